"""Seawater properties as column expressions, from the published formulas.

Density is the 75-term TEOS-10 polynomial (Roquet et al., 2015), conservative
temperature the TEOS-10 potential-enthalpy polynomial. Absolute salinity uses
the reference composition without the regional anomaly table, and potential
temperature the TEOS-10 starting polynomial without its refinement steps; both
shift absolute values slightly and cancel in vertical differences.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.rounding import round_even

SP_TO_SA = 35.16504 / 35.0
CP0 = 3991.86795711963
S_FACTOR = 0.0248826675584615

# Specific volume coefficients, keyed by the powers of
# (sqrt salinity, temperature, pressure).
SPECVOL = {
    (0, 0, 0): 1.0769995862e-3, (0, 0, 1): -6.0799143809e-5, (0, 0, 2): 9.9856169219e-6,
    (0, 0, 3): -1.1309361437e-6, (0, 0, 4): 1.0531153080e-7, (0, 0, 5): -1.2647261286e-8,
    (0, 0, 6): 1.9613503930e-9,
    (0, 1, 0): -1.5649734675e-5, (0, 1, 1): 1.8505765429e-5, (0, 1, 2): -1.1736386731e-6,
    (0, 1, 3): -3.6527006553e-7, (0, 1, 4): 3.1454099902e-7,
    (0, 2, 0): 2.7762106484e-5, (0, 2, 1): -1.1716606853e-5, (0, 2, 2): 2.1305028740e-6,
    (0, 2, 3): 2.8695905159e-7,
    (0, 3, 0): -1.6521159259e-5, (0, 3, 1): 7.9279656173e-6, (0, 3, 2): -4.6132540037e-7,
    (0, 4, 0): 6.9111322702e-6, (0, 4, 1): -3.4102187482e-6, (0, 4, 2): -6.3352916514e-8,
    (0, 5, 0): -8.0539615540e-7, (0, 5, 1): 5.0736766814e-7,
    (0, 6, 0): 2.0543094268e-7,
    (1, 0, 0): -3.1038981976e-4, (1, 0, 1): 2.4262468747e-5, (1, 0, 2): -5.8484432984e-7,
    (1, 0, 3): 3.6310188515e-7, (1, 0, 4): -1.1147125423e-7,
    (1, 1, 0): 3.5009599764e-5, (1, 1, 1): -9.5677088156e-6, (1, 1, 2): -5.5699154557e-6,
    (1, 1, 3): -2.7295696237e-7,
    (1, 2, 0): -3.7435842344e-5, (1, 2, 1): -2.3678308361e-7, (1, 2, 2): 3.9137387080e-7,
    (1, 3, 0): 2.4141479483e-5, (1, 3, 1): -3.4558773655e-6, (1, 3, 2): 7.7618888092e-9,
    (1, 4, 0): -8.7595873154e-6, (1, 4, 1): 1.2956717783e-6,
    (1, 5, 0): -3.3052758900e-7,
    (2, 0, 0): 6.6928067038e-4, (2, 0, 1): -3.4792460974e-5, (2, 0, 2): -4.8122251597e-6,
    (2, 0, 3): 1.6746303780e-8,
    (2, 1, 0): -4.3592678561e-5, (2, 1, 1): 1.1100834765e-5, (2, 1, 2): 5.4620748834e-6,
    (2, 2, 0): 3.5907822760e-5, (2, 2, 1): 2.9283346295e-6, (2, 2, 2): -6.5731104067e-7,
    (2, 3, 0): -1.4353633048e-5, (2, 3, 1): 3.1655306078e-7,
    (2, 4, 0): 4.3703680598e-6,
    (3, 0, 0): -8.5047933937e-4, (3, 0, 1): 3.7470777305e-5, (3, 0, 2): 4.9263106998e-6,
    (3, 1, 0): 3.4532461828e-5, (3, 1, 1): -9.8447117844e-6, (3, 1, 2): -1.3544185627e-6,
    (3, 2, 0): -1.8698584187e-5, (3, 2, 1): -4.8826139200e-7,
    (3, 3, 0): 2.2863324556e-6,
    (4, 0, 0): 5.8086069943e-4, (4, 0, 1): -1.7322218612e-5, (4, 0, 2): -1.7811974727e-6,
    (4, 1, 0): -1.1959409788e-5, (4, 1, 1): 2.5909225260e-6,
    (4, 2, 0): 3.8595339244e-6,
    (5, 0, 0): -2.1092370507e-4, (5, 0, 1): 3.0927427253e-6,
    (5, 1, 0): 1.3864594581e-6,
    (6, 0, 0): 3.1932457305e-5,
}

# Potential enthalpy coefficients, keyed by the powers of
# (sqrt salinity, temperature).
POT_ENTHALPY = {
    (0, 0): 61.01362420681071, (0, 1): 168776.46138048015, (0, 2): -2735.2785605119625,
    (0, 3): 2574.2164453821433, (0, 4): -1536.6644434977543, (0, 5): 545.7340497931629,
    (0, 6): -50.91091728474331, (0, 7): -18.30489878927802,
    (2, 0): 268.5520265845071, (2, 1): -12019.028203559312, (2, 2): 3734.858026725145,
    (2, 3): -2046.7671145057618, (2, 4): 465.28655623826234, (2, 5): -0.6370820302376359,
    (2, 6): -10.650848542359153,
    (3, 0): 937.2099110620707, (3, 1): 588.1802812170108, (3, 2): 248.39476522971285,
    (3, 3): -3.871557904936333, (3, 4): -2.6268019854268356,
    (4, 0): -1687.914374187449, (4, 1): 936.3206544460336, (4, 2): -942.7827304544439,
    (4, 3): 369.4389437509002, (4, 4): -33.83664947895248, (4, 5): -9.987880382780322,
    (5, 0): 246.9598888781377, (6, 0): 123.59576582457964, (7, 0): -48.5891069025409,
}

# Starting polynomial of potential temperature.
PT0 = {"1": 8.65483913395442e-6, "s": -1.41636299744881e-6, "p": -7.38286467135737e-9,
       "t": -8.38241357039698e-6, "ts": 2.83933368585534e-8, "tt": 1.77803965218656e-8,
       "tp": 1.71155619208233e-10}


def _horner(terms: dict[tuple, float], names: tuple[str, ...]) -> str:
    """Nested polynomial over several columns, as expression text (building it
    from hundreds of Column objects would cost seconds per plan)."""
    if not names:
        return f"{terms[()]!r}D"
    by_power: dict[int, dict[tuple, float]] = {}
    for powers, coef in terms.items():
        by_power.setdefault(powers[0], {})[powers[1:]] = coef
    total = ""
    for power in range(max(by_power), -1, -1):
        part = _horner(by_power[power], names[1:]) if power in by_power else "0D"
        total = f"({total} * {names[0]} + {part})" if total else part
    return total


def with_seawater(df: DataFrame, practical: Column, temperature: Column,
                  pressure: Column) -> DataFrame:
    """Add ``sa`` (absolute salinity), ``pt`` (potential temperature), ``ct``
    (conservative temperature) and ``sigma0`` (potential density anomaly)."""
    k = {n: f"({v!r}D)" for n, v in PT0.items()}
    pt = (f"_t + _p * ({k['1']} + _s * {k['s']} + _p * {k['p']} + _t * ({k['t']} + _s * {k['ts']}"
          f" + _t * {k['tt']} + _p * {k['tp']}))")
    return (df.withColumns({"sa": F.when(practical >= 0, practical) * F.lit(SP_TO_SA),
                            "_t": temperature, "_p": pressure})
            .withColumn("_s", F.col("sa") * F.lit(35.0 / 35.16504))
            .withColumn("pt", F.expr(pt))
            .withColumns({"_x": _filled(F.sqrt(F.col("sa") * F.lit(S_FACTOR))),
                          "_y": _filled(F.col("pt") * 0.025)})
            .withColumn("ct", F.when(F.col("pt").isNotNull(),
                                     F.expr(f"({_horner(POT_ENTHALPY, ('_x', '_y'))}) / {CP0!r}D")))
            .transform(with_density, F.col("sa"), F.col("ct"), F.lit(0.0), "sigma0")
            .withColumn("sigma0", F.col("sigma0") - 1000.0)
            .drop("_t", "_p", "_s", "_x", "_y"))


def _filled(value: Column) -> Column:
    """Never null: without null checks a long polynomial stays inside one
    generated method. Rows that were null are blanked afterwards."""
    return F.coalesce(value, F.lit(0.0))


def with_density(df: DataFrame, sa: Column, ct: Column, p: Column, out: str) -> DataFrame:
    """Add in-situ density (kg/m3)."""
    root = F.sqrt(sa * F.lit(S_FACTOR) + F.lit(0.5971840214030754))
    return (df.withColumns({"_dx": _filled(root), "_dy": _filled(ct * 0.025),
                            "_dz": _filled(p * 1e-4),
                            "_dk": root.isNotNull() & ct.isNotNull() & p.isNotNull()})
            .withColumn(out, F.when(F.col("_dk"),
                                    F.expr(f"1D / ({_horner(SPECVOL, ('_dx', '_dy', '_dz'))})")))
            .drop("_dx", "_dy", "_dz", "_dk"))


def depth_from_pressure(p: Column, latitude: float | Column, subtract_atmosphere: bool = True) -> Column:
    """UNESCO (1983) depth in metres, rounded half-even to centimetres.

    Fixed values: the coefficients are those of the published formula.
    """
    if subtract_atmosphere:
        p = p - F.lit(10.1325)
    latitude = latitude if isinstance(latitude, Column) else F.lit(float(latitude))
    x = F.pow(F.sin(latitude / 57.29578), F.lit(2.0))
    g = F.lit(9.780318) * (F.lit(1.0) + (F.lit(5.2788e-3) + F.lit(2.36e-5) * x) * x) + F.lit(1.092e-6) * p
    metres = ((((F.lit(-1.82e-15) * p + F.lit(2.279e-10)) * p - F.lit(2.2512e-5)) * p
               + F.lit(9.72659)) * p) / g
    return round_even(metres, 2)
