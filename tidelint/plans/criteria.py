"""Quality criteria: switches, numeric limits and statistical factors."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Canonical column, variable key, sensor range, environmental
# range. None means the range test does not exist for the variable.
VARIABLES = {
    "T": ("Temperature (degC)", (-5.0, 40.0), (8.0, 35.0)),
    "S": ("Salinity (PSU)", (0.0, 45.0), (20.0, 37.5)),
    "C": ("Conductivity (mS/cm)", (0.0, 75.0), (5.0, 75.0)),
    "P": ("Pressure (dbar)", (0.0, 6000.0), (0.0, 6000.0)),
    "O2": ("O2 level (uM)", (0.0, 500.0), (120.0, 450.0)),
    "pH": ("pH", (0.0, 14.0), (7.5, 8.4)),
    "chl": ("Chlorophyll (ug/L)", (0.0, 500.0), (0.0, 30.0)),
    "tur": ("Turbidity (FTU)", (0.0, 1500.0), (0.0, 50.0)),
    "PAR": ("PAR (umol/m2/s)", (0.0, 5000.0), (0.0, 4000.0)),
    "CO2": ("CO2 Level (ppm)", (0.0, 10000.0), (100.0, 2000.0)),
    "org": ("Dissolved organic matter (ppb)", None, (0.0, 50.0)),
}

# Regions and their representative coordinates.
REGIONS = (
    ("Amazonian Reefs / North (AP-MA)", -1.0, -46.0),
    ("Northeast - northern (CE-RN)", -4.5, -37.5),
    ("Northeast - eastern (PB-AL)", -8.5, -35.0),
    ("East / Abrolhos (BA-ES)", -17.5, -39.0),
    ("Southeast (RJ-SP)", -23.5, -43.0),
    ("South (PR-RS)", -30.0, -49.0),
)


@dataclass(frozen=True)
class Factor:
    """Multiples of the local spread, and the window it is taken over."""
    suspect: float = 2.5
    fail: float = 3.0
    window: str = "30M"


@dataclass(frozen=True)
class Criteria:
    """Everything a user may tune. Defaults are the published ones."""
    sensor: dict[str, tuple[float, float]] = field(default_factory=lambda: {
        k: s for k, (_c, s, _e) in VARIABLES.items() if s})
    environment: dict[str, tuple[float, float]] = field(default_factory=lambda: {
        k: e for k, (_c, _s, e) in VARIABLES.items() if e})
    logger_sensor_temp: tuple[float, float] = (-5.0, 40.0)
    spike: dict[str, Factor] = field(default_factory=lambda: {k: Factor() for k in VARIABLES})
    rate: dict[str, Factor] = field(default_factory=lambda: {k: Factor() for k in "TSCP"})
    gradient: dict[str, Factor] = field(default_factory=lambda: {k: Factor() for k in "TSC"})
    logger_spike: Factor = Factor()
    logger_rate: Factor = Factor()
    flat_fail: int = 20
    flat_suspect: int = 15
    logger_flat_fail: int = 20
    logger_flat_suspect: int = 15
    density_tolerance: float = 0.03
    light_baseline_days: int = 7
    light_cutoff_fraction: float = 0.5
    light_sustain_days: int = 3
    light_fixed_days: int = 60
    edge_temperature_tolerance: float = 1.5
    latitude: float = -17.5
    off: frozenset[str] = frozenset({"pressure flat line"})

    def with_off(self, *switches: str) -> Criteria:
        return replace(self, off=self.off | set(switches))

    def with_on(self, *switches: str) -> Criteria:
        return replace(self, off=self.off - set(switches))


# What a light logger's switches are called after its prefix.
LOGGER_SWITCHES = ("temperature sensor range", "temperature environmental range", "temperature spikes",
                   "temperature rate of change", "temperature flat line", "light fouling window")


def migrate(old: dict) -> Criteria:
    """Criteria from a flat settings dict with keys such as ``env_max_temp``.

    Switches are ``{name: 'ON' | 'OFF'}``, a light logger's begin with ``hobo``;
    factors are ``{key: {'susp': x, 'fail': y, 'window': z}}``. Settings from
    before loggers had their own (``rep_cnt_fail``, ``sensor_max_temp``, a
    shared switch, one factor row a variable such as ``'T'``) count for both
    instruments wherever the newer key is not given. Other keys are ignored.
    """
    base = Criteria()
    # Short names of the variables inside setting keys.
    short = {"temp": "T", "sal": "S", "cond": "C", "pres": "P", "O2": "O2", "pH": "pH",
             "chl": "chl", "tur": "tur", "PAR": "PAR", "CO2": "CO2", "org": "org"}

    def first(default, *names):
        return type(default)(next((old[n] for n in names if n in old), default))

    def limits(defaults, prefix):
        return {key: (first(defaults[key][0], f"{prefix}_min_{name}"), first(defaults[key][1], f"{prefix}_max_{name}"))
                for name, key in short.items() if key in defaults}

    def factor(default: Factor, *names):
        row = next((old[n] for n in names if isinstance(old.get(n), dict)), {})
        return Factor(float(row.get("susp", default.suspect)), float(row.get("fail", default.fail)), row.get("window", default.window))

    def factors(defaults, family):
        return {v: factor(f, f"sg_{family}_{v}", v) for v, f in defaults.items()}

    states = {name: state for name, state in old.items() if state in ("ON", "OFF")}
    switches = {f"logger {n}": states[n] for n in LOGGER_SWITCHES if n in states}
    switches |= {f"logger {n[5:]}" if n.startswith("hobo ") else n: state for n, state in states.items()}
    turned_off = {n for n, state in switches.items() if state == "OFF"}
    low, high = base.logger_sensor_temp
    return replace(
        base, sensor=limits(base.sensor, "sensor"), environment=limits(base.environment, "env"),
        off=frozenset((base.off - set(switches)) | turned_off),
        logger_sensor_temp=(first(low, "hobo_sensor_min_temp", "sensor_min_temp"), first(high, "hobo_sensor_max_temp", "sensor_max_temp")),
        spike=factors(base.spike, "spike"), rate=factors(base.rate, "rate"), gradient=factors(base.gradient, "gradient"),
        logger_spike=factor(base.logger_spike, "hobo_spike_T", "T"), logger_rate=factor(base.logger_rate, "hobo_rate_T", "T"),
        flat_fail=first(base.flat_fail, "seaguard_flat_fail", "rep_cnt_fail"),
        flat_suspect=first(base.flat_suspect, "seaguard_flat_susp", "rep_cnt_susp"),
        logger_flat_fail=first(base.logger_flat_fail, "hobo_flat_fail", "rep_cnt_fail"),
        logger_flat_suspect=first(base.logger_flat_suspect, "hobo_flat_susp", "rep_cnt_susp"),
        density_tolerance=first(base.density_tolerance, "dens_inv_tolerance"),
        light_baseline_days=first(base.light_baseline_days, "lux_baseline_days"),
        light_cutoff_fraction=first(base.light_cutoff_fraction, "lux_cutoff_frac"),
        light_sustain_days=first(base.light_sustain_days, "lux_sustain_days"),
        light_fixed_days=first(base.light_fixed_days, "lux_fixed_days"))
