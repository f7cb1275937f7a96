import numpy as np
import pandas as pd


def series(spark, values, start="2026-01-01", step="60s", name="s", **extra):
    """One series as rows (series_id, sample_no, ts, v, ...)."""
    n = len(values)
    pdf = pd.DataFrame({"series_id": name, "sample_no": np.arange(n), "ts": pd.date_range(start, periods=n, freq=step),
                        "v": pd.array([None if v is None or (isinstance(v, float) and np.isnan(v)) else float(v) for v in values], dtype="Float64"),
                        **extra})
    return frame(spark, pdf)


def frame(spark, pdf):
    """A pandas frame as rows; missing values become NULL, stamps zone-less."""
    types = []
    for c in pdf.columns:
        t = pdf[c].dtype
        if str(t).startswith("datetime"):
            types.append(f"`{c}` timestamp_ntz")
        elif pd.api.types.is_bool_dtype(t):
            types.append(f"`{c}` boolean")
        elif pd.api.types.is_integer_dtype(t):
            types.append(f"`{c}` bigint")
        elif pd.api.types.is_float_dtype(t):
            types.append(f"`{c}` double")
        else:
            types.append(f"`{c}` string")
    rows = [tuple(None if pd.isna(x) else x.to_pydatetime() if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x
                  for x in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, ", ".join(types))


def column(df, name, by="sample_no"):
    return [r[name] for r in df.orderBy(by).select(name).collect()]
