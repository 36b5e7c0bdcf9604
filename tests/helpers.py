"""Random readings and frame comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd

READING_DDL = (
    "seq long, location string, timestamp timestamp, pm2_5 double, pm10 double, aqi int, no2 double, o3 double, "
    "temperature double, humidity double, pressure double, wind_speed double, clouds double"
)


def random_readings(spark, rows=600, seed=0, hot_share=0.5):
    """Irregular readings: one hot station, a NULL station, tied times, missing values."""
    rng = np.random.default_rng(seed)
    others = np.array(["b", "c", None], dtype=object)
    station = np.where(rng.random(rows) < hot_share, "a", others[rng.integers(0, 3, rows)])
    minutes = rng.integers(0, rows * 20, rows) // 10 * 10
    quarter = lambda hi: rng.integers(0, hi * 4, rows) / 4.0
    no2, o3 = quarter(50), quarter(50)
    pm = quarter(100)
    pdf = pd.DataFrame({
        "seq": rng.permutation(rows), "location": station,
        "timestamp": pd.Timestamp("2024-01-01") + pd.to_timedelta(minutes, unit="min"),
        "pm2_5": pm, "pm10": pm + quarter(20), "aqi": rng.integers(1, 6, rows),
        "no2": np.where(rng.random(rows) < 0.4, None, no2), "o3": np.where(rng.random(rows) < 0.4, None, o3),
        "temperature": quarter(30), "humidity": quarter(90), "pressure": 1000 + quarter(20),
        "wind_speed": quarter(10), "clouds": quarter(100),
    })
    records = [tuple(None if pd.isna(v) else v for v in row) for row in pdf.itertuples(index=False, name=None)]
    plain = lambda v: v.to_pydatetime() if hasattr(v, "to_pydatetime") else v.item() if hasattr(v, "item") else v
    records = [tuple(plain(v) for v in row) for row in records]
    return spark.createDataFrame(records, READING_DDL)


def rows_of(df, places=7):
    """Sorted, rounded rows of a frame for equality tests."""
    def cell(v):
        if isinstance(v, float):
            return round(v, places) + 0.0
        return v

    names = sorted(df.columns)
    out = [tuple(cell(r[n]) for n in names) for r in df.select(*names).collect()]
    return sorted(out, key=repr)
