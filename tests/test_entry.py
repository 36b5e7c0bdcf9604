"""The driver contract."""

import __spark_entry__ as entry


def test_entry(spark):
    out = entry.entry(spark)
    assert {"location", "aqi", "aqi_category", "pm2_5_rolling_std_48h"} <= set(out.columns)
    assert out.count() == 4


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
