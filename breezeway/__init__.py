"""breezeway: hourly sensor series (air quality, weather) as Spark DataFrames.

Every operator takes and returns a ``DataFrame``; column names are arguments
with the air-quality names as defaults.
"""

from breezeway.operators.series import Series

__all__ = ["Series"]
