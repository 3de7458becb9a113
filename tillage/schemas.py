"""Column names, keys and year bounds of the crop/weather data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names, keys and split years of the data model.
ENTITY_COLUMNS = ["State_Name", "District_Name", "Season", "Crop"]
JOIN_KEYS = ["State_Name", "District_Name", "Crop_Year", "Season", "Crop"]
CROP_COLUMNS = [*JOIN_KEYS, "Area", "Production", "yield"]
COORD_COLUMNS = ["State_Name", "District_Name", "latitude", "longitude"]

# The weather features of the data model, in their file order.
WEATHER_COLUMNS = [
    "rain_sum_mm",
    "rainy_days_ge1mm",
    "dry_days_lt1mm",
    "longest_dry_spell_days",
    "longest_wet_spell_days",
    "heavy_rain_days_ge20mm",
    "temp_mean_c",
    "temp_max_mean_c",
    "temp_min_mean_c",
    "hot_days_tmax_ge35c",
    "humidity_mean_pct",
    "solar_mean",
    "planting_dry_flag",
    "harvest_too_wet_flag",
]

TARGET, YEAR, LAG = "yield", "Crop_Year", "lag_yield"
# Fixed values: (name, first year, last year) of each chronological split, ends included.
SPLITS = [("train", 1997, 2010), ("validation", 2011, 2012), ("test", 2013, 2014)]


def text_schema(columns: list[str]) -> T.StructType:
    """Every column as text: types are decided by explicit, lenient casts, never by inference."""
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])
