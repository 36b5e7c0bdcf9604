"""Breakpoints, labels, colours and texts that results must equal."""

# US EPA breakpoints: concentration low, concentration high, index low, index high.
EPA_PM25 = [
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 350.4, 301, 400),
    (350.5, 500.4, 401, 500),
]
EPA_PM10 = [
    (0, 54, 0, 50),
    (55, 154, 51, 100),
    (155, 254, 101, 150),
    (255, 354, 151, 200),
    (355, 424, 201, 300),
    (425, 504, 301, 400),
    (505, 604, 401, 500),
]
EPA_MAX_INDEX = 500

# EPA index bands: upper bound (None = open), label, colour, level, message.
EPA_BANDS = [
    (50, "Good", "#00E400", 1,
     "Air quality is satisfactory, and air pollution poses little or no risk."),
    (100, "Moderate", "#FFFF00", 2,
     "Air quality is acceptable. However, there may be a risk for some people, "
     "particularly those who are unusually sensitive to air pollution."),
    (150, "Unhealthy for Sensitive Groups", "#FF7E00", 3,
     "Members of sensitive groups may experience health effects. "
     "The general public is less likely to be affected."),
    (200, "Unhealthy", "#FF0000", 4,
     "Some members of the general public may experience health effects; "
     "members of sensitive groups may experience more serious health effects."),
    (300, "Very Unhealthy", "#8F3F97", 5,
     "Health alert: The risk of health effects is increased for everyone."),
    (None, "Hazardous", "#7E0023", 6,
     "Health warning of emergency conditions:  everyone is more likely to be affected."),
]
# The exploratory report shortens one EPA label.
EPA_SHORT_LABELS = {"Unhealthy for Sensitive Groups": "Unhealthy for Sensitive"}

# Five-step scale: upper bound (None = open), label, colour, message.
FIVE_STEP_BANDS = [
    (1.5, "Good", "#00E400",
     "Air quality is satisfactory, air pollution poses little or no risk."),
    (2.5, "Fair", "#FFFF00",
     "Air quality is acceptable. However, there may be a risk for some people."),
    (3.5, "Moderate", "#FF7E00",
     "Members of sensitive groups may experience health effects."),
    (4.5, "Poor", "#FF0000",
     "Everyone may begin to experience health effects."),
    (None, "Very Poor", "#8F3F97",
     "Health warning of emergency conditions. Everyone is more likely to be affected."),
]
DARK_TEXT_UP_TO = 2.5
FIVE_STEP_SCALE_NAME = "1-5 (OpenWeather)"

# Named index ranges: name, low, high.
INDEX_RANGES = [
    ("good", 0, 50),
    ("moderate", 51, 100),
    ("unhealthy_sensitive", 101, 150),
    ("unhealthy", 151, 200),
    ("very_unhealthy", 201, 300),
    ("hazardous", 301, 500),
]

HORIZONS = ["24h", "48h", "72h"]
POLLUTANTS = ["pm2_5", "pm10", "no2", "o3", "so2", "co"]
DEFAULT_LOCATION = "Karachi"

# Columns that are never model features, per trainer.
NOT_FEATURES_ADAPTIVE = [
    "timestamp", "location", "_id", "target_aqi", "aqi", "source", "gap",
    "weather_main", "weather_description", "co", "no", "no2", "o3", "so2",
    "feels_like", "temp_min", "temp_max", "wind_direction", "wind_gust", "visibility",
]
NOT_FEATURES_FULL = [
    "_id", "timestamp", "location", "source", "weather_main", "weather_description",
    "aqi_24h_ahead", "aqi_48h_ahead", "aqi_72h_ahead",
]
# Our own bookkeeping columns, excluded everywhere.
BOOKKEEPING = ["seq", "ingestion_timestamp", "batch_id"]
METADATA_COLUMNS = [
    "batch_id", "split", "model_version", "creation_timestamp", "source", "ingestion_timestamp",
]
COORDINATE_NAMES = ["latitude", "longitude", "lat", "lon"]
CORRELATION_FEATURES = [
    "aqi", "pm2_5", "pm10", "no2", "o3", "so2", "co",
    "temperature", "humidity", "pressure", "wind_speed",
]
TARGET_CANDIDATES = ["aqi", "target", "y", "label", "pm2_5", "AQI"]
REPORT_TIME_CANDIDATES = ["timestamp", "created_at", "collected_at", "time"]
TIME_CANDIDATES = ["timestamp", "created_at", "date", "datetime"]
VALIDATED_FIELDS = ["pm2_5", "pm10", "temperature", "humidity", "pressure", "wind_speed"]

# Ingest gate and quality thresholds.
GATE_MINUTES = 45
GATE_TOLERANCE = 0.5
RUN_GAP_MINUTES = 90
LARGE_GAP_HOURS = 2
FILL_GAP_HOURS = 3
LAG_RUN = 12
FORECAST_RUN = 24
