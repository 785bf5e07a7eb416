"""Fixed values of the air-quality domain.

Everything in this module is data, not logic.  Values marked FIXED VALUES must
stay exactly as they are for results to agree with the application whose
behaviour this library reproduces.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: canonical pollutants, in the order the application lists them.
# (display name, internal column name)
# ---------------------------------------------------------------------------
POLLUTANTS = [
    ("PM2.5", "pm25"),
    ("PM10", "pm10"),
    ("NO", "no"),
    ("NO2", "no2"),
    ("NOx", "nox"),
    ("NH3", "nh3"),
    ("CO", "co"),
    ("SO2", "so2"),
    ("O3", "o3"),
    ("Benzene", "benzene"),
    ("Toluene", "toluene"),
    ("Xylene", "xylene"),
]
POLLUTANT_NAMES = [p for p, _ in POLLUTANTS]
POLLUTANT_COLUMNS = [c for _, c in POLLUTANTS]
COLUMN_OF = dict(POLLUTANTS)

# FIXED VALUES: raw pollutant id (upper-cased) -> canonical name.
POLLUTANT_ALIASES = {
    "PM2.5": "PM2.5",
    "PM10": "PM10",
    "NO": "NO",
    "NO2": "NO2",
    "NOX": "NOx",
    "NH3": "NH3",
    "CO": "CO",
    "SO2": "SO2",
    "O3": "O3",
    "OZONE": "O3",
    "BENZENE": "Benzene",
    "TOLUENE": "Toluene",
    "XYLENE": "Xylene",
    "C6H6": "Benzene",
    "C7H8": "Toluene",
    "C8H10": "Xylene",
}

# FIXED VALUES: universal defaults used to complete a pollutant row.
UNIVERSAL_DEFAULTS = {
    "PM2.5": 50.0,
    "PM10": 80.0,
    "NO": 20.0,
    "NO2": 40.0,
    "NOx": 60.0,
    "NH3": 25.0,
    "CO": 1.5,
    "SO2": 30.0,
    "O3": 80.0,
    "Benzene": 2.0,
    "Toluene": 5.0,
    "Xylene": 3.0,
}

# FIXED VALUES: default for a target pollutant whose column is entirely null;
# any other target falls back to TARGET_FALLBACK_DEFAULT.
TARGET_DEFAULTS = {"PM2.5": 50.0, "PM10": 80.0, "NO2": 40.0, "SO2": 30.0, "CO": 1.5, "O3": 80.0}
TARGET_FALLBACK_DEFAULT = 50.0

# FIXED VALUES: city-specific defaults (PM2.5, PM10, NO2, SO2).
CITY_DEFAULTS = {
    "Delhi": (150.0, 200.0, 45.0, 30.0),
    "Mumbai": (70.0, 120.0, 35.0, 25.0),
    "Kolkata": (90.0, 150.0, 40.0, 28.0),
    "Chennai": (50.0, 80.0, 25.0, 18.0),
    "Bengaluru": (55.0, 90.0, 30.0, 20.0),
    "Hyderabad": (65.0, 110.0, 35.0, 22.0),
    "Ahmedabad": (85.0, 140.0, 38.0, 26.0),
    "Pune": (60.0, 100.0, 32.0, 21.0),
    "Jaipur": (95.0, 160.0, 40.0, 24.0),
    "Lucknow": (110.0, 180.0, 42.0, 27.0),
    "Kanpur": (125.0, 190.0, 44.0, 29.0),
    "Nagpur": (75.0, 125.0, 33.0, 23.0),
}
CITY_DEFAULT_FALLBACK = "Delhi"

# ---------------------------------------------------------------------------
# FIXED VALUES: AQI breakpoints.  Per pollutant, the five finite bins as
# (conc_lo, conc_hi, aqi_lo, aqi_hi); a concentration above the last conc_hi
# lies in the open top bin whose index is always TOP_BIN_AQI.
# ---------------------------------------------------------------------------
AQI_BREAKPOINTS = {
    "PM2.5": [(0, 30, 0, 50), (30, 60, 51, 100), (60, 90, 101, 200), (90, 120, 201, 300), (120, 250, 301, 400)],
    "PM10": [(0, 50, 0, 50), (50, 100, 51, 100), (100, 250, 101, 200), (250, 350, 201, 300), (350, 430, 301, 400)],
    "NO2": [(0, 40, 0, 50), (40, 80, 51, 100), (80, 180, 101, 200), (180, 280, 201, 300), (280, 400, 301, 400)],
    "SO2": [(0, 40, 0, 50), (40, 80, 51, 100), (80, 380, 101, 200), (380, 800, 201, 300), (800, 1600, 301, 400)],
    "CO": [(0, 1.0, 0, 50), (1.0, 2.0, 51, 100), (2.0, 10, 101, 200), (10, 17, 201, 300), (17, 34, 301, 400)],
    "O3": [(0, 50, 0, 50), (50, 100, 51, 100), (100, 168, 101, 200), (168, 208, 201, 300), (208, 748, 301, 400)],
}
TOP_BIN_AQI = 401
AQI_WHEN_NO_POLLUTANT = 50

# FIXED VALUES: AQI categories (upper bound inclusive, label, health text, colour).
AQI_CATEGORIES = [
    (50, "Good", "Minimal Impact", "green"),
    (100, "Satisfactory", "Minor Breathing Discomfort", "yellow"),
    (200, "Moderate", "Breathing Discomfort", "orange"),
    (300, "Poor", "Respiratory Illness", "red"),
    (400, "Very Poor", "Respiratory Effects", "purple"),
    (None, "Severe", "Emergency Conditions", "black"),
]
CATEGORY_FILL = "Moderate"

# FIXED VALUES: display units by pollutant.
POLLUTANT_UNITS = {
    "PM2.5": "µg/m³",
    "PM10": "µg/m³",
    "NO2": "ppb",
    "SO2": "ppb",
    "O3": "ppb",
    "CO": "mg/m³",
}

# FIXED VALUES: accepted input range per pollutant, from 0 to the value below.
INPUT_BOUNDS = {
    "PM2.5": 500.0,
    "PM10": 600.0,
    "NO": 200.0,
    "NO2": 200.0,
    "NOx": 300.0,
    "NH3": 400.0,
    "CO": 30.0,
    "SO2": 400.0,
    "O3": 300.0,
    "Benzene": 50.0,
    "Toluene": 200.0,
    "Xylene": 200.0,
}

# FIXED VALUES: plausibility of an AQI given PM2.5.
# (PM2.5 upper bound inclusive, expected AQI low, expected AQI high); None = above all.
SANITY_RANGES = [
    (30, 23, 100),
    (60, 80, 180),
    (90, 150, 250),
    (120, 200, 310),
    (160, 280, 370),
    (250, 350, 500),
    (None, 450, 677),
]
SANITY_TOLERANCE = 50
LINEAR_SLOPE = 2.14
LINEAR_INTERCEPT = 9.3
LINEAR_MAX_DIFF = 80
NO2_WARN = 200
SO2_WARN = 80

# FIXED VALUES: seasons by (month % 12 + 3) div 3.
SEASON_NAMES = {1: "Winter", 2: "Spring", 3: "Summer", 4: "Fall"}

# FIXED VALUES: six-key current weather defaults.
WEATHER_KEY_DEFAULTS = {"T": 25.0, "RH": 65.0, "WS": 5.0, "WD": 180.0, "RF": 0.0, "BP": 1013.0}
WEATHER_KEY_LABELS = {
    "T": "Temperature (°C)",
    "RH": "Relative Humidity (%)",
    "WS": "Wind Speed (km/h)",
    "WD": "Wind Direction (°)",
    "RF": "Rainfall (mm)",
    "BP": "Atmospheric Pressure (hPa)",
}

# FIXED VALUES: fifteen daily weather variables and their defaults.
DAILY_WEATHER_DEFAULTS = {
    "temperature_2m_max": 32.0,
    "temperature_2m_min": 22.0,
    "temperature_2m_mean": 27.0,
    "relative_humidity_2m_max": 75.0,
    "relative_humidity_2m_min": 45.0,
    "relative_humidity_2m_mean": 60.0,
    "precipitation_sum": 0.0,
    "rain_sum": 0.0,
    "snowfall_sum": 0.0,
    "wind_speed_10m_max": 15.0,
    "wind_speed_10m_mean": 8.0,
    "wind_direction_10m_dominant": 180.0,
    "wind_gusts_10m_max": 20.0,
    "pressure_msl_mean": 1013.0,
    "sunshine_duration": 28800.0,
}
DAILY_WEATHER_VARS = list(DAILY_WEATHER_DEFAULTS)

# FIXED VALUES: spreads used to synthesise daily features from six keys.
SYNTH_TEMP_SPREAD = 5.0
SYNTH_RH_SPREAD = 10.0
SYNTH_WIND_SPREAD = 3.0
SYNTH_GUST_EXTRA = 2.0
SYNTH_SUNSHINE = 28800.0

# FIXED VALUES: city coordinates (27 cities, alphabetical); default Delhi.
CITY_COORDINATES = {
    "Ahmedabad": (23.0225, 72.5714),
    "Aizawl": (23.7367, 92.7173),
    "Amaravati": (16.5062, 80.6480),
    "Amritsar": (31.6340, 74.8723),
    "Bengaluru": (12.9716, 77.5946),
    "Bhopal": (23.2599, 77.4126),
    "Brajrajnagar": (21.8245, 83.9186),
    "Chandigarh": (30.7333, 76.7794),
    "Chennai": (13.0827, 80.2707),
    "Coimbatore": (11.0168, 76.9558),
    "Delhi": (28.7041, 77.1025),
    "Ernakulam": (9.9312, 76.2673),
    "Gurugram": (28.4595, 77.0266),
    "Guwahati": (26.1445, 91.7362),
    "Hyderabad": (17.3850, 78.4867),
    "Jaipur": (26.9124, 75.7873),
    "Jorapokhar": (23.7957, 86.4304),
    "Kochi": (9.9312, 76.2673),
    "Kolkata": (22.5726, 88.3639),
    "Lucknow": (26.8467, 80.9462),
    "Mumbai": (19.0760, 72.8777),
    "Patna": (25.5941, 85.1376),
    "Pune": (18.5204, 73.8567),
    "Rajkot": (22.3039, 70.8022),
    "Shillong": (25.5788, 91.8933),
    "Thiruvananthapuram": (8.5241, 76.9366),
    "Visakhapatnam": (17.6868, 83.2185),
    "Agra": (27.1767, 78.0081),
    "Allahabad": (25.4358, 81.8463),
    "Aurangabad": (19.8762, 75.3433),
    "Dhanbad": (23.7957, 86.4304),
    "Faridabad": (28.4089, 77.3178),
    "Ghaziabad": (28.6692, 77.4538),
    "Gwalior": (26.2183, 78.1828),
    "Howrah": (22.5958, 88.2636),
    "Indore": (22.7196, 75.8577),
    "Jabalpur": (23.1815, 79.9864),
    "Jodhpur": (26.2389, 73.0243),
    "Kalyan-Dombivali": (19.2403, 73.1305),
    "Kanpur": (26.4499, 80.3319),
    "Kota": (25.2138, 75.8648),
    "Ludhiana": (30.9010, 75.8573),
    "Madurai": (9.9252, 78.1198),
    "Meerut": (28.9845, 77.7064),
    "Nagpur": (21.1458, 79.0882),
    "Nashik": (19.9975, 73.7898),
    "Navi Mumbai": (19.0330, 73.0297),
    "Raipur": (21.2514, 81.6296),
    "Ranchi": (23.3441, 85.3096),
    "Srinagar": (34.0837, 74.7973),
    "Vadodara": (22.3072, 73.1812),
    "Varanasi": (25.3176, 82.9739),
    "Vasai-Virar": (19.4912, 72.8054),
    "Vijayawada": (16.5062, 80.6480),
}
DEFAULT_CITY = "Delhi"

# FIXED VALUES: city information (lat, lon, region, population); default below.
CITY_INFO = {
    "Delhi": (28.70, 77.10, "North India", "32M"),
    "Mumbai": (19.08, 72.88, "West India", "21M"),
    "Kolkata": (22.57, 88.36, "East India", "15M"),
    "Chennai": (13.08, 80.27, "South India", "11M"),
    "Bengaluru": (12.97, 77.59, "South India", "13M"),
    "Hyderabad": (17.39, 78.49, "South India", "10M"),
    "Ahmedabad": (23.02, 72.57, "West India", "8M"),
    "Pune": (18.52, 73.86, "West India", "7M"),
    "Jaipur": (26.91, 75.79, "North India", "4M"),
    "Lucknow": (26.85, 80.95, "North India", "3M"),
}
CITY_INFO_DEFAULT = (28.70, 77.10, "India", None)

# FIXED VALUES: target pollutants of the six-output model and the pollutants
# used as its features.
TARGET_POLLUTANTS = ["PM2.5", "PM10", "NO2", "SO2", "CO", "O3"]
OTHER_POLLUTANTS = ["NO", "NOx", "NH3", "Benzene", "Toluene", "Xylene"]

# FIXED VALUES: forest settings of the offline models.
FOREST_TREES = 100
FOREST_DEPTH = 20
FOREST_MIN_LEAF = 2
FOREST_MIN_SPLIT = 5
SPLIT_SEED = 42
TEST_FRACTION = 0.2

# FIXED VALUES: activity-log event kinds.
EVENT_KINDS = ["USER_ACTION", "API_CALL", "MODEL_RUN", "CALCULATION", "ERROR"]
LAST_N_PREDICTIONS = 5

# FIXED VALUES: reading text that means "no value".
MISSING_TEXT = ["", "NA", "N/A"]

# FIXED VALUES: "no filter" choice of the state/city selectors.
ALL = "All"

# FIXED VALUES: marker size for a reading without value; AQI of a table
# without any reading-value column.
MARKER_FILL = 10.0
AQI_WITHOUT_VALUES = 100.0

# FIXED VALUES: daily variables of a forecast document, and the
# current-conditions variables.
FORECAST_VARS = ["temperature_2m_max", "temperature_2m_min", "relative_humidity_2m_max", "wind_speed_10m_max", "precipitation_sum"]
CURRENT_VARS = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "surface_pressure"]
