"""Domain constants shared by the operators.

Fixed values: they must equal the published study settings for results to agree.
"""

BIOCLIM = ["bio1", "bio4", "bio5", "bio6", "bio7", "bio10", "bio11", "bio12", "bio15", "bio17"]
TERRAIN = ["elevation", "slope", "northness", "eastness"]
PREDICTORS = BIOCLIM + TERRAIN
ALGORITHMS = ["glm", "gam", "rf", "gbm", "maxent"]

# min_lon, min_lat, max_lon, max_lat
CALIBRATION_BBOX = (-76.0, -56.0, -66.0, -17.0)
PREDICTION_BBOX = (-82.0, -56.0, -34.0, 13.0)
PATCH_BBOX = (-71.65, -30.01, -69.98, -25.00)

MAX_UNCERTAINTY_M = 10_000
CENTROID_TOLERANCE_KM = 1.0
GRID_STEP_DEG = 2.5 / 60
MIN_RECORDS = 50
LOW_N_MIN_RECORDS = 25
COSMOPOLITAN = ["Schinus areira", "Atriplex semibaccata"]

N_BACKGROUND = 10_000
ACCESSIBLE_KM = 300.0
EOO_DECAY_KM = 50.0
# exp(-(d/50)^2) is zero in float32 beyond about 508 km
EOO_RADIUS_KM = 510.0

CORRELATION_LIMIT = 0.7
VIF_LIMIT = 10.0
N_FOLDS = 5
SEED = 42
TSS_MIN_ENSEMBLE = 0.5

PRUNE_BIO1_MIN = -5.0
PRUNE_ABS_LAT_MAX = 55.0

EARTH_KM = 6371.0088
WGS84_A_M = 6378137.0
WGS84_F = 1 / 298.257223563
METRES_PER_DEGREE = 111_320.0
RASTER_NODATA = -9999.0

GCMS = ["ACCESS-CM2", "IPSL-CM6A-LR", "MPI-ESM1-2-HR", "MRI-ESM2-0"]
SSPS = ["ssp245", "ssp585"]

SOUTH_AMERICA = [
    "Argentina",
    "Bolivia",
    "Bolivia (Plurinational State of)",
    "Brasil",
    "Brazil",
    "Chile",
    "Colombia",
    "Ecuador",
    "Falkland Islands (Malvinas)",
    "French Guiana",
    "Guyana",
    "Paraguay",
    "Peru",
    "Perú",
    "Suriname",
    "Uruguay",
    "Venezuela",
    "Venezuela (Bolivarian Republic of)",
]

ISO3 = {
    "Argentina": "ARG",
    "Bolivia (Plurinational State of)": "BOL",
    "Brazil": "BRA",
    "Chile": "CHL",
    "Colombia": "COL",
    "Ecuador": "ECU",
    "Paraguay": "PRY",
    "Peru": "PER",
}

# code, descriptive name, description, unit
PREDICTOR_DICTIONARY = [
    ("bio1", "temp_media_anual", "Temperatura media anual", "°C"),
    ("bio4", "estacionalidad_temp", "Estacionalidad de temperatura (desv. est. ×100)", "°C×100"),
    ("bio5", "temp_max_mes_calido", "Temperatura máxima del mes más cálido", "°C"),
    ("bio6", "temp_min_mes_frio", "Temperatura mínima del mes más frío", "°C"),
    ("bio7", "rango_anual_temp", "Rango anual de temperatura (bio5 − bio6)", "°C"),
    ("bio10", "temp_media_trim_calido", "Temperatura media del trimestre más cálido", "°C"),
    ("bio11", "temp_media_trim_frio", "Temperatura media del trimestre más frío", "°C"),
    ("bio12", "precip_anual", "Precipitación anual", "mm"),
    ("bio15", "estacionalidad_precip", "Estacionalidad de precipitación (coef. variación)", "%"),
    ("bio17", "precip_trim_seco", "Precipitación del trimestre más seco", "mm"),
    ("elevation", "elevacion", "Elevación sobre el nivel del mar", "m"),
    ("slope", "pendiente", "Pendiente del terreno", "grados"),
    ("northness", "exposicion_norte", "Orientación N–S de la ladera (1=N, −1=S)", "índice [-1,1]"),
    ("eastness", "exposicion_este", "Orientación E–O de la ladera (1=E, −1=O)", "índice [-1,1]"),
]
