"""Fixed values of the risk engine; they must agree with the published rules."""

# Checks, windows, cohorts.
V2_TOLERANCE_KWH = "0.500"
V4_CONTIGUITY_DAYS = 1
INFORMATIVE_CHECKS = ("V1",)
VALID_FRACTION = 0.95
NEAR_DUPLICATE_DAYS = 3
LONG_WINDOW, SHORT_WINDOW = 12, 6
MIN_PERIODS_DEVIATION, MIN_PERIODS_SLOPE = 3, 4
COHORT_MIN, COHORT_FALLBACK_MIN = 10, 3
IQR_FENCE = 1.5
SUMMARY_Z, SUMMARY_PERCENTILE = 3.0, 0.99

# Rules R1 to R6.
R1_STREAK = 3
R2_DROP = -0.60
R3_RISE = 2.00
R4_PERCENTILE, R4_RATIO = 0.05, 0.4
R5_PERCENTILE, R5_RATIO = 0.95, 2.5
R6_DEVIATION = 3.0
RULES = {
    "R1": ("Persistencia Anómala", "Alta"),
    "R2": ("Caída Brusca", "Alta"),
    "R3": ("Incremento Brusco", "Media"),
    "R4": ("Consumo Muy Bajo", "Media"),
    "R5": ("Consumo Muy Alto", "Media"),
    "R6": ("Desvío Estadístico", "Media"),
}
ML_ANOMALY = ("Patrón Irregular", "Crítica")
ACTIVE = "Activo"
IMPACT_UNIT = "kWh"

# The anomaly model.
MODEL_MIN_PER_CATEGORY = 1000
CONTAMINATION, TREES, TREE_SAMPLE, SEED = 0.03, 200, 256, 42

# Bands (inclusive upper bounds).
CLASSES = ((20, "Normal"), (40, "Atención"), (70, "Alto Riesgo"), (None, "Crítico"))
LEVELS = ((20, "Muy Bajo"), (40, "Bajo"), (60, "Medio"), (80, "Alto"), (None, "Crítico"))

# The risk index.
WEIGHTS = {
    "score_ia": 0.30,
    "historial_consumos": 0.15,
    "persistencia_anomalias": 0.15,
    "variacion_porcentual": 0.15,
    "impacto_economico": 0.10,
    "inspecciones_anteriores": 0.08,
    "consumo_promedio": 0.04,
    "categoria_tarifaria": 0.03,
}
ZERO_WEIGHT = ("inspecciones_anteriores",)
HISTORY_CAP, HISTORY_SCALE = 5.0, 20.0
PRIOR_POINTS, STREAK_POINTS, PERSISTENCE_CAP = 25.0, 10.0, 100.0
VARIATION_CAP, VARIATION_SCALE = 3.0, 100.0 / 3.0
CRITICALITY = {"Grandes Demandas": 100.0, "Industrial": 90.0, "Comercial": 60.0, "Residencial": 30.0, "Alumbrado Público": 20.0}
CRITICALITY_DEFAULT = 50.0
PAGE_DEFAULT, PAGE_MAX = 50, 200


def normalised(weights: dict[str, float], without: tuple[str, ...] = ()) -> dict[str, float]:
    """Shares of the factors that are in use; those left out have none."""
    used = [k for k in weights if k not in without]
    total = sum(map(weights.__getitem__, used))
    return dict.fromkeys(weights, 0.0) | {k: weights[k] / total for k in used}


EFFECTIVE_WEIGHTS = normalised(WEIGHTS, ZERO_WEIGHT)

# Names of the factors for readers.
FACTOR_LABELS = {
    "score_ia": "Score de IA (aproximación)",
    "historial_consumos": "Historial de consumos",
    "persistencia_anomalias": "Persistencia de anomalías",
    "variacion_porcentual": "Variación porcentual",
    "impacto_economico": "Impacto económico",
    "consumo_promedio": "Consumo promedio",
    "categoria_tarifaria": "Categoría tarifaria",
}
