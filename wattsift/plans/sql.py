"""DuckDB text of the shared views, for comparison with the Spark plans."""

from wattsift.sources.tables import SQL as BASE

FEATURES = """
feat0 AS (
  SELECT *, count(*) OVER w12 AS n12, avg(kwh) OVER w12 AS avg_consumption, max(kwh) OVER w12 AS max_consumption, min(kwh) OVER w12 AS min_consumption,
         stddev_samp(kwh) OVER w12 AS sd12, regr_slope(kwh, year(inicio) * 12 + month(inicio)) OVER w12 AS slope12,
         lag(kwh) OVER w AS last_kwh, avg(kwh) OVER w6 AS moving_avg_6m,
         arg_min(kwh, inicio) OVER (wm RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS yoy,
         count(*) OVER (wm RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_earlier,
         avg(kwh) OVER (wm RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS avg_earlier,
         count(*) OVER wp AS np, avg(kwh) OVER wp AS avgp, stddev_samp(kwh) OVER wp AS sdp,
         sum(CASE WHEN kwh <> 0 THEN 1 ELSE 0 END) OVER wp AS island
  FROM (SELECT *, month(inicio) AS mes, year(inicio) AS anio FROM cons)
  WINDOW w AS (PARTITION BY suministro ORDER BY inicio), w12 AS (PARTITION BY suministro ORDER BY inicio ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
         w6 AS (PARTITION BY suministro ORDER BY inicio ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), wp AS (PARTITION BY suministro ORDER BY inicio ROWS UNBOUNDED PRECEDING),
         wm AS (PARTITION BY suministro, mes ORDER BY anio)),
feat AS (
  SELECT suministro, inicio, fin, dias, kwh, lote, avg_consumption, max_consumption, min_consumption,
         CASE WHEN n12 >= 3 THEN sd12 END AS stddev_consumption, (kwh - last_kwh) / nullif(last_kwh, 0) AS pct_change_prev_period,
         (kwh - yoy) / nullif(yoy, 0) AS pct_change_yoy, moving_avg_6m, avg_consumption AS moving_avg_12m,
         CASE WHEN n12 >= 3 THEN (kwh - avg_consumption) / nullif(sd12, 0) END AS deviation_from_baseline,
         CAST(sum(CASE WHEN kwh = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY suministro, island ORDER BY inicio ROWS UNBOUNDED PRECEDING) AS BIGINT) AS zero_consumption_streak,
         CASE WHEN n12 >= 4 THEN coalesce(slope12, 0.0) END AS trend_slope,
         CASE WHEN n_earlier = 0 THEN 1.0 ELSE kwh / nullif(avg_earlier, 0) END AS seasonality_index,
         CASE WHEN np >= 3 THEN (kwh - avgp) / nullif(sdp, 0) END AS zscore_self, np < 3 AS is_cold_start
  FROM feat0)"""

STATIC = """
stat AS (
  SELECT feat.*, sumin.* EXCLUDE (suministro), CASE WHEN fecha_alta <= inicio THEN date_diff('day', fecha_alta, inicio) END AS supply_age_days, dias AS billed_days
  FROM feat JOIN sumin USING (suministro))"""

#: The quartiles without the row itself come from the cohort's sorted list with that row's place cut out.
COHORT = """
coh0 AS (
  SELECT *, count(*) OVER f AS f_n, count(*) OVER c AS c_n, quantile_cont(kwh, 0.5) OVER f AS f_med, quantile_cont(kwh, 0.5) OVER c AS c_med,
         cume_dist() OVER (PARTITION BY lote, categoria, localidad ORDER BY kwh) AS f_cd, cume_dist() OVER (PARTITION BY lote, categoria ORDER BY kwh) AS c_cd,
         row_number() OVER (PARTITION BY lote, categoria, localidad ORDER BY kwh, suministro) AS f_r, row_number() OVER (PARTITION BY lote, categoria ORDER BY kwh, suministro) AS c_r
  FROM stat WINDOW f AS (PARTITION BY lote, categoria, localidad), c AS (PARTITION BY lote, categoria)),
lf AS (SELECT lote, categoria, localidad, list(kwh ORDER BY kwh) AS fl FROM stat GROUP BY ALL),
lc AS (SELECT lote, categoria, list(kwh ORDER BY kwh) AS cl FROM stat GROUP BY ALL),
coh1 AS (
  SELECT coh0.*, CASE WHEN f_n >= 10 THEN list_concat(fl[1:f_r - 1], fl[f_r + 1:]) WHEN c_n >= 3 THEN list_concat(cl[1:c_r - 1], cl[c_r + 1:]) END AS rest
  FROM coh0 JOIN lf USING (lote, categoria, localidad) JOIN lc USING (lote, categoria)),
coh2 AS (
  SELECT *, 0.25 * (len(rest) - 1) AS i1, 0.75 * (len(rest) - 1) AS i3 FROM coh1),
coh3 AS (
  SELECT *, rest[CAST(floor(i1) AS BIGINT) + 1] + (rest[CAST(ceil(i1) AS BIGINT) + 1] - rest[CAST(floor(i1) AS BIGINT) + 1]) * (i1 - floor(i1)) AS q1,
            rest[CAST(floor(i3) AS BIGINT) + 1] + (rest[CAST(ceil(i3) AS BIGINT) + 1] - rest[CAST(floor(i3) AS BIGINT) + 1]) * (i3 - floor(i3)) AS q3
  FROM coh2),
vec AS (
  SELECT * EXCLUDE (f_n, c_n, f_med, c_med, f_cd, c_cd, f_r, c_r, rest, i1, i3, q1, q3),
         kwh / nullif(CASE WHEN f_n >= 10 THEN f_med ELSE c_med END, 0) AS peer_ratio,
         CASE WHEN f_n >= 10 THEN f_cd WHEN c_n >= 3 THEN c_cd END AS percentile_peer,
         CASE WHEN rest IS NOT NULL THEN kwh < q1 - 1.5 * (q3 - q1) OR kwh > q3 + 1.5 * (q3 - q1) END AS iqr_outlier_flag,
         CASE WHEN f_n >= 10 THEN f_n ELSE c_n END AS cohort_size
  FROM coh3)"""

RULES = """
ruled AS (
  SELECT *, coalesce(zero_consumption_streak >= 3 AND estado = 'Activo', false) AS r1, coalesce(pct_change_prev_period <= -0.60, false) AS r2,
         coalesce(pct_change_prev_period >= 2.00, false) AS r3, coalesce(percentile_peer <= 0.05 AND peer_ratio <= 0.4, false) AS r4,
         coalesce(percentile_peer >= 0.95 AND peer_ratio >= 2.5, false) AS r5, coalesce(abs(deviation_from_baseline) >= 3, false) AS r6
  FROM vec),
counted AS (SELECT *, CAST(r1 AS INTEGER) + CAST(r2 AS INTEGER) + CAST(r3 AS INTEGER) + CAST(r4 AS INTEGER) + CAST(r5 AS INTEGER) + CAST(r6 AS INTEGER) AS n_reglas FROM ruled),
prior AS (
  SELECT *, coalesce(sum(n_reglas) OVER (PARTITION BY suministro ORDER BY inicio ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior_anomaly_count FROM counted)"""

SCORES = """
impact AS (SELECT *, CASE WHEN NOT is_cold_start THEN greatest(0.0, moving_avg_12m - kwh) END AS iee FROM prior),
ends AS (
  SELECT lote, min(iee) FILTER (iee > 0) AS i0, max(iee) FILTER (iee > 0) AS i1, min(avg_consumption) AS a0, max(avg_consumption) AS a1 FROM impact GROUP BY lote),
norms AS (
  SELECT impact.*, CASE WHEN coalesce(iee, 0) <= 0 THEN 0.0 WHEN i0 = i1 THEN 100.0 ELSE (iee - i0) / (i1 - i0) * 100 END AS iee_norm,
         CASE WHEN a0 = a1 THEN 50.0 ELSE (avg_consumption - a0) / (a1 - a0) * 100 END AS avg_norm
  FROM impact JOIN ends USING (lote)),
facs AS (
  SELECT *, CASE WHEN deviation_from_baseline IS NOT NULL THEN least(abs(deviation_from_baseline), 5.0) * 20.0 END AS v_hist, least(prior_anomaly_count * 25.0 + zero_consumption_streak * 10.0, 100.0) AS v_pers,
         CASE WHEN pct_change_prev_period IS NOT NULL OR pct_change_yoy IS NOT NULL
              THEN least(greatest(coalesce(abs(pct_change_prev_period), 0), coalesce(abs(pct_change_yoy), 0)), 3.0) * (CAST(100 AS DOUBLE) / 3) END AS v_var,
         CASE categoria WHEN 'Grandes Demandas' THEN 100.0 WHEN 'Industrial' THEN 90.0 WHEN 'Comercial' THEN 60.0 WHEN 'Residencial' THEN 30.0 WHEN 'Alumbrado Público' THEN 20.0 ELSE 50.0 END AS v_cat
  FROM norms),
raw AS (
  SELECT *, CAST((coalesce(v_hist, 0) * 15 + v_pers * 15 + coalesce(v_var, 0) * 15 + iee_norm * 10 + avg_norm * 4 + v_cat * 3) / 92 AS DOUBLE) AS ire_crudo FROM facs),
res0 AS (SELECT *, CAST(least(greatest(floor(ire_crudo + 0.5), 0), 100) AS INTEGER) AS ire, CAST(n_reglas AS INTEGER) AS n_anomalias FROM raw),
res AS (
  SELECT *, CASE WHEN ire <= 20 THEN 'Muy Bajo' WHEN ire <= 40 THEN 'Bajo' WHEN ire <= 60 THEN 'Medio' WHEN ire <= 80 THEN 'Alto' ELSE 'Crítico' END AS nivel,
         CASE WHEN ire <= 20 THEN 'Normal' WHEN ire <= 40 THEN 'Atención' WHEN ire <= 70 THEN 'Alto Riesgo' ELSE 'Crítico' END AS clasificacion
  FROM res0)"""

CHECKS = """
chain AS (
  SELECT c.*, s.categoria, lag(c.inicio) OVER w AS prev_inicio, lag(c.fin) OVER w AS prev_fin FROM cons c JOIN sumin s USING (suministro)
  WINDOW w AS (PARTITION BY c.suministro ORDER BY c.inicio, c.fin)),
chk AS (
  SELECT chain.*, lectura_anterior, lectura_actual, lectura_dias FROM chain LEFT JOIN lect USING (suministro, inicio)),
found AS (
  SELECT suministro, lote, inicio, chequeo FROM (SELECT suministro, lote, inicio, unnest([
    CASE WHEN lectura_dias IS NULL THEN 'V1' END, CASE WHEN abs(kwh - (lectura_actual - lectura_anterior)) > 0.5 THEN 'V2' END, CASE WHEN lectura_dias <> dias THEN 'V3' END,
    CASE WHEN inicio > prev_fin + 1 THEN 'V4' END, CASE WHEN inicio <= prev_fin THEN 'V5' END, CASE WHEN categoria = 'Grandes Demandas' THEN 'V6' END,
    CASE WHEN kwh < 0 THEN 'V7' END, CASE WHEN dias <= 0 THEN 'V7' END]) AS chequeo
  FROM chk) WHERE chequeo IS NOT NULL)"""

CONFLICTS = """
conf AS (SELECT DISTINCT a.suministro, a.inicio, a.lote FROM cons a JOIN cons b ON a.suministro = b.suministro AND a.inicio <= b.fin AND b.inicio <= a.fin AND (a.inicio <> b.inicio OR a.lote <> b.lote))"""

#: The history without conflicted periods, the streak of all of it, and no excluded supplies.
CLEAN = [
    """
kept AS (SELECT cons.* FROM cons ANTI JOIN conf USING (suministro, inicio, lote))""",
    FEATURES.replace("feat0", "full0").replace("feat AS", "full1 AS"),
    FEATURES.replace("FROM cons)", "FROM kept)"),
    """
stat AS (
  SELECT feat.* EXCLUDE (zero_consumption_streak), full1.zero_consumption_streak, sumin.* EXCLUDE (suministro), feat.dias AS billed_days, feat.suministro IN (SELECT suministro FROM conf) AS has_conflicted_periods
  FROM feat JOIN full1 USING (suministro, inicio) JOIN sumin USING (suministro) ANTI JOIN (SELECT * FROM found WHERE chequeo <> 'V1') gone ON gone.suministro = feat.suministro AND gone.lote = feat.lote
  QUALIFY row_number() OVER (PARTITION BY feat.suministro, feat.lote ORDER BY feat.inicio DESC) = 1)""",
]

FACTORS = """
factors AS (
  SELECT * FROM (
    SELECT suministro, lote, 'historial_consumos' AS factor, v_hist * 15 / 92 AS v FROM facs UNION ALL SELECT suministro, lote, 'persistencia_anomalias', v_pers * 15 / 92 FROM facs
    UNION ALL SELECT suministro, lote, 'variacion_porcentual', v_var * 15 / 92 FROM facs UNION ALL SELECT suministro, lote, 'impacto_economico', iee_norm * 10 / 92 FROM facs
    UNION ALL SELECT suministro, lote, 'consumo_promedio', avg_norm * 4 / 92 FROM facs UNION ALL SELECT suministro, lote, 'categoria_tarifaria', CAST(v_cat AS DOUBLE) * 3 / 92 FROM facs) WHERE v > 0)"""

FEATURE_PLAN = [BASE["dense"], FEATURES]
STATIC_PLAN = [BASE["sumin"], *FEATURE_PLAN, STATIC]
VECTOR_PLAN = [*STATIC_PLAN, COHORT]
SPARSE_VECTORS = [BASE["sumin"], BASE["sparse"], FEATURES, STATIC, COHORT, RULES]
SCORE_PLAN = [*SPARSE_VECTORS, SCORES]
CHECK_PLAN = [BASE["sumin"], BASE["faulty"], BASE["lect"], CHECKS]
CLEAN_PLAN = [*CHECK_PLAN, CONFLICTS, *CLEAN, COHORT]


def query(plan: list[str], select: str) -> str:
    return ("WITH " + ",".join(plan) + "\n" if plan else "") + select


def _sections() -> str:
    """The report's sections as (lote, seccion, clave, valor)."""
    counts = {
        "completitud": ("gate", {"declarados": "declarados", "activos": "activos", "completo": "CAST(declarados > 0 AND declarados = activos AS INTEGER)"}),
        "validacion": ("val", {"suministros": "suministros", "excluidos": "excluidos", "fraccion_valida": "1 - excluidos / suministros", "cumple": "CAST((suministros - excluidos) * 100 >= suministros * 95 AS INTEGER)"}),
        "duplicidades": ("(SELECT lote, count(*) AS periodos, count(DISTINCT suministro) AS suministros FROM conf GROUP BY lote)", {"periodos": "periodos", "suministros": "suministros"}),
    }
    per_batch = {
        "features": {"vectores": "count(*)", "cold_starts": "count(*) FILTER (is_cold_start)", "conflictivos": "count(*) FILTER (has_conflicted_periods)", "z_altos": "count(*) FILTER (abs(zscore_self) >= 3)", "outliers_iqr": "count(*) FILTER (iqr_outlier_flag)", "percentiles_altos": "count(*) FILTER (percentile_peer >= 0.99)"},
        "reglas": {f"r{i}": f"count(*) FILTER (r{i})" for i in range(1, 7)} | {"con_hits": "count(*) FILTER (n_reglas > 0)"},
        "ml": {"evaluados": "count(*)", "minimo": "0", "p50": "0", "p95": "0", "maximo": "0"},
        "ire": {"total": "count(*)", "nivel_0": "count(*) FILTER (ire <= 20)", "nivel_1": "count(*) FILTER (ire > 20 AND ire <= 40)", "nivel_2": "count(*) FILTER (ire > 40 AND ire <= 60)", "nivel_3": "count(*) FILTER (ire > 60 AND ire <= 80)", "nivel_4": "count(*) FILTER (ire > 80)", "con_anomalias": "count(*) FILTER (n_anomalias > 0)", "minimo": "min(ire)", "p50": "quantile_cont(ire, 0.5)", "p95": "quantile_cont(ire, 0.95)", "maximo": "max(ire)"},
        "iee": {"total_kwh": "coalesce(sum(iee), 0.0)", "con_iee": "count(*) FILTER (iee > 0)"},
    }
    rows = [f"SELECT lote, '{s}' AS seccion, '{k}' AS clave, CAST({e} AS DOUBLE) AS valor FROM {t}" for s, (t, keys) in counts.items() for k, e in keys.items()]
    rows += [f"SELECT lote, '{s}', '{k}', CAST({e} AS DOUBLE) FROM res GROUP BY lote" for s, keys in per_batch.items() for k, e in keys.items()]
    types = [*(f"count(*) FILTER (r{i})" for i in range(1, 7)), "0"]
    rows += [f"SELECT lote, 'ire', 'tipo_{i}', CAST({e} AS DOUBLE) FROM res WHERE n_reglas > 0 GROUP BY lote" for i, e in enumerate(types)]
    rows.append("SELECT lote, 'duplicidades', 'diferencia', CAST(activos - declarados AS DOUBLE) FROM gate WHERE declarados <> 0 AND activos <> declarados")
    return " UNION ALL ".join(rows)


_GATE = """
gate AS (SELECT lote, count(*) + CASE WHEN length(lote) = 11 THEN 3 ELSE 0 END AS declarados, count(*) AS activos FROM cons GROUP BY lote),
val AS (
  SELECT chk.lote, count(DISTINCT chk.suministro) AS suministros, count(DISTINCT found.suministro) AS excluidos
  FROM chk LEFT JOIN found ON found.lote = chk.lote AND found.suministro = chk.suministro AND chequeo <> 'V1' GROUP BY chk.lote)"""

REPORT = query([*CLEAN_PLAN, RULES, SCORES, _GATE], f"SELECT lote, seccion, clave, round(valor, 4) + 0.0 AS valor FROM ({_sections()})")

#: Stored predictions of a model, a formula over supply and month; its own anomalies count like the rules'.
_WITH_ML = """
predicted AS (SELECT *, CAST((suministro * 37 + year(inicio) * 12 + month(inicio)) * 13 % 1000 AS DOUBLE) / 10 AS ml_score FROM vec)"""
RULES_ML = _WITH_ML + "," + RULES.replace("FROM vec)", "FROM predicted)").replace("FROM counted)", "FROM all_counted)").replace("sum(n_reglas)", "sum(n_todas)").replace(
    "prior AS (", "all_counted AS (SELECT *, n_reglas + CASE WHEN ml_score > 70 AND n_reglas = 0 THEN 1 ELSE 0 END AS n_todas FROM counted),\nprior AS ("
)
SCORES_ML = SCORES.replace("CAST((coalesce(v_hist", "CAST((ml_score * 30 + coalesce(v_hist").replace("CAST(n_reglas AS INTEGER) AS n_anomalias", "CAST(n_todas AS INTEGER) AS n_anomalias")
FACTORS_ML = FACTORS.replace("SELECT suministro, lote, 'historial_consumos' AS factor", "SELECT suministro, lote, 'score_ia' AS factor, ml_score * 30 / 92 AS v FROM facs UNION ALL SELECT suministro, lote, 'historial_consumos'")
MODEL_PLAN = [*CLEAN_PLAN, RULES_ML, SCORES_ML]
#: The fixed names of the report, as its maps and lists hold them.
_TYPES = ("Persistencia Anómala", "Caída Brusca", "Incremento Brusco", "Consumo Muy Bajo", "Consumo Muy Alto", "Desvío Estadístico")
_LEVELS = ("Muy Bajo", "Bajo", "Medio", "Alto", "Crítico")


def _documents() -> str:
    """Every value of the documents as (lote, seccion, campo, valor)."""
    number = lambda e: f"CAST(CAST(round(CAST({e} AS DOUBLE), 6) AS DECIMAL(38, 6)) AS VARCHAR)"
    out = []

    def single(section: str, source: str, **fields: str) -> None:
        out.extend(f"SELECT lote, '{section}' AS seccion, '{name.replace('__', '.')}' AS campo, {number(e)} AS valor FROM {source}" for name, e in fields.items())

    def entries(section: str, prefix: str, source: str, numbers: dict[str, str], texts: dict[str, str]) -> None:
        fields = {k: number(e) for k, e in numbers.items()} | texts
        out.extend(f"SELECT lote, '{section}', '{prefix}.' || k || '.{name}', {e} FROM {source}" for name, e in fields.items())

    single("informe", "val", total_suministros="suministros", suministros_excluidos="excluidos", fraccion_valida="1 - excluidos / suministros", umbral_cumplido="CAST((suministros - excluidos) * 100 >= suministros * 95 AS INTEGER)")
    single("informe", "(SELECT val.lote, count(found.lote) AS n FROM val LEFT JOIN found ON found.lote = val.lote GROUP BY val.lote)", hallazgos="n")
    single("duplicidades", "(SELECT val.lote, count(conf.lote) AS n, count(DISTINCT conf.suministro) AS s FROM val LEFT JOIN conf ON conf.lote = val.lote GROUP BY val.lote)", periodos_conflictivos="n", suministros_conflictivos="s", lecturas_near_duplicate="0")
    drift = "(SELECT p.lote, p.otro, g.declarados, g.activos, row_number() OVER (PARTITION BY p.lote ORDER BY p.otro) AS k FROM (SELECT DISTINCT a.lote, b.lote AS otro FROM cons a JOIN cons b USING (suministro) WHERE a.lote <> b.lote) p JOIN gate g ON g.lote = p.otro WHERE g.declarados <> 0 AND g.declarados <> g.activos)"
    entries("duplicidades", "drift_lotes", drift, {"cantidad_registros": "declarados", "consumos_activos": "activos", "diferencia": "activos - declarados"}, {"lote": "otro"})
    sums = {
        "features": {"suministros_con_vector": "count(r.lote)", "cold_starts": "count(*) FILTER (is_cold_start)", "con_periodos_conflictivos": "count(*) FILTER (has_conflicted_periods)", "indicadores.zscore_extremos": "count(*) FILTER (abs(zscore_self) >= 3)", "indicadores.iqr_outliers": "count(*) FILTER (iqr_outlier_flag)", "indicadores.percentile_extremos": "count(*) FILTER (percentile_peer >= 0.99)"},
        "reglas": {"suministros_evaluados": "count(r.lote)", "suministros_con_hits": "count(*) FILTER (n_reglas > 0)"} | {f"hits_por_regla.R{i}": f"count(*) FILTER (r{i})" for i in range(1, 7)},
        "ml": {"suministros_scored": "count(r.lote)"},
        "ire": {"suministros_evaluados": "count(r.lote)"} | {f"conteo_por_nivel.{n}": f"count(*) FILTER (nivel = '{n}')" for n in _LEVELS} | {f"anomalias_por_tipo.{n}": f"count(*) FILTER (r{i + 1})" for i, n in enumerate(_TYPES)} | {"anomalias_por_tipo.Patrón Irregular": "count(*) FILTER (ml_score > 70 AND n_reglas = 0)"},
        "iee": {"total_kwh_estimado": "coalesce(sum(iee), 0.0)", "suministros_con_iee": "count(*) FILTER (iee > 0)"},
    }
    out.extend(f"SELECT v.lote, '{s}', '{k}', {number(e)} FROM val v LEFT JOIN res r ON r.lote = v.lote GROUP BY v.lote" for s, fields in sums.items() for k, e in fields.items())
    for section, column in (("ml", "ml_score"), ("ire", "ire")):
        out.extend(f"SELECT lote, '{section}', 'distribucion.{k}', {number(e)} FROM res GROUP BY lote" for k, e in (("minimo", f"min({column})"), ("p50", f"quantile_cont({column}, 0.5)"), ("p95", f"quantile_cont({column}, 0.95)"), ("maximo", f"max({column})")))
    fits = "(SELECT lote, 1 AS k, 'global' AS scope, 'isolation-forest-global' AS modelo, 'v1-' || substr(lote, 1, 16) || '-' || substr(sha256(lote), 1, 8) AS version, count(*) AS n FROM res GROUP BY lote)"
    entries("ml", "modelos", fits, {"suministros_entrenados": "n"}, {"scope": "scope", "modelo": "modelo", "version": "version"})
    best = lambda column, n, where="true": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lote ORDER BY {column} DESC, numero, suministro) AS k FROM res WHERE {where}) WHERE k <= {n})"
    critical = "CASE WHEN ml_score <= 20 THEN 'Normal' WHEN ml_score <= 40 THEN 'Atención' WHEN ml_score <= 70 THEN 'Alto Riesgo' ELSE 'Crítico' END"
    entries("ml", "top_10", best("ml_score", 10), {"suministro": "suministro", "ml_score": "ml_score"}, {"numero": "numero", "clasificacion": critical})
    entries("ire", "top_10", best("ire", 10), {"suministro": "suministro", "ire": "ire"}, {"numero": "numero", "nivel": "nivel", "clasificacion": "clasificacion"})
    factors = f"(SELECT b.lote, b.k || '.top_factores.' || row_number() OVER (PARTITION BY b.lote, b.k ORDER BY round(v, 6) DESC, factor DESC) AS k, row_number() OVER (PARTITION BY b.lote, b.k ORDER BY round(v, 6) DESC, factor DESC) AS j, factor, v FROM {best('ire', 10)} b JOIN factors f ON f.suministro = b.suministro AND f.lote = b.lote QUALIFY j <= 3)"
    entries("ire", "top_10", factors, {"contribution": "round(v, 6)"}, {"factor": "factor"})
    entries("iee", "top_5", best("iee", 5, "iee > 0"), {"suministro": "suministro", "iee_kwh": "iee"}, {"numero": "numero"})
    return " UNION ALL ".join(out)


DOCUMENTS = query([*MODEL_PLAN, FACTORS_ML, _GATE], f"SELECT lote, seccion, campo, valor FROM ({_documents()})")
