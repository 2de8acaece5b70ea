"""Views, gestures, review, sessions and resumable work: aggregates and windows that start from partial counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.plans.estadisticas import ZONA, dia_local
from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import table

#: Largest label, share of hidden labels above which a group closes and below which it opens,
#: fewest lots for a scale, milliseconds of a gesture that count and its least length.
ROTULO_MAX, COLAPSAR, ABRIR, ESCALA_LOTES, VENTANA_MS, GESTO_MIN_MS = 5.0, 0.4, 0.2, 3, 90, 16
VELOCIDAD_MAX = 0.5


def _vistas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views: id, posicion, altura, solo_foto, puntaje."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 40).alias("posicion"), (F.col("p_size") * 10).cast("long").alias("altura"),
        (F.col("p_partkey") % 3 == 0).alias("solo_foto"), F.col("p_retailprice").alias("puntaje"),
    )


def alturas_de_puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of each position as a text: one, or lowest to highest."""
    h = _vistas(spark, sf_dir).groupBy("posicion").agg(F.min("altura").alias("baja"), F.max("altura").alias("alta"), F.count("*").alias("vistas"))
    texto = F.when(F.col("baja") == F.col("alta"), F.format_string("%d m", "baja")).otherwise(F.format_string("%d–%d m", "baja", "alta"))
    return h.select("posicion", "vistas", texto.alias("alturas"))


def vista_cercana(spark: SparkSession, sf_dir: str, altura: int = 255) -> DataFrame:
    """Of each position the view whose height is nearest to the one asked for; the first on a tie."""
    cerca = F.min_by("id", F.struct(F.abs(F.col("altura") - altura), F.col("id")))
    return _vistas(spark, sf_dir).groupBy("posicion").agg(cerca.alias("id"))


def vista_inicial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each ten positions the view of most merit with a drawing, or of all if none has one; the first on a tie."""
    mejor = F.max_by("id", F.struct((~F.col("solo_foto")).cast("int"), F.col("puntaje"), -F.col("id")))
    return _vistas(spark, sf_dir).groupBy((F.col("posicion") % 4).alias("loteo")).agg(mejor.alias("id"))


def tamano_comun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common label size of each project: the value at a quarter of the sorted ones (none between two), at most ROTULO_MAX. From counts of values."""
    n = parcelas(spark, sf_dir).groupBy("proyecto_id", (F.col("superficie") / 10).alias("cabe")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("proyecto_id")
    n = n.withColumn("hasta", F.sum("n").over(w.orderBy("cabe"))).withColumn("cuarto", F.floor(F.sum("n").over(w) / 4))
    return n.where("hasta > cuarto").groupBy("proyecto_id").agg(F.least(F.min("cabe"), F.lit(ROTULO_MAX)).alias("tamano"))


def resumen_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of each project by the first case that holds: left out, undecided rest, without number, or a lot with its level."""
    k = F.col("id")
    caso = F.when(k % 23 == 0, "fuera").when(k % 29 == 0, "resto").when(k % 7 == 0, "sin_numero").otherwise("lote")
    nivel = F.element_at(F.array(*map(F.lit, ("verde", "ambar", "rojo", "gris"))), (F.col("superficie") % 4 + 1).cast("int"))
    p = parcelas(spark, sf_dir).select("proyecto_id", caso.alias("caso"), nivel.alias("nivel"), (k % 11 == 0).alias("duplicado"), (k % 2 == 0).alias("de_lote"))
    lote = F.col("caso") == "lote"
    niveles = [F.count_if(lote & (F.col("nivel") == c)).alias(c) for c in ("verde", "ambar", "rojo", "gris")]
    return p.groupBy("proyecto_id").agg(
        F.count_if(lote).alias("lotes"), *niveles, F.count_if(F.col("caso") == "sin_numero").alias("sin_numero"),
        F.count_if((F.col("caso") == "sin_numero") & F.col("de_lote")).alias("sin_numero_lote"), F.count_if(lote & F.col("duplicado")).alias("duplicados"),
        F.count_if(F.col("caso") == "fuera").alias("fuera"), F.bool_or(F.col("caso") == "resto").alias("resto_pendiente"),
    )


def burbujas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's group shows as a bubble after every change: it closes above COLAPSAR and opens below ABRIR, else it stays."""
    fraccion, total = F.pmod("event_id", F.lit(10)) / 10, F.pmod("event_id", F.lit(13))
    decide = F.when(total < 2, False).when(fraccion > COLAPSAR, True).when(fraccion < ABRIR, False)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    estado = F.coalesce(F.last("decide", ignorenulls=True).over(w), F.lit(False))
    return table(spark, sf_dir, "events").withColumn("decide", decide).select("event_id", estado.alias("burbuja"))


def gestos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speed of each user's drag as it is let go: the moves of its last VENTANA_MS (here hours stand for
    milliseconds), with the sample before them as the start if it belongs to the same gesture, within VELOCIDAD_MAX."""
    t, w = F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0, Window.partitionBy("user_id")
    m = table(spark, sf_dir, "events").select("user_id", "event_id", t.alias("t"), (F.pmod("event_id", F.lit(7)) - 3).alias("mueve"))
    m = m.withColumn("ahora", F.max("t").over(w)).withColumn("previa", F.lag("t").over(w.orderBy("t", "event_id")))
    m = m.where(F.col("ahora") - F.col("t") <= VENTANA_MS)
    primera = F.col("previa").isNull() | (F.col("ahora") - F.col("previa") > VENTANA_MS)
    junta = F.coalesce(F.col("t") - F.col("previa") <= VENTANA_MS, F.lit(False))
    desde = F.min(F.when(primera, F.when(junta, F.col("previa")).otherwise(F.col("t"))))
    suma = F.coalesce(F.sum(F.when(~primera | junta, F.col("mueve"))), F.lit(0))
    v = suma / F.greatest(F.max("ahora") - desde, F.lit(float(GESTO_MIN_MS)))
    return m.groupBy("user_id").agg(F.round(F.least(F.greatest(v, F.lit(-VELOCIDAD_MAX)), F.lit(VELOCIDAD_MAX)), 6).alias("velocidad"))


def actividad_por_dia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines of each user by local day, newest line first in its group: count, newest, oldest."""
    g = table(spark, sf_dir, "events").groupBy("user_id", dia_local(F.col("ts")).alias("dia"))
    return g.agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("nueva"), F.min(F.struct("ts", "event_id"))["event_id"].alias("vieja"))


def escala_del_cuadro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metres to a pixel of each project: median root of official area over drawn area; null for fewer than ESCALA_LOTES."""
    p = parcelas(spark, sf_dir).where("id % 9 <> 0 and superficie > 0").select("proyecto_id", F.sqrt(F.col("superficie") / (F.col("id") % 17 + 1)).alias("e"))
    g = p.groupBy("proyecto_id").agg(F.count("*").alias("n"), F.percentile("e", F.lit(0.5)).alias("m"))
    return g.select("proyecto_id", "n", F.when(F.col("n") >= ESCALA_LOTES, F.round("m", 6)).alias("escala"))


def color_dominante(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each outline the colour with most metres of line; the first by name on a tie."""
    largo = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_returnflag").alias("color")).agg(F.sum("l_quantity").alias("metros"))
    return largo.groupBy("l_orderkey").agg(F.min_by("color", F.struct(-F.col("metros"), "color")).alias("color"), F.max("metros").alias("metros"))


def cifras_de_sesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a browser sends: a visit once per session (user and day), an opened lot once per session and lot, clicks always."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    cual = F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", F.coalesce(F.get_json_object("props", "$.k"), F.lit(""))).otherwise(F.col("event_id").cast("string"))
    g = e.groupBy("user_id", F.to_date("ts").alias("dia"), "event_type", cual.alias("cual"))
    return g.agg(F.min("event_id").alias("event_id")).select("event_id", "event_type")


def uso_unico(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-use tokens (here a user's of a month): the first use counts, later ones change nothing."""
    g = table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id", F.date_trunc("month", "ts").alias("ficha"))
    return g.agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"), (F.count("*") - 1).alias("rechazados"))


def pasadas_pendientes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes that must run (again): those with no reading, and those of which any reading is not valid."""
    vale = (F.col("l_quantity") > 0) & (F.col("l_discount") < 0.1)
    hechas = table(spark, sf_dir, "lineitem").where("l_orderkey % 6 <> 0").groupBy("l_orderkey").agg(F.bool_and(F.coalesce(vale, F.lit(False))).alias("vale"))
    buenas = hechas.where("vale").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(buenas, "o_orderkey", "left_anti")


def pasos_vencidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps whose inputs are not those they were made from: the stored digest differs from the present one."""
    huella = lambda p: F.sha2(F.concat_ws("|", "s_name", "s_nationkey", p), 256)
    k = F.col("s_suppkey")
    ahora, antes = huella(k.cast("string")), huella(F.when(k % 4 == 0, k + 1).otherwise(k).cast("string"))
    return table(spark, sf_dir, "supplier").where(ahora != antes).select("s_suppkey", ahora.alias("huella"))


def totales_de_cuentas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tenant: projects, those online and those that wait; it asks for more than it has if any waits."""
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey")
    en_linea, espera = F.col("c_acctbal") > 5000, F.col("c_acctbal") < 0
    return g.agg(F.count("*").alias("proyectos"), F.count_if(en_linea).alias("en_linea"), F.count_if(espera).alias("pendientes"), F.bool_or(espera).alias("pide"))


def rumbos_y_cruces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearing of a segment modulo 180, and where its line meets another's (null below 8 degrees between them)."""
    e: list[Column] = [F.col("embedding")[i].cast("double") for i in range(8)]
    ax, ay, bx, by = e[2] - e[0], e[3] - e[1], e[6] - e[4], e[7] - e[5]
    cruz, largo = ax * by - ay * bx, F.hypot(ax, ay) * F.hypot(bx, by)
    t = F.try_divide((e[4] - e[0]) * by - (e[5] - e[1]) * bx, cruz)
    firme = F.degrees(F.asin(F.least(F.abs(F.try_divide(cruz, largo)), F.lit(1.0)))) >= 8
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.round(F.pmod(F.degrees(F.atan2(ax, ay)), F.lit(180.0)), 4).alias("rumbo"), *[F.round(F.when(firme, p + t * d), 4).alias(n) for n, p, d in (("x", e[0], ax), ("y", e[1], ay))]
    )


def ajuste_afin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Affine least squares u = a x + b y + c of each label's points, from sums alone; null where they lie on a line."""
    e = lambda i: F.col("embedding")[i].cast("double")
    p = table(spark, sf_dir, "embeddings").select("label", e(0).alias("x"), e(1).alias("y"), (2 * e(0) - 0.5 * e(1) + 3 + 0.1 * e(2)).alias("u"))
    cov = [F.covar_pop(a, b).alias(a + b) for a, b in ("xx", "yy", "xy", "xu", "yu")]
    s = p.groupBy("label").agg(*cov, *[F.avg(c).alias(f"m{c}") for c in "xyu"])
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    det = F.when(det > 1e-12, det)
    s = s.withColumn("a", (F.col("xu") * F.col("yy") - F.col("yu") * F.col("xy")) / det).withColumn("b", (F.col("yu") * F.col("xx") - F.col("xu") * F.col("xy")) / det)
    return s.select("label", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("mu") - F.col("a") * F.col("mx") - F.col("b") * F.col("my"), 6).alias("c"))


_VISTAS = "(SELECT p_partkey AS id, p_partkey % 40 AS posicion, CAST(p_size * 10 AS BIGINT) AS altura, p_partkey % 3 = 0 AS solo_foto, p_retailprice AS puntaje FROM part)"
_E = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 9)]
QUERIES = {
    f.__name__: f
    for f in (
        alturas_de_puntos, vista_cercana, vista_inicial, tamano_comun, resumen_revision, burbujas, gestos, actividad_por_dia, escala_del_cuadro,
        color_dominante, cifras_de_sesion, uso_unico, pasadas_pendientes, pasos_vencidos, totales_de_cuentas, rumbos_y_cruces, ajuste_afin,
    )
}
ORACLES = {
    "alturas_de_puntos": f"""
  SELECT posicion, count(*) AS vistas, CASE WHEN min(altura) = max(altura) THEN min(altura) || ' m' ELSE min(altura) || '–' || max(altura) || ' m' END AS alturas
  FROM {_VISTAS} GROUP BY posicion""",
    "vista_cercana": f"SELECT posicion, id FROM {_VISTAS} QUALIFY row_number() OVER (PARTITION BY posicion ORDER BY abs(altura - 255), id) = 1",
    "vista_inicial": f"""
  SELECT posicion % 4 AS loteo, id FROM {_VISTAS} QUALIFY row_number() OVER (PARTITION BY posicion % 4 ORDER BY solo_foto, puntaje DESC, id) = 1""",
    "tamano_comun": f"SELECT proyecto_id, least(list_sort(list(superficie / 10))[count(*) // 4 + 1], 5.0) AS tamano FROM {PARCELAS_SQL} GROUP BY proyecto_id",
    "resumen_revision": f"""
  SELECT proyecto_id, count(*) FILTER (lote) AS lotes, count(*) FILTER (lote AND nivel = 0) AS verde, count(*) FILTER (lote AND nivel = 1) AS ambar,
         count(*) FILTER (lote AND nivel = 2) AS rojo, count(*) FILTER (lote AND nivel = 3) AS gris, count(*) FILTER (sin) AS sin_numero,
         count(*) FILTER (sin AND id % 2 = 0) AS sin_numero_lote, count(*) FILTER (lote AND id % 11 = 0) AS duplicados,
         count(*) FILTER (fuera) AS fuera, bool_or(resto) AS resto_pendiente
  FROM (SELECT *, NOT (fuera OR resto OR sin) AS lote FROM (SELECT *, NOT fuera AND NOT resto AND id % 7 = 0 AS sin FROM (
    SELECT proyecto_id, id, superficie % 4 AS nivel, id % 23 = 0 AS fuera, id % 23 <> 0 AND id % 29 = 0 AS resto FROM {PARCELAS_SQL}))) GROUP BY proyecto_id""",
    "burbujas": """
  SELECT event_id, coalesce(last_value(decide IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS burbuja FROM (
    SELECT *, CASE WHEN event_id % 13 < 2 THEN false WHEN event_id % 10 > 4 THEN true WHEN event_id % 10 < 2 THEN false END AS decide FROM events)""",
    "gestos": """
  SELECT user_id, round(least(greatest(coalesce(sum(mueve) FILTER (NOT primera OR junta), 0)
    / greatest(max(ahora) - min(CASE WHEN primera THEN CASE WHEN junta THEN previa ELSE t END END), 16), -0.5), 0.5), 6) AS velocidad
  FROM (SELECT *, previa IS NULL OR ahora - previa > 90 AS primera, coalesce(t - previa <= 90, false) AS junta FROM (
    SELECT user_id, t, event_id % 7 - 3 AS mueve, max(t) OVER (PARTITION BY user_id) AS ahora, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS previa
    FROM (SELECT *, floor(epoch(ts)) / 3600.0::DOUBLE AS t FROM events)) WHERE ahora - t <= 90) GROUP BY user_id""",
    "actividad_por_dia": f"""
  SELECT user_id, CAST(timezone('{ZONA}', timezone('UTC', ts)) AS DATE) AS dia, count(*) AS n, arg_max(event_id, (ts, event_id)) AS nueva, arg_min(event_id, (ts, event_id)) AS vieja
  FROM events GROUP BY ALL""",
    "escala_del_cuadro": f"""
  SELECT proyecto_id, count(*) AS n, CASE WHEN count(*) >= 3 THEN round(median(sqrt(superficie / (id % 17 + 1))), 6) END AS escala
  FROM {PARCELAS_SQL} WHERE id % 9 <> 0 AND superficie > 0 GROUP BY proyecto_id""",
    "color_dominante": """
  SELECT l_orderkey, color, metros FROM (SELECT l_orderkey, l_returnflag AS color, sum(l_quantity) AS metros FROM lineitem GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY metros DESC, color) = 1""",
    "cifras_de_sesion": """
  SELECT min(event_id) AS event_id, event_type FROM events WHERE event_type IN ('view', 'click', 'purchase')
  GROUP BY user_id, CAST(ts AS DATE), event_type, CASE event_type WHEN 'view' THEN '' WHEN 'click' THEN coalesce(json_extract_string(props, '$.k'), '') ELSE CAST(event_id AS VARCHAR) END""",
    "uso_unico": """
  SELECT user_id, date_trunc('month', ts) AS ficha, arg_min(event_id, (ts, event_id)) AS event_id, count(*) - 1 AS rechazados
  FROM events WHERE event_type = 'purchase' GROUP BY ALL""",
    "pasadas_pendientes": """
  SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE NOT coalesce(l_quantity > 0 AND l_discount < 0.1, false))""",
    "pasos_vencidos": "SELECT s_suppkey, sha256(s_name || '|' || s_nationkey || '|' || s_suppkey) AS huella FROM supplier WHERE s_suppkey % 4 = 0",
    "totales_de_cuentas": """
  SELECT c_nationkey, count(*) AS proyectos, count(*) FILTER (c_acctbal > 5000) AS en_linea, count(*) FILTER (c_acctbal < 0) AS pendientes, bool_or(c_acctbal < 0) AS pide
  FROM customer GROUP BY c_nationkey""",
    "rumbos_y_cruces": f"""
  SELECT vec_id, round(((degrees(atan2(ax, ay)) % 180) + 180) % 180, 4) AS rumbo, CASE WHEN firme THEN round(x0 + t * ax, 4) END AS x, CASE WHEN firme THEN round(y0 + t * ay, 4) END AS y
  FROM (SELECT *, ((x1 - x0) * dy - (y1 - y0) * dx) / cruz AS t, degrees(asin(least(abs(cruz / (sqrt(ax * ax + ay * ay) * sqrt(dx * dx + dy * dy))), 1.0))) >= 8 AS firme
    FROM (SELECT *, ax * dy - ay * dx AS cruz FROM (SELECT vec_id, {_E[0]} AS x0, {_E[1]} AS y0, {_E[4]} AS x1, {_E[5]} AS y1,
      {_E[2]} - {_E[0]} AS ax, {_E[3]} - {_E[1]} AS ay, {_E[6]} - {_E[4]} AS dx, {_E[7]} - {_E[5]} AS dy FROM embeddings)))""",
    "ajuste_afin": f"""
  SELECT label, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx - b * my, 6) AS c FROM (
    SELECT *, (xu * yy - yu * xy) / det AS a, (yu * xx - xu * xy) / det AS b FROM (SELECT *, CASE WHEN xx * yy - xy * xy > 1e-12 THEN xx * yy - xy * xy END AS det FROM (
      SELECT label, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, avg(x) AS mx, avg(y) AS my, avg(u) AS mu
      FROM (SELECT *, 2 * x - 0.5 * y + 3 + 0.1 * z AS u FROM (SELECT label, {_E[0]} AS x, {_E[1]} AS y, {_E[2]} AS z FROM embeddings)) GROUP BY label)))""",
}
