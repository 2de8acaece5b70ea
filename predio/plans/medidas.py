"""Scalar functions and measures over the test tables: text, money, geometry, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.functions import espacio, texto
from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import table


def textos_normales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal form, slug and phone of customers."""
    nombre = F.concat(F.lit("  Ñuñoa Ávila, "), F.col("c_name"), F.lit(" . "))
    fono = F.concat(F.lit("+"), F.when(F.col("c_custkey") % 2 == 0, "9 ").otherwise("56 9 "), F.lpad(F.col("c_custkey").cast("string"), 8, "4"))
    return table(spark, sf_dir, "customer").select("c_custkey", texto.normal(nombre).alias("normal"), texto.slug(nombre).alias("slug"), texto.whatsapp(fono).alias("whatsapp"))


def montos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts written in four ways, read back."""
    k = F.col("p_partkey")
    mil = F.concat(F.lit("$ "), (k % 900 + 100).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"))
    escrito = F.when(k % 4 == 0, mil).when(k % 4 == 1, F.concat(mil, F.lit(",5"))).when(k % 4 == 2, F.concat((k % 50).cast("string"), F.lit(".25 UF"))).otherwise(F.lit("consultar"))
    return table(spark, sf_dir, "part").select("p_partkey", escrito.alias("escrito"), texto.monto(escrito).alias("monto"))


def contraste_colores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contrast with white of a colour for each lot."""
    color = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", color.alias("color"), F.round(texto.contraste(color, F.lit("#ffffff")), 6).alias("contraste"))


def _lotes_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadrilaterals in metres round a point, and another point."""
    e = lambda i: F.col("embedding")[i].cast("double")
    ancho, alto = 10 + 40 * F.abs(e(2)), 10 + 40 * F.abs(e(3))
    esquina = lambda sx, sy: F.struct((100 * e(0) + sx * ancho).alias("x"), (100 * e(1) + sy * alto + sx * 5).alias("y"))
    anillo = F.array(esquina(-1, -1), esquina(1, -1), esquina(1, 1), esquina(-1, 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", anillo.alias("anillo"), (100 * e(4)).alias("px"), (100 * e(5)).alias("py"))


def areas_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area, bounds and whether the point lies in the lot."""
    g = _lotes_geo(spark, sf_dir)
    lado = lambda f, c: f(F.transform("anillo", lambda p: p[c]))
    return g.select("vec_id", F.round(espacio.area(F.col("anillo")), 4).alias("area"), F.round(lado(F.array_min, "x"), 4).alias("oeste"), F.round(lado(F.array_max, "y"), 4).alias("norte"), espacio.contiene(F.col("anillo"), F.col("px"), F.col("py")).alias("dentro"))


def vistas_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction and distance of each lot's point from a view 80 m up."""
    v = espacio.rumbo_y_distancia(F.col("px"), F.col("py"), F.lit(-80.0)).alias("v")
    r = lambda c: F.round(F.col(f"v.{c}"), 4).alias(c)
    return _lotes_geo(spark, sf_dir).select("vec_id", v).select("vec_id", r("azimut"), r("elevacion"), r("distancia"))


def azimut_medio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean direction of the points of each label."""
    a = F.degrees(F.atan2("px", "py"))
    return _lotes_geo(spark, sf_dir).groupBy("label").agg(F.round(espacio.media_circular(a), 4).alias("azimut"), F.count("*").alias("n"))


def metricas_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of relative price differences by state, and lots within tolerance."""
    p = parcelas(spark, sf_dir).where("precio is not null").withColumn("error", 100 * (F.col("precio") / (900 + F.col("superficie") * 10) - 1))
    q = lambda x: F.round(F.percentile("error", F.lit(x)), 6)
    return p.groupBy("estado").agg(
        F.count("*").alias("n"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.round(F.min("error"), 6).alias("minimo"),
        F.count_if(F.abs("error") <= 2).alias("verdes"), F.count_if((F.abs("error") > 2) & (F.abs("error") <= 5)).alias("amarillos"), F.count_if(F.abs("error") > 5).alias("rojos"),
    )


def moda_superficies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's most frequent surface (tie: the one seen first)."""
    c = parcelas(spark, sf_dir).groupBy("proyecto_id", "superficie").agg(F.count("*").alias("n"), F.min("id").alias("primera"))
    return c.groupBy("proyecto_id").agg(F.max_by(F.struct("superficie", "n"), F.struct("n", -F.col("primera"))).alias("m")).select("proyecto_id", "m.superficie", "m.n")


def umbral_otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of the histogram of quantities (at most 256 bins, whatever the input)."""
    h = table(spark, sf_dir, "lineitem").groupBy(F.floor("l_quantity").cast("int").alias("v")).agg(F.count("*").alias("n"))
    antes, todo = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    h = h.select("v", F.sum("n").over(antes).alias("w0"), F.sum(F.col("n") * F.col("v")).over(antes).alias("s0"), F.sum("n").over(todo).alias("w"), F.sum(F.col("n") * F.col("v")).over(todo).alias("s"))
    entre = F.pow(F.col("s0") * F.col("w") - F.col("s") * F.col("w0"), F.lit(2)) / (F.col("w0") * 1.0 * (F.col("w") - F.col("w0")))
    return h.where("w0 < w").agg(F.max_by("v", F.struct(entre, -F.col("v"))).alias("umbral"))


QUERIES = {f.__name__: f for f in (textos_normales, montos, contraste_colores, areas_lotes, vistas_lotes, azimut_medio, metricas_areas, moda_superficies, umbral_otsu)}
_E = "CAST(embedding[{}] AS DOUBLE)"
_GEO = f"""(SELECT vec_id, label, 100 * {_E.format(1)} AS cx, 100 * {_E.format(2)} AS cy, 10 + 40 * abs({_E.format(3)}) AS w, 10 + 40 * abs({_E.format(4)}) AS h,
  100 * {_E.format(5)} AS px, 100 * {_E.format(6)} AS py FROM embeddings)"""
_CANAL = "(CASE WHEN {0} / 255.0 <= 0.03928 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END)"
ORACLES = {
    "textos_normales": """
  SELECT c_custkey, 'nunoa avila, ' || lower(c_name) || ' ' AS normal, 'nunoa-avila-' || regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g') AS slug,
         '569' || lpad(CAST(c_custkey AS VARCHAR), 8, '4') AS whatsapp FROM customer""",
    "montos": """
  SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN m WHEN 1 THEN m || ',5' WHEN 2 THEN CAST(p_partkey % 50 AS VARCHAR) || '.25 UF' ELSE 'consultar' END AS escrito,
         CAST(CASE p_partkey % 4 WHEN 0 THEN (p_partkey % 900 + 100) * 1000 + p_partkey % 1000 WHEN 1 THEN (p_partkey % 900 + 100) * 1000 + p_partkey % 1000 + 0.5
              WHEN 2 THEN p_partkey % 50 + 0.25 END AS DOUBLE) AS monto
  FROM (SELECT p_partkey, '$ ' || CAST(p_partkey % 900 + 100 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') AS m FROM part)""",
    "contraste_colores": f"""
  SELECT p_partkey, '#' || lpad(to_hex(n), 6, '0') AS color,
         round(1.05 / (0.2126 * {_CANAL.format("(n // 65536)")} + 0.7152 * {_CANAL.format("(n // 256 % 256)")} + 0.0722 * {_CANAL.format("(n % 256)")} + 0.05), 6) AS contraste
  FROM (SELECT p_partkey, p_partkey * 7919 % 16777216 AS n FROM part)""",
    "areas_lotes": f"""
  SELECT vec_id, round(4 * w * h, 4) AS area, round(cx - w, 4) AS oeste, round(cy + h + 5, 4) AS norte,
         px >= cx - w AND px < cx + w AND abs(py - (cy + 5 * (px - cx) / w)) <= h AS dentro FROM {_GEO}""",
    "vistas_lotes": f"""
  SELECT vec_id, round((degrees(atan2(px, py)) + 360) % 360, 4) AS azimut, round(degrees(atan2(-80.0, sqrt(px * px + py * py))), 4) AS elevacion,
         round(sqrt(px * px + py * py + 6400), 4) AS distancia FROM {_GEO}""",
    "azimut_medio": f"""
  SELECT label, round((degrees(atan2(sum(sin(a)), sum(cos(a)))) + 360) % 360, 4) AS azimut, count(*) AS n FROM (SELECT label, atan2(px, py) AS a FROM {_GEO}) GROUP BY label""",
    "metricas_areas": f"""
  SELECT estado, count(*) AS n, round(quantile_cont(error, 0.5), 6) AS p50, round(quantile_cont(error, 0.9), 6) AS p90, round(min(error), 6) AS minimo,
         count(*) FILTER (abs(error) <= 2) AS verdes, count(*) FILTER (abs(error) > 2 AND abs(error) <= 5) AS amarillos, count(*) FILTER (abs(error) > 5) AS rojos
  FROM (SELECT estado, 100 * (precio / (900 + superficie * 10) - 1) AS error FROM {PARCELAS_SQL} WHERE precio IS NOT NULL) GROUP BY estado""",
    "moda_superficies": f"""
  SELECT proyecto_id, superficie, n FROM (SELECT *, row_number() OVER (PARTITION BY proyecto_id ORDER BY n DESC, primera) AS k FROM (
    SELECT proyecto_id, superficie, count(*) AS n, min(id) AS primera FROM {PARCELAS_SQL} GROUP BY ALL)) WHERE k = 1""",
    "umbral_otsu": """
  WITH h AS (SELECT CAST(floor(l_quantity) AS INTEGER) AS v, count(*) AS n FROM lineitem GROUP BY 1),
  c AS (SELECT a.v, (SELECT sum(n) FROM h WHERE v <= a.v) AS w0, (SELECT sum(n * v) FROM h WHERE v <= a.v) AS s0, (SELECT sum(n) FROM h) AS w, (SELECT sum(n * v) FROM h) AS s FROM h a)
  SELECT v AS umbral FROM c WHERE w0 < w ORDER BY pow(CAST(s0 AS DOUBLE) * w - CAST(s AS DOUBLE) * w0, 2) / (CAST(w0 AS DOUBLE) * (w - w0)) DESC, v LIMIT 1""",
}
