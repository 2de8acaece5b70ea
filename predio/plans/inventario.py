"""Lots against the commercial sheet, prices, states, changes, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.plans.vistas import PARCELAS_SQL, parcelas

#: Most lots of a numbering gap that is reported, and of a group of consecutive numbers.
HUECO_MAX, GRUPO_MAX = 3, 12
CAMPOS = ("estado", "precio", "moneda", "superficie")


def _dibujo_y_planilla(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drawn lots and sheet rows: each lacks some lots of the other."""
    p = parcelas(spark, sf_dir)
    return p.where("id % 10 <> 0").select("id", "proyecto_id", "etapa"), p.where("id % 10 <> 1").select("id", "estado", "precio", "moneda", "superficie", F.col("etapa").alias("etapa_planilla"))


def lotes_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lot of either side; one without a sheet row is not available."""
    dibujo, planilla = _dibujo_y_planilla(spark, sf_dir)
    return dibujo.join(planilla, "id", "full_outer").select(
        "id", F.coalesce("etapa", "etapa_planilla").alias("etapa"), F.coalesce("estado", F.lit("no_disponible")).alias("estado"),
        "precio", F.col("superficie").isNotNull().alias("en_planilla"), F.col("proyecto_id").isNotNull().alias("en_dibujo"),
    )


def cobertura_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots on one side only."""
    dibujo, planilla = _dibujo_y_planilla(spark, sf_dir)
    solo = lambda a, b, falta: a.join(b, "id", "left_anti").select("id", F.lit(falta).alias("falta_en"))
    return solo(dibujo, planilla, "planilla").unionByName(solo(planilla, dibujo, "dibujo"))


def conteo_por_estado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots by project and state, with how many have a price."""
    return parcelas(spark, sf_dir).groupBy("proyecto_id", "estado").agg(F.count("*").alias("n"), F.count("precio").alias("con_precio"))


def precio_desde(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: the currency of most available priced lots (tie: the one seen first), and its least price."""
    por_moneda = parcelas(spark, sf_dir).where("estado = 'disponible' and precio is not null").groupBy("proyecto_id", "moneda")
    por_moneda = por_moneda.agg(F.count("*").alias("n"), F.min("precio").alias("precio"), F.min("id").alias("primera"))
    mejor = F.max_by(F.struct("moneda", "precio", "n"), F.struct("n", -F.col("primera"))).alias("m")
    return por_moneda.groupBy("proyecto_id").agg(mejor).select("proyecto_id", "m.moneda", "m.precio", "m.n")


def cambios_inventario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of which a commercial field differs from the published one, nulls being equal."""
    antes = parcelas(spark, sf_dir)
    ahora = antes.select(
        "id", F.when(F.col("id") % 17 == 0, "vendido").otherwise(F.col("estado")).alias("estado"), F.when(F.col("id") % 13 != 0, F.col("precio")).alias("precio"),
        "moneda", "superficie",
    )
    a, b = antes.alias("a"), ahora.alias("b")
    distinto = [~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in CAMPOS]
    cuales = F.array_compact(F.array(*[F.when(d, c) for d, c in zip(distinto, CAMPOS)]))
    return a.join(b, F.col("a.id") == F.col("b.id")).select(F.col("a.id").alias("id"), F.array_join(cuales, ",").alias("campos")).where("campos <> ''")


def _numeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lot numbers present in each sector."""
    return parcelas(spark, sf_dir).where("superficie % 6 <> 0").select(F.col("proyecto_id").alias("sector"), F.floor(F.col("id") / 25).cast("long").alias("numero"))


def _dos_cifras(numero: Column) -> Column:
    """At least two digits; longer numbers stay whole (lpad would cut them)."""
    n = numero.cast("string")
    return F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)


def huecos_numeracion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that lack between two present ones of a sector, if at most HUECO_MAX lack."""
    sigue = F.lead("numero").over(Window.partitionBy("sector").orderBy("numero"))
    g = _numeros(spark, sf_dir).withColumn("sigue", sigue).where(F.col("sigue") - F.col("numero") - 1 <= HUECO_MAX).where("sigue > numero + 1")
    faltan = g.select("sector", F.explode(F.sequence(F.col("numero") + 1, F.col("sigue") - 1)).alias("numero"))
    return faltan.select("sector", "numero", F.concat_ws("-", F.col("sector"), _dos_cifras(F.col("numero"))).alias("rotulo"))


def grupos_numeracion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of consecutive numbers, cut after GRUPO_MAX lots: first, last and count."""
    w = Window.partitionBy("sector").orderBy("numero")
    corte = F.coalesce((F.col("numero") - F.lag("numero").over(w) > 1).cast("int"), F.lit(0))
    t = _numeros(spark, sf_dir).withColumn("corte", corte).withColumn("tramo", F.sum("corte").over(w))
    dentro = F.row_number().over(Window.partitionBy("sector", "tramo").orderBy("numero")) - 1
    t = t.withColumn("parte", F.floor(dentro / GRUPO_MAX))
    return t.groupBy("sector", "tramo", "parte").agg(F.min("numero").alias("desde"), F.max("numero").alias("hasta"), F.count("*").alias("n")).drop("tramo", "parte")


def buscar_lotes(spark: SparkSession, sf_dir: str, consulta: str = "Lote a12") -> DataFrame:
    """The viewer's search: 3 name or number equal, 2 name contains it, 1 number starts with it; ties by number, the best eight."""
    limpia = consulta.strip().upper()
    for palabra in ("LOTES", "LOTE"):
        if limpia.startswith(palabra):
            limpia = limpia.removeprefix(palabra)
            break
    limpia = "".join(limpia.split())
    digitos = "".join(c for c in limpia if c.isdigit())
    nombre = F.concat(F.element_at(F.array(F.lit("A"), F.lit("B")), (F.col("id") % 2 + 1).cast("int")), F.col("id").cast("string"))
    numero = F.col("id").cast("string")
    por_numero = F.when((nombre == limpia) | ((numero == digitos) & F.lit(digitos != "")), 3)
    puntos = por_numero.when(F.contains(nombre, F.lit(limpia)), 2).when(numero.startswith(digitos) & F.lit(digitos != ""), 1).otherwise(0)
    p = parcelas(spark, sf_dir).select("id", nombre.alias("lote"), puntos.alias("puntos"))
    return p.where("puntos > 0").orderBy(F.desc("puntos"), "id").limit(8)


def filtrar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The viewer's filter with all its conditions set."""
    return parcelas(spark, sf_dir).where(F.col("estado").isin("disponible", "reservado") & F.coalesce("superficie", F.lit(0)).between(10, 40) & (F.col("etapa").cast("string") == "1")).select("id", "estado", "superficie")


def duplicados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots whose normalised name occurs more than once in their project."""
    clave = F.trim(F.regexp_replace(F.lower("nombre"), "[^a-z0-9]+", " "))
    clave = F.substring_index(clave, " ", 1)
    w = Window.partitionBy("proyecto_id", "clave")
    return parcelas(spark, sf_dir).withColumn("clave", clave).withColumn("veces", F.count("*").over(w)).where("veces > 1").select("id", "proyecto_id", "clave", "veces")


_DIBUJO = f"(SELECT id, proyecto_id, etapa FROM {PARCELAS_SQL} WHERE id % 10 <> 0)"
_PLANILLA = f"(SELECT * FROM {PARCELAS_SQL} WHERE id % 10 <> 1)"
_NUMEROS = f"(SELECT proyecto_id AS sector, id // 25 AS numero FROM {PARCELAS_SQL} WHERE superficie % 6 <> 0)"

QUERIES = {f.__name__: f for f in (lotes_full_outer, cobertura_anti, conteo_por_estado, precio_desde, cambios_inventario, huecos_numeracion, grupos_numeracion, buscar_lotes, filtrar, duplicados)}
ORACLES = {
    "lotes_full_outer": f"""
  SELECT coalesce(d.id, p.id) AS id, coalesce(d.etapa, p.etapa) AS etapa, coalesce(estado, 'no_disponible') AS estado, precio,
         superficie IS NOT NULL AS en_planilla, d.id IS NOT NULL AS en_dibujo
  FROM {_DIBUJO} d FULL OUTER JOIN {_PLANILLA} p ON d.id = p.id""",
    "cobertura_anti": f"""
  SELECT id, 'planilla' AS falta_en FROM {_DIBUJO} WHERE id NOT IN (SELECT id FROM {_PLANILLA})
  UNION ALL SELECT id, 'dibujo' FROM {_PLANILLA} WHERE id NOT IN (SELECT id FROM {_DIBUJO})""",
    "conteo_por_estado": f"SELECT proyecto_id, estado, count(*) AS n, count(precio) AS con_precio FROM {PARCELAS_SQL} GROUP BY ALL",
    "precio_desde": f"""
  SELECT proyecto_id, moneda, precio, n FROM (
    SELECT *, row_number() OVER (PARTITION BY proyecto_id ORDER BY n DESC, primera) AS lugar FROM (
      SELECT proyecto_id, moneda, count(*) AS n, min(precio) AS precio, min(id) AS primera
      FROM {PARCELAS_SQL} WHERE estado = 'disponible' AND precio IS NOT NULL GROUP BY ALL)) WHERE lugar = 1""",
    "cambios_inventario": f"""
  SELECT id, concat_ws(',', CASE WHEN cambia_estado THEN 'estado' END, CASE WHEN cambia_precio THEN 'precio' END) AS campos
  FROM (SELECT id, id % 17 = 0 AND estado <> 'vendido' AS cambia_estado, id % 13 = 0 AND precio IS NOT NULL AS cambia_precio FROM {PARCELAS_SQL})
  WHERE cambia_estado OR cambia_precio""",
    "huecos_numeracion": f"""
  SELECT sector, numero, sector || '-' || lpad(CAST(numero AS VARCHAR), 2, '0') AS rotulo FROM (
    SELECT sector, unnest(range(numero + 1, sigue)) AS numero FROM (
      SELECT *, lead(numero) OVER (PARTITION BY sector ORDER BY numero) AS sigue FROM {_NUMEROS}) WHERE sigue - numero - 1 BETWEEN 1 AND 3)""",
    "grupos_numeracion": f"""
  SELECT sector, min(numero) AS desde, max(numero) AS hasta, count(*) AS n FROM (
    SELECT *, (row_number() OVER (PARTITION BY sector, isla ORDER BY numero) - 1) // 12 AS parte FROM (
      SELECT *, numero - row_number() OVER (PARTITION BY sector ORDER BY numero) AS isla FROM {_NUMEROS})) GROUP BY sector, isla, parte""",
    "buscar_lotes": f"""
  SELECT id, lote, CAST(CASE WHEN lote = 'A12' OR CAST(id AS VARCHAR) = '12' THEN 3 WHEN lote LIKE '%A12%' THEN 2 ELSE 1 END AS INTEGER) AS puntos
  FROM (SELECT id, CASE id % 2 WHEN 0 THEN 'A' ELSE 'B' END || id AS lote FROM {PARCELAS_SQL})
  WHERE lote LIKE '%A12%' OR CAST(id AS VARCHAR) LIKE '12%' ORDER BY puntos DESC, id LIMIT 8""",
    "filtrar": f"SELECT id, estado, superficie FROM {PARCELAS_SQL} WHERE estado <> 'vendido' AND superficie BETWEEN 10 AND 40 AND etapa = 1",
    "duplicados": f"""
  SELECT id, proyecto_id, clave, veces FROM (SELECT *, count(*) OVER (PARTITION BY proyecto_id, clave) AS veces FROM (
    SELECT *, split_part(trim(regexp_replace(lower(nombre), '[^a-z0-9]+', ' ', 'g')), ' ', 1) AS clave FROM {PARCELAS_SQL})) WHERE veces > 1""",
}
