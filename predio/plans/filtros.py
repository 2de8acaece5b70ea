"""Conditions that may be left out, and what people write in forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions import validar
from predio.plans.vistas import BITACORA_SQL, PARCELAS_SQL, bitacora, parcelas
from predio.session import table

#: Plans that a form can name.
PLANES = ("fly", "pro", "master", "enterprise", "no-se")


def filtrar(lotes: DataFrame, estados: tuple[str, ...] = (), minima: float | None = None, maxima: float | None = None, con_vista: bool = False, etapa: str | int | None = None) -> DataFrame:
    """Lots that meet every condition that is set: states (none: all), surface (a missing one is 0 for the least and without
    bound for the largest), shown in some view (`mejor_vista` not empty), stage as text."""
    if estados:
        lotes = lotes.where(F.col("estado").isin(*estados))
    if minima is not None:
        lotes = lotes.where(F.coalesce("superficie", F.lit(0)) >= minima)
    if maxima is not None:
        lotes = lotes.where(F.coalesce(F.col("superficie").cast("double"), F.lit(float("inf"))) <= maxima)
    if con_vista:
        lotes = lotes.where(F.coalesce(F.col("mejor_vista"), F.lit("")) != "")
    if etapa is not None:
        lotes = lotes.where(F.col("etapa").cast("string") == str(etapa))
    return lotes


def filtrar_interesados(filas: DataFrame, loteo: int | str | None = None, estado: str | None = None) -> DataFrame:
    """Leads of a project and of a state, where they are set, newest first."""
    if loteo is not None:
        filas = filas.where(F.col("proyecto_id") == loteo)
    if estado is not None:
        filas = filas.where(F.col("estado") == estado)
    return filas.orderBy(F.desc("creado_en"), F.desc("id"))


def _con_vista(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parcelas(spark, sf_dir).withColumn("superficie", F.when(F.col("id") % 8 != 0, F.col("superficie"))).withColumn("mejor_vista", F.when(F.col("id") % 3 == 0, F.concat(F.lit("p"), F.col("id") % 5)))


def filtros_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lots six sets of conditions leave, and the sum of their ids."""
    casos = ({}, {"estados": ("disponible", "reservado")}, {"minima": 10}, {"maxima": 30}, {"con_vista": True, "etapa": "1"}, {"estados": ("vendido",), "minima": 5, "maxima": 45, "con_vista": True, "etapa": 2})
    lotes = _con_vista(spark, sf_dir)
    partes = [filtrar(lotes, **c).agg(F.count("*").alias("n"), F.coalesce(F.sum("id"), F.lit(0)).alias("suma")).select(F.lit(i).alias("caso"), "n", "suma") for i, c in enumerate(casos)]
    todas = partes[0]
    for p in partes[1:]:
        todas = todas.unionByName(p)
    return todas


def interesados_del_loteo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One project's leads of one state, newest first."""
    b = bitacora(spark, sf_dir).select("id", (F.col("usuario") % 25).alias("proyecto_id"), F.col("que").alias("estado"), F.col("cuando").alias("creado_en"))
    return filtrar_interesados(b, 3, "signup").select("id", "creado_en")


def _crudos() -> dict[str, Column]:
    """What customers write: from names and numbers of the table, in ways that are right and wrong."""
    k = F.col("c_custkey")
    de = lambda *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    t = k.cast("string")
    return {
        "nombre": de(F.concat(F.lit("  "), F.col("c_name"), F.lit("\n\t")), F.col("c_name"), F.col("c_name"), " x ", None), "email": de(F.concat(F.lit("c"), t, F.lit("@correo.cl")), F.concat(F.lit("c"), t, F.lit("@correo")), "", F.concat(F.lit("c"), t, F.lit("@a.b.com"))),
        "telefono": de(F.concat(F.lit("9 "), F.lpad(t, 8, "1")), F.concat(F.lit("+56 2 "), F.lpad(t, 7, "2")), "12", ""), "plan": de("pro", "otro", None), "parcelas": de("1.200", "", "0", "doce", "7"), "mensaje": F.concat(F.lit(" Hola\r\n\r\n\r\n\r\nchao\a "), t, F.lit("\n")),
    }


def formularios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three forms, cleaned, with the field for which they are refused."""
    c = _crudos()
    r = validar.comprador(c["nombre"], c["telefono"], c["email"])
    i = validar.comprador(c["nombre"], c["telefono"], c["email"], correo_obligatorio=False)
    o = validar.contacto(c["nombre"], c["email"], c["telefono"], c["plan"], c["parcelas"], c["mensaje"], PLANES)
    d = table(spark, sf_dir, "customer").select("c_custkey", r.alias("r"), i.alias("i"), o.alias("o"))
    return d.select("c_custkey", "r.nombre", "r.telefono", F.col("r.motivo").alias("reserva"), F.col("i.motivo").alias("interes"), F.col("o.motivo").alias("contacto"), "o.plan", "o.parcelas", "o.mensaje")


QUERIES = {f.__name__: f for f in (filtros_de_lotes, interesados_del_loteo, formularios)}
_L = f"(SELECT id, estado, CAST(etapa AS VARCHAR) AS etapa, CASE WHEN id % 8 <> 0 THEN superficie END AS s, id % 3 = 0 AS vista FROM {PARCELAS_SQL})"
_CASOS = ("true", "estado <> 'vendido'", "coalesce(s, 0) >= 10", "s <= 30", "vista AND etapa = '1'", "estado = 'vendido' AND s BETWEEN 5 AND 45 AND vista AND etapa = '2'")
ORACLES = {
    "filtros_de_lotes": " UNION ALL ".join(f"SELECT {i} AS caso, count(*) AS n, coalesce(CAST(sum(id) AS BIGINT), 0) AS suma FROM {_L} WHERE {c}" for i, c in enumerate(_CASOS)),
    "interesados_del_loteo": f"SELECT id, cuando AS creado_en FROM {BITACORA_SQL} WHERE usuario % 25 = 3 AND que = 'signup'",
    "formularios": """
  WITH c AS (
    SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 3 THEN 'x' WHEN 4 THEN '' ELSE c_name END AS nombre, CASE c_custkey % 4 WHEN 0 THEN '569' || right(lpad(CAST(c_custkey AS VARCHAR), 8, '1'), 8) WHEN 1 THEN '562' || lpad(CAST(c_custkey AS VARCHAR), 7, '2') WHEN 2 THEN '12' ELSE '' END AS telefono FROM customer)
  SELECT k AS c_custkey, nombre, telefono, CASE WHEN k % 5 > 2 THEN 'nombre' WHEN k % 4 > 1 THEN 'telefono' WHEN k % 4 IN (1, 2) THEN 'email' END AS reserva,
         CASE WHEN k % 5 > 2 THEN 'nombre' WHEN k % 4 > 1 THEN 'telefono' WHEN k % 4 = 1 THEN 'email' END AS interes,
         CASE WHEN k % 5 > 2 THEN 'nombre' WHEN k % 4 IN (1, 2) THEN 'email' WHEN k % 4 = 2 THEN 'telefono' WHEN k % 5 IN (2, 3) THEN 'parcelas' END AS contacto,
         CASE k % 3 WHEN 0 THEN 'pro' ELSE 'no-se' END AS plan, CASE k % 5 WHEN 0 THEN 1200 WHEN 4 THEN 7 END AS parcelas, 'Hola' || chr(10) || chr(10) || 'chao ' || k AS mensaje FROM c""",
}
