"""Nearest in time: as-of matches without windows over whole keys.

Both tables are cut into blocks of time within each key. Inside a block a window finds the right-hand row
before and after each left-hand one; what a block doesn't show comes from the blocks' own first and last
rows (one row for each key and block). So a key's rows are dealt by time, however many there are, and no row
meets more than two others. Of right-hand rows at one instant the one with the smallest id counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.plans.actividad import ESPERA_US, dedup_24h
from predio.plans.actividad import ORACLES as ACTIVIDAD
from predio.plans.vistas import BITACORA_SQL, bitacora
from predio.session import table

DIA = 24 * 3600 * 1_000_000


def vecinos(izquierda: DataFrame, derecha: DataFrame, claves: list[str], bloque: int) -> DataFrame:
    """izquierda (claves, us, ...) with antes and despues: structs (us, id) of the last row of derecha (claves, us, id)
    at or before its time and the first one at or after it, null if there is none. A null in a key or time has none."""
    en = F.floor(F.col("us") / bloque).alias("bloque")
    der = derecha.where(" and ".join(f"{c} is not null" for c in (*claves, "us"))).groupBy(*claves, "us").agg(F.min("id").alias("id"))
    vivas = F.lit(True)
    for c in (*claves, "us"):
        vivas = vivas & F.col(c).isNotNull()
    resto = [c for c in izquierda.columns if c not in (*claves, "us")]
    i = izquierda.where(vivas).select(*claves, "us", en, F.struct(*resto).alias("fila"), F.lit(None).cast(f"struct<us:bigint,id:{der.schema['id'].dataType.simpleString()}>").alias("d"), F.lit(1).alias("lado"))
    d = der.select(*claves, "us", en, F.lit(None).cast(i.schema["fila"].dataType).alias("fila"), F.struct("us", "id").alias("d"), F.lit(0).alias("lado"))
    juntas = i.unionByName(d)
    dentro = Window.partitionBy(*claves, "bloque")
    adelante = dentro.orderBy("us", "lado").rowsBetween(Window.unboundedPreceding, 0)
    atras = dentro.orderBy(F.col("us").desc(), "lado").rowsBetween(Window.unboundedPreceding, 0)
    con = juntas.withColumn("a", F.last("d", ignorenulls=True).over(adelante)).withColumn("z", F.last("d", ignorenulls=True).over(atras)).where("lado = 1")
    # the blocks before and after: one row for each
    b = juntas.groupBy(*claves, "bloque").agg(F.min("d").alias("primera"), F.max("d").alias("ultima"))
    w = Window.partitionBy(*claves).orderBy("bloque")
    b = b.select(*claves, "bloque", F.last("ultima", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("previa"), F.first("primera", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("sigue"))
    hecho = con.join(b, [*claves, "bloque"]).select(*claves, "us", "fila.*", F.coalesce("a", "previa").alias("antes"), F.coalesce("z", "sigue").alias("despues"))
    sin = izquierda.where(~vivas).select(*claves, "us", *resto, F.lit(None).cast(hecho.schema["antes"].dataType).alias("antes"), F.lit(None).cast(hecho.schema["antes"].dataType).alias("despues"))
    return hecho.unionByName(sin)


def anterior(izquierda: DataFrame, derecha: DataFrame, claves: list[str], dentro_de: int, bloque: int | None = None) -> DataFrame:
    """izquierda with `previo`, the id of the last row of derecha at or before it by less than `dentro_de` microseconds."""
    v = vecinos(izquierda, derecha, claves, bloque or dentro_de)
    return v.select(*izquierda.columns, F.when(F.col("us") - F.col("antes.us") < dentro_de, F.col("antes.id")).alias("previo"))


def mas_cercano(izquierda: DataFrame, derecha: DataFrame, claves: list[str], bloque: int) -> DataFrame:
    """izquierda with `cercano` and `lejos`: id of the row of derecha nearest in time, and by how much; of two as
    near the one before."""
    v = vecinos(izquierda, derecha, claves, bloque)
    atras, adelante = F.col("us") - F.col("antes.us"), F.col("despues.us") - F.col("us")
    antes = F.coalesce(atras <= adelante, adelante.isNull())
    return v.select(*izquierda.columns, F.when(antes, F.col("antes.id")).otherwise(F.col("despues.id")).alias("cercano"), F.when(antes, atras).otherwise(adelante).alias("lejos"))


def interesados_repetidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that repeat one of less than 24 h before (same user, same type), and which."""
    b = bitacora(spark, sf_dir).select("id", "usuario", "que", F.unix_micros(F.col("cuando").cast("timestamp")).alias("us"))
    quedan = b.join(dedup_24h(spark, sf_dir), "id", "left_semi")
    r = anterior(b.join(quedan.select("id"), "id", "left_anti"), quedan, ["usuario", "que"], ESPERA_US, DIA)
    return r.select("id", F.col("previo").alias("repite_a"))


def escena_mas_cercana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each flight (a returned line's date and square) the scene (an urgent order of that square) nearest in days."""
    us = lambda c: F.unix_micros(F.date_trunc("day", c).cast("timestamp"))
    vuelos = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select((F.col("l_suppkey") % 25).cast("int").alias("cuadro"), us("l_shipdate").alias("us"), "l_orderkey", "l_linenumber", "l_partkey")
    escenas = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select((F.col("o_custkey") % 25).cast("int").alias("cuadro"), us("o_orderdate").alias("us"), F.col("o_orderkey").alias("id"))
    r = mas_cercano(vuelos, escenas, ["cuadro"], 90 * DIA)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", F.col("cercano").alias("escena"), (F.col("lejos") / DIA).cast("int").alias("dias"))


QUERIES = {f.__name__: f for f in (interesados_repetidos, escena_mas_cercana)}
ORACLES = {
    "interesados_repetidos": f"""
  WITH quedan AS (SELECT b.* FROM {BITACORA_SQL} b JOIN ({ACTIVIDAD["dedup_24h"]}) k USING (id))
  SELECT b.id, q.id AS repite_a FROM {BITACORA_SQL} b LEFT JOIN LATERAL (
    SELECT id FROM quedan q WHERE q.usuario = b.usuario AND q.que = b.que AND q.cuando <= b.cuando AND q.cuando > b.cuando - INTERVAL 24 HOUR ORDER BY q.cuando DESC, id LIMIT 1) q ON true
  WHERE b.id NOT IN (SELECT id FROM quedan)""",
    "escena_mas_cercana": """
  SELECT l_orderkey, l_linenumber, l_partkey, m.o AS escena, CAST(m.dias AS INTEGER) AS dias FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, min({'dias': abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))), 'despues': o_orderdate > l_shipdate, 'o': o_orderkey}) AS m
    FROM lineitem JOIN orders ON o_custkey % 25 = l_suppkey % 25 AND o_orderpriority LIKE '1%' WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity)""",
}
