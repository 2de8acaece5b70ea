"""Domain views over the test tables, for Spark and, as SQL, for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.session import table

ESTADOS = ("disponible", "disponible", "reservado", "vendido")


def parcelas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots: id, proyecto_id, etapa, estado, precio, moneda, superficie, nombre."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.pmod("p_partkey", F.lit(25)).alias("proyecto_id"),
        F.pmod("p_partkey", F.lit(3)).alias("etapa"),
        F.element_at(F.array(*map(F.lit, ESTADOS)), (F.pmod("p_size", F.lit(4)) + 1).cast("int")).alias("estado"),
        F.when(F.pmod("p_partkey", F.lit(11)) != 0, F.col("p_retailprice")).alias("precio"),
        F.when(F.pmod("p_partkey", F.lit(5)) == 0, "UF").otherwise("CLP").alias("moneda"),
        F.col("p_size").cast("long").alias("superficie"),
        F.col("p_name").alias("nombre"),
    )


def reservas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holds: id, comprador, creada_en, vence_en (so many hours later as the priority's digit), estado, monto."""
    horas = F.substring("o_orderpriority", 1, 1).cast("int")
    estado = F.when(F.col("o_orderstatus") == "O", "confirmada").when(F.col("o_orderstatus") == "P", "pendiente").otherwise("liberada")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("comprador"),
        F.col("o_orderdate").alias("creada_en"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=horas)).alias("vence_en"),
        estado.alias("estado"),
        F.col("o_totalprice").alias("monto"),
    )


def bitacora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit log: id, usuario, que, cuando, lote."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("usuario"), F.col("event_type").alias("que"),
        F.col("ts").alias("cuando"), F.get_json_object("props", "$.k").cast("int").alias("lote"),
    )


PARCELAS_SQL = """(SELECT p_partkey AS id, p_partkey % 25 AS proyecto_id, p_partkey % 3 AS etapa,
  CASE p_size % 4 WHEN 2 THEN 'reservado' WHEN 3 THEN 'vendido' ELSE 'disponible' END AS estado,
  CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS precio,
  CASE WHEN p_partkey % 5 = 0 THEN 'UF' ELSE 'CLP' END AS moneda, CAST(p_size AS BIGINT) AS superficie, p_name AS nombre FROM part)"""
RESERVAS_SQL = """(SELECT o_orderkey AS id, o_custkey AS comprador, o_orderdate AS creada_en,
  o_orderdate + to_hours(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS vence_en,
  CASE o_orderstatus WHEN 'O' THEN 'confirmada' WHEN 'P' THEN 'pendiente' ELSE 'liberada' END AS estado, o_totalprice AS monto FROM orders)"""
BITACORA_SQL = """(SELECT event_id AS id, user_id AS usuario, event_type AS que, ts AS cuando,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS lote FROM events)"""
