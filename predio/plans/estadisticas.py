"""Visit statistics: which events count, per-day and per-lot figures, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions.fechas import ZONA, dia_local
from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import table

#: The visitor events that are known, and the test table's names for them.
EVENTOS = {"view": "visita", "click": "ficha", "signup": "whatsapp", "purchase": "reservar"}


#: A batch of more events is refused whole (fixed value).
LOTE_MAX = 30
#: Days to a batch of the test table's events: what one user sends in them comes at once.
DIAS_ENVIO = 10


def envio() -> Column:
    return F.floor(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")) / DIAS_ENVIO).cast("long").alias("envio")


def aceptados(events: DataFrame) -> DataFrame:
    """The events of batches that aren't too long: a longer one is refused whole, whatever is in it."""
    con = events.withColumn("envio", envio())
    largos = con.groupBy("user_id", "envio").agg(F.count("*").alias("n")).where(F.col("n") > LOTE_MAX)
    return con.join(largos, ["user_id", "envio"], "left_anti").drop("envio")


def validos(events: DataFrame, lotes: DataFrame) -> DataFrame:
    """Known event types; those of a lot only if the event's own project has it (lotes: proyecto_id, id).
    A visit belongs to the whole project: its lot is '' and isn't looked up."""
    tipo = F.create_map(*[F.lit(x) for kv in EVENTOS.items() for x in kv])
    proyecto, k = F.pmod("user_id", F.lit(25)).cast("int"), F.get_json_object("props", "$.k")
    # the test table's lots: the k-th of the project, but in every tenth event k is the lot itself
    escrito = F.when(F.col("event_id") % 10 == 0, k).otherwise((k.cast("int") * 25 + proyecto).cast("string"))
    v = events.where(F.col("event_type").isin(*EVENTOS)).withColumn("tipo", F.element_at(tipo, F.col("event_type")))
    columnas = ["event_id", proyecto.alias("proyecto_id"), dia_local(F.col("ts")).alias("dia")]
    visitas = v.where("event_type = 'view'").select(*columnas, F.lit("").alias("parcela"), "tipo")
    de_lote = v.where("event_type <> 'view'").select(*columnas, F.substring(escrito, 1, 40).alias("parcela"), "tipo")
    conocidos = lotes.select(F.col("proyecto_id").cast("int").alias("proyecto_id"), F.col("id").cast("string").alias("parcela"))
    return visitas.unionByName(de_lote.join(conocidos, ["proyecto_id", "parcela"], "left_semi").select(*visitas.columns))


def eventos_validos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validos(aceptados(table(spark, sf_dir, "events")), parcelas(spark, sf_dir))


def lotes_de_eventos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of events as they come in: accepted, or refused whole if too long."""
    b = table(spark, sf_dir, "events").groupBy("user_id", envio()).agg(F.count("*").alias("n"))
    return b.select("user_id", "envio", F.when(F.col("n") <= LOTE_MAX, F.col("n")).otherwise(0).alias("aceptados"), (F.col("n") > LOTE_MAX).alias("rechazado"))


def estadisticas_resumen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per project and event type, with the number of days that have any."""
    return (
        eventos_validos(spark, sf_dir)
        .groupBy("proyecto_id", "tipo")
        .agg(F.count("*").alias("cantidad"), F.countDistinct("dia").alias("dias"))
    )


_ENVIO_SQL = f"date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // {DIAS_ENVIO}"
#: An event counts if its request is short enough and, unless it is a visit, the site of its project has its lot.
VALIDOS_SQL = f"""
  SELECT event_id, e.proyecto_id, dia, tipo, e.parcela FROM (
    SELECT event_id, CAST(user_id % 25 AS INTEGER) AS proyecto_id, CAST(timezone('{ZONA}', timezone('UTC', ts)) AS DATE) AS dia,
           CASE event_type WHEN 'view' THEN 'visita' WHEN 'click' THEN 'ficha' WHEN 'signup' THEN 'whatsapp' ELSE 'reservar' END AS tipo,
           CASE WHEN event_type = 'view' THEN '' WHEN event_id % 10 = 0 THEN json_extract_string(props, '$.k')
                ELSE CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) * 25 + user_id % 25 AS VARCHAR) END AS parcela,
           count(*) OVER (PARTITION BY user_id, {_ENVIO_SQL}) AS del_envio, event_type
    FROM events) e
  WHERE del_envio <= {LOTE_MAX} AND event_type IN ('view', 'click', 'signup', 'purchase')
    AND (tipo = 'visita' OR EXISTS (SELECT 1 FROM {PARCELAS_SQL} p WHERE p.proyecto_id = e.proyecto_id AND CAST(p.id AS VARCHAR) = e.parcela))"""

QUERIES = {"estadisticas_resumen": estadisticas_resumen, "lotes_de_eventos": lotes_de_eventos}
ORACLES = {
    "lotes_de_eventos": f"""
  SELECT user_id, envio, CASE WHEN n <= {LOTE_MAX} THEN n ELSE 0 END AS aceptados, n > {LOTE_MAX} AS rechazado
  FROM (SELECT user_id, {_ENVIO_SQL} AS envio, count(*) AS n FROM events GROUP BY ALL)""",
    "estadisticas_resumen": f"""
  SELECT proyecto_id, tipo, count(*) AS cantidad, count(DISTINCT dia) AS dias
  FROM ({VALIDOS_SQL}) GROUP BY proyecto_id, tipo""",
}
