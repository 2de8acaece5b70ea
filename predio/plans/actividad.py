"""Activity: statistics over days and lots, merged log lines, holds, queues, admission in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.plans.estadisticas import VALIDOS_SQL, eventos_validos
from predio.plans.vistas import BITACORA_SQL, PARCELAS_SQL, RESERVAS_SQL, bitacora, parcelas, reservas
from predio.session import table

AHORA = "1998-06-01 12:00:00"
ESPERA_US = 24 * 3600 * 1_000_000
TOPE_HORA = 5


def estadisticas_por_dia(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits per project and day, days without any included."""
    n = eventos_validos(spark, sf_dir).where("tipo = 'visita'").groupBy("proyecto_id", "dia").agg(F.count("*").alias("n"))
    dias = n.agg(F.explode(F.sequence(F.min("dia"), F.max("dia"))).alias("dia"))
    todos = n.select("proyecto_id").distinct().crossJoin(F.broadcast(dias))  # projects by the days of the window
    return todos.join(n, ["proyecto_id", "dia"], "left").select("proyecto_id", "dia", F.coalesce("n", F.lit(0)).alias("visitas"))


def estadisticas_por_semana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of seven days from the first day on; the last one may be short."""
    d = estadisticas_por_dia(spark, sf_dir).groupBy("dia").agg(F.sum("visitas").alias("visitas"))
    inicio = d.agg(F.min("dia").alias("inicio"))
    d = d.crossJoin(F.broadcast(inicio))  # one row
    return d.groupBy(F.floor(F.datediff("dia", "inicio") / 7).cast("int").alias("barra")).agg(F.min("dia").alias("desde"), F.count("*").alias("dias"), F.sum("visitas").alias("visitas"))


def estadisticas_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty lots (of a project each) of most interest: events, leads and holds, and the state now (null if the lot is gone)."""
    clave = ["proyecto_id", "parcela"]
    v = eventos_validos(spark, sf_dir).where("parcela <> ''").select(*clave, "tipo")
    de = lambda df, lote, tipo: df.select((F.col(lote) % 25).cast("int").alias("proyecto_id"), F.col(lote).cast("string").alias("parcela"), F.lit(tipo).alias("tipo"))
    leads = de(table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'"), "l_partkey", "interesa")
    holds = de(reservas(spark, sf_dir).where("estado = 'pendiente'"), "comprador", "reservas")
    cuenta = [F.count_if(F.col("tipo") == t).alias(t) for t in ("ficha", "whatsapp", "reservar", "interesa", "reservas")]
    t = v.unionByName(leads).unionByName(holds).groupBy(*clave).agg(*cuenta)
    lotes = parcelas(spark, sf_dir).where("id % 7 <> 0").select(F.col("proyecto_id").cast("int").alias("proyecto_id"), F.col("id").cast("string").alias("parcela"), "estado")
    primeros = t.orderBy(F.desc("ficha"), F.desc("interesa"), F.desc("whatsapp"), *clave).limit(50)
    return primeros.join(lotes, clave, "left").select(*clave, "estado", "ficha", "whatsapp", "reservar", "interesa", "reservas")


def upsert_contadores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters after a second batch is merged into those of the first."""
    v = eventos_validos(spark, sf_dir)
    clave = ["proyecto_id", "dia", "parcela", "tipo"]
    lote = lambda cond: v.where(cond).groupBy(*clave).agg(F.count("*").alias("cantidad"))
    return lote("event_id % 2 = 0").unionByName(lote("event_id % 2 <> 0")).groupBy(*clave).agg(F.sum("cantidad").alias("cantidad"))


def islas_eventos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that follow each other in a tenant's log and are equal in user, action and detail on
    the same day, as one with its count. Islands don't cross days, so a window is one day's log."""
    b = bitacora(spark, sf_dir).select("id", F.pmod("usuario", F.lit(25)).alias("cliente"), F.to_date("cuando").alias("dia"), F.pmod("usuario", F.lit(2)).alias("actor"), "que", F.floor(F.col("lote") / 50).alias("detalle"), "cuando")
    w = Window.partitionBy("cliente", "dia").orderBy("cuando", "id")
    linea = F.struct("actor", "que", "detalle")
    b = b.withColumn("isla", F.sum(F.when(linea.eqNullSafe(F.lag(linea).over(w)), 0).otherwise(1)).over(w))
    return b.groupBy("cliente", "dia", "isla").agg(F.min("id").alias("id"), F.first("que").alias("que"), F.min("cuando").alias("desde"), F.max("cuando").alias("hasta"), F.count("*").alias("veces")).drop("isla", "dia")


def estado_reserva(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the holds at an instant: a pending one that has run out is expired."""
    ahora = F.lit(AHORA).cast("timestamp_ntz")
    r = reservas(spark, sf_dir).withColumn("a_las", F.when((F.col("estado") == "pendiente") & (F.col("vence_en") <= ahora), "vencida").otherwise(F.col("estado")))
    return r.groupBy("a_las").agg(F.count("*").alias("n"), F.max("vence_en").alias("ultima"))


def apartadas_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available lots that are held show as reserved; others stay."""
    apartadas = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_linenumber = 1").select(F.col("l_partkey").alias("id")).distinct()
    p = parcelas(spark, sf_dir).join(apartadas.withColumn("apartada", F.lit(True)), "id", "left")
    return p.select("id", F.when((F.col("estado") == "disponible") & F.col("apartada"), "reservado").otherwise(F.col("estado")).alias("estado"))


def ultimo_por_clave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each buyer's newest hold."""
    ultima = F.max_by(F.struct("id", "estado"), F.struct("creada_en", "id")).alias("u")
    return reservas(spark, sf_dir).groupBy("comprador").agg(ultima).select("comprador", "u.id", "u.estado")


def historial_pagina(spark: SparkSession, sf_dir: str, antes: int = 5000, n: int = 50) -> DataFrame:
    """One page of the log, by key."""
    return bitacora(spark, sf_dir).where(F.col("id") < antes).orderBy(F.desc("id")).limit(n).select("id", "usuario", "que", "cuando")


def cola_trabajos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the open holds in the one queue, first in first out: the days before, then the place within the day."""
    q = reservas(spark, sf_dir).where("estado = 'confirmada'").select("id", "comprador", "creada_en", F.to_date("creada_en").alias("dia"))
    dias = q.groupBy("dia").agg(F.count("*").alias("n"))
    antes = F.coalesce(F.sum("n").over(Window.orderBy("dia").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each day
    dentro = F.row_number().over(Window.partitionBy("dia").orderBy("creada_en", "id"))
    return q.withColumn("dentro", dentro).join(dias.select("dia", antes.alias("antes")), "dia").select("id", "comprador", (F.col("antes") + F.col("dentro")).alias("lugar"))


def inbox_interesados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 newest leads with their project's name and their lot's state now (null if it is gone)."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), F.col("ts").alias("creado_en"), F.pmod("user_id", F.lit(25)).alias("proyecto_id"), F.get_json_object("props", "$.k").cast("long").alias("lote"))
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("proyecto_id"), F.col("n_name").alias("proyecto"))
    lotes = parcelas(spark, sf_dir).select(F.col("id").alias("lote"), "estado")
    nuevos = e.join(p, "proyecto_id").orderBy(F.desc("creado_en"), F.desc("id")).limit(500)
    return nuevos.join(lotes, "lote", "left").select("id", "creado_en", "proyecto", "lote", "estado")


def en_orden(df: DataFrame, clave: str, ventana: int, decide) -> DataFrame:
    """The ids of df (key, us, id) that are admitted, judged one after another within each key.

    Where a key is silent for `ventana` microseconds nothing of what was admitted counts any more, so the
    rows after that are judged by themselves: gaps are found between blocks of that length (a row for each
    key and block), and a key's stretches are dealt over tasks. A task holds one stretch's state at a time.
    Only a stretch without any such gap stays in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        actual, estado = None, None
        for b in batches:
            pasan = []
            for k, tramo, us, i in zip(*(c.to_pylist() for c in b.columns)):
                if (k, tramo) != actual:
                    actual, estado = (k, tramo), None
                pasa, estado = decide(estado, us)
                if pasa:
                    pasan.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(pasan, pa.int64())], ["id"])

    filas = df.select(F.coalesce(F.col(clave).cast("string"), F.lit("")).alias("clave"), "us", "id", F.floor(F.col("us") / ventana).alias("bloque"))
    bloques = filas.groupBy("clave", "bloque").agg(F.min("us").alias("desde"), F.max("us").alias("hasta"))
    w = Window.partitionBy("clave").orderBy("bloque")
    corta = F.coalesce((F.col("desde") - F.lag("hasta").over(w) >= ventana).cast("int"), F.lit(0))
    tramos = bloques.withColumn("corta", corta).withColumn("tramo", F.sum("corta").over(w)).select("clave", "bloque", "tramo")
    con = filas.join(tramos, ["clave", "bloque"]).select("clave", "tramo", "us", "id")
    return con.repartition("clave", "tramo").sortWithinPartitions("clave", "tramo", "us", "id").mapInArrow(run, "id long")


def admitir_espaciados(df: DataFrame, clave: str, espera: int = ESPERA_US) -> DataFrame:
    """Rows (key, us, id) that come `espera` microseconds and more after the last admitted one of their key."""
    return en_orden(df, clave, espera, lambda ultimo, us: (True, us) if ultimo is None or us - ultimo >= espera else (False, ultimo))


def limitar(df: DataFrame, clave: str, tope: int = TOPE_HORA, ventana: int = ESPERA_US // 24) -> DataFrame:
    """Rows (key, us, id) that pass: at most `tope` admitted ones of a key within `ventana` microseconds."""

    def decide(pasados, us):
        pasados = [x for x in pasados or [] if us - x < ventana]
        return (True, [*pasados, us]) if len(pasados) < tope else (False, pasados)

    return en_orden(df, clave, ventana, decide)


def _filas(spark: SparkSession, sf_dir: str, clave: Column) -> DataFrame:
    return bitacora(spark, sf_dir).select(clave.alias("clave"), F.unix_micros(F.col("cuando").cast("timestamp")).alias("us"), "id")


def dedup_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads that are kept: 24 h and more after the last kept one of the same user and type."""
    return admitir_espaciados(_filas(spark, sf_dir, F.concat_ws("|", "usuario", "que")), "clave")


#: The test table's users are slow: so many requests in so many hours refuse about a third.
TOPE_USUARIO, HORAS_USUARIO = 3, 36


def limitador_usuario(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that pass the limit, each user by itself."""
    return limitar(_filas(spark, sf_dir, F.col("usuario")), "clave", TOPE_USUARIO, HORAS_USUARIO * 3600 * 1_000_000)


QUERIES = {f.__name__: f for f in (estadisticas_por_dia, estadisticas_por_semana, estadisticas_top, upsert_contadores, islas_eventos, estado_reserva, apartadas_overlay, ultimo_por_clave, historial_pagina, cola_trabajos, inbox_interesados, dedup_24h, limitador_usuario)}
_DIAS = f"""(SELECT p.proyecto_id, d.dia, coalesce(n, 0) AS visitas FROM (SELECT DISTINCT proyecto_id FROM v) p
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(dia), max(dia), INTERVAL 1 DAY)) AS DATE) AS dia FROM v) d
  LEFT JOIN (SELECT proyecto_id, dia, count(*) AS n FROM v GROUP BY ALL) c ON c.proyecto_id = p.proyecto_id AND c.dia = d.dia)"""
_V = f"WITH v AS (SELECT * FROM ({VALIDOS_SQL}) WHERE tipo = 'visita')"
ORACLES = {
    "estadisticas_por_dia": f"{_V} SELECT * FROM {_DIAS}",
    "estadisticas_por_semana": f"""{_V}
  SELECT CAST((dia - (SELECT min(dia) FROM v)) // 7 AS INTEGER) AS barra, min(dia) AS desde, count(*) AS dias, CAST(sum(visitas) AS BIGINT) AS visitas
  FROM (SELECT dia, sum(visitas) AS visitas FROM {_DIAS} GROUP BY dia) GROUP BY 1""",
    "estadisticas_top": f"""
  SELECT t.*, l.estado FROM (
    SELECT proyecto_id, parcela, count(*) FILTER (tipo = 'ficha') AS ficha, count(*) FILTER (tipo = 'whatsapp') AS whatsapp, count(*) FILTER (tipo = 'reservar') AS reservar,
           count(*) FILTER (tipo = 'interesa') AS interesa, count(*) FILTER (tipo = 'reservas') AS reservas
    FROM (SELECT proyecto_id, parcela, tipo FROM ({VALIDOS_SQL}) WHERE parcela <> ''
          UNION ALL SELECT CAST(l_partkey % 25 AS INTEGER), CAST(l_partkey AS VARCHAR), 'interesa' FROM lineitem WHERE l_returnflag = 'R'
          UNION ALL SELECT CAST(comprador % 25 AS INTEGER), CAST(comprador AS VARCHAR), 'reservas' FROM {RESERVAS_SQL} WHERE estado = 'pendiente')
    GROUP BY ALL ORDER BY ficha DESC, interesa DESC, whatsapp DESC, proyecto_id, parcela LIMIT 50) t
  LEFT JOIN (SELECT CAST(proyecto_id AS INTEGER) AS proyecto_id, CAST(id AS VARCHAR) AS parcela, estado FROM {PARCELAS_SQL} WHERE id % 7 <> 0) l USING (proyecto_id, parcela)""",
    "upsert_contadores": f"SELECT proyecto_id, dia, parcela, tipo, count(*) AS cantidad FROM ({VALIDOS_SQL}) GROUP BY ALL",
    "islas_eventos": f"""
  WITH b AS (SELECT id, usuario % 25 AS cliente, CAST(cuando AS DATE) AS dia, usuario % 2 AS actor, que, lote // 50 AS detalle, cuando FROM {BITACORA_SQL}),
  n AS (SELECT *, row_number() OVER (PARTITION BY cliente ORDER BY cuando, id)
              - row_number() OVER (PARTITION BY cliente, dia, actor, que, detalle ORDER BY cuando, id) AS isla FROM b)
  SELECT cliente, min(id) AS id, que, min(cuando) AS desde, max(cuando) AS hasta, count(*) AS veces FROM n GROUP BY cliente, dia, actor, que, detalle, isla""",
    "estado_reserva": f"""
  SELECT CASE WHEN estado = 'pendiente' AND vence_en <= TIMESTAMP '{AHORA}' THEN 'vencida' ELSE estado END AS a_las, count(*) AS n, max(vence_en) AS ultima
  FROM {RESERVAS_SQL} GROUP BY 1""",
    "apartadas_overlay": f"""
  SELECT id, CASE WHEN estado = 'disponible' AND id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 1) THEN 'reservado' ELSE estado END AS estado
  FROM {PARCELAS_SQL}""",
    "ultimo_por_clave": f"""
  SELECT comprador, id, estado FROM (SELECT *, row_number() OVER (PARTITION BY comprador ORDER BY creada_en DESC, id DESC) AS n FROM {RESERVAS_SQL}) WHERE n = 1""",
    "historial_pagina": f"SELECT id, usuario, que, cuando FROM {BITACORA_SQL} WHERE id < 5000 ORDER BY id DESC LIMIT 50",
    "cola_trabajos": f"SELECT id, comprador, row_number() OVER (ORDER BY creada_en, id) AS lugar FROM {RESERVAS_SQL} WHERE estado = 'confirmada'",
    "inbox_interesados": f"""
  SELECT i.id, i.creado_en, i.proyecto, i.lote, p.estado FROM (
    SELECT event_id AS id, ts AS creado_en, n_name AS proyecto, CAST(json_extract_string(props, '$.k') AS BIGINT) AS lote
    FROM events JOIN nation ON n_nationkey = user_id % 25 WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 500) i
  LEFT JOIN {PARCELAS_SQL} p ON p.id = i.lote""",
    "dedup_24h": f"""
  WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY usuario, que ORDER BY cuando, id) AS n FROM {BITACORA_SQL}),
  f AS (SELECT usuario, que, n, id, cuando AS ultimo, true AS pasa FROM b WHERE n = 1
    UNION ALL SELECT b.usuario, b.que, b.n, b.id, CASE WHEN b.cuando - f.ultimo >= INTERVAL 24 HOUR THEN b.cuando ELSE f.ultimo END, b.cuando - f.ultimo >= INTERVAL 24 HOUR
    FROM f JOIN b ON b.usuario = f.usuario AND b.que = f.que AND b.n = f.n + 1)
  SELECT id FROM f WHERE pasa""",
}
