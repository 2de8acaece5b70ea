"""Streams over several files and restarts give what one batch gives."""

from pyspark.sql import functions as F

from predio.plans.actividad import dedup_24h
from predio.plans.estadisticas import aceptados, envio, validos
from predio.plans.vistas import parcelas
from predio.session import table
from predio.streaming import continuas

SF = "/root/testdata/sf0.001"


def test_restart_goes_on(spark, tmp_path):
    todos = table(spark, SF, "events")
    corte = todos.select(envio()).selectExpr("min(envio) + 1").first()[0]
    for parte in ("envio < {}", "envio >= {}"):
        todos.withColumn("envio", envio()).where(parte.format(corte)).drop("envio").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        llegan = continuas.eventos(spark, f"{tmp_path}/in")
        continuas.sumar_contadores(llegan, parcelas(spark, SF), f"{tmp_path}/n", f"{tmp_path}/c1").awaitTermination()
        salida = continuas.admitir(continuas.eventos(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/d")
        salida.option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert {r.lote for r in spark.read.parquet(f"{tmp_path}/n").select("lote").distinct().collect()} == {0, 1}
    got = spark.read.parquet(f"{tmp_path}/n").groupBy(*continuas.CLAVE).agg(F.sum("cantidad").alias("n"))
    want = validos(aceptados(todos), parcelas(spark, SF)).groupBy(*continuas.CLAVE).agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    ids = [r.id for r in spark.read.parquet(f"{tmp_path}/d").collect()]
    assert sorted(ids) == sorted(r.id for r in dedup_24h(spark, SF).collect())


def test_files_out_of_order(spark, tmp_path):
    """Leads of an older file that comes later count, over a restart too."""
    todos = table(spark, SF, "events")
    cortes = [0, *todos.selectExpr("percentile_approx(unix_micros(cast(ts as timestamp)), array(0.25, 0.5, 0.75))").first()[0], 1 << 62]
    for k in (3, 1, 0, 2):
        parte = todos.where(F.unix_micros(F.col("ts").cast("timestamp")).between(cortes[k], cortes[k + 1] - 1))
        parte.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        salida = continuas.admitir(continuas.eventos(spark, f"{tmp_path}/in", 1)).writeStream.format("parquet").option("path", f"{tmp_path}/d")
        salida.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    cambios = spark.read.parquet(f"{tmp_path}/d")
    assert cambios.where("cambio < 0").count() > 0
    assert sorted(r.id for r in continuas.vigentes(cambios).collect()) == sorted(r.id for r in dedup_24h(spark, SF).collect())


def test_keys_share_groups_of_state(spark, tmp_path, monkeypatch):
    """Few groups hold all keys, a null user or type is a key of its own, and a restart finds them again."""
    monkeypatch.setattr(continuas, "PARTES", 4)
    e = table(spark, SF, "events")
    nulo = lambda c, k, tipo: F.when(F.col("event_id") % k != 0, F.col(c)).cast(tipo).alias(c)
    todos = e.select(*[nulo(c, *{"user_id": (7, "long"), "event_type": (5, "string")}[c]) if c in ("user_id", "event_type") else c for c in e.columns]).cache()
    for k in (2, 0, 1):
        todos.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        salida = continuas.admitir(continuas.eventos(spark, f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/d")
        salida.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want, ultimo = [], {}
    for r in sorted(todos.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").collect(), key=lambda r: (r.us, r.event_id)):
        if r.us - ultimo.get(r[:2], -(1 << 62)) >= 24 * 3600 * 10**6:
            ultimo[r[:2]] = r.us
            want.append(r.event_id)
    assert sorted(r.id for r in continuas.vigentes(spark.read.parquet(f"{tmp_path}/d")).collect()) == sorted(want)
    assert None in {u for u, _ in ultimo} and len(ultimo) > 8
    assert spark.read.format("statestore").load(f"{tmp_path}/c").count() <= 4
