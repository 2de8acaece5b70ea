"""Statistics and admission kept up to date as events arrive, with Structured Streaming.

Each job reads new files of the events table in micro-batches of bounded size, keeps its
offsets and state in a checkpoint in the shared folder, and so goes on where it stopped.
The queries run a job over what is there and return its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from predio.plans import actividad
from predio.plans.estadisticas import aceptados, validos
from predio.plans.vistas import parcelas
from predio.session import shared_folder, table

CLAVE = ["proyecto_id", "dia", "parcela", "tipo"]
#: Bytes of files that a micro-batch takes; what one key has of them is sorted in one task.
POR_LOTE = 1 << 30
#: Groups that share the leads' state.
PARTES = 1024


def eventos(spark: SparkSession, sf_dir: str, por_lote: int = POR_LOTE) -> DataFrame:
    """The events table as a stream of its files."""
    esquema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(esquema).option("maxBytesPerTrigger", por_lote).parquet(f"{sf_dir}/events.parque[t]")


def sumar_contadores(llegan: DataFrame, lotes: DataFrame, destino: str, control: str):
    """Counters of each micro-batch under its number; a batch that is run again replaces its own.
    What a visitor sends at once comes in one file, so requests that are too long are refused by batch."""

    def anotar(lote: DataFrame, numero: int) -> None:
        validos(aceptados(lote), lotes).groupBy(*CLAVE).agg(F.count("*").alias("cantidad")).write.mode("overwrite").parquet(f"{destino}/lote={numero}")

    return llegan.writeStream.foreachBatch(anotar).option("checkpointLocation", control).trigger(availableNow=True).start()


def contadores_continuos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters per project, day, lot and type, summed over the micro-batches."""
    base = shared_folder(spark)
    sumar_contadores(eventos(spark, sf_dir), parcelas(spark, sf_dir), f"{base}/contadores", f"{base}/control").awaitTermination()
    return spark.read.parquet(f"{base}/contadores").groupBy(*CLAVE).agg(F.sum("cantidad").alias("cantidad"))


def admitir(llegan: DataFrame) -> DataFrame:
    """Leads that are kept: 24 h and more after the last kept one of the same user and type.

    Rows id and cambio: 1 when a lead is kept, -1 when it is taken back because an older one
    arrived later; the sum over an id says whether it is kept, in whatever order files come.
    State: times, ids, whose they are and kept or not of all leads (21 bytes each), since one of any age may still
    arrive. Keys share PARTES groups by their hash, as a group costs some milliseconds whatever it holds. The leads of
    the keys that a micro-batch names are judged again.
    """

    def decidir(clave: tuple, partes: Iterator[pd.DataFrame], estado: GroupState) -> Iterator[pd.DataFrame]:
        filas = pd.concat(list(partes))
        de, llaves = pd.factorize(filas["llave"])
        us, ids, antes = filas["us"].to_numpy(np.int64), filas["id"].to_numpy(np.int64), np.zeros(len(filas), np.int8)
        nombres: dict[str, int] = {}
        if estado.exists:
            *columnas, conocidas = estado.get
            nombres = {x: i for i, x in enumerate(conocidas)}
        cual = np.array([nombres.setdefault(x, len(nombres)) for x in llaves], np.int32)
        nombrada, quien = np.zeros(len(nombres), np.bool_), cual[de]
        nombrada[cual] = True
        if estado.exists:
            us, ids, antes, quien = (np.concatenate([np.frombuffer(bytes(x), y.dtype), y]) for x, y in zip(columnas, (us, ids, antes, quien)))
        orden = np.lexsort((ids, us, quien))
        us, ids, antes, quien = us[orden], ids[orden], antes[orden], quien[orden]
        ahora = antes.copy()
        otra, ultimo, toca = -1, 0, np.flatnonzero(nombrada[quien])
        for i, cuando, q in zip(toca.tolist(), us[toca].tolist(), quien[toca].tolist()):
            ahora[i] = q != otra or cuando - ultimo >= actividad.ESPERA_US
            if ahora[i]:
                otra, ultimo = q, cuando
        estado.update((us.tobytes(), ids.tobytes(), ahora.tobytes(), quien.tobytes(), list(nombres)))
        cambia = np.flatnonzero(ahora != antes)
        yield pd.DataFrame({"id": ids[cambia], "cambio": (ahora - antes)[cambia].astype("int32")})

    # a null user or type is one of its own, and no user's number holds a colon
    llave = F.concat(F.coalesce(F.col("user_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.concat(F.lit("="), "event_type"), F.lit("")))
    filas = llegan.select(llave.alias("llave"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"))
    filas = filas.withColumn("parte", F.pmod(F.xxhash64("llave"), F.lit(PARTES)))
    return filas.groupBy("parte").applyInPandasWithState(decidir, "id long, cambio int", "us binary, ids binary, pasan binary, quien binary, llaves array<string>", "append", GroupStateTimeout.NoTimeout)


def vigentes(cambios: DataFrame) -> DataFrame:
    """The leads that are kept after all changes so far."""
    return cambios.groupBy("id").agg(F.sum("cambio").cast("int").alias("n")).where("n > 0").select(F.explode(F.array_repeat("id", F.col("n"))).alias("id"))


def dedup_24h_continuo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The admitted leads: what the stream wrote, less what it took back."""
    base = shared_folder(spark)
    salida = admitir(eventos(spark, sf_dir)).writeStream.format("parquet").option("path", f"{base}/admitidos").option("checkpointLocation", f"{base}/control")
    salida.trigger(availableNow=True).start().awaitTermination()
    return vigentes(spark.read.schema("id long, cambio int").parquet(f"{base}/admitidos"))


QUERIES = {f.__name__: f for f in (contadores_continuos, dedup_24h_continuo)}
ORACLES = {"contadores_continuos": actividad.ORACLES["upsert_contadores"], "dedup_24h_continuo": actividad.ORACLES["dedup_24h"]}
