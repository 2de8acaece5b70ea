"""Holds on lots and remote jobs as streams with timers.

`admitir` judges requests for holds in the order in which they arrive, project by project: a
held lot, a buyer with a hold (by e-mail or phone) and a project with ten open holds refuse
further requests. A hold ends by event time: by its timer, or when a later row of its project
shows that its time is over, whichever comes first. `vigilar` closes jobs that stay
too long in the queue or fall silent.

State ends: of a project its open holds (ten at most) and its confirmed lots remain, of a job
nothing once it is closed. A row whose time is before what its project has already seen is
judged at that later time, as at a counter. One project's rows are judged by one task, one after
another, since each decision depends on those before it; a row costs a look at ten holds.

State is kept by transformWithState, which needs the RocksDB store (`con_estado` sets it).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta
from functools import cache
from itertools import batched

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from predio.plans.vistas import parcelas
from predio.session import shared_folder, table

#: Hours of a hold, open holds of a project, minutes in the queue and without a beat.
HORAS, TOPE, EN_COLA, CORRIENDO = 2, 10, timedelta(minutes=10), timedelta(minutes=3)
PEDIDO = "proyecto_id long, id long, que string, parcela string, email string, telefono string, cuando timestamp, horas int, disponible boolean"
#: Within the processors times are microseconds since the epoch.
FALLO = "proyecto_id long, id long, que string, motivo string, cuando long, vence_en long"
ABIERTA = "id long, parcela string, email string, telefono string, vence_en long"
HORA = 3600 * 1_000_000
#: Texts and numbers of a request that a turn looks at, rows that are unpacked or handed on at once, an absent id.
TEXTOS, NUMEROS, FILAS, SIN = ("que", "parcela", "email", "telefono"), {"us": np.int64, "id": np.int64, "horas": np.int32, "disponible": np.bool_}, 10_000, -(1 << 63)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def con_estado(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class Turno:
    """One project's open holds and confirmed lots, and what one row does to them."""

    def __init__(self, abiertas: list[tuple] = (), confirmado: Callable[[str], int | None] | None = None, hasta: int | None = None):
        self.abiertas = {a[0]: tuple(a) for a in abiertas}
        self.nuevas: dict[str, int] = {}
        self.antes = confirmado or (lambda parcela: None)
        self.hasta = hasta

    def duena(self, parcela: str) -> int | None:
        return self.nuevas[parcela] if parcela in self.nuevas else self.antes(parcela)

    def vencer(self, ahora: int) -> Iterator[tuple]:
        for a in sorted((a for a in self.abiertas.values() if a[4] <= ahora), key=lambda a: (a[4], a[0])):
            del self.abiertas[a[0]]
            yield a[0], "vencida", None, a[4], a[4]

    def aplicar(self, id: int, que: str, parcela: str, email: str, telefono: str, cuando: int, horas: int | None, disponible: bool) -> Iterator[tuple]:  # noqa: A002
        """(id, que, motivo, cuando, vence_en) of everything that the row brings about."""
        self.hasta = ahora = cuando if self.hasta is None else max(cuando, self.hasta)
        yield from self.vencer(ahora)
        otra = next((a[0] for a in self.abiertas.values() if a[1] == parcela and a[0] != id), None)
        duena = self.duena(parcela)
        ocupada = otra is not None or duena not in (None, id)
        if que == "pedir":
            motivo = None
            if not disponible:
                motivo = "no disponible"
            elif ocupada or duena == id or id in self.abiertas:
                motivo = "apartada"
            elif any((email is not None and a[2] == email) or (telefono is not None and a[3] == telefono) for a in self.abiertas.values()):
                motivo = "ya tiene otra"
            elif len(self.abiertas) >= TOPE:
                motivo = "muchas"
            if motivo is None:
                vence = ahora + (horas or HORAS) * HORA
                self.abiertas[id] = (id, parcela, email, telefono, vence)
                yield id, "apartada", None, ahora, vence
            else:
                yield id, "rechazada", motivo, ahora, None
        elif que == "confirmar":
            if id not in self.abiertas and ocupada:
                yield id, "rechazada", "otra la aparto", ahora, None
            else:
                self.abiertas.pop(id, None)
                self.nuevas[parcela] = id
                yield id, "confirmada", None, ahora, None
        else:
            if self.abiertas.pop(id, None) is None and duena == id:
                self.nuevas[parcela] = None
            yield id, "liberada", None, ahora, None


def _en_orden(partes: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A micro-batch's rows of one project in order of time, those of one instant by id: the arguments of Turno.aplicar.
    Held are numbers, some forty bytes a row, and each text once."""
    codigos: dict[str, int] = {}
    columnas = [[] for _ in (*TEXTOS, *NUMEROS)]
    for parte in partes:
        for c, en in zip(TEXTOS, columnas):
            cual, textos = pd.factorize(parte[c])
            en.append(np.array([codigos.setdefault(t, len(codigos)) for t in textos] + [-1], np.int32)[cual])
        for (c, tipo), en in zip(NUMEROS.items(), columnas[len(TEXTOS) :]):
            en.append(parte[c].astype("Int64").to_numpy(tipo, na_value=SIN) if c == "id" else parte[c].to_numpy(tipo))
    for i, c in enumerate(columnas):
        columnas[i] = np.concatenate(c)
    textos = [*codigos, None]
    que, parcela, email, telefono, us, id, *resto = columnas  # noqa: A001
    lugar = np.zeros(len(textos), np.int32)
    verbos = sorted(np.unique(que).tolist(), key=lambda v: textos[v] or "")
    lugar[verbos] = range(len(verbos))
    orden = np.lexsort((lugar[que], id, us))
    for desde in range(0, len(orden), FILAS):
        k = orden[desde : desde + FILAS]
        de = lambda c: [textos[x] for x in c[k].tolist()]  # noqa: B023, E731
        yield from zip((None if x == SIN else x for x in id[k].tolist()), de(que), de(parcela), de(email), de(telefono), us[k].tolist(), *(c[k].tolist() for c in resto))


def _llave(key: tuple) -> int | None:
    return None if pd.isna(key[0]) else int(key[0])


class Mostrador(StatefulProcessor):
    """A project's turn between micro-batches: open holds, confirmed lots, the time seen last."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.abiertas = handle.getListState("abiertas", ABIERTA)
        self.confirmadas = handle.getMapState("confirmadas", "parcela string", "id long")
        self.visto = handle.getValueState("visto", "hasta long")

    def _turno(self) -> Turno:
        @cache  # a call to the store costs more than a row
        def confirmado(parcela: str) -> int | None:
            found = self.confirmadas.getValue((parcela,)) if self.confirmadas.containsKey((parcela,)) else None
            return found[0] if found else None

        visto = self.visto.get() if self.visto.exists() else None
        return Turno([tuple(a) for a in self.abiertas.get()] if self.abiertas.exists() else [], confirmado, visto[0] if visto else None)

    def _guardar(self, turno: Turno) -> None:
        if turno.abiertas:
            self.abiertas.put(list(turno.abiertas.values()))
        else:
            self.abiertas.clear()
        for parcela, duena in turno.nuevas.items():
            if duena is None:
                self.confirmadas.removeKey((parcela,))
            else:
                self.confirmadas.updateValue((parcela,), (duena,))
        if turno.hasta is not None:
            self.visto.update((turno.hasta,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if turno.abiertas:  # one timer: for the hold that ends first
            self.handle.registerTimer(_ms(min(a[4] for a in turno.abiertas.values())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turno = self._turno()
        if (marca := timerValues.getCurrentWatermarkInMs()) > 0:  # holds up to here have been ended by timers
            turno.hasta = marca * 1000 if turno.hasta is None else max(turno.hasta, marca * 1000)
        yield from self._tabla(key, (h for r in _en_orden(rows) for h in turno.aplicar(*r)))
        self._guardar(turno)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        turno = self._turno()
        yield from self._tabla(key, turno.vencer(expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self._guardar(turno)

    def _tabla(self, key: tuple, hechos: Iterator[tuple]) -> Iterator[pd.DataFrame]:
        for parte in batched(hechos, FILAS):
            columnas = dict(zip(("id", "que", "motivo", "cuando", "vence_en"), zip(*parte)))
            largos = {c: pd.array(columnas[c], "Int64") for c in ("id", "cuando", "vence_en")}
            yield pd.DataFrame({"proyecto_id": pd.array([_llave(key)] * len(parte), "Int64"), **columnas, **largos})

    def close(self) -> None:
        pass


def _ms(us: int) -> int:
    """Milliseconds, rounded up: a timer must not come before its time."""
    return -(-us // 1000)


def admitir(llegan: DataFrame, demora: str = "0 seconds") -> DataFrame:
    """What becomes of requests, confirmations and releases (PEDIDO): proyecto_id, id, que (apartada,
    rechazada, confirmada, liberada, vencida), motivo, cuando, vence_en."""
    con_estado(llegan.sparkSession)
    filas = llegan.withColumns({"us": F.unix_micros("cuando"), "horas": F.coalesce("horas", F.lit(0)), "disponible": F.coalesce("disponible", F.lit(False))})
    hechos = filas.withWatermark("cuando", demora).groupBy("proyecto_id").transformWithStateInPandas(Mostrador(), FALLO, "append", "eventTime")
    return hechos.withColumns({c: F.timestamp_micros(c) for c in ("cuando", "vence_en")})


class Guardia(StatefulProcessor):
    """A job's last sign of life and its limit."""

    def __init__(self, en_cola: timedelta, corriendo: timedelta):
        self.limite = {k: v // timedelta(microseconds=1) for k, v in (("en_cola", en_cola), ("corriendo", corriendo))}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.estado = handle, handle.getValueState("estado", "estado string, ultimo long")

    def _perdido(self, key, estado: str, ultimo: int) -> Row:
        return Row(trabajo=key[0], estado="fallo", codigo=-1, cuando=ultimo + self.limite[estado])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        habia = ahora = tuple(self.estado.get() or ()) or None
        for r in sorted(rows, key=lambda r: (r.us, r.orden)):
            if ahora and r.us - ahora[1] > self.limite[ahora[0]]:
                yield self._perdido(key, *ahora)
                ahora = None
            if ahora is None:
                if r.que == "encolar":
                    ahora = ("en_cola", r.us)
                continue  # whatever comes for a closed job is ignored
            if r.que == "cerrar" and ahora[0] == "corriendo":
                yield Row(trabajo=key[0], estado="terminado", codigo=r.codigo, cuando=r.us)
                ahora = None
            elif r.que == "tomar" and ahora[0] == "en_cola":
                ahora = ("corriendo", r.us)
            elif r.que == "latido" and ahora[0] == "corriendo":
                ahora = ("corriendo", max(r.us, ahora[1]))
        if ahora != habia:
            self._guardar(habia, ahora)

    def _guardar(self, habia: tuple | None, ahora: tuple | None) -> None:
        """Each call to the store costs more than a job's rows: a job without state has no timer and nothing to clear."""
        if habia is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
        if ahora is None:
            self.estado.clear()
        else:
            self.estado.update(ahora)
            self.handle.registerTimer(_ms(ahora[1] + self.limite[ahora[0]]) + 1)  # lost when the limit is over, not when it is reached

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if ahora := self.estado.get():
            yield self._perdido(key, *ahora)
            self.estado.clear()

    def close(self) -> None:
        pass


def vigilar(llegan: DataFrame, en_cola: timedelta = EN_COLA, corriendo: timedelta = CORRIENDO, demora: str = "0 seconds") -> DataFrame:
    """How jobs end: trabajo, estado (terminado, fallo), codigo, cuando. llegan: trabajo, orden, que
    (encolar, tomar, latido, cerrar), codigo, cuando."""
    con_estado(llegan.sparkSession)
    filas = llegan.withColumn("us", F.unix_micros("cuando")).withWatermark("cuando", demora)
    fin = filas.groupBy("trabajo").transformWithState(Guardia(en_cola, corriendo), "trabajo long, estado string, codigo int, cuando long", "append", "eventTime")
    return fin.withColumn("cuando", F.timestamp_micros("cuando"))


def pedidos(ordenes: DataFrame, lotes: DataFrame) -> DataFrame:
    """Orders as rows of PEDIDO: a request, and for orders that are confirmed or released that too, some hours later.
    A project has eight lots and its buyers come back; a hold lasts as many days as the priority's digit."""
    n, k = F.col("o_orderkey"), F.col("o_custkey")
    proyecto, dias = F.pmod(k, F.lit(25)), F.substring("o_orderpriority", 1, 1).cast("int")
    base = ordenes.select(
        proyecto.alias("proyecto_id"), n.alias("id"), F.concat(F.pmod(n, F.lit(8)), F.lit("-"), proyecto).alias("parcela"), F.concat(F.lit("c"), F.pmod(k, F.lit(60)), F.lit("@correo.cl")).alias("email"),
        F.concat(F.lit("569"), F.lpad(F.pmod(k, F.lit(90)).cast("string"), 8, "0")).alias("telefono"), F.col("o_orderdate").cast("timestamp").alias("cuando"), (dias * 24).alias("horas"),
        (F.pmod(n, F.lit(8)) * 25 + proyecto).alias("lote"), F.when(F.col("o_orderstatus") == "O", "liberar").when((F.col("o_orderstatus") == "F") & (n % 7 == 0), "confirmar").alias("despues"),
    )
    en_venta = lotes.where("estado <> 'vendido'").select(F.col("id").alias("lote"), F.lit(True).alias("en_venta"))
    con = base.join(en_venta, "lote", "left").withColumn("disponible", F.coalesce("en_venta", F.lit(False)))
    resto = ["parcela", "email", "telefono"]
    pide = con.select("proyecto_id", "id", F.lit("pedir").alias("que"), *resto, "cuando", "horas", "disponible")
    sigue = con.where("despues is not null").select("proyecto_id", "id", F.col("despues").alias("que"), *resto, (F.col("cuando") + F.make_dt_interval(hours=F.pmod(F.col("id"), F.lit(100)).cast("int"))).alias("cuando"), "horas", "disponible")
    return pide.unionByName(sigue)


def corrientes(spark: SparkSession, carpeta: str, esquema) -> DataFrame:
    return spark.readStream.schema(esquema).parquet(carpeta)


def _hasta_el_fin(salida: DataFrame, base: str) -> DataFrame:
    spark = salida.sparkSession
    salida.writeStream.format("parquet").option("path", f"{base}/salida").option("checkpointLocation", f"{base}/control").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(salida.schema).parquet(f"{base}/salida")


def apartados_en_orden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of every request, in the order of arrival."""
    base = shared_folder(spark)
    pedidos(table(spark, sf_dir, "orders"), parcelas(spark, sf_dir)).write.parquet(f"{base}/pedidos")
    return _hasta_el_fin(admitir(corrientes(spark, f"{base}/pedidos", PEDIDO)), base)


def senales(ordenes: DataFrame) -> DataFrame:
    """A customer's orders as the signs of one job: queued, taken, beats, and for some the end."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = F.row_number().over(w)
    que = F.when(n == 1, "encolar").when(n == 2, "tomar").when((n > 5) & (F.col("o_orderstatus") == "O"), "cerrar").otherwise("latido")
    return ordenes.select(F.col("o_custkey").alias("trabajo"), F.col("o_orderkey").alias("orden"), que.alias("que"), F.when(que == "cerrar", F.pmod("o_orderkey", F.lit(3)).cast("int")).alias("codigo"), F.col("o_orderdate").cast("timestamp").alias("cuando"))


#: Days that the test table's jobs may wait and be silent.
ESPERA, SILENCIO = 600, 500


def trabajos_caidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the jobs end that end: closed, or lost by their timer."""
    base = shared_folder(spark)
    senales(table(spark, sf_dir, "orders")).write.parquet(f"{base}/senales")
    llegan = corrientes(spark, f"{base}/senales", "trabajo long, orden long, que string, codigo int, cuando timestamp")
    fin = _hasta_el_fin(vigilar(llegan, timedelta(days=ESPERA), timedelta(days=SILENCIO)), base)
    return fin.select("trabajo", "estado", "codigo", F.col("cuando").cast("timestamp_ntz").alias("cuando"))


QUERIES = {f.__name__: f for f in (apartados_en_orden, trabajos_caidos)}
ORACLES = {
    "trabajos_caidos": f"""
  WITH s AS (
    SELECT o_custkey AS trabajo, o_orderkey AS orden, o_orderdate AS cuando, o_orderstatus, row_number() OVER w AS n, lead(o_orderdate) OVER w AS sigue
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  t AS (SELECT *, n > 5 AND o_orderstatus = 'O' AS cierra, cuando + CASE n WHEN 1 THEN INTERVAL {ESPERA} DAY ELSE INTERVAL {SILENCIO} DAY END AS tope, (SELECT max(o_orderdate) FROM orders) AS fin FROM s),
  ends AS (
    SELECT trabajo, n, 'terminado' AS estado, CAST(orden % 3 AS INTEGER) AS codigo, cuando FROM t WHERE cierra
    UNION ALL SELECT trabajo, n, 'fallo', -1, tope FROM t WHERE NOT cierra AND coalesce(sigue, fin) > tope)
  SELECT trabajo, estado, codigo, cuando FROM (SELECT *, row_number() OVER (PARTITION BY trabajo ORDER BY n) AS lugar FROM ends) WHERE lugar = 1""",
}
