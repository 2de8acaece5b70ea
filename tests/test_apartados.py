"""Holds and jobs as streams against plain loops, over restarts and with late rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from predio.plans.vistas import parcelas
from predio.session import table
from predio.streaming import apartados

SF = "/root/testdata/sf0.001"


def por_partes(spark, filas, carpeta, partes, salida):
    """The stream's rows after each part came as a file and the job was started anew."""
    for n, parte in enumerate(partes):
        parte.coalesce(1).write.mode("append").parquet(f"{carpeta}/in")
        s = salida(apartados.corrientes(spark, f"{carpeta}/in", filas))
        s.writeStream.format("parquet").option("path", f"{carpeta}/out").option("checkpointLocation", f"{carpeta}/c").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(s.schema).parquet(f"{carpeta}/out").collect()


def mostrador(partes):
    """One request after another, with a table of all requests ever made and the clock of each project."""
    tabla, reloj, hechos, marca = {}, {}, [], None

    def viva(s, ahora):
        return s["estado"] == "confirmada" or (s["estado"] == "pendiente" and s["vence"] > ahora)

    for parte in partes:
        for r in sorted(parte, key=lambda r: (r.cuando, r.id, r.que)):
            ahora = max(x for x in (r.cuando, reloj.get(r.proyecto_id), marca) if x is not None)
            reloj[r.proyecto_id] = ahora
            suyas = [s for s in tabla.values() if s["proyecto"] == r.proyecto_id]
            activas = [s for s in suyas if viva(s, ahora)]
            pendientes = [s for s in activas if s["estado"] == "pendiente"]
            de_otra = [s for s in activas if s["parcela"] == r.parcela and s["id"] != r.id]
            dice = lambda que, motivo=None, vence=None: hechos.append((r.proyecto_id, r.id, que, motivo, ahora, vence))  # noqa: B023, E731
            if r.que == "pedir":
                if not r.disponible:
                    dice("rechazada", "no disponible")
                elif de_otra:
                    dice("rechazada", "apartada")
                elif any(r.email and s["email"] == r.email or r.telefono and s["telefono"] == r.telefono for s in pendientes):
                    dice("rechazada", "ya tiene otra")
                elif len(pendientes) >= 10:
                    dice("rechazada", "muchas")
                else:
                    vence = ahora + timedelta(hours=r.horas or 2)
                    tabla[r.id] = {"id": r.id, "proyecto": r.proyecto_id, "parcela": r.parcela, "email": r.email, "telefono": r.telefono, "estado": "pendiente", "vence": vence}
                    dice("apartada", None, vence)
            elif r.que == "confirmar":
                propia = tabla.setdefault(r.id, {"id": r.id, "proyecto": r.proyecto_id, "parcela": r.parcela, "email": r.email, "telefono": r.telefono, "estado": "nunca", "vence": None})
                if not (propia["estado"] == "pendiente" and viva(propia, ahora)) and de_otra:
                    dice("rechazada", "otra la aparto")
                else:
                    if propia["estado"] == "pendiente" and not viva(propia, ahora):
                        hechos.append((r.proyecto_id, r.id, "vencida", None, propia["vence"], propia["vence"]))
                    propia["estado"] = "confirmada"
                    dice("confirmada")
            else:
                if r.id in tabla and tabla[r.id]["estado"] == "pendiente" and not viva(tabla[r.id], ahora):
                    hechos.append((r.proyecto_id, r.id, "vencida", None, tabla[r.id]["vence"], tabla[r.id]["vence"]))
                if r.id in tabla:
                    tabla[r.id]["estado"] = "liberada"
                dice("liberada")
        marca = max([marca, *(r.cuando for r in parte)], key=lambda x: x or datetime.min)
    abiertas = 0
    for s in tabla.values():
        if s["estado"] == "pendiente":
            if s["vence"] <= marca:
                hechos.append((s["proyecto"], s["id"], "vencida", None, s["vence"], s["vence"]))
            else:
                abiertas += 1
    return hechos, abiertas


def test_holds_equal_a_plain_loop(spark, tmp_path):
    todos = apartados.pedidos(table(spark, SF, "orders"), parcelas(spark, SF)).cache()
    a, b = (datetime(1997, 1, 1), datetime(1999, 6, 1))
    partes = [todos.where(F.col("cuando") < F.lit(a)), todos.where((F.col("cuando") >= F.lit(a)) & (F.col("cuando") < F.lit(b))), todos.where(F.col("cuando") >= F.lit(b))]
    filas = [p.collect() for p in partes]
    got = por_partes(spark, apartados.PEDIDO, str(tmp_path), partes, apartados.admitir)
    want, abiertas = mostrador(filas)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    motivos = {r.motivo for r in got}
    assert {"no disponible", "apartada", "ya tiene otra"} <= motivos
    assert sum(r.que == "rechazada" for r in got) * 3 > sum(r.que == "pedir" for p in filas for r in p)
    estado = spark.read.format("statestore").option("path", f"{tmp_path}/c").option("stateVarName", "abiertas").load()
    assert estado.count() == abiertas  # what has ended is out of the state


def test_late_rows_ties_and_odd_ones(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    fila = lambda p, i, que, lote, correo, minutos, horas=2, libre=True: (p, i, que, lote, correo, None if correo is None else f"t{correo}", t + timedelta(minutes=minutos), horas, libre)
    partes = [
        [fila(1, 1, "pedir", "a", "x", 0), fila(1, 2, "pedir", "a", "y", 0), fila(1, 3, "pedir", "b", "x", 1), fila(2, 4, "pedir", "a", "x", 60, None), fila(2, 5, "pedir", "b", None, 61), fila(2, 6, "pedir", "c", None, 62)],
        [fila(2, 7, "pedir", "a", "z", 179), fila(2, 8, "pedir", "a", "z", 180), fila(1, 9, "confirmar", "a", "q", 200), fila(1, 10, "pedir", "a", "q", 201), fila(1, 9, "liberar", "a", "q", 202), fila(1, 11, "pedir", "a", "q", 203)],
        [fila(3, 20 + k, "pedir", f"l{k}", f"c{k}", 300 + k, 24) for k in range(13)] + [fila(3, 40, "pedir", "l99", "c99", 400, 24, False)],
        [fila(1, 1, "confirmar", "a", "x", 500), fila(3, 41, "pedir", "l50", "c50", 3000)],
    ]
    dfs = [spark.createDataFrame(p, apartados.PEDIDO) for p in partes]
    got = por_partes(spark, apartados.PEDIDO, str(tmp_path), dfs, apartados.admitir)
    want, _ = mostrador([df.collect() for df in dfs])
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {r.motivo for r in got} == {None, "apartada", "ya tiene otra", "muchas", "no disponible"}


def test_late_rows_are_judged_at_the_clock_or_dropped_as_late(spark, tmp_path):
    """A row older than the watermark doesn't bring back a hold that has ended."""
    t = datetime(2024, 1, 1, 12)
    fila = lambda p, i, lote, minutos: (p, i, "pedir", lote, f"c{i}", f"t{i}", t + timedelta(minutes=minutos), 2, True)
    dfs = [spark.createDataFrame(p, apartados.PEDIDO) for p in ([fila(1, 1, "a", 0), fila(2, 2, "a", 600)], [fila(1, 3, "a", 30), fila(1, 4, "a", 700)])]
    got = {(r.id, r.que) for r in por_partes(spark, apartados.PEDIDO, str(tmp_path), dfs, apartados.admitir)}
    assert {(1, "apartada"), (1, "vencida"), (2, "apartada")} <= got
    assert (4, "apartada") in got or (3, "apartada") in got


@pytest.mark.parametrize("cortes", [1, 3])
def test_jobs_equal_a_plain_loop(spark, tmp_path, cortes):
    todas = apartados.senales(table(spark, SF, "orders")).cache()
    filas = todas.collect()
    orden = sorted({r.cuando for r in filas})
    bordes = [orden[len(orden) * k // cortes] for k in range(cortes)] + [orden[-1] + timedelta(days=1)]
    partes = [todas.where((F.col("cuando") >= F.lit(a)) & (F.col("cuando") < F.lit(b))) for a, b in zip(bordes, bordes[1:])]
    en_cola, corriendo = timedelta(days=200), timedelta(days=400)
    got = por_partes(spark, "trabajo long, orden long, que string, codigo int, cuando timestamp", str(tmp_path), partes, lambda d: apartados.vigilar(d, en_cola, corriendo))
    want, por_trabajo = set(), {}
    for r in filas:
        por_trabajo.setdefault(r.trabajo, []).append(r)
    for trabajo, suyas in por_trabajo.items():
        suyas.sort(key=lambda r: (r.cuando, r.orden))
        ultimo, estado = None, None
        for r in suyas:
            limite = en_cola if estado == "en_cola" else corriendo
            if estado and r.cuando > ultimo + limite:
                break
            if r.que == "cerrar" and estado == "corriendo":
                want.add((trabajo, "terminado", r.codigo, r.cuando))
                estado = None
                break
            estado, ultimo = ("en_cola" if r.que == "encolar" else "corriendo"), r.cuando
        if estado:
            limite = en_cola if estado == "en_cola" else corriendo
            if ultimo + limite < orden[-1]:
                want.add((trabajo, "fallo", -1, ultimo + limite))
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert {r.estado for r in got} == {"terminado", "fallo"}


def test_a_job_that_ends_at_once_costs_one_call():
    from datetime import timedelta

    from pyspark.sql import Row

    from predio.streaming.apartados import Guardia

    class Falso:
        def __init__(self):
            self.llamadas = []

        def __getattr__(self, nombre):
            return lambda *a: self.llamadas.append(nombre)

    falso = Falso()
    g = Guardia(timedelta(minutes=10), timedelta(minutes=3))
    g.handle = g.estado = falso
    filas = [Row(us=n, orden=n, que=q, codigo=0) for n, q in enumerate(("encolar", "tomar", "cerrar"))]
    assert [r.estado for r in g.handleInputRows((7,), iter(filas), None)] == ["terminado"]
    assert falso.llamadas == ["get"]


def test_a_project_s_rows_are_held_as_numbers():
    """Memory of a row in order is some tens of bytes, whatever its texts; order, nulls and chunks as of a plain sort."""
    import random
    import tracemalloc

    import pandas as pd

    draw = random.Random(7)
    filas = [(draw.randrange(10**6), draw.randrange(50), draw.choice(["pedir", "confirmar", "liberar"]), draw.choice("ab"), draw.choice([None, "x@correo.cl", "y@correo.cl"]), draw.choice([None, "569"]), draw.randrange(9), draw.random() < 0.5) for _ in range(60_000)]
    nombres = ["us", "id", "que", "parcela", "email", "telefono", "horas", "disponible"]
    partes = lambda: (pd.DataFrame(filas[k : k + 7000], columns=nombres) for k in range(0, len(filas), 7000))
    got = [(us, i, *textos, horas, libre) for i, *textos, us, horas, libre in apartados._en_orden(partes())]
    assert got == sorted(filas, key=lambda f: f[:3])
    tracemalloc.start()
    for n, _ in enumerate(apartados._en_orden(partes())):
        if n == 30_000:
            break
    assert tracemalloc.get_traced_memory()[1] < 200 * len(filas)
    tracemalloc.stop()
