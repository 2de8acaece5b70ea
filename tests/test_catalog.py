"""Every query against its SQL in DuckDB, and the ordered rules against a plain loop."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from predio.plans import catalog
from predio.session import TABLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_its_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    con = duck.sql(catalog.ORACLES[name])
    assert sorted(con.columns) == columns
    at = [con.columns.index(c) for c in columns]
    assert got and got == sorted((tuple(plain(r[i]) for i in at) for r in con.fetchall()), key=str)


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def limitados(filas, tope, segundos):
    """(key, time in seconds, id) that pass, in order of time."""
    pasados: dict = {}
    for k, t, i in sorted(filas, key=lambda r: (r[1], r[2])):
        vivos = [x for x in pasados.get(k, []) if t - x < segundos]
        if len(vivos) < tope:
            pasados[k] = [*vivos, t]
            yield i


def test_limiter_equals_a_plain_loop(spark):
    from predio.plans import actividad

    filas = [(r.user_id, r.ts.timestamp(), r.event_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect()]
    want = set(limitados(filas, actividad.TOPE_USUARIO, actividad.HORAS_USUARIO * 3600))
    assert len(want) < 0.75 * len(filas)
    assert {r.id for r in catalog.QUERIES["limitador_usuario"](spark, SF).collect()} == want


@pytest.mark.parametrize("tope, segundos", [(60, 60), (3, 3600), (5, 3600), (1, 86_400)])
def test_limits_that_refuse(spark, tope, segundos):
    """Bursts and silences of some keys, one of them with most rows, rows at one instant and exactly a window apart."""
    import random

    from predio.plans import actividad

    draw = random.Random(tope)
    filas, t = [], 1_700_000_000.0
    for k in (None, "a", "a", "a", "a", "b"):
        for _ in range(4):
            t += draw.choice([segundos, 3 * segundos, segundos - 1])
            for _ in range(2 * tope):
                filas.append((k, t, len(filas)))
                t += draw.choice([0, segundos / tope / 3, segundos / tope])
    df = spark.createDataFrame([(k, int(t * 1_000_000), i) for k, t, i in filas], "clave string, us long, id long").repartition(5)
    want = set(limitados([(k, int(t * 1_000_000) / 1_000_000, i) for k, t, i in filas], tope, segundos))
    assert {r.id for r in actividad.limitar(df, "clave", tope, segundos * 1_000_000).collect()} == want and len(want) < len(filas)
    if tope == 1:
        assert {r.id for r in actividad.admitir_espaciados(df, "clave").collect()} == want


def test_labels_of_numbers_from_100_on(spark):
    rows = catalog.QUERIES["huecos_numeracion"](spark, "/root/testdata/sf0.1").collect()
    assert max(r.numero for r in rows) >= 100
    assert all(r.rotulo == f"{r.sector}-{str(r.numero).zfill(2)}" for r in rows)


def test_names_and_amounts_as_written(spark):
    from predio.functions import texto

    lotes = {"LOTE 12": "12", "12.0": "12", "A-0420": "A420", "lote b 07": "B7", "N° 7-01": "7-1", "#15": "15", "PARCELA 3": "3", "sin número": None, "": None, None: None}
    lotes |= {"N 5": "N5", "LOTE N 12": "N12", "N 12-3": "N12", "N.5": None, "LOTE 12,0": None, "-5": None, "LOTE -5": "5", "LOTE--12": None, "12-": None, "12.5": None, "12/03/2024": None, "A": None}
    lotes |= {"PARCELA N° 12": "12", "Nº 12": "12", "12,00": "12", "7 - 01": "7-1", "LOTE 8-01": "8-1", "LOTE #12": "12", "a-1": "A1", "PARCELA12": "A12", "lote 007": "7", "9" * 45: "9" * 45, "LOTE 12.": "12", "12 3": None}
    montos = {"$ 13.124": 13124.0, "13.12": 13.12, "1.234.567,5": 1234567.5, "-5": -5.0, "1,2,3": None, "UF 1.500": 1500.0, "consultar": None, None: None}
    normales = {"João": "joao", "Ýngrid Škoda": "yngrid skoda", "Ångström": "angstrom", "Ñuñoa  Ltda..": "nunoa ltda", "ﬁn": "fin"}
    for casos, f in ((lotes, texto.lote_id), (montos, texto.monto), (normales, texto.normal)):
        df = spark.createDataFrame([(k,) for k in casos], "x string")
        assert {r.x: r.y for r in df.select("x", f(F.col("x")).alias("y")).collect()} == casos
    df = spark.createDataFrame([("a\u00a0\u3000b\tc  ",), ("abcd ef",)], "x string")
    assert [r.y for r in df.select(texto.limpio(F.col("x"), 5).alias("y")).collect()] == ["a b c", "abcd "]


def test_sheet_headers_repeats_and_stages(spark, tmp_path):
    from predio.plans import planillas

    hoja = tmp_path / "hoja.csv"
    hoja.write_text('﻿LOTE,Situación,Valor,Superficie  M2\n"Lote 7",Vendido,"$ 1.500",50\nsin,,,\n8,,0,\n', encoding="utf-8")
    got = {r.id: r for r in planillas.fichas(planillas.leer_csv(spark, str(hoja))).collect()}
    assert set(got) == {"7", "8"} and got["7"].etapa is None
    assert (got["7"].estado, got["7"].precio, got["7"].superficie) == ("vendido", 1500.0, 50)
    assert (got["8"].estado, got["8"].precio, got["8"].superficie) == ("no_disponible", None, None)
    filas = spark.createDataFrame([("7", "1", 0), ("7", "2", 1)], "lote string, precio string, fila long")
    with pytest.raises(ValueError, match="repeated lots: 7"):
        planillas.fichas(filas)
    assert [r.precio for r in planillas.fichas(filas, repetidas=True).collect()] == [2.0]
    assert planillas.fichas(filas.limit(0), repetidas=True).count() == 0
    with pytest.raises(ValueError, match="no column"):
        planillas.fichas(filas.drop("lote"))
