"""Rounds of sheets onto published sites: what changes, what is refused, what a reader sees."""

import pytest

from predio.plans.publicacion import COMERCIALES, OtraVuelta, Sitio, comparar, fichas, resumen

BASE = "proyecto_id long, id string, area_kmz_m2 double, dibujada boolean, estado string, precio double, moneda string, superficie_m2 double, en_planilla boolean, vistas array<string>"


def lote(proyecto, i, estado="no_disponible", en_planilla=False, precio=None, dibujada=True):
    return (proyecto, i, 5000.0, dibujada, estado, precio, "CLP", 5000.0, en_planilla, ["p01"] if dibujada else [])


@pytest.fixture
def sitio(spark, tmp_path):
    def hacer(*lotes):
        s = Sitio(spark, f"file://{tmp_path}/sitio")
        s.publicar(spark.createDataFrame(list(lotes), BASE))
        return s

    return hacer


def hoja(spark, *filas, columnas="proyecto_id long, id string, estado string, precio double, moneda string, superficie_m2 double"):
    n = len(columnas.split(","))
    return spark.createDataFrame([(*f, *[None] * (n - len(f))) for f in filas], columnas)


def estado(s):
    return {(r.proyecto_id, r.id): (r.estado, r.precio, r.superficie_m2) for r in s.leer().collect()}


def dicho(df):
    return {r.proyecto_id: (r.resultado, r.cambiadas, r.n_faltan, list(r.primeras)) for r in df.collect()}


def test_only_commercial_fields_change(spark, sitio):
    s = sitio(lote(1, "1"), lote(1, "2"), lote(1, "3"))
    got = s.sincronizar(hoja(spark, (1, "1", "disponible", 9990000.0, "CLP", 5002.0), (1, "2", "vendido", None, "CLP", 5100.0)))
    assert dicho(got) == {1: ("al dia", 2, 0, [])}
    assert estado(s) == {(1, "1"): ("disponible", 9990000.0, 5002.0), (1, "2"): ("vendido", None, 5100.0), (1, "3"): ("no_disponible", None, 5000.0)}
    assert {(r.id, r.area_kmz_m2, r.dibujada, tuple(r.vistas)) for r in s.leer().collect()} == {(i, 5000.0, True, ("p01",)) for i in "123"}
    assert {(r.estado, r.n, r.con_geometria, r.con_vista) for r in resumen(s.leer()).collect()} == {("disponible", 1, 1, 1), ("vendido", 1, 1, 1), ("no_disponible", 1, 1, 1)}
    assert set(COMERCIALES) <= set(s.leer().columns)


def test_the_same_sheet_again_changes_nothing(spark, sitio):
    s = sitio(lote(1, "1"))
    filas = hoja(spark, (1, "1", "disponible", 1.0, "CLP", 5000.0))
    assert dicho(s.sincronizar(filas))[1][0] == "al dia" and s.numero() == 2
    assert dicho(s.sincronizar(filas)) == {1: ("sin cambios", 0, 0, [])} and s.numero() == 2


def test_missing_and_orphan_lots_are_refused_and_nothing_is_written(spark, sitio):
    s = sitio(lote(1, "1"), lote(2, "1"), lote(2, "7", "disponible", True, dibujada=False), lote(3, "1"))
    antes = estado(s)
    got = dicho(s.sincronizar(hoja(spark, (1, "1", "disponible"), (1, "2-15", "vendido"), (1, "2-7", "vendido"), (1, "99", "vendido"), (2, "1", "disponible"), (3, None, "vendido"), (4, "1", "vendido"), (None, "1", "vendido"))))
    assert got == {1: ("reconstruir", 0, 3, ["99", "2-7", "2-15"]), 2: ("reconstruir", 0, 1, ["7"]), 3: ("ilegible", 0, 0, []), 4: ("sin construir", 0, 1, ["1"])}
    assert estado(s) == antes and s.numero() == 1


def test_a_refused_project_does_not_stop_the_others(spark, sitio):
    s = sitio(lote(1, "1"), lote(2, "1"), lote(3, "1"))
    got = dicho(s.sincronizar(hoja(spark, (1, "1", "vendido"), (1, "5", "vendido"), (2, "1", "vendido", 3.0, "UF", 10.0))))
    assert got[1][0] == "reconstruir" and got[2] == ("al dia", 1, 0, [])
    assert estado(s) == {(1, "1"): ("no_disponible", None, 5000.0), (2, "1"): ("vendido", 3.0, 10.0), (3, "1"): ("no_disponible", None, 5000.0)}


def test_not_for_sale_stays_without_a_sheet_row(spark, sitio):
    s = sitio(lote(1, "1"), lote(1, "2", "no_en_venta"), lote(1, "3", "no_en_venta", True))
    s.sincronizar(hoja(spark, (1, "1", "disponible", None, "CLP", 1.0)))
    assert {i: e[0] for (_, i), e in estado(s).items()} == {"1": "disponible", "2": "no_en_venta", "3": "no_disponible"}


def test_new_columns_and_the_last_row_of_a_lot(spark, sitio):
    s = sitio(lote(1, "1", "disponible", True, 5.0), lote(2, "1"))
    columnas = "proyecto_id long, id string, estado string, fila long, rol string, pie double, cuotas int, mostrar_numero boolean"
    filas = hoja(spark, (1, "1", "vendido", 2, "8073-145", 1998000.0, 24, False), (1, "1", "disponible", 1, "otro", None, None, True), columnas=columnas)
    s.sincronizar(filas)
    r = s.leer().where("proyecto_id = 1").first()
    assert (r.estado, r.rol, r.pie, r.cuotas, r.sin_numero, r.en_planilla, r.precio) == ("vendido", "8073-145", 1998000.0, 24, True, True, None)
    assert s.leer().where("proyecto_id = 2").first().rol is None  # an older version without the column
    assert dicho(s.sincronizar(filas))[1][0] == "sin cambios"


def test_two_rounds_at_once(spark, sitio):
    s = sitio(lote(1, "1"))
    otro = Sitio(spark, s.base)
    visto = s.leer()
    desde = s.numero()
    otro.sincronizar(hoja(spark, (1, "1", "vendido")))
    assert {r.estado for r in visto.collect()} == {"no_disponible"}  # the reader's state stays whole
    with pytest.raises(OtraVuelta):
        s.publicar(spark.createDataFrame([lote(1, "1", "reservado")], BASE), desde)
    assert estado(s)[1, "1"][0] == "vendido" and s.numero() == desde + 1


def test_rounds_over_arriving_sheets(spark, sitio, tmp_path):
    s = sitio(lote(1, "1"), lote(2, "1"))
    for n, filas in enumerate(([(1, "1", "vendido"), (2, "9", "vendido")], [(1, "1", "vendido")], [(2, "1", "reservado")])):
        df = hoja(spark, *filas)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/hojas")
        llegan = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/hojas")
        s.vigilar(llegan, f"{tmp_path}/control", None).awaitTermination()
        assert s.numero() == (2, 2, 3)[n]
    assert estado(s) == {(1, "1"): ("vendido", None, None), (2, "1"): ("reservado", None, None)}
    juicios = spark.read.parquet(f"{tmp_path}/sitio/revisiones/*")
    assert juicios.where("resultado = 'reconstruir'").count() == 1


def test_nothing(spark, sitio):
    s = sitio(lote(1, "1"))
    assert s.sincronizar(hoja(spark)).count() == 0 and s.numero() == 1
    assert comparar(s.leer().limit(0), fichas(hoja(spark))).count() == 0
    assert Sitio(spark, s.base + "/otro").leer().count() == 0
