"""Tables of surfaces and coordinates as they are written."""

import math

import pytest
from pyspark.sql import functions as F

from predio.functions import lectura


def leer(spark, textos, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(textos)], "i int, t string")
    return [r.y for r in df.select("i", f(F.col("t")).alias("y")).orderBy("i").collect()]


def test_surfaces(spark):
    casos = {"5,00hás": 50000, "5,00 has": 50000, "0,52 ha": 5200, "5.000": 5000, "5.000 m²": 5000, "5.000,50 m2": 5000.5, "12.345.678": 12345678, "5,00": 50000, "5000": 5000, "abc": None, "": None, None: None, "1,2,3": None, "0": None, "12.5": 125000}
    assert leer(spark, list(casos), lectura.area_m2) == list(casos.values())


def test_rows_of_tables(spark):
    rapel = ".0\n8-01 1.342m2 5.000m2\n8-02 435 m2 5.000 m2\n8-02 4352 5.0002\n8-03 456m2 5.000m2\n8\ns 0.000m2 760.000m2\n0sa 0.000m2 760.000m2\n"
    casos = [
        ("1 10,00 0,00 10,00\n2 10,63 0,21 10,84\nTOTAL\n2 9,99\n202 222\n3 13,45 0,43 13,88\n", [["1", "10,00", "0,00", "10,00"], ["2", "10,63", "0,21", "10,84"], ["2", "9,99"], ["3", "13,45", "0,43", "13,88"]]),
        (rapel, [["8-01", "1.342m2", "5.000m2"], ["8-02", "435 m2", "5.000 m2"], ["8-03", "456m2", "5.000m2"], ["8", "0.000m2", "760.000m2"]]),
        ("8\no resto\nde la\npropiedad 0.000 m2 760.000 m2", [["8", "0.000 m2", "760.000 m2"]]),
        ("Resto de la propiedad 760.000 m2", [["Resto", "760.000 m2"]]), ("8\n8-04 474m2 5.000m2", [["8-04", "474m2", "5.000m2"]]), ("8 o resto 0.000 m2 760.000 m2", [["8", "0.000 m2", "760.000 m2"]]),
        ("8\na\nb\nc\n5.000", [["8", "5.000"]]), ("8\na\nb\nc\nd\n5.000", []), ("0 5.000", []), ("8\n\n5.000\n6.000", [["8", "5.000"]]), ("8\n12 x\n5.000", []), ("LOTE 12 : 5,00 hás", [["12", "5,00 hás"]]), ("", []), (None, []), ("7 .:\r\n1.234,5 m2", [["7", "1.234,5 m2"]]),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(casos)], "i int, t string").select("i", lectura.lineas_cuadro(F.col("t")).alias("l"))
    got = [[[f.lote, *f.celdas] for f in r.f] for r in df.select("i", lectura.filas_cuadro(F.col("l")).alias("f")).orderBy("i").collect()]
    for (t, want), g in zip(casos, got):
        assert g == want, t


def test_coordinates(spark):
    a, b = -(34 + 10 / 60 + 37.5 / 3600), -(71 + 32 / 60 + 53.89 / 3600)
    casos = {
        "-34.98, -71.24": (-34.98, -71.24), "-34,98 -71,24": (-34.98, -71.24), "-34,98; -71,24": (-34.98, -71.24), "34°10'37.50\"S 71°32'53.89\"W": (a, b), "S 34°10'37.5\" O 71°32'53.89\"": (a, b),
        "34º10’37,5”S, 71º32’53,89”O": (a, b), "71°32'53.89\"W 34°10'37.50\"S": (a, b), "34°10.625'S 71°W": (-(34 + 10.625 / 60), -71.0), "34 10' S 71 32' W": (-(34 + 10 / 60), -(71 + 32 / 60)),
        "-34° 10' -71° 32'": (-(34 + 10 / 60), -(71 + 32 / 60)), "-71.24, -34.98": (-71.24, -34.98), "-171.24, -34.98": (-34.98, -171.24), "34''S 7W": (-34 / 3600, -7.0), "-34° N 71 W": None, "34°60'S 71W": None, "34.5°10'S 71W": None,
        "34S": None, "34S 35S": None, "34S 71W 5": None, "91 N 5 W": None, "hola": None, "": None, None: None, "10°20'30\" 40°50'": (10 + 20 / 60 + 30 / 3600, 40 + 50 / 60), "34''S": None, "+34.5 +71.5": (34.5, 71.5), "34°-10' 71": None, "N S 3 4": None, "200, 300": None,
    }
    got = leer(spark, list(casos), lectura.coordenadas)
    for (t, want), g in zip(casos.items(), got):
        assert (g is None) == (want is None) and (g is None or tuple(g) == pytest.approx(want, abs=1e-9)), (t, g)
    assert math.isfinite(got[0].lat)


def test_small_files_are_read_by_several_tasks(spark):
    from predio.plans import catalog

    for name in ("coordenadas_escritas", "lotes_visibles"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.01").select(F.spark_partition_id()).distinct().count() > 1
