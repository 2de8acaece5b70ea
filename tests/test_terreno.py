"""Heights over seams and edges, horizons, against plain Python."""

import math

import pytest
from pyspark.sql import functions as F

from predio.functions import espacio
from predio.plans import terreno

SF = "/root/testdata/sf0.001"


def a_mano(spark):
    """Pixel of the world -> height, and their bounds."""
    px = {}
    for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect():
        tx, ty = terreno._TX + r.vec_id % terreno._ANCHO, terreno._TY + r.vec_id // terreno._ANCHO
        for k, e in enumerate(r.embedding):
            alto = 128 * 256 + math.floor((e + 0.1) * 300) + math.floor(abs(e) * 255) / 256 - 32768
            px[tx * 8 + k % 8, ty * 8 + k // 8] = max(alto, 0.0)
    return px, [f(k[i] for k in px) for i in (0, 1) for f in (min, max)]


def cota(px, borde, x, y):
    x0, x1, y0, y1 = borde
    x, y = min(max(x - 0.5, x0), x1), min(max(y - 0.5, y0), y1)
    j, i = int(x), int(y)
    fj, fi = x - j, y - i
    j2, i2 = min(j + 1, x1), min(i + 1, y1)
    return px[j, i] * (1 - fi) * (1 - fj) + px[j2, i] * (1 - fi) * fj + px[j, i2] * fi * (1 - fj) + px[j2, i2] * fi * fj


def global_(lon, lat):
    n = 8 * 2**14
    r = math.radians(lat)
    return (lon + 180) / 360 * n, (1 - math.log(math.tan(r) + 1 / math.cos(r)) / math.pi) / 2 * n


def test_heights_over_seams_and_edges(spark):
    px, borde = a_mano(spark)
    puntos = {r.c_custkey: (r.lon, r.lat) for r in terreno._puntos(spark, SF).collect()}
    got = {r.c_custkey: r.cota for r in terreno.cotas_de_puntos(spark, SF).collect()}
    assert got.keys() == puntos.keys()
    for k, p in puntos.items():
        assert got[k] == pytest.approx(cota(px, borde, *global_(*p)), abs=1e-4)


def test_missing_tiles_and_coordinates(spark):
    m = terreno._mosaico(spark, SF)
    hueco = m.where(~((F.col("tx") == terreno._TX + 3) & (F.col("ty") == terreno._TY + 3)))
    mundo = F.lit(float(8 * 2**14))
    en = lambda x, y: espacio.coordenada(F.lit((terreno._TX + x) * 8.0), F.lit((terreno._TY + y) * 8.0), mundo)
    filas = spark.range(4).select("id", F.lit("m").alias("mosaico"), F.lit(14).alias("zoom"), F.element_at(F.array(en(3.5, 3.5), en(2.97, 3.5), en(1.5, 1.5), F.lit(None)), (F.col("id") + 1).cast("int")).alias("p")).select("id", "mosaico", "zoom", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
    got = {r.id: r.cota for r in terreno.cotas_en(filas, hueco, ["id"], 8).collect()}
    assert got[0] is None and got[1] is None and got[2] is not None and got[3] is None
    assert all(r.cota is None for r in terreno.cotas_en(filas, m.where("false"), ["id"], 8).collect())


def test_horizons(spark):
    px, borde = a_mano(spark)
    anillos = ((14, 150.0, 1500.0, 60.0), (14, 1500.0, 6000.0, 300.0))
    v = terreno._puntos(spark, SF).where("c_custkey in (7, 60)").withColumn("altura", F.lit(30.0)).drop("zoom")
    vistas = {r.c_custkey: (r.lon, r.lat) for r in v.collect()}
    got = {(r.c_custkey, r.azimut): (r.elevacion, r.distancia) for r in terreno.horizonte(v, terreno._mosaico(spark, SF), "c_custkey", anillos, 30.0, 8).collect()}
    assert len(got) == 24
    for (k, az), (e, d) in got.items():
        lon, lat = vistas[k]
        mejor, lejos = -90.0, 0.0
        for _, desde, hasta, paso in anillos:
            n = math.ceil((hasta - desde) / paso)
            for dist in (desde + paso * i for i in range(n)):
                a = math.radians(az)
                p = lon + math.sin(a) * dist / (111_320 * math.cos(math.radians(lat))), lat + math.cos(a) * dist / 111_320
                angulo = math.degrees(math.atan2(cota(px, borde, *global_(*p)) - dist**2 / (2 * 6371000) * 0.87 - 30, dist))
                if angulo > mejor + 1e-12:
                    mejor, lejos = angulo, dist
        assert e == pytest.approx(mejor, abs=1e-6) and d == pytest.approx(lejos)


def test_decoding_and_there_and_back(spark):
    r = spark.range(1).select(*[terreno.decodificar(*map(F.lit, c)).alias(n) for n, c in (("a", (128, 0, 0)), ("b", (131, 232, 128)), ("c", (120, 0, 0)))], espacio.coordenada(espacio.pixel_global(F.lit(-72.3), F.lit(-34.7), F.lit(4096.0))["x"], espacio.pixel_global(F.lit(-72.3), F.lit(-34.7), F.lit(4096.0))["y"], F.lit(4096.0)).alias("p")).first()
    assert (r.a, r.b, r.c) == (0.0, 1000.5, 0.0) and tuple(r.p) == pytest.approx((-72.3, -34.7))


def test_points_are_not_broadcast(spark):
    """Their number grows with views, directions and steps; only the mosaics' bounds may go round."""
    for q in (terreno.horizontes, terreno.cotas_de_puntos):
        plan = q(spark, "/root/testdata/check_l")._jdf.queryExecution().executedPlan().toString()
        assert "BuildLeft" not in plan and "BuildRight" in plan
