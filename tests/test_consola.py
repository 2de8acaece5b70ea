"""Labels in lots: counted by strips, as the plain rule counts them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from predio.functions import espacio
from predio.plans import consola
from predio.plans.medidas import _lotes_geo

SF = "/root/testdata/sf0.001"


def dentro(anillo, x, y):
    cruces = 0
    for (ax, ay), (bx, by) in zip(anillo, anillo[1:] + anillo[:1]):
        cruces += (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay)
    return cruces % 2 == 1


def test_counts_on_edges_and_copies(monkeypatch):
    monkeypatch.setattr(consola, "PRUEBAS", 50)  # several groups of lots
    draw = np.random.default_rng(3)
    puntos = draw.integers(-12, 12, (400, 2)).astype(float)  # many on edges and corners, many in one place
    lotes = [[(x - w, y - h - d), (x + w, y - h + d), (x + w, y + h + d), (x - w, y + h - d)] for x, y, w, h, d in zip(*(draw.integers(a, b, 60).astype(float) for a, b in ((-12, 12), (-12, 12), (1, 9), (1, 9), (0, 6))))]
    tabla = pa.table({f"{c}{i}": [lote[i][k] for lote in lotes] for k, c in enumerate("xy") for i in range(4)})
    got = consola._cuantos(tabla, pa.table({"px": puntos[:, 0], "py": puntos[:, 1]}))
    assert got.tolist() == [sum(dentro(lote, *p) for p in puntos) for lote in lotes] and got.max() > 50


def test_rows_without_a_place_and_copies(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    nulo = F.transform("embedding", lambda x, i: F.when(i != 4, x))
    raro = F.transform("embedding", lambda x, i: F.when(F.col("vec_id") % 2 == i % 2, F.lit("NaN").cast("float")).otherwise(x))
    mas = e.withColumn("embedding", nulo).unionByName(e.withColumn("embedding", raro)).unionByName(e.withColumn("label", F.lit(None).cast("int"))).withColumn("vec_id", F.col("vec_id") + 1000)
    e.unionByName(e.where("vec_id % 3 = 0")).unionByName(mas).write.parquet(f"{tmp_path}/embeddings.parquet")
    g = _lotes_geo(spark, str(tmp_path))
    par = g.select("vec_id", "label", "anillo").join(g.select("label", "px", "py"), "label").where(espacio.contiene(F.col("anillo"), F.col("px"), F.col("py")))
    want = {(r.vec_id, r.n, r.n == 1) for r in par.groupBy("vec_id").agg(F.count("*").alias("n")).collect()}
    got = consola.rotulos_en_lotes(spark, str(tmp_path)).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 20
