"""Clipping, overlap, centres and distances of outlines against plain Python by other means."""

import math
import random

import pytest
from pyspark.sql import functions as F

from predio.functions import espacio
from predio.plans import recortes

ESQUEMA = "id int, g int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>"


def area(ps):
    return abs(sum(x * v - u * y for (x, y), (u, v) in zip(ps, ps[1:] + ps[:1]))) / 2 if len(ps) > 2 else 0.0


def dentro(ps, x, y):
    return sum(((y1 > y) != (y2 > y)) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in zip(ps, ps[1:] + ps[:1])) % 2 == 1


def comun(a, b):
    """Shared area by horizontal strips: between all heights at which something changes both rings are trapezoids."""
    lados = [list(zip(r, r[1:] + r[:1])) for r in (a, b)]
    ys = {y for r in (a, b) for _, y in r}
    for (p, q) in lados[0]:
        for (r, s) in lados[1]:
            d = (q[0] - p[0]) * (s[1] - r[1]) - (q[1] - p[1]) * (s[0] - r[0])
            if d:
                t = ((r[0] - p[0]) * (s[1] - r[1]) - (r[1] - p[1]) * (s[0] - r[0])) / d
                if 0 <= t <= 1:
                    ys.add(p[1] + t * (q[1] - p[1]))
    ys, total = sorted(ys), 0.0
    for y0, y1 in zip(ys, ys[1:]):
        m = (y0 + y1) / 2
        cortes = [sorted(p[0] + (m - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in ls if (p[1] > m) != (q[1] > m)) for ls in lados]
        tramos = [list(zip(c[::2], c[1::2])) for c in cortes]
        total += (y1 - y0) * sum(max(0.0, min(u[1], v[1]) - max(u[0], v[0])) for u in tramos[0] for v in tramos[1])
    return total


def estrella(draw, n, cx, cy, r):
    """A simple ring, as a rule not convex."""
    return [(cx + draw.uniform(0.3, 1) * r * math.cos(2 * math.pi * k / n), cy + draw.uniform(0.3, 1) * r * math.sin(2 * math.pi * k / n)) for k in range(n)]


@pytest.fixture(scope="module")
def anillos(spark):
    draw = random.Random(4)
    filas = []
    for i in range(60):
        a, b = (estrella(draw, draw.randint(3, 9), draw.uniform(0, 40), draw.uniform(0, 40), draw.uniform(5, 40)) for _ in range(2))
        filas.append((i, i % 2, a[::-1] if i % 3 == 0 else a, b))
    q = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    filas += [(100, 0, q, q), (101, 0, q, [(x + 10, y) for x, y in q]), (102, 0, q, [(x + 5, y) for x, y in q]), (103, 0, q, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0)]), (104, 0, q, [(50.0, 50.0), (60.0, 50.0), (60.0, 60.0)]), (105, 0, q, q[:2]), (106, 0, [], q), (107, 0, q[:1] * 4, q)]
    return filas, spark.createDataFrame(filas, ESQUEMA)


def test_overlap_and_iou(anillos):
    filas, df = anillos
    got = {r.id: r for r in df.select("id", espacio.traslape(F.col("a"), F.col("b")).alias("m2"), espacio.iou(F.col("a"), F.col("b")).alias("iou")).collect()}
    for i, _, a, b in filas:
        want = comun(a, b) if len(a) > 2 and len(b) > 2 else 0.0
        assert got[i].m2 == pytest.approx(want, abs=1e-6)
        junta = area(a) + area(b) - want
        assert got[i].iou == pytest.approx(want / junta, abs=1e-9) if junta else got[i].iou is None
    assert got[100].iou == pytest.approx(1) and got[102].iou == pytest.approx(1 / 3)


def test_centres(anillos):
    filas, df = anillos
    got = {r.id: r.c for r in df.select("id", espacio.centroide(F.col("a")).alias("c")).collect()}
    for i, _, a, _ in filas:
        if area(a) > 1e-9:
            d = sum(x * v - u * y for (x, y), (u, v) in zip(a, a[1:] + a[:1]))
            cx = sum((x + u) * (x * v - u * y) for (x, y), (u, v) in zip(a, a[1:] + a[:1])) / (3 * d)
            cy = sum((y + v) * (x * v - u * y) for (x, y), (u, v) in zip(a, a[1:] + a[:1])) / (3 * d)
            assert (got[i].x, got[i].y) == pytest.approx((cx, cy), abs=1e-6)
    assert got[106].x is None and (got[107].x, got[107].y) == (0.0, 0.0)
    vistos = {r.id: r.c for r in df.select("id", espacio.centro_visible(F.col("a"), F.lit(30.0), F.lit(25.0), 5.0).alias("c")).collect()}
    marco = [(5.0, 5.0), (25.0, 5.0), (25.0, 20.0), (5.0, 20.0)]
    for i, _, a, _ in filas:
        m2 = comun(a, marco) if len(a) > 2 else 0.0
        assert (vistos[i] is None) == (m2 < 5e-7)
        if vistos[i] is not None:
            assert 5 <= vistos[i].x <= 25 and 5 <= vistos[i].y <= 20
    assert (vistos[100].x, vistos[100].y) == pytest.approx((7.5, 7.5))


def test_hausdorff(anillos):
    filas, df = anillos

    def a_lado(p, q, r):
        dx, dy = r[0] - q[0], r[1] - q[1]
        t = max(0, min(1, ((p[0] - q[0]) * dx + (p[1] - q[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.dist(p, (q[0] + t * dx, q[1] + t * dy))

    def lejos(a, b):
        densos = [(p[0] + (q[0] - p[0]) * k / 20, p[1] + (q[1] - p[1]) * k / 20) for p, q in zip(a, a[1:] + a[:1]) for k in range(20)]
        return max(min(a_lado(p, q, r) for q, r in zip(b, b[1:] + b[:1])) for p in densos)

    got = {r.id: r.h for r in df.select("id", espacio.hausdorff(F.col("a"), F.col("b")).alias("h")).collect()}
    for i, _, a, b in filas:
        if a and b:
            assert got[i] == pytest.approx(max(lejos(a, b), lejos(b, a)), abs=1e-9)


def test_pairs_count_once(spark, anillos):
    filas, df = anillos
    lotes = df.select("id", "g", F.col("a").alias("anillo")).where("size(a) > 0")
    for celda in (3.0, 50.0, 1000.0):
        got = sorted((r.a, r.b) for r in recortes.pares(lotes, "g", "id", celda).collect())
        caja = {i: [f(v) for v in zip(*a) for f in (min, max)] for i, _, a, _ in filas if a}
        grupo = {i: g for i, g, _, _ in filas}
        want = sorted((i, j) for i in caja for j in caja if i < j and grupo[i] == grupo[j] and caja[i][0] <= caja[j][1] and caja[j][0] <= caja[i][1] and caja[i][2] <= caja[j][3] and caja[j][2] <= caja[i][3])
        assert got == want


def test_overlaps_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    from predio.plans.medidas import _lotes_geo

    rows = [(r.vec_id, r.label, [tuple(p) for p in r.anillo]) for r in _lotes_geo(spark, sf).where("label < 2").collect()]
    want = {(g, i, j): round(comun(a, b), 4) for i, g, a in rows for j, h, b in rows if i < j and g == h}
    want = {k: v for k, v in want.items() if v > 1e-4}
    got = {(r.label, r.a, r.b): r.m2 for r in recortes.solapes_de_lotes(spark, sf).where("label < 2 and m2 > 1e-4").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-4) for k in want) and want


def test_a_crowded_cell_is_not_one_task(spark):
    anillo = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 9D, 'y', 0D), named_struct('x', 9D, 'y', 9D), named_struct('x', 0D, 'y', 9D))")
    p = recortes.pares(spark.range(0, 100, 1, 1).select("id", (F.col("id") % 1).alias("g"), anillo.alias("anillo")), "g", "id")
    por_tarea = [r["count"] for r in p.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(por_tarea) == 4950 and max(por_tarea) < 2500


def test_overlaps_in_blocks_are_those_of_the_pairs(spark, anillos):
    """Rings of any shape, cells and parts of any size, ids as texts, lots without group or id."""
    filas, df = anillos
    lotes = df.select("id", "g", F.col("a").alias("anillo")).unionByName(df.select(F.col("id") + 1000, "g", "b").toDF("id", "g", "anillo"))
    lotes = lotes.select(F.concat(F.lit("n"), "id").alias("id"), "g", "anillo")
    lotes = lotes.unionByName(lotes.limit(5).withColumn("g", F.lit(None).cast("int"))).unionByName(lotes.limit(5).withColumn("id", F.lit(None).cast("string")))
    junto = recortes.pares(lotes, "g", "id").select("g", "a", "b", espacio.traslape(F.col("anillo_a"), F.col("anillo_b")).alias("m2")).where("m2 > 1e-6")
    want = {(r.g, r.a, r.b): r.m2 for r in junto.collect()}
    for celda, bloque in ((50.0, 1000), (7.0, 3), (1000.0, 10)):
        rows = recortes.solapes(lotes, "g", "id", celda, bloque).collect()
        got = {(r.g, r.a, r.b): r.m2 for r in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert recortes.solapes(lotes.where("false"), "g", "id").count() == 0


def test_a_crowded_drawing_in_time(spark):
    """Two million pairs in one place: a call clips many, and none has more than a block's."""
    import time

    e = lambda i: F.rand(i) * 20
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lotes = spark.range(2000).select("id", F.lit(1).alias("g"), e(1).alias("x"), e(2).alias("y"))
    x, y = F.col("x"), F.col("y")
    lotes = lotes.select("id", "g", F.array(p(x, y), p(x + 40, y + 5), p(x + 40, y + 45), p(x, y + 40)).alias("anillo"))
    desde = time.monotonic()
    assert recortes.solapes(lotes, "g", "id").count() == 2000 * 1999 // 2
    assert time.monotonic() - desde < 60
