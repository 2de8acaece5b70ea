"""Outlines against outlines: overlap, agreement with the truth, what a picture shows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from predio.functions import espacio
from predio.plans.medidas import _lotes_geo
from predio.session import dealt

#: Side of a grid cell in metres: pairs of outlines are sought within cells.
CELDA = 50.0
#: Parts of a cell's outlines that meet the cell in different tasks.
PARTES = 16
#: About so many outlines of a cell meet so many others in one call, and about so many pairs are clipped at once.
BLOQUE, LOTE = 1000, 50_000
#: Least shared area in square metres.
TRAZA = 1e-6
#: Where a candidate lies against the truth in the test table: metres east and north.
CORRIDO = (3.0, -2.0)


def _caja(anillo: Column) -> dict[str, Column]:
    lado = lambda f, c: f(F.transform(anillo, lambda p: p[c]))
    return {"x0": lado(F.array_min, "x"), "x1": lado(F.array_max, "x"), "y0": lado(F.array_min, "y"), "y1": lado(F.array_max, "y")}


def _por_celdas(lotes: DataFrame, grupo: str, id: str, celda: float) -> DataFrame:  # noqa: A002
    """grupo, id, anillo and its bounds, under every cell that they touch."""
    c = lotes.select(F.col(grupo), F.col(id).alias("id"), "anillo").withColumns(_caja(F.col("anillo")))
    en = lambda v: F.floor(v / celda).cast("long")
    return c.withColumn("cx", F.explode(F.sequence(en(F.col("x0")), en(F.col("x1"))))).withColumn("cy", F.explode(F.sequence(en(F.col("y0")), en(F.col("y1")))))


def pares(lotes: DataFrame, grupo: str, id: str, celda: float = CELDA) -> DataFrame:  # noqa: A002
    """Pairs (a before b) of outlines of one group whose bounds meet: grupo, a, b, anillo_a, anillo_b.

    Outlines are listed under every cell that their bounds touch and a pair counts in one of them,
    that of the lower left corner of what their bounds share. A cell's outlines are dealt over PARTES tasks, each of
    which has all of the cell's others, so that a crowded cell isn't one task.
    """
    en = lambda v: F.floor(v / celda).cast("long")
    por = _por_celdas(lotes, grupo, id, celda)
    lado = lambda s, parte: por.select(grupo, "cx", "cy", *[F.col(x).alias(f"{x}_{s}") for x in ("id", "anillo", "x0", "x1", "y0", "y1")], parte.alias("parte"))
    clave = [grupo, "cx", "cy", "parte"]
    a = dealt(lado("a", F.pmod(F.xxhash64("id"), F.lit(PARTES)).cast("int")), *clave)
    b = dealt(lado("b", F.explode(F.sequence(F.lit(0), F.lit(PARTES - 1)))), *clave)
    j = a.join(b.hint("merge"), clave).where("id_a < id_b and x0_a <= x1_b and x0_b <= x1_a and y0_a <= y1_b and y0_b <= y1_a")
    suya = (en(F.greatest("x0_a", "x0_b")) == F.col("cx")) & (en(F.greatest("y0_a", "y0_b")) == F.col("cy"))
    return j.where(suya).select(grupo, F.col("id_a").alias("a"), F.col("id_b").alias("b"), "anillo_a", "anillo_b")


def _esquinas(anillos: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x and y of rings, a column each and padded, and how many corners they have."""
    n = pc.fill_null(pc.list_value_length(anillos), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    puntos, k = anillos.flatten(), np.arange(n.max(initial=0))[:, None]
    en = np.where(k < n, np.cumsum(n) - n + k, 0)
    x, y = (pc.fill_null(puntos.field(c).cast("double"), np.nan).to_numpy(zero_copy_only=False) for c in ("x", "y"))
    return (x[en], y[en], n) if len(x) else (np.zeros(en.shape), np.zeros(en.shape), n)


def _siguiente(v: np.ndarray, n: np.ndarray, pasos: int = 1) -> np.ndarray:
    """Each corner's value so many corners on."""
    k = np.arange(len(v))[:, None]
    return np.take_along_axis(v, np.where(k < n, (k + pasos) % np.maximum(n, 1), 0), 0)


def _signadas(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Areas with the sign of the turn, as espacio sums them."""
    v = np.where(np.arange(len(x))[:, None] < n, x * _siguiente(y, n) - _siguiente(x, n) * y, 0.0)
    suma = np.zeros(x.shape[1])
    for lado in v:
        suma += lado
    return suma / 2


def _planos(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """espacio.lados_convexos; sides that a ring hasn't leave everything inside."""
    giro, hay = np.sign(_signadas(x, y, n)), np.arange(len(x))[:, None] < n
    a, b = (np.where(hay, giro * v, 0.0) for v in (y - _siguiente(y, n), _siguiente(x, n) - x))
    return a, b, np.where(hay, -(a * x + b * y), 0.0)


def _convexos(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """espacio.es_convexo."""
    (x1, x2), (y1, y2) = ([_siguiente(v, n, p) for p in (1, 2)] for v in (x, y))
    giro = np.where(np.arange(len(x))[:, None] < n, (x1 - x) * (y2 - y1) - (y1 - y) * (x2 - x1), 0.0)
    return (n >= 3) & (_signadas(x, y, n) != 0) & ((giro >= 0).all(0) | (giro <= 0).all(0))


def _areas_recortadas(x: np.ndarray, y: np.ndarray, n: np.ndarray, planos: tuple[np.ndarray, ...]) -> np.ndarray:
    """espacio.area of what espacio.recortar leaves of each ring inside its half planes: the same steps, pair beside pair."""
    for a, b, c in zip(*planos):
        s = a * x + b * y + c
        dentro = s >= 0
        ultima = np.maximum(n - 1, 0)[None, :]
        px, py, ps, pd = (np.take_along_axis(v, ultima, 0)[0] for v in (x, y, s, dentro))
        qx, qy, m = np.zeros((2 * len(x), len(n))), np.zeros((2 * len(x), len(n))), np.zeros(len(n), np.int64)
        for k in range(len(x)):
            hay = k < n
            i = np.flatnonzero(hay & (dentro[k] != pd))
            t = ps[i] / (ps[i] - s[k, i])
            qx[m[i], i], qy[m[i], i] = px[i] + t * (x[k, i] - px[i]), py[i] + t * (y[k, i] - py[i])
            m[i] += 1
            i = np.flatnonzero(hay & dentro[k])
            qx[m[i], i], qy[m[i], i] = x[k, i], y[k, i]
            m[i] += 1
            px, py, ps, pd = x[k], y[k], s[k], dentro[k]
        ancho = max(int(m.max(initial=0)), 1)
        x, y, n = qx[:ancho], qy[:ancho], m
    return np.where(n < 3, 0.0, np.abs(_signadas(x, y, n)))


def _traslapes(x: np.ndarray, y: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """espacio.traslape of rings a[i] and b[i]: one clipped by the other if that is convex, else over the triangles of both."""
    total, convexo, hay = np.zeros(len(a)), _convexos(x, y, n), (n[a] >= 3) & (n[b] >= 3)
    planos = _planos(x, y, n)
    de = lambda i, por: _areas_recortadas(x[:, i], y[:, i], n[i], tuple(p[:, por] for p in planos))
    por_b, por_a = hay & convexo[b], hay & convexo[a] & ~convexo[b]
    total[por_b], total[por_a] = de(a[por_b], b[por_b]), de(b[por_a], a[por_a])
    resto = np.flatnonzero(hay & ~convexo[a] & ~convexo[b])

    def triangulos(i: np.ndarray):
        for k in range(1, int(n[i].max(initial=0)) - 1):
            tx, ty = x[:, i][[0, k, k + 1]], y[:, i][[0, k, k + 1]]
            tres = np.full(len(i), 3)
            yield tx, ty, tres, np.where(k + 1 < n[i], np.sign(_signadas(tx, ty, tres)), 0.0)

    if len(resto):
        suma = np.zeros(len(resto))
        for tx, ty, tres, s in triangulos(a[resto]):
            for hx, hy, _, h in triangulos(b[resto]):
                suma += s * h * np.where(s * h != 0, _areas_recortadas(tx, ty, tres, _planos(hx, hy, tres)), 0.0)
        total[resto] = np.abs(suma)
    return total


def solapes(lotes: DataFrame, grupo: str, id: str, celda: float = CELDA, bloque: int = BLOQUE) -> DataFrame:  # noqa: A002
    """Pairs of one group that share more than a trace, with the shared area: grupo, a (the lesser id), b, m2.

    The pairs are those of pares(). A cell's outlines are dealt into parts of about `bloque`, so many that none is larger
    however crowded the cell, and every two parts meet in a call of their own, where numpy clips many pairs at once.
    """
    por = dealt(_por_celdas(lotes, grupo, id, celda)).where(F.col(grupo).isNotNull() & F.col("id").isNotNull())
    cuantas = por.groupBy(grupo, "cx", "cy").agg(F.ceil(F.count("*") / bloque).cast("int").alias("partes"))
    con = por.join(cuantas, [grupo, "cx", "cy"]).withColumn("parte", F.pmod(F.xxhash64("id"), F.col("partes")).cast("int"))
    con = con.withColumn("otra", F.explode(F.sequence(F.lit(0), F.col("partes") - 1)))
    con = con.withColumns({"i": F.least("parte", "otra"), "j": F.greatest("parte", "otra")}).drop("otra", "partes")

    def cruzar(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = lambda c: t[c].to_numpy()
        lista = t["anillo"].combine_chunks() if t["anillo"].num_chunks != 1 else t["anillo"].chunk(0)
        x, y, n = _esquinas(lista)
        orden = pc.rank(t["id"], tiebreaker="dense").to_numpy()
        x0, x1, y0, y1, cx, cy, parte = (col(c) for c in ("x0", "x1", "y0", "y1", "cx", "cy", "parte"))
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        u, v = np.flatnonzero(parte == i), np.flatnonzero(parte == j)
        a, b, m2 = [], [], []
        for desde in range(0, len(u), max(1, LOTE // max(len(v), 1))):
            w = u[desde : desde + max(1, LOTE // max(len(v), 1))][:, None]
            suya = (np.floor(np.maximum(x0[w], x0[v]) / celda) == cx[0]) & (np.floor(np.maximum(y0[w], y0[v]) / celda) == cy[0])
            toca = suya & (x0[w] <= x1[v]) & (x0[v] <= x1[w]) & (y0[w] <= y1[v]) & (y0[v] <= y1[w])
            r, s = np.nonzero(toca & ((orden[w] < orden[v]) if i == j else (orden[w] != orden[v])))
            p, q = w[r, 0], v[s]
            p, q = np.where(orden[p] < orden[q], p, q), np.where(orden[p] < orden[q], q, p)
            with np.errstate(all="ignore"):
                comun = _traslapes(x, y, n, p, q)
            queda = comun > TRAZA
            a.append(p[queda])
            b.append(q[queda])
            m2.append(comun[queda])
        a, b, m2 = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b, m2))
        return pa.table({grupo: t[grupo].take(pa.array(a)), "a": t["id"].take(pa.array(a)), "b": t["id"].take(pa.array(b)), "m2": pa.array(m2, pa.float64())})

    tipos = con.schema
    salida = T.StructType([T.StructField(grupo, tipos[grupo].dataType), T.StructField("a", tipos["id"].dataType), T.StructField("b", tipos["id"].dataType), T.StructField("m2", T.DoubleType())])
    clave = [grupo, "cx", "cy", "i", "j"]
    return dealt(con, *clave).groupBy(*clave).applyInArrow(cruzar, salida)


def comparar(candidato: DataFrame, real: DataFrame, clave: list[str]) -> DataFrame:
    """Per lot of both sides (`clave`, anillo): iou, dx, dy, d (between the centres), hd, corners and areas of both."""
    j = candidato.select(*clave, F.col("anillo").alias("a")).join(real.select(*clave, F.col("anillo").alias("b")), clave)
    a, b = F.col("a"), F.col("b")
    j = j.select(*clave, "a", "b", espacio.centroide(a).alias("ca"), espacio.centroide(b).alias("cb"))
    dx, dy = F.col("cb.x") - F.col("ca.x"), F.col("cb.y") - F.col("ca.y")
    return j.select(*clave, espacio.iou(a, b).alias("iou"), dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("d"), espacio.hausdorff(a, b).alias("hd"), F.size("a").alias("vertices"), F.size("b").alias("vertices_real"), espacio.area(a).alias("area"), espacio.area(b).alias("area_real"))


def resumen(por_lote: DataFrame, grupo: list[str]) -> DataFrame:
    """The figures of each drawing: medians, tails and means of comparar()'s."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    error = F.abs(F.col("area") / F.col("area_real") - 1) * 100
    return por_lote.groupBy(*grupo).agg(
        F.count("*").alias("n"), q("iou", 0.5).alias("iou_mediana"), q("iou", 0.1).alias("iou_p10"), F.min("iou").alias("iou_min"), q("d", 0.5).alias("centroide_mediana_m"), q("d", 0.9).alias("centroide_p90_m"),
        F.max("d").alias("centroide_max_m"), q("hd", 0.5).alias("hausdorff_mediana_m"), q("hd", 0.1).alias("hausdorff_p10_m"), q("hd", 0.9).alias("hausdorff_p90_m"), F.max("hd").alias("hausdorff_max_m"),
        F.avg("dx").alias("dx_medio_m"), F.avg("dy").alias("dy_medio_m"), q("vertices", 0.5).alias("vertices_mediana"), q("vertices_real", 0.5).alias("vertices_real_mediana"), q(error, 0.5).alias("error_area_mediana_pct"),
    )


def _movidos(lotes: DataFrame) -> DataFrame:
    mueve = lambda p: F.struct((p["x"] + CORRIDO[0]).alias("x"), (p["y"] + CORRIDO[1]).alias("y"))
    return lotes.withColumn("anillo", F.transform("anillo", mueve))


def solapes_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of one drawing that overlap, and by how much."""
    return solapes(_lotes_geo(spark, sf_dir), "label", "vec_id").select("label", "a", "b", F.round("m2", 4).alias("m2"))


def metricas_por_lote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved outlines against the true ones."""
    g = _lotes_geo(spark, sf_dir)
    m = comparar(_movidos(g), g, ["vec_id", "label"])
    return m.select("vec_id", F.round("iou", 6).alias("iou"), F.round("dx", 4).alias("dx"), F.round("dy", 4).alias("dy"), F.round("area", 3).alias("area"), F.round("area_real", 3).alias("area_real"), "vertices")


def metricas_de_dibujos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures, drawing by drawing."""
    g = _lotes_geo(spark, sf_dir)
    r = resumen(comparar(_movidos(g), g, ["vec_id", "label"]), ["label"])
    return r.select("label", "n", *[F.round(c, 6).alias(c) for c in ("iou_mediana", "iou_p10", "iou_min", "centroide_mediana_m", "centroide_p90_m", "dx_medio_m", "dy_medio_m", "vertices_mediana", "error_area_mediana_pct")])


def centros_visibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the label of an outline stands in a picture of 120 by 90 with a margin of 10; null if it is out of sight."""
    g = _lotes_geo(spark, sf_dir)
    c = espacio.centro_visible(F.col("anillo"), F.lit(120.0), F.lit(90.0), 10.0)
    return g.select("vec_id", c.alias("c")).select("vec_id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


# a parallelogram against itself moved: along its sides u = (2a, 10) and v = (0, 2b) the move is (s, t), and (1 - |s|)(1 - |t|) of it is shared
_MOVIDO = f"""
  SELECT vec_id, label, 4 * a * b AS area, CASE WHEN abs(s) < 1 AND abs(t) < 1 THEN (1 - abs(s)) * (1 - abs(t)) ELSE 0 END AS f FROM (
    SELECT *, {CORRIDO[0]} / (2 * a) AS s, ({CORRIDO[1]} - 10 * {CORRIDO[0]} / (2 * a)) / (2 * b) AS t FROM (
      SELECT vec_id, label, 10 + 40 * abs(CAST(embedding[3] AS DOUBLE)) AS a, 10 + 40 * abs(CAST(embedding[4] AS DOUBLE)) AS b FROM embeddings))"""
QUERIES = {f.__name__: f for f in (solapes_de_lotes, metricas_por_lote, metricas_de_dibujos, centros_visibles)}
ORACLES = {
    "metricas_por_lote": f"""
  SELECT vec_id, round(f / (2 - f), 6) AS iou, {-CORRIDO[0]}::DOUBLE AS dx, {-CORRIDO[1]}::DOUBLE AS dy, round(area, 3) AS area, round(area, 3) AS area_real, 4 AS vertices FROM ({_MOVIDO})""",
    "metricas_de_dibujos": f"""
  SELECT label, count(*) AS n, round(quantile_cont(iou, 0.5), 6) AS iou_mediana, round(quantile_cont(iou, 0.1), 6) AS iou_p10, round(min(iou), 6) AS iou_min,
         round(sqrt(13.0), 6) AS centroide_mediana_m, round(sqrt(13.0), 6) AS centroide_p90_m, {-CORRIDO[0]}::DOUBLE AS dx_medio_m, {-CORRIDO[1]}::DOUBLE AS dy_medio_m, 4.0::DOUBLE AS vertices_mediana, 0.0::DOUBLE AS error_area_mediana_pct
  FROM (SELECT label, f / (2 - f) AS iou FROM ({_MOVIDO})) GROUP BY label""",
}
