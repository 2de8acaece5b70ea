"""Lots as views see them, runs of neighbouring lots, flights by height, numbering against the truth, one queue's times."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.plans.planos import _DENTRO, _LOTES, _ROTULOS, _lotes, _rotulos, cercanos, dentro
from predio.session import dealt, table

#: Farthest metres, least width in degrees, least area in square degrees, least degrees below the horizon,
#: most that one lot adds to a view's merit, most lots of a run and metres between its neighbours, decimetres from a
#: flight's mean height, minutes after which a job is stopped.
LEJOS_M, ANCHO_MIN, AREA_MIN, BAJO_MIN, MERITO_MAX, TIRA_MAX, TIRA_M, VUELO_DM, CORTE_MIN = 2000, 0.8, 0.6, 1.5, 50, 12, 120, 30, 45


def _vistas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views: vista, plano, px, py, alto (metres above flat ground)."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("vista"), F.floor(k / 20).alias("plano"), (k * 71 % 997 + 0.5).alias("px"), (k * 83 % 991 + 0.25).alias("py"), (30.0 + k % 5 * 20).alias("alto")
    )


def lotes_visibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots (four corners) that each view shows: within LEJOS_M, not too narrow, small or near the horizon. The area is the
    outline's on the plane across the line of sight to its centre; on flat ground corners alone give it and the width."""
    alto, cx, cy = F.col("alto"), F.col("cx"), F.col("cy")
    esquinas = [(F.col("x") + i * F.col("w") - F.col("px"), F.col("y") + j * F.col("h") - F.col("py")) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
    norma = lambda x, y: F.sqrt(x * x + y * y + alto * alto)
    par = cercanos(dealt(_lotes(spark, sf_dir), "lote"), _vistas(spark, sf_dir), LEJOS_M).select("vista", "lote", "x", "y", "w", "h", "px", "py", "alto").withColumns({"cx": F.col("x") - F.col("px"), "cy": F.col("y") - F.col("py")})
    par = par.withColumn("lejos", norma(cx, cy)).withColumns({"metros": F.round("lejos", 1), "elevacion": F.round(F.degrees(F.asin(-alto / F.col("lejos"))), 3)})
    par = par.where((F.col("metros") <= LEJOS_M) & (F.col("elevacion") <= -BAJO_MIN))
    for n, (x, y) in enumerate(esquinas):
        par = par.withColumns({f"x{n}": x, f"y{n}": y}).withColumns({f"n{n}": norma(F.col(f"x{n}"), F.col(f"y{n}")), f"p{n}": F.col(f"x{n}") * cx + F.col(f"y{n}") * cy + alto * alto})
    par = par.select("vista", "lote", F.inline(F.array(F.struct(*par.columns[par.columns.index("alto") :]))))  # computed once: no plan inlines through it
    v = lambda c, n: F.col(f"{c}{n % 4}")
    coseno = F.least(F.lit(1.0), *[v("p", n) / (v("n", n) * F.col("lejos")) for n in range(4)])
    cruz = [alto * (v("y", n + 1) - v("y", n)) * cx + alto * (v("x", n) - v("x", n + 1)) * cy - alto * (v("x", n) * v("y", n + 1) - v("x", n + 1) * v("y", n)) for n in range(4)]
    suma = sum((F.col("lejos") * c / (v("p", n) * v("p", n + 1)) for n, c in enumerate(cruz)), F.lit(0.0))
    delante = F.least(*[v("p", n) - 1e-6 * F.col("lejos") * v("n", n) for n in range(4)]) > 0
    area = F.when(delante, F.abs(suma) / 2 * (180 / math.pi) ** 2).otherwise(0.0)
    par = par.select("vista", "lote", "metros", "elevacion", F.round(2 * F.degrees(F.acos(coseno)), 3).alias("ancho"), F.round(area, 3).alias("area"))
    return par.where((F.col("ancho") >= ANCHO_MIN) & (F.col("area") >= AREA_MIN))


def puntaje_encuadre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merit of each view that shows a lot: the areas of what it shows, each counted up to MERITO_MAX."""
    return lotes_visibles(spark, sf_dir).groupBy("vista").agg(F.count("*").alias("lotes"), F.round(F.sum(F.least("area", F.lit(float(MERITO_MAX)))), 3).alias("puntaje"))


def tiras_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each drawing's lots in order of number: a new one after TIRA_MAX lots or more than TIRA_M metres from the one before; centre and box."""
    w = Window.partitionBy("plano").orderBy("lote")
    salta = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) > TIRA_M
    p = _lotes(spark, sf_dir).withColumn("tramo", F.count_if(F.coalesce(salta, F.lit(False))).over(w))
    orden = F.row_number().over(Window.partitionBy("plano", "tramo").orderBy("lote"))
    g = p.withColumn("parte", F.floor((orden - 1) / TIRA_MAX)).groupBy("plano", "tramo", "parte")
    return g.agg(
        F.min("lote").alias("desde"), F.max("lote").alias("hasta"), F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("cx"), F.round(F.avg("y"), 4).alias("cy"),
        F.min("x").alias("oeste"), F.max("x").alias("este"), F.min("y").alias("sur"), F.max("y").alias("norte"),
    ).drop("tramo", "parte")


def vuelos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights of each drawing: its distinct heights from low to high, in one flight while within VUELO_DM of the flight's mean so far.
    The order decides, so a drawing's distinct heights (decimetres) are folded together."""
    k = F.col("p_partkey")
    alturas = table(spark, sf_dir, "part").select(F.floor(k / 400).alias("plano"), (k * k % 1009).alias("dm"))
    g = alturas.groupBy("plano", "dm").agg(F.count("*").alias("n")).groupBy("plano").agg(F.array_sort(F.collect_list(F.struct("dm", "n"))).alias("a"))
    nuevo = lambda v: F.struct(v["dm"].alias("desde"), v["dm"].alias("hasta"), (v["dm"] * v["n"]).alias("suma"), v["n"].alias("n"))

    def suma(hay: Column, v: Column) -> Column:
        u = F.element_at(hay, -1)
        crece = F.struct(u["desde"].alias("desde"), v["dm"].alias("hasta"), (u["suma"] + v["dm"] * v["n"]).alias("suma"), (u["n"] + v["n"]).alias("n"))
        cerca = v["dm"] * u["n"] - u["suma"] <= VUELO_DM * u["n"]
        return F.when(cerca, F.concat(F.slice(hay, 1, F.size(hay) - 1), F.array(crece))).otherwise(F.concat(hay, F.array(nuevo(v))))

    v = g.select("plano", F.explode(F.aggregate(F.slice("a", 2, F.size("a")), F.array(nuevo(F.col("a")[0])), suma)).alias("v"))
    return v.select("plano", (F.col("v.desde") / 10).alias("desde"), (F.col("v.hasta") / 10).alias("hasta"), "v.n", F.round(F.col("v.suma") / F.col("v.n") / 10, 4).alias("media"))


def numeracion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read in each drawing against the true ones: right, wrong, none (no label of its own), and recall."""
    lotes = _lotes(spark, sf_dir)
    leido = dentro(lotes, _rotulos(spark, sf_dir)).groupBy("lote").agg(F.count("*").alias("n"), F.min("rotulo").alias("rotulo")).where("n = 1")
    bien = F.col("rotulo") % 5 == F.col("lote") % 5
    g = lotes.select("lote", "plano").join(leido, "lote", "left").groupBy("plano")
    return g.agg(F.count_if(bien).alias("bien"), F.count_if(~bien).alias("mal"), F.count_if(F.col("rotulo").isNull()).alias("sin"), F.round(F.count_if(bien) / F.count("*"), 6).alias("recuperado"))


def cola_de_un_cupo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute at which each job of a user's queue starts and ends if one runs at a time, in order of arrival, and is stopped
    after CORTE_MIN. A start is the latest of all earlier arrivals plus the work between, so running sums and maxima give it."""
    w = Window.partitionBy("user_id").orderBy("llega", "event_id")
    pide = F.pmod("event_id", F.lit(60)) + 1
    t = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("llega"), F.least(pide, F.lit(CORTE_MIN)).alias("dura"), (pide > CORTE_MIN).alias("cortado"))
    t = t.withColumn("antes", F.sum("dura").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("dura"))
    t = t.withColumn("empieza", F.max(F.col("llega") - F.col("antes")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("antes"))
    return t.select("event_id", "empieza", (F.col("empieza") + F.col("dura")).alias("termina"), "cortado")


_VISTAS = """vistas AS (SELECT s_suppkey AS vista, s_suppkey // 20 AS plano, s_suppkey * 71 % 997 + 0.5::DOUBLE AS px, s_suppkey * 83 % 991 + 0.25::DOUBLE AS py,
  30.0::DOUBLE + s_suppkey % 5 * 20 AS z FROM supplier)"""
_VISIBLES = f"""
  WITH {_LOTES}, {_VISTAS}, q(i, sx, sy, ux, uy) AS (VALUES (1, -1, -1, 1, -1), (2, 1, -1, 1, 1), (3, 1, 1, -1, 1), (4, -1, 1, -1, -1)),
  c AS (SELECT vista, lote, z, x - px AS cx, y - py AS cy, x - px + sx * w AS ax, y - py + sy * h AS ay, x - px + ux * w AS ex, y - py + uy * h AS ey,
    sqrt((x - px) ** 2 + (y - py) ** 2 + z * z) AS d FROM lotes JOIN vistas USING (plano), q),
  s AS (SELECT *, ax * cx + ay * cy + z * z AS pa, ex * cx + ey * cy + z * z AS pb FROM c),
  v AS (SELECT vista, lote, round(any_value(d), 1) AS metros, round(degrees(asin(-any_value(z / d))), 3) AS elevacion,
    round(2 * max(degrees(acos(least(1.0, pa / (sqrt(ax * ax + ay * ay + z * z) * d))))), 3) AS ancho,
    round(CASE WHEN bool_or(pa <= 1e-6 * d * sqrt(ax * ax + ay * ay + z * z)) THEN 0.0
      ELSE abs(sum(d * (z * (ey - ay) * cx + z * (ax - ex) * cy - z * (ax * ey - ex * ay)) / (pa * pb))) / 2 * (180 / pi()) ** 2 END, 3) AS area FROM s GROUP BY vista, lote),
  visibles AS (SELECT * FROM v WHERE metros <= 2000 AND ancho >= 0.8 AND area >= 0.6 AND elevacion <= -1.5)"""
QUERIES = {f.__name__: f for f in (lotes_visibles, puntaje_encuadre, tiras_de_lotes, vuelos, numeracion, cola_de_un_cupo)}
#: The fold of vuelos is tested against a plain loop.
ORACLES = {
    "lotes_visibles": f"{_VISIBLES} SELECT vista, lote, metros, elevacion, ancho, area FROM visibles",
    "puntaje_encuadre": f"{_VISIBLES} SELECT vista, count(*) AS lotes, round(sum(least(area, 50.0)), 3) AS puntaje FROM visibles GROUP BY vista",
    "tiras_de_lotes": f"""
  WITH {_LOTES}, t AS (SELECT *, sum(salta) OVER (PARTITION BY plano ORDER BY lote) AS tramo FROM (SELECT *,
    CASE WHEN sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) > 120 THEN 1 ELSE 0 END AS salta FROM lotes WINDOW w AS (PARTITION BY plano ORDER BY lote))),
  k AS (SELECT *, (row_number() OVER (PARTITION BY plano, tramo ORDER BY lote) - 1) // 12 AS parte FROM t)
  SELECT plano, min(lote) AS desde, max(lote) AS hasta, count(*) AS n, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, min(x) AS oeste, max(x) AS este, min(y) AS sur, max(y) AS norte
  FROM k GROUP BY plano, tramo, parte""",
    "numeracion": f"""
  WITH {_LOTES}, {_ROTULOS}, en AS (SELECT lote, min(rotulo) AS rotulo FROM lotes JOIN rotulos USING (plano) WHERE {_DENTRO} GROUP BY lote HAVING count(*) = 1)
  SELECT plano, count(*) FILTER (rotulo % 5 = lote % 5) AS bien, count(*) FILTER (rotulo % 5 <> lote % 5) AS mal, count(*) FILTER (rotulo IS NULL) AS sin,
    round(count(*) FILTER (rotulo % 5 = lote % 5) / count(*), 6) AS recuperado FROM lotes LEFT JOIN en USING (lote) GROUP BY plano""",
    "cola_de_un_cupo": """
  WITH RECURSIVE t AS (SELECT event_id, user_id, CAST(floor(floor(epoch(ts)) / 3600) AS BIGINT) AS llega, least(event_id % 60 + 1, 45) AS dura, event_id % 60 + 1 > 45 AS cortado,
    row_number() OVER (PARTITION BY user_id ORDER BY floor(floor(epoch(ts)) / 3600), event_id) AS k FROM events),
  r AS (SELECT *, llega AS empieza FROM t WHERE k = 1 UNION ALL SELECT t.*, greatest(t.llega, r.empieza + r.dura) FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k + 1)
  SELECT event_id, empieza, empieza + dura AS termina, cortado FROM r""",
}
