"""Heights from tiles, and the horizon that they make.

A mosaic is a table of tiles: mosaico, zoom, tx, ty and `cotas`, the heights of a tile's pixels row by row. A
point asks for the four pixels round it, each of them a tile key and a place in it, so seams need no care; the
requests meet the tiles in one join by key, and a point's four answers are summed up again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions import espacio
from predio.session import dealt, table

#: Pixels of a tile's side, what the encoded height is shifted by, the rings of the horizon (zoom, from, to and
#: step in metres), its step in degrees, the earth's radius and the share of its curve that the air takes away.
LADO, DESPLAZAMIENTO = 256, 32768.0
ANILLOS = ((12, 150.0, 15000.0, 30.0), (10, 15000.0, 60000.0, 150.0), (8, 60000.0, 250000.0, 500.0))
PASO_AZIMUT, RADIO, REFRACCION = 0.25, 6371000.0, 0.13


def decodificar(r: Column, g: Column, b: Column) -> Column:
    """Height in metres of a pixel's three channels; the sea's floor counts as its surface."""
    return F.greatest(r * 256.0 + g + b / 256.0 - DESPLAZAMIENTO, F.lit(0.0))


def teselas(pixeles: DataFrame) -> DataFrame:
    """Tiles with arrays r, g and b, to tiles with `cotas`."""
    alto = F.zip_with(F.arrays_zip("r", "g"), F.col("b"), lambda rg, b: decodificar(rg["r"], rg["g"], b))
    return pixeles.withColumn("cotas", alto).drop("r", "g", "b")


def cotas_en(puntos: DataFrame, mosaicos: DataFrame, id: list[str], lado: int = LADO) -> DataFrame:  # noqa: A002
    """id and cota of points (id, mosaico, zoom, lon, lat): bilinear between the centres of the four pixels round a point, at the
    mosaic's edge its outermost pixels; null where one of the four has no tile, or without coordinates."""
    borde = mosaicos.groupBy("mosaico", "zoom").agg(F.min("tx").alias("x0"), F.min("ty").alias("y0"), (F.max("tx") + 1).alias("x1"), (F.max("ty") + 1).alias("y1"))
    en = espacio.pixel_global(F.col("lon"), F.col("lat"), lado * F.pow(F.lit(2.0), F.col("zoom")))
    # one row for each mosaic and zoom; unasked, Spark may send the points round where both keys are constants
    p = puntos.join(F.broadcast(borde), ["mosaico", "zoom"], "left").withColumn("g", en)
    dentro = lambda v, a, z: F.when(v.isNotNull(), F.least(F.greatest(v - 0.5, (F.col(a) * lado).cast("double")), (F.col(z) * lado - 1).cast("double")))
    p = p.select(*id, "mosaico", "zoom", "x1", "y1", dentro(F.col("g.x"), "x0", "x1").alias("px"), dentro(F.col("g.y"), "y0", "y1").alias("py"))
    j, i = F.floor("px"), F.floor("py")
    fj, fi = F.col("px") - j, F.col("py") - i
    j2, i2 = F.least(j + 1, F.col("x1") * lado - 1), F.least(i + 1, F.col("y1") * lado - 1)
    en = lambda v: F.floor(v / lado).cast("int")
    # a point asks each of its tiles once (px, py, x1, y1 say which pixels) and takes all of its pixels from there
    otra_x, otra_y = en(j2) != en(j), en(i2) != en(i)
    suyas = [(j, i, F.lit(True)), (j2, i, otra_x), (j, i2, otra_y), (j2, i2, otra_x & otra_y)]
    tesela = lambda x, y, pide: F.struct(en(x).alias("tx"), en(y).alias("ty"), pide.alias("pide"))
    piden = p.select(*id, "mosaico", "zoom", "x1", "y1", "px", "py", F.inline(F.array(*[tesela(*t) for t in suyas]))).where("pide").drop("pide")
    toca = piden.join(mosaicos.select("mosaico", "zoom", "tx", "ty", "cotas"), ["mosaico", "zoom", "tx", "ty"], "left")
    valores = []
    for x, y, w in ((j, i, (1 - fi) * (1 - fj)), (j2, i, (1 - fi) * fj), (j, i2, fi * (1 - fj)), (j2, i2, fi * fj)):
        pixel = F.get("cotas", (F.pmod(y, F.lit(lado)) * lado + F.pmod(x, F.lit(lado))).cast("int"))
        valores.append(F.when((en(x) == F.col("tx")) & (en(y) == F.col("ty")), F.when(w == 0, 0.0).otherwise(pixel * w)))  # w is null without coordinates
    cada = toca.select(*id, *[v.alias(f"v{n}") for n, v in enumerate(valores)])
    cada = cada.select(*id, sum((F.col(f"v{n}").isNotNull().cast("int") for n in range(4)), F.lit(0)).alias("n"), sum((F.coalesce(f"v{n}", F.lit(0.0)) for n in range(4)), F.lit(0.0)).alias("v"))
    return cada.groupBy(*id).agg(F.when(F.sum("n") == 4, F.sum("v")).alias("cota"))


def horizonte(vistas: DataFrame, mosaicos: DataFrame, id: str, anillos=ANILLOS, paso: float = PASO_AZIMUT, lado: int = LADO) -> DataFrame:  # noqa: A002
    """id, azimut, elevacion and distancia of the horizon seen from (id, mosaico, lon, lat, altura): in every direction the highest
    angle over the rings' points, curvature and refraction taken off; of equal ones the nearest. Directions
    in which no point has a height are left out."""
    partes = None
    for n, (zoom, desde, hasta, cada) in enumerate(anillos):
        pasos = max(0, math.ceil((hasta - desde) / cada))
        d = F.lit(desde) + F.col("k") * cada
        v = dealt(vistas, id).where(F.lit(pasos > 0)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(360 / paso) - 1)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(0, pasos - 1)))))
        az = F.radians(F.col("a") * paso)
        grado = espacio.METROS_POR_GRADO
        lon, lat = F.col("lon") + F.sin(az) * d / (grado * F.cos(F.radians("lat"))), F.col("lat") + F.cos(az) * d / grado
        v = v.select(id, "mosaico", F.lit(zoom).alias("zoom"), "altura", "a", F.lit(n).alias("anillo"), d.alias("d"), lon.alias("lon"), lat.alias("lat"))
        partes = v if partes is None else partes.unionByName(v)
    cotas = cotas_en(partes, mosaicos, [id, "altura", "a", "anillo", "d"], lado)
    caida = F.col("d") * F.col("d") / (2 * RADIO) * (1 - REFRACCION)
    angulo = F.degrees(F.atan2(F.col("cota") - caida - F.col("altura"), F.col("d")))
    mejor = F.max(F.struct(angulo.alias("e"), (-F.col("anillo")).alias("n"), (-F.col("d")).alias("d"))).alias("m")
    return cotas.where("cota is not null").groupBy(id, "a").agg(mejor).select(id, (F.col("a") * paso).alias("azimut"), F.col("m.e").alias("elevacion"), (-F.col("m.d")).alias("distancia"))


#: The test table's tiles: eight pixels wide, at this zoom, from this corner of the world on.
_LADO, _ZOOM, _TX, _TY, _ANCHO = 8, 14, 4900, 9800, 25


def _mosaico(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a mosaic of tiles, 25 in a row; some heights below the sea."""
    e = F.col("embedding")
    canal = lambda f: F.transform(e, lambda x: f(x.cast("double")))
    t = table(spark, sf_dir, "embeddings").select(F.lit("m").alias("mosaico"), F.lit(_ZOOM).alias("zoom"), (_TX + F.col("vec_id") % _ANCHO).cast("int").alias("tx"), (_TY + F.floor(F.col("vec_id") / _ANCHO)).cast("int").alias("ty"), canal(lambda x: F.lit(128)).alias("r"), canal(lambda x: F.floor((x + 0.1) * 300)).alias("g"), canal(lambda x: F.floor(F.abs(x) * 255)).alias("b"))
    return teselas(t)


def _puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as points over the mosaic and a little beyond its edge, as fractions of pixels."""
    k, mundo = F.col("c_custkey"), F.lit(float(_LADO * 2**_ZOOM))
    x, y = F.lit(float(_TX * _LADO)) + (k * 37 % 2040) / 10.07 - 2, F.lit(float(_TY * _LADO)) + (k * 53 % 1640) / 10.07 - 2
    p = espacio.coordenada(x, y, mundo)
    return table(spark, sf_dir, "customer").select("c_custkey", F.lit("m").alias("mosaico"), F.lit(_ZOOM).alias("zoom"), p["x"].alias("lon"), p["y"].alias("lat"))


def cotas_de_puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground's height under points."""
    return cotas_en(_puntos(spark, sf_dir), _mosaico(spark, sf_dir), ["c_custkey"], _LADO).select("c_custkey", F.round("cota", 4).alias("cota"))


def horizontes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The horizon from every hundredth point, in steps of 15 degrees, over two rings."""
    v = _puntos(spark, sf_dir).where("c_custkey % 100 = 0").withColumn("altura", F.lit(40.0)).drop("zoom")
    h = horizonte(v, _mosaico(spark, sf_dir), "c_custkey", ((_ZOOM, 150.0, 3000.0, 30.0), (_ZOOM, 3000.0, 20000.0, 150.0)), 15.0, _LADO)
    return h.select("c_custkey", "azimut", F.round("elevacion", 5).alias("elevacion"), "distancia")


QUERIES = {f.__name__: f for f in (cotas_de_puntos, horizontes)}
_P = f"(SELECT c_custkey, {_TX * _LADO}.0::DOUBLE + (c_custkey * 37 % 2040) / 10.07::DOUBLE - 2 AS x, {_TY * _LADO}.0::DOUBLE + (c_custkey * 53 % 1640) / 10.07::DOUBLE - 2 AS y FROM customer)"
ORACLES = {
    "cotas_de_puntos": f"""
  WITH px AS MATERIALIZED (
    SELECT ({_TX} + vec_id % {_ANCHO}) * {_LADO} + (k - 1) % {_LADO} AS x, ({_TY} + vec_id // {_ANCHO}) * {_LADO} + (k - 1) // {_LADO} AS y,
           greatest(128 * 256.0::DOUBLE + floor((e + 0.1) * 300) + floor(abs(e) * 255) / 256.0::DOUBLE - {DESPLAZAMIENTO}, 0) AS cota
    FROM (SELECT vec_id, CAST(embedding[k] AS DOUBLE) AS e, k FROM embeddings, range(1, 65) AS r(k))),
  b AS MATERIALIZED (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM px),
  p AS (SELECT c_custkey, least(greatest(x - 0.5, x0), x1) AS px, least(greatest(y - 0.5, y0), y1) AS py, x1, y1 FROM {_P} c, b),
  q AS MATERIALIZED (
    SELECT c_custkey, unnest([{{'x': floor(px), 'y': floor(py), 'w': (1 - px + floor(px)) * (1 - py + floor(py))}}, {{'x': least(floor(px) + 1, x1), 'y': floor(py), 'w': (px - floor(px)) * (1 - py + floor(py))}},
                              {{'x': floor(px), 'y': least(floor(py) + 1, y1), 'w': (1 - px + floor(px)) * (py - floor(py))}}, {{'x': least(floor(px) + 1, x1), 'y': least(floor(py) + 1, y1), 'w': (px - floor(px)) * (py - floor(py))}}]) AS c FROM p)
  SELECT c_custkey, round(sum(c.w * cota), 4) AS cota FROM q JOIN px ON px.x = CAST(c.x AS BIGINT) AND px.y = CAST(c.y AS BIGINT) GROUP BY c_custkey""",
}
