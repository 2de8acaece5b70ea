"""Drawings: labels, outlines and pills joined by grid cell; greedy rules as rounds of joins.

A greedy rule in a fixed order is decided in parallel: in each round every item that comes first among all the
items it competes with is settled, and what it excludes goes. At least one item is settled in a round, and the
result is the one of the loop in order. Each round is written to the shared folder, so a lost executor repeats
one round and no plan grows. Rows without an id or a place meet nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions import espacio
from predio.session import dealt, shared_folder, table

#: Metres from a label to a free centroid, from a stage's label to its swatch, of a mutual pair,
#: of views that count as one place; air between two pills.
CERCA_M, LEYENDA_M, MUTUO_M, MISMO_SITIO_M, AIRE = 150, 100, 90, 15, 2
CELDA_M = 50


def _escrito(df: DataFrame) -> DataFrame:
    carpeta = shared_folder(df.sparkSession)
    df.write.parquet(carpeta)
    return df.sparkSession.read.parquet(carpeta)


def emparejar(pares: DataFrame, a: str, b: str, *orden: str) -> DataFrame:
    """The pairs that a loop over `pares` by `orden` takes if both sides are still free (ties by a, then b)."""
    quedan, tomados = _escrito(pares.select(*dict.fromkeys((*orden, a, b))).dropna().distinct()), []
    clave = F.struct(*quedan.columns)
    while not quedan.isEmpty():
        primeros = [quedan.groupBy(lado).agg(F.min(clave).alias("k")).select("k.*") for lado in (a, b)]
        tomados.append(_escrito(primeros[0].join(primeros[1], quedan.columns)))
        for lado in (a, b):
            quedan = quedan.join(tomados[-1].select(lado), lado, "left_anti")
        quedan = _escrito(quedan.select(*tomados[-1].columns))
    return reduce(DataFrame.unionByName, tomados, quedan)


def conservar(nodos: DataFrame, choques: DataFrame) -> DataFrame:
    """The ids that a loop in order keeps if they clash with none kept before; `choques` has mejor (the earlier one) and peor."""
    vivos, choques, quedan = _escrito(nodos.select("id").dropna().distinct()), _escrito(choques.select("mejor", "peor").distinct()), []
    while not vivos.isEmpty():
        quedan.append(_escrito(vivos.join(choques.select(F.col("peor").alias("id")), "id", "left_anti")))
        caen = choques.join(quedan[-1].select(F.col("id").alias("mejor")), "mejor").select(F.col("peor").alias("id"))
        vivos = _escrito(vivos.join(quedan[-1], "id", "left_anti").join(caen, "id", "left_anti"))
        for lado in ("mejor", "peor"):
            choques = choques.join(vivos.select(F.col("id").alias(lado)), lado, "left_semi")
        choques = _escrito(choques.select("mejor", "peor"))
    return reduce(DataFrame.unionByName, quedan, vivos)


def componentes(nodos: DataFrame, aristas: DataFrame) -> DataFrame:
    """id and grupo, the smallest id that the edges a, b reach: neighbours' least group, then the group of the group."""
    lados = _escrito(aristas.select("a", "b").unionByName(aristas.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    grupos, cambian = _escrito(nodos.select("id", F.col("id").alias("grupo")).dropna().distinct()), True
    while cambian:
        vecino = lados.join(grupos, F.col("b") == F.col("id")).groupBy("a").agg(F.min("grupo").alias("m")).withColumnRenamed("a", "id")
        nuevo = grupos.join(vecino, "id", "left").select("id", F.col("grupo").alias("antes"), F.least("grupo", "m").alias("g"))
        jefe = nuevo.select(F.col("id").alias("g"), F.col("g").alias("grupo"))
        nuevo = _escrito(nuevo.join(jefe, "g").select("id", "antes", "grupo"))
        cambian, grupos = not nuevo.where("antes <> grupo").isEmpty(), nuevo.select("id", "grupo")
    return grupos


def _lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines: lote, plano, x and y of the centre, half width w, half height h, numbered already or not."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("lote"), F.floor(k / 400).alias("plano"), (k * 37 % 997).alias("x"), (k * 53 % 991).alias("y"),
        (5 + F.col("p_size") * 0.5).alias("w"), (6 + F.col("p_size") % 16).alias("h"), (k % 10 == 0).alias("numerado"), F.col("p_size").alias("medida"),
    )


def _rotulos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: rotulo, plano, px, py."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("rotulo"), F.floor(k / 400).alias("plano"), (k * 41 % 997 + 0.5).alias("px"), (k * 59 % 991 + 0.25).alias("py"))


def _celdas(desde: Column, hasta: Column, lado: int = CELDA_M) -> Column:
    return F.explode(F.sequence(F.floor(desde / lado), F.floor(hasta / lado)))


def dentro(lotes: DataFrame, puntos: DataFrame) -> DataFrame:
    """Points with the outlines of their drawing that contain them. Outlines are dealt over tasks before their cells are listed."""
    cajas = dealt(lotes, "plano", "x", "y").withColumn("cx", _celdas(F.col("x") - F.col("w"), F.col("x") + F.col("w"))).withColumn("cy", _celdas(F.col("y") - F.col("h"), F.col("y") + F.col("h")))
    puntos = puntos.withColumn("cx", F.floor(F.col("px") / CELDA_M)).withColumn("cy", F.floor(F.col("py") / CELDA_M))
    esquina = lambda sx, sy: F.struct((F.col("x") + sx * F.col("w")).alias("x"), (F.col("y") + sy * F.col("h")).cast("double").alias("y"))
    anillo = F.array(esquina(-1, -1), esquina(1, -1), esquina(1, 1), esquina(-1, 1))
    return puntos.join(cajas, ["plano", "cx", "cy"]).where(espacio.contiene(anillo, F.col("px"), F.col("py"))).drop("cx", "cy")


def cercanos(lotes: DataFrame, puntos: DataFrame, radio: int) -> DataFrame:
    """Points with the centres of their drawing within `radio`, and the squared distance d2; from neighbouring cells alone.
    A point is listed under nine cells: points are dealt over tasks first, so that a small file isn't one task with all of them."""
    centros = lotes.withColumn("cx", F.floor(F.col("x") / radio)).withColumn("cy", F.floor(F.col("y") / radio))
    alcance = lambda c: _celdas(F.col(c) - radio, F.col(c) + radio, radio)
    puntos = dealt(puntos, "plano", "px", "py").withColumn("cx", alcance("px")).withColumn("cy", alcance("py"))
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return puntos.join(centros, ["plano", "cx", "cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") <= radio * radio).drop("cx", "cy")


def rotulo_a_lote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline of each label, in the labels' order: the only container without a number yet, then of the labels left the
    nearest free centre within CERCA_M. Labels whose number an outline has already are left out."""
    lotes = _lotes(spark, sf_dir)
    libres = lotes.where("not numerado")
    con_numero = lotes.where("numerado").select("plano", F.col("lote").alias("rotulo"))
    rotulos = _rotulos(spark, sf_dir).join(con_numero, ["plano", "rotulo"], "left_anti")
    quedan, tomados = _escrito(dentro(libres, rotulos).select("rotulo", "lote")), []
    while not quedan.isEmpty():  # a label decides once every earlier label of its containers has
        turno = quedan.groupBy("lote").agg(F.min("rotulo").alias("turno"))
        listos = quedan.join(turno, "lote").groupBy("rotulo").agg(F.bool_and(F.col("rotulo") == F.col("turno")).alias("listo"), F.count("*").alias("n"), F.min("lote").alias("lote"))
        listos = _escrito(listos.where("listo").drop("listo"))
        tomados.append(listos.where("n = 1").select("rotulo", "lote"))
        quedan = _escrito(quedan.join(listos.select("rotulo"), "rotulo", "left_anti").join(tomados[-1].select("lote"), "lote", "left_anti").select("rotulo", "lote"))
    contenidos = reduce(DataFrame.unionByName, tomados, quedan)
    faltan, sueltos = rotulos.join(contenidos, "rotulo", "left_anti"), libres.join(contenidos, "lote", "left_anti")
    resto = emparejar(cercanos(sueltos, faltan, CERCA_M), "rotulo", "lote", "rotulo", "d2").select("rotulo", "lote")
    return contenidos.withColumn("por", F.lit("contenido")).unionByName(resto.withColumn("por", F.lit("cercano")))


def parejas_cercanas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and centres paired from the nearest pair on, each used once, within MUTUO_M."""
    pares = cercanos(_lotes(spark, sf_dir), _rotulos(spark, sf_dir), MUTUO_M)
    return emparejar(pares, "rotulo", "lote", "d2").select("rotulo", "lote", F.round(F.sqrt("d2"), 4).alias("metros"))


def lotes_dibujados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each label the smallest outline that holds it and no other label."""
    en = dentro(_lotes(spark, sf_dir), _rotulos(spark, sf_dir))
    unicos = en.groupBy("lote").agg(F.count("*").alias("n"), F.min("rotulo").alias("rotulo"), F.first(F.col("w") * F.col("h") * 4).alias("area")).where("n = 1")
    return unicos.groupBy("rotulo").agg(F.min_by("lote", F.struct("area", "lote")).alias("lote"), F.round(F.min("area"), 4).alias("area"))


def leyenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each stage's label the nearest swatch beside it within LEYENDA_M: an outline without lots' labels that doesn't hold the label itself."""
    lotes, k = _lotes(spark, sf_dir), F.col("s_suppkey")
    etapas = table(spark, sf_dir, "supplier").select(k.alias("etapa"), F.floor(k / 20).alias("plano"), (k * 71 % 997 + 0.5).alias("px"), (k * 83 % 991 + 0.25).alias("py"))
    muestras = lotes.join(dentro(lotes, _rotulos(spark, sf_dir)).select("lote").distinct(), "lote", "left_anti")
    al_lado = cercanos(muestras, etapas, LEYENDA_M).join(dentro(muestras, etapas).select("etapa", "lote"), ["etapa", "lote"], "left_anti")
    return al_lado.groupBy("etapa").agg(F.min_by("lote", F.struct("d2", "lote")).alias("muestra"), F.round(F.sqrt(F.min("d2")), 4).alias("metros"))


def _pildoras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pills: id, plano, x, y, ancho, alto, prioridad."""
    resto = F.col("lote") % 991
    return _lotes(spark, sf_dir).select(F.col("lote").alias("id"), "plano", "x", (resto * resto * 53 % 991).alias("y"), (20 + F.col("medida") % 9 * 2).alias("ancho"), F.lit(12).alias("alto"), (F.col("medida") % 7).alias("prioridad"))


def chocan(pildoras: DataFrame, aire_x: int, aire_y: int) -> DataFrame:
    """Pairs of pills of a drawing that overlap, each once (structs p and q, the first id in p): they share a cell, and count in that of their overlap's least corner."""
    cel = lambda v: F.floor(v / CELDA_M)
    borde = {c: (F.col(c) - F.col(m) / 2 - F.lit(a) / 2, F.col(c) + F.col(m) / 2 + F.lit(a) / 2) for c, m, a in (("x", "ancho", aire_x), ("y", "alto", aire_y))}
    todo = F.struct(*pildoras.columns, cel(borde["x"][0]).alias("x0"), cel(borde["y"][0]).alias("y0"))
    p = dealt(pildoras, "plano", "x", "y").select("plano", todo.alias("p"), F.explode(F.sequence(*map(cel, borde["x"]))).alias("cx"), F.sequence(*map(cel, borde["y"])).alias("cys"))
    p = p.select("plano", "p", "cx", F.explode("cys").alias("cy"))
    junto = p.join(p.withColumnRenamed("p", "q"), ["plano", "cx", "cy"]).where(F.col("p.id") < F.col("q.id"))
    toca = [F.abs(F.col(f"p.{c}") - F.col(f"q.{c}")) < (F.col(f"p.{m}") + F.col(f"q.{m}")) / 2 + a for c, m, a in (("x", "ancho", aire_x), ("y", "alto", aire_y))]
    una = (F.col("cx") == F.greatest("p.x0", "q.x0")) & (F.col("cy") == F.greatest("p.y0", "q.y0"))
    return junto.where(toca[0] & toca[1] & una).select("p", "q")


def rotulos_sin_choques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pills that are drawn: by priority, then in the order of their ids, those that overlap none drawn before (with AIRE between them)."""
    pildoras = _pildoras(spark, sf_dir)
    antes = F.col("p.prioridad") >= F.col("q.prioridad")
    par = chocan(pildoras, AIRE, AIRE).select(F.when(antes, F.col("p.id")).otherwise(F.col("q.id")).alias("mejor"), F.when(antes, F.col("q.id")).otherwise(F.col("p.id")).alias("peor"))
    return conservar(pildoras, par)


def grupos_por_choque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of each pill, the least id among those that overlaps connect; a pin of 8 below each pill and an air of 4 across count too."""
    pildoras = _pildoras(spark, sf_dir)
    return componentes(pildoras, chocan(pildoras, 4, 8).select(F.col("p.id").alias("a"), F.col("q.id").alias("b")))


def lote_buscado(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline of each written number: the first with the same sector and number, else the only form with the same number
    where just one of the two names a sector; none if several do."""
    numero = lambda k, sin: (F.floor(k / 400).alias("plano"), F.when(k % sin != 0, k % 5).alias("sector"), (k % 151).alias("numero"))
    lotes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lote"), *numero(F.col("p_partkey"), 3)).groupBy("plano", "sector", "numero").agg(F.min("lote").alias("lote"))
    lotes = lotes.select("plano", "numero", F.col("sector").alias("del_lote"), "lote")
    buscados = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("buscado"), *numero(F.col("c_custkey"), 2))
    igual, omite = F.col("sector").eqNullSafe(F.col("del_lote")), F.col("sector").isNull() != F.col("del_lote").isNull()
    g = buscados.join(lotes, ["plano", "numero"], "left").groupBy("buscado").agg(F.min(F.when(igual, F.col("lote"))).alias("igual"), F.count(F.when(omite, F.col("lote"))).alias("n"), F.min(F.when(omite, F.col("lote"))).alias("otro"))
    return g.select("buscado", F.coalesce("igual", F.when(F.col("n") == 1, F.col("otro"))).alias("lote"))


def otros_puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each view the other positions of its drawing, by their first view, unless nearer than MISMO_SITIO_M."""
    k = F.col("s_suppkey")
    v = table(spark, sf_dir, "supplier").select(k.alias("vista"), F.floor(k / 20).alias("plano"), (k % 7).alias("posicion"), (k * 11 % 61).alias("x"), (k * 17 % 53).alias("y"))
    punto = v.groupBy("plano", "posicion").agg(F.min_by(F.struct("vista", "x", "y"), "vista").alias("p")).select("plano", F.col("posicion").alias("otra"), F.col("p.vista").alias("punto"), F.col("p.x").alias("ox"), F.col("p.y").alias("oy"))
    metros = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    return v.join(punto, "plano").where((F.col("posicion") != F.col("otra")) & (metros >= MISMO_SITIO_M)).select("vista", "punto", F.round(metros, 4).alias("metros"))


_LOTES = """lotes AS (SELECT p_partkey AS lote, p_partkey // 400 AS plano, p_partkey * 37 % 997 AS x, p_partkey * 53 % 991 AS y, 5 + p_size * 0.5::DOUBLE AS w,
  6 + p_size % 16 AS h, p_size AS medida FROM part)"""
_ROTULOS = "rotulos AS (SELECT c_custkey AS rotulo, c_custkey // 400 AS plano, c_custkey * 41 % 997 + 0.5::DOUBLE AS px, c_custkey * 59 % 991 + 0.25::DOUBLE AS py FROM customer)"
_DENTRO = "px >= x - w AND px < x + w AND py >= y - h AND py < y + h"
_PILDORAS = """SELECT p_partkey AS id, p_partkey // 400 AS plano, p_partkey * 37 % 997 AS x,
  (p_partkey % 991) * (p_partkey % 991) * 53 % 991 AS y, 20 + p_size % 9 * 2 AS ancho FROM part"""
QUERIES = {f.__name__: f for f in (rotulo_a_lote, parejas_cercanas, lotes_dibujados, leyenda, rotulos_sin_choques, grupos_por_choque, lote_buscado, otros_puntos)}
#: The greedy rules (rotulo_a_lote, parejas_cercanas, rotulos_sin_choques) are tested against plain loops.
ORACLES = {
    "lotes_dibujados": f"""
  WITH {_LOTES}, {_ROTULOS}, en AS (SELECT rotulo, lote, round(w * h * 4, 4) AS area FROM lotes JOIN rotulos USING (plano) WHERE {_DENTRO})
  SELECT rotulo, lote, area FROM en WHERE lote IN (SELECT lote FROM en GROUP BY lote HAVING count(*) = 1)
  QUALIFY row_number() OVER (PARTITION BY rotulo ORDER BY area, lote) = 1""",
    "leyenda": f"""
  WITH {_LOTES}, {_ROTULOS}, con AS (SELECT lote FROM lotes JOIN rotulos USING (plano) WHERE {_DENTRO}),
  etapas AS (SELECT s_suppkey AS etapa, s_suppkey // 20 AS plano, s_suppkey * 71 % 997 + 0.5::DOUBLE AS px, s_suppkey * 83 % 991 + 0.25::DOUBLE AS py FROM supplier)
  SELECT etapa, lote AS muestra, round(sqrt(d2), 4) AS metros FROM (SELECT *, (x - px) * (x - px) + (y - py) * (y - py) AS d2 FROM lotes JOIN etapas USING (plano)
    WHERE lote NOT IN (SELECT lote FROM con) AND NOT ({_DENTRO})) WHERE d2 <= 10000 QUALIFY row_number() OVER (PARTITION BY etapa ORDER BY d2, lote) = 1""",
    "grupos_por_choque": f"""
  WITH RECURSIVE p AS ({_PILDORAS}), e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.plano = b.plano AND a.id <> b.id
    AND abs(a.x - b.x) < (a.ancho + b.ancho) / 2.0 + 4 AND abs(a.y - b.y) < 12 + 8),
  r(id, llega) AS (SELECT id, id FROM p UNION SELECT r.id, e.b FROM r JOIN e ON r.llega = e.a)
  SELECT id, min(llega) AS grupo FROM r GROUP BY id""",
    "lote_buscado": """
  WITH l AS (SELECT p_partkey // 400 AS plano, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 5 END AS sector, p_partkey % 151 AS numero, min(p_partkey) AS lote FROM part GROUP BY ALL),
  b AS (SELECT c_custkey AS buscado, c_custkey // 400 AS plano, CASE WHEN c_custkey % 2 <> 0 THEN c_custkey % 5 END AS sector, c_custkey % 151 AS numero FROM customer)
  SELECT buscado, coalesce((SELECT min(lote) FROM l WHERE l.plano = b.plano AND l.numero = b.numero AND l.sector IS NOT DISTINCT FROM b.sector),
    (SELECT CASE WHEN count(*) = 1 THEN min(lote) END FROM l WHERE l.plano = b.plano AND l.numero = b.numero AND (l.sector IS NULL) <> (b.sector IS NULL))) AS lote FROM b""",
    "otros_puntos": """
  WITH v AS (SELECT s_suppkey AS vista, s_suppkey // 20 AS plano, s_suppkey % 7 AS posicion, s_suppkey * 11 % 61 AS x, s_suppkey * 17 % 53 AS y FROM supplier),
  p AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY plano, posicion ORDER BY vista) = 1)
  SELECT v.vista, p.vista AS punto, round(sqrt((v.x - p.x) ** 2 + (v.y - p.y) ** 2), 4) AS metros FROM v JOIN p USING (plano)
  WHERE v.posicion <> p.posicion AND (v.x - p.x) ** 2 + (v.y - p.y) ** 2 >= 225""",
}
