"""Names and points that have to agree: stages by elimination, anchors with leave-one-out residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.session import shared_folder, table

#: Share of a group's numbers that a stage must have; an anchor stands out if its residual without it
#: is above FACTOR times the median of the others', and above PISO metres.
CALCE, FACTOR, PISO = 0.9, 3.0, 4.0


def _escrito(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: a round's result, with its lineage cut."""
    camino = shared_folder(df.sparkSession)
    df.write.parquet(camino)
    return df.sparkSession.read.schema(df.schema).parquet(camino)


def _borrar(df: DataFrame | None) -> None:
    """Removes what _escrito wrote, once nothing reads it any more."""
    if df is not None:
        spark = df.sparkSession
        for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            ruta = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
            ruta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(ruta, True)


def prefijo_y_numero(x: Column) -> tuple[Column, Column]:
    """What stands before the digits at an id's end, and those digits (none: the whole id and '')."""
    numero = F.regexp_extract(x, "([0-9]*)$", 1)
    return F.substring(x, F.lit(1), F.length(x) - F.length(numero)), numero


def alinear(fichas: DataFrame, ids: DataFrame) -> DataFrame:
    """Sheet lots (grupo, id, numero, etapa) with the id that the drawing (grupo, id) uses, within each grupo:
    id_dibujo and por: 'igual', 'numero' (the bare number, if no other pending lot has it), 'descarte' or null (as it is).

    By elimination: the drawing's free ids are grouped by their prefix. A group fits a stage that has nine tenths of
    its numbers at least. In every round the groups with a single stage left settle (of two for one stage the
    smaller prefix), and both go; so there are at most as many rounds as a project has stages. What stays
    ambiguous keeps its id. The numbers meet once, in one join; the rounds work on the pairs of group and stage.
    """
    clave = ["grupo", "id"]
    pendientes, libres = fichas.join(ids, clave, "left_anti"), ids.select(*clave).distinct().join(fichas, clave, "left_anti")
    unicos = pendientes.where("numero is not null").groupBy("grupo", "numero").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    nuevos = _escrito(unicos.join(libres.select("grupo", F.col("id").alias("numero")), ["grupo", "numero"]).select("grupo", "id", F.col("numero").alias("nuevo")))
    libres = libres.join(nuevos.select("grupo", F.col("nuevo").alias("id")), clave, "left_anti")
    prefijo, numero = prefijo_y_numero(F.col("id"))
    rotulos = libres.groupBy("grupo", prefijo.alias("prefijo"), numero.alias("numero")).agg(F.max("id").alias("rotulo"))
    propias = pendientes.join(nuevos, clave, "left_anti").where("numero <> '' and etapa is not null").groupBy("grupo", "etapa", "numero").agg(F.max("id").alias("id"))
    juntos = _escrito(rotulos.join(propias, ["grupo", "numero"]))
    tamano = rotulos.groupBy("grupo", "prefijo").agg(F.count("*").alias("n"))
    aciertos = juntos.groupBy("grupo", "prefijo", "etapa").agg(F.count("*").alias("m"))
    quedan = _escrito(aciertos.join(tamano, ["grupo", "prefijo"]).where(F.col("m") >= CALCE * F.col("n")).select("grupo", "prefijo", "etapa"))
    partes = []
    while True:
        solos = quedan.groupBy("grupo", "prefijo").agg(F.count("*").alias("n"), F.first("etapa").alias("etapa")).where("n = 1")
        firmes = _escrito(solos.groupBy("grupo", "etapa").agg(F.min("prefijo").alias("prefijo")).select("grupo", "prefijo", "etapa"))
        if firmes.isEmpty():
            break
        partes.append(firmes)
        antes, quedan = quedan, _escrito(quedan.join(firmes.select("grupo", "prefijo"), ["grupo", "prefijo"], "left_anti").join(firmes.select("grupo", "etapa"), ["grupo", "etapa"], "left_anti"))
        _borrar(antes)
    _borrar(firmes)
    todas = nuevos.select("grupo", "id", "nuevo", F.lit("numero").alias("por"))
    for p in partes:
        todas = todas.unionByName(juntos.join(p, ["grupo", "prefijo", "etapa"]).select("grupo", "id", F.col("rotulo").alias("nuevo"), F.lit("descarte").alias("por")))
    conocidos = ids.select(*clave, F.lit("igual").alias("igual")).distinct()
    return fichas.join(todas, clave, "left").join(conocidos, clave, "left").select("grupo", "id", F.coalesce("nuevo", "id").alias("id_dibujo"), F.coalesce("por", "igual").alias("por"))


# --- anchors ---------------------------------------------------------------------------


def _ajustado(p: DataFrame, f: str, sumas: dict[str, Column], hay: Column) -> DataFrame:
    """p with the similarity w = a z + b in complex numbers by least squares (f_ar ... f_bi) and the rms of what is left (f_rms), from sums.
    A plan whose points are all in one place has none, nor where `hay` is false. Step by step: in one expression
    the sums would be repeated until the generated code is too long to be compiled."""
    j = p.withColumns({f"_{k}": c for k, c in sumas.items()})
    c = {k: F.col(f"_{k}") for k in (*SUMAS, "n")}
    n = F.when(c["n"] > 0, c["n"])
    centradas = {
        "_czz": c["zz"] - (c["sx"] * c["sx"] + c["sy"] * c["sy"]) / n, "_cww": c["ww"] - (c["su"] * c["su"] + c["sv"] * c["sv"]) / n,
        "_cre": c["re"] - (c["sx"] * c["su"] + c["sy"] * c["sv"]) / n, "_cim": c["im"] - (c["sx"] * c["sv"] - c["sy"] * c["su"]) / n,
    }
    j = j.withColumns(centradas)
    sirve = hay & (F.col("_czz") > 1e-12)
    j = j.withColumns({f"{f}_ar": F.when(sirve, F.col("_cre") / F.col("_czz")), f"{f}_ai": F.when(sirve, F.col("_cim") / F.col("_czz"))})
    ar, ai = F.col(f"{f}_ar"), F.col(f"{f}_ai")
    rms = F.sqrt(F.greatest(F.lit(0.0), F.col("_cww") - (ar * ar + ai * ai) * F.col("_czz")) / n)
    j = j.withColumns({f"{f}_br": (c["su"] - ar * c["sx"] + ai * c["sy"]) / n, f"{f}_bi": (c["sv"] - ar * c["sy"] - ai * c["sx"]) / n, f"{f}_rms": F.when(hay, rms)})
    return j.drop(*[f"_{k}" for k in sumas], *centradas)


def _resto(f: str) -> Column:
    """Distance of a point (x, y, u, v) from where the fit in columns f_ar ... puts it."""
    ar, ai, br, bi = (F.col(f"{f}_{k}") for k in ("ar", "ai", "br", "bi"))
    return F.hypot(F.col("u") - (ar * F.col("x") - ai * F.col("y") + br), F.col("v") - (ar * F.col("y") + ai * F.col("x") + bi))


SUMAS = ("sx", "sy", "su", "sv", "zz", "ww", "re", "im")
PROPIOS = {"sx": "x", "sy": "y", "su": "u", "sv": "v", "zz": "x * x + y * y", "ww": "u * u + v * v", "re": "x * u + y * v", "im": "x * v - y * u"}


def sin_cada_una(p: DataFrame) -> DataFrame:
    """Points (plano, punto, x, y, u, v) with n and the sums of their plan, the fit of their plan without them (sin_ar ... sin_bi), the
    rms that is left then (rms) and their own distance from it (loo): the plan's sums less the point's terms, so no point meets another.
    Nulls in plans of fewer than three points."""
    w = Window.partitionBy("plano")
    j = p.select("*", F.count("*").over(w).alias("n"), *[F.sum(F.expr(e)).over(w).alias(k) for k, e in PROPIOS.items()])
    sin = {k: F.col(k) - F.expr(PROPIOS[k]) for k in SUMAS} | {"n": F.col("n") - 1}
    return _ajustado(j, "sin", sin, F.col("n") >= 3).withColumnRenamed("sin_rms", "rms").withColumn("loo", _resto("sin"))


def _umbrales(puntos: DataFrame, fuera: DataFrame) -> DataFrame:
    """For each left-out point of `fuera` (plano, punto, fit): threshold from the median residual of the others under that
    fit. One fit for each plan, or three for plans of three, so the rows are the points and no more than three times them."""
    otros = puntos.select("plano", F.col("punto").alias("otro"), "x", "y", "u", "v").join(fuera.select("plano", "punto", "sin_ar", "sin_ai", "sin_br", "sin_bi"), "plano").where("otro <> punto")
    medio = otros.groupBy("plano", "punto").agg(F.median(_resto("sin")).alias("medio"))
    return medio.select("plano", "punto", F.greatest(F.lit(FACTOR) * F.col("medio"), F.lit(PISO)).alias("umbral"))


def por_anclas(anclas: DataFrame) -> DataFrame:
    """Anchors (plano, punto, x, y on the sheet with y downwards, este, norte in metres) with residuo (under the fit of all of their
    plan), residuo_sin_ella, atipica, and the plan's escala, giro in degrees, rms_m and control: 'sin control' (two points),
    'inconsistente' (three that don't agree), 'atipicas', 'ok', or null (fewer than two, or all in one place).

    With four points or more the one whose absence leaves the others most in agreement (ties: the first) is set apart if it
    stands out, and so on with what is left, in all plans at once: a round drops at most one point of a plan and ends the plans
    that keep theirs, so there are as many rounds as a plan has outliers. A round shuffles the points once.
    """
    base = anclas.select("plano", "punto", F.col("x").cast("double").alias("x"), (-F.col("y")).cast("double").alias("y"), F.col("este").cast("double").alias("u"), F.col("norte").cast("double").alias("v")).where("x is not null and y is not null and u is not null and v is not null")
    # about each plan's first mean: sums of squares of large coordinates would lose the metres
    plano = Window.partitionBy("plano")
    puntos = base.where("plano is not null").select("plano", "punto", *[(F.col(c) - F.avg(c).over(plano)).alias(c) for c in "xyuv"])
    con = _ajustado(sin_cada_una(puntos), "de", {k: F.col(k) for k in (*SUMAS, "n")}, F.col("n") >= 2).withColumns({"sirve": F.col("de_ar").isNotNull(), "rms_m": F.when(F.col("de_ar").isNotNull() & (F.col("n") >= 3), F.col("de_rms"))})
    todos = _escrito(con.drop(*SUMAS, "de_rms"))
    tres = todos.where("n = 3")
    raras = [tres.join(_umbrales(tres, tres.where(F.col("loo") > PISO)), ["plano", "punto"]).where("loo > umbral").select("plano", "punto")]
    vivas, cada = None, todos.where("n >= 4")
    while True:
        # no point nearer than PISO stands out, so only the other plans need a median; a plan's rows stay in one place for the sums, the worst point and the others' residuals under its fit
        peor = F.min_by(F.struct("punto", "loo", *[F.col(f"sin_{k}").alias(k) for k in ("ar", "ai", "br", "bi")]), F.struct(F.round("rms", 9).alias("rms"), "punto"))
        con = cada.select("plano", "punto", "x", "y", "u", "v", peor.over(plano).alias("k")).select("*", "k.loo", *[F.col(f"k.{c}").alias(f"sin_{c}") for c in ("ar", "ai", "br", "bi")])
        medio = con.where(F.col("loo") > PISO).groupBy("plano").agg(F.median(F.when(F.col("punto") != F.col("k.punto"), _resto("sin"))).alias("medio"), F.first("k.punto").alias("fuera"), F.first("loo").alias("loo"))
        salen = _escrito(medio.where(F.col("loo") > F.greatest(F.lit(FACTOR) * F.col("medio"), F.lit(PISO))).where("medio is not null").select("plano", "fuera"))
        if salen.isEmpty():
            break
        raras.append(salen.withColumnRenamed("fuera", "punto"))
        quedan = cada if vivas is None else vivas
        antes, vivas = vivas, _escrito(quedan.join(salen, "plano").where(~F.col("punto").eqNullSafe(F.col("fuera"))).select("plano", "punto", "x", "y", "u", "v"))
        _borrar(antes)
        cada = sin_cada_una(vivas).where("n >= 4")
    _borrar(vivas)
    malas = raras[0]
    for r in raras[1:]:
        malas = malas.unionByName(r)
    malas = malas.groupBy("plano").agg(F.collect_set("punto").alias("malas"))
    control = F.when(~F.col("sirve"), None).when(F.col("n") == 2, "sin control").when((F.col("n") == 3) & F.col("malas").isNotNull(), "inconsistente").when(F.col("malas").isNotNull(), "atipicas").otherwise("ok")
    atipica = F.coalesce(F.array_contains("malas", F.col("punto")), F.lit(False)).alias("atipica")
    return todos.join(malas, "plano", "left").select("plano", "punto", _resto("de").alias("residuo"), F.col("loo").alias("residuo_sin_ella"), atipica, F.hypot("de_ar", "de_ai").alias("escala"), F.degrees(F.atan2("de_ai", "de_ar")).alias("giro"), "rms_m", control.alias("control"))


def etapas_por_descarte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of each project's three stages against a drawing that names one stage without prefix, one with its
    number and one with a letter."""
    k = F.col("p_partkey")
    lotes = table(spark, sf_dir, "part").select((k % 5).alias("grupo"), (F.floor(k / 5) % 3 + 1).cast("int").alias("etapa"), (F.floor(F.floor(k / 5) / 3) + 1).cast("string").alias("numero"), k)
    # stages differ in length, so that only the longest one holds all numbers of the others
    hay = F.col("numero").cast("int") <= 2 + F.floor(F.lit(40) * F.col("etapa") / (F.col("grupo") + 1))
    fichas = lotes.where(hay).select("grupo", F.concat_ws("-", F.col("etapa").cast("string"), "numero").alias("id"), "numero", "etapa")
    rotulo = F.when(F.col("etapa") == 1, F.col("numero")).when(F.col("etapa") == 2, F.concat(F.lit("2-"), "numero")).otherwise(F.concat(F.lit("A"), "numero"))
    ids = lotes.where(hay & (F.col("p_partkey") % 17 != 3)).select("grupo", rotulo.alias("id"))
    return alinear(fichas, ids)


def anclas_de_planos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as anchors of sheets (an order each, up to seven points), turned and scaled, some of them wrong by far."""
    li = table(spark, sf_dir, "lineitem").where("l_orderkey % 4 = 0")
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    x, y, g = F.col("l_partkey") % 997, F.col("l_suppkey") % 89 * 11, F.radians(F.col("l_orderkey") % 360)
    mal = F.when(F.col("l_partkey") % 13 == 0, 90.0).otherwise(F.pmod(F.col("l_partkey"), F.lit(5)) * 0.3)
    e = 300_000 + 0.5 * (x * F.cos(g) + y * F.sin(g)) + mal
    no = 6_000_000 + 0.5 * (x * F.sin(g) - y * F.cos(g)) - mal
    a = por_anclas(li.select(F.col("l_orderkey").alias("plano"), n.alias("punto"), x.alias("x"), y.alias("y"), e.alias("este"), no.alias("norte")))
    return a.select("plano", "punto", F.round("residuo", 4).alias("residuo"), F.round("residuo_sin_ella", 4).alias("residuo_sin_ella"), "atipica", F.round("escala", 6).alias("escala"), "control")


QUERIES = {f.__name__: f for f in (etapas_por_descarte, anclas_de_planos)}
ORACLES: dict[str, str] = {}
