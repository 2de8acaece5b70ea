"""Sheets onto published sites: all or nothing for each project.

A round compares the sheet's lots with the published ones in one full outer join, judges
every project and writes only those that changed. A project whose sheet names a lot that the
site hasn't, or no longer names one that only the sheet knew, is refused: it has to be built
anew, and its published rows stay. A project that fails doesn't stop the others.

Under `base`: `datos/<version>` (rows of the projects written in a round), `manifiesto/<version>`
(project -> version, all projects) and `actual/<number>` (one small file: the version in force).
Data and manifest are written first; a round takes effect when the file `actual/<number>` appears,
by a rename that fails if the number is taken. So a reader sees the old state or the new one, a lost
driver leaves only folders that nobody reads, and of two rounds at once the second one fails and
can be run again. Older versions may lack columns: they are read as nulls.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.functions.texto import orden_lote
from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import shared_folder

#: What a sheet decides of a lot (fixed values: names and kinds of the published fields).
COMERCIALES = {
    "estado": "string", "superficie_m2": "double", "servidumbre_m": "double", "servidumbre_m2": "double", "precio": "double",
    "moneda": "string", "link_pago": "string", "en_planilla": "boolean", "rol": "string", "topografia": "string", "pie": "double",
    "cuotas": "int", "valor_cuota": "double", "reserva": "double", "sin_numero": "boolean",
}
CLAVE = ["proyecto_id", "id"]
#: Lots named in a refusal.
NOMBRADOS = 10
#: Parts of a project whose first lots are sought apart.
PARTES = 32


class OtraVuelta(RuntimeError):
    """Another round took effect meanwhile; run this one again."""


def completas(df: DataFrame, columnas: dict[str, str]) -> DataFrame:
    """df with these columns, those that it lacks as nulls."""
    vacias = df.sparkSession.createDataFrame([], ", ".join(f"{c} {t}" for c, t in columnas.items()))
    unidas = vacias.unionByName(df, allowMissingColumns=True)
    return unidas.select(*[F.col(c).cast(columnas.get(c, unidas.schema[c].dataType)) for c in unidas.columns])


def fichas(planilla: DataFrame) -> DataFrame:
    """The sheet's legible rows; of several for one lot the last one by `fila`."""
    p = completas(planilla, {"proyecto_id": "long", "id": "string", "fila": "long", "mostrar_numero": "boolean"} | {c: t for c, t in COMERCIALES.items() if c not in ("en_planilla", "sin_numero")})
    datos = [c for c in p.columns if c not in CLAVE]
    return p.where("proyecto_id is not null and id is not null").groupBy(*CLAVE).agg(F.max_by(F.struct(*datos), F.struct("fila", *[c for c in datos if c != "fila"])).alias("f")).select(*CLAVE, "f.*")


def comerciales(ficha: Column, hay: Column, estado: Column, en_planilla: Column, area: Column) -> dict[str, Column]:
    """The commercial fields of a lot with a sheet row (`hay`), or without: not available, or not
    for sale if the drawing said so, with the drawing's surface."""
    no_en_venta = (estado == "no_en_venta") & ~F.coalesce(en_planilla, F.lit(False))
    sin = {"estado": F.when(F.coalesce(no_en_venta, F.lit(False)), "no_en_venta").otherwise("no_disponible"), "superficie_m2": area.cast("double"), "moneda": F.lit("CLP"), "en_planilla": F.lit(False), "sin_numero": F.lit(None).cast("boolean")}
    con = {"en_planilla": F.lit(True), "sin_numero": F.when(~F.coalesce(ficha["mostrar_numero"], F.lit(True)), True)}
    return {c: F.when(hay, con[c] if c in con else ficha[c]).otherwise(sin.get(c, F.lit(None).cast(t))) for c, t in COMERCIALES.items()}


def comparar(sitio: DataFrame, hojas: DataFrame) -> DataFrame:
    """Every lot of either side: the site's columns, en_sitio, en_ficha, nuevo (the commercial
    fields by the sheet) and cambia (some of them differs, nulls being equal)."""
    s = completas(sitio, {"proyecto_id": "long", "id": "string", "area_kmz_m2": "double", "dibujada": "boolean"} | COMERCIALES)
    a, b = s.withColumn("en_sitio", F.lit(True)).alias("a"), hojas.withColumn("en_ficha", F.lit(True)).alias("b")
    hay = F.col("b.en_ficha").isNotNull()
    nuevo = comerciales(F.struct("b.*"), hay, F.col("a.estado"), F.col("a.en_planilla"), F.col("a.area_kmz_m2"))
    j = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in CLAVE], "full_outer")
    igual = F.lit(True)
    for c, x in nuevo.items():
        igual = igual & F.col(f"a.{c}").eqNullSafe(x)
    clave = [F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in CLAVE]
    resto = [F.col(f"a.{c}").alias(c) for c in s.columns if c not in CLAVE]
    return j.select(*clave, *resto, F.col("a.en_sitio").isNotNull().alias("en_sitio"), hay.alias("en_ficha"), F.struct(*[x.alias(c) for c, x in nuevo.items()]).alias("nuevo"), (~igual).alias("cambia"))


def faltantes(comparado: DataFrame) -> DataFrame:
    """Lots that the site can't show without being built anew: of the sheet only, or no longer in it and never drawn."""
    sobra = F.col("en_sitio") & ~F.col("en_ficha") & ~F.coalesce("dibujada", F.lit(False))
    return comparado.where(~F.col("en_sitio") | sobra).select(*CLAVE, F.when(sobra, "sobra").otherwise("falta").alias("motivo"))


def revisiones(sitio: DataFrame, planilla: DataFrame, comparado: DataFrame) -> DataFrame:
    """One row per project with sheet rows: proyecto_id, resultado ('sin construir', 'ilegible',
    'reconstruir', 'sin cambios', 'al dia'), cambiadas, n_faltan and primeras: the first lots that are
    missing, those of the sheet before the orphans, by stage and number."""
    suyas = completas(planilla, {"proyecto_id": "long", "id": "string"}).where("proyecto_id is not null")
    leidas = suyas.groupBy("proyecto_id").agg(F.count("id").alias("legibles"))
    construidos = sitio.groupBy("proyecto_id").agg(F.count("*").alias("n_sitio"))
    cuenta = comparado.groupBy("proyecto_id").agg(F.count_if(F.col("en_sitio") & F.col("cambia")).alias("cambiadas"))
    malas = faltantes(comparado).withColumn("orden", F.struct((F.col("motivo") == "sobra").alias("sobra"), orden_lote(F.col("id")).alias("n"), "id"))
    # the first ones of each part, then of the project: no project's rows are sorted in one task
    parte = F.pmod(F.xxhash64("id"), F.lit(PARTES))
    por_parte = malas.withColumn("lugar", F.row_number().over(Window.partitionBy("proyecto_id", parte).orderBy("orden"))).where(F.col("lugar") <= NOMBRADOS)
    primeras = por_parte.groupBy("proyecto_id").agg(F.slice(F.array_sort(F.collect_list("orden")), 1, NOMBRADOS)["id"].alias("primeras"))
    todas = malas.groupBy("proyecto_id").agg(F.count("*").alias("n_faltan"))
    j = leidas.join(construidos, "proyecto_id", "left").join(cuenta, "proyecto_id", "left").join(todas, "proyecto_id", "left").join(primeras, "proyecto_id", "left")
    resultado = F.when(F.col("n_sitio").isNull(), "sin construir").when(F.col("legibles") == 0, "ilegible").when(F.col("n_faltan") > 0, "reconstruir").when(F.col("cambiadas") > 0, "al dia").otherwise("sin cambios")
    aplica = resultado == "al dia"
    return j.select("proyecto_id", resultado.alias("resultado"), F.when(aplica, F.col("cambiadas")).otherwise(0).cast("long").alias("cambiadas"), F.coalesce("n_faltan", F.lit(0)).alias("n_faltan"), F.coalesce("primeras", F.array().cast("array<string>")).alias("primeras"))


def resumen(publicado: DataFrame) -> DataFrame:
    """Per project and state: lots, those that are drawn and those that some view shows."""
    p = completas(publicado, {"proyecto_id": "long", "estado": "string", "dibujada": "boolean", "vistas": "array<string>"})
    return p.groupBy("proyecto_id", "estado").agg(F.count("*").alias("n"), F.count_if("dibujada").alias("con_geometria"), F.count_if(F.size(F.coalesce("vistas", F.array().cast("array<string>"))) > 0).alias("con_vista"))


class Sitio:
    """The published sites under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._ruta = jvm, lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._ruta(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numero(self) -> int:
        """Number of the state in force; 0 before the first one."""
        carpeta = self._ruta(f"{self.base}/actual")
        if not self._fs.exists(carpeta):
            return 0
        nombres = [f.getPath().getName() for f in self._fs.listStatus(carpeta)]
        return max((int(n) for n in nombres if n.isdigit()), default=0)

    def _manifiesto(self, numero: int) -> DataFrame:
        if not numero:
            return self.spark.createDataFrame([], "proyecto_id long, version string")
        version = self.spark.read.text(f"{self.base}/actual/{numero:012d}").first()[0]
        return self.spark.read.parquet(f"{self.base}/manifiesto/{version}")

    def leer(self, numero: int | None = None) -> DataFrame:
        """The lots in force (or those of an earlier number that is still there)."""
        numero = self.numero() if numero is None else numero
        m = self._manifiesto(numero)
        versiones = [r[0] for r in m.select("version").distinct().collect()]  # at most one per round
        if not versiones:
            return self.spark.createDataFrame([], "proyecto_id long, id string")
        datos = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.base}/datos").parquet(*[f"{self.base}/datos/version={v}" for v in versiones])
        return datos.join(m, ["proyecto_id", "version"], "left_semi").drop("version")

    def publicar(self, lotes: DataFrame, desde: int | None = None) -> int:
        """The projects of `lotes` in force with exactly these rows, the others as they are; the new number."""
        desde = self.numero() if desde is None else desde
        version = f"{desde + 1:012d}-{uuid.uuid4().hex}"
        lotes.write.parquet(f"{self.base}/datos/version={version}")
        nuevos = self.spark.read.parquet(f"{self.base}/datos/version={version}").select("proyecto_id").distinct()
        quedan = self._manifiesto(desde).join(nuevos, "proyecto_id", "left_anti")
        quedan.unionByName(nuevos.withColumn("version", F.lit(version))).coalesce(1).write.parquet(f"{self.base}/manifiesto/{version}")
        self._poner(desde + 1, version)
        return desde + 1

    def _poner(self, numero: int, version: str) -> None:
        borrador, destino = self._ruta(f"{self.base}/actual/.{version}"), self._ruta(f"{self.base}/actual/{numero:012d}")
        salida = self._fs.create(borrador, True)
        salida.write(bytearray(version.encode()))
        salida.close()
        contexto = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(borrador.toUri() if borrador.isAbsolute() and borrador.toUri().getScheme() else self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        opciones = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            contexto.rename(self._fs.makeQualified(borrador), self._fs.makeQualified(destino), opciones)
        except Exception as error:
            self._fs.delete(borrador, False)
            if "FileAlreadyExists" in str(error):
                raise OtraVuelta(f"number {numero} is taken") from error
            raise

    def sincronizar(self, planilla: DataFrame, vuelta: str | None = None) -> DataFrame:
        """One round: judges the sheet's projects, publishes those that changed, and returns the
        written judgements (under `revisiones/<vuelta>`; the same round again replaces its own)."""
        desde = self.numero()
        sitio = self.leer(desde)
        comparado = comparar(sitio, fichas(planilla))
        camino = f"{self.base}/revisiones/{vuelta or uuid.uuid4().hex}"
        revisiones(sitio, planilla, comparado).write.mode("overwrite").parquet(camino)
        dichas = self.spark.read.schema("proyecto_id long, resultado string, cambiadas long, n_faltan long, primeras array<string>").parquet(camino)
        cambian = dichas.where("resultado = 'al dia'")
        if not cambian.isEmpty():
            filas = comparado.join(cambian.select("proyecto_id"), "proyecto_id", "left_semi")
            quedan = [c for c in filas.columns if c not in (*COMERCIALES, "en_sitio", "en_ficha", "nuevo", "cambia")]
            self.publicar(filas.select(*quedan, "nuevo.*"), desde)
        return dichas

    def vigilar(self, llegan: DataFrame, control: str, cada: str | None = "15 minutes"):
        """Rounds over the sheets that arrive as a stream, every so often (None: over what is there, once)."""
        escribe = llegan.writeStream.foreachBatch(lambda lote, n: self.sincronizar(lote, f"lote-{n}")).option("checkpointLocation", control)
        return (escribe.trigger(processingTime=cada) if cada else escribe.trigger(availableNow=True)).start()


def sitio_de_prueba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lots as a published site: those whose id 7 divides are known from the sheet only."""
    p = parcelas(spark, sf_dir)
    return p.where("id % 9 <> 1").select(
        "proyecto_id", F.concat_ws("-", "etapa", "id").alias("id"), F.when((F.col("id") % 29 == 0), "no_en_venta").otherwise(F.col("estado")).alias("estado"), "precio", "moneda",
        F.col("superficie").cast("double").alias("superficie_m2"), (F.col("id") * 10.0).alias("area_kmz_m2"), (F.col("id") % 7 != 0).alias("dibujada"), (F.col("id") % 29 != 0).alias("en_planilla"),
    )


def planilla_de_prueba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet of the same lots: some sold meanwhile, some gone; lots that the site hasn't in every fifth
    project; nothing legible in project 3; projects from 20 on unchanged, 24 not named."""
    p = parcelas(spark, sf_dir).where("proyecto_id <> 24 and id % 29 <> 0 and (id % 9 <> 1 or proyecto_id % 5 = 0) and (id % 11 <> 5 or id % 7 = 0 or proyecto_id >= 20)")
    vendida = (F.col("id") % 17 == 0) & (F.col("proyecto_id") < 20)
    return p.select(
        "proyecto_id", F.when(F.col("proyecto_id") != 3, F.concat_ws("-", "etapa", "id")).alias("id"), F.when(vendida, "vendido").otherwise(F.col("estado")).alias("estado"), "precio", "moneda",
        F.col("superficie").cast("double").alias("superficie_m2"), F.col("id").alias("fila"),
    )


def revision_de_planillas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each project's judgement in one round."""
    sitio, planilla = sitio_de_prueba(spark, sf_dir), planilla_de_prueba(spark, sf_dir)
    r = revisiones(sitio, planilla, comparar(sitio, fichas(planilla)))
    return r.select("proyecto_id", "resultado", "cambiadas", "n_faltan", F.array_join("primeras", ",").alias("primeras"))


def publicado_tras_planillas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published lots after the first publication, a round and the same round again."""
    sitio = Sitio(spark, shared_folder(spark))
    sitio.publicar(sitio_de_prueba(spark, sf_dir))
    planilla = planilla_de_prueba(spark, sf_dir)
    sitio.sincronizar(planilla)
    sitio.sincronizar(planilla)
    return sitio.leer().select("proyecto_id", "id", "estado", "precio", "moneda", "superficie_m2", "en_planilla", F.lit(sitio.numero()).alias("numero"))


_BASE = f"""
  p AS (SELECT *, etapa || '-' || id AS lote FROM {PARCELAS_SQL}),
  sitio AS (SELECT proyecto_id, id AS n, lote, CASE WHEN id % 29 = 0 THEN 'no_en_venta' ELSE estado END AS estado, precio, moneda, CAST(superficie AS DOUBLE) AS superficie_m2, id % 29 <> 0 AS en_planilla FROM p WHERE id % 9 <> 1),
  hoja AS (
    SELECT proyecto_id, id AS n, CASE WHEN proyecto_id <> 3 THEN lote END AS lote, CASE WHEN id % 17 = 0 AND proyecto_id < 20 THEN 'vendido' ELSE estado END AS estado, precio, moneda, CAST(superficie AS DOUBLE) AS superficie_m2
    FROM p WHERE proyecto_id <> 24 AND id % 29 <> 0 AND (id % 9 <> 1 OR proyecto_id % 5 = 0) AND (id % 11 <> 5 OR id % 7 = 0 OR proyecto_id >= 20)),
  nuevo AS (
    SELECT s.proyecto_id, s.lote, s.n, coalesce(h.estado, CASE WHEN s.estado = 'no_en_venta' AND NOT s.en_planilla THEN 'no_en_venta' ELSE 'no_disponible' END) AS estado,
           h.precio, coalesce(h.moneda, 'CLP') AS moneda, CASE WHEN h.lote IS NULL THEN s.n * 10.0 ELSE h.superficie_m2 END AS superficie_m2, h.lote IS NOT NULL AS en_planilla,
           s.estado AS a_estado, s.precio AS a_precio, s.moneda AS a_moneda, s.superficie_m2 AS a_superficie, s.en_planilla AS a_en
    FROM sitio s LEFT JOIN hoja h ON h.proyecto_id = s.proyecto_id AND h.lote = s.lote),
  cambios AS (
    SELECT proyecto_id, count(*) FILTER ((estado, precio, moneda, superficie_m2, en_planilla) IS DISTINCT FROM (a_estado, a_precio, a_moneda, a_superficie, a_en)) AS n FROM nuevo GROUP BY proyecto_id),
  malas AS (
    SELECT proyecto_id, lote, n, split_part(lote, '-', 1)::INT AS e, false AS sobra FROM hoja WHERE lote IS NOT NULL AND (proyecto_id, lote) NOT IN (SELECT proyecto_id, lote FROM sitio)
    UNION ALL SELECT proyecto_id, lote, n, split_part(lote, '-', 1)::INT, true FROM nuevo WHERE NOT en_planilla AND n % 7 = 0),
  faltan AS (SELECT proyecto_id, count(*) AS n, array_to_string(list(lote ORDER BY sobra, e, n)[1:10], ',') AS primeras FROM malas GROUP BY proyecto_id),
  juicio AS (
    SELECT h.proyecto_id, CASE WHEN s.n IS NULL THEN 'sin construir' WHEN legibles = 0 THEN 'ilegible' WHEN f.n > 0 THEN 'reconstruir' WHEN c.n > 0 THEN 'al dia' ELSE 'sin cambios' END AS resultado,
           c.n AS cambios, coalesce(f.n, 0) AS n_faltan, coalesce(primeras, '') AS primeras
    FROM (SELECT proyecto_id, count(lote) AS legibles FROM hoja GROUP BY proyecto_id) h LEFT JOIN (SELECT proyecto_id, count(*) AS n FROM sitio GROUP BY proyecto_id) s USING (proyecto_id)
    LEFT JOIN cambios c USING (proyecto_id) LEFT JOIN faltan f USING (proyecto_id))"""
QUERIES = {f.__name__: f for f in (revision_de_planillas, publicado_tras_planillas)}
ORACLES = {
    "revision_de_planillas": f"""
  WITH {_BASE}
  SELECT proyecto_id, resultado, CASE WHEN resultado = 'al dia' THEN cambios ELSE 0 END AS cambiadas, n_faltan, primeras FROM juicio""",
    "publicado_tras_planillas": f"""
  WITH {_BASE},
  aplica AS (SELECT proyecto_id FROM juicio WHERE resultado = 'al dia')
  SELECT proyecto_id, lote AS id, estado, precio, moneda, superficie_m2, en_planilla, 2 AS numero FROM nuevo WHERE proyecto_id IN (SELECT * FROM aplica)
  UNION ALL SELECT proyecto_id, lote, estado, precio, moneda, superficie_m2, en_planilla, 2 FROM sitio WHERE proyecto_id NOT IN (SELECT * FROM aplica)""",
}
