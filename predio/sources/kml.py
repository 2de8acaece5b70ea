"""Drawings as KML or KMZ files, to tables.

Files are read as binary rows and unpacked one by one (`archivos`), or plain ones in pieces of one placemark, so
that a drawing may be larger than a task's memory (`trozos`); a drawing's placemarks become rows at once, so
what follows is spread over tasks whatever the size of a drawing. Placemarks are read with Spark's XML
functions. What can't be read ends in `rechazados`, with its reason, and stops nothing.

A placemark is routed by its name: water, zones, roads (only in a drawing without other lines),
stage labels, lot labels, and what is left: lots and lines. Multi-geometries are read to
two levels; a ring loses its last point if it repeats the first one.

Defined results: a file that is no archive is taken as KML itself; of several KML in an archive the
first one counts; text that isn't UTF-8 loses the bytes that aren't; a drawing without placemarks has
no rows; a shape without coordinates is none; a placemark that isn't XML is rejected, the others stay;
a point with a broken number is left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.functions import espacio, texto
from predio.session import shared_folder

#: Names that tell what a placemark is (fixed values: words that must match).
AGUA = r"(?iu)^\s*(estero|r[ií]o|quebrada|canal|arroyo|acequia|vertiente)(?![\p{L}\p{N}_])"
ZONA = r"(?iu)^\s*((zona\s+(de|protegida)|[aá]reas?\s+(verdes?|de)|reserva|conservaci[oó]n)(?![\p{L}\p{N}_])|bosque\s+nativo(?![\p{L}\p{N}_]))"
CAMINO = r"(?iu)^\s*(servidumbres?|caminos?|accesos?)(?![\p{L}\p{N}_])"
NO_EN_VENTA = "NO EN VENTA"
#: What ends a piece of a plain file.
FIN = "</Placemark>"
_TRAZO = "struct<coordinates:string>"
_POLIGONO = f"struct<outerBoundaryIs:struct<LinearRing:{_TRAZO}>,innerBoundaryIs:array<struct<LinearRing:{_TRAZO}>>>"
_FORMAS = {"Point": f"array<{_TRAZO}>", "LineString": f"array<{_TRAZO}>", "Polygon": f"array<{_POLIGONO}>"}
_dentro = lambda campos: "array<struct<" + ",".join(f"{k}:{v}" for k, v in campos.items()) + ">>"
_CAMPOS = {"name": "string", "description": "string", "styleUrl": "string", "Style": "array<struct<LineStyle:struct<color:string>>>", **_FORMAS, "MultiGeometry": _dentro(_FORMAS | {"MultiGeometry": _dentro(_FORMAS)}), "_mala": "string"}
MARCA = ", ".join(f"{k} {v}" for k, v in _CAMPOS.items())
ESTILO = "_id string, LineStyle struct<color:string>, PolyStyle struct<color:string>, Pair array<struct<key:string,styleUrl:string>>, _mala string"


def archivos(spark: SparkSession, ruta: str | list[str]) -> DataFrame:
    """archivo, kml, motivo (why there is no KML): one row per file. Only archives and text that isn't UTF-8 go to Python, where
    a file stands in memory several times."""

    def abrir(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for nombre, datos in zip(*(b.column(c) for c in ("path", "content"))):
                kml, motivo, datos = None, None, datos.as_py()
                if datos[:2] == b"PK":
                    try:
                        with zipfile.ZipFile(io.BytesIO(datos)) as z:
                            dentro = [n for n in z.namelist() if n.lower().endswith(".kml")]
                            kml, motivo = (z.read(dentro[0]), None) if dentro else (None, "no kml inside")
                    except Exception as error:  # noqa: BLE001  whatever is wrong with one archive
                        motivo = f"broken archive: {type(error).__name__}"
                else:
                    kml = datos
                if kml is not None:
                    kml = kml.decode("utf-8", "ignore")
                yield pa.RecordBatch.from_arrays([pa.array([nombre.as_py()]), pa.array([kml], pa.string()), pa.array([motivo], pa.string())], ["archivo", "kml", "motivo"])

    leidos = spark.read.format("binaryFile").load(ruta).select("path", "content")
    llano = (F.hex(F.substring("content", 1, 2)) != "504B") & F.is_valid_utf8(F.col("content").cast("string"))
    llanos = leidos.where(llano).select(F.col("path").alias("archivo"), F.col("content").cast("string").alias("kml"), F.lit(None).cast("string").alias("motivo"))
    return llanos.unionByName(leidos.where(~llano).mapInArrow(abrir, "archivo string, kml string, motivo string"))


def trozos(spark: SparkSession, ruta: str) -> DataFrame:
    """archivo, trozo, kml, motivo: as archivos(), but a plain file is a row for each placemark, with its place in the file as
    `trozo`, and what follows the last one. The pieces are written once, so that their places don't depend on
    how a later job splits the files. A file that can't be cut so stays one row: an archive, any other name than .kml or .txt,
    text that isn't UTF-8, comments over more than one piece, placemarks with prefixes or without an end."""
    carpeta = f"{shared_folder(spark)}/trozos"
    valor, fuera = F.col("value"), F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    entera = valor.startswith("PK") | ~F.is_valid_utf8("value") | fuera.contains("<!--")
    leidas = spark.read.option("lineSep", FIN).option("pathGlobFilter", "*.{[kK][mM][lL],[tT][xX][tT]}").text(ruta).select(F.col("_metadata.file_path").alias("archivo"), F.col("_metadata.file_block_start").alias("bloque"), F.monotonically_increasing_id().alias("n"), "value")
    leidas = leidas.withColumn("una", F.size(_elementos(F.concat("value", F.lit(FIN)), "Placemark")) == 1).withColumn("entera", entera)
    leidas.withColumn("value", F.when(~F.col("entera"), valor)).write.parquet(carpeta)
    filas = spark.read.parquet(carpeta)
    # a piece's place: the rows of its file's blocks before, and of its block; only a file's last piece is without a placemark
    bloques = filas.groupBy("archivo", "bloque").agg(F.min("n").alias("primera"), F.count("*").alias("filas"), F.count_if(~F.col("una")).alias("sin"), F.max_by("una", "n").alias("ultima"), F.bool_or("entera").alias("entera"))
    w = Window.partitionBy("archivo")
    bloques = bloques.select("archivo", "bloque", "primera", F.coalesce(F.sum("filas").over(w.orderBy("bloque").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("antes"), F.sum("filas").over(w).alias("todas"), "sin", "ultima", "entera")
    sirve = ~F.bool_or("entera").over(w) & (F.sum("sin").over(w) == 1) & ~F.max_by("ultima", "bloque").over(w)
    # _metadata writes names as addresses
    nombres = spark.read.format("binaryFile").load(ruta).select("path", F.col("_metadata.file_path").alias("archivo"))
    bloques = nombres.join(bloques.select("archivo", "bloque", "primera", "antes", "todas", sirve.alias("sirve")), "archivo", "left")
    bloques.write.parquet(f"{carpeta}-bloques")
    bloques = spark.read.parquet(f"{carpeta}-bloques")
    lugar = F.col("antes") + F.col("n") - F.col("primera")
    en_trozos = filas.join(bloques.where("sirve"), ["archivo", "bloque"]).select(F.col("path").alias("archivo"), lugar.alias("trozo"), F.concat("value", F.when(lugar < F.col("todas") - 1, FIN).otherwise("")).alias("kml"), F.lit(None).cast("string").alias("motivo"))
    # names only; the driver has listed them all before
    resto = [re.sub(r"([\\\[\]{}*?])", r"\\\1", r.path) for r in bloques.where("not coalesce(sirve, false)").select("path").distinct().collect()]
    if not resto:
        return en_trozos
    return en_trozos.unionByName(archivos(spark, resto).withColumn("trozo", F.lit(0).cast("long")))


def _elementos(kml: Column, nombre: str) -> Column:
    """The source of every element of that name, outermost ones, without prefixes; comments left out."""
    limpio = F.regexp_replace(F.regexp_replace(kml, r"(?s)<!--.*?-->", ""), r"<(/?)[A-Za-z_][\w.-]*:(?=[A-Za-z])", "<$1")
    return F.regexp_extract_all(limpio, F.lit(rf"(?s)<{nombre}(?:\s[^>]*)?(?<!/)>.*?</{nombre}\s*>"), 0)


def puntos(coordenadas: Column, cerrado: bool = False) -> Column:
    """array<struct<x, y>> (longitude, latitude) of a coordinates text; an outline without its repeated end."""
    partes = F.transform(F.split(F.trim(F.coalesce(coordenadas, F.lit(""))), r"\s+"), lambda t: F.split(t, ","))
    xy = F.transform(partes, lambda t: F.struct(F.get(t, F.lit(0)).try_cast("double").alias("x"), F.get(t, F.lit(1)).try_cast("double").alias("y")))
    sanos = F.filter(xy, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    if not cerrado:
        return sanos
    return espacio._con(sanos, lambda s: F.when((F.size(s) > 2) & (F.get(s, F.lit(0)) == F.element_at(s, -1)), F.slice(s, 1, F.size(s) - 1)).otherwise(s))


def _todas(m: Column, forma: str) -> Column:
    """A placemark's shapes of one kind, those in multi-geometries too."""
    nada = F.lit(None)
    multi = m["MultiGeometry"]
    hondas = F.flatten(F.transform(F.flatten(F.transform(multi, lambda g: F.coalesce(g["MultiGeometry"], F.array()))), lambda g: F.coalesce(g[forma], F.array())))
    dentro = F.flatten(F.transform(multi, lambda g: F.coalesce(g[forma], F.array())))
    juntas = [F.coalesce(x, F.array()) for x in (m[forma], F.when(multi.isNotNull(), dentro).otherwise(nada), F.when(multi.isNotNull(), hondas).otherwise(nada))]
    return F.concat(*juntas)


def _colores(kmls: DataFrame) -> DataFrame:
    """archivo, estilo, color (aabbggrr): a line's color or else the filling's; of a map that of its normal style."""
    leer = lambda nombre: kmls.where(F.contains("kml", F.lit(nombre))).select("archivo", F.explode(_elementos(F.col("kml"), nombre)).alias("x")).select("archivo", F.from_xml("x", ESTILO, {"rowTag": nombre, "columnNameOfCorruptRecord": "_mala"}).alias("e"))
    propios = leer("Style").where("e._id is not null").select("archivo", F.col("e._id").alias("estilo"), F.upper(F.trim(F.coalesce("e.LineStyle.color", "e.PolyStyle.color"))).alias("color")).where("color <> ''")
    propios = propios.groupBy("archivo", "estilo").agg(F.max("color").alias("color"))
    normal = F.get(F.filter("e.Pair", lambda p: p["key"] == "normal"), F.lit(0))["styleUrl"]
    mapas = leer("StyleMap").where("e._id is not null").select("archivo", F.col("e._id").alias("mapa"), F.regexp_replace(F.trim(normal), "^#+", "").alias("estilo"))
    mapas = mapas.groupBy("archivo", "mapa").agg(F.max("estilo").alias("estilo"))
    return propios.unionByName(mapas.join(propios, ["archivo", "estilo"]).select("archivo", F.col("mapa").alias("estilo"), "color")).groupBy("archivo", "estilo").agg(F.max("color").alias("color"))


def marcas(kmls: DataFrame) -> DataFrame:
    """archivo, orden, xml and m (its fields) of every placemark of archivos() or trozos(); m._mala if it isn't XML."""
    antes = [F.col("trozo")] if "trozo" in kmls.columns else []
    cada = kmls.where("kml is not null").select("archivo", *antes, F.posexplode(_elementos(F.col("kml"), "Placemark")).alias("orden", "xml"))
    cada = cada.withColumn("orden", sum(antes, F.col("orden")))
    return cada.select("archivo", "orden", "xml", F.from_xml("xml", MARCA, {"rowTag": "Placemark", "columnNameOfCorruptRecord": "_mala"}).alias("m"))


def rechazados(kmls: DataFrame) -> DataFrame:
    """archivo, orden (null: the whole file), motivo."""
    entero = kmls.groupBy("archivo").agg(F.bool_or(F.coalesce(F.rlike("kml", F.lit(r"<[^>]*\bkml\b")), F.lit(False))).alias("es"), F.max("motivo").alias("motivo"))
    entero = entero.where("not es").select("archivo", F.lit(None).cast("int").alias("orden"), F.coalesce("motivo", F.lit("no kml element")).alias("motivo"))
    return entero.unionByName(marcas(kmls).where("m._mala is not null or m is null").select("archivo", "orden", F.lit("broken placemark").alias("motivo")))


def rasgos(kmls: DataFrame) -> DataFrame:
    """Every shape of every placemark: archivo, orden, parte (its place among the placemark's shapes of
    that kind), tipo (L line, A outline, P point), capa (the description), nombre, descripcion, color,
    puntos and huecos (rings inside an outline)."""
    m = F.col("m")
    linea = F.transform(_todas(m, "LineString"), lambda x: F.struct(F.lit("L").alias("tipo"), puntos(x["coordinates"]).alias("puntos"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("huecos")))
    hueco = lambda x: F.filter(F.transform(F.coalesce(x["innerBoundaryIs"], F.array()), lambda h: puntos(h["LinearRing"]["coordinates"], True)), lambda h: F.size(h) >= 3)
    area = F.transform(_todas(m, "Polygon"), lambda x: F.struct(F.lit("A").alias("tipo"), puntos(x["outerBoundaryIs"]["LinearRing"]["coordinates"], True).alias("puntos"), hueco(x).alias("huecos")))
    punto = F.transform(_todas(m, "Point"), lambda x: F.struct(F.lit("P").alias("tipo"), F.slice(puntos(x["coordinates"]), 1, 1).alias("puntos"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("huecos")))
    sanas = marcas(kmls).where("m is not null and m._mala is null")
    texto_de = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    propio = F.upper(F.trim(F.get(F.filter(F.transform("m.Style", lambda s: s["LineStyle"]["color"]), lambda c: c.isNotNull()), F.lit(0))))
    base = sanas.select("archivo", "orden", texto_de("m.name").alias("nombre"), texto_de("m.description").alias("descripcion"), F.regexp_replace(texto_de("m.styleUrl"), "^#+", "").alias("estilo"), propio.alias("propio"), *[F.filter(x, lambda s: F.size(s["puntos"]) > 0).alias(n) for n, x in (("l", linea), ("a", area), ("p", punto))])
    con = base.join(_colores(kmls.where("kml is not null")), ["archivo", "estilo"], "left")
    color = F.when(F.col("estilo") != "", F.col("color")).otherwise(F.col("propio"))
    formas = F.concat(*[F.transform(n, lambda s, i: F.struct(i.alias("parte"), s["tipo"].alias("tipo"), s["puntos"].alias("puntos"), s["huecos"].alias("huecos"))) for n in ("l", "a", "p")])
    return con.select("archivo", "orden", "nombre", "descripcion", color.alias("color"), F.inline(formas)).select("archivo", "orden", "parte", "tipo", F.col("descripcion").alias("capa"), "nombre", "descripcion", "color", "puntos", "huecos")


def dibujo(formas: DataFrame) -> DataFrame:
    """rasgos() with what each shape is: `clase` agua, zona, camino, etapa, etiqueta, lote, linea or otro;
    lote (normal id), etapa, en_venta; es_cad (the drawing has lines besides water and named roads: its lots
    are to be closed from lines) and, with es_cad, roads by name stay lines, since a lot's border may be one.
    A zone's lines and points and the water's points are `otro`."""
    nombre = F.col("nombre")
    es = lambda patron: nombre.rlike(patron)
    es_linea = F.col("tipo") == "L"
    cad = formas.where(es_linea & ~es(AGUA) & ~es(CAMINO)).select("archivo").distinct().withColumn("es_cad", F.lit(True))
    de_zona = formas.where((F.col("tipo") == "A") & es(ZONA)).select("archivo", "orden").distinct().withColumn("de_zona", F.lit(True))
    con = formas.join(cad, "archivo", "left").join(de_zona, ["archivo", "orden"], "left").withColumn("es_cad", F.coalesce("es_cad", F.lit(False)))
    etapa, lote = texto.etapa(nombre), texto.lote_id(nombre)
    es_punto = F.col("tipo") == "P"
    clase = (
        F.when(es(AGUA), F.when(es_punto, "otro").otherwise("agua"))
        .when(F.col("de_zona").isNotNull(), F.when(F.col("tipo") == "A", "zona").otherwise("otro"))
        .when(es(CAMINO) & ~F.col("es_cad"), F.when(es_punto, "otro").otherwise("camino"))
        .when(es_punto, F.when(etapa.isNotNull(), "etapa").when(lote.isNotNull(), "etiqueta").otherwise("otro"))
        .when(es_linea, "linea").otherwise("lote")
    )
    return con.withColumns({
        "clase": clase, "etapa": F.when(clase.isin("etapa", "lote"), etapa), "lote": F.when((clase == "etiqueta") | ((clase == "lote") & etapa.isNull()), lote),
        "en_venta": F.when(clase == "lote", ~F.upper("descripcion").contains(NO_EN_VENTA)),
    }).drop("de_zona")


def aguas(partes: DataFrame) -> DataFrame:
    """Streams and canals of a dibujo(): archivo, nombre, puntos; an outline is closed again."""
    trazo = F.when(F.col("tipo") == "A", F.concat("puntos", F.slice("puntos", 1, 1))).otherwise(F.col("puntos"))
    return partes.where("clase = 'agua'").select("archivo", "orden", F.regexp_replace("nombre", r"\s+", " ").alias("nombre"), trazo.alias("puntos")).where("size(puntos) >= 2")


def zonas(partes: DataFrame) -> DataFrame:
    """Named zones: archivo, nombre, puntos of the outline."""
    return partes.where("clase = 'zona' and size(puntos) >= 3").select("archivo", "orden", F.regexp_replace("nombre", r"\s+", " ").alias("nombre"), "puntos")


def caminos(partes: DataFrame) -> DataFrame:
    """Named roads of drawings without other lines: strips with the rings inside, or axes."""
    return partes.where("clase = 'camino' and size(puntos) >= if(tipo = 'A', 3, 2)").select("archivo", "orden", "nombre", F.when(F.col("tipo") == "A", "franja").otherwise("eje").alias("forma"), "puntos", "huecos")


# --- writing -------------------------------------------------------------------------


def escapado(x: Column) -> Column:
    """Text for XML: its five signs as entities, control characters left out."""
    sin = F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for signo, entidad in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        sin = F.replace(sin, F.lit(signo), F.lit(entidad))
    return sin


def coordenadas(pts: Column, cerrado: bool = False, decimales: int = 7) -> Column:
    """Points as KML writes them; an outline with its first point again at the end."""
    todos = F.concat(pts, F.slice(pts, 1, 1)) if cerrado else pts
    return F.array_join(F.transform(todos, lambda p: F.format_string(f"%.{decimales}f,%.{decimales}f,0", p["x"], p["y"])), " ")


def marca(nombre: Column, descripcion: Column, tipo: Column, pts: Column) -> Column:
    """A placemark with one shape: tipo P, L or A."""
    anillo = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), coordenadas(pts, True), F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    linea = F.concat(F.lit("<LineString><coordinates>"), coordenadas(pts), F.lit("</coordinates></LineString>"))
    punto = F.concat(F.lit("<Point><coordinates>"), coordenadas(F.slice(pts, 1, 1)), F.lit("</coordinates></Point>"))
    return F.concat(F.lit("<Placemark><name>"), escapado(nombre), F.lit("</name><description>"), escapado(descripcion), F.lit("</description>"), F.when(tipo == "A", anillo).when(tipo == "L", linea).otherwise(punto), F.lit("</Placemark>"))


def _principio(nombre: Column) -> Column:
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>'), escapado(nombre), F.lit("</name>"))


def documento(nombre: Column, piezas: Column) -> Column:
    """A whole KML document of an array of placemarks."""
    return F.concat(_principio(nombre), F.array_join(piezas, ""), F.lit("</Document></kml>"))


def escribir(piezas: DataFrame, dibujo: str, nombre: Column, carpeta: str) -> None:
    """One document, as documento() makes it, for each value of the column `dibujo` of piezas (dibujo, xml), in a folder of
    its own. Written a placemark a line by one task, which holds none of it: a drawing may be larger than its memory."""
    cada = piezas.select(dibujo).distinct()
    lineas = piezas.select(dibujo, F.lit(1).alias("lugar"), F.col("xml").alias("value"))
    for lugar, borde in ((0, _principio(nombre)), (2, F.lit("</Document></kml>"))):
        lineas = lineas.unionByName(cada.select(dibujo, F.lit(lugar).alias("lugar"), borde.alias("value")))
    lineas.repartition(dibujo).sortWithinPartitions(dibujo, "lugar").drop("lugar").write.partitionBy(dibujo).text(carpeta)


def geojson(propiedades: Column, tipo: Column, pts: Column) -> Column:
    """A GeoJSON feature with one shape."""
    par = lambda p: F.array(p["x"], p["y"])
    xy = F.transform(pts, par)
    forma = F.when(tipo == "A", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(F.concat(xy, F.slice(xy, 1, 1))).alias("coordinates")))).when(tipo == "L", F.to_json(F.struct(F.lit("LineString").alias("type"), xy.alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("Point").alias("type"), F.get(xy, F.lit(0)).alias("coordinates"))))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(propiedades), F.lit(',"geometry":'), forma, F.lit("}"))
