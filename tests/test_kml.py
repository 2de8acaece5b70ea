"""Drawings as files: what is read, how it is routed, what is rejected."""

import math
import zipfile

import pytest
from pyspark.sql import functions as F

from predio.sources import kml

LAT, LON = -34.79, -72.0


def desplazar(este, norte):
    return LON + este / (111_320 * math.cos(math.radians(LAT))), LAT + norte / 111_320


def coords(puntos):
    return " ".join(f"{x:.10f},{y:.10f},0" for x, y in puntos)


def cuadrado(este, norte, lado=70):
    return [desplazar(este + a * lado, norte + b * lado) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1))]


def anillo(puntos, borde="outer"):
    return f"<{borde}BoundaryIs><LinearRing><coordinates>{coords(puntos + puntos[:1])}</coordinates></LinearRing></{borde}BoundaryIs>"


def poligono(puntos, descripcion="0", nombre="", huecos=()):
    return f"<Placemark><name>{nombre}</name><description>{descripcion}</description><Polygon>{anillo(puntos)}{''.join(anillo(h, 'inner') for h in huecos)}</Polygon></Placemark>"


def punto(nombre, p):
    return f"<Placemark><name>{nombre}</name><Point><coordinates>{coords([p])}</coordinates></Point></Placemark>"


def linea(nombre, puntos, extra=""):
    return f"<Placemark><name>{nombre}</name>{extra}<LineString><coordinates>\n {coords(puntos)}\n</coordinates></LineString></Placemark>"


def doc(cuerpo):
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document>{cuerpo}</Document></kml>'


@pytest.fixture
def leer(spark, tmp_path):
    def _leer(**dibujos):
        for nombre, cuerpo in dibujos.items():
            with zipfile.ZipFile(tmp_path / f"{nombre}.kmz", "w") as z:
                z.writestr("files/foto.png", b"x")
                z.writestr("doc.KML", cuerpo if cuerpo.startswith("<?xml") else doc(cuerpo))
        return kml.archivos(spark, str(tmp_path))

    return _leer


def partes(archivos):
    return sorted(kml.dibujo(kml.rasgos(archivos)).collect(), key=lambda r: (r.archivo, r.orden, r.parte))


def test_labels_outlines_and_sale(leer):
    k = leer(a=poligono(cuadrado(0, 0), "NO EN VENTA") + poligono(cuadrado(100, 0)) + punto("LOTE A10", desplazar(35, 35)) + punto("TEXTOS REPARO", desplazar(1, 1)) + punto("ROL 409-37 ETAPA 2", desplazar(9, 9)) + poligono(cuadrado(9, 9), nombre="Lote 7-01") + poligono(cuadrado(9, 9), nombre="ETAPA 3"))
    got = [(r.clase, r.lote, r.etapa, r.en_venta, len(r.puntos), r.es_cad) for r in partes(k)]
    assert got == [("lote", None, None, False, 4, False), ("lote", None, None, True, 4, False), ("etiqueta", "A10", None, None, 1, False), ("otro", None, None, None, 1, False), ("etapa", None, 2, None, 1, False), ("lote", "7-1", None, True, 4, False), ("lote", None, 3, True, 4, False)]
    assert kml.rechazados(k).count() == 0


def test_lines_make_a_drawing_of_lines(leer):
    borde = linea("", cuadrado(0, 0))
    k = leer(cad=borde + linea("Camino viejo", cuadrado(5, 5)) + linea("Estero X", cuadrado(1, 1)), llano=linea("Camino viejo", cuadrado(5, 5)) + linea("Estero X", cuadrado(1, 1)) + poligono(cuadrado(0, 0)))
    got = {(r.archivo.rsplit("/", 1)[1], r.orden): (r.clase, r.es_cad) for r in partes(k)}
    assert got == {("cad.kmz", 0): ("linea", True), ("cad.kmz", 1): ("linea", True), ("cad.kmz", 2): ("agua", True), ("llano.kmz", 0): ("camino", False), ("llano.kmz", 1): ("agua", False), ("llano.kmz", 2): ("lote", False)}


def test_water_zones_and_roads(leer):
    multi = f"<Placemark><name>  Río   Claro </name><MultiGeometry><LineString><coordinates>{coords(cuadrado(0, 0)[:2])}</coordinates></LineString><MultiGeometry><Polygon>{anillo(cuadrado(5, 5))}</Polygon></MultiGeometry></MultiGeometry></Placemark>"
    k = leer(a=multi + poligono(cuadrado(0, 0), nombre="Área verde") + punto("Reserva sur", desplazar(0, 0)) + poligono(cuadrado(0, 0), nombre="ACCESO", huecos=[cuadrado(10, 10, 20)]) + linea("Servidumbre", cuadrado(3, 3)[:2]) + linea("Canalizado", cuadrado(3, 3)) + linea("acequia", cuadrado(3, 3)[:1]))
    d = kml.dibujo(kml.rasgos(k))
    assert [(r.nombre, len(r.puntos)) for r in kml.aguas(d).orderBy("orden", F.size("puntos")).collect()] == [("Río Claro", 2), ("Río Claro", 5)]
    assert [(r.nombre, len(r.puntos)) for r in kml.zonas(d).collect()] == [("Área verde", 4)]
    assert kml.caminos(d).count() == 0 and d.where("clase = 'linea'").count() == 2  # "Canalizado" makes it a drawing of lines
    d = kml.dibujo(kml.rasgos(k).where("nombre <> 'Canalizado'"))
    assert sorted((r.forma, len(r.puntos), len(r.huecos)) for r in kml.caminos(d).collect()) == [("eje", 2, 0), ("franja", 4, 1)]


def test_colours(leer):
    estilos = '<Style id="rojo"><LineStyle><color>ff0000ff</color></LineStyle><PolyStyle><color>00ff00ff</color></PolyStyle></Style><Style id="lleno"><PolyStyle><color>7fabcdef</color></PolyStyle></Style><StyleMap id="m"><Pair><key>highlight</key><styleUrl>#lleno</styleUrl></Pair><Pair><key>normal</key><styleUrl>#rojo</styleUrl></Pair></StyleMap>'
    propio = "<Style><LineStyle><color> ff112233 </color></LineStyle></Style>"
    k = leer(a=estilos + "".join(linea(str(i), cuadrado(0, 0), x) for i, x in enumerate(("<styleUrl>#rojo</styleUrl>", "<styleUrl>#lleno</styleUrl>", "<styleUrl>#m</styleUrl>", "<styleUrl>#nada</styleUrl>", propio, ""))))
    assert [r.color for r in partes(k)] == ["FF0000FF", "7FABCDEF", "FF0000FF", None, "FF112233", None]


def test_prefixes_comments_and_escapes(leer):
    otro = doc(punto("A &amp; B &lt;5&gt;", desplazar(0, 0))).replace("<Placemark", "<k:Placemark").replace("</Placemark", "</k:Placemark").replace("<Point", "<k:Point").replace("</Point", "</k:Point").replace("<Document>", "<Document><!-- <Placemark><name>no</name></Placemark> -->")
    k = leer(a=otro.replace('<kml xmlns="', '<kml xmlns:k="x" xmlns="'))
    assert [(r.nombre, r.tipo) for r in partes(k)] == [("A & B <5>", "P")]


def test_rejects_stop_nothing(spark, leer, tmp_path):
    leer(bueno=punto("LOTE 1", desplazar(0, 0)) + "<Placemark><name>roto</nam></Placemark>" + punto("LOTE 2", desplazar(0, 0)) + "<Placemark><Point><coordinates>a,b 1</coordinates></Point></Placemark><Placemark/>")
    with zipfile.ZipFile(tmp_path / "sin.kmz", "w") as z:
        z.writestr("leeme.txt", "nada")
    (tmp_path / "malo.kmz").write_bytes(b"PK\x03\x04 no")
    (tmp_path / "texto.kml").write_bytes(b"hola \xff")
    (tmp_path / "suelto.kml").write_text(doc(punto("LOTE 3", desplazar(0, 0))))
    k = kml.archivos(spark, str(tmp_path))
    assert {r.lote for r in partes(k)} == {"1", "2", "3"}
    assert {(r.archivo.rsplit("/", 1)[1], r.orden, r.motivo.split(":")[0]) for r in kml.rechazados(k).collect()} == {("sin.kmz", None, "no kml inside"), ("malo.kmz", None, "broken archive"), ("texto.kml", None, "no kml element"), ("bueno.kmz", 1, "broken placemark")}


def test_written_and_read_again(spark, tmp_path):
    from pyspark.sql import types as T

    punto_ = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
    filas = [('a"<&>\'b', "A", [(1.5, 2.25), (3.0, 4.0), (5.0, 6.5)]), ("é\x01", "L", [(0.0, 1.0), (2.0, 3.0)]), (None, "P", [(7.0, 8.0)])]
    df = spark.createDataFrame(filas, T.StructType([T.StructField("n", T.StringType()), T.StructField("t", T.StringType()), T.StructField("p", punto_)]))
    marcas = df.select(kml.marca(F.col("n"), F.lit("d"), F.col("t"), F.col("p")).alias("x"), kml.geojson(F.struct("n"), F.col("t"), F.col("p")).alias("j"))
    marcas.agg(kml.documento(F.lit("L & M"), F.collect_list("x")).alias("value")).coalesce(1).write.text(str(tmp_path / "k"))
    got = sorted((r.tipo, r.nombre, r.capa, [tuple(p) for p in r.puntos]) for r in kml.rasgos(kml.archivos(spark, f"{tmp_path}/k/*.txt")).collect())
    assert got == sorted((t, (n or "").replace("\x01", ""), "d", p) for n, t, p in filas)
    import json

    for (n, t, p), r in zip(filas, marcas.collect()):
        f = json.loads(r.j)
        assert f["properties"].get("n") == n and f["geometry"]["coordinates"] == {"A": [[list(x) for x in p + p[:1]]], "L": [list(x) for x in p], "P": list(p[0])}[t]


def test_plain_files_do_not_pass_through_python(spark, tmp_path):
    (tmp_path / "a.kml").write_text("<kml/>")
    a = kml.archivos(spark, str(tmp_path))
    plan = a._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "isValid()" in plan
    assert [tuple(r)[1:] for r in a.collect()] == [("<kml/>", None)]


def test_every_project_is_drawn(spark):
    from predio.plans import dibujos

    sf = "/root/testdata/sf0.001"
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.pmod("p_partkey", F.lit(25)).alias("proyecto_id"))
    d = dibujos.kml_leido(spark, sf)
    got = {r.clase: r["count"] for r in d.groupBy("clase").count().collect()}
    assert got["lote"] == got["etiqueta"] == p.count() and got["etapa"] == got["agua"] == p.select("proyecto_id").distinct().count() == 25
    assert {r.etapa for r in d.where("clase = 'etapa'").collect()} == set(range(25))


def formas(archivos):
    return sorted((r.archivo.rsplit("/", 1)[1], *r[1:]) for r in kml.dibujo(kml.rasgos(archivos)).drop("color", "huecos").collect())


def test_plain_files_in_pieces_are_the_same(spark, tmp_path):
    dos = punto("LOTE 1", desplazar(0, 0)) + "<Placemark><name>roto</nam></Placemark>" + linea("Estero ñ", cuadrado(0, 0), "<styleUrl>#r</styleUrl>")
    estilo = '<Style id="r"><LineStyle><color>ff0000ff</color></LineStyle></Style>'
    entero = doc(estilo + "<!-- una nota -->" + dos + poligono(cuadrado(0, 0), nombre="Zona de paso") + punto("LOTE 2", desplazar(1, 1)))
    casos = {
        "llano.kml": entero, "con blanco [1].txt": entero, "nota larga.kml": doc(dos.replace("<name>roto", "<!-- <name>x</Placemark> --><name>roto")), "cortado.kml": entero[: entero.rindex("</Placemark>")], "sin fin.kml": entero[: entero.rindex("</Placemark>") + 12],
        "prefijo.kml": doc(dos).replace("<Placemark", "<k:Placemark").replace("</Placemark", "</k:Placemark"), "separado.kml": doc(dos).replace("</Placemark>", "</Placemark >"), "vacio.kml": "", "nada.kml": doc(""), "otro.dat": entero, "hola.kml": "hola",
    }
    for nombre, cuerpo in casos.items():
        (tmp_path / nombre).write_text(cuerpo)
    (tmp_path / "bytes.kml").write_bytes(entero.encode().replace(b"Zona", b"Z\xffona"))
    for nombre in ("a.kmz", "a.kml"):
        with zipfile.ZipFile(tmp_path / nombre, "w") as z:
            z.writestr("doc.kml", entero)
    uno, otro = kml.archivos(spark, str(tmp_path)), kml.trozos(spark, str(tmp_path))
    assert formas(otro) == formas(uno) and formas(uno)
    colores = lambda k: sorted(str(r.color) for r in kml.rasgos(k).collect())
    assert colores(otro) == colores(uno)
    malos = lambda k: sorted((r.archivo.rsplit("/", 1)[1], -1 if r.orden is None else r.orden, r.motivo) for r in kml.rechazados(k).collect())
    assert malos(otro) == malos(uno)
    filas = {r.archivo.rsplit("/", 1)[1]: r["count"] for r in otro.groupBy("archivo").count().collect()}
    assert filas["llano.kml"] == 6 and filas["a.kmz"] == filas["prefijo.kml"] == filas["bytes.kml"] == 1 and filas.keys() == {r.archivo.rsplit("/", 1)[1] for r in uno.collect()}


def test_a_drawing_is_never_one_row(spark, tmp_path):
    """Written in order, read in many tasks, and no row has more than one placemark."""
    marca = kml.marca(F.concat(F.lit("LOTE "), F.col("id")), F.lit("ñ"), F.lit("P"), F.array(F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))))
    kml.escribir(spark.range(20_000).select((F.col("id") % 2).alias("k"), marca.alias("xml")), "k", F.concat(F.lit("L\n& "), F.col("k")), f"{tmp_path}/d")
    assert len(list((tmp_path / "d").glob("*/*.txt"))) == 2
    antes = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        t = kml.trozos(spark, f"{tmp_path}/d/*/*.txt")
        assert t.agg(F.max(F.length("kml"))).first()[0] < 400
        r = kml.rasgos(t)
        assert r.count() == r.select("archivo", "orden").distinct().count() == r.select("nombre").distinct().count() == 20_000
        assert [tuple(x) for x in r.groupBy("archivo").agg(F.min("orden"), F.max("orden")).select(F.col("min(orden)"), F.col("max(orden)")).collect()] == [(0, 9999)] * 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", antes)
    uno = {(x.nombre, x.orden) for x in kml.rasgos(kml.archivos(spark, f"{tmp_path}/d/*/*.txt")).collect()}
    assert uno == {(x.nombre, x.orden) for x in r.collect()} and kml.rechazados(t).count() == 0
