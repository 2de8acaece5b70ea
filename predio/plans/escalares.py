"""Amounts, dates, labels, plane and sphere geometry, sets, changes of tables and evaluation
joins, each over the spread of a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from predio.functions import espacio, fechas, lectura, montos, texto
from predio.plans.vistas import PARCELAS_SQL, RESERVAS_SQL, parcelas, reservas
from predio.session import table

AHORA = "1998-06-01 12:00:00"
#: Plans by name and number of projects (fixed values), least first.
PLANES = (("basico", 1), ("medio", 3), ("grande", 10))
#: What a candidate may lose against the baseline (fixed values): overlap, metres, pairs.
TOLERANCIAS = (0.01, 0.25, 0)
RADIO_M = 6_378_137.0


def montos_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down payment as a percentage and as an amount, a surface's quarter for a sheet, the price in words, amounts as written."""
    p, i = parcelas(spark, sf_dir), F.col("id")
    escrito = F.when(i % 3 == 0, F.concat((i % 40 + 1).cast("string"), F.lit("%"))).when(i % 3 == 1, F.concat(F.lit("$ "), montos.miles(i * 1000))).otherwise("0")
    cuarto = F.col("superficie") / 4
    return p.select(
        "id", montos.entero(F.replace(cuarto.cast("string"), F.lit("."), F.lit(","))).alias("cuarto"), montos.pie(escrito, F.floor("precio").cast("double")).cast("long").alias("pie"),
        montos.precio_escrito(F.col("precio"), F.col("moneda")).alias("texto"), montos.para_planilla(cuarto).alias("coma"),
        texto.monto(F.concat(F.lit("$ "), i.cast("string"), F.lit(",25"))).alias("digitos"),
    )


def areas_escritas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Square metres of written surfaces: in hectares if the unit or a value under 100 says so."""
    p = parcelas(spark, sf_dir)
    unidad = F.when(F.col("id") % 3 == 0, " hás").when(F.col("id") % 3 == 1, "m2").otherwise("")
    valor = F.col("superficie") * F.when(F.col("id") % 2 == 0, 1.5).otherwise(120.0)
    escrito = F.concat(F.replace(valor.cast("string"), F.lit("."), F.lit(",")), unidad)
    return p.select("id", escrito.alias("escrito"), lectura.area_m2(escrito).alias("m2"))


def plazos_de_reservas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each hold at an instant: share of its time left (0 to 1), minutes left, and how long ago it was made, in words."""
    ahora = F.lit(AHORA).cast("timestamp_ntz")
    a, b = F.col("creada_en"), F.col("vence_en")
    return reservas(spark, sf_dir).select("id", F.round(fechas.parte_restante(a, b, ahora), 6).alias("queda"), fechas.minutos_restantes(b, ahora).alias("minutos"), fechas.hace(a, ahora).alias("hace"))


def fechas_legibles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day of a hold as a date in words, as today, yesterday or weekday, and seconds as hours, minutes and seconds."""
    dia = F.to_date("creada_en")
    return reservas(spark, sf_dir).select("id", fechas.fecha_legible(dia).alias("fecha"), fechas.nombre_del_dia(dia, F.lit(AHORA[:10]).cast("date")).alias("nombre"), fechas.duracion(F.col("id") % 100_000).alias("tiempo"))


def rotulos_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lot's stage in roman numbers, its name without XML's own characters, its mark if it has the right length, prefix and number."""
    i = F.col("id")
    marca = F.when(i % 2 == 0, F.concat(F.lit("E-"), (i + 250_000).cast("string"))).otherwise(F.concat(F.lit("N-"), (i + 630_000).cast("string")))
    crudo = F.concat(F.lit("<"), F.col("nombre"), F.lit("> & \"x\""))
    escapado = crudo
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escapado = F.replace(escapado, F.lit(c), F.lit(e))
    lote = F.concat(F.element_at(F.array(F.lit("A"), F.lit("B-"), F.lit("")), (i % 3 + 1).cast("int")), i.cast("string"))
    return parcelas(spark, sf_dir).select(
        "id", fechas.de_lista(("I", "II", "III"), F.col("etapa") + 1).alias("etapa"), escapado.alias("escapado"),
        F.when(marca.rlike("^(E-[0-9]{6}|N-[0-9]{7})$"), marca).alias("marca"),
        F.regexp_extract(lote, "^([A-Z]*)-?([0-9]+)$", 1).alias("prefijo"), F.regexp_extract(lote, "^([A-Z]*)-?([0-9]+)$", 2).cast("long").alias("numero"),
    )


def pixeles_de_puntos(spark: SparkSession, sf_dir: str, zoom: int = 15) -> DataFrame:
    """Web-Mercator pixels of points, and the coordinates got back from them."""
    lado = F.lit(256.0 * 2**zoom)
    p = espacio.pixel_global(F.col("c_custkey") % 340 - 170.5, F.col("c_custkey") % 120 - 60.25, lado)
    d = table(spark, sf_dir, "customer").select("c_custkey", p.alias("p")).select("c_custkey", "p", espacio.coordenada(F.col("p.x"), F.col("p.y"), lado).alias("c"))
    return d.select("c_custkey", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"), F.round("c.x", 6).alias("lon"), F.round("c.y", 6).alias("lat"))


def husos_de_puntos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTM zone and EPSG code (WGS84) of points, octant of a bearing, and the shortest signed turn between two."""
    lon, lat = F.col("c_custkey") % 359 - 179.5, F.col("c_custkey") % 120 - 60.25
    huso = F.floor((lon + 180) / 6).cast("int") + 1
    a, b = F.col("c_custkey") % 360, (F.col("c_custkey") * 7) % 360
    giro = F.pmod(b - a + 540, F.lit(360)) - 180
    rumbo = fechas.de_lista(("N", "NE", "E", "SE", "S", "SO", "O", "NO"), F.floor((a + 22.5) / 45) % 8 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", huso.alias("huso"), (F.when(lat < 0, 32700).otherwise(32600) + huso).alias("epsg"), rumbo.alias("rumbo"), giro.alias("giro"))


def puntos_girados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points turned about a centre, and moved by a homography (null where its divisor is 0)."""
    k = F.col("c_custkey")
    x, y, t = (k % 100).cast("double"), (k % 37).cast("double"), F.radians((k % 360).cast("double"))
    w = 0.001 * x - 0.002 * y + 1
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.round(10 + (x - 10) * F.cos(t) - (y - 5) * F.sin(t), 6).alias("gx"), F.round(5 + (x - 10) * F.sin(t) + (y - 5) * F.cos(t), 6).alias("gy"),
        F.round(F.try_divide(1.5 * x + 0.2 * y + 3, w), 6).alias("hx"), F.round(F.try_divide(-0.1 * x + 0.9 * y + 4, w), 6).alias("hy"),
    )


def centroides_de_poligonos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of area of a quadrilateral per lot; the mean of its corners where it has no area."""
    k = F.col("id")
    w, h = (k % 7).cast("double"), (k % 5 + 1).cast("double")
    anillo = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((k * 1.0, k * 0.0), (k + w, k * 0.0), (k + 2 * w, h), (k * 1.0, h))])
    sigue = F.concat(F.slice(anillo, F.lit(2), F.lit(3)), F.slice(anillo, F.lit(1), F.lit(1)))
    lados = F.zip_with(anillo, sigue, lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).alias("c"), (a["x"] + b["x"]).alias("x"), (a["y"] + b["y"]).alias("y")))
    suma = lambda g: F.aggregate(lados, F.lit(0.0), lambda s, l: s + g(l))
    doble = suma(lambda l: l["c"])  # noqa: E741
    medio = lambda n: F.aggregate(anillo, F.lit(0.0), lambda s, p: s + p[n]) / 4
    centro = lambda n: F.when(F.abs(doble) < 1e-9, medio(n)).otherwise(suma(lambda l: l["c"] * l[n]) / (3 * doble))  # noqa: E741, E731
    return parcelas(spark, sf_dir).select("id", F.round(centro("x"), 4).alias("cx"), F.round(centro("y"), 4).alias("cy"), F.round(F.abs(doble) / 2, 4).alias("area"))


def ajuste_rigido(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of least squares from each source's points to their images: turn, scale and shift, from sums alone."""
    k = F.col("p_partkey")
    x, y = (k % 50).cast("double"), (k % 31).cast("double")
    u, v = 2 * (x * 0.8 - y * 0.6) + 3 + (k % 3), 2 * (x * 0.6 + y * 0.8) - 1 + (k % 2)
    p = table(spark, sf_dir, "part").select((k % 25).alias("grupo"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))
    m = {c: F.avg(c).alias(f"m{c}") for c in "xyuv"}
    cov = lambda a, b: F.covar_pop(a, b)
    g = p.groupBy("grupo").agg(*m.values(), (cov("x", "u") + cov("y", "v")).alias("a"), (cov("x", "v") - cov("y", "u")).alias("b"), (F.var_pop("x") + F.var_pop("y")).alias("s"))
    c, d = F.col("a") / F.col("s"), F.col("b") / F.col("s")
    return g.select(
        "grupo", F.round(F.degrees(F.atan2("b", "a")), 4).alias("giro"), F.round(F.sqrt(c * c + d * d), 6).alias("escala"),
        F.round(F.col("mu") - c * F.col("mx") + d * F.col("my"), 4).alias("dx"), F.round(F.col("mv") - d * F.col("mx") - c * F.col("my"), 4).alias("dy"),
    )


def _dos_lados(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lots of a candidate and of the truth: each lacks some; surfaces differ a little."""
    p = parcelas(spark, sf_dir)
    candidato = p.where("id % 10 <> 3").select("id", "proyecto_id", (F.col("superficie") * (1 + (F.col("id") % 9 - 4) / 100)).alias("area"))
    return candidato, p.where("id % 10 <> 7").select("id", "proyecto_id", F.col("superficie").cast("double").alias("area"))


def comparar_con_verdad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per project: lots on both sides, on one only, recall, and quartiles of the error of the surface in per cent."""
    c, v = _dos_lados(spark, sf_dir)
    j = c.select("id", F.col("proyecto_id").alias("p1"), F.col("area").alias("a")).join(v.select("id", F.col("proyecto_id").alias("p2"), F.col("area").alias("b")), "id", "full")
    error = F.when(F.col("b") > 0, F.round(100 * F.abs(F.col("a") - F.col("b")) / F.col("b"), 6))
    ambos = F.col("a").isNotNull() & F.col("b").isNotNull()
    g = j.groupBy(F.coalesce("p1", "p2").alias("proyecto_id")).agg(
        F.count_if(ambos).alias("ambos"), F.count_if(F.col("b").isNull()).alias("sobran"), F.count_if(F.col("a").isNull()).alias("faltan"),
        F.round(F.avg(error), 6).alias("error"), F.count_if(error <= 2).alias("verdes"), F.count_if((error > 2) & (error <= 5)).alias("amarillos"),
    )
    return g.withColumn("recall", F.round(F.col("ambos") / (F.col("ambos") + F.col("faltan")), 6))


def regresiones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose figures are worse than the baseline's by more than the tolerances, with the reasons."""
    ahora = parcelas(spark, sf_dir).groupBy("proyecto_id").agg((F.sum("superficie") / F.count("*") / 50).alias("iou"), F.round(F.stddev_pop("superficie"), 6).alias("centro"), F.count_if(F.col("superficie") == 1).alias("pares"))
    base = ahora.select("proyecto_id", (F.col("iou") + F.col("proyecto_id") % 3 / 100).alias("iou0"), (F.col("centro") - F.col("proyecto_id") % 4 / 10).alias("centro0"), (F.col("pares") - F.col("proyecto_id") % 2).alias("pares0"))
    j = ahora.join(base, "proyecto_id")
    motivos = F.array_compact(F.array(
        F.when(F.col("iou") < F.col("iou0") - TOLERANCIAS[0] - 1e-9, "iou"),
        F.when(F.col("centro") > F.col("centro0") + TOLERANCIAS[1], "centro"),
        F.when(F.col("pares") > F.col("pares0") + TOLERANCIAS[2], "pares"),
    ))
    return j.select("proyecto_id", F.array_join(motivos, ",").alias("motivos")).where("motivos <> ''")


def claves_de_ambos_lados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keys the two sides have together, in common, on the first only, and with repeats."""
    c, v = (d.select("id") for d in _dos_lados(spark, sf_dir))
    cuenta = lambda d, n: d.agg(F.lit(n).alias("conjunto"), F.count("*").alias("n"))
    partes = (c.union(v).distinct(), "union"), (c.intersect(v), "interseccion"), (c.exceptAll(v), "diferencia"), (c.unionByName(v), "bolsa")
    out = None
    for d, n in partes:
        out = cuenta(d, n) if out is None else out.unionByName(cuenta(d, n))
    return out


def cambios_de_tablas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots after deleted projects took their lots along, sold ones lost their offer (set null), and new rows of a stage replaced its old ones."""
    p = parcelas(spark, sf_dir)
    quedan = p.join(F.broadcast(p.where("proyecto_id % 6 = 0").select("proyecto_id").distinct()), "proyecto_id", "left_anti")  # at most 25 projects
    sin_oferta = quedan.withColumn("precio", F.when(F.col("estado") != "vendido", F.col("precio")))
    nuevas = quedan.where("etapa = 1 and id % 2 = 0").withColumn("precio", F.round(F.col("precio") * 2, 2))
    return sin_oferta.where("etapa <> 1").unionByName(nuevas).select("id", "proyecto_id", "etapa", "precio")


def correos_repetidos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts whose e-mail another account has too, whatever its case; the first one keeps it."""
    k = F.col("c_custkey")
    correo = F.concat(F.when(k % 2 == 0, "Ana").otherwise("ana"), (k % 400).cast("string"), F.lit("@x.cl"))
    w = Window.partitionBy("clave")
    c = table(spark, sf_dir, "customer").select("c_custkey", correo.alias("correo"), F.lower(correo).alias("clave"))
    return c.select("c_custkey", "correo", F.count("*").over(w).alias("veces"), (k == F.min("c_custkey").over(w)).alias("queda"))


def plan_sugerido(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least plan that has room for one more project than the account has (null if none has)."""
    usados = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("usados"))
    plan = F.coalesce(*[F.when(F.col("usados") + 1 <= cupo, nombre) for nombre, cupo in PLANES])
    return usados.select("s_nationkey", "usados", plan.alias("plan"))


def admision_reservas(spark: SparkSession, sf_dir: str, activos: int = 10) -> DataFrame:
    """Requests that come after an instant and why they would be refused at it: the lot is held, the buyer has a hold, the
    project has its number (`apartados_en_orden` judges them one after another). A hold lasts a hundred times the view's hours here."""
    ahora = F.lit(AHORA).cast("timestamp_ntz")
    vence = F.col("creada_en") + (F.col("vence_en") - F.col("creada_en")) * 100
    r = reservas(spark, sf_dir).select("id", "comprador", (F.col("comprador") % 300).alias("lote"), (F.col("comprador") % 25).alias("proyecto_id"), "creada_en", "estado", vence.alias("vence"))
    vivas = r.where((F.col("estado") == "pendiente") & (F.col("creada_en") <= ahora) & (F.col("vence") > ahora))
    por = lambda c, n: vivas.groupBy(c).agg(F.count("*").alias(n))
    j = r.where(F.col("creada_en") > ahora).join(por("lote", "en_lote"), "lote", "left").join(por("comprador", "suyas"), "comprador", "left").join(por("proyecto_id", "en_proyecto"), "proyecto_id", "left")
    motivo = F.when(F.col("en_lote") > 0, "lote").when(F.col("suyas") > 0, "comprador").when(F.col("en_proyecto") >= activos, "proyecto")
    return j.select("id", motivo.alias("motivo"))


_FUNCIONES = (
    montos_de_lotes, areas_escritas, plazos_de_reservas, fechas_legibles, rotulos_de_lotes, pixeles_de_puntos, husos_de_puntos, puntos_girados, centroides_de_poligonos,
    ajuste_rigido, comparar_con_verdad, regresiones, claves_de_ambos_lados, cambios_de_tablas, correos_repetidos, plan_sugerido, admision_reservas,
)
QUERIES = {f.__name__: f for f in _FUNCIONES}

_LISTA = lambda nombres: "[" + ", ".join(f"'{n}'" for n in nombres) + "]"
_SEG = "date_diff('second', {}, {})"
_T = f"TIMESTAMP '{AHORA}'"
ORACLES = {
    "montos_de_lotes": f"""
  SELECT id, CAST(round_even(superficie / 4.0, 0) AS BIGINT) AS cuarto,
         CAST(CASE id % 3 WHEN 0 THEN round_even(floor(precio) * CAST(id % 40 + 1 AS DOUBLE) / 100, 0) WHEN 1 THEN id * 1000 END AS BIGINT) AS pie,
         CASE WHEN moneda = 'UF' THEN 'UF ' || replace(format('{{:,}}', CAST(floor(precio) AS BIGINT)), ',', '.') || CASE WHEN precio = floor(precio) THEN '' ELSE ',' || rtrim(split_part(printf('%.3f', precio), '.', 2), '0') END
              ELSE '$' || replace(format('{{:,}}', CAST(floor(precio + 0.5) AS BIGINT)), ',', '.') END AS texto,
         CASE WHEN superficie % 4 = 0 THEN CAST(superficie // 4 AS VARCHAR) ELSE replace(CAST(CAST(superficie AS DOUBLE) / 4 AS VARCHAR), '.', ',') END AS coma, id + 0.25::DOUBLE AS digitos FROM {PARCELAS_SQL}""",
    "areas_escritas": f"""
  SELECT id, replace(CAST(valor AS VARCHAR), '.', ',') || CASE id % 3 WHEN 0 THEN ' hás' WHEN 1 THEN 'm2' ELSE '' END AS escrito, valor * CASE WHEN id % 3 = 0 OR (id % 3 = 2 AND valor < 100) THEN 10000.0::DOUBLE ELSE 1.0::DOUBLE END AS m2 FROM (
    SELECT id, superficie * CASE id % 2 WHEN 0 THEN CAST(1.5 AS DOUBLE) ELSE CAST(120.0 AS DOUBLE) END AS valor FROM {PARCELAS_SQL})""",
    "plazos_de_reservas": f"""
  SELECT id, round(greatest(0.0, least(1.0, {_SEG.format(_T, "vence_en")} / nullif({_SEG.format("creada_en", "vence_en")}, 0))), 6) AS queda,
         greatest(0, CAST(floor({_SEG.format(_T, "vence_en")} / 60) AS BIGINT)) AS minutos,
         CASE WHEN m < 1 THEN 'recién' WHEN m < 60 THEN 'hace ' || m || ' min' WHEN m < 1440 THEN 'hace ' || (m // 60) || ' h' ELSE 'hace ' || (m // 1440) || ' días' END AS hace
  FROM (SELECT *, CAST(floor({_SEG.format("creada_en", _T)} / 60) AS BIGINT) AS m FROM {RESERVAS_SQL})""",
    "fechas_legibles": f"""
  SELECT id, day(d) || ' de ' || {_LISTA(fechas.MESES)}[month(d)] || ' de ' || year(d) AS fecha,
         CASE DATE '{AHORA[:10]}' - d WHEN 0 THEN 'Hoy' WHEN 1 THEN 'Ayer' ELSE {_LISTA(fechas.DIAS)}[isodow(d)] END AS nombre,
         ((id % 100000) // 3600) || ':' || lpad(CAST((id % 100000) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(id % 100000 % 60 AS VARCHAR), 2, '0') AS tiempo
  FROM (SELECT id, CAST(creada_en AS DATE) AS d FROM {RESERVAS_SQL})""",
    "rotulos_de_lotes": f"""
  SELECT id, ['I', 'II', 'III'][etapa + 1] AS etapa, '&lt;' || nombre || '&gt; &amp; &quot;x&quot;' AS escapado,
         CASE WHEN id % 2 = 0 AND length(CAST(id + 250000 AS VARCHAR)) = 6 THEN 'E-' || (id + 250000) WHEN id % 2 = 1 AND length(CAST(id + 630000 AS VARCHAR)) = 7 THEN 'N-' || (id + 630000) END AS marca,
         ['A', 'B', ''][id % 3 + 1] AS prefijo, CAST(id AS BIGINT) AS numero FROM {PARCELAS_SQL}""",
    "pixeles_de_puntos": """
  WITH p AS (SELECT c_custkey, CAST(c_custkey % 340 - 170.5 AS DOUBLE) AS lon, CAST(c_custkey % 120 - 60.25 AS DOUBLE) AS lat FROM customer)
  SELECT c_custkey, round((lon + 180) / 360 * 8388608, 3) AS x, round((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 8388608, 3) AS y,
         round(lon, 6) AS lon, round(lat, 6) AS lat FROM p""",
    "husos_de_puntos": """
  WITH p AS (SELECT c_custkey, CAST(c_custkey % 359 - 179.5 AS DOUBLE) AS lon, c_custkey % 120 - 60.25 AS lat, c_custkey % 360 AS a, c_custkey * 7 % 360 AS b FROM customer),
  h AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS huso FROM p)
  SELECT c_custkey, huso, CASE WHEN lat < 0 THEN 32700 ELSE 32600 END + huso AS epsg, ['N', 'NE', 'E', 'SE', 'S', 'SO', 'O', 'NO'][CAST(floor((a + 22.5) / 45) AS INTEGER) % 8 + 1] AS rumbo,
         (b - a + 540) % 360 - 180 AS giro FROM h""",
    "puntos_girados": """
  WITH p AS (SELECT c_custkey, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 37 AS DOUBLE) AS y, radians(CAST(c_custkey % 360 AS DOUBLE)) AS t FROM customer)
  SELECT c_custkey, round(10 + (x - 10) * cos(t) - (y - 5) * sin(t), 6) AS gx, round(5 + (x - 10) * sin(t) + (y - 5) * cos(t), 6) AS gy,
         round((1.5 * x + 0.2 * y + 3) / (0.001 * x - 0.002 * y + 1), 6) AS hx, round((-0.1 * x + 0.9 * y + 4) / (0.001 * x - 0.002 * y + 1), 6) AS hy FROM p""",
    "centroides_de_poligonos": f"""
  WITH p AS (SELECT id, CAST(id % 7 AS DOUBLE) AS w, CAST(id % 5 + 1 AS DOUBLE) AS h FROM {PARCELAS_SQL})
  SELECT id, round(id + CASE WHEN w = 0 THEN 0 ELSE 7 * w / 9 END, 4) AS cx, round(CASE WHEN w = 0 THEN h / 2 ELSE 5 * h / 9 END, 4) AS cy, round(1.5 * w * h, 4) AS area FROM p""",
    "ajuste_rigido": """
  WITH q AS (SELECT p_partkey % 25 AS grupo, CAST(p_partkey % 50 AS DOUBLE) AS x, CAST(p_partkey % 31 AS DOUBLE) AS y, p_partkey % 3 AS e, p_partkey % 2 AS f FROM part),
  p AS (SELECT grupo, x, y, 1.6 * x - 1.2 * y + 3 + e AS u, 1.2 * x + 1.6 * y - 1 + f AS v FROM q),
  m AS (SELECT grupo, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY grupo),
  s AS (SELECT grupo, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) AS b, sum((x - mx) ** 2 + (y - my) ** 2) AS s FROM p JOIN m USING (grupo) GROUP BY grupo)
  SELECT grupo, round(degrees(atan2(b, a)), 4) AS giro, round(sqrt(a * a + b * b) / s, 6) AS escala, round(mu - a / s * mx + b / s * my, 4) AS dx, round(mv - b / s * mx - a / s * my, 4) AS dy
  FROM s JOIN m USING (grupo)""",
    "comparar_con_verdad": f"""
  WITH j AS (SELECT *, id % 10 <> 3 AS c, id % 10 <> 7 AS v, round(abs(superficie * (id % 9 - 4)) / superficie, 6) AS e FROM {PARCELAS_SQL})
  SELECT proyecto_id, count(*) FILTER (c AND v) AS ambos, count(*) FILTER (NOT v) AS sobran, count(*) FILTER (NOT c) AS faltan, round(avg(e) FILTER (c AND v), 6) AS error,
         count(*) FILTER (c AND v AND e <= 2) AS verdes, count(*) FILTER (c AND v AND e > 2 AND e <= 5) AS amarillos,
         round(count(*) FILTER (c AND v) / (count(*) FILTER (v)), 6) AS recall FROM j GROUP BY proyecto_id""",
    "regresiones": f"""
  SELECT proyecto_id, concat_ws(',', CASE WHEN proyecto_id % 3 > 1 THEN 'iou' END, CASE WHEN proyecto_id % 4 > 2 THEN 'centro' END, CASE WHEN proyecto_id % 2 > 0 THEN 'pares' END) AS motivos
  FROM (SELECT DISTINCT proyecto_id FROM {PARCELAS_SQL}) WHERE motivos <> ''""",
    "claves_de_ambos_lados": f"""
  WITH c AS (SELECT id FROM {PARCELAS_SQL} WHERE id % 10 <> 3), v AS (SELECT id FROM {PARCELAS_SQL} WHERE id % 10 <> 7)
  SELECT 'union' AS conjunto, count(*) AS n FROM (SELECT * FROM c UNION SELECT * FROM v) UNION ALL
  SELECT 'interseccion', count(*) FROM (SELECT * FROM c INTERSECT SELECT * FROM v) UNION ALL
  SELECT 'diferencia', count(*) FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM v) UNION ALL
  SELECT 'bolsa', count(*) FROM (SELECT * FROM c UNION ALL SELECT * FROM v)""",
    "cambios_de_tablas": f"""
  SELECT id, proyecto_id, etapa, CASE WHEN etapa = 1 THEN round(precio * 2, 2) WHEN estado <> 'vendido' THEN precio END AS precio
  FROM {PARCELAS_SQL} WHERE proyecto_id % 6 <> 0 AND (etapa <> 1 OR id % 2 = 0)""",
    "correos_repetidos": """
  SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'Ana' ELSE 'ana' END || (c_custkey % 400) || '@x.cl' AS correo, count(*) OVER (PARTITION BY c_custkey % 400) AS veces,
         c_custkey = min(c_custkey) OVER (PARTITION BY c_custkey % 400) AS queda FROM customer""",
    "plan_sugerido": """
  SELECT s_nationkey, count(*) AS usados, CASE WHEN count(*) < 1 THEN 'basico' WHEN count(*) < 3 THEN 'medio' WHEN count(*) < 10 THEN 'grande' END AS plan FROM supplier GROUP BY s_nationkey""",
    "admision_reservas": f"""
  WITH r AS (SELECT *, creada_en + (vence_en - creada_en) * 100 AS vence FROM {RESERVAS_SQL}),
  v AS (SELECT * FROM r WHERE estado = 'pendiente' AND creada_en <= {_T} AND vence > {_T})
  SELECT id, CASE WHEN comprador % 300 IN (SELECT comprador % 300 FROM v) THEN 'lote' WHEN comprador IN (SELECT comprador FROM v) THEN 'comprador'
    WHEN comprador % 25 IN (SELECT comprador % 25 FROM v GROUP BY 1 HAVING count(*) >= 10) THEN 'proyecto' END AS motivo
  FROM r WHERE creada_en > {_T}""",
}
