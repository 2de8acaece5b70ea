"""Commercial sheets in and out: headers by alias, rows to lots, ids against the drawing's, feed, leads and outlines as text."""

from __future__ import annotations

import math
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions import texto
from predio.functions.espacio import METROS_POR_GRADO
from predio.plans.medidas import _lotes_geo
from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import table

#: Header names of each field, in their normal form (fixed values).
ALIAS = {
    "id": ("parcela", "lote", "parcela/lote"),
    "parcelacion": ("parcelacion", "proyecto", "nombre proyecto", "nombre del proyecto"),
    "etapa": ("etapa",),
    "estado": ("estado", "situacion"),
    "superficie": ("superficie", "superficie m2", "sup", "m2"),
    "precio": ("precio", "valor", "precio uf", "precio clp"),
    "moneda": ("moneda", "unidad"),
}
#: Headers of the CRM's export and what they are called in a sheet (fixed values).
CRM = {"SUPERFICIE_CRM": "Superficie", "SERVIDUMBRE": "Servidumbre m2", "VALOR_CONTADO": "Precio", "ESTADO_CRM_PARCELA": "Estado"}
#: States as a sheet writes them (fixed values).
ETIQUETAS = {"disponible": "Disponible", "reservado": "Reservado", "vendido": "Vendido"}
#: Where the test outlines lie.
ORIGEN = (-72.0, -36.5)


def leer_csv(spark: SparkSession, ruta: str) -> DataFrame:
    """A sheet as strings, its header's byte-order mark gone, with the row's place in `fila`."""
    df = spark.read.csv(ruta, header=True, inferSchema=False, multiLine=True, quote='"', escape='"')
    return df.toDF(*(c.removeprefix("﻿").strip() for c in df.columns)).withColumn("fila", F.monotonically_increasing_id())


def columnas(nombres: list[str]) -> dict[str, str]:
    """Field to the first header that is one of its aliases, whatever its case, marks and blanks."""
    plano = lambda s: " ".join("".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower().split())
    return {campo: hay[0] for campo, alias in ALIAS.items() if (hay := [n for n in nombres if plano(n) in alias])}


def fichas(hoja: DataFrame, repetidas: bool = False) -> DataFrame:
    """Lots of a sheet of strings with a column fila: id, numero, etapa, estado, superficie, precio, moneda.

    Rows without a readable lot go. An own stage column is stronger than the development's name;
    if any row has a stage, the others are of the first; with several stages an id is
    stage-number. A repeated id is an error, or with repetidas its last row stays. A price of 0
    is none; a missing state is not available. An empty sheet gives no rows; one without a
    column for the lot is an error.
    """
    donde = columnas([c for c in hoja.columns if c != "fila"])
    if "id" not in donde:
        raise ValueError(f"no column for the lot among {hoja.columns}")
    de = lambda campo: F.col(f"`{donde[campo]}`") if campo in donde else F.lit(None).cast("string")
    limpio = hoja.select(
        "fila",
        texto.lote_id(de("id")).alias("numero"),
        F.coalesce(texto.etapa(de("etapa")), texto.etapa(de("parcelacion"))).cast("int").alias("etapa"),
        texto.estado(de("estado")).alias("estado"),
        F.floor(texto.monto(de("superficie"))).cast("long").alias("superficie"),
        F.nullif(texto.monto(de("precio")), F.lit(0.0)).alias("precio"),
        F.coalesce(F.nullif(F.trim(de("moneda")), F.lit("")), F.lit("CLP")).alias("moneda"),
    ).where("numero is not null")
    hay = limpio.agg(F.count("etapa").alias("n"), F.min(F.coalesce("etapa", F.lit(1))).alias("a"), F.max(F.coalesce("etapa", F.lit(1))).alias("b")).first()
    etapa = F.coalesce("etapa", F.lit(1)) if hay.n else F.col("etapa")
    numero = F.concat_ws("-", etapa.cast("string"), "numero") if hay.n and hay.a != hay.b else F.col("numero")
    con_id = limpio.select("fila", numero.alias("id"), "numero", etapa.alias("etapa"), "estado", "superficie", "precio", "moneda")
    if not repetidas:
        dos = con_id.groupBy("id").count().where("count > 1").orderBy(F.length("id"), "id").limit(10).collect()
        if dos:
            raise ValueError("repeated lots: " + ", ".join(r.id for r in dos))
        return con_id.drop("fila")
    return con_id.groupBy("id").agg(F.max_by(F.struct("numero", "etapa", "estado", "superficie", "precio", "moneda"), "fila").alias("f")).select("id", "f.*")


def _hoja_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fila = lambda precio, lugar: table(spark, sf_dir, "part").select(
        F.concat(F.lit("Lote "), F.floor(k / 3).cast("string")).alias("PARCELA"),
        F.concat(F.lit("Cierra Etapa "), (k % 3 + 1).cast("string")).alias("Proyecto"),
        F.when(k % 4 == 0, "Vendido").otherwise("Disponible").alias("ESTADO_CRM_PARCELA"),
        F.col("p_size").cast("string").alias("SUPERFICIE_CRM"),
        precio.alias("VALOR_CONTADO"),
        lugar.alias("fila"),
    )
    una = fila(F.when(k % 11 == 0, "0").otherwise(F.concat(F.lit("$ "), (k + 100).cast("string"))), k)
    return una.unionByName(fila(F.lit("77"), k + 1_000_000_000).where("fila % 10 = 0"))


def planilla_crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The CRM's export as lots: four headers renamed, a repeated lot's last row stays."""
    return fichas(_hoja_crm(spark, sf_dir).withColumnsRenamed(CRM), repetidas=True)


def alinear(hoja: DataFrame, ids: DataFrame) -> DataFrame:
    """Sheet lots (id, numero) with the drawing's id: the same one; else its bare number, if no other
    pending lot has it and no sheet lot is called so; else its own."""
    pendientes, libres = hoja.join(ids, "id", "left_anti"), ids.join(hoja, "id", "left_anti")
    unicos = pendientes.groupBy("numero").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1")
    nuevos = unicos.join(libres.select(F.col("id").alias("numero")).distinct(), "numero").select("id", F.col("numero").alias("nuevo"))
    return hoja.join(nuevos, "id", "left").select("id", F.coalesce("nuevo", "id").alias("id_dibujo"))


def ids_alineados(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lots of three stages against a drawing that names some with the stage and some without."""
    k, numero = F.col("p_partkey"), F.floor(F.col("p_partkey") / 2).cast("string")
    hoja = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", (k % 3).cast("string"), numero).alias("id"), numero.alias("numero"))
    dibujo = hoja.where("p_partkey % 5 < 3").select(F.when(F.col("p_partkey") % 5 == 0, F.col("id")).otherwise(F.col("numero")).alias("id")).distinct()
    return alinear(hoja.where("p_partkey % 7 <> 0").drop("p_partkey"), dibujo)


def numero_corto(x: Column) -> Column:
    """A number without decimals if it has none; null stays empty."""
    return F.coalesce(F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string")), F.lit(""))


def inventario_csv(spark: SparkSession, sf_dir: str, elecciones: dict[int, int] | None = None) -> DataFrame:
    """The feed as a sheet's rows: lots of the chosen projects (project to stage, an argument), the stage named only if there are several."""
    elecciones = elecciones or {2: 1, 3: 1, 5: 2, 7: 3}
    etapa = F.create_map(*[F.lit(int(x)) for kv in elecciones.items() for x in kv])
    nombre = F.concat(F.lit("CIERRA ET"), F.col("e").cast("string")) if len(set(elecciones.values())) > 1 else F.lit("CIERRA")
    etiqueta = F.create_map(*[F.lit(x) for kv in ETIQUETAS.items() for x in kv])
    p = parcelas(spark, sf_dir).where(F.col("proyecto_id").isin(*elecciones)).withColumn("e", F.element_at(etapa, F.col("proyecto_id").cast("int")))
    return p.select(
        F.col("id").cast("string").alias("parcela"), nombre.alias("proyecto"), F.coalesce(F.try_element_at(etiqueta, "estado"), F.lit("No disponible")).alias("estado"),
        numero_corto(F.col("precio")).alias("precio"), "moneda", F.coalesce(F.col("superficie").cast("string"), F.lit("")).alias("superficie"),
    )


def celda(x: Column) -> Column:
    """A cell of a semicolon sheet: quoted only where it must be."""
    x = F.coalesce(x.cast("string"), F.lit(""))
    return F.when(x.rlike('[";\n\r]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def contactos_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads as the lines of a sheet, cells parted by semicolons."""
    k = F.col("c_custkey")
    nota = F.when(k % 3 == 0, F.concat(F.lit('dice "sí"; '), F.col("c_mktsegment"))).when(k % 3 == 1, F.lit("a\nb")).otherwise(F.col("c_mktsegment"))
    celdas = [celda(c) for c in (k, F.col("c_name"), F.concat(F.lit("+"), F.col("c_nationkey").cast("string")), nota, F.lit(None))]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(";", *celdas).alias("linea"))


def kml_de_lotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines as KML coordinates: longitude, latitude and height, the first point again at the end."""
    lon = lambda p: F.lit(ORIGEN[0]) + p["x"] / (METROS_POR_GRADO * math.cos(math.radians(ORIGEN[1])))
    lat = lambda p: F.lit(ORIGEN[1]) + p["y"] / METROS_POR_GRADO
    cerrado = F.concat("anillo", F.slice("anillo", 1, 1))
    puntos = F.array_join(F.transform(cerrado, lambda p: F.format_string("%.6f,%.6f,0", lon(p), lat(p))), " ")
    return _lotes_geo(spark, sf_dir).select("vec_id", F.concat(F.lit("<coordinates>"), puntos, F.lit("</coordinates>")).alias("kml"))


def _punto_sql(sx: int, sy: int) -> str:
    e = lambda i: f"CAST(embedding[{i}] AS DOUBLE)"
    x, y = f"100 * {e(1)} + {sx} * (10 + 40 * abs({e(3)}))", f"100 * {e(2)} + {sy} * (10 + 40 * abs({e(4)})) + {sx} * 5"
    return f"printf('%.6f,%.6f,0', {ORIGEN[0]} + ({x}) / {METROS_POR_GRADO * math.cos(math.radians(ORIGEN[1]))!r}, {ORIGEN[1]} + ({y}) / {METROS_POR_GRADO})"


_HOJA = "(SELECT p_partkey, (p_partkey % 3) || '-' || (p_partkey // 2) AS id, CAST(p_partkey // 2 AS VARCHAR) AS numero FROM part)"
_FICHAS = f"(SELECT id, numero FROM {_HOJA} WHERE p_partkey % 7 <> 0)"
_DIBUJO = f"(SELECT DISTINCT CASE WHEN p_partkey % 5 = 0 THEN id ELSE numero END AS id FROM {_HOJA} WHERE p_partkey % 5 < 3)"
QUERIES = {f.__name__: f for f in (planilla_crm, ids_alineados, inventario_csv, contactos_csv, kml_de_lotes)}
ORACLES = {
    "planilla_crm": """
  SELECT (p_partkey % 3 + 1) || '-' || (p_partkey // 3) AS id, CAST(p_partkey // 3 AS VARCHAR) AS numero, CAST(p_partkey % 3 + 1 AS INTEGER) AS etapa,
         CASE WHEN p_partkey % 4 = 0 THEN 'vendido' ELSE 'disponible' END AS estado, CAST(p_size AS BIGINT) AS superficie,
         CASE WHEN p_partkey % 10 = 0 THEN 77.0::DOUBLE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey + 100 AS DOUBLE) END AS precio, 'CLP' AS moneda
  FROM part""",
    "ids_alineados": f"""
  SELECT f.id, coalesce(n.numero, f.id) AS id_dibujo FROM {_FICHAS} f LEFT JOIN (
    SELECT numero, min(id) AS id FROM {_FICHAS} WHERE id NOT IN (SELECT id FROM {_DIBUJO}) GROUP BY numero HAVING count(*) = 1) n
  ON n.id = f.id AND n.numero IN (SELECT id FROM {_DIBUJO}) AND n.numero NOT IN (SELECT id FROM {_FICHAS})""",
    "inventario_csv": f"""
  SELECT CAST(id AS VARCHAR) AS parcela, 'CIERRA ET' || CASE proyecto_id WHEN 5 THEN 2 WHEN 7 THEN 3 ELSE 1 END AS proyecto,
         CASE estado WHEN 'disponible' THEN 'Disponible' WHEN 'reservado' THEN 'Reservado' ELSE 'Vendido' END AS estado,
         coalesce(CASE WHEN precio = floor(precio) THEN CAST(CAST(precio AS BIGINT) AS VARCHAR) ELSE CAST(precio AS VARCHAR) END, '') AS precio,
         moneda, CAST(superficie AS VARCHAR) AS superficie FROM {PARCELAS_SQL} WHERE proyecto_id IN (2, 3, 5, 7)""",
    "contactos_csv": """
  SELECT c_custkey, c_custkey || ';' || c_name || ';+' || c_nationkey || ';' || CASE c_custkey % 3
    WHEN 0 THEN '"dice ""sí""; ' || c_mktsegment || '"' WHEN 1 THEN '"a' || chr(10) || 'b"' ELSE c_mktsegment END || ';' AS linea FROM customer""",
    "kml_de_lotes": f"""
  SELECT vec_id, '<coordinates>' || concat_ws(' ', {', '.join(_punto_sql(*s) for s in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)))}) || '</coordinates>' AS kml FROM embeddings""",
}
