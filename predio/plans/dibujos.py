"""Drawings written as KML and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.plans.vistas import PARCELAS_SQL, parcelas
from predio.session import dealt, shared_folder
from predio.sources import kml


def _piezas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placemarks of each project: its lots' outlines (no names) and labels, and a stream; in projects that 3
    divides a zone, in odd ones a road, in those that 4 divides a border as a plain line."""
    p = dealt(parcelas(spark, sf_dir).select("id", "proyecto_id", "etapa"))
    x, y = F.lit(-72.0) + F.col("id") * 0.001, F.lit(-34.0) - F.col("proyecto_id") * 0.01
    en = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    cuadro = F.array(en(0, 0), en(0.0005, 0), en(0.0005, 0.0005), en(0, 0.0005))
    nada = F.lit("")
    lotes = p.select("proyecto_id", kml.marca(nada, F.when(F.col("id") % 29 == 0, "sector <b> no en venta").otherwise("0"), F.lit("A"), cuadro).alias("xml"))
    rotulos = p.select("proyecto_id", kml.marca(F.concat(F.lit("LOTE "), F.col("etapa"), F.lit("-0"), F.col("id")), nada, F.lit("P"), F.array(en(0.0002, 0.0002))).alias("xml"))
    d = p.groupBy("proyecto_id").agg(F.min("id").alias("id"))
    otros = [
        ("true", F.concat(F.lit("Estero  \"N° "), F.col("proyecto_id"), F.lit("\" & Cía")), "L"), ("proyecto_id % 3 = 0", F.lit("Zona de conservación"), "A"),
        ("proyecto_id % 2 = 1", F.lit("Servidumbre norte"), "L"), ("proyecto_id % 4 = 0", F.lit("deslinde"), "L"), ("true", F.concat(F.lit("Rol 7 ETAPA 0"), F.col("proyecto_id")), "P"),
    ]
    todas = lotes.unionByName(rotulos)
    for cuales, nombre, tipo in otros:
        todas = todas.unionByName(d.where(cuales).select("proyecto_id", kml.marca(nombre, nada, F.lit(tipo), cuadro).alias("xml")))
    return todas


def kml_leido(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is in the drawings once they were written, one file for each project, and read again."""
    carpeta = shared_folder(spark)
    kml.escribir(_piezas(spark, sf_dir), "proyecto_id", F.concat(F.lit("Loteo "), F.col("proyecto_id")), f"{carpeta}/dibujos")
    kml.rasgos(kml.trozos(spark, f"{carpeta}/dibujos/*/*.txt")).write.parquet(f"{carpeta}/rasgos")  # what a shape is takes them three times
    d = kml.dibujo(spark.read.parquet(f"{carpeta}/rasgos"))
    uno = F.get("puntos", F.lit(0))
    return d.select("clase", "nombre", "lote", "etapa", "en_venta", "es_cad", F.size("puntos").alias("n"), F.round(uno["x"], 6).alias("x"), F.round(uno["y"], 6).alias("y"))


QUERIES = {"kml_leido": kml_leido}
ORACLES = {
    "kml_leido": f"""
  WITH p AS (SELECT id, etapa, proyecto_id AS k, -72.0::DOUBLE + id * 0.001::DOUBLE AS x, -34.0::DOUBLE - proyecto_id * 0.01::DOUBLE AS y, proyecto_id % 4 = 0 AS es_cad FROM {PARCELAS_SQL}),
  d AS (SELECT k, es_cad, -72.0::DOUBLE + min(id) * 0.001::DOUBLE AS x, min(y) AS y FROM p GROUP BY k, es_cad),
  r AS (
    SELECT 'lote' AS clase, '' AS nombre, NULL AS lote, NULL AS etapa, id % 29 <> 0 AS en_venta, es_cad, 4 AS n, x, y FROM p
    UNION ALL SELECT 'etiqueta', 'LOTE ' || etapa || '-0' || id, etapa || '-' || id, NULL, NULL, es_cad, 1, x + 0.0002, y + 0.0002 FROM p
    UNION ALL SELECT 'agua', 'Estero  "N° ' || k || '" & Cía', NULL, NULL, NULL, es_cad, 4, x, y FROM d
    UNION ALL SELECT 'zona', 'Zona de conservación', NULL, NULL, NULL, es_cad, 4, x, y FROM d WHERE k % 3 = 0
    UNION ALL SELECT 'camino', 'Servidumbre norte', NULL, NULL, NULL, es_cad, 4, x, y FROM d WHERE k % 2 = 1
    UNION ALL SELECT 'linea', 'deslinde', NULL, NULL, NULL, es_cad, 4, x, y FROM d WHERE k % 4 = 0
    UNION ALL SELECT 'etapa', 'Rol 7 ETAPA 0' || k, NULL, CAST(k AS INTEGER), NULL, es_cad, 1, x, y FROM d)
  SELECT clase, nombre, lote, etapa, en_venta, es_cad, n, round(x, 6) AS x, round(y, 6) AS y FROM r""",
}
