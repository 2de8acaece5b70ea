"""Tables and coordinates found in documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from predio.functions import lectura
from predio.session import dealt, table


def filas_en_documentos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of documents that read like those of a table of surfaces: lot, number of cells, the last one and its square metres."""
    d = table(spark, sf_dir, "documents").select("doc_id", lectura.lineas_cuadro(F.col("text")).alias("l"))
    f = d.select("doc_id", F.posexplode(lectura.filas_cuadro(F.col("l"))).alias("n", "f"))
    ultima = F.element_at("f.celdas", -1)
    return f.select("doc_id", (F.col("n") + 1).alias("fila"), "f.lote", F.size("f.celdas").alias("celdas"), ultima.alias("ultima"), lectura.area_m2(ultima).alias("m2"))


def coordenadas_escritas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' places written in six ways and read again."""
    k = F.col("c_custkey")
    g, m, s = k % 90, k % 60, (k * 7 % 600) / 10.0
    d = lambda x: F.format_string("%d", x)
    dms = F.concat(d(g), F.lit("°"), d(m), F.lit("'"), F.format_string("%.1f", s), F.lit('"'))
    otra = F.concat(d(k % 180), F.lit("° "), d(k % 59), F.lit("'"))
    dec = F.concat(F.format_string("%.4f", -(g + m / 100.0)), F.lit(", "), F.format_string("%.4f", -(k % 179 + 0.25)))
    formas = F.array(F.concat(dms, F.lit("S "), otra, F.lit("W")), F.concat(F.lit("O "), otra, F.lit(", S "), dms), dec, F.replace(F.replace(dec, F.lit(", "), F.lit("; ")), F.lit("."), F.lit(",")), F.concat(dms, F.lit(" S")), F.concat(F.lit("a "), dec))
    c = lectura.coordenadas(F.element_at(formas, (k % 6 + 1).cast("int")))
    return dealt(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select("c_custkey", c.alias("c")).select("c_custkey", F.round("c.lat", 7).alias("lat"), F.round("c.lon", 7).alias("lon"))


QUERIES = {f.__name__: f for f in (filas_en_documentos, coordenadas_escritas)}
ORACLES = {
    "filas_en_documentos": r"""
  WITH l AS (
    SELECT doc_id, unnest(t) AS linea, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]') AS t FROM documents)),
  p AS (SELECT *, regexp_extract(linea, '^(\D*?)(\d{1,3}(?:-\d{1,3})?)(?:[^\d.,]|$)', 1) AS antes, regexp_extract(linea, '^(\D*?)(\d{1,3}(?:-\d{1,3})?)(?:[^\d.,]|$)', 2) AS lote0 FROM l),
  q AS (SELECT *, lote0 <> '' AND regexp_matches(regexp_extract(lote0, '(\d+)$', 1), '[1-9]') AS con FROM p),
  r AS (SELECT *, CASE WHEN con THEN substr(linea, length(antes) + length(lote0) + 1) ELSE linea END AS resto FROM q),
  c AS (SELECT *, list_transform(regexp_extract_all(resto, '(?i)\d+(?:[.,]\d+)*(?:\s?(?:m2|m²|mts?2|h[aá]s?\b|hect\w*))?'), lambda x: trim(x)) AS celdas FROM r),
  k AS (
    SELECT *, CASE WHEN con AND a THEN 'F' WHEN con AND regexp_replace(resto, '[ .:]', '', 'g') = '' THEN 'S' WHEN a THEN 'A' WHEN NOT regexp_matches(linea, '\d') THEN 'D' ELSE 'X' END AS k FROM (
      SELECT *, len(celdas) > 0 AND regexp_full_match(regexp_extract(celdas[-1], '^\d+(?:[.,]\d+)*'), '\d{1,3}(?:\.\d{3})*,\d{1,2}|\d{1,3}(?:\.\d{3})+|\d{4,7}') AS a FROM c)),
  s AS (
    SELECT *, lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2, lag(k, 3) OVER w AS k3, lag(k, 4) OVER w AS k4, lag(lote0, 1) OVER w AS l1, lag(lote0, 2) OVER w AS l2, lag(lote0, 3) OVER w AS l3, lag(lote0, 4) OVER w AS l4
    FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  f AS (
    SELECT doc_id, i, celdas, CASE k WHEN 'F' THEN lote0 WHEN 'A' THEN coalesce(CASE WHEN k1 = 'S' THEN l1 WHEN k1 = 'D' AND k2 = 'S' THEN l2 WHEN k1 = 'D' AND k2 = 'D' AND k3 = 'S' THEN l3
             WHEN k1 = 'D' AND k2 = 'D' AND k3 = 'D' AND k4 = 'S' THEN l4 END, CASE WHEN regexp_matches(linea, '(?i)\bresto\b') THEN 'Resto' END) END AS lote FROM s),
  n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS fila, lote, len(celdas) AS celdas, celdas[-1] AS ultima, regexp_extract(celdas[-1], '\d+(?:[.,]\d+)*') AS t FROM f WHERE lote IS NOT NULL),
  v AS (
    SELECT *, TRY_CAST(CASE WHEN contains(t, ',') AND contains(t, '.') THEN replace(replace(t, '.', ''), ',', '.') WHEN length(t) - length(replace(t, ',', '')) = 1 THEN replace(t, ',', '.') WHEN contains(t, ',') THEN NULL
             WHEN regexp_full_match(t, '\d{1,3}(\.\d{3})+') THEN replace(t, '.', '') WHEN length(t) - length(replace(t, '.', '')) > 1 THEN NULL ELSE t END AS DOUBLE) AS valor FROM n)
  SELECT doc_id, fila, lote, celdas, ultima, CASE WHEN valor > 0 THEN round(CASE WHEN regexp_matches(ultima, '(?i)h[aá]s?\b|hect') THEN valor * 10000 WHEN regexp_matches(ultima, '(?i)m2|m²|mt2|mts2') THEN valor WHEN valor < 100 THEN valor * 10000 ELSE valor END, 2) END AS m2 FROM v""",
    "coordenadas_escritas": """
  SELECT c_custkey, round(lat, 7) AS lat, round(lon, 7) AS lon FROM (
    SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN -dms WHEN 1 THEN -dms WHEN 2 THEN -d WHEN 3 THEN -d END AS lat,
           CASE c_custkey % 6 WHEN 0 THEN -o WHEN 1 THEN -o WHEN 2 THEN -(c_custkey % 179 + 0.25::DOUBLE) WHEN 3 THEN -(c_custkey % 179 + 0.25::DOUBLE) END AS lon
    FROM (SELECT c_custkey, c_custkey % 90 + (c_custkey % 60) / 60.0::DOUBLE + (c_custkey * 7 % 600) / 36000.0::DOUBLE AS dms, c_custkey % 180 + (c_custkey % 59) / 60.0::DOUBLE AS o, c_custkey % 90 + (c_custkey % 60) / 100.0::DOUBLE AS d FROM customer))""",
}
