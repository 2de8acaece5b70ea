"""The numbered queries, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from predio.llm import bpe, decontamination, fingerprint, line_dedup, lm_score, minhash, mixing, pii, quality_classifier, quality_rules, spelling, suffix_dedup, vector_codes
from predio.llm.common import small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(documents(spark, sf_dir)).drop("rejected_by")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.assign(documents(spark, sf_dir, "doc_id", "text", "source"))
    columns = ["doc_id", "size", "source_size", "target", "taken", "copies", "position"]
    return placed.select(*columns).repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir))
    n = [F.size(pii.of_kinds(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    base = pii.of_kinds(F.col("spans"), *pii.KINDS)
    scores = F.array_join(F.transform("spans", lambda s: F.format_string("%.1f", s["score"])), ",")
    return found.select("doc_id", *n, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), scores.alias("scores"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(documents(spark, sf_dir))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated", F.size("near_items").cast("long").alias("n_near_items"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


OP1_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS last_doc FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT keyed.*, coalesce(doc_id < last_doc, false) AS gone FROM keyed LEFT JOIN repeated USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
firsts AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE doc_id > first_doc),
opened AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS opens FROM gone),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM opened),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
kept AS (
  SELECT doc_id, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b), 0) + 1,
                        2 * (a - coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY b), 0))) AS piece, a, b FROM spans JOIN d USING (doc_id)),
joined AS (
  SELECT doc_id, string_agg(piece, '' ORDER BY a) AS pieces, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_b FROM kept GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(last_b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN joined USING (doc_id)"""

OP4_SQL = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
features AS (
  SELECT doc_id, len(ws) AS n_words, len(array_to_string(ws, '')) AS word_chars,
         len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*+\\x{{2022}}]'))) AS n_bullet_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\\.\\.\\.|\\x{{2026}})[\\x20\\x09-\\x0D]*$'))) AS n_cut_lines,
         coalesce(covered.n, 0) AS n_repeat_words,
         len(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, len(regexp_replace(t, '[^A-Za-z]+', '', 'g')) AS n_letters
  FROM w LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM features)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > n_letters
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * n_dup_lines > 4 * n_lines
            OR 10 * n_bullet_lines > 9 * n_lines OR 10 * n_cut_lines > 3 * n_lines) AS kept
FROM judged"""

OP7_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM reach r JOIN edges e ON e.a = r.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM reach GROUP BY id) c ON c.id = d.doc_id"""

OP11_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS r FROM documents)
  GROUP BY doc_id, r),
coded AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM runs),
hashed AS (
  SELECT r, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2),
      lambda j: CAST(16 * (strpos('0123456789ABCDEF', substr(x, 2 * j + 1, 1)) - 1) + strpos('0123456789ABCDEF', substr(x, 2 * j + 2, 1)) - 1 AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM coded, crc),
edited AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, n FROM hashed),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.k = b.k AND a.word <> b.word
  UNION SELECT a.word, cut.word FROM words a JOIN cut ON cut.k = a.word
  UNION SELECT cut.word, a.word FROM words a JOIN cut ON cut.k = a.word),
ranked AS (
  SELECT a, b, n AS b_n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place
  FROM near JOIN words ON word = b),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN b_n >= 10 * n THEN b END AS form, CASE WHEN b_n >= 10 * n THEN b_n END AS form_n
  FROM words LEFT JOIN ranked ON a = word AND place = 1),
walk AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL SELECT w.word, w.onward, f.form FROM walk w JOIN formed f ON f.word = w.onward)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, w.root FROM formed f JOIN walk w ON w.word = f.word AND w.onward IS NULL"""

OP12_SQL = f"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
cut AS (SELECT DISTINCT item, ws[i:i + 9] AS w FROM (SELECT item, ws, unnest(range(1, greatest(2, len(ws) - 8))) AS i FROM b WHERE len(ws) > 0)),
phrases AS (SELECT DISTINCT w FROM cut),
sizes AS (SELECT DISTINCT len(w) AS k FROM phrases),
places AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS w FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
met AS (SELECT doc_id, i, k, w FROM places JOIN phrases USING (w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT DISTINCT doc_id, item FROM met JOIN cut USING (w)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM items GROUP BY doc_id),
tokens AS (SELECT doc_id, i, ws[i] AS term FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
counts AS (SELECT term, count(*) AS n FROM tokens GROUP BY term),
terms AS (SELECT DISTINCT w, unnest(w) AS term FROM phrases),
ranked AS (
  SELECT w, term, row_number() OVER (PARTITION BY w ORDER BY counts.n, term) AS place, count(*) OVER (PARTITION BY w) AS got FROM terms JOIN counts USING (term)),
probes AS (
  SELECT x.w, x.term AS t1, y.term AS t2 FROM ranked x LEFT JOIN ranked y ON y.w = x.w AND y.place = 2 WHERE x.place = 1 AND x.got = len(list_distinct(x.w))),
pairs AS (SELECT DISTINCT t1, t2 FROM probes),
close AS (
  SELECT DISTINCT a.doc_id, t1, t2 FROM pairs JOIN tokens a ON a.term = t1 LEFT JOIN tokens c ON c.doc_id = a.doc_id AND c.term = t2
  WHERE t2 IS NULL OR abs(a.i - c.i) <= 20),
near AS (
  SELECT doc_id, count(DISTINCT item) AS n FROM close JOIN probes ON probes.t1 = close.t1 AND probes.t2 IS NOT DISTINCT FROM close.t2 JOIN cut USING (w) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(listed.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AS contaminated, coalesce(near.n, 0) AS n_near_items
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN near USING (doc_id)"""


def _op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """The rounds as one table of assignments and one of entries each."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
met{r} AS (
  SELECT vec_id, p, min({{'d': list_sum(list_transform(range(1, 5), lambda k: (parts.x[k] - b.x[k]) * (parts.x[k] - b.x[k]))), 'e': e}}) AS m
  FROM parts JOIN book{r} b USING (p) GROUP BY vec_id, p)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT parts.p, m.e AS e, count(*) AS n, [CAST(sum(x[1]) AS BIGINT), CAST(sum(x[2]) AS BIGINT), CAST(sum(x[3]) AS BIGINT), CAST(sum(x[4]) AS BIGINT)] AS s
  FROM met{r} JOIN parts USING (vec_id, p) GROUP BY parts.p, m.e),
book{r + 1} AS (
  SELECT p, e, CASE WHEN n IS NULL THEN x ELSE list_transform(s, lambda v: (v - ((v % n) + n) % n) // n) END AS x FROM book{r} LEFT JOIN sums{r} USING (p, e))""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, p, v[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) AS r(p)),
book0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts QUALIFY e < 64),{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM met{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (vec_id)"""


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_fingerprint": op10_fingerprint,
    "op11_spelling": op11_spelling,
    "op12_decontamination": op12_decontamination,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op2_suffix_dedup": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op7_minhash": OP7_SQL,
    "op11_spelling": OP11_SQL,
    "op12_decontamination": OP12_SQL,
    "op13_vector_codes": _op13_sql(),
}
