"""One query for each operator of this package, over its whole table, and its oracle SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.llm import (
    lexical_search, licences, minhash_postings, mixing, near_duplicates, neighbours, periodic_runs, pieces, quality_model, quality_rules,
    substring_dedup, token_counts, token_files,
)
from flagstone.session import scratch_dir

WORD = r"[^\x20\x09-\x0D]+"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = scratch_dir(spark, "token-files")
    token_files.write_files(_table(spark, folder, "documents"), files)
    return token_files.read_files(spark, files)


def op2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP2_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]), lambda a, b: a + b) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""


def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixing.plan(docs).select("row.doc_id", "size", "source_size", "target", taken)


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    (('0x' || substr(md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
s1 AS (SELECT *, CASE place % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, source_size * 2.0::DOUBLE AS cap FROM s0),
s2 AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS unit
  FROM s1 WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, weight * unit > cap AS is_full FROM s2),
s4 AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE weight * (SELECT min_by(unit, cap / weight) FROM s3 WHERE NOT is_full) END AS target FROM s3),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM s4),
m0 AS (
  SELECT d.source, floor(sqrt(size))::BIGINT AS z, sum(size)::DOUBLE AS words, any_value(target - certain * source_size) AS missing
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source WHERE size > 0 AND target - certain * source_size > 0 GROUP BY ALL),
m1 AS (
  SELECT source, z, (missing - coalesce(sum(words) OVER (PARTITION BY source ORDER BY z DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(z * words) OVER (PARTITION BY source ORDER BY z DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM m0),
m2 AS (SELECT source, max_by(c, z) AS c FROM m1 WHERE c * z < 1 GROUP BY source),
v0 AS (
  SELECT doc_id, d.source, size, source_size, target, certain, target - certain * source_size AS missing, c * floor(sqrt(size)) AS p, u
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN m2 ON d.source IS NOT DISTINCT FROM m2.source),
v1 AS (SELECT *, CASE WHEN size = 0 OR p IS NULL THEN u WHEN p >= 1 THEN 0 ELSE u / (1 - u) * (1 - p) / p END AS v FROM v0),
o AS (
  SELECT doc_id, size, source_size, target, certain, missing,
    sum(size) OVER (PARTITION BY source ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
    sum(size) OVER (PARTITION BY source, v) AS own
  FROM v1)
SELECT doc_id, size, source_size, target, (size * (certain + CASE
  WHEN missing > 0 AND (total <= missing OR (total - own < missing AND total - missing < missing - (total - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM o
"""


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, folder, "documents"))


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.sample_pieces(_table(spark, folder, "documents"), k=2)


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    rated = quality_rules.rate(_table(spark, folder, "documents").select("doc_id", "text", "source"))
    return rated.select("row.doc_id", *quality_rules.COUNTS, "base_failed", "kept", "lost_share")


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 5),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i:i+4]) AS n FROM win),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g WHERE n > 1) GROUP BY rid),
raw AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
norm AS (
  SELECT DISTINCT source, t, trim(unnest(string_split(lower(regexp_replace(t, '[\x20\x09\x0B-\x0D]+', ' ', 'g')), chr(10))), ' ') AS line FROM d),
lines AS (SELECT *, len(string_split(line, ' ')) AS n FROM norm WHERE line <> ''),
freq AS (SELECT source, line FROM lines GROUP BY ALL HAVING count(*) > 100),
lost AS (
  SELECT l.source, l.t, sum(CASE WHEN f.line IS NULL THEN 0 ELSE n END) / sum(n) AS lost_share
  FROM lines l LEFT JOIN freq f ON l.line = f.line AND l.source IS NOT DISTINCT FROM f.source GROUP BY ALL),
base AS (
  SELECT doc_id, source, t, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND coalesce(lost_share, 0) <= 0.5 AS kept,
  coalesce(lost_share, 0.0) AS lost_share
FROM base LEFT JOIN lost ON base.t = lost.t AND base.source IS NOT DISTINCT FROM lost.source
"""

def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan_licenses(_table(spark, folder, "documents"))


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.join(_table(spark, folder, "documents"))


def op9_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, folder, "documents"))


OP9_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
win AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
g AS (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY hash(ws[i:i+12]), ws[i:i+12]) AS first FROM win),
gone AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM g WHERE first < coalesce(doc_id, 9223372036854775807)) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
  sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(ps, []), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (rid)
"""


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op11_minhash_postings(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_postings.near_duplicates(_table(spark, folder, "documents"))


OP11_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
    ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i:i+2]))) END AS s FROM d),
kinds AS (SELECT s, row_number() OVER () AS kid, len(s) AS n, min(coalesce(doc_id, 9223372036854775807)) AS first FROM sets WHERE len(s) > 0 GROUP BY s),
grams AS (SELECT kid, n, unnest(s) AS g FROM kinds),
posts AS (SELECT kid, n, hash(g) AS g FROM grams),
pairs AS (
  SELECT a.kid AS a, b.kid AS b FROM posts a JOIN posts b ON a.g = b.g AND a.kid <> b.kid AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.kid, b.kid, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT kid, kid AS other FROM kinds UNION SELECT r.kid, p.b FROM reach r JOIN pairs p ON r.other = p.a),
heads AS (SELECT r.kid, min(k.first) AS head FROM reach r JOIN kinds k ON r.other = k.kid GROUP BY r.kid),
o AS (
  SELECT doc_id, len(sets.s) AS n_shingles, CASE WHEN head IS NULL THEN doc_id WHEN head < 9223372036854775807 THEN head END AS component_id
  FROM sets LEFT JOIN kinds ON sets.s = kinds.s LEFT JOIN heads USING (kid))
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o
"""


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS ts FROM documents),
q AS (SELECT row_number() OVER () AS qid, item_id, unnest({_TERMS}) AS term FROM benchmark),
asked AS (SELECT qid, item_id, term, count(*) AS times FROM q GROUP BY ALL),
totals AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
found AS (SELECT rid, doc_id, 75 + (25 * len(ts) * n_docs) // n_terms AS m, unnest(ts) AS term FROM d, totals),
posts AS (SELECT rid, doc_id, m, term, count(*) AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posts, totals GROUP BY term),
scored AS (
  SELECT qid, item_id, rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN posts USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The order of words that the query's contract asks for: from some place on a tenth of the documents repeat a period."""
    if doc_id is None:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic_runs.find_runs(_table(spark, folder, "documents"), planted_period)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    start, length, period = -F.col("x.s"), F.col("x.n"), -F.col("x.p")
    return found.select(
        "doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_pieces": op5_pieces,
    "op6_quality_rules": op6_quality_rules,
    "op7_licenses": op7_licenses,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_minhash_postings": op11_minhash_postings,
    "op12_lexical_search": op12_lexical_search,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL: dict[str, str] = {
    "op2_neighbours": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op6_quality_rules": OP6_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op11_minhash_postings": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
}
