"""The operators of this package as queries over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import (
    decontamination,
    divergence,
    language_id,
    lexical_search,
    lm_scoring,
    merkle,
    mixing,
    phrase_dedup,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    token_files,
)
from sparkprep.llm.shared import crc_of_id
from sparkprep.session import new_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


MIXING_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
 ('0x' || substr(md5('7-' || CAST(doc_id AS VARCHAR)), 1, 12))::BIGINT AS draw,
 FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
 CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
 FROM d GROUP BY source),
l AS (SELECT max(level) AS level FROM (SELECT ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3 * b.source_size) FROM s b
   WHERE 3.0 * b.source_size / b.weight < 3.0 * a.source_size / a.weight), 0))::DOUBLE
  / (SELECT sum(b.weight) FROM s b WHERE 3.0 * b.source_size / b.weight >= 3.0 * a.source_size / a.weight) AS level,
  3.0 * a.source_size / a.weight AS cap FROM s a) WHERE level <= cap),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM s CROSS JOIN l),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
n AS (SELECT *, target - whole * source_size AS need FROM w),
o AS (SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.need,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
 (size * (whole + CASE WHEN need > 0 AND upto - size / 2.0 < need THEN 1 ELSE 0 END))::BIGINT AS taken FROM o
"""

DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k FROM
 (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS k FROM
 (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d JOIN z ON len(w) >= size)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.size = bw.size),
hit AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS j FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

SUFFIX_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS x FROM documents),
p AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d WHERE length(x) >= 200),
h AS (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS k FROM p),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM h),
g AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, TRUE) AS starts FROM r WHERE n > 1),
e AS (SELECT doc_id, i, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM e GROUP BY doc_id, run),
u AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b FROM s GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1),
  lambda j: substr(x, CASE WHEN j = 0 THEN 1 ELSE 2 * b[j] + 1 END,
   CASE WHEN j = n_spans THEN length(x) ELSE 2 * a[j + 1] - CASE WHEN j = 0 THEN 0 ELSE 2 * b[j] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN u USING (doc_id)
"""

SUBSTRING_DEDUP_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM h GROUP BY k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM h JOIN f USING (k) WHERE first < doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
 sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(
  list_filter(w, lambda x, j: NOT list_contains(gone, j)), ' ') END) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""

LEXICAL_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
z AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM e),
t AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM e) GROUP BY ALL),
q AS (SELECT item_id, term, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM t GROUP BY term),
w AS (SELECT item_id, term, c * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM q JOIN f USING (term) CROSS JOIN z),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
 FROM t JOIN w USING (term) CROSS JOIN z GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""

SOURCE_DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, sum(n) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k ON g.lang = k.lang
 LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM f JOIN v USING (lang)),
l AS (SELECT lang, term, sum(n) AS n FROM f GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l JOIN v USING (lang)),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def _removed(spans: str) -> Column:
    """How much all spans of an array take."""
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)


@query("op2_sharding")
def op2_sharding(spark, folder):
    path = new_path(spark, "llm-shards")
    return sharding.assignment(table(spark, folder, "documents"), path, shards=24, seed=7)


@query("op3_lm_scoring")
def op3_lm_scoring(spark, folder):
    held_out = crc_of_id(F.col("doc_id")) % 10 == 0
    scored = lm_scoring.score(table(spark, folder, "documents"), ~held_out)
    return scored.withColumn("held_out", ~F.col("learned")).drop("learned")


@query("op4_merkle_fingerprints")
def op4_merkle_fingerprints(spark, folder):
    return merkle.against_next(table(spark, folder, "documents"))


@query("op5_mixing", MIXING_SQL)
def op5_mixing(spark, folder):
    mixed = mixing.mix(table(spark, folder, "documents"), seed=7)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op6_decontamination", DECONTAMINATION_SQL)
def op6_decontamination(spark, folder):
    marked = decontamination.contamination(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_language_id")
def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    learn = (crc_of_id(F.col("doc_id")) % 5 != 0) & F.col("lang").isNotNull()
    found = language_id.identify(docs, learn)
    held_out = (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score")


@query("op8_suffix_dedup", SUFFIX_DEDUP_SQL)
def op8_suffix_dedup(spark, folder):
    kept = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        "n_bytes",
        _removed("removed").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_substring_dedup", SUBSTRING_DEDUP_SQL)
def op9_substring_dedup(spark, folder):
    kept = phrase_dedup.remove_repeats(table(spark, folder, "documents"))
    return kept.select(
        "doc_id",
        "n_words",
        _removed("removed").alias("n_removed"),
        F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"),
    )


@query("op10_quality_classifier")
def op10_quality_classifier(spark, folder):
    labels = table(spark, folder, "labels")
    trusted = labels.where("quality = 1 AND toxic = 0").select("doc_id")
    return quality.classify(table(spark, folder, "documents"), trusted)


@query("op11_token_files")
def op11_token_files(spark, folder):
    import public_tokenizers

    path = new_path(spark, "llm-tokens")
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(table(spark, folder, "documents"), path, vocabulary, end_id=2)
    tokens = token_files.read_tokens(spark, path)
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op12_lexical_search", LEXICAL_SEARCH_SQL)
def op12_lexical_search(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return lexical_search.search_documents(docs, items, k=20)


@query("op13_source_divergence", SOURCE_DIVERGENCE_SQL)
def op13_source_divergence(spark, folder):
    return divergence.audit(table(spark, folder, "documents"), min_docs=30, top_terms=50)
