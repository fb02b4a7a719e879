"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leasebook.llm.byte_bpe import encode_decode
from leasebook.llm.collocations import collocations
from leasebook.llm.common import documents, table
from leasebook.llm.conversation_repair import damaged, repair
from leasebook.llm.decontamination import contamination
from leasebook.llm.language_id import learned_and_identified
from leasebook.llm.line_dedup import without_repeated_lines
from leasebook.llm.minhash_dedup import groups
from leasebook.llm.order_minhash import edited_fingerprints
from leasebook.llm.pseudonyms import findings, pseudonymise
from leasebook.llm.quality import learned_and_scored
from leasebook.llm.sharding import shard
from leasebook.llm.simhash_dedup import groups as simhash_groups
from leasebook.llm.substring_dedup import remove_repeats


# Key of the registered query; real use passes a secret of its own.
KEY_OF_CHECKS = "not a secret"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_left"), "n_removed",
        F.sha2("text", 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_and_identified(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir), shingle_words=4)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_and_scored(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce(F.size(findings("text")), F.lit(0)).cast("long").alias("n_found"), "text")
    return pseudonymise(docs, KEY_OF_CHECKS)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_quality": op7_quality,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_decontamination": op9_decontamination,
    "op10_order_minhash": op10_order_minhash,
    "op11_collocations": op11_collocations,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x20\x09-\x0D]+"

SQL = {
    "op4_substring_dedup": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORDS}'), []) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d),
y AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS win FROM x),
f AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS k FROM y),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM f WHERE k > 1),
r AS (SELECT doc_id, list(p) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)),
           lambda z: NOT list_contains(coalesce(gone, []), z[2])), lambda z: z[1]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
""",
    "op5_minhash_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{WORDS}'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.h = b.h AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) AS component_id,
       s.doc_id <= coalesce(m, s.doc_id) AS kept
FROM s LEFT JOIN c USING (doc_id)
""",
    "op9_decontamination": rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{LETTERS}'), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWER}, '{LETTERS}') AS w FROM benchmark WHERE text IS NOT NULL),
z AS (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s+size-1], ' ') AS win FROM z),
k AS (SELECT DISTINCT size FROM iw),
ds AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, k WHERE len(w) >= size),
dw AS (SELECT doc_id, size, s, array_to_string(w[s:s+size-1], ' ') AS win FROM ds),
h AS (SELECT doc_id, size, s, item_id FROM dw JOIN iw USING (size, win)),
p AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS q FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(v, ',' ORDER BY v) AS ids
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS v FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(p.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, p.n IS NOT NULL AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
x AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS s FROM w),
y AS (SELECT lang, w, s, unnest(range(1, 6)) AS m FROM x),
c AS (SELECT lang, w[s:s+m-1] AS ph, count(*) AS f FROM y WHERE s + m - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
k AS (SELECT lang, ph, f, unnest(range(1, len(ph))) AS k FROM c WHERE len(ph) > 1),
q AS (SELECT k.lang, k.ph, k.f, k.k, l.f AS l, r.f AS r, (1000 * k.f::HUGEINT * n::HUGEINT) // (l.f::HUGEINT * r.f::HUGEINT) AS score
      FROM k JOIN t USING (lang) JOIN c l ON l.lang = k.lang AND l.ph = k.ph[1:k.k] JOIN c r ON r.lang = k.lang AND r.ph = k.ph[k.k+1:]),
b AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
e AS (SELECT lang, f, ph[1:len(ph)-1] AS ph FROM c WHERE len(ph) > 2 UNION SELECT lang, f, ph[2:] FROM c WHERE len(ph) > 2),
z AS (SELECT b.*, array_to_string(ph, ' ') AS phrase FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.lang = b.lang AND e.ph = b.ph AND e.f >= b.f)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank FROM z)
SELECT o.lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN t USING (lang) WHERE rank <= 2000
""",
}
