"""The corpus queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import collocations, decontamination, html_text, jaccard_join, ordinal_quality, packing, quality_rules, sharding, simhash, suffix_dedup, token_blocks, toxicity, turn_repair
from tallyforge.llm.common import scratch, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = ordinal_quality.fit(docs, labels.select("doc_id", ordinal_quality.grade(F.col("quality"), F.col("toxic")).alias("grade")))
    return ordinal_quality.score(docs, model)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.groups(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedupe(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.stored(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_blocks.round_trip(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), second=vocabulary("byte_bpe_50k.tiktoken"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op9_quality_rules, which SQL can express."""
    return op9_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired(turn_repair.damaged(table(spark, sf_dir, "conversations")))


_QUERIES = (op1_ordinal_quality, op2_jaccard_join, op3_suffix_dedup, op4_decontamination, op5_sharding, op6_token_blocks, op7_toxicity, op8_html_text, op9_quality_rules, quality_base, op10_best_fit_packing, op11_phrase_collocations, op12_simhash_near_dedup, op13_turn_repair)

_SHARDS = """SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256, lang, source, n_chars FROM documents"""


_BASE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
 v AS (SELECT doc_id, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS five, lead(word, 4) OVER o IS NOT NULL AS whole FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM v WHERE whole) q, (VALUES (0), (1), (2), (3), (4)) x(k) WHERE c > 1 GROUP BY 1),
 l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d)
 SELECT d.doc_id, len(w) AS n_words, CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
 coalesce(r.n, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed FROM d JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id"""

_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, row_number() OVER () AS n, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p), u AS (SELECT lang, n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
 v AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4 FROM u WINDOW o AS (PARTITION BY n ORDER BY i)),
 g AS (SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM v GROUP BY ALL UNION ALL SELECT lang, 2, concat_ws(' ', w1, w2), count(*) FROM v WHERE w2 IS NOT NULL GROUP BY ALL
 UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3), count(*) FROM v WHERE w3 IS NOT NULL GROUP BY ALL UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4), count(*) FROM v WHERE w4 IS NOT NULL GROUP BY ALL),
 c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE m > 1 AND f >= 30),
 k AS (SELECT c.lang, c.m, c.phrase, c.a, k, concat(lang, '|', array_to_string(ws[:k], ' ')) AS head, concat(lang, '|', array_to_string(ws[k + 1:], ' ')) AS rest FROM c, (VALUES (1), (2), (3)) s(k) WHERE k < c.m),
 h AS (SELECT concat(lang, '|', phrase) AS id, f FROM g), z AS (SELECT k.*, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM k JOIN h l ON l.id = k.head JOIN h r ON r.id = k.rest),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM z) q WHERE nth = 1),
 o AS (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = b.lang AND x.m > b.m AND contains(concat(' ', x.phrase, ' '), concat(' ', b.phrase, ' ')) AND 100 * x.a >= 80 * b.a))
 SELECT o.lang, rank, phrase, a, l, r, n.n, score FROM o JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE m = 1 GROUP BY 1) n ON n.lang = o.lang WHERE rank <= 2000"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontamination.ORACLE, "op5_sharding": _SHARDS, "op11_phrase_collocations": _PHRASES, "quality_base": _BASE}
