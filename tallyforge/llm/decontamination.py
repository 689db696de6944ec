"""Benchmark decontamination: short test items found inside long documents, with DataFrame functions only.

Containment search by MinHash sketches in size partitions: the items are partitioned by the size of
their set of word 5-grams, and an item of a partition is indexed under the k smallest hashes of its set,
where k is one more than a quarter of the partition's largest size. An item of which a document holds
three quarters or more misses fewer than k of its shingles there, so at least one key is in the document:
the search loses nothing. Each pair found is then verified with the shingles themselves.

Null, empty and short texts: a text of fewer than five words is one shingle, one without words has none
and is in nothing. Rows of one doc_id count as one document, those without doc_id or item_id are in no
pair. Items with equal texts are reported one by one. An empty table gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import cut, sized_broadcast

WIDTH = 5
PERCENT = 75
#: Rows of the items' side that may be broadcast; beyond it the join shuffles.
MOST_BROADCAST = 2_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _starts(w: Column) -> Column:
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - WIDTH, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column) -> Column:
    """The hashes of the windows of an array of word hashes (windows past the end take nulls)."""
    return F.transform(_starts(w), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(WIDTH))))


def shingle_texts(w: Column) -> Column:
    return F.transform(_starts(w), lambda i: F.array_join(F.slice(w, i + 1, WIDTH), " "))


def _hashed(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).select(key, F.explode(shingle_hashes(F.col("w"))).alias("h"))


def item_keys(items: DataFrame) -> DataFrame:
    """item_id, h: the sketch of every item, by size partition."""
    sets = items.where("item_id IS NOT NULL").select("item_id", F.array_sort(F.array_distinct(shingle_hashes(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))))).alias("s"))
    largest = F.pow(F.lit(2), F.floor(F.log2(F.size("s"))) + 1) - 1
    k = (F.floor(largest * (100 - PERCENT) / 100) + 1).cast("int")
    return sets.where(F.size("s") > 0).select("item_id", F.explode(F.slice("s", F.lit(1), k)).alias("h")).distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs doc_id, item_id with n_shingles (of the item) and n_found (of them in the document), at PERCENT or more."""
    docs, items = docs.where("doc_id IS NOT NULL").select("doc_id", "text"), items.where("item_id IS NOT NULL").select("item_id", "text")
    pairs = cut(_hashed(docs, "doc_id").join(sized_broadcast(item_keys(items), MOST_BROADCAST), "h").select("doc_id", "item_id").distinct(), "leak-pairs")
    # the words stand in a column of their own: an expression over the text would be worked out anew for every window
    worded = items.select("item_id", words(F.col("text")).alias("w"))
    texts = worded.select("item_id", F.explode(F.array_distinct(shingle_texts(F.col("w")))).alias("g")).distinct()
    sizes = texts.groupBy("item_id").agg(F.count("*").alias("n_shingles"))
    asked = sized_broadcast(pairs.select("doc_id").distinct(), MOST_BROADCAST)
    grams = docs.join(asked, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(shingle_texts(F.col("w"))).alias("g"))
    hits = grams.join(sized_broadcast(texts, MOST_BROADCAST), "g").distinct().join(sized_broadcast(pairs, MOST_BROADCAST), ["doc_id", "item_id"], "left_semi")
    counts = hits.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_found"))
    return counts.join(sized_broadcast(sizes, MOST_BROADCAST), "item_id").where(100 * F.col("n_found") >= PERCENT * F.col("n_shingles")).select("doc_id", "item_id", "n_shingles", "n_found")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs."""
    return docs.join(leaks(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


_SETS = r"""SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' '))) AS g
FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM {table} WHERE {key} IS NOT NULL) WHERE len(w) > 0"""

ORACLE = f"""WITH d AS ({_SETS.format(key="doc_id", table="documents")}), b AS ({_SETS.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY 1)
SELECT doc_id, item_id, n_shingles, count(*) AS n_found FROM d JOIN b USING (g) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_shingles HAVING 100 * count(*) >= 75 * n_shingles"""
