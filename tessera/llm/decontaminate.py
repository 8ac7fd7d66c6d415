"""Benchmark decontamination: size-partitioned MinHash containment search, all in DataFrame operations.

Test items are classed by their number of shingles, and the index of their sketches is partitioned by these classes: a
document looks only into classes whose smallest item it is long enough to hold. An item's sketch is its smallest shingle
hashes (bottom-k MinHash), those that fewest items hold first, so that a template that all items share is looked up last; k
depends on the size class. An item of n shingles of which a document holds at least t * n lacks at most
m = n - ceil(t * n) there, so at least k - m sketch values must occur in the document: no such pair is lost. Pairs that
pass are verified on the shingles' words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, SIMILARITY, WORD_SPLIT, joined_with, materialise

#: Rows up to which the sketches, the items' shingles or the candidates are broadcast; beyond that they are shuffled.
BROADCAST_ROWS = 200_000
#: Items that hold a shingle up to which its places are matched with all of them before the pairs that passed are looked at.
COMMON_ITEMS = 64


def words_of(text):
    return F.filter(F.split(F.lower(text), WORD_SPLIT), lambda w: w != "")


def _windows(rows: DataFrame, k: int) -> DataFrame:
    """One row per shingle place: the columns of ``rows`` with the place ``at`` among ``words``."""
    return rows.where(F.size("words") > 0).withColumn("at", F.explode(F.sequence(F.lit(0), _places(k) - 1)))


def _hash(k: int):
    return F.xxhash64(*[F.get("words", F.col("at") + i) for i in range(k)])


def _phrase(k: int):
    return F.concat_ws(" ", F.slice("words", F.col("at") + 1, k))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Distinct (item_id, shingle, h) with the item's count n."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), words_of(F.col(text_col)).alias("words")).where("item_id is not null")
    rows = _windows(items, words).select("item_id", _phrase(words).alias("shingle"), _hash(words).alias("h")).distinct()
    return rows.join(rows.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")


def _places(k: int):
    return F.greatest(F.size("words") - F.lit(k - 1), F.least(F.size("words"), F.lit(1)))


def sketches(shingles: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """(h, item_id, needed, size_class, least): each item's sketch, how many of its values a document must hold, and the shingles that a document needs to look into the class."""
    shared = shingles.groupBy("h").agg(F.countDistinct("item_id").alias("items"))
    by_item = shingles.join(shared, "h").groupBy("item_id", "n").agg(F.array_sort(F.collect_set(F.struct("items", "h"))).alias("hs"))  # one short text each
    by_item = by_item.withColumn("size_class", F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long"))  # the class's upper end decides how many values are kept
    smallest = by_item.groupBy("size_class").agg(F.ceil(F.min("n") * F.lit(threshold) - F.lit(1e-9)).alias("least"))
    missing = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9))
    kept = F.least(F.size("hs").cast("long"), F.greatest(2 * F.floor(F.col("size_class") * F.lit(1 - threshold)), F.lit(4)), F.col("n"))
    kept = F.greatest(kept, F.least(missing + 1, F.size("hs").cast("long")))
    values = by_item.select("item_id", "size_class", F.greatest(kept - missing, F.lit(1)).alias("needed"), F.explode(F.slice("hs", F.lit(1), kept.cast("int"))).alias("x"))
    return values.join(F.broadcast(smallest), "size_class").select(F.col("x.h").alias("h"), "item_id", "needed", "size_class", "least")  # a class for each doubling of length


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): pairs in which the document holds at least ``threshold`` of the item's distinct shingles.

    Words are lower-cased runs between ASCII white space. A text of 1 to words - 1 words has one shingle, all its
    words, so such an item is found only in a document of just these words; null and empty texts have none. Items of equal
    text are found together. Rows with a null id are in no pair. Texts that share an id, on either side, are one document or
    item, which holds the shingles of all of them; repeated rows change nothing. Empty tables give no pairs. Other columns
    are ignored, whatever their names.
    """
    shingles = materialise(item_shingles(benchmark, words=words), "items")
    sketch = materialise(sketches(shingles, threshold), "item-sketches")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    rows = texts.select("doc_id", words_of(F.col("text")).alias("words"))
    # distinct per document before the shuffle: a document that repeats a line sends its values once
    longest = rows.withColumn("places", _places(words))
    hits = _windows(longest, words).select("doc_id", "places", _hash(words).alias("h")).join(_small(sketch, sketch.count()), "h").where("places >= least")
    likely = hits.groupBy("doc_id", "item_id", "needed", "h").agg(F.lit(1).alias("one")).groupBy("doc_id", "item_id", "needed").agg(F.count("*").alias("found")).where("found >= needed").select("doc_id", "item_id")
    likely = materialise(likely, "likely")
    n = likely.count()
    whole = joined_with(texts, likely.select("doc_id").distinct(), "doc_id", "left_semi") if n > BROADCAST_ROWS else texts.join(F.broadcast(likely.select("doc_id").distinct()), "doc_id", "left_semi")
    places = _windows(whole.select("doc_id", words_of(F.col("text")).alias("words")), words).select("doc_id", _phrase(words).alias("shingle"))
    holders = materialise(shingles.groupBy("shingle").agg(F.count("*").alias("items")).where(F.col("items") > COMMON_ITEMS).select("shingle"), "common")
    n_common, n_items, pairs = holders.count(), shingles.count(), ["doc_id", "item_id"]
    sets = shingles.select("item_id", "shingle", "n")
    rare = sets if not n_common else sets.join(_small(holders, n_common), "shingle", "left_anti")
    shared = places.join(_small(rare, n_items), "shingle").join(_small(likely, n), pairs, "left_semi").select("doc_id", "item_id", "n", "shingle")
    if n_common:  # what many items hold is matched with the pairs that passed only
        common = places.join(_small(holders, n_common), "shingle", "left_semi").distinct().join(_small(likely, n), "doc_id").join(_small(sets, n_items), ["item_id", "shingle"])
        shared = shared.unionByName(common.select("doc_id", "item_id", "n", "shingle"))
    return (
        shared.groupBy("doc_id", "item_id", "n", "shingle").agg(F.lit(1).alias("one")).groupBy("doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
        .where(F.col("n_shared") >= F.ceil(F.col("n") * F.lit(threshold) - F.lit(1e-9)))
        .select("doc_id", "item_id", "n_shared", F.col("n").alias("n_shingles"))
    )


def mark(docs: DataFrame, benchmark: DataFrame, threshold: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """Every row of ``docs``: doc_id, contaminated (0 or 1), n_items, items (ids, comma-joined, ascending), n_shared (of the item most shared).

    Null and empty texts and rows with a null id hold no item; rows that share an id get the same result; else as ``find_leaks``.
    """
    found = find_leaks(docs, benchmark, threshold=threshold, words=words).groupBy("doc_id").agg(F.sort_array(F.collect_list("item_id")).alias("ids"), F.max("n_shared").alias("most"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.when(F.col("ids").isNull(), 0).otherwise(1).alias("contaminated"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce(F.concat_ws(",", F.col("ids").cast("array<string>")), F.lit("")).alias("items"), F.coalesce("most", F.lit(0)).cast("long").alias("n_shared")
    )


ORACLE_SQL = """
WITH w AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM benchmark),
dp AS (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM w WHERE len(ws) > 0),
bp AS (SELECT id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM b WHERE len(ws) > 0),
ds AS (SELECT DISTINCT id, array_to_string(ws[i:i+4], ' ') AS s FROM dp),
bs AS (SELECT DISTINCT id, array_to_string(ws[i:i+4], ' ') AS s FROM bp),
n AS (SELECT id, count(*) AS n FROM bs GROUP BY id),
hit AS (SELECT ds.id AS doc_id, bs.id AS item_id, count(*) AS c FROM ds JOIN bs USING (s) GROUP BY 1, 2),
ok AS (SELECT doc_id, item_id, c FROM hit JOIN n ON n.id = item_id WHERE c >= ceil(n * 0.8 - 1e-9)),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(c) AS n_shared FROM ok GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN g.doc_id IS NULL THEN 0 ELSE 1 END AS contaminated, coalesce(n_items, 0) AS n_items, coalesce(items, '') AS items, coalesce(n_shared, 0) AS n_shared
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
