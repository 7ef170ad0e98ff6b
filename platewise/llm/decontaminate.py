"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

An item's set is its distinct shingles of SHINGLE words (words: runs of letters and digits of the lower-cased text); a text of fewer words
is one shingle, the whole of it. An item is found in a document when at least THRESHOLD of the item's shingles are in the document, whose
set has its shingles of SHINGLE words and of each smaller length that some item has.

Items are partitioned by their set size: partition p has the items of more than 2^(p - 1) and at most 2^p shingles, and all signatures
of a partition have one length k: the k shingles with the smallest hashes (a bottom-k MinHash sketch). The share of an item's signature
that is in a document estimates the item's containment in it, however long the document is. A document that has THRESHOLD of an item's n
shingles lacks at most (1 - THRESHOLD) * n of its signature, and k is half as long again as that can be in the partition: an estimate
that lacks more is dropped, and no pair is lost. The other pairs are verified on the shingles themselves.

An item of fewer than SHINGLE words is found wherever its words stand in a row, in documents of any length. Lengths that no item has cost
nothing: they are looked up in the items first (five numbers at most).

Nulls and edges: null and empty texts, and texts without a word, have an empty set and are in no pair. Rows with the same item_id (or a
null one) are one item, whose set has the shingles of all of them. Repeated documents each give their rows. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import saved

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch rows, or pair rows, up to which a table is broadcast (16 and 40 bytes a row); past it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _grams(w: Column, n: int, one) -> Column:
    """one(i) for every place i where n words follow; none in shorter texts."""
    return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.size(w) - n), one)).otherwise(F.array())


def shingle_hashes(w: Column, lengths: list[int]) -> tuple[Column, Column]:
    """Hashes of an array's words, and those of all its shingles of the lengths, given the former as column `hashed `."""
    hashed = F.transform(w, lambda x: F.xxhash64(x))
    of = lambda n: _grams(w, n, lambda i: F.xxhash64(*[F.get(F.col("hashed "), i + j) for j in range(n)]))
    return hashed, F.concat(*[of(n).cast("array<bigint>") for n in lengths])


def shingles(w: str, lengths: list[int]) -> Column:
    """The distinct shingles themselves, given the words as a column (an expression would be computed again for every shingle)."""
    w = F.col(w)
    of = lambda n: _grams(w, n, lambda i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)]))
    return F.array_distinct(F.concat(*[of(n).cast("array<string>") for n in lengths]))


def hashed_sets(rows: DataFrame, keep: list[str], text: str, lengths: list[int]) -> DataFrame:
    """keep, and hashes: those of all shingles."""
    w = rows.select(*keep, words(F.col(text)).alias("words "))
    hashed, sets = shingle_hashes(F.col("words "), lengths)
    return w.withColumn("hashed ", hashed).select(*keep, sets.alias("hashes"))


def _short(items: DataFrame, k: int) -> DataFrame:
    """item_id, text, n: the distinct texts, and the length of their shingles (0 for texts without a word)."""
    return items.select("item_id", "text").distinct().withColumn("n", F.least(F.size(words(F.col("text"))), F.lit(k)))


def shingle_lengths(items: DataFrame, k: int = SHINGLE) -> list[int]:
    """The lengths of the items' shingles: k, and those of shorter items."""
    return sorted({k} | {r["n"] for r in _short(items, k).where("n > 0").select("n").distinct().collect()})


def item_sets(items: DataFrame, lengths: list[int], k: int = SHINGLE) -> DataFrame:
    """item_id, shingles: the distinct shingles of each of its texts."""
    w = _short(items, k).select("item_id", "n", words(F.col("text")).alias("words "))
    return reduce(DataFrame.union, [w.where(F.col("n") == n).select("item_id", shingles("words ", [n]).alias("shingles")) for n in lengths])


def signatures(items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD, lengths: list[int] | None = None) -> DataFrame:
    """item_id, partition, shingle, least: each item's signature, and how many of it a document must have."""
    w = _short(items, k)
    each = reduce(DataFrame.union, [hashed_sets(w.where(F.col("n") == n), ["item_id"], "text", [n]) for n in lengths or shingle_lengths(items, k)])
    each = each.select("item_id", F.explode("hashes").alias("shingle")).distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n"))
    # 2^partition is the smallest power of two that is no less than n
    sizes = sizes.withColumn("partition", F.when(F.col("n") > 1, F.length(F.bin(F.col("n") - 1))).otherwise(0).cast("int"))
    lacks = lambda n: F.floor(n * F.lit(1 - threshold) + 1e-9).cast("int")
    of_partition = lacks(F.pow(F.lit(2.0), F.col("partition")))
    # a partition's signatures are half as long again as what may be lacking of them
    sizes = sizes.withColumn("k", F.least(of_partition + F.ceil(of_partition / 2 + 0.5), "n").cast("int")).withColumn("least", (F.col("k") - lacks(F.col("n"))).cast("int"))
    ranked = each.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy("shingle")))
    got = ranked.join(sizes.withColumnRenamed("item_id", "item "), F.col("item_id").eqNullSafe(F.col("item "))).where("rank <= k")
    return got.select("item_id", "partition", "shingle", "least")


def pairs(docs: DataFrame, items: DataFrame, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """row, doc_id, item_id, n_shingles, n_shared: the verified pairs. docs needs a column row that tells its rows apart."""
    lengths = shingle_lengths(items, k)
    sketch = saved(signatures(items, k, threshold, lengths), "signatures")
    small = sketch.count() <= BROADCAST_ROWS
    anchors = sketch.select("shingle").distinct()
    anchors = F.broadcast(anchors) if small else anchors
    # explode_outer: for explode, the optimizer would filter on the array's size, and compute the array a second time inside that filter
    streamed = hashed_sets(docs, ["row"], "text", lengths).select("row", F.explode_outer("hashes").alias("shingle"))
    # two joins on purpose: the first keeps few of the corpus's shingles, and only those meet the items
    hits = streamed.join(anchors, "shingle", "left_semi").distinct()
    found = hits.join(F.broadcast(sketch) if small else sketch, "shingle").groupBy("row", "partition", "item_id").agg(F.count("*").alias("has"), F.first("least").alias("least"))
    found = saved(found.where("has >= least").select("row", "item_id"), "pairs")
    n_pairs = found.count()
    hit_rows = found.select("row").distinct()
    hit_docs = docs.join(F.broadcast(hit_rows) if n_pairs <= BROADCAST_ROWS else hit_rows, "row", "left_semi").select("row", "doc_id", words(F.col("text")).alias("words ")).select("row", "doc_id", shingles("words ", lengths).alias("in_document"))
    of_items = item_sets(items, lengths, k).select("item_id", F.explode("shingles").alias("s")).groupBy("item_id").agg(F.collect_set("s").alias("of_item"))
    checked = found.join(hit_docs, "row").join(of_items, found["item_id"].eqNullSafe(of_items["item_id"])).select("row", "doc_id", found["item_id"], F.size("of_item").cast("bigint").alias("n_shingles"), F.size(F.array_intersect("of_item", "in_document")).cast("bigint").alias("n_shared"))
    return checked.where(F.col("n_shared") >= F.ceil(F.col("n_shingles") * F.lit(threshold) - 1e-9))


def _row() -> Column:
    """What tells rows apart: 96 bits, as some pairs of ten billion rows agree in 64."""
    return F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shingles, n_shared, containment for every item found in a document."""
    rows = docs.select("doc_id", "text", _row().alias("row"))
    got = pairs(rows, items)
    return got.select("doc_id", "item_id", "n_shingles", "n_shared", F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("containment"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no item is found."""
    rows = docs.withColumn("row ", _row())
    hit = saved(pairs(rows.select(F.col("row ").alias("row"), "doc_id", "text"), items).select(F.col("row").alias("row ")).distinct(), "contaminated")
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    return rows.join(hit, "row ", "left_anti").select(*docs.columns)


ORACLE_SQL = """
with item as (
  select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w, least(len(w), 5) as k from (select distinct item_id, text from benchmark)
), item_shingle as (select distinct item_id, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as s from item where k > 0),
item_size as (select item_id, count(*) as n_shingles from item_shingle group by item_id),
doc as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents),
doc_shingle as (
  select distinct doc_id, unnest([array_to_string(w[i : i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as s from doc, (select distinct k from item where k > 0) where len(w) >= k
), hit as (select doc_id, item_id, count(*) as n_shared from doc_shingle join item_shingle using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, round(n_shared / n_shingles, 6) as containment
from hit join item_size using (item_id) where n_shared >= ceil(n_shingles * 0.8 - 1e-9)
"""
