"""MinHash near-dedup with odd sketches.

A document's set is its distinct shingles of consecutive words (words: runs of other characters than ASCII white space, A-Z lower-cased;
with fewer words than a shingle, the whole sequence is the one shingle). Documents with equal sets are grouped first, by a 128-bit hash,
and only one of each group goes on. Its BANDS * ROWS MinHash samples give the bands, and are folded into a parity bitmap of BITS bits: the
population count of the XOR of two bitmaps estimates the share of samples that differ, hence the similarity.

Pairs are not listed bucket by bucket. Each bucket's members are tied to its most connected member (a star); stars whose odd sketches
pass are verified on the full sets. Members whose star shows no similarity are compared, by odd sketch, with the bucket's other members
(but those so near the centre that they cannot be near copies of the former) in blocks of BLOCK rows, and tied to what passes. Families
(buckets joined by stars with some similarity at all) that this leaves in several components go through an exhaustive check: the members
outside the family's largest component against all others, in blocks of BLOCK rows, odd sketch first and full sets after. So every link
between documents that share a bucket counts, and a large group of copies costs one star.

Nulls and edges: a null text, or one without words, has an empty set, is linked with nothing and is its own component. Rows that share
a doc_id are one document. A row with a null doc_id takes the component of documents with an equal set, else null, and is kept
only in the latter case. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import as_long, bloom, map_rows, mix, rolled, saved, word_hashes

BANDS, ROWS = 30, 5
BITS = 1024
SIMILARITY = 0.8
#: Odd-sketch estimates that reject: for verification (more than five standard deviations under SIMILARITY) and for families.
DOUBT, FAMILY = 0.6, 0.3
BLOCK = 1024
#: Families (40 bytes a row) up to which their table is broadcast; past it Spark joins by shuffle and splits large families.
BROADCAST_ROWS = 1_000_000
_RNG = np.random.default_rng(1729)
_A = _RNG.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles. Shingles of fewer words than k hash apart from those of k."""
    h = word_hashes(text.lower())
    n = min(k, len(h))
    return np.unique(mix(rolled(h, n) + np.uint64(n)) if n else h)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples: the minimum of each of BANDS * ROWS hash functions."""
    least = None
    for at in range(0, len(shingles), 2048):
        m = ((shingles[at : at + 2048, None] * _A + _B) >> np.uint64(24)).min(axis=0)
        least = m if least is None else np.minimum(least, m)
    return least


def odd_sketch(sample: np.ndarray) -> np.ndarray:
    """Parity bitmap of the samples, as BITS / 64 words."""
    at = mix(sample + (np.arange(1, len(sample) + 1, dtype=np.uint64) << np.uint64(48))) % np.uint64(BITS)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.uint64)


def estimate(differing: np.ndarray) -> np.ndarray:
    """Similarity from the population count of the XOR of two odd sketches."""
    share = np.minimum(2 * differing / BITS, 1 - 1e-9)
    return 1 + BITS / 4 * np.log(1 - share) / (BANDS * ROWS)


#: The largest population count whose estimate is still at least the bound.
_MOST = {bound: int(max(d for d in range(BITS // 2) if estimate(np.float64(d)) >= bound)) for bound in (SIMILARITY, DOUBT, FAMILY)}


def sketch(docs: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, set1 and set2 (the set's hash; null for an empty set), bands, odd."""

    def make():
        bands_of = np.arange(1, BANDS + 1, dtype=np.uint64)

        def work(batch):
            out = {k: [] for k in ("doc_id", "n_shingles", "set1", "set2", "bands", "odd")}
            for doc, raw in zip(batch["doc_id"], batch["text "], strict=True):
                s = shingle_set(raw or b"", shingle)
                row = doc, len(s), None, None, None, None
                if len(s):
                    key = xxhash.xxh128_intdigest(s.tobytes())
                    sample = samples(s)
                    band = bands_of.copy()
                    for i in range(ROWS):
                        band = mix(band * np.uint64(0x9E3779B97F4A7C15) + sample[i::ROWS])
                    row = doc, len(s), (key >> 64) - 2**63, (key & (2**64 - 1)) - 2**63, as_long(band), as_long(odd_sketch(sample))
                for k, v in zip(out, row, strict=True):
                    out[k].append(v)
            return out

        return work

    return map_rows(docs.select("doc_id", F.col(text).alias("text ")), "doc_id bigint, n_shingles bigint, set1 bigint, set2 bigint, bands array<bigint>, odd array<bigint>", make, binary=("text ",))


def _differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def full_sets(docs: DataFrame, ids: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """id, shingles of the documents in ids: a Bloom filter of the ids thins the scan, a join settles it."""
    shared = docs.sparkSession.sparkContext.broadcast(bloom(ids, "id"))

    def make():
        def work(batch):
            ids, sets = [], []
            known = [i for i, d in enumerate(batch["id"]) if d is not None]
            among = shared.value.has(np.array([batch["id"][i] for i in known], np.int64).view(np.uint64))
            for i, wanted in zip(known, among, strict=True):
                if wanted and (raw := batch["text "][i]):
                    s = shingle_set(raw, shingle)
                    if len(s):
                        ids.append(batch["id"][i])
                        sets.append(as_long(s))
            return {"id": ids, "shingles": sets}

        return work

    rows = docs.select(F.col("doc_id").alias("id"), F.col(text).alias("text "))
    return map_rows(rows, "id bigint, shingles array<bigint>", make, binary=("text ",)).join(ids, "id", "left_semi")


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of every node of edges (a, b): alternating large-star and small-star steps."""
    edges = saved(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(least.select("a", "m")).distinct()
        edges = saved(small, "edges")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def links(docs: DataFrame, shingle: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sketch table, and set1, set2, id, component of every group of equal sets."""
    every = saved(sketch(docs, shingle, text), "sketch")
    unique = saved(every.where(F.col("set1").isNotNull() & F.col("doc_id").isNotNull()).groupBy("set1", "set2").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("odd").alias("odd")), "unique")
    odd = unique.select("id", "odd")
    rows = unique.select("id", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = saved(rows.join(sizes, "bucket"), "members")
    weight = members.groupBy("id").agg(F.sum("n").alias("weight"))
    centres = saved(members.join(weight, "id").groupBy("bucket").agg(F.max_by("id", F.struct("weight", "id")).alias("centre")), "centres")
    stars = members.join(centres, "bucket").where("id != centre").select("id", "centre").distinct()
    stars = stars.join(odd, "id").join(odd.select(F.col("id").alias("centre"), F.col("odd").alias("odd_centre")), "centre")
    judged = saved(stars.select("id", "centre", _differing("odd", "odd_centre").alias("differing")), "judged")
    stars = saved(judged.where(F.col("differing") <= _MOST[FAMILY]).union(_rejected(members, centres, judged, odd)), "stars")
    ids = saved(stars.select("id").union(stars.select("centre")).distinct(), "ids")
    sets = saved(full_sets(docs, ids, shingle, text), "sets")
    doubtful = stars.where(F.col("differing") <= _MOST[DOUBT])
    pairs = doubtful.join(sets, "id").join(sets.select(F.col("id").alias("centre"), F.col("shingles").alias("of_centre")), "centre")
    both, total = F.size(F.array_intersect("shingles", "of_centre")), F.size("shingles") + F.size("of_centre")
    edges = saved(pairs.where(both * 100 >= (total - both) * int(SIMILARITY * 100)).select(F.col("id").alias("a"), F.col("centre").alias("b")).distinct(), "links")
    first = saved(connected(edges), "components")
    families = connected(stars.select(F.col("id").alias("a"), F.col("centre").alias("b")))
    more = _rest(families, first, sets, odd)
    component = connected(edges.union(more)).withColumnRenamed("node", "id")
    groups = unique.select("set1", "set2", "id").join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return every, groups


def _rejected(members: DataFrame, centres: DataFrame, judged: DataFrame, odd: DataFrame) -> DataFrame:
    """id, centre, differing of members that their bucket's centre rejects and members of that bucket whose odd sketches pass as doubtful:
    of all such pairs in a block, as many as connect what they connect."""
    loose = judged.where(F.col("differing") > _MOST[SIMILARITY]).select("id", "centre", (F.col("differing") > _MOST[FAMILY]).alias("rejected"))
    pool = saved(members.where("n > 2").join(centres, "bucket").join(loose, ["id", "centre"]).select("bucket", "id", "rejected"), "pool")
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "id", "rejected")).alias(f"mark{i}") for i in range(2)]
    shape = pool.groupBy("bucket").agg(F.count("*").alias("m"), F.max("rejected").alias("any"), *marks).where("any and m > 1")
    # of buckets with the same members, one
    shape = saved(shape.groupBy("m", "mark0", "mark1").agg(F.min("bucket").alias("bucket")), "shape")
    # small buckets are packed, about BLOCK rows together; large ones are cut into blocks, and every two blocks meet
    packs = -(-(shape.where(F.col("m") <= BLOCK).agg(F.sum("m")).first()[0] or 1) // BLOCK)
    n = F.ceil(F.col("m") / BLOCK).cast("int")
    block = F.pmod(F.xxhash64("id"), n).cast("int")
    pack = F.when(F.col("m") <= BLOCK, F.pmod(F.xxhash64("bucket"), F.lit(packs))).otherwise(F.col("bucket"))
    rows = pool.join(shape.select("bucket", "m"), "bucket").select("bucket", "id", "rejected", pack.alias("pack"), n.alias("blocks"), block.alias("block"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    rows = rows.select("bucket", "id", "rejected", "pack", F.explode(cell).alias("cell")).join(odd, "id").select("pack", "cell.*", "bucket", "id", "rejected", "odd")
    most = _MOST[DOUBT]

    def check(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["bucket", "id"])
        bucket, every, is_rejected = (pdf[c].to_numpy() for c in ("bucket", "id", "rejected"))
        sketches, out = np.stack(pdf["odd"].to_numpy()).view(np.uint64), []
        cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, bitmaps, part = every[a:b], sketches[a:b], np.arange(b - a)
            for x in np.flatnonzero(is_rejected[a:b]):
                differing = np.bitwise_count(bitmaps ^ bitmaps[x]).sum(axis=1, dtype=np.int64)
                near = np.flatnonzero((differing <= most) & (part != part[x]))
                if len(near):
                    parts, first = np.unique(part[near], return_index=True)
                    out += [(ids[x], ids[y], differing[y]) for y in near[first]]
                    part[np.isin(part, parts)] = part[x]
        return pd.DataFrame(out, columns=["id", "centre", "differing"]).astype("int64")

    return rows.groupBy("pack", "i", "j").applyInPandas(check, "id bigint, centre bigint, differing bigint")


def _rest(families: DataFrame, first: DataFrame, sets: DataFrame, odd: DataFrame) -> DataFrame:
    """Links (a, b) inside families that are in several components so far, between members of different components."""
    placed = saved(families.select(F.col("node").alias("id"), F.col("component").alias("family")).join(first.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")), "placed")
    sizes = placed.groupBy("family", "component").agg(F.count("*").alias("n"))
    shape = sizes.groupBy("family").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_other"), F.count("*").alias("k")).where("k > 1")
    # a table of its own: the join neither has to deal the members out by family as the counts were, nor to keep a large family in one task
    shape = saved(shape.drop("k"), "families")
    rows = placed.join(F.broadcast(shape) if shape.count() <= BROADCAST_ROWS else shape, "family").withColumn("other", F.col("component") != F.col("main"))
    of_other, of_main = F.ceil(F.col("n_other") / BLOCK), F.ceil(F.col("n_main") / BLOCK)
    block = F.pmod(F.xxhash64("id"), F.when(F.col("other"), of_other).otherwise(of_main)).cast("int")
    rows = rows.withColumn("block", block)
    # blocks of the others meet one another (kind 0, pair i <= j) and the blocks of the main component (kind 1, pair i, j)
    pair = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda n: F.sequence(F.lit(0), (n - 1).cast("int"))
    others = F.concat(F.transform(upto(of_other), lambda j: pair(0, F.least("block", j), F.greatest("block", j))), F.transform(upto(of_main), lambda j: pair(1, F.col("block"), j)))
    cells = F.when(F.col("other"), others).otherwise(F.transform(upto(of_other), lambda i: pair(1, i, F.col("block"))))
    rows = rows.select("family", "id", "component", "other", F.explode(cells).alias("cell")).join(odd, "id").join(sets, "id")
    rows = rows.select("family", "cell.*", "id", "component", "other", "odd", "shingles")

    def check(pdf):
        import pandas as pd

        pdf = pdf.sort_values("id")
        ids, component, other = pdf["id"].to_numpy(), pdf["component"].to_numpy(), pdf["other"].to_numpy()
        bitmaps = np.stack(pdf["odd"].to_numpy()).view(np.uint64)
        sets = [np.asarray(s).view(np.uint64) for s in pdf["shingles"]]
        n, parent, out = np.array([len(s) for s in sets]), {c: c for c in component.tolist()}, []

        def root(c):
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for x in np.flatnonzero(other):
            differing = np.bitwise_count(bitmaps ^ bitmaps[x]).sum(axis=1)
            near = (differing <= _MOST[DOUBT]) & (component != component[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * int(SIMILARITY * 100))
            near[: x + 1] &= ~other[: x + 1]
            for y in sorted(np.flatnonzero(near).tolist(), key=differing.__getitem__):
                a, b = root(component[x].item()), root(component[y].item())
                if a != b:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both * 100 >= (n[x] + n[y] - both) * int(SIMILARITY * 100):
                        parent[a] = b
                        out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return saved(rows.groupBy("family", "kind", "i", "j").applyInPandas(check, "a bigint, b bigint"), "more")


def components(docs: DataFrame, shingle: int = 5, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    every, groups = links(docs, shingle, text)
    got = every.select("doc_id", "n_shingles", "set1", "set2").join(groups.select("set1", "set2", "component"), ["set1", "set2"], "left")
    got = got.withColumn("component_id", F.coalesce("component", "doc_id"))
    return got.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def representatives(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of docs, all columns, for each component: that with the smallest doc_id. Rows of one doc_id are one document, of which each
    text stays once; rows with a null doc_id stay, one for each text. Of rows that repeat a text, that whose other columns have the
    smallest hash stays."""
    kept = components(docs, shingle).where("kept").select(F.col("doc_id").alias("doc_id ")).distinct()
    rows = docs.join(kept, docs["doc_id"] == kept["doc_id "], "left_semi").union(docs.where(F.col("doc_id").isNull()))
    text = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    order = F.row_number().over(W.partitionBy("doc_id", *text).orderBy(F.xxhash64(*docs.columns)))
    return rows.withColumn("order ", order).where(F.col("order ") == 1).drop("order ")


ORACLE_SQL = """
with recursive doc as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+') as w from documents),
shingle as (select distinct doc_id, unnest(case when len(w) >= 2 then [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] else w end) as s from doc),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (
  select a.doc_id as x, b.doc_id as y from shingle a join shingle b using (s) join size p on p.doc_id = a.doc_id join size q on q.doc_id = b.doc_id
  where a.doc_id != b.doc_id and 100 * least(p.n, q.n) >= 80 * greatest(p.n, q.n)
  group by a.doc_id, b.doc_id, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach as (select x, y from link union select r.x, l.y from reach r join link l on l.x = r.y),
least as (select x, min(y) as m from reach group by x)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id))::bigint as component_id, d.doc_id = least(d.doc_id, coalesce(l.m, d.doc_id)) as kept
from doc d left join size s using (doc_id) left join least l on l.x = d.doc_id
"""
