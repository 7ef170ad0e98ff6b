"""Substring dedup: documents are parsed greedily into factors of an index of reference blocks.

Words are runs of other characters than ASCII white space, unchanged. The index has every WINDOW consecutive words by hash, with the place
where they stand first: the smallest doc_id, and in it the smallest start. A document is parsed from left to right: a factor begins at a
word whose window stands earlier, and goes on as long as the document and the reference advance together; where it ends, the windows over
the boundary are looked up like all others, and may begin the next factor. A factor has WINDOW words at least. Then the factors are held
against the words of the reference themselves, which are fetched as blocks of BLOCK words, and only words that are equal for WINDOW words
on end are removed: a hash never decides alone. What goes is the words of all windows that occur earlier.

Only windows that can occur twice are shuffled. The smallest hash among a window's ANCHOR-word shingles is its anchor: equal windows have
equal anchors. Anchors are counted over the corpus first (about one for eight words), and a window whose anchor is in one document alone is
looked up in that document. Texts that are whole copies of an earlier document's (by 128 bits) are found first and need no parse.

Nulls and edges: a null or empty text has no words. A document shorter than WINDOW words keeps all of them. A null doc_id comes after
all others. Rows with the same doc_id are one document and should have one text; repeated rows give equal results and do not remove
each other. Rows with a null doc_id are one document for each text, in the order of the texts' hashes. Extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import Bloom, as_long, bloom, map_rows, mix, rolled, saved, word_hashes

WINDOW = 20
ANCHOR = 6
BLOCK = 64
LAST, NONE = 2**63 - 1, -(2**63)


def anchors_of(h: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of every window: the minimum over the shingles in it."""
    a, width, need = rolled(h, anchor), 1, window - anchor + 1
    while width < need:
        step = min(width, need - width)
        a, width = np.minimum(a[: len(a) - step], a[step:]), width + step
    return a


def _keys(text: str) -> tuple[Column, Column, Column, Column]:
    """A document's key, doc (doc_id, nulls last) and own (tells null doc_ids apart by their text), and the two halves of the text's hash."""
    x = F.coalesce(F.col(text), F.lit(""))
    h1, h2 = F.xxhash64(x), F.xxhash64(F.lit(1), x)
    return F.coalesce("doc_id", F.lit(LAST)), F.when(F.col("doc_id").isNull(), h1).otherwise(F.lit(NONE)), h1, h2


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """text, doc, own, h1, h2."""
    doc, own, h1, h2 = _keys(text)
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), doc.alias("doc"), own.alias("own"), h1.alias("h1"), h2.alias("h2"))


#: A factor: its first word, its words, and where they stand first (a document's key, see _keys, and the first word there).
FACTOR = "array<struct<start:int,length:int,doc:bigint,own:bigint,at:int>>"


def factors(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, Bloom]:
    """doc, own, factors (FACTOR) of each parsed document that has any, and the filter of first copies of texts: a document outside it
    is a whole copy and is not parsed."""
    spark = docs.sparkSession
    keyed = _keyed(docs, text)
    copy = F.xxhash64("h1", "h2", "doc").alias("copy")
    firsts = bloom(saved(keyed.groupBy("h1", "h2").agg(F.min("doc").alias("doc")).select(copy), "first-copies"), "copy")
    first_copies = spark.sparkContext.broadcast(firsts)
    rows = keyed.select("text", "doc", "own", copy)

    def parsed(batch):
        keep = first_copies.value.has(np.array(batch["copy"], np.int64).view(np.uint64))
        for words, doc, own, first in zip(batch["text"], batch["doc"], batch["own"], keep, strict=True):
            if first and len(h := word_hashes(words)) >= window:
                yield doc, own, h

    def make_anchors():
        def work(batch):
            found = [np.unique(anchors_of(h, window, anchor)) for _, _, h in parsed(batch)]
            return {"anchor": as_long(np.concatenate(found))} if found else None

        return work

    counted = map_rows(rows, "anchor bigint", make_anchors, binary=("text",)).groupBy("anchor").count().where("count > 1").select("anchor")
    shared = spark.sparkContext.broadcast(bloom(saved(counted, "shared-anchors"), "anchor"))

    def make_blocks():
        def work(batch):
            out = [], [], [], [], []
            for doc, own, h in parsed(batch):
                blocks = rolled(h, window)
                order = np.argsort(blocks, kind="stable")
                same = np.r_[False, blocks[order[1:]] == blocks[order[:-1]]]
                # where a window that the document has again stands first in it, else -1
                first = np.full(len(blocks), -1, np.int32)
                first[order] = np.where(same, order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))], -1)
                again = first >= 0
                at = np.flatnonzero(shared.value.has(anchors_of(h, window, anchor)) | again)
                if len(at):
                    # what a document has again needs no reference: any key does, and one of its own spreads a line repeated very often
                    out[0].append(np.where(again[at], mix(blocks[at] + mix(at.astype(np.uint64))), blocks[at]))
                    out[1].append(np.full(len(at), doc, np.int64))
                    out[2].append(np.full(len(at), own, np.int64))
                    out[3].append(at.astype(np.int32))
                    out[4].append(first[at])
            if out[0]:
                block, doc, own, at, first = map(np.concatenate, out)
                return {"block": as_long(block), "doc": doc, "own": own, "at": at, "first": first}

        return work

    # written once: the index is made from them, and they are looked up in it
    blocks = saved(map_rows(rows, "block bigint, doc bigint, own bigint, at int, first int", make_blocks, binary=("text",)), "windows", "lz4")
    # counted where they are first; blocks that a document has again are duplicates already and weigh nothing here
    index = blocks.where("first < 0").groupBy("block").agg(F.min("doc").alias("r_doc"), F.min("own").alias("r_own"), F.min_by("at", "doc").alias("by_doc"), F.min_by("at", "own").alias("by_own"))
    # own counts only where all documents of a block have a null doc_id; it is NONE in the others and in their minimum
    index = index.select("block", "r_doc", "r_own", F.when(F.col("r_doc") == LAST, F.col("by_own")).otherwise(F.col("by_doc")).alias("r_at"))
    again, later = F.col("first") >= 0, (F.col("doc") > F.col("r_doc")) | ((F.col("doc") == F.col("r_doc")) & (F.col("own") > F.col("r_own")))
    earlier = blocks.join(index, "block", "left").where(again | later)
    reference = [F.when(again, F.col(mine)).otherwise(F.col(other)).alias(mine if mine != "first" else "r_at") for mine, other in (("doc", "r_doc"), ("own", "r_own"), ("first", "r_at"))]
    # a set: repeated rows, of which there may be any number, have the same windows
    of_document = earlier.select(F.col("doc").alias("d"), F.col("own").alias("o"), F.struct("at", *reference).alias("w")).groupBy("d", "o").agg(F.collect_set("w").alias("w"))
    flat = of_document.select("d", "o", *[F.col(f"w.{c}").alias(c) for c in ("at", "doc", "own", "r_at")])

    def make_factors():
        def work(batch):
            found = [greedy(*(np.array(batch[c][i], np.int64) for c in ("at", "doc", "own", "r_at")), window) for i in range(len(batch["d"]))]
            return {"doc": batch["d"], "own": batch["o"], "factors": found}

        return work

    return saved(map_rows(flat, f"doc bigint, own bigint, factors {FACTOR}", make_factors), "factors"), firsts


def greedy(at: np.ndarray, doc: np.ndarray, own: np.ndarray, r_at: np.ndarray, window: int) -> list[dict]:
    """The factors of a document whose windows at stand earlier at r_at in (doc, own)."""
    order = np.argsort(at)
    at, doc, own, r_at = at[order], doc[order], own[order], r_at[order]
    ends = (at[1:] != at[:-1] + 1) | (r_at[1:] != r_at[:-1] + 1) | (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(np.r_[True, ends])
    length = at[np.r_[begin[1:], len(at)] - 1] - at[begin] + window
    return [dict(zip(("start", "length", "doc", "own", "at"), f, strict=True)) for f in zip(*(x.tolist() for x in (at[begin], length, doc[begin], own[begin], r_at[begin])), strict=True)]


def equal_stretches(mine: list[bytes], theirs: list[bytes], window: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches of at least window words that are equal."""
    if mine == theirs:
        return [(0, len(mine))]
    same = np.array([False, *(a == b for a, b in zip(mine, theirs, strict=False)), False])  # noqa: B905
    edges = np.flatnonzero(same[1:] != same[:-1])
    return [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= window]


def _block_keys(document: np.ndarray, block: np.ndarray) -> np.ndarray:
    return mix(document + (block.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def with_reference(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """doc, own, and references: for each factor its words in blocks (start, length, at, block; words is null where the reference is the
    document itself)."""
    one = found.select("doc", "own", F.explode("factors").alias("f")).select("doc", "own", "f.start", "f.length", F.col("f.doc").alias("r_doc"), F.col("f.own").alias("r_own"), "f.at")
    inner = (F.col("doc") == F.col("r_doc")) & (F.col("own") == F.col("r_own"))
    last = F.floor((F.col("at") + F.col("length") - 1) / BLOCK).cast("int")
    needs = one.withColumn("block", F.explode(F.when(inner, F.array(F.lit(-1))).otherwise(F.sequence(F.floor(F.col("at") / BLOCK).cast("int"), last))))
    needs = saved(needs, "needs")
    wanted = saved(needs.where("block >= 0").select("r_doc", "r_own", "block").distinct(), "wanted")
    document = F.xxhash64("r_doc", "r_own").alias("key")

    def make_keys():
        def work(batch):
            key = np.array(batch["key"], np.int64).view(np.uint64)
            return {"key": as_long(np.unique(np.r_[key, _block_keys(key, np.array(batch["block"], np.int64))]))}

        return work

    # the documents and their blocks in one filter
    keys = saved(map_rows(wanted.select(document, "block"), "key bigint", make_keys), "keys")
    shared = docs.sparkSession.sparkContext.broadcast(bloom(keys, "key"))

    def make():
        def work(batch):
            out = [], [], [], []
            key = np.array(batch["key"], np.int64).view(np.uint64)
            for i in np.flatnonzero(shared.value.has(key)).tolist():
                words = batch["text"][i].split()
                k = np.arange(-(-len(words) // BLOCK))
                for k in k[shared.value.has(_block_keys(key[i], k))].tolist():
                    for x, value in zip(out, (batch["r_doc"][i], batch["r_own"][i], k, b" ".join(words[k * BLOCK : (k + 1) * BLOCK])), strict=True):
                        x.append(value)
            return dict(zip(("r_doc", "r_own", "block", "words"), out, strict=True))

        return work

    rows = _keyed(docs, text).select("text", F.col("doc").alias("r_doc"), F.col("own").alias("r_own")).withColumn("key", document)
    cut = map_rows(rows, "r_doc bigint, r_own bigint, block int, words binary", make, binary=("text",))
    blocks = saved(cut.join(wanted, ["r_doc", "r_own", "block"], "left_semi").groupBy("r_doc", "r_own", "block").agg(F.first("words").alias("words")), "blocks")
    got = needs.join(blocks, ["r_doc", "r_own", "block"], "left")
    return got.groupBy("doc", "own").agg(F.collect_list(F.struct("start", "length", "at", "block", "words")).alias("references"))


def digest(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs."""
    return _applied(docs, text, window, anchor, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string", [], lambda words, kept: {"n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()})


def deduplicated(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The rows of docs with their duplicate spans cut out of text (words joined by one space where anything was removed; n_chars, where
    there is such a column, follows the text). A row of which no word is left goes."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    schema = "doc_id bigint, text string, changed boolean" + "".join(f", `{c}` {t}" for c, t in docs.select(*rest).dtypes)
    got = _applied(docs, "text", window, anchor, schema, rest, lambda words, kept: {"text": b" ".join(kept).decode("utf-8") if len(kept) < len(words) else None, "changed": len(kept) < len(words)}, whole="text")
    got = got.where(~F.col("changed") | (F.col("text") != "")).select(*docs.columns)
    return got.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else got


def covered(words: list[bytes], references: list[dict], window: int) -> np.ndarray:
    """Which words are in a factor that has been held against the words of its reference."""
    inside, of = np.zeros(len(words) + 1, np.int32), {}
    for r in references:
        of.setdefault((r["start"], r["length"], r["at"]), {})[r["block"]] = r["words"]
    for (start, length, at), blocks in of.items():
        if -1 in blocks:
            theirs = words[at : at + length]
        else:
            lines = [blocks[k] for k in sorted(blocks)]
            theirs = [] if None in lines else b" ".join(lines).split()[at % BLOCK :][:length]
        for a, b in equal_stretches(words[start : start + length], theirs, window):
            inside[start + a] += 1
            inside[start + b] -= 1
    return np.cumsum(inside[:-1]) > 0


def _applied(docs, text, window, anchor, schema, keep, result, whole=None):
    found, firsts = factors(docs, text, window, anchor)
    found = with_reference(docs, found, text)
    first_copies = docs.sparkSession.sparkContext.broadcast(firsts)
    doc, own, h1, h2 = _keys(text)
    rows = docs.select("doc_id", F.col(text).alias("text "), doc.alias("doc "), own.alias("own "), F.xxhash64(h1, h2, doc).alias("copy "), *keep)
    found = found.select(F.col("doc").alias("doc "), F.col("own").alias("own "), F.col("references").alias("references "))
    joined = rows.join(found, ["doc ", "own "], "left").select("doc_id", "text ", "copy ", "references ", *keep)

    def make():
        def work(batch):
            first = first_copies.value.has(np.array(batch["copy "], np.int64).view(np.uint64))
            out = []
            for raw, references, is_first in zip(batch["text "], batch["references "], first, strict=True):
                words = (raw or b"").split()
                kept = words
                if len(words) >= window and not is_first:
                    kept = []
                elif references:
                    kept = [words[i] for i in np.flatnonzero(~covered(words, references, window))]
                row = result(words, kept)
                if whole and row[whole] is None:
                    row[whole] = None if raw is None else raw.decode("utf-8")
                out.append(row)
            return {"doc_id": batch["doc_id"]} | {k: [r[k] for r in out] for k in out[0]} | {k: batch[k] for k in keep}

        return work

    return map_rows(joined, schema, make, binary=("text ",))


ORACLE_SQL = """
with doc as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') as w from documents),
win as (
  select doc_id, p, md5(array_to_string(w[p : p + 19], ' ')) as h
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as p from doc where len(w) >= 20)
), again as (select doc_id, p from (select doc_id, p, row_number() over (partition by h order by doc_id, p) as k from win) where k > 1),
hit as (select distinct doc_id, unnest(range(p, p + 20)) as i from again),
word as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from doc),
kept as (select doc_id, string_agg(x, ' ' order by i) as t, count(*) as n from word anti join hit using (doc_id, i) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.t, '')) as kept_sha256
from doc d left join kept k using (doc_id)
"""
