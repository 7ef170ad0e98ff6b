"""Spelling variants: words that differ by one code point, found with k-d trees over letter-count vectors.

One edit changes the letter counts by an L1 distance of two at most (one up and one down for a replaced letter, one up for an inserted one).
Words of each length are cells of a k-d tree, whose cuts come from a bounded sample and whose cells hold about CELL words. Each word is
sent to the cells of its own length and of the next one whose boxes it reaches; a cell is a task's work: its words form a k-d tree of small
leaves, what is sent there goes down it with the same pruning, and what is left is compared letter by letter. A pair is found in one
direction only, and both words learn of it.

Forms are chosen by aggregation over the pairs, and roots by pointer doubling: a form is at least twice as frequent as its word, so that
chains have at most log2 of the largest count links.

Nulls and edges: null and empty texts have no words, an empty table gives no rows. A null doc_id counts as an empty one in the key of a
deletion. Repeated rows count each. A word that no other is near has n_near 0 and itself as root. Texts are read in pieces that end
between runs, so that their length does not matter; a word may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import map_rows, parts, saved

#: Shortest word, fewest occurrences, and the divisor of the keys whose run loses a letter.
LEAST_LETTERS, LEAST_COUNT, DELETIONS = 5, 3, 97
#: Words of a cell, words of a leaf, words that the cuts are chosen from, cells of a length at most.
CELL, LEAF, SAMPLE, CELLS = 4096, 64, 1 << 16, 1 << 12
LETTERS = 90  # a to z, and U+00C0 to U+00FF
_RUN = re.compile("[a-zÀ-ÿ]+")
_PIECE = 1 << 20
_FAR = 255


def runs(text: str) -> Iterator[list[str]]:
    """The runs of letters of a text, in lists for each piece of it."""
    at = 0
    while at < len(text):
        end = at + _PIECE
        if (rest := _RUN.match(text, end)) and _RUN.match(text, end - 1):
            end = rest.end()
        yield _RUN.findall(text, at, end)
        at = end


def words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, n: the words of all texts that are long and frequent enough, with the seeded deletions."""

    def make():
        held: Counter[str] = Counter()

        def given():
            out = {"word": list(held), "n": list(held.values())}
            held.clear()
            return out

        def work(batch):
            if batch is None:
                return given()
            for key, body in zip(batch["doc_id"], batch["text"], strict=True):
                if not body:
                    continue
                seed = zlib.crc32(f"{'' if key is None else key}:".encode())
                for piece in runs(body.lower().decode("utf-8", "replace")):  # bytes: lower() knows A to Z only
                    for run, n in Counter(piece).items():
                        h = zlib.crc32(run.encode(), seed)
                        if h % DELETIONS == 0:
                            run = run[: h % len(run)] + run[h % len(run) + 1 :]
                        if len(run) >= LEAST_LETTERS:
                            held[run] += n
            return given() if len(held) > 1 << 17 else None

        return work

    counts = map_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "word string, n bigint", make, binary=("text",), finish=True)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(words: list[str]) -> np.ndarray:
    """Codes of words of one length, a row each: 0 to 25 for a to z, 26 to 89 for U+00C0 to U+00FF."""
    b = np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)
    return np.where(b < 128, b - 97, b - 166)


def counted(codes: np.ndarray) -> np.ndarray:
    """Letter counts (at most _FAR each, which brings vectors nearer and never further apart)."""
    n = np.bincount((np.arange(len(codes))[:, None] * LETTERS + codes).ravel(), minlength=len(codes) * LETTERS)
    return np.minimum(n, _FAR).astype(np.int16).reshape(-1, LETTERS)


_STEPS = [(i, t) for t in (1, 2, 3, 4) for i in range(LETTERS if t == 1 else 25 if t == 4 else 26)]  # 90 + 26 + 26 + 25 + padding: three words of 64 bits


def signatures(counts: np.ndarray) -> np.ndarray:
    """Counts in unary, three 64-bit words each: the bits that differ are at most the L1 distance."""
    bits = np.zeros((len(counts), 192), bool)
    for place, (i, t) in enumerate(_STEPS):
        bits[:, place] = counts[:, i] >= t
    return np.packbits(bits, axis=1).view(np.uint64)


@dataclass
class Tree:
    """A k-d tree over count vectors. Node k cuts letter dim[k]: counts up to cut[k] go to left[k]; a negative child is the leaf ~child.
    low and high are the bounds of the node's box in that letter."""

    dim: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    leaves: int = 1

    @staticmethod
    def of(counts: np.ndarray, leaf: float, most: int = 1 << 30) -> tuple[Tree, list[np.ndarray]]:
        """The tree, and the rows of each leaf: as many as leaf, or all alike, or what there is when most leaves are made."""
        tree, rows = Tree(leaves=0), []
        waiting = [(np.arange(len(counts)), np.zeros(LETTERS, np.int16), np.full(LETTERS, _FAR, np.int16), None)]
        open_leaves = 1
        for ids, low, high, slot in waiting:  # in breadth, so that most leaves are about as full
            choice = None
            if len(ids) > leaf and open_leaves < most:
                v = counts[ids]
                middle = np.sort(v, axis=0)[len(v) // 2]
                for t in (middle, middle - 1):
                    share = (v <= t).mean(axis=0)
                    d = int(np.argmin(np.abs(share - 0.5)))
                    if 0 < share[d] < 1 and (choice is None or abs(share[d] - 0.5) < choice[0]):
                        choice = abs(share[d] - 0.5), d, int(t[d])
            if choice is None:
                name = ~tree.leaves
                tree.leaves += 1
                rows.append(ids)
            else:
                _, d, t = choice
                name = len(tree.dim)
                open_leaves += 1
                for held, x in ((tree.dim, d), (tree.cut, t), (tree.left, 0), (tree.right, 0), (tree.low, int(low[d])), (tree.high, int(high[d]))):
                    held.append(x)
                under = counts[ids, d] <= t
                up, down = low.copy(), high.copy()
                up[d], down[d] = t + 1, t
                waiting += [(ids[under], low, down, (tree.left, name)), (ids[~under], up, high, (tree.right, name))]
            if slot is not None:
                slot[0][slot[1]] = name
        return tree, rows

    def reached(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows of counts whose distance to the leaf's box is at most up upwards and down downwards."""
        if not len(counts):
            return
        zero = np.zeros(len(counts), np.int16)
        waiting = [(0 if self.dim else -1, np.arange(len(counts)), zero, zero)]
        while waiting:
            node, ids, ups, downs = waiting.pop()
            if node < 0:
                yield ~node, ids
                continue
            q, t = counts[ids, self.dim[node]], self.cut[node]
            more = downs + np.maximum(q - t, 0) - np.maximum(q - self.high[node], 0)
            if (keep := more <= down).any():
                waiting.append((self.left[node], ids[keep], ups[keep], more[keep]))
            more = ups + np.maximum(t + 1 - q, 0) - np.maximum(self.low[node] - q, 0)
            if (keep := more <= up).any():
                waiting.append((self.right[node], ids[keep], more[keep], downs[keep]))


class Cell:
    """The words of a cell, all of one length, in a k-d tree."""

    def __init__(self, words: list[str]):
        self.words, self.codes = words, letters(words)
        counts = counted(self.codes)
        self.tree, self.rows = Tree.of(counts, LEAF)
        self.signatures = signatures(counts)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in words, place in the cell) of words that one edit parts. words are all as long as the cell's, or all one shorter."""
        codes = letters(words)
        size, shorter = codes.shape[1], codes.shape[1] < self.codes.shape[1]
        counts = counted(codes)
        mine = signatures(counts)
        # an edit leaves the first half or the last half as it is
        half = size // 2
        weights = np.random.default_rng(size).integers(1 << 63, size=size, dtype=np.uint64) | np.uint64(1)
        ends = lambda c: (c[:, :half] @ weights[:half], c[:, c.shape[1] - (size - half) :] @ weights[half:])
        (a1, a2), (b1, b2) = ends(codes.astype(np.uint64)), ends(self.codes.astype(np.uint64))
        most, step = (1, 0) if shorter else (1, 1), 1 << 12
        left, right = [], []
        for leaf, ids in self.tree.reached(counts, *most):
            rows = self.rows[leaf]
            for at in range(0, len(ids), step):
                some = ids[at : at + step]
                for k in range(0, len(rows), LEAF):  # a leaf of words that are all alike in letters may be larger
                    others = rows[k : k + LEAF]
                    apart = np.bitwise_count(mine[some, None, 0] ^ self.signatures[None, others, 0])
                    for w in (1, 2):
                        apart += np.bitwise_count(mine[some, None, w] ^ self.signatures[None, others, w])
                    i, j = np.nonzero(apart <= sum(most))
                    i, j = some[i], others[j]
                    keep = (a1[i] == b1[j]) | (a2[i] == b2[j])
                    left.append(i[keep])
                    right.append(j[keep])
        i, j = np.concatenate(left or [np.empty(0, int)]), np.concatenate(right or [np.empty(0, int)])
        good = np.zeros(len(i), bool)
        chunk = max(1, (1 << 22) // size)
        for at in range(0, len(i), chunk):
            a, b = codes[i[at : at + chunk]], self.codes[j[at : at + chunk]]
            if shorter:
                before, after = a != b[:, :-1], a != b[:, 1:]
                first = np.where(before.any(axis=1), before.argmax(axis=1), size)
                last = np.where(after.any(axis=1), size - 1 - after[:, ::-1].argmax(axis=1), -1)
                good[at : at + chunk] = last < first
            else:
                good[at : at + chunk] = (a != b).sum(axis=1) == 1
        return i[good], j[good]


def cuts(vocabulary: DataFrame) -> dict[int, Tree]:
    """A tree of cells for each length with more than CELL words. The sample (at most about SAMPLE words, by hash) chooses the cuts only."""
    sizes = {r["length"]: r["n"] for r in vocabulary.groupBy("length").agg(F.count("*").alias("n")).where(F.col("n") > CELL).toLocalIterator()}
    if not sizes:
        return {}
    every = max(1, -(-sum(sizes.values()) // SAMPLE))
    sample = vocabulary.where(F.col("length").isin(*sizes) & (F.pmod(F.xxhash64("word"), F.lit(every)) == 0)).select("word", "length").toArrow()
    lengths, words, out = np.asarray(sample["length"]), np.array(sample["word"].to_pylist(), object), {}
    for length, n in sizes.items():
        if (chosen := words[lengths == length]).size:
            out[length] = Tree.of(counted(letters(chosen.tolist())), CELL * len(chosen) / n, CELLS)[0]
    return out


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    lengths = np.array([len(w) for w in words])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


SENT = "length int, leaf int, block int, role int, word string, n bigint"


def _leaves(trees: dict[int, Tree], length: int, counts: np.ndarray) -> np.ndarray:
    leaf = np.zeros(len(counts), np.int64)
    if length in trees:
        for k, ids in trees[length].reached(counts, 0, 0):
            leaf[ids] = k
    return leaf


def sent(vocabulary: DataFrame, trees: dict[int, Tree], blocks: dict[tuple[int, int], int]) -> DataFrame:
    """Each word to its own cell (role 0), and to the later cells of its length (role 1) and the cells of the next length (role 2) that it
    reaches. Cells with blocks are split by the words' CRC."""

    def make():
        def work(batch):
            out: dict[str, list] = {k: [] for k in ("length", "leaf", "block", "role", "word", "n")}

            def put(length, leaf, block, role, at):
                for name, x in (("length", length), ("leaf", leaf), ("block", block), ("role", role), ("word", words[at]), ("n", n[at])):
                    out[name].append(x)

            words, n = batch["word"], batch["n"]
            for length, ids in _by_length(words).items():
                counts = counted(letters([words[i] for i in ids]))
                own = _leaves(trees, length, counts)
                mine = [zlib.crc32(words[i].encode()) % blocks.get((length, int(k)), 1) for i, k in zip(ids, own, strict=True)]
                for i, k, b in zip(ids, own.tolist(), mine, strict=True):
                    put(length, k, b, 0, i)
                for target, role, down in ((length, 1, 1), (length + 1, 2, 0)):
                    reached = trees[target].reached(counts, 1, down) if target in trees else [(0, np.arange(len(ids)))]
                    for k, some in reached:
                        for b in range(blocks.get((target, k), 1)):
                            for s in some.tolist():
                                if role == 2 or (k, b) > (own[s], mine[s]):
                                    put(target, k, b, role, ids[s])
            return out

        return work

    return map_rows(vocabulary.select("word", "n"), SENT, make)


def _full(vocabulary: DataFrame, trees: dict[int, Tree]) -> dict[tuple[int, int], int]:
    """Cells with more than four times CELL words, and into how many blocks each is split."""
    def make():
        def work(batch):
            held = Counter()
            for length, ids in _by_length(batch["word"]).items():
                held.update((length, k) for k in _leaves(trees, length, counted(letters([batch["word"][i] for i in ids]))).tolist())
            return {"length": [k[0] for k in held], "leaf": [k[1] for k in held], "n": list(held.values())}

        return work

    sizes = map_rows(vocabulary.select("word"), "length int, leaf int, n bigint", make).groupBy("length", "leaf").agg(F.sum("n").alias("n"))
    return {(r["length"], r["leaf"]): -(-r["n"] // CELL) for r in sizes.where(F.col("n") > 4 * CELL).toLocalIterator()}


def _pairs_of(batches: Iterator[pa.RecordBatch], emit: Callable[[list], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells come one after another, their own words first."""
    at, own, counts, cell, asked = None, [], [], None, {1: [], 2: []}

    def answers(role):
        nonlocal cell
        cell = cell or Cell(own)
        some, asked[role] = asked[role], []
        i, j = cell.near([w for w, _ in some])
        return [(some[x][0], some[x][1], own[y], counts[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]

    def closed():
        if own:
            for role in (1, 2):
                if asked[role]:
                    yield emit(answers(role))
            for k in range(0, len(own) if len(own) > 1 else 0, 1 << 12):
                mine = cell_of().near(own[k : k + (1 << 12)])
                yield emit([(own[x + k], counts[x + k], own[y], counts[y]) for x, y in zip(mine[0].tolist(), mine[1].tolist(), strict=True) if x + k < y])

    def cell_of():
        nonlocal cell
        cell = cell or Cell(own)
        return cell

    for batch in batches:
        for part in parts(batch):
            for length, leaf, block, role, word, n in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                if (length, leaf, block) != at:
                    yield from closed()
                    at, own, counts, cell, asked = (length, leaf, block), [], [], None, {1: [], 2: []}
                if role == 0:
                    own.append(word)
                    counts.append(n)
                elif own:
                    asked[role].append((word, n))
                    if len(asked[role]) >= 1 << 12:
                        yield emit(answers(role))
    yield from closed()


def near(vocabulary: DataFrame) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n) that one edit parts, in both directions."""
    rows = vocabulary.select("word", "n", F.length("word").alias("length"))
    trees = cuts(rows)
    parts_ = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = ["length", "leaf", "block"]
    dealt = sent(rows, trees, _full(rows, trees)).repartition(parts_, *cells).sortWithinPartitions(*cells, "role", "word")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["word", "n", "near", "near_n"]

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True) if found else [[]] * 4, kinds, strict=True)], names)

    pairs = dealt.mapInArrow(lambda batches: _pairs_of(batches, emit), "word string, n bigint, near string, near_n bigint")
    # written once: each pair is read in both directions
    pairs = saved(pairs, "pairs")
    return pairs.union(pairs.select("near", "near_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): pointers are doubled until none moves."""
    at = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = saved(at.join(then, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """word, form, root, n, n_near, form_n of all words."""
    vocabulary = saved(words(docs, text, doc_id), "vocabulary")
    best = near(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), F.col("near").alias("form"))).alias("best"))
    good = -F.col("best.k") >= 2 * F.col("n")
    chosen = saved(best.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.k")).alias("form_n")), "forms")
    ended = roots(chosen.where("form is not null"))
    rows = vocabulary.join(chosen, "word", "left").join(ended, "word", "left")
    return rows.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "form_n")


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
with recursive bits as (select i, i as c, 0 as k from range(256) t(i) union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8),
crc as materialized (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
counted as (select doc_id, run, count(*) as n from runs group by all),
coded as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as b from counted),
hashed as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) as h from coded, crc),
said as (select case when h % 97 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed),
v as materialized (select word, sum(n)::bigint as n from said where length(word) >= 5 group by word having sum(n) >= 3),
p as (select word, n, unnest(range(1, length(word) + 1))::int as i from v),
shorter as materialized (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from p),
near as materialized (select a.word, b.word as other, b.n from shorter a join shorter b on a.i = b.i and a.rest = b.rest and a.word <> b.word
  union select a.word, b.word, b.n from shorter a join v b on a.rest = b.word
  union select b.word, a.word, a.n from shorter a join v b on a.rest = b.word),
best as (select word, other, n, count(*) over (partition by word) as n_near from near qualify row_number() over (partition by word order by n desc, other) = 1),
f as materialized (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best.n >= 2 * v.n then other end as form, case when best.n >= 2 * v.n then best.n end as form_n from v left join best using (word)),
chain as (select word, word as root from f where form is null union all select f.word, chain.root from chain join f on f.form = chain.word)
select f.word, form, root, f.n, n_near::bigint as n_near, form_n from f join chain using (word)
"""
