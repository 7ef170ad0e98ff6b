"""Best-fit packing: bulk-synchronous best-fit of token pieces into sequences of CAPACITY tokens.

Lengths are whole numbers up to CAPACITY, so pieces and gaps, sorted by size, are run-length codes: a run of pieces is a length and an
interval of ranks among the pieces of that length, a run of gaps is a size and an interval of sequences. Spark tokenizes and ranks all
pieces; the runs are a table too, and every round of it is a Spark job:

* range-sort: runs are dealt out by ranges of sizes and sorted in each;
* successor sweeps: each range is swept by its own task. A gap takes the largest pieces that are no larger than it and that no smaller
  gap has taken, as many of one run as fit. What a range can't match is carried to a sweep over the ranges' leftovers;
* conflicts, where pieces of several runs want the same gaps, are resolved by rank: longer pieces and lower ranks first;
* gaps are updated, and the next round begins. Rounds go on until no piece of the current phase fits; then sequences are opened,
  as many as the pieces need at least. Phases go from long pieces to short ones (PHASES), so that short ones fill what is left.

Nothing moves but runs, of which there are at most CAPACITY of pieces, and of gaps as many as rounds have made, whatever the number of
documents. They are counted before they are broadcast to the pieces; more than BROADCAST_ROWS of them would be joined by length.

Nulls and edges: a null text is empty and becomes one piece of one token. Repeated rows are separate documents. A null doc_id stays
null. Very long texts are tokenized whole and cut. Extra columns are ignored; an empty table gives no rows. Any vocabulary file will do: the quick way of splitting plain words is
taken only where a probe shows that it gives the file's own ids.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from threading import Timer

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from platewise.llm.common import map_rows, saved

CAPACITY = 2048
#: A phase packs the pieces longer than this share of the capacity; RANGES: of sizes, for the sweeps.
PHASES = (1 / 2, 1 / 3, 1 / 4, 1 / 8, 0)
RANGES = 16
#: Runs up to which they are broadcast to the pieces; past it they are joined by length.
BROADCAST_ROWS = 1_000_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Chunks whose tokens need no normalizer but lower case: Latin letters up to U+012F, digits and signs; neither contractions nor special tokens.
PLAIN = re.compile("[!-~\u00a1-\u012f]+")
LETTER, NUMBER = "a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
PARTS = re.compile(f"[{LETTER}]+|[{NUMBER}]|[^{LETTER}{NUMBER}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Bytes as the vocabulary writes them: shown characters are themselves, the others follow from U+0100 on.
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Tokens:
    """Ids of chunks without ASCII white space, remembered in two generations of bounded size. Where the tokenizer drops white space
    and never merges across it, a text's ids are its chunks' ids in order, and plain chunks are split into their parts here and go to the
    vocabulary's model directly. A probe decides whether that holds for a file; otherwise whole texts go through the whole tokenizer."""

    LIMIT = 300_000
    #: Seconds without a task after which a worker forgets what it remembers: it may be of use to other stages.
    IDLE = 5.0
    PROBE = "Plain words,  and\n\tWORDS-of 123 (mixed) kinds: caf\u00e9 stra\u00dfe \u4f60\u597d \u0130 it's <|endoftext|> \U0001f600\u00a0x 9th"
    #: One for each vocabulary in a worker, kept from task to task, and the timer that ends it.
    KEPT: dict[str, Tokens] = {}
    TIMER: list[Timer] = []

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old, self.parts = Tokenizer.from_file(path), {}, {}, {}
        self.model = self.tokenizer.model
        self.by_chunks = True
        self.by_chunks = self.of(self.PROBE.encode()).tolist() == [*self._whole(self.PROBE), 0]

    @classmethod
    def at(cls, path: str) -> Tokens:
        while cls.TIMER:
            cls.TIMER.pop().cancel()
        if path not in cls.KEPT:
            cls.KEPT[path] = cls(path)
        return cls.KEPT[path]

    @classmethod
    def rest(cls) -> None:
        """At the end of a task."""
        cls.TIMER.append(Timer(cls.IDLE, cls.KEPT.clear))
        cls.TIMER[-1].daemon = True
        cls.TIMER[-1].start()

    def _part(self, part: str) -> bytes:
        if len(self.parts) >= self.LIMIT:
            self.parts.clear()
        shown = part if part.isascii() else "".join([BYTES[b] for b in part.encode()])
        ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
        return ids

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _chunk(self, chunk: bytes) -> bytes:
        if (ids := self.old.get(chunk)) is None:
            text = chunk.decode("utf-8")
            if PLAIN.fullmatch(text) and "'" not in text and "<|" not in text:
                ids = b"".join([self.parts.get(p) or self._part(p) for p in PARTS.findall(text.lower())])
            else:
                ids = np.array(self._whole(text), "<u4").tobytes()
        if len(self.young) >= self.LIMIT:
            self.young, self.old = {}, self.young
        self.young[chunk] = ids
        return ids

    def of(self, text: bytes) -> np.ndarray:
        """The ids of a text, then 0."""
        if not self.by_chunks:
            return np.array([*self._whole(text.decode("utf-8")), 0], "<u4")
        known = self.young.get
        return np.frombuffer(b"".join([known(c) or self._chunk(c) for c in text.split()] + [bytes(4)]), "<u4")


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece; task and rank: the piece's place among those of its length in its task."""

    def make():
        tokens, seen = Tokens.at(path or vocabulary()), Counter()

        def work(batch):
            if batch is None:
                return Tokens.rest()
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "rank")}
            for doc, words in zip(batch["doc_id"], batch["text "], strict=True):
                ids = tokens.of(words or b"")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for k, v in zip(out, (doc, piece, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]), strict=True):
                        out[k].append(v)
                    seen[len(part)] += 1
            return out

        return work

    rows = docs.select("doc_id", F.col(text).alias("text "))
    made = map_rows(rows, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, rank bigint", make, binary=("text ",), finish=True)
    return made.withColumn("task", F.spark_partition_id())


#: A run of pieces (kind 0): of a length (size), the n ranks from first on. Of gaps (1): of a size, the n sequences from first on; gaps made
#: in the round have kind 2. Placed (3): the pieces with the n ranks from first on, each to a sequence, in the sequences from sequence on, at offset.
RUN = "kind int, size int, first bigint, n bigint, each int, sequence bigint, offset int"


def sweep(runs, capacity: int) -> list[tuple]:
    """One successor sweep over sorted runs (kind, size, first, n) of pieces and gaps: what is placed, what is left, and the gaps made."""
    waiting, out = [], []
    for kind, size, first, n in sorted(runs, key=lambda r: (r[1], r[0], r[2])):
        if kind == 0:
            waiting.append((size, first, n))
            continue
        while n and waiting:
            length, rank, left = waiting.pop()
            each = min(size // length, left)
            full = min(n, left // each)
            out.append((3, length, rank, full * each, each, first, capacity - size))
            if size > each * length:
                out.append((2, size - each * length, first, full, 0, 0, 0))
            first, n, left = first + full, n - full, left - full * each
            if left:
                waiting.append((length, rank + full * each, left))
        if n:
            out.append((1, size, first, n, 0, 0, 0))
    return out + [(0, length, rank, n, 0, 0, 0) for length, rank, n in waiting]


def _swept(runs: DataFrame, key, capacity: int) -> DataFrame:
    """The runs after one sweep within each key; those of kinds 2 and 3 stay as they are."""

    def work(pdf):
        import pandas as pd

        rows = list(pdf[[f.split()[0] for f in RUN.split(", ")]].itertuples(index=False, name=None))
        done = [r for r in rows if r[0] > 1]
        return pd.DataFrame(done + sweep([r[:4] for r in rows if r[0] < 2], capacity), columns=[f.split()[0] for f in RUN.split(", ")])

    return runs.withColumn("key", key).groupBy("key").applyInPandas(work, RUN)


def place(classes: DataFrame, capacity: int = CAPACITY, ranges: int = RANGES) -> DataFrame:
    """The placed runs (RUN) for classes (size, n): how many pieces there are of each length."""
    spark, zero = classes.sparkSession, F.lit(0)
    row = (zero, F.col("size").cast("int"), zero.cast("bigint"), F.col("n").cast("bigint"), zero, zero.cast("bigint"), zero)
    longer = [int(capacity * share) for share in PHASES]

    def state(least):
        """Of the pieces longer than least that wait: how many there are, and how many sequences they need at least: by their tokens, and
        with k pieces to a sequence of those longer than a (k + 1)th of it."""
        waits = f"kind = 0 and size > {least}"
        needs = [f"sum(case when {waits} then size * n end) / {capacity}", *(f"sum(case when {waits} and size > {capacity // (k + 1)} then n end) / {k}" for k in range(1, 9))]
        return F.expr(f"struct(sum(case when {waits} then n end) as n, cast(ceil(greatest({', '.join(needs)})) as bigint) as need) as p{least}")

    def kept(runs, phase):
        """The runs as a table, and what they say of a phase, of the next one and of the placed pieces: observed while they are written."""
        seen = Observation()
        runs = saved(runs.coalesce(1).observe(seen, *[state(n) for n in {phase, max((n for n in longer if n < phase), default=0)}], F.expr("sum(case when kind = 3 then n end) as placed")), "runs")
        return runs, seen.get

    runs, now = kept(classes.select(*[c.alias(f.split()[0]) for c, f in zip(row, RUN.split(", "), strict=True)]), 0)
    of = lambda phase: now[f"p{phase}"] if f"p{phase}" in now else runs.agg(state(phase)).first()[0]  # noqa: E731  where a whole phase is passed over
    opened, before = 0, -1
    for least in longer:
        while (waits := of(least if opened else 0))["n"]:
            placed, need = now["placed"] or 0, waits["need"]
            if placed == before or not opened:
                runs, opened = runs.union(spark.createDataFrame([(1, capacity, opened, need, 0, 0, 0)], RUN)), opened + need
            before = placed
            idle = f"kind = 3 or kind = 0 and size <= {least}"
            swept = _swept(runs.where(f"not ({idle})"), F.expr(f"cast(floor(size * {ranges} / {capacity + 1}) as int)"), capacity)
            swept = _swept(swept, zero, capacity).withColumn("kind", F.expr("case when kind = 2 then 1 else kind end"))
            runs, now = kept(runs.where(idle).union(swept), least)
    return runs.where("kind = 3")


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every token of every document in a sequence of at most capacity tokens."""
    found = saved(pieces(docs, capacity, path), "pieces")
    # Pieces of a length: counted by task, then each task's first rank
    counts = found.groupBy("length", "task").agg(F.count("*").alias("n"))
    counts = saved(counts.withColumn("base", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "ranks")
    placed = place(counts.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), capacity)
    ranked = found.join(counts.select("length", "task", "base"), ["length", "task"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    # the runs of the piece's length, and of these that with its rank
    runs = placed.select(F.col("size").cast("bigint").alias("length"), "first", "n", "each", "sequence", F.col("offset").alias("at"))
    got = ranked.join(F.broadcast(runs) if runs.count() <= BROADCAST_ROWS else runs, "length").where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    k = F.col("rank") - F.col("first")
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("at") + k % F.col("each") * F.col("length")).alias("offset"))
