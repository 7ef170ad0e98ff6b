"""Quality classifier: random-indexing word vectors, pooled per document, then a two-layer network with calibrated probabilities.

Word vectors come from every document: each hashed word has a sparse random index vector, and a word's vector is the sum of its
neighbours' index vectors. Tasks sum into a matrix of BUCKETS x DIMENSIONS whole numbers, Spark adds the matrices up. The same is done
for word shapes (runs of upper case, lower case, digits and signs). A document is the mean and spread of its words' and shapes' vectors,
and the share of distinct words and lines. The network learns from at most LABELLED labelled rows, those with the smallest hash of
doc_id; a fifth of them is set apart to fit the temperature.

Nulls and edges: a null or empty text has the zero vector and is scored like any other. Rows without a quality are not learned from, nor
is a row with a null doc_id. Of several labels of one document the smallest counts. Without labels of both kinds every score is the share
of label 1 (0.5 without any). Repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import _VALUE, map_rows, saved, segment_hashes, word_starts

BUCKETS, DIMENSIONS, NONZERO, REACH = 1 << 13, 32, 2, 2
SHAPES = 1 << 8
LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE = 32, 30, 256, 0.003
THRESHOLD = 0.3
#: Classes of bytes: upper case, lower case and all beyond ASCII, digits; the rest stay apart.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1], _CLASS[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")


def places(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a text's words, and of their shapes: a shape is the word's classes without repeats, so `WORD!!` is A!"""
    b, starts = word_starts(text or b"")
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    b, starts = b[starts[0] :], starts - starts[0]
    lengths = np.diff(starts, append=len(b))
    words = segment_hashes(_VALUE[b], np.arange(len(b)) - np.repeat(starts, lengths), starts)
    kind = _CLASS[b]
    new = np.r_[True, kind[1:] != kind[:-1]]
    new[starts] = True
    rank = np.cumsum(new)
    shapes = segment_hashes(np.where(new, _VALUE[kind], np.uint64(0)), rank - np.repeat(rank[starts], lengths), starts)
    return (words % np.uint64(BUCKETS)).astype(np.int64), (shapes % np.uint64(SHAPES)).astype(np.int64) + BUCKETS


_INDEX = np.random.default_rng(4409)
#: Of each row: the places of its index vector that are not zero, and their signs.
_AT = _INDEX.integers(0, DIMENSIONS, (BUCKETS + SHAPES, NONZERO))
_SIGN = _INDEX.choice([-1.0, 1.0], (BUCKETS + SHAPES, NONZERO))


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit vectors of all buckets and shapes, from all rows of docs."""

    def make():
        total = np.zeros((BUCKETS + SHAPES) * DIMENSIONS)

        def work(batch):
            nonlocal total
            if batch is None:
                matrix = total.reshape(-1, DIMENSIONS)
                used = np.flatnonzero(np.abs(matrix).sum(axis=1))
                return {"place": used, "vector": list(matrix[used].astype(np.int64))} if len(used) else None
            flat, signs = [], []
            for rows in (r for t in batch["text "] for r in places(t)):
                for reach in range(1, REACH + 1):
                    for word, neighbour in ((rows[:-reach], rows[reach:]), (rows[reach:], rows[:-reach])):
                        flat.append((word[:, None] * DIMENSIONS + _AT[neighbour]).ravel())
                        signs.append(_SIGN[neighbour].ravel())
            if flat:
                total += np.bincount(np.concatenate(flat), np.concatenate(signs), len(total))
            return None

        return work

    sums = map_rows(docs.select(F.col(text).alias("text ")), "place bigint, vector array<bigint>", make, binary=("text ",), finish=True)
    sums = sums.groupBy("place").agg(F.array(*[F.sum(F.get("vector", F.lit(i))) for i in range(DIMENSIONS)]).alias("vector")).toArrow()
    vectors = np.zeros((BUCKETS + SHAPES, DIMENSIONS), np.float32)
    for place, vector in zip(sums.column("place").to_pylist(), sums.column("vector").to_pylist(), strict=True):
        vectors[place] = vector
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def pool(text: bytes | None, vectors: np.ndarray) -> np.ndarray:
    out = []
    words, shapes = places(text)
    for rows in (words, shapes):
        if len(rows):
            found, n = np.unique(rows, return_counts=True)
            v, w = vectors[found], (n / len(rows))[:, None]
            mean = (v * w).sum(axis=0)
            out += [mean, np.sqrt(np.maximum((v * v * w).sum(axis=0) - mean * mean, 0))]
        else:
            out += [np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)]
    lines = (text or b"").split(b"\n")
    n = max(1, len(words))
    return np.concatenate([*out, [len(np.unique(words)) / n, len(set(lines)) / len(lines), np.log1p(len(words)) / 10]])


class Network:
    """Inputs -> HIDDEN tanh -> one logit, divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.one_sided = len(y) < 10 or y.min() == y.max()
        if self.one_sided:
            return
        self.centre, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        apart = rng.random(len(y)) < 0.2
        z, zy, vz, vy = self._scaled(x[~apart]), y[~apart], self._scaled(x[apart]), y[apart]
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(max(EPOCHS, 4000 * BATCH // max(1, len(zy) * 4))):
            order = rng.permutation(len(zy))
            for at in range(0, len(order), BATCH):
                i = order[at : at + BATCH]
                h = np.tanh(z[i] @ p[0] + p[1])
                e = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - zy[i]) / len(i)
                d = np.outer(e, p[2]) * (1 - h * h)
                grads = [z[i].T @ d + 1e-4 * p[0], d.sum(axis=0), h.T @ e + 1e-4 * p[2], e.sum(keepdims=True)]
                step += 1
                for a, g, mm, vv in zip(p, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= RATE * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(vy):
            logit = self._logit(vz)
            self.temperature = min(np.geomspace(0.25, 8, 61), key=lambda t: np.logaddexp(0, np.where(vy == 1, -logit, logit) / t).mean())

    def _scaled(self, x):
        return np.clip((x - self.centre) / self.spread, -8, 8)

    def _logit(self, z):
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.one_sided:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self._logit(self._scaled(x)) / self.temperature, -30, 30)))


def held_out():
    """Whether crc32(doc_id as text) mod 5 is 0. A null doc_id is held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, labelled: int = LABELLED) -> Network:
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = saved(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled), "labelled")  # at most labelled rows: small enough to broadcast
    rows = docs.select("doc_id", F.col("text").alias("text ")).join(F.broadcast(sample), "doc_id")

    def make():
        def work(batch):
            return {"doc_id": batch["doc_id"], "quality": batch["quality"], "x": [pool(t, shared.value).astype(np.float32) for t in batch["text "]]}

        return work

    got = map_rows(rows, "doc_id bigint, quality int, x array<float>", make, binary=("text ",)).toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float) if len(got) else np.empty((0, 1))
    return Network(x, np.array(got.column("quality").to_pylist(), float))


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs."""
    vectors = word_vectors(docs)
    network = train(docs, labels, vectors, labelled)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network.__dict__))

    def make():
        vectors, state = shared.value
        network = Network.__new__(Network)
        network.__dict__ = state

        def work(batch):
            score = network.score(np.stack([pool(t, vectors) for t in batch["text "]]))
            return {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": score, "predicted": (score >= THRESHOLD).astype(np.int32)}

        return work

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("text "))
    return map_rows(rows, "doc_id bigint, held_out boolean, score double, predicted int", make, binary=("text ",))
