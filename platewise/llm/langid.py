"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of every learnable document in numpy inside tasks and sums the counts in Spark. The matrix of
log-probabilities (2^BITS buckets x languages) is broadcast in blocks of at most BLOCK languages. A batch of documents is scored as a
sparse matrix, one entry (document, bucket) for each n-gram, times a block: nothing is computed document by document. With more languages than a block has,
one pass over the documents is made for each block, and the passes' best languages and sums of probabilities are merged.

Nulls and edges: a null text, or one without a letter, is `und` with score 0. Rows with null lang or null text are not learned
from. Repeated rows each count and each get a row. A table without a learnable row predicts `und` everywhere; the filter then keeps
every document with a letter, as nothing can be said against it. Of equally likely languages the first by name is taken. Extra columns are
ignored (the filter keeps them); texts of any length are counted whole, in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import map_rows, parts, saved, small_batches

ORDERS = (1, 2, 3)
BITS = 15
#: Languages in a broadcast matrix (2^BITS x BLOCK float32: 32 MB at most), and languages counted at a time in a task.
BLOCK = 256
ALPHA = 0.5
PIECE = 1 << 18


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Characters of the lower-cased texts, and the number of the text each is of, in pieces of about PIECE characters. The last
    characters of a piece stand again in the next, so that every n-gram is whole in one."""
    held, size = [], 0

    def joined():
        numbers, codes = zip(*held, strict=True)
        return np.concatenate(codes), np.repeat(np.array(numbers), [len(c) for c in codes])

    for i, text in enumerate(texts):
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32)
        for at in range(0, len(codes), PIECE):
            held.append((i, codes[at : at + PIECE]))
            size += len(held[-1][1])
            if size >= PIECE:
                yield joined()
                held, size = ([(i, codes[at + PIECE - max(ORDERS) + 1 : at + PIECE])], 0) if at + PIECE < len(codes) else ([], 0)
    if held:
        yield joined()


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The number of the text and the bucket of every n-gram of the texts."""
    last = None  # of a text that goes on in the next piece, the characters that both pieces have
    for codes, number in pieces(texts):
        again = max(ORDERS) - 1 if last is not None and number[0] == last[0] and last[1] else 0
        for n in ORDERS:
            m = len(codes) - n + 1
            if m > 0:
                h = np.full(m, n, np.uint32)
                for i in range(n):
                    h = (h ^ codes[i : i + m]) * np.uint32(0x9E3779B1)
                    h ^= h >> np.uint32(15)
                inside = number[:m] == number[n - 1 :]
                inside[: max(0, again - n + 1)] = False  # counted in the piece before
                yield number[:m][inside], (h >> np.uint32(32 - BITS)).astype(np.int64)[inside]
        last = number[-1], len(codes) >= PIECE


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """At most BLOCK languages."""

    languages: list[str]
    #: float32, languages x buckets
    log_probability: np.ndarray
    log_prior: np.ndarray

    def totals(self, texts: list[str]) -> np.ndarray:
        """log prior + sum of count * log probability, texts x languages."""
        out = np.tile(self.log_prior, (len(texts), 1))
        for text, bucket in grams(texts):
            for k in range(len(self.languages)):
                out[:, k] += np.bincount(text, self.log_probability[k][bucket], len(texts))
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[LanguageModel]:
    """Learns from all rows of docs that have both columns: the languages by name, in models of at most BLOCK."""
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def make():
        counts: dict[str, np.ndarray] = {}

        def given():
            held = [(k, c.nonzero()[0]) for k, c in counts.items()]
            # bucket -1: the number of documents
            out = {"lang": [k for k, b in held for _ in b], "bucket": np.concatenate([b - 1 for _, b in held] or [np.empty(0, np.int64)]), "n": np.concatenate([counts[k][b] for k, b in held] or [np.empty(0, np.int64)])}
            counts.clear()
            return out

        def work(batch):
            if batch is None:
                return given()
            of = {}
            for words, k in zip(batch["text"], batch["lang"], strict=True):
                of.setdefault(k, []).append(words)
            out = given() if len(counts) + len(of) > BLOCK else None
            for k, texts in of.items():
                mine = counts.setdefault(k, np.zeros((1 << BITS) + 1, np.int64))
                mine[0] += len(texts)
                for _, bucket in grams(texts):
                    mine[1:] += np.bincount(bucket, minlength=1 << BITS)
            return out

        return work

    counted = saved(map_rows(rows, "lang string, bucket bigint, n bigint", make, finish=True).groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "grams")
    documents = {r["lang"]: r["n"] for r in counted.where("bucket = -1").select("lang", "n").collect()}  # one row for each language
    languages, every, models = sorted(documents), sum(n + 1 for n in documents.values()), []
    for at in range(0, len(languages), BLOCK):
        block = languages[at : at + BLOCK]
        got = counted.where(F.col("lang").between(block[0], block[-1]) & (F.col("bucket") >= 0)).toArrow()
        place, counts = {k: i for i, k in enumerate(block)}, np.full((len(block), 1 << BITS), ALPHA)
        counts[[place[k] for k in got.column("lang").to_pylist()], got.column("bucket").to_numpy()] += got.column("n").to_numpy()
        models.append(LanguageModel(block, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), np.log(np.array([documents[k] + 1 for k in block]) / every)))
    return models


def scored(model: LanguageModel | None, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the best language, its total, and the logarithm of the sum of all exp(total - best)."""
    known = np.array([model is not None and has_letter(x) for x in texts], bool)
    best, total, others = np.full(len(texts), "und", object), np.full(len(texts), -np.inf), np.zeros(len(texts))
    if known.any():
        totals = model.totals([x for x, k in zip(texts, known, strict=True) if k])
        at = totals.argmax(axis=1)
        best[known], total[known] = np.array(model.languages, object)[at], totals.max(axis=1)
        others[known] = np.log(np.exp(totals - total[known, None]).sum(axis=1))
    return best, total, others


def predict(docs: DataFrame, models: list[LanguageModel], keep: list[str], text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns named in keep, then the language and its probability."""
    kept = ", ".join(f"`{n}` {t}" for n, t in docs.select(*keep).dtypes)
    rows, so_far = docs.select(*keep, F.col(text).alias("text "), F.lit("und").alias("best "), F.lit(float("-inf")).alias("total "), F.lit(0.0).alias("others ")), None
    for model in models or [None]:
        rows = rows if so_far is None else so_far
        so_far = _pass(rows, docs.sparkSession.sparkContext.broadcast(model), keep, kept, last=model is (models or [None])[-1])
    score = F.when(F.col("best ") == "und", 0.0).otherwise(F.exp(-F.col("others ")))
    return so_far.select(*keep, F.col("best ").alias(names[0]), score.alias(names[1]))


def _pass(rows, shared, keep, kept, last):
    def make():
        model = shared.value

        def work(batch):
            best, total, others = scored(model, batch["text "])
            before, before_others = np.array(batch["total "], float), np.array(batch["others "], float)
            better = total > before
            top = np.where(better, total, before)
            with np.errstate(invalid="ignore"):
                both = np.logaddexp(total + others - top, before + before_others - top)
            return {k: batch[k] for k in keep} | ({} if last else {"text ": batch["text "]}) | {"best ": np.where(better, best, np.array(batch["best "], object)).tolist(), "total ": top, "others ": np.where(np.isfinite(top), both, 0.0)}

        return work

    return map_rows(rows, kept + ("" if last else ", `text ` string") + ", `best ` string, `total ` double, `others ` double", make)


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1):
    """Whether crc32(doc_id as text) mod folds is fold. A null doc_id is held out: nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of documents, learned from the rows that are not held out."""
    models = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), models, ["doc_id", "held_out"])


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is known with probability least or more. Learned from all rows that have a language.
    Rows stay Arrow batches: only the texts are looked at, and batches are filtered."""
    models = train(docs)
    if len(models) > 1:
        found = predict(docs, models, docs.columns, names=("lang ", "score "))
        return found.where((F.col("lang ") != "und") & (F.col("score ") >= least)).select(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(models[0] if models else None)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in parts(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                best, _, others = scored(model, texts)
                keep = (best != "und") & (np.exp(-others) >= least) if model else np.array([has_letter(x) for x in texts], bool)
                if keep.any():
                    yield part.filter(pa.array(keep))
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
