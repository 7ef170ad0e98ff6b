"""What the operators of this subpackage share: tables, scratch tables, word hashing, Bloom filters."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_OWN_SCRATCH: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_SCRATCH:
        _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="spark-platewise-", dir="/tmp"))
    return _OWN_SCRATCH[0]


def saved(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df as a Parquet table in the shared scratch folder and returns that table: lineage ends here, so a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows, and about so many bytes of Arrow data, that are turned into Python objects at a time.
PART_ROWS, PART_BYTES = 1024, 1 << 22
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most PART_ROWS rows and, but for single rows, about PART_BYTES."""
    n = max(1, min(PART_ROWS, batch.num_rows * PART_BYTES // max(1, batch.nbytes)))
    for at in range(0, batch.num_rows, n):
        part = batch.slice(at, n)
        if n > 1 and part.nbytes > 2 * PART_BYTES:  # long texts stand together here
            yield from (part.slice(i, 1) for i in range(part.num_rows))
        else:
            yield part


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of PART_ROWS rows, unless the session has a setting of its own: 10,000 texts, Spark's default, are tens of MB outside the
    heap, several times over."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(PART_ROWS))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable[[dict[str, list]], dict[str, Iterable] | None]], binary: tuple[str, ...] = (), finish: bool = False) -> DataFrame:
    """mapInArrow with lists. make() runs once in each task and returns a function from a batch's columns to output columns.
    Text columns named in binary arrive as UTF-8 bytes. With finish, the function is called once more with None at the end."""
    small_batches(df.sparkSession)
    fields = T.StructType.fromDDL(schema)
    names, kinds = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()

        def out(columns):
            arrays = [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n], k) for n, k in zip(names, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in parts(batch):
                columns = {n: (part.column(i).cast(pa.binary()) if n in binary else part.column(i)).to_pylist() for i, n in enumerate(part.schema.names)}
                if (made := work(columns)) is not None:
                    yield out(made)
            batch = part = columns = made = None
        if finish and (made := work(None)) is not None:
            yield out(made)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, fields)


_TABLES = np.random.default_rng(20_061)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.where(_SPACE, np.uint64(0), _TABLES.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_WEIGHT, _WEIGHTS = (_TABLES.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_WEIGHTS[0] = 1  # a segment's hash is the same with and without a longer one beside it


def word_starts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text, and where its words begin; words are runs of other bytes than ASCII white space."""
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    begins = ~space
    begins[1:] &= space[:-1]
    return b, np.flatnonzero(begins)


def segment_hashes(values: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of value times a random odd weight for its place in the segment, for segments that begin at starts (the first at 0)."""
    weight = _WEIGHT[place & 4095]
    if len(place) and place.max() > 4095:
        weight = weight * _WEIGHTS[place >> 12 & 4095]
    return mix(np.add.reduceat(values * weight, starts))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, in order."""
    b, starts = word_starts(text)
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(starts[0], len(b)) - np.repeat(starts, np.diff(starts, append=len(b)))
    return segment_hashes(_VALUE[b[starts[0] :]], place, starts - starts[0])


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of every n consecutive words, from the words' hashes: by doubling, in log2(n) array operations."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, width, got = None, 0, h
    step, bits = 1, n
    while bits:
        if bits & 1:
            if out is None:
                out, width = got, step
            else:
                m = len(h) - width - step + 1
                out, width = mix(out[:m] * np.uint64(0x9E3779B97F4A7C15) + got[width : width + m]), width + step
        bits >>= 1
        if bits:
            m = len(h) - 2 * step + 1
            got, step = mix(got[:m] * np.uint64(0xC2B2AE3D27D4EB4F) + got[step : step + m]), 2 * step
    return out


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


class Bloom:
    """A set of 64-bit keys with false positives only. Its size follows the number of keys up to 2^29 bits (64 MB, the bound of what
    is broadcast); past that it lets more keys through, which costs shuffle but never a result: all its uses check what passes."""

    MOST = 29

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, int(len(words) * 64).bit_length() - 1

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for bit in self.places(mix(keys), self.bits):
            found &= (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        return found

    @staticmethod
    def places(x, bits: int):
        return [x & np.uint64((1 << bits) - 1), x >> np.uint64(64 - bits)]


def bloom(keys: DataFrame, column: str) -> Bloom:
    """Bloom filter of a bigint column. Spark sets the bits and ors them by 64-bit word; only the filter reaches the driver."""
    n = keys.count()
    bits = min(Bloom.MOST, max(12, (16 * n).bit_length()))

    def make():
        def work(batch):
            x = mix(np.array([k for k in batch[column] if k is not None], np.int64).view(np.uint64))
            at = np.unique(np.concatenate(Bloom.places(x, bits)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
            return {"word": as_long(word), "value": as_long(value)}

        return work

    got = map_rows(keys.select(column), "word bigint, value bigint", make).groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got.column("word").to_numpy()] = got.column("value").to_numpy().view(np.uint64)
    return Bloom(words)
