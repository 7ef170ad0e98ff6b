"""WARC archives with a two-level capture index.

Every page becomes a WARC record in a gzip member of its own: a `response` with the payload, or a `revisit` of the response whose payload
is equal. Records are stored in chunks of about CHUNK bytes; the chunks of an archive, joined in order, are a valid .warc.gz file. The
index holds one line for every capture, sorted by the key (reversed host, then the rest of the URL, then page_id), in compressed blocks.
The second level is a sparse directory, the first key of every block: blocks grow with the index, so that the directory never has more than
DIRECTORY entries. Reading bisects the directory, then the block, and then reads the range of bytes that the line names.

Nulls and edges: a null html is the empty payload; a null url has the empty key. Rows with a null page_id come after all others, and
refer to a response like them. Of repeated rows with the smallest page_id all are responses. Extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.llm.common import map_rows, saved

CHUNK = 1 << 20
PER_BLOCK = 512
DIRECTORY = 1 << 16
LAST = 2**63 - 1
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def surt(url: Column) -> Column:
    """`com,example,www)/path?query`: the host reversed, its ASCII letters lower-cased; without ://, the url itself."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host, tail = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.concat(F.array_join(F.reverse(F.split(lower, r"\.")), ","), F.lit(")"), tail)).otherwise(url), F.lit(""))


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_record(kind: str, url: str | None, page: int | None, refers_to: int | None, payload: bytes, digest: str) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP header only, as its profile allows."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Target-URI: {target}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def read_record(member: bytes) -> dict:
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    number = lambda x: None if x in (None, "<urn:page:None>") else int(x[10:-1])
    return {"page_id": number(fields["WARC-Record-ID"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload}


CHUNKS = "archive bigint, chunk bigint, records binary, url_key array<string>, page array<bigint>, start array<bigint>, bytes array<bigint>"


def write_archives(pages: DataFrame) -> DataFrame:
    """The table of chunks: archive, chunk, records, and for each record url_key, page, start and bytes (its range in the chunk)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), surt(F.col("url")).alias("url_key"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = rows.select("digest", "page_id").groupBy("digest").agg(F.min(F.coalesce("page_id", F.lit(LAST))).alias("first"))
    rows = rows.join(first, "digest").withColumn("archive", F.spark_partition_id().cast("bigint"))

    def make():
        held, size, chunk = [], 0, 0

        def emit(archive):
            nonlocal held, size, chunk
            at = np.cumsum([0] + [len(m) for m, _, _ in held])
            row = {"archive": [archive], "chunk": [chunk], "records": [b"".join(m for m, _, _ in held)], "url_key": [[k for _, k, _ in held]], "page": [[p for _, _, p in held]], "start": [at[:-1].tolist()], "bytes": [np.diff(at).tolist()]}
            held, size, chunk = [], 0, chunk + 1
            return row

        last = None

        def work(batch):
            nonlocal size, last
            out = []
            if batch is None:
                return emit(last) if held else None
            for page, url, html, key, digest, first, last in zip(*(batch[k] for k in ("page_id", "url", "html", "url_key", "digest", "first", "archive")), strict=True):
                kind = "response" if (LAST if page is None else page) == first else "revisit"
                member = write_record(kind, url, page, None if first == LAST else first, html, base64.b32encode(bytes.fromhex(digest)).decode())
                held.append((member, key, page))
                size += len(member)
                if size >= CHUNK:
                    out.append(emit(last))
            return {k: [v for o in out for v in o[k]] for k in out[0]} if out else None

        return work

    names = ["page_id", "url", "html", "url_key", "digest", "first", "archive"]
    schema = CHUNKS.replace("array<string>", "array<string>")
    return saved(map_rows(rows.select(*names), schema, make, binary=("html",), finish=True), "archives")


def write_index(archives: DataFrame) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The blocks (block, lines: zlib of the sorted lines), as a table, and the directory: (first key, block), sorted.
    A line is key, archive, chunk, start, bytes, separated by tabs; its key ends in the page_id."""
    lines = archives.select("archive", "chunk", F.explode(F.arrays_zip("url_key", "page", "start", "bytes")).alias("x"))
    escaped = F.regexp_replace(F.regexp_replace("x.url_key", "[\t\r\n]", " "), " ", "%20")
    key = F.concat(escaped, F.lit(" "), F.lpad(F.coalesce(F.col("x.page").cast("string"), F.lit("-")), 20, "0"))
    lines = lines.select(key.alias("key"), "archive", "chunk", F.col("x.start").alias("start"), F.col("x.bytes").alias("bytes"))
    n = archives.agg(F.sum(F.size("page"))).first()[0] or 0
    per_block = max(PER_BLOCK, -(-2 * n // DIRECTORY))
    parts = max(1, -(-n // (per_block * 64)))
    # by the place too, so that captures with one key are dealt out over parts
    order = "key", "archive", "chunk", "start"
    ordered = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("task", F.spark_partition_id().cast("bigint"))

    def make():
        held, block, task = [], 0, 0

        def emit():
            nonlocal held, block
            row = {"block": [(task << 32) + block], "first": [held[0].partition("\t")[0]], "n": [len(held)], "lines": [zlib.compress("\n".join(held).encode(), 6)]}
            held, block = [], block + 1
            return row

        def work(batch):
            nonlocal task
            if batch is None:
                return emit() if held else None
            out = []
            for key, archive, chunk, start, size, task in zip(*(batch[k] for k in ("key", "archive", "chunk", "start", "bytes", "task")), strict=True):
                held.append(f"{key}\t{archive}\t{chunk}\t{start}\t{size}")
                if len(held) >= per_block:
                    out.append(emit())
            return {k: [v for o in out for v in o[k]] for k in out[0]} if out else None

        return work

    blocks = saved(map_rows(ordered, "block bigint, first string, n bigint, lines binary", make, finish=True), "index")
    return blocks, sorted((r["first"], r["block"]) for r in blocks.select("first", "block").collect())  # DIRECTORY rows at most, and one for each part


def find(keys: DataFrame, blocks: DataFrame, directory: list[tuple[str, int]]) -> DataFrame:
    """archive, chunk, start, bytes of each capture in keys (column key), by bisection of the directory and then of the blocks: captures
    with one key may lie in several."""
    shared = keys.sparkSession.sparkContext.broadcast(directory)

    def make_first():
        firsts, at = [k for k, _ in shared.value], [b for _, b in shared.value]
        wide = set()  # keys that lie in several blocks, of which there are fewer than blocks: a task asks for them once

        def work(batch):
            out = [], []
            for k in batch["key"]:
                low, high = max(0, bisect_left(firsts, k) - 1), bisect_right(firsts, k)
                if high - low > 1:
                    if k in wide:
                        continue
                    wide.add(k)
                out[0].extend([k] * (high - low))
                out[1].extend(at[low:high])
            return dict(zip(("key", "block"), out, strict=True))

        return work

    probes = map_rows(keys.select("key"), "key string, block bigint", make_first).groupBy("block").agg(F.collect_set("key").alias("keys"))

    def make_second():
        def work(batch):
            out = [], [], [], []
            for packed, wanted in zip(batch["lines"], batch["keys"], strict=True):
                lines = [x.split("\t") for x in zlib.decompress(packed).decode().split("\n")]
                keys = [x[0] for x in lines]
                for key in wanted:
                    i = bisect_right(keys, key) - 1
                    while i >= 0 and keys[i] == key:
                        for column, v in zip(out, lines[i][1:], strict=True):
                            column.append(int(v))
                        i -= 1
            return dict(zip(("archive", "chunk", "start", "bytes"), out, strict=True))

        return work

    # a block has per_block lines, so the keys collected for it are bounded too
    return map_rows(blocks.join(probes, "block").select("lines", "keys"), "archive bigint, chunk bigint, start bigint, bytes bigint", make_second)


def read_ranges(ranges: DataFrame, archives: DataFrame, payload: bool = False) -> DataFrame:
    """Reads the records at ranges (archive, chunk, start, bytes) and parses them; payload: with the payload itself."""
    wanted = ranges.groupBy("archive", "chunk").agg(F.collect_list(F.struct("start", "bytes")).alias("at")).select("archive", "chunk", F.col("at.start").alias("start"), F.col("at.bytes").alias("bytes"))
    rows = archives.select("archive", "chunk", "records").join(wanted, ["archive", "chunk"]).select("records", "start", "bytes")
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload

    def make():
        names = [f.split()[0] for f in schema.split(", ")]

        def work(batch):
            got = [read_record(records[a : a + n]) for records, start, size in zip(batch["records"], batch["start"], batch["bytes"], strict=True) for a, n in zip(start, size, strict=True)]
            return {k: [g[k] for g in got] for k in names}

        return work

    return map_rows(rows, schema, make)


def page_keys(pages: DataFrame) -> DataFrame:
    escaped = F.regexp_replace(F.regexp_replace(surt(F.col("url")), "[\t\r\n]", " "), " ", "%20")
    return pages.select(F.concat(escaped, F.lit(" "), F.lpad(F.coalesce(F.col("page_id").cast("string"), F.lit("-")), 20, "0")).alias("key"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives and index, then finds and reads the record of every page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    archives = write_archives(pages)
    blocks, directory = write_index(archives)
    return read_ranges(find(page_keys(pages), blocks, directory), archives)


ORACLE_SQL = """
with page as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
bits as (select page_id, html, h, min(page_id) over (partition by h) as first from page)
select page_id, octet_length(encode(html))::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1) for i in range(32)], '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id = first then null else first end as refers_to
from bits
"""
