"""Which keys of a chunk of documents occur in other documents too.

Operators that look for what documents have in common make many 64-bit keys a document, of which most are unique. Only
keys that are not need to travel with their documents. A first exchange carries, per chunk and bucket of key space, the
sorted distinct keys cut to 40 bits, as zstd-packed differences (about 4 bytes a key); a bucket's task counts the
documents of each key over all chunks and answers each chunk with one capped byte a key, which packs to little. A count is
never too low, as equal keys have equal 40 bits; a key counted too high only makes a candidate that later steps refute.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Bytes of text in a chunk, and so in a task.
CHUNK_BYTES = 8_000_000
CAP = 255


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, bytes of equal weight together, packed."""
    import zstandard

    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def packed(raw: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(raw).tobytes())


def unpacked(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(id, text) with the number of its chunk, dealt by it; and how many chunks there are."""
    n = max(1, -(-text_bytes(docs) // chunk_bytes))
    return docs.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).repartition(n, "chunk"), n


def bits_for(n: int) -> int:
    """So many bits of a key choose the bucket that there are as many buckets as chunks, about."""
    return max(1, (n - 1).bit_length())


def by_bucket(keys: np.ndarray, docs: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 40-bit keys in order of buckets, how many documents have each, where each bucket begins, and each input's place."""
    cut = keys >> np.uint64(64 - bits - 40)
    distinct, place = np.unique(cut, return_inverse=True)
    order = np.lexsort((docs, place))
    p, d = place[order], docs[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    counts = np.bincount(p[new], minlength=len(distinct))
    edges = np.searchsorted(distinct, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(40))
    return distinct, counts, edges, place


SENT = "bucket int, chunk int, keys binary, counts binary"
ANSWER = "chunk int, bucket int, counts binary"


def sent(chunk: int, keys: np.ndarray, docs: np.ndarray, bits: int):
    """A chunk's rows for the buckets."""
    import pyarrow as pa

    distinct, counts, edges, _ = by_bucket(keys, docs, bits)
    used = np.flatnonzero(np.diff(edges))
    low = distinct & np.uint64((1 << 40) - 1)
    few = np.minimum(counts, CAP).astype(np.uint8)
    return pa.table({
        "bucket": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), chunk), pa.int32()),
        "keys": pa.array([pack(low[edges[b] : edges[b + 1]]) for b in used], pa.binary()),
        "counts": pa.array([packed(few[edges[b] : edges[b + 1]]) for b in used], pa.binary()),
    })


def answers(rows: DataFrame) -> DataFrame:
    """The buckets' answers: for each of a chunk's keys how many documents have it, at most CAP."""

    def count(table):
        import pyarrow as pa

        keys = [unpack(x.as_py()) for x in table.column("keys")]
        own = [unpacked(x.as_py(), np.uint8) for x in table.column("counts")]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(own), len(distinct))
        total = np.minimum(total, CAP).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        blobs = [packed(total[place[e - len(k) : e]]) for k, e in zip(keys, ends, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "counts": pa.array(blobs, pa.binary())})

    return rows.groupBy("bucket").applyInArrow(count, ANSWER)


def counted(answer_buckets: list[int], answer_blobs: list[bytes], keys: np.ndarray, docs: np.ndarray, bits: int) -> np.ndarray:
    """For each key of a chunk, made anew in the same order, the number of documents that have it."""
    distinct, _, edges, place = by_bucket(keys, docs, bits)
    total = np.zeros(len(distinct), np.int64)
    for b, blob in zip(answer_buckets, answer_blobs, strict=True):
        total[edges[b] : edges[b + 1]] = unpacked(blob, np.uint8)
    return total[place]


