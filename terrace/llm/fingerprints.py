"""Exact deduplication by composable polynomial fingerprints.

A text is cut into chunks of ``CHUNK`` bytes; a chunk's hash is a polynomial in four bases modulo four primes below 2^30.
Hashes combine: hash(AB) = hash(A) * base^|B| + hash(B). So all chunks of a batch are hashed at once, in one matrix
product that is exact in doubles, and a document's fingerprint is the length-shifted sum of its chunks' hashes; pieces of
a huge document can be hashed apart and combined with ``combine``.

Equal fingerprints are not taken for equal texts: texts are compared piece by piece. Pieces of ``PIECE`` bytes are
aggregated by (fingerprint, length, number of the piece) to their least and greatest bytes, which are equal only if the
pieces of all texts of the group are. The aggregation combines before it shuffles, so a group with a third of all rows
sends one row per task, no group is ever gathered, and a huge text is spread over tasks. Texts of a fingerprint that
fails are grouped by their full text.

Defined results: null counts as empty, so null and blank-free empty texts are copies of each other; runs of white space
count as one space; of equal texts the row with the smallest doc_id stays, null doc_ids last; rows that repeat a doc_id
with an equal text have the same verdict; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_BYTES, SPACES, byte_class, ensure_checkpoint_dir, lean, table, text_buffer

CHUNK = 512
PIECE = 1 << 16
PRIMES = (1073741789, 1073741783, 1073741741, 1073741723)
BASES = (536870923, 805306457, 671088667, 939524129)


def _powers(base: int, prime: int, n: int) -> list[int]:
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % prime)
    return out


#: Column m: base^(CHUNK-1), ..., base^0 modulo prime m.
_MATRIX = np.array([_powers(b, p, CHUNK)[::-1] for b, p in zip(BASES, PRIMES, strict=True)], np.float64).T
_PRIMES = np.array(PRIMES, np.int64)


def combine(left: tuple[int, ...], right: tuple[int, ...], right_bytes: int) -> tuple[int, ...]:
    """The fingerprint of two texts put together."""
    return tuple((a * pow(b, right_bytes, p) + c) % p for a, c, b, p in zip(left, right, BASES, PRIMES, strict=True))


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four residues for each text of a buffer."""
    n = np.diff(offsets)
    chunks = (n + CHUNK - 1) // CHUNK
    ends = np.cumsum(chunks)
    total = int(ends[-1]) if len(ends) else 0
    # zeros before a text change nothing, so each text is set against the end of its chunks
    padded = np.zeros(total * CHUNK, np.uint8)
    for i in np.flatnonzero(n):
        to = ends[i] * CHUNK
        padded[to - n[i] : to] = data[offsets[i] : offsets[i + 1]]
    padded = padded.reshape(-1, CHUNK)
    hashes = np.empty((total, len(PRIMES)), np.int64)
    for at in range(0, total, 4096):
        hashes[at : at + 4096] = (padded[at : at + 4096].astype(np.float64) @ _MATRIX).astype(np.int64) % _PRIMES
    most = int(chunks.max()) if len(chunks) else 0
    shift = np.array([_powers(pow(b, CHUNK, p), p, max(most, 1)) for b, p in zip(BASES, PRIMES, strict=True)], np.int64).T
    after = np.repeat(ends, chunks) - 1 - np.arange(total)
    shifted = hashes * shift[after] % _PRIMES if total else hashes
    sums = np.vstack([np.zeros((1, len(PRIMES)), np.int64), np.cumsum(shifted, axis=0)])
    return (sums[ends] - sums[ends - chunks]) % _PRIMES


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of white space to one space each, text by text."""
    space = byte_class(SPACE_BYTES)[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    counts = np.concatenate([[0], np.cumsum(keep)])
    return np.where(space, np.uint8(32), data)[keep], counts[offsets]


def _columns(fp: np.ndarray, bits: int) -> list[np.ndarray]:
    """Two longs of two residues each; fewer bits for tests of colliding fingerprints."""
    cut = fp & ((1 << bits) - 1)
    return [cut[:, 0] << 30 | cut[:, 1], cut[:, 2] << 30 | cut[:, 3]]


def _plain(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))


#: Rows of an Arrow batch that are worked on at once.
ROWS = 500


def _base(bits: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                data, offsets = normalised(*text_buffer(batch.column("text")))
                raw = memoryview(data)
                shas = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).hexdigest() for i in range(batch.num_rows)]
                a, b = _columns(fingerprints(data, offsets), bits)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a), pa.array(b), pa.array(np.diff(offsets)), pa.array(shas)], names=["id", "a", "b", "n", "sha"])

    return run


def _pieces(bits: int, piece: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                data, offsets = normalised(*text_buffer(batch.column("text")))
                a, b = _columns(fingerprints(data, offsets), bits)
                n = np.diff(offsets)
                pieces = np.maximum((n + piece - 1) // piece, 1)
                row = np.repeat(np.arange(len(n)), pieces)
                no = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts = offsets[:-1][row] + no * piece
                bounds = np.append(starts, offsets[-1])
                values = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(row)), pa.array(a[row]), pa.array(b[row]), pa.array(n[row]), pa.array(no), values.cast(pa.binary()),
                ], names=["id", "a", "b", "n", "no", "piece"])

    return run


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 30, piece: int = PIECE) -> DataFrame:
    """Per row: key, keep_id, group_size, kept, text_sha256, fp_a, fp_b (the fingerprint). bits: of each residue."""
    ensure_checkpoint_dir(docs.sparkSession)
    plain = _plain(docs, key, text)
    base = plain.mapInArrow(lean(_base(bits)), "id long, a long, b long, n long, sha string").checkpoint()
    pieces = plain.mapInArrow(lean(_pieces(bits, piece)), "id long, a long, b long, n long, no long, piece binary")
    compared = pieces.groupBy("a", "b", "n", "no").agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size"), (F.min("piece") != F.max("piece")).alias("unlike")
    )
    groups = compared.groupBy("a", "b", "n").agg(F.min("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.max("unlike").alias("unlike")).checkpoint()
    rows = base.join(groups.filter(~F.col("unlike")), ["a", "b", "n"])
    unlike = groups.filter("unlike").select("a", "b", "n")
    if not unlike.isEmpty():
        texts = plain.mapInArrow(lean(_pieces(bits, 1 << 30)), "id long, a long, b long, n long, no long, piece binary").join(unlike, ["a", "b", "n"])
        same = Window.partitionBy("a", "b", "n", "piece")
        split = texts.select("id", "a", "b", "n", F.sha2("piece", 256).alias("sha"), F.min("id").over(same).alias("keep_id"), F.count("*").over(same).alias("group_size"))
        rows = rows.select("id", "a", "b", "sha", "keep_id", "group_size").unionByName(split.select("id", "a", "b", "sha", "keep_id", "group_size"))
    return rows.select(
        F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("a").alias("fp_a"), F.col("b").alias("fp_b"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("fp_a", "fp_b")


def groups_sql(documents: str) -> str:
    return f"""
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACES}', ' ', 'g') AS t FROM {documents})"""


QUERIES = {"op4_exact_dedup": op4_exact_dedup}
SQL = {"op4_exact_dedup": groups_sql("documents")}
