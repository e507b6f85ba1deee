"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's shared folder; where none is named, a folder of the warehouse, which all share."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")


def text_of(column: str = "text"):
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts, from which partition counts are derived."""
    return int(docs.agg(F.sum(F.octet_length(F.col(text))).alias("n")).first()["n"] or 0)


def text_buffer(column):
    """An Arrow string column as one uint8 array with int64 offsets; null counts as empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n, start = len(column), column.offset
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[start : start + n + 1]
    data = column.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def byte_class(inside) -> "object":
    """A table of 256 booleans."""
    import numpy as np

    out = np.zeros(256, bool)
    out[list(inside)] = True
    return out


SPACE_BYTES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def word_starts(data, offsets, spaces=SPACE_BYTES):
    """Where words (runs of bytes that are not spaces) begin and end, texts apart; and how many words each text has."""
    import numpy as np

    word = ~byte_class(spaces)[data]
    before = np.empty(len(data), bool)
    before[1:] = word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[firsts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(data), bool)
    after[:-1] = word[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    after[lasts] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def give_back() -> None:
    """Returns to the system what a worker's allocators keep. Workers outlive their tasks, and what one stage leaves in them
    counts while the next one runs."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A worker's function over batches that gives memory back when its task ends."""

    def over(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return over


def lean_pair(run: Callable) -> Callable:
    """A worker's function over a key and two tables that gives memory back when it ends."""

    def over(key, left, right):
        out = run(key, left, right)
        give_back()
        return out

    return over


def stored(frame: DataFrame) -> tuple[DataFrame, str]:
    """Writes a table to the shared checkpoint folder, which cuts its lineage, and gives it with its path."""
    import uuid

    spark = frame.sparkSession
    ensure_checkpoint_dir(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{folder}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path), path


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes stored tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def row_keyed(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, str]:
    """The table with a column that tells its rows apart, and that column's name: the key itself if no row lacks or repeats
    it, else numbers. Numbers are given as rows come, so the numbered table is stored: made anew, rows could come otherwise."""
    n = docs.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys")).first()
    if n["rows"] == n["keys"]:
        return docs, key
    row = max(docs.columns, key=len) + "_row"
    return stored(docs.withColumn(row, F.monotonically_increasing_id()))[0], row


def components(nodes_edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): rows (id, component) for each id in an edge, component the smallest id.

    Each round hooks every node to its smallest neighbour and contracts the edges. The first round is enough for stars;
    from then on pointers are doubled three times before, so a chain shrinks to an eighth. Rounds are checkpointed."""
    spark = nodes_edges.sparkSession
    ensure_checkpoint_dir(spark)
    edges = nodes_edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().checkpoint()
    label = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")).checkpoint()
    first = True
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")).checkpoint()
        for _ in range(0 if first else 3):
            on = hook.select(F.col("node").alias("to"), F.col("to").alias("beyond"))
            hook = hook.join(on, "to").select("node", F.col("beyond").alias("to")).checkpoint()
        first = False
        to = hook.select(F.col("node").alias("component"), "to")
        label = label.join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")).checkpoint()
        moved = edges.join(hook.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(hook.select(F.col("node").alias("v"), F.col("to").alias("b")), "v")
        edges = moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct().checkpoint()
    return label
