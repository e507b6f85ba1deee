"""Mixing sources to target weights by capped water-filling.

Targets: sources share the words of all documents by weight; a source that would get more than ``max_epochs`` times its
own words is clamped there, and the excess goes to the others by weight until none is above. With sources in the order of
cap / weight the clamped ones are a prefix, so the level that repeated redistribution ends at comes from running sums.

Sampling: a source's rate is its target over its words. Every document is taken floor(rate) times whole; the rest of the
target is filled with one more repetition of documents in the order of a seeded hash, and the document at which it is
reached is taken in part. So taken words meet the target up to rounding, no document is taken more often than
``max_epochs``, and reruns agree. The order is resolved by the hash's leading hex digits: words are summed per source and
bucket, and only running sums within buckets look at rows, so a source with a third of all rows is spread over all tasks.

Defined results: a null text has 0 words; a null source is a source, the last one; an empty table gives an empty table;
a source without words gets the target 0; rows that repeat a doc_id are documents of their own, ordered by size; null
doc_ids are allowed. Only the named columns are read; others, whatever their names, don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORDS, ensure_checkpoint_dir, lean, row_keyed, table, word_starts, text_buffer

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hex digits of the seeded hash that make a bucket: 4096 a source.
DIGITS = 3


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for b in batches:
        *_, n = word_starts(*text_buffer(b.column("text")))
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "size"])


def sized(docs: DataFrame, key: str, text: str, source: str, row: str | None = None) -> DataFrame:
    more = [F.col(row).cast("long").alias("row")] if row else []
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(source).cast("string").alias("source"), *more, F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean(_counted), f"id long, source string,{' row long,' if row else ''} size long")


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size) to (source, source_size, target). One row per source, so its windows are not partitioned."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(ordered) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", w).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = lambda c: F.sum(c).over(everything)
    x = x.withColumn("words", total(F.col("source_size").cast("double")))
    x = x.withColumn("left", F.col("words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    x = x.withColumn("w_left", total("w") - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    x = x.withColumn("clamped", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    x = x.withColumn("free", F.col("words") - total(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)))
    x = x.withColumn("w_free", total(F.when(F.col("clamped"), 0.0).otherwise(F.col("w"))))
    target = F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("w") * F.col("free") / F.col("w_free"))
    return x.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """Per row of docs: key, size, source_size, target, taken, epochs (whole repetitions), extra (words of a partial one);
    and row, a column of numbers that tells rows of one key apart, if it is named."""
    ensure_checkpoint_dir(docs.sparkSession)
    base = sized(docs, key, text, source, row)
    own = ["row"] if row else []
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    h = F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(f":{seed}")))
    base = base.withColumns({"named": named, "h": h, "bucket": F.substring(h, 1, DIGITS)}).checkpoint()
    buckets = base.groupBy("named", "source", "bucket").agg(F.sum("size").alias("words"))
    sources = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    sources = sources.withColumn("named", named).drop("source")
    sums = buckets.withColumn("start", F.sum("words").over(Window.partitionBy("named").orderBy("bucket")) - F.col("words")).select("named", "bucket", "start")
    within = F.sum("size").over(Window.partitionBy("named", "bucket").orderBy("h", F.col("id").asc_nulls_last(), "size", *own).rowsBetween(Window.unboundedPreceding, 0))
    rows = base.withColumn("upto", within).join(sums, ["named", "bucket"]).join(sources, "named")
    rows = rows.withColumn("start", F.col("start") + F.col("upto") - F.col("size"))
    rows = rows.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    rest = F.floor(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    taken = F.col("whole") * F.col("size") + more
    full = (more == F.col("size")) & (F.col("size") > 0)
    return rows.select(
        F.col("id").alias(key), "size", "source_size", "target", taken.cast("long").alias("taken"),
        (F.col("whole") + F.when(full, 1).otherwise(0)).cast("long").alias("epochs"), F.when(full, 0).otherwise(more).cast("long").alias("extra"),
        *(F.col(c).alias(row) for c in own),
    )


def repeated(docs: DataFrame, **names) -> DataFrame:
    """The mixed documents: each as often as the mix takes it, a partial repetition cut after its words."""
    keyed, row = row_keyed(docs)
    took = mix(keyed, row=None if row == "doc_id" else row, **names).select(F.col(row).alias("taken_id"), "epochs", "extra")
    rows = keyed.join(took, F.col(row) == F.col("taken_id"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORDS), 0)
    part = F.array_join(F.slice(words, F.lit(1), F.col("extra").cast("int")), "")
    copies = F.concat(F.array_repeat(F.col("text"), F.col("epochs").cast("int")), F.when(F.col("extra") > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    out = rows.withColumn("text", F.explode(copies))
    return out.select(*[F.length("text").cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def mixed_sql(documents: str) -> str:
    """The mix of a relation as DuckDB SQL: doc_id, size, source_size, target, taken, epochs, extra."""
    return rf"""
SELECT doc_id, size, source_size, target, CAST(whole * size + more AS BIGINT) AS taken,
       CAST(whole + CASE WHEN more = size AND size > 0 THEN 1 ELSE 0 END AS BIGINT) AS epochs,
       CAST(CASE WHEN more = size THEN 0 ELSE more END AS BIGINT) AS extra
FROM (
  SELECT *, greatest(0, least(size, CAST(floor(target - whole * source_size) AS BIGINT) - start)) AS more
  FROM (
    SELECT b.doc_id, b.size, t.source_size, t.target,
           CAST(CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS BIGINT) AS whole,
           CAST(sum(b.size) OVER (PARTITION BY b.named ORDER BY b.h, b.doc_id NULLS LAST, b.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - b.size AS start
    FROM (
      SELECT doc_id, coalesce('s' || source, 'n') AS named, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':{SEED}') AS h,
             CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size FROM {documents}
    ) b JOIN (
      SELECT named, source_size, CASE WHEN clamped THEN cap ELSE w * (words - sum(CASE WHEN clamped THEN cap ELSE 0e0 END) OVER ())
             / sum(CASE WHEN clamped THEN 0e0 ELSE w END) OVER () END AS target
      FROM (
        SELECT *, cap * (sum(w) OVER () - coalesce(sum(w) OVER up, 0e0)) <= w * (words - coalesce(sum(cap) OVER up, 0e0)) AS clamped
        FROM (
          SELECT *, CAST(source_size * {MAX_EPOCHS} AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS words,
                 [{', '.join(f'{x}e0' for x in WEIGHTS)}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS w
          FROM (
            SELECT source, coalesce('s' || source, 'n') AS named, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))) AS BIGINT) AS source_size
            FROM {documents} GROUP BY source
          )
        ) WINDOW up AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
      )
    ) t USING (named)
  )
)"""


QUERIES = {"op8_mixing": op8_mixing}
SQL = {"op8_mixing": mixed_sql("documents")}
