"""Groups with the same content are worked out once."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tasks that kinds are dealt to: few rows would be one task, and the kernel takes far longer than reading.
DEALT = 48


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """256 bits of the columns' values; an array's items are told one by one, so that no long text is made."""
    digest = lambda c: F.sha2(F.to_json(F.struct(c.alias("v"))), 256)
    parts = [F.concat_ws(",", F.transform(c, digest)) if isinstance(df.schema[c].dataType, T.ArrayType) else digest(F.col(c)) for c in columns]
    return F.sha2(F.concat_ws(";", *parts), 256)


def by_kind(groups: DataFrame, key: list[str], run: Callable[[dict], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``run`` makes of each group's content, with the group's key. groups: one row a group; what is
    not its key is its content."""
    content = [c for c in groups.columns if c not in key]
    named = groups.withColumn("kind", fingerprint(groups, content))
    kinds = named.groupBy("kind").agg(*[F.first(c).alias(c) for c in content])

    def make(batches):
        for b in batches:
            for r in b.to_dict("records"):
                yield run(r).assign(kind=r["kind"])

    made = kinds.repartition(DEALT, "kind").mapInPandas(make, f"{schema}, kind string")
    return named.select(*key, "kind").join(made, "kind").drop("kind")
