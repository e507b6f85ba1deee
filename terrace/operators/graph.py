"""Graph operators on edge tables: depths, elevations along containment forests, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edges up to which components are finished in one task.
FEW = 1_000_000


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the cluster's checkpoint folder; where none is named, in a folder of the warehouse, which all share."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
    return df.checkpoint()


def numbered(df: DataFrame, order: list[Column], name: str = "k") -> DataFrame:
    """Rows numbered from 0 in an order that tells all apart, without one task for all: sorted in ranges, counted by range."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    rows = checkpointed(sorted_.withColumns({"part": F.shiftrightunsigned("at", 33), "at": F.col("at").bitwiseAND((1 << 33) - 1)}))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    # one row a range
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    return rows.join(F.broadcast(starts), "part").withColumn(name, F.col("start") + F.col("at")).drop("part", "at", "start")


def depths(parents: DataFrame, key: str = "project") -> DataFrame:
    """(key, child, parent) of a forest to (key, id, depth), roots at 0: pointer doubling, so log2(depth) rounds."""
    parents = checkpointed(parents)
    kids = parents.select(key, F.col("child").alias("id"), F.col("parent").alias("up"), F.lit(1).alias("depth"))
    tops = parents.select(key, F.col("parent").alias("id")).distinct().join(kids.select(key, "id"), [key, "id"], "left_anti")
    state = checkpointed(kids.unionByName(tops.select(key, "id", F.lit(None).cast(kids.schema["up"].dataType).alias("up"), F.lit(0).alias("depth"))))
    while not state.filter("up is not null").isEmpty():
        far = state.select(key, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = checkpointed(state.join(far, [key, "up"], "left").select(key, "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")))
    return state.select(key, "id", "depth")


def assign_elevations(nodes: DataFrame, parents: DataFrame, base: int, changes: list[int], interval: float = 1.0, key: str = "project") -> DataFrame:
    """Elevations along the forest from a base node: a child is one step up, a parent one step down; the step flips at
    the nodes in ``changes`` (not the base) and stays so beyond. Unreachable nodes have null.

    The tree is hung up at the base: the base's ancestors point to their child on the way to it, all others to their
    parent. Each node knows how the stretch from the node it points to changes the height and the sign; stretches compose,
    so pointers are doubled, and depth takes log2(depth) rounds."""
    chain = checkpointed(nodes.filter(F.col("id") == base).select(key, "id").distinct())
    tree = parents.select(key, F.col("child").alias("id"), F.col("parent").alias("up"))
    tree = jump = checkpointed(tree.join(chain.select(key), key, "left_semi"))  # other projects don't have the base
    while True:
        more = chain.join(jump, [key, "id"]).select(key, F.col("up").alias("id")).join(chain, [key, "id"], "left_anti").distinct()
        more = checkpointed(more)
        if more.isEmpty():
            break
        chain = checkpointed(chain.unionByName(more))
        on = jump.select(key, F.col("id").alias("up"), F.col("up").alias("beyond"))
        jump = checkpointed(jump.join(on, [key, "up"]).select(key, "id", F.col("beyond").alias("up")))
    down = tree.join(chain, [key, "id"], "left_anti").withColumn("way", F.lit(1.0))
    up = tree.join(chain, [key, "id"]).select(key, F.col("up").alias("id"), F.col("id").alias("up"), F.lit(-1.0).alias("way"))
    turn = F.when(F.col("id").isin(changes), -1.0).otherwise(1.0) if changes else F.lit(1.0)
    steps = down.unionByName(up).select(key, "id", "up", (F.col("way") * turn).alias("rise"), turn.alias("sign"), F.lit(False).alias("hit"))
    ends = nodes.select(key, "id").distinct().join(steps.select(key, "id"), [key, "id"], "left_anti")
    ends = ends.select(key, "id", F.lit(None).cast(steps.schema["up"].dataType).alias("up"), F.lit(0.0).alias("rise"), F.lit(1.0).alias("sign"), (F.col("id") == base).alias("hit"))
    state = checkpointed(steps.unionByName(ends))
    while not state.filter("up is not null").isEmpty():
        on = state.select(key, F.col("id").alias("up"), F.col("up").alias("up2"), F.col("rise").alias("rise2"), F.col("sign").alias("sign2"), F.col("hit").alias("hit2"))
        joined = state.join(on, [key, "up"], "left")
        far = F.col("up2").isNotNull() | F.col("hit2").isNotNull()
        state = checkpointed(joined.select(
            key, "id", F.col("up2").alias("up"), F.when(far, F.col("rise2") + F.col("sign2") * F.col("rise")).otherwise(F.col("rise")).alias("rise"),
            F.when(far, F.col("sign2") * F.col("sign")).otherwise(F.col("sign")).alias("sign"), F.coalesce(F.col("hit2"), F.col("hit")).alias("hit"),
        ))
    return nodes.select(key, "id").join(state.filter("hit").select(key, "id", (F.col("rise") * interval).alias("elevation")), [key, "id"], "left")


def least_reached(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Of each of n nodes the least one that edges lead to: roots hook to lesser ones, pointers are doubled."""
    label = np.arange(n)
    while True:
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v = u[open_], v[open_]
        np.minimum.at(label, np.maximum(a, b)[open_], np.minimum(a, b)[open_])
        while not np.array_equal(up := label[label], label):
            label = up


def _least_of_all(e: DataFrame, key: str) -> DataFrame:
    """Nodes of few edges with the least one of their component: key, node, to; one task."""

    def run(batches):
        got = [b for b in batches if len(b)]
        if not got:
            return
        pdf = pd.concat(got, ignore_index=True)
        ends = pd.concat([pdf[[key, c]].set_axis([key, "node"], axis=1) for c in "uv"], ignore_index=True).sort_values([key, "node"], kind="stable")
        number = ends.groupby([key, "node"], dropna=False, sort=False).ngroup().sort_index().to_numpy()
        nodes = ends.assign(k=number[ends.index]).drop_duplicates("k")  # numbered in order, so the least number is the least id
        label = least_reached(number[: len(pdf)], number[len(pdf) :], len(nodes))
        yield nodes[[key, "node"]].assign(to=nodes["node"].to_numpy()[label])

    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    # a key goes as text, as numbers with nulls among them would go as floats
    found = e.withColumn(key, F.col(key).cast("string")).coalesce(1).mapInPandas(run, f"`{key}` string, node {kind['u']}, to {kind['u']}")
    return found.withColumn(key, F.col(key).cast(kind[key]))


def components(edges: DataFrame, key: str = "project", few: int = 0) -> DataFrame:
    """Connected components of (key, u, v): (key, id, component), component the least id. Nodes hook to their least
    neighbour and edges contract; after the first round, which is enough for stars, pointers are doubled three times
    before, so a chain shrinks to an eighth. Edges of a null key are a project of their own. Once no more than ``few`` edges
    are left, one task finishes them (ids are numbers or strings then)."""
    e = checkpointed(edges.filter("u <> v").select(key, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())

    def joined(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
        """Null-safe in the key; the right side's columns of the join go."""
        other = right.withColumnsRenamed({key: "other_key", on: "other_on"})
        return left.join(other, F.col(key).eqNullSafe(F.col("other_key")) & (F.col(on) == F.col("other_on")), how).drop("other_key", "other_on")

    label = checkpointed(e.select(key, F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("component", F.col("id")))
    first = True
    while not e.isEmpty():
        if few and e.count() <= few:
            last = _least_of_all(e, key).withColumnRenamed("node", "component")
            return joined(label, last, "component", "left").select(key, "id", F.coalesce("to", "component").alias("component"))
        both = e.unionByName(e.select(key, F.col("v").alias("u"), F.col("u").alias("v")))
        hook = checkpointed(both.groupBy(key, F.col("u").alias("node")).agg(F.min("v").alias("m")).select(key, "node", F.least("m", "node").alias("to")))
        for _ in range(0 if first else 3):
            on = hook.select(key, F.col("node").alias("to"), F.col("to").alias("beyond"))
            hook = checkpointed(joined(hook, on, "to").select(key, "node", F.col("beyond").alias("to")))
        first = False
        label = checkpointed(joined(label, hook.withColumnRenamed("node", "component"), "component", "left").select(key, "id", F.coalesce("to", "component").alias("component")))
        moved = joined(joined(e, hook.select(key, F.col("node").alias("u"), F.col("to").alias("a")), "u"), hook.select(key, F.col("node").alias("v"), F.col("to").alias("b")), "v")
        e = checkpointed(moved.filter("a <> b").select(key, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    return label
