import random
from collections import deque

from pyspark.sql import functions as F

from terrace.operators import graph


def test_components_of_chains_and_stars(spark):
    r = random.Random(2)
    ids = list(range(120))
    r.shuffle(ids)
    edges = [(0, k, k + 1) for k in range(40)] + [(0, ids[k], ids[k + 1]) for k in range(60, 90)] + [(1, 500, 500 + k) for k in range(1, 20)]
    comp = {}
    find = lambda x: x if comp.setdefault(x, x) == x else find(comp[x])
    for p, u, v in edges:
        a, b = sorted((find((p, u)), find((p, v))))
        comp[b] = a
    got = graph.components(spark.createDataFrame(edges, "project int, u long, v long")).collect()
    assert sorted((g.project, g.id, g.component) for g in got) == sorted((*x, find(x)[1]) for x in list(comp))


def test_few_edges_are_finished_in_one_task(spark, monkeypatch):
    r = random.Random(4)
    rows = [(p, str(u), str(r.randrange(max(0, u - 3), u))) for p in (None, 1, 2) for u in range(1, 80) if u % 11]
    frame = spark.createDataFrame(rows, "project int, u string, v string")
    seen, whole = [], graph.checkpointed
    want = sorted(graph.components(frame).collect(), key=repr)
    monkeypatch.setattr(graph, "checkpointed", lambda df: seen.append(1) or whole(df))
    assert sorted(graph.components(frame, few=1000).collect(), key=repr) == want and len(seen) == 2
    assert sorted(graph.components(frame, few=100).collect(), key=repr) == want and len(seen) > 4


def test_components_of_a_null_project(spark):
    edges = [(None, 1, 2), (None, 3, 2), (None, 9, 8), (0, 2, 7)] + [(None, k, k + 1) for k in range(20, 40)]
    want = sorted([(-1, 1, 1), (-1, 2, 1), (-1, 3, 1), (-1, 8, 8), (-1, 9, 8), (0, 2, 2), (0, 7, 2)] + [(-1, k, 20) for k in range(20, 41)])
    got = graph.components(spark.createDataFrame(edges, "project int, u long, v long")).collect()
    assert sorted((-1 if g.project is None else g.project, g.id, g.component) for g in got) == want


def test_elevations_from_a_base_within_a_tree(spark):
    r = random.Random(6)
    up = {k: r.randrange(max(0, k - 4), k) for k in range(1, 60)}
    up |= {k: k - 1 for k in range(60, 75)} | {101: 100}
    base, changes = 70, {62, 5, 31}
    edges = {}
    for c, p in up.items():
        edges.setdefault(c, []).append((p, -1))
        edges.setdefault(p, []).append((c, 1))
    want, todo = {base: (0.0, 1)}, deque([base])
    while todo:
        u = todo.popleft()
        for v, way in edges[u]:
            if v not in want:
                sign = want[u][1] * (-1 if v in changes else 1)
                want[v] = (want[u][0] + way * sign * 0.5, sign)
                todo.append(v)
    ids = [*range(75), 100, 101, 200]
    nodes = spark.createDataFrame([(p, k) for p in (1, 2) for k in ids if (p, k) != (2, base)], "project int, id long")
    parents = spark.createDataFrame([(p, c, u) for p in (1, 2) for c, u in up.items()], "project int, child long, parent long")
    got = {(r.project, r.id): r.elevation for r in graph.assign_elevations(nodes, parents, base, sorted(changes), 0.5).collect()}
    assert got == {(p, k): want[k][0] if p == 1 and k in want else None for p in (1, 2) for k in ids if (p, k) != (2, base)}


def test_rows_are_numbered_across_partitions(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v")).repartition(7)
    assert [(r.v, r.k) for r in graph.numbered(rows, [F.col("v")]).orderBy("v").collect()] == [(k, k) for k in range(1000)]
    assert graph.numbered(rows.limit(0), [F.col("v")]).count() == 0
