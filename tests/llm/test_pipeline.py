"""The pipeline stage by stage, against brute force on what each stage got."""

import hashlib

import corpus_pipeline
import sentencepiece

from terrace.llm import mixing, pieces, toxicity
from test_operators import SPACE, D, brute_components


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    model = toxicity.learned(docs, spark.read.parquet(f"{D}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = spark.createDataFrame(stage(spark, docs, D).collect(), None) if name == "encoding" else spark.createDataFrame(stage(spark, docs, D).collect(), docs.schema)
        after = docs.collect()
        ids = sorted(r.doc_id for r in after)
        if name != "encoding":
            assert docs.columns == columns
        if name == "toxicity":
            assert ids == sorted(r.doc_id for r in before if model.score(r.text or "") < toxicity.THRESHOLD)
        elif name == "exact_dedup":
            least = {}
            for r in before:
                t = SPACE.sub(" ", r.text or "")
                least[t] = min(least.get(t, r.doc_id), r.doc_id)
            assert ids == sorted(least.values())
        elif name == "near_dedup":
            assert ids == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in before], 5, 80)})
        elif name == "mixing":
            size = {}
            for r in before:
                size[r.source] = size.get(r.source, 0) + len((r.text or "").split())
            assert set(ids) <= {r.doc_id for r in before}
            assert abs(sum(len(r.text.split()) for r in after) - sum(size.values())) <= len(size)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
            want = sorted((r.doc_id, hashlib.sha256(" ".join(map(str, sp.encode(r.text or "", add_eos=True))).encode()).hexdigest()) for r in before)
            assert sorted((r.doc_id, r.ids_sha256) for r in after) == want
    assert corpus_pipeline.run(spark, D).count() == len(after)


def test_verdicts_are_on_rows(spark):
    """Null and repeated ids: each text's first row stays, and no other row passes by that row's id."""
    near = [f"w{k}" for k in range(60)]
    a, b = " ".join(near), " ".join([*near[:59], "other"])
    rows = [
        (None, "x y"), (None, "x  y"), (None, "alone"), (None, "has an id"), (4, "has an id"), (None, None), (None, ""),  # exact copies among null ids, and of a row with an id
        (7, "kept"), (7, "dropped"), (3, "dropped"), (7, "kept"),  # one id, a text that stays and one that goes; a repeated row
        (None, a), (None, b), (None, " ".join(f"v{k}" for k in range(60))), (9, " ".join(f"v{k}" for k in range(59)) + " u"), (2, "apart"), (2, a + " more"),
    ]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    exact = corpus_pipeline.exact_dedup(spark, docs, D)
    assert exact.columns == docs.columns
    got = sorted((r.doc_id or 0, SPACE.sub(" ", r.text or "")) for r in exact.collect())
    assert got == sorted([(0, "x y"), (0, "alone"), (4, "has an id"), (0, ""), (7, "kept"), (3, "dropped"), *((i or 0, t) for i, t in rows[11:])])
    left = corpus_pipeline.near_dedup(spark, exact, D)
    assert left.columns == docs.columns
    got = sorted((r.doc_id or 0, SPACE.sub(" ", r.text or "")) for r in left.collect())
    assert got == sorted([(0, "x y"), (0, "alone"), (4, "has an id"), (0, ""), (7, "kept"), (3, "dropped"), (9, rows[14][1]), (2, "apart"), (2, a + " more")])


def test_mixing_meets_targets_with_null_and_repeated_ids(spark):
    rows = [(None if k % 3 == 0 else k % 7, " ".join(f"w{j}" for j in range(k % 23)), f"s{k % 4}") for k in range(300)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    target = {g.source: g.target for g in mixing.targets(mixing.sized(docs, "doc_id", "text", "source").groupBy("source").agg({"size": "sum"}).withColumnRenamed("sum(size)", "source_size")).collect()}
    words = {}
    out = corpus_pipeline.mixing(spark, docs, D)
    assert out.columns == docs.columns
    for r in out.collect():
        words[r.source] = words.get(r.source, 0) + len(r.text.split())
    assert all(abs(words.get(s, 0) - t) <= 1 for s, t in target.items()), (words, target)


def _after(task) -> tuple[int, int]:
    """MB of a new process once it has done a task, and its most."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import re, sys
sys.path.insert(0, {str(Path(corpus_pipeline.__file__).parent)!r})
import numpy as np, pyarrow as pa
from terrace.llm import jaccard
from terrace.llm.common import lean
text = pa.array([" ".join(f"w{{(i * 7919 + k) % 50021}}" for k in range(300)) for i in range(5000)])
batch = pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int64()), text, pa.array([0] * 5000, pa.int32())], names=["id", "text", "chunk"])
at = lambda: sum(map(int, re.findall(r"\\nVmRSS:\\s+(\\d+)", open("/proc/self/status").read()))) // 1024
before = at()
{task}
most = int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024
print(at() - before, most - before)
"""
    return tuple(map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split()))


def test_workers_keep_little():
    """Sizes of 9 MB of text: slices are small, one table of powers is kept a base, and the rest is given back."""
    kept, most = _after("for _ in lean(jaccard._sizes(5))(iter([batch])): pass")
    assert kept < 30 and most < 110, (kept, most)
