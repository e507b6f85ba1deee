import hashlib
import random

import numpy as np
import pytest

from terrace.llm import suffixes as S


def brute(rows, length):
    """(id, text) rows to {row number: (n_bytes, n_removed, n_spans, sha)}."""
    texts = [(t or "").encode() for _, t in rows]
    key = [(i is None, i or 0) for i, _ in rows]
    least = {}
    for k, t in zip(key, texts, strict=True):
        for q in range(len(t) - length + 1):
            w = t[q : q + length]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, t in zip(key, texts, strict=True):
        gone = [False] * len(t)
        for q in range(len(t) - length + 1):
            if least[t[q : q + length]] < k:
                gone[q : q + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(frame):
    return sorted(((r.doc_id is None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in frame.collect())


@pytest.mark.parametrize("seed", range(12))
def test_suffix_array_and_prefixes(seed):
    r = np.random.default_rng(seed)
    t = r.integers(0, 1 + seed % 5, r.integers(1, 400)).astype(np.uint8) + np.uint8(seed % 3)
    if seed % 2:
        t = np.concatenate([t, t, np.zeros(seed, np.uint8), t])
    depth, raw = 50, t.tobytes() + bytes(200)
    sa = S.suffix_array(t, depth)
    assert sorted(sa) == list(range(len(t)))
    keys = [raw[i : i + depth] for i in sa]
    assert keys == sorted(keys)
    lcp = S.common_prefixes(sa, S.words_at(t, depth), depth)
    for i in range(1, len(sa)):
        a, b = keys[i - 1], keys[i]
        assert lcp[i] == next((k for k in range(depth) if a[k] != b[k]), depth)


def test_small_table_against_brute_force(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(120))
    rows = [(7, passage), (3, "x" + passage + "y"), (9, passage[10:90] + passage[:70]), (1, None), (2, ""), (4, "a" * 500), (5, "a" * 300), (6, "é" * 80), (8, "é" * 70)]
    rows += [(None, passage), (7, passage), (20, "zz" * 40 + passage[5:60] + "long " * 3000), (21, "long " * 3000)]
    rows += [(100 + i, "".join(r.choice(["the ", "and ", passage[20:75], passage[40:100], "q"]) for _ in range(r.randrange(12)))) for i in range(60)]
    docs = spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], "doc_id long, text string, id int, chunk int, bucket string")
    for size in (2000, 10**6):
        assert got(S.repeated_spans(docs, chunk_bytes=size)) == brute(rows, 50)
    assert S.repeated_spans(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert got(S.op1_suffix_dedup(spark, d)) == brute(rows, 50)


def chunk_runs(texts, length, gram, ids=None):
    """A chunk's runs, as a shard gets them, and the documents they are of."""
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return S.Runs(np.arange(len(texts)) if ids is None else np.asarray(ids), data, np.append(0, ends), length, gram)


def least_of(chunks, length, gram):
    """What a shard that gets all runs finds, and the windows' bytes and owners."""
    stretches = [c.data[s : s + n + length - 1] for c in chunks for s, n in zip(c.start, c.windows, strict=True)]
    windows = np.concatenate([c.windows for c in chunks])
    owners = np.concatenate([c.ids[c.doc] for c in chunks])
    found = S.least_owners(np.concatenate(stretches), windows, owners, np.concatenate([c.place for c in chunks]), length, gram)
    strings = [x[q : q + length].tobytes() for x, n in zip(stretches, windows, strict=True) for q in range(n)]
    return found, strings, np.repeat(owners, windows)


@pytest.mark.parametrize("length, gram, chance", [(50, 24, False), (50, 24, True), (12, 5, False), (12, 5, True), (20, 20, False), (33, 11, False)])
def test_least_owners_against_brute_force(monkeypatch, length, gram, chance):
    if chance:  # hashes that meet by chance cost time, not results
        monkeypatch.setattr(S, "_row_hashes", lambda rows: rows[:, 0] % np.uint64(3))
    monkeypatch.setattr(S, "ARRAY", 2000)
    r = random.Random(length + gram)
    passage = "".join(r.choice("abcdefgh ") for _ in range(150))
    texts = ["".join(r.choice(["the ", "and ", passage[20:95], passage[40:130], "q", "\0", "é" * 30]) for _ in range(r.randrange(14))) for _ in range(60)]
    chunks = [chunk_runs(texts[k::3], length, gram, range(k, 60, 3)) for k in range(3)]
    found, strings, owners = least_of(chunks, length, gram)
    least = {}
    for s, o in zip(strings, owners.tolist(), strict=True):
        least[s] = min(least.get(s, o), o)
    assert found.tolist() == [least[s] for s in strings]


def test_copies_are_sorted_once(monkeypatch):
    r = random.Random(3)
    text = "".join(r.choice("abcdefgh ") for _ in range(3000))
    sorted_bytes = []
    plain = S.least_owner
    monkeypatch.setattr(S, "least_owner", lambda t, *rest: sorted_bytes.append(len(t)) or plain(t, *rest))
    tails = [text[:1500] + c + "".join(r.choice("abcdefgh ") for _ in range(200)) for c in "xy"]
    chunks = [chunk_runs([t], 50, 24, [k]) for k, t in enumerate([text] * 20 + [tails[0]] * 20 + [tails[1]] * 20)]
    found, strings, owners = least_of(chunks, 50, 24)
    assert found[owners == 19].max() == 0 and sorted(set(found[owners == 59].tolist())) == [0, 40]
    # only the runs at the places where the three texts part
    assert 0 < sum(sorted_bytes) < 1500


def test_keys_fall_into_all_buckets_alike():
    r = random.Random(4)
    runs = chunk_runs(["".join(r.choice("abcdefgh ") for _ in range(5000)) for _ in range(20)], 50, 24)
    shares = np.bincount((runs.key >> np.uint64(60)).astype(np.int64), minlength=16) / len(runs.key)
    assert 0.03 < shares.min() and shares.max() < 0.1
