"""Each operator on small tables: nulls in any column, empty and long texts, ties, repeated rows, empty tables, extra
columns with names that operators use inside; against brute force where there is one."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terrace.llm import chat, fingerprints, jaccard, mixing, notices, registry, topk, toxicity, url_rules

D = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
EXTRA = ", id long, n long, key string, size long, a string, u long"


def table(spark, rows, schema="doc_id long, text string, source string"):
    """Rows with extra columns of clashing names."""
    return spark.createDataFrame([(*r, 1, 2, "k", 3, "x", 4) for r in rows], schema + EXTRA)


def by_id(df, *names):
    return sorted(((r[names[0]] is None, r[names[0]] or 0), *(r[n] for n in names[1:])) for r in df.collect())


# --- exact dedup


def test_fingerprints_combine():
    import numpy as np

    data = np.random.default_rng(1).integers(0, 256, 5000).astype(np.uint8)
    f = lambda x: tuple(fingerprints.fingerprints(x, np.array([0, len(x)]))[0].tolist())
    for cut in (0, 1, 511, 512, 513, 4000, 5000):
        assert fingerprints.combine(f(data[:cut]), f(data[cut:]), 5000 - cut) == f(data)
    p, b = fingerprints.PRIMES[0], fingerprints.BASES[0]
    assert f(data[:700])[0] == sum(int(c) * pow(b, 699 - i, p) for i, c in enumerate(data[:700])) % p


@pytest.mark.parametrize("bits", [30, 1])
def test_exact_groups(spark, bits):
    """bits=1: fingerprints of four bits, which unlike texts share."""
    long = "word  and\tword \n" * 9000
    rows = [(5, "a  b", "s"), (3, "a b", None), (9, "a\n\tb", "s"), (1, None, "s"), (2, "", "s"), (4, " ", "s"), (None, "a b", "s"), (7, long, "s"), (8, SPACE.sub(" ", long), "s"), (3, "a b", "t")]
    rows += [(100 + k, f"t{k % 17}", "s") for k in range(60)]
    got = by_id(fingerprints.exact_groups(table(spark, rows), bits=bits, piece=1000), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    norm = [SPACE.sub(" ", t or "") for _, t, _ in rows]
    want = []
    for (i, _, _), t in zip(rows, norm, strict=True):
        same = [r[0] for r, u in zip(rows, norm, strict=True) if u == t]
        keep = min(x for x in same if x is not None)
        want.append(((i is None, i or 0), keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(want)
    assert fingerprints.exact_groups(table(spark, rows).limit(0)).count() == 0


# --- n-gram join


def shingles(text, n):
    w = SPACE.sub(" ", (text or "").translate({c: c + 32 for c in range(65, 91)})).strip(" ")
    w = w.split(" ") if w else []
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    comp = {i: i for i, _ in rows}
    find = lambda x: x if comp[x] == x else find(comp[x])
    for (i, _), (j, _) in itertools.combinations(rows, 2):
        a, b = sets[[r[0] for r in rows].index(i)], sets[[r[0] for r in rows].index(j)]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = sorted((find(i), find(j)))
            comp[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(rows, sets, strict=True))


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_near_duplicates(spark, n, percent):
    r = random.Random(n)
    words = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "  ")]
    ids = itertools.count(10)
    for size in (5, 8, 12, 30, 80, 200, 600):
        base = [r.choice(words) for _ in range(size)]
        for _ in range(9):
            own = list(base)
            for _ in range(r.randrange(0, 1 + size // 25 + 1)):
                k = r.randrange(len(own))
                own[k : k + r.randrange(2)] = [r.choice(words)]
            rows.append((next(ids), " ".join(own)))
    passage = " ".join(r.choice(words) for _ in range(40))
    rows += [(next(ids), passage + " " + " ".join(r.choice(words) for _ in range(r.randrange(60)))) for _ in range(25)]
    r.shuffle(rows)
    df = spark.createDataFrame([(i, t, 1, "b", 7) for i, t in rows], "doc_id long, text string, chunk int, bucket string, id long")
    for size in (4000, 10**6):
        got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.near_duplicates(df, n=n, percent=percent, chunk_bytes=size).collect())
        assert got == brute_components(rows, n, percent)


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f g"), (None, "x y z"), (2, "a b c d e f g"), (2, "a b c d e f g"), (7, "A b c d e f g")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.near_duplicates(df).collect())
    assert got == [(0, 0), (0, 2), (2, 2), (2, 2), (7, 2)]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


# --- search


def test_search_against_all_scores(spark):
    from math import log1p

    r = random.Random(4)
    words = [f"w{int(r.paretovariate(0.7)) % 200}" for _ in range(400)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randrange(0, 60))), "s") for k in range(0, 900, 3)] + [(1, None, "s"), (2, "W1, w2; W3", None), (6, "w1 w1 w1", "s"), (None, "w1 w2", "s")]
    docs = table(spark, rows)
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for _, t, _ in rows]
    n, total = len(rows), sum(map(len, terms))
    df = {}
    for t in terms:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    want = []
    for (q, _, _), qt in zip(rows, terms, strict=True):
        if q is None or q % 100:
            continue
        scores = []
        for (d, _, _), dt in zip(rows, terms, strict=True):
            s = sum(round(log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * dt.count(w) * 2.2 / (dt.count(w) + 1.2 * (0.25 + 0.75 * len(dt) / (total / n))) * 1e6) for w in set(qt) if w in dt)
            if s:
                scores.append((-s, d is None, d or 0))
        want += [(q, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:10])]
    for size in (2000, 10**7):
        got = topk.search(docs, docs.filter("doc_id % 100 = 0"), shard_bytes=size).collect()
        got = sorted((x.query_id, x.rank, x.doc_id, round(x.score * 1e6)) for x in got)
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert all(abs(g[3] - w[3]) <= 60 for g, w in zip(got, sorted(want), strict=True))
        assert [g[2] for g in got] == [w[2] for w in sorted(want)]
    assert topk.search(docs.limit(0), docs.limit(0)).count() == 0


def test_blocks_are_pruned():
    import numpy as np

    texts = [b"common"] * 4000 + [b"rare common"] * 3
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    _, term, _, _ = topk.terms_of(data, offsets)
    terms, df = np.unique(term, return_counts=True)
    index = topk.Index(np.arange(len(texts)), data, offsets, terms, df.astype(float), len(texts), 4006)
    ids, _, opened = index.search(np.arange(len(terms)), 3)
    assert sorted(ids) == [4000, 4001, 4002] and opened < index.n_blocks / 4


def test_queries_taken_together_find_what_each_finds_alone():
    import numpy as np

    rng = np.random.default_rng(5)
    words = [f"w{int(n)}" for n in range(400)]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 9)), p=np.arange(400, 0, -1) / 80200)).encode() for _ in range(9000)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    doc, term, tf, _ = topk.terms_of(data, offsets)
    terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
    index = topk.Index(np.arange(len(texts))[::-1], data, offsets, terms, df.astype(float), len(texts), sum(len(t.split()) for t in texts))
    asked = [at[doc == d] for d in range(0, 9000, 45)]
    query, ids, scores, _ = index.search_all(np.concatenate(asked), np.cumsum([0] + [len(a) for a in asked]), 10)
    value = np.zeros((len(texts), len(terms)))
    length = np.array([len(t.split()) for t in texts])
    idf = np.log1p((len(texts) - df + 0.5) / (df + 0.5))
    value[doc, at] = np.rint(idf[at] * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / (length.sum() / len(texts))))) * 1e6)
    for q, a in enumerate(asked):
        total = value[:, a].sum(1)[::-1]
        want = np.lexsort((np.arange(len(total)), -total))[:10]
        want = want[total[want] > 0]
        assert ids[query == q].tolist() == want.tolist() and scores[query == q].tolist() == total[want].tolist()


def test_very_long_texts_are_searched_whole(spark):
    docs = table(spark, [(0, "needle hay", "s"), (1, "hay " * 60000 + "needle", "s"), (2, "hay straw", "s")])
    got = {r.doc_id: r.rank for r in topk.search(docs, docs.filter("doc_id = 0")).collect()}
    assert set(got) == {0, 1, 2} and got[0] == 1


# --- notices


def base_columns(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in notices.BASE.items():
        p = phrase.split()
        at = [k for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_notices(spark):
    rows = [
        (1, None, "s"), (2, "", "s"), (3, "All rights\n# reserved. cc-by, CC/BY all", "s"), (4, "GNU Genral Public Licence v3", None), (5, "allrights reserved", "s"), (6, "é cc bye xcc by", "s"),
        (7, "Licensed under the Apache Lisense, Version 2", "s"), (8, "clean text of no interest " * 5000, "s"), (9, "x " * 30000 + "Relesed under the MIT License", "s"), (9, "cc by cc by", "t"), (None, "cc by", "s"),
    ]
    got = notices.scan_notices(table(spark, rows)).collect()
    for (i, t, _), g in zip(rows, got, strict=True):
        assert g.doc_id == i and (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base_columns(t)
        assert set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1
    labels = [g.labels for g in got]
    assert labels[3] == "gpl" and labels[6] == "apache" and labels[7] == "" and labels[8] == "mit" and 0.8 < got[3].score < 1
    (m,) = got[8].matches
    assert (m.start_word, m.end_word, m.edits) == (30000, 30005, 1)
    assert notices.scan_notices(table(spark, rows).limit(0)).count() == 0


def test_seeds_lose_no_match():
    """Every text within the allowed edits of a notice is found."""
    r = random.Random(8)
    for notice, label in notices.NOTICES[:6]:
        for _ in range(40):
            s = list(notice)
            for _ in range(len(notice) // notices.EDIT_EVERY):
                k = r.randrange(1, len(s) - 1)
                s[k : k + r.randrange(2)] = r.choice(["", "q"])
            near = " ".join("".join(s).split())
            assert label in {m[2] for m in notices.search(notices.folded("some words " + near + " and more"))}, near


def test_seeds_lose_no_match_with_long_characters():
    """Edits count characters, however many bytes each has; spans are bytes, also where a window's end is in such a text."""
    t = notices.folded("all rights re\ufffder\ufffded")
    assert notices.search(t) == [(1, len(t) - 1, "reserved", 2, 19)]
    r = random.Random(9)
    for notice, label in notices.NOTICES:
        for _ in range(20):
            s = list(notice)
            for _ in range(len(notice) // notices.EDIT_EVERY):
                k = r.randrange(1, len(s) - 1)
                s[k : k + r.randrange(2)] = r.choice(["\u00ad", "\u00e9", "\ufffd", "\U0001f600"])
            for around in ("some words", "\u00e9\ufffd\U0001f600"):
                before = notices.folded(around)
                t = notices.folded(f"{around} {''.join(s)} {around}")
                own = [m for m in notices.search(t) if m[2] == label]
                assert any(m[0] <= len(before) + 8 and t[m[0] - 1 : m[0]] == t[m[1] : m[1] + 1] == b" " for m in own), s


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def nearest_runs(words):
    """Per label the least share of edits of any run of words that is within the allowed edits of one of its notices."""
    out = {}
    for notice, label in notices.NOTICES:
        n, k = len(notice), len(notice) // notices.EDIT_EVERY
        for i in range(len(words)):
            for j in range(i + 1, len(words) + 1):
                run = " ".join(words[i:j])
                if len(run) > n + k:
                    break
                if len(run) >= n - k and (d := edit_distance(notice, run)) <= k:
                    out[label] = min(out.get(label, 1.0), d / n)
    return out


def test_notices_against_all_runs_of_words():
    r = random.Random(11)
    for turn in range(60):
        notice, _ = notices.NOTICES[turn % len(notices.NOTICES)]
        s = list(notice)
        for _ in range(r.randrange(len(notice) // notices.EDIT_EVERY + 2)):
            k = r.randrange(len(s))
            s[k : k + r.randrange(2)] = r.choice(["", "q", " ", "\u00e9", "\U0001f600", "e"])
        words = f"{r.choice(['', 'one all', 'é rights'])} {''.join(s)} {r.choice(['', 'reserved', 'x public'])}".split()
        want = nearest_runs(words)
        found = notices.search(notices.folded(" ".join(words)))
        assert {m[2] for m in found} == set(want), words
        assert max((1 - m[3] / m[4] for m in found), default=0.0) == pytest.approx(1 - min(want.values(), default=1.0)), words
        for a, b, label, edits, n in found:
            run = notices.folded(" ".join(words))[a:b].decode()
            assert any(edit_distance(x, run) == edits for x, y in notices.NOTICES if y == label and len(x) == n)


def test_notice_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    for g in notices.op3_license_scan(spark, D).collect():
        assert (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) == base_columns(texts[g.doc_id])


# --- toxicity


def test_grammar():
    m = toxicity.Model()
    score = lambda t: sum(s for _, s in m.clauses(t))
    assert score("you idiot") > score("idiot") > score("she said idiot") > 0
    assert score("idiot") > score("not an idiot") and score("not a word of it all, idiot") == score("x, idiot")
    assert score("nothing here. all fine") == 0 and m.clauses("") == []
    assert score("I kill you") > score("kill the process") > score("never kill it") and score("kill you") > score("she said kill you") and score("kill you") > score("kill it")


def plain_clause(model, clause):
    """A clause's score by the rules, word by word."""
    total, insulted, target, waiting, scope, reported = 0.0, False, False, False, 0, False
    for word in toxicity.WORD.findall(clause):
        kind, weight = model.read(word)
        damp = (0.3 if scope else 1.0) * (0.5 if reported else 1.0)
        if kind == "insult":
            total += weight * damp * (1.1 if insulted else 1.0) * (1.2 if target else 1.0)
            insulted = True
        elif kind == "threat":
            total += weight * damp * (1.0 if target and not waiting else 0.4)
            waiting = waiting or not target
        elif kind == "target":
            if waiting:
                total += 0.6 * damp
            waiting, target = False, True
        reported = reported or kind == "report"
        scope = 3 if kind == "negation" else max(0, scope - 1)
    return total


def test_grammar_against_plain_rules(spark):
    import random

    m, r = toxicity.Model(), random.Random(4)
    words = "idiot stupid kill hurt you they not never said wrote the process fine . ! no".split()
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(25))) for _ in range(800)]
    texts += [d.text or "" for d in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    for t in texts:
        want = [s for s in (plain_clause(m, c) for c in toxicity.CLAUSE.split(t.lower())) if s]
        assert [s for _, s in m.clauses(t)] == pytest.approx(want)
        z = m.curve[0] + m.curve[1] * math.log1p(sum(want)) + m.curve[2] * math.log1p(max(want, default=0)) + m.curve[3] * math.log1p(500 * sum(want) / (20 + len(t)))
        assert m.score(t) == pytest.approx(1 / (1 + math.exp(-z)))


def test_counts_that_are_learned_from(spark):
    """Words and beginnings as tasks count them, against counting in one place."""
    rows = [(k, f"Wort{k % 7} idiot{k % 2} common Ünïted x{k}", int(k % 3 == 0)) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, mark int").repartition(5).select("text", "mark")
    known = frozenset({"common"})
    for features in (toxicity.word_set, lambda t: toxicity.beginnings(toxicity.word_set(t), known)):
        want = {}
        for _, t, m in rows:
            for f in features(t):
                want.setdefault(f, [0, 0])[1 - m] += 1
        assert toxicity._counted(df, features) == sorted((f, a, b) for f, (a, b) in want.items() if a >= toxicity.LEAST_ROWS)


def test_toxicity_rows(spark):
    docs = table(spark, [(1, None, "s"), (2, "", "s"), (3, "you idiot, you stupid idiot", "s"), (3, "fine words", "t"), (None, "fine " * 50000, None)])
    labels = spark.createDataFrame([(1, None, 0), (3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.learned(docs, labels)
    got = toxicity.score_documents(docs, model).collect()
    assert [g.predicted for g in got] == [0, 0, 1, 0, 0] and all(0 <= g.score <= 1 for g in got)
    assert [g.held_out for g in got] == [zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2 for i in (1, 2, 3, 3, None)]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == 4
    assert toxicity.score_documents(docs.limit(0), toxicity.learned(docs.limit(0), labels.limit(0))).count() == 0


def test_matching_clauses_are_counted_at_every_score(spark):
    """Also of documents far below the threshold."""
    model = toxicity.Model(curve=(-20.0, 1.5, 0.5, 0.5))
    docs = table(spark, [(1, "you idiot. fine words. kill it!", "s"), (2, "fine words", "s"), (3, None, "s")])
    got = toxicity.score_documents(docs, model).collect()
    assert [(g.predicted, g.n_clauses) for g in got] == [(0, 2), (0, 0), (0, 0)]
    assert [g.score for g in got] == [model.score(t) for t in ("you idiot. fine words. kill it!", "fine words", "")]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out and toxic is not null")
    rows = [(g.score, g.predicted, g.toxic) for g in got.collect()]
    hit = sum(p and t for _, p, t in rows)
    assert hit >= 0.85 * sum(t for *_, t in rows) and hit >= 0.9 * sum(p for _, p, _ in rows)
    pos, neg = [s for s, _, t in rows if t], [s for s, _, t in rows if not t]
    assert sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg) > 0.95


# --- URLs


def test_url_rules(spark):
    rows = [
        (1, "https://WWW.Example.org/es/x?y#z", "example.org/es/", "block"), (2, "http://example.org/en/17", "example.org/en/1", "block"), (3, "http://notexample.org/es/1", "org/", "allow"),
        (4, "http://a.com/de", None, "allow"), (5, "http://a.com/de/", "com/de/", "block"), (6, "http://example.org", None, "allow"), (7, None, None, "allow"), (8, "no scheme", None, "allow"),
        (9, "http://www.cheap-pills.net/", None, "block"), (10, "x://org/", "org/", "allow"), (11, "http://cheap-pills.com/fr/1", "com/fr/", "allow"), (11, "http://cheap-pills.com/fr/1", "com/fr/", "allow"), (None, "://", None, "allow"),
    ]
    df = spark.createDataFrame([(i, u, "h", 1, "p") for i, u, *_ in rows], "page_id long, url string, host string, key int, path string")
    long = "http://Long.Example.ORG/en/1" + "/x" * 200_000
    df = df.unionByName(spark.createDataFrame([(12, long, "h", 1, "p")], df.schema))
    rows.append((12, long, "example.org/en/1", "block"))
    got = url_rules.judge_urls(df, url_rules.STATED + url_rules.OWN).collect()
    assert [(g.page_id, g.rule, g.verdict) for g in got] == [(i, r, v) for i, _, r, v in rows]
    assert got[0].host == "www.example.org" and got[0].path == "/es/x" and url_rules.judge_urls(df.limit(0), url_rules.STATED).count() == 0
    joined = url_rules.judge_urls(df, url_rules.STATED + url_rules.OWN, in_plan=3).collect()
    assert sorted(map(tuple, joined), key=str) == sorted(map(tuple, got), key=str)
    shouted = [url_rules.prefix_rule("Example.ORG/en/1", "block")]
    assert url_rules.judge_urls(df.filter("page_id in (2, 12)"), shouted).filter("verdict = 'block'").count() == 2
    # only rules whose rarest token the URL has are run
    many = [url_rules.prefix_rule(f"host{k}.com/", "block") for k in range(200)]
    assert url_rules.judge_urls(spark.createDataFrame([(1, "http://host7.com/a")], "page_id long, url string"), many).first().n_candidates == 1
    plan = url_rules.op7_url_filters(spark, D)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_urls_against_the_contract(spark):
    """Every page, judged by a plain reading of the contract."""
    stated = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    d = D.replace("sf0.001", "sf0.1")
    got = {r.page_id: r for r in url_rules.op7_url_filters(spark, d).collect()}
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    assert len(got) == len(pages)
    met = set()
    for p in pages:
        rest = (p.url or "").partition("://")[2]
        bare = re.split(r"[?#]", rest)[0]
        host, slash, path = bare.partition("/")
        host, path = host.lower(), slash + path
        best = None
        for name in stated:
            h, s, start = name.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith(s + start) and (best is None or len(name) > len(best)):
                best = name
        g = got[p.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best)
        if best is not None:
            assert g.verdict == stated[best]
            met.add(best)
    assert met == set(stated)


# --- mixing


def test_mix(spark):
    rows = [(k, "w " * (k % 40), f"s{k % 3}") for k in range(400)] + [(1000, None, None), (1001, "a b", None), (None, "x y z", "s0"), (3, "w w w", "s0"), (3, "w w w", "s0"), (1002, "only", "tiny"), (1003, "w " * 5000, "s1")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(table(spark, rows)).collect()), key=str)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
        free -= over
        left = sum(size.values()) - sum(target.values())
    taken = {}
    of = {i: s for i, _, s in rows}
    for g in got:
        s = of[g.doc_id]
        assert g.target == pytest.approx(target[s]) and g.source_size == size[s] and 0 <= g.taken <= 3 * g.size
        assert g.taken == g.epochs * g.size + g.extra
        taken[s] = taken.get(s, 0) + g.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert mixing.mix(table(spark, rows).limit(0)).count() == 0


def test_repeated_documents_are_what_the_mix_takes(spark):
    rows = [(k, " ".join(f"w{j}" for j in range(k % 30)), f"s{k % 4}") for k in range(200)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, n_chars long")
    out = mixing.repeated(docs).collect()
    words = {}
    for o in out:
        words[o.doc_id] = words.get(o.doc_id, 0) + len(o.text.split())
        assert o.n_chars == len(o.text)
    assert {k: n for k, n in words.items() if n} == {g.doc_id: g.taken for g in mixing.mix(docs).collect() if g.taken}


# --- chat


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "", None, "\\l \\b \\\\ <# #<", "### user\nx</turn>\n", "é\n\n</turn", "long " * 20000]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(texts)] + [(2, None, None, "a"), (2, 0, "###\nodd", "b"), (None, 1, "assistant", "c"), (2, 0, "###\nodd", "b")]
    df = spark.createDataFrame([(*r, "t", "x") for r in rows], "conv_id long, turn long, role string, text string, turns string, formatted string")
    done = chat.format_conversations(df)
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert back[1] == [("assistant" if k % 2 else "user", t or "") for k, t in enumerate(texts)]
    assert back[2] == [("", "a"), ("###\nodd", "b"), ("###\nodd", "b")] and back[None] == [("assistant", "c")]
    for r in done.collect():
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        assert all("<" not in s and "#" not in s for s in spans)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        ('{"prompt": "p", "completion": "c"}', "prompt_completion"), ('{"completion": null, "prompt": "p"}', "prompt_completion"), ('{"instruction": "i", "input": "", "output": "o"}', "instruction_input"),
        ('{"messages": [{"role": "user", "content": "m"}, {"role": "assistant", "content": "n"}]}', "messages"), ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}', "conversations"),
        ('{"strange": 1}', "unknown"),
    ]
    df = spark.createDataFrame([(k, j) for k, (j, _) in enumerate(records)], "k int, j string").withColumn("v", F.parse_json("j"))
    got = chat.canonical_turns(df, "v").orderBy("k").collect()
    assert [g.layout for g in got] == [x for _, x in records]
    turns = [[(t.role, t.text) for t in g.turns] if g.turns else None for g in got]
    assert turns[0] == [("user", "p"), ("assistant", "c")] and turns[2] == [("user", "i"), ("assistant", "o")]
    assert turns[3] == [("user", "m"), ("assistant", "n")] and turns[4] == [("user", "h"), ("assistant", "g")] and turns[5] is None
    assert "Python" not in chat.op10_chat_formatting(spark, D)._jdf.queryExecution().toString()


def test_records_of_several_layouts_in_one_table(spark):
    records = [
        (1, 0, '{"messages": [{"role": "user", "content": "m", "name": "x"}, {"role": "bot", "content": null}], "id": 7}'), (1, 1, '{"prompt": "p", "completion": "c", "id": 3, "score": 0.5}'),
        (2, 0, '{"conversations": [{"from": "Human", "value": "h", "weight": 1}, {"from": "gpt", "value": "g"}], "source": "s"}'), (3, 0, '{"strange": 1, "messages": 5}'), (3, 1, "[1, 2]"), (4, 0, None),
        (5, 0, '{"strange": 1}'), (5, 1, '{"question": "q", "answer": "a", "": {"b c": 1}}'), (None, 0, '{"messages": []}'),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in records], "conv_id long, turn long, j string, at int, items string").withColumn("record", F.parse_json("j"))
    done = chat.format_records(df).select("conv_id", "n_unknown", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back"))
    got = {r.conv_id: (r.n_unknown, [(t.role, t.text) for t in r.back] if r.formatted is not None else None, [r.formatted[s.start : s.end] for s in r.loss_spans] if r.formatted else []) for r in done.collect()}
    assert got[1] == (0, [("user", "m"), ("bot", ""), ("user", "p"), ("assistant", "c")], ["c"])
    assert got[2] == (0, [("user", "h"), ("assistant", "g")], ["g"])
    assert got[3] == (2, None, []) and got[4] == (1, None, []) and got[5] == (1, [("user", "q"), ("assistant", "a")], ["a"]) and got[None][1] is None
    rows = spark.createDataFrame([(1, 0, "Human", "x"), (1, 1, "gpt", "y")], "conv_id long, turn long, role string, text string")
    ((formatted, spans),) = chat.format_conversations(rows).select("formatted", "loss_spans").collect()
    assert formatted == "### Human\nx</turn>\n### gpt\ny</turn>\n" and spans == []


# --- queries with SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, D)
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    rows = lambda x: sorted(map(repr, x))
    assert rows(tuple(r[n] for n in names) for r in got.collect()) == rows(want.select(*names).fetchall())
