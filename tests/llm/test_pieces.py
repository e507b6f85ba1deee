import hashlib
import random
import struct

import pytest
import sentencepiece

from terrace.llm import pieces as P

ODD = ["", " ", "  ", "▁", "▁a", "a▁ b", " a", "a  b   c ", "\n\n x\t y", "日本語 テスト", "😀 😀😀", "áé", "1234 5 67", "x" * 5000, "a b" * 3000, "\u0000 z", "<s> </s> <0x41>", "ﬁ Å"]


@pytest.fixture(scope="module")
def model():
    return P.default_model()


def test_ids_equal_the_librarys(model):
    p, sp = P.Pieces(model), sentencepiece.SentencePieceProcessor(model_file=model)
    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["the", "ing", " ", "  ", "▁", "é", "ß", "\n", "7", "😀", ".", "Xy"]) for _ in range(r.randrange(60))) for _ in range(400)]
    for t, (ids, b, e) in zip(texts, p.encode(texts), strict=True):
        assert ids == sp.encode(t), t
        assert len(b) == len(e) == len(ids)
        raw = t.encode()
        slow = p._mapped(raw)
        normal, begin, end = p.normalise(t)
        assert normal == (P.BAR + slow[0] if t else "") and (not t or (begin.tolist()[1:], end.tolist()[1:]) == (slow[1].tolist(), slow[2].tolist()))


def test_spans_tile_the_text_and_name_the_pieces(model):
    p = P.Pieces(model)
    for t in ODD[1:]:
        data = t.encode()
        ((ids, b, e),) = p.encode([t])
        assert "".join(data[x:y].decode() for x, y in zip(b, e, strict=True)) == t
        for k, (i, x, y) in enumerate(zip(ids, b, e, strict=True)):
            if x != y and not p.pieces[i].startswith("<0x"):
                own = data[x:y].decode().replace(" ", P.BAR)
                assert p.pieces[i] == (P.BAR + own if k == 0 else own)


def darts(keys: dict[bytes, int], size: int = 1 << 14) -> list[int]:
    """A double array for a few keys, placed greedily; no two nodes have the same base."""
    units, used, bases = [0] * size, {0}, set()

    def place(node: int, under: dict[bytes, int]) -> None:
        value = under.get(b"")
        kids = sorted({k[0] for k in under if k})
        labels = ([0] if value is not None else []) + kids
        base = next(x for x in range(1, size - 256) if x not in bases and all((x ^ c) not in used for c in labels))
        bases.add(base)
        used.update(base ^ c for c in labels)
        units[node] |= (node ^ base) << 10 | (0x100 if value is not None else 0)
        if value is not None:
            units[base] = value | 1 << 31
        for c in kids:
            units[base ^ c] = c
            place(base ^ c, {k[1:]: v for k, v in under.items() if k[:1] == bytes([c])})

    place(0, keys)
    return units


def char_map(changes: dict[str, str]) -> bytes:
    strings, keys = b"", {}
    for k, v in changes.items():
        keys[k.encode()] = len(strings)
        strings += v.encode() + b"\0"
    units = darts(keys)
    return struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + strings


CHANGES = {"ﬁ": "fi", "Å": "Å", "A": "a", "…": "...", "　": " ", "\t": " ", "­": "", "ab": "BA", "abc": "Z"}


def test_longest_prefix_of_a_character_map():
    p = P.Pieces.__new__(P.Pieces)
    p.map, p.strip, p.prefix = P.CharsMap(char_map(CHANGES)), False, False
    out, begin, end = p.normalise("ﬁ ÅA…z­abcab")
    assert out == "fi▁Åa...zZBA"
    assert begin.tolist() == [0, 0, 3, 4, 7, 8, 8, 8, 11, 14, 17, 17]
    assert end.tolist() == [3, 3, 4, 7, 8, 11, 11, 11, 12, 17, 19, 19]


@pytest.mark.parametrize("strip", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_ids_equal_the_librarys_with_a_character_map(model, tmp_path, strip, prefix):
    """The vocabulary is the given one; only the normaliser is another."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(model, "rb") as f:
        m.ParseFromString(f.read())
    m.normalizer_spec.precompiled_charsmap = char_map(CHANGES)
    m.normalizer_spec.remove_extra_whitespaces = strip
    m.normalizer_spec.add_dummy_prefix = prefix
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    p, sp = P.Pieces(str(tmp_path / "m.model")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    r = random.Random(5)
    parts = ["the", "ing", " ", "  ", "é", "ß", "\n", "7", "😀", ".", *CHANGES]
    texts = ["", " ", "ﬁ", *("".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(300))]
    for t, (ids, b, e) in zip(texts, p.encode(texts), strict=True):
        assert ids == sp.encode(t), t
        data = t.encode()
        last = 0
        for i, x, y in zip(ids, b, e, strict=True):
            assert last <= y or x == y
            last = max(last, y)
            own = p._mapped(data[x:y])[0] if not strip else None
            piece = p.pieces[i]
            if own is not None and x != y and not piece.startswith("<0x"):
                assert piece.removeprefix(P.BAR if x == 0 and prefix else "").strip(P.BAR) in own.replace(P.BAR, " ") + own


def test_table(spark, model):
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 8), (2, None, 9), (3, "", 1), (4, "long " * 20000, 1), (None, "x", 1)], "doc_id long, text string, ids int")
    got = P.digests(docs).collect()
    assert len(got) == 6
    for r in got:
        text = {1: "a b", 2: "", 3: "", 4: "long " * 20000, None: "x"}[r.doc_id]
        ids = sp.encode(text, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert P.digests(docs.limit(0)).count() == 0
    spans = {r.doc_id: r for r in P.encode_documents(docs).collect()}
    assert list(spans[1].begins) == [0, 1, 3] and list(spans[1].ends) == [1, 3, 3]


def test_query_against_the_library(spark):
    d = "/root/testdata/sf0.001"
    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_model())
    got = {r.doc_id: r for r in P.op9_pieces(spark, d).collect()}
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = sp.encode(r.text or "", add_eos=True)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
