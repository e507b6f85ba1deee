"""License scans: fuzzy search for short notices.

A notice of length L with k allowed edits is split into k + 1 pieces; by the pigeonhole principle one of them stands
unchanged in every match, so exact finds of the pieces locate all candidates. Around each the regex library's
bounded-error matching decides, and reports span and edits. Texts are compared as lower-case words (A-Z) joined by one
space, so line ends, punctuation and comment signs inside a notice don't count as edits; spans are in words.

The base labels of the contract are places of exact phrases; a place also is a match of the method with no edits.

Defined results: a null text is empty: no words, no labels, score 0; very long texts are searched whole; overlapping
matches of one notice are reported once, the one with the fewest edits, then the first; repeated rows are searched one by
one; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Phrases and labels of the contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices of the method's own. Of L characters, L // EDIT_EVERY edits are allowed.
NOTICES = [
    ("all rights reserved", "reserved"), ("general public license", "gpl"), ("gnu lesser general public license", "lgpl"),
    ("licensed under cc by", "cc-by"), ("creative commons attribution", "cc-by"), ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"), ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"), ("mozilla public license", "mpl"), ("eclipse public license", "epl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]
EDIT_EVERY = 9
#: Bytes that part words; A-Z become a-z.
_FOLD = bytes(32 if c < 0x30 or 0x3A <= c <= 0x40 or 0x5B <= c <= 0x60 or 0x7B <= c <= 0x7F else c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def folded(text: str) -> bytes:
    """Lower-case words, a space before and after each."""
    return b" " + b" ".join(text.encode().translate(_FOLD).split()) + b" "


@cache
def plan(notices: tuple, every: int) -> list[tuple]:
    """Per notice: label, length, edits, pieces with their offsets, the expression."""
    import regex

    out = []
    for notice, label in notices:
        n, k = len(notice), len(notice) // every
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        pieces = [(notice[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]
        # (?e) mends a match that was found to fewer edits; whole words at both ends
        out.append((label, n, k, pieces, regex.compile(rf"(?e)(?<= )(?:{regex.escape(notice)}){{e<={k}}}(?= )", regex.V1) if k else None, notice))
    return out


def search(text: bytes, notices=tuple(NOTICES), every: int = EDIT_EVERY) -> list[tuple[int, int, str, int, int]]:
    """Matches in a folded text: start and end (bytes), label, edits, length of the notice."""
    found = []
    # edits are counted in characters, which an edit can lengthen to four bytes, so windows are cut in characters
    whole = text.decode()
    place = (lambda at: at) if text.isascii() else (lambda at: len(whole[:at].encode()))
    for label, n, k, pieces, expression, exact in plan(notices, every):
        areas: list[list[int]] = []
        for piece, offset in pieces:
            at = whole.find(piece)
            while at >= 0:
                areas.append([max(0, at - offset - k - 1), min(len(whole), at - offset + n + k + 1)])
                at = whole.find(piece, at + 1)
        if not areas:
            continue
        areas.sort()
        merged = [areas[0]]
        for a, b in areas[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        own = []
        for a, b in merged:
            if expression is None:
                at = whole.find(f" {exact} ", a, b)
                if at >= 0:
                    own.append((place(at + 1), place(at + 1 + n), label, 0, n))
                continue
            for m in expression.finditer(whole[a:b], overlapped=True):
                own.append((place(a + m.start()), place(a + m.end()), label, sum(m.fuzzy_counts), n))
        taken: list[tuple] = []
        for m in sorted(own, key=lambda m: (m[3], m[0])):
            if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                taken.append(m)
        found += taken
    return sorted(found)


def _places(text: bytes, phrase: bytes) -> list[int]:
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double,"
    " matches array<struct<label:string,start_word:long,end_word:long,edits:long,start_byte:long,end_byte:long>>"
)


def _scan(notices: tuple, every: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        phrases = [(f" {p} ".encode(), label) for p, label in BASE.items()]
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for text in batch.column("text"):
                t = folded(text.as_py() or "")
                n_words = t.count(b" ") - 1 if len(t) > 2 else 0
                places = [(at, label) for p, label in phrases for at in _places(t, p)]
                words = [t.count(b" ", 0, at) for at, _ in places]
                near = search(t, notices, every)
                labels = {label for _, label in places}
                score = 1.0 if places else max((1 - m[3] / m[4] for m in near), default=0.0)
                row = (
                    n_words, len(places), min(words, default=None), max(words, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[2] for m in near})), score,
                    [{"label": m[2], "start_word": t.count(b" ", 0, m[0]) - 1, "end_word": t.count(b" ", 0, m[1]), "edits": m[3], "start_byte": m[0] - 1, "end_byte": m[1] - 1} for m in near],
                )
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            match = pa.list_(pa.struct([("label", pa.string()), *((x, pa.int64()) for x in ("start_word", "end_word", "edits", "start_byte", "end_byte"))]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match]
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def scan_notices(docs: DataFrame, key: str = "doc_id", text: str = "text", notices=tuple(NOTICES), every: int = EDIT_EVERY) -> DataFrame:
    """Per row: key, the contract's columns, and the matches with their spans (words, and bytes of the folded text)."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_scan(tuple(notices), every), SCHEMA).withColumnRenamed("id", key)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_notices(table(spark, sf_dir, "documents")).drop("matches")


QUERIES = {"op3_license_scan": op3_license_scan}
SQL: dict[str, str] = {}
