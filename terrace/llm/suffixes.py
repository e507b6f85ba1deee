"""Suffix-array deduplication of repeated byte strings.

``suffix_array`` sorts in two stages: only suffixes smaller than their successors are sorted directly (by as many leading
bytes as matter), all others are induced from them by one scan over the buckets of first bytes; then common prefixes of
neighbours are computed. Scans and prefixes work on whole buckets and arrays at once.

To shard the array, every window of ``length`` bytes is filed under the smallest hashed k-gram in it, which equal windows
have in common. Windows whose k-gram no other document has (``shared_keys``) cannot repeat and stay where they are. For the
others the run of windows with the same k-gram is sent once per chunk and distinct content, with the smallest doc_id that
has it there, so a passage that a third of all documents share is sent once per chunk. A shard's task takes each distinct
run once, with the smallest doc_id of all chunks. Where a k-gram has one run only, no window of it stands in another one.
Of all other runs the task builds suffix arrays, and neighbours with a common prefix of ``length`` bytes give each window
the smallest doc_id of its string. Answers are one bit a window; the chunk puts them together to spans.

Defined results: texts are UTF-8 bytes, null and empty ones have none; a string is removed where it also starts in a document
with a smaller doc_id, null doc_ids are larger than all; repeats inside a document, and between rows with one doc_id,
stay; very long texts are read whole; an empty table gives an empty table; only the named columns are read. Equal runs
inside a chunk are told by 64-bit hashes and lengths, those of several chunks by their bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_keys as sk
from .common import table, text_buffer
from .jaccard import _R, _R_INVERSE, _powers_of, cut_buffer

LENGTH = 50
#: Bytes of the k-grams that windows are filed under.
GRAM = 24
#: Bytes of a suffix array's text, about.
ARRAY = 300_000
#: Bytes of text whose windows are filed at once, about: so few that arrays of eight bytes each stay in a core's cache.
SLICE = 100_000
_NULL = np.iinfo(np.int64).max


def smaller_than_next(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it; the last one is not."""
    n = len(t)
    change = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(change, np.arange(n))
    rises = np.append(t[change] < t[change + 1], False)
    return rises[at]


def words_at(t: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes from each place, the first one highest; zeros after the end."""
    padded = np.concatenate([t, np.zeros(depth + 8, np.uint8)])
    out = np.zeros(len(t) + depth, np.uint64)
    for k in range(8):
        out |= padded[k : k + len(out)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def _direct(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes, or some more; ties in any order."""
    order = places[np.argsort(words[places])]
    w = words[order]
    group = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])]) if len(order) else np.zeros(0, np.int64)
    open_ = np.arange(len(order))
    for at in range(8, depth, 8):
        size = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 0)
        open_ = open_[size[group[open_]] > 1]
        if not len(open_):
            break
        own, g = order[open_], group[open_]
        w = words[own + at]
        by = np.lexsort((w, g))
        own, w = own[by], w[by]
        order[open_] = own
        new = np.zeros(len(group), bool)
        new[open_[1:]] = (w[1:] != w[:-1]) & (g[1:] == g[:-1])
        # groups are runs of the whole order, so a new one starts in place
        starts = np.concatenate([[False], group[1:] != group[:-1]])
        group = np.cumsum(starts | new)
    return order


def suffix_array(t: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes at least, as if zeros followed the text."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64)
    words = words_at(t, depth) if words is None else words
    small = smaller_than_next(t)
    sa = np.full(n, -1, np.int64)
    sizes = np.bincount(t, minlength=256)
    ends = np.cumsum(sizes)
    heads = ends - sizes
    first = heads.copy()
    own = _direct(np.flatnonzero(small), words, depth)
    n_small = np.bincount(t[own], minlength=256)
    small_starts = ends - n_small
    done = 0
    for c in np.flatnonzero(n_small):
        sa[small_starts[c] : ends[c]] = own[done : done + n_small[c]]
        done += n_small[c]

    def induce(part: np.ndarray) -> None:
        before = part[part > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        c = t[before]
        by = np.argsort(c, kind="stable")
        before, c = before[by], c[by]
        counts = np.bincount(c, minlength=256)
        begin = np.cumsum(counts) - counts
        sa[heads[c] + np.arange(len(c)) - begin[c]] = before
        heads[:] += counts

    sa[heads[t[-1]]] = n - 1  # nothing follows the last suffix, so it is the first of its bucket
    heads[t[-1]] += 1
    for c in np.flatnonzero(sizes):
        at = first[c]
        while at < heads[c]:
            to = heads[c]
            induce(sa[at:to])
            at = to
        induce(sa[small_starts[c] : ends[c]])
    return sa


def common_prefixes(sa: np.ndarray, words: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Length of the common prefix with the neighbour before, at most ``depth``."""
    out = np.zeros(len(sa), np.int64)
    open_ = np.arange(1, len(sa))
    for at in range(0, depth, 8):
        differ = words[sa[open_] + at] ^ words[sa[open_ - 1] + at]
        same = differ == 0
        rest = differ[~same]
        # leading zero bytes of what differs
        lead = sum((rest < (np.uint64(1) << np.uint64(64 - 8 * k))).astype(np.int64) for k in range(1, 8))
        out[open_[~same]] = at + lead
        open_ = open_[same]
    out[open_] = depth
    return np.minimum(out, depth)


def least_owner(t: np.ndarray, owner: np.ndarray, window: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each place in t where a window starts, the least owner among the windows with its bytes."""
    words = words_at(t, depth)
    sa = suffix_array(t, depth, words)
    lcp = common_prefixes(sa, words, depth)
    group = np.cumsum(lcp < depth) if len(sa) else sa
    value = np.where(window, owner, _NULL)[sa]
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(sa) else sa
    least = np.minimum.reduceat(value, starts) if len(sa) else value
    out = np.empty(len(t), np.int64)
    out[sa] = np.repeat(least, np.diff(np.append(starts, len(sa))))
    return out


class Runs:
    """A chunk's windows, by the k-gram that each is filed under: of each run of windows with one k-gram its key, document,
    first byte, number of windows, a hash of its bytes, and where in it the k-gram stands."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.ids, self.data, self.offsets, self.length = ids, data, offsets, length
        parts = [p for a, b in cut_buffer(data, offsets, SLICE) if (p := self._slice(a, b, length, gram))]
        kinds = (np.uint64, np.int64, np.int64, np.int64, np.uint64, np.uint8)
        self.key, self.doc, self.start, self.windows, self.content, self.place = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds))

    def _slice(self, a: int, b: int, length: int, gram: int):
        first = self.offsets[a]
        data, offsets = self.data[first : self.offsets[b]], self.offsets[a : b + 1] - first
        per_doc = np.maximum(np.diff(offsets) - length + 1, 0)
        if not per_doc.sum():
            return None
        n = len(data)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_R, n), dtype=np.uint64)])
        inverse = _powers_of(_R_INVERSE, n + 1)
        grams = sk.mix64((running[gram:] - running[:-gram]) * inverse[: n - gram + 1])
        # order by the upper half, the place in the lower: of equal ones the leftmost is the smallest, wherever the slice began
        low = np.uint64((1 << 32) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < width:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        window = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc) + offsets[:-1][doc]
        anchor = (least[window] & low).astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        start, windows = window[at], np.diff(np.append(at, len(doc)))
        content = sk.mix64((running[start + windows + length - 1] - running[start]) * inverse[start] + windows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        # hashes of which each is the smallest of many are small: mixed again, they fall into all buckets alike
        return sk.mix64(grams[anchor[at]]), doc[at] + a, start + first, windows, content, (anchor[at] - start).astype(np.uint8)

    def classes(self, shared: np.ndarray, bits: int):
        """Distinct contents of the runs that share their k-gram, by shard: runs, class of each, and of each class its shard,
        first run and least doc_id."""
        runs = np.flatnonzero(shared)
        h = self.content[runs]
        shard = (self.key[runs] >> np.uint64(64 - bits)).astype(np.int64)
        own = self.ids[self.doc[runs]]
        order = np.lexsort((own, h, shard))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (shard[order][1:] != shard[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        first = order[new]
        return runs, of, shard[first], runs[first], own[first]


def _chunk(table_, length: int, gram: int) -> Runs:
    ids = table_.column("id").fill_null(_NULL).to_numpy()
    return Runs(ids, *text_buffer(table_.column("text")), length, gram)


def _ask(length: int, gram: int, bits: int):
    def run(key, left):
        runs = _chunk(left, length, gram)
        return sk.sent(key[0].as_py(), runs.key, runs.ids[runs.doc], bits)

    return run


def _shared(runs: Runs, said, bits: int) -> np.ndarray:
    return sk.counted(said.column("bucket").to_pylist(), said.column("counts").to_pylist(), runs.key, runs.ids[runs.doc], bits) > 1


SENT = "shard int, chunk int, windows binary, owners binary, places binary, bytes binary"
MASKS = "chunk int, shard int, mask binary"


def _send(length: int, gram: int, bits: int):
    def run(key, left, right):
        import pyarrow as pa

        runs = _chunk(left, length, gram)
        _, _, shard, first, least = runs.classes(_shared(runs, right, bits), bits)
        edges = np.searchsorted(shard, np.arange((1 << bits) + 1))
        used = np.flatnonzero(np.diff(edges))
        rows = []
        for s in used:
            own = first[edges[s] : edges[s + 1]]
            n = runs.windows[own]
            size = n + length - 1
            at = np.repeat(runs.start[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            rows.append((sk.packed(n.astype(np.uint8)), sk.packed(least[edges[s] : edges[s + 1]]), sk.packed(runs.place[own]), sk.packed(runs.data[at])))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        return pa.table({
            "shard": pa.array(used, pa.int32()), "chunk": pa.array(np.full(len(used), key[0].as_py()), pa.int32()),
            **{name: pa.array(c, pa.binary()) for name, c in zip(("windows", "owners", "places", "bytes"), columns, strict=True)},
        })

    return run


def _stretches(data: np.ndarray, start: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """A row of words for each stretch of ``size`` bytes, at most ``most``; those of one size are equal if and only if their
    rows are. The last words overlap instead of going beyond the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    out = np.empty((len(start), -(-most // 8)), np.uint64)
    for k in range(out.shape[1]):
        out[:, k] = words[start + np.clip(size - 8, 0, 8 * k)]
    short = size < 8
    out[short] &= (np.uint64(1) << (8 * size[short]).astype(np.uint64))[:, None] - np.uint64(1)
    return out


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = sk.mix64(h * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return h


def least_owners(data: np.ndarray, windows: np.ndarray, owners: np.ndarray, places: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of each run the least owner of the windows with its bytes. Runs follow each other in data; ``places``
    is where in each its k-gram stands."""
    if not len(windows):
        return np.zeros(0, np.int64)
    size = windows + length - 1
    begin = np.cumsum(size) - size
    whole = _stretches(data, begin, size, 2 * length - gram)
    key = _row_hashes(_stretches(data, begin + places, np.full(len(size), gram), gram))
    order = np.lexsort((_row_hashes(whole), key))
    # distinct runs; those whose hashes meet by chance only make more of them
    new_key = np.append(True, np.diff(key[order]) != 0)
    new = new_key.copy()
    new[1:] |= (size[order][1:] != size[order][:-1]) | (whole[order][1:] != whole[order][:-1]).any(axis=1)
    del whole
    run_of = np.empty(len(order), np.int64)
    run_of[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    owner = np.minimum.reduceat(owners[order], first)
    n, size, begin = windows[order[first]], size[order[first]], begin[order[first]]
    at = np.cumsum(n) - n
    least = np.repeat(owner, n)
    # one suffix array for as many k-grams of several runs as make about ARRAY bytes
    group = np.cumsum(new_key[first]) - 1
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    part = (np.cumsum(size[many]) // ARRAY)[np.searchsorted(group[many], group[many])]
    for own in np.split(many, np.flatnonzero(np.diff(part)) + 1):
        if not len(own):
            continue
        of = np.repeat(np.arange(len(own)), size[own])
        within = np.arange(len(of)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        window = within < n[own][of]
        found = least_owner(data[begin[own][of] + within], owner[own][of], window, length)
        least[(at[own][of] + within)[window]] = found[window]
    return least[np.arange(int(windows.sum())) + np.repeat(at[run_of] - (np.cumsum(windows) - windows), windows)]


def _judge(length: int, gram: int):
    def run(rows):
        import pyarrow as pa

        n = [sk.unpacked(x.as_py(), np.uint8).astype(np.int64) for x in rows.column("windows")]
        owners, places, data = (np.concatenate([sk.unpacked(x.as_py(), kind) for x in rows.column(name)]) for name, kind in (("owners", np.int64), ("places", np.uint8), ("bytes", np.uint8)))
        windows = np.concatenate(n)
        repeats = least_owners(data, windows, owners, places, length, gram) < np.repeat(owners, windows)
        ends = np.cumsum([int(x.sum()) for x in n])
        masks = [sk.packed(np.packbits(repeats[e - int(x.sum()) : e])) for x, e in zip(n, ends, strict=True)]
        return pa.table({"chunk": rows.column("chunk"), "shard": rows.column("shard"), "mask": pa.array(masks, pa.binary())})

    return run


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def _cut(length: int, gram: int, bits: int):
    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        runs = _chunk(left, length, gram)
        said = right.filter(pc.is_valid(right.column("bucket")))
        own, of, shard, first, least = runs.classes(_shared(runs, said, bits), bits)
        # a class's windows that a smaller doc_id elsewhere has
        n = runs.windows[first]
        begin = np.cumsum(n) - n
        repeats = np.zeros(int(n.sum()), bool)
        edges = np.append(begin, len(repeats))
        masks = right.filter(pc.is_null(right.column("bucket")))
        for s, blob in zip(masks.column("shard").to_pylist(), masks.column("counts").to_pylist(), strict=True):
            a, b = np.searchsorted(shard, [s, s + 1])
            repeats[edges[a] : edges[b]] = np.unpackbits(sk.unpacked(blob, np.uint8), count=int(edges[b] - edges[a])).astype(bool)
        each = runs.windows[own]
        run_of = np.repeat(np.arange(len(own)), each)
        within = np.arange(len(run_of)) - np.repeat(np.cumsum(each) - each, each)
        gone = repeats[begin[of[run_of]] + within] | (runs.ids[runs.doc[own]] > least[of])[run_of]
        at = (runs.start[own][run_of] + within)[gone]
        delta = np.zeros(len(runs.data) + length + 1, np.int16)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + length, -1)
        covered = np.cumsum(delta, dtype=np.int32)[: len(runs.data)] > 0
        out: list[list] = [[], [], [], [], []]
        o = runs.offsets
        for i in range(left.num_rows):
            c = covered[o[i] : o[i + 1]]
            turns = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
            for x, v in zip(out, (len(c), int(c.sum()), len(turns) // 2, hashlib.sha256(runs.data[o[i] : o[i + 1]][~c].tobytes()).hexdigest(), [{"start": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]), strict=True):
                x.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        return pa.table({"id": left.column("id"), **{k: pa.array(x, kind) for k, x, kind in zip(("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"), out, kinds, strict=True)}})

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, chunk_bytes: int = sk.CHUNK_BYTES) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256, spans (maximal removed runs, in bytes)."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    dealt, chunks = sk.chunked(plain, chunk_bytes)
    bits = sk.bits_for(chunks)
    by_chunk = dealt.groupBy("chunk")
    said = sk.answers(by_chunk.applyInArrow(_ask(length, gram, bits), sk.SENT))
    sent = by_chunk.cogroup(said.groupBy("chunk")).applyInArrow(_send(length, gram, bits), SENT)
    masks = sent.groupBy("shard").applyInArrow(_judge(length, gram), MASKS)
    both = said.select("chunk", "bucket", F.lit(None).cast("int").alias("shard"), "counts").unionByName(masks.select("chunk", F.lit(None).cast("int").alias("bucket"), "shard", F.col("mask").alias("counts")))
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(_cut(length, gram, bits), RESULT).withColumnRenamed("id", key)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
SQL: dict[str, str] = {}
