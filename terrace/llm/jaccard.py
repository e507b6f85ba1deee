"""Exact Jaccard self-join of documents on word n-grams, by universe-partition pigeonhole.

Sizes are cut into bands; a pair belongs to the band of its larger set, so a set takes part in its own band and, if its
partners may reach it, in the next. In a band whose pairs differ in at most H elements, elements are hashed into H + 1
segments. A set's subset in a segment is a key; in a few doubled segments the subsets with one element deleted are keys
too. A segment that is compared exactly finds sets that differ there by less than 1, a doubled one by less than 2, so as
soon as a set asks in segments whose sum of these is over H, no partner is missed. The doubled segments give room: the
allocation leaves out the segments whose keys the most documents have (empty subsets, common passages), as counted over
all documents; such a key still stands in the file, but only those who could not leave it out ask with it.

Keys that no two documents have are dropped before anything is shuffled but their packed form (``shared_keys``). Documents
with equal sets are one node. Each group of a key is linked as stars first, to its smallest and its largest document;
exact verification of the full sets decides; what stays apart in a group after that is compared pair by pair. So
large groups of copies cost rows in proportion to their size, and no link between different texts is lost.

Sets are of 64-bit hashes; equal sets are told by 128 bits.

Defined results: null, empty and blank texts have an empty set and are linked with nothing; texts with fewer words than n
have one element; very long texts are read whole; equal texts are linked; rows that repeat a doc_id count as one
document; a null doc_id gets a null component; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared_keys as sk
from .common import components, ensure_checkpoint_dir, forget, lean, lean_pair, stored, table, text_buffer, word_starts

N = 4
PERCENT = 85
#: Bytes of text in a chunk; a task's arrays take some hundred bytes a byte.
CHUNK_BYTES = 2_000_000

_R = np.uint64(0x9E3779B97F4A7C15)
_R_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)


#: The longest table of powers made for a base; shorter ones are its beginnings.
_powers: dict[int, np.ndarray] = {}


def _powers_of(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(1 << max(10, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        _powers[int(base)] = np.multiply.accumulate(have, out=have)
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, from one running polynomial."""
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_R, len(data)), dtype=np.uint64)])
    own = (running[ends] - running[starts]) * _powers_of(_R_INVERSE, len(data) + 1)[starts]
    return sk.mix64(own + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, one text after the other; and where each text's begin."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, words = word_starts(lower, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(words) + 1, np.int64)
    h = word_hashes(lower, starts, ends)
    doc = np.repeat(np.arange(len(words)), words)
    first = np.cumsum(words) - words
    place = np.arange(len(h)) - first[doc]
    whole = place + n <= words[doc]
    short = (place == 0) & (words[doc] < n)
    begin = np.flatnonzero(whole | short)
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    grams = np.zeros(len(begin), np.uint64)
    left = words[doc[begin]] - place[begin]
    for k in range(n):
        grams += np.where(k < left, padded[begin + k] * _PLACES[k], np.uint64(0))
    grams = sk.mix64(grams + np.minimum(left, n).astype(np.uint64))
    owner = doc[begin]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(words) + 1))


#: Bytes of text that are hashed at once; the arrays for it take some hundred bytes a byte.
SLICE = 2_000_000
#: Bytes of text whose n-grams are hashed at once here, where a whole executor's workers do so.
HASHED = 500_000


def cut_buffer(data: np.ndarray, offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about this many bytes."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def _slices(batch, size: int = SLICE) -> Iterator:
    """Parts of a batch of about this many bytes of text."""
    data, offsets = text_buffer(batch.column("text"))
    for at, to in cut_buffer(data, offsets, size):
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]


def _sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of a large buffer, slice by slice."""
    parts = [shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n) for a, b in cut_buffer(data, offsets, HASHED)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate([g for g, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts]))])


def _sizes(n: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch, data, offsets in _slices(whole, HASHED):
                grams, bounds = shingle_sets(data, offsets, n)
                sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(sk.mix64(grams ^ np.uint64(c)), dtype=np.uint64)]) for c in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                a, b = ((s[bounds[1:]] - s[bounds[:-1]]).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("chunk"), pa.array(np.diff(bounds)), pa.array(a), pa.array(b)], names=["id", "chunk", "n", "a", "b"])

    return run


class Bands:
    """Size bands for a threshold of percent / 100."""

    def __init__(self, percent: int, most: int):
        self.percent = percent
        # the largest size whose partners must be equal sets: 1 element more or less is too much
        low = next(s for s in range(1, 10_000) if 100 * s >= percent * (s + 1))
        self.low = [low]
        while self.low[-1] <= most:
            self.low.append(self.low[-1] * 100 // percent + 1)
        self.low_at = np.array(self.low)
        high = self.low_at * 100 // percent
        self.differ = 2 * high * (100 - percent) // (100 + percent)
        self.segments = self.differ + 1
        self.doubled = 1 + self.segments // 16

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low_at, size, "right") - 1

    def room(self, size: np.ndarray, band: np.ndarray) -> np.ndarray:
        """How many segments a set of this size may leave out in a band."""
        own = self.of(size)
        largest = np.minimum(size * 100 // self.percent, self.low_at[band] * 100 // self.percent)
        partner = np.where(own == band, np.maximum(size, largest), largest)
        h = (size + partner) * (100 - self.percent) // (100 + self.percent)
        return self.segments[band] + self.doubled[band] - 1 - h


def signatures(grams: np.ndarray, bounds: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    """Keys of all sets: key, row (of the set), part (row and band), single (segment compared exactly), deleted, seg."""
    size = np.diff(bounds)
    rows = np.flatnonzero(size >= bands.low[0])
    own = bands.of(size[rows])
    nxt = (own + 1 < len(bands.low)) & (size[rows] * 100 // bands.percent >= bands.low_at[np.minimum(own + 1, len(bands.low) - 1)])
    row = np.concatenate([rows, rows[nxt]])
    band = np.concatenate([own, own[nxt] + 1])
    m = bands.segments[band] if len(band) else np.zeros(0, np.int64)
    base = np.cumsum(m) - m
    lengths = size[row]
    part = np.repeat(np.arange(len(row)), lengths)
    token = grams[np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(bounds[:-1][row], lengths)]
    seg = (sk.mix64(token ^ np.uint64(0x2545F4914F6CDD1D)) % m[part].astype(np.uint64)).astype(np.int64) if len(part) else part
    at = base[part] + seg
    mixed = sk.mix64(token ^ np.uint64(0x6C62272E07BB0142))
    total = int(m.sum())
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, at, mixed)
    owner = np.repeat(np.arange(len(row)), m)
    seg_no = np.arange(total) - base[owner]
    salt = sk.mix64((band[owner].astype(np.uint64) << np.uint64(32)) + seg_no.astype(np.uint64) + np.uint64(1))
    keys = sk.mix64(sums ^ salt)
    doubled = seg_no < bands.doubled[band[owner]] if len(band) else np.zeros(0, bool)
    cut = seg < bands.doubled[band[part]] if len(part) else np.zeros(0, bool)
    less = sk.mix64((sums[at[cut]] - mixed[cut]) ^ salt[at[cut]])
    return {
        "key": np.concatenate([keys, less]), "part": np.concatenate([owner, part[cut]]),
        "row": np.concatenate([row[owner], row[part[cut]]]) if len(row) else np.zeros(0, np.int64),
        "segment": np.concatenate([np.arange(total), at[cut]]), "doubled": np.concatenate([doubled, np.ones(int(cut.sum()), bool)]), "deleted": np.concatenate([np.zeros(total, bool), np.ones(int(cut.sum()), bool)]),
        "room": bands.room(size[row], band) if len(row) else np.zeros(0, np.int64),
    }


def allocate(keys: dict[str, np.ndarray], counts: np.ndarray) -> np.ndarray:
    """Which keys a set asks with. It has ``room`` units to save, and saves them where the most documents would answer: a
    unit leaves out a segment's exact key, or the deletions of a doubled one; of a doubled segment the deletions go first."""
    segment, gone = keys["segment"], keys["deleted"]
    total = int(segment.max()) + 1 if len(segment) else 0
    exact = np.zeros(total, np.int64)
    exact[segment[~gone]] = counts[~gone]
    deletions = np.zeros(total, np.int64)
    np.maximum.at(deletions, segment[gone], counts[gone])
    part = np.zeros(total, np.int64)
    part[segment] = keys["part"]
    doubled = np.zeros(total, bool)
    doubled[segment] = keys["doubled"]
    # units: deletions of doubled segments, then exact keys, which are worth no more than their segment's deletions
    unit_part = np.concatenate([part, part])
    worth = np.concatenate([np.where(doubled, deletions, 0), np.where(doubled, np.minimum(exact, deletions), exact)])
    may = np.flatnonzero(worth > 1)
    order = may[np.lexsort((may, -worth[may], unit_part[may]))]
    p = unit_part[order]
    first = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
    rank = np.arange(len(p)) - np.maximum.accumulate(np.where(first, np.arange(len(p)), 0)) if len(p) else p
    saved = np.zeros(2 * total, bool)
    saved[order[rank < keys["room"][p]]] = True
    return ~np.where(gone, saved[segment], saved[total + segment])


def _own_sets(left, right, n: int):
    """A chunk's representatives: ids, sets."""
    import pyarrow.compute as pc

    keep = pc.and_(pc.is_valid(left.column("id")), pc.is_in(left.column("id"), right.filter(pc.is_null(right.column("bucket"))).column("id")))
    left = left.filter(pc.fill_null(keep, False))
    grams, bounds = _sets(*text_buffer(left.column("text")), n)
    return left.column("id").to_numpy(), grams, bounds


def _ask(n: int, bands: Bands, bits: int):
    def run(key, left, right):
        _, grams, bounds = _own_sets(left, right, n)
        keys = signatures(grams, bounds, bands)
        return sk.sent(key[0].as_py(), keys["key"], keys["row"], bits)

    return run


CANDIDATES = "key long, id long, n int, asks boolean, deleted boolean, sketch binary"
#: Bits of the shortest and the longest sketch; a set of n elements has 2 n bits between these.
SKETCH_BITS = (256, 8192)


def sketch(grams: np.ndarray) -> bytes:
    """Bit i is the parity of the elements whose low bits are i: two sets differ in at least as many elements as their
    sketches do in bits. A longer sketch folds to a shorter one."""
    bits = min(max(1 << max(0, 2 * len(grams) - 1).bit_length(), SKETCH_BITS[0]), SKETCH_BITS[1])
    odd = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def sketch_rows(raw: list[bytes], length: int) -> np.ndarray:
    """Sketches of at least this many bytes as a table of 64-bit numbers, folded to this length."""
    out = np.empty((len(raw), length // 8), np.uint64)
    sizes = np.array([len(x) for x in raw])
    for have in np.unique(sizes):
        own = np.flatnonzero(sizes == have)
        rows = np.frombuffer(b"".join([raw[i] for i in own]), np.uint64).reshape(len(own), -1)
        while rows.shape[1] > length // 8:
            half = rows.shape[1] // 2
            rows = rows[:, :half] ^ rows[:, half:]
        out[own] = rows
    return out


def may_differ(size: np.ndarray, percent: int) -> np.ndarray:
    """In how many elements two linked sets of this size together can differ."""
    return size * (100 - percent) // (100 + percent)


def _candidates(n: int, bands: Bands, bits: int):
    def run(key, left, right):
        import pyarrow as pa
        import pyarrow.compute as pc

        ids, grams, bounds = _own_sets(left, right, n)
        said = right.filter(pc.is_valid(right.column("bucket")))
        keys = signatures(grams, bounds, bands)
        counts = sk.counted(said.column("bucket").to_pylist(), said.column("counts").to_pylist(), keys["key"], keys["row"], bits)
        asks = allocate(keys, counts)
        hit = np.flatnonzero(counts > 1)
        row = keys["row"][hit]
        own = np.unique(row)
        size = np.diff(bounds)
        none, total = len(own), len(hit) + len(own)
        flags = lambda x: pa.concat_arrays([pa.array(x[hit]), pa.nulls(none, pa.bool_())])
        return pa.table({
            "key": pa.concat_arrays([pa.array(keys["key"][hit].view(np.int64)), pa.nulls(none, pa.int64())]),
            "id": pa.array(np.concatenate([ids[row], ids[own]]) if total else np.zeros(0, np.int64), pa.int64()),
            "n": pa.array(np.concatenate([size[row], size[own]]), pa.int32()), "asks": flags(asks), "deleted": flags(keys["deleted"]),
            "sketch": pa.concat_arrays([pa.nulls(len(hit), pa.binary()), pa.array([sketch(grams[bounds[r] : bounds[r + 1]]) for r in own], pa.binary())]),
        })

    return run


def _verified(percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                x, y = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                same = int((y[at] == x).sum())
                keep[i] = 100 * same >= percent * (len(x) + len(y) - same)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(keep)], names=["u", "v", "linked"])

    return run


def _alike(percent: int):
    """Pairs whose sketches don't rule them out."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(c).to_pylist() for c in ("a", "b"))
            shorter = np.array([min(len(x), len(y)) for x, y in zip(a, b, strict=True)])
            differ = np.zeros(len(shorter), np.int64)
            for k in np.unique(shorter):
                own = np.flatnonzero(shorter == k)
                x, y = (sketch_rows([c[i] for i in own], k) for c in (a, b))
                differ[own] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            keep = pa.array(differ <= may_differ(batch.column("n").to_numpy().astype(np.int64), percent))
            yield pa.RecordBatch.from_arrays([batch.column("u").filter(keep), batch.column("v").filter(keep)], names=["u", "v"])

    return run


def _sets_of(n: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for batch, data, offsets in _slices(whole, HASHED):
                grams, bounds = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([grams[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["id", "grams"])

    return run


def _verify(pairs: DataFrame, sketches: DataFrame, plain: DataFrame, n: int, percent: int) -> DataFrame:
    """Which pairs are linked. Sketches refute most false pairs, exactly; of the others the full sets are compared, made
    anew from the texts that it takes."""
    both = pairs.join(sketches.select(F.col("id").alias("u"), F.col("n").alias("n1"), F.col("sketch").alias("a")), "u")
    both = both.join(sketches.select(F.col("id").alias("v"), F.col("n").alias("n2"), F.col("sketch").alias("b")), "v")
    alike, first = stored(both.select("u", "v", (F.col("n1") + F.col("n2")).alias("n"), "a", "b").mapInArrow(lean(_alike(percent)), "u long, v long"))
    ids, second = stored(alike.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    sets, third = stored(plain.join(ids, "id").mapInArrow(lean(_sets_of(n)), "id long, grams binary"))
    left = alike.join(sets.select(F.col("id").alias("u"), F.col("grams").alias("a")), "u")
    full = left.join(sets.select(F.col("id").alias("v"), F.col("grams").alias("b")), "v")
    links = full.select("u", "v", "a", "b").mapInArrow(lean(_verified(percent)), "u long, v long, linked boolean").filter("linked").select("u", "v").distinct().checkpoint()
    forget(plain.sparkSession, first, second, third)
    return links


def _met(rows: DataFrame, percent: int) -> DataFrame:
    """Rows x and y that may be linked: not both by deletion, sizes near, and the one with the greater id asks. (Each of
    two linked sets meets the other in a key that it asks with, so one asker is enough.)"""
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    asks = F.when(F.col("x.id") > F.col("y.id"), F.col("x.asks")).otherwise(F.col("y.asks"))
    return rows.filter((F.col("x.id") != F.col("y.id")) & asks & ~(F.col("x.deleted") & F.col("y.deleted")) & near)


#: Documents of a key's group that are compared in one task; larger groups are cut into blocks, every two of which meet.
BLOCK = 2000
#: Rows of an anchor's groups that go to one task, about; those of a larger anchor are dealt by key.
ANCHOR_ROWS = 2 * BLOCK
#: Pairs that a task keeps to find repeats before it hands them on.
KEPT_PAIRS = 500_000


def _apart(percent: int):
    """From rows sorted by anchor and group (key, lo, hi): pairs of unlike components that may be linked and that sketches
    don't rule out, each once for an anchor. Rows come in batches; a group is worked on when its last row has come."""

    def pairs(t) -> np.ndarray:
        key, lo, hi, block, ids, n, c = (t.column(x).to_numpy() for x in ("key", "lo", "hi", "block", "id", "n", "c"))
        asks, gone = (t.column(x).to_numpy(zero_copy_only=False) for x in ("asks", "deleted"))
        _, first, doc = np.unique(ids, return_index=True, return_inverse=True)
        raw = t.column("sketch").take(first).to_pylist()
        length = np.array([len(x) for x in raw])
        sketches = {k: (np.cumsum(length >= k) - 1, sketch_rows([x for x in raw if len(x) >= k], k)) for k in np.unique(length)}
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
        starts = np.flatnonzero(new)
        end = np.repeat(np.append(starts[1:], len(key)), np.diff(np.append(starts, len(key))))
        i, found = np.arange(len(key)), [np.zeros((0, 2), np.int64)]
        for d in range(1, len(key)):
            i = i[i + d < end[i]]
            if not len(i):
                break
            j = i + d
            small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            ok = (c[i] != c[j]) & (ids[i] != ids[j]) & np.where(ids[i] > ids[j], asks[i], asks[j]) & ~(gone[i] & gone[j]) & (100 * small >= percent * large)
            ok &= (lo[i] == hi[i]) | (block[i] != block[j])
            x, y = i[ok], j[ok]
            shorter = np.minimum(length[doc[x]], length[doc[y]])
            for k, (at, rows) in sketches.items():
                own = np.flatnonzero(shorter == k)
                differ = np.bitwise_count(rows[at[doc[x[own]]]] ^ rows[at[doc[y[own]]]]).sum(axis=1, dtype=np.int64)
                near = own[differ <= may_differ(n[x[own]].astype(np.int64) + n[y[own]], percent)]
                found.append(np.stack([np.minimum(ids[x[near]], ids[y[near]]), np.maximum(ids[x[near]], ids[y[near]])], axis=1))
        return np.unique(np.concatenate(found), axis=0)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        made = lambda p: pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["u", "v"])
        rest, kept = None, np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            last = [t.column(x)[t.num_rows - 1].as_py() for x in ("key", "lo", "hi")]
            same = np.ones(t.num_rows, bool)
            for x, v in zip(("key", "lo", "hi"), last, strict=True):
                same &= t.column(x).to_numpy() == v
            cut = int(np.argmax(same))
            rest = t.slice(cut)
            if cut:
                kept = np.unique(np.concatenate([kept, pairs(t.slice(0, cut).combine_chunks())]), axis=0)
            if len(kept) > KEPT_PAIRS:
                yield made(kept)
                kept = kept[:0]
        if rest is not None:
            yield made(np.unique(np.concatenate([kept, pairs(rest.combine_chunks())]), axis=0))

    return run


def _nearest(rows: DataFrame, percent: int) -> DataFrame:
    """One pair for each document x: with the y that it shares the most keys with."""
    shared = _met(rows, percent).groupBy(F.col("x.id").alias("x"), F.col("y.id").alias("y")).agg(F.count("*").alias("n"))
    best = shared.groupBy("x").agg(F.max_by("y", F.struct("n", -F.col("y"))).alias("y"))
    return best.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per row: key, n_shingles, component_id (smallest key reachable by links), set_id (smallest key with an equal set)."""
    if n > len(_PLACES):
        raise ValueError(f"n is at most {len(_PLACES)}")
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    dealt, chunks = sk.chunked(plain, chunk_bytes)
    bits = sk.bits_for(chunks)
    placed = plain.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int"))
    base = placed.mapInArrow(lean(_sizes(n)), "id long, chunk int, n long, a long, b long").checkpoint()
    sets_of = base.filter("n > 0 and id is not null").groupBy("a", "b", "n").agg(F.min(F.struct("id", "chunk")).alias("one"))
    most = base.agg(F.max("n").alias("n")).first()["n"] or 0
    bands = Bands(percent, int(most))
    firsts = sets_of.filter(F.col("n") >= bands.low[0]).select("one.chunk", "one.id", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("counts")).checkpoint()
    by_chunk = dealt.groupBy("chunk")
    asked = by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(lean_pair(_ask(n, bands, bits)), sk.SENT)
    said = sk.answers(asked).select("chunk", F.lit(None).cast("long").alias("id"), "bucket", "counts").unionByName(firsts)
    found = by_chunk.cogroup(said.groupBy("chunk")).applyInArrow(lean_pair(_candidates(n, bands, bits)), CANDIDATES)
    found, path = stored(found)
    sketches = found.filter("sketch is not null").select("id", "n", "sketch")
    item = F.struct("id", "n", "asks", "deleted")
    rows = found.filter("key is not null").select("key", item.alias("x"))
    ends = rows.groupBy("key").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.max("x.asks").alias("asked"))
    ends = ends.filter(F.col("asked") & (F.col("least.id") != F.col("most.id")))
    stars = rows.join(ends, "key").select("x", F.explode(F.array("least", "most")).alias("y"))
    tested = _nearest(stars, percent).checkpoint()
    links = _verify(tested, sketches, plain, n, percent)
    label = components(links)
    # groups that are still in parts: what of them is apart is compared pair by pair. Keys with the same rows are one
    # group, and groups with the same least document come to few tasks, which drop the repeats of a pair
    told = rows.join(label.withColumnRenamed("id", "own"), F.col("x.id") == F.col("own"), "left").select("key", "x.*", F.coalesce("component", "id").alias("c"))
    marks = [F.bit_xor(F.xxhash64(*cols)).alias(f"mark{i}") for i, cols in enumerate((("id", "asks", "deleted"), ("deleted", "asks", "id")))]
    parts = told.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("asks").alias("asked"), F.count("*").alias("size"), F.min("id").alias("anchor"), *marks)
    parts = parts.filter("low <> high and asked").groupBy("mark0", "mark1", "size", "anchor").agg(F.min("key").alias("key"))
    deals = parts.groupBy("anchor").agg(F.ceil(F.sum("size") / ANCHOR_ROWS).alias("deals"))
    parts = parts.join(deals, "anchor").select("key", "anchor", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"), F.pmod(F.xxhash64("key"), F.col("deals")).alias("deal"))
    told = told.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    told = told.join(sketches.select("id", "sketch"), "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    told = told.select("anchor", "deal", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "n", "asks", "deleted", "c", "sketch")
    apart = told.repartition("anchor", "deal", "lo", "hi").sortWithinPartitions("anchor", "deal", "key", "lo", "hi", "id").mapInArrow(lean(_apart(percent)), "u long, v long").distinct()
    more = _verify(apart.join(tested, ["u", "v"], "left_anti"), sketches, plain, n, percent)
    label = components(links.unionByName(more)) if not more.isEmpty() else label
    forget(spark, path)
    owner = sets_of.select("a", "b", "n", F.col("one.id").alias("set_id")).join(label.withColumnRenamed("id", "set_id"), "set_id", "left")
    out = base.join(owner, ["a", "b", "n"], "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "set_id", "id").alias("component_id"), F.coalesce("set_id", "id").alias("set_id"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("set_id")


SQL_OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS s FROM w
), toks AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (SELECT t FROM toks GROUP BY t HAVING count(*) > 1),
shared AS (SELECT * FROM toks SEMI JOIN common USING (t)),
pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id < b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS MATERIALIZED (SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs),
reach AS (SELECT DISTINCT u AS doc_id, u AS r FROM links UNION SELECT reach.doc_id, links.v FROM reach JOIN links ON links.u = reach.r),
least_of AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least_of.c, s.doc_id) AS component_id FROM sets s LEFT JOIN least_of USING (doc_id)"""

QUERIES = {"op5_ngram_jaccard": op5_ngram_jaccard}
SQL = {"op5_ngram_jaccard": SQL_OP5}
