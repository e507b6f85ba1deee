"""SentencePiece encoding that keeps offsets, and decoding.

``normalise`` does what the library's normaliser does: at each place the longest prefix that the compiled character map has
(a double-array trie over UTF-8) is replaced, else one character is kept, and spaces become U+2581; it records for each
normalised character the bytes of the source that it stands for. The normalised text is what is segmented, by a copy of the
model whose own normaliser is off; the pieces' lengths are running places in the normalised text, whose alignment projects
them to byte spans of the original text. Where the map is empty each character stands for its own bytes, and the alignment
is made for a whole text at once.

Byte pieces of a character that the model doesn't have: the last one spans the character, those before it are empty at
its start, as in the library.

Defined results: a null text is empty and has the end id only; very long texts are encoded whole; repeated rows are
encoded one by one; an empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

BAR = "▁"

def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class CharsMap:
    """A precompiled character map: trie size, trie (Darts double array), replacement strings."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that begins at ``at``, and its replacement."""
        if not self.units:
            return None
        u = self.units
        node = u[0]
        pos = (node >> 10) << ((node & 0x200) >> 6)
        found = None
        for k in range(at, len(data)):
            pos ^= data[k]
            if pos >= len(u):
                break
            node = u[pos]
            if node & 0x800000FF != data[k]:
                break
            pos ^= (node >> 10) << ((node & 0x200) >> 6)
            if node & 0x100:
                found = (k + 1 - at, u[pos] & 0x7FFFFFFF)
        if found is None:
            return None
        n, start = found
        return n, self.strings[start : self.strings.index(b"\0", start)]


class Pieces:
    """One model: encode to ids with byte spans, decode."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.strip = spec.remove_extra_whitespaces
        if not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that write spaces otherwise are not handled")
        self.prefix = spec.add_dummy_prefix
        self.pieces = [p.piece for p in model.pieces]
        is_byte = np.array([p.type == 6 for p in model.pieces])
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), -1)
        #: Characters of a piece; a byte piece ends its character only if no further byte of it follows (see ``lengths``).
        self.n_chars = np.array([1 if b else len(x) for x, b in zip(self.pieces, is_byte, strict=True)])
        #: Byte pieces that go on a character: 0x80 to 0xBF.
        self.goes_on = np.array([bool(b) and 0x80 <= int(x[3:5], 16) < 0xC0 for x, b in zip(self.pieces, is_byte, strict=True)])
        # the same segmentation without a normaliser: it gets texts that are normalised
        spec.precompiled_charsmap = b""
        spec.remove_extra_whitespaces = False
        spec.add_dummy_prefix = False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())

    def normalise(self, text: str) -> tuple[str, np.ndarray, np.ndarray]:
        """Normalised text, and per character the bytes of the source from and to which it stands for. The space that the
        model puts before a text stands for nothing, at its start."""
        data = text.encode()
        if not self.map.units and not self.strip:
            raw = np.frombuffer(data, np.uint8)
            begin = np.flatnonzero((raw & 0xC0) != 0x80)
            end = np.append(begin[1:], len(data)) if len(begin) else begin
            out = text.replace(" ", BAR)
        else:
            out, begin, end = self._mapped(data)
        if self.prefix and out:
            at = begin[:1] if self.strip else np.zeros(1, np.int64)
            return BAR + out, np.concatenate([at, begin]), np.concatenate([at, end])
        return out, begin, end

    def _mapped(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        out: list[str] = []
        begin: list[int] = []
        end: list[int] = []
        at = 0
        while at < len(data):
            hit = self.map.longest(data, at)
            if hit:
                n, to = hit[0], hit[1].decode()
            else:
                n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
                to = data[at : at + n].decode()
            for c in to:
                out.append(BAR if c == " " else c)
                begin.append(at)
                end.append(at + n)
            at += n
        if self.strip:
            keep = [i for i, c in enumerate(out) if c != BAR or (i and out[i - 1] != BAR)]
            while keep and out[keep[-1]] == BAR:
                keep.pop()
            while keep and out[keep[0]] == BAR:
                keep.pop(0)
            out, begin, end = ([x[i] for i in keep] for x in (out, begin, end))
        return "".join(out), np.array(begin, np.int64), np.array(end, np.int64)

    def lengths(self, normal: str, ids: np.ndarray) -> np.ndarray:
        """Normalised characters of each piece; of a character's byte pieces the last one has it."""
        if self.unknown >= 0 and (ids == self.unknown).any():
            return np.array([len(x) for x in self.segmenter.encode(normal, out_type=str)], np.int64)
        n = self.n_chars[ids]
        on = self.goes_on[ids]
        n[:-1][on[1:]] = 0
        return n

    def project(self, normal: str, begin: np.ndarray, end: np.ndarray, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First and last byte (exclusive) in the original text of each piece of a normalised text."""
        if not ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = self.lengths(normal, np.asarray(ids, np.int64))
        to = np.cumsum(n)
        first = np.minimum(to - n, len(begin) - 1)
        return begin[first], np.where(n > 0, end[np.maximum(to - 1, 0)], begin[first])

    def encode(self, texts: list[str]) -> list[tuple[list[int], np.ndarray, np.ndarray]]:
        """Per text: ids, and the first and the last byte (exclusive) of each; no end id."""
        normal = [self.normalise(t) for t in texts]
        ids = self.segmenter.encode([x[0] for x in normal], num_threads=1)
        return [(i, *self.project(*x, i)) for x, i in zip(normal, ids, strict=True)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.sp.decode(ids, num_threads=1)


_loaded: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """A model, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


#: Texts are encoded in slices of about this many characters, to bound memory.
SLICE = 250_000


def _slices(texts: list[str]) -> Iterator[list[int]]:
    part, n = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        n += len(t)
        if n >= SLICE:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row: key, ids (with the end id), begins and ends (bytes of the original text; the end id is empty at its end), decoded."""
    path = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = pieces(path)
        end = p.sp.eos_id()
        for batch in batches:
            keys, texts = batch.column("id"), [t or "" for t in batch.column("text").to_pylist()]
            for part in _slices(texts):
                own = [texts[i] for i in part]
                coded = p.encode(own)
                whole = [c[0] + [end] for c in coded]
                size = [len(t.encode()) for t in own]
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(part)), pa.array(whole, pa.list_(pa.int32())),
                    pa.array([np.append(c[1], n) for c, n in zip(coded, size, strict=True)], pa.list_(pa.int32())),
                    pa.array([np.append(c[2], n) for c, n in zip(coded, size, strict=True)], pa.list_(pa.int32())), pa.array(p.decode(whole), pa.string()),
                ], names=["id", "ids", "begins", "ends", "decoded"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean(run), "id long, ids array<int>, begins array<int>, ends array<int>, decoded string").withColumnRenamed("id", key)


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str | None = None) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and n_bytes that the pieces' spans cover, made where the ids are so that only digests leave the worker."""
    path = model or default_model()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        p = pieces(path)
        end = p.sp.eos_id()
        for batch in batches:
            keys, texts = batch.column("id"), [t or "" for t in batch.column("text").to_pylist()]
            for part in _slices(texts):
                coded = p.encode([texts[i] for i in part])
                whole = [c[0] + [end] for c in coded]
                yield pa.RecordBatch.from_arrays([
                    keys.take(pa.array(part)), pa.array([len(x) for x in whole], pa.int64()),
                    pa.array([hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest() for x in whole]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in p.decode(whole)]),
                    pa.array([int(c[2][-1] - c[1][0]) if c[0] else 0 for c in coded], pa.int64()),
                ], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes"])

    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(lean(run), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long").withColumnRenamed("id", key)


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op9_pieces": op9_pieces}
SQL: dict[str, str] = {}
