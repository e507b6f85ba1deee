"""Exact top-k search by BM25 over an inverted index with block maxima.

Documents are dealt to shards; a shard's documents stand in the order of their commonest query word and length, so that
alike documents share blocks. A shard's commonest terms have a row of contributions and the greatest one of each block,
the others posting lists. A query first sums its lists; a block's greatest sum and its maxima of the commoner terms bound
its scores, and blocks below the k-th best score so far can have no result and are never opened (block-max WAND with
blocks aligned over terms, its terms parted as in MaxScore). Opened blocks are scored for many queries by one product of
matrices. Document counts, lengths and term frequencies are those of all documents, so shards' scores are comparable and
their k best merge to the exact k best.

Contributions are rounded to millionths and summed as integers, so scores don't depend on the order of summation, and
ties are real ties: the smaller doc_id wins. Terms are words of letters, digits and other non-ASCII characters, A-Z in
lower case, told by 64-bit hashes; a query's repeated words count once.

Defined results: queries without words, or without a hit, have no result; null texts are empty documents, null doc_ids
are found like others (ties after all others) but are no queries; rows that repeat a doc_id are documents of their own;
empty tables give empty tables; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_buffer, text_bytes, word_starts
from .jaccard import _slices, cut_buffer, word_hashes

K = 10
K1, B = 1.2, 0.75
EVERY = 100
BLOCK = 64
SHARD_BYTES = 24_000_000
#: Documents taken at a time; terms with rows, at most, and only those that a document in so many has; queries taken at a
#: time, at most, and so many postings of their lists.
CHUNK, ROWS, SPARSE, TOGETHER, BATCH = 4096, 256, 200, 64, 1 << 20
UNIT = 1e6
_NULL = np.iinfo(np.int64).max
#: Bytes that part words.
PARTING = tuple(c for c in range(128) if not (0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A))


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings (document, term, frequency) in the order of documents and terms, and lengths in words."""
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    starts, ends, words = word_starts(lower, offsets, PARTING)
    h = word_hashes(lower, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at].view(np.int64), np.diff(np.append(at, len(h))), words


def _frequencies(batches: Iterator) -> Iterator:
    """Per batch: (term, documents with it), and a row without a term for its documents and words."""
    import pyarrow as pa

    for whole in batches:
        found, n_docs, n_words = [], 0, 0
        for _, data, offsets in _slices(whole):
            _, term, _, words = terms_of(data, offsets)
            found.append(np.unique(term, return_counts=True))
            n_docs, n_words = n_docs + len(words), n_words + int(words.sum())
        distinct, place = np.unique(np.concatenate([t for t, _ in found]), return_inverse=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        counts = np.bincount(place, np.concatenate([c for _, c in found]), len(distinct)).astype(np.int64) if found else distinct
        yield pa.RecordBatch.from_arrays([
            pa.concat_arrays([pa.array(distinct, pa.int64()), pa.nulls(1, pa.int64())]), pa.array(np.append(counts, n_docs), pa.int64()),
            pa.array(np.append(np.zeros(len(counts), np.int64), n_words), pa.int64()),
        ], names=["term", "docs", "words"])


def _terms(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for whole in batches:
        for batch, data, offsets in _slices(whole):
            doc, term, _, _ = terms_of(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(term, pa.int64())], names=["query", "term"])


class Index:
    """A shard: postings of the terms that queries ask for, by chunks of documents, and block maxima of the commonest."""

    def __init__(self, ids, data, offsets, terms: np.ndarray, df: np.ndarray, n_docs: int, n_words: int):
        self.terms = terms
        parts, words = [], np.zeros(len(offsets) - 1, np.int64)
        for a, b in cut_buffer(data, offsets):
            doc, term, tf, words[a:b] = terms_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = np.searchsorted(terms, term)
            at[at == len(terms)] = 0
            asked = terms[at] == term if len(terms) else np.zeros(len(term), bool)
            parts.append((doc[asked] + a, at[asked], tf[asked]))
        doc, at, tf = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
        # alike documents next to each other: by the commonest term they have much of, then by length
        lead = np.full(len(words), -1)
        by = np.lexsort((df[at], tf, doc))
        last = np.append(doc[by][1:] != doc[by][:-1], True) if len(by) else np.zeros(0, bool)
        lead[doc[by][last]] = at[by][last]
        order = np.lexsort((words, lead))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.ids = np.asarray(ids)[order]
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        value = idf[at] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * words[doc] / max(n_words / max(n_docs, 1), 1e-9))))
        value = np.rint(value * UNIT)
        doc = place[doc]
        self.n_blocks = len(words) // BLOCK + 1
        # the commonest terms have a row of every document's value, the others have lists
        count = np.bincount(at, minlength=len(terms))
        common = np.argsort(-count, kind="stable")[:ROWS]
        common = common[count[common] * SPARSE > len(words)]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        self.rows = len(common)
        dense = self.row[at] >= 0
        by = np.argsort(doc[dense], kind="stable")
        self.dense = doc[dense][by], self.row[at[dense]][by], value[dense][by]
        doc, at, value = doc[~dense], at[~dense], value[~dense]
        by = np.lexsort((doc, at, doc // CHUNK))
        self.lists = doc[by], at[by], value[by]

    @staticmethod
    def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = ends - starts
        return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)

    def _chunks(self) -> Iterator:
        """Per chunk of documents: its first, the rows of the commonest terms, their block maxima, and the other terms' lists."""
        for base in range(0, len(self.ids), CHUNK):
            size = -(-min(CHUNK, len(self.ids) - base) // BLOCK) * BLOCK
            doc, row, value = self.dense
            a, b = np.searchsorted(doc, (base, base + CHUNK))
            rows = np.zeros((self.rows, size))
            rows[row[a:b], doc[a:b] - base] = value[a:b]
            doc, at, value = self.lists
            a, b = np.searchsorted(doc // CHUNK, (base // CHUNK, base // CHUNK + 1))
            starts = np.append(0, np.cumsum(np.bincount(at[a:b], minlength=len(self.terms))))
            yield base, rows, rows.reshape(self.rows, -1, BLOCK).max(2), starts, doc[a:b] - base, value[a:b]

    def search_all(self, asked: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For queries whose terms are asked[ends[i] : ends[i + 1]], the k best documents with a hit: query, id and score,
        best first, and how many blocks were opened.

        In a chunk the lists of a query's rarer terms are summed; the greatest sum of a block and the block maxima of its
        commoner terms bound the block's scores. Blocks below the k-th best score so far, or below the k-th best sum of lists,
        are not opened: their rows of the commoner terms are not read. Several queries are taken at a time."""
        n = len(ends) - 1
        query, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        least, opened, who = np.zeros(n), 0, np.repeat(np.arange(n), np.diff(ends))
        for base, rows, most, starts, doc, value in self._chunks():
            size, blocks = rows.shape[1], most.shape[1]
            work = np.append(0, np.cumsum(starts[asked + 1] - starts[asked]))[ends[1:]] + np.arange(1, n + 1) * BATCH // TOGETHER
            edges = np.append(np.flatnonzero(np.diff(work // BATCH, prepend=-1)), n)
            found = [(query, ids, scores)]
            for q0, q1 in zip(edges[:-1], edges[1:], strict=True):
                terms, own = asked[ends[q0] : ends[q1]], who[ends[q0] : ends[q1]] - q0
                row = self.row[terms]
                has = np.zeros((q1 - q0, self.rows))
                has[own[row >= 0], row[row >= 0]] = 1
                terms, own = terms[row < 0], own[row < 0]
                a, b = starts[terms], starts[terms + 1]
                posting = self._spread(a, b)
                total = np.bincount(np.repeat(own * size, b - a) + doc[posting], value[posting], (q1 - q0) * size).astype(float, copy=False).reshape(-1, blocks, BLOCK)
                limit = self._limit(total, least[q0:q1], k)
                bound = has @ most + total.max(2)
                open_ = (bound >= limit[:, None]) & (bound > 0)
                opened += int(open_.sum())
                if open_.mean() > 0.5:
                    total += (has @ rows).reshape(total.shape)
                else:
                    for block in np.flatnonzero(open_.any(0)):
                        some = np.flatnonzero(open_[:, block])
                        total[some, block] += has[some] @ rows[:, block * BLOCK : (block + 1) * BLOCK]
                total[~open_] = 0
                limit = self._limit(total, limit, k)
                hit = np.flatnonzero((total >= np.maximum(limit, 1)[:, None, None]).ravel())
                found.append((hit // size + q0, self.ids[hit % size + base], total.ravel()[hit]))
            query, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
            best = np.lexsort((ids, -scores, query))
            query, ids, scores = query[best], ids[best], scores[best]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            kept = rank < k
            query, ids, scores, rank = query[kept], ids[kept], scores[kept], rank[kept]
            least[query[rank == k - 1]] = scores[rank == k - 1]
        return query, ids, scores, opened

    @staticmethod
    def _limit(total: np.ndarray, least: np.ndarray, k: int) -> np.ndarray:
        """What the k-th best reaches at least, as k of these documents have that much."""
        flat = total.reshape(len(total), -1)
        return least if flat.shape[1] < k else np.maximum(least, np.partition(flat, flat.shape[1] - k, axis=1)[:, flat.shape[1] - k])

    def search(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of one query's k best documents with a hit, and how many blocks were opened."""
        _, ids, scores, opened = self.search_all(np.asarray(asked), np.array([0, len(asked)]), k)
        return ids, scores, opened


FOUND = "query long, id long, score long"


def _shard(k: int, n_docs: int, n_words: int):
    def run(key, left, right):
        import pyarrow as pa

        lists = right.column("terms").combine_chunks()
        flat = lists.flatten().to_numpy()
        ends = np.append(lists.offsets.to_numpy()[: len(lists)], lists.offsets.to_numpy()[-1:])
        ends = ends - ends[0] if len(ends) else np.zeros(1, np.int64)
        terms, first, at = np.unique(flat, return_index=True, return_inverse=True)
        df = right.column("dfs").combine_chunks().flatten().to_numpy()[first].astype(float)
        index = Index(left.column("id").fill_null(_NULL).to_numpy(), *text_buffer(left.column("text")), terms, df, n_docs, n_words)
        q, ids, scores, _ = index.search_all(at, ends, k)
        return pa.table({"query": right.column("query").combine_chunks().take(pa.array(q)), "id": pa.array(ids, pa.int64(), mask=ids == _NULL), "score": pa.array(scores.astype(np.int64))})

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per query (key and text of ``queries``) its k best documents: query_id, doc_id, rank, score."""
    plain = lambda x: x.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    documents = plain(docs)
    counts = documents.mapInArrow(_frequencies, "term long, docs long, words long").groupBy("term").agg(F.sum("docs").alias("df"), F.sum("words").alias("words"))
    asked = plain(queries.filter(F.col(key).isNotNull())).mapInArrow(_terms, "query long, term long").distinct()
    counts = counts.join(asked.select("term").distinct().unionByName(asked.sparkSession.range(1).select(F.lit(None).cast("long").alias("term"))).withColumnRenamed("term", "wanted"), F.col("term").eqNullSafe(F.col("wanted")), "left_semi").checkpoint()
    totals = counts.filter("term is null").first()
    n_docs, n_words = (totals["df"], totals["words"]) if totals else (0, 0)
    stated = asked.join(counts, "term").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("term", "df"))).alias("items"))
    stated = stated.select("query", F.col("items.term").alias("terms"), F.col("items.df").alias("dfs"))
    shards = max(1, -(-text_bytes(documents) // shard_bytes))
    dealt = documents.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    sent = stated.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    found = dealt.groupBy("shard").cogroup(sent.groupBy("shard")).applyInArrow(_shard(k, int(n_docs), int(n_words)), FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return best.select(F.col("query").alias("query_id"), F.col("id").alias(key), F.col("rank").cast("long").alias("rank"), (F.col("score") / UNIT).alias("score"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100 is a query, by its whole text, against all documents."""
    from .common import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    return search(docs, docs.filter(F.col("doc_id") % EVERY == 0))


SQL_OP2 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), lens AS (SELECT doc_id, len(ws) AS n FROM w), tot AS (SELECT count(*) AS n_docs, sum(n) AS n_words FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
part AS (
  SELECT tf.doc_id, tf.term, CAST(round_even(ln(1 + (n_docs - df + 0.5e0) / (df + 0.5e0)) * (tf * {K1 + 1}e0 / (tf + {K1}e0 * ({1 - B}e0 + {B}e0 * n / (n_words / n_docs)))) * 1e6, 0) AS BIGINT) AS v
  FROM tf JOIN df USING (term) JOIN lens USING (doc_id) CROSS JOIN tot
), scored AS (
  SELECT q.doc_id AS query_id, p.doc_id, sum(p.v) AS s FROM tf q JOIN part p USING (term) WHERE q.doc_id % {EVERY} = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS rank FROM scored WHERE s > 0)
SELECT query_id, doc_id, rank, CAST(s AS DOUBLE) / 1e6 AS score FROM ranked WHERE rank <= {K}"""

QUERIES = {"op2_topk_search": op2_topk_search}
SQL = {"op2_topk_search": SQL_OP2}
