"""Ranked lexical search, term at a time over short lists, then document at a time over long ones.

Terms are the maximal runs of ASCII letters and digits and of characters beyond
ASCII; only A-Z are lower-cased.  With N documents that hold a term, L terms in
all, n terms in a document, df documents with the term and tf occurrences in
the document, a term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), and a
document scores the sum over the query's distinct terms of
w * ((10^9 tf) div (1000 tf + 8 m)), m = 10 + (90 n N) div L, in 64-bit integers.

The index is a table with a row per document: its id, n, and the numbers and
counts of those of its terms that some query holds.  A task reads it in segments
of at most ``SEGMENT_POSTINGS`` postings and turns each into lists by term, in
order of doc_id.  Of a query's lists in a segment those with at most ``SHORT`` of
its documents are read term at a time into summed accumulators, kept by document.
From then on the accumulators are one more iterator beside the long lists, with a
bound per window of ``WINDOW`` documents like theirs.  The windows are visited in
order of documents; one is skipped if the bounds of all iterators together do not
reach the k-th best score so far, which starts at the k-th best accumulator.  The
best k of a task go on from segment to segment; those of all tasks are merged in
two steps.  No bound is estimated: the result is that of scoring every document.

Scale: only queries travel, in blocks of at most ``BLOCK_BYTES`` of text, each
one pass over the documents; documents never shuffle.  Any number of documents
may hold a term: lists exist by segment only.

Defined results: null or term-less documents and queries have no rows; repeated
and null ids are documents and queries of their own (doc_id is returned as given,
null after all others among equal scores); equal scores are ranked by doc_id.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import discard, materialize, prepare_workers, read_table

TOP = 10
SEGMENT_POSTINGS = 1_000_000
WINDOW = 64                  # documents
SHORT = 1 / 16               # of a segment's documents
BATCH_WINDOWS = 16           # visited before the threshold is looked at again
BLOCK_BYTES = 4 << 20
MERGE_GROUPS = 256
NO_ID = np.iinfo(np.int64).max   # sorts null ids last, inside a segment

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


# ------------------------------------------------------------------ one segment
class Segment:
    """Lists of a lot of documents in order of doc_id; per list the contributions and their maxima by window."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, counts: np.ndarray, term: np.ndarray, tf: np.ndarray,
                 weight: np.ndarray, n_docs: int, n_terms: int):
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        self.ids = ids[order]
        m = 10 + (90 * length * n_docs) // n_terms
        doc = np.repeat(np.arange(len(ids)), counts)
        value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        by = np.lexsort((place[doc], term))
        self.doc, self.value = place[doc][by], value[by]
        self.terms, self.start = np.unique(term[by], return_index=True)
        self.stop = np.append(self.start[1:], len(by))
        self.at = {int(t): i for i, t in enumerate(self.terms)}
        self.n_windows = -(-len(ids) // WINDOW)
        self.long: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window's postings begin, and the largest value in each window."""
        edge = np.searchsorted(doc, np.arange(self.n_windows + 1) * WINDOW)
        most = np.zeros(self.n_windows, np.int64)
        full = np.flatnonzero(edge[1:] > edge[:-1])
        if len(full):
            most[full] = np.maximum.reduceat(value, edge[full])
        return edge, most

    def list_windows(self, i: int):
        if i not in self.long:
            self.long[i] = self.windows(self.doc[self.start[i]:self.stop[i]], self.value[self.start[i]:self.stop[i]])
        return self.long[i]

    def search(self, query: np.ndarray, best: list[tuple[int, int]], top: int) -> list[tuple[int, int]]:
        """The best ``top`` of ``best`` and this segment, as (-score, doc_id), in order."""
        lists = [i for i in map(self.at.get, query.tolist()) if i is not None]
        limit = max(1, int(SHORT * len(self.ids)))
        short = [i for i in lists if self.stop[i] - self.start[i] <= limit]
        far = [i for i in lists if self.stop[i] - self.start[i] > limit]
        iterators = []
        floor = -best[-1][0] if len(best) == top else 1
        if short:                                           # term at a time: summed accumulators, by document
            doc = np.concatenate([self.doc[self.start[i]:self.stop[i]] for i in short])
            value = np.concatenate([self.value[self.start[i]:self.stop[i]] for i in short])
            doc, where = np.unique(doc, return_inverse=True)
            total = np.zeros(len(doc), np.int64)
            np.add.at(total, where, value)
            if len(total) >= top:
                floor = max(floor, int(np.partition(total, len(total) - top)[len(total) - top]))
            iterators.append((doc, total, *self.windows(doc, total)))
        iterators += [(self.doc[self.start[i]:self.stop[i]], self.value[self.start[i]:self.stop[i]], *self.list_windows(i)) for i in far]
        if not iterators:
            return best
        bound = sum(x[3] for x in iterators)
        todo = np.flatnonzero(bound >= floor)
        while len(todo):                                    # document at a time, window by window
            now, todo = todo[:BATCH_WINDOWS], todo[BATCH_WINDOWS:]
            score = np.zeros(len(now) * WINDOW, np.int64)
            for doc, value, edge, _ in iterators:
                size = edge[now + 1] - edge[now]
                got = np.repeat(edge[now] - np.cumsum(size) + size, size) + np.arange(size.sum())
                score[doc[got] - np.repeat((now - np.arange(len(now))) * WINDOW, size)] += value[got]
            found = np.flatnonzero(score >= floor)
            if len(found) > top:                            # of equal scores the first documents, those with the least ids
                found = found[np.argsort(-score[found], kind="stable")[:top]]
            if len(found):
                ids = self.ids[now[found // WINDOW] * WINDOW + found % WINDOW]
                best = sorted([*best, *zip((-score[found]).tolist(), ids.tolist())])[:top]
                if len(best) == top and -best[-1][0] > floor:
                    floor = -best[-1][0]
                    todo = todo[bound[todo] >= floor]
        return best


# ------------------------------------------------------------------ jobs
def _index(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n, term (numbers), tf of every document with a term."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(vocabulary)          # at most BLOCK_BYTES of terms
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(sent.value)}
        for b in batches:
            keep, n, term, tf = [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                words = terms(text)
                if words:
                    count = {number[t]: c for t, c in Counter(words).items() if t in number}
                    keep.append(i), n.append(len(words)), term.append(list(count)), tf.append(list(count.values()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())),
                                              pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return d.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<long>")


def _answers(index: DataFrame, queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """query (its number in the block), doc_id, score: the best ``top`` of each task."""
    sent = index.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]
        lot: list[pa.RecordBatch] = []

        def close() -> None:
            t = pa.Table.from_batches(lot).combine_chunks()
            lot.clear()
            lists = t.column("term").chunk(0)
            seg = Segment(t.column("doc_id").fill_null(NO_ID).to_numpy(), t.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()),
                          lists.flatten().to_numpy().astype(np.int64), t.column("tf").chunk(0).flatten().to_numpy(), w, n_docs, n_terms)
            for k, q in enumerate(asked):
                best[k] = seg.search(q, best[k], top)

        held = 0
        for b in batches:
            sizes = np.cumsum(np.diff(b.column(2).offsets.to_numpy()) + 1)
            lo = 0
            while lo < b.num_rows:                           # a batch may hold several segments
                done = sizes[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + SEGMENT_POSTINGS - held, "right")))
                lot.append(b.slice(lo, hi - lo))
                held += int(sizes[hi - 1] - done)
                lo = hi
                if held >= SEGMENT_POSTINGS or lo < b.num_rows:
                    close()
                    held = 0
        if lot:
            close()
        rows = [(k, None if d == NO_ID else d, -s) for k, found in enumerate(best) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64()))], names=["query", "doc_id", "score"])

    return index.select("doc_id", "n", "term", "tf").mapInArrow(run, "query int, doc_id long, score long")


def _merged(rows: DataFrame, top: int) -> DataFrame:
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    part = rows.withColumn("_g", F.spark_partition_id() % MERGE_GROUPS)
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("query", "_g").orderBy(*order))).where(F.col("rank") <= top)
    return part.select("query", "doc_id", "score", F.row_number().over(Window.partitionBy("query").orderBy(*order)).alias("rank")).where(F.col("rank") <= top)


def query_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Lists of (id, text), by a hash of the row, each of about BLOCK_BYTES of text at most (a longer text alone)."""
    q = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    size = q.agg(F.sum(F.octet_length("t").cast("long")).alias("s")).first().s or 0
    blocks = 1 + 2 * size // BLOCK_BYTES
    if blocks == 1:
        rows = [tuple(r) for r in q.collect()]
        if rows:
            yield rows
        return
    for k in range(blocks):
        held, lot = 0, []
        for r in q.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k).toLocalIterator():
            if lot and held + len(r.t) > BLOCK_BYTES:
                yield lot
                held, lot = 0, []
            lot.append(tuple(r))
            held += len(r.t)
        if lot:
            yield lot


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0."""
    spark = docs.sparkSession
    prepare_workers(spark)
    schema = StructType([items.select(F.col(item_col).alias("item_id")).schema["item_id"], *StructType.fromDDL("rank int, doc_id long, score long").fields])
    out = None
    for block in query_blocks(items, item_col, item_text_col):
        asked = [sorted(set(terms(t))) for _, t in block]
        vocabulary = sorted(set().union(*asked))
        if not vocabulary:
            continue
        number = {t: i for i, t in enumerate(vocabulary)}
        index = materialize(_index(docs, id_col, text_col, vocabulary), "search-index")
        n_docs, n_terms = index.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            discard(index)
            return spark.createDataFrame([], schema)
        df = np.zeros(len(vocabulary), np.int64)
        for r in index.select(F.explode("term").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toLocalIterator():
            df[r.t] = r.n                                    # a number per term of the block
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        rows = _answers(index, [np.array([number[t] for t in q], np.int64) for q in asked], weight, n_docs, n_terms, top)
        found = materialize(_merged(rows, top), "search-found", True)
        discard(index)
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(block)], StructType([*StructType.fromDDL("q int").fields, schema["item_id"]]))
        got = found.join(ids, F.col("query") == F.col("q")).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = got if out is None else out.union(got)
    return spark.createDataFrame([], schema) if out is None else out


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
#: The same ranking by scoring every pair of item and document with a common term.
SQL = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_TERM})) AS t FROM documents),
p AS (SELECT r, t, any_value(doc_id) AS doc_id, count(*) AS tf FROM d GROUP BY r, t),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
g AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM l),
q AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all({_LOWER.format('text')}, {_TERM})) AS t FROM (SELECT row_number() OVER () AS i, * FROM benchmark)),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY t, n_docs),
s AS (SELECT i, item_id, p.r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
      FROM q JOIN p USING (t) JOIN w USING (t) JOIN l ON l.r = p.r, g GROUP BY i, item_id, p.r, doc_id),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10"""
