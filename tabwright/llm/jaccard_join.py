"""Exact Jaccard self-join of word shingles, by skipping and by set relations.

A document's set is its distinct runs of five lower-cased words.  Equal sets
are one class from the start.  All sets are ordered by one global order of
shingles, rare ones first (counts come from a fixed-size table of hashed
counters over all documents; a wrong count costs time, never a link).  Two
sets that link must meet in the inverted list of a shingle early in both, so
only the first quarter of each set is indexed.

Index-level skipping: a list is kept by set size and position; an entry skips
every block of the list whose sizes are out of range, or whose positions leave
too few shingles behind them for the overlap that the sizes ask for.

Answer-level skipping: lists are first answered for one partner per entry
only, the first of fitting size; lists in which many components still meet are
answered again for another partner, round by round.  A set then has a leader (its most similar
partner) at an exactly known Jaccard distance, and a component.  Within a list
whose entries are one component nothing is left to ask.  Elsewhere the
leaders of different components are compared; as the Jaccard distance obeys
the triangle inequality, the answer of a set follows from that of its leader
unless the distances leave it open, and only open pairs are compared
themselves.  So a group of thousands of near copies costs a comparison per
member, and no link between different sets is lost.

Spark moves few large rows: workers ship postings packed by hash range, sets
travel as binary.  Positions of lists, links and components stay distributed.

Null text, or text without words, has an empty set (n_shingles 0) and is its
own component; under five words the whole sequence is the one shingle.  Rows
are told apart by a digest of id and text: rows that repeat an id, or have none,
are documents of their own.  Ids are returned as given; a component is named by
its smallest id, null if none of its rows has one.  Other columns are not read.

Most lists are short: the task that answers a list of at most SHORT entries names
its fitting pairs at once, and leaders stand for the ends of these pairs, so that
only longer lists travel as rows, are asked again and are sorted by list.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_small, materialize, prepare_workers
from .components import components

WORDS = 5
PERCENT = 75
COUNTERS = 22          # log2 of the table of hashed counters
CHUNKS = 256           # of that table, to add it up
DOCS_PER_PART = 2000
SHORT = 16             # entries of a list whose fitting pairs are named at once
CROWD = 24             # components in a list from which stars are tried before leaders
STAR_ROUNDS = 8
REACH = 0.17           # a leader is this near at most; other sets are their own leaders
STAR_WORTH = 20        # a round is worth another if one in so many of its pairs links
PARTNERS = 64          # sets that meet one copy of another to be compared
FLUSH = 400_000        # postings a worker holds before it ships them
REMEMBERED = 20_000    # words a worker keeps: more save no time and stay in workers that are used again
SIGNATURE = 10         # log2 of the bits of a set's signature
TEXTS_AT_ONCE = 128    # split into words together: a worker's memory grows with them
_B = 0x9E3779B97F4A7C15


class Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = h
        return h


_hashes: dict = {}


def remembered() -> Hashes:
    return _hashes.setdefault("words", Hashes())


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values, by sorting alone."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text (UTF-8, A-Z lower-cased,
    split at exactly space, tab, LF, VT, FF, CR)."""
    get = remembered().__getitem__
    lists = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    size = [len(ws) for ws in lists]
    flat = np.fromiter(map(get, chain.from_iterable(lists)), np.uint64, sum(size))
    many = np.zeros(max(0, len(flat) - words + 1), dtype=np.uint64)
    for i in range(words):
        many = many * np.uint64(_B) + flat[i:i + len(many)]
    many = mixed(many)
    out, at = [], 0
    for n in size:
        if n >= words:
            out.append(distinct(many[at:at + n - words + 1]))
        elif n:
            h = 0
            for x in flat[at:at + n].tolist():
                h = (h * _B + x + n) % (1 << 64)
            out.append(mixed(np.array([h ^ 0x5851F42D4C957F2D], dtype=np.uint64)))
        else:
            out.append(np.array([], dtype=np.uint64))
        at += n
    return out


def set_id(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def signature(s: np.ndarray) -> bytes:
    """Whether an odd number of shingles falls into each of 2^SIGNATURE ranges of the hash."""
    return np.packbits(np.bincount((s >> np.uint64(64 - SIGNATURE)).astype(np.int64), minlength=1 << SIGNATURE).astype(np.uint8) & 1).tobytes()


def most_shared(x: np.ndarray, y: np.ndarray, nx, ny) -> np.ndarray:
    """No two sets of these signatures and sizes share more: a range odd in one only holds a shingle of one only."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return np.minimum((nx + ny - apart) // 2, np.minimum(nx, ny))


def needed(a, b, percent: int = PERCENT):
    """Least overlap of linked sets of sizes a and b: 100 o >= percent (a + b - o)."""
    return -(-percent * (a + b) // (100 + percent))


def probe_length(n, percent: int = PERCENT):
    """A set with a partner of any size shares a shingle with it among so many first ones."""
    return n - -(-percent * n // 100) + 1


def index_length(n, percent: int = PERCENT):
    """The same for a partner that is not smaller."""
    return n - needed(n, n, percent) + 1


def _table(names: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names.split())


def scan_sets(docs: DataFrame) -> DataFrame:
    """kind 0: doc_id, key, sid, n of every document; kind 1: a chunk of a worker's counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTERS, dtype=np.uint16)
        any_row = False
        for b in batches:
            any_row = True
            texts, sids, sizes = b.column(1).to_pylist(), [], []
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                sets = shingle_sets(texts[lo:lo + TEXTS_AT_ONCE])
                sids += [set_id(s) for s in sets]
                sizes += [len(s) for s in sets]
                at, n = np.unique((np.concatenate(sets) >> np.uint64(64 - COUNTERS)).astype(np.uint32), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 65535)
            k = len(texts)
            yield _table("kind doc_id key sid n chunk counts", [np.zeros(k, np.int32), b.column(0), b.column(2), np.array(sids, np.int64), np.array(sizes, np.int64), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())])
        if any_row:
            small, k = np.minimum(counts, 255).astype(np.uint8).reshape(CHUNKS, -1), CHUNKS
            yield _table("kind doc_id key sid n chunk counts", [np.ones(k, np.int32), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), np.arange(k, dtype=np.int32), pa.array([r.tobytes() for r in small], pa.binary())])

    return docs.mapInArrow(run, "kind int, doc_id long, key long, sid long, n long, chunk int, counts binary")


def rarity(scanned: DataFrame) -> np.ndarray:
    """All hashed counters: a table of fixed size (2 x 2^COUNTERS bytes).  Every counter
    holds about as many rare shingles as any other, so it tells shingles apart whose
    count exceeds the spread of that number, a few times its square root."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None

        def done():
            return _table("chunk levels", [np.array([now], np.int32), pa.array([np.minimum(total, 65535).astype(np.uint16).tobytes()], pa.binary())])

        for b in batches:
            for chunk, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if chunk != now:
                    if now is not None:
                        yield done()
                    now, total = chunk, np.zeros(len(raw), dtype=np.int64)
                total += np.frombuffer(raw, dtype=np.uint8)
        if now is not None:
            yield done()

    chunks = scanned.where("kind = 1").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    out = np.zeros((CHUNKS, (1 << COUNTERS) // CHUNKS), dtype=np.uint16)
    for r in chunks.mapInArrow(add, "chunk int, levels binary").toLocalIterator():
        out[r.chunk] = np.frombuffer(r.levels, dtype=np.uint16)
    return out.reshape(-1)


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """A set's keys in the global order, rare shingles first: 16 bits of rarity, then 48 of the hash (shingles of one key share a list)."""
    return np.sort((levels[(s >> np.uint64(64 - COUNTERS)).astype(np.int64)].astype(np.uint64) << np.uint64(48)) | (s >> np.uint64(16)))


def postings(docs: DataFrame, levels, part_bits: int) -> DataFrame:
    """(part, hashes, sids, sizes, positions): packed postings of the first shingles of every different set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = levels.value, set()

        def ship(held):
            h = np.concatenate([x[0] for x in held])
            count = [len(x[0]) for x in held]
            sid = np.repeat(np.array([x[1] for x in held], dtype=np.int64), count)
            n = np.repeat(np.array([x[2] for x in held], dtype=np.uint32), count)
            pos = np.concatenate([np.minimum(np.arange(c), 65535) for c in count]).astype(np.uint16)
            part = ((h >> np.uint64(32)) & np.uint64((1 << part_bits) - 1)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            h, sid, n, pos, part = (h.astype(np.uint32)[order], sid[order], n[order], pos[order], part[order].astype(np.int64))
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            cut = list(zip(edges, edges[1:]))
            return _table("part hashes sids sizes positions", [part[edges[:-1]].astype(np.int32), *(pa.array([c[a:e].tobytes() for a, e in cut], pa.binary()) for c in (h, sid, n, pos))])

        held, size = [], 0
        for b in batches:
            texts = b.column(0).to_pylist()
            for lo in range(0, len(texts), TEXTS_AT_ONCE):
                for s in shingle_sets(texts[lo:lo + TEXTS_AT_ONCE]):
                    if not len(s) or (i := set_id(s)) in seen:
                        continue
                    seen.add(i)
                    held.append((ordered(s, table)[:probe_length(len(s))].copy(), i, len(s)))     # a view would hold the whole set
                    size += len(held[-1][0])
                    if size >= FLUSH:
                        yield ship(held)
                        held, size = [], 0
        if held:
            yield ship(held)

    return docs.select("text").mapInArrow(run, "part int, hashes binary, sids binary, sizes binary, positions binary")


def _fits(n_small, pos_small, n_large, pos_large):
    """May an entry of each size and position, meeting here first, be linked?"""
    return ((100 * n_small >= PERCENT * n_large) & (pos_small < index_length(n_small))
            & (1 + np.minimum(n_small - pos_small - 1, n_large - pos_large - 1) >= needed(n_small, n_large)))


def lists_of_part(h: np.ndarray, sid: np.ndarray, n: np.ndarray, pos: np.ndarray):
    """Rows (list, sid, n, pos) of the longer lists that can link sets, pairs (first fitting, sid)
    of all lists, and the fitting pairs of the short ones."""
    order = np.lexsort((pos, sid, (h.astype(np.uint64) << np.uint64(32)) | n))
    h, sid, n, pos = h[order], sid[order], n[order].astype(np.int64), pos[order].astype(np.int64)
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
    h, sid, n, pos = h[fresh], sid[fresh], n[fresh], pos[fresh]
    same = h[1:] == h[:-1]
    near = same & (100 * n[:-1] >= PERCENT * n[1:])      # a neighbour of fitting size
    live = np.zeros(len(h), dtype=bool)
    live[1:] |= near
    live[:-1] |= near
    h, sid, n, pos = h[live], sid[live], n[live], pos[live]
    if not len(h):
        return h, sid, n, pos, sid, sid, sid, sid
    # block skip by size: the first entry of the list that is large enough
    block = np.cumsum(np.concatenate([[0], (h[1:] != h[:-1]).astype(np.int64)]))
    wide = int(n.max()) + 1
    at = np.searchsorted(block * wide + n, block * wide - (-PERCENT * n // 100))
    # skip by position: entries that leave too few shingles are no answer here
    ok = (at < np.arange(len(h))) & _fits(n[at], pos[at], n, pos)
    i = np.flatnonzero(ok)
    first = _pairs([(sid[at[i]], sid[i])])
    long = np.bincount(block)[block] > SHORT
    met, s = [], np.flatnonzero(~long)
    hs, ns, ps, ids = block[s], n[s], pos[s], sid[s]
    for k in range(1, SHORT):
        if not (same := hs[k:] == hs[:-k]).any():
            break
        x = np.flatnonzero(same)
        y = x + k                                        # not smaller than x
        fit = _fits(ns[x], ps[x], ns[y], ps[y]) | ((ns[x] == ns[y]) & _fits(ns[y], ps[y], ns[x], ps[x]))
        x, y = x[fit], y[fit]
        met.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
    return h[long], sid[long], n[long], pos[long], *first, *_pairs(met)


def _pairs(some: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of ids."""
    if not sum(len(a) for a, _ in some):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = (np.concatenate(c) for c in zip(*some))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
    return a[new], b[new]


def answer_lists(packed: DataFrame) -> DataFrame:
    """kind 0: rows (list, sid, n, pos) of the longer lists; kind 1: first pairs (a in list's place, b in sid's);
    kind 2: pairs of short lists (a in list's place, b in sid's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part, rows):
            h, sid, n, pos = (np.concatenate([np.frombuffer(r[c], dtype=t) for r in rows]) for c, t in enumerate((np.uint32, np.int64, np.uint32, np.uint16)))
            h, sid, n, pos, a, b, c, d = lists_of_part(h, sid, n, pos)
            rest = np.zeros(len(a) + len(c), np.int64)
            return _table("kind list sid n pos", [
                np.repeat(np.arange(3, dtype=np.int32), [len(h), len(a), len(c)]),
                np.concatenate([(np.int64(part) << np.int64(32)) | h.astype(np.int64), a, c]), np.concatenate([sid, b, d]),
                np.concatenate([n.astype(np.int64), rest]), np.concatenate([pos.astype(np.int64), rest])])

        now, held = None, []
        for b in batches:
            for part, *cols in zip(*(c.to_pylist() for c in b.columns)):
                if held and part != now:
                    yield done(now, held)
                    held = []
                now = part
                held.append(cols)
        if held:
            yield done(now, held)

    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(run, "kind int, list long, sid long, n long, pos long")


def likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, slack) of set ids whose signatures leave room for sets no further apart than a link's distance and ``slack``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(b.num_rows, -1) for c in (2, 3))
                na, nb = b.column(4).to_numpy(), b.column(5).to_numpy()
                shared = most_shared(x, y, na, nb)
                yield b.select([0, 1]).filter(pa.array(1 - shared / (na + nb - shared) - b.column(6).to_numpy() <= 1 - PERCENT / 100 + 1e-9))

    sig = sets.select("sid", "sig", "n")
    both = pairs.select("a", "b", "slack").join(sig.select(F.col("sid").alias("_a"), F.col("sig").alias("x"), F.col("n").alias("na")), F.col("a") == F.col("_a"))
    both = both.join(sig.select(F.col("sid").alias("_b"), F.col("sig").alias("y"), F.col("n").alias("nb")), F.col("b") == F.col("_b"))
    return both.select("a", "b", "x", "y", "na", "nb", "slack").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, d) of the linked ones among ``pairs``: only those that signatures leave open meet their sets."""
    open_ones = materialize(likely(pairs.withColumn("slack", F.lit(0.0)), sets), "jac-likely", True)
    return verify(open_ones, sets).where(LINKED).select("a", "b", F.expr(DISTANCE).alias("d"))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, na, nb): exact overlap of pairs of set ids (a written table of distinct ones); sets that no pair names stay where they are.

    A set travels once to every PARTNERS sets that are compared with it, followed by these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, x = None, None
        for batch in batches:
            out: list[tuple] = []
            for a, deal, b, own, raw in zip(*(batch.column(c).to_pylist() for c in range(4)), batch.column(4)):
                y = np.frombuffer(raw.as_py(), dtype=np.uint64)
                if own:
                    now, x = (a, deal), y
                elif now == (a, deal):
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    out.append((a, b, int((x[at] == y).sum()), len(x), len(y)))
            yield _table("a b shared na nb", [pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)])

    deals = pairs.groupBy(F.col("a").alias("_a")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("deals"))
    dealt = pairs.join(deals, F.col("a") == F.col("_a")).select("a", F.pmod(F.xxhash64("b"), F.col("deals")).cast("int").alias("deal"), F.col("b").alias("_sid"), F.lit(False).alias("own"))
    asked = materialize(dealt.union(deals.select(F.col("_a").alias("a"), F.explode(F.expr("sequence(0, deals - 1)")), F.col("_a").alias("_sid"), F.lit(True))), "jac-asked", True)
    both = join_small(sets.select("sid", "hashes"), asked, F.col("sid") == F.col("_sid")).select("a", "deal", F.col("_sid").alias("b"), "own", "hashes")
    return both.repartition("a", "deal").sortWithinPartitions("a", "deal", F.col("own").desc()).mapInArrow(run, "a long, b long, shared long, na long, nb long")


LINKED = f"100 * shared >= {PERCENT} * (na + nb - shared)"
DISTANCE = "1 - shared / (na + nb - shared)"


def leader_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): leaders of different components that meet in a list, if their members' sizes and positions may
    fit and the leaders' signatures leave them near enough for a link between members of this list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            label, leader, low, high, pos, size = (np.array(c, dtype=np.int64) for c in list(zip(*held))[:6])
            reach = np.array([r[6] for r in held])
            sig = np.frombuffer(b"".join(r[7] for r in held), np.uint8).reshape(len(held), -1)
            out_a, out_b = [], []
            for i in range(len(label) - 1):
                j = slice(i + 1, None)
                fit = (label[j] != label[i]) & (100 * high[i] >= PERCENT * low[j]) & (100 * high[j] >= PERCENT * low[i])
                fit &= 1 + np.minimum(high[i] - pos[i] - 1, high[j] - pos[j] - 1) >= needed(low[i], low[j])
                own, other = pos[i] < index_length(high[i]), pos[j] < index_length(high[j])
                fit &= np.where(high[i] < low[j], own, np.where(high[j] < low[i], other, own | other))
                k = i + 1 + np.flatnonzero(fit)
                shared = most_shared(sig[i], sig[k], size[i], size[k])
                k = k[1 - shared / (size[i] + size[k] - shared) - reach[i] - reach[k] <= 1 - PERCENT / 100 + 1e-9]
                to = leader[k]
                out_a.append(np.minimum(to, leader[i])), out_b.append(np.maximum(to, leader[i]))
            return np.concatenate(out_a), np.concatenate(out_b)

        now, held, found, size = None, [], [], 0
        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if len(held) > 1:
                        found.append(done(held))
                        size += len(found[-1][0])
                    now, held = key, []
                held.append(row)
                if size > 500_000:
                    pair = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found)]), axis=0)
                    yield _table("a b", [pair[:, 0], pair[:, 1]])
                    found, size = [], 0
        if len(held) > 1:
            found.append(done(held))
        if found:
            pair = np.unique(np.column_stack([np.concatenate(x) for x in zip(*found)]), axis=0)
            yield _table("a b", [pair[:, 0], pair[:, 1]])

    per = rows.groupBy("list", "label", "leader").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"), F.max("d").alias("reach"))
    own = sets.select(F.col("sid").alias("_leader"), F.col("n").alias("size"), "sig")
    per = per.join(own, F.col("leader") == F.col("_leader")).select("list", "label", "leader", "low", "high", "pos", "size", "reach", "sig")
    return per.repartition("list").sortWithinPartitions("list", "leader").mapInArrow(run, "a long, b long").distinct()


def open_pairs(rows: DataFrame, undecided: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): members of undecided leader pairs that the triangle inequality and their own signatures leave open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held):
            lab, lead, sid, n, pos = (np.array(c, dtype=np.int64) for c in list(zip(*held))[:5])
            far = np.array([r[5] for r in held])
            sig = np.frombuffer(b"".join(r[6] for r in held), np.uint8).reshape(len(held), -1)
            for i in range(len(lab) - 1):
                j = np.arange(i + 1, len(lab))
                up = n[j] >= n[i]
                j = j[(lab[j] != lab[i]) & np.where(up, _fits(n[i], pos[i], n[j], pos[j]), _fits(n[j], pos[j], n[i], pos[i]))]
                shared = most_shared(sig[i], sig[j], n[i], n[j])
                j = j[100 * shared >= PERCENT * (n[i] + n[j] - shared)]
                if len(j):
                    yield np.column_stack([np.minimum(lead[j], lead[i]), np.maximum(lead[j], lead[i]), np.minimum(sid[j], sid[i]), np.maximum(sid[j], sid[i]), (far[j] + far[i]).view(np.int64)])

        def ship(found):
            rows = np.unique(np.concatenate(found), axis=0)
            return _table("la lb a b slack", [*(rows[:, c] for c in range(4)), np.ascontiguousarray(rows[:, 4]).view(np.float64)])

        now, held, found = None, [], []
        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns)):
                if key != now:
                    if len(held) > 1:
                        found += done(held)
                    now, held = key, []
                    if sum(map(len, found)) > 100_000:
                        yield ship(found)
                        found = []
                held.append(row)
        if len(held) > 1:
            found += done(held)
        if found:
            yield ship(found)

    ends = undecided.select(F.explode(F.array("a", "b")).alias("leader")).distinct()
    near = rows.join(ends, "leader").join(sets.select(F.col("sid").alias("_sid"), "sig"), F.col("sid") == F.col("_sid")).select("list", "label", "leader", "sid", "n", "pos", "d", "sig")
    found = near.repartition("list").sortWithinPartitions("list", "sid").mapInArrow(run, "la long, lb long, a long, b long, slack double").distinct()
    u = undecided.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "distance")
    return (found.join(u, (F.col("la") == F.col("_a")) & (F.col("lb") == F.col("_b")))
            .where(f"distance - slack <= {1 - PERCENT / 100} + 1e-9").select("a", "b").distinct())


def meetings(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, la, lb, slack): pairs of sets in different components with their leaders, la < lb, and the sum of the distances to them."""
    for c in "ab":
        of = facts.select(F.col("_node").alias(f"_{c}"), F.col("label").alias(f"label_{c}"), F.col("leader").alias(f"leader_{c}"), F.col("d").alias(f"d_{c}"))
        pairs = join_small(pairs, of, F.col(c) == F.col(f"_{c}"), "left").withColumns({
            f"label_{c}": F.coalesce(f"label_{c}", c), f"leader_{c}": F.coalesce(f"leader_{c}", c), f"d_{c}": F.coalesce(f"d_{c}", F.lit(0.0))}).drop(f"_{c}")
    return pairs.where("label_a != label_b").select("a", "b", F.least("leader_a", "leader_b").alias("la"), F.greatest("leader_a", "leader_b").alias("lb"), (F.col("d_a") + F.col("d_b")).alias("slack")).distinct()


def labelled(lists: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets with links and their components, these with their leaders, rows of lists with label, leader and distance to it)."""
    label = materialize(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "jac-label", True)
    lead = links.where(F.col("d") <= REACH).groupBy(F.col("b").alias("_sid")).agg(F.min(F.struct("d", F.col("a").alias("leader"))).alias("l"))
    facts = materialize(label.join(lead, F.col("node") == F.col("_sid"), "left").select(
        F.col("node").alias("_node"), F.col("component").alias("label"), F.coalesce("l.leader", "node").alias("leader"), F.coalesce("l.d", F.lit(0.0)).alias("d")), "jac-facts", True)
    rows = join_small(lists, facts, F.col("sid") == F.col("_node"), "left").select(
        "list", "sid", "n", "pos", F.coalesce("label", "sid").alias("label"), F.coalesce("leader", "sid").alias("leader"), F.coalesce("d", F.lit(0.0)).alias("d"))
    return label, facts, materialize(rows, "jac-rows", True)


def star_pairs(rows: DataFrame, r: int) -> DataFrame:
    """(a, b): in lists where many components meet, one entry with each of the others it may link.

    The entry is the one of smallest hash in this round, so that lists with the same
    sets ask for the same pairs: a linear number, however crowded a list is."""
    order = F.struct(F.xxhash64(F.lit(r), "sid").alias("h"), "sid", "label", "n", "pos")
    centre = rows.groupBy("list").agg(F.approx_count_distinct("label").alias("labels"), F.min(order).alias("c")).where(f"labels > {CROWD}")
    centre = materialize(centre.select(F.col("list").alias("_list"), F.col("c.sid").alias("a"), F.col("c.label").alias("_label"), F.col("c.n").alias("_n"), F.col("c.pos").alias("_pos")), "jac-centre", True)
    met = rows.join(centre, (F.col("list") == F.col("_list")) & (F.col("label") != F.col("_label")))
    small, large, p_small, p_large = F.least("n", "_n"), F.greatest("n", "_n"), F.when(F.col("n") <= F.col("_n"), F.col("pos")).otherwise(F.col("_pos")), F.when(F.col("n") <= F.col("_n"), F.col("_pos")).otherwise(F.col("pos"))
    need = F.ceil(F.lit(PERCENT) * (small + large) / (100 + PERCENT))
    fits = (100 * small >= PERCENT * large) & (1 + F.least(small - p_small - 1, large - p_large - 1) >= need)
    return met.where(fits).select("a", F.col("sid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: a row per document."""
    spark = docs.sparkSession
    prepare_workers(spark)
    own_id = F.col(id_col).cast("long")
    d = docs.select(own_id.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(own_id, own_id.isNull(), F.col(text_col)).alias("key"))
    scanned = materialize(scan_sets(d), "jac-scan")
    own = scanned.where("kind = 0").select("doc_id", "sid", "n")
    keys = scanned.where("kind = 0 AND n > 0").groupBy("sid", "key").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(keys.groupBy("sid").agg(F.min("rep").alias("rep"), F.min(F.struct("key", "copies")).alias("k"), F.min("n").alias("n"))
                          .select("sid", "rep", "n", "k.key", "k.copies"), "jac-classes", True)
    levels = spark.sparkContext.broadcast(rarity(scanned))
    part_bits = max(4, min(15, math.ceil(math.log2(max(1, classes.count() / DOCS_PER_PART)))))
    answered = materialize(answer_lists(postings(d, levels, part_bits)), "jac-lists")
    lists = answered.where("kind = 0").select("list", "sid", "n", "pos")
    first, short = (answered.where(f"kind = {k}").select(F.col("list").alias("a"), F.col("sid").alias("b")) for k in (1, 2))
    first = materialize(first.distinct(), "jac-first-pairs", True)
    # the sets that lists name, read again from their documents
    named = answered.select(F.explode(F.when(F.col("kind") == 0, F.array("sid")).otherwise(F.array("list", "sid"))).alias("sid")).distinct()
    named = materialize(named.join(classes, "sid").select("sid", F.col("key").alias("_key"), "copies"), "jac-named", True)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, TEXTS_AT_ONCE):
                some = b.slice(lo, TEXTS_AT_ONCE)
                sets = shingle_sets(some.column(1).to_pylist())
                sid = np.array([set_id(s) for s in sets], dtype=np.int64)
                same = np.flatnonzero(sid == some.column(0).to_numpy())   # rows of one key may differ
                yield _table("sid hashes sig n", [sid[same], pa.array([sets[i].tobytes() for i in same], pa.binary()),
                                                  pa.array([signature(sets[i]) for i in same], pa.binary()), np.array([len(sets[i]) for i in same], np.int64)])

    def packed(named):
        return join_small(d, named, F.col("key") == F.col("_key")).select("sid", "text").mapInArrow(pack, "sid long, hashes binary, sig binary, n long")

    # rows of one id and text are told apart by nothing: only their sets need a shuffle to come once
    sets = packed(named.where("copies = 1"))
    if named.where("copies > 1").limit(1).count():
        sets = sets.union(packed(named.where("copies > 1")).dropDuplicates(["sid"]))
    sets = materialize(sets, "jac-sets")
    links = materialize(linked(first, sets), "jac-first", True)
    tried, label, facts, rows = first, *labelled(lists, links)
    for r in range(STAR_ROUNDS):
        pairs = star_pairs(rows, r).join(tried, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "jac-star", True)
        n_pairs = pairs.count()
        if not n_pairs:
            break
        more = materialize(linked(pairs, sets), "jac-star-links", True)
        if STAR_WORTH * more.count() < n_pairs:      # crowded by sets that are not alike: compare leaders instead
            links = links.union(more)
            label, facts, rows = labelled(lists, links)
            break
        links, tried = links.union(more), tried.union(pairs)
        discard(rows)
        label, facts, rows = labelled(lists, links)
    short = materialize(meetings(short, facts), "jac-meetings", True)
    discard(answered)
    near = likely(short.select("a", "b", F.lit(0.0).alias("slack")), sets)     # the others are answered by their own signatures
    short = materialize(short.join(near, ["a", "b"]), "jac-short", True)
    mixed_lists = materialize(rows.groupBy("list").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select(F.col("list").alias("_list")), "jac-mixed", True)
    rows = materialize(rows.join(mixed_lists, F.col("list") == F.col("_list")).drop("_list"), "jac-open-rows", True)
    among = materialize(short.groupBy(F.col("la").alias("a"), F.col("lb").alias("b")).agg(F.max("slack").alias("slack")), "jac-short-leaders", True)
    leaders = materialize(likely(among, sets).union(leader_pairs(rows, sets)).distinct(), "jac-leader-pairs", True)
    between = materialize(verify(leaders, sets).withColumn("distance", F.expr(DISTANCE)), "jac-leaders", True)
    reach = materialize(facts.groupBy("leader").agg(F.max("d").alias("reach")).where("reach > 0"), "jac-reach", True)
    ra, rb = (reach.select(F.col("leader").alias(f"_{c}"), F.col("reach").alias(f"r{c}")) for c in "ab")
    undecided = materialize(between.where(f"NOT ({LINKED})").join(ra, F.col("a") == F.col("_a"), "left").join(rb, F.col("b") == F.col("_b"), "left")
                            .where(f"distance - coalesce(ra, 0) - coalesce(rb, 0) <= {1 - PERCENT / 100} + 1e-9").select("a", "b", "distance"), "jac-undecided", True)
    more = between.where(LINKED).select("a", "b")
    if undecided.limit(1).count():
        u = undecided.select(F.col("a").alias("_a"), F.col("b").alias("_b"), "distance")
        left = short.join(u, (F.col("la") == F.col("_a")) & (F.col("lb") == F.col("_b"))).where(f"distance - slack <= {1 - PERCENT / 100} + 1e-9").select("a", "b")
        more = more.union(linked(open_pairs(rows, undecided, sets).union(left).distinct(), sets).select("a", "b"))
    # links between components join their labels
    la, lb = (label.select(F.col("node").alias(f"_{c}"), F.col("component").alias(f"l{c}")) for c in "ab")
    joined = (more.join(la, F.col("a") == F.col("_a"), "left").join(lb, F.col("b") == F.col("_b"), "left")
              .select(F.coalesce("la", "a").alias("u"), F.coalesce("lb", "b").alias("v")))
    merged = materialize(components(joined).withColumnRenamed("node", "_label").withColumnRenamed("component", "_to"), "jac-merged", True)
    discard(sets)
    final = classes.join(label.withColumnRenamed("node", "_node"), F.col("sid") == F.col("_node"), "left").select(
        "sid", "rep", F.coalesce("component", "sid").alias("label"))
    final = final.join(merged, F.col("label") == F.col("_label"), "left").select("sid", "rep", F.coalesce("_to", "label").alias("label"))
    least = materialize(final.groupBy("label").agg(F.min("rep").alias("component_id")).withColumnRenamed("label", "_l"), "jac-least", True)
    final = materialize(final.join(least, F.col("label") == F.col("_l")).select(F.col("sid").alias("_sid"), "component_id"), "jac-final", True)
    return own.join(final, F.col("sid") == F.col("_sid"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
