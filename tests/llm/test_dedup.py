"""Jaccard join, vector links, components, archives and the pipeline."""
import hashlib
import random

import numpy as np
import pytest

from tabwright.llm import euclid_lsh, jaccard_join, warc
from tabwright.llm.common import materialize, scratch_path
from tabwright.llm.components import components
from tests.conftest import SF0001
from tests.llm.data import components as brute_components
from tests.llm.data import docs, odd_rows, shingles


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(x, x + 7) for x in range(200, 260)] + [(5, 5), (300, 301), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if sum(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def nulls_last(row):
    return [(v is None, v or 0) for v in row]


def check_join(spark, rows):
    got = jaccard_join.near_duplicates(docs(spark, rows)).collect()
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    want = [(i, len(s), c if s else i) for i, s, c in zip(ids, sets, brute_components(ids, sets))]
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=nulls_last) == sorted(want, key=nulls_last)


def test_jaccard_join_of_odd_rows(spark):
    check_join(spark, odd_rows(n=140))


def test_jaccard_join_of_null_and_repeated_ids(spark):
    """Groups that each hold a row without id, or one of the same id, are not one group."""
    text = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    check_join(spark, [(5, text[0], None, None), (None, text[0], None, None), (6, text[1], None, None), (None, text[1], None, None),
                       (7, text[2], None, None), (7, text[0], None, None), (None, text[3], None, None), (None, text[3] + " more", None, None), (None, "", None, None)])


def test_jaccard_join_at_the_threshold(spark):
    """Copies with ever more changes: links just at, over and under 0.75, and chains of them."""
    rnd = random.Random(7)
    base = [f"w{i}" for i in range(64)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            ws[rnd.randrange(64)] = rnd.choice(["x", "y", f"z{rnd.randrange(9)}"])
        rows.append((i, " ".join(ws[rnd.randrange(3):]), None, None))
    check_join(spark, rows)


def test_jaccard_join_of_drifting_copies(spark):
    """A chain in which neighbours link and distant members don't: the triangle inequality leaves pairs open."""
    rows, ws = [], [f"a{i}" for i in range(60)]
    for i in range(80):
        ws = ws[1:] + [f"b{i}"]
        rows += [(i, " ".join(ws), None, None), (1000 + i, " ".join(ws[:30] + [f"c{i}"] + ws[30:]), None, None)]
    check_join(spark, rows)


def test_jaccard_join_of_batches_longer_than_what_a_worker_splits_at_once(spark):
    """Each of many texts in one batch has one near copy: all links are found, whatever a worker splits together."""
    n = 3 * jaccard_join.TEXTS_AT_ONCE
    rows = [(2 * i + k, " ".join(f"w{i}x{j}" for j in range(60 + k)), None, None) for i in range(n) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs(spark, rows).coalesce(1)).collect()}
    assert got == {i: i - i % 2 for i in range(2 * n)}


def test_short_lists_name_their_fitting_pairs():
    """Lists of few entries send no rows, but each pair that may be linked; longer lists send their rows."""
    rnd = np.random.default_rng(5)
    k = 400
    h, sid = rnd.integers(0, 90, k).astype(np.uint32), rnd.integers(-50, 50, k)
    n, pos = (40 + sid % 25).astype(np.uint32), rnd.integers(0, 12, k).astype(np.uint16)
    h[:60], sid[:60], n[:60] = 1000, np.arange(60), 50                     # one long list
    lists, ids, _, _, _, _, a, b = jaccard_join.lists_of_part(h, sid, n, pos)
    assert set(lists.tolist()) == {1000} and sorted(ids.tolist()) == list(range(60))
    want = set()
    for x in set(h[60:].tolist()):
        least = {}                                                         # a set's first place in this list
        for i in np.flatnonzero(h == x):
            least[int(sid[i])] = min(least.get(int(sid[i]), (99, 0)), (int(pos[i]), int(n[i])))
        for s, (ps, ns) in least.items():
            for t, (pt, nt) in least.items():
                if s != t and ns <= nt and jaccard_join._fits(ns, ps, nt, pt):
                    want.add((min(s, t), max(s, t)))
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want) > 20


def test_sets_that_many_others_meet_are_compared_in_deals(spark):
    """A set travels once to every PARTNERS of the sets that it is compared with."""
    k = 3 * jaccard_join.PARTNERS
    sets = [np.arange(i, 60 + i // 4, dtype=np.uint64) for i in range(k)]
    table = materialize(spark.createDataFrame([(i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "sid long, hashes binary"), "test-sets")
    pairs = [(0, i) for i in range(1, k)] + [(i, i + 1) for i in range(5, 40)]
    got = jaccard_join.verify(materialize(spark.createDataFrame(pairs, "a long, b long"), "test-pairs"), table).collect()
    want = [(a, b, len(np.intersect1d(sets[a], sets[b])), len(sets[a]), len(sets[b])) for a, b in pairs]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("copies", [1, 40])
def test_sets_travel_only_where_rows_repeat(spark, monkeypatch, copies):
    """Rows that repeat id and text have one set together; other sets are written where they were made."""
    plans, write = {}, jaccard_join.materialize

    def noted(df, tag, *more):
        plans.setdefault(tag, df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag, *more)

    monkeypatch.setattr(jaccard_join, "materialize", noted)
    text = [" ".join(f"{c}{i}" for i in range(50)) for c in "abc"]
    check_join(spark, [(1, text[0], None, None)] * copies + [(2, text[0] + " more", None, None), (3, text[1], None, None), (4, text[1], None, None),
                       (5, text[1] + " end", None, None), (6, text[2], None, None)])
    assert ("Exchange hashpartitioning(sid" in plans["jac-sets"]) == (copies > 1)


def test_jaccard_join_of_crowded_and_short_lists(spark):
    """Many sets behind the same rare words, few of them linked, beside pairs of near copies that meet in short lists only."""
    rnd = random.Random(3)
    head = [f"r{i}" for i in range(25)]
    rows = [(i, " ".join(head + [f"x{rnd.randrange(14)}" for _ in range(40)]), None, None) for i in range(70)]
    for i in range(60):
        ws = [f"p{i}w{j}" for j in range(50 + i % 9)]
        rows += [(100 + 3 * i + k, " ".join(ws[k * (i % 5):]), None, None) for k in range(3)]
    check_join(spark, rows)


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0
    got = jaccard_join.near_duplicates(docs(spark, [(1, None, None, None), (2, "", None, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 0, 1), (2, 0, 2)]


def test_signatures_never_hide_a_shared_shingle():
    rng = np.random.default_rng(3)
    for n in (1, 5, 80, 3000, 60000):
        a = np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64))
        for share in (0.0, 0.3, 0.8, 1.0):
            b = np.unique(np.concatenate([a[:int(share * len(a))], rng.integers(0, 2 ** 64, n // 2, dtype=np.uint64)]))
            x, y = (np.frombuffer(jaccard_join.signature(s), np.uint8)[None] for s in (a, b))
            most = jaccard_join.most_shared(x, y, len(a), len(b))[0]
            assert len(np.intersect1d(a, b)) <= most <= min(len(a), len(b))


def test_signatures_tell_unlike_texts_apart():
    """Sets of a page's size that share a tenth are known to be unlike, even if their leaders' members stray by ``REACH`` each."""
    rng = np.random.default_rng(4)
    for n in (40, 100, 200, 300):
        a, b = (rng.integers(0, 2 ** 64, n, dtype=np.uint64) for _ in "ab")
        b[:n // 10] = a[:n // 10]
        x, y = (np.frombuffer(jaccard_join.signature(np.unique(s)), np.uint8) for s in (a, b))
        assert len(x) == 128
        shared = jaccard_join.most_shared(x, y, n, n)
        assert 1 - shared / (2 * n - shared) - 2 * jaccard_join.REACH > 0.25


def test_overlap_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            least = next((o for o in range(a + 1) if 100 * o >= 75 * (a + b - o)), None)
            assert (least is None) == (100 * a < 75 * b)
            if least is not None:
                assert jaccard_join.needed(a, b) == least
                assert jaccard_join.probe_length(b) >= b - least + 1 and jaccard_join.index_length(a) >= a - least + 1


# vectors

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, True) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links long, kept boolean")


def brute_vectors(rows):
    x = [np.array([np.nan if c is None else c for c in v], dtype=np.float64) if v else None for _, v in rows]
    ok = [v is not None and np.isfinite(v).all() and v.any() for v in x]
    n, ids = len(rows), [r[0] for r in rows]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(x[i]) == len(x[j])
              and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.95] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in links[i])], key=lambda r: (ids[r] is None, ids[r] or 0, r)) for i in range(n)]
        if new == root:
            break
        root = new
    return sorted(((ids[i], len(links[i]), ids[root[i]]) for i in range(n)), key=nulls_last)


def test_vector_links_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(euclid_lsh, "BLOCK", 16)           # blocks and several tables at this size
    monkeypatch.setattr(euclid_lsh, "OCCUPANCY", 4)
    rng, rows = np.random.default_rng(1), []
    for i in range(40):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.2])).astype(np.float32).tolist()) for k in range(rng.integers(1, 9))]
    hot = rng.standard_normal(16).astype(np.float32)
    rows += [(1000 + k, (hot + 0.1 * rng.standard_normal(16)).astype(np.float32).tolist()) for k in range(60)]
    rows += [(2000 + k, hot.tolist()) for k in range(50)] + [(2100, (2 * hot).tolist())]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [1.0, None] + [0.0] * 14), (3003, [float("nan")] * 16), (3004, [float("inf")] * 16), (3005, []), (3006, hot.tolist()[:8]),
             (3007, [1e30] * 16), (3008, [1e-30] * 16), (3009, [-0.0] + [1.0] * 15), (3010, [0.0] + [1.0] * 15)]
    got = euclid_lsh.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=nulls_last) == brute_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_of_null_and_repeated_ids(spark):
    e = np.eye(8).tolist()
    near = [x + 0.1 for x in e[2]]
    rows = [(1, e[0]), (1, e[1]), (2, e[0]), (3, e[1]), (5, e[2]), (None, near), (6, e[3]), (None, e[3]), (None, e[4]), (None, e[4]), (9, e[5]), (9, e[5]), (None, None)]
    got = euclid_lsh.near_duplicates(vectors(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=nulls_last) == brute_vectors(rows)


def test_collision_probability():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1, 32))
    x /= np.linalg.norm(x)
    d = rng.standard_normal((1, 32))
    d -= (d @ x.T) * x
    y = x * 0.95 + d / np.linalg.norm(d) * np.sqrt(1 - 0.95 ** 2)
    a, b = (euclid_lsh.signatures(v, 1, 20000)[0] for v in (x, y))
    assert (a == b).mean() == pytest.approx(euclid_lsh.collision(np.sqrt(0.1)), abs=0.01)


def test_no_vectors(spark):
    assert euclid_lsh.near_duplicates(vectors(spark, [])).count() == 0
    assert euclid_lsh.near_duplicates(vectors(spark, [(1, None)])).collect()[0][:3] == (1, 0, 1)


# archives

def test_archives_round_trip_odd_pages(spark):
    big, nasty = "copy " * 40, "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\nhttp://a 0.0.0.0 20260101000000 text/html 5\n" * 3
    rows = [(8, "u", "s"), (8, "u", "s"), (20, "u", big), (20, "u", big), (1, "http://a/b c\n", big), (2, None, big), (3, "http://é/", nasty), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (7, "u", big), (1, "u", big),
            (9, "u", nasty), (None, "u", "null id " * 20), (None, "v", big), (12, "u", "z" * 300000), (13, "u", "\n\n \n"), (14, "", "é" * 60)]
    df = spark.createDataFrame([(*r, "x", 3) for r in rows], "page_id long, url string, html string, payload string, refers_to long")
    got = warc.round_trip(df).collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        first = min(same) if len(b) >= 100 and same else i
        more = sum((g or "") == (h or "") for _, _, g in rows) > 1
        kind = ("response", None) if i == first or not more else ("revisit", first)
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), *kind))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by_id = {r.record_id: r for r in got}
    assert len(by_id) == len(got)                         # repeated rows too
    for r in got:
        if r.record_type == "revisit":
            first = by_id[r.refers_to_record]
            assert (first.record_type, first.page_id, first.payload_digest) == ("response", r.refers_to, r.payload_digest)
        else:
            assert r.refers_to_record is None


def test_arc_versions_and_payloads(spark):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"page {i}\n" * i) for i in range(30)], "page_id long, url string, html string").repartition(4)
    path = scratch_path(spark, "arc-test")
    warc.write_arc(df, path)
    recs = warc.read_arc(spark, path).collect()
    assert sorted((r.page_id, r.url, warc.expand(r.squeezed).decode()) for r in recs) == sorted((i, f"http://h/{i}", f"page {i}\n" * i) for i in range(30))
    assert {r.date for r in recs} == {"2026-01-01T00:00:00Z"} and {r.mime for r in recs} == {"text/html"}
    heads = {bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    assert len(heads) == 4 and {len(next(warc.parse_arc(h))) for h in heads} == {6, 11}        # the fields of both versions, and the body


def test_arc_errors():
    block = b"1 0 x\n" + warc.ARC_FIELDS[1].encode() + b"\n"
    start = b"filedesc://x 0.0.0.0 20260101000000 text/plain %d\n" % len(block) + block + b"\n"
    assert list(warc.parse_arc(b"")) == [] and list(warc.parse_arc(start)) == []
    ok = list(warc.parse_arc(start + b"http://a b c 1.2.3.4 2026 text/html 3\nabc\n"))
    assert [(r["URL"], r["body"]) for r in ok] == [("http://a b c", b"abc")]
    for bad in (b"no version block\n", start + b"http://a 1.2.3.4 2026 text/html 9\nabc\n", start.replace(b"1 0 x", b"9 0 x")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad))


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# the pipeline

def test_pipeline_stages_by_brute_force(spark):
    import corpus_pipeline

    from tabwright.llm import langid, pii
    from tests.llm.data import WORD
    from tests.llm.test_text import base_by_regex

    rows = odd_rows(n=90) + [(500, "write to me.now@mail.example.org or 4844508665317339 please", "en", "a"), (501, "0123 4567 ...", "en", "a")]
    rows = [(*r[:2], r[2] or "en", r[3]) for r in rows]
    start = docs(spark, rows)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "personal_data", "mix_sources", "pack"]

    one = materialize(stages["language_id"](spark, start, SF0001), "t1")
    assert one.columns == start.columns
    pred = {(r.doc_id, r.lang_pred, r.score) for r in langid.predict(start, langid.train(start)).collect()}
    gone = {i for i, p, s in pred if p == "und" or s < corpus_pipeline.LEAST_SCORE}
    assert {0, 1, 2, 3, 501} <= gone
    left = sorted((r.doc_id, r.text) for r in one.where("doc_id IS NOT NULL").collect())
    assert left == sorted((i, t) for i, t, *_ in rows if i is not None and i not in gone)

    two = materialize(stages["near_duplicates"](spark, one, SF0001), "t2")
    kept = one.collect()
    ids, sets = [-1 if r.doc_id is None else r.doc_id for r in kept], [shingles(r.text) for r in kept]
    want = {i for i, c in zip(ids, brute_components(ids, sets)) if i == c}
    got = [-1 if r.doc_id is None else r.doc_id for r in two.collect()]
    assert two.columns == start.columns and sorted(got) == sorted(want)

    three = materialize(stages["personal_data"](spark, two, SF0001), "t3")
    before = {r.doc_id: r for r in two.collect()}
    assert three.columns == start.columns and three.count() == len(before)
    for r in three.collect():
        assert not base_by_regex(r.text) and r.n_chars == len(r.text)
        if not base_by_regex(before[r.doc_id].text) and not pii.regions(before[r.doc_id].text):
            assert r.text == before[r.doc_id].text
    assert three.where("doc_id = 500").first().text == "write to [EMAIL] or [CARD] please"

    four = materialize(stages["mix_sources"](spark, three, SF0001), "t4")
    words = lambda df: sum(len(WORD.findall(r.text)) for r in df.collect())
    assert four.columns == start.columns and words(four) == pytest.approx(1.5 * words(three), rel=0.1)
    assert max(r["count"] for r in four.groupBy("doc_id").count().collect()) <= 2

    five = stages["pack"](spark, four, SF0001).collect()
    assert {r.doc_id for r in five} == {r.doc_id for r in four.collect()}
    assert sum(r.start == 0 for r in five) == four.count()


def test_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    d = docs(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        d = materialize(stage(spark, d, SF0001), f"empty-{name}")
        assert d.count() == 0


def test_pipeline_runs_and_its_decisions_take_effect(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, SF0001).collect()
    ids = {r.doc_id for r in got}
    d = spark.read.parquet(f"{SF0001}/documents.parquet").collect()
    groups = brute_components([r.doc_id for r in d], [shingles(r.text) for r in d])
    assert ids <= set(groups) and len(ids) > 0.6 * len(set(groups))


def test_pipeline_keeps_unlike_texts_of_null_and_repeated_ids(spark):
    import corpus_pipeline

    rnd = random.Random(4)
    text = lambda: " ".join(f"w{rnd.randrange(5000)}" for _ in range(40))
    a, b, c, d, e, f, g = (text() for _ in range(7))
    rows = [(None, a, "en", "a"), (None, b, "en", "a"), (None, b, "en", "b"), (None, b, "en", "b"),      # no ids
            (7, c, "en", "a"), (7, d, "en", "a"), (7, d, None, "en"), (7, d, "en", None),                # an id with two texts
            (3, e, "en", "a"), (8, e + " more", "en", "a"), (8, f, "en", "a"),                          # one of them a copy of a smaller id's
            (9, g, "en", "a"), (9, g, "en", "a"), (10, g, "en", "a"), (None, c + " x", "en", "a")]
    start = docs(spark, rows)
    runs = [sorted(map(tuple, corpus_pipeline.near_duplicates(spark, start.repartition(k), SF0001).collect()), key=str) for k in (1, 3)]
    assert runs[0] == runs[1]
    assert sorted(((-1 if r[0] is None else r[0]), r[1]) for r in runs[0]) == sorted([(-1, a), (-1, b), (-1, c + " x"), (7, d), (3, e), (8, f), (9, g)])
