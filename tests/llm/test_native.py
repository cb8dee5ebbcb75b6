"""Quality rules, mixing and sharding: odd rows, empty tables, brute force."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabwright.llm import mixing, quality_rules, sharding
from tests.llm.data import WORD, docs, odd_rows


def measures(text):
    t = text or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    c = Counter(tri)
    covered = {j for i, g in enumerate(tri) if c[g] > 1 for j in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


def test_measures_by_brute_force(spark):
    rnd = random.Random(2)
    rows = odd_rows() + [(100 + i, "".join(rnd.choice(["a ", "b ", "#", "\n", "c\t", "\x0b", " ", "\x1c", "é "]) for _ in range(rnd.randint(0, 80))), None, None) for i in range(150)]
    got = quality_rules.measure(docs(spark, rows)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == sorted(
        ((i, *measures(t)) for i, t, *_ in rows), key=key)


def test_policies_are_masks_and_ablation_counts_sole_failures(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(1, clean, None, None), (2, "too few", None, None), (3, clean.upper(), None, None), (4, " ".join(["a b c"] * 40), None, None), (5, None, None, None),
            (6, " ".join(f"w{i}###" for i in range(80)), None, None)]
    led = quality_rules.ledger(docs(spark, rows)).cache()
    kept = {r.doc_id: r.kept for r in quality_rules.apply_policy(led).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}
    assert {r.doc_id for r in quality_rules.apply_policy(led, "v1").collect() if r.kept} == {1, 3, 6}
    assert {r.doc_id for r in quality_rules.apply_policy(led, ("capitals",)).collect() if not r.kept} == {3}
    ab = {(r.policy, r.rule): (r.n_failed, r.n_only_this, r.n_kept) for r in quality_rules.ablation(led).collect()}
    assert ab["v2", "capitals"] == (1, 1, 1) and ab["v2", "symbols"] == (1, 1, 1) and ab["v1", "few_words"] == (2, 2, 3)


def test_quality_of_an_empty_table(spark):
    assert quality_rules.apply_policy(quality_rules.ledger(docs(spark, []))).count() == 0


def targets(sizes, weights=(3, 1, 2)):
    """Cap and reshare, round after round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: (total - sum(out.values())) * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    return out


def test_mixing_targets_and_takes(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = targets(sizes)
    by_id = {r[0]: r[3] for r in rows}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        if r.doc_id is not None:
            assert r.source_size == sizes[by_id[r.doc_id]] and r.target == pytest.approx(want[by_id[r.doc_id]])
    again = mixing.mix(df.repartition(7)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(got, key=key) == sorted(again, key=key)


def test_mixing_meets_its_targets_and_spreads_a_hot_source(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(["w"] * rnd.randint(1, 60)), None, "hot" if i % 3 else f"s{i % 4}") for i in range(1500)]
    got = mixing.mix(docs(spark, rows, extra=False)).toPandas()
    got["source"] = [rows[i][3] for i in got.doc_id]
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= max(2, 0.001 * g.target.iloc[0])


def test_pareto_inclusion_follows_the_size_measure(spark):
    """Over many seeds, documents four times the size (twice the measure) are drawn twice as often."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 16)), None, s) for i in range(400) for s in "abc"][:1200]
    df = docs(spark, [(k, *r[1:]) for k, r in enumerate(rows)], extra=False).cache()
    small = large = 0
    for seed in range(4):
        for r in mixing.mix(df, weights=(1, 1, 1), share_percent=20, seed=f"t{seed}").collect():
            small += r.size == 4 and r.copies
            large += r.size == 16 and r.copies
    assert 1.6 < large / small < 2.5


def test_mixing_returns_whole_rows(spark):
    df = docs(spark, odd_rows())
    got = mixing.mix(df, rows=True).select("row.*")
    assert got.columns == df.columns and got.count() == df.count()


def test_mixing_an_empty_table(spark):
    assert mixing.mix(docs(spark, [])).count() == 0


def check_shards(rows, got):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_sharding_odd_rows(spark):
    rows = odd_rows()
    check_shards(rows, sharding.assign(docs(spark, rows)).collect())


def test_sharding_balances_and_keeps_groups(spark):
    rnd = random.Random(3)
    rows = [(i, "copy " * 20 if i % 3 == 0 else " ".join(str(rnd.random()) for _ in range(rnd.randint(1, 40))) if i % 7 else f"pair {i // 2}", None, None) for i in range(3000)]
    got = sharding.assign(docs(spark, rows, extra=False)).toPandas()
    check_shards(rows, list(got.itertuples()))
    for c in (got.groupby("shard")["size"].sum(), got.groupby("shard").size()):
        assert c.max() <= 1.02 * c.min()
    groups = got.groupby("text_crc32").shard.nunique()
    hot = zlib.crc32(b"copy " * 20)
    assert groups.drop(hot).max() == 1 and groups[hot] > 1        # only the group of a third of all rows is cut


def test_sharding_keeps_a_group_that_fits(spark):
    """A text that takes nearly half a shard stays in one; repeated ids and rows are rows like others."""
    rows = [(i % 50, "the same words " * 3 if i % 20 == 0 else f"text {i} of its own kind", None, None) for i in range(4000)]
    got = sharding.assign(docs(spark, rows, extra=False)).toPandas()
    check_shards(rows, list(got.itertuples()))
    assert got.groupby("text_crc32").shard.nunique().max() == 1
    size = got.groupby("shard")["size"].sum()
    assert size.max() <= 1.03 * size.min(), size.tolist()


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = odd_rows() + [(None, "x", None, None)] * 3 + [(4, "one two", "en", None)] * 2
    df = docs(spark, rows).withColumnRenamed("shard", "other")
    sharding.write_shards(df, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert Counter((r.doc_id, r.text, r.source) for r in back.collect()) == Counter((i, t, s) for i, t, _, s in rows)
    assert set(back.columns) == {*df.columns, "shard"}


def test_place_by_brute_force():
    rng = np.random.default_rng(1)
    items = rng.integers(1, 100, (200, 3)).astype(float)
    v = items * 8 / items.sum(axis=0)
    left, want = [[1.0] * 3 for _ in range(8)], {}
    for i in sorted(range(200), key=lambda i: (-v[i].max(), i)):
        score = [sum(a * b for a, b in zip(x, v[i])) for x in left]
        room = [s for s in range(8) if left[s][0] >= v[i][0]]
        s = max(room, key=lambda s: (round(score[s], 12), -s)) if room else max(range(8), key=lambda s: (left[s][0], -s))
        want[i] = s
        left[s] = [a - b for a, b in zip(left[s], v[i])]
    assert sharding.place(items, 8) == [want[i] for i in range(200)]


def test_sharding_an_empty_table(spark):
    assert sharding.assign(docs(spark, [])).count() == 0


@pytest.mark.parametrize("crowd", [50_000, 7])
def test_mixing_draws_equal_rows_one_by_one(spark, monkeypatch, crowd):
    """Rows that repeat an id, or have none, are documents like others: targets are met."""
    monkeypatch.setattr(mixing, "COPIES_PER_LOT", crowd)
    ten = " ".join(["w"] * 10)
    rows = [(7, ten, None, "a")] * 400 + [(i, ten + f" x{i}", None, "b") for i in range(300)] + [(None, ten + f" y{i % 200}", None, "c") for i in range(310)]
    rows += [(9, ten + f" z{i}", None, "a") for i in range(50)]
    got = mixing.mix(docs(spark, rows, extra=False)).toPandas()
    assert len(got) == len(rows)
    for _, g in got.groupby("source_size"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 11
    whole = mixing.mix(docs(spark, rows, extra=False), rows=True).select("row.source", "taken", "target", "copies", "size").toPandas()
    assert len(whole) == len(rows) and (whole.taken <= 2 * whole["size"]).all()
    assert sorted(whole.groupby("source").taken.sum()) == sorted(got.groupby("source_size").taken.sum())
    again = mixing.mix(docs(spark, rows, extra=False).repartition(5)).toPandas()
    cols = ["doc_id", "size", "taken"]
    assert got[cols].fillna(-1).sort_values(cols).values.tolist() == again[cols].fillna(-1).sort_values(cols).values.tolist()
