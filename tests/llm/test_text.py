"""Language ID, personal data, packing and language model: odd rows, empty tables, brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabwright.llm import bloom_lm, langid, packing, pii
from tests.conftest import SF001
from tests.llm.data import LOWER, WORD, docs, odd_rows


# language ID

def test_forward_sums_all_segmentations(monkeypatch):
    pieces = ["a", "b", "ab", "ba", "abc", langid.SPACE, langid.SPACE + "a", "c"]
    lat, rng = langid.Lattice(pieces), np.random.default_rng(0)
    prob = rng.random((len(pieces) + 2, 2))
    prob[-1] = 0

    def brute(w):
        total = [np.ones(2)]
        for j in range(1, len(w) + 1):
            total.append(sum((total[j - k] * prob[pieces.index(w[j - k:j]) if w[j - k:j] in pieces else len(pieces)]
                              for k in range(1, min(j, 3) + 1) if w[j - k:j] in pieces or k == 1), np.zeros(2)))
        return np.log(total[-1])

    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcxé") for _ in range(rnd.randint(1, 14))) for _ in range(200)] + ["abcx" * 11]
    assert np.allclose(langid.word_scores(words, lat, prob), [brute(langid.SPACE + w) for w in words])
    for part in (7, 50, 4096):                            # long runs are walked in parts, segmentations over an edge summed too
        monkeypatch.setattr(langid, "PART", part)
        long = ["".join(rnd.choice("abcxé") for _ in range(k)) for k in (48, 49, 100, 151, 300)]
        assert np.allclose(langid.word_scores(long, lat, prob), [brute(langid.SPACE + w) for w in long])


def test_expected_counts_of_long_runs(monkeypatch):
    """Walked part by part as summed side by side."""
    pieces = ["a", "b", "ab", "ba", "abc", langid.SPACE, langid.SPACE + "a", "c"]
    lat, rnd = langid.Lattice(pieces), random.Random(3)
    prob = np.random.default_rng(1).random((len(pieces) + 2, 2))
    prob[-1] = 0
    words = ["".join(rnd.choice("abcx") for _ in range(k)) for k in (60, 99, 200, 5)]
    counts = np.array([[1., 2.], [3., 0.], [1., 1.], [0., 2.]])
    monkeypatch.setattr(langid, "BATCHED", 1000)
    want = langid.expected(words, counts, lat, prob)
    monkeypatch.setattr(langid, "BATCHED", 48)
    for part in (5, 33, 4096):
        monkeypatch.setattr(langid, "PART", part)
        assert np.allclose(langid.expected(words, counts, lat, prob), want)


def test_all_pieces_take_part_and_words_split_alike():
    found = langid.vocabulary()
    assert max(map(len, found)) > 12 and langid.SPACE + "international" in found
    assert langid._WORD.findall("a\u00a0b c\x1cd\n") == ["a\u00a0b", "c\x1cd"]


def test_expected_counts_by_enumeration():
    pieces = ["a", "b", "ab", langid.SPACE, langid.SPACE + "a"]
    lat, prob = langid.Lattice(pieces), np.array([[.1, .3], [.2, .1], [.3, .2], [.2, .2], [.1, .1], [.1, .1], [0, 0]])

    def paths(w):
        if not w:
            yield [], np.ones(2)
        for k in range(1, min(2, len(w)) + 1):
            q = pieces.index(w[:k]) if w[:k] in pieces else len(pieces) if k == 1 else None
            if q is not None:
                for rest, v in paths(w[k:]):
                    yield [q, *rest], v * prob[q]

    words, counts = ["ab", "abxab", "b"], np.array([[1., 2.], [3., 0.], [1., 1.]])
    want = np.zeros_like(prob)
    for w, c in zip(words, counts):
        found = list(paths(langid.SPACE + w))
        z = sum(v for _, v in found)
        for path, v in found:
            for q in path:
                want[q] += c * v / z
    assert np.allclose(langid.expected(words, counts, lat, prob), want)


def test_language_accuracy_held_out(spark):
    d = spark.read.parquet(f"{SF001}/documents.parquet").withColumn("held_out", langid.held_out())
    model = langid.train(d.where("NOT held_out"), sample_docs=40, rounds=2)
    got = langid.predict(d.where("held_out"), model, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = odd_rows()
    df = docs(spark, rows)
    got = langid.predict(df, langid.train(df, sample_docs=20, rounds=1)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        if r.doc_id in (0, 1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in ("en", "de", "fr")
    none = langid.train(df.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(docs(spark, []), none).count() == 0


# personal data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_by_regex(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            s = m.group()
            d = re.sub("[^0-9]", "", s)
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in s.split(".")) or k == 2 and 16 <= len(d) <= 19 and pii.luhn(d) or k == 3 and 8 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rnd = random.Random(5)
    bits = ["a", "@", ".", "1", "22", "555", "+", "-", " ", "(", ")", "_", "b.c", "0000", "256", "é", "4844508665317339"]
    for _ in range(20000):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(t) == base_by_regex(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 200000, "1" * 200000, "a@" * 50000, "1." * 50000, "+1(" * 50000):
        assert isinstance(pii.base_spans(t), list)


def field():
    rnd, samples = random.Random(1), []
    for i in range(60):
        phone = f"+1 ({rnd.randint(100, 999)}) 555-{rnd.randint(1000, 9999)}"
        t = rnd.choice([f"ring {phone} today", f"at 10.2.{i}.7 we", f"to a.{i}@mail.example.com now", f"id {rnd.randint(10**15, 10**16 - 1)} of", f"see 4.{i}.1 for"])
        samples += [x for a, e in pii.regions(t) for x in pii.examples(t, a, e)]
    return pii.fit(samples), samples


def test_gradient_by_differences():
    crf, samples = field()
    for region, gold in samples[:8]:
        _, feats, _ = crf.gradient(region, gold)
        for at in list(feats)[:3]:
            w = crf.w[at]
            value = []
            for step in (1e-5, -1e-5):
                crf.w[at] = w + step
                value.append(crf.gradient(region, gold)[0])
            crf.w[at] = w
            assert (value[0] - value[1]) / 2e-5 == pytest.approx(feats[at], abs=1e-4)


def test_decode_is_the_best_segmentation():
    crf, _ = field()
    text = "or (123) 555-4567 10.2.3.4 x"
    region = pii.Region(text, 3, len(text) - 2)

    def best(j, y):                                        # all segmentations that end at j with label y
        if j == 0:
            return 0.0 if y == 0 else -math.inf
        arcs = [(j - 1, 0.0)] if y == 0 else [(i, crf._score(f)) for i, e, k, f in region.segs if e == j and k + 1 == y]
        return max((best(i, p) + crf.pair[p, y] + s for i, s in arcs for p in range(5)), default=-math.inf)

    spans = crf.decode(region)
    where = {(k, region.cuts[i], region.cuts[e]): f for i, e, k, f in region.segs}
    score, at, label = 0.0, region.cuts[0], 0
    for k, s, e in spans:
        while at < s:
            score, label, at = score + crf.pair[label, 0], 0, region.cuts[region.cuts.index(at) + 1]
        score, label, at = score + crf.pair[label, k + 1] + crf._score(where[k, s, e]), k + 1, e
    while at < region.cuts[-1]:
        score, label, at = score + crf.pair[label, 0], 0, region.cuts[region.cuts.index(at) + 1]
    assert score == pytest.approx(max(best(region.n, y) for y in range(5)))
    assert (3, 3, 17) in spans                             # a phone number without its country code


def test_pii_query_on_odd_rows(spark):
    extra = [(200, "mail x.y@z.org, 10.0.0.1", None, None), (201, "+1 (415) 555-2671 and 4844508665317339", None, None), (202, "10.0.0.999 4844508665317338", None, None)]
    rows = odd_rows() + extra
    df = docs(spark, rows)
    got = pii.detect(df, pii.train(df), redact=True).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows if i is not None}
    for r in got:
        if r.doc_id is None:
            continue
        base = base_by_regex(text[r.doc_id])
        joined = lambda spans: ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(joined(base).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(joined(base).split(",") if base else []) <= set(every) and len(every) == len(base) + r.n_added
        if text[r.doc_id] is not None:
            assert not base_by_regex(r.redacted)
    assert {r.doc_id: r.redacted for r in got}[200] == "mail [EMAIL], [IP]"
    empty = docs(spark, [])
    assert pii.detect(empty, pii.train(empty)).count() == 0


# packing

def test_best_fit_by_brute_force():
    rnd = random.Random(3)
    fit, room = packing.BestFit(64), []
    for n in sorted((rnd.randint(1, 64) for _ in range(800)), reverse=True):
        w, offset = fit.put(n)
        best = min((r for r in room if r >= n), default=None) if n < 64 else None
        if best is None:
            assert w == len(room) and offset == 0
            room.append(64 - n)
        else:
            assert room[w] == best and offset == 64 - best
            room[w] -= n
    assert fit.made == len(room)


def test_encoder_equals_the_tokenizer():
    enc, rnd = packing.Encoder(packing.tokenizer_path()), random.Random(1)
    bits = ["a", " ", "\n", "\t", "b's", "don't", "é", "  ", "1", "!", "<|endoftext|>", " \n", "\r\n", "\x1c", "　", "\x85", "\0"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(2000)]
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.tokenizer_path())      # built apart, with its own settings
    assert len(plain.encode("a <|endoftext|> b", add_special_tokens=False).ids) == 4
    assert enc(texts) == [np.asarray(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_packing_odd_rows(spark):
    rows = odd_rows()
    got = packing.pack_documents(docs(spark, rows), keep_ids=True).collect()
    enc = packing.Encoder(packing.tokenizer_path())
    want = Counter((i, enc([t or ""])[0] + bytes(4)) for i, t, *_ in rows)
    pieces: dict = {}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4096
        pieces.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(bytes(r.ids))
    for (i, ids), n in want.items():                       # every id in exactly one piece
        for s in range(0, len(ids) // 4, 1024):
            part = ids[4 * s:4 * (s + 1024)]
            assert pieces[i, len(ids) // 4, s].count(part) >= n
    assert sum(r.length for r in got) == sum(n * len(ids) // 4 for (_, ids), n in want.items())
    at: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 1024
    assert packing.pack_documents(docs(spark, [])).count() == 0


# language model

def model_by_counting(rows, stored=2):
    train = [r for r in rows if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 7 != 2]
    tokens = lambda t: [*WORD.findall((t or "").translate(LOWER)), ""]
    c = Counter(w for r in train for w in tokens(r[1]))
    pair = Counter(x for r in train for x in zip(["", *tokens(r[1])], tokens(r[1])))
    n, v = sum(c.values()), len(c)
    q = lambda x: (3 * 2.0 ** (x.bit_length() - 1) - 1) / 2 if x else 0.0
    total = sum(map(q, c.values()))

    def one(t):
        ws = tokens(t)
        score = 0.0
        for h, w in zip(["", *ws], ws):
            share = 0.5 if c[h] else 0.0
            near = q(pair[h, w]) if pair[h, w] >= stored else 0.0
            score += math.log10(share * min(1.0, near / max(q(c[h]), 1.0)) + (1 - share) * (q(c[w]) + 1) / (total + v + 1))
        return len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), score

    return one


@pytest.mark.parametrize("top", [5, 1 << 17])
def test_language_model_by_counting(spark, monkeypatch, top):
    monkeypatch.setattr(bloom_lm, "TOP", top)              # with 5, nearly all counts travel
    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 200)   # no false positives
    rows = odd_rows()
    df = docs(spark, rows).withColumn("held_out", bloom_lm.held_out())
    got = bloom_lm.score(df, df.where("NOT held_out")).collect()
    one = model_by_counting(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r[0], *one(r[1])) for r in rows), key=key)
    for g, w in zip(sorted((tuple(r) for r in got), key=key), want):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], abs=1e-8) and g[5] == pytest.approx(w[5], abs=1e-6)


def test_filter_levels_never_fall_short():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2 ** 63, 4000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    q = rng.integers(1, 12, 4000)
    part = (x >> np.uint64(60)).astype(int)
    bits = np.concatenate([bloom_lm.segment([(x[part == p], q[part == p])], 16) for p in range(16)])
    f = bloom_lm.Filter(bits, 4, 16)
    got = f.levels(x)
    assert (got >= q).all() and (got > q).mean() < 0.05
    assert (f.levels(rng.integers(0, 2 ** 63, 4000).astype(np.uint64)) > 0).mean() < 0.05


def test_language_model_of_nothing(spark):
    df = docs(spark, odd_rows()[:6])
    got = bloom_lm.score(df, df.where("false")).collect()
    assert len(got) == 6 and all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in got)
    assert bloom_lm.score(docs(spark, []), docs(spark, [])).count() == 0


def test_language_model_grows_with_its_corpus(spark, monkeypatch):
    """No bound on the filter: with a small one, pairs used to be dropped by their counts, then words read back false."""
    monkeypatch.setattr(bloom_lm, "FILTER_BYTES", 1 << 10, raising=False)
    monkeypatch.setattr(bloom_lm, "LOT", 500, raising=False)
    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 200)
    rnd = random.Random(3)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.4)) % 900}" for _ in range(80)) for _ in range(120)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts + texts[:60])]
    df = docs(spark, rows).withColumn("held_out", bloom_lm.held_out())
    one = model_by_counting(rows)
    for r in bloom_lm.score(df, df.where("NOT held_out"), keep=("text",)).collect():
        want = one(r.text)
        assert (r.n_tokens, r.n_known) == want[:2] and r.base_score == pytest.approx(want[3], abs=1e-8) and r.score == pytest.approx(want[4], abs=1e-6)


def test_language_model_query_keeps_pairs_seen_once(spark, monkeypatch, tmp_path):
    from tabwright.llm.queries import queries

    monkeypatch.setattr(bloom_lm, "BITS_PER_ENTRY", 200)
    rows = [r for r in odd_rows() if r[0] is not None]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    one, twice, text = model_by_counting(rows, stored=1), model_by_counting(rows), {r[0]: r[1] for r in rows}
    got = queries()["op9_bloom_lm"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert all(r.score == pytest.approx(one(text[r.doc_id])[4], abs=1e-6) for r in got)
    assert any(one(t)[4] > twice(t)[4] + 1 for t in text.values())
