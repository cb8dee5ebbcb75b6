"""Personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from the patterns below, scanned in linear time over whole
texts.  The field adds spans the patterns miss (a phone number without its
plus, say): it scores whole candidate segments by features of the segment as a
whole (shape, checks, digit count, what stands before and after) and a dynamic
program over bounded segments chooses boundaries and types jointly.  Base
spans always stay; added spans never overlap one.

A segment needs a digit or an at sign, so text without them can only be
"outside", at score 0; the program therefore runs region by region around
them and gives the same result as over the whole text.

Training maximises the conditional log-likelihood of base spans (and of the
same phone numbers without country code) on regions of a hash sample of about
``SAMPLE_DOCS`` documents, at most ``SAMPLE_REGIONS`` regions.

Null text is an empty text: no spans.  Offsets are code points, ends
exclusive.  Repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import prepare_workers

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 6000
SAMPLE_REGIONS = 600
EPOCHS = 6
MAX_TOKENS = 20     # of a segment
MAX_REACH = 64      # characters that a region extends beyond a digit or at sign

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m.group().split(".")
        pos = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = pos + sum(map(len, four)) + 3
            if all(int(p) <= 255 if len(p) < 4 else not p.strip("0") or int(p[-4:]) <= 255 and not p[:-4].strip("0") for p in four):
                yield pos, end
            pos = end + 1


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m.group().count, "0123456789")) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind and start."""
    found = []
    if "@" in text:
        found += [(0, *s) for s in _emails(text)]
    if re.search("[0-9]", text):
        found += [(k, *s) for k, f in ((1, _ips), (2, _cards), (3, _phones)) for s in f(text)]
    return found


# regions and candidate segments

_TRIGGER = re.compile(r"[0-9@]\S{0,%d}" % MAX_REACH)
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[\s\S]")
_SPACE = re.compile(r"\s")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words with a digit or at sign, one space apart at most; each reaches ``MAX_REACH`` characters around its marks."""
    start = end = -1
    for m in _TRIGGER.finditer(text):
        a, low = m.start(), max(end, m.start() - MAX_REACH, 0)
        while a > low and not text[a - 1].isspace():
            a -= 1
        if end >= 0 and (a <= end or (a == end + 1 and text[end] == " ")):
            end = m.end()
        else:
            if end >= 0:
                yield start, end
            start, end = a, m.end()
    if end >= 0:
        yield start, end


def _side(c: str) -> str:
    return "edge" if not c else "alnum" if c.isalnum() else "space" if c.isspace() else "dot" if c in ".," else "mark"


def _features(s: str, kind: int, before: str, after: str, word: str) -> list[str]:
    digits = "".join(filter(str.isdigit, s))
    k = KINDS[kind]
    out = [k, f"{k} before {_side(before)}", f"{k} after {_side(after)}", f"{k} word {word}", f"{k} digits {min(len(digits), 20)}"]
    if kind == 0:
        m = _DOMAIN.match(s, s.find("@") + 1)
        out += [f"{k} ats {min(s.count('@'), 2)}", f"{k} domain {bool(m) and m.end() == len(s)}", f"{k} local {s.find('@') > 0 and set(s[:s.find('@')]) <= _LOCAL_CHARS}"]
    elif kind == 1:
        parts = s.split(".")
        out += [f"{k} parts {min(len(parts), 6)}", f"{k} bytes {all(p.isdigit() and int(p[:6]) <= 255 for p in parts)}"]
    elif kind == 2:
        out += [f"{k} luhn {luhn(digits)}", f"{k} groups {min(len(re.split('[ -]', s)), 6)}"]
    else:
        out += [f"{k} plus {s[0] == '+'}", f"{k} paren {'(' in s}", f"{k} marks {min(sum(not c.isdigit() for c in s), 8)}", f"{k} shape {re.sub('[0-9]', '9', s)[-14:]}"]
    return out


class Region:
    """Tokens and candidate segments (first token, last token + 1, kind, features) of a piece of text."""

    def __init__(self, text: str, start: int, end: int):
        body = text[start:end]
        cuts = [start + m.start() for m in _TOKEN.finditer(body)] + [end]
        left = text[max(0, start - 24):start].split()
        word = left[-1].strip(".,:;()").lower()[-12:] if left else ""
        self.cuts, self.n, self.segs = cuts, len(cuts) - 1, []
        for i in range(self.n):
            first = text[cuts[i]]
            if not (first.isalnum() or first in "+("):
                continue
            n_digits, at, only = 0, False, True
            for j in range(i + 1, min(self.n, i + MAX_TOKENS) + 1):
                tok = text[cuts[j - 1]:cuts[j]]
                if tok[0].isdigit():
                    n_digits += len(tok)
                elif tok == "@":
                    at = True
                elif tok not in " -.()+":
                    only = False
                if cuts[j] - cuts[i] > MAX_REACH:
                    break
                if not tok[0].isalnum() or not (at or only):
                    if not at and not only and "@" not in text[cuts[i]:cuts[min(self.n, i + MAX_TOKENS)]]:
                        break
                    continue
                s = text[cuts[i]:cuts[j]]
                kinds = [0] if at else ([1] if s.count(".") == 3 and set(s) <= set("0123456789.") and 4 <= n_digits <= 12 else []) + (
                    [2] if 12 <= n_digits <= 19 and set(s) <= set("0123456789 -") else []) + ([3] if 7 <= n_digits <= 15 and s[0] != "." else [])
                for k in kinds:
                    if k == 0 and (" " in s):
                        continue
                    self.segs.append((i, j, k, _features(s, k, text[cuts[i] - 1:cuts[i]], text[cuts[j]:cuts[j] + 1], word)))


class SemiCRF:
    """Weights of segment features and of label pairs (0 is outside, k + 1 is KINDS[k])."""

    def __init__(self, names: dict[str, int] | None = None, w: np.ndarray | None = None, pair: np.ndarray | None = None):
        n = len(KINDS) + 1
        self.names = names or {}
        self.w = w if w is not None else np.zeros(len(self.names))
        self.pair = pair if pair is not None else np.zeros((n, n))

    def _score(self, feats: list[str]) -> float:
        names, w = self.names, self.w
        return float(sum(w[names[f]] for f in feats if f in names))

    def _arcs(self, region: Region) -> list[list[tuple[int, int, float, int]]]:
        """Arcs by their end: (start, label, score, segment)."""
        arcs = [[] for _ in range(region.n + 1)]
        for x in range(region.n):
            arcs[x + 1].append((x, 0, 0.0, -1))
        for q, (i, j, k, feats) in enumerate(region.segs):
            arcs[j].append((i, k + 1, self._score(feats), q))
        return arcs

    def decode(self, region: Region) -> list[tuple[int, int, int]]:
        """Best (kind, start, end) of a region; ties leave text outside."""
        if not region.segs:
            return []
        n = len(KINDS) + 1
        best = np.full((region.n + 1, n), -np.inf)
        best[0, 0] = 0.0
        back: dict = {}
        for j, into in enumerate(self._arcs(region)):
            for i, y, s, q in into:
                options = best[i] + self.pair[:, y]
                p = int(np.argmax(options))
                if options[p] + s > best[j, y]:
                    best[j, y] = options[p] + s
                    back[j, y] = (i, p, q)
        j, y = region.n, int(np.argmax(best[-1]))
        out = []
        while j:
            i, p, q = back[j, y]
            if q >= 0:
                out.append((y - 1, region.cuts[i], region.cuts[j]))
            j, y = i, p
        return out[::-1]

    def gradient(self, region: Region, gold: set[int]) -> tuple[float, dict[int, float], np.ndarray]:
        """Log-likelihood of the gold segments, and its gradient by feature and by label pair."""
        n = len(KINDS) + 1
        arcs = self._arcs(region)
        log = np.logaddexp.reduce
        alpha = np.full((region.n + 1, n), -np.inf)
        alpha[0, 0] = 0.0
        for j, into in enumerate(arcs):
            for i, y, s, _ in into:
                alpha[j, y] = np.logaddexp(alpha[j, y], log(alpha[i] + self.pair[:, y]) + s)
        beta = np.full((region.n + 1, n), -np.inf)
        beta[-1] = 0.0
        z = log(alpha[-1])
        feats: dict[int, float] = {}
        pairs = np.zeros((n, n))
        for j in range(region.n, 0, -1):
            for i, y, s, q in arcs[j]:
                through = alpha[i] + self.pair[:, y] + s + beta[j, y]
                beta[i] = np.logaddexp(beta[i], self.pair[:, y] + s + beta[j, y])
                p = np.exp(through - z)
                pairs[:, y] -= p
                if q >= 0:
                    for f in region.segs[q][3]:
                        if (at := self.names.get(f)) is not None:
                            feats[at] = feats.get(at, 0.0) - float(p.sum())
        # the gold path
        starts = {region.segs[q][0]: q for q in gold}
        j = y = 0
        value = 0.0
        while j < region.n:
            q = starts.get(j)
            nxt, to = (region.segs[q][1], region.segs[q][2] + 1) if q is not None else (j + 1, 0)
            pairs[y, to] += 1
            value += self.pair[y, to]
            if q is not None:
                value += self._score(region.segs[q][3])
                for f in region.segs[q][3]:
                    if (at := self.names.get(f)) is not None:
                        feats[at] = feats.get(at, 0.0) + 1.0
            j, y = nxt, to
        return value - float(z), feats, pairs


def gold_segments(region: Region, spans: list[tuple[int, int, int]]) -> set[int] | None:
    """Indices of the segments that are ``spans``; None if some span is no segment or two overlap."""
    where = {(k, region.cuts[i], region.cuts[j]): q for q, (i, j, k, _) in enumerate(region.segs)}
    if any(s not in where for s in spans):
        return None
    ends = sorted((s, e) for _, s, e in spans)
    if any(a[1] > b[0] for a, b in zip(ends, ends[1:])):
        return None
    return {where[s] for s in spans}


def examples(text: str, start: int, end: int) -> Iterator[tuple[Region, set[int]]]:
    """A region with its base spans, and the same with a phone number's country code cut off."""
    spans = [s for s in base_spans(text) if start <= s[1] and s[2] <= end]
    region = Region(text, start, end)
    gold = gold_segments(region, spans)
    if gold is not None and region.segs:
        yield region, gold
    for k, a, b in spans:
        m = re.match(r"\+[0-9]{1,3}[ .-]?", text[a:b])
        if k == 3 and len(spans) == 1 and m and sum(c.isdigit() for c in text[a + m.end():b]) >= 7:
            other = text[:a] + text[a + m.end():]
            less = m.end()
            region = Region(other, start, end - less)
            gold = gold_segments(region, [(3, a, b - less)])
            if gold is not None:
                yield region, gold


def fit(samples: list[tuple[Region, set[int]]], epochs: int = EPOCHS, rate: float = 0.5, decay: float = 1e-4) -> SemiCRF:
    """Adaptive gradient ascent on the conditional log-likelihood, in the order given."""
    names: dict[str, int] = {}
    for region, _ in samples:
        for *_, feats in region.segs:
            for f in feats:
                names.setdefault(f, len(names))
    crf = SemiCRF(names)
    seen, seen_pair = np.full(len(names), 1e-6), np.full_like(crf.pair, 1e-6)
    for _ in range(epochs):
        for region, gold in samples:
            _, feats, pairs = crf.gradient(region, gold)
            if feats:
                at, g = np.fromiter(feats, np.int64, len(feats)), np.fromiter(feats.values(), float, len(feats))
                g -= decay * crf.w[at]
                seen[at] += g * g
                crf.w[at] += rate * g / np.sqrt(seen[at])
            seen_pair += pairs * pairs
            crf.pair += rate * pairs / np.sqrt(seen_pair) * (pairs != 0)
    return crf


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_regions: int = SAMPLE_REGIONS) -> SemiCRF:
    prepare_workers(docs.sparkSession)
    n = max(1, docs.count())
    key = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|pii"))), 1, 8), 16, 10).cast("long")
    d = docs.select(key.alias("key"), F.col(text_col).alias("text")).where(
        (F.col("key") < F.lit(min(1.0, sample_docs / n) * float(1 << 32))) & F.col("text").rlike("[0-9@]"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts, starts, ends = [], [], [], []
            for key, text in zip(*(c.to_pylist() for c in b.columns)):
                for a, e in regions(text):
                    if e - a <= 8 * MAX_REACH:
                        lo = max(0, a - 24)
                        keys.append(key), texts.append(text[lo:e + 1]), starts.append(a - lo), ends.append(e - lo)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["key", "text", "a", "e"])

    # regions that look like a number or an address come first, the rest fill up
    found = (d.mapInArrow(cut, "key long, text string, a int, e int")
             .withColumn("rich", F.col("text").rlike(r"@|[0-9.() +-]{9}"))
             .dropDuplicates(["key", "text"]).orderBy(F.desc("rich"), "key", "text").limit(sample_regions).collect())
    return fit([x for r in found for x in examples(r.text, r.a, r.e)])


def all_spans(text: str, crf: SemiCRF) -> tuple[list, list]:
    """Base spans; all spans, by kind and start."""
    if "@" not in text and not re.search("[0-9]", text):
        return [], []
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    added = []
    for a, e in regions(text):
        if sum(map(str.isdigit, text[a:e])) < 4 and "@" not in text[a:e]:
            continue                                # no candidate segment
        for k, s, t in crf.decode(Region(text, a, e)):
            if not any(s < y and x < t for x, y in taken):
                added.append((k, s, t))
    return base, sorted(base + added)


_models: dict = {}


def model(key: str, sent) -> SemiCRF:
    if key not in _models:
        _models.clear()
        _models[key] = SemiCRF(*sent.value)
    return _models[key]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans) -> str:
    """Spans (merged where they overlap) replaced by their kind in brackets."""
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def detect(docs: DataFrame, crf: SemiCRF, id_col: str = "doc_id", text_col: str = "text", redact: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_<kind> of base spans, base_sha256, spans, n_added[, redacted][, columns in ``keep``]."""
    spark = docs.sparkSession
    prepare_workers(spark)
    sent, key = spark.sparkContext.broadcast((crf.names, crf.w, crf.pair)), uuid.uuid4().hex
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    new = [*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string", "n_added long", *(["redacted string"] * redact)]
    schema = StructType([*(f for f in d.schema if f.name != "_text"), *StructType.fromDDL(", ".join(new)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(key, sent)
        for b in batches:
            counts, sha, spans, added, red = [[] for _ in KINDS], [], [], [], []
            for text in b.column(1).to_pylist():
                base, every = all_spans(text or "", m)
                for k, c in enumerate(counts):
                    c.append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(base))
                if redact:
                    red.append(redacted(text, every) if text is not None else None)
            cols = [c for i, c in enumerate(b.columns) if i != 1] + [pa.array(c, pa.int64()) for c in counts] + [
                pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())] + ([pa.array(red, pa.string())] if redact else [])
            yield pa.RecordBatch.from_arrays(cols, names=[n for i, n in enumerate(b.schema.names) if i != 1] + [x.split()[0] for x in new])

    return d.mapInArrow(run, schema)
