"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of text pieces; for each language a probability per
piece.  The probability of a word is the sum, over all its segmentations into
pieces, of the product of their probabilities (forward algorithm); a text's is
the product over its words.  The most probable language wins.

Training: a bounded hash sample of labelled documents per language
(``SAMPLE_DOCS``) is counted into words by Spark; expectation maximisation
with forward and backward sums gives the expected piece counts of each
language, summed by Spark over all workers.  The model is vocabulary x
languages numbers, whatever the corpus; its size is checked before it is
broadcast.

Every piece of the vocabulary takes part, and no word is cut: runs of over
``BATCHED`` characters (some scripts have no white space) are walked in parts
of ``PART`` characters, the last forward sums carried from part to part, so
that all their segmentations are summed in bounded memory.

Prediction reads whole texts.  Word scores are remembered in each worker (at
most ``REMEMBERED`` words), so a text costs a lookup per word.

Null texts and texts without a letter are ``und`` with score 0; so is every
text if there is nothing to learn from.  Ties go to the first language by code
point.  Repeated rows and extra columns are of no consequence.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import GAP, prepare_workers

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 200      # labelled documents per language, at most about this many
ROUNDS = 3             # of expectation maximisation
BATCHED = 48           # characters; words up to this long are summed side by side, longer ones one by one
PART = 4096            # characters of a long word held at a time
SMOOTH = 0.1           # added to each expected count
REMEMBERED = 150_000
MODEL_BYTES = 256 << 20
SPACE = "▁"       # word start mark of the vocabulary
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")     # what training splits at GAP


def vocabulary(path: str | None = None) -> list[str]:
    """Pieces in lower case, without control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    found = (sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return sorted({p for p in found if p})


class Lattice:
    """All pieces in words, found by hashes of their substrings.

    Index ``len(pieces)`` stands for a single character outside the vocabulary,
    ``len(pieces) + 1`` for no piece.
    """

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max((len(p) for p in pieces), default=1)
        self.power = np.ones(self.longest + 1, dtype=np.uint64)
        self.power[1:] = _BASE
        self.power = np.multiply.accumulate(self.power)  # modulo 2^64
        self.by_len: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(1, self.longest + 1):
            ids = np.array([i for i, p in enumerate(pieces) if len(p) == k], dtype=np.int64)
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids], dtype=np.uint64).reshape(-1, k)
            h = np.zeros(len(ids), dtype=np.uint64)
            for j in range(k):
                h = h * _BASE + chars[:, j]
            order = np.argsort(h)
            maybe = np.zeros(1 << 18, dtype=bool)  # by the hash's top bits: spares most searches
            maybe[h >> np.uint64(46)] = True
            self.by_len.append((h[order], ids[order], maybe))

    def ids(self, words: list[str], width: int) -> np.ndarray:
        """(word, start, length - 1) -> piece index, for words of ``width`` characters."""
        n, none = len(words), self.n + 1
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64).reshape(n, width)
        h = np.zeros((n, width + 1), dtype=np.uint64)
        for j in range(width):
            h[:, j + 1] = h[:, j] * _BASE + chars[:, j]
        out = np.full((n, width, self.longest), none, dtype=np.int64)
        for k in range(1, min(self.longest, width) + 1):
            keys, ids, maybe = self.by_len[k - 1]
            sub = h[:, k:] - h[:, :width + 1 - k] * self.power[k]
            if k == 1:
                out[:, :, 0] = self.n
            row, col = np.nonzero(maybe[sub >> np.uint64(46)])
            hit = sub[row, col]
            at = np.minimum(np.searchsorted(keys, hit), max(0, len(keys) - 1))
            ok = keys[at] == hit
            out[row[ok], col[ok], k - 1] = ids[at[ok]]
        return out


def by_length(words: list[str]) -> tuple[list[str], np.ndarray, list[int]]:
    """Marked words, the indices of those of at most ``BATCHED`` characters, and of the longer ones."""
    marked = [SPACE + w for w in words]
    size = np.array([len(w) for w in marked], dtype=np.int64)
    return marked, np.flatnonzero(size <= BATCHED), np.flatnonzero(size > BATCHED).tolist()


def lots(size: np.ndarray, cells: int = 1 << 16) -> Iterator[np.ndarray]:
    """Indices of parts of equal length, in lots of at most ``cells`` characters."""
    order = np.argsort(size, kind="stable")
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for a, b in zip(edges, edges[1:]):
        step = max(1, cells // int(size[order[a]]))
        for i in range(a, b, step):
            yield order[i:min(b, i + step)]


def word_scores(words: list[str], lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """(word, language): log of the sum over all segmentations."""
    marked, short, long = by_length(words)
    out = np.zeros((len(words), prob.shape[1]))
    for lot in lots(np.array([len(marked[i]) for i in short], dtype=np.int64)):
        at = short[lot]
        ids = lattice.ids([marked[i] for i in at], len(marked[at[0]]))
        out[at] = forward(ids, prob)[:, -1]
    for i in long:
        before = np.zeros((1, prob.shape[1]))
        for a in range(0, len(marked[i]), PART):
            before = part_forward(marked[i], a, before, lattice, prob)[2][-lattice.longest:]
        out[i] = before[-1]
    return out


def part_forward(word: str, a: int, before: np.ndarray, lattice: Lattice, prob: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``PART`` characters of a long word from ``a`` on.  ``before`` holds log P up to ``a`` and the
    positions before it that a piece reaches.  -> pieces (start, length - 1), probabilities of the
    pieces by their end (end, length - 1, language), log P (position, language); positions count from the first in ``before``."""
    over = len(before) - 1
    text = word[a - over:a + PART]
    n, longest, g = len(text), lattice.longest, prob.shape[1]
    ids = lattice.ids([text], n)[0]
    p = np.zeros((n + 1, longest, g))
    for k in range(1, min(longest, n) + 1):
        p[k:, k - 1] = prob[ids[:n + 1 - k, k - 1]]
    logs = np.zeros((n + 1, g))
    logs[:over + 1] = before
    offset, last = before[over], np.zeros((longest, g))     # last[k - 1]: the sum at j - k
    last[:over + 1] = np.exp(before[::-1] - offset)
    for j in range(over + 1, n + 1):
        total = (last * p[j]).sum(axis=0)
        logs[j] = offset + np.log(total)
        if j % 8 == 0:
            last, offset, total = last / total, logs[j], np.ones(g)
        last[1:] = last[:-1].copy()
        last[0] = total
    return ids, p, logs


def long_expected(word: str, count: np.ndarray, lattice: Lattice, prob: np.ndarray, out: np.ndarray) -> None:
    """Adds the expected uses of a long word.  Forward once, keeping what each part starts from; then backward part by part."""
    longest, starts = lattice.longest, [np.zeros((1, prob.shape[1]))]
    for a in range(0, len(word), PART):
        starts.append(part_forward(word, a, starts[-1], lattice, prob)[2][-longest:])
    later = count[None, :]      # probability of a boundary, times the count, at the positions that end a part
    for q in range(len(starts) - 2, -1, -1):
        ids, p, logs = part_forward(word, q * PART, starts[q], lattice, prob)
        over, n = len(starts[q]) - 1, len(logs) - 1
        share = np.zeros_like(logs)
        share[-len(later):] += later
        uses = np.zeros_like(p)
        for j in range(n, over, -1):
            k = min(longest, j)
            uses[j, :k] = share[j] * np.exp(logs[j - k:j][::-1] - logs[j]) * p[j, :k]
            share[j - k:j] += uses[j, :k][::-1]
        for k in range(1, min(longest, n) + 1):
            for lang in range(out.shape[1]):
                out[:, lang] += np.bincount(ids[:n + 1 - k, k - 1], weights=uses[k:, k - 1, lang], minlength=len(out))
        later = share[:over + 1]


def forward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """log P of the first j characters, (word, j, language).  Sums are rescaled every
    few positions, so that long words do not underflow."""
    n, width, longest = ids.shape
    logs = np.zeros((n, width + 1, prob.shape[1]))
    offset = 0.0
    last = [np.ones((n, prob.shape[1]))]    # last[k - 1]: the sum at j - k, newest first
    for j in range(1, width + 1):
        total = last[0] * prob[ids[:, j - 1, 0]]
        for k in range(2, min(j, longest) + 1):
            p = ids[:, j - k, k - 1]
            row = np.flatnonzero(p < len(prob) - 1)
            if len(row):
                total[row] += last[k - 1][row] * prob[p[row]]
        logs[:, j] = offset + np.log(total)
        if j % 8 == 0:
            offset = logs[:, j].copy()
            last, total = [x / total for x in last], np.ones_like(total)
        last = [total, *last[:longest - 1]]
    return logs


def expected(words: list[str], counts: np.ndarray, lattice: Lattice, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece per language, for words seen ``counts`` (word, language) times."""
    out = np.zeros_like(prob)
    marked, short, long = by_length(words)
    for i in long:
        long_expected(marked[i], counts[i], lattice, prob, out)
    for lot in lots(np.array([len(marked[i]) for i in short], dtype=np.int64)):
        at = short[lot]
        width = len(marked[at[0]])
        ids = lattice.ids([marked[i] for i in at], width)
        n, longest, g = len(at), lattice.longest, prob.shape[1]
        logs = forward(ids, prob)
        # backward, relative to the forward logs: beta[j] * exp(logs[j]) / Z
        share = np.zeros((n, width + 1, g))  # probability that a segmentation has a boundary at j
        share[:, width] = counts[at]
        pieces, uses = [], []
        for j in range(width, 0, -1):
            for k in range(1, min(j, longest) + 1):
                row = np.flatnonzero(ids[:, j - k, k - 1] <= lattice.n)
                if len(row):
                    p = ids[row, j - k, k - 1]
                    part = share[row, j] * np.exp(logs[row, j - k] - logs[row, j]) * prob[p]
                    share[row, j - k] += part
                    pieces.append(p), uses.append(part)
        p, part = np.concatenate(pieces), np.concatenate(uses)
        for lang in range(g):
            out[:, lang] += np.bincount(p, weights=part[:, lang], minlength=len(out))
    return out


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> dict:
    """{"langs", "pieces", "prob"}; ``labelled`` holds the rows to learn from."""
    spark = labelled.sparkSession
    prepare_workers(spark)
    d = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    seen = {r.lang: r.n for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(seen)
    pieces = vocabulary()
    if len(langs) * (len(pieces) + 2) * 8 > MODEL_BYTES:
        raise ValueError(f"{len(langs)} languages: the model would exceed {MODEL_BYTES} bytes")
    lattice = Lattice(pieces)
    prob = np.full((len(pieces) + 2, len(langs)), 1.0 / (len(pieces) + 1))
    prob[-1] = 0.0
    if not langs:
        return {"langs": [], "pieces": pieces, "prob": prob}
    unit = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|lang"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    limit = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / seen[k]))]), F.col("lang"))
    words = (d.where(unit < limit).select("lang", F.explode(F.split(F.lower("text"), GAP)).alias("word"))
             .where("word != ''").groupBy("word", "lang").agg(F.count(F.lit(1)).alias("n"))
             .groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")))
    words = words.select("word", *[F.coalesce(F.col("by")[k], F.lit(0)).cast("double").alias(f"c{i}") for i, k in enumerate(langs)]).persist()
    n_lang = len(langs)
    for _ in range(rounds):
        at = spark.sparkContext.broadcast((lattice, prob))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lat, p = at.value
            total = np.zeros_like(p)
            for b in batches:
                c = np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(n_lang)])
                total += expected(b.column(0).to_pylist(), c, lat, p)
            used = np.flatnonzero(total.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["piece", "n"])

        sums = words.mapInArrow(count, "piece long, n array<double>").groupBy("piece").agg(*[F.sum(F.col("n")[i]).alias(f"n{i}") for i in range(n_lang)])
        got = np.zeros_like(prob)
        for r in sums.collect():             # at most one row per piece
            got[r[0]] = r[1:]
        got[:-1] += SMOOTH
        got[-1] = 0.0
        prob = got / got.sum(axis=0)
        at.unpersist()
    words.unpersist()
    return {"langs": langs, "pieces": pieces, "prob": prob}


class Scorer:
    def __init__(self, langs: list[str], pieces: list[str], prob: np.ndarray):
        self.langs, self.lattice, self.prob = langs, Lattice(pieces), prob
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((1024, len(self.langs)))

    def learn(self, words: list[str]) -> None:
        start = len(self.index)
        need = start + len(words)
        if need > len(self.table):
            self.table = np.concatenate([self.table, np.zeros((max(need - len(self.table), len(self.table)), len(self.langs)))])
        self.table[start:need] = word_scores(words, self.lattice, self.prob)
        self.index.update(zip(words, range(start, need)))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score = [], []
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        for lo in range(0, len(texts), 256):
            part = [None if t is None or not any(map(str.isalpha, t)) else _WORD.findall(t.lower()) for t in texts[lo:lo + 256]]
            if len(self.index) > REMEMBERED:
                self.clear()
            index = self.index
            new = list(dict.fromkeys(w for ws in part if ws for w in ws if w not in index))
            if new:
                self.learn(new)
            for ws in part:
                if ws is None:
                    pred.append("und"), score.append(0.0)
                    continue
                total = self.table[np.fromiter(map(index.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(np.argmax(total))
                pred.append(self.langs[best])
                score.append(round(float(1.0 / np.exp(total - total[best]).sum()), 9))
        return pred, score


_scorers: dict = {}


def scorer(key: str, sent) -> Scorer:
    """The worker's scorer of a broadcast model, kept from task to task."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(*sent.value)
    return _scorers[key]


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns named in ``keep``."""
    spark = docs.sparkSession
    prepare_workers(spark)
    sent = spark.sparkContext.broadcast((model["langs"], model["pieces"], model["prob"]))
    key = uuid.uuid4().hex
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), *keep)
    schema = StructType([*(f for f in d.schema if f.name != "_text"), *StructType.fromDDL("lang_pred string, score double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_texts = scorer(key, sent)
        for b in batches:
            pred, score = score_texts(b.column(1).to_pylist())
            others = [c for i, c in enumerate(b.columns) if i != 1]
            names = [n for i, n in enumerate(b.schema.names) if i != 1]
            yield pa.RecordBatch.from_arrays([*others, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return d.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2
