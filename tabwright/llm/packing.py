"""Packing tokenised documents into fixed windows by best-fit decreasing.

A document is its token ids and one end id.  Documents longer than a window
are first cut into full windows (each a sequence of its own); what is left of
every document is packed, longest first, into the open window with the
tightest remaining capacity that still holds it.  Open windows are found in a
segment tree indexed by remaining capacity.

Spark deals the pieces out by a hash and sorts each task's pieces by length;
a task streams them through its own tree, so memory is the list of open
windows and no task sees the whole corpus.  Padding lost per task is less than
a few windows.

Null text is an empty document (just the end id); repeated ids are separate
documents; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import prepare_workers

WINDOW = 1024
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Tokenised text runs remembered by a worker (about 200 bytes each).
REMEMBERED = 500_000

_state: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer never joins a space with what precedes it, so a text without
    two white-space characters in a row is the concatenation of its runs " word",
    and the ids of runs are remembered.  New runs are encoded many at a time, in
    one string, and told apart by the byte lengths of their tokens.  This uses the
    same vocabulary's rank file, whose merge loop is faster; texts with white space
    other than spaces and line feeds, or with one of the vocabulary's added tokens
    (such as its end mark, which is one id), go to ``tokenizers`` whole.
    """

    #: White space and controls other than space and line feed, each looked for by itself (faster than a pattern).
    odd = [chr(c) for c in (0, 9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    double = ("  ", "\n\n", " \n", "\n ")

    def __init__(self, path: str):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)
        self.runs: dict[str, bytes] = {}

    def _fast(self, text: str) -> np.ndarray:
        return np.asarray(self.fast.encode_ordinary(text), dtype="<u4")

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of " word" for each word."""
        out = {}
        for lo in range(0, len(words), 5000):
            part = words[lo:lo + 5000]
            ids = self._fast(" " + " ".join(part))
            ends = np.cumsum(self.size[ids])                 # in bytes of the joined string
            want = np.cumsum(np.array([len(w.encode()) + 1 for w in part]))
            at = [0, *(4 * (np.searchsorted(ends, want) + 1)).tolist()]
            raw = ids.tobytes()
            out.update(zip(part, [raw[a:b] for a, b in zip(at, at[1:])]))
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in self.odd) or any(c in t for c in self.added) for t in texts]
        split = [None if o or any(c in t for c in self.double) else t.split(" ") for t, o in zip(texts, odd)]
        # the first run has no space before it; a run that is empty or has white space inside is a word like any other
        known = self.runs.get
        found = [s and list(map(known, s[1:])) for s in split]
        new = {w for s, f in zip(split, found) if s and None in f for w, v in zip(s[1:], f) if v is None}
        learned = self._learn(list(new))
        if len(self.runs) + len(new) <= REMEMBERED:
            self.runs.update(learned)
        elif 2 * len(new) > sum(len(set(s)) for s in split if s):   # other texts than those remembered
            self.runs = learned
        out = []
        for t, o, s, f in zip(texts, odd, split, found):
            if s is None:
                ids = self.tok.encode(t, add_special_tokens=False).ids if o else self._fast(t)
                out.append(np.asarray(ids, dtype="<u4").tobytes())
            else:
                first = self._fast(s[0]).tobytes() if s[0] else b""
                out.append(first + b"".join([learned[w] if v is None else v for w, v in zip(s[1:], f)] if None in f else f))
        return out


def encoder(path: str) -> Encoder:
    if path not in _state:
        _state[path] = Encoder(path)
    return _state[path]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
           tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens[, ids]: full windows and the rest of every document."""
    spark = docs.sparkSession
    prepare_workers(spark)
    path = tokenizer or tokenizer_path()
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else ""))
    schema = StructType([d.schema["doc_id"], *schema.fields])
    out_schema = to_arrow_schema(schema)
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            take, start, length, crc, total, raw = [], [], [], [], [], []
            every = (b for lo in range(0, len(texts), 500) for b in enc(texts[lo:lo + 500]))
            for k, b in enumerate(every):
                b += end
                n = len(b) // 4
                for s in range(0, n, window):
                    part = b[4 * s:4 * (s + window)]
                    take.append(k), start.append(s), length.append(len(part) // 4), crc.append(zlib.crc32(part)), total.append(n)
                    if keep_ids:
                        raw.append(part)
            cols = [ids.take(pa.array(take, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols + ([pa.array(raw, pa.binary())] if keep_ids else []), out_schema)], schema=out_schema)

    return d.mapInArrow(cut, schema)


class BestFit:
    """Open windows by remaining capacity, under a segment tree of counts."""

    def __init__(self, window: int = WINDOW):
        self.half = 1 << (window - 1).bit_length()
        self.count = array("q", bytes(8 * 2 * self.half))
        self.open: list[list[int]] = [[] for _ in range(window)]
        self.window, self.made = window, 0

    def _add(self, cap: int, by: int) -> None:
        i = cap + self.half
        while i:
            self.count[i] += by
            i >>= 1

    def _tightest(self, need: int) -> int:
        """Smallest capacity of an open window that is at least ``need``; 0 if none."""
        c, i = self.count, need + self.half
        if i >= 2 * self.half:
            return 0
        if c[i]:
            return need
        while i > 1:
            if not i & 1 and c[i + 1]:
                i += 1
                while i < self.half:
                    i *= 2
                    if not c[i]:
                        i += 1
                return i - self.half
            i >>= 1
        return 0

    def put(self, length: int) -> tuple[int, int]:
        """(window number, offset) of a piece."""
        if length == self.window:
            self.made += 1
            return self.made - 1, 0
        cap = self._tightest(length)
        if cap:
            w = self.open[cap].pop()
            self._add(cap, -1)
        else:
            w, cap, self.made = self.made, self.window, self.made + 1
        left = cap - length
        if left:
            self.open[left].append(w)
            self._add(left, 1)
        return w, self.window - cap


def pack(parts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id (unique) and offset to pieces; ``sequence_id`` is the task's number times 2^40 plus the window's."""
    schema = StructType([*parts.schema.fields, *StructType.fromDDL("sequence_id long, offset long").fields])
    out_schema = to_arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, fit = TaskContext.get().partitionId() << 40, BestFit(window)
        for batch in batches:
            where = [fit.put(n) for n in batch.column("length").to_pylist()]
            cols = [*batch.columns, pa.array([first + w for w, _ in where], pa.int64()), pa.array([o for _, o in where], pa.int64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out_schema)], schema=out_schema)

    dealt = parts.repartition(F.xxhash64("doc_id", "start", "ids_crc32"))
    return dealt.sortWithinPartitions(F.desc("length"), "doc_id", "start", "ids_crc32").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their place; ``keep_ids`` adds the ids themselves as bytes."""
    return pack(pieces(docs, id_col, text_col, window, tokenizer, keep_ids), window)
