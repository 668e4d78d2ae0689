"""Packing of tokenised documents into sequences by bounded-space online best-fit.

A packer keeps at most ``open_bins`` sequences open. A bitset says which amounts of free space occur
among them, so the tightest sequence that still takes a piece is found in one step. When a new one is
needed and all are open, the fullest closes first. Only documents longer than a sequence are cut; their
whole pieces fill a sequence by themselves, and the rest is packed.

Packers work side by side, each on millions of tokens, so what the last open sequences leave free is a
small share at any size.

Defined results: a null or empty text is its end token alone; repeated ids are documents of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SHORT, WordPattern, cut, normalised
from .shared import columns, written

LENGTH = 4096
OPEN_BINS = 1024
#: sequences a packer fills on the average
SEQUENCES_A_PACKER = 2048
#: letters below this have one form only: composed, and in lower case once lowered
PLAIN = "\u0300"
#: marks that are a word of their own after letters
MARKS = frozenset(".,;:!?)")
#: pieces of text that a worker remembers as they came in two texts or more, and those that came in one
REMEMBERED, NEW = 100_000, 50_000
#: texts handed to a worker at once, and the setting for that
TEXTS_A_BATCH, BATCH = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


class Ids(dict):
    """Piece of text -> its ids as bytes, from the tokenizers library. Words are encoded many at a time, each once.

    Most pieces never come again, so a piece of one text only is kept apart, among few, until a second text has it.
    """

    def __init__(self, path: str):
        super().__init__()
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.words = WordPattern(next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        suffix = said["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in said["model"]["vocab"].items() if t.endswith(suffix)]] = True
        self.special = [t["content"] for t in said["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.new: dict[str, bytes] = {}
        self.new_before: dict[str, bytes] = {}

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, pieces: list[str]) -> None:
        """Ids of new pieces. Words joined by blanks come back with word ends between them."""
        plan = {}
        for p in pieces:
            text = normalised(p)
            # letters, and one mark after them at most: the pattern takes them apart just so
            if text.isalpha() and (text.isascii() or max(text) < PLAIN):
                plan[p] = (text,)
            elif text[-1:] in MARKS and text[:-1].isalpha() and (text.isascii() or max(text) < PLAIN):
                plan[p] = (text[:-1], text[-1])
            # a piece with a special token, or that changes when normalised again, is left whole
            elif any(s in p for s in self.special) or not text.isascii() and normalised(text) != text:
                self[p] = self.plain(p).tobytes()
            else:
                plan[p] = self.words.findall(text)
        new = list({w for words in plan.values() for w in words if w not in self.known})
        for a in range(0, len(new), 256):
            some = new[a:a + 256]
            ids = self.plain(" ".join(some))
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(cuts) == len(some) and cuts[-1] == 4 * len(ids):
                raw = ids.tobytes()
                made = [raw[x:y] for x, y in zip([0, *cuts], cuts)]
            else:  # a word without an end of its own
                made = [self.plain(w).tobytes() for w in some]
            self.known.update(zip(some, made))
        known = self.known
        for p, words in plan.items():
            self[p] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def of(self, text: str | None) -> bytes:
        pieces, first = cut(text), []
        for p in {p for p in set(pieces) if p not in self}:
            for known in (self.new, self.new_before, self.before):
                if (was := known.pop(p, None)) is not None:
                    self[p] = was
                    break
            else:
                first.append(p)
        if first:
            self.learn(first)
        out = b"".join(map(self.__getitem__, pieces))
        for p in first:
            ids = self.pop(p)
            if len(p) < SHORT:
                self.new[p] = ids
        # each has one generation back: pieces that come again are not worked out anew
        if len(self.new) > NEW:
            self.new_before, self.new = self.new, {}
        if len(self) > REMEMBERED:
            self.before = dict(self)
            self.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return out


@lru_cache(maxsize=1)
def ids_for(path: str) -> Ids:
    """One per worker."""
    return Ids(path)


class Packer:
    """Bounded-space best-fit."""

    def __init__(self, length: int, open_bins: int):
        self.length, self.open_bins = length, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        #: free space -> open sequences
        self.free: list[list[int]] = [[] for _ in range(length + 1)]

    def _take(self, space: int) -> int:
        seq = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return seq

    def place(self, n: int) -> tuple[int, int]:
        """Sequence and offset for a piece of n tokens."""
        fits = self.bits >> n
        if fits:
            space = n + (fits & -fits).bit_length() - 1
            seq = self._take(space)
        else:
            if self.open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, seq = self.length, self.made
            self.made += 1
        left = space - n
        if left:
            self.free[left].append(seq)
            self.bits |= 1 << left
            self.open += 1
        return seq, self.length - space


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of the pieces of every document."""
    names = ["id", "piece", "start", "length", "ids_crc32"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = ids_for(path)
        for batch in batches:
            out = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                raw = ids_of.of(text.as_py()) + end
                n = len(raw) // 4
                out += [(i, k, a, min(length, n - a), zlib.crc32(raw[4 * a:4 * (a + length)])) for k, a in enumerate(range(0, n, length))]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)], names=names)

    rows = columns(docs, id=id_col, text=text_col)
    return rows.withColumn("id", rows["id"].cast("bigint")).mapInArrow(run, "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(docs: DataFrame, path: str, length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    was = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(TEXTS_A_BATCH, int(was)) if int(was) > 0 else TEXTS_A_BATCH))
    try:
        cut_up = written(pieces(docs, path, length, end_id, id_col, text_col), "pieces")
    finally:
        spark.conf.set(BATCH, was)
    whole = cut_up.filter(F.col("length") == length).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    rest = cut_up.filter(F.col("length") < length)
    tokens = rest.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    packers = max(1, math.ceil(tokens / (length * SEQUENCES_A_PACKER)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, base = Packer(length, open_bins), TaskContext.get().partitionId() << 40
        for pdf in batches:
            placed = [packer.place(n) for n in pdf["length"].tolist()]
            yield pdf.assign(sequence_id=[base + s for s, _ in placed], offset=[o for _, o in placed])

    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return whole.unionByName(rest.repartition(packers).mapInPandas(run, schema))
