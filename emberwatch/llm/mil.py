"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of ``WORDS`` words. Every passage is encoded: shares of character classes, of word shapes and
lengths and of hashed pairs of letters, how many of its words are distinct or repeat the one before, through a
learned layer. A gated attention (tanh times sigmoid) learned from document labels gives each passage a
weight, and the document's score is that of the weighted mean of its encoded passages, so that a
few bad passages can decide about a long text.

Parameters that bound: the model is fitted on at most ``SAMPLE`` distinct labelled texts, chosen by hash, of each
at most ``BAG`` passages evenly spread over the text. Scoring reads every passage of every text; a passage adds
to two sums, so a text of any length needs no more than a chunk of ``CHUNK`` bytes at a time.

Defined results: a null or empty text is one passage without words; copies of a text count once in training; of
several labels of one text the lowest counts; null labels and ids are never learned from; without training
labels of both classes every score is the share of good ones among them (0 without any); repeated rows are scored
one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, written
from .toxicity import held_out

SAMPLE = 6000
BAG = 32
WORDS = 48
CHUNK = 1 << 20
PAIRS = 32
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE, DECAY = 16, 128, 4e-3, 1e-4
SEED = 7

#: character classes: small, capital, digit, then groups of signs, then bytes of other characters
_GROUPS = (".,", ";:", "!", "?", "'\"", "-", "()", "|", "#", "$%", "&*", "@_", "<>{}[]=/\\", "+^~`")
_SMALL, _CAPITAL, _DIGIT, _OTHER = 0, 1, 2, 3 + len(_GROUPS)
CLASSES = _OTHER + 1


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.int64)
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = _SMALL, _CAPITAL, _DIGIT
    for i, signs in enumerate(_GROUPS, 3):
        table[list(signs.encode())] = i
    return table


_CLASS = _class_table()
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.random.default_rng(SEED).integers(1, 2**63, 64, dtype=np.uint64)
#: word lengths up to which a word falls into a group
_LENGTHS = np.array([1, 3, 6, 10, 15, 30])
SHAPES = 7
WIDTH = CLASSES + PAIRS + len(_LENGTHS) + 1 + SHAPES


def encode(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts ``data[bounds[i]:bounds[i + 1]]``, and the text of each passage. A text without words has one passage of zeros."""
    docs = len(bounds) - 1
    solid = ~_SPACE[data]
    before = np.empty(len(data), bool)  # whether the byte before is part of the same text and no space
    before[1:] = solid[:-1]
    inner = bounds[:-1][bounds[:-1] < len(data)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    doc_of_word = np.searchsorted(bounds, starts, side="right") - 1
    words_of = np.bincount(doc_of_word, minlength=docs)
    rank = np.arange(len(starts)) - (np.cumsum(words_of) - words_of)[doc_of_word]
    passages_of = np.maximum(1, -(-words_of // WORDS))
    first = np.cumsum(passages_of) - passages_of
    count = int(passages_of.sum())
    owner = np.repeat(np.arange(docs), passages_of)
    out = np.zeros((count, WIDTH))
    if not len(starts):
        return out.astype(np.float32), owner
    of_word = first[doc_of_word] + rank // WORDS  # passage of each word
    place = np.flatnonzero(solid)
    word = np.searchsorted(starts, place, side="right") - 1
    of_byte, b = of_word[word], data[place]
    length = np.bincount(word, minlength=len(starts))
    kind = _CLASS[b]
    size = np.bincount(of_byte, minlength=count).clip(min=1)[:, None]
    out[:, :CLASSES] = np.bincount(of_byte * CLASSES + kind, minlength=count * CLASSES).reshape(count, CLASSES) / size
    # pairs of bytes within a word, letters of either case alike
    folded = np.where(kind == _CAPITAL, b + 32, b).astype(np.int64)
    pair = (folded[:-1] * 31 + folded[1:] * 17) % PAIRS
    together = word[:-1] == word[1:]
    pairs = np.bincount((of_byte[1:] * PAIRS + pair)[together], minlength=count * PAIRS).reshape(count, PAIRS)
    out[:, CLASSES : CLASSES + PAIRS] = pairs / pairs.sum(axis=1, keepdims=True).clip(min=1)
    n = np.bincount(of_word, minlength=count).clip(min=1).astype(float)
    at = CLASSES + PAIRS
    groups = len(_LENGTHS) + 1
    out[:, at : at + groups] = np.bincount(of_word * groups + np.searchsorted(_LENGTHS, length), minlength=count * groups).reshape(count, groups) / n[:, None]
    at += groups
    share = lambda test: np.bincount(of_word, weights=test, minlength=count) / n
    edge = np.searchsorted(word, np.arange(len(starts)))
    capital, small = (np.bincount(word, weights=kind == k, minlength=len(starts)) for k in (_CAPITAL, _SMALL))
    signs = np.bincount(word, weights=(kind > _DIGIT + 1) & (kind < _OTHER), minlength=len(starts))
    mixed = np.add.reduceat(b.astype(np.uint64) * _MIX[(place - starts[word]) & 63], edge)
    same = np.zeros(len(starts), bool)
    same[1:] = (mixed[1:] == mixed[:-1]) & (of_word[1:] == of_word[:-1])
    one = np.unique(mixed * np.uint64(0x9E3779B97F4A7C15) + of_word.astype(np.uint64) * _MIX[0], return_index=True)[1]
    out[:, at] = share((capital == 1) & (kind[edge] == _CAPITAL))
    out[:, at + 1] = share((capital > 1) & (small == 0))
    out[:, at + 2] = share(signs > 0)
    out[:, at + 3] = share(same)
    out[:, at + 4] = np.bincount(of_word[one], minlength=count) / n
    out[:, at + 5] = np.log1p(np.bincount(of_word, weights=length, minlength=count) / n)
    out[:, at + 6] = np.log1p(n) * (np.bincount(of_word, minlength=count) > 0)
    return out.astype(np.float32), owner


def chunks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes, bounds and row numbers of whole texts up to ``CHUNK`` bytes together; a longer text is cut at white space where there is some."""
    held, bounds, rows = [], [0], []

    def given():
        return np.frombuffer(b"".join(held), np.uint8), np.array(bounds), np.array(rows)

    for i, text in enumerate(texts):
        raw = (text.as_py() or "").encode()
        while True:
            piece = raw
            if len(raw) > CHUNK:
                cut = max(raw.rfind(b" ", 0, CHUNK), raw.rfind(b"\n", 0, CHUNK)) + 1 or CHUNK
                piece, raw = raw[:cut], raw[cut:]
            if held and bounds[-1] + len(piece) > CHUNK:
                yield given()
                held, bounds, rows = [], [0], []
            held.append(piece)
            bounds.append(bounds[-1] + len(piece))
            rows.append(i)
            if piece is raw:
                break
    if rows:
        yield given()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Attention:
    """Encoder, gated attention and linear score. Weights of a passage are exponentials of a bounded number, so they can be summed over any pieces of a text."""

    def __init__(self, width: int = WIDTH):
        rng = np.random.default_rng(SEED)
        scale = lambda a, b: rng.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"enc": scale(width, HIDDEN), "enc0": np.zeros(HIDDEN), "tan": scale(HIDDEN, GATE), "sig": scale(HIDDEN, GATE), "att": scale(GATE, 1)[:, 0], "out": scale(HIDDEN, 1)[:, 0], "out0": np.zeros(1)}
        self.mean, self.spread = np.zeros(width), np.ones(width)

    def passages(self, x: np.ndarray):
        """Encoded passages and the parts of their attention."""
        h = np.tanh((x - self.mean) / self.spread @ self.w["enc"] + self.w["enc0"])
        t, s = np.tanh(h @ self.w["tan"]), _sigmoid(h @ self.w["sig"])
        return h, t, s, np.exp(np.clip((t * s) @ self.w["att"], -30, 30))

    def score(self, weighted: np.ndarray, total: np.ndarray) -> np.ndarray:
        return _sigmoid(weighted / total[:, None] @ self.w["out"] + self.w["out0"][0])

    def fit(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> Attention:
        """Adam on the logistic loss of whole documents. ``owner`` ascends and names each document at least once."""
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.w["out0"][0] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
        bounds = np.r_[np.searchsorted(owner, np.arange(len(y))), len(owner)]
        moment = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        rng, step = np.random.default_rng(SEED), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                docs = np.sort(order[lo : lo + BATCH])
                sizes = bounds[docs + 1] - bounds[docs]
                rows = np.repeat(bounds[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                grad = self._gradient(x[rows], np.repeat(np.arange(len(docs)), sizes), y[docs])
                step += 1
                for k, g in grad.items():
                    g = g + DECAY * self.w[k]
                    moment[k] = 0.9 * moment[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - RATE * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradient(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        h, t, s, e = self.passages(x)
        starts = np.searchsorted(owner, np.arange(len(y)))
        a = e / np.add.reduceat(e, starts)[owner]
        z = np.add.reduceat(a[:, None] * h, starts)
        error = (_sigmoid(z @ self.w["out"] + self.w["out0"][0]) - y) / len(y)
        back = (error[:, None] * self.w["out"])[owner]
        pull = (h * back).sum(axis=1)
        d_e = a * (pull - np.add.reduceat(a * pull, starts)[owner])
        d_gate = d_e[:, None] * self.w["att"]
        d_t, d_s = d_gate * s * (1 - t * t), d_gate * t * s * (1 - s)
        d_h = (a[:, None] * back + d_t @ self.w["tan"].T + d_s @ self.w["sig"].T) * (1 - h * h)
        scaled = (x - self.mean) / self.spread
        return {"enc": scaled.T @ d_h, "enc0": d_h.sum(axis=0), "tan": h.T @ d_t, "sig": h.T @ d_s, "att": (t * s).T @ d_e, "out": z.T @ error, "out0": np.array([error.sum()])}


class Model:
    """Attention, or the share of good texts where nothing could be learned."""

    def __init__(self, attention: Attention | None, share: float):
        self.attention, self.share = attention, share

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.attention is None or not len(texts):
            return np.full(len(texts), self.share)
        weighted, total = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts))
        for data, bounds, rows in chunks(texts):
            x, owner = encode(data, bounds)
            h, _, _, e = self.attention.passages(x)
            starts = np.searchsorted(owner, np.arange(len(rows)))
            np.add.at(weighted, rows, np.add.reduceat(e[:, None] * h, starts))
            np.add.at(total, rows, np.add.reduceat(e, starts))
        return self.attention.score(weighted, total)


def bag(text: pa.Scalar) -> np.ndarray:
    """Features of at most ``BAG`` passages of a text, evenly spread."""
    found = np.concatenate([encode(data, bounds)[0] for data, bounds, _ in chunks(pa.array([text.as_py()], pa.string()))])
    return found if len(found) <= BAG else found[np.linspace(0, len(found) - 1, BAG).round().astype(int)]


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learns from labelled rows outside the held-out fold."""
    known = columns(labels, id="doc_id", good=label_col).filter(F.col("good").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    rows = columns(docs, id=id_col, text=text_col).withColumn("hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    # one row a text: ids and hashes only
    texts = rows.select("id", "hash").join(known, "id").groupBy("hash").agg(F.min("id").alias("id"), F.min("good").cast("int").alias("good"))
    texts = written(texts, "quality-texts", small=True)
    sizes = {r["good"]: r["n"] for r in texts.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    good, bad = sizes.get(1, 0), sizes.get(0, 0)
    share = good / (good + bad) if good + bad else 0.0
    if not good or not bad:
        return Model(None, share)
    chosen = written(texts.orderBy(F.xxhash64("hash"), "hash").limit(SAMPLE), "quality-sample", small=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(t).ravel() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("good"), pa.array(bags, pa.list_(pa.float32()))], names=["hash", "good", "bag"])

    # at most SAMPLE rows are sent, and come back
    found = rows.join(F.broadcast(chosen), ["id", "hash"]).select("hash", "good", "text").mapInArrow(run, "hash bigint, good int, bag array<float>")
    got = sorted(found.dropDuplicates(["hash"]).collect(), key=lambda r: r["hash"])
    bags = [np.array(r["bag"], np.float32).reshape(-1, WIDTH) for r in got]
    owner = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    return Model(Attention().fit(np.concatenate(bags).astype(float), owner, np.array([r["good"] for r in got], float)), share)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least: float = 0.3) -> DataFrame:
    """id, held_out, score, predicted of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(held.value.scores(batch.column("text")), pa.float64())], names=["id", "score"])

    rows = columns(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    done = rows.mapInArrow(run, "id bigint, score double")
    return done.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
