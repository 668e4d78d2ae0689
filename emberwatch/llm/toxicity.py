"""Toxicity by weak supervision.

Labelled training rows give a lexicon: words and word beginnings that stand far more often in toxic
texts, counted over all of them, near copies once. The lexicon is dealt to many voters, beside a few voters with fixed
patterns; each voter says toxic, clean, or nothing about a text. A generative label model then learns,
with the training label as one more voter, how often each says what for either class, and how voters depend on each other
(two that look at one stem speak together), and gives every text of a bounded sample a posterior. A
linear classifier learns these posteriors from the votes and hit counts, and scores every text.

Parameter that bounds: ``SAMPLE`` rows for the label model and the classifier. Counts of terms cover all
training rows, and all terms that pass are taken; a lexicon over ``LEXICON_BYTES`` is an error.

Defined results: a null or empty text is scored like one without any term; without training labels of
both classes every score is the share of toxic ones among them (0 without any); of several labels of one
id the highest counts; null labels count as none; null ids are scored, never learned from; repeated rows
are scored one by one; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .minhash import near_duplicates
from .shared import columns, sent, written

#: size beyond which a lexicon is refused, not cut
LEXICON_BYTES = 64 << 20
SAMPLE = 20_000
FOLDS = 5
PREFIXES = (4, 5, 6)
#: longer words are terms by their beginnings only
LONGEST = 40
BUCKETS = 8
#: a term must stand in so many, and such a share, of the toxic training texts
MIN_TEXTS, MIN_SHARE = 4, 0.002
#: and so many times as often there as in the others
MIN_RATIO = 20
#: share of the weight of a text's most telling term that another of its terms must have
NEAR_TOP = 0.9
#: chance of taking in any term that means nothing
ERROR = 0.01
#: how often the label of a training row is right
MARKED = 0.98
#: how often a voter calls a clean text toxic, before anything is seen
FALSE_ALARMS = 0.002

#: fixed values: insults, as a voter of their own
INSULTS = frozenset("idiot idiots moron morons stupid scum loser losers pathetic worthless disgusting trash clown clowns imbecile dumb jerk bastard bitch asshole crap shit fuck fucking".split())
WORDS = re.compile(r"[^\W\d_]+")
KINDS = ("word", *[f"p{k}" for k in PREFIXES])
#: one voter for each kind and bucket (toxic), one for texts without any term (clean), then the fixed ones
VOTERS = len(KINDS) * BUCKETS + 1 + 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def terms(text: Column) -> Column:
    """Distinct words in lower case and their beginnings, marked by kind."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    words = F.filter(words, lambda w: w != "")

    def beginnings(k: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.length(w) >= k), lambda w: F.concat(F.lit(f"p{k}:"), F.substring(w, 1, k)))

    whole = F.transform(F.filter(words, lambda w: F.length(w) <= LONGEST), lambda w: F.concat(F.lit("word:"), w))
    return F.array_distinct(F.concat(whole, *map(beginnings, PREFIXES)))


def distinct_texts(train: DataFrame) -> DataFrame:
    """id, toxic of one text of each class and group of exact or near copies. ``train``: id, text, toxic. Texts are read where they are, never stored again."""
    firsts = written(train.groupBy(F.xxhash64("text").alias("hash"), "toxic").agg(F.min("id").alias("id")).select("id", "toxic"), "training-firsts", small=True)
    texts = train.join(sent(firsts, 32 * firsts.count()), ["id", "toxic"])
    groups = near_duplicates(texts, id_col="id").select("id", "component").distinct()
    return written(firsts.join(groups, "id").groupBy("toxic", "component").agg(F.min("id").alias("id")).select("id", "toxic"), "training-texts", small=True)


def learn_lexicon(train: DataFrame) -> tuple[dict[str, float], int, int]:
    """Terms with their weight of evidence, and the rows of both classes. ``train``: id, text, toxic.

    Copies of a text, near ones included, are one piece of evidence: everything is counted in distinct texts.
    Terms of the toxic texts that are frequent enough; how often the others have them; and which of
    those left are the most telling term, or nearly so, of some toxic texts.
    """
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    rows = sizes.get(1, 0), sizes.get(0, 0)
    if not all(rows):
        return {}, *rows
    firsts = distinct_texts(train)
    sizes = {r["toxic"]: r["n"] for r in firsts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    train = train.join(sent(firsts, 32 * sum(sizes.values())), ["id", "toxic"])
    n_pos, n_neg = sizes[1], sizes[0]
    each = train.select("toxic", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term"))
    least = max(MIN_TEXTS, math.ceil(MIN_SHARE * n_pos))
    frequent = written(each.filter("toxic = 1").groupBy("term").agg(F.count("*").alias("pos")).filter(F.col("pos") >= least), "toxic-terms")
    tried = max(1, frequent.count())
    others = each.filter("toxic = 0").join(sent(frequent.select("term"), 64 * tried), "term").groupBy("term").agg(F.count("*").alias("neg"))
    both = frequent.join(others, "term", "left").select("term", F.col("pos").cast("double").alias("pos"), F.coalesce("neg", F.lit(0)).cast("double").alias("neg"))
    # likelihood ratio of the term against no dependence on the class
    n, seen = n_pos + n_neg, F.col("pos") + F.col("neg")
    part = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    gain = 2 * (part(F.col("pos"), seen * n_pos / n) + part(F.col("neg"), seen * n_neg / n) + part(n_pos - F.col("pos"), (n - seen) * n_pos / n) + part(n_neg - F.col("neg"), (n - seen) * n_neg / n))
    ratio = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / n_neg)
    kept = both.withColumn("gain", gain).filter((ratio >= min(MIN_RATIO, n_neg / n_pos * MIN_TEXTS)) & (F.col("gain") > 2 * math.log(tried / ERROR)))
    kept = written(kept.select("term", "gain"), "telling-terms")
    # words that only go along with a more telling term, as in copies of one toxic text, tell nothing of their own
    hits = train.filter("toxic = 1").select("id", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).join(sent(kept, 80 * kept.count()), "term")
    top = F.max("gain").over(Window.partitionBy("id"))
    own = hits.withColumn("top", top).filter(F.col("gain") >= NEAR_TOP * F.col("top")).groupBy("term", "gain").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_TEXTS)
    own = written(own.select("term", "gain"), "lexicon", small=True)
    size = own.agg(F.coalesce(F.sum(F.octet_length("term") + 100), F.lit(0)).alias("n")).first()["n"]
    if size > LEXICON_BYTES:
        raise ValueError(f"the lexicon takes {size} bytes, more than the {LEXICON_BYTES} that go with every task")
    return {r["term"]: r["gain"] for r in own.orderBy(F.col("gain").desc(), "term").collect()}, *rows


class Voters:
    """Votes and hit counts of a text. The lexicon is at most ``LEXICON_BYTES``."""

    def __init__(self, lexicon: dict[str, float]):
        self.tables = [{t.split(":", 1)[1]: zlib.crc32(t.encode()) % BUCKETS for t in lexicon if t.startswith(kind + ":")} for kind in KINDS]

    def __call__(self, text: str | None) -> tuple[list[int], list[int]]:
        votes, counts = [0] * VOTERS, [0] * len(KINDS)
        whole, starts = self.tables[0], list(zip(PREFIXES, self.tables[1:]))
        found = WORDS.findall((text or "").lower())
        words = set(found)
        for w in words & whole.keys():
            votes[whole[w]] = 1
            counts[0] += 1
        for kind, (k, table) in enumerate(starts, 1):
            for s in table.keys() & {w[:k] for w in words if len(w) >= k}:
                votes[kind * BUCKETS + table[s]] = 1
                counts[kind] += 1
        base = len(KINDS) * BUCKETS
        insults, any_term = len(words & INSULTS), sum(counts)
        votes[base] = 0 if any_term else -1
        votes[base + 1] = 1 if insults else 0
        votes[base + 2] = 1 if insults > 1 or any_term > 3 else 0
        votes[base + 3] = -1 if not insults and not any_term and len(found) > 30 else 0
        return votes, counts


class LabelModel:
    """Class-conditional vote rates by expectation maximisation, with votes of dependent voters counted for less."""

    def __init__(self, prior: float, rounds: int = 25, false_alarms: float | None = None):
        self.prior, self.rounds, self.false_alarms = min(max(prior, 1e-3), 1 - 1e-3), rounds, false_alarms

    def fit(self, votes: np.ndarray, marked: np.ndarray | None = None) -> np.ndarray:
        """Posterior of class 1 for each row. ``marked``, the rows' own labels, counts as a voter that is right with ``MARKED``."""
        marks = 0.0 if marked is None else np.where(marked == 1, 1, -1) * np.log(MARKED / (1 - MARKED))
        said = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # rows x voters x 3
        # before anything is learned: voters are right three times in four
        rate = np.stack([np.full((votes.shape[1], 3), 1 / 3)] * 2)
        rate[0, :, 0], rate[0, :, 2] = 0.5, 1 / 6
        rate[1, :, 2], rate[1, :, 0] = 0.5, 1 / 6
        spoken = (votes != 0).astype(float)
        weight = self._weights(votes.astype(float), 0.9)  # voters that say the same are one
        for step in range(self.rounds):
            odds = np.einsum("ijk,jk->ij", said, np.log(rate[1]) - np.log(rate[0]))
            if step == 0:
                odds *= spoken
            logit = np.log(self.prior / (1 - self.prior)) + odds @ weight + marks
            post = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            if step >= self.rounds // 4:  # voters that are dependent given the class share their weight
                weight = self._weights(votes - (np.outer(post, self._mean(votes, post)) + np.outer(1 - post, self._mean(votes, 1 - post))), 0.25)
            for c, p in ((0, 1 - post), (1, post)):
                rate[c] = (np.einsum("i,ijk->jk", p, said) + 0.05) / (p.sum() + 0.15)
            if self.false_alarms is not None:
                # terms were taken in for standing in few clean texts: that is held as a prior
                clean, held = (1 - post).sum(), 5 * len(votes)
                false = (rate[0, :, 2] * clean + self.false_alarms * held) / (clean + held)
                rate[0, :, :2] *= ((1 - false) / (1 - rate[0, :, 2]).clip(min=1e-9))[:, None]
                rate[0, :, 2] = false
        self.rate, self.weight = rate, weight
        return post

    def _weights(self, left: np.ndarray, bound: float) -> np.ndarray:
        """Weights from the correlations of what is left of the votes; those above the bound count."""
        left = left - left.mean(axis=0)
        spread = np.sqrt((left**2).mean(axis=0))
        same = np.abs((left / np.maximum(spread, 1e-9)).T @ (left / np.maximum(spread, 1e-9)) / len(left))
        same[spread < 1e-6] = 0
        np.fill_diagonal(same, 1)
        self.correlation = same
        return 1 / np.where(same > bound, same, 0).sum(axis=1).clip(min=1)

    @staticmethod
    def _mean(votes: np.ndarray, p: np.ndarray) -> np.ndarray:
        return p @ votes / max(p.sum(), 1e-9)


def features(votes, counts) -> np.ndarray:
    return np.concatenate([np.asarray(votes, float), np.log1p(np.asarray(counts, float))], axis=-1)


def fit_linear(x: np.ndarray, p: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (q - p) + penalty * w
        hess = (x * (q * (1 - q) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Voters and weights, small enough to go with the tasks."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None, share: float):
        self.voters, self.weights, self.share = Voters(lexicon), weights, share

    def score(self, texts) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.share)
        if not len(texts):
            return np.zeros(0)
        votes, counts = zip(*map(self.voters, texts))
        z = features(np.array(votes), np.array(counts)) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled rows outside the held-out fold."""
    known = columns(labels, id="doc_id", toxic=label_col).filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = written(known.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic")), "known-labels", small=True)
    rows = columns(docs, id=id_col, text=text_col)
    train = rows.join(sent(known, 32 * known.count()), "id")
    lexicon, n_pos, n_neg = learn_lexicon(train)
    share = n_pos / (n_pos + n_neg) if n_pos + n_neg else 0.0
    if not lexicon:
        return Model({}, None, share)
    voters = docs.sparkSession.sparkContext.broadcast(Voters(lexicon))
    # a bounded sample of training rows, the same for the same ids
    chosen = known.select("id", "toxic").orderBy(F.xxhash64("id"), "id").limit(SAMPLE)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [voters.value(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[pa.array([g[i] for g in got], pa.list_(pa.int32())) for i in (0, 1)], batch.column("toxic")], names=["votes", "counts", "toxic"])

    got = rows.join(F.broadcast(chosen), "id").select("text", "toxic").mapInArrow(vote, "votes array<int>, counts array<int>, toxic int").limit(2 * SAMPLE).collect()
    votes, counts = np.array([r["votes"] for r in got]), np.array([r["counts"] for r in got])
    post = LabelModel(share, false_alarms=FALSE_ALARMS).fit(votes, np.array([r["toxic"] for r in got]))
    return Model(lexicon, fit_linear(features(votes, counts), post), share)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted of every text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score([t.as_py() for t in batch.column("text")])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score, pa.float64())], names=["id", "score"])

    rows = columns(docs, id=id_col, text=text_col)
    done = rows.withColumn("id", F.col("id").cast("bigint")).mapInArrow(run, "id bigint, score double")
    return done.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not call toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = held.value.score([t.as_py() for t in batch.column(at)])
            yield batch.filter(pa.array(score < 0.5, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
