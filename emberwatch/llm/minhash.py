"""Near-duplicate documents by min-max hashing.

Each hash function over a document's shingles gives two signature values, its least and its greatest, so
half the evaluations fill a signature. ``BANDS`` bands of ``ROWS`` values make buckets; documents that
share a bucket are candidates. Candidates are confirmed on their full shingle sets, and confirmed links
are joined into components.

Groups of any size stay cheap without losing a link. Documents with equal sets form one class, with one
member going on. In a bucket every class first meets the bucket's smallest only. Where classes of a
bucket are still in different components after that, all pairs of different components in the bucket are
compared in tiles: the members come in packed blocks, a task compares two blocks, and what leaves it are
the confirmed links alone. A pair that shares several buckets is compared in the first of them, and only
if its sizes and its signatures leave a similarity of the threshold possible.

A pair at the threshold of 0.75 shares no bucket with a chance of 1e-4, a pair at 0.8 of 3e-6.

Defined results: a null or empty text, or one of white space, has no shingles and is linked with nothing;
a text of fewer words than a shingle is one shingle; rows with a null id are classes of their own and
never leave; repeated ids are one vertex; other columns are carried by ``deduplicated`` and not read
otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import columns, written

WORDS = 5
PERCENT = 75
ROWS, BANDS = 4, 24
FUNCTIONS = ROWS * BANDS // 2
#: classes in a packed block
BLOCK = 256
#: signature agreement below which a pair cannot have the threshold's similarity (more than five standard deviations off)
AGREEMENT = 0.5

_RANDOM = np.random.default_rng(20240229)
_BYTE = _RANDOM.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(1 << 63, size=FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP, _WORD_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def powers(step: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, step, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of a text, in order. raw: its UTF-8 bytes; A-Z count as a-z, words end at blanks and 0x09-0x0D."""
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.flatnonzero(~blank)
    place = inside - np.repeat(starts, ends - starts)
    sums = np.add.reduceat(_BYTE[raw[inside]] * powers(_STEP, int((ends - starts).max()))[place], np.concatenate(([0], np.cumsum(ends - starts)[:-1])))
    return mixed(sums + (ends - starts).astype(np.uint64))


def shingle_set(text: bytes) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, ascending."""
    w = word_hashes(np.frombuffer(text, np.uint8))
    if not len(w):
        return w
    k = min(WORDS, len(w))
    s = np.zeros(len(w) - k + 1, np.uint64)
    for j, p in enumerate(powers(_WORD_STEP, k)):
        s += w[j: len(w) - k + 1 + j] * p
    return np.unique(mixed(s + np.uint64(k)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least and the greatest value of every hash function."""
    low, high = np.empty(FUNCTIONS, np.uint64), np.empty(FUNCTIONS, np.uint64)
    for a in range(0, FUNCTIONS, 8):
        v = shingles[None, :] * _FACTORS[a:a + 8, None]
        v ^= v >> np.uint64(31)
        low[a:a + 8], high[a:a + 8] = v.min(axis=1), v.max(axis=1)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key a band. Values of one function lie far apart in the signature, so few bands hold both of its values."""
    parts = mixed(sig).reshape(BANDS, ROWS)
    return mixed((parts * powers(_STEP, ROWS)[None, :]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _utf8(column: pa.Array) -> Iterator[bytes]:
    return ((t.as_buffer().to_pybytes() if t.is_valid else b"") for t in column.cast(pa.binary()))


def sketches(rows: DataFrame) -> DataFrame:
    """id, n, same (two numbers that equal sets share), keys (of the bands), sig (8 bits a value), of columns id and text."""
    names = ["id", "n", "same", "keys", "sig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, same, keys, sig = [], [], [], []
            for raw in _utf8(batch.column("text")):
                s = shingle_set(raw)
                n.append(len(s))
                if len(s):
                    values = signature(s)
                    same.append([int(s.sum(dtype=np.uint64).view(np.int64)), int(mixed(s).sum(dtype=np.uint64).view(np.int64))])
                    keys.append(band_keys(values))
                    sig.append((values >> np.uint64(20)).astype(np.uint8).tobytes())
                else:
                    same.append(None)
                    keys.append(None)
                    sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(same, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64())), pa.array(sig, pa.binary())], names=names)

    return rows.withColumn("id", F.col("id").cast("bigint")).mapInArrow(run, "id bigint, n bigint, same array<bigint>, keys array<bigint>, sig binary")


def shingled(rows: DataFrame) -> DataFrame:
    """id and its full set, of columns id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, raw in zip(batch.column("id").to_pylist(), _utf8(batch.column("text"))):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([shingle_set(raw).tobytes()], pa.binary())], names=["id", "shingles"])

    return rows.mapInArrow(run, "id bigint, shingles binary")


def similar(n_a: Column, n_b: Column, both: Column, percent: int) -> Column:
    return 100 * both >= percent * (n_a + n_b - both)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for p, q in zip(x, y):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            c = common(p, q)
            out.append(100 * c >= percent * (len(p) + len(q) - c))
        return pd.Series(out, dtype=bool)

    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(two, "b").join(one, "a").filter(linked("x", "y")).select("a", "b")


def open_links(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components within buckets. members: band, key, id, component, n, keys, sig, shingles.

    The members outside a bucket's largest component meet all members, both dealt to blocks of about
    ``BLOCK`` by hash; two blocks meet in one task.
    """
    bucket = ["band", "key"]
    sizes = members.groupBy(*bucket, "component").agg(F.count("*").alias("c"))
    main = sizes.groupBy(*bucket).agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    dealt = members.join(main, bucket).withColumn("outside", F.col("component") != F.col("main"))
    dealt = dealt.withColumn("ways_i", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int")).withColumn("ways_j", F.ceil(F.col("all") / BLOCK).cast("int")).drop("main", "all", "most")
    deal = lambda ways: F.pmod(F.xxhash64("id"), F.col(ways)).cast("int")
    left = dealt.filter("outside").withColumn("i", deal("ways_i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("ways_j") - 1))).withColumn("side", F.lit(0))
    right = dealt.withColumn("j", deal("ways_j")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ways_i") - 1))).withColumn("side", F.lit(1))

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = []
        if len(x) and len(y):
            band, joined = int(pdf["band"].iloc[0]), {}
            keys_y, sig_y = np.stack(y["keys"].to_numpy()), np.stack([np.frombuffer(s, np.uint8) for s in y["sig"]])
            id_y, comp_y, n_y, outside_y = (y[c].to_numpy() for c in ("id", "component", "n", "outside"))
            sets_y = [np.frombuffer(s, np.uint64) for s in y["shingles"]]

            def root(c: int) -> int:
                while (p := joined.get(c, c)) != c:
                    c = p
                return c

            for i, comp, n, keys, sig, raw in zip(x["id"], x["component"], x["n"], x["keys"], x["sig"], x["shingles"]):
                # two outside members meet twice; once is enough
                at = np.flatnonzero((comp_y != comp) & (100 * np.minimum(n, n_y) >= percent * np.maximum(n, n_y)) & (~outside_y | (id_y > i)))
                at = at[~(keys_y[at, :band] == keys[:band]).any(axis=1)]
                at = at[(sig_y[at] == np.frombuffer(sig, np.uint8)).mean(axis=1) >= AGREEMENT]
                own = np.frombuffer(raw, np.uint64)
                for k in at:
                    if root(comp) == root(comp_y[k]):
                        continue
                    c = common(own, sets_y[k])
                    if 100 * c >= percent * (n + n_y[k] - c):
                        found.append((i, id_y[k]))
                        joined[root(comp)] = root(comp_y[k])
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    # dealt by tile in so many words: a union of two sides dealt alike by bucket would be taken as dealt already
    return left.unionByName(right).repartition(*bucket, "i", "j").groupBy(*bucket, "i", "j").applyInPandas(tile, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component (smallest id reachable), kept (id = component) of every row."""
    rows = columns(docs, id=id_col, text=text_col)
    sketch = written(sketches(rows), "sketches")
    classes = sketch.filter(F.col("same").isNotNull() & F.col("id").isNotNull()).groupBy("same").agg(F.min("id").alias("class"))
    heads = written(sketch.join(classes, (sketch["same"] == classes["same"]) & (sketch["id"] == classes["class"])).select("id", "n", "keys", "sig").dropDuplicates(["id"]), "classes")
    banded = heads.select("id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = written(banded.groupBy("band", "key").agg(F.min("id").alias("first"), F.count("*").alias("members")).filter("members > 1"), "buckets")
    shared = written(banded.join(buckets, ["band", "key"]).select("band", "key", "id", "first", "n"), "bucket-members")
    # first meeting: everyone with the bucket's smallest
    size = heads.select(F.col("id").alias("first"), F.col("n").alias("n_first"))
    pairs = shared.filter("id <> first").select("first", "id", "n").distinct().join(size, "first")
    pairs = pairs.filter(100 * F.least("n", "n_first") >= percent * F.greatest("n", "n_first")).select(F.col("first").alias("a"), F.col("id").alias("b"))
    wanted = shared.select("id").distinct()
    sets = written(shingled(rows.withColumn("id", F.col("id").cast("bigint")).join(wanted, "id")).dropDuplicates(["id"]), "shingle-sets")
    links = written(confirmed(pairs, sets, percent), "links")
    part = written(components(links), "components")
    # second meeting: buckets that still hold different components
    placed = shared.select("band", "key", "id", "n").join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
    still = placed.groupBy("band", "key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("band", "key")
    members = placed.join(still, ["band", "key"]).join(heads.select("id", "keys", "sig"), "id").join(sets, "id")
    more = written(open_links(members, percent), "links")
    whole = components(links.unionByName(more))
    of_class = classes.join(whole, classes["class"] == whole["id"], "left").select("same", F.coalesce("component", "class").alias("component"))
    out = sketch.select("id", "n", "same").join(of_class, "same", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component")).withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(True)))


def deduplicated(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, of which one of each component stays."""
    gone = near_duplicates(docs, percent, id_col, text_col).filter(~F.col("kept")).select(F.col("id").alias("_gone")).distinct()
    return docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
