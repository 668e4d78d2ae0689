"""Chunk starts by a fold over lengths, against a plain loop; long texts take linear time."""

import random
import time

import pytest
from pyspark.sql import functions as F

from emberwatch.operators import retrieve as R


def plain(text, size):
    if text is None:
        return []
    out, cur = [], ""
    for para in text.split("\n\n"):
        if len(cur) + len(para) < size:
            cur += para + "\n\n"
        else:
            if cur:
                out.append(cur.strip())
            cur = para + "\n\n"
    return out + ([cur.strip()] if cur.strip() else [])


@pytest.mark.parametrize("fold", [1, 3, 256])
def test_chunks_equal_a_plain_loop(spark, monkeypatch, fold):
    monkeypatch.setattr(R, "FOLD", fold)
    rng = random.Random(fold)
    texts = [None, "", "\n\n", "   ", "é" * 60, "a\n\n\n\nb", "x" * 19, "x" * 20]
    texts += ["\n\n".join("w" * rng.choice([0, 1, 5, 9, 18, 20, 40]) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in R.chunk_rows(docs, "text", 20).orderBy("id", "position").collect():
        got.setdefault(r.id, []).append((r.position, r.content))
    assert got == {i: list(enumerate(c)) for i, t in enumerate(texts) if (c := plain(t, 20))}


def test_a_text_of_many_paragraphs_is_cut_in_seconds(spark):
    text = "\n\n".join("p" * 300 for _ in range(20_000))
    docs = spark.createDataFrame([(1, text)], "id int, text string")
    start = time.time()
    n, longest = R.chunk_rows(docs, "text").agg(F.count("*"), F.max(F.length("content"))).first()
    assert (n, longest) == (20_000, 300)
    assert time.time() - start < 30


def test_vectors_of_texts_without_tokens_are_zero(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "one two one")], "id int, text string")
    got = {r.id: r.e for r in docs.select("id", R.embed("text").alias("e")).collect()}
    assert set(map(len, got.values())) == {R.DIM} and not any(got[1]) and not any(got[2])
    assert sum(x * x for x in got[3]) == pytest.approx(1)
