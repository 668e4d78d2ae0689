"""Main text of pages, toxicity on held-out rows, the pipeline, and that nothing else needs this subpackage."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from emberwatch.llm import html, minhash, packing, queries, toxicity

STORY = "The quick brown fox was on the way to the end of the road and it is where we all are in this story of the day."


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a", "a"), ("<", "<"), ("<p", ""), ("a &amp; b &copy", "a & b"), ("<script>if (a < b) '</p>'", ""),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{STORY}</p><p>Yes.</p></article><footer>All of it is ours and not for you.</footer>", f"T\n{STORY}\nYes."),
    (f"<header><h1>Site</h1></header><div id=content><h2>Of it</h2><p>{STORY}<p>Short.<p>{STORY} &#x263A;</div><div class='side-bar widget'><p>{STORY}</p></div>", f"Of it\n{STORY}\nShort.\n{STORY} ☺"),
    (f"<main class='has-sidebar'><p>One\n  two&nbsp;<b>three</b><br>four</p><aside>{STORY}</aside><form><p>{STORY}</p></form><section id=comments><p>{STORY}</p></section></main>", "One two three four"),
    (f"<ul><li><a>One of the links in the list</a></li><li><a>And the other of them all</a></li></ul><p>{STORY}</p>", STORY),
    (f"<article><header><h1>Head</h1></header><p>{STORY}</p><div class=cookieNotice>We use it.</div><style>p{{}}</style><!-- <p>no</p> --></article>", f"Head\n{STORY}"),
    (f"<article><p>{STORY}</p><p>cut off &am", f"{STORY}\ncut off"), ("<article>" + "<div>" * 3000 + "deep</article>", "deep"),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


def test_long_pages_take_linear_time():
    import time

    start = time.process_time()
    assert html.main_text("<article>" + "<p>of the word</p>" * 30_000 + "<a " * 20_000).count("\n") == 29_999
    assert time.process_time() - start < 20


def test_extracted(spark):
    df = spark.createDataFrame([(1, "u", f"<article><p>{STORY}</p></article>", "x"), (2, None, None, "x"), (2, "v", "", "x"), (None, "w", "é", "x")], "page_id bigint, url string, html string, text string")
    got = sorted((r["id"] or 0, r["url"] or "", r["text"], r["n_chars"]) for r in html.extracted(df).collect())
    assert got == [(0, "w", "é", 1), (1, "u", STORY, len(STORY)), (2, "", "", 0), (2, "v", "", 0)]
    assert html.extracted(df.limit(0)).count() == 0


def toxic_corpus():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "on", "is", "le", "st", "re"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(3000):
        text = [word() for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.12
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(["moron", "SCUM", f"zurvog{word()}", f"Qibla{word()}"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, "en", 3.0) for i, t, _ in rows] + [(9001, None, "en", 0.0), (9002, "", "en", 0.0), (None, "moron", "en", 0.0), (1, rows[1][1], "en", 0.0)], "doc_id bigint, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(4, None), (None, 1), (5, rows[5][2])], "doc_id bigint, toxic int")
    model = toxicity.train_model(docs, labels)
    got = {(r["id"], r["held_out"]): (r["score"], r["predicted"]) for r in toxicity.scored(docs, model).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in got if i is not None) and (None, False) in got
    truth = {i: y for i, _, y in rows}
    hits = [(p, truth[i]) for (i, h), (_, p) in got.items() if h and i in truth]
    assert len(hits) > 400 and sum(p == y for p, y in hits) / len(hits) > 0.98
    assert all(0 <= s <= 1 and p == (s >= 0.5) for s, p in got.values())
    assert [p for (i, _), (_, p) in got.items() if i in (9001, 9002)] == [0, 0]
    kept = toxicity.kept(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(r["predicted"] for r in toxicity.scored(docs, model).collect())


def test_labels_of_the_held_out_fold_are_never_read(spark):
    rows = toxic_corpus()[:800]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    score = lambda labels: [tuple(r) for r in toxicity.scored(docs, toxicity.train_model(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))).orderBy("id").collect()]
    assert score([(i, y) for i, _, y in rows]) == score([(i, 1 - y if held(i) else y) for i, _, y in rows])


def test_lexicon_keeps_every_telling_term(spark):
    """Four texts share 6,000 toxic words, each as telling as the rarer insult of other texts: none is cut."""
    letters = lambda i: "".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0))
    # each in an order of its own, so that the texts are no copies of each other
    long = [" ".join(f"{letters(i)}{letters(7 * i + 1)}" for i in random.Random(j).sample(range(6000), 6000)) + f" own{letters(j)}" for j in range(4)]
    rows = [(j, t, 1) for j, t in enumerate(long)] + [(10 + j, f"zzzzurvog {letters(j)}", 1) for j in range(4)] + [(100 + j, f"calm words {letters(50 * j + 3)}", 0) for j in range(300)]
    lexicon, n_pos, n_neg = toxicity.learn_lexicon(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    assert (n_pos, n_neg) == (8, 300) and "word:zzzzurvog" in lexicon
    assert len(lexicon) > 6000


@pytest.mark.parametrize("near", [False, True])
def test_copies_of_one_toxic_text_are_one_piece_of_evidence(spark, near):
    """One toxic text makes up a third of the rows: the insults of the other toxic texts stay in the lexicon."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(5))
    rows = [(" ".join(word() for _ in range(9)), 0) for _ in range(240)]
    rows += [(" ".join([*(word() for _ in range(8)), "zurvog"]), 1) for _ in range(12)]
    lexicon = lambda rows: toxicity.learn_lexicon(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id bigint, text string, toxic int"))[0]
    long = [word() for _ in range(400)]
    copies = [(" ".join(long[:-1] + [word()] if near else long), 1) for _ in range(126)]
    alone = lexicon(rows + copies[:1])
    assert "word:zurvog" in alone
    assert lexicon(rows + copies).keys() == alone.keys()


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "moron"), (2, "of")], "doc_id bigint, text string")
    for labels, want in (([], 0.0), ([(1, 1), (2, 1)], 1.0), ([(1, 0)], 0.0)):
        model = toxicity.train_model(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {want}


def test_label_model_finds_accuracies_and_dependence():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    right = lambda p: np.where(rng.random(4000) < p, y, ~y) * 2 - 1
    good, fair, bad = right(0.95), right(0.8), right(0.55)
    votes = np.stack([good, fair, bad, bad, bad, right(0.85)], axis=1)
    model = toxicity.LabelModel(0.2)
    post = model.fit(votes)
    assert ((post > 0.5) == y).mean() > 0.94
    assert model.correlation[2, 3] > 0.9 and model.correlation[0, 1] < 0.25
    assert model.weight[2] < 0.5 and model.rate[1, 0, 2] > model.rate[1, 2, 2]


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "packing"]
    toxic = corpus_pipeline.drop_toxic(spark, docs, sf)
    model = toxicity.train_model(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert {r["doc_id"] for r in toxic.collect()} == {r["id"] for r in toxicity.scored(docs, model).filter("predicted = 0").collect()}
    line = corpus_pipeline.drop_lines(spark, docs, sf)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert toxic.columns == line.columns == near.columns == docs.columns
    assert line.count() == docs.count() and line.filter(F.length("text") != F.col("n_chars")).count() == docs.filter(F.length("text") != F.col("n_chars")).count()
    assert {r["doc_id"] for r in near.collect()} == {r["id"] for r in minhash.near_duplicates(docs).filter("kept").collect()}
    out = corpus_pipeline.run(spark, sf).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= packing.LENGTH).all() and len(out)


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
