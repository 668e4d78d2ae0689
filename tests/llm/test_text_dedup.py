"""Near-duplicate documents and lines against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberwatch.llm import graph, lines, minhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups(dict):
    def root(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta of the and in zeta eta theta iota kappa mu nu xi".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)]


def changed(rng, base, share):
    out = list(base)
    for i in rng.sample(range(len(out)), max(1, int(share * len(out)))):
        out[i] = f"new{rng.randrange(10**6)}"
    return out


def corpus():
    rng = random.Random(3)
    texts, hub = [], words(rng, 200)
    texts += [" ".join(changed(rng, hub, rng.choice([0.01, 0.02, 0.03, 0.05, 0.08]))) for _ in range(150)]  # one large group, not all linked
    texts.insert(77, " ".join(hub))
    texts += ["Copy Of  This\ttext and some more words of it"] * 40 + ["copy of this TEXT and some more words of it"]
    passage = " ".join(words(rng, 40))
    texts += [passage + " " + " ".join(words(rng, rng.randrange(5, 60))) for _ in range(60)]
    texts += ["two words", "Two Words", "one", "", None, "   \n\t ", "é à ü ö ñ", "É à ü ö ñ", "x\xa0y z a b c", "a b c d e", "a b c d e f"]
    texts += [" ".join(words(rng, 9000))] + [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(150)]
    return texts


def sets_of(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets, groups = [(i, sets_of(t)) for i, t in rows], Groups()
    for n, (i, a) in enumerate(sets):
        groups.root(i)
        for j, b in sets[:n]:
            both = len(a & b)
            if a and b and 100 * both >= 75 * (len(a) + len(b) - both):
                groups.join(i, j)
    return {i: (len(s), groups.root(i)) for i, s in sets}


@pytest.fixture(scope="module")
def near(spark):
    rows = [(1000 - 2 * i, t) for i, t in enumerate(corpus())]
    df = spark.createDataFrame([(i, t, 5, [1]) for i, t in rows], "doc_id bigint, text string, n bigint, keys array<int>").repartition(6)
    return rows, df


def test_near_duplicates_equal_brute_force(spark, near, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 32)
    rows, df = near
    got = {r["id"]: (r["n_shingles"], r["component"], r["kept"]) for r in minhash.near_duplicates(df).collect()}
    want = brute_near(rows)
    assert got == {i: (n, c, i == c) for i, (n, c) in want.items()}
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (n, c) in want.items() if i == c}


def test_second_meeting_finds_links_between_others(spark):
    """In a bucket whose smallest member is linked with none, the others still meet."""
    rng = random.Random(1)
    a = words(rng, 100)
    b = changed(rng, a, 0.02)
    raw = [(5, a), (6, b), (1, words(rng, 100))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in raw], "id bigint, text string")
    sketch = minhash.sketches(df).join(minhash.shingled(df), "id")
    members = sketch.select(F.lit(0).alias("band"), F.lit(7).cast("bigint").alias("key"), "id", F.col("id").alias("component"), "n", "keys", "sig", "shingles")
    assert {frozenset((r["a"], r["b"])) for r in minhash.open_links(members, 75).collect()} == {frozenset((5, 6))}


def test_near_duplicates_of_odd_tables(spark):
    schema = "doc_id bigint, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, "same text of five words"), (None, "same text of five words"), (3, "same text of five words"), (3, "same text of five words")], schema)
    got = sorted((r["id"] or 0, r["n_shingles"], r["kept"]) for r in minhash.near_duplicates(odd).collect())
    assert got == [(0, 1, True), (0, 1, True), (3, 1, True), (3, 1, True)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (250, 300), (7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 250: 200, 300: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def brute_lines(rows, least):
    """(id, line) of the occurrences that go."""
    seen = [(i, n, normal(x)) for i, t in rows if t is not None and i is not None for n, x in enumerate(t.split("\n"))]
    seen, groups = [s for s in seen if s[2]], Groups()
    texts = sorted({x for *_, x in seen})
    for n, x in enumerate(texts):
        groups.root(x)
        for y in texts[:n]:
            if min(len(x.split()), len(y.split())) >= lines.FUZZY_WORDS and edits(x.split(), y.split()) <= (1 - least) * max(len(x.split()), len(y.split())) + 1e-9:
                groups.join(x, y)
    first, gone = {}, set()
    for i, n, x in sorted(seen):
        if groups.root(x) in first:
            gone.add((i, n))
        first.setdefault(groups.root(x), (i, n))
    return gone


def line_rows():
    rng = random.Random(9)
    base = [" ".join(words(rng, n)) for n in (12, 30, 60, 90)]
    rows = []
    for i in range(24):
        own = [" ".join(words(rng, rng.randrange(1, 40)))]
        near = [" ".join(changed(rng, x.split(), 0.004)) for x in rng.sample(base, 2)]
        rows.append((i, "\n".join(own + near + ["All rights reserved.", "", "***", rng.choice(base).upper() + "!"])))
    return rows + [(70, None), (71, ""), (72, "\n\n"), (None, base[0]), (73, base[1]), (73, base[1]), (74, "ÀÉ ñandú Straße " * 4)]


@pytest.mark.parametrize("tile", [lines.TILE, 2])
def test_lines_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lines, "TILE", tile)
    rows = line_rows()
    df = spark.createDataFrame([(i, t, 4, "k") for i, t in rows], "doc_id bigint, text string, n bigint, line string").repartition(5)
    want = brute_lines(rows, lines.SIMILARITY)
    plain = df.select(F.col("doc_id").alias("id"), "text")
    assert {(r["id"], r["line"]) for r in lines.removed_lines(plain).collect()} == want
    done = lines.deduplicated(df)
    assert done.columns == [*df.columns, "n_lines", "n_removed"]
    got = sorted((r["doc_id"] is None, r["doc_id"], r["text"] is None, r["text"], r["n_lines"], r["n_removed"]) for r in done.collect())
    cut = lambda i, t: t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)
    assert got == sorted((i is None, i, t is None, cut(i, t), 0 if t is None else len(t.split("\n")), sum(j == i for j, _ in want)) for i, t in rows)
    assert any(n for *_, n in got)


def test_near_lines_are_found(spark):
    """Brute force over all pairs: one word changed, and as many edits as are allowed, spread evenly."""
    rng = random.Random(12)
    rows = []
    for n in (8, 9, 12, 14, 20, 27, 34, 50, 80, 120, 300):
        base = words(rng, n)
        one, many, k = list(base), list(base), int(0.15 * n)
        one[n // 2] = "changed"
        for j in range(k):
            many[(j + 1) * n // (k + 1)] = f"other{j}"
        rows += [(len(rows) + i, " ".join(x)) for i, x in enumerate((base, one, many, base[: n // 2] + ["put", "in"] + base[n // 2 :], words(rng, n // 2) + base[n // 2 :]))]
    want = brute_lines(rows, lines.SIMILARITY)
    df = spark.createDataFrame(rows, "id bigint, text string")
    assert {(r["id"], r["line"]) for r in lines.removed_lines(df).collect()} == want
    assert len(want) > 25
    assert {(r["id"], r["line"]) for r in lines.removed_lines(df, blocks=None).collect()} == want


def test_edits_at_the_least_blocks_lose_no_link(spark):
    """Lines whose least blocks are all spoilt by the allowed edits: they once met nowhere, as only 8 blocks were dealt."""
    rng = random.Random(3)
    bases = [[f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(12)]
    df = spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(bases)], "id bigint, text string")
    windows = F.transform(F.sequence(F.lit(0), F.size("p") - 3), lambda i: F.struct(F.xxhash64(lines.majority([F.get(F.col("p"), i + j) for j in range(3)])).alias("h"), i.alias("at")))
    pairs = lines.lines_of(df).select("id", F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.xxhash64(a, b)).alias("p"))
    order = {r["id"]: [x["at"] for x in r["w"]] for r in pairs.select("id", F.sort_array(windows).alias("w")).collect()}
    rows, spoilt = [], []
    for i, base in enumerate(bases):
        other, hit = list(base), set()
        for at in order[i][:8]:  # at most 8 of the 9 edits allowed
            if not hit & set(range(at, at + 4)):
                hit.add(at + 1)
                other[at + 1] = f"new{i}x{at}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        spoilt.append(len(hit))
    want = brute_lines(rows, lines.SIMILARITY)
    assert len(want) == 12 and max(spoilt) <= 9
    assert {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()} == want


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    """The second row's first line stands nowhere else, though the first row's first line is a copy."""
    rows = [(1, "a line that is here twice"), (2, "a line that is here twice\nonly in one"), (2, "stands nowhere else\nand this neither"), (2, "stands nowhere else\nand this neither")]
    got = sorted(r["text"] for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == sorted([rows[0][1], "only in one", rows[2][1], rows[2][1]])


@pytest.mark.parametrize("least, words", [(0.85, 4), (0.7, 2), (1.0, 8)])
def test_words_of_a_shared_run(least, words):
    assert lines.run_words(least) == words


@pytest.mark.parametrize("tile", [lines.TILE, 1])
def test_lines_of_a_bucket_meet_when_the_first_is_like_none(spark, monkeypatch, tile):
    """One block for all: members of different groups meet in the second step."""
    monkeypatch.setattr(lines, "TILE", tile)
    monkeypatch.setattr(lines, "simhash_blocks", lambda pairs, length: F.array(F.lit(5).cast("bigint")))
    rng = random.Random(4)
    base = [words(rng, 40) for _ in range(4)]
    rows = [(i, " ".join(changed(rng, x, 0.03) if i % 3 else x)) for i, x in enumerate(x for x in base for _ in range(3))]
    got = {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == brute_lines(rows, lines.SIMILARITY) and len(got) == 8


def test_the_sieve_loses_no_line_alike(spark):
    rng = random.Random(8)
    rows = []
    for n in [8, 13, 14, 40, 90, 200] * 6:
        x, y = words(rng, n), None
        y = list(x)
        for _ in range(int(0.15 * n)):
            at = rng.randrange(len(y))
            y[at:at + 1] = rng.choice([["put"], [], [y[at], "in"]])
        if edits(x, y) <= 0.15 * max(len(x), len(y)) + 1e-9:
            rows.append((len(rows), " ".join(x) + "\n" + " ".join(y)))
    got = lines.described(spark.createDataFrame(rows, "id bigint, text string"), 4, None).select("id", "line", F.struct("n", "fold").alias("mark"))
    one, two = got.filter("line = 0").withColumnRenamed("mark", "ma"), got.filter("line = 1").select("id", F.col("mark").alias("mb"))
    assert one.join(two, "id").filter(lines.near("ma", "mb", 0.85)).count() == len(rows) > 20


def test_blocks_are_majorities_and_edits_spoil_their_own_windows_only(spark):
    rng = random.Random(6)
    x = [f"w{rng.randrange(10**9)}" for _ in range(30)]
    y = x[:15] + ["other"] + x[16:]
    got = lines.described(spark.createDataFrame([(0, " ".join(x)), (1, " ".join(y))], "id bigint, text string"), 4, None).orderBy("id").collect()
    assert [len(r["blocks"]) for r in got] == [27, 27] and len(set(got[0]["blocks"]) & set(got[1]["blocks"])) == 23
    three = spark.range(1).select(*[lines.majority([F.lit(v).cast("bigint") for v in vs]).alias(f"m{n}") for n, vs in enumerate([(12, 10, 6), (9,), (1, 3, 7, 15, 31)])]).first()
    assert list(three) == [14, 9, 7]


def test_no_lines(spark):
    assert lines.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_a_line_is_dealt_to_fewer_keys_than_runs(spark):
    """Once 69 keys for a line of 100 words, which took more disk than there was; neighbouring runs now share theirs."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(40)]
    got = [len(r["blocks"]) for r in lines.described(spark.createDataFrame(rows, "id bigint, text string"), 4, lines.SIMILARITY).collect()]
    assert len(got) == 40 and max(got) <= 62 and sum(got) / 40 < 55


def test_the_order_of_keys_changes_no_result(spark, monkeypatch):
    """Blocks counted on all lines, so that many are met often."""
    monkeypatch.setattr(lines, "COUNTED", 1)
    rng = random.Random(14)
    phrase = words(rng, 9)
    rows = [(i, "\n".join(" ".join(changed(rng, x, 0.03)) for x in (phrase + words(rng, 11), phrase + words(rng, 30), phrase * 3))) for i in range(12)]
    rows += [(20 + i, t + " and") for i, t in rows[:6]]
    got = {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == brute_lines(rows, lines.SIMILARITY) and len(got) > 15


def test_blocks_that_lie_apart_make_fewer_enough(spark):
    """Once about 53 keys for a line of 100 words; 18 blocks that lie apart are enough for its 17 edits."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(40)]
    got = [len(r["blocks"]) for r in lines.described(spark.createDataFrame(rows, "id bigint, text string"), 4, lines.SIMILARITY).collect()]
    assert min(got) >= 18 and max(got) <= 52 and sum(got) / 40 < 40


def test_a_group_of_near_copies_is_compared_with_few(spark, monkeypatch):
    """Once each line met another one in each of its buckets, and of groups still apart all pairs were written."""
    met, verify = [], lines.verified

    def counting(pairs, classes, least):
        met.append(pairs.count())
        return verify(pairs, classes, least)

    monkeypatch.setattr(lines, "verified", counting)
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = [(i, " ".join(changed(rng, base, 0.04))) for i in range(120)]
    got = {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == {(i, 0) for i in range(1, 120)}
    assert sum(met) < 6 * 120


@pytest.mark.parametrize(("few", "slots"), [(0, 64), (64, 64), (64, 1), (2, 2)])
def test_lines_that_share_many_buckets_meet_in_one(spark, monkeypatch, few, slots):
    """Once a pair was compared in each bucket that both lines are in."""
    met, tiled = [], lines.tiled_pairs

    def counting(*args):
        pairs = tiled(*args)
        met.append([(r["a"], r["b"]) for r in pairs.select("a", "b").collect()])
        return pairs

    monkeypatch.setattr(lines, "tiled_pairs", counting)
    monkeypatch.setattr(lines, "FEW", few)
    monkeypatch.setattr(lines, "SLOTS", slots)
    rng = random.Random(31)
    rows = []
    for _ in range(4):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        rows += [" ".join(changed(rng, base, 0.1)) for _ in range(14)]
    rows = list(enumerate(rows))
    got = {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert got == brute_lines(rows, lines.SIMILARITY) and got
    assert met[0] and all(len(some) == len(set(some)) for some in met)


def test_words_left_out_on_either_side_are_told_by_the_sieves(spark):
    """Seven words left out of each of two copies: 14 edits where 7 are allowed, which the fold of the words alone lets pass."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    without = lambda at: " ".join(w for i, w in enumerate(base) if i not in at)
    rows = [(0, " ".join(base)), (1, without(range(3, 59, 8))), (2, without(range(7, 60, 8)))]
    got = lines.coded_lines(spark.createDataFrame(rows, "id bigint, text string")).withColumn("pairs", lines.pairs_of(F.col("code")))
    got = lines.folded(got).select("id", F.struct("n", "fold", lines.folds(F.col("pairs")).alias("pair_fold")).alias("mark"))
    one, two = got.select(F.col("id").alias("a"), F.col("mark").alias("ma")), got.select(F.col("id").alias("b"), F.col("mark").alias("mb"))
    passed = one.join(two, F.col("a") < F.col("b")).select("a", "b", lines.near("ma", "mb", 0.85).alias("words"), lines.near_by_pairs("ma", "mb", 0.85).alias("pairs"))
    assert {(r["a"], r["b"]): (r["words"], r["pairs"]) for r in passed.collect()} == {(0, 1): (True, True), (0, 2): (True, True), (1, 2): (True, False)}


def test_lines_after_a_capital_sigma_and_odd_blanks(spark):
    """Lines are normalised with the text they stand in: what follows a line changes none."""
    rows = [(1, "ΛΟΓΟΣ\nΛΟΓΟΣ α"), (2, "x\r\n\t*** ΛΟΓΟΣ\nλογος Α !\n"), (3, "\n x "), (4, "a b\nA b")]
    got = {(r["id"], r["line"]) for r in lines.removed_lines(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    plain = [(i, n, tuple(w for w in re.split(r"[^\w]+|_+", x.lower()) if w)) for i, t in rows for n, x in enumerate(t.split("\n"))]
    first, want = {}, set()
    for i, n, x in plain:
        if x and first.setdefault(x, (i, n)) != (i, n):
            want.add((i, n))
    assert got == want


def test_the_driver_gets_the_bits_of_blocks_met_often_only(spark, monkeypatch):
    """Collected as blocks, each task would send it its own first ones; the bits are those of the blocks met most often all the same."""
    monkeypatch.setattr(lines, "COUNTED", 1)
    monkeypatch.setattr(lines, "OFTEN", 25)
    monkeypatch.setattr(lines, "OFTEN_BITS", 128)
    rng = random.Random(7)
    phrases = [" ".join(words(rng, 6)) for _ in range(12)]
    texts = [" ".join(f"{rng.choice(phrases)} own{i}x{j}" for j in range(3)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    classes = lines.coded_lines(docs).select("n", "code")
    length, seen = lines.run_words(lines.SIMILARITY), []
    collect = type(classes).collect
    monkeypatch.setattr(type(classes), "collect", lambda df: seen.append((df, collect(df))) or seen[-1][1])
    got = lines.often_met(classes, length)
    monkeypatch.undo()
    (df, rows), = seen
    assert len(rows) <= 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and not re.match(r"(AdaptiveSparkPlan.*\n.*\n)?\W*TakeOrderedAndProject", plan)
    blocks = lines.with_pairs(classes).select(F.explode(F.array_distinct(lines.simhash_blocks(F.col("pairs"), lines.short(length)))).alias("h"))
    counts = {row["h"]: row["count"] for row in blocks.groupBy("h").count().collect()}
    most = sorted((h for h in counts if counts[h] > 1), key=lambda h: (-counts[h], h))
    assert len(most) > 25
    bits = [0, 0]
    for h in most[:25]:
        bits[(h >> 6) % 2] |= 1 << h % 64
    assert [x % (1 << 64) for x in spark.range(1).select(got.alias("bits")).first()["bits"]] == bits


def test_new_links_join_groups(spark):
    rng = random.Random(9)
    steps = [[(rng.randrange(400), rng.randrange(400)) for _ in range(90)] for _ in range(3)]
    steps.insert(2, [])
    table = lambda links: spark.createDataFrame(links, "a long, b long")
    brute, groups = Groups(), table([]).selectExpr("a as id", "b as component")
    for links in steps:
        for a, b in links:
            brute.join(a, b)
        rows = lines.joined(groups, table(links)).collect()
        groups = spark.createDataFrame(rows, "id long, component long")
        linked = {x for a, b in brute.items() if a != brute.root(a) for x in (a, brute.root(a))}
        assert sorted(map(tuple, rows)) == sorted((x, brute.root(x)) for x in linked)
