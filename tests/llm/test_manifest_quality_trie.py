import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from emberwatch.llm import merkle, mil, trie
from emberwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
H = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# --- manifest


def plain_leaf(row):
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H([part(row[f]) for f in FIELDS])


def climb(row):
    """All levels of a tree over a list of digests."""
    levels = [row]
    while len(levels[-1]) > 1:
        levels.append([H(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain_manifest(rows, lower=True):
    """Brute force: whole trees in lists, each proof walked on its own."""
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[g] = climb([plain_leaf(r) for r in groups[g]])
    top = climb([trees[g][-1][0] for g in names])
    ascii_lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t, g in enumerate(names):
        for i, r in enumerate(groups[g]):
            leaf = plain_leaf(r)
            changed = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                changed["text"] = r["text"].translate(ascii_lower)
            siblings, folded = [], plain_leaf(changed)
            for levels, at in ((trees[g], i), (top, t)):
                for row in levels[:-1]:
                    run = row[at // 8 * 8 : at // 8 * 8 + 8]
                    k = at % 8
                    siblings += run[:k] + run[k + 1 :]
                    folded = H(run[:k] + [folded] + run[k + 1 :])
                    at //= 8
            root = top[-1][0]
            out.append((r["doc_id"], leaf, trees[g][-1][0], root, H(siblings), folded, folded == root))
    return sorted(out, key=repr)


def manifest(df):
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = [lower if f == "text" else F.col(f) for f in FIELDS]
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    out = merkle.manifest(df, "doc_id", "lang", FIELDS, changed, third)
    return sorted(map(tuple, out.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def some_documents(n):
    rng = random.Random(5)
    langs = ["en"] * 6 + ["de", "ü", None, ""]
    rows = [(i * 3 - 7, rng.choice(["Ab c", "", None, "ÄÖ x", "lower", "Z" * 5000]), rng.choice(langs), rng.choice(["s", None]), rng.choice([1, None])) for i in range(n)]
    return rows + [(5, "Same", "en", "s", 1)] * 3 + [(5, "Other", "en", "s", 1), (None, "No id", "en", None, None), (None, None, None, None, None), (9, "only one", "xx", "s", 1)]


@pytest.mark.parametrize("block", [8, 64])
def test_manifest_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)  # several rounds, and partitions that must fetch
    monkeypatch.setattr(merkle, "LEVELS", {8: 1, 64: 2}[block])
    monkeypatch.setattr(merkle, "SPREAD", 1)
    rows = some_documents(700)
    df = spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("x"), "h": F.lit(1), "tree": F.lit(2), "at": F.lit(3)})
    got = manifest(df)
    assert got == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1])
def test_manifest_of_few_rows(spark, n):
    rows = [(1, "Text", "en", "s", 4)][:n]
    got = manifest(spark.createDataFrame(rows, DOCS))
    assert got == plain_manifest([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in rows])


def test_manifest_query_equals_brute_force(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op11_merkle_manifest"](spark, SF)
    assert sorted(map(tuple, got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr) == plain_manifest(rows)


def test_multiproof_fetches_no_more_than_needed():
    rng = random.Random(2)
    for n in (1, 2, 8, 9, 64, 65, 700):
        levels = climb([H([str(i)]) for i in range(n)])
        some = rng.sample(range(n), min(n, 5))
        need = merkle.missing(some, n)
        assert len(need) == len(set(need)) and all(i not in some for level, i in need if level == 0)
        part = merkle.Partition({i: levels[0][i] for i in some}, {(level, i): levels[level][i] for level, i in need}, n)
        assert part.top == levels[-1][0]
        for i in some:
            assert merkle.fold(levels[0][i], part.proof(i)) == part.top
        # without any one of the fetched nodes the top cannot be derived
        for gone in need:
            with pytest.raises(KeyError):
                merkle.Partition({i: levels[0][i] for i in some}, {x: levels[x[0]][x[1]] for x in need if x != gone}, n)


# --- trie


def plain_trie(rows):
    """Brute force: every prefix of every rebuilt conversation as a tuple."""
    convs = {}
    ident = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append(((turn is not None, turn or 0, ident(role, text)), (role, text)))
    own = {c: [x for _, x in sorted(t)] for c, t in convs.items()}
    share = lambda c: zlib.crc32(str(c).encode()) % 6
    hundred = lambda c: c - (abs(c) % 100) * (1 if c >= 0 else -1)
    built = {c: tuple(own.get(hundred(c), [])[: share(c)] + t[share(c) :]) for c, t in own.items()}
    members, kids = {}, {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
            if d:
                kids.setdefault(t[: d - 1], set()).add(t[:d])

    def below(node):
        leaves = saved = 0
        todo = [node]
        while todo:
            x = todo.pop()
            leaves += x not in kids
            saved += (len(members[x]) - 1) * (len(x[-1][1]) if x else 0)
            todo += kids.get(x, ())
        return leaves, saved

    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, ())), *below(node), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def tries(df):
    out = trie.prefix_trie(df)
    return sorted(map(tuple, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


CONV = "conv_id long, turn long, role string, text string"


def some_conversations():
    rng = random.Random(9)
    rows = []
    for c in [*range(-3, 240), 1001, 100_000]:
        shape = rng.random()
        n = 0 if c == 100 else rng.randrange(1, 9)
        for t in range(n):
            text = "hi" if shape < 0.3 else rng.choice(["a", "b", "", None, "ünï", "long " * 300])
            rows.append((c, t, rng.choice(["user", "user", "user", None]) if shape > 0.5 else "user", text))
    rows += [(7000, t, "user", f"t{t % 3}") for t in range(150)] + [(7001, t, "user", f"t{t % 3}") for t in range(149)] + [(7050, t, "user", f"t{t % 3}") for t in range(150)]
    rows += [(300, None, "user", "null turn"), (300, 0, "user", "b"), (300, 0, "user", "a"), (300, 0, "user", "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, small):
    if small:  # many segments, trees and pieces
        for name, value in {"SEGMENT": 4, "TREE_KEYS": 20, "PIECE": 8, "PIECES": 3, "RUN": 4}.items():
            monkeypatch.setattr(trie, name, value)
    rows = some_conversations()
    df = spark.createDataFrame(rows, CONV).withColumns({"conv": F.lit(1), "d": F.lit(2), "id": F.lit("x"), "fa": F.lit(3)})
    assert tries(df) == plain_trie(rows)


def test_trie_of_nothing_and_of_no_turns_left(spark):
    assert tries(spark.createDataFrame([], CONV)) == []
    rows = [(c, 0, "user", "x") for c in range(1, 60)]  # the first of the hundred is absent
    assert tries(spark.createDataFrame(rows, CONV)) == plain_trie(rows)


def test_trie_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op13_prefix_trie"](spark, SF)
    assert sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr) == plain_trie(rows)


def test_radix_layouts_and_aligned_depths():
    rng = random.Random(4)
    keys = [bytes([rng.randrange(256), rng.randrange(3)]) + bytes(rng.choice([b"", b"ab", b"abcd", bytes([0, rng.randrange(60)])])) for _ in range(3000)]
    tree = trie.RadixTree()
    for i, k in enumerate(keys):
        tree.add(k, 1, i, k)
    kinds, todo = set(), [tree.root]
    while todo:
        node = todo.pop()
        kinds.add(node.kind)
        todo += node.children()
    assert {4, 256} <= kinds and kinds & {16, 48}
    got = sorted((value[: 2 * k], n, least) for k, n, least, value in tree.nodes(0, 2))
    want = {}
    for i, key in enumerate(keys):
        for k in range(1, len(key) // 2 + 1):
            n, least = want.get(key[: 2 * k], (0, i))
            want[key[: 2 * k]] = (n + 1, least)
    assert got == sorted((p, n, least) for p, (n, least) in want.items())


# --- quality


def good_text(rng, words):
    return " ".join(rng.choice(["the", "house", "stands", "near", "a", "river", "and", "people", "walk", "there."]) + rng.choice(["", "", "s", "ing"]) for _ in range(words))


def bad_text(rng, words):
    return " ".join(rng.choice(["CLICK!!", "BUY###", "win$$$", "FREE!!", "x|y"]) for _ in range(words))


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(400):
        kind = rng.choice(["good", "bad", "mixed"])
        text = good_text(rng, rng.randrange(5, 200)) if kind == "good" else bad_text(rng, rng.randrange(5, 120))
        if kind == "mixed":  # one bad part in a long good text
            text = good_text(rng, 100) + " " + bad_text(rng, 60) + " " + good_text(rng, 100)
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, int(kind == "good"), 0))
    labels += [(3, None, None), (None, 1, 0)]
    docs += [(400 + i, docs[5][1], "en", "s", 1) for i in range(300)]  # a large group of copies, labelled alike
    labels += [(400 + i, labels[5][1], 0) for i in range(300)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((i, q) for i, q, _ in labels)


def test_quality_of_held_out_rows(judged):
    docs, labels, truth = judged
    out = mil.scored(docs, mil.train_model(docs, labels)).collect()
    assert len(out) == docs.count()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == truth[r.id] for r in held) >= 0.97 * len(held)


def test_quality_of_odd_rows(spark, judged):
    docs, labels, _ = judged
    model = mil.train_model(docs, labels)
    rng = random.Random(8)
    odd = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "z" * 3_000_000), (6, good_text(rng, 400_000)), (6, good_text(rng, 50)), (None, "no id here"), (7, "ünï cødé 漢字")]
    df = spark.createDataFrame(odd, "doc_id long, text string").withColumns({"id": F.lit(1), "score": F.lit(2), "good": F.lit(1), "hash": F.lit(0)})
    out = mil.scored(df, model).collect()
    assert len(out) == len(odd) and all(0 <= r.score <= 1 for r in out) and not [r for r in out if r.id is None and r.held_out]
    assert len({r.score for r in out if r.id in (1, 2, 3)}) == 1
    assert mil.scored(df.limit(0), model).collect() == []
    clash = docs.withColumns({"id": F.lit(1), "good": F.lit(1), "hash": F.lit(0), "quality": F.lit(1), "bag": F.lit("x")})
    again = mil.train_model(clash, labels)
    assert np.allclose(again.attention.w["out"], model.attention.w["out"])


def test_quality_without_labels(spark, judged):
    docs, labels, _ = judged
    for some, share in ((labels.limit(0), 0.0), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        assert {r.score for r in mil.scored(docs, mil.train_model(docs, some)).collect()} == {share}
    assert mil.train_model(docs.limit(0), labels).attention is None


def test_long_text_is_read_whole(monkeypatch):
    rng = random.Random(3)
    text = good_text(rng, 30_000) + " " + bad_text(rng, 30_000)
    model = mil.Model(mil.Attention(), 0.5)
    whole = model.scores(pa.array([text]))
    start = model.scores(pa.array([text[: len(text) // 3]]))
    monkeypatch.setattr(mil, "CHUNK", 20_000)
    assert np.allclose(model.scores(pa.array([text])), whole, atol=1e-3) and not np.allclose(start, whole, atol=1e-4)
    both = model.scores(pa.array([text, None, "short one", text]))
    assert both[0] == both[3] and np.allclose(both[2], model.scores(pa.array(["short one"])))


def test_encoding_of_texts_together_and_alone():
    rng = random.Random(6)
    texts = [good_text(rng, 130), "", "  x ", bad_text(rng, 49), "Ü" * 40]
    raw = [t.encode() for t in texts]
    x, owner = mil.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert owner.tolist() == [0, 0, 0, 1, 2, 3, 3, 4]
    for i, r in enumerate(raw):
        alone, _ = mil.encode(np.frombuffer(r, np.uint8), np.array([0, len(r)]))
        assert np.allclose(alone, x[owner == i])


def test_gradient():
    rng = np.random.default_rng(0)
    model = mil.Attention(6)
    x, owner, y = rng.normal(size=(9, 6)), np.array([0, 0, 0, 1, 2, 2, 2, 2, 3]), np.array([1.0, 0, 1, 0])

    def loss():
        h, _, _, e = model.passages(x)
        total = np.bincount(owner, weights=e)
        p = model.score(np.stack([np.bincount(owner, weights=e * c) for c in h.T], axis=1), total)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model._gradient(x, owner, y).items():
        flat = model.w[name].reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            old, step = flat[i], 1e-6
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * step) - g.reshape(-1)[i]) < 1e-6
