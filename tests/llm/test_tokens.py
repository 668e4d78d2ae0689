"""BPE and packing: against the tokenizers library and by round trip."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberwatch.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n\n", "It's we'll 'S'", "<|endoftext|>", "a<|startoftext|>b <|endoftext|", "İstanbul ΣΑΣ ſ Å", "é" * 300, "x" * 20_000, "日本語 ½ ² ٣", "👍🏽 ́a", "tab\tnbsp\xa0nel\x85fs\x1cend", "\x00\ufeff"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def own_ids(text):
    pieces = bpe.pieces_for(PATH)
    return np.frombuffer(b"".join(pieces[p][0] for p in bpe.cut(text)), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcXYZ'stre <|>\n\t123.,!"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_ids_equal_the_library(text):
    want = _LIBRARY.encode(text, add_special_tokens=False).ids
    assert own_ids(text) == want
    assert np.frombuffer(packing.ids_for(PATH).of(text), "<u4").tolist() == want


_LIBRARY = Tokenizer.from_file(PATH)


def test_every_character_is_of_the_library_s_class():
    """Between signs, a character joins them only if it is neither letter nor digit."""
    bad = []
    for a in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000]
        text = " ".join(f"!{c}!" for c in chars)
        if own_ids(text) != _LIBRARY.encode(text, add_special_tokens=False).ids:
            bad += [c for c in chars if own_ids(f"!{c}!") != _LIBRARY.encode(f"!{c}!", add_special_tokens=False).ids]
    assert not bad


def test_merges_take_the_leftmost_lowest_rank():
    v = bpe.pieces_for(PATH).v

    def plain(word):
        ids = v.symbols(word)
        while True:
            ranked = [(v.merge[ids[i] << 32 | ids[i + 1]][0], i) for i in range(len(ids) - 1) if ids[i] << 32 | ids[i + 1] in v.merge]
            if not ranked:
                return ids
            i = min(ranked)[1]
            ids[i:i + 2] = [v.merge[ids[i] << 32 | ids[i + 1]][1]]

    rng = np.random.default_rng(5)
    for _ in range(300):
        word = "".join(rng.choice(list("aeinorst"), rng.integers(1, 80)))
        assert v.encode_word(word) == plain(word)


def test_digests(spark, tokenizer):
    rows = [(i, t, "c") for i, t in enumerate([*ODD, None])] + [(0, "again", "c"), (None, "no id", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r["id"] is None, r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digests(df, PATH).collect())
    want = []
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(df.limit(0), PATH).count() == 0


def test_encoded_and_decoded(spark, tokenizer):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, None)], "doc_id bigint, text string")
    ids = {r["id"]: r["ids"] for r in bpe.encoded(df, PATH).collect()}
    assert ids[2] == [] and ids[1] == tokenizer.encode("the quick brown fox", add_special_tokens=False).ids
    assert bpe.decoded(bpe.pieces_for(PATH).v, ids[1]) == tokenizer.decode(ids[1])


def test_packing_is_whole(spark, tokenizer):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["alpha", "beta", "of", "the", "zeta"], rng.integers(0, 400))) for _ in range(300)] + ["word " * 9000, None, "", *ODD]
    rows = [(i, t, 9) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, length int").repartition(3)
    got = packing.packed(df, PATH, open_bins=16).toPandas()
    total = 0
    for i, t, _ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        mine = got[got["id"] == i].sort_values("piece")
        assert mine["start"].tolist() == list(range(0, len(ids), 4096)) and mine["length"].sum() == len(ids) and (mine["length"].iloc[:-1] == 4096).all()
        assert mine["ids_crc32"].tolist() == [zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes()) for a in range(0, len(ids), 4096)]
        total += len(ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.1 * total / 4096 + 1
    assert packing.packed(df.limit(0), PATH).count() == 0


def test_best_fit_takes_the_tightest_and_closes_the_fullest():
    p = packing.Packer(10, 2)
    assert p.place(6) == (0, 0) and p.place(7) == (1, 0)
    assert p.place(3) == (1, 7)  # the tightest that takes it; sequence 1 is full
    assert p.place(5) == (2, 0) and p.place(6) == (3, 0)  # sequence 0, the fullest, closes
    assert p.place(4) == (3, 6) and p.place(4) == (2, 5)


def test_pieces_are_not_worked_out_anew_when_the_memory_is_full(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    ids = packing.Ids(PATH)
    text = "Words, that come again: É, ÉTÉ. (İx) it's"
    want = _LIBRARY.encode(text, add_special_tokens=False).ids
    asked, plain = [], ids.plain
    monkeypatch.setattr(ids, "plain", lambda t: asked.append(t) or plain(t))
    for _ in range(3):
        assert np.frombuffer(ids.of(text), "<u4").tolist() == want
        asked, before = [], asked
    assert before == []


def test_pieces_of_one_text_fill_no_memory(spark, monkeypatch):
    """Once each new piece was remembered among those that come again."""
    monkeypatch.setattr(packing, "NEW", 50)
    ids = packing.Ids(PATH)
    for i in range(40):
        ids.of("the same words " + " ".join(f"w{i}x{j}" for j in range(20)))
    assert set(ids) == {"the", "same", "words"} and len(ids.new) + len(ids.new_before) <= 2 * (50 + 20)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, seen = spark.conf.get(name), []
    monkeypatch.setattr(packing, "written", lambda df, _: seen.append(spark.conf.get(name)) or df)
    packing.packed(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), PATH)
    assert int(seen[0]) <= packing.TEXTS_A_BATCH and spark.conf.get(name) == was


def test_letters_with_one_mark_equal_the_library():
    ids = packing.Ids(PATH)
    for c in map(chr, range(0x21, 0x370)):
        for piece in (c, f"A{c}", f"{c}x", f"b{c}.", f"B{c},"):
            assert ids.of(piece) == ids.plain(piece).tobytes()
