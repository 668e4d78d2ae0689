"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word is a row of symbols. The leaves of the tree hold rank and place of each pair of neighbours, so
the root is the leftmost pair of the lowest rank. A merge changes three leaves at most, each in
logarithmic time, and the word is done when the root holds no pair: n log n for a word of any length.

Texts are cut at blanks and line breaks, which no token spans; what a piece becomes is kept in a
bounded memory of each worker, as pieces repeat. Works on the vocabulary file of a tokenizer with byte
symbols, word ends and lower case.

Defined results: a null or empty text has no tokens; special tokens in a text are found as themselves;
texts may be of any length; rows with equal or null ids are encoded one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import columns

#: pieces of text remembered by a worker, which then starts anew
REMEMBERED = 400_000
NO_PAIR = 1 << 62
#: longer pieces and words are worked out each time
SHORT = 64


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: fixed values: characters (first to last) that the regex module takes for letters or digits and the tokenizers library, of an earlier Unicode version, does not
LATER = (
    "0558-0558 058B-058C 088F-088F 0C5C-0C5C 0CDC-0CDC 208F-208F 209D-209F A7CE-A7CF A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A "
    "11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E "
    "2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)


class WordPattern:
    """The tokenizer's own pattern of words; later letters count as what they were before, neither letter nor digit."""

    def __init__(self, split: str):
        new = "".join("-".join(f"\\U{int(end, 16):08x}" for end in span.split("-")) for span in LATER.split())
        self.plain, self.first = regex.compile(split, regex.V0), chr(int(LATER[:4], 16))
        split = split.replace(r"[\p{L}]+", rf"[\p{{L}}--[{new}]]+").replace(r"[\p{N}]", rf"[\p{{N}}--[{new}]]").replace(r"[^\s\p{L}\p{N}]+", rf"[[^\s\p{{L}}\p{{N}}][{new}]]+")
        self.late = regex.compile(split, regex.V1)

    def findall(self, text: str) -> list[str]:
        return (self.plain if text.isascii() or max(text) < self.first else self.late).findall(text)


class Vocabulary:
    """What a tokenizer file says: symbols, merges by rank, special tokens, the pattern of words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        model = said["model"]
        self.id_of: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.token_of = {i: t for t, i in self.id_of.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: left id << 32 | right id -> (rank << 32, merged id)
        self.merge = {}
        for rank, (a, b) in enumerate(pairs):
            self.merge.setdefault(self.id_of[a] << 32 | self.id_of[b], (rank << 32, self.id_of[a + b]))
        split = next(p["pattern"]["Regex"] for p in said["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = WordPattern(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = [self.id_of.get(s) for s in byte_symbols()]
        self.last_id = [self.id_of.get(s + self.end) for s in byte_symbols()]

    def symbols(self, word: str) -> list[int]:
        raw = word.encode("utf-8")
        ids = [self.byte_id[b] for b in raw[:-1]] + [self.last_id[raw[-1]]]
        return [i for i in ids if i is not None]

    def encode_word(self, word: str) -> list[int]:
        """Merges in order of rank, the leftmost first.

        Leaf i of the tree is the pair that starts at symbol i: its rank in the upper bits, i in the
        lower ones. The tree lies in one list, the children of node i at 2i and 2i + 1.
        """
        ids = self.symbols(word)
        n = len(ids)
        if n < 2:
            return ids
        find = self.merge.get
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NO_PAIR] * (2 * size)
        for i in range(n - 1):
            if pair := find(ids[i] << 32 | ids[i + 1]):
                tree[size + i] = pair[0] | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) != NO_PAIR:
            i = top & 0xFFFFFFFF
            j = after[i]
            k = after[i] = after[j]
            ids[i] = merged = find(ids[i] << 32 | ids[j])[1]
            ids[j] = -1
            changed = [(i, NO_PAIR)]
            if k < n:
                before[k] = i
                if pair := find(merged << 32 | ids[k]):
                    changed[0] = (i, pair[0] | i)
                changed.append((j, NO_PAIR))
            h = before[i]
            if h >= 0:
                pair = find(ids[h] << 32 | merged)
                changed.append((h, pair[0] | h if pair else NO_PAIR))
            for at, value in changed:
                at += size
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    at >>= 1
                    if other < value:
                        value = other
                    if tree[at] == value:
                        break
                    tree[at] = value
        return [i for i in ids if i >= 0]


#: fixed values: capitals whose small letter the tokenizers library knows and Python does not, and sigma, which has one small letter there
SMALL = {
    0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B, ord("Σ"): ord("σ"),
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


def normalised(text: str) -> str:
    """Composed characters, each in lower case by itself."""
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).translate(SMALL).lower()


class Pieces(dict):
    """Piece of text -> (ids as little-endian 32-bit numbers, their tokens joined by blanks), worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.known = vocabulary, {}

    def ids(self, piece: str) -> list[int]:
        parts = self.v.specials.split(piece) if self.v.specials and "<|" in piece else [piece]
        out: list[int] = []
        for part in parts:
            if part in self.v.special:
                out.append(self.v.special[part])
            elif part:
                for word in self.v.words.findall(normalised(part)):
                    ids = self.known.get(word)
                    if ids is None:
                        ids = tuple(self.v.encode_word(word))
                        if len(word) < SHORT:
                            self.known[word] = ids
                    out += ids
        return out

    def __missing__(self, piece: str):
        ids = self.ids(piece)
        made = struct.pack(f"<{len(ids)}I", *ids), " ".join(map(self.v.token_of.__getitem__, ids)).encode("utf-8")
        if len(piece) < SHORT:
            self[piece] = made
        return made

    def forget(self) -> None:
        """Keeps the memory of a worker within bounds; results do not depend on it."""
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.known) > REMEMBERED:
            self.known.clear()


def cut(text: str | None) -> list[str]:
    """Pieces between blanks and line breaks."""
    return (text or "").replace("\n", " ").split(" ")


@lru_cache(maxsize=2)
def pieces_for(path: str) -> Pieces:
    """One per worker and file."""
    return Pieces(Vocabulary(path))


def decoded(vocabulary: Vocabulary, ids: list[int]) -> str:
    """Tokens joined by blanks, as a tokenizer without a decoder has it; unknown ids are passed over."""
    return " ".join(vocabulary.token_of[i] for i in ids if i in vocabulary.token_of)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                made = [pieces[p] for p in cut(text.as_py())]
                ids = b"".join([m[0] for m in made])
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(b" ".join([m[1] for m in made if m[0]])).hexdigest())
                pieces.forget()
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], schema=schema)

    rows = columns(docs, id=id_col, text=text_col)
    return rows.withColumn("id", rows["id"].cast("bigint")).mapInArrow(run, "id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_for(path)
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(b"".join([pieces[p][0] for p in cut(text.as_py())]), "<u4").astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([ids], pa.list_(pa.int32()))], names=["id", "ids"])
                pieces.forget()

    rows = columns(docs, id=id_col, text=text_col)
    return rows.withColumn("id", rows["id"].cast("bigint")).mapInArrow(run, "id bigint, ids array<int>")
