"""Byte-level BPE, encoding and decoding.

A segment tree over the byte positions of a piece stores the lowest pair rank and its leftmost place; a merge takes the
root's pair and updates the leaves of the live neighbours, in logarithmic time each. Pieces are merged in lockstep, a
tree per row of an array; a long piece gets a tree of its own. Each Python worker remembers the ids of the words that
it has met, up to a fixed number.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from collections.abc import Iterable
from functools import cached_property, lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_texts, ship_code

#: Words remembered by a worker; later ones are merged anew in each step.
MEMORY = 500_000
#: Pieces up to this many bytes are merged in lockstep.
LOCKSTEP = 64
NEVER = np.int64(1 << 60)


def gpt_bytes() -> dict[str, int]:
    """Printable stand-ins for bytes in byte-level vocabulary files: visible Latin-1 as it is, the rest from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def as_bytes(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Merges:
    """A vocabulary and the ranks of its pairs; ``special`` strings have ids of their own."""

    def __init__(self, vocab: dict[bytes, int], pairs: Iterable[tuple[int, int, int, int]], special: dict[str, int]):
        self.ids = vocab
        self.vocab = {i: b for b, i in vocab.items()}
        self.special = special
        rows = sorted((a << 20 | b, rank, to) for a, b, rank, to in pairs)
        self.keys = np.array([r[0] for r in rows] + [1 << 60], np.int64)
        self.ranks = np.array([r[1] for r in rows] + [0], np.int64)
        self.to = np.zeros(max([0, *(r[1] for r in rows)]) + 1, np.int64)
        self.to[self.ranks[:-1]] = [r[2] for r in rows]
        self.single = np.array([vocab[bytes([b])] for b in range(256)], np.int64)
        left, right = np.repeat(self.single, 256), np.tile(self.single, 256)
        self.bytes_rank = self.rank_of(left, right)

    @cached_property
    def pairs(self) -> dict[int, tuple[int, int]]:
        ranks = self.ranks[:-1].tolist()
        return {k: (r, t) for k, r, t in zip(self.keys[:-1].tolist(), ranks, self.to[self.ranks[:-1]].tolist(), strict=True)}

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a .tiktoken file of ranks, or the .json of a byte-level BPE tokenizer."""
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                file = json.load(f)
            back, model = gpt_bytes(), file["model"]
            special = {t["content"]: t["id"] for t in file["added_tokens"]}
            vocab = {
                bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special
            }
            pairs = []
            for rank, pair in enumerate(model["merges"]):
                a, b = (bytes(back[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
                pairs.append((vocab[a], vocab[b], rank, vocab[a + b]))
            return cls(vocab, pairs, special)
        with open(path, "rb") as f:
            vocab = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pairs = [
            (vocab[t[:i]], vocab[t[i:]], rank, rank)
            for t, rank in vocab.items()
            for i in range(1, len(t))
            if t[:i] in vocab and t[i:] in vocab
        ]
        return cls(vocab, pairs, {})

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NEVER where there is none or ``right`` is missing (negative)."""
        key = np.where(right < 0, -1, left << 20 | right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids (as bytes, 32 bits each) of pieces of 1 to ``width`` bytes, ``width`` a power of two: one segment tree per row, in lockstep."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        place = np.arange(width)
        # A last column of its own takes the updates of neighbours that don't exist.
        token = np.full((n, width + 1), -1, np.int64)
        token[:, :width] = np.where(place < lengths[:, None], self.single[raw], -1)
        after = np.tile(np.minimum(place + 1, width), (n, 1))
        after = np.where(after < lengths[:, None], after, width)
        before = np.tile(np.arange(-1, width), (n, 1))
        before[:, 0] = width
        tree = np.full((n, 2 * width), NEVER, np.int64)
        rank = np.full((n, width), NEVER, np.int64)
        rank[:, :-1] = self.bytes_rank[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        rank[place + 1 >= lengths[:, None]] = NEVER
        tree[:, width:] = np.where(rank < NEVER, rank * width + place, NEVER)
        for i in range(width - 1, 0, -1):
            tree[:, i] = np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1])
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NEVER]
            if not len(rows):
                break
            top = tree[rows, 1]
            at = top % width
            gone = after[rows, at]
            right = after[rows, gone]
            left = before[rows, at]
            merged = self.to[top // width]
            token[rows, at] = merged
            token[rows, gone] = -1
            after[rows, at] = right
            before[rows, right] = at
            before[rows, width] = width
            new_right = self.rank_of(merged, token[rows, right])
            new_left = np.where(left < width, self.rank_of(np.maximum(token[rows, left], 0), merged), NEVER)
            tree[rows, width + at] = np.where(new_right < NEVER, new_right * width + at, NEVER)
            tree[rows, width + gone] = NEVER
            safe = np.where(left < width, left, at)
            tree[rows, width + safe] = np.where(
                left < width, np.where(new_left < NEVER, new_left * width + left, NEVER), tree[rows, width + at]
            )
            for leaf in (at, gone, safe):
                i = (width + leaf) >> 1
                while i[0]:
                    tree[rows, i] = np.minimum(tree[rows, 2 * i], tree[rows, 2 * i + 1])
                    i = i >> 1
        kept = token[:, :width]
        alive = kept >= 0
        flat, ends = kept[alive].astype("<u4").tobytes(), (4 * np.cumsum(alive.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, piece: bytes) -> list[int]:
        """Ids of one piece of any length: one segment tree."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        token = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, never = self.pairs, int(NEVER)

        def leaf(i: int) -> int:
            found = pairs.get(token[i] << 20 | token[after[i]]) if after[i] < n else None
            return found[0] * width + i if found else never

        tree = [never] * (2 * width)
        for i in range(n):
            tree[width + i] = leaf(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            i >>= 1
            while i:
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low
                i >>= 1

        to = self.to
        while tree[1] < never:
            rank, at = divmod(tree[1], width)
            gone = after[at]
            token[at] = int(to[rank])
            token[gone] = -1
            after[at] = after[gone]
            if after[at] < n:
                before[after[at]] = at
            put(gone, never)
            put(at, leaf(at))
            if before[at] >= 0:
                put(before[at], leaf(before[at]))
        return [t for t in token if t >= 0]

    def merge(self, pieces: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of each different piece, as bytes."""
        out, groups = {}, {}
        for p in set(pieces):
            if (known := self.ids.get(p)) is not None and len(p) == 1:
                out[p] = as_bytes([known])
            elif len(p) > LOCKSTEP:
                out[p] = as_bytes(self.merge_long(p))
            else:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, group in groups.items():
            for at in range(0, len(group), 1 << 13):
                part = group[at : at + (1 << 13)]
                out |= zip(part, self.merge_rows(part, width), strict=True)
        return out


class _Words(dict):
    """Ids of words as bytes; ``later`` holds those of the present step that don't fit any more."""

    def __init__(self):
        super().__init__()
        self.later: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.later[word]


class Encoder:
    """Encodes texts as little-endian unsigned 32-bit ids."""

    #: A space before anything but white space always begins a piece, so words can be encoded on their own.
    LOOSE = re.compile(r" (?=\s|\Z)")
    CUT = re.compile(r"(?<!\s)(?= \S)")
    #: Up to here letters and marks are the same in every Unicode version, so the pattern isn't asked.
    PLAIN, MARKS = "\u024f", frozenset(".,;:!?")

    def __init__(self, merges: Merges, pattern: str):
        self.merges = merges
        self.pattern = regex.compile(pattern)
        #: Words after a space, and other stretches as they stand.
        self.spaced, self.other = _Words(), _Words()

    def _pieces(self, word: str) -> list[str]:
        """Pieces of a word and the space before it."""
        if word and max(word) <= self.PLAIN:
            if word.isalpha():
                return [" " + word]
            if word[-1] in self.MARKS and word[:-1].isalpha():
                return [" " + word[:-1], word[-1]]
        return self.pattern.findall(" " + word)

    def _learn(self, spaced: set[str], other: set[str]) -> None:
        known = self.spaced
        # A mark after a word is a piece of its own, so the word may be known already.
        marked = [w for w in spaced if w and w[-1] in self.MARKS and (w[:-1] in known or w[:-1] in spaced)]
        marked = [w for w in marked if max(w) <= self.PLAIN and w[:-1].isalpha()]
        words = list(spaced.difference(marked)), list(other)
        pieces = [[p.encode() for p in self._pieces(w)] for w in words[0]]
        pieces += [[p.encode() for p in self.pattern.findall(w)] for w in words[1]]
        ids = self.merges.merge([m.encode() for m in self.MARKS] + [p for ps in pieces for p in ps])
        each = iter([ids[ps[0]] if len(ps) == 1 else b"".join(map(ids.__getitem__, ps)) for ps in pieces])
        new = dict(zip(words[0], each, strict=False))
        marks = {m: ids[m.encode()] for m in self.MARKS}
        new |= {w: (new.get(w[:-1]) or known[w[:-1]]) + marks[w[-1]] for w in marked}
        for memory, found in ((self.spaced, new), (self.other, dict(zip(words[1], each, strict=True)))):
            if len(memory) + len(found) <= MEMORY:
                memory.update(found)
            else:
                memory.later = found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, null as empty; special strings are text."""
        split = []
        spaced, other = set(), set()
        for text in texts:
            if not text:
                split.append(([], []))
            elif self.LOOSE.search(text):
                split.append((self.CUT.split(text), []))
            else:
                first, *words = text.split(" ")
                split.append(([first], words))
            other.update(split[-1][0])
            spaced.update(split[-1][1])
        self.spaced.later, self.other.later = {}, {}
        spaced.difference_update(self.spaced)
        other.difference_update(self.other)
        if spaced or other:
            self._learn(spaced, other)
        get_other, get = self.other.__getitem__, self.spaced.__getitem__
        return [b"".join([*map(get_other, a), *map(get, b)]) for a, b in split]

    def encode_special(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode``, but the strings of special tokens give their ids, as tokenizers do by default."""
        special = self.merges.special
        if not any(t and s in t for t in texts for s in special):
            return self.encode(texts)
        cut = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        parts = [cut.split(t) if t else [] for t in texts]
        plain = iter(self.encode([p for ps in parts for p in ps[::2]]))
        fixed = {s: as_bytes([i]) for s, i in special.items()}
        return [b"".join(fixed[p] if i & 1 else next(plain) for i, p in enumerate(ps)) for ps in parts]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.merges.vocab.__getitem__, array("I", ids)))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(Merges.read(path), pattern)


def encode(
    docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), with_decoded: bool = False
) -> DataFrame:
    """Columns ``keep``, n_tokens and ids (binary, little-endian unsigned 32-bit) of every text.

    Null and empty texts give no ids. One pass, nothing is shuffled. ``with_decoded`` adds decoded, the bytes that the
    ids stand for, in the same pass.
    """

    def work(texts):
        one = encoder(path, pattern)
        ids = one.encode(texts)
        return [[len(x) // 4 for x in ids], ids] + ([list(map(one.decode, ids))] if with_decoded else [])

    fields = [("n_tokens", "long"), ("ids", "binary")] + ([("decoded", "binary")] if with_decoded else [])
    return map_texts(docs, list(keep), fields, work)


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of ``tokens`` and decoded: the bytes that its column ids stands for; null ids give null."""
    import pyarrow as pa

    ship_code(tokens.sparkSession)

    def run(batches):
        for batch in batches:
            one = encoder(path, pattern)
            ids = batch.column("ids").to_pylist()
            decoded = pa.array([None if x is None else one.decode(x) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], [*batch.schema.names, "decoded"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes)
    return tokens.mapInArrow(run, kinds + ", decoded binary")
