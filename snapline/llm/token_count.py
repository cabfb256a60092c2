"""Token counts by a tokenizer compiled to finite-state transducers.

Two transducers run over a text. The first marks where pieces begin; it looks at no more than its neighbours and so is
evaluated for all characters at once. The second reads the bytes of a piece: a valid encoding is one whose neighbouring
tokens would not merge otherwise, so the last token of every prefix follows from the last tokens of the prefixes before
it, and only as many of them matter as the longest suffix that begins a token is long. These few tokens, with the token
counts relative to now, are the state; the change of the count is the output on the transition. States are compiled
when a text first needs them.

Texts are cut into chunks that advance in lockstep. A chunk's map takes the state in which it is entered to the state in
which it is left and the tokens it counts. After the beginning of a piece this map is constant, so a chunk that begins
with one needs no other. Within a longer piece the map is made for the states that are reached: first for the state that
some bytes before the chunk lead to, then for those in which the chunk before may be left, until no exit is missing; all
chunks advance side by side in each of these rounds. The maps of a piece are then composed by a parallel prefix scan,
pairs first, which gives the state in which each chunk is really entered.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges, as_bytes
from .common import map_texts

#: Bytes after which a chunk ends with its piece, and how many steps are laid out at once.
CHUNK, LAID = 512, 64
#: Bytes before a chunk that its first guess of the entry state is made from.
LOOK = 64
#: States after which a new table is begun, within a text too; states are compiled anew as they are met.
MOST_STATES = 150_000

LETTER, NUMBER, OTHER, SPACE = range(4)
#: White space of the pattern: Unicode's White_Space.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def character_kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c in "LN":
            kinds[i] = LETTER if c == "L" else NUMBER
    kinds[WHITE] = SPACE
    return kinds


def piece_starts(code: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin, for the code points of several texts one after the other; ``begins`` marks their first.

    Stands for the pattern 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+.
    """
    n = len(code)
    kind = character_kinds()[code]
    ends = np.append(begins[1:], True)
    new_run = begins.copy()
    new_run[1:] |= kind[1:] != kind[:-1]
    white = kind == SPACE
    after_blank = np.zeros(n, bool)
    after_blank[1:] = (code[:-1] == 32) & ~begins[1:]
    # A run of letters, numbers or others takes the blank before it along.
    start = new_run & (white | ~after_blank)
    # The last white space before something else stands alone or goes with that.
    last_white = white & ~ends
    last_white[:-1] &= ~white[1:]
    start |= last_white
    # Short forms after an apostrophe that begins a piece.
    mark = np.flatnonzero(start & (code == 39))
    if len(mark):
        padded = np.concatenate([code, [0, 0, 0]])
        fresh = np.concatenate([begins, [True, True, True]])
        one, two = padded[mark + 1], padded[mark + 2]
        one = np.where(fresh[mark + 1], 0, one)
        two = np.where(fresh[mark + 1] | fresh[mark + 2], 0, two)
        is_ = lambda x, c: x == ord(c)
        short = is_(one, "s") | is_(one, "t") | is_(one, "m") | is_(one, "d")
        long = (is_(one, "r") | is_(one, "v")) & is_(two, "e") | is_(one, "l") & is_(two, "l")
        start[mark[short | long] + 1] = False
        after = np.concatenate([mark[short] + 2, mark[long] + 3])
        after = after[after < n]
        # A blank before a word begins that piece already; white space keeps its own rule.
        start[after] |= ~white[after] | new_run[after]
    return start


#: From entry states to exit state and tokens counted.
Map = dict[tuple, tuple[tuple, int]]


def composed(first: Map, then: Map) -> Map:
    """The map of two neighbouring chunks."""
    return {entry: (then[exit_][0], n + then[exit_][1]) for entry, (exit_, n) in first.items()}


def prefixes(maps: list[Map]) -> list[Map]:
    """The maps of all first 1, 2, 3, ... chunks: pairs are composed, scanned, and completed by every second chunk."""
    if len(maps) < 2:
        return maps
    pairs = prefixes([composed(a, b) for a, b in zip(maps[::2], maps[1::2])])
    return [
        maps[0] if not i else pairs[i // 2] if i % 2 else composed(pairs[i // 2 - 1], maps[i]) for i in range(len(maps))
    ]


class Counter:
    """The compiled transducer of one vocabulary."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.special = merges.special
        encoded = merges.merge(merges.ids)
        whole = {b: i for b, i in merges.ids.items() if encoded[b] == as_bytes([i])}
        self.next: list[dict[int, int]] = [{}]
        self.depth, text = [0], [b""]
        for token in sorted(whole, key=len):
            node = 0
            for b in token:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    self.depth.append(self.depth[node] + 1)
                    text.append(text[node] + bytes([b]))
                node = self.next[node][b]
        self.token = [whole.get(t, -1) for t in text]
        self.fail = [0] * len(text)
        for node in sorted(range(len(text)), key=self.depth.__getitem__):
            for b, child in self.next[node].items():
                if node:
                    self.fail[child] = self._go(self.fail[node], b)
        self.valid: dict[tuple[int, int], bool] = {}
        self._reset()

    def _renew(self) -> None:
        """Begins a new table of states; bytes keep their columns."""
        start = (0, ((-1, 0),))
        self.states, self.number = [start], {start: 0}
        self.table = np.full(16384 * self.width, -1, np.int32)

    def _intern(self, state: tuple) -> int:
        number = self.number.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            if (number + 1) * self.width > len(self.table):
                self.table = np.concatenate([self.table, np.full(16384 * self.width, -1, np.int32)])
        return number

    def _reset(self) -> None:
        #: Bytes have columns in the order in which they are met, so that texts in few scripts need a narrow table.
        self.column, self.byte = np.full(256, -1, np.int32), []
        self.width = 64
        self._renew()

    def _columns(self, raw: np.ndarray) -> np.ndarray:
        for b in np.flatnonzero(np.bincount(raw, minlength=256)).tolist():
            if self.column[b] < 0:
                if len(self.byte) == self.width:
                    wider = np.full((len(self.table) // self.width, 2 * self.width), -1, np.int32)
                    wider[:, : self.width] = self.table.reshape(-1, self.width)
                    self.width, self.table = 2 * self.width, wider.reshape(-1)
                self.column[b] = len(self.byte)
                self.byte.append(b)
        return self.column[raw]

    def _go(self, node: int, b: int) -> int:
        while node and b not in self.next[node]:
            node = self.fail[node]
        return self.next[node].get(b, 0)

    def _fits(self, a: int, b: int) -> bool:
        """Whether the tokens stand side by side in the encoding of their bytes."""
        if a < 0:
            return True
        key = a, b
        if (found := self.valid.get(key)) is None:
            vocab = self.merges.vocab
            found = self.valid[key] = self.merges.merge_long(vocab[a] + vocab[b]) == [a, b]
        return found

    def _compile(self, state: int, b: int) -> None:
        """Adds one transition: the next state, times 512, plus the change of the count, plus 256."""
        node, past = self.states[state]
        node = look = self._go(node, b)
        while True:
            token, back = self.token[look], self.depth[look] - 1
            if token >= 0 and back < len(past) and self._fits(past[back][0], token):
                break
            look = self.fail[look]
        change = past[back][1] + 1
        kept = past[: self.depth[node]]
        state_to = (node, ((token, 0), *((t, c - change) for t, c in kept)))
        number = self._intern(state_to)
        self.table[state * self.width + int(self.column[b])] = number << 9 | (change + 256)

    def _step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        key = state * self.width + column
        out = self.table[key]
        if out.min() < 0:
            for k in np.unique(key[out < 0]).tolist():
                self._compile(k // self.width, self.byte[k % self.width])
            out = self.table[key]
        return out

    def _run(
        self, columns: np.ndarray, start: np.ndarray, at: np.ndarray, size: np.ndarray, entry: list[tuple],
        out: np.ndarray | None = None,
    ) -> tuple[list[tuple], np.ndarray]:
        """Exit states and token counts of the stretches ``at`` to ``at + size``, entered in the given states, side by
        side; ``out`` takes each byte's change of the count."""
        order = np.argsort(-size, kind="stable")
        at, size = at[order], size[order]
        state = np.array([self._intern(entry[i]) for i in order], np.int32)
        total = np.zeros(len(at), np.int64)
        for first in range(0, int(size[0]) if len(size) else 0, LAID):
            if len(self.states) > MOST_STATES:
                held = [self.states[x] for x in state]
                self._renew()
                state = np.array([self._intern(x) for x in held], np.int32)
            lanes = int(np.searchsorted(-size, -first, side="left"))
            here = at[:lanes] + np.arange(first, min(first + LAID, int(size[0])))[:, None]
            inside = here < (at + size)[:lanes]
            here = np.minimum(here, len(columns) - 1)
            read = columns[here]
            goes_on = np.where(start[here], 0, 1).astype(np.int32)
            change = np.zeros(here.shape, np.int16)
            for i, each in enumerate(read):
                live = int(np.searchsorted(-size, -(first + i), side="left"))
                moved = self._step(state[:live] * goes_on[i, :live], each[:live])
                state[:live] = moved >> 9
                change[i, :live] = (moved & 511) - 256
            total[:lanes] += change.sum(0)
            if out is not None:
                out[here[inside]] = change[inside]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return [self.states[x] for x in state[back]], total[back]

    def _pieces(self, raw: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Tokens counted in each byte's transition, summed so far, for bytes with the begins of pieces."""
        n = len(raw)
        begins = np.flatnonzero(start)
        # Chunks end where a piece begins, or within a piece that is longer than a chunk.
        wanted = np.arange(0, n, CHUNK)
        place = begins[np.minimum(np.searchsorted(begins, wanted), len(begins) - 1)]
        cuts = np.unique(np.where((place >= wanted) & (place < wanted + CHUNK), place, wanted))
        lengths = np.diff(np.append(cuts, n))
        fresh = start[cuts]
        columns = self._columns(raw)
        out = np.zeros(n, np.int16)
        entry = [self.states[0]] * len(cuts)
        inner = np.flatnonzero(~fresh)
        if not len(inner):
            self._run(columns, start, cuts, lengths, entry, out)
            return np.cumsum(out, dtype=np.int64)
        back = np.minimum(LOOK, cuts[inner])
        guessed, _ = self._run(columns, start, cuts[inner] - back, back, [self.states[0]] * len(inner))
        for k, x in zip(inner.tolist(), guessed, strict=True):
            entry[k] = x
        exits, totals = self._run(columns, start, cuts, lengths, entry, out)
        maps: list[Map] = [{e: (x, c)} for e, x, c in zip(entry, exits, totals.tolist(), strict=True)]
        # Maps of the chunks within a piece take in every state in which the chunk before them may be left.
        todo = [(k, exits[k - 1]) for k in inner.tolist() if exits[k - 1] not in maps[k]]
        while todo:
            ks = np.array([k for k, _ in todo])
            left, counted = self._run(columns, start, cuts[ks], lengths[ks], [x for _, x in todo])
            for (k, x), y, c in zip(todo, left, counted.tolist(), strict=True):
                maps[k][x] = (y, c)
            after = {(k + 1, y) for (k, _), y in zip(todo, left, strict=True) if k + 1 < len(cuts) and not fresh[k + 1]}
            todo = [(k, y) for k, y in after if y not in maps[k]]
        # Pieces that go on over chunks: a first chunk that begins fresh, and those after it.
        wrong = []
        for chain in np.split(np.arange(len(cuts)), np.flatnonzero(fresh)[1:]):
            if len(chain) > 1:
                first = chain[0]
                scanned = prefixes([{entry[first]: maps[first][entry[first]]}, *(maps[k] for k in chain[1:-1])])
                for k, before in zip(chain[1:].tolist(), scanned, strict=True):
                    if (true := before[entry[first]][0]) != entry[k]:
                        wrong.append((k, true))
        if wrong:
            ks = np.array([k for k, _ in wrong])
            self._run(columns, start, cuts[ks], lengths[ks], [x for _, x in wrong], out)
        return np.cumsum(out, dtype=np.int64)

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text, null as empty; the strings of special tokens count one each."""
        if len(self.states) > MOST_STATES:
            self._reset()
        cut = re.compile("|".join(map(re.escape, self.special)) or r"\Z(?!\Z)")
        counts = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            if t:
                found = cut.split(t)
                counts[i] = len(found) - 1
                parts += [p for p in found if p]
                owner += [i] * sum(map(bool, found))
        if not parts:
            return counts.tolist()
        joined = "".join(parts)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        begins = np.zeros(len(code), bool)
        begins[np.cumsum([0, *map(len, parts[:-1])])] = True
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        start = np.zeros(len(raw), bool)
        start[lead[piece_starts(code, begins)]] = True
        so_far = np.concatenate([[0], self._pieces(raw, start)])
        bounds = np.append(lead[begins], len(raw))
        np.add.at(counts, owner, np.diff(so_far[bounds]))
        return counts.tolist()


@lru_cache(2)
def counter(path: str) -> Counter:
    """One compiled transducer per worker process and vocabulary."""
    return Counter(Merges.read(path))


def count_tokens(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), limit: int = 512) -> DataFrame:
    """Columns ``keep``, n_bytes (UTF-8), n_tokens and over_limit of every text.

    ``path``: the .json of a byte-level BPE tokenizer. Null and empty texts have none. One pass, nothing is shuffled.
    """

    def work(texts):
        return [[len(t.encode()) if t else 0 for t in texts], counter(path).count(texts)]

    counted = map_texts(docs, list(keep), [("n_bytes", "long"), ("n_tokens", "long")], work)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
