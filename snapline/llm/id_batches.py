"""Token ids of whole batches of texts, for operators that need the ids and not the way to them.

The library tiktoken encodes, over the merge ranks in the .json of a byte-level BPE tokenizer; the ids are those that the
library tokenizers gives, strings of special tokens included, in a fraction of its time. A step's ids lie in one buffer.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken

from .bpe import gpt_bytes

#: What the pattern says of runs of white space, and the same for texts that have no two white characters in a row.
RUNS, SINGLE = r"|\s+(?!\S)|\s+", r"|\s"


class BatchEncoder:
    """Encodes by the .json of a byte-level BPE tokenizer and the pattern that cuts its pieces."""

    DOUBLE = re.compile(r"\s\s")

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        back, model = gpt_bytes(), file["model"]
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        ids = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        merged = [
            bytes(back[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part) for m in model["merges"]
        ]
        order = [*(bytes([b]) for b in range(256)), *merged]
        #: tiktoken numbers tokens by their merge; here is the id that each has in the file.
        self.ids = np.array([ids[token] for token in order], np.uint32)
        ranks = {token: rank for rank, token in enumerate(order)}
        one = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = self.single = one.encode_ordinary
        if pattern.endswith(RUNS):
            # No look-ahead is left, so the pieces are found in half the time.
            short = pattern.removesuffix(RUNS) + SINGLE
            self.single = tiktoken.Encoding(path, pat_str=short, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _ranks(self, text: str) -> list[int]:
        return (self.full if self.DOUBLE.search(text) else self.single)(text)

    def encode(self, texts: list[str | None], end: int | None = None) -> tuple[np.ndarray, list[int]]:
        """All ids one after the other, unsigned 32 bits, and the place where each text's ids begin, with the end as last.

        A null or empty text has no ids of its own. ``end`` is put after each text's ids.
        """
        flat, places, fixed = array("I"), [0], []
        for text in texts:
            if text:
                if any(s in text for s in self.special):
                    for i, part in enumerate(self.cut.split(text)):
                        if i & 1:
                            fixed.append((len(flat), self.special[part]))
                            flat.append(0)
                        else:
                            flat.extend(self._ranks(part))
                else:
                    flat.extend(self._ranks(text))
            if end is not None:
                fixed.append((len(flat), end))
                flat.append(0)
            places.append(len(flat))
        ids = self.ids[np.frombuffer(flat, np.uint32)] if flat else np.zeros(0, np.uint32)
        if fixed:
            at, put = zip(*fixed, strict=True)
            ids[list(at)] = put
        return ids, places


@lru_cache(2)
def batch_encoder(path: str, pattern: str) -> BatchEncoder:
    """One encoder per worker process and vocabulary."""
    return BatchEncoder(path, pattern)
