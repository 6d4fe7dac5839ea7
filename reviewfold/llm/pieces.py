"""Token ids of whole texts.

For a vocabulary that drops white space a text may be cut at any ASCII white
space: no token and no normalisation crosses it. Most of these pieces are
repeated, so each distinct piece is encoded once by the tokenizer's own batch
call, and a worker remembers a bounded number of pieces for later batches.
"""

from __future__ import annotations

import base64
import itertools
import os
import re
from collections.abc import Sequence

import numpy as np

#: Pieces a worker remembers between batches; then it starts anew.
REMEMBERED = 800_000

# A special token's string begins so; outside Latin letters Unicode versions differ.
_UNSURE = re.compile(r"<\||[^\x00-\u024f\u2010-\u2027\u20ac]")


def load_tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbering(dict):
    """Numbers keys in the order of their first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


class PieceEncoder:
    """Encodes distinct pieces once and remembers a bounded number of them.

    ``ids`` maps piece numbers to token ids by offsets into one array.
    """

    def __init__(self, tokenizer, remembered: int = REMEMBERED):
        self.tokenizer, self.remembered = tokenizer, remembered
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbering()
        self.chunks: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def encode(self, texts: Sequence[Sequence[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts as lists of UTF-8 pieces: piece numbers of all texts in a row,
        and for each number the count, start and array of its ids."""
        if len(self.number) > self.remembered:
            self._forget()
        number = self.number
        known = len(number)
        flat: list[int] = []
        for pieces in texts:
            flat.extend(map(number.__getitem__, pieces))
        new = list(itertools.islice(number, known, None))
        if new:
            counts, ids = self._encode_new([p.decode("utf-8", "replace") for p in new])
            self.chunks.append(ids)
            self.counts.append(counts)
        if len(self.chunks) > 1:
            self.chunks = [np.concatenate(self.chunks)]
            self.counts = [np.concatenate(self.counts)]
        counts = self.counts[0] if self.counts else np.zeros(0, np.int64)
        ids = self.chunks[0] if self.chunks else np.zeros(0, np.uint32)
        return np.array(flat, dtype=np.int64), counts, np.cumsum(counts) - counts, ids

    def _encode_new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        counts, parts = [], []
        for at in range(0, len(pieces), 4096):
            encoded = self.tokenizer.encode_batch_fast(pieces[at : at + 4096], add_special_tokens=False)
            ids = [e.ids for e in encoded]
            counts.extend(map(len, ids))
            parts.append(np.array([i for each in ids for i in each], dtype=np.uint32))
        return np.array(counts, dtype=np.int64), np.concatenate(parts)


class RankedEncoder:
    """Ids of whole texts for a byte-level vocabulary also given as merge ranks.

    The rank file's library gives the same ids several times faster. Texts with
    a special token's string, or with characters on whose classes two Unicode
    versions may disagree, go to the tokenizer itself; given as a path, it is read
    at the first of them.
    """

    def __init__(self, tokenizer, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokenizer = tokenizer
        self.ranked = tiktoken.Encoding("ranked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _UNSURE.search(text) is None:
            return self.ranked.encode_ordinary(text)
        if isinstance(self.tokenizer, str):
            self.tokenizer = load_tokenizer(self.tokenizer)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def gather(numbers: np.ndarray, counts: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Ids of the pieces ``numbers`` in a row."""
    each = counts[numbers]
    total = int(each.sum())
    begins = np.repeat(starts[numbers] - (np.cumsum(each) - each), each)
    return ids[begins + np.arange(total)]
