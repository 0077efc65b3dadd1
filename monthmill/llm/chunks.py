"""Cached encoding of texts by the pieces that a tokenizer cuts them into anyway.

Both tokenizers here never form a token across a space that stands between two
other characters.  So a text is cut there, each distinct chunk is encoded once by
the library, and a text's ids are its chunks' ids in a row.
"""

from __future__ import annotations

import re

import numpy as np

#: Chunks that a worker remembers: two generations of so many.  Longer ones are never kept, so the memory is bounded.
MAX_CACHED, MAX_LENGTH = 150_000, 64
_DOUBLE = re.compile(r"\s | \s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")


def split_at_single_spaces(text: str) -> list[str]:
    return _SINGLE.split(text) if _DOUBLE.search(text) else text.split(" ")


class ChunkCache:
    """ids of chunks as little-endian bytes of ``dtype``; ``encode_many`` turns chunks into lists of ids."""

    def __init__(self, encode_many, dtype: str):
        self.encode_many, self.dtype, self.known, self.old = encode_many, dtype, {}, {}

    def join(self, chunked: list[list[str]]) -> list[bytes]:
        """Each list of chunks as one run of ids."""
        if len(self.known) >= MAX_CACHED:
            self.known, self.old = {}, self.known
        known, once, missing = self.known, {}, []
        for c in {c for chunks in chunked for c in chunks}.difference(known):
            if c in self.old:
                known[c] = self.old[c]
            else:
                missing.append(c)
        for c, ids in zip(missing, self.encode_many(missing) if missing else []):
            (known if len(c) <= MAX_LENGTH else once)[c] = np.asarray(ids, self.dtype).tobytes()
        get = (lambda c: once[c] if c in once else known[c]) if once else known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in chunked]
