"""Token ids of texts by a public byte-level BPE, exactly as the ``tokenizers`` library gives them.

In plain prose a single space between two visible characters always starts a new token, so a
text may be cut there and each chunk looked up in a dictionary of chunks already seen. Any text
with other spacing, with characters outside the plain set, or with a special token's string
goes through the library itself.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
MAX_CHUNKS = 100_000  # entries of each of the two dictionaries that a Python worker keeps

# Outside these characters, or at spaces that touch other white space, texts are not cut.
_UNUSUAL = re.compile("[^\t\n\r -~¡§©«®°·»¿-ɏ‐-‧]| [ \t\n\r]|[\t\n\r] |^ | $")
_SPECIAL = "<|endoftext|>"


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Chunks(dict):
    """Chunk of text to its ids as little-endian 32-bit bytes; emptied when it grows too large."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MAX_CHUNKS:
            self.clear()
        self[chunk] = ids = np.asarray(self.encode(chunk), dtype="<u4").tobytes()
        return ids


class Encoder:
    def __init__(self, vocabulary: str, ranks: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding(
            "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )
        self.first = Chunks(plain.encode_ordinary)
        self.later = Chunks(lambda chunk: plain.encode_ordinary(" " + chunk))

    def ids(self, text: str) -> bytes:
        """The ids, four bytes each, little-endian."""
        if not text:
            return b""
        if _UNUSUAL.search(text) or _SPECIAL in text:
            text = text.encode("utf-8", "replace").decode()
            return np.asarray(
                self.library.encode(text, add_special_tokens=False).ids, dtype="<u4"
            ).tobytes()
        head, *rest = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, rest))


@cache
def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Encoder:
    """One encoder per Python worker; the paths are those of the public tokenizer files."""
    return Encoder(vocabulary or place(VOCABULARY), ranks or place(RANKS))
