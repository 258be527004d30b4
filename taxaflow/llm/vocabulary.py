"""Byte-level BPE vocabularies of the public tokenizer files, loaded once per Python worker.

The vocabulary file's place is an argument everywhere. Encoding uses the file of ranks, whose ids are
those of the tokenizers library for the JSON file of the same name: both split by the same pattern
and agree for every code point (tests compare them). A special token's own string in a text becomes
its id, as that library does by default.
"""

from __future__ import annotations

import base64
import functools
import json

import numpy as np


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Codec:
    """Encoder and decoder of one byte-level BPE file in the tokenizers library's JSON format."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = bytes_by_letter()
        special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        pieces = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = special
        # The file's merges are listed in the order of the ids they make, so ids serve as ranks.
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=pieces, special_tokens=special)
        table = [b""] * (1 + max([*pieces.values(), *special.values()]))
        for piece, i in [*pieces.items(), *((t.encode(), i) for t, i in special.items())]:
            table[i] = piece
        self.lengths = np.array([len(piece) for piece in table], np.int64)

    def tokens(self, text: str) -> list[int]:
        if any(token in text for token in self.special):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.tokens(text), np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.encoding.decode(ids.tolist())

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist())


def bytes_by_letter() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, reversed."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


@functools.cache
def rank_encoding(path: str):
    """tiktoken encoding of a ``.tiktoken`` file, without special tokens."""
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
