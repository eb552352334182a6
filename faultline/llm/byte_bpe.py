"""Exact byte-level BPE ids, as the tokenizers library gives them for byte_bpe_50k.json, at the speed of tiktoken.

Both libraries split a text by the same pattern and merge by the same ranks; tests compare them. What only the
tokenizers library knows, the special token inside a text, is cut out here; what the fast library refuses (its pattern
engine gives up on some extreme texts) goes to the tokenizers library.
"""

from __future__ import annotations

import functools
import json

import numpy as np


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest
    for code points from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        # the pattern that a ByteLevel pre-tokenizer with use_regex stands for; a fixed value
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.fast = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = special
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, np.int64)
        for token, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.lengths[i] = len(token)

    def ids(self, text: str) -> np.ndarray:
        for token, i in self.special.items():
            if token in text:
                parts = [self.ids(p) for p in text.split(token)]
                between = np.array([i], np.uint32)
                return np.concatenate([x for p in parts for x in (between, p)][1:])
        try:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        except ValueError:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One vocabulary for each worker process and path."""
    return ByteBpe(path)
