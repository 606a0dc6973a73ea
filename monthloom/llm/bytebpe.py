"""Byte-level BPE vocabularies: splitting texts into pieces as the tokenizers library does, and the merge rules.

A vocabulary is a tokenizers .json with a ByteLevel pre-tokenizer that uses its pattern. Plain pieces of a text are found
with Python's re, which agrees with the library on the characters of SAFE; a text with any other character is split by
the library's own pre-tokenizer, so that no Unicode table has to match another.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Characters outside the ranges for which re and the library's pattern have been compared one by one (tests/llm/test_tokens.py).
UNSAFE = re.compile("[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u0377\u0400-\u052f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Merge ranks by pair of ids, and the splitter. special: added token -> id, matched in texts before all else."""

    SHIFT = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE vocabulary")
        added = spec.get("added_tokens") or []
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not handled")
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.of_byte = [vocab[letters[b]] for b in range(256)]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << self.SHIFT | vocab[b]] = r
            self.merged.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in added}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        self._library, self._back = None, {c: b for b, c in letters.items()}

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens, as strings of the text."""
        if UNSAFE.search(text) is None:
            return PIECES.findall(text)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
