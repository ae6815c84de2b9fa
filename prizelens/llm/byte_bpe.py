"""Byte-level BPE by pre-token: each distinct pre-token is encoded once per worker."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

from prizelens.llm.common import worker_memo

MEMO_TOKENS = 800_000  # a full memo is emptied and fills again; results do not depend on it
LATIN_END = 0x250  # end of the Latin blocks


def char_ranges(chars: Iterable[int]) -> str:
    """Code points as the inside of a regex character class."""
    ranges: list[list[int]] = []
    for c in chars:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def newer_characters() -> re.Pattern:
    """Characters that Unicode 3.2 did not have. Two regex engines of different Unicode
    versions agree on the classes of all others."""
    old = unicodedata.ucd_3_2_0
    return re.compile(f"[{char_ranges(c for c in range(0x110000) if old.category(chr(c)) == 'Cn')}]")


def latin_form(pattern: str) -> re.Pattern:
    """``pattern`` for texts of Latin blocks only: its classes written out, which the
    standard engine matches faster."""
    named = {r"\p{L}": "L", r"\p{N}": "N", r"\s": "s"}
    for name in named:
        test = regex.compile(name)
        inside = char_ranges(c for c in range(LATIN_END) if test.match(chr(c)))
        pattern = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m: m[1] + inside, pattern)
        pattern = re.sub(rf"(\[[^\]]*){re.escape(name)}", lambda m: m[1] + inside, pattern)
        pattern = pattern.replace(name, f"[{inside}]")
    pattern = pattern.replace(r"\S", "[^" + char_ranges(
        c for c in range(LATIN_END) if regex.match(r"\s", chr(c))) + "]")
    return re.compile(pattern)


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes with ids, if every merge's result has its rank as id order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # Byte-level alphabet: printable bytes stand for themselves, the others follow from 256.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab, last = model["vocab"], -1
    for merge in model["merges"]:
        rank = vocab["".join(merge if isinstance(merge, list) else merge.split(" "))]
        if rank <= last:
            return None
        last = rank
    return {bytes(byte_of[c] for c in t): i for t, i in vocab.items()}


class ByteBpe:
    """Encodes texts exactly as the ``tokenizers`` library does for a byte-level BPE file.

    The library splits a text by a fixed pattern and encodes the parts (pre-tokens)
    one by one, so a part's ids can be remembered. Texts that hold an added token or a
    character newer than Unicode 3.2 go through the library as a whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pattern = regex.compile(pattern)
        self.latin = latin_form(pattern)
        self.not_latin = re.compile(f"[^\\0-{chr(LATIN_END - 1)}]")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newer = newer_characters()
        ranks = merge_ranks(path)
        self.fast = ranks and tiktoken.Encoding(
            path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.parts: dict[str, bytes] = {}

    @classmethod
    def of_worker(cls, path: str, pattern: str) -> ByteBpe:
        memo = worker_memo("byte_bpe")
        if (path, pattern) not in memo:
            memo[path, pattern] = cls(path, pattern)
        return memo[path, pattern]

    def whole(self, text: str) -> list[int]:
        """Ids by the library alone."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def part(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return self.fast.encode_ordinary(text) if self.fast else self.whole(text)

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens, or None where the library must see the whole text."""
        if any(a in text for a in self.added):
            return None
        if text.isascii() or not self.not_latin.search(text):
            return self.latin.findall(text)
        return None if self.newer.search(text) else self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts = self.split(text)
        if parts is None:
            return np.asarray(self.whole(text), "<u4").tobytes()
        try:
            return b"".join(map(self.parts.__getitem__, parts))
        except KeyError:
            if len(self.parts) > MEMO_TOKENS:
                self.parts.clear()
            for p in parts:
                if p not in self.parts:
                    self.parts[p] = np.asarray(self.part(p), "<u4").tobytes()
            return b"".join(map(self.parts.__getitem__, parts))
