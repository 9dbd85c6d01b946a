"""Byte-level BPE vocabularies: loading, pre-token splitting, pair ranks.

The path of the vocabulary file (tiktoken's format: base64 token, space, rank) is always a
parameter.  A loaded vocabulary is kept for the life of the Python worker, by path.
"""

from __future__ import annotations

import base64
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex

#: Where the box keeps its public tokenizers; callers may name any other file.
DEFAULT_VOCAB = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: The pre-token rule of that vocabulary: contractions, words, numbers, symbols, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: No pair of this rank exists.
NONE = np.int32(1 << 24)
#: White space other than space and line feed; a text with any goes through PATTERN whole.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Symbols that end many words and are never part of a contraction.
TAIL = ".,;:!?*&%$#|)]}\"-"


class Vocab:
    """Token bytes by id, ids of the 256 bytes, and the rank of each pair of tokens that has one."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.size = max(ranks.values()) + 1
        by_id = [b""] * self.size
        for token, rank in ranks.items():
            by_id[rank] = token
        self.bytes = by_id
        self.arrow = pa.array(by_id, pa.large_binary())
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 24 | b] = rank
        self.pairs = pairs
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks = np.fromiter(pairs.values(), np.int32, len(pairs))[order]
        self.split = regex.compile(PATTERN)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, which is also the id of the merged token; NONE where no such token exists."""
        keys = left.astype(np.int64) << 24 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NONE).astype(np.int32)

    def pieces(self, text: str) -> list[str]:
        """Cuts of the text that never go through a pre-token: before single spaces, around single line feeds.

        A space that is alone starts a pre-token, a line feed that is alone is one.  Only
        runs of white space are more involved; a text that has one isn't cut here.
        """
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text):
            return self.split.findall(text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            head, *rest = line.split(" ")
            if head:
                out.append(head)
            out += map(" ".__add__, rest)
        return out

    def pretokens(self, piece: str) -> list[str]:
        """The pre-tokens of one piece; a word with symbols after it needs no regular expression."""
        core = piece.rstrip(TAIL)
        if core.isalpha() or (core[:1] == " " and core[1:].isalpha()):
            return [core, piece[len(core) :]] if len(core) < len(piece) else [piece]
        return self.split.findall(piece)


@cache
def load(path: str) -> Vocab:
    return Vocab(path)
