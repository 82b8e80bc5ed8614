"""Byte-pair encoding with a public vocabulary by per-prefix dynamic programming.

Of every prefix of a piece there is exactly one token that can end its encoding. Going through the prefixes in order,
the tokens that end at a position are found by a trie of reversed tokens (the suffix matches an automaton reports),
and the one whose predecessor, the token stored for the rest, is compatible with it is stored. Back-pointers from the
end give the ids. Two tokens are compatible when encoding their joined bytes gives just them; that test undoes merges
along the boundary and never encodes anything.
"""

from __future__ import annotations

import base64
import functools
import itertools
import os
import re
import sys
import unicodedata

DEFAULT_FOLDER = "/opt/tokenizers"
#: Pieces kept per worker. A piece that is not kept is encoded again, so the bound changes no result.
KEPT_PIECES = 300_000
#: Longer pieces are encoded each time.
KEPT_LENGTH = 64


def _ranges(points: list[int]) -> str:
    out = []
    for _, run in itertools.groupby(enumerate(points), lambda x: x[1] - x[0]):
        run = [p for _, p in run]
        out.append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    return "".join(out)


@functools.cache
def piece_pattern() -> re.Pattern:
    """The vocabulary's splitting rule for the standard library: contractions, then runs of letters, numbers or other
    marks with at most one space before them, then white space, which leaves its last character to what follows."""
    space = re.compile(r"\s")
    kinds: dict[str, list[int]] = {"L": [], "N": [], "S": []}
    for p in range(sys.maxunicode + 1):
        c = chr(p)
        kind = unicodedata.category(c)[0]
        if kind in "LN":
            kinds[kind].append(p)
        # The splitting rule's white space is that of Unicode, which lacks the four information separators.
        elif space.match(c) and not 0x1C <= p <= 0x1F:
            kinds["S"].append(p)
    letter, number, blank = (_ranges(kinds[k]) for k in "LNS")
    return re.compile(
        f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


class Encoder:
    """Exact encoder for a rank file (base64 token and rank a line)."""

    def __init__(self, path: str):
        self.token_of: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.token_of[base64.b64decode(token)] = int(rank)
        self.bytes_of = {i: t for t, i in self.token_of.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self._compatible: dict[tuple[int, int], bool] = {}
        self.longest = max(map(len, self.token_of))
        # In rank order, a token's last merge joins the two parts that the vocabulary's earlier merges leave of it.
        for token, i in sorted(self.token_of.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merge(token, i)
                if len(parts) == 2:
                    self.split[i] = (parts[0], parts[1])
                    self.merged[parts[0], parts[1]] = i
        #: Tokens no text encodes to, as no two earlier ones join to them.
        self.reachable = {i for i, t in self.bytes_of.items() if len(t) == 1 or i in self.split}
        self.suffixes: dict = {}
        for token, i in self.token_of.items():
            if i in self.reachable:
                node = self.suffixes
                for byte in reversed(token):
                    node = node.setdefault(byte, {})
                node[-1] = i

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The merges under rank ``below`` applied to a token's bytes; only used to learn the vocabulary's splits."""
        parts = [bytes([b]) for b in token]
        while len(parts) > 2:
            ranks = [self.token_of.get(a + b, below) for a, b in zip(parts, parts[1:])]
            least = min(ranks)
            if least >= below:
                break
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.token_of[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' joined bytes gives just the two."""
        known = self._compatible.get((left, right))
        if known is None:
            known = self._test(left, right)
            if len(self._compatible) < 2_000_000:
                self._compatible[left, right] = known
        return known

    def _test(self, left: int, right: int) -> bool:
        limit = sys.maxsize
        while True:
            joined = self.merged.get((left, right))
            if joined is not None and joined < limit:
                return False
            # Undo the later of the two merges next to the boundary; a merge of the same rank as the left one's
            # happens left to right.
            if left > right:
                limit = left
                if left not in self.split:
                    return True
                left = self.split[left][1]
                if left == limit:
                    return True
            else:
                limit = right + 1
                if right not in self.split:
                    if left not in self.split:
                        return True
                    limit = left
                    left = self.split[left][1]
                else:
                    right = self.split[right][0]

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.token_of.get(piece)
        if whole is not None and whole in self.reachable:
            return [whole]
        last = [-1] * (len(piece) + 1)
        for end in range(1, len(piece) + 1):
            node, at = self.suffixes, end
            while at:
                node = node.get(piece[at - 1])
                if node is None:
                    break
                at -= 1
                token = node.get(-1)
                if token is not None and (at == 0 or (last[at] >= 0 and self.compatible(last[at], token))):
                    last[end] = token
                    break
        out, end = [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]


class _Pieces(dict):
    """Ids of common pieces; others are encoded again each time."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(self) < KEPT_PIECES and len(piece) <= KEPT_LENGTH:
            self[piece] = ids
        return ids


class TextEncoder:
    """Encodes whole texts piece by piece."""

    def __init__(self, path: str):
        self.pieces = _Pieces(Encoder(path))
        self.findall = piece_pattern().findall

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens, whose strings are ordinary text; an empty or null text has no ids."""
        return list(itertools.chain.from_iterable(map(self.pieces.__getitem__, self.findall(text or ""))))

    def tokens(self) -> list[bytes]:
        """The bytes of each id."""
        by_id = {i: b for b, i in self.pieces.encoder.token_of.items()}
        return [by_id.get(i, b"") for i in range(max(by_id) + 1)]

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.pieces.__getitem__, self.findall(text or ""))))


@functools.cache
def text_encoder(name: str, folder: str = DEFAULT_FOLDER) -> TextEncoder:
    """One encoder per worker process."""
    return TextEncoder(os.path.join(folder, f"{name}.tiktoken"))
