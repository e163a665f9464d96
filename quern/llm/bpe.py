"""Byte-level BPE in two exact ways: backtracking over longest matches, and a heap of merges.

Both take a rank file (a token's bytes in base64 and its rank, which is its id). A text is first split
by the tokenizer's pattern; as a space before a non-blank always starts a piece, whole blank-separated
words are encoded once and kept, which is what makes a pass over a corpus cheap.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array

import ahocorasick
import regex

#: Fixed value: the pattern that the byte-level tokenizers split texts with before any merge.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept at most in a worker's memory; the store is emptied when full, so results never depend on it.
STORE = 300_000
_NEVER = 1 << 60
_LOADED: dict[tuple[str, str], object] = {}


class Ranks:
    """Vocabulary of a rank file, with what splitting a text needs."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.token = {rank: token for token, rank in self.rank.items()}
        self.pieces = regex.compile(PATTERN).findall


def words(text: str) -> list[str]:
    """Blank-separated parts whose concatenation, each but the first after one space, is ``text``.

    Every part but the first starts with a non-blank, so a piece of the pattern starts at each joint.
    """
    parts = text.split(" ")
    if all(part and not part[0].isspace() for part in parts[1:]):
        return parts
    whole = [parts[0]]
    for part in parts[1:]:
        if part and not part[0].isspace():
            whole.append(part)
        else:
            whole[-1] = f"{whole[-1]} {part}"
    return whole


class Backtracking(Ranks):
    """Encoder in linear time: longest matches of one automaton, checked for compatible neighbours."""

    def __init__(self, path: str):
        super().__init__(path)
        self.matches = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.rank.items():
            self.matches.add_word(token.decode("latin-1"), rank)
        self.matches.make_automaton()
        self.size = {rank: len(token) for token, rank in self.rank.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.prefix: dict[int, int | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.kept: dict[str, bytes] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made ``token``; None for a single byte."""
        if token not in self.parts:
            text = self.token[token]
            symbols = [text[i : i + 1] for i in range(len(text))]
            while len(symbols) > 2:
                at = min(range(len(symbols) - 1), key=lambda i: self.rank.get(symbols[i] + symbols[i + 1], _NEVER))
                if self.rank.get(symbols[at] + symbols[at + 1], _NEVER) >= token:
                    raise ValueError(f"rank {token} can't be reached by merges")
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.parts[token] = (self.rank[symbols[0]], self.rank[symbols[1]]) if len(symbols) == 2 else None
        return self.parts[token]

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of ``token``."""
        if token not in self.prefix:
            text = self.token[token]
            self.prefix[token] = next((self.rank[text[:k]] for k in range(len(text) - 1, 0, -1) if text[:k] in self.rank), None)
        return self.prefix[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as neighbours.

        Merges are undone from the last one back. While two edge symbols faced each other, a merge of the
        two would have gone first if its rank was below that of the merge that took the left symbol, or
        not above that of the merge that took the right one (equal ranks merge from left to right).
        """
        key = (left, right)
        if key in self.fits:
            return self.fits[key]
        left_taken = right_taken = _NEVER
        answer = True
        while True:
            crossing = self.rank.get(self.token[left] + self.token[right], _NEVER)
            if crossing < left_taken and crossing <= right_taken and crossing != _NEVER:
                answer = False
                break
            undone = self.halves(left) if left > right else self.halves(right)
            if undone is not None and left > right:
                left_taken, left = left, undone[1]
            elif undone is not None:
                right_taken, right = right, undone[0]
            elif (undone := self.halves(left)) is not None:
                left_taken, left = left, undone[1]
            elif (undone := self.halves(right)) is not None:
                right_taken, right = right, undone[0]
            else:
                break
        if len(self.fits) > 4 * STORE:
            self.fits.clear()
        self.fits[key] = answer
        return answer

    def piece(self, raw: bytes) -> list[int]:
        """Ids of one piece of the pattern."""
        whole = self.rank.get(raw)
        if whole is not None and self._made(whole):
            return [whole]
        end = len(raw)
        longest = [-1] * end
        size = self.size
        for last, token in self.matches.iter(raw.decode("latin-1")):
            start = last + 1 - size[token]
            if longest[start] < 0 or size[longest[start]] < size[token]:
                longest[start] = token
        ids: list[int] = []
        closed: set[int] = set()
        at, token = 0, longest[0]
        while True:
            if token is None:  # nothing more can start here
                closed.add(at)
                token = ids.pop()
                at -= size[token]
                token = self.shorter(token)
                continue
            after = at + size[token]
            if after not in closed and (not ids or self.compatible(ids[-1], token)):
                ids.append(token)
                if after == end:
                    return ids
                at, token = after, longest[after]
            else:
                token = self.shorter(token)

    def _made(self, token: int) -> bool:
        """Whether the merges of the token's own bytes make it."""
        try:
            return self.halves(token) is None or True
        except ValueError:
            return False

    def word(self, text: str) -> bytes:
        """Ids of a part of a text, as bytes of 32-bit integers."""
        found = self.kept.get(text)
        if found is None:
            ids = array("i")
            for piece in self.pieces(text):
                ids.extend(self.piece(piece.encode("utf-8")))
            found = ids.tobytes()
            if len(self.kept) >= STORE:
                self.kept.clear()
            if len(text) <= 200:
                self.kept[text] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a text, as bytes of 32-bit integers; nothing for an empty or null text."""
        if not text:
            return b""
        first, *rest = words(text)
        get, out = self.kept.get, [self.word(first)]
        for part in rest:
            spaced = f" {part}"
            out.append(get(spaced) or self.word(spaced))
        return b"".join(out)


class Heap(Ranks):
    """Token counts by linked symbols and a priority queue of merges."""

    def __init__(self, path: str):
        super().__init__(path)
        self.kept: dict[str, int] = {}
        self.counted: dict[str, int] = {}

    def survivors(self, raw: bytes) -> int:
        """Symbols that are left of a piece when no merge is possible any more."""
        count = len(raw)
        if count < 2:
            return count
        rank = self.rank
        after = list(range(1, count + 1))
        before = list(range(-1, count - 1))
        symbol = [raw[i : i + 1] for i in range(count)]
        queue = []
        for i in range(count - 1):
            order = rank.get(symbol[i] + symbol[i + 1])
            if order is not None:
                queue.append((order, i, symbol[i] + symbol[i + 1]))
        heapq.heapify(queue)
        end = count
        while queue:
            _, i, joined = heapq.heappop(queue)
            j = after[i]
            if not symbol[i] or j >= end or symbol[i] + symbol[j] != joined:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = joined, b""
            after[i] = after[j]
            if after[j] < end:
                before[after[j]] = i
                order = rank.get(joined + symbol[after[j]])
                if order is not None:
                    heapq.heappush(queue, (order, i, joined + symbol[after[j]]))
            if before[i] >= 0:
                order = rank.get(symbol[before[i]] + joined)
                if order is not None:
                    heapq.heappush(queue, (order, before[i], symbol[before[i]] + joined))
            count -= 1
        return count

    def word(self, text: str) -> int:
        found = self.kept.get(text)
        if found is None:
            found = 0
            for piece in self.pieces(text):
                n = self.counted.get(piece)
                if n is None:
                    n = self.survivors(piece.encode("utf-8"))
                    if len(self.counted) >= STORE:
                        self.counted.clear()
                    if len(piece) <= 60:
                        self.counted[piece] = n
                found += n
            if len(self.kept) >= STORE:
                self.kept.clear()
            if len(text) <= 200:
                self.kept[text] = found
        return found

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for an empty or null text."""
        if not text:
            return 0
        first, *rest = words(text)
        get, total = self.kept.get, self.word(first)
        for part in rest:
            spaced = f" {part}"
            total += get(spaced) or self.word(spaced)
        return total


def load(kind: type, folder: str, name: str):
    """One model a worker process."""
    key = (kind.__name__, os.path.join(folder, f"{name}.tiktoken"))
    if key not in _LOADED:
        _LOADED[key] = kind(key[1])
    return _LOADED[key]
