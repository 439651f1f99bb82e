"""Where many tokens stand in texts, looked up for all positions of a batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Bytes looked at together, and numbers held of texts by tokens and of candidates by their bytes.
WINDOW, CELLS = 1 << 16, 4 << 20
#: Length of the beginnings that have tables, of those that every position is asked for first, and lengths behind a beginning that are told apart.
HEAD, FIRST, TOLD = 4, 3, 31


class Finder:
    """Distinct tokens of a-z, 0-9 and signs, to be found within runs of such characters, of two at least."""

    def __init__(self, tokens: list[str], signs: str, window: int = WINDOW) -> None:
        self.window = window
        self.tokens = [t.encode() for t in tokens]
        self.sizes = {len(t) for t in self.tokens}
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.plain, self.code = np.zeros(256, bool), np.zeros(256, np.int64)
        self.plain[list(PLAIN)] = True
        kinds = PLAIN + signs.encode()
        self.code[list(kinds)] = np.arange(1, len(kinds) + 1)
        self.base = len(kinds) + 1
        longest = int(min(HEAD, self.size.max(initial=1)))
        #: by length: the token that stands at a code, and what lengths tokens have that go on behind it
        self.exact = {n: np.full(self.base**n, -1, np.int32) for n in range(1, longest + 1)}
        self.further = {n: np.zeros(self.base**n, np.uint32) for n in range(1, longest + 1)}
        self.begins = np.zeros(self.base**FIRST, bool)  # whether a token may begin at characters of this code
        by_size: dict[int, list[int]] = {}
        for k, t in enumerate(self.tokens):
            at = 0
            for n, c in enumerate(t[:HEAD], 1):
                at = at * self.base + int(self.code[c])
                if n == len(t):
                    self.exact[n][at] = k
                else:
                    self.further[n][at] |= 1 << min(len(t) - n - 1, TOLD)
                if n == min(len(t), FIRST):
                    wide = self.base ** (FIRST - n)
                    self.begins[at * wide : (at + 1) * wide] = True
            if len(t) > HEAD:
                by_size.setdefault(len(t), []).append(k)
        self.long = {}
        for n, some in by_size.items():
            some = sorted(some, key=lambda k: self.tokens[k])
            self.long[n] = np.array([self.tokens[k] for k in some], f"S{n}"), np.array(some, np.int32)

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, token, whole) in order: the tokens that each text holds, and whether one stands there with no letter or digit before or behind it."""
        got = list(self._blocks(texts.cast(pa.large_string())))
        return tuple(np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def _blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        if not len(texts) or not self.tokens:
            return
        _, ends, body = texts.buffers()
        offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.empty(0, np.uint8)
        n = len(self.tokens)
        rows = max(1, CELLS // n)
        for row in range(0, len(texts), rows):
            own = offsets[row : row + rows + 1]
            some, whole = np.zeros((len(own) - 1) * n, bool), np.zeros((len(own) - 1) * n, bool)
            for low in range(int(own[0]), int(own[-1]), self.window):
                for at, token in self._hits(data, low, min(low + self.window, int(own[-1])), int(own[-1])):
                    text = np.searchsorted(own, at, "right") - 1
                    behind, start, end = at + self.size[token], own[text], own[text + 1]
                    before, after = np.where(at > start, data[at - 1], 0), np.where(behind < end, data[np.minimum(behind, len(data) - 1)], 0)
                    good = (behind <= end) & ((self.size[token] > 1) | (self.code[before] > 0) | (self.code[after] > 0))
                    cell = text * n + token
                    some[cell[good]] = True
                    whole[cell[good & ~self.plain[before] & ~self.plain[after]]] = True
            cell = np.flatnonzero(some)
            yield cell // n + row, cell % n, whole[cell]

    def _hits(self, data: np.ndarray, low: int, high: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, token) of tokens that begin from low to high and may reach up to end."""
        codes = np.zeros(high - low + HEAD, np.int64)
        part = self.code[data[low : min(end, high + HEAD)]]
        codes[: len(part)] = part
        first = codes[: high - low]
        for n in range(1, FIRST):
            first = first * self.base + codes[n : n + high - low]
        at = np.flatnonzero(self.begins[first])
        head = more = np.zeros(len(at), np.int64)
        for n, exact in self.exact.items():
            head = head * self.base + codes[at + (n - 1)]
            if n in self.sizes:
                token = exact[head]
                hit = np.flatnonzero(token >= 0)
                yield at[hit] + low, token[hit]
            more = self.further[n][head]
            if n >= FIRST:
                on = np.flatnonzero(more)
                at, head, more = at[on], head[on], more[on]
        for n, (words, number) in self.long.items():
            begun = at[(more >> min(n - HEAD - 1, TOLD) & 1 > 0) & (at + low + n <= end)] + low
            for k in range(0, len(begun), max(1, CELLS // n)):
                some = begun[k : k + max(1, CELLS // n)]
                stands = data[some[:, None] + np.arange(n)].view(f"S{n}").ravel()
                place = np.minimum(np.searchsorted(words, stands), len(words) - 1)
                hit = words[place] == stands
                yield some[hit], number[place[hit]]
