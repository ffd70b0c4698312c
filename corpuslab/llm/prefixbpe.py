"""Byte-pair encoding by dynamic programming over prefixes.

A text is a string of symbols. The encoding of every prefix has one last token, and a token
`t` that is a suffix of the prefix is that one exactly if the encoding of what is before it
ends in a token which `t` may follow: whether two tokens may stand side by side depends on
these two alone. So each position needs the tokens that end there (an automaton over the
vocabulary with suffix links gives them) and one test for each until one holds. Back-pointers
give the ids, and a counter beside them the token count of every prefix.
"""

from __future__ import annotations

import heapq
from itertools import chain

import ahocorasick
import numpy as np

from corpuslab.llm.worker import Bounded

PAIRS_KEPT = 2_000_000
#: Pair tests that `encode_many` remembers, by place: a power of two.
PAIR_SLOTS = 1 << 20
END = "\x01"  # stands behind the last symbol of a word where the vocabulary marks word ends


class PrefixBPE:
    """`texts`: the symbol string of each mergeable token by id; `order`: its rank (None: a
    base symbol); `join(a, b)`: the token that the neighbours a and b merge to, or None."""

    def __init__(self, texts: dict[int, str], order: dict[int, float | None], join, parts):
        self.texts, self.order, self.join = texts, order, join
        self.birth: dict[int, float] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.may_follow = Bounded(self._may_follow, PAIRS_KEPT)
        automaton = ahocorasick.Automaton()
        for token in sorted(texts, key=lambda t: (order[t] is not None, order[t] or 0, len(texts[t]))):
            if order[token] is None:
                self.birth[token] = float("-inf")
            else:
                pair = parts(token)
                if pair is None or pair[0] not in self.birth or pair[1] not in self.birth:
                    continue  # merges never lead to it
                self.left[token], self.right[token] = pair
                self.birth[token] = max(order[token], self.birth[pair[0]], self.birth[pair[1]])
                if not self._apart(*pair, below=order[token]):
                    del self.birth[token], self.left[token], self.right[token]
                    continue  # its own symbols are merged to something else
            automaton.add_word(texts[token], (token, len(texts[token])))
        automaton.make_automaton()
        self.automaton = automaton

    def _apart(self, a: int, b: int, below: float | None = None) -> bool:
        """Whether no merge across the border of a and b comes before those that made them.

        Goes back in time: the younger of the two border tokens is undone (of two of one rank
        the right one, as the leftmost merge comes first), and each pair that meets at the
        border must not merge earlier than one of them is used up. `below`: a and b
        themselves merge at that rank, and this is as it should be."""
        birth, order, join = self.birth, self.order, self.join
        dies_a = dies_b = float("inf")
        first = below is not None
        while True:
            met = None if first else join(a, b)
            first = False
            if met is not None and order[met] < dies_a and order[met] <= dies_b:
                return False
            if birth[a] > birth[b]:
                dies_a, a = birth[a], self.right[a]
            elif birth[b] != float("-inf"):
                dies_b, b = birth[b], self.left[b]
            else:
                return True

    def _may_follow(self, pair: tuple[int, int]) -> bool:
        return self._apart(*pair)

    def table(self, symbols: str) -> tuple[list, list, list]:
        """For every prefix: its last token (-1: none), where that begins, its token count."""
        n = len(symbols)
        last, begin, count = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        may_follow = self.may_follow
        for at, (token, size) in self.automaton.iter(symbols):
            at += 1
            if last[at] >= 0:
                continue
            start = at - size
            if start == 0 or (last[start] >= 0 and may_follow[last[start], token]):
                last[at], begin[at], count[at] = token, start, count[start] + 1
        return last, begin, count

    def encode(self, symbols: str) -> list[int]:
        """Exact ids of the whole string, by its back-pointers."""
        if self.automaton is None:
            return self.encode_many(symbols)[0].tolist()
        last, begin, _ = self.table(symbols)
        ids, at = [], len(symbols)
        while at:
            if last[at] < 0:
                raise ValueError("a symbol is not in the vocabulary")
            ids.append(last[at])
            at = begin[at]
        return ids[::-1]

    def _follows(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Pair tests for many pairs. Each pair has one place in a table of fixed size, where it takes that of the one before."""
        if not hasattr(self, "pair_keys"):
            self.pair_keys, self.pair_fits = np.full(PAIR_SLOTS, -1, np.int64), np.zeros(PAIR_SLOTS, bool)
        key = (last << 32) | token
        place = ((last * 0x9E3779B1) ^ (token * 0x85EBCA6B)) >> 9 & (PAIR_SLOTS - 1)
        out = self.pair_fits[place]
        new = np.flatnonzero(self.pair_keys[place] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            fits = np.fromiter((self._apart(int(k) >> 32, int(k) & 0xFFFFFFFF) for k in keys), bool, len(keys))
            out[new] = fits[back]
            at = place[new][first]
            self.pair_keys[at], self.pair_fits[at] = keys, fits
        return out

    def encode_many(self, joined: str) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of many strings, joined by NUL, one after the other, and how many each has.

        The same dynamic program as `table`, for all strings together: one pass of an automaton finds the
        tokens that end at each place, then prefixes are settled in the order of their lengths. A string may be empty."""
        if not hasattr(self, "token_at"):
            # As `automaton`, which goes, with bare ids, of which a flat array is quickly made.
            self.token_at, self.size = ahocorasick.Automaton(ahocorasick.STORE_INTS), np.zeros(max(self.texts) + 1, np.int64)
            for text, (token, size) in self.automaton.items():
                self.token_at.add_word(text, token)
                self.size[token] = size
            self.token_at.make_automaton()
            self.automaton = None
        stops = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 0)
        start = np.concatenate([[0], stops + 1])
        length = np.concatenate([stops, [len(joined)]]) - start
        hits = list(self.token_at.iter(joined))
        end, token = np.fromiter(chain.from_iterable(hits), np.int64, 2 * len(hits)).reshape(-1, 2).T
        end, size = end + 1, self.size[token]
        owner = np.searchsorted(start, end, "right") - 1
        prefix = end - start[owner]
        order = np.argsort(prefix, kind="stable")
        end, token, begin, prefix = end[order], token[order], (end - size)[order], prefix[order]
        at_start = begin == start[owner[order]]
        # The last token of the prefix that ends at a place of the joined string; -1: none.
        last, back = np.full(int((length + 1).sum()) + 1, -1, np.int64), np.zeros(int((length + 1).sum()) + 1, np.int64)
        steps = np.flatnonzero(np.diff(prefix, prepend=-1, append=-1)) if len(prefix) else []
        for a, b in zip(steps, steps[1:]):
            fits = at_start[a:b].copy()
            before = last[begin[a:b]]
            open_ = np.flatnonzero(~fits & (before >= 0))
            fits[open_] = self._follows(before[open_], token[a:b][open_])
            last[end[a:b][fits]], back[end[a:b][fits]] = token[a:b][fits], begin[a:b][fits]
        rows, at = np.flatnonzero(length > 0), (start + length)[length > 0]
        found = []
        while len(rows):
            if (last[at] < 0).any():
                raise ValueError("a symbol is not in the vocabulary")
            found.append((rows, last[at]))
            at = back[at]
            more = at > start[rows]
            rows, at = rows[more], at[more]
        count = np.zeros(len(start), np.int64)
        for rows, _ in found:
            count[rows] += 1
        place = np.cumsum(count) - 1
        ids = np.empty(int(count.sum()), np.int64)
        for step, (rows, tokens) in enumerate(found):
            ids[place[rows] - step] = tokens
        return ids, count


def merge_by_rank(symbols: list[int], order, join) -> list[int]:
    """Plain merging, always the pair of the lowest rank and of these the leftmost. For tests."""
    at = list(symbols)
    prev, after = list(range(-1, len(at) - 1)), list(range(1, len(at) + 1))
    heap = []

    def offer(i):
        j = after[i]
        if i >= 0 and j < len(at) and (t := join(at[i], at[j])) is not None:
            heapq.heappush(heap, (order[t], i, j, at[i], at[j], t))

    for i in range(len(at) - 1):
        offer(i)
    while heap:
        _, i, j, a, b, t = heapq.heappop(heap)
        if at[i] != a or j >= len(at) or at[j] != b or after[i] != j:
            continue
        at[i], at[j] = t, None
        after[i] = after[j]
        if after[j] < len(at):
            prev[after[j]] = i
        if prev[i] >= 0:
            offer(prev[i])
        offer(i)
    return [t for t in at if t is not None]
