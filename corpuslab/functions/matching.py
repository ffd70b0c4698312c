"""Comparing one question with one value for value linking: a small helper run on Arrow
batches of candidate pairs. What can be told from the texts it finds is tested in columns
(`operators.valuelink`)."""

from __future__ import annotations

import re
from bisect import bisect_left

# Fixed values.
SEPARATORS = "'\"()`,.?! "
STOP_WORDS = frozenset([
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've", "you'll",
    "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "she's",
    "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "that'll", "these", "those", "am", "is",
    "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did",
    "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until", "while", "of", "at",
    "by", "for", "with", "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now", "d", "ll",
    "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn", "didn't", "doesn",
    "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn", "isn't", "ma", "mightn",
    "mightn't", "mustn", "mustn't", "needn", "needn't", "shan", "shan't", "shouldn", "shouldn't", "wasn",
    "wasn't", "weren", "weren't", "won", "won't", "wouldn", "wouldn't",
])
COMMON_WORDS = frozenset({"no", "yes", "many"})
KEY_TERMS = frozenset({"id"})
# A span may go on this many characters behind the common part.
LOOK_AHEAD = 2
TOKEN = re.compile(f"[^{re.escape(SEPARATORS)}]+")


def fold_case(text: str) -> str:
    """Lower case character by character, so that places stay the same."""
    if text.isascii():
        return text.lower()
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def longest_common(s: str, v: str) -> tuple[int, int, int]:
    """(place in s, place in v, length) of the longest common part, earliest in s first, then in v.

    Grows the length while some part of v of that length occurs in s; the search itself
    is the built-in one. The same for values of any length.
    """
    size, at = 0, 0
    for i in range(len(v)):
        while i + size < len(v) and v[i : i + size + 1] in s:
            size, at = size + 1, i
    if not size:
        return 0, 0, 0
    starts: dict[int, int] = {}
    for i in range(at, len(v) - size + 1):
        place = s.find(v[i : i + size])
        if place >= 0:
            starts.setdefault(place, i)
    place = min(starts)
    return place, starts[place], size


class Words:
    """Where the words of a text, its runs without separators, begin and end."""

    def __init__(self, text: str):
        found = [m.span() for m in TOKEN.finditer(text)]
        self.begins, self.ends = [a for a, _ in found], [b for _, b in found]

    def span(self, start: int, end: int) -> tuple[int, int] | None:
        """The whole words that a common part [start, end) stands for, or None.

        It must begin where a word does, or between words, and end in a word that goes on for
        `LOOK_AHEAD` characters at most, or between words."""
        first, last = bisect_left(self.begins, start), bisect_left(self.begins, end) - 1
        inside = first > 0 and self.ends[first - 1] > start
        if inside or first > last:
            return None
        if self.ends[last] > end + LOOK_AHEAD:
            return None
        return self.begins[first], self.ends[last]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & rows.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / total length."""
    total = len(a) + len(b)
    if not total:
        return 1.0
    return (1.0 - (total - 2 * common_subsequence(a, b)) / total) * 100 / 100


def compared(question: str, folded: str, words: Words, value: str) -> tuple[str, str, float, int] | None:
    """(match, span of the question, ratio of span and value, length of the match), or None;
    `folded` is the question in folded case, `words` its words."""
    start, at, size = longest_common(folded, fold_case(value))
    span = words.span(start, start + size) if size else None
    if span is None or span[1] - span[0] <= 1:
        return None
    source = question[span[0] : span[1]]
    return value[at : at + size], source, indel_ratio(value.lower().strip(), source.lower().strip()), size
