"""similarity() of all pairs of two blocks of stems, in arrays: the numbers that it gives stem by stem.

Stems that differ only in a number at their end share a head. Where no head of two blocks holds a digit, equal characters
are of two heads or of two numbers, so what heads share is found once for each two heads, and numbers are compared by
themselves. Elsewhere whole forms are heads and their numbers empty."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

from .similarity import SIMILAR, _data, normal, pairs, similarity_from

#: From this length on SequenceMatcher leaves out popular characters, so such texts are left to it.
_LONG = 200
#: Characters that one word of bits holds.
_WORD = 64
#: Second heads bounded at once, cells of one table of run lengths, pairs of texts or rows at once.
_STRIPE, _CELLS, _ROWS = 256, 6_000_000, 200_000


def _coded(forms: list[str], signs: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and characters as numbers above 0 for the forms that are short."""
    length = np.array([len(x) for x in forms], dtype=np.int64)
    codes = np.zeros((len(forms), max((n for n in length.tolist() if n < _LONG), default=0) or 1), dtype=np.uint8)
    for i, form in enumerate(forms):
        if len(form) < _LONG:
            codes[i, : len(form)] = [signs[c] for c in form]
    return length, codes


def _groups(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each group begins in a list that is sorted by group, and its size."""
    many = np.bincount(of, minlength=n)
    return np.cumsum(many) - many, many


class Heads:
    """Different heads: their characters, how many of each, pairs of words."""

    def __init__(self, keys: list[tuple[str, bool]], signs: dict):
        self.forms = [form for form, _ in keys]
        self.length, self.codes = _coded(self.forms, signs)
        self.pairs = [pairs(form.rpartition(" ")[0] if numbered else form) for form, numbered in keys]
        self.numbered = np.array([numbered for _, numbered in keys], dtype=bool)
        self.n_pairs = np.array([len(x) for x in self.pairs], dtype=np.int64) + self.numbered
        self.with_pair = defaultdict(list)
        self.counts = np.zeros((len(signs), len(keys)), dtype=np.uint8 if self.length.max(initial=0) < 256 else np.uint32)
        self.bits = np.zeros((len(signs) + 1, len(keys)), dtype=np.uint64)
        for i, form in enumerate(self.forms):
            code = np.array([signs[c] for c in form], dtype=np.int64)
            self.counts[:, i] = np.bincount(code, minlength=len(signs) + 1)[1:]
            if len(form) <= _WORD:
                np.bitwise_or.at(self.bits[:, i], code, np.uint64(1) << np.arange(len(form), dtype=np.uint64))
            for pair in self.pairs[i]:
                self.with_pair[pair].append(i)


class Stems:
    """Different texts with their rows, grouped by heads: numbers at their ends, stated data."""

    def __init__(self, texts: list[str], rank: np.ndarray, form_of: dict, split: bool, signs: dict, own: dict, said: tuple[dict, ...]):
        place: dict[str, int] = {}
        forms, known = [], {}
        node = np.array([place.setdefault(x, len(place)) for x in texts], dtype=np.int64)
        self.texts, head, self.own = list(place), [], []
        self.data = np.zeros((len(said), len(place)), dtype=np.int64)
        self.after = np.zeros(len(place), dtype=np.int64)
        for i, text in enumerate(self.texts):
            form = form_of[text]
            before = form.rstrip("0123456789") if split else form
            number = form[len(before) :]
            forms.append(form)
            head.append(known.setdefault((before, number != ""), len(known)))
            self.after[i] = len(number)
            words = tuple(form.split(" ")[-2:])
            self.own.append(own.setdefault(words, len(own) + 1) if number else 0)  # the pair of words that holds the number
            sets, numbers, operators = _data(text)
            for k, stated in enumerate((tuple(sorted(sets.values())), frozenset(numbers.items()), frozenset(operators.items()))):
                if stated:
                    self.data[k, i] = said[k].setdefault(stated, len(said[k]) + 1)
        self.own = np.array(self.own, dtype=np.int64)
        self.length, self.codes = _coded(forms, signs)
        self.digits = np.full((len(forms), min(_WORD, int(self.after.max()))), 10, dtype=np.int64)
        self.bits = np.zeros((len(forms), 11), dtype=np.uint64)
        for i in np.nonzero((self.after > 0) & (self.after <= _WORD))[0].tolist():
            for t, digit in enumerate(map(int, forms[i][-self.after[i] :])):
                self.digits[i, t] = digit
                self.bits[i, digit] |= np.uint64(1 << t)
        self.rows, self.rank = np.lexsort((rank, node)), rank
        self.first, self.many = _groups(node, len(place))
        self.low, self.high = rank[self.rows[self.first]], rank[self.rows[self.first + self.many - 1]]
        self.head = np.array(head, dtype=np.int64)
        self.heads = Heads(list(known), signs)
        self.members = np.argsort(self.head, kind="stable")
        self.head_first, self.head_many = _groups(self.head, len(known))
        self.head_low = np.minimum.reduceat(self.low[self.members], self.head_first)
        self.head_high = np.maximum.reduceat(self.high[self.members], self.head_first)
        self.head_after = np.maximum.reduceat(self.after[self.members], self.head_first)


def _shared_pairs(one: Heads, other: Heads, at: np.ndarray) -> np.ndarray:
    """How many pairs of words each head of one shares with each of some heads of the other."""
    shared = np.zeros((len(one.forms), len(at)), dtype=np.int64)
    here = defaultdict(list)
    for place, v in enumerate(at.tolist()):
        for pair in other.pairs[v]:
            if pair in one.with_pair:
                here[pair].append(place)
    for pair, places in here.items():
        shared[np.ix_(one.with_pair[pair], places)] += 1
    return shared


def _most_shared(one: Heads, other: Heads, at: np.ndarray, need: np.ndarray) -> np.ndarray:
    """At least as many characters as SequenceMatcher matches of heads: the characters they share, and where these are
    as many as needed, the length of their longest common subsequence.

    Its bit vectors (one for each head of one) are kept for each prefix, and the heads are taken in order, so that a prefix
    is walked once.
    """
    shared = np.zeros(need.shape, dtype=one.counts.dtype if one.counts.dtype == other.counts.dtype else np.uint32)
    for a, b in zip(one.counts, other.counts):
        if a.any() and b[at].any():
            shared += np.minimum(a[:, None], b[at][None, :])
    can = (shared >= need).any(axis=0)
    most = shared.astype(np.int64)
    fits = one.length <= _WORD
    kept = np.where(one.length >= _WORD, ~np.uint64(0), (np.uint64(1) << np.minimum(one.length, _WORD - 1).astype(np.uint64)) - np.uint64(1))
    states, before = [np.full(len(one.forms), ~np.uint64(0))], ""
    for place in sorted((p for p in range(len(at)) if can[p] and other.length[at[p]] < _LONG), key=lambda p: other.forms[at[p]]):
        form = other.forms[at[place]]
        same = next((i for i, (x, y) in enumerate(zip(form, before)) if x != y), min(len(form), len(before)))
        del states[same + 1 :]
        for code in other.codes[at[place], same : len(form)].tolist():
            state = states[-1]
            met = state & one.bits[code]
            states.append((state + met) | (state - met))
        before = form
        most[fits, place] = np.bitwise_count(~states[-1] & kept)[fits]
    return most


def matches(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Characters that SequenceMatcher(None, x[u], y[v]) matches, for texts as rows of codes above 0 and their lengths."""
    return _matches(x, y, u, v, _until(nx[u], ny[v]))


def _until(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Item, begin and end in x, begin and end in y: from the beginning on."""
    zero = np.zeros(len(n), dtype=np.int64)
    return np.stack([np.arange(len(n)), zero, n, zero, m])


def _matches(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, open_: np.ndarray) -> np.ndarray:
    """The same within parts of the texts (see _until).

    The longest run of equal characters, of those the first in x and then in y, and so on left and right of it.
    """
    total = np.zeros(len(u), dtype=np.int64)
    open_ = open_[:, (open_[1] < open_[2]) & (open_[3] < open_[4])]
    while open_.shape[1]:
        wide, high = open_[2] - open_[1], open_[4] - open_[3]
        open_ = open_[:, np.lexsort((high, wide))]
        after, start = [], 0
        while start < open_.shape[1]:
            end = min(start + 8192, open_.shape[1])
            a, b = (int((open_[k + 1, start:end] - open_[k, start:end]).max()) for k in (1, 3))
            end = min(end, start + max(1, _CELLS // (a * b)))
            item, alo, ahi, blo, bhi = part = open_[:, start:end]
            a, b = int((ahi - alo).max()), int((bhi - blo).max())
            i, j, k = _longest(x, y, u[item], v[item], part, a, b)
            np.add.at(total, item, k)
            left, right = (k > 0) & (i > alo) & (j > blo), (k > 0) & (i + k < ahi) & (j + k < bhi)
            after.append(np.stack([item, alo, i, blo, j])[:, left])
            after.append(np.stack([item, i + k, ahi, j + k, bhi])[:, right])
            start = end
        open_ = np.concatenate(after, axis=1)
    return total


def _longest(x, y, u, v, part, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the longest runs of equal characters begin in the parts of x[u] and y[v], and their lengths."""
    _, alo, ahi, blo, bhi = part
    one, other = np.zeros((a, len(u)), dtype=np.uint8), np.zeros((b, len(u)), dtype=np.uint8)
    for row, texts, at, low, high, none in ((one, x, u, alo, ahi, 0), (other, y, v, blo, bhi, 255)):
        flat, begin, last = texts.reshape(-1), at * texts.shape[1] + low, high - low
        for i in range(len(row)):
            row[i] = np.where(i < last, flat.take(begin + i, mode="clip"), none)
    runs = np.zeros((a, b, len(u)), dtype=np.uint8)
    best, end = np.zeros(len(u), dtype=np.uint8), np.zeros(len(u), dtype=np.int64)
    for i in range(a):
        same = (other == one[i]).view(np.uint8)
        runs[i, 0] = same[0]
        if i:
            np.add(runs[i - 1, :-1], 1, out=runs[i, 1:])
            runs[i, 1:] *= same[1:]
        else:
            runs[i, 1:] = same[1:]
        longest = runs[i].max(axis=0)
        np.copyto(end, i, where=longest > best)
        np.maximum(best, longest, out=best)
    ends = runs[end, :, np.arange(len(u))].argmax(axis=1)
    k = best.astype(np.int64)
    return alo + end - k + 1, blo + ends - k + 1, k


class _First:
    """Of pairs of heads, what their texts' alignment begins with: the longest run of the heads, their common end, and what
    is matched before either."""

    def __init__(self, one: Heads, other: Heads, g: np.ndarray, h: np.ndarray):
        n, m = one.length[g], other.length[h]
        long = (n >= _LONG) | (m >= _LONG)  # their texts are as well, and not aligned here
        n, m = np.where(long, 0, n), np.where(long, 0, m)
        zero = np.zeros(len(g), dtype=np.int64)
        self.i, self.j, self.run, self.end = zero.copy(), zero.copy(), zero.copy(), zero.copy()
        where, start = _until(n, m), 0
        while start < len(g):
            part = slice(start, start + max(1, min(8192, _CELLS // max(1, one.codes.shape[1] * other.codes.shape[1]))))
            high, wide = max(1, int(n[part].max())), max(1, int(m[part].max()))
            self.i[part], self.j[part], self.run[part] = _longest(one.codes, other.codes, g[part], h[part], where[:, part], high, wide)
            start = part.stop
        alike = np.ones(len(g), dtype=bool)
        for back in range(1, int(np.minimum(n, m).max(initial=0)) + 1):
            alike &= (back <= n) & (back <= m)
            alike &= one.codes[g, np.maximum(n - back, 0)] == other.codes[h, np.maximum(m - back, 0)]
            self.end += alike
        before = lambda i, j: _matches(one.codes, other.codes, g, h, _until(i, j))
        self.before_run, self.before_end = before(self.i, self.j), before(n - self.end, m - self.end)


def _matched(first: Stems, second: Stems, u: np.ndarray, v: np.ndarray, known: _First, pair: np.ndarray) -> np.ndarray:
    """matches() of whole texts, where what heads share is known."""
    n, m = first.length[u], second.length[v]
    a, b, p, q = n - first.after[u], m - second.after[v], first.after[u], second.after[v]
    alike, same = np.ones(len(u), dtype=bool), np.zeros(len(u), dtype=np.int64)
    for t in range(int(np.minimum(p, q).max(initial=0))):
        alike &= (t < p) & (t < q)
        alike &= first.codes[u, np.minimum(a + t, n - 1)] == second.codes[v, np.minimum(b + t, m - 1)]
        same += alike
    run, end, i, j = known.run[pair], known.end[pair], known.i[pair], known.j[pair]
    over = np.where(end > 0, end + same, 0)  # the run over the end of both heads
    ahead = (i < a - end) | ((i == a - end) & (j <= b - end))
    by_run = (run > over) | ((run == over) & ahead)
    longest = np.maximum(run, over)
    whole = np.minimum(p, q) > longest  # a run within the numbers can be longer
    longest[whole] = 0
    total = np.where(whole, 0, longest + np.where(by_run, known.before_run[pair], known.before_end[pair]))
    low = np.where(whole, 0, np.where(by_run, i + run, a + same)), np.where(whole, 0, np.where(by_run, j + run, b + same))
    return total + _matches(first.codes, second.codes, u, v, np.stack([np.arange(len(u)), low[0], n, low[1], m]))


def near(texts: tuple[list[str], list[str] | None], ranks: tuple[np.ndarray, np.ndarray | None], threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of rows of two blocks, or of one block with itself where the other is None, that are similar: whether the row of
    lower rank is of the second block, its place, the other's place, similarity, whether they are too similar."""
    forms = {x: normal(x) for x in {x for side in texts if side is not None for x in side}}
    split = not any(re.search("[0-9]", head) for head in {form.rstrip("0123456789") for form in forms.values()})
    signs = {c: i + 1 for i, c in enumerate(sorted(set("".join(forms.values()))))}
    numbers: tuple = ({}, ({}, {}, {}))  # of pairs of words and of stated data
    alone = texts[1] is None
    if not texts[0] or (not alone and not texts[1]):
        return
    one = Stems(texts[0], ranks[0], forms, split, signs, *numbers)
    other = one if alone else Stems(texts[1], ranks[1], forms, split, signs, *numbers)
    least = threshold - 1e-6
    x, y = one.heads, other.heads
    for start in range(0, len(y.forms), _STRIPE):
        at = np.arange(start, min(start + _STRIPE, len(y.forms)))
        after = np.minimum(one.head_after[:, None], other.head_after[at][None, :])
        need = np.ceil(least * (x.length[:, None] + y.length[at][None, :] + 2 * after) / 2).astype(np.int64) - after
        most = _most_shared(x, y, at, need)
        shared = _shared_pairs(x, y, at)
        best = shared + (x.numbered[:, None] & y.numbered[at][None, :])
        able = (most >= need) | (best / np.maximum(1, x.n_pairs[:, None] + y.n_pairs[at][None, :] - best) >= least)
        g, h = np.nonzero(np.triu(able, -start) if alone else able)
        most, aligns, shared, h = most[g, h], (most >= need)[g, h], shared[g, h], at[h]
        for first, second, a, b, flipped in ((one, other, g, h, False), (other, one, h, g, True)):
            wanted = first.head_low[a] < second.head_high[b]
            if alone and flipped:
                wanted &= a != b  # both orders of two texts of one head come with the first
            yield from _found(first, second, a[wanted], b[wanted], most[wanted], aligns[wanted], shared[wanted], threshold, flipped and not alone)


def _expanded(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of pairs of groups (where they begin, their sizes), all pairs of members, some at a time: pair, place, place."""
    size = first[1] * second[1]
    until = np.cumsum(size)
    if len(until) and until[-1] == len(until) <= _ROWS:
        yield np.arange(len(until)), first[0], second[0]
        return
    for start in range(0, int(until[-1]) if len(until) else 0, _ROWS):
        end = min(start + _ROWS, int(until[-1]))
        some = np.arange(np.searchsorted(until, start, side="right"), np.searchsorted(until, end - 1, side="right") + 1)
        pair = np.repeat(some, np.minimum(until[some], end) - np.maximum(until[some] - size[some], start))
        nth, wide = np.arange(start, end) - (until - size)[pair], second[1][pair]
        yield pair, first[0][pair] + nth // wide, second[0][pair] + nth % wide


def _most_digits(first: Stems, second: Stems, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The longest common subsequences of the numbers at texts' ends, or more."""
    state, bits, row = np.full(len(u), ~np.uint64(0)), first.bits.reshape(-1), u * 11
    for digits in second.digits.T:
        met = state & bits[row + digits[v]]
        state = (state + met) | (state - met)
    p, q = first.after[u], second.after[v]
    kept = ~np.uint64(0) >> np.clip(_WORD - p, 0, _WORD - 1).astype(np.uint64)
    return np.where((p <= _WORD) & (q <= _WORD), np.minimum(np.bitwise_count(~state & kept), p), np.minimum(p, q))


def _found(first: Stems, second: Stems, g, h, most, aligns, shared, threshold: float, flipped: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of the texts of heads g, h that reach the threshold, each row of the first with those of the second behind it."""
    least = threshold - 1e-6
    known = _First(first.heads, second.heads, g[aligns], h[aligns])
    numbered = np.cumsum(aligns) - 1
    for pair, i, j in _expanded((first.head_first[g], first.head_many[g]), (second.head_first[h], second.head_many[h])):
        u, v = first.members[i], second.members[j]
        wanted = (first.low[u] < second.high[v]) & (first.length[u] > 0) & (second.length[v] > 0)
        pair, u, v = pair[wanted], u[wanted], v[wanted]
        both = shared[pair] + ((first.own[u] > 0) & (first.own[u] == second.own[v]))
        value = both / np.maximum(1, first.heads.n_pairs[g[pair]] + second.heads.n_pairs[h[pair]] - both)
        sizes = first.length[u] + second.length[v]
        can = aligns[pair] & (value < 1) & (2 * (most[pair] + np.minimum(first.after[u], second.after[v])) >= least * sizes)
        long = (first.length[u] >= _LONG) | (second.length[v] >= _LONG)
        short = np.nonzero(can & ~long)[0]
        short = short[2 * (most[pair[short]] + _most_digits(first, second, u[short], v[short])) >= least * sizes[short]]
        if len(short):
            matched = _matched(first, second, u[short], v[short], known, numbered[pair[short]])
            value[short] = np.maximum(value[short], 2.0 * matched / sizes[short])
        for k in np.nonzero(can & long)[0].tolist():
            value[k] = max(value[k], similarity_from(first.texts[u[k]], second.texts[v[k]], least))
        close = value >= least
        u, v, value = u[close], v[close], value[close]
        different, place = np.unique(value, return_inverse=True)
        rounded = np.array([round(x, 6) for x in different.tolist()], dtype=float)[place]
        keep = rounded >= threshold
        u, v, value, rounded = u[keep], v[keep], value[keep], rounded[keep]
        p, q = first.data[:, u], second.data[:, v]
        too = (value >= SIMILAR) & ~((p > 0) & (q > 0) & (p != q)).any(axis=0)
        for pair, i, j in _expanded((first.first[u], first.many[u]), (second.first[v], second.many[v])):
            i, j = first.rows[i], second.rows[j]
            ahead = first.rank[i] < second.rank[j]
            yield flipped, i[ahead], j[ahead], rounded[pair[ahead]], too[pair[ahead]]
