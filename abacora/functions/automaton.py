"""Many substrings at once: an Aho-Corasick automaton as flat arrays, run over many stretches of text side by side.

States are numbered level by level, so each level is built with a few array operations. The automaton holds the first PREFIX
bytes of every pattern, which bounds its states; where one is met, the rest of a longer pattern is compared as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of a pattern that are states of the automaton, at most.
PREFIX = 24
#: Bytes of text in one lane of a scan; all lanes advance together.
LANE = 1024


class Automaton:
    """Non-empty patterns, as bytes, in the order given."""

    def __init__(self, patterns: list[bytes], prefix: int = PREFIX):
        self.patterns = patterns
        heads = [p[:prefix] for p in patterns]
        self.head = np.array([len(h) for h in heads], np.int64)
        self.depth = int(self.head.max(initial=0))
        used = np.unique(np.frombuffer(b"".join(heads), np.uint8))
        self.kind = np.zeros(256, np.uint16)  # 0: a byte that no head holds
        self.kind[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        grid = np.zeros((len(heads), max(1, self.depth)), np.int64)
        for i, h in enumerate(heads):
            grid[i, : len(h)] = self.kind[np.frombuffer(h, np.uint8)]
        levels, state, self.states = [], np.zeros(len(heads), np.int64), 1
        for d in range(self.depth):
            alive = np.flatnonzero(self.head > d)
            step, inverse = np.unique(state[alive] * self.width + grid[alive, d], return_inverse=True)
            child = self.states + np.arange(len(step))
            state[alive] = child[inverse.reshape(-1)]
            levels.append((step // self.width, step % self.width, child))
            self.states += len(step)
        self.next = np.zeros((self.states, self.width), np.int32)
        fail = np.zeros(self.states, np.int64)
        by_state = np.argsort(state, kind="stable")
        ends, first = np.unique(state[by_state], return_index=True)
        self.members = dict(zip(ends.tolist(), np.split(by_state, first[1:]))) if len(patterns) else {}
        own = np.zeros(self.states, bool)
        own[ends] = True
        #: the state itself or the longest suffix of it that ends a head, and the next shorter one (0: none)
        self.report, self.shorter = np.zeros(self.states, np.int64), np.zeros(self.states, np.int64)
        for d, (parent, kind, child) in enumerate(levels):
            if d:
                fail[child] = self.next[fail[parent], kind]
            self.next[parent, kind] = child
            self.next[child] = self.next[fail[child]]
            self.shorter[child] = self.report[fail[child]]
            self.report[child] = np.where(own[child], child, self.shorter[child])

    def _ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where (last byte) the automaton is in which reporting state."""
        before = self.depth - 1  # bytes of the lane before that a lane starts with
        lanes = -(-len(data) // LANE)
        kinds = np.zeros(before + lanes * LANE, np.uint16 if self.width > 256 else np.uint8)
        kinds[before : before + len(data)] = self.kind[data]
        strided = np.lib.stride_tricks.as_strided(kinds, (before + LANE, lanes), (kinds.itemsize, kinds.itemsize * LANE))
        flat, reports = self.next.reshape(-1), self.report > 0
        state = np.zeros(lanes, np.int64)
        base, at, where = np.arange(lanes) * LANE - before, [], []
        for t in range(before + LANE):
            state = flat[state * self.width + strided[t]].astype(np.int64)
            if t >= before:
                hit = np.flatnonzero(reports[state])
                if len(hit):
                    at.append(base[hit] + t)
                    where.append(self.report[state[hit]])
        none = np.empty(0, np.int64)
        return np.concatenate([none, *at]), np.concatenate([none, *where])

    def find(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts laid end to end (bytes, where each begins and the last one ends) -> text, pattern, first byte of each match
        within its text. A match lies in one text."""
        none = np.empty(0, np.int64)
        if not len(self.patterns) or not len(data):
            return none, none, none
        at, state = self._ends(data)
        text, pattern, begin = [none], [none], [none]
        while len(at):
            for s in np.unique(state).tolist():
                here = at[state == s]
                for p in self.members[s].tolist():
                    start, size = here - self.head[p] + 1, len(self.patterns[p])
                    row = np.searchsorted(edges, start, "right") - 1
                    fits = start + size <= edges[row + 1]
                    start, row = start[fits], row[fits]
                    if size > self.head[p] and len(start):
                        rest = np.frombuffer(self.patterns[p], np.uint8)[self.head[p] :]
                        same = np.ones(len(start), bool)
                        for i in range(0, len(rest), 64):
                            left = np.flatnonzero(same)
                            if not len(left):
                                break
                            part = rest[i : i + 64]
                            same[left] = (data[(start[left] + self.head[p] + i)[:, None] + np.arange(len(part))] == part).all(axis=1)
                        start, row = start[same], row[same]
                    text.append(row)
                    pattern.append(np.full(len(row), p, np.int64))
                    begin.append(start - edges[row])
            state = self.shorter[state]
            at, state = at[state > 0], state[state > 0]
        return np.concatenate(text), np.concatenate(pattern), np.concatenate(begin)


def laid_out(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array of strings without nulls, and its edges; nothing is copied."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or not len(texts):
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[edges[0] : edges[-1]], edges - edges[0]
