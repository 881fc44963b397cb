"""Substring dedup by suffix automata of reference shards.

A shard's automaton knows every run of words of the shard's stretches and the first document of each.
Stretches are streamed through it for matching statistics: at each word the state of the longest
known run that ends there, held to the window's length, so a full run is a repeated window. What the
windows cover is removed as maximal spans. The shards grow with the data, so an automaton is
built in the task where its shard's stretches meet and is not sent to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .passages import Repeats, Shape, repeats

SHAPE = Shape(window=13, anchor=5, shard_words=100_000)


class Automaton:
    """A suffix automaton of many runs of words; each state has the least document whose run ends there."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [None]

    def _state(self, length: int, least: int | None, follow: dict[int, int]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        self.least.append(least)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of the runs that p and word reach, with the longer runs of q left to q."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, None, dict(self.next[q]))
        self.link[copy] = self.link[q]
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, run: list[int], doc: int) -> None:
        last = 0
        for word in run:
            if word in self.next[last]:
                last = self._split(last, word, self.next[last][word])
            else:
                new = self._state(self.length[last] + 1, None, {})
                p = last
                while p != -1 and word not in self.next[p]:
                    self.next[p][word] = new
                    p = self.link[p]
                if p != -1:
                    self.link[new] = self._split(p, word, self.next[p][word])
                last = new
            if self.least[last] is None or doc < self.least[last]:
                self.least[last] = doc

    def finish(self) -> None:
        """A run that ends somewhere has its shorter ends there too."""
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up, own = self.link[state], self.least[state]
            if self.least[up] is None or own < self.least[up]:
                self.least[up] = own

    def firsts(self, run: list[int], window: int) -> list[int | None]:
        """Of each window of the run the least document that has it, or None."""
        state, have, out = 0, 0, []
        for i, word in enumerate(run):
            while state and word not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if word in self.next[state]:
                state, have = self.next[state][word], have + 1
            if have > window:
                have = window
            while have <= self.length[self.link[state]] and state:
                state = self.link[state]
            if i + 1 >= window:
                out.append(self.least[state] if have == window else None)
        return out


def index(runs: list[np.ndarray], at: np.ndarray, anchor: np.ndarray, docs: np.ndarray, window: int) -> pa.ListArray:
    automaton = Automaton()
    for run, doc in zip(runs, docs.tolist(), strict=True):
        automaton.add(run.tolist(), doc)
    automaton.finish()
    return pa.array([automaton.firsts(run.tolist(), window) for run in runs], pa.list_(pa.int64()))


def dedup(docs: DataFrame, shape: Shape = SHAPE) -> Repeats:
    """Substring dedup of (doc_id, text); see `repeats` for rows, edge cases and columns."""
    return repeats(docs, shape, index)
