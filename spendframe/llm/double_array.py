"""A trie of equally long phrases in two arrays, through which all positions of a text go at once."""

from __future__ import annotations

import numpy as np


class DoubleArray:
    """Phrases as rows of word ids (sorted, distinct). A child of state s over word w is at base[s] + code(w), where check is s."""

    def __init__(self, phrases: np.ndarray):
        self.depth = phrases.shape[1]
        # Frequent words get small codes, so that the children of nodes with many of them lie close together.
        words, counts = np.unique(phrases, return_counts=True)
        self.words = words
        self.codes = np.empty(len(words), np.int64)
        self.codes[np.argsort(-counts, kind="stable")] = np.arange(len(words))
        rows = self.codes[np.searchsorted(words, phrases)] if len(words) else phrases
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.empty(0, np.int64)
        rows = rows[order]
        self.base, self.check = np.zeros(1, np.int64), np.full(1, -2, np.int64)
        slots = np.zeros(len(rows), np.int64)  # of each phrase, the state of its prefix so far
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for level in range(self.depth):
            starts = new.copy()  # where a node of the level above begins
            new[1:] |= rows[1:, level] != rows[:-1, level]
            children = np.flatnonzero(new)
            placed = self._place(slots[children], rows[children, level], np.flatnonzero(starts[children]))
            slots = placed[np.cumsum(new) - 1]
        #: The phrase (its row number) that a state stands for; -1 where it is none.
        self.phrase = np.full(len(self.base), -1, np.int64)
        self.phrase[slots] = order

    def _place(self, parents: np.ndarray, codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """The states of all children of one level; the children of a node stand together, from `firsts` on.

        All nodes that still lack a base draw one at the same time and keep it if all their children fall on free places of
        their own; nodes with many children draw first. The level has a stretch of its own, which grows if the draws fail.
        """
        sizes = np.diff(np.concatenate([firsts, [len(codes)]]))
        start, width = len(self.check), 2 * len(codes) + len(self.words)
        self._grow(width)
        low, high = np.minimum.reduceat(codes, firsts) if len(firsts) else sizes, np.maximum.reduceat(codes, firsts) if len(firsts) else sizes
        draw, base = np.random.default_rng(len(codes)), np.zeros(len(firsts), np.int64)
        classes = np.frexp(sizes)[1] if len(sizes) else sizes
        for kind in np.unique(classes)[::-1]:
            todo, tries = np.flatnonzero(classes == kind), 0
            while len(todo):
                tries += 1
                if tries % 64 == 0:
                    self._grow(width)
                    width *= 2
                base[todo] = start - low[todo] + (draw.random(len(todo)) * (width - (high - low)[todo])).astype(np.int64)
                own = np.repeat(np.arange(len(todo)), sizes[todo])
                within = np.arange(len(own)) - np.repeat(np.cumsum(sizes[todo]) - sizes[todo], sizes[todo])
                slots = base[todo][own] + codes[firsts[todo][own] + within]
                first = np.zeros(len(slots), bool)
                first[np.unique(slots, return_index=True)[1]] = True
                clash = np.bincount(own[~first | (self.check[slots] != -1)], minlength=len(todo)) > 0
                kept = ~clash[own]
                self.check[slots[kept]] = parents[firsts[todo][own[kept]]]
                todo = todo[clash]
        self.base[parents[firsts]] = base
        return np.repeat(base, sizes) + codes

    def _grow(self, more: int) -> None:
        self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
        self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def advance(self, ids: np.ndarray) -> np.ndarray:
        """The phrase that starts at each position of the ids, -1 where none does; all positions go down a level at a time."""
        out = np.full(len(ids), -1, np.int64)
        if not len(self.words) or len(ids) < self.depth:
            return out
        near = np.minimum(np.searchsorted(self.words, ids), len(self.words) - 1)
        codes = np.where(self.words[near] == ids, self.codes[near], -1)
        places = np.flatnonzero(codes[:len(ids) - self.depth + 1] >= 0)
        states = np.zeros(len(places), np.int64)
        for level in range(self.depth):
            code = codes[places + level]
            following = self.base[states] + code
            alive = (code >= 0) & (following >= 0) & (following < len(self.check))
            alive[alive] = self.check[following[alive]] == states[alive]
            places, states = places[alive], following[alive]
        out[places] = self.phrase[states]
        return out
