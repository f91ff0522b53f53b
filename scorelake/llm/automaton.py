"""Generalised suffix automaton over words, in sorted arrays of some 50 bytes a word, that many texts are streamed through side by side.

Runs of words longer than a window aren't told apart: what ends at a word is a run of the window's length, or a shorter one. So a state is a set
of runs, of a window's words at most, that end at the same places of the items; it has the longest one's length, a link to the state of the
longest run that ends there and elsewhere too, and moves by word. Runs of each length are numbered by sorting (the run of one word less, the
word before it), so the automaton is made by one sort a length, without a step of Python a word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from itertools import count, repeat

import numpy as np

from scorelake.llm.common import ragged

#: Words of a text that one lane of the matcher reads, besides those of a window before them.
STRETCH = 256


class Automaton:
    """Of (item, text) pairs, all items' words as `words_of` splits them. An item of fewer words than the window is a window by itself."""

    def __init__(self, items: Sequence[tuple[str, bytes]], window: int, words_of: Callable[[bytes], list[bytes]]):
        self.window, self.words_of = window, words_of
        self.names = sorted({item for item, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        number: dict = defaultdict(count(1).__next__)
        parts = [np.fromiter(map(number.__getitem__, words_of(text)), np.int32) for _, text in items]
        self.number = dict(number)
        sizes = np.array([len(p) for p in parts], np.int64)
        self.base = len(self.number) + 1
        self.least = int(min([window, *sizes[sizes > 0].tolist()]))
        owner = np.repeat(np.array([place[item] for item, _ in items], np.int64), sizes)
        code = np.concatenate([np.zeros(0, np.int32), *parts])
        del parts
        self._build(code, np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes), owner, sizes)

    def _build(self, code: np.ndarray, place: np.ndarray, owner: np.ndarray, sizes: np.ndarray) -> None:
        """code, place (in its piece) and owner of every word of the pieces, whose sizes are given."""
        top, n = self.window, len(code)
        # By length: the number of the run that ends at each word (0: it would begin before its piece), and a place where each run ends.
        runs, ends = [np.zeros(n, np.int32), code], [np.zeros(1, np.int64), np.zeros(self.base, np.int64)]
        ends[1][code] = np.arange(n)
        for size in range(2, top + 1):
            inside = np.flatnonzero(place >= size - 1)
            _, first, of = np.unique(runs[-1][inside].astype(np.int64) * self.base + code[inside - size + 1], return_index=True, return_inverse=True)
            run = np.zeros(n, np.int32)
            run[inside] = of + 1
            runs.append(run)
            ends.append(np.concatenate([[0], inside[first]]))
        # A run is the longest of its state if pieces begin with it, if different words stand before it, or if it is a window.
        own, self.size, self.link, up, states = [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)], np.zeros(n, np.int32), 1
        for size in range(1, top + 1):
            longest = np.full(len(ends[size]), size == top)
            if size < top:
                longest = np.bincount(runs[size][ends[size + 1][1:]], minlength=len(longest)) >= 2
                longest[runs[size][place == size - 1]] = True
            longest[0] = False
            number = np.zeros(len(longest), np.int32)
            number[longest] = states + np.arange(longest.sum())
            states += int(longest.sum())
            own.append(number)
            self.size.append(np.full(longest.sum(), size, np.int32))
            self.link.append(up[ends[size][longest]])
            at = number[runs[size]]
            up = np.where(at > 0, at, up)
        del up
        self.size, self.link = np.concatenate(self.size), np.concatenate(self.link)
        # From the run's number to its state's: that of the run with the one word more before it, if it isn't the longest itself.
        for size in range(top, 0, -1):
            at = own[size][runs[size]]
            runs[size] = at if size == top else np.where((at == 0) & (runs[size] > 0), runs[size + 1], at)
        self.root = np.zeros(self.base, np.int32)
        if n:
            self.root[1:] = runs[1][ends[1][1:]]
        # A state moves as its longest run of less than a window does. A run of one word more is a move each.
        keys, to = [], []
        for size in range(2, top + 1):
            end = ends[size][1:]
            before = runs[size - 1][end - 1]
            taken = np.flatnonzero((self.size[before] == size - 1) | (size == top))
            keys.append(before[taken].astype(np.int64) * self.base + code[end[taken]])
            to.append(runs[size][end[taken]])
        keys, to = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int32), *to])
        order = np.argsort(keys)
        self.edge, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(to[order], 0).astype(np.int32)
        # After a whole window only its last words but one count.
        self.onward = np.where((self.size == top) & (self.size[self.link] == top - 1), self.link, np.arange(states)).astype(np.int32)
        whole = runs[top]
        last = np.cumsum(sizes) - 1
        short = np.flatnonzero((sizes > 0) & (sizes < top))
        short_states = np.array([runs[int(sizes[k])][last[k]] for k in short.tolist()], np.int64)
        names = max(1, len(self.names))
        pairs = np.unique(np.concatenate([whole[whole > 0].astype(np.int64) * names + owner[whole > 0], short_states * names + owner[last[short]]]))
        self.items = (pairs % names).astype(np.int32)
        self.items_at = np.searchsorted(pairs // names, np.arange(states + 1)).astype(np.int32)
        # The nearest state, itself or by links, of whole short items; links lead to lower numbers.
        self.short = np.zeros(states, np.int32)
        self.short[short_states] = short_states
        if short.size:
            for size in range(1, top + 1):
                level = np.flatnonzero((self.size == size) & (self.short == 0))
                self.short[level] = self.short[self.link[level]]
        self.any_short = bool(short.size)

    def nbytes(self) -> int:
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def _lanes(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of stretches, longest first, of the runs of known words that could hold a window."""
        known = np.concatenate([[False], code > 0, [False]]).astype(np.int8)
        edge = np.diff(known)
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        a, b = a[b - a >= self.least], b[b - a >= self.least]
        n = -(-(b - a) // STRETCH)
        own = np.repeat(np.arange(len(a)), n)
        start = a[own] + STRETCH * (np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n))
        size = np.minimum(start + STRETCH, b[own])
        start = np.maximum(start - (self.window - 1), a[own])
        size = size - start
        order = np.argsort(-size, kind="stable")
        return start[order], size[order]

    def _ends(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words at which a window ends, and its state: all windows', and the longest short item's. Some more than once."""
        start, size = self._lanes(code)
        at, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        state, length = np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        for t in range(int(size[0]) if len(size) else 0):
            k = int(np.searchsorted(-size, -t))
            c = code[start[:k] + t]
            s, n = self.onward[state[:k]], np.minimum(length[:k], self.window - 1)
            new, grown = self.root[c], np.ones(k, np.int32)
            live = np.flatnonzero(s)
            while live.size:
                key = s[live].astype(np.int64) * self.base + c[live]
                p = np.searchsorted(self.edge, key)
                found = self.edge[p] == key
                hit, p = live[found], p[found]
                new[hit], grown[hit] = self.to[p], n[hit] + 1
                live = live[~found]
                s[live] = self.link[s[live]]
                n[live] = self.size[s[live]]
                live = live[s[live] > 0]
            state[:k], length[:k] = new, grown
            full = np.flatnonzero(grown == self.window)
            if full.size:
                at.append(start[full] + t)
                nodes.append(new[full])
            if self.any_short:
                short = self.short[np.where(self.size[new] <= grown, new, self.link[new])]
                some = np.flatnonzero(short)
                if some.size:
                    at.append(start[some] + t)
                    nodes.append(short[some])
        return np.concatenate(at), np.concatenate(nodes)

    def match(self, texts: Sequence[bytes]) -> tuple[np.ndarray, tuple, tuple]:
        """Of each text its number of words; (offsets by text, firsts, ends) of ranges of words in occurring windows, apart and in order; and
        (offsets by text, names) of the items with such windows, in order."""
        parts, sizes = [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            words = self.words_of(t)
            sizes[i] = len(words)
            parts += [np.fromiter(map(self.number.get, words, repeat(0)), np.int32, len(words)), np.zeros(1, np.int32)]
        code = np.concatenate([np.zeros(0, np.int32), *parts])
        begin = np.cumsum(sizes + 1) - sizes - 1
        at, node = self._ends(code)
        change = np.bincount(at + 1 - self.size[node], minlength=len(code) + 1) - np.bincount(at + 1, minlength=len(code) + 1)
        edge = np.diff(np.concatenate([[0], np.cumsum(change) > 0, [0]]).astype(np.int8))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        text = np.searchsorted(begin, first, "right") - 1
        spans = np.searchsorted(text, np.arange(len(texts) + 1)), first - begin[text], end - begin[text]
        states = len(self.size)
        pairs = np.unique((np.searchsorted(begin, at, "right") - 1) * states + node)
        own = []
        while pairs.size:  # the states themselves, then the shorter items that end with them
            t, s = np.divmod(pairs, states)
            n = (self.items_at[s + 1] - self.items_at[s]).astype(np.int64)
            own.append(np.repeat(t, n) * max(1, len(self.names)) + self.items[ragged(self.items_at[s].astype(np.int64), n)])
            up = self.short[self.link[s]]
            pairs = np.unique((t * states + up)[up > 0])
        t, item = np.divmod(np.unique(np.concatenate([np.zeros(0, np.int64), *own])), max(1, len(self.names)))
        return sizes, spans, (np.searchsorted(t, np.arange(len(texts) + 1)), [self.names[i] for i in item.tolist()])
