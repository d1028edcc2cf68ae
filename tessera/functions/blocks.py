"""How alike two texts are by their common blocks: the longest common block is found with a suffix automaton, then those on
its left and on its right, and so on.
"""

from __future__ import annotations

from collections import Counter

#: In a text of so many characters, a character of more than one in POPULAR of them (and one more) starts no block.
LONG, POPULAR = 200, 100
#: Ranges of so few pairs of places are compared pair by pair.
SMALL = 256


class Automaton:
    """The suffix automaton of a run of symbols, with the first end of each state's texts."""

    def __init__(self, symbols):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        last = 0
        for at, symbol in enumerate(symbols):
            new = self._state({}, -1, self.length[last] + 1, at)
            state = last
            while state >= 0 and symbol not in self.next[state]:
                self.next[state][symbol] = new
                state = self.link[state]
            if state < 0:
                self.link[new] = 0
            else:
                to = self.next[state][symbol]
                if self.length[to] == self.length[state] + 1:
                    self.link[new] = to
                else:  # texts of ``to`` that are short enough to end here too get a state of their own
                    copy = self._state(dict(self.next[to]), self.link[to], self.length[state] + 1, self.first[to])
                    while state >= 0 and self.next[state].get(symbol) == to:
                        self.next[state][symbol] = copy
                        state = self.link[state]
                    self.link[to] = self.link[new] = copy
            last = new

    def _state(self, edges: dict, link: int, length: int, first: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.next) - 1

    def longest(self, symbols) -> tuple[int, int, int]:
        """(end here, end there, size) of the longest common block, the first here and then there; ends are of last symbols."""
        best, state, size = (-1, -1, 0), 0, 0
        edges, link, length = self.next, self.link, self.length
        for at, symbol in enumerate(symbols):
            while state and symbol not in edges[state]:
                state = link[state]
                size = length[state]
            to = edges[state].get(symbol)
            if to is None:
                continue
            state, size = to, size + 1
            if size > best[2]:
                best = (at, self.first[state], size)
        return best


def _pairwise(a, b) -> tuple[int, int, int]:
    """The same for short runs, pair by pair."""
    best, before = (-1, -1, 0), {}
    for i, x in enumerate(a):
        now = {}
        for j, y in enumerate(b):
            if x == y:
                now[j] = k = before.get(j - 1, 0) + 1
                if k > best[2]:
                    best = (i, j, k)
        before = now
    return best


def common_size(a: str, b: str) -> int:
    """How many characters the common blocks of two texts have.

    Characters that are popular in a long ``b`` start no block and count only where they lie beside one. Each of them is a
    symbol of its own in the automaton, so that no block runs through it.
    """
    popular = {c for c, n in Counter(b).items() if n > len(b) // POPULAR + 1} if len(b) >= LONG else set()
    left = [None if c in popular else c for c in a]
    right = [j if c in popular else c for j, c in enumerate(b)]
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 >= i1 or j0 >= j1:
            continue
        x, y = left[i0:i1], right[j0:j1]
        i, j, size = _pairwise(x, y) if len(x) * len(y) <= SMALL else Automaton(y).longest(x)
        i, j = (i0 + i - size + 1, j0 + j - size + 1) if size else (i0, j0)
        while i > i0 and j > j0 and a[i - 1] == b[j - 1]:
            i, j, size = i - 1, j - 1, size + 1
        while i + size < i1 and j + size < j1 and a[i + size] == b[j + size]:
            size += 1
        if size:
            total += size
            todo += [(i0, i, j0, j), (i + size, i1, j + size, j1)]
    return total


def ratio(a: str, b: str) -> float:
    """Twice the common blocks' size by both texts' sizes; 1 for two empty texts."""
    return 2.0 * common_size(a, b) / (len(a) + len(b)) if a or b else 1.0
