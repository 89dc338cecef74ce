"""A generalised suffix automaton over integers."""
from __future__ import annotations

from collections.abc import Sequence


class SuffixAutomaton:
    """All substrings of the sequences added so far.

    Each state stands for a class of substrings; ``length`` is its longest one,
    ``link`` the state of the longest suffix outside the class.  A state's
    transitions are a dict.  There are at most two states for each element added.
    """

    __slots__ = ("step", "link", "length")

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def __len__(self) -> int:
        return len(self.step)

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the suffixes that end in p's class plus c."""
        step, link, length = self.step, self.link, self.length
        copy = len(step)
        step.append(step[q].copy())
        length.append(length[p] + 1)
        link.append(link[q])
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, sequence: Sequence[int]) -> None:
        """One more sequence; none of its substrings reaches into another one."""
        step, link, length = self.step, self.link, self.length
        last = 0
        for c in sequence:
            q = step[last].get(c)
            if q is not None:  # the prefix read so far was there before
                last = q if length[q] == length[last] + 1 else self._split(last, q, c)
                continue
            new = len(step)
            step.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in step[p]:
                step[p][c] = new
                p = link[p]
            if p >= 0:
                q = step[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, c)
            last = new

    def matching(self, sequence: Sequence[int]) -> list[int]:
        """Matching statistics: for each element the length of the longest substring
        that ends there and is a substring of an added sequence."""
        step, link, length = self.step, self.link, self.length
        out, at, n = [], 0, 0
        for c in sequence:
            q = step[at].get(c)
            while q is None and at:
                at = link[at]
                n = length[at]
                q = step[at].get(c)
            if q is not None:
                at, n = q, n + 1
            out.append(n)
        return out
