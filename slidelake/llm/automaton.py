"""Suffix automata over sequences of words."""

from __future__ import annotations


class SuffixAutomaton:
    """Of a set of weighted sequences. count[state]: weighted number of the occurrences of the state's strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, words: list, weight: int = 1) -> None:
        """Add a sequence; strings never run across two sequences."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for w in words:
            to = nxt[last].get(w)
            if to is not None and length[to] == length[last] + 1:
                last = to  # the prefix is there already
                count[last] += weight
                continue
            if to is not None:  # there as part of longer strings only: split it off
                last = self._split(last, w, to)
                count[last] += weight
                continue
            cur = self._state(length[last] + 1)
            p = last
            while p >= 0 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p < 0:
                link[cur] = 0
            else:
                q = nxt[p][w]
                link[cur] = q if length[p] + 1 == length[q] else self._split(p, w, q)
            last = cur
            count[last] += weight

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.length) - 1

    def _split(self, p: int, w, q: int) -> int:
        twin = self._state(self.length[p] + 1)
        self.next[twin] = dict(self.next[q])
        self.link[twin] = self.link[q]
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def close(self) -> None:
        """Carry the counts of prefixes over to all strings. Call once, after the last add."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def matches(self, words: list, size: int) -> list[tuple[int, int]]:
        """(start, count) of the windows of size words of a sequence that occur in the closed automaton, and how often.

        Streams the sequence for its matching statistics: the state of the longest suffix read so far that occurs at all.
        """
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = held = 0
        out = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                held = length[state]
            if w in nxt[state]:
                state, held = nxt[state][w], held + 1
            while length[link[state]] >= size if state else False:
                state = link[state]
                held = length[state]
            if held >= size:
                out.append((i + 1 - size, count[state]))
        return out

    def repeated(self, words: list, size: int, least: int = 2) -> list[int]:
        """Starts of the windows of size words of a sequence that occur least times or more in the closed automaton."""
        return [i for i, n in self.matches(words, size) if n >= least]
