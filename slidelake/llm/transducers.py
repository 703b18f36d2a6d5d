"""Small weighted finite-state transducers over classes of words: composition, and the best path of a clause."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

Weight = tuple[int, ...]  # counts of parameters; what an arc weighs is their sum under the learned values


@dataclass
class Transducer:
    """Weighted, over a tropical semiring: arcs[state][symbol] = [(next state, output symbol, weight), ...].

    A weight is a tuple of parameter numbers, whose values are added; a run's weight is the sum along it, and of several
    runs over one input the best counts. rest[state]: where a symbol without arc leads, with its own name and no weight.
    """

    start: object
    arcs: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)

    def arc(self, state, symbol: str, to, out: str | None = None, weight: Weight = ()) -> None:
        self.arcs.setdefault(state, {}).setdefault(symbol, []).append((to, symbol if out is None else out, weight))

    def steps(self, state, symbol: str) -> list[tuple[object, str, Weight]]:
        found = self.arcs.get(state, {}).get(symbol)
        return found if found else [(self.rest.get(state, state), symbol, ())]


def window(starts: str, reach: int, mark: dict[str, tuple[str, Weight]], keep: bool = False) -> Transducer:
    """After the symbol starts, the next reach symbols that are keys of mark are rewritten at a weight; keep: until the end."""
    t = Transducer(0)
    for left in range(reach + 1):
        t.rest[left] = left if keep else max(0, left - 1)
        t.arc(left, starts, reach)
        if left:
            for a, (b, weight) in mark.items():
                t.arc(left, a, left if keep else left - 1, b, weight)
    return t


def compose(first: Transducer, second: Transducer, symbols: list[str]) -> Transducer:
    """The transducer that feeds first's output to second, built over the reachable pairs of states."""
    out = Transducer((first.start, second.start))
    todo, done = [out.start], set()
    while todo:
        state = todo.pop()
        if state in done:
            continue
        done.add(state)
        for s in symbols:
            for a, mid, w1 in first.steps(state[0], s):
                for b, end, w2 in second.steps(state[1], mid):
                    out.arc(state, s, (a, b), end, w1 + w2)
                    todo.append((a, b))
    return out


@dataclass
class Tables:
    """A transducer as arrays: per state and symbol up to n arcs. to: -1 where there is none. counts: parameters of each arc."""

    to: np.ndarray  # (states, symbols, arcs)
    counts: np.ndarray  # (states, symbols, arcs, parameters)

    @classmethod
    def of(cls, t: Transducer, symbols: list[str], n_params: int) -> Tables:
        states = {t.start: 0}
        todo, rows = [t.start], []
        while todo:
            s = todo.pop(0)
            for k, symbol in enumerate(symbols):
                for n, (to, _, weight) in enumerate(t.steps(s, symbol)):
                    if to not in states:
                        states[to] = len(states)
                        todo.append(to)
                    rows.append((states[s], k, n, states[to], weight))
        width = max(r[2] for r in rows) + 1
        to = np.full((len(states), len(symbols), width), -1, np.int64)
        counts = np.zeros((len(states), len(symbols), width, n_params), np.int64)
        for s, k, n, end, weight in rows:
            to[s, k, n] = end
            for p in weight:
                counts[s, k, n, p] += 1
        return cls(to, counts)

    def best(self, symbols: np.ndarray, clause: np.ndarray, values: np.ndarray, may_end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For clauses that lie end to end in symbols (clause: the number of each symbol's clause, ascending): the weight of
        each clause's best path, and how often that path uses each parameter.

        All clauses go in lock step, ordered by length, with one score per state. Of equal paths the first arc of the
        smallest state wins, so results do not depend on how clauses are batched.
        """
        n = int(clause[-1]) + 1 if len(clause) else 0
        sizes = np.bincount(clause, minlength=n)
        first = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        n_states, n_params = len(self.to), len(values)
        weight = self.counts @ values
        score = np.full((n, n_states), -np.inf)
        if n:
            score[:, 0] = 0.0
        used = np.zeros((n, n_states, n_params), np.int64)
        flat = [(s, k) for s in range(n_states) for k in range(self.to.shape[2])]
        for t in range(int(sizes.max()) if n else 0):
            at = order[: int(np.searchsorted(-sizes[order], -t, side="left"))]
            x = symbols[first[at] + t]
            new, new_used = np.full((len(at), n_states), -np.inf), np.zeros((len(at), n_states, n_params), np.int64)
            for s, k in flat:
                old = score[at, s]
                some = np.nonzero((self.to[s, x, k] >= 0) & (old > -np.inf))[0]
                if not len(some):
                    continue
                end, got = self.to[s, x[some], k], old[some] + weight[s, x[some], k]
                better = got > new[some, end]
                some, end, got = some[better], end[better], got[better]
                new[some, end] = got
                new_used[some, end] = used[at[some], s] + self.counts[s, x[some], k]
            score[at], used[at] = new, new_used
        if may_end is not None:
            score[:, ~may_end] = -np.inf
        top = score.argmax(axis=1) if n else np.zeros(0, np.int64)
        return score[np.arange(n), top], used[np.arange(n), top]
