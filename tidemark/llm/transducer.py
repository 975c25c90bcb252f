"""Weighted finite-state transducers that write one symbol for each one they read.

A machine has numbered states, arcs (symbol read, symbol written, weight, next state) and weights of its final states; weights add
along a path. compose() makes one machine of two: the second reads what the first writes. Where several paths read the same
symbols, run() gives the heaviest, of equal ones the first found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple


class Arc(NamedTuple):
    read: str
    write: str
    weight: float
    to: int


class Transducer:
    def __init__(self, arcs: dict[int, list[Arc]], final: dict[int, float], start: int = 0):
        self.arcs, self.final, self.start = arcs, final, start
        self._by: dict[tuple[int, str], list[Arc]] = {}
        for state, out in arcs.items():
            for arc in out:
                self._by.setdefault((state, arc.read), []).append(arc)

    def on(self, state: int, symbol: str) -> list[Arc]:
        return self._by.get((state, symbol), [])

    def compose(self, other: Transducer) -> Transducer:
        """This machine, then the other: the pairs of states that a path from the start reaches and from which one ends."""
        number = {(self.start, other.start): 0}
        arcs, final, todo = {}, {}, [(self.start, other.start)]
        while todo:
            pair = todo.pop()
            here = arcs.setdefault(number[pair], [])
            if pair[0] in self.final and pair[1] in other.final:
                final[number[pair]] = self.final[pair[0]] + other.final[pair[1]]
            for a in self.arcs.get(pair[0], ()):
                for b in other.on(pair[1], a.write):
                    to = (a.to, b.to)
                    if to not in number:
                        number[to] = len(number)
                        todo.append(to)
                    here.append(Arc(a.read, b.write, a.weight + b.weight, number[to]))
        return Transducer(arcs, final)._trimmed()

    def _trimmed(self) -> Transducer:
        before: dict[int, set[int]] = {}
        for state, out in self.arcs.items():
            for arc in out:
                before.setdefault(arc.to, set()).add(state)
        live, todo = set(self.final), list(self.final)
        while todo:
            for state in before.get(todo.pop(), ()):
                if state not in live:
                    live.add(state)
                    todo.append(state)
        return Transducer({s: [a for a in out if a.to in live] for s, out in self.arcs.items() if s in live}, self.final, self.start)

    def run(self, symbols: Sequence[str]) -> tuple[float, tuple[str, ...]] | None:
        """Weight and written symbols of the heaviest path; None if no path reads the symbols to an end."""
        best: dict[int, tuple[float, tuple | None]] = {self.start: (0.0, None)}  # weight, what was written last and before
        for symbol in symbols:
            after: dict[int, tuple[float, tuple | None]] = {}
            for state, (weight, written) in best.items():
                for arc in self.on(state, symbol):
                    if arc.to not in after or weight + arc.weight > after[arc.to][0]:
                        after[arc.to] = (weight + arc.weight, (arc.write, written))
            best = after
        ends = [(weight + self.final[s], written) for s, (weight, written) in best.items() if s in self.final]
        if not ends:
            return None
        weight, written = max(ends, key=lambda e: e[0])
        out = []
        while written is not None:
            out.append(written[0])
            written = written[1]
        return weight, tuple(reversed(out))

    def paths(self, symbols: Sequence[str], state: int | None = None) -> Iterator[tuple[float, tuple[str, ...]]]:
        """Weight and written symbols of every path, one by one."""
        state = self.start if state is None else state
        if not symbols:
            if state in self.final:
                yield self.final[state], ()
            return
        for arc in self.on(state, symbols[0]):
            for weight, out in self.paths(symbols[1:], arc.to):
                yield arc.weight + weight, (arc.write, *out)
