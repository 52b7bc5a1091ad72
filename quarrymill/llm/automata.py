"""Probabilistic automata from positive samples by state merging (ALERGIA; Carrasco and Oncina, 1994).

The strings become a prefix tree with counts. States are visited breadth first; each is merged with a kept state that
it is compatible with - the shares of endings and of every outgoing symbol agree within Hoeffding bounds, and so do
those of their successors - or is kept. Of several such states it is the one from which the strings below are
likeliest: states of few strings are compatible with any, and the first would draw all of them.
"""

from __future__ import annotations

import math
from collections import deque


class Automaton:
    """arrivals, endings and edges (symbol -> (state, count)) of each state; state 0 is the start."""

    def __init__(self, alphabet: int):
        self.arrivals: list[int] = [0]
        self.endings: list[int] = [0]
        self.edges: list[dict[str, tuple[int, int]]] = [{}]
        self.alphabet = alphabet

    def add(self, string: str) -> None:
        state = 0
        for symbol in string:
            self.arrivals[state] += 1
            to, count = self.edges[state].get(symbol, (len(self.arrivals), 0))
            if to == len(self.arrivals):
                self.arrivals.append(0)
                self.endings.append(0)
                self.edges.append({})
            self.edges[state][symbol] = (to, count + 1)
            state = to
        self.arrivals[state] += 1
        self.endings[state] += 1

    def _differ(self, f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
        if not n1 or not n2:
            return False
        return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int, alpha: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n1, n2 = self.arrivals[a], self.arrivals[b]
            if self._differ(self.endings[a], n1, self.endings[b], n2, alpha):
                return False
            for symbol in self.edges[a].keys() | self.edges[b].keys():
                to1, f1 = self.edges[a].get(symbol, (-1, 0))
                to2, f2 = self.edges[b].get(symbol, (-1, 0))
                if self._differ(f1, n1, f2, n2, alpha):
                    return False
                if to1 >= 0 and to2 >= 0 and to1 != to2:
                    todo.append((to1, to2))
        return True

    def _likeness(self, a: int, b: int) -> float:
        """Natural logarithm of the probability that the strings below b begin in a."""
        total, todo, share = 0.0, [(a, b)], 1 / (self.alphabet + 1)
        while todo:
            a, b = todo.pop()
            n = self.arrivals[a] + 1 if a >= 0 else 0
            if self.endings[b]:
                total += self.endings[b] * math.log((self.endings[a] + share) / n if a >= 0 else share)
            for symbol, (below, count) in self.edges[b].items():
                to, f = self.edges[a].get(symbol, (-1, 0)) if a >= 0 else (-1, 0)
                total += count * math.log((f + share) / n if a >= 0 else share)
                todo.append((to, below))
        return total

    def _fold(self, a: int, b: int) -> None:
        """Adds the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.arrivals[a] += self.arrivals[b]
            self.endings[a] += self.endings[b]
            for symbol, (to, count) in self.edges[b].items():
                if symbol in self.edges[a]:
                    own, n = self.edges[a][symbol]
                    self.edges[a][symbol] = (own, n + count)
                    todo.append((own, to))
                else:
                    self.edges[a][symbol] = (to, count)

    def merge(self, alpha: float) -> Automaton:
        """Merges compatible states in place."""
        kept, waiting = [0], deque((0, s) for s in self.edges[0])
        while waiting:
            source, symbol = waiting.popleft()
            if symbol not in self.edges[source]:
                continue
            state, count = self.edges[source][symbol]
            if state in kept:
                continue
            alike = [other for other in kept if self._compatible(other, state, alpha)]
            if alike:
                other = max(alike, key=lambda k: self._likeness(k, state)) if len(alike) > 1 else alike[0]
                self.edges[source][symbol] = (other, count)
                self._fold(other, state)
                queued = set(waiting)
                for k in kept:  # what folding hung under kept states is visited too
                    waiting.extend((k, s) for s, (to, _) in sorted(self.edges[k].items()) if to not in kept and (k, s) not in queued)
            else:
                kept.append(state)
                waiting.extend((state, s) for s in self.edges[state])
        return self._only(kept)

    def _only(self, kept: list[int]) -> Automaton:
        place = {s: i for i, s in enumerate(kept)}
        out = Automaton(self.alphabet)
        out.arrivals = [self.arrivals[s] for s in kept]
        out.endings = [self.endings[s] for s in kept]
        out.edges = [{x: (place[to], n) for x, (to, n) in self.edges[s].items()} for s in kept]
        return out

    def log_likelihood(self, string: str) -> float:
        """Natural logarithm of the probability of a string; every symbol and the end have a small share of their own."""
        total, state, share = 0.0, 0, 1 / (self.alphabet + 1)
        for i, symbol in enumerate(string):
            to, count = self.edges[state].get(symbol, (-1, 0))
            total += math.log((count + share) / (self.arrivals[state] + 1))
            if to < 0:  # no such way: the rest and the end are scored as any symbols
                return total + (len(string) - i) * math.log(share)
            state = to
        return total + math.log((self.endings[state] + share) / (self.arrivals[state] + 1))


def infer(strings: list[str], alpha: float = 0.01, alphabet: int = 64) -> Automaton:
    """The automaton of a sample; without strings, one that gives every symbol the same share."""
    tree = Automaton(alphabet)
    for s in strings:
        tree.add(s)
    return tree.merge(alpha)
