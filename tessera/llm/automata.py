"""Stochastic automata inferred from strings by merging compatible prefix-tree states.

A string comes as two of one length: its shape, whose symbols the automaton
moves by, and its letters, finer symbols that each state has frequencies of.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable

END = ""
#: Strings that a state has to have seen before it is merged with another one, or before what it has not seen counts as impossible.
LEAST = 20


class Automaton:
    """A probabilistic automaton: for each state, transitions, and frequencies of shape symbols (and ends) and of their letters."""

    def __init__(self, moves: list[dict[str, int]], counts: list[dict[str, int]], letters: list[dict[str, int]], alphabet: int, fine: int):
        self.moves, self.counts, self.letters, self.alphabet, self.fine = moves, counts, letters, alphabet, fine
        # Per state: the total, the share of an unseen step, and by step (shape symbol and letter) its log2 probability and the state it leads to.
        total = [sum(c.values()) for c in counts]
        self._known = [n < LEAST for n in total]
        self._unseen = [math.log2(0.5 / (n + 0.5 * (alphabet + 1))) for n in total]
        share = lambda k, s: math.log2((counts[k][s] + 0.5) / (total[k] + 0.5 * (alphabet + 1)))
        self._ends = [share(k, END) if END in c else None for k, c in enumerate(counts)]
        self._steps = [{sc: (share(k, sc[0]) + math.log2((n + 0.5) / (counts[k][sc[0]] + 0.5 * fine)), moves[k][sc[0]]) for sc, n in f.items()} for k, f in enumerate(letters)]

    def bits(self, shape: str, letters: str, early: bool = False) -> tuple[float, bool]:
        """Mean log2 probability of a step, the end among them, and whether every step was seen where enough strings passed.

        Unseen steps have a smoothed share and return to the start; ``early`` ends at one that is sure to be impossible.
        """
        state, total, sure = 0, 0.0, True
        for s, c in zip(shape, letters, strict=True):
            step = self._steps[state].get(s + c)
            if step is None:
                seen = self.counts[state].get(s, 0)
                if seen:  # the shape is known here, the letter is not
                    of = sum(self.counts[state].values())
                    step = math.log2((seen + 0.5) / (of + 0.5 * (self.alphabet + 1))) + math.log2(0.5 / (seen + 0.5 * self.fine)), self.moves[state][s]
                else:
                    sure = sure and self._known[state]
                    if early and not sure:
                        return -math.inf, False
                    step = self._unseen[state] + math.log2(1 / self.fine), 0
            total += step[0]
            state = step[1]
        end = self._ends[state]
        if end is None:
            end, sure = self._unseen[state], sure and self._known[state]
        return (total + end) / (len(shape) + 1), sure


def _differ(n: int, of_n: int, m: int, of_m: int, bound: float) -> bool:
    """Whether two frequencies differ by more than the Hoeffding bound allows."""
    return of_n > 0 and of_m > 0 and abs(n / of_n - m / of_m) > bound * (1 / math.sqrt(of_n) + 1 / math.sqrt(of_m))


def infer(strings: Iterable[tuple[str, str]], alpha: float = 0.05) -> Automaton:
    """The automaton of a sample of (shape, letters).

    States of the prefix tree are met breadth first. One that ``LEAST`` strings
    have passed is merged into the first kept state of which that is true, too,
    and whose frequencies, and those of all states below both, agree within the
    Hoeffding bound at level ``alpha``; otherwise it is kept. States that fewer
    strings have passed say too little to be merged and stay as they are.
    """
    moves: list[dict[str, int]] = [{}]
    counts: list[dict[str, int]] = [{}]
    fine: list[dict[str, int]] = [{}]
    passed = [0]
    for shape, letters in sorted(strings):
        state = 0
        passed[0] += 1
        for s, c in zip((*shape, END), (*letters, END), strict=True):
            counts[state][s] = counts[state].get(s, 0) + 1
            if s != END:
                fine[state][s + c] = fine[state].get(s + c, 0) + 1
                if s not in moves[state]:
                    moves[state][s] = len(moves)
                    moves.append({})
                    counts.append({})
                    fine.append({})
                    passed.append(0)
                state = moves[state][s]
                passed[state] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def agree(a: int, b: int) -> bool:
        open_, met = [(a, b)], set()
        while open_:
            a, b = open_.pop()
            if (a, b) in met:
                continue
            met.add((a, b))
            of_a, of_b = sum(counts[a].values()), sum(counts[b].values())
            if any(_differ(counts[a].get(s, 0), of_a, counts[b].get(s, 0), of_b, bound) for s in {*counts[a], *counts[b]}):
                return False
            of = {s[0] for s in {*fine[a], *fine[b]}}
            if any(_differ(fine[a].get(s, 0), counts[a].get(s[0], 0), fine[b].get(s, 0), counts[b].get(s[0], 0), bound) for s in {*fine[a], *fine[b]} if s[0] in of):
                return False
            open_ += [(moves[a][s], moves[b][s]) for s in moves[a] if s in moves[b] and moves[a][s] != moves[b][s]]
        return True

    kept, order = {0}, [0]
    waiting = deque((0, s) for s in sorted(moves[0]))

    def fold(a: int, b: int) -> None:
        """Add the tree below ``b`` to the state ``a``."""
        open_ = [(a, b)]
        while open_:
            a, b = open_.pop()
            passed[a] += passed[b]
            for have, more in ((counts[a], counts[b]), (fine[a], fine[b])):
                for s, n in more.items():
                    have[s] = have.get(s, 0) + n
            for s, below in moves[b].items():
                if s in moves[a]:
                    open_.append((moves[a][s], below))
                else:
                    moves[a][s] = below
                    if a in kept:
                        waiting.append((a, s))

    while waiting:
        k, s = waiting.popleft()
        state = moves[k][s]
        if state in kept:
            continue
        same = next((o for o in order if passed[o] >= LEAST and agree(o, state)), None) if passed[state] >= LEAST else None
        if same is None:
            kept.add(state)
            order.append(state)
            waiting += [(state, t) for t in sorted(moves[state])]
        else:
            moves[k][s] = same
            fold(same, state)
    place = {k: i for i, k in enumerate(order)}
    alphabet = len({s for k in order for s in counts[k] if s != END})
    return Automaton([{s: place[t] for s, t in moves[k].items()} for k in order], [counts[k] for k in order], [fine[k] for k in order], alphabet, len({s[1:] for k in order for s in fine[k]}))
