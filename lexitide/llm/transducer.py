"""A minimal acyclic transducer: sorted terms become a small automaton whose path for a term adds up to its ordinal.

States are joined as soon as no later term can pass through them: of two states with equal final flags, arcs and outputs one
is kept. An arc's output is the number of terms that are reached before it, so ordinals follow the order of the terms'
UTF-8 bytes. Arcs are kept as one sorted array, and all terms of a text take their steps together.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from io import BytesIO

import numpy as np

#: Bytes that a term is made of, A-Z folded: letters, and all bytes of characters beyond ASCII. 0 for other bytes.
CLASS = np.zeros(256, np.uint8)
CLASS[128:] = np.arange(128, 256)
CLASS[97:123] = np.arange(97, 123)
CLASS[65:91] = np.arange(97, 123)


@dataclass(frozen=True)
class Transducer:
    """``arcs``: state * 256 + byte, ascending; ``roots``: the first state and the first ordinal of each language."""

    arcs: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    final: np.ndarray
    roots: dict[str, tuple[int, int]]

    def ordinals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray, base: np.ndarray) -> np.ndarray:
        """The ordinals of the terms at these offsets, each from its own state and base; -1 where a term is not held."""
        found = np.full(len(starts), -1, np.int64)
        alive = np.flatnonzero(states >= 0)
        at, end, state, total = starts[alive], ends[alive], states[alive], base[alive]
        while len(alive):
            over = at == end
            if over.any():
                done = over & self.final[state]
                found[alive[done]] = total[done]
                alive, at, end, state, total = (x[~over] for x in (alive, at, end, state, total))
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            hit = self.arcs[arc] == key if len(self.arcs) else np.zeros(len(key), bool)
            arc = arc[hit]
            alive, at, end, state, total = alive[hit], at[hit] + 1, end[hit], self.targets[arc], total[hit] + self.outputs[arc]
        return found

    def pack(self) -> bytes:
        held = BytesIO()
        np.savez_compressed(held, arcs=self.arcs, targets=self.targets, outputs=self.outputs, final=self.final, names=np.frombuffer("\0".join(x.encode().hex() for x in self.roots).encode(), np.uint8), roots=np.array(list(self.roots.values()), np.int64).reshape(-1, 2))
        return held.getvalue()

    @staticmethod
    def unpack(packed: bytes) -> Transducer:
        held = np.load(BytesIO(packed))
        names = [bytes.fromhex(x).decode() for x in held["names"].tobytes().decode().split("\0")] if len(held["roots"]) else []
        return Transducer(held["arcs"], held["targets"], held["outputs"], held["final"], dict(zip(names, map(tuple, held["roots"].tolist()))))


class Builder:
    """Takes languages in order, and the terms of each in order of their bytes."""

    def __init__(self) -> None:
        self.known: dict[tuple, int] = {}  # final flag and arcs (byte, target) of a state that is done
        self.states: list[tuple[bool, tuple, int]] = []  # final flag, arcs, number of terms from here on
        self.roots: dict[str, tuple[int, int]] = {}
        self.path: list[list] = [[False, []]]  # final flag and arcs of the states of the last term
        self.last, self.lang, self.count, self.first = b"", None, 0, 0

    def _close(self, depth: int) -> None:
        """The states of the last term below ``depth`` are done: each is met with an equal one or becomes new."""
        while len(self.path) > depth + 1:
            state = self._held(self.path.pop())
            self.path[-1][1].append((self.last[len(self.path) - 1], state))

    def _held(self, open_state: list) -> int:
        key = (open_state[0], tuple(open_state[1]))
        if (state := self.known.get(key)) is None:
            state = self.known[key] = len(self.states)
            self.states.append((*key, key[0] + sum(self.states[t][2] for _, t in key[1])))
        return state

    def _end(self) -> None:
        if self.lang is not None:
            self._close(0)
            self.roots[self.lang] = self._held(self.path.pop()), self.first
            self.path, self.last, self.first = [[False, []]], b"", self.count

    def add(self, lang: str, term: bytes) -> int:
        """The term's ordinal among all terms so far."""
        if lang != self.lang:
            self._end()
            self.lang = lang
        shared, most = 0, min(len(term), len(self.last))
        while shared < most and term[shared] == self.last[shared]:
            shared += 1
        self._close(shared)
        self.path += [[False, []] for _ in range(len(term) - shared)]
        self.path[-1][0] = True
        self.last, self.count = term, self.count + 1
        return self.count - 1

    def done(self) -> Transducer:
        self._end()
        arcs, targets, outputs = [], [], []
        for state, (final, own, _) in enumerate(self.states):
            before = int(final)  # a term comes before those that it begins
            for byte, target in own:
                arcs.append(state * 256 + byte)
                targets.append(target)
                outputs.append(before)
                before += self.states[target][2]
        return Transducer(*(np.array(x, np.int64) for x in (arcs, targets, outputs)), np.array([s[0] for s in self.states], bool), self.roots)


def built(terms: Iterable[tuple[str, bytes]]) -> Transducer:
    builder = Builder()
    for lang, term in terms:
        builder.add(lang, term)
    return builder.done()
