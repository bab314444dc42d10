"""One deterministic automaton over many grammars, run over all starts of a text side by side.

Grammars are put together from literals, character sets, repeats and choices; the subset construction
makes one table of them, so that no character is looked at twice from the same start, whatever the
number of grammars. ``scan`` walks the table from every start of a chunk at once (one vector step per
character read); a walk reads on beyond its chunk, so no match depends on where a chunk ends.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Starts that are walked side by side.
CHUNK = 1 << 18
#: From so few walks on, plain steps are cheaper than vector steps.
FEW = 12
_ANY = 129  # 128 ASCII characters, one class for all others
_DEAD = 0
#: Grammars that can be read in several ways at once multiply the states; more than these is a mistake in a grammar.
MAX_STATES = 20_000

Node = tuple


def lit(text: str, *, fold: bool = False) -> Node:
    """The characters of ``text`` in a row; with ``fold`` in either case."""
    return ("seq", tuple(chars(c.lower() + c.upper()) if fold else chars(c) for c in text))


def chars(allowed: Iterable[str], *, other: bool = False) -> Node:
    """One character of a set; ``other`` adds everything beyond ASCII."""
    return ("set", frozenset(ord(c) for c in allowed) | ({128} if other else frozenset()))


def all_but(forbidden: str) -> Node:
    """One character, line ends and NUL included only if not forbidden; NUL always is."""
    return ("set", frozenset(range(1, _ANY)) - {ord(c) for c in forbidden})


def seq(*parts: Node) -> Node:
    return ("seq", parts)


def alt(*parts: Node) -> Node:
    return ("alt", parts)


def many(part: Node, least: int = 0, most: int | None = None) -> Node:
    """``part`` at least ``least`` and at most ``most`` times (None: without end)."""
    return ("rep", part, least, most)


class Automaton:
    """The table of ``{tag: (grammar, inside)}``; grammars with ``inside`` may start in the middle of a word."""

    def __init__(self, grammars: dict[str, tuple[Node, bool]]):
        self._empty: list[list[int]] = []
        self._moves: list[tuple[frozenset, int] | None] = []
        self._tags: dict[int, str] = {}
        starts = {True: set(), False: set()}
        for tag, (node, inside) in grammars.items():
            begin, end = self._build(node)
            self._tags[end] = tag
            starts[False].add(begin)
            if inside:
                starts[True].add(begin)
        self._determinise(starts)

    def _state(self) -> int:
        self._empty.append([])
        self._moves.append(None)
        return len(self._empty) - 1

    def _build(self, node: Node) -> tuple[int, int]:
        kind = node[0]
        if kind == "set":
            a, b = self._state(), self._state()
            self._moves[a] = (node[1], b)
            return a, b
        if kind == "seq":
            first = last = self._state()
            for part in node[1]:
                a, b = self._build(part)
                self._empty[last].append(a)
                last = b
            return first, last
        if kind == "alt":
            first, last = self._state(), self._state()
            for part in node[1]:
                a, b = self._build(part)
                self._empty[first].append(a)
                self._empty[b].append(last)
            return first, last
        _, part, least, most = node
        first = last = self._state()
        for _ in range(least):
            a, b = self._build(part)
            self._empty[last].append(a)
            last = b
        if most is None:
            a, b = self._build(part)
            loop = self._state()
            self._empty[last].append(loop)
            self._empty[loop].append(a)
            self._empty[b].append(loop)
            return first, loop
        end = self._state()
        self._empty[last].append(end)
        for _ in range(most - least):
            a, b = self._build(part)
            self._empty[last].append(a)
            self._empty[b].append(end)
            last = b
        return first, end

    def _closure(self, states: Iterable[int]) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for nxt in self._empty[todo.pop()]:
                if nxt not in found:
                    found.add(nxt)
                    todo.append(nxt)
        return frozenset(found)

    def _determinise(self, starts: dict[bool, set[int]]) -> None:
        sets = {m[0] for m in self._moves if m}
        alike: dict[tuple, int] = {}
        classes = np.zeros(256, dtype=np.uint8)
        members: list[int] = []
        for c in range(_ANY):
            mark = tuple(sorted(k for k, s in enumerate(sets) if c in s)) if c else ()
            if mark not in alike:
                alike[mark] = len(alike)
                members.append(c)
            classes[c] = alike[mark]
        classes[129:] = classes[128]
        reads = {s: [k for k, c in enumerate(members) if c and c in m[0]] for s, m in enumerate(self._moves) if m}
        after = {s: self._closure([self._moves[s][1]]) for s in reads}
        numbers: dict[frozenset, int] = {frozenset(): _DEAD}
        rows: list[list[int]] = [[_DEAD] * len(members)]
        ends: list[frozenset] = [frozenset()]
        todo: list[frozenset] = []

        def number(states: frozenset) -> int:
            if states not in numbers:
                if len(numbers) >= MAX_STATES:
                    raise ValueError("the grammars need too many states")
                numbers[states] = len(numbers)
                rows.append([])
                ends.append(frozenset(self._tags[s] for s in states if s in self._tags))
                todo.append(states)
            return numbers[states]

        first = {inside: number(self._closure(begin)) for inside, begin in starts.items()}
        while todo:
            states = todo.pop()
            reached: dict[int, list[frozenset]] = {}
            for s in states:
                for k in reads.get(s, ()):
                    reached.setdefault(k, []).append(after[s])
            row = [_DEAD] * len(members)
            for k, parts in reached.items():
                row[k] = number(parts[0] if len(parts) == 1 else frozenset().union(*parts))
            rows[numbers[states]] = row
        self.table = np.array(rows, dtype=np.int32)
        self.rows = rows
        self.tags = ends
        self.accepts = np.array([bool(e) for e in ends])
        self.classes = classes
        self.first = (first[False], first[True])
        word = np.zeros(256, dtype=np.int8)
        for c in range(256):
            word[c] = chr(c).isalnum() or chr(c) == "_"
        self.word = word

    def scan(self, text: str) -> list[tuple[int, int, frozenset]]:
        """``(start, end, tags)`` of the longest match from every start that has one, in order of starts."""
        if not text:
            return []
        raw = np.frombuffer(text.encode("latin-1", "replace") + b"\0", dtype=np.uint8)
        codes = self.classes[raw]
        flat = codes.tobytes()
        first = np.array(self.first, dtype=np.int32)
        found: list[tuple[int, int, frozenset]] = []
        for base in range(0, len(text), CHUNK):
            stop = min(len(text), base + CHUNK)
            before = np.concatenate(([raw[base - 1] if base else 0], raw[base : stop - 1]))
            state = self.table[first[self.word[before]], codes[base:stop]]
            starts = np.flatnonzero(state)
            state = state[starts]
            starts = starts + base
            at = starts + 1
            ends, last = np.where(self.accepts[state], at, 0), state.copy()
            while len(starts) > FEW:
                state = self.table[state, codes[at]]
                at = at + 1
                hit = self.accepts[state]
                ends[hit], last[hit] = at[hit], state[hit]
                over = state == _DEAD
                if over.any():
                    done = over & (ends > 0)
                    found.extend(zip(starts[done].tolist(), ends[done].tolist(), (self.tags[k] for k in last[done].tolist())))
                    alive = ~over
                    state, starts, at, ends, last = state[alive], starts[alive], at[alive], ends[alive], last[alive]
            for start, here, k, end, best in zip(starts.tolist(), at.tolist(), state.tolist(), ends.tolist(), last.tolist()):
                while k != _DEAD:
                    k = self.rows[k][flat[here]]
                    here += 1
                    if self.tags[k]:
                        end, best = here, k
                if end:
                    found.append((start, end, self.tags[best]))
        found.sort(key=lambda f: f[:2])
        return found
