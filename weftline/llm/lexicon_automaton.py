"""A lexicon trie intersected with Levenshtein automata, made deterministic as words ask for it."""

from __future__ import annotations

from collections.abc import Callable

from .common import ship

ship(__name__)

#: Terms of so many characters may be misspelt in the first one too; shorter ones would then meet too many other words.
FIRST_CHARS = 7
#: States kept before the automaton starts afresh, which bounds its memory.
MOST_STATES = 100_000


def budget_of(term: str, is_open: bool) -> int:
    """Edits allowed for a term: none for short ones; open terms (prefixes) are stricter."""
    if is_open:
        return 0 if len(term) < 8 else 1
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """match(word): the closest term as (edits, index of the term), or None.

    A state of the intersection is a trie node with the edits spent so far; on a character it goes to the child (match), to any child (substitution), stays
    (insertion), skips a child (deletion), or waits for the first of two exchanged characters. A state knows whether an edit touched the first character, as only
    terms of FIRST_CHARS allow that. Sets of such states are the
    states of a deterministic automaton whose transitions are kept, so a word costs a look-up for each character
    until no term is in reach.
    """

    def __init__(self, terms: list[tuple[str, bool]], budget: Callable[[str, bool], int] = budget_of) -> None:
        self.child: list[dict[str, int]] = [{}]
        self.closed: dict[int, tuple[int, int, bool]] = {}
        self.opened: dict[int, tuple[int, int, bool]] = {}
        # the most edits of any term below a node, and of any that allows one in its first character
        self.most: tuple[list[int], list[int]] = ([0], [0])
        for k, (term, is_open) in enumerate(terms):
            node, edits, long = 0, budget(term, is_open), len(term) >= FIRST_CHARS
            below = (edits, edits if long else 0)
            for c in ["", *term]:
                if c and c not in self.child[node]:
                    self.child[node][c] = len(self.child)
                    self.child.append({})
                    for most in self.most:
                        most.append(0)
                node = self.child[node][c] if c else node
                for most, n in zip(self.most, below, strict=True):
                    most[node] = max(most[node], n)
            (self.opened if is_open else self.closed)[node] = (edits, k, long)
        self.fresh()

    def fresh(self) -> None:
        self.start = self.closure({(0, 0, "", False)})
        self.steps: dict[frozenset, dict[str, frozenset]] = {}
        self.ends: dict[frozenset, tuple[int, int] | None] = {}

    def closure(self, states: set[tuple[int, int, str, bool]]) -> frozenset:
        todo = list(states)
        while todo:
            node, edits, waits, first = todo.pop()
            if not waits:
                first = first or not node
                for nxt in self.child[node].values():
                    if edits + 1 <= self.most[first][nxt] and (new := (nxt, edits + 1, "", first)) not in states:
                        states.add(new)
                        todo.append(new)
        return frozenset(states)

    def step(self, state: frozenset, c: str) -> frozenset:
        out: set[tuple[int, int, str, bool]] = set()
        for node, edits, waits, first in state:
            if waits:
                if waits == c:
                    out.add((node, edits, "", first))
                continue
            if self.reached(self.opened, node, edits, first):
                out.add((node, edits, "", first))
            if (nxt := self.child[node].get(c)) is not None:
                out.add((nxt, edits, "", first))
            first = first or not node
            most = self.most[first]
            if edits + 1 > most[node]:
                continue
            out.add((node, edits + 1, "", first))
            for x, nxt in self.child[node].items():
                if x != c and edits + 1 <= most[nxt]:
                    out.add((nxt, edits + 1, "", first))
                if x != c and (later := self.child[nxt].get(c)) is not None and edits + 1 <= most[later]:
                    out.add((later, edits + 1, x, first))
        return self.closure(out)

    @staticmethod
    def reached(held: dict[int, tuple[int, int, bool]], node: int, edits: int, first: bool) -> bool:
        return node in held and edits <= held[node][0] and (held[node][2] or not first)

    def end(self, state: frozenset) -> tuple[int, int] | None:
        return min(((edits, held[node][1]) for node, edits, waits, first in state if not waits for held in (self.closed, self.opened) if self.reached(held, node, edits, first)), default=None)

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.steps) > MOST_STATES:
            self.fresh()
        state = self.start
        for c in word:
            known = self.steps.setdefault(state, {})
            if (nxt := known.get(c)) is None:
                nxt = known[c] = self.step(state, c)
            if not nxt:
                return None
            state = nxt
        if state not in self.ends:
            self.ends[state] = self.end(state)
        return self.ends[state]
