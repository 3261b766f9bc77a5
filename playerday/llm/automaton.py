"""One deterministic automaton for many regular expressions over bytes."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser

import numpy as np


class _Graph:
    """A nondeterministic automaton: byte-set edges and empty edges."""

    def __init__(self):
        self.edges: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def closure(self, nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.empty[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)

    def add(self, tree, start: int, fold: bool, backwards: bool) -> int:
        """Append the parsed pattern after start; gives its end. backwards reads it from its end."""
        for op, arg in reversed(list(tree)) if backwards else tree:
            if op is sre.LITERAL:
                start = self._byte(start, {arg}, fold)
            elif op is sre.NOT_LITERAL:
                start = self._byte(start, set(range(256)) - self._folded({arg}, fold), False)
            elif op is sre.ANY:
                start = self._byte(start, set(range(256)) - {10}, False)
            elif op is sre.IN:
                start = self._byte(start, self._set(arg, fold), False)
            elif op is sre.SUBPATTERN:
                _, on, off, sub = arg
                start = self.add(sub, start, (fold or bool(on & re.I)) and not off & re.I, backwards)
            elif op is sre.BRANCH:
                end = self.node()
                for sub in arg[1]:
                    self.empty[self.add(sub, self._fork(start), fold, backwards)].append(end)
                start = end
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
                least, most, sub = arg
                for _ in range(least):
                    start = self.add(sub, start, fold, backwards)
                if most is sre.MAXREPEAT:
                    loop = self._fork(start)
                    self.empty[self.add(sub, loop, fold, backwards)].append(loop)
                    start = self._fork(loop)
                else:
                    end = self.node()
                    for _ in range(most - least):
                        self.empty[start].append(end)
                        start = self.add(sub, self._fork(start), fold, backwards)
                    self.empty[start].append(end)
                    start = end
            else:
                raise ValueError(f"not a regular construct: {op}")
        return start

    def _fork(self, start: int) -> int:
        n = self.node()
        self.empty[start].append(n)
        return n

    def _byte(self, start: int, allowed: set, fold: bool) -> int:
        end = self.node()
        self.edges[start].append((frozenset(self._folded(allowed, fold)), end))
        return end

    @staticmethod
    def _folded(allowed: set, fold: bool) -> set:
        if fold:
            allowed = allowed | {ord(chr(b).swapcase()) for b in allowed if b < 128 and chr(b).isalpha()}
        return set(allowed)

    def _set(self, items, fold: bool) -> set:
        allowed: set = set()
        negate = False
        for op, arg in items:
            if op is sre.NEGATE:
                negate = True
            elif op is sre.LITERAL:
                allowed.add(arg)
            elif op is sre.RANGE:
                allowed |= set(range(arg[0], arg[1] + 1))
            else:
                raise ValueError(f"not a plain class: {op}")
        allowed = self._folded(allowed, fold)
        return set(range(256)) - allowed if negate else allowed


class Automaton:
    """Minimal deterministic automaton over bytes.

    `table` is one flat transition array: state s (a multiple of 256) on byte b
    goes to table[s + b]. States from `accept` up accept; `rules[s // 256]` is
    the bit set of the rules that end there. `dead` is the state without a way
    to accept, or -1.
    """

    def __init__(self, patterns: list[bytes], anywhere: bool, backwards: bool = False):
        graph = _Graph()
        root = graph.node()
        ends: dict[int, int] = {}
        for n, pattern in enumerate(patterns):
            ends[graph.add(_parser.parse(pattern), graph._fork(root), False, backwards)] = 1 << n
        if anywhere:
            graph.edges[root].append((frozenset(range(256)), root))
        trans, accepts = self._subsets(graph, root, ends)
        self._minimise(trans, accepts)

    @staticmethod
    def _subsets(graph: _Graph, root: int, ends: dict[int, int]):
        sets = {allowed for edges in graph.edges for allowed, _ in edges}
        signature: dict[tuple, int] = {}
        class_of = np.zeros(256, np.int64)
        for b in range(256):
            class_of[b] = signature.setdefault(tuple(b in s for s in sets), len(signature))
        sample = [int(np.argmax(class_of == c)) for c in range(len(signature))]
        first = graph.closure([root])
        number, order, rows = {first: 0}, [first], []
        for here in order:  # grows while it is walked
            row = []
            for b in sample:
                to = graph.closure([end for n in here for allowed, end in graph.edges[n] if b in allowed])
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        accepts = np.array([sum({ends[n] for n in here if n in ends}) for here in order], np.int64)
        return np.array(rows, np.int64)[:, class_of], accepts

    def _minimise(self, trans: np.ndarray, accepts: np.ndarray) -> None:
        """Refine the partition by accepted rules until no byte tells two states of a block apart."""
        columns = np.unique(trans, axis=1)
        block, blocks = np.unique(accepts, return_inverse=True)[1].ravel(), 0
        while blocks != block.max() + 1:
            blocks = block.max() + 1
            block = np.unique(np.column_stack([block, block[columns]]), axis=0, return_inverse=True)[1].ravel()
        first = np.array([np.argmax(block == n) for n in range(blocks)])
        order = np.argsort(accepts[first] != 0, kind="stable")  # accepting states last
        place = np.empty(blocks, np.int64)
        place[order] = np.arange(blocks)
        table = place[block[trans[first[order]]]]
        self.rules = accepts[first[order]].tolist()
        self.accept = 256 * sum(1 for r in self.rules if not r)
        self.start = 256 * int(place[block[0]])
        lost = [n for n in range(blocks) if not self.rules[n] and (table[n] == n).all()]
        self.dead = 256 * lost[0] if lost else -1
        self.table = (256 * table).ravel().tolist()


class Scanner:
    """Finds the matches of all rules in one pass over the bytes.

    The forward automaton of all rules together marks where matches end; a
    small backward automaton of the one rule then finds where such a match
    began. Per rule, matches are leftmost, longest and do not overlap. A rule
    must be one whose longest match from the leftmost start also ends no later
    than any match inside it (true of a prefix followed by a run of characters).
    """

    def __init__(self, rules: dict[str, bytes]):
        self.names = list(rules)
        self.forward = Automaton(list(rules.values()), anywhere=True)
        self.backward = [Automaton([p], anywhere=False, backwards=True) for p in rules.values()]

    def find(self, data: bytes) -> list[tuple[int, int, int]]:
        """(rule number, start, end) in bytes, by rule and then start."""
        table, accept, state, hits = self.forward.table, self.forward.accept, self.forward.start, []
        for at, byte in enumerate(data):
            state = table[state + byte]
            if state >= accept:
                hits.append((at, state))
        if not hits:
            return []
        found = []
        for n in range(len(self.names)):
            last = 0
            mine = [at for at, s in hits if self.forward.rules[s >> 8] >> n & 1]
            for at, after in zip(mine, [*mine[1:], -1]):
                if after != at + 1 and (start := self._start(n, data, at, last)) is not None:
                    found.append((n, start, at + 1))
                    last = at + 1
        return found

    def _start(self, n: int, data: bytes, end: int, stop: int) -> int | None:
        """The leftmost start, from stop on, of a match of rule n whose last byte is at end."""
        back, start = self.backward[n], None
        state = back.start
        for at in range(end, stop - 1, -1):
            state = back.table[state + data[at]]
            if state == back.dead:
                break
            if state >= back.accept:
                start = at
        return start
