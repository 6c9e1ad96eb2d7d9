"""Secret scans with one combined deterministic automaton.

A rule is a head pattern followed by a run of characters of one class, for
example ``AKIA`` and then ``[A-Z0-9]+``.  Each head becomes an NFA, the NFAs
become one DFA over all rules by subset construction, and partition
refinement minimises it.  The result is a flat transition array; scanning
reads each byte once, whatever the number of rules.

Matches are those of leftmost, longest, non-overlapping search for each rule;
a match whose run, or whole length, is under the rule's minimum is dropped
after it has consumed its text.  Texts are scanned as one byte for a code
point (anything beyond ASCII becomes one byte that no rule contains), so
offsets are code points.  Null and empty texts give no spans; very long texts
are scanned whole.  Repeated rows give repeated rows; an empty table gives an
empty result.  Only doc_id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type, map_rows


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least_tail: int = 1
    least_all: int = 0
    fold_head: bool = False
    base: bool = False


#: Fixed patterns of the base kinds, then those that this scan adds.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]", least_tail=6, fold_head=True, base=True),
    Rule("access", "AKIA", "[A-Z0-9]", least_all=20, base=True),
    Rule("hex", "", "[0-9a-f]", least_tail=24, base=True),
    Rule("forge", "gh(p|o|u|s|r)_", "[A-Za-z0-9]", least_tail=36),
    Rule("chat", "xox(a|b|p|r|s)-", "[A-Za-z0-9-]", least_tail=10),
    Rule("cloud", "AIza", "[A-Za-z0-9_-]", least_tail=35),
    Rule("jwt", "eyJ", "[A-Za-z0-9_.-]", least_tail=40),
    Rule("pem", "-----BEGIN\\x20", "[A-Z\\x20-]", least_tail=16),
)
#: Runs shorter than this (or than the rule's minimum) begin and end without an event.
QUIET = 4


class Parser:
    """Literals, classes, groups, alternation and the marks ? * + over bytes, to nested tuples."""

    def __init__(self, source: str, fold: bool):
        self.s, self.i, self.fold = source, 0, fold

    def parse(self) -> tuple:
        tree = self.choice()
        if self.i < len(self.s):
            raise ValueError(f"can't read {self.s[self.i :]!r}")
        return tree

    def choice(self) -> tuple:
        ways = [self.chain()]
        while self.s[self.i : self.i + 1] == "|":
            self.i += 1
            ways.append(self.chain())
        return ways[0] if len(ways) == 1 else ("or", *ways)

    def chain(self) -> tuple:
        items = []
        while self.i < len(self.s) and self.s[self.i] not in "|)":
            item = self.atom()
            while self.s[self.i : self.i + 1] in ("?", "*", "+"):
                item = (self.s[self.i], item)
                self.i += 1
            items.append(item)
        return ("cat", *items)

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self) -> tuple:
        c = self.s[self.i]
        if c == "(":
            self.i += 1
            tree = self.choice()
            if self.s[self.i : self.i + 1] != ")":
                raise ValueError("group isn't closed")
            self.i += 1
            return tree
        if c == "[":
            return ("set", self.members())
        return ("set", self.folded({self.char()}))

    def members(self) -> frozenset[int]:
        self.i += 1
        found: set[int] = set()
        while self.s[self.i] != "]":
            a = self.char()
            if self.s[self.i] == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found.update(range(a, self.char() + 1))
            else:
                found.add(a)
        self.i += 1
        return self.folded(found)

    def folded(self, found: set[int]) -> frozenset[int]:
        if max(found, default=0) > 127:
            raise ValueError("rules are over ASCII")
        if self.fold:
            found = found | {ord(f(chr(x))) for x in found for f in (str.lower, str.upper)}
        return frozenset(found)


def reverse(tree: tuple) -> tuple:
    if tree[0] == "set":
        return tree
    if tree[0] == "cat":
        return ("cat", *map(reverse, tree[:0:-1]))
    return (tree[0], *map(reverse, tree[1:]))


class Nfa:
    """Thompson's construction; state 0 is the start and `last` accepts."""

    def __init__(self, tree: tuple):
        self.free: list[list[int]] = [[]]
        self.steps: list[list[tuple[frozenset[int], int]]] = [[]]
        self.last = self.build(tree, 0)

    def new(self) -> int:
        self.free.append([])
        self.steps.append([])
        return len(self.free) - 1

    def build(self, tree: tuple, at: int) -> int:
        kind = tree[0]
        if kind == "set":
            to = self.new()
            self.steps[at].append((tree[1], to))
            return to
        if kind == "cat":
            for part in tree[1:]:
                at = self.build(part, at)
            return at
        out = self.new()
        if kind == "or":
            for part in tree[1:]:
                begin = self.new()
                self.free[at].append(begin)
                self.free[self.build(part, begin)].append(out)
            return out
        begin = self.new()
        self.free[at].append(begin)
        end = self.build(tree[1], begin)
        self.free[end].append(out)
        if kind in "*+":
            self.free[end].append(begin)
        if kind in "*?":
            self.free[at].append(out)
        return out

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)

    def step(self, states, byte: int) -> list[int]:
        return [to for s in states for chars, to in self.steps[s] if byte in chars]


class RuleMachine:
    """One rule as a machine with events: its states are sets of head states, or the number of run bytes read so far."""

    def __init__(self, rule: Rule):
        tree = Parser(rule.head, rule.fold_head).parse()
        self.tail = Parser(rule.tail, False).members()
        self.nfa = Nfa(tree)
        self.begin = self.nfa.close([0])
        self.start = ("head", self.begin)
        self.quiet = max(1, min(QUIET, rule.least_tail))
        back = Nfa(reverse(tree))
        self.back = (back, back.close([0]))
        seen, todo = {self.begin}, [self.begin]
        while todo:  # the head alone, from one start
            what = todo.pop()
            for byte in range(128):
                to = self.nfa.close(self.nfa.step(what, byte))
                if to and byte in self.tail and self.nfa.last in what:
                    raise ValueError("a head that can go on with a byte of its run is ambiguous")
                if to and to not in seen:
                    seen.add(to)
                    todo.append(to)

        self.known: dict = {}

    def step(self, state, byte: int):
        """Next state and the event: 0 none, 1 a run has reached the quiet length, 2 it has ended before this byte."""
        if (state, byte) not in self.known:
            self.known[state, byte] = self.found(state, byte)
        return self.known[state, byte]

    def found(self, state, byte: int):
        kind, what = state
        event = 0
        if kind == "run":
            if byte in self.tail:
                if what == self.quiet:
                    return state, 0
                return ("run", what + 1), int(what + 1 == self.quiet)
            event, what = 2 * (what == self.quiet), self.begin
        if self.nfa.last in what and byte in self.tail:
            return ("run", 1), event or int(self.quiet == 1)
        return ("head", self.nfa.close([*self.nfa.step(what, byte), 0])), event


def minimised(moves: list[list[tuple]], marks: list) -> list[int]:
    """Class of each state, by partition refinement over (mark, event and class of each move)."""
    ids: dict = {}
    of = [ids.setdefault(m, len(ids)) for m in marks]
    while True:
        ids = {}
        new = [ids.setdefault((of[i], *((of[to], event) for to, event in row)), len(ids)) for i, row in enumerate(moves)]
        if len(ids) == len(set(of)):
            return new
        of = new


class Scanner:
    """The combined automaton of the rules, as arrays."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        machines = [RuleMachine(r) for r in rules]
        # bytes that no rule tells apart share a column
        groups: dict[tuple, int] = {}
        kinds = bytearray(256)
        sample: list[int] = []
        sets = [c for m in machines for c in [m.tail, *(c for row in m.nfa.steps for c, _ in row)]]
        for b in range(256):
            key = tuple(b in s for s in sets)
            if key not in groups:
                groups[key] = len(groups)
                sample.append(b)
            kinds[b] = groups[key]
        start = tuple(m.start for m in machines)
        number, order, moves = {start: 0}, [start], []
        while len(moves) < len(order):
            state, row = order[len(moves)], []
            for b in sample:
                both = [m.step(s, b) for m, s in zip(machines, state)]
                to = tuple(x for x, _ in both)
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append((number[to], tuple(e for _, e in both)))
            moves.append(row)
        running = [tuple(s[0] == "run" and s[1] == m.quiet for m, s in zip(machines, state)) for state in order]
        of = minimised(moves, running)
        self.states_before, self.states = len(order), max(of) + 1
        width = len(sample)
        table, events, event_ids = [0] * (self.states * width), [], {}
        for i, row in enumerate(moves):
            for k, (to, what) in enumerate(row):
                target = of[to] * width
                if any(what):
                    key = (target, what)
                    if key not in event_ids:
                        event_ids[key] = len(events)
                        events.append((target, tuple(r for r, e in enumerate(what) if e == 1), tuple(r for r, e in enumerate(what) if e == 2)))
                    target = ~event_ids[key]
                table[of[i] * width + k] = target
        self.table, self.events, self.kinds, self.first = table, events, bytes(kinds), of[0] * width
        self.quiet = [m.quiet for m in machines]
        self.back = [m.back if r.head else None for m, r in zip(machines, rules)]

    def head_start(self, rule: int, data: bytes, at: int) -> int:
        """Where the head that ends at `at` begins."""
        if self.back[rule] is None:
            return at
        nfa, states = self.back[rule]
        i, best = at, at
        while states and i > 0:
            i -= 1
            states = nfa.close(nfa.step(states, data[i]))
            if nfa.last in states:
                best = i
        return best

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, rule, end) of every match, by start, then rule."""
        if not text:
            return []
        data = text.encode("ascii", "replace")
        table, state, events = self.table, self.first, self.events
        began = [-1] * len(self.rules)
        out: list[tuple[int, int, int]] = []

        def end(rule: int, at: int) -> None:
            run, what = began[rule], self.rules[rule]
            began[rule] = -1
            if at - run >= what.least_tail:
                start = self.head_start(rule, data, run)
                if at - start >= what.least_all:
                    out.append((start, rule, at))

        for i, c in enumerate(data.translate(self.kinds)):
            state = table[state + c]
            if state < 0:
                state, begins, ends = events[~state]
                for r in ends:
                    end(r, i)
                for r in begins:
                    began[r] = i - self.quiet[r] + 1
        for r, run in enumerate(began):
            if run >= 0:
                end(r, len(data))
        out.sort()
        return out


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind, base_sha256 and spans, for every document."""
    scanner = Scanner(rules)
    base = [i for i, r in enumerate(rules) if r.base]

    def make():
        def row(doc_id, text):
            found = scanner.spans(text)
            said = [f"{rules[r].kind}:{a}:{b}" for a, r, b in found]
            mine = ",".join(s for s, f in zip(said, found) if rules[f[1]].base)
            counts = [sum(f[1] == r for f in found) for r in base]
            return doc_id, *counts, hashlib.sha256(mine.encode()).hexdigest(), ",".join(said)

        return row

    names = [f"n_{rules[r].kind}" for r in base]
    kind, arrow = id_type(documents)
    fields = [("doc_id", arrow), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())]
    return map_rows(documents, ["doc_id", "text"], make, fields, f"doc_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", base_sha256 string, spans string")
