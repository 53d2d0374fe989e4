"""Table-driven recognition of token streams from a grammar in EBNF.

A grammar is compiled to one finite automaton per rule, whose edges are terminals or calls of other rules, with FIRST
sets and nullability. A stream is recognised by the set of all (automaton state, return stack) pairs that its tokens so
far allow, as a chart of all parses at once, so a grammar may be ambiguous; it may not be left recursive.

Stacks are shared linked nodes and sets of pairs are interned, which makes every step a table look-up the second time.
The tables grow as texts need them, and whole lines of tokens are remembered as steps of their own: code repeats its
shapes, so that most lines cost one look-up. The tables are emptied when they hold too many nodes, within a text too; the
state reached so far is all that has to stay.

Syntax of grammars: ``rule = alternatives ;`` with ``|``, ``( )``, ``[ ]`` (optional), ``{ }`` (any number), ``'x'``
(literal token), capitals (token class), small letters (rule) and ``<rule ! 'x' 'y'>`` (rule that may not begin so).
"""

from __future__ import annotations

import re

_SYNTAX = re.compile(r"\s+|#[^\n]*|'([^'\s]+)'|([A-Z][A-Z_0-9]*)|([a-z][a-z_0-9]*)|([=;|()\[\]{}<>!])")
LIMIT = 300_000


class _Node:
    __slots__ = ("back", "up")

    def __init__(self, back: int, up):
        self.back, self.up = back, up


class _Set:
    __slots__ = ("lines", "pairs", "step")

    def __init__(self, pairs):
        self.pairs, self.step, self.lines = pairs, {}, {}


class Grammar:
    """Compiled grammar. ``code[name]`` is the character that stands for a terminal in token strings."""

    def __init__(self, text: str, start: str, *, optional_newline: bool = False):
        self._tokens = [m.groups() for m in _SYNTAX.finditer(text) if m.group().strip() and not m.group().startswith("#")]
        self._at = 0
        self.code: dict[str, str] = {}
        self.terms: list[dict[str, int]] = []
        self.calls: list[list[tuple[str, int, frozenset]]] = []
        self.final: list[bool] = []
        self._eps: list[list[int]] = []
        self._nfa: list[list[tuple]] = []
        self.start_of: dict[str, int] = {}
        trees: dict[str, tuple[int, int]] = {}
        while self._at < len(self._tokens):
            name = self._next()[2]
            assert self._next()[3] == "="
            trees[name] = self._alternatives()
            assert self._next()[3] == ";", name
        for name, (a, b) in trees.items():
            self.start_of[name] = self._determine(a, b)
        self.eof = self.code.setdefault("EOF", chr(0x4E00 + len(self.code)))
        self.newline = self.code.get("NL") if optional_newline else None
        self._firsts()
        self.tail = [self.final[q] and not self.terms[q] and not self.calls[q] for q in range(len(self.final))]
        self._start = self.start_of[start]
        self._clear()

    # -- reading -----------------------------------------------------------------------------------------------------
    def _peek(self):
        return self._tokens[self._at] if self._at < len(self._tokens) else (None,) * 4

    def _next(self):
        self._at += 1
        return self._tokens[self._at - 1]

    def _new(self) -> int:
        self._eps.append([])
        self._nfa.append([])
        return len(self._eps) - 1

    def _char(self, name: str) -> str:
        return self.code.setdefault(name, chr(0x4E00 + len(self.code)))

    def _alternatives(self):
        a, b = self._new(), self._new()
        while True:
            x, y = self._sequence()
            self._eps[a].append(x)
            self._eps[y].append(b)
            if self._peek()[3] != "|":
                return a, b
            self._next()

    def _sequence(self):
        a = cur = self._new()
        while True:
            lit, cls, rule, sign = self._peek()
            if lit or cls:
                self._next()
                end = self._new()
                self._nfa[cur].append(("t", self._char(lit or cls), end))
            elif rule:
                self._next()
                end = self._new()
                self._nfa[cur].append(("r", rule, frozenset(), end))
            elif sign == "<":
                self._next()
                rule = self._next()[2]
                assert self._next()[3] == "!"
                barred = set()
                while self._peek()[3] != ">":
                    t = self._next()
                    barred.add(self._char(t[0] or t[1]))
                self._next()
                end = self._new()
                self._nfa[cur].append(("r", rule, frozenset(barred), end))
            elif sign in ("(", "[", "{"):
                self._next()
                x, y = self._alternatives()
                self._next()
                end = self._new()
                self._eps[cur].append(x)
                self._eps[y].append(end)
                if sign != "(":
                    self._eps[cur].append(end)
                if sign == "{":
                    self._eps[y].append(x)
            else:
                return a, cur
            cur = end

    def _determine(self, a: int, b: int) -> int:
        def closed(xs):
            seen, work = set(xs), list(xs)
            while work:
                for y in self._eps[work.pop()]:
                    if y not in seen:
                        seen.add(y)
                        work.append(y)
            return frozenset(seen)

        known: dict[frozenset, int] = {}

        def state(xs) -> int:
            if xs in known:
                return known[xs]
            q = known[xs] = len(self.terms)
            self.terms.append({})
            self.calls.append([])
            self.final.append(b in xs)
            edges: dict[tuple, set] = {}
            for x in sorted(xs):
                for e in self._nfa[x]:
                    edges.setdefault(e[:-1], set()).add(e[-1])
            for e, to in edges.items():
                target = state(closed(to))
                if e[0] == "t":
                    self.terms[q][e[1]] = target
                else:
                    self.calls[q].append((e[1], target, e[2]))
            return q

        return state(closed({a}))

    def _firsts(self) -> None:
        self.nullable: set[str] = set()
        self.first: dict[str, set[str]] = {r: set() for r in self.start_of}
        changed = True
        while changed:
            changed = False
            for r, q0 in self.start_of.items():
                seen, work, got, empty = set(), [q0], set(), False
                while work:
                    q = work.pop()
                    if q in seen:
                        continue
                    seen.add(q)
                    got |= set(self.terms[q])
                    empty |= self.final[q]
                    for c, to, barred in self.calls[q]:
                        got |= self.first[c] - barred
                        if c in self.nullable:
                            work.append(to)
                if not got <= self.first[r] or (empty and r not in self.nullable):
                    self.first[r] |= got
                    changed = True
                    if empty:
                        self.nullable.add(r)

    # -- recognising -------------------------------------------------------------------------------------------------
    def _clear(self) -> None:
        self._nodes: dict[tuple[int, int], _Node] = {}
        self._sets: dict[frozenset, _Set] = {}
        self._known_lines = 0
        self._root = self._intern({(self._start, None)})

    def _intern(self, pairs) -> _Set:
        k = frozenset(pairs)
        s = self._sets.get(k)
        if s is None:
            s = self._sets[k] = _Set(k)
        return s

    def _step(self, s: _Set, t: str) -> _Set | None:
        out, seen, work = set(), set(), list(s.pairs)
        terms, calls, final, first, start_of, nullable, tail, nodes = self.terms, self.calls, self.final, self.first, self.start_of, self.nullable, self.tail, self._nodes
        while work:
            pair = work.pop()
            if pair in seen:
                continue
            seen.add(pair)
            q, up = pair
            to = terms[q].get(t)
            if to is not None:
                out.add((to, up))
            for rule, back, barred in calls[q]:
                if t in first[rule] and t not in barred:
                    if tail[back]:
                        work.append((start_of[rule], up))
                    else:
                        k = (back, id(up))
                        node = nodes.get(k)
                        if node is None:
                            node = nodes[k] = _Node(back, up)
                        work.append((start_of[rule], node))
                if rule in nullable:
                    work.append((back, up))
            if final[q] and up is not None:
                work.append((up.back, up.up))
        if t == self.newline:
            out |= s.pairs
        return self._intern(out) if out else None

    def _full(self) -> bool:
        return len(self._nodes) + len(self._sets) + self._known_lines > LIMIT

    def begin(self) -> _Set:
        if self._full():
            self._clear()
        return self._root

    def advance(self, s: _Set, line: str) -> _Set | None:
        """The set after a line of tokens, None if some token fits no parse."""
        hit = s.lines.get(line, 0)
        if hit != 0:
            return hit
        if self._full():  # forget all but the state at hand, whose nodes its pairs keep
            self._clear()
            s.step, s.lines = {}, {}
            self._sets[s.pairs] = s
        cur: _Set | None = s
        for t in line:
            nxt = cur.step.get(t, 0)
            if nxt == 0:
                nxt = cur.step[t] = self._step(cur, t)
            cur = nxt
            if cur is None:
                break
        s.lines[line] = cur
        self._known_lines += 1
        return cur
