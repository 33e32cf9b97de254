"""Secret scanning by one deterministic automaton over bytes.

All rules are compiled into one NFA, made deterministic by subset construction over classes of equal bytes, and minimised
by partition refinement into one transition array. It is that of the rules read backwards, so that it accepts at the byte
where a match begins. A batch of texts is one buffer, scanned once from its end: it is cut into lanes that step together,
each lane starting in the state in which the one before it ended (lanes whose guess of that state was wrong are run again
until all agree, so the result is that of one pass). No rule holds a newline, and texts are joined by one, so that none
reaches over.

From the first marked byte of a rule its own minimised automaton runs to the end of the longest match, and goes on at the
next mark behind it: spans are leftmost, longest, not overlapping per kind, as a backtracking matcher finds them for these
rules, and only bytes of matches are read again. Matches that miss the rule's least length are dropped but consume their bytes.

Edge cases: null counts as empty; a text without secrets has empty ``spans`` and the digest of the empty string; repeated
rows get equal results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm._common import map_arrow, text_slices


class Rule(NamedTuple):
    kind: str
    pattern: str
    any_case: bool = False
    least: int = 0  # characters of the match, or of what follows the separator if ``value``
    value: bool = False
    scan: str = ""  # pattern for the scan where it can ask for the least length at once


#: In this order ties of spans are told.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24, scan=r"[0-9a-f]{24}[0-9a-f]*"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]+", least=15),
)
BASE = ("assign", "access", "hex")


class _Nfa:
    """Thompson construction; edges over byte sets, and empty ones."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def build(self, pattern: str, any_case: bool) -> tuple[int, int]:
        self.p, self.i, self.ci = pattern, 0, any_case
        out = self._either()
        if self.i != len(pattern):
            raise ValueError(f"can't read {pattern!r} at {self.i}")
        return out

    def _either(self) -> tuple[int, int]:
        a, b = self._sequence()
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            c, d = self._sequence()
            s, e = self.state(), self.state()
            self.empty[s] += [a, c]
            self.empty[b].append(e)
            self.empty[d].append(e)
            a, b = s, e
        return a, b

    def _sequence(self) -> tuple[int, int]:
        a = b = self.state()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            c, d = self._repeated()
            self.empty[b].append(c)
            b = d
        return a, b

    def _repeated(self) -> tuple[int, int]:
        at = self.i
        a, b = self._atom()
        end = self.i
        sign = self.p[self.i : self.i + 1]
        if sign and sign in "?*+":
            self.i += 1
            s, e = self.state(), self.state()
            self.empty[s].append(a)
            self.empty[b].append(e)
            if sign in "?*":
                self.empty[s].append(e)
            if sign in "*+":
                self.empty[b].append(a)
            return s, e
        if sign == "{":
            close = self.p.index("}", self.i)
            n = int(self.p[self.i + 1 : close])
            for _ in range(n - 1):
                self.i = at
                c, d = self._atom()
                self.empty[b].append(c)
                b = d
            assert self.i == end
            self.i = close + 1
        return a, b

    def _atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self._either()
            self.i += 1
            return out
        got = self._class() if c == "[" else frozenset([self._byte()])
        if self.ci:
            got |= frozenset(x ^ 32 for x in got if 65 <= x <= 90 or 97 <= x <= 122)
        if 10 in got:
            raise ValueError("a rule may not hold a newline")
        s, e = self.state(), self.state()
        self.edges[s].append((got, e))
        return s, e

    def _byte(self) -> int:
        c = self.p[self.i]
        self.i += 1
        if c == "\\":
            c = self.p[self.i]
            self.i += 1
            if c == "x":
                self.i += 2
                return int(self.p[self.i - 2 : self.i], 16)
        return ord(c)

    def _class(self) -> frozenset:
        self.i += 1
        got: set[int] = set()
        while self.p[self.i] != "]":
            lo = self._byte()
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                got.update(range(lo, self._byte() + 1))
            else:
                got.add(lo)
        self.i += 1
        return frozenset(got)


class Automaton(NamedTuple):
    next: np.ndarray  # states x 256
    accept: np.ndarray  # bit mask of rules per state
    start: int
    dead: int  # the state nothing leaves, or -1


def compile_rules(patterns: Iterable[tuple[str, bool]], backwards: bool) -> Automaton:
    """Minimal deterministic automaton of all patterns; ``backwards``: of the patterns reversed, and anywhere in a text."""
    nfa = _Nfa()
    built = [nfa.build(pattern, any_case) for pattern, any_case in patterns]
    if backwards:
        empty, edges = nfa.empty, nfa.edges
        nfa.empty, nfa.edges = [[] for _ in empty], [[] for _ in edges]
        for s in range(len(empty)):
            for t in empty[s]:
                nfa.empty[t].append(s)
            for got, t in edges[s]:
                nfa.edges[t].append((got, s))
        built = [(b, a) for a, b in built]
    first = nfa.state()
    nfa.empty[first] += [a for a, _ in built]
    ends = {b: k for k, (_, b) in enumerate(built)}
    # classes of bytes that no edge tells apart
    sets = {s for es in nfa.edges for s, _ in es}
    kinds: dict[tuple, int] = {}
    of = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)])
    one = [int(np.flatnonzero(of == k)[0]) for k in range(len(kinds))]

    @lru_cache(None)
    def closure(s: int) -> frozenset:
        seen, todo = {s}, [s]
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(x for x in seen if nfa.edges[x] or x in ends)

    start = closure(first)
    index, todo, rows = {start: 0}, [start], []
    for state in todo:
        row = []
        for k in range(len(kinds)):
            into: set[int] = set(start) if backwards else set()
            for s in state:
                for got, t in nfa.edges[s]:
                    if one[k] in got:
                        into |= closure(t)
            key = frozenset(into)
            if key not in index:
                index[key] = len(index)
                todo.append(key)
            row.append(index[key])
        rows.append(row)
    step = np.array(rows)
    accept = np.array([sum(1 << ends[s] for s in state if s in ends) for state in todo], np.int64)
    block = np.unique(accept, return_inverse=True)[1]
    while True:
        _, finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    n = int(block.max()) + 1
    rep = np.zeros(n, np.int64)
    rep[block] = np.arange(len(block))
    small = block[step[rep]]
    dead = [s for s in range(n) if (small[s] == s).all() and not accept[rep][s]]
    return Automaton(small[:, of].astype(np.int32), accept[rep], int(block[0]), dead[0] if dead else -1)


@lru_cache(None)
def combined() -> Automaton:
    return compile_rules([(r.scan or r.pattern, r.any_case) for r in RULES], True)


@lru_cache(None)
def single(k: int) -> tuple[list[list[int]], list[bool], int, int]:
    a = compile_rules([(RULES[k].pattern, RULES[k].any_case)], False)
    return a.next.tolist(), [bool(x) for x in a.accept], a.start, a.dead


LANE = 192


def scan(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of data at which a match of a rule begins, ascending, and the masks of rules."""
    a = combined()
    n = len(data)
    lanes = max(1, -(-n // LANE))
    grid = np.full(lanes * LANE, 10, np.uint8)
    grid[:n] = data[::-1]
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    states = np.zeros((LANE, lanes), np.int32)
    table = a.next.ravel()
    begin = np.full(lanes, a.start, np.int32)
    todo = np.arange(lanes)
    while len(todo):
        s = begin[todo].astype(np.int64)
        part = grid[:, todo] if len(todo) < lanes else grid
        for k in range(LANE):
            s = table[s * 256 + part[k]]
            states[k, todo] = s
        real = np.concatenate([[a.start], states[-1, :-1]])
        todo = np.flatnonzero(real != begin)
        begin = real
    hit = a.accept[states] != 0
    k, lane = np.nonzero(hit)
    at = n - 1 - (lane * LANE + k)
    order = np.argsort(at)
    return at[order], a.accept[states[k, lane]][order]


def follow(text: bytes, k: int, begins: list[int]) -> list[tuple[int, int]]:
    """Spans (bytes) of rule k in text, given all positions at which a match of it begins, ascending."""
    rule = RULES[k]
    step, accept, start, dead = single(k)
    out, i, n = [], 0, len(text)
    for p in begins:
        if p < i:
            continue
        s, end, q = start, -1, p
        while q < n:
            s = step[s][text[q]]
            if s == dead:
                break
            q += 1
            if accept[s]:
                end = q
        i = end
        length = end - p
        if rule.value:
            v = p
            while text[v] not in b":=":
                v += 1
            v += 1
            while text[v] == 32:
                v += 1
            v += text[v] in b"\"'"
            length = end - v
        if length >= rule.least:
            out.append((p, end))
    return out


def spans(text: bytes, at: np.ndarray, masks: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, ascending, given where matches of which rules begin."""
    found = sorted((p, k, e) for k in range(len(RULES)) for p, e in follow(text, k, at[masks >> k & 1 == 1].tolist()))
    if not text.isascii():
        ahead = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        found = [(int(ahead[p]), k, int(ahead[e])) for p, k, e in found]
    return found


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [r.kind for r in RULES]
    base = [names.index(b) for b in BASE]
    told = lambda xs: ",".join(f"{names[k]}:{p}:{e}" for p, k, e in xs)
    nothing = hashlib.sha256(b"").hexdigest()
    for t in text_slices(batches):
        docs = len(t.off) - 1
        lengths = np.diff(t.off)
        joined = np.full(len(t.data) + docs, 10, np.uint8)
        joined[np.arange(len(t.data)) + np.repeat(np.arange(docs), lengths)] = t.data
        at, masks = scan(joined)
        counts = np.zeros((docs, len(base)), np.int64)
        sha, all_ = [nothing] * docs, [""] * docs
        if len(at):
            first = np.searchsorted(at, t.off + np.arange(docs + 1))
            for d in np.flatnonzero(np.diff(first)).tolist():
                mine = slice(first[d], first[d + 1])
                got = spans(t.data[t.off[d] : t.off[d + 1]].tobytes(), at[mine] - t.off[d] - d, masks[mine])
                mine = [x for x in got if x[1] in base]
                for j, k in enumerate(base):
                    counts[d, j] = sum(x[1] == k for x in mine)
                sha[d] = hashlib.sha256(told(mine).encode()).hexdigest()
                all_[d] = told(got)
        yield pa.RecordBatch.from_arrays([t.rows.column(0), *(pa.array(counts[:, j]) for j in range(len(base))), pa.array(sha), pa.array(all_)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    return map_arrow(docs.select("doc_id", "text"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
