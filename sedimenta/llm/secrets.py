"""Secret scans (operator 9): combined deterministic automaton.

All rules are compiled together: each regex becomes a nondeterministic automaton over bytes, their union that may
start anywhere is made deterministic by subset construction and then minimal. One pass of this automaton over the
bytes of a batch of texts tells where matches of which rule end; minimal automata of the reversed rules, run backwards
from there, tell where they start.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _parser as sre

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.llm.common import in_arrow, table, worker_value


@dataclass(frozen=True)
class Rule:
    """``pattern`` has one greedy way to match from any start and no line break; ``least``: characters of its last group, or of all."""

    kind: str
    pattern: str
    least: int = 1


# The three base kinds, in this order.
BASE = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # any run is as good as its longest start, so a shorter bound than 32 keeps the automaton small and changes nothing
    Rule("hex", r"[0-9a-f]{8,}", 32),
)
# Formats that issuers of keys have published.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
)
RULES = BASE + MORE
# Where a key ends that the header of kind private_key begins; no kind of its own.
FOOTER = Rule("private_key_end", r"-----END [A-Z ]*PRIVATE KEY-----")


class _Graph:
    """Nondeterministic automaton: edges on sets of bytes and empty edges."""

    def __init__(self):
        self.on: list[list[tuple[frozenset, int]]] = []
        self.empty: list[list[int]] = []

    def node(self) -> int:
        self.on.append([])
        self.empty.append([])
        return len(self.on) - 1

    def add(self, items, start: int, backwards: bool, fold: bool = False) -> int:
        """Append a parsed sequence behind ``start`` and give its end."""
        for op, value in reversed(list(items)) if backwards else items:
            if op is sre.SUBPATTERN:
                start = self.add(value[3], start, backwards, fold or bool(value[1] & re.IGNORECASE))
            elif op is sre.BRANCH:
                end = self.node()
                for choice in value[1]:
                    self.empty[self.add(choice, start, backwards, fold)].append(end)
                start = end
            elif op is sre.MAX_REPEAT:
                least, most, inside = value
                for _ in range(least):
                    start = self.add(inside, start, backwards, fold)
                if most is sre.MAXREPEAT:
                    loop = self.node()
                    self.empty[start].append(loop)
                    self.empty[self.add(inside, loop, backwards, fold)].append(loop)
                    start = loop
                else:
                    end = self.node()
                    for _ in range(most - least):
                        self.empty[start].append(end)
                        start = self.add(inside, start, backwards, fold)
                    self.empty[start].append(end)
                    start = end
            else:
                end = self.node()
                self.on[start].append((_set(op, value, fold), end))
                start = end
        return start


def _set(op, value, fold: bool) -> frozenset:
    if op is sre.LITERAL:
        found = {value}
    elif op is sre.NOT_LITERAL:
        found = set(range(256)) - {value}
    elif op is sre.IN:
        found = set()
        for kind, v in value:
            if kind is sre.LITERAL:
                found.add(v)
            elif kind is sre.RANGE:
                found |= set(range(v[0], v[1] + 1))
            elif kind is not sre.NEGATE:
                raise ValueError(f"rules have no {kind}")
        if value[0][0] is sre.NEGATE:
            found = set(range(256)) - found
    else:
        raise ValueError(f"rules have no {op}")
    if fold:
        found |= {ord(s) for b in found if b < 128 for s in (chr(b).lower(), chr(b).upper())}
    return frozenset(found)


@dataclass
class Automaton:
    """``step[state * classes + class]``: next state times ``classes``; ``ends``: the rules (bits) that end there, same index."""

    classes: int
    of_byte: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    first: int
    dead: int


def automaton(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """Minimal deterministic automaton of byte patterns, by subset construction and refinement of partitions."""
    graph = _Graph()
    root = graph.node()
    accept = {graph.add(sre.parse(p.encode("latin-1")), root, backwards): 1 << k for k, p in enumerate(patterns)}
    # bytes that no edge tells apart are one class
    sets = {s for edges in graph.on for s, _ in edges}
    rows = np.array([[b in s for s in sets] for b in range(256)], np.uint8).reshape(256, -1)
    _, sample, of_byte = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    classes = len(sample)
    moves = [[[t for s, t in edges if int(b) in s] for b in sample] for edges in graph.on]

    def closed(nodes) -> frozenset:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for t in graph.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)

    start = closed([root])
    numbers, order, table_ = {start: 0}, [start], []
    for state in order:
        row = []
        for c in range(classes):
            target = {t for s in state for t in moves[s][c]}
            goal = closed(target | ({root} if anywhere else set()))
            if goal not in numbers:
                numbers[goal] = len(order)
                order.append(goal)
            row.append(numbers[goal])
        table_.append(row)
    step = np.array(table_)
    ends = np.array([sum({accept[s] for s in state if s in accept}) for state in order])
    # equal states have equal outputs and go to equal states
    _, block = np.unique(ends, return_inverse=True)
    while True:
        _, now = np.unique(np.c_[block, block[step]], axis=0, return_inverse=True)
        now = now.reshape(-1)
        if now.max() == block.max():
            break
        block = now
    _, chosen = np.unique(block, return_index=True)
    step, ends = block[step[chosen]], ends[chosen]
    dead = next((k for k in range(len(chosen)) if not ends[k] and (step[k] == k).all()), -1)
    return Automaton(
        classes, of_byte.reshape(-1).astype(np.uint8), (step * classes).reshape(-1).astype(np.int32),
        ends[step].reshape(-1).astype(np.int32), int(block[0]) * classes, dead * classes,
    )


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES, lane: int = 2048):
        self.rules, self._lane = rules, lane
        self._all = automaton([r.pattern for r in rules], anywhere=True)
        self._back = [automaton([r.pattern], anywhere=False, backwards=True) for r in rules]
        self._back_class = [a.of_byte.tolist() for a in self._back]
        self._exact = [re.compile(r.pattern.encode("latin-1")) for r in rules]
        # bytes after which no rule is under way, whatever was before
        whole = self._all.step.reshape(-1, self._all.classes)
        resets = (whole == self._all.first).all(axis=0)
        if not resets[self._all.of_byte[10]]:
            raise ValueError("rules must not match across lines")
        self._reset = resets[self._all.of_byte]

    def ends(self, data: np.ndarray) -> list[tuple[int, int]]:
        """(end, rules as bits) where matches end for good, over bytes whose last one is a line break.

        The bytes are cut into lanes behind bytes that end every match; all lanes step through the automaton together.
        """
        cuts = np.flatnonzero(self._reset[data]) + 1
        wanted = np.arange(self._lane, len(data), self._lane)
        starts = np.unique(np.r_[0, cuts[np.searchsorted(cuts, wanted).clip(max=len(cuts) - 1)]])
        starts = starts[starts < len(data)]
        lengths = np.diff(np.r_[starts, len(data)])
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        classes, a = self._all.of_byte[data], self._all
        state, open_ = np.full(len(starts), a.first, np.int32), np.zeros(len(starts), np.int32)
        # lanes that have a byte at each place
        active = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")
        found = []
        for k in range(int(lengths[0])):
            m = int(active[k])
            at = state[:m] + classes[starts[:m] + k]
            now = a.ends[at]
            gone = open_[:m] & ~now
            if gone.any():
                hit = np.flatnonzero(gone)
                found += zip((starts[hit] + k).tolist(), gone[hit].tolist())
            state[:m], open_[:m] = a.step[at], now
        return sorted(found)

    def _start(self, rule: int, text: bytes, end: int, floor: int) -> int | None:
        """First place from ``floor`` on where a match of the rule starts that ends at ``end``."""
        a, classes = self._back[rule], self._back_class[rule]
        state, best = a.first, None
        for k in range(end - 1, floor - 1, -1):
            at = state + classes[text[k]]
            state = a.step[at]
            if state == a.dead:
                break
            if a.ends[at]:
                best = k
        return best

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule number, end) in code points, leftmost and without overlaps for each rule."""
        coded = [t.encode("utf-8", "replace") for t in texts]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
        begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
        floors: dict[tuple[int, int], int] = {}
        for end, bits in self.ends(data):
            n = int(np.searchsorted(begins, end, side="right")) - 1
            text, stop = coded[n], end - int(begins[n])
            for rule in range(len(self.rules)):
                if not bits >> rule & 1:
                    continue
                start = self._start(rule, text, stop, floors.get((n, rule), 0))
                if start is None:
                    continue
                floors[n, rule] = stop
                match = self._exact[rule].fullmatch(text, start, stop)
                if len(match[match.lastindex or 0]) >= self.rules[rule].least:
                    place = (start, stop) if len(text) == len(texts[n]) else tuple(len(text[:x].decode()) for x in (start, stop))
                    out[n].append((place[0], rule, place[1]))
        return [sorted(spans) for spans in out]


def spelled(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)


def whole_keys(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...], length: int) -> list[tuple[int, int, int]]:
    """Each header of a private key joined with the next footer into one span, up to the text's end where there is none.

    Headers inside such a span are part of it; footers are no spans of their own.
    """
    ends = [e for _, k, e in spans if rules[k] == FOOTER]
    out, open_to, n = [], 0, 0
    for start, k, end in spans:
        if rules[k] == FOOTER:
            continue
        if rules[k].kind == "private_key":
            if start < open_to:
                continue
            while n < len(ends) and ends[n] <= end:
                n += 1
            end = open_to = ends[n] if n < len(ends) else length
        out.append((start, k, end))
    return sorted(out)


def _scanned(batches, scanner: Scanner, size: int = 4_000_000):
    """(row, spans) of every row, some million characters at a time, private keys whole. Null texts as empty."""
    held, chars = [], 0

    def scanned():
        texts = [r[-1] or "" for r in held]
        return zip(held, (whole_keys(s, scanner.rules, len(t)) for s, t in zip(scanner.spans(texts), texts)))

    for columns in batches:
        for row in zip(*columns):
            held.append(row)
            chars += len(row[-1] or "")
            if chars > size:
                yield from scanned()
                held, chars = [], 0
    yield from scanned()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[Rule, ...] = MORE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every whole text.

    Spans are ``kind:start:end`` in code points, end exclusive, ordered by start and then as the rules are listed, for
    each rule leftmost and without overlaps; a private key is one span from its header to the end of its footer, or of the
    text where there is none; ``base_sha256`` covers the base kinds only. Null texts count as empty and
    have none. Repeated rows stay, a null id stays null, other columns are ignored.
    """
    rules = BASE + more
    # compiled once, on the driver; its size depends on the rules only
    scanner = worker_value(Scanner, (*rules, FOOTER))

    def rows(batches):
        for (i, _), spans in _scanned(batches, scanner):
            base = [s for s in spans if s[1] < len(BASE)]
            yield (
                i, *(sum(k == n for _, k, _ in base) for n in range(len(BASE))),
                hashlib.sha256(spelled(base, rules).encode()).hexdigest(), spelled(spans, rules),
            )

    chosen = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return in_arrow(chosen, f"`{id_col}` {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string", rows)


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def redacted(text: str, spans: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are one, named by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{rules[kind].kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets are replaced in the texts, ``n_chars`` follows; every document and column stays."""
    scanner = worker_value(Scanner, (*RULES, FOOTER))

    def rows(batches):
        for (row, text), spans in _scanned(batches, scanner):
            if spans:
                clean = redacted(text, spans)
                row = {**row, "text": clean, "n_chars": len(clean)}
            yield (row,)

    packed = docs.select(F.struct("*").alias("row"), "text")
    return in_arrow(packed, f"row {packed.schema['row'].dataType.simpleString()}", rows, flush=500).select("row.*")
