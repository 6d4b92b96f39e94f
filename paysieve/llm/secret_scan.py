"""Secret scans with one deterministic automaton for all rules.

Every rule's expression becomes an automaton by subset construction; the union of all, free to begin anywhere, is
minimised into one transition array. A text is read by it once, byte by byte: bytes that send every state back to the
start cut the text into lanes, and numpy advances all lanes of a slice together. Lanes in which a rule accepted are read
again by that rule's own anchored array, which yields the leftmost, longest, non-overlapping spans.

Narrow: no shuffle, so neither hot sources nor copies matter; memory follows the slice. Null texts are empty and have no
spans. Repeated rows get equal results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysieve.llm import buffers as B


@dataclass(frozen=True)
class Rule:
    """`pattern` gives the spans, of which those shorter than `least` (in its last class run, or as a whole) are dropped;
    `scan` is an expression that occurs wherever a span that stays does, and is what the combined automaton looks for."""

    kind: str
    pattern: str
    scan: str
    least: int = 1
    tail: str = ""  # bytes of the run whose length is measured; empty: the whole span


_KEYWORD = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN + r"[A-Za-z0-9+/_.=-]{6}", 6, r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)\Z"),
    Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]", 20),
    Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 24),
)
EXTRA = (
    Rule("key_block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN "),
    Rule("code_host", r"gh[opsru]_[A-Za-z0-9]+", r"gh[opsru]_[A-Za-z0-9]", 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-", 20),
    Rule("map_key", r"AIza[A-Za-z0-9_-]+", r"AIza[A-Za-z0-9]", 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9]", 40),
)
RULES = BASE + EXTRA
FEW_LANES = 16  # fewer than these are read one by one


def _nfa(pattern: str, steps: list, free: list) -> tuple[int, int]:
    """Fragment of an automaton: steps[state] = [(byte set, state)], free[state] = states reached without a byte."""
    parser = re._parser

    def state() -> int:
        steps.append([])
        free.append([])
        return len(steps) - 1

    def one(begin: int, members) -> int:
        end = state()
        steps[begin].append((frozenset(members), end))
        return end

    def members(items) -> set:
        out, negated = set(), False
        for op, value in items:
            name = str(op)
            if name == "NEGATE":
                negated = True
            elif name == "LITERAL":
                out.add(value)
            elif name == "RANGE":
                out.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"class member {name} is not supported")
        return set(range(256)) - out if negated else out

    def sequence(begin: int, tree) -> int:
        for op, value in tree:
            name = str(op)
            if name == "LITERAL":
                begin = one(begin, {value})
            elif name == "IN":
                begin = one(begin, members(value))
            elif name == "SUBPATTERN":
                begin = sequence(begin, value[3])
            elif name == "BRANCH":
                end = state()
                for branch in value[1]:
                    free[sequence(begin, branch)].append(end)
                begin = end
            elif name == "MAX_REPEAT":
                low, high, body = value
                for _ in range(low):
                    begin = sequence(begin, body)
                if high is parser.MAXREPEAT:
                    loop, end = state(), state()
                    free[begin].append(loop)
                    free[sequence(loop, body)].append(loop)
                    free[loop].append(end)
                    begin = end
                else:
                    end = state()
                    for _ in range(high - low):
                        free[begin].append(end)
                        begin = sequence(begin, body)
                    free[begin].append(end)
                    begin = end
            else:
                raise ValueError(f"expression part {name} is not supported")
        return begin

    begin = state()
    return begin, sequence(begin, parser.parse(pattern))


class Automaton:
    """Deterministic and minimal: table[state, byte class], and the mask of rules accepting in each state."""

    def __init__(self, patterns: list[str], anywhere: bool):
        steps, free, accepts, begins = [], [], {}, []
        for bit, pattern in enumerate(patterns):
            begin, end = _nfa(pattern, steps, free)
            begins.append(begin)
            accepts[end] = accepts.get(end, 0) | 1 << bit
        signature = defaultdict(list)  # bytes that every step treats alike form a class
        sets = sorted({s for row in steps for s, _ in row}, key=sorted)
        for byte in range(256):
            signature[tuple(byte in s for s in sets)].append(byte)
        groups = list(signature.values())
        self.classes = np.zeros(256, np.int64)
        for i, group in enumerate(groups):
            self.classes[group] = i

        def closed(states) -> frozenset:
            todo, seen = list(states), set(states)
            while todo:
                for x in free[todo.pop()]:
                    if x not in seen:
                        seen.add(x)
                        todo.append(x)
            return frozenset(seen)

        first = closed(begins)
        number, rows, order = {first: 0}, [], [first]
        for current in order:
            row = []
            for group in groups:
                reached = {t for s in current for chars, t in steps[s] if group[0] in chars}
                target = closed(reached | set(begins) if anywhere else reached)
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                row.append(number[target])
            rows.append(row)
        table = np.array(rows, np.int64)
        mask = np.array([sum({accepts[s] for s in st if s in accepts}) for st in order], np.int64)
        part = np.unique(mask, return_inverse=True)[1]
        while True:  # split states until those of a part behave alike
            finer = np.unique(np.column_stack([part, part[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        keep = np.unique(part, return_index=True)[1]
        self.table, self.mask, self.start = part[table[keep]], mask[keep], int(part[0])
        self.dead = next((s for s in range(len(keep)) if not self.mask[s] and (self.table[s] == s).all()), -1)

    def resets(self) -> np.ndarray:
        """Bytes after which every state is the start state."""
        return (self.table == self.start).all(axis=0)[self.classes]

    def accepted(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Mask of rules that accept somewhere in each lane codes[s:e]; all lanes advance together."""
        order = np.argsort(starts - ends, kind="stable")
        begin, length = starts[order], (ends - starts)[order]
        width = self.table.shape[1]
        flat, state = (self.table * width).ravel(), np.full(len(order), self.start * width, np.int64)
        mask = self.mask
        seen = np.zeros(len(order), np.int64)
        accepting = np.zeros(len(mask) * width, np.int64)
        accepting[::width] = mask
        alive = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        together = int(np.searchsorted(-alive, -FEW_LANES, "right"))  # steps with enough lanes for an array operation
        for j, n in enumerate(alive[:together].tolist()):
            state[:n] = flat[state[:n] + codes[begin[:n] + j]]
            seen[:n] |= accepting[state[:n]]
        rows, accepts = (self._rows(), self._accepts()) if together < len(alive) else ([], [])
        for i in range(int(alive[together]) if together < len(alive) else 0):  # the few long ones, one after another
            at, found = int(state[i]) // width, int(seen[i])
            for code in codes[begin[i] + together: begin[i] + length[i]].tolist():
                at = rows[at][code]
                found |= accepts[at]
            seen[i] = found
        out = np.empty(len(order), np.int64)
        out[order] = seen
        return out

    def spans(self, raw: bytes) -> list[tuple[int, int]]:
        """Leftmost, longest, non-overlapping matches of an anchored automaton.

        A state that was left at some place without reaching a match after it will not reach one from there later either;
        such pairs are remembered, so the time is linear in the text however often a scan starts anew.
        """
        codes, table, mask, dead = self.classes[np.frombuffer(raw, np.uint8)].tolist(), self._rows(), self._accepts(), self.dead
        out, at, n = [], 0, len(codes)
        states, hopeless, far = len(table), set(), -1
        while at < n:
            if at > far:
                hopeless.clear()
            state, end, last = self.start, -1, []
            for j in range(at, n):
                state = table[state][codes[j]]
                if state == dead:
                    break
                if mask[state]:
                    end = j + 1
                    last.clear()
                    continue
                pair = j * states + state
                if pair in hopeless:
                    break
                last.append(pair)
            if len(last) > 1:
                hopeless.update(last)
                far = max(far, last[-1] // states)
            if end > at:
                out.append((at, end))
            at = max(at + 1, end)
        return out

    def _rows(self) -> list:
        if not hasattr(self, "_listed"):
            self._listed = self.table.tolist(), self.mask.tolist()
        return self._listed[0]

    def _accepts(self) -> list:
        self._rows()
        return self._listed[1]


class Scanner:
    """Compiled rules; built once, on the driver, and shipped with the tasks."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.combined = Automaton([r.scan for r in rules], True)
        self.anchored = [Automaton([r.pattern], False) for r in rules]
        self.cut = self.combined.resets()
        self.tails = [re.compile(r.tail.encode()) if r.tail else None for r in rules]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each row, the (start, rule number, end) of its spans in code points."""
        out = [[] for _ in range(len(offsets) - 1)]
        starts, ends = B.runs(~self.cut[data], offsets)
        seen = self.combined.accepted(self.combined.classes[data], starts, ends)
        hits = np.flatnonzero(seen)
        if not len(hits):
            return out
        points = B.code_points(data)
        for lane in hits.tolist():
            s, e = int(starts[lane]), int(ends[lane])
            row = int(np.searchsorted(offsets, s, "right")) - 1
            raw = data[s:e].tobytes()
            for i, rule in enumerate(self.rules):
                if seen[lane] >> i & 1:
                    for a, b in self.anchored[i].spans(raw):
                        size = len(self.tails[i].search(raw[a:b])[1]) if self.tails[i] else b - a
                        if size >= rule.least:
                            zero = points[offsets[row]]
                            out[row].append((int(points[s + a] - zero), i, int(points[s + b] - zero)))
        for found in out:
            found.sort()
        return out


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: the id and `found`, an array of (kind, start, end) by start, then by the order of the rules."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def run(batches):
        for batch in B.slices(batches, text):
            rows = scanner.scan(*B.utf8(batch.column(1)))
            found = [[{"kind": kinds[i], "start": s, "end": e} for s, i, e in row] for row in rows]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "found"])

    rows = docs.select(F.col(key), F.col(text).alias(text))
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, found array<struct<kind:string,start:bigint,end:bigint>>")



def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, digest of the base spans and all spans as text, from the spans of `find`; built-in functions only."""
    def of(array):
        return F.array_join(F.transform(array, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("found", lambda x: x["kind"].isin([r.kind for r in BASE]))

    def number(kind):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(key, *[number(r.kind) for r in BASE], F.sha2(of(base), 256).alias("base_sha256"), of(F.col("found")).alias("spans"))


def reference_spans(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans by a backtracking matcher, for tests."""
    out = []
    for i, rule in enumerate(BASE):
        for m in re.finditer(rule.pattern, text or ""):
            size = len(re.search(rule.tail, m[0])[1]) if rule.tail else len(m[0])
            if size >= rule.least:
                out.append((m.start(), i, m.end()))
    return [(BASE[i].kind, s, e) for s, i, e in sorted(out)]
