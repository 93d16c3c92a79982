"""Secret scans: fixed patterns, and formats inferred from what they find.

The patterns label credentials. For each kind of label a prefix tree over character classes is folded into a
probabilistic automaton by merging states whose continuations are statistically compatible. Every run of credential
characters is then scored by its likelihood under these formats against that under an automaton of ordinary words.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, forget, lasting, map_whole

KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: From the length of the shortest labelled credential on.
LEAST = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
PLAIN = re.compile(r"[A-Za-z]{10,}")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, secret) of the fixed patterns by start, then kind; leftmost and not overlapping within a kind."""
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _classes() -> dict[str, tuple[str, float]]:
    """Character -> its class and the log of its share of the class."""
    made = {}
    for name, chars in (("U", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("h", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("d", "0123456789")):
        made |= {c: (name, -math.log(len(chars))) for c in chars}
    return made | {c: (c, 0.0) for c in "+/_.=-"}


CLASSES = _classes()
_SYMBOLS = len({s for s, _ in CLASSES.values()}) + 1


@dataclass
class Automaton:
    """States with the number of strings that pass, that end, and that go on by each symbol."""

    passed: list[int] = field(default_factory=lambda: [0])
    ended: list[int] = field(default_factory=lambda: [0])
    went: list[dict[str, int]] = field(default_factory=lambda: [defaultdict(int)])
    to: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, symbols: str) -> None:
        at = 0
        for s in symbols:
            self.passed[at] += 1
            self.went[at][s] += 1
            if s not in self.to[at]:
                self.to[at][s] = len(self.to)
                self.passed.append(0)
                self.ended.append(0)
                self.went.append(defaultdict(int))
                self.to.append({})
            at = self.to[at][s]
        self.passed[at] += 1
        self.ended[at] += 1

    def compatible(self, a: int, b: int, alpha: float) -> bool:
        """Whether all frequencies behind two states agree within Hoeffding bounds."""
        bound, todo = math.sqrt(0.5 * math.log(2 / alpha)), [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.passed[a], self.passed[b]
            if not n or not m:
                continue
            most = bound * (n**-0.5 + m**-0.5)
            if most >= 1:  # so few strings can't tell the states apart, and behind them come fewer still
                continue
            if abs(self.ended[a] / n - self.ended[b] / m) > most:
                return False
            for s in self.went[a].keys() | self.went[b].keys():
                if abs(self.went[a].get(s, 0) / n - self.went[b].get(s, 0) / m) > most:
                    return False
                if s in self.to[a] and s in self.to[b] and self.to[a][s] != self.to[b][s]:
                    todo.append((self.to[a][s], self.to[b][s]))
        return True

    def fold(self, a: int, b: int) -> None:
        """Puts the tree below b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.passed[a] += self.passed[b]
            self.ended[a] += self.ended[b]
            for s, n in self.went[b].items():
                self.went[a][s] += n
            for s, to in self.to[b].items():
                if s in self.to[a]:
                    todo.append((self.to[a][s], to))
                else:
                    self.to[a][s] = to

    def merge(self, alpha: float) -> Automaton:
        """Merges compatible states, nearest to the start first, until all that are left differ."""
        red, members, first = [0], {0}, 0
        while True:
            # States are looked through in order; what is done with one stays done until a merge adds to an older one.
            edge = next(((i, s, t) for i in range(first, len(red)) for s, t in sorted(self.to[red[i]].items()) if t not in members), None)
            if edge is None:
                if not first:
                    return self
                first = 0
                continue
            first, s, t = edge
            into = next((x for x in red if self.compatible(x, t, alpha)), None)
            if into is None:
                red.append(t)
                members.add(t)
            else:
                self.to[red[first]][s] = into
                self.fold(into, t)
                first = 0

    def frozen(self) -> tuple[list[dict[str, float]], list[dict[str, int]], list[float]]:
        """Smoothed log-probabilities of symbols and ends, and the moves, of the states that can be reached."""
        order, place = [0], {0: 0}
        for x in order:
            for t in self.to[x].values():
                if t not in place:
                    place[t] = len(order)
                    order.append(t)
        logs, moves, ends = [], [], []
        for x in order:
            whole = math.log(self.passed[x] + 0.05 * _SYMBOLS)
            seen = {s: math.log(n + 0.05) - whole for s, n in self.went[x].items()}
            logs.append(defaultdict(_Missing(math.log(0.05) - whole), seen))
            moves.append({s: place[t] for s, t in self.to[x].items()})
            ends.append(math.log(self.ended[x] + 0.05) - whole)
        return logs, moves, ends


@dataclass
class _Missing:
    value: float

    def __call__(self) -> float:
        return self.value


def learn(strings: list[str], alpha: float) -> tuple:
    tree = Automaton()
    for x in strings:
        tree.add("".join(CLASSES[c][0] for c in x if c in CLASSES))
    return tree.merge(alpha).frozen()


def log_likelihood(model: tuple, string: str) -> float:
    """Log-likelihood of a string of credential characters; an unknown move goes back to the start."""
    logs, moves, ends = model
    at, total = 0, 0.0
    for c in string:
        s, share = CLASSES[c]
        total += logs[at][s] + share
        at = moves[at].get(s, 0)
    return total + ends[at]


def _at(kind: str, secret: str) -> int:
    """The place of a string in the order by which examples are taken."""
    return int.from_bytes(hashlib.blake2b(f"{kind}:{secret}".encode(), digest_size=7).digest(), "big")


def fit_formats(docs: DataFrame, text_col: str = "text", examples: int = 300, alpha: float = 0.05) -> dict[str, tuple]:
    """Formats by kind, and ``plain`` for ordinary words, from at most ``examples`` distinct labelled strings of a kind.

    The patterns run over all whole texts, and words are all runs of ten and more letters outside labelled ones. Which of the strings found are
    taken, if there are more, follows a hash; strings of any length are. A task hands on the first by hash of what it
    finds, which are all that can be among the first of all.
    """

    def label(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, dict[str, int]] = {kind: {} for kind in ("assign", "access", "hex", "plain")}
        for frame in batches(frames, "text"):
            found: dict[str, set[str]] = {kind: set() for kind in held}
            for text in frame["text"]:
                if isinstance(text, str):
                    at = 0
                    for kind, a, b, secret in base_spans(text):
                        found[kind].add(secret)
                        found["plain"].update(PLAIN.findall(text[at:a]) if a > at else ())
                        at = max(at, b)
                    found["plain"].update(PLAIN.findall(text[at:] if at else text))
            for kind, strings in found.items():
                both = held[kind] | {x: _at(kind, x) for x in strings if x not in held[kind]}
                held[kind] = dict(sorted(both.items(), key=lambda x: (x[1], x[0]))[:examples])
        rows = [(kind, at, x) for kind, strings in held.items() for x, at in strings.items()]
        if rows:
            yield pd.DataFrame(rows, columns=["kind", "at", "secret"])

    found = docs.select(F.col(text_col).alias("text")).mapInPandas(label, "kind string, at long, secret string").distinct()
    found = lasting(found)
    rows = {}
    for kind in ("assign", "access", "hex", "plain"):
        few = found.where(F.col("kind") == kind).orderBy("at", "secret").limit(examples)
        rows[kind] = [row.secret for row in few.collect()]
    forget(found)
    return {kind: learn(sorted(strings), alpha) for kind, strings in rows.items() if strings}


def outside(start: int, end: int, base: list) -> Iterator[tuple[int, int]]:
    """The parts of a run that no base span (sorted by start) covers and that are long enough for a candidate."""
    for _, a, b in base:
        if b <= start:
            continue
        if a >= end:
            break
        if a - start >= LEAST:
            yield start, a
        start = b
    if end - start >= LEAST:
        yield start, end


def all_spans(text: str, models: dict[str, tuple], least: float) -> tuple[list, list]:
    """(base spans, all spans): those of the patterns, and with them the runs that fit a format, as (kind, start, end)."""
    base = [x[:3] for x in base_spans(text)]
    found = []
    formats = [m for kind, m in models.items() if kind != "plain"]
    if formats and "plain" in models:
        for m in CANDIDATE.finditer(text):
            for a, b in outside(*m.span(), base):
                part = text[a:b]
                plain = log_likelihood(models["plain"], part)
                if max(log_likelihood(f, part) for f in formats) - plain >= least * (b - a):
                    found.append(("format", a, b))
    return base, sorted(base + found, key=lambda x: (x[1], KINDS.index(x[0]))) if found else base


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan_secrets(docs: DataFrame, models: dict[str, tuple] | None = None, least: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base_spans, spans) for each row: spans of secrets in code points, end exclusive, by start, then kind.

    ``spans`` holds those of the fixed patterns and, as kind ``format``, the runs of 12 and more credential characters
    outside them (what a pattern leaves of a run counts as a run) whose log-likelihood under a learned format is above
    that under ordinary words by ``least`` a character. A null or empty text has no spans. Without labelled credentials
    there are no formats. Null ids and rows that repeat stay, and an empty table gives an empty table.
    """
    models = fit_formats(docs, text_col) if models is None else models
    held = docs.sparkSession.sparkContext.broadcast(models)  # a few hundred examples a kind at most

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "text"):
            both = [all_spans(x, held.value, least) if isinstance(x, str) else ([], []) for x in frame["text"]]
            dicts = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in pair] for pair in both]
            yield pd.DataFrame({"id": frame["id"], "base_spans": pd.Series([x for x, _ in dicts], dtype=object, index=frame.index), "spans": pd.Series([y for _, y in dicts], dtype=object, index=frame.index)})

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_whole(texts, scan, f"base_spans {SPANS}, spans {SPANS}").withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, models: dict[str, tuple] | None = None, least: float = 1.0, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mask``; spans that overlap become one. Other columns stay."""
    models = fit_formats(docs, text_col) if models is None else models
    held = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("string")
    def redact(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if isinstance(text, str) and (spans := all_spans(text, held.value, least)[1]):
                parts, at = [], 0
                for _, a, b in spans:
                    if a >= at:
                        parts += [text[at:a], mask]
                    at = max(at, b)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, redact(F.col(text_col)))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
