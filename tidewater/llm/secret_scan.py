"""Secret scans: fixed patterns, and formats inferred from the credentials that these find.

The credentials that the patterns find over all documents are labelled by their kind. For each kind a
probabilistic automaton is inferred: a prefix tree of the labelled strings, whose states are merged
where their continuations are statistically compatible (Hoeffding bounds on the shares of each next
symbol and of endings). Every other credential-like run of a text is then scored by its mean
log-likelihood under the automata; runs that look as likely as the labelled ones become spans of
kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import cut as kept
from tidewater.llm.text import slices

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that the automata score; a letter and a digit are asked for besides.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "format")
#: What a text must have for any of the patterns to match; found without Python's regex engine.
HINT = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9a-f]{24}|[A-Za-z0-9+/_=-]{16}"
LONGEST = 512


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind number, end, start of the secret itself), sorted; offsets in code points."""
    out = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _symbol(c: str) -> str:
    """Classes of characters that random strings draw evenly; punctuation stands for itself."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "g"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "G"
    return c


_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}


class Automaton:
    """A probabilistic automaton: counts of arrivals, endings and transitions of each state."""

    def __init__(self, strings: list[str], alpha: float = 0.05):
        self.n, self.ends, self.next, self.count = [0], [0], [{}], [{}]
        for s in strings:
            at = 0
            self.n[0] += 1
            for c in map(_symbol, s):
                if c not in self.next[at]:
                    self.next[at][c] = len(self.n)
                    self.n.append(0)
                    self.ends.append(0)
                    self.next.append({})
                    self.count.append({})
                self.count[at][c] = self.count[at].get(c, 0) + 1
                at = self.next[at][c]
                self.n[at] += 1
            self.ends[at] += 1
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return na > 0 and nb > 0 and abs(a / na - b / nb) > self._bound * (na**-0.5 + nb**-0.5)

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            if self._differ(self.ends[p], self.n[p], self.ends[q], self.n[q]):
                return False
            for c in self.count[p].keys() | self.count[q].keys():
                if self._differ(self.count[p].get(c, 0), self.n[p], self.count[q].get(c, 0), self.n[q]):
                    return False
                if c in self.next[p] and c in self.next[q] and self.next[p][c] != self.next[q][c]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _fold(self, p: int, q: int) -> None:
        """Add the tree at q to the states at p."""
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.n[p] += self.n[q]
            self.ends[p] += self.ends[q]
            for c, to in self.next[q].items():
                self.count[p][c] = self.count[p].get(c, 0) + self.count[q][c]
                if c in self.next[p]:
                    todo.append((self.next[p][c], to))
                else:
                    self.next[p][c] = to

    def _infer(self) -> None:
        red, seen = [0], {0}
        while True:
            blue = [(p, c) for p in red for c, q in sorted(self.next[p].items()) if q not in seen]
            if not blue:
                break
            p, c = max(blue, key=lambda x: self.n[self.next[x[0]][x[1]]])
            q = self.next[p][c]
            for r in red:
                if self._compatible(r, q):
                    self.next[p][c] = r
                    self._fold(r, q)
                    break
            else:
                red.append(q)
                seen.add(q)
        number = {p: i for i, p in enumerate(red)}
        self.states = [({c: (number[q], self.count[p][c]) for c, q in self.next[p].items()}, self.n[p]) for p in red]
        del self.n, self.ends, self.next, self.count

    def score(self, s: str) -> float:
        """Mean log-likelihood per character, a little mass kept for what was not seen."""
        at, total = 0, 0.0
        for ch in s:
            c = _symbol(ch)
            moves, n = self.states[at]
            to, seen = moves.get(c, (0, 0))
            total += math.log((seen + 0.05) / (n + 0.5)) - math.log(_SIZE.get(c, 1))
            at = to
        return total / max(1, len(s))


def learn(documents: DataFrame, text: str = "text", max_strings: int = 600, tail: float = 0.02) -> list[tuple[Automaton, float]]:
    """An automaton and a least score for each kind with ten labelled credentials or more.

    All documents are scanned; of the distinct credentials of each kind, the ``max_strings`` with the
    smallest hashes and at most LONGEST characters train it, a fifth of them set aside: the least score
    is a low quantile of what those get.
    """

    def found(batches):
        for batch in batches:
            kinds, values = [], []
            for t in _hinted(batch.column(0))[1]:
                for _, kind, end, inner in base_spans(t):
                    kinds.append(kind)
                    values.append(t[inner:end])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(values, pa.string())], names=["kind", "value"])

    strings = documents.select(text).mapInArrow(found, "kind int, value string").where(F.length("value") <= LONGEST).groupBy("kind", "value").count()
    strings = kept(strings)  # the texts are read once for all kinds
    out = []
    for kind in range(3):
        rows = strings.where(F.col("kind") == kind).select("value", F.xxhash64("value").alias("h")).orderBy("h", "value").limit(max_strings)
        values = [r["value"] for r in rows.collect()]
        values = [v for v in values if any(c.isdigit() for c in v)]
        if len(values) >= 10:
            cut = max(1, len(values) // 5)
            automaton = Automaton(values[cut:])
            held = sorted(automaton.score(v) for v in values[:cut])
            out.append((automaton, held[int(tail * len(held))] - 0.05))
    return out


def format_spans(text: str, models, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidate runs that an automaton finds likely enough and that touch none of the ``taken`` spans, which are sorted."""
    out, at, reach = [], 0, 0
    for m in CANDIDATE.finditer(text):
        s = m.group()
        if s.isdigit() or s.isalpha() or not any(c.isdigit() for c in s) or not any(c.isalpha() for c in s):
            continue
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach > m.start():
            continue
        if any(automaton.score(s) >= least for automaton, least in models):
            out.append(m.span())
    return out


def all_spans(text: str, models) -> list[tuple[int, int, int, int]]:
    base = base_spans(text)
    added = format_spans(text, models, [(s, e) for s, _, e, _ in base]) if models else []
    return sorted(base + [(a, 3, b, a) for a, b in added])


def _hinted(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Rows whose text may have a match, and those texts."""
    column = pc.fill_null(column, "")
    rows = np.flatnonzero(pc.match_substring_regex(column, HINT).to_numpy(zero_copy_only=False))
    return rows, column.take(pa.array(rows)).to_pylist()


def _digest(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b, _ in spans)


def scan(documents: DataFrame, models, text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Null and empty texts have no secrets (the hash is then that of an empty string); repeated rows give
    repeated results.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    kind = documents.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text)):
            n = batch.num_rows
            counts = np.zeros((3, n), np.int64)
            digests, spans = [nothing] * n, [""] * n
            for i, t in zip(*_hinted(batch.column(1))):
                found = all_spans(t, shared.value)
                if found:
                    base = [x for x in found if x[1] < 3]
                    for x in base:
                        counts[x[1], i] += 1
                    digests[i] = hashlib.sha256(_digest(base).encode()).hexdigest()
                    spans[i] = _digest(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=names)

    return documents.select("doc_id", text).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(documents: DataFrame, models, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """The documents with every secret replaced by ``mark`` (of an assignment only its value), columns kept.

    ``n_chars``, where it is an integer column, is recounted for texts that change.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)
    at, size = documents.columns.index(text), documents.columns.index("n_chars") if "n_chars" in documents.columns else -1

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, text)):
            texts, changed = None, {}
            for i, t in zip(*_hinted(batch.column(at))):
                found = all_spans(t, shared.value)
                if found:
                    out, done = [], 0
                    for a, b in sorted((x[3], x[2]) for x in found):
                        if b > done:
                            if a >= done:
                                out += [t[done:a], mark]
                            done = b
                    changed[int(i)] = "".join(out) + t[done:]
            if changed:
                texts = batch.column(at).to_pylist()
                for i, t in changed.items():
                    texts[i] = t
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if size >= 0 and pa.types.is_integer(batch.schema.field(size).type):
                    counts = batch.column(size).to_pylist()
                    for i, t in changed.items():
                        counts[i] = len(t)
                    batch = batch.set_column(size, batch.schema.field(size), pa.array(counts, batch.schema.field(size).type))
            yield batch

    return documents.mapInArrow(run, documents.schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(documents, learn(documents))


QUERIES = {"op10_secret_scan": op10_secret_scan}
ORACLES: dict[str, str] = {}
