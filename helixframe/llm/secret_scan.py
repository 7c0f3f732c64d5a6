"""Secret scans with a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived that every matching text must satisfy.
Documents are indexed block by block (a block is one slice of one task, so the index is sharded with the table and needs
no shuffle): postings give, for each trigram of any query, the documents of the block that have it. Postings are
intersected and united as the query says, and only the candidates are verified with the expression itself. A rule
without mandatory trigrams scans all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import batch_of, documents, slices, text_bytes

#: Most alternatives of a literal run that are followed; beyond, the run is cut, which only weakens the query.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches are leftmost and do not overlap; one whose `group` is shorter than `least` is dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The base kinds, in the order of their digest.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: Further kinds with a prefix of their own.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no demand), a trigram, or ("and" | "or", parts).


def _both(op: str, parts: list):
    if op == "and":
        parts = [p for p in parts if p is not True]
        return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[str]):
    """The query of all UTF-8 trigrams of any of the strings, as bytes written in latin-1."""
    raw = [s.encode("utf-8", "surrogatepass").decode("latin-1") for s in sorted(strings)]
    return _both("or", [_both("and", sorted({s[i : i + 3] for i in range(len(s) - 2)})) for s in raw])


def _lower(code: int) -> str:
    """A-Z in lower case, as in the index; other letters stay, since expressions are matched in ASCII mode."""
    return chr(code + 32 if 65 <= code <= 90 else code)


def _strings(tokens) -> set[str] | None:
    """All strings that a part of an expression can match, if they are few."""
    out = {""}
    for op, arg in tokens:
        name = str(op)
        if name == "LITERAL":
            more = {_lower(arg)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            more = {_lower(a) for _, a in arg}
        elif name == "SUBPATTERN":
            more = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(b) for b in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 4:
            once = _strings(arg[2])
            more = None
            if once is not None:
                more, run = set(), {""}
                for i in range(arg[1] + 1):
                    more |= run if i >= arg[0] else set()
                    run = {a + b for a in run for b in once}
        elif name == "AT":
            more = {""}
        else:
            more = None
        if more is None or len(more) * len(out) > ALTERNATIVES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str):
    """The Boolean query over lower-cased trigrams that every text with a match satisfies."""

    def of(tokens):
        asked, run = [], {""}
        for token in tokens:
            name, arg = str(token[0]), token[1]
            more = _strings([token])
            if more is not None and len(more) * len(run) <= ALTERNATIVES:
                run = {a + b for a in run for b in more}
                continue
            asked.append(_of_strings(run))
            run = more if more is not None else {""}
            if more is None and name == "SUBPATTERN":
                asked.append(of(arg[3]))
            elif more is None and name == "BRANCH":
                asked.append(_both("or", [of(b) for b in arg[1]]))
            elif more is None and name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
                asked.append(of(arg[2]))
        return _both("and", [*asked, _of_strings(run)])

    return of(list(re._parser.parse(pattern)))


def _trigrams(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


class BlockIndex:
    """Postings of one block of documents for the trigrams of given queries."""

    def __init__(self, queries: list) -> None:
        asked = sorted(set().union(*map(_trigrams, queries)) if queries else set())
        self.number = {t: i + 1 for i, t in enumerate(asked)}
        self.table = np.zeros(1 << 24, np.uint8 if len(asked) < 255 else np.uint16)
        for t, i in self.number.items():
            a, b, c = t.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def load(self, data: np.ndarray, offsets: np.ndarray) -> None:
        self.n = len(offsets) - 1
        self.postings = np.zeros((len(self.number) + 1, self.n), bool)
        if len(data) > 2:
            x = self.lower[data].astype(np.uint32)
            which = self.table[x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
            at = np.flatnonzero(which)
            self.postings[which[at], np.searchsorted(offsets, at, side="right") - 1] = True

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.ones(self.n, bool)
        if isinstance(query, str):
            return self.postings[self.number[query]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.candidates(q) for q in query[1]])


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, spans (array of kind, start, end in code points, end exclusive), by start and
    then in the order of `rules`. Null and empty texts have no spans; repeated rows are judged each for itself. Texts of
    any length are scanned whole."""
    rows = documents(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern) for r in rules]
        index, compiled = BlockIndex(queries), [r.compiled() for r in rules]
        for batch in slices(batches, "text"):
            index.load(*text_bytes(batch.column("text")))
            texts = batch.column("text").to_pylist()
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for k, (rule, query, regex) in enumerate(zip(rules, queries, compiled, strict=True)):
                for i in np.flatnonzero(index.candidates(query)).tolist():
                    found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            for f in found:
                f.sort()
            yield batch_of(_SCHEMA, batch.column("doc_id"), [[rules[k].kind for _, k, _ in f] for f in found], [[a for a, _, _ in f] for f in found], [[b for _, _, b in f] for f in found])

    out = rows.mapInArrow(scan, "doc_id long, kinds array<string>, starts array<int>, ends array<int>")
    return out.select("doc_id", F.expr("arrays_zip(kinds, starts, ends)").cast("array<struct<kind: string, start: int, end: int>>").alias("spans"))
