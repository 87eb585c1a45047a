"""Text functions as columns: case, tokens, full-text query parsing."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower case of A-Z only; other letters keep their case."""
    return F.translate(text, _UPPER, _LOWER)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@cache
def _accents() -> tuple[str, str]:
    """Letters that are a base letter with marks, and those bases (built from the character database)."""
    src, to = [], []
    for c in range(0xC0, 0x2000):
        base = unicodedata.normalize("NFD", chr(c))
        if len(base) > 1 and unicodedata.category(base[0])[0] == "L" and all(unicodedata.combining(x) for x in base[1:]):
            src.append(chr(c))
            to.append(base[0])
    return "".join(src), "".join(to)


def fold(text: Column) -> Column:
    """Lower case without diacritics, as the full-text index stores terms."""
    return F.regexp_replace(F.translate(F.lower(text), *_accents()), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """Terms of a text in order: runs of letters and digits, folded. Null gives an empty list."""
    found = F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def word_set(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != ""))


def word_overlap(a: Column, b: Column) -> Column:
    """Common words over those of the smaller text; 0 if one has none, null for null."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small > 0, F.size(F.array_intersect(a, b)) / small).otherwise(F.lit(0.0))


def python_tokens(text: str) -> list[str]:
    """``tokens`` of a query string, on the driver."""
    flat = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFC", flat))


def sanitize_query(query: str) -> str:
    """A query in which punctuation inside a word makes a phrase of its pieces."""
    out = []
    for word in query.split():
        pieces = re.sub(r"[^\w]", " ", word).split()
        if len(pieces) > 1:
            out.append('"' + " ".join(pieces) + '"')
        else:
            out += pieces
    return " ".join(out)


@dataclass(frozen=True)
class Node:
    """A full-text expression: op is phrase, and, or, not (left without right)."""

    op: str
    terms: tuple[str, ...] = ()
    kids: tuple[Node, ...] = ()

    def phrases(self) -> list[tuple[str, ...]]:
        """The phrases that score: not those to the right of NOT."""
        if self.op == "phrase":
            return [self.terms]
        kids = self.kids[:1] if self.op == "not" else self.kids
        return [p for k in kids for p in k.phrases()]

    def all_phrases(self) -> list[tuple[str, ...]]:
        return [self.terms] if self.op == "phrase" else [p for k in self.kids for p in k.all_phrases()]


def parse_query(query: str) -> Node | None:
    """Words and "phrases" joined by blanks (AND), AND, OR, NOT; NOT binds tightest, OR loosest.

    A malformed operator counts as a word; a query without words gives None.
    """
    words: list[str | Node] = []
    for m in re.finditer(r'"([^"]*)"|(\S+)', query):
        text = m.group(2)
        if text in ("AND", "OR", "NOT"):
            words.append(text)
            continue
        terms = tuple(python_tokens(m.group(1) if text is None else text))
        if terms:
            words.append(Node("phrase", terms))

    def is_op(k: int, *ops: str) -> bool:
        """An operator stands between two operands."""
        return 0 < k < len(words) - 1 and words[k] in ops and isinstance(words[k - 1], Node) and isinstance(words[k + 1], Node)

    clean: list[str | Node] = []
    for k, w in enumerate(words):
        clean.append(w if isinstance(w, Node) or is_op(k, "AND", "OR", "NOT") else Node("phrase", (w.lower(),)))
    if not clean:
        return None
    ors: list[list[Node]] = [[]]
    k = 0
    while k < len(clean):
        w = clean[k]
        if w == "OR":
            ors.append([])
        elif w == "NOT":
            k += 1
            ors[-1][-1] = Node("not", kids=(ors[-1][-1], clean[k]))
        elif w != "AND":
            ors[-1].append(w)
        k += 1
    ands = [g[0] if len(g) == 1 else Node("and", kids=tuple(g)) for g in ors]
    return ands[0] if len(ands) == 1 else Node("or", kids=tuple(ands))
