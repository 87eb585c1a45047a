"""One form for texts that look alike (problem 6).

A transducer reads texts once, grapheme cluster by grapheme cluster, and takes
the longest match of its compiled table at each place: widths, ligatures,
kinds of space and hyphen, invisible characters, stored accents, conjoining
letters, and letters of other alphabets that look like Latin ones. The table
is generated from the character database and a list of look-alikes, holds
whole clusters (a base of any source with its accents in any stored order),
and is checked for conflicts when it is built. Joiners between letters of
joining scripts or between emoji, and selectors and tags of emoji, are
visible, so they stay.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import cache
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.llm.pairs import meet_in_blocks
from engramlake.session import cut

# Letters of other alphabets that print like Latin ones, and those letters.
LOOK_ALIKE_ROWS = (
    # Cyrillic
    ("АВЕКМНОРСТХЅІЈԚԜҮԌѴӀаеорсухѕіјԁһԛԝӏѵ", "ABEKMHOPCTXSIJQWYGVIaeopcyxsijdhqwlv"),
    # Greek
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹοϲϳνρ", "ABEZHIKMNOPTYXCocjvp"),
    # Armenian, Coptic, Latin extensions
    ("օոսցհՏՕՍⲞⲢⲤⲦⲘⲚⲔⲟⲥɡᴏᴄᴠᴡᴢ", "onughSOUOPCTMNKocgocvwz"),
    # Cherokee
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃᏀ", "ABCDEHJKLMPRSTVWZG"),
    # Lisu
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),
)
LOOK_ALIKES = {ch: latin for row, letters in LOOK_ALIKE_ROWS for ch, latin in zip(row, letters, strict=True)}
# Characters that print like a hyphen-minus (dashes are longer and stay), and the visible ones among format characters.
HYPHENS = "\u2010\u2011\u2012\u2212\ufe63"
SHOWN_FORMATS = ((0x600, 0x605), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2), (0xFFF9, 0xFFFB), (0x110BD, 0x110CD), (0x13430, 0x1343F))
# Invisible characters that are no format characters: fillers, vowel marks and selectors that print nothing.
BLANKS = ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF))
# Character classes of joining scripts and of emoji, in whose midst a joiner shows; of what a selector or tag changes.
JOINING = "\u0600-\u08ff\u0900-\u0dff\u1000-\u109f\u1780-\u17ff\u1800-\u18af\ufb50-\ufdff\ufe70-\ufefe\u2600-\u27bf\ufe0f\U0001f000-\U0001faff"
EMOJI = "#*0-9\u00a9\u00ae\u203c-\u3299\U0001f000-\U0001faff"

_WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>")
_SHAPED = ((0xFB00, 0xFB4F), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC), (0x132, 0x133), (0x1C4, 0x1CC), (0x1F1, 0x1F3))


def _within(c: int, spans: Sequence[tuple[int, int]]) -> bool:
    return any(a <= c <= b for a, b in spans)


@cache
def invisible() -> str:
    """All characters that print nothing by themselves: format characters, fillers, selectors, tags."""
    return "".join(
        chr(c) for c in range(0x80, 0xE0200) if _within(c, BLANKS) or (unicodedata.category(chr(c)) == "Cf" and not _within(c, SHOWN_FORMATS))
    )


INVISIBLE = invisible()


def build_map() -> dict[str, str]:
    """Every single character that changes, and what it becomes."""
    out: dict[str, str] = {}
    for c in range(0x80, sys.maxunicode + 1):
        ch = chr(c)
        if 0xD800 <= c <= 0xDFFF or not unicodedata.name(ch, ""):
            continue
        kind = unicodedata.category(ch)
        made = unicodedata.decomposition(ch)
        if kind == "Zs":
            out[ch] = " "
        elif made.startswith(_WIDTH_TAGS) or _within(c, _SHAPED) or (kind == "Nl" and made.startswith("<compat>")) or ch == "\u00b5":
            out[ch] = unicodedata.normalize("NFKC", ch)
        elif made and made[0] != "<" and (one := unicodedata.normalize("NFC", ch)) != ch:
            out[ch] = one  # stored otherwise, the same character
    out |= dict.fromkeys(HYPHENS, "-") | dict.fromkeys(INVISIBLE, "") | LOOK_ALIKES
    # letters with accents over a base that changes
    for c in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", ch := chr(c))
        if len(parts) > 1 and parts[0] in out and ch not in out:
            out[ch] = unicodedata.normalize("NFC", out[parts[0]] + parts[1:])
    # what a rule yields may itself be a source, e.g. the non-breaking hyphen's compatibility form
    for ch, to in out.items():
        seen = {ch}
        while any(x in out and x not in seen for x in to):
            seen |= set(to)
            to = "".join(out.get(x, x) for x in to)
        out[ch] = to
    out = {ch: to for ch, to in out.items() if ch != to}
    check_map(out)
    return out


def build_clusters(table: dict[str, str]) -> dict[str, str]:
    """Clusters of several characters and what they become: a base, or anything that becomes it, with accents in any stored order."""
    sources: dict[str, list[str]] = {}
    for ch, to in table.items():
        if len(to) == 1:
            sources.setdefault(to, []).append(ch)
    out: dict[str, str] = {}
    for c in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", ch := chr(c))
        if len(parts) < 2 or [bool(unicodedata.combining(x)) for x in parts] != [False] + [True] * (len(parts) - 1):
            continue
        image = table.get(ch, ch)
        for marks in permutations(parts[1:]):
            for n in range(len(marks)):  # some accents may be on the letter already
                base = unicodedata.normalize("NFC", parts[0] + "".join(marks[:n]))
                stored = base + "".join(marks[n:])
                if len(base) == 1 and unicodedata.normalize("NFC", stored) == unicodedata.normalize("NFC", ch):
                    for b in (base, *sources.get(base, ())):
                        out[b + "".join(marks[n:])] = image
    for lead in range(0x1100, 0x1113):  # conjoining letters of Hangul
        for vowel in range(0x1161, 0x1176):
            two = chr(lead) + chr(vowel)
            whole = unicodedata.normalize("NFC", two)
            out[two] = whole
            for tail in range(0x11A8, 0x11C3):
                out[two + chr(tail)] = out[whole + chr(tail)] = unicodedata.normalize("NFC", two + chr(tail))
    return out


def check_map(table: dict[str, str]) -> None:
    """Raise if the map is not confluent: an image must contain no source, and ASCII must stay itself."""
    for ch, to in table.items():
        if ch.isascii():
            raise ValueError(f"{ch!r} would change")
        if bad := [x for x in to if x in table]:
            raise ValueError(f"{ch!r} becomes {to!r}, of which {bad} change again")


#: Kinds of characters to the transducer: all others are copied as they are.
_SOURCE, _NOTHING, _JOINER, _SELECTOR, _MARK = 1, 2, 3, 4, 5


class Transducer:
    """The compiled table; calling it gives a text's canonical form.

    One array look-up gives the kind of every character; only where it says
    so are clusters cut and looked up, whole, so the longest match is one step.
    """

    def __init__(self, table: dict[str, str]):
        self.table = table
        self.clusters = build_clusters(table)
        if bad := [k for k, v in self.clusters.items() if any(x in table for x in v)]:
            raise ValueError(f"images of clusters change again: {bad[:5]}")
        self.kind = np.zeros(sys.maxunicode + 1, np.uint8)
        self.kind[[ord(ch) for ch in table]] = _SOURCE
        self.kind[[ord(ch) for ch, to in table.items() if not to]] = _NOTHING
        self.kind[[0x200C, 0x200D]] = _JOINER
        self.kind[[0xFE0E, 0xFE0F, *range(0xE0020, 0xE0080)]] = _SELECTOR
        self.kind[[c for c in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(c)) and self.kind[c] != _NOTHING]] = _MARK
        # what joins the letter before it, as accents do: voicing marks of half width, vowels and tails of Hangul
        self.kind[[0xFF9E, 0xFF9F, *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]] = _MARK
        self.joining, self.emoji = re.compile(f"[{JOINING}]"), re.compile(f"[{EMOJI}\U000e0020-\U000e007e]")
        self.settled: dict[str, str] = {}

    def settle(self, cluster: str) -> str:
        """A cluster that is not in the table, e.g. one with an invisible character before its accent, or three accents."""
        got = self.settled.get(cluster)
        if got is None:
            if len(self.settled) > 100_000:
                self.settled.clear()
            parts = unicodedata.normalize("NFD", cluster)
            got = self.settled[cluster] = unicodedata.normalize("NFC", "".join(self.table.get(x, x) for x in parts))
        return got

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, new text) of every cluster that may change, in one pass."""
        kind = self.kind[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        spots = np.flatnonzero(kind)
        at, kinds = spots.tolist(), kind[spots].tolist()
        table, clusters, joining, emoji = self.table, self.clusters, self.joining.match, self.emoji.match
        out: list[tuple[int, int, str]] = []
        i, n, done = 0, len(at), 0
        while i < n:
            a, k = at[i], kinds[i]
            # accents that follow, maybe after invisible characters, belong to the cluster
            last, j = (i if k == _MARK else -1), i + 1
            while j < n and kinds[j] != _SOURCE and at[j] - at[i] == j - i:
                if kinds[j] == _MARK:
                    last = j
                j += 1
            if last >= 0:
                start = a if k == _SOURCE or a == done or text[a - 1] in "\x00\n" else a - 1
                cluster = text[start : at[last] + 1]
                to = clusters.get(cluster)
                out.append((start, at[last] + 1, self.settle(cluster) if to is None else to))
                i, done = last + 1, at[last] + 1
                continue
            i += 1
            if k == _JOINER and a and joining(text, a - 1) and joining(text, a + 1) or k == _SELECTOR and a and emoji(text, a - 1):
                continue
            done = a + 1
            out.append((a, done, table[text[a]] if k == _SOURCE else ""))
        return out

    def __call__(self, text: str | None) -> str | None:
        return text if text is None or text.isascii() else self.many([text])[0]

    def many(self, texts: Sequence[str]) -> list[str]:
        """The canonical forms of many texts, which are read as one."""
        whole = "\x00".join(texts)
        parts: list[str] = []
        at = 0
        for a, b, to in self.edits(whole):
            parts += (whole[at:a], to)
            at = b
        parts.append(whole[at:])
        out = "".join(parts).split("\x00")
        # a text that holds the separator itself is read alone
        return out if len(out) == len(texts) else [x for t in texts for x in ("\x00".join(self.many([p])[0] for p in t.split("\x00")),)]


@cache
def transducer() -> Transducer:
    return Transducer(build_map())


def _canonical(texts: pd.Series) -> pd.Series:
    here = texts.notna().to_numpy()
    out = texts.copy()
    out[here] = transducer().many(texts[here].tolist())
    return out


def canonical(text: Column) -> Column:
    """The canonical form of a text column; null stays null. Texts of ASCII only never reach Python."""
    changing = text.rlike("[^\\x00-\\x7f]")
    return F.when(changing, F.pandas_udf(_canonical, T.StringType())(F.when(changing, text))).otherwise(text)


def with_canonical(df: DataFrame, text_col: str, out: str = "canonical") -> DataFrame:
    """``df`` with the canonical form of ``text_col`` as ``out`` (an existing column of that name is replaced)."""
    return df.withColumn(out, canonical(F.col(text_col)))


def look_alike_pairs(df: DataFrame, id_col: str, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows whose texts differ as stored and look the same: *by, id_a, id_b (id_a < id_b).

    Only rows with equal ``by`` columns (e.g. the table they come from) pair.
    Rows are first grouped by (form, stored text), so copies of one text meet
    only texts that differ from it; forms with one stored text end there.
    Null texts, ids and ``by`` values pair with nothing, an empty text looks
    like one of invisible characters only, repeated rows count once, an empty
    table gives no rows.
    """
    stored = df.select(*by, F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    rows = with_canonical(stored, "text", "form").select(
        *by, "id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("text")
    )
    rows = cut(rows.distinct())
    group = [*by, "form"]
    kinds = rows.select(*group, "text").distinct()
    mixed = kinds.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    kinds = cut(kinds.join(mixed, group))
    a = kinds.withColumnRenamed("text", "ta")
    b = kinds.withColumnRenamed("text", "tb")
    meets = a.join(b, group).where("ta < tb")
    # both sides of a pair of texts may have many copies: they meet in blocks
    pair = F.struct("ta", "tb")
    left = meets.join(rows.withColumnsRenamed({"text": "ta", "id": "ia"}), [*group, "ta"]).select(*group, pair.alias("_pair"), "ia")
    right = meets.join(rows.withColumnsRenamed({"text": "tb", "id": "ib"}), [*group, "tb"]).select(*group, pair.alias("_pair"), "ib")
    pairs = meet_in_blocks(left, right, [*group, "_pair"], "ia", "ib").where("ia <> ib")
    return pairs.select(*by, F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
