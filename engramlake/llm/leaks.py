"""Evaluation texts inside a training corpus (problem 9).

Greedy string tiling: runs of ``min_words`` words of the items are seeds; a
Karp-Rabin hash that rolls over the words of every document finds the seeds it
shares. Around them the longest matches are marked first, then the next
longest ones that do not overlap, down to ``min_words``; each tile's words are
compared as text. How much of an item the tiles cover, in whatever order they
stand, decides whether it counts as contained.

Documents are never shuffled: the seeds go to them. Their number is counted
first and larger item sets are worked off in blocks of bounded size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.codepoints import alphanumeric, chunks, han, joined
from engramlake.session import cut

#: Characters of items that one pass over the corpus carries (about 50 MB at each executor).
BLOCK_CHARS = 1_000_000

_BASE_CHAR, _BASE_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
_BLOOM_BITS = 22


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (n a power of two)."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.ones(n, np.uint64)
        size = 1
        while size < n:
            p[size : 2 * size] = p[:size] * np.uint64(pow(b, size, 1 << 64))
            size *= 2
        out.append(p)
    return out[0], out[1]


def _rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums of values[i] * base**i, base**-i): hashes of any run are a difference and a product."""
    up, down = _powers(base, 1 << max(10, int(len(values)).bit_length()))
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return prefix, down


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-case string, word starts, word ends, text of each word, 64-bit hash of each word)."""
    whole, points, _, ends = joined([t.lower() for t in texts])
    word = alphanumeric()[points]
    single = han()[points] & word
    before = np.concatenate(([False], word[:-1]))
    alone_before = np.concatenate(([False], single[:-1]))
    starts = np.flatnonzero(word & (~before | single | alone_before))
    after = np.concatenate((word[1:], [False]))
    alone_after = np.concatenate((single[1:], [False]))
    stops = np.flatnonzero(word & (~after | single | alone_after)) + 1
    prefix, down = _rolling(points.astype(np.uint64) + np.uint64(1), _BASE_CHAR)
    hashes = _mix((prefix[stops] - prefix[starts]) * down[starts])
    return whole, starts, stops, np.searchsorted(ends, starts, side="right"), hashes


def _grams(hashes: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the n words from each word on, whether they stand in one text)."""
    count = max(0, len(hashes) - n + 1)
    prefix, down = _rolling(hashes, _BASE_WORD)
    grams = _mix((prefix[n : n + count] - prefix[:count]) * down[:count])
    return grams, text_of[:count] == text_of[n - 1 : n - 1 + count]


class Seeds:
    """The seeds of a block of items, sorted by hash, and the items' words."""

    def __init__(self, items: Sequence[tuple[int, str]], n: int):
        whole, a, b, text_of, hashes = words_of([t for _, t in items])
        grams, one = _grams(hashes, text_of, n)
        at = np.flatnonzero(one)
        order = np.argsort(grams[at], kind="stable")
        self.n, self.ids = n, [i for i, _ in items]
        self.grams, self.at = grams[at][order], at[order]
        self.words = [whole[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        self.item_of = text_of
        self.first = np.searchsorted(text_of, np.arange(len(items) + 1))
        self.bloom = np.zeros(1 << _BLOOM_BITS, bool)
        self.bloom[self.grams >> np.uint64(64 - _BLOOM_BITS)] = True

    def hits(self, grams: np.ndarray, one: np.ndarray) -> Iterator[tuple[int, int]]:
        """(word position in the documents, word position in the items) of every shared seed."""
        maybe = np.flatnonzero(self.bloom[grams >> np.uint64(64 - _BLOOM_BITS)] & one)
        low = np.searchsorted(self.grams, grams[maybe], "left")
        high = np.searchsorted(self.grams, grams[maybe], "right")
        for k in np.flatnonzero(high > low).tolist():
            for s in range(low[k], high[k]):
                yield int(maybe[k]), int(self.at[s])


def tiles(pairs: Sequence[tuple[int, int]], n: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of the seeds of one document and item: (position here, position there, words).

    Seeds on one diagonal that follow each other make one match. The longest
    match is marked first; what overlaps a marked tile on either side is cut,
    and pieces of at least n words stay in play.
    """
    diagonals: dict[int, list[int]] = defaultdict(list)
    for d, i in set(pairs):
        diagonals[d - i].append(d)
    matches = []
    for shift, ds in diagonals.items():
        ds.sort()
        start = prev = ds[0]
        for d in [*ds[1:], -1]:
            if d != prev + 1:
                matches.append((prev - start + n, start, start - shift))
                start = d
            prev = d
    heap = sorted(matches, key=lambda m: (m[0], -m[1], -m[2]))
    here: set[int] = set()
    there: set[int] = set()
    out = []
    while heap:
        size, d, i = heap.pop()
        free = [k for k in range(size) if d + k not in here and i + k not in there]
        if len(free) == size:
            here.update(range(d, d + size))
            there.update(range(i, i + size))
            out.append((d, i, size))
            continue
        runs: list[list[int]] = []
        for k in free:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        heap += [(len(r), d + r[0], i + r[0]) for r in runs if len(r) >= n]
        heap.sort(key=lambda m: (m[0], -m[1], -m[2]))
    return out


_FOUND = "doc_id bigint, item_id bigint, longest int, covered int, item_words int"


def _scan(docs: DataFrame, shared: Broadcast[Seeds]) -> DataFrame:

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Seeds = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for first, texts in chunks(batch.column(1).to_pylist()):
                whole, a, b, text_of, hashes = words_of(texts)
                grams, one = _grams(hashes, text_of, s.n)
                pairs: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
                for d, i in s.hits(grams, one):
                    pairs[int(text_of[d]), int(s.item_of[i])].append((d, i))
                for (doc, item), found in pairs.items():
                    real = [
                        t
                        for t in tiles(found, s.n)
                        if all(whole[a[t[0] + k] : b[t[0] + k]] == s.words[t[1] + k] for k in range(t[2]))
                    ]
                    if real:
                        size = int(s.first[item + 1] - s.first[item])
                        rows.append((ids[first + doc], s.ids[item], max(t[2] for t in real), sum(t[2] for t in real), size))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "longest", "covered", "item_words"])

    return docs.mapInArrow(run, _FOUND)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_words: int = 12,
    min_coverage: float = 0.0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Which documents contain which items: doc_id, item_id, longest, covered, item_words.

    ``docs`` has doc_id and text, ``items`` item_id and text. A pair counts if
    tiles of at least ``min_words`` words cover at least ``min_coverage`` of
    the item. Null and empty texts, and items shorter than ``min_words``,
    match nothing; repeated rows give one row; empty tables give none. Items
    of one id count as one id, each text for itself.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    wanted = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")
    # each text once, however many items have it
    texts_of = cut(wanted.groupBy("text").agg(F.min("item_id").alias("rep")))
    out = None
    block: list[tuple[int, str]] = []
    size = 0

    def scanned(block: list[tuple[int, str]], more: bool) -> DataFrame:
        # with several blocks each one's seeds leave memory before the next come
        shared = docs.sparkSession.sparkContext.broadcast(Seeds(block, min_words))
        found = _scan(texts, shared)
        if more or out is not None:
            found = cut(found)
            shared.destroy()
        return found if out is None else out.unionByName(found)

    # the texts come one by one, a block of bounded size is held at a time
    for row in texts_of.orderBy("rep", "text").toLocalIterator():
        block.append((row.rep, row.text))
        size += len(row.text)
        if size >= block_chars:
            out = scanned(block, True)
            block, size = [], 0
    if block or out is None:
        out = scanned(block, False)
    members = wanted.join(texts_of, "text").select(F.col("rep").alias("_rep"), F.col("item_id").alias("_item")).distinct()
    out = out.join(members, F.col("item_id") == F.col("_rep")).withColumn("item_id", F.col("_item")).drop("_rep", "_item")
    best = F.max(F.struct("covered", "longest", "item_words"))
    return (
        out.groupBy("doc_id", "item_id")
        .agg(best.alias("b"))
        .select("doc_id", "item_id", "b.longest", "b.covered", "b.item_words")
        .where(F.col("covered") >= min_coverage * F.col("item_words"))
    )


def leak_report(found: DataFrame) -> DataFrame:
    """Per leaked item: in how many documents it stands, and the highest share of it in one."""
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.round(F.max(F.col("covered") / F.col("item_words")), 6).alias("best_share"),
    )
