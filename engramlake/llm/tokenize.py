"""Encoding a corpus with a public byte-level BPE tokenizer (problem 8).

Pre-tokenisation runs without a regular expression: code points become class
codes, each class is a transition function of a small automaton, and a prefix
scan over the (associative) composition of these functions gives the
automaton's state at every character of a whole batch at once. States plus the
class of the next character tell where a slice starts. Slices feed pair
merging behind a cache; their offsets are kept, so ids can be mapped back.

The rules located are those of the pattern that belongs to the vocabulary:
contractions after an apostrophe, runs of letters, of numbers and of other
characters with one leading blank each, and white space whose last character
goes to what follows.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.llm.codepoints import category_flags, chunks, joined, white_space

#: Slices a worker keeps with their ids; when full, the cache starts anew.
CACHE_SLICES = 200_000

# Classes of code points, and states: what the character before belongs to.
SEP, WS, SP, LET, NUM, OTH, APO, STMD, R_, V_, L_, E_ = range(12)
S_START, S_WS, S_SP, S_LET, S_NUM, S_OTH, S_APO, S_DONE, S_R, S_V, S_L = range(11)
_LETTERS = (LET, STMD, R_, V_, L_, E_)


def _step(state: int, cls: int) -> int:
    """The automaton: the state after reading a character of class ``cls`` in ``state``."""
    plain = {SEP: S_START, WS: S_WS, SP: S_SP, NUM: S_NUM, OTH: S_OTH}
    if cls in plain:
        return plain[cls]
    if cls == APO:  # alone at the start of a slice it may open a contraction
        return S_OTH if state in (S_SP, S_OTH, S_APO) else S_APO
    if state == S_APO:
        return {STMD: S_DONE, R_: S_R, V_: S_V, L_: S_L}.get(cls, S_LET)
    if (cls == E_ and state in (S_R, S_V)) or (cls == L_ and state == S_L):
        return S_DONE
    return S_LET


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, OTH, np.uint8)
    out[category_flags("L")] = LET
    out[category_flags("N")] = NUM
    out[white_space()] = WS
    out[ord(" ")] = SP
    out[ord("'")] = APO
    for c in "stmd":
        out[ord(c)] = STMD
    for c, k in (("r", R_), ("v", V_), ("l", L_), ("e", E_)):
        out[ord(c)] = k
    return out


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, composition table, state of each element applied to the start)."""
    gens = [tuple(_step(s, c) for s in range(11)) for c in range(12)]
    known = {tuple(range(11)): 0}
    todo = [*known]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    els = list(known)
    comp = np.array([[known[tuple(b[x] for x in a)] for b in els] for a in els], np.uint8)
    assert len(els) < 256
    return np.array([known[g] for g in gens], np.uint8), comp, np.array([f[S_START] for f in els], np.uint8)


def _prefix(elements: np.ndarray, comp: np.ndarray, block: int = 256) -> np.ndarray:
    """Inclusive prefix scan by blocks: all blocks advance together, then their totals are scanned alike."""
    n = len(elements)
    rows = -(-n // block)
    if rows <= 1:
        out = elements.copy()
        for i in range(1, n):
            out[i] = comp[out[i - 1], out[i]]
        return out
    grid = np.zeros((block, rows), np.uint8)  # element 0 is the identity
    padded = np.zeros(rows * block, np.uint8)
    padded[:n] = elements
    grid[:] = padded.reshape(rows, block).T
    flat, width = comp.ravel(), comp.shape[1]
    for i in range(1, block):
        grid[i] = flat[grid[i - 1].astype(np.int32) * width + grid[i]]
    carry = np.zeros(rows, np.uint8)
    carry[1:] = _prefix(grid[-1], comp, block)[:-1]
    grid = flat[carry.astype(np.int32) * width + grid]
    return grid.T.reshape(-1)[:n]


@cache
def _start_rule() -> np.ndarray:
    """start[state before, class]: 1 starts a slice, 0 does not, 2 depends on the next character."""
    out = np.zeros((11, 12), np.uint8)
    for s in range(11):
        for c in range(12):
            if c in (WS, SP):
                out[s, c] = 2 if s in (S_WS, S_SP) else 1
            elif c == NUM:
                out[s, c] = s not in (S_SP, S_NUM)
            elif c in (OTH, APO):
                out[s, c] = s not in (S_SP, S_OTH, S_APO)
            elif c in _LETTERS:
                if s == S_APO:
                    out[s, c] = {STMD: 0, R_: 2, V_: 2, L_: 2}.get(c, 1)
                else:
                    out[s, c] = s not in (S_SP, S_LET, S_R, S_V, S_L)
    for s, c in ((S_R, E_), (S_V, E_), (S_L, L_)):
        out[s, c] = 0
    return out


def slice_starts(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags of the characters at which a slice starts; ``ends`` are the separators' positions."""
    cls = _classes()[points]
    cls[ends] = SEP
    element, comp, applied = _monoid()
    after = applied[_prefix(element[cls], comp)]
    before = np.empty_like(after)
    before[:1], before[1:] = S_START, after[:-1]
    rule = _start_rule()[before, cls]
    start = rule == 1
    open_ = np.flatnonzero(rule == 2)
    this, nxt = cls[open_], cls[np.minimum(open_ + 1, len(cls) - 1)]
    blank = (this == WS) | (this == SP)
    # the last blank before something visible starts a slice; a contraction of two letters needs its second
    last = blank & (nxt != WS) & (nxt != SP) & (nxt != SEP)
    unfit = ~blank & (((this != L_) & (nxt != E_)) | ((this == L_) & (nxt != L_)))
    start[open_] = last | unfit
    return start


def load_ranks(data: bytes) -> dict[bytes, int]:
    """The content of a rank file: one base64 piece and its id per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of the lowest rank is merged until none is left."""
    n = len(piece)
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = end[i]
        if j < n and (r := ranks.get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, j, end[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        _, i, j, e = heapq.heappop(heap)
        if not alive[i] or end[i] != j or j >= n or not alive[j] or end[j] != e:
            continue
        alive[j], end[i] = False, e
        if e < n:
            left[e] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """A vocabulary, from the content of its rank file, with its slice cache; one per Python worker."""

    def __init__(self, data: bytes, compiled: bool = True):
        ranks = load_ranks(data)
        self.bytes_of = {v: k for k, v in ranks.items()}
        try:  # the same merges in compiled form, one slice at a time
            if not compiled:
                raise ImportError
            import tiktoken

            core = tiktoken.Encoding("slices", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
            self.merge = lambda s: tuple(core.encode_single_piece(s.encode("utf-8")))
        except (ImportError, AttributeError):
            self.merge = lambda s: tuple(merge_pairs(s.encode("utf-8"), ranks))
        self.cache: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, number of ids of each slice, first character of each slice in its text, slices of each text)."""
        whole, points, firsts, ends = joined(texts)
        start = slice_starts(points, ends)
        marks = start.copy()
        marks[ends] = True
        at = np.flatnonzero(marks)
        is_slice = start[at]
        a = at[is_slice]
        b = np.append(at[1:], len(points))[is_slice]
        get, cache_, merge = self.cache.get, self.cache, self.merge
        ids = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            piece = whole[x:y]
            found = get(piece)
            if found is None:
                if len(cache_) >= CACHE_SLICES:
                    cache_.clear()
                found = cache_[piece] = merge(piece)
            ids.append(found)
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
        text_of = np.searchsorted(ends, a)
        return flat, sizes, (a - firsts[text_of]).astype(np.int32), np.bincount(text_of, minlength=len(texts))

    def decode(self, ids: Sequence[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


@cache
def encoder(data: bytes) -> Encoder:
    return Encoder(data)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def encode_corpus(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False
) -> DataFrame:
    """The token ids of every row: id_col, ids array<int>.

    ``path`` names a rank file (about a megabyte) that is read here and sent to
    the workers. With ``offsets``,
    also slice_start (first character of each slice) and slice_ids (its number
    of ids): the ids of slice k are the next slice_ids[k] ones. Empty and null
    texts give empty lists; repeated rows are encoded each, rows keep a null
    id, other columns are dropped. Nothing is shuffled.
    """

    shared = df.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                flat, sizes, starts, per_text = enc.encode(texts)
                # ids per text: sums over its slices
                edge = np.concatenate(([0], np.cumsum(per_text)))
                total = np.concatenate(([0], np.cumsum(sizes)))
                cols = [batch.column(0).slice(first, len(texts)), _lists(flat, np.diff(total[edge]))]
                if offsets:
                    cols += [_lists(starts, per_text), _lists(sizes, per_text)]
                yield pa.RecordBatch.from_arrays(cols, names)

    names = [id_col, "ids"] + ["slice_start", "slice_ids"] * offsets
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, ids array<int>" + ", slice_start array<int>, slice_ids array<int>" * offsets
    return df.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every row's ids: id_col, text. Null lists give null, empty ones ''; an unknown id fails."""

    shared = df.sparkSession.sparkContext.broadcast(read_file(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value)
        for batch in batches:
            texts = [None if x is None else enc.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
