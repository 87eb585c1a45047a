"""The most similar vectors for every vector (problem 7).

Balanced posting lists: hierarchical k-means over a bounded sample cuts the
space into cells of about equal weight, and cells that stay heavy are split
again; the cells' centroids form an in-memory graph of several layers, each an
eighth of the one below, and walking down it finds the nearest centroids of a
vector. A vector is posted to its nearest list and, near a boundary, to every
further list whose distance is within a ratio of the nearest one. As every
vector is also a query, the same rule selects the lists a query reads, so one
routing serves both: two vectors meet where their lists overlap. Inside a list
all similarities come from matrix products; exact values are kept for the best.

The number of lists grows with the vectors: where the sample's cells would
hold too many, each is cut into lists of its own, fitted by the executors on
rows of the cell, so lists keep their length at any size.

Vectors that are equal bit by bit are one point with its smallest ids, so a
group of copies never fills a list. ``exact_neighbours`` compares with all
rows instead of lists, for the vectors asked about.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import cut

#: Rows the index is fitted on (all rows are indexed), and wanted points in a list.
SAMPLE_ROWS, LIST_ROWS = 65_536, 512
#: A list is read or written if its distance is at most RATIO times the nearest one's; at most MAX_LISTS of them.
RATIO, MAX_LISTS = 1.08, 3
#: Expected rows of a sample's cell beyond which it is cut into lists of its own.
BLOCK_ROWS = 8_192
#: Rows that a list of a cell is fitted on (about), and the heaviest list against the mean.
FIT_ROWS, HEAVIEST = 64, 2.0
#: Neighbours of a centroid in the graph, and centroids a walk keeps.
GRAPH_LINKS, WALK_WIDTH = 64, 16
#: Each layer of the graph against the one below.
LAYER = 8
#: Similarities that are held at a time while centroids are fitted and linked.
PRODUCT = 4_000_000
#: Queries that one pass over all rows carries.
QUERY_ROWS = 16_384


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (lengths in double precision)."""
    length = np.sqrt((vectors.astype(np.float64) ** 2).sum(1, keepdims=True))
    return (vectors / length).astype(np.float32)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Cell of each row after spherical k-means."""
    centre = x[rng.choice(len(x), k, replace=False)]
    cell = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        cell = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, cell, x)
        size = np.sqrt((total**2).sum(1))
        alive = size > 0
        centre[alive] = total[alive] / size[alive, None]
    return cell


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """Centroids of cells of the sample, each split until none holds more than its share."""
    rng = np.random.default_rng(seed)
    share = max(1, 3 * len(x) // (2 * max(1, lists)))  # cells end up between a half and a whole of it
    todo, out = [x], []
    while todo:
        part = todo.pop()
        if len(part) <= share:
            mean = part.mean(0)
            size = np.sqrt((mean**2).sum())
            out.append(mean / size if size > 1e-6 else part[0])
            continue
        k = min(8, max(2, -(-len(part) // share)))
        cell = _kmeans(part, k, rng)
        cells = [part[cell == c] for c in range(k)]
        if max(map(len, cells)) == len(part):  # cannot be told apart
            cells = [part[::2], part[1::2]]
        todo += [c for c in cells if len(c)]
    return np.array(out, np.float32)


def even_centroids(x: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """``balanced_centroids`` whose lists, by nearest centroid, are split until none is far heavier than the mean."""
    c = balanced_centroids(x, lists, seed)
    rng = np.random.default_rng(seed)
    for _ in range(6):
        cell = nearest(x, c)
        size = np.bincount(cell, minlength=len(c))
        heavy = np.flatnonzero(size > HEAVIEST * len(x) / len(c))
        if not len(heavy):
            break
        more = []
        for k in heavy:
            part = x[cell == k]
            label = _kmeans(part, min(8, max(2, round(len(part) * len(c) / len(x)))), rng)
            means = np.array([part[label == t].mean(0) for t in np.unique(label)])
            more.append(unit(means + np.float32(1e-12)))
        c = np.concatenate([np.delete(c, heavy, 0), *more]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, by products of bounded size."""
    step = max(16, min(4096, PRODUCT // max(1, len(c))))
    return np.concatenate([(x[i : i + step] @ c.T).argmax(1) for i in range(0, len(x), step)] or [np.zeros(0, np.int64)])


class CentroidGraph:
    """Centroids with links to near and some far ones, in layers; a walk starts at the few centroids of the top one."""

    def __init__(self, centroids: np.ndarray, links: int = GRAPH_LINKS, seed: int = 11, layers: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.c = centroids
        if layers is not None:
            self.layers = layers
            return
        n = len(centroids)
        rng = np.random.default_rng(seed)
        order = rng.permutation(n)
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []  # centroids of a layer, links by their places in it
        size = n
        while True:
            nodes = np.sort(order[:size])
            x = centroids[nodes]
            near = min(links, size)
            step = max(16, min(1024, PRODUCT // max(1, size)))
            rows = [np.argpartition(-(x[i : i + step] @ x.T), near - 1, axis=1)[:, :near].astype(np.int32) for i in range(0, size, step)]
            far = rng.integers(0, max(1, size), (size, 4))  # long links keep the graph connected
            self.layers.append((nodes, np.concatenate([np.concatenate(rows) if rows else np.zeros((0, 0), int), far], 1).astype(np.int32)))
            if size <= max(16, math.isqrt(n)):
                break
            size = max(16, size // LAYER)

    def search(self, q: np.ndarray, width: int = WALK_WIDTH, hops: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """(centroids, similarities) of the ``width`` nearest ones found, best first (-1 where fewer exist)."""
        rows, sims = [], []
        step = max(256, 40_000_000 // max(1, len(self.c)))
        for i in range(0, len(q), step):
            node, sim = self._search(q[i : i + step], width, hops)
            rows.append(node)
            sims.append(sim)
        return (np.concatenate(rows), np.concatenate(sims)) if rows else (np.zeros((0, width), np.int64), np.zeros((0, width), np.float32))

    def _search(self, q: np.ndarray, width: int, hops: int) -> tuple[np.ndarray, np.ndarray]:
        nodes, _ = self.layers[-1]
        start = q @ self.c[nodes].T
        keep = min(width, start.shape[1])
        pick = np.argpartition(-start, keep - 1, axis=1)[:, :keep]
        found, sim = nodes[pick], np.take_along_axis(start, pick, 1)
        for nodes, links in self.layers[-2::-1] if len(self.layers) > 1 else self.layers:
            found, sim = self._walk(q, nodes, links, np.searchsorted(nodes, found), sim, width, hops)
        order = np.argsort(-sim, axis=1)
        found, sim = np.take_along_axis(found, order, 1), np.take_along_axis(sim, order, 1)
        found[~np.isfinite(sim)] = -1
        return found, sim

    def _walk(self, q: np.ndarray, nodes: np.ndarray, links: np.ndarray, at_start: np.ndarray, start: np.ndarray, width: int, hops: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first walks of all queries together in one layer: those that stand at one centroid are compared with its neighbours by one product."""
        m, n, c = len(q), len(nodes), self.c[nodes]
        seen = np.zeros((m, n), bool)
        opened = np.zeros((m, n), bool)
        keep = at_start.shape[1]
        node = np.full((m, width), -1, np.int64)
        sim = np.full((m, width), -np.inf, np.float32)
        node[:, :keep], sim[:, :keep] = at_start, start
        node[~np.isfinite(sim)] = -1
        np.put_along_axis(seen, np.maximum(node[:, :keep], 0), True, 1)
        active = np.arange(m)
        for hop in range(hops):
            order = np.argsort(-sim[active], axis=1)
            node[active] = np.take_along_axis(node[active], order, 1)
            sim[active] = np.take_along_axis(sim[active], order, 1)
            # the best centroid of each walk that was not left yet; a walk ends when its better half is done
            here = node[active]
            fresh = (here >= 0) & ~np.take_along_axis(opened[active], np.maximum(here, 0), 1)
            fresh[:, max(2, width // 2) :] = False
            go = fresh.any(1)
            active, at = active[go], here[go, fresh[go].argmax(1)]
            if not len(active) or hop == hops - 1:
                break
            opened[active, at] = True
            by = np.argsort(at, kind="stable")
            active, at = active[by], at[by]
            edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
            got = np.empty((len(active), links.shape[1]), np.float32)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                got[a:b] = q[active[a:b]] @ c[links[at[a]]].T
            new = links[at].astype(np.int64)
            old = np.take_along_axis(seen[active], new, 1)
            got[old] = -np.inf
            np.put_along_axis(sub := seen[active], new, True, 1)
            seen[active] = sub
            # a random link may repeat a near one: the first counts
            s = np.argsort(new, axis=1, kind="stable")
            rep = np.zeros_like(old)
            np.put_along_axis(rep, s[:, 1:], np.diff(np.take_along_axis(new, s, 1), axis=1) == 0, 1)
            got[rep] = -np.inf
            all_n = np.concatenate((node[active], new), 1)
            all_s = np.concatenate((sim[active], got), 1)
            best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            sim[active] = np.take_along_axis(all_s, best, 1)
            node[active] = np.take_along_axis(all_n, best, 1)
        return np.where(node >= 0, nodes[np.maximum(node, 0)], nodes[0] if n else 0), sim

    def lists(self, q: np.ndarray, ratio: float = RATIO, most: int = MAX_LISTS) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) pairs: each row's nearest list, and those within ``ratio`` of its distance."""
        node, sim = self.search(q)
        node, sim = node[:, :most], sim[:, :most]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * sim))
        ok = (node >= 0) & np.isfinite(sim) & (d <= ratio * d[:, :1] + 1e-6)
        r, c = np.nonzero(ok)
        return r, node[r, c]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, vec as ``4*dim`` bytes) of the rows with an id and a usable vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            full = np.flatnonzero(v.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
            v, ids = v.take(pa.array(full)), batch.column(0).take(pa.array(full))
            flat = v.flatten()
            x = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(-1, dim)
            ok = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[ok] + np.float32(0)  # -0.0 is 0.0
            raw = pa.Array.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)), raw], ["id", "vec"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return rows.where("id IS NOT NULL AND v IS NOT NULL").mapInArrow(run, "id bigint, vec binary")


def points(vectors: DataFrame) -> DataFrame:
    """Vectors that are equal count as one point: id (the smallest), vec."""
    return vectors.groupBy(F.unhex(F.md5("vec")).alias("h")).agg(F.min("id").alias("id"), F.first("vec").alias("vec")).drop("h")


def _compare(vec: np.ndarray, ids: np.ndarray, other: np.ndarray, other_ids: np.ndarray, k: int, least: float, slack: float = 1e-4) -> Iterator[tuple]:
    """(ids, neighbours, similarities) of the best k of ``other`` for each row, as far as at least ``least``."""
    u, w = unit(vec), unit(other)
    x64, y64 = vec.astype(np.float64), other.astype(np.float64)
    nx, ny = np.sqrt((x64**2).sum(1)), np.sqrt((y64**2).sum(1))
    for i in range(0, len(u), 1024):
        sim = u[i : i + 1024] @ w.T
        sim[ids[i : i + 1024, None] == other_ids[None]] = -2
        near = sim >= least - slack
        wide = np.flatnonzero(near.sum(1) > 4 * k)
        if len(wide):  # far more than k: only what may be among the best k
            edge = -np.partition(-sim[wide], k - 1, axis=1)[:, k - 1 : k]
            near[wide] &= sim[wide] >= edge - slack
        r, c = np.nonzero(near)
        if not len(r):
            continue
        exact = (x64[r + i] * y64[c]).sum(1) / (nx[r + i] * ny[c])
        ok = exact >= least
        r, c, exact = r[ok] + i, c[ok], exact[ok]
        order = np.lexsort((other_ids[c], -exact, r))
        r, c, exact = r[order], c[order], exact[order]
        first = np.searchsorted(r, r)
        best = np.arange(len(r)) - first < k
        yield ids[r[best]], other_ids[c[best]], exact[best]


_FOUND = "id bigint, neighbour bigint, similarity double"
_POSTED = "cell bigint, id bigint, vec binary"


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell as one table, of batches sorted by cell (the first column)."""
    parts: list[pa.RecordBatch] = []

    def split(last: bool) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches(parts).combine_chunks()
        parts.clear()
        cells = rows.column(0).to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True]))).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if b == len(cells) and not last:
                parts.extend(rows.slice(a).to_batches())
            else:
                yield rows.slice(a, b - a)

    for batch in batches:
        if batch.num_rows:
            more = bool(parts) and batch.column(0)[-1] == parts[-1].column(0)[0]
            parts.append(batch)
            if not more:
                yield from split(False)
    if parts:
        yield from split(True)


def _hashed(id_col: str = "id") -> Column:
    return F.xxhash64(id_col, F.lit(17))


def _sample(vectors: DataFrame, n: int, rows: int) -> DataFrame:
    """The vectors of the ``rows`` smallest hashes of ids: the same ones however the rows are stored."""
    part = min(1.0, 1.5 * rows / max(1, n) + 1e-3)
    cutoff = -(1 << 63) + math.ceil(part * ((1 << 64) - 1))
    near = vectors.where(_hashed() <= F.lit(min(cutoff, (1 << 63) - 1))).select(_hashed().alias("h"), "id", "vec")
    return near.orderBy("h", "id").limit(rows)


def _fitted(sample: DataFrame, lists: int, dim: int) -> CentroidGraph:
    """The graph of the sample's centroids, fitted by one task: only centroids and links come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        x = unit(_matrix(pa.Table.from_batches(held).sort_by([("h", "ascending"), ("id", "ascending")]).column(2), dim))
        held.clear()
        graph = CentroidGraph(even_centroids(x, max(1, min(len(x) // 4, lists))))
        parts = [graph.c, *[part for layer in graph.layers for part in layer]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(parts)), pa.int32()), pa.array([p.dtype.str for p in parts]), pa.array([list(p.shape) for p in parts], pa.list_(pa.int64())), pa.array([np.ascontiguousarray(p).tobytes() for p in parts], pa.binary())],
            ["part", "kind", "shape", "data"],
        )

    got = sample.coalesce(1).mapInArrow(run, "part int, kind string, shape array<bigint>, data binary").toArrow().sort_by("part").to_pydict()
    if not got["part"]:  # no rows
        return CentroidGraph(np.ones((1, dim), np.float32) / np.float32(math.sqrt(dim)))
    c, *parts = [np.frombuffer(d, k).reshape(s) for k, s, d in zip(got["kind"], got["shape"], got["data"], strict=True)]
    return CentroidGraph(c, layers=list(zip(parts[::2], parts[1::2], strict=True)))


def _posted(spots: DataFrame, shared: Broadcast[CentroidGraph], dim: int, ratio: float, most: int) -> DataFrame:
    """The vectors under the cells of a graph: cell, id, vec."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = shared.value.lists(unit(_matrix(batch.column(1), dim)), ratio, most)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["cell", "id", "vec"])

    return spots.select("id", "vec").mapInArrow(route, _POSTED)


def _cut_cells(posted: DataFrame, primary: DataFrame, subs: int, share: float, dim: int, ratio: float, most: int) -> DataFrame:
    """The vectors under lists of their cells: each cell is cut into about ``subs`` lists by centroids of its own.

    ``primary`` has each vector under its nearest cell; ``share`` of it is what
    the lists are fitted on, cell by cell, by the executors.
    """
    fitted = primary.where(_hashed() <= F.lit(min((1 << 63) - 1, -(1 << 63) + math.ceil(share * ((1 << 64) - 1)))))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            c = even_centroids(unit(_matrix(rows.column(2).combine_chunks(), dim)), subs)
            raw = pa.Array.from_buffers(pa.binary(4 * dim), len(c), [None, pa.py_buffer(np.ascontiguousarray(c, np.float32).tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), rows.column(0)[0].as_py())), pa.array(np.full(len(c), -1)), raw, pa.array(np.ones(len(c), bool))], ["cell", "id", "vec", "centre"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a cell's centroids come before its vectors, which pass by in batches
        cell, centres, graph = None, [], None
        for batch in batches:
            cells = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1], [True]))).tolist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                rows = batch.slice(a, b - a)
                if cells[a] != cell:
                    cell, centres, graph = cells[a], [], None
                is_centre = rows.column(3).to_numpy(zero_copy_only=False)
                k = int(is_centre.sum())
                x = _matrix(rows.column(2), dim)
                if k:
                    centres.append(x[:k])
                if k == len(x):
                    continue
                if graph is None:
                    graph = CentroidGraph(np.concatenate(centres) if centres else unit(x[:1]))
                row, sub = graph.lists(unit(x[k:]), ratio, most)
                at = pa.array(row + k)
                yield pa.RecordBatch.from_arrays([pa.array((int(cell) << 32) + sub.astype(np.int64)), rows.column(1).take(at), rows.column(2).take(at)], ["cell", "id", "vec"])

    centroids = fitted.repartition("cell").sortWithinPartitions("cell").mapInArrow(fit, _POSTED + ", centre boolean")
    both = posted.withColumn("centre", F.lit(False)).unionByName(cut(centroids))
    return both.repartition("cell").sortWithinPartitions("cell", F.desc("centre")).mapInArrow(place, _POSTED)


def neighbours(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 5, least: float = 0.9, sample_rows: int = SAMPLE_ROWS, list_rows: int = LIST_ROWS, ratio: float = RATIO, most: int = MAX_LISTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For every usable vector its k most similar others: id, neighbour, similarity (cosine).

    Usable: exactly ``dim`` finite numbers, not all 0; other rows and null ids
    are ignored. Only similarities of at least ``least`` count; ties go to the
    smaller id. Repeated rows count once, an empty table gives no rows. A
    vector may lose neighbours that share no list with it; ``ratio`` and
    ``most`` set how many lists it is in, ``exact_neighbours`` loses none.
    """
    vectors = usable_vectors(df, id_col, vector_col, dim)
    spots = points(vectors)
    n = df.count()
    graph = _fitted(_sample(vectors, n, sample_rows), n // list_rows, dim)
    cells, shared = len(graph.c), df.sparkSession.sparkContext.broadcast(graph)
    del graph
    posted = _posted(spots, shared, dim, ratio, most)
    if n * most > cells * block_rows:
        spots = cut(spots)
        subs = -(-n // (cells * list_rows))
        share = min(1.0, FIT_ROWS * subs * cells / n)
        posted = _cut_cells(_posted(spots, shared, dim, ratio, most), _posted(spots, shared, dim, ratio, 1), subs, share, dim, ratio, most)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            ids, vecs = rows.column(1).to_numpy(), _matrix(rows.column(2).combine_chunks(), dim)
            for a, b, sim in _compare(vecs, ids, vecs, ids, k, least):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], ["id", "neighbour", "similarity"])

    found = posted.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, _FOUND)
    return _with_copies(_best(found, k), vectors, k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each vector, of what lists or batches have found for it."""
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    found = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return cut(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r"))


def exact_neighbours(df: DataFrame, asked: DataFrame, id_col: str, vector_col: str, dim: int = 64, k: int = 5, least: float = 0.9, query_rows: int = QUERY_ROWS) -> DataFrame:
    """``neighbours`` of the vectors ``asked`` (same columns) by comparison with all rows, without lists: no loss.

    The queries go to the rows in blocks of bounded size, one pass for each.
    """
    vectors = usable_vectors(df, id_col, vector_col, dim)
    rows = cut(points(vectors))
    wanted = cut(points(usable_vectors(asked, id_col, vector_col, dim)))
    # a query stands for the point it is a copy of
    queries = wanted.withColumn("h", F.md5("vec")).join(rows.select(F.md5("vec").alias("h"), F.col("id").alias("_p")), "h").select(F.col("_p").alias("id"), "vec")
    out, block = None, []

    def scan(block: list[tuple[int, bytes]]) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in block]), np.frombuffer(b"".join(bytes(v) for _, v in block), np.float32).reshape(-1, dim)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vecs = shared.value
            for batch in batches:
                for a, b, sim in _compare(vecs, ids, _matrix(batch.column(1), dim), batch.column(0).to_numpy(), k, least):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sim)], ["id", "neighbour", "similarity"])

        return _best(rows.select("id", "vec").mapInArrow(run, _FOUND), k)

    for row in queries.toLocalIterator():
        block.append((row.id, row.vec))
        if len(block) == query_rows:
            part = scan(block)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = scan(block) if block else rows.sparkSession.createDataFrame([], _FOUND)
        out = part if out is None else out.unionByName(part)
    ids = usable_vectors(asked, id_col, vector_col, dim).select("id").distinct()
    return _with_copies(cut(out), vectors, k).join(ids, "id", "left_semi")


def _with_copies(found: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """From points to rows: a neighbour brings its k + 1 smallest ids, a row its own copies."""
    members = vectors.select("id", F.unhex(F.md5("vec")).alias("h")).distinct()
    least_ids = Window.partitionBy("h").orderBy("id")
    few = members.withColumn("_r", F.row_number().over(least_ids)).where(F.col("_r") <= k + 1).drop("_r")
    rep = members.groupBy("h").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    copied = cut(rep.where("n > 1"))
    if copied.isEmpty():
        return found
    few = cut(few.join(copied.select("h", "rep"), "h").select("rep", F.col("id").alias("copy")))
    each = members.join(copied.select("h", "rep"), "h").select("rep", F.col("id").alias("member"))
    # neighbours of points, each with its copies
    wide = found.join(few.withColumnRenamed("rep", "neighbour"), "neighbour", "left").select(
        "id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity"
    )
    own = few.select(F.col("rep").alias("id"), F.col("copy").alias("neighbour"), F.lit(1.0).alias("similarity"))
    near = wide.unionByName(own)
    best = Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbour")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r")
    # every member of a point has the point's neighbours, itself left out
    rows = near.join(each.withColumnRenamed("rep", "id"), "id", "left").select(
        F.coalesce("member", "id").alias("id"), "neighbour", "similarity"
    )
    return (
        rows.where("id <> neighbour").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    )


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Pairs of which at least one is a neighbour of the other: id_a, id_b (id_a < id_b), each once."""
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
