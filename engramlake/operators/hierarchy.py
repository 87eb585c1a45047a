"""Parent-child rows to full hierarchies (problem 1).

Bottom-up leaf peeling: an edge (child, parent) is a leaf edge while nothing
below its child is left. Every round takes all leaf edges away and sends the
subtree sizes of their children to the parents. What no round can take lies on
a cycle. In reverse peel order each child then extends its parent's path.

Rounds are distributed joins. Real trees lose most of their nodes in the first
rounds and keep a thin residue of long chains. Peeling goes on while a round
takes away at least a third of the edges, so what all rounds write, down and
back, is a geometric series of the table's size. The residue then goes one of
two ways with equal results: at most ``local_edges`` edges (counted, not
assumed) are peeled by one task; a larger residue is resolved by pointer
doubling, whose rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.session import cut, drop

#: Edges that one task may peel by itself; 65,536 edges are about 10 MB there.
LOCAL_EDGES = 65_536
#: Peeling goes on while a round leaves at most this share of the edges.
PEEL_LEAVES = 2 / 3

_RESOLVED = "id bigint, parent_id bigint, root_id bigint, depth int, path string, n_below bigint"


def parent_edges(df: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a table: ids once, and the (child, parent) pairs whose parent exists.

    Rows without an id are ignored. Repeated rows count once; of contradicting
    parents of one id the smallest counts.
    """
    nodes = (
        df.select(F.col(id_col).cast("long").alias("child"), F.col(parent_col).cast("long").alias("parent"))
        .where(F.col("child").isNotNull())
        .groupBy("child")
        .agg(F.min("parent").alias("parent"))
    )
    known = nodes.select(F.col("child").alias("known"))
    edges = nodes.where(F.col("parent").isNotNull()).join(known, F.col("parent") == F.col("known"), "left_semi")
    return nodes, edges


def _peel_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All remaining rounds and the way back, over one bounded set of edges."""
    up: dict[int, int] = {}
    below: dict[int, int] = {}
    for b in batches:
        for c, p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            up[c], below[c] = p, n
    waiting: dict[int, int] = {}
    for p in up.values():
        waiting[p] = waiting.get(p, 0) + 1
    layer = [c for c in up if c not in waiting]
    order: list[int] = []
    while layer:
        order += layer
        above = []
        for c in layer:
            p = up[c]
            if p in below:
                below[p] += below[c] + 1
            waiting[p] -= 1
            if not waiting[p] and p in up:
                above.append(p)
        layer = above
    cyclic = set(up).difference(order)
    root: dict[int, int] = dict.fromkeys(cyclic, -1)
    kids: dict[int, list[int]] = {}
    for c in reversed(order):
        p = up[c]
        if root.get(p) == -1:
            root[c] = -1
        else:
            kids.setdefault(p, []).append(c)
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True))
        out.clear()
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64()]
        names = ["id", "parent_id", "root_id", "depth", "path", "n_below"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    for c, r in root.items():
        out.append((c, up[c], -1, -1, "", below[c] if c not in cyclic else -1))
        if len(out) >= 4096:
            yield flush()
    # depth first, so only the paths of one branch are held at a time
    for top in [p for p in kids if p not in up]:
        stack = [(c, 1, str(top)) for c in kids[top]]
        while stack:
            c, depth, prefix = stack.pop()
            path = f"{prefix}/{c}"
            out.append((c, up[c], top, depth, path, below[c]))
            stack += [(k, depth + 1, path) for k in kids.get(c, ())]
            if len(out) >= 4096:
                yield flush()
    if out:
        yield flush()


def _below_parent(layer: DataFrame, resolved: DataFrame) -> DataFrame:
    """Children of ``layer`` given the resolved nodes above them; an unresolved parent is a root."""
    above = resolved.select(
        F.col("id").alias("_p"), F.col("root_id").alias("_r"), F.col("depth").alias("_d"), F.col("path").alias("_path")
    )
    lost: Column = F.col("_r") == -1
    return layer.join(above, F.col("parent") == F.col("_p"), "left").select(
        F.col("child").alias("id"),
        F.col("parent").alias("parent_id"),
        F.coalesce("_r", "parent").alias("root_id"),
        F.when(lost, -1).otherwise(F.coalesce("_d", F.lit(0)) + 1).cast("int").alias("depth"),
        F.when(lost, "")
        .otherwise(F.concat_ws("/", F.coalesce(F.col("_path"), F.col("parent").cast("string")), F.col("child")))
        .alias("path"),
        F.col("n_below"),
    )


def _climbed(up: DataFrame, extra: dict[str, tuple[Column, Column]], most: int | None, sizes: bool = False) -> DataFrame:
    """``up`` (child, parent, top, done, steps, ...) after doubling its climbs until all are done or longer than ``most``.

    A climb is done when ``top`` has no parent. ``extra`` says how a column
    goes on at the top: (the top's column under a new name, the combination of
    both). With ``sizes``, n_below grows by what lies as far below as climbs
    reach, so in the end it is the whole subtree.
    """
    reach = 1
    while True:
        if (most is not None and reach > most) or up.where("NOT done").isEmpty():
            return up
        above = up.select(F.col("child").alias("_a"), F.col("top").alias("_top"), F.col("done").alias("_done"), F.col("steps").alias("_steps"), *[a for a, _ in extra.values()])
        new = up.join(above, ~F.col("done") & (F.col("top") == F.col("_a")), "left")
        if sizes:
            # of the sums on a cycle nothing is kept, so they may overflow
            sent = up.where("NOT done").groupBy(F.col("top").alias("_t")).agg(F.try_sum(F.col("n_below") + 1).alias("_sent"))
            new = new.join(sent, F.col("child") == F.col("_t"), "left")
        changed = {
            "top": F.coalesce("_top", "top"),
            "done": F.coalesce("_done", "done"),
            "steps": F.col("steps") + F.coalesce("_steps", F.lit(0)),
            "n_below": F.try_add("n_below", F.coalesce("_sent", F.lit(0))) if sizes else F.col("n_below"),
            **{c: how for c, (_, how) in extra.items()},
        }
        new = cut(new.select(*[changed.get(c, F.col(c)).alias(c) for c in up.columns]))
        drop(up)
        up, reach = new, 2 * reach


def _doubled(rest: DataFrame, left: int) -> DataFrame:
    """``resolve_children`` for ``left`` edges (child, parent, n_below) by pointer doubling.

    First without paths: a climb of more steps than there are edges never
    ends, and the nodes such climbs are at are the cycles. Then the paths of
    those that end.
    """
    ends = rest.select(F.col("child").alias("_c"))
    up = cut(
        rest.join(ends, F.col("parent") == F.col("_c"), "left").select(
            "child", "parent", F.col("parent").alias("top"), F.col("_c").isNull().alias("done"), F.lit(1).cast("long").alias("steps"), "n_below"
        )
    )
    known = _climbed(up, {}, left, sizes=True)
    endless = known.where("NOT done")
    loops = endless.select(F.col("top").alias("_l")).distinct()
    lost = endless.join(loops, F.col("child") == F.col("_l"), "left").select(
        F.col("child").alias("id"), F.col("parent").alias("parent_id"), F.lit(-1).cast("long").alias("root_id"), F.lit(-1).alias("depth"), F.lit("").alias("path"),
        F.when(F.col("_l").isNotNull(), -1).otherwise(F.col("n_below")).cast("long").alias("n_below"),
    )
    finite = known.where("done").select("child", "parent", F.col("parent").alias("top"), (F.col("steps") == 1).alias("done"), F.lit(1).cast("long").alias("steps"), "n_below", F.col("child").cast("string").alias("path"))
    longer = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat_ws("/", "_path", "path"))
    paths = _climbed(cut(finite), {"path": (F.col("path").alias("_path"), longer)}, None)
    return lost.unionByName(
        paths.select(
            F.col("child").alias("id"), F.col("parent").alias("parent_id"), F.col("top").alias("root_id"), F.col("steps").cast("int").alias("depth"),
            F.concat_ws("/", F.col("top").cast("string"), "path").alias("path"), "n_below",
        )
    )


def resolve_children(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """One row per edge (child, parent): id, parent_id, root_id, depth, path, n_below.

    Nodes on a cycle and nodes whose ancestors run into one get root_id -1,
    depth -1 and path ''; n_below is -1 for nodes on a cycle. No edges: no rows.
    """
    spark = edges.sparkSession
    rest = cut(edges.select("child", "parent", F.lit(0).cast("long").alias("n_below")))
    left = rest.count()
    layers: list[DataFrame] = []
    while left > local_edges:
        fan_in = rest.groupBy("parent").agg(F.count(F.lit(1)).alias("kids")).withColumnRenamed("parent", "_p")
        marked = cut(rest.join(fan_in, F.col("child") == F.col("_p"), "left").drop("_p"))
        leaves = marked.where(F.col("kids").isNull()).drop("kids")
        sizes = leaves.groupBy("parent").agg(F.sum(F.col("n_below") + 1).alias("_sent")).withColumnRenamed("parent", "_p")
        inner = (
            marked.where(F.col("kids").isNotNull())
            .drop("kids")
            .join(sizes, F.col("child") == F.col("_p"), "left")
            .select("child", "parent", (F.col("n_below") + F.coalesce("_sent", F.lit(0))).alias("n_below"))
        )
        inner = cut(inner)
        now, before = inner.count(), left
        layers.append(leaves)
        drop(rest)
        rest, left = inner, now
        if now > PEEL_LEAVES * before:
            break
    if left > local_edges:
        resolved = _doubled(rest, left)
    elif left:
        resolved = rest.coalesce(1).mapInArrow(_peel_here, _RESOLVED)
    else:
        resolved = spark.createDataFrame([], _RESOLVED)
    for layer in reversed(layers):
        resolved = cut(resolved)
        resolved = resolved.unionByName(_below_parent(layer, resolved))
    return resolved


def hierarchy(
    df: DataFrame, id_col: str = "id", parent_col: str = "parent_id", local_edges: int = LOCAL_EDGES
) -> DataFrame:
    """Every node of a parent-child table: id, root_id, depth, path, n_below.

    A parent that is null or no id of the table makes a root: depth 0, path its
    own id. Cyclic nodes and nodes below a cycle: root_id -1, depth -1, path ''.
    n_below is the number of nodes beneath (-1 on a cycle). Other columns of
    the input are ignored, repeated rows count once, an empty table gives none.
    """
    nodes, edges = parent_edges(df, id_col, parent_col)
    inner = cut(resolve_children(edges, local_edges))
    sizes = inner.where("root_id <> -1").groupBy(F.col("root_id").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    roots = (
        nodes.join(inner.select(F.col("id").alias("_c")), F.col("child") == F.col("_c"), "left_anti")
        .join(sizes, F.col("child") == F.col("_r"), "left")
        .select(
            F.col("child").alias("id"),
            F.col("child").alias("root_id"),
            F.lit(0).alias("depth"),
            F.col("child").cast("string").alias("path"),
            F.coalesce("_n", F.lit(0)).cast("long").alias("n_below"),
        )
    )
    return roots.unionByName(inner.select("id", "root_id", "depth", "path", "n_below"))


def descendants(nodes: DataFrame) -> DataFrame:
    """All (ancestor_id, id, distance) pairs of a resolved hierarchy, one row each.

    Rows, not lists: the list below a root may be a third of the table.
    """
    steps = F.split("path", "/")
    return (
        nodes.where("depth > 0")
        .select("id", "depth", F.posexplode(steps).alias("at", "step"))
        .where(F.col("at") < F.col("depth"))
        .select(
            F.col("step").cast("long").alias("ancestor_id"),
            "id",
            (F.col("depth") - F.col("at")).cast("int").alias("distance"),
        )
    )


def _around(loops: DataFrame) -> DataFrame:
    """(id, above, steps) for the other members of each loop, given its (id, parent_id) edges; steps double each round."""
    pairs = cut(loops.where("id <> parent_id").select("id", F.col("parent_id").alias("above"), F.lit(1).alias("steps")))
    n, far = pairs.count(), 1
    while True:
        ends = pairs.where(F.col("steps") == far)
        on = pairs.select(F.col("id").alias("above"), F.col("above").alias("_next"), F.col("steps").alias("_s"))
        more = ends.join(on, "above").select("id", F.col("_next").alias("above"), (F.col("steps") + F.col("_s")).cast("int").alias("steps"))
        pairs = cut(pairs.unionByName(more.where("id <> above")).groupBy("id", "above").agg(F.min("steps").alias("steps")))
        now = pairs.count()
        if now == n:
            return pairs
        n, far = now, far * 2


def all_descendants(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``descendants``, and the pairs of the trees that hang off loops: below each of their nodes and below every loop member.

    Members of a loop are not listed as beneath each other; ``cycle_members`` has them.
    """
    edges = cut(edges)
    nodes = cut(resolve_children(edges, local_edges))
    hanging = nodes.where("root_id = -1 AND n_below <> -1").select(F.col("id").alias("child"), F.col("parent_id").alias("parent"))
    loose = cut(resolve_children(hanging, local_edges))  # a loop member is a root there
    around = _around(cycle_members(edges, nodes))
    tops = loose.select("root_id", F.col("id").alias("_low"), "depth").join(around, F.col("root_id") == F.col("id"))
    beyond = tops.select(F.col("above").alias("ancestor_id"), F.col("_low").alias("id"), (F.col("depth") + F.col("steps")).cast("int").alias("distance"))
    return descendants(nodes).unionByName(descendants(loose)).unionByName(beyond)


def cycle_members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes that lie on a cycle themselves (n_below -1), with their parent."""
    on = nodes.where("n_below = -1").select("id")
    return edges.join(on, edges["child"] == on["id"], "left_semi").select(
        F.col("child").alias("id"), F.col("parent").alias("parent_id")
    )
