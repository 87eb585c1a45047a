"""Search: full text with BM25, substrings, hybrid, pyramid, privacy.

A store that is searched often has an ``Index``: its terms with the places
where they stand, sorted by term, and its rows without their texts. A query
string is parsed on the driver; only the row groups of its terms are read, and
the matching ids are joined with the narrow rows. A store without an index is
scanned: each phrase is counted in a document's terms, and the corpus figures
come from one aggregate over the same scan. Substrings are always found by a
scan whose filters reach the files; each task keeps its best rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.text import Node, ascii_lower, parse_query, sanitize_query, tokens
from engramlake.operators.store import PATTERN, active
from engramlake.session import cut

# BM25 parameters, and the weight of terms in more than half of the documents.
K1, B, FLOOR = 1.2, 0.75, 1e-6


def phrase_count(terms: Column, phrase: tuple[str, ...]) -> Column:
    """How often a phrase stands in an array of terms."""
    if len(phrase) == 1:
        return F.size(F.filter(terms, lambda t: t == phrase[0]))
    whole = F.array(*[F.lit(p) for p in phrase])
    n = len(phrase)
    starts = F.when(F.size(terms) >= n, F.sequence(F.lit(1), F.size(terms) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.size(F.filter(starts, lambda i: F.slice(terms, i, n) == whole))


def _matches(node: Node, tf: dict[tuple[str, ...], Column]) -> Column:
    if node.op == "phrase":
        return tf[node.terms] > 0
    kids = [_matches(k, tf) for k in node.kids]
    if node.op == "not":
        return kids[0] & ~kids[1]
    return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), kids)


def postings(store: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """The inverted index: term, id, tf. Rows delivered twice count once."""
    terms = store.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("at", "term"))
    return terms.groupBy("term", id_col).agg(F.size(F.collect_set("at")).cast("long").alias("tf"))


def term_stats(index: Index) -> DataFrame:
    """df of every term, with the number of documents and their mean length: term, df, n_docs, avgdl."""
    figures = index.docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    return index.terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(figures))


#: What an index keeps of each row beside its terms.
CARRIED = ("domain", "level", "ts", "status", "privacy", "parent_id")


@dataclass(frozen=True)
class Index:
    """A written inverted index of a store: rows that searches need, places of terms, and the store itself for substrings."""

    #: id, the carried columns, dl (number of terms)
    docs: DataFrame
    #: term, id, places (positions, ascending), sorted by term
    terms: DataFrame
    #: the indexed rows; repeated ones may still be there
    store: DataFrame

    @property
    def columns(self) -> list[str]:
        return [c for c in self.docs.columns if c != "dl"]


def build_index(store: DataFrame, carried: tuple[str, ...] = CARRIED) -> Index:
    """Index the texts of a store (id, content, carried columns). Rows delivered twice count once.

    Texts are tokenised once and never shuffled; a term's places go to range
    partitions of (term, id), so a frequent term fills many tasks and a query
    reads the row groups of its terms alone.
    """
    rows = store.select("id", *carried, tokens(F.col("content")).alias("_terms"))
    docs = cut(rows.select("id", *carried, F.size("_terms").alias("dl")).distinct())
    places = rows.select("id", F.posexplode("_terms").alias("at", "term")).groupBy("term", "id").agg(F.sort_array(F.collect_set("at")).alias("places"))
    return Index(docs, cut(places.repartitionByRange(F.col("term"), F.col("id")).sortWithinPartitions("term", "id")), store)


def _moved(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _indexed_counts(index: Index, every: list[tuple[str, ...]]) -> DataFrame:
    """id and the count of each phrase (_tf0, _tf1, ...) of the rows that have a term of them."""
    words = sorted({w for p in every for w in p})
    of = {w: F.max(F.when(F.col("term") == w, F.col("places"))).alias(f"_w{k}") for k, w in enumerate(words)}
    column = {w: F.coalesce(F.col(f"_w{k}"), F.array().cast("array<int>")) for k, w in enumerate(words)}
    rows = index.terms.where(F.col("term").isin(words)).groupBy("id").agg(*of.values())

    def count(phrase: tuple[str, ...]) -> Column:
        # places of the first word from which on the others stand
        starts = [_moved(column[w], k) for k, w in enumerate(phrase)]
        return F.size(reduce(F.array_intersect, starts)) if len(starts) > 1 else F.size(column[phrase[0]])

    return rows.select("id", *[count(p).alias(f"_tf{k}") for k, p in enumerate(every)])


def scored(store: DataFrame | Index, query: str) -> DataFrame:
    """All active memories that match, with score (BM25, higher is better). A query without words matches none.

    Corpus figures count all rows, archived ones too, as their text stays
    indexed. Of an index, the rows have its columns; of a plain store, all.
    """
    node = parse_query(query)
    rows = store.docs if isinstance(store, Index) else store
    if node is None:
        return rows.select(*store.columns).limit(0).withColumn("score", F.lit(0.0))
    every = list(dict.fromkeys(node.all_phrases()))
    column = {p: f"_tf{k}" for k, p in enumerate(every)}
    dfs = [F.count_if(F.col(c) > 0).alias(f"{c}_df") for c in column.values()]
    match = _matches(node, {p: F.col(c) for p, c in column.items()})
    if isinstance(store, Index):
        counted = _indexed_counts(store, every)
        figures = counted.agg(*dfs).crossJoin(F.broadcast(store.docs.agg(F.count(F.lit(1)).alias("_n"), F.avg("dl").alias("_avgdl"))))
        rows = active(store.docs).withColumnRenamed("dl", "_dl").join(counted.where(match), "id").crossJoin(F.broadcast(figures))
    else:
        terms = store.withColumn("_terms", tokens(F.col("content")))
        counted = terms.select(*store.columns, F.size("_terms").alias("_dl"), *[phrase_count(F.col("_terms"), p).alias(c) for p, c in column.items()])
        figures = counted.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avgdl"), *dfs)
        rows = active(counted).where(match).crossJoin(F.broadcast(figures))
    score = F.lit(0.0)
    for p in node.phrases():
        c = column[p]
        raw = F.log((F.col("_n") - F.col(f"{c}_df") + 0.5) / (F.col(f"{c}_df") + 0.5))
        idf = F.when(raw <= 0, FLOOR).otherwise(raw)
        norm = F.col(c) + K1 * (1 - B + B * F.col("_dl") / F.col("_avgdl"))
        score = score + idf * F.col(c) * (K1 + 1) / norm
    return rows.select(*store.columns, score.alias("score"))


def search_fts(store: DataFrame | Index, query: str, limit: int = 20) -> DataFrame:
    """The best full-text hits: all columns, score, method, pos (1 is the best)."""
    best = scored(store, sanitize_query(query) if '"' not in query else query).orderBy(F.desc("score"), "id").limit(limit)
    return _placed(best, F.desc("score"), F.col("id")).withColumn("method", F.lit("fts"))


def search_like(store: DataFrame | Index, query: str, limit: int = 10) -> DataFrame:
    """Active memories that contain the text, ASCII case ignored, newest first; score 1.0.

    Rows delivered twice have one rank, so each task hands on the rows of its
    ``limit`` best ranks, whatever the number of hits.
    """
    rows = store.store if isinstance(store, Index) else store
    hit = active(rows).where(ascii_lower(F.col("content")).contains(ascii_lower(F.lit(query)))).select(*store.columns)
    rank = F.dense_rank().over(Window.orderBy(F.desc("ts"), "id"))
    best = hit.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r").dropDuplicates(["id"]).withColumn("score", F.lit(1.0))
    return _placed(best, F.desc("ts"), F.col("id")).withColumn("method", F.lit("like"))


def _placed(best: DataFrame, *order: Column) -> DataFrame:
    """``pos`` of a few rows that a limit has bounded already."""
    return best.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def visible(search_domain: str | None) -> Column:
    """Privacy: what a search from a domain (None: the user's own search over all) may show."""
    privacy = F.coalesce("privacy", F.lit("open"))
    if search_domain is None:
        return privacy != "sealed"
    same = F.coalesce("domain", F.lit("")) == search_domain
    guarded = (privacy != "guarded") | (F.coalesce("level", F.lit(0)) >= PATTERN)
    return same | ((privacy != "sealed") & guarded)


def _merged(store: DataFrame | Index, query: str, fts: int, like: int) -> DataFrame:
    """Both kinds of hits, each memory once: full text before substring."""
    both = search_fts(store, query, fts).withColumn("src", F.lit(0)).unionByName(search_like(store, query, like).withColumn("src", F.lit(1)))
    return _once(both)


def _once(both: DataFrame) -> DataFrame:
    w = Window.partitionBy("id").orderBy("src", "pos")
    return both.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def hybrid_search(store: DataFrame | Index, query: str, limit: int = 10, domain: str | None = None, context_domain: str | None = None) -> DataFrame:
    """Hits of both kinds, the higher levels first, then by score.

    ``domain`` restricts the hits; ``context_domain`` is where the search comes
    from, for privacy (``domain`` if not given). Filters come after the limits
    of the two searches.
    """
    rows = _merged(store, query, 2 * limit, limit)
    if domain is not None:
        rows = rows.where(F.col("domain") == domain)
    rows = rows.where(visible(context_domain if context_domain is not None else domain))
    return rows.orderBy(F.desc(F.coalesce("level", F.lit(0))), F.desc("score"), "src", "pos").limit(limit)


def pyramid_search(store: DataFrame | Index, query: str, limit: int = 10, domain: str | None = None, start_level: int = 2) -> DataFrame:
    """Principles with their children first, then patterns, then facts while there is room.

    stage and pos give the order. A level is searched with limits twice as wide
    before it is filtered. Privacy holds for all hits and children.
    """
    allowed = visible(domain)
    # the narrower limits are the first places of the widest, so both searches run once
    widest = 10
    found = search_fts(store, query, 2 * widest).withColumn("src", F.lit(0)).unionByName(search_like(store, query, widest).withColumn("src", F.lit(1)))
    found = cut(found)

    def level_hits(level: int, n: int) -> DataFrame:
        near = found.where(F.col("pos") <= F.when(F.col("src") == 0, 2 * n).otherwise(n))
        hits = _once(near).where(F.col("level") == level)
        if domain is not None:
            hits = hits.where(F.col("domain") == domain)
        w = Window.partitionBy(F.lit(0)).orderBy("src", "pos")
        return hits.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= n)

    shape = [*store.columns, "score", "method", "stage", "pos", "sub"]
    parts = []
    if start_level >= 2:
        top = level_hits(2, 3).where(allowed)
        parts.append(top.withColumn("stage", F.lit(0)).withColumn("sub", F.lit(0)).select(*shape))
        heads = top.select(F.col("id").alias("_p"), F.col("score").alias("_s"), F.col("pos").alias("_pos"))
        kids = active(store.docs if isinstance(store, Index) else store).where(allowed).join(F.broadcast(heads), F.col("parent_id") == F.col("_p"))
        w = Window.partitionBy("_p").orderBy(F.desc("ts"), "id")
        parts.append(
            kids.withColumn("sub", F.row_number().over(w)).where(F.col("sub") <= limit)
            .withColumn("score", F.col("_s") * 0.8).withColumn("method", F.lit("drill")).withColumn("stage", F.lit(0)).withColumn("pos", F.col("_pos")).select(*shape)
        )
    if start_level >= 1:
        parts.append(level_hits(1, 5).where(allowed).withColumn("stage", F.lit(1)).withColumn("sub", F.lit(0)).select(*shape))
    parts.append(level_hits(0, 10).where(allowed).withColumn("stage", F.lit(2)).withColumn("sub", F.lit(0)).select(*shape))
    rows = reduce(DataFrame.unionByName, parts)
    w = Window.partitionBy("id").orderBy("stage", "pos", "sub")
    once = rows.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")
    return once.orderBy("stage", "pos", "sub", "id").limit(limit)


def knn(store: DataFrame, query: list[float], k: int = 10, dim: int = 64) -> DataFrame:
    """The k memories whose embedding is most similar to the query vector: id, similarity."""
    from engramlake.functions.vectors import dot

    q = F.array(*[F.lit(float(x)) for x in query])
    usable = (F.size("embedding") == dim) & F.forall("embedding", lambda x: ~F.isnan(x)) & F.exists("embedding", lambda x: x != 0)
    length = F.sqrt(dot(F.col("embedding"), F.col("embedding")))
    norm = sum(x * x for x in query) ** 0.5
    sim = F.round(dot(F.col("embedding"), q) / (length * F.lit(norm)), 6)
    return store.where(usable).select("id", sim.alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)
