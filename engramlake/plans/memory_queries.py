"""Queries of the memory engine's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions import rules as R
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.functions.embedding import embed
from engramlake.operators import consolidate as C
from engramlake.operators import gate as G
from engramlake.operators import habits as H
from engramlake.operators import refine as E
from engramlake.operators import search as S
from engramlake.operators import store as ST
from engramlake.operators import triples as TR
from engramlake.operators import votes as VO
from engramlake.operators.history import SINGLE_VALUED
from engramlake.session import scratch, table
from engramlake.sources import readers as RD
from engramlake.streaming import ingest as IN

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: The time queries run at, and what they look for.
NOW = 1_751_500_000.0
WORD, OTHER, BESIDE, PHRASE, SUBSTRING, DOMAIN, AS_OF, SUBJECT = "kettle", "harbour", "never", "night market", "Tea House", "work", 1_700_000_000.0, "user"

MEMORY_COLUMNS = ["id", "content", "domain", "ts", "level", "parent_id", "status", "privacy", "hit_count", "last_hit_at", "decay_count", "created_at", "metadata"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def raw(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Memories as delivered, rows delivered twice still twice, with the columns needed."""
    return table(spark, sf, "memories").select(*(dict.fromkeys(["id", *cols]) if cols else MEMORY_COLUMNS))


def mem(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Memories, each once, with the columns needed (default: all but the embedding); filters on them reach the scan."""
    return ST.once(raw(spark, sf, *cols))


def raw_msgs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages").select("msg_id", "conv_id", "turn", "role", "content", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))


def msgs(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(raw_msgs(spark, sf))


def tris(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(table(spark, sf, "triples"))


def votes(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(table(spark, sf, "votes"))


_INDEXES: dict[tuple[str, str], S.Index] = {}


def index(spark: SparkSession, sf: str) -> S.Index:
    """The written index of a store's memories; like any index it is built once and then searched, as long as the session lasts."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = S.build_index(raw(spark, sf, "content", *S.CARRIED))
    return _INDEXES[key]


_MEM = f"mem AS (SELECT DISTINCT {', '.join(MEMORY_COLUMNS)} FROM memories)"
_MSG = "msg AS (SELECT DISTINCT msg_id, conv_id, turn, role, content, epoch_us(ts) / 1e6 AS ts FROM messages)"
_TRI = "tri AS (SELECT DISTINCT * FROM triples)"
_VOT = "vot AS (SELECT DISTINCT * FROM votes)"
_WITH = f"WITH {_MEM} "
_ACTIVE = "status = 'active'"
_STRIP = r"regexp_replace({}, '^[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+|[\s\x0b\x{{85}}\x{{a0}}\x{{2000}}-\x{{200a}}\x{{3000}}]+$', '', 'g')"
_LOW_ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+".replace("{{", "{").replace("}}", "}")
_TOKENS = r"coalesce(regexp_extract_all(strip_accents(lower(content)), '[\p{L}\p{N}\p{Co}]+'), [])"


# --- store -----------------------------------------------------------------


@query("memory_project", _WITH + "SELECT id, content, domain, level, status, privacy, coalesce(CASE WHEN json_valid(metadata) THEN json_extract_string(metadata, '$.category') END, '') AS category FROM mem")
def memory_project(spark: SparkSession, sf: str) -> DataFrame:
    rows = ST.metadata_map(raw(spark, sf, "content", "domain", "level", "status", "privacy", "metadata"))
    return ST.once(rows.select("id", "content", "domain", "level", "status", "privacy", F.coalesce(F.col("metadata")["category"], F.lit("")).alias("category")))


@query("memory_get", _WITH + "SELECT id, content, domain, level, status FROM mem WHERE id = (SELECT min(id) FROM mem)")
def memory_get(spark: SparkSession, sf: str) -> DataFrame:
    """A row by its id: the id reaches the scan, and as it is unique the first of equal rows will do."""
    wanted = table(spark, sf, "memories").agg(F.min("id")).scalar()
    return raw(spark, sf, "content", "domain", "level", "status").where(F.col("id") == wanted).limit(1)


@query("memory_exists", _WITH + f"SELECT DISTINCT a.id FROM mem a JOIN mem b ON a.content = b.content AND a.domain = b.domain WHERE a.status = 'archived' AND b.{_ACTIVE}")
def memory_exists(spark: SparkSession, sf: str) -> DataFrame:
    """The archived memories that were stored again."""
    rows = raw(spark, sf, "content", "domain", "status")
    return ST.exists(rows, rows.where("status = 'archived'")).select("id").distinct()


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    return G.gate(raw_msgs(spark, sf))  # equal texts count once there


@query("memory_add_dedup")
def memory_add_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return ST.add_new(mem(spark, sf, "content", "domain", "status"), _gated(spark, sf)).select("id", "content", "domain", "ts")


@query("memory_update", _WITH + ", d AS (SELECT parent_id AS id, count(*) AS n FROM mem WHERE parent_id IS NOT NULL GROUP BY 1) SELECT mem.id, CAST(coalesce(d.n, mem.hit_count) AS INTEGER) AS hit_count, mem.status FROM mem LEFT JOIN d ON d.id = mem.id")
def memory_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "hit_count", "status", "parent_id")
    delta = rows.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).cast("int").alias("hit_count"))
    return ST.updated(rows, delta.withColumnRenamed("parent_id", "id")).select("id", "hit_count", "status")


@query("memory_delete", _WITH + "SELECT id, domain, status FROM mem WHERE id NOT IN (SELECT memory_id FROM deletions WHERE memory_id IS NOT NULL)")
def memory_delete(spark: SparkSession, sf: str) -> DataFrame:
    gone = table(spark, sf, "deletions").select(F.col("memory_id").alias("id")).where("id IS NOT NULL")
    return ST.deleted(mem(spark, sf, "domain", "status"), gone)


@query("list_by_domain", _WITH + f"SELECT domain, id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY level DESC NULLS LAST, ts DESC, id) AS rn FROM mem WHERE {_ACTIVE} AND domain <> '') WHERE rn <= 50")
def list_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    rows = ST.active(mem(spark, sf, "domain", "level", "ts", "status")).where("domain <> ''")
    return ST.newest(rows, 50, ["domain"], F.col("level").desc_nulls_last(), F.desc("ts"), F.col("id")).select("domain", "id", "rn")


@query("list_by_level", _WITH + f"SELECT level, id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY level ORDER BY hit_count DESC, ts DESC, id) AS rn FROM mem WHERE {_ACTIVE}) WHERE rn <= 50")
def list_by_level(spark: SparkSession, sf: str) -> DataFrame:
    rows = ST.active(mem(spark, sf, "level", "hit_count", "ts", "status"))
    return ST.newest(rows, 50, ["level"], F.desc("hit_count"), F.desc("ts"), F.col("id")).select("level", "id", "rn")


@query("get_children", _WITH + f"SELECT c.parent_id, c.id, c.ts FROM mem c WHERE c.{_ACTIVE} AND c.parent_id IN (SELECT id FROM mem WHERE level = 2)")
def get_children(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "parent_id", "ts", "status", "level")
    return ST.children(rows, rows.where("level = 2").select("id")).select("parent_id", "id", "ts")


@query("count_by_domain_level", _WITH + f"SELECT domain, level, count(*) AS n FROM mem WHERE {_ACTIVE} GROUP BY ALL")
def count_by_domain_level(spark: SparkSession, sf: str) -> DataFrame:
    return ST.active(mem(spark, sf, "domain", "level", "status")).groupBy("domain", "level").agg(F.count(F.lit(1)).alias("n"))


@query("memory_stats", _WITH + f"SELECT count(*) FILTER ({_ACTIVE}) AS total_active, count(*) FILTER ({_ACTIVE} AND level = 0) AS facts, count(*) FILTER ({_ACTIVE} AND level = 1) AS patterns, count(*) FILTER ({_ACTIVE} AND level = 2) AS principles, count(*) FILTER (status = 'archived') AS archived FROM mem")
def memory_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ST.counts(mem(spark, sf, "status", "level"))


@query("memory_rollup", _WITH + f"SELECT domain, level, CAST(grouping(domain, level) AS INTEGER) AS depth, count(*) AS n FROM mem WHERE {_ACTIVE} GROUP BY ROLLUP (domain, level)")
def memory_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return ST.level_rollup(mem(spark, sf, "domain", "level", "status"))


@query("list_domains", _WITH + "SELECT domain, count(*) AS memory_count FROM mem WHERE domain <> '' GROUP BY 1")
def list_domains(spark: SparkSession, sf: str) -> DataFrame:
    return ST.domain_counts(mem(spark, sf, "domain"))


@query("active_domains", _WITH + "SELECT domain, count(*) AS memory_count FROM mem WHERE domain <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def active_domains(spark: SparkSession, sf: str) -> DataFrame:
    return E.active_domains(mem(spark, sf, "domain"))


_HITS = "SELECT unnest(source_ids) AS id, created_at AS t FROM habits"


@query("hit_rollup", _WITH + f", h AS (SELECT id, count(*) AS n, max(t) AS t FROM ({_HITS}) GROUP BY 1) SELECT mem.id, CAST(mem.hit_count + coalesce(h.n, 0) AS INTEGER) AS hit_count, greatest(mem.last_hit_at, h.t) AS last_hit_at FROM mem LEFT JOIN h ON h.id = mem.id")
def hit_rollup(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "habits").select(F.explode("source_ids").alias("id"), F.col("created_at").alias("ts"))
    return ST.hit_rollup(mem(spark, sf, "hit_count", "last_hit_at"), hits)


_DECAYS = f"((last_hit_at > 0 AND last_hit_at < {NOW - 30 * 86400}) OR (hit_count = 0 AND created_at < {NOW - 30 * 86400}))"
_NEWEST_FACTS = f"(SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id) AS rn FROM mem WHERE {_ACTIVE} AND level = 0 AND domain <> '')"


@query("decay_candidates", _WITH + f"SELECT id, decay_count FROM {_NEWEST_FACTS} WHERE {_DECAYS}")
def decay_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return ST.decay_candidates(mem(spark, sf, "domain", "level", "status", "ts", "hit_count", "last_hit_at", "created_at", "decay_count"), NOW)


@query("decay_apply", _WITH + f", d AS (SELECT id FROM {_NEWEST_FACTS} WHERE {_DECAYS}) SELECT mem.id, CAST(coalesce(decay_count, 0) + CASE WHEN d.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS decay_count, CASE WHEN d.id IS NOT NULL AND coalesce(decay_count, 0) + 1 >= 3 THEN 'archived' ELSE status END AS status FROM mem LEFT JOIN d ON d.id = mem.id")
def decay_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "domain", "level", "status", "ts", "hit_count", "last_hit_at", "created_at", "decay_count")
    return ST.decayed(rows, NOW).select("id", "decay_count", "status")


# --- search ----------------------------------------------------------------


def _tf_sql(phrase: str) -> str:
    words = X.python_tokens(phrase)
    if len(words) == 1:
        return f"len(list_filter(ws, lambda x: x = '{words[0]}'))"
    n = len(words)
    listed = ", ".join(f"'{w}'" for w in words)
    return f"len(list_filter(generate_series(1, greatest(len(ws) - {n - 1}, 0)), lambda i: ws[i : i + {n - 1}] = [{listed}]))"


def _fts_sql(phrases: list[str], where: str, score: list[int] | None = None) -> str:
    """CTEs up to ``hit``: active matching memories with score; tf columns are t0, t1, ..."""
    score = list(range(len(phrases))) if score is None else score
    tfs = ", ".join(f"{_tf_sql(p)} AS t{k}" for k, p in enumerate(phrases))
    dfs = ", ".join(f"count(*) FILTER (t{k} > 0) AS d{k}" for k in range(len(phrases)))
    parts = [f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - d{k} + 0.5) / (d{k} + 0.5)) END) * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for k in score]
    return (
        f"WITH {_MEM}, w AS (SELECT *, {_TOKENS} AS ws FROM mem), c AS (SELECT *, len(ws) AS dl, {tfs} FROM w), f AS (SELECT count(*) AS n, avg(dl) AS avgdl, {dfs} FROM c),"
        f" hit AS (SELECT c.*, {' + '.join(parts)} AS score FROM c, f WHERE {_ACTIVE} AND {where})"
    )


_COLS = "id, domain, level, round(score, 6) AS score"


def _found(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("id", "domain", "level", F.round("score", 6).alias("score"), *more)


@query("fts_and", _fts_sql([WORD, BESIDE], "t0 > 0 AND t1 > 0") + f" SELECT {_COLS} FROM hit")
def fts_and(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.scored(index(spark, sf), f"{WORD} {BESIDE}"))


@query("fts_or", _fts_sql([WORD, OTHER], "(t0 > 0 OR t1 > 0)") + f" SELECT {_COLS} FROM hit")
def fts_or(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.scored(index(spark, sf), f"{WORD} OR {OTHER}"))


@query("fts_not", _fts_sql([WORD, OTHER], "t0 > 0 AND NOT t1 > 0", [0]) + f" SELECT {_COLS} FROM hit")
def fts_not(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.scored(index(spark, sf), f"{WORD} NOT {OTHER}"))


@query("fts_phrase", _fts_sql([PHRASE], "t0 > 0") + f" SELECT {_COLS} FROM hit")
def fts_phrase(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.scored(index(spark, sf), f'"{PHRASE}"'))


@query("fts_sanitize", _fts_sql(["second hand", WORD], "t0 > 0 AND t1 > 0") + f" SELECT {_COLS} FROM hit")
def fts_sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.scored(index(spark, sf), X.sanitize_query(f"second-hand {WORD}!")))


_FTS20 = "fts AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS pos FROM hit QUALIFY pos <= {n})"
_LIKE10 = (
    "lk AS (SELECT *, 1.0 AS score, row_number() OVER (ORDER BY ts DESC, id) AS pos FROM mem WHERE " + _ACTIVE + " AND contains("
    + _LOW_ASCII.format("content") + ", '{q}') QUALIFY pos <= {n})"
)


@query("search_fts", _fts_sql([WORD], "t0 > 0") + ", " + _FTS20.format(n=20) + f" SELECT {_COLS}, 'fts' AS method, CAST(pos AS INTEGER) AS pos FROM fts")
def search_fts(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_fts(index(spark, sf), WORD, 20), "method", "pos")


@query("search_like", _WITH + ", " + _LIKE10.format(q=SUBSTRING.lower(), n=10) + f" SELECT {_COLS}, 'like' AS method, CAST(pos AS INTEGER) AS pos FROM lk")
def search_like(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.search_like(index(spark, sf), SUBSTRING, 10), "method", "pos")


_BOTH = (
    ", {p}u AS (SELECT id, domain, level, privacy, ts, score, 'fts' AS method, 0 AS src, pos FROM {p}fts UNION ALL SELECT id, domain, level, privacy, ts, score, 'like', 1, pos FROM {p}lk),"
    " {p}m AS (SELECT * FROM {p}u QUALIFY row_number() OVER (PARTITION BY id ORDER BY src, pos) = 1)"
)
_HYBRID = _fts_sql([WORD], "t0 > 0") + ", " + _FTS20.format(n=20) + ", " + _LIKE10.format(q=WORD, n=10) + _BOTH.format(p="")


@query("hybrid_search", _HYBRID + f" SELECT {_COLS}, method FROM m WHERE coalesce(privacy, 'open') <> 'sealed' ORDER BY coalesce(level, 0) DESC, m.score DESC, src, pos LIMIT 10")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.hybrid_search(index(spark, sf), WORD), "method")


@query("bridge_projection", _HYBRID + " SELECT CAST(id AS VARCHAR) AS key, substr(content, 1, 50) AS title, round(-score, 6) AS rank FROM (SELECT m.*, mem.content FROM m JOIN mem USING (id) WHERE coalesce(m.privacy, 'open') <> 'sealed' ORDER BY coalesce(m.level, 0) DESC, m.score DESC, src, pos LIMIT 10)")
def bridge_projection(spark: SparkSession, sf: str) -> DataFrame:
    best = S.hybrid_search(index(spark, sf), WORD).select("id", "score")
    rows = mem(spark, sf, "content").join(F.broadcast(best), "id")  # ten rows
    return rows.select(F.col("id").cast("string").alias("key"), F.substring("content", 1, 50).alias("title"), F.round(-F.col("score"), 6).alias("rank"))


@query("simple_search", _HYBRID + f" SELECT content, domain, CASE coalesce(level, 0) WHEN 2 THEN 'principle' WHEN 1 THEN 'pattern' ELSE 'fact' END AS level, round(score, 6) AS score FROM (SELECT m.*, mem.content FROM m JOIN mem USING (id) WHERE m.domain = '{DOMAIN}') ORDER BY score DESC LIMIT 10")
def simple_search(spark: SparkSession, sf: str) -> DataFrame:
    best = S.hybrid_search(index(spark, sf), WORD, domain=DOMAIN).select("id", "domain", "level", "score")
    rows = mem(spark, sf, "content").join(F.broadcast(best), "id")  # ten rows
    name = F.when(F.col("level") == 2, "principle").when(F.col("level") == 1, "pattern").otherwise("fact")
    return rows.select("content", "domain", name.alias("level"), F.round("score", 6).alias("score"))


_VISIBLE = f"(coalesce(domain, '') = '{DOMAIN}' OR (coalesce(privacy, 'open') <> 'sealed' AND (coalesce(privacy, 'open') <> 'guarded' OR coalesce(level, 0) >= 1)))"


@query("privacy_filter", _WITH + f"SELECT id, coalesce(privacy, 'open') <> 'sealed' AS to_all, {_VISIBLE} AS to_domain FROM mem")
def privacy_filter(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(raw(spark, sf, "privacy", "domain", "level").select("id", S.visible(None).alias("to_all"), S.visible(DOMAIN).alias("to_domain")))


def _pyramid_sql() -> str:
    """All three levels: hits of each in its own limits, children of principles behind them."""
    out = _fts_sql([WORD], "t0 > 0")
    for level, n in ((2, 3), (1, 5), (0, 10)):
        p = f"p{level}"
        out += ", " + f"{p}{_FTS20.format(n=2 * n)}" + ", " + f"{p}{_LIKE10.format(q=WORD, n=n)}" + _BOTH.format(p=p)
        out += f", l{level} AS (SELECT *, row_number() OVER (ORDER BY src, pos) AS p FROM {p}m WHERE level = {level} QUALIFY p <= {n})"
    out += ", top AS (SELECT * FROM l2 WHERE coalesce(privacy, 'open') <> 'sealed')"
    out += f", kid AS (SELECT mem.id, mem.domain, mem.level, top.score * 0.8 AS score, 'drill' AS method, top.p AS pos, row_number() OVER (PARTITION BY top.id ORDER BY mem.ts DESC, mem.id) AS sub FROM mem JOIN top ON mem.parent_id = top.id WHERE mem.{_ACTIVE} AND coalesce(mem.privacy, 'open') <> 'sealed' QUALIFY sub <= 10)"
    out += (
        ", rows_ AS (SELECT id, domain, level, score, method, 0 AS stage, p AS pos, 0 AS sub FROM top UNION ALL SELECT id, domain, level, score, method, 0, pos, sub FROM kid"
        " UNION ALL SELECT id, domain, level, score, method, 1, p, 0 FROM l1 WHERE coalesce(privacy, 'open') <> 'sealed' UNION ALL SELECT id, domain, level, score, method, 2, p, 0 FROM l0 WHERE coalesce(privacy, 'open') <> 'sealed')"
        ", one AS (SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY stage, pos, sub) = 1)"
    )
    return out


@query("pyramid_search", _pyramid_sql() + f" SELECT {_COLS}, method, stage FROM one ORDER BY one.stage, one.pos, one.sub, one.id LIMIT 10")
def pyramid_search(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.pyramid_search(index(spark, sf), WORD), "method", "stage")


@query("pyramid_drill", _pyramid_sql() + f" SELECT {_COLS}, method FROM (SELECT * FROM one ORDER BY stage, pos, sub, id LIMIT 100) one WHERE stage = 0")
def pyramid_drill(spark: SparkSession, sf: str) -> DataFrame:
    return _found(S.pyramid_search(index(spark, sf), WORD, limit=100).where("stage = 0"), "method")


@query("bm25_stats", f"WITH {_MEM}, w AS (SELECT {_TOKENS} AS ws FROM mem), f AS (SELECT count(*) AS n_docs, round(avg(len(ws)), 6) AS avgdl FROM w) SELECT term, count(*) AS df, n_docs, avgdl FROM (SELECT unnest(list_distinct(ws)) AS term FROM w), f GROUP BY ALL")
def bm25_stats(spark: SparkSession, sf: str) -> DataFrame:
    return S.term_stats(index(spark, sf)).withColumn("avgdl", F.round("avgdl", 6))


@query("postings", f"WITH {_MEM} SELECT term, id, count(*) AS tf FROM (SELECT id, unnest({_TOKENS}) AS term FROM mem) GROUP BY ALL")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    return S.postings(raw(spark, sf, "content"))


_Q64 = [((k * 37) % 19 - 9) / 10 for k in range(64)]
_LEN = sum(x * x for x in _Q64) ** 0.5


@query("knn_cosine", "WITH e AS (SELECT DISTINCT id, CAST(embedding AS DOUBLE[]) AS v FROM memories WHERE len(embedding) = 64), g AS (SELECT * FROM e WHERE len(list_filter(v, lambda x: isnan(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)" + f" SELECT id, round(list_dot_product(v, CAST({_Q64} AS DOUBLE[])) / (sqrt(list_dot_product(v, v)) * {_LEN!r}), 6) AS similarity FROM g ORDER BY 2 DESC, 1 LIMIT 10")
def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return S.knn(mem(spark, sf, "embedding"), _Q64, 10)


# --- messages, gate, profile ------------------------------------------------


@query("messages_scan", f"WITH {_MSG} SELECT msg_id, conv_id, turn, role, content FROM msg WHERE role IS NOT NULL AND content IS NOT NULL")
def messages_scan(spark: SparkSession, sf: str) -> DataFrame:
    return msgs(spark, sf).where("role IS NOT NULL AND content IS NOT NULL").select("msg_id", "conv_id", "turn", "role", "content")


@query("messages_jsonl", f"WITH {_MSG} SELECT role, content, ts FROM msg WHERE role IS NOT NULL AND content IS NOT NULL")
def messages_jsonl(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as JSON lines and read back."""
    path = scratch(spark)
    msgs(spark, sf).select("role", "content", F.col("ts").alias("timestamp")).write.json(path)
    return RD.read_messages(spark, path).select("role", "content", "ts")


@query("transcript_humans", f"WITH {_MSG} SELECT count(*) AS n_human FROM msg WHERE role = 'user' OR conv_id % 2 = 0")
def transcript_humans(spark: SparkSession, sf: str) -> DataFrame:
    """Human messages of transcripts of both kinds: those that name a type, those that name a role."""
    path = scratch(spark)
    msgs(spark, sf).select(F.when(F.col("conv_id") % 2 == 0, "human").alias("type"), "role", "content").write.json(path)
    return RD.human_messages(RD.read_transcript(spark, path))


@query("human_message_count", f"WITH {_MSG} SELECT count(*) FILTER (role = 'user') AS n_human FROM msg")
def human_message_count(spark: SparkSession, sf: str) -> DataFrame:
    return RD.human_messages(msgs(spark, sf))


@query("user_messages", f"WITH {_MSG} SELECT msg_id, conv_id, turn, content FROM msg WHERE role = 'user'")
def user_messages(spark: SparkSession, sf: str) -> DataFrame:
    return G.user_messages(msgs(spark, sf)).select("msg_id", "conv_id", "turn", "content")


def _case_sql(col: str) -> str:
    arms = " ".join(f"WHEN regexp_matches({col}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{c}'" for p, c in R.GATE_PATTERNS)
    return f"CASE {arms} END"


def _domain_sql(col: str) -> str:
    scores = {d: " + ".join(f"CAST(contains(lower({col}), '{w}') AS INTEGER)" for w in ws) for d, ws in R.DOMAIN_KEYWORDS.items()}
    best = "greatest(" + ", ".join(scores.values()) + ")"
    arms = " ".join(f"WHEN ({s}) = {best} THEN '{d}'" for d, s in scores.items())
    return f"CASE WHEN {best} = 0 THEN '' {arms} END"


_GATED = (
    f"WITH {_MSG}, t AS (SELECT {_STRIP.format('content')} AS content, ts FROM msg WHERE role = 'user' AND content IS NOT NULL),"
    f" g AS (SELECT content, min(ts) AS ts, {_case_sql('content')} AS category, {_domain_sql('content')} AS domain FROM t WHERE {_case_sql('content')} IS NOT NULL GROUP BY content)"
)


@query("gate_extract", _GATED + " SELECT content, domain, category, CASE WHEN domain IN ('health', 'finance') THEN 'guarded' ELSE 'open' END AS privacy, 0 AS level, ts FROM g")
def gate_extract(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).select("content", "domain", "category", "privacy", "level", "ts")


@query("gate_counters", _GATED + " SELECT (SELECT count(*) FROM msg) AS processed, (SELECT count(*) FROM g) AS matched, coalesce((SELECT string_agg(domain, ',' ORDER BY domain) FROM (SELECT DISTINCT domain FROM g WHERE domain <> '')), '') AS domains")
def gate_counters(spark: SparkSession, sf: str) -> DataFrame:
    return G.gate_counters(raw_msgs(spark, sf))


ORACLE["memory_add_dedup"] = (
    _GATED + f", {_MEM}, fresh AS (SELECT g.content, g.domain, g.ts FROM g WHERE NOT EXISTS (SELECT 1 FROM mem WHERE mem.{_ACTIVE} AND mem.content = g.content AND coalesce(mem.domain, '') = g.domain))"
    " SELECT (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY ts, content, domain) AS id, content, domain, ts FROM fresh"
)


@query("detect_domain", _WITH + f"SELECT id, {_domain_sql('content')} AS detected FROM mem WHERE content IS NOT NULL")
def detect_domain(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(raw(spark, sf, "content").where("content IS NOT NULL").select("id", R.detect_domain(F.col("content")).alias("detected")))


def _captures_sql(rules, keep: str, tag: str) -> str:
    parts = [
        f"SELECT {keep}, {tag.format(key)}, {_STRIP.format(f'regexp_extract(content, {chr(39)}{p}{chr(39)}, 1)')} AS value FROM t WHERE regexp_matches(content, '{p}')"
        for p, key in rules
    ]
    return " UNION ALL ".join(f"SELECT * FROM ({x}) WHERE value <> ''" for x in parts)


_USER = f"WITH {_MSG}, t AS (SELECT * FROM msg WHERE role = 'user' AND content IS NOT NULL)"


@query("extract_triples", _USER + f" SELECT msg_id, 'user' AS subject, relation, value AS object FROM ({_captures_sql(R.TRIPLE_PATTERNS, 'msg_id', chr(39) + '{}' + chr(39) + ' AS relation')})")
def extract_triples(spark: SparkSession, sf: str) -> DataFrame:
    rows = G.user_messages(msgs(spark, sf)).where("content IS NOT NULL")
    return TR.from_text(rows, "content", ["msg_id"])


_FACTS = " UNION ALL ".join("(" + _captures_sql(p, "msg_id, conv_id, ts", f"'{facet}' AS facet, '{{}}' AS key") + ")" for facet, p in R.PROFILE_PATTERNS.items())


@query("extract_profile", _USER + f" SELECT msg_id, facet, key, value FROM ({_FACTS})")
def extract_profile(spark: SparkSession, sf: str) -> DataFrame:
    return G.profile_facts(msgs(spark, sf), ["msg_id"]).drop("ts")


@query("profile_who", _USER + f" SELECT conv_id, facet, key, arg_max(value, (ts, value)) AS value FROM ({_FACTS}) WHERE facet IN ('who', 'what') GROUP BY ALL")
def profile_who(spark: SparkSession, sf: str) -> DataFrame:
    return G.profile_latest(G.profile_facts(msgs(spark, sf), ["conv_id"]), ["conv_id"])


_HOW = "SELECT conv_id, key, list_reduce(list(value ORDER BY ts, value), lambda a, x: CASE WHEN contains(a, x) THEN a ELSE a || '; ' || x END) AS value FROM (SELECT conv_id, key, value, min(ts) AS ts FROM f WHERE facet = 'how' GROUP BY ALL) GROUP BY ALL"


@query("profile_how", _USER + f", f AS ({_FACTS}) " + _HOW)
def profile_how(spark: SparkSession, sf: str) -> DataFrame:
    return G.profile_how(G.profile_facts(msgs(spark, sf), ["conv_id"]), ["conv_id"])


@query(
    "digest",
    _USER + f", f AS ({_FACTS}), {_MEM}, lt AS (SELECT conv_id, facet, key, arg_max(value, (ts, value)) AS value FROM f WHERE facet IN ('who', 'what') GROUP BY ALL UNION ALL SELECT conv_id, 'how', key, value FROM ({_HOW})),"
    " parts AS (SELECT conv_id, 'User: ' || string_agg(key || ': ' || value, ', ' ORDER BY key) FILTER (facet = 'who') AS w, 'Style: ' || string_agg(value, '; ' ORDER BY key) FILTER (facet = 'how') AS h, 'Focus: ' || string_agg(value, '; ' ORDER BY key) FILTER (facet = 'what') AS g FROM lt GROUP BY 1),"
    f" d AS (SELECT string_agg(domain, ', ' ORDER BY c DESC, domain) AS d FROM (SELECT domain, count(*) AS c FROM mem WHERE domain <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)), x AS (SELECT conv_id, concat_ws(chr(10), w, h, g, 'Memory: ' || (SELECT count(*) FROM mem WHERE {_ACTIVE}) || ' entries across ' || d.d) AS t FROM parts, d)"
    " SELECT conv_id, CASE WHEN length(t) // 2 <= 250 THEN t ELSE substr(t, 1, CAST(floor(length(t) * 250 / (length(t) // 2)) AS INTEGER)) END AS text FROM x",
)
def digest(spark: SparkSession, sf: str) -> DataFrame:
    return E.digests(G.profile_facts(msgs(spark, sf), ["conv_id"]), ["conv_id"], mem(spark, sf, "domain", "status"))


@query("turn_triggers", f"WITH {_MSG} SELECT msg_id, conv_id, CAST(n AS INTEGER) AS n_turns FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, msg_id) AS n FROM msg) WHERE n % 10 = 0")
def turn_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return G.every_n(msgs(spark, sf), 10).select("msg_id", "conv_id", "n_turns")


@query("save_triggers", f"WITH {_MSG} SELECT msg_id, conv_id, CAST(n AS INTEGER) AS n_human FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, msg_id) AS n FROM msg WHERE role = 'user') WHERE n % 15 = 0")
def save_triggers(spark: SparkSession, sf: str) -> DataFrame:
    return G.save_points(msgs(spark, sf)).select("msg_id", "conv_id", "n_human")


# --- triples ---------------------------------------------------------------

_CLOSED = (
    f"WITH {_TRI}, c AS (SELECT * REPLACE (coalesce(valid_until, CASE WHEN relation IN ('name_is', 'works_at', 'located_in', 'currently_doing')"
    " THEN lead(created_at) OVER (PARTITION BY subject, relation ORDER BY created_at, id) END) AS valid_until) FROM tri)"
)


@query("triples_scd2", _CLOSED + " SELECT id, subject, relation, valid_until FROM c")
def triples_scd2(spark: SparkSession, sf: str) -> DataFrame:
    return TR.closed(tris(spark, sf)).select("id", "subject", "relation", "valid_until")


@query("triples_as_of", _CLOSED + f" SELECT id, subject, relation, object FROM c WHERE valid_from <= {AS_OF} AND (valid_until IS NULL OR valid_until > {AS_OF})")
def triples_as_of(spark: SparkSession, sf: str) -> DataFrame:
    return TR.as_of(TR.closed(tris(spark, sf)), AS_OF).select("id", "subject", "relation", "object")


@query("triples_asof_join", _CLOSED + ", e AS (SELECT DISTINCT id AS event_id, subject, created_at AS at FROM tri WHERE created_at IS NOT NULL) SELECT e.event_id, c.id, c.relation FROM e JOIN c ON c.subject = e.subject AND c.valid_from <= e.at AND (c.valid_until IS NULL OR c.valid_until > e.at) WHERE c.relation IN ('name_is', 'works_at', 'located_in', 'currently_doing')")
def triples_asof_join(spark: SparkSession, sf: str) -> DataFrame:
    rows = tris(spark, sf)
    events = rows.where("created_at IS NOT NULL").select(F.col("id").alias("event_id"), "subject", F.col("created_at").alias("at"))
    states = TR.closed(rows.where(F.col("relation").isin(*SINGLE_VALUED))).select("id", "subject", "relation", "valid_from", "valid_until")
    return TR.asof_join(events, states).select("event_id", "id", "relation")


@query("query_relation", f"WITH {_TRI} SELECT id, subject, object FROM tri WHERE valid_until IS NULL AND relation = 'works_at'")
def query_relation(spark: SparkSession, sf: str) -> DataFrame:
    return TR.current(tris(spark, sf), relation="works_at").select("id", "subject", "object")


@query("query_entity", f"WITH {_TRI} SELECT id, relation, object, created_at FROM tri WHERE valid_until IS NULL AND subject = '{SUBJECT}'")
def query_entity(spark: SparkSession, sf: str) -> DataFrame:
    return TR.current(tris(spark, sf), SUBJECT).select("id", "relation", "object", "created_at").orderBy(F.desc("created_at"), "id")


@query("triple_timeline", f"WITH {_TRI} SELECT id, relation, object, valid_from, valid_until FROM tri WHERE subject = '{SUBJECT}'")
def triple_timeline(spark: SparkSession, sf: str) -> DataFrame:
    return TR.timeline(tris(spark, sf), SUBJECT).select("id", "relation", "object", "valid_from", "valid_until")


@query("triple_count", f"WITH {_TRI} SELECT count(*) FILTER (valid_until IS NULL) AS n_open, count(*) AS n FROM tri")
def triple_count(spark: SparkSession, sf: str) -> DataFrame:
    return tris(spark, sf).agg(F.count_if(F.col("valid_until").isNull()).alias("n_open"), F.count(F.lit(1)).alias("n"))


# --- votes and sharing ------------------------------------------------------

_SCORES = (
    f"WITH {_VOT}, s AS (SELECT entry_id, count(*) FILTER (vote > 0) AS positive, count(*) FILTER (vote < 0) AS negative, count(*) FILTER (is_usage) AS usage_count,"
    " coalesce(min(epoch_us(ts) / 1e6), 0) AS first_seen, coalesce(max(epoch_us(ts) / 1e6) FILTER (vote IS NOT NULL AND vote <> 0), 0) AS last_vote FROM vot WHERE entry_id IS NOT NULL GROUP BY 1),"
    f" z AS (SELECT *, positive - 2.0 * negative AS raw_score, (positive - 2.0 * negative) * exp(-ln(2) / 125.0 * CASE WHEN first_seen > 0 THEN ({NOW} - first_seen) / 86400.0 ELSE 0 END) AS final_score FROM s)"
)


@query("vote_scores", _SCORES + " SELECT entry_id, positive, negative, usage_count, round(raw_score, 6) AS raw_score, round(final_score, 6) AS final_score FROM z")
def vote_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = VO.scores(votes(spark, sf), NOW)
    return rows.select("entry_id", "positive", "negative", "usage_count", F.round("raw_score", 6).alias("raw_score"), F.round("final_score", 6).alias("final_score"))


@query("score_top", _SCORES + " SELECT entry_id, round(final_score, 6) AS final_score FROM z ORDER BY round(final_score, 6) DESC, entry_id LIMIT 20")
def score_top(spark: SparkSession, sf: str) -> DataFrame:
    return VO.top(votes(spark, sf), NOW).select("entry_id", F.round("final_score", 6).alias("final_score"))


@query("score_stats", _SCORES + " SELECT count(*) AS entries, CAST(sum(positive + negative) AS BIGINT) AS votes, CAST(sum(usage_count) AS BIGINT) AS uses, count(*) FILTER (last_vote = 0) AS never_voted FROM z")
def score_stats(spark: SparkSession, sf: str) -> DataFrame:
    return VO.totals(votes(spark, sf)).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.col("positive") + F.col("negative")).alias("votes"), F.sum("usage_count").alias("uses"), F.count_if(F.col("last_vote") == 0).alias("never_voted")
    )


#: A time at which enough votes are young.
VOTED = 1_690_000_000.0


@query("score_verify", _SCORES.replace(str(NOW), str(VOTED)) + " SELECT entry_id FROM z WHERE usage_count >= 5 AND final_score >= 8")
def score_verify(spark: SparkSession, sf: str) -> DataFrame:
    return VO.scores(votes(spark, sf), VOTED).where(VO.proven()).select("entry_id")


@query("score_archivable", _SCORES + f" SELECT entry_id FROM z WHERE (last_vote = 0 AND first_seen > 0 AND ({NOW} - first_seen) / 86400.0 > 180) OR (usage_count >= 10 AND final_score <= 0)")
def score_archivable(spark: SparkSession, sf: str) -> DataFrame:
    return VO.scores(votes(spark, sf), NOW).where(VO.stale()).select("entry_id")


def _re2(pattern: str) -> str:
    """A sharing rule for RE2, which has no look-around and only ASCII classes: what stands beside a match is matched too, classes are spelled out."""
    digit, word = r"\p{Nd}", r"\p{L}\p{N}_"
    for edge, before, after in (("(?<!\\d)", digit, ""), ("(?!\\d)", "", digit)):
        pattern = pattern.replace(edge, f"(?:^|[^{before}])" if before else f"(?:$|[^{after}])")
    if pattern.startswith(r"\b"):
        pattern = f"(?:^|[^{word}])" + pattern[2:]
    if pattern.endswith(r"\b"):
        pattern = pattern[:-2] + f"(?:$|[^{word}])"
    return pattern.replace(r"\d", digit)


_RE2 = {kind: _re2(p) for p, kind in R.SHARING_PII}


def _pii_sql(col: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, '{p}')" for p in _RE2.values()) + ")"


@query("detect_pii", _WITH + "SELECT id, " + ", ".join(f"regexp_matches(content, '{p}') AS {k}" for k, p in _RE2.items()) + " FROM mem WHERE content IS NOT NULL")
def detect_pii(spark: SparkSession, sf: str) -> DataFrame:
    text = raw(spark, sf, "content").where("content IS NOT NULL")
    return ST.once(text.select("id", *[(F.size(R.pii_hits(F.col("content"), [(p, k)])) > 0).alias(k) for p, k in R.SHARING_PII]))


_CUT = r"regexp_replace(regexp_replace(regexp_replace(text, '\[(?:source|来源):?\s*[\p{L}\p{N}_]+\]', '', 'g'), '~/[^\s]+', '', 'g'), '/Users/[\p{L}\p{N}_]+/[^\s]+', '', 'g')"


@query("scrub_text", "SELECT doc_id, " + _STRIP.format(_CUT) + " AS clean FROM documents WHERE text IS NOT NULL")
def scrub_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", R.scrub(F.col("text")).alias("clean"))


def _clean_sql(col: str) -> str:
    return _STRIP.format(_CUT.replace("(text,", f"({col},"))


@query("training_scrub", _WITH + f"SELECT id, CASE WHEN {_pii_sql('content')} THEN '' ELSE {_clean_sql('content')} END AS clean FROM mem WHERE content IS NOT NULL")
def training_scrub(spark: SparkSession, sf: str) -> DataFrame:
    return ST.once(raw(spark, sf, "content").where("content IS NOT NULL").select("id", R.training_scrub(F.col("content")).alias("clean")))


@query("contributor_hash", "SELECT DISTINCT entry_id, substr(sha256(entry_id || ':engramlake'), 1, 16) AS hash FROM votes WHERE entry_id IS NOT NULL")
def contributor_hash(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "votes").select("entry_id").where("entry_id IS NOT NULL").distinct()
    return ids.select("entry_id", R.contributor_hash(F.col("entry_id")).alias("hash"))


@query(
    "contribute_funnel",
    _WITH + f", h AS (SELECT DISTINCT ON (habit_id) * FROM habits), t AS (SELECT *, {_clean_sql('description')} AS text FROM h), e AS (SELECT *, CASE WHEN confidence IS NULL OR confidence < 0.7 THEN 'low_confidence'"
    " WHEN EXISTS (SELECT 1 FROM mem WHERE privacy = 'sealed' AND list_contains(t.source_ids, mem.id)) THEN 'sealed'"
    f" WHEN {_pii_sql('description')} THEN 'pii' WHEN description IS NULL OR length(text) < 10 THEN 'short' END AS early FROM t)"
    " SELECT habit_id, text, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY early IS NULL, text ORDER BY habit_id) > 1 THEN 'duplicate' ELSE 'shared' END) AS outcome FROM e",
)
def contribute_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return E.contribution_funnel(table(spark, sf, "habits"), mem(spark, sf, "privacy"))


# --- consolidation ----------------------------------------------------------

_LINED = f"big AS (SELECT domain FROM mem WHERE domain <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), l AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(lower(content), '{_SPACE}'), lambda x: x <> '')) AS ws, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id) AS rn FROM mem WHERE {_ACTIVE} AND level = 0 AND domain IN (FROM big) QUALIFY rn <= 30)"
_OVERLAP = "CASE WHEN least(len(a.ws), len(b.ws)) > 0 THEN len(list_intersect(a.ws, b.ws)) / least(len(a.ws), len(b.ws)) ELSE 0 END"


@query("redundant_pairs", _WITH + ", " + _LINED + f" SELECT a.domain, a.id AS id_a, b.id AS id_b, round({_OVERLAP}, 6) AS overlap FROM l a JOIN l b ON a.domain = b.domain AND b.rn > a.rn AND b.rn <= a.rn + 3 WHERE a.rn <= 10")
def redundant_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return E.redundant_pairs(mem(spark, sf, "content", "domain", "level", "status", "ts"))


@query("word_overlap", _WITH + f", a AS (SELECT id, parent_id, list_distinct(list_filter(regexp_split_to_array(lower(content), '{_SPACE}'), lambda x: x <> '')) AS ws FROM mem WHERE content IS NOT NULL) SELECT a.id, round({_OVERLAP}, 6) AS overlap FROM a JOIN a b ON a.parent_id = b.id")
def word_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "content", "parent_id").where("content IS NOT NULL").select("id", "parent_id", X.word_set(F.col("content")).alias("ws"))
    above = rows.select(F.col("id").alias("_p"), F.col("ws").alias("wp"))
    return rows.join(above, F.col("parent_id") == F.col("_p")).select("id", F.round(X.word_overlap(F.col("ws"), F.col("wp")), 6).alias("overlap"))


_LINKED = f"link AS (SELECT a.id AS id_a, b.id AS id_b FROM l a JOIN l b ON a.domain = b.domain AND b.rn > a.rn AND b.rn <= a.rn + 3 WHERE a.rn <= 10 AND round({_OVERLAP}, 6) > 0.6)"
_MERGED = "SELECT mem.id, decay_count, CAST(greatest(hit_count, (SELECT max(hit_count) FROM mem b JOIN link ON link.id_b = b.id WHERE link.id_a = mem.id)) AS INTEGER) AS hit_count, CASE WHEN mem.id IN (SELECT id_b FROM link) THEN 'archived' ELSE status END AS status FROM mem"


@query("redundancy_apply", _WITH + ", " + _LINED + ", " + _LINKED + " " + _MERGED)
def redundancy_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "content", "domain", "level", "status", "ts", "hit_count", "decay_count")
    return C.without_redundancy(rows).select("id", "decay_count", "hit_count", "status")


@query(
    "dream_prune",
    f"WITH all_ AS (SELECT DISTINCT {', '.join(MEMORY_COLUMNS)} FROM memories), due AS (SELECT id FROM all_ WHERE {_ACTIVE} AND level = 0 AND domain <> '' AND {_DECAYS}), mem AS (SELECT all_.* REPLACE (CAST(coalesce(decay_count, 0) + CASE WHEN due.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS decay_count,"
    " CASE WHEN due.id IS NOT NULL AND coalesce(decay_count, 0) + 1 >= 3 THEN 'archived' ELSE status END AS status) FROM all_ LEFT JOIN due ON due.id = all_.id), " + _LINED + ", " + _LINKED + " " + _MERGED,
)
def dream_prune(spark: SparkSession, sf: str) -> DataFrame:
    rows = mem(spark, sf, "content", "domain", "level", "status", "ts", "hit_count", "decay_count", "last_hit_at", "created_at")
    return C.pruned(rows, NOW).select("id", "decay_count", "hit_count", "status")


def _due_sql(low: int, high: int, least: int, ratio: int, take: int) -> str:
    return (
        f"{_WITH}, n AS (SELECT domain, count(*) FILTER (level = {low}) AS lows, count(*) FILTER (level = {high}) AS highs FROM mem WHERE {_ACTIVE} AND domain <> '' GROUP BY 1)"
        f" SELECT r.domain, id, CAST(rn AS INTEGER) AS rn, lows, highs FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id) AS rn FROM mem WHERE {_ACTIVE} AND level = {low} AND domain <> '') r JOIN n ON n.domain = r.domain"
        f" WHERE rn <= {take} AND lows >= {least} AND (highs = 0 OR lows > {ratio} * highs)"
    )


@query("aggregate_fact_candidates", _due_sql(0, 1, 10, 10, 20))
def aggregate_fact_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return E.fact_candidates(mem(spark, sf, "domain", "level", "status", "ts"))


@query("aggregate_pattern_candidates", _due_sql(1, 2, 3, 3, 10))
def aggregate_pattern_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return E.pattern_candidates(mem(spark, sf, "domain", "level", "status", "ts"))


def _applied_sql(low: int) -> str:
    due = _due_sql(0, 1, 10, 10, 20) if low == 0 else _due_sql(1, 2, 3, 3, 10)
    return (
        f"{_WITH}, due AS ({due.removeprefix(_WITH + ', n AS').replace('(SELECT domain, count', 'WITH n AS (SELECT domain, count', 1)}), got AS (SELECT mem.*, due.rn FROM mem JOIN due ON due.id = mem.id),"
        " txt AS (SELECT domain, string_agg(content, '; ' ORDER BY rn) AS t FROM got GROUP BY 1), new AS (SELECT domain, t, (SELECT max(id) FROM mem) + row_number() OVER (ORDER BY domain) AS nid FROM txt WHERE trim(t) <> '')"
        f" SELECT nid AS id, domain, {low + 1} AS level, CAST(NULL AS BIGINT) AS parent_id, md5(t) AS text FROM new"
        " UNION ALL SELECT got.id, got.domain, got.level, new.nid, md5(content) FROM got JOIN new ON new.domain = got.domain WHERE parent_id IS NULL OR parent_id IN (0, -1)"
    )


def _applied(spark: SparkSession, sf: str, low: int) -> DataFrame:
    rows = mem(spark, sf)
    due = E.fact_candidates(rows) if low == 0 else E.pattern_candidates(rows)
    return C.aggregated(rows, due, low + 1, NOW).select("id", "domain", "level", "parent_id", F.md5("content").alias("text"))


@query("aggregate_facts", _applied_sql(0))
def aggregate_facts(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, 0)


@query("aggregate_patterns", _applied_sql(1))
def aggregate_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _applied(spark, sf, 1)


_POOL = (
    _WITH + ", h AS (SELECT DISTINCT habit_id, description FROM habits), p AS (SELECT 'habit' AS kind, habit_id AS id, '[habit] ' || description AS text FROM h"
    + "".join(f" UNION ALL (SELECT '{t}', id, '[{t}/' || coalesce(domain, '') || '] ' || content FROM mem WHERE {_ACTIVE} AND level = {n} ORDER BY hit_count DESC, ts DESC, id LIMIT 20)" for n, t in ((2, "principle"), (1, "pattern")))
    + ")"
)


@query("wander_pool", _POOL + " SELECT kind, id, text FROM p")
def wander_pool(spark: SparkSession, sf: str) -> DataFrame:
    return E.wander_pool(mem(spark, sf), ST.once(table(spark, sf, "habits"), "habit_id"))


@query("wander_sample", _POOL + " SELECT kind, id, text FROM p ORDER BY md5('1:' || kind || ':' || id), kind, id LIMIT 5")
def wander_sample(spark: SparkSession, sf: str) -> DataFrame:
    return E.wander_sample(wander_pool(spark, sf), seed=1)


@query("debate_prompt", _WITH + f", r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY ts DESC, id) AS rn FROM mem WHERE {_ACTIVE} AND domain <> '' QUALIFY rn <= 15) SELECT domain, CAST(count(*) AS INTEGER) AS n, 'What do these notes of one person have in common?' || chr(10) || 'Domain: ' || domain || chr(10) || string_agg('- ' || coalesce(content, ''), chr(10) ORDER BY rn) AS prompt FROM r GROUP BY domain")
def debate_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return E.prompts(mem(spark, sf, "content", "domain", "status", "ts"))


@query("parse_insights")
def parse_insights(spark: SparkSession, sf: str) -> DataFrame:
    """Answers built from the habits: one insight with its confidence each."""
    answers = table(spark, sf, "habits").select("habit_id", F.concat(F.lit("INSIGHT: "), F.regexp_replace("description", "\n", " "), F.lit("\nCONFIDENCE: "), F.col("confidence").cast("string")).alias("answer"))
    return E.parsed_insights(answers, ["habit_id"], "answer").withColumn("confidence", F.round("confidence", 6))


ORACLE["parse_insights"] = "SELECT habit_id, 0 AS pos, trim(replace(description, chr(10), ' ')) AS description, round(coalesce(confidence, 0.5), 6) AS confidence FROM habits WHERE description IS NOT NULL AND confidence IS NOT NULL"


@query("training_examples")
def training_examples(spark: SparkSession, sf: str) -> DataFrame:
    store = mem(spark, sf)
    return E.training_examples(store).unionByName(E.habit_examples(store, table(spark, sf, "habits")))


def _safe_sql(col: str) -> str:
    return f"CASE WHEN {_pii_sql(col)} THEN '' ELSE {_clean_sql(col)} END"


def _training_sql() -> str:
    """The examples' texts: habits first by id, notes newest first, texts with personal information left out."""
    ask = E._ASK_HABITS["en"]

    def joined(rows: str, order: str, k: int, sep: str, lead: str = "") -> str:
        return f"(SELECT string_agg('{lead}' || t, {sep} ORDER BY {order}) FROM (SELECT * FROM {rows} WHERE t <> '' ORDER BY {order} LIMIT {k}))"

    about = f"'You know this person from earlier conversations.' || chr(10) || 'Habits: ' || {joined('h', 'habit_id', 5, chr(39) + '；' + chr(39))} || chr(10) || 'Active domains: ' || (SELECT string_agg(domain, ', ' ORDER BY domain) FROM dm)"
    listed = {
        "habit_summary": joined("h", "habit_id", 10, "'；'"),
        "preferences": joined("liked", "habit_id", 5, "'；'"),
        "habits_list": joined("h", "habit_id", 10, "chr(10)", "- "),
        "pattern_summary": joined("(SELECT * FROM note WHERE level = 1)", "ts DESC, id", 5, "chr(10)", "- "),
    }
    singles = " UNION ALL ".join(f"SELECT '{k}' AS kind, CAST(0 AS BIGINT) AS id, '{ask[k][0]}' AS question, replace('{ask[k][1]}', '{{}}', {a}) AS answer" for k, a in listed.items())
    liked = " OR ".join(f"contains(description, '{w}')" for w in E.PREFERENCE_WORDS)
    levels = " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{tag}' AS kind, id, 'You know this person from earlier conversations.' AS system, replace('{q}', '{{}}', coalesce(domain, '')) AS question, t AS answer FROM (SELECT * FROM note WHERE level = {n} ORDER BY hit_count DESC, ts DESC, id LIMIT {k}) WHERE t <> '')"
        for n, tag, k, q in ((2, "principle", 10, "Which rule shows in what you know about {}?"), (1, "pattern", 20, "What stands out about {}?"))
    )
    return (
        f"{_WITH}, h AS (SELECT *, {_safe_sql('description')} AS t FROM habits), liked AS (SELECT * FROM h WHERE {liked}), note AS (SELECT *, {_safe_sql('content')} AS t FROM mem WHERE {_ACTIVE} AND content IS NOT NULL),"
        " dm AS (SELECT domain, count(*) AS c FROM mem WHERE domain <> '' GROUP BY 1), top AS (SELECT domain, row_number() OVER (ORDER BY c DESC, domain) AS id FROM dm QUALIFY id <= 3),"
        " near AS (SELECT domain, level, t, ts, id, row_number() OVER (PARTITION BY domain, level ORDER BY ts DESC, id) AS rn FROM note WHERE t <> '' AND level IN (0, 1) AND domain IN (SELECT domain FROM top) QUALIFY rn <= 3),"
        " ins AS (SELECT domain, arg_max(a, level) AS a FROM (SELECT domain, level, string_agg(t, '；' ORDER BY rn) AS a FROM near GROUP BY 1, 2) GROUP BY 1),"
        f" q AS ({singles} UNION ALL SELECT 'domain', top.id, replace('{ask['domain'][0]}', '{{}}', top.domain), ins.a FROM top JOIN ins ON ins.domain = top.domain)"
        f" SELECT kind, id, {about} AS system, question, answer FROM q WHERE answer IS NOT NULL UNION ALL {levels}"
    )


@query("training_texts", _training_sql())
def training_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The three texts of every training example."""
    rows = training_examples(spark, sf)
    return rows.select("kind", "id", *[F.col("messages")[k]["content"].alias(name) for k, name in enumerate(("system", "question", "answer"))])


@query("training_valid", f"WITH x AS ({_training_sql()}) SELECT kind, id FROM (SELECT kind, id, row_number() OVER (ORDER BY kind, id) AS rn FROM x) WHERE rn <= (SELECT greatest(4, count(*) // 5) FROM x)")
def training_valid(spark: SparkSession, sf: str) -> DataFrame:
    """The validation lines of a tuner."""
    return E.first_as_valid(training_examples(spark, sf), ["kind", "id"]).select("kind", "id")


@query("engine_stats", _WITH + f", {_TRI} SELECT (SELECT count(*) FROM mem WHERE {_ACTIVE}) AS memories, (SELECT count(*) FROM tri WHERE valid_until IS NULL) AS triples, (SELECT count(DISTINCT habit_id) FROM habits) AS habits, (SELECT count(DISTINCT vote_id) FROM votes) AS votes")
def engine_stats(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        ("memories", ST.active(mem(spark, sf, "status"))),
        ("triples", TR.current(tris(spark, sf))),
        ("habits", table(spark, sf, "habits").select("habit_id").distinct()),
        ("votes", table(spark, sf, "votes").select("vote_id").distinct()),
    ]
    rows = None
    for name, df in parts:
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy().agg(*[F.max(F.when(F.col("name") == n, F.col("n"))).alias(n) for n, _ in parts])


@query("preferences", "SELECT habit_id FROM habits WHERE " + " OR ".join(f"contains(description, '{w}')" for w in E.PREFERENCE_WORDS))
def preferences(spark: SparkSession, sf: str) -> DataFrame:
    return E.preferences(table(spark, sf, "habits")).select("habit_id")


def _topic_sql(col: str) -> str:
    clean = f"replace(replace(lower({col}), '.md', ''), '-', ' ')"
    return "CASE " + " ".join(f"WHEN contains({clean}, '{a}') THEN '{b}'" for a, b in R.TOPIC_DOMAINS) + " ELSE 'general' END"


@query("infer_domain", f"SELECT doc_id, {_topic_sql('source')} AS domain FROM documents WHERE source IS NOT NULL")
def infer_domain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("source IS NOT NULL").select("doc_id", R.topic_domain(F.col("source")).alias("domain"))


@query("text_embedding")
def text_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "habits").select("habit_id", "description")
    return rows.select("habit_id", embed(F.col("description")).alias("embedding"))


# --- hypervectors -----------------------------------------------------------


_TWO64 = "CAST(18446744073709551616 AS HUGEINT)"
_TOP = "CAST(9223372036854775808 AS HUGEINT)"


def _hv_sql(concept: str) -> str:
    """A concept's 16 numbers, unsigned."""
    return f"list_transform(generate_series(0, 15), lambda w: CAST(CAST('0x' || substr(sha256({concept} || ':' || CAST(w // 4 AS VARCHAR)), 16 * (w % 4) + 1, 16) AS UBIGINT) AS HUGEINT))"


def _signed_sql(x: str) -> str:
    return f"CAST(CASE WHEN {x} >= {_TOP} THEN {x} - {_TWO64} ELSE {x} END AS BIGINT)"


_HABIT = "h AS (SELECT DISTINCT habit_id, description FROM habits WHERE description <> '')"
_FIRST_WORD = r"(regexp_split_to_array(trim(description), '\s+'))[1]"
_HABIT_HV = f"hv AS (SELECT habit_id, list_transform(list_zip({_hv_sql(_FIRST_WORD)}, {_hv_sql('description')}), lambda z: xor(CAST(z[1] AS UHUGEINT), CAST(z[2] AS UHUGEINT))) AS v FROM h)"


def _majority_sql(rows: str, by: str) -> str:
    """(by, v) of rows (by, v): the sign of the sums of each place, as 16 numbers."""
    group = f"{by}, " if by else ""
    return (
        f"(SELECT {group}list(n ORDER BY w) AS v FROM (SELECT {group}w, sum(CASE WHEN s < 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END) AS n FROM"
        f" (SELECT {group}w, i, sum(CASE WHEN (CAST(v[w] AS HUGEINT) >> i) & 1 = 1 THEN -1 ELSE 1 END) AS s FROM {rows}, generate_series(1, 16) a(w), generate_series(0, 63) b(i) GROUP BY {group}w, i) GROUP BY {group}w)" + (f" GROUP BY {by})" if by else ")")
    )


def _near_sql(a: str, b: str) -> str:
    return f"round(1 - 2 * list_sum(list_transform(list_zip({a}, {b}), lambda z: bit_count(CAST(CAST(xor(CAST(z[1] AS UHUGEINT), CAST(z[2] AS UHUGEINT)) AS HUGEINT) AS BIT)))) / 1024, 6)"


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return H.encoded(ST.once(table(spark, sf, "habits").where("description <> ''"), "habit_id").select("habit_id", "description"))


@query("hv_encode", f"SELECT concept, CASE WHEN concept IS NOT NULL THEN list_transform({_hv_sql('concept')}, lambda x: {_signed_sql('x')}) END AS hv FROM (SELECT DISTINCT domain AS concept FROM memories)")
def hv_encode(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "memories").select(F.col("domain").alias("concept")).distinct()
    return words.select("concept", V.encode(F.col("concept")).alias("hv"))


@query("habit_encode", f"WITH {_HABIT}, {_HABIT_HV} SELECT habit_id, list_transform(v, lambda y: {_signed_sql('CAST(y AS HUGEINT)')}) AS hv FROM hv")
def habit_encode(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("habit_id", "hv")


_SMALL = "e AS (SELECT vec_id, embedding AS v FROM embeddings)"


@query("hv_bind", f"WITH {_SMALL} SELECT a.vec_id, list_transform(generate_series(1, 64), lambda i: CASE WHEN a.v[i] < 0 THEN -1 ELSE 1 END * CASE WHEN b.v[i] < 0 THEN -1 ELSE 1 END) AS bound FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def hv_bind(spark: SparkSession, sf: str) -> DataFrame:
    """Signs of neighbouring embeddings, bound as packed vectors and unpacked."""
    rows = _packed(spark, sf)
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hv").alias("other")), "vec_id")
    return pairs.select("vec_id", V.signs(V.bind(F.col("hv"), F.col("other"))).alias("bound"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.get(F.col("embedding"), i) < 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return table(spark, sf, "embeddings").select("vec_id", "label", F.array(bits).alias("hv"))


@query("hv_similarity", f"WITH {_SMALL} SELECT a.vec_id, round(list_sum(list_transform(generate_series(1, 64), lambda i: CASE WHEN (a.v[i] < 0) = (b.v[i] < 0) THEN 1 ELSE -1 END)) / 64.0, 6) AS similarity FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def hv_similarity(spark: SparkSession, sf: str) -> DataFrame:
    rows = _packed(spark, sf)
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hv").alias("other")), "vec_id")
    return pairs.select("vec_id", F.round(V.similarity(F.col("hv"), F.col("other")), 6).alias("similarity"))


@query("hv_bundle", "WITH s AS (SELECT label, i, sum(CASE WHEN embedding[i] < 0 THEN -1 ELSE 1 END) AS s FROM embeddings, generate_series(1, 64) g(i) GROUP BY ALL) SELECT label, list(CASE WHEN s < 0 THEN -1 ELSE 1 END ORDER BY i) AS bundled FROM s GROUP BY label")
def hv_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return H.bundle(_packed(spark, sf), ["label"], 64).select("label", V.signs(F.col("hv")).alias("bundled"))


@query("habit_bundle", f"WITH {_HABIT}, {_HABIT_HV} SELECT list_transform(v, lambda y: {_signed_sql('CAST(y AS HUGEINT)')}) AS hv FROM {_majority_sql('hv', '')}")
def habit_bundle(spark: SparkSession, sf: str) -> DataFrame:
    return H.bundle(_encoded(spark, sf), [])


def _bags_sql(asked: str) -> str:
    """Words of every habit, and of what is asked as habit 0, with their numbers."""
    words = _TOKENS.replace("content", "description")
    return f"hw AS (SELECT habit_id, unnest(list_distinct({words})) AS word FROM (SELECT * FROM h UNION ALL SELECT 0, '{asked}')), wv AS (SELECT habit_id, {_hv_sql('word')} AS v FROM hw), bag AS (SELECT * FROM {_majority_sql('wv', 'habit_id')})"


@query("habit_query", f"WITH {_HABIT}, {_bags_sql(f'habit {WORD} {PHRASE}')} SELECT a.habit_id, {_near_sql('a.v', 'q.v')} AS similarity FROM bag a, bag q WHERE q.habit_id = 0 AND a.habit_id <> 0 ORDER BY 2 DESC, 1 LIMIT 5")
def habit_query(spark: SparkSession, sf: str) -> DataFrame:
    """The habits nearest to a text, by their words."""
    rows = ST.once(table(spark, sf, "habits").where("description <> ''"), "habit_id")
    bags = H.bag_encoded(rows, "habit_id")
    asked = H.bag_encoded(spark.createDataFrame([(0, f"habit {WORD} {PHRASE}")], "habit_id bigint, description string"), "habit_id")
    return H.nearest(bags.crossJoin(F.broadcast(asked.select(F.col("hv").alias("q")))), F.col("q")).select("habit_id", "similarity")


@query("habit_query_pairs", f"WITH {_HABIT}, {_HABIT_HV} SELECT a.habit_id, {_near_sql('a.v', 'q.v')} AS similarity FROM hv a, hv q WHERE q.habit_id = 1 ORDER BY 2 DESC, 1 LIMIT 5")
def habit_query_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The habits nearest to a concept pair: the first habit's own."""
    rows = _encoded(spark, sf)
    first = rows.where("habit_id = 1").select(F.col("hv").alias("q"))
    return H.nearest(rows.crossJoin(F.broadcast(first)), F.col("q")).select("habit_id", "similarity")


_TEN_AND_HABITS = (
    _HYBRID + f", {_HABIT}, {_bags_sql(WORD)}, near AS (SELECT a.habit_id, {_near_sql('a.v', 'q.v')} AS s FROM bag a, bag q WHERE q.habit_id = 0 AND a.habit_id <> 0 ORDER BY 2 DESC, 1 LIMIT 3),"
    " best AS (SELECT 0 AS part, row_number() OVER (ORDER BY coalesce(level, 0) DESC, m.score DESC, src, pos) AS rk, id, domain, CASE coalesce(level, 0) WHEN 2 THEN 'principle' WHEN 1 THEN 'pattern' ELSE 'fact' END AS level, score FROM m WHERE coalesce(privacy, 'open') <> 'sealed' QUALIFY rk <= 7),"
    " hs AS (SELECT 1 AS part, row_number() OVER (ORDER BY s DESC, near.habit_id) AS rk, near.habit_id AS id, 'habits' AS domain, 'habit' AS level, confidence AS score FROM near JOIN (SELECT DISTINCT habit_id, confidence FROM habits) c ON c.habit_id = near.habit_id)"
    " SELECT id, domain, level, round(score, 6) AS score FROM (SELECT * FROM best UNION ALL SELECT * FROM hs) ORDER BY part, rk LIMIT 10"
)


@query("search_with_habits", _TEN_AND_HABITS)
def search_with_habits(spark: SparkSession, sf: str) -> DataFrame:
    """Memories and the habits nearest to the query, as one list."""
    habits = ST.once(table(spark, sf, "habits").where("description <> ''"), "habit_id")
    return H.beside(S.hybrid_search(index(spark, sf), WORD, limit=10), habits, WORD, memories=7)


# --- sources and streams ----------------------------------------------------

_LINES = (
    "raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),"
    f" ln AS (SELECT *, {_STRIP.format('raw')} AS line FROM raw),"
    f" sec AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(line, '##') THEN {_STRIP.format(chr(114) + 'egexp_replace(line, ' + chr(39) + '^#+' + chr(39) + ', ' + chr(39) * 2 + ')')} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), CAST(doc_id AS VARCHAR)) AS section FROM ln)"
)


@query("topic_lines", f"WITH {_LINES} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line AS content, '' AS source_project, section FROM sec WHERE line <> '' AND NOT starts_with(line, '#') AND length(line) > 5")
def topic_lines(spark: SparkSession, sf: str) -> DataFrame:
    return RD.topic_lines(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text")


@query("topic_tags", "SELECT doc_id, 0 AS line_no, 'kept under ' || coalesce(source, 'no source') AS content, kind AS source_project, CAST(doc_id AS VARCHAR) AS section FROM documents")
def topic_tags(spark: SparkSession, sf: str) -> DataFrame:
    """Tagged lines: the tag is split off."""
    said = F.concat(F.lit("[source:"), F.col("kind"), F.lit("] kept under "), F.coalesce("source", F.lit("no source")), F.lit("\n# heading\n\nabc"))
    return RD.topic_lines(table(spark, sf, "documents").select("doc_id", said.alias("text")), "doc_id", "text")


_HEAD = r"regexp_extract(t, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n', 1)"


@query("frontmatter_parse", "WITH d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL)" + r" SELECT doc_id, " + ", ".join(rf"trim(regexp_extract({_HEAD}, '(?m)^{k}:(.*)$', 1)) AS {k}" for k in ("id", "domain", "tags", "refs")) + r" FROM d WHERE regexp_matches(t, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n')")
def frontmatter_parse(spark: SparkSession, sf: str) -> DataFrame:
    return RD.front_matter(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text").select("doc_id", "id", "domain", "tags", "refs")


_AFTER_HEAD = r"regexp_extract(t, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n(.*)', 2)"
_BODY = (
    "d AS (SELECT doc_id, replace(text, chr(13) || chr(10), chr(10)) AS t FROM documents WHERE text IS NOT NULL),"
    rf" b AS (SELECT doc_id, trim(regexp_extract({_HEAD}, '(?m)^id:(.*)$', 1)) AS name, trim(regexp_extract({_HEAD}, '(?m)^domain:(.*)$', 1)) AS domain, {_STRIP.format(_AFTER_HEAD)} AS body FROM d WHERE regexp_matches(t, '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n')),"
    f" ln AS (SELECT doc_id, i, {_STRIP.format('raw')} AS x FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS raw, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM b)),"
    " st AS (SELECT *, last_value(CASE WHEN starts_with(x, 'fix:') THEN 1 WHEN starts_with(x, 'context:') OR starts_with(x, 'symptom:') OR x = '' THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS is_on FROM ln),"
    f" pt AS (SELECT doc_id, i, x, CASE WHEN starts_with(x, 'fix:') THEN nullif({_STRIP.format('substr(x, 5)')}, '') WHEN is_on = 1 AND starts_with(x, '- ') THEN substr(x, 3) END AS p FROM st),"
    f" fm AS (SELECT doc_id, coalesce(arg_max({_STRIP.format('substr(x, 9)')}, i) FILTER (starts_with(x, 'context:')), '') AS context, coalesce(arg_max({_STRIP.format('substr(x, 9)')}, i) FILTER (starts_with(x, 'symptom:')), '') AS symptom, coalesce(string_agg(p, '; ' ORDER BY i), '') AS fix FROM pt GROUP BY 1)"
)


@query("frontmatter_body", f"WITH {_BODY} SELECT * FROM fm")
def frontmatter_body(spark: SparkSession, sf: str) -> DataFrame:
    return RD.front_matter(table(spark, sf, "documents").where("text IS NOT NULL"), "doc_id", "text").select("doc_id", "context", "symptom", "fix")


@query(
    "import_documents",
    f"WITH {_MEM}, {_BODY}, c AS (SELECT b.doc_id, name, CASE WHEN b.domain = '' THEN 'community' ELSE lower({_STRIP.format('split_part(b.domain, chr(44), 1)')}) END AS domain,"
    " coalesce(nullif(concat_ws(' | ', CASE WHEN symptom <> '' THEN 'symptom: ' || symptom END, CASE WHEN fix <> '' THEN 'fix: ' || fix END, CASE WHEN context <> '' THEN 'context: ' || context END), ''), substr(body, 1, 200)) AS content FROM b JOIN fm ON fm.doc_id = b.doc_id),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY content, domain ORDER BY doc_id) AS rn FROM c)"
    f" SELECT doc_id, CASE WHEN rn = 1 AND NOT EXISTS (SELECT 1 FROM mem WHERE mem.{_ACTIVE} AND mem.content = r.content AND mem.domain = r.domain) THEN 'imported' ELSE 'skipped' END AS outcome, domain, md5(content) AS text FROM r"
    " UNION ALL SELECT doc_id, 'error', NULL, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM b)",
)
def import_documents(spark: SparkSession, sf: str) -> DataFrame:
    known = ST.active(raw(spark, sf, "content", "domain", "status"))
    rows = RD.import_documents(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text", known)
    return rows.select("doc_id", "outcome", "domain", F.md5("content").alias("text"))


@query(
    "import_counts",
    f"WITH {_LINES} SELECT 'topic' AS source, count(*) AS imported FROM sec WHERE line <> '' AND NOT starts_with(line, '#') AND length(line) > 5"
    r" UNION ALL SELECT 'document', count(*) FROM documents WHERE regexp_matches(replace(text, chr(13) || chr(10), chr(10)), '(?s)^---[ \t]*\n(.*?)\n---[ \t]*\n')",
)
def import_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").where("text IS NOT NULL")
    lines = RD.topic_lines(docs, "doc_id", "text").agg(F.count(F.lit(1)).alias("imported")).select(F.lit("topic").alias("source"), "imported")
    heads = RD.front_matter(docs, "doc_id", "text").agg(F.count(F.lit(1)).alias("imported")).select(F.lit("document").alias("source"), "imported")
    return lines.unionByName(heads)


@query("events_tumbling", "SELECT date_trunc('day', ts) AS w_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    rows = IN.tumbling(table(spark, sf, "events"))
    return rows.withColumn("w_start", F.col("w_start").cast("timestamp_ntz"))


@query("events_session", "WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, min(ts) AS w_start, max(ts) + INTERVAL 6 HOUR AS w_end, count(*) AS n FROM g GROUP BY user_id, g")
def events_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = IN.sessions(table(spark, sf, "events"))
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("w_start", "w_end")})
