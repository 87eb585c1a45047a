"""The engine's own operators on small cases."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from engramlake.engine import Memory
from engramlake.functions import rules as R
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.operators import gate as G
from engramlake.operators import habits as H
from engramlake.operators import refine as E
from engramlake.operators import search as S
from engramlake.operators import store as ST
from engramlake.operators import triples as TR
from engramlake.operators import votes as VO
from engramlake.sources import readers as RD
from engramlake.sources import sinks as SK

DAY = 86_400.0


def store(spark, rows):
    """(id, content, domain, ts, level, parent, status, privacy) rows."""
    full = [(*r, None, 0, 0.0, 0, float(r[3]), "{}") for r in rows]
    return spark.createDataFrame(full, ST.MEMORY_SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return store(
        spark,
        [
            (1, "Rules of running: rest between runs", "health", 1.0, 2, None, "active", "open"),
            (2, "Running on Monday, running on Friday", "health", 2.0, 1, 1, "active", "open"),
            (3, "Ran five kilometres by the river", "health", 3.0, 0, 2, "active", "guarded"),
            (4, "running shoes cost too much", "finance", 4.0, 0, None, "active", "sealed"),
            (5, "old note about running", "health", 5.0, 0, None, "archived", "open"),
            (6, "用户喜欢跑步", "health", 6.0, 0, 2, "active", "open"),
            (7, None, None, 7.0, None, None, "active", None),
            (8, "Café au lait, ÉTÉ 100%", "", 8.0, 0, None, "active", "open"),
        ],
    )


TEXTS = ["a rat and a cat", "cat cat dog", "the dog of the cat", "rat", "of the dog", "", "Élan vital cat-dog"]


@pytest.mark.parametrize("query", ["cat", "cat dog", "cat OR rat", "cat NOT rat", '"the dog"', 'rat OR "of the" NOT cat', "élan"])
def test_bm25_equals_an_fts5_index(spark, query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(content, tokenize='unicode61')")
    con.executemany("INSERT INTO f(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    want = {i: -s for i, s in con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (query,))}
    df = store(spark, [(i, t, "d", float(i), 0, None, "active", "open") for i, t in enumerate(TEXTS, 1)])
    got = {r.id: r.score for r in S.scored(df, query).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_query_parsing():
    assert X.sanitize_query("foo-bar baz!") == '"foo bar" baz'
    assert X.parse_query("NOT") == X.Node("phrase", ("not",))
    assert X.parse_query("cat AND") == X.Node("and", kids=(X.Node("phrase", ("cat",)), X.Node("phrase", ("and",))))
    assert X.parse_query("  ") is None and X.parse_query('""') is None


def test_search_like_folds_ascii_only(small):
    assert [r.id for r in S.search_like(small, "café AU").collect()] == [8]
    assert [r.id for r in S.search_like(small, "été").collect()] == []
    assert [r.id for r in S.search_like(small, "100%").collect()] == [8]
    assert [r.id for r in S.search_like(small, "跑步").collect()] == [6]


def test_hybrid_levels_privacy_and_domain(small):
    assert [r.id for r in S.hybrid_search(small, "running").collect()] == [1, 2]
    assert [r.id for r in S.hybrid_search(small, "running", domain="finance").collect()] == [4]
    assert [r.id for r in S.hybrid_search(small, "river", context_domain="finance").collect()] == []
    assert S.hybrid_search(small, "nonsense").collect() == []


def test_pyramid_drills_down(small):
    got = [(r.id, r.method) for r in S.pyramid_search(small, "rules").collect()]
    assert got[:2] == [(1, "fts"), (2, "drill")]


def test_store_writes(spark, small):
    fresh = spark.createDataFrame([("new", "x", 9.0), ("new", "x", 8.0), ("Ran five kilometres by the river", "health", 1.0), ("old note about running", "health", 1.0)], "content string, domain string, ts double")
    got = [(r.id, r.content, r.ts) for r in ST.add_new(small, fresh).orderBy("id").collect()]
    assert got == [(9, "old note about running", 1.0), (10, "new", 8.0)]
    assert {r.id for r in ST.deleted(small, spark.createDataFrame([(1,), (1,), (99,)], "id bigint")).collect()} == set(range(2, 9))
    up = ST.updated(small, spark.createDataFrame([(2, "archived", None)], "id bigint, status string, content string"))
    assert {r.id: (r.status, r.content) for r in up.collect()}[2] == ("archived", "Running on Monday, running on Friday")
    hits = ST.hit_rollup(small, spark.createDataFrame([(1, 5.0), (1, 9.0)], "id bigint, ts double"))
    assert {r.id: (r.hit_count, r.last_hit_at) for r in hits.collect()}[1] == (2, 9.0)
    assert ST.counts(small).first().asDict() == {"total_active": 7, "facts": 4, "patterns": 1, "principles": 1, "archived": 1}


def test_decay(spark, small):
    once = ST.decayed(small, now=40 * DAY)
    assert {r.id for r in once.where("decay_count = 1").collect()} == {3, 4, 6}
    thrice = ST.decayed(ST.decayed(once, 40 * DAY), 40 * DAY)
    assert {r.id for r in thrice.where("status = 'archived'").collect()} == {3, 4, 5, 6}


def test_gate_and_profile(spark):
    msgs = spark.createDataFrame(
        [("user", " My name is Ada ", 1.0), ("user", "My name is Ada", 2.0), ("assistant", "I like tea", 3.0), ("user", "hello", 4.0), ("user", "我喜欢跑步和音乐", 5.0), ("user", None, 6.0), ("user", "我今年30岁", 7.0), ("user", "我喜欢跑步", 8.0)],
        "role string, content string, ts double",
    )
    got = {r.content: (r.category, r.domain, r.privacy, r.ts) for r in G.gate(msgs).collect()}
    assert got["My name is Ada"] == ("identity", "", "open", 1.0)
    assert got["我喜欢跑步和音乐"] == ("preference", "health", "guarded", 5.0)
    assert len(got) == 3
    facts = G.profile_facts(msgs, [])
    assert {(r.key, r.value) for r in G.profile_latest(facts, []).collect()} == {("age", "30")}
    assert [r.value for r in G.profile_how(facts, []).collect()] == ["跑步和音乐"]
    assert {(r.relation, r.object) for r in TR.from_text(msgs, "content", []).collect()} == {("likes", "跑步和音乐"), ("likes", "跑步")}


def test_sharing_rules(spark):
    df = spark.createDataFrame([("call 13800001111",), ("mail a.b@c.org",), ("see ~/x and [source:Y] end",), ("key sk-abcdefghijklmnopqrstu",), ("clean",)], "t string")
    kinds = [[h.kind for h in r.h] for r in df.select(R.pii_hits(F.col("t")).alias("h")).collect()]
    assert kinds == [["phone_cn"], ["email"], [], ["api_key"], []]
    assert [r.s for r in df.select(R.training_scrub(F.col("t")).alias("s")).collect()] == ["", "", "see  and  end", "", "clean"]


def test_triples_close_and_hold(spark):
    rows = [(1, "u", "works_at", "A", 1000.0, None, 1000.0), (2, "u", "works_at", "B", 2000.0, None, 2000.0), (3, "u", "likes", "tea", 1.0, None, 1.0), (4, None, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, subject string, relation string, object string, valid_from double, valid_until double, created_at double")
    done = TR.closed(df)
    assert {r.id: r.valid_until for r in done.collect()} == {1: 2000.0, 2: None, 3: None, 4: None}
    assert {r.object for r in TR.as_of(done, 1500.0).collect()} == {"A", "tea"}
    events = spark.createDataFrame([("u", 1500.0), ("u", 2500.0), ("v", 1.0)], "subject string, at double")
    got = TR.asof_join(events, done.where("relation = 'works_at'"), slice_s=100.0)
    assert {(r.at, r.object) for r in got.collect()} == {(1500.0, "A"), (2500.0, "B")}


def test_vote_decay(spark):
    df = spark.sql("SELECT 'e' AS entry_id, vote, vote IS NULL AS is_usage, timestamp_seconds(0) + make_interval(0,0,0,1) AS ts FROM VALUES (1), (1), (-1), (NULL) v(vote)")
    got = VO.scores(df, now=126 * DAY).first()
    assert (got.positive, got.negative, got.usage_count, got.raw_score) == (2, 1, 1, 0.0)
    one = VO.scores(df.where("vote = 1"), now=126 * DAY).first()
    assert abs(one.final_score - 1.0) < 1e-9


def test_hypervector_laws(spark):
    df = spark.createDataFrame([("a", "b", "c")], "a string, b string, c string")
    a, b, c = (V.encode(F.col(x), 2048) for x in "abc")
    r = df.select(V.similarity(a, b).alias("apart"), V.similarity(V.bind(V.bind(a, b), b), a).alias("same"), V.similarity(a, a).alias("one")).first()
    assert abs(r.apart) < 0.1 and r.same == 1.0 and r.one == 1.0
    three = df.select(F.explode(F.array(a, b, c)).alias("hv")).withColumn("g", F.lit(1))
    bundled = H.bundle(three, ["g"], 2048)
    sims = bundled.crossJoin(df).select(V.similarity(F.col("hv"), a).alias("s")).first().s
    assert sims > 0.3


def test_model_answers():
    text = "INSIGHT: likes nonetheless tea\nCONFIDENCE: 0.85\nINSIGHT: bare\nCONFIDENCE: high\nINSIGHT:\nnoise"
    assert E.insights_of(text) == [("likes nonetheless tea", 0.85), ("bare", 0.5)]
    assert E.insights_of("NONE") == [] and E.insights_of(None) == []
    assert E.actions_of("KEEP: 4 ARCHIVE: 7 stale\nDECAY: x\nMERGE: 1+2") == [("keep", 4, "4"), ("archive", 7, "7 stale"), ("merge", 1, "1+2")]
    assert len(E.digest({"name": "x" * 900}, {}, {}, 0, [], 100)) <= 200


def test_sql_functions_and_embeddings(spark):
    import numpy as np

    from engramlake.functions.embedding import embed
    from engramlake.functions.register import register

    register(spark)
    rows = spark.sql("SELECT a.k, p.* FROM (SELECT 1 AS k, 'INSIGHT: x\\nCONFIDENCE: 2' AS t) a, LATERAL parse_insights(a.t) p").collect()
    assert [tuple(r) for r in rows] == [(1, "x", 1.0)]
    assert [r.type for r in spark.sql("SELECT * FROM parse_actions('DECAY: 3 a')").collect()] == ["decay"]
    df = spark.createDataFrame([("tea and cake",), ("cake and tea",), ("",), (None,)], "t string")
    a, b, empty, none = [r.v for r in df.select(embed(F.col("t")).alias("v")).collect()]
    assert a == b and abs(np.dot(a, b) - 1) < 1e-5 and empty is None and none is None
    own = [r.v for r in df.select(embed(F.col("t"), lambda ts: [np.ones(2)] * len(ts)).alias("v")).collect()]
    assert own == [[1.0, 1.0], [1.0, 1.0], [1.0, 1.0], None]


def test_readers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"role": "user", "content": "hi"}\n\n{"role": "assistant", "content": "yo"}\n')
    assert RD.read_messages(spark, str(tmp_path / "m.jsonl")).count() == 2
    (tmp_path / "t.jsonl").write_text('{"type": "human"}\nbroken{\n{"role": "user"}\n{"role": "assistant"}\n')
    assert RD.human_messages(RD.read_transcript(spark, str(tmp_path / "t.jsonl"))).first().n_human == 2
    text = "first line here\n# title\n## Swift\n[source:App-1] tagged content\n\nabc\n## Rust ##\nlast one here"
    df = spark.createDataFrame([("f", text), ("g", None)], "file string, text string")
    assert [tuple(r) for r in RD.topic_lines(df, "file", "text").orderBy("line_no").collect()] == [
        ("f", 0, "first line here", "", "f"), ("f", 3, "tagged content", "App-1", "Swift"), ("f", 7, "last one here", "", "Rust ##")
    ]
    doc = "---\nid: sw-1\ndomain: iOS\n---\ncontext: c: d\nfix: one\n- two\n\n- three\nsymptom: s\n"
    got = RD.front_matter(spark.createDataFrame([(1, doc), (2, "no header"), (3, None)], "k int, text string"), "k", "text").collect()
    assert [(r.k, r.id, r.domain, r.tags, r.context, r.symptom, r.fix) for r in got] == [(1, "sw-1", "iOS", "", "c: d", "s", "one; two")]
    (tmp_path / "sw-a.md").write_text(doc)
    assert [r.file for r in RD.read_texts(spark, str(tmp_path), "sw-*.md").collect()] == ["sw-a.md"]
    (tmp_path / "p.json").write_text('{"projects": {"x": {"a": 1}, "y": {}}}')
    assert {r.name for r in RD.read_projects(spark, str(tmp_path / "p.json")).collect()} == {"x", "y"}


def test_sinks(spark, small, tmp_path):
    out = SK.write_snapshot(small, str(tmp_path / "s"), 3)
    assert spark.read.parquet(out).count() == 8
    log = spark.sql("SELECT 'e' AS entry_id, 1 AS vote, timestamp'2024-03-05' AS ts")
    SK.append_votes(log, str(tmp_path / "v"))
    SK.append_votes(log, str(tmp_path / "v"))
    assert [(r.month, r["count"]) for r in spark.read.json(str(tmp_path / "v")).groupBy("month").count().collect()] == [("2024-03", 2)]
    assert SK.digest_file("x" * 4000).startswith("x" * 3450) and len(SK.digest_file("x" * 10)) == 10
    ex = E.train_valid(E.training_examples(small))
    assert {r.split for r in ex.collect()} <= {"train", "valid"} and [m.role for m in ex.first().messages] == ["system", "user", "assistant"]


def test_stream_equals_batch(spark, tmp_path):
    from engramlake.streaming.ingest import stored, stream_ingest

    src = tmp_path / "in"
    src.mkdir()
    schema = "role string, content string, ts double"
    for k in range(3):
        (src / f"{k}.json").write_text("\n".join(f'{{"role": "user", "content": "I like tea number {i}", "ts": {k}.0}}' for i in range(k, k + 4)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
    stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = sorted(r.content for r in stored(spark, str(tmp_path / "out/memories")).collect())
    want = sorted(r.content for r in G.gate(spark.read.schema(schema).json(str(src))).collect())
    assert got == want


def test_facade(spark):
    answers = lambda prompt, system: "INSIGHT: drinks tea\nCONFIDENCE: 0.9"
    m = Memory(spark, model=answers)
    n = m.add([{"role": "user", "content": "I like green tea at work"}, {"role": "assistant", "content": "ok"}, {"role": "user", "content": "我叫小明"}])
    assert n == 2 and m.add([{"role": "user", "content": "I like green tea at work"}]) == 0
    assert [r.id for r in m.search("tea").collect()] == [2] or m.search("tea").count() == 1
    assert "小明" in m.digest() and m.stats()["total_active"] == 2
    assert m.refine() == [("drinks tea", 0.9)] and m.habits.count() == 1
    assert "drinks tea" in m.prefetch("tea") and "green tea" in m.prefetch("tea")
    assert m.apply("ARCHIVE: 1 old") and m.stats()["archived"] == 1
    assert m.search_pyramid("tea").count() in (0, 1)


def test_a_profile_keeps_every_preference(spark):
    rows = [("how", "likes", f"thing {k:03d}", k) for k in range(120)] + [("how", "likes", "thing 00", 500)]
    facts = spark.createDataFrame(rows, "facet string, key string, value string, ts bigint")
    assert [r.value for r in G.profile_how(facts, []).collect()] == ["; ".join(f"thing {k:03d}" for k in range(120))]


def test_habit_examples(spark, small):
    habits = spark.createDataFrame([(1, "I like long walks"), (2, "reads at night")], "habit_id bigint, description string")
    got = {(r.kind, r.id): [m.content for m in r.messages] for r in E.habit_examples(small, habits).collect()}
    assert got["habit_summary", 0][2] == "Based on our interactions, I like long walks；reads at night"
    assert got["preferences", 0][2] == "I like long walks" and got["habits_list", 0][2] == "- I like long walks\n- reads at night"
    assert {k for k, _ in got} >= {"pattern_summary", "domain"} and "reads at night" in got["domain", 1][0]


def test_index_equals_a_scan(spark):
    df = store(spark, [(i, t, "d", float(i), 0, None, "active" if i != 3 else "archived", "open") for i, t in enumerate([*TEXTS, None], 1)])
    index = S.build_index(df.unionByName(df.limit(2)))
    for query in ("cat", "cat dog", "cat OR rat", "cat NOT rat", '"the dog"', '"of the" NOT cat', "nonsense", ""):
        want = {r.id: round(r.score, 9) for r in S.scored(df, query).collect()}
        assert {r.id: round(r.score, 9) for r in S.scored(index, query).collect()} == want
    assert [r.id for r in S.search_like(index, "CAT", 3).collect()] == [7, 2, 1] and S.hybrid_search(index, "cat").count() == 3
    assert S.scored(S.build_index(df.limit(0)), "cat").collect() == []


def test_filters_reach_the_scan(spark, tmp_path):
    from engramlake.plans import registry

    def scans(df):
        text = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return [line for line in text.split("\n") if "PushedFilters" in line]

    queries = registry.queries()
    for name, column in (("memory_get", "id"), ("list_by_domain", "domain"), ("search_like", "status"), ("query_entity", "subject")):
        assert any(column in line for line in scans(queries[name](spark, "/root/testdata/sf0.001"))), name


def test_redundant_facts_are_merged(spark):
    from engramlake.operators import consolidate as C

    rows = [(1, "a b c d e", "x", 3.0, 0, None, "active", "open"), (2, "a b c d f", "x", 2.0, 0, None, "active", "open"), (3, "q r s", "x", 1.0, 0, None, "active", "open"), (4, None, "x", 0.0, 0, None, "active", "open")]
    df = store(spark, rows).withColumn("hit_count", F.when(F.col("id") == 2, 7).otherwise(F.col("hit_count")))
    got = {r.id: (r.status, r.hit_count, r.content) for r in C.without_redundancy(df).collect()}
    assert got[1] == ("active", 7, "a b c d e") and got[2][0] == "archived" and got[3][0] == "active" and len(got) == 4
    merged = {r.id: r.content for r in C.without_redundancy(df, " + ".join).collect()}
    assert merged[1] == "a b c d e + a b c d f"
    same = C.without_redundancy(df, lambda texts: " ")
    assert {r.status for r in same.collect()} == {"active"}
    assert C.without_redundancy(df.limit(0)).collect() == []
    assert {r.id for r in C.pruned(df, now=-1.0).where("status = 'archived'").collect()} == {2}


def test_summaries_stand_above_their_facts(spark):
    from engramlake.operators import consolidate as C

    df = store(spark, [(k, f"fact {k}", "x", float(k), 0, [None, 0, 99][k % 3], "active", "open") for k in range(1, 13)])
    due = E.fact_candidates(df)
    changes = {r.id: r for r in C.aggregated(df, due, 1, 50.0).collect()}
    assert changes[13].level == 1 and changes[13].content == "; ".join(f"fact {k}" for k in range(12, 0, -1)) and changes[13].parent_id is None
    assert {k: r.parent_id for k, r in changes.items() if k != 13} == {k: 13 for k in range(1, 13) if k % 3 != 2}
    assert C.with_changes(df, C.aggregated(df, due, 1, 50.0, lambda t: "sum")).count() == 13
    assert C.aggregated(df, due, 1, 50.0, lambda t: "").collect() == []


def test_snapshots_by_version(spark, small, tmp_path):
    path = str(tmp_path / "t")
    assert SK.versions(spark, path) == [] and SK.read_snapshot(spark, path, schema=small.schema).collect() == []
    with pytest.raises(FileNotFoundError):
        SK.read_snapshot(spark, path)
    assert SK.save_next(small.limit(3), path) == 1 and SK.save_next(small, path) == 2
    assert SK.read_snapshot(spark, path).count() == 8 and SK.read_snapshot(spark, path, 1).count() == 3 and SK.versions(spark, path) == [1, 2]


def test_imports_with_outcomes(spark, small):
    doc = "---\nid: sw-1\ndomain: iOS, x\n---\nfix: one\nsymptom: s\n"
    docs = spark.createDataFrame([(1, doc), (2, doc), (3, "no header"), (4, "---\nid: sw-2\n---\nRan five kilometres by the river"), (5, "---\nid: q\ndomain: health\n---\nRan five kilometres by the river")], "k int, text string")
    known = small.where("status = 'active'").select("content", "domain")
    got = {r.k: (r.outcome, r.content, r.domain) for r in RD.import_documents(docs, "k", "text", known).collect()}
    assert got == {1: ("imported", "symptom: s | fix: one", "ios"), 2: ("skipped", "symptom: s | fix: one", "ios"), 3: ("error", None, None), 4: ("imported", "Ran five kilometres by the river", "community"), 5: ("skipped", "Ran five kilometres by the river", "health")}
    uses = RD.import_uses(RD.import_documents(docs, "k", "text", known), F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(u.entry_id for u in uses) == ["sw-1", "sw-2"] and all(u.is_usage for u in uses)


def test_stream_keeps_facts_and_triples(spark, tmp_path):
    from engramlake.streaming.ingest import stored, stream_ingest, stream_votes

    (tmp_path / "in").mkdir()
    (tmp_path / "in/0.json").write_text('{"role": "user", "content": "我喜欢跑步", "ts": 1.0}\n{"role": "assistant", "content": "我喜欢茶", "ts": 2.0}')
    stream = spark.readStream.schema("role string, content string, ts double").json(str(tmp_path / "in"))
    seen = []
    stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "ck"), fold=lambda new, n: seen.append((n, new.count()))).awaitTermination()
    assert seen == [(0, 1)]
    assert [(r.relation, r.object) for r in stored(spark, str(tmp_path / "out/triples")).collect()] == [("likes", "跑步")]
    assert [r.value for r in stored(spark, str(tmp_path / "out/facts")).collect()] == ["跑步"]
    (tmp_path / "v").mkdir()
    (tmp_path / "v/0.json").write_text('{"entry_id": "e", "vote": 1, "ts": "2024-03-05T00:00:00"}')
    votes = spark.readStream.schema("entry_id string, vote int, ts timestamp").json(str(tmp_path / "v"))
    stream_votes(votes, str(tmp_path / "log"), str(tmp_path / "ck2")).awaitTermination()
    assert [(r.entry_id, r.month) for r in spark.read.json(str(tmp_path / "log")).collect()] == [("e", "2024-03")]


def test_updates_may_clear_a_value(spark, small):
    delta = spark.createDataFrame([(2, None)], "id bigint, content string")
    assert {r.id: r.content for r in ST.updated(small, delta, set_nulls=True).collect()}[2] is None
    assert {r.id: r.content for r in ST.updated(small, delta, set_nulls=True).collect()}[1] is not None


def test_more_model_actions(spark, small):
    assert E.actions_of("INSIGHT: drinks tea\nMERGE: 1+2 both run") == [("insight", None, "drinks tea"), ("merge", 1, "1+2 both run")]
    assert E.merge_ids("1+2 both run 3 times") == [1, 2] and E.merge_ids("[4], [5] and 6: x 7") == [4, 5, 6] and E.merge_ids("none") == []
    m = Memory(spark, store=small.withColumn("hit_count", F.col("id").cast("int")))
    m.apply("MERGE: 1 + 2\nINSIGHT: likes rivers")
    got = {r.id: (r.status, r.hit_count) for r in m.store.collect()}
    assert got[1] == ("active", 2) and got[2][0] == "archived" and [h.description for h in m.habits.collect()] == ["likes rivers"]
    assert m.dream(now=1e12)["archived"] >= 0


def test_habits_beside_memories(spark, small):
    habits = spark.createDataFrame([(1, "running every day", 0.9), (2, "tea", 0.2)], "habit_id bigint, description string, confidence double")
    rows = H.beside(S.hybrid_search(small, "running"), habits, "running", memories=1, k=1).collect()
    assert [(r.id, r.level) for r in rows] == [(1, "principle"), (1, "habit")] and rows[1].score == 0.9


def test_router_falls_back_and_counts():
    from engramlake.models import Router, first_model

    def broken(prompt, system):
        raise RuntimeError

    router = Router([("cloud", 2, lambda p, s: "far"), ("local", 0, broken), ("mute", 1, lambda p, s: " ")])
    assert router("hi", "x") == "far" and [m[0] for m in Router(router.models, tier=1).order()] == ["mute", "cloud", "local"]
    assert router.used["local"].failed == router.used["mute"].failed == 1 and router.totals().calls == 3 and router.totals().answered == 3
    assert Router([])("hi") == "" and first_model(None, broken) is broken and first_model(None) is None


def test_config(tmp_path):
    from engramlake.config import Config

    path = str(tmp_path / "c.json")
    assert Config.load(path).get("decay.days") == 30 and Config().get("no.such", 7) == 7
    Config().set("decay.days", 9).save(path)
    assert Config.load(path).get("decay.days") == 9 and Config.load(path).get("decay.strikes") == 3


def test_wandering_and_validation_lines(spark, small, tmp_path):
    m = Memory(spark, store=small, model=lambda prompt, system: "INSIGHT: all is running")
    m.habits = spark.createDataFrame([(1, "walks", "candidate", 0.5, [])], m.habits.schema)
    assert m.wander() == [("all is running", 0.4)] and m.habits.count() == 2
    assert Memory(spark, store=small).wander() == []
    df = spark.range(3).withColumnRenamed("id", "k")
    assert sorted(r.k for r in E.first_as_valid(df, ["k"], 7).collect()) == [0, 0, 0, 1, 1, 2, 2]
    assert [r.k for r in E.first_as_valid(spark.range(50).withColumnRenamed("id", "k"), ["k"]).collect()] == list(range(10))
    (tmp_path / "a.md").write_text("abc")
    assert tuple(RD.file_counts(spark, str(tmp_path)).first()) == (1, 3)


def test_debate_and_imports_of_the_facade(spark):
    heard = []

    def model(prompt, system):
        heard.append(system)
        return "INSIGHT: so it is" if "Sum up" in system else "a view"

    assert E.debated(model, "p") == [("so it is", 0.5)] and len(heard) == 4
    assert E.debated(lambda p, s: "", "p") == []
    m = Memory(spark)
    docs = spark.createDataFrame([("a", "---\nid: 1\n---\nbody text"), ("b", "---\nid: 2\n---\nbody text"), ("c", "none")], "file string, text string")
    assert m.take_in(docs) == {"imported": 1, "skipped": 1, "error": 1} and m.take_in(docs) == {"imported": 0, "skipped": 2, "error": 1}
    assert [(r.id, r.level, r.domain) for r in m.store.collect()] == [(1, 1, "community")]


def test_scalar_functions_in_sql(spark):
    from engramlake.functions.register import register

    register(spark)
    row = spark.sql("SELECT hv_similarity(array(1L), array(1L)) AS a, hv_similarity(array(0L), array(-1L)) AS b, word_overlap(array('x', 'y'), array('x')) AS c, word_overlap(array(), array('x')) AS d, score_at(8, 125) AS e").first()
    assert (row.a, row.b, row.c, row.d) == (1.0, -1.0, 1.0, 0.0) and abs(row.e - 4) < 1e-9
