"""The facade: add, search, digest, refine over a memory table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.models import Model
from engramlake.operators import consolidate as co
from engramlake.operators import gate as g
from engramlake.operators import habits as h
from engramlake.operators import refine as r
from engramlake.operators import search as s
from engramlake.operators import store as st
from engramlake.operators import triples as tr
from engramlake.session import cut, drop
from engramlake.sources import readers as sources



class Memory:
    """A store with its habits and triples. Every change gives new snapshots in place of the old ones.

    Without a model nothing that needs one is done.
    """

    def __init__(self, spark: SparkSession, store: DataFrame | None = None, habits: DataFrame | None = None, model: Model | None = None):
        self.spark, self.model = spark, model
        self.store = store if store is not None else spark.createDataFrame([], st.MEMORY_SCHEMA)
        self.habits = habits if habits is not None else spark.createDataFrame([], "habit_id bigint, description string, status string, confidence double, source_ids array<bigint>")
        self.triples = spark.createDataFrame([], "subject string, relation string, object string, valid_from double")
        self.facts = spark.createDataFrame([], "ts double, facet string, key string, value string")

    def add(self, messages: DataFrame | Sequence[dict]) -> int:
        """Take in messages (role, content, ts): memories, profile facts and triples. Returns the memories added."""
        if not isinstance(messages, DataFrame):
            rows = [(m["role"], m["content"], float(m.get("ts", k))) for k, m in enumerate(messages)]
            messages = self.spark.createDataFrame(rows, "role string, content string, ts double")
        fresh = g.gate(messages)
        new = st.add_new(self.store, fresh.select("content", "domain", "ts", "level", "privacy", F.to_json(F.create_map(F.lit("category"), "category", F.lit("source"), "source")).alias("metadata")))
        n = self._append(new)
        user = g.user_messages(messages)
        found = tr.from_text(user, "content", ["ts"]).withColumnRenamed("ts", "valid_from")
        self.triples = cut(self.triples.unionByName(found.select("subject", "relation", "object", "valid_from")))
        self.facts = cut(self.facts.unionByName(g.profile_facts(messages, [])))
        if self.model is not None:
            self.aggregate()
        return n

    def _append(self, new: DataFrame) -> int:
        """Add rows to the store, the columns they lack being those of new memories."""
        filled = {
            "status": F.lit(st.ACTIVE), "parent_id": F.lit(None).cast("bigint"), "embedding": F.lit(None).cast("array<float>"),
            "hit_count": F.lit(0), "last_hit_at": F.lit(0.0), "decay_count": F.lit(0), "created_at": F.col("ts"),
        }
        rows = cut(new.select(*[(filled[f.name] if f.name in filled else F.col(f.name)).cast(f.dataType).alias(f.name) for f in st.MEMORY_SCHEMA]))
        n = rows.count()
        # a snapshot of its own, so plans do not grow with every call; results of earlier searches may still read the one before
        self.store = cut(self.store.unionByName(rows))
        drop(rows)
        return n

    def aggregate(self) -> int:
        """Put a summary of the model above the facts, then the patterns, of every domain that is due. Returns the summaries."""
        made = 0
        for low, due in ((st.FACT, r.fact_candidates), (st.PATTERN, r.pattern_candidates)):
            rows = due(self.store)
            if rows.isEmpty():
                continue
            now = self.store.agg(F.coalesce(F.max("ts"), F.lit(0.0))).first()[0]
            changes = cut(co.aggregated(self.store, rows, low + 1, now, lambda texts: self.model("\n".join(texts), "Sum up in one sentence.")))
            made += changes.where(F.col("level") == low + 1).count()
            self.store = cut(co.with_changes(self.store, changes))
        return made

    def dream(self, now: float) -> dict[str, int]:
        """Prune what decayed and what is redundant. Returns how many memories were archived."""
        before = self.stats()["archived"]
        merge = None if self.model is None else lambda texts: self.model("\n".join(texts), "Merge into one sentence.")
        self.store = cut(co.pruned(self.store, now, merge))
        return {"archived": self.stats()["archived"] - before, "insights": len(self.wander())}

    def wander(self, seed: int = 1, size: int = 5) -> list[tuple[str, float]]:
        """Ask the model what a few habits, principles and patterns have to do with each other; its insights become habits."""
        if self.model is None:
            return []
        texts = [x.text for x in r.wander_sample(r.wander_pool(self.store, self.habits), seed, size).collect()]  # a handful
        if len(texts) < 3:
            return []
        found = r.insights_of(self.model("\n".join(f"{k}. {t}" for k, t in enumerate(texts, 1)), "Name what connects these, as INSIGHT: lines, or NONE."), 0.4)
        self._keep(found)
        return found

    def _keep(self, found: list[tuple[str, float]]) -> None:
        """New habits, with ids after the highest one."""
        if found:
            top = self.habits.agg(F.coalesce(F.max("habit_id"), F.lit(0))).first()[0]
            rows = [(top + k + 1, d, "candidate", c, []) for k, (d, c) in enumerate(found)]
            self.habits = self.habits.unionByName(self.spark.createDataFrame(rows, self.habits.schema), allowMissingColumns=True)

    def search(self, query: str, limit: int = 10, domain: str | None = None) -> DataFrame:
        """Memories for a query: content, domain, level, score, method."""
        return s.hybrid_search(self.store, query, limit, domain).select("id", "content", "domain", "level", "score", "method")

    def search_pyramid(self, query: str, limit: int = 10, domain: str | None = None) -> DataFrame:
        return s.pyramid_search(self.store, query, limit, domain).select("id", "content", "domain", "level", "score", "method", "stage")

    def prefetch(self, query: str, memories: int = 5, habits: int = 3) -> str:
        """Text for a prompt: the best memories and the habits nearest to the query."""
        lines = [f"- {x.content}" for x in self.search(query, memories).collect()]
        bags = h.bag_encoded(self.habits.where("description <> ''"), "habit_id")
        asked = h.bag_encoded(self.spark.createDataFrame([(0, query)], "habit_id bigint, description string"), "habit_id")
        near = h.nearest(bags.crossJoin(F.broadcast(asked.select(F.col("hv").alias("q")))), F.col("q"), habits, 0.1)
        return "\n".join(lines + [f"- {x.description}" for x in near.join(self.habits, "habit_id").orderBy(F.desc("similarity"), "habit_id").collect()])

    def learn(self, text: str, ts: float = 0.0) -> int:
        """Store a text as it is, unless an active memory has it."""
        return self.add([{"role": "user", "content": f"remember: {text}", "ts": ts}])

    def stats(self) -> dict[str, int]:
        return st.counts(self.store).first().asDict()

    def digest(self, token_budget: int = 250) -> str:
        """The text a prompt starts with."""
        latest = {(x.facet, x.key): x.value for x in g.profile_latest(self.facts, []).collect()}
        how = {x.key: x.value for x in g.profile_how(self.facts, []).collect()}
        domains = [x.domain for x in r.active_domains(self.store).collect()]
        pick = {f: {k: v for (facet, k), v in sorted(latest.items()) if facet == f} for f in ("who", "what")}
        return r.digest(pick["who"], dict(sorted(how.items())), pick["what"], self.stats()["total_active"], domains, token_budget)

    def refine(self, domain: str | None = None) -> list[tuple[str, float]]:
        """Debate each of the largest domains (or one) with the model and keep the insights as habits."""
        if self.model is None:
            return []
        asked = r.prompts(self.store)
        names = [domain] if domain else [x.domain for x in r.active_domains(self.store).collect()]
        found = []
        for row in asked.where(F.col("domain").isin(names)).orderBy("domain").collect():  # at most five prompts
            found += r.debated(self.model, row.prompt)
        self._keep(found)
        return found

    def take_in(self, texts: DataFrame, key: str = "file", text_col: str = "text") -> dict[str, int]:
        """Import documents with front matter as patterns. Returns how many were imported, skipped and in error."""
        known = self.store.where(F.col("status") == st.ACTIVE).select("content", "domain")
        rows = cut(sources.import_documents(texts, key, text_col, known))
        fresh = rows.where("outcome = 'imported'").select("content", "domain", F.lit(0.0).alias("ts"), F.lit(st.PATTERN).alias("level"), F.lit("open").alias("privacy"), F.to_json(F.create_map(F.lit("source"), F.lit("community"), F.lit("name"), "name")).alias("metadata"))
        self._append(st.add_new(self.store, fresh))
        n = {x.outcome: x["count"] for x in rows.groupBy("outcome").count().collect()}
        drop(rows)
        return {k: n.get(k, 0) for k in ("imported", "skipped", "error")}

    def apply(self, answer: str) -> list[tuple[str, int | None, str]]:
        """Carry out a model's MERGE, ARCHIVE, DECAY and INSIGHT lines."""
        actions = r.actions_of(answer)
        merges = [ids for kind, _, rest in actions if kind == "merge" and len(ids := r.merge_ids(rest)) > 1]
        if merges:
            pairs = self.spark.createDataFrame([(ids[0], other) for ids in merges for other in ids[1:]], "id bigint, other bigint")
            hits = pairs.join(self.store.select(F.col("id").alias("other"), "hit_count"), "other").groupBy("id").agg(F.max("hit_count").alias("_h"))
            self.store = self.store.join(hits, "id", "left").withColumn("hit_count", F.greatest("hit_count", "_h")).select(*self.store.columns)
        self._keep([(rest, 0.5) for kind, _, rest in actions if kind == "insight"])
        gone = [(i,) for kind, i, _ in actions if kind == "archive" and i is not None] + [(i,) for ids in merges for i in ids[1:]]
        if gone:
            delta = self.spark.createDataFrame(gone, "id bigint").distinct().withColumn("status", F.lit(st.ARCHIVED))
            self.store = st.updated(self.store, delta)
        worn = [(i,) for kind, i, _ in actions if kind == "decay" and i is not None]
        if worn:
            times = self.spark.createDataFrame(worn, "id bigint").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
            self.store = (
                self.store.join(times, "id", "left").withColumn("decay_count", (F.col("decay_count") + F.coalesce("_n", F.lit(0))).cast("int")).select(*self.store.columns)
            )
        return actions
