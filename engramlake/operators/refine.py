"""Consolidation: redundant pairs, aggregation candidates, pools, answers of a model, training examples."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.rules import has_pii, scrub, training_scrub
from engramlake.functions.text import word_overlap, word_set
from engramlake.operators.gate import profile_how, profile_latest
from engramlake.operators.store import FACT, PATTERN, PRINCIPLE, active, domain_counts, newest


def active_domains(store: DataFrame, n: int = 5) -> DataFrame:
    """The n domains with the most memories."""
    return domain_counts(store).orderBy(F.desc("memory_count"), "domain").limit(n)


def redundant_pairs(store: DataFrame, domains: int = 5, newest_n: int = 30, heads: int = 10, ahead: int = 3) -> DataFrame:
    """Pairs of near facts with their word overlap: domain, id_a, id_b, overlap.

    In each of the largest domains the newest facts are lined up; each of the
    first ``heads`` is compared with the ``ahead`` that follow it.
    """
    facts = active(store).where(F.col("level") == FACT).join(active_domains(store, domains).select("domain"), "domain", "left_semi")
    lined = newest(facts, newest_n, ["domain"], F.col("ts").desc(), F.col("id")).select("domain", "id", "rn", word_set(F.col("content")).alias("ws"))
    a = lined.where(F.col("rn") <= heads).select("domain", F.col("id").alias("id_a"), F.col("rn").alias("ra"), F.col("ws").alias("wa"))
    b = lined.select("domain", F.col("id").alias("id_b"), F.col("rn").alias("rb"), F.col("ws").alias("wb"))
    near = a.join(b, "domain").where((F.col("rb") > F.col("ra")) & (F.col("rb") <= F.col("ra") + ahead))
    return near.select("domain", "id_a", "id_b", F.round(word_overlap(F.col("wa"), F.col("wb")), 6).alias("overlap"))


def aggregation_candidates(store: DataFrame, low: int, high: int, at_least: int, ratio: int, take: int) -> DataFrame:
    """The newest ``take`` memories of level ``low`` in domains with enough of them against level ``high``."""
    on = active(store).where(F.col("domain") != "")
    n = on.groupBy("domain").agg(F.count_if(F.col("level") == low).alias("lows"), F.count_if(F.col("level") == high).alias("highs"))
    due = n.where((F.col("lows") >= at_least) & ((F.col("highs") == 0) | (F.col("lows") > ratio * F.col("highs"))))
    rows = newest(on.where(F.col("level") == low), take, ["domain"], F.col("ts").desc(), F.col("id"))
    return rows.join(due, "domain").select("domain", "id", "rn", "lows", "highs")


def fact_candidates(store: DataFrame) -> DataFrame:
    return aggregation_candidates(store, FACT, PATTERN, 10, 10, 20)


def pattern_candidates(store: DataFrame) -> DataFrame:
    return aggregation_candidates(store, PATTERN, PRINCIPLE, 3, 3, 10)


def wander_pool(store: DataFrame, habits: DataFrame, principles: int = 20, patterns: int = 20) -> DataFrame:
    """Tagged texts to associate freely: all habits, the most used principles and patterns (kind, id, text)."""

    def level(n: int, tag: str, k: int) -> DataFrame:
        best = active(store).where(F.col("level") == n).orderBy(F.desc("hit_count"), F.desc("ts"), "id").limit(k)
        return best.select(F.lit(tag).alias("kind"), "id", F.concat(F.lit(f"[{tag}/"), F.coalesce("domain", F.lit("")), F.lit("] "), F.col("content")).alias("text"))

    all_habits = habits.select(F.lit("habit").alias("kind"), F.col("habit_id").alias("id"), F.concat(F.lit("[habit] "), F.col("description")).alias("text"))
    return all_habits.unionByName(level(PRINCIPLE, "principle", principles)).unionByName(level(PATTERN, "pattern", patterns))


def wander_sample(pool: DataFrame, seed: int, n: int = 5) -> DataFrame:
    """n of the pool, the same ones for a seed."""
    return pool.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "kind", F.col("id").cast("string"))), "kind", "id").limit(n)


def prompts(store: DataFrame, per_domain: int = 15, header: str = "What do these notes of one person have in common?") -> DataFrame:
    """One prompt per domain from its newest memories: domain, n, prompt."""
    rows = newest(active(store).where(F.col("domain") != ""), per_domain, ["domain"], F.col("ts").desc(), F.col("id"))
    listed = rows.groupBy("domain").agg(F.sort_array(F.collect_list(F.struct("rn", "content"))).alias("m"))
    lines = F.transform("m", lambda x: F.concat(F.lit("- "), F.coalesce(x["content"], F.lit(""))))
    return listed.select("domain", F.size("m").alias("n"), F.concat_ws("\n", F.lit(header), F.concat(F.lit("Domain: "), F.col("domain")), F.array_join(lines, "\n")).alias("prompt"))


_INSIGHT = re.compile(r"\s*INSIGHT:\s*(.*?)\s*$", re.I)
_CONFIDENCE = re.compile(r"\s*CONFIDENCE:.*?([^:]*)$", re.I)


def insights_of(answer: str | None, default: float = 0.5) -> list[tuple[str, float]]:
    """(description, confidence) of each INSIGHT line; a CONFIDENCE line right after it counts, a bad number does not.

    A line that says only NONE makes the answer empty.
    """
    lines = (answer or "").strip().split("\n")
    if any(x.strip().upper() == "NONE" for x in lines):
        return []
    out = []
    for k, line in enumerate(lines):
        if (m := _INSIGHT.match(line)) and m.group(1):
            confidence = default
            if k + 1 < len(lines) and (c := _CONFIDENCE.match(lines[k + 1])):
                try:
                    confidence = float(c.group(1))
                except ValueError:
                    pass
            out.append((m.group(1), min(max(confidence, 0.0), 1.0)))
    return out


#: Views a debate hears before it is summed up.
ROLES = ("Keep to what is well supported; object to the rest.", "Look for what is new or connects things.", "Say it in as few words as possible.")


def debated(model: Callable[[str, str], str], prompt: str) -> list[tuple[str, float]]:
    """The insights of a debate: each role's answer to the prompt, then one answer that sums them up."""
    said = [model(prompt, role) for role in ROLES]
    heard = "\n\n".join(f"{k}. {x.strip()}" for k, x in enumerate(said, 1) if x and x.strip())
    return insights_of(model(f"{prompt}\n\n{heard}", "Sum up with INSIGHT: and CONFIDENCE: lines, or NONE.")) if heard else []


_ACTIONS = {"MERGE": "merge", "KEEP": "keep", "ARCHIVE": "archive", "DECAY": "decay", "INSIGHT": "insight"}
_ANY_ACTION = "|".join(_ACTIONS)


def actions_of(answer: str | None) -> list[tuple[str, int | None, str]]:
    """(type, memory id, rest) of MERGE, KEEP, ARCHIVE, DECAY and INSIGHT lines; several on one line count each.

    ARCHIVE and DECAY need an id, INSIGHT a text; ``merge_ids`` reads a MERGE's ids.
    """
    out = []
    for m in re.finditer(rf"\b({_ANY_ACTION}):\s*(.*?)(?=\b(?:{_ANY_ACTION}):|\n|$)", answer or ""):
        kind, rest = _ACTIONS[m.group(1)], m.group(2).strip()
        number = re.match(r"(\d+)", rest) if kind != "insight" else None
        if number or kind in ("merge", "keep") or (kind == "insight" and rest):
            out.append((kind, int(number.group(1)) if number else None, rest))
    return out


def merge_ids(rest: str) -> list[int]:
    """The ids a MERGE line names before any other text, each once: the first stays, the others go into it."""
    between = r"[\s\[\](){}#,;+&]*"
    head = re.match(rf"(?:{between}(?:and|with|into)?{between}\d+)*", rest).group()
    return list(dict.fromkeys(int(x) for x in re.findall(r"\d+", head)))


def parsed_insights(answers: DataFrame, keep: list[str], text_col: str, default: float = 0.5) -> DataFrame:
    """``insights_of`` over a table of answers: keep columns, pos, description, confidence."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (*[r[c] for c in keep], k, d, c)
                for r in pdf.to_dict("records")
                for k, (d, c) in enumerate(insights_of(r[text_col], default))
            ]
            yield pd.DataFrame(rows, columns=[*keep, "pos", "description", "confidence"])

    types = dict(answers.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", pos int, description string, confidence double"
    return answers.select(*keep, text_col).mapInPandas(run, schema)


def contribution_funnel(habits: DataFrame, store: DataFrame, least: float = 0.7, shortest: int = 10) -> DataFrame:
    """Outcome of each habit on its way to being shared: habit_id, outcome, text.

    In this order: low_confidence, sealed (it rests on a sealed memory), pii,
    short, duplicate (an earlier one has the same text), shared.
    """
    sealed = store.where(F.col("privacy") == "sealed").select(F.col("id").alias("_s")).distinct()
    refs = habits.select("habit_id", F.explode("source_ids").alias("_s")).join(sealed, "_s", "left_semi").select("habit_id").distinct().withColumn("_sealed", F.lit(True))
    rows = habits.join(refs, "habit_id", "left").withColumn("text", scrub(F.col("description")))
    early = (
        F.when(F.col("confidence").isNull() | (F.col("confidence") < least), "low_confidence")
        .when(F.col("_sealed"), "sealed")
        .when(has_pii(F.col("description")), "pii")
        .when(F.col("description").isNull() | (F.length("text") < shortest), "short")
    )
    rows = rows.withColumn("_early", early)
    w = Window.partitionBy("text").orderBy("habit_id")
    passed = rows.where(F.col("_early").isNull()).withColumn("outcome", F.when(F.row_number().over(w) > 1, "duplicate").otherwise("shared"))
    rest = rows.where(F.col("_early").isNotNull()).withColumn("outcome", F.col("_early"))
    return passed.select("habit_id", "outcome", "text").unionByName(rest.select("habit_id", "outcome", "text"))


# Words that mark a preference.
PREFERENCE_WORDS = ("喜欢", "偏好", "prefer", "like", "love")


def preferences(habits: DataFrame) -> DataFrame:
    hit = F.lit(False)
    for w in PREFERENCE_WORDS:
        hit = hit | F.col("description").contains(w)
    return habits.where(hit)


def training_examples(store: DataFrame, language: str = "en", principles: int = 10, patterns: int = 20) -> DataFrame:
    """Chat examples from the most used principles and patterns: kind, id, messages array<struct<role, content>>."""
    ask = {
        "en": {PRINCIPLE: "Which rule shows in what you know about {}?", PATTERN: "What stands out about {}?"},
        "zh": {PRINCIPLE: "在{}上你看到了怎样的规律？", PATTERN: "{}方面有什么特别的？"},
    }[language]
    system = F.struct(F.lit("system").alias("role"), F.lit("You know this person from earlier conversations.").alias("content"))

    def level(n: int, tag: str, k: int) -> DataFrame:
        best = active(store).where(F.col("level") == n).orderBy(F.desc("hit_count"), F.desc("ts"), "id").limit(k)
        clean = best.withColumn("_t", training_scrub(F.col("content"))).where(F.col("_t") != "")
        question = F.replace(F.lit(ask[n]), F.lit("{}"), F.coalesce("domain", F.lit("")))
        talk = F.array(system, F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), F.col("_t").alias("content")))
        return clean.select(F.lit(tag).alias("kind"), "id", talk.alias("messages"))

    return level(PRINCIPLE, "principle", principles).unionByName(level(PATTERN, "pattern", patterns))


# Question and answer of each habit-based example; {} is the text or the domain.
_ASK_HABITS = {
    "en": {"habit_summary": ("What do you know about me?", "Based on our interactions, {}"), "preferences": ("What are my preferences?", "{}"), "habits_list": ("Remind me about my habits.", "{}"), "pattern_summary": ("What patterns have you noticed about me?", "{}"), "domain": ("What should I keep in mind about {}?", "{}")},
    "zh": {"habit_summary": ("你了解我什么？", "根据我们的交流，{}"), "preferences": ("我有什么偏好？", "{}"), "habits_list": ("提醒我一下我的习惯。", "{}"), "pattern_summary": ("你发现了我什么规律？", "{}"), "domain": ("关于{}我需要注意什么？", "{}")},
}


def habit_examples(store: DataFrame, habits: DataFrame, language: str = "en") -> DataFrame:
    """Question and answer examples from habits, preferences, patterns and the largest domains, as in the reference.

    kind, id, messages. Texts are scrubbed; a text with personal information is left out, an example without text too.
    The system prompt carries five habits and all domains.
    """

    def first(rows: DataFrame, order: list, k: int, by: list[str], sep: str, lead: str = "") -> DataFrame:
        clean = rows.where(F.col("_t") != "").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k)
        texts = F.transform(F.sort_array(F.collect_list(F.struct("_r", "_t"))), lambda x: F.concat(F.lit(lead), x["_t"]))
        return clean.groupBy(*by).agg(F.array_join(texts, sep).alias("_a"))

    own = habits.withColumn("_t", training_scrub(F.col("description")))
    liked = preferences(habits).withColumn("_t", training_scrub(F.col("description")))
    notes = active(store).withColumn("_t", training_scrub(F.col("content")))
    newest_first, by_id = [F.desc("ts"), F.col("id")], [F.col("habit_id")]
    patterns = notes.where(F.col("level") == PATTERN)
    single = {
        "habit_summary": first(own, by_id, 10, [], "；"),
        "preferences": first(liked, by_id, 5, [], "；"),
        "habits_list": first(own, by_id, 10, [], "\n", "- "),
        "pattern_summary": first(patterns, newest_first, 5, [], "\n", "- "),
    }
    domains = domain_counts(store).where(F.col("domain") != "")
    top = domains.orderBy(F.desc("memory_count"), "domain").limit(3).select("domain", F.row_number().over(Window.orderBy(F.desc("memory_count"), "domain")).cast("long").alias("id"))
    of = notes.where(F.col("level").isin(PATTERN, FACT)).join(top.select("domain"), "domain", "left_semi")
    insight = first(of, newest_first, 3, ["domain", "level"], "；").groupBy("domain").agg(F.max_by("_a", "level").alias("_a"))
    ask = _ASK_HABITS[language]
    rows = top.join(insight, "domain").select(F.lit("domain").alias("kind"), "id", F.replace(F.lit(ask["domain"][0]), F.lit("{}"), F.col("domain")).alias("_q"), "_a")
    for kind, df in single.items():
        q, a = ask[kind]
        rows = rows.unionByName(df.select(F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("id"), F.lit(q).alias("_q"), F.replace(F.lit(a), F.lit("{}"), F.col("_a")).alias("_a")).where(df["_a"] != ""))
    active_in = domains.agg(F.array_join(F.array_sort(F.collect_list("domain")), ", ").alias("_d"))
    about = first(own, by_id, 5, [], "；").withColumnRenamed("_a", "_h").crossJoin(active_in)
    prompt = F.concat(F.lit("You know this person from earlier conversations.\nHabits: "), F.col("_h"), F.lit("\nActive domains: "), F.col("_d"))
    said = [F.struct(F.lit(role).alias("role"), text.alias("content")) for role, text in (("system", prompt), ("user", F.col("_q")), ("assistant", F.col("_a")))]
    return rows.crossJoin(about).select("kind", "id", F.array(*said).alias("messages"))


def train_valid(examples: DataFrame, key: str = "id", valid_share: int = 5) -> DataFrame:
    """``examples`` with split: every ``valid_share``-th by hash of the key is validation."""
    return examples.withColumn("split", F.when(F.pmod(F.xxhash64("kind", key), F.lit(valid_share)) == 0, "valid").otherwise("train"))


def first_as_valid(examples: DataFrame, order: list[str], batch: int = 4) -> DataFrame:
    """The validation lines of a tuner that needs whole batches: the first max(batch, a fifth) by ``order``, from the start again if there are fewer."""
    n = examples.count()
    k = max(batch, n // 5)
    first = examples.orderBy(*order).limit(min(k, n))
    if n >= k or not n:
        return first
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1  # fewer rows than a batch
    times = F.explode(F.sequence(F.lit(0), F.lit((k - 1) // n)))
    return first.withColumn("_at", at).withColumn("_t", times).where(F.col("_t") * n + F.col("_at") < k).drop("_at", "_t")


def digest(who: dict[str, str], how: dict[str, str], what: dict[str, str], total: int, domains: list[str], token_budget: int = 250) -> str:
    """The text a prompt starts with, cut to a budget of tokens (two characters each)."""
    parts = []
    if who:
        parts.append("User: " + ", ".join(f"{k}: {v}" for k, v in who.items()))
    if how:
        parts.append("Style: " + "; ".join(how.values()))
    if what:
        parts.append("Focus: " + "; ".join(what.values()))
    if total:
        parts.append(f"Memory: {total} entries across {', '.join(domains[:5])}")
    text = "\n".join(parts)
    estimate = len(text) // 2
    return text if estimate <= token_budget else text[: len(text) * token_budget // estimate]


def digests(facts: DataFrame, by: list[str], store: DataFrame, token_budget: int = 250) -> DataFrame:
    """The text a prompt starts with, for each speaker: by columns, text. Set-at-a-time form of ``digest``.

    ``facts`` are profile facts (by columns, ts, facet, key, value). Keys stand
    in alphabetical order; the store's figures are the same for all.
    """
    latest, how = profile_latest(facts, by), profile_how(facts, by)
    rows = latest.select(*by, "facet", "key", "value").unionByName(how.select(*by, F.lit("how").alias("facet"), "key", "value"))
    listed = rows.groupBy(*by).agg(*[F.sort_array(F.collect_list(F.when(F.col("facet") == f, F.struct("key", "value")))).alias(f) for f in ("who", "how", "what")])
    domains = active_domains(store).agg(F.transform(F.sort_array(F.collect_list(F.struct(-F.col("memory_count"), "domain"))), lambda x: x["domain"]).alias("_d"))
    total = active(store).agg(F.count(F.lit(1)).alias("_n"))
    who = F.array_join(F.transform("who", lambda x: F.concat_ws(": ", x["key"], x["value"])), ", ")
    how_, what = (F.array_join(F.transform(f, lambda x: x["value"]), "; ") for f in ("how", "what"))
    parts = [
        F.when(F.size("who") > 0, F.concat(F.lit("User: "), who)),
        F.when(F.size("how") > 0, F.concat(F.lit("Style: "), how_)),
        F.when(F.size("what") > 0, F.concat(F.lit("Focus: "), what)),
        F.when(F.col("_n") > 0, F.concat(F.lit("Memory: "), F.col("_n").cast("string"), F.lit(" entries across "), F.array_join("_d", ", "))),
    ]
    text = F.concat_ws("\n", *parts)
    estimate = F.floor(F.length("_text") / 2)
    cut_at = F.floor(F.length("_text") * F.lit(token_budget) / estimate).cast("int")
    figures = listed.crossJoin(F.broadcast(domains.crossJoin(total))).withColumn("_text", text)
    return figures.select(*by, F.when(estimate <= token_budget, F.col("_text")).otherwise(F.substring(F.col("_text"), F.lit(1), cut_at)).alias("text"))
