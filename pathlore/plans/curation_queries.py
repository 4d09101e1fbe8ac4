"""Queries of lesson quality, types, difficulty, rule lessons and candidates, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import lessons as ls
from pathlore.functions import patterns as p
from pathlore.functions import scalar as sc
from pathlore.operators import curation
from pathlore.plans.derived import REFLECTIONS, phrase, reflections, sql_phrase
from pathlore.plans.queries import TOKENS
from pathlore.plans.registry import register
from pathlore.session import table


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(text: str, patterns: list[str], flags: str = "i") -> str:
    return " + ".join(f"regexp_matches({text}, {_quoted(x)}, '{flags}')::INT" for x in patterns)


def _unit(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def _mean(score: str) -> str:
    return f"CASE WHEN len(lessons) = 0 THEN 0.0 ELSE list_sum(list_transform(lessons, lambda l: {score})) / len(lessons) END"


def _types(text: str, types: list[tuple[str, str]], other: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({text}), {_quoted(x)}) THEN '{n}'" for x, n in types) + f" ELSE '{other}' END"


_VAGUE3 = "regexp_matches(regexp_replace(l, '\\b(thing|stuff|item|element) (button|field|menu)', '', 'gi'), '\\b(thing|stuff|item|element)\\b', 'i')::INT"
_SPECIFIC = _mean(_unit(f"0.25::DOUBLE * ({_any('l', p.CONCRETE)}) - 0.15::DOUBLE * ({_any('l', p.VAGUE[:2])} + {_VAGUE3})"))
_ACTIONABLE = _mean(_unit(f"0.5::DOUBLE + 0.2::DOUBLE * ({_any('l', p.ACTIONABLE)}) - 0.15::DOUBLE * ({_any('l', p.DESCRIPTIVE)})"))
_NOVEL = _mean(_unit(f"""0.5::DOUBLE + CASE WHEN len(regexp_split_to_array(l, '\\s+')) < 5 THEN -0.2::DOUBLE WHEN len(regexp_split_to_array(l, '\\s+')) > 12 THEN 0.1::DOUBLE ELSE 0::DOUBLE END
  + CASE WHEN {_any('l', p.TRIVIAL)} > 0 THEN -0.2::DOUBLE ELSE 0.2::DOUBLE * ({_any('l', p.NOVEL)}) END"""))
_COHERENT = f"""CASE WHEN len(lessons) = 0 THEN 0.0 ELSE {_unit('''0.5::DOUBLE + CASE outcome WHEN 'success' THEN CASE WHEN good OR len(strategies) > 0 THEN 0.3 ELSE 0 END - CASE WHEN bad AND len(failures) = 0 THEN 0.2 ELSE 0 END
  WHEN 'failure' THEN CASE WHEN bad OR len(failures) > 0 THEN 0.3 ELSE 0 END - CASE WHEN good AND NOT bad THEN 0.2 ELSE 0 END ELSE 0 END''')} END"""
QUALITY = f"""{REFLECTIONS}, g AS (SELECT *, regexp_matches(lower(array_to_string(lessons, ' ')), {_quoted(p.FAILURE)}) AS bad, regexp_matches(lower(array_to_string(lessons, ' ')), {_quoted(p.SUCCESS)}) AS good FROM r),
q AS (SELECT *, {_SPECIFIC} AS specificity, {_ACTIONABLE} AS actionability, {_COHERENT} AS coherence, {_NOVEL} AS novelty FROM g)"""


@register("lesson_quality", f"WITH {QUALITY} SELECT id, round(specificity, 6) AS specificity, round(actionability, 6) AS actionability, round(coherence, 6) AS coherence, round(novelty, 6) AS novelty, round((specificity + actionability + coherence + novelty) / 4, 6) AS quality, round((specificity + actionability + coherence + novelty) / 4, 9) >= 0.6 AS is_valid FROM q")
def lesson_quality(spark, sf_dir):
    """The four scores of each reflection, their mean and the verdict (to nine places)."""
    q = curation.with_quality(reflections(spark, sf_dir), "q").select("id", "q")
    names = ["specificity", "actionability", "coherence", "novelty", "quality"]
    return q.select("id", *[F.round(F.col(f"q.{n}"), 6).alias(n) for n in names], (F.round("q.quality", 9) >= 0.6).alias("is_valid"))


@register("lesson_gate", f"WITH {QUALITY} SELECT kind, count(*) AS n, count(*) FILTER (round((specificity + actionability + coherence + novelty) / 4, 9) >= 0.6) AS passed, round(avg((specificity + actionability + coherence + novelty) / 4), 6) AS mean_quality FROM q GROUP BY 1")
def lesson_gate(spark, sf_dir):
    """How many reflections of each kind pass the quality gate, and their mean quality."""
    q = curation.with_quality(reflections(spark, sf_dir), "q").select("kind", F.col("q.quality").alias("q"))
    return q.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.round("q", 9) >= 0.6).alias("passed"), F.round(F.avg("q"), 6).alias("mean_quality"))


@register("request_types", f"WITH {REFLECTIONS} SELECT id, {_types('task', p.REQUEST_TYPES, p.OTHER_REQUEST)} AS request, {_types('task', p.DEMO_TYPES, p.OTHER_INTERACTION)} AS demo, {_types('task', p.GOAL_TYPES, p.OTHER_INTERACTION)} AS goal FROM r")
def request_types(spark, sf_dir):
    task = F.col("task")
    return reflections(spark, sf_dir).select("id", ls.request_type(task).alias("request"), ls.demo_type(task).alias("demo"), ls.goal_type(task).alias("goal"))


def _difficulty(text: str) -> str:
    steps = " + ".join(f"CASE WHEN contains(lower({text}), '{w}') THEN 0.1::DOUBLE ELSE 0 END" for w in p.STEP_WORDS)
    harder = " + ".join(f"CASE WHEN regexp_matches(lower({text}), {_quoted(x)}) THEN {n}::DOUBLE ELSE 0 END" for x, n in p.HARDER)
    return _unit(f"0.3::DOUBLE + {steps} + {harder}")


MODE = "CASE WHEN outcome <> 'failure' THEN 'unknown' WHEN loops > 0 THEN 'loop' WHEN stagnations > 0 THEN 'stagnation' WHEN iterations > 20 THEN 'complexity' ELSE 'execution_error' END"
MORE = "CASE mode WHEN 'loop' THEN 0.15 WHEN 'complexity' THEN 0.2 WHEN 'unknown' THEN 0 ELSE 0.1 END"
HARD = f"{REFLECTIONS}, d AS (SELECT *, {_difficulty('task')} AS base, {MODE} AS mode FROM r), h AS (SELECT *, least(1.0::DOUBLE, base + {MORE}) AS difficulty FROM d)"


@register("task_difficulty", f"WITH {HARD} SELECT id, round(base, 6) AS base, mode, round(difficulty, 6) AS difficulty FROM h")
def task_difficulty(spark, sf_dir):
    mode = ls.failure_mode(F.col("outcome"), F.col("loops"), F.col("stagnations"), F.col("iterations"))
    own = reflections(spark, sf_dir).withColumn("mode", mode)
    return own.select("id", F.round(ls.difficulty(F.col("task")), 6).alias("base"), "mode", F.round(ls.task_difficulty(F.col("task"), F.col("mode")), 6).alias("difficulty"))


@register("curriculum", f"""WITH {HARD}, m AS (SELECT avg(difficulty) AS mean FROM h WHERE outcome = 'failure'), v AS (SELECT id, {_difficulty(sql_phrase('id * 3 + 2'))} AS estimate FROM r WHERE outcome = 'failure')
SELECT id, round(estimate, 6) AS estimate FROM v, m WHERE round(estimate - mean, 9) BETWEEN 0.05 AND 0.25""")
def curriculum(spark, sf_dir):
    """Variants of failed tasks (here another phrase) that are .05 to .25 harder than the failed tasks' mean."""
    mode = ls.failure_mode(F.col("outcome"), F.col("loops"), F.col("stagnations"), F.col("iterations"))
    failed = reflections(spark, sf_dir).where("outcome = 'failure'").select("id", ls.task_difficulty(F.col("task"), mode).alias("d"), ls.difficulty(phrase(F.col("id") * 3 + 2)).alias("estimate"))
    return failed.crossJoin(F.broadcast(failed.agg(F.avg("d").alias("mean")))).where(F.round(F.col("estimate") - F.col("mean"), 9).between(0.05, 0.25)).select("id", F.round("estimate", 6).alias("estimate"))


@register("rule_lessons", f"""WITH {REFLECTIONS}, t AS (SELECT *, {_types('task', p.REQUEST_TYPES, p.OTHER_REQUEST)} AS type, list_distinct(tools) AS du, CASE WHEN iterations = 0 THEN 999 ELSE iterations END AS few FROM r),
x AS (SELECT id, type, [CASE WHEN few <= 4 AND outcome = 'success' THEN 'Efficient approach: ' || array_to_string(tools, ', ') || ' in ' || iterations || ' iterations for ' || type END,
  CASE WHEN iterations > 6 THEN 'High iteration count (' || iterations || '): consider more targeted tool selection' END,
  CASE WHEN cost > CASE type WHEN 'vision' THEN 1.5 WHEN 'desktop_action' THEN 0.5 WHEN 'briefing' THEN 0.3 WHEN 'general' THEN 0.25 ELSE 0.2 END THEN 'high cost' END,
  CASE WHEN outcome = 'failure' THEN 'Failed task type ''' || type || ''': unknown error' END,
  CASE WHEN len(du) >= 3 AND few <= 3 THEN 'Good fan-out pattern: ' || len(du) || ' tools in ' || iterations || ' iterations' END] AS all_lessons FROM t)
SELECT id, type, len(list_filter(all_lessons, lambda l: l IS NOT NULL)) AS n, array_to_string(list_filter(all_lessons, lambda l: l IS NOT NULL), '|') AS lessons FROM x""")
def rule_lessons(spark, sf_dir):
    """Lessons from a run's numbers (the amount in 'high cost' is left out of the comparison: formats of halves differ)."""
    own = reflections(spark, sf_dir).withColumn("type", ls.request_type(F.col("task")))
    found = ls.rule_lessons(F.col("type"), F.col("outcome"), F.col("iterations"), F.col("cost"), F.col("tools"), F.lit(None).cast("string"))
    found = F.transform(found, lambda x: F.when(x.startswith("High cost"), "high cost").otherwise(x))
    return own.select("id", "type", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("lessons"))


@register("judge_lessons", f"""WITH {REFLECTIONS}, e AS (SELECT id, unnest(lessons) AS lesson, confidence FROM r),
c AS (SELECT *, CASE WHEN regexp_matches(lower(lesson), 'success|worked|effective') THEN 'success' WHEN regexp_matches(lower(lesson), 'fail|error|avoid') THEN 'failure' END AS class FROM e)
SELECT class, lesson, count(*) AS n, round(avg(CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END), 6) AS confidence FROM c WHERE class IS NOT NULL GROUP BY 1, 2""")
def judge_lessons(spark, sf_dir):
    """Lessons that tell of success or of failure, with their mean confidence (0 counts as unknown, .5)."""
    e = reflections(spark, sf_dir).select(F.explode("lessons").alias("lesson"), F.when(F.col("confidence") == 0, 0.5).otherwise(F.col("confidence")).alias("c"))
    return e.withColumn("class", ls.lesson_class(F.col("lesson"))).where("class is not null").groupBy("class", "lesson").agg(F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("confidence"))


CANDIDATES = f"{REFLECTIONS}, c AS (SELECT id, session, round({_unit('0.5::DOUBLE * confidence + 0.3::DOUBLE * least(iterations / 5.0, 1) + 0.2::DOUBLE * (1 - (id % 5) / 4.0)')}, 9) AS score FROM r)"


def _candidates(spark, sf_dir):
    score = sc.composite(F.col("iterations"), F.col("confidence"), F.col("id") % 5 + 1)
    return reflections(spark, sf_dir).select("id", "session", F.round(score, 9).alias("score"))


@register("best_candidate", f"WITH {CANDIDATES} SELECT session, arg_max(id, (score, -id)) AS id, round(max(score), 6) AS score, count(*) AS candidates FROM c GROUP BY 1")
def best_candidate(spark, sf_dir):
    """The best candidate of each session, of equals the one with the smallest id; no sort is needed for it."""
    c = _candidates(spark, sf_dir)
    return c.groupBy("session").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("id"), F.round(F.max("score"), 6).alias("score"), F.count("*").alias("candidates"))


@register("ranked_candidates", f"WITH {CANDIDATES} SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY score DESC, id) AS rank FROM c QUALIFY rank <= 3")
def ranked_candidates(spark, sf_dir):
    w = Window.partitionBy("session").orderBy(F.col("score").desc(), "id")
    return _candidates(spark, sf_dir).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("session", "id", F.col("rank").cast("long").alias("rank"))


@register("ranker_stats", f"WITH {CANDIDATES}, s AS (SELECT session, count(*) AS n, max(score) AS top FROM c GROUP BY 1) SELECT count(*) AS runs, round(avg(n), 6) AS mean_candidates, sum(n)::BIGINT AS candidates, round(avg(top), 6) AS mean_top FROM s")
def ranker_stats(spark, sf_dir):
    s = _candidates(spark, sf_dir).groupBy("session").agg(F.count("*").alias("n"), F.max("score").alias("top"))
    return s.agg(F.count("*").alias("runs"), F.round(F.avg("n"), 6).alias("mean_candidates"), F.sum("n").alias("candidates"), F.round(F.avg("top"), 6).alias("mean_top"))


@register("fallback_judge", f"WITH {REFLECTIONS}, a AS (SELECT *, ['click', 'type', 'key', 'drag'][id % 4 + 1] AS action, id % 6 AS price FROM r) SELECT id, round(0.5 * CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END + 0.3 * CASE action WHEN 'key' THEN 0.9 ELSE 0.8 END * CASE WHEN price > 3 THEN 0.9 ELSE 1 END + 0.2 * CASE action WHEN 'click' THEN 0.7 WHEN 'type' THEN 0.8 ELSE 0.6 END, 6) AS score FROM a")
def fallback_judge(spark, sf_dir):
    action = F.element_at(F.array(*map(F.lit, ["click", "type", "key", "drag"])), (F.col("id") % 4 + 1).cast("int"))
    return reflections(spark, sf_dir).select("id", F.round(ls.fallback_judge(action, F.col("confidence"), F.col("id") % 6), 6).alias("score"))


@register("ingest_gate", f"""WITH {QUALITY}, v AS (SELECT id, kind, round((specificity + actionability + coherence + novelty) / 4, 9) >= 0.6 AS good, row_number() OVER (PARTITION BY array_to_string(lessons, ' ') ORDER BY id) > 1 AS again FROM q),
d AS (SELECT CASE WHEN kind NOT IN ('click', 'error', 'purchase', 'view') THEN 'rejected_source' WHEN NOT good THEN 'rejected_quality' WHEN again THEN 'rejected_duplicate' ELSE 'ingested' END AS disposition FROM v)
SELECT disposition, count(*) AS n FROM d GROUP BY 1""")
def ingest_gate(spark, sf_dir):
    """What becomes of each generated reflection: source not allowed, quality too low, lessons known already, or taken in."""
    r = curation.with_quality(reflections(spark, sf_dir), "q")
    good = F.round(F.col("q.quality"), 9) >= 0.6
    own = r.select("id", "kind", good.alias("good"), F.array_join("lessons", " ").alias("text"))
    first = own.groupBy("text").agg(F.min("id").alias("first"))
    d = F.when(~F.col("kind").isin("click", "error", "purchase", "view"), "rejected_source").when(~F.col("good"), "rejected_quality").when(F.col("id") != F.col("first"), "rejected_duplicate").otherwise("ingested")
    return own.join(first, "text").groupBy(d.alias("disposition")).agg(F.count("*").alias("n"))


_GATED = f"""x AS (SELECT doc_id AS id, {TOKENS.format('text')} AS t, source, coalesce(n_chars % 7 <> 0, false) AS good FROM documents), w AS (SELECT id, len(t) AS n_tokens, unnest(t) AS word FROM x), c AS (SELECT id, word, count(*) / n_tokens AS tf FROM w GROUP BY id, n_tokens, word),
e AS (SELECT * FROM c WHERE id % 2 = 0), f AS (SELECT word, count(*) AS df FROM e GROUP BY 1), n AS (SELECT count(*) + 1 AS n FROM documents WHERE doc_id % 2 = 0),
o AS (SELECT id AS match, word, tf * ln(n / df) AS alone, tf * ln(n / (df + 1)) AS beside FROM e JOIN f USING (word), n), a AS (SELECT id, word, tf * ln(n / (coalesce(df, 0) + 1)) AS w FROM c LEFT JOIN f USING (word), n WHERE id % 2 = 1),
s AS (SELECT id, match, round(sum(w * beside) / (sqrt(any_value(na)) * sqrt(any_value(nb) + sum(beside * beside - alone * alone))), 9) AS sim FROM a JOIN o USING (word) JOIN (SELECT id, sum(w * w) AS na FROM a GROUP BY 1) USING (id) JOIN (SELECT match, sum(alone * alone) AS nb FROM o GROUP BY 1) USING (match) GROUP BY 1, 2),
b AS (SELECT id, arg_max(match, (sim, -match)) AS match FROM s WHERE sim >= 0.9 GROUP BY 1)"""


@register("synthetic_ingest", f"WITH {_GATED} SELECT id, CASE WHEN source IS NULL OR source IN ('src1', 'src2') THEN 'source' WHEN NOT good THEN 'quality' WHEN match IS NOT NULL THEN 'duplicate' ELSE 'accepted' END AS disposition, CASE WHEN good AND source NOT IN ('src1', 'src2') THEN match END AS match FROM x LEFT JOIN b USING (id) WHERE id % 2 = 1")
def synthetic_ingest(spark, sf_dir):
    """What becomes of the odd documents as candidates for a store of the even ones: duplicates are told by the cosine of their words."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "source", F.coalesce(F.col("n_chars") % 7 != 0, F.lit(False)).alias("good"))
    named = d.withColumn("source", F.when(F.col("source").isin("src1", "src2"), "other").when(F.col("source").isNotNull(), "real"))
    return curation.ingest(d.where("id % 2 = 0"), named.where("id % 2 = 1"))
