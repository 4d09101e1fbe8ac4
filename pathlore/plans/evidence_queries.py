"""Queries of patterns, thresholds, statistics and retention over recorded evidence, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import lessons as ls
from pathlore.functions import patterns as p
from pathlore.functions import text as tx
from pathlore.operators import evidence, memory
from pathlore.plans.curation_queries import _types
from pathlore.plans.derived import REFLECTIONS, reflections, sql_list
from pathlore.plans.registry import register
from pathlore.session import table

RUNS = f"{REFLECTIONS}, ru AS (SELECT *, {_types('task', p.REQUEST_TYPES, p.OTHER_REQUEST)} AS type, array_to_string(tools, ' -> ') AS sig FROM r WHERE len(tools) > 0)"
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '\s+'), lambda w: length(w) > 2))"
_JACCARD = f"len(list_intersect({_WORDS.format('p')}, {_WORDS.format('o.sig')})) / len(list_distinct(list_concat({_WORDS.format('p')}, {_WORDS.format('o.sig')})))"
MERGED = f"""{RUNS}, s AS (SELECT type, sig, min(id) AS f FROM ru GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY f) AS rn FROM s),
g(type, rn, pats, sig, pattern) AS (SELECT DISTINCT type, 0::BIGINT, []::VARCHAR[], ''::VARCHAR, ''::VARCHAR FROM s UNION ALL
  SELECT o.type, o.rn, CASE WHEN list_filter(pats, lambda p: {_JACCARD} > 0.5)[1] IS NULL THEN list_append(pats, o.sig) ELSE pats END, o.sig, coalesce(list_filter(pats, lambda p: {_JACCARD} > 0.5)[1], o.sig)
  FROM g JOIN o ON o.type = g.type AND o.rn = g.rn + 1),
pt AS (SELECT type, pattern, count(*) AS occurrences, count(*) FILTER (outcome = 'success') / count(*) AS success_rate, avg(iterations) AS iterations, avg(cost) AS cost, max(id) AS last FROM ru JOIN g USING (type, sig) WHERE g.rn > 0 GROUP BY 1, 2)"""


def _runs(spark, sf_dir):
    return reflections(spark, sf_dir).withColumn("type", ls.request_type(F.col("task"))).withColumn("sig", evidence.signature(F.col("tools")))


@register("evidence_patterns", f"WITH RECURSIVE {MERGED} SELECT type, pattern, occurrences, round(success_rate, 6) AS success_rate, round(iterations, 6) AS iterations, round(cost, 6) AS cost, last FROM pt")
def evidence_patterns(spark, sf_dir):
    m = evidence.merged(_runs(spark, sf_dir), "type", "sig", "id")
    return m.select("type", "pattern", "occurrences", *[F.round(c, 6).alias(c) for c in ("success_rate", "iterations", "cost")], "last")


@register("pattern_sources", f"WITH RECURSIVE {MERGED} SELECT type, pattern, id FROM ru JOIN g USING (type, sig) WHERE g.rn > 0 QUALIFY row_number() OVER (PARTITION BY type, pattern ORDER BY id DESC) <= 10")
def pattern_sources(spark, sf_dir):
    """The last ten runs of each pattern."""
    runs = _runs(spark, sf_dir).where("sig != ''").select("type", "sig", "id")
    of = evidence.pattern_of(runs, "type", "sig", "id")
    return evidence.top_per_group(runs.join(of, ["type", "sig"]).select("type", "pattern", "id"), ["type", "pattern"], [F.col("id").desc()], 10)


@register("graduated_strategies", f"""WITH RECURSIVE {MERGED}, a AS (SELECT count(*) AS n, avg(success_rate) AS mean FROM pt), t AS (SELECT count(*) AS runs FROM events)
SELECT type, pattern, occurrences, round(success_rate, 6) AS success_rate FROM pt, a, t WHERE occurrences >= greatest(3, ceil(sqrt(runs))) AND success_rate >= least(0.9, greatest(0.6, mean + 0.1))
QUALIFY row_number() OVER (ORDER BY success_rate * 10 + occurrences DESC, type, pattern) <= greatest(15, floor(2 * sqrt(n)))""")
def graduated_strategies(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return evidence.graduates(evidence.merged(runs, "type", "sig", "id"), runs.count()).select("type", "pattern", "occurrences", F.round("success_rate", 6).alias("success_rate"))


@register("ungraduated", f"WITH RECURSIVE {MERGED} SELECT type, pattern FROM pt WHERE pattern NOT IN (SELECT sig FROM s WHERE type = 'general')")
def ungraduated(spark, sf_dir):
    """Patterns that no skill came from (here: whose signature isn't one of the general type's)."""
    runs = _runs(spark, sf_dir)
    done = runs.where("type = 'general' AND sig != ''").select(F.col("sig").alias("pattern")).distinct()
    return evidence.merged(runs, "type", "sig", "id").select("type", "pattern").join(done, "pattern", "left_anti").select("type", "pattern")


@register("desktop_thresholds", f"""WITH {REFLECTIONS}, a AS (SELECT count(*) AS n, count(DISTINCT kind) AS types FROM r), g AS (SELECT task, avg((outcome = 'success')::INT) AS rate, len(list_filter(regexp_split_to_array(regexp_replace(lower(task), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2)) AS words FROM r GROUP BY 1),
b AS (SELECT count(*) AS segments, avg(rate) AS rate, avg(words) AS words FROM g)
SELECT greatest(20, types * 5) AS reflections_cap, (greatest(30, segments + ceil(sqrt(greatest(segments, 1)) * 3)))::BIGINT AS segments_cap, (greatest(20, floor(sqrt(greatest(segments, 1)) * 3)))::BIGINT AS skills_cap,
  (greatest(3, ceil(sqrt(greatest(n, 1)))))::BIGINT AS graduation_occurrences, round(least(0.9, greatest(0.5, rate + 0.1)), 6) AS graduation_success, round(greatest(0.3, 1 - 1 / sqrt(greatest(words, 1))), 6) AS same_above FROM a, b""")
def desktop_thresholds(spark, sf_dir):
    """Caps and limits from the counts of reflections and of segments (here distinct tasks)."""
    r = reflections(spark, sf_dir)
    by = r.groupBy("kind", "task").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "success").alias("good"))
    a = by.groupBy("kind").agg(F.sum("n").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("types"))
    g = by.groupBy("task").agg((F.sum("good") / F.sum("n")).alias("rate")).withColumn("words", F.size(tx.tokens(F.col("task"))))
    b = g.agg(F.count("*").alias("segments"), F.avg("rate").alias("rate"), F.avg("words").alias("words"))
    return a.crossJoin(F.broadcast(b)).select(*memory.desktop_thresholds(F.col("n"), F.col("types"), F.col("segments"), F.col("rate"), F.col("words")))


_STOPS = f"lambda w: length(w) > 2 AND NOT list_contains({sql_list(p.TOPIC_STOPS)}, w)"
_TERMS = f"list_filter(regexp_split_to_array(regexp_replace(lower(task), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+'), {_STOPS})"
USAGE = f"""{REFLECTIONS}, u AS (SELECT session AS memory, ts, task, {_TERMS} AS terms FROM r), l AS (SELECT memory, ts, unnest(list_distinct(list_concat([regexp_replace(trim(lower(task)), '\\s+', ' ', 'g')], terms[1:5]))) AS q FROM u),
co AS (SELECT substr(md5(q), 1, 12) AS hash, memory, count(*) AS frequency, max(ts) AS last_seen FROM l GROUP BY 1, 2)"""


def _usage(spark, sf_dir):
    r = reflections(spark, sf_dir).select(F.col("session").alias("memory"), "ts", "task")
    return evidence.usage_terms(r, "task", tx.topic_terms(F.col("task")), tx.query_hash).groupBy("hash", "memory").agg(F.count("*").alias("frequency"), F.max("ts").alias("last_seen"))


@register("memory_usage", f"WITH {USAGE} SELECT * FROM co")
def memory_usage(spark, sf_dir):
    """How often each memory went with a query or one of its first five terms."""
    return _usage(spark, sf_dir)


@register("access_patterns", f"WITH {USAGE}, f AS (SELECT hash, memory FROM co WHERE frequency >= 3 ORDER BY frequency DESC, hash, memory LIMIT 5000) SELECT hash, count(*) AS memories, min(memory) AS first_memory FROM f GROUP BY 1")
def access_patterns(spark, sf_dir):
    """The memories that go with a query often, of the 5000 most frequent pairs (that number is the feature)."""
    often = _usage(spark, sf_dir).where("frequency >= 3").orderBy(F.col("frequency").desc(), "hash", "memory").limit(5000)
    return often.groupBy("hash").agg(F.size(F.collect_set("memory")).cast("long").alias("memories"), F.min("memory").alias("first_memory"))


@register("failed_lessons", f"WITH {REFLECTIONS} SELECT id, lessons[1] AS lesson FROM r WHERE outcome = 'failure' AND len(lessons) > 0 AND abs(iterations - 10) <= 3")
def failed_lessons(spark, sf_dir):
    """Lessons of failed branches that begin within three frames of a checkpoint (here at frame 10)."""
    return reflections(spark, sf_dir).where(memory.near_checkpoint(F.col("outcome"), F.col("iterations"), 10) & (F.size("lessons") > 0)).select("id", F.col("lessons")[0].alias("lesson"))


@register("pruned_memories", f"WITH {REFLECTIONS}, n AS (SELECT max(ts) AS now FROM r) SELECT id FROM r, n WHERE NOT (kind IN ('view', 'click') AND ts < now - INTERVAL 10 DAY AND confidence < 0.1)")
def pruned_memories(spark, sf_dir):
    """What is left once old memories of two types and of low importance are gone."""
    r = reflections(spark, sf_dir).select("id", "kind", "ts", "confidence")
    old = F.col("kind").isin("view", "click") & (F.col("ts") < F.col("now") - F.expr("INTERVAL 10 DAYS")) & (F.col("confidence") < 0.1)
    return r.crossJoin(F.broadcast(r.agg(F.max("ts").alias("now")))).where(~old).select("id")


@register("importance_updates", f"WITH {REFLECTIONS}, n AS (SELECT *, confidence * greatest(0.1, 1 / log10(id % 90 + 10)) * (1 + 0.3 * log10(iterations + 1)) AS fresh FROM r) SELECT id, round(fresh, 6) AS importance FROM n WHERE abs(round(fresh - confidence, 9)) > 0.01")
def importance_updates(spark, sf_dir):
    """New scores of the memories whose score moves by more than .01."""
    new = memory.importance(F.col("confidence"), F.col("id") % 90, F.col("iterations"))
    return reflections(spark, sf_dir).select("id", "confidence", new.alias("fresh")).where(F.abs(F.round(F.col("fresh") - F.col("confidence"), 9)) > 0.01).select("id", F.round("fresh", 6).alias("importance"))


@register("execution_stats", "SELECT l_shipmode AS tool, count(*) AS n, count(*) FILTER (l_returnflag = 'N') AS good, round(avg(l_quantity), 6) AS mean_ms, max(l_quantity) AS most_ms, min(l_quantity) AS least_ms FROM (SELECT *, l_linestatus AS l_shipmode FROM lineitem) GROUP BY 1")
def execution_stats(spark, sf_dir):
    """Executions of each tool (here a line's status): how many, how many good, and their times."""
    return memory.execution_stats(table(spark, sf_dir, "lineitem"), F.col("l_linestatus").alias("tool"), F.col("l_returnflag") == "N", "l_quantity")


@register("prediction_stats", "WITH n AS (SELECT max(ts) - INTERVAL 1 DAY AS since FROM events) SELECT count(*) AS predictions, round(avg(value), 6) AS mean_ms, round(avg((event_type = 'click')::INT), 6) AS hit_rate FROM events, n WHERE ts > since")
def prediction_stats(spark, sf_dir):
    """Predictions of the last day: how many, their mean time and hit rate."""
    e = table(spark, sf_dir, "events").select("ts", "value", "event_type")
    day = e.crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("since")))).where("ts > since")
    return day.agg(F.count("*").alias("predictions"), F.round(F.avg("value"), 6).alias("mean_ms"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("hit_rate"))


@register("learning_stats", f"WITH {REFLECTIONS} SELECT kind, count(*) AS n, count(*) FILTER (outcome = 'success') AS good, round(avg((outcome = 'success')::INT), 6) AS success_rate, round(avg(len(lessons)), 6) AS mean_lessons FROM r GROUP BY ROLLUP (kind)")
def learning_stats(spark, sf_dir):
    """Reflections and successes by kind, and over all kinds."""
    good = F.col("outcome") == "success"
    return reflections(spark, sf_dir).rollup("kind").agg(F.count("*").alias("n"), F.count_if(good).alias("good"), F.round(F.avg(good.cast("int")), 6).alias("success_rate"), F.round(F.avg(F.size("lessons")), 6).alias("mean_lessons"))


@register("top_patterns", f"WITH RECURSIVE {MERGED} SELECT type, pattern, occurrences FROM pt ORDER BY occurrences DESC, type, pattern LIMIT 5")
def top_patterns(spark, sf_dir):
    return evidence.merged(_runs(spark, sf_dir), "type", "sig", "id").orderBy(F.col("occurrences").desc(), "type", "pattern").limit(5).select("type", "pattern", "occurrences")


@register("convergence", f"WITH {REFLECTIONS}, c AS (SELECT task, count(*) AS n, count(*) FILTER (kind <> 'click') AS synthetic, sum(CASE WHEN kind <> 'click' THEN confidence END) AS conf FROM r GROUP BY 1) SELECT count(*) AS types, count(*) FILTER (n >= 5) AS converged, round(count(*) FILTER (n >= 5) / count(*), 6) AS rate, round(sum(conf) / sum(synthetic), 6) AS synthetic_confidence FROM c")
def convergence(spark, sf_dir):
    """How many types of task have five reflections or more, and the mean confidence of those that aren't real."""
    made = F.col("kind") != "click"
    c = reflections(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"), F.count_if(made).alias("made"), F.sum(F.when(made, F.col("confidence"))).alias("conf"))
    done = F.count_if(F.col("n") >= 5)
    return c.agg(F.count("*").alias("types"), done.alias("converged"), F.round(done / F.count("*"), 6).alias("rate"), F.round(F.sum("conf") / F.sum("made"), 6).alias("synthetic_confidence"))


@register("failure_analysis", f"WITH {REFLECTIONS}, f AS (SELECT kind, CASE WHEN loops > 0 THEN 'loop' WHEN stagnations > 0 THEN 'stagnation' WHEN iterations >= 20 THEN 'timeout' ELSE 'other' END AS class FROM r WHERE outcome <> 'success') SELECT class, count(*) AS n, count(DISTINCT kind) AS kinds FROM f GROUP BY 1 ORDER BY n DESC, class LIMIT 5")
def failure_analysis(spark, sf_dir):
    """The commonest classes of failures."""
    kind = F.when(F.col("loops") > 0, "loop").when(F.col("stagnations") > 0, "stagnation").when(F.col("iterations") >= 20, "timeout").otherwise("other")
    f = reflections(spark, sf_dir).where("outcome != 'success'").groupBy(kind.alias("class"), "kind").agg(F.count("*").alias("n"))
    return f.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).orderBy(F.col("n").desc(), "class").limit(5)


@register("failure_keys", f"""WITH {REFLECTIONS}, k AS (SELECT id, outcome, session, unnest(lessons) AS lesson FROM r WHERE outcome = 'failure'),
x AS (SELECT *, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(lesson), '[^a-z0-9\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 3)[1:4], ' ') AS key FROM k)
SELECT key, count(*) AS n, count(DISTINCT session) AS sessions, arg_min(lesson, id) AS example FROM x GROUP BY 1""")
def failure_keys(spark, sf_dir):
    """Lessons of failures by their first four longer words."""
    k = reflections(spark, sf_dir).where("outcome = 'failure'").select("id", "session", F.explode("lessons").alias("lesson")).withColumn("key", tx.pattern_key(F.col("lesson")))
    by = k.groupBy("key", "session").agg(F.count("*").alias("n"), F.min_by("lesson", "id").alias("lesson"), F.min("id").alias("id"))
    return by.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("sessions"), F.min_by("lesson", "id").alias("example"))


@register("health_today", "WITH d AS (SELECT max(ts)::DATE AS day FROM events) SELECT count(*) AS queries, count(*) FILTER (event_type = 'error') AS errors, round(100.0 * count(*) FILTER (event_type = 'error') / count(*), 6) AS error_percent, round(sum(value), 4) AS cost FROM events, d WHERE ts::DATE = day")
def health_today(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "event_type", "value")
    today = e.crossJoin(F.broadcast(e.agg(F.to_date(F.max("ts")).alias("day")))).where(F.to_date("ts") == F.col("day"))
    bad = F.count_if(F.col("event_type") == "error")
    return today.agg(F.count("*").alias("queries"), bad.alias("errors"), F.round(100.0 * bad / F.count("*"), 6).alias("error_percent"), F.round(F.sum("value"), 4).alias("cost"))


@register("schedule_stats", "WITH n AS (SELECT max(ts) - INTERVAL 1 HOUR AS since FROM events) SELECT count(*) FILTER (user_id % 2 = 0) AS enabled, count(*) FILTER (user_id % 2 <> 0) AS disabled, count(*) FILTER (ts > since) AS last_hour FROM events, n")
def schedule_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("ts", "user_id")
    own = e.crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 1 HOUR")).alias("since"))))
    return own.agg(F.count_if(F.col("user_id") % 2 == 0).alias("enabled"), F.count_if(F.col("user_id") % 2 != 0).alias("disabled"), F.count_if(F.col("ts") > F.col("since")).alias("last_hour"))


@register("workflow_stats", "SELECT o_orderpriority, count(*) AS n, coalesce(round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0)), 0)::BIGINT AS success_percent FROM orders GROUP BY 1")
def workflow_stats(spark, sf_dir):
    """Whole per cent of finished workflows that succeeded; 0 where none has finished."""
    done = [F.count_if(F.col("o_orderstatus").isin(*s)) for s in (["F"], ["F", "O"])]
    share = F.coalesce(F.round(F.try_divide(100.0 * done[0], done[1])), F.lit(0.0)).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), share.alias("success_percent"))


@register("index_statistics", f"WITH {REFLECTIONS} SELECT count(*) AS total, count(*) FILTER (outcome = 'success') AS successes, count(*) FILTER (outcome = 'failure') AS failures, round(avg(iterations), 6) AS mean_duration FROM r")
def index_statistics(spark, sf_dir):
    return reflections(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.col("outcome") == "success").alias("successes"), F.count_if(F.col("outcome") == "failure").alias("failures"), F.round(F.avg("iterations"), 6).alias("mean_duration"))


@register("progress_report", f"""WITH {REFLECTIONS}, c AS (SELECT task, count(*) FILTER (id % 2 = 0) AS a, count(*) AS b FROM r GROUP BY 1)
SELECT sum(b)::BIGINT - sum(a)::BIGINT AS reflections, count(*) FILTER (b > 0) - count(*) FILTER (a > 0) AS categories, count(*) FILTER (b >= 5) - count(*) FILTER (a >= 5) AS converged FROM c""")
def progress_report(spark, sf_dir):
    """What later reflections (odd ids) add to coverage: one pass counts both states."""
    c = reflections(spark, sf_dir).groupBy("task").agg(F.count_if(F.col("id") % 2 == 0).alias("a"), F.count("*").alias("b"))
    grown = lambda n: F.count_if(F.col("b") >= n) - F.count_if(F.col("a") >= n)
    return c.agg((F.sum("b") - F.sum("a")).alias("reflections"), grown(1).alias("categories"), grown(5).alias("converged"))


@register("kept_logs", "WITH n AS (SELECT max(ts) - INTERVAL 30 DAY AS since FROM events) SELECT event_id FROM events, n WHERE ts >= since")
def kept_logs(spark, sf_dir):
    """Access logs of the last 30 days."""
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return e.crossJoin(F.broadcast(e.agg((F.max("ts") - F.expr("INTERVAL 30 DAYS")).alias("since")))).where("ts >= since").select("event_id")


@register("missed_tasks", "WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderkey AS task, 'missed' AS status FROM orders, n WHERE o_orderstatus = 'O' AND o_orderdate < now - INTERVAL 30 DAY AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def missed_tasks(spark, sf_dir):
    """Overdue tasks that have no execution (here: no line with flag R) become missed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    ran = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    due = o.crossJoin(F.broadcast(o.agg(F.max("o_orderdate").alias("now")))).where("o_orderstatus = 'O' AND o_orderdate < now - INTERVAL 30 DAYS")
    return due.join(ran, "o_orderkey", "left_anti").select(F.col("o_orderkey").alias("task"), F.lit("missed").alias("status"))


@register("task_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderpriority DESC, o_orderdate DESC, o_orderkey LIMIT 50")
def task_list(spark, sf_dir):
    """The 50 tasks of a status that come first, by priority and date."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").orderBy(F.col("o_orderpriority").desc(), F.col("o_orderdate").desc(), "o_orderkey").limit(50).select("o_orderkey", "o_orderpriority")


@register("newest_executions", "SELECT l_returnflag AS task, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 20")
def newest_executions(spark, sf_dir):
    """The newest 20 executions of each task (here a flag: three hot groups)."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("task"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return evidence.top_per_group(own, ["task"], [F.col("l_shipdate").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 20).select("task", "l_orderkey", "l_linenumber")


@register("retest_pick", """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS class, o_totalprice AS slow FROM orders)
SELECT id, class FROM c ORDER BY class, slow DESC, id LIMIT 30""")
def retest_pick(spark, sf_dir):
    """Thirty tasks to test again: failed ones, then hard ones, then the slowest."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return o.select(F.col("o_orderkey").alias("id"), kind.alias("class"), "o_totalprice").orderBy("class", F.col("o_totalprice").desc(), "id").limit(30).select("id", "class")


@register("state_vote", f"WITH {REFLECTIONS} SELECT session, list_sort(list_distinct(flatten(list(lessons))))[1:15] AS tests FROM r GROUP BY 1")
def state_vote(spark, sf_dir):
    """The distinct lessons that a session's reflections propose, the first 15."""
    r = reflections(spark, sf_dir).select("session", F.explode_outer("lessons").alias("x"))
    return r.groupBy("session").agg(F.slice(F.sort_array(F.collect_set("x")), 1, 15).alias("tests"))


@register("session_topics", f"""WITH {REFLECTIONS}, t AS (SELECT session, unnest({_TERMS}) AS topic, ts FROM r), c AS (SELECT session, topic, count(*) AS n, max(ts) AS seen FROM t WHERE length(topic) > 3 GROUP BY 1, 2)
SELECT session, topic, n FROM c QUALIFY row_number() OVER (PARTITION BY session ORDER BY seen DESC, topic) <= 20""")
def session_topics(spark, sf_dir):
    """The 20 topics that each session has named last."""
    t = reflections(spark, sf_dir).select("session", F.explode(tx.topic_terms(F.col("task"))).alias("topic"), "ts").where(F.length("topic") > 3)
    c = t.groupBy("session", "topic").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    w = Window.partitionBy("session").orderBy(F.col("seen").desc(), "topic")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("session", "topic", "n")
