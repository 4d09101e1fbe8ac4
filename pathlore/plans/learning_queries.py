"""Queries of demonstrations, goals on the way, plans, branches, vectors and device rules, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import device as dv
from pathlore.functions import lessons as ls
from pathlore.functions import patterns as p
from pathlore.functions import text as tx
from pathlore.operators import environment, evidence, memory, relabel, retrieval, screen, sequences, vectors
from pathlore.plans.curation_queries import QUALITY, _quoted, _types
from pathlore.plans.derived import PHRASES, REFLECTIONS, phrase, reflections, sql_list, sql_phrase
from pathlore.plans.evidence_queries import _TERMS, USAGE, _usage
from pathlore.plans.registry import register
from pathlore.session import table

KIND = "CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'key' WHEN 'signup' THEN 'type' ELSE event_type END"
DEMO = f"""de AS (SELECT user_id, event_id, event_type, {KIND} AS kind, row_number() OVER w - 1 AS idx, epoch_us(ts) AS us, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS delay FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
dm AS (SELECT user_id, count(*) AS n, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'type') AS types, count(*) FILTER (kind = 'key') AS keys, count(DISTINCT kind) AS kinds, avg(delay) AS mean, max(delay) AS most, (max(us) - min(us)) / 1e9 AS seconds, arg_max(event_type, idx) <> 'error' AS good FROM de GROUP BY 1)"""


def _demo_steps(spark, sf_dir):
    t = F.col("event_type")
    kind = F.when(t == "view", "key").when(t == "signup", "type").otherwise(t)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts", kind.alias("kind"), us.alias("us"))
    return sequences.indexed(e.withColumn("delay", (F.col("us") - F.lag("us").over(w)) / 1e6), "user_id", "ts", "event_id")


def _demos(spark, sf_dir):
    """A demonstration for each user; its seconds are a thousandth of the true ones, so that short ones are there."""
    n = lambda k: F.count_if(F.col("kind") == k)
    d = _demo_steps(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), n("click").alias("clicks"), n("type").alias("types"), n("key").alias("keys"), F.countDistinct("kind").alias("kinds"), F.avg("delay").alias("mean"), F.max("delay").alias("most"), ((F.max("us") - F.min("us")) / 1e9).alias("seconds"), F.max_by("event_type", "idx").alias("last")
    )
    return d.withColumn("good", F.col("last") != "error")


@register("demo_reflections", f"""WITH {DEMO} SELECT user_id, round(greatest(0, least(1, 0.5 + CASE WHEN good THEN 0.2 ELSE -0.1 END + CASE WHEN n BETWEEN 3 AND 20 THEN 0.15 WHEN n > 50 THEN -0.1 ELSE 0 END + CASE WHEN seconds BETWEEN 2 AND 60 THEN 0.15 WHEN seconds > 120 THEN -0.1 ELSE 0 END + CASE WHEN kinds >= 2 THEN 0.1 ELSE 0 END)), 6) AS confidence,
  coalesce(CASE WHEN clicks > types + keys THEN 'mouse' WHEN keys > clicks THEN 'keyboard' WHEN types > 0 THEN 'typing' END, '') AS how, CASE WHEN most > 3 AND most > mean * 3 THEN 'waits' WHEN mean < 0.5 THEN 'rapid' ELSE '' END AS waits, good FROM dm""")
def demo_reflections(spark, sf_dir):
    """Demonstrations as reflections: confidence, and what their lessons say."""
    d = _demos(spark, sf_dir)
    lessons = relabel.demo_lessons(*[F.col(c) for c in ("clicks", "types", "keys", "mean", "most", "good", "n", "seconds")])
    says = lambda word, name: F.when(F.exists("l", lambda x: F.contains(x, F.lit(word))), name)
    own = d.withColumn("l", lessons)
    how = F.coalesce(says("mouse clicks", "mouse"), says("keyboard shortcuts", "keyboard"), says("keyboard typing", "typing"), F.lit(""))
    waits = F.coalesce(says("requires waiting", "waits"), says("Rapid", "rapid"), F.lit(""))
    return own.select("user_id", F.round(relabel.demo_confidence(F.col("good"), F.col("n"), F.col("seconds"), F.col("kinds")), 6).alias("confidence"), how.alias("how"), waits.alias("waits"), says("completed successfully", "x").isNotNull().alias("good"))


@register("demo_strategies", f"WITH {DEMO}, f AS (SELECT user_id, string_agg(kind, ' -> ' ORDER BY idx) AS first FROM de WHERE idx < 5 GROUP BY 1) SELECT user_id, 'Action sequence: ' || first || CASE user_id % 3 WHEN 0 THEN '|Used semantic target identification (element labels)' WHEN 1 THEN '|Used coordinate-based targeting' ELSE '' END AS strategies FROM f JOIN dm USING (user_id) WHERE good")
def demo_strategies(spark, sf_dir):
    """What successful demonstrations did (a third aimed at names, a third at places)."""
    first = _demo_steps(spark, sf_dir).where("idx < 5").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "kind"))), lambda x: x.kind).alias("kinds"))
    own = first.join(_demos(spark, sf_dir).where("good").select("user_id"), "user_id")
    u = F.col("user_id") % 3
    return own.select("user_id", F.array_join(relabel.strategies(F.col("kinds"), u == 1, u == 0), "|").alias("strategies"))


@register("reached_goals", f"""WITH {DEMO}, f AS (SELECT user_id FROM dm WHERE NOT good), c AS (SELECT d.user_id, d.idx, d.event_id FROM de d JOIN f USING (user_id) WHERE event_type = 'purchase'),
x AS (SELECT user_id, kind, min(idx) AS f FROM de GROUP BY 1, 2), n AS (SELECT c.user_id, c.idx, count(*) AS distinct_kinds, list(x.kind ORDER BY x.f)[1:3] AS names FROM c JOIN x ON x.user_id = c.user_id AND x.f <= c.idx GROUP BY 1, 2),
g AS (SELECT c.*, coalesce(CASE WHEN event_id % 3 = 0 THEN nullif({sql_phrase('event_id')}, '') END, CASE WHEN event_id % 2 = 0 THEN 'comment' END, 'purchase') AS goal FROM c)
SELECT user_id, idx + 1 AS steps, goal, {_types('goal', p.GOAL_TYPES, p.OTHER_INTERACTION)} AS goal_type, array_to_string(list_filter([CASE WHEN distinct_kinds = 1 THEN 'Single action type (' || names[1] || ') sufficient for this sub-goal' ELSE 'Multi-step procedure: ' || array_to_string(names, ', ') END,
  CASE WHEN idx + 1 <= 3 THEN 'Efficient completion: ' || (idx + 1) || ' actions' WHEN idx + 1 > 10 THEN 'Complex sub-goal requiring ' || (idx + 1) || ' actions' END, 'Successfully achieved: ' || goal], lambda l: l IS NOT NULL), '|') AS lessons FROM g JOIN n USING (user_id, idx)""")
def reached_goals(spark, sf_dir):
    """What failed runs reached on the way: each checkpoint as a goal of its own, with lessons of the steps up to it."""
    s = _demo_steps(spark, sf_dir)
    failed = _demos(spark, sf_dir).where("not good").select("user_id")
    reached = sequences.prefixes(s, "user_id", F.col("event_type") == "purchase", F.col("kind")).join(failed, "user_id", "left_semi")
    i = F.col("event_id")
    goals = s.where("event_type = 'purchase'").select("user_id", "idx", relabel.sub_goal(F.when(i % 3 == 0, phrase(i)), F.when(i % 2 == 0, "comment"), F.lit("purchase")).alias("goal"))
    own = reached.join(goals, ["user_id", "idx"])
    lessons = relabel.prefix_lessons(F.col("names"), F.col("distinct_names"), F.col("steps"), F.col("goal"))
    return own.select("user_id", "steps", "goal", ls.goal_type(F.col("goal")).alias("goal_type"), F.array_join(lessons, "|").alias("lessons"))


@register("failed_run_stats", f"WITH {DEMO}, f AS (SELECT user_id FROM dm WHERE NOT good), c AS (SELECT d.user_id FROM de d JOIN f USING (user_id) WHERE event_type = 'purchase') SELECT (SELECT count(*) FROM dm) AS processed, (SELECT count(*) FROM f) AS failed, (SELECT count(*) FROM c) AS reflections, (SELECT count(DISTINCT user_id) FROM c) AS helped")
def failed_run_stats(spark, sf_dir):
    """How many runs were looked at, failed, gave reflections, and how many of these there are."""
    runs = _demos(spark, sf_dir).select("user_id", "good")
    goals = _demo_steps(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("goals"))
    own = runs.join(goals, "user_id", "left")
    bad = ~F.col("good")
    return own.agg(F.count("*").alias("processed"), F.count_if(bad).alias("failed"), F.coalesce(F.sum(F.when(bad, F.col("goals"))), F.lit(0)).alias("reflections"), F.count_if(bad & (F.col("goals") > 0)).alias("helped"))


@register("checkpoint_lessons", f"WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) SELECT c.user_id, c.idx AS node, b.event_id AS branch, b.idx AS base, {sql_phrase('b.event_id')} AS lesson FROM s c JOIN s b ON b.user_id = c.user_id AND abs(b.idx - c.idx) <= 3 WHERE c.event_type = 'purchase' AND b.event_type = 'error' AND {sql_phrase('b.event_id')} IS NOT NULL")
def checkpoint_lessons(spark, sf_dir):
    """Lessons of failed branches (from errors) for each checkpoint (purchase) that they begin near to."""
    e = sequences.indexed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id")
    checkpoints = e.where("event_type = 'purchase'").select("user_id", F.col("idx").alias("node"))
    branches = e.where("event_type = 'error'").select("user_id", F.col("event_id").alias("branch"), F.col("idx").alias("base"), F.lit("failed").alias("status"), phrase(F.col("event_id")).alias("lesson"))
    return memory.checkpoint_lessons(branches, checkpoints, "user_id")


@register("merged_steps", "SELECT event_id, event_type AS kind, CASE WHEN event_id % 3 = 0 THEN 'target ' || event_id % 5 END AS target, CASE WHEN event_id % 3 = 0 THEN round(event_id % 10 / 10.0, 6) END AS semantic_confidence, CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS semantic_at FROM events")
def merged_steps(spark, sf_dir):
    """Steps with the semantic targets of every third laid over them."""
    i = F.col("event_id")
    semantic = F.when(i % 3 == 0, F.struct(F.concat(F.lit("target "), i % 5).alias("target"), F.round(i % 10 / 10, 6).alias("confidence"), (i * 2).alias("captured_at")))
    step = screen.with_target(F.struct("event_id", F.col("event_type").alias("kind")), semantic)
    return table(spark, sf_dir, "events").select(step.alias("s")).select("s.*")


@register("probed_step", "WITH s AS (SELECT event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS idx FROM events WHERE user_id = (SELECT min(user_id) FROM events)), b AS (SELECT min(idx) AS bad, (SELECT max(idx) FROM s) AS last FROM s WHERE event_type = 'error') SELECT bad AS step, CASE WHEN bad = 0 THEN 'low' WHEN bad IS NULL THEN 'none' ELSE 'high' END AS confidence FROM b")
def probed_step(spark, sf_dir):
    """The first task's first step from which on something is wrong, by probes of a judge, each a look at the table."""
    e = table(spark, sf_dir, "events")
    own = sequences.indexed(e.where(F.col("user_id") == e.agg(F.min("user_id")).first()[0]).select("user_id", "event_type", "ts", "event_id"), "user_id", "ts", "event_id").persist()
    wrong = lambda step: not own.where((F.col("idx") <= step) & (F.col("event_type") == "error")).isEmpty()
    step, _, sure = sequences.bisect_probes(0, own.count() - 1, wrong)
    own.unpersist()
    return spark.createDataFrame([(step, sure)], "step long, confidence string")


@register("inferred_goals", f"WITH s AS (SELECT event_id AS id, {sql_phrase('event_id')} AS action FROM events) SELECT id, 'app_launch' AS goal_type FROM s WHERE regexp_matches(action, {_quoted(p.LAUNCHES)}, 'i') UNION ALL SELECT id, 'web_navigation' FROM s WHERE regexp_matches(action, {_quoted(p.NAVIGATIONS)}, 'i')")
def inferred_goals(spark, sf_dir):
    s = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), phrase(F.col("event_id")).alias("action"))
    return relabel.inferred_goals(s, "action").select("id", "goal_type")


ACT = ["left_click", "right_click", "type", "key", "bash", "double_click", "screenshot"]
KEYS = ["cmd+n", "cmd+t", "cmd+space", "a", "return", "cmd+o", "cmd+shift+n"]
ACTED = f"""ac AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type = 'purchase' AS cp, CASE WHEN event_id % 10 <> 0 THEN ({sql_list(ACT)})[event_id % 7 + 1] END AS type, event_id % 50 AS y,
  CASE event_id % 7 WHEN 2 THEN {sql_phrase('event_id')} WHEN 3 THEN ({sql_list(KEYS)})[event_id // 7 % 7 + 1] END AS text, CASE WHEN event_id % 21 = 4 THEN 'open -a X' WHEN event_id % 7 = 4 THEN 'ls' END AS command FROM events)"""


def _acted(spark, sf_dir):
    i = F.col("event_id")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    own = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", (F.col("event_type") == "purchase").alias("checkpoint"), F.when(i % 10 != 0, pick(ACT, i % 7)).alias("type"), (i % 50).alias("y"), F.when(i % 7 == 2, phrase(i)).when(i % 7 == 3, pick(KEYS, F.floor(i / 7) % 7)).alias("text"), F.when(i % 21 == 4, "open -a X").when(i % 7 == 4, "ls").alias("command")
    )
    return sequences.indexed(own, "user_id", "ts", "event_id")


@register("ways_back", f"""WITH {ACTED}, l AS (SELECT *, max(idx) FILTER (cp) OVER (PARTITION BY user_id) AS last_cp, lower(coalesce(text, '')) AS t FROM ac), s AS (SELECT * FROM l WHERE idx > last_cp AND type IS NOT NULL),
k AS (SELECT *, type = 'key' AND (contains(t, 'cmd+n') OR contains(t, 'cmd+shift+n')) AS win, type = 'key' AND NOT (contains(t, 'cmd+n') OR contains(t, 'cmd+shift+n')) AND contains(t, 'cmd+t') AS tab FROM s),
d AS (SELECT *, type = 'key' AND NOT win AND NOT tab AND (contains(t, 'cmd+space') OR contains(t, 'cmd+o')) AS dialog FROM k),
n AS (SELECT user_id, count(*) AS actions, sum(dialog::INT + (type IN ('left_click', 'right_click', 'double_click') AND y < 30)::INT + (type = 'right_click')::INT) AS menus, sum(CASE WHEN type = 'type' THEN greatest(1, ceil(length(t) / 20.0)) WHEN type = 'key' AND NOT win AND NOT tab AND NOT dialog AND length(t) = 1 THEN 1 ELSE 0 END) AS typed, count(*) FILTER (win OR tab) AS opened, max((type = 'bash' AND contains(coalesce(command, ''), 'open '))::INT) AS app FROM d GROUP BY 1),
c AS (SELECT *, least(menus, 3) + least(typed, 10) * 2 + opened * 3 + app * 3 AS total FROM n)
SELECT user_id, actions, CASE WHEN total = 0 THEN 2 ELSE least(menus, 3) END::BIGINT AS escapes, least(typed, 10)::BIGINT AS undos, least(opened, 5)::BIGINT AS closes, app::BIGINT AS hides, CASE WHEN total = 0 THEN 2 ELSE total END::BIGINT AS cost FROM c""")
def ways_back(spark, sf_dir):
    return relabel.way_back(_acted(spark, sf_dir), "user_id")


@register("arrivals", """WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), c AS (SELECT user_id, arg_max(event_id % 4, k) AS hash, arg_max(event_id % 3, k) AS pic FROM s WHERE event_type = 'purchase' GROUP BY 1), l AS (SELECT user_id, arg_max(event_id % 4, k) AS hash, arg_max(event_id % 3, k) AS pic FROM s GROUP BY 1)
SELECT l.user_id, CASE WHEN l.hash = c.hash THEN 'exact' WHEN l.pic = c.pic THEN 'perceptual' ELSE 'none' END AS match FROM l JOIN c USING (user_id)""")
def arrivals(spark, sf_dir):
    """Whether each task's last state is that of its last checkpoint."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    state = F.struct((F.col("event_id") % 4).alias("hash"), (F.col("event_id") % 3).alias("pic"))
    own = e.groupBy("user_id").agg(F.max_by(state, order).alias("l"), F.max_by(state, F.when(F.col("event_type") == "purchase", order)).alias("c"), F.count_if(F.col("event_type") == "purchase").alias("n")).where("n > 0")
    return own.select("user_id", relabel.arrival(F.col("l.hash"), F.col("l.pic"), F.col("c.hash"), F.col("c.pic")).alias("match"))


@register("branch_frames", """WITH s AS (SELECT user_id, event_type, row_number() OVER w - 1 AS idx, coalesce(count(*) FILTER (event_type IN ('error', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS branch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, branch, min(idx) AS start, max(idx) AS tip, coalesce(max(CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'succeeded' END), 'exploring') AS status FROM s GROUP BY 1, 2""")
def branch_frames(spark, sf_dir):
    """Branches of each task's steps: an error or a purchase ends one."""
    s = sequences.indexed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")
    return relabel.branch_frames(s, "user_id", F.col("event_type").isin("error", "purchase"), F.col("event_type") == "error")


@register("auto_lessons", f"""WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER w AS k, CASE WHEN event_id % 4 <> 0 THEN event_type || event_id END AS raw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), c AS (SELECT user_id, list(raw ORDER BY k) FILTER (raw IS NOT NULL) AS raws, max(k) FILTER (event_type = 'purchase') AS cp FROM s GROUP BY 1)
SELECT user_id, 'After "' || CASE WHEN cp IS NULL THEN 'initial state' ELSE 'step ' || cp END || '", tried [' || CASE WHEN len(raws) > 0 THEN array_to_string(raws[-3:], ', ') ELSE 'main' END || '] but loop detected' AS lesson FROM c""")
def auto_lessons(spark, sf_dir):
    """What a task that got stuck tried last; only its last three actions meet."""
    i = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", F.when(i % 4 != 0, F.concat("event_type", i)).alias("raw"))
    last = e.where("raw is not null").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), "raw"))), lambda x: x.raw).alias("raws"))
    k = sequences.indexed(e, "user_id", "ts", "event_id").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("idx") + 1)).alias("cp"))
    own = k.join(last, "user_id", "left").withColumn("raws", F.coalesce("raws", F.array().cast("array<string>")))
    return own.select("user_id", relabel.auto_lesson(F.concat(F.lit("step "), F.col("cp")), F.col("raws"), F.lit("main"), F.lit("loop detected")).alias("lesson"))


@register("dependency_waves", "WITH RECURSIVE w(step, wave) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey < 5 UNION ALL SELECT p_partkey, wave + 1 FROM part JOIN w ON w.step = p_partkey // 5 WHERE p_partkey >= 5 AND p_partkey % 50 <> 7) SELECT step, max(wave) AS wave FROM w GROUP BY 1")
def dependency_waves(spark, sf_dir):
    """Rounds in which steps may run: each needs the step of a fifth of its number; every fiftieth needs one that isn't there."""
    plan = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("step"))
    needs = plan.where("step >= 5").select("step", F.when(F.col("step") % 50 == 7, -1).otherwise(F.floor(F.col("step") / 5)).alias("needed"))
    return relabel.waves(plan, needs)


@register("environment_facts", f"""WITH s AS (SELECT user_id, lower({sql_phrase('event_id')}) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_type FROM events), e AS (SELECT *, regexp_extract(t, '\\b(browser|terminal|window|calendar|music|folder)\\b', 1) AS entity, coalesce(contains(lag(t) OVER (PARTITION BY user_id ORDER BY k), 'cmd'), false) AS by_keys FROM s)
SELECT entity, CASE WHEN by_keys THEN 'shortcut' ELSE event_type END AS method, count(*) AS observations, round(least(0.95, count(*) / (count(*) + 3.0)), 6) AS confidence FROM e WHERE entity <> '' GROUP BY 1, 2""")
def environment_facts(spark, sf_dir):
    """How things were reached: by a shortcut in the step before, else by the step's own kind; more observations make it surer."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.lower(phrase(F.col("event_id")))
    s = table(spark, sf_dir, "events").select("event_type", t.alias("t"), F.coalesce(F.contains(F.lag(t).over(w), F.lit("cmd")), F.lit(False)).alias("by_keys"))
    entity = F.regexp_extract("t", f"{ls.BOUNDARY}(browser|terminal|window|calendar|music|folder){ls.BOUNDARY}", 1)
    e = s.select(entity.alias("entity"), F.when(F.col("by_keys"), "shortcut").otherwise(F.col("event_type")).alias("method")).where("entity != ''")
    return e.groupBy("entity", "method").agg(F.count("*").alias("observations")).withColumn("confidence", F.round(F.least(F.lit(0.95), F.col("observations") / (F.col("observations") + 3.0)), 6))


_RUN_FACTS = """n AS (SELECT user_id AS run, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, event_id % 6 AS way,
  CASE event_id % 6 WHEN 0 THEN 'open -a "App ' || event_id % 7 || '"' WHEN 1 THEN 'open -a Notes; open "x-apple.x:com.apple.' || ['SoundSettings', 'DockPreferences', 'Wifi'][event_id // 6 % 3 + 1] || '"' WHEN 2 THEN 'key: "Command+ ' || ['Space', 'W', 'K'][event_id // 6 % 3 + 1] || '"' WHEN 3 THEN 'cmd+space' WHEN 4 THEN ['Music', 'My App!', '/tmp/x', 'Notes'][event_id // 6 % 4 + 1] ELSE 'click' END AS raw FROM events),
p AS (SELECT *, lag(raw) OVER (PARTITION BY run ORDER BY k) AS before FROM n),
f AS (SELECT run, 0 AS part, k, name AS display, regexp_replace(lower(name), '\\s+', '-', 'g') AS key, 'bash' AS method, 'open -a "' || name || '"' AS command FROM (SELECT *, CASE WHEN way = 0 THEN 'App ' || event_id % 7 ELSE 'Notes' END AS name FROM p WHERE way < 2)
  UNION ALL SELECT run, 0, k, raw, regexp_replace(regexp_replace(lower(raw), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), 'spotlight', NULL FROM p WHERE way = 4 AND before = 'cmd+space' AND NOT contains(raw, '/')
  UNION ALL SELECT run, 0, k, 'System Settings', 'system-settings', NULL, NULL FROM p WHERE way = 1
  UNION ALL SELECT DISTINCT run, 1, 0, 'Calculator', 'calculator', NULL, NULL FROM n WHERE run % 4 = 0),
r AS (SELECT key, count(DISTINCT run) AS interactions, arg_min(display, (run, part, k)) AS display FROM f GROUP BY 1), m AS (SELECT key, method, command, count(*) AS observations FROM f WHERE method IS NOT NULL GROUP BY ALL)"""


def _acting_runs(spark, sf_dir):
    """Tasks (users) as runs: what was done follows from the event's id."""
    i = F.col("event_id")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.floor(i / 6) % len(names) + 1).cast("int"))
    way = i % 6
    shell = F.when(way == 0, F.concat(F.lit('open -a "App '), i % 7, F.lit('"'))).otherwise(F.concat(F.lit('open -a Notes; open "x-apple.x:com.apple.'), pick(["SoundSettings", "DockPreferences", "Wifi"]), F.lit('"')))
    raw = F.when(way < 2, shell).when(way == 2, F.concat(F.lit('key: "Command+ '), pick(["Space", "W", "K"]), F.lit('"'))).when(way == 3, F.lit("cmd+space")).when(way == 4, pick(["Music", "My App!", "/tmp/x", "Notes"])).otherwise("click")
    kind = F.when(way < 2, "bash").when(way < 4, "key").when(way == 4, "type").otherwise("left_click")
    action = F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), raw.alias("raw"))
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", action.alias("action")).alias("n"))
    nodes = F.transform(F.array_sort(F.collect_list("n")), lambda n: F.struct(n.action.alias("action")))
    own = e.groupBy(F.col("user_id").alias("run")).agg(nodes.alias("nodes"))
    scene = F.when(F.col("run") % 4 == 0, F.array(F.lit("The Calculator is open"))).otherwise(F.array().cast("array<string>"))
    return own.select("run", F.col("run").alias("at"), F.lit("do it").alias("description"), "nodes", scene.alias("states"))


def _environment(spark, sf_dir, made, merge):
    """State after two increments: runs up to the middle one, and the others."""
    runs = _acting_runs(spark, sf_dir)
    return merge(made(runs.where("run % 2 = 0")), made(runs.where("run % 2 = 1")))


@register("environment_model", f"WITH {_RUN_FACTS} SELECT key, display, interactions, method, command, observations, round(least(0.95, observations / (observations + 3.0)), 6) AS confidence FROM r LEFT JOIN m USING (key)")
def environment_model(spark, sf_dir):
    """Applications, and how surely each way opens them, merged from two increments of runs."""
    return environment.ways(_environment(spark, sf_dir, environment.entities, environment.merged_entities))


@register("environment_settings", f"WITH {_RUN_FACTS}, c AS (SELECT DISTINCT run, ['sound', 'dock', 'wifi'][event_id // 6 % 3 + 1] AS child FROM n WHERE way = 1) SELECT 'system-settings' AS key, child, count(*) AS observations FROM c GROUP BY 2")
def environment_settings(spark, sf_dir):
    """Settings that were opened by their address, and in how many runs."""
    state = _environment(spark, sf_dir, environment.entities, environment.merged_entities)
    return state.select("key", F.explode("children").alias("child", "c")).select("key", "child", "c.observations")


@register("environment_shortcuts", f"WITH {_RUN_FACTS}, u AS (SELECT DISTINCT run, CASE WHEN way = 3 THEN 'cmd+space' ELSE 'cmd+' || ['space', 'w', 'k'][event_id // 6 % 3 + 1] END AS key FROM n WHERE way IN (2, 3)) SELECT key, CASE key WHEN 'cmd+space' THEN 'Open Spotlight (universal app/file launcher)' WHEN 'cmd+w' THEN 'Close current window/tab' ELSE 'Keyboard shortcut: ' || key END AS action, count(*) AS observations, round(least(0.95, count(*) / (count(*) + 3.0)), 6) AS confidence FROM u GROUP BY 1")
def environment_shortcuts(spark, sf_dir):
    """Shortcuts with what they do, and how surely."""
    state = _environment(spark, sf_dir, environment.shortcuts, environment.merged_shortcuts)
    return state.select("key", "action", "observations", F.round(environment.confidence(F.col("observations")), 6).alias("confidence"))


@register("predicted_memories", f"""WITH {USAGE}, ap AS (SELECT hash, memory FROM co WHERE frequency >= 3), q AS (SELECT id AS q, session, task, {_TERMS} AS terms FROM r WHERE id % 100 = 0),
h AS (SELECT q, substr(md5(regexp_replace(trim(lower(task)), '\\s+', ' ', 'g')), 1, 12) AS hash, 3.0 AS w FROM q UNION ALL SELECT q, substr(md5(t), 1, 12), 1.0 FROM (SELECT q, unnest(terms[1:5]) AS t FROM q)),
f AS (SELECT session AS memory FROM r WHERE ts >= (SELECT max(ts) FROM r) - INTERVAL 7 DAY GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10),
c AS (SELECT q, memory, w FROM h JOIN ap USING (hash) UNION ALL SELECT q, memory, 0.5 FROM q, f), s AS (SELECT q, memory, sum(w) AS score FROM c GROUP BY 1, 2)
SELECT s.q, memory, score FROM s JOIN q ON q.q = s.q WHERE memory <> q.session QUALIFY row_number() OVER (PARTITION BY s.q ORDER BY score DESC, memory) <= 15""")
def predicted_memories(spark, sf_dir):
    """The 15 memories that each message (ids divisible by 100) will likely need: those that went with it or its first terms, and the week's most used; the session's own is loaded already."""
    r = reflections(spark, sf_dir).select("id", "session", "task", "ts")
    known = _usage(spark, sf_dir).where("frequency >= 3").select("hash", "memory")
    q = r.where("id % 100 = 0").select(F.col("id").alias("q"), "session", "task")
    # messages of one text need the same memories but for the session's own: each text is scored once, and one more of its best is kept
    tasks = q.select("task").distinct()
    asked = tasks.select("task", F.explode(F.concat(F.array(F.struct(tx.query_hash(F.col("task")).alias("hash"), F.lit(3.0).alias("w"))), F.transform(F.slice(tx.topic_terms(F.col("task")), 1, 5), lambda t: F.struct(tx.query_hash(t).alias("hash"), F.lit(1.0).alias("w"))))).alias("a")).select("task", "a.*")
    week = r.crossJoin(F.broadcast(r.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 7 DAYS")
    often = week.groupBy(F.col("session").alias("memory")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "memory").limit(10).select("memory")
    some = asked.join(known, "hash").select("task", "memory", "w").unionByName(tasks.crossJoin(F.broadcast(often)).withColumn("w", F.lit(0.5)))
    best = evidence.top_per_group(some.where("memory is not null").groupBy("task", "memory").agg(F.sum("w").alias("score")), ["task"], [F.col("score").desc(), F.col("memory")], 16)
    scored = q.join(best.withColumnRenamed("task", "of"), F.col("task").eqNullSafe(F.col("of"))).where("memory != session")
    return retrieval.top(scored, "memory", "score", 15).select("q", "memory", "score")


_ADMITTED = """o AS (SELECT o_orderkey AS id, 'user ' || o_custkey % 3 AS creator, o_orderkey * 7 AS s, substr(sha256('{"schedule":{"hour":' || o_custkey % 24 || '},"action":{"kind":"' || o_orderpriority || '","customer":' || o_custkey % 40 || '}}'), 1, 16) AS sig FROM orders),
x AS (SELECT *, row_number() OVER (ORDER BY s, id) AS k FROM o),
r AS (SELECT 0::BIGINT AS k, []::STRUCT(c VARCHAR, s BIGINT, sig VARCHAR, k BIGINT)[] AS made
  UNION ALL SELECT x.k, CASE WHEN len(list_filter(made, lambda m: m.c = x.creator AND m.s > x.s - 3600)) >= 50 OR len(list_filter(made, lambda m: m.sig = x.sig)) > 0 THEN made ELSE list_append(made, {'c': x.creator, 's': x.s, 'sig': x.sig, 'k': x.k}) END
  FROM r JOIN x ON x.k = r.k + 1 WHERE len(made) < 200),
l AS (SELECT made FROM r ORDER BY k DESC LIMIT 1)
SELECT id, sig AS signature, CASE WHEN len(list_filter(made, lambda m: m.k < x.k AND m.c = x.creator AND m.s > x.s - 3600)) >= 50 THEN 'rate_limit' WHEN len(list_filter(made, lambda m: m.k < x.k)) >= 200 THEN 'full'
  WHEN len(list_filter(made, lambda m: m.k < x.k AND m.sig = x.sig)) > 0 THEN 'deduplicated' ELSE 'created' END AS outcome FROM x, l"""


@register("task_admission", "WITH RECURSIVE " + _ADMITTED)
def task_admission(spark, sf_dir):
    """What becomes of each new task: too many of its creator's in the hour, too many in all, known by its signature, or created."""
    schedule, action = F.struct((F.col("o_custkey") % 24).alias("hour")), F.struct(F.col("o_orderpriority").alias("kind"), (F.col("o_custkey") % 40).alias("customer"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("user "), F.col("o_custkey") % 3).alias("creator"), (F.col("o_orderkey") * 7).alias("s"), memory.task_signature(schedule, action).alias("signature"))
    return memory.admitted(o, "creator", "s", "signature", "id").select("id", "signature", "outcome")


@register("hashed_vectors", r"""WITH t AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS w FROM benchmark), h AS (SELECT item_id, md5(w) AS d, unnest([0, 1, 2, 3]) AS i FROM t),
b AS (SELECT item_id, ('0x' || substr(d, 8 * i + 1, 2))::INT % 384 AS place, ('0x' || substr(d, 8 * i + 3, 2))::INT % 2 * 2 - 1 AS sign FROM h), v AS (SELECT item_id, place, sum(sign) AS v FROM b GROUP BY 1, 2 HAVING sum(sign) <> 0), n AS (SELECT item_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1)
SELECT item_id, place, round(v / norm, 6) AS value FROM v JOIN n USING (item_id)""")
def hashed_vectors(spark, sf_dir):
    return vectors.hashed(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "place", F.round("value", 6).alias("value"))


@register("picture_hashes", "WITH p AS (SELECT event_id, list_transform(range(0, 72), lambda i: (event_id * (i + 7) * 31 + i * i) % 256) AS px FROM events) SELECT event_id, array_to_string(list_transform(range(0, 64), lambda i: CASE WHEN px[(i // 8 * 9 + i % 8 + 1)::INT] < px[(i // 8 * 9 + i % 8 + 2)::INT] THEN '1' ELSE '0' END), '') AS bits FROM p")
def picture_hashes(spark, sf_dir):
    """Difference hashes of grey pictures of 9 by 8 points (derived from the ids)."""
    e = F.col("event_id")
    pixels = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (e * (i + 7) * 31 + i * i) % 256)
    return table(spark, sf_dir, "events").select("event_id", pixels.alias("px")).select("event_id", vectors.difference_bits(F.col("px")).alias("bits"))


@register("first_settled", "WITH h AS (SELECT user_id, row_number() OVER w AS k, bit_count(xor(event_id % 64 * 17 % 64, lag(event_id % 64 * 17 % 64) OVER w)) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, min(k) FILTER (d <= 1) AS settled FROM h GROUP BY 1")
def first_settled(spark, sf_dir):
    """The first step of each task whose picture hash (six bits of the id here) differs from the one before in one bit or none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    h = F.col("event_id") % 64 * 17 % 64
    s = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("k"), F.bit_count(h.bitwiseXOR(F.lag(h).over(w))).alias("d"))
    return s.groupBy("user_id").agg(F.min(F.when(F.col("d") <= 1, F.col("k"))).cast("long").alias("settled"))


@register("targeted_pipeline", f"""WITH {QUALITY}, v AS (SELECT id, kind, array_to_string(lessons, ' ') AS text, round((specificity + actionability + coherence + novelty) / 4, 9) >= 0.6 AS good FROM q), known AS (SELECT DISTINCT text FROM v WHERE kind = 'click')
SELECT kind AS strategy, count(*) AS generated, count(*) FILTER (good) AS validated, count(*) FILTER (good AND text NOT IN (SELECT text FROM known)) AS kept FROM v WHERE kind IN ('error', 'purchase', 'view') GROUP BY 1""")
def targeted_pipeline(spark, sf_dir):
    """Generated reflections (all but clicks, which are the real ones) by strategy: how many pass the gate, and how many of those aren't known."""
    r = reflections(spark, sf_dir)
    good = F.round(ls.quality(F.col("lessons"), F.col("outcome"), F.col("failures"), F.col("strategies")).quality, 9) >= 0.6
    v = r.select("kind", F.array_join("lessons", " ").alias("text"), good.alias("good")).where("kind in ('error', 'purchase', 'view', 'click')")
    known = v.where("kind = 'click'").select("text").distinct().withColumn("known", F.lit(True))
    own = v.where("kind != 'click'").groupBy("kind", "text", "good").agg(F.count("*").alias("n")).join(known, "text", "left")
    n = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return own.groupBy(F.col("kind").alias("strategy")).agg(F.sum("n").alias("generated"), n(F.col("good")).alias("validated"), n(F.col("good") & F.col("known").isNull()).alias("kept"))


@register("variants", f"WITH {REFLECTIONS}, v AS (SELECT id, session, confidence AS d, row_number() OVER (PARTITION BY session ORDER BY id) AS n FROM r WHERE outcome = 'failure' AND id % 3 <> 2) SELECT id, CASE WHEN d < 0.4 AND d <> 0 THEN 3 WHEN d < 0.7 THEN 8 ELSE 18 END AS iterations FROM v WHERE n <= 2")
def variants(spark, sf_dir):
    """The first two variants of each failed task that aren't harder (every third id is), with the iterations to be expected."""
    v = reflections(spark, sf_dir).where("outcome = 'failure' and id % 3 != 2").select("id", "session", F.col("confidence").alias("d"))
    few = evidence.top_per_group(v, ["session"], [F.col("id")], 2)
    return few.select("id", dv.iterations(F.col("d")).alias("iterations"))


@register("transfer_stats", f"WITH {REFLECTIONS} SELECT kind, count(*) AS sources, round(count(*) / (SELECT count(*) FROM r), 6) AS share, round(avg(confidence) * 0.85, 6) AS confidence FROM r WHERE outcome = 'success' AND kind <> 'signup' GROUP BY 1")
def transfer_stats(spark, sf_dir):
    """Real successes that others may learn from, by kind; what is passed on counts .85 of their confidence."""
    r = reflections(spark, sf_dir)
    n = r.agg(F.count("*").alias("all"))
    own = r.where("outcome = 'success' and kind != 'signup'").groupBy("kind").agg(F.count("*").alias("sources"), F.avg("confidence").alias("c"))
    return own.crossJoin(F.broadcast(n)).select("kind", "sources", F.round(F.col("sources") / F.col("all"), 6).alias("share"), F.round(F.col("c") * 0.85, 6).alias("confidence"))


@register("recent_uses", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_uses(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc(), "event_id").limit(50).select("event_id", "user_id")


@register("batch_until_failure", "WITH s AS (SELECT user_id, event_type, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, count(*) AS ran, count(*) FILTER (event_type <> 'error') AS good FROM s WHERE before = 0 GROUP BY 1")
def batch_until_failure(spark, sf_dir):
    """Steps of each batch up to its first failure: the place of the first error is found without a window over a batch's steps."""
    order = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min(order).alias("first"))
    own = e.join(first, "user_id", "left").where(F.col("first").isNull() | (order <= F.col("first")))
    return own.groupBy("user_id").agg(F.count("*").alias("ran"), F.count_if(F.col("event_type") != "error").alias("good"))


@register("agent_totals", "SELECT l_returnflag AS agent, count(*) AS calls, round(sum(l_quantity), 4) AS tokens, round(sum(l_extendedprice), 2) AS cost FROM lineitem GROUP BY ROLLUP (1)")
def agent_totals(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.rollup(F.col("l_returnflag").alias("agent")).agg(F.count("*").alias("calls"), F.round(F.sum("l_quantity"), 4).alias("tokens"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@register("window_order", "SELECT o_custkey AS app, o_orderkey AS win, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS z FROM orders WHERE o_orderstatus <> 'P'")
def window_order(spark, sf_dir):
    """The windows of each application (orders of a customer) that aren't minimised, from front to back."""
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").where("o_orderstatus != 'P'").select(F.col("o_custkey").alias("app"), F.col("o_orderkey").alias("win"), F.row_number().over(w).cast("long").alias("z"))


@register("last_urls", r"WITH u AS (SELECT page_id % 10 AS log, page_id, regexp_extract_all(html, 'https?://[^\s\x22<>'']+')[-1] AS url FROM pages), c AS (SELECT *, lag(url) OVER (PARTITION BY log ORDER BY page_id) AS before FROM u WHERE url IS NOT NULL) SELECT log, page_id, url FROM c WHERE url IS DISTINCT FROM before")
def last_urls(spark, sf_dir):
    """The last address in each text of a log, where it isn't that of the text before."""
    u = table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("log"), "page_id", F.try_element_at(F.regexp_extract_all("html", F.lit(r"https?://[^\s\x22<>']+"), F.lit(0)), F.lit(-1)).alias("url")).where("url is not null")
    before = F.lag("url").over(Window.partitionBy("log").orderBy("page_id"))
    return u.withColumn("before", before).where(~F.col("url").eqNullSafe(F.col("before"))).select("log", "page_id", "url")


STATES = list(p.TRANSITIONS)


@register("illegal_transitions", f"WITH s AS (SELECT user_id, event_id, ({sql_list(STATES)})[event_id % 8 + 1] AS state, lag(({sql_list(STATES)})[event_id % 8 + 1]) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before, state, count(*) AS n FROM s WHERE before IS NOT NULL AND NOT (" + " OR ".join(f"(before = '{k}' AND state IN ({', '.join(repr(x) for x in v)}))" for k, v in p.TRANSITIONS.items()) + ") GROUP BY 1, 2")
def illegal_transitions(spark, sf_dir):
    """How often each illegal change of a tutorial's state was asked for."""
    state = F.element_at(F.array(*map(F.lit, STATES)), (F.col("event_id") % 8 + 1).cast("int"))
    s = table(spark, sf_dir, "events").select(state.alias("state"), F.lag(state).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before")).where("before is not null")
    return s.where(~dv.legal(F.col("before"), F.col("state"))).groupBy("before", "state").agg(F.count("*").alias("n"))


@register("replay_delays", "WITH d AS (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS ms FROM events) SELECT event_id, round(greatest(100, least(ms / (event_id % 3 + 1), 5000)), 3) AS ms FROM d WHERE ms IS NOT NULL")
def replay_delays(spark, sf_dir):
    """Recorded delays (a thousandth of the true ones) at one to three times the speed."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = table(spark, sf_dir, "events").select("event_id", ((us - F.lag(us).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) / 1e6).alias("ms")).where("ms is not null")
    return d.select("event_id", F.round(dv.replay_delay(F.col("ms"), F.col("event_id") % 3 + 1), 3).alias("ms"))


@register("scaled_screens", "WITH s AS (SELECT event_id, 800 + event_id % 40 * 100 AS w, 600 + event_id % 30 * 90 AS h FROM events), f AS (SELECT *, least(1.0, 1568.0 / greatest(w, h), sqrt(1150000.0 / (w * h))) AS f FROM s) SELECT event_id, round(f, 6) AS factor, floor(event_id % 700 / f + 0.5)::BIGINT AS x, floor(event_id % 900 * (w / 1440.0) + 0.5)::BIGINT AS moved FROM f")
def scaled_screens(spark, sf_dir):
    """Shrinking factors of screens, a point scaled back, and one moved to another screen."""
    e = F.col("event_id")
    s = table(spark, sf_dir, "events").select("event_id", (800 + e % 40 * 100).alias("w"), (600 + e % 30 * 90).alias("h"))
    f = dv.scale_factor(F.col("w"), F.col("h"))
    return s.select("event_id", F.round(f, 6).alias("factor"), dv.unscaled(F.array(e % 700, e % 500), f)[0].alias("x"), dv.rescaled(e % 900, F.col("w"), F.lit(1440.0)).alias("moved"))


SAYS = ["I'll click the Save button to finish", "clicking on 'Open file' now", "click the blue icon", "Let me click on it.", "nothing here", "Going to click the very long " + "x" * 70 + ", ok", "click"]


@register("click_targets", f"""WITH s AS (SELECT event_id, ({sql_list(SAYS)})[event_id % {len(SAYS)} + 1] AS t FROM events), x AS (SELECT event_id, t, {', '.join(f"trim(regexp_extract(t, {_quoted(x)}, 1, 'i')) AS c{i}" for i, x in enumerate(p.CLICK_TARGETS))} FROM s)
SELECT event_id, CASE WHEN length(t) >= 5 THEN coalesce({', '.join(f"CASE WHEN length(c{i}) BETWEEN 3 AND 59 THEN c{i} END" for i in range(3))}) END AS target FROM x""")
def click_targets(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, SAYS)), (F.col("event_id") % len(SAYS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dv.click_target(text).alias("target"))


COMMANDS = ["ls", "rm -rf /", "rm -rf /home", "mkfs.ext4 x", "dd if=a of=/dev/sdb", "echo > /dev/sda", ":{ :|:& };:"]


@register("blocked_commands", f"WITH s AS (SELECT event_id, ({sql_list(COMMANDS)})[event_id % {len(COMMANDS)} + 1] AS c FROM events) SELECT event_id, regexp_matches(regexp_replace(c, 'rm\\s+-rf\\s+/\\w', '', 'g'), 'rm\\s+-rf\\s+/') OR " + " OR ".join(f"regexp_matches(c, {_quoted(x)})" for x in p.BLOCKED_COMMANDS[1:]) + " AS blocked FROM s")
def blocked_commands(spark, sf_dir):
    c = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", dv.is_blocked(c).alias("blocked"))


@register("corrections", "WITH c AS (SELECT event_id, event_id % 5 AS n, coalesce(CASE WHEN event_id % 3 = 0 THEN 'the menu' END, CASE WHEN event_id % 2 = 0 THEN 'Click it' END, 'the highlighted element') AS t FROM events) SELECT event_id, CASE WHEN n <= 1 THEN 'Almost! Try clicking ' || t || '.' WHEN n = 2 THEN 'I''m pointing at ' || t || ' -- give it a click.' WHEN n = 3 THEN 'Look for ' || t || '. It''s highlighted in blue.' ELSE 'Take your time. ' || t || ' is right where the pointer is.' END AS says FROM c")
def corrections(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", dv.correction(F.when(e % 3 == 0, "the menu"), F.when(e % 2 == 0, "Click it"), e % 5).alias("says"))


@register("screen_context", f"""WITH n AS (SELECT p_partkey AS k, lower(p_name) AS name, p_brand AS app FROM part), m AS (SELECT *, CASE WHEN contains(name, 'red') THEN 0 ELSE 1 END AS part FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY app, part ORDER BY k) AS rn, count(*) FILTER (part = 0) OVER (PARTITION BY app) AS hits FROM m)
SELECT app, k FROM r WHERE CASE WHEN hits = 0 THEN rn <= 15 WHEN part = 0 THEN rn <= 12 ELSE rn <= 3 END""")
def screen_context(spark, sf_dir):
    """Up to 15 elements of each application's screen for a task: 12 that fit and three others, or the first 15 where none fits."""
    m = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("app"), F.when(F.contains(F.lower("p_name"), F.lit("red")), 0).otherwise(1).alias("part"))
    few = evidence.top_per_group(m, ["app", "part"], [F.col("k")], 15)
    rn = F.row_number().over(Window.partitionBy("app", "part").orderBy("k"))
    some = F.min("part").over(Window.partitionBy("app")) == 0
    keep = F.when(~F.col("some"), F.col("rn") <= 15).when(F.col("part") == 0, F.col("rn") <= 12).otherwise(F.col("rn") <= 3)
    return few.withColumn("rn", rn).withColumn("some", some).where(keep).select("app", "k")
