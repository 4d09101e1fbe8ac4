"""Queries of texts taken apart, names, schedules, layouts, scenes and workflows, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import parsers as ps
from pathlore.functions import patterns as p
from pathlore.plans.curation_queries import _any, _quoted
from pathlore.plans.derived import PHRASES, phrase, sql_list, sql_phrase
from pathlore.plans.registry import register
from pathlore.session import table

_N = len(PHRASES) - 1  # the last phrase is empty


def _some(i):
    return phrase(F.pmod(i, F.lit(_N)))


def _sql_some(i: str) -> str:
    return sql_phrase(f"({i}) % {_N}")


def _agent_texts(spark, sf_dir):
    """(id, text): what an agent may have said, from an event's id; each marker is missing now and then."""
    i = F.col("event_id")
    part = lambda keep, *xs: F.when(keep, F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])).otherwise(F.lit(""))
    text = F.concat(
        part(i % 3 != 0, "PLAN:\n1. ", _some(i), "\n 2.  ", _some(i + 1), "\nDone\n"),
        part(i % 4 != 0, "CHECKPOINT [", (i % 5).cast("string"), "]:  ", _some(i + 2), " \n"),
        part(i % 6 == 0, "CHECKPOINT [9]: again\n"),
        part(i % 5 != 0, "STEP [", (i % 7).cast("string"), "] then STEP [", (i % 9).cast("string"), "]\n"),
        part(i % 7 != 0, "EXPECT: a\nEXPECT: ", _some(i + 3), "\nSCENE: ", _some(i + 4), "\n"),
        part(i % 8 == 0, "SURPRISE: 0.", (i % 10).cast("string"), " ", _some(i + 5)),
    )
    return table(spark, sf_dir, "events").select(i.alias("id"), text.alias("text"))


AGENT = f"""ag AS (SELECT event_id AS id, CASE WHEN event_id % 3 <> 0 THEN 'PLAN:' || chr(10) || '1. ' || {_sql_some('event_id')} || chr(10) || ' 2.  ' || {_sql_some('event_id + 1')} || chr(10) || 'Done' || chr(10) ELSE '' END
  || CASE WHEN event_id % 4 <> 0 THEN 'CHECKPOINT [' || event_id % 5 || ']:  ' || {_sql_some('event_id + 2')} || ' ' || chr(10) ELSE '' END || CASE WHEN event_id % 6 = 0 THEN 'CHECKPOINT [9]: again' || chr(10) ELSE '' END
  || CASE WHEN event_id % 5 <> 0 THEN 'STEP [' || event_id % 7 || '] then STEP [' || event_id % 9 || ']' || chr(10) ELSE '' END
  || CASE WHEN event_id % 7 <> 0 THEN 'EXPECT: a' || chr(10) || 'EXPECT: ' || {_sql_some('event_id + 3')} || chr(10) || 'SCENE: ' || {_sql_some('event_id + 4')} || chr(10) ELSE '' END
  || CASE WHEN event_id % 8 = 0 THEN 'SURPRISE: 0.' || event_id % 10 || ' ' || {_sql_some('event_id + 5')} ELSE '' END AS text FROM events)"""


@register("agent_markers", rf"""WITH {AGENT}, x AS (SELECT id, text, list_filter(string_split(trim(regexp_extract(text, 'PLAN:\s*\n((?:\s*\d+\..+(?:\n|$))+)', 1)), chr(10)), lambda l: regexp_matches(l, '^\s*\d+\.\s*.+')) AS plan FROM ag)
SELECT id, len(plan) AS n_plan, array_to_string(list_transform(plan, lambda l: trim(regexp_extract(l, '^\s*\d+\.\s*(.+)', 1))), '|') AS plan, array_to_string(list_transform(regexp_extract_all(text, 'CHECKPOINT\s*\[(\d+)\]:\s*(.+)', 2), lambda l: trim(l)), '|') AS checkpoints,
  array_to_string(regexp_extract_all(text, 'CHECKPOINT\s*\[(\d+)\]:\s*(.+)', 1), ',') AS numbers, regexp_extract_all(text, 'STEP\s*\[(\d+)\]', 1)[-1]::BIGINT AS step, trim(regexp_extract_all(text, 'EXPECT:\s*(.+)', 1)[-1]) AS expectation, trim(regexp_extract_all(text, 'SCENE:\s*(.+)', 1)[-1]) AS scene,
  regexp_extract_all(text, 'SURPRISE:\s*([01](?:\.\d+)?)\s+(.*)', 1)[-1]::DOUBLE AS surprise, trim(regexp_extract_all(text, 'SURPRISE:\s*([01](?:\.\d+)?)\s+(.*)', 2)[-1]) AS reason FROM x""")
def agent_markers(spark, sf_dir):
    m = _agent_texts(spark, sf_dir).select("id", ps.markers(F.col("text")).alias("m"))
    return m.select(
        "id",
        F.size("m.plan").cast("long").alias("n_plan"),
        F.array_join("m.plan.desc", "|").alias("plan"),
        F.array_join("m.checkpoints.description", "|").alias("checkpoints"),
        F.array_join(F.transform("m.checkpoints.step", lambda x: x.cast("string")), ",").alias("numbers"),
        "m.step",
        "m.expectation",
        "m.scene",
        "m.surprise",
        F.col("m.surprise_reason").alias("reason"),
    )


@register("tutorial_lines", rf"""WITH t AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'Intro' || chr(10) || 'TUTORIAL:' || chr(10) ELSE '' END || '1. ' || {_sql_some('event_id')} || ' | the menu | it opens' || chr(10) || '2) ' || {_sql_some('event_id + 1')} || '|b|c| why |pit' || chr(10) || '3. too | few' || CASE WHEN event_id % 3 = 0 THEN chr(10) || chr(10) || 'NOTES:' || chr(10) || '4. a|b|c' ELSE '' END AS text FROM events),
b AS (SELECT id, CASE WHEN regexp_matches(text, 'TUTORIAL:\s*\n') THEN regexp_extract(text, 'TUTORIAL:\s*\n([\s\S]*?)(?:\n\n[A-Z]+:|$)', 1) ELSE text END AS block FROM t), l AS (SELECT id, unnest(string_split(block, chr(10))) AS line FROM b),
f AS (SELECT id, regexp_extract(line, '^\s*(\d+)', 1)::BIGINT - 1 AS step, list_transform(string_split(regexp_extract(line, '^\s*\d+[.)]\s+(.+)$', 1), '|'), lambda x: trim(x)) AS parts FROM l WHERE regexp_matches(line, '^\s*\d+[.)]\s+.+$'))
SELECT id, step, parts[1] AS action, parts[2] AS target, parts[3] AS expected, coalesce(parts[4], '') AS why, coalesce(parts[5], '') AS pitfall FROM f WHERE len(parts) >= 3""")
def tutorial_lines(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(
        F.when(i % 2 == 0, "Intro\nTUTORIAL:\n").otherwise(""), F.lit("1. "), _some(i), F.lit(" | the menu | it opens\n2) "), _some(i + 1), F.lit("|b|c| why |pit\n3. too | few"), F.when(i % 3 == 0, "\n\nNOTES:\n4. a|b|c").otherwise("")
    )
    steps = table(spark, sf_dir, "events").select(i.alias("id"), F.explode(ps.tutorial_steps(text)).alias("s"))
    return steps.select("id", F.col("s.index").alias("step"), "s.action", "s.target", "s.expected", "s.why", "s.pitfall")


@register("video_ids", r"""WITH u AS (SELECT event_id AS id, substr(md5(event_id::VARCHAR), 1, CASE WHEN event_id % 7 = 0 THEN 10 ELSE 11 END) AS v FROM events),
t AS (SELECT id, CASE id % 5 WHEN 0 THEN v WHEN 1 THEN 'https://www.youtube.com/watch?v=' || v || '&t=1' WHEN 2 THEN 'https://youtu.be/' || v WHEN 3 THEN 'https://www.youtube.com/embed/' || v ELSE 'https://example.org/' || v END AS t FROM u)
SELECT id, CASE WHEN regexp_matches(t, '^[a-zA-Z0-9_-]{11}$') THEN t ELSE nullif(regexp_extract(t, '(?:youtube\.com/(?:[^/]+/.+/|(?:v|e(?:mbed)?)/|.*[?&]v=)|youtu\.be/)([^"&?/\s]{11})', 1, 'i'), '') END AS video FROM t""")
def video_ids(spark, sf_dir):
    i = F.col("event_id")
    v = F.substring(F.md5(i.cast("string")), F.lit(1), F.when(i % 7 == 0, 10).otherwise(11))
    t = F.when(i % 5 == 0, v).when(i % 5 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&t=1"))).when(i % 5 == 2, F.concat(F.lit("https://youtu.be/"), v)).when(i % 5 == 3, F.concat(F.lit("https://www.youtube.com/embed/"), v)).otherwise(F.concat(F.lit("https://example.org/"), v))
    return table(spark, sf_dir, "events").select(i.alias("id"), ps.video_id(t).alias("video"))


_MARKED = "'# ' || {0} || chr(10) || '**bold** *it* `code` [see](http://x.y/z) __u__ ~s~ ' || {1}"


@register("plain_texts", rf"""WITH m AS (SELECT event_id AS id, {_MARKED.format(_sql_some('event_id'), _sql_some('event_id + 1'))} AS t FROM events)
SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '`(.+?)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '(?m)^#+\s*', '', 'g'), '[*_~`]', '', 'g')) AS text FROM m""")
def plain_texts(spark, sf_dir):
    i = F.col("event_id")
    text = F.concat(F.lit("# "), _some(i), F.lit("\n**bold** *it* `code` [see](http://x.y/z) __u__ ~s~ "), _some(i + 1))
    return table(spark, sf_dir, "events").select(i.alias("id"), ps.without_markdown(text).alias("text"))


_ASKED = f"{_sql_some('event_id')} || CASE event_id % 6 WHEN 1 THEN ' debug it' WHEN 2 THEN ' build the app' WHEN 3 THEN ' multi-step' ELSE '' END"


@register("model_tiers", f"SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN 'gatekeeper' WHEN {_any(_ASKED, p.HARD_REQUESTS)} > 0 THEN 'primary' ELSE 'default' END AS tier FROM events")
def model_tiers(spark, sf_dir):
    i = F.col("event_id")
    more = F.when(i % 6 == 1, " debug it").when(i % 6 == 2, " build the app").when(i % 6 == 3, " multi-step").otherwise("")
    return table(spark, sf_dir, "events").select(i.alias("id"), ps.model_tier(F.concat(_some(i), more), F.when(i % 10 == 0, "gatekeeper")).alias("tier"))


CODE = ["return 1", "const fs = require ('fs'); fs.unlink(x)", "import x from 'y'", "eval(a) + Function(b)", "child_process.execSync('ls'); spawn(1)", "process.env.HOME + __dirname", "global.x = Buffer.alloc(9)", "process.exit(0); execFile('a'); __filename"]


def _code(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(c, {_quoted(pattern)}) THEN 'Blocked pattern detected: ' || {_quoted(pattern)} END"


@register("tool_code_errors", f"""WITH t AS (SELECT event_id AS id, ({sql_list(CODE)})[event_id % {len(CODE)} + 1] || CASE WHEN event_id % 50 = 0 THEN repeat(' ', 5000) ELSE '' END AS c FROM events)
SELECT id, array_to_string(list_filter([CASE WHEN length(c) > 5000 THEN 'Code exceeds max length: ' || length(c) || ' > 5000' END, {', '.join(_code(x) for x in p.BLOCKED_CODE)}], lambda e: e IS NOT NULL), '|') AS errors FROM t""")
def tool_code_errors(spark, sf_dir):
    i = F.col("event_id")
    code = F.concat(F.element_at(F.array(*map(F.lit, CODE)), (i % len(CODE) + 1).cast("int")), F.when(i % 50 == 0, F.repeat(F.lit(" "), F.lit(5000))).otherwise(F.lit("")))
    return table(spark, sf_dir, "events").select(i.alias("id"), F.array_join(ps.code_errors(code), "|").alias("errors"))


KINDS = ["click", "type", "key", "launch", "drag"]


def _workflows(spark, sf_dir):
    """(id, name, steps): a workflow for each order, a step for each of its lines."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 6 + 1).cast("int"))
    own = F.when(F.col("l_partkey") % 6 < 5, kind)
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("app"), F.col("l_suppkey") % 3)).alias("app"), own.alias("action"), F.when(own == "type", phrase(F.col("l_partkey"))).alias("text"), (F.col("l_linenumber") % 3 == 0).alias("waits"), (F.when(F.col("l_linenumber") == 6, -1).otherwise(F.col("l_linenumber") % 2 * 700)).alias("timeout"))
    lines = table(spark, sf_dir, "lineitem").withColumn("s", step).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("s")).alias("steps"))
    return lines.withColumn("name", F.when(F.col("id") % 20 != 0, F.concat(F.lit("flow "), F.col("id"))))


FLOWS = f"""st AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, CASE WHEN l_suppkey % 9 <> 0 THEN 'app' || l_suppkey % 3 END AS app, CASE WHEN l_partkey % 6 < 5 THEN ({sql_list(KINDS)})[l_partkey % 6 + 1] END AS action, CASE WHEN l_partkey % 6 = 1 THEN {sql_phrase('l_partkey')} END AS text, l_linenumber % 3 = 0 AS waits,
  CASE WHEN l_linenumber = 6 THEN -1 ELSE l_linenumber % 2 * 700 END AS timeout FROM lineitem)"""


@register("workflow_durations", f"""WITH {FLOWS} SELECT id, count(*) AS n_steps, (sum(500 + CASE action WHEN 'click' THEN 300 WHEN 'type' THEN 500 + 50 * length(text) WHEN 'key' THEN 200 WHEN 'launch' THEN 2000 WHEN 'drag' THEN 500 ELSE 0 END + CASE WHEN waits THEN CASE WHEN timeout = 0 THEN 5000 ELSE timeout END ELSE 0 END))::BIGINT AS ms, count(DISTINCT app) AS apps FROM st GROUP BY 1""")
def workflow_durations(spark, sf_dir):
    """Estimated time, steps and distinct applications of each workflow."""
    cost = F.transform("steps", lambda s: ps.step_cost(s.action, s.text, s.waits, s.timeout))
    total = F.aggregate(cost, F.lit(0).cast("long"), lambda a, x: a + x)
    apps = F.size(F.array_compact(F.array_distinct(F.transform("steps", lambda s: s.app))))
    return _workflows(spark, sf_dir).select("id", F.size("steps").cast("long").alias("n_steps"), total.alias("ms"), apps.cast("long").alias("apps"))


@register("workflow_errors", f"""WITH {FLOWS}, e AS (SELECT id, i, 0 AS k, 'Step ' || i || ': missing or invalid app name' AS e FROM st WHERE app IS NULL UNION ALL SELECT id, i, 1, 'Step ' || i || ': missing or invalid action' FROM st WHERE action IS NULL UNION ALL SELECT id, i, 2, 'Step ' || i || ': invalid timeout (must be positive number)' FROM st WHERE timeout < 0
  UNION ALL SELECT DISTINCT id, -1, 0, 'Workflow must have a name' FROM st WHERE id % 20 = 0) SELECT id, string_agg(e, '|' ORDER BY i, k) AS errors, count(*) AS n FROM e GROUP BY 1""")
def workflow_errors(spark, sf_dir):
    """The workflows with errors, and which they are."""
    e = _workflows(spark, sf_dir).select("id", ps.workflow_errors(F.col("name"), F.col("steps")).alias("e")).where("size(e) > 0")
    return e.select("id", F.array_join("e", "|").alias("errors"), F.size("e").cast("long").alias("n"))


@register("workflow_analysis", f"""WITH {FLOWS}, r AS (SELECT DISTINCT 'app' || s_suppkey % 3 AS app FROM supplier WHERE s_suppkey % 3 <> 1), a AS (SELECT DISTINCT id, app FROM st WHERE app IS NOT NULL), n AS (SELECT id, count(*) AS n FROM st GROUP BY 1)
SELECT n.id, count(a.app) FILTER (r.app IS NULL) AS not_running, count(r.app) AS running, any_value(n.n) > 10 AS fragile FROM n LEFT JOIN a ON a.id = n.id LEFT JOIN r ON r.app = a.app GROUP BY 1""")
def workflow_analysis(spark, sf_dir):
    """How many of a workflow's applications run (a table of those that do), and whether it is long."""
    runs = table(spark, sf_dir, "supplier").where("s_suppkey % 3 != 1").select(F.concat(F.lit("app"), F.col("s_suppkey") % 3).alias("app")).distinct()
    w = _workflows(spark, sf_dir).select("id", F.size("steps").alias("n"), F.explode_outer(F.array_compact(F.array_distinct(F.transform("steps", lambda s: s.app)))).alias("app"))
    own = w.join(runs.withColumn("up", F.lit(1)), "app", "left")
    return own.groupBy("id").agg(F.count_if(F.col("app").isNotNull() & F.col("up").isNull()).alias("not_running"), F.count("up").alias("running"), (F.max("n") > 10).alias("fragile"))


@register("layouts", """WITH c AS (SELECT DISTINCT o_orderkey % 6 AS c, o_orderkey % 5 AS k, 1000 + o_orderkey % 7 * 101 AS w FROM orders), x AS (SELECT c, k, w, 777 AS h, unnest(range(0, greatest(c, 1))) AS i FROM c),
g AS (SELECT c, k, w, i, CASE k WHEN 0 THEN CASE WHEN i = 0 THEN 0 ELSE w / 2 END WHEN 1 THEN CASE WHEN i = 0 THEN w / 2 ELSE 0 END WHEN 2 THEN CASE WHEN i % 2 = 0 THEN 0 ELSE w / 2 END WHEN 3 THEN w / 3 * i ELSE 0 END AS x,
  CASE k WHEN 2 THEN CASE WHEN i < 2 THEN 0 ELSE h / 2 END WHEN 3 THEN 0 WHEN 4 THEN h / c * i ELSE CASE WHEN i = 0 THEN 0 ELSE h / (c - 1) * (i - 1) END END AS y, CASE k WHEN 3 THEN w / 3 WHEN 4 THEN w ELSE w / 2 END AS ww, CASE k WHEN 2 THEN h / 2 WHEN 3 THEN h WHEN 4 THEN h / c ELSE CASE WHEN i = 0 THEN h ELSE h / (c - 1) END END AS hh FROM x WHERE c > 0 AND (k <> 2 OR c = 4) AND (k <> 3 OR c = 3))
SELECT c, k, w, i, floor(x + 0.5)::BIGINT AS x, floor(y + 0.5)::BIGINT AS y, floor(ww + 0.5)::BIGINT AS width, floor(hh + 0.5)::BIGINT AS height FROM g""")
def layouts(spark, sf_dir):
    """Rectangles of windows by layout, number of windows and width of the screen."""
    c = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 6).alias("c"), (F.col("o_orderkey") % 5).alias("k"), (1000 + F.col("o_orderkey") % 7 * 101).alias("w")).distinct().where("c > 0")
    kind = F.element_at(F.array(*map(F.lit, ["split-left", "split-right", "quarters", "thirds", "stack"])), (F.col("k") + 1).cast("int"))
    out = c.select("c", "k", "w", F.posexplode(ps.layout(kind, F.col("c").cast("int"), F.col("w").cast("double"), F.lit(777.0))).alias("i", "r"))
    return out.select("c", "k", "w", F.col("i").cast("long").alias("i"), "r.x", "r.y", "r.width", "r.height")


@register("grids", "WITH w AS (SELECT DISTINCT 900 + s_suppkey % 50 AS w FROM supplier) SELECT w, i, floor(w / 3.0 * (i % 3) + 0.5)::BIGINT AS x, floor(601 / 2.0 * (i // 3) + 0.5)::BIGINT AS y, floor(w / 3.0 + 0.5)::BIGINT AS width, floor(601 / 2.0 + 0.5)::BIGINT AS height FROM w, range(0, 6) r(i)")
def grids(spark, sf_dir):
    w = table(spark, sf_dir, "supplier").select((900 + F.col("s_suppkey") % 50).alias("w")).distinct()
    out = w.select("w", F.posexplode(ps.grid(2, 3, F.col("w").cast("double"), F.lit(601.0))).alias("i", "r"))
    return out.select("w", F.col("i").cast("long").alias("i"), "r.x", "r.y", "r.width", "r.height")


@register("next_runs", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN epoch(o_orderdate)::BIGINT WHEN 1 THEN 1700000000 + CASE WHEN o_orderkey % 4 = 0 THEN 60 ELSE o_orderkey % 4 * 100 END END AS next_run FROM orders")
def next_runs(spark, sf_dir):
    i = F.col("o_orderkey")
    kind = F.when(i % 3 == 0, "date").when(i % 3 == 1, "interval").otherwise("cron")
    return table(spark, sf_dir, "orders").select(i.alias("id"), ps.next_run(kind, F.unix_seconds(F.col("o_orderdate").cast("timestamp")), i % 4 * 100, F.lit(1_700_000_000).cast("long")).alias("next_run"))


ACTIONS = ["left_click", "double_click", "type", "key", "screenshot", "bash"]


@register("step_scenes", f"""WITH s AS (SELECT event_id AS i, ({sql_list(ACTIONS)})[event_id % 6 + 1] AS action, CASE event_id % 5 WHEN 0 THEN {_sql_some('event_id')} WHEN 1 THEN 'left_click at 3' END AS state, CASE WHEN event_id % 4 = 0 THEN {_sql_some('event_id + 1')} END AS cp, event_id % 3 = 0 AS has_target, CASE WHEN event_id % 6 = 0 THEN 'Finder' END AS app, CASE WHEN event_id % 7 = 0 THEN 'I will look' END AS intent, {_sql_some('event_id + 2')} AS text FROM events),
a AS (SELECT *, CASE WHEN has_target THEN CASE action WHEN 'left_click' THEN 'Clicked' WHEN 'double_click' THEN 'Double-clicked' ELSE 'Interacted with' END || ' ''OK'' (button)' || CASE WHEN app IS NULL THEN '' ELSE ' in ' || app END WHEN intent IS NOT NULL THEN intent
  WHEN action = 'key' THEN 'Pressed key: ' || text WHEN action = 'type' THEN 'Typed: "' || substr(text, 1, 50) || '"' WHEN action = 'left_click' THEN 'Clicked at (' || i % 100 || ', ' || i % 90 || ')' WHEN action = 'screenshot' THEN 'Screenshot captured' ELSE action END AS auto FROM s)
SELECT i AS id, auto, CASE WHEN state IS NOT NULL AND NOT starts_with(state, 'left_click') THEN state WHEN cp IS NOT NULL THEN '[Checkpoint] ' || cp ELSE auto END AS scene FROM a""")
def step_scenes(spark, sf_dir):
    """What each step's state is called by itself, and its scene."""
    i = F.col("event_id")
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (i % 6 + 1).cast("int"))
    target = F.when(i % 3 == 0, F.struct(F.lit("OK").alias("label"), F.lit("button").alias("role"), F.when(i % 6 == 0, "Finder").alias("app")))
    auto = ps.action_state(target, F.when(i % 7 == 0, "I will look"), action, F.lit(None).cast("string"), _some(i + 2), F.array(i % 100, i % 90))
    state = F.when(i % 5 == 0, _some(i)).when(i % 5 == 1, "left_click at 3")
    out = table(spark, sf_dir, "events").withColumn("auto", auto)
    return out.select(i.alias("id"), "auto", ps.scene(state, F.when(i % 4 == 0, _some(i + 1)), F.col("auto")).alias("scene"))


@register("kept_history", "WITH m AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS z, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn DESC) AS images FROM conversations) SELECT conv_id, turn, role = 'user' AND images > 2 AS replaced FROM m WHERE a = 1 OR z <= 40")
def kept_history(spark, sf_dir):
    """The first and the last 40 messages of each conversation; of their pictures (here users' messages) the newest two stay, others become text."""
    back = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    m = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(back).alias("z"), F.count_if(F.col("role") == "user").over(back).alias("images"))
    m = m.withColumn("first", F.min("turn").over(Window.partitionBy("conv_id")))
    return m.where("turn = first or z <= 40").select("conv_id", "turn", ((F.col("role") == "user") & (F.col("images") > 2)).alias("replaced"))


@register("macro_names", f"""WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, 'App' || l_suppkey % 4 AS app, CASE l_partkey % 3 WHEN 0 THEN 'Click ' || 'part ' || l_partkey % 10 WHEN 1 THEN 'Type "' || substr({_sql_some('l_partkey')}, 1, 20) || CASE WHEN length({_sql_some('l_partkey')}) > 20 THEN '...' ELSE '' END || '"' ELSE 'cmd+' || l_linenumber END AS act FROM lineitem),
a AS (SELECT id, app, min(i) AS f FROM s WHERE app <> 'App0' GROUP BY 1, 2), b AS (SELECT id, string_agg(app, ', ' ORDER BY f) AS apps FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY f) <= 2) GROUP BY 1), c AS (SELECT id, string_agg(act, ' > ' ORDER BY i) AS acts FROM s WHERE i <= 3 GROUP BY 1)
SELECT c.id, coalesce(apps, 'Desktop') || ': ' || acts AS name FROM c LEFT JOIN b ON b.id = c.id""")
def macro_names(spark, sf_dir):
    """Names of recorded procedures (orders) from their steps (lines)."""
    k = F.col("l_partkey")
    kind = F.when(k % 3 == 0, "click").when(k % 3 == 1, "text_input").otherwise("key_combo")
    act = ps.action_name(kind, F.concat(F.lit("part "), k % 10), _some(k), F.concat(F.lit("cmd+"), F.col("l_linenumber")))
    app = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("App"), F.col("l_suppkey") % 4))
    steps = table(spark, sf_dir, "lineitem").withColumn("s", F.struct("l_linenumber", "l_partkey", "l_suppkey", app.alias("app"), act.alias("act"))).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return steps.select("id", ps.macro_name(F.col("s.app"), F.col("s.act")).alias("name"))


@register("resolved_texts", """SELECT event_id AS id, 'Hi ' || CASE WHEN event_id % 2 = 0 THEN 'v' || event_id % 9 ELSE '{{name}}' END || ', {{none}} and ' || 'x{{name}}y' || '{{' AS text FROM events""")
def resolved_texts(spark, sf_dir):
    """Placeholders replaced by values, once: a value that looks like a placeholder stays as it is, and so does an unknown name."""
    i = F.col("event_id")
    values = F.when(i % 2 == 0, F.create_map(F.lit("name"), F.concat(F.lit("v"), i % 9), F.lit("b"), F.lit("x{{name}}y"))).otherwise(F.create_map(F.lit("b"), F.lit("x{{name}}y")))
    return table(spark, sf_dir, "events").select(i.alias("id"), ps.resolved(F.lit("Hi {{name}}, {{none}} and {{b}}{{"), values).alias("text"))


@register("chapters", "SELECT event_id AS id, coalesce(nullif(CASE WHEN event_id % 2 = 0 THEN '1:0' || event_id % 10 ELSE '' END, ''), CASE WHEN event_id % 3 = 0 THEN '2:00' END, '') AS time, coalesce(CASE WHEN event_id % 5 = 0 THEN 'title' END, CASE WHEN event_id % 7 = 0 THEN 'name' END, '') AS title FROM events")
def chapters(spark, sf_dir):
    i = F.col("event_id")
    c = ps.chapter(F.when(i % 2 == 0, F.concat(F.lit("1:0"), i % 10)).otherwise(F.lit("")), F.when(i % 3 == 0, "2:00"), F.when(i % 5 == 0, "title"), F.when(i % 7 == 0, "name"))
    return table(spark, sf_dir, "events").select(i.alias("id"), c.alias("c")).select("id", "c.time", "c.title")
