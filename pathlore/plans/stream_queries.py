"""Queries that run as streams over a table's files until all is read, each beside the DuckDB SQL of the same result; and tools and variables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlore.functions import variables
from pathlore.functions.parsers import resolved
from pathlore.functions.patterns import INDEX_STOPS, TOPIC_STOPS
from pathlore.functions.registry import ToolRegistry
from pathlore.plans.derived import sql_list
from pathlore.plans.queries import FLAGS, step_columns
from pathlore.plans.registry import ORACLES, register
from pathlore.session import shared_folder, table
from pathlore.streaming import logs, recovery, sessions, steps, topics
from pathlore.streaming.index import IndexWriter


def _stream(spark, sf_dir, name, **options):
    """A table as a stream of its files; the path's last letter is a pattern, so that a single file will do."""
    return spark.readStream.options(**options).schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _drained(stream, mode, spark, name, key=None, path=None):
    """What a stream has put out once all that there is has been read; in update mode, of each ``key`` what the last trigger with it has put out."""
    path = path or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        run.format("parquet").option("path", f"{path}/out").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{path}/out")
    run.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/trigger={n}")).start().awaitTermination()
    out = spark.read.schema(f"{stream._jdf.schema().toDDL()}, trigger long").parquet(f"{path}/out")
    newest = out.groupBy(key).agg(F.max("trigger").alias("trigger"))
    return out.join(newest, [key, "trigger"], "left_semi").drop("trigger")


@register("stream_flags", f"WITH {FLAGS} SELECT user_id AS task, idx, stagnation, CAST(loop_at AS BIGINT) AS loop_at, loop_by FROM fl")
def stream_flags(spark, sf_dir):
    """Step flags as the steps arrive."""
    i = F.col("event_id")
    own = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("task"), "ts", i.alias("id"), F.col("event_type").alias("state"), F.when(i % 9 != 0, i % 13).alias("picture"), (i % 10 != 0).alias("acted"))
    return _drained(steps.flag_stream(own), "append", spark, "flags")


def recovery_steps(events):
    """Steps of tasks (users) with all that a monitor looks at, as in ``recovery_level``."""
    return step_columns(events).select("*", F.col("user_id").alias("task"), F.col("event_id").alias("id"), (F.col("state") == "purchase").alias("checkpoint"))


@register("stream_recovery", ORACLES["recovery_level"])
def stream_recovery(spark, sf_dir):
    """Recovery level of each task after its last step, kept up step by step."""
    rows = recovery.monitored(recovery_steps(_stream(spark, sf_dir, "events")))
    with recovery.with_store(spark):
        out = _drained(rows, "append", spark, "recovery")
    return recovery.latest(out).withColumnRenamed("task", "user_id")


@register("stream_messages", "SELECT conv_id AS session, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations QUALIFY rank <= 10")
def stream_messages(spark, sf_dir):
    """The last ten messages of each session, kept as they arrive."""
    own = _stream(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "role")
    return _drained(sessions.message_stream(own, expire_ms=None), "update", spark, "messages", "session")


def topic_messages(conversations):
    """Messages with a time: a conversation's turns are seven minutes apart."""
    at = F.col("conv_id") * 60 + F.col("turn") * 420
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + at)
    return conversations.select(F.col("conv_id").alias("session"), ts.alias("ts"), F.col("turn").alias("id"), "text")


TOPICS = r"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 3 AND NOT list_contains(" + sql_list(TOPIC_STOPS) + ", w))"


def _topics_after(known: str, terms: str, ms: str) -> str:
    """SQL: a list of topics after one message more."""
    count = "len(list_filter(" + terms + ", lambda t: t = {0}))::BIGINT"
    old = f"list_transform({known}, lambda x: {{'topic': x.topic, 'n': x.n + {count.format('x.topic')}, 'seen': CASE WHEN list_contains({terms}, x.topic) THEN {ms} ELSE x.seen END}})"
    new = f"list_transform(list_filter({terms}, lambda t, i: list_position({terms}, t) = i AND NOT list_contains(list_transform({known}, lambda x: x.topic), t)), lambda w: {{'topic': w, 'n': {count.format('w')}, 'seen': {ms}}})"
    return f"list_concat({old}, {new})"


_TRIMMED = "CASE WHEN len(topics) > 20 THEN list_transform(list_sort(list_transform(topics, lambda x, i: {'a': -x.seen, 'i': i, 'x': x})), lambda y: y.x)[1:20] ELSE topics END AS topics"
_NO_TOPICS = "[]::STRUCT(topic VARCHAR, n BIGINT, seen BIGINT)[]"


@register(
    "stream_topics",
    f"""WITH RECURSIVE m AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, (1704067200 + conv_id * 60 + turn * 420) * 1000 AS ms, {TOPICS} AS terms FROM conversations),
s AS (SELECT conv_id, k, started, n, {_TRIMMED} FROM (SELECT conv_id, k, ms AS started, 1::BIGINT AS n, {_topics_after(_NO_TOPICS, 'terms', 'ms')} AS topics FROM m WHERE k = 1)
  UNION ALL SELECT conv_id, k, started, n, {_TRIMMED} FROM (SELECT conv_id, k, CASE WHEN ends THEN ms ELSE started END AS started, CASE WHEN ends THEN 1 ELSE n + 1 END AS n, {_topics_after('known', 'terms', 'ms')} AS topics
    FROM (SELECT m.*, s.started, s.n, m.ms - s.started > 1800000 AS ends, CASE WHEN m.ms - s.started > 1800000 THEN {_NO_TOPICS} ELSE s.topics END AS known FROM s JOIN m ON m.conv_id = s.conv_id AND m.k = s.k + 1))),
e AS (SELECT *, lead(started) OVER (PARTITION BY conv_id ORDER BY k) AS next FROM s),
c AS (SELECT * FROM e WHERE next <> started OR next IS NULL AND started + 1800000 < (SELECT max(ms) FROM m) - 600000)
SELECT conv_id AS session, started, n AS messages, unnest(topics).topic AS topic, unnest(topics).n AS n, unnest(topics).seen AS seen, unnest(range(1, len(topics) + 1)) AS rank FROM c""",
)
def stream_topics(spark, sf_dir):
    """Topics of the sessions that have ended, half an hour after their start, kept up message by message."""
    rows = topics.ended_sessions(topic_messages(_stream(spark, sf_dir, "conversations")))
    with recovery.with_store(spark):
        out = _drained(rows, "append", spark, "topics")
    return out.where("topic is not null")


@register(
    "stream_urls",
    r"""WITH u AS (SELECT page_id % 10 AS log, page_id, regexp_extract_all(coalesce(html, '') || ' ' || coalesce(url, ''), 'https?://[a-z0-9.-]+')[-1] AS url FROM pages), c AS (SELECT *, lag(url) OVER (PARTITION BY log ORDER BY page_id) AS before FROM u WHERE url IS NOT NULL) SELECT log, page_id, url FROM c WHERE url IS DISTINCT FROM before""",
)
def stream_urls(spark, sf_dir):
    """The last host that each text of a log names, where it changes, as the texts come."""
    text = F.concat_ws(" ", F.coalesce("html", F.lit("")), F.coalesce("url", F.lit("")))
    parts = _stream(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("log"), F.col("page_id").alias("place"), text.alias("text"))
    return _drained(logs.changes(parts, "https?://[a-z0-9.-]+"), "append", spark, "urls").select("log", F.col("place").alias("page_id"), F.col("found").alias("url"))


@register("stream_sessions", """WITH w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER p >= INTERVAL 30 MINUTE OR lag(ts) OVER p IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW p AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM s)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTE AS ended, count(*) AS n FROM g GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT mark FROM w)""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed (the last ones are still open)."""
    own = _stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = _drained(sessions.session_stream(own, "user_id"), "append", spark, "sessions")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


@register("stream_index", r"WITH e AS (SELECT item_id::VARCHAR AS task, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2 AND NOT list_contains(" + sql_list(INDEX_STOPS) + ", w))) AS term FROM benchmark) SELECT task, term, count(*) AS tf FROM e GROUP BY 1, 2")
def stream_index(spark, sf_dir):
    """The index of terms that a stream of items leaves."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    writer = IndexWriter(path)
    own = _stream(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("task"), "text")
    own.writeStream.foreachBatch(writer).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return writer.read(spark)


@register("tool_statistics", "SELECT 'length_of' AS tool, 2 AS version, count(*) AS n, count(text) AS good FROM benchmark UNION ALL SELECT 'first_word', 1, count(*), count(nullif(split_part(text, ' ', 1), '')) FROM benchmark")
def tool_statistics(spark, sf_dir):
    """Two made tools, one of them changed, run over the items; what the log tells."""
    r = ToolRegistry()
    r.forge("Length  of", "length", F.length, {"text": "string"})
    r.forge("first word", "first word", lambda c: F.nullif(F.split_part(c, F.lit(" "), F.lit(1)), F.lit("")), {"text": "string"})
    r.forge("gone", "gone", F.upper, {"text": "string"})
    items = table(spark, sf_dir, "benchmark")
    r.run(items, "gone", "text")
    r.update("length_of", lambda c: F.length(F.trim(c)))
    r.toggle("first_word", False)
    r.toggle("first_word", True)
    r.run(r.run(items, "length_of", "text"), "first_word", "text", result="word")
    r.delete("gone")
    return r.statistics(spark)


@register(
    "tool_catalogue",
    "WITH r AS (SELECT 'length_of' AS tool, 2 AS version, count(*) AS n FROM benchmark UNION ALL SELECT 'first_word', 1, count(*) FROM benchmark) SELECT t.name, t.version, t.enabled, t.inputs, coalesce(n, 0) AS runs FROM (VALUES ('first_word', 1, true, 'text:string'), ('length_of', 2, true, 'text:string'), ('never_run', 1, false, 'a:int,b:string')) t(name, version, enabled, inputs) LEFT JOIN r ON tool = name",
)
def tool_catalogue(spark, sf_dir):
    """All made tools with their inputs, and on how many rows their present version was run."""
    r = ToolRegistry()
    r.forge("length of", "length", F.lower, {"text": "string"})
    r.forge("first word", "first word", lambda c: F.split_part(c, F.lit(" "), F.lit(1)), {"text": "string"})
    r.forge("never run", "nothing", F.concat, {"a": "int", "b": "string"})
    r.toggle("never_run", False)
    r.update("length_of", F.length)
    items = table(spark, sf_dir, "benchmark")
    r.run(items, "length_of", "text")
    r.run(items, "first_word", "text")
    inputs = F.array_join(F.transform(F.array_sort(F.map_entries("inputs")), lambda e: F.concat_ws(":", e.key, e.value)), ",")
    ran = r.statistics(spark).select(F.col("tool").alias("name"), "version", F.col("n").alias("runs"))
    return r.catalogue(spark).join(ran, ["name", "version"], "left").select("name", "version", "enabled", inputs.alias("inputs"), F.coalesce("runs", F.lit(0)).alias("runs"))


TYPED = ["mail a.b@x.org and a.b@x.org", "see https://x.org/p?q=1 on 2024-05-06", "pay $1,200.50 by 5/6/2024 or call 555-123-4567", "open ~/docs/my file or /tmp/a-b.txt", "nothing"]


def _macros(spark, sf_dir):
    i = F.col("o_orderkey")
    pick = lambda k: F.element_at(F.array(*map(F.lit, TYPED)), (k % len(TYPED) + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(i.alias("id"), F.array(pick(i), pick(i + 1), F.concat(F.lit("u"), i % 3, F.lit("@y.org"))).alias("texts"))


@register("macro_variables", f"""WITH t AS (SELECT o_orderkey AS id, unnest([0, 1, 2]) AS step, unnest([({sql_list(TYPED)})[o_orderkey % 5 + 1], ({sql_list(TYPED)})[(o_orderkey + 1) % 5 + 1], 'u' || o_orderkey % 3 || '@y.org']) AS x FROM orders),
k(kind, value, pos) AS (VALUES ('email', 'a.b@x.org', 1), ('url', 'https://x.org/p?q=1', 1), ('date_iso', '2024-05-06', 1), ('money', '$1,200.50', 1), ('date_slash', '5/6/2024', 1), ('phone', '555-123-4567', 1), ('home_path', '~/docs/my', 1), ('absolute_path', '/tmp/a-b.txt', 1))
SELECT kind, value, sum((length(x) - length(replace(x, value, ''))) // length(value))::BIGINT AS uses, count(DISTINCT id) AS macros FROM t JOIN k ON contains(x, value) GROUP BY 1, 2 UNION ALL SELECT 'email', x, count(*), count(DISTINCT id) FROM t WHERE step = 2 GROUP BY 2""")
def macro_variables(spark, sf_dir):
    """What varies in recorded procedures (orders), and how often."""
    v = variables.extracted(_macros(spark, sf_dir))
    return v.groupBy("kind", "value", "id").agg(F.count("*").alias("n")).groupBy("kind", "value").agg(F.sum("n").alias("uses"), F.count("*").alias("macros"))


@register("replayed_macros", f"SELECT o_orderkey AS id, replace(({sql_list(TYPED)})[o_orderkey % 5 + 1], 'a.b@x.org', 'new@z.org') AS first, 'u' || o_orderkey % 3 || '@y.org' AS last FROM orders")
def replayed_macros(spark, sf_dir):
    """Procedures with their values taken out and put in again, one of them replaced by a value of the user."""
    m = variables.parameterised(_macros(spark, sf_dir))
    own = F.map_filter("variables", lambda k, v: k != "a_b_email")
    values = F.map_concat(own, F.create_map(F.lit("a_b_email"), F.lit("new@z.org")))
    texts = F.transform("texts", lambda t: resolved(t, F.col("v")))
    return m.withColumn("v", values).select("id", texts.alias("t")).select("id", F.col("t")[0].alias("first"), F.col("t")[2].alias("last"))
