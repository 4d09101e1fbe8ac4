"""Queries that write and read documents, logs and memories, each beside its DuckDB SQL over the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pathlore.operators.merging import written
from pathlore.plans.derived import REFLECTIONS, phrase, reflections, sql_phrase
from pathlore.plans.registry import register
from pathlore.session import shared_folder, table
from pathlore.sources import files, memories, runs, store


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("json_round_trip", f"WITH {REFLECTIONS} SELECT id::VARCHAR AS id, task, outcome, iterations, CASE WHEN id % 4 = 0 OR confidence = 0 THEN 1.0 ELSE confidence END AS confidence, CASE WHEN id % 3 = 0 THEN 'real' ELSE kind END AS source, len(lessons) AS lessons FROM r")
def json_round_trip(spark, sf_dir):
    """Reflections written as documents and read back with their defaults."""
    i = F.col("id")
    own = reflections(spark, sf_dir).select(
        i.cast("string").alias("id"), F.col("task").alias("taskDescription"), "outcome", "iterations", F.when(i % 4 != 0, F.col("confidence")).alias("confidence"), F.when(i % 3 != 0, F.col("kind")).alias("source"), "lessons"
    )
    path = _folder(spark, "reflections")
    files.write_documents(own, path)
    r = runs.read_reflections(spark, path, many_lines=False)
    return r.select("id", F.col("taskDescription").alias("task"), "outcome", "iterations", "confidence", "source", F.size("lessons").cast("long").alias("lessons"))


@register("missing_documents", "SELECT count(*) AS n FROM events WHERE false")
def missing_documents(spark, sf_dir):
    """Documents that aren't there are an empty table."""
    return runs.read_reflections(spark, f"{sf_dir}/no-such-folder").agg(F.count("*").alias("n"))


@register("broken_documents", "SELECT count(*) FILTER (event_id % 10 <> 0) AS good, count(*) FILTER (event_id % 10 = 0) AS broken FROM events")
def broken_documents(spark, sf_dir):
    """Lines that are no documents are told from the others."""
    i = F.col("event_id")
    path = _folder(spark, "broken")
    table(spark, sf_dir, "events").select(F.when(i % 10 == 0, F.concat(F.lit('{"id": "'), i)).otherwise(F.concat(F.lit('{"id": "'), i, F.lit('"}'))).alias("value")).write.text(path)
    d = files.read_documents(spark, path, runs.REFLECTION, many_lines=False).select("id", files.BROKEN)
    return d.agg(F.count_if(F.col(files.BROKEN).isNull() & F.col("id").isNotNull()).alias("good"), F.count_if(F.col(files.BROKEN).isNotNull()).alias("broken"))


LOG = "ts TIMESTAMP_NTZ, task STRING, id BIGINT"


@register("log_tail", "SELECT event_id AS id, event_type AS task FROM events ORDER BY ts DESC LIMIT 50")
def log_tail(spark, sf_dir):
    """The newest 50 rows of a log that two writers appended to."""
    path = _folder(spark, "log")
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("task"), F.col("event_id").alias("id"))
    for part in (0, 1):
        files.append_log(e.where(F.col("id") % 2 == part), path)
    return files.tail_log(spark, path, LOG, "ts").select("id", "task")


@register("rotated_log", "SELECT 0::BIGINT AS open, count(*) AS aside FROM events")
def rotated_log(spark, sf_dir):
    """A log moved aside twice on one day: it is empty then, and its rows are in the day's copy."""
    path = _folder(spark, "queue")
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("task"), F.col("event_id").alias("id"))
    aside = path
    for part in (0, 1):
        files.append_log(e.where(F.col("id") % 2 == part), path)
        aside = files.rotate_log(spark, path, "2024-01-01")
    read = lambda p: files.read_documents(spark, p, LOG, many_lines=False).agg(F.count("*").alias("n"))
    return read(path).select(F.col("n").alias("open")).crossJoin(read(aside).select(F.col("n").alias("aside")))


def _runs(spark, sf_dir):
    """A run for each user: its events are the steps, its purchases the checkpoints, and a branch ends with each error."""
    i = F.col("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    none = F.array().cast("array<string>")
    flags = F.when(i % 7 == 0, F.array(F.lit("loop"))).when(F.col("event_type") == "purchase", F.array(F.lit("checkpoint"))).otherwise(none)
    action = F.when(i % 5 != 0, F.struct(F.col("event_type").alias("type"), F.lit(None).cast("array<bigint>").alias("coordinates"), phrase(i).alias("text"), F.lit(None).cast("string").alias("command"), F.concat_ws(" ", "event_type", phrase(i)).alias("raw")))
    e = table(spark, sf_dir, "events").select("user_id", i.alias("id"), ms.alias("ms"), "ts", "event_type", flags.alias("flags"), action.alias("action"), F.when(i % 3 == 0, phrase(i + 1)).alias("state"), F.when(i % 4 == 0, F.struct((i % 10 / 10).alias("score"), F.lit("seen").alias("observed"))).alias("surprise"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "ms", "event_type", "flags", "action", "state", "surprise"))).alias("s"))
    kinds = dict(spark.createDataFrame([], runs.RUN).dtypes)
    node = F.transform(
        "s",
        lambda x, k: F.struct(F.concat(F.lit("n"), k).alias("id"), k.cast("long").alias("index"), x.ms.alias("timestamp"), (x.ms - F.col("s")[0].ms).alias("relativeTime"), F.concat(F.lit("/a/b/"), k, F.lit(".png")).alias("screenshotPath"), x.action.alias("action"), x.flags.alias("flags"), x.surprise.alias("surprise"), x.state.alias("semanticState")),
    )
    # named fields find their places by way of JSON, as they do when a run is recorded
    as_kind = lambda c, name: F.from_json(F.to_json(c), kinds[name])
    cp = F.filter(F.transform("s", lambda x, k: F.when(x.event_type == "purchase", F.struct(k.cast("long").alias("nodeIndex"), k.cast("long").alias("stepNumber"), F.concat(F.lit("done "), k).alias("description")))), lambda c: c.isNotNull())
    br = F.filter(F.transform("s", lambda x, k: F.when(x.event_type.isin("error", "purchase"), F.struct(k.cast("long").alias("index"), F.when(x.event_type == "error", "failed").otherwise("succeeded").alias("status"), phrase(x.id).alias("approach"), F.concat(F.lit("lesson "), x.id).alias("lesson")))), lambda c: c.isNotNull())
    return rows.select(
        F.col("user_id").cast("string").alias("taskId"),
        phrase(F.col("user_id")).alias("taskDescription"),
        F.col("s")[0].ms.alias("startTime"),
        (F.element_at("s", -1).ms - F.col("s")[0].ms).alias("duration"),
        (F.element_at("s", -1).event_type != "error").alias("success"),
        F.size("s").cast("long").alias("totalSteps"),
        as_kind(node, "nodes").alias("nodes"),
        as_kind(cp, "checkpoints").alias("checkpoints"),
        as_kind(br, "branches").alias("branches"),
    )


STEPS = f"""e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS k, CASE WHEN event_id % 7 = 0 THEN 'loop' WHEN event_type = 'purchase' THEN 'checkpoint' END AS flag,
  CASE WHEN event_id % 5 <> 0 THEN event_type || ' ' || {sql_phrase('event_id')} END AS raw, CASE WHEN event_id % 3 = 0 THEN nullif({sql_phrase('event_id + 1')}, '') END AS state, event_id % 10 / 10.0 AS score, ts FROM events)"""


def _recorded(spark, sf_dir):
    path = _folder(spark, "runs")
    runs.save_runs(_runs(spark, sf_dir), path)
    # one document a line here, so that a folder of parts is written; a file of its own for each run reads in the same way
    return files.good(files.read_documents(spark, path, runs.RUN + ", narrative ARRAY<STRUCT<step: BIGINT, state: STRING, action: STRING, flags: ARRAY<STRING>, surprise: STRUCT<score: DOUBLE, reason: STRING>, expectation: STRING>>", many_lines=False))


@register("run_summaries", f"WITH {STEPS} SELECT user_id::VARCHAR AS task, min(ms) AS started, max(ms) - min(ms) AS duration, count(*) AS steps, arg_max(event_type, k) <> 'error' AS success, count(*) FILTER (event_type IN ('error', 'purchase')) AS branches, count(*) FILTER (event_type = 'error') AS failed FROM e GROUP BY 1")
def run_summaries(spark, sf_dir):
    s = runs.summaries(_recorded(spark, sf_dir))
    return s.select(F.col("taskId").alias("task"), F.col("startTime").alias("started"), "duration", F.col("totalSteps").alias("steps"), "success", F.col("branches").cast("long").alias("branches"), F.col("failedBranches").cast("long").alias("failed"))


@register("one_run", f"WITH {STEPS} SELECT k AS idx, raw, coalesce(flag, '') AS flags FROM e WHERE user_id = 3")
def one_run(spark, sf_dir):
    """The steps of one task's run."""
    s = runs.steps(runs.load_run(_recorded(spark, sf_dir), "3"))
    return s.select("idx", "action.raw", F.array_join("flags", ",").alias("flags"))


@register("narratives", f"WITH {STEPS} SELECT user_id::VARCHAR AS task, count(*) FILTER (raw IS NOT NULL OR flag IS NOT NULL) AS entries, count(*) FILTER ((raw IS NOT NULL OR flag IS NOT NULL) AND state IS NULL) AS unknown, count(*) FILTER ((raw IS NOT NULL OR flag IS NOT NULL) AND event_id % 4 = 0 AND score > 0.5) AS surprises FROM e GROUP BY 1")
def narratives(spark, sf_dir):
    """What the runs' narratives hold."""
    n = _recorded(spark, sf_dir).select(F.col("taskId").alias("task"), "narrative")
    count = lambda f: F.size(F.filter("narrative", f)).cast("long")
    return n.select("task", F.size("narrative").cast("long").alias("entries"), count(lambda e: e.state == "unknown").alias("unknown"), count(lambda e: e.surprise.isNotNull()).alias("surprises"))


@register("rendered_runs", f"""WITH {STEPS}, l AS (SELECT user_id, string_agg('  n' || k || ' (+' || printf('%.1f', (ms - f) / 1000.0) || 's): ' || coalesce(raw, 'initial_state') || CASE WHEN flag IS NULL THEN '' ELSE ' [' || flag || ']' END, chr(10) ORDER BY k) AS t FROM (SELECT *, min(ms) OVER (PARTITION BY user_id) AS f FROM e) GROUP BY 1),
c AS (SELECT user_id, chr(10) || chr(10) || 'CHECKPOINTS:' || chr(10) || string_agg('  [' || k || ']: done ' || k, chr(10) ORDER BY k) AS t FROM e WHERE event_type = 'purchase' GROUP BY 1)
SELECT l.user_id::VARCHAR AS task, md5(regexp_replace(l.t || coalesce(c.t, ''), '\\(\\+[0-9.]+s\\)', '', 'g')) AS digest FROM l LEFT JOIN c USING (user_id)""")
def rendered_runs(spark, sf_dir):
    """Runs as text, by a digest (without the seconds, whose halves the two engines round in their own ways)."""
    return runs.rendered(_recorded(spark, sf_dir)).select(F.col("taskId").alias("task"), F.md5(F.regexp_replace("text", r"\(\+[0-9.]+s\)", "")).alias("digest"))


@register("good_approaches", f"WITH {STEPS}, c AS (SELECT user_id, count(*) AS n FROM e WHERE event_type = 'purchase' GROUP BY 1) SELECT user_id::VARCHAR AS task, {sql_phrase('event_id')} AS approach, n AS checkpoints, 'lesson ' || event_id AS lesson FROM e JOIN c USING (user_id) WHERE event_type = 'purchase'")
def good_approaches(spark, sf_dir):
    """Branches that succeeded, beside what their runs reached."""
    s = runs.successful_approaches(_recorded(spark, sf_dir), F.lit("any"))
    return s.select(F.col("taskId").alias("task"), "approach", F.size("checkpoints").cast("long").alias("checkpoints"), "lesson")


@register("action_summaries", f"""WITH a AS (SELECT event_id AS id, event_id % 4 AS k, {sql_phrase('event_id')} AS t FROM events) SELECT id, CASE k WHEN 0 THEN 'left_click' WHEN 1 THEN 'bash' WHEN 2 THEN 'open' END AS type,
  CASE k WHEN 0 THEN 'left_click (' || id % 9 || ',5)' || CASE WHEN t = '' THEN '' ELSE ': "' || substr(t, 1, 50) || '"' END WHEN 1 THEN 'bash: ' || substr(t || t || t, 1, 80) WHEN 2 THEN '{{"text":"hi"}}' END AS raw, CASE WHEN k = 1 THEN substr(t || t || t, 1, 100) END AS command FROM a""")
def action_summaries(spark, sf_dir):
    i = F.col("event_id")
    k, t = i % 4, phrase(i)
    given = F.when(k == 0, F.struct(F.lit("left_click").alias("action"), F.array(i % 9, F.lit(5).cast("long")).alias("coordinate"), t.alias("text"), F.lit(None).cast("string").alias("command")))
    given = given.when(k == 1, F.struct(F.lit(None).cast("string").alias("action"), F.lit(None).cast("array<bigint>").alias("coordinate"), F.lit(None).cast("string").alias("text"), F.concat(t, t, t).alias("command")))
    given = given.when(k == 2, F.struct(F.lit(None).cast("string").alias("action"), F.lit(None).cast("array<bigint>").alias("coordinate"), F.lit("hi").alias("text"), F.lit(None).cast("string").alias("command")))
    name = F.when(k == 0, "computer").when(k == 1, "bash").when(k == 2, "open")
    action = F.when(k < 3, F.struct(name.alias("name"), given.alias("input")))
    return table(spark, sf_dir, "events").select(i.alias("id"), action.alias("a")).select("id", runs.action_summary(F.col("a")).alias("s")).select("id", "s.*")


def _entries(spark, sf_dir):
    """A store of entries from the conversations' turns, and as many new ones from the documents."""
    c = table(spark, sf_dir, "conversations")
    kind = F.element_at(F.array(*map(F.lit, [*memories.ENTRY_TYPES, "other"])), (F.col("turn") % 9 + 1).cast("int"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), kind.alias("type"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.col("role")).alias("title"), F.col("text").alias("content"), F.array("role").alias("tags"), F.lit("chat").alias("source"), F.lit(None).cast("timestamp").alias("created"))


KINDS = "['meeting', 'call', 'voice_command', 'task', 'fact', 'preference', 'conversation', 'learning', 'other']"


@register("memory_entries", f"SELECT conv_id || '-' || turn AS id, ({KINDS})[turn % 9 + 1] AS type, CASE WHEN turn % 4 = 0 THEN 'Untitled' ELSE role END AS title, length(coalesce(text, '')) AS size, 0::BIGINT AS accesses FROM conversations WHERE turn % 9 <> 8")
def memory_entries(spark, sf_dir):
    """New entries of allowed types with their defaults."""
    return memories.new_entries(_entries(spark, sf_dir)).select("id", "type", "title", F.length("content").cast("long").alias("size"), "accesses")


@register("memory_store", f"""WITH s AS (SELECT conv_id || '-' || turn AS id, ({KINDS})[turn % 9 + 1] AS type, conv_id, turn, text FROM conversations WHERE turn % 9 <> 8),
u AS (SELECT id, type, CASE WHEN turn = 1 THEN 'changed' ELSE coalesce(text, '') END AS content, CASE WHEN turn = 0 THEN conv_id % 3 ELSE 0 END AS accesses FROM s WHERE NOT (turn = 2 AND conv_id % 2 = 0))
SELECT id, type, md5(content) AS digest, accesses::BIGINT AS accesses FROM u""")
def memory_store(spark, sf_dir):
    """A store after additions (some of them known), changes, deletions and reads."""
    store = _changed(_added(spark, sf_dir))
    conv, turn = _numbers()
    reads = store.where(turn == 0).select("id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n")).where(F.col("n") <= conv % 3)
    return memories.touched(store, reads).select("id", "type", F.md5("content").alias("digest"), "accesses")


def _numbers():
    split = F.split("id", "-")
    return split[0].cast("long"), split[1].cast("long")


def _added(spark, sf_dir):
    new = memories.new_entries(_entries(spark, sf_dir))
    return memories.add(new.where(_numbers()[0] % 2 == 0), new)


def _changed(store):
    conv, turn = _numbers()
    store = memories.update(store, store.where(turn == 1).select("id", F.lit("changed").alias("content")))
    return memories.delete(store, store.where((turn == 2) & (conv % 2 == 0)).select("id"))


@register("memory_vectors", rf"""WITH s AS (SELECT conv_id || '-' || turn AS id, conv_id, turn, text FROM conversations WHERE turn % 9 <> 8), u AS (SELECT id, CASE WHEN turn = 1 THEN 'changed' ELSE coalesce(text, '') END AS content FROM s WHERE NOT (turn = 2 AND conv_id % 2 = 0)),
t AS (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS w FROM u), h AS (SELECT id, md5(w) AS d, unnest([0, 1, 2, 3]) AS i FROM t),
b AS (SELECT id, ('0x' || substr(d, 8 * i + 1, 2))::INT % 384 AS place, ('0x' || substr(d, 8 * i + 3, 2))::INT % 2 * 2 - 1 AS sign FROM h), v AS (SELECT id, place, sum(sign) AS v FROM b GROUP BY 1, 2 HAVING sum(sign) <> 0), n AS (SELECT id, sqrt(sum(v * v)) AS norm FROM v GROUP BY 1)
SELECT id, place, round(v / norm, 6) AS value FROM v JOIN n USING (id)""")
def memory_vectors(spark, sf_dir):
    """The vectors beside a store: made for what was added, then brought up to changes and deletions."""
    store = written(_added(spark, sf_dir), "store")
    vectors = memories.with_vectors(written(_changed(store), "changed"), written(memories.with_vectors(store), "vectors"))
    return vectors.select("id", "place", F.round("value", 6).alias("value"))


@register("memory_counts", f"SELECT ({KINDS})[turn % 9 + 1] AS type, count(*) AS n FROM conversations WHERE turn % 9 <> 8 GROUP BY ROLLUP (1)")
def memory_counts(spark, sf_dir):
    return memories.counts(memories.new_entries(_entries(spark, sf_dir)))


@register("memory_terms", rf"""WITH s AS (SELECT conv_id || '-' || turn AS id, CASE WHEN turn % 4 = 0 THEN 'Untitled' ELSE role END || ' ' || coalesce(text, '') || ' ' || role AS t FROM conversations WHERE turn % 9 <> 8), e AS (SELECT id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(t), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)) AS term FROM s)
SELECT term, count(*) AS uses, count(DISTINCT id) AS entries FROM e GROUP BY 1""")
def memory_terms(spark, sf_dir):
    t = memories.terms(memories.new_entries(_entries(spark, sf_dir)))
    return t.groupBy("term").agg(F.sum("tf").alias("uses"), F.count("*").alias("entries"))


@register("meeting_entries", "SELECT 'meeting_' || doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'Meeting ' || lang ELSE source END AS title, md5(concat_ws(chr(10) || chr(10), CASE WHEN doc_id % 3 = 0 THEN 'Untitled Meeting' ELSE source END, CASE WHEN doc_id % 2 = 0 THEN 'short' END, nullif(substr(text, 1, 2000), ''))) AS digest FROM documents WHERE doc_id % 5 <> 0 AND lang IS NOT NULL")
def meeting_entries(spark, sf_dir):
    """Entries of meetings (documents) that aren't in the store yet: title, summary, and the beginning that an entry keeps."""
    d = table(spark, sf_dir, "documents").where("lang is not null")
    m = d.select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("title"), F.col("lang").alias("date"), F.when(F.col("doc_id") % 2 == 0, "short").otherwise("").alias("summary"), F.col("text").alias("transcript"))
    known = d.where("doc_id % 5 = 0").select(F.concat(F.lit("meeting_"), F.col("doc_id")).alias("id"))
    return memories.meeting_entries(m, known).select("id", "title", F.md5("content").alias("digest"))


@register("voice_entries", f"SELECT event_id AS id, concat_ws(chr(10), nullif({sql_phrase('event_id')}, ''), CASE WHEN event_id % 2 = 0 THEN nullif({sql_phrase('event_id + 1')}, '') END, CASE WHEN event_id % 2 = 0 THEN 'two' END, CASE WHEN event_id % 3 = 0 THEN 'ok' END) AS content FROM events")
def voice_entries(spark, sf_dir):
    i = F.col("event_id")
    content = memories.voice_content(phrase(i), F.when(i % 2 == 0, F.array(phrase(i + 1), F.lit("two"))), F.when(i % 3 == 0, "ok"))
    return table(spark, sf_dir, "events").select(i.alias("id"), content.alias("content"))


@register("memory_export", f"""WITH {REFLECTIONS}, m AS (SELECT CASE kind WHEN 'click' THEN 'semantic' WHEN 'purchase' THEN 'preference' ELSE 'episodic' END AS type, task || id AS content, id % 100 / 100.0 AS score, id % 7 AS uses FROM r), b AS (SELECT * FROM m WHERE type IN ('semantic', 'preference') ORDER BY score DESC, uses DESC, content LIMIT 100)
SELECT type, '## ' || upper(type[1]) || type[2:] || ' Memories' || chr(10) || chr(10) || string_agg(printf('- %s' || chr(10) || '  *Importance: %.2f, Accessed: %d times*' || chr(10) || chr(10), content, score, uses), '' ORDER BY score DESC, uses DESC, content) AS text FROM b GROUP BY 1""")
def memory_export(spark, sf_dir):
    """The hundred most important facts and preferences as sections of text."""
    r = reflections(spark, sf_dir)
    kind = F.when(F.col("kind") == "click", "semantic").when(F.col("kind") == "purchase", "preference").otherwise("episodic")
    m = r.select(kind.alias("memory_type"), F.concat("task", "id").alias("content"), (F.col("id") % 100 / 100).alias("importance_score"), (F.col("id") % 7).alias("access_count"))
    return memories.markdown(m, ["semantic", "preference"])


@register("context_text", f"WITH {REFLECTIONS} SELECT session, string_agg(CASE kind WHEN 'click' THEN '[FACT] ' WHEN 'purchase' THEN '[PREF] ' ELSE '[MEM] ' END || task, chr(10) ORDER BY id) AS text FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY session ORDER BY id) <= 15) GROUP BY 1")
def context_text(spark, sf_dir):
    """The first 15 memories of each session as lines of context."""
    from pathlore.operators import evidence

    kind = F.when(F.col("kind") == "click", "semantic").when(F.col("kind") == "purchase", "preference").otherwise("episodic")
    few = evidence.top_per_group(reflections(spark, sf_dir).select("session", "id", memories.context_lines(kind, F.col("task")).alias("line")), ["session"], [F.col("id")], 15)
    return few.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("x")).select("session", F.array_join(F.transform("x", lambda r: r.line), "\n").alias("text"))


@register("session_history", "SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def session_history(spark, sf_dir):
    """The 20 sessions that went furthest."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn")).orderBy(F.col("last_turn").desc(), "conv_id").limit(20)


@register("files_found", "SELECT 2::BIGINT AS logs, 3::BIGINT AS files, (SELECT count(*) FROM benchmark WHERE contains(text, 'the')) > 0 AS found")
def files_found(spark, sf_dir):
    """Files of a folder by name and by what is in them."""
    path = _folder(spark, "tree")
    items = table(spark, sf_dir, "benchmark").select(F.regexp_replace("text", r"\s+", " ").alias("value"))
    for name, part in (("a/log", items), ("b/log", items.where("contains(value, 'the')"))):
        part.coalesce(1).write.text(f"{path}/{name}")
    items.limit(0).coalesce(1).write.json(f"{path}/c")
    items.limit(1).coalesce(1).write.mode("overwrite").csv(f"{path}/c")
    logs = files.list_files(spark, path, "*.txt").agg(F.count("*").alias("logs"))
    whole = files.list_files(spark, path, "part-*").agg(F.count("*").alias("files"))
    hits = files.grep_files(spark, path, "the", "*.txt").agg((F.count("*") > 0).alias("found"))
    return logs.crossJoin(whole).crossJoin(hits)


@register("stored_messages", "SELECT turn, role, text FROM conversations WHERE conv_id = (SELECT max(conv_id) FROM conversations)")
def stored_messages(spark, sf_dir):
    """The messages of the newest session, out of a stored table in buckets of sessions."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session")
    name = f"store_{uuid.uuid4().hex}"
    own = store.Store(spark, name, f"{shared_folder(spark)}/{name}")
    own.append("messages", c)
    return own.of("messages", c.agg(F.max("session")).first()[0]).select("turn", "role", "text")
