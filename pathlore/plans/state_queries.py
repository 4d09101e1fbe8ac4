"""Queries of scalar expressions, state kept from evidence and sequence windows, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import scalar as sc
from pathlore.functions import text as tx
from pathlore.operators import memory, retrieval
from pathlore.plans.queries import TOKENS
from pathlore.plans.registry import register
from pathlore.session import table


@register("clip_text", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE coalesce(text, '') END AS clipped FROM documents")
def clip_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sc.clip(F.col("text")).alias("clipped"))


@register("format_times", "SELECT event_id, printf('%d:%02d', event_id * 7919 // 60000, event_id * 7919 // 1000 % 60) AS clock FROM events")
def format_times(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.minutes_seconds(F.col("event_id") * 7919).alias("clock"))


@register("parse_times", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id % 60 * 1000.0 + 120000 WHEN 1 THEN event_id % 60 * 1000.0 + 3720000 ELSE 0.0 END AS ms FROM events")
def parse_times(spark, sf_dir):
    s = F.col("event_id") % 60
    clock = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("2:"), s)).when(F.col("event_id") % 3 == 1, F.concat(F.lit("1:2:"), s)).otherwise(s.cast("string"))
    return table(spark, sf_dir, "events").select("event_id", sc.clock_to_ms(clock).alias("ms"))


@register(
    "format_duration",
    """WITH x AS (SELECT event_id, (event_id % 100000) * (event_id % 100000) * 1009 // 1000 AS s FROM events)
SELECT event_id, CASE WHEN s >= 86400 THEN printf('%dd %dh', s // 86400, s // 3600 % 24) WHEN s >= 3600 THEN printf('%dh %dm', s // 3600, s // 60 % 60) WHEN s >= 60 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%ds', s) END AS duration FROM x""",
)
def format_duration(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sc.duration((F.col("event_id") % 100000) * (F.col("event_id") % 100000) * 1009).alias("duration"))


@register("subtitle_duration", "SELECT conv_id, turn, greatest(2000, least(10000, coalesce(length(text), 0) * 60)) AS ms FROM conversations")
def subtitle_duration(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", sc.subtitle_ms(F.col("text")).alias("ms"))


@register("composite_score", "SELECT event_id, round(greatest(0, least(1, 0.5 * CASE WHEN event_id % 5 = 0 THEN 0.5 ELSE value / 100 END + 0.3 * least(event_id % 9 / 5.0, 1) + 0.2 * (1 - (event_id % 4) / 4.0))), 6) AS score FROM events")
def composite_score(spark, sf_dir):
    i = F.col("event_id")
    judge = F.when(i % 5 != 0, F.col("value") / 100)
    return table(spark, sf_dir, "events").select("event_id", F.round(sc.composite(i % 9, judge, i % 4 + 1), 6).alias("score"))


@register("action_cost", "SELECT event_type, count(*) AS n, sum(CASE event_type WHEN 'click' THEN 2 WHEN 'type' THEN 3 WHEN 'key' THEN 1 WHEN 'scroll' THEN 2 WHEN 'drag' THEN 4 ELSE 3 END)::BIGINT AS cost FROM events GROUP BY 1")
def action_cost(spark, sf_dir):
    cost = sc.lookup(F.col("event_type"), sc.ACTION_COST, sc.OTHER_COST)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(cost).alias("cost"))


@register("rollout_count", "SELECT DISTINCT p_size % 4 AS level, CASE p_size % 4 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 8 ELSE 5 END AS rollouts FROM part")
def rollout_count(spark, sf_dir):
    level = F.col("p_size") % 4
    name = F.when(level == 0, "simple").when(level == 1, "medium").when(level == 2, "complex").otherwise("other")
    return table(spark, sf_dir, "part").select(level.alias("level"), sc.lookup(name, sc.ROLLOUTS, sc.OTHER_ROLLOUTS).alias("rollouts")).distinct()


@register("task_type", r"WITH t AS (SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)[1:2] AS w FROM benchmark) SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'unknown' END AS task_type FROM t")
def task_type(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", sc.two_word_type(F.col("text")).alias("task_type"))


@register("short_hash", "SELECT page_id, substr(md5(url), 1, 8) AS short, substr(sha256(url), 1, 16) AS signature FROM pages")
def short_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.substring(F.md5("url"), 1, 8).alias("short"), F.substring(F.sha2("url", 256), 1, 16).alias("signature"))


@register("match_score", f"WITH t AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark) SELECT a.item_id AS q, b.item_id, round(len(list_filter(a.t, lambda w: list_contains(b.t, w))) / len(a.t), 6) AS score FROM t a JOIN t b ON a.item_id % 100 = 0 AND len(a.t) > 0")
def match_score(spark, sf_dir):
    """Share of the words of each query item (ids divisible by 100) that each item holds."""
    t = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t"))
    q = t.where("item_id % 100 = 0 AND size(t) > 0").select(F.col("item_id").alias("q"), F.col("t").alias("u"))
    return retrieval.against_blocks(t, q, F.lit(True)).select("q", "item_id", F.round(F.size(F.filter("u", lambda w: F.array_contains("t", w))) / F.size("u"), 6).alias("score"))


@register("inverted_index", f"WITH e AS (SELECT item_id, unnest({TOKENS.format('text')}) AS word FROM benchmark) SELECT word, count(DISTINCT item_id) AS df, count(*) AS uses, min(item_id) AS first_item FROM e GROUP BY 1")
def inverted_index(spark, sf_dir):
    """Words with document and use counts; counted by (word, item) before the word's rows meet."""
    e = table(spark, sf_dir, "benchmark").select("item_id", F.explode(tx.tokens(F.col("text"))).alias("word")).groupBy("word", "item_id").agg(F.count("*").alias("tf"))
    return e.groupBy("word").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"), F.min("item_id").alias("first_item"))


@register(
    "sparse_cosine",
    f"""WITH t AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), e AS (SELECT item_id, len(t) AS n, unnest(t) AS word FROM t), c AS (SELECT item_id, n, word, count(*) AS tf FROM e GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), s AS (SELECT item_id, word, tf / n * ln((SELECT count(*) FROM benchmark) / df) AS w FROM c JOIN d USING (word)), m AS (SELECT item_id, sqrt(sum(w * w)) AS norm FROM s GROUP BY 1),
p AS (SELECT a.item_id, sum(a.w * b.w) AS dot FROM s a JOIN s b ON a.word = b.word AND b.item_id = a.item_id + 1 GROUP BY 1)
SELECT p.item_id, round(dot / (x.norm * y.norm), 6) AS cosine FROM p JOIN m x ON x.item_id = p.item_id JOIN m y ON y.item_id = p.item_id + 1 WHERE x.norm > 0 AND y.norm > 0""",
)
def sparse_cosine(spark, sf_dir):
    """Cosine of the TF-IDF vectors of each item and the next."""
    v = retrieval.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text").select("item_id", "word", "weight")
    norm = v.groupBy("item_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm")).where("norm > 0")
    after = F.col("item_id") - 1
    dot = v.join(v.select(after.alias("item_id"), "word", F.col("weight").alias("other")), ["item_id", "word"]).groupBy("item_id").agg(F.sum(F.col("weight") * F.col("other")).alias("dot"))
    return dot.join(norm, "item_id").join(norm.select(after.alias("item_id"), F.col("norm").alias("next")), "item_id").select("item_id", F.round(F.col("dot") / (F.col("norm") * F.col("next")), 6).alias("cosine"))


@register(
    "adaptive_thresholds",
    """WITH p AS (SELECT user_id, event_type, avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) AS rate FROM events GROUP BY 1, 2), a AS (SELECT count(*) AS p, avg(rate) AS m FROM p), r AS (SELECT count(*) AS r, count(DISTINCT event_type) AS t FROM events)
SELECT greatest(30, 8 * t) AS reflections_cap, greatest(20, p + CAST(ceil(2 * sqrt(p)) AS BIGINT)) AS patterns_cap, greatest(15, CAST(floor(2 * sqrt(p)) AS BIGINT)) AS strategies_cap, greatest(3, CAST(ceil(sqrt(r)) AS BIGINT)) AS graduation_occurrences, round(least(0.9, greatest(0.6, m + 0.1)), 6) AS graduation_success FROM a, r""",
)
def adaptive_thresholds(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg((F.col("event_type") != "error").cast("double")).alias("rate"))
    types = e.groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("p"), F.sum("rate").alias("s"))
    total = types.agg(F.sum("n").alias("r"), F.count("*").alias("t"), F.sum("p").alias("p"), (F.sum("s") / F.sum("p")).alias("m"))
    return total.select(*memory.thresholds(F.col("r"), F.col("t"), F.col("p"), F.col("m")))


@register("stratified_retention", "WITH k AS (SELECT greatest(2, ceil(40 / count(DISTINCT event_type))) AS k FROM events), r AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) SELECT event_type, event_id FROM r, k WHERE rn <= k ORDER BY ts DESC, event_id LIMIT 40")
def stratified_retention(spark, sf_dir):
    return memory.newest_per_type(table(spark, sf_dir, "events").select("event_type", "event_id", "ts"), "event_type", "ts", "event_id", 40).select("event_type", "event_id")


@register("graduation", "SELECT user_id, count(*) AS occurrences, round(avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN event_type <> 'error' THEN 1.0 ELSE 0.0 END) >= 0.8")
def graduation(spark, sf_dir):
    return memory.graduated(table(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", 5, 0.8).withColumn("rate", F.round("rate", 6))


@register("quiet_hours", "SELECT event_id, (hour(ts) >= 22 OR hour(ts) < 7) AS quiet FROM events")
def quiet_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", memory.quiet(F.col("ts"), 22, 7).alias("quiet"))


@register("session_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10")
def session_messages(spark, sf_dir):
    return memory.newest_messages(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", 10)


@register("once_per_day", "SELECT event_type, ts::DATE AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def once_per_day(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.min("event_id").alias("event_id"))


@register("week_frequency", "SELECT user_id, count(*) AS freq FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def week_frequency(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    recent = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where("ts >= now - INTERVAL 7 DAYS")
    return recent.groupBy("user_id").agg(F.count("*").alias("freq")).orderBy(F.col("freq").desc(), "user_id").limit(10)


@register("first_bad_step", "WITH s AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events) SELECT user_id, min(idx) FILTER (event_type = 'error') AS first_bad, count(*) AS n FROM s GROUP BY 1")
def first_bad_step(spark, sf_dir):
    """The number of steps before each task's first error, found by its place in time, without numbering a task's steps."""
    order = F.struct("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min(order).alias("first"))
    before = F.count_if(order < F.col("first"))
    return e.join(first, "user_id", "left").groupBy("user_id").agg(F.when(F.count("first") > 0, before).alias("first_bad"), F.count("*").alias("n"))


@register("segments", "WITH s AS (SELECT *, row_number() OVER w - 1 AS idx, coalesce(sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, seg, min(idx) AS first_step, max(idx) AS last_step, bool_or(event_type = 'error') AS touches_failure FROM s GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase')")
def segments(spark, sf_dir):
    """Steps after one checkpoint (purchase) up to and with the next; the open rest is left out."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = (F.col("event_type") == "purchase").cast("long")
    s = table(spark, sf_dir, "events").select("user_id", "event_type", (F.row_number().over(w) - 1).alias("idx"), F.coalesce(F.sum(done).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("seg"))
    out = s.groupBy("user_id", "seg").agg(F.min("idx").alias("first_step"), F.max("idx").alias("last_step"), F.bool_or(F.col("event_type") == "error").alias("touches_failure"), F.bool_or(F.col("event_type") == "purchase").alias("closed"))
    return out.where("closed").drop("closed")


@register("hash_distance", "WITH h AS (SELECT event_id, bit_count(xor(event_id % 1000003 * 2654435761, coalesce(lag(event_id % 1000003 * 2654435761) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0)))::INT AS distance FROM events) SELECT event_id, distance FROM h")
def hash_distance(spark, sf_dir):
    """Differing bits of each state hash (derived from the id) and the one before it; zero stands before the first."""
    h = F.col("event_id") % 1000003 * F.lit(2654435761)
    return table(spark, sf_dir, "events").select("event_id", F.bit_count(h.bitwiseXOR(F.coalesce(F.lag(h).over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0)))).alias("distance"))


@register("top_topics", "WITH t AS (SELECT user_id, event_type, count(*) / (1 + date_diff('second', max(ts), (SELECT max(ts) FROM events)) / 60.0) AS score FROM events GROUP BY 1, 2) SELECT user_id, event_type, round(score, 6) AS score FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, event_type) <= 3")
def top_topics(spark, sf_dir):
    """Topics of each session by count over one and their age in minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts")
    n = e.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("seen")).crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    age = F.unix_seconds(F.col("now").cast("timestamp")) - F.unix_seconds(F.col("seen").cast("timestamp"))
    s = n.select("user_id", "event_type", (F.col("n") / (1 + age / 60.0)).alias("score"))
    w = Window.partitionBy("user_id").orderBy(F.round("score", 9).desc(), "event_type")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("user_id", "event_type", F.round("score", 6).alias("score"))


@register("majority_vote", "SELECT l_orderkey, CASE WHEN count(*) FILTER (l_returnflag = 'N') > count(*) FILTER (l_returnflag = 'R') THEN 'KEEP' ELSE 'REVERT' END AS verdict FROM lineitem GROUP BY 1")
def majority_vote(spark, sf_dir):
    keep, revert = (F.count_if(F.col("l_returnflag") == x) for x in ("N", "R"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.when(keep > revert, "KEEP").otherwise("REVERT").alias("verdict"))


@register("memory_stats", "SELECT lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, max(n_chars) AS most_chars FROM documents GROUP BY 1")
def memory_stats(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.max("n_chars").alias("most_chars"))


@register("newest_of_type", "SELECT event_id, ts FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 16")
def newest_of_type(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'click'").select("event_id", "ts").orderBy(F.col("ts").desc(), "event_id").limit(16)
