"""Queries of the reference's own operators over the driver's tables, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import text as tx
from pathlore.functions.patterns import EXPECTATION_STOPS
from pathlore.operators import coverage, retrieval, selection, sequences
from pathlore.plans.derived import phrase, sql_list, sql_phrase
from pathlore.plans.registry import register
from pathlore.session import table

EXPECT = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + sql_list(EXPECTATION_STOPS) + ", w))"
STEPS = f"""st AS (SELECT user_id, event_id, event_type AS state, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 13 END AS picture, event_id % 10 <> 0 AS acted, CASE WHEN event_id % 3 = 0 THEN {sql_phrase('event_id')} END AS expectation, lower({sql_phrase('event_id * 5 + 3')} || ' ' || event_type) AS observed,
  event_id % 17 = 0 AS navigated, CASE WHEN event_id % 19 = 0 THEN value / 60 END AS given, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"""
FLAGS = f"""{STEPS}, lo AS (SELECT a.user_id, a.idx, max(b.idx) AS loop_at, max(b.idx) FILTER (b.state = a.state) AS exact_at FROM st a JOIN st b ON b.user_id = a.user_id AND (b.state = a.state OR b.picture = a.picture) AND b.idx <= a.idx - 2
    AND b.idx >= a.idx - least(50, greatest(10, floor((a.idx + 1) * 0.6))) GROUP BY 1, 2),
f0 AS (SELECT st.*, acted AND coalesce(state = lag(state) OVER w, false) AS stagnation, loop_at, CASE WHEN loop_at IS NULL THEN NULL WHEN loop_at = exact_at THEN 'exact' ELSE 'perceptual' END AS loop_by, lag(expectation) OVER w AS before, lead(idx) OVER w IS NULL AS is_last FROM st LEFT JOIN lo USING (user_id, idx) WINDOW w AS (PARTITION BY user_id ORDER BY idx)),
k AS (SELECT *, {EXPECT.format("coalesce(before, '')")} AS kw, {EXPECT.format("observed || CASE WHEN loop_at IS NOT NULL THEN ' loop detected same screen' ELSE '' END || CASE WHEN stagnation THEN ' stagnation no change' ELSE '' END")} AS obs FROM f0),
s0 AS (SELECT *, coalesce(CASE WHEN given IS NOT NULL THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, given)) END, CASE WHEN NOT is_last AND NOT navigated AND len(kw) > 0 THEN greatest(0.0::DOUBLE, 1 - list_sum(list_transform(kw, lambda w: CASE WHEN list_contains(obs, w) THEN 1.0::DOUBLE WHEN len(list_filter(obs, lambda o: contains(o, w) OR contains(w, o))) > 0 THEN 0.5 ELSE 0 END)) / len(kw)) END) AS surprise FROM k),
fl AS (SELECT *, coalesce(surprise > 0.5, false) AS surprised FROM s0)"""
TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)"


def step_columns(events):
    """Steps of tasks (users): the event's type is the state; the other fields are derived from its id."""
    i = F.col("event_id")
    return events.select(
        "user_id",
        "event_id",
        "ts",
        F.col("event_type").alias("state"),
        F.when(i % 9 != 0, i % 13).alias("picture"),
        (i % 10 != 0).alias("acted"),
        F.when(i % 3 == 0, phrase(i)).alias("expectation"),
        F.concat_ws(" ", phrase(i * 5 + 3), "event_type").alias("observed"),
        (i % 17 == 0).alias("navigated"),
        F.when(i % 19 == 0, F.col("value") / 60).alias("given"),
    )


def _steps(spark, sf_dir):
    return sequences.indexed(step_columns(table(spark, sf_dir, "events")), "user_id", "ts", "event_id")


def _flagged(spark, sf_dir):
    flagged = sequences.flags(_steps(spark, sf_dir), "user_id", "state", "picture", F.col("acted"))
    return sequences.surprises(flagged, "user_id", "expectation", F.col("observed"), F.col("navigated"), F.col("given"))


@register("seq_flags", f"WITH {FLAGS} SELECT user_id, idx, stagnation, CAST(loop_at AS BIGINT) AS loop_at, loop_by FROM fl")
def seq_flags(spark, sf_dir):
    return sequences.flags(_steps(spark, sf_dir), "user_id", "state", "picture", F.col("acted")).select("user_id", "idx", "stagnation", "loop_at", "loop_by")


@register("seq_surprises", f"WITH {FLAGS} SELECT user_id, idx, round(surprise, 6) AS surprise, surprised FROM fl")
def seq_surprises(spark, sf_dir):
    return _flagged(spark, sf_dir).select("user_id", "idx", F.round("surprise", 6).alias("surprise"), "surprised")


@register(
    "recovery_level",
    f"""WITH {FLAGS}, n AS (SELECT *, stagnation::INT + (loop_at IS NOT NULL)::INT + surprised::INT AS issues, count(*) OVER (PARTITION BY user_id) AS n, coalesce(max(idx) FILTER (state = 'purchase') OVER (PARTITION BY user_id), -1) AS cp FROM fl),
g AS (SELECT user_id, max(n) AS n_steps, count(loop_at) AS loops, count(*) FILTER (stagnation) AS stagnations, count(*) FILTER (surprised) AS surprises,
  count(*) FILTER (issues > 0 AND idx >= n - greatest(3, floor(sqrt(n) * 2))) AS recent, (sum(CASE WHEN idx > cp THEN issues ELSE 0 END))::BIGINT AS run FROM n GROUP BY user_id),
r AS (SELECT *, (loops + surprises * 0.5 + stagnations * 0.4) / n_steps AS rate, recent / greatest(3, floor(sqrt(n_steps) * 2)) AS rr, sqrt(n_steps) AS q FROM g)
SELECT user_id, n_steps, loops, stagnations, surprises, round(rate, 6) AS issue_rate, round(rr, 6) AS recent_rate, run AS issue_run,
  CASE WHEN rr >= 0.75 OR run >= greatest(3, floor(q)) THEN 3 WHEN rate >= 0.35 OR rr >= 0.6 OR run >= greatest(2, floor(q / 2)) THEN 2
  WHEN rate >= 0.1 OR rr >= 0.25 OR run >= greatest(1, floor(q / 3)) THEN 1 ELSE 0 END AS recovery_level FROM r""",
)
def recovery_level(spark, sf_dir):
    """Recovery level of each task; a purchase is a checkpoint, which ends a run of issues."""
    return sequences.recovery(_flagged(spark, sf_dir), "user_id", F.col("state") == "purchase")


@register("coverage_hist", "SELECT coalesce(event_type, 'unknown') AS category, count(*) AS n FROM events GROUP BY 1")
def coverage_hist(spark, sf_dir):
    return coverage.histogram(table(spark, sf_dir, "events"), "event_type")


@register("coverage_gaps", "SELECT o_orderpriority AS category, count(*) AS n, 3100 - count(*) AS deficit FROM orders GROUP BY 1 HAVING count(*) < 3100")
def coverage_gaps(spark, sf_dir):
    return coverage.gaps(table(spark, sf_dir, "orders"), "o_orderpriority", 3100)


@register(
    "coverage_report",
    """WITH h AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), a AS (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS categories, count(*) FILTER (n >= 200) AS converged, min(n) AS least, max(n) AS most, round(sum(n) / count(*), 2) AS mean FROM h),
e AS (SELECT -sum(n / total * log2(n / total)) AS entropy FROM h, a), t AS (SELECT list(event_type ORDER BY n DESC, event_type)[1:5] AS top FROM h), g AS (SELECT coalesce(list(event_type ORDER BY 200 - n DESC, event_type) FILTER (n < 200), [])[1:10] AS gaps FROM h)
SELECT total, categories, converged, round(converged / categories, 3) AS convergence_rate, least, most, mean, round(entropy, 3) AS entropy, round(log2(categories), 3) AS max_entropy, round(entropy / log2(categories), 3) AS normalized, array_to_string(top, ',') AS top, array_to_string(gaps, ',') AS gaps FROM a, e, t, g""",
)
def coverage_report(spark, sf_dir):
    r = coverage.report(table(spark, sf_dir, "events"), "event_type", 200)
    return r.withColumn("top", F.array_join("top", ",")).withColumn("gaps", F.array_join("gaps", ","))


@register(
    "priorities",
    """WITH m AS (SELECT max(ts) AS now FROM events), v AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view', 'share', 'refund']) AS kind), g AS (SELECT event_type AS kind, count(*) AS n, count(*) FILTER (ts > now - INTERVAL 7 DAY) AS fresh FROM events, m GROUP BY 1),
p AS (SELECT kind, coalesce(n, 0) AS n, 2100 - coalesce(n, 0) + CASE WHEN coalesce(fresh, 0) = 0 THEN 2 ELSE 0 END + CASE WHEN coalesce(n, 0) = 0 THEN 3 ELSE 0 END AS priority FROM v LEFT JOIN g USING (kind) WHERE coalesce(n, 0) < 2100)
SELECT kind, n, priority FROM p ORDER BY priority DESC, kind LIMIT 5""",
)
def priorities(spark, sf_dir):
    """The five categories of a vocabulary that need more: by deficit, by lack of rows of the last week, and by having none at all."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts")
    now = events.agg(F.max("ts").alias("now"))
    kinds = spark.createDataFrame([(k,) for k in ("click", "error", "purchase", "signup", "view", "share", "refund")], "kind string")
    counted = events.crossJoin(F.broadcast(now)).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS")).alias("fresh"))
    return coverage.priorities(kinds.join(counted, "kind", "left").fillna(0, ["n", "fresh"]), "kind", 2100, 5)


@register(
    "stats_groupingsets",
    "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 6) AS done_rate FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))",
)
def stats_groupingsets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[], [status], [priority]], status, priority).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"), F.round(F.avg(F.when(status == "F", 1.0).otherwise(0.0)), 6).alias("done_rate"))


SOURCES = [f"src{i}" for i in range(20)]


@register("source_pivot", "SELECT lang, " + ", ".join(f"count(*) FILTER (source = '{s}') AS {s}" for s in SOURCES) + " FROM documents GROUP BY lang")
def source_pivot(spark, sf_dir):
    """Counts by language and source, of the whole vocabulary of sources."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[F.count_if(F.col("source") == s).alias(s) for s in SOURCES])


PRICES = {"A": (3.0, 15.0), "N": (0.8, 4.0)}
DEFAULT_PRICE = (3.0, 15.0)


@register(
    "usage_cost",
    """SELECT l_returnflag, CAST(l_shipdate AS DATE) AS day, count(*) AS calls, round(sum(l_quantity * CASE l_returnflag WHEN 'N' THEN 0.8 ELSE 3.0 END / 1e6 + l_linenumber * CASE l_returnflag WHEN 'N' THEN 4.0 ELSE 15.0 END / 1e6), 9) AS cost
FROM lineitem GROUP BY ROLLUP (CAST(l_shipdate AS DATE), l_returnflag)""",
)
def usage_cost(spark, sf_dir):
    """Daily and per-model usage with a price table; unknown models take the default price."""
    prices = F.create_map(*[F.lit(x) for k, v in PRICES.items() for x in (k, v[0])]), F.create_map(*[F.lit(x) for k, v in PRICES.items() for x in (k, v[1])])
    flag = F.col("l_returnflag")
    cost = F.col("l_quantity") * F.coalesce(F.try_element_at(prices[0], flag), F.lit(DEFAULT_PRICE[0])) / 1e6 + F.col("l_linenumber") * F.coalesce(F.try_element_at(prices[1], flag), F.lit(DEFAULT_PRICE[1])) / 1e6
    own = table(spark, sf_dir, "lineitem").select("l_returnflag", F.to_date("l_shipdate").alias("day"), cost.alias("c"))
    return own.rollup("day", "l_returnflag").agg(F.count("*").alias("calls"), F.round(F.sum("c"), 9).alias("cost"))


@register("mode_per_task", "SELECT user_id, event_type AS mode, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, min(event_id)) AS rn FROM events GROUP BY 1, 2) WHERE rn = 1")
def mode_per_task(spark, sf_dir):
    """The commonest state of each task; of equals the one seen first."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    best = n.groupBy("user_id").agg(F.max_by(F.struct("event_type", "n"), F.struct("n", -F.col("f"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("mode"), F.col("b.n").alias("n"))


@register("step_delays", "WITH d AS (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events) SELECT user_id, round(avg(d) / 1000, 3) AS mean_ms, max(d) AS max_us FROM d GROUP BY 1")
def step_delays(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    d = table(spark, sf_dir, "events").select("user_id", (us - F.lag(us).over(w)).alias("d"))
    return d.groupBy("user_id").agg(F.round(F.avg("d") / 1000, 3).alias("mean_ms"), F.max("d").alias("max_us"))


@register("rolling_mean20", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS mean20 FROM events")
def rolling_mean20(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-19, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("mean20"))


@register("session_gap", "WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM s) SELECT user_id, min(ts) AS started, count(*) AS n FROM g GROUP BY user_id, s")
def session_gap(spark, sf_dir):
    """Sessions that end after 30 idle minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("started"), F.count("*").alias("n")).select("user_id", "started", "n")


@register("topk_per_type", "SELECT event_type, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 6")
def topk_per_type(spark, sf_dir):
    """The newest 6 of each type: 6 of each (type, user) first, so that a hot type is cut down before it meets."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "ts")
    for keys in (["event_type", "user_id"], ["event_type"]):
        e = e.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("ts").desc(), "event_id"))).where("rn <= 6").drop("rn")
    return e.select("event_type", "event_id")


@register("rate_limit_hour", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def rate_limit_hour(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(F.unix_millis(F.col("ts").cast("timestamp"))).rangeBetween(-3_600_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("in_hour"))


@register("resume_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@register("failed_semi", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
def failed_semi(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id").distinct()


@register(
    "phase_compare",
    """WITH m AS (SELECT median(epoch_ms(ts)) AS mid FROM events), p AS (SELECT user_id, epoch_ms(ts) <= mid AS first, count(*) AS n, bool_or(event_type = 'purchase') AS ok FROM events, m GROUP BY 1, 2)
SELECT b.user_id, b.n AS n_before, a.n AS n_after, a.n - b.n AS delta, CASE WHEN a.ok IS NULL THEN 'MISSING' WHEN a.ok AND NOT b.ok THEN 'FIXED' WHEN b.ok AND NOT a.ok THEN 'REGRESSED' ELSE 'SAME' END AS change
FROM (SELECT * FROM p WHERE first) b LEFT JOIN (SELECT * FROM p WHERE NOT first) a ON a.user_id = b.user_id""",
)
def phase_compare(spark, sf_dir):
    """Success of each task in the first and second half of the time, and the class of the change."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    p = e.crossJoin(F.broadcast(selection.median(e, "ms"))).groupBy("user_id", (F.col("ms") <= F.col("median")).alias("first")).agg(F.count("*").alias("n"), F.bool_or(F.col("event_type") == "purchase").alias("ok"))
    b, a = p.where("first").selectExpr("user_id", "n AS n_before", "ok AS b"), p.where("not first").selectExpr("user_id", "n AS n_after", "ok AS a")
    return b.join(a, "user_id", "left").selectExpr("user_id", "n_before", "n_after", "CASE WHEN n_before != 0 THEN n_after - n_before END AS delta", "CASE WHEN a IS NULL THEN 'MISSING' WHEN a AND NOT b THEN 'FIXED' WHEN b AND NOT a THEN 'REGRESSED' ELSE 'SAME' END AS change")


@register("dependency_gate", "SELECT o_orderkey, coalesce(arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) = 'N', true) AS ready FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def dependency_gate(spark, sf_dir):
    """A task may start if its latest execution succeeded, or if it has none."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("s"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(last, "o_orderkey", "left").select("o_orderkey", F.coalesce(F.col("s") == "N", F.lit(True)).alias("ready"))


@register("tool_signature", "SELECT l_orderkey, string_agg(l_returnflag || ':' || l_linestatus, ' -> ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS signature FROM lineitem GROUP BY 1")
def tool_signature(spark, sf_dir):
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(":", "l_returnflag", "l_linestatus").alias("s"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(steps.alias("s")).select("l_orderkey", F.array_join(F.transform("s", lambda x: x.s), " -> ").alias("signature"))


@register("tokens", f"SELECT item_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark)")
def tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t")).select("item_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@register("jaccard_pairs", f"WITH t AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark) SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))), 6) AS similarity FROM t a JOIN t b ON a.item_id <> b.item_id WHERE a.item_id % 100 = 0 AND len(list_intersect(a.t, b.t)) > 0")
def jaccard_pairs(spark, sf_dir):
    """Items with the queries (ids divisible by 100) that share a word with them."""
    t = table(spark, sf_dir, "benchmark").select("item_id", tx.tokens(F.col("text")).alias("t"))
    q = t.where("item_id % 100 = 0").select(F.col("item_id").alias("a"), F.col("t").alias("u"))
    pairs = retrieval.against_blocks(t.withColumnRenamed("item_id", "b"), q, F.col("a") != F.col("b"))
    return pairs.where(F.arrays_overlap("t", "u")).select("a", "b", F.round(tx.jaccard(F.col("u"), F.col("t")), 6).alias("similarity"))


@register("lev_sim", "SELECT a.p_partkey, round(1 - levenshtein(lower(a.p_name), lower(b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def lev_sim(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("a"))
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return p.join(q, "p_partkey").select("p_partkey", F.round(tx.edit_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@register("query_hash", r"SELECT item_id, substr(md5(regexp_replace(trim(lower(text)), '\s+', ' ', 'g')), 1, 12) AS hash FROM benchmark")
def query_hash(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.query_hash(F.col("text")).alias("hash"))


@register("tfidf_top", f"""WITH t AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), e AS (SELECT item_id, len(t) AS n, unnest(t) AS word FROM t),
c AS (SELECT item_id, n, word, count(*) AS tf FROM e GROUP BY ALL), d AS (SELECT word, count(*) AS df FROM c GROUP BY 1), s AS (SELECT item_id, word, tf / n * ln((SELECT count(*) FROM benchmark) / df) AS weight FROM c JOIN d USING (word))
SELECT item_id, word, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(weight, 9) DESC, word) AS rn FROM s) WHERE rn <= 3""")
def tfidf_top(spark, sf_dir):
    w = Window.partitionBy("item_id").orderBy(F.round("weight", 9).desc(), "word")
    return retrieval.tfidf(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("item_id", "word", F.round("weight", 6).alias("weight"))


BM25 = f"""qt AS (SELECT DISTINCT q, term FROM (SELECT item_id AS q, unnest({TOKENS.format('text')}[1:2]) AS term FROM benchmark WHERE item_id % 10 = 0)), qn AS (SELECT q, count(*) AS terms FROM qt GROUP BY 1),
t AS (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents), n AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM t),
tf AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS size, unnest(t) AS term FROM t) WHERE term IN (SELECT term FROM qt) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT q, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS score FROM qt JOIN qn USING (q) JOIN tf USING (term) JOIN df USING (term), n GROUP BY q, doc_id, terms HAVING count(*) = terms)"""


def _queries(spark, sf_dir):
    """The first two words of every tenth benchmark item."""
    items = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0")
    return items.select(F.col("item_id").alias("q"), F.explode(F.array_distinct(F.slice(tx.tokens(F.col("text")), 1, 2))).alias("term"))


@register("bm25_scores", f"WITH {BM25} SELECT q, doc_id, round(score, 6) AS score FROM bm")
def bm25_scores(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _queries(spark, sf_dir)).select("q", "doc_id", F.round("score", 6).alias("score"))


COSINE = "cs AS (SELECT a.vec_id AS q, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"


def _similar(spark, sf_dir, name="vec_id"):
    """(q, name, s): cosine of the 20 vectors nearest to each query vector, those whose id is divisible by 100; of each block's."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), "embedding")
    q = e.where(F.col(name) % 100 == 0).select(F.col(name).alias("q"), F.col("embedding").alias("v"))
    return retrieval.nearest_vectors(e, q, name, 20)


@register("cosine_topk", f"WITH {COSINE} SELECT q, vec_id, round(sim, 6) AS similarity FROM cs QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, vec_id) <= 20")
def cosine_topk(spark, sf_dir):
    """The 20 vectors nearest to each query vector."""
    return retrieval.top(_similar(spark, sf_dir), "vec_id", "s", 20).select("q", "vec_id", F.round("s", 6).alias("similarity"))


@register(
    "hybrid_rrf",
    f"""WITH {BM25}, {COSINE}, x AS (SELECT q, doc_id AS id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS r FROM bm QUALIFY r <= 20), y AS (SELECT q, vec_id AS id, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, vec_id) AS r FROM cs QUALIFY r <= 20)
SELECT coalesce(x.q, y.q) AS q, coalesce(x.id, y.id) AS id, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0), 9) AS rrf FROM x FULL JOIN y ON x.id = y.id AND x.q = y.q""",
)
def hybrid_rrf(spark, sf_dir):
    """Fusion of the lexical and the vector list of each query; vec_id is taken as doc_id and as the query's number."""
    lexical = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _queries(spark, sf_dir)).select("q", F.col("doc_id").alias("id"), F.round("score", 9).alias("s"))
    return retrieval.fuse(retrieval.top(lexical, "id", "s", 20), retrieval.top(_similar(spark, sf_dir, "id"), "id", "s", 20), "id").select("q", "id", F.round("rrf", 9).alias("rrf"))


@register("importance", "SELECT doc_id, round(n_chars / 1000.0 * greatest(0.1, 1 / log10(doc_id % 90 + 10)) * (1 + 0.3 * log10(n_chars % 7 + 1)), 6) AS importance FROM documents")
def importance(spark, sf_dir):
    """Score decayed by age in days and raised by accesses (here derived from the id and length)."""
    days, seen = F.col("doc_id") % 90, F.col("n_chars") % 7
    value = F.col("n_chars") / 1000.0 * F.greatest(F.lit(0.1), 1 / F.log10(days + 10)) * (1 + 0.3 * F.log10(seen + 1))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(value, 6).alias("importance"))


@register("confidence_n3", "SELECT user_id, least(0.95, count(*) / (count(*) + 3.0)) AS confidence FROM events GROUP BY 1")
def confidence_n3(spark, sf_dir):
    n = F.count("*")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.least(F.lit(0.95), n / (n + 3.0)).alias("confidence"))


@register("cooccurrence", "SELECT user_id, event_type, count(*) AS frequency, max(ts) AS last_seen FROM events GROUP BY 1, 2")
def cooccurrence(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("frequency"), F.max("ts").alias("last_seen"))


@register("transcript", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1")
def transcript(spark, sf_dir):
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("s"))))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(lines.alias("x")).select("conv_id", F.array_join(F.transform("x", lambda r: r.s), "\n").alias("content"))
