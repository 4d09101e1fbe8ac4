"""Queries of segment libraries, plans, hints, candidates with evidence and restored layouts, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import device as dv
from pathlore.functions import lessons as ls
from pathlore.functions import parsers as ps
from pathlore.functions import patterns as p
from pathlore.functions import scalar as sc
from pathlore.functions import text as tx
from pathlore.operators import evidence, memory, retrieval, screen, sequences, vectors
from pathlore.plans.curation_queries import _types
from pathlore.plans.derived import CLICKS, ELEMENTS, PHRASES, REFLECTIONS, clicks, elements, phrase, reflections, sql_list, sql_phrase
from pathlore.plans.queries import BM25, FLAGS, TOKENS, _flagged, _queries
from pathlore.plans.registry import register
from pathlore.plans.retrieval_queries import ASKED, FUZZY, NAMES, _names, _phrases
from pathlore.plans.screen_queries import MIDDLE, _middles
from pathlore.session import table

SEG = f"""e AS (SELECT user_id, event_id, event_type, row_number() OVER w - 1 AS idx, coalesce(count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg, event_id % 7 = 0 AS issue FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT user_id, seg, min(idx) AS first_step, max(idx) AS last_step, max(event_id) FILTER (event_type = 'purchase') AS cp, bool_or(issue) AS issues, bool_or(event_type = 'error') AS failed, count(*) FILTER (event_id % 5 <> 0) AS steps FROM e GROUP BY 1, 2 HAVING bool_or(event_type = 'purchase') AND max(idx) > min(idx)),
sg AS (SELECT user_id, seg, first_step, last_step, steps, CASE WHEN cp % 2 = 0 AND {sql_phrase('cp')} <> '' THEN {sql_phrase('cp')} ELSE 'done ' || cp % 5 END AS label, 'done ' || cp % 5 || CASE WHEN cp % 3 = 0 THEN ' [SCENE: shop]' ELSE '' END AS post, coalesce(lag('done ' || cp % 5 || CASE WHEN cp % 3 = 0 THEN ' [SCENE: shop]' ELSE '' END) OVER (PARTITION BY user_id ORDER BY seg), 'initial desktop state') AS pre, NOT issues AND NOT failed AS clean FROM g)"""


def _segments(spark, sf_dir):
    """The steps between a task's checkpoints (purchases): label of the plan or the checkpoint, conditions, and whether they went well."""
    i = F.col("event_id")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    done = F.col("event_type") == "purchase"
    e = sequences.indexed(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type"), "user_id", "ts", "event_id")
    e = e.withColumn("seg", F.coalesce(F.sum(done.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = e.groupBy("user_id", "seg").agg(F.min("idx").alias("first_step"), F.max("idx").alias("last_step"), F.max(F.when(done, i)).alias("cp"), F.bool_or(i % 7 == 0).alias("issues"), F.bool_or(F.col("event_type") == "error").alias("failed"), F.count_if(i % 5 != 0).alias("steps"))
    g = g.where("cp is not null and last_step > first_step")
    cp = F.col("cp")
    said = F.concat(F.lit("done "), cp % 5)
    post = F.concat(said, F.when(cp % 3 == 0, " [SCENE: shop]").otherwise(""))
    label = F.when((cp % 2 == 0) & (phrase(cp) != ""), phrase(cp)).otherwise(said)
    own = g.select("user_id", "seg", "first_step", "last_step", "steps", label.alias("label"), post.alias("post"), (~F.col("issues") & ~F.col("failed")).alias("clean"))
    return own.withColumn("pre", F.coalesce(F.lag("post").over(Window.partitionBy("user_id").orderBy("seg")), F.lit("initial desktop state")))


@register("segment_rows", f"WITH {SEG} SELECT user_id, seg, first_step, last_step, steps, label, pre, post, clean FROM sg")
def segment_rows(spark, sf_dir):
    return _segments(spark, sf_dir).select("user_id", "seg", "first_step", "last_step", "steps", "label", "pre", "post", "clean")


_TOK = "list_distinct(" + TOKENS.format("{0}") + ")"
LIBRARY = f"""{SEG}, k AS (SELECT label, min(user_id * 100000 + seg) AS f FROM sg GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY f) AS rn FROM k),
m(rn, lib, label, entry) AS (SELECT 0::BIGINT, []::VARCHAR[], ''::VARCHAR, ''::VARCHAR UNION ALL
  SELECT o.rn, CASE WHEN x.hit IS NULL THEN list_append(m.lib, o.label) ELSE m.lib END, o.label, coalesce(x.hit, o.label) FROM m JOIN o ON o.rn = m.rn + 1,
  LATERAL (SELECT list_filter(m.lib, lambda p: len({_TOK.format('p')}) > 0 AND len({_TOK.format('o.label')}) > 0 AND len(list_intersect({_TOK.format('p')}, {_TOK.format('o.label')})) / len(list_distinct(list_concat({_TOK.format('p')}, {_TOK.format('o.label')}))) > 0.5)[1] AS hit) x),
lb AS (SELECT entry, count(*) AS occurrences, count(*) FILTER (clean) / count(*) AS success_rate, max(user_id * 100000 + seg) AS last FROM sg JOIN m USING (label) WHERE m.rn > 0 GROUP BY 1)"""


def _library(spark, sf_dir):
    s = _segments(spark, sf_dir).withColumn("order", F.col("user_id") * 100_000 + F.col("seg"))
    return evidence.library(s, "label", "order", F.col("clean"), 0.5)


@register("segment_library", f"WITH RECURSIVE {LIBRARY} SELECT entry, occurrences, round(success_rate, 6) AS success_rate, last FROM lb ORDER BY occurrences DESC, last DESC, entry LIMIT 30")
def segment_library(spark, sf_dir):
    """Segments merged by what their labels share, the 30 that occur most (of equals the last used)."""
    lib = _library(spark, sf_dir).orderBy(F.col("occurrences").desc(), F.col("last").desc(), "entry").limit(30)
    return lib.select("entry", "occurrences", F.round("success_rate", 6).alias("success_rate"), "last")


_ALIKE = "len({a}) > 0 AND len({b}) > 0 AND len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) > t.above"
_EITHER = "(" + _ALIKE.format(a="p.lw", b="o.lw") + ") OR (" + _ALIKE.format(a="p.pw", b="o.pw") + ")"


@register(
    "segment_merges",
    f"""WITH RECURSIVE {SEG}, t AS (SELECT greatest(0.3, 1 - 1 / sqrt(greatest(avg(len({TOKENS.format('label')})), 1))) AS above FROM sg),
k AS (SELECT label, post, min(user_id * 100000 + seg) AS f FROM sg GROUP BY 1, 2), o AS (SELECT label, post, {_TOK.format('label')} AS lw, {_TOK.format('post')} AS pw, row_number() OVER (ORDER BY f, label, post) AS rn FROM k),
m(rn, lib, label, post, e) AS (SELECT 0::BIGINT, []::STRUCT(l VARCHAR, p VARCHAR, lw VARCHAR[], pw VARCHAR[])[], '', '', NULL::STRUCT(l VARCHAR, p VARCHAR, lw VARCHAR[], pw VARCHAR[]) UNION ALL
  SELECT o.rn, CASE WHEN x.hit IS NULL THEN list_append(m.lib, {{'l': o.label, 'p': o.post, 'lw': o.lw, 'pw': o.pw}}) ELSE m.lib END, o.label, o.post, coalesce(x.hit, {{'l': o.label, 'p': o.post, 'lw': o.lw, 'pw': o.pw}}) FROM t, m JOIN o ON o.rn = m.rn + 1,
  LATERAL (SELECT list_filter(m.lib, lambda p: {_EITHER})[1] AS hit) x)
SELECT m.e.l AS label, m.e.p AS post, count(*) AS occurrences, round(count(*) FILTER (clean) / count(*), 6) AS success_rate, max(user_id * 100000 + seg) AS last FROM sg JOIN m ON m.label = sg.label AND m.post = sg.post WHERE m.rn > 0 GROUP BY 1, 2 ORDER BY 3 DESC, 5 DESC, 1, 2 LIMIT 30""",
)
def segment_merges(spark, sf_dir):
    """The library of segments, merged where labels or postconditions are alike by a bound that grows with the labels' length, at its first cap."""
    s = _segments(spark, sf_dir).withColumn("order", F.col("user_id") * 100_000 + F.col("seg"))
    above = s.agg(F.greatest(F.lit(0.3), 1 - 1 / F.sqrt(F.greatest(F.avg(F.size(tx.tokens(F.col("label")))), F.lit(1.0))))).first()[0]
    lib = evidence.segment_entries(s, "label", "post", "order", F.col("clean"), above or 0.3, 30)
    return lib.withColumn("success_rate", F.round("success_rate", 6))


@register("all_thresholds", f"""WITH {REFLECTIONS}, a AS (SELECT count(*) AS n, count(DISTINCT kind) AS types, avg(len(lessons)) AS lessons FROM r), {SEG}, b AS (SELECT count(*) AS s, avg(clean::INT) AS rate, avg(len({TOKENS.format('label')})) AS words FROM sg), k AS (SELECT count(DISTINCT label) AS skills FROM sg),
t AS (SELECT *, greatest(3, ceil(sqrt(greatest(n, 1)))) AS go FROM a, b, k)
SELECT greatest(20, types * 5) AS reflections_cap, greatest(30, s + ceil(sqrt(greatest(s, 1)) * 3))::BIGINT AS segments_cap, greatest(20, floor(sqrt(greatest(s, 1)) * 3))::BIGINT AS skills_cap, go::BIGINT AS graduation_occurrences, round(least(0.9, greatest(0.5, rate + 0.1)), 6) AS graduation_success, round(greatest(0.3, 1 - 1 / sqrt(greatest(words, 1))), 6) AS same_above,
  greatest(1, floor(250 / ((3 + lessons) * 15)))::BIGINT AS max_reflections, 3::BIGINT AS max_skills, 2::BIGINT AS max_segments, round(greatest(0.05, 0.15 / sqrt(greatest(1, n / 10.0))), 6) AS reflection_above, round(greatest(0.03, 0.1 / sqrt(greatest(1, skills / 5.0))), 6) AS skill_above, round(greatest(0.05, 0.2 / sqrt(greatest(1, s / 10.0))), 6) AS segment_above,
  greatest(2, floor(sqrt(go)))::BIGINT AS least_occurrences, round(greatest(0.4, rate), 6) AS least_success, 60 AS entity_cap, 30 AS shortcut_cap, 10 AS convention_cap, 50 AS environment_tokens FROM t""")
def all_thresholds(spark, sf_dir):
    """All caps and limits that follow from the stores' counts and means, and the fixed ones."""
    r = reflections(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.size("lessons")).alias("l")).agg(F.sum("n").alias("n"), F.count("*").alias("types"), (F.sum("l") / F.sum("n")).alias("lessons"))
    s = _segments(spark, sf_dir).groupBy("label").agg(F.count("*").alias("s"), F.count_if("clean").alias("good")).withColumn("words", F.size(tx.tokens(F.col("label"))) * F.col("s"))
    s = s.agg(F.sum("s").alias("s"), (F.sum("good") / F.sum("s")).alias("rate"), (F.sum("words") / F.sum("s")).alias("words"), F.count("*").alias("skills"))
    return r.crossJoin(F.broadcast(s)).select(*memory.desktop_thresholds(*[F.col(c) for c in ("n", "types", "s", "rate", "words")]), *memory.context_thresholds(*[F.col(c) for c in ("n", "lessons", "skills", "s", "rate")]))


@register("runs_of_type", r"WITH t AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(regexp_replace(lower(substr(text, 1, 100)), '[^a-z0-9_\s]', ' ', 'g'), '\s+'), lambda w: length(w) > 2)[1:2] AS w FROM documents), y AS (SELECT doc_id, CASE WHEN len(w) > 0 THEN array_to_string(w, ' ') ELSE 'unknown' END AS type FROM t) SELECT type, count(*) AS n, min(doc_id) AS first_id FROM y GROUP BY 1 HAVING count(*) > 1")
def runs_of_type(spark, sf_dir):
    """Types (the first two words of a description, here a text's first 100 characters) that have several runs."""
    t = table(spark, sf_dir, "documents").select("doc_id", sc.two_word_type(F.substring("text", 1, 100)).alias("type"))
    return t.groupBy("type").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@register("macro_search", f"""WITH {NAMES}, q AS (SELECT lower(name) AS q FROM nm WHERE key % 10 = 0), x AS (SELECT q, key, days, lower(name) AS name, lower(app) AS app FROM nm, q),
s AS (SELECT q, key, days, greatest({FUZZY.replace("t,", "name,").replace("(t)", "(name)").replace("contains(t", "contains(name").replace("string_split(t", "string_split(name").replace("substr(t", "substr(name")}, 0.7 * {FUZZY.replace("t,", "app,").replace("(t)", "(app)").replace("contains(t", "contains(app").replace("string_split(t", "string_split(app").replace("substr(t", "substr(app")}) AS score FROM x)
SELECT q, key, round(score, 6) AS score FROM s WHERE round(score, 9) > 0.2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY floor(round(score, 9) * 10 + 1e-6) DESC, days, key) <= 5""")
def macro_search(spark, sf_dir):
    """Named procedures by the best of their fields' scores; scores are compared in steps of .1, then the last used comes first."""
    n = _names(spark, sf_dir)
    q = n.where("key % 10 = 0").select(F.lower("name").alias("q"))
    score = F.greatest(tx.fuzzy(F.col("q"), F.col("name")), 0.7 * tx.fuzzy(F.col("q"), F.col("app")))
    s = retrieval.against_blocks(n, q, F.lit(True)).select("q", "key", "days", F.round(score, 9).alias("score")).where("score > 0.2")
    return evidence.top_per_group(s, ["q"], [F.floor(F.col("score") * 10 + 1e-6).desc(), F.col("days"), F.col("key")], 5).select("q", "key", F.round("score", 6).alias("score"))


@register("plan_progress", "WITH p AS (SELECT l_orderkey AS task, l_linenumber AS n, max((l_returnflag = 'N')::INT) = 1 AS done FROM lineitem GROUP BY 1, 2) SELECT task, count(*) AS total, count(*) FILTER (done) AS finished, min(n) FILTER (NOT done) AS next FROM p GROUP BY 1")
def plan_progress(spark, sf_dir):
    """How far each plan is: steps with a checkpoint (here a line with flag N), and the first without."""
    steps = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linenumber").alias("n")).agg(F.bool_or(F.col("l_returnflag") == "N").alias("done"))
    return steps.groupBy("task").agg(F.count("*").alias("total"), F.count_if("done").alias("finished"), F.min(F.when(~F.col("done"), F.col("n"))).alias("next"))


@register("agent_hints", f"""WITH {FLAGS}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM fl), l AS (SELECT user_id, max(n) AS n, count(*) FILTER (state = 'purchase') AS cps, max(idx) FILTER (state = 'purchase') AS last_cp, count(*) FILTER (state = 'error') AS failed, count(*) FILTER (surprised AND idx >= n - 10) AS recent FROM n GROUP BY 1)
SELECT user_id, 'CHECKPOINTS: ' || cps || coalesce(' (last ' || (n - 1 - last_cp) || ' actions ago)', '') || chr(10) || 'FAILED APPROACHES: ' || least(failed, 5) || chr(10) || 'RECENT SURPRISES: ' || recent AS hints FROM l""")
def agent_hints(spark, sf_dir):
    """What a task in trouble is told: its checkpoints, how many failed approaches (five at most), and surprises in its last ten steps."""
    w = Window.partitionBy("user_id")
    f = _flagged(spark, sf_dir).withColumn("n", F.count("*").over(w))
    cp = F.col("state") == "purchase"
    own = f.groupBy("user_id").agg(F.max("n").alias("n"), F.count_if(cp).alias("cps"), F.max(F.when(cp, F.col("idx"))).alias("last_cp"), F.count_if(F.col("state") == "error").alias("failed"), F.count_if(F.col("surprised") & (F.col("idx") >= F.col("n") - 10)).alias("recent"))
    ago = F.coalesce(F.concat(F.lit(" (last "), F.col("n") - 1 - F.col("last_cp"), F.lit(" actions ago)")), F.lit(""))
    return own.select("user_id", F.concat(F.lit("CHECKPOINTS: "), F.col("cps"), ago, F.lit("\nFAILED APPROACHES: "), F.least("failed", F.lit(5)), F.lit("\nRECENT SURPRISES: "), F.col("recent")).alias("hints"))


@register("prediction_query", f"""WITH {REFLECTIONS}, m AS (SELECT session, arg_max(task, (ts, id)) AS last, max(ts) AS now FROM r GROUP BY 1), c AS (SELECT session, kind, count(*) AS n, max(ts) AS seen FROM r GROUP BY 1, 2),
s AS (SELECT c.session, kind, round(n / (1 + date_diff('microsecond', seen, now) / 60e6), 9) AS score FROM c JOIN m USING (session)), t AS (SELECT session, string_agg(kind, ' ' ORDER BY score DESC, kind) AS topics FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session ORDER BY score DESC, kind) <= 5) GROUP BY 1)
SELECT session, trim(last || ' ' || topics) AS query FROM m JOIN t USING (session)""")
def prediction_query(spark, sf_dir):
    """Each session's last message with its five top topics (here kinds)."""
    r = reflections(spark, sf_dir).select("session", "id", "ts", "task", "kind")
    m = r.groupBy("session").agg(F.max_by("task", F.struct("ts", "id")).alias("last"), F.max("ts").alias("now"))
    c = r.groupBy("session", "kind").agg(F.count("*").alias("n"), F.max("ts").alias("seen")).join(m, "session")
    us = lambda x: F.unix_micros(F.col(x).cast("timestamp"))
    s = c.select("session", "last", "kind", F.round(F.col("n") / (1 + (us("now") - us("seen")) / 60e6), 9).alias("score"))
    few = evidence.top_per_group(s, ["session"], [F.col("score").desc(), F.col("kind")], 5)
    topics = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "kind"))), lambda x: x.kind)
    return few.groupBy("session", "last").agg(topics.alias("t")).select("session", F.trim(F.concat_ws(" ", "last", F.array_join("t", " "))).alias("query"))


@register("supported_candidates", f"""WITH {REFLECTIONS}, {ASKED}, c AS (SELECT id, session, list_filter(regexp_split_to_array(lower(task), '\\s+'), lambda w: length(w) > 3) AS w, confidence FROM r WHERE id % 10 = 0), a AS (SELECT q, lower(phrase) AS approach FROM qs WHERE q % 2 = 0),
e AS (SELECT id, session, confidence, count(*) FILTER (len(list_filter(w, lambda x: contains(approach, x))) > 0) AS support FROM c, a GROUP BY 1, 2, 3)
SELECT id, support, round(greatest(0, least(1, 0.5 * CASE WHEN confidence = 0 THEN 0.5 ELSE confidence END + 0.3 * least(support / 5.0, 1) + 0.2 * 0.5)), 6) AS score FROM e""")
def supported_candidates(spark, sf_dir):
    """Candidates (every tenth reflection) with the number of successful approaches (every other phrase) that support them, and their score at cost 3."""
    r = reflections(spark, sf_dir).where("id % 10 = 0")
    w = F.filter(F.split(F.lower("task"), r"\s+"), lambda x: F.length(x) > 3)
    approaches = _phrases(spark).where("q % 2 = 0").select("q", F.lower("phrase").alias("approach"))
    # equal texts are judged once
    texts = r.select("task").distinct().select("task", w.alias("w"))
    support = retrieval.against_blocks(texts, approaches, F.lit(True)).groupBy("task").agg(F.count_if(F.exists("w", lambda x: F.contains(F.col("approach"), x))).alias("support"))
    own = r.join(support, "task")
    judge = F.when(F.col("confidence") == 0, 0.5).otherwise(F.col("confidence"))
    return own.select("id", "support", F.round(sc.composite(F.col("support"), judge, F.lit(3)), 6).alias("score"))


@register("enriched_macros", f"""WITH {ELEMENTS}, {CLICKS}, n AS (SELECT c.click, count(e.key) > 0 AS hit FROM cl c LEFT JOIN el e ON {MIDDLE} <= 50 GROUP BY 1) SELECT click // 10 AS macro, count(*) AS clicks, count(*) FILTER (hit) AS enriched, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM n GROUP BY 1""")
def enriched_macros(spark, sf_dir):
    """How many clicks of each recorded procedure (ten clicks each) have an element within 50 px."""
    c = clicks(spark, sf_dir)
    near = screen.nearest(c, _middles(spark, sf_dir), 50, "click", "key")
    own = c.join(near, "click", "left").groupBy(F.floor(F.col("click") / 10).alias("macro")).agg(F.count("*").alias("clicks"), F.count("key").alias("enriched"))
    return own.withColumn("rate", F.round(F.col("enriched") / F.col("clicks"), 6))


@register("dependency_lists", """WITH t AS (SELECT o_orderkey AS id, [o_orderkey - 1, o_orderkey - 7] AS deps FROM orders WHERE o_orderkey % 3 <> 0), d AS (SELECT id, unnest(deps) AS dep FROM t), x AS (SELECT l_orderkey AS dep, arg_max(l_returnflag, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS status FROM lineitem GROUP BY 1)
SELECT id, bool_and(coalesce(status = 'N', false)) AS ready FROM d LEFT JOIN x USING (dep) GROUP BY 1 UNION ALL SELECT o_orderkey, true FROM orders WHERE o_orderkey % 3 = 0""")
def dependency_lists(spark, sf_dir):
    """Whether the last execution of all that a task depends on was good; a task that depends on none may start."""
    i = F.col("o_orderkey")
    deps = F.when(i % 3 != 0, F.to_json(F.array(i - 1, i - 7)))
    t = table(spark, sf_dir, "orders").select(i.alias("id"), F.explode_outer(F.from_json(deps, "array<bigint>")).alias("dep"))
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("dep")).agg(F.max_by("l_returnflag", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("status"))
    good = F.col("dep").isNull() | F.coalesce(F.col("status") == "N", F.lit(False))
    return t.join(last, "dep", "left").groupBy("id").agg(F.bool_and(good).alias("ready"))


@register("filtered_hybrid", f"""WITH {BM25}, f AS (SELECT q, bm.doc_id, score FROM bm JOIN documents d ON d.doc_id = bm.doc_id WHERE lang IN ('en', 'de') AND n_chars >= 200), x AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, doc_id) AS r FROM f QUALIFY r <= 20),
v AS (SELECT a.vec_id AS q, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id JOIN documents d ON d.doc_id = b.vec_id WHERE a.vec_id % 100 = 0 AND lang IN ('en', 'de') AND n_chars >= 200),
y AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY round(sim, 9) DESC, doc_id) AS r FROM v QUALIFY r <= 20),
z AS (SELECT coalesce(x.q, y.q) AS q, coalesce(x.doc_id, y.doc_id) AS doc_id, round(coalesce(1.0 / (60 + x.r), 0) + coalesce(1.0 / (60 + y.r), 0), 9) AS rrf FROM x FULL JOIN y ON x.q = y.q AND x.doc_id = y.doc_id)
SELECT q, z.doc_id, rrf, lang FROM z JOIN documents d ON d.doc_id = z.doc_id QUALIFY row_number() OVER (PARTITION BY q ORDER BY rrf DESC, z.doc_id) <= 10""")
def filtered_hybrid(spark, sf_dir):
    """The ten best by both lists, of documents of two languages and 200 characters or more (as kinds and importance), with a field of theirs."""
    allowed = table(spark, sf_dir, "documents").where("lang in ('en', 'de') and n_chars >= 200").select("doc_id", "lang")
    lexical = retrieval.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _queries(spark, sf_dir)).join(allowed.select("doc_id"), "doc_id").select("q", "doc_id", F.round("score", 9).alias("s"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("q"), F.col("embedding").alias("v"))
    near = retrieval.nearest_vectors(e.join(allowed.select("doc_id"), "doc_id"), q, "doc_id", 20)
    both = retrieval.fuse(retrieval.top(lexical, "doc_id", "s", 20), retrieval.top(near, "doc_id", "s", 20), "doc_id").withColumn("rrf", F.round("rrf", 9))
    return retrieval.top(both, "doc_id", "rrf", 10).join(allowed, "doc_id").select("q", "doc_id", "rrf", "lang")


@register("snap_rates", "WITH s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events) SELECT user_id, count(*) AS snaps, round(count(*) FILTER (event_type = 'click') / count(*), 6) AS snap_rate, round(count(*) FILTER (event_id % 3 = 0) / count(*), 6) AS hit_rate, round(avg(value) FILTER (z <= 20), 6) AS mean_ms FROM s GROUP BY 1")
def snap_rates(spark, sf_dir):
    """Rates of all snaps, and the mean of the last 20 timings."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    n = e.groupBy("user_id").agg(F.count("*").alias("snaps"), F.round(F.avg((F.col("event_type") == "click").cast("int")), 6).alias("snap_rate"), F.round(F.avg((F.col("event_id") % 3 == 0).cast("int")), 6).alias("hit_rate"))
    last = evidence.top_per_group(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 20).groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean_ms"))
    return n.join(last, "user_id")


@register("debates", "WITH v AS (SELECT l_orderkey AS task, l_returnflag AS vote, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT task, arg_max(vote, (n, vote)) AS winner, sum(n)::BIGINT AS votes, max(n) AS most FROM v GROUP BY 1")
def debates(spark, sf_dir):
    """The proposal with most votes in each debate (of equals the last by name)."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_returnflag").alias("vote")).agg(F.count("*").alias("n"))
    return v.groupBy("task").agg(F.max_by("vote", F.struct("n", "vote")).alias("winner"), F.sum("n").alias("votes"), F.max("n").alias("most"))


@register("restored_layouts", "WITH w AS (SELECT o_orderkey AS win, o_custkey % 7 AS app, o_orderkey % 1400 AS x, o_orderkey % 800 AS y FROM orders), r AS (SELECT DISTINCT s_suppkey % 7 AS app FROM supplier WHERE s_suppkey % 7 < 4) SELECT win, floor(x * (1920 / 1440.0) + 0.5)::BIGINT AS x, floor(y * (1080 / 900.0) + 0.5)::BIGINT AS y, r.app IS NOT NULL AS running FROM w LEFT JOIN r USING (app)")
def restored_layouts(spark, sf_dir):
    """Saved windows placed on another screen; those of applications that don't run are marked."""
    w = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("win"), (F.col("o_custkey") % 7).alias("app"), (F.col("o_orderkey") % 1400).alias("x"), (F.col("o_orderkey") % 800).alias("y"))
    up = table(spark, sf_dir, "supplier").where("s_suppkey % 7 < 4").select((F.col("s_suppkey") % 7).alias("app")).distinct().withColumn("up", F.lit(True))
    return w.join(up, "app", "left").select("win", dv.rescaled(F.col("x"), F.lit(1920), F.lit(1440.0)).alias("x"), dv.rescaled(F.col("y"), F.lit(1080), F.lit(900.0)).alias("y"), F.coalesce("up", F.lit(False)).alias("running"))


@register("top_entities", f"WITH {REFLECTIONS}, e AS (SELECT unnest(regexp_extract_all(lower(task), '\\b(browser|terminal|window|calendar|music|folder|menu|tab)\\b', 1)) AS entity FROM r) SELECT entity, count(*) AS n FROM e GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_entities(spark, sf_dir):
    found = F.regexp_extract_all(F.lower("task"), F.lit(f"{ls.BOUNDARY}(browser|terminal|window|calendar|music|folder|menu|tab){ls.BOUNDARY}"), F.lit(1))
    return reflections(spark, sf_dir).select(F.explode(found).alias("entity")).groupBy("entity").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "entity").limit(5)


@register("synthetic_rows", f"WITH {REFLECTIONS} SELECT 'ref-' || id AS id, {_types('task', p.GOAL_TYPES, p.OTHER_INTERACTION)} AS type, CASE WHEN confidence < 0.4 AND confidence <> 0 THEN 3 WHEN confidence < 0.7 THEN 8 ELSE 18 END AS iterations, 'webrl' AS source, 0.6 AS confidence FROM r WHERE outcome = 'failure' AND task <> ''")
def synthetic_rows(spark, sf_dir):
    """Variants of failed tasks as reflections of a made source."""
    v = reflections(spark, sf_dir).where("outcome = 'failure' and task != ''")
    return v.select(F.concat(F.lit("ref-"), "id").alias("id"), ls.goal_type(F.col("task")).alias("type"), dv.iterations(F.col("confidence")).alias("iterations"), F.lit("webrl").alias("source"), F.lit(0.6).alias("confidence"))


@register("learning_pass", f"WITH {REFLECTIONS}, c AS (SELECT *, {_types('task', p.REQUEST_TYPES, p.OTHER_REQUEST)} AS type FROM r WHERE trim(task) <> '') SELECT type, count(*) AS captured, count(*) FILTER (len(tools) > 0) AS with_pattern, count(*) FILTER (iterations > 6) AS with_count_lesson FROM c GROUP BY 1")
def learning_pass(spark, sf_dir):
    """What a learning pass captures by type: runs without a task are refused, those without tools make no pattern."""
    r = reflections(spark, sf_dir).where("trim(task) != ''").withColumn("type", ls.request_type(F.col("task")))
    told = ls.rule_lessons(F.col("type"), F.col("outcome"), F.col("iterations"), F.col("cost"), F.col("tools"), F.lit(None).cast("string"))
    return r.groupBy("type").agg(F.count("*").alias("captured"), F.count_if(F.size("tools") > 0).alias("with_pattern"), F.count_if(F.exists(told, lambda x: x.startswith("High iteration"))).alias("with_count_lesson"))


@register("short_macro_names", f"""WITH s AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CASE WHEN l_suppkey % 4 <> 0 THEN 'App' || l_suppkey % 4 END AS app, CASE l_partkey % 3 WHEN 0 THEN 'part ' || l_partkey % 10 WHEN 1 THEN '"' || substr({sql_phrase(f'l_partkey % {len(PHRASES) - 1}')}, 1, 15) || '"' END AS act FROM lineitem),
a AS (SELECT id, app, min(i) AS f FROM s WHERE app IS NOT NULL GROUP BY 1, 2), b AS (SELECT id, string_agg(app, '+' ORDER BY f) AS apps FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY id ORDER BY f) <= 2) GROUP BY 1), c AS (SELECT id, list(act ORDER BY i) FILTER (act IS NOT NULL AND i <= 5)[1:2] AS acts FROM s GROUP BY 1)
SELECT c.id, coalesce(apps, 'Desktop') || CASE WHEN len(acts) > 0 THEN ': ' || array_to_string(acts, ' > ') ELSE ' Macro' END AS name FROM c LEFT JOIN b ON b.id = c.id""")
def short_macro_names(spark, sf_dir):
    k = F.col("l_partkey")
    act = F.when(k % 3 == 0, F.concat(F.lit("part "), k % 10)).when(k % 3 == 1, F.concat(F.lit('"'), F.substring(phrase(k % (len(PHRASES) - 1)), 1, 15), F.lit('"')))
    app = F.when(F.col("l_suppkey") % 4 != 0, F.concat(F.lit("App"), F.col("l_suppkey") % 4))
    s = table(spark, sf_dir, "lineitem").withColumn("s", F.struct("l_linenumber", "l_partkey", "l_suppkey", app.alias("app"), act.alias("act"))).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return s.select("id", ps.short_name(F.col("s.app"), F.col("s.act")).alias("name"))


_CLUSTER = "STRUCT(ids BIGINT[], s DOUBLE[], n BIGINT)"


@register(
    "consolidated",
    f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + 0.25) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e WHERE list_dot_product(v, v) > 0),
l AS (SELECT list({{'ids': [vec_id], 's': v, 'n': 1}}::{_CLUSTER} ORDER BY vec_id DESC) AS all FROM u),
r(k, used, c) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::{_CLUSTER} UNION ALL
  SELECT k + 1, CASE WHEN x.c IS NULL THEN used ELSE list_concat(used, x.c.ids) END, x.c FROM r, l, LATERAL (SELECT CASE WHEN NOT list_contains(used, l.all[k + 1].ids[1]) THEN
    list_reduce(list_filter(l.all[k + 1:], lambda y: NOT list_contains(used, y.ids[1])), lambda a, b: CASE WHEN list_dot_product(a.s, b.s) / a.n >= 0.85
      THEN {{'ids': list_concat(a.ids, b.ids), 's': list_transform(list_zip(a.s, b.s), lambda z: z[1] + z[2]), 'n': a.n + 1}} ELSE a END) END AS c) x WHERE k < len(l.all))
SELECT c.ids[1] AS vec_id, c.n AS size, array_to_string(c.ids, ',') AS ids FROM r WHERE c.n >= 2""",
)
def consolidated(spark, sf_dir):
    """Clusters of vectors (newest first by id), over the whole table; moved by a quarter in each place, without which no two are near enough."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").cast("string").alias("content"), F.lit(0.5).alias("importance"), F.col("vec_id").alias("accessed_at"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 0.25).alias("embedding"))
    return vectors.consolidated(e).select(F.col("first").alias("vec_id"), "size", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
