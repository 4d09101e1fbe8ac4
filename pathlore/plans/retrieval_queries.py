"""Queries of keyword, phrase, tier and name retrieval, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pathlore.functions import patterns as p
from pathlore.functions import text as tx
from pathlore.operators import evidence, retrieval
from pathlore.plans.derived import PHRASES, REFLECTIONS, reflections, sql_list
from pathlore.plans.queries import TOKENS
from pathlore.plans.registry import register
from pathlore.session import table

STATE_STOPS = p.TOPIC_STOPS
_SPLIT = r"regexp_split_to_array(regexp_replace(lower({0}), '{1}', ' ', 'g'), '\s+')"
INDEX = f"list_filter({_SPLIT.format('{0}', '[^a-z0-9_' + chr(92) + 's]')}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(p.INDEX_STOPS)}, w))"
TOPIC = f"list_filter({_SPLIT.format('{0}', '[^a-z0-9' + chr(92) + 's-]')}, lambda w: length(w) > 2 AND NOT list_contains({sql_list(p.TOPIC_STOPS)}, w))"
STATE = "list_filter(list_transform(regexp_split_to_array(lower({0}), '\\s+'), lambda w: regexp_replace(w, '[^a-z0-9]', '', 'g')), lambda w: length(w) > 1 AND NOT list_contains(" + sql_list(p.STATE_STOPS) + ", w))"


@register("keywords", f"WITH {REFLECTIONS} SELECT id, array_to_string({INDEX.format('task')}, ' ') AS index_terms, array_to_string({TOPIC.format('task')}, ' ') AS topics, array_to_string({STATE.format('task')}, ' ') AS state_terms FROM r")
def keywords(spark, sf_dir):
    task = F.col("task")
    own = [tx.index_terms(task), tx.topic_terms(task), tx.state_terms(task, p.STATE_STOPS)]
    return reflections(spark, sf_dir).select("id", *[F.array_join(c, " ").alias(n) for c, n in zip(own, ("index_terms", "topics", "state_terms"), strict=True)])


def _phrases(spark):
    """(q, phrase): the phrases as a table of queries; their number is fixed."""
    return spark.createDataFrame([(i, x) for i, x in enumerate(PHRASES) if x], "q long, phrase string")


ASKED = f"qs AS (SELECT i - 1 AS q, ({sql_list(PHRASES)})[i] AS phrase FROM range(1, {len(PHRASES) + 1}) x(i) WHERE ({sql_list(PHRASES)})[i] <> '')"


@register("reflection_search", f"""WITH {REFLECTIONS}, {ASKED}, n AS (SELECT max(ts) AS now FROM r), t AS (SELECT id, {TOKENS.format("task || ' ' || kind || ' ' || array_to_string(lessons, ' ')")} AS t, exp(-(epoch(now) - epoch(ts)) / 86400 / 30) * CASE WHEN confidence = 0 THEN 1 ELSE confidence END AS weight FROM r, n),
u AS (SELECT q, {TOKENS.format('phrase')} AS u FROM qs), s AS (SELECT q, id, round(len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) * weight, 9) AS score FROM t, u)
SELECT q, id, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5""")
def reflection_search(spark, sf_dir):
    """The five reflections that fit each query best, by Jaccard, age and confidence (0 counts as 1)."""
    r = reflections(spark, sf_dir)
    text = F.concat_ws(" ", "task", "kind", F.array_join("lessons", " "))
    days = (F.unix_micros(F.col("now").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000
    weight = F.exp(-days / 30) * F.when(F.col("confidence") == 0, 1.0).otherwise(F.col("confidence"))
    own = r.crossJoin(F.broadcast(r.agg(F.max("ts").alias("now")))).select("id", text.alias("text"), weight.alias("weight"))
    q = _phrases(spark).select("q", tx.tokens(F.col("phrase")).alias("u"))
    return retrieval.weighted_top(own, q, lambda: tx.jaccard(tx.tokens(F.col("text")), F.col("u")), 5).select("q", "id", F.round("score", 6).alias("score"))


@register("context_tiers", f"""WITH {REFLECTIONS}, {ASKED}, u AS (SELECT q, {TOKENS.format('phrase')} AS u FROM qs), sk AS (SELECT q AS id, {TOKENS.format('phrase')} AS t FROM qs WHERE q % 4 = 0), sg AS (SELECT q AS id, {TOKENS.format('phrase')} AS t FROM qs WHERE q % 4 <> 0),
a AS (SELECT q, min(id) AS id, 'reflection' AS tier, round(len(list_filter(u, lambda w: list_contains(t, w))) / len(u), 9) AS score FROM u, (SELECT id, task, {TOKENS.format("task || ' ' || kind || ' ' || array_to_string(lessons, ' ')")} AS t FROM r) GROUP BY q, u, t),
b AS (SELECT q, id, 'skill' AS tier, round(len(list_filter(u, lambda w: list_contains(t, w))) / len(u), 9) AS score FROM u, sk),
c AS (SELECT q, id, 'segment' AS tier, round(len(list_filter(u, lambda w: list_contains(t, w))) / len(u), 9) AS score FROM u, sg),
k AS (SELECT * FROM b WHERE score > 0.2), z AS (SELECT * FROM a WHERE score > 0.3 UNION ALL SELECT * FROM k UNION ALL SELECT * FROM c WHERE score > 0.2 AND q NOT IN (SELECT q FROM k))
SELECT q, tier, id, round(score, 6) AS score FROM z QUALIFY row_number() OVER (PARTITION BY q, tier ORDER BY score DESC, id) <= 3""")
def context_tiers(spark, sf_dir):
    """What a task is told: the best reflections, the best skills, and segments only where no skill fits.

    Skills and segments are phrases here; equal texts of reflections are folded before they are scored.
    """
    r = reflections(spark, sf_dir)
    text = F.concat_ws(" ", "task", "kind", F.array_join("lessons", " "))
    q = _phrases(spark).select("q", tx.tokens(F.col("phrase")).alias("u"))
    known = r.groupBy(tx.tokens(text).alias("t")).agg(F.min("id").alias("id"))
    other = _phrases(spark).select(F.col("q").alias("id"), tx.tokens(F.col("phrase")).alias("t"))

    def tier(rows, name, above):
        score = F.round(F.size(F.filter("u", lambda w: F.array_contains("t", w))) / F.size("u"), 9)
        return retrieval.against_blocks(rows, q, F.lit(True)).select("q", F.lit(name).alias("tier"), "id", score.alias("score")).where(F.col("score") > above)

    skills = tier(other.where("id % 4 = 0"), "skill", 0.2)
    segments = tier(other.where("id % 4 != 0"), "segment", 0.2).join(skills.select("q").distinct(), "q", "left_anti")
    told = tier(known, "reflection", 0.3).unionByName(skills).unionByName(segments)
    return evidence.top_per_group(told, ["q", "tier"], [F.col("score").desc(), F.col("id")], 3).select("q", "tier", "id", F.round("score", 6).alias("score"))


@register("run_context", f"""WITH {REFLECTIONS}, {ASKED}, w AS (SELECT q, phrase, list_distinct(list_filter(regexp_split_to_array(lower(phrase), '\\s+'), lambda x: length(x) > 2)) AS u FROM qs),
t AS (SELECT min(id) AS id, task, kind, list_distinct(list_filter(regexp_split_to_array(lower(task), '\\s+'), lambda x: length(x) > 2)) AS t FROM r WHERE trim(task) <> '' GROUP BY task, kind),
s AS (SELECT q, id, round(CASE WHEN kind = 'click' THEN 0.4 ELSE 0 END + 0.6 * CASE WHEN len(t) = 0 OR len(u) = 0 THEN 0 ELSE len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) END, 9) AS score FROM t, w)
SELECT q, id, round(score, 6) AS score FROM s WHERE score > 0.05 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 3""")
def run_context(spark, sf_dir):
    """The three earlier runs nearest to each task: .4 for the same type (click here) and .6 for the words they share."""
    r = reflections(spark, sf_dir).where(F.trim("task") != "").groupBy("task", "kind").agg(F.min("id").alias("id"))
    t = r.select("id", "kind", evidence.words(F.col("task")).alias("t"))
    q = _phrases(spark).select("q", evidence.words(F.col("phrase")).alias("u"))
    score = F.round(F.when(F.col("kind") == "click", 0.4).otherwise(0.0) + 0.6 * evidence.word_jaccard(F.col("t"), F.col("u")), 9)
    scored = retrieval.against_blocks(t, q, F.lit(True)).select("q", "id", score.alias("score")).where("score > 0.05")
    return retrieval.top(scored, "id", "score", 3).select("q", "id", F.round("score", 6).alias("score"))


@register("index_search", f"""WITH qq AS (SELECT item_id AS q, {INDEX.format('text')}[1:6] AS terms FROM benchmark WHERE item_id % 10 = 0), a AS (SELECT q, len(terms) AS size, unnest(terms) AS term FROM qq), k AS (SELECT q, size, term, count(*) AS uses FROM a GROUP BY ALL),
d AS (SELECT doc_id, unnest({INDEX.format('text')}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT q, doc_id, round(least(1, sum(tf * uses * ln(n / df)) / size / 5), 9) AS score FROM k JOIN tf USING (term) JOIN df USING (term), n GROUP BY q, doc_id, size)
SELECT q, s.doc_id, lang, round(score, 6) AS score FROM s JOIN documents d ON d.doc_id = s.doc_id WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, s.doc_id) <= 10""")
def index_search(spark, sf_dir):
    """The ten documents that share most with the first six keywords of each query, with a field of theirs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", tx.index_terms(F.col("text")).alias("terms"))
    q = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("q"), F.slice(tx.index_terms(F.col("text")), 1, 6).alias("terms"))
    scored = retrieval.shared_terms(docs.select("doc_id", "terms"), "doc_id", q).select("q", "doc_id", F.round("score", 9).alias("score")).where("score > 0")
    best = retrieval.top(scored, "doc_id", "score", 10)
    return best.join(docs.select("doc_id", "lang"), "doc_id").select("q", "doc_id", "lang", F.round("score", 6).alias("score"))


@register("duplicate_check", f"""WITH x AS (SELECT item_id, {TOKENS.format('text')} AS t FROM benchmark), w AS (SELECT item_id, len(t) AS n_tokens, unnest(t) AS word FROM x), c AS (SELECT item_id, n_tokens, word, count(*) / n_tokens AS tf FROM w GROUP BY item_id, n_tokens, word),
e AS (SELECT * FROM c WHERE item_id % 2 = 0), f AS (SELECT word, count(*) AS df FROM e GROUP BY 1), n AS (SELECT count(*) + 1 AS n FROM benchmark WHERE item_id % 2 = 0),
p AS (SELECT a.item_id AS c, b.item_id AS e FROM x a, x b WHERE a.item_id % 2 = 1 AND b.item_id % 2 = 0),
v AS (SELECT p.c, p.e, coalesce(a.tf, 0) * ln(n / (coalesce(df, 0) + (a.tf IS NOT NULL)::INT)) AS wa, coalesce(b.tf, 0) * ln(n / (coalesce(df, 0) + (a.tf IS NOT NULL)::INT)) AS wb
  FROM p, n, (SELECT DISTINCT word FROM c) d LEFT JOIN c a ON a.item_id = p.c AND a.word = d.word LEFT JOIN c b ON b.item_id = p.e AND b.word = d.word LEFT JOIN f ON f.word = d.word WHERE a.tf IS NOT NULL OR b.tf IS NOT NULL),
s AS (SELECT c, e, round(sum(wa * wb) / (sqrt(sum(wa * wa)) * sqrt(sum(wb * wb))), 9) AS sim, count(*) FILTER (wa <> 0 AND wb <> 0) AS shared FROM v GROUP BY c, e)
SELECT c AS item_id, arg_max(e, (sim, -e)) AS match, round(max(sim), 6) AS similarity, max(sim) >= 0.9 AS duplicate FROM s WHERE shared > 0 GROUP BY c""")
def duplicate_check(spark, sf_dir):
    """Each odd item's most similar even item, and whether that makes it a duplicate."""
    items = table(spark, sf_dir, "benchmark")
    d = retrieval.duplicates(items.where("item_id % 2 = 0"), items.where("item_id % 2 = 1"), "item_id", "text")
    return d.select("item_id", "match", F.round("similarity", 6).alias("similarity"), (F.col("similarity") >= 0.9).alias("duplicate"))


_NORMAL = r"' ' || trim(regexp_replace(regexp_replace(lower({0}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) || ' '"


@register("phrase_search", f"""WITH q AS (SELECT item_id AS q, {TOKENS.format('text')}[1:2] AS w FROM benchmark WHERE item_id % 10 = 0), qq AS (SELECT q, w FROM q WHERE len(w) = 2), d AS (SELECT doc_id, {_NORMAL.format('text')} AS t FROM documents),
h AS (SELECT q, doc_id, contains(t, ' ' || w[1] || ' ' || w[2] || ' ') AS whole FROM qq, d WHERE contains(t, ' ' || w[1] || ' ') OR contains(t, ' ' || w[2] || ' ')), b AS (SELECT q, bool_or(whole) AS found FROM h GROUP BY 1)
SELECT q, doc_id, whole FROM h JOIN b USING (q) WHERE whole OR NOT found QUALIFY row_number() OVER (PARTITION BY q ORDER BY doc_id) <= 20""")
def phrase_search(spark, sf_dir):
    """Documents with the two words of a query in a row; where none has them, those with either word. The first 20 of each."""
    q = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.col("item_id").alias("q"), F.slice(tx.tokens(F.col("text")), 1, 2).alias("w")).where("size(w) = 2")
    d = table(spark, sf_dir, "documents").select("doc_id", tx.normalised(F.col("text")).alias("t"))
    one, two = F.col("w")[0], F.col("w")[1]
    has = lambda x: F.contains("t", F.concat(F.lit(" "), x, F.lit(" ")))
    hits = retrieval.against_blocks(d, q, has(one) | has(two)).select("q", "doc_id", has(F.concat_ws(" ", one, two)).alias("whole"))
    # the first 20 of either kind are enough to choose from
    few = evidence.top_per_group(hits, ["q", "whole"], [F.col("doc_id")], 20)
    some = F.max("whole").over(Window.partitionBy("q"))
    return few.withColumn("some", some).where("whole or not some").select("q", "doc_id", "whole")


NAMES = "nm AS (SELECT p_name AS name, min(p_brand) AS app, count(*) AS uses, min(p_partkey) AS key, max(p_size) % 40 AS days FROM part GROUP BY 1)"


def _names(spark, sf_dir):
    """(name, app, uses, key, days): distinct names of parts, as named procedures with counts of use."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("app"), F.count("*").alias("uses"), F.min("p_partkey").alias("key"), (F.max("p_size") % 40).alias("days"))


@register("ranked_by_context", f"""WITH {NAMES}, q AS (SELECT name AS query FROM nm), s AS (SELECT query, key, CASE WHEN app = 'Brand#1' THEN 2.0 ELSE 0 END + CASE WHEN days <= 30 THEN exp(-days / 10.0) ELSE 0 END + least(2.0, 0.5 * log2(uses + 1))
  + CASE WHEN name = query THEN 3.0 WHEN contains(name, query) OR contains(query, name) THEN 1.5 ELSE 0 END AS score FROM nm, q)
SELECT query, key, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) <= 5""")
def ranked_by_context(spark, sf_dir):
    """Named procedures for each query (every distinct name) by application, age, use and name."""
    n = _names(spark, sf_dir)
    q = n.select(F.col("name").alias("q"))
    score = tx.context_score(F.lower("app"), F.lit("brand#1"), F.col("days"), F.col("uses"), F.lower("name"), F.lower("q"), exact_app=True)
    scored = retrieval.against_blocks(n, q, F.lit(True)).select("q", "key", F.round(score, 9).alias("score"))
    return retrieval.top(scored, "key", "score", 5).select(F.col("q").alias("query"), "key", F.round("score", 6).alias("score"))


FUZZY = r"""CASE WHEN contains(t, q) THEN 1.0 WHEN len(list_filter(string_split(q, ' '), lambda a: len(list_filter(string_split(t, ' '), lambda b: contains(b, a) OR contains(a, b))) > 0)) > 0
  THEN 0.5 + 0.4 * len(list_filter(string_split(q, ' '), lambda a: len(list_filter(string_split(t, ' '), lambda b: contains(b, a) OR contains(a, b))) > 0)) / len(string_split(q, ' '))
  ELSE CASE WHEN list_reduce(string_split(q, ''), lambda j, c: CASE WHEN j >= length(t) THEN j WHEN instr(substr(t, j::BIGINT + 1), c) = 0 THEN length(t) ELSE j + instr(substr(t, j::BIGINT + 1), c) END, 0) < length(t) THEN 0.3 ELSE 0.1 END * length(q) / greatest(length(q), length(t)) END"""


@register("fuzzy_names", "WITH x AS (SELECT DISTINCT lower(p_name) AS t FROM part), y AS (SELECT DISTINCT lower(c_mktsegment) AS q FROM customer UNION SELECT t FROM x UNION SELECT 'rd wdgt') SELECT q, t, round(fz, 6) AS score FROM (SELECT q, t, " + FUZZY.replace("j::BIGINT", "CAST(j AS BIGINT)").replace("lambda j, c: CASE", "lambda j, c: CASE") + " AS fz FROM x, y)")
def fuzzy_names(spark, sf_dir):
    """How well each distinct name, and a few others, fits each distinct name: contained, by words, or letter by letter."""
    t = table(spark, sf_dir, "part").select(F.lower("p_name").alias("t")).distinct()
    q = table(spark, sf_dir, "customer").select(F.lower("c_mktsegment").alias("q")).union(t.select("t")).union(spark.createDataFrame([("rd wdgt",)], "q string")).distinct()
    return retrieval.against_blocks(t, q, F.lit(True)).select("q", "t", F.round(tx.fuzzy(F.col("q"), F.col("t")), 6).alias("score"))


@register("similar_domains", "WITH t AS (SELECT DISTINCT lower(replace(p_name, ' ', '_')) AS t FROM part), p AS (SELECT a.t AS a, b.t AS b, len(list_intersect(string_split(a.t, '_'), string_split(b.t, '_'))) / greatest(len(list_distinct(string_split(a.t, '_'))), len(list_distinct(string_split(b.t, '_')))) AS s FROM t a JOIN t b ON a.t <> b.t) SELECT a, b, round(s, 6) AS similarity FROM p WHERE s > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 3")
def similar_domains(spark, sf_dir):
    """The three types (here names) that share the largest part of their words with each; only pairs with a shared word meet."""
    t = table(spark, sf_dir, "part").select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("t")).distinct().select("t", F.array_distinct(F.split("t", "_")).alias("w"))
    word = lambda name: t.select(F.col("t").alias(name), F.size("w").alias(f"n_{name}"), F.explode("w").alias("word"))
    pairs = word("a").join(word("b"), "word").where("a != b").groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("n"))
    s = pairs.select("a", "b", F.round(F.col("n") / F.greatest("n_a", "n_b"), 9).alias("s"))
    return evidence.top_per_group(s, ["a"], [F.col("s").desc(), F.col("b")], 3).select("a", "b", F.round("s", 6).alias("similarity"))


@register("context_memories", f"""WITH {REFLECTIONS}, h AS (SELECT id, ts, 0 AS part FROM r WHERE contains(lower(task), 'browser') QUALIFY row_number() OVER (ORDER BY ts DESC, id) <= 10), n AS (SELECT id, ts, 1 AS part FROM r QUALIFY row_number() OVER (ORDER BY ts DESC, id) <= 10),
u AS (SELECT id, min(part) AS part, max(ts) AS ts FROM (SELECT * FROM h UNION ALL SELECT * FROM n) GROUP BY 1) SELECT id, part FROM u ORDER BY part, ts DESC, id LIMIT 15""")
def context_memories(spark, sf_dir):
    """Relevant memories first, then recent ones, each once, 15 in all."""
    r = reflections(spark, sf_dir).select("id", "ts", "task")
    newest = [F.col("ts").desc(), F.col("id")]
    hits = r.where(F.contains(F.lower("task"), F.lit("browser"))).orderBy(*newest).limit(10).withColumn("part", F.lit(0))
    both = hits.unionByName(r.orderBy(*newest).limit(10).withColumn("part", F.lit(1)))
    return both.groupBy("id").agg(F.min("part").alias("part"), F.max("ts").alias("ts")).orderBy("part", *newest).limit(15).select("id", "part")
