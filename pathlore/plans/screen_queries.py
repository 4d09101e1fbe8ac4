"""Queries of screen elements, clicks and requests, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.functions import patterns as p
from pathlore.functions import text as tx
from pathlore.operators import evidence, retrieval, screen
from pathlore.plans.derived import CLICKS, ELEMENTS, PHRASES, clicks, elements, sql_list, sql_phrase
from pathlore.plans.registry import register
from pathlore.plans.retrieval_queries import ASKED, STATE, _phrases

MIDDLE = "sqrt((e.x + e.w / 2.0 - c.x) ** 2 + (e.y + e.h / 2.0 - c.y) ** 2)"
NEAR = f"{ELEMENTS}, {CLICKS}, d AS (SELECT c.click, e.*, {MIDDLE} AS d FROM cl c JOIN el e ON abs(e.x + e.w / 2.0 - c.x) <= 80 AND abs(e.y + e.h / 2.0 - c.y) <= 80)"


def _middles(spark, sf_dir):
    e = elements(spark, sf_dir)
    return e.select("key", (F.col("x") + F.col("w") / 2).alias("px"), (F.col("y") + F.col("h") / 2).alias("py"))


@register("nearest_element", f"""WITH {NEAR}, b AS (SELECT click, arg_min(key, (d, key)) AS key, min(d) AS d FROM d WHERE d <= 50 GROUP BY 1)
SELECT click, b.key, round(d, 6) AS distance, round(least(1, 0.5 + CASE WHEN d < 5 THEN 0.4 WHEN d < 15 THEN 0.3 WHEN d < 30 THEN 0.15 ELSE 0.05 END + CASE WHEN length(label) > 0 THEN 0.1 ELSE 0 END + CASE WHEN list_contains(actions, 'AXPress') THEN 0.05 ELSE 0 END), 6) AS confidence FROM b JOIN el ON el.key = b.key""")
def nearest_element(spark, sf_dir):
    """The element within 50 px whose middle is nearest to each click, and how sure that is."""
    near = screen.nearest(clicks(spark, sf_dir), _middles(spark, sf_dir), 50, "click", "key")
    e = elements(spark, sf_dir).select("key", "label", "actions")
    return near.join(e, "key").select("click", "key", F.round("distance", 6).alias("distance"), F.round(screen.confidence(F.col("distance"), F.col("label"), F.col("actions")), 6).alias("confidence"))


@register("elements_near", f"WITH {NEAR} SELECT click, count(*) AS n, min(key) AS first_key FROM d WHERE d <= 80 GROUP BY 1")
def elements_near(spark, sf_dir):
    return screen.count_within(clicks(spark, sf_dir), _middles(spark, sf_dir), 80, "click", "key").withColumnRenamed("first", "first_key")


@register("snapped_clicks", f"""WITH {ELEMENTS}, {CLICKS}, s AS (SELECT c.click, arg_min(e.key, (sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2), e.key)) AS key FROM cl c JOIN el e ON sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2) <= 30 WHERE NOT (c.click % 2 = 0 AND c.y > 100) GROUP BY 1)
SELECT c.click, coalesce(e.x, c.x) AS x, coalesce(e.y, c.y) AS y, s.key IS NOT NULL AS snapped FROM cl c LEFT JOIN s ON s.click = c.click LEFT JOIN el e ON e.key = s.key""")
def snapped_clicks(spark, sf_dir):
    """Clicks moved to the nearest element within 30 px; in a browser (even clicks here) not below the tool bar."""
    c, e = clicks(spark, sf_dir), elements(spark, sf_dir).select("key", F.col("x").alias("px"), F.col("y").alias("py"))
    near = screen.nearest(c.where("not (click % 2 = 0 and y > 100)"), e, 30, "click", "key").join(e, "key").select("click", "px", "py")
    return c.join(near, "click", "left").select("click", F.coalesce("px", "x").alias("x"), F.coalesce("py", "y").alias("y"), F.col("px").isNotNull().alias("snapped"))


@register("action_targets", f"""WITH {ELEMENTS}, {CLICKS}, s AS (SELECT c.click, arg_min(e.key, (sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2), e.key)) AS key, min(sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2)) AS d FROM cl c JOIN el e ON sqrt((e.x - c.x) ** 2 + (e.y - c.y) ** 2) <= 80 GROUP BY 1)
SELECT click, coalesce(label, '(unlabeled)') AS label, role, round(d)::BIGINT AS distance FROM s JOIN el ON el.key = s.key""")
def action_targets(spark, sf_dir):
    """What each click was on: the nearest element within 80 px."""
    e = elements(spark, sf_dir).select("key", "label", "role", F.col("x").alias("px"), F.col("y").alias("py"))
    near = screen.nearest(clicks(spark, sf_dir), e.select("key", "px", "py"), 80, "click", "key")
    return near.join(e, "key").select("click", F.coalesce("label", F.lit("(unlabeled)")).alias("label"), "role", F.round("distance").cast("long").alias("distance"))


@register("resolved_actions", f"""WITH {ELEMENTS}, a AS (SELECT key AS action, role, CASE WHEN key % 3 = 0 THEN label || 'x' ELSE label END AS label, CASE WHEN key % 7 = 0 THEN 'AXRow' ELSE role END AS wanted, path FROM el),
x AS (SELECT role, lower(label) AS label, min(key) AS key FROM el WHERE label IS NOT NULL GROUP BY 1, 2), y AS (SELECT role, min(key) AS key FROM el GROUP BY 1), z AS (SELECT path, min(key) AS key FROM el GROUP BY 1),
f AS (SELECT q.label, min(x.key) AS key FROM (SELECT DISTINCT lower(label) AS label FROM a WHERE label IS NOT NULL AND wanted = 'AXRow') q JOIN (SELECT lower(label) AS label, min(key) AS key FROM el WHERE label IS NOT NULL GROUP BY 1) x ON 1 - levenshtein(q.label, x.label) / greatest(length(q.label), length(x.label)) > 0.7 GROUP BY 1)
SELECT action, CASE WHEN a.label IS NULL THEN CASE WHEN z.key IS NOT NULL THEN 'path' END WHEN x.key IS NOT NULL THEN 'exact' WHEN coalesce(y.key, f.key) IS NOT NULL THEN 'fuzzy' WHEN z.key IS NOT NULL THEN 'path' END AS method,
  CASE WHEN a.label IS NULL THEN z.key ELSE coalesce(x.key, y.key, f.key, z.key) END AS key FROM a LEFT JOIN x ON x.role = a.wanted AND x.label = lower(a.label) LEFT JOIN y ON y.role = a.wanted LEFT JOIN f ON f.label = lower(a.label) LEFT JOIN z ON z.path = a.path""")
def resolved_actions(spark, sf_dir):
    """The element of each recorded action: by role and label, else the first of its role (or of a near label, where the role is gone), else by path.

    The actions are the elements' own, some with another label or role.
    """
    e = elements(spark, sf_dir)
    wanted = F.when(F.col("key") % 7 == 0, "AXRow").otherwise(F.col("role"))
    a = e.select(F.col("key").alias("action"), F.lower(F.when(F.col("key") % 3 == 0, F.concat("label", F.lit("x"))).otherwise(F.col("label"))).alias("label"), wanted.alias("role"), "path")
    low = e.where("label is not null").withColumn("label", F.lower("label"))
    exact = low.groupBy("role", "label").agg(F.min("key").alias("exact"))
    role = e.groupBy("role").agg(F.min("key").alias("of_role"))
    path = e.groupBy("path").agg(F.min("key").alias("of_path"))
    gone = a.where("label is not null").join(role.select("role"), "role", "left_anti").select(F.col("label").alias("q")).distinct()
    labels = low.groupBy("label").agg(F.min("key").alias("key"))
    near = retrieval.against_blocks(labels, gone, tx.edit_similarity(F.col("q"), F.col("label")) > 0.7).groupBy(F.col("q").alias("label")).agg(F.min("key").alias("near"))
    own = a.join(exact, ["role", "label"], "left").join(role, "role", "left").join(near, "label", "left").join(path, "path", "left")
    found = F.coalesce("of_role", "near")
    named = F.col("label").isNotNull()
    method = F.when(named & F.col("exact").isNotNull(), "exact").when(named & found.isNotNull(), "fuzzy").when(F.col("of_path").isNotNull(), "path")
    return own.select("action", method.alias("method"), F.when(named, F.coalesce("exact", found, "of_path")).otherwise(F.col("of_path")).alias("key"))


_B = "\\b"
PARSED = f"""pa AS (SELECT q, CASE WHEN regexp_extract(phrase, '\\b({p.ACTION_WORDS})\\b', 1, 'i') = '' THEN 'click' ELSE lower(regexp_extract(phrase, '\\b({p.ACTION_WORDS})\\b', 1, 'i')) END AS action,
  trim(regexp_replace(trim(regexp_replace(phrase, '\\b({p.ACTION_WORDS}|the|a|an|on|in)\\b', '', 'gi')), '\\bin ({p.PLACE_WORDS})\\b', '', 'gi')) AS target, list_transform(regexp_extract_all(phrase, '\\bin ({p.PLACE_WORDS})\\b', 1, 'i'), lambda m: lower(m)) AS modifiers FROM rq)"""
ROLE_SQL = "CASE action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.ROLE_OF_ACTION.items()) + " END"
#: Requests: the phrases, and phrases about names of parts.
REQUESTS = f"{ASKED}, rq AS (SELECT q, phrase FROM qs UNION ALL SELECT 1000 + min(p_partkey), CASE min(p_partkey) % 3 WHEN 0 THEN 'Click ' || p_name WHEN 1 THEN 'Press ' || p_name || 's in dialog' ELSE 'toggle ' || split_part(p_name, ' ', 2) || ' in sidebar' END FROM part GROUP BY p_name)"


def _requests(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_name").agg(F.min("p_partkey").alias("k"))
    k, name = F.col("k"), F.col("p_name")
    text = F.when(k % 3 == 0, F.concat(F.lit("Click "), name)).when(k % 3 == 1, F.concat(F.lit("Press "), name, F.lit("s in dialog"))).otherwise(F.concat(F.lit("toggle "), F.split_part(name, F.lit(" "), F.lit(2)), F.lit(" in sidebar")))
    return _phrases(spark).unionByName(n.select((k + 1000).alias("q"), text.alias("phrase")))


@register("parsed_requests", f"WITH {REQUESTS}, {PARSED} SELECT q, action, target, array_to_string(modifiers, ',') AS modifiers, {ROLE_SQL} AS role FROM pa")
def parsed_requests(spark, sf_dir):
    r = _requests(spark, sf_dir).select("q", screen.parsed(F.col("phrase")).alias("r"))
    return r.select("q", "r.action", "r.target", F.array_join("r.modifiers", ",").alias("modifiers"), "r.role")


FITS = "CASE WHEN " + " OR ".join(f"(action = '{k}' AND role IN ({', '.join(repr(x) for x in v)}))" for k, v in p.FITTING_ROLES.items()) + " THEN 1.0 ELSE 0.3 END"
NEEDED = "CASE action " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.OFFERED_ACTION.items()) + " END"
SAME = "CASE WHEN label IS NULL OR length(target) = 0 THEN 0 ELSE 1 - levenshtein(lower(label), lower(target)) / greatest(length(label), length(target)) END"
PLACE = "CASE WHEN len(modifiers) = 0 THEN 1.0 ELSE len(list_filter(modifiers, lambda m: contains(lower(path), m))) / len(modifiers) END"
SHAPES = f"{ELEMENTS}, sh AS (SELECT role, label, path, actions, min(key) AS key FROM el GROUP BY 1, 2, 3, 4)"


def _shapes(spark, sf_dir):
    """Elements that differ in more than their place, each once: what a request can tell apart."""
    return elements(spark, sf_dir).groupBy("role", "label", "path", "actions").agg(F.min("key").alias("key")).withColumnRenamed("role", "own")


@register("relevant_elements", f"""WITH {SHAPES}, {REQUESTS}, {PARSED}, s AS (SELECT q, key, round(0.4 * {SAME} + 0.3 * {FITS} + 0.2 * {PLACE} + 0.1 * CASE WHEN {NEEDED} IS NULL OR list_contains(actions, {NEEDED}) THEN 1 ELSE 0 END, 9) AS score FROM sh, pa)
SELECT q, key, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, key) <= 3""")
def relevant_elements(spark, sf_dir):
    """The three elements that fit each request best."""
    r = _requests(spark, sf_dir).select("q", screen.parsed(F.col("phrase")).alias("r"))
    score = screen.relevance(F.col("r"), F.col("own"), F.col("label"), F.col("path"), F.col("actions"))
    scored = retrieval.against_blocks(_shapes(spark, sf_dir), r, F.lit(True)).select("q", "key", F.round(score, 9).alias("score"))
    return retrieval.top(scored, "key", "score", 3).select("q", "key", F.round("score", 6).alias("score"))


@register("found_elements", f"""WITH {SHAPES}, {REQUESTS}, {PARSED}, t AS (SELECT q, key, CASE WHEN lower(label) = lower(target) THEN 1 WHEN {SAME} > 0.7 THEN 2 WHEN role = {ROLE_SQL} AND contains(lower(label), lower(target)) THEN 3 WHEN len(modifiers) > 0 AND {PLACE} = 1 AND contains(lower(label), lower(target)) THEN 4 END AS tier FROM sh, pa)
SELECT q, tier, count(*) AS n, min(key) AS first_key FROM t WHERE tier IS NOT NULL GROUP BY 1, 2 QUALIFY tier = min(tier) OVER (PARTITION BY q)""")
def found_elements(spark, sf_dir):
    """What the first way that finds anything finds for each request."""
    r = _requests(spark, sf_dir).select("q", screen.parsed(F.col("phrase")).alias("r"))
    tier = screen.search_tier(F.col("r"), F.col("own"), F.col("label"), F.col("path"))
    t = retrieval.against_blocks(_shapes(spark, sf_dir), r, F.lit(True)).select("q", "key", tier.alias("tier")).where("tier is not null")
    by = t.groupBy("q", "tier").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))
    return by.groupBy("q").agg(F.min(F.struct("tier", "n", "first_key")).alias("b")).select("q", "b.*")


@register("titles_found", """WITH n AS (SELECT lower(p_name) AS t, min(p_partkey) AS key FROM part GROUP BY 1), q AS (SELECT DISTINCT split_part(t, ' ', 1) AS q FROM n UNION SELECT t FROM n WHERE key % 5 = 0),
s AS (SELECT q, key, CASE WHEN t = q THEN 3 WHEN starts_with(t, q) THEN 2 WHEN contains(t, q) OR contains(q, t) THEN 1 END AS s FROM n, q)
SELECT q, arg_max(key, (s, -key)) AS key, max(s) = 3 AS exact, CASE WHEN max(s) < 3 THEN count(*) - 1 END AS alternatives FROM s WHERE s IS NOT NULL GROUP BY 1""")
def titles_found(spark, sf_dir):
    """The element whose title fits each query best, and how many others would do."""
    n = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy(F.lower("p_name").alias("t")).agg(F.min("p_partkey").alias("key"))
    q = n.select(F.split_part("t", F.lit(" "), F.lit(1)).alias("q")).union(n.where("key % 5 = 0").select("t")).distinct()
    s = retrieval.against_blocks(n, q, F.lit(True)).select("q", "key", screen.title_score(F.col("t"), F.col("q")).alias("s")).where("s is not null")
    best = s.groupBy("q").agg(F.max_by("key", F.struct("s", -F.col("key"))).alias("key"), F.max("s").alias("s"), F.count("*").alias("n"))
    return best.select("q", "key", (F.col("s") == 3).alias("exact"), F.when(F.col("s") < 3, F.col("n") - 1).alias("alternatives"))


HAY = "lower(coalesce(label, '') || ' ' || role)"
HITS = f"ph AS (SELECT i - 1 AS q, {STATE.format('(' + sql_list(PHRASES) + ')[i]')} AS terms FROM range(1, {len(PHRASES) + 1}) x(i)), hy AS (SELECT DISTINCT {HAY} AS h FROM el), hi AS (SELECT q, len(terms) AS terms, max(len(list_filter(terms, lambda t: contains(h, t)))) AS hits FROM ph, hy GROUP BY q, terms)"


def _hits(spark, sf_dir):
    """(q, terms, hits): for each phrase its terms and how many of them the element with most has."""
    h = elements(spark, sf_dir).select(F.lower(F.concat_ws(" ", F.coalesce("label", F.lit("")), "role")).alias("h")).distinct()
    q = spark.createDataFrame(list(enumerate(PHRASES)), "q long, phrase string").select("q", tx.state_terms(F.col("phrase"), p.STATE_STOPS).alias("terms"))
    pairs = retrieval.against_blocks(h, q, F.lit(True)).select("q", F.size("terms").alias("terms"), screen.state_hits(F.col("terms"), F.col("h")).alias("hits"))
    return pairs.groupBy("q", "terms").agg(F.max("hits").alias("hits"))


@register("state_checks", f"WITH {ELEMENTS}, {HITS} SELECT q, terms, hits, hits >= 2 OR (terms > 0 AND hits / terms >= 0.5) AS matched FROM hi")
def state_checks(spark, sf_dir):
    """Whether an element shows what each phrase expects."""
    hits, terms = F.col("hits"), F.col("terms")
    return _hits(spark, sf_dir).select("q", terms.cast("long").alias("terms"), hits.cast("long").alias("hits"), ((hits >= 2) | ((terms > 0) & (hits / F.greatest(terms, F.lit(1)) >= 0.5))).alias("matched"))


@register("validated_steps", f"""WITH {ELEMENTS}, {CLICKS}, {HITS}, n AS (SELECT count(*) AS n FROM el), s AS (SELECT c.click, {MIDDLE} AS d, h.hits, h.terms FROM cl c JOIN n ON true JOIN el e ON e.key = c.click % n LEFT JOIN hi h ON h.q = c.click % {len(PHRASES)} AND c.click % 3 = 0)
SELECT click, CASE WHEN d > 80 THEN 'incorrect' WHEN hits IS NOT NULL THEN CASE WHEN terms > 0 AND (hits >= 2 OR hits / terms >= 0.5) THEN 'correct' ELSE 'incorrect' END WHEN d <= 40 THEN 'correct' ELSE 'partial' END AS verdict FROM s""")
def validated_steps(spark, sf_dir):
    """Whether each click was right: too far from its target, else by the state where it is known (every third click), else by nearness."""
    m = _middles(spark, sf_dir)
    c = clicks(spark, sf_dir).crossJoin(F.broadcast(m.agg(F.count("*").alias("n")))).withColumn("key", F.col("click") % F.col("n"))
    own = c.join(m, "key").withColumn("q", F.when(F.col("click") % 3 == 0, F.col("click") % len(PHRASES)))
    far = screen.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py"))
    return own.join(F.broadcast(_hits(spark, sf_dir)), "q", "left").select("click", screen.step_verdict(far, F.col("hits"), F.col("terms")).alias("verdict"))


@register("semantic_actions", f"""WITH {ELEMENTS}, a AS (SELECT key, CASE WHEN key % 13 <> 0 THEN 'click' END AS type, CASE WHEN key % 11 <> 0 THEN role END AS role, label, CASE WHEN key % 6 <> 0 THEN path END AS path, CASE WHEN key % 10 = 0 THEN [x] ELSE [x, y] END AS c FROM el)
SELECT key, coalesce(role, '') <> '' AND label IS NOT NULL AS semantic, CASE WHEN coalesce(role, '') <> '' AND label IS NOT NULL THEN role || '[' || label || ']' ELSE 'coordinate-only action' END AS description, CASE WHEN len(c) = 2 THEN c[1] END AS x,
  array_to_string(list_filter([CASE WHEN type IS NULL THEN 'Missing action type' END, CASE WHEN role IS NULL THEN 'Missing target.role' END, CASE WHEN label IS NULL THEN 'Missing target.label' END, CASE WHEN path IS NULL THEN 'Missing target.path' END, CASE WHEN len(c) <> 2 THEN 'Missing or invalid fallback coordinates' END], lambda e: e IS NOT NULL), '|') AS errors FROM a""")
def semantic_actions(spark, sf_dir):
    """Shape, description, point and violations of semantic actions (the elements', some with parts missing)."""
    k = F.col("key")
    a = elements(spark, sf_dir).select("key", F.when(k % 13 != 0, "click").alias("type"), F.when(k % 11 != 0, F.col("role")).alias("role"), "label", F.when(k % 6 != 0, F.col("path")).alias("path"), F.when(k % 10 == 0, F.array("x")).otherwise(F.array("x", "y")).alias("c"))
    role, label = F.col("role"), F.col("label")
    return a.select("key", screen.is_semantic(role, label).alias("semantic"), screen.description(role, label).alias("description"), F.when(F.size("c") == 2, F.col("c")[0]).alias("x"), F.array_join(screen.violations(F.col("type"), role, label, F.col("path"), F.col("c")), "|").alias("errors"))


@register("element_paths", """SELECT p_partkey, '/AXApplication/AXWindow' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '/' || p_type END || '/' || CASE WHEN p_size % 4 = 0 THEN 'AXUnknown' ELSE 'AXButton' END || CASE WHEN p_size % 5 = 0 THEN '' ELSE '[' || p_name || ']' END AS path FROM part""")
def element_paths(spark, sf_dir):
    """Paths of raw elements (parts with some fields missing)."""
    s = F.col("p_size")
    path = screen.path_of(F.when(s % 4 != 0, "AXButton"), F.when(s % 5 != 0, F.col("p_name")), F.when(s % 3 == 0, "").otherwise(F.col("p_type")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", path.alias("path"))


@register("picture_needed", f"""WITH s AS (SELECT p_brand, count(*) AS n, bool_or(p_size = 49) AS bare, string_agg(DISTINCT lower(p_name), '|') AS names, min(p_partkey) AS k FROM part GROUP BY 1),
t AS (SELECT *, CASE k % 3 WHEN 0 THEN 'Click the red icon' WHEN 1 THEN 'Compare the drawing' ELSE 'Save it' END AS task FROM s), w AS (SELECT *, lower(regexp_extract(task, '\\b({p.COLOUR_WORDS})\\b', 1, 'i')) AS colour, lower(regexp_extract(task, '\\b({p.PICTURE_WORDS})\\b', 1, 'i')) AS kind FROM t)
SELECT p_brand, n < 10 OR bare OR (regexp_matches(task, '\\b({p.VISUAL_WORDS})\\b', 'i') AND NOT contains(names, CASE WHEN colour <> '' THEN colour ELSE kind END)) AS needed FROM w""")
def picture_needed(spark, sf_dir):
    """Whether the picture is needed for a task on each screen (here a brand's parts)."""
    s = spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").agg(F.count("*").alias("n"), F.bool_or(F.col("p_size") == 49).alias("bare"), F.collect_set("p_name").alias("names"), F.min("p_partkey").alias("k"))
    task = F.when(F.col("k") % 3 == 0, "Click the red icon").when(F.col("k") % 3 == 1, "Compare the drawing").otherwise("Save it")
    return s.select("p_brand", screen.needs_picture(F.col("n"), F.col("bare"), F.col("names"), task).alias("needed"))


@register("element_search", f"""WITH {ELEMENTS}, c AS (SELECT DISTINCT role, CASE WHEN key % 2 = 0 THEN lower(label) ELSE label || 'z' END AS label FROM el WHERE key % 9 = 0 AND label IS NOT NULL),
x AS (SELECT c.role, c.label, count(*) AS n, min(key) AS key FROM c JOIN el e ON e.role = c.role AND lower(e.label) = lower(c.label) GROUP BY 1, 2),
f AS (SELECT c.role, c.label, count(*) AS n, min(key) AS key FROM c JOIN el e ON 1 - levenshtein(lower(e.label), lower(c.label)) / greatest(length(e.label), length(c.label)) > 0.7 WHERE (c.role, c.label) NOT IN (SELECT role, label FROM x) GROUP BY 1, 2)
SELECT *, 'exact' AS way FROM x UNION ALL SELECT *, 'near' AS way FROM f""")
def element_search(spark, sf_dir):
    """Elements of a role and label; where there is none, those of any role with a near label. Labels are compared once each."""
    e = elements(spark, sf_dir)
    c = e.where("key % 9 = 0 and label is not null").select("role", F.when(F.col("key") % 2 == 0, F.lower("label")).otherwise(F.concat("label", F.lit("z"))).alias("label")).distinct()
    low = e.where("label is not null").select("role", F.lower("label").alias("low"), "key")
    x = c.withColumn("low", F.lower("label")).join(low, ["role", "low"]).groupBy("role", "label").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    rest = c.join(x, ["role", "label"], "left_anti")
    names = low.groupBy("low").agg(F.count("*").alias("n"), F.min("key").alias("key"))
    near = retrieval.against_blocks(names, rest, tx.edit_similarity(F.lower("label"), F.col("low")) > 0.7).groupBy("role", "label").agg(F.sum("n").alias("n"), F.min("key").alias("key"))
    return x.withColumn("way", F.lit("exact")).unionByName(near.withColumn("way", F.lit("near")))


@register("similar_approach", f"WITH {ELEMENTS}, k AS (SELECT key, list_filter(string_split(lower('click ' || coalesce(label, '')), ' '), lambda w: length(w) > 3) AS w, lower({sql_phrase('key')}) || ' ' || CASE WHEN key % 2 = 0 THEN coalesce(label, '') ELSE '' END AS approach FROM el) SELECT key, len(list_filter(w, lambda x: contains(approach, x))) > 0 AS similar_to FROM k")
def similar_approach(spark, sf_dir):
    """Whether a longer word of an action is in the approach of a run (here a phrase)."""
    from pathlore.plans.derived import phrase

    label = F.coalesce("label", F.lit(""))
    approach = F.concat(F.lower(phrase(F.col("key"))), F.lit(" "), F.when(F.col("key") % 2 == 0, label).otherwise(F.lit("")))
    words = F.filter(F.split(F.lower(F.concat(F.lit("click "), label)), " "), lambda w: F.length(w) > 3)
    return elements(spark, sf_dir).select("key", F.exists(words, lambda w: F.contains(approach, w)).alias("similar_to"))


@register("usage_by_place", f"WITH {ELEMENTS} SELECT split_part(path, '/', 4) AS place, role, count(*) AS n FROM el GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY place ORDER BY n DESC, role) <= 2")
def usage_by_place(spark, sf_dir):
    n = elements(spark, sf_dir).groupBy(F.split_part("path", F.lit("/"), F.lit(4)).alias("place"), "role").agg(F.count("*").alias("n"))
    return evidence.top_per_group(n, ["place"], [F.col("n").desc(), F.col("role")], 2)
