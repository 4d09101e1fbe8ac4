"""Full-text queries: stems, the engine's own ranks, snippets, each beside its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathlore.functions import stems
from pathlore.operators import retrieval, search
from pathlore.operators.merging import written
from pathlore.plans.registry import register
from pathlore.session import table

TOK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"


def _sql_replaced(word: str, endings: dict[str, str]) -> str:
    pattern = f"'^(.+?)({'|'.join(endings)})$'"
    to = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in endings.items()) + "}"
    return f"CASE WHEN regexp_matches({word}, {pattern}) AND regexp_matches(regexp_extract({word}, {pattern}, 1), '{stems.SOME}') THEN regexp_extract({word}, {pattern}, 1) || {to}[regexp_extract({word}, {pattern}, 2)] ELSE {word} END"


def sql_stems(words: str) -> str:
    """SQL: CTEs s0 to s8 from a table of ``words`` (word) to (word, x); s9 has (word, stem)."""
    has = lambda x, pattern: f"regexp_matches({x}, '{pattern}')"
    cut = lambda x, pattern: f"regexp_extract({x}, '{pattern}', 1)"
    past, fourth = cut("x", "^(.+?)(ed|ing)$"), cut("x", f"^(.+?)({'|'.join(stems.FOURTH)})$")
    double = f"{has('z', '[^aeiouylsz]$')} AND length(z) > 1 AND right(z, 1) = substr(z, length(z) - 1, 1)"
    steps = [
        f"SELECT word, CASE WHEN {has('x', '^.+(ss|i)es$')} THEN left(x, length(x) - 2) WHEN {has('x', '^.+[^s]s$')} THEN left(x, length(x) - 1) ELSE x END AS x FROM s0",
        f"SELECT word, CASE WHEN {has('x', '^.+eed$')} THEN CASE WHEN {has(cut('x', '^(.+?)eed$'), stems.SOME)} THEN left(x, length(x) - 1) ELSE x END WHEN {has('z', stems.VOWEL)} THEN CASE WHEN {has('z', '(at|bl|iz)$')} THEN z || 'e' WHEN {double} THEN left(z, length(z) - 1) WHEN {has('z', stems.SHORT)} THEN z || 'e' ELSE z END ELSE x END AS x FROM (SELECT *, {past} AS z FROM s1)",
        f"SELECT word, CASE WHEN {has(cut('x', '^(.+?)y$'), stems.VOWEL)} THEN {cut('x', '^(.+?)y$')} || 'i' ELSE x END AS x FROM s2",
        f"SELECT word, {_sql_replaced('x', stems.SECOND)} AS x FROM s3",
        f"SELECT word, {_sql_replaced('x', stems.THIRD)} AS x FROM s4",
        f"SELECT word, CASE WHEN z <> '' THEN CASE WHEN {has('z', stems.MORE)} THEN z ELSE x END WHEN {has('i', stems.MORE)} THEN i ELSE x END AS x FROM (SELECT *, {fourth} AS z, {cut('x', '^(.+?[st])ion$')} AS i FROM s5)",
        f"SELECT word, CASE WHEN {has('z', stems.MORE)} OR {has('z', stems.ONE)} AND NOT {has('z', stems.SHORT)} THEN z ELSE x END AS x FROM (SELECT *, {cut('x', '^(.+?)e$')} AS z FROM s6)",
        f"SELECT word, CASE WHEN {has('x', 'll$')} AND {has('x', stems.MORE)} THEN left(x, length(x) - 1) ELSE x END AS x FROM s7",
    ]
    first = f"s0 AS (SELECT DISTINCT word, regexp_replace(word, '^y', 'Y') AS x FROM {words})"
    last = "s9 AS (SELECT word, CASE WHEN length(word) < 3 OR length(word) > 64 THEN word ELSE regexp_replace(x, '^Y', 'y') END AS stem FROM s8)"
    return ", ".join([first, *(f"s{i + 1} AS ({s})" for i, s in enumerate(steps)), last])


_ASKED = f"SELECT item_id AS q, unnest(list_distinct({TOK.format('text')}[1:3])) AS word FROM benchmark WHERE item_id % 10 = 0"


def _asked(spark, sf_dir, words=3):
    q = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0")
    return q.select(F.col("item_id").alias("q"), F.explode(F.array_distinct(F.slice(search.search_tokens(F.col("text")), 1, words))).alias("word"))


@register("word_stems", f"WITH w AS (SELECT unnest({TOK.format('text')}) AS word FROM documents), {sql_stems('w')} SELECT word, stem FROM s9")
def word_stems(spark, sf_dir):
    """The stem of each distinct word of all documents."""
    words = table(spark, sf_dir, "documents").select(F.explode(search.search_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", stems.stem(F.col("word")).alias("stem"))


@register(
    "stem_search",
    f"""WITH d AS (SELECT doc_id, unnest({TOK.format('text')}) AS word FROM documents), a AS ({_ASKED}), w AS (SELECT word FROM d UNION SELECT word FROM a), {sql_stems('w')},
qs AS (SELECT DISTINCT q, stem FROM a JOIN s9 USING (word)), sz AS (SELECT doc_id, len({TOK.format('text')}) AS size FROM documents), st AS (SELECT count(*) AS n, avg(coalesce(size, 0)) AS mean FROM sz),
tf AS (SELECT doc_id, stem, count(*) AS tf FROM d JOIN s9 USING (word) GROUP BY 1, 2), df AS (SELECT stem, count(*) AS df, CASE WHEN ln((n - count(*) + 0.5) / (count(*) + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - count(*) + 0.5) / (count(*) + 0.5)) END AS idf FROM tf, st GROUP BY stem, n),
f AS (SELECT q, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score, count(*) AS held FROM qs JOIN tf USING (stem) JOIN df USING (stem) JOIN sz USING (doc_id), st GROUP BY 1, 2),
h AS (SELECT f.* FROM f JOIN (SELECT q, count(*) AS terms FROM qs GROUP BY 1) t ON t.q = f.q AND held = terms)
SELECT q, doc_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM h) WHERE rank <= 10""",
)
def stem_search(spark, sf_dir):
    """The ten documents that rank first for each query by the stems of its words, as a full-text engine ranks them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = written(_asked(spark, sf_dir).select("q", stems.stem(F.col("word")).alias("term")).distinct(), "asked")
    tokens = search.search_tokens(F.col("text"))
    hits = search.token_hits(docs, "doc_id", tokens, search.stemmed_words(docs, tokens, asked))
    scored = search.ranked(hits, "doc_id", asked, search.engine_idf).withColumn("score", F.round("score", 9))
    return retrieval.top(scored, "doc_id", "score", 10).select("q", "doc_id", F.round("score", 6).alias("score"), "rank")


@register(
    "search_snippets",
    rf"""WITH a AS ({_ASKED}), x AS (SELECT doc_id, {TOK.format('text')} AS t, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+') AS shown FROM documents), st AS (SELECT count(*) AS n, avg(coalesce(len(t), 0)) AS mean FROM x),
d AS (SELECT doc_id, len(t) AS size, unnest(t) AS word, unnest(range(len(t))) AS pos FROM x), tf AS (SELECT doc_id, size, word, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
f AS (SELECT q, doc_id, round(sum(greatest(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM a JOIN tf USING (word) JOIN df USING (word), st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5),
h AS (SELECT r.q, r.doc_id, d.pos, d.word FROM r JOIN a ON a.q = r.q JOIN d ON d.doc_id = r.doc_id AND d.word = a.word),
w AS (SELECT q, doc_id, pos, len(list_distinct(list(word) OVER o)) AS terms, list(pos) OVER o AS places FROM h WINDOW o AS (PARTITION BY q, doc_id ORDER BY pos RANGE BETWEEN CURRENT ROW AND 31 FOLLOWING)),
b AS (SELECT q, doc_id, arg_max({{'s': pos, 'p': places}}, terms * 1000000000 - pos) AS w FROM w GROUP BY 1, 2)
SELECT q, doc_id, rank, round(score, 6) AS score, CASE WHEN w.s > 0 THEN '...' ELSE '' END || array_to_string(list_transform(shown[w.s + 1:w.s + 32], lambda z, i: CASE WHEN list_contains(w.p, w.s + i - 1) THEN '>>>' || z || '<<<' ELSE z END), ' ') || CASE WHEN w.s + 32 < len(shown) THEN '...' ELSE '' END AS snippet
FROM r JOIN b USING (q, doc_id) JOIN x USING (doc_id)""",
)
def search_snippets(spark, sf_dir):
    """The five documents that rank first for any word of each query, with the part of each that has most of the words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    asked = _asked(spark, sf_dir).withColumnRenamed("word", "term")
    hits = search.token_hits(docs, "doc_id", search.search_tokens(F.col("text")), asked.select("term", F.col("term").alias("word")).distinct())
    scored = search.ranked(hits, "doc_id", asked, search.engine_idf, every=False).withColumn("score", F.round("score", 9))
    best = retrieval.top(scored, "doc_id", "score", 5)
    windows = search.best_windows(hits, "doc_id", best, asked)
    text = search.snippet(search.shown(F.col("text")), F.col("start"), F.col("places")).alias("snippet")
    return best.join(windows, ["q", "doc_id"]).join(docs, "doc_id").select("q", "doc_id", "rank", F.round("score", 6).alias("score"), text)
