"""Full-text search: stems, ranks and snippets, over one pass of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathlore.functions.stems import stem
from pathlore.operators.merging import written

WINDOW, K1, B = 32, 1.2, 0.75
_TOKEN = r"[\p{L}\p{N}]+"


def shown(text: Column) -> Column:
    """Runs of letters and digits."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return shown(F.lower(text))


def token_hits(docs: DataFrame, key: str, tokens: Column, wanted: DataFrame) -> DataFrame:
    """(key, size, pos, term): a row for each token that ``wanted`` (word, term) has, and one without a term for each document; written.

    The one pass over the texts: counts of documents and sizes, document and term frequencies and places all come from it.
    """
    each = docs.select(key, tokens.alias("_t")).select(key, F.size("_t").cast("long").alias("size"), F.posexplode_outer("_t").alias("pos", "word"))
    hits = each.join(wanted.select("word", "term"), "word", "left").where("term IS NOT NULL OR coalesce(pos, 0) = 0").select(key, "size", "pos", "term")
    # a document's first token may be a hit, too
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    rows = F.array_union(F.when(first, F.array(F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("term")))).otherwise(F.array().cast("array<struct<pos:int,term:string>>")),
                         F.when(F.col("term").isNotNull(), F.array(F.struct("pos", "term"))).otherwise(F.array().cast("array<struct<pos:int,term:string>>")))
    return written(hits.select(key, "size", F.explode(rows).alias("r")).select(key, "size", "r.pos", "r.term"), "hits")


def collection(hits: DataFrame) -> DataFrame:
    """(n, mean): number of documents and their mean size."""
    return hits.where("term IS NULL").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))


def frequencies(hits: DataFrame, key: str) -> DataFrame:
    """(key, size, term, tf)."""
    return hits.where("term IS NOT NULL").groupBy(key, "size", "term").agg(F.count("*").alias("tf"))


def smooth_idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def engine_idf(n: Column, df: Column) -> Column:
    """As full-text engines have it that don't let a common term count against a document: a millionth at least."""
    own = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(own <= 0, 1e-6).otherwise(own)


def ranked(hits: DataFrame, key: str, queries: DataFrame, idf=smooth_idf, every: bool = True, k1: float = K1, b: float = B) -> DataFrame:
    """(q, key, score) by BM25 of the documents that hold all terms (or any) of a query, from ``queries`` (q, term), each pair once."""
    tf = frequencies(hits, key)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    terms = queries.join(df, "term").crossJoin(F.broadcast(collection(hits))).join(queries.groupBy("q").agg(F.count("*").alias("terms")), "q")
    found = tf.join(terms, "term").groupBy("q", key, "terms").agg(F.sum(weight).alias("score"), F.count("*").alias("held"))
    return (found.where("held = terms") if every else found).select("q", key, "score")


def stemmed_words(docs: DataFrame, tokens: Column, terms: DataFrame) -> DataFrame:
    """(word, term): the words of the documents whose stem is one of ``terms`` (term); each distinct word is stemmed once. Written.

    All stems are written before they are joined: a join's filter of its key would be pushed below ``distinct``, and stem each token.
    """
    words = docs.select(F.explode(tokens).alias("word")).distinct()
    stems = written(words.select("word", stem(F.col("word")).alias("term")), "stems")
    return written(stems.join(terms.select("term").distinct(), "term", "left_semi").select("word", "term"), "words")


def best_windows(hits: DataFrame, key: str, found: DataFrame, queries: DataFrame, window: int = WINDOW) -> DataFrame:
    """(q, key, start, places): for each of ``found`` (q, key) the window of so many tokens with the most different terms of the query, the earliest of equals.

    A window begins at a hit; ``places`` are the hits in it. Work grows with the hits of the documents found.
    """
    own = found.select("q", key).join(queries.select("q", "term"), "q").join(hits.where("term IS NOT NULL").select(key, "pos", "term"), [key, "term"])
    ahead = Window.partitionBy("q", key).orderBy("pos").rangeBetween(0, window - 1)
    each = own.withColumn("terms", F.size(F.collect_set("term").over(ahead))).withColumn("places", F.collect_list("pos").over(ahead))
    best = each.groupBy("q", key).agg(F.max(F.struct("terms", -F.col("pos"), "places")).alias("b"))
    return best.select("q", key, (-F.col("b.col2")).alias("start"), F.col("b.places").alias("places"))


def snippet(words: Column, start: Column, places: Column, window: int = WINDOW, marks: tuple[str, str, str] = (">>>", "<<<", "...")) -> Column:
    """The window's words with the hits marked, and dots where the text goes on."""
    begin, end, dots = marks
    part = F.slice(words, start + 1, F.lit(window))
    marked = F.transform(part, lambda w, i: F.when(F.array_contains(places, (start + i).cast("int")), F.concat(F.lit(begin), w, F.lit(end))).otherwise(w))
    return F.concat(F.when(start > 0, dots).otherwise(""), F.array_join(marked, " "), F.when(start + window < F.size(words), dots).otherwise(""))
