"""Token and text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as p


def tokens(text: Column) -> Column:
    """Lower-case ASCII letters and digits, tokens of 3 or more."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: F.length(w) > 2)


def jaccard(a: Column, b: Column) -> Column:
    """Of token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less edit distance over the longer length; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def pattern_key(text: Column) -> Column:
    """The first four words of 4 or more letters, lower-case."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: F.length(w) > 3)
    return F.array_join(F.slice(words, 1, 4), " ")


def query_hash(text: Column) -> Column:
    """12 hex digits of the MD5 of the trimmed lower-case text with single spaces."""
    return F.substring(F.md5(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")), 1, 12)


def _without(words: Column, stops: list[str], least: int = 3) -> Column:
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stops))


def index_terms(text: Column) -> Column:
    """Words of 3 or more word characters, less the stop words of the run index."""
    return _without(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s]", " "), r"\s+"), p.INDEX_STOPS)


def topic_terms(text: Column) -> Column:
    """Words of 3 or more letters, digits and hyphens, less the stop words of session topics."""
    return _without(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s-]", " "), r"\s+"), p.TOPIC_STOPS)


def state_terms(text: Column, stops: list[str]) -> Column:
    """Words with only letters and digits kept, of 2 or more, less stop words."""
    bare = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    return _without(bare, stops, 2)


def expectation_terms(text: Column) -> Column:
    """Runs of 3 or more letters and digits, less the stop words of expectations."""
    return _without(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), p.EXPECTATION_STOPS)


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits with single spaces between and around them."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " ")
    return F.concat(F.lit(" "), F.trim(bare), F.lit(" "))


def context_score(app: Column, current: Column, days: Column, uses: Column, name: Column, query: Column, exact_app: bool = False) -> Column:
    """2 for the current application, up to 1 for use in the last 30 days, up to 2 for use, 3 or 1.5 for the name."""
    here = app == current if exact_app else F.contains(app, current) | F.contains(current, app)
    return (
        F.when(here, 2.0).otherwise(0.0)
        + F.when(days <= 30, F.exp(-days / 10)).otherwise(0.0)
        + F.when(uses > 0, F.least(F.lit(2.0), F.log2(uses + 1) * 0.5)).otherwise(0.0)
        + F.when(name == query, 3.0).when(F.contains(name, query) | F.contains(query, name), 1.5).otherwise(0.0)
    )


def fuzzy(query: Column, text: Column) -> Column:
    """1 if the text contains the query, else .5 to .9 by the words that match, else a little by letters in the same order."""
    q, t = F.lower(query), F.lower(text)
    words, own = F.split(q, r"\s+"), F.split(t, r"\s+")
    hit = F.size(F.filter(words, lambda a: F.exists(own, lambda b: F.contains(b, a) | F.contains(a, b)))) / F.size(words)

    def step(j: Column, c: Column) -> Column:
        at = F.call_function("locate", c, t, j + 1)
        return F.when(j >= F.length(t), j).when(at == 0, F.length(t)).otherwise(at)

    end = F.aggregate(F.split(q, ""), F.lit(0), step)
    letters = F.when(end < F.length(t), 0.3).otherwise(0.1) * F.length(q) / F.greatest(F.length(q), F.length(t))
    some = F.when(F.contains(t, q), 1.0).when(hit > 0, 0.5 + 0.4 * hit).otherwise(letters)
    return F.when((F.coalesce(F.length(query), F.lit(0)) == 0) | (F.coalesce(F.length(text), F.lit(0)) == 0), 0.0).otherwise(some)
