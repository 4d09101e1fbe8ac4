"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0). Votes are counted by pattern over all
documents (at most 3 to the number of rules rows come to the driver); expectation-maximisation
over those counts estimates the share of good documents and each rule's accuracy, as its chances
of each vote on good and on bad documents. A document's
posterior is then a sum of log-odds, a plain column expression. ``kept`` is false where the base
conditions fail (fewer than ``MIN_WORDS`` words, or over 30 % of words in repeated 8-word
windows) or the posterior is below one half.

Repeated windows are found within the row: 64-bit hashes of words are combined to windows of 2, 4
and 8 words, and only rows with equal window hashes are sorted. Nothing is shuffled but counts.

Nulls: a null text has no words and fails the base. Rows are judged alone, so repeats and null ids
don't matter. Texts of any length are read whole. An empty table gives an empty result. Other
columns are passed on, whatever their names; one named like the result is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh
from .native import count_of, let, words

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"


RULES = ["word_length", "symbols", "letters", "capitals", "exclaims", "digits", "brackets", "wordless"]


#: What a text keeps for the counts of characters: all but white space and letters that aren't upper-case.
_PLAIN = r"[a-z\x20\x09-\x0D\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+"
_WORDLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


def facts(text: Column, window: int | None = WINDOW) -> Column:
    """Struct of the counts that base figures and rules need, from one split and one reduction of the text.

    Characters are counted in the short rest that remains once white space and plain letters are
    gone. Without a window the base figures that only the base conditions need are left out.
    """
    whole = F.coalesce(text, F.lit(""))

    def of_words(ws: Column) -> Column:
        own = [F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars")]
        return F.struct(*own, *([repeated_words(ws, window).alias("n_repeat_words")] if window else []))

    def of_rest(rest: Column) -> Column:
        return F.struct(
            count_of(rest, SYMBOLS).alias("symbols"),
            F.length(F.regexp_replace(rest, r"\p{Lu}+", "")).alias("others"),
            count_of(rest, r"\p{Lu}").alias("capitals"),
            count_of(rest, "!").alias("exclaims"),
            count_of(rest, r"\p{N}").alias("digits"),
            count_of(rest, r"[{}=;]").alias("brackets"),
        )

    def lines(ls: Column) -> Column:
        def again(full: Column) -> Column:
            return F.size(full) - F.size(F.array_distinct(full))

        return F.when(F.size(ls) == F.size(F.array_distinct(ls)), 0).otherwise(let(F.filter(ls, lambda x: x.rlike(r"[^\x20\x09-\x0D]")), again)).cast("long")

    more = [let(F.split(whole, "\n"), lines).alias("n_dup_lines")] if window else []
    rest = let(F.regexp_replace(whole, _PLAIN, ""), of_rest)
    return F.struct(let(words(text), of_words).alias("w"), rest.alias("r"), F.regexp_count(whole, F.lit(_WORDLESS)).alias("wordless"), *more)


def votes(f: Column) -> Column:
    """Struct of each rule's vote from a text's facts. A rule abstains between its two bounds, and all do on texts without words."""

    def vote(value: Column, good: float, bad: float) -> Column:
        worse = value >= bad if bad > good else value <= bad
        better = value <= good if bad > good else value >= good
        return F.when(worse, -1).when(better, 1).otherwise(0)

    dense, n, letters = F.greatest(f.w.word_chars, F.lit(1)), F.greatest(f.w.n_words, F.lit(1)), f.w.word_chars - f.r.others
    own = {
        "word_length": F.when((dense < 2 * n) | (dense > 15 * n), -1).when((dense >= 3 * n) & (dense <= 11 * n), 1).otherwise(0),
        "symbols": vote(f.r.symbols / n, 0.02, 0.1),
        "letters": vote(letters / dense, 0.85, 0.7),
        "capitals": vote(f.r.capitals / F.greatest(letters, F.lit(1)), 0.2, 0.5),
        "exclaims": vote(f.r.exclaims / n, 0.05, 0.25),
        "digits": vote(f.r.digits / dense, 0.1, 0.3),
        "brackets": vote(f.r.brackets / n, 0.02, 0.2),
        "wordless": vote(f.wordless / n, 0.05, 0.25),
    }
    return F.struct(*[F.when(f.w.n_words == 0, 0).otherwise(own[k]).alias(k) for k in RULES])


#: A model: the share of good documents, and for good and for bad ones each rule's chances of (-1, 0, 1).
Model = tuple[float, list[list[tuple[float, float, float]]]]

#: Where estimation starts, and as how many votes that counts: bad documents are where a rule says so.
START, WEIGHT = (0.9, [(0.01, 0.09, 0.9), (0.4, 0.2, 0.4)]), 10.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], rules: int, rounds: int = 200) -> Model:
    """The model by expectation-maximisation over (votes, how many documents)."""
    prior, start = START
    model: Model = (prior, [[chances] * rules for chances in start])
    for _ in range(rounds):
        seen = [[[WEIGHT * c for c in start[y]] for _ in range(rules)] for y in (0, 1)]
        good, total = WEIGHT * prior, WEIGHT
        for pattern, n in patterns:
            p = posterior(pattern, model)
            good, total = good + n * p, total + n
            for y, share in enumerate((p, 1 - p)):
                for i, v in enumerate(pattern):
                    seen[y][i][v + 1] += n * share
        new: Model = (min(0.99, max(0.5, good / total)), [[tuple(c / sum(r) for c in r) for r in of] for of in seen])
        moved = max(abs(a - b) for y in (0, 1) for r, s in zip(new[1][y], model[1][y], strict=True) for a, b in zip(r, s, strict=True)) if rules else 0
        model = new
        if moved < 1e-9:
            break
    return model


def weights(model: Model) -> tuple[float, list[list[float]]]:
    """Log-odds of being good: of the prior, and of each rule's votes -1, 0 and 1."""
    prior, (good, bad) = model
    return math.log(prior / (1 - prior)), [[math.log(a / b) for a, b in zip(g, x, strict=True)] for g, x in zip(good, bad, strict=True)]


def posterior(pattern, model: Model) -> float:
    odds, per = weights(model)
    odds += sum(w[v + 1] for w, v in zip(per, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-700, min(700, odds))))


def fit(known: DataFrame, name: str = "_facts") -> Model:
    """The model from the votes of all rows, whose facts are in a column ``name``."""
    counts = known.select(votes(F.col(name)).alias("v")).groupBy("v").count().collect()
    return estimate(sorted((tuple(r[0]), r[1]) for r in counts), len(RULES))


def probability(v: Column, model: Model) -> Column:
    """Posterior probability that a document with these votes is good."""
    odds, per = weights(model)
    odds = F.lit(odds)
    for rule, w in zip(RULES, per, strict=True):
        odds = odds + F.when(v[rule] < 0, w[0]).when(v[rule] > 0, w[2]).otherwise(w[1])
    return 1 / (1 + F.exp(-odds))


def _join_hashes(h: Column, by: int) -> Column:
    return F.zip_with(h, F.slice(h, F.lit(by + 1), F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def repeated_words(ws: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of 8 words (a power of two) that occur twice or more in the array."""

    def of(h: Column) -> Column:
        def spread(s: Column) -> Column:
            def again(i: Column) -> Column:
                own = F.get(s, i)
                return F.when((own.h == F.get(s, i - 1).h) | (own.h == F.get(s, i + 1).h), own.i)

            at = F.array_sort(F.filter(F.transform(F.sequence(F.lit(0), F.size(s) - 1), again), lambda x: x.isNotNull()))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a.n + F.least(F.lit(window), x - a.last)).alias("n")), lambda a: a.n)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spread))

    def windows(h: Column, by: int) -> Column:
        return let(h, lambda x: windows(_join_hashes(x, by), 2 * by)) if by < window else let(F.slice(h, F.lit(1), F.size(h) - (window - 1)), of)

    return F.when(F.size(ws) <= window, 0).otherwise(windows(F.transform(ws, lambda w: F.xxhash64(w)), 1)).cast("long")


def verdict(f: Column, model: Model) -> Column:
    """Struct of the base figures, base_failed, probability and kept."""
    w, p = f.w, probability(votes(f), model)
    failed = (w.n_words < MIN_WORDS) | (100 * w.n_repeat_words > REPEAT_PERCENT * w.n_words)
    return F.struct(
        w.n_words.alias("n_words"),
        w.word_chars.alias("word_chars"),
        f.r.symbols.alias("n_symbols"),
        f.n_dup_lines.alias("n_dup_lines"),
        w.n_repeat_words.alias("n_repeat_words"),
        failed.alias("base_failed"),
        p.alias("probability"),
        (~failed & (p >= 0.5)).alias("kept"),
    )


def judged(docs: DataFrame, model: Model | None = None, name: str = "_quality") -> DataFrame:
    """``docs`` less text, with a struct column ``name`` (in place of one of that name). Texts are read once; their facts go through a checkpoint."""
    own = fresh(docs, "_facts")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("text", name.lower())]
    known = checkpoint(docs.select(*kept, facts(F.col("text")).alias(own)))
    return known.withColumn(name, verdict(F.col(own), model or fit(known, own))).drop(own)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept. Texts are read twice, so that none has to be written in between."""
    model = fit(docs.select(facts(F.col("text"), None).alias("_facts")))
    return docs.where(let(facts(F.col("text")), lambda f: verdict(f, model).kept))
