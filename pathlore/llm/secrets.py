"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its content. A blob is scanned once for
each version of the rules: blobs that the ledger has already under the version are left out,
equal contents are scanned once, and findings are joined back to all paths by content address.

Spans are (kind, start, end) in code points, end exclusive, leftmost and without overlap in a
kind. The places of matches follow from the texts between them: ``split`` gives the gaps,
``regexp_extract_all`` the matches, and running sums add up their lengths; time grows with the number
of hits in a text times its logarithm.

The ledger is a Parquet folder of (blob, rules_version, spans); rows that two writers add twice
count once. Nulls: a null content is an empty one, without spans. Repeated rows give repeated
results. Texts of any length are scanned whole. An empty table gives an empty result. Other
columns are passed on under any name; a column named like the findings' is replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, exists, fresh, held_out, shared_folder, small
from .native import let


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1


#: The base kinds come first; the order settles ties of equal starts.
BASE = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # maximal runs: the same as runs of any length, less the short ones
]
MORE = [
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"\bgh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"\bxox[abps]-[A-Za-z0-9-]{10,}"),
]
RULES = BASE + MORE
RULES_VERSION = 1
#: Characters of a piece of text.
PIECE = 1024
SPANS = "array<struct<start:int,rank:int,kind:string,end:int>>"


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with all before it (a sum, a maximum), by doubling: as many passes over the array as its length has binary digits."""
    digits = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")
    steps = F.when(digits > 0, F.transform(F.sequence(F.lit(1), F.greatest(digits, F.lit(1))), lambda k: F.pow(F.lit(2), k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def double(done: Column, step: Column) -> Column:
        return F.transform(done, lambda x, i: F.when(i >= step, join(x, F.get(done, i - step))).otherwise(x))

    return F.aggregate(steps, values, double)


def spans_of(text: Column, rule: Rule, rank: int) -> Column:
    """A kind's spans in a text, by start."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.split(text, rule.pattern).alias("gap"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    own = F.transform(F.filter(parts, lambda x: x.hit.isNotNull()), lambda x: F.struct((F.length(x.gap) + F.length(x.hit)).alias("both"), F.length(x.hit).alias("hit"), F.length(x.part).alias("part")))

    def placed(sizes: Column) -> Column:
        """Spans from the sizes of each gap with its hit, of the hit, and of the part that counts."""
        ends = running(F.transform(sizes, lambda x: x.both), lambda a, b: a + b)
        each = F.zip_with(sizes, ends, lambda x, end: F.struct((end - x.hit).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"), x.part.alias("part")))
        return F.transform(F.filter(each, lambda x: x.part >= rule.least), lambda x: F.struct(x.start.alias("start"), x.rank.alias("rank"), x.kind.alias("kind"), x.end.alias("end")))

    return F.when(text.rlike(rule.pattern), let(own, placed)).otherwise(F.array().cast(SPANS))


def content_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, rules_version: int = RULES_VERSION) -> DataFrame:
    """(blob, rules_version, spans) for each distinct content of ``text`` that the ledger lacks under this version."""
    own = versions.select(content_key(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = own.groupBy("blob").agg(F.first("text").alias("text"))  # copies are folded before the shuffle
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules_version") == rules_version).select("blob"), "blob", "left_anti")
    spans = F.concat(*[spans_of(F.col("text"), r, i) for i, r in enumerate(rules)])
    return blobs.select("blob", F.lit(rules_version).alias("rules_version"), F.array_sort(spans).alias("spans"))


def findings(versions: DataFrame, scanned: DataFrame, rules_version: int = RULES_VERSION, name: str = "_spans") -> DataFrame:
    """``versions`` with its findings as a last column ``name`` (in place of one of that name), from scanned blobs (ledger rows of this version).

    Only blobs with findings are joined, each once, however often the ledger has it; they are
    broadcast where they are few, and else the join can split a blob that many rows have, if
    ``scanned`` is a written table.
    """
    kept = [c for c in versions.columns if c.lower() != name.lower()]
    key, blob, spans = (fresh(versions, c) for c in ("_key", "_blob", "_found"))
    found = scanned.where((F.col("rules_version") == rules_version) & (F.size("spans") > 0)).groupBy("blob").agg(F.first("spans").alias("spans"))
    found = small(checkpoint(found.select(F.col("blob").alias(blob), F.col("spans").alias(spans))), units=F.size(spans))
    joined = versions.withColumn(key, content_key(F.col("text"))).join(found, F.col(key) == F.col(blob), "left")
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(spans, F.array().cast(SPANS)).alias(name))


def update_ledger(versions: DataFrame, path: str, rules: list[Rule] = RULES, rules_version: int = RULES_VERSION) -> DataFrame:
    """Scans what the ledger at ``path`` lacks, appends it there, and returns the ledger."""
    spark = versions.sparkSession
    scan(versions, spark.read.parquet(path) if exists(spark, path) else None, rules, rules_version).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def scan_increments(parts: list[DataFrame], path: str, rules: list[Rule] = RULES, rules_version: int = RULES_VERSION) -> DataFrame:
    """The ledger at ``path`` after one increment of versions after the other; none is scanned for what an earlier one had."""
    ledger = None
    for versions in parts:
        ledger = update_ledger(versions, path, rules, rules_version)
    return ledger


def rendered(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by the mark.

    The text is cut into pieces of ``PIECE`` characters first, so that a gap between two runs is put
    together from its own pieces and not looked for from the text's beginning.
    """

    def gap(pieces: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")

        def part(k: Column) -> Column:
            begin = F.greatest(start - k * PIECE, F.lit(0))
            return F.substring(F.get(pieces, k), begin + 1, F.least(end - k * PIECE, F.lit(PIECE)) - begin)

        return F.when(end > start, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise("")

    def rebuilt(x: Column) -> Column:
        """From pieces, length, spans and their reach, which is how far the spans up to each go."""
        begins = F.transform(x.spans, lambda s, i: F.struct(s.start.alias("start"), (s.start >= F.coalesce(F.get(x.reach, i - 1), F.lit(0))).alias("new")))
        starts = F.transform(F.filter(begins, lambda s: s.new), lambda s: s.start)
        ends = F.filter(x.reach, lambda e, i: F.coalesce(F.get(x.spans, i + 1).start >= e, F.lit(True)))

        def joined(r: Column) -> Column:
            gaps = F.transform(F.sequence(F.lit(0), F.size(r.starts)), lambda k: gap(x.pieces, F.coalesce(F.get(r.ends, k - 1), F.lit(0)), F.coalesce(F.get(r.starts, k), x.length)))
            return F.array_join(gaps, mark)

        return let(F.struct(starts.alias("starts"), ends.alias("ends")), joined)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    reach = running(F.transform(spans, lambda s: s.end), F.greatest)
    done = let(F.struct(pieces.alias("pieces"), F.length(text).alias("length"), spans.alias("spans"), reach.alias("reach")), rebuilt)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def increments(docs: DataFrame) -> list[DataFrame]:
    """``docs`` as two increments of versions: rows whose crc32 of the id's text is even are taken as history, the others as what came after."""
    old = held_out(F.col("doc_id"), 2, 0)
    return [docs.where(old), docs.where(~old)]


def redact(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with their secrets replaced in ``text``, scanned against the ledger at ``path`` (a new one by default)."""
    spark = docs.sparkSession
    ledger = update_ledger(docs.select("text"), path or new_ledger(spark))
    name = fresh(docs, "_spans")
    found = findings(docs, ledger, name=name)
    return found.withColumn("text", redacted(F.col("text"), F.col(name))).select([F.col(f"`{c}`") for c in docs.columns])


def new_ledger(spark: SparkSession) -> str:
    """Where a run without a ledger of its own keeps it: a new folder below the shared one."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
