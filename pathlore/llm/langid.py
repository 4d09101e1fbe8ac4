"""Language identification by compression with per-language dictionaries.

Each language's dictionary is raw content: windows of learning texts. A text is compressed with
every dictionary, and the language with the fewest bytes wins; of equal sizes, which only very short
texts have, the language with more learning rows.

Learning uses at most ``WINDOWS`` windows of ``WINDOW_CHARS`` characters of each language, taken at
places that a hash of the text names (a documented bound on the sample). Half of the windows make
first dictionaries, which must agree with the label of each window that is kept for the final
ones: windows that a document has in another language than its label don't enter.

With the margin (runner-up's bytes less the winner's, over the runner-up's), ``score`` is 0.5 plus
five times the margin, at most 1, and ``rejected`` is true where the margin is narrow (below
``MARGIN``); the prediction is given all the same. Nulls: a text that is null or has no letter is
``und`` with score 0; rows without lang teach nothing. With no language learned, all texts are
``und``. Rows are judged alone, repeated rows alike, and texts of any length whole. An empty table
gives an empty result. Other columns are passed on; input columns with the names of the results
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOWS, WINDOW_CHARS, LEVEL, MARGIN = 256, 800, 9, 0.01
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters.from_level(LEVEL, write_checksum=0, write_content_size=0, write_dict_id=0)


class Verdict(NamedTuple):
    lang: str
    score: float
    rejected: bool


class Classifier:
    """A compressor for each language's dictionary; of equal sizes the language named first wins."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float = MARGIN):
        self.langs, self.margin, self.compressors = list(dictionaries), margin, []
        for k in self.langs:
            own = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=own, compression_params=_parameters()))

    def judge(self, text: str | None) -> Verdict:
        if not text or not self.langs or not _LETTER.search(text):
            return Verdict(UNKNOWN, 0.0, True)
        data = text.encode()
        ranked = sorted((len(c.compress(data)), i) for i, c in enumerate(self.compressors))
        lang = self.langs[ranked[0][1]]
        if len(ranked) == 1:
            return Verdict(lang, 1.0, False)
        best, second = ranked[0][0], ranked[1][0]
        margin = (second - best) / second
        return Verdict(lang, min(1.0, 0.5 + 5 * margin), margin < self.margin)


def sample(labelled: DataFrame, windows: int = WINDOWS, chars: int = WINDOW_CHARS) -> dict[str, list[str]]:
    """At most ``windows`` windows of each language, by hash of the text; languages by falling number of rows."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return {}
    scale = 1 << 30
    chance = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(scale, int(scale * windows * 1.5 / n) + 1))])
    h = F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(scale))
    start = F.pmod(F.xxhash64("text", F.lit("window")), F.greatest(F.length("text") - chars, F.lit(0)) + 1)
    window = F.substring(F.col("text"), (start + 1).cast("int"), F.lit(chars))
    out: dict[str, list] = {}
    for r in usable.where(h < chance[F.col("lang")]).select("lang", h.alias("h"), window.alias("w")).distinct().collect():
        out.setdefault(r[0], []).append((r[1], r[2]))
    return {k: [w for _, w in sorted(out[k])[:windows]] for k in sorted(out, key=lambda k: (-counts[k], k))}


def learn(windows: dict[str, list[str]]) -> dict[str, bytes]:
    """Each language's dictionary from windows, less those that first dictionaries of the other half assign elsewhere."""

    def build(of: dict[str, list[str]]) -> dict[str, bytes]:
        return {k: "\n".join(v).encode() for k, v in of.items() if v}

    halves = [{k: v[i::2] for k, v in windows.items()} for i in (0, 1)]
    first = [Classifier(build(h)) for h in halves]
    kept = {k: [w for i in (0, 1) for w in halves[i][k] if len(first[1 - i].langs) < len(windows) or first[1 - i].judge(w).lang == k] for k in windows}
    return build({k: v or windows[k] for k, v in kept.items()})


def predict(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """``docs`` columns but text, with lang_pred, score and rejected as last columns (in place of any of these names)."""
    kept = [c for c in docs.columns if c.lower() not in ("text", "lang_pred", "score", "rejected")]
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Classifier(dictionaries, margin)
        for b in slices(batches, "text"):
            lang, score, rejected = zip(*map(own.judge, b.column("text").to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(lang), pa.array(score), pa.array(rejected)], [*kept, "lang_pred", "score", "rejected"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, f"{kinds}lang_pred string, score double, rejected boolean")
