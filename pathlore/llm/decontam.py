"""Benchmark decontamination by template windows.

Words lose outer punctuation and case; a number, a unit after a number, and a name become typed
placeholders (slots). A name is a capitalised word, at the beginning of a sentence only if the
benchmark has it nowhere in lower case, and, in any case, a word that the benchmark has capitalised inside
a sentence and nowhere in lower case, or one of ``NAMES``. Windows of ``WINDOW`` template words of every document are
joined by hash with those of the benchmark items (an item with fewer words is one window of its own
length, if it has ``LEAST`` or more), by their template words and by their plain words; windows without
``LITERALS`` words beside placeholders in the item are compared by their plain words only. Windows that
match at one difference of positions and touch or overlap are a run. A run's slots must be consistent: each slot
value of the item stands for one value of the document throughout, and each name of the document for
one of the item, so a question with other numbers or names is caught, and a text whose slots don't
line up is not. Where windows of mostly placeholders take part, the slots say more than the words, and must
be one-to-one (each value of the document stands for one of the item, too) and hold ``HEAVY_COVERAGE`` of
the item's words. A pair of document and item is contaminated if a run has ``LONG`` words, or if runs in
the same order in both, with consistent slots and positions shifted by no more than the item's
length, hold ``COVERAGE`` of the item's words (rounded down), so words put in, left out or replaced
between runs don't matter. A change within each ``WINDOW`` words leaves no run, and isn't found.
An item with fewer than ``LEAST`` words is found where a line of a document has its plain words and
no others.

Before the join a Bloom filter of ``BITS`` bits, gathered from the item windows of any number, keeps
the documents' windows in place that no item has. The benchmark's lower-case words and its names are
filters of the same size; a word that one of them has by chance is read alike in items and documents. Matched
windows are folded to runs before they are shuffled, so a pair's rows grow with its runs.

Nulls: a null text has no words; rows with a null item_id are left out, a null doc_id is kept. Ids
may be of any type. Repeated rows give one result. Texts of any length are read whole, a few at a
time. Empty tables give an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Words, checkpoint, fresh, slices, small, starts, string_hashes

WINDOW, LEAST, COVERAGE, LITERALS = 8, 5, 0.5, 1
#: Share of an item's words that places with windows of mostly placeholders must hold.
HEAVY_COVERAGE = 0.75
LONG = 13
#: Of the Bloom filter, a power of two.
BITS = 1 << 25

UNITS = frozenset("mm cm m km in ft mi mg g kg t oz lb lbs ml l s sec min h hr hours minutes seconds days weeks months years % kb mb gb tb usd eur dollars euros cents percent miles meters metres feet inches degrees".split())
#: Common given names that are no other words, known in lower case too.
NAMES = frozenset("""
    aaron adam alan albert alexander alice amanda amy andrea andrew angela anna anne anthony arthur barbara benjamin betty brandon brian carlos
    carol caroline catherine charlotte christopher cynthia daniel david deborah diana donald donna dorothy dylan edward elena elizabeth emily emma
    eric ethan eugene eva evelyn fatima fernando gabriel george gloria gregory hannah harold heather helen henry isabel isabella jacob jacqueline
    james jane janet jason jeffrey jennifer jeremy jessica joan john jonathan jose joseph joshua juan judith julia julie karen katherine kathleen
    keith kelly kenneth kevin kyle larry laura lauren leonard linda lisa louis lucas lucy luis madison margaret maria marie martha mary matthew
    megan melissa michael michelle mohammed nancy natalia natalie nathan nicholas nicole noah oliver olivia pamela patricia paul peter philip rachel
    ralph raymond rebecca richard robert roger ronald russell ryan samantha samuel sandra sara sarah scott sean sharon shirley simon sophia sophie
    stephanie stephen steven susan teresa theresa thomas timothy tyler victoria vincent virginia walter wayne william zachary
""".split())
_NUMBER = regex.compile(r"[+-]?[$€£]?\d[\d.,:/]*\d*%?|[+-]?[$€£]?\d+%?")
_OUTER = regex.compile(r"^[^\p{L}\p{N}$€£+%-]+|[^\p{L}\p{N}%]+$")
_MIX = np.uint64(0x9E3779B97F4A7C15)


_NUM, _UNIT, _NAME = "<num>", "<unit>", "<name>"


_SLOTS = dict(zip((_NUM, _UNIT, _NAME), string_hashes(pa.array([_NUM, _UNIT, _NAME])).tolist(), strict=True))


@lru_cache(1 << 16)
def _word(raw: bytes) -> tuple[str, bool, bool, bool, bool]:
    """Plain form, whether number, unit, capitalised, and whether a sentence may begin after it."""
    word = raw.decode()
    core = _OUTER.sub("", word)
    low = core.lower()
    return low, _NUMBER.fullmatch(core) is not None, low in UNITS, core[:1].isupper() and not core.isupper(), word[-1] in ".!?:;|\"'»)" or not core


_RUN = pa.struct([("heavy", pa.bool_()), ("shift", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("windows", pa.binary()), ("slots", pa.list_(pa.struct([("kind", pa.string()), ("item", pa.string()), ("doc", pa.string())])))])


class Filter:
    """A Bloom filter of ``BITS`` bits with two places for each hash ``h`` of a table."""

    def __init__(self, items: DataFrame):
        places = F.explode(F.array(*[F.shiftrightunsigned("h", n).bitwiseAND(F.lit(BITS - 1)) for n in (0, 32)]))
        rows = items.select(places.alias("p")).select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int)) AS bit"))
        words = np.zeros(BITS >> 6, np.uint64)  # no more rows than this come to the driver
        for word, bits in rows.groupBy("word").agg(F.bit_or("bit")).collect():
            words[word] = bits & 0xFFFFFFFFFFFFFFFF
        self.words = words

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Positions of the hashes that an item may have."""
        at = np.arange(len(h))
        for n in (0, 32):
            p = (h[at].view(np.uint64) >> np.uint64(n)) & np.uint64(BITS - 1)
            at = at[(self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
        return at


def _among(own: frozenset[str] | Filter, hashes: np.ndarray) -> np.ndarray:
    """Which of the words' hashes a vocabulary has."""
    if not isinstance(own, Filter):
        return np.isin(hashes, string_hashes(pa.array(sorted(own), pa.string())))
    out = np.zeros(len(hashes), bool)
    out[own.maybe(hashes.view(np.int64))] = True
    return out


def _template(text: str | None, ordinary: frozenset[str] | Filter = frozenset(), names: frozenset[str] | Filter = frozenset()) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    words, begins = [], True
    for raw in (text or "").encode().split():
        word = _word(raw)
        if word[0]:
            words.append((*word[:4], begins))
        begins = word[4]
    plain = [w[0] for w in words]
    plain_hashes = string_hashes(pa.array(plain, pa.string()))
    out, after_number = [], False
    for (low, number, unit, capital, begins), common, named in zip(words, _among(ordinary, plain_hashes).tolist(), _among(names, plain_hashes).tolist(), strict=True):
        out.append(_NUM if number else _UNIT if unit and after_number else _NAME if named or capital and not (begins and common) else low)
        after_number = number
    return out, plain, string_hashes(pa.array(out, pa.string())), plain_hashes


def template(text: str | None, ordinary: frozenset[str] | Filter = frozenset(), names: frozenset[str] | Filter = frozenset()) -> tuple[list[str], list[str]]:
    """Template words and the plain forms of the same words; ``ordinary`` words aren't names where a sentence begins, ``names`` are in any case."""
    return _template(text, ordinary, names)[:2]


class Vocabulary(NamedTuple):
    """What the benchmark has in lower case, and names that count in any case."""

    ordinary: frozenset[str] | Filter = frozenset()
    names: frozenset[str] | Filter = frozenset()


def vocabulary(benchmark: DataFrame, names: frozenset[str] = NAMES) -> Vocabulary:
    """The benchmark's lower-case words, and the words that it has capitalised inside sentences but nowhere in lower case, with ``names`` of the same kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            own: dict[str, list[bool]] = {}
            for text in b.column("text").to_pylist():
                begins = True
                for raw in (text or "").encode().split():
                    low, number, unit, capital, ends = _word(raw)
                    if low and not number:
                        seen = own.setdefault(low, [False, False])
                        seen[0] |= not capital
                        seen[1] |= capital and not begins and not unit
                    begins = ends
            hashes = string_hashes(pa.array(list(own), pa.string())).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes), *(pa.array([v[i] for v in own.values()], pa.bool_()) for i in (0, 1))], ["h", "lower", "name"])

    known = benchmark.sparkSession.createDataFrame([(int(h), False, True) for h in string_hashes(pa.array(sorted(names), pa.string())).view(np.int64)], "h long, lower boolean, name boolean")
    words = checkpoint(benchmark.select("text").mapInArrow(run, "h long, lower boolean, name boolean").unionByName(known).groupBy("h").agg(F.max("lower").alias("lower"), F.max("name").alias("name")))
    return Vocabulary(Filter(words.where("lower").select("h")), Filter(words.where("name and not lower").select("h")))


_SLOT_HASHES = np.array(sorted(_SLOTS.values()), np.uint64)


def _windows(hashes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: the size, window hashes, and which windows have ``LITERALS`` words or more beside placeholders."""
    h = hashes
    total = np.concatenate([[0], np.cumsum(np.isin(h, _SLOT_HASHES))])
    for k in sizes:
        n = len(h) - k + 1
        if n <= 0:
            continue
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * _MIX + h[i : i + n]
        out ^= out >> np.uint64(29)
        yield k, out.view(np.int64), total[k:] - total[:-k] <= k - LITERALS


def _templates(texts: pa.Array, ordinary: frozenset[str] | Filter = frozenset(), names: frozenset[str] | Filter = frozenset()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]:
    """``_template`` of many texts at once: flat template hashes, plain hashes and vocabulary codes, offsets of the texts, the vocabulary of raw words."""
    words = Words(texts)
    raw = words.vocab
    easy = pc.and_(pc.utf8_is_alpha(raw), pc.utf8_is_lower(raw))  # words that are their own plain form
    hard = [_word(w.encode() or b"-") for w in raw.filter(pc.invert(easy)).to_pylist()]  # an unused empty word may be there
    easy = easy.to_numpy(zero_copy_only=False)
    columns = list(zip(*hard, strict=True)) or [()] * 5
    flags = np.zeros((7, len(raw)), bool)  # whether not empty, number, unit, capitalised, end, ordinary, name
    flags[0, easy], flags[2] = True, pc.is_in(raw, pa.array(sorted(UNITS), raw.type)).to_numpy(zero_copy_only=False)
    for flag, column in zip(flags[:5], [list(map(bool, columns[0])), *columns[1:]], strict=True):
        flag[~easy] = column
    by_word = np.zeros(len(raw), np.uint64)
    by_word[easy] = string_hashes(raw.filter(pa.array(easy)))
    by_word[~easy] = string_hashes(pa.array(columns[0], pa.string()))
    flags[5, ~easy] = _among(ordinary, by_word[~easy])  # the others have no capital
    flags[6] = _among(names, by_word) & flags[0]
    full, number, unit, capital, ends, common, named = (f[words.codes] for f in flags)
    n = len(full)
    begins = np.concatenate([[True], ends[:-1]])[:n]
    begins[words.offsets[:-1][words.offsets[:-1] < n]] = True
    offsets = np.concatenate([[0], np.cumsum(full)])[words.offsets]
    codes, number, unit, capital, begins, named = words.codes[full], number[full], unit[full], capital[full], (begins & common)[full], named[full]
    n = len(codes)
    after_number = np.concatenate([[False], number[:-1]])[:n]
    after_number[offsets[:-1][offsets[:-1] < n]] = False
    plain = by_word[codes]
    kinds = [number, unit & after_number, named | capital & ~begins]
    hashes = np.select(kinds, [np.uint64(_SLOTS[s]) for s in (_NUM, _UNIT, _NAME)], plain)
    kind = np.select(kinds, [1, 2, 3], 0)
    return hashes, plain, np.stack([codes, kind]), offsets, raw


def item_windows(benchmark: DataFrame, known: Vocabulary) -> DataFrame:
    """(h, item_id, at, size, windows, length, words, plain): the windows of every item by template and plain hash.

    ``windows`` is how many places of windows the item has, ``length`` how many words.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    shared = benchmark.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in slices(batches, "text", 1 << 18):
            rows, own = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                words, plain, hashes, plain_hashes = _template(text, *known)
                size = min(WINDOW, len(words))
                if size < LEAST:
                    continue
                for (k, h, ok), (_, p, _) in zip(_windows(hashes, [size]), _windows(plain_hashes, [size]), strict=True):
                    for at in range(len(h)):
                        for v in {int(h[at]), int(p[at])} if ok[at] else {int(p[at])}:
                            own.append(i)
                            rows.append((v, at, k, len(h), len(words), words[at : at + k], plain[at : at + k]))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("item_id").take(pa.array(own)), *columns], _NAMES)

    return benchmark.where("item_id IS NOT NULL").select("item_id", "text").mapInArrow(run, f"item_id {kind}, h long, at long, size long, windows long, length long, words array<string>, plain array<string>")


_NAMES = ["item_id", "h", "at", "size", "windows", "length", "words", "plain"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]


def doc_windows(docs: DataFrame, sizes: list[int], wanted: Filter, known: Vocabulary) -> DataFrame:
    """(doc_id, t, h, place, doc_words, doc_plain): the documents' windows of these sizes that an item may have; ``t`` is the text's hash."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((wanted, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, known = shared.value
        for part in slices(batches, "text", 1 << 20):
            ids, hs, places, ws, ps = [], [], [], [], []
            hashes, plain_hashes, (codes, kinds), offsets, vocab = _templates(part.column("text"), *known)
            for (k, h, ok), (_, p, _) in zip(_windows(hashes, sizes), _windows(plain_hashes, sizes), strict=True):
                whole = np.zeros(len(h), bool)
                whole[starts(offsets, k)] = True
                for v, good in ((h, ok & whole), (p, (p != h) & whole | ~ok & whole)):
                    at = wanted.maybe(v)
                    at = at[good[at]]
                    own = np.searchsorted(offsets, at, side="right") - 1
                    ids += own.tolist()
                    hs += v[at].tolist()
                    places += (at - offsets[own]).tolist()
                    for j in at.tolist():
                        plain = [_word(vocab[c].as_py().encode())[0] for c in codes[j : j + k].tolist()]
                        ps.append(plain)
                        ws.append([(w, _NUM, _UNIT, _NAME)[x] for w, x in zip(plain, kinds[j : j + k].tolist(), strict=True)])
            if ids:
                texts = part.column("text")
                ts = {i: xxhash.xxh64_intdigest(texts[i].as_py(), 11) - (1 << 63) for i in set(ids)}
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(ids)), pa.array([ts[i] for i in ids], pa.int64()), pa.array(hs, pa.int64()), pa.array(places, pa.int64()), pa.array(ws), pa.array(ps)], ["doc_id", "t", "h", "place", "doc_words", "doc_plain"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, t long, h long, place long, doc_words array<string>, doc_plain array<string>")


def short_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, n_words): documents with a line of just the plain words of an item of fewer than ``LEAST`` words; none without such items."""

    def plain(df: DataFrame, key: str) -> DataFrame:
        kind = df.schema[key].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text"):
                own = [template(x)[1] for x in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(key), pa.array([" ".join(w) if len(w) < LEAST else None for w in own], pa.string()), pa.array([len(w) for w in own], pa.int64())], [key, "line", "n"])

        return df.mapInArrow(run, f"{key} {kind}, line string, n long").where("line is not null and n > 0").distinct()

    items = checkpoint(plain(benchmark.where("item_id IS NOT NULL").select("item_id", "text"), "item_id"))
    if items.isEmpty():
        return None
    full = F.filter(F.split("text", SPACE), lambda w: w.rlike(r"[\p{L}\p{N}%]"))  # the others have no plain form
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("text")).where(F.size(full) < LEAST)
    return plain(lines, "doc_id").drop("n").join(small(items), "line").select("doc_id", "item_id", F.col("n").alias("n_words"))


#: (kind, value in the item, value in the document) of a placeholder.
Slot = tuple[str, str, str]


class Run(NamedTuple):
    """Item places [begin, end) that windows match ``shift`` further on in the document: the windows' places as bits, their slots."""

    heavy: bool
    shift: int
    begin: int
    end: int
    windows: int
    slots: frozenset[Slot]


def folded(parts: Iterable[Run]) -> list[Run]:
    """Runs that touch or overlap at one shift, joined; windows of mostly placeholders apart from the others."""
    out: list[list] = []
    for r in sorted(parts, key=lambda r: r[:4]):
        if out and out[-1][:2] == [r.heavy, r.shift] and r.begin <= out[-1][3]:
            last = out[-1]
            last[3], last[4] = max(last[3], r.end), last[4] | r.windows
            last[5] |= r.slots
        else:
            out.append([*r[:5], set(r.slots)])
    return [Run(*r[:5], frozenset(r[5])) for r in out]


def _joined(slots: dict[tuple, str], more: Iterable[Slot] | dict[tuple, str], one_to_one: bool = False) -> dict[tuple, str] | None:
    """The slots, by item's value and for names (``one_to_one``: for all) by the document's too, with these also; none if one would have two values."""
    out = dict(slots)
    pairs = more.items() if isinstance(more, dict) else [x for kind, item, doc in more for x in ((("item", item), doc), *([(("doc", doc), item)] if one_to_one or kind == _NAME else []))]
    for key, value in pairs:
        if out.setdefault(key, value) != value:
            return None
    return out


def _judged(parts: list[Run], length: int, one_to_one: bool) -> tuple[int, int, bool] | None:
    kept = [(r.shift, r.begin, r.end, r.windows.bit_count(), own) for r in folded(parts) if (own := _joined({}, r.slots, one_to_one)) is not None]
    least = math.ceil(HEAVY_COVERAGE * length) if one_to_one else int(COVERAGE * length)
    found, used, ordered = [], set(), sorted(kept, key=lambda r: (r[1] - r[2], r[0], r[1]))
    by_shift = sorted(range(len(ordered)), key=lambda i: ordered[i][0])
    shifts = [ordered[i][0] for i in by_shift]
    for i, first in enumerate(ordered):
        if i in used:
            continue
        chain, slots = [i], first[4]
        near = by_shift[bisect_left(shifts, first[0] - length) : bisect_right(shifts, first[0] + length)]
        for j in sorted(near):
            s, a, b, _, own = ordered[j]
            if j in used or any(j == c or (a < ordered[c][1]) != (a + s < ordered[c][1] + ordered[c][0]) or (b < ordered[c][2]) != (b + s < ordered[c][2] + ordered[c][0]) for c in chain):
                continue
            if (more := _joined(slots, own)) is not None:
                chain.append(j)
                slots = more
        of = [ordered[c] for c in chain]
        covered = min(len({x for _, a, b, _, _ in of for x in range(a, b)}), len({x + s for s, a, b, _, _ in of for x in range(a, b)}))
        if covered >= least or not one_to_one and first[2] - first[1] >= LONG:
            used.update(chain)
            found.append((sum(r[3] for r in of), covered, all(key[1] == value for key, value in slots.items())))
    return (max(x[0] for x in found), max(x[1] for x in found), any(x[2] for x in found)) if found else None


def judge(parts: list[Run], length: int) -> tuple[int, int, bool] | None:
    """Most windows and item words in one place and whether one place is verbatim; none if the pair isn't contaminated.

    Windows of mostly placeholders count together with the others, if all slots are one-to-one then.
    """
    found = [_judged([r for r in parts if not r.heavy], length, False)]
    if any(r.heavy for r in parts):
        found.append(_judged([r._replace(heavy=False) for r in parts], length, True))
    found = [x for x in found if x]
    return (max(x[0] for x in found), max(x[1] for x in found), any(x[2] for x in found)) if found else None


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, item_windows, coverage, verbatim): a row for each contaminated pair.

    ``coverage`` is the share of the item's words; ``verbatim`` is false where slots have other
    values than the item's. An item shorter than a window counts as one window.
    """
    known = vocabulary(benchmark)
    items = checkpoint(item_windows(benchmark, known))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    found = doc_windows(docs if sizes else docs.limit(0), sizes, Filter(items), known)
    slots = F.filter(F.transform(F.arrays_zip("words", "plain", "doc_plain"), lambda x: F.when(x.words.rlike("^<(num|unit|name)>$"), F.struct(x.words.alias("kind"), x.plain.alias("item"), x.doc_plain.alias("doc")))), lambda x: x.isNotNull())
    pairs = found.join(small(items, units=F.lit(1 + WINDOW // 2)), "h").where("words = doc_words OR plain = doc_plain")
    heavy = (2 * F.size("slots") > F.col("size")) & (F.col("plain") != F.col("doc_plain"))
    hits = pairs.withColumn("slots", slots).select("doc_id", "t", "item_id", "windows", "length", "at", "place", "size", heavy.alias("heavy"), "slots")
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, item_id {benchmark.schema['item_id'].dataType.simpleString()}"
    keys = ["doc_id", "t", "item_id", "windows", "length"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of: dict[tuple, list[Run]] = {}
            at = {}
            own = zip(*(b.column(c).to_pylist() for c in (*keys, "heavy", "at", "place", "size", "slots")), strict=True)
            for i, (*key, heavy, start, place, size, slots) in enumerate(own):
                at.setdefault(tuple(key), i)
                of.setdefault(tuple(key), []).append(Run(heavy, place - start, start, start + size, 1 << start, frozenset((s["kind"], s["item"], s["doc"]) for s in slots)))
            rows = [(at[key], r) for key, parts in of.items() for r in folded(parts)]
            if rows:
                old = [b.column(c).take(pa.array([i for i, _ in rows])) for c in keys]
                runs = [{"heavy": r.heavy, "shift": r.shift, "begin": r.begin, "end": r.end, "windows": r.windows.to_bytes((r.windows.bit_length() + 7) // 8, "little"), "slots": [dict(zip(("kind", "item", "doc"), x, strict=True)) for x in sorted(r.slots)]} for _, r in rows]
                yield pa.RecordBatch.from_arrays([*old, pa.array(runs, _RUN)], [*keys, "run"])

    slot = "struct<kind:string,item:string,doc:string>"
    folded_runs = hits.mapInArrow(fold, f"{kinds}, windows long, length long, run struct<heavy:boolean,shift:long,begin:long,end:long,windows:binary,slots:array<{slot}>>")
    placed = folded_runs.groupBy(*keys).agg(F.collect_list("run").alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, (length, runs) in enumerate(zip(b.column("length").to_pylist(), b.column("runs").to_pylist(), strict=True)):
                parts = [Run(r["heavy"], r["shift"], r["begin"], r["end"], int.from_bytes(r["windows"], "little"), frozenset((s["kind"], s["item"], s["doc"]) for s in r["slots"])) for r in runs]
                if own := judge(parts, length):
                    rows.append((own[0], own[1] / length, own[2]))
                    at.append(i)
            if rows:
                n, share, verbatim = zip(*rows, strict=True)
                old = [b.column(c).take(pa.array(at)) for c in ("doc_id", "t", "item_id", "windows")]
                yield pa.RecordBatch.from_arrays([*old, pa.array(n, pa.int64()), pa.array(share, pa.float64()), pa.array(verbatim)], ["doc_id", "t", "item_id", "windows", "n", "share", "verbatim"])

    good = placed.mapInArrow(run, f"{kinds}, windows long, n long, share double, verbatim boolean")
    if (short := short_matches(docs, benchmark)) is not None:
        one = F.lit(1).cast("long")
        good = good.unionByName(short.select("doc_id", F.lit(0).cast("long").alias("t"), "item_id", one.alias("windows"), one.alias("n"), F.lit(1.0).alias("share"), F.lit(True).alias("verbatim")))
    return good.groupBy("doc_id", "item_id").agg(F.max("n").alias("n_windows"), F.max("windows").alias("item_windows"), F.round(F.max("share"), 6).alias("coverage"), F.max("verbatim").alias("verbatim"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text matches no item, whatever other rows have their id; rows with a null id stay."""
    key, gone_key = fresh(docs, "_key"), fresh(docs, "_gone")
    address = F.sha2(F.coalesce("text", F.lit("")), 256)
    texts = docs.where("doc_id IS NOT NULL").select(address.alias("doc_id"), "text")
    gone = small(checkpoint(matches(texts, benchmark).select(F.col("doc_id").alias(gone_key)).distinct()))
    own = docs.withColumn(key, F.when(F.col("doc_id").isNotNull(), address))
    return own.join(gone, F.col(key) == F.col(gone_key), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
