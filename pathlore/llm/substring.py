"""Removal of repeated word passages by level-wise doubling.

Levels have lengths that double, from ``least`` words to the whole window of ``window`` words. At each
level a window's anchor is its part of that length with the smallest hash, so equal windows have
equal anchors. Only windows whose anchor occurs at another place too go on to twice the length; the
others drop out, and a level without survivors ends the search. At the last level whole windows are
compared. No longer length can remove more than the windows of ``window`` words do, so doubling
ends there.

Each level first folds what one batch of documents (``FOLD_BYTES`` of text) holds. Anchors at two
places in a batch are known to be repeated there and then: their documents are told so directly, and
others learn of it by one row of the batch; anchors at one place send one row. Windows send a batch's
earliest place only. So what meets at one key, a passage that half of all documents share, grows
with the number of batches by a few bytes each, not with the documents.

A window's place is (doc_id, start); each word covered by a window whose sequence has an earlier
place is removed. Words are compared by 64 bits of hash, sequences of them by two hashes (64 bits of
the anchor, 56 of the window) and the anchor's offset. ``window`` is 510 at most, and ``least`` times
a power of two.

Ids are numbers (other types fail on the cast). Nulls: a null text has no words. A null id counts as
before all others. Rows with equal id and text are judged alike: the windows of each of them have no
earlier place than those of the others, so they keep what one such row would keep. Different texts
under one id share what is removed. Texts of any length are read whole. An empty table gives an empty
result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, checkpoint, covered, rolling, runs, slices, starts

WINDOW = 20
#: Text bytes that are folded at once.
FOLD_BYTES = 12 << 20
_LOW = np.iinfo(np.int64).min
#: Low bits of a window's hash that hold how far its anchor lies behind its begin; windows of up to twice as many words.
_OFFSET = 255
_SALT = np.uint64(0xD6E8FEB86659FD93)


def sliding_low(a: np.ndarray, n: int) -> np.ndarray:
    """Position of the smallest of each n consecutive values, the first of equal ones."""
    low, at = a.copy(), np.arange(len(a))
    done = 1
    while done < n:  # doubling spans
        step = min(done, n - done)
        m = len(low) - step
        swap = low[step : step + m] < low[:m]
        at = np.where(swap, at[step : step + m], at[:m])
        low = np.where(swap, low[step : step + m], low[:m])
        done += step
    return at


def levels(window: int, least: int) -> list[int]:
    """The lengths of anchors, each twice the one before, below the window's own."""
    out = [least]
    while out[-1] * 2 < window:
        out.append(out[-1] * 2)
    if out[-1] * 2 != window:
        raise ValueError("the window must be the least length times a power of two")
    return out


class Batch:
    """Word windows of a batch of documents (columns id, text) with their anchors of a length."""

    def __init__(self, b: pa.RecordBatch, window: int, half: int):
        words = Words(b.column("text"))
        self.window, self.offsets = window, words.offsets
        self.hash = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
        self.ids = b.column("id").to_numpy()
        self.at = starts(words.offsets, window)
        self.owner = np.repeat(np.arange(len(self.ids)), np.diff(words.offsets))
        self.part = rolling(self.hash, half)
        self.anchor = sliding_low(self.part, window - half + 1)[self.at] if len(self.at) else self.at
        self.anchor_hash = self.part[self.anchor].view(np.int64)

    def of_known(self, known: np.ndarray) -> "Batch":
        """Without the windows whose anchors aren't known to be repeated."""
        good = np.isin(self.anchor_hash, known)
        self.at, self.anchor, self.anchor_hash = self.at[good], self.anchor[good], self.anchor_hash[good]
        return self

    def full(self, at: np.ndarray) -> np.ndarray:
        """Second hash of the windows that begin at flat positions, beside their anchors'."""
        return rolling(self.hash * _SALT ^ (self.hash >> np.uint64(17)), self.window)[at].view(np.int64)

    def split(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ranges, cut where a document ends."""
        cuts = np.unique(self.offsets)
        which = np.searchsorted(begin, cuts, side="right") - 1
        cuts = cuts[(which >= 0) & (cuts > begin[which]) & (cuts < end[which])]
        return np.sort(np.concatenate([begin, cuts])), np.sort(np.concatenate([end, cuts]))


def _first(one: np.ndarray, two: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the earliest place of each key, and for each item whether its key has an earlier place."""
    order = np.lexsort((start, ids, two, one))
    a, b = one[order], two[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = order[new]
    mine = first[np.cumsum(new) - 1]
    later = np.empty(len(order), bool)
    later[order] = (ids[order] != ids[mine]) | (start[order] != start[mine])
    return first, later


def _key(doc_id):
    return F.coalesce(doc_id.cast("long"), F.lit(_LOW))


_ROWS = pa.schema([("k", pa.int64()), ("id", pa.int64()), ("hs", pa.binary())])


def _packed(ids: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each id once, with its distinct hashes as bytes."""
    order = np.lexsort((h, ids))
    ids, h = ids[order], h[order]
    new = np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(h) != 0)])
    ids, h = ids[new], h[new]
    cut = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]])
    blob = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * 8).astype(np.int32).tobytes()), pa.py_buffer(h.astype("<i8").tobytes())])
    return ids[cut[:-1]], blob


def repeated_anchors(survivors: DataFrame, window: int, length: int, before: int | None) -> DataFrame:
    """(id, h array): each document's anchors of a length that occur at two places or more anywhere.

    ``survivors`` has (id, text, h), with the repeated anchors of the level before; ``before`` is
    that level's length, none at the first level.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, id, hs): hashes at one place with its id, others with no id (k: the hash), and documents with hashes at several places (hs)."""
        for s in slices(batches, "text", FOLD_BYTES):
            b = Batch(s, window, length)
            if before is not None:
                own = Batch(s, window, before).of_known(np.unique(s.column("h").flatten().to_numpy()))
                b.anchor = b.anchor[np.isin(b.at, own.at)]
            flat = np.unique(b.anchor)
            if not len(flat):
                continue
            h, ids = b.part[flat].view(np.int64), b.ids[b.owner[flat]]
            distinct, first, which, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            lone = times == 1
            found = pa.array(ids[first], mask=~lone)
            yield pa.RecordBatch.from_arrays([pa.array(distinct), found, pa.nulls(len(distinct), pa.binary())], schema=_ROWS)
            if not lone.all():
                several = ~lone[which]
                own_ids, blobs = _packed(ids[several], h[several])
                yield pa.RecordBatch.from_arrays([pa.array(own_ids * 31), pa.array(own_ids), blobs], schema=_ROWS)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(id, h): from rows in the order of k, the documents with hashes that have two rows or a row without an id."""
        held, held_id, known = None, None, False  # the last hash, its first id while that is undecided, whether it is repeated
        for b in batches:
            told = np.flatnonzero(b.column("hs").is_valid().to_numpy(zero_copy_only=False))
            if len(told):
                rows = pa.array(told)
                blobs = b.column("hs").take(rows).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("id").take(rows).to_numpy(), [len(x) // 8 for x in blobs])), pa.array(np.frombuffer(b"".join(blobs), "<i8"))], ["id", "h"])
            rest = pa.array(np.flatnonzero(b.column("hs").is_null().to_numpy(zero_copy_only=False)))
            if not len(rest):
                continue
            k, lone = b.column("k").take(rest).to_numpy(), b.column("id").take(rest)
            some = lone.is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(lone, 0).to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(k)) + 1, [len(k)]])
            group = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
            twice = (np.diff(cut) > 1) | ~np.logical_and.reduceat(some, cut[:-1])
            extra_id = extra_h = ids[:0]
            if held is not None and held == k[0]:  # the group goes on from the batch before
                if held_id is not None and not known:
                    extra_id, extra_h = np.array([held_id]), np.array([held])
                twice[0] = True
            good = twice[group] & some
            out_id, out_h = np.concatenate([extra_id, ids[good]]), np.concatenate([extra_h, k[good]])
            last = slice(cut[-2], cut[-1])
            held, known = k[-1], bool(twice[-1])
            held_id = None if known else int(ids[last][0])
            if len(out_id):
                yield pa.RecordBatch.from_arrays([pa.array(out_id), pa.array(out_h)], ["id", "h"])

    rows = survivors.mapInArrow(fold, "k long, id long, hs binary").repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(settle, "id long, h long").groupBy("id").agg(F.collect_list("h").alias("h"))


def repeated(texts: DataFrame, window: int = WINDOW, least: int | None = None) -> DataFrame:
    """(id, ranges): each document's word ranges to remove, as an array of (begin, end); they may overlap."""
    lengths = levels(window, least or window // 2)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(h, id, at, end, w): a batch's earliest places of extended windows, as one row for each anchor's place, and ranges of its later places (w null)."""
        for s in slices(batches, "text", FOLD_BYTES):
            b = Batch(s, window, lengths[-1]).of_known(np.unique(s.column("h").flatten().to_numpy()))
            at, anchor = b.at, b.anchor
            if not len(at):
                continue
            ids, start = b.ids[b.owner[at]], at - b.offsets[b.owner[at]]
            h, own = b.part[anchor].view(np.int64), b.full(at) & ~np.int64(_OFFSET) | (anchor - at)
            first, later = _first(h, own, ids, start)
            first = np.sort(first)
            cut = np.concatenate([[0], np.flatnonzero(np.diff(anchor[first])) + 1, [len(first)]])
            lead, low = first[cut[:-1]], anchor[first[cut[:-1]]]
            lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(own[first]))
            yield pa.RecordBatch.from_arrays([pa.array(h[lead]), pa.array(ids[lead]), pa.array(low - b.offsets[b.owner[low]]), pa.nulls(len(lead), pa.int64()), lists], _NAMES)
            if later.any():
                mask = covered(int(b.offsets[-1]), at[later], at[later] + window)
                begin, end = b.split(*runs(mask))
                ids, start = b.ids[b.owner[begin]], begin - b.offsets[b.owner[begin]]
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (ids * 31 + start, ids, start, start + end - begin)), pa.nulls(len(ids), pa.list_(pa.int64()))], _NAMES)

    none = F.array().cast("array<bigint>")
    survivors, before = texts.withColumn("h", none), None
    for length in lengths:
        anchors = repeated_anchors(survivors, window, length, before)
        if length != lengths[-1]:  # the last level's survivors are looked at once only
            anchors = checkpoint(anchors)
            if anchors.isEmpty():
                return texts.sparkSession.createDataFrame([], "id long, ranges array<struct<begin:bigint,end:bigint>>")
        survivors = texts.join(anchors, "id", "left").select("id", F.when(F.col("h").isNotNull(), F.col("text")).alias("text"), F.coalesce("h", none).alias("h"))
        before = length
    places = survivors.mapInArrow(extend, "h long, id long, at long, end long, w array<long>").repartition("h")
    # windows of one anchor lie in one partition, so they are unfolded behind the shuffle
    single = places.select("h", "id", "at", "end", F.explode_outer("w").alias("w")).withColumn("begin", F.when(F.col("w").isNull(), F.col("at")).otherwise(F.col("at") - F.col("w").bitwiseAND(F.lit(_OFFSET))))
    first = F.min(F.when(F.col("end").isNull(), F.struct("id", "begin"))).over(Window.partitionBy("h", "w"))
    found = single.withColumn("first", first).where(F.col("end").isNotNull() | (F.struct("id", "begin") > F.col("first")))
    return found.groupBy("id").agg(F.collect_list(F.struct("begin", F.coalesce("end", F.col("begin") + window).alias("end"))).alias("ranges"))


_NAMES = ["h", "id", "at", "end", "w"]


def remove_repeats(docs: DataFrame, window: int = WINDOW, least: int | None = None) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept_text): each document's kept words joined by one space."""
    texts = docs.select(_key(F.col("doc_id")).alias("id"), "text")
    joined = texts.join(repeated(texts, window, least), "id", "left").select("id", "text", F.transform("ranges", lambda r: r.begin).alias("begin"), F.transform("ranges", lambda r: r.end).alias("end"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches, "text"):
            total, removed, kept = [], [], []
            for text, begin, end in zip(s.column("text").to_pylist(), s.column("begin").to_pylist(), s.column("end").to_pylist(), strict=True):
                words = (text or "").encode().split()
                total.append(len(words))
                if begin:
                    keep = np.flatnonzero(~covered(len(words), np.minimum(begin, len(words)), np.minimum(end, len(words))))
                    words = [words[i] for i in keep.tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([s.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_words", "n_removed", "kept"])

    out = joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept binary")
    kind = docs.schema["doc_id"].dataType
    return out.select(F.when(F.col("id") != _LOW, F.col("id")).cast(kind).alias("doc_id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
