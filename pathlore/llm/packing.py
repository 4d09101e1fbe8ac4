"""Packing of token sequences by minimum bin slack.

A document's ids (with an end id) are cut into full windows of ``capacity`` and one remainder.
Remainders wait in a pool of bounded size; whenever it is full, windows are filled from it: each
starts with the longest remainder, and a subset-sum dynamic programme over a bitset of reachable
sums finds the multiset of remaining lengths that comes closest to the capacity, whose counts are
then traced back. At the end of a partition whatever a window still lacks is cut from the longest
remainder left, and the last ids go into sequences whose lengths are powers of two, so that no
padding is needed anywhere. A pool belongs to one task; nothing is shuffled, and a task that runs
again packs the same documents in the same way.

Nulls: a null text is an empty one (its only id is the end id); a null id is kept. Equal rows are
documents of their own. Texts of any length are read whole. An empty table gives no sequences. Other
columns don't matter, whatever their names.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Words, slices, string_hashes

CAPACITY, END_ID = 4096, 2
#: Ids that wait for a window at once.
POOL_IDS = 1 << 21
#: Words whose ids a worker remembers, and their bytes.
REMEMBERED, REMEMBERED_BYTES = 1 << 19, 1 << 25
#: Bytes of text whose ids are looked up at once.
SLICE_BYTES = 1 << 20

_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[\x21-\x7eß-öø-ÿÀ-ÖØ-Þ]+")
_SUFFIX = "</w>"


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: themselves, or the next from U+0100."""
    own = {b for b in range(256) if chr(b).isprintable() and b not in (32, 127) and not 128 <= b < 161 and b != 173}
    spare = iter(range(256, 512))
    return {chr(b) if b in own else chr(next(spare)): b for b in range(256)}


class WordTokenizer:
    """Ids of whole texts by a word-end BPE file, equal to the tokenizers library's, word by word.

    Texts are split at ASCII white space, which that vocabulary drops. A word of plain letters and
    signs is lower-cased, cut into pieces and merged by a byte-pair encoder with the same merge
    ranks; any other word goes through the tokenizers library itself. Each distinct word of a
    batch is looked up once. What is remembered lies in a few arrays, as objects for each word would
    take most of a worker's memory: words are found by hash and compared, so equal hashes do no harm.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path) as f:
            vocab = json.load(f)["model"]["vocab"]
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        symbols = _byte_symbols()
        ranks = {bytes(symbols[c] for c in w.removesuffix(_SUFFIX)) + b"\xff" * w.endswith(_SUFFIX): i for w, i in vocab.items() if w not in special}
        ranks.setdefault(b"\xff", max(vocab.values()) + 1)  # never left alone: each byte has a word-end form
        self.merge = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.forget()

    def forget(self) -> None:
        """Remembers the empty word only, which has no ids."""
        self.known, self.ids, self.ends = pa.array([""], pa.string()), np.zeros(0, np.uint32), np.zeros(2, np.int64)
        self.hashes, self.numbers = string_hashes(self.known), np.zeros(1, np.int64)  # by hash

    def word(self, w: str) -> bytes:
        """The word's ids, four bytes each."""
        if "<|" not in w and _PLAIN.fullmatch(w):
            ids = [i for p in _PIECE.findall(w.lower()) for i in self.merge(p.encode() + b"\xff")]
        else:
            ids = self.full.encode(w, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def places(self, vocab: pa.Array) -> np.ndarray:
        """Numbers of distinct words among those remembered, to which new ones are added."""
        h = string_hashes(vocab)
        at = self.numbers[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)]
        new = np.flatnonzero(~pc.equal(self.known.take(pa.array(at)), vocab).to_numpy(zero_copy_only=False))
        if len(new):
            words = vocab.take(pa.array(new))
            found = [self.word(w) for w in words.to_pylist()]
            at[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, words])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(found), np.uint32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) >> 2 for x in found])])
            new = new[np.argsort(h[new])]
            among = np.searchsorted(self.hashes, h[new])
            self.hashes, self.numbers = np.insert(self.hashes, among, h[new]), np.insert(self.numbers, among, at[new])
        return at

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and each text's offsets in them."""
        words = Words(texts)
        if len(self.known) > REMEMBERED or self.known.nbytes > REMEMBERED_BYTES:
            self.forget()
        at = self.places(words.vocab)
        begin, size = self.ends[at], self.ends[at + 1] - self.ends[at]
        per = size[words.codes]
        ends = np.concatenate([[0], np.cumsum(per)])
        at = np.repeat(begin[words.codes] - ends[:-1], per) + np.arange(ends[-1])
        return self.ids[at], ends[words.offsets]


@lru_cache(1)
def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of a vocabulary file, one for all tasks of a worker."""
    return WordTokenizer(path)


def fill(lengths: dict[int, int], target: int) -> dict[int, int]:
    """Counts of the multiset of ``lengths`` (length -> how many) with the largest sum up to ``target``.

    Bit s of ``reach`` tells whether the sum s is reachable; counts are added in powers of two.
    """
    mask, reach, steps = (1 << (target + 1)) - 1, 1, []
    for length in sorted(lengths, reverse=True):
        left, k = min(lengths[length], target // length) if length <= target else 0, 1
        while left and not reach >> target & 1:
            n = min(k, left)
            steps.append((length, n, reach))
            reach = (reach | reach << (length * n)) & mask
            left, k = left - n, 2 * k
        if reach >> target & 1:
            break
    total, counts = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            counts[length] = counts.get(length, 0) + n
            total -= length * n
    return counts


class Packer:
    """Pieces of sequences: lists of (document, start, ids)."""

    def __init__(self, capacity: int = CAPACITY, pool_ids: int = POOL_IDS):
        self.capacity, self.pool_ids = capacity, pool_ids
        self.pool: dict[int, list] = defaultdict(list)
        self.held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[list]:
        c = self.capacity
        whole = len(ids) // c * c
        for s in range(0, whole, c):
            yield [(doc, s, ids[s : s + c])]
        if whole < len(ids):
            self.pool[len(ids) - whole].append((doc, whole, ids[whole:]))
            self.held += len(ids) - whole
        while self.held > self.pool_ids:
            yield self._window()

    def _take(self, length: int):
        out = self.pool[length].pop()
        if not self.pool[length]:
            del self.pool[length]
        self.held -= length
        return out

    def _window(self) -> list:
        first = max(self.pool)
        out = [self._take(first)]
        for length, n in fill({k: len(v) for k, v in self.pool.items()}, self.capacity - first).items():
            out += [self._take(length) for _ in range(n)]
        slack = self.capacity - sum(len(x[2]) for x in out)
        if slack and self.pool:  # every rest is longer than the slack, or the programme had taken it
            doc, start, ids = self._take(max(self.pool))
            out.append((doc, start, ids[:slack]))
            self._keep((doc, start + slack, ids[slack:]))
        return out

    def _keep(self, piece) -> None:
        self.pool[len(piece[2])].append(piece)
        self.held += len(piece[2])

    def finish(self) -> Iterator[list]:
        while self.held >= self.capacity:
            yield self._window()
        rest = [self._take(k) for k in sorted(self.pool, reverse=True) for _ in range(len(self.pool[k]))]
        left = sum(len(x[2]) for x in rest)
        while left:
            size = 1 << left.bit_length() - 1
            out, left = [], left - size
            while size:
                doc, start, ids = rest.pop(0)
                out.append((doc, start, ids[:size]))
                if len(ids) > size:
                    rest.insert(0, (doc, start + size, ids[size:]))
                size -= len(out[-1][2])
            yield out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, pool_ids: int = POOL_IDS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): a row for each piece.

    sequence_id has the number of the partition above the sequence's number in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer, packer = tokenizer_of(tokenizer_path), Packer(capacity, pool_ids)
        base, count, rows = TaskContext.get().partitionId() << 33, 0, []

        def put(sequences):
            nonlocal count
            for sequence in sequences:
                offset = 0
                for (doc_id, total), start, ids in sequence:
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, base + count, offset, ids))
                    offset += len(ids)
                count += 1

        def flush():
            out = list(zip(*rows, strict=True))
            rows.clear()
            ids = np.concatenate(out[7]).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))
            return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *(pa.array(x, pa.int64()) for x in out[1:7]), lists], _COLUMNS)

        id_type = pa.int64()
        for s in slices(batches, "text", SLICE_BYTES):
            id_type = s.column("doc_id").type
            flat, ends = tokenizer.encode(pc.fill_null(s.column("text"), ""))
            for i, doc_id in enumerate(s.column("doc_id").to_pylist()):
                ids = np.append(flat[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                put(packer.add((doc_id, len(ids)), ids))
            if rows:
                yield flush()
            pa.default_memory_pool().release_unused()  # a worker lives on with what it has
        put(packer.finish())
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


_COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
