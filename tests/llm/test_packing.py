import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pathlore.llm import packing
from pathlore.llm.queries import op6_packing

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER, FAST = Tokenizer.from_file(PATH), packing.WordTokenizer(PATH)


def check(rows, ids_of, capacity):
    """Each id once, sequences gapless; returns the share of padding."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids_of[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids_of[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids_of[d])
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids = {r.doc_id: [*TOKENIZER.encode(r.text, add_special_tokens=False).ids, 2] for r in docs}
    assert check(op6_packing(spark, SF).collect(), ids, 4096) == 0


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "It's <|endoftext|>x İstanbul Σ é", 3), (4, "a " * 20000 + "b" * 5000, 4)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start long"), PATH, 64).collect()
    assert check(out, {d: [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 2] for d, t, _ in rows}, 64) == 0
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_ids_equal_the_library(texts):
    flat, ends = FAST.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert flat[ends[i] : ends[i + 1]].tolist() == TOKENIZER.encode(t, add_special_tokens=False).ids


def test_remembered_words_take_little_memory():
    tokenizer, n = packing.WordTokenizer(PATH), 20_000
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    for k in range(8):
        tokenizer.encode(pa.array([" ".join(f"w{k}x{i}" for i in range(n))]))
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes() - before
    tracemalloc.stop()
    assert held < 100 * 8 * n


def test_equal_hashes_and_forgetting(monkeypatch):
    texts = ["a b c ab", "", " ", "b c d é \u0130x", None, "ab zz d a", "x" * 3000]
    for hashes, remembered in ((lambda x: np.zeros(len(x), np.uint64), 1 << 19), (packing.string_hashes, 2)):
        monkeypatch.setattr(packing, "string_hashes", hashes)
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        tokenizer = packing.WordTokenizer(PATH)
        for own in (texts[:3], texts[3:], texts):
            flat, ends = tokenizer.encode(pa.array(own, pa.string()))
            for i, t in enumerate(own):
                assert flat[ends[i] : ends[i + 1]].tolist() == TOKENIZER.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=9), st.integers(0, 60))
def test_least_slack(lengths, target):
    have = {k: lengths.count(k) for k in lengths}
    best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= target)
    got = packing.fill(have, target)
    assert all(n <= have[k] for k, n in got.items()) and sum(k * n for k, n in got.items()) == best


def test_pool_stays_bounded():
    rng, packer, n = random.Random(5), packing.Packer(64, 1000), 0
    for d in range(500):
        for seq in packer.add(d, np.zeros(rng.randint(1, 200), np.uint32)):
            n += sum(len(x[2]) for x in seq) == 64
        assert packer.held <= 1000
    assert n > 500
