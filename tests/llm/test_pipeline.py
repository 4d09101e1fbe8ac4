import uuid
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_nearcopies import brute as near_copies
from .test_packing import check
from .test_quality import brute as figures
from .test_secrets import brute as spans

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs, last = spark.read.parquet(f"{SF}/documents.parquet"), None
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name == "packing":
            last = before
            break
        assert docs.columns == columns
        seen[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = seen["quality_rules"]
    failed = {d for d, r in before.items() if (f := figures(r.text))[0] < 20 or 100 * f[4] > 30 * f[0]}
    assert not failed & set(after) and len(after) > 0.85 * (len(before) - len(failed))
    before, after = seen["simhash_near_duplicates"]
    comp = near_copies({d: r.text for d, r in before.items()})
    assert set(after) == set(comp.values()) and all(after[d] == before[d] for d in after)
    before, after = seen["decontamination"]
    leaks = {d for d, r in before.items() if any(t in r.text for t in items)}
    assert leaks and not leaks & set(after) and len(after) >= len(before) - len(leaks) - 3
    before, after = seen["secret_scan"]
    assert set(before) == set(after)
    for d, r in before.items():
        places, out, at = [tuple(map(int, s.split(":")[1:])) for s in spans(r.text).split(",") if s], "", 0
        for a, b in places:
            out += r.text[at:a] + "[SECRET]" if a >= at else ""
            at = max(at, b)
        assert after[d].text == out + r.text[at:] and after[d].n_chars == len(after[d].text)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {d: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for d, r in last.items()}
    assert check(rows, ids, 4096) == 0
    pieces = defaultdict(dict)
    for r in rows:
        pieces[r.doc_id][r.start] = r.ids
    assert all([i for s in sorted(p) for i in p[s]] == ids[d] for d, p in pieces.items())


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _key string, _spans string, fp long, t long, h array<long>, score double"


def odd_rows():
    good = " ".join(f"plain word{chr(97 + i % 26)} here and there{chr(97 + i // 26)}" for i in range(40))
    rows = [(1, good), (2, good), (2, good), (3, None), (4, ""), (None, good + " of its own"), (5, "token = 'abcdefgh12345' " + good.upper()), (6, "x " * 30_000), (7, "w" * 300_000), (7, "another text of the same id " + good[::-1])]
    return [(i, t, None, "s", len(t or ""), "k", "sp", 1, 2, [3], None) for i, t in rows]


def test_stages_with_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names pass each stage; columns stay as they are."""
    docs = spark.createDataFrame(odd_rows(), COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        for own in (docs, docs.limit(0)):
            out = stage(spark, own, "/root/testdata/sf0.001")
            rows = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            elif own is docs:
                assert sum(r.length for r in rows if r.doc_id == 3) == 1 and {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
        if name == "simhash_near_duplicates":
            kept = sorted((r.doc_id or 0, (r.text or "")[:8]) for r in stage(spark, docs, "").collect())
            assert kept == [(1, "plain wo"), (3, ""), (6, "x x x x "), (7, "another "), (7, "wwwwwwww")]
        if name == "secret_scan":
            assert [r.text[:18] for r in stage(spark, docs, "").collect() if r.doc_id == 5] == ["[SECRET]' PLAIN WO"]


def test_a_run_goes_on_where_it_stopped(spark, monkeypatch):
    """Under a name, stages that are written whole aren't run again, and outputs behind them are gone."""
    calls, name = [], uuid.uuid4().hex

    def stage(letter, fail=False):
        def run(spark, docs, sf_dir):
            calls.append(letter)
            if fail:
                raise RuntimeError(letter)
            return docs.where("doc_id % 2 = 0") if letter == "a" else docs

        return letter, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c", True), stage("d")])
    with pytest.raises(RuntimeError):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001", name)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c"), stage("d")])
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001", name)
    assert out.count() == 100 and calls == ["a", "b", "c", "c", "d"]
