import random
import re
from collections import defaultdict

from pathlore.llm import decontam
from pathlore.llm.queries import op2_decontamination

SF = "/root/testdata/sf0.001"


def plain_word(w):
    """A word without outer punctuation, written out by hand."""
    good = [c.isalpha() or c.isnumeric() for c in w]
    a = next((i for i, c in enumerate(w) if good[i] or c in "$€£+%-"), len(w))
    b = next((i for i in range(len(w) - 1, -1, -1) if good[i] or w[i] == "%"), -1)
    return w[a : b + 1] if b >= a else ""


def independent_template(text, ordinary):
    out, plain, begins, after = [], [], True, False
    for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        core = plain_word(w)
        low = core.lower()
        if low:
            number = re.fullmatch(r"[+-]?[$€£]?\d([\d.,:/]*\d)?%?", core) is not None
            name = core[0].isupper() and not core.isupper() and not (begins and low in ordinary)
            out.append("<num>" if number else "<unit>" if after and low in decontam.UNITS else "<name>" if name else low)
            plain.append(low)
            after = number
        begins = w[-1] in ".!?:;|\"'»)" or not core
    return out, plain


def lower_words(items):
    return {c.lower() for q in items for w in (q or "").split() if (c := plain_word(w)) and (not c[0].isupper() or c.isupper()) and not re.fullmatch(r"[+-]?[$€£]?\d([\d.,:/]*\d)?%?", c)}


def brute(docs, items):
    """Pairs with half of the item's usable windows at one shift and consistent slots: a part of what counts."""
    out, ordinary = set(), lower_words([q for _, q in items])
    items = [(i, *independent_template(q, ordinary)) for i, q in items]
    for d, text in docs:
        words, plain = independent_template(text, ordinary)
        for i, iw, ip in items:
            k = min(8, len(iw))
            if i is None or k < 5:
                continue
            usable = [a for a in range(len(iw) - k + 1) if 2 * sum(w in ("<num>", "<unit>", "<name>") for w in iw[a : a + k]) <= k]
            by_shift = defaultdict(set)
            for a in range(len(iw) - k + 1):
                for p in range(len(words) - k + 1):
                    if a in usable and words[p : p + k] == iw[a : a + k] or plain[p : p + k] == ip[a : a + k]:
                        by_shift[p - a].add(a)
            for shift, ats in by_shift.items():
                slots = {(iw[x], ip[x], plain[x + shift]) for a in ats for x in range(a, a + k) if iw[x] in ("<num>", "<unit>", "<name>")}
                names = {(s, t) for n, s, t in slots if n == "<name>"}
                if len(ats) >= 0.5 * (len(iw) - k + 1) and len({s for _, s, _ in slots}) == len({x[1:] for x in slots}) and len({t for _, t in names}) == len(names):
                    out.add((d, i))
    return out


def test_against_plain_search(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {(r.doc_id, r.item_id) for r in op2_decontamination(spark, SF).collect()}
    assert got and brute(docs, items) == got
    whole = {(r.doc_id, r.item_id) for r in spark.sql(f"SELECT doc_id, item_id FROM parquet.`{SF}/documents.parquet` d, parquet.`{SF}/benchmark.parquet` b WHERE contains(d.text, b.text)").collect()}
    assert whole <= got


def test_templates_equal_independent_ones():
    import numpy as np
    import pyarrow as pa

    rng, pieces = random.Random(5), ["Ann", "ann", "The", "the", "12", "$3.50", "kg", "(kg)", "end.", "\"Quote\"", "5%", "-", "...", "É", "é!", "NASA", "x\ty", "3/4:", "1.", "'s"]
    texts = [" ".join(rng.choices(pieces, k=rng.randrange(0, 12))) for _ in range(300)] + [None, "", " "]
    ordinary = frozenset(["the", "x"])
    hashes, plain, _, offsets, _ = decontam._templates(pa.array(texts, pa.string()), ordinary)
    for i, t in enumerate(texts):
        want = independent_template(t, ordinary)
        assert decontam.template(t, ordinary) == want
        at = slice(offsets[i], offsets[i + 1])
        assert np.array_equal(hashes[at], decontam.string_hashes(pa.array(want[0], pa.string()))) and np.array_equal(plain[at], decontam.string_hashes(pa.array(want[1], pa.string())))


Q = "A farmer called Ann sells 12 kg of apples to Bob and then 12 kg of pears to Carl before the market closes"
OTHER = "Start here. A farmer called Eve sells 7 km of apples to Dan and then 7 km of pears to Finn before the market closes tonight"
BROKEN = "A farmer called Eve sells 7 kg of apples to Dan and then 9 kg of pears to Finn before the market closes"


def test_slots(spark):
    docs = [(1, Q, "q", 0), (2, OTHER, "q", 0), (3, BROKEN, "q", 0), (4, None, None, None), (5, "", "x", 1), (None, Q, "x", 1), (1, Q, "q", 0), (6, "short five word question here " + "y" * 100_000, "x", 1)]
    items = [(7, Q), (8, "short five word question here"), (9, None), (None, Q), (10, "too short")]
    df = spark.createDataFrame(docs, "doc_id long, text string, words string, item_id long")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.verbatim) for r in decontam.matches(df, b).collect()}
    assert got == {(1, 7, True), (2, 7, False), (None, 7, True), (6, 8, True)}
    assert sorted((r.doc_id or 0) for r in decontam.drop_contaminated(df, b).collect()) == [0, 3, 4, 5]
    assert decontam.matches(df.limit(0), b).count() == 0 and decontam.matches(df, b.limit(0)).count() == 0


def test_edited_and_partial_copies(spark):
    words = Q.split()
    texts = {
        1: [*words[:11], "also", *words[11:]],
        2: [*words[:11], *words[12:]],
        3: words[: len(words) // 2],
        4: words[:9],
        5: ["so", *words[11:], "while", *words[:11]],
        6: [w.upper() if w in ("called", "pears") else w for w in words],
    }
    long = " ".join(f"term{i}" for i in range(200))
    docs = [(d, "It says: " + " ".join(t)) for d, t in texts.items()] + [(7, " ".join(long.split()[50:64])), (8, " ".join(long.split()[50:60]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, Q), (2, long)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.coverage for r in decontam.matches(df, b).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 1), (5, 1), (6, 1), (7, 2)}
    assert got[1, 1] == 1 and got[3, 1] == round(11 / 23, 6) and got[7, 2] == 0.07


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, Q), (1, "clean text of the same id")], "doc_id long, text string")
    got = decontam.drop_contaminated(df, spark.createDataFrame([(7, Q)], "item_id long, text string")).collect()
    assert [r.text for r in got] == ["clean text of the same id"]


def found(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string")
    b = spark.createDataFrame([(f"item {i}", q) for i, q in enumerate(items)], "item_id string, text string")
    return {(r.doc_id, int(r.item_id[5:]), r.verbatim) for r in decontam.matches(df, b).collect()}


def test_verbatim_items_of_mostly_numbers(spark):
    item = "Compute 12 + 30 - 4 * 9 = 24 and 5 * 7 = 35"
    assert found(spark, [f"Before it. {item} after it.", "Compute 13 + 31 - 5 * 8 = 25 and 6 * 8 = 36"], [item]) == {(0, 0, True)}


def test_names_at_the_beginning_of_sentences(spark):
    item = "Natalia sold 48 clips in the market in April. Natalia sold half as many in the next month, and the rest was left"
    doc = "Maria sold 30 clips in the market in June. Maria sold half as many in the next month, and the rest was left"
    broken = "Maria sold 30 clips in the market in June. Paula sold half as many in the next month, and the rest was left"
    got = found(spark, [doc, broken], [item, "the clips were sold in the market"])
    assert (0, 0, False) in got and (1, 0) not in {x[:2] for x in got}


def test_slots_hold_in_both_directions(spark):
    item = "On that day Ann gave the red box to Bob before lunch and Bob gave the blue box back to Ann at night"
    merged = item.replace("Ann", "Eve").replace("Bob", "Eve")
    assert found(spark, [item.replace("Ann", "Eve").replace("Bob", "Dan"), merged], [item]) == {(0, 0, False)}


def test_short_items_are_whole_lines(spark):
    docs = ["first line\n  Who are you? \nlast line", "he asked who are you today", "WHO ARE YOU", None, ""]
    assert found(spark, docs, ["Who are you?", "", None, "..."]) == {(0, 0, True), (2, 0, True)}


def test_filter_loses_no_hash(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    own = rng.integers(-(2**63), 2**63 - 1, 5000)
    f = decontam.Filter(spark.createDataFrame([(int(x),) for x in own], "h long"))
    assert len(f.maybe(own)) == 5000 and len(f.maybe(rng.integers(-(2**63), 2**63 - 1, 100_000))) < 50


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, Q, "a", "b"), (2, "clean", "a", "b")], "doc_id long, text string, _key string, _gone string")
    got = decontam.drop_contaminated(df, spark.createDataFrame([(7, Q, 1)], "item_id long, text string, doc_id long"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, "clean", "a", "b")]


def test_questions_of_mostly_numbers(spark):
    items = ["Compute 12 + 30 - 4 * 9 = 24 now", "What comes next: 2, 4, 8, 16, 32, 64, ?", "1 2 3 4 5 6 7 8"]
    docs = ["Compute 15 + 31 - 7 * 2 = 99 now", "Tell me. What comes next: 3, 9, 27, 81, 243, 729, ?", "Compute 15 + 15 - 15 * 15 = 15 now", "what comes first: 3, 9, 27, 81, 243", "11 12 13 14 15 16 17 18", "0 1 2 3 4 5 6 7 8 9"]
    assert found(spark, docs, items) == {(0, 0, False), (1, 1, False), (5, 2, True)}


def test_names_in_lower_case(spark):
    items = ["If John has 5 apples and gives 2 to Mary then how many apples does John have left in all", "The merchant Okonkwo sold a red lamp to Ngozi and then Okonkwo left the old market place"]
    docs = [
        "if peter has 9 apples and gives 4 to anna then how many apples does peter have left in all",
        "if john has 9 apples and gives 4 to mary then how many apples does john have left in all",
        "the merchant ngozi sold a red lamp to okonkwo and then ngozi left the old market place",
        "if peter has 9 apples and gives 4 to anna then how many apples does anna have left in all",
        "IF PETER HAS 9 APPLES AND GIVES 4 TO ANNA THEN HOW MANY APPLES DOES PETER HAVE LEFT IN ALL",
    ]
    assert found(spark, docs, items) == {(0, 0, False), (1, 0, False), (2, 1, False), (4, 0, False)}


def test_folding_in_any_parts():
    rng = random.Random(7)
    for _ in range(200):
        parts = [decontam.Run(rng.random() < 0.3, rng.randrange(3), a, a + 8, 1 << a, frozenset([("<num>", str(a), str(rng.randrange(3)))] if rng.random() < 0.5 else [])) for a in (rng.randrange(40) for _ in range(rng.randrange(1, 12)))]
        cut = rng.randrange(len(parts) + 1)
        halves = decontam.folded(parts[:cut]) + decontam.folded(parts[cut:])
        assert decontam.folded(halves) == decontam.folded(parts) and decontam.judge(halves, 20) == decontam.judge(parts, 20)
