"""Benchmark decontamination: brute force, parts of the test set, edge cases, span removal."""

import re

import pytest

from vocara.llm.decontam import WORD, contamination_digest, decontaminate, find_contamination

BENCH = "item_id long, text string"
DOCS = "doc_id long, text string, lang string"


def brute(texts, items, window=10):
    """Covered word count and items per text, straight from the contract."""
    low = lambda t: re.findall(WORD, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    wins = []
    for item_id, text in items:
        w = low(text)
        if len(w) >= window:
            wins += [(item_id, tuple(w[i : i + window])) for i in range(len(w) - window + 1)]
        elif w:
            wins.append((item_id, tuple(w)))
    out = []
    for text in texts:
        w = low(text)
        hit, met = set(), set()
        for item_id, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    met.add("" if item_id is None else str(item_id))
        out.append((len(w), len(hit), sorted(met)))
    return out


def _case(spark):
    passage = " ".join(f"w{i}" for i in range(25))
    items = [(1, passage), (2, "Short Item here"), (None, "nul item words"), (3, None), (4, ""), (5, passage)]
    texts = [
        None,
        "",
        f"Before. {passage.upper()} after",
        "x short item here y SHORT item",
        "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10",
        "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w15 w16 w17 w18 w19 w20 w21 w22 w23 w24 nul item words",
        ("filler " * 30000) + passage,
        f"{passage} {passage}",
    ]
    return texts, items


@pytest.mark.parametrize("per_pass", [1_000_000, 3])
def test_against_brute_force(spark, per_pass):
    texts, items = _case(spark)
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[2], None)], DOCS)
    bench = spark.createDataFrame(items, BENCH)
    got = {r["doc_id"]: r for r in find_contamination(docs, bench, per_pass=per_pass).collect()}
    want = brute(texts, items)
    for i, (n, hit, met) in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, met), i
    assert got[None]["n_hit"] == want[2][1] and got[None]["lang"] is None
    assert got[2]["items"] == ["1", "5"] and got[5]["items"] == ["", "1", "5"]


def test_digest_and_repeats(spark):
    texts, items = _case(spark)
    docs = spark.createDataFrame([(7, texts[3], "de"), (7, texts[3], "de"), (8, texts[0], None)], DOCS)
    rows = contamination_digest(docs, spark.createDataFrame(items, BENCH)).collect()
    assert len(rows) == 3
    hit = [r for r in rows if r["doc_id"] == 7]
    assert all(r["n_hit"] == 3 and r["n_items"] == 1 and r["contaminated"] for r in hit)
    import hashlib

    assert hit[0]["items_sha256"] == hashlib.sha256(b"2").hexdigest()
    none = [r for r in rows if r["doc_id"] == 8][0]
    assert (none["n_words"], none["n_hit"], none["contaminated"]) == (0, 0, False)
    assert none["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 99, "keep")], "doc_id long, text string, n_hit long, hits string")
    bench = spark.createDataFrame([(1, "b c")], BENCH)
    row = find_contamination(docs, bench).collect()[0]
    assert row["n_hit"] == 2 and row["hits"][0]["c0"] == 2 and row["hits"][0]["c1"] == 5
    assert find_contamination(docs, spark.createDataFrame([], BENCH)).collect()[0]["n_hit"] == 0
    assert find_contamination(docs.limit(0), bench).count() == 0


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"Keep this. {passage}! tail", "en"), (2, "clean text", "en"), (3, None, "en")], DOCS)
    bench = spark.createDataFrame([(9, passage)], BENCH)
    cut = {r["doc_id"]: r["text"] for r in decontaminate(docs, bench).collect()}
    assert cut == {1: "Keep this. ! tail", 2: "clean text", 3: None}
    kept = decontaminate(docs, bench, mode="documents")
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3] and kept.columns == docs.columns
