"""Source divergence audit: term counting by brute force, whole results against SQL on edge cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd

from vocara.llm.divergence import TERM, count_terms_in, divergence, oracle

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_counting_equals_regex():
    rng = random.Random(7)
    alphabet = ["a", "Z", "q", " ", ".", "é", "ß", "日本", "😀", "@", "[", "`", "{", "0", "\n", "x" * 9, "Y" * 20]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(300)]
    groups = np.array([rng.randrange(3) for _ in texts])
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    got = {(g, t.decode()): (n, d) for g, t, n, d in count_terms_in(np.frombuffer(b"".join(raw), np.uint8), offsets, groups)}
    want_n, want_d = Counter(), Counter()
    for g, t in zip(groups, texts, strict=True):
        terms = re.findall(TERM, t.translate(LOWER))
        want_n.update((int(g), w) for w in terms)
        want_d.update((int(g), w) for w in set(terms))
    assert got == {k: (want_n[k], want_d[k]) for k in want_n}


def _sql(frame: pd.DataFrame, min_docs: int) -> list[tuple]:
    con = duckdb.connect()
    con.register("documents", frame)
    query = oracle().replace(">= 30", f">= {min_docs}")
    return sorted(con.execute(f"SELECT lang, source, part, item, value, rank FROM ({query})").fetchall())


def test_edge_cases_against_sql(spark):
    rows = []
    for i in range(40):
        rows.append((i, f"Alpha beta GAMMA {'delta ' * (i % 3)}ünïcode{i % 2} averyveryverylongtermxx", "en", f"s{i % 3}", "x"))
    rows += [(100, None, "en", None, "x"), (101, "alpha", None, "s1", None), (101, "alpha", None, "s1", None), (102, "", "fr", "t", "y"), (103, "zz", "fr", "u", "y")]
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs = spark.createDataFrame(frame.astype(object).where(frame.notna(), None), "doc_id long, text string, lang string, source string, n_chars string")
    for min_docs in (2, 30):
        got = sorted(tuple(r) for r in divergence(docs, min_docs=min_docs).collect())
        assert got == _sql(frame, min_docs)
    got = divergence(docs).collect()
    assert {(r["lang"], r["source"]) for r in got if r["part"] == "pair"} >= {("fr", "t"), ("fr", "u"), ("en", "")}
    assert all(r["value"] == 0 for r in got if r["lang"] == "fr")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence(docs).count() == 0
