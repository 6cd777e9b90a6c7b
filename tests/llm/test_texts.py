"""Repeats, personal data, toxicity, token counts and page texts."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from vocara.llm import html_text, pii, suffix_dedup, token_counts, toxicity

DIR = "/root/testdata/sf0.001"


def brute_repeats(rows, length=200):
    data = [(t or "").encode("utf-8", "surrogatepass") for _, t in rows]
    seen = {}
    for d in data:
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for (i, _), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeats(spark, rows):
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, anchor int").repartition(4)
    return sorted(tuple(r)[:5] for r in suffix_dedup.remove_repeats(frame).collect())


@pytest.mark.parametrize("hot", [512, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = np.random.default_rng(1)
    word = lambda n: " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 7))) for _ in range(n))
    passage, long = word(60), word(120)
    rows = [word(80) for _ in range(8)]
    rows += [f"{word(int(rng.integers(1, 50)))} {passage} {word(int(rng.integers(1, 50)))}" for _ in range(25)]
    rows += [f"{word(10)} {long[: int(rng.integers(190, 420))]}" for _ in range(12)] + [rows[0], rows[0], rows[1] + word(5), word(5) + rows[2]]
    rows += ["a" * 1000, "a" * 199, "a" * 201, "ab" * 300, "z" * 200, None, "", "short", "é" * 150, "x" + "0123456789" * 60]
    near = list(rows[3])
    near[len(near) // 2] = "Q"
    rows += ["".join(near), rows[4][:199], rows[4][1:201]]
    rows = list(enumerate(rows))
    assert repeats(spark, rows) == brute_repeats(rows)


def test_repeats_on_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_repeats_odd_tables(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "k" * 50 + "q" * 150 + "r" * 30), (1, "k" * 50 + "q" * 150 + "r" * 30), (2, None)]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_index_statistics_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        segments = [bytes(rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)) for _ in range(rng.integers(1, 9))]
        segments = list(dict.fromkeys(segments))
        index = suffix_dedup.RunLengthIndex(segments)
        assert index.run_length.sum() == sum(map(len, segments))
        suffixes = [s[i:] for s in segments for i in range(len(s))]
        common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        expected = [max([common(s, t) for j, t in enumerate(suffixes) if i != j], default=0) for i, s in enumerate(suffixes)]
        assert index.matching_statistics().tolist() == expected


def plain_base(text):
    out = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
                if not 12 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(4)
    alphabet = list("ab1234567890123456789@@..--+++()  %_é")
    for _ in range(3000):
        text = "".join(rng.choice(alphabet, rng.integers(0, 60)))
        assert pii.base_spans(text) == plain_base(text), text
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        assert pii.base_spans(r["text"]) == plain_base(r["text"])
    assert pii.base_spans("4111 1111-1111 1111 a.b@c.de +1 (017) 555-7713 1.2.3.4.5 " + "9" * 100_000)


def test_gradients_of_the_tagger():
    tagger = pii.Tagger()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    rng = np.random.default_rng(1)
    symbols, tags = rng.integers(0, pii.SYMBOLS, (3, 7)), rng.integers(0, pii.TAGS, (3, 7))
    _, grad = tagger.gradients(symbols, tags)
    for name in tagger.p:
        spot = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        change = []
        for step in (1e-3, -2e-3):
            tagger.p[name][spot] += step
            change.append(tagger.gradients(symbols, tags)[0])
        tagger.p[name][spot] += 1e-3
        assert abs((change[0] - change[1]) / 2e-3 - grad[name][spot]) < 0.02 * abs(grad[name][spot]) + 2e-3, name


def test_tagger_finds_held_out_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tagger = pii.train(docs)
    rng = np.random.default_rng(99)
    good = wanted = found = 0
    for n in range(200):
        kind = pii.KINDS[n % 4]
        made = pii._made(kind, rng)
        text = f"the on ing ention {made} and reon, thea"
        wanted += 1
        spans = pii.tagged_spans(tagger, [text])[0]
        found += len(spans)
        good += (kind, 18, 18 + len(made)) in spans
    assert good >= 0.85 * wanted and good >= 0.85 * found


def test_find_spans_and_redact(spark):
    rows = [
        (1, "mail a.b@c.de now", 17), (2, None, None), (3, "", 0), (4, "nothing here", 12), (4, "nothing here", 12), (5, "ip 10.0.0.1, card 4111111111111111 " * 30, 5),
        (None, "x@y.zz", 6),
    ]
    frame = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = {r["doc_id"]: r for r in pii.find_spans(frame).collect()}
    assert got[1]["n_email"] == 1 and "email:5:13" in got[1]["spans"] and got[2]["spans"] == "" and got[5]["n_ip"] == got[5]["n_card"] == 30
    for i, text, _ in rows:
        if i:
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(text or ""))
            assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
            assert set(base.split(",")) <= set(got[i]["spans"].split(","))
    clean = pii.redact(frame)
    assert clean.columns == frame.columns and clean.count() == len(rows)
    after = {r["doc_id"]: r for r in clean.collect()}
    assert after[1]["text"] == "mail [email] now" and after[1]["n_chars"] == 16 and after[2]["text"] is None and after[4]["text"] == "nothing here"
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_spans(empty).count() == 0 and pii.redact(empty).count() == 0


def test_windows_do_not_cut_spans(spark):
    tagger = pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rng = np.random.default_rng(5)
    ips = " ".join(".".join(map(str, rng.integers(0, 256, 4))) for _ in range(60))
    spans = pii.tagged_spans(tagger, [ips])[0]
    exact = {("ip", m.start(), m.end()) for m in re.finditer(r"\S+", ips)}
    assert len(exact & set(spans)) >= 50


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(r["toxic"], got[r["doc_id"]]["predicted"]) for r in labels.collect() if r["doc_id"] in got and got[r["doc_id"]]["held_out"]]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.85 and hit / sum(b for _, b in held) > 0.85


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 1.0), (3, "you idiot", 1.0), (3, "you idiot", 1.0), (None, "x", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 3] and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0
    assert toxicity.reject_toxic(docs.where("doc_id is not null"), labels).columns == docs.columns


def test_label_model_separates_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(20_000) < 0.1
    votes = np.stack([np.where(y, rng.random(y.size) < 0.7, rng.random(y.size) < 0.02) for _ in range(toxicity.VOTERS)], axis=1).astype(int)
    votes[:, -1] = votes[:, -2]  # a copy must not count twice
    known = rng.random(y.size) < 0.2
    model = toxicity.LabelModel(votes, (~known).astype(float), (known & ~y).astype(float), (known & y).astype(float))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.99
    pair = {toxicity.VOTERS - 1, toxicity.VOTERS - 2}
    assert any({j, int(k)} == pair for j, k in enumerate(model.parent))


def test_token_counts_equal_the_library(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = token_counts.word_counts(public_tokenizers.path("piece_bpe_32k.model"))
    assert counts.proven and counts.first > 10_000
    rng = np.random.default_rng(1)
    alphabet = list("ab e   \n\tthxé日🙂▁<s>0.,") + [" the", "</s>", "<0x0A>", "ﬁ", "́", "　"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()] + ["", " ", "  ", "a ", " a", "x" * 20_000, "a  b   c    "]
    for text in texts:
        assert counts.of(text) == len(model.encode(text)), repr(text[:60])
    rows = [(1, None), (2, ""), (3, "aé b"), (3, "aé b"), (None, "x"), (4, "w " * 5000)]
    got = sorted(tuple(r) for r in token_counts.count_tokens(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")).collect())
    assert got == sorted((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 4096) for i, t in rows if i)
    assert token_counts.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a></li></ul></nav><!-- <p>no</p> --><div class="ad">Buy &amp; go, now, please, today, here</div>
<div class="cookie-notice">We use cookies, many of them, for you, and for us.</div>
<article><header><h1>Title &lt;1&gt;</h1></header><p>First,  long
 paragraph with <b>bold</b> and <a href=x title="a>b">a link</a>, and so on, for a while.<p>Second &eacute;&#33; paragraph, unclosed, with a <br>break.
<ul><li>item one</li><li>item two</ul><form><input value=1><label>Send</label></form><section class="comments"><p>Reader says, well, hello there, this is long.</p></section></article>
<aside>Aside text, with, commas, in, it.</aside><footer>&copy; Foot, all rights, reserved.</footer></body></html>"""


def test_main_text_of_an_article():
    assert html_text.main_text(PAGE) == (
        "Title <1>\nFirst, long paragraph with bold and a link, and so on, for a while.\nSecond é! paragraph, unclosed, with a break.\nitem one\nitem two"
    )


def test_main_text_without_article_elements():
    long = "A sentence with words, commas, and more words that go on for quite some time, so that it scores well. " * 2
    links = "".join(f'<li><a href="/{i}">A rather long link text, with commas, number {i}</a></li>' for i in range(30))
    page = f"<body><div><ul>{links}</ul></div><div id=content><p>{long}</p><p>{long}</p><p>End.</p></div><div class=sidebar><p>{long}</p></div><div><p>tiny</p></div></body>"
    assert html_text.main_text(page) == "\n".join([long.strip(), long.strip(), "End."])


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("<p>", ""), ("plain words", "plain words"), ("a < b &am", "a < b &am"), ("<article><p>x<a hre", "x"), ("<div " * 5000, ""), ("<div>" * 20000 + "deep", "deep"), ("<script>never", "")])
def test_main_text_of_broken_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract_text_on_pages(spark):
    got = html_text.extract_text(spark.read.parquet(f"{DIR}/pages.parquet")).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert len(got) == len(pages)
    import html as h

    for r in got:
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        plain = "\n".join(b for b in blocks if b)
        assert re.sub(r"\s", "", r["text"]) == re.sub(r"\s", "", plain) and r["n_chars"] == len(r["text"])
        assert r["text"].count("\n") == plain.count("\n")
    odd = spark.createDataFrame([(None, None, "<p>x</p>", 1), (2, "u", None, 1), (2, "u", None, 1)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.extract_text(odd).collect()) == [(0, "x", 1), (2, "", 0), (2, "", 0)]
    assert html_text.extract_text(odd.where("false")).count() == 0


def test_short_blocks_beside_the_body_stay():
    body = "A long sentence, with commas, that goes on and on about the matter at hand. " * 6
    page = f"<body><nav><a href=x>Menu</a></nav><div><h2>Title</h2><div id=body><p>{body}</p><p>{body}</p></div><p>Short end.</p><p><a href=y>Next</a></p></div></body>"
    assert html_text.main_text(page).split("\n") == ["Title", body.strip(), body.strip(), "Short end."]


def test_a_form_around_the_page_is_a_container():
    body = "A long sentence, with commas, that goes on and on about the matter at hand. " * 6
    inner = f"<div id=body><p>{body}</p><p>{body}</p></div>"
    assert html_text.main_text(f"<body><form action=x>{inner}<button>Send</button></form></body>") == f"{body.strip()}\n{body.strip()}"
    assert "Your name" not in html_text.main_text(f"<body>{inner}<form><p>Your name and your message, please, in the field below.</p></form></body>")


def test_training_windows_are_distinct(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "labelled", lambda rows: seen.append(rows) or ((), ()))
    monkeypatch.setattr(pii.Tagger, "fit", lambda self, *a: None)
    texts = ["card 4111111111111111 of a copy"] * 3000 + [f"number {i} call 0{i}555 now" for i in range(100, 140)]
    pii.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert len(set(seen[0])) == 41 and max(map(seen[0].count, seen[0])) == 2
