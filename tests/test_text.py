import re

from pyspark.sql import functions as F

from vocara.functions import keys, text

PAGE = """<!doctype html><html><head><title>Go Engineer | Acme</title>
<style>p{margin:0}</style></head><body><!-- <p>hidden</p> --><nav>Home</nav>
<header>Top</header><h1>Senior <b>Go</b> Engineer</h1>
<p>Acme &amp; Sons&nbsp;</p><p>  Dublin,
   Ireland </p><script>var t="</p><nav>";</script><form>Apply</form>
<p>5 &lt; 6</p><footer>Rights</footer></body></html>"""


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(
        column.alias("x")
    ).first()[0]


def cleaned(spark, html, **options):
    return one(spark, text.html_to_text(F.col("h"), **options), h=html)


def test_boilerplate_goes_and_content_stays(spark):
    assert cleaned(spark, PAGE) == "Senior\nGo\nEngineer\nAcme & Sons\nDublin,\n Ireland\n5 < 6"


def test_text_is_capped_only_on_request(spark):
    long = "<p>" + "word " * 5000 + "</p>"
    assert len(cleaned(spark, long, max_chars=12_000)) == 12_000 and len(cleaned(spark, long)) == 24_999
    assert len(cleaned(spark, long, max_chars=None)) == 24_999
    assert cleaned(spark, long, max_chars=9) == "word word"


MARKUP_CASES = [
    ("<nav>a<nav>b</nav>MENU</nav><p title='x>y'>kept</p>", "kept"),
    ("<header>a<form>b</header>kept<form><nav>c</nav>d</form>", "kept"),
    ("one</nav>two<footer>x<footer>y</footer></footer>three<nav/>four</nav>five", "one\ntwo\nthree\nfive"),
    ('<a href="a>b" title=it\'s>link</a><navy>blue</navy>', "link\nblue"),
    ("<p data-x=\"" + "y>" * 20_000 + "\">long</p>" + "<b " + "z " * 20_000 + ">bold</b>", "long\nbold"),
    ("plain", "plain"),
    ("", ""),
    ("<p>a</p>\r\n<p>b</p>", "a\nb"),
    ("<p>a</p><script>never closed <p>b</p>", "a"),
    ("<p>a\n\n\n\n\nb</p>", "a\n\nb"),
    ("<SCRIPT>x</SCRIPT><P>A</P>", "A"),
    ("<p>2 < 3 and x<y</p>", "2 < 3 and x"),
    ("<p>&#233;&#xE9;&amp;lt;&unknown; & ;</p>", "éé&lt;&unknown; & ;"),
    ("<head><title>t</title></head><p>b</p>", "b"),
    ("<headline>h</headline><headers>k</headers>", "h\nk"),
]


def test_markup_cases(spark):
    pages = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(MARKUP_CASES)], "i int, h string").orderBy("i")
    assert [r.x for r in pages.select(text.html_to_text(F.col("h")).alias("x")).collect()] == [e for _, e in MARKUP_CASES]


def test_title_prefers_the_heading(spark):
    title = text.html_title(F.col("h"))
    assert one(spark, title, h=PAGE) == "SeniorGoEngineer"
    assert one(spark, title, h="<title> Only </title><h1> </h1>") == "Only"
    assert one(spark, title, h="<p>none</p>") is None


def test_normalize_equals_a_python_expression(spark):
    samples = ["  Acme  Cloud! ", "acme, cloud", "Straße ẞ", "ÀÉ x\u001fy", "áb", "ΣΊΣΥΦΟΣ ς", "ŉ ǰ ﬁ", "x_y-z", "日本 語", ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = [r.n for r in rows.orderBy("i").select(text.normalize(F.col("s")).alias("n")).collect()]
    spaced = [re.sub(r"[^\w\s]", " ", s.casefold().strip()) for s in samples]
    assert got == [re.sub(r"\s+", " ", s).strip() for s in spaced]


def test_content_hash_is_stable_and_distinguishes(spark):
    def key(company, title, location):
        return one(spark, keys.content_hash(F.col("c"), F.col("t"), F.col("l")), c=company, t=title, l=location)

    assert key("Acme  Cloud!", "Go Engineer", "Dublin") == key("acme cloud", "GO, engineer", "dublin ")
    assert key("Acme", "Go Engineer", None) == key("Acme", "Go Engineer", "")
    assert key("Acme", "Go Engineer", "X") != key("Acme", "Data Engineer", "X")
    assert key("Acmé", "Go", None) != key("Acme", "Go", None)
    assert len(key("a", "b", "c")) == 16


def test_point_id_keeps_all_64_bits(spark):
    assert int(one(spark, keys.point_id(F.col("h")), h="ffffffffffffffff")) == 2**64 - 1


def test_job_text_has_fallbacks(spark, sample_jobs):
    full = sample_jobs.filter("company = 'Kruste'").select(text.job_text_of()).first()[0]
    assert full.split("\n")[0] == "Oven Telemetry Analyst at Kruste"
    assert "location: Ulm (DE)" in full and "stack: Scala, Redis" in full
    bare = sample_jobs.filter("company = 'Kruste'").withColumns(
        {"location": F.lit(""), "country": F.lit(None).cast("string"), "stack": F.array().cast("array<string>"),
         "description_summary": F.lit("")}
    )
    lines = bare.select(text.job_text_of()).first()[0].split("\n")
    assert lines[2] == "location: unknown (?)" and lines[4] == "stack: n/a" and len(lines) == 6


def test_steps_before_the_references_are_mentioned_once(spark):
    # Each step of a page that is mentioned twice is run twice where Spark interprets it.
    plan = spark.createDataFrame([("<p>a</p>",)], "h string").select(text.html_to_text(F.col("h")).alias("x"))
    tree = plan._jdf.queryExecution().analyzed().toString()
    assert tree.count("(?:head") == 1
    page = "<nav\rx>out</NAV\r\n><p>a\rb &amp; <header >x<nav>y</header>c</nav>\u0001d</p>"
    assert one(spark, text.html_to_text(F.col("h")), h=page) == "a\nb &\nc\nd"
