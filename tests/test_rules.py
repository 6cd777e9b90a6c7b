from pyspark.sql import functions as F

from vocara.functions import rules
from vocara.operators.extraction import rule_extract
from vocara.sources.readers import clean_pages


VISA_CASES = [
    (["LMIA ready"], None, "no", "yes"),
    ([], "Newcomers get a relocation bonus.", "unknown", "yes"),
    (["work permit provided"], "Sadly we are unable to sponsor interns.", "yes", "no"),
    ([], None, "unknown", "unknown"),
    (None, "", "yes", "yes"),
    (["sponsor of the local choir"], None, "no", "no"),
    (["valid work authorisation"], None, "unknown", "unknown"),
    (["an hsm permit"], None, "no", "yes"),
    (["ashsmx"], None, "no", "no"),
]


def test_visa_rules(spark):
    schema = "i int, s array<string>, d string, m string"
    rows = spark.createDataFrame([(i, *case[:3]) for i, case in enumerate(VISA_CASES)], schema).orderBy("i")
    got = rows.select(rules.refine_visa(F.col("s"), F.col("d"), F.col("m")).alias("x")).collect()
    assert [r.x for r in got] == [case[3] for case in VISA_CASES]


def test_the_body_counts_whole(spark):
    body = "filler " * 3000 + "we will sponsor you"
    row = spark.createDataFrame([([], None, "unknown", body)], "s array<string>, d string, m string, b string")
    assert row.select(rules.refine_visa(F.col("s"), F.col("d"), F.col("m"), F.col("b"))).first()[0] == "yes"
    page = spark.createDataFrame([("<h1>T</h1><p>C</p><p>" + body + "</p>",)], "html string")
    assert rule_extract(clean_pages(page)).first().visa_sponsorship == "yes"


def test_evidence_names_the_patterns(spark):
    row = spark.createDataFrame([("relocation package; no visa sponsorship",)], "t string")
    hits = row.select(
        rules.matched_patterns(F.col("t"), rules.VISA_NO, "no"), rules.matched_patterns(F.col("t"), rules.VISA_YES, "yes")
    ).first()
    assert hits[0] == ["no3"] and hits[1] == ["yes0", "yes3"]


CASES = [
    (
        "Lead Cartographer\nTerra Maps - Lyon, France (hybrid)\nOur maps run on Spark; a relocation bonus and "
        "visa sponsorship are part of the offer, also under Critical Skills.",
        ("Lead Cartographer", "Terra Maps", "Lyon, France", "FR", "hybrid", "lead", "yes"),
    ),
    (
        "Beekeeper\nHonig AG - Kiel, Germany\nJunior-level, on-site, with React dashboards; no sponsorship.",
        ("Beekeeper", "Honig AG", "Kiel, Germany", "DE", "onsite", "junior", "no"),
    ),
    (
        "Principal Diver\nReef Watch - Anywhere (EU)\nA remote desk between dives.",
        ("Principal Diver", "Reef Watch", "Anywhere", None, "remote", "staff", "unknown"),
    ),
    ("Clerk\nQuill\nPorto, Portugal\nWe ask for 3 years of Rust.", ("Clerk", "Quill", "Porto, Portugal", "PT", "unknown", "mid", "unknown")),
    ("", ("", "", None, None, "unknown", "unknown", "unknown")),
]


def test_rule_extraction(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = rule_extract(rows).orderBy("i").collect()
    for row, (_, expected) in zip(got, CASES):
        assert (row.title, row.company, row.location, row.country, row.remote, row.seniority, row.visa_sponsorship) == expected
    assert got[1].stack == ["React"]
    assert got[0].visa_signals == ["relocation bonus", "visa sponsorship", "Critical Skills"]


def test_salary_range(spark):
    rows = spark.createDataFrame([("T\nC\nL\nSalary 90,000 - 120,000 EUR per year",)], "text string")
    assert rule_extract(rows).first().salary.asDict() == {"min": 90000.0, "max": 120000.0, "currency": "EUR", "period": "year"}


def test_every_pattern_holds_a_core():
    # The cores only save work; a phrase without one would be overlooked.
    samples = (
        "must have right to work", "must have work authoriz", "existing work authoriz", "must be eligible to work",
        "must be authorized to work", "no sponsorship", "cannot sponsor", "without sponsorship", "visa sponsorship",
        "sponsor visa", "we sponsor", "relocation bonus", "eu blue card", "blue card", "critical skills",
        "highly skilled migrant", "hsm", "lmia", "work permit support",
    )
    assert all(any(core in s for core in rules.VISA_CORES) for s in samples)


def test_faster_patterns_find_what_the_plain_ones_find(spark):
    bodies = [
        "Senior-level Go and gRPC, on-site; no visa\nsponsorship.\nWe can sponsor a Visa, unable to sponsor",
        "xlead level lead level-level Mid-level mid level entry-levels sr level\r\nhsm\nLMIA ashsm",
        "Golang Go, Java,JavaScript remote-first Remote on site hybrid_ onsiteİ EU BLUE CARD blue card",
        "", "\n\n", None,
    ]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").orderBy("i")
    b, low = F.col("b"), F.lower("b")
    plain = lambda words, after="": F.lit(rf"\b({'|'.join(words)})\b{after}")
    terms = [t for t, _ in rules.SENIORITY_TERMS]
    got = rows.select(
        rules.found_words(low, rules.TEXT_LEVEL).alias("level"),
        F.regexp_extract_all(low, plain(terms, "[- ]level"), F.lit(1)).alias("plain_level"),
        rules.found_words(b, rules.STACK_PATTERN).alias("stack"),
        F.regexp_extract_all(b, plain(rules.STACK_TERMS), F.lit(1)).alias("plain_stack"),
        rules.found_words(low, rules.REMOTE_PATTERN).alias("remote"),
        F.regexp_extract_all(low, plain([t for t, _ in rules.REMOTE_TERMS]), F.lit(1)).alias("plain_remote"),
        rules.visa_phrases(b, low).alias("visa"),
        F.coalesce(F.regexp_extract_all(b, F.lit(rules.VISA_PHRASE), F.lit(0)), F.array()).alias("plain_visa"),
    ).collect()
    for row in got:
        assert (row.level, row.stack, row.remote, row.visa) == (row.plain_level, row.plain_stack, row.plain_remote, row.plain_visa)
    assert got[0].visa == ["We can sponsor", "unable to sponsor"] and got[1].level == ["lead", "mid", "mid", "entry", "sr"]


def test_costly_patterns_look_at_few_places():
    # before, the boundary was looked for at every character and every line got the visa patterns
    assert rules.STACK_PATTERN.startswith("(?=[") and rules.TEXT_LEVEL.startswith("level(?<=")
