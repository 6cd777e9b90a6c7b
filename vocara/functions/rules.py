"""Explainable rules over text: visa classification and the keyless extraction pass."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases that rule sponsorship out, and phrases that offer it.
VISA_NO = (
    r"must (already )?have (the )?(right to work|work authoriz)",
    r"(existing|valid) work authoriz",
    r"must be (eligible|authorized) to work",
    r"no (visa )?sponsorship",
    r"(cannot|not able to|unable to) sponsor",
    r"without sponsorship",
)
VISA_YES = (
    r"visa sponsorship",
    r"sponsor(ship)?( a| your)? visa",
    r"we (will |can )?sponsor",
    r"relocation (package|support|assistance|bonus)",
    r"eu blue card",
    r"blue card",
    r"critical skills",
    r"highly skilled migrant",
    r"\bhsm\b",
    r"\blmia\b",
    r"work permit (provided|support)",
)

# Parameters of the extraction rules; callers may pass their own.
STACK_TERMS = (
    "Go", "Python", "Java", "Scala", "Rust", "TypeScript", "React", "Kafka", "Kubernetes",
    "Docker", "gRPC", "PostgreSQL", "Redis", "Spark", "AWS", "GCP", "Azure", "Terraform",
)
COUNTRY_NAMES = (
    ("ireland", "IE"), ("germany", "DE"), ("netherlands", "NL"), ("canada", "CA"),
    ("united states", "US"), ("france", "FR"), ("spain", "ES"), ("portugal", "PT"),
    ("united kingdom", "GB"), ("poland", "PL"), ("sweden", "SE"), ("denmark", "DK"),
)
SENIORITY_TERMS = (
    ("staff", "staff"), ("principal", "staff"), ("lead", "lead"), ("senior", "senior"), ("sr", "senior"),
    ("junior", "junior"), ("jr", "junior"), ("graduate", "junior"), ("entry", "junior"), ("mid", "mid"),
)
SENIOR_YEARS, MID_YEARS = 5, 2
REMOTE_TERMS = (
    ("hybrid", "hybrid"), ("remote", "remote"), ("onsite", "onsite"), ("on-site", "onsite"), ("on site", "onsite"),
)
SALARY_PATTERN = r"([0-9][0-9,]*) - ([0-9][0-9,]*) ([A-Z]{3}) per (year|month|day|hour)"
YEARS_PATTERN = r"([0-9]{1,2})\+? years"
# The same, looking back from the fixed word: of two digits or more, the last two count.
YEARS_BEFORE = r" years(?<=((?<![0-9])[0-9]|[0-9]{2})\+? years)"


def words_pattern(words, after: str = "") -> str:
    """Any of the words, standing alone; one pass over the text finds them all. Their first
    letters are looked for before the word boundary, which costs more."""
    first = sorted({w[0] for w in words})
    ahead = f"(?=[{''.join(first)}])" if all(c.isalnum() for c in first) else ""
    return rf"{ahead}\b({'|'.join(words)})\b{after}"


TITLE_LEVEL = words_pattern([t for t, _ in SENIORITY_TERMS])
# Looks back from the fixed word, which is found faster than any of the terms.
TEXT_LEVEL = rf"level(?<=\b({'|'.join(t for t, _ in SENIORITY_TERMS)})\b[- ]level)"
REMOTE_PATTERN = words_pattern([t for t, _ in REMOTE_TERMS])
STACK_PATTERN = words_pattern(STACK_TERMS)
COUNTRY_PATTERN = words_pattern([n for n, _ in COUNTRY_NAMES])


def any_of(patterns: tuple[str, ...]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


VISA_PHRASE = "(?i)" + any_of(VISA_NO + VISA_YES)
# Every phrase above contains one of these; a text without any needs no closer look.
VISA_CORES = (
    "sponsor", "authoriz", "to work", "relocation", "blue card", "critical skills",
    "skilled migrant", "hsm", "lmia", "work permit",
)


def visa_text(signals: Column, summary: Column, body: Column | None = None) -> Column:
    """Lower-cased phrases, summary and, if given, the whole posting: what the visa rules look at."""
    parts = [F.array_join(signals, " "), F.coalesce(summary, F.lit("")), *([] if body is None else [body])]
    return F.lower(F.concat_ws(" ", *parts))


def classify_visa(
    text: Column,
    fallback: Column,
    no_patterns: tuple[str, ...] = VISA_NO,
    yes_patterns: tuple[str, ...] = VISA_YES,
) -> Column:
    """``no`` wins over ``yes``; without any rule the fallback stands."""
    return (
        F.when(F.rlike(text, F.lit(any_of(no_patterns))), "no")
        .when(F.rlike(text, F.lit(any_of(yes_patterns))), "yes")
        .otherwise(fallback)
    )


def hinted_lines(low: Column) -> Column:
    """The lines of a lower-cased text that hold a part of every visa phrase; none runs over a line end."""
    has_core = lambda line: reduce(or_, [F.contains(line, F.lit(core)) for core in VISA_CORES])
    return F.array_join(F.filter(F.split(low, "\n"), has_core), "\n")


def refine_visa(signals: Column, summary: Column, model_value: Column, body: Column | None = None) -> Column:
    lines = hinted_lines(visa_text(signals, summary, body))
    # An item of its own, so that the lines are looked for once, not once per pattern.
    return F.transform(F.array(lines), lambda text: classify_visa(text, model_value))[0]


def matched_patterns(text: Column, patterns: tuple[str, ...], label: str) -> Column:
    """Ids (``label`` and position) of the patterns that match."""
    hits = [
        F.when(F.rlike(text, F.lit(p)), F.lit(f"{label}{i}")) for i, p in enumerate(patterns)
    ]
    return F.array_compact(F.array(*hits))


def found_words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def value_of_first(found: Column, terms: tuple[tuple[str, str], ...], default: Column) -> Column:
    """The value of the first term, in the order of ``terms``, that was found."""
    chain = None
    for term, value in terms:
        hit = F.array_contains(found, term)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain.otherwise(default)


def seniority_of(title_words: Column, text_words: Column, years_text: Column) -> Column:
    """From the title, then from a level named in the text, then from the years asked for."""
    years = years_text.try_cast("int")
    by_years = (
        F.when(years >= SENIOR_YEARS, "senior")
        .when(years >= MID_YEARS, "mid")
        .when(years.isNotNull(), "junior")
        .otherwise("unknown")
    )
    in_text = value_of_first(text_words, SENIORITY_TERMS, by_years)
    return value_of_first(title_words, SENIORITY_TERMS, in_text)


def stack_of(text: Column) -> Column:
    """The known technologies named in the text, in dictionary order."""
    return F.array_intersect(F.array(*[F.lit(t) for t in STACK_TERMS]), found_words(text, STACK_PATTERN))


def visa_phrases(text: Column, low: Column) -> Column:
    """The exact phrases that hint at sponsorship or rule it out; ``low`` is the text in
    lower case. No phrase runs over a line end, so only lines with a hint get the closer look."""
    lines = F.arrays_zip(F.split(text, "\n").alias("text"), F.split(low, "\n").alias("low"))
    hinted = F.filter(lines, lambda line: reduce(or_, [F.contains(line["low"], F.lit(core)) for core in VISA_CORES]))
    phrases = F.transform(hinted, lambda line: F.regexp_extract_all(line["text"], F.lit(VISA_PHRASE), F.lit(0)))
    return F.coalesce(F.flatten(phrases), F.array().cast("array<string>"))


def visa_of_phrases(phrases: Column) -> Column:
    """The class of a text from its phrases. No ruling-out phrase can start inside an
    offering one, so looking at the phrases is looking at the text."""
    ruled_out = F.exists(phrases, lambda p: F.rlike(F.lower(p), F.lit(any_of(VISA_NO))))
    return F.when(ruled_out, "no").when(F.size(phrases) > 0, "yes").otherwise("unknown")


def country_of(location: Column) -> Column:
    return value_of_first(found_words(F.lower(location), COUNTRY_PATTERN), COUNTRY_NAMES, F.lit(None))


def salary_of(span: Column) -> Column:
    """``90,000 - 120,000 EUR per year`` as a struct, null when the span is empty."""
    part = lambda i: F.regexp_extract(span, SALARY_PATTERN, i)
    amount = lambda i: F.replace(part(i), F.lit(","), F.lit("")).try_cast("double")
    return F.when(
        span != "",
        F.struct(
            amount(1).alias("min"), amount(2).alias("max"),
            part(3).alias("currency"), part(4).alias("period"),
        ),
    )
