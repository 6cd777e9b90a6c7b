"""Typed validation of model output, as rule columns over a VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocara import schemas as S
from vocara.functions.keys import content_hash

NUMBER_TEXT = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
ISO_TIME = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
    r"([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|z|[+-][0-9]{2}:?[0-9]{2})?)?$"
)
ISO_ZONE = r"(Z|[0-9][+-][0-9]{2}:[0-9]{2})$"
# Numbers beyond this are milliseconds, smaller ones seconds.
MAX_EPOCH_SECONDS = 20_000_000_000
URL = r"^([hH][tT][tT][pP][sS]?)://([^/?#\s]+)([^?#]*)(.*)$"


def json_span(output: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty when there is none."""
    return F.regexp_extract(output, r"(?s)\{.*\}", 0)


def json_from_output(df: DataFrame, output: str = "output") -> DataFrame:
    """Adds ``json_text`` (the span, null when absent) and ``parsed`` (null when unreadable).

    Spark's reader stops after the first value. To reject spans that go on, the span must
    also read as the only item of a list and as the only member of an object.
    """
    span = F.col("json_text")
    listed = F.try_parse_json(F.concat(F.lit("["), span, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"v":'), span, F.lit("}")))
    single = F.try_variant_get(listed, "$[1]", "variant").isNull() & member.isNotNull()
    with_span = df.withColumn("json_text", F.nullif(json_span(F.col(output)), F.lit("")))
    return with_span.withColumn("parsed", F.when(single, F.try_variant_get(listed, "$[0]", "variant")))


STRING_FIELDS = ("title", "company", "location", "country", "description_summary")
ENUM_FIELDS = (
    ("remote", S.REMOTE_VALUES),
    ("seniority", S.SENIORITY_VALUES),
    ("visa_sponsorship", S.VISA_VALUES),
)
LIST_FIELDS = ("stack", "visa_signals")
SALARY_FIELDS = ("min", "max", "currency", "period")


def _absent(kind: Column) -> Column:
    return kind.isNull() | (kind == "VOID")


def _is_number(kind: Column) -> Column:
    return F.coalesce(F.rlike(kind, F.lit(r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), F.lit(False))


def _number(kind: Column, text: Column) -> Column:
    """An optional number; numeric strings and booleans count."""
    from_text = (kind == "STRING") & F.rlike(text, F.lit(NUMBER_TEXT))
    return F.when(_is_number(kind) | from_text, F.trim(text).try_cast("double")).when(
        kind == "BOOLEAN", (text == "true").cast("double")
    )


def _instant(kind: Column, text: Column) -> Column:
    """An optional point in time; naive values are taken as UTC."""
    is_number = _is_number(kind) | ((kind == "STRING") & F.rlike(text, F.lit(NUMBER_TEXT)))
    number = F.when(is_number, F.trim(text).try_cast("double"))
    seconds = F.when(F.abs(number) > MAX_EPOCH_SECONDS, number / 1000).otherwise(number)
    iso = F.when((kind == "STRING") & F.rlike(text, F.lit(ISO_TIME)), F.upper(text))
    # Spark wants seconds, and a colon in the offset.
    iso = F.regexp_replace(iso, r"^(.{10}[T ][0-9]{2}:[0-9]{2})(Z|[+-].*)?$", "$1:00$2")
    iso = F.regexp_replace(iso, r"([+-][0-9]{2}):?([0-9]{2})$", "$1:$2")
    zoned = (
        F.when(F.rlike(iso, F.lit(ISO_ZONE)), iso)
        .when(F.length(iso) == 10, F.concat(iso, F.lit("T00:00:00Z")))
        .otherwise(F.concat(iso, F.lit("Z")))
    )
    return F.coalesce(
        F.timestamp_micros((seconds * 1_000_000).try_cast("bigint")), zoned.try_cast("timestamp")
    )


def validate_records(df: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Adds ``record`` (the typed struct, null unless valid) and ``errors``.

    ``errors`` names every failing field, or ``json`` when there was nothing to read.
    A missing field takes its default, an explicit null does not.

    Every field is taken out of the document once, with its JSON type (null when the field
    is missing, VOID when it is null); the rules then work on plain columns.
    """
    v = F.col(parsed)
    simple = (*STRING_FIELDS, *[f for f, _ in ENUM_FIELDS], "posted_at")
    members = lambda names: "struct<" + ",".join(f"{n}:variant" for n in names) + ">"
    opened = {
        "_doc": F.try_variant_get(v, "$", members((*simple, *LIST_FIELDS, "salary"))),
        "_pay": F.try_variant_get(v, "$.salary", members(SALARY_FIELDS)),
    }
    taken: dict[str, Column] = {}
    for column, owner, fields in (("", "_doc", simple), ("salary_", "_pay", SALARY_FIELDS)):
        for f in fields:
            member = F.col(f"{owner}.{f}")
            taken[f"_k_{column}{f}"] = F.schema_of_variant(member)
            taken[f"_t_{column}{f}"] = F.try_variant_get(member, "$", "string")
    for f in (*LIST_FIELDS, "salary"):
        taken[f"_k_{f}"] = F.schema_of_variant(F.col(f"_doc.{f}"))
    for f in LIST_FIELDS:
        items = F.try_variant_get(F.col(f"_doc.{f}"), "$", "array<variant>")
        taken[f"_t_{f}"] = F.try_variant_get(F.col(f"_doc.{f}"), "$", "array<string>")
        taken[f"_odd_{f}"] = F.exists(items, lambda x: F.schema_of_variant(x) != "STRING")
    kind, text = (lambda f: F.col(f"_k_{f}")), (lambda f: F.col(f"_t_{f}"))

    values: dict[str, Column] = {f: F.when(kind(f) == "STRING", text(f)) for f in STRING_FIELDS}
    checks: list[tuple[str, Column]] = [(f, kind(f) == "STRING") for f in ("title", "company")]
    checks += [(f, _absent(kind(f)) | (kind(f) == "STRING")) for f in ("location", "country")]
    for f, allowed in ENUM_FIELDS:
        values[f] = F.when(kind(f).isNull(), "unknown").otherwise(text(f))
        checks.append((f, kind(f).isNull() | ((kind(f) == "STRING") & text(f).isin(*allowed))))
    for f in LIST_FIELDS:
        values[f] = F.when(kind(f).isNull(), F.array().cast("array<string>")).otherwise(text(f))
        checks.append((f, kind(f).isNull() | (F.startswith(kind(f), F.lit("ARRAY<")) & ~F.col(f"_odd_{f}"))))

    amounts = {f: _number(kind(f"salary_{f}"), text(f"salary_{f}")) for f in ("min", "max")}
    salary_ok = F.startswith(kind("salary"), F.lit("OBJECT<"))
    for f in ("min", "max"):
        salary_ok = salary_ok & (_absent(kind(f"salary_{f}")) | amounts[f].isNotNull())
    for f in ("currency", "period"):
        salary_ok = salary_ok & (_absent(kind(f"salary_{f}")) | (kind(f"salary_{f}") == "STRING"))
        amounts[f] = text(f"salary_{f}")
    values["salary"] = F.when(~_absent(kind("salary")), F.struct(*[amounts[f].alias(f) for f in SALARY_FIELDS]))
    checks.append(("salary", _absent(kind("salary")) | salary_ok))

    summary = "description_summary"
    fits = (kind(summary) == "STRING") & (F.length(text(summary)) <= S.MAX_SUMMARY_CHARS)
    checks.append((summary, _absent(kind(summary)) | fits))
    values["posted_at"] = _instant(kind("posted_at"), text("posted_at"))
    checks.append(("posted_at", _absent(kind("posted_at")) | values["posted_at"].isNotNull()))

    failing = F.array_compact(
        F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
    )
    errors = F.when(v.isNull(), F.array(F.lit("json"))).otherwise(failing)
    record = F.struct(*[values[f.name].cast(f.dataType).alias(f.name) for f in S.EXTRACTED.fields])
    # Generated columns stop a later filter from being pushed below the parsing, where
    # every mention of a field would parse the document again.
    outcome = F.inline(F.array(F.struct(errors.alias("errors"), record.alias("record"))))
    checked = df.withColumns(opened).withColumns(taken).select(*df.columns, outcome)
    return checked.withColumn("record", F.when(F.size("errors") == 0, F.col("record")))


def canonical_url(url: Column) -> Column:
    """http(s) only, host lower-cased, empty path as ``/``, other characters of the path
    percent-encoded; null when the address is not acceptable."""
    part = lambda i: F.regexp_extract(url, URL, i)
    tail = F.concat(F.when(part(3) == "", "/").otherwise(part(3)), part(4))
    encoded = F.array_join(
        F.transform(
            F.split(tail, ""),
            lambda c: F.when(F.rlike(c, F.lit(r"[^\x00-\x7F]")), F.url_encode(c)).otherwise(c),
        ),
        "",
    )
    tail = F.when(F.rlike(tail, F.lit(r"[^\x00-\x7F]")), encoded).otherwise(tail)
    return F.when(
        F.rlike(url, F.lit(URL)), F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), tail)
    )


def add_provenance(df: DataFrame, record: str = "record") -> DataFrame:
    """Expands the record and adds ``url`` (canonical), ``external_id`` and ``content_hash``.

    Expects ``source``, ``url`` and ``fetched_at`` columns next to the record.
    """
    rest = [c for c in df.columns if c not in (record, "url")]
    return df.select(
        *rest,
        F.col(f"{record}.*"),
        canonical_url(F.col("url")).alias("url"),
        F.lit(None).cast("string").alias("external_id"),
        content_hash(
            F.col(f"{record}.company"), F.col(f"{record}.title"), F.col(f"{record}.location")
        ).alias("content_hash"),
    )
