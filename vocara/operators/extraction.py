"""Model extraction as dataflow: requests, tiered attempts, cache."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vocara import schemas as S
from vocara.functions import rules
from vocara.functions.keys import text_hash
from vocara.operators.picking import keep_first
from vocara.operators.validation import json_from_output, validate_records
from vocara.session import materialize

# A provider turns (text_hash, text, tier, attempt) into RESPONSE rows; one that never fails may
# leave out ``error``, which tells why a call failed for another reason than its answer.
Provider = Callable[[DataFrame], DataFrame]
RESPONSE = T.StructType(
    [
        T.StructField("text_hash", T.StringType()),
        T.StructField("attempt", T.IntegerType()),
        T.StructField("tier", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("output", T.StringType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)
MAX_OUTPUT_TOKENS = 1_500
INSTRUCTIONS = (
    "Read the job posting below and answer with one JSON object that fits the schema. "
    "State only what the posting says: use null, or unknown for an enumeration, otherwise. "
    "Take seniority from the title or the years required. Set visa_sponsorship to yes only "
    "for an explicit offer and to no when existing work authorisation is demanded. List "
    "concrete technologies in stack and quote sponsorship phrases in visa_signals. Give "
    "country as a two-letter code."
)


def record_schema() -> str:
    """A JSON schema of the record, derived from the declared Spark schema."""

    def of(data_type: T.DataType) -> dict:
        if isinstance(data_type, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in data_type}}
        if isinstance(data_type, T.ArrayType):
            return {"type": "array", "items": of(data_type.elementType)}
        if isinstance(data_type, T.DoubleType):
            return {"type": "number"}
        if isinstance(data_type, T.TimestampType):
            return {"type": "string", "format": "date-time"}
        return {"type": "string"}

    schema = of(S.EXTRACTED)
    schema["required"] = ["title", "company"]
    schema["properties"]["remote"]["enum"] = list(S.REMOTE_VALUES)
    schema["properties"]["seniority"]["enum"] = list(S.SENIORITY_VALUES)
    schema["properties"]["visa_sponsorship"]["enum"] = list(S.VISA_VALUES)
    schema["properties"]["description_summary"]["maxLength"] = S.MAX_SUMMARY_CHARS
    return json.dumps(schema)


def user_prompt(text: Column) -> Column:
    return F.concat(F.lit(f"Record shape:\n{record_schema()}\n\nPosting:\n"), text)


def build_requests(postings: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """One request per distinct text that the cache does not hold.

    Expects ``seq`` and ``text``; returns ``text_hash``, ``system``, ``prompt`` and
    ``max_tokens``, ready for a JSON-lines batch file.
    """
    distinct = keep_first(postings.withColumn("text_hash", text_hash(F.col("text"))), "text_hash", "seq")
    if cache is not None:
        distinct = distinct.join(cache.select("text_hash"), "text_hash", "left_anti")
    return distinct.select(
        "text_hash",
        F.lit(INSTRUCTIONS).alias("system"),
        user_prompt(F.col("text")).alias("prompt"),
        F.lit(MAX_OUTPUT_TOKENS).alias("max_tokens"),
    )


def batch_provider(complete: Callable[[pd.DataFrame], pd.DataFrame]) -> Provider:
    """A provider from a function over pandas batches (one model client per worker).

    A batch that raises is asked again text by text, so that only the texts at fault fail.
    """

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        absent = {name: None for name in RESPONSE.fieldNames() if name not in rows.columns}
        return rows.assign(**absent)[RESPONSE.fieldNames()]

    def answers(batch: pd.DataFrame) -> pd.DataFrame:
        return whole(complete(batch))

    def fault(row: pd.DataFrame, error: Exception) -> pd.DataFrame:
        return whole(row[["text_hash", "attempt", "tier"]].assign(input_tokens=0, output_tokens=0, error=str(error)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                yield answers(batch)
                continue
            except Exception as error:
                if len(batch) == 1:
                    yield fault(batch, error)
                    continue
            for place in range(len(batch)):
                row = batch.iloc[place : place + 1]
                try:
                    yield answers(row)
                except Exception as error:
                    yield fault(row, error)

    return lambda requests: requests.mapInPandas(run, RESPONSE)


def rule_extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the record that the extraction rules read off each posting text.

    The first line is the title and the second the company; the place is either the
    third line or what follows `` - `` in the second, without its bracketed remark. The
    rules write no summary.

    The first step passes over the whole text, once per kind of finding; the second only
    looks at what was found.
    """
    body = F.col(text)
    found = df.withColumn("_low", F.lower(body)).withColumns(
        {
            "_head": F.split(F.substring_index(body, "\n", 3), "\n"),
            "_remote": rules.found_words(F.col("_low"), rules.REMOTE_PATTERN),
            "_level": rules.found_words(F.col("_low"), rules.TEXT_LEVEL),
            "_years": F.regexp_extract("_low", rules.YEARS_BEFORE, 1),
            "_salary": F.regexp_extract(body, rules.SALARY_PATTERN, 0),
            "_phrases": rules.visa_phrases(body, F.col("_low")),
            "_stack": rules.stack_of(body),
        }
    )
    line = lambda i: F.coalesce(F.try_element_at("_head", F.lit(i)), F.lit(""))
    has_place = F.contains(line(2), F.lit(" - "))
    place = F.when(has_place, F.regexp_extract(line(2), r" - (.*)$", 1)).otherwise(line(3))
    place = F.nullif(F.trim(F.regexp_replace(place, r"\([^)]*\)", "")), F.lit(""))
    return found.withColumn("_place", place).select(
        *df.columns,
        line(1).alias("title"),
        F.when(has_place, F.regexp_extract(line(2), r"^(.*?) - ", 1)).otherwise(line(2)).alias("company"),
        F.col("_place").alias("location"),
        rules.country_of(F.col("_place")).alias("country"),
        rules.value_of_first(F.col("_remote"), rules.REMOTE_TERMS, F.lit("unknown")).alias("remote"),
        rules.seniority_of(
            rules.found_words(F.lower(line(1)), rules.TITLE_LEVEL), F.col("_level"), F.col("_years")
        ).alias("seniority"),
        F.col("_stack").alias("stack"),
        rules.salary_of(F.col("_salary")).alias("salary"),
        rules.visa_of_phrases(F.col("_phrases")).alias("visa_sponsorship"),
        F.col("_phrases").alias("visa_signals"),
        F.lit(None).cast("string").alias("description_summary"),
    )


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(text) / 4).cast("bigint")


def rule_provider(model: str = "rules") -> Provider:
    """The keyless provider: answers with what the rules find, entirely in the JVM."""

    def run(requests: DataFrame) -> DataFrame:
        asked = ["text_hash", "attempt", "tier", "text"]
        ruled = rule_extract(requests.select(*asked))
        record = F.struct(*[c for c in ruled.columns if c not in asked])
        answered = ruled.withColumn("output", F.to_json(record, {"ignoreNullFields": "false"}))
        return answered.select(
            "text_hash", "attempt", "tier", F.lit(model).alias("model"), "output",
            token_estimate(F.col("text")).alias("input_tokens"),
            token_estimate(F.col("output")).alias("output_tokens"),
        )

    return run


def attempt_tiers(fast_retries: int = 1) -> list[str]:
    return ["fast"] * (1 + fast_retries) + ["strong"]


def extract_cascade(requests: DataFrame, provider: Provider, fast_retries: int = 1) -> DataFrame:
    """Every response the cascade bought, validated: RESPONSE columns, ``errors``, ``record``.

    Each attempt runs over only the texts that still fail. Its checked responses are
    written to the shared folder before anything looks at them, so a call is made once.
    A text the provider does not answer counts as a failed attempt (``unanswered``) and is
    asked again; one whose call failed with an ``error`` is not.
    ``requests`` needs ``text_hash`` and ``text``, one row per text.
    """
    pending = requests.select("text_hash", "text")
    bought: DataFrame | None = None
    for attempt, tier in enumerate(attempt_tiers(fast_retries), start=1):
        asked = pending.withColumn("attempt", F.lit(attempt)).withColumn("tier", F.lit(tier))
        responses = provider(asked)
        if "error" not in responses.columns:
            responses = responses.withColumn("error", F.lit(None).cast("string"))
        answered = validate_records(json_from_output(responses.select(*RESPONSE.fieldNames())))
        checked = asked.select("text_hash", "attempt", "tier").join(
            answered.drop("parsed", "json_text", "attempt", "tier"), "text_hash", "left"
        )
        checked = materialize(checked.withColumns(
            {
                "errors": F.when(F.col("error").isNotNull(), F.array(F.lit("call")))
                .otherwise(F.coalesce("errors", F.array(F.lit("unanswered")))),
                "input_tokens": F.coalesce("input_tokens", F.lit(0)),
                "output_tokens": F.coalesce("output_tokens", F.lit(0)),
            }
        ).select(*RESPONSE.fieldNames(), "errors", "record"), f"attempt-{attempt}")
        bought = checked if bought is None else bought.unionByName(checked)
        failed = checked.filter((F.size("errors") > 0) & F.col("error").isNull()).select("text_hash")
        if failed.isEmpty():
            break
        pending = pending.join(failed, "text_hash", "left_semi")
    return bought


def first_valid_attempt(responses: DataFrame) -> DataFrame:
    """Per text the first valid attempt, or why there is none: the ``error`` of a call, else
    ``extraction failed`` with the findings of the last attempt.

    Expects validated responses; returns ``text_hash``, ``attempt`` (null on failure),
    ``attempts`` (calls made up to it), ``record`` and ``error``. One pass, one exchange.
    """
    fault = F.col("error") if "error" in responses.columns else F.lit(None).cast("string")
    rows = responses.select("text_hash", "attempt", "record", "errors", fault.alias("fault"))
    won = F.when(F.size("errors") == 0, F.col("attempt"))
    per_text = rows.groupBy("text_hash").agg(
        F.min(won).alias("attempt"),
        F.max("attempt").alias("last_attempt"),
        F.min_by("record", won).alias("record"),
        F.max_by("errors", "attempt").alias("findings"),
        F.max_by("fault", F.when(F.col("fault").isNotNull(), F.col("attempt"))).alias("fault"),
    )
    why = F.coalesce("fault", F.concat(F.lit("extraction failed: "), F.array_join("findings", ",")))
    return per_text.select(
        "text_hash",
        "attempt",
        F.coalesce("attempt", "last_attempt").alias("attempts"),
        "record",
        F.when(F.col("attempt").isNull(), why).alias("error"),
    )


def cache_lookup(postings: DataFrame, cache: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Postings the cache answers and postings it does not, by ``text_hash``."""
    if cache is None:
        return postings.limit(0), postings
    keys = cache.select("text_hash")
    return postings.join(keys, "text_hash", "left_semi"), postings.join(keys, "text_hash", "left_anti")


#: Hex characters of ``text_hash`` that name a cache partition: 256 folders.
CACHE_PREFIX = 2


def cache_store_at(path: str, fresh: DataFrame, prefix: int = CACHE_PREFIX) -> DataFrame:
    """Writes ``fresh`` into the cache folder ``path``, partitioned by the first ``prefix``
    characters of ``text_hash``, and returns the cache read back.

    Only the partitions that ``fresh`` touches are rewritten (dynamic partition overwrite): their
    stored rows without fresh keys, and the fresh rows. The merge is written to the shared folder
    first, so the overwrite never reads what it replaces, and a lost executor only repeats work.
    The touched prefixes (at most ``16 ** prefix``) are gathered to prune the read of the store.
    Keys are unique on both sides; columns missing on one side are null.
    """
    spark = fresh.sparkSession
    fresh = fresh.withColumn("prefix", F.substring("text_hash", 1, prefix))
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        touched = sorted(r["prefix"] for r in fresh.select("prefix").distinct().collect())
        stored = spark.read.parquet(path).where(F.col("prefix").isin(touched))
        kept = stored.join(fresh.select("text_hash"), "text_hash", "left_anti")
        fresh = materialize(kept.unionByName(fresh, allowMissingColumns=True), "cache-merge")
    # rows of one prefix go to one writer (hashes spread evenly over prefixes), not every task to every folder
    fresh = fresh.repartition("prefix")
    fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    return spark.read.parquet(path)


def cache_store(cache: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The cache after ``fresh`` overwrote its keys; keys are unique on both sides."""
    if cache is None:
        return fresh
    kept = cache.join(fresh.select("text_hash"), "text_hash", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)
