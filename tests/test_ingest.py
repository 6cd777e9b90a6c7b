import pandas as pd
from pyspark.sql import functions as F

from vocara.operators.dedup import DenseVectors
from vocara.operators.extraction import batch_provider, rule_provider
from vocara.functions.vectors import HASHED_DIM
from vocara.plans.ingest import batch_embedder, embed_hashed, ingest
from vocara.streaming import ingest as streaming

PAGES = {
    "https://board/1": "<h1>Lead Cartographer</h1><p>Terra Maps - Cork, Ireland</p><p>Spark, a relocation bonus</p>",
    "https://board/2": "<h1>Beekeeper</h1><p>Honig AG - Kiel, Germany</p><p>React</p>",
    "https://board/3": "<h1>Broken</h1>",
}
ITEMS = [(0, "a", "https://board/1"), (1, "a", "https://board/bad"), (2, "b", "https://board/1"), (3, "b", "https://board/2")]


def tables(spark, items):
    return (
        spark.createDataFrame(items, "seq bigint, source string, url string"),
        spark.createDataFrame(list(PAGES.items()), "url string, html string"),
    )


def by_seq(outcomes):
    return {r.seq: (r.outcome, r.error) for r in outcomes.collect()}


def test_duplicates_and_failures_stay_apart(spark):
    done = ingest(*tables(spark, ITEMS), rule_provider())
    assert by_seq(done.outcomes) == {
        0: ("indexed", None), 1: ("error", "fetch failed: no page for https://board/bad"),
        2: ("duplicate", None), 3: ("indexed", None),
    }
    assert done.index.count() == 2 and done.calls.count() == 2 and done.cache.count() == 2
    maps = done.jobs.filter("company = 'Terra Maps'").first()
    assert (maps.url, maps.source, maps.visa_sponsorship, maps.country) == ("https://board/1", "a", "yes", "IE")
    # A second run against what is stored finds nothing new and asks nothing.
    items, pages = tables(spark, [(10, "c", "https://board/2")])
    stored = done.entries.select("seq", *[c for c in done.entries.columns if c != "seq"])
    again = ingest(items, pages, rule_provider(), cache=done.cache, index=stored)
    assert by_seq(again.outcomes) == {10: ("duplicate", None)} and again.calls.count() == 0


def test_extraction_errors_and_a_dense_embedder(spark):
    def complete(batch: pd.DataFrame) -> pd.DataFrame:
        good = '{"title": "%s", "company": "C"}'
        answers = ["no" if t.startswith("Broken") else good % t.split("\n")[0] for t in batch["text"]]
        return batch.assign(model="m", output=answers, input_tokens=10, output_tokens=5)

    items = [(0, "a", "https://board/1"), (1, "a", "https://board/3"), (2, "b", "https://board/2")]
    done = ingest(*tables(spark, items), batch_provider(complete), embedder=embed_hashed, finder=DenseVectors(0.97))
    assert by_seq(done.outcomes) == {
        0: ("indexed", None), 1: ("error", "extract failed: extraction failed: json"), 2: ("indexed", None),
    }
    assert done.calls.count() == 5 and done.index.select(F.size("vector")).first()[0] == HASHED_DIM


def test_what_the_embedder_leaves_out_is_an_error_of_that_item(spark):
    def embed(texts: list[str]) -> list[list[float]]:
        if any("Beekeeper" in t for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t)), 1.0] if "Broken" not in t else [1.0] for t in texts]

    items = [(i, "a", url) for i, url in enumerate(PAGES)] + [(9, "b", "https://board/2")]
    done = ingest(*tables(spark, items), rule_provider(), embedder=batch_embedder(embed, 2), finder=DenseVectors(0.97))
    assert by_seq(done.outcomes) == {
        0: ("indexed", None), 1: ("error", "index failed: refused"),
        2: ("error", "index failed: expected a vector of width 2, got 1"), 9: ("error", "index failed: refused"),
    }
    assert done.embedded.count() == 3


def test_stream_of_dense_vectors_and_any_page_id(spark, tmp_path):
    schema, root = "page_id bigint, source string, url string, html string", str(tmp_path / "store")
    run = streaming.ingest_batch(root, rule_provider(), embed_hashed, DenseVectors(0.97))
    html, far = list(PAGES.values()), 1 << 45
    # The same page id in every batch, and one beyond 2^40.
    run(spark.createDataFrame([(7, "a", "https://x/1", html[0]), (far, "a", "https://x/2", html[1])], schema), 0)
    run(spark.createDataFrame([(7, "b", "https://x/3", html[0]), (far + 1, "b", "https://x/4", html[0])], schema), 1)
    rows = streaming.stream_outcomes(spark, root).collect()
    assert {r.url[-1]: (r.seq, r.outcome) for r in rows} == {
        "1": (7, "indexed"), "2": (far, "indexed"), "3": (7, "duplicate"), "4": (far + 1, "duplicate"),
    }
    stored = streaming.stream_index(spark, root).collect()
    assert {r.seq for r in stored} == {7, far} and all(len(r.vector) == 256 and r.words is None for r in stored)


def test_stream_continues_and_replays_change_nothing(spark, tmp_path):
    arriving, root, progress = (str(tmp_path / n) for n in ("arriving", "store", "progress"))
    schema = "page_id bigint, source string, url string, html string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(arriving)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving)
        streaming.start_ingest(stream, root, progress, rule_provider()).awaitTermination()
        return {(r.url, r.batch_id): r.outcome for r in streaming.stream_outcomes(spark, root).collect()}

    html = list(PAGES.values())
    arrive((1, "a", "https://x/1", html[0]), (2, "a", "https://x/2", None))
    first = run()
    assert first == {("https://x/1", 0): "indexed", ("https://x/2", 0): "error"}
    arrive((3, "b", "https://x/3", html[0]), (4, "b", "https://x/4", html[1]))
    second = run()
    assert second == first | {("https://x/3", 1): "duplicate", ("https://x/4", 1): "indexed"}
    assert run() == second
    # The same micro-batch once more, as after a lost driver.
    replay = spark.createDataFrame([(3, "b", "https://x/3", html[0]), (4, "b", "https://x/4", html[1])], schema)
    streaming.ingest_batch(root, rule_provider())(replay, 1)
    assert {(r.url, r.batch_id): r.outcome for r in streaming.stream_outcomes(spark, root).collect()} == second
    assert streaming.stream_index(spark, root).count() == 2
    totals = streaming.stream_runs(spark, root).orderBy("batch_id").collect()
    assert [(r.indexed, r.duplicates, r.errors) for r in totals] == [(1, 0, 1), (1, 1, 0)]
