"""Mixing sources to target weights by hierarchical budgeting.

The sources form a tree domain -> language -> source. A budget of tokens enters at the root
and flows down by weight. A child that cannot use its share, because all its leaves together
hold less, keeps what it can use; its shortage goes to its siblings by weight, and only what
all siblings together cannot use stays short one level up, where it was already offered to the
ancestors' siblings in the same way. Shares are integers: the shares of a level come from the
closed form of water filling, sorted by capacity over weight, with running sums.

Each leaf then reads seeded epochs: in epoch e its documents stand in the order of
md5(seed:e:doc_id), and the leaf takes the prefix of this sequence that its tokens pay for. A
document is taken when it ends within the target, so a leaf misses its target by less than one
document per epoch boundary.

Only DataFrame functions are used. The order inside a leaf is cut into slices of the digest, so
running sums cross slices by totals and a leaf with a third of all rows is spread over tasks.

Cases: null or unlisted languages and sources are leaves of their own, with the default weight;
a null or empty text has no tokens and is never taken (it would be free in any order); rows
without a doc_id are left out; repeated rows of one doc_id are taken once or not at all per
epoch, as one document, the longest row; other columns are ignored; an empty table, or weights
of zero, give an empty result. Tokens are maximal runs without white space.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vocara.llm.common import materialize

#: Digest values a slice covers: 4 hex digits are cut off, 2^16 slices of a leaf at most.
SLICE_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Weights are integers. ``share`` is the budget in thousandths of all tokens."""

    domains: dict[str, int] = field(default_factory=lambda: {"hub": 40, "web": 60})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    other: int = 10
    hub: str = "src0"
    share: int = 500
    epochs: int = 2
    seed: int = 7


def _weight(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for key, value in sorted(weights.items()):
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def _fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Shares ``budget`` among the children of each parent: columns weight, capacity -> given."""
    order = Window.partitionBy(*parent).orderBy((F.col("capacity") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*parent)
    big = lambda c: F.col(c).cast("decimal(38,0)")
    whole = children.where("weight > 0").withColumn("place", F.row_number().over(order))
    whole = whole.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
    whole = whole.withColumn("parts", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    whole = whole.withColumn("short", big("capacity") * big("parts") <= big("weight") * big("left"))
    free = F.min(F.when(~F.col("short"), F.struct("place", "left", "parts"))).over(all_of)
    whole = whole.withColumn("free", free)
    given = F.when(F.col("free").isNull() | (F.col("place") < F.col("free.place")), F.col("capacity")).otherwise(
        F.expr("cast(weight as decimal(19,0)) * cast(free.left as decimal(19,0)) div cast(free.parts as decimal(19,0))")
    )
    return whole.withColumn("given", given.cast("long")).drop("place", "left", "parts", "short", "free")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """``domain, lang, source, tokens`` -> the same with ``target``, the tokens the leaf is to give.
    One row per leaf, so windows here hold leaves, never documents."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    top = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    total = top.withColumn("budget", F.expr(f"sum(tokens) over (partition by 1) * {mix.share} div 1000")).withColumn("root", F.lit(1))
    top = _fill(total.withColumn("weight", _weight(F.col("domain"), mix.domains, mix.other)), ["root"], "domain")
    middle = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    middle = middle.join(top.select("domain", F.col("given").alias("budget")), "domain")
    middle = _fill(middle.withColumn("weight", _weight(F.col("lang"), mix.languages, mix.other)), ["domain"], "lang")
    low = leaves.join(middle.select("domain", "lang", F.col("given").alias("budget")), ["domain", "lang"])
    low = _fill(low.withColumn("weight", F.lit(1).cast("long")), ["domain", "lang"], "source")
    return low.select("domain", "lang", "source", "tokens", F.col("given").alias("target"))


def mix_sources(documents: DataFrame, mix: Mix | None = None) -> DataFrame:
    """One row per document and epoch in which it is taken: ``doc_id, domain, lang, source, epoch``
    (from 0), ``n_tokens``, ``starts_at`` (tokens of the leaf before it)."""
    mix = mix or Mix()
    lang, source = F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))
    rows = documents.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.when(source == mix.hub, "hub").otherwise("web").alias("domain"),
        lang.cast("string").alias("lang"),
        source.cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    rows = rows.where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("n_tokens", "domain", "lang", "source")).alias("row")).select("doc_id", "row.*")
    rows = materialize(rows, "tokens")
    leaf = ["domain", "lang", "source"]
    leaves = rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("tokens"))
    plan = materialize(budgets(leaves, mix), "plan")
    reads = rows.join(plan, leaf).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(mix.epochs - 1))))
    reads = reads.where(F.col("epoch") * F.col("tokens") < F.col("target"))
    reads = reads.withColumn("at", F.md5(F.concat_ws(":", F.lit(mix.seed), F.col("epoch"), F.col("doc_id")))).withColumn("slice", F.substring("at", 1, SLICE_DIGITS))
    slices = reads.groupBy(*leaf, "epoch", "slice").agg(F.sum("n_tokens").alias("held"))
    ahead = Window.partitionBy(*leaf, "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("held").over(ahead), F.lit(0))).drop("held")
    inside = Window.partitionBy(*leaf, "epoch", "slice").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = reads.withColumn("within", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(materialize(slices, "slices"), [*leaf, "epoch", "slice"])
    placed = placed.withColumn("starts_at", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("within"))
    return placed.where("starts_at + n_tokens <= target").select("doc_id", *leaf, "epoch", "n_tokens", "starts_at")


def oracle(mix: Mix | None = None) -> str:
    """The same rows in SQL: shares level by level, then one running sum per leaf and epoch."""
    mix = mix or Mix()
    case = lambda name, weights: "case " + " ".join(f"when {name} = '{k}' then {v}" for k, v in sorted(weights.items())) + f" else {mix.other} end"

    def level(name: str, parent: str, child: str, source: str) -> str:
        key = f"{parent}, " if parent else ""
        by = f"partition by {parent}" if parent else ""
        return f"""{name}_a as (select *, row_number() over o as place,
  budget - coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0) as left_over,
  sum(weight) over ({by}) - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as parts
 from ({source}) s where weight > 0 window o as ({by} order by capacity / weight, {child})),
{name}_b as (select {key}min(place) as place, min_by(left_over, place) as left_over, min_by(parts, place) as parts
 from {name}_a where not (capacity * parts <= weight * left_over) {"group by " + parent if parent else ""}),
{name} as (select a.* exclude (place, left_over, parts),
  cast(case when b.place is null or a.place < b.place then a.capacity else a.weight::hugeint * b.left_over::hugeint // b.parts end as bigint) as given
 from {name}_a a left join {name}_b b on {" and ".join(f"a.{c.strip()} = b.{c.strip()}" for c in parent.split(",")) if parent else "true"})"""

    top = f"select domain, capacity, {case('domain', mix.domains)} as weight, (select sum(tokens) from leaves) * {mix.share} // 1000 as budget from (select domain, sum(tokens) * {mix.epochs} as capacity from leaves group by 1)"
    middle = f"select m.domain, lang, m.capacity, {case('lang', mix.languages)} as weight, t.given as budget from (select domain, lang, sum(tokens) * {mix.epochs} as capacity from leaves group by 1, 2) m join top t on t.domain = m.domain"
    low = f"select l.domain, l.lang, l.source, l.tokens, l.tokens * {mix.epochs} as capacity, 1 as weight, m.given as budget from leaves l join middle m on m.domain = l.domain and m.lang = l.lang"
    return f"""with r as (select doc_id, case when coalesce(source, '') = '{mix.hub}' then 'hub' else 'web' end as domain, coalesce(lang, '') as lang,
 coalesce(source, '') as source, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> ''))::bigint as n_tokens from documents where doc_id is not null),
d as (select doc_id, domain, lang, source, n_tokens from r where n_tokens > 0
 qualify row_number() over (partition by doc_id order by n_tokens desc, domain desc, lang desc, source desc) = 1),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by 1, 2, 3),
{level("top", "", "domain", top)},
{level("middle", "domain", "lang", middle)},
{level("low", "domain, lang", "source", low)},
reads as (select d.*, e.epoch, l.tokens, l.given as target from d join low l on l.domain = d.domain and l.lang = d.lang and l.source = d.source,
 (select unnest(range({mix.epochs})) as epoch) e),
placed as (select doc_id, domain, lang, source, epoch::int as epoch, n_tokens, target,
 (epoch * tokens + coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by md5(concat_ws(':', '{mix.seed}', epoch, doc_id)), doc_id
  rows between unbounded preceding and 1 preceding), 0))::bigint as starts_at from reads)
select doc_id, domain, lang, source, epoch, n_tokens, starts_at from placed where starts_at + n_tokens <= target"""
