"""Mixing sources to target weights in a tree of domain, language and source.

Budgets flow down the tree. Among the children of a node a budget is shared by
weight; a child that cannot use its share (a leaf can be read MAX_EPOCHS times)
takes what it can, and its siblings share the rest by weight. What all leaves
below a node can take bounds the node's own share, so a shortage is first met by
siblings and reaches the ancestors' other children only when they are all full.
With children in order of capacity / weight this is a closed form over running
sums: no iteration.

A leaf with budget b and t tokens uses all its documents b // t times; of the next
epoch, a seeded order of its own, it takes the prefix of whole documents that fits
in the rest. The order is cut into 4096 ranges by the first hex digits of a hash;
sums by range find the range of the cut, and only that range's documents are
sorted. Rows of equal place in the order (repeated rows) go together.

Defined results: tokens are words (runs without ASCII white space); documents
without words are never chosen; a null language or source is a node like any
other, with the weight of unnamed ones; repeated rows count each; an empty table
gives an empty mix. Columns named domain, n_tokens or epochs are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pingtrace.llm.inputs import table
from pingtrace.sources.staging import staged

BROADCAST_ROWS = 200_000
TREE = ("domain", "lang", "source")
DIGITS = 3


@dataclass(frozen=True)
class Targets:
    """Weights by node name (1 for others), the budget as a share of all tokens, and the order's seed."""

    domain: dict = field(default_factory=lambda: {"web": 5, "books": 3, "code": 1, "reference": 2})
    lang: dict = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    source: dict = field(default_factory=dict)
    budget_percent: int = 80
    max_epochs: int = 4
    seed: int = 7

    def weight(self, level: str) -> Column:
        named = getattr(self, level)
        chosen = F.lit(1)
        for name, weight in named.items():
            chosen = F.when(F.col(level) == name, F.lit(weight)).otherwise(chosen)
        return chosen.cast("bigint")


def domain_of_source() -> Column:
    """The domain of the numbered sources: five sources each, in this order."""
    number = F.try_to_number(F.regexp_extract("source", "^src([0-9]{1,6})$", 1), F.lit("999999"))
    names = F.array(*[F.lit(d) for d in ("web", "books", "code", "reference")])
    return F.coalesce(F.get(names, F.floor(number / 5).cast("int")), F.lit("other"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _matched(frame: DataFrame, other: DataFrame, columns: tuple[str, ...], how: str = "inner") -> DataFrame:
    """Join on `columns`, null being equal to null; `other` adds its remaining columns."""
    named = other.select(*[F.col(c).alias(f"_mix_{c}") if c in columns else F.col(c) for c in other.columns])
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(c).eqNullSafe(F.col(f"_mix_{c}"))
    return frame.join(_small(named), condition, how).drop(*[f"_mix_{c}" for c in columns])


def _shared(nodes: DataFrame, parent: tuple[str, ...], level: str, targets: Targets) -> DataFrame:
    """`nodes` (parent's columns, level, capacity, budget of the parent) with their own `budget`."""
    nodes = nodes.withColumn("weight", targets.weight(level)).where("weight > 0 and capacity > 0")
    nodes = nodes.withColumn("ratio", F.col("capacity") / F.col("weight"))
    order = Window.partitionBy(*parent).orderBy("ratio", F.col(level).asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    nodes = nodes.withColumn(
        "height",
        (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    nodes = nodes.withColumn("full", F.col("ratio") <= F.col("height"))
    top = F.max(F.when(~F.col("full"), F.col("height"))).over(whole)
    share = F.when(F.col("full"), F.col("capacity")).otherwise(F.floor(top * F.col("weight")))
    return nodes.withColumn("budget", F.greatest(share, F.lit(0)).cast("bigint")).select(*parent, level, "budget")


def leaf_budgets(leaves: DataFrame, targets: Targets) -> DataFrame:
    """domain, lang, source, tokens and budget of every leaf (columns TREE and tokens) that gets any."""
    leaves = leaves.where("tokens > 0").withColumn("capacity", F.col("tokens") * targets.max_epochs)
    total = leaves.agg(F.floor(F.sum("tokens") * targets.budget_percent / 100).cast("bigint").alias("budget"))
    above, parent = total, ()
    for level in TREE:
        here = (*parent, level)
        nodes = leaves.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
        # The root is one row.
        below = _matched(nodes, above, parent) if parent else nodes.crossJoin(F.broadcast(above))
        above = staged(_shared(below, parent, level, targets), f"mix-{level}")
        parent = here
    return _matched(leaves, above, TREE).select(*TREE, "tokens", "budget").where("budget > 0")


def _place(targets: Targets, epoch: Column, key: str) -> Column:
    name = F.concat_ws("|", F.lit(str(targets.seed)), epoch.cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.md5(name.cast("binary"))


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def mix(docs: DataFrame, targets: Targets | None = None, domain: Column | None = None, key: str = "doc_id") -> DataFrame:
    """`docs` that are in the mix, with domain, n_tokens and epochs (how many times it is used)."""
    targets = targets or Targets()
    marked = docs.withColumn("domain", domain_of_source() if domain is None else domain)
    marked = marked.withColumn("n_tokens", n_words(F.col("text")))
    sizes = staged(
        marked.select(*TREE, key, "n_tokens", F.xxhash64("text").alias("_text")).where("n_tokens > 0"), "mix-sizes"
    )
    leaves = sizes.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"))
    budgets = leaf_budgets(staged(leaves, "mix-leaves"), targets)
    budgets = budgets.withColumn("whole_epochs", F.floor(F.col("budget") / F.col("tokens")))
    budgets = budgets.withColumn("rest", F.expr("budget % tokens"))
    budgets = staged(budgets.select(*TREE, "whole_epochs", "rest"), "mix-budgets")

    placed = _matched(sizes, budgets, TREE).withColumn("_place", _place(targets, F.col("whole_epochs"), key))
    placed = placed.withColumn("_range", F.substring("_place", 1, DIGITS))
    by_range = placed.groupBy(*TREE, "_range", "rest").agg(F.sum("n_tokens").alias("held"))
    up_to = Window.partitionBy(*TREE).orderBy("_range")
    by_range = by_range.withColumn("reached", F.sum("held").over(up_to))
    cut = (
        by_range.where("reached > rest")
        .groupBy(*TREE, "rest")
        .agg(F.min(F.struct("_range", (F.col("reached") - F.col("held")).alias("below"))).alias("c"))
        .select(*TREE, F.col("c._range").alias("cut_range"), (F.col("rest") - F.col("c.below")).alias("left"))
    )
    cut = staged(cut, "mix-cuts")
    inside = _matched(placed.drop("rest"), cut, TREE).where("_range = cut_range")
    spot = F.struct("_place", "n_tokens", "_text")
    inside = inside.groupBy(*TREE, "left", spot.alias("spot")).agg(F.sum("n_tokens").alias("held"))
    reached = F.sum("held").over(Window.partitionBy(*TREE).orderBy("spot"))
    last = inside.withColumn("reached", reached).where("reached <= left").groupBy(*TREE).agg(F.max("spot").alias("last"))

    ends = _matched(budgets.drop("rest"), cut.select(*TREE, "cut_range"), TREE, "left")
    ends = staged(_matched(ends, staged(last, "mix-last"), TREE, "left"), "mix-ends")

    # Names that the documents' own columns are unlikely to have.
    ends = ends.select(
        *TREE, F.col("whole_epochs").alias("_mix_epochs"), F.col("cut_range").alias("_mix_range"), F.col("last").alias("_mix_last")
    )
    chosen = _matched(marked.where(F.col("n_tokens") > 0), ends, TREE)
    place = _place(targets, F.col("_mix_epochs"), key)
    mine = F.struct(place.alias("_place"), F.col("n_tokens"), F.xxhash64("text").alias("_text"))
    in_prefix = (F.substring(place, 1, DIGITS) < F.col("_mix_range")) | F.coalesce(mine <= F.col("_mix_last"), F.lit(False))
    epochs = F.col("_mix_epochs") + F.coalesce(in_prefix, F.lit(False)).cast("int")
    chosen = chosen.withColumn("epochs", epochs.cast("bigint")).where("epochs > 0")
    return chosen.drop("_mix_epochs", "_mix_range", "_mix_last")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mix(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "domain", "lang", "source", "n_tokens", "epochs")


def _sql_weight(level: str, named: dict) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in named.items())
    return f"CASE {level} {cases} ELSE 1 END" if cases else "1"


def _sql_level(name: str, above: str, parent: tuple[str, ...], level: str, named: dict) -> str:
    keys = ", ".join((*parent, level))
    over = f"PARTITION BY {', '.join(parent)}" if parent else ""
    match = " AND ".join(f"n.{c} IS NOT DISTINCT FROM a.{c}" for c in parent) or "true"
    return f"""
{name}_in AS (
  SELECT n.*, a.budget, {_sql_weight("n." + level, named)} AS weight,
         n.capacity / cast({_sql_weight("n." + level, named)} AS double) AS ratio
  FROM (SELECT {keys}, cast(sum(capacity) AS bigint) AS capacity FROM leaves GROUP BY {keys}) n JOIN {above} a ON {match}),
{name}_level AS (
  SELECT *, cast(budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double)
       / cast(sum(weight) OVER ({over}) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS double) AS height
  FROM {name}_in WINDOW o AS ({over} ORDER BY ratio, {level} NULLS FIRST)),
{name} AS (
  SELECT {keys}, cast(greatest(CASE WHEN ratio <= height THEN capacity
       ELSE floor(max(CASE WHEN ratio > height THEN height END) OVER ({over}) * weight) END, 0) AS bigint) AS budget
  FROM {name}_level)"""


def mixing_sql(targets: Targets) -> str:
    leaf = "n.domain IS NOT DISTINCT FROM b.domain AND n.lang IS NOT DISTINCT FROM b.lang AND n.source IS NOT DISTINCT FROM b.source"
    return f"""
WITH sized AS (
  SELECT doc_id, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens,
         CASE cast(try_cast(regexp_extract(source, '^src([0-9]{{1,6}})$', 1) AS integer) // 5 AS integer)
           WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'code' WHEN 3 THEN 'reference' ELSE 'other' END AS domain
  FROM documents),
leaves AS (
  SELECT domain, lang, source, cast(sum(n_tokens) AS bigint) AS tokens, cast(sum(n_tokens) AS bigint) * {targets.max_epochs} AS capacity
  FROM sized GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT cast(floor(sum(tokens) * {targets.budget_percent} / 100) AS bigint) AS budget FROM leaves),
{_sql_level("domains", "total", (), "domain", targets.domain)},
{_sql_level("langs", "domains", ("domain",), "lang", targets.lang)},
{_sql_level("sources", "langs", ("domain", "lang"), "source", targets.source)},
budgets AS (
  SELECT b.*, n.tokens, b.budget // n.tokens AS whole_epochs, b.budget % n.tokens AS rest FROM sources b JOIN leaves n ON {leaf}),
placed AS (
  SELECT n.*, b.whole_epochs, b.rest,
         sum(n.n_tokens) OVER (PARTITION BY n.domain, n.lang, n.source
           ORDER BY md5(concat('{targets.seed}|', b.whole_epochs, '|', n.doc_id)), n.n_tokens) AS reached
  FROM sized n JOIN budgets b ON {leaf} WHERE n.n_tokens > 0)
SELECT doc_id, domain, lang, source, cast(n_tokens AS bigint) AS n_tokens,
       cast(whole_epochs + CASE WHEN reached <= rest THEN 1 ELSE 0 END AS bigint) AS epochs
FROM placed WHERE whole_epochs > 0 OR reached <= rest"""


ORACLE_SQL = mixing_sql(Targets())
