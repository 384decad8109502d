"""Mixing sources to target weights by hierarchical budgeting.

Rows belong to the leaves of a tree of columns (domain, language, source).  A token budget goes
down the tree: at every node it is split among the children by their weights; a child that cannot
use its part, because its leaves hold too few tokens even when repeated max_epochs times, gets what
it can use and its siblings share the rest by weight.  Only what all children of a node cannot use
was never given to the node, since a node's own limit is the sum of its children's: shortages are
settled among siblings before ancestors.

Each leaf then takes whole epochs while its budget allows, and of the last one a prefix: rows are
ordered by a hash of seed, epoch and id, and taken while their tokens fit.  The prefix is found from
token sums over 4096 hash buckets of a leaf and then over the keys of the one bucket in which the
budget ends, so that no task orders a whole leaf.

All sums are integers; rounding leaves less than one token per child unspent, and a prefix stops
before the row that would exceed the budget.

Defined cases: null levels are children of their own, written `(null)`; null texts hold no tokens
(such rows go with their key, but a leaf without any token has no budget, and its rows are dropped at
every percentage, as in the query's SQL); rows with equal ids stand or fall together within a leaf and epoch;
an empty table gives an empty result.  Input columns are kept, but for one
named epoch, which is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillway.llm.common import materialize

BUCKETS = 4096
KEY_BITS = 60
#: Leaves up to which the leaf table is broadcast; larger ones are joined by a shuffle.
BROADCAST_LEAVES = 50_000


def tokens_of(text: str) -> Column:
    """Estimated tokens of a text: a quarter of its UTF-8 bytes, rounded up."""
    return F.coalesce(F.floor((F.octet_length(text) + 3) / 4), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for k, w in weights.items():
        out = F.when(F.col(level) == k, F.lit(w)).otherwise(out)
    return out.cast("long")


def budgets(leaves: DataFrame, levels: list[str], weights: Mapping[str, Mapping[str, int]], total: Column) -> DataFrame:
    """leaves (levels, cap) with budget bigint; weights by level and value, 1 where not given."""
    above: DataFrame | None = None
    for depth in range(1, len(levels) + 1):
        here, parents, level = levels[:depth], levels[: depth - 1], levels[depth - 1]
        nodes = leaves.groupBy(here).agg(F.sum("cap").alias("cap"))
        if above is None:
            nodes = nodes.withColumn("given", F.sum("cap").over(Window.partitionBy(F.lit(0)))).withColumn("given", F.least("given", total))
        else:
            nodes = nodes.join(above.withColumnRenamed("budget", "given"), parents)
        part = parents or [F.lit(0)]
        order = Window.partitionBy(part).orderBy((F.col("cap") / F.nullif(F.col("w"), F.lit(0))).asc_nulls_last(), F.col(level))
        # in order of capacity by weight, those whose part of what is left exceeds their capacity are full
        nodes = (
            nodes.withColumn("w", _weight(level, weights.get(level, {})))
            .withColumn("used", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("left_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
            .withColumn("full", F.col("cap") * F.col("left_w") <= F.col("w") * (F.col("given") - F.col("used")))
        )
        rest = F.when(~F.col("full"), F.struct("used", "left_w"))
        first = F.min(rest).over(Window.partitionBy(part))  # used grows along the order
        share = F.expr("w * (given - first.used) div nullif(first.left_w, 0)")
        above = nodes.withColumn("first", first).select(*here, F.when(F.col("full"), F.col("cap")).otherwise(F.coalesce(share, F.lit(0))).cast("long").alias("budget"))
    return leaves.join(above, levels)


def _key(id_col: Column, seed: int, epoch: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), id_col.cast("string"))), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_epochs(
    df: DataFrame,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    percent: int,
    max_epochs: int = 1,
    seed: int = 17,
    id_col: str = "doc_id",
    tokens: Column | None = None,
) -> DataFrame:
    """Rows of df that are selected, with epoch int: once for every epoch that takes them.

    levels: the tree, from the root's children to the leaves, as columns of df; percent: the budget
    as a share of the tokens that df holds.
    """
    names = [f"__l{i}" for i in range(len(levels))]
    spec = {n: weights.get(k, {}) for n, k in zip(names, levels)}
    rows = df.withColumns({n: F.coalesce(c.cast("string"), F.lit("(null)")) for n, c in zip(names, levels.values())})
    rows = rows.withColumn("__tokens", tokens if tokens is not None else tokens_of("text"))
    sums = rows.groupBy(names).agg(F.sum("__tokens").alias("tokens"))
    leaves = sums.withColumn("cap", F.col("tokens") * max_epochs)
    held = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    leaves = materialize(leaves.withColumn("total", F.floor(held * percent / 100).cast("long")), "leaves")
    total = F.lit((leaves.select(F.max("total")).first() or [0])[0] or 0)
    plan = budgets(leaves.drop("total"), names, spec, total).filter("tokens > 0").select(*names, F.expr("budget div tokens").alias("full"), F.expr("budget % tokens").alias("rest"))
    plan = materialize(plan, "budgets")
    small = plan.count() <= BROADCAST_LEAVES
    on_leaf = lambda a, b: a.join(F.broadcast(b) if small else b, names)

    key = _key(F.col("__id"), seed, F.col("full")).alias("key")
    slim = rows.select(*names, F.col(id_col).alias("__id"), "__tokens")
    slim = on_leaf(slim, plan.filter("rest > 0")).select(*names, "rest", key, F.col("__tokens").alias("n"))
    bucket = F.shiftright("key", KEY_BITS - BUCKETS.bit_length() + 1)
    along = Window.partitionBy(names).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cut = (
        slim.groupBy(*names, bucket.alias("bucket"))
        .agg(F.sum("n").alias("n"), F.max("rest").alias("rest"))
        .withColumn("end", F.sum("n").over(along))
        .filter("end > rest")
        .groupBy(names)
        .agg(F.min(F.struct("bucket", (F.col("end") - F.col("n")).alias("before"))).alias("at"))
        .select(*names, "at.bucket", "at.before")
    )
    cut = materialize(cut, "cuts")
    by_key = Window.partitionBy(names).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    last = (
        on_leaf(slim, cut)
        .filter(bucket == F.col("bucket"))
        .groupBy(*names, "key")
        .agg(F.sum("n").alias("n"), F.max(F.col("rest") - F.col("before")).alias("room"))
        .withColumn("end", F.sum("n").over(by_key))
        .filter("end > room")
        .groupBy(names)
        .agg(F.min("key").alias("stop"))
    )
    plan = materialize(plan.join(cut, names, "left").join(last, names, "left"), "plan")
    # before the cut's bucket all keys are taken, within it those before the first that is too much;
    # names of df can't clash with these
    full, rest, cut_at, stop = (F.col(f"__{c}") for c in ("full", "rest", "bucket", "stop"))
    chosen = on_leaf(rows, plan.select(*names, *[F.col(c).alias(f"__{c}") for c in ("full", "rest", "bucket", "stop")]))
    chosen = chosen.withColumn("__key", _key(F.col(id_col), seed, full))
    bucket = F.shiftright("__key", KEY_BITS - BUCKETS.bit_length() + 1)
    taken = (rest > 0) & (cut_at.isNull() | (bucket < cut_at) | ((bucket == cut_at) & (stop.isNull() | (F.col("__key") < stop))))
    chosen = chosen.withColumn("__n", full + taken.cast("long")).filter("__n > 0")
    kept = [c for c in df.columns if c != "epoch"]
    if max_epochs == 1:
        return chosen.select(*kept, F.lit(0).alias("epoch"))
    return chosen.select(*kept, F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))).alias("epoch"))
