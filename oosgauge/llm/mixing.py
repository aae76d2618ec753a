"""Mixing sources to target weights by budgets that flow down a tree of levels.

A node's budget is dealt to its children by weight, none above what the child can deliver
(its tokens times ``epochs``); what a child cannot take goes to its siblings by weight, and
only what all of them cannot take reaches the ancestors' other children. A leaf then takes
whole epochs and, of the next one, the prefix of a seeded order that fits its budget.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: names of the tree's columns in all tables of this module
L = ("level_1", "level_2", "level_3")
#: hexadecimal digits of the seeded order that name a slice of a leaf
SLICE_DIGITS = 3
#: rows of a leaf table that may be broadcast; larger ones are joined by shuffle
MOST_SENT = 100_000


@dataclass(frozen=True)
class Mix:
    """``weights``: by level, name -> weight; names that are absent have ``default``. ``budget``: tokens as a share of all."""

    seed: int = 17
    epochs: int = 2
    budget: float = 0.5
    default: float = 1.0
    weights: tuple[dict[str, float], ...] = field(default=({}, {}, {}))


def token_count(text: Column) -> Column:
    """Words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: Column, weights: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, w in weights.items():
        out = F.when(level == name, F.lit(float(w))).otherwise(out)
    return out


def deal(children: DataFrame, by: list[str], me: str) -> DataFrame:
    """Add ``alloc`` to children with ``cap, weight, given`` (their parent's budget): level filling in closed form.

    Ordered by cap / weight the first children are full, and the rest share what is left by
    weight. The first child that this share does not fill sets the level. Without weight a child gets
    nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("cap") / F.col("weight")).otherwise(F.lit(float("inf")))
    before = Window.partitionBy(*by).orderBy("_r", me).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    share = F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = F.when(F.col("_share") > 0, F.greatest(F.col("_left"), F.lit(0.0)) / F.col("_share")).otherwise(F.lit(0.0))
    out = children.withColumn("_r", ratio).withColumns({"_left": left, "_share": share})
    out = out.withColumn("_fits", level).withColumn("_open", (F.col("weight") > 0) & (F.col("_fits") <= F.col("_r")))
    top = F.max(F.when(F.col("_open"), F.col("_fits"))).over(group)  # the first open one's: later ones are lower
    alloc = F.when(F.col("weight") <= 0, 0.0).when(top.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), top * F.col("weight")))
    return out.withColumn("alloc", alloc).drop("_r", "_left", "_share", "_fits", "_open")


def leaf_budgets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Levels, ``tokens``, ``alloc`` of every leaf; all sums and windows are over leaves, not documents."""
    leaves = sizes.withColumn("cap", F.col("tokens").cast("double") * mix.epochs)
    two = leaves.groupBy(L[0], L[1]).agg(F.sum("cap").alias("cap"))
    one = two.groupBy(L[0]).agg(F.sum("cap").alias("cap")).withColumn("_root", F.lit(0))
    w = [lambda i=i: weight_of(F.col(L[i]), mix.weights[i], mix.default) for i in range(3)]
    given = F.sum("cap").over(Window.partitionBy("_root")) / mix.epochs * mix.budget
    one = deal(one.withColumns({"weight": w[0](), "given": given}), ["_root"], L[0])
    two = two.join(one.select(L[0], F.col("alloc").alias("given")), L[0]).withColumn("weight", w[1]())
    two = deal(two, [L[0]], L[1])
    leaves = leaves.join(two.select(L[0], L[1], F.col("alloc").alias("given")), [L[0], L[1]]).withColumn("weight", w[2]())
    return deal(leaves, [L[0], L[1]], L[2]).select(*L, "tokens", "alloc")


def mix_sources(docs: DataFrame, levels: tuple[Column, Column, Column], mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the three levels, ``n_tokens`` and ``copies`` of every row of ``docs``; 0 copies: not taken.

    Null levels are the level ''. Rows without words cost nothing and are never taken. Ids
    order a leaf after the seeded digest, so ties are rows that repeat an id; they are taken
    or left together. An empty table gives an empty one.
    """
    from oosgauge.session import stable

    named = [F.coalesce(c.cast("string"), F.lit("")).alias(n) for c, n in zip(levels, L)]
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), *named, token_count(F.col(text_col)).alias("n_tokens"))
    rows = stable(rows)  # the text is read once
    budgets = stable(leaf_budgets(rows.groupBy(*L).agg(F.sum("n_tokens").alias("tokens")), mix))
    small = F.broadcast if budgets.count() <= MOST_SENT else (lambda df: df)
    return taken(rows, budgets, mix, small)


def taken(rows: DataFrame, budgets: DataFrame, mix: Mix, small: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Copies by row; ``small`` marks tables of a row per leaf that may be sent to every task."""
    whole = F.when(F.col("tokens") > 0, F.floor(F.col("alloc") / F.col("tokens"))).otherwise(0)
    plan = budgets.select(*L, F.least(whole, F.lit(mix.epochs)).cast("long").alias("_whole"), "tokens", "alloc")
    plan = plan.withColumn("_rest", F.floor(F.round(F.col("alloc") - F.col("_whole") * F.col("tokens"), 3))).drop("tokens", "alloc")
    order = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("_whole").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = rows.filter("n_tokens > 0").join(small(plan), list(L)).withColumn("_k", order)
    keyed = keyed.withColumn("_slice", F.substring("_k", 1, SLICE_DIGITS))
    sums = keyed.groupBy(*L, "_slice").agg(F.sum("n_tokens").alias("_sum"), F.first("_rest").alias("_rest"))
    run = Window.partitionBy(*L).orderBy("_slice")
    cuts = sums.withColumn("_upto", F.sum("_sum").over(run)).filter(F.col("_upto") > F.col("_rest"))
    cut = cuts.groupBy(*L).agg(F.min(F.struct("_slice", (F.col("_upto") - F.col("_sum")).alias("before"))).alias("_cut"))
    placed = keyed.join(small(cut), list(L), "left")
    inside = F.col("_cut.before").isNull() | (F.col("_slice") < F.col("_cut._slice"))
    at_cut = placed.filter(F.col("_slice") == F.col("_cut._slice"))
    # ties share a frame: rows of one id go together
    upto = F.sum("n_tokens").over(Window.partitionBy(*L).orderBy("_k").rangeBetween(Window.unboundedPreceding, 0))
    at_cut = at_cut.withColumn("copies", F.col("_whole") + (F.col("_cut.before") + upto <= F.col("_rest")).cast("long"))
    others = placed.filter(F.col("_cut._slice").isNull() | (F.col("_slice") != F.col("_cut._slice")))
    others = others.withColumn("copies", F.col("_whole") + inside.cast("long"))
    cols = ["doc_id", *L, "n_tokens", "copies"]
    none = rows.filter("n_tokens = 0").withColumn("copies", F.lit(0).cast("long"))
    return others.select(*cols).unionByName(at_cut.select(*cols)).unionByName(none.select(*cols))
