"""Temperature mixing of sources, in DataFrame expressions only.

A source with share p of the tokens gets weight p**a / sum(p**a).  At exponent 1 sources mix as they
are, at 0 evenly; entropy falls and the most-repeated source is repeated less as the exponent rises.
Each round of the search evaluates a grid of exponents in one aggregate over the sources, so the
driver sees a few sums, however many sources there are.  The exponent is the largest that reaches the
target entropy, raised as far as the repetition limit asks for.

Weights become epochs (passes over a source).  Each source's rows are dealt to blocks of about
``BLOCK`` rows; a block is read whole once per full epoch, in a new permutation each time, and for the
last, partial epoch up to its budget of tokens, in permuted order.  Where that order stops is one
number per block, so texts are never shuffled.

Null sources are a source of their own; null and empty texts count as one token; repeated rows are
rows of their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, whole

BLOCK = 1024
GRID = 16
ROUNDS = 5
#: Per-source and per-block tables are broadcast up to so many rows (about 5 MB), and shuffled beyond.
SMALL_ROWS = 50_000


@dataclass(frozen=True)
class Mix:
    """What the mix must meet.

    ``entropy``: target as a share of the greatest entropy; None leaves it to the limit alone.
    ``repeats``: the most epochs that any source may take.
    ``keep_all``: the budget is the least at which every source is read in full; else the corpus size.
    """

    entropy: float | None = 0.98
    repeats: float = 4.0
    keep_all: bool = False


def token_count(text: Column) -> Column:
    """Words without white space; at least 1."""
    return F.greatest(F.regexp_count(text, F.lit("\\S+")), F.lit(1)).cast("long")


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def _search(shares: DataFrame, measure, holds) -> tuple[float, float]:
    """(last, first): on [0, 1], ``holds`` is true up to ``last`` and false from ``first`` on."""
    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * j / GRID for j in range(GRID + 1)]
        got = shares.agg(*[measure(a).alias(f"m{j}") for j, a in enumerate(grid)]).first()
        good = [holds(m) for m in got]
        if good[-1]:
            return grid[-1], grid[-1]
        if not good[0]:
            return grid[0], grid[0]
        j = good.index(False)
        lo, hi = grid[j - 1], grid[j]
    return lo, hi


def exponent(shares: DataFrame, mix: Mix) -> float:
    """The exponent for a table of shares ``p``."""
    top = shares.agg(F.count("*").alias("n"), F.min("p").alias("least"), F.max("p").alias("most")).first()
    if not top["n"]:
        return 1.0

    def entropy(a: float) -> Column:
        w = F.pow("p", F.lit(a))
        return F.log(F.sum(w)) - F.sum(w * F.log(w)) / F.sum(w)

    def repeats(a: float) -> Column:
        if mix.keep_all:  # the largest source is read once
            return F.lit((top["most"] / top["least"]) ** (1 - a)) + F.sum(F.lit(0.0))
        return F.lit(top["least"] ** (a - 1)) / F.sum(F.pow("p", F.lit(a)))

    a = 0.0
    if mix.entropy is not None and top["n"] > 1:
        a = _search(shares, entropy, lambda h: h >= mix.entropy * math.log(top["n"]) - 1e-12)[0]
    limit = _search(shares, repeats, lambda r: r > mix.repeats + 1e-9)[1]
    return max(a, limit)


def source_plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """(key, weight, epochs, blocks) by source."""
    stats = stash(rows.groupBy("key").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")))
    total = stats.agg(F.sum("t")).first()[0] or 1
    shares = stats.withColumn("p", F.col("t") / F.lit(float(total)))
    a = exponent(shares, mix)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    weighted = shares.withColumn("weight", F.pow("p", F.lit(a)) / F.lit(z))
    scale = 1.0
    if mix.keep_all:
        scale = weighted.agg(F.max(F.col("p") / F.col("weight"))).first()[0] or 1.0
    epochs = F.round(F.col("weight") / F.col("p") * F.lit(scale), 9)
    return weighted.select("key", "weight", epochs.alias("epochs"), F.ceil(F.col("n") / BLOCK).alias("blocks"))


def copies(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(_row, key, weight, block, copies) of ``rows`` (_row, key, tokens): how often each row is read."""
    plan = _small(stash(source_plan(rows, mix)))
    dealt = rows.join(plan, "key").withColumn("block", F.pmod(F.xxhash64("_row", F.lit(1)), F.col("blocks")))
    dealt = dealt.withColumn("turn", F.xxhash64("_row", F.lit(2)))
    block = Window.partitionBy("key", "block")
    so_far = block.orderBy("turn", "_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = F.col("epochs") - F.floor("epochs")
    taken = F.sum("tokens").over(so_far) - F.col("tokens") / 2.0 <= part * F.sum("tokens").over(block)
    return dealt.select("_row", "key", "weight", "block", (F.floor("epochs") + taken.cast("long")).alias("copies"))


def mix_plan(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per reading of a document: its source and weight, epoch, block and place in the block's permutation."""
    rows = stash(
        docs.select(
            F.monotonically_increasing_id().alias("_row"), "doc_id", "source", source_key(F.col("source")).alias("key"),
            token_count(whole(F.col("text"))).alias("tokens"),
        )
    )
    read = copies(rows.select("_row", "key", "tokens"), mix).where("copies > 0")
    each = read.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    turn = Window.partitionBy("key", "block", "epoch").orderBy(F.xxhash64("_row", F.col("epoch"), F.lit(3)), "_row")
    each = each.withColumn("slot", F.row_number().over(turn))
    named = rows.select("_row", "doc_id", "source", "tokens")
    return each.join(named, "_row").select("doc_id", "source", "weight", "tokens", "epoch", "block", "slot")


def mix_documents(docs: DataFrame, mix: Mix) -> DataFrame:
    """``docs`` with each row as often as the mix reads it."""
    packed = stash(docs.select(F.struct("*").alias("r"), F.monotonically_increasing_id().alias("_row")))
    key = source_key(F.col("r")["source"])
    rows = stash(packed.select("_row", key.alias("key"), token_count(whole(F.col("r")["text"])).alias("tokens")))
    plan = stash(source_plan(rows, mix))
    block = F.pmod(F.xxhash64("_row", F.lit(1)), F.col("blocks"))
    counted = copies(rows, mix)
    # One row per block: the turn of the last row that the partial epoch takes.
    cuts = (
        counted.join(_small(plan.select("key", "epochs")), "key")
        .where(F.col("copies") > F.floor("epochs"))
        .groupBy("key", "block")
        .agg(F.max(F.struct(F.xxhash64("_row", F.lit(2)).alias("turn"), "_row")).alias("last"))
    )
    cuts = _small(stash(cuts))
    own = packed.withColumn("key", key).join(_small(plan), "key").withColumn("block", block)
    own = own.join(cuts, ["key", "block"], "left")
    more = F.struct(F.xxhash64("_row", F.lit(2)).alias("turn"), F.col("_row")) <= F.col("last")
    n = F.floor("epochs") + F.coalesce(more, F.lit(False)).cast("long")
    read = own.withColumn("_n", n).where("_n > 0")
    return read.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select("r.*")
