"""Mixing sources by temperature, DataFrame functions only.

A source's weight is its share of tokens to the power of an exponent, made to sum to one. The
exponent is bisected between 0 (all sources alike) and 1 (as they come): the largest one whose
weights reach a target entropy, or the smallest one at which no source is repeated more often
than a limit allows. Several steps of the bisection share one job, as the sums for all midpoints
they may need are formed together.

With a budget of tokens (by default the least that leaves no document out) each source is passed
through ``epochs = weight * budget / tokens`` times. Whole passes take every document. The last,
partial pass is a permutation of blocks, each about ``BLOCK`` tokens of documents dealt by hash,
taken in the order of a hash of block and pass until the source's tokens are used up; the block
that does not fit whole gives its documents in the order of a hash. So no task orders more than
the documents of one block, or the blocks of one source.

Tokens are words and one end per document. Defined results: null texts are empty; a null source
is a source of its own; rows with equal ids or equal rows are documents of their own; null ids
are allowed; an empty table gives no rows; other columns are carried by ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from continuum.llm.quality import words_of
from continuum.sources.shared import cut_lineage

REPETITIONS = 1.5
BLOCK = 1_000_000
STEPS = 28
PER_JOB = 4
DECIMALS = 6
MOST_BROADCAST = 20_000  # sources; each is a short row


def token_count(text: Column) -> Column:
    return (F.size(words_of(F.coalesce(text, F.lit("")))) + 1).cast("long")


def order_key(*parts: Column) -> Column:
    """A number below 2**32 from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _bisect(enough, low: float = 0.0, high: float = 1.0) -> float:
    """The least exponent in [0, 1], to within 2**-STEPS, for which ``enough`` holds.

    ``enough`` takes a list of exponents and answers for all of them in one job.
    """
    for _ in range(STEPS // PER_JOB):
        n = 1 << PER_JOB
        between = [low + (high - low) * k / n for k in range(1, n)]
        holds = enough(between)
        first = next((k for k, yes in enumerate(holds) if yes), n - 1)
        high = between[first] if first < n - 1 else high
        low = between[first - 1] if first else low
    return high


def exponent_for_repetitions(totals: DataFrame, most: float, budget: float | None = None) -> float:
    """The least exponent at which no source is passed through more than ``most`` times."""
    whole, large, small = totals.agg(F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not whole:
        return 1.0
    if budget is None:
        return round(_bisect(lambda xs: [(large / small) ** (1 - x) <= most for x in xs]), DECIMALS)

    def enough(xs: list[float]) -> list[bool]:
        sums = [F.sum(F.pow(F.col("tokens") / float(whole), F.lit(x))) for x in xs]
        row = totals.agg(*[s.alias(f"z{i}") for i, s in enumerate(sums)]).first()
        return [(small / whole) ** x / z * budget / small <= most for x, z in zip(xs, row, strict=True)]

    return round(_bisect(enough), DECIMALS)


def exponent_for_entropy(totals: DataFrame, target: float) -> float:
    """The largest exponent whose weights have at least the target entropy, in nats."""
    whole, n = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not whole:
        return 1.0
    if target >= math.log(n):
        return 0.0
    share = F.col("tokens") / float(whole)

    def too_sharp(xs: list[float]) -> list[bool]:
        columns = []
        for i, x in enumerate(xs):
            columns.append(F.sum(F.pow(share, F.lit(x))).alias(f"z{i}"))
            columns.append(F.sum(F.pow(share, F.lit(x)) * F.log(share)).alias(f"l{i}"))
        row = totals.agg(*columns).first()
        return [math.log(row[2 * i]) - x * row[2 * i + 1] / row[2 * i] < target for i, x in enumerate(xs)]

    return round(_bisect(too_sharp), DECIMALS)


def source_totals(docs: DataFrame) -> DataFrame:
    """``src, tokens`` of a table with ``src`` and ``n_tokens``: one short row per source."""
    return cut_lineage(docs.groupBy("src").agg(F.sum("n_tokens").alias("tokens")))


def passes(totals: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``src, tokens, weight, full, quota``: whole passes, and tokens of the partial one."""
    sums = totals.agg(F.sum("tokens"), F.max("tokens"), F.sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent)))).first()
    whole, large, z = (float(x or 1) for x in sums)
    tokens = F.col("tokens").cast("double")
    weight = F.pow(tokens, F.lit(exponent)) / z
    if budget is None:
        epochs = F.pow(large / tokens, F.lit(1 - exponent))
    else:
        epochs = weight * budget / tokens
    full = F.floor(epochs)
    return totals.select(
        "src", "tokens", weight.alias("weight"), full.cast("int").alias("full"),
        F.floor((epochs - full) * tokens).cast("long").alias("quota"),
    )


def mixed(
    docs: DataFrame,
    repetitions: float | None = REPETITIONS,
    entropy: float | None = None,
    budget: float | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """The rows of ``docs``, repeated by pass: ``_doc`` (the row), ``epoch``, ``n_tokens``, ``weight``."""
    text = F.col("_doc")["text"]
    key = order_key(F.col("_doc")["doc_id"], F.md5(F.coalesce(text, F.lit(""))))
    rows = docs.select(F.struct("*").alias("_doc")).select(
        "_doc", F.coalesce(F.concat(F.lit("="), F.col("_doc")["source"]), F.lit("")).alias("src"), key.alias("key")
    )
    count = token_count(text)  # words are counted only where a step needs them
    totals = source_totals(rows.withColumn("n_tokens", count))
    if entropy is not None:
        exponent = exponent_for_entropy(totals, entropy)
    else:
        exponent = exponent_for_repetitions(totals, repetitions, budget)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("tokens") / block)).cast("long")
    plan = cut_lineage(passes(totals, exponent, budget).withColumn("n_blocks", n_blocks))
    small = plan.count() <= MOST_BROADCAST

    def beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
        """Joined without moving the rows while the sources are known to be few."""
        return left.join(F.broadcast(right) if small else right.hint("merge"), keys, how)

    placed = beside(rows, plan, ["src"]).withColumn("block", F.col("key") % F.col("n_blocks"))
    # Which blocks the partial pass takes whole, and which one it cuts.
    open_ = placed.filter("quota > 0")
    sizes = open_.withColumn("n_tokens", count).groupBy("src", "block", "full", "quota").agg(
        F.sum("n_tokens").alias("size")
    )
    place = F.struct(
        order_key(F.col("src"), F.col("block"), F.col("full")).alias("o"), F.col("block").alias("b")
    )
    turn = Window.partitionBy("src").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    lined = cut_lineage(
        sizes.withColumn("end", F.sum("size").over(turn)).withColumn("begin", F.col("end") - F.col("size"))
    )
    cut = lined.filter("begin < quota AND end > quota").select(
        "src", "block", (F.col("quota") - F.col("begin")).alias("left")
    )
    # A block is taken whole if its turn is not after the last whole one: no list of blocks is joined.
    edges = lined.filter("end <= quota").groupBy("src").agg(F.max(place).alias("edge"))
    epochs = F.when(place <= F.col("edge"), F.sequence(F.lit(0), F.col("full"))).when(
        F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)
    )
    whole = beside(placed, edges, ["src"], "left").withColumn("epoch", F.explode(epochs)).withColumn("n_tokens", count)
    inner = Window.partitionBy("src", "block").orderBy("key", F.col("_doc")["doc_id"]).rowsBetween(
        Window.unboundedPreceding, 0
    )
    some = (
        beside(open_, cut, ["src", "block"]).withColumn("n_tokens", count)
        .withColumn("end", F.sum("n_tokens").over(inner)).filter(F.col("end") <= F.col("left"))
    )
    keep = ["_doc", "n_tokens", "weight"]
    return whole.select(*keep, "epoch").unionByName(some.select(*keep, F.col("full").alias("epoch")))


def remixed(docs: DataFrame, **how) -> DataFrame:
    """The mixed rows with the columns of ``docs``."""
    return mixed(docs, **how).select("_doc.*")
