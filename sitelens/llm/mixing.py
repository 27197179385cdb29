"""Mixing sources to target weights: raking, then sampling by calibrated probabilities.

Documents are counted into cells (source, language, topic) by tokens.  Iterative
proportional fitting rescales the cells' weights to the target share of every
source, then language, then topic, round after round until all margins hold.  No
cell can give more tokens than it has, so the weights are then raked to the token
budget under that bound: cells at the bound stay there and the free cells of a margin
value take what is left of its target.  The ratio of kept to present tokens is the
probability with which a cell's documents are kept.  Where a value has fewer tokens
than its share of the budget, the budget is lowered: shares come first.

Scale: one aggregate with partial sums makes the cells; fitting runs on cells
only (distinct combinations, not documents) as window sums; probabilities go back
by a salted join, since one cell may hold a third of all documents.  Only scalars
(totals, margin error) reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import prepare, salted_join, text_or_empty, words

MARGINS = ("source", "lang", "topic")
TOPICS = 8
SMOOTHING = 0.7                            # target share of a value ~ (its share of tokens) ** 0.7
KEEP = 0.8                                 # share of all tokens to keep
ROUNDS, TOLERANCE = 30, 1e-4
ATTEMPTS = 4                               # budgets tried under the bound before plain scaling


def lexical_topic(word_list: Column, topics: int = TOPICS) -> Column:
    """Topic of a text without topic labels: hash class of its longest word (ties: the greatest)."""
    longest = F.array_max(F.transform(word_list, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    return F.when(longest.isNotNull(), F.concat(F.lit("t"), F.pmod(F.crc32(longest.cast("binary")), F.lit(topics))))


def cell_name(margins=MARGINS) -> Column:
    return F.to_json(F.struct(*margins), {"ignoreNullFields": "false"})


def target_shares(cells: DataFrame, margin: str, targets: dict[str, float] | None, smoothing: float) -> DataFrame:
    """Add ``t_<margin>``: the target share of the cell's value, given or smoothed from the data.

    Given targets: values not named have share 0, and shares are rescaled over the
    values that occur.
    """
    own = Window.partitionBy(margin)
    if targets is None:
        raw = F.pow(F.sum("tokens").over(own), F.lit(smoothing))
    else:
        raw = reduce(lambda rest, kv: F.when(F.col(margin) == kv[0], F.lit(float(kv[1]))).otherwise(rest),
                     targets.items(), F.lit(0.0))
    cells = cells.withColumn("__raw", raw).withColumn("__one", F.row_number().over(own.orderBy("cell")) == 1)
    total = F.sum(F.when(F.col("__one"), F.col("__raw"))).over(Window.partitionBy())
    return cells.withColumn(f"t_{margin}", F.col("__raw") / total).drop("__raw", "__one")


def rake(cells: DataFrame, margins=MARGINS, targets: dict[str, dict[str, float]] | None = None,
         smoothing: float = SMOOTHING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (cell, margins, tokens) with ``weight``: fitted token weights with the target margins.

    Stops when the largest relative margin error is under ``tolerance`` or after
    ``rounds`` rounds (targets that no positive weights can meet stay unmet).
    """
    for m in margins:
        cells = target_shares(cells, m, (targets or {}).get(m), smoothing)
    total = F.sum("tokens").over(Window.partitionBy())
    cells = cells.withColumn("total", total).withColumn("weight", F.col("tokens").cast("double")).checkpoint()
    for _ in range(rounds):
        for m in margins:
            have = F.sum("weight").over(Window.partitionBy(m))
            cells = cells.withColumn("weight", F.when(have > 0, F.col("weight") * F.col(f"t_{m}") * F.col("total") / have)
                                     .otherwise(F.lit(0.0)))
        cells = cells.checkpoint()
        error = _margin_errors(cells, "weight", {m: F.col(f"t_{m}") * F.col("total") for m in margins})[0]
        if error is None or error < tolerance:
            break
    return cells


def _margin_errors(cells: DataFrame, weight: str, goals: dict[str, Column]) -> tuple[float | None, float | None]:
    """Largest relative error of a margin value, and the least ratio of weight to goal."""
    ratios = [cells.groupBy(m).agg(F.sum(weight).alias("have"), F.max(goal).alias("goal")).filter("goal > 0").select(
        (F.col("have") / F.col("goal")).alias("r")) for m, goal in goals.items()]
    return tuple(reduce(DataFrame.union, ratios).agg(F.max(F.abs(F.col("r") - 1)), F.min("r")).first())


def _bounded_step(cells: DataFrame, margin: str, budget: float) -> DataFrame:
    """Scale ``x`` within each margin value so that the sum of least(tokens, x) is the value's part of the budget.

    Cells in order of tokens / x reach their bound first; the others share the rest.
    A value with too few tokens has all its cells at the bound.
    """
    own = Window.partitionBy(margin)
    upto = own.orderBy("__r", "cell").rowsBetween(Window.unboundedPreceding, 0)
    goal = F.col(f"g_{margin}") * budget
    cells = cells.withColumn("__r", F.when(F.col("x") > 0, F.col("tokens") / F.col("x")))
    real = F.when(F.col("x") > 0, F.col("tokens")).otherwise(0)
    rest = F.greatest(F.sum("x").over(own) - F.sum("x").over(upto), F.lit(0.0))
    cells = cells.withColumn("__full", (F.col("x") > 0) & (F.sum(real).over(upto) + F.col("__r") * rest <= goal))
    full = F.sum(F.when(F.col("__full"), F.col("tokens")).otherwise(0)).over(own)
    free = F.sum(F.when(F.col("__full"), F.lit(0.0)).otherwise(F.col("x"))).over(own)
    scale = F.when(free > 0, (goal - full) / free).otherwise(F.max("__r").over(own))
    return cells.withColumn("x", F.when(F.col("x") > 0, F.col("x") * scale).otherwise(F.lit(0.0))).drop("__r", "__full")


def keep_within(cells: DataFrame, margins=MARGINS, keep: float = KEEP, rounds: int = ROUNDS,
                tolerance: float = TOLERANCE) -> DataFrame:
    """Add ``kept``: tokens to keep of each raked cell, at most its tokens, with the margins of ``weight``.

    Their sum is ``keep`` of all tokens, or less where the shares can't be met with so
    many: first what the scarcest margin value allows, then, if the cells allow less,
    lowered by the worst shortfall.  Scaling the weights down until the scarcest cell
    suffices always meets the shares, so the budget never falls below that.
    """
    w = F.col("weight")
    total, tokens, room = cells.agg(F.sum("weight"), F.sum("tokens"), F.min(F.when(w > 0, F.col("tokens") / w))).first()
    if not total:
        return cells.withColumn("kept", F.lit(0.0))
    for m in margins:
        cells = cells.withColumn(f"g_{m}", F.sum("weight").over(Window.partitionBy(m)) / total)
    cells = cells.checkpoint()
    present = cells.withColumn("__real", F.when(w > 0, F.col("tokens")))
    reach = _margin_errors(present, "__real", {m: F.col(f"g_{m}") for m in margins})[1]
    budget, safe = min(keep * tokens, reach), room * total
    if budget > safe:
        fitted = cells.withColumn("x", w * (budget / total))
        for _ in range(ATTEMPTS):
            for _ in range(rounds):
                for m in margins:
                    fitted = _bounded_step(fitted, m, budget)
                fitted = fitted.withColumn("kept", F.least(F.col("tokens").cast("double"), "x")).checkpoint()
                error, least = _margin_errors(fitted, "kept", {m: F.col(f"g_{m}") * budget for m in margins})
                if error < tolerance:
                    return fitted.drop("x")
            budget *= least
            if budget <= safe:
                break
    return cells.withColumn("kept", w * (min(budget, safe) / total))


def _counted(docs: DataFrame, margins, key: str, text: str) -> DataFrame:
    """Rows (__key, margins, n_tokens, cell) of all documents."""
    prepare(docs.sparkSession)
    w = words(text_or_empty(text))
    topic = F.col("topic") if "topic" in docs.columns else lexical_topic(F.col("__w"))
    rows = docs.withColumn("__w", w).withColumn("topic", topic).select(
        F.col(key).alias("__key"), *margins, F.size("__w").cast("long").alias("n_tokens"))
    return rows.withColumn("cell", cell_name(margins)).checkpoint()


def _fitted(rows: DataFrame, margins, targets, smoothing: float, keep: float) -> DataFrame:
    cells = rows.groupBy("cell", *margins).agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0")
    return keep_within(rake(cells, margins, targets, smoothing), margins, keep)


def margin_shares(docs: DataFrame, margins=MARGINS, targets: dict[str, dict[str, float]] | None = None,
                  smoothing: float = SMOOTHING, keep: float = KEEP, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """Rows (margin, value, target, reached): target share of each margin value and its share of the kept tokens."""
    cells = _fitted(_counted(docs, margins, key, text), margins, targets, smoothing, keep).checkpoint()
    total = cells.agg(F.sum("kept")).first()[0] or 1.0
    return reduce(DataFrame.union, [cells.groupBy(F.col(m).cast("string").alias("value")).agg(
        F.max(f"t_{m}").alias("target"), (F.sum("kept") / total).alias("reached")).select(
        F.lit(m).alias("margin"), "value", "target", "reached") for m in margins])


def mix(docs: DataFrame, margins=MARGINS, targets: dict[str, dict[str, float]] | None = None,
        smoothing: float = SMOOTHING, keep: float = KEEP, seed: int = 7, key: str = "doc_id",
        text: str = "text") -> DataFrame:
    """One row per document: key, margins, n_tokens, probability, sampled.

    Tokens are words.  ``topic`` is taken from the table if it has that column, else
    the lexical topic.  Nulls are values of their own margins.  A text without words
    weighs nothing; it goes with its cell, or is kept (probability 1) if the whole
    cell has no tokens.  Sampling compares a hash of (seed, key) with the
    probability, so it does not depend on partitions, and rows with equal keys
    share their fate.  probability * n_tokens has the target margins that the cells
    allow (``margin_shares`` tells targets and reached shares); ``keep`` of all tokens
    are kept, fewer if the targets need that.  An empty table gives no rows.
    """
    rows = _counted(docs, margins, key, text)
    fitted = _fitted(rows, margins, targets, smoothing, keep)
    chance = fitted.select("cell", (F.col("kept") / F.col("tokens")).alias("probability"))
    out = salted_join(rows, chance, ["cell"], F.col("__key"), "left")
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("__key").cast("string"))), 1, 12), 16, 10)
    out = out.withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return out.select(F.col("__key").alias(key), *margins, "n_tokens", "probability",
                      (draw.cast("double") / F.lit(float(16 ** 12)) < F.col("probability")).alias("sampled"))
