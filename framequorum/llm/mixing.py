"""Temperature mixing: source shares raised to a power that meets a target, dealt as block permutations."""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import keep, lookup

#: Points of the exponent that one pass over the source table tries at once.
POINTS = 16
ROUNDS = 9
#: Hash slices of a source's permutation; the last slice is cut row by row.
SLICE_BITS = 12


def token_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


@dataclass(frozen=True)
class Exponent:
    """The chosen power and what it gives: entropy in nats and the most passes over any source."""

    power: float
    entropy: float
    repetition: float


def _measure(shares: DataFrame, powers: list[float], budget_ratio: float) -> list[Exponent]:
    """One aggregate over the source table for all powers."""
    p = F.col("share")
    aggs = []
    for i, a in enumerate(powers):
        w = F.pow(p, F.lit(a))
        aggs += [F.sum(w).alias(f"z{i}"), F.sum(w * F.lit(a) * F.log(p)).alias(f"l{i}"), F.max(F.pow(p, F.lit(a - 1))).alias(f"m{i}")]
    r = shares.agg(*aggs).first()
    return [Exponent(a, log(r[f"z{i}"]) - r[f"l{i}"] / r[f"z{i}"], r[f"m{i}"] / r[f"z{i}"] * budget_ratio) for i, a in enumerate(powers)]


def choose_power(shares: DataFrame, flattening: float | None, max_repetition: float | None, budget_ratio: float = 1.0) -> Exponent:
    """Bisect the exponent in [0, 1], POINTS cuts a pass.

    The target entropy lies ``flattening`` of the way from the corpus' own entropy (power 1)
    to that of equal shares (power 0). The smallest power whose entropy is at most the target
    and whose largest repetition is at most max_repetition; power 1 where none is. Entropy
    and repetition fall as the power grows, so a bisection finds it.
    """
    n = shares.count()
    if n == 0:
        return Exponent(1.0, 0.0, budget_ratio)
    own = _measure(shares, [1.0], budget_ratio)[0].entropy
    goal = float("inf") if flattening is None else own + flattening * (log(n) - own) + 1e-9
    limit = float("inf") if max_repetition is None else max_repetition
    fits = lambda e: e.entropy <= goal and e.repetition <= limit + 1e-9
    low, high = 0.0, 1.0
    best = None
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / POINTS for i in range(POINTS + 1)]
        tried = _measure(shares, grid, budget_ratio)
        at = next((i for i, e in enumerate(tried) if fits(e)), None)
        if at is None:
            return tried[-1] if best is None else best
        best = tried[at]
        if at == 0:
            return best
        low, high = grid[at - 1], grid[at]
    return best


def _order(passes: Column, key: Column, seed: int) -> Column:
    """A row's place (63 bits) in the permutation of its source that a pass uses."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), passes.cast("long"), key), 1)


def plan_mixture(rows: DataFrame, flattening: float | None = 0.5, max_repetition: float | None = 4.0, budget: int | None = None, seed: int = 11) -> DataFrame:
    """For every source: tokens, weight, budget, whole passes and where its last pass is cut.

    rows has key (long), source and tokens. Whole passes are permutations of all of a
    source's rows; the last pass keeps the longest prefix of its permutation within what is
    left of the budget. Prefix sums go over hash slices first and row by row only in the
    slice that holds the cut, so no task sees a whole source.
    """
    stats = keep(rows.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count("*").alias("source_docs")))
    total = int(stats.agg(F.sum("source_tokens")).first()[0] or 0)
    budget = total if budget is None else budget
    shares = keep(stats.where("source_tokens > 0").select((F.col("source_tokens") / F.lit(float(max(1, total)))).alias("share")))
    chosen = choose_power(shares, flattening, max_repetition, budget / max(1, total))
    z = shares.agg(F.sum(F.pow("share", F.lit(chosen.power)))).first()[0] or 1.0
    weight = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens") / F.lit(float(max(1, total))), F.lit(chosen.power)) / F.lit(z)).otherwise(0.0)
    plan = stats.withColumn("weight", weight)
    plan = plan.withColumn("source_budget", F.when(F.col("source_tokens") > 0, F.round(F.col("weight") * F.lit(float(budget))).cast("long")).otherwise(F.lit(0).cast("long")))
    whole = F.when(F.col("source_tokens") > 0, F.expr("source_budget div source_tokens")).otherwise(F.lit(1).cast("long"))
    plan = plan.withColumn("passes", whole).withColumn("left_over", F.when(F.col("source_tokens") > 0, F.col("source_budget") - F.col("passes") * F.col("source_tokens")).otherwise(F.lit(0).cast("long")))
    plan = plan.withColumn("power", F.lit(chosen.power))
    last = lookup(rows, plan.where("left_over > 0").select("source", "passes", "left_over"), "source", "inner")
    last = last.withColumn("place", _order(F.col("passes"), F.col("key"), seed)).withColumn("slice", F.shiftright("place", 63 - SLICE_BITS).cast("int"))
    sums = last.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"), F.first("left_over").alias("left_over"))
    upto = F.sum("slice_tokens").over(Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    over = sums.withColumn("upto", upto).where("upto > left_over").groupBy("source").agg(F.min_by(F.struct("slice", (F.col("upto") - F.col("slice_tokens")).alias("before")), "slice").alias("s"))
    over = keep(over.select("source", F.col("s.slice").alias("cut_slice"), F.col("s.before").alias("before")))
    inside = lookup(last.select("source", "place", "slice", "tokens", "left_over"), over, "source", "inner").where("slice = cut_slice")
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    cut = inside.withColumn("run", run + F.col("before")).where("run <= left_over").groupBy("source").agg(F.max("place").alias("cut_place"))
    plan = lookup(plan, over, "source")
    plan = lookup(plan, keep(cut), "source")
    edge = F.when(F.col("cut_slice").isNull(), F.when(F.col("left_over") > 0, F.lit(2**63 - 1)).otherwise(F.lit(-1).cast("long"))).otherwise(F.coalesce("cut_place", F.shiftleft(F.col("cut_slice").cast("long"), 63 - SLICE_BITS) - F.lit(1)))
    return keep(plan.select("source", "source_tokens", "source_docs", "weight", "power", "source_budget", "passes", "left_over", edge.alias("cut_place")))


def deal(rows: DataFrame, plan: DataFrame, seed: int = 11) -> DataFrame:
    """Rows as often as their source's budget says, with ``pass`` from 0 and ``place`` in that pass's permutation."""
    with_plan = lookup(rows, plan.select("source", "weight", "passes", "cut_place"), "source", "inner")
    partial = (_order(F.col("passes"), F.col("key"), seed) <= F.col("cut_place")).cast("long")
    out = with_plan.withColumn("copies", F.col("passes") + partial).where("copies > 0")
    out = out.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return out.withColumn("place", _order(F.col("pass"), F.col("key"), seed)).drop("passes", "cut_place", "copies")


def mix_sources(docs: DataFrame, flattening: float | None = 0.5, max_repetition: float | None = 4.0, budget: int | None = None, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Temperature mixing of documents: (doc_id, source, tokens, weight, pass, place), one row per use.

    Order by (pass, place) within a source to get its block permutations. Texts are read
    once for their token counts; everything after that moves ids and counts only.

    Defined cases: null sources are one source; null and empty texts have no tokens and cost
    nothing; a source without tokens is used once, whole; rows with one id share their places
    and are cut together; an empty table gives no rows.
    """
    rows = keep(docs.select(F.col(id_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col).cast("string")).alias("tokens")))
    plan = plan_mixture(rows, flattening, max_repetition, budget, seed)
    out = deal(rows, plan, seed)
    return out.select(F.col("key").alias("doc_id"), "source", "tokens", F.round("weight", 9).alias("weight"), F.col("pass").cast("int").alias("pass"), "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents themselves, with all their columns, as often as the mixture uses them.

    Each row decides from its own id and its source's plan, so texts are not shuffled.
    """
    seed = how.get("seed", 11)
    names = docs.columns
    rows = keep(docs.select(F.col(id_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"), token_count(F.col(text_col).cast("string")).alias("tokens")))
    plan = plan_mixture(rows, **how)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(id_col).cast("long").alias("key"), F.col(source_col).cast("string").alias("source"))
    return deal(whole, plan, seed).select("_row.*")
