"""Mixing sources to target weights by temperature, in DataFrame operations only.

Source shares p of the tokens become weights p**a / sum(p**a). The exponent a is bisected until the
weights meet a target entropy or keep within a repetition limit. A source's budget of tokens is
realised as passes over its documents; each pass is a permutation of blocks, and of the rows in a block, and the
last pass ends where the budget does.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_broadcast, materialise

#: Up to so many sources, their table of one small row each is broadcast.
BROADCAST_SOURCES = 100_000
#: Exponents that one pass over the sources tries, less one, and the passes: 64**9 = 2**54 steps in all.
FAN, ROUNDS = 64, 9
#: Rows of a block, about.
BLOCK_ROWS = 2048


@dataclass(frozen=True)
class Target:
    """What the exponent is bisected for; exactly one is given.

    repetition: the flattest weights at which no source is passed over more often than this, while
    the budget covers every source once. entropy: the share of the largest possible entropy.
    """

    repetition: float | None = 2.0
    entropy: float | None = None


def weights_at(tokens: dict, exponent: float) -> dict:
    total = sum(tokens.values())
    logs = {s: exponent * math.log(n / total) for s, n in tokens.items() if n > 0}
    top = max(logs.values(), default=0.0)
    z = sum(math.exp(x - top) for x in logs.values())
    return {s: math.exp(x - top) / z for s, x in logs.items()}


def entropy_share(weights: dict) -> float:
    if len(weights) < 2:
        return 1.0
    return -sum(w * math.log(w) for w in weights.values() if w > 0) / math.log(len(weights))


def covering_budget(tokens: dict, weights: dict) -> float:
    """The smallest budget that gives each source as many tokens as it has."""
    return max((tokens[s] / w for s, w in weights.items()), default=0.0)


def repetition(tokens: dict, weights: dict, budget: float | None = None) -> float:
    budget = covering_budget(tokens, weights) if budget is None else budget
    return max((w * budget / tokens[s] for s, w in weights.items()), default=0.0)


def smallest_exponent(flat_enough: Callable[[list[float]], list[bool]]) -> float:
    """The smallest exponent in [0, 1] that is flat enough, where every larger one is; 1 where none is.

    flat_enough is asked for many exponents at once, so that a few passes over the sources do.
    """
    low, high = 0.0, 1.0
    if flat_enough([low])[0]:
        return low
    for _ in range(ROUNDS):
        asked = [low + (high - low) * k / FAN for k in range(1, FAN)]
        first = next((k for k, good in enumerate(flat_enough(asked)) if good), len(asked))
        low, high = (asked[first - 1] if first else low), (asked[first] if first < len(asked) else high)
    return high


def bisect_exponent(tokens: dict, target: Target, budget: float | None = None) -> float:
    """The exponent in [0, 1] nearest to 0 (all sources alike) that meets the target.

    With the repetition limit, exponent 1 repeats sources least. With the entropy, the weights' entropy
    falls as the exponent grows; the exponent is 0 or 1 where the target lies beyond.
    """

    def flat_enough(a: float) -> bool:
        w = weights_at(tokens, a)
        return entropy_share(w) <= target.entropy if target.entropy is not None else repetition(tokens, w, budget) <= target.repetition

    return smallest_exponent(lambda exponents: [flat_enough(a) for a in exponents])


@dataclass(frozen=True)
class Totals:
    """The sources that hold tokens, as sums over a table of any number of them: rows(mix_source, n, t)."""

    rows: DataFrame
    count: int
    least: int
    most: int

    def sums(self, exponents: list[float]) -> list[tuple[float, float]]:
        """For each exponent a: the sum z of (t / most)**a, and the mean of log(t / most) by the weights (t / most)**a / z."""
        x = F.log(F.col("t") / F.lit(self.most))
        each = self.rows.where("t > 0").select(x.alias("x"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        part = F.exp(F.col("a") * F.col("x"))
        found = {r["a"]: (r["z"], r["m"] / r["z"]) for r in each.groupBy("a").agg(F.sum(part).alias("z"), F.sum(part * F.col("x")).alias("m")).collect()}
        return [found[a] for a in exponents]

    def covering_budget(self, z: float) -> float:
        """As covering_budget(): tokens over weight are largest at the largest source, for exponents up to 1."""
        return self.most * z

    def flat_enough(self, target: Target, budget: float | None) -> Callable[[list[float]], list[bool]]:
        def asked(exponents: list[float]) -> list[bool]:
            out = []
            for a, (z, mean) in zip(exponents, self.sums(exponents), strict=True):
                if target.entropy is not None:
                    share = (math.log(z) - a * mean) / math.log(self.count) if self.count > 1 else 1.0
                    out.append(share <= target.entropy)
                else:  # the smallest source is repeated most
                    whole = self.covering_budget(z) if budget is None else budget
                    out.append((self.least / self.most) ** a / z * whole / self.least <= target.repetition)
            return out

        return asked


def _tokens() -> Column:
    """Runs of other than white space; 0 of a null text."""
    return F.coalesce(F.size(F.filter(F.split("text", r"[\x09-\x0D\x20]+"), lambda w: w != "")), F.lit(0)).cast("long")


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _source() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def _block_order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed + 1), F.col("mix_source"), F.col("mix_cell"))


@dataclass(frozen=True)
class MixingPlan:
    """rows: doc_id, source, mix_source, mix_key, mix_tokens, mix_cell of every row (a table in the shared folder).
    sources: one row a source: mix_source, weight, blocks, passes, rest, cut_order, cut_key (a table there too); count: its rows."""

    rows: DataFrame
    sources: DataFrame
    seed: int
    count: int

    def with_sources(self, df: DataFrame) -> DataFrame:
        """df with the columns of its source; the table of sources is broadcast where it is small."""
        return df.join(bounded_broadcast(self.sources, self.count, BROADCAST_SOURCES), "mix_source")

    def uses(self) -> Column:
        """How often a row is used, by columns of `sources`: whole passes, and once more where its turn comes before the cut."""
        order = _block_order(self.seed)
        return F.col("passes") + F.when((order < F.col("cut_order")) | ((order == F.col("cut_order")) & (F.col("mix_key") <= F.col("cut_key"))), 1).otherwise(0)


def mixing_plan(docs: DataFrame, target: Target = Target(), budget: float | None = None, seed: int = 17, block_rows: int = BLOCK_ROWS) -> MixingPlan:  # noqa: B008
    """Weights, budgets and cuts for docs(doc_id, text, source).

    budget: tokens of the mixture, by default the smallest that covers every source. A source's rows
    stand in a fixed order: blocks by a hash, rows in a block by another. The cut, last pass uses the first
    rows of that order whose tokens together keep within the rest of the budget. A null source is
    a source like another. Rows without tokens and null texts cost nothing; a source of such rows alone is passed
    over once. Repeated rows share a place and are used alike. An empty table gives an empty plan.
    """
    narrow = materialise(docs.select("doc_id", "source", _source().alias("mix_source"), _key(seed).alias("mix_key"), _tokens().alias("mix_tokens")), "mixing")
    totals = materialise(narrow.groupBy("mix_source").agg(F.count("*").alias("n"), F.sum("mix_tokens").alias("t")), "mixing-totals")
    known = totals.agg(F.count("*"), F.count(F.when(F.col("t") > 0, 1)), F.min(F.when(F.col("t") > 0, F.col("t"))), F.max("t")).first()
    count, weight, share = known[0], F.lit(0.0), F.lit(0).cast("long")
    if known[1]:
        held = Totals(totals, *known[1:])
        exponent = smallest_exponent(held.flat_enough(target, budget))
        z = held.sums([exponent])[0][0]
        weight = F.when(F.col("t") > 0, F.exp(F.lit(exponent) * F.log(F.col("t") / F.lit(held.most))) / F.lit(z)).otherwise(0.0)
        share = F.round(weight * F.lit(held.covering_budget(z) if budget is None else float(budget))).cast("long")
    with_share = totals.select("mix_source", "n", "t", weight.alias("weight"), share.alias("share"))
    passes = F.when(F.col("t") > 0, F.floor(F.col("share") / F.col("t"))).otherwise(1).cast("long")
    planned = with_share.select(
        "mix_source", "weight", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block_rows))).cast("long").alias("blocks"), passes.alias("passes"),
        F.when(F.col("t") > 0, F.col("share") % F.col("t")).otherwise(0).cast("long").alias("rest"),
    )
    few = lambda df: bounded_broadcast(df, count, BROADCAST_SOURCES)
    celled = narrow.join(few(planned), "mix_source").withColumn("mix_cell", F.pmod("mix_key", "blocks"))

    # one row a block: the first that the rest of the budget doesn't hold whole is cut
    blocks = celled.groupBy("mix_source", "mix_cell").agg(F.sum("mix_tokens").alias("t"), F.first("rest").alias("rest")).withColumn("order", _block_order(seed))
    upto = F.sum("t").over(Window.partitionBy("mix_source").orderBy("order"))
    cut = blocks.withColumn("upto", upto).where("upto > rest").groupBy("mix_source").agg(F.min(F.struct("order", (F.col("upto") - F.col("t")).alias("before"), "mix_cell")).alias("cut"))
    cut = cut.select("mix_source", "cut.*")
    inside = celled.join(few(cut), ["mix_source", "mix_cell"])
    reach = F.col("before") + F.sum("mix_tokens").over(Window.partitionBy("mix_source").orderBy("mix_key"))
    keys = inside.withColumn("reach", reach).groupBy("mix_source").agg(F.first("order").alias("cut_order"), F.max(F.when(F.col("reach") <= F.col("rest"), F.col("mix_key"))).alias("cut_key"))
    # a source without a cut block has no tokens, and no pass beyond the whole ones
    sources = materialise(planned.join(few(keys), "mix_source", "left"), "mixing-sources")
    return MixingPlan(celled.select("doc_id", "source", "mix_source", "mix_key", "mix_tokens", "mix_cell"), sources, seed, count)


def mixing_schedule(docs: DataFrame, target: Target = Target(), budget: float | None = None, seed: int = 17) -> DataFrame:  # noqa: B008
    """One row for each use of a row of docs(doc_id, text, source): doc_id, source, n_tokens, weight (of its
    source), pass (from 1), block (its block's place in the order, from 1), rank (its place in the block, from 1)."""
    plan = mixing_plan(docs, target, budget, seed)
    blocks = plan.rows.select("mix_source", "mix_cell").distinct()
    blocks = blocks.withColumn("block", F.row_number().over(Window.partitionBy("mix_source").orderBy(_block_order(seed))).cast("long"))
    rank = F.rank().over(Window.partitionBy("mix_source", "mix_cell").orderBy("mix_key")).cast("long")
    ranked = plan.rows.withColumn("rank", rank).join(blocks, ["mix_source", "mix_cell"])
    used = plan.with_sources(ranked).withColumn("uses", plan.uses()).where("uses > 0").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("uses"))).alias("pass"))
    return used.select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), "weight", "pass", "block", "rank")


def mix(docs: DataFrame, target: Target = Target(), budget: float | None = None, seed: int = 17) -> DataFrame:  # noqa: B008
    """docs with each row as often as the mixture uses it, all columns kept.

    A row's uses follow from its own key and its source's row of the plan, so texts aren't shuffled.
    """
    plan = mixing_plan(docs, target, budget, seed)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mix_row"), _source().alias("mix_source"), _key(seed).alias("mix_key"))
    placed = plan.with_sources(own).withColumn("mix_cell", F.pmod("mix_key", "blocks")).withColumn("mix_uses", plan.uses())
    used = placed.where("mix_uses > 0").select("mix_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_uses"))).alias("mix_pass"))
    return used.select(*(F.col("mix_row").getField(c).alias(c) for c in docs.columns))
