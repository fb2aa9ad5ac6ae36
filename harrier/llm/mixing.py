"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

Each source's share of all tokens is raised to an exponent; the exponent is found by bisection, so that the weights have
a wanted entropy or no source repeats more often than a limit. The weights times a budget of tokens say how often each
source is read. A source is cut into blocks by a hash; each reading (epoch) goes through the blocks in a permutation of
its own and through a block's documents in another; the last epoch ends where the source's budget does.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrier.llm.shared import Scratch, documents

#: Tokens of a block, about: what a sort within a source holds together.
BLOCK_TOKENS = 1 << 18
REPEATS = 2.0
#: So many sources are broadcast, and their token sums brought to the driver; more are joined and summed where they are.
SOURCES = 100_000
#: Blocks that one task puts in order, about.
BLOCKS_TOGETHER = 1000
SEED = 17


class Shares:
    """What the bisection needs to know of the sources' shares p: the least, the greatest, and for an exponent x the sums
    of p**x and of p**x ln p."""

    def __init__(self, least: float, greatest: float, moments: Callable[[float], tuple[float, float]]):
        self.least, self.greatest, self.moments = least, greatest, moments

    @classmethod
    def of(cls, shares: list[float]) -> Shares:
        some = sorted(p for p in shares if p > 0)
        return cls(some[0], some[-1], lambda x: (math.fsum(p**x for p in some), math.fsum(p**x * math.log(p) for p in some)))

    def entropy(self, x: float) -> float:
        z, s = self.moments(x)
        return math.log(z) - x * s / z

    def scale(self, x: float, budget: float | None) -> float:
        """A source of share p is read scale * p**(x - 1) times. budget: tokens wanted, as a multiple of all there are; None:
        as many as it takes for every source to be read at least once."""
        return budget / self.moments(x)[0] if budget is not None else self.greatest ** (1 - x)

    def most_repeats(self, x: float, budget: float | None) -> float:
        return self.scale(x, budget) * self.least ** (x - 1)


def temper(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raw = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raw.values())
    return {s: x / total for s, x in raw.items()} if total else raw


def entropy(weights: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in weights.values() if p > 0)


def repeats(shares: dict[str, float], weights: dict[str, float], budget: float | None) -> dict[str, float]:
    """How often each source is read under weights."""
    ratio = {s: weights[s] / p for s, p in shares.items() if p > 0}
    scale = budget if budget is not None else 1 / min(ratio.values())
    return {s: r * scale for s, r in ratio.items()}


def bisect_exponent(shares: Shares | dict[str, float], *, target_entropy: float | None = None, most_repeats: float | None = None, budget: float | None = None, steps: int = 60) -> float:
    """The exponent in [0, 1] whose weights have target_entropy, or the least one that reads no source more often than
    most_repeats. Entropy falls and the largest repetition shrinks as the exponent grows to 1. Out of reach: the nearer end."""

    if isinstance(shares, dict):
        shares = Shares.of(list(shares.values()))

    def flat_enough(x: float) -> bool:
        if target_entropy is not None:
            return shares.entropy(x) >= target_entropy
        return shares.most_repeats(x, budget) > most_repeats * (1 + 1e-12)

    lo, hi = 0.0, 1.0
    if not flat_enough(lo):
        return lo
    if flat_enough(hi):
        return hi
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if flat_enough(mid) else (lo, mid)
    return lo if target_entropy is not None else hi


def _shares(totals: DataFrame) -> tuple[int, float, Shares | None]:
    """(sources, tokens, shares) of token sums t by source. Up to SOURCES sums come to the driver; of more sources, each step
    of the bisection sums over the table."""
    n, whole = totals.agg(F.count("*").alias("n"), F.sum("t").alias("w")).first()
    if not n:
        return 0, 0.0, None
    if n <= SOURCES:
        return n, whole, Shares.of([r.t / whole for r in totals.select("t").collect()])
    p = F.col("t") / F.lit(whole)
    least, greatest = totals.agg(F.min(p), F.max(p)).first()
    return n, whole, Shares(least, greatest, lambda x: tuple(totals.agg(F.sum(F.pow(p, F.lit(x))), F.sum(F.pow(p, F.lit(x)) * F.log(p))).first()))


def _number(*parts) -> F.Column:
    """A number in [0, 2**32) from an md5, the same in any SQL engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def mix_sources(
    spark: SparkSession,
    docs: DataFrame,
    target_entropy: float | None = None,
    most_repeats: float | None = REPEATS,
    budget: float | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_tokens: int = BLOCK_TOKENS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per reading of a document: doc_id, source, n_tokens, epoch (from 0), block, position (64 bits that order
    an epoch of a source), start_token (tokens of the source read before), and the columns named in keep.

    Tokens are runs of [^\\x20\\x09-\\x0D]; a document counts at least one, so empty and null texts are read, too. A null
    source is a source of its own (null). Equal rows are separate documents. budget: tokens wanted, as a multiple of
    all there are; None: as many as it takes to read each source once or more. The last document of a source's budget is
    read whole; a very long document is one entry of its block. Where entries tie, the least id (none first), then the
    text's hash, comes first. An empty table gives an empty result; names in keep may clash with none of the result's own.
    """
    scratch = Scratch(spark, "mixing")
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n"))
    words = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    extra = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    # Equal ids of one source are told apart by a hash of the text, and equal rows by nothing: they are read together.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), name.alias("of"), words.cast("long").alias("n_tokens"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("mark"), *extra)
    # Written once: the words are counted and the texts hashed in one pass, and what is read again has no texts.
    rows = scratch.table(rows, "rows")
    totals = scratch.table(rows.groupBy("of").agg(F.sum("n_tokens").alias("t")), "totals")
    n, whole, shares = _shares(totals)
    exponent = bisect_exponent(shares, target_entropy=target_entropy, most_repeats=most_repeats, budget=budget) if shares else 1.0
    times = F.lit(shares.scale(exponent, budget) if shares else 1.0) * F.pow(F.col("t") / F.lit(float(whole or 1)), F.lit(exponent - 1))
    plan = totals.select("of", "t", F.floor(F.round(times * F.col("t"), 3) + 0.999).cast("long").alias("quota"), F.ceil(F.round(times, 9)).cast("int").alias("epochs"), F.greatest(F.lit(1), F.round(F.col("t") / block_tokens)).cast("long").alias("blocks"))
    planned = lambda df: df.join(F.broadcast(plan) if n <= SOURCES else plan, "of")

    own = planned(rows).withColumn("block", F.pmod(_number(F.lit(seed), "of", "mark", F.col("doc_id").cast("string")), F.col("blocks")))
    sizes = planned(own.groupBy("of", "block").agg(F.sum("n_tokens").alias("block_tokens")))
    turns = sizes.select("*", F.explode(F.sequence(F.lit(0), F.greatest(F.col("epochs"), F.lit(1)) - 1)).alias("epoch")).where("epochs > 0")
    turns = turns.withColumn("h", _number(F.lit(seed), F.lit("block"), "of", F.col("epoch").cast("string"), F.col("block").cast("string")))
    # A source may have any number of blocks. They are dealt by their place into spans; sums of whole spans come first, and
    # then those within a span, so no task orders all blocks of a source.
    turns = turns.withColumn("span", F.floor(F.col("h") * F.ceil(F.col("blocks") / BLOCKS_TOGETHER) / float(1 << 32)).cast("long"))
    spans = turns.groupBy("of", "epoch", "span").agg(F.sum("block_tokens").alias("tokens"), F.count("*").alias("n"))
    along = Window.partitionBy("of").orderBy("epoch", "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("of", "epoch", "span", F.coalesce(F.sum("tokens").over(along), F.lit(0)).alias("tokens_before"), F.coalesce(F.sum("n").over(along), F.lit(0)).alias("turns_before"))
    in_span = Window.partitionBy("of", "epoch", "span").orderBy("h", "block")
    turns = turns.join(spans, ["of", "epoch", "span"]).withColumn("before", F.col("tokens_before") + F.coalesce(F.sum("block_tokens").over(in_span.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("turn", F.col("turns_before") + F.row_number().over(in_span))
    turns = scratch.table(turns.where("before < quota").select("of", "block", "epoch", "before", "turn", "quota"), "turns")
    # Within a block, documents are in an order of their own; a block is small, so is each of these windows.
    read = own.drop("quota", "epochs", "blocks", "t").join(turns, ["of", "block"])
    order = _number(F.lit(seed), F.lit("doc"), "of", F.col("epoch").cast("string"), "mark", F.col("doc_id").cast("string"))
    read = read.withColumn("order", order)
    within = Window.partitionBy("of", "block", "epoch").orderBy("order", F.col("doc_id").asc_nulls_first(), "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = read.withColumn("start_token", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("start_token < quota")
    position = (F.col("turn").cast("long") * (1 << 32) + F.col("order")).alias("position")
    return placed.select("doc_id", "source", "n_tokens", "epoch", F.col("block").cast("int").alias("block"), position, "start_token", *(F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep) if c not in ("doc_id", "source", "n_tokens", "epoch", "block", "position", "start_token")))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark, documents(spark, sf_dir))
