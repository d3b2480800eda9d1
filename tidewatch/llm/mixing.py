"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The share of a source in the tokens is raised to an exponent ``alpha`` and normalised: 1 keeps the
shares, 0 makes all sources alike. The exponent is bisected until the weights have a target entropy,
or as far down as no source is repeated more than a limit. A source's quota is its weight of the
budget. It is used up in epochs: whole epochs take all its documents; the last one takes whole
blocks in the order of a permutation, and of the block on the border documents in such an order,
as long as their tokens fit. Blocks are documents by a hash of their id and text; a source has as
many as the square root of its size over ``BLOCK_TOKENS``, so neither the list of its blocks nor one
block grows with the source as a whole, and no task ever orders a source's documents.

Everything is DataFrame expressions. Tokens are words ``[^\\x20\\x09-\\x0D]+``. Without a budget, it is
the smallest one that uses every document at least once, and the repetition limit is then the
number of epochs of the source repeated most.

Defined results: a null text has no tokens; documents without tokens go with their block; a null
source is a source; a source without tokens keeps its documents once; rows that repeat an id are
documents of their own; an empty table stays empty; other columns are kept whatever their names, in
``mix`` but for those in ``MIXED``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import staged

BLOCK_TOKENS, WORD = 1 << 12, r"[^\x20\x09-\x0D]+"
#: Exponents tried at once (six bisections) and the number of times.
GRID, ROUNDS = 64, 6
MIXED = ("n_tokens", "epoch", "block", "block_order", "doc_order")


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _grid(sources: DataFrame, low: float, high: float) -> list:
    """Entropy and repetition of the weights for exponents from ``low`` to ``high``."""
    step = (high - low) / GRID
    tried = sources.select("share", F.explode(F.sequence(F.lit(0), F.lit(GRID))).alias("k"))
    power = F.exp((F.lit(low) + F.col("k") * step) * F.log("share"))
    sums = tried.withColumn("w", power).groupBy("k").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("e"),
        F.max(F.col("w") / F.col("share")).alias("most"), F.min(F.col("w") / F.col("share")).alias("least"),
    )
    rows = sums.select("k", (F.log("z") - F.col("e") / F.col("z")).alias("entropy"), "z", "most", "least")
    return [(low + r.k * step, r) for r in sorted(rows.collect(), key=lambda r: r.k)]


def exponent(
    sources: DataFrame, *, entropy: float | None, max_repeats: float | None, per_token: float | None
) -> float:
    """The exponent; ``per_token`` is the budget over the tokens there are (None: all used once)."""

    def too_flat(r) -> bool:
        if entropy is not None:
            return r.entropy >= entropy
        return (r.most / r.least if per_token is None else r.most / r.z * per_token) > max_repeats

    low, high = 0.0, 8.0 if entropy is not None else 1.0
    for _ in range(ROUNDS):
        tried = _grid(sources, low, high)
        flat = [a for a, r in tried if too_flat(r)]
        if not flat:  # even the flattest weights are allowed, or no weights are flat enough
            return low
        if len(flat) == len(tried):
            return high
        low = max(flat)
        high = min(a for a, r in tried if a > low)
    return high


def mix(
    docs: DataFrame, *, entropy: float | None = None, max_repeats: float | None = None,
    budget: int | None = None, seed: int = 0,
) -> DataFrame:
    """Documents as often as their source's quota has them, with ``MIXED`` columns.

    Sorting by ``epoch``, ``block_order`` and ``doc_order`` gives the order of the mixture.
    """
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in MIXED]
    return _mixed(docs, entropy, max_repeats, budget, seed).select(*own, *MIXED)


def mixed_rows(
    docs: DataFrame, *, entropy: float | None = None, max_repeats: float | None = None,
    budget: int | None = None, seed: int = 0,
) -> DataFrame:
    """As ``mix``, with the columns of ``docs`` as they are, whatever their names, and no others."""
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return _mixed(docs, entropy, max_repeats, budget, seed).select(*own)


def _mixed(
    docs: DataFrame, entropy: float | None, max_repeats: float | None, budget: int | None, seed: int
) -> DataFrame:
    """``row``, a document as it came, and ``MIXED``."""
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give an entropy or a repetition limit")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source").cast("string").alias("of"),
        n_tokens().alias("n_tokens"),
        F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)),
                          F.md5(F.coalesce("text", F.lit(""))))).alias("doc_key"),
    )
    source = F.col("of")
    totals = staged(
        keyed.select(source.alias("src"), "n_tokens").groupBy("src").agg(F.sum("n_tokens").alias("tokens")),
        "sources",
    )
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    used = totals.filter("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(whole, 1))))
    alpha = exponent(
        used, entropy=entropy, max_repeats=max_repeats, per_token=None if budget is None else budget / max(whole, 1)
    ) if whole else 1.0
    weights = used.withColumn("w", F.exp(F.lit(alpha) * F.log("share")))
    z, least = weights.agg(F.sum("w"), F.min(F.col("w") / F.col("share"))).first()
    scale = 1.0 if not whole else whole / least if budget is None else budget / z
    quotas = totals.join(
        weights.select(F.col("src").alias("s2"), F.round(F.col("w") * scale).cast("long").alias("quota")),
        F.col("src").eqNullSafe(F.col("s2")), "left",
    ).select(
        "src", "tokens", F.coalesce("quota", "tokens").alias("quota"),
        F.greatest(F.lit(1), F.ceil(F.sqrt(F.col("tokens") / BLOCK_TOKENS))).cast("int").alias("n_blocks"),
    )
    quotas = staged(quotas, "quotas")
    # Which block: the first 32 bits of the key, over the source's number of blocks.
    number = F.conv(F.substring("doc_key", 1, 8), 16, 10).cast("long")
    placed = keyed.join(quotas, source.eqNullSafe(F.col("src"))).withColumn(
        "block", (number % F.col("n_blocks")).cast("int")
    )
    blocks = placed.groupBy("src", "block", "tokens", "quota").agg(F.sum("n_tokens").alias("size"))
    whole_epochs = F.when(F.col("tokens") > 0, F.floor(F.col("quota") / F.col("tokens"))).otherwise(1)
    rest = F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(0)
    plan = (
        blocks.withColumns({"full": whole_epochs.cast("int"), "rest": rest})
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full"))))
        .filter("epoch < full or rest > 0")
        .withColumn("block_order", F.md5(F.concat_ws("|", F.lit(str(seed)), "epoch", F.coalesce("src", F.lit("")), "block")))
        .withColumn("upto", F.expr("sum(size) over (partition by src, epoch order by block_order, block)"))
        .withColumn("left", F.when(F.col("epoch") < F.col("full"), F.col("size"))
                    .otherwise(F.col("rest") - F.col("upto") + F.col("size")))
        .filter("epoch < full or left > 0")
        .select(F.col("src").alias("s3"), F.col("block").alias("b3"), "epoch", "block_order", "left",
                ((F.col("epoch") < F.col("full")) | (F.col("left") >= F.col("size"))).alias("all_of_it"))
    )
    plan = staged(plan, "plan")
    taken = placed.join(
        plan, F.col("src").eqNullSafe(F.col("s3")) & (F.col("block") == F.col("b3"))
    ).withColumn("doc_order", F.md5(F.concat_ws("|", "doc_key", "epoch")))
    border = taken.filter("not all_of_it").withColumn(
        "run", F.expr("sum(n_tokens) over (partition by src, epoch, block order by doc_order rows unbounded preceding)")
    )
    columns = ["row", *MIXED]
    return taken.filter("all_of_it").select(*columns).unionByName(
        border.filter("run <= left").select(*columns)
    )
