"""URL filter: rules first, then the ratio of two character language models.

A URL is judged by host and path. The longest rule that fits decides. For the rest, two Markov models
over characters, one of accepted and one of rejected URLs (as the rules tell them), give the mean
difference of log-likelihoods per character; it is accepted from a calibrated threshold on.

The models have variable order: the probability of a character after a context of ``n`` characters
is its count there plus ``BACK`` times its probability after the last ``n - 1``, over the count of the
context plus ``BACK``; below order 0 all 256 signs are alike. Counts, smoothing and scores are
joins and sums over distinct character strings of ``ORDER + 1`` characters, so each level is solved
once per string and not once per URL. Four fifths of the distinct URLs with a rule train (by
crc32), the last fifth calibrates: scores are counted by multiples of ``1 / STEPS``, and the threshold
lies midway between the lowest multiple with the best sum of accepted and rejected shares and the
one counted below it.

Everything is DataFrame expressions. Defined results: a null URL or one without ``://`` has an empty
host and path and no rule; an empty URL scores 0; without training URLs every score is 0, and
without URLs to calibrate with the threshold is 0; repeated rows are judged each but count once for
the models; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark_io import staged

ORDER, BACK, STEPS = 4, 4.0, 1000
#: Host, start of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, _PARTS, 1), _UPPER, _LOWER)
    return host, F.regexp_extract(text, _PARTS, 2)


def _ruled(value: int | None, rules=RULES) -> Column:
    """Verdict of the rule that fits (or, for None, its name), from columns ``host`` and ``path``."""
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(host + path if value is None else verdict)).otherwise(out)
    return out


def _strings(order: int) -> Column:
    """All strings of ``order + 1`` characters of a URL between its start and end signs."""
    signs = F.split(F.concat(F.lit("\u0002" * order), F.col("s"), F.lit("\u0003")), "")
    signs = F.filter(signs, lambda c: c != "")
    at = F.sequence(F.lit(1), F.char_length("s") + 1)
    return F.transform(at, lambda i: F.array_join(F.slice(signs, i, order + 1), ""))


def _log_ratios(counts: DataFrame, order: int) -> DataFrame:
    """``g`` and ``d``: log ratio of its last character's probabilities after the others."""
    levels = [counts]
    for n in range(order, 0, -1):
        levels.insert(
            0,
            levels[0].groupBy(F.expr(f"right(g, {n})").alias("g"))
            .agg(F.sum("a").alias("a"), F.sum("b").alias("b")),
        )
    below = None
    for n, level in enumerate(levels):
        context = level.groupBy(F.expr(f"left(g, {n})").alias("h")).agg(
            F.sum("a").alias("ha"), F.sum("b").alias("hb")
        )
        rows = level.withColumn("h", F.expr(f"left(g, {n})")).join(context, "h")
        if below is None:
            rows = rows.withColumns({"qa": F.lit(1 / 256), "qb": F.lit(1 / 256)})
        else:
            lower = below.select(F.col("g").alias("t"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
            rows = rows.withColumn("t", F.expr(f"right(g, {n})")).join(lower, "t")
        below = rows.select(
            "g",
            ((F.col("a") + BACK * F.col("qa")) / (F.col("ha") + BACK)).alias("pa"),
            ((F.col("b") + BACK * F.col("qb")) / (F.col("hb") + BACK)).alias("pb"),
        )
    return below.select("g", (F.log("pa") - F.log("pb")).alias("d"))


def _scores(urls: DataFrame, order: int) -> DataFrame:
    """Mean log ratio per character of every distinct URL."""
    # A URL becomes some thirty strings: deal the URLs over all cores before that, not after. With the
    # number of parts given, adaptive execution does not merge these small rows into one task again.
    spark = urls.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = urls.repartition(parts, "uid")
    grams = dealt.select("uid", "verdict", "trains", F.explode(_strings(order)).alias("g"))
    one = lambda v: F.sum(F.when(F.col("trains") & (F.col("verdict") == v), 1).otherwise(0))
    counts = staged(grams.groupBy("g").agg(one("allow").alias("a"), one("block").alias("b")), "grams")
    ratios = staged(_log_ratios(counts, order), "ratios")
    return grams.select("uid", "g").join(ratios, "g").groupBy("uid").agg(F.avg("d").alias("score"))


def _threshold(scored: DataFrame) -> float:
    bins = scored.filter("not trains and verdict is not null").groupBy(
        F.floor(F.col("score") * STEPS).cast("long").alias("bin")
    ).agg(
        F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("b"),
    )
    # As many rows as there are multiples of 1 / STEPS between two log-probabilities.
    bins = bins.withColumns(
        {"up": F.expr("sum(a) over (order by bin desc)"), "down": F.expr("coalesce(sum(b) over (order by bin rows between unbounded preceding and 1 preceding), 0)"),
         "na": F.expr("sum(a) over ()"), "nb": F.expr("sum(b) over ()"),
         "under": F.expr("coalesce(lag(bin) over (order by bin) + 1, bin)")}
    )
    best = bins.filter("na > 0 and nb > 0").orderBy((F.col("up") / F.col("na") + F.col("down") / F.col("nb")).desc(), "bin").first()
    return (best.bin + best.under) / 2 / STEPS if best else 0.0


def judge(pages: DataFrame, order: int = ORDER) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` (null where a rule decides)."""
    host, path = host_and_path()
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = staged(
        rows.select("host", "path").distinct()
        .select(
            F.concat("host", "path").alias("s"), _ruled(1).alias("verdict"), "host", "path",
            F.monotonically_increasing_id().alias("uid"),
        )
        .withColumn("trains", F.crc32("s") % 5 != 4),
        "urls",
    )
    scored = staged(urls.join(_scores(urls, order), "uid", "left"), "scored")
    bound = _threshold(scored)
    model = F.when(F.col("score") >= bound, "allow").otherwise("block")
    known = scored.select(
        F.col("host").alias("h2"), F.col("path").alias("p2"), "score",
        F.coalesce("verdict", model).alias("verdict"),
    )
    joined = rows.join(known, (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")))
    return joined.select(
        "page_id", "host", "path", _ruled(None).alias("rule"), "verdict",
        F.when(_ruled(1).isNull(), F.col("score")).alias("score"),
    )
