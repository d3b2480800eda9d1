"""Secret scans by a trigram index: Boolean queries from the rules, then verification.

Each rule is a regular expression. From its parse come the trigrams every match must hold, as an OR
of ANDs over lower-cased text. The index has a posting (trigram, document) for the trigrams the rules
ask for; postings are intersected per document, and the documents a rule's query admits are verified
with the expression itself. A rule without mandatory trigrams, such as a run of hex digits, is
verified on every document.

Everything is DataFrame expressions. Positions come from the lengths of the pieces between matches,
summed in order within a document and rule. Documents are known by their id and a hash of their text,
so rows equal in both share their result.

Defined results: a null text is empty; a null id stays a row with a null id; positions count code
points, ends are exclusive; matches of one kind do not overlap; other columns are ignored.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spark_io import text_rows


class Rule(NamedTuple):
    kind: str
    pattern: str
    # Regular-expression group that must have so many characters, else the match is dropped.
    group: int = 0
    least: int = 1


#: The base kinds in the order in which they are listed.
BASE = (
    Rule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: Kinds with a form of their own, after the public descriptions of these tokens.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("pay", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE + MORE

Query = tuple[frozenset[str], ...]  # any of these sets of trigrams; an empty set admits everything
ANY: Query = (frozenset(),)
#: Most strings that alternatives are spelled out to.
SPELLED = 64


def _either(queries: list[Query]) -> Query:
    sets = {s for q in queries for s in q}
    return tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))


def _both(a: Query, b: Query) -> Query:
    return _either([(x | y,) for x in a for y in b])


def _of_strings(strings: set[str]) -> Query:
    return _either([(frozenset(s[i : i + 3] for i in range(len(s) - 2)),) for s in strings])


def _walk(nodes) -> tuple[set[str] | None, Query]:
    """The strings a sequence can be, if few, and the query of what its matches hold."""
    run, query, exact = {""}, ANY, True
    for kind, value in nodes:
        strings, inner = _node(kind, value)
        if strings is not None and len(run) * len(strings) <= SPELLED:
            run = {a + b for a in run for b in strings}
            continue
        query, exact = _both(query, _of_strings(run)), False
        if strings is not None:
            run = strings
        else:
            query, run = _both(query, inner), {""}
    query = _both(query, _of_strings(run))
    return (run if exact else None), query


def _node(kind, value) -> tuple[set[str] | None, Query]:
    if kind is op.LITERAL:
        return {chr(value).lower()}, ANY
    if kind is op.SUBPATTERN:
        return _walk(value[3])
    if kind is op.BRANCH:
        found = [_walk(x) for x in value[1]]
        if all(s is not None for s, _ in found):
            return set().union(*(s for s, _ in found)), ANY
        return None, _either([q for _, q in found])
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
        return {chr(v).lower() for _, v in value}, ANY
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        low, high, inner = value
        strings, query = _walk(inner)
        if low == 0 and high == 1 and strings is not None:
            return strings | {""}, ANY
        return None, (query if low else ANY)
    return None, ANY


def trigram_query(pattern: str) -> Query:
    """Sets of trigrams of which every lower-cased match holds at least one set whole."""
    return _walk(parser.parse(pattern))[1]


def index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings ``doc_id``, ``h``, ``trigram`` (its number) for the given trigrams."""
    low = docs.select("doc_id", "h", F.lower("text").alias("low"))
    held = F.filter(
        F.array(*(F.struct(F.lit(k).alias("k"), F.lit(t).alias("t")) for k, t in enumerate(trigrams))),
        lambda x: F.contains(F.col("low"), x["t"]),
    )
    return low.select("doc_id", "h", F.explode(held).alias("x")).select(
        "doc_id", "h", F.col("x.k").alias("trigram")
    )


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Documents that some rule's query admits, with one flag per rule with a query."""
    queries = [trigram_query(r.pattern) for r in rules]
    trigrams = sorted({t for q in queries for s in q for t in s})
    postings = index(docs, trigrams)
    # Intersection per document: the trigrams it has, as bits of a few longs.
    masks = [
        F.bit_or(
            F.when(F.col("trigram").between(p, p + 62), F.expr(f"shiftleft(1L, cast(trigram - {p} as int))"))
            .otherwise(F.lit(0).cast("long"))
        ).alias(f"m{p}")
        for p in range(0, max(len(trigrams), 1), 63)
    ]
    held = postings.groupBy("doc_id", "h").agg(*masks)

    def holds(s: frozenset[str]) -> Column:
        ok = F.lit(True)
        for p in range(0, len(trigrams), 63):
            want = sum(1 << k for k, t in enumerate(trigrams[p : p + 63]) if t in s)
            ok = ok & (F.col(f"m{p}").bitwiseAND(F.lit(want).cast("long")) == want)
        return ok

    flags = []
    for k, q in enumerate(queries):
        if q != ANY:
            any_ = F.lit(False)
            for s in q:
                any_ = any_ | holds(s)
            flags.append(any_.alias(f"r{k}"))
    return held.select("doc_id", "h", *flags).filter(
        F.greatest(F.lit(False), *(F.col(f"r{k}") for k, q in enumerate(queries) if q != ANY))
    )


def _told(k: int, rule: Rule, gaps: Column):
    """Describes a match by its rule, number, distance from the match before, and length."""
    def tell(x, i):
        held = F.char_length(F.regexp_extract(x, rule.pattern, rule.group))
        return F.struct(
            F.lit(k).alias("kind"), i.alias("i"), F.get(gaps, i).alias("gap"),
            F.char_length(x).alias("size"), (held >= rule.least).alias("ok"),
        )

    return tell


def spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id``, ``h``, ``kind`` (number of the rule), ``start`` and ``end`` of every secret."""
    docs = _keyed(docs)
    mine = docs.select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"), "text")
    admitted = candidates(docs, rules)
    joined = mine.join(
        admitted, F.col("id2").eqNullSafe(F.col("doc_id")) & (F.col("h2") == F.col("h")), "left"
    )
    found = []
    for k, rule in enumerate(rules):
        scan = F.lit(True) if trigram_query(rule.pattern) == ANY else F.coalesce(f"r{k}", F.lit(False))
        pattern = F.lit(rule.pattern)
        gaps = F.transform(F.split("text", rule.pattern, -1), F.char_length)
        hits = F.regexp_extract_all("text", pattern, F.lit(0))
        hit = F.transform(hits, _told(k, rule, gaps))
        found.append(F.when(scan & F.col("text").rlike(rule.pattern), hit))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
    rows = (
        joined.select(
            F.col("id2").alias("doc_id"), F.col("h2").alias("h"),
            F.explode(F.concat(*(F.coalesce(x, empty) for x in found))).alias("x"),
        )
        .select("doc_id", "h", "x.*").distinct()
    )
    order = Window.partitionBy("doc_id", "h", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order)).filter("ok")
        .select("doc_id", "h", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return text_rows(docs, F.col("doc_id").cast("long")).withColumn("h", F.xxhash64("text"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans of every document."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    told = lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])
    found = (
        spans(docs, rules).groupBy("doc_id", "h")
        .agg(
            *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])),
            listed.alias("x"),
        )
        .withColumn("base", F.array_join(F.transform(F.filter("x", lambda x: x["kind"] < base), told), ","))
        .withColumn("spans", F.array_join(F.transform("x", told), ","))
    )
    mine = _keyed(docs).select(F.col("doc_id").alias("id2"), F.col("h").alias("h2"))
    joined = mine.join(found, F.col("id2").eqNullSafe(F.col("doc_id")) & (F.col("h2") == F.col("h")), "left")
    return joined.select(
        F.col("id2").alias("doc_id"),
        *(F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules[:base]),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )


def oracle_sql(rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> str:
    """The same result as SQL without an index."""
    parts = []
    for k, r in enumerate(rules):
        rx = "'" + r.pattern.replace("'", "''") + "'"
        parts.append(
            f"SELECT doc_id, {k} AS kind, '{r.kind}' AS name, regexp_extract_all(t, {rx}) AS hits, "
            f"list_transform(string_split_regex(t, {rx}), lambda x: length(x)) AS gaps, "
            f"list_transform(regexp_extract_all(t, {rx}, {r.group}), lambda x: length(x) >= {r.least}) AS ok "
            f"FROM d WHERE regexp_matches(t, {rx})"
        )
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = {k}) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(rules[:base])
    )
    outer = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    m AS ({' UNION ALL '.join(parts)}),
    e AS (SELECT doc_id, kind, name, hits, gaps, ok, unnest(generate_series(1, len(hits))) AS i FROM m),
    s AS (SELECT doc_id, kind, name, ok[i] AS good, length(hits[i]) AS size, sum(gaps[i] + length(hits[i]))
      OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM e),
    g AS (SELECT doc_id, {counts},
      coalesce(string_agg(name || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ','
        ORDER BY stop - size, kind) FILTER (kind < {base}), '') AS base,
      string_agg(name || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT), ','
        ORDER BY stop - size, kind) AS spans FROM s WHERE good GROUP BY doc_id)
    SELECT d.doc_id, {outer}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""
