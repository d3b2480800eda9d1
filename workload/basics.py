"""Single operators over the benchmark tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import functions as X
from tidewatch import operators as O
from tidewatch.functions import date_lit
from tidewatch.plans.extracts import AGE_LABELS, AGE_UPPER, city_rules
from tidewatch.sources import date_spine, dense_grid, off_stretch, spine_between

from .derived import AS_OF, SNAPSHOT_CUTOFF, START, days, extract, extract_sql, table
from .registry import full_window, half_even, query, running, spine_sql, sunday

ORDER_DAY = "CAST(o_orderdate AS DATE)"


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a plain date."""
    return table(spark, sf_dir, "orders").withColumn("day", F.col("o_orderdate").cast("date"))


# ---------------------------------------------------------------- spines


@query(
    f"""WITH b AS (SELECT min({ORDER_DAY}) lo, max({ORDER_DAY}) hi FROM orders)
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b"""
)
def spine_daily(spark, sf_dir):
    return spine_between(orders(spark, sf_dir), "day")


@query(
    f"""WITH b AS (SELECT min({sunday(ORDER_DAY)}) lo, max({ORDER_DAY}) hi FROM orders)
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 7 DAY)) AS DATE) AS week_of FROM b"""
)
def spine_weekly(spark, sf_dir):
    bounds = orders(spark, sf_dir).agg(
        F.min(X.week_floor("day")).alias("lo"), F.max("day").alias("hi")
    )
    both = bounds.select(F.explode(F.array("lo", "hi")).alias("d"))
    return spine_between(both, "d", "week", "week_of")


@query(
    f"""WITH b AS (SELECT CAST(date_trunc('month', min({ORDER_DAY})) AS DATE) lo,
    max({ORDER_DAY}) hi FROM orders)
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM b"""
)
def spine_monthly(spark, sf_dir):
    return spine_between(
        orders(spark, sf_dir).select(
            F.explode(F.array(X.month_floor("day"), F.col("day"))).alias("d")
        ),
        "d",
        "month",
        "month",
    )


#: A few orders get a year that is a thousand too high, as a typing error would.
MISTYPED = f"""SELECT o_orderkey AS id, o_totalprice AS amount, CASE WHEN o_orderkey % 97 = 1
    THEN CAST({ORDER_DAY} + INTERVAL 1000 YEAR AS DATE) ELSE {ORDER_DAY} END AS day FROM orders"""
MAIN_STRETCH = f"""d AS ({MISTYPED}),
    c AS (SELECT day, count(*) n, day - lag(day) OVER (ORDER BY day) gap FROM d
          WHERE day IS NOT NULL GROUP BY day),
    s AS (SELECT day, n, sum(CASE WHEN gap > 366 THEN 1 ELSE 0 END) OVER (ORDER BY day) k FROM c),
    b AS (SELECT min(day) lo, max(day) hi FROM s GROUP BY k ORDER BY sum(n) DESC, lo LIMIT 1)"""


def mistyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    far = F.col("o_orderkey") % 97 == 1
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"),
        F.col("o_totalprice").alias("amount"),
        F.when(far, F.add_months("day", 12000)).otherwise(F.col("day")).alias("day"),
    )


@query(
    f"""WITH {MAIN_STRETCH}
    SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM b"""
)
def spine_main_stretch(spark, sf_dir):
    return spine_between(mistyped(spark, sf_dir), "day", max_gap=366)


@query(f"WITH {MAIN_STRETCH} SELECT d.* FROM d, b WHERE d.day < b.lo OR d.day > b.hi")
def off_main_stretch(spark, sf_dir):
    return off_stretch(mistyped(spark, sf_dir), "day")


# ---------------------------------------------------------------- projections


@query(
    f"""SELECT o_orderkey AS id, o_totalprice AS amount, {ORDER_DAY} AS day,
    round(o_totalprice * 2, 2) AS doubled, round(o_totalprice * 2, 2) + 1 AS doubled_plus,
    'orders' AS origin FROM orders"""
)
def computed_columns(spark, sf_dir):
    return (
        orders(spark, sf_dir)
        .withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "amount"})
        .withColumn("doubled", F.round(F.col("amount") * 2, 2))
        .withColumn("doubled_plus", F.col("doubled") + 1)
        .withColumn("origin", F.lit("orders"))
        .select("id", "amount", "day", "doubled", "doubled_plus", "origin")
    )


@query(
    """SELECT c_custkey + 1 AS c_custkey, c_nationkey + 1 AS c_nationkey,
    c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer"""
)
def across_numeric(spark, sf_dir):
    return O.across_numeric(
        table(spark, sf_dir, "customer").drop("c_name"), lambda c: c + F.lit(1).cast("int")
    )


@query(
    f"""SELECT c_mktsegment, {half_even('count(*) FILTER (c_acctbal < 1000) * 100', 'count(*)', 2)}
    AS low_per, {half_even('count(*) FILTER (c_acctbal >= 5000) * 100', 'count(*)', 2)} AS high_per,
    count(*) AS n FROM customer GROUP BY c_mktsegment"""
)
def across_matching(spark, sf_dir):
    shares = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("c_acctbal") < 1000).alias("low_per"),
        F.count_if(F.col("c_acctbal") >= 5000).alias("high_per"),
    )
    return O.across_matching(shares, "PER", lambda c: X.safe_ratio(c, "n", scale=100, digits=2))


# ---------------------------------------------------------------- filters


@query(
    """SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders
    WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'"""
)
def filter_either(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.filter(
        (F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")
    ).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(
    f"""SELECT patient_record_number, breakthrough, age FROM ({extract_sql('cases')})
    WHERE breakthrough IN ('Yes', '') AND age <> '0-1'"""
)
def filter_membership(spark, sf_dir):
    return (
        extract(spark, sf_dir, "cases")
        .filter(F.col("breakthrough").isin("Yes", "") & (F.col("age") != "0-1"))
        .select("patient_record_number", "breakthrough", "age")
    )


@query(
    f"""SELECT o_orderkey, o_totalprice, {ORDER_DAY} AS day FROM orders
    WHERE o_totalprice BETWEEN 50000 AND 180000 AND o_orderdate >= DATE '1996-08-18'
    AND o_orderdate <= DATE '{AS_OF}'"""
)
def filter_ranges(spark, sf_dir):
    return orders(spark, sf_dir).filter(
        F.col("o_totalprice").between(50000, 180000)
        & (F.col("o_orderdate") >= date_lit("1996-08-18"))
        & (F.col("o_orderdate") <= date_lit(AS_OF))
    ).select("o_orderkey", "o_totalprice", "day")


@query(
    f"""SELECT o_orderkey, {ORDER_DAY} AS day FROM orders
    WHERE {ORDER_DAY} >= CAST(DATE '{AS_OF}' - INTERVAL 14 DAY AS DATE)"""
)
def trailing_days(spark, sf_dir):
    return O.trailing_days(
        table(spark, sf_dir, "orders"), "o_orderdate", AS_OF, 14
    ).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query(
    f"""SELECT o_orderkey, {ORDER_DAY} AS day FROM orders
    WHERE {ORDER_DAY} = (SELECT max({ORDER_DAY}) FROM orders)"""
)
def latest_rows(spark, sf_dir):
    return O.latest_rows(orders(spark, sf_dir), "day").select("o_orderkey", "day")


@query(
    f"""SELECT patient_record_number, place_name FROM ({extract_sql('linked')})
    WHERE coalesce(place_name, '') = ''"""
)
def blank_rows(spark, sf_dir):
    return extract(spark, sf_dir, "linked").filter(X.is_blank("place_name")).select(
        "patient_record_number", "place_name"
    )


@query(
    """SELECT count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 25 AND l_discount < 0.05)
    AS returned_large, count(*) FILTER (l_linestatus = 'O' AND l_tax > 0.04) AS open_taxed
    FROM lineitem"""
)
def compound_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(
        F.count_if(
            (F.col("l_returnflag") == "R")
            & (F.col("l_quantity") >= 25)
            & (F.col("l_discount") < 0.05)
        ).alias("returned_large"),
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.04)).alias("open_taxed"),
    )


@query(
    """SELECT p_partkey, p_name, p_brand, p_type FROM part
    WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'red')"""
)
def search_rows(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return O.search_rows(parts, "RED", ["p_name", "p_brand", "p_type"])


# ---------------------------------------------------------------- scalar expressions

_RAW_DATE = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN concat(CAST({0} AS {1}), ' 10:30:00') "
    "WHEN '2-HIGH' THEN '' WHEN '3-MEDIUM' THEN 'unknown' ELSE CAST({0} AS {1}) END"
)


@query(
    f"""SELECT o_orderkey, TRY_CAST({_RAW_DATE.format(ORDER_DAY, 'VARCHAR')} AS DATE) AS raw
    FROM orders"""
)
def parse_dates(spark, sf_dir):
    raw = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", f"{_RAW_DATE.format(ORDER_DAY, 'STRING')} AS raw"
    )
    return O.parse_dates(raw, ["raw"])


@query(
    f"""SELECT {sunday(ORDER_DAY)} AS week_of, CAST(date_trunc('week', {ORDER_DAY}) AS DATE)
    AS monday, count(*) AS n FROM orders GROUP BY 1, 2"""
)
def week_floor(spark, sf_dir):
    return (
        orders(spark, sf_dir)
        .groupBy(X.week_floor("day").alias("week_of"), X.week_floor("day", 1).alias("monday"))
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""SELECT CAST(date_trunc('month', {ORDER_DAY}) AS DATE) AS month, count(*) AS n
    FROM orders GROUP BY 1"""
)
def month_floor(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(X.month_floor("day").alias("month")).agg(
        F.count("*").alias("n")
    )


@query(
    f"""WITH w AS (SELECT CAST({sunday(ORDER_DAY)} + INTERVAL 3 DAY AS DATE) AS wed FROM orders)
    SELECT CAST(year(wed) AS INTEGER) AS epi_year,
    CAST((dayofyear(wed) - 1) // 7 + 1 AS INTEGER) AS epi_week, count(*) AS n
    FROM w GROUP BY 1, 2"""
)
def epi_week(spark, sf_dir):
    return (
        orders(spark, sf_dir)
        .groupBy(X.epi_year("day").alias("epi_year"), X.epi_week("day").alias("epi_week"))
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""SELECT o_orderkey, {days('o_orderdate', 10)} AS recovered, {days('o_orderdate', -2)}
    AS infectious, CAST(datediff('day', {ORDER_DAY}, DATE '{AS_OF}') AS INTEGER) AS age_days
    FROM orders"""
)
def date_arithmetic(spark, sf_dir):
    return orders(spark, sf_dir).select(
        "o_orderkey",
        F.date_add("day", 10).alias("recovered"),
        F.date_sub("day", 2).alias("infectious"),
        X.days_between(date_lit(AS_OF), "day").alias("age_days"),
    )


_AGE = "CASE WHEN p_size > 45 THEN NULL ELSE p_size * 3 - 5 END"
_AGE_CASE = " ".join(
    f"WHEN age < {u} THEN '{label}'" for u, label in zip(AGE_UPPER, AGE_LABELS)
)


@query(
    f"""SELECT CASE {_AGE_CASE} ELSE 'Unknown' END AS band, count(*) AS n
    FROM (SELECT {_AGE} AS age FROM part) GROUP BY 1"""
)
def bucket_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr(f"{_AGE} AS age")
    return parts.groupBy(X.bucketize("age", AGE_UPPER, AGE_LABELS).alias("band")).agg(
        F.count("*").alias("n")
    )


@query(
    """SELECT c_custkey, c_nationkey, coalesce(n_name, 'elsewhere') AS nation FROM customer
    LEFT JOIN nation ON c_nationkey = CASE n_regionkey WHEN 2 THEN -1 - n_nationkey
    ELSE n_nationkey END"""
)
def map_codes(spark, sf_dir):
    listed = table(spark, sf_dir, "nation").withColumn(
        "n_nationkey", F.expr("IF(n_regionkey = 2, -1 - n_nationkey, n_nationkey)")
    )
    return O.map_codes(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        "c_nationkey",
        listed,
        "n_nationkey",
        "n_name",
        "nation",
        default="elsewhere",
    )


@query(
    f"""SELECT patient_record_number, CASE WHEN breakthrough = 'Yes' OR reinfection = 'Yes'
    OR hosp = 'Yes' THEN 1 ELSE 0 END AS any_flag, CASE WHEN breakthrough IN ('Yes', 'No')
    THEN breakthrough ELSE 'Unknown' END AS answer FROM ({extract_sql('cases')})"""
)
def flags(spark, sf_dir):
    return extract(spark, sf_dir, "cases").select(
        "patient_record_number",
        X.flag_any(
            F.col("breakthrough") == "Yes", F.col("reinfection") == "Yes", F.col("hosp") == "Yes"
        ).alias("any_flag"),
        X.yes_no_unknown("breakthrough").alias("answer"),
    )


@query(
    f"""SELECT CASE WHEN zipcode IN (84322, 84323) THEN 84321 ELSE zipcode END AS zipcode_map,
    CASE WHEN ethnicity = 'Hispanic or Latino' THEN 'Hispanic or Latino' ELSE race END AS race_eth,
    count(*) AS n FROM ({extract_sql('doses')}) GROUP BY 1, 2"""
)
def override_and_dominant(spark, sf_dir):
    return (
        extract(spark, sf_dir, "doses")
        .groupBy(
            X.override_if_in("zipcode", (84322, 84323), 84321).alias("zipcode_map"),
            X.dominant_category("ethnicity", "Hispanic or Latino", "race").alias("race_eth"),
        )
        .agg(F.count("*").alias("n"))
    )


_PART_RULES = [("^red|blue$", "primary"), ("hot|cold", "thermal"), ("ring", "ring")]


@query(
    """SELECT CASE WHEN regexp_matches(p_name, '^red|blue$') THEN 'primary'
    WHEN regexp_matches(p_name, 'hot|cold') THEN 'thermal'
    WHEN contains(p_name, 'ring') THEN 'ring' ELSE p_name END AS kind, count(*) AS n
    FROM part GROUP BY 1"""
)
def normalize_text(spark, sf_dir):
    return (
        table(spark, sf_dir, "part")
        .groupBy(X.normalize_text("p_name", _PART_RULES).alias("kind"))
        .agg(F.count("*").alias("n"))
    )


@query(
    f"""WITH raw AS (SELECT address_at_diagnosis_city AS c FROM ({extract_sql('investigations')}))
    SELECT CASE {' '.join(f"WHEN regexp_matches(c, '{p}') THEN '{v}'" for p, v in city_rules())}
    ELSE c END AS city, count(*) AS n FROM raw GROUP BY 1"""
)
def normalize_city(spark, sf_dir):
    return (
        extract(spark, sf_dir, "investigations")
        .groupBy(X.normalize_text("address_at_diagnosis_city", city_rules()).alias("city"))
        .agg(F.count("*").alias("n"))
    )


@query(
    """WITH alias AS (SELECT concat(n_name, ' School') AS alias, n_name AS name, r_name AS grp
    FROM (SELECT CASE r_name WHEN 'ASIA' THEN concat('Old ', n_name) ELSE n_name END AS n_name, r_name
    FROM nation JOIN region ON n_regionkey = r_regionkey)),
    raw AS (SELECT CASE o_orderstatus WHEN 'F' THEN concat(n_name, ' School') ELSE n_name END
    AS place FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey)
    SELECT coalesce(a.name, place) AS school, g.grp AS region, count(*) AS n FROM raw
    LEFT JOIN alias a ON place = a.alias LEFT JOIN alias g ON coalesce(a.name, place) = g.name
    GROUP BY 1, 2"""
)
def alias_canonicalize(spark, sf_dir):
    dim = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .withColumn("n_name", F.expr("IF(r_name = 'ASIA', concat('Old ', n_name), n_name)"))
        .selectExpr("concat(n_name, ' School') AS alias", "n_name AS name", "r_name AS grp")
    )
    raw = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "CASE o_orderstatus WHEN 'F' THEN concat(n_name, ' School') ELSE n_name END AS place"
        )
    )
    named = O.canonicalize(raw, "place", dim, "alias", "name", "school")
    return (
        O.map_codes(named, "school", dim, "name", "grp", "region")
        .groupBy("school", "region")
        .agg(F.count("*").alias("n"))
    )


@query(
    """WITH raw AS (SELECT CASE o_orderstatus WHEN 'F' THEN concat(n_name, ' School') ELSE n_name
    END AS place FROM orders JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey)
    SELECT place, count(*) AS rows FROM raw WHERE place NOT IN
    (SELECT concat(n_name, ' School') FROM nation) GROUP BY place"""
)
def unmapped(spark, sf_dir):
    raw = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .selectExpr(
            "CASE o_orderstatus WHEN 'F' THEN concat(n_name, ' School') ELSE n_name END AS place"
        )
    )
    dim = table(spark, sf_dir, "nation").selectExpr("concat(n_name, ' School') AS alias")
    return O.unmapped(raw, "place", dim, "alias")


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, '')
    AS segment, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END, 0) AS nationkey
    FROM customer"""
)
def fill_missing(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment",
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS nationkey",
    )
    return O.fill_zero(O.fill_blank(raw))


@query(
    f"""SELECT p_size, {half_even('p_size', '4', 1)} AS quarter, {half_even('p_size', '8', 2)}
    AS eighth, CAST(trunc(p_size / 8.0) AS INTEGER) AS whole, CAST(p_size AS VARCHAR) AS as_text,
    count(*) AS n FROM part GROUP BY p_size"""
)
def rounding(spark, sf_dir):
    size = F.col("p_size")
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_size")
        .agg(F.count("*").alias("n"))
        .select(
            "p_size",
            X.round_half_even(size / 4, 1).alias("quarter"),
            X.round_half_even(size / 8, 2).alias("eighth"),
            X.int_trunc(size / 8).alias("whole"),
            size.cast("string").alias("as_text"),
            "n",
        )
    )


@query(
    f"""SELECT {ORDER_DAY} AS day, count(*) FILTER (o_orderstatus = 'F') AS f,
    count(*) FILTER (o_orderstatus = 'O') AS o, {half_even("count(*) FILTER (o_orderstatus = 'F')",
    "count(*) FILTER (o_orderstatus = 'O')", 2)} AS f_per_o,
    coalesce(count(*) FILTER (o_orderstatus = 'F') / NULLIF(CAST(
    count(*) FILTER (o_orderstatus = 'O') AS DOUBLE), 0), 0) AS filled,
    count(*) - count(*) FILTER (o_orderstatus = 'F') AS rest FROM orders GROUP BY 1"""
)
def safe_ratio(spark, sf_dir):
    counts = O.count_where(
        orders(spark, sf_dir),
        "day",
        f=F.col("o_orderstatus") == "F",
        o=F.col("o_orderstatus") == "O",
        total=F.lit(True),
    )
    return counts.select(
        "day",
        "f",
        "o",
        X.safe_ratio("f", "o", digits=2).alias("f_per_o"),
        X.safe_ratio("f", "o", fill=0).alias("filled"),
        (F.col("total") - F.col("f")).alias("rest"),
    )


@query(
    f"""WITH p AS (SELECT c_nationkey, count(*) AS population FROM customer GROUP BY 1),
    n AS (SELECT c_nationkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
    GROUP BY 1) SELECT n.c_nationkey, orders, population,
    {half_even('orders * 100000', 'population', 2)} AS per_100k,
    {half_even('orders * 1000', 'population', 2)} AS per_1000
    FROM n JOIN p ON n.c_nationkey = p.c_nationkey"""
)
def rate_per_capita(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    people = customer.groupBy("c_nationkey").agg(F.count("*").alias("population"))
    counts = (
        table(spark, sf_dir, "orders")
        .join(customer, F.expr("o_custkey = c_custkey"))
        .groupBy("c_nationkey")
        .agg(F.count("*").alias("orders"))
    )
    return O.with_population(counts, people, "c_nationkey").withColumns(
        {
            "per_100k": X.rate("orders", "population"),
            "per_1000": X.rate("orders", "population", per=1000),
        }
    )


@query(
    """SELECT DISTINCT n_name, concat_ws(' ', 'Orders of', n_name) AS title
    FROM customer JOIN nation ON c_nationkey = n_nationkey"""
)
def series_title(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .select("n_name", X.series_title("Orders of", "n_name").alias("title"))
        .distinct()
    )


# ---------------------------------------------------------------- joins


@query(
    f"""WITH s AS ({spine_sql(START, AS_OF)}), c AS (SELECT {ORDER_DAY} AS date,
    count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders GROUP BY 1)
    SELECT s.date, coalesce(f, 0) AS f, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.date = c.date"""
)
def fill_spine(spark, sf_dir):
    counts = O.count_where(
        orders(spark, sf_dir).withColumnRenamed("day", "date"),
        "date",
        f=F.col("o_orderstatus") == "F",
        n=F.lit(True),
    )
    return O.fill_spine(date_spine(spark, START, AS_OF), counts, "date")


@query(
    f"""SELECT {ORDER_DAY} AS date, count(*) AS dropped FROM orders
    WHERE o_orderdate < DATE '1996-01-01' OR o_orderdate > DATE '2000-12-31' GROUP BY 1"""
)
def dropped_events(spark, sf_dir):
    return O.dropped_events(
        orders(spark, sf_dir).select(F.col("day").alias("date")),
        date_spine(spark, "1996-01-01", "2000-12-31"),
        "date",
    )


# Every order, on a calendar stretched so that two days of three have none.
_STRETCHED = f"CAST(DATE '{START}' + CAST(3 * ({ORDER_DAY} - DATE '{START}') AS INTEGER) AS DATE)"


@query(
    f"""WITH c AS (SELECT {_STRETCHED} AS day, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT min(day) lo, max(day) hi FROM c),
    s AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM b)
    SELECT s.day, coalesce(n, 0) AS n FROM s LEFT JOIN c ON s.day = c.day"""
)
def fill_gaps(spark, sf_dir):
    stretched = F.date_add(date_lit(START), 3 * F.datediff("day", date_lit(START)))
    counts = (
        orders(spark, sf_dir).withColumn("day", stretched).groupBy("day")
        .agg(F.count("*").alias("n"))
    )
    return O.fill_gaps(counts, "day", "day")


@query(
    f"""SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS dropped FROM lineitem
    WHERE l_shipdate < DATE '{START}' OR CAST(l_shipdate AS DATE) > DATE '{AS_OF}' GROUP BY 1"""
)
def dropped_lines(spark, sf_dir):
    """Lines that the line-item panels leave out because they lie outside the calendar."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return O.dropped_events(lines, date_spine(spark, START, AS_OF), "date")


_GRID_SQL = f"""g AS (SELECT n_name AS nation, s.date FROM nation, ({spine_sql(START, AS_OF)}) s),
    c AS (SELECT n_name AS nation, {ORDER_DAY} AS date, count(*) AS n FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    p AS (SELECT g.nation, g.date, coalesce(n, 0) AS n FROM g LEFT JOIN c
    ON g.nation = c.nation AND g.date = c.date)"""


def nation_events(spark, sf_dir):
    return (
        orders(spark, sf_dir)
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .select(F.col("n_name").alias("nation"), F.col("day").alias("date"), "o_orderkey")
    )


def nation_grid(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("nation"))
    return dense_grid(names, START, AS_OF)


def nation_daily(spark, sf_dir):
    return O.spine_counts(
        nation_events(spark, sf_dir),
        nation_grid(spark, sf_dir),
        ["date", "nation"],
        {"n": F.lit(1)},
    )


@query(f"WITH {_GRID_SQL} SELECT nation, date, n FROM p")
def dense_grid_panel(spark, sf_dir):
    return nation_daily(spark, sf_dir)


@query(
    """WITH c AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END AS id,
    c_mktsegment FROM customer), o AS (SELECT CASE WHEN o_totalprice > 100000 THEN o_custkey
    WHEN o_totalprice > 90000 THEN NULL ELSE o_custkey + 100000000 END AS id, o_orderkey FROM orders)
    SELECT coalesce(c.id, o.id) AS id, c_mktsegment, o_orderkey FROM c FULL JOIN o ON c.id = o.id"""
)
def link_records(spark, sf_dir):
    """All customers and orders; some ids have no partner and some are missing."""
    people = table(spark, sf_dir, "customer").select(
        F.expr("IF(c_acctbal > 0, c_custkey, -c_custkey)").alias("id"), "c_mktsegment"
    )
    bought = table(spark, sf_dir, "orders").select(
        F.expr(
            "CASE WHEN o_totalprice > 100000 THEN o_custkey WHEN o_totalprice > 90000 THEN NULL "
            "ELSE o_custkey + 100000000 END"
        ).alias("id"),
        "o_orderkey",
    )
    return O.link_records(people, bought, "id")


# ---------------------------------------------------------------- aggregations


@query(f"SELECT {ORDER_DAY} AS day, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def group_count(spark, sf_dir):
    return orders(spark, sf_dir).groupBy("day", "o_orderstatus").agg(F.count("*").alias("n"))


@query(
    """SELECT l_linestatus, count(*) FILTER (l_returnflag = 'R') AS returned,
    count(*) FILTER (l_returnflag = 'A' AND l_quantity > 25) AS accepted_large
    FROM lineitem GROUP BY 1"""
)
def count_where(spark, sf_dir):
    return O.count_where(
        table(spark, sf_dir, "lineitem"),
        "l_linestatus",
        returned=F.col("l_returnflag") == "R",
        accepted_large=(F.col("l_returnflag") == "A") & (F.col("l_quantity") > 25),
    )


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD")


@query(
    "SELECT c_nationkey, "
    + ", ".join(f"count(*) FILTER (c_mktsegment = '{s}') AS \"{s}\"" for s in _SEGMENTS)
    + " FROM customer GROUP BY 1"
)
def pivot_counts(spark, sf_dir):
    return O.pivot_counts(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", _SEGMENTS)


@query(
    f"""WITH x AS (SELECT {ORDER_DAY} AS day, r_name AS region, o_orderstatus FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)
    SELECT day, region, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS f FROM x
    GROUP BY 1, 2 UNION ALL SELECT day, 'ALL', count(*), count(*) FILTER (o_orderstatus = 'F')
    FROM x GROUP BY 1"""
)
def with_total(spark, sf_dir):
    rows = (
        orders(spark, sf_dir)
        .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey"))
        .groupBy("day", F.col("r_name").alias("region"))
        .agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    )
    return O.with_total(rows, "day", "region", "ALL", n=F.col("n"), f=F.col("f"))


@query(
    """SELECT segment, count(*) AS n FROM (SELECT CASE WHEN c_acctbal < 0 THEN NULL
    ELSE c_mktsegment END AS segment FROM customer) WHERE segment IS NOT NULL GROUP BY 1"""
)
def freq_table(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr(
        "CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS segment"
    )
    return O.freq(raw, "segment")


@query(
    f"""SELECT o_orderstatus, min({ORDER_DAY}) AS first_day, max({ORDER_DAY}) AS last_day,
    max(o_totalprice) AS top FROM orders GROUP BY 1"""
)
def date_bounds(spark, sf_dir):
    return (
        orders(spark, sf_dir)
        .groupBy("o_orderstatus")
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.max("o_totalprice").alias("top"),
        )
    )


@query(
    f"WITH {_GRID_SQL}, t AS (SELECT nation, date, n, {running('n', 'date', 'nation')} AS total "
    "FROM p) SELECT nation, n, total FROM t WHERE date = DATE '" + AS_OF + "'"
)
def latest_values(spark, sf_dir):
    panel = O.cumulative(nation_daily(spark, sf_dir), {"n": "total"}, "date", "nation")
    return O.latest(panel, "date", ["n", "total"], "nation")


@query(
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey) AS rn
    FROM lineitem) WHERE rn = 1"""
)
def distinct_on(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    best = O.distinct_on(lines, "l_orderkey", [F.desc("l_extendedprice"), "l_partkey", "l_suppkey"])
    return best.drop("l_suppkey")


# ---------------------------------------------------------------- windows


@query(
    f"""WITH s AS ({spine_sql(START, AS_OF)}), c AS (SELECT {ORDER_DAY} AS date, count(*) AS n
    FROM orders GROUP BY 1), p AS (SELECT s.date, coalesce(n, 0) AS n FROM s
    LEFT JOIN c ON s.date = c.date)
    SELECT date, n, {running('n', 'date')} AS total FROM p"""
)
def cumulative_panel(spark, sf_dir):
    panel = O.spine_counts(
        orders(spark, sf_dir).withColumnRenamed("day", "date"),
        date_spine(spark, START, AS_OF),
        "date",
        {"n": F.lit(1)},
    )
    return O.cumulative(panel, {"n": "total"}, "date")


@query(f"WITH {_GRID_SQL} SELECT nation, date, {running('n', 'date', 'nation')} AS total FROM p")
def cumulative_by_entity(spark, sf_dir):
    panel = O.cumulative(nation_daily(spark, sf_dir), {"n": "total"}, "date", "nation")
    return panel.drop("n")


@query(
    f"""WITH s AS ({spine_sql(START, AS_OF)}), c AS (SELECT {ORDER_DAY} AS date,
    count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o
    FROM orders GROUP BY 1), p AS (SELECT s.date, coalesce(f, 0) AS f, coalesce(o, 0) AS o
    FROM s LEFT JOIN c ON s.date = c.date)
    SELECT date, {running('f', 'date')} AS f, {running('o', 'date')} AS o FROM p"""
)
def cumulative_all(spark, sf_dir):
    panel = O.spine_counts(
        orders(spark, sf_dir).withColumnRenamed("day", "date"),
        date_spine(spark, START, AS_OF),
        "date",
        {"f": F.col("o_orderstatus") == "F", "o": F.col("o_orderstatus") == "O"},
    )
    return O.cumulative_all(panel, "date")


@query(
    f"WITH {_GRID_SQL}, w AS (SELECT nation, date, n, "
    f"{full_window('sum', 'n', 7, 'date', 'nation')} AS s FROM p) "
    f"SELECT nation, date, {half_even('s', '7', 1)} AS mean_7d, CAST(s AS BIGINT) AS sum_7d FROM w"
)
def trailing_mean_and_sum(spark, sf_dir):
    panel = O.trailing_mean(nation_daily(spark, sf_dir), {"n": "mean_7d"}, 7, "date", "nation")
    return O.trailing_sum(panel, {"n": "sum_7d"}, 7, "date", "nation").drop("n")


@query(
    f"WITH {_GRID_SQL}, w AS (SELECT nation, date, {full_window('sum', 'n', 5, 'date', 'nation')} "
    "AS s FROM p), l AS (SELECT nation, date, s, lag(s, 5) OVER (PARTITION BY nation ORDER BY date) "
    f"AS earlier FROM w) SELECT nation, date, CAST(s AS BIGINT) AS sum_5d, "
    f"{half_even('s', 'earlier', 2)} AS growth, 1 - {half_even('s', 'earlier', 2)} AS decrease FROM l"
)
def growth_ratio(spark, sf_dir):
    panel = O.trailing_sum(nation_daily(spark, sf_dir), {"n": "sum_5d"}, 5, "date", "nation")
    return O.lag_ratio(panel, "sum_5d", 5, "date", "nation", ratio="growth").drop("n")


def _open_sql(k: int) -> str:
    back = f"{running('n', 'date', 'nation')}"
    return (
        f"WITH {_GRID_SQL}, t AS (SELECT nation, date, CAST(n AS BIGINT) AS entered, {back} "
        "AS entered_total FROM p), o AS (SELECT *, CAST(coalesce(lag(entered_total, "
        f"{k}) OVER (PARTITION BY nation ORDER BY date), 0) AS BIGINT) AS left_total FROM t) "
        'SELECT nation, date, entered, entered_total, left_total, '
        'entered_total - left_total AS "open" FROM o'
    )


@query(_open_sql(7))
def open_count_7(spark, sf_dir):
    return O.open_count(
        nation_events(spark, sf_dir), nation_grid(spark, sf_dir), "date", 7, "nation"
    )


@query(_open_sql(10))
def open_count_10(spark, sf_dir):
    return O.open_count(
        nation_events(spark, sf_dir), nation_grid(spark, sf_dir), "date", 10, "nation"
    )


@query(
    f"""WITH s AS ({spine_sql('1998-01-01', AS_OF)}), e AS (SELECT {ORDER_DAY} AS d FROM orders),
    i AS (SELECT d, count(*) AS n FROM e GROUP BY 1),
    x AS (SELECT CAST(d + INTERVAL 10 DAY AS DATE) AS d, count(*) AS n FROM e GROUP BY 1),
    p AS (SELECT s.date, coalesce(i.n, 0) AS entered, coalesce(x.n, 0) AS gone FROM s
    LEFT JOIN i ON s.date = i.d LEFT JOIN x ON s.date = x.d)
    SELECT date, entered, {running('entered', 'date')} AS entered_total,
    {running('gone', 'date')} AS left_total,
    {running('entered', 'date')} - {running('gone', 'date')} AS "open" FROM p"""
)
def open_count_literal(spark, sf_dir):
    return O.open_count(
        orders(spark, sf_dir),
        date_spine(spark, "1998-01-01", AS_OF),
        "day",
        10,
        literal=True,
    )


@query(
    """SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
    ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2
    ELSE 3 END, event_id) AS rn FROM events) WHERE rn = 1"""
)
def priority_dedupe(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    return O.dedupe_by_priority(
        events, "user_id", "event_type", ["purchase", "signup", "click"], ["event_id"]
    )


@query(
    """SELECT l_orderkey, l_partkey, l_extendedprice FROM lineitem WHERE l_orderkey IN
    (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 1)"""
)
def unique_only(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    return O.unique_only(lines, "l_orderkey")


@query(
    f"""WITH s AS ({spine_sql(START, AS_OF, '7 DAY', 'week_of')}), c AS (SELECT
    {sunday(ORDER_DAY)} AS week_of, count(*) AS n FROM orders GROUP BY 1)
    SELECT s.week_of, coalesce(n, 0) AS n,
    s.week_of >= CAST(DATE '{AS_OF}' - INTERVAL 14 DAY AS DATE) AS provisional
    FROM s LEFT JOIN c ON s.week_of = c.week_of"""
)
def provisional_flag(spark, sf_dir):
    panel = O.spine_counts(
        orders(spark, sf_dir).select(X.week_floor("day").alias("week_of")),
        date_spine(spark, START, AS_OF, "week", "week_of"),
        "week_of",
        {"n": F.lit(1)},
    )
    return O.flag_provisional(panel, "week_of", dt.date.fromisoformat(AS_OF), 14)


# ---------------------------------------------------------------- sorting and set operations


@query(
    """SELECT o_orderkey, o_orderpriority, CASE o_orderpriority WHEN '3-MEDIUM' THEN 0
    WHEN '1-URGENT' THEN 1 ELSE 2 END AS position FROM orders ORDER BY position, o_orderkey"""
)
def priority_sort(spark, sf_dir):
    place = X.first_match(
        [(F.col("o_orderpriority") == "3-MEDIUM", 0), (F.col("o_orderpriority") == "1-URGENT", 1)],
        2,
    )
    return (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_orderpriority", place.alias("position"))
        .orderBy("position", "o_orderkey")
    )


@query(
    """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1
    ORDER BY n DESC, top DESC, o_custkey DESC LIMIT 20"""
)
def top_sorted(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.max("o_totalprice").alias("top")
    )
    return O.sort_desc(per, ["n", "top", "o_custkey"], limit=20)


@query(
    """SELECT c_custkey AS id, c_nationkey AS nation, c_mktsegment AS segment, NULL AS balance
    FROM customer UNION ALL SELECT s_suppkey, s_nationkey, NULL, s_acctbal FROM supplier"""
)
def union_missing(spark, sf_dir):
    people = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS id", "c_nationkey AS nation", "c_mktsegment AS segment"
    )
    firms = table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS id", "s_nationkey AS nation", "s_acctbal AS balance"
    )
    return people.unionByName(firms, allowMissingColumns=True)


# ---------------------------------------------------------------- snapshots

_COLS = "o_orderkey, o_custkey, {} AS o_orderstatus, o_totalprice"
CURRENT_SQL = f"SELECT {_COLS.format('o_orderstatus')} FROM orders WHERE o_totalprice >= 20000"
PREVIOUS_SQL = (
    "SELECT "
    + _COLS.format("CASE o_orderpriority WHEN '1-URGENT' THEN 'X' ELSE o_orderstatus END")
    + f" FROM orders WHERE o_orderdate < DATE '{SNAPSHOT_CUTOFF}'"
)


def snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    current = o.filter("o_totalprice >= 20000").selectExpr(
        *_COLS.format("o_orderstatus").split(", ")
    )
    previous = o.filter(F.col("o_orderdate") < date_lit(SNAPSHOT_CUTOFF)).selectExpr(
        *_COLS.format(
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'X' ELSE o_orderstatus END"
        ).split(", ")
    )
    return current, previous


_SNAPS = f"WITH c AS ({CURRENT_SQL}), p AS ({PREVIOUS_SQL})"


@query(f"{_SNAPS} SELECT * FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)")
def new_records(spark, sf_dir):
    return O.new_records(*snapshots(spark, sf_dir), "o_orderkey")


@query(
    f"""{_SNAPS}, u AS (SELECT * FROM c UNION SELECT * FROM p)
    SELECT * FROM u WHERE o_orderkey IN (SELECT o_orderkey FROM u GROUP BY 1 HAVING count(*) = 1)"""
)
def symmetric_delta(spark, sf_dir):
    return O.symmetric_delta(*snapshots(spark, sf_dir), "o_orderkey")


@query(
    f"""{_SNAPS}, u AS (SELECT * FROM c UNION ALL SELECT * FROM p)
    SELECT * FROM u WHERE o_orderkey IN (SELECT o_orderkey FROM u GROUP BY 1 HAVING count(*) = 1)"""
)
def once_only(spark, sf_dir):
    return O.once_only(*snapshots(spark, sf_dir), "o_orderkey")


@query(
    f"""{_SNAPS} SELECT coalesce(c.o_orderkey, p.o_orderkey) AS o_orderkey,
    CASE WHEN p.o_orderkey IS NULL THEN 'new' WHEN c.o_orderkey IS NULL THEN 'removed'
    WHEN c.o_orderstatus <> p.o_orderstatus THEN 'changed' ELSE 'unchanged' END AS change,
    CAST(CASE WHEN c.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rows_current,
    CAST(CASE WHEN p.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS rows_previous
    FROM c FULL JOIN p ON c.o_orderkey = p.o_orderkey"""
)
def classify_delta(spark, sf_dir):
    return O.classify_delta(*snapshots(spark, sf_dir), "o_orderkey")


_LEFT_QUANTITY = "CASE WHEN l_discount < 0.05 THEN l_quantity WHEN l_discount > 0.09 THEN NULL ELSE 100 + l_quantity END"
_RIGHT_QUANTITY = "CASE WHEN l_tax > 0.03 THEN l_quantity WHEN l_tax < 0.01 THEN NULL ELSE -l_quantity END"


@query(
    f"""WITH a AS (SELECT l_returnflag, l_linestatus, {_LEFT_QUANTITY} AS quantity, l_tax, count(*) AS m
    FROM lineitem GROUP BY 1, 2, 3, 4),
    b AS (SELECT l_returnflag, l_linestatus, {_RIGHT_QUANTITY} AS quantity, l_discount, count(*) AS n
    FROM lineitem GROUP BY 1, 2, 3, 4)
    SELECT coalesce(a.l_returnflag, b.l_returnflag) AS l_returnflag,
    coalesce(a.l_linestatus, b.l_linestatus) AS l_linestatus,
    coalesce(a.quantity, b.quantity) AS quantity, l_tax, l_discount,
    coalesce(m, 1) * coalesce(n, 1) AS copies FROM a FULL JOIN b
    ON a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus
    AND a.quantity IS NOT DISTINCT FROM b.quantity"""
)
def natural_full_join(spark, sf_dir):
    """All lines on both sides; each side has a column of its own that varies within shared rows."""
    lines = table(spark, sf_dir, "lineitem")
    flags = ["l_returnflag", "l_linestatus"]
    return O.natural_full_join(
        lines.select(*flags, F.expr(_LEFT_QUANTITY).alias("quantity"), "l_tax"),
        lines.select(*flags, F.expr(_RIGHT_QUANTITY).alias("quantity"), "l_discount"),
    )


_NUMBER_TEXT = (
    "CASE o_orderkey % 8 WHEN 0 THEN concat(CAST(o_orderkey AS VARCHAR(20)), '.75') WHEN 1 THEN '1e12' "
    "WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '4357525678' WHEN 6 THEN "
    "concat('-', CAST(o_orderkey AS VARCHAR(20))) ELSE 'n/a' END"
)


@query(
    """SELECT o_orderkey, CAST(CASE o_orderkey % 8 WHEN 0 THEN o_orderkey WHEN 6 THEN -o_orderkey END
    AS INTEGER) AS number FROM orders"""
)
def parse_ints(spark, sf_dir):
    """Whole numbers from text with fractions, overflow, blanks and words in it."""
    text = F.expr(_NUMBER_TEXT.replace("VARCHAR(20)", "STRING"))
    return O.parse_ints(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("number")), ["number"])


@query(
    """SELECT k, a, b FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY a NULLS FIRST,
    b NULLS FIRST) AS rn FROM (SELECT o_custkey AS k, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS a,
    CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey END AS b FROM orders)) WHERE rn = 1"""
)
def keep_first_by_content(spark, sf_dir):
    """Keep-first without a given order: the same row however the input is dealt, nulls included."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS k", "IF(o_orderkey % 2 = 0, o_orderkey, NULL) AS a",
        "IF(o_orderkey % 2 = 1, o_orderkey, NULL) AS b",
    )
    return O.distinct_on(rows, "k")
