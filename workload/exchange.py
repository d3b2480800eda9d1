"""Sources and sinks: tables written out and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.operators import distinct_on, fill_blank, map_codes, new_records, parse_dates
from tidewatch.session import folders as folders_below
from tidewatch.session import shared_folder
from tidewatch.sources import (
    commit_snapshot,
    dimension,
    publish,
    read_extract,
    read_published,
    read_snapshot,
    with_input_order,
    write_by_recipient,
    write_extract,
)

from .derived import AS_OF, SNAPSHOT_CUTOFF, extract, extract_sql, table
from .registry import query
from .schools import _line_list_sql, line_list_14d


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared folder; what the tests read lies there till the session ends."""
    return f"{shared_folder(spark)}/exchange-{uuid.uuid4().hex}"


_CASE_COLUMNS = (
    "patient_record_number, case_date, hosp_admit_date, county, breakthrough, hosp, age"
)


_DETAILS = (
    "CASE county WHEN 2 THEN concat('bus \"', patient_record_number, '\" route, north') WHEN 3 THEN "
    "concat('first line', chr(10), 'second \"line\"', chr(10)) WHEN 17 THEN 'back\\slash \\\" quoted' "
    "ELSE '' END"
)


@query(
    f"""SELECT patient_record_number, case_date, hosp_admit_date, CAST(county AS INTEGER) AS county,
    coalesce(breakthrough, '') AS breakthrough, hosp, age, {_DETAILS} AS details
    FROM ({extract_sql('cases')})"""
)
def extract_roundtrip(spark, sf_dir):
    """Header CSV written and read back as text, dates and numbers parsed, blanks restored.

    The free text holds quotes, commas, backslashes and line breaks.
    """
    path = scratch(spark)
    cases = extract(spark, sf_dir, "cases").select(*_CASE_COLUMNS.split(", "))
    details = F.expr(_DETAILS.replace("\\", "\\\\"))
    write_extract(cases.withColumn("details", details), path)
    back = read_extract(spark, path, multi_line=True)
    typed = parse_dates(back, ["case_date", "hosp_admit_date"]).withColumn(
        "county", F.col("county").cast("int")
    )
    return fill_blank(typed)


@query(
    """SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS order_date,
    o_totalprice AS total_price FROM orders"""
)
def typed_extract(spark, sf_dir):
    """CSV with a leading row number, read under a positional schema that names and types it."""
    path = scratch(spark)
    write_extract(
        table(spark, sf_dir, "orders").select(
            F.monotonically_increasing_id().alias("row"),
            F.col("o_orderkey").alias("Order.Key"),
            F.col("o_orderdate").cast("date").alias("Order.Date"),
            F.col("o_totalprice").alias("Total Price"),
        ),
        path,
    )
    schema = "`row` BIGINT, `Order.Key` BIGINT, `Order.Date` DATE, `Total Price` DOUBLE"
    return read_extract(spark, path, schema, drop_first=True)


@query(
    f"""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate < DATE '{SNAPSHOT_CUTOFF}'"""
)
def snapshot_roundtrip(spark, sf_dir):
    """Three committed snapshots, of which the newest before the run date is read."""
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    for day in ("2000-01-01", SNAPSHOT_CUTOFF, AS_OF):
        commit_snapshot(
            orders.filter(F.col("o_orderdate") < day).drop("o_orderdate"), path, day
        )
    return read_snapshot(spark, path, AS_OF)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def publish_roundtrip(spark, sf_dir):
    """A table published in two languages; the latest English copy is read."""
    base = scratch(spark)
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    publish({"status": counts}, base, AS_OF, "en")
    publish({"status": counts.withColumnRenamed("n", "total")}, base, AS_OF, "es")
    return spark.read.parquet(f"{base}/en/latest/status")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1")
def publish_interrupted(spark, sf_dir):
    """A second bundle fails at its last table: readers keep the whole first one."""
    base = scratch(spark)
    orders = table(spark, sf_dir, "orders")
    counts = lambda df: df.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
    publish({"status": counts(orders.filter("o_orderkey % 2 = 0")), "keys": orders.select("o_orderkey")}, base, AS_OF)
    broken = orders.select(F.when(F.col("o_orderkey").isNotNull(), F.raise_error(F.lit("interrupted"))))
    try:
        publish({"status": counts(orders), "keys": broken}, base, AS_OF)
    except Exception as error:  # the table that cannot be computed
        if "interrupted" not in str(error):
            raise
    return read_published(spark, base, "status")


@query(
    """SELECT o_custkey, o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS place
    FROM orders"""
)
def publish_sorted(spark, sf_dir):
    """The place of every row in a published table, counted over its files as they lie there."""
    base = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    publish({"orders": orders}, base, AS_OF, order={"orders": ["o_custkey", "o_orderkey"]})
    rows = read_published(spark, base, "orders").select(
        "o_custkey", "o_orderkey", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i")
    )
    # Files are a number each and rows count on from file to file: one row per file is gathered.
    files = rows.groupBy("file").agg(F.count("*").alias("rows"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    return rows.join(starts, "file").select("o_custkey", "o_orderkey", (F.col("start") + F.col("i") + 1).alias("place"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 0")
def snapshot_empty(spark, sf_dir):
    """The newest snapshot has no rows, and hides the rows of the one before."""
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    commit_snapshot(orders, path, "2000-01-01")
    commit_snapshot(orders, path, "2000-01-02")
    commit_snapshot(orders.filter("o_orderkey < 0"), path, "2000-01-02")
    return read_snapshot(spark, path, "2000-01-03")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def snapshot_first_run(spark, sf_dir):
    """On a first run there is no snapshot: every record is new."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return new_records(orders, read_snapshot(spark, scratch(spark), AS_OF, orders.schema), "o_orderkey")


@query(
    f"""SELECT recipient, CAST(sum(n) AS BIGINT) AS n FROM (SELECT recipient, 1 AS n
    FROM ({_line_list_sql()}) WHERE recipient <> 'asia' UNION ALL
    SELECT 'asia', 0 UNION ALL SELECT 'nobody', 0) GROUP BY 1"""
)
def recipient_fanout(spark, sf_dir):
    """The line list written into one folder per recipient, twice; the second run lacks one.

    That one, and one that never has rows, have a file with the header alone.
    """
    path = scratch(spark)
    rows = line_list_14d(spark, sf_dir)
    write_by_recipient(rows, path)
    write_by_recipient(rows.filter("recipient <> 'asia'"), path, recipients=["asia", "nobody"])
    read = spark.read.option("multiLine", True).option("escape", '"')
    lines = read.option("header", True).csv(path).groupBy("recipient").agg(F.count("*").alias("n"))
    named = spark.createDataFrame(
        [(name.partition("=")[2],) for name in folders_below(spark, path)], "recipient string"
    )
    return named.join(lines, "recipient", "left").na.fill(0, ["n"])


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER
    (PARTITION BY l_orderkey ORDER BY pos) AS rn FROM (SELECT *, row_number() OVER () AS pos
    FROM lineitem)) WHERE rn = 1"""
)
def keep_first_in_file(spark, sf_dir):
    """First row per key in file order."""
    lines = with_input_order(table(spark, sf_dir, "lineitem"))
    return distinct_on(lines, "l_orderkey", ["input_order"]).select(
        "l_orderkey", "l_linenumber", "l_partkey"
    )


@query(
    """SELECT c_custkey, CASE c_nationkey WHEN 2 THEN 'Box Elder' WHEN 3 THEN 'Cache'
    WHEN 17 THEN 'Rich' END AS county FROM customer"""
)
def shipped_dimension(spark, sf_dir):
    """Codes looked up in a reference table shipped with the package."""
    return map_codes(
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"),
        "c_nationkey",
        dimension(spark, "county"),
        "code",
        "county",
        "county",
    ).select("c_custkey", "county")
