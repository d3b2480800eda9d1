"""Surveillance-shaped extracts derived from the benchmark tables.

Each extract is a FROM clause and one SQL expression per column, written in the dialect Spark
and the checking engine share, so both sides start from the same rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HOME = "Home"
START, AS_OF = "1995-01-01", "2001-07-31"
DOSE_START, DOSE_AS_OF = "2024-01-01", "2024-01-30"
SNAPSHOT_CUTOFF = "2001-03-01"


def days(expr: str, n: int) -> str:
    sign = "+" if n >= 0 else "-"
    return f"CAST(CAST({expr} AS DATE) {sign} INTERVAL {abs(n)} DAY AS DATE)"


def bands(expr: str, bounds: list[tuple[float, str]], default: str) -> str:
    whens = " ".join(f"WHEN {expr} < {b} THEN '{label}'" for b, label in bounds)
    return f"CASE {whens} ELSE '{default}' END"


_ORDER_DATE = "CAST(o_orderdate AS DATE)"
_SHIP_DATE = "CAST(l_shipdate AS DATE)"
_AGE_BY_BALANCE = bands(
    "c_acctbal",
    [(0, "0-1"), (1500, "1-14"), (3000, "15-24"), (5000, "25-44"), (7000, "45-64"), (9000, "65-84")],
    "85+",
)
_AGE_BY_QUANTITY = bands(
    "l_quantity",
    [(3, "0-1"), (8, "1-14"), (15, "15-24"), (25, "25-44"), (35, "45-64"), (45, "65-84")],
    "85+",
)
_SEGMENT_COUNTY = (
    "CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 3 "
    "WHEN 'HOUSEHOLD' THEN 17 ELSE 99 END"
)
_RATE_COUNTY = (
    "CASE WHEN l_discount < 0.035 THEN 2 WHEN l_discount < 0.065 THEN 3 "
    "WHEN l_discount < 0.085 THEN 17 ELSE 99 END"
)
_PRIORITY = "CASE o_orderpriority WHEN '1-URGENT' THEN {} WHEN '2-HIGH' THEN {} " \
    "WHEN '3-MEDIUM' THEN {} WHEN '4-NOT SPECIFIED' THEN {} ELSE {} END"
# Computed once per row, ahead of the columns that use it.
_K = "k"
_BASE = {"doses": {"k": "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"}}

# name -> (tables with join conditions, {column: expression})
EXTRACTS: dict[str, tuple[list[tuple[str, str | None]], dict[str, str]]] = {
    "cases": (
        [("orders", None), ("customer", "o_custkey = c_custkey")],
        {
            "patient_record_number": "CAST(o_orderkey AS VARCHAR(20))",
            "case_date": _ORDER_DATE,
            "case_onset_date": days("o_orderdate", -4),
            "hosp_admit_date": f"CASE WHEN o_totalprice >= 300000 THEN {days('o_orderdate', 3)} END",
            "first_positive_lab": days("o_orderdate", -2),
            "county": _SEGMENT_COUNTY,
            "lhd": "CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY','HOUSEHOLD') THEN 1 ELSE 0 END",
            "st_case_status": "CASE o_orderstatus WHEN 'P' THEN 'Probable' ELSE 'Confirmed' END",
            "breakthrough": _PRIORITY.format("'Yes'", "'No'", "NULL", "''", "'No'"),
            "reinfection": "CASE WHEN c_acctbal < 1000 THEN 'Yes' ELSE 'No' END",
            "hosp": "CASE WHEN o_totalprice >= 300000 THEN 'Yes' ELSE 'No' END",
            "age": _AGE_BY_BALANCE,
            "condition_caused_death": "CASE WHEN o_totalprice >= 480000 THEN 'Yes' ELSE 'No' END",
            "covid_death": "CASE WHEN o_totalprice >= 490000 THEN 'Yes' ELSE 'No' END",
        },
    ),
    "deaths": (
        [("lineitem", None)],
        {
            "date_of_death": _SHIP_DATE,
            "case_date": days("l_shipdate", -20),
            "patient_died": "CASE l_returnflag WHEN 'R' THEN 'Yes' WHEN 'A' THEN 'Yes' ELSE 'No' END",
            "breakthrough": "CASE l_linestatus WHEN 'O' THEN 'Yes' ELSE 'No' END",
            "age": _AGE_BY_QUANTITY,
            "county": _RATE_COUNTY,
            "lhd": "CASE WHEN l_discount < 0.085 THEN 1 ELSE 0 END",
        },
    ),
    "tests": (
        [("lineitem", None)],
        {
            "collect_date_fillrph": _SHIP_DATE,
            "case_date": days("l_shipdate", 2),
            "test_result": "CASE l_returnflag WHEN 'R' THEN 'POSITIVE' WHEN 'A' THEN 'NEGATIVE' "
            "ELSE 'INCONCLUSIVE' END",
            "test_type": "CASE WHEN l_tax < 0.075 THEN 'PCR/amplification' ELSE 'Antigen' END",
            "lhd": "CASE WHEN l_quantity <= 45 THEN 'Home' ELSE 'Elsewhere' END",
            "county": "CASE WHEN l_discount < 0.035 THEN 'Box Elder' WHEN l_discount < 0.085 "
            "THEN 'Cache' WHEN l_discount < 0.095 THEN 'Rich' ELSE NULL END",
        },
    ),
    "doses": (
        [("events", None)],
        {
            "vaccine_date": "CAST(ts AS DATE)",
            "zipcode": f"84320 + {_K}",
            "ethnicity": f"CASE WHEN {_K} < 15 THEN 'Hispanic or Latino' ELSE 'Other' END",
            "race": f"CASE WHEN {_K} < 25 THEN 'Asian' WHEN {_K} < 40 THEN 'Unknown' "
            f"WHEN {_K} < 45 THEN 'Some other race' ELSE 'White' END",
            "district": f"CASE WHEN {_K} < 90 THEN 'Home' ELSE 'Elsewhere' END",
            "county": f"CASE WHEN {_K} < 30 THEN 'Box Elder' WHEN {_K} < 75 THEN 'Cache' "
            f"WHEN {_K} < 85 THEN 'Rich' ELSE 'Weber' END",
            "dose_all": "CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'signup' "
            "THEN 1 WHEN 'purchase' THEN 3 END",
            "vaccine_status": "CASE event_type WHEN 'view' THEN 'Complete' WHEN 'signup' "
            "THEN 'Complete' END",
            "booster_dose": "CASE event_type WHEN 'purchase' THEN 'Yes' END",
            "age_original": "CAST(FLOOR(value) AS INT)",
            "age": "CASE WHEN value < 5 THEN 'Unknown' WHEN value < 12 THEN '5-11' "
            "WHEN value < 19 THEN '12-18' WHEN value < 30 THEN '19-29' WHEN value < 40 THEN '30-39' "
            "WHEN value < 50 THEN '40-49' WHEN value < 60 THEN '50-59' WHEN value < 70 THEN '60-69' "
            "WHEN value < 80 THEN '70-79' ELSE '80+' END",
        },
    ),
    "investigations": (
        [
            ("lineitem", None),
            ("orders", "l_orderkey = o_orderkey"),
            ("customer", "o_custkey = c_custkey"),
        ],
        {
            "patient_record_number": "CAST(l_orderkey AS VARCHAR(20))",
            "line": "l_linenumber",
            "part": "l_partkey",
            "supplier": "l_suppkey",
            "amount": "l_extendedprice",
            "covid_case_date": _ORDER_DATE,
            "patient_age_at_event_in_years": "CAST(FLOOR(l_quantity * 3) AS INT) - 10",
            "patient_jurisdiction_of_residence": "CASE c_mktsegment WHEN 'FURNITURE' THEN "
            "'Elsewhere' WHEN 'MACHINERY' THEN '' ELSE 'Home' END",
            "patient_state_case_status": "CASE o_orderstatus WHEN 'P' THEN 'Probable' "
            "ELSE 'Confirmed' END",
            "condition_caused_death": "CASE WHEN c_acctbal < 500 THEN 'Yes' ELSE 'No' END",
            "person_facility_visit_type": "CASE l_returnflag WHEN 'A' THEN 'Outpatient' WHEN 'N' "
            "THEN 'Unknown' ELSE CASE l_linestatus WHEN 'O' THEN 'Inpatient' ELSE '' END END",
            "corona_pui_col_hosp_ncov": "CASE WHEN o_totalprice > 400000 THEN 'Yes' ELSE 'No' END",
            "corona_pui_col_icu": "CASE WHEN o_totalprice > 490000 THEN 'Yes' ELSE 'No' END",
            "address_at_diagnosis_city": "CASE c_mktsegment WHEN 'BUILDING' THEN 'NORTH LOGAN' "
            "WHEN 'MACHINERY' THEN 'LOGAN' WHEN 'HOUSEHOLD' THEN 'BRIGHAM CITY' "
            "ELSE 'Smithfield' END",
        },
    ),
    "linked": (
        [
            ("orders", None),
            ("customer", "o_custkey = c_custkey"),
            ("nation", "c_nationkey = n_nationkey"),
            ("region", "n_regionkey = r_regionkey"),
        ],
        {
            "patient_record_number": "CAST(o_orderkey AS VARCHAR(20))",
            "covid_case_date": _ORDER_DATE,
            "patient_event_onset_date": "CASE o_orderstatus WHEN 'F' THEN "
            f"{days('o_orderdate', -3)} WHEN 'O' THEN {_ORDER_DATE} END",
            "patient_birth_date": days("o_orderdate", -6000),
            "patient_age_at_event_in_years": "CAST(FLOOR(o_totalprice / 10000) AS INT)",
            "corona_pui_col_school_univ": "CASE WHEN c_acctbal < 5000 THEN 'Yes' ELSE 'No' END",
            "corona_pui_col_school_univ_type": _PRIORITY.format(
                "'Student'", "'Teacher'", "'Volunteer/visitor'", "'Student'", "NULL"
            ),
            "corona_pui_col_school_univ_type_details": "o_orderpriority",
            "corona_pui_col_school_acquired_case": "CASE c_mktsegment WHEN 'BUILDING' THEN 'Yes' "
            "ELSE 'No' END",
            "exposure_place_school_district": "concat(r_name, ' District')",
            "place_name": "CASE o_orderstatus WHEN 'F' THEN concat(n_name, ' School') WHEN 'P' "
            "THEN n_name ELSE CASE c_mktsegment WHEN 'FURNITURE' THEN '' ELSE n_name END END",
            "person_first_name": "c_name",
            "person_last_name": "n_name",
            "corona_pui_col_covid_sympt": "CASE o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' "
            "THEN 'No' END",
            "corona_pui_col_school_univ_event": "c_mktsegment",
            "corona_pui_col_school_univ_event_details": "o_orderstatus",
            "corona_pui_col_school_univ_activity": "c_mktsegment",
            "corona_pui_col_school_univ_activities_details": "o_orderstatus",
            "corona_pui_col_school_univ_bus_details": "''",
            "first_positive_lab": days("o_orderdate", -1),
            "address_at_diagnosis_county": "CASE c_mktsegment WHEN 'BUILDING' THEN 'BE' "
            "WHEN 'MACHINERY' THEN 'RI' ELSE 'CA' END",
            "address_at_diagnosis_city": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'Logan' "
            "WHEN 'FURNITURE' THEN 'Hyrum' ELSE 'Other' END",
            "covid_interview_complete": "CASE o_orderstatus WHEN 'F' THEN 'f' ELSE 't' END",
            "patient_jurisdiction_of_investigation": "CASE c_mktsegment WHEN 'MACHINERY' THEN "
            "'Utah State' WHEN 'BUILDING' THEN 'Utah State' ELSE 'Home' END",
        },
    ),
}

_VARCHAR = "VARCHAR(20)"


@functools.cache
def _schema(path: str) -> StructType:
    """Schema of a table, read from its footer once."""
    return SparkSession.active().read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(path)).parquet(path)


def extract(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables, columns = EXTRACTS[name]
    out = None
    for source, on in tables:
        side = table(spark, sf_dir, source)
        out = side if out is None else out.join(side, F.expr(on))
    for column, expr in _BASE.get(name, {}).items():
        out = out.withColumn(column, F.expr(expr))
    return out.selectExpr(
        *[f"{e.replace(_VARCHAR, 'STRING')} AS {c}" for c, e in columns.items()]
    )


def extract_sql(name: str) -> str:
    tables, columns = EXTRACTS[name]
    source = tables[0][0] + "".join(f" JOIN {t} ON {on}" for t, on in tables[1:])
    if name in _BASE:
        base = ", ".join(f"{e} AS {c}" for c, e in _BASE[name].items())
        source = f"(SELECT *, {base} FROM {source})"
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {source}"
