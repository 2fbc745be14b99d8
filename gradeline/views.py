"""Views over the given tables: loan records, their registry and roles, and labelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# First and last month of every role, by split. The locked split has no role.
ROLE_MONTHS = (
    ("base_fit", "train", "1995-01", "1998-12"),
    ("fusion_fit", "train", "1999-01", "1999-06"),
    ("fusion_calibration", "train", "1999-07", "1999-12"),
    ("validation", "validation", "2000-01", "2000-12"),
)
SPLIT_MONTHS = (
    ("train", "1995-01", "1999-12"),
    ("validation", "2000-01", "2000-12"),
    ("test", "2001-01", "2001-12"),
)
TEXT_ROLE_MONTHS = (
    ("base_fit", "train", "2012-01", "2012-06"),
    ("fusion_fit", "train", "2012-07", "2012-08"),
    ("fusion_calibration", "train", "2012-09", "2012-09"),
    ("validation", "validation", "2012-10", "2012-11"),
)
SCORING_ROLES = ("fusion_fit", "fusion_calibration", "validation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order as one all-text loan record with its one-based row number."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    money = lambda name: F.col(name).cast("decimal(18,2)").cast("string")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        (F.col("o_orderkey") + 1).alias("source_row_number"),
        F.date_format("o_orderdate", "MMM-yyyy").alias("issue_d"),
        F.when(F.col("o_orderstatus") == "F", "Charged Off").when(F.col("o_orderstatus") == "O", "Fully Paid")
        .otherwise("Current").alias("loan_status"),
        money("o_totalprice").alias("loan_amnt"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(3)) == 0, " 60 months").otherwise(" 36 months").alias("term"),
        money("c_acctbal").alias("annual_inc"),
        (F.pmod(F.col("o_custkey") * 37, F.lit(400)) / F.lit(10)).cast("decimal(18,1)").cast("string").alias("dti"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(20)) == 0, "  ")
        .otherwise(F.pmod(F.col("o_orderkey") * 13, F.lit(101)).cast("string")).alias("revol_util"),
        F.pmod(F.col("o_custkey"), F.lit(4)).cast("string").alias("delinq_2yrs"),
        F.pmod(F.col("c_nationkey"), F.lit(6)).cast("string").alias("inq_last_6mths"),
        F.date_format(F.add_months(F.col("o_orderdate").cast("date"),
                                   -(60 + F.pmod(F.col("o_custkey"), F.lit(200))).cast("int")),
                      "MMM-yyyy").alias("earliest_cr_line"),
        F.when(F.col("o_orderpriority").startswith("1"), "RENT")
        .when(F.col("o_orderpriority").startswith("2"), "MORTGAGE")
        .when(F.col("o_orderpriority").startswith("3"), " own ")
        .when(F.col("o_orderpriority").startswith("4"), "none").otherwise("ANY").alias("home_ownership"),
        F.col("c_mktsegment").alias("title"),
        F.lower(F.concat_ws("_", F.col("c_mktsegment"), F.lit("loan"))).alias("purpose"),
        F.when(F.pmod(F.col("o_orderkey"), F.lit(50)) == 7, " \t ")
        .when(F.pmod(F.col("o_orderkey"), F.lit(50)) == 9, " N/A ")
        .otherwise(F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" "))).alias("desc"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed orders as scored loans: F is the event, O the non-event, P is not eligible."""
    orders = table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    event = F.col("o_orderstatus") == "F"
    month = F.date_format("o_orderdate", "yyyy-MM")

    def score(a: int, b: int, span: int, shift: int):
        return (((key * a + cust * b) % span + 100 + F.when(event, shift).otherwise(0)).cast("double")
                / F.lit(1000.0))

    return (
        orders.filter(F.col("o_orderstatus").isin("F", "O"))
        .join(customer, cust == F.col("c_custkey"))
        .select(
            F.format_string("lc_%09d", key + 1).alias("loan_id"),
            (key + 1).alias("source_row_number"),
            month.alias("issue_month"),
            F.when(month <= "1999-12", "train").when(month <= "2000-12", "validation").otherwise("test").alias("split"),
            F.when(month <= "1998-12", "base_fit").when(month <= "1999-06", "fusion_fit")
            .when(month <= "1999-12", "fusion_calibration").when(month <= "2000-12", "validation").alias("role"),
            event.cast("int").alias("target"),
            F.col("o_totalprice").alias("loan_amnt"),
            F.col("c_acctbal").alias("annual_inc"),
            F.col("c_mktsegment").alias("purpose"),
            score(7919, 31, 800, 99).alias("p_a"),
            score(104729, 17, 700, 199).alias("p_b"),
        )
    )


def labelled_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label, as text records with a category, a month and an outcome."""
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    month = F.concat(F.lit("2012-"), F.lpad((F.col("doc_id") % 12 + 1).cast("string"), 2, "0"))
    return documents.join(labels, "doc_id").select(
        F.format_string("lc_%09d", F.col("doc_id") + 1).alias("loan_id"),
        F.col("doc_id"),
        month.alias("issue_month"),
        F.when(month <= "2012-09", "train").when(month <= "2012-11", "validation").otherwise("test").alias("split"),
        F.when(month <= "2012-06", "base_fit").when(month <= "2012-08", "fusion_fit")
        .when(month <= "2012-09", "fusion_calibration").when(month <= "2012-11", "validation").alias("role"),
        F.col("quality").alias("target"),
        F.col("toxic"),
        F.concat(F.lit("Note "), F.col("source")).alias("title"),
        F.concat_ws("_", F.lit("text"), F.col("lang")).alias("purpose"),
        F.col("text").alias("desc"),
    )


# The same views as SQL text, for the oracle queries.
RAW_LOANS_SQL = """raw_loans as (
  select o_orderkey + 1 as source_row_number, strftime(o_orderdate, '%b-%Y') as issue_d,
    case o_orderstatus when 'F' then 'Charged Off' when 'O' then 'Fully Paid' else 'Current' end as loan_status,
    cast(cast(o_totalprice as decimal(18,2)) as varchar) as loan_amnt,
    case when o_orderkey % 3 = 0 then ' 60 months' else ' 36 months' end as term,
    cast(cast(c_acctbal as decimal(18,2)) as varchar) as annual_inc,
    cast(cast(cast((o_custkey * 37) % 400 as double) / 10 as decimal(18,1)) as varchar) as dti,
    case when o_orderkey % 20 = 0 then '  ' else cast((o_orderkey * 13) % 101 as varchar) end as revol_util,
    cast(o_custkey % 4 as varchar) as delinq_2yrs, cast(c_nationkey % 6 as varchar) as inq_last_6mths,
    strftime(cast(o_orderdate as date) - to_months(cast(60 + o_custkey % 200 as integer)), '%b-%Y') as earliest_cr_line,
    case left(o_orderpriority, 1) when '1' then 'RENT' when '2' then 'MORTGAGE' when '3' then ' own '
      when '4' then 'none' else 'ANY' end as home_ownership,
    c_mktsegment as title, lower(c_mktsegment || '_loan') as purpose,
    case when o_orderkey % 50 = 7 then ' ' || chr(9) || ' ' when o_orderkey % 50 = 9 then ' N/A '
      else '  ' || o_orderpriority || ' ' end as "desc"
  from orders join customer on o_custkey = c_custkey)"""

LOANS_SQL = """loans as (
  select 'lc_' || lpad(cast(o_orderkey + 1 as varchar), 9, '0') as loan_id, o_orderkey + 1 as source_row_number,
    strftime(o_orderdate, '%Y-%m') as issue_month,
    case when strftime(o_orderdate, '%Y-%m') <= '1999-12' then 'train'
         when strftime(o_orderdate, '%Y-%m') <= '2000-12' then 'validation' else 'test' end as split,
    case when strftime(o_orderdate, '%Y-%m') <= '1998-12' then 'base_fit'
         when strftime(o_orderdate, '%Y-%m') <= '1999-06' then 'fusion_fit'
         when strftime(o_orderdate, '%Y-%m') <= '1999-12' then 'fusion_calibration'
         when strftime(o_orderdate, '%Y-%m') <= '2000-12' then 'validation' end as role,
    case when o_orderstatus = 'F' then 1 else 0 end as target,
    o_totalprice as loan_amnt, c_acctbal as annual_inc, c_mktsegment as purpose,
    cast((o_orderkey*7919 + o_custkey*31) % 800 + 100 + case when o_orderstatus='F' then 99 else 0 end as double)
      / cast(1000 as double) as p_a,
    cast((o_orderkey*104729 + o_custkey*17) % 700 + 100 + case when o_orderstatus='F' then 199 else 0 end as double)
      / cast(1000 as double) as p_b
  from orders join customer on o_custkey = c_custkey where o_orderstatus in ('F', 'O'))"""

TEXTS_SQL = """texts as (
  select 'lc_' || lpad(cast(doc_id + 1 as varchar), 9, '0') as loan_id, doc_id,
    '2012-' || lpad(cast(doc_id % 12 + 1 as varchar), 2, '0') as issue_month,
    case when doc_id % 12 + 1 <= 9 then 'train' when doc_id % 12 + 1 <= 11 then 'validation' else 'test' end as split,
    case when doc_id % 12 + 1 <= 6 then 'base_fit' when doc_id % 12 + 1 <= 8 then 'fusion_fit'
         when doc_id % 12 + 1 <= 9 then 'fusion_calibration' when doc_id % 12 + 1 <= 11 then 'validation' end as role,
    quality as target, toxic, 'Note ' || source as title, 'text_' || lang as purpose, text as "desc"
  from documents join labels using (doc_id))"""
