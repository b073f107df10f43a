"""Queries over the given tables and the SQL that must give the same rows.

Tables are encoded into records by expressions, put into files where a scan is meant, read back through the engine,
and compared with plain SQL over the tables themselves. Everything stays distributed; nothing runs on made-up rows.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections import Counter
from functools import reduce
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from copperleaf.functions import codecs
from copperleaf.functions import encoders as enc
from copperleaf.operators import database, load, reconcile, reshape, subtypes, transform
from copperleaf.operators.decode import DecodeOptions, accepted, byte_histogram, decode, once, page_ranking, page_scores, rejected
from copperleaf.plans import engine, state
from copperleaf.plans.schema import Options, Table, compile_copybook
from copperleaf.sources import ranges, records, tables
from copperleaf.streaming import incremental
from copperleaf.streaming.changes import ChangeTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CUSTOMER = """
01 CUSTOMER-REC.
   05 CUST-KEY PIC 9(9) COMP.
   05 CUST-NAME PIC X(18).
   05 CUST-NATION PIC 9(2).
   05 CUST-BAL PIC S9(9)V99 COMP-3.
   05 CUST-SEGMENT PIC X(10).
   05 FILLER PIC X(4).
"""
ORDER = """
01 ORDER-REC.
   05 ORD-TYPE PIC X.
   05 ORD-KEY PIC 9(18) COMP.
   05 ORD-CUST PIC S9(9) COMP-5.
   05 ORD-STATUS PIC X.
      88 ORD-KNOWN VALUE 'O' 'F' 'P'.
   05 ORD-TOTAL PIC S9(9)V99.
   05 ORD-DATE PIC 9(8).
   05 ORD-PRIO PIC X(15).
"""
LINE = """
01 LINE-REC.
   05 LN-TYPE PIC X.
   05 LN-ORD PIC 9(18) COMP.
   05 LN-PART PIC 9(9) COMP.
   05 LN-SUPP PIC 9(9) COMP-5.
   05 LN-NUM PIC 9(4) COMP.
   05 LN-QTY PIC S9(5) COMP-3.
   05 LN-PRICE PIC S9(11)V99 COMP-3.
   05 LN-DISC COMP-2.
   05 LN-TAX PIC 9V99 COMP-6.
   05 LN-FLAG PIC X.
   05 LN-STATUS PIC X.
   05 LN-SHIP PIC 9(7).
"""
ORDER_LINES = """
01 ORDER-ODO-REC.
   05 OO-KEY PIC 9(18) COMP.
   05 OO-COUNT PIC 9(4) COMP.
   05 OO-LINES OCCURS 0 TO 20 TIMES DEPENDING ON OO-COUNT.
      10 OL-NUM PIC 9(4) COMP.
      10 OL-QTY PIC S9(5) COMP-3.
      10 OL-PRICE PIC S9(11)V99 COMP-3.
"""
ORDER_LINES_END = ORDER_LINES + "   05 OO-END PIC X(3).\n"
EVENT = """
01 EVENT-REC.
   05 EV-ID PIC 9(18) COMP.
   05 EV-TYPE PIC X(8).
   05 EV-USER PIC 9(9) COMP.
   05 EV-BODY PIC X(8).
   05 EV-PURCHASE REDEFINES EV-BODY.
      10 EV-AMT PIC S9(7)V99 COMP-3.
      10 FILLER PIC X(3).
   05 EV-ERROR REDEFINES EV-BODY.
      10 EV-CODE PIC 9(8).
"""
#: Characters only, the last of them a semicolon: what Spark's text writer can make files of.
RUN_ORDER = """
01 RUN-ORDER.
   05 RO-KEY PIC 9(9).
   05 RO-STATUS PIC X.
      88 RO-KNOWN VALUE 'O' 'F'.
   05 RO-PARTS OCCURS 3 TIMES.
      10 RP-PART PIC 9(9).
      10 RP-QTY PIC 9(3).
   05 RO-FILE PIC X(4).
   05 FILLER PIC X.
"""
DATES = {"ORD-DATE": "YYYYMMDD", "LN-SHIP": "YYYYDDD"}


def layout(text: str, **options) -> Table:
    return compile_copybook(text, Options(dates=DATES, **options), free=True).tables[0]


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str, p: int = 11, s: int = 2) -> Column:
    return F.col(c).cast(f"decimal({p},{s})")


def joined(*parts: Column) -> Column:
    return F.concat(*parts)


# --- records of the tables --------------------------------------------------------------------------------------------


def customer_records(c: DataFrame, page: str = "cp037", balance: Column | None = None) -> DataFrame:
    raw = joined(
        enc.binary(F.col("c_custkey"), 4), enc.text(F.col("c_name"), 18, page), enc.text(enc.zoned(F.col("c_nationkey"), 2, signed=False), 2, page),
        enc.packed(money("c_acctbal"), 6, 2) if balance is None else balance, enc.text(F.col("c_mktsegment"), 10, page), enc.text(F.lit(""), 4, page),
    )
    return once(c.select("c_custkey", raw.alias("raw")))


def order_records(o: DataFrame) -> DataFrame:
    raw = joined(
        enc.text(F.lit("O"), 1), enc.binary(F.col("o_orderkey"), 8), enc.binary(F.col("o_custkey"), 4, big_endian=False), enc.text(F.col("o_orderstatus"), 1),
        enc.text(enc.zoned(money("o_totalprice"), 11, 2), 11), enc.text(F.date_format("o_orderdate", "yyyyMMdd"), 8), enc.text(F.col("o_orderpriority"), 15),
    )
    return once(o.select("o_orderkey", raw.alias("raw")))


def line_records(x: DataFrame) -> DataFrame:
    raw = joined(
        enc.text(F.lit("L"), 1), enc.binary(F.col("l_orderkey"), 8), enc.binary(F.col("l_partkey"), 4), enc.binary(F.col("l_suppkey"), 4, big_endian=False), enc.binary(F.col("l_linenumber"), 2),
        enc.packed(money("l_quantity", 5, 0), 3), enc.packed(money("l_extendedprice", 13), 7, 2), enc.ieee(F.col("l_discount")), enc.packed_unsigned(money("l_tax", 3), 2, 2),
        enc.text(F.col("l_returnflag"), 1), enc.text(F.col("l_linestatus"), 1), enc.text(F.date_format("l_shipdate", "yyyyDDD"), 7),
    )
    return once(x.select("l_orderkey", raw.alias("raw")))


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
NUMBERED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)"


def order_line_records(x: DataFrame, padded: bool = False) -> DataFrame:
    """One record for each order; 20 elements at most occur (13 at sf0.01, 17 at sf0.1)."""
    element = joined(enc.binary(F.col("l_linenumber"), 2), enc.packed(money("l_quantity", 5, 0), 3), enc.packed(money("l_extendedprice", 13), 7, 2))
    every = F.array_sort(F.collect_list(F.struct(*LINE_ORDER, F.hex(element).alias("h"))))
    one = x.groupBy("l_orderkey").agg(every.alias("e"))
    body = F.array_join(F.transform("e", lambda y: y["h"]), "")
    body = F.rpad(body, 480, "0") if padded else body
    return once(one.select("l_orderkey", joined(enc.binary(F.col("l_orderkey"), 8), enc.binary(F.size("e"), 2), F.unhex(body)).alias("raw")))


def event_records(e: DataFrame) -> DataFrame:
    amount = joined(enc.packed(money("value", 9), 5, 2), enc.text(F.lit(""), 3))
    code = enc.text(enc.zoned(F.expr("cast(event_id % 100000000 as bigint)"), 8, signed=False), 8)
    body = F.when(F.col("event_type") == "purchase", amount).when(F.col("event_type") == "error", code).otherwise(enc.text(F.lit("-"), 8))
    return once(e.select("event_id", joined(enc.binary(F.col("event_id"), 8), enc.text(F.col("event_type"), 8), enc.binary(F.col("user_id"), 4), body).alias("raw")))


# --- scans ------------------------------------------------------------------------------------------------------------

CUSTOMER_SQL = "CAST(c_custkey AS INT) AS cust_key, c_name AS cust_name, CAST(c_nationkey AS SMALLINT) AS cust_nation, CAST(c_acctbal AS DECIMAL(11,2)) AS cust_bal, c_mktsegment AS cust_segment"


def customers(rows: DataFrame) -> DataFrame:
    return accepted(decode(rows, layout(CUSTOMER))).drop("file", "line_num", "c_custkey")


@query(f"SELECT {CUSTOMER_SQL} FROM customer")
def fixed_scan_customer(spark, d):
    return customers(records.fixed(records.as_files(customer_records(table(spark, d, "customer")), "c_custkey", 512), 44))


@query(f"SELECT {CUSTOMER_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 512 ORDER BY c_custkey) AS k FROM customer) WHERE k > 3")
def fixed_scan_skip_header(spark, d):
    return customers(records.fixed(records.as_files(customer_records(table(spark, d, "customer")), "c_custkey", 512), 44, skip=3))


@query("SELECT count(*) AS n FROM customer")
def fixed_record_count(spark, d):
    return records.fixed_count(records.as_files(customer_records(table(spark, d, "customer")), "c_custkey", 512), 44)


@query(f"SELECT {CUSTOMER_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey // 512 ORDER BY c_custkey DESC) AS k FROM customer) WHERE k > 1")
def fixed_truncated_tail(spark, d):
    files = records.as_files(customer_records(table(spark, d, "customer")), "c_custkey", 512)
    return customers(records.fixed(files.withColumn("content", F.expr("substring(content, 1, length(content) - 5)")), 44))


ORDER_SQL = "o_orderkey AS ord_key, CAST(o_custkey AS INT) AS ord_cust, o_orderstatus AS ord_status, CAST(o_totalprice AS DECIMAL(11,2)) AS ord_total, CAST(o_orderdate AS DATE) AS ord_date, o_orderpriority AS ord_prio"


def orders(rows: DataFrame) -> DataFrame:
    return accepted(decode(rows, layout(ORDER))).drop("file", "line_num", "ord_type", "o_orderkey")


@query(f"SELECT {ORDER_SQL} FROM orders")
def variable_scan_orders(spark, d):
    return orders(records.variable(records.as_files(order_records(table(spark, d, "orders")), "o_orderkey", 4096, records.described())))


@query(f"SELECT {ORDER_SQL} FROM orders")
def blocked_scan_orders(spark, d):
    return orders(records.variable(records.as_files(order_records(table(spark, d, "orders")), "o_orderkey", 4096, records.described(), block=100), in_blocks=True))


def variable_file(spark, d, block: int = 0) -> str:
    """Files of lines of lineitem as V records of many lengths (VB with blocks of so many), written by Spark: each line ends
    in the byte that the text writer adds."""
    body = F.concat_ws("|", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.expr("repeat('x', cast(l_partkey % 60 as int))"))
    rows = table(spark, d, "lineitem").select(F.concat(F.encode(body, "UTF-8"), F.unhex(F.lit("3B"))).alias("raw"))
    one = rows.select(F.expr(records.described()).alias("raw"))
    if block:
        part = F.expr(f"monotonically_increasing_id() div {block}")
        one = one.withColumn("b", part).groupBy("b").agg(F.unhex(F.array_join(F.collect_list(F.hex("raw")), "")).alias("raw")).select(F.expr(records.described()).alias("raw"))
    path = scratch(spark)
    one.select(F.expr("cast(substring(raw, 1, length(raw) - 1) as string)").alias("value")).write.option("lineSep", ";").text(path)
    return path


LINE_SQL = "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS numbers, CAST(count(*) AS BIGINT) AS last, CAST(sum(l_orderkey) AS BIGINT) AS keys, CAST(sum(l_orderkey * l_linenumber) AS BIGINT) AS mixed FROM lineitem"


def line_facts(rows: DataFrame) -> DataFrame:
    parts = F.split(F.decode("raw", "UTF-8"), r"\|")
    number = lambda i: parts[i].cast("long")
    facts = (F.count(F.lit(1)).alias("n"), F.max("line_num").alias("last"), F.sum(number(0)).alias("keys"), F.sum(number(0) * number(1)).alias("mixed"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("line_num")).alias("bits")  # numbers lie close together, so a task has few bitmaps
    parts = rows.groupBy("file", F.bitmap_bucket_number("line_num").alias("bucket")).agg(bits, *facts).withColumn("numbers", F.bitmap_count("bits"))
    sums = (F.sum(c).alias(c) for c in ("n", "numbers", "keys", "mixed"))
    return parts.groupBy("file").agg(*sums, F.max("last").alias("last")).agg(*(F.sum(c).alias(c) for c in ("n", "numbers", "last", "keys", "mixed")))


@query(LINE_SQL)
def variable_ranges(spark, d):
    """One file of variable records, read in ranges of 256 KB."""
    return line_facts(ranges.variable(spark, variable_file(spark, d), size=1 << 18))


@query(LINE_SQL)
def blocked_ranges(spark, d):
    return line_facts(ranges.variable(spark, variable_file(spark, d, 50), in_blocks=True, size=1 << 18))


@query("SELECT count(*) AS n_records, 0 AS n_skipped, 0 AS tail_bytes FROM lineitem")
def scan_counters(spark, d):
    """What a scan of variable records returns and passes over."""
    out = ranges.scan_counts(spark, variable_file(spark, d), "V", size=1 << 18)
    return out.agg(*(F.sum(c).cast(k).alias(c) for c, k in (("n_records", "long"), ("n_skipped", "int"), ("tail_bytes", "int"))))


@query("SELECT o_orderkey AS ok, o_orderstatus AS status FROM orders")
def line_ranges(spark, d):
    """Files of lines, split between tasks."""
    path = scratch(spark)
    table(spark, d, "orders").select(F.concat_ws("|", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value")).write.option("lineSep", "\r\n").text(path)
    parts = F.split(F.decode("raw", "UTF-8"), r"\|")
    return records.read_records(spark, path, "D").select(parts[0].cast("long").alias("ok"), parts[1].alias("status"))


@query("SELECT n_nationkey AS n_key, n_name AS n_name, n_regionkey AS n_region FROM nation")
def text_scan_nation(spark, d):
    n = table(spark, d, "nation")
    raw = joined(enc.ascii_text(F.lpad(F.col("n_nationkey").cast("string"), 4, "0"), 4), enc.ascii_text(F.col("n_name"), 25), enc.ascii_text(F.lpad(F.col("n_regionkey").cast("string"), 4, "0"), 4), F.unhex(F.lit("0A")))
    t = layout("01 N-REC.\n 05 N-KEY PIC 9(4).\n 05 N-NAME PIC X(25).\n 05 N-REGION PIC 9(4).\n")
    rows = records.lines(records.as_files(n.select("n_nationkey", raw.alias("raw")), "n_nationkey", 10))
    out = accepted(decode(rows, t, DecodeOptions(ascii=True))).drop("file", "line_num")
    return out.select(F.col("n_key").cast("int").alias("n_key"), "n_name", F.col("n_region").cast("int").alias("n_region"))


@query("SELECT count(*) AS files, count(DISTINCT k) AS sums FROM (SELECT c_custkey // 512 AS k FROM customer GROUP BY 1)")
def file_checksums(spark, d):
    sums = records.checksums(records.as_files(customer_records(table(spark, d, "customer")), "c_custkey", 512))
    return sums.agg(F.count(F.lit(1)).alias("files"), F.count_distinct("checksum").alias("sums"))


# --- codecs -----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(13,2)) AS price FROM lineitem")
def comp3_decode(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", enc.packed(money("l_extendedprice", 13), 7, 2).alias("f"))
    return x.select("l_orderkey", "l_linenumber", codecs.packed(F.col("f"), 7, 2, 13).value.alias("price"))


@query("SELECT l_orderkey, l_linenumber, lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 5, '0') || 'C' AS h FROM lineitem")
def comp3_encode(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.hex(enc.packed(money("l_quantity", 5, 0), 3)).alias("h"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(11,2)) AS bal FROM customer")
def comp3_negative_signs(spark, d):
    k = F.col("c_custkey")
    sign = F.when(F.col("c_acctbal") < 0, F.when(k % 2 == 0, "D").otherwise("B")).otherwise(F.get(F.array(*map(F.lit, "CFAE")), (k % 4).cast("int")))
    x = table(spark, d, "customer").select("c_custkey", enc.packed(money("c_acctbal"), 6, 2, sign).alias("f"))
    return x.select("c_custkey", codecs.packed(F.col("f"), 6, 2, 11).value.alias("bal"))


@query("SELECT count(*) FILTER (WHERE l_linenumber = 3) AS n_rejected, count(*) FILTER (WHERE l_linenumber <> 3) AS n_ok FROM lineitem")
def comp3_invalid_rejects(spark, d):
    x = table(spark, d, "lineitem")
    bad = F.when(F.col("l_linenumber") == 3, F.unhex(F.lit("1A234C"))).otherwise(enc.packed(money("l_quantity", 5, 0), 3))
    rows = decode(x.select(bad.alias("raw")), layout("01 R.\n 05 Q PIC S9(5) COMP-3.\n"))
    return rows.agg(F.count_if(F.size("errors") > 0).alias("n_rejected"), F.count_if(F.size("errors") == 0).alias("n_ok"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_tax AS DECIMAL(3,2)) AS tax FROM lineitem")
def comp6_decode(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", enc.packed_unsigned(money("l_tax", 3), 2, 2).alias("f"))
    return x.select("l_orderkey", "l_linenumber", codecs.packed_unsigned(F.col("f"), 2, 2, 3).value.alias("tax"))


INTS_SQL = "SELECT l_orderkey, CAST({s} AS BIGINT) AS k2, CAST({p} AS BIGINT) AS k4, CAST({o} AS BIGINT) AS k8 FROM lineitem"
FLIP = "CASE WHEN l_partkey % 2 = 0 THEN -1 ELSE 1 END * "


def integers(spark, d, signed: bool, big: bool) -> DataFrame:
    flip = F.when(F.col("l_partkey") % 2 == 0, -1).otherwise(1) if signed else F.lit(1)
    x = table(spark, d, "lineitem").select("l_orderkey", *(enc.binary(F.col(c) * flip, n, big).alias(f"f{n}") for c, n in (("l_linenumber", 2), ("l_partkey", 4), ("l_orderkey", 8))))
    return x.select("l_orderkey", *(codecs.binary(F.col(f"f{n}"), n, signed, big).value.cast("long").alias(f"k{n}") for n in (2, 4, 8)))


@query(INTS_SQL.format(s=FLIP + "l_linenumber", p=FLIP + "l_partkey", o=FLIP + "l_orderkey"))
def comp_signed_be(spark, d):
    return integers(spark, d, True, True)


@query(INTS_SQL.format(s="l_linenumber", p="l_partkey", o="l_orderkey"))
def comp_unsigned_be(spark, d):
    return integers(spark, d, False, True)


@query(INTS_SQL.format(s=FLIP + "l_linenumber", p=FLIP + "l_partkey", o=FLIP + "l_orderkey"))
def comp5_le(spark, d):
    return integers(spark, d, True, False)


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(9,2)) AS bal FROM customer")
def comp_scaled(spark, d):
    raw = table(spark, d, "customer").select("c_custkey", enc.binary(money("c_acctbal", 9), 4, scale=2).alias("raw"))
    return accepted(decode(raw, layout("01 R.\n 05 BAL PIC S9(7)V99 COMP.\n")))


@query("SELECT l_orderkey, CAST(l_discount AS FLOAT) AS disc FROM lineitem")
def comp1_float(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", enc.ieee(F.col("l_discount").cast("float"), 4).alias("raw"))
    return accepted(decode(x, layout("01 R.\n 05 DISC COMP-1.\n")))


@query("SELECT l_orderkey, l_discount AS disc FROM lineitem")
def comp2_double(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", enc.ieee(F.col("l_discount")).alias("raw"))
    return accepted(decode(x, layout("01 R.\n 05 DISC COMP-2.\n")))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS size FROM part")
def index_decode(spark, d):
    return table(spark, d, "part").select("p_partkey", codecs.unsigned_index(enc.binary(F.col("p_size"), 4)).value.cast("long").alias("size"))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(11,2)) AS bal FROM customer")
def zoned_overpunch(spark, d):
    x = table(spark, d, "customer").select("c_custkey", enc.text(enc.zoned(money("c_acctbal"), 11, 2), 11).alias("raw"))
    return accepted(decode(x, layout("01 R.\n 05 BAL PIC S9(9)V99.\n")))


@query("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(11,2)) AS bal FROM customer")
def zoned_sign_separate(spark, d):
    x = table(spark, d, "customer").select("c_custkey", enc.text(enc.zoned(money("c_acctbal"), 12, 2, separate="leading"), 12).alias("raw"))
    return accepted(decode(x, layout("01 R.\n 05 BAL PIC S9(9)V99 SIGN IS LEADING SEPARATE.\n")))


def _ebcdic(page: str) -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        c = table(spark, d, "customer").select("c_custkey", codecs.ebcdic_text(enc.text(F.col("c_name"), 25, page), page).value.alias("name"))
        p = table(spark, d, "part").select((F.col("p_partkey") + 1_000_000_000).alias("c_custkey"), codecs.ebcdic_text(enc.text(F.col("p_name"), 55, page), page).value.alias("name"))
        return c.unionAll(p)

    f.__name__ = f"ebcdic_text_{page}"
    query("SELECT c_custkey, rtrim(left(c_name, 25), ' ') AS name FROM customer UNION ALL SELECT p_partkey + 1000000000, rtrim(left(p_name, 55), ' ') FROM part")(f)


for _page in ("cp037", "cp273", "cp500", "cp1140"):
    _ebcdic(_page)


@query("SELECT CAST('cp037' AS VARCHAR) AS page, count(*) AS n FROM customer")
def code_page_guess(spark, d):
    c = customer_records(table(spark, d, "customer"))
    best = page_scores(c.select(F.expr("substring(raw, 5, 18)").alias("raw")), ("cp037", "latin-1")).orderBy(F.desc("score")).limit(1).select("page")
    return c.agg(F.count(F.lit(1)).alias("n")).join(best).select("page", "n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer")
def display_blank_null(spark, d):
    s = F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment"))
    t = layout("01 R.\n 05 SEGMENT PIC X(10).\n")
    return accepted(decode(table(spark, d, "customer").select("c_custkey", enc.text(s, 10).alias("raw")), t))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(9,2)) END AS total FROM orders")
def sentinel_null(spark, d):
    v = F.when(F.col("o_orderkey") % 7 == 0, F.lit("9999999.99").cast("decimal(9,2)")).otherwise(money("o_totalprice", 9))
    t = layout("01 R.\n 05 TOTAL PIC S9(7)V99 COMP-3.\n", sentinels={"TOTAL": ["9999999.990"]})
    return accepted(decode(table(spark, d, "orders").select("o_orderkey", enc.packed(v, 5, 2).alias("raw")), t))


# --- dates ------------------------------------------------------------------------------------------------------------

PATTERNS = {"YYYYMMDD": "yyyyMMdd", "YYMMDD": "yyMMdd", "YYYYDDD": "yyyyDDD", "YYDDD": "yyDDD", "MMDDYYYY": "MMddyyyy", "DDMMYYYY": "ddMMyyyy", "MMDDYY": "MMddyy", "DDMMYY": "ddMMyy", "YYYY-MM-DD": "yyyy-MM-dd", "MM/DD/YYYY": "MM/dd/yyyy", "DD/MM/YYYY": "dd/MM/yyyy", "YYYYMM": "yyyyMM"}


@query(
    "SELECT o_orderkey, fmt, CAST(CASE WHEN fmt = 'YYYYMM' THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS DATE) AS d FROM orders, (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in (*PATTERNS, "LILIAN"))
    + "]) AS fmt)"
)
def date_formats_long(spark, d):
    o = table(spark, d, "orders")
    said = {f: F.date_format("o_orderdate", p) for f, p in PATTERNS.items()} | {"LILIAN": (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1582-10-15").cast("date")) + 1).cast("string")}
    rows = F.array(*(F.struct(F.lit(f).alias("fmt"), codecs.date_of(x, f).alias("d")) for f, x in said.items()))
    return o.select("o_orderkey", F.inline(rows))


@query("SELECT o_orderkey, make_date(CASE WHEN o_orderkey % 100 <= 30 THEN 2000 ELSE 1900 END + o_orderkey % 100, 3, 15) AS d30, make_date(CASE WHEN o_orderkey % 100 <= 50 THEN 2000 ELSE 1900 END + o_orderkey % 100, 3, 15) AS d50 FROM orders")
def date_y2k_window(spark, d):
    yy = F.concat(F.lpad((F.col("o_orderkey") % 100).cast("string"), 2, "0"), F.lit("0315"))
    return table(spark, d, "orders").select("o_orderkey", codecs.date_of(yy, "YYMMDD", 30).alias("d30"), codecs.date_of(yy, "YYMMDD", 50).alias("d50"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders")
def date_invalid_null(spark, d):
    k = F.col("o_orderkey") % 3
    t = F.when(k == 0, F.date_format("o_orderdate", "yyyyMMdd")).when(k == 1, F.concat(F.year("o_orderdate").cast("string"), F.lit("0230"))).otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("1332")))
    return table(spark, d, "orders").select("o_orderkey", codecs.date_of(t, "YYYYMMDD").alias("d"))


@query("SELECT o_orderkey, CAST(make_date(CAST(year(o_orderdate) AS INT), 1, 1) + CAST(o_orderkey % 401 - 1 AS INT) AS DATE) AS d FROM orders")
def date_julian_overflow(spark, d):
    t = F.concat(F.year("o_orderdate").cast("string"), F.lpad((F.col("o_orderkey") % 401).cast("string"), 3, "0"))
    return table(spark, d, "orders").select("o_orderkey", codecs.date_of(t, "YYYYDDD").alias("d"))


# --- errors and routing -----------------------------------------------------------------------------------------------


def cut_customers(spark, d) -> DataFrame:
    c = customer_records(table(spark, d, "customer"))
    return c.withColumn("raw", F.when(F.col("c_custkey") % 10 == 0, F.expr("substring(raw, 1, 28)")).otherwise(F.col("raw")))


@query("SELECT col AS \"column\", count(*) AS n FROM customer, (SELECT unnest(['cust_bal', 'cust_segment']) AS col) WHERE c_custkey % 10 = 0 GROUP BY 1")
def short_record_errors(spark, d):
    rows = rejected(decode(cut_customers(spark, d), layout(CUSTOMER)))
    return rows.select(F.explode("errors").alias("e")).groupBy(F.col("e.column").alias("column")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(c_custkey AS INT) AS cust_key, c_name AS cust_name, CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_acctbal AS DECIMAL(11,2)) END AS cust_bal FROM customer")
def errors_as_nulls(spark, d):
    return decode(cut_customers(spark, d), layout(CUSTOMER), on_error="null").select("cust_key", "cust_name", "cust_bal")


@query("SELECT count(*) FILTER (c_custkey % 10 <> 0) AS n_ok, count(*) FILTER (c_custkey % 10 = 0) AS n_errors, CAST(sum(CASE WHEN c_custkey % 10 = 0 THEN 28 ELSE 44 END) AS BIGINT) AS n_bytes FROM customer")
def extraction_counters(spark, d):
    return reconcile.extraction_counts(decode(cut_customers(spark, d).withColumn("__raw", F.col("raw")), layout(CUSTOMER)))


@query(
    "SELECT 'cust_bal' AS \"column\", 24 AS byte_offset, 6 AS byte_length, 'ffffffffffff' AS raw_hex, 'invalid packed decimal' AS message, count(*) AS n FROM customer WHERE c_custkey % 7 = 0 HAVING count(*) > 0"
)
def error_facts(spark, d):
    """Where a bad field lies and its bytes."""
    bad = F.when(F.col("c_custkey") % 7 == 0, F.unhex(F.lit("FF" * 6))).otherwise(enc.packed(money("c_acctbal"), 6, 2))
    rows = rejected(decode(customer_records(table(spark, d, "customer"), balance=bad), layout(CUSTOMER)))
    return rows.select(F.inline("errors")).groupBy("column", "byte_offset", "byte_length", "raw_hex", "message").agg(F.count(F.lit(1)).alias("n"))


def mixed_records(spark, d) -> DataFrame:
    return order_records(table(spark, d, "orders")).select("raw").unionAll(line_records(table(spark, d, "lineitem")).select("raw"))


def routed_once(spark, d, default: str | None) -> DataFrame:
    """The mixed records, routed and written once by table, so that each table's decoding reads its own records only."""
    path = scratch(spark)
    rows = reshape.routed(mixed_records(spark, d), 0, 1, {"O": "order_rec", "L": "line_rec"}, default)
    rows.write.partitionBy("table_name").parquet(path)
    return spark.read.schema("raw binary, table_name string").parquet(path)


@query(
    "SELECT 'order_rec' AS table_name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(11,2))) AS DECIMAL(20,2)) AS total FROM orders "
    "UNION ALL SELECT 'line_rec', count(*), CAST(sum(CAST(l_extendedprice AS DECIMAL(13,2))) AS DECIMAL(20,2)) FROM lineitem"
)
def route_record_types(spark, d):
    rows = routed_once(spark, d, "order_rec")
    part = lambda t, c: accepted(decode(reshape.of_table(rows, t.name), t)).groupBy("table_name").agg(F.count(F.lit(1)).alias("n"), F.sum(c).cast("decimal(20,2)").alias("total"))
    return part(layout(ORDER), "ord_total").unionAll(part(layout(LINE), "ln_price"))


@query("SELECT CASE WHEN l_linenumber = 2 THEN 'line_rec' ELSE 'order_rec' END AS table_name, count(*) AS n FROM lineitem GROUP BY 1")
def route_default(spark, d):
    x = table(spark, d, "lineitem").select(enc.text(F.when(F.col("l_linenumber") == 2, "L").otherwise("Z"), 1).alias("raw"))
    return reshape.routed(x, 0, 1, {"O": "order_rec", "L": "line_rec"}, "order_rec").groupBy("table_name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT o_orderstatus AS status, count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(13,2))) AS DECIMAL(20,2)) AS revenue "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
)
def flagship(spark, d):
    """A mixed file: routed, decoded, lines joined to their orders, revenue by status."""
    rows = routed_once(spark, d, None)
    o = accepted(decode(reshape.of_table(rows, "order_rec"), layout(ORDER))).select("ord_key", "ord_status")
    x = accepted(decode(reshape.of_table(rows, "line_rec"), layout(LINE))).select("ln_ord", "ln_price")
    both = x.join(o, F.col("ln_ord") == F.col("ord_key"))
    return both.groupBy(F.col("ord_status").alias("status")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("ln_price").cast("decimal(20,2)").alias("revenue"))


# --- arrays and overlays ----------------------------------------------------------------------------------------------

CHILD_SQL = f"SELECT l_orderkey AS oo_key, CAST({NUMBERED} AS SMALLINT) AS occurrence_index, CAST(l_linenumber AS SMALLINT) AS ol_num, CAST(l_quantity AS DECIMAL(5,0)) AS ol_qty, CAST(l_extendedprice AS DECIMAL(13,2)) AS ol_price FROM lineitem"


def lines_of(spark, d, padded: bool) -> DataFrame:
    t = layout(ORDER_LINES)
    rows = reshape.child_rows(order_line_records(table(spark, d, "lineitem"), padded).select("raw"), t.arrays[0], [t.column("oo_key")], None if padded else t.column("oo_count"))
    return accepted(rows).where("ol_num > 0") if padded else accepted(rows)


@query(CHILD_SQL)
def occurs_child_rows(spark, d):
    """Fixed count: padding decodes to errors (no sign half byte) and is left out."""
    return lines_of(spark, d, True)


@query(CHILD_SQL)
def odo_child_rows(spark, d):
    return lines_of(spark, d, False)


@query("SELECT DISTINCT l_orderkey AS oo_key, 'end' AS oo_end FROM lineitem")
def odo_field_after_array(spark, d):
    """A field behind an array of varying size."""
    t = layout(ORDER_LINES_END)
    rows = order_line_records(table(spark, d, "lineitem")).select(joined(F.col("raw"), enc.text(F.lit("end"), 3)).alias("raw"))
    return accepted(decode(reshape.full_layout(rows, t), t)).select("oo_key", "oo_end")


@query("SELECT l_orderkey AS oo_key, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(13,2))) AS DECIMAL(20,2)) AS total FROM lineitem GROUP BY 1")
def occurs_array_agg(spark, d):
    t = layout(ORDER_LINES)
    rows = decode(order_line_records(table(spark, d, "lineitem")).withColumn("__raw", F.col("raw")), [t.column("oo_key"), t.column("oo_count")])
    items = reshape.element_structs(t.arrays[0], F.col("__raw"), F.col("oo_count"))
    total = F.aggregate(F.transform(items, lambda x: x["ol_price"]), F.lit(0).cast("decimal(20,2)"), lambda a, x: (a + x).cast("decimal(20,2)"))
    return rows.select("oo_key", F.size(items).cast("long").alias("n"), total.alias("total"))


@query(
    f"SELECT l_orderkey AS oo_key, max(CASE WHEN k = 1 THEN q END) AS ol_qty_1, max(CASE WHEN k = 2 THEN q END) AS ol_qty_2, max(CASE WHEN k = 3 THEN q END) AS ol_qty_3 "
    f"FROM (SELECT l_orderkey, CAST(l_quantity AS DECIMAL(5,0)) AS q, {NUMBERED} AS k FROM lineitem) GROUP BY 1"
)
def occurs_wide(spark, d):
    t = layout(ORDER_LINES)
    rows = order_line_records(table(spark, d, "lineitem"))
    wide = reshape.wide_columns(t.arrays[0], F.col("raw"), most=3)
    return rows.select(F.col("l_orderkey").alias("oo_key"), *wide).select("oo_key", "ol_qty_1", "ol_qty_2", "ol_qty_3")


@query(
    "SELECT event_id AS ev_id, event_type AS ev_type, CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(9,2)) END AS ev_amt, "
    "CASE WHEN event_type = 'error' THEN CAST(event_id % 100000000 AS INT) END AS ev_code FROM events"
)
def redefines_wide(spark, d):
    t = layout(EVENT, redefines="subtype")
    kind = codecs.ebcdic_text(codecs.slice_of(F.col("raw"), 8, 8)).value
    by = dict(zip(("purchase", "error"), t.overlays, strict=True))
    return event_records(table(spark, d, "events")).select(F.col("event_id").alias("ev_id"), kind.alias("ev_type"), *(c for k, o in by.items() for c in reshape.overlay_columns(o, F.col("raw"), when=kind == k)))


@query("SELECT event_id AS ev_id, CAST(value AS DECIMAL(9,2)) AS ev_amt FROM events WHERE event_type = 'purchase'")
def redefines_subtype(spark, d):
    schema = compile_copybook(EVENT, Options(redefines="subtype"), free=True)
    t = schema.table("event_rec_ev_purchase")
    rows = reshape.routed(event_records(table(spark, d, "events")).select("raw"), 8, 8, {"purchase": t.name}, None)
    return accepted(decode(rows, [t.column("ev_id"), t.column("ev_amt")])).drop("table_name")


@query("SELECT event_id AS ev_id, CAST(value AS DECIMAL(9,2)) AS amount FROM events WHERE event_type = 'purchase'")
def redefines_json(spark, d):
    t = layout(EVENT, redefines="json")
    rows = event_records(table(spark, d, "events").where("event_type = 'purchase'"))
    return rows.select(F.col("event_id").alias("ev_id"), F.get_json_object(reshape.overlay_json(t.overlays[0], F.col("raw")), "$.ev_amt").cast("decimal(9,2)").alias("amount"))


@query(
    "SELECT 'EV-TYPE' AS field, event_type AS value, CASE event_type WHEN 'purchase' THEN 'event_rec_ev_purchase' WHEN 'error' THEN 'event_rec_ev_error' ELSE 'event_rec' END AS table_name, "
    "count(*) AS n FROM events GROUP BY event_type"
)
def subtype_discriminator(spark, d):
    """The field that tells the overlays of events apart, found from their bytes, with the table of each value."""
    schema = compile_copybook(EVENT, Options(redefines="subtype"), free=True)
    t, rows = schema.tables[0], event_records(table(spark, d, "events")).select("raw")
    area = subtypes.areas(t)[0]
    found = subtypes.discriminator(rows, t, area)
    names = F.array(*(F.lit(x.name) for x in schema.tables))
    each = subtypes.judged(subtypes.costs(rows, t, area, [found.column]))
    return each.select(F.lit(found.column.source).alias("field"), "value", F.get(names, F.col("layout")).alias("table_name"), "n")


@query("SELECT count(*) FILTER (WHERE o_orderstatus NOT IN ('O', 'F')) AS n_bad FROM orders")
def level88_check(spark, d):
    check = load.Check("known", "ord_status", ("O", "F"))
    return orders(order_records(table(spark, d, "orders"))).agg(F.count_if(~check.holds()).alias("n_bad"))


# --- managed runs over files ------------------------------------------------------------------------------------------


def run_files(spark, d) -> str:
    """A folder of files of RUN_ORDER records, written by Spark."""
    number = lambda x, n: enc.zoned(x, n, signed=False)
    parts = [y for k in (1, 2, 3) for y in (number(F.col("o_custkey") + k, 9), number((F.col("o_orderkey") + k) % 1000, 3))]
    path = scratch(spark)
    rows = table(spark, d, "orders").select(F.concat(number(F.col("o_orderkey"), 9), "o_orderstatus", *parts, F.lit("file")).alias("value"))
    rows.write.option("lineSep", ";").text(path)
    return path


RUN_BOXES = """
01 RUN-BOXES.
   05 RB-KEY PIC 9(9).
   05 RB-STATUS PIC X.
      88 RB-KNOWN VALUE 'O' 'F'.
   05 RB-BOX OCCURS 2 TIMES.
      10 BX-NO PIC 9(3).
      10 BX-COUNT PIC 9.
      10 BX-ITEM OCCURS 3 TIMES.
         15 IT-PART PIC 9(9).
         15 IT-QTY PIC 9(2).
   05 FILLER PIC X.
"""
BOXES = "orders, (SELECT unnest([1, 2]) AS i), (SELECT unnest([1, 2, 3]) AS j)"


@query(
    "SELECT CAST(o_orderkey AS INT) AS rb_key, CAST(i AS SMALLINT) AS occurrence_index, CAST(j AS SMALLINT) AS occurrence_index_2, CAST(o_custkey + 10 * i + j AS INT) AS it_part, "
    f"CAST((o_orderkey + j) % 100 AS SMALLINT) AS it_qty FROM {BOXES} WHERE o_orderstatus IN ('O', 'F')"
)
def run_nested_arrays(spark, d):
    """Arrays inside arrays as tables of their own, loaded with their parents."""
    number = lambda x, n: enc.zoned(x, n, signed=False)
    item = lambda i, j: (number(F.col("o_custkey") + (10 * i + j), 9), number((F.col("o_orderkey") + j) % 100, 2))
    box = lambda i: (number(F.lit(i), 3), number(F.lit(3), 1), *(x for j in (1, 2, 3) for x in item(i, j)))
    files, folder = scratch(spark), scratch(spark)
    rows = table(spark, d, "orders").select(F.concat(number(F.col("o_orderkey"), 9), "o_orderstatus", *box(1), *box(2)).alias("value"))
    rows.write.option("lineSep", ";").text(files)
    config = engine.RunConfig("boxes", RUN_BOXES, [engine.Source(files)], f"{folder}/target", f"{folder}/state", decoding=DecodeOptions(ascii=True), free=True)
    engine.run(spark, config)
    return spark.read.parquet(f"{config.target}/run_boxes_rb_box_bx_item")


RUN_KINDS = """
01 RUN-KINDS.
   05 RK-KEY PIC 9(9).
   05 RK-YEAR PIC 9(4).
   05 RK-KIND PIC X.
   05 RK-BODY PIC X(10).
   05 RK-PRICE REDEFINES RK-BODY.
      10 RK-TOTAL PIC 9(8)V99.
   05 RK-DONE REDEFINES RK-BODY.
      10 RK-DATE PIC 9(8).
      10 RK-MARK PIC X(2).
   05 FILLER PIC X.
"""


@query(
    "SELECT CASE o_orderstatus WHEN 'F' THEN 'run_kinds_rk_price' WHEN 'P' THEN 'run_kinds_rk_done' ELSE 'run_kinds' END AS table_name, CAST(o_orderkey AS INT) AS rk_key, "
    "CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN trim(substr(o_orderpriority, 1, 10)) END AS rk_body, CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(10,2)) END AS rk_total, "
    "CASE WHEN o_orderstatus = 'P' THEN CAST(strftime(o_orderdate, '%Y%m%d') AS INT) END AS rk_date FROM orders"
)
def run_subtypes(spark, d):
    """A run that finds by itself which records have which layout, and loads the tables of the overlays."""
    number = lambda x, n: enc.zoned(x, n, signed=False)
    status, files, folder = F.col("o_orderstatus"), scratch(spark), scratch(spark)
    body = F.when(status == "F", F.lpad((money("o_totalprice", 10) * 100).cast("long").cast("string"), 10, "0"))
    body = body.when(status == "P", F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("ok"))).otherwise(F.rpad(F.substring("o_orderpriority", 1, 10), 10, " "))
    rows = table(spark, d, "orders").select(F.concat(number(F.col("o_orderkey"), 9), F.date_format("o_orderdate", "yyyy"), status, body).alias("value"))
    rows.write.option("lineSep", ";").text(files)
    config = engine.RunConfig("kinds", RUN_KINDS, [engine.Source(files, discriminate=True)], f"{folder}/target", f"{folder}/state", options=Options(redefines="subtype"), decoding=DecodeOptions(ascii=True), free=True)
    engine.run(spark, config)
    names = ("run_kinds", "run_kinds_rk_price", "run_kinds_rk_done")
    parts = [spark.read.parquet(f"{config.target}/{x}").withColumn("table_name", F.lit(x)) for x in names]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select("table_name", "rk_key", "rk_body", "rk_total", "rk_date")


def ran(spark, d, **options) -> tuple[engine.RunConfig, str]:
    folder = scratch(spark)
    config = engine.RunConfig("orders", RUN_ORDER, [engine.Source(run_files(spark, d))], f"{folder}/target", f"{folder}/state", options=Options(**options), decoding=DecodeOptions(ascii=True), free=True)
    return config, engine.run(spark, config)


RUN_PARTS = "SELECT CAST(o_orderkey AS INT) AS ro_key, CAST(k AS SMALLINT) AS occurrence_index, CAST(o_custkey + k AS INT) AS rp_part, CAST((o_orderkey + k) % 1000 AS SMALLINT) AS rp_qty FROM orders, (SELECT unnest([1, 2, 3]) AS k)"


@query("SELECT CAST(o_orderkey AS INT) AS ro_key, o_orderstatus AS ro_status, CAST(o_custkey + 1 AS INT) AS first_part FROM orders")
def fixed_split_scan(spark, d):
    """Files of fixed records, split between tasks."""
    t = compile_copybook(RUN_ORDER, Options(occurs="wide"), free=True).tables[0]
    rows = records.read_records(spark, run_files(spark, d), "F", t.record_length)
    return accepted(decode(rows, t, DecodeOptions(ascii=True))).select("ro_key", "ro_status", F.col("rp_part_1").alias("first_part"))


@query("SELECT CAST(o_orderkey AS INT) AS ro_key, o_orderstatus AS ro_status, 'file' AS ro_file FROM orders WHERE o_orderstatus IN ('O', 'F')")
def run_main_table(spark, d):
    config, _ = ran(spark, d)
    return spark.read.parquet(f"{config.target}/run_order")


@query(RUN_PARTS + " WHERE o_orderstatus IN ('O', 'F')")
def run_child_table(spark, d):
    config, _ = ran(spark, d)
    return spark.read.parquet(f"{config.target}/run_order_ro_parts")


@query("SELECT CAST(0 AS BIGINT) AS orphans, CAST(3 * count(*) FILTER (o_orderstatus IN ('O', 'F')) AS BIGINT) AS children, CAST(3 * count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS BIGINT) AS refused FROM orders")
def run_foreign_keys(spark, d):
    """Rows of a run's child table without a parent, and children that were refused with theirs."""
    config, run_id = ran(spark, d)
    parents, children = (spark.read.parquet(f"{config.target}/{t}") for t in ("run_order", "run_order_ro_parts"))
    log = state.Store(spark, config.state).rows("rejection_log").where((F.col("run_id") == run_id) & F.col("error_message").startswith("run_order: "))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(children.join(parents, "ro_key", "left_anti"), "orphans").crossJoin(n(children, "children")).crossJoin(n(log, "refused"))


@query(f"SELECT ro_key, CAST(count(*) AS INT) AS n, CAST(sum(rp_part) AS BIGINT) AS parts FROM ({RUN_PARTS}) JOIN orders ON o_orderkey = ro_key WHERE o_orderstatus IN ('O', 'F') GROUP BY ro_key")
def run_json_column(spark, d):
    config, _ = ran(spark, d, occurs="json")
    parts = F.from_json("ro_parts_array", "array<struct<rp_part: int, rp_qty: smallint>>")
    rows = spark.read.parquet(f"{config.target}/run_order").withColumn("parts", parts)
    return rows.select("ro_key", F.size("parts").alias("n"), F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["rp_part"]).alias("parts"))


@query(
    "SELECT 'load' AS error_type, k || 'check chk_run_order_ro_status' AS error_message, n * count(*) AS n, CAST(n * sum(o_orderkey) AS BIGINT) AS keys "
    "FROM orders, (SELECT unnest(['', 'run_order: ']) AS k, unnest([1, 3]) AS n) WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY k, n"
)
def run_refusals(spark, d):
    config, run_id = ran(spark, d)
    log = state.Store(spark, config.state).rows("rejection_log").where(F.col("run_id") == run_id)
    key = F.get_json_object("decoded_partial", "$.ro_key").cast("long")
    return log.groupBy("error_type", "error_message").agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("keys"))


@query(
    'SELECT k AS "check", t AS table_name, CASE WHEN k = \'rejection_rate\' THEN (SELECT count(*) FILTER (o_orderstatus NOT IN (\'O\', \'F\')) < 0.01 * count(*) FROM orders) ELSE true END AS passed '
    "FROM (SELECT unnest(['row_count', 'rejection_rate', 'completed', 'in_target']) AS k), (SELECT unnest(['run_order', 'run_order_ro_parts']) AS t)"
)
def run_validation(spark, d):
    config, run_id = ran(spark, d)
    return engine.validate(spark, config, run_id)


@query("SELECT 'table_progress' AS event, 2 AS n, (SELECT 4 * count(*) FILTER (o_orderstatus IN ('O', 'F')) FROM orders) AS loaded UNION ALL SELECT 'run_complete', 1, 0")
def run_progress(spark, d):
    config, run_id = ran(spark, d)
    events = state.Store(spark, config.state).rows("progress_events").where(F.col("run_id") == run_id)
    return events.groupBy("event").agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("rows_loaded").alias("loaded"))


@query("SELECT CAST(n_nationkey AS SMALLINT) AS na_key, n_name AS na_name, CAST(n_regionkey AS SMALLINT) AS na_region FROM nation")
def delimited_scan_nation(spark, d):
    t = layout("01 NATION.\n 05 NA-KEY PIC 9(4).\n 05 NA-NAME PIC X(25).\n 05 NA-REGION PIC 9(4).\n")
    path = scratch(spark)
    table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").write.csv(path)
    return accepted(tables.delimited(spark, path, t))


@query("SELECT o_orderkey AS ord_key, o_orderstatus AS ord_status, CAST(o_totalprice AS DECIMAL(11,2)) AS ord_total FROM orders")
def unload_scan_orders(spark, d):
    content = records.as_files(order_records(table(spark, d, "orders")), "o_orderkey", 4000, records.described())
    return accepted(tables.unloaded(content, layout(ORDER))).select("ord_key", "ord_status", "ord_total")


PAGES = ("cp037", "cp273", "cp277", "cp278", "cp280", "cp284", "cp285", "cp290", "cp297", "cp420", "cp500", "cp870", "cp875", "cp1047", "cp1140", "cp1141", "cp1142", "cp1143", "cp1144", "cp1145", "cp1146", "cp1147", "cp1148", "cp1149")


@query("SELECT p AS page, n_name AS name FROM nation, (SELECT unnest([" + ", ".join(f"'{p}'" for p in PAGES) + "]) AS p)")
def ebcdic_text_all_pages(spark, d):
    """Names written in and read from each code page: their capitals lie at other places than ASCII's in all of them."""
    n = table(spark, d, "nation")
    one = lambda p: n.select(F.lit(p).alias("page"), codecs.ebcdic_text(enc.text(F.col("n_name"), 25, p), p).value.alias("name"))
    out = one(PAGES[0])
    for p in PAGES[1:]:
        out = out.unionAll(one(p))
    return out


def national(page: str) -> str:
    """What a code page has beside plain letters and digits, some more often than others: national letters, signs."""
    return "".join(c * (ord(c) % 5 + 1) for c in sorted(set(codecs.code_page(page))) if c.isprintable() and c not in " \ufffd" and not (c.isascii() and c.isalnum()))


@query("SELECT p AS page, p AS best, count(*) AS n FROM nation, (SELECT unnest([" + ", ".join(f"'{p}'" for p in PAGES) + "]) AS p) GROUP BY p")
def code_page_ranking(spark, d):
    """Texts in each of the pages, recognised among all of them by one histogram of bytes for each."""
    n, texts = table(spark, d, "nation"), {p: national(p) for p in PAGES}
    one = lambda p: n.select(F.lit(p).alias("page"), enc.text(F.concat(F.col("n_name"), F.lit(texts[p])), 40 + len(texts[p]), p).alias("raw"))
    rows = reduce(DataFrame.unionAll, map(one, PAGES))
    names = Counter("".join(r.n_name.ljust(40) for r in n.select("n_name").collect()))  # 25 names of nations
    out = []
    for r in byte_histogram(rows, "page").join(rows.groupBy("page").count(), "page").collect():  # a row for each page
        expected = names + Counter({c: k * 25 for c, k in Counter(texts[r.page]).items()})
        ranking = page_ranking(r.counts, PAGES, expected)
        out.append((r.page, ",".join(p for p, x in ranking if x == ranking[0][1]), r["count"]))
    return spark.createDataFrame(out, "page string, best string, n long")


@query("SELECT o_orderkey AS ok, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'old' END AS status, CAST(o_custkey AS BIGINT) AS cust FROM orders")
def database_load(spark, d):
    """Orders appended to a database, some of them merged again, one load twice. The database is Derby in the driver's memory,
    so this query runs in local sessions."""
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("Derby's memory is the driver's alone")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    with database.connected(spark, url, {}) as c:
        database.execute(c, 'CREATE TABLE orders ("ok" BIGINT NOT NULL PRIMARY KEY, "status" VARCHAR(3), "cust" BIGINT)')
        c.commit()
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("ok"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("long").alias("cust"))
    for _ in range(2):
        database.load_database(o.withColumn("status", F.lit("old")), url, "orders", "first")
    database.load_database(o.where("ok % 3 = 0"), url, "orders", "second", "upsert", ["ok"])
    return spark.read.format("jdbc").options(url=url, dbtable="orders").load()


@query("SELECT count(*) FILTER (o_orderstatus IN ('O', 'F')) AS loaded, count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) AS rejected FROM orders")
def load_stats(spark, d):
    """What a load says of itself: one row, counted while it writes."""
    stats = load.load(orders(order_records(table(spark, d, "orders"))), scratch(spark), "append", ["ord_key"], (load.Check("known", "ord_status", ("O", "F")),))
    return spark.createDataFrame([(stats["loaded"], stats["rejected"])], "loaded long, rejected long")


# --- loading ----------------------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder for a query's tables, below the folder the cluster shares; a local session may have one of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-load-')}/copperleaf-{uuid.uuid4().hex}"


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_keys FROM (SELECT c_custkey FROM customer UNION ALL SELECT c_custkey FROM customer)")
def load_append(spark, d):
    path, rows = scratch(spark), customers(customer_records(table(spark, d, "customer")))
    for _ in range(2):
        load.load(rows, path, "append")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cust_key").alias("n_keys"))


@query(f"SELECT {CUSTOMER_SQL} FROM customer WHERE c_custkey % 2 = 0")
def load_truncate(spark, d):
    path, c = scratch(spark), table(spark, d, "customer")
    load.load(customers(customer_records(c)), path)
    load.load(customers(customer_records(c.where("c_custkey % 2 = 0"))), path)
    return spark.read.parquet(path)


@query(
    "SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN CAST(c_acctbal AS DECIMAL(12,2)) + 1 ELSE CAST(c_acctbal AS DECIMAL(12,2)) END AS DECIMAL(13,2)) AS bal "
    "FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0"
)
def load_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", money("c_acctbal", 12).alias("bal"))
    out = load.upserted(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("bal", F.col("bal") + 1), ["c_custkey"])
    return out.withColumn("bal", F.col("bal").cast("decimal(13,2)"))


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS DECIMAL(5,0)) AS qty FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber "
    "ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem) WHERE k = 1"
)
def load_upsert_last_wins(spark, d):
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", money("l_quantity", 5, 0).alias("qty"))
    return load.upserted(x.limit(0), x, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "qty"])


@query(
    "SELECT coalesce(reason, 'loaded') AS reason, count(*) AS n FROM (SELECT CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'check flag' "
    "WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_returnflag IN ('A', 'N') ORDER BY l_partkey, l_suppkey) > 1 THEN 'duplicate key' END AS reason FROM lineitem) GROUP BY 1"
)
def bisect_rejects(spark, d):
    rows = load.judged(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], (load.Check("flag", "l_returnflag", ("A", "N")),), ["l_partkey", "l_suppkey"])
    return rows.groupBy(F.coalesce("reject_reason", F.lit("loaded")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- state and validation ---------------------------------------------------------------------------------------------


def states(spark, d) -> DataFrame:
    """An order is a table state of its customer's run: 100 rows extracted, key % 5 of them rejected."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "failed").otherwise("running")
    return o.select(
        F.col("o_custkey").alias("run_id"), (k % 3).alias("project_id"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("table_name"), F.sha2(k.cast("string"), 256).alias("source_checksum"), status.alias("status"), k.alias("id"),
        F.lit(100).cast("long").alias("rows_extracted"), F.when(k % 11 == 0, None).otherwise(100 - k % 5).alias("rows_loaded"), (k % 5).alias("rows_rejected"),
        F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("make_dt_interval(0, 0, 1, 0)")).alias("finished_at"),
    )


@query(
    "SELECT o_custkey AS run_id, CAST(100 * count(*) AS BIGINT) AS rows_extracted, CAST(coalesce(sum(CASE WHEN o_orderkey % 11 <> 0 THEN 100 - o_orderkey % 5 END), 0) AS BIGINT) AS rows_loaded, "
    "CAST(sum(o_orderkey % 5) AS BIGINT) AS rows_rejected, count(*) AS tables, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, "
    "CAST(date_diff('second', min(o_orderdate), max(o_orderdate)) + 60 AS BIGINT) AS elapsed_s FROM orders GROUP BY 1"
)
def state_run_summary(spark, d):
    return state.run_summary(states(spark, d))


@query(
    "SELECT t AS table_name, n FROM (SELECT 'projects' AS t, count(*) AS n FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 'migration_runs', count(*) FROM customer WHERE c_nationkey <> 3 "
    "UNION ALL SELECT 'table_migration_states', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3))"
)
def state_cascade_delete(spark, d):
    """Nations as projects, customers as their runs, orders as the runs' tables: one project goes with all it owns."""
    text = lambda c: F.col(c).cast("string")
    tables_ = {
        "projects": table(spark, d, "nation").select(text("n_nationkey").alias("id")),
        "migration_runs": table(spark, d, "customer").select(text("c_custkey").alias("id"), text("c_nationkey").alias("project_id")),
        "table_migration_states": table(spark, d, "orders").select(text("o_orderkey").alias("id"), text("o_custkey").alias("run_id")),
    }
    out = None
    for name, rows in state.without(tables_, "projects", "3").items():
        own = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = own if out is None else out.unionAll(own)
    return out


@query("SELECT o_orderkey AS run_number FROM orders WHERE o_custkey % 10 = 3 ORDER BY o_orderkey DESC LIMIT 5")
def state_recent_runs(spark, d):
    o = table(spark, d, "orders")
    runs = o.select((F.col("o_custkey") % 10).cast("string").alias("project_id"), F.col("o_orderkey").alias("run_number"), F.col("o_orderdate").alias("started_at"))
    return state.recent_runs(runs, "3").select("run_number")


@query("SELECT c_custkey AS project_id, coalesce(max(o_orderkey), 0) + 1 AS next_number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def state_next_run_number(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_number"))
    return state.next_run_numbers(runs, table(spark, d, "customer").select(F.col("c_custkey").alias("project_id")))


@query("SELECT o_orderkey % 3 AS project_id, 't' || CAST(o_orderkey % 7 AS VARCHAR) AS table_name, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def state_skip_loaded(spark, d):
    s = states(spark, d)
    return state.not_loaded(s.select("project_id", "table_name", F.col("source_checksum").alias("checksum"), "id"), s).select("project_id", "table_name", "id")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS id, 'A' AS run_id, CAST(l_linenumber AS BIGINT) AS source_line_num, l_shipdate AS created_at FROM lineitem WHERE l_returnflag = 'A' ORDER BY created_at, source_line_num, id LIMIT 200")
def state_rejections_page(spark, d):
    x = table(spark, d, "lineitem")
    log = x.select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("run_id"), F.col("l_linenumber").cast("long").alias("source_line_num"), F.col("l_shipdate").alias("created_at"))
    return state.rejections_page(log, "A")


@query("SELECT o_custkey AS run_id, CAST(round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*)) AS INT) AS percent FROM orders GROUP BY 1")
def state_progress(spark, d):
    return state.progress(states(spark, d))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 5 = 100 ELSE true END AS passed FROM orders")
def validate_row_count(spark, d):
    return reconcile.count_check(states(spark, d)).select("id", "passed")


@query("SELECT o_orderkey AS id, printf('%.2f%%', 100.0 * (o_orderkey % 5) / 100) AS rate_text, (o_orderkey % 5) / 100.0 < 0.01 AS passed FROM orders")
def validate_rejection_rate(spark, d):
    return reconcile.rate_check(states(spark, d)).select("id", "rate_text", "passed")


@query("SELECT o_custkey AS run_id, bool_and(o_orderkey % 11 <> 0) AS all_passed FROM orders GROUP BY 1")
def validate_all_passed(spark, d):
    return reconcile.all_passed(reconcile.count_check(states(spark, d)), "run_id")


RECON = {"ln_qty": ("l_quantity", "DECIMAL(20,2)"), "ln_price": ("l_extendedprice", "DECIMAL(20,2)"), "ln_tax": ("l_tax", "DECIMAL(20,2)")}


def decoded_lines(spark, d) -> DataFrame:
    return accepted(decode(line_records(table(spark, d, "lineitem")), layout(LINE)))


def source_lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("ln_ord"), *(money(c, 13).alias(k) for k, (c, _) in RECON.items()))


@query(
    " UNION ALL ".join(
        f"SELECT '{k}' AS column_name, count(*) AS n, CAST(sum(CAST({c} AS DECIMAL(20,2))) AS DECIMAL(38,2)) AS total, min(CAST({c} AS DECIMAL(20,2))) AS least, max(CAST({c} AS DECIMAL(20,2))) AS most, count(DISTINCT {c}) AS n_distinct, true AS passed FROM lineitem"
        for k, (c, _) in RECON.items()
    )
)
def recon_aggregates(spark, d):
    path = scratch(spark)
    load.load(decoded_lines(spark, d).select(*RECON), path)
    return reconcile.aggregates_check(source_lines(spark, d), spark.read.parquet(path), RECON).select("column_name", "n", "total", "least", "most", "n_distinct", "passed")


@query("SELECT count(*) AS n_sampled, CAST(0 AS BIGINT) AS n_different FROM orders WHERE o_orderkey % 97 = 0")
def recon_sample(spark, d):
    o = table(spark, d, "orders")
    source = o.select(F.col("o_orderkey").alias("ord_key"), F.col("o_custkey").cast("int").alias("ord_cust"), F.col("o_orderstatus").alias("ord_status"), money("o_totalprice").alias("ord_total"), F.col("o_orderdate").cast("date").alias("ord_date"), F.col("o_orderpriority").alias("ord_prio"))
    return reconcile.sample_check(source, orders(order_records(o)), "ord_key")


@query("SELECT count(*) AS n_keys, true AS inside, true AS whole, count(*) FILTER (o_orderkey % 40 = 0) AS n_wrong FROM orders")
def recon_confidence(spark, d):
    """Orders with wrong totals planted in a target: a sample's interval holds their share, a margin of 0 compares all rows."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k"), "o_orderstatus", money("o_totalprice"))
    wrong = F.when(F.col("k") % 40 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    target = o.withColumn("o_totalprice", wrong.cast(o.schema["o_totalprice"].dataType))
    part = reconcile.confidence_check(o, target, ["k"], 0.9999, 0.02, 0.03)
    every = reconcile.confidence_check(o, target, ["k"], margin=1e-9)
    share = F.col("n_wrong") / F.col("n_keys")
    both = part.select("low", "high").crossJoin(every.select("n_keys", (F.col("n_sampled") == F.col("n_keys")).alias("whole"), F.col("n_different").alias("n_wrong")))  # a row each
    return both.select("n_keys", ((F.col("low") <= share) & (share <= F.col("high"))).alias("inside"), "whole", "n_wrong")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey % 11 = 0")
def recon_orphans(spark, d):
    o = table(spark, d, "orders").where("o_orderkey % 11 <> 0")
    return reconcile.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), o, [("l_orderkey", "o_orderkey")])


@query(
    "SELECT 'no total' AS rule, count(*) FILTER (WHERE o_totalprice <= 0) AS n_broken, count(*) FILTER (WHERE o_totalprice <= 0) = 0 AS passed FROM orders "
    "UNION ALL SELECT 'partly shipped', count(*) FILTER (WHERE o_orderstatus = 'P'), count(*) FILTER (WHERE o_orderstatus = 'P') = 0 FROM orders "
    "UNION ALL SELECT 'early', count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01'), count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1996-01-01') = 0 FROM orders"
)
def recon_business_rules(spark, d):
    return reconcile.rule_counts(table(spark, d, "orders"), {"no total": "o_totalprice <= 0", "partly shipped": "o_orderstatus = 'P'", "early": "o_orderdate < timestamp '1996-01-01'"})


@query("SELECT 'cust_bal' AS column_name, count(*) FILTER (WHERE c_custkey % 10 = 0) AS n_null FROM customer UNION ALL SELECT 'cust_name', 0 FROM customer LIMIT 2")
def recon_nulls(spark, d):
    return reconcile.null_counts(decode(cut_customers(spark, d), layout(CUSTOMER), on_error="null").select("cust_bal", "cust_name"))


ORACLES["recon_nulls"] = "SELECT 'cust_bal' AS column_name, count(*) FILTER (WHERE c_custkey % 10 = 0) AS n_null FROM customer UNION ALL SELECT 'cust_name', count(*) FILTER (WHERE false) FROM customer"


# --- transformations --------------------------------------------------------------------------------------------------


def _xform(name: str, rules: list[dict], sql: str, columns: str, of: str = "orders") -> None:
    def f(spark: SparkSession, d: str) -> DataFrame:
        return transform.transformed(table(spark, d, of).select(*columns.split()), rules)

    f.__name__ = f"xform_{name}"
    query(sql)(f)


_xform("rename", [{"rule": "rename", "column": "o_orderstatus", "to": "status"}], "SELECT o_orderkey, o_orderstatus AS status FROM orders", "o_orderkey o_orderstatus")
_xform("type_cast", [{"rule": "type_cast", "column": "o_totalprice", "to": "decimal(12,1)"}], "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS DECIMAL(12,1)) AS o_totalprice FROM orders", "o_orderkey o_totalprice")
_xform("lookup", [{"rule": "lookup", "column": "o_orderstatus", "values": {"O": "open", "F": "done"}, "default": "?"}], "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE '?' END AS o_orderstatus FROM orders", "o_orderkey o_orderstatus")
_xform("computed", [{"rule": "computed", "to": "twice", "expression": "o_orderkey * 2"}], "SELECT o_orderkey, o_orderkey * 2 AS twice FROM orders", "o_orderkey")
_xform("split", [{"rule": "split", "column": "o_orderpriority", "separator": "-", "to": ["p1", "p2"]}], "SELECT o_orderkey, o_orderpriority, string_split(o_orderpriority, '-')[1] AS p1, string_split(o_orderpriority, '-')[2] AS p2 FROM orders", "o_orderkey o_orderpriority")
_xform("merge", [{"rule": "merge", "columns": ["o_orderstatus", "o_orderpriority"], "separator": "/", "to": "both"}], "SELECT o_orderkey, o_orderstatus, o_orderpriority, concat_ws('/', o_orderstatus, o_orderpriority) AS both FROM orders", "o_orderkey o_orderstatus o_orderpriority")
_xform("regex_replace", [{"rule": "regex_replace", "column": "o_orderpriority", "pattern": "[0-9]+-", "by": "#"}], "SELECT o_orderkey, regexp_replace(o_orderpriority, '[0-9]+-', '#', 'g') AS o_orderpriority FROM orders", "o_orderkey o_orderpriority")
_xform("sentinel_null", [{"rule": "sentinel_null", "column": "c_mktsegment", "sentinels": ["BUILDING"]}], "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment FROM customer", "c_custkey c_mktsegment", "customer")
_xform("constant", [{"rule": "constant", "to": "origin", "value": "legacy"}], "SELECT c_custkey, 'legacy' AS origin FROM customer", "c_custkey", "customer")
_xform("drop", [{"rule": "drop", "columns": ["c_name"]}], "SELECT c_custkey, c_nationkey FROM customer", "c_custkey c_name c_nationkey", "customer")


@query("SELECT c_custkey, c_nationkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def xform_lookup_table(spark, d):
    return transform.lookup_table(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", table(spark, d, "nation"), "n_nationkey", "n_name", "nation")


# --- streams ----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def stream_latest_event(spark, d):
    """events as a change stream: the latest row of each user, batch by batch."""
    folder = scratch(spark)
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parq*").select("user_id", "event_id", "event_type", "ts")
    incremental.apply_changes(spark, stream, f"{folder}/table", "user_id", ["ts", "event_id"], f"{folder}/state")
    return incremental.current(spark, f"{folder}/table").select("user_id", "event_id", "event_type")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def stream_new_files(spark, d):
    """Files that arrive, by checksum: a second look at the folder brings none of them again."""
    files, folder = run_files(spark, d), scratch(spark)
    t = compile_copybook(RUN_ORDER, free=True).tables[0]

    def each(content: DataFrame) -> None:
        accepted(decode(records.fixed(content, t.record_length), t, DecodeOptions(ascii=True))).write.mode("append").parquet(f"{folder}/rows")

    for _ in range(2):
        incremental.new_files(spark, files, f"{folder}/state", each, f"{folder}/seen")
    return spark.read.parquet(f"{folder}/rows").agg(F.count(F.lit(1)).alias("n"), F.sum("ro_key").alias("keys"))


@query(
    "SELECT c_custkey AS cust, CASE WHEN op IS NULL THEN CAST(c_acctbal AS DECIMAL(14,2)) ELSE CAST(o_totalprice AS DECIMAL(14,2)) END AS bal FROM customer LEFT JOIN "
    "(SELECT o_custkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 THEN 'D' ELSE 'U' END AS op FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) "
    "ON o_custkey = c_custkey WHERE op IS NULL OR op <> 'D'"
)
def change_operations(spark, d):
    """Orders as changes of their customers, in batches out of order, one of them twice, merged on the way, then cut over."""
    t = ChangeTable(spark, scratch(spark), ["cust"], "pos", buckets=8)
    money = lambda c: F.col(c).cast("decimal(14,2)").alias("bal")
    t.baseline(table(spark, d, "customer").select(F.col("c_custkey").alias("cust"), money("c_acctbal")), 0)
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    op = F.when(F.col("o_orderkey") % 7 == 0, F.lit("D")).otherwise(F.lit("U"))
    changes = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").cast("int").alias("pos"), op.alias("op"), money("o_totalprice"))
    for number, part in enumerate((2, 0, 1)):
        for _ in range(2 if part == 0 else 1):
            t.apply(changes.where(F.col("pos") % 3 == part), number)
        if number == 1:
            t.merge()
    t.cut_over(changes.agg(F.max("pos")).first()[0])
    return t.current()
