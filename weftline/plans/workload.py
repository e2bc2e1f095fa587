"""The golden workload: select-project-join queries that end in ungrouped SUMs.

Each query is DataFrame code beside the SQL that gives the same row. Filters and
column lists reach the Parquet scans; join order and strategy are left to
Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.unsigned import as_unsigned, u64_gt, u64_lt, wrapping_sum
from weftline.operators.joins import many_to_many_sums, side_by_side, sums
from weftline.sources.shared import fresh_path
from weftline.sources.tables import binding, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return register


def total(sel: str, rest: str) -> str:
    """SELECT CAST(SUM(x) AS BIGINT) AS s0, ... rest."""
    return "SELECT " + ", ".join(f"CAST(SUM({x}) AS BIGINT) AS s{i}" for i, x in enumerate(sel.split())) + f" {rest}"


c = F.col


@query("w01_filter_eq", total("l_orderkey l_partkey", "FROM lineitem WHERE l_linenumber = 1"))
def w01(spark, sf):
    return sums(table(spark, sf, "lineitem").where(c("l_linenumber") == 1), "l_orderkey", "l_partkey")


@query("w02_filter_gt", total("l_partkey", "FROM lineitem WHERE l_orderkey > 700"))
def w02(spark, sf):
    return sums(table(spark, sf, "lineitem").where(c("l_orderkey") > 700), "l_partkey")


@query("w03_filter_lt", total("l_partkey l_suppkey", "FROM lineitem WHERE l_orderkey < 100"))
def w03(spark, sf):
    return sums(table(spark, sf, "lineitem").where(c("l_orderkey") < 100), "l_partkey", "l_suppkey")


@query("w04_filter_range", total("l_orderkey l_partkey", "FROM lineitem WHERE l_orderkey > 100 AND l_orderkey < 200"))
def w04(spark, sf):
    return sums(table(spark, sf, "lineitem").where((c("l_orderkey") > 100) & (c("l_orderkey") < 200)), "l_orderkey", "l_partkey")


@query("w05_empty", total("c_custkey c_nationkey", "FROM customer WHERE c_custkey < 0"))
def w05(spark, sf):
    return sums(table(spark, sf, "customer").where(c("c_custkey") < 0), "c_custkey", "c_nationkey")


@query("w06_contradiction", total("l_partkey", "FROM lineitem WHERE l_orderkey = 3 AND l_orderkey = 5"))
def w06(spark, sf):
    return sums(table(spark, sf, "lineitem").where((c("l_orderkey") == 3) & (c("l_orderkey") == 5)), "l_partkey")


@query("w07_same_row_eq", total("l_partkey", "FROM lineitem WHERE l_linenumber = l_suppkey"))
def w07(spark, sf):
    return sums(table(spark, sf, "lineitem").where(c("l_linenumber") == c("l_suppkey")), "l_partkey")


@query("w08_tautology", total("n_nationkey n_regionkey", "FROM nation WHERE n_nationkey = n_nationkey"))
def w08(spark, sf):
    return sums(table(spark, sf, "nation").where(c("n_nationkey").isNotNull()), "n_nationkey", "n_regionkey")


@query("w09_repeated_select", total("o_orderkey o_orderkey o_custkey", "FROM orders WHERE o_custkey = 7"))
def w09(spark, sf):
    return sums(table(spark, sf, "orders").where(c("o_custkey") == 7), "o_orderkey", "o_orderkey", "o_custkey")


@query("w10_join", total("l_partkey o_custkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey"))
def w10(spark, sf):
    return sums(table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey")), "l_partkey", "o_custkey")


@query("w11_join_filter", total("l_partkey o_custkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey > 100"))
def w11(spark, sf):
    orders = table(spark, sf, "orders").where(c("o_custkey") > 100)
    return sums(table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")), "l_partkey", "o_custkey")


@query("w12_join_two_filters", total("l_partkey o_custkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey > 100 AND o_custkey < 500"))
def w12(spark, sf):
    lines, orders = table(spark, sf, "lineitem").where(c("l_orderkey") > 100), table(spark, sf, "orders").where(c("o_custkey") < 500)
    return sums(lines.join(orders, c("l_orderkey") == c("o_orderkey")), "l_partkey", "o_custkey")


@query("w13_join_empty", total("l_partkey o_custkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey > 99999999"))
def w13(spark, sf):
    orders = table(spark, sf, "orders").where(c("o_custkey") > 99999999)
    return sums(table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")), "l_partkey", "o_custkey")


@query("w14_many_to_many", total("c_custkey s_suppkey", "FROM customer JOIN supplier ON c_nationkey = s_nationkey"))
def w14(spark, sf):
    return many_to_many_sums(table(spark, sf, "customer"), "c_nationkey", "c_custkey", table(spark, sf, "supplier"), "s_nationkey", "s_suppkey")


@query("w15_two_keys", total("l_orderkey p_size", "FROM lineitem JOIN part ON l_partkey = p_partkey AND l_linenumber = p_size"))
def w15(spark, sf):
    return sums(table(spark, sf, "lineitem").join(table(spark, sf, "part"), (c("l_partkey") == c("p_partkey")) & (c("l_linenumber") == c("p_size"))), "l_orderkey", "p_size")


@query("w16_repeated_predicate", total("o_orderkey c_nationkey", "FROM orders JOIN customer ON o_custkey = c_custkey AND o_custkey = c_custkey"))
def w16(spark, sf):
    return sums(table(spark, sf, "orders").join(table(spark, sf, "customer"), c("o_custkey") == c("c_custkey")), "o_orderkey", "c_nationkey")


CHAIN = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


def chain(spark, sf, customer=None):
    customer = table(spark, sf, "customer") if customer is None else customer
    orders = table(spark, sf, "orders").join(customer, c("o_custkey") == c("c_custkey"))
    return table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey"))


@query("w17_chain3", total("l_partkey o_custkey c_nationkey", f"{CHAIN} WHERE c_nationkey > 10"))
def w17(spark, sf):
    return sums(chain(spark, sf, table(spark, sf, "customer").where(c("c_nationkey") > 10)), "l_partkey", "o_custkey", "c_nationkey")


@query("w18_chain4", total("l_partkey o_custkey c_custkey n_nationkey", f"{CHAIN} JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2"))
def w18(spark, sf):
    customer = table(spark, sf, "customer").join(table(spark, sf, "nation").where(c("n_regionkey") == 2), c("c_nationkey") == c("n_nationkey"))
    return sums(chain(spark, sf, customer), "l_partkey", "o_custkey", "c_custkey", "n_nationkey")


@query("w19_chain5", total("l_partkey o_custkey c_custkey n_nationkey r_regionkey", f"{CHAIN} JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey > 1"))
def w19(spark, sf):
    nation = table(spark, sf, "nation").join(table(spark, sf, "region").where(c("r_regionkey") > 1), c("n_regionkey") == c("r_regionkey"))
    customer = table(spark, sf, "customer").join(nation, c("c_nationkey") == c("n_nationkey"))
    return sums(chain(spark, sf, customer), "l_partkey", "o_custkey", "c_custkey", "n_nationkey", "r_regionkey")


@query("w20_star", total("l_linenumber o_custkey p_size s_nationkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25"))
def w20(spark, sf):
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "part").where(c("p_size") > 25), c("l_partkey") == c("p_partkey"))
    lines = lines.join(table(spark, sf, "supplier"), c("l_suppkey") == c("s_suppkey"))
    return sums(lines.join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey")), "l_linenumber", "o_custkey", "p_size", "s_nationkey")


@query("w21_cycle", total("l_orderkey s_suppkey c_custkey", f"{CHAIN} JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey"))
def w21(spark, sf):
    return sums(chain(spark, sf).join(table(spark, sf, "supplier"), (c("l_suppkey") == c("s_suppkey")) & (c("s_nationkey") == c("c_nationkey"))), "l_orderkey", "s_suppkey", "c_custkey")


@query("w22_bushy", total("o_custkey n_regionkey", "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"))
def w22(spark, sf):
    left = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), c("l_orderkey") == c("o_orderkey"))
    right = table(spark, sf, "supplier").join(table(spark, sf, "nation"), c("s_nationkey") == c("n_nationkey"))
    return sums(left.join(right, c("l_suppkey") == c("s_suppkey")), "o_custkey", "n_regionkey")


@query("w23_self_join", total("a.n_regionkey b.n_nationkey", "FROM nation a JOIN nation b ON a.n_nationkey = b.n_regionkey"))
def w23(spark, sf):
    a, b = (binding(spark, sf, "nation", x, "n_nationkey", "n_regionkey") for x in "ab")
    return sums(a.join(b, c("a_n_nationkey") == c("b_n_regionkey")), "a_n_regionkey", "b_n_nationkey")


@query("w24_self_join_same_column", total("a.n_nationkey b.n_nationkey", "FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"))
def w24(spark, sf):
    a, b = (binding(spark, sf, "nation", x, "n_nationkey", "n_regionkey") for x in "ab")
    return many_to_many_sums(a, "a_n_regionkey", "a_n_nationkey", b, "b_n_regionkey", "b_n_nationkey")


@query("w25_self_join_filter", total("b.toxic a.doc_id", "FROM labels a JOIN labels b ON a.doc_id = b.doc_id WHERE a.quality = 1"))
def w25(spark, sf):
    a, b = binding(spark, sf, "labels", "a", "doc_id", "quality").where(c("a_quality") == 1), binding(spark, sf, "labels", "b", "doc_id", "toxic")
    return sums(a.join(b, c("a_doc_id") == c("b_doc_id")), "b_toxic", "a_doc_id")


@query("w26_components", "SELECT (SELECT CAST(SUM(c_custkey) AS BIGINT) FROM customer WHERE c_nationkey = 5) AS s0, (SELECT CAST(SUM(s_suppkey) AS BIGINT) FROM supplier WHERE s_nationkey < 3) AS s1")
def w26(spark, sf):
    return side_by_side(sums(table(spark, sf, "customer").where(c("c_nationkey") == 5), "c_custkey"), sums(table(spark, sf, "supplier").where(c("s_nationkey") < 3), "s_suppkey"))


@query("w27_unmentioned_binding", total("c_custkey", "FROM customer WHERE c_nationkey = 5"))
def w27(spark, sf):
    return sums(table(spark, sf, "customer").where(c("c_nationkey") == 5), "c_custkey")


@query(
    "w28_join_components",
    "SELECT (SELECT CAST(SUM(l_partkey) AS BIGINT) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey < 10) AS s0, (SELECT CAST(SUM(c_custkey) AS BIGINT) FROM customer JOIN nation ON c_nationkey = n_nationkey) AS s1",
)
def w28(spark, sf):
    one = table(spark, sf, "lineitem").join(table(spark, sf, "orders").where(c("o_custkey") < 10), c("l_orderkey") == c("o_orderkey"))
    two = table(spark, sf, "customer").join(table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    return side_by_side(sums(one, "l_partkey"), sums(two, "c_custkey"))


@query("w29_shared_column", total("o_orderkey event_id c_nationkey", "FROM orders JOIN events ON o_custkey = user_id JOIN customer ON user_id = c_custkey WHERE c_nationkey < 5"))
def w29(spark, sf):
    customer = table(spark, sf, "customer").where(c("c_nationkey") < 5)
    return sums(table(spark, sf, "orders").join(customer, c("o_custkey") == c("c_custkey")).join(table(spark, sf, "events"), c("o_custkey") == c("user_id")), "o_orderkey", "event_id", "c_nationkey")


@query("w30_other_tables", total("event_id vec_id", "FROM events JOIN embeddings ON user_id = vec_id WHERE label = 3"))
def w30(spark, sf):
    return sums(table(spark, sf, "events").join(table(spark, sf, "embeddings").where(c("label") == 3), c("user_id") == c("vec_id")), "event_id", "vec_id")


#: Every seventh line's key has its 64 bits flipped, so that values on both sides of 2^63 occur.
_FLIP_SQL = "CASE WHEN l_linenumber = 7 THEN 18446744073709551615 - CAST(l_orderkey AS HUGEINT) ELSE CAST(l_orderkey AS HUGEINT) END"


def _flipped(spark, sf):
    return table(spark, sf, "lineitem").select(F.when(c("l_linenumber") == 7, F.bitwise_not(c("l_orderkey"))).otherwise(c("l_orderkey")).alias("v"))


def _unsigned(df):
    return df.agg(as_unsigned(wrapping_sum(c("v"))).cast("string").alias("s0"), F.count("v").alias("n"))


def _unsigned_sql(where: str) -> str:
    return f"SELECT CAST(SUM(v) % 18446744073709551616 AS VARCHAR) AS s0, COUNT(v) AS n FROM (SELECT {_FLIP_SQL} AS v FROM lineitem) WHERE {where}"


@query("u01_unsigned_gt", _unsigned_sql("v > 1000"))
def u01(spark, sf):
    return _unsigned(_flipped(spark, sf).where(u64_gt(c("v"), 1000)))


@query("u02_unsigned_lt", _unsigned_sql("v < 1000"))
def u02(spark, sf):
    return _unsigned(_flipped(spark, sf).where(u64_lt(c("v"), 1000)))


@query("u03_binary_relation", _unsigned_sql("v >= 0"))
def u03(spark, sf):
    """The same column through the binary format: written by the tasks, read back by row ranges."""
    from weftline.sources.u64file import register

    register(spark)
    path = fresh_path(spark, "u64rel")
    _flipped(spark, sf).write.format("u64rel").mode("append").save(path)
    return _unsigned(spark.read.format("u64rel").load(path).withColumnRenamed("c0", "v"))
