"""The relational dialect that graded statements use, as DataFrame plans on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import query, table

REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2)"


@query("SELECT r_regionkey, r_name FROM region AS t1")
def r01_scan_alias(spark, sf):
    return table(spark, sf, "region").alias("t1").select("t1.r_regionkey", "t1.r_name")


@query("SELECT p_partkey, p_name, p_retailprice AS price FROM part")
def r02_projection(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.col("p_retailprice").alias("price"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def r03_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT max(l_quantity) AS max_q, min(l_quantity) AS min_q, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS sum_q, round(avg(l_quantity), 6) AS avg_q FROM lineitem")
def r04_aggregates(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").agg(F.max(q).alias("max_q"), F.min(q).alias("min_q"), F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"), F.round(F.sum(q), 2).alias("sum_q"), F.round(F.avg(q), 6).alias("avg_q"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice - l_tax, 4) AS minus, round(l_extendedprice + l_tax, 4) AS plus, round(l_quantity * l_tax, 4) AS times, round(l_extendedprice / l_quantity, 8) AS per_unit FROM lineitem WHERE l_quantity > 0")
def r05_arithmetic(spark, sf):
    r = F.round
    x, t, q = F.col("l_extendedprice"), F.col("l_tax"), F.col("l_quantity")
    return table(spark, sf, "lineitem").filter(q > 0).select("l_orderkey", "l_linenumber", r(x - t, 4).alias("minus"), r(x + t, 4).alias("plus"), r(q * t, 4).alias("times"), r(x / q, 8).alias("per_unit"))


@query("SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def r06_join_chain(spark, sf):
    # lines meet orders on one shuffle; customers and nations follow by size
    t = lambda n: table(spark, sf, n)
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    by_customer = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = by_customer.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.expr(REVENUE).alias("revenue"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def r07_left_join(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_orders"))


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def r07_full_join(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return c.join(s, (F.col("c_custkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")), "full").select("c_custkey", "s_suppkey")


@query("SELECT o_orderpriority, round(avg(d.spent), 4) AS avg_spent FROM (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey, o_orderpriority) AS d GROUP BY o_orderpriority")
def r08_derived_table(spark, sf):
    d = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("spent"))
    return d.groupBy("o_orderpriority").agg(F.round(F.avg("spent"), 4).alias("avg_spent"))


@query("SELECT p_partkey FROM part WHERE p_size > 40 AND p_retailprice < 1500 OR p_brand = 'Brand#17'")
def r09_and_or(spark, sf):
    return table(spark, sf, "part").filter((F.col("p_size") > 40) & (F.col("p_retailprice") < 1500) | (F.col("p_brand") == "Brand#17")).select("p_partkey")


@query("SELECT sum(CASE WHEN p_size = 10 THEN 1 ELSE 0 END)::BIGINT AS eq, sum(CASE WHEN p_size > 10 THEN 1 ELSE 0 END)::BIGINT AS gt, sum(CASE WHEN p_size < 10 THEN 1 ELSE 0 END)::BIGINT AS lt, sum(CASE WHEN p_size >= 10 THEN 1 ELSE 0 END)::BIGINT AS ge, sum(CASE WHEN p_size <= 10 THEN 1 ELSE 0 END)::BIGINT AS le, sum(CASE WHEN p_size != 10 THEN 1 ELSE 0 END)::BIGINT AS ne FROM part")
def r10_comparisons(spark, sf):
    s = F.col("p_size")
    tests = {"eq": s == 10, "gt": s > 10, "lt": s < 10, "ge": s >= 10, "le": s <= 10, "ne": s != 10}
    return table(spark, sf, "part").agg(*[F.count_if(t).alias(n) for n, t in tests.items()])


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
def r11_between(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_totalprice").between(1000, 50000)).select("o_orderkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def r12_in_semi(spark, sf):
    big = table(spark, sf, "orders").filter("o_totalprice > 200000")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000)")
def r12_not_in_anti(spark, sf):
    big = table(spark, sf, "orders").filter("o_orderstatus = 'F' AND o_totalprice > 100000 AND o_custkey IS NOT NULL")
    return table(spark, sf, "customer").join(big, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%red%' AND NOT lower(p_name) LIKE '%gadget%'")
def r13_like(spark, sf):
    n = F.col("p_name")
    return table(spark, sf, "part").filter(n.ilike("%red%") & ~n.ilike("%gadget%")).select("p_partkey", "p_name")


@query("SELECT count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def r14_is_null(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").filter("o_orderkey IS NULL").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def r15_scalar_subquery(spark, sf):
    o = table(spark, sf, "orders")
    o.createOrReplaceTempView("r15_orders")
    return spark.sql("SELECT o_orderkey FROM r15_orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM r15_orders)")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_orderstatus, o_orderpriority")
def r16_group_by(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20")
def r17_having(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 20")


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def r18_order_by(spark, sf):
    top = table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long"))


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7")
def r19_limit(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").limit(7)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1")
def r20_top1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(1)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def r21_union(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
def r21_intersect(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").filter("s_acctbal > 0").select("s_nationkey"))


@query("SELECT l_partkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part WHERE p_size < 45")
def r21_except(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")).subtract(table(spark, sf, "part").filter("p_size < 45").select("p_partkey"))


@query("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R')")
def r23_exists(spark, sf):
    back = table(spark, sf, "lineitem").filter("l_returnflag = 'R'")
    return table(spark, sf, "supplier").join(back, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("SELECT p_partkey, p_brand || '/' || p_type AS label FROM part")
def r24_concat(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("label"))
