"""Registered queries and their SQL twins. Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggs, arrays, expr
from ..operators import joins, ranking, sets
from ..operators.table import Table
from ..sources import io
from . import builtins  # noqa: F401  its queries are registered, too
from .base import ORACLES, QUERIES, query, read, rounded, scratch  # noqa: F401

LINE = ["l_orderkey", "l_linenumber"]
C = F.col


# selection and grouping
@query("select_where_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS revenue FROM lineitem WHERE l_quantity > 25 AND l_discount BETWEEN 0.03 AND 0.07")
def select_where_project(spark, d):
    t = Table(read(spark, d, "lineitem"))
    return t.select({"l_orderkey": C("l_orderkey"), "l_linenumber": C("l_linenumber"), "revenue": expr.mul(C("l_extendedprice"), expr.sub(1, C("l_discount")))}, where=(C("l_quantity") > 25) & C("l_discount").between(0.03, 0.07)).df


@query("groupby_single", "SELECT l_returnflag, sum(l_quantity) AS v FROM lineitem GROUP BY 1")
def groupby_single(spark, d):
    return Table(read(spark, d, "lineitem")).select({"v": aggs.sum_(C("l_quantity"))}, by="l_returnflag").df


@query("groupby_multi", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2")
def groupby_multi(spark, d):
    t = Table(read(spark, d, "lineitem"))
    return t.select({"sum_qty": aggs.sum_(C("l_quantity")), "revenue": rounded(aggs.sum_(C("l_extendedprice") * (1 - C("l_discount"))), 2), "n": aggs.count()}, where=C("l_quantity") > 25, by=["l_returnflag", "l_linestatus"]).df


@query("groupby_sum_avg", "SELECT l_partkey, sum(l_quantity) AS v1, round(avg(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY 1")
def groupby_sum_avg(spark, d):
    return Table(read(spark, d, "lineitem")).select({"v1": aggs.sum_(C("l_quantity")), "v3": rounded(aggs.avg(C("l_extendedprice")))}, by="l_partkey").df


@query("groupby_avgs", "SELECT l_linenumber, round(avg(l_quantity), 4) AS v1, round(avg(l_discount), 4) AS v2, round(avg(l_extendedprice), 4) AS v3 FROM lineitem GROUP BY 1")
def groupby_avgs(spark, d):
    return Table(read(spark, d, "lineitem")).select({"v1": rounded(aggs.avg(C("l_quantity"))), "v2": rounded(aggs.avg(C("l_discount"))), "v3": rounded(aggs.avg(C("l_extendedprice")))}, by="l_linenumber").df


@query("groupby_sums", "SELECT l_orderkey, sum(l_quantity) AS v1, sum(l_linenumber)::BIGINT AS v2, round(sum(l_extendedprice), 2) AS v3 FROM lineitem GROUP BY 1")
def groupby_sums(spark, d):
    return Table(read(spark, d, "lineitem")).select({"v1": aggs.sum_(C("l_quantity")), "v2": aggs.sum_(C("l_linenumber")), "v3": rounded(aggs.sum_(C("l_extendedprice")), 2)}, by="l_orderkey").df


@query("groupby_expr", "SELECT l_suppkey, max(l_quantity) - min(l_discount) AS spread FROM lineitem GROUP BY 1")
def groupby_expr(spark, d):
    return Table(read(spark, d, "lineitem")).select({"spread": expr.sub(aggs.max_(C("l_quantity")), aggs.min_(C("l_discount")))}, by="l_suppkey").df


@query("groupby_wide", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus, round(sum(l_extendedprice), 2) AS v3, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def groupby_wide(spark, d):
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus"]
    return Table(read(spark, d, "lineitem")).select({"v3": rounded(aggs.sum_(C("l_extendedprice")), 2), "n": aggs.count()}, by=keys).df


@query(
    "groupby_all_aggs",
    """SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS mi, max(o_totalprice) AS ma, CAST(count(*) AS BIGINT) AS n,
       round(median(o_totalprice), 4) AS md, round(stddev_pop(o_totalprice), 3) AS dv, arg_min(o_custkey, o_orderkey) AS f, arg_max(o_custkey, o_orderkey) AS l FROM orders GROUP BY 1""",
)
def groupby_all_aggs(spark, d):
    x = C("o_totalprice")
    t = Table(read(spark, d, "orders"), "o_orderkey")
    out = {"s": rounded(aggs.sum_(x), 2), "a": rounded(aggs.avg(x)), "mi": aggs.min_(x), "ma": aggs.max_(x), "n": aggs.count(), "md": rounded(aggs.med(x)), "dv": rounded(aggs.dev(x), 3), "f": aggs.first(C("o_custkey"), C("o_orderkey")), "l": aggs.last(C("o_custkey"), C("o_orderkey"))}
    return t.select(out, by="o_orderpriority").df


@query("aggregate_global", "SELECT sum(l_quantity) AS s, max(l_tax) AS m, CAST(count(*) AS BIGINT) AS n FROM lineitem")
def aggregate_global(spark, d):
    return Table(read(spark, d, "lineitem")).select({"s": aggs.sum_(C("l_quantity"), empty_zero=True), "m": aggs.max_(C("l_tax")), "n": aggs.count()}, aggregated=True).df


@query("groupby_first_row", "SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def groupby_first_row(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")
    return Table(o, "o_orderkey").select(by="o_custkey").df.select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


@query("groupby_collect", "SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1")
def groupby_collect(spark, d):
    t = Table(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), "o_orderkey")
    return t.select({"p": t.listed("o_orderpriority")}, by="o_custkey").df.select("o_custkey", "p")


@query("group_rows", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS r FROM orders GROUP BY 1")
def group_rows(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(aggs.rows(C("o_orderkey")).alias("r"))


@query("groupby_xbar_time", "SELECT time_bucket(INTERVAL 6 HOURS, ts) AS bucket, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS v FROM events GROUP BY 1, 2")
def groupby_xbar_time(spark, d):
    return Table(read(spark, d, "events")).select({"n": aggs.count(), "v": rounded(aggs.sum_(C("value")), 3)}, by={"bucket": expr.xbar_ts(C("ts"), 6 * 3600 * 1_000_000), "event_type": C("event_type")}).df.select("bucket", "event_type", "n", "v")


@query("xbar_numeric", "SELECT p_partkey, p_size - ((p_size % 7) + 7) % 7 AS b, floor(p_retailprice / 12.5) * 12.5 AS r FROM part")
def xbar_numeric(spark, d):
    return read(spark, d, "part").select("p_partkey", expr.xbar(C("p_size"), 7).alias("b"), expr.mul(F.floor(C("p_retailprice") / 12.5), 12.5).alias("r"))


@query("xbar_date", "SELECT o_orderkey, (DATE '2000-01-01' + CAST(floor((o_orderdate::DATE - DATE '2000-01-01') / 10.0) * 10 AS INT))::DATE::VARCHAR AS b FROM orders")
def xbar_date(spark, d):
    return read(spark, d, "orders").select("o_orderkey", expr.xbar_date(C("o_orderdate").cast("date"), 10).cast("string").alias("b"))


@query("distinct_values", "SELECT DISTINCT p_brand, p_size FROM part")
def distinct_values(spark, d):
    return sets.distinct(read(spark, d, "part"), ["p_brand", "p_size"])


@query("count_distinct", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def count_distinct(spark, d):
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(aggs.count_distinct(C("l_suppkey")).alias("n"))


@query("having_nested", "SELECT * FROM (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1) WHERE n > 12")
def having_nested(spark, d):
    inner = Table(read(spark, d, "orders")).select({"n": aggs.count()}, by="o_custkey")
    return inner.select(where=C("n") > 12).df


# joins
@query("left_join_first_match", "SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) ON c_custkey = o_custkey")
def left_join_first_match(spark, d):
    r = read(spark, d, "orders").select(C("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.left_join(["c_custkey"], read(spark, d, "customer").select("c_custkey", "c_name"), r, order="o_orderkey")


@query("left_join_overlap", "SELECT n_nationkey, CASE WHEN s_nationkey IS NULL THEN n_name ELSE s_name END AS name FROM nation LEFT JOIN (SELECT * FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) = 1) ON n_nationkey = s_nationkey")
def left_join_overlap(spark, d):
    l = read(spark, d, "nation").select("n_nationkey", C("n_name").alias("name"))
    r = read(spark, d, "supplier").select(C("s_nationkey").alias("n_nationkey"), C("s_name").alias("name"), "s_suppkey")
    return joins.left_join(["n_nationkey"], l, r, order="s_suppkey").drop("s_suppkey")


@query(
    "inner_join_multi_key",
    """SELECT a.l_partkey, a.l_suppkey, a.l_orderkey, a.l_linenumber, b.q FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, arg_min(l_quantity, l_orderkey * 8 + l_linenumber) AS q FROM lineitem WHERE l_quantity > 40 GROUP BY 1, 2) b USING (l_partkey, l_suppkey)""",
)
def inner_join_multi_key(spark, d):
    l = read(spark, d, "lineitem")
    r = l.where("l_quantity > 40").select("l_partkey", "l_suppkey", C("l_quantity").alias("q"), (C("l_orderkey") * 8 + C("l_linenumber")).alias("o"))
    return joins.inner_join(["l_partkey", "l_suppkey"], l.select("l_partkey", "l_suppkey", *LINE), r, order="o").drop("o")


@query("join_star", "SELECT r_name, round(sum(l_extendedprice), 1) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def join_star(spark, d):
    j = read(spark, d, "lineitem").select("l_orderkey", "l_extendedprice").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), C("l_orderkey") == C("o_orderkey"))
    j = j.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), C("o_custkey") == C("c_custkey")).join(read(spark, d, "nation"), C("c_nationkey") == C("n_nationkey")).join(read(spark, d, "region"), C("n_regionkey") == C("r_regionkey"))
    return j.groupBy("r_name").agg(F.round(F.sum("l_extendedprice"), 1).alias("v"))


def _sides(spark, d):
    e = read(spark, d, "events")
    t = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    q = e.where("event_type = 'click'").select("user_id", "ts", C("value").alias("bid"), C("event_id").alias("click_id"))
    return t, q


ASOF = """WITH t AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, value AS bid, event_id AS click_id FROM events WHERE event_type = 'click')
SELECT t.user_id, t.ts, t.event_id, q.bid, q.click_id FROM t ASOF LEFT JOIN q ON t.user_id = q.user_id AND t.ts >= q.ts"""


@query("asof_join", ASOF)
def asof_join(spark, d):
    return joins.asof_join(["user_id"], "ts", *_sides(spark, d))


@query("asof_join_slots", ASOF)
def asof_join_slots(spark, d):
    """The same with time slots that spread hot keys."""
    return joins.asof_join(["user_id"], "ts", *_sides(spark, d), slot=24 * 3600 * 1_000_000)


WJ = """WITH t AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, ts, value AS bid FROM events WHERE event_type = 'click')
SELECT t.user_id, t.ts, t.event_id, min(bid) AS lo, max(bid) AS hi FROM t LEFT JOIN q ON t.user_id = q.user_id AND {} GROUP BY ALL"""


@query("window_join1", WJ.format("q.ts BETWEEN t.ts - INTERVAL 6 HOURS AND t.ts + INTERVAL 6 HOURS"))
def window_join1(spark, d):
    h = F.expr("INTERVAL 6 HOURS")
    return joins.window_join1(["user_id"], "ts", C("ts") - h, C("ts") + h, *_sides(spark, d), {"lo": F.min("bid"), "hi": F.max("bid")})


@query("window_join", WJ.format("q.ts <= t.ts + INTERVAL 6 HOURS AND q.ts >= coalesce((SELECT max(p.ts) FROM q p WHERE p.user_id = t.user_id AND p.ts <= t.ts - INTERVAL 6 HOURS), t.ts - INTERVAL 6 HOURS)"))
def window_join(spark, d):
    h = F.expr("INTERVAL 6 HOURS")
    return joins.window_join(["user_id"], "ts", C("ts") - h, C("ts") + h, *_sides(spark, d), {"lo": F.min("bid"), "hi": F.max("bid")})


@query("find_row", "SELECT c_custkey, min(o_orderkey) AS row FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def find_row(spark, d):
    return joins.find_rows(["c_custkey"], read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "o_orderkey")


@query("semi_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_in(spark, d):
    return joins.semi_join(["c_custkey"], read(spark, d, "customer").select("c_custkey"), read(spark, d, "orders").select(C("o_custkey").alias("c_custkey")))


@query("bin_lookup", "SELECT p_partkey, (SELECT count(*) FROM region WHERE r_regionkey * 500 + 900 <= p_retailprice) - 1 AS b FROM part")
def bin_lookup(spark, d):
    points = read(spark, d, "region").select((C("r_regionkey") * 500 + 900).cast("double").alias("point"))
    return joins.bin_join(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", points, "point", "b").drop("p_retailprice")


@query("binr_lookup", "SELECT p_partkey, (SELECT count(*) FROM region WHERE r_regionkey * 500 + 900 < p_retailprice) AS b FROM part")
def binr_lookup(spark, d):
    points = read(spark, d, "region").select((C("r_regionkey") * 500 + 900).cast("double").alias("point"))
    return joins.bin_join(read(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", points, "point", "b", right=True).drop("p_retailprice")


# verbs that change tables
@query("update_all", "SELECT p_partkey, p_size * 1.5 AS p_size, p_retailprice FROM part")
def update_all(spark, d):
    return Table(read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")).update({"p_size": C("p_size") * F.lit(1.5)}).df


@query("update_where", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS old FROM customer")
def update_where(spark, d):
    return Table(read(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")).update({"old": C("c_mktsegment"), "c_acctbal": F.lit(0.0)}, where=C("c_acctbal") < 0).df.drop("c_mktsegment")


@query("update_by", "SELECT o_orderkey, o_custkey, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders")
def update_by(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")).update({"most": aggs.max_(C("o_totalprice"))}, by="o_custkey").df.drop("o_totalprice")


@query("insert_rows", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, NULL FROM nation")
def insert_rows(spark, d):
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return Table(n).insert(n.select((C("n_nationkey") + 100).alias("n_nationkey"), "n_name")).df


@query(
    "upsert_rows",
    """WITH u AS (SELECT CASE WHEN c_custkey % 20 = 0 THEN c_custkey + 1000000 ELSE c_custkey END AS c_custkey, c_acctbal * 2 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0)
    SELECT coalesce(c.c_custkey, u.c_custkey) AS c_custkey, c.c_name, CASE WHEN u.c_custkey IS NOT NULL THEN u.c_acctbal ELSE c.c_acctbal END AS c_acctbal FROM customer c FULL JOIN u ON c.c_custkey = u.c_custkey""",
)
def upsert_rows(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = C("c_custkey")
    u = c.where(k % 10 == 0).select(F.when(k % 20 == 0, k + 1000000).otherwise(k).alias("c_custkey"), (C("c_acctbal") * 2).alias("c_acctbal"))
    return Table(c).upsert(1, u).df


@query("alter_column", "SELECT n_nationkey, n_regionkey + 10 AS n_regionkey FROM nation")
def alter_column(spark, d):
    return Table(read(spark, d, "nation").select("n_nationkey", "n_regionkey")).alter(expr.add, "n_regionkey", 10).df


# order
@query("sort_xasc_take", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey LIMIT 50")
def sort_xasc_take(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey").xasc("o_orderpriority").limit(50)


@query("topk_xdesc", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_xdesc(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey").xdesc("o_totalprice").limit(25)


@query("take_tail", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def take_tail(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").take(-7).df


@query("take_range", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def take_range(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").take(10, start=5).df


@query("take_cyclic", "SELECT r_name, CAST(count(*) AS BIGINT) AS n FROM (SELECT r_name FROM region CROSS JOIN range(3) x(i) ORDER BY i, r_regionkey LIMIT 13) GROUP BY 1")
def take_cyclic(spark, d):
    t = Table(read(spark, d, "region").select("r_regionkey", "r_name").withColumn("k", C("r_regionkey").cast("long")), "k").take(13, cyclic=True)
    return t.full.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("rank_all", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def rank_all(spark, d):
    return ranking.rank(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", ["o_orderkey"]).drop("o_totalprice")


@query("rank_by", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders")
def rank_by(spark, d):
    return ranking.rank(read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", ["o_orderkey"], by=["o_custkey"]).select("o_orderkey", "rank")


@query("xrank_buckets", "SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 10 / (SELECT count(*) FROM orders)) AS BIGINT) AS xrank FROM orders")
def xrank_buckets(spark, d):
    return ranking.xrank(read(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 10, ["o_orderkey"]).drop("o_totalprice")


@query("scan_running_sum", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 3) AS running FROM events")
def scan_running_sum(spark, d):
    return ranking.running(read(spark, d, "events").select("event_id", "user_id", "ts", "value"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "user_id", F.round("running", 3).alias("running"))


@query("scan_running_all", "SELECT o_orderkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS running FROM orders")
def scan_running_all(spark, d):
    return ranking.running(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", ["o_orderkey"]).drop("o_custkey")


# sets
@query("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, d):
    return sets.union(read(spark, d, "customer").select(C("c_nationkey").alias("k")), read(spark, d, "supplier").select(C("s_nationkey").alias("k")))


@query("set_sect", "SELECT o_custkey AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def set_sect(spark, d):
    return sets.sect(read(spark, d, "orders").select(C("o_custkey").alias("k")), read(spark, d, "customer").where("c_acctbal > 5000").select(C("c_custkey").alias("k")))


@query("set_except", "SELECT o_custkey AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def set_except(spark, d):
    return sets.except_(read(spark, d, "orders").select(C("o_custkey").alias("k")), read(spark, d, "customer").where("c_acctbal > 5000").select(C("c_custkey").alias("k")))


@query("set_concat", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def set_concat(spark, d):
    return sets.concat(read(spark, d, "customer").select(C("c_nationkey").alias("k")), read(spark, d, "supplier").select(C("s_nationkey").alias("k")))


# scalars
@query("like_glob", "SELECT p_partkey FROM part WHERE p_type GLOB '*[EA]*' AND p_name LIKE '%a%'")
def like_glob(spark, d):
    return read(spark, d, "part").where(expr.like(C("p_type"), "*[EA]*") & expr.like(C("p_name"), "*a*")).select("p_partkey")


@query("split_string", "SELECT o_orderkey, string_split(o_orderpriority, '-') AS parts FROM orders")
def split_string(spark, d):
    return read(spark, d, "orders").select("o_orderkey", expr.split(C("o_orderpriority"), "-").alias("parts"))


@query("cast_types", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS i, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, CAST(o_orderkey AS VARCHAR) AS s FROM orders")
def cast_types(spark, d):
    return read(spark, d, "orders").select("o_orderkey", expr.cast("I64", C("o_totalprice")).alias("i"), expr.cast("DATE", C("o_orderdate")).cast("string").alias("dt"), expr.cast("SYMBOL", C("o_orderkey")).alias("s"))


@query("in_list", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linenumber IN (1, 3)")
def in_list(spark, d):
    return read(spark, d, "lineitem").where(expr.in_(C("l_returnflag"), ["A", "R"]) & expr.in_(C("l_linenumber"), [1, 3])).select(*LINE)


@query("compare_nulls", "SELECT c_custkey, coalesce(x < 100, true) AS lt, x IS NOT DISTINCT FROM 5 AS eq, coalesce(x >= 100, false) AS ge FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer)")
def compare_nulls(spark, d):
    x = F.when(C("c_acctbal") > 0, C("c_acctbal"))
    return read(spark, d, "customer").select("c_custkey", expr.lt(x, 100).alias("lt"), expr.eq(x, 5).alias("eq"), expr.ge(x, 100).alias("ge"))


@query("floor_div_mod", "SELECT c_custkey, floor(c_acctbal / 7) AS q, round(c_acctbal - 7 * floor(c_acctbal / 7), 6) AS r, CAST(floor((c_custkey - 500) / -3.0) AS BIGINT) AS qi, CAST(c_custkey - 500 + 3 * floor((c_custkey - 500) / -3.0) AS BIGINT) AS ri, NULL::DOUBLE AS z FROM customer")
def floor_div_mod(spark, d):
    a, k = C("c_acctbal"), C("c_custkey") - 500
    return read(spark, d, "customer").select("c_custkey", expr.floor_div(a, 7).cast("double").alias("q"), F.round(expr.floor_mod(a, F.lit(7.0)), 6).alias("r"), expr.int_floor_div(k, F.lit(-3)).alias("qi"), expr.floor_mod(k, F.lit(-3)).alias("ri"), expr.true_div(a, 0).alias("z"))


@query("math_functions", "SELECT c_custkey, round(c_acctbal) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, -c_acctbal AS n, c_acctbal / 4 AS q FROM customer")
def math_functions(spark, d):
    a = C("c_acctbal")
    return read(spark, d, "customer").select("c_custkey", expr.round_(a).alias("r"), expr.floor_(a).alias("f"), expr.ceil_(a).alias("c"), expr.neg(a).alias("n"), expr.true_div(a, 4).alias("q"))


@query("temporal_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 90 SECONDS AS later, CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2000-01-01') AS BIGINT) * 1000 AS ns, CAST(CAST(CAST(o_orderdate AS DATE) + 3 AS DATE) AS VARCHAR) AS d3 FROM orders")
def temporal_arithmetic(spark, d):
    t = C("o_orderdate")
    return read(spark, d, "orders").select("o_orderkey", expr.ts_add(t, 90_000_000).alias("later"), expr.ts_sub(t, F.lit("2000-01-01").cast("timestamp_ntz")).alias("ns"), F.date_add(t.cast("date"), 3).cast("string").alias("d3"))


@query("format_text", "SELECT n_nationkey, n_name || ' in ' || n_regionkey AS s FROM nation")
def format_text(spark, d):
    return read(spark, d, "nation").select("n_nationkey", expr.format_("% in %", C("n_name"), C("n_regionkey")).alias("s"))


# arrays and higher-order functions
@query("map_array", "SELECT vec_id, list_transform(embedding, lambda x: round(x * 2, 4) + 0) AS m FROM embeddings")
def map_array(spark, d):
    return read(spark, d, "embeddings").select("vec_id", arrays.map_(lambda x: F.round(x.cast("double") * 2, 4).cast("float") + F.lit(0).cast("float"), C("embedding")).alias("m"))


@query("fold_array", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS s, list_max(embedding) AS m FROM embeddings")
def fold_array(spark, d):
    e = C("embedding").cast("array<double>")
    return read(spark, d, "embeddings").select("vec_id", F.round(arrays.fold(lambda a, x: a + x, e), 4).alias("s"), arrays.fold(lambda a, x: F.greatest(a, x), C("embedding")).alias("m"))


@query("scan_array", "SELECT o_custkey, list_transform(range(1, len(k) + 1), lambda i: list_sum(k[1:i])::BIGINT) AS s FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k FROM orders GROUP BY 1)")
def scan_array(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(aggs.rows(C("o_orderkey")).alias("k"))
    return g.select("o_custkey", arrays.scan(lambda a, x: a + x, C("k")).alias("s"))


@query("array_sets", "SELECT o_custkey, list_sort(list_distinct(p)) AS u, list_filter(p, lambda x: x IN ('1-URGENT', '2-HIGH')) AS s FROM (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS p FROM orders GROUP BY 1)")
def array_sets(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(aggs.collected(C("o_orderpriority"), C("o_orderkey")).alias("p"))
    return g.select("o_custkey", arrays.distinct(C("p")).alias("u"), arrays.sect(C("p"), F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).alias("s"))


@query("raze_explode", "SELECT o_orderkey, unnest(string_split(o_orderpriority, '-')) AS part FROM orders")
def raze_explode(spark, d):
    t = read(spark, d, "orders").select("o_orderkey", expr.split(C("o_orderpriority"), "-").alias("part"))
    return sets.raze(t, "part")


# storage
@query("parted_prune", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS Date, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS v FROM events WHERE day(ts) <= 10 GROUP BY 1")
def parted_prune(spark, d):
    path = scratch(spark, "parted")
    io.set_parted(read(spark, d, "events").withColumn("Date", C("ts").cast("date")), path)
    t = io.get_parted(spark, path)
    return t.where(F.day("Date") <= 10).groupBy("Date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("v")).withColumn("Date", C("Date").cast("string"))


@query("splayed_roundtrip", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def splayed_roundtrip(spark, d):
    path = scratch(spark, "splayed")
    io.set_splayed(read(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return io.get_splayed(spark, path)


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def csv_roundtrip(spark, d):
    path = scratch(spark, "csv")
    io.write_csv(read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"), path)
    return io.read_csv(spark, ["I64", "SYMBOL", "I32", "F64"], path)
