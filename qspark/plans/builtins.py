"""Registered queries of single builtins, with their SQL twins: Columns over whole tables, and scripts of the language."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import aggs, arrays, expr
from ..lang import Interpreter
from ..operators import ranking
from ..operators.table import Table
from ..sources import io
from .base import query, read, scratch

C = F.col


def of_rows(name: str, table: str, key: str, made: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A row a row of the table: its key, and each Column beside its SQL."""
    sql = f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, (_, s) in made.items())} FROM {table}"
    query(name, sql)(lambda spark, d: read(spark, d, table).select(key, *(c().alias(n) for n, (c, _) in made.items())))


def of_lists(name: str, made: dict[str, tuple[Callable[[], Column], str]], nulls: str = "first") -> None:
    """A row a customer with orders, from the lists of its order keys (k), prices (p) and priorities (s) in the order of keys.

    nulls: where orders without a key stand; the SQL has them last.
    """
    lists = "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS k, list(o_totalprice ORDER BY o_orderkey) AS p, list(o_orderpriority ORDER BY o_orderkey) AS s FROM orders GROUP BY 1"
    sql = f"SELECT o_custkey, {', '.join(f'{s} AS {n}' for n, (_, s) in made.items())} FROM ({lists})"

    def run(spark: SparkSession, d: str) -> DataFrame:
        own = {"k": "o_orderkey", "p": "o_totalprice", "s": "o_orderpriority"}
        g = read(spark, d, "orders").groupBy("o_custkey").agg(*(aggs.collected(C(c), C("o_orderkey"), nulls).alias(n) for n, c in own.items()))
        return g.select("o_custkey", *(c().alias(n) for n, (c, _) in made.items()))

    query(name, sql)(run)


def script(name: str, sql: str, text: str, **tables: str) -> None:
    """A script of the language over tables; its value is the result."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        q = Interpreter(spark)
        for k, t in tables.items():
            q.globals[k] = read(spark, d, t)
        return q.table(q.run(text)).df

    query(name, sql)(run)


# comparisons and logic
def some() -> Column:
    return F.when(C("c_acctbal") > 0, C("c_acctbal"))


SOME = "(CASE WHEN c_acctbal > 0 THEN c_acctbal END)"
of_rows("compare_ne", "customer", "c_custkey", {"x": (lambda: expr.ne(some(), C("c_custkey")), f"{SOME} IS DISTINCT FROM c_custkey")})
of_rows("compare_gt", "customer", "c_custkey", {"x": (lambda: expr.gt(some(), 500), f"coalesce({SOME} > 500, false)")})
of_rows("compare_le", "customer", "c_custkey", {"x": (lambda: expr.le(some(), 500), f"coalesce({SOME} <= 500, true)")})
positive, low = lambda: C("c_acctbal") > 0, lambda: C("c_nationkey") < 10
of_rows("logic_and", "customer", "c_custkey", {"x": (lambda: expr.and_(positive(), low()), "c_acctbal > 0 AND c_nationkey < 10")})
of_rows("logic_or", "customer", "c_custkey", {"x": (lambda: expr.or_(positive(), low()), "c_acctbal > 0 OR c_nationkey < 10")})
of_rows("logic_not", "customer", "c_custkey", {"x": (lambda: expr.not_(positive()), "NOT c_acctbal > 0")})
of_rows("logic_nil", "customer", "c_custkey", {"x": (lambda: expr.nil(some()), f"{SOME} IS NULL")})
of_rows("logic_if", "customer", "c_custkey", {"x": (lambda: expr.if_(positive(), C("c_mktsegment"), "none"), "CASE WHEN c_acctbal > 0 THEN c_mktsegment ELSE 'none' END")})
of_rows("within_range", "lineitem", "l_orderkey", {"l_linenumber": (lambda: C("l_linenumber"), "l_linenumber"), "x": (lambda: expr.within(C("l_quantity"), 10, 20), "l_quantity BETWEEN 10 AND 20")})

# numbers
of_rows("round_down_up", "customer", "c_custkey", {"f": (lambda: expr.floor_(C("c_acctbal") / 3), "floor(c_acctbal / 3)"), "c": (lambda: expr.ceil_(C("c_acctbal") / 3), "ceil(c_acctbal / 3)")})
of_rows("floor_div_exact", "orders", "o_orderkey", {"q": (lambda: expr.floor_div(C("o_orderkey") + F.lit(9007199254740993), 2), "(o_orderkey + 9007199254740993) // 2")})
of_rows("minus_div", "orders", "o_orderkey", {"m": (lambda: expr.sub(C("o_custkey"), C("o_orderkey")), "o_custkey - o_orderkey"), "q": (lambda: expr.true_div(C("o_custkey"), C("o_orderkey")), "o_custkey / nullif(o_orderkey, 0)")})

# arrays
of_lists("array_asc_desc", {"a": (lambda: arrays.asc(C("p")), "list_sort(p)"), "d": (lambda: arrays.desc(C("p")), "list_reverse_sort(p)")})
PLACES = "list_transform(list_sort(list_transform(range(0, len({0})), lambda i: {{'v': {0}[i + 1], 'i': i}})), lambda x: x.i)"
of_lists("array_iasc", {"x": (lambda: arrays.iasc(C("s")), PLACES.format("s"))})
of_lists("array_idesc", {"x": (lambda: arrays.idesc(C("s")), "list_transform(list_reverse_sort(list_transform(range(0, len(s)), lambda i: {'v': s[i + 1], 'i': -i})), lambda x: -x.i)")})
of_lists("array_rank", {"x": (lambda: arrays.rank(C("p"), ties="least"), "list_transform(p, lambda v: len(list_filter(p, lambda w: w < v)))"), "b": (lambda: arrays.xrank(C("p"), 3, ties="least"), "list_transform(p, lambda v: len(list_filter(p, lambda w: w < v)) * 3 // len(p))")}, nulls="last")
of_lists("array_reverse", {"x": (lambda: arrays.reverse(C("k")), "list_reverse(k)")})
of_lists("array_where", {"x": (lambda: arrays.where(F.transform(C("p"), lambda v: v > 150000)), "list_filter(range(0, len(p)), lambda i: p[i + 1] > 150000)")})
of_lists("array_filter", {"x": (lambda: arrays.filter_(C("k"), F.transform(C("p"), lambda v: v > 150000)), "list_transform(list_filter(range(0, len(p)), lambda i: p[i + 1] > 150000), lambda i: k[i + 1])")})
of_lists("array_at", {"x": (lambda: arrays.at(C("k"), 1), "k[2]"), "far": (lambda: arrays.at(C("k"), 10_000), "NULL::BIGINT")})
of_lists("array_find", {"x": (lambda: arrays.find(C("s"), "1-URGENT"), "list_position(s, '1-URGENT') - 1")})
of_lists("array_bin", {"b": (lambda: arrays.bin_(arrays.asc(C("p")), 150000.0), "len(list_filter(p, lambda v: v <= 150000)) - 1"), "r": (lambda: arrays.binr(arrays.asc(C("p")), 150000.0), "len(list_filter(p, lambda v: v < 150000))")})
of_lists("array_take", {"x": (lambda: arrays.take(C("k"), 5), "list_transform(range(0, 5), lambda i: k[i % len(k) + 1])"), "y": (lambda: arrays.take(C("k"), -2), "list_transform(range(0, 2), lambda i: k[((i - 2) % len(k) + len(k)) % len(k) + 1])")})
of_lists("array_remove", {"x": (lambda: arrays.remove(C("k"), 0), "k[2:]")})
of_lists("array_concat_raze", {"x": (lambda: arrays.concat(C("k"), C("k")), "list_concat(k, k)"), "y": (lambda: arrays.raze(F.array(C("k"), arrays.reverse(C("k")))), "list_concat(k, list_reverse(k))")})
of_lists("array_union_except", {"u": (lambda: arrays.asc(arrays.union(C("s"), F.array(F.lit("x")))), "list_sort(list_distinct(list_append(s, 'x')))"), "e": (lambda: arrays.except_(C("s"), F.array(F.lit("5-LOW"))), "list_filter(s, lambda v: v <> '5-LOW')")})
of_lists("array_list", {"x": (lambda: arrays.enlist(F.size("k").cast("long"), F.lit(1).cast("long")), "[len(k), 1]")})
of_lists("array_alter", {"x": (lambda: arrays.alter(C("k"), lambda a, v: a + v, 0, 1000), "list_concat([k[1] + 1000], k[2:])")})
of_lists("dict_key_value", {"a": (lambda: arrays.key(arrays.dict_(C("k"), C("s"))), "map_keys(map(k, s))"), "v": (lambda: arrays.value(arrays.dict_(C("k"), C("s"))), "map_values(map(k, s))")})
of_lists("fold_left", {"x": (lambda: arrays.fold_left(lambda x, acc: F.concat(acc, F.lit("/"), x), C("s"), F.lit("at")), "'at/' || array_to_string(s, '/')")})
of_lists("fold_right", {"x": (lambda: arrays.fold_right(lambda x, acc: F.concat(acc, F.lit("/"), x), F.lit("at"), C("s")), "'at/' || array_to_string(list_reverse(s), '/')")})
of_lists("scan_left", {"x": (lambda: arrays.scan_left(lambda x, acc: acc + x, C("k"), F.lit(7).cast("long")), "list_transform(range(1, len(k) + 1), lambda i: 7 + list_sum(k[1:i])::BIGINT)")})
of_lists("scan_right", {"x": (lambda: arrays.scan_right(lambda x, acc: acc + x, F.lit(7).cast("long"), C("k")), "list_transform(range(1, len(k) + 1), lambda i: 7 + list_sum(k[i:])::BIGINT)")})
of_lists("map_left_right", {"l": (lambda: arrays.map_left(lambda x, y: y - x, C("o_custkey"), C("k")), "list_transform(k, lambda v: v - o_custkey)"), "r": (lambda: arrays.map_right(lambda x, y: x * y, C("k"), 3), "list_transform(k, lambda v: v * 3)")})
of_lists("map_two", {"x": (lambda: arrays.map_(lambda a, b: a + b, C("k"), arrays.reverse(C("k"))), "list_transform(range(1, len(k) + 1), lambda i: k[i] + k[len(k) + 1 - i])")})
of_rows("til_array", "nation", "n_nationkey", {"x": (lambda: arrays.til(C("n_nationkey")), "range(0, n_nationkey)")})


@query("group_places", "SELECT o_custkey, v, list(i ORDER BY i) AS places FROM (SELECT o_custkey, o_orderpriority AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders) GROUP BY 1, 2")
def group_places(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey").agg(aggs.collected(C("o_orderpriority"), C("o_orderkey")).alias("s"))
    return g.select("o_custkey", F.explode(arrays.group(C("s"))).alias("v", "places"))


# tables
@query("sort_permutation", "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, i AS index FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def sort_permutation(spark, d):
    return ranking.iasc(read(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("sort_permutation_down", "SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place, i AS index FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)")
def sort_permutation_down(spark, d):
    return ranking.iasc(read(spark, d, "orders"), "o_totalprice", "o_orderkey", ascending=False)


@query("reverse_take", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 9")
def reverse_take(spark, d):
    return Table(read(spark, d, "orders").select("o_orderkey"), "o_orderkey").reverse().limit(9)


@query("modify_field", "SELECT s_suppkey, s_acctbal + 1 AS v, s_name AS n FROM supplier")
def modify_field(spark, d):
    t = read(spark, d, "supplier").select("s_suppkey", F.struct(C("s_acctbal").alias("v"), C("s_name").alias("n")).alias("x"))
    return Table(t).modify(expr.add, ["x", "v"], 1).df.select("s_suppkey", "x.v", "x.n")


@query("meta_names", "SELECT * FROM (VALUES ('r_regionkey', 'I32'), ('r_name', 'SYMBOL')) t(name, type)")
def meta_names(spark, d):
    t = Table(read(spark, d, "region").select(C("r_regionkey").cast("int").alias("r_regionkey"), "r_name"))
    return spark.createDataFrame(t.meta(), "name string, type string")


@query("table_of_columns", "SELECT * FROM (VALUES (1, 'a', 9), (2, 'b', 9), (NULL, 'c', 9)) t(x, s, n)")
def table_of_columns(spark, d):
    return io.table(spark, ["x", "s", "n"], [[1, 2, None], ["a", "b", "c"], 9], ["I64", "SYMBOL", "I64"])


@query("til_rand_guid", "SELECT CAST(1000 AS BIGINT) AS n, CAST(499500 AS BIGINT) AS s, true AS inside, CAST(1000 AS BIGINT) AS ids")
def til_rand_guid(spark, d):
    t = io.til(spark, 1000).agg(F.count("x").alias("n"), F.sum("x").alias("s"))
    r = io.rand(spark, 1000, 50).agg((F.min("x").between(0, 49) & F.max("x").between(0, 49)).alias("inside"))
    g = io.guid(spark, 1000).agg(F.count_distinct("x").alias("ids"))
    return t.join(r, F.lit(True)).join(g, F.lit(True))  # one row each


@query("set_get_name", "SELECT n_nationkey, n_name FROM nation")
def set_get_name(spark, d):
    io.set_name(read(spark, d, "nation").select("n_nationkey", "n_name"), "qspark_nation_kept")
    return io.get_name(spark, "qspark_nation_kept")


@query("load_folder", "SELECT s_suppkey, s_name FROM supplier")
def load_folder(spark, d):
    path = scratch(spark, "load") + "loaded_supplier/"
    io.set_splayed(read(spark, d, "supplier").select("s_suppkey", "s_name"), path)
    return spark.table(io.load(spark, path))


@query("ser_de", "SELECT n_nationkey, n_name, CAST(n_nationkey AS DECIMAL(9,2)) AS m, '2024-02-03' AS dt FROM nation")
def ser_de(spark, d):
    return io.de(io.ser(read(spark, d, "nation").select("n_nationkey", "n_name", C("n_nationkey").cast("decimal(9,2)").alias("m"), F.lit(datetime.date(2024, 2, 3)).alias("dt"))), spark).withColumn("dt", C("dt").cast("string"))


@query("journal_replay", "SELECT unnest(['a', 'b', 'c']) AS message, CAST(3 AS BIGINT) AS total")
def journal_replay(spark, d):
    log, seen = io.Journal(spark, scratch(spark, "journal")), []
    for x in "abc":
        log.write(x)
    _, total = log.read(seen.append)
    return spark.createDataFrame([(x, total) for x in seen], "message string, total long")


# scripts
script("lang_let_do", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1", "(do (let low (+ 10 20)) (select {n: (count l_quantity) from: t where: (> l_quantity low) by: l_returnflag}))", t="lineitem")
script("lang_lambda", "SELECT o_custkey, max(o_totalprice) * 2 + 1 AS v FROM orders GROUP BY 1", "(set f (fn [x] (+ (* x 2.0) 1.0))) (select {v: (f (max o_totalprice)) from: t by: o_custkey})", t="orders")
script("lang_parse_eval", "SELECT CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation", '(eval (parse "(select {s: (sum n_nationkey) from: t})"))', t="nation")
script("lang_try_raise", "SELECT r_name FROM region WHERE r_regionkey < 2", '(select {r_name: r_name from: (try (raise "no table") (fn [e] (resolve \'t))) where: (< r_regionkey 2)})', t="region")
script("lang_apply", "SELECT n_name, n_regionkey + 5 AS v FROM nation", "(select {n_name: n_name v: (apply + n_regionkey 5) from: t})", t="nation")
script("lang_quote", "SELECT CAST(count(*) AS BIGINT) AS n FROM region", "(eval (quote (select {n: (count r_name) from: t})))", t="region")
script("lang_if_scalar", "SELECT n_name, CASE WHEN n_regionkey > 2 THEN 'far' ELSE 'near' END AS where_ FROM nation", "(select {n_name: n_name where_: (if (> n_regionkey 2) 'far 'near) from: t})", t="nation")
script("lang_format_as", "SELECT n_name || '#' || n_nationkey AS s, CAST(n_nationkey AS DOUBLE) AS x FROM nation", "(select {s: (format \"%#%\" n_name n_nationkey) x: (as 'F64 n_nationkey) from: t})", t="nation")
script("lang_return", "SELECT r_name FROM region", "((fn [x] (return (select {r_name: r_name from: x})) 5) t)", t="region")
script("lang_dates", "SELECT n_name, true AS now FROM nation", "(select {n_name: n_name now: (>= (date 'utc) 2024.01.01) from: t})", t="nation")
