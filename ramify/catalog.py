"""The queries of the library over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import labels
from .operators import calls, fanin, memo, monitor, recursion, reduction, sorting, sync, trials
from .plans import invoke, program, tree
from .sources import files
from .storage import fresh, load
from .streaming import replay

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
THRESHOLD = 128


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quantity() -> Column:
    return F.col("l_quantity").cast("long")


# sorting


@query("SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS rank FROM orders")
def sort_global(spark: SparkSession, d: str) -> DataFrame:
    return sorting.sort_global(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"])


@query("SELECT o_totalprice AS a, o_orderkey AS b, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM orders")
def sort_set_index(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "orders").select(F.col("o_totalprice").alias("a"), F.col("o_orderkey").alias("b"))
    return sorting.sort_global(own, ["a", "b"])


@query("SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS rank FROM lineitem")
def sort_runs(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber")
    return sorting.sort_runs(own, "l_suppkey", ["l_partkey", "l_orderkey", "l_linenumber"])


@query("""
WITH u AS (SELECT o_orderkey, o_totalprice, 0 AS run FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice, 1 FROM orders WHERE o_orderkey % 2 = 1)
SELECT o_orderkey, run, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rank FROM u""")
def merge_sorted_runs(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    halves = [own.where(F.col("o_orderkey") % 2 == i).withColumn("run", F.lit(i)) for i in (0, 1)]
    return sorting.merge_runs(halves, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("""
WITH r AS (SELECT o_custkey % 64 AS run, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders GROUP BY 1)
SELECT run // 2 AS parent, min(lo) AS lo, max(hi) AS hi FROM r GROUP BY 1""")
def merge_bounds(spark: SparkSession, d: str) -> DataFrame:
    runs = load(spark, d, "orders").groupBy((F.col("o_custkey") % 64).alias("run")).agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    return sorting.merge_bounds(runs, F.floor(F.col("run") / 2), "lo", "hi")


@query("""
WITH p AS (SELECT arg_max(o_totalprice, o_orderkey) AS pv FROM orders)
SELECT pv AS pivot_value, count(*) FILTER (o_totalprice <= pv) - 1 AS split, count(*) FILTER (o_totalprice <= pv) - 1 AS n_left,
  count(*) FILTER (o_totalprice > pv) + 1 AS n_right, max(o_totalprice) FILTER (o_totalprice <= pv) AS max_left, min(o_totalprice) FILTER (o_totalprice > pv) AS min_right
FROM orders, p GROUP BY pv""")
def quicksort_partition_step(spark: SparkSession, d: str) -> DataFrame:
    return sorting.quicksort_step(load(spark, d, "orders"), "o_totalprice", "o_orderkey")


@query("""
WITH o AS (SELECT o_custkey, list(o_totalprice ORDER BY o_orderkey) AS a FROM orders GROUP BY 1),
q AS (SELECT o_custkey, CASE WHEN len(a) > 1 THEN list_concat(list_concat(list_filter(a[:-2], lambda x: x <= a[-1]), [a[-1]]), list_filter(a[:-2], lambda x: x > a[-1])) ELSE a END AS a FROM o)
SELECT o_custkey, unnest(range(len(a))) AS pos, unnest(a) AS price FROM q""")
def quicksort_array_step(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    step = sorting.quicksort_array(F.transform("a", lambda x: x["o_totalprice"]))
    return own.select("o_custkey", F.posexplode(step).alias("pos", "price")).withColumn("pos", F.col("pos").cast("long"))


@query("""
WITH r AS (SELECT c_nationkey, list_sort(list(c_custkey) FILTER (c_custkey % 2 = 0)) AS a, list_sort(list(c_custkey) FILTER (c_custkey % 2 = 1)) AS b FROM customer GROUP BY 1)
SELECT c_nationkey, unnest(range(len(list_concat(a, b)))) AS pos, unnest(list_sort(list_concat(a, b))) AS c_custkey FROM r""")
def merge_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Two sorted runs of each nation, merged by rank: a nation with a third of all customers is no array."""
    own = load(spark, d, "customer").select("c_nationkey", "c_custkey")
    at = sorting.merge_runs([own.where(F.col("c_custkey") % 2 == i) for i in (0, 1)], ["c_custkey"], run="c_nationkey")
    return at.select("c_nationkey", (F.col("rank") - 1).alias("pos"), "c_custkey")


@query("""
WITH s AS (SELECT o_custkey, lead(o_custkey) OVER (ORDER BY o_custkey, o_orderkey) AS nxt FROM orders), u AS (SELECT o_custkey, lead(o_custkey) OVER (ORDER BY o_orderkey) AS nxt FROM orders)
SELECT 'by customer' AS sorted_by, count(*) AS n, count(*) FILTER (nxt < o_custkey) AS out_of_order, count(*) - count(nxt) - 1 AS gaps FROM s
UNION ALL SELECT 'by order', count(*), count(*) FILTER (nxt < o_custkey), count(*) - count(nxt) - 1 FROM u""")
def verify_sorted(spark: SparkSession, d: str) -> DataFrame:
    """Customers in their own order, and in that of orders, where neighbours are out of order."""
    own = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    orders = {"by customer": ["o_custkey", "o_orderkey"], "by order": ["o_orderkey"]}
    found = [sorting.verify(sorting.sort_global(own, o), "rank", "o_custkey").select(F.lit(n).alias("sorted_by"), "*") for n, o in orders.items()]
    return found[0].union(found[1])


@query("""
WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS r FROM orders), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders WHERE o_orderkey % 10 <> 0)
SELECT count(*) AS n, count(*) FILTER (a.r IS NULL) AS missing, count(*) FILTER (b.r IS NULL) AS surplus, count(*) FILTER (a.r <> b.r) AS differ FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey""")
def verify_result(spark: SparkSession, d: str) -> DataFrame:
    """A result against an expected one that lacks rows and has other ranks."""
    own = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    got = sorting.sort_global(own, ["o_custkey", "o_orderkey"])
    return sorting.differences(got, sorting.sort_global(own.where("o_orderkey % 10 <> 0"), ["o_totalprice", "o_orderkey"]), ["o_orderkey"], "rank")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (ORDER BY (l_linenumber, l_partkey, l_orderkey, l_suppkey, l_quantity)) AS rank FROM lineitem")
def sort_tuple_key(spark: SparkSession, d: str) -> DataFrame:
    """One key that is a tuple."""
    own = load(spark, d, "lineitem").select(*LINE, quantity().alias("q"))
    return sorting.sort_global(own, [F.struct("l_linenumber", "l_partkey", "l_orderkey", "l_suppkey", "q")])


@query("SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names FROM nation GROUP BY 1")
def sorted_keys(spark: SparkSession, d: str) -> DataFrame:
    keyed = load(spark, d, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey"))).alias("m"))
    return keyed.select("n_regionkey", F.array_join(F.sort_array(F.map_keys("m")), ",").alias("names"))


# reductions


@query("SELECT CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem")
def reduce_sum(spark: SparkSession, d: str) -> DataFrame:
    return reduction.reduce_sum(load(spark, d, "lineitem"), quantity())


@query("""
SELECT CAST(level AS INTEGER) AS level, l_orderkey % (CAST(1 AS BIGINT) << level) AS node, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total
FROM lineitem, (SELECT unnest(range(0, 7)) AS level) GROUP BY 1, 2""")
def reduce_sum_by_level(spark: SparkSession, d: str) -> DataFrame:
    return reduction.sums_by_level(load(spark, d, "lineitem"), F.col("l_orderkey"), quantity(), 6)


@query("SELECT l_orderkey % 8 AS node, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def partial_combine_level_k(spark: SparkSession, d: str) -> DataFrame:
    return reduction.combine_to_level(load(spark, d, "lineitem"), F.col("l_orderkey"), quantity(), 3)


@query("""
WITH e AS (SELECT unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
SELECT CAST(pos AS INTEGER) AS pos, round(sum(CAST(x AS DOUBLE)), 4) AS total FROM e GROUP BY 1""")
def vector_sum(spark: SparkSession, d: str) -> DataFrame:
    out = reduction.vector_sum(load(spark, d, "embeddings"), "embedding")
    return out.select("pos", F.round("total", 4).alias("total"))


@query("""
WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, CAST(pos AS INTEGER) AS pos, round(CAST(x AS DOUBLE) * CASE WHEN pos < vec_id % 65 THEN 2 ELSE 1 END, 4) AS x FROM e""")
def vector_add_padded(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    short = F.slice("a", F.lit(1), F.pmod("vec_id", F.lit(65)).cast("int"))
    return own.select("vec_id", F.posexplode(reduction.add_padded(F.col("a"), short)).alias("pos", "x")).withColumn("x", F.round("x", 4))


FIB = "WITH RECURSIVE f AS (SELECT 0 AS n, CAST(0 AS HUGEINT) AS a, CAST(1 AS HUGEINT) AS b UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 30)"

# recursion trees and labels

TREE = f"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM orders),
t AS (
  SELECT '[0,1]' AS problem_id, CAST(NULL AS VARCHAR) AS parent_id, 0 AS level, CAST(NULL AS INTEGER) AS child_idx, CAST(0 AS BIGINT) AS lo, n - 1 AS hi FROM n WHERE n > 0
  UNION ALL
  SELECT problem_id || '[' || i || ',2]', problem_id, level + 1, i, CASE WHEN i = 0 THEN lo + (hi - lo) // 2 + 1 ELSE lo END, CASE WHEN i = 0 THEN hi ELSE lo + (hi - lo) // 2 END
  FROM t, (SELECT unnest([0, 1]) AS i) WHERE hi - lo + 1 > {THRESHOLD})
"""  # noqa: S608


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return tree.range_tree(spark, load(spark, d, "orders").count(), THRESHOLD)


@query(TREE + f"SELECT problem_id, parent_id, level, child_idx, lo AS from_idx, hi AS to_idx, hi - lo + 1 <= {THRESHOLD} AS is_leaf FROM t")
def dnc_tree_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d)


@query(TREE + f"SELECT level, count(*) AS leaves, CAST(sum(hi - lo + 1) AS BIGINT) AS elements FROM t WHERE hi - lo + 1 <= {THRESHOLD} GROUP BY 1")
def dnc_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).where("is_leaf").groupBy("level").agg(F.count("*").alias("leaves"), F.sum(F.col("to_idx") - F.col("from_idx") + 1).alias("elements"))


@query(TREE + "SELECT problem_id, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || 'x' || hi END AS label FROM t")
def dnc_range_labels(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("problem_id", tree.range_label(F.col("from_idx"), F.col("to_idx")).alias("label"))


@query(TREE + f""", r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT problem_id, lo AS from_idx, hi AS to_idx, count(*) AS n, arg_min(o_custkey, pos) AS first_value, arg_max(o_custkey, pos) AS last_value, CAST(sum(o_custkey) AS BIGINT) AS total
FROM t JOIN r ON pos BETWEEN lo AND hi WHERE hi - lo + 1 <= {THRESHOLD} GROUP BY 1, 2, 3""")
def dnc_slices(spark: SparkSession, d: str) -> DataFrame:
    own = sorting.sort_global(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return tree.slices(_tree(spark, d), own.withColumn("pos", F.col("rank") - 1), "pos", "o_custkey")


@query(TREE + """, k AS (SELECT parent_id, count(*) AS n FROM t WHERE parent_id IS NOT NULL GROUP BY 1)
SELECT level, count(*) AS fanouts, CAST(sum(n - 1) AS BIGINT) AS invoked, count(n) AS becomes FROM t JOIN k ON k.parent_id = t.problem_id GROUP BY 1""")
def fanout_counts(spark: SparkSession, d: str) -> DataFrame:
    return tree.fanout_counts(_tree(spark, d))


RANKED = ", r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)"


def _positions(spark: SparkSession, d: str) -> DataFrame:
    own = sorting.sort_global(load(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return own.withColumn("pos", F.col("rank") - 1)


@query(TREE + RANKED + "SELECT problem_id, CAST(sum(o_custkey) AS BIGINT) AS result FROM t JOIN r ON pos BETWEEN lo AND hi WHERE level = 2 GROUP BY 1")
def program_partial_sums(spark: SparkSession, d: str) -> DataFrame:
    """A user program whose combining stops at level 2."""
    return program.execute(program.TREE_REDUCTION, _positions(spark, d), "pos", "o_custkey", output_level=2)


@query("SELECT '[0,1]' AS problem_id, unnest(range(count(*))) AS pos, unnest(list_sort(list(o_custkey))) AS o_custkey FROM orders")
def program_merge_sort(spark: SparkSession, d: str) -> DataFrame:
    """A user program whose root result is the sorted table, as ranked rows."""
    out = program.execute_sort(load(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "o_custkey")
    return out.withColumnRenamed("value", "o_custkey")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) - 1 AS pos, o_totalprice AS price FROM orders")
def program_quicksort(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's prices, in order of arrival, sorted by recursion about the last one."""
    own = load(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("a"))
    roots = own.select(F.concat(F.lit("["), F.col("o_custkey").cast("string"), F.lit(",1]")).alias("problem_id"), F.transform("a", lambda x: x["o_totalprice"]).alias("problem"))
    out = program.solve(program.QUICKSORT, roots).select(F.regexp_extract("problem_id", r"\[(\d+),", 1).cast("long").alias("o_custkey"), F.posexplode("result").alias("pos", "price"))
    return out.withColumn("pos", F.col("pos").cast("long"))


def _fibonacci_roots(spark: SparkSession, d: str, most: int) -> DataFrame:
    label = F.concat(F.lit("["), F.col("n_nationkey").cast("string"), F.lit(",1]"))
    return load(spark, d, "nation").where(F.col("n_nationkey") <= most).select(label.alias("problem_id"), F.col("n_nationkey").cast("long").alias("problem"))


@query(FIB + " SELECT '[' || n || ',1]' AS problem_id, CAST(a AS BIGINT) AS result FROM nation JOIN f ON n = n_nationkey WHERE n <= 10")
def program_fibonacci(spark: SparkSession, d: str) -> DataFrame:
    """The naive call tree, divided and combined level by level."""
    return program.solve(program.FIBONACCI, _fibonacci_roots(spark, d, 10))


@query(FIB + " SELECT '[' || n || ',1]' AS problem_id, CAST(a AS BIGINT) AS result FROM nation JOIN f ON n = n_nationkey WHERE n <= 16")
def program_fibonacci_memo(spark: SparkSession, d: str) -> DataFrame:
    """The same with memo labels: each value is divided once for all roots."""
    return program.solve(program.FIBONACCI_MEMO, _fibonacci_roots(spark, d, 16))


K_WAY = f"""
WITH RECURSIVE n AS (SELECT count(*) AS n FROM orders),
t AS (
  SELECT 0 AS level, CAST(0 AS BIGINT) AS lo, n - 1 AS hi FROM n
  UNION ALL
  SELECT level + 1, lo + (hi - lo + 1) * i // 3, lo + (hi - lo + 1) * (i + 1) // 3 - 1 FROM t, (SELECT unnest([0, 1, 2]) AS i) WHERE hi - lo + 1 > {THRESHOLD})
"""  # noqa: S608


def _k_way(spark: SparkSession, d: str) -> tuple[program.Recursion, DataFrame]:
    whole = F.struct(F.lit(0).cast("long").alias("low"), (F.count("*") - 1).alias("high"))
    return program.k_way_sum(3, THRESHOLD), load(spark, d, "orders").agg(whole.alias("problem")).select(F.lit("[0,1]").alias("problem_id"), "problem")


@query("SELECT '[0,1]' AS problem_id, count(*) * (count(*) - 1) // 2 AS result FROM orders")
def program_fanout_k(spark: SparkSession, d: str) -> DataFrame:
    """The sum of all positions, by a program that divides three ways."""
    return program.solve(*_k_way(spark, d))


@query(K_WAY + f"SELECT level, count(*) AS problems, count(*) FILTER (hi - lo + 1 <= {THRESHOLD}) AS leaves, CAST(sum(hi - lo + 1) AS BIGINT) AS elements FROM t GROUP BY 1")
def program_fanout_k_levels(spark: SparkSession, d: str) -> DataFrame:
    """What that program does at each level."""
    levels = program.expand(*_k_way(spark, d))
    out = levels[0]
    for at in levels[1:]:
        out = out.union(at)
    size = F.col("problem.high") - F.col("problem.low") + 1
    return out.groupBy("level").agg(F.count("*").alias("problems"), F.count_if("is_leaf").alias("leaves"), F.sum(size).alias("elements"))


@query(TREE + f""", r AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)
SELECT problem_id, lo AS from_idx, hi AS to_idx, count(*) AS n, arg_min(o_custkey, pos) AS first_value, arg_max(o_custkey, pos) AS last_value, CAST(sum(o_custkey) AS BIGINT) AS total
FROM t JOIN r ON pos BETWEEN lo AND hi WHERE level = 2 OR level < 2 AND hi - lo + 1 <= {THRESHOLD} GROUP BY 1, 2, 3""")
def dnc_inputs_at_level(spark: SparkSession, d: str) -> DataFrame:
    """Inputs are given out at level 2, to problems that are then divided further without input of their own."""
    return tree.slices(_tree(spark, d), _positions(spark, d), "pos", "o_custkey", level=2)


@query(TREE + "SELECT problem_id, problem_id || '[0,2]' AS first_child, problem_id || '[1,2]' AS second_child FROM t")
def label_fanout(spark: SparkSession, d: str) -> DataFrame:
    first, second = (labels.fanout(F.col("problem_id"), F.lit(i), F.lit(2)) for i in (0, 1))
    return _tree(spark, d).select("problem_id", first.alias("first_child"), second.alias("second_child"))


@query(TREE + r""", s AS (SELECT problem_id, regexp_extract_all(problem_id, '\[(\d+),(\d+)\]', 1) AS xs, regexp_extract_all(problem_id, '\[(\d+),(\d+)\]', 2) AS ys FROM t)
SELECT problem_id, CASE WHEN len(xs) = 1 THEN '' ELSE left(problem_id, length(problem_id) - length('[' || xs[-1] || ',' || ys[-1] || ']') - length('[' || xs[-2] || ',' || ys[-2] || ']')) END
  || '[' || (CAST(xs[greatest(len(xs) - 1, 1)] AS BIGINT) + CAST(ys[greatest(len(ys) - 1, 1)] AS BIGINT)) || ',' || ys[greatest(len(ys) - 1, 1)] || ']' AS fanin_id FROM s""")
def label_fanin(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("problem_id", labels.fanin(F.col("problem_id")).alias("fanin_id"))


@query(TREE + "SELECT problem_id, coalesce(parent_id, '') AS popped FROM t")
def label_parent(spark: SparkSession, d: str) -> DataFrame:
    return _tree(spark, d).select("problem_id", labels.parent(F.col("problem_id")).alias("popped"))


# fan-in


@query("""
SELECT l_orderkey, count(*) AS n, arg_max(CAST(l_quantity AS BIGINT), (l_linenumber, l_partkey, l_suppkey, l_quantity)) AS own,
  array_to_string(list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity)[:-2], ',') AS others
FROM lineitem GROUP BY 1 HAVING count(*) > 1""")
def fanin_last_combines(spark: SparkSession, d: str) -> DataFrame:
    return fanin.last_combines(load(spark, d, "lineitem"), "l_orderkey", LINE[1:], quantity())


@query("""
WITH r AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)
SELECT a.l_orderkey, (a.k + 1) // 2 AS pair, a.q AS first_value, b.q AS second_value FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.k % 2 = 1 AND b.k = a.k + 1""")
def sibling_join(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "lineitem").select(*LINE, quantity().alias("q"))
    return fanin.siblings(sorting.window_rank(own, "l_orderkey", [*LINE[1:], "q"], "k"), "l_orderkey", "k", "q")


@query("""
WITH c AS (SELECT l_orderkey, list({'line': l_linenumber, 'part': l_partkey, 'supplier': l_suppkey, 'q': CAST(l_quantity AS BIGINT)} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS a FROM lineitem GROUP BY 1),
s AS (SELECT l_orderkey, a[-1] AS receiver, unnest(a[:-2]) AS sender FROM c)
SELECT l_orderkey, sender.line AS sender, receiver.line AS receiver, sender.q AS result FROM s""")
def fanin_received(spark: SparkSession, d: str) -> DataFrame:
    """What is sent to the line of each order that becomes the parent."""
    own = load(spark, d, "lineitem").select(*LINE, quantity().alias("q"))
    got = fanin.received(own, "l_orderkey", [*LINE[1:], "q"], F.col("q"))
    return got.select("l_orderkey", F.col("sender.l_linenumber").alias("sender"), F.col("receiver.l_linenumber").alias("receiver"), "result")


RESULT = "SELECT o_orderkey, o_custkey // 4 % 3 - 1 AS type, o_custkey % 4 AS id FROM orders"


@query(f"WITH r AS ({RESULT}) SELECT a.o_orderkey, a.type = b.type AND a.id = b.id AS same FROM r a JOIN r b ON b.o_orderkey = a.o_orderkey + 3")
def result_equality(spark: SparkSession, d: str) -> DataFrame:
    """Results of orders, compared by type and id with those three orders on; values always differ."""
    key = F.col("o_orderkey")
    own = load(spark, d, "orders").select(key, labels.result(F.floor(F.col("o_custkey") / 4) % 3 - 1, F.col("o_custkey") % 4, key).alias("r"))
    other = own.select((key - 3).alias("o_orderkey"), F.col("r").alias("b"))
    return own.join(other, "o_orderkey").select("o_orderkey", labels.same_result(F.col("r"), F.col("b")).alias("same"))


@query("SELECT 'sum' AS program, CAST(sum(o_custkey) AS BIGINT) AS result FROM orders UNION ALL SELECT 'greatest', max(o_custkey) FROM orders UNION ALL SELECT 'count', count(*) FROM orders")
def invoked_programs(spark: SparkSession, d: str) -> DataFrame:
    """Three programs that run at the same time; their results are put together as they are withdrawn."""
    own = load(spark, d, "orders")
    hooks = {"sum": F.sum("o_custkey"), "greatest": F.max("o_custkey"), "count": F.count("*")}
    got = [df.select(F.lit(name).alias("program"), "result") for name, df in invoke.invoke({n: own.agg(h.cast("long").alias("result")) for n, h in hooks.items()})]
    return got[0].union(got[1]).union(got[2])


# Fibonacci and memoization

CALLS = """
WITH RECURSIVE c AS (SELECT 0 AS level, {n} AS value UNION ALL SELECT level + 1, value - s FROM c, (SELECT unnest([1, 2]) AS s) WHERE value > 1)
"""


@query(FIB + " SELECT n_nationkey, CAST(a AS BIGINT) AS fib FROM nation JOIN f ON n = n_nationkey")
def fib_sequence(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select("n_nationkey", recursion.fibonacci(F.col("n_nationkey")).cast("long").alias("fib"))


@query(CALLS.format(n=16) + "SELECT level, value, count(*) AS calls FROM c GROUP BY 1, 2")
def fib_call_tree(spark: SparkSession, d: str) -> DataFrame:
    return recursion.call_tree(spark, 16)


@query(CALLS.format(n=16) + "SELECT count(*) AS leaves, CAST(sum(value) AS BIGINT) AS total FROM c WHERE value <= 1")
def fib_leaf_sum(spark: SparkSession, d: str) -> DataFrame:
    return recursion.leaf_sum(recursion.call_tree(spark, 16))


@query(CALLS.format(n=16) + "SELECT count(*) AS calls, count(DISTINCT value) FILTER (value > 1) * 2 + 1 AS memoized, count(*) - count(DISTINCT value) FILTER (value > 1) * 2 - 1 AS saved FROM c")
def memo_savings(spark: SparkSession, d: str) -> DataFrame:
    return recursion.memo_savings(recursion.call_tree(spark, 16))


MEMO = """
WITH f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS computes, min(epoch_us(ts)) + arg_min(CAST(floor(value) AS BIGINT), (ts, event_id)) * 60000000 AS delivered_us FROM events GROUP BY 1),
o AS (
  SELECT event_id, e.user_id, CASE WHEN event_id = computes THEN 'compute' WHEN epoch_us(ts) < delivered_us THEN 'wait' ELSE 'hit' END AS outcome, epoch_us(ts) AS promised_us, delivered_us
  FROM events e JOIN f ON e.user_id = f.user_id)
"""


def _takes() -> Column:
    return F.floor("value").cast("long") * 60_000_000


@query(MEMO + "SELECT * FROM o")
def memo_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return memo.outcomes(load(spark, d, "events"), "user_id", "ts", "event_id", _takes())


@query(MEMO + "SELECT user_id, count(*) AS restarted, CAST(sum(delivered_us - promised_us) AS BIGINT) AS waited_us FROM o WHERE outcome = 'wait' GROUP BY 1")
def memo_restarts(spark: SparkSession, d: str) -> DataFrame:
    return memo.restarts(load(spark, d, "events"), "user_id", "ts", "event_id", _takes())


@query("SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events")
def memo_put_previous(spark: SparkSession, d: str) -> DataFrame:
    return memo.put_previous(load(spark, d, "events"), "user_id", "ts", "event_id", F.col("value"))


PAIRING = "CASE event_type WHEN 'signup' THEN 1 ELSE -1 END"


@query(f"""
WITH s AS (SELECT event_id, user_id, {PAIRING} AS sign, CAST(sum({PAIRING}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS live FROM events WHERE event_type IN ('signup', 'purchase'))
SELECT event_id, user_id, sign, live, live > 1 OR live < 0 AS violation FROM s""")  # noqa: S608
def pairing_live_count(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").where(F.col("event_type").isin("signup", "purchase"))
    return memo.live_names(log, "user_id", "ts", "event_id", F.when(F.col("event_type") == "signup", 1).otherwise(-1))


@query("SELECT user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 150) AS removed FROM events WHERE event_type = 'signup' GROUP BY 1")
def pairing_membership(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "events")
    return memo.membership(own.where("event_type = 'signup'"), own.where("event_type = 'error' AND value > 150"), "user_id")


# synchronization objects


@query("""
WITH r AS (SELECT event_id, event_type, ts, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 4 AS generation FROM events)
SELECT event_id, event_type, generation, CASE WHEN count(*) OVER g = 4 THEN max(ts) OVER g END AS released FROM r WINDOW g AS (PARTITION BY event_type, generation)""")
def barrier_release(spark: SparkSession, d: str) -> DataFrame:
    return sync.barrier(load(spark, d, "events").select("event_id", "event_type", "ts"), ["event_type"], "ts", "event_id", 4)


SIGN = "CASE event_type WHEN 'view' THEN -1 ELSE 1 END"


def _pv(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").where(F.col("event_type").isin("view", "click")).select("event_id", "event_type", "ts")


@query(f"""
WITH s AS (SELECT event_id, event_type, ts, CAST(3 + sum({SIGN}) OVER (ORDER BY ts, event_id) AS BIGINT) AS permits FROM events WHERE event_type IN ('view', 'click'))
SELECT *, greatest(0, -permits) AS waiters FROM s""")  # noqa: S608
def semaphore_permits(spark: SparkSession, d: str) -> DataFrame:
    return sync.permits(_pv(spark, d), [], "ts", "event_id", F.when(F.col("event_type") == "view", -1).otherwise(1), 3)


@query("""
WITH r AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('view', 'click')),
p AS (SELECT * FROM r WHERE event_type = 'view'), v AS (SELECT * FROM r WHERE event_type = 'click')
SELECT p.event_id, p.k, greatest(0, p.k - 3) AS needs, CASE WHEN p.k <= 3 THEN p.ts WHEN v.ts IS NOT NULL THEN greatest(p.ts, v.ts) END AS goes_on FROM p LEFT JOIN v ON v.k = p.k - 3""")
def semaphore_wait(spark: SparkSession, d: str) -> DataFrame:
    return sync.semaphore_waits(_pv(spark, d), [], "ts", "event_id", F.when(F.col("event_type") == "view", "P").otherwise("V"), 3)


@query("""
WITH RECURSIVE r AS MATERIALIZED (
  SELECT event_id, user_id % 16 AS name, ts, event_type = 'view' AS waits, event_type = 'purchase' AS leaves, row_number() OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS k
  FROM events WHERE event_type IN ('view', 'click', 'purchase')),
s AS (
  SELECT DISTINCT name, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS queue, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BIGINT) AS woken FROM r
  UNION ALL
  SELECT r.name, r.k, CASE WHEN r.waits THEN list_append(queue, r.event_id) ELSE queue[2:] END, r.event_id, CASE WHEN NOT r.waits THEN queue[1] END FROM s JOIN r ON r.name = s.name AND r.k = s.k + 1)
SELECT r.event_id, r.name, r.waits, CAST(len(s.queue) AS BIGINT) AS waiting, CASE WHEN r.waits THEN g.event_id ELSE s.woken END AS met,
  CASE WHEN r.waits THEN g.ts WHEN NOT r.leaves THEN r.ts END AS resumed, s.woken IS NOT NULL AND NOT r.leaves AS urgent
FROM s JOIN r ON r.name = s.name AND r.k = s.k LEFT JOIN (SELECT x.woken, y.event_id, y.ts FROM s x JOIN r y ON y.name = x.name AND y.k = x.k WHERE x.woken IS NOT NULL) g ON g.woken = r.event_id""")
def monitor_conditions(spark: SparkSession, d: str) -> DataFrame:
    """Views wait, clicks signal, and purchases signal and leave the monitor."""
    kind = F.col("event_type")
    log = load(spark, d, "events").where(kind.isin("view", "click", "purchase")).select("event_id", "event_type", (F.col("user_id") % 16).alias("name"), "ts")
    return monitor.conditions(log, ["name"], "ts", "event_id", kind == "view", kind == "purchase")


BUFFER = """
WITH r AS (SELECT event_id, event_type, user_id % 16 AS name, ts, row_number() OVER (PARTITION BY user_id % 16, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'view')),
c AS (
  SELECT coalesce(a.name, b.name) AS name, coalesce(a.k, b.k) AS k, a.event_id AS deposit, b.event_id AS withdrawal, a.ts AS offered, b.ts AS asked
  FROM (SELECT * FROM r WHERE event_type = 'purchase') a FULL JOIN (SELECT * FROM r WHERE event_type = 'view') b ON a.name = b.name AND a.k = b.k)
"""

BOUNDED = BUFFER + """,
m AS (
  SELECT *, CASE WHEN bool_and(offered IS NOT NULL AND asked IS NOT NULL) OVER l THEN max(greatest(offered, asked)) OVER l END AS withdrawn
  FROM c WINDOW l AS (PARTITION BY name, k % {n} ORDER BY k ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lag(withdrawn) OVER (PARTITION BY name, k % {n} ORDER BY k) AS freed FROM m)
SELECT name, k, deposit, withdrawal, CASE WHEN offered IS NULL THEN NULL WHEN k <= {n} THEN offered WHEN freed IS NOT NULL THEN greatest(offered, freed) END AS deposited, withdrawn FROM f
"""


def _dw(spark: SparkSession, d: str) -> tuple[DataFrame, list[str], str, str, Column]:
    log = load(spark, d, "events").where(F.col("event_type").isin("purchase", "view")).select("event_id", "event_type", (F.col("user_id") % 16).alias("name"), "ts")
    return log, ["name"], "ts", "event_id", F.when(F.col("event_type") == "purchase", "D").otherwise("W")


@query(BUFFER + "SELECT name, k, deposit, withdrawal, CASE WHEN offered IS NOT NULL AND asked IS NOT NULL THEN greatest(offered, asked) END AS passed FROM c")
def buffer_match(spark: SparkSession, d: str) -> DataFrame:
    return sync.buffer(*_dw(spark, d))


@query(BOUNDED.format(n=4))
def buffer_bounded(spark: SparkSession, d: str) -> DataFrame:
    return sync.bounded_buffer(*_dw(spark, d), capacity=4)


@query(BOUNDED.format(n=1))
def channel_send_receive(spark: SparkSession, d: str) -> DataFrame:
    """A channel holds one value: a buffer of capacity 1."""
    return sync.bounded_buffer(*_dw(spark, d), capacity=1)


@query("""
WITH e AS (SELECT event_id, ts, event_type, CASE event_type WHEN 'click' THEN ['V'] WHEN 'view' THEN ['P'] ELSE ['V', 'P'] END AS ks FROM events WHERE event_type IN ('view', 'click', 'purchase')),
x AS (SELECT event_id, ts, unnest(ks) AS kind, unnest(range(len(ks))) AS step FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id, step) AS k FROM x), p AS (SELECT * FROM r WHERE kind = 'P'), v AS (SELECT * FROM r WHERE kind = 'V')
SELECT p.event_id, p.k, greatest(0, p.k - 3) AS needs, CASE WHEN p.k <= 3 THEN p.ts WHEN v.ts IS NOT NULL THEN greatest(p.ts, v.ts) END AS goes_on FROM p LEFT JOIN v ON v.k = p.k - 3""")
def semaphore_vp(spark: SparkSession, d: str) -> DataFrame:
    """With a call that is a V and then a P."""
    log = load(spark, d, "events").where(F.col("event_type").isin("view", "click", "purchase")).select("event_id", "event_type", "ts")
    both = sync.with_both(log, F.when(F.col("event_type") == "click", "V").when(F.col("event_type") == "view", "P").otherwise("VP"))
    return sync.semaphore_waits(both, [], "ts", "event_id", F.col("kind"), 3, ("step",))


BICHANNEL = """
WITH r AS (
  SELECT event_id, event_type IN ('purchase', 'click') AS sends, user_id % 16 AS name, CASE WHEN event_type IN ('purchase', 'view') THEN 'out' ELSE 'back' END AS direction, ts,
    row_number() OVER (PARTITION BY user_id % 16, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type IN ('purchase', 'view', 'click', 'signup')),
c AS (
  SELECT coalesce(a.name, b.name) AS name, coalesce(a.direction, b.direction) AS direction, coalesce(a.k, b.k) AS k, a.event_id AS deposit, b.event_id AS withdrawal, a.ts AS offered, b.ts AS asked
  FROM (SELECT * FROM r WHERE sends) a FULL JOIN (SELECT * FROM r WHERE NOT sends) b ON a.name = b.name AND a.direction = b.direction AND a.k = b.k),
m AS (SELECT *, CASE WHEN bool_and(offered IS NOT NULL AND asked IS NOT NULL) OVER l THEN max(greatest(offered, asked)) OVER l END AS withdrawn FROM c WINDOW l AS (PARTITION BY name, direction ORDER BY k ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, lag(withdrawn) OVER (PARTITION BY name, direction ORDER BY k) AS freed FROM m)
SELECT name, direction, k, deposit, withdrawal, CASE WHEN offered IS NULL THEN NULL WHEN k <= 1 THEN offered WHEN freed IS NOT NULL THEN greatest(offered, freed) END AS deposited, withdrawn FROM f
"""


@query(BICHANNEL)
def bichannel_send_receive(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.col("event_type")
    log = load(spark, d, "events").where(kinds.isin("purchase", "view", "click", "signup"))
    log = log.select("event_id", "event_type", (F.col("user_id") % 16).alias("name"), F.when(kinds.isin("purchase", "view"), "out").otherwise("back").alias("direction"), "ts")
    return sync.bichannel(log, ["name"], "direction", "ts", "event_id", F.when(kinds.isin("purchase", "click"), "D").otherwise("W"))


@query("""
WITH s AS (
  SELECT event_id, user_id, event_type = 'purchase' AS delivers, CAST(count(*) FILTER (event_type <> 'purchase') OVER o AS BIGINT) AS promised, CAST(count(*) FILTER (event_type = 'purchase') OVER o AS BIGINT) AS delivered
  FROM events WHERE event_type IN ('purchase', 'signup') WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, promised, delivered, CASE WHEN promised = 0 THEN 'unknown label' WHEN delivered > 1 THEN 'double delivery' END AS violation FROM s WHERE delivers""")
def memo_violations(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").where(F.col("event_type").isin("purchase", "signup"))
    return memo.violations(log, "user_id", "ts", "event_id", F.col("event_type") == "purchase")


CLASS = "CASE user_id % 3 WHEN 0 THEN 'Barrier' WHEN 1 THEN 'Semaphore' ELSE 'Counter' END"


@query("SELECT event_id, user_id % 16 AS name, CASE user_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'no source' ELSE 'invalid class' END AS status FROM events WHERE event_type = 'signup'")
def synchronizer_create(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "events").where("event_type = 'signup'")
    return own.select("event_id", (F.col("user_id") % 16).alias("name"), calls.create_status(F.expr(CLASS)).alias("status"))


@query("""
WITH e AS (
  SELECT event_id, ts, user_id % 16 AS name, event_type, count(*) FILTER (event_type = 'signup' AND user_id % 3 = 0) OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS objects
  FROM events WHERE event_type <> 'error'),
c AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, event_id) AS call FROM e WHERE objects > 0 AND event_type <> 'signup'),
g AS (SELECT *, call % 4 <> 0 AS blocks, CASE WHEN count(*) OVER w = 4 THEN max(ts) OVER w END AS released FROM c WINDOW w AS (PARTITION BY name, (call - 1) // 4))
SELECT event_id, name, CASE WHEN event_type = 'purchase' THEN 'none' WHEN event_type = 'view' AND blocks THEN 'blocking' ELSE 'state' END AS reply,
  CASE WHEN event_type = 'view' AND blocks THEN ts WHEN event_type <> 'purchase' THEN released END AS answered, CASE WHEN blocks AND event_type <> 'click' THEN released END AS restarted FROM g
UNION ALL SELECT event_id, name, 'unknown object', ts, NULL FROM e WHERE objects = 0 AND event_type <> 'signup'""")
def synchronizer_calls(spark: SparkSession, d: str) -> DataFrame:
    """Sign-ups create objects, views try, clicks wait, and purchases are asynchronous."""
    kind = F.col("event_type")
    own = load(spark, d, "events").where(kind != "error").select("event_id", "event_type", "user_id", (F.col("user_id") % 16).alias("name"), "ts")
    method = F.when(kind == "view", "try_wait_b").otherwise("wait_b")
    return calls.barrier_calls(own, ["name"], "ts", "event_id", F.when(kind == "signup", F.expr(CLASS)), method, kind != "purchase", 4)


# the same over streams


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    at = f"{d}/events.parquet"
    table = spark.read.parquet(at)
    reader = spark.readStream.schema(table.schema)
    if any(f.endswith("/events.parquet") for f in table.inputFiles()):  # a stream reads folders: take this file from its folder
        return reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return reader.parquet(at)


@query("""
WITH r AS (SELECT event_type AS name, event_id, ts, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 4 AS generation FROM events),
g AS (SELECT *, count(*) OVER w AS n, max(ts) OVER w AS released FROM r WINDOW w AS (PARTITION BY name, generation))
SELECT name, event_id, generation, released FROM g WHERE n = 4""")
def stream_barrier(spark: SparkSession, d: str) -> DataFrame:
    own = _event_stream(spark, d).select(F.col("event_type").alias("name"), "event_id", "ts")
    return replay.drained(replay.barrier(own, 4), "stream-barrier")


@query("""
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS name, event_id, row_number() OVER o AS arrived, array_to_string(list(event_id) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ',') AS others FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT name, event_id, arrived, arrived = 3 AS combines, CASE WHEN arrived = 3 THEN others END AS others FROM r""")
def stream_fanin(spark: SparkSession, d: str) -> DataFrame:
    own = _event_stream(spark, d).select(F.col("user_id").cast("string").alias("name"), "event_id", "ts", F.col("event_id").alias("result"))
    return replay.drained(replay.fanin(own, 3), "stream-fanin")


@query(f"""
WITH s AS (SELECT CAST(user_id % 16 AS VARCHAR) AS name, event_id, CAST(3 + sum({SIGN}) OVER (PARTITION BY user_id % 16 ORDER BY ts, event_id) AS BIGINT) AS permits FROM events WHERE event_type IN ('view', 'click'))
SELECT *, greatest(0, -permits) AS waiters FROM s""")  # noqa: S608
def stream_semaphore(spark: SparkSession, d: str) -> DataFrame:
    own = _event_stream(spark, d).where(F.col("event_type").isin("view", "click")).select((F.col("user_id") % 16).cast("string").alias("name"), "event_id", "ts", F.when(F.col("event_type") == "view", -1).otherwise(1).alias("sign"))
    return replay.drained(replay.semaphore(own, 3), "stream-semaphore")


@query(BUFFER + "SELECT CAST(name AS VARCHAR) AS name, k, deposit, withdrawal, greatest(offered, asked) AS passed FROM c WHERE offered IS NOT NULL AND asked IS NOT NULL")
def stream_buffer(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "purchase", "D").otherwise("W")
    own = _event_stream(spark, d).where(F.col("event_type").isin("purchase", "view")).select((F.col("user_id") % 16).cast("string").alias("name"), "event_id", "ts", kinds.alias("kind"))
    return replay.drained(replay.buffer(own), "stream-buffer")


# trials


def _rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("SELECT count(value) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS greatest, round(avg(value), 4) AS mean FROM events")
def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rounded(trials.summary(load(spark, d, "events"), "value"), "mean"), "total", digits=2)


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def group_means(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trials.summary(load(spark, d, "events"), "value", "event_type").select("event_type", "mean"), "mean")


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(var_samp(value), 4) AS var FROM events GROUP BY 1")
def desc_stats(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trials.described(load(spark, d, "events"), "value", "event_type"), "mean", "std", "var")


@query("SELECT event_type, count(value) AS n, round(stddev_samp(value), 4) AS std FROM events GROUP BY 1")
def sample_std_formula(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(trials.std_by_squares(load(spark, d, "events"), "value", "event_type"), "std")


BOTH = """
WITH e AS (SELECT user_id % 8 AS problem, event_type, value FROM events),
g AS (SELECT problem, event_type, count(value) AS n, avg(value) AS m, var_samp(value) AS s FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2),
b AS (SELECT a.problem, a.n AS n1, a.m AS m1, a.s AS s1, b.n AS n2, b.m AS m2, b.s AS s2 FROM g a JOIN g b ON a.problem = b.problem AND a.event_type = 'click' AND b.event_type = 'view' WHERE a.n > 1 AND b.n > 1)
"""
DF = "(s1 / n1 + s2 / n2) ** 2 / ((s1 / n1) ** 2 / (n1 - 1) + (s2 / n2) ** 2 / (n2 - 1))"


def _both(spark: SparkSession, d: str) -> DataFrame:
    return trials.samples(load(spark, d, "events").withColumn("problem", F.col("user_id") % 8), "event_type", "value", "click", "view", "problem")


@query(BOTH + f"SELECT problem, round({DF}, 4) AS df FROM b")
def welch_df(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("problem", F.round(trials.welch_df(), 4).alias("df"))


@query(BOTH + f"SELECT problem, round({DF} - 2, 4) AS df FROM b")
def welch_df_minus2(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("problem", F.round(trials.unpaired_df(), 4).alias("df"))


@query(BOTH + "SELECT problem, round((m1 - m2) / sqrt(s1 / n1 + s2 / n2), 4) AS t FROM b")
def welch_t(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("problem", F.round(trials.welch_t(), 4).alias("t"))


@query(BOTH + "SELECT problem, round(sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)), 4) AS std FROM b")
def pooled_std(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("problem", F.round(trials.pooled_std(), 4).alias("std"))


@query(BOTH + "SELECT problem, n1, n2, round(m1, 4) AS m1, round(m2, 4) AS m2, m1 < m2 AS first_is_faster FROM b")
def compare_systems(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d).select("problem", "n1", "n2", F.round("m1", 4).alias("m1"), F.round("m2", 4).alias("m2"), (F.col("m1") < F.col("m2")).alias("first_is_faster"))


#: Student's t in SQL: the density integrated by Simpson's rule over 400 steps, and its quantile by bisection.
STUDENT = BOTH + """,
s AS (SELECT *, {df} AS df, (m1 - m2) / sqrt(s1 / n1 + s2 / n2) AS t, sqrt(((n1 - 1) * s1 + (n2 - 1) * s2) / (n1 + n2 - 2)) AS pooled FROM b),
c AS (SELECT *, exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) AS front FROM s),
q AS (
  WITH RECURSIVE h AS (
    SELECT problem, df, front, CAST(0 AS DOUBLE) AS low, CAST(64 AS DOUBLE) AS high, 0 AS i FROM c
    UNION ALL
    SELECT problem, df, front, CASE WHEN {area} < 0.475 THEN (low + high) / 2 ELSE low END, CASE WHEN {area} < 0.475 THEN high ELSE (low + high) / 2 END, i + 1 FROM h WHERE i < 50)
  SELECT problem, (low + high) / 2 AS t_crit FROM h WHERE i = 50),
w AS (SELECT c.*, q.t_crit, 1 - 2 * {p} AS p FROM c JOIN q ON c.problem = q.problem)
"""


def _area(x: str) -> str:
    """The integral of the density from 0 to x."""
    point = f"power(1 + power({x} * j / 400.0, 2) / df, -(df + 1) / 2)"
    return f"(front * {x} / 1200.0 * list_sum([(CASE WHEN j = 0 OR j = 400 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END) * {point} FOR j IN range(401)]))"


def _student(df: str) -> str:
    return STUDENT.format(df=df, area=_area("((low + high) / 2)"), p=_area("abs(t)"))


@query(_student(DF) + """, i AS (SELECT *, (m1 - m2) - t_crit * sqrt(1.0 / n1 + 1.0 / n2) * pooled AS low, (m1 - m2) + t_crit * sqrt(1.0 / n1 + 1.0 / n2) * pooled AS high FROM w)
SELECT problem, round(df, 4) AS df, round(t, 4) AS t, round(t_crit, 4) AS t_crit, round(p, 4) AS p, round(low, 4) AS low, round(high, 4) AS high, printf('[%.3f,%.3f]', low, high) AS ci FROM i""")
def welch_ci(spark: SparkSession, d: str) -> DataFrame:
    return trials.intervals(_both(spark, d)).select("problem", *(F.round(x, 4).alias(x) for x in ("df", "t", "t_crit", "p", "low", "high")), "ci")


@query(_student(f"{DF} - 2") + """, i AS (SELECT *, (m1 - m2) - t_crit * sqrt(s1 / n1 + s2 / n2) AS low, (m1 - m2) + t_crit * sqrt(s1 / n1 + s2 / n2) AS high FROM w)
SELECT problem, round(df, 4) AS df, round(t_crit, 4) AS t_crit, round(low, 4) AS low, round(high, 4) AS high, low <= 0 AND high >= 0 AS contains_zero FROM i""")
def ci_contains_zero(spark: SparkSession, d: str) -> DataFrame:
    return trials.unpaired(_both(spark, d)).select("problem", *(F.round(x, 4).alias(x) for x in ("df", "t_crit", "low", "high")), "contains_zero")


@query("SELECT event_id, round(value * 1000 * 2.1e-9 * 2, 12) AS cost FROM events")
def cost_ms(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(trials.cost_by_ms(F.col("value")), 12).alias("cost"))


@query("SELECT event_id, round(value / 60 * 2.1e-9 * 2, 16) AS cost FROM events")
def cost_min(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.round(trials.cost_by_minute(F.col("value")), 16).alias("cost"))


TYPES = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in TYPES) + " FROM events GROUP BY 1")
def pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    out = trials.pivot_wide(load(spark, d, "events"), "user_id", "event_type", TYPES, F.count(F.lit(1)))
    return out.fillna(0, TYPES)


@query("SELECT event_id, 'click' AS system, value FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'view', value FROM events WHERE event_type = 'view'")
def union_trials(spark: SparkSession, d: str) -> DataFrame:
    own = load(spark, d, "events")
    return trials.union_trials(*(own.where(F.col("event_type") == s).select("event_id", F.lit(s).alias("system"), "value") for s in ("click", "view")))


@query("SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events GROUP BY 1")
def durations(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg((trials.micros(F.max("ts")) - trials.micros(F.min("ts"))).alias("duration_us"))


@query("""
WITH d AS (SELECT user_id, event_type, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2)
SELECT *, row_number() OVER (ORDER BY event_type DESC, user_id) AS rank FROM d""")
def durations_list(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of tasks, added to a list by two runs and read newest first."""
    at, own = fresh(spark, "durations"), load(spark, d, "events")
    for i, kind in enumerate(("click", "view")):
        files.push(own.where(F.col("event_type") == kind).groupBy("user_id", "event_type").agg((trials.micros(F.max("ts")) - trials.micros(F.min("ts"))).alias("duration_us")), at, i)
    return sorting.sort_global(files.pushed(spark, at, "user_id long, event_type string, duration_us long"), [F.desc("batch"), "user_id"]).drop("batch")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_custkey * 40 > 32000 WHEN 1 THEN o_custkey * 40 > 25 ELSE false END AS too_large FROM orders")
def parameter_checks(spark: SparkSession, d: str) -> DataFrame:
    """Problems that are larger than drivers take without a complaint; there is no limit for reductions."""
    algorithm = F.expr("CASE o_orderkey % 3 WHEN 0 THEN 'mergesort' WHEN 1 THEN 'fibonacci' ELSE 'treereduction' END")
    return load(spark, d, "orders").select("o_orderkey", trials.too_large(algorithm, F.col("o_custkey") * 40).alias("too_large"))


# strings, messages and files


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", labels.message_field(F.col("props"), "k").cast("long").alias("k"))


@query("WITH m AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'try_' ELSE '' END || event_type AS method FROM events) SELECT event_id, starts_with(method, 'try_') AS is_try, CASE WHEN starts_with(method, 'try_') THEN substr(method, 5) ELSE method END AS name FROM m")
def method_try_split(spark: SparkSession, d: str) -> DataFrame:
    method = F.concat(F.when(F.col("event_id") % 2 == 0, "try_").otherwise(""), "event_type")
    return load(spark, d, "events").select("event_id", method.alias("m")).select("event_id", labels.is_try(F.col("m")).alias("is_try"), labels.without_try(F.col("m")).alias("name"))


@query("SELECT o_custkey, CAST(len(list(o_orderkey)) AS BIGINT) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders GROUP BY 1")
def parse_list_literal(spark: SparkSession, d: str) -> DataFrame:
    """Lists written as text files and read again, keyed by their first element."""
    own = load(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("numbers"))
    at = fresh(spark, "lists")
    files.write_lists(own.select(F.concat(F.array("o_custkey"), "numbers").alias("numbers")), at, "numbers")
    back = files.read_lists(spark, at)
    return back.select(F.element_at("numbers", 1).alias("o_custkey"), (F.size("numbers") - 1).cast("long").alias("n"), (F.aggregate("numbers", F.lit(0).cast("long"), lambda a, x: a + x) - F.element_at("numbers", 1)).alias("total"))


@query("SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = fresh(spark, "csv")
    files.write_csv(_rounded(trials.summary(load(spark, d, "events"), "value", "event_type").select("event_type", "n", "mean"), "mean"), at)
    return files.read_csv(spark, at, "event_type string, n bigint, mean double")


@query("SELECT event_type, min(value) AS least, max(value) AS greatest FROM events GROUP BY 1")
def tsv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    at = fresh(spark, "tsv")
    files.write_csv(trials.summary(load(spark, d, "events"), "value", "event_type").select("event_type", "least", "greatest"), at, "\t")
    return files.read_csv(spark, at, "event_type string, least double, greatest double", "\t", glob="*.csv")


@query("SELECT n_nationkey, n_name, n_regionkey AS threshold FROM nation")
def threshold_of_file(spark: SparkSession, d: str) -> DataFrame:
    """Files of a folder by suffix, each row with the number in its file's path."""
    at = fresh(spark, "files")
    own = load(spark, d, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("seq"))
    own.write.partitionBy("seq").option("header", True).csv(at)
    return files.read_with_threshold(spark, at, "n_nationkey long, n_name string")


@query("SELECT n_nationkey, n_name FROM nation")
def from_pandas(spark: SparkSession, d: str) -> DataFrame:
    """A table of the driver, which 25 rows may be, dealt over ten partitions."""
    return files.from_pandas(spark, load(spark, d, "nation").select("n_nationkey", "n_name").toPandas(), 10)


@query("SELECT user_id, printf('[%.3f,%.3f]', min(value), max(value)) AS span, CAST(round(max(value)) AS BIGINT) AS whole FROM events GROUP BY 1")
def formatted_spans(spark: SparkSession, d: str) -> DataFrame:
    """Casts and formatting."""
    own = load(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return own.select("user_id", F.format_string("[%.3f,%.3f]", "low", "high").alias("span"), F.round("high").cast("long").alias("whole"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids, 36 AS shortest, 36 AS longest FROM events")
def message_ids(spark: SparkSession, d: str) -> DataFrame:
    """A UUID for each message: none twice."""
    own = load(spark, d, "events").select(F.uuid().alias("id"))
    return own.groupBy("id").agg(F.count("*").alias("c")).agg(F.sum("c").alias("n"), F.count("*").alias("ids"), F.min(F.length("id")).alias("shortest"), F.max(F.length("id")).alias("longest"))


@query("SELECT o_orderkey, o_orderkey % 1024 AS threshold FROM orders")
def threshold_from_name(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("sort_8196_seq="), F.col("o_orderkey") % 1024, F.lit("_bench.csv"))
    return load(spark, d, "orders").select("o_orderkey", labels.threshold_in(path).alias("threshold"))


@query("SELECT event_id, event_type AS op, CAST(user_id AS VARCHAR) AS name FROM events")
def message_round_trip(spark: SparkSession, d: str) -> DataFrame:
    sent = labels.envelope(F.col("event_type").alias("op"), F.col("user_id").cast("string").alias("name"))
    back = load(spark, d, "events").select("event_id", labels.opened(F.rtrim(sent, F.lit("="))).alias("m"))
    return back.select("event_id", labels.message_field(F.col("m"), "op").alias("op"), labels.message_field(F.col("m"), "name").alias("name"))


@query("SELECT o_orderkey, CAST(o_orderkey % 97 AS VARCHAR) AS label FROM orders")
def memo_labels(spark: SparkSession, d: str) -> DataFrame:
    label = F.concat_ws("-", F.lit("root"), F.col("o_custkey").cast("string"), (F.col("o_orderkey") % 97).cast("string"))
    return load(spark, d, "orders").select("o_orderkey", labels.memo_label(label).alias("label"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey + (l_partkey + l_orderkey - l_orderkey) // 2 AS mid FROM lineitem")
def midpoints(spark: SparkSession, d: str) -> DataFrame:
    low = F.col("l_orderkey")
    return load(spark, d, "lineitem").select(*LINE, tree.midpoint(low, low + F.col("l_partkey")).alias("mid"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS places, true AS within, true AS both_signs FROM orders")
def random_numbers(spark: SparkSession, d: str) -> DataFrame:
    """As many numbers as orders: their places and bounds."""
    own = files.random_numbers(spark, load(spark, d, "orders").count())
    return own.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("places"), F.expr("min(v) >= -1000 AND max(v) <= 1000").alias("within"), F.expr("min(v) < 0 AND max(v) > 0").alias("both_signs"))
