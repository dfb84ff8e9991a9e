"""User programs: hooks that say how a problem is divided, solved and combined, and builders that turn them into plans.

The hooks are Column expressions and DataFrame transforms, so a program is planned, not interpreted. There are two kinds:

* Program, over ranges of a table's rows: leaves are one aggregation, combining another, whatever the depth of the tree.
* Recursion, over problems that are values: all problems of a level are divided by one projection and combined by one
  aggregation by parent. With memo labels, problems of equal label are solved once, at whatever level they turn up.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..operators.sorting import sort_global
from ..storage import written
from .tree import ROOT, range_tree, with_leaf


def _same(df: DataFrame) -> DataFrame:
    return df


def _problem(problem: Column) -> Column:
    return problem


@dataclass(frozen=True)
class Program:
    """What a user writes for ranges of rows.

    sequential: the result of a leaf, an aggregate over its rows. combine: the result of a problem, an aggregate over those of
    its subproblems (column `result`); it must be associative. preprocess and output transform the rows before and the
    result after. threshold: the size up to which a problem is a leaf.
    """

    sequential: Callable[[Column], Column]
    combine: Callable[[Column], Column]
    threshold: int = 128
    preprocess: Callable[[DataFrame], DataFrame] = field(default=_same)
    output: Callable[[DataFrame], DataFrame] = field(default=_same)

    def __post_init__(self) -> None:
        if self.threshold < 1:
            raise ValueError("a problem can't be divided below one element")


def execute(program: Program, rows: DataFrame, position: str, value: str, n: int | None = None, output_level: int = 0) -> DataFrame:
    """(problem_id, result) at output_level: the root's only row, or, where combining stops early, up to 2**level rows.

    position: 0 to n - 1, each once. Leaves above the level are results as they are. No row for no input. As combining is
    associative, all leaves below a problem are combined at once: two exchanges at any depth.
    """
    if output_level < 0:
        raise ValueError("the root is level 0")
    own = program.preprocess(rows)
    n = own.count() if n is None else n
    tree = range_tree(rows.sparkSession, n, program.threshold)
    met = with_leaf(tree, own.select(F.col(position).alias("__pos"), F.col(value).alias("__value")), "__pos")
    leaves = met.groupBy("problem_id").agg(program.sequential(F.col("__value")).alias("result"))
    above = F.array_join(F.slice(F.split("problem_id", r"(?<=\])"), 1, output_level + 1), "")
    return program.output(leaves.groupBy(above.alias("problem_id")).agg(program.combine(F.col("result")).alias("result")))


def execute_sort(rows: DataFrame, position: str, value: str) -> DataFrame:
    """Merge sort as a program: (problem_id, pos, value), the root's result as ranked rows, never as an array.

    One range exchange takes the place of a merge a level; its sorted ranges are the leaves.
    """
    own = rows.select(F.col(position).alias("__at"), F.col(value).alias("value"))
    at = sort_global(own, ["value", "__at"], "rank")
    return at.select(F.lit(ROOT).alias("problem_id"), (F.col("rank") - 1).alias("pos"), "value")


@dataclass(frozen=True)
class Recursion:
    """What a user writes for problems that are values; each hook maps a column to a column.

    base_case: whether a problem is solved as it is. divide: the array of its subproblems, of any number. sequential: the result
    of a base case. combine: the result of a problem from the problem and the array of its subproblems' results, in their order.
    preprocess: a problem before it is looked at. memo_label: the key under which results are shared, None for no sharing.
    """

    base_case: Callable[[Column], Column]
    divide: Callable[[Column], Column]
    sequential: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    preprocess: Callable[[Column], Column] = field(default=_problem)
    memo_label: Callable[[Column], Column] | None = None
    max_levels: int = 200


def expand(program: Recursion, roots: DataFrame) -> list[DataFrame]:
    """The problems of each level: problem_id, parent_id, child_idx, fan_out, level, problem, is_leaf.

    roots: (problem_id, problem). Each level is a projection of the one before, written to the shared folder.
    """
    def ready(df: DataFrame) -> DataFrame:
        seen = df.withColumn("problem", program.preprocess(F.col("problem")))
        return seen.withColumn("is_leaf", program.base_case(F.col("problem")))

    none = F.lit(None)
    at = written(ready(roots.select("problem_id", none.cast("string").alias("parent_id"), none.cast("int").alias("child_idx"), F.lit(1).alias("fan_out"), F.lit(0).alias("level"), "problem")), "problems")
    out = [at]
    while (inner := at.where(~F.col("is_leaf"))).limit(1).count():
        if len(out) > program.max_levels:
            raise RecursionError(f"problems are still divided at level {program.max_levels}")
        parts = inner.select("problem_id", "level", program.divide(F.col("problem")).alias("parts"))
        parts = parts.select("problem_id", "level", F.size("parts").alias("fan_out"), F.posexplode("parts").alias("child_idx", "problem"))
        child = labels.fanout(F.col("problem_id"), F.col("child_idx"), F.col("fan_out"))
        at = written(ready(parts.select(child.alias("problem_id"), F.col("problem_id").alias("parent_id"), "child_idx", "fan_out", (F.col("level") + 1).alias("level"), "problem")), "problems")
        out.append(at)
    return out


def solve(program: Recursion, roots: DataFrame) -> DataFrame:
    """(problem_id, result) of the roots. A problem without subproblems that is no base case has no result and no row."""
    if program.memo_label is not None:
        return _solve_memoized(program, roots)
    levels = expand(program, roots)
    below: DataFrame | None = None
    for at in reversed(levels):
        done = at.where("is_leaf").select("problem_id", "parent_id", "child_idx", "fan_out", program.sequential(F.col("problem")).alias("result"))
        if below is not None:
            met = below.groupBy(F.col("parent_id").alias("problem_id")).agg(F.array_sort(F.collect_list(F.struct("child_idx", "result"))).alias("got"))  # fan_out entries
            inner = at.where(~F.col("is_leaf")).join(met, "problem_id")
            done = done.union(inner.select("problem_id", "parent_id", "child_idx", "fan_out", program.combine(F.col("problem"), F.col("got.result")).alias("result")))
        below = written(done, "results")
    return below.select("problem_id", "result")


def _solve_memoized(program: Recursion, roots: DataFrame) -> DataFrame:
    """Problems by label: each label is divided once, when it first turns up, and its result goes to all that wait for it."""
    def labelled(df: DataFrame) -> DataFrame:
        seen = df.withColumn("problem", program.preprocess(F.col("problem")))
        return seen.withColumn("label", program.memo_label(F.col("problem")).cast("string")).withColumn("is_leaf", program.base_case(F.col("problem")))

    asked = written(labelled(roots.select("problem_id", "problem")), "roots")
    known = written(asked.select("label", "problem", "is_leaf").dropDuplicates(["label"]), "known")
    new, edges = known, None
    rounds = 0
    while (inner := new.where(~F.col("is_leaf"))).limit(1).count():
        if (rounds := rounds + 1) > program.max_levels:
            raise RecursionError(f"new labels still turn up at level {program.max_levels}")
        parts = inner.select(F.col("label").alias("parent"), F.posexplode(program.divide(F.col("problem"))).alias("child_idx", "problem"))
        parts = written(labelled(parts), "parts")
        link = parts.select("parent", "child_idx", "label")
        edges = link if edges is None else written(edges.union(link), "edges")
        new = written(parts.select("label", "problem", "is_leaf").dropDuplicates(["label"]).join(known, "label", "left_anti"), "new")
        known = written(known.union(new), "known")
    done = written(known.where("is_leaf").select("label", program.sequential(F.col("problem")).alias("result")), "results")
    if edges is not None:
        need = edges.groupBy(F.col("parent").alias("label")).agg(F.count("*").alias("need"))
        waiting = written(known.where(~F.col("is_leaf")).join(need, "label"), "waiting")
        while waiting.limit(1).count():
            met = edges.join(done, "label").groupBy(F.col("parent").alias("label")).agg(F.array_sort(F.collect_list(F.struct("child_idx", "result"))).alias("got"))
            found = waiting.join(met, "label").where(F.size("got") == F.col("need"))
            found = written(found.select("label", program.combine(F.col("problem"), F.col("got.result")).alias("result")), "found")
            if not found.limit(1).count():
                raise RecursionError("problems wait for each other")
            done = written(done.union(found), "results")
            waiting = written(waiting.join(found, "label", "left_anti"), "waiting")
    return asked.join(done, "label").select("problem_id", "result")


TREE_REDUCTION = Program(sequential=F.sum, combine=F.sum)

#: Naive Fibonacci numbers, and the same with shared results.
FIBONACCI = Recursion(
    base_case=lambda v: v <= 1,
    divide=lambda v: F.array(v - 1, v - 2),
    sequential=lambda v: v,
    combine=lambda _, got: F.element_at(got, 1) + F.element_at(got, 2),
)
FIBONACCI_MEMO = Recursion(FIBONACCI.base_case, FIBONACCI.divide, FIBONACCI.sequential, FIBONACCI.combine, memo_label=lambda v: v)


def _split(values: Column) -> Column:
    """Values not above the last one, that one, and the rest."""
    pivot, rest = F.element_at(values, -1), F.slice(values, 1, F.size(values) - 1)
    return F.array(F.filter(rest, lambda x: x <= pivot), F.array(pivot), F.filter(rest, lambda x: x > pivot))


#: Quicksort of arrays: the pivot is a subproblem of one element, so that combining is to put the arrays end to end.
QUICKSORT = Recursion(
    base_case=lambda a: F.size(a) <= 1,
    divide=_split,
    sequential=lambda a: a,
    combine=lambda _, got: F.flatten(got),
)


def k_way_sum(k: int, threshold: int) -> Recursion:
    """The sum of the whole numbers of a range struct(low, high), divided into k ranges as equal as can be."""

    def divide(p: Column) -> Column:
        size = p["high"] - p["low"] + 1
        cut = lambda i: p["low"] + F.floor(size * i / k)
        return F.array(*(F.struct(cut(i).alias("low"), (cut(i + 1) - 1).alias("high")) for i in range(k)))

    return Recursion(
        base_case=lambda p: p["high"] - p["low"] + 1 <= threshold,
        divide=divide,
        sequential=lambda p: F.floor((p["low"] + p["high"]) * (p["high"] - p["low"] + 1) / 2),
        combine=lambda _, got: F.aggregate(got, F.lit(0).cast("long"), lambda a, x: a + x),
    )
