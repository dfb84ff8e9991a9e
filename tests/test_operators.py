import math
import os
import random

import pytest
from pyspark.sql import functions as F

from ramify.functions import labels, student
from ramify.operators import calls, fanin, memo, monitor, recursion, reduction, scan, sorting, sync, trials
from ramify.plans import invoke, program, tree
from ramify.sources import files
from ramify.storage import flush, fresh, written

GOLDEN = [9, -3, 5, 0, 1, 2, -1, 4, 11, 10, 13, 12, 15, 14, 17, 16]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sort_of_sixteen(spark):
    df = spark.createDataFrame(list(enumerate(GOLDEN)), "pos long, v long")
    assert [r.v for r in sorting.sort_global(df, ["v", "pos"]).orderBy("rank").collect()] == sorted(GOLDEN)


@pytest.mark.parametrize("values", [[], [7], [5] * 40, list(range(30)), list(range(30, 0, -1))])
def test_sort_of_odd_inputs(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    got = sorting.sort_global(df, ["v", "pos"]).collect()
    assert [r.v for r in sorted(got, key=lambda r: r["rank"])] == sorted(values)
    assert sorted(r["rank"] for r in got) == list(range(1, len(values) + 1))


def test_prefix_sums_with_a_hot_and_a_null_key(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice([None, 1, 1, 1, 1, 2]), i, rnd.randint(-3, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    got = {r["at"]: r.total for r in scan.prefix(df, ["k"], ["at"], {"total": F.col("v")}).collect()}
    sums, want = {}, {}
    for k, at, v in rows:
        sums[k] = want[at] = sums.get(k, 0) + v
    assert got == want


def test_verify_finds_disorder(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (3, 9), (5, 10)], "rank long, v long")
    r = sorting.verify(df, "rank", "v").first()
    assert (r.n, r.out_of_order, r.gaps) == (4, 1, 1)


def test_quicksort_step_of_nothing(spark):
    assert sorting.quicksort_step(spark.createDataFrame([], "v long, p long"), "v", "p").count() == 0


def test_quicksort_step_with_the_least_pivot(spark):
    r = sorting.quicksort_step(spark.createDataFrame([(3, 0), (2, 1), (1, 2)], "v long, p long"), "v", "p").first()
    assert (r.pivot_value, r.n_left, r.n_right) == (1, 0, 3)


@pytest.mark.parametrize("n, threshold, leaves", [(100, 2, 64), (750, 2, 494), (1000, 128, 8), (2048, 128, 16), (8192, 128, 64), (0, 2, 0), (1, 2, 1), (2, 2, 1)])
def test_leaves_of_a_range_tree(spark, n, threshold, leaves):
    found = tree.range_tree(spark, n, threshold).where("is_leaf")
    assert found.count() == leaves
    if n:
        r = found.agg(F.min("from_idx").alias("a"), F.max("to_idx").alias("b"), F.sum(F.col("to_idx") - F.col("from_idx") + 1).alias("n")).first()
        assert (r.a, r.b, r.n) == (0, n - 1, n)


def test_labels(spark):
    got = [one(spark, labels.fanin(F.lit(x))) for x in ("[0,1][0,3][1,3]", "[0,1]", "[0,1][1,2]")]
    assert got == ["[0,1][3,3]", "[1,1]", "[1,1]"]
    assert one(spark, labels.parent(F.lit("[0,1][0,3]"))) == "[0,1]"
    assert one(spark, labels.fanout(F.lit("[0,1]"), F.lit(2), F.lit(3))) == "[0,1][2,3]"
    assert one(spark, labels.threshold_in(F.lit("sort_seq=64_x.csv"))) == 64
    assert one(spark, labels.threshold_in(F.lit("sort.csv"))) is None


@pytest.mark.parametrize("n, leaves, total", [(0, 1, 0), (1, 1, 1), (4, 5, 3), (8, 34, 21), (12, 233, 144), (16, 1597, 987)])
def test_fibonacci(spark, n, leaves, total):
    r = recursion.leaf_sum(recursion.call_tree(spark, n)).first()
    assert (r.leaves, r.total) == (leaves, total)
    assert int(one(spark, recursion.fibonacci(F.lit(n)))) == total


def test_fibonacci_beyond_long(spark):
    assert int(one(spark, recursion.fibonacci(F.lit(150)))) == 9969216677189303386214405760200


def test_padded_vectors(spark):
    a, b = F.array(*map(F.lit, (1, 2, 3))), F.array(F.lit(10))
    assert one(spark, reduction.add_padded(a, b)) == [11, 2, 3]


def test_fan_in_of_two(spark):
    calls = spark.createDataFrame([("a", 1, 7), ("a", 2, 9), ("b", 1, 5)], "name string, at long, v long")
    (r,) = fanin.last_combines(calls, "name", ["at"], F.col("v")).collect()
    assert (r.name, r.n, r.own, r.others) == ("a", 2, 9, "7")


def log(spark, rows):
    return spark.createDataFrame(rows, "name string, event_id long, at long, kind string").withColumn("ts", F.timestamp_seconds("at"))


def test_memo_outcomes(spark):
    own = log(spark, [("x", 1, 0, ""), ("x", 2, 5, ""), ("x", 3, 20, ""), ("y", 4, 7, "")])
    got = {r.event_id: r.outcome for r in memo.outcomes(own, "name", "ts", "event_id", F.lit(10_000_000)).collect()}
    assert got == {1: "compute", 2: "wait", 3: "hit", 4: "compute"}


def test_barrier_keeps_an_incomplete_generation(spark):
    own = log(spark, [("b", i, i, "") for i in range(5)])
    got = {r.event_id: (r.generation, r.released.second if r.released else None) for r in sync.barrier(own, ["name"], "ts", "event_id", 2).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (1, 3), 4: (2, None)}


def test_semaphore_without_permits(spark):
    own = log(spark, [("s", 0, 0, "P"), ("s", 1, 3, "V"), ("s", 2, 4, "P")])
    got = {r.event_id: r.goes_on.second if r.goes_on else None for r in sync.semaphore_waits(own, ["name"], "ts", "event_id", F.col("kind"), 0).collect()}
    assert got == {0: 3, 2: None}
    with pytest.raises(ValueError):
        sync.permits(own, ["name"], "ts", "event_id", F.lit(1), -1)


@pytest.mark.parametrize("capacity", [1, 2, 5])
def test_bounded_buffer_against_its_recurrence(spark, capacity):
    rnd = random.Random(capacity)
    d, w = sorted(rnd.sample(range(1000), 30)), sorted(rnd.sample(range(1000), 25))
    own = log(spark, [("q", i, x, "D") for i, x in enumerate(d)] + [("q", 100 + i, x, "W") for i, x in enumerate(w)])
    got = {r.k: tuple(x and int(x.timestamp()) for x in (r.deposited, r.withdrawn)) for r in sync.bounded_buffer(own, ["name"], "ts", "event_id", F.col("kind"), capacity).collect()}
    done, want = {}, {}
    for k in range(1, 31):
        freed = done.get(k - capacity, 0) if k > capacity else 0
        into = None if freed is None else max(d[k - 1], freed)
        out = max(w[k - 1], into) if k <= 25 and into is not None else None
        done[k], want[k] = out, (into, out)
    assert got == want


def test_student(spark):
    assert student.quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert student.quantile(0.975, 1) == pytest.approx(12.70620474, abs=1e-6)
    assert student.two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0), abs=1e-12)  # closed forms
    assert student.two_sided(2.0, 2) == pytest.approx(1 - 2 / math.sqrt(6), abs=1e-12)
    assert student.two_sided(0.0, 3) == pytest.approx(1)


def test_welch_of_known_samples(spark):
    a, b = [27.5, 21.0, 19.0, 23.6, 17.0, 17.9], [27.1, 22.0, 20.8, 23.4, 23.4, 23.5, 25.8, 22.0, 24.8, 20.2, 21.9, 22.1, 22.9, 30.5, 24.4]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "s string, v double")
    r = trials.intervals(trials.samples(df, "s", "v", "a", "b")).first()
    n, m = (len(a), len(b)), (sum(a) / len(a), sum(b) / len(b))
    v = [sum((x - y) ** 2 for x in z) / (len(z) - 1) for z, y in ((a, m[0]), (b, m[1]))]
    assert r.t == pytest.approx((m[0] - m[1]) / (v[0] / n[0] + v[1] / n[1]) ** 0.5)
    assert 0 < r.p < 1 and r.low < m[0] - m[1] < r.high


def test_files(spark):
    at = fresh(spark, "trials")
    own = spark.createDataFrame([(0, 1.5, 2.0, 3, 1.0, 1.0, 1.0, 1.0)], files.TRIALS)
    files.write_csv(own, at)
    assert files.read_csv(spark, at, files.TRIALS).collect() == own.collect()
    numbers = files.random_numbers(spark, 1000)
    r = numbers.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    assert -1000 <= r.a < r.b <= 1000


@pytest.mark.parametrize("n", [0, 1, 2, 16, 100])
def test_programs(spark, n):
    rnd = random.Random(n)
    values = [rnd.randint(-1000, 1000) for _ in range(n)]
    df = spark.createDataFrame(list(enumerate(values)), "pos long, v long")
    small = program.Program(sequential=F.sum, combine=F.sum, threshold=3)
    assert [r.result for r in program.execute(small, df, "pos", "v").collect()] == ([sum(values)] if n else [])
    sort = program.Program(sequential=lambda v: F.array_sort(F.collect_list(v)), combine=lambda r: F.array_sort(F.flatten(F.collect_list(r))), threshold=7)
    assert [r.result for r in program.execute(sort, df, "pos", "v").collect()] == ([sorted(values)] if n else [])


@pytest.mark.parametrize("values", [GOLDEN, [], [1], [2, 2, 2, 2, 1, 1], list(range(12)), list(range(12, 0, -1))])
def test_quicksort_program(spark, values):
    roots = spark.createDataFrame([("[0,1]", values)], "problem_id string, problem array<long>")
    assert [r.result for r in program.solve(program.QUICKSORT, roots).collect()] == [sorted(values)]


def test_recursion_with_and_without_shared_results(spark):
    roots = spark.createDataFrame([(f"[{i},1]", i) for i in (0, 1, 2, 7, 8, 8)], "problem_id string, problem long")
    want = [(f"[{i},1]", f) for i, f in ((0, 0), (1, 1), (2, 1), (7, 13), (8, 21), (8, 21))]
    assert sorted(map(tuple, program.solve(program.FIBONACCI_MEMO, roots).collect())) == want
    assert sorted(map(tuple, program.solve(program.FIBONACCI, roots.distinct()).collect())) == sorted(set(want))
    assert program.solve(program.FIBONACCI, roots.limit(0)).count() == program.solve(program.FIBONACCI_MEMO, roots.limit(0)).count() == 0


def test_k_ways_and_checks(spark):
    roots = spark.createDataFrame([("[0,1]", (0, 100)), ("[1,1]", (5, 5))], "problem_id string, problem struct<low: long, high: long>")
    got = {r.problem_id: r.result for r in program.solve(program.k_way_sum(5, 3), roots).collect()}
    assert got == {"[0,1]": 5050, "[1,1]": 5}
    levels = program.expand(program.k_way_sum(5, 3), roots)
    assert levels[1].count() == 5 and {r.problem_id for r in levels[1].collect()} == {f"[0,1][{i},5]" for i in range(5)}
    endless = program.Recursion(lambda p: F.lit(False), lambda p: F.array(p), lambda p: p, lambda p, got: p, max_levels=3)
    with pytest.raises(RecursionError):
        program.expand(endless, roots)
    with pytest.raises(ValueError):
        program.Program(F.sum, F.sum, threshold=0)
    with pytest.raises(ValueError):
        program.execute(program.TREE_REDUCTION, roots, "pos", "v", 5, output_level=-1)


def test_running_extremes_with_nulls(spark):
    rows = [(i % 2, i, None if i % 5 == 0 else (i * 37) % 101) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, at long, v long")
    got = {r["at"]: (r.top, r.low, r.before) for r in scan.prefix(df, ["k"], ["at"], {"top": F.col("v"), "low": F.col("v"), "before": F.col("v")}, kinds={"top": "max", "low": "min", "before": "max"}, before=("before",)).collect()}
    for k, at, _ in rows:
        seen = [v for j, i, v in rows if j == k and i <= at and v is not None]
        past = [v for j, i, v in rows if j == k and i < at and v is not None]
        assert got[at] == (max(seen, default=None), min(seen, default=None), max(past, default=None))


def test_memo_violations(spark):
    log = spark.createDataFrame([(1, "a", 1, True), (2, "a", 2, False), (3, "a", 3, True), (4, "b", 4, False), (5, "b", 5, True), (6, "b", 6, True)], "event long, label string, ts long, delivers boolean")
    got = {r.event: r.violation for r in memo.violations(log, "label", "ts", "event", F.col("delivers")).collect()}
    assert got == {1: "unknown label", 3: "double delivery", 5: None, 6: "double delivery"}


def test_a_call_that_is_both(spark):
    log = spark.createDataFrame([(1, 1, "P"), (2, 2, "VP"), (3, 3, "V")], "event long, ts long, kind string")
    got = {(r.event, r.goes_on) for r in sync.semaphore_waits(sync.with_both(log, F.col("kind")), [], "ts", "event", F.col("kind"), 0, ("step",)).collect()}
    assert got == {(1, 2), (2, 3)}


def test_differences(spark):
    a, b = (spark.createDataFrame(x, "k long, v long") for x in ([(1, 1), (2, 2), (3, None)], [(2, 5), (3, None), (4, 4)]))
    assert tuple(sorting.differences(a, b, ["k"], "v").first()) == (4, 1, 1, 1)


def test_calls_to_objects_against_a_replay(spark):
    rnd = random.Random(5)
    events = [(i, rnd.choice(["a", "b", None]), i // 2, rnd.choice(["create", "try", "wait", "async", "async"]), rnd.choice(["Barrier", "semaphore", "Queue", "FanIn"])) for i in range(200)]
    log_ = spark.createDataFrame(events, "event_id long, name string, ts long, kind string, cls string").withColumn("name", F.coalesce("name", F.lit("c")))
    kind = F.col("kind")
    got = calls.barrier_calls(log_, ["name"], "ts", "event_id", F.when(kind == "create", F.col("cls")), F.when(kind == "try", "try_wait_b").otherwise("wait_b"), kind != "async", 3)
    made, held, want = set(), {}, {}
    for i, name, ts, what, cls in events:
        name = name or "c"
        if what == "create":
            made |= {name} if cls in ("Barrier", "FanIn") else set()
        elif name not in made:
            want[i] = ("unknown object", ts, None)
        else:
            held.setdefault(name, []).append((i, what, ts))
            full, last = len(held[name]) == 3, i
            reply = {"try": "state" if full else "blocking", "wait": "state", "async": "none"}[what]
            want[i] = (reply, ts if reply == "blocking" else None, None)
            if full:
                for j, how, _ in held.pop(name):
                    again = want[j][0] != "state" and j != last
                    want[j] = (want[j][0], ts if want[j][0] == "state" else want[j][1], ts if again else None)
    assert {r.event_id: (r.reply, r.answered, r.restarted) for r in got.collect()} == want
    assert {"unknown object", "blocking", "state", "none"} == {w[0] for w in want.values()}
    assert calls.barrier_calls(log_.limit(0), ["name"], "ts", "event_id", F.lit("Barrier"), F.lit("wait_b"), F.lit(True), 3).count() == 0


def test_a_batch_pushed_again_replaces_itself(spark):
    at = fresh(spark, "pushed")
    for batch, n in ((0, 3), (1, 2), (1, 4)):
        files.push(spark.range(n), at, batch)
    assert sorted((r.batch, r.id) for r in files.pushed(spark, at, "id long").collect()) == [(0, i) for i in range(3)] + [(1, i) for i in range(4)]


def test_conditions_against_a_queue(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["a", "a", "b"]), i // 2, rnd.choice(["wait", "wait", "signal", "signal", "leave", None])) for i in range(300)]
    log_ = spark.createDataFrame(rows, "event_id long, name string, ts long, kind string")
    got = monitor.conditions(log_, ["name"], "ts", "event_id", F.col("kind") == "wait", F.col("kind") == "leave")
    queues, want = {}, {}
    for i, name, ts, kind in rows:
        queue = queues.setdefault(name, [])
        if kind == "wait":
            queue.append(i)
            want[i] = [len(queue), None, None, False]
            continue
        woken = queue.pop(0) if queue else None
        want[i] = [len(queue), woken, None if kind == "leave" else ts, woken is not None and kind != "leave"]
        if woken is not None:
            want[woken][1:3] = [i, ts]
    assert {r.event_id: [r.waiting, r.met, r.resumed, r.urgent] for r in got.collect()} == want
    assert any(w[1] is None and w[2] is not None for w in want.values()) and any(w[3] for w in want.values())
    assert monitor.conditions(log_.limit(0), ["name"], "ts", "event_id", F.lit(True), F.lit(False)).count() == 0


def test_what_the_last_child_is_sent(spark):
    own = spark.createDataFrame([("a", 2, 7), ("a", 1, 9), ("a", 3, None), ("b", 1, 5)], "name string, at long, v long")
    got = {(r.name, r.sender["at"], r.receiver["at"], r.result) for r in fanin.received(own, "name", ["at"], F.col("v")).collect()}
    assert got == {("a", 1, 3, 9), ("a", 2, 3, 7)}


def test_membership_with_repeats_and_nulls(spark):
    a, b = (spark.createDataFrame([(x,) for x in names], "name string") for names in (["x", "x", "y", None], ["x", None, "z"]))
    assert {(r.name, r.removed) for r in memo.membership(a, b, "name").collect()} == {("x", True), ("y", False), (None, False)}


def test_results_are_the_same_by_type_and_id(spark):
    one_, null = labels.result(F.lit(1), F.lit("[0,1]"), F.lit(5)), labels.result(F.lit(-1), F.lit("[0,1]"), F.lit(5))
    assert one(spark, one_["value"]) == 5 and one(spark, null["value"]) is None
    assert one(spark, labels.same_result(one_, labels.result(F.lit(1), F.lit("[0,1]"), F.lit(6))))
    assert not one(spark, labels.same_result(one_, null))
    assert not one(spark, labels.same_result(one_, labels.result(F.lit(1), F.lit("[1,1]"), F.lit(5))))


def test_invoked_plans(spark):
    got = {name: df.first().id for name, df in invoke.invoke({str(i): spark.range(i, i + 1) for i in range(6)}, at_once=3)}
    assert got == {str(i): i for i in range(6)} and not list(invoke.invoke({}))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        list(invoke.invoke({"wrong": spark.range(1).select((F.lit(1) / F.col("id")).alias("x"))}))
    with pytest.raises(ValueError):
        list(invoke.invoke({}, at_once=0))


def test_hooks_before_and_after_a_program(spark):
    df = spark.createDataFrame([(i, i) for i in range(20)], "pos long, v long")
    hooked = program.Program(F.sum, F.sum, threshold=3, preprocess=lambda rows: rows.withColumn("v", F.col("v") * 2), output=lambda out: out.withColumn("result", F.col("result") + 1))
    assert [r.result for r in program.execute(hooked, df, "pos", "v").collect()] == [2 * 190 + 1]


def test_flush_removes_what_was_written(spark):
    kept = written(spark.range(5), "kept")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and flush(spark) and not os.path.exists(path)
    assert not flush(spark) and written(spark.range(3), "again").count() == 3
