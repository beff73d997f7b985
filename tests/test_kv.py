"""Literal cases of the key-value operators."""

import pytest
from pyspark.sql import functions as F

from lodespar.functions import keys
from lodespar.operators import dup, kv, secondary, telemetry, txn

ORDER = [6, 3, 8, 1, 5, 7, 2, 4, 9, 0]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(k, bytes([3]) * 1024) for k in ORDER], "k long, v binary")


def got(df, *names):
    return [tuple(r[x] for x in names) if len(names) > 1 else r[names[0]] for r in df.collect()]


@pytest.mark.parametrize("low, high, n", [(2, 7, 5), (0, 10, 10), (None, None, 10), (5, 5, 0)])
def test_ordered_scan(ten, low, high, n):
    found = got(kv.scan(ten, ["k"], low=low, high=high), "k")
    assert len(found) == n and found == sorted(found)


def test_scan_of_nothing(spark):
    assert kv.scan(spark.createDataFrame([], "k long, v binary"), ["k"]).count() == 0


def test_ranges_add_up(ten):
    assert got(kv.scan(ten, ["k"], low=1, high=4), "k") + got(kv.scan(ten, ["k"], low=4, high=9), "k") == got(kv.scan(ten, ["k"], low=1, high=9), "k")


def test_filter_scan(spark):
    rows = spark.createDataFrame([(k, bytes([4]) * 1024 if k % 2 == 0 else bytes([3]) * 512) for k in ORDER], "k long, v binary")
    assert kv.scan(rows, ["k"], F.octet_length("v") == 512).count() == 5
    assert got(kv.scan(rows, ["k"], F.col("k") % 2 == 0), "k") == [0, 2, 4, 6, 8]


def test_get(ten, spark):
    asked = spark.createDataFrame([(3,), (42,)], "k long")
    assert sorted(got(kv.get(ten, asked, "k"), "k", "status")) == [(3, "ok"), (42, "key_not_found")]


def ops(spark, *rows, value="string"):
    return spark.createDataFrame(list(rows), f"seq long, k long, v {value}")


def test_insert_then_delete_is_nothing(ten, spark):
    batch = spark.createDataFrame([(1, 50, b"x"), (2, 50, b"y"), (3, 6, b"z")], "seq long, k long, v binary")
    after, status = kv.insert(ten, batch, "k", "seq")
    assert sorted(got(status, "seq", "status")) == [(1, "ok"), (2, "key_exists"), (3, "key_exists")]
    assert after.count() == 11 and got(after.where("k = 50"), "v") == [b"x"]
    back = kv.delete(after, spark.createDataFrame([(50,)], "k long"), "k")
    assert sorted(got(back, "k")) == sorted(ORDER)


def test_update_and_upsert(spark):
    base = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    batch = ops(spark, (1, 1, "b"), (2, 1, None), (3, 2, "c"), (4, 3, "d"))
    assert sorted(got(kv.update(base, batch, "k", "seq", "v"), "k", "v")) == [(1, None), (2, "c")]
    once = kv.upsert(base, batch, "k", "seq", "v")
    assert sorted(got(once, "k", "v")) == [(1, None), (2, "c"), (3, "d")]
    assert sorted(got(kv.upsert(once, batch, "k", "seq", "v"), "k", "v")) == sorted(got(once, "k", "v"))
    assert sorted(got(kv.upsert(base, batch, "k", "seq", "v", old="was"), "k", "was"), key=str) == [(1, "a"), (2, None), (3, None)]
    assert sorted(got(kv.update_status(base, batch, "k", "seq"), "seq", "status")) == [(1, "ok"), (2, "ok"), (3, "ok"), (4, "key_not_found")]


def test_merge_adds_up(spark):
    batch = ops(spark, *((n, 0, k) for n, k in enumerate(ORDER)), value="long")
    none = spark.createDataFrame([], "k long, v long")
    assert got(kv.upsert_merge(none, batch, "k", "v", F.sum, lambda a, b: a + b), "v") == [45]
    assert got(kv.upsert_fold(none, batch, "k", "seq", "v", lambda a, b: a + b), "v") == [45]
    assert got(kv.fold_in_order(batch.withColumn("start", F.lit(0)), "k", ["seq"], "start", "v", lambda a, b: a * 10 + b), "state") == [6381572490]


@pytest.mark.parametrize("step", [1, 3, 1000])
def test_fold_keeps_the_order(spark, step):
    base = spark.createDataFrame([(0, "<"), (2, "x"), (3, None)], "k long, v string")
    batch = ops(spark, *((n, n % 2, str(n)) for n in range(20)), (5, 3, "y"))
    want = {0: "<" + "".join(map(str, range(0, 20, 2))), 1: "".join(map(str, range(1, 20, 2))), 2: "x", 3: None}
    assert dict(got(kv.upsert_fold(base, batch, "k", "seq", "v", F.concat, step=step), "k", "v")) == want


def test_fold_in_order_streams_every_key(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(5) if rng.random() < 0.5 else 7, n, 20, rng.randint(1, 50)) for n in range(30_000)]
    step = lambda s, q: s - q if s > q + 10 else s - q + 91
    want = {}
    for k, _, s, q in rows:
        want[k] = step(want.get(k, s), q)
    shuffled = spark.createDataFrame(rng.sample(rows, len(rows)), "k long, n long, s int, q long")
    assert dict(got(kv.fold_in_order(shuffled, "k", ["n"], "s", "q", step), "k", "state")) == want
    assert kv.fold_in_order(shuffled.limit(0), "k", ["n"], "s", "q", step).count() == 0


def test_cursor_goes_on(ten):
    seen, last = [], None
    while page := got(kv.page(ten, ["k"], 3, last), "k"):
        seen, last = seen + page, (page[-1],)
    assert seen == sorted(ORDER)


def test_bounds(spark):
    table = spark.createDataFrame([(x,) for x in (2, 3, 5, 8, 13, 5000, 2_000_000)], "k long")
    probes = spark.createDataFrame([(x,) for x in (2, 5, 6, 13, 14, 6000, 3_000_000)], "x long")
    low = dict(got(kv.bound(table, probes, "k", "x", strict=False), "x", "bound"))
    high = dict(got(kv.bound(table, probes, "k", "x", strict=True), "x", "bound"))
    assert low == {2: 2, 5: 5, 6: 8, 13: 13, 14: 5000, 6000: 2_000_000, 3_000_000: None}
    assert high == {2: 3, 5: 8, 6: 8, 13: 5000, 14: 5000, 6000: 2_000_000, 3_000_000: None}


def test_bounds_beyond_the_widest_range(spark):
    far = 5 * 10**12
    table = spark.createDataFrame([(x,) for x in (-4 * 10**12, 7, far, far + 1, 9 * 10**15)], "k long")
    probes = spark.createDataFrame([(x,) for x in (-(10**14), 100, far, 10**14, 10**16, 3 * 10**12)], "x long")
    assert dict(got(kv.bound(table, probes, "k", "x", strict=False), "x", "bound")) == {-(10**14): -4 * 10**12, 100: far, far: far, 10**14: 9 * 10**15, 10**16: None, 3 * 10**12: far}
    assert dict(got(kv.bound(table, probes, "k", "x", strict=True), "x", "bound"))[far] == far + 1
    assert dict(got(kv.bound(table.limit(0), probes, "k", "x", strict=True), "x", "bound"))[100] is None


def test_random_bounds_like_a_sorted_list(spark):
    import bisect
    import random

    rng = random.Random(5)
    keys_ = sorted({rng.randrange(-(10 ** rng.randint(1, 17)), 10 ** rng.randint(1, 17)) for _ in range(300)})
    asked = {rng.choice(keys_) + rng.choice((-1, 0, 1)) for _ in range(100)} | {rng.randrange(-(10**18), 10**18) for _ in range(50)}
    table, probes = spark.createDataFrame([(x,) for x in keys_], "k long"), spark.createDataFrame([(x,) for x in asked], "x long")
    for strict, find in ((False, bisect.bisect_left), (True, bisect.bisect_right)):
        want = {x: keys_[at] if (at := find(keys_, x)) < len(keys_) else None for x in asked}
        assert dict(got(kv.bound(table, probes, "k", "x", strict=strict), "x", "bound")) == want


def test_disorder_and_repeats_are_found(spark):
    stream = spark.createDataFrame([("a", 0, 3), ("a", 1, 1), ("a", 2, 2), ("b", 0, 1), ("b", 1, 1), ("c", 0, 5), ("c", 1, 6)], "g string, n long, k long")
    found = kv.order_faults(stream, "k", by="g", order=["n"])
    assert sorted(got(found, "g", "n_rows", "n_below", "n_repeats")) == [("a", 3, 1, 0), ("b", 2, 0, 1), ("c", 2, 0, 0)]


def test_numbers_by_ranges_are_the_plain_ones(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 101).alias("x"), "id")
    plain = dup.append_suffix(rows, "g", order=["x", "id"])
    ranged = dup.append_suffix(rows, "g", order=["x", "id"], coarse=F.floor(F.col("x") / 10))
    assert plain.columns == ranged.columns and sorted(got(plain, "id", "suffix")) == sorted(got(ranged, "id", "suffix"))


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_quantiles_by_ranges_are_exact(spark, width):
    import math
    import random

    rng = random.Random(2)
    rows = [(rng.choice("ab"), round(rng.expovariate(0.05), rng.choice((0, 2)))) for _ in range(700)] + [("c", 3.5), ("d", None)]
    points = {"p1": 0.01, "p50": 0.5, "p90": 0.9, "p999": 0.999}
    for r in telemetry.latency_quantiles(spark.createDataFrame(rows, "g string, x double"), "x", "g", points, width).collect():
        own = sorted(x for g, x in rows if g == r.g and x is not None)
        assert [r[k] for k in points] == [own[max(1, math.ceil(round(p * len(own), 9))) - 1] if own else None for p in points.values()]
        if len(own) > 1:
            mean = sum(own) / len(own)
            assert abs(r.mean - mean) < 1e-3 and abs(r.deviation - math.sqrt(sum((x - mean) ** 2 for x in own) / len(own))) < 1e-3


def test_secondary_is_checked_and_repaired(spark):
    primary = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (5, None)], "id long, k string")
    second = spark.createDataFrame([("a", 1), ("x", 2), ("d", 4), (None, 5)], "k string, id long")
    checked = secondary.verify(second, primary, "k", "id")
    assert dict(got(checked, "id", "state")) == {1: "ok", 2: "stale", 3: "missing", 4: "dangling", 5: "ok"}
    assert sorted(got(secondary.repair(checked, "k", "id"), "id", "k", "repaired")) == [(1, "a", False), (2, "b", True), (3, "c", True), (5, None, False)]
    some = secondary.repair(checked, "k", "id", only=spark.createDataFrame([(2,), (9,)], "id long"))
    assert sorted(got(some, "id", "k", "repaired")) == [(1, "a", False), (2, "b", True), (4, "d", False), (5, None, False)]


def test_lookup_by_name(spark):
    people = spark.createDataFrame([(1, "ann", 10), (1, "bob", 11), (1, "cid", 12), (1, "dan", 13), (2, "eve", 14)], "d long, first string, id long").withColumn("last", F.lit("ese"))
    asked = spark.createDataFrame([(1, "ese", "q1"), (2, "ese", "q2"), (3, "ese", "q3"), (1, "pri", "q4")], "d long, last string, q string")
    assert sorted(got(secondary.lookup_middle(asked, people, ["d", "last"], ["first"]), "q", "id")) == [("q1", 11), ("q2", 14), ("q3", None), ("q4", None)]


def test_rewrite_same_length(spark):
    table = spark.createDataFrame([(1, "abc"), (2, "abc")], "k long, v string")
    new = spark.createDataFrame([(1, "xyz"), (2, "toolong")], "k long, v string")
    assert sorted(got(kv.rewrite_same_length(table, new, "k", "v"), "k", "v")) == [(1, "xyz"), (2, "abc")]


def test_duplicates(spark):
    rows = spark.createDataFrame([(0, v) for v in range(10)], "k long, v long")
    assert sorted(got(dup.append_suffix(rows, "k", order=["v"]), "suffix", "v")) == [(v, v) for v in range(10)]
    few = spark.createDataFrame([(1,), (2,), (2,), (3,)], "k long")
    assert dup.scan_range(few, "k", 1, 2).count() == 3 and dup.cursor_range(few, "k", 1, 2).count() == 1


def test_binary_order(spark):
    rows = spark.createDataFrame([(bytes.fromhex(x),) for x in ("80", "", "7f", "0000", "00")], "b binary")
    assert [bytes(x).hex() for x in got(rows.orderBy("b"), "b")] == ["", "00", "0000", "7f", "80"]


@pytest.mark.parametrize("quantity, lines, after", [(5, [50, 50], 87), (20, [10], 101), (21, [10], 11), (15, [10, 10], 86)])
def test_stock_rule(spark, quantity, lines, after):
    row = spark.createDataFrame([(quantity, lines)], "q long, l array<long>")
    assert row.select(F.aggregate("l", F.col("q"), keys.stock_after).alias("x")).first().x == after


def test_names_and_draws(spark):
    row = spark.range(1).select(keys.last_name(F.lit(371)).alias("n"), keys.nurand(255, 0, 999, F.lit(3), F.lit(4)).alias("r"), keys.packed((F.lit(2), 16), (F.lit(5), 32)).alias("p")).first()
    assert row.n == "PRICALLYOUGHT" and row.r == 157 and row.p == (2 << 32) + 5


def test_fold_of_operations(spark):
    base = spark.createDataFrame([(2, "a"), (5, "e")], "k long, v string")
    log = spark.createDataFrame(
        [(1, "insert", 1, "x"), (2, "delete", 1, None), (3, "insert", 1, "y"), (4, "update", 2, "b"), (5, "delete", 2, None), (6, "insert", 3, "p"), (7, "insert", 3, "q"), (8, "update", 4, "z"), (9, "insert", 5, "w"), (10, "delete", 4, None)],
        "seq long, op string, k long, v string",
    )
    after, status = txn.fold(base, log, "k")
    assert sorted(got(after, "k", "v")) == [(1, "y"), (3, "p"), (5, "e")]
    assert [s for _, s in sorted(got(status, "seq", "status"))] == ["ok"] * 6 + ["key_exists", "key_not_found", "key_exists", "key_not_found"]


def test_abort_leaves_nothing(spark):
    base = spark.createDataFrame([(1, "a")], "k long, v string")
    log = spark.createDataFrame([(1, 7, "insert", 2, "x"), (2, 8, "update", 1, "b")], "seq long, txn long, op string, k long, v string")
    after = txn.transact(base, log, "k", aborted=spark.createDataFrame([(7,)], "txn long"))
    assert got(after, "k", "v") == [(1, "b")]


def test_lock_conflicts(spark):
    locks = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False), ("b", 1, False), ("b", 2, False), ("c", 1, True), ("c", 1, False)], "k string, txn long, exclusive boolean")
    assert got(txn.lock_conflicts(locks, "k"), "k", "n_txns", "n_exclusive", "n_conflicts") == [("a", 3, 1, 2)]


def test_middle_row_and_diff(spark):
    rows = spark.createDataFrame([("g", x) for x in "dbac"] + [("h", "z")], "g string, n string")
    assert sorted(got(secondary.middle_row(rows, ["g"], ["n"]), "g", "n")) == [("g", "b"), ("h", "z")]
    a, b = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k long, p long"), spark.createDataFrame([(2, 2), (3, 4), (5, 5)], "k long, p long")
    assert dict(got(secondary.snapshot_diff(a, b, "k", "p"), "change", "n_rows")) == {"removed": 1, "kept": 1, "changed": 1, "added": 1}


def test_histogram_overflow(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 249.0, 250.0, 9000.0)], "x double")
    assert dict(got(telemetry.histogram(rows, F.col("x"), 250, 6000), "bucket", "n")) == {0: 2, 250: 1, 6000: 1}


def test_random_logs_like_a_dictionary(spark):
    """Model-based: many random logs at once, each on keys of its own."""
    import random

    rng = random.Random(11)
    base, log, state, status = [], [], {}, {}
    for case in range(150):
        for k in range(4):
            if rng.random() < 0.5:
                base.append((case * 10 + k, "base"))
                state[case * 10 + k] = "base"
    for seq in range(2500):
        op, k = rng.choice(["insert", "update", "upsert", "delete"]), rng.randrange(150) * 10 + rng.randrange(4)
        v = None if op == "delete" else f"v{seq}"
        log.append((seq, op, k, v))
        there = k in state
        status[seq] = "key_exists" if op == "insert" and there else "key_not_found" if op in ("update", "delete") and not there else "ok"
        if status[seq] == "ok":
            state.pop(k, None) if op == "delete" else state.__setitem__(k, v)
    for step in (7, 1_000_000):
        after, done = txn.fold(spark.createDataFrame(base, "k long, v string"), spark.createDataFrame(log, "seq long, op string, k long, v string"), "k", step=step)
        assert dict(got(after, "k", "v")) == state and dict(got(done, "seq", "status")) == status


def test_random_batches_like_a_dictionary(spark):
    import random

    rng = random.Random(12)
    base = {k: rng.randrange(100) for k in rng.sample(range(400), 200)}
    batch = [(seq, rng.randrange(400), rng.randrange(100)) for seq in range(600)]
    table, ops_df = spark.createDataFrame(list(base.items()), "k long, v long"), spark.createDataFrame(batch, "seq long, k long, v long")
    insert, update, upsert, merge = dict(base), dict(base), dict(base), dict(base)
    for _, k, v in batch:
        insert.setdefault(k, v)
        if k in update:
            update[k] = v
        upsert[k] = v
        merge[k] = max(merge.get(k, v), v)
    assert dict(got(kv.insert(table, ops_df, "k", "seq")[0], "k", "v")) == insert
    assert dict(got(kv.update(table, ops_df, "k", "seq", "v"), "k", "v")) == update
    assert dict(got(kv.upsert(table, ops_df, "k", "seq", "v"), "k", "v")) == upsert
    assert dict(got(kv.upsert_merge(table, ops_df, "k", "v", F.max, F.greatest), "k", "v")) == merge
    assert dict(got(kv.upsert_fold(table, ops_df, "k", "seq", "v", F.greatest), "k", "v")) == merge
