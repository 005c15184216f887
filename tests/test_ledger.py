"""Balance gate against a Python fold; seed ledger; carry across Arrow batches."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txlens.operators.ledger import balance_gate, closing_balance, insert_skip_duplicates, process_transactions, upsert

TX = "transaction_id string, user_id string, amount decimal(14,2), event_ts timestamp, status string"
PROF = "user_id string, account_balance decimal(14,2)"
T0 = dt.datetime(2024, 1, 1)


def python_fold(txns, profiles):
    bal = dict(profiles)
    out = {}
    for tid, u, a, ts, st in sorted(txns, key=lambda r: (r[1], r[3] is not None, r[3] or T0, r[0])):
        if st != "approved":
            out[tid] = ("accepted", 0, bal.get(u))
        elif u not in bal:
            out[tid] = ("rejected", 0, None)
        elif bal[u] < a:
            out[tid] = ("rejected", 0, bal[u])
        else:
            bal[u] -= a
            out[tid] = ("accepted", 1, bal[u])
    return out


def run(spark, txns, profiles, **options):
    g = balance_gate(spark.createDataFrame(txns, TX), spark.createDataFrame(list(profiles.items()), PROF), **options)
    return {r.transaction_id: (r.decision, r.debited, r.balance_after) for r in g.collect()}


def test_seed_ledger(spark):
    # Two users, four transactions, two of them blocked (the seed data of the original).
    txns = [("s1", "alice", Decimal("2500.00"), T0, "approved"),
            ("s2", "alice", Decimal("480000.00"), T0 + dt.timedelta(hours=1), "blocked"),
            ("s3", "bob", Decimal("18000.00"), T0, "approved"),
            ("s4", "bob", Decimal("320000.00"), T0 + dt.timedelta(hours=2), "blocked")]
    prof = {"alice": Decimal("250000.00"), "bob": Decimal("100000.00")}
    got = run(spark, txns, prof)
    assert got == python_fold(txns, prof)
    assert got["s1"] == ("accepted", 1, Decimal("247500.00"))
    assert got["s2"][0] == "accepted" and got["s2"][1] == 0  # blocked: recorded, not debited


def test_exact_balance_insufficient_then_smaller(spark):
    txns = [("a", "u", Decimal("60.00"), T0, "approved"),
            ("b", "u", Decimal("50.00"), T0 + dt.timedelta(seconds=1), "approved"),   # 40 left: rejected
            ("c", "u", Decimal("40.00"), T0 + dt.timedelta(seconds=2), "approved"),   # exactly the balance
            ("d", "u", Decimal("0.01"), T0 + dt.timedelta(seconds=3), "approved"),
            ("e", "nobody", Decimal("1.00"), T0, "approved"),
            ("f", "nobody", Decimal("1.00"), T0, "blocked")]
    got = run(spark, txns, {"u": Decimal("100.00")})
    assert [got[k][0] for k in "abcdef"] == ["accepted", "rejected", "accepted", "rejected", "rejected", "accepted"]
    assert got["c"][2] == Decimal("0.00")


def test_random_fold_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rnd = random.Random(11)
        users = ["u0", "u1", "u2", "u3"]
        prof = {u: Decimal(rnd.randint(100, 5000)) for u in users[:3]}
        txns = []
        for i in range(400):
            ts = None if rnd.random() < 0.02 else T0 + dt.timedelta(minutes=rnd.randint(0, 5000))
            txns.append((f"t{i:03d}", rnd.choice(users), Decimal(rnd.randint(1, 40000)) / 100, ts,
                         "approved" if rnd.random() < 0.8 else "blocked"))
        got = run(spark, txns, prof)
        assert got == python_fold(txns, prof)
        assert all(v[2] is None or v[2] >= 0 for v in got.values())  # never below zero
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_closing_balance(spark):
    txns = [("a", "u", Decimal("30.00"), T0, "approved"), ("b", "u", Decimal("80.00"), T0, "approved")]
    prof = spark.createDataFrame([("u", Decimal("100.00")), ("v", Decimal("5.00"))], PROF)
    g = balance_gate(spark.createDataFrame(txns, TX), prof)
    got = {r.user_id: r.closing_balance for r in closing_balance(prof, g).collect()}
    assert got == {"u": Decimal("70.00"), "v": Decimal("5.00")}


def test_process_order(spark):
    cols = ("transaction_id string, user_id string, amount string, event_time string, hour string, "
            "device_risk string, location_risk string, txn_velocity string, edge_fraud_probability string, status string")
    rows = [("t1", "bad", "10", "2024-01-01T00:00:00Z", "1", "0.1", "0.1", "1", "0.1", "approved"),
            ("t2", "u", "-5", "2024-01-01T00:00:00Z", "1", "0.1", "0.1", "1", "0.1", "approved"),
            ("t3", "u", "50", "2024-01-01T00:00:01Z", "1", "0.1", "0.1", "1", "0.1", "approved"),
            ("t4", "u", "60", "2024-01-01T00:00:02Z", "1", "0.1", "0.1", "1", "0.1", "approved")]
    out = process_transactions(spark.createDataFrame(rows, cols), spark.createDataFrame([("bad",)], "user_id string"),
                               spark.createDataFrame([("u", Decimal("100.00"))], PROF))
    got = {r.transaction_id: (r.code, r.message) for r in out.collect()}
    assert got["t1"][0] == 403 and got["t2"][0] == 400 and got["t3"][0] == 200
    assert got["t4"] == (400, "Insufficient account balance.")


def test_insert_skip_and_upsert(spark):
    existing = spark.createDataFrame([(1, "a")], "k int, v string")
    batch = spark.createDataFrame([(1, "x", 0), (2, "first", 0), (2, "second", 1)], "k int, v string, seq int")
    assert [(r.k, r.v) for r in insert_skip_duplicates(existing, batch, "k", "seq").collect()] == [(2, "first")]
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, w int")
    upd = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    got = sorted(tuple(r) for r in upsert(old, upd, "k").collect())
    assert got == [(1, "a", 10), (2, "b", 20), (3, "c", None)]


FEED = ("transaction_id string, user_id string, amount string, event_time string, hour string, "
        "device_risk string, location_risk string, txn_velocity string, edge_fraud_probability string, status string")


def feed_row(tid, user, amount, second, status="approved"):
    return (tid, user, amount, f"2024-01-01T00:{second // 60:02d}:{second % 60:02d}Z", "1", "0.1", "0.1", "1", "0.1", status)


def test_one_hostile_row_fails_alone(spark):
    rows = [feed_row("big", "u", "1e13", 1), feed_row("ok", "u", "50", 2), feed_row(None, "u", "20", 3),
            feed_row(None, "u", "20", 4), feed_row("nobody", None, "5", 5), feed_row("half", "u", "10.004", 6)]
    out = process_transactions(spark.createDataFrame(rows, FEED).repartition(3), spark.createDataFrame([], "user_id string"),
                               spark.createDataFrame([("u", Decimal("80.00"))], PROF)).collect()
    assert len(out) == len(rows)
    assert sorted((r.transaction_id or "", r.code, r.message) for r in out) == [
        ("", 200, "Transaction forwarded to cloud processor"), ("", 400, "Insufficient account balance."),
        ("big", 500, "Transaction processing failed."), ("half", 400, "Insufficient account balance."),
        ("nobody", 400, "Financial profile not found."), ("ok", 200, "Transaction forwarded to cloud processor")]


def test_balances_stay_exact_beside_huge_rejected_amounts(spark):
    huge = Decimal("999999999999.99")
    txns = [(f"h{i:03d}", "u", huge, T0 + dt.timedelta(seconds=i), "approved") for i in range(300)]
    txns += [(f"s{i}", "u", Decimal("0.33"), T0 + dt.timedelta(seconds=400 + i), "approved") for i in range(4)]
    prof = {"u": Decimal("1.00")}
    got = run(spark, txns, prof)
    assert got == python_fold(txns, prof)
    assert got["s2"][2] == Decimal("0.01") and got["s3"][0] == "rejected"


@pytest.mark.parametrize("seed", range(4))
def test_hot_user_mixed_fast_and_ordered_paths(spark, seed):
    """A third of all rows on one user; ties, NULL times, NULL and negative amounts."""
    rnd = random.Random(seed)
    users = ["hot"] * 5 + [f"u{i}" for i in range(10)]
    prof = {u: Decimal(rnd.randint(0, 80_000)) / 100 * (50 if u == "hot" else 1) for u in set(users) - {"u9"}}
    txns = []
    for i in range(900):
        ts = None if rnd.random() < 0.03 else T0 + dt.timedelta(minutes=20 * rnd.randint(0, 400))
        low = -2000 if seed == 3 else 1
        txns.append((f"t{i:03d}", rnd.choice(users), Decimal(rnd.randint(low, 9000)) / 100, ts,
                     "approved" if rnd.random() < 0.85 else "blocked"))
    assert run(spark, txns, prof) == python_fold(txns, prof)
    assert run(spark, txns, prof, hot_rows=60) == python_fold(txns, prof)       # balance levels (seed 3: fold)


@pytest.mark.parametrize("amounts", ["geometric", "equal", "cents", "first hour"])
def test_balance_levels(spark, monkeypatch, amounts):
    """Whole hot users by levels: no row reaches the fold, and few rounds do."""
    from txlens.operators import ledger
    rnd = random.Random(len(amounts))
    draw = {"geometric": lambda i: Decimal(rnd.randint(1, 2 ** rnd.randint(1, 20))) / 100, "equal": lambda i: Decimal("3.33"),
            "cents": lambda i: Decimal(rnd.randint(0, 2)) / 100, "first hour": lambda i: Decimal(rnd.randint(500, 90_000)) / 100}[amounts]
    txns = [(f"t{i:03d}", rnd.choice(["a", "b"]), draw(i), T0 + dt.timedelta(minutes=(i if i > 40 else 0) * 7),
             "approved" if rnd.random() < 0.9 else "blocked") for i in range(500)]
    prof = {"a": Decimal("700.00") if amounts != "cents" else Decimal("0.37"), "b": Decimal("0.01")}
    rounds, levels = [], ledger.balance_levels

    def counted(rows, state, keep):
        def kept(df):
            rounds.append(1)
            return keep(df)
        return levels(rows, state, kept)

    monkeypatch.setattr(ledger, "balance_levels", counted)
    monkeypatch.setattr(ledger, "_fold_batches", lambda batches: (b for b in batches if 1 / 0))
    decided = ledger._gate_users

    def no_users(rows, ts_col):      # the other branches hold no rows here
        return decided(rows.filter("false"), ts_col)

    monkeypatch.setattr(ledger, "_gate_users", no_users)
    assert run(spark, txns, prof, hot_rows=10) == python_fold(txns, prof)
    assert 1 <= len(rounds) <= 18


def test_unrounded_amounts_by_levels(spark):
    """Rows that need a cent and debit none do not cost a round each."""
    kind = TX.replace("decimal(14,2)", "double")
    txns = [(f"t{i:02d}", "u", 0.004, T0 + dt.timedelta(seconds=i), "approved") for i in range(60)]
    txns += [("z1", "u", 0.01, T0 + dt.timedelta(seconds=99), "approved"), ("z2", "u", 0.004, T0 + dt.timedelta(hours=2), "approved")]
    prof = spark.createDataFrame([("u", Decimal("0.01"))], PROF)
    for hot in (10 ** 6, 5):
        got = {r.transaction_id: r.decision for r in balance_gate(spark.createDataFrame(txns, kind), prof, hot_rows=hot).collect()}
        assert got.pop("z2") == "rejected" and set(got.values()) == {"accepted"}


def test_only_the_undecided_stretch_reaches_python(spark, tmp_dir):
    """Rows before a user's first cell that could overdraw never enter the fold."""
    from txlens.operators import ledger
    txns = [(f"r{i:04d}", "rich", Decimal("1.00"), T0 + dt.timedelta(hours=i), "approved") for i in range(500)]
    txns += [(f"p{i:04d}", "poor", Decimal("1.00"), T0 + dt.timedelta(hours=i), "approved") for i in range(100)]
    prof = {"rich": Decimal("500.00"), "poor": Decimal("90.00")}
    seen = spark.sparkContext.accumulator(0)
    fold = ledger._fold_batches

    def counted(batches):
        def count(inner):
            for b in inner:
                seen.add(len(b))
                yield b
        return fold(count(batches))

    ledger._fold_batches = counted
    try:
        got = run(spark, txns, prof)
    finally:
        ledger._fold_batches = fold
    assert got == python_fold(txns, prof)
    assert seen.value == 10          # poor's last ten hours


def test_upsert_defaults_and_repeated_keys(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, None, 20)], "k int, v string, w int")
    upd = spark.createDataFrame([(2, "b"), (3, None)], "k int, v string")
    got = sorted(tuple(r) for r in upsert(old, upd, "k", {"v": "new", "w": 0}).collect())
    assert got == [(1, "a", 10), (2, "b", 20), (3, "new", 0)]
    with pytest.raises(Exception, match="k repeated in the batch: 2"):
        upsert(old, upd.unionByName(upd), "k").collect()
