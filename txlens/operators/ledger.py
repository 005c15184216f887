"""Account ledger (LED1-LED3, SNK4, SNK5).

LED1 is an ordered fold per user: an approved transaction is accepted and
debited only if the balance left by the earlier accepted ones covers it; a
rejection does not debit, so the result is not a running sum.

Plan: only what order really decides goes through Python, and no task gets more
than ``HOT_ROWS`` rows of a user.

* A user's rows are sorted once.  Up to the first row that would overdraw if all
  before it were accepted, they are decided by a running sum in the JVM.  A user
  whose total fits never leaves that path; rows without a profile need no order
  and are spread.
* From that row on ``mapInPandas`` folds the user's rows, in the partitions the
  running sum left sorted, carrying only (user, balance).
* Users with more than ``HOT_ROWS`` rows (counted first) are cut into hour cells.
  What each cell could debit is summed before the shuffle; running totals over
  the cells give the balance before each, and up to the first cell that could
  overdraw the rows are decided cell by cell in parallel.
* The rest of such a user is decided by *balance levels* (:func:`balance_levels`):
  at balance B rows needing more than B are refused for good, rows needing at most
  B / 2 fit until the balance is below B / 2, and the first larger row that fits
  takes the balance there at once.  Where that happens follows from cell totals
  and running sums inside cells, so a round is parallel over the cells and halves
  the balance: O(log balance) rounds, each over the rows still open.
* Hot users with a negative amount (nothing is refused for good) are folded whole.

Money is exact integer cents.  A row is accepted if its unrounded amount is
within the balance (compared as the next whole cent), and debits the amount
rounded to cents, as it is stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens import constants as K

MONEY = T.DecimalType(14, 2)
ACCEPTED, REJECTED = "accepted", "rejected"
CELL_SECONDS = 3600
#: Rows of one user that a single task may fold.
HOT_ROWS = 1_000_000
#: Above any storable amount in cents; such a debit never fits.
NEVER = 10 ** 15


def _cents(c) -> F.Column:
    """Whole cents of an amount rounded as it is stored; NULL if it cannot be."""
    col = F.col(c) if isinstance(c, str) else c
    return (col.try_cast(MONEY) * 100).cast("long")


def _needed_cents(c) -> F.Column:
    """The smallest whole-cent balance that covers the unrounded amount."""
    exact = F.col(c).try_cast("decimal(30,12)")
    return F.when(_cents(c).isNotNull(), F.greatest(F.ceil(exact * 100).try_cast("long"), _cents(c)))


def _fold_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Ordered balance fold over rows sorted by (user, time, id).

    Reads ``user_id``, ``__amt`` and ``__need`` (cents), ``__open`` (cents
    before the user's first row here, or NULL) and ``__approved`` (0/1);
    appends ``__ok`` (0/1), ``__why`` (0 ok, 1 no profile, 2 insufficient) and
    ``__balc`` (cents after the row, NULL without a profile).  Only
    (user, balance) is carried between batches.
    """
    cur_user, bal = object(), None
    for pdf in batches:
        n = len(pdf)
        if n == 0:
            continue
        users = pdf["user_id"].to_numpy(dtype=object)
        amt = pdf["__amt"].fillna(NEVER).to_numpy(dtype=np.int64)
        need = pdf["__need"].fillna(NEVER).to_numpy(dtype=np.int64)
        has_profile = pdf["__open"].notna().to_numpy()
        opening = pdf["__open"].fillna(0).to_numpy(dtype=np.int64)
        approved = pdf["__approved"].to_numpy(dtype=np.int64)
        ok = np.ones(n, dtype=np.int64)
        why = np.zeros(n, dtype=np.int64)
        out_bal = np.zeros(n, dtype=np.int64)
        starts = np.flatnonzero(np.r_[True, users[1:] != users[:-1]])
        ends = np.r_[starts[1:], n]
        for s, e in zip(starts, ends):
            if users[s] != cur_user:  # a new user; otherwise the run continues the last batch
                cur_user, bal = users[s], int(opening[s]) if has_profile[s] else None
            if bal is None:  # no profile: approved rows rejected, blocked ones recorded
                mask = approved[s:e] == 1
                ok[s:e][mask] = 0
                why[s:e][mask] = 1
                continue
            bal = _fold_run(amt[s:e], need[s:e], approved[s:e], bal, ok[s:e], why[s:e], out_bal[s:e])
        yield pdf.assign(__ok=ok, __why=why,
                         __balc=pd.Series(out_bal, index=pdf.index).astype("Int64").where(has_profile))


def _fold_run(amt, need, approved, bal, ok, why, out_bal):
    """Fold one user's run in place and return the closing balance.

    Linear in the run length, however often rows are rejected:

    * one prefix sum of the debits (``cs[j]`` = debit of rows before ``j``);
      accepted stretches never include a rejected row, so the balance before
      row ``j`` of a stretch from ``i`` is ``bal - (cs[j] - cs[i])``, and the
      end of the longest stretch is one binary search;
    * the row after a stretch does not fit and is rejected without a debit;
      the balance is unchanged, so every following row up to the first one
      within the balance is rejected too -- found with one vectorised search
      over a block of rows, not row by row.

    All sums are int64.  Amounts above the balance cannot be accepted any more,
    so they are clipped to just above it; a batch of 10,000 rows stays far from
    overflow.
    """
    n = len(amt)
    amt, need = np.where(approved == 1, amt, 0), np.where(approved == 1, need, 0)
    if (amt < 0).any():  # negative amounts break the prefix search: plain loop
        for i in range(n):
            if int(need[i]) <= bal:
                bal -= int(amt[i])
            else:
                ok[i], why[i] = 0, 2
            out_bal[i] = bal
        return bal
    never = max(bal, 0) + 1
    amt, need = np.minimum(amt, never), np.minimum(need, never)
    cs = np.concatenate(([0], np.cumsum(amt)))
    # Row j of the stretch fits if cs[j] + need[j] <= cs[i] + bal.  need exceeds
    # the debit by a cent at most, so cs[j + 1] <= cs[i] + bal holds for every
    # fitting row; among the rows within that bound the first misfit ends it.
    reach = cs[:-1] + need
    i = 0
    while i < n:
        j = min(int(np.searchsorted(cs, cs[i] + bal, side="right")) - 1, n)
        short = np.flatnonzero(need[i:j] > amt[i:j])
        over = short[reach[i + short] > cs[i] + bal]
        j = i + int(over[0]) if over.size else max(j, i)
        if j > i:
            out_bal[i:j] = bal - (cs[i + 1:j + 1] - cs[i])
            bal = bal - int(cs[j] - cs[i])
            i = j
        if i >= n:
            break
        # Row i is rejected; so is every row up to the next one that fits.
        nxt = i + 1
        block = 64
        while nxt < n:
            hit = np.flatnonzero(need[nxt:nxt + block] <= bal)
            if hit.size:
                nxt += int(hit[0])
                break
            nxt += block
            block = min(block * 4, 1 << 16)
        nxt = min(nxt, n)
        ok[i:nxt], why[i:nxt] = 0, 2
        out_bal[i:nxt] = bal
        i = nxt
    return bal


def _arrival(ts_col: str) -> list:
    return [F.col(ts_col).asc_nulls_first(), F.col("transaction_id").asc_nulls_first(),
            F.col("__amt").asc_nulls_first(), F.col("__approved").asc()]


WIDE = "decimal(20,0)"       # sums of cents beyond a long


def _fold(rows: DataFrame) -> DataFrame:
    """The ordered fold over rows sorted by user and arrival; ``__open`` of a user's
    first row is the balance before it."""
    extra = [T.StructField("__ok", T.LongType()), T.StructField("__why", T.LongType()), T.StructField("__balc", T.LongType())]
    return rows.mapInPandas(_fold_batches, T.StructType(rows.schema.fields + extra))


def _decide(rows: DataFrame, takes: F.Column, balance: F.Column) -> DataFrame:
    """Adds ``__ok``, ``__why`` and ``__balc`` where the accepted debits are known."""
    ok = F.when((F.col("__approved") == 0) | F.coalesce(takes, F.lit(False)), 1).otherwise(0).cast("long")
    return (rows.withColumn("__ok", ok)
            .withColumn("__why", F.when(F.col("__ok") == 1, 0).when(F.col("__open").isNull(), 1).otherwise(2).cast("long"))
            .withColumn("__balc", balance.cast("long")))


def _gate_users(rows: DataFrame, ts_col: str) -> DataFrame:
    """Users of bounded size: one sort, a running sum, and the fold from the first
    row that would overdraw."""
    candidate = (F.col("__approved") == 1) & (F.col("__need") <= F.col("__open")) & (F.col("__amt") >= 0)
    takes = F.coalesce(candidate, F.lit(False))
    # rows without a profile have no balance to follow: spread them
    spread = rows.withColumn("__spread", F.when(F.col("__open").isNull(), F.xxhash64("transaction_id", "__amt")).otherwise(0))
    user = Window.partitionBy("user_id", "__spread").orderBy(*_arrival(ts_col))
    debit = F.when(takes, F.col("__amt")).otherwise(0).cast(WIDE)
    before = F.coalesce(F.sum(debit).over(user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    overdraws = (F.coalesce(F.col("__approved") * F.col("__amt"), F.lit(0)) < 0) | (takes & (F.col("__before") + F.col("__need") > F.col("__open")))
    known = (spread.withColumn("__before", before)
             .withColumn("__late", F.max(overdraws).over(user.rowsBetween(Window.unboundedPreceding, 0))))
    sure = _decide(known.filter(~F.col("__late")), takes, F.col("__open") - F.col("__before") - debit)
    late = (known.filter("__late").withColumn("__open", (F.col("__open") - F.col("__before")).cast("long"))
            .sortWithinPartitions("user_id", "__spread", *_arrival(ts_col)))       # the order the running sum left
    return sure.unionByName(_fold(late).select(*sure.columns)).drop("__spread", "__before", "__late")


def balance_levels(rows: DataFrame, state: DataFrame, keep) -> DataFrame:
    """The phases of each user: user_id, start and end (places), ``limit`` and
    ``balance`` at the start.  A row inside a phase is accepted if it needs at most
    ``limit``; the row at a phase's end is accepted.  Inside a phase the balance stays
    at ``limit`` or above; at its end it is at most half of what it was.

    ``rows``: user_id, place (struct of cell and number), __amt >= 0, __need;
    ``state``: user_id, balance, place (the rows after it are open).
    """
    phases = None
    while True:
        # at 1 cent a row may need it and debit nothing, so the level is 1, not 0
        half = F.when(F.col("balance") == 1, 1).otherwise(F.floor(F.col("balance") / 2)).cast("long")
        open_rows = (rows.join(state.withColumnRenamed("place", "start"), "user_id")
                     .filter((F.col("place") > F.col("start")) & (F.col("__need") <= F.col("balance"))))
        small = F.col("__need") <= half
        spend = F.when(small, F.col("__amt")).otherwise(0).cast(WIDE)
        cells = open_rows.groupBy("user_id", F.col("place.cell").alias("cell")).agg(
            F.first("balance").alias("balance"), F.sum(spend).alias("spend"),
            F.min(F.when(~small, F.col("__need"))).alias("least"))
        earlier = Window.partitionBy("user_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        spent = cells.withColumn("before", F.coalesce(F.sum("spend").over(earlier), F.lit(0)))
        left = F.col("balance") - F.col("before")
        fits = F.coalesce(F.col("least") <= left, F.lit(False))
        due = (spent.filter((left >= half) & (fits | (left - F.col("spend") < half)))   # none after the one that crosses
               .select("user_id", "cell", "before"))
        inside = Window.partitionBy("user_id", "cell").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        near = (open_rows.withColumn("cell", F.col("place.cell")).join(due, ["user_id", "cell"])
                .withColumn("before", F.col("before") + F.coalesce(F.sum(spend).over(inside), F.lit(0))))
        event = F.when(small, left - F.col("__amt") < half).otherwise(F.col("__need") <= left)
        first = near.filter(event).groupBy("user_id").agg(
            F.min(F.struct("place", (left - F.col("__amt")).cast("long").alias("left"))).alias("e"))
        done = keep(state.join(first, "user_id", "left").select(
            "user_id", F.col("place").alias("start"), F.col("e.place").alias("end"), half.alias("limit"), "balance",
            F.col("e.left").alias("left")))
        phases = done if phases is None else phases.unionByName(done)
        state = done.filter(F.col("end").isNotNull()).select("user_id", F.col("left").alias("balance"), F.col("end").alias("place"))
        if state.isEmpty():
            return phases.drop("left")


def _gate_hot_users(rows: DataFrame, ts_col: str, keep) -> DataFrame:
    """Users of any size, cell by cell; then by balance levels."""
    own, cell_of = ["user_id", "__cell"], F.floor(F.unix_seconds(F.col(ts_col).cast("timestamp")) / CELL_SECONDS)
    number = F.row_number().over(Window.partitionBy(*own).orderBy(*_arrival(ts_col)))
    rows = keep(rows.withColumn("__cell", F.coalesce(cell_of, F.lit(-(1 << 62))).cast("long"))      # places are fixed
                .withColumn("__place", F.struct(F.col("__cell").alias("cell"), number.alias("number"))))   # once stored
    candidate = F.coalesce((F.col("__approved") == 1) & (F.col("__need") <= F.col("__open")) & (F.col("__amt") >= 0), F.lit(False))
    money = lambda c: F.sum(F.when(candidate, F.col(c)).otherwise(0).cast(WIDE))
    cells = rows.groupBy(*own).agg(
        F.max("__open").alias("start"), money("__amt").alias("debit"), money("__need").alias("needed"),
        F.max(F.coalesce(F.col("__approved") * F.col("__amt"), F.lit(0)) < 0).alias("negative"))
    user = Window.partitionBy("user_id")
    earlier = user.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    overdraws = F.coalesce(F.col("before") + F.col("needed") > F.col("start"), F.lit(False))
    placed = keep(cells.withColumn("before", F.coalesce(F.sum("debit").over(earlier), F.lit(0)))
                  .withColumn("__negative", F.max("negative").over(user))
                  .withColumn("turn", F.min(F.when(overdraws, F.col("__cell"))).over(user))
                  .withColumn("__late", F.coalesce(F.col("__cell") >= F.col("turn"), F.lit(False)))
                  .withColumn("__left", (F.col("start") - F.col("before")).cast("decimal(30,0)")))
    known = rows.join(placed.select(*own, "__negative", "__late", "__left"), own)
    in_cell = Window.partitionBy(*own).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    debit = F.when(candidate, F.col("__amt")).otherwise(0).cast(WIDE)
    sure = known.filter("NOT __late AND NOT __negative").withColumn("__run", F.sum(debit).over(in_cell))
    out = [_decide(sure, candidate, F.col("__left") - F.col("__run")).drop("__run")]
    # a negative amount anywhere: the whole user in order
    out.append(_fold(known.filter("__negative").repartition("user_id").sortWithinPartitions("user_id", "__place")))
    state = keep(placed.filter("NOT __negative AND __cell = turn").select(
        "user_id", F.col("__left").cast("long").alias("balance"),
        F.struct(F.col("__cell").alias("cell"), F.lit(0).alias("number")).alias("place")))
    if not state.isEmpty():
        late = known.filter("__late AND NOT __negative")
        phases = balance_levels(late.filter(candidate).select("user_id", F.col("__place").alias("place"), "__amt", "__need"),
                                state, keep)
        by_user = phases.groupBy("user_id").agg(F.collect_list(F.struct("start", "end", "limit")).alias("__phases"),
                                                F.max("balance").alias("__first"))   # some fifty phases a user at most
        took = F.exists("__phases", lambda p: (F.col("__place") == p["end"]) | (
            (F.col("__place") > p["start"]) & (p["end"].isNull() | (F.col("__place") < p["end"])) & (F.col("__need") <= p["limit"])))
        accepted = keep(late.join(by_user, "user_id").withColumn("__took", candidate & F.coalesce(took, F.lit(False)))
                        .drop("__phases"))
        debit = F.when(F.col("__took"), F.col("__amt")).otherwise(0).cast(WIDE)
        totals = accepted.groupBy(*own).agg(F.sum(debit).alias("debit"))
        before = totals.select(*own, F.coalesce(F.sum("debit").over(earlier), F.lit(0)).alias("__before"))
        ran = accepted.withColumn("__run", F.sum(debit).over(in_cell)).join(before, own)
        out.append(_decide(ran, F.col("__took"), F.col("__first") - F.col("__before") - F.col("__run"))
                   .drop("__run", "__before", "__first", "__took"))
    both = out[0]
    for o in out[1:]:
        both = both.unionByName(o.select(*both.columns))
    return both.drop("__cell", "__place", "__negative", "__late", "__left")


def balance_gate(txns: DataFrame, profiles: DataFrame, user_col: str = "user_id",
                 ts_col: str = "event_ts", eligible: str | None = None, hot_rows: int = HOT_ROWS,
                 keep=None, count_in: DataFrame | None = None) -> DataFrame:
    """LED1: adds ``decision``, ``message``, ``debited`` (0/1) and
    ``balance_after`` (DECIMAL(14,2); NULL without a profile).

    Arrival order is (event_ts NULLS FIRST, transaction_id NULLS FIRST, amount).
    Approved rows need a profile and enough balance; blocked rows are recorded,
    never debited.  With ``eligible`` (a boolean column), only those rows can
    debit; the others ride along in arrival order without touching the balance.
    An approved row without an amount never fits.  Users with more than
    ``hot_rows`` rows are decided in parallel; the result is the same.  ``keep`` stores
    intermediate tables (default :func:`materialize`); ``count_in`` may name a
    cheaper frame with the same users.
    """
    from txlens.session import materialize

    keep = keep or materialize
    cols = [c for c in txns.columns if c != eligible]
    prof = profiles.select(F.col("user_id").alias("__puser"), _cents("account_balance").alias("__open"))
    approved = F.col("status") == "approved"
    if eligible is not None:
        approved = approved & F.coalesce(F.col(eligible), F.lit(False))
    rows = (txns.join(prof, txns[user_col] == prof.__puser, "left").drop("__puser")
            .withColumn("__amt", _cents("amount"))
            .withColumn("__need", _needed_cents("amount"))
            .withColumn("__approved", F.coalesce(approved, F.lit(False)).cast("int")))
    # the amount comes back from the cents: both branches below then share one exchange
    rows = rows.select(*[F.col(c) for c in cols if c != "amount"], "__open", "__amt", "__need", "__approved")
    if user_col != "user_id":
        rows = rows.withColumnRenamed(user_col, "user_id")
    sizes = (txns if count_in is None else count_in).groupBy(F.col(user_col).alias("__hot")).agg(F.count(F.lit(1)).alias("n"))
    hot = keep(sizes.filter(F.col("__hot").isNotNull() & (F.col("n") > hot_rows)).select("__hot"))
    if hot.isEmpty():
        both = _gate_users(rows, ts_col)
    else:
        mine = F.col("user_id") == F.col("__hot")
        both = _gate_users(rows.join(hot, mine, "left_anti"), ts_col)
        both = both.unionByName(_gate_hot_users(
            rows.filter(F.col("__open").isNotNull()).join(hot, mine, "left_semi"), ts_col, keep).select(*both.columns))
        # a hot user without a profile is decided like any row without one
        both = both.unionByName(_gate_users(rows.filter(F.col("__open").isNull()).join(hot, mine, "left_semi"), ts_col))
    if user_col != "user_id":
        both = both.withColumnRenamed("user_id", user_col)
    return both.select(
        *[(F.col("__amt").cast("decimal(20,0)") / 100).cast(MONEY).alias("amount") if c == "amount" else F.col(c)
          for c in cols],
        F.when(F.col("__ok") == 1, F.lit(ACCEPTED)).otherwise(F.lit(REJECTED)).alias("decision"),
        F.when(F.col("__why") == 1, F.lit(K.MSG_NO_PROFILE))
        .when(F.col("__why") == 2, F.lit(K.MSG_INSUFFICIENT))
        .otherwise(F.lit(K.MSG_ACCEPTED)).alias("message"),
        ((F.col("__ok") == 1) & (F.col("__approved") == 1)).cast("int").alias("debited"),
        (F.col("__balc").cast("decimal(20,0)") / 100).cast(MONEY).alias("balance_after"),
    )


def closing_balance(profiles: DataFrame, gated: DataFrame) -> DataFrame:
    """LED2: opening balance minus the debited amounts, per profile."""
    spent = (gated.filter(F.col("debited") == 1).groupBy("user_id")
             .agg(F.sum(F.col("amount").cast(MONEY)).alias("__spent")))
    return (profiles.join(spent, "user_id", "left")
            .select("user_id", F.col("account_balance").cast(MONEY).alias("opening_balance"),
                    (F.col("account_balance").cast(MONEY) - F.coalesce(F.col("__spent"), F.lit(0)))
                    .cast(MONEY).alias("closing_balance")))


def decide_transactions(feed: DataFrame, blacklist: DataFrame, profiles: DataFrame, keep=None,
                        carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """LED3 with the balance-gated rows: returns (decisions, gated rows).

    ``keep`` (a ``materialize``) stores the gated rows, so that both results come
    from one evaluation; ``carry`` names feed columns to hand through.

    A left join to the distinct blacklisted ids flags denied rows (AQE broadcasts
    the keys when they are small and splits a skewed user's partition
    otherwise), the payload rules become one boolean, and every row goes
    through :func:`balance_gate`, where only allowed, valid, storable rows can
    debit; most are decided there without the ordered fold.
    """
    from txlens.operators.normalize import parse_event_ts, to_double
    from txlens.operators.validate import transaction_rules

    keys = blacklist.select(F.col("user_id").cast("string").alias("__bl_user")).distinct()
    rules = transaction_rules(feed)
    valid = None
    for ok in rules.values():
        valid = ok if valid is None else valid & ok
    flagged = (feed.select("*", valid.alias("__valid"))
               .join(keys, F.col("user_id").cast("string") == F.col("__bl_user"), "left"))
    denied = F.col("__bl_user").isNotNull()
    # A valid amount that the store cannot take fails its own row, not the job.
    exact = to_double("amount").try_cast("decimal(30,12)")
    storable = _cents(to_double("amount")).isNotNull()
    eligible = ~denied & F.col("__valid") & storable
    typed = flagged.select(
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.when(eligible, exact).alias("amount"),
        parse_event_ts("event_time").alias("event_ts"),
        F.col("status").cast("string").alias("status"),
        *[F.col(c) for c in carry or []],
        denied.alias("__denied"), F.col("__valid"), storable.alias("__storable"), eligible.alias("__eligible"))
    gated = balance_gate(typed, profiles, eligible="__eligible", keep=keep,
                         count_in=feed.select(F.col("user_id").cast("string").alias("user_id")))
    gated = keep(gated) if keep else gated
    code = (F.when(F.col("__denied"), F.lit(403)).when(~F.col("__valid"), F.lit(400))
            .when(~F.col("__storable"), F.lit(500))
            .when(F.col("decision") == ACCEPTED, F.lit(200)).otherwise(F.lit(400)))
    refused = F.col("__denied") | ~F.col("__valid") | ~F.col("__storable")
    decisions = gated.select(
        "transaction_id", "user_id", *(carry or []), code.alias("code"),
        F.when(refused, F.lit(REJECTED)).otherwise(F.col("decision")).alias("decision"),
        F.when(F.col("__denied"), F.lit(K.MSG_BLACKLISTED)).when(~F.col("__valid"), F.lit(K.MSG_INVALID))
        .when(~F.col("__storable"), F.lit(K.MSG_FAILED))
        .otherwise(F.col("message")).alias("message"))
    return decisions, gated


def process_transactions(feed: DataFrame, blacklist: DataFrame, profiles: DataFrame) -> DataFrame:
    """LED3: blacklist (403) -> payload validation (400) -> not storable (500) ->
    balance gate (400) -> accepted (200).

    ``feed`` holds the payload columns as text or typed values, ``user_id``
    and ``transaction_id``.  One output row per input row with ``code``,
    ``decision`` and ``message``.
    """
    return decide_transactions(feed, blacklist, profiles)[0]


def insert_skip_duplicates(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """SNK4: rows of ``batch`` whose key is not in ``existing``; within the batch
    the first row by ``order`` wins.  Returns the rows to append."""
    fresh = batch.join(existing.select(key).distinct(), key, "left_anti")
    w = Window.partitionBy(key).orderBy(F.col(order).asc_nulls_last())
    return fresh.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _new_fields(existing: DataFrame, batch: DataFrame, key: str) -> tuple[DataFrame, list[str]]:
    """The batch's fields of the snapshot, each as ``__new_<field>``, one row a key."""
    given = [c for c in existing.columns if c != key and c in batch.columns]
    repeated = F.raise_error(F.concat(F.lit(f"upsert: {key} repeated in the batch: "),
                                      F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
    b = (batch.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.first(c).alias(f"__new_{c}") for c in given])
         .filter(F.when(F.col("__n") > 1, repeated.cast("boolean")).otherwise(F.lit(True))).drop("__n"))
    return b, given


def update_rows(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """SNK5, first half: ``existing`` with the batch's non-NULL fields for its keys.
    A left join, so a small batch goes to the rows and not the rows to it."""
    b, given = _new_fields(existing, batch, key)
    return (existing.join(b, key, "left")
            .select(*[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in given else F.col(c)
                      for c in existing.columns]))


def insert_rows(existing: DataFrame, batch: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """SNK5, second half: rows for the batch's keys that ``existing`` lacks, with
    ``defaults`` (column -> value) for fields the batch leaves out.  Of ``existing``
    only the key column is read."""
    b, given = _new_fields(existing, batch, key)
    out = []
    for field in existing.schema:
        value = F.col(key) if field.name == key else F.col(f"__new_{field.name}") if field.name in given else F.lit(None)
        if field.name != key and field.name in (defaults or {}):
            value = F.coalesce(value, F.lit(defaults[field.name]))
        out.append(value.cast(field.dataType).alias(field.name))
    return b.join(existing.select(key), key, "left_anti").select(*out)


def upsert(existing: DataFrame, batch: DataFrame, key: str, defaults: dict | None = None) -> DataFrame:
    """SNK5: new snapshot -- matching keys take the batch's non-NULL fields
    (absent fields keep the old value), new keys are inserted, with ``defaults``
    (column -> value) for fields the batch leaves out.  A key that the batch
    holds twice fails the job with a message that names it.  This form computes the
    whole snapshot; ``sources.merge_table`` keeps one and rewrites what changed."""
    cols = [c for c in existing.columns if c != key]
    b, given = _new_fields(existing, batch, key)
    j = existing.withColumn("__old", F.lit(True)).join(b, key, "full_outer")
    out = [F.col(key)]
    for c in cols:
        value = F.coalesce(F.col(f"__new_{c}"), F.col(c)) if c in given else F.col(c)
        if defaults and c in defaults:
            fallback = F.lit(defaults[c]).cast(existing.schema[c].dataType)
            value = F.when(F.col("__old").isNull(), F.coalesce(value, fallback)).otherwise(value)
        out.append(value.alias(c))
    return j.select(*out)
