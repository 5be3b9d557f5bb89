"""Annotations, data-quality splits, and the run tables, over the given events and orders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barworks.catalog import inputs as I
from barworks.catalog.registry import query, r
from barworks.operators import review as V
from barworks.sources import runs as R
from barworks.session import materialize, shared_dir

LATEST_SQL = """last_flags AS (SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY signal_key ORDER BY created_at DESC, id DESC) AS rn FROM log) WHERE rn = 1)"""
# Orders as trades whose signal is the customer, so that annotations by user can meet them.
REVIEW_SQL = """reviewed AS (SELECT o_orderkey AS trade_id, CAST(o_custkey AS VARCHAR) AS signal_key FROM orders)"""


def _by_customer(spark, d):
    return I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").cast("string").alias("signal_key")
    )


@query("n1_latest_feedback", I.with_sql(I.SQL_FEEDBACK, LATEST_SQL, "SELECT signal_key, flag, note, created_at, id FROM last_flags"))
def _(spark, d):
    """Last verdict per signal from the append log."""
    return V.latest_feedback(I.feedback_log(spark, d))


@query("n2_latest_marks", I.with_sql(I.SQL_MARKS, "SELECT signal_key, kind, bar_ts, created_at, id FROM last_marks"))
def _(spark, d):
    """Last mark per signal and kind, deletions applied."""
    return V.latest_marks(I.mark_log(spark, d))


@query(
    "n3_merged_marks",
    I.with_sql(
        I.SQL_MARKS,
        """base AS (SELECT signal_key, kind, max(bar_ts) AS bar_ts FROM log WHERE NOT deleted GROUP BY ALL),
        over_ AS (SELECT signal_key, kind, min(bar_ts) AS bar_ts FROM log WHERE deleted GROUP BY ALL)""",
        """SELECT coalesce(o.signal_key, b.signal_key) AS signal_key, coalesce(o.kind, b.kind) AS kind,
          coalesce(o.bar_ts, b.bar_ts) AS bar_ts
        FROM base b FULL JOIN over_ o ON o.signal_key = b.signal_key AND o.kind = b.kind""",
    ),
)
def _(spark, d):
    """Loaded marks merged with local ones, which are those of one kind of event; local wins per
    signal and kind."""
    log = I.mark_log(spark, d)
    keys = ["signal_key", "kind"]
    base = log.where("NOT deleted").groupBy(*keys).agg(F.max("bar_ts").alias("bar_ts"))
    mine = log.where("deleted").groupBy(*keys).agg(F.min("bar_ts").alias("bar_ts"))
    return V.merge_marks(base, mine)


@query(
    "n4_attached_feedback",
    I.with_sql(
        I.SQL_FEEDBACK,
        LATEST_SQL,
        REVIEW_SQL,
        "SELECT trade_id, t.signal_key, flag FROM reviewed t LEFT JOIN last_flags f ON f.signal_key = t.signal_key",
    ),
)
def _(spark, d):
    """Verdicts joined to trades by signal key."""
    last = V.latest_feedback(I.feedback_log(spark, d)).select("signal_key", "flag")
    return V.attach(_by_customer(spark, d), last).select("trade_id", "signal_key", "flag")


N5_SQL = I.with_sql(
    I.SQL_BARS,
    """placed AS (SELECT event_id, e.event_type AS epic, e.user_id, e.ts,
        coalesce(min(b.idx) FILTER (b.end_s * 1000000 >= epoch_us(e.ts)), max(b.idx)) AS mark_idx
      FROM events e JOIN bars b ON b.epic = e.event_type GROUP BY ALL)""",
    f"""SELECT event_id, mark_idx, mark_idx - 30 AS bars_from_entry, 60 - mark_idx AS bars_to_exit,
      {r("CASE WHEN event_id % 2 = 0 THEN b.c - en.c ELSE en.c - b.c END")} AS pnl_at_mark
    FROM placed p JOIN bars b ON b.epic = p.epic AND b.idx = p.mark_idx
    JOIN bars en ON en.epic = p.epic AND en.idx = 30""",
)


@query("n5_mark_outcomes", N5_SQL)
def _(spark, d):
    """Where each mark lies between entry and exit, and the pnl had the exit been there."""
    bars = materialize(I.bars(spark, d))
    at_entry = bars.where(F.col("idx") == 30).select("epic", F.col("c").alias("entry_price"))
    marks = I.table(spark, d, "events").select(
        "event_id",
        F.col("event_id").cast("string").alias("signal_key"),
        F.col("ts").cast("timestamp").alias("bar_ts"),
    )
    trades = (
        I.table(spark, d, "events")
        .select(
            F.col("event_id").cast("string").alias("signal_key"),
            F.col("event_type").alias("epic"),
            F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT").alias("direction"),
            F.lit(30).cast("long").alias("entry_idx"),
            F.lit(60).cast("long").alias("exit_idx"),
        )
        .join(at_entry, "epic")
    )
    return V.mark_outcomes(marks, trades, bars).select(
        "event_id", "mark_idx", "bars_from_entry", "bars_to_exit", "pnl_at_mark"
    )


@query(
    "n6_unreviewed_trades",
    I.with_sql(REVIEW_SQL, "SELECT trade_id, signal_key FROM reviewed WHERE signal_key NOT IN (SELECT CAST(user_id AS VARCHAR) FROM events)"),
)
def _(spark, d):
    """Trades nobody has annotated."""
    return V.unreviewed(_by_customer(spark, d), I.feedback_log(spark, d))


@query(
    "n6_orphan_annotations",
    I.with_sql(
        I.SQL_FEEDBACK,
        LATEST_SQL,
        "filled AS (SELECT CAST(o_custkey AS VARCHAR) AS signal_key FROM orders WHERE o_orderstatus = 'F')",
        "SELECT signal_key, flag FROM last_flags f WHERE NOT EXISTS (SELECT 1 FROM filled t WHERE t.signal_key = f.signal_key)",
    ),
)
def _(spark, d):
    """Annotations whose signal is not among the filled orders."""
    last = V.latest_feedback(I.feedback_log(spark, d)).select("signal_key", "flag")
    filled = I.table(spark, d, "orders").where(F.col("o_orderstatus") == "F")
    return V.orphans(last, filled.select(F.col("o_custkey").cast("string").alias("signal_key")))


GAPPED = {"direction": 11, "stop_price": 13, "pnl": 17}


@query(
    "p15_incomplete_trades",
    """SELECT o_orderkey AS trade_id, concat_ws(',', CASE WHEN o_orderkey % 11 = 0 THEN 'direction' END,
      CASE WHEN o_orderkey % 13 = 0 THEN 'stop_price' END, CASE WHEN o_orderkey % 17 = 0 THEN 'pnl' END) AS missing
    FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0""",
)
def _(spark, d):
    """Trades with a missing required field, and which ones they lack."""
    t = I.trades(spark, d).withColumns(
        {
            "entry_time": F.col("entry_ts"),
            "exit_time": F.col("exit_ts"),
            **{c: F.col("atr_value") for c in ("entry_price", "exit_price", "stop_price", "target_price")},
        }
    )
    for name, step in GAPPED.items():
        t = t.withColumn(name, F.when(F.col("trade_id") % step != 0, F.col(name)))
    _, broken = V.split_complete(t)
    return broken.select("trade_id", F.array_join("missing_fields", ",").alias("missing"))


FLAG_SQL = """CASE event_type WHEN 'click' THEN 'chop' WHEN 'view' THEN 'late-entry' WHEN 'error' THEN NULL
  ELSE event_type END"""


@query(
    "p16_known_vocabulary",
    f"""SELECT event_id, {FLAG_SQL} AS flag, ({FLAG_SQL}) IS NULL OR ({FLAG_SQL}) IN
      ('knife-catch', 'chop', 'news-spike', 'late-entry', 'bad-exit', 'good-signal') AS known FROM events""",
)
def _(spark, d):
    """Rows with a flag of the vocabulary, and the others quarantined."""
    kind = F.col("event_type")
    flag = (
        F.when(kind == "click", "chop").when(kind == "view", "late-entry").when(kind != "error", kind)
    )
    rows = I.table(spark, d, "events").select("event_id", flag.alias("flag"))
    good, bad = V.split_vocabulary(rows, V.known_flag(F.col("flag")))
    return good.withColumn("known", F.lit(True)).unionByName(bad.withColumn("known", F.lit(False)))


def _scratch(spark) -> str:
    return f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"


@query(
    "s4_saved_experiments",
    I.with_sql(
        I.SQL_TRADES,
        f"""SELECT run_id AS experiment_id, count(*) AS trades, {r('avg(pnl)')} AS avg_pnl FROM trades GROUP BY run_id""",
    ),
)
def _(spark, d):
    """Experiments and trades written, written again, and read back through the commit marker."""
    root = _scratch(spark)
    t = I.trades(spark, d).withColumnRenamed("run_id", "experiment_id")
    exps = t.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"))
    for _attempt in range(2):
        R.save_experiments(exps, t, root)
    _, saved = R.read_experiments(spark, root)
    return saved.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("avg_pnl")
    )


@query(
    "s5_loaded_run",
    I.with_sql(
        I.SQL_TRADES,
        "SELECT run_id, run_id || ':' || signal_key AS id, is_win FROM trades",
    ),
)
def _(spark, d):
    """Runs loaded twice keep one row per trade."""
    root = _scratch(spark)
    t = I.trades(spark, d)
    runs = t.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("trades_count"))
    for _attempt in range(2):
        R.load_run(runs, t, root)
    return R.read_runs(spark, root)[1].select("run_id", "id", "is_win")


@query(
    "s6_exported_runs",
    I.with_sql(
        I.SQL_TRADES,
        f"""SELECT run_id, signal_key, strftime(entry_day, '%Y-%m-%dT00:00:00Z') AS entry_ts, {r('net_pnl')} AS net_pnl,
          is_win::BIGINT AS is_win, n AS trades_count
        FROM trades JOIN (SELECT run_id, count(*) AS n FROM trades GROUP BY run_id) USING (run_id)""",
    ),
)
def _(spark, d):
    """Nested JSON export read back."""
    path = _scratch(spark)
    t = I.trades(spark, d).select("run_id", "signal_key", "entry_ts", "net_pnl", "is_win")
    runs = t.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("trades_count"))
    R.export_runs(runs, t, path)
    schema = (
        "run_id string, run struct<id: string, trades_count: bigint>, "
        "trade struct<signal_key: string, entry_ts: string, net_pnl: double, is_win: bigint>"
    )
    return spark.read.schema(schema).json(path).select("run_id", "trade.*", "run.trades_count")


def _bar_trades(bars):
    """Every bar as the entry of a trade of five bars."""
    return bars.select(
        "epic",
        F.concat_ws("|", "epic", F.col("idx").cast("string")).alias("signal_key"),
        F.col("idx").alias("entry_idx"),
        (F.col("idx") + 5).alias("exit_idx"),
    )


@query(
    "s6_trades_with_bars",
    I.with_sql(
        I.SQL_BARS,
        f"""SELECT t.epic, t.idx AS entry_idx, count(*) AS bars, {r('sum(b.c)')} AS sum_c FROM bars t
        JOIN bars b ON b.epic = t.epic AND b.idx BETWEEN t.idx - 50 AND t.idx + 55
        GROUP BY t.epic, t.idx""",
    ),
)
def _(spark, d):
    """Trades with their bar window as an array; every bar is an entry."""
    bars = materialize(I.bars(spark, d))
    t = _bar_trades(bars)
    out = R.review_trades(t, bars)
    return out.select(
        "epic", "entry_idx", F.size("bars").alias("bars"),
        F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["c"]).alias("sum_c"),
    )


@query(
    "e9_one_run",
    I.with_sql(I.SQL_TRADES, "SELECT run_id AS id, count(*) AS trades_count FROM trades WHERE run_id = '3-MEDIUM' GROUP BY run_id"),
)
def _(spark, d):
    """One of the loaded runs, by its id: a point lookup."""
    root = _scratch(spark)
    t = I.trades(spark, d)
    R.load_run(t.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("trades_count")), t, root)
    return R.read_run(spark, root, "3-MEDIUM").select("id", "trades_count")


@query(
    "e10_trade_with_bars",
    I.with_sql(
        I.SQL_BARS,
        f"""SELECT 'click:click|20' AS id, 20 AS entry_idx, count(*) AS bars, {r('sum(c)')} AS sum_c,
          min(end_s) AS first_end FROM bars WHERE epic = 'click' AND idx BETWEEN 0 AND 75""",
    ),
)
def _(spark, d):
    """One trade of the loaded runs with its bars, by its id: a point lookup."""
    root = _scratch(spark)
    bars = materialize(I.bars(spark, d))
    t = _bar_trades(bars).withColumn("run_id", F.col("epic"))
    R.load_run(t.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("trades_count")), t, root)
    return R.read_trade(spark, root, "click:click|20", bars).select(
        "id", "entry_idx", F.size("bars").alias("bars"), F.aggregate("bars", F.lit(0.0), lambda a, b: a + b["c"]).alias("sum_c"),
        F.col("bars")[0]["t"].alias("first_end"),
    )


@query(
    "s7_pulled_feedback",
    I.with_sql(
        I.SQL_FEEDBACK, LATEST_SQL, "SELECT signal_key, flag, note, created_at FROM last_flags ORDER BY created_at, signal_key"
    ),
)
def _(spark, d):
    """Verdicts pulled for a downstream join."""
    return R.pull_feedback(V.latest_feedback(I.feedback_log(spark, d)))


@query(
    "s7_pulled_marks",
    I.with_sql(I.SQL_MARKS, "SELECT signal_key, kind, bar_ts, created_at FROM last_marks ORDER BY signal_key, kind"),
)
def _(spark, d):
    """Marks pulled for a downstream join."""
    return R.pull_marks(V.latest_marks(I.mark_log(spark, d)))
