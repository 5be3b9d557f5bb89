"""Statistics, slices, rankings and sweeps over the given orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barworks.catalog import inputs as I
from barworks.catalog.registry import query, r
from barworks.catalog.signal_queries import closed_sql
from barworks.operators import slices, stats
from barworks.plans import ranking
from barworks.plans.arms import Arm, config_hash, reference_grid
from barworks.plans.sweep import sweep_bars
from barworks.schemas import SLICE_FEATURES
from barworks.session import materialize

ORDER = ["entry_ts", "trade_id"]
TRADES = I.SQL_TRADES
EQUITY_SQL = """curve AS (
  SELECT *, sum(net_pnl) OVER (PARTITION BY run_id ORDER BY entry_day, trade_id ROWS UNBOUNDED PRECEDING) AS equity
  FROM trades),
falls AS (
  SELECT run_id, greatest(0, max(equity) OVER (PARTITION BY run_id ORDER BY entry_day, trade_id
    ROWS UNBOUNDED PRECEDING)) - equity AS fall FROM curve),
drawdown AS (SELECT run_id, max(fall) AS max_drawdown FROM falls GROUP BY run_id)"""
QUARTER_SQL = "quarters AS (SELECT run_id, q, sum(net_pnl) AS net, avg(net_pnl) AS net_mean FROM trades GROUP BY run_id, q)"


@query(
    "a1_headline",
    I.with_sql(
        TRADES,
        f"""SELECT run_id, count(*) AS trades, {r('avg(is_win::INT)')} AS win_rate,
          {r('avg((net_pnl > 0)::INT)')} AS net_win_rate, {r('avg(hit_t1::INT)')} AS hit_t1_rate,
          {r('avg(pnl)')} AS avg_pnl, {r('avg(net_pnl)')} AS net_avg_pnl, {r('sum(net_pnl)')} AS total_net,
          {r('avg(r_multiple)')} AS avg_r, {r('avg(net_pnl) * 2.5')} AS net_avg_value,
          {r('count(*) / 250.0')} AS trades_per_day FROM trades GROUP BY run_id""",
    ),
)
def _(spark, d):
    """Counts, rates and means per run in one aggregation."""
    return stats.headline(I.trades(spark, d), ["run_id"], trading_days=250, value_per_point=2.5)


@query(
    "a1_headline_with_empty_runs",
    I.with_sql(
        TRADES,
        f"""SELECT m.c_mktsegment AS run_id, coalesce(count(t.run_id), 0) AS trades,
          {r('coalesce(avg(t.net_pnl), 0)')} AS net_avg_pnl
        FROM (SELECT DISTINCT c_mktsegment FROM customer) m LEFT JOIN (
          SELECT c.c_mktsegment AS run_id, net_pnl FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey
          JOIN trades t ON t.trade_id = o.o_orderkey WHERE c.c_mktsegment LIKE '%U%') t
        ON t.run_id = m.c_mktsegment GROUP BY m.c_mktsegment""",
    ),
)
def _(spark, d):
    """Runs by market segment; segments without trades are listed with zeros."""
    customer = I.table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    owner = I.table(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), "o_custkey")
    rows = (
        I.trades(spark, d)
        .drop("run_id")
        .join(owner, "trade_id")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .withColumnRenamed("c_mktsegment", "run_id")
        .where(F.col("run_id").contains("U"))
    )
    runs = customer.select(F.col("c_mktsegment").alias("run_id")).distinct()
    return stats.headline(rows, ["run_id"], all_keys=runs).select("run_id", "trades", "net_avg_pnl")


@query(
    "a2_max_drawdown",
    I.with_sql(TRADES, EQUITY_SQL, f"SELECT run_id, {r('max_drawdown')} AS max_drawdown FROM drawdown"),
)
def _(spark, d):
    """Largest fall of cumulative net per run."""
    return stats.max_drawdown(I.trades(spark, d), ["run_id"], ORDER, I.order_chunk())


@query(
    "a3_net_by_quarter",
    I.with_sql(
        TRADES, QUARTER_SQL, f"SELECT run_id, q AS quarter, {r('net')} AS net, {r('net_mean')} AS net_mean FROM quarters"
    ),
)
def _(spark, d):
    """Net per calendar quarter."""
    return stats.net_by_quarter(I.trades(spark, d), ["run_id"])


@query(
    "a4_worst_quarter",
    I.with_sql(
        TRADES,
        QUARTER_SQL,
        f"""SELECT run_id, {r('min(net)')} AS worst_quarter_net_sum, {r('min(net_mean)')} AS worst_quarter_net_mean
        FROM quarters GROUP BY run_id""",
    ),
)
def _(spark, d):
    """Worst quarter by sum and by mean; the two are different metrics."""
    return stats.quarter_summary(I.trades(spark, d), ["run_id"]).select(
        "run_id", "worst_quarter_net_sum", "worst_quarter_net_mean"
    )


@query(
    "a5_positive_quarters",
    I.with_sql(
        TRADES,
        QUARTER_SQL,
        "SELECT run_id, count(*) FILTER (net > 0) AS positive_quarters, count(*) AS quarters FROM quarters GROUP BY run_id",
    ),
)
def _(spark, d):
    """Quarters with positive net, and all quarters."""
    return stats.quarter_summary(I.trades(spark, d), ["run_id"]).select(
        "run_id", "positive_quarters", "quarters"
    )


@query(
    "a6_return_over_drawdown",
    I.with_sql(
        TRADES,
        EQUITY_SQL,
        f"""SELECT t.run_id, {r('total')} AS total_net, {r('total / nullif(max_drawdown, 0)')} AS return_over_drawdown
        FROM (SELECT run_id, sum(net_pnl) AS total FROM trades GROUP BY run_id) t JOIN drawdown USING (run_id)""",
    ),
)
def _(spark, d):
    """Total net and its ratio to the drawdown."""
    t = I.trades(spark, d)
    out = stats.headline(t, ["run_id"]).join(
        stats.max_drawdown(t, ["run_id"], ORDER, I.order_chunk()), "run_id"
    )
    ratio = stats.return_over_drawdown(F.col("total_net"), F.col("max_drawdown"))
    return out.select("run_id", "total_net", ratio.alias("return_over_drawdown"))


@query(
    "a7_breakdown",
    I.with_sql(
        TRADES,
        f"""SELECT run_id,
          CASE WHEN grouping(volatility_regime) = 0 THEN 'regime' WHEN grouping(qd) = 0 THEN 'q+dir'
               WHEN grouping(q) = 0 THEN 'quarter' WHEN grouping(m) = 0 THEN 'month'
               WHEN grouping(y) = 0 THEN 'year' ELSE 'total' END AS breakdown,
          coalesce(volatility_regime, qd, q, m, y) AS bucket, count(*) AS trades,
          {r('avg(is_win::INT)')} AS win_rate, {r('avg(net_pnl)')} AS net_avg_pnl
        FROM (SELECT *, q || '_' || direction AS qd, strftime(entry_day, '%Y-%m') AS m, strftime(entry_day, '%Y') AS y FROM trades)
        GROUP BY GROUPING SETS ((run_id), (run_id, volatility_regime), (run_id, q), (run_id, qd), (run_id, m), (run_id, y))""",
    ),
)
def _(spark, d):
    """Regime, quarter and direction, month, quarter, year and total in one pass."""
    return stats.breakdown(I.trades(spark, d), ["run_id"])


@query(
    "a8_by_vote_combination",
    I.with_sql(
        TRADES,
        """SELECT run_id, concat_ws(' + ', CASE WHEN trade_id % 2 = 0 THEN 'Candle' END,
            CASE WHEN trade_id % 3 = 0 THEN 'RSI+BB' END, CASE WHEN trade_id % 5 = 0 THEN 'S/R' END) AS votes,
          count(*) AS trades, count(*) FILTER (pnl > 0) AS wins FROM trades GROUP BY ALL""",
    ),
)
def _(spark, d):
    """Trades per set of votes."""
    key = F.col("trade_id")
    fired = F.array(
        F.when(key % 5 == 0, "S/R"), F.when(key % 3 == 0, "RSI+BB"), F.when(key % 2 == 0, "Candle")
    )
    t = I.trades(spark, d).withColumn("reasons", F.filter(fired, lambda x: x.isNotNull()))
    return stats.by_vote_combination(t, ["run_id"])


@query(
    "a9_equity_curve",
    I.with_sql(
        TRADES,
        f"""SELECT run_id, trade_id, {r("sum(pnl - 0.05::DOUBLE) OVER (PARTITION BY run_id "
          "ORDER BY entry_day, trade_id ROWS UNBOUNDED PRECEDING)")} AS equity FROM trades""",
    ),
)
def _(spark, d):
    """Cumulative net in entry order, at a spread of whole cents."""
    t = stats.with_net(I.trades(spark, d), 0.05)
    out = stats.equity_curve(t, ["run_id"], ORDER, I.order_chunk())
    return out.select("run_id", "trade_id", "equity")


STORED_SQL = """stored AS (SELECT run_id, avg(pnl) - 0.4794 AS net_avg_pnl FROM trades
  WHERE run_id <> '5-LOW' GROUP BY run_id)"""


def _stored_runs(trades):
    return (
        trades.where(F.col("run_id") != "5-LOW")
        .groupBy("run_id")
        .agg((F.avg("pnl") - 0.4794).alias("net_avg_pnl"))
    )


@query(
    "a10_recovered_spread",
    I.with_sql(
        TRADES,
        STORED_SQL,
        f"""SELECT run_id, {r('m - net_avg_pnl')} AS avg_spread
        FROM (SELECT run_id, avg(pnl) AS m FROM trades GROUP BY run_id) JOIN stored USING (run_id)""",
    ),
)
def _(spark, d):
    """Spread recovered from the mean pnl and the stored net average."""
    t = I.trades(spark, d)
    return stats.recovered_spread(t, _stored_runs(t))


@query(
    "a11_repaired_net",
    I.with_sql(
        TRADES,
        STORED_SQL,
        f"""SELECT t.trade_id, {r('coalesce(t.pnl - (m - s.net_avg_pnl), t.net_pnl)')} AS net_pnl
        FROM trades t JOIN (SELECT run_id, avg(pnl) AS m FROM trades GROUP BY run_id) a USING (run_id)
        LEFT JOIN stored s USING (run_id)""",
    ),
)
def _(spark, d):
    """Net column repaired twice; runs without a stored average keep theirs."""
    t = I.trades(spark, d)
    runs = _stored_runs(t)
    once = stats.repair_net(t, runs)
    return stats.repair_net(once, runs).select("trade_id", "net_pnl")


@query(
    "a12_title_summary",
    I.with_sql(
        TRADES,
        f"""SELECT run_id, count(*) AS trades, {r('100 * avg(is_win::INT)')} AS win_pct, {r('avg(r_multiple)')} AS avg_r
        FROM trades GROUP BY run_id""",
    ),
)
def _(spark, d):
    """Count, win percentage and mean R of the title line."""
    return stats.title_summary(I.trades(spark, d), ["run_id"]).drop("title")


@query(
    "a_run_metrics",
    I.with_sql(
        TRADES,
        EQUITY_SQL,
        QUARTER_SQL,
        f"""SELECT t.run_id, trades, {r('total')} AS total_net, {r('max_drawdown')} AS max_drawdown,
          positive_quarters, {r('worst')} AS worst_quarter_net_sum
        FROM (SELECT run_id, count(*) AS trades, sum(net_pnl) AS total FROM trades GROUP BY run_id) t
        JOIN drawdown USING (run_id)
        JOIN (SELECT run_id, count(*) FILTER (net > 0) AS positive_quarters, min(net) AS worst
              FROM quarters GROUP BY run_id) USING (run_id)""",
    ),
)
def _(spark, d):
    """Every metric of a run in one row."""
    out = stats.run_metrics(I.trades(spark, d), ["run_id"], ORDER, chunk=I.order_chunk())
    return out.select(
        "run_id", "trades", "total_net", "max_drawdown", "positive_quarters", "worst_quarter_net_sum"
    )


def _slice_sql(features: list[str], buckets: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT run_id, trade_id, '{f}' AS feature, {f}::DOUBLE AS v, is_win, net_pnl FROM trades "
        f"WHERE {f} IS NOT NULL"
        for f in features
    )
    return I.with_sql(
        TRADES,
        f"long AS ({parts})",
        f"""placed AS (SELECT *, row_number() OVER (PARTITION BY run_id, feature ORDER BY v, trade_id) - 1 AS pos,
          greatest(1, count(*) OVER (PARTITION BY run_id, feature) // {buckets}) AS per,
          avg(is_win::INT) OVER (PARTITION BY run_id, feature) AS base FROM long)""",
        """cut AS (SELECT run_id, feature, CAST(pos // per AS BIGINT) AS bucket, min(v) AS lo, max(v) AS hi,
          count(*) AS trades, avg(net_pnl) AS net_avg_pnl, avg(is_win::INT) AS win_share, min(base) AS base
          FROM placed GROUP BY ALL)""",
        f"""SELECT run_id, feature, bucket, {r('lo')} AS lo, {r('hi')} AS hi, trades, {r('net_avg_pnl')} AS net_avg_pnl,
          {r('win_share')} AS win_share, {r('base')} AS baseline_win,
          {r('greatest(0.3, trades / max(trades) OVER (PARTITION BY run_id, feature))')} AS confidence,
          win_share < base - 0.10 AS drag, win_share >= base AS good FROM cut""",
    )




@query("q1_slice", _slice_sql(["atr_value"], 7))
def _(spark, d):
    """Seven equal-count buckets of one feature, the remainder in an extra bucket."""
    return slices.slice_feature(I.trades(spark, d), "atr_value", 7, tie="trade_id")


@query("q2_slice_with_gaps", _slice_sql(["dist_to_trend_ema_atr"], 4))
def _(spark, d):
    """A feature that is null for every seventh trade; baseline and drag over the rest."""
    return slices.slice_feature(I.trades(spark, d), "dist_to_trend_ema_atr", 4, tie="trade_id")


@query("q3_slice_all", _slice_sql(list(SLICE_FEATURES), 5))
def _(spark, d):
    """Every stored feature in one job: dense and few values, one dominant value, gaps and NaN."""
    return slices.slice_all(I.trades(spark, d), buckets=5, tie="trade_id")


@query("q4_confidence", _slice_sql(["hour_utc"], 10))
def _(spark, d):
    """Confidence weights of the buckets of a feature with 24 values, ties ordered by a text."""
    trades = I.trades(spark, d).withColumn("tie", F.format_string("trade-%012d", F.col("trade_id")))
    return slices.slice_feature(trades, "hour_utc", 10, tie="tie")


# ---- Experiments ---------------------------------------------------------------------------

EXPERIMENTS_SQL = """experiments AS (
  SELECT o_custkey AS experiment_id, 'arm' || CAST(o_custkey % 7 AS VARCHAR) AS label, count(*) AS trades,
    avg(is_win::INT) AS win_rate, avg(net_pnl) AS net_avg_pnl, sum(net_pnl) AS total_net
  FROM trades JOIN orders ON o_orderkey = trade_id GROUP BY o_custkey),
by_q AS (SELECT o_custkey AS experiment_id, q, avg(net_pnl) AS m FROM trades JOIN orders ON o_orderkey = trade_id
  GROUP BY ALL)"""


def _experiments(spark, d):
    """One experiment per customer."""
    owner = I.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("trade_id"), F.col("o_custkey").alias("experiment_id")
    )
    t = I.trades(spark, d).join(owner, "trade_id")
    label = F.concat(F.lit("arm"), (F.col("experiment_id") % 7).cast("string"))
    return t, stats.headline(t, ["experiment_id"]).withColumn("label", label)


@query(
    "p13_losers",
    I.with_sql(
        TRADES,
        f"""SELECT signal_key, epoch_us(entry_day::TIMESTAMP) AS entry_ts, direction, {r('net_pnl')} AS net_pnl
        FROM trades WHERE run_id = '1-URGENT' AND NOT is_win""",
    ),
)
def _(spark, d):
    """All losing trades of one run."""
    return ranking.trades_of(I.trades(spark, d), "1-URGENT", "losers").select(
        "signal_key", "entry_ts", "direction", "net_pnl"
    )


@query(
    "p13_worst_losers_top40",
    I.with_sql(
        TRADES,
        f"""SELECT signal_key, {r('net_pnl')} AS net_pnl FROM trades WHERE run_id = '2-HIGH' AND NOT is_win
        ORDER BY trades.net_pnl, signal_key LIMIT 40""",
    ),
)
def _(spark, d):
    """The listing of the 40 worst losing trades: a top-k report."""
    return ranking.worst_losers(I.trades(spark, d), "2-HIGH", ranking.LISTING_LIMIT).select("signal_key", "net_pnl")


@query(
    "p14_quality_gate",
    I.with_sql(
        TRADES,
        EXPERIMENTS_SQL,
        f"""SELECT e.experiment_id, label, {r('win_rate')} AS win_rate, {r('net_avg_pnl')} AS net_avg_pnl
        FROM experiments e JOIN (SELECT experiment_id, min(m) AS worst FROM by_q GROUP BY ALL) USING (experiment_id)
        WHERE win_rate > 0.75 AND worst > 0 AND net_avg_pnl > 0""",
    ),
)
def _(spark, d):
    """Experiments with over 75% winners, no losing quarter and positive net."""
    t, exps = _experiments(spark, d)
    exps = exps.join(stats.quarter_summary(t, ["experiment_id"]), "experiment_id")
    return ranking.quality_gate(exps).select("experiment_id", "label", "win_rate", "net_avg_pnl")


METRICS_SQL = (
    "spread AS (SELECT epic, avg(ask - bid) AS s FROM quotes GROUP BY epic)",
    "dates AS (SELECT count(DISTINCT end_s // 86400) AS days FROM bars)",
    """net AS (SELECT c.*, pnl - s.s AS net_pnl, CASE WHEN risk = 0 THEN 0 ELSE pnl / risk END AS r_multiple
      FROM closed c JOIN spread s USING (epic))""",
    """curve AS (SELECT label, sum(net_pnl) OVER (PARTITION BY label
      ORDER BY entry_s, direction, epic ROWS UNBOUNDED PRECEDING) AS eq,
      row_number() OVER (PARTITION BY label ORDER BY entry_s, direction, epic) AS rn FROM net)""",
    """falls AS (SELECT label, max(greatest(0, peak) - eq) AS max_drawdown FROM (
      SELECT label, eq, max(eq) OVER (PARTITION BY label ORDER BY rn ROWS UNBOUNDED PRECEDING) AS peak FROM curve)
      GROUP BY label)""",
    """metrics AS (SELECT a.label, count(n.label) AS trades, coalesce(avg((pnl > 0)::INT), 0) AS win_rate,
      coalesce(avg((net_pnl > 0)::INT), 0) AS net_win_rate, coalesce(avg((n.n >= 1)::INT), 0) AS hit_t1_rate,
      coalesce(avg(r_multiple), 0) AS avg_r, coalesce(avg(net_pnl), 0) AS net_avg_pnl,
      coalesce(sum(net_pnl), 0) AS total_net, coalesce(any_value(f.max_drawdown), 0) AS max_drawdown,
      coalesce(count(n.label) / any_value(dates.days)::DOUBLE, 0) AS trades_per_day
      FROM arms a LEFT JOIN net n ON n.label = a.label LEFT JOIN falls f ON f.label = a.label CROSS JOIN dates
      GROUP BY a.label)""",
)
SWEEP_SQL = (*closed_sql(I.DEMO_GRID), *METRICS_SQL)
SWEEP_OUT = f"""SELECT label, trades, {r('win_rate')} AS win_rate, {r('net_win_rate')} AS net_win_rate,
  {r('hit_t1_rate')} AS hit_t1_rate, {r('avg_r')} AS avg_r, {r('net_avg_pnl')} AS net_avg_pnl,
  {r('total_net')} AS total_net, {r('max_drawdown')} AS max_drawdown, {r('trades_per_day')} AS trades_per_day
  FROM metrics"""


def _grid_sql() -> str:
    """The full grid in SQL: arms are grouped by what their indicators and votes depend on."""
    groups: dict[tuple, list[Arm]] = {}
    for arm in reference_grid():
        key = (arm.trend_ema_period, arm.swing_lookback_bars, arm.enable_structure)
        groups.setdefault(key, []).append(arm)
    parts = []
    for arms in groups.values():
        head = arms[0]
        parts.append(
            I.with_sql(
                I.sql_bars(5),
                I.sql_recurrences(head),
                I.sql_frame(head),
                I.sql_arms(arms),
                I.sql_signals(head),
                I.SQL_TAKEN,
                I.sql_outcomes(),
                *METRICS_SQL,
                SWEEP_OUT,
            )
        )
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in parts)


def _sweep(spark, d):
    from barworks.operators.bars import average_spread

    bars = materialize(I.bars(spark, d))
    return sweep_bars(bars, I.DEMO_GRID, average_spread(I.quotes(spark, d)))


SWEEP_COLUMNS = [
    "label", "trades", "win_rate", "net_win_rate", "hit_t1_rate", "avg_r", "net_avg_pnl", "total_net",
    "max_drawdown", "trades_per_day",
]


@query(
    "e2_sweep_metrics",
    I.with_sql(
        *SWEEP_SQL,
        SWEEP_OUT,
    ),
)
def _(spark, d):
    """Seven arms with entries, gating, ladders and metrics in one job."""
    return _sweep(spark, d).metrics.select(*SWEEP_COLUMNS)


@query(
    "e2_sweep_trades",
    I.with_sql(
        *SWEEP_SQL,
        f"""SELECT label, epic, direction, signal_idx, exit_idx, reason AS exit_reason, {r('pnl')} AS pnl,
          {r('net_pnl')} AS net_pnl, {r('r_multiple')} AS r_multiple FROM net""",
    ),
)
def _(spark, d):
    """The trades behind the sweep."""
    return _sweep(spark, d).trades.select(
        "label", "epic", "direction", "signal_idx", "exit_idx", "exit_reason", "pnl", "net_pnl", "r_multiple"
    )


@query("e1_full_grid_on_events", _grid_sql())
def _(spark, d):
    """The 19 arms of the full grid with their real periods over 5-minute bars of the events."""
    from barworks.operators.bars import average_spread, resample

    quotes = I.quotes(spark, d)
    bars = materialize(resample(quotes, 5))
    result = sweep_bars(bars, reference_grid(), average_spread(quotes))
    return ranking.rank_arms(result.metrics).select(*SWEEP_COLUMNS)


@query(
    "e3_ranked_runs",
    I.with_sql(
        TRADES,
        f"""SELECT run_id AS label, {r('avg((net_pnl > 0)::INT)')} AS net_win_rate, count(*) AS trades
        FROM trades GROUP BY run_id""",
    ),
)
def _(spark, d):
    """Runs ranked by net win rate."""
    m = stats.headline(I.trades(spark, d), ["run_id"]).withColumnRenamed("run_id", "label")
    return ranking.rank_arms(m).select("label", "net_win_rate", "trades")


HASH_ARM = Arm(name="hashed")


@query(
    "e4_config_hash",
    f"""SELECT event_type AS instrument, substr(sha256(concat_ws('|', '{HASH_ARM.config_json}', event_type, '60',
      strftime(min(ts), '%Y-%m-%dT%H:%M:%S'), strftime(max(ts), '%Y-%m-%dT%H:%M:%S'))), 1, 12) AS config_hash
    FROM events GROUP BY event_type""",
)
def _(spark, d):
    """Config hash per instrument over its own window."""
    e = I.table(spark, d, "events").groupBy(F.col("event_type").alias("instrument")).agg(
        F.min("ts").alias("a"), F.max("ts").alias("b")
    )
    text = "yyyy-MM-dd'T'HH:mm:ss"
    digest = config_hash(
        F.lit(HASH_ARM.config_json), F.col("instrument"), F.lit(60), F.date_format("a", text), F.date_format("b", text)
    )
    return e.select("instrument", digest.alias("config_hash"))


@query(
    "e5_list_experiments",
    I.with_sql(
        TRADES,
        EXPERIMENTS_SQL,
        f"""SELECT experiment_id, label, trades, {r('win_rate')} AS win_rate, {r('net_avg_pnl')} AS net_avg_pnl
        FROM experiments ORDER BY experiment_id""",
    ),
)
def _(spark, d):
    """All experiments by id."""
    _, exps = _experiments(spark, d)
    return ranking.list_experiments(exps).select("experiment_id", "label", "trades", "win_rate", "net_avg_pnl")


@query(
    "e5_find_experiment",
    I.with_sql(
        TRADES,
        EXPERIMENTS_SQL,
        "SELECT experiment_id, label, trades FROM experiments WHERE label = 'arm3' ORDER BY experiment_id DESC LIMIT 1",
    ),
)
def _(spark, d):
    """The latest experiment with a given label: a top-1 lookup."""
    _, exps = _experiments(spark, d)
    return ranking.find_experiment(exps, "arm3").select("experiment_id", "label", "trades")


@query(
    "e6_pooled_trades",
    """SELECT sha256('entry' || CAST(l_suppkey % 3 AS VARCHAR)) AS entry_hash, CAST(l_orderkey AS VARCHAR) AS signal_key,
      count(*) AS experiments, min(l_suppkey) AS experiment_id FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    """Line items pooled per order over the suppliers that share an entry config."""
    rows = I.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("experiment_id"),
        F.col("l_orderkey").cast("string").alias("signal_key"),
        F.col("l_extendedprice").alias("pnl"),
    )
    entry = F.concat(F.lit("entry"), (F.col("s_suppkey") % 3).cast("string"))
    configs = I.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("experiment_id"), entry.alias("entry_config")
    )
    return ranking.pool_trades(rows, configs).select("entry_hash", "signal_key", "experiments", "experiment_id")


@query(
    "e6_entry_set_difference",
    I.with_sql(
        *closed_sql(I.DEMO_GRID),
        """keyed AS (SELECT label, epic || '|' || CAST(entry_s AS VARCHAR) || '|' || direction AS k FROM closed)""",
        """SELECT side AS only_in, count(*) AS signals FROM (
          (SELECT 'control' AS side, k FROM keyed WHERE label = 'control' EXCEPT ALL
           SELECT 'control', k FROM keyed WHERE label = 'strict') UNION ALL
          (SELECT 'strict' AS side, k FROM keyed WHERE label = 'strict' EXCEPT ALL
           SELECT 'strict', k FROM keyed WHERE label = 'control') UNION ALL
          (SELECT 'differs' AS side, k FROM keyed WHERE label = 'control' EXCEPT ALL
           SELECT 'differs', k FROM keyed WHERE label = 'ladder_none')) GROUP BY side""",
    ),
)
def _(spark, d):
    """Entries that two arms do not share; a ladder arm shares all of its control's."""
    t = _sweep(spark, d).trades
    a = ranking.same_entries(t, "control", "strict")
    b = ranking.same_entries(t, "control", "ladder_none").withColumn("only_in", F.lit("differs"))
    return a.unionByName(b).groupBy("only_in").agg(F.count(F.lit(1)).alias("signals"))


WINDOW_SQL = """w AS (SELECT 'r' || CAST(trade_id % 9 AS VARCHAR) AS label,
    CASE WHEN entry_day < DATE '1999-01-01' THEN 'IS' ELSE 'OOS' END AS win, * FROM trades),
wc AS (SELECT label, win, net_pnl, sum(net_pnl) OVER o AS eq, row_number() OVER o AS rn FROM w
  WINDOW o AS (PARTITION BY label, win ORDER BY entry_day, trade_id)),
wd AS (SELECT label, win, max(greatest(0, peak) - eq) AS dd FROM (SELECT label, win, eq,
  max(eq) OVER (PARTITION BY label, win ORDER BY rn) AS peak FROM wc) GROUP BY ALL),
wq AS (SELECT label, win, count(*) FILTER (s > 0) AS pq FROM (SELECT label, win, q, sum(net_pnl) AS s FROM w GROUP BY ALL)
  GROUP BY ALL),
wm AS (SELECT label, win, count(*) AS trades, avg(net_pnl) AS net_avg, sum(net_pnl) AS total,
  avg(is_win::INT) AS win_rate FROM w GROUP BY ALL)"""


def _window_metrics(spark, d):
    split = F.lit("1999-01-01").cast("timestamp")
    t = I.trades(spark, d).withColumns(
        {
            "label": F.concat(F.lit("r"), (F.col("trade_id") % 9).cast("string")),
            "window": ranking.window_label(F.col("entry_ts"), split),
        }
    )
    return stats.run_metrics(t, ["label", "window"], ORDER, chunk=I.order_chunk())


@query(
    "e7_promotion_gate",
    I.with_sql(
        TRADES,
        WINDOW_SQL,
        f"""SELECT o.label, o.trades, {r('o.net_avg')} AS net_avg_pnl, {r('d.dd')} AS max_drawdown,
          {r('o.total')} AS total_net, {r('o.total / nullif(d.dd, 0)')} AS ratio,
          row_number() OVER (ORDER BY o.total / nullif(d.dd, 0) DESC NULLS LAST, o.label) AS place
        FROM wm o JOIN wd d USING (label, win) JOIN wq i ON i.label = o.label AND i.win = 'IS' AND i.pq >= 3
        JOIN (SELECT net_avg, dd FROM wm JOIN wd USING (label, win) WHERE label = 'r4' AND win = 'OOS') c
          ON o.net_avg > c.net_avg AND d.dd <= c.dd
        WHERE o.win = 'OOS' AND o.label <> 'r4' AND o.trades >= 30""",
    ),
)
def _(spark, d):
    """Arms that beat the control out of sample, ranked."""
    return ranking.promotion_gate(_window_metrics(spark, d), "r4")


@query(
    "e8_window_comparison",
    I.with_sql(
        TRADES,
        WINDOW_SQL,
        f"""SELECT label, {r("max(net_avg) FILTER (win = 'IS')")} AS net_avg_pnl_is,
          {r("max(net_avg) FILTER (win = 'OOS')")} AS net_avg_pnl_oos,
          {r("max(net_avg) FILTER (win = 'OOS') - max(net_avg) FILTER (win = 'IS')")} AS net_avg_pnl_shift,
          {r("max(win_rate) FILTER (win = 'IS')")} AS win_rate_is,
          {r("max(win_rate) FILTER (win = 'OOS')")} AS win_rate_oos,
          {r("max(win_rate) FILTER (win = 'OOS') - max(win_rate) FILTER (win = 'IS')")} AS win_rate_shift
        FROM wm GROUP BY label""",
    ),
)
def _(spark, d):
    """In-sample against out-of-sample per arm."""
    return ranking.compare_windows(_window_metrics(spark, d), ["label"], ["net_avg_pnl", "win_rate"])


@query(
    "e9_list_runs",
    """SELECT o_orderpriority AS id, epoch_us(max(o_orderdate)) AS created_at, count(*) AS trades_count
    FROM orders GROUP BY o_orderpriority ORDER BY created_at DESC, id""",
)
def _(spark, d):
    """Runs, newest first."""
    runs = I.trades(spark, d).groupBy(F.col("run_id").alias("id")).agg(
        F.max("entry_ts").alias("created_at"), F.count(F.lit(1)).alias("trades_count")
    )
    return ranking.list_runs(runs)


@query(
    "e10_trade_list",
    I.with_sql(
        TRADES,
        f"""SELECT signal_key, direction, {r('pnl')} AS pnl, {r('net_pnl')} AS net_pnl, is_win
        FROM trades WHERE run_id = '3-MEDIUM'""",
    ),
)
def _(spark, d):
    """Trades of one run without the bar windows."""
    return ranking.trades_of(I.trades(spark, d), "3-MEDIUM").select(
        "signal_key", "direction", "pnl", "net_pnl", "is_win"
    )
