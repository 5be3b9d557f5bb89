"""Votes, signals, outcomes and features over the given events."""

from __future__ import annotations

from pyspark.sql import functions as F

from barworks.catalog import inputs as I
from barworks.catalog.registry import query, r
from barworks.functions.guards import at_least, at_most, share
from barworks.functions.instants import iso_weekday
from barworks.operators import outcomes as X
from barworks.operators import votes as V
from barworks.operators.features import bracket, signal_key
from barworks.operators.indicators import Needs, indicator_frame, needs_of
from barworks.plans import sweep as S
from barworks.plans.arms import check_ladder, variant
from barworks.session import materialize

DEMO, CONTROL, GRID = I.DEMO, I.CONTROL, I.DEMO_GRID
FRAME_SQL = (I.SQL_BARS, I.sql_recurrences(), I.sql_frame())


def signal_sql(arms):
    return (*FRAME_SQL, I.sql_arms(arms), I.sql_signals())


def taken_sql(arms):
    return (*signal_sql(arms), I.SQL_TAKEN)


def closed_sql(arms):
    return (*taken_sql(arms), I.sql_outcomes())


# Every signal taken as an event of its own, without waiting for the one before.
def event_sql(arms):
    every = "taken AS (SELECT *, CASE WHEN is_long THEN 1.0 ELSE -1.0 END::DOUBLE AS sgn FROM sig)"
    return (*signal_sql(arms), every, I.sql_outcomes())


@query(
    "flagship_band_breaks",
    I.with_sql(
        *FRAME_SQL,
        f"""SELECT epic, count(*) AS bars, count(*) FILTER (c < lower_band) AS below_band,
          count(*) FILTER (c > upper_band) AS above_band,
          {r('avg(CASE WHEN c < lower_band OR c > upper_band THEN 1 ELSE 0 END)')} AS break_share,
          {r('avg(h - l) FILTER (c < lower_band OR c > upper_band)')} AS break_range
        FROM ind GROUP BY epic""",
    ),
)
def _(spark, d):
    """Per instrument: how often the price closes beyond its band, and the range of those bars."""
    needs = Needs(candles=False, context=False, bands=frozenset({(20, 1.5)}))
    ind = indicator_frame(I.bars(spark, d), needs)
    low, high = F.col("c") < F.col("bb_lower_20_1p5"), F.col("c") > F.col("bb_upper_20_1p5")
    return ind.groupBy("epic").agg(
        F.count(F.lit(1)).alias("bars"),
        F.count_if(low).alias("below_band"),
        F.count_if(high).alias("above_band"),
        share(low | high).alias("break_share"),
        F.avg(F.when(low | high, F.col("h") - F.col("l"))).alias("break_range"),
    )


def _vote(name: str, vote: str, column: str):
    @query(
        name,
        I.with_sql(
            *signal_sql([DEMO]),
            f"SELECT epic, idx, bool_or(is_long AND {column}) AS bull, bool_or(NOT is_long AND {column}) AS bear "
            "FROM votes GROUP BY epic, idx",
        ),
    )
    def _(spark, d):
        bull = dict(V.votes_of(DEMO, True))[vote]
        bear = dict(V.votes_of(DEMO, False))[vote]
        return I.frame(spark, d).select("epic", "idx", F.expr(bull).alias("bull"), F.expr(bear).alias("bear"))


_vote("p1_vote_rsi_band", "RSI+BB", "v_rsi")
_vote("p2_vote_candle", "Candle", "v_candle")
_vote("p3_vote_level", "S/R", "v_level")
_vote("p4_vote_structure", "Structure", "v_break")
_vote("p5_vote_volume_trend", "Vol+Trend", "v_volume")


@query(
    "p6_score",
    I.with_sql(
        *signal_sql([DEMO]),
        """SELECT epic, idx, CAST(max(score) FILTER (is_long) AS BIGINT) AS bull,
          CAST(max(score) FILTER (NOT is_long) AS BIGINT) AS bear FROM scored GROUP BY epic, idx""",
    ),
)
def _(spark, d):
    """Votes that agree, per direction."""
    return I.frame(spark, d).select(
        "epic", "idx",
        F.expr(V.score(V.votes_of(DEMO, True))).alias("bull"),
        F.expr(V.score(V.votes_of(DEMO, False))).alias("bear"),
    )


SIGNAL_OUT = f"""SELECT arm_id::BIGINT AS entry_id, epic, direction, signal_idx, entry_idx,
  {r('entry_price')} AS entry_price, {r('entry_atr')} AS entry_atr, CAST(score AS BIGINT) AS score FROM sig"""


def _signals(spark, d, arms):
    return V.signals(I.frame(spark, d, arms), arms)


def _signal_rows(df):
    return df.select(
        "entry_id", "epic", "direction", "signal_idx", "entry_idx", "entry_price", "entry_atr",
        F.col("features.confluence_score").alias("score"),
    )


@query("p7_entry_signals", I.with_sql(*signal_sql([DEMO]), SIGNAL_OUT))
def _(spark, d):
    """Entry signals of one arm, both directions."""
    return _signal_rows(_signals(spark, d, [DEMO]))


@query(
    "p8_trend_gate",
    I.with_sql(
        *FRAME_SQL,
        """SELECT epic, idx, c > trend AS long_gate, c < trend AS short_gate,
          c > trend AND c < trend + 1.5 * atr AS long_near, c < trend AND c > trend - 1.5 * atr AS short_near
        FROM ind""",
    ),
)
def _(spark, d):
    """Trend gate without and with the proximity ceiling."""
    return I.frame(spark, d).select(
        "epic", "idx",
        F.expr(V.trend_gate(DEMO, True)).alias("long_gate"),
        F.expr(V.trend_gate(DEMO, False)).alias("short_gate"),
        F.expr(V.trend_gate(CONTROL, True)).alias("long_near"),
        F.expr(V.trend_gate(CONTROL, False)).alias("short_near"),
    )


LONG_ONLY = variant(DEMO, "long_only", enable_short=False)


@query(
    "p9_direction_switch",
    I.with_sql(*signal_sql([LONG_ONLY]), SIGNAL_OUT),
)
def _(spark, d):
    """Shorts switched off."""
    return _signal_rows(_signals(spark, d, [LONG_ONLY]))


@query(
    "p10_reasons",
    I.with_sql(*signal_sql([DEMO]), "SELECT epic, direction, entry_idx, reasons FROM sig"),
)
def _(spark, d):
    """The votes that fired at each signal bar, in vote order."""
    return _signals(spark, d, [DEMO]).select(
        "epic", "direction", "entry_idx", F.array_join("reasons", "+").alias("reasons")
    )


@query(
    "p11_warm_up",
    I.with_sql(*FRAME_SQL, f"SELECT epic, idx, idx >= {DEMO.warm_up} AS settled FROM ind"),
)
def _(spark, d):
    """Bars before the longest EMA period take no entries."""
    return I.bars(spark, d).select("epic", "idx", (F.col("idx") >= DEMO.warm_up).alias("settled"))


@query(
    "p12_merged_entries",
    I.with_sql(
        *signal_sql([DEMO]),
        """SELECT epic, entry_s * 1000000 AS entry_ts, direction, entry_idx FROM sig
        ORDER BY epic, entry_ts, direction""",
    ),
)
def _(spark, d):
    """Both directions in entry order per instrument."""
    found = _signals(spark, d, [DEMO])
    return found.select("epic", "entry_ts", "direction", "entry_idx").orderBy(
        "epic", "entry_ts", "direction"
    )


def _stored_bars(spark, d):
    """Bars are read by the signals and by every search, so they are written once."""
    return materialize(I.bars(spark, d))


def _events(spark, d, arm):
    """(search index, signals with distances): every signal is an event of its own."""
    bars = _stored_bars(spark, d)
    frame = indicator_frame(bars, needs_of([arm]))
    return X.touch_index(bars), S.entries(frame, [arm], gate_exit="none")


def _taken(spark, d, arm):
    """(search index, signals that are taken)."""
    bars = _stored_bars(spark, d)
    index = X.touch_index(bars)
    return index, S.entries(indicator_frame(bars, needs_of([arm])), [arm], index.on_close())


OUTCOME_OUT = f"""SELECT epic, direction, entry_idx, exit_idx, reason AS exit_reason,
  {r('exit_price')} AS exit_price FROM closed"""


@query("l1_first_touch", I.with_sql(*event_sql([DEMO]), OUTCOME_OUT))
def _(spark, d):
    """First touch of stop or target after every signal; stop wins ties."""
    index, events = _events(spark, d, DEMO)
    return X.bracket_outcomes(events, index).select(
        "epic", "direction", "entry_idx", "exit_idx", "exit_reason", "exit_price"
    )


TIMED = variant(DEMO, "timed", max_holding_bars=4)


@query("l2_time_stop", I.with_sql(*event_sql([TIMED]), OUTCOME_OUT))
def _(spark, d):
    """The same with a holding limit of 4 bars."""
    index, events = _events(spark, d, TIMED)
    return X.bracket_outcomes(events, index).select(
        "epic", "direction", "entry_idx", "exit_idx", "exit_reason", "exit_price"
    )


FAR = variant(DEMO, "far", stop_atr=6.0, target_atr=12.0)


@query("l3_end_of_data", I.with_sql(*event_sql([FAR]), OUTCOME_OUT))
def _(spark, d):
    """Far levels: long searches, and events that are still open at the last bar."""
    index, events = _events(spark, d, FAR)
    return X.bracket_outcomes(events, index).select(
        "epic", "direction", "entry_idx", "exit_idx", "exit_reason", "exit_price"
    )


def _ladder(name: str, arm, doc: str):
    @query(
        name,
        I.with_sql(
            *event_sql([arm]),
            f"""SELECT epic, direction, entry_idx, exit_idx, reason AS exit_reason,
              {r('exit_price')} AS exit_price, CAST(n AS BIGINT) AS tiers_filled, n >= 1 AS hit_t1,
              {r('pnl')} AS pnl FROM closed""",
        ),
    )
    def _(spark, d):
        index, events = _events(spark, d, arm)
        dist = F.col("entry_atr")
        ladder = F.array(
            *[
                F.struct(
                    F.lit(t.fraction).alias("fraction"), (F.lit(t.target_atr) * dist).alias("dist")
                )
                for t in arm.exit_ladder
            ]
        )
        work = events.withColumns({"ladder": ladder, "ratchet": F.lit(arm.ratchet)})
        out = X.ladder_outcomes(work, index, len(arm.exit_ladder))
        return X.pnl_columns(out).select(
            "epic", "direction", "entry_idx", "exit_idx", "exit_reason", "exit_price",
            "tiers_filled", "hit_t1", "pnl",
        )

    _.__doc__ = doc


_ladder("l4_ladder_thirds", variant(GRID[4], "ladder_none"), "Thirds banked at rising targets.")
_ladder("l5_ratchet_breakeven", variant(GRID[5], "ladder_breakeven"), "Stop moved up behind filled tiers.")
_ladder("l5_ratchet_lagged", variant(GRID[6], "ladder_lagged"), "Stop moved after the second tier.")


@query(
    "l6_ladder_fills",
    I.with_sql(
        *event_sql([GRID[5]]),
        f"""SELECT reason AS exit_reason, CAST(n AS BIGINT) AS tiers_filled, count(*) AS trades,
          {r('avg(exit_price)')} AS mean_price, {r('avg(1.0)')} AS fractions FROM closed GROUP BY reason, n""",
    ),
)
def _(spark, d):
    """Fills per outcome: the fractions of every event sum to one."""
    arm = GRID[5]
    index, events = _events(spark, d, arm)
    ladder = F.array(
        *[
            F.struct(F.lit(t.fraction).alias("fraction"), (F.lit(t.target_atr) * F.col("entry_atr")).alias("dist"))
            for t in arm.exit_ladder
        ]
    )
    out = X.ladder_outcomes(
        events.withColumns({"ladder": ladder, "ratchet": F.lit(arm.ratchet)}), index, 3
    )
    total = F.aggregate("fills", F.lit(0.0), lambda a, f: a + f["fraction"])
    return out.groupBy("exit_reason", "tiers_filled").agg(
        F.count(F.lit(1)).alias("trades"),
        F.avg("exit_price").alias("mean_price"),
        F.avg(total).alias("fractions"),
    )


@query(
    "l7_checked_ladders",
    I.with_sql(
        *event_sql([GRID[4], GRID[5], GRID[6]]),
        f"SELECT label, count(*) AS trades, {r('avg(pnl)')} AS avg_pnl FROM closed GROUP BY label",
    ),
)
def _(spark, d):
    """Three ladders, each checked before any job starts, over the same signals."""
    arms = [GRID[4], GRID[5], GRID[6]]
    for arm in arms:
        check_ladder(arm)
    bars = _stored_bars(spark, d)
    found = S.entries(indicator_frame(bars, needs_of(arms)), arms, gate_exit="none")
    done = S.outcomes(found, X.touch_index(bars), arms)
    label = F.element_at(F.array(*[F.lit(a.name) for a in arms]), F.col("arm_id") + 1)
    return done.groupBy(label.alias("label")).agg(
        F.count(F.lit(1)).alias("trades"), F.avg("pnl").alias("avg_pnl")
    )


@query(
    "l8_pnl_and_r",
    I.with_sql(
        *event_sql([DEMO]),
        f"""SELECT epic, direction, entry_idx, {r('pnl')} AS pnl,
          {r('CASE WHEN risk = 0 THEN 0 ELSE pnl / risk END')} AS r_multiple, pnl > 0 AS is_win FROM closed""",
    ),
)
def _(spark, d):
    """Signed pnl, R-multiple and win flag of every event."""
    index, events = _events(spark, d, DEMO)
    out = X.pnl_columns(X.bracket_outcomes(events, index))
    return out.select("epic", "direction", "entry_idx", "pnl", "r_multiple", "is_win")


@query(
    "l9_non_overlapping",
    I.with_sql(*taken_sql([DEMO]), "SELECT epic, direction, signal_idx, gate_idx FROM taken"),
)
def _(spark, d):
    """Signals that are taken when each waits for the close-based exit of the one before."""
    return _taken(spark, d, DEMO)[1].select("epic", "direction", "signal_idx", "gate_idx")


@query(
    "l9_non_overlapping_users",
    """WITH RECURSIVE e AS (
      SELECT user_id AS epic, event_id AS s, event_id + 1 + CAST(floor(value * 40) AS BIGINT) AS f FROM events),
    n AS (SELECT e.epic, e.s, min(x.s) AS nxt FROM e LEFT JOIN e x ON x.epic = e.epic AND x.s >= e.f GROUP BY ALL),
    chain AS (
      SELECT epic, min(s) AS s FROM e GROUP BY epic
      UNION ALL
      SELECT c.epic, n.nxt FROM chain c JOIN n USING (epic, s) WHERE n.nxt IS NOT NULL)
    SELECT epic, s FROM chain""",
)
def _(spark, d):
    """Per user, events kept when each blocks the user for a while that grows with its value."""
    e = I.table(spark, d, "events").select(
        F.col("user_id").alias("epic"),
        F.col("event_id").alias("s"),
        (F.col("event_id") + 1 + F.floor(F.col("value") * 40)).alias("f"),
    )
    return X.select_non_overlapping(e, ["epic"], "s", "f").select("epic", "s")


@query(
    "l10_close_based_exit",
    I.with_sql(*taken_sql([CONTROL]), "SELECT epic, direction, signal_idx, gate_idx FROM gated"),
)
def _(spark, d):
    """First later close beyond stop or target, or the end of the holding limit."""
    bars = _stored_bars(spark, d)
    events = S.entries(indicator_frame(bars, needs_of([CONTROL])), [CONTROL], gate_exit="none")
    return X.close_based_exit(events, X.touch_index(bars).on_close()).select("epic", "direction", "signal_idx", "gate_idx")


@query(
    "l11_legacy_reason",
    I.with_sql(
        *taken_sql([DEMO]),
        f"""SELECT t.epic, t.direction, t.signal_idx, {r('t.sgn * (b.c - t.entry_price)')} AS pnl,
          CASE WHEN t.gate_idx + 1 >= t.last_idx THEN 'END'
               WHEN t.sgn * (b.c - t.entry_price) > 0 THEN 'TARGET' ELSE 'STOP' END AS exit_reason
        FROM taken t JOIN bars b ON b.epic = t.epic AND b.idx = t.gate_idx + 1""",
    ),
)
def _(spark, d):
    """Close-based trades classified by the sign of their pnl."""
    index, taken = _taken(spark, d, DEMO)
    taken = taken.withColumn("_exit", F.col("gate_idx") + 1)
    out = X.last_bar(X.bar_at(taken, index, "_exit", "bar"), index)
    sign = F.when(F.col("direction") == "LONG", 1.0).otherwise(-1.0)
    pnl = sign * (F.col("bar.close") - F.col("entry_price"))
    return out.select(
        "epic", "direction", "signal_idx", pnl.alias("pnl"),
        X.legacy_reason(F.col("_exit"), F.col("last.idx"), pnl).alias("exit_reason"),
    )


@query(
    "l_label_orders_by_user_series",
    I.with_sql(
        I.SQL_BARS_USER,
        f"""SELECT e.epic, e.idx, min(b.idx) AS touch_idx, {r('arg_min(b.c, b.idx)')} AS touch_price
        FROM bars e LEFT JOIN bars b ON b.epic = e.epic AND b.idx > e.idx
          AND (b.c <= e.c * 0.5 OR b.c >= e.c * 1.5)
        GROUP BY e.epic, e.idx""",
    ),
)
def _(spark, d):
    """Label every event by the first later event of its user that halves it or adds a half."""
    bars = materialize(I.bars_user(spark, d))
    touched = X.first_touch(bars, X.touch_index(bars), "idx", "c * 0.5", "c * 1.5")
    return touched.select(
        "epic", "idx", F.col("touch.at").alias("touch_idx"), F.col("touch.close").alias("touch_price")
    )


@query(
    "f1_entry_features",
    I.with_sql(
        *signal_sql([DEMO]),
        f"""SELECT s.epic, s.direction, s.entry_idx, {r('i.rsi')} AS rsi_value,
          {r('(i.c - i.lower_band) / nullif(i.atr, 0)')} AS dist_to_bb_lower_atr,
          {r('(i.upper_band - i.c) / nullif(i.atr, 0)')} AS dist_to_bb_upper_atr,
          {r('(i.c - i.lowest) / nullif(i.atr, 0)')} AS dist_to_support_atr,
          {r('(i.highest - i.c) / nullif(i.atr, 0)')} AS dist_to_resistance_atr,
          {r('(i.c - i.trend) / nullif(i.atr, 0)')} AS dist_to_trend_ema_atr,
          {r('(i.trend - i.trend_back) / nullif(greatest(1, least(10, i.idx)) * i.atr, 0)')} AS trend_slope_atr,
          {r('i.atr')} AS atr_value, {r('i.atr_rank')} AS atr_percentile,
          {r('i.volume / nullif(i.volume_sma, 0)')} AS volume_ratio,
          CAST(s.score AS BIGINT) AS confluence_score
        FROM sig s JOIN shapes i ON i.epic = s.epic AND i.idx = s.signal_idx""",
    ),
)
def _(spark, d):
    """Feature vector of every signal, taken at the signal bar."""
    return _signals(spark, d, [DEMO]).select("epic", "direction", "entry_idx", "features.*").drop(
        "hour_utc", "day_of_week"
    )


@query(
    "f2_hour_and_weekday",
    I.with_sql(
        *signal_sql([DEMO]),
        """SELECT epic, direction, entry_idx, (entry_s // 3600) % 24 AS hour_utc,
          CAST(isodow(DATE '1970-01-01' + CAST(entry_s // 86400 AS INTEGER)) AS BIGINT) AS day_of_week FROM sig""",
    ),
)
def _(spark, d):
    """UTC hour and ISO weekday of the entry bar's end."""
    return _signals(spark, d, [DEMO]).select(
        "epic", "direction", "entry_idx", "features.hour_utc", "features.day_of_week"
    )


@query(
    "f3_signal_key",
    """SELECT event_id, event_type || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%S') ||
      CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0
           THEN '.' || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0')
           ELSE '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0') END || 'Z|' ||
      CASE WHEN event_id % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS signal_key,
      CAST(isodow(ts) AS BIGINT) AS day_of_week FROM events""",
)
def _(spark, d):
    """Signal keys of all events."""
    ts = F.col("ts").cast("timestamp")
    side = F.when(F.col("event_id") % 2 == 0, "LONG").otherwise("SHORT")
    return I.table(spark, d, "events").select(
        "event_id", signal_key(F.col("event_type"), ts, side).alias("signal_key"),
        iso_weekday(ts).alias("day_of_week"),
    )


@query(
    "f4_stop_and_target_price",
    I.with_sql(
        *signal_sql([DEMO]),
        f"""SELECT s.epic, s.direction, s.entry_idx,
          {r("CASE WHEN is_long THEN entry_price - 1.5 * entry_atr ELSE entry_price + 1.5 * entry_atr END")} AS stop_price,
          {r("CASE WHEN is_long THEN entry_price + 0.75 * entry_atr ELSE entry_price - 0.75 * entry_atr END")} AS target_price,
          {r("CASE WHEN is_long THEN entry_price - 1.5 * i.atr ELSE entry_price + 1.5 * i.atr END")} AS stop_price_signal_atr
        FROM sig s JOIN ind i ON i.epic = s.epic AND i.idx = s.signal_idx""",
    ),
)
def _(spark, d):
    """Stop and target of every signal by the entry bar's ATR, and the stop by the signal bar's."""
    found = _signals(spark, d, [DEMO])
    args = [F.col("direction"), F.col("entry_price")]
    mult = [F.col("stop_atr"), F.col("target_atr")]
    stop, target = bracket(*args, F.col("entry_atr"), *mult)
    shown, _ = bracket(*args, F.col("features.atr_value"), *mult)
    return found.select(
        "epic", "direction", "entry_idx", stop.alias("stop_price"), target.alias("target_price"),
        shown.alias("stop_price_signal_atr"),
    )


@query(
    "guards_nan_comparisons",
    f"""SELECT count(*) FILTER (x <= 1.0) AS at_most_one, count(*) FILTER (x >= 1.0) AS at_least_one,
      {r('sum(x)')} AS total FROM (SELECT value / nullif(event_id % 3, 0) AS x FROM events)""",
)
def _(spark, d):
    """A ratio with zero denominators: NaN passes no comparison."""
    from barworks.functions.guards import ratio

    x = ratio(F.col("value"), (F.col("event_id") % 3).cast("double"))
    rows = I.table(spark, d, "events").select(x.alias("x"))
    one = F.lit(1.0)
    return rows.agg(
        F.count_if(at_most(F.col("x"), one)).alias("at_most_one"),
        F.count_if(at_least(F.col("x"), one)).alias("at_least_one"),
        F.sum(F.when(~F.isnan("x"), F.col("x"))).alias("total"),
    )
