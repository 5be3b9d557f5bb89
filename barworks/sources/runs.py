"""Experiment, run and annotation tables on shared storage."""

from __future__ import annotations

import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.functions.instants import iso_instant
from barworks.operators.bars import bar_window
from barworks.operators.ordered import join_per_key
from barworks.plans.arms import config_hash
from barworks.schemas import require
from barworks.session import files_of

RUN_COLUMNS = (
    "id", "created_at", "label", "config_json", "instrument", "timeframe_min", "window_start",
    "window_end", "trades_count", "trades_per_day", "win_rate", "net_avg_pnl", "net_avg_pnl_usd",
    "avg_r", "max_drawdown", "worst_quarter_net",
)


# Rows of a saved table are laid out by key, in row groups small enough for point lookups.
LAYOUT = {"parquet.block.size": str(16 << 20)}
BLOOM_VALUES = 100_000  # distinct trade ids that the Bloom filter of a row group is made for


def save_experiments(experiments: DataFrame, trades: DataFrame, root: str) -> None:
    """Persist experiments with their trades.

    Every save writes one folder of its own, an attempt, and commits it last: a line in the manifest
    under the next free number, which only one writer can take. A reader that goes through
    ``read_experiments`` sees, for every id, head and trades of the last committed attempt that has
    it, none where that run had none. A failed attempt is never seen and can simply be run again; of
    two writers of one id the later commit wins whole.
    """
    require(experiments, ["experiment_id"])
    require(trades, ["experiment_id"])
    _save(experiments, trades, root, "experiment", "trade", "experiment_id")


def _save(heads: DataFrame, trades: DataFrame, root: str, heads_name: str, trades_name: str, key: str) -> str:
    # A letter in front, so that no reader takes the name for a number.
    attempt = f"a{uuid.uuid4().hex}"
    order = [c for c in (key, "id", "signal_key") if c in trades.columns]
    # By ranges of the key and the trade: one run may hold most rows, and thousands may share a file.
    rows = trades.repartitionByRange(*order).sortWithinPartitions(*order).write.options(**LAYOUT)
    if "id" in trades.columns:
        rows = rows.option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.expected.ndv#id", str(BLOOM_VALUES))
    rows.parquet(f"{root}/{trades_name}/attempt={attempt}")
    heads.sortWithinPartitions(key).write.parquet(f"{root}/{heads_name}/attempt={attempt}")
    _commit(heads.sparkSession, f"{root}/{heads_name}_manifest", attempt)
    return attempt


def _commit(spark: SparkSession, manifest: str, attempt: str) -> None:
    """Put the attempt under the first free number; creating a file that exists fails, so a number
    that another writer has taken meanwhile is left to it."""
    files, where = files_of(spark, manifest)
    files.mkdirs(where)
    number = max((int(f.getPath().getName()) for f in files.listStatus(where)), default=0)
    while True:
        number += 1
        try:
            out = files.create(files_of(spark, f"{manifest}/{number:012d}")[1], False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            continue
        out.write(attempt.encode())
        out.close()
        return


def _current(spark: SparkSession, root: str, heads_name: str, key: str, only: Column | None = None) -> DataFrame:
    """Heads of the last committed attempt of every key, with the attempt; ``only`` limits them."""
    number = F.regexp_extract(F.input_file_name(), r"(\d+)$", 1).cast("long")
    commits = spark.read.text(f"{root}/{heads_name}_manifest").select(F.col("value").alias("attempt"), number.alias("_number"))
    heads = spark.read.option("mergeSchema", "true").parquet(f"{root}/{heads_name}")
    if only is not None:
        heads = heads.where(only)
    heads = heads.join(commits, "attempt")
    last = heads.groupBy(key).agg(F.max("_number").alias("_number"))
    return heads.join(last, [key, "_number"]).drop("_number")


def _read(spark: SparkSession, root: str, heads_name: str, trades_name: str, key: str) -> tuple[DataFrame, DataFrame]:
    heads = _current(spark, root, heads_name, key)
    trades = spark.read.option("mergeSchema", "true").parquet(f"{root}/{trades_name}")
    named = heads.select(key, "attempt").distinct()
    committed = join_per_key(trades, named, [key, "attempt"], "left_semi")
    return heads.drop("attempt"), committed.drop("attempt")


def read_experiments(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(experiments, trades); only trades of committed experiments are returned."""
    return _read(spark, root, "experiment", "trade", "experiment_id")


def load_run(runs: DataFrame, trades: DataFrame, root: str) -> None:
    """Load runs for review. Loading the same run id again replaces its rows, also by none."""
    keyed = trades.withColumn("id", F.concat_ws(":", F.col("run_id").cast("string"), "signal_key"))
    _save(runs.withColumn("run_id", F.col("id")), keyed, root, "runs", "trades", "run_id")


def read_runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(runs, trades) as last loaded."""
    return _read(spark, root, "runs", "trades", "run_id")


def read_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """One loaded run by its id; no row where there is none."""
    return _current(spark, root, "runs", "run_id", F.col("run_id") == run_id).drop("attempt")


def read_trade(spark: SparkSession, root: str, trade_id: str, bars: DataFrame | None = None, pad: int = 50) -> DataFrame:
    """One loaded trade by its id, with the bar window that was loaded with it; no row where there is
    none.

    The id is compared in the scan, where ranges and Bloom filters of the row groups leave a few.
    ``bars`` gives the window of a trade that was loaded without one; only the bars around it are read.
    """
    found = spark.read.option("mergeSchema", "true").parquet(f"{root}/trades").where(F.col("id") == trade_id)
    runs = [r.run_id for r in found.select("run_id").distinct().collect()]  # an id names one run
    current = _current(spark, root, "runs", "run_id", F.col("run_id").isin(runs)).select("run_id", "attempt")
    trade = found.join(current, ["run_id", "attempt"], "left_semi").drop("attempt")
    row = trade.first() if bars is not None else None
    if row is None:
        return trade
    low, high = min(row.entry_idx, row.exit_idx) - pad, max(row.entry_idx, row.exit_idx) + pad
    return review_trades(trade, bars.where((F.col("epic") == row.epic) & F.col("idx").between(low, high)), pad)


def clean(spark: SparkSession, root: str, heads_name: str, trades_name: str, key: str, older_than_s: float = 86_400) -> list[str]:
    """Delete the folders of attempts that no id is read from any more and that are old enough not to
    be under way; returns their names."""
    kept = {r.attempt for r in _current(spark, root, heads_name, key).select("attempt").distinct().collect()}
    files, where = files_of(spark, f"{root}/{trades_name}")
    gone = []
    for folder in files.listStatus(where):
        name = folder.getPath().getName()
        attempt = name.removeprefix("attempt=")
        if name.startswith("attempt=") and attempt not in kept and folder.getModificationTime() < (time.time() - older_than_s) * 1000:
            for table in (trades_name, heads_name):
                files.delete(files_of(spark, f"{root}/{table}/{name}")[1], True)
            gone.append(attempt)
    return gone


def clean_experiments(spark: SparkSession, root: str, older_than_s: float = 86_400) -> list[str]:
    return clean(spark, root, "experiment", "trade", "experiment_id", older_than_s)


def clean_runs(spark: SparkSession, root: str, older_than_s: float = 86_400) -> list[str]:
    return clean(spark, root, "runs", "trades", "run_id", older_than_s)


def review_trades(trades: DataFrame, bars: DataFrame, pad: int = 50) -> DataFrame:
    """Trades with their bar window attached as an array of (t, o, h, l, c).

    Runs share signal keys, so a window belongs to its run where trades have a ``run_id``.
    """
    keys = [name for name in ("run_id", "signal_key") if name in trades.columns]
    windows = bar_window(trades, bars, keys, pad, pad)
    plain = F.transform("bars", lambda b: b.dropFields("idx"))
    slim = windows.select("epic", *keys, plain.alias("bars"))
    return trades.join(slim, ["epic", *keys], "left")


def export_runs(runs: DataFrame, trades: DataFrame, path: str) -> None:
    """Runs with their trades and bar windows as JSON, one line per trade under its run.

    A run is a folder: its trades are written in parallel, so no run has to fit in one row. Exporting
    a run again replaces its folder and leaves those of other runs.
    """
    nested = export_rows(runs, trades).hint("rebalance", F.col("run_id"))
    nested.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").json(path)


def export_rows(runs: DataFrame, trades: DataFrame) -> DataFrame:
    flat = trades.withColumns(
        {
            name: iso_instant(F.col(name))
            for name, kind in trades.dtypes
            if kind == "timestamp"
        }
    ).withColumn("is_win", F.col("is_win").cast("int"))
    run = F.struct(*[F.col(c) for c in runs.columns])
    head = runs.select(F.col("id").alias("run_id"), run.alias("run"))
    body = [F.col(c) for c in flat.columns if c != "run_id"]
    rows = join_per_key(flat.select("run_id", F.struct(*body).alias("trade")), head, ["run_id"])
    # A run without trades is exported with a null trade.
    bare = head.join(flat.select("run_id").distinct(), "run_id", "left_anti")
    return rows.unionByName(bare.withColumn("trade", F.lit(None).cast(rows.schema["trade"].dataType)))


def experiment_rows(
    metrics: DataFrame,
    arms: DataFrame,
    instrument: str,
    timeframe_min: int,
    window: tuple[str, str],
    code_version: str = "unknown",
) -> DataFrame:
    """The experiment grain: one row per arm with its config, hash, window and headline metrics.

    The id is the hash with the label, so saving the same run again replaces it.
    """
    start, end = window
    digest = config_hash(
        F.col("config_json"), F.lit(instrument), F.lit(timeframe_min), F.lit(start), F.lit(end)
    )
    rows = metrics.join(arms.select("label", "config_json", "entry_config"), "label")
    return rows.withColumns(
        {
            "config_hash": digest,
            "instrument": F.lit(instrument),
            "timeframe_min": F.lit(timeframe_min),
            "window_from": F.lit(start),
            "window_to": F.lit(end),
            "code_version": F.lit(code_version),
            "run_ts": F.current_timestamp(),
        }
    ).withColumn("experiment_id", F.concat_ws("-", "config_hash", "label"))


def run_rows(experiments: DataFrame, value_per_point: float = 1.0) -> DataFrame:
    """The review grain: the 16 columns of a run, from experiment rows."""
    source = {
        "id": F.col("experiment_id"),
        "created_at": F.col("run_ts"),
        "window_start": F.col("window_from"),
        "window_end": F.col("window_to"),
        "trades_count": F.col("trades"),
        "net_avg_pnl_usd": F.col("net_avg_pnl") * value_per_point,
        "worst_quarter_net": F.col("worst_quarter_net_sum"),
    }
    return experiments.select(*[source.get(name, F.col(name)).alias(name) for name in RUN_COLUMNS])


def append_annotation(rows: DataFrame, path: str) -> None:
    """Annotations are an append log; the latest write wins at read time."""
    rows.write.mode("append").parquet(path)


def pull_feedback(feedback: DataFrame) -> DataFrame:
    return feedback.select("signal_key", "flag", "note", "created_at").orderBy("created_at", "signal_key")


def pull_marks(marks: DataFrame) -> DataFrame:
    return marks.select("signal_key", "kind", "bar_ts", "created_at").orderBy("signal_key", "kind")


def to_bars_json(bars: Column) -> Column:
    return F.to_json(bars)
