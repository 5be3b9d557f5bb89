"""What later bars did after an event: first touches, ladders, non-overlap selection.

Bars are packed in blocks of 256 with the block's extremes, blocks in groups of 256, groups in one
top row per series. A search climbs from the event's own block to the group and the series and
then descends to the bar. Each step is an equi-join in which an event meets exactly one packed
row, so an event costs five lookups whether the touch is on the next bar or years later, with no
horizon and no pair explosion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barworks.operators.ordered import SALTS, join_per_key
from barworks.session import materialize, materialize_with

BLOCK = 256
CHUNK = 512  # positions in a chunk of the selection
NEVER = 2**62


@dataclass(frozen=True)
class TouchIndex:
    """Packed bars: blocks of bars, groups of blocks, the top row per series, and its last bar.

    Blocks are stored, so all searches read the same rows and Catalyst knows how large they are.
    ``top`` is absent where no series is longer than one group. A search compares the
    ``leaf`` legs of bars and the ``node`` extremes of blocks and groups.
    """

    keys: tuple[str, ...]
    blocks: DataFrame
    groups: DataFrame
    top: DataFrame | None
    ends: DataFrame
    leaf: tuple[str, str] = ("lo", "hi")
    node: tuple[str, str] = ("lo", "hi")

    def on_close(self) -> "TouchIndex":
        """The same bars, searched by their close alone."""
        return replace(self, leaf=("close", "close"), node=("close_lo", "close_hi"))


def touch_index(
    bars: DataFrame,
    keys: tuple[str, ...] = ("epic",),
    low: str = "l",
    high: str = "h",
    close: str = "c",
) -> TouchIndex:
    """Pack indexed bars for searches."""
    named = bars.select(
        *keys,
        "idx",
        F.col(low).cast("double").alias("lo"),
        F.col(high).cast("double").alias("hi"),
        F.col(close).cast("double").alias("close"),
        F.col("end_ts").alias("ts"),
    )
    blocks = named.groupBy(*keys, F.expr(f"idx div {BLOCK}").alias("_part")).agg(
        F.expr("sort_array(collect_list(struct(idx AS at, lo, hi, close, ts)))").alias("_items")
    )
    blocks, last_block = materialize_with(blocks, F.max("_part"))
    spans = blocks.selectExpr(
        *keys, "_part AS at", "array_min(_items.lo) AS lo", "array_max(_items.hi) AS hi",
        "array_min(_items.close) AS close_lo", "array_max(_items.close) AS close_hi",
    )
    groups = _packed(spans, keys, F.expr(f"at div {BLOCK}"))
    top = None
    if (last_block or 0) >= BLOCK:
        spans = groups.selectExpr(
            *keys, "_part AS at", "array_min(_items.lo) AS lo", "array_max(_items.hi) AS hi",
            "array_min(_items.close_lo) AS close_lo", "array_max(_items.close_hi) AS close_hi",
        )
        top = _packed(spans, keys).withColumn("_part", F.expr(f"explode(sequence(0L, {SALTS - 1}L))"))
    last = F.max_by(F.element_at("_items", -1), "_part")
    ends = blocks.groupBy(*keys).agg(last.alias("_bar")).selectExpr(
        *keys, "struct(_bar.at AS idx, _bar.close AS close, _bar.ts AS ts) AS _end"
    )
    return TouchIndex(keys, blocks, groups, top, ends)


def _packed(spans: DataFrame, keys: tuple[str, ...], part: Column | None = None) -> DataFrame:
    items = F.expr("sort_array(collect_list(struct(at, lo, hi, close_lo, close_hi)))").alias("_items")
    return spans.groupBy(*keys, *([] if part is None else [part.alias("_part")])).agg(items)


def _lookup(
    events: DataFrame, packed: DataFrame, keys: tuple[str, ...], want: str, found: dict[str, str]
) -> DataFrame:
    """Left-join each event to the packed row ``want`` of its series and add the ``found`` columns.

    Where ``want`` is null the event needs nothing: it gets a negative key, spread over many values
    so that such events match no row and do not pile up in one partition.
    """
    key = f"coalesce({want}, -1 - pmod(xxhash64({', '.join(keys)}, _from), 9973)) AS _part"
    joined = events.selectExpr("*", key).join(packed, [*keys, "_part"], "left")
    kept = [c for c in events.columns if c not in found]
    return joined.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in found.items()])


def _first(legs: tuple[str, str], after: str | None = None) -> str:
    """SQL: the first packed item past ``after`` that reaches the low or the high level."""
    later = f"x.at > {after} AND " if after else ""
    touch = f"(x.{legs[0]} <= _lo_level OR x.{legs[1]} >= _hi_level)"
    return f"try_element_at(filter(_items, x -> {later}{touch}), 1)"


def first_touch(events: DataFrame, index: TouchIndex, start: str, lo_level: str, hi_level: str) -> DataFrame:
    """Add ``touch`` (at, lo, hi, close, ts): the first bar after ``start`` with low at or below the
    low level or high at or above the high level (both given as SQL). Null where no bar ever does,
    or where ``start`` is null (a finished event). A null or NaN level is never reached."""
    keys = index.keys
    levels = [
        f"nanvl(CAST({sql} AS DOUBLE), CAST(NULL AS DOUBLE)) AS {name}"
        for name, sql in (("_lo_level", lo_level), ("_hi_level", hi_level))
    ]
    work = events.selectExpr("*", f"CAST({start} AS BIGINT) AS _from", *levels)
    blk, grp = f"_from div {BLOCK}", f"_from div {BLOCK * BLOCK}"
    # Up: the event's own block, the later blocks of its group, the later groups of the series.
    work = _lookup(work, index.blocks, keys, blk, {"touch": _first(index.leaf, "_from")})
    work = _lookup(
        work, index.groups, keys, f"CASE WHEN touch IS NULL THEN {grp} END", {"_hit_blk": _first(index.node, blk) + ".at"}
    )
    if index.top is not None:
        # One row per series: it is repeated per salt, so a series with many events is spread.
        salt = f"pmod(xxhash64(_from), {SALTS})"
        wanted = f"CASE WHEN touch IS NULL AND _hit_blk IS NULL AND _from IS NOT NULL THEN {salt} END"
        work = _lookup(work, index.top, keys, wanted, {"_hit_grp": _first(index.node, grp) + ".at"})
        # Down: the group, then the block.
        work = _lookup(
            work, index.groups, keys, "_hit_grp", {"_hit_blk": f"coalesce(_hit_blk, {_first(index.node)}.at)"}
        )
        work = work.drop("_hit_grp")
    work = _lookup(work, index.blocks, keys, "_hit_blk", {"touch": f"coalesce(touch, {_first(index.leaf)})"})
    return work.drop("_from", "_lo_level", "_hi_level", "_hit_blk")


def bar_at(events: DataFrame, index: TouchIndex, at: str, name: str) -> DataFrame:
    """Add the packed bar with index ``at`` (null where ``at`` is null or past the end)."""
    work = events.selectExpr("*", f"CAST({at} AS BIGINT) AS _from")
    found = "try_element_at(filter(_items, x -> x.at = _from), 1)"
    return _lookup(work, index.blocks, index.keys, f"_from div {BLOCK}", {name: found}).drop("_from")


def last_bar(events: DataFrame, index: TouchIndex, name: str = "last") -> DataFrame:
    """Add the last bar (idx, close, ts) of the event's series."""
    return join_per_key(events, index.ends.withColumnRenamed("_end", name), list(index.keys), "left")


def ladder_outcomes(events: DataFrame, index: TouchIndex, rounds: int) -> DataFrame:
    """Scale-out outcome of each event against the bars after its entry bar.

    Events carry ``direction``, ``entry_idx``, ``entry_price``, ``stop_dist``, ``ladder`` (array of
    fraction and dist, ascending), ``ratchet`` and ``max_holding_bars``; ``rounds`` is the longest
    ladder. Each round finds the next bar that reaches the current stop or the next tier, so bars
    in between are never fetched. A bar that reaches the stop banks no tier; several tiers may bank
    on one bar; a moved stop counts from the next bar; the time limit comes after both.
    """
    if rounds < 1:
        raise ValueError("a ladder needs at least one tier")
    fill = "idx: bigint, price: double, fraction: double, reason: string"
    state = {
        "_long": "direction = 'LONG'",
        "_sign": "CASE WHEN direction = 'LONG' THEN 1D ELSE -1D END",
        "_n": "0",
        "_at": "CAST(entry_idx AS BIGINT)",
        "_left": "1D",
        "_fills": f"CAST(array() AS array<struct<{fill}>>)",
        "_exit_ts": "CAST(NULL AS TIMESTAMP)",
        "_done": "false",
        "_limit": "CASE WHEN max_holding_bars > 0 THEN CAST(entry_idx + max_holding_bars AS BIGINT) END",
    }
    work = _with(events, {**state, "_stop": "entry_price - _sign * stop_dist"})
    kept = work.columns
    tier = "entry_price + _sign * try_element_at(ladder, _n + 1).dist"
    for _ in range(rounds):
        work = first_touch(
            work,
            index,
            "_at",
            f"CASE WHEN _long THEN _stop ELSE {tier} END",
            f"CASE WHEN _long THEN {tier} ELSE _stop END",
        )
        work = _with(
            work,
            {
                "_live": "coalesce(touch.at <= coalesce(_limit, touch.at), false)",
                "_stopped": "_live AND CASE WHEN _long THEN touch.lo <= _stop ELSE touch.hi >= _stop END",
                "_banked": "_live AND NOT _stopped",
                "_reached": """CASE WHEN _long
                    THEN size(filter(ladder, t -> touch.hi >= entry_price + t.dist))
                    ELSE size(filter(ladder, t -> touch.lo <= entry_price - t.dist)) END""",
                "_m": "CASE WHEN _banked THEN greatest(_n, _reached) ELSE _n END",
                "_taken": "slice(ladder, _n + 1, _m - _n)",
            },
        )
        work = _with(
            work,
            {
                "_fills": f"""CASE
                    WHEN _stopped THEN concat(_fills, array(CAST(
                        struct(touch.at, _stop, _left, 'STOP') AS struct<{fill}>)))
                    WHEN _banked THEN concat(_fills, transform(_taken, t -> CAST(
                        struct(touch.at, entry_price + _sign * t.dist, t.fraction, 'TARGET') AS struct<{fill}>)))
                    ELSE _fills END""",
                "_left": """CASE WHEN _banked
                    THEN aggregate(_taken, _left, (acc, t) -> acc - t.fraction) ELSE _left END""",
                "_exit_ts": "CASE WHEN _live THEN touch.ts ELSE _exit_ts END",
                "_done": "_done OR _stopped OR (_banked AND _m >= size(ladder))",
                # Null ends the search: finished, or nothing is reached within the limit.
                "_at": "CASE WHEN _banked AND _m < size(ladder) THEN touch.at END",
                "_stop": """CASE
                    WHEN NOT _banked THEN _stop
                    WHEN ratchet = 'BREAKEVEN_AFTER_T1' AND _m >= 2 THEN entry_price + _sign * ladder[0].dist
                    WHEN ratchet = 'BREAKEVEN_AFTER_T1' AND _m >= 1 THEN entry_price
                    WHEN ratchet = 'LAGGED' AND _m >= 2 THEN entry_price
                    ELSE _stop END""",
                "_n": "_m",
            },
        ).select(*kept)

    work = last_bar(work, index)
    time_idx = "CASE WHEN NOT _done AND _limit <= last.idx THEN _limit END"
    work = bar_at(work, index, time_idx, "_timed")
    return _with(
        work,
        {
            "fills": f"""CASE
                WHEN _done THEN _fills
                WHEN _timed IS NOT NULL THEN concat(_fills, array(CAST(
                    struct(_timed.at, _timed.close, _left, 'TIME') AS struct<{fill}>)))
                WHEN _left > 0 THEN concat(_fills, array(CAST(
                    struct(last.idx, last.close, _left, 'END') AS struct<{fill}>)))
                ELSE _fills END""",
            "exit_ts": "CASE WHEN _done THEN _exit_ts ELSE coalesce(_timed.ts, last.ts) END",
            "tiers_filled": "_n",
            "exit_idx": "element_at(fills, -1).idx",
            "exit_reason": "element_at(fills, -1).reason",
            "exit_price": "aggregate(fills, 0D, (acc, f) -> acc + f.fraction * f.price)",
            "hit_t1": "tiers_filled >= 1",
        },
    ).drop(*state, "_stop", "_timed", "last")


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace SQL columns in one projection; a new column may use those listed before it,
    while the name of a replaced one means its old value."""
    kept = [c for c in df.columns if c not in columns]
    return df.selectExpr(*kept, *[f"{sql} AS {name}" for name, sql in columns.items()])


def bracket_outcomes(events: DataFrame, index: TouchIndex) -> DataFrame:
    """One stop and one target (``stop_dist``, ``target_dist``): a one-tier ladder."""
    ladder = F.array(F.struct(F.lit(1.0).alias("fraction"), F.col("target_dist").alias("dist")))
    one = events.withColumns({"ladder": ladder, "ratchet": F.lit("NONE")})
    return ladder_outcomes(one, index, rounds=1).drop("ladder", "ratchet")


def pnl_columns(work: DataFrame) -> DataFrame:
    """Signed pnl, R-multiple (risk falls back to the ATR, and to 0 when that is 0) and win flag."""
    risk = "CASE WHEN stop_dist = 0 THEN entry_atr ELSE stop_dist END"
    sign = "CASE WHEN direction = 'LONG' THEN 1D ELSE -1D END"
    return _with(
        work,
        {
            "pnl": f"({sign}) * (exit_price - entry_price)",
            "r_multiple": f"coalesce(try_divide(pnl, {risk}), 0D)",
            "is_win": "pnl > 0",
        },
    )


def legacy_reason(exit_idx: Column, last_idx: Column, pnl: Column) -> Column:
    """Reason of a close-based exit: END at the last bar, else by the sign of the pnl."""
    return F.when(exit_idx >= last_idx, "END").when(pnl > 0, "TARGET").otherwise("STOP")


def close_based_exit(events: DataFrame, close_index: TouchIndex, moving: bool = False) -> DataFrame:
    """Add ``gate_idx``: the first later bar whose close is beyond the stop or target, or the end
    of the holding limit, whichever is first. Null while the position never closes.

    ``close_index`` is a touch index searched by the close alone (:meth:`TouchIndex.on_close`). With
    ``moving`` it holds series that already contain the distances and are compared with the entry price.
    """
    sign = "CASE WHEN direction = 'LONG' THEN 1D ELSE -1D END"
    work = _with(
        events,
        {
            "_stop": "entry_price" if moving else f"entry_price - ({sign}) * stop_dist",
            "_target": "entry_price" if moving else f"entry_price + ({sign}) * target_dist",
            "_limit": "CASE WHEN max_holding_bars > 0 THEN CAST(entry_idx + max_holding_bars AS BIGINT) END",
        },
    )
    work = first_touch(
        work,
        close_index,
        "entry_idx",
        "CASE WHEN direction = 'LONG' THEN _stop ELSE _target END",
        "CASE WHEN direction = 'LONG' THEN _target ELSE _stop END",
    )
    work = last_bar(work, close_index)
    # The exit is filled on the bar after, which must exist.
    gate = "CASE WHEN least(touch.at, _limit) < last.idx THEN least(touch.at, _limit) END"
    return _with(work, {"gate_idx": gate}).drop("touch", "last", "_stop", "_target", "_limit")


def select_non_overlapping(events: DataFrame, keys: list[str], at: str, free: str) -> DataFrame:
    """Keep the first event of each key, skip those before its ``free`` position, and so on.

    Positions are cut into chunks. What a chunk does is a table from the position that is free when it
    is entered to the one that is free when it is left, with one step per run of equal results
    (:func:`jump_table`). One pass over the tables of a key, in order and with a single number as
    state, gives the entry of every chunk; then all chunks pick their events side by side. Events
    themselves never leave their chunk, so a key with very many of them is spread, and nothing
    depends on how long they block each other. A null ``free`` means never free again. Of events at
    the same position the one that is free first counts, ties by a hash of their other columns.
    """
    never = F.lit(NEVER).cast("long")
    slim = events.groupBy(*keys, F.col(at).cast("long").alias("_s")).agg(F.min(F.coalesce(F.col(free).cast("long"), never)).alias("_f"))
    chunk = F.floor(F.col("_s") / CHUNK).cast("long").alias("_chunk")
    named = [T.StructField(f"_k{i}", events.schema[k].dataType) for i, k in enumerate(keys)]
    own = [f.name for f in named]
    dealt = slim.select(*[F.col(k).alias(o) for k, o in zip(keys, own)], chunk, "_s", "_f")
    dealt = dealt.repartition(*own, "_chunk").sortWithinPartitions(*own, "_chunk", "_s")
    longs = T.ArrayType(T.LongType())
    head = [*named, T.StructField("_chunk", T.LongType())]
    arrays = [T.StructField(c, longs) for c in ("_s", "_f", "_enter", "_leave")]
    tables = materialize(dealt.mapInArrow(_pack_chunks, T.StructType([*head, *arrays])))
    ordered = tables.select(*own, "_chunk", "_enter", "_leave").repartition(*own).sortWithinPartitions(*own, "_chunk")
    entries = ordered.mapInArrow(_enter_chunks, T.StructType([*head, T.StructField("_x", T.LongType())]))
    met = tables.select(*own, "_chunk", "_s", "_f").join(entries, [*own, "_chunk"])
    kept = met.select(*own, "_s", "_f", "_x").mapInArrow(_pick, T.StructType([*named, T.StructField("_s", T.LongType())]))
    kept = kept.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], F.col("_s").alias(at))
    chosen = events.join(kept, [*keys, at], "left_semi")
    others = F.xxhash64(*[c for c, kind in events.dtypes if "map<" not in kind])
    place = Window.partitionBy(*keys, at).orderBy(F.coalesce(F.col(free), never), others)
    return chosen.withColumn("_tie", F.row_number().over(place)).where("_tie = 1").drop("_tie")


def jump_table(s: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(enter, leave) of a chunk with events at the ascending positions ``s`` that are free at ``f``:
    who comes with a position up to ``enter`` leaves with ``leave``; beyond the last one the chunk
    changes nothing. Entries with one result are one step."""
    last = len(s)
    after = np.maximum(np.searchsorted(s, f), np.arange(1, last + 1)).tolist()
    leave = f.tolist()
    for i in range(last - 1, -1, -1):
        if after[i] < last:
            leave[i] = leave[after[i]]
    leave = np.array(leave, dtype=np.int64)
    ends = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))
    return s[ends], leave[ends]


def picked(s: np.ndarray, f: np.ndarray, enter: int) -> np.ndarray:
    """Positions that are kept of a chunk which is entered with a free position."""
    out, i = [], int(np.searchsorted(s, enter))
    while i < len(s):
        out.append(i)
        i = max(int(np.searchsorted(s, f[i])), i + 1)
    return s[out]


def _lists(values: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets, offsets[1:])]


def _named(batch: pa.RecordBatch) -> list[str]:
    return [name for name in batch.schema.names if name.startswith("_k")]


def _pack_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (key, chunk) with its events and its jump table, from rows sorted by position."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        cuts = _changes(whole, [*_named(whole), "_chunk"])
        # The last run may go on in the next batch.
        yield from _packed_rows(whole, cuts[:-1])
        held = [whole.slice(cuts[-2])]
    if held:
        yield from _packed_rows(held[0], [0, held[0].num_rows])


def _changes(batch: pa.RecordBatch, names: list[str]) -> list[int]:
    """Starts of the runs of equal rows, and the end."""
    rows = list(zip(*(batch.column(n).to_pylist() for n in names)))
    return [0, *(i for i in range(1, len(rows)) if rows[i] != rows[i - 1]), len(rows)]


def _packed_rows(batch: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
    if len(cuts) < 2:
        return
    s, f = batch.column("_s").to_numpy(), batch.column("_f").to_numpy()
    spans = list(zip(cuts, cuts[1:]))
    tables = [jump_table(s[a:b], f[a:b]) for a, b in spans]
    names = [*_named(batch), "_chunk"]
    heads = batch.select(names).take(pa.array(cuts[:-1]))
    parts = [_lists([s[a:b] for a, b in spans]), _lists([f[a:b] for a, b in spans]), *(_lists(list(c)) for c in zip(*tables))]
    yield pa.RecordBatch.from_arrays([*heads.columns, *parts], [*names, "_s", "_f", "_enter", "_leave"])


def _enter_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The free position at the entry of every chunk, from tables sorted by key and chunk."""
    key, free = None, 0
    for batch in batches:
        names = _named(batch)
        out = []
        for mine, enter, leave in zip(zip(*(batch.column(n).to_pylist() for n in names)), _arrays(batch.column("_enter")), _arrays(batch.column("_leave"))):
            if mine != key:
                key, free = mine, -NEVER
            out.append(free)
            step = int(np.searchsorted(enter, free))
            if step < len(enter):
                free = int(leave[step])
        columns = [*batch.select([*names, "_chunk"]).columns, pa.array(out, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "_chunk", "_x"])


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = _named(batch)
        kept = [picked(s, f, x) for s, f, x in zip(_arrays(batch.column("_s")), _arrays(batch.column("_f")), batch.column("_x").to_pylist())]
        rows = np.repeat(np.arange(batch.num_rows), [len(k) for k in kept])
        heads = batch.select(names).take(pa.array(rows, pa.int64()))
        positions = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(positions, pa.int64())], [*names, "_s"])
