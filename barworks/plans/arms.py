"""Arms: one parameter set each. Arms are rows, so a grid is one job."""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import asdict, dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

RATCHETS = ("NONE", "BREAKEVEN_AFTER_T1", "LAGGED")


@dataclass(frozen=True)
class Tier:
    fraction: float
    target_atr: float


@dataclass(frozen=True)
class Arm:
    """The defaults are the tuned index profile."""

    name: str = "base"
    rsi_period: int = 7
    rsi_smooth_period: int = 7
    bb_period: int = 20
    bb_multiplier: float = 2.0
    ema_period: int = 50
    atr_period: int = 14
    rsi_oversold: float = 25.0
    rsi_overbought: float = 75.0
    stop_atr: float = 3.0
    target_atr: float = 0.75
    max_holding_bars: int = 0
    trend_ema_period: int = 200
    trend_ema_max_atr: float = 0.0
    confluence_threshold: int = 3
    proximity_atr: float = 0.5
    swing_lookback_bars: int = 10
    volume_sma_period: int = 20
    enable_candles: bool = True
    enable_support_resistance: bool = True
    enable_structure: bool = False
    enable_volume_trend: bool = True
    enable_long: bool = True
    enable_short: bool = False
    tiers: tuple[Tier, ...] = ()
    ratchet: str = "NONE"

    @property
    def warm_up(self) -> int:
        return max(self.ema_period, self.trend_ema_period)

    @property
    def exit_ladder(self) -> tuple[Tier, ...]:
        return self.tiers or (Tier(1.0, self.target_atr),)

    @property
    def entry_config(self) -> str:
        """Canonical text of everything but the name and the exit ladder.

        Stop, target and holding limit stay in: they decide when the next entry may come.
        """
        fields = asdict(self)
        for name in ("name", "tiers", "ratchet"):
            del fields[name]
        return json.dumps(fields, sort_keys=True)

    @property
    def config_json(self) -> str:
        fields = asdict(self)
        del fields["name"]
        return json.dumps(fields, sort_keys=True)


def variant(base: Arm, name: str, **overrides) -> Arm:
    return replace(base, name=name, **overrides)


def ladder_faults(arm: Arm) -> list[str]:
    """What would mis-size the trades of a ladder, as texts; none for an empty ladder."""
    fractions = [t.fraction for t in arm.tiers]
    targets = [t.target_atr for t in arm.tiers]
    rules = {
        f"unknown ratchet {arm.ratchet}": arm.ratchet in RATCHETS,
        "tier fractions must be positive numbers": all(0 < f < math.inf for f in fractions),
        "tier targets must be finite and ascending": all(map(math.isfinite, targets)) and targets == sorted(set(targets)),
        "tier fractions must sum to 1": not fractions or abs(sum(fractions) - 1) <= 1e-6,
    }
    return [text for text, holds in rules.items() if not holds]


def check_ladder(arm: Arm) -> None:
    """Raise on a faulty ladder. Fractions are never renormalised."""
    faults = ladder_faults(arm)
    if faults:
        raise ValueError(f"{arm.name}: {'; '.join(faults)}")


def check_arms(arms: list[Arm]) -> list[Arm]:
    if not arms:
        raise ValueError("no arms given")
    names = [a.name for a in arms]
    if len(set(names)) != len(names):
        raise ValueError("arm names must be unique")
    for arm in arms:
        check_ladder(arm)
    return arms


# The named arms, each with every value it pins over whatever base is given. Ceilings of
# the distance to the trend average and ladders of thirds follow as products of the lists below.
PREGATE = {
    "confluence_threshold": 3, "enable_structure": False, "enable_long": True, "enable_short": True, "trend_ema_period": 0,
}
PROMOTED = PREGATE | {
    "enable_short": False, "proximity_atr": 0.5, "swing_lookback_bars": 10, "stop_atr": 3.0, "target_atr": 0.75,
    "trend_ema_period": 200,
}
NAMED_ARMS = {
    "i1_baseline_th2_struct": {
        "confluence_threshold": 2, "enable_structure": True, "enable_short": True,
        "trend_ema_period": 0, "stop_atr": 1.5, "target_atr": 3.0,
    },
    "i3_pregate_winchamp_stop4.0_tgt0.5": PREGATE | {
        "proximity_atr": 0.5, "swing_lookback_bars": 8, "stop_atr": 4.0, "target_atr": 0.5,
    },
    "i3_pregate_expchamp_stop3.0_tgt0.75": PREGATE | {
        "proximity_atr": 0.5, "swing_lookback_bars": 10, "stop_atr": 3.0, "target_atr": 0.75,
    },
    "final_longOnly_trend200": PROMOTED,
}
CEILINGS = (1.0, 1.5, 2.0, 2.5, 3.0)
CONTROL, CONTROL_CEILING = "control_singleTarget_0.75", 3.0
FIRST_TARGETS, LAST_TARGETS = (0.75, 1.5), (2.0, 3.0, 4.0)


def thirds(last: float) -> tuple[Tier, ...]:
    return tuple(Tier(1 / 3, target) for target in (*FIRST_TARGETS, last))


def reference_grid(base: Arm = Arm()) -> list[Arm]:
    """The 19 arms: 4 milestones, 5 proximity ceilings, 1 control, 9 ladders."""
    table = dict(NAMED_ARMS)
    table.update({f"emaCeil_{c:.1f}atr": PROMOTED | {"trend_ema_max_atr": c} for c in CEILINGS})
    table[CONTROL] = PROMOTED | {"trend_ema_max_atr": CONTROL_CEILING}
    for last, ratchet in itertools.product(LAST_TARGETS, RATCHETS):
        table[f"tier3_t3-{last:.1f}_{ratchet.lower()}"] = table[CONTROL] | {"tiers": thirds(last), "ratchet": ratchet}
    return check_arms([variant(base, name, **overrides) for name, overrides in table.items()])


def table_of(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """Rows of the driver as a local relation, so that the optimizer knows their size."""
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(StructType.fromDDL(schema))))


def arms_frame(spark: SparkSession, arms: list[Arm]) -> DataFrame:
    """One row per arm, for joins, hashes and the experiment table."""
    rows = [
        {
            "arm_id": i,
            "label": a.name,
            "config_json": a.config_json,
            "entry_config": a.entry_config,
            "ladder": [{"fraction": t.fraction, "target_atr": t.target_atr} for t in a.exit_ladder],
            "ratchet": a.ratchet,
        }
        for i, a in enumerate(check_arms(arms))
    ]
    schema = (
        "arm_id int, label string, config_json string, entry_config string, "
        "ladder array<struct<fraction: double, target_atr: double>>, ratchet string"
    )
    return table_of(spark, rows, schema)


def first_of_config(arms: list[Arm]) -> list[int]:
    """For every arm the first one with the same entries."""
    first: dict[str, int] = {}
    return [first.setdefault(arm.entry_config, i) for i, arm in enumerate(arms)]


def config_hash(
    config_json: Column, instrument: Column, timeframe_min: Column, start_iso: Column, end_iso: Column
) -> Column:
    """First 12 hex digits of SHA-256 over config, instrument, timeframe and window."""
    text = F.concat_ws("|", config_json, instrument, timeframe_min.cast("string"), start_iso, end_iso)
    return F.substring(F.sha2(text, 256), 1, 12)
