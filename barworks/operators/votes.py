"""Votes, gates and entry signals of many arms as bits over the indicator frame.

Every vote and gate is a list of comparisons between indicator values. The distinct ones of all arms
are rows of a list that one expression runs over, so a bar gets one bit per predicate whatever their
number. Arms are rows too: a trigger holds the bits of its votes and gates and the score it needs.
Bars with equal bits share their answer, so triggers meet distinct bit patterns and not bars, and the
hits come back to the bars by an equality join. The plan does not grow with the number of arms.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barworks.operators.features import FEATURE_TERMS, feature_row, feature_sql
from barworks.plans.arms import Arm, check_arms, first_of_config, table_of
from barworks.session import materialize

LONG, SHORT = "LONG", "SHORT"
WORD = 63  # predicates in a word of bits
CHUNK = 64  # triggers in a row that a bit pattern meets
ZERO, ONE = "0D", "1D"
LARGEST = "double('Infinity')"  # NaN is above it
# A user vote: a name and a predicate (SQL text) per (arm, is_long) over the indicator frame.
Vote = tuple[str, Callable[[Arm, bool], str]]


@dataclass(frozen=True)
class Compare:
    """``left - minus`` against ``right + factor * unit``; false where a side is NaN or null."""

    left: str
    op: str
    right: str = ZERO
    factor: float = 0.0
    unit: str = ONE
    minus: str = ZERO

    def sql(self) -> str:
        mine = self.left if self.minus == ZERO else f"abs({self.left} - {self.minus})"
        reach = f"({self.factor}D * {self.unit})"
        other = self.right if not self.factor else reach if self.right == ZERO else f"({self.right} + {reach})"
        return f"coalesce({mine} {self.op} {other} AND NOT isnan({mine}) AND NOT isnan({other}), false)"


Rule = tuple[Compare, ...]


def sql_of(rule: Rule) -> str:
    return " AND ".join(c.sql() for c in rule) or "true"


def _rsi_band(arm: Arm, is_long: bool) -> Rule:
    rsi, mid, dev = f"rsi_{arm.rsi_period}", f"bb_mid_{arm.bb_period}", f"bb_dev_{arm.bb_period}"
    if is_long:
        return Compare(rsi, "<", factor=arm.rsi_oversold), Compare("c", "<=", mid, -arm.bb_multiplier, dev)
    return Compare(rsi, ">", factor=arm.rsi_overbought), Compare("c", ">=", mid, arm.bb_multiplier, dev)


def _flag(sql: str) -> Rule:
    """A condition over the frame as a rule."""
    return (Compare(f"CAST(coalesce({sql}, false) AS DOUBLE)", ">"),)


def _candle(arm: Arm, is_long: bool) -> Rule:
    if is_long:
        return _flag("bullish_engulfing OR bullish_harami OR hammer")
    return _flag("bearish_engulfing OR bearish_harami OR shooting_star")


def _near_level(arm: Arm, is_long: bool) -> Rule:
    level = f"{'lowest' if is_long else 'highest'}_{max(1, arm.swing_lookback_bars)}"
    return (Compare("c", "<", factor=arm.proximity_atr, unit=f"atr_{arm.atr_period}", minus=level),)


def _structure(arm: Arm, is_long: bool) -> Rule:
    n = max(1, arm.swing_lookback_bars)
    return (Compare("c", ">", f"prior_high_{n}"),) if is_long else (Compare("c", "<", f"prior_low_{n}"),)


def _volume_trend(arm: Arm, is_long: bool) -> Rule:
    side = ">" if is_long else "<"
    return Compare("volume", ">", f"volume_sma_{arm.volume_sma_period}"), Compare("c", side, f"ema_{arm.ema_period}")


def rules_of(arm: Arm, is_long: bool, extra: list[Vote] | None = None) -> list[tuple[str, Rule]]:
    """The enabled votes of an arm in vote order, then the user's own."""
    chosen = [("RSI+BB", _rsi_band)]
    if arm.enable_candles:
        chosen.append(("Candle", _candle))
    if arm.enable_support_resistance:
        chosen.append(("S/R", _near_level))
    if arm.enable_structure:
        chosen.append(("Structure", _structure))
    if arm.enable_volume_trend:
        chosen.append(("Vol+Trend", _volume_trend))
    own = [(name, _flag(vote(arm, is_long))) for name, vote in extra or []]
    return [(name, rule(arm, is_long)) for name, rule in chosen] + own


def gate_of(arm: Arm, is_long: bool) -> Rule:
    """Right side of the trend EMA, and not beyond the proximity ceiling when one is set."""
    if arm.trend_ema_period <= 0:
        return ()
    ema, toward, away = f"ema_{arm.trend_ema_period}", *((">", "<") if is_long else ("<", ">"))
    side = (Compare("c", toward, ema),)
    if arm.trend_ema_max_atr <= 0:
        return side
    reach = arm.trend_ema_max_atr if is_long else -arm.trend_ema_max_atr
    return *side, Compare("c", away, ema, reach, f"atr_{arm.atr_period}")


def votes_of(arm: Arm, is_long: bool, extra: list[Vote] | None = None) -> list[tuple[str, str]]:
    """Names and conditions (SQL text) of the votes of one arm."""
    return [(name, sql_of(rule)) for name, rule in rules_of(arm, is_long, extra)]


def score(votes: list[tuple[str, str]]) -> str:
    """SQL: number of votes that hold."""
    return " + ".join(f"CAST(({rule}) AS INT)" for _, rule in votes)


def trend_gate(arm: Arm, is_long: bool) -> str:
    return sql_of(gate_of(arm, is_long))


class Terms:
    """Numeric columns that rows of arms refer to by their place in one array."""

    def __init__(self):
        self.place: dict[str, int] = {}

    def at(self, sql: str) -> int:
        return self.place.setdefault(sql, len(self.place))

    def sql(self) -> str:
        return "array(" + ", ".join(f"CAST({sql} AS DOUBLE)" for sql in self.place) + ")"


@dataclass
class Bits:
    """Distinct rules of all arms; each has a word and a bit in it."""

    terms: Terms
    place: dict[tuple[Rule, int], int] = field(default_factory=dict)

    def at(self, rule: Rule, copy: int = 0) -> int:
        return self.place.setdefault((rule, copy), len(self.place))

    def words(self) -> int:
        return -(-len(self.place) // WORD)

    def sql(self, values: str) -> str:
        """SQL: the words of bits of a bar, from the array of its values. The rules are one constant."""
        words = [[] for _ in range(self.words())]
        for (rule, _), at in self.place.items():
            compared = [
                {"l": self.terms.at(c.left), "m": self.terms.at(c.minus), "r": self.terms.at(c.right), "u": self.terms.at(c.unit),
                 "f": c.factor, "sign": 1.0 if c.op[0] == ">" else -1.0, "same": c.op.endswith("=")}
                for c in rule
            ]
            words[at // WORD].append({"bit": 1 << at % WORD, "all": compared})
        schema = "array<array<struct<bit: bigint, all: array<struct<l: int, m: int, r: int, u: int, f: double, sign: double, same: boolean>>>>>"
        mine = f"(get({values}, c.l) - get({values}, c.m))"
        mine = f"(CASE WHEN c.m = {self.terms.at(ZERO)} THEN get({values}, c.l) ELSE abs({mine}) END)"
        gap = f"(c.sign * ({mine} - (get({values}, c.r) + c.f * get({values}, c.u))))"
        # A gap that is NaN or null is no number above or at zero.
        holds = f"coalesce(CASE WHEN c.same THEN {gap} BETWEEN 0D AND {LARGEST} ELSE {gap} > 0D AND {gap} <= {LARGEST} END, false)"
        each = f"aggregate(w, 0L, (bits, p) -> bits | CASE WHEN forall(p.all, c -> {holds}) THEN p.bit ELSE 0L END)"
        return f"transform(from_json('{json.dumps(words)}', '{schema}'), w -> {each})"


TRIGGER = "chunk int, triggers array<struct<trigger: int, least: int, gates: array<bigint>, votes: array<bigint>>>"


def _masks(bits: Bits, places: list[int]) -> list[int]:
    words = [0] * bits.words()
    for at in places:
        words[at // WORD] |= 1 << at % WORD
    return words


def pattern_hits(patterns: DataFrame, triggers: list[dict], bits: Bits) -> DataFrame:
    """(bits, hits): the triggers that fire on each distinct pattern of bits, none of them left out.

    A trigger fires where all its gates hold and the number of its votes that hold reaches ``least``.
    Triggers come in chunks of rows, so their number bounds no task.
    """
    rows = []
    for start in range(0, len(triggers), CHUNK):
        some = [
            {"trigger": t["trigger"], "least": t["least"], "gates": _masks(bits, t["gates"]), "votes": _masks(bits, [v["at"] for v in t["votes"]])}
            for t in triggers[start : start + CHUNK]
        ]
        rows.append({"chunk": start // CHUNK, "triggers": some})
    chunks = table_of(patterns.sparkSession, rows, TRIGGER)
    holds = "forall(zip_with(bits, t.gates, (b, g) -> b & g = g), x -> x)"
    score_of = "aggregate(zip_with(bits, t.votes, (b, v) -> bit_count(b & v)), 0, (n, x) -> n + x)"
    met = patterns.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(len(rows) - 1)))).join(chunks, "chunk")
    found = met.selectExpr("bits", f"transform(filter(triggers, t -> {holds} AND {score_of} >= t.least), t -> t.trigger) AS some").where("size(some) > 0")
    return found.groupBy("bits").agg(F.flatten(F.collect_list("some")).alias("hits"))


ENTRY = (
    "trigger int, entry_id int, direction string, atr_period int, atr_at int, next_atr_at int, regime_at int, stop_atr double, "
    "target_atr double, max_holding_bars int, votes array<struct<name: string, word: int, bit: bigint>>, "
    + ", ".join(f"{name} int" for name in FEATURE_TERMS) + ", band_factor double"
)


def signals(
    frame: DataFrame,
    arms: list[Arm],
    entry_fill: str = "next_close",
    extra: list[Vote] | None = None,
) -> DataFrame:
    """Entry signals of all arms and both directions.

    Arms that differ only in their exit ladder share one set of entries (``entry_id`` is the first
    such arm), and entry configs that differ only in exits share their triggers. Bars on which some
    vote holds are written once with their bits; a bar yields the configs that fire on it and is
    never multiplied by arms.
    """
    if entry_fill not in ("next_close", "next_open"):
        raise ValueError("entry_fill must be 'next_close' or 'next_open'")
    check_arms(arms)
    terms = Terms()
    terms.at(ZERO), terms.at(ONE)
    bits = Bits(terms)
    regimes: dict[str, int] = {}
    triggers: dict[str, dict] = {}
    entries = []
    for entry_id in sorted(set(first_of_config(arms))):
        arm = arms[entry_id]
        for is_long in (True, False):
            if not (arm.enable_long if is_long else arm.enable_short):
                continue
            rules = rules_of(arm, is_long, extra)
            votes = []
            for i, (name, rule) in enumerate(rules):
                # Two votes of one arm with the same rule are two votes.
                copy = sum(rule == other for _, other in rules[:i])
                votes.append({"name": name, "at": bits.at(rule, copy)})
            warm = (Compare("idx", ">=", factor=float(arm.warm_up)),)
            gates = [bits.at((c,)) for c in (*warm, *gate_of(arm, is_long))]
            need = {"least": arm.confluence_threshold, "gates": gates, "votes": votes}
            known = triggers.setdefault(json.dumps([need, is_long]), need | {"trigger": len(triggers)})
            entries.append(
                {"trigger": known["trigger"], "entry_id": entry_id, "direction": LONG if is_long else SHORT, "atr_period": arm.atr_period,
                 "atr_at": terms.at(f"atr_{arm.atr_period}"), "next_atr_at": terms.at(f"next_atr_{arm.atr_period}"),
                 "regime_at": regimes.setdefault(f"next_regime_{arm.atr_period}", len(regimes)), "stop_atr": arm.stop_atr,
                 "target_atr": arm.target_atr, "max_holding_bars": arm.max_holding_bars,
                 "votes": [{"name": v["name"], "word": v["at"] // WORD, "bit": 1 << v["at"] % WORD} for v in votes],
                 **feature_row(arm, terms.at)}
            )
    if not entries:
        raise ValueError("every direction of every arm is switched off")

    price = "next_c" if entry_fill == "next_close" else "next_o"
    words = bits.sql("v")  # names the last terms
    coded = materialize(
        frame.where("next_end_ts IS NOT NULL")
        .selectExpr(
            "epic", "idx AS signal_idx", "idx + 1 AS entry_idx", "next_end_ts AS entry_ts", f"{price} AS entry_price",
            f"{terms.sql()} AS v", f"array({', '.join(regimes)}) AS regimes",
        )
        .selectExpr("*", f"{words} AS bits")
    )
    hits = pattern_hits(coded.select("bits").distinct(), list(triggers.values()), bits)
    fired = coded.join(hits, "bits").withColumn("trigger", F.explode("hits")).drop("hits")
    held = "filter(votes, x -> get(bits, x.word) & x.bit <> 0L)"
    return (
        fired.join(table_of(frame.sparkSession, entries, ENTRY), "trigger")
        .selectExpr("*", f"transform({held}, x -> x.name) AS reasons")
        .selectExpr(
            "epic", "signal_idx", "entry_idx", "entry_ts", "entry_price", "entry_id", "direction", "atr_period",
            "get(v, next_atr_at) AS entry_atr", "get(regimes, regime_at) AS volatility_regime", "stop_atr", "target_atr",
            "max_holding_bars", "reasons", f"{feature_sql('v', 'size(reasons)', 'entry_ts')} AS features",
        )
    )
