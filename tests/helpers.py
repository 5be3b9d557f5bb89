"""Small inputs for the tests."""

import datetime as dt
import random

START = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
BAR_SCHEMA = "epic string, idx long, end_ts timestamp, o double, h double, l double, c double, volume double"


def bar(epic, idx, high, low, close, open_=None, volume=1.0):
    at = START + dt.timedelta(minutes=5 * idx)
    return (epic, idx, at, float(close if open_ is None else open_), float(high), float(low), float(close), volume)


def random_bars(n, epic="X", seed=1):
    rng = random.Random(seed)
    rows, price = [], 100.0
    for i in range(n):
        open_ = price
        price = max(1.0, price + rng.uniform(-2, 2))
        high = max(open_, price) + rng.uniform(0, 1)
        low = min(open_, price) - rng.uniform(0, 1)
        rows.append(bar(epic, i, high, low, price, open_, rng.randint(1, 100) * 1.0))
    return rows
