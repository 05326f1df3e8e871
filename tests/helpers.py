"""Small event logs for tests."""

import datetime as dt
import random

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
KINDS = ("purchase", "view", "click", "signup", "error")


def event_rows(seed, users, each, start="2024-01-01"):
    rng = random.Random(seed)
    begin = dt.datetime.fromisoformat(start)
    rows = []
    for k in range(users * each):
        at = begin + dt.timedelta(minutes=37 * k + rng.randrange(30))
        rows.append((k + 1, at, k % users, rng.choice(KINDS), rng.random() * 100, f'{{"k": {rng.randrange(100)}}}'))
    return rows


def events(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
