"""Small frames for tests."""

from __future__ import annotations

import datetime as dt

DAY = dt.timedelta(days=1)
GOLD_SCHEMA = "item_code string, date date, quantity_sold double, return_quantity double, avg_unit_price double"
DAILY_SCHEMA = "item_code string, date date, sales_qty double, return_qty double, profit double"


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def feature_gold(spark, plant: float | None = None):
    """Two items, 70 days; ``plant`` overwrites the first item's quantity on 2025-03-05."""
    rows = []
    for item in ("SKU-A", "SKU-B"):
        for i in range(70):
            date = day("2025-01-01") + i * DAY
            quantity = float(i % 5)
            if plant is not None and item == "SKU-A" and date == day("2025-03-05"):
                quantity = plant
            rows.append((item, date, quantity, 1.0 if i == 5 else 0.0, 10.0 + i))
    return spark.createDataFrame(rows, GOLD_SCHEMA)


def forecast_gold(spark, items, days: int = 90, last: str = "2025-09-05"):
    rows = []
    for s, item in enumerate(items):
        for i in range(days):
            date = day(last) - (days - 1 - i) * DAY
            rows.append((item, date, float((i + 3 * s) % 7), 0.0, 100.0 + s))
    return spark.createDataFrame(rows, GOLD_SCHEMA)


def daily_rows(spark, series: dict[str, dict[str, float]], profit: float = 1.0):
    """Sparse daily sales from {item: {day: quantity}}."""
    rows = [
        (item, day(date), float(quantity), 0.0, profit * quantity)
        for item, values in series.items()
        for date, quantity in values.items()
    ]
    return spark.createDataFrame(rows, DAILY_SCHEMA)


def by(frame, *keys):
    """Rows of a small frame as dicts, keyed by one or more columns."""
    out = {}
    for row in frame.collect():
        key = tuple(row[k] for k in keys)
        out[key[0] if len(key) == 1 else key] = row.asDict()
    return out
