"""DuckDB SQL of the registered queries, written the plain dense way: cross-joined panels, per-day windows.

The Spark side mostly works from sparse rows, so equal results check the closed forms too.
"""

from __future__ import annotations

from shelfcast.config import (
    CALENDAR_COLUMNS,
    DIRECT_COLUMNS,
    HISTORY_COLUMNS,
    LAG_DAYS,
    ORIGIN_LAGS,
    ORIGIN_WINDOWS,
    RAW_FIELD_NAMES,
    STATIC_COLUMNS,
)
from shelfcast.contract.queries import (
    DIGITS,
    DIRECT,
    EARLIER_END,
    ENDED_SINCE,
    EXPANDING,
    LAGS,
    LAST_DATE,
    PRICES,
    ROLLING,
    RULES,
    TIE_SHIFT,
    TOP,
    TRAIN_END,
)

CUT = f"DATE '{TRAIN_END}'"


def rounded(sql: str, *doubles: str) -> str:
    """``sql`` (a full WITH statement) with its double columns rounded."""
    replaced = ", ".join(f"round({c} + {TIE_SHIFT}, {DIGITS}) + 0.0e0 AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS q"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# -- shared relations -----------------------------------------------------------------------------------


def cents(amount: str) -> str:
    return f"CAST(floor(abs({amount}) * 100 + 0.5e0) AS BIGINT)"


def tx(grain: str = "brand") -> str:
    item = "upper(replace(p_brand, '#', '-'))" if grain == "brand" else (
        "'SKU-' || lpad(CAST(l_partkey AS VARCHAR), CAST(greatest(5, length(CAST(l_partkey AS VARCHAR))) AS INTEGER), '0')"
    )
    return f"""tx AS (
  SELECT CAST(l_shipdate AS DATE) AS date, l_orderkey AS stt, {item} AS item_code,
    sgn * CAST(l_quantity AS BIGINT) AS quantity,
    {cents('l_extendedprice / l_quantity')} / 100e0 AS unit_price,
    sgn * ({cents('l_extendedprice * (1 - l_discount)')} / 100e0) AS sales_amount,
    {cents('p_retailprice')} / 100e0 AS unit_cost,
    sgn * ({cents('l_quantity * p_retailprice')} / 100e0) AS cost_amount,
    l_linenumber, l_tax, l_discount
  FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sgn FROM lineitem)
  JOIN part ON l_partkey = p_partkey)"""


def vn_text(amount: str) -> str:
    whole = f"replace(format('{{:,}}', {cents(amount)} // 100), ',', '.')"
    return (
        f"(CASE WHEN {amount} < 0 THEN '-' ELSE '' END || {whole} || ',' || "
        f"lpad(CAST({cents(amount)} % 100 AS VARCHAR), 2, '0'))"
    )


def text(faults: bool = True) -> str:
    day, item, price = "strftime(date, '%Y-%m-%d')", "' ' || lower(item_code) || ' '", vn_text("unit_price")
    if faults:
        day = f"CASE WHEN l_linenumber = 7 THEN strftime(date, '%d/%m/%Y') ELSE {day} END"
        item = f"CASE WHEN l_tax > 0.075 THEN '  ' ELSE {item} END"
        price = f"CASE WHEN l_discount > 0.095 THEN 'n/a' ELSE {price} END"
    return f"""file AS (SELECT {day} AS date_raw, stt, {item} AS item_code_raw, CAST(quantity AS VARCHAR) AS quantity_raw,
    {price} AS unit_price_raw, {vn_text('sales_amount')} AS sales_amount_raw, {vn_text('unit_cost')} AS unit_cost_raw,
    {vn_text('cost_amount')} AS cost_amount_raw FROM tx)"""


def vn(column: str) -> str:
    return f"TRY_CAST(replace(replace({column}, '.', ''), ',', '.') AS DOUBLE)"


TYPED = f"""typed AS (SELECT stt AS source_row_number,
    CAST(TRY_STRPTIME(date_raw, '%Y-%m-%d') AS DATE) AS date,
    nullif(upper(replace(item_code_raw, ' ', '')), '') AS item_code,
    {vn('quantity_raw')} AS quantity, {vn('unit_price_raw')} AS unit_price, {vn('sales_amount_raw')} AS sales_amount,
    {vn('unit_cost_raw')} AS unit_cost, {vn('cost_amount_raw')} AS cost_amount FROM file)"""
SILVER = """silver AS (SELECT source_row_number, date, item_code, quantity, greatest(quantity, 0e0) AS sales_quantity,
    greatest(-quantity, 0e0) AS return_quantity, unit_price, sales_amount, unit_cost, cost_amount,
    quantity < 0 AS is_return, error_reason IS NULL AS is_valid, error_reason
  FROM (SELECT *, nullif(concat_ws(';', CASE WHEN date IS NULL THEN 'invalid_date' END,
    CASE WHEN item_code IS NULL THEN 'missing_item_code' END, CASE WHEN quantity IS NULL THEN 'invalid_quantity' END,
    CASE WHEN unit_price IS NULL THEN 'invalid_unit_price' END,
    CASE WHEN sales_amount IS NULL THEN 'invalid_sales_amount' END,
    CASE WHEN unit_cost IS NULL THEN 'invalid_unit_cost' END,
    CASE WHEN cost_amount IS NULL THEN 'invalid_cost_amount' END), '') AS error_reason FROM typed))"""


def from_text(faults: bool = True) -> tuple[str, ...]:
    return tx(), text(faults), TYPED, SILVER


GOLD_AGGREGATES = """sum(sales_quantity) AS quantity_sold, sum(return_quantity) AS return_quantity,
    sum(quantity) AS net_quantity, sum(sales_amount) AS sales_amount, sum(cost_amount) AS cost_amount,
    avg(unit_price) AS avg_unit_price, avg(unit_cost) AS avg_unit_cost, count(*) AS transaction_count"""
GOLD = f"""gold AS (SELECT date, item_code, {GOLD_AGGREGATES}
  FROM (SELECT date, item_code, CAST(quantity AS DOUBLE) AS quantity, greatest(CAST(quantity AS DOUBLE), 0) AS sales_quantity,
    greatest(-CAST(quantity AS DOUBLE), 0) AS return_quantity, unit_price, unit_cost, sales_amount, cost_amount FROM tx)
  GROUP BY date, item_code)"""
GOLD_DOUBLES = ["quantity_sold", "return_quantity", "net_quantity", "sales_amount", "cost_amount", "avg_unit_price", "avg_unit_cost"]
STRICT = """strict AS (SELECT *, quantity < 0 AND sales_amount < 0 AND cost_amount < 0 AS is_return,
    CAST(greatest(quantity, 0) AS DOUBLE) AS sales_qty,
    CAST(CASE WHEN quantity < 0 AND sales_amount < 0 AND cost_amount < 0 THEN -quantity ELSE 0 END AS DOUBLE) AS return_qty,
    CAST(quantity AS DOUBLE) AS net_qty, sales_amount - cost_amount AS profit
  FROM (SELECT date, stt, item_code, quantity, unit_price, sales_amount, unit_cost, cost_amount FROM tx))"""
DAILY = """daily AS (SELECT date, item_code, sum(sales_qty) AS sales_qty, sum(return_qty) AS return_qty, sum(net_qty) AS net_qty,
    sum(sales_amount) AS sales_amount, sum(cost_amount) AS cost_amount, sum(profit) AS profit, count(*) AS line_count
  FROM strict GROUP BY date, item_code)"""
DAILY_DOUBLES = ["sales_qty", "return_qty", "net_qty", "sales_amount", "cost_amount", "profit"]
# Dense demand of every item over all days.
DEMAND = """demand AS (SELECT i.item_code, d.date, coalesce(s.sales_qty, 0e0) AS qty
  FROM (SELECT DISTINCT item_code FROM daily) i
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM daily) d
  LEFT JOIN daily s ON s.item_code = i.item_code AND s.date = d.date)"""


def daily(grain: str = "brand") -> tuple[str, ...]:
    return tx(grain), STRICT, DAILY


def profile(cut: str = CUT) -> str:
    return f"""profile AS (SELECT item_code, total_sales_qty, active_days, 1 - active_days / n AS zero_ratio,
    total_sales_qty / n AS avg_daily_qty,
    coalesce(total_sales_qty / nullif(active_days, 0), 0) AS avg_qty_when_active, total_profit,
    greatest(total_profit, 0) AS positive_profit,
    coalesce(greatest(total_profit, 0) / nullif(sum(greatest(total_profit, 0)) OVER (), 0), 0) AS profit_weight, return_qty,
    coalesce(return_qty / nullif(total_sales_qty, 0), 0) AS return_ratio, last_sale_date,
    CAST(coalesce(datediff('day', last_sale_date, last_day), 9999) AS INTEGER) AS days_since_last_sale
  FROM (SELECT item_code, coalesce(sum(sales_qty) FILTER (date <= {cut}), 0) AS total_sales_qty,
      CAST(count(*) FILTER (date <= {cut} AND sales_qty > 0) AS INTEGER) AS active_days,
      coalesce(sum(profit) FILTER (date <= {cut}), 0) AS total_profit,
      coalesce(sum(return_qty) FILTER (date <= {cut}), 0) AS return_qty,
      max(date) FILTER (date <= {cut} AND sales_qty > 0) AS last_sale_date
    FROM daily GROUP BY item_code)
  CROSS JOIN (SELECT least({cut}, max(date)) AS last_day, datediff('day', min(date), least({cut}, max(date))) + 1 AS n FROM daily))"""


PROFILE_DOUBLES = [
    "total_sales_qty", "zero_ratio", "avg_daily_qty", "avg_qty_when_active", "total_profit", "positive_profit",
    "profit_weight", "return_qty", "return_ratio",
]


def top_volume(n: int, name: str = "top") -> str:
    return f"""{name} AS (SELECT item_code, sum(quantity_sold) AS total_quantity FROM gold GROUP BY item_code
  ORDER BY total_quantity DESC, item_code LIMIT {n})"""


PANEL = """kept AS (SELECT * FROM gold WHERE item_code IN (SELECT item_code FROM top)),
panel AS (SELECT i.item_code, d.date, coalesce(k.quantity_sold, 0e0) AS quantity_sold,
    coalesce(k.return_quantity, 0e0) AS return_quantity, k.avg_unit_price
  FROM (SELECT DISTINCT item_code FROM kept) i
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM kept) d
  LEFT JOIN kept k ON k.item_code = i.item_code AND k.date = d.date)"""


def inference_panel(cut: str, lookback: int) -> str:
    return f"""active AS (SELECT DISTINCT item_code FROM gold
  WHERE date >= (SELECT max(date) FROM gold) - {lookback - 1}),
kept AS (SELECT * FROM gold WHERE item_code IN (SELECT item_code FROM active) AND date BETWEEN {cut} - {lookback - 1} AND {cut}),
panel AS (SELECT i.item_code, d.date, coalesce(k.quantity_sold, 0e0) AS quantity_sold,
    coalesce(k.return_quantity, 0e0) AS return_quantity, k.avg_unit_price
  FROM active i
  CROSS JOIN (SELECT CAST(unnest(generate_series(min(date), {cut}, INTERVAL 1 DAY)) AS DATE) AS date FROM kept) d
  LEFT JOIN kept k ON k.item_code = i.item_code AND k.date = d.date)"""


def history() -> tuple[str, ...]:
    lags = ", ".join(f"lag(quantity_sold, {k}, 0e0) OVER w AS lag_{k}" for k in LAG_DAYS)
    over = {n: f"OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 14, 28, 56)}
    so_far = "OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rolling = ", ".join(f"avg(h) {over[n]} AS rolling_mean_{n}" for n in over)
    rolling += "".join(
        f", coalesce(stddev_samp(h) {over[n]}, 0) AS rolling_std_{n}, sum(h) {over[n]} AS rolling_sum_{n}" for n in (7, 28)
    )
    return (
        f"""shifted AS (SELECT *, lag(quantity_sold, 1, 0e0) OVER w AS h, lag(return_quantity, 1, 0e0) OVER w AS rh, {lags},
    last_value(avg_unit_price IGNORE NULLS) {so_far} AS known,
    min(CASE WHEN quantity_sold > 0 THEN date END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sku_first_sale_date
  FROM panel WINDOW w AS (PARTITION BY item_code ORDER BY date))""",
        f"""rolled AS (SELECT * EXCLUDE (avg_unit_price), {rolling}, min(h) {over[28]} AS rolling_min_28, max(h) {over[28]} AS rolling_max_28,
    avg(h) {so_far} AS sku_avg_sales, quantile_cont(h, 0.5) {so_far} AS sku_median_sales,
    coalesce(stddev_samp(h) {so_far}, 0) AS sku_sales_std, sum(h) {so_far} AS sku_total_sales,
    avg(CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END) {so_far} AS sku_nonzero_sales_ratio,
    coalesce(sum(rh) {so_far} / nullif(sum(h) {so_far} + sum(rh) {so_far}, 0), 0) AS sku_return_rate,
    CAST(coalesce(datediff('day', sku_first_sale_date, date), 0) AS INTEGER) AS sku_lifecycle_days,
    lag(known, 1) OVER w AS avg_unit_price, lag(known, 2) OVER w AS lag_price_1
  FROM shifted WINDOW w AS (PARTITION BY item_code ORDER BY date))""",
        f"""priced AS (SELECT *, avg(avg_unit_price) {over[7]} AS rolling_price_mean_7, avg(avg_unit_price) {over[28]} AS rolling_price_mean_28
  FROM rolled WINDOW w AS (PARTITION BY item_code ORDER BY date))""",
        """hist AS (SELECT *, coalesce(avg_unit_price / nullif(lag_price_1, 0) - 1, 0) AS price_change_rate,
    coalesce(avg_unit_price / nullif(rolling_price_mean_28, 0) - 1, 0) AS discount_proxy FROM priced)""",
    )


HISTORY_DOUBLES = [c for c in HISTORY_COLUMNS if c != "sku_lifecycle_days"]


def calendar(day: str = "target_date") -> str:
    return f"""CAST(isodow({day}) - 1 AS INTEGER) AS day_of_week, CAST(day({day}) AS INTEGER) AS day_of_month,
    CAST(week({day}) AS INTEGER) AS week_of_year, CAST(month({day}) AS INTEGER) AS month,
    CAST(quarter({day}) AS INTEGER) AS quarter, isodow({day}) >= 6 AS is_weekend, day({day}) = 1 AS is_month_start,
    {day} = last_day({day}) AS is_month_end"""


def training(top: int = TOP, anchors: int = 60, horizon: int = 56) -> tuple[str, ...]:
    return (
        tx(),
        GOLD,
        top_volume(top),
        PANEL,
        *history(),
        f"""frame AS (SELECT 'v1' AS feature_version, a.date AS as_of_date, a.item_code, CAST(g.h AS INTEGER) AS horizon,
    CAST(a.date + CAST(g.h AS INTEGER) AS DATE) AS target_date, coalesce(t.quantity_sold, 0) AS target_quantity,
    {calendar('CAST(a.date + CAST(g.h AS INTEGER) AS DATE)')}, {', '.join('a.' + c for c in HISTORY_COLUMNS)}, a.sku_first_sale_date
  FROM hist a CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS h) g
  CROSS JOIN (SELECT max(date) - {horizon} AS cutoff FROM panel) b
  LEFT JOIN panel t ON t.item_code = a.item_code AND t.date = a.date + CAST(g.h AS INTEGER)
  WHERE a.date BETWEEN b.cutoff - {anchors - 1} AND b.cutoff)""",
    )


def inference(horizon: int) -> str:
    return f"""inference AS (SELECT {CUT} AS forecast_date, item_code, {CUT} AS as_of_date,
    CAST({CUT} + CAST(ahead AS INTEGER) AS DATE) AS target_date, CAST(ahead AS INTEGER) AS horizon,
    {calendar(f'CAST({CUT} + CAST(ahead AS INTEGER) AS DATE)')}, {', '.join(HISTORY_COLUMNS)}
  FROM hist CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS ahead) WHERE date = {CUT})"""


def baselines(cut: str = CUT, name: str = "base", horizon: int = 56) -> tuple[str, ...]:
    """All baselines of every item after a cut, from the dense demand."""
    return (
        f"""{name}_past AS (SELECT * FROM demand WHERE date <= {cut})""",
        f"""{name}_stats AS (SELECT item_code,
    avg(qty) FILTER (date > {cut} - 28) AS mean_28, avg(qty) FILTER (date > {cut} - 56) AS mean_56,
    quantile_cont(qty, 0.5) FILTER (date > {cut} - 56) AS median_56, count(*) FILTER (qty > 0) AS active,
    coalesce(datediff('day', max(date) FILTER (qty > 0), {cut}), 9999) AS unsold
  FROM {name}_past GROUP BY item_code)""",
        f"""{name} AS (SELECT s.item_code, CAST({cut} + CAST(g.h AS INTEGER) AS DATE) AS target_date, CAST(g.h AS INTEGER) AS horizon,
    0e0 AS zero, mean_28, mean_56, median_56, coalesce(w.same_weekday, 0) AS same_weekday_8w,
    median_56 * (CASE WHEN active <= 2 THEN 0.15e0 WHEN active <= 5 THEN 0.35e0 WHEN active <= 15 THEN 0.65e0 ELSE 1e0 END)
      * (CASE WHEN unsold > 180 THEN 0.05e0 WHEN unsold > 90 THEN 0.35e0 WHEN unsold > 56 THEN 0.7e0 ELSE 1e0 END) AS conservative_sparse,
    mean_28 * 0.45e0 + mean_56 * 0.25e0 + coalesce(w.same_weekday, 0) * 0.30e0 AS blend_mean_weekday
  FROM {name}_stats s CROSS JOIN (SELECT unnest(generate_series(1, {horizon})) AS h) g
  LEFT JOIN (SELECT p.item_code, h2.h, avg(p.qty) AS same_weekday FROM {name}_past p
      JOIN (SELECT unnest(generate_series(1, {horizon})) AS h) h2
        ON (CAST({cut} + CAST(h2.h AS INTEGER) AS DATE) - p.date) % 7 = 0
        AND CAST({cut} + CAST(h2.h AS INTEGER) AS DATE) - p.date <= 56
      GROUP BY p.item_code, h2.h) w ON w.item_code = s.item_code AND w.h = g.h)""",
    )


def scale(cut: str = CUT, name: str = "scale") -> str:
    """Dense RMSSE scale: squared day-to-day changes from the first sale on."""
    return f"""{name} AS (SELECT item_code, greatest(CASE WHEN avg(change) > 0 THEN avg(change) ELSE 1e0 END, 1e-9) AS rmsse_denom
  FROM (SELECT item_code, CASE WHEN lag(seen) OVER w THEN (qty - lag(qty) OVER w) ** 2 END AS change
    FROM (SELECT *, bool_or(qty > 0) OVER (PARTITION BY item_code ORDER BY date) AS seen FROM demand WHERE date <= {cut})
    WINDOW w AS (PARTITION BY item_code ORDER BY date)) GROUP BY item_code)"""


def scores(model: str, cut: str = CUT, name: str = "scores") -> str:
    """Weighted scaled errors of one column of ``base`` over 56 days."""
    return f"""{name} AS (SELECT item_code, w / sum(w) OVER () AS weight, rmsse_denom AS denom, mse,
    sqrt(mse / rmsse_denom) AS rmsse, w / sum(w) OVER () * sqrt(mse / rmsse_denom) AS weighted_rmsse
  FROM (SELECT d.item_code, avg((b.{model} - d.qty) ** 2) AS mse FROM demand d
    JOIN base b ON b.item_code = d.item_code AND b.target_date = d.date GROUP BY d.item_code)
  JOIN scale USING (item_code) JOIN (SELECT item_code, profit_weight AS w FROM profile) USING (item_code))"""


MODELS = ["zero", "mean_28", "mean_56", "median_56", "same_weekday_8w", "conservative_sparse", "blend_mean_weekday"]


def backtest(grain: str) -> str:
    folds = {n: f"(DATE '{LAST_DATE}' - {56 + 28 * (3 - n)})" for n in (1, 2, 3)}
    ctes, parts = [*daily(grain), DEMAND], []
    for n, cut in folds.items():
        cut_date = f"CAST({cut} AS DATE)"
        ctes += [*baselines(cut_date, f"b{n}"), scale(cut_date, f"s{n}")]
        ctes.append(f"""w{n} AS (SELECT item_code, greatest(coalesce(sum(profit) FILTER (date <= {cut_date}), 0), 0) AS w FROM daily GROUP BY item_code)""")
        for model in MODELS:
            def total(column: str) -> str:
                return f"coalesce(sum(w * sqrt({column} / rmsse_denom)) / nullif(sum(w), 0), 0)"

            parts.append(f"""SELECT {n} AS fold, {cut_date} AS train_end, CAST({cut_date} + 1 AS DATE) AS valid_start,
  CAST({cut_date} + 56 AS DATE) AS valid_end, '{model}' AS model, {total('m28')} AS wrmsse_28, {total('m56')} AS wrmsse_56
FROM (SELECT d.item_code, avg((b.{model} - d.qty) ** 2) FILTER (horizon <= 28) AS m28, avg((b.{model} - d.qty) ** 2) AS m56
  FROM demand d JOIN b{n} b ON b.item_code = d.item_code AND b.target_date = d.date GROUP BY d.item_code)
JOIN s{n} USING (item_code) JOIN w{n} USING (item_code)""")
    return with_(*ctes) + "\nUNION ALL\n".join(parts)


METRICS = {
    "mae": "avg(abs(target_quantity - p))",
    "rmse": "sqrt(avg((target_quantity - p) ** 2))",
    "wape": "sum(abs(target_quantity - p)) / greatest(sum(abs(target_quantity)), 1e-9)",
    "smape": "avg(CASE WHEN abs(target_quantity) + abs(p) > 0 THEN 2 * abs(target_quantity - p) / (abs(target_quantity) + abs(p)) ELSE 0 END)",
}
FRAME_MODELS = {"naive_last_value": "lag_1", "seasonal_naive_lag_7": "lag_7", "moving_average_28": "rolling_mean_28"}
VALIDATION = "validation AS (SELECT * FROM frame WHERE target_date >= (SELECT max(target_date) - 27 FROM frame))"
SPEED = """grouped AS (SELECT *, CASE WHEN ntile(2) OVER (ORDER BY sku_avg_sales, target_date, item_code, horizon, as_of_date) = 1
    THEN 'slow_moving' ELSE 'fast_moving' END AS sku_group FROM validation)"""


def frame_metrics(by: str = "", source: str = "validation") -> str:
    group, select = (f" GROUP BY {by}", f"{by}, ") if by else ("", "")
    metrics = ", ".join(f"{sql} AS {name}" for name, sql in METRICS.items())
    return "\nUNION ALL\n".join(
        f"SELECT {select}'{model}' AS model, {metrics} FROM (SELECT *, greatest({column}, 0) AS p FROM {source}){group}"
        for model, column in FRAME_MODELS.items()
    )


# -- post-processing and serving ------------------------------------------------------------------------


def reference() -> tuple[str, ...]:
    rules = ", ".join(
        f"('{r.item_code}', {r.alpha}e0, {r.n}, '{r.stat}', {str(r.month_factor).lower()}, {str(r.trend).lower()})" for r in RULES
    )
    return (
        f"rules AS (SELECT * FROM (VALUES {rules}) AS r(item_code, alpha, n, stat, month_factor, trend))",
        f"""series AS (SELECT d.*, isodow(date) - 1 AS dow, month(date) AS mon, r.* EXCLUDE (item_code)
  FROM demand d JOIN rules r USING (item_code) WHERE date <= {CUT})""",
        """aged AS (SELECT *, row_number() OVER (PARTITION BY item_code, dow ORDER BY date DESC) AS age FROM series)""",
        """dows AS (SELECT item_code, dow, avg(qty) AS mean_qty, median(qty) AS median_qty FROM aged WHERE age <= n GROUP BY item_code, dow)""",
        """months AS (SELECT item_code, mon, avg(qty) AS month_mean FROM series WHERE date >= DATE '1998-01-01' AND dow <> 6 GROUP BY item_code, mon)""",
        f"""levels AS (SELECT item_code, avg(qty) FILTER (date >= DATE '1998-01-01' AND dow <> 6) AS open_mean,
    avg(qty) FILTER (date > {CUT} - 56) AS recent, avg(qty) FILTER (date <= {CUT} - 56 AND date > {CUT} - 112) AS previous
  FROM series GROUP BY item_code)""",
        f"""reference AS (SELECT r.item_code, target_date, horizon, alpha,
    CASE WHEN isodow(target_date) = 7 THEN 0e0 ELSE greatest((CASE WHEN stat = 'mean' THEN mean_qty ELSE median_qty END)
      * (CASE WHEN month_factor AND month_mean IS NOT NULL THEN (month_mean + 1) / (open_mean + 1) ELSE 1e0 END)
      * (CASE WHEN trend THEN (recent + 1) / (previous + 1) ELSE 1e0 END), 0) END AS reference
  FROM rules r JOIN levels USING (item_code)
  CROSS JOIN (SELECT CAST(h AS INTEGER) AS horizon, CAST({CUT} + CAST(h AS INTEGER) AS DATE) AS target_date FROM (SELECT unnest(generate_series(1, 56)) AS h))
  LEFT JOIN dows ON dows.item_code = r.item_code AND dows.dow = isodow(target_date) - 1
  LEFT JOIN months ON months.item_code = r.item_code AND months.mon = month(target_date))""",
    )


def hybrid(grain: str, lookback: int, modelled: int) -> tuple[str, ...]:
    return (
        tx(grain),
        GOLD,
        top_volume(modelled),
        inference_panel(CUT, lookback),
        *history(),
        inference(56),
        """hybrid AS (SELECT forecast_date, item_code, target_date, horizon,
    CASE WHEN item_code IN (SELECT item_code FROM top) THEN greatest(rolling_mean_28, 0) ELSE greatest(lag_7, 0) END AS predicted_quantity,
    CASE WHEN item_code IN (SELECT item_code FROM top) THEN 'gbt' ELSE 'seasonal_naive_lag_7' END AS prediction_source FROM inference)""",
    )


HYBRID = hybrid("brand", 730, 10)


def runs() -> tuple[str, ...]:
    rows = "\nUNION ALL\n".join(
        f"SELECT 'run-{day}' AS run_id, DATE '{day}' AS forecast_date, item_code, target_date, horizon, same_weekday_8w AS predicted_quantity FROM {name}"
        for day, name in ((EARLIER_END, "early"), (TRAIN_END, "base"))
    )
    return (
        *daily(),
        DEMAND,
        *baselines(f"DATE '{EARLIER_END}'", "early"),
        *baselines(),
        f"forecasts AS ({rows})",
        """runs AS (SELECT run_id, forecast_date, 'same_weekday' AS model_name, 'success' AS status, count(*) AS row_count,
    CAST(forecast_date AS TIMESTAMP) AS started_at, CAST(forecast_date AS TIMESTAMP) + INTERVAL 1 HOUR AS finished_at
  FROM forecasts GROUP BY run_id, forecast_date
  UNION ALL SELECT 'run-failed', max(forecast_date), 'same_weekday', 'failed', NULL, max(forecast_date), max(forecast_date) + INTERVAL 1 DAY FROM forecasts)""",
        "latest AS (SELECT * FROM runs WHERE status = 'success' ORDER BY finished_at DESC NULLS LAST, started_at DESC LIMIT 1)",
        "rows_of AS (SELECT * FROM forecasts WHERE run_id = (SELECT run_id FROM latest))",
    )


# -- direct models --------------------------------------------------------------------------------------

CHOSEN = f"chosen AS (SELECT *, CAST(row_number() OVER (ORDER BY profit_weight DESC, item_code) - 1 AS INTEGER) AS item_id FROM profile ORDER BY profit_weight DESC, item_code LIMIT {DIRECT.top_n})"


def origins() -> tuple[str, ...]:
    lags = ", ".join(f"coalesce(lag(qty, {k}) OVER w, 0e0) AS lag_{k}" for k in ORIGIN_LAGS)
    stats = ", ".join(
        f"coalesce({f}(qty) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 0e0) AS {name}_{n}"
        for n in ORIGIN_WINDOWS
        for f, name in (("avg", "mean"), ("max", "max"))
    )
    active = ", ".join(
        f"CAST(count(CASE WHEN qty > 0 THEN 1 END) OVER (w ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS DOUBLE) AS active_{n}"
        for n in ORIGIN_WINDOWS
    )
    return (
        f"""long_demand AS (SELECT item_code, date, qty FROM demand WHERE date <= {CUT} AND item_code IN (SELECT item_code FROM chosen)
  UNION ALL SELECT item_code, CAST({CUT} + 1 AS DATE), 0e0 FROM chosen)""",
        f"""featured AS (SELECT item_code, date AS origin_date, row_number() OVER w - 1 AS pos, {lags}, {stats}, {active},
    CAST(coalesce(datediff('day', max(CASE WHEN qty > 0 THEN date END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), date) - 1, 9999) AS DOUBLE) AS days_since_last_sale,
    CAST(isodow(date) - 1 AS INTEGER) AS origin_dow, CAST(month(date) AS INTEGER) AS origin_month
  FROM long_demand WINDOW w AS (PARTITION BY item_code ORDER BY date))""",
    )


def direct_rows(offset: int = 0, grain: str = "brand") -> tuple[str, ...]:
    return (
        *daily(grain),
        DEMAND,
        profile(),
        CHOSEN,
        *origins(),
        f"""bounds AS MATERIALIZED (SELECT greatest(364, datediff('day', min(date), {CUT} - {DIRECT.origin_lookback_days})) AS lo,
    datediff('day', min(date), {CUT} - {offset}) AS hi FROM daily)""",
        # The few origins first; only then their horizons.
        f"""picked AS MATERIALIZED (SELECT f.* FROM featured f, bounds
  WHERE f.pos BETWEEN lo AND hi AND (f.pos - lo) % {DIRECT.origin_stride} = 0)""",
        f"""targets AS MATERIALIZED (SELECT item_code, date AS target_date, qty AS target FROM demand
  WHERE date <= {CUT} AND item_code IN (SELECT item_code FROM chosen))""",
        """direct AS MATERIALIZED (SELECT p.*, CAST(datediff('day', p.origin_date, t.target_date) + 1 AS INTEGER) AS horizon, t.target_date, t.target
  FROM picked p JOIN targets t ON t.item_code = p.item_code AND t.target_date BETWEEN p.origin_date AND p.origin_date + 55)""",
    )


def recursion() -> tuple[str, ...]:
    """Days after the cut, one by one: the median of the last 56 days, which the new day then joins."""
    return (
        f"""begun AS (SELECT item_code, list(qty ORDER BY date) FILTER (date > {CUT} - 56) AS recent,
    coalesce(sum(qty) FILTER (date >= DATE '{ENDED_SINCE}'), 0e0) AS sold
  FROM demand WHERE date <= {CUT} GROUP BY item_code)""",
        f"""rolled AS (SELECT item_code, CAST(0 AS INTEGER) AS place, CAST(0 AS DOUBLE) AS yhat, recent, sold FROM begun
  UNION ALL
  SELECT item_code, place + 1, y, list_append(recent[2:], y), sold + y
  FROM (SELECT *, CASE WHEN isodow(CAST({CUT} + place + 1 AS DATE)) = 7 OR sold = 0 THEN 0e0
      ELSE greatest(list_aggregate(recent, 'median'), 0e0) END AS y FROM rolled WHERE place < {DIRECT.horizon}))""",
    )


TARGET_CALENDAR = """CAST(isodow(target_date) - 1 AS INTEGER) AS target_dow, CAST(day(target_date) AS INTEGER) AS target_day,
  CAST(month(target_date) AS INTEGER) AS target_month, CAST(week(target_date) AS INTEGER) AS target_week"""
ORIGIN_COLUMNS = [f"lag_{k}" for k in ORIGIN_LAGS] + [f"{s}_{n}" for n in ORIGIN_WINDOWS for s in ("mean", "max", "active")]

ALPHA_GRID = """SELECT a AS alpha, sum(profit_weight * sqrt(mse / rmsse_denom)) / sum(profit_weight) AS wrmsse_56
FROM (SELECT a, b.item_code, avg(({model} - d.qty) ** 2) AS mse
  FROM base b JOIN demand d ON d.item_code = b.item_code AND d.date = b.target_date
  CROSS JOIN (SELECT unnest(generate_series(0, 20)) / 20e0 AS a) GROUP BY a, b.item_code)
JOIN scale USING (item_code) JOIN profile USING (item_code) GROUP BY a"""
DIRECT_DOUBLES = [*ORIGIN_COLUMNS, "days_since_last_sale", *[c for c in STATIC_COLUMNS if c != "active_days"]]
SAMPLE_WEIGHTS = """sample_weights AS (SELECT item_code, greatest(raw / avg(CASE WHEN raw > 0 THEN raw END) OVER (), 0) AS sample_weight
FROM (SELECT item_code, profit_weight / rmsse_denom AS raw FROM chosen JOIN scale USING (item_code)))"""
DIRECT_JOINED = f"""(SELECT d.* EXCLUDE (pos), item_id, {', '.join(STATIC_COLUMNS)}, sample_weight, {TARGET_CALENDAR}
  FROM direct d JOIN chosen c USING (item_code) JOIN sample_weights w USING (item_code))"""


def root_split() -> tuple[str, ...]:
    """Gradients of the Poisson loss at the mean, summed over every feature and bin, and the gain of every border."""
    names = ", ".join(f"'{c}'" for c in DIRECT_COLUMNS)
    values = ", ".join(f"CAST({c} AS DOUBLE)" for c in DIRECT_COLUMNS)
    shares = ", ".join(repr(i / 64) for i in range(1, 64))
    part = lambda g, h: f"{g} * {g} / ({h} + 2e0)"
    return (
        f"sold AS MATERIALIZED (SELECT * FROM {DIRECT_JOINED} WHERE target > 0 AND sample_weight > 0)",
        "mean AS (SELECT sum(sample_weight * target) / sum(sample_weight) AS mu FROM sold)",
        f"""derived AS (SELECT [{values}] AS x, CAST(round(sample_weight * (mu - target) * 1048576e0) AS HUGEINT) AS g,
    CAST(round(sample_weight * mu * 1048576e0) AS HUGEINT) AS h FROM sold, mean)""",
        f"""long AS MATERIALIZED (SELECT unnest(range({len(DIRECT_COLUMNS)})) AS i, unnest(x) AS x, unnest([{names}]) AS feature, g, h FROM derived)""",
        f"borders AS (SELECT i, list_sort(list_distinct(quantile_disc(x, [{shares}]))) AS cuts FROM long GROUP BY i)",
        """binned AS (SELECT i, feature, cuts, len(list_filter(cuts, lambda c: c < x)) AS bin, sum(g) AS g, sum(h) AS h, count(*) AS n
  FROM long JOIN borders USING (i) GROUP BY ALL)""",
        """summed AS (SELECT i, feature, cuts, bin, CAST(sum(g) OVER upto AS DOUBLE) / 1048576e0 AS g_left, CAST(sum(h) OVER upto AS DOUBLE) / 1048576e0 AS h_left,
    CAST(sum(n) OVER upto AS DOUBLE) AS n_left, CAST(sum(g) OVER every AS DOUBLE) / 1048576e0 AS g, CAST(sum(h) OVER every AS DOUBLE) / 1048576e0 AS h,
    CAST(sum(n) OVER every AS DOUBLE) AS n
  FROM binned WINDOW upto AS (PARTITION BY i ORDER BY bin ROWS UNBOUNDED PRECEDING), every AS (PARTITION BY i))""",
        f"splits AS (SELECT *, {part('g_left', 'h_left')} + {part('(g - g_left)', '(h - h_left)')} - {part('g', 'h')} AS gain FROM summed)",
    )


# -- the oracles ----------------------------------------------------------------------------------------

BASE = with_(*daily(), DEMAND, *baselines())
SILVER_COLUMNS = "source_row_number, date, item_code, quantity, sales_quantity, return_quantity, unit_price, sales_amount, unit_cost, cost_amount, is_return, is_valid, error_reason"
PANEL_WITH = with_(tx(), GOLD, top_volume(TOP), PANEL)
HISTORY_WITH = with_(tx(), GOLD, top_volume(TOP), PANEL, *history())
FRAME_WITH = with_(*training())
VALIDATION_WITH = with_(*training(), VALIDATION)
FRAME_ORDER = f"feature_version, as_of_date, item_code, horizon, target_date, target_quantity, {', '.join(CALENDAR_COLUMNS + HISTORY_COLUMNS)}, sku_first_sale_date"
SUNDAY_RULE = "CASE WHEN isodow(target_date) = 7 THEN 0e0 ELSE {} END"


def forecast_of(column: str) -> str:
    return rounded(BASE + f"SELECT item_code, target_date, horizon, {column} AS yhat FROM base", "yhat")


def history_of(*columns: str, doubles: list[str] | None = None) -> str:
    shown = list(columns) if doubles is None else doubles
    sql = HISTORY_WITH + f"SELECT item_code, date, {', '.join(columns)} FROM hist"
    return rounded(sql, *shown) if shown else sql


def selected(condition: str) -> str:
    return rounded(
        with_(*daily("part"), profile())
        + f"""SELECT item_code, total_profit, active_days, days_since_last_sale FROM profile WHERE {condition}
ORDER BY profit_weight DESC, item_code LIMIT {TOP}""",
        "total_profit",
    )


ACTIVE, RECENT = "active_days >= 15", "days_since_last_sale <= 180"
WIDE_CELLS = ", ".join(f"max(yhat) FILTER (place = {k}) AS F{k}" for k in range(1, 29))
GRID_MODEL = "CASE WHEN b.item_code IN (SELECT item_code FROM chosen) THEN a * b.same_weekday_8w + (1 - a) * b.median_56 ELSE b.median_56 END"

ORACLES: dict[str, str] = {
    "mean_forecast_of_selected": rounded(
        with_(*daily(), DEMAND, profile(), *baselines())
        + f"""SELECT item_code, target_date, horizon, {SUNDAY_RULE.format('mean_56')} AS yhat FROM base
WHERE item_code IN (SELECT item_code FROM profile WHERE active_days >= 50 AND days_since_last_sale <= 56
  ORDER BY profit_weight DESC, item_code LIMIT {TOP})""",
        "yhat",
    ),
    "bronze_transactions": with_(tx(), text())
    + f"""SELECT 'batch-1' AS batch_id, 'transactions.csv' AS source_file, stt AS source_row_number, stt, date_raw, item_code_raw,
  {vn('quantity_raw')} AS quantity, unit_price_raw, {vn('sales_amount_raw')} AS sales_amount, unit_cost_raw,
  {vn('cost_amount_raw')} AS cost_amount FROM file""",
    "clean_transactions": with_(*from_text()) + f"SELECT {SILVER_COLUMNS} FROM silver",
    "vn_decimal_roundtrip": with_(tx(), text())
    + f"SELECT stt, sales_amount_raw AS amount_text, {vn('sales_amount_raw')} AS amount, {vn('unit_price_raw')} AS unit_price FROM file",
    "silver_errors_by_reason": with_(*from_text())
    + """SELECT reason, count(*) AS rows, count(*) FILTER (is_return) AS return_rows
FROM (SELECT is_return, unnest(string_split(error_reason, ';')) AS reason FROM silver WHERE NOT is_valid) GROUP BY reason""",
    "csv_ingest": with_(tx(), text())
    + f"SELECT {', '.join('CAST(stt AS VARCHAR) AS stt_raw' if c == 'stt_raw' else c for c in RAW_FIELD_NAMES)}, true AS row_numbers_contiguous FROM file",
    "replaced_gold": rounded(with_(tx(), GOLD) + "SELECT * FROM gold", *GOLD_DOUBLES),
    "gold_for_features": rounded(
        with_(tx(), GOLD) + "SELECT date, item_code, quantity_sold, return_quantity, avg_unit_price FROM gold",
        "quantity_sold", "return_quantity", "avg_unit_price",
    ),
    "features_in_training_order": FRAME_WITH
    + """SELECT row_number() OVER (ORDER BY target_date, item_code, horizon, as_of_date) AS place, target_date, item_code, horizon, as_of_date
FROM frame""",
    "model_matrix": rounded(
        with_(tx(), GOLD, top_volume(TOP), inference_panel(CUT, 730), *history(), inference(56))
        + f"""SELECT i.item_code, horizon, {', '.join(f'CAST(CAST({c} AS INTEGER) AS DOUBLE) AS {c}' for c in CALENDAR_COLUMNS)},
  {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in HISTORY_COLUMNS)}, CAST(coalesce(item_code_id, -1) AS DOUBLE) AS item_code_id
FROM inference i LEFT JOIN (SELECT item_code, row_number() OVER (ORDER BY item_code) - 1 AS item_code_id FROM top) t ON t.item_code = i.item_code""",
        *CALENDAR_COLUMNS, *HISTORY_COLUMNS, "item_code_id",
    ),
    "batch_forecast_run": rounded(with_(*HYBRID) + "SELECT 'run-1' AS run_id, * FROM hybrid", "predicted_quantity"),
    "loaded_wide_forecast": rounded(
        BASE
        + f"""SELECT 'run-1' AS run_id, {CUT} AS forecast_date, item_code, target_date, horizon,
  CASE WHEN item_code = 'BRAND-7' THEN mean_28 ELSE same_weekday_8w END AS predicted_quantity FROM base""",
        "predicted_quantity",
    ),
    "chosen_model_version": """SELECT name, version, stage FROM (SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, p_partkey,
  ['None', 'Staging', 'Production'][p_size % 3 + 1] AS stage FROM part) WHERE name = 'Brand#7' AND stage <> 'None'
ORDER BY stage, p_partkey DESC LIMIT 1""",
    "typed_csv_load": rounded(with_(*daily()) + "SELECT * FROM daily", *DAILY_DOUBLES),
    "gold_daily_sales": rounded(with_(tx(), GOLD) + "SELECT * FROM gold", *GOLD_DOUBLES),
    "gold_of_valid_rows": rounded(
        with_(*from_text()) + f"SELECT date, item_code, {GOLD_AGGREGATES} FROM silver WHERE is_valid GROUP BY date, item_code",
        *GOLD_DOUBLES,
    ),
    "strict_transactions": rounded(
        with_(tx(), STRICT)
        + """SELECT date, stt, ' ' || lower(item_code) || ' ' AS item_code, quantity, unit_price, sales_amount, unit_cost, cost_amount,
  is_return, sales_qty, return_qty, net_qty, profit FROM strict""",
        "unit_price", "sales_amount", "unit_cost", "cost_amount", "sales_qty", "return_qty", "net_qty", "profit",
    ),
    "strict_daily_sales": rounded(with_(*daily()) + "SELECT * FROM daily", *DAILY_DOUBLES),
    "gold_quality_report": with_(
        *from_text(),
        f"gold AS (SELECT date, item_code, {GOLD_AGGREGATES} FROM silver WHERE is_valid GROUP BY date, item_code)",
    )
    + """SELECT (SELECT count(*) FROM silver) AS silver_rows, (SELECT count(*) FROM silver WHERE is_valid) AS valid_silver_rows,
  (SELECT count(*) FROM silver WHERE NOT is_valid) AS invalid_silver_rows, count(*) AS gold_rows,
  count(*) FILTER (date IS NULL) AS null_gold_dates, count(*) FILTER (item_code IS NULL) AS null_gold_item_codes,
  count(*) - count(DISTINCT (date, item_code)) AS duplicate_gold_keys,
  count(*) FILTER (return_quantity < 0) AS negative_return_quantity,
  count(*) FILTER (transaction_count < 1) AS invalid_transaction_count FROM gold""",
    "sku_profile_asof": rounded(with_(*daily(), profile()) + "SELECT * FROM profile", *PROFILE_DOUBLES),
    "sku_profile_asof_part": rounded(with_(*daily("part"), profile()) + "SELECT * FROM profile", *PROFILE_DOUBLES),
    "select_top_profit": selected("true"),
    "select_active": selected(ACTIVE),
    "select_recent": selected(RECENT),
    "select_active_recent": selected(f"{ACTIVE} AND {RECENT}"),
    "top_volume_skus": with_(tx("part"), GOLD, top_volume(TOP)) + "SELECT * FROM top",
    "active_skus": with_(tx("part"), GOLD) + "SELECT DISTINCT item_code FROM gold WHERE date >= (SELECT max(date) FROM gold) - 55",
    "gold_window": rounded(
        with_(tx(), GOLD)
        + f"SELECT date, item_code, quantity_sold, return_quantity, avg_unit_price FROM gold WHERE date BETWEEN {CUT} - 199 AND {CUT}",
        "quantity_sold", "return_quantity", "avg_unit_price",
    ),
    "training_skus": with_(tx(), GOLD, top_volume(5)) + "SELECT item_code FROM top",
    "dense_panel_top20": rounded(PANEL_WITH + "SELECT * FROM panel", "quantity_sold", "return_quantity", "avg_unit_price"),
    "demand_matrix": with_(*daily(), DEMAND) + "SELECT item_code, date, qty FROM demand",
    "lag_features": history_of(*LAGS),
    "rolling_features": history_of(*ROLLING),
    "expanding_features": history_of(*EXPANDING),
    "expanding_median": history_of("sku_median_sales"),
    "lifecycle_features": history_of("sku_first_sale_date", "sku_lifecycle_days", doubles=[]),
    "price_features": history_of(*PRICES),
    "training_frame": rounded(FRAME_WITH + f"SELECT {FRAME_ORDER} FROM frame", "target_quantity", *HISTORY_DOUBLES),
    "feature_quality_report": FRAME_WITH
    + f"""SELECT count(*) AS rows, count(DISTINCT item_code) AS skus, count(DISTINCT as_of_date) AS as_of_dates,
  count(DISTINCT horizon) AS horizons,
  count(*) FILTER (feature_version IS NULL OR as_of_date IS NULL OR item_code IS NULL OR horizon IS NULL OR target_date IS NULL OR target_quantity IS NULL) AS null_keys,
  count(*) FILTER (horizon NOT BETWEEN 1 AND 56) AS invalid_horizons, count(*) FILTER (target_quantity < 0) AS negative_targets,
  count(*) FILTER (target_date <= as_of_date) AS target_not_future,
  count(*) - count(DISTINCT (feature_version, as_of_date, item_code, horizon)) AS duplicate_keys,
  CAST({' + '.join(f"count(*) FILTER (isinf({c}))" for c in HISTORY_DOUBLES)} AS BIGINT) AS infinite_features FROM frame""",
    "inference_frame": rounded(
        with_(tx("part"), GOLD, inference_panel(CUT, 200), *history(), inference(56)) + "SELECT * FROM inference", *HISTORY_DOUBLES
    ),
    "inference_frame_brand": rounded(
        with_(tx(), GOLD, inference_panel(CUT, 730), *history(), inference(56)) + "SELECT * FROM inference", *HISTORY_DOUBLES
    ),
    "time_split_counts": FRAME_WITH
    + """SELECT CASE WHEN target_date >= b.start THEN 'validation' ELSE 'train' END AS part, count(*) AS rows,
  min(target_date) AS first_target_date, max(target_date) AS last_target_date
FROM frame CROSS JOIN (SELECT max(target_date) - 27 AS start FROM frame) b GROUP BY 1""",
    "baseline_zero": forecast_of("zero"),
    "baseline_mean28": forecast_of("mean_28"),
    "baseline_median56": forecast_of("median_56"),
    "baseline_weekday8": forecast_of("same_weekday_8w"),
    "baseline_sparse": forecast_of("conservative_sparse"),
    "baseline_blend": forecast_of("blend_mean_weekday"),
    "blend_of_models": rounded(BASE + "SELECT item_code, target_date, mean_28 * 0.75e0 + median_56 * 0.25e0 AS yhat FROM base", "yhat"),
    "rmsse_denominator": rounded(with_(*daily("part"), DEMAND, scale()) + "SELECT item_code, rmsse_denom FROM scale", "rmsse_denom"),
    "wrmsse_by_sku": rounded(
        with_(*daily(), DEMAND, profile(), *baselines(), scale(), scores("mean_28")) + "SELECT * FROM scores",
        "weight", "denom", "mse", "rmsse", "weighted_rmsse",
    ),
    "wrmsse_total": rounded(
        with_(*daily(), DEMAND, profile(), *baselines(), scale(), scores("mean_28"))
        + "SELECT sum(weighted_rmsse) AS wrmsse FROM scores",
        "wrmsse",
    ),
    "baseline_cv": rounded(backtest("brand"), "wrmsse_28", "wrmsse_56"),
    "baseline_cv_part": rounded(backtest("part"), "wrmsse_28", "wrmsse_56"),
    "baseline_cv_summary": rounded(
        f"SELECT model, avg(wrmsse_28) AS wrmsse_28, avg(wrmsse_56) AS wrmsse_56 FROM ({backtest('brand')}) GROUP BY model",
        "wrmsse_28", "wrmsse_56",
    ),
    "feature_baseline_metrics": rounded(VALIDATION_WITH + frame_metrics(), *METRICS),
    "metrics_by_horizon": rounded(VALIDATION_WITH + frame_metrics("horizon"), *METRICS),
    "late_actuals_metrics": rounded(VALIDATION_WITH + frame_metrics("horizon"), *METRICS),
    "metrics_by_speed_group": rounded(with_(*training(), VALIDATION, SPEED) + frame_metrics("sku_group", "grouped"), *METRICS),
    "registration_rule": rounded(
        with_(*training(), VALIDATION, f"metrics AS ({frame_metrics()})")
        + """SELECT model_wape, best_baseline_wape, model_wape <= best_baseline_wape * 1.05 AS passed
FROM (SELECT max(wape) FILTER (model = 'moving_average_28') AS model_wape,
  min(wape) FILTER (model <> 'moving_average_28') AS best_baseline_wape FROM metrics)""",
        "model_wape", "best_baseline_wape",
    ),
    "sunday_zero": forecast_of(SUNDAY_RULE.format("mean_28")),
    "end_of_selling_zero": rounded(
        with_(*daily("part"), DEMAND, *baselines("DATE '2000-12-31'"))
        + f"""SELECT item_code, sum(CASE WHEN sold THEN mean_56 ELSE 0e0 END) AS total, count(*) AS days
FROM base JOIN (SELECT item_code, sum(qty) FILTER (date BETWEEN DATE '{ENDED_SINCE}' AND {CUT}) > 0 AS sold FROM demand GROUP BY item_code) USING (item_code)
GROUP BY item_code""",
        "total",
    ),
    "weekday_reference": rounded(with_(*daily(), DEMAND, *reference()) + "SELECT * FROM reference", "alpha", "reference"),
    "key_sku_adjust": rounded(
        with_(*daily(), DEMAND, *baselines(), *reference())
        + f"""SELECT item_code, target_date, horizon, CASE WHEN alpha > 0 THEN greatest(alpha * reference + (1 - alpha) * y, 0) ELSE y END AS yhat
FROM (SELECT item_code, target_date, horizon, CASE WHEN isodow(target_date) = 7 OR NOT sold THEN 0e0 ELSE mean_56 END AS y FROM base
  JOIN (SELECT item_code, sum(qty) FILTER (date BETWEEN DATE '{ENDED_SINCE}' AND {CUT}) > 0 AS sold FROM demand GROUP BY item_code) USING (item_code))
LEFT JOIN (SELECT item_code, target_date, alpha, reference FROM reference) USING (item_code, target_date)""",
        "yhat",
    ),
    "forecast_wide": rounded(
        BASE
        + f"""SELECT id, {WIDE_CELLS} FROM (SELECT item_code || CASE WHEN horizon <= 28 THEN '_validation' ELSE '_evaluation' END AS id,
  (horizon - 1) % 28 + 1 AS place, same_weekday_8w AS yhat FROM base) GROUP BY id""",
        *[f"F{k}" for k in range(1, 29)],
    ),
    "forecast_long": rounded(
        BASE + f"SELECT {CUT} AS forecast_date, item_code, target_date, horizon, same_weekday_8w AS predicted_quantity FROM base",
        "predicted_quantity",
    ),
    "wide_file_check": with_(*daily())
    + """SELECT CAST(0 AS BIGINT) AS null_rows, CAST(0 AS BIGINT) AS negative_rows, CAST(0 AS BIGINT) AS items_without_56_horizons,
  CAST(0 AS BIGINT) AS items_with_duplicates, count(DISTINCT item_code) AS items FROM daily""",
    "hybrid_forecast": rounded(with_(*HYBRID) + "SELECT * FROM hybrid", "predicted_quantity"),
    "hybrid_forecast_part": rounded(with_(*hybrid("part", 200, 100)) + "SELECT * FROM hybrid", "predicted_quantity"),
    "source_counts": with_(*HYBRID) + "SELECT prediction_source, count(*) AS rows FROM hybrid GROUP BY prediction_source",
    "forecast_quality_report": with_(*HYBRID)
    + """SELECT count(*) AS rows, count(DISTINCT item_code) AS skus, (SELECT count(*) FROM active) AS expected_skus,
  count(DISTINCT horizon) AS horizons,
  (SELECT count(*) FROM active WHERE item_code NOT IN (SELECT item_code FROM hybrid)) AS missing_skus,
  count(*) FILTER (horizon NOT BETWEEN 1 AND 56) AS invalid_horizons,
  count(*) FILTER (predicted_quantity < 0) AS negative_predictions, count(*) FILTER (predicted_quantity IS NULL) AS null_predictions,
  count(*) - count(DISTINCT (item_code, target_date)) AS duplicate_keys,
  count(*) FILTER (datediff('day', forecast_date, target_date) <> horizon) AS wrong_target_date FROM hybrid""",
    "latest_run": with_(*runs()) + "SELECT run_id, forecast_date, model_name, status, row_count FROM latest",
    "sku_forecast": rounded(
        with_(*runs())
        + "SELECT target_date, horizon, predicted_quantity FROM rows_of WHERE item_code = 'BRAND-7' AND horizon <= 28",
        "predicted_quantity",
    ),
    "top_skus": rounded(
        with_(*runs())
        + """SELECT item_code, target_date, horizon, predicted_quantity FROM rows_of WHERE target_date = DATE '2001-09-03'
ORDER BY predicted_quantity DESC, item_code LIMIT 10 OFFSET 5""",
        "predicted_quantity",
    ),
    "day_summary": rounded(
        with_(*runs())
        + """SELECT target_date, count(*) AS sku_count, sum(predicted_quantity) AS total_predicted_quantity,
  avg(predicted_quantity) AS avg_predicted_quantity, max(predicted_quantity) AS max_predicted_quantity
FROM rows_of WHERE target_date = DATE '2001-09-03' GROUP BY target_date""",
        "total_predicted_quantity", "avg_predicted_quantity", "max_predicted_quantity",
    ),
    "published_forecast": rounded(
        BASE + "SELECT 'run-b' AS run_id, item_code, target_date, horizon, mean_28 AS predicted_quantity FROM base",
        "predicted_quantity",
    ),
    "origin_features": rounded(
        with_(*direct_rows())
        + f"SELECT item_code, origin_date, {', '.join(ORIGIN_COLUMNS)}, days_since_last_sale, origin_dow, origin_month FROM direct WHERE horizon = 1",
        *ORIGIN_COLUMNS,
        "days_since_last_sale",
    ),
    "direct_dataset": rounded(
        with_(*direct_rows(), scale(), SAMPLE_WEIGHTS)
        + f"SELECT item_code, origin_date, target_date, {', '.join(DIRECT_COLUMNS)}, target, sample_weight FROM {DIRECT_JOINED}",
        *DIRECT_DOUBLES, "target", "sample_weight",
    ),
    "poisson_root_split": rounded(
        with_(*direct_rows(), scale(), SAMPLE_WEIGHTS, *root_split())
        + """SELECT feature, cuts[bin + 1] AS threshold, gain, CAST(n_left AS BIGINT) AS rows_left, CAST(n AS BIGINT) AS rows
FROM splits WHERE least(n_left, n - n_left) >= 50 AND least(h_left, h - h_left) >= 1e-3 ORDER BY gain DESC, i, bin LIMIT 1""",
        "threshold", "gain",
    ),
    "direct_rows_of_active": rounded(
        with_(*direct_rows(grain="part"))
        + """SELECT item_code, origin_date, count(*) AS rows, sum(target) AS target FROM direct
WHERE days_since_last_sale < 9999 GROUP BY item_code, origin_date""",
        "target",
    ),
    "direct_newest_rows": with_(*direct_rows(56))
    + f"""SELECT origin_date, count(*) AS rows FROM (SELECT d.origin_date FROM direct d JOIN chosen c ON c.item_code = d.item_code
  ORDER BY d.origin_date DESC, d.horizon DESC, c.item_id DESC LIMIT {DIRECT.top_n * 56 * 8}) GROUP BY origin_date""",
    "direct_forecast_features": rounded(
        with_(*daily(), DEMAND, profile(), CHOSEN, *origins())
        + f"""SELECT item_code, origin_date, target_date, {', '.join(DIRECT_COLUMNS)} FROM (
  SELECT f.* EXCLUDE (pos), horizon, target_date, item_id, {', '.join(STATIC_COLUMNS)}, {TARGET_CALENDAR}
  FROM featured f JOIN chosen c USING (item_code)
  CROSS JOIN (SELECT CAST(h AS INTEGER) AS horizon, CAST({CUT} + CAST(h AS INTEGER) AS DATE) AS target_date FROM (SELECT unnest(generate_series(1, 56)) AS h))
  WHERE origin_date = CAST({CUT} + 1 AS DATE))""",
        *DIRECT_DOUBLES,
    ),
    "sample_weights": rounded(
        with_(*daily(), DEMAND, profile(), CHOSEN, scale(), SAMPLE_WEIGHTS) + "SELECT * FROM sample_weights", "sample_weight"
    ),
    "alpha_grid": rounded(
        with_(*daily(), DEMAND, profile(), CHOSEN, *baselines(), scale())
        + ALPHA_GRID.format(model=GRID_MODEL),
        "alpha", "wrmsse_56",
    ),
    "chosen_alpha": with_(*daily(), DEMAND, profile(), CHOSEN, *baselines(), scale(), f"grid AS MATERIALIZED ({ALPHA_GRID.format(model=GRID_MODEL)})")
    + """SELECT coalesce((SELECT alpha FROM grid WHERE wrmsse_56 < (SELECT wrmsse_56 FROM grid WHERE alpha = 0)
  ORDER BY wrmsse_56, alpha LIMIT 1), 0e0) AS best_alpha""",
    "recursive_median": rounded(
        with_(*daily(), DEMAND, *recursion()).replace("WITH ", "WITH RECURSIVE ", 1)
        + f"""SELECT item_code, CAST({CUT} + place AS DATE) AS target_date, place AS horizon, yhat
FROM rolled WHERE place > 0""",
        "yhat",
    ),
    "blended_forecast": rounded(
        with_(*daily(), DEMAND, profile(), CHOSEN, *baselines())
        + f"SELECT item_code, target_date, horizon, {GRID_MODEL} AS yhat FROM base b CROSS JOIN (SELECT 0.6e0 AS a)",
        "yhat",
    ),
}
