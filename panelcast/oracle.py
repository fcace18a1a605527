"""DuckDB oracle SQL for the registered queries.

Each statement re-derives the result from the raw views (``lineitem``,
``orders``, ``events``) with plain ANSI window/aggregate SQL, independent of
the Spark code path. Shared CTEs are assembled from the fragments below.
Computed doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

IDX = "(year(period) * 12 + month(period))"
W = "PARTITION BY entity_id ORDER BY period"

# Test-run parameters shared with panelcast.queries (fixed for the oracle).
SUFFIX = "7"
U_THR, S_THR = 5, 0
MIN_HIST = 6

PANEL = f"""
panel_raw AS (
  SELECT l_suppkey AS entity_id,
         CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
         count(*) AS total_events,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS planned_events,
         count(CASE WHEN l_returnflag <> 'N' THEN 1 END) AS unplanned_events,
         count(CASE WHEN l_returnflag = 'R' AND l_quantity >= 49 THEN 1 END) AS severe_events,
         avg(CASE WHEN l_linenumber = 1 THEN 1.0 - l_discount END) AS avail_peak_am,
         avg(CASE WHEN l_linenumber >= 5 THEN 1.0 - l_discount END) AS avail_peak_pm,
         avg(1.0 - l_discount) AS avail_all_day,
         bool_or(l_quantity >= 50) AS mark
  FROM lineitem
  WHERE l_suppkey IS NOT NULL AND l_shipdate IS NOT NULL
  GROUP BY 1, 2
),
panel AS (
  SELECT entity_id, period, total_events, planned_events, unplanned_events, severe_events,
         avail_peak_am, avail_peak_pm, avail_all_day,
         CAST({IDX} - max(CASE WHEN mark THEN {IDX} END)
              OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS age
  FROM panel_raw
)"""

ORDERS_PANEL = f"""
panel_raw AS (
  SELECT o_custkey AS entity_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS period,
         count(*) AS total_events,
         count(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 END) AS planned_events,
         count(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 END) AS unplanned_events,
         count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS severe_events,
         avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS avail_peak_am,
         avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END) AS avail_peak_pm,
         avg(CASE WHEN o_orderstatus <> 'P' THEN 1.0 ELSE 0.0 END) AS avail_all_day,
         bool_or(o_totalprice >= 300000) AS mark
  FROM orders
  WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL
  GROUP BY 1, 2
),
panel AS (
  SELECT entity_id, period, total_events, planned_events, unplanned_events, severe_events,
         avail_peak_am, avail_peak_pm, avail_all_day,
         CAST({IDX} - max(CASE WHEN mark THEN {IDX} END)
              OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS age
  FROM panel_raw
)"""

EVENTS_PANEL = """
panel AS (
  SELECT user_id AS entity_id,
         CAST(ts AS DATE) AS period,
         count(*) AS total_events,
         count(CASE WHEN event_type <> 'error' THEN 1 END) AS planned_events,
         count(CASE WHEN event_type = 'error' THEN 1 END) AS unplanned_events,
         count(CASE WHEN event_type = 'error' AND value >= 90 THEN 1 END) AS severe_events,
         avg(value / 100.0) AS value_mean,
         avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS value_share
  FROM events
  WHERE user_id IS NOT NULL AND ts IS NOT NULL
  GROUP BY 1, 2
)"""


def history_ctes(src: str = "panel", idx: str = IDX) -> str:
    """flags + consecutive history over ``src`` -> ``hist``."""
    return f"""
flagged AS (
  SELECT *, {idx} AS idx,
         NOT coalesce(ends_with(CAST(entity_id AS VARCHAR), '{SUFFIX}'), false) AS eligible_for_modeling
  FROM {src}
),
brk AS (
  SELECT *, CASE WHEN lag(idx) OVER (PARTITION BY entity_id ORDER BY idx) = idx - 1 THEN false ELSE true END AS run_start
  FROM flagged
),
hist AS (
  SELECT * EXCLUDE (run_start),
         CAST(idx - max(CASE WHEN run_start THEN idx END)
              OVER (PARTITION BY entity_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1 AS INTEGER)
           AS consecutive_history_months
  FROM brk
)"""


def label_cte(src: str = "hist", u: int = U_THR, s: int = S_THR, name: str = "label", eligible_only: bool = True) -> str:
    where = "WHERE eligible_for_modeling" if eligible_only else ""
    return f"""
lab AS (
  SELECT *,
         CASE WHEN lead(idx) OVER w = idx + 1
                   AND lead(unplanned_events) OVER w IS NOT NULL
                   AND lead(severe_events) OVER w IS NOT NULL
              THEN CAST((lead(unplanned_events) OVER w >= {u} OR lead(severe_events) OVER w > {s}) AS INTEGER)
         END AS {name}
  FROM {src} {where}
  WINDOW w AS (PARTITION BY entity_id ORDER BY idx)
)"""


# holdout: 3 months ending one month before the last panel period
HOLDOUT = """
bounds AS (
  SELECT CAST(max(period) - INTERVAL 3 MONTH AS DATE) AS h_start,
         CAST(max(period) - INTERVAL 1 MONTH AS DATE) AS h_end
  FROM panel
)"""

OPS = ["total_events", "unplanned_events", "planned_events", "severe_events", "avail_peak_am", "avail_peak_pm", "avail_all_day"]


def features_cte(src: str = "lab", lags=(1, 2, 3), windows=(3, 6), age: bool = False, season: bool = False) -> str:
    cols = []
    if age:
        cols.append("CAST(age IS NULL AS INTEGER) AS age_missing")
    for c in OPS:
        for k in lags:
            cols.append(f"lag({c}, {k}) OVER w AS {c}_lag_{k}")
        for n in windows:
            cols.append(f"avg(CAST({c} AS DOUBLE)) OVER (w ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS {c}_roll_{n}_mean")
    if season:
        cols.append("CAST(month(period) AS INTEGER) AS month_of_year")
        cols.append("CAST(month(period) IN (12, 1, 2) AS INTEGER) AS is_winter")
    body = ",\n         ".join(cols)
    return f"""
feat AS (
  SELECT *,
         {body}
  FROM {src}
  WINDOW w AS (PARTITION BY entity_id ORDER BY idx)
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(c.strip("\n") for c in ctes) + "\n"


DEV = """
dev AS (
  SELECT * FROM feat
  WHERE label IS NOT NULL AND consecutive_history_months >= 6
    AND period < (SELECT h_start FROM bounds)
)"""


def feature_select(lags=(1, 2, 3), windows=(3, 6), age: bool = False, season: bool = False) -> str:
    """Select list of a feature set in the fixed order, doubles rounded."""
    dbl = {"avail_peak_am", "avail_peak_pm", "avail_all_day"}
    cols = [f"round({c}, 6) AS {c}" if c in dbl else c for c in OPS]
    if age:
        cols += ["round(age, 6) AS age", "age_missing"]
    for c in OPS:
        for k in lags:
            n = f"{c}_lag_{k}"
            cols.append(f"round({n}, 6) AS {n}" if c in dbl else n)
        for w in windows:
            n = f"{c}_roll_{w}_mean"
            cols.append(f"round({n}, 6) AS {n}")
    if season:
        cols += ["month_of_year", "is_winter"]
    return ", ".join(cols)


def fold_cte(src: str = "dev", k: int = 4, m: int = 3) -> str:
    """Fold list (position, name, bounds) from the last development period."""
    return f"""
folds AS (
  SELECT p AS position,
         CAST(last - to_months(({k} - p) * {m} + {m - 1}) AS DATE) AS v_start,
         CAST(last - to_months(({k} - p) * {m}) AS DATE) AS v_end
  FROM (SELECT max(period) AS last FROM {src}), range(1, {k + 1}) AS t(p)
)"""
