"""Oracle statements keyed like ``panelcast.queries.REGISTRY``."""

from __future__ import annotations

from .oracle import DEV, HOLDOUT, PANEL, features_cte, history_ctes, label_cte, with_

SQL: dict[str, str] = {}

PANEL_COLS = ("entity_id, period, total_events, planned_events, unplanned_events, severe_events, "
              "round(avail_peak_am, 6) AS avail_peak_am, round(avail_peak_pm, 6) AS avail_peak_pm, "
              "round(avail_all_day, 6) AS avail_all_day, round(age, 6) AS age")

SQL["scan_panel"] = with_(PANEL) + f"SELECT {PANEL_COLS} FROM panel"

SQL["consecutive_history"] = with_(PANEL, history_ctes()) + \
    "SELECT entity_id, period, consecutive_history_months FROM hist"

SQL["eligibility_flags"] = with_(PANEL) + """
SELECT entity_id, period,
       NOT (sfx OR n < 80) AS eligible_for_modeling,
       CASE WHEN sfx THEN 'excluded_equipment_suffix' WHEN n < 80 THEN 'insufficient_history' ELSE 'eligible' END
         AS eligibility_reason
FROM (SELECT *, coalesce(ends_with(CAST(entity_id AS VARCHAR), '7'), false) AS sfx,
             count(period) OVER (PARTITION BY entity_id) AS n FROM panel)"""

SQL["next_period_label"] = with_(PANEL, history_ctes(), label_cte()) + "SELECT entity_id, period, label FROM lab"

SQL["label_prevalence"] = with_(PANEL, history_ctes(), label_cte(), HOLDOUT) + """
SELECT count(label) AS labeled_rows,
       count(CASE WHEN label = 1 THEN 1 END) AS positive_rows,
       count(CASE WHEN label = 0 THEN 1 END) AS negative_rows,
       round(avg(CAST(label AS DOUBLE)), 6) AS prevalence,
       count(CASE WHEN label IS NULL THEN 1 END) AS unlabeled_rows,
       count(DISTINCT CASE WHEN label IS NOT NULL THEN entity_id END) AS labeled_entities,
       min(CASE WHEN label IS NOT NULL THEN period END) AS first_period,
       max(CASE WHEN label IS NOT NULL THEN period END) AS last_period
FROM lab
WHERE consecutive_history_months >= 6 AND period < (SELECT h_start FROM bounds)"""

from .oracle import ORDERS_PANEL  # noqa: E402

EXPORT = """
export AS (
  SELECT strftime(period, '%m/%d/%Y') AS "Month",
         'B' || CAST(entity_id % 5 AS VARCHAR) AS "Borough",
         CASE WHEN entity_id % 4 = 0 THEN 'Escalator' ELSE 'Elevator' END AS "Equipment Type",
         'EQ' || lpad(CAST(entity_id AS VARCHAR), 6, '0') AS "Equipment Code",
         CAST(total_events AS VARCHAR) AS "Total Outages",
         CAST(planned_events AS VARCHAR) AS "Scheduled Outages",
         CAST(unplanned_events AS VARCHAR) AS "Unscheduled Outages",
         CAST(severe_events AS VARCHAR) AS "Entrapments",
         age AS "Time Since Major Improvement",
         CASE WHEN entity_id % 3 = 0 THEN CAST(CAST(avail_peak_am * 100.0 AS DECIMAL(9,4)) AS VARCHAR) || '%'
              ELSE CAST(CAST(avail_peak_am AS DECIMAL(9,6)) AS VARCHAR) END AS "AM Peak Availability",
         avail_peak_am * hours AS "AM Peak Hours Available", hours AS "AM Peak Total Hours",
         CAST(CAST(avail_peak_pm * 100.0 AS DECIMAL(9,4)) AS VARCHAR) AS "PM Peak Availability",
         avail_peak_pm * hours AS "PM Peak Hours Available", hours AS "PM Peak Total Hours",
         CAST(CAST(avail_all_day AS DECIMAL(9,6)) AS VARCHAR) AS "24-Hour Availability",
         avail_all_day * hours AS "24-Hour Hours Available", hours AS "24-Hour Total Hours",
         'Station ' || CAST(entity_id % 50 AS VARCHAR) AS "Station Name", entity_id % 50 AS "Station MRN",
         'Complex ' || CAST(entity_id % 25 AS VARCHAR) AS "Station Complex Name", entity_id % 25 AS "Station Complex MRN",
         period, entity_id
  FROM (SELECT *, CAST(day(last_day(period)) AS DOUBLE) * 24.0 AS hours FROM panel)
)"""


def _ratio(col: str) -> str:
    t = f'trim("{col}")'
    return (f"CASE WHEN coalesce(ends_with({t}, '%'), false) THEN TRY_CAST(rtrim({t}, '%') AS DOUBLE) / 100.0 "
            f"ELSE TRY_CAST(rtrim({t}, '%') AS DOUBLE) END")


RATIO_COLS = ("AM Peak Availability", "PM Peak Availability", "24-Hour Availability")

SQL["canonicalize"] = with_(PANEL, EXPORT) + f"""
, norm AS (
  SELECT *, {_ratio(RATIO_COLS[0])} AS r0, {_ratio(RATIO_COLS[1])} AS r1, {_ratio(RATIO_COLS[2])} AS r2 FROM export
), scale AS (
  SELECT CASE WHEN max(r0) > 1 THEN 100.0 ELSE 1.0 END AS s0, CASE WHEN max(r1) > 1 THEN 100.0 ELSE 1.0 END AS s1,
         CASE WHEN max(r2) > 1 THEN 100.0 ELSE 1.0 END AS s2 FROM norm
)
SELECT "Month", "Borough", "Equipment Type", "Equipment Code",
       TRY_CAST("Total Outages" AS BIGINT) AS "Total Outages",
       TRY_CAST("Scheduled Outages" AS BIGINT) AS "Scheduled Outages",
       TRY_CAST("Unscheduled Outages" AS BIGINT) AS "Unscheduled Outages",
       TRY_CAST("Entrapments" AS BIGINT) AS "Entrapments",
       round("Time Since Major Improvement", 6) AS "Time Since Major Improvement",
       round(r0 / (SELECT s0 FROM scale), 6) AS "AM Peak Availability",
       round("AM Peak Hours Available", 6) AS "AM Peak Hours Available", round("AM Peak Total Hours", 6) AS "AM Peak Total Hours",
       round(r1 / (SELECT s1 FROM scale), 6) AS "PM Peak Availability",
       round("PM Peak Hours Available", 6) AS "PM Peak Hours Available", round("PM Peak Total Hours", 6) AS "PM Peak Total Hours",
       round(r2 / (SELECT s2 FROM scale), 6) AS "24-Hour Availability",
       round("24-Hour Hours Available", 6) AS "24-Hour Hours Available", round("24-Hour Total Hours", 6) AS "24-Hour Total Hours",
       "Station Name", "Station MRN", "Station Complex Name", "Station Complex MRN"
FROM norm
WHERE "Equipment Type" = 'Elevator' AND strptime("Month", '%m/%d/%Y') >= DATE '1996-01-01'"""

DIRTY = EXPORT.replace("strftime(period, '%m/%d/%Y') AS \"Month\"",
                       "CASE WHEN entity_id % 97 = 0 AND month(period) = 1 THEN 'bad' ELSE strftime(period, '%m/%d/%Y') END AS \"Month\"") \
    .replace('CAST(total_events AS VARCHAR) AS "Total Outages"',
             'CASE WHEN entity_id % 89 = 0 AND month(period) = 2 THEN \'n/a\' ELSE CAST(total_events AS VARCHAR) END AS "Total Outages"')

SQL["parse_failures"] = with_(PANEL, DIRTY) + """
SELECT count_if(try_strptime("Month", '%m/%d/%Y') IS NULL) AS unparseable_months,
       count_if("Total Outages" IS NOT NULL AND TRY_CAST("Total Outages" AS BIGINT) IS NULL) AS bad_total_outages,
       count_if("Scheduled Outages" IS NOT NULL AND TRY_CAST("Scheduled Outages" AS BIGINT) IS NULL) AS bad_scheduled_outages,
       count_if("Unscheduled Outages" IS NOT NULL AND TRY_CAST("Unscheduled Outages" AS BIGINT) IS NULL) AS bad_unscheduled_outages,
       count_if("Entrapments" IS NOT NULL AND TRY_CAST("Entrapments" AS BIGINT) IS NULL) AS bad_entrapments
FROM export"""


def _ratio_report_part(col: str) -> str:
    t = f'trim("{col}")'
    pct = f"coalesce(ends_with({t}, '%'), false)"
    return f"""SELECT '{col}' AS "column", count_if({pct}) AS percent_rows,
       count_if("{col}" IS NOT NULL AND ({_ratio(col)}) IS NULL) AS unparseable_rows,
       round(max({_ratio(col)}), 6) AS max_value,
       count_if({pct}) > 0 AND count_if(NOT {pct} AND ({_ratio(col)}) > 1) > 0 AS mixed_encoding
FROM export"""


SQL["normalize_ratio"] = with_(PANEL, EXPORT) + "\nUNION ALL\n".join(_ratio_report_part(c) for c in RATIO_COLS)

SQL["rule_violations"] = with_(PANEL) + """
SELECT count_if(total_events < 0) AS negative_total_events, count_if(planned_events < 0) AS negative_planned_events,
       count_if(unplanned_events < 0) AS negative_unplanned_events, count_if(severe_events < 0) AS negative_severe_events,
       count_if(avail_peak_am < 0 OR avail_peak_am > 1) AS out_of_range_avail_peak_am,
       count_if(avail_peak_pm < 0 OR avail_peak_pm > 1) AS out_of_range_avail_peak_pm,
       count_if(avail_all_day < 0 OR avail_all_day > 1) AS out_of_range_avail_all_day,
       count_if(coalesce(total_events <> planned_events + unplanned_events, true)) AS identity_mismatch
FROM panel"""

SQL["dup_keys"] = """
SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows, count_if(n > 1) AS duplicated_keys
FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2)"""

SQL["gap_count"] = with_(ORDERS_PANEL) + """
SELECT count(step) AS transitions, count_if(step <> 1) AS nonconsecutive_transitions
FROM (SELECT lead(year(period) * 12 + month(period)) OVER (PARTITION BY entity_id ORDER BY period)
             - (year(period) * 12 + month(period)) AS step FROM panel)"""

SQL["history_summary"] = with_(ORDERS_PANEL) + """
SELECT min(n) AS history_min, round(median(n), 6) AS history_median, max(n) AS history_max
FROM (SELECT entity_id, count(*) AS n FROM panel GROUP BY 1)"""

SQL["null_profile"] = with_(PANEL) + """
SELECT count_if(entity_id IS NULL) AS nulls_entity_id, count_if(period IS NULL) AS nulls_period,
       count_if(total_events IS NULL) AS nulls_total_events, count_if(planned_events IS NULL) AS nulls_planned_events,
       count_if(unplanned_events IS NULL) AS nulls_unplanned_events, count_if(severe_events IS NULL) AS nulls_severe_events,
       count_if(avail_peak_am IS NULL) AS nulls_avail_peak_am, count_if(avail_peak_pm IS NULL) AS nulls_avail_peak_pm,
       count_if(avail_all_day IS NULL) AS nulls_avail_all_day, count_if(age IS NULL) AS nulls_age
FROM panel"""

SQL["panel_profile"] = with_(PANEL) + """
SELECT count(*) AS rows, count(DISTINCT entity_id) AS entities, min(period) AS first_period, max(period) AS last_period
FROM panel"""

SQL["eligibility_audit"] = with_(PANEL) + """
, e AS (SELECT entity_id, coalesce(ends_with(CAST(entity_id AS VARCHAR), '7'), false) AS x, count(*) AS n, min(period) AS first
        FROM panel GROUP BY 1, 2)
SELECT CAST(coalesce(sum(CASE WHEN x THEN n ELSE 0 END), 0) AS BIGINT) AS excluded_rows,
       count_if(x) AS excluded_entities,
       CAST(coalesce(sum(CASE WHEN NOT x THEN n ELSE 0 END), 0) AS BIGINT) AS eligible_rows,
       count_if(NOT x) AS eligible_entities,
       count_if(NOT x AND first > (SELECT min(first) FROM e WHERE NOT x)) AS newly_introduced_entities
FROM e"""

SQL["feature_history_audit"] = with_(PANEL, history_ctes()) + """
SELECT fs AS feature_set, m AS minimum_history,
       count_if(consecutive_history_months >= m) AS eligible_rows,
       count(DISTINCT CASE WHEN consecutive_history_months >= m THEN entity_id END) AS eligible_entities
FROM hist, (VALUES ('current_only', 1), ('short_history', 4), ('full_history', 6)) AS t(fs, m)
WHERE eligible_for_modeling
GROUP BY 1, 2"""

SQL["missing_age_audit"] = with_(PANEL) + """
SELECT count_if(miss) AS missing_rows, count(DISTINCT CASE WHEN miss THEN entity_id END) AS affected_entities,
       coalesce(bool_and(NOT miss OR first), true) AS all_on_first_record
FROM (SELECT entity_id, age IS NULL AS miss, row_number() OVER (PARTITION BY entity_id ORDER BY period) = 1 AS first
      FROM panel WHERE NOT coalesce(ends_with(CAST(entity_id AS VARCHAR), '7'), false))"""

AGE_STEPS = with_(PANEL, history_ctes(), label_cte(), HOLDOUT) + """
, pre AS (SELECT * FROM lab WHERE period < (SELECT h_start FROM bounds))
, steps AS (
  SELECT entity_id, period, age, delta,
         c AND delta IS NOT NULL AS observed,
         c AND delta IS NOT NULL AND delta < 0 AS reset,
         c AND delta IS NOT NULL AND (delta < 1 OR delta > 1) AND NOT (delta < 0) AS anomaly
  FROM (SELECT *, coalesce(lag(idx) OVER w = idx - 1, false) AS c, age - lag(age) OVER w AS delta
        FROM pre WINDOW w AS (PARTITION BY entity_id ORDER BY idx))
)
"""

SQL["age_behavior"] = AGE_STEPS + """
SELECT count_if(observed) AS observed_transitions, round(median(CASE WHEN observed THEN delta END), 6) AS median_increment,
       count_if(reset) AS resets, count_if(anomaly) AS anomalies
FROM steps"""

SQL["age_resets"] = AGE_STEPS + """
SELECT entity_id, period, round(age, 6) AS age FROM steps WHERE reset ORDER BY entity_id, period LIMIT 20"""

SQL["age_anomalies"] = AGE_STEPS + """
SELECT entity_id, period, round(age, 6) AS age FROM steps WHERE anomaly ORDER BY entity_id, period LIMIT 20"""

from .oracle import EVENTS_PANEL, OPS, feature_select, fold_cte  # noqa: E402

SQL["feature_eligibility"] = with_(PANEL, history_ctes(), label_cte()) + \
    "SELECT entity_id, period, eligible_for_modeling AND consecutive_history_months >= 4 AS eligible_for_feature_set FROM lab"

SQL["panel_features"] = with_(PANEL, history_ctes(), label_cte(), features_cte(age=True, season=True)) + \
    f"SELECT entity_id, period, label, {feature_select(age=True, season=True)} FROM feat"

SQL["lag_features"] = with_(ORDERS_PANEL) + """
SELECT entity_id, period,
       lag(unplanned_events, 1) OVER w AS unplanned_events_lag_1,
       lag(unplanned_events, 2) OVER w AS unplanned_events_lag_2,
       lag(unplanned_events, 3) OVER w AS unplanned_events_lag_3
FROM panel WINDOW w AS (PARTITION BY entity_id ORDER BY period)"""

SQL["rolling_features"] = with_(ORDERS_PANEL, features_cte(src="(SELECT *, year(period) * 12 + month(period) AS idx FROM panel)", lags=())) + \
    "SELECT entity_id, period, " + ", ".join(
        f"round({c}_roll_{w}_mean, 6) AS {c}_roll_{w}_mean" for c in OPS for w in (3, 6)) + " FROM feat"

SQL["season_features"] = with_(EVENTS_PANEL) + """
SELECT entity_id, period, CAST(month(period) AS INTEGER) AS month_of_year,
       CAST(month(period) IN (12, 1, 2) AS INTEGER) AS is_winter FROM panel"""

DEV_CTES = with_(PANEL, history_ctes(), label_cte(), features_cte(), HOLDOUT, DEV)

SQL["prepared_cohort"] = DEV_CTES + f"SELECT entity_id, period, label, consecutive_history_months, {feature_select()} FROM dev"

SQL["sequence_windows"] = with_(PANEL, history_ctes(), label_cte(), HOLDOUT) + """
, ends AS (SELECT entity_id, idx AS end_idx, period AS end_period FROM lab
           WHERE label IS NOT NULL AND consecutive_history_months >= 6 AND period < (SELECT h_start FROM bounds))
SELECT e.entity_id, CAST(e.end_period - INTERVAL 5 MONTH AS DATE) AS start_period, e.end_period,
       CAST(l.idx - (e.end_idx - 5) AS INTEGER) AS step,
       CAST(l.total_events AS DOUBLE) AS total_events, CAST(l.unplanned_events AS DOUBLE) AS unplanned_events,
       CAST(l.planned_events AS DOUBLE) AS planned_events, CAST(l.severe_events AS DOUBLE) AS severe_events,
       round(l.avail_peak_am, 6) AS avail_peak_am, round(l.avail_peak_pm, 6) AS avail_peak_pm,
       round(l.avail_all_day, 6) AS avail_all_day
FROM ends e JOIN lab l ON l.entity_id = e.entity_id AND l.idx BETWEEN e.end_idx - 5 AND e.end_idx"""

SQL["sequence_cohorts"] = with_(PANEL, history_ctes(), label_cte(), HOLDOUT) + """
, dev AS (SELECT * FROM lab WHERE label IS NOT NULL AND period < (SELECT h_start FROM bounds))
, pe AS (SELECT entity_id, count_if(consecutive_history_months >= 6) AS r6, count_if(consecutive_history_months >= 12) AS r12,
                count_if(consecutive_history_months >= 24) AS r24 FROM dev GROUP BY 1)
SELECT 6 AS sequence_length, CAST(sum(r6) AS BIGINT) AS rows, count_if(r6 > 0) AS entities, count(*) - count_if(r6 > 0) AS entities_lost FROM pe
UNION ALL
SELECT 12, CAST(sum(r12) AS BIGINT), count_if(r12 > 0), count(*) - count_if(r12 > 0) FROM pe
UNION ALL
SELECT 24, CAST(sum(r24) AS BIGINT), count_if(r24 > 0), count(*) - count_if(r24 > 0) FROM pe"""

LABELED_FEAT = with_(PANEL, history_ctes(), label_cte(), features_cte(), HOLDOUT) + """
, lf AS (SELECT * FROM feat WHERE label IS NOT NULL AND consecutive_history_months >= 6)
"""

SQL["holdout_split"] = LABELED_FEAT + """
SELECT entity_id, period, CASE WHEN period < (SELECT h_start FROM bounds) THEN 'development' ELSE 'holdout' END AS split
FROM lf WHERE period <= (SELECT h_end FROM bounds)"""

SQL["latest_split"] = DEV_CTES + """
SELECT entity_id, period,
       CASE WHEN period < (SELECT CAST(max(period) - INTERVAL 2 MONTH AS DATE) FROM dev) THEN 'train' ELSE 'validation' END AS role
FROM dev"""

FOLD_ROWS = DEV_CTES + """
, a AS (
  SELECT *, back,
         CASE WHEN back >= 0 AND back < 12 THEN CAST(4 - floor(back / 3) AS INTEGER) END AS validation_fold,
         CASE WHEN back >= 3 THEN CAST(greatest(1, 4 - floor(back / 3) + 1) AS INTEGER) END AS first_train_fold,
         CASE WHEN back >= 3 THEN CAST(least(4, floor(back / 3)) AS INTEGER) ELSE 0 END AS train_fold_count
  FROM (SELECT *, (SELECT max(year(period) * 12 + month(period)) FROM dev) - idx AS back FROM dev)
)
"""

SQL["rolling_folds"] = FOLD_ROWS + "SELECT entity_id, period, validation_fold, first_train_fold, train_fold_count FROM a"

SQL["fold_audit"] = FOLD_ROWS + "," + fold_cte("dev").strip("\n") + """
, sides AS (
  SELECT validation_fold AS position, 'validation' AS role, count(*) AS rows, count(DISTINCT entity_id) AS entities,
         CAST(sum(label) AS BIGINT) AS positives, min(period) AS first_period, max(period) AS last_period
  FROM a WHERE validation_fold IS NOT NULL GROUP BY 1
  UNION ALL
  SELECT f.position, 'train', count(*), count(DISTINCT a.entity_id), CAST(sum(a.label) AS BIGINT), min(a.period), max(a.period)
  FROM folds f JOIN a ON a.first_train_fold <= f.position GROUP BY 1
)
SELECT strftime(f.v_start, '%Y-%m') || '_to_' || strftime(f.v_end, '%Y-%m') AS fold, CAST(f.position AS INTEGER) AS position,
       s.role, s.rows, s.entities, s.positives, round(s.positives / s.rows, 6) AS prevalence, s.first_period, s.last_period
FROM folds f JOIN sides s ON s.position = f.position"""

SQL["group_folds"] = DEV_CTES + """
, rk AS (SELECT entity_id, row_number() OVER (ORDER BY count(*) DESC, entity_id) - 1 AS r FROM dev GROUP BY entity_id)
, gf AS (SELECT entity_id, CAST(CASE WHEN (r // 4) % 2 = 0 THEN r % 4 ELSE 3 - r % 4 END AS INTEGER) AS group_fold FROM rk)
SELECT group_fold, count(*) AS rows, count(DISTINCT dev.entity_id) AS entities, round(avg(CAST(label AS DOUBLE)), 6) AS prevalence, CAST(0 AS BIGINT) AS shared_entities
FROM dev JOIN gf ON gf.entity_id = dev.entity_id GROUP BY 1"""

SQL["holdout_counts"] = LABELED_FEAT + """
, act AS (SELECT period, count(*) AS actual_rows FROM lf
          WHERE period BETWEEN (SELECT h_start FROM bounds) AND (SELECT h_end FROM bounds) GROUP BY 1)
, exp AS (SELECT period, count(*) AS expected_rows FROM lab
          WHERE label IS NOT NULL AND period BETWEEN (SELECT h_start FROM bounds) AND (SELECT h_end FROM bounds) GROUP BY 1)
SELECT coalesce(act.period, exp.period) AS period, coalesce(actual_rows, 0) AS actual_rows,
       coalesce(expected_rows, 0) AS expected_rows, coalesce(actual_rows, 0) = coalesce(expected_rows, 0) AS matches
FROM act FULL OUTER JOIN exp ON act.period = exp.period"""

SQL["calibration_split"] = DEV_CTES + "," + fold_cte("dev").strip("\n") + """
, tr AS (SELECT f.position, f.v_start, f.v_end, max(d.period) AS tmax FROM folds f JOIN dev d ON d.period < f.v_start GROUP BY 1, 2, 3)
SELECT strftime(tr.v_start, '%Y-%m') || '_to_' || strftime(tr.v_end, '%Y-%m') AS fold, CAST(tr.position AS INTEGER) AS position,
       CAST(tmax - INTERVAL 2 MONTH AS DATE) AS calibration_start,
       count_if(d.period < CAST(tmax - INTERVAL 2 MONTH AS DATE)) AS base_rows,
       count_if(d.period >= CAST(tmax - INTERVAL 2 MONTH AS DATE)) AS calibration_rows
FROM tr JOIN dev d ON d.period < tr.v_start GROUP BY tr.position, tr.v_start, tr.v_end, tmax"""

SQL["prospective_rows"] = LABELED_FEAT + "SELECT entity_id, period, label FROM lf WHERE period > (SELECT CAST(h_end - INTERVAL 6 MONTH AS DATE) FROM bounds)"

SQL["chrono_split"] = DEV_CTES + """
SELECT entity_id, period,
       row_number() OVER (ORDER BY period, entity_id) <= (SELECT least(greatest(1, floor(count(*) * 0.85)), count(*) - 1) FROM dev) AS early
FROM dev"""

PREDS = FOLD_ROWS + """
, preds AS (SELECT validation_fold AS fold, entity_id, period, label, least(1.0, unplanned_events_roll_3_mean / 10.0) AS score,
                   first_train_fold, age FROM a WHERE validation_fold IS NOT NULL)
"""


def ladder_sql(by: list[str], src: str = "preds", name: str = "lad") -> str:
    b = "".join(f"{c}, " for c in by)
    part = f"PARTITION BY {', '.join(by)}" if by else ""
    return f"""
, {name}_g AS (SELECT {b}score, CAST(sum(label) AS BIGINT) AS pos, count(*) AS n FROM {src} GROUP BY {b}score)
, {name} AS (SELECT *, CAST(sum(pos) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_pos,
                 CAST(sum(n) OVER ({part} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum_n,
                 CAST(sum(pos) OVER ({part}) AS BIGINT) AS tot_pos, CAST(sum(n) OVER ({part}) AS BIGINT) AS tot_n FROM {name}_g)
, {name}_rank AS (SELECT {b}
       CASE WHEN max(tot_pos) > 0 THEN sum(pos * (cum_pos / cum_n)) / max(tot_pos) END AS pr_auc,
       CASE WHEN max(tot_pos) > 0 AND max(tot_n) - max(tot_pos) > 0
            THEN sum((n - pos) * ((cum_pos - pos) + pos / 2.0)) / (max(tot_pos) * (max(tot_n) - max(tot_pos))) END AS roc_auc
  FROM {name} GROUP BY ALL)
"""


def cands_sql(by: list[str], src: str = "preds", lad: str = "lad") -> str:
    b = "".join(f"{c}, " for c in by)
    grp = f"GROUP BY {', '.join(by)}" if by else ""
    edges = "\n  UNION\n  ".join(
        f"SELECT {b}CAST({t} AS DOUBLE), CAST(sum(CASE WHEN score >= {t} THEN label ELSE 0 END) AS BIGINT), count_if(score >= {t}), "
        f"CAST(sum(label) AS BIGINT), count(*) FROM {src} {grp}" for t in ("0.0", "1.0"))
    return f"""
, cand0 AS (
  SELECT {b}CAST(score AS DOUBLE) AS threshold, cum_pos AS tp, cum_n AS pp, tot_pos, tot_n FROM {lad}
  UNION
  {edges}
)
, cands AS (
  SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM (
    SELECT {b}threshold, tp, pp - tp AS fp, tot_pos - tp AS fn, tot_n - tot_pos - (pp - tp) AS tn,
           CASE WHEN pp > 0 THEN tp / pp ELSE 0.0 END AS precision,
           CASE WHEN tot_pos > 0 THEN tp / tot_pos ELSE 0.0 END AS recall
    FROM cand0)
)
"""


def pick(r: float, src: str = "cands") -> str:
    return (f"coalesce((SELECT threshold FROM {src} WHERE recall >= {r} ORDER BY precision DESC, recall DESC, threshold DESC LIMIT 1),"
            f" (SELECT threshold FROM {src} ORDER BY f1 DESC, recall DESC, threshold ASC LIMIT 1))")


def conf_cols(t: str) -> str:
    return (f"count_if(label = 1 AND score >= {t}) AS true_positives, count_if(label = 0 AND score >= {t}) AS false_positives, "
            f"count_if(label = 1 AND score < {t}) AS false_negatives, count_if(label = 0 AND score < {t}) AS true_negatives")


PR = ("round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END, 6) AS precision, "
      "round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END, 6) AS recall")

SQL["confusion"] = PREDS + f"SELECT fold, *, {PR} FROM (SELECT fold, {conf_cols('0.5')} FROM preds GROUP BY fold)".replace("SELECT fold, *,", "SELECT *,")

SQL["average_precision"] = PREDS + ladder_sql(["fold"]) + "SELECT fold, round(pr_auc, 6) AS pr_auc FROM lad_rank"
SQL["roc_auc"] = PREDS + ladder_sql(["fold"]) + "SELECT fold, round(roc_auc, 6) AS roc_auc FROM lad_rank"

SQL["brier"] = PREDS + """
, tp AS (SELECT f.p AS fold, avg(CAST(d.label AS DOUBLE)) AS prev
         FROM range(1, 5) AS f(p) JOIN a d ON d.first_train_fold <= f.p GROUP BY 1)
SELECT fold, round(b, 6) AS brier_score, round(r, 6) AS reference_brier, round(1 - b / r, 6) AS brier_skill
FROM (SELECT preds.fold, avg(pow(score - label, 2)) AS b, avg(pow(prev - label, 2)) AS r
      FROM preds JOIN tp ON tp.fold = preds.fold GROUP BY 1)"""

BIN = "((score >= 0.2)::INT + (score >= 0.4)::INT + (score >= 0.6000000000000001)::INT + (score >= 0.8)::INT)"

SQL["calibration_bins"] = PREDS + f"""
, spine AS (SELECT * FROM (VALUES (0, 0.0, 0.2), (1, 0.2, 0.4), (2, 0.4, 0.6000000000000001), (3, 0.6000000000000001, 0.8), (4, 0.8, 1.0))
            AS t(bin, lower, upper))
, g AS (SELECT DISTINCT fold FROM preds)
, agg AS (SELECT fold, {BIN} AS bin, count(*) AS rows, avg(score) AS mp, avg(CAST(label AS DOUBLE)) AS obs FROM preds GROUP BY 1, 2)
SELECT g.fold, spine.bin, round(CAST(spine.lower AS DOUBLE), 6) AS lower, round(CAST(spine.upper AS DOUBLE), 6) AS upper,
       coalesce(agg.rows, 0) AS rows, round(mp, 6) AS mean_probability, round(obs, 6) AS observed_rate
FROM g CROSS JOIN spine LEFT JOIN agg ON agg.fold = g.fold AND agg.bin = spine.bin"""

SQL["ece"] = PREDS + f"""
SELECT fold, round(sum(n * abs(p - y)) / sum(n), 6) AS expected_calibration_error
FROM (SELECT fold, {BIN} AS bin, count(*) AS n, avg(score) AS p, avg(CAST(label AS DOUBLE)) AS y FROM preds GROUP BY 1, 2) GROUP BY fold"""

SQL["operating_threshold"] = PREDS + ladder_sql([]) + cands_sql([]) + f"SELECT round({pick(0.7)}, 6) AS threshold"

POLICIES = """
SELECT * FROM (
  SELECT 'approximately_70_percent_recall' AS policy, {p70} AS threshold
  UNION ALL SELECT 'approximately_80_percent_recall', {p80}
  UNION ALL SELECT 'best_validation_f1', (SELECT threshold FROM cands ORDER BY f1 DESC, recall DESC, threshold ASC LIMIT 1)
  UNION ALL SELECT 'fn_cost_3x_fp', (SELECT threshold FROM cands ORDER BY 3 * fn + fp ASC, recall DESC, threshold ASC LIMIT 1))"""

SQL["threshold_policies"] = PREDS + ladder_sql([]) + cands_sql([]) + \
    "SELECT policy, round(threshold, 6) AS threshold FROM (" + POLICIES.format(p70=pick(0.7), p80=pick(0.8)) + ")"

SQL["policy_transfer"] = PREDS + """
, sel AS (SELECT * FROM preds WHERE fold < (SELECT max(fold) FROM preds))
, latest AS (SELECT * FROM preds WHERE fold = (SELECT max(fold) FROM preds))
""" + ladder_sql([], "sel") + cands_sql([], "sel") + ", pol AS (" + POLICIES.format(p70=pick(0.7), p80=pick(0.8)) + """)
SELECT policy, round(threshold, 6) AS threshold, true_positives, false_positives, false_negatives, true_negatives, """ + PR + """
FROM (SELECT policy, threshold,
             count_if(label = 1 AND score >= threshold) AS true_positives, count_if(label = 0 AND score >= threshold) AS false_positives,
             count_if(label = 1 AND score < threshold) AS false_negatives, count_if(label = 0 AND score < threshold) AS true_negatives
      FROM pol JOIN latest ON true GROUP BY 1, 2)"""


def eval_sql(by: list[str], t: str, src: str = "preds", name: str = "ev") -> str:
    """CTE ``{name}``: ranking metrics, Brier and confusion at ``t`` per group."""
    b = ", ".join(by)
    on = " AND ".join(f"r.{c} = c.{c}" for c in by) or "true"
    return ladder_sql(by, src, name + "_l") + f"""
, {name} AS (
  SELECT c.*, r.pr_auc, r.roc_auc FROM {name}_l_rank r JOIN (
    SELECT {b + ', ' if by else ''}avg(pow(score - label, 2)) AS brier_score, {conf_cols(t)}
    FROM {src} {'GROUP BY ' + b if by else ''}) c ON {on}
)
"""


EVAL_COLS = ("round(pr_auc, 6) AS pr_auc, round(roc_auc, 6) AS roc_auc, round(brier_score, 6) AS brier_score, "
             "true_positives, false_positives, false_negatives, true_negatives, " + PR)

POOLED = PREDS + ladder_sql([]) + cands_sql([]) + f", thr AS (SELECT {pick(0.7)} AS t)" + \
    eval_sql(["fold"], "(SELECT t FROM thr)") + eval_sql([], "(SELECT t FROM thr)", name="evp")

SQL["pooled_metrics"] = POOLED + f"""
SELECT 'fold_' || CAST(fold AS VARCHAR) AS scope, {EVAL_COLS}, round((SELECT t FROM thr), 6) AS threshold FROM ev
UNION ALL
SELECT 'pooled', {EVAL_COLS}, round((SELECT t FROM thr), 6) FROM evp"""

_SUMMARY_PARTS = []
for _m in ("pr_auc", "roc_auc", "brier_score", "precision", "recall", "false_positives", "false_negatives"):
    _SUMMARY_PARTS.append(
        f"SELECT '{_m}' AS metric, round(avg(CAST({_m} AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST({_m} AS DOUBLE)), 6) AS std, "
        f"round(min(CAST({_m} AS DOUBLE)), 6) AS min, round(max(CAST({_m} AS DOUBLE)), 6) AS max FROM evx")
SQL["fold_summary"] = POOLED + """
, evx AS (SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS precision,
                 CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS recall FROM ev)
""" + "\nUNION ALL\n".join(_SUMMARY_PARTS)

SQL["metrics_by_period"] = PREDS + eval_sql(["period"], "0.5") + f"""
, cal AS (SELECT period, sum(n * abs(p - y)) / sum(n) AS ece
          FROM (SELECT period, {BIN} AS bin, count(*) AS n, avg(score) AS p, avg(CAST(label AS DOUBLE)) AS y FROM preds GROUP BY 1, 2) GROUP BY period)
SELECT s.period, s.rows, s.entities, s.positives, round(s.prevalence, 6) AS prevalence, {EVAL_COLS}, round(cal.ece, 6) AS expected_calibration_error
FROM (SELECT period, count(*) AS rows, count(DISTINCT entity_id) AS entities, CAST(sum(label) AS BIGINT) AS positives,
             avg(CAST(label AS DOUBLE)) AS prevalence FROM preds GROUP BY 1) s JOIN ev ON ev.period = s.period JOIN cal ON cal.period = s.period"""

SQL["calibration_by_period"] = SQL["calibration_bins"].replace("fold FROM preds", "period FROM preds").replace("SELECT fold, ", "SELECT period, ") \
    .replace("g.fold", "g.period").replace("agg.fold", "agg.period")

SQL["subgroup_metrics"] = PREDS + """
, sp AS (SELECT *, CASE WHEN age IS NULL THEN 'imputed_age' ELSE 'observed_age' END AS subgroup FROM preds)
""" + eval_sql(["fold", "subgroup"], "0.5", "sp") + f"""
SELECT s.fold, s.subgroup, s.rows, s.ok AS metrics_available,
       CASE WHEN s.ok THEN round(pr_auc, 6) END AS pr_auc, CASE WHEN s.ok THEN round(roc_auc, 6) END AS roc_auc,
       CASE WHEN s.ok THEN round(brier_score, 6) END AS brier_score,
       CASE WHEN s.ok THEN round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END, 6) END AS precision,
       CASE WHEN s.ok THEN round(CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END, 6) END AS recall
FROM (SELECT fold, subgroup, count(*) AS rows, count(DISTINCT label) = 2 AS ok FROM sp GROUP BY 1, 2) s
LEFT JOIN ev ON ev.fold = s.fold AND ev.subgroup = s.subgroup"""

SQL["label_variants"] = with_(PANEL, history_ctes(), label_cte()) + """
SELECT entity_id, period, label,
       CASE WHEN lead(idx) OVER w = idx + 1 AND lead(unplanned_events) OVER w IS NOT NULL AND lead(severe_events) OVER w IS NOT NULL
            THEN CAST((lead(unplanned_events) OVER w >= 3 OR lead(severe_events) OVER w > 0) AS INTEGER) END AS label_secondary
FROM lab WINDOW w AS (PARTITION BY entity_id ORDER BY idx)"""

SQL["current_period_label"] = with_(PANEL) + """
SELECT entity_id, period, CAST((unplanned_events >= 5 OR severe_events > 0) AS INTEGER) AS current_label FROM panel"""

SQL["prevalence_populations"] = with_(PANEL, HOLDOUT) + """
, safe AS (SELECT * FROM panel WHERE period <= (SELECT h_start FROM bounds))
""" + "," + history_ctes("safe").strip("\n") + "," + label_cte().strip("\n") + """
, dev AS (SELECT * FROM lab WHERE period < (SELECT h_start FROM bounds) AND label IS NOT NULL)
, pops AS (
  SELECT 'all_eligible' AS population, * FROM dev
  UNION ALL SELECT 'history_1', * FROM dev WHERE consecutive_history_months >= 1
  UNION ALL SELECT 'history_4', * FROM dev WHERE consecutive_history_months >= 4
  UNION ALL SELECT 'history_6', * FROM dev WHERE consecutive_history_months >= 6
)
SELECT population, count(*) AS labeled_rows, count_if(label = 1) AS positive_rows, count_if(label = 0) AS negative_rows,
       round(count_if(label = 1) / count(*), 6) AS prevalence, count(DISTINCT entity_id) AS entities,
       (SELECT count(*) FROM lab WHERE label IS NULL) AS safe_source_unlabeled_rows
FROM pops GROUP BY population"""

_SAFE = with_(PANEL, HOLDOUT) + """
, safe AS (SELECT * FROM panel WHERE period <= (SELECT h_start FROM bounds))
""" + "," + history_ctes("safe").strip("\n")

SQL["prevalence_alternatives"] = _SAFE + """
, nx AS (
  SELECT entity_id, period, eligible_for_modeling AS e, unplanned_events AS u, severe_events AS s,
         lead(unplanned_events) OVER w AS nu, lead(severe_events) OVER w AS ns, lead(idx) OVER w = idx + 1 AS adjacent
  FROM hist WINDOW w AS (PARTITION BY entity_id ORDER BY idx)
)
, r AS (SELECT *, coalesce(adjacent, false) AND nu IS NOT NULL AND ns IS NOT NULL AS known FROM nx WHERE period < (SELECT h_start FROM bounds))
, d AS (
  SELECT 'next_period_with_excluded' AS definition, entity_id, CAST(nu >= 5 OR ns > 0 AS INTEGER) AS v FROM r WHERE known
  UNION ALL SELECT 'current_period_with_excluded', entity_id, CAST(u >= 5 OR s > 0 AS INTEGER) FROM r
  UNION ALL SELECT 'next_period_unplanned_only', entity_id, CAST(nu >= 5 AS INTEGER) FROM r WHERE known AND e
)
SELECT definition, count(*) AS labeled_rows, CAST(sum(v) AS BIGINT) AS positive_rows, CAST(count(*) - sum(v) AS BIGINT) AS negative_rows,
       round(avg(CAST(v AS DOUBLE)), 6) AS prevalence, count(DISTINCT entity_id) AS entities
FROM d GROUP BY definition"""

SQL["label_decomposition"] = _SAFE + """
, k AS (
  SELECT period, lead(unplanned_events) OVER w >= 5 AS a, lead(severe_events) OVER w > 0 AS b,
         coalesce(lead(idx) OVER w = idx + 1, false) AND lead(unplanned_events) OVER w IS NOT NULL
           AND lead(severe_events) OVER w IS NOT NULL AS known
  FROM hist WHERE eligible_for_modeling WINDOW w AS (PARTITION BY entity_id ORDER BY idx)
)
SELECT count(*) AS labeled_rows, count_if(a) AS unplanned_clause, count_if(b) AS severe_clause, count_if(a AND b) AS both_clauses,
       count_if(b AND NOT a) AS severe_only_extra, count_if(a OR b) AS positive_rows
FROM k WHERE known AND period < (SELECT h_start FROM bounds)"""

SQL["source_profile"] = with_(PANEL, EXPORT) + """
SELECT "Equipment Type" AS equipment_type, count(*) AS type_rows,
       (SELECT count(*) FROM export) AS rows, 22 AS columns,
       (SELECT min(strptime("Month", '%m/%d/%Y'))::DATE FROM export) AS first_month,
       (SELECT max(strptime("Month", '%m/%d/%Y'))::DATE FROM export) AS last_month,
       (SELECT count(DISTINCT "Equipment Code") FROM export) AS entities,
       (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM export GROUP BY "Equipment Code", "Month") WHERE n > 1) AS duplicate_keys
FROM export GROUP BY 1"""

_CANON_SELECT = SQL["canonicalize"].split("SELECT \"Month\", \"Borough\"", 1)
_CANON_BODY = "SELECT \"Month\", \"Borough\"" + _CANON_SELECT[1]
SQL["export_order"] = _CANON_SELECT[0] + ", canon AS (" + _CANON_BODY + """)
SELECT "Month", "Equipment Code", row_number() OVER (ORDER BY strptime("Month", '%m/%d/%Y') DESC, "Equipment Code") AS position FROM canon"""
SQL["snapshot_diff"] = _CANON_SELECT[0] + """
, regen AS (""" + _CANON_BODY + """)
, snap AS (""" + _CANON_BODY.replace("DATE '1996-01-01'", "DATE '1997-01-01'") + """)
SELECT (SELECT count(*) FROM (SELECT * FROM regen EXCEPT ALL SELECT * FROM snap)) AS left_only,
       (SELECT count(*) FROM (SELECT * FROM snap EXCEPT ALL SELECT * FROM regen)) AS right_only"""

SCORED = with_(PANEL, history_ctes(), label_cte(), features_cte(), HOLDOUT) + """
, scored AS (SELECT *, least(1.0, unplanned_events_roll_3_mean / 10.0) AS probability FROM feat WHERE consecutive_history_months >= 6)
, latest AS (SELECT *, CAST(period + INTERVAL 1 MONTH AS DATE) AS target_period FROM scored
             WHERE period = (SELECT max(period) FROM panel) AND label IS NULL)
"""

TIER = "CASE WHEN probability >= 0.4433219097353501 THEN 'high' WHEN probability >= 0.3 THEN 'medium' ELSE 'low' END"

SQL["prediction_table"] = SCORED + """
SELECT entity_id, period, round(probability, 6) AS probability, CAST(probability >= 0.4433219097353501 AS INTEGER) AS predicted,
       label AS actual
FROM scored WHERE label IS NOT NULL AND period BETWEEN (SELECT h_start FROM bounds) AND (SELECT h_end FROM bounds)"""

SQL["latest_unlabeled"] = SCORED + "SELECT entity_id, period, target_period, round(probability, 6) AS probability FROM latest"

SQL["risk_tiers"] = SCORED + f"SELECT entity_id, round(probability, 6) AS probability, {TIER} AS risk_tier FROM latest"
SQL["ranked_batch"] = "SELECT *, row_number() OVER (ORDER BY probability DESC, entity_id) AS position FROM (" + SQL["risk_tiers"] + ")"

SQL["tier_counts"] = SCORED + f"""
SELECT t.risk_tier, count(l.entity_id) AS rows
FROM (VALUES ('high'), ('medium'), ('low')) AS t(risk_tier) LEFT JOIN (SELECT *, {TIER} AS tier FROM latest) l ON l.tier = t.risk_tier
GROUP BY 1"""

SQL["scored_batch"] = SCORED + f"""
SELECT entity_id, period, target_period, round(probability, 6) AS probability, {TIER} AS risk_tier,
       CAST(probability >= 0.4433219097353501 AS INTEGER) AS predicted, 'rule_unplanned_r3' AS model_name,
       round(CAST(0.4433219097353501 AS DOUBLE), 6) AS threshold, round(avail_all_day, 6) AS avail_all_day
FROM latest"""

SQL["published_batch"] = SQL["scored_batch"]

SQL["run_summary"] = SCORED + """
, h AS (SELECT * FROM scored WHERE label IS NOT NULL AND period BETWEEN (SELECT h_start FROM bounds) AND (SELECT h_end FROM bounds))
SELECT period, count(*) AS rows, count(DISTINCT entity_id) AS entities, CAST(sum(label) AS BIGINT) AS positives,
       round(avg(CAST(label AS DOUBLE)), 6) AS prevalence, count(DISTINCT period) AS periods, 'period' AS scope
FROM h GROUP BY period
UNION ALL
SELECT NULL, count(*), count(DISTINCT entity_id), CAST(sum(label) AS BIGINT), round(avg(CAST(label AS DOUBLE)), 6),
       count(DISTINCT period), 'all' FROM h"""

FEATS42 = [*OPS] + [f"{c}_lag_{k}" for c in OPS for k in (1, 2, 3)]
FEATS42 = [*OPS] + [x for c in OPS for x in ([f"{c}_lag_{k}" for k in (1, 2, 3)] + [f"{c}_roll_{w}_mean" for w in (3, 6)])]
LAST_TRAIN = FOLD_ROWS + ", tr AS (SELECT * FROM a WHERE first_train_fold <= 4)\n"

SQL["median_impute"] = LAST_TRAIN + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, round(median(CAST({c} AS DOUBLE)), 6) AS median FROM tr" for c in FEATS42)


def _robust(c: str, src: str = "tr", fold: str | None = None) -> str:
    imp = f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM {src}))"
    f = f"{fold} AS fold, " if fold else ""
    return (f"SELECT {f}'{c}' AS feature, round(q[2], 6) AS center, round(CASE WHEN q[3] - q[1] <> 0 THEN q[3] - q[1] ELSE 1.0 END, 6) AS scale "
            f"FROM (SELECT quantile_cont({imp}, [0.25, 0.5, 0.75]) AS q FROM {src})")


SQL["robust_scale"] = LAST_TRAIN + "\nUNION ALL\n".join(_robust(c) for c in FEATS42)


def _audit(c: str, p: int) -> str:
    src = f"tr{p}"
    imp = f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM {src}))"
    return (f"SELECT {p} AS fold, '{c}' AS feature, round((SELECT median(CAST({c} AS DOUBLE)) FROM {src}), 6) AS median, "
            f"round(q[2], 6) AS center, round(CASE WHEN q[3] - q[1] <> 0 THEN q[3] - q[1] ELSE 1.0 END, 6) AS scale, "
            f"(SELECT count(*) FROM {src}) AS fit_rows, (SELECT min(period) FROM {src}) AS fit_start, (SELECT max(period) FROM {src}) AS fit_end "
            f"FROM (SELECT quantile_cont({imp}, [0.25, 0.5, 0.75]) AS q FROM {src})")


SQL["prep_audit"] = FOLD_ROWS + "".join(f", tr{p} AS (SELECT * FROM a WHERE first_train_fold <= {p})\n" for p in range(1, 5)) + \
    "\nUNION ALL\n".join(_audit(c, p) for p in range(1, 5) for c in FEATS42)

SQL["class_weights"] = FOLD_ROWS + """
SELECT f.p AS fold, count(*) AS rows, CAST(sum(d.label) AS BIGINT) AS positives,
       round(count(*) / (2.0 * (count(*) - sum(d.label))), 6) AS weight_negative, round(count(*) / (2.0 * sum(d.label)), 6) AS weight_positive
FROM range(1, 5) AS f(p) JOIN a d ON d.first_train_fold <= f.p GROUP BY 1"""

SQL["onehot"] = FOLD_ROWS + """
, tr AS (SELECT * FROM a WHERE first_train_fold <= 4)
, fill AS (SELECT month(period) AS m FROM tr GROUP BY 1 ORDER BY count(*) DESC, m ASC LIMIT 1)
, lv AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS slot FROM (SELECT DISTINCT month(period) AS m FROM tr WHERE period IS NOT NULL))
SELECT entity_id, period, coalesce(slot, -1) AS slot, (SELECT count(*) FROM lv) AS width, CAST(slot IS NOT NULL AS INTEGER) AS hot
FROM a LEFT JOIN lv ON lv.m = coalesce(month(a.period), (SELECT m FROM fill)) WHERE validation_fold = 4"""

SQL["baseline_scores"] = FOLD_ROWS + """
, prev AS (SELECT f.p AS fold, CAST(sum(d.label) AS BIGINT) / count(*) AS cp FROM range(1, 5) AS f(p) JOIN a d ON d.first_train_fold <= f.p GROUP BY 1)
, v AS (SELECT validation_fold AS fold, entity_id, period, label, unplanned_events, severe_events FROM a WHERE validation_fold IS NOT NULL)
SELECT v.fold, entity_id, period, label, 'constant_prevalence' AS baseline, round(cp, 6) AS score FROM v JOIN prev ON prev.fold = v.fold
UNION ALL SELECT fold, entity_id, period, label, 'previous_period_failure', CAST((unplanned_events >= 5 OR severe_events > 0) AS DOUBLE) FROM v
UNION ALL SELECT fold, entity_id, period, label, 'simple_outage_rule', CAST(unplanned_events >= 1 AS DOUBLE) FROM v"""

_SEQ_STEPS = SQL["sequence_windows"]
SQL["sequence_scale"] = "WITH st AS (" + _SEQ_STEPS.replace("round(l.avail_peak_am, 6)", "l.avail_peak_am").replace(
    "round(l.avail_peak_pm, 6)", "l.avail_peak_pm").replace("round(l.avail_all_day, 6)", "l.avail_all_day") + ")\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS channel, round((SELECT median({c}) FROM st), 6) AS median, round(q[2], 6) AS center, "
    f"round(CASE WHEN q[3] - q[1] <> 0 THEN q[3] - q[1] ELSE 1.0 END, 6) AS scale "
    f"FROM (SELECT quantile_cont(coalesce({c}, (SELECT median({c}) FROM st)), [0.25, 0.5, 0.75]) AS q FROM st)" for c in OPS)

SQL["matched_cohort"] = DEV_CTES + "SELECT entity_id, period, label FROM dev WHERE consecutive_history_months >= 12"

ZOO = FOLD_ROWS + """
, v AS (SELECT validation_fold AS fold, entity_id, period, label, unplanned_events_roll_3_mean AS u3, unplanned_events_roll_6_mean AS u6,
               total_events_roll_3_mean AS t3, unplanned_events, severe_events FROM a WHERE validation_fold IS NOT NULL)
, zp AS (
  SELECT 'rule_unplanned_r3' AS model, fold, entity_id, period, label, least(1.0, u3 / 10.0) AS score FROM v
  UNION ALL SELECT 'rule_unplanned_r6', fold, entity_id, period, label, least(1.0, u6 / 10.0) FROM v
  UNION ALL SELECT 'rule_total_r3', fold, entity_id, period, label, least(1.0, t3 / 20.0) FROM v
  UNION ALL SELECT 'previous_period_failure', fold, entity_id, period, label, CAST((unplanned_events >= 5 OR severe_events > 0) AS DOUBLE) FROM v
  UNION ALL SELECT 'simple_outage_rule', fold, entity_id, period, label, CAST(unplanned_events >= 1 AS DOUBLE) FROM v
)
""" + eval_sql(["model", "fold"], "0.5", "zp") + """
, mt AS (SELECT *, CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) ELSE 0.0 END AS precision,
                CASE WHEN true_positives + false_negatives > 0 THEN true_positives / (true_positives + false_negatives) ELSE 0.0 END AS recall FROM ev)
, summ AS (
  SELECT model, avg(CASE WHEN fold < 4 THEN pr_auc END) AS selection_mean_pr_auc, avg(pr_auc) AS all_fold_mean_pr_auc,
         stddev_pop(pr_auc) AS all_fold_std_pr_auc, min(pr_auc) AS worst_fold_pr_auc,
         max(CASE WHEN fold = 4 THEN pr_auc END) AS latest_fold_pr_auc, max(CASE WHEN fold = 4 THEN precision END) AS latest_precision,
         max(CASE WHEN fold = 4 THEN recall END) AS latest_recall, max(CASE WHEN fold = 4 THEN false_positives END) AS latest_false_positives,
         max(CASE WHEN fold = 4 THEN false_negatives END) AS latest_false_negatives
  FROM mt GROUP BY model
)
, weak AS (SELECT fold, avg(pr_auc) AS m FROM mt WHERE model NOT IN ('previous_period_failure', 'simple_outage_rule') GROUP BY fold ORDER BY m LIMIT 1)
"""

SQL["weak_fold"] = ZOO + "SELECT fold AS weak_fold, round(m, 6) AS mean_pr_auc FROM weak"

SQL["model_comparison"] = ZOO + """
SELECT model, round(selection_mean_pr_auc, 6) AS selection_mean_pr_auc, round(all_fold_mean_pr_auc, 6) AS all_fold_mean_pr_auc,
       round(all_fold_std_pr_auc, 6) AS all_fold_std_pr_auc, round(worst_fold_pr_auc, 6) AS worst_fold_pr_auc,
       round(latest_fold_pr_auc, 6) AS latest_fold_pr_auc, round(latest_precision, 6) AS latest_precision,
       round(latest_recall, 6) AS latest_recall, latest_false_positives, latest_false_negatives FROM summ"""

SQL["candidate_ranking"] = ZOO + """
SELECT model, round(selection_mean_pr_auc, 6) AS selection_mean_pr_auc, round(all_fold_std_pr_auc, 6) AS all_fold_std_pr_auc,
       CAST(row_number() OVER (ORDER BY selection_mean_pr_auc DESC, all_fold_std_pr_auc ASC, model) AS INTEGER) AS rank,
       selection_mean_pr_auc >= (SELECT max(selection_mean_pr_auc) FROM summ) - 0.01 AS within_materiality
FROM summ"""

SQL["replace_rule"] = ZOO + """
SELECT 'rule_unplanned_r3' AS incumbent, 'rule_unplanned_r6' AS challenger, round(c.selection_mean_pr_auc - i.selection_mean_pr_auc, 6) AS selection_gain,
       (c.selection_mean_pr_auc - i.selection_mean_pr_auc >= 0.01)
         OR (c.latest_false_negatives < i.latest_false_negatives AND c.latest_false_positives <= i.latest_false_positives) AS replace
FROM summ i JOIN summ c ON i.model = 'rule_unplanned_r3' AND c.model = 'rule_unplanned_r6'"""

SQL["readiness_gate"] = ZOO + """
SELECT round(b, 6) AS best_baseline_pr_auc, round(w, 6) AS weakest_model_pr_auc, w > b AND w >= 0.45 AS ready
FROM (SELECT max(CASE WHEN model IN ('previous_period_failure', 'simple_outage_rule') THEN all_fold_mean_pr_auc END) AS b,
             min(CASE WHEN model NOT IN ('previous_period_failure', 'simple_outage_rule') THEN all_fold_mean_pr_auc END) AS w FROM summ)"""

SQL["cohort_profile"] = ZOO + """
, fp AS (SELECT entity_id, min(period) AS first FROM dev GROUP BY 1)
SELECT CASE WHEN validation_fold = (SELECT fold FROM weak) THEN 'weak_fold' ELSE 'other_folds' END AS cohort,
       count(*) AS rows, count(DISTINCT a.entity_id) AS entities, round(avg(CAST(label AS DOUBLE)), 6) AS prevalence,
       count_if(period = fp.first) AS new_entity_rows, """ + ", ".join(
    f"round(avg(CAST({c} IS NULL AS DOUBLE)), 6) AS null_share_{c}" for c in FEATS42) + """
FROM a JOIN fp ON fp.entity_id = a.entity_id WHERE validation_fold IS NOT NULL GROUP BY 1"""

SQL["feature_drift"] = ZOO + """
, va AS (SELECT *, validation_fold = (SELECT fold FROM weak) AS w FROM a WHERE validation_fold IS NOT NULL)
, d AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, avg(CASE WHEN w THEN CAST({c} AS DOUBLE) END) AS wm, avg(CASE WHEN NOT w THEN CAST({c} AS DOUBLE) END) AS om, "
    f"stddev_pop(CAST({c} AS DOUBLE)) AS s FROM va" for c in FEATS42) + """)
SELECT feature, round(wm, 6) AS weak_fold_mean, round(om, 6) AS other_folds_mean, round(smd, 6) AS standardized_mean_difference
FROM (SELECT *, CASE WHEN s = 0 THEN 0.0 ELSE (wm - om) / s END AS smd FROM d)
ORDER BY abs(smd) DESC, feature LIMIT 15"""

WEAK_ERR = ZOO + """
, sel AS (SELECT * FROM zp WHERE model = 'rule_unplanned_r3' AND fold < 4)
""" + ladder_sql([], "sel") + cands_sql([], "sel") + f"""
, thr AS (SELECT {pick(0.7)} AS t)
, werr AS (SELECT *, CAST(CAST(score >= (SELECT t FROM thr) AS INTEGER) <> label AS INTEGER) AS error
           FROM zp WHERE model = 'rule_unplanned_r3' AND fold = (SELECT fold FROM weak))
"""

SQL["error_top_entities"] = WEAK_ERR + """
, top AS (SELECT entity_id, CAST(sum(error) AS BIGINT) AS errors FROM werr GROUP BY 1 ORDER BY errors DESC, entity_id LIMIT 10)
SELECT entity_id, errors, round((SELECT sum(errors) FROM top) / greatest((SELECT sum(error) FROM werr), 1), 6) AS top_10_share FROM top"""

SQL["error_by_period"] = WEAK_ERR + "SELECT period, CAST(sum(error) AS BIGINT) AS errors, count(*) AS rows FROM werr GROUP BY 1"

_PAIRS = [(x, y) for i, x in enumerate(FEATS42) for y in FEATS42[i + 1:]]
SQL["high_correlation"] = LAST_TRAIN + ", pc AS (" + "\nUNION ALL\n".join(
    f"SELECT '{x}' AS feature_a, '{y}' AS feature_b, abs(corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))) AS r FROM tr" for x, y in _PAIRS) + \
    ")\nSELECT feature_a, feature_b, round(r, 6) AS absolute_correlation FROM pc WHERE r >= 0.95"

SQL["correlation_pairs"] = SQL["high_correlation"].replace("r >= 0.95", "r >= 0.3")

SQL["ranking_orders"] = ZOO + """
SELECT model, CAST(row_number() OVER (ORDER BY selection_mean_pr_auc DESC, all_fold_std_pr_auc, model) AS INTEGER) AS by_selection,
       CAST(row_number() OVER (ORDER BY all_fold_mean_pr_auc DESC, worst_fold_pr_auc DESC, all_fold_std_pr_auc, model) AS INTEGER) AS by_worst_fold,
       CAST(row_number() OVER (ORDER BY all_fold_mean_pr_auc DESC, latest_fold_pr_auc DESC, model) AS INTEGER) AS by_latest_fold
FROM summ"""

# isotonic regression without pooling: the fit at i is the largest over starts of the least over ends of the range averages
SQL["isotonic_rule"] = FOLD_ROWS + """
, sc AS (SELECT *, least(1.0, unplanned_events_roll_3_mean / 10.0) AS score FROM a)
, c AS (SELECT p AS fold, score, sum(label) AS y, count(*) AS n FROM sc JOIN range(1, 5) AS f(p) ON back BETWEEN (4 - p) * 3 + 3 AND (4 - p) * 3 + 5
        WHERE score IS NOT NULL GROUP BY 1, 2)
, r AS (SELECT *, sum(y) OVER w AS cy, sum(n) OVER w AS cn, row_number() OVER w AS i FROM c WINDOW w AS (PARTITION BY fold ORDER BY score))
, g AS (SELECT x.fold, x.i AS i0, z.i AS i1, CAST(z.cy - x.cy + x.y AS DOUBLE) / CAST(z.cn - x.cn + x.n AS DOUBLE) AS v FROM r x JOIN r z ON x.fold = z.fold AND x.i <= z.i)
, m AS (SELECT r.fold, r.i, r.score, g.i0, min(g.v) AS v FROM r JOIN g ON g.fold = r.fold AND g.i0 <= r.i AND g.i1 >= r.i GROUP BY 1, 2, 3, 4)
, fit AS (SELECT fold, score, max(v) AS fit FROM m GROUP BY fold, i, score)
, v AS (SELECT validation_fold AS fold, entity_id, period, label, score FROM sc WHERE validation_fold IS NOT NULL)
, lo AS (SELECT v.*, fit.score AS s0, fit.fit AS f0 FROM v ASOF LEFT JOIN fit ON v.fold = fit.fold AND v.score >= fit.score)
, both_ AS (SELECT lo.*, fit.score AS s1, fit.fit AS f1 FROM lo ASOF LEFT JOIN fit ON lo.fold = fit.fold AND lo.score <= fit.score)
SELECT fold, entity_id, period, label, round(CASE WHEN s0 IS NULL THEN f1 WHEN s1 IS NULL THEN f0 WHEN s0 = s1 THEN f0
       ELSE f0 + (f1 - f0) * (score - s0) / (s1 - s0) END, 6) AS score FROM both_"""

SQL["stage_comparison"] = LABELED_FEAT + """
, st0 AS (SELECT entity_id, period, label, least(1.0, unplanned_events_roll_3_mean / 10.0) AS score,
                 (SELECT CAST(h_start - INTERVAL 6 MONTH AS DATE) FROM bounds) AS a, (SELECT CAST(h_end - INTERVAL 6 MONTH AS DATE) FROM bounds) AS z FROM lf)
, st AS (SELECT entity_id, period, label, score, CASE WHEN period > z THEN 'prospective' WHEN period >= a THEN 'holdout' ELSE 'development' END AS stage
         FROM st0 WHERE period >= CAST(a - INTERVAL 3 MONTH AS DATE))
""" + eval_sql(["stage"], "0.5", "st", "sev") + f"""
SELECT s.stage, s.rows, s.entities, round(s.prevalence, 6) AS prevalence, {EVAL_COLS}
FROM (SELECT stage, count(*) AS rows, count(DISTINCT entity_id) AS entities, avg(CAST(label AS DOUBLE)) AS prevalence FROM st GROUP BY 1) s
JOIN sev ON sev.stage = s.stage"""

SQL["fold_overlap"] = FOLD_ROWS + """
SELECT CAST(f.p AS INTEGER) AS position,
       max(CASE WHEN first_train_fold <= f.p THEN period END) AS train_last_period,
       min(CASE WHEN validation_fold = f.p THEN period END) AS validation_first_period,
       max(CASE WHEN first_train_fold <= f.p THEN period END) >= min(CASE WHEN validation_fold = f.p THEN period END) AS date_overlap,
       count_if(validation_fold = f.p AND first_train_fold <= f.p) AS row_overlap_rows,
       count_if((first_train_fold <= f.p OR validation_fold = f.p)
                AND period BETWEEN (SELECT h_start FROM bounds) AND (SELECT h_end FROM bounds)) AS holdout_rows
FROM range(1, 5) AS f(p), a GROUP BY f.p"""


from .sources.tables import FLOAT_LISTS, FLOATS, TABLES, TIMES  # noqa: E402


def _spelled(c: str) -> str:
    if c in FLOATS:
        text = f"CAST(CAST(round(CAST({c} AS DOUBLE) * 1000000) AS DECIMAL(38,0)) AS VARCHAR)"
    elif c in FLOAT_LISTS:
        text = f"array_to_string(list_transform({c}, lambda x: CAST(CAST(round(CAST(x AS DOUBLE) * 1000000) AS DECIMAL(38,0)) AS VARCHAR)), ';')"
    elif c in TIMES:
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')"
    else:
        text = f"CAST({c} AS VARCHAR)"
    return f"coalesce(length({text}) || '=' || {text}, '-')"


SQL["table_fingerprint"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS \"table\", count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(" + " || '|' || ".join(map(_spelled, cols)) + f"), 1, 15) AS BIGINT)) AS VARCHAR) AS hash_sum FROM {t}"
    for t, cols in TABLES.items())
