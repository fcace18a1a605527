from pyspark.sql import functions as F

from panelcast.operators.history import add_consecutive_history, add_eligibility_flags, add_feature_set_eligibility
from panelcast.operators.labels import add_next_period_label
from panelcast.spec import PRIMARY_RULE, LabelRule

from conftest import month


def _by(df, spec, *cols):
    return {(r[0], r[1]): tuple(r[2:]) for r in df.select(spec.entity, spec.period, *cols).collect()}


def test_excluded_suffix_is_kept_with_reason(monthly, spec):
    df = monthly.withColumn(spec.entity, F.when(F.col(f"`{spec.entity}`") == "EL002", "EL002X").otherwise(F.col(f"`{spec.entity}`")))
    out = add_eligibility_flags(df, spec, ("X",))
    rows = out.where(F.col(f"`{spec.entity}`") == "EL002X").select("eligible_for_modeling", "eligibility_reason").distinct().collect()
    assert [tuple(r) for r in rows] == [(False, "excluded_equipment_suffix")]
    assert out.count() == 18


def test_minimum_history_and_consecutive_counts(monthly, spec):
    first6 = monthly.where((F.col(f"`{spec.entity}`") == "EL001") & (F.col(spec.period) <= month(5)))
    h = add_feature_set_eligibility(add_consecutive_history(add_eligibility_flags(first6, spec, ("X",)), spec), spec, 4)
    got = [tuple(r) for r in h.orderBy(spec.period).select("consecutive_history_months", "eligible_for_feature_set").collect()]
    assert got == [(1, False), (2, False), (3, False), (4, True), (5, True), (6, True)]


def test_history_resets_after_gap_and_label_unknown(monthly, spec):
    gap = monthly.where(~((F.col(f"`{spec.entity}`") == "EL001") & (F.col(spec.period) == month(3))))
    h = _by(add_consecutive_history(gap, spec), spec, "consecutive_history_months")
    assert h[("EL001", month(4))] == (1,)
    lab = _by(add_next_period_label(gap, spec, PRIMARY_RULE), spec, PRIMARY_RULE.name)
    assert lab[("EL001", month(2))] == (None,)


def test_last_row_unknown_and_or_definition(monthly, spec):
    lab = _by(add_next_period_label(monthly, spec, PRIMARY_RULE), spec, PRIMARY_RULE.name)
    assert lab[("EL001", month(8))] == (None,) and lab[("EL002", month(8))] == (None,)
    assert lab[("EL001", month(3))] == (1,)  # next month has 2 unscheduled outages
    assert lab[("EL001", month(4))] == (0,)
    assert lab[("EL002", month(4))] == (1,)  # next month has an entrapment (severe > 0)


def test_unknown_never_zero_with_null_outcome(spark, monthly, spec):
    df = monthly.withColumn(spec.severe, F.when(F.col(spec.period) == month(2), F.lit(None)).otherwise(F.col(f"`{spec.severe}`")))
    lab = _by(add_next_period_label(df, spec, LabelRule(2, 0, "y")), spec, "y")
    assert lab[("EL001", month(1))] == (None,)
