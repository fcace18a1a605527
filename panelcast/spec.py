"""Panel description and fixed parameters.

A panel is one row per (entity, period). ``PanelSpec`` names the columns so the
same operators run on the official export layout and on panels derived from
the driver's tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class PanelSpec:
    entity: str = "entity_id"
    period: str = "period"
    total: str = "total_events"
    planned: str = "planned_events"
    unplanned: str = "unplanned_events"
    severe: str = "severe_events"
    ratios: tuple[str, ...] = ("avail_peak_am", "avail_peak_pm", "avail_all_day")
    age: str | None = "age"
    grain: str = "month"  # "month" or "day"
    label: str = "label"

    @property
    def counts(self) -> tuple[str, ...]:
        return (self.total, self.planned, self.unplanned, self.severe)

    @property
    def operational(self) -> tuple[str, ...]:
        """Current-period operational columns in the fixed order."""
        return (self.total, self.unplanned, self.planned, self.severe, *self.ratios)

    @property
    def key(self) -> tuple[str, str]:
        return (self.entity, self.period)


@dataclass(frozen=True)
class FeatureSet:
    name: str
    lags: tuple[int, ...] = ()
    windows: tuple[int, ...] = ()
    include_age: bool = False
    include_season: bool = False

    @property
    def minimum_history(self) -> int:
        """Consecutive periods needed for fully observed features."""
        return max(1, max(self.lags, default=0) + 1, max(self.windows, default=1))


@dataclass(frozen=True)
class LabelRule:
    """Next-period label: unplanned >= threshold OR severe > threshold."""

    unplanned_threshold: int = 2
    severe_threshold: int = 0
    name: str = "label"


# Fixed values that must equal the reference's configuration.
EXPORT_SPEC = PanelSpec(
    entity="Equipment Code",
    period="Month",
    total="Total Outages",
    planned="Scheduled Outages",
    unplanned="Unscheduled Outages",
    severe="Entrapments",
    ratios=("AM Peak Availability", "PM Peak Availability", "24-Hour Availability"),
    age="Time Since Major Improvement",
    label="failure_next_month",
)
CANONICAL_COLUMNS = (
    "Month", "Borough", "Equipment Type", "Equipment Code", "Total Outages", "Scheduled Outages",
    "Unscheduled Outages", "Entrapments", "Time Since Major Improvement", "AM Peak Availability",
    "AM Peak Hours Available", "AM Peak Total Hours", "PM Peak Availability", "PM Peak Hours Available",
    "PM Peak Total Hours", "24-Hour Availability", "24-Hour Hours Available", "24-Hour Total Hours",
    "Station Name", "Station MRN", "Station Complex Name", "Station Complex MRN",
)
REQUIRED_COLUMNS = (
    "Month", "Equipment Code", "Total Outages", "Scheduled Outages", "Unscheduled Outages",
    "Entrapments", "Time Since Major Improvement", "AM Peak Availability", "PM Peak Availability",
    "24-Hour Availability",
)
PRIMARY_RULE = LabelRule(unplanned_threshold=2, severe_threshold=0, name="failure_next_month")
SECONDARY_RULE = LabelRule(unplanned_threshold=1, severe_threshold=0, name="failure_next_month_secondary")
FEATURE_SETS = {
    "current_only": FeatureSet("current_only"),
    "short_history": FeatureSet("short_history", lags=(1, 2, 3), windows=(3,)),
    "full_history": FeatureSet("full_history", lags=(1, 2, 3), windows=(3, 6)),
}
EXCLUDED_SUFFIXES = ("X",)
HOLDOUT_START, HOLDOUT_END = "2025-02-01", "2025-04-01"
VALIDATION_MONTHS, FOLD_COUNT = 3, 4
RISK_TIER_HIGH, RISK_TIER_MEDIUM = 0.4433219097353501, 0.30
MINIMUM_AP = 0.45
CALIBRATION_GAIN = 0.005
MATERIAL_AP_GAIN = 0.01
FROZEN_ACKNOWLEDGMENT = "I_UNDERSTAND_THIS_ACCESSES_THE_FROZEN_TEST_SET"
LOGISTIC_GRID = (("l2", 0.1), ("l2", 0.3), ("l2", 1.0), ("l2", 3.0), ("l1", 0.1), ("l1", 0.3), ("l1", 1.0))
FOREST_SEEDS = (7, 21, 42, 84, 168)
AGE_INCREMENT_BAND = (20, 40)


def feature_prefix(column: str) -> str:
    """Generated-column naming rule: lower case, drop '-', spaces to '_'."""
    return column.lower().replace("-", "").replace(" ", "_")


@dataclass(frozen=True)
class RunConfig:
    """Parameters of one development run on a panel."""

    spec: PanelSpec = field(default_factory=PanelSpec)
    rule: LabelRule = field(default_factory=LabelRule)
    feature_set: FeatureSet = FEATURE_SETS["full_history"]
    excluded_suffixes: tuple[str, ...] = ()
    holdout_months: int = 3
    validation_months: int = 3
    fold_count: int = 4

# The reference's tree grids in Spark terms. No depth limit is Spark's largest depth, 30;
# 7, 15 and 31 leaf nodes are depths 3, 4 and 5. Spark's boosting has no L2 term, so candidates that
# differ by it alone coincide; all twelve are kept.
def _forest(trees: int, depth: int, leaf: int, features: str) -> dict:
    return {"numTrees": trees, "maxDepth": depth, "minInstancesPerNode": leaf, "featureSubsetStrategy": features}


def _boosting(iterations: int, step: float, depth: int, leaf: int, bins: int) -> dict:
    return {"maxIter": iterations, "stepSize": step, "maxDepth": depth, "minInstancesPerNode": leaf, "maxBins": bins}


FOREST_GRID = (_forest(300, 30, 5, "sqrt"), _forest(600, 30, 5, "sqrt"), _forest(300, 12, 5, "sqrt"), _forest(300, 20, 5, "0.5"),
               _forest(300, 30, 10, "sqrt"), _forest(600, 30, 10, "0.5"), _forest(300, 12, 15, "0.5"), _forest(600, 20, 15, "sqrt"))
LOCKED_FOREST = FOREST_GRID[-1]
BOOSTING_GRID = (_boosting(150, 0.10, 4, 20, 255), _boosting(300, 0.05, 4, 20, 255), _boosting(500, 0.03, 4, 20, 255), _boosting(150, 0.10, 3, 20, 255),
                 _boosting(300, 0.05, 3, 40, 255), _boosting(500, 0.03, 3, 40, 255), _boosting(150, 0.10, 5, 20, 255), _boosting(300, 0.05, 5, 40, 255),
                 _boosting(300, 0.05, 4, 10, 255), _boosting(300, 0.05, 4, 40, 255), _boosting(300, 0.05, 4, 20, 63), _boosting(500, 0.03, 5, 40, 63))
