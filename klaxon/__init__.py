"""klaxon: alert rules over tables and streams, as Spark DataFrames."""

from .model import (
    Expression,
    PatternMatch,
    Rule,
    SqlReturnsRows,
    Threshold,
    WindowAggregate,
    register_condition,
)
from .plans.alerting import AlertPlan, Subscribers, plan_alerts

__all__ = [
    "AlertPlan", "Expression", "PatternMatch", "Rule", "SqlReturnsRows", "Subscribers", "Threshold",
    "WindowAggregate", "plan_alerts", "register_condition",
]
