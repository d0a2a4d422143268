"""What the checks expect, written out: check SQL must not borrow values from the code it checks.

``pkgutil`` imports this module with the bindings; it registers nothing.
"""

from __future__ import annotations

# fixed values: impact columns behind each basis-point measure
IMPACTS = {
    "execution": ("labor_impact", "capacity_impact"),
    "event": ("event_impact",),
    "constraint": ("constraint_impact",),
    "unallocated": ("unallocated_impact",),
    "complexity": ("complexity_impact",),
    "training": ("training_impact",),
    "downtime": ("downtime_impact",),
    "planning": ("planning_impact",),
}
# fixed values: rows of the KPI board, each with the measure it shows
BOARD = (
    ("Output", "Speed", "Performance Impact", "Execution", "bps", "execution_bps"),
    ("Output", "Speed", "Performance Impact", "Training", "bps", "training_bps"),
    ("Output", "Speed", "Performance Impact", "Planning", "bps", "planning_bps"),
    ("Output", "Speed", "Performance Impact", "Capacity Constraint", "bps", "constraint_bps"),
    ("Output", "Speed", "Performance Impact", "Complexity", "bps", "complexity_bps"),
    ("Output", "Speed", "Performance Impact", "Event", "bps", "event_bps"),
    ("Output", "Speed", "Performance Impact", "Unallocated", "bps", "unallocated_bps"),
    ("Output", "Speed", "Performance Impact", "Downtime", "bps", "downtime_bps"),
    ("Output", "Quality", "Quality Metrics", "Defect Units", "units", "quality_miss_units"),
    ("Output", "Cost", "Staffing Hours", "Overstaffing Hours Not Actioned", "hours", "os_hrs_not_actioned"),
    ("Output", "Cost", "Staffing Hours", "Overstaffing Hours Unplanned", "hours", "os_hrs_unplanned"),
    ("Output", "Cost", "Staffing Cost", "Overstaffing Cost Not Actioned", "cost", "os_cost_not_actioned"),
)
# fixed values: staffing measures by the name they are reported under
STAFFING = {
    "os_hrs_not_actioned": "overstaffing_hours_not_actioned",
    "os_hrs_unplanned": "overstaffing_hours_unplanned",
    "os_hrs_not_adopted": "overstaffing_hours_not_adopted",
    "os_cost_not_actioned": "overstaffing_cost_not_actioned",
    "os_cost_unplanned": "overstaffing_cost_unplanned",
    "os_cost_not_adopted": "overstaffing_cost_not_adopted",
    "us_hrs_not_actioned": "understaffing_hours_not_actioned",
    "us_hrs_unplanned": "understaffing_hours_unplanned",
    "us_hrs_not_adopted": "understaffing_hours_not_adopted",
    "us_cost_not_actioned": "understaffing_cost_not_actioned",
    "us_cost_unplanned": "understaffing_cost_unplanned",
    "us_cost_not_adopted": "understaffing_cost_not_adopted",
}
# fixed values: subcategory order, metric order, subcategory, metric, unit, measure
HIERARCHY = (
    (1, 1, "Speed", "Performance Metric A", "bps", "metric_a_bps"),
    (1, 2, "Speed", "Performance Metric B", "bps", "metric_b_bps"),
    (1, 3, "Speed", "Performance Metric C", "bps", "metric_c_bps"),
    (1, 4, "Speed", "Performance Metric D", "bps", "metric_d_bps"),
    (1, 5, "Speed", "Performance Metric E", "bps", "metric_e_bps"),
    (3, 1, "Quality", "Quality Events", "DPMO", "total_event_units"),
    (4, 1, "Cost", "Resource Hours Type 1", "hours", "total_buffer_hours"),
    (4, 2, "Cost", "Resource Hours Type 2", "hours", "total_buffer_hours"),
    (4, 3, "Cost", "Resource Hours Type 3", "hours", "total_buffer_hours"),
    (4, 4, "Cost", "Buffer Management", "%", "total_buffer_hours"),
    (4, 5, "Cost", "Resource Hours Type 4", "hours", "total_buffer_hours"),
    (4, 6, "Cost", "Resource Hours Type 5", "hours", "total_buffer_hours"),
)
# fixed values: parts of the total task score
SCORES = (
    "execution_score",
    "compliance_score",
    "event_score",
    "capacity_score",
    "uncategorized_score",
    "accuracy_score",
    "workload_score",
    "planning_score",
)
# fixed values: industry names as they are repaired
REPAIRS = {
    "Artificial Intelligence": "Artificial intelligence",
    "Data management and analytics": "Data management & analytics",
    "FinTech": "Fintech",
}
# fixed values: rates that are compared
RATES = ("predicted_rate", "actual_rate", "planned_rate")
