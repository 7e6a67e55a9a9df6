"""From signals to an action: an ordered rule table evaluated as one conditional."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from shelfline import messages
from shelfline.functions.guards import (ended, filled, fixed_texts, holds, number, quoted, ratio, staged,
                                        texts)
from shelfline.params import DEFAULTS, Params

# Order of urgency used by rankings; unknown priorities sort last.
PRIORITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NONE"]
UNRANKED = 99

# The reasons that a rule itself gives, reported before all others.
PRIMARY_REASONS = ["DATA_INCOMPLETE", "CONFLICT_STOCKOUT", "CONFLICT_EXCESS", "CONFLICT_MONITOR",
                   "COVERAGE_BELOW_LEAD", "STOCKOUT_ELEVATED", "STOCKOUT_PRESENT", "VOLATILE_COVERED",
                   "ZERO_DEMAND_EXCESS", "ZERO_DEMAND", "EXCESS_SIGNIFICANT", "EXCESS_PRESENT",
                   "INCREASING_LOW_COVER", "DECREASING_HIGH_COVER", "RISK_HIGH", "RISK_MEDIUM",
                   "LOW_COVER_BUFFER", "HEALTHY"]

# The numbers behind a recommendation, in their order.
EVIDENCE = ["stockout_probability", "days_remaining", "lead_time_demand", "reorder_point",
            "reorder_quantity", "target_stock", "excess_units", "excess_inventory_value",
            "revenue_at_risk", "profit_at_risk", "risk_level", "risk_score"]


@dataclass(frozen=True)
class Context:
    """What the rules read beside planning, financial and risk results: columns or literals."""

    mean: str = "mean_demand"
    cv: str = "cv"
    trend: str = "trend"
    strength: str = "trend_strength"
    observations: str = "observation_count"
    inventory: str = "current_inventory"
    lead: str = "lead_time_days"
    # optional wider context
    category: str | None = None
    category_level: str | None = None
    overall_status: str | None = None


def _gate(context: Context, p: str) -> list[tuple[str, str]]:
    """What makes a recommendation impossible, with its wording."""
    return [
        (f"{context.observations} = 0", messages.GATE_NO_DEMAND),
        (f"{p}lead_time_demand is null", messages.GATE_NO_LEAD_DEMAND),
        (f"{p}target_stock is null", messages.GATE_NO_TARGET),
        (f"{p}risk_score is null", messages.GATE_NO_SCORE),
        (f"{context.inventory} is null", messages.GATE_NO_INVENTORY),
    ]


def _rules(context: Context, params: Params, p: str) -> list[tuple[str, str, str, str, str]]:
    """(branch, condition, action, priority, reason) in order of precedence, over `_signals`."""
    def above(value: str, limit: float) -> str:
        return f"{value} > {number(limit)}"

    chance, excess, cover = f"{p}stockout_probability", f"{p}excess_ratio", f"{p}coverage_ratio"
    short, over, severe = f"{p}stockout_signal", f"{p}excess_signal", f"{p}severe_signal"
    rising, idle = f"{p}rising_signal", f"{p}idle_signal"
    both = f"{short} and {over}"
    return [
        ("DATA_INCOMPLETE", f"{p}incomplete_signal", "UNAVAILABLE", "LOW", "DATA_INCOMPLETE"),
        ("CONFLICT_STOCKOUT", f"{both} and {above(chance, params.stockout_critical)}",
         "REORDER", "CRITICAL", "CONFLICT_STOCKOUT"),
        ("CONFLICT_EXCESS", f"{both} and {severe}", "REDUCE", "HIGH", "CONFLICT_EXCESS"),
        ("CONFLICT_MONITOR", both, "MONITOR", "MEDIUM", "CONFLICT_MONITOR"),
        ("STOCKOUT_CRITICAL", f"{short} and {p}urgent_signal",
         "REORDER", "CRITICAL", "COVERAGE_BELOW_LEAD"),
        ("STOCKOUT_HIGH", f"{short} and {p}soon_signal and {above(chance, params.stockout_elevated)}",
         "REORDER", "HIGH", "STOCKOUT_ELEVATED"),
        ("STOCKOUT_HIGH", f"{short} and {p}soon_signal", "REORDER", "HIGH", "COVERAGE_BELOW_LEAD"),
        ("STOCKOUT_MEDIUM", short, "REORDER", "MEDIUM", "STOCKOUT_PRESENT"),
        ("VOLATILE_COVERED", f"{above(context.cv, params.volatile_cv)} and {cover} > 1",
         "MONITOR", "MEDIUM", "VOLATILE_COVERED"),
        ("ZERO_DEMAND_EXCESS",
         f"{idle} and {above(f'{p}excess_units', params.material_excess_units)}",
         "REDUCE", "HIGH", "ZERO_DEMAND_EXCESS"),
        ("ZERO_DEMAND", idle, "HOLD", "MEDIUM", "ZERO_DEMAND"),
        ("EXCESS_HIGH", f"{over} and {severe}", "REDUCE", "HIGH", "EXCESS_SIGNIFICANT"),
        ("EXCESS_MEDIUM", over, "REDUCE", "MEDIUM", "EXCESS_PRESENT"),
        ("INCREASING_LOW_COVER", f"{rising} and {cover} < 1",
         "REORDER", "HIGH", "INCREASING_LOW_COVER"),
        ("DECREASING_HIGH_COVER", f"{context.trend} = 'DECREASING' and {cover} > 1.5D",
         "HOLD", "LOW", "DECREASING_HIGH_COVER"),
        ("RISK_HIGH", f"{p}risk_level = 'HIGH'", "MONITOR", "MEDIUM", "RISK_HIGH"),
        ("RISK_MEDIUM", f"{p}risk_level = 'MEDIUM'", "MONITOR", "LOW", "RISK_MEDIUM"),
        ("LOW_COVER_BUFFER", f"{cover} < 0.5D", "REORDER", "LOW", "LOW_COVER_BUFFER"),
        ("HEALTHY", "true", "NO_ACTION", "NONE", "HEALTHY"),
    ]


def _signals(context: Context, params: Params, p: str) -> dict[str, str]:
    """Conditions that several rules share, each worked out once; all are true or false."""
    days, rising = f"{p}days_remaining", f"{context.trend} = 'INCREASING'"
    return {
        "incomplete": " or ".join(condition for condition, _ in _gate(context, p)),
        "stockout": f"{p}stockout_probability > {number(params.stockout_signal)}",
        "excess": f"{p}excess_ratio > {number(params.excess_signal)}",
        "severe": f"{p}excess_ratio > {number(params.excess_severe)}",
        "rising": rising,
        "idle": f"{context.mean} = 0",
        "urgent": f"{days} <= if({rising}, 3, 2)",
        "soon": f"{days} <= if({rising}, 5, 4)",
    }


def _chosen(rules: list[tuple[str, str, str, str, str]]) -> str:
    """The number of the first rule whose condition holds, from 1."""
    arms = " ".join(f"when {rule[1]} then {n}" for n, rule in enumerate(rules, 1))
    return f"case {arms} end"


def _of_rule(rules: list[tuple[str, str, str, str, str]], place: int, p: str) -> str:
    """What the chosen rule says, from a constant array."""
    return f"element_at(array({', '.join(quoted(rule[place]) for rule in rules)}), {p}rule)"


def _numbers(context: Context, p: str) -> dict[str, tuple[str, int]]:
    """The numbers that reasons mention, with their decimals."""
    return {
        "days": (f"{p}days_remaining", 1),
        "lead": (context.lead, 1),
        "chance": (f"{p}stockout_probability * 100", 1),
        "excess": (f"{p}excess_ratio * 100", 1),
        "quantity": (f"{p}reorder_quantity", 1),
        "revenue_at_risk": (f"{p}revenue_at_risk", 2),
        "profit_at_risk": (f"{p}profit_at_risk", 2),
        "excess_inventory_value": (f"{p}excess_inventory_value", 2),
    }


def _primary_text(context: Context, p: str) -> str:
    """The text of the reason that the chosen rule gives."""
    text = _said(context, p)
    worded = {
        "COVERAGE_BELOW_LEAD": [text("days"), text("lead")],
        "STOCKOUT_ELEVATED": [f"concat({text('chance')}, '%')"],
        "EXCESS_SIGNIFICANT": [f"concat({text('excess')}, '%')"],
    }
    plain = ", ".join(quoted(messages.REASONS[code]) for code in PRIMARY_REASONS)
    codes = ", ".join(map(quoted, PRIMARY_REASONS))
    arms = " ".join(f"when {quoted(code)} then {filled(messages.REASONS[code], *values)}"
                    for code, values in worded.items())
    return f"case {p}reason {arms} else element_at(array({plain}), int(array_position(array({codes}), {p}reason))) end"


def _said(context: Context, p: str) -> Callable[[str], str]:
    names = list(_numbers(context, p))
    return lambda name: f"{p}number_texts[{names.index(name)}]"


def _more_reasons(context: Context, p: str) -> list[tuple[str, str, str]]:
    """(condition, code, text) of the reasons after the primary one, in the order they are reported."""
    text = _said(context, p)

    def say(code: str, *values: str) -> str:
        return filled(messages.REASONS[code], *values)

    decided = f"{p}action <> 'UNAVAILABLE'"
    reorder, quantity = f"{p}action = 'REORDER'", f"{p}reorder_quantity"

    def positive(name: str, code: str) -> tuple[str, str, str]:
        return f"{decided} and {p}{name} > 0", code, say(code, text(name))

    stockout_arm = f"{p}branch in ('STOCKOUT_CRITICAL', 'STOCKOUT_HIGH', 'STOCKOUT_MEDIUM')"
    listed = [
        (f"{stockout_arm} and {p}rising_signal", "DEMAND_INCREASING", say("DEMAND_INCREASING")),
        (f"{reorder} and {quantity} is not null", "REORDER_QTY", say("REORDER_QTY", text("quantity"))),
        (f"{reorder} and {quantity} is null", "REORDER_QTY_UNKNOWN", say("REORDER_QTY_UNKNOWN")),
        (f"{decided} and {p}stockout_probability > 0", "STOCKOUT_ESTIMATE",
         say("STOCKOUT_ESTIMATE", f"concat({text('chance')}, '%')")),
        positive("revenue_at_risk", "REVENUE_AT_RISK"),
        positive("profit_at_risk", "PROFIT_AT_RISK"),
        positive("excess_inventory_value", "EXCESS_VALUE"),
    ]
    if context.category_level is not None:
        listed.append((f"{decided} and {context.category_level} = 'HIGH'", "CATEGORY_HIGH",
                       say("CATEGORY_HIGH", context.category)))
    if context.overall_status is not None:
        listed.append((f"{decided} and {context.overall_status} = 'CRITICAL'",
                       "OVERALL_CRITICAL", say("OVERALL_CRITICAL")))
    return listed


def evidence(context: Context = Context(), extra: tuple[str, ...] = (), prefix: str = "") -> str:
    """Struct with the numbers behind a recommendation, in a fixed field order."""
    fields = {"mean_demand": context.mean, "cv": context.cv, "trend": context.trend,
              "trend_strength": context.strength,
              **{name: prefix + name for name in EVIDENCE}, **{name: name for name in extra}}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def with_recommendation(df: DataFrame, context: Context = Context(), params: Params = DEFAULTS,
                        prefix: str = "") -> DataFrame:
    """Add ratios, branch, action, priority, suggested quantity, reasons and gate warnings.

    Conditions are columns that codes and texts both read, and the rule chosen is a number: what
    it says comes from constant arrays.  That keeps the generated code small enough to be compiled.
    """
    p = prefix
    rules, more, signals = _rules(context, params, p), _more_reasons(context, p), _signals(context, params, p)
    given = [f"{p}given_{n}" for n in range(len(more))]
    return staged(
        df,
        {
            f"{p}coverage_ratio": ratio(f"{p}days_remaining", context.lead),
            f"{p}excess_ratio": ratio(f"{p}excess_units", f"{p}target_stock"),
        },
        {f"{p}{name}_signal": holds(condition) for name, condition in signals.items()},
        {f"{p}rule": ended(_chosen(rules))},
        {f"{p}{part}": _of_rule(rules, place, p)
         for part, place in (("branch", 0), ("action", 2), ("priority", 3), ("reason", 4))},
        {
            f"{p}suggested_quantity": f"if({p}action = 'UNAVAILABLE', null, {p}reorder_quantity)",
            f"{p}number_texts": fixed_texts(list(_numbers(context, p).values())),
            **{name: holds(condition) for name, (condition, *_) in zip(given, more, strict=True)},
        },
        {
            f"{p}reason_codes": f"concat(array({p}reason), "
                                f"{texts((name, quoted(code)) for name, (_, code, _) in zip(given, more))})",
            f"{p}reasons": f"concat(array({_primary_text(context, p)}), "
                           f"{texts((name, text) for name, (*_, text) in zip(given, more))})",
            f"{p}gate_warnings": texts((cond, quoted(text)) for cond, text in _gate(context, p)),
        },
    ).drop(f"{p}rule", f"{p}reason", f"{p}number_texts", *given, *[f"{p}{name}_signal" for name in signals])


def priority_rank(priority: str) -> str:
    ranks = " ".join(f"when {quoted(name)} then {rank}" for rank, name in enumerate(PRIORITIES))
    return f"case {priority} {ranks} else {UNRANKED} end"
