"""Building blocks for SQL expressions in which NULL means "unavailable" and stays so."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "cast(null as double)"


def number(value: float) -> str:
    """A double literal; a bare decimal point would make it a DECIMAL."""
    return f"{float(value)!r}D"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ratio(numerator: str, denominator: str) -> str:
    """numerator / denominator where the denominator is positive, else NULL."""
    return f"case when {denominator} > 0 then ({numerator}) / {denominator} end"


def at_least_zero(value: str) -> str:
    return f"if({value} < 0, 0D, {value})"


def at_most_100(value: str) -> str:
    return f"if({value} > 100, 100D, {value})"


def ended(value: str) -> str:
    """The same value, where a stage of generated code ends.

    Spark evaluates functions with a lambda outside whole-stage code, so what stands before and after
    this column is compiled apart.  Formula families that build on each other end in one: fused, they
    become methods of more than 8,000 bytecodes, which the JVM never compiles.
    """
    return f"transform(array({value}), x -> x)[0]"


def holds(condition: str) -> str:
    """A condition with "unknown" read as false."""
    return f"coalesce({condition}, false)"


def texts(pairs: Iterable[tuple[str, str]]) -> str:
    """array<string> of the texts whose condition holds, in the order given.

    Built by concatenation because array filters with lambdas leave whole-stage codegen.
    """
    none = "cast(array() as array<string>)"
    return "concat(" + ", ".join(f"if({c}, array({text}), {none})" for c, text in pairs) + ")"


def band(score: str, low_max: float, medium_max: float, names: tuple[str, str, str]) -> str:
    """Three-way label of a 0-100 score; NULL stays NULL."""
    low, medium, high = map(quoted, names)
    return (f"case when {score} <= {number(low_max)} then {low} "
            f"when {score} <= {number(medium_max)} then {medium} "
            f"when {score} is not null then {high} end")


def fixed_texts(numbers: list[tuple[str, int]]) -> str:
    """array<string> of numbers with a fixed number of decimals, rounded as the double that they are.

    2.675 lies a little below its name and reads 2.67, 0.125 lies in the middle and goes to the even
    0.12.  The fraction is scaled by 10 or 100 (exactly representable), and what the product of doubles
    loses is recovered exactly from the halves of its factor (Dekker's product), so that the middle is
    told from its neighbours.  From 2^63 on, digits come from the shortest text of the double.
    """
    given = ", ".join(f"named_struct('x', {value}, 'places', {places}, 'scale', {10.0 ** places!r}D)"
                      for value, places in numbers)
    steps = [
        # whole part and fraction, both exact
        "named_struct('n', n, 'whole', if(abs(n.x) < 9.2e18D, floor(abs(n.x)), null), "
        "'part', if(abs(n.x) < 9.2e18D, abs(n.x) - floor(abs(n.x)), null))",
        # the scaled fraction, and the upper half of the fraction's digits
        "named_struct('n', n.n, 'whole', n.whole, 'part', n.part, 'scaled', n.part * n.n.scale, "
        "'upper', n.part * 134217729D - (n.part * 134217729D - n.part))",
        # digits below the scaled fraction, its rest against one half, and what the product lost
        "named_struct('n', n.n, 'whole', n.whole, 'digits', floor(n.scaled), "
        "'rest', n.scaled - floor(n.scaled) - 0.5D, "
        "'lost', (n.upper * n.n.scale - n.scaled) + (n.part - n.upper) * n.n.scale)",
        "named_struct('n', n.n, 'whole', n.whole, 'digits', n.digits + "
        "if(n.rest > 0 or n.rest = 0 and (n.lost > 0 or n.lost = 0 and n.digits % 2 = 1), 1, 0))",
        "case when n.n.x is null then null when n.whole is null then format_string(concat('%.', n.n.places, 'f'), n.n.x) "
        "else concat(if(startswith(string(n.n.x), '-'), '-', ''), "
        "string(if(n.digits >= n.n.scale, n.whole + 1, n.whole)), '.', "
        "lpad(string(if(n.digits >= n.n.scale, 0, n.digits)), n.n.places, '0')) end",
    ]
    text = f"array({given})"
    for step in steps:
        text = f"transform({text}, n -> {step})"
    return text


def filled(template: str, *values: str) -> str:
    """A message with its places filled by text expressions."""
    pieces = template.split("{}")
    parts = [quoted(pieces[0])]
    for value, piece in zip(values, pieces[1:], strict=True):
        parts += [value, quoted(piece)]
    return f"concat({', '.join(parts)})" if values else parts[0]


def staged(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Add columns stage by stage; a later stage reads the columns of an earlier one.

    Keeping results as columns, instead of nesting their formulas, is what lets Spark evaluate each of
    them once per row.
    """
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df


def windowed(df: DataFrame, *stages: dict[str, str]) -> DataFrame:
    """Like `staged` for window functions, which cannot read lateral aliases."""
    for stage in stages:
        df = df.withColumns({name: F.expr(text) for name, text in stage.items()})
    return df
