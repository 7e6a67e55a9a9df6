"""The standard normal distribution function and its inverse as native expressions."""

from __future__ import annotations

from functools import reduce

from shelfline.functions.guards import number

# Coefficients of Hart (1968), as published by West (2005), highest power first.
HART_NUMERATOR = [
    3.52624965998911e-02,
    0.700383064443688,
    6.37396220353165,
    33.912866078383,
    112.079291497871,
    221.213596169931,
    220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02,
    1.75566716318264,
    16.064177579207,
    86.7807322029461,
    296.564248779674,
    637.333633378831,
    793.826512519948,
    440.413735824752,
]
HART_CENTRE = 7.07106781186547
HART_LIMIT = 37.0
ROOT_TWO_PI = 2.506628274631

# Coefficients of Wichura (1988), algorithm AS 241, highest power first: numerator and
# denominator for the centre, for the tails, and for the far tails.
QUANTILE_CENTRE = (
    [2.5090809287301226727e+3, 3.3430575583588128105e+4, 6.7265770927008700853e+4,
     4.5921953931549871457e+4, 1.3731693765509461125e+4, 1.9715909503065514427e+3,
     1.3314166789178437745e+2, 3.3871328727963666080e+0],
    [5.2264952788528545610e+3, 2.8729085735721942674e+4, 3.9307895800092710610e+4,
     2.1213794301586595867e+4, 5.3941960214247511077e+3, 6.8718700749205790830e+2,
     4.2313330701600911252e+1, 1.0])
QUANTILE_TAIL = (
    [7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1,
     1.27045825245236838258e+0, 3.64784832476320460504e+0, 5.76949722146069140550e+0,
     4.63033784615654529590e+0, 1.42343711074968357734e+0],
    [1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2,
     1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e+0,
     2.05319162663775882187e+0, 1.0])
QUANTILE_FAR = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3,
     2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e+0,
     5.46378491116411436990e+0, 6.65790464350110377720e+0],
    [2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5,
     7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1,
     5.99832206555887937690e-1, 1.0])
QUANTILE_HALF_WIDTH, QUANTILE_SQUARE, TAIL_SHIFT, FAR_SHIFT = 0.425, 0.180625, 1.6, 5.0


def _polynomial(x: str, coefficients: list[float]) -> str:
    return reduce(lambda total, c: f"({total} * {x} + {number(c)})", coefficients[1:],
                  number(coefficients[0]))


def normal_cdf(x: str) -> str:
    """P(Z <= x) for a column x; absolute error about 2e-16.  NULL in, NULL out."""
    size = f"abs({x})"
    density = f"exp(-{x} * {x} / 2)"
    centre = f"{density} * {_polynomial(size, HART_NUMERATOR)} / {_polynomial(size, HART_DENOMINATOR)}"
    fraction = reduce(lambda tail, k: f"({size} + {k} / {tail})", (4, 3, 2, 1), f"({size} + 0.65D)")
    beyond = (f"case when {size} < {number(HART_CENTRE)} then {centre} "
              f"when {size} <= {number(HART_LIMIT)} "
              f"then {density} / ({fraction} * {number(ROOT_TWO_PI)}) else 0D end")
    return f"case when {x} > 0 then 1D - {beyond} when {x} is not null then {beyond} end"


def normal_quantile(level: str, name: str) -> list[dict[str, str]]:
    """Stages that end in the column name: the z with P(Z <= z) = level; NULL unless 0 < level < 1.

    The relative error is about 1e-16.  The columns before the last are working columns.
    """
    offset, tail, square = f"{name}_offset", f"{name}_tail", f"{name}_square"

    def fraction(x: str, parts: tuple[list[float], list[float]]) -> str:
        return f"{_polynomial(x, parts[0])} / {_polynomial(x, parts[1])}"

    return [
        {
            offset: f"case when {level} > 0 and {level} < 1 then {level} - 0.5D end",
            tail: f"case when {level} > 0 and {level} < 1 then sqrt(-ln(least({level}, 1 - {level}))) end",
        },
        {
            square: f"{number(QUANTILE_SQUARE)} - {offset} * {offset}",
            f"{tail}_near": f"{tail} - {number(TAIL_SHIFT)}",
            f"{tail}_far": f"{tail} - {number(FAR_SHIFT)}",
        },
        {name: f"case when abs({offset}) <= {number(QUANTILE_HALF_WIDTH)} "
               f"then {offset} * {fraction(square, QUANTILE_CENTRE)} "
               f"else sign({offset}) * case when {tail} <= {number(FAR_SHIFT)} "
               f"then {fraction(f'{tail}_near', QUANTILE_TAIL)} "
               f"else {fraction(f'{tail}_far', QUANTILE_FAR)} end end"},
    ]


def working_columns(name: str) -> list[str]:
    """What `normal_quantile` leaves beside its result."""
    return [f"{name}_offset", f"{name}_tail", f"{name}_square", f"{name}_tail_near", f"{name}_tail_far"]
