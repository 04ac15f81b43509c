"""Tails and quantiles of the normal distribution as native expressions.

Each function gives SQL text over a column name; it holds only arithmetic, CASE, ln, exp and sqrt. The column is named many times,
so it should be a plain column and no expression.
"""

from __future__ import annotations

import math

# W. J. Cody's rational approximations of the normal tail (1969), highest power first.
CENTRE = (
    (0.065682337918207449113, 2.2352520354606839287, 161.02823106855587881, 1067.6894854603709582, 18154.981253343561249),
    (1.0, 47.20258190468824187, 976.09855173777669322, 10260.932208618978205, 45507.789335026729956),
)
MIDDLE = (
    (1.0765576773720192317e-8, 0.39894151208813466764, 8.8831497943883759412, 93.506656132177855979, 597.27027639480026226,
     2494.5375852903726711, 6848.1904505362823326, 11602.651437647350124, 9842.7148383839780218),
    (1.0, 22.266688044328115691, 235.38790178262499861, 1519.377599407554805, 6485.558298266760755, 18615.571640885098091,
     34900.952721145977266, 38912.003286093271411, 19685.429676859990727),
)
# Algorithm AS 241 (1988), lowest power first: the centre, and the tails up to and beyond r = 5.
QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4,
      6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4,
      3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1,
      1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4,
      1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
#: The median of the chi-square distribution with one degree of freedom.
CHI2_MEDIAN = 0.4549364231195727


def _number(value: float) -> str:
    return f"{value!r}" if "e" in repr(value) else f"{value!r}e0"


def _horner(highest_first: tuple[float, ...], x: str) -> str:
    text = _number(highest_first[0])
    for c in highest_first[1:]:
        text = f"({text} * {x} + {_number(c)})"
    return text


def neg_log10_p(t: str) -> str:
    """-log10 of the upper tail at t of chi-square with one degree of freedom, in log space, so it never underflows; null for null."""
    y = f"sqrt({t})"
    centre = f"ln(0.5e0 - {y} * {_horner(CENTRE[0], t)} / {_horner(CENTRE[1], t)})"
    middle = f"(-{t} / 2e0 + ln({_horner(MIDDLE[0], y)} / {_horner(MIDDLE[1], y)}))"
    # Beyond sqrt(32), Laplace's continued fraction of Mills' ratio, cut after so many levels.
    ratio = y
    for k in range(12, 0, -1):
        ratio = f"({y} + {k}e0 / {ratio})"
    far = f"(-{t} / 2e0 - {_number(0.5 * math.log(2 * math.pi))} - ln{ratio})"
    log_q = f"CASE WHEN {t} <= 0.45493642e0 THEN {centre} WHEN {t} <= 32e0 THEN {middle} ELSE {far} END"
    return f"CASE WHEN {t} IS NOT NULL THEN greatest(0e0, -(({log_q}) + {_number(math.log(2))}) / {_number(math.log(10))}) END"


def quantile(p: str) -> str:
    """The normal quantile of p; null outside of 0 to 1, both excluded."""
    low = [tuple(reversed(c)) for pair in QUANTILE for c in pair]
    q, least = f"({p} - 0.5e0)", f"least({p}, 1e0 - {p})"
    r = f"sqrt(-ln({least}))"
    centre = f"(0.180625e0 - {q} * {q})"
    parts = [f"{q} * {_horner(low[0], centre)} / {_horner(low[1], centre)}"]
    for shift, a, b in ((1.6, low[2], low[3]), (5.0, low[4], low[5])):
        x = f"({r} - {shift}e0)"
        parts.append(f"sign({q}) * {_horner(a, x)} / {_horner(b, x)}")
    return (
        f"CASE WHEN {p} <= 0e0 OR {p} >= 1e0 THEN NULL WHEN abs{q} <= 0.425e0 THEN {parts[0]} "
        f"WHEN {r} <= 5e0 THEN {parts[1]} ELSE {parts[2]} END"
    )
