"""Scores as Column expressions over metrics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.stats import clamp

#: Weights of the debt gradient and of the defect probability.
GRADIENT = {"complexity": 0.30, "churn": 0.35, "coupling": 0.15, "domain_risk": 0.10, "duplication": 0.10}
DEFECT = {"churn": 0.35, "complexity": 0.30, "duplication": 0.25, "coupling": 0.10}
#: Break points (value, share) of the normalising curves.
CHURN_CURVE = ((0.0, 0.0), (0.1, 0.05), (0.2, 0.15), (0.3, 0.30), (0.4, 0.50), (0.5, 0.70), (0.6, 0.85), (0.7, 0.93), (0.8, 0.97), (1.0, 1.0))
COMPLEXITY_CURVE = ((1.0, 0.1), (2.0, 0.2), (3.0, 0.3), (5.0, 0.5), (7.0, 0.7), (10.0, 0.8), (15.0, 0.9), (20.0, 0.95), (30.0, 0.98), (50.0, 1.0))
COUPLING_CURVE = ((0.0, 0.1), (1.0, 0.3), (2.0, 0.5), (3.0, 0.7), (5.0, 0.8), (8.0, 0.9), (12.0, 0.95), (20.0, 1.0))
#: What the constant provability score of 0.425 leaves of the gradient.
PROVABILITY = 0.425


def on_curve(x: Column, curve) -> Column:
    """Piecewise linear value; the ends' values beyond the ends."""
    out = F.lit(float(curve[-1][1]))
    for (a, p), (b, q) in reversed(list(zip(curve, curve[1:]))):
        out = F.when(x <= b, p + (x - a) * ((q - p) / (b - a))).otherwise(out)
    return F.when(x <= curve[0][0], float(curve[0][1])).otherwise(out)


def churn_score(commits: Column, changes: Column, most_commits: Column, most_changes: Column) -> Column:
    share = lambda x, most: F.when(most > 0, x / most).otherwise(0.0)
    return F.least(F.lit(1.0), 0.6 * share(commits, most_commits) + 0.4 * share(changes, most_changes))


def churn_factor(commits: Column) -> Column:
    return F.least(F.lit(5.0), F.log1p(commits / 3) / 2)


def churn_factor_by_age(days: Column) -> Column:
    return F.when(days < 7, 3.0).when(days < 30, 2.0).when(days < 90, 1.0).otherwise(0.5)


def complexity_factor(mean: Column, deviation: Column, most: Column, loc: Column) -> Column:
    """From a file's function complexities (population deviation); 0.5 without functions."""
    score = 0.4 * mean / 5 + 0.2 * deviation / 3 + 0.2 * F.least(most / 10, F.lit(1.0)) + 0.2 * F.least(loc / 100, F.lit(1.0))
    return F.when(mean.isNull(), 0.5).otherwise(F.least(F.lit(5.0), score))


def coupling_factor(imports: Column, instability: Column) -> Column:
    return F.least(F.lit(5.0), F.least(imports / 15, F.lit(2.0)) + 2 * instability + F.when(imports > 20, 1.0).otherwise(0.0))


def domain_risk(path: Column) -> Column:
    has = lambda *words: F.when(F.lit(False) if not words else path.rlike("|".join(words)), 1.0).otherwise(0.0)
    return F.least(F.lit(5.0), 2 * has("auth", "crypto", "security") + 1.5 * has("database", "migration") + has("api", "integration"))


def gradient(parts: dict[str, Column], provability: float = PROVABILITY) -> Column:
    total = sum((parts[k] * w for k, w in GRADIENT.items()), F.lit(0.0))
    return clamp(total * (1 - 0.2 * provability), 0.0, 5.0)


def gradient_severity(value: Column) -> Column:
    return F.when(value > 2.5, "critical").when(value > 1.5, "warning").otherwise("normal")


def gradient_confidence(churn: Column, coupling: Column, duplication: Column) -> Column:
    return F.when(churn == 0, 0.8).otherwise(1.0) * F.when(coupling == 0, 0.9).otherwise(1.0) * F.when(duplication == 0, 0.95).otherwise(1.0)


def gradient_hours(value: Column) -> Column:
    return 2 * F.pow(F.lit(1.8), value)


def primary_factor(parts: dict[str, Column]) -> Column:
    """The part with the largest weighted value."""
    return F.array_max(F.array(*[F.struct((v * GRADIENT[k]).alias("v"), F.lit(k).alias("k")) for k, v in parts.items()]))["k"]


def defect_raw(churn: Column, complexity: Column, duplication: Column, coupling: Column) -> Column:
    return (
        DEFECT["churn"] * on_curve(churn, CHURN_CURVE)
        + DEFECT["complexity"] * on_curve(complexity, COMPLEXITY_CURVE)
        + DEFECT["duplication"] * clamp(duplication, 0.0, 1.0)
        + DEFECT["coupling"] * on_curve(coupling, COUPLING_CURVE)
    )


def defect_probability(*metrics: Column) -> Column:
    return 1 / (1 + F.exp(-10 * (defect_raw(*metrics) - 0.5)))


def risk_level(probability: Column) -> Column:
    return F.when(probability >= 0.7, "High").when(probability >= 0.3, "Medium").otherwise("Low")


def defect_confidence(loc: Column, afferent: Column, efferent: Column, churn: Column) -> Column:
    return F.when(loc < 10, 0.5).when(loc < 50, 0.8).otherwise(1.0) * F.when((afferent == 0) & (efferent == 0), 0.9).otherwise(1.0) * F.when(churn == 0, 0.85).otherwise(1.0)


# What to do about a file, by its largest factor, by two limits, and for files that are at risk in all.
ADVICE = {
    "complexity": ("split its long functions into smaller ones",),
    "cyclomatic": ("branch less: cyclomatic complexity is high",),
    "cognitive": ("nest less: cognitive complexity is high",),
    "churn": ("settle its interface: it changes often", "look through its last changes for flaws of design"),
    "duplication": ("move repeated code into one place", "share behaviour by composition or by functions as arguments"),
    "coupling": ("depend on fewer modules", "put interfaces between it and what it uses"),
    "risk": ("rework it before others: several factors add up", "test more of it", "document its hard parts"),
}


def defect_advice(churn: Column, complexity: Column, duplication: Column, coupling: Column, cyclomatic: Column, cognitive: Column) -> Column:
    """An array of advice: on the largest weighed factor if that is over 0.2, the last of equal ones, and on the file where all add up to over 0.7."""
    parts = {
        "churn": DEFECT["churn"] * on_curve(churn, CHURN_CURVE),
        "complexity": DEFECT["complexity"] * on_curve(complexity, COMPLEXITY_CURVE),
        "duplication": DEFECT["duplication"] * clamp(duplication, 0.0, 1.0),
        "coupling": DEFECT["coupling"] * on_curve(coupling, COUPLING_CURVE),
    }
    best, none = F.greatest(*parts.values()), F.expr("cast(array() as array<string>)")
    said = lambda key: F.array(*[F.lit(x) for x in ADVICE[key]])
    limits = F.concat(F.when(cyclomatic > 15, said("cyclomatic")).otherwise(none), F.when(cognitive > 20, said("cognitive")).otherwise(none))
    main = none
    for name, part in parts.items():
        main = F.when(part == best, F.concat(said(name), limits) if name == "complexity" else said(name)).otherwise(main)
    total = parts["churn"] + parts["complexity"] + parts["duplication"] + parts["coupling"]
    return F.concat(F.when(best > 0.2, main).otherwise(none), F.when(total > 0.7, said("risk")).otherwise(none))


def composite_rank(most: Column, mean_cognitive: Column, functions: Column) -> Column:
    score = 0.4 * F.least(most, F.lit(50)) / 50 * 100 + 0.4 * F.least(mean_cognitive, F.lit(100.0)) / 100 * 100 + 0.2 * F.least(functions, F.lit(100)) / 100 * 50
    return F.when(functions == 0, 0.0).otherwise(score)


def size_rank(ext: Column, chars: Column) -> Column:
    """A file's rank by size, curved by language."""
    capped = lambda per: F.least(chars / per, F.lit(100.0))
    return F.when(ext == "rs", capped(1000)).when(ext.isin("js", "ts"), capped(1200) * 0.9).when(ext == "py", capped(800) * 1.1).otherwise(0.0)


def dead_score(percentage: Column, lines: Column, functions: Column, confidence: Column) -> Column:
    factor = F.when(confidence == "high", 1.0).when(confidence == "medium", 0.7).otherwise(0.4)
    return 0.35 * percentage + 0.30 * F.least(lines, F.lit(1000)) / 10 + 0.20 * 2 * F.least(functions, F.lit(50)) + 0.15 * 100 * factor


def severity_points(severity: Column) -> Column:
    return F.when(severity == "critical", 10.0).when(severity == "high", 5.0).when(severity == "medium", 3.0).otherwise(1.0)


def halstead_volume(operators: Column, operands: Column, distinct_operators: Column, distinct_operands: Column) -> Column:
    return (operators + operands) * F.log2(distinct_operators + distinct_operands)


def halstead_difficulty(operands: Column, distinct_operators: Column, distinct_operands: Column) -> Column:
    return F.when(distinct_operands == 0, 0.0).otherwise(distinct_operators / 2 * operands / distinct_operands)


def makefile_quality(errors: Column, warnings: Column, infos: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - 0.3 * errors - 0.1 * warnings - 0.02 * infos)


def health_score(mean_complexity: Column, dead_share: Column, duplicate_share: Column, mean_gradient: Column) -> Column:
    over = lambda x, most: F.greatest(F.lit(0.0), F.least(x, F.lit(most)))
    return F.greatest(F.lit(0.0), 100 - over(mean_complexity - 10, 20.0) - over(dead_share * 100, 15.0) - over(duplicate_share * 100, 15.0) - over((mean_gradient - 3) * 5, 20.0))


def growth(order: Column, n: Column) -> Column:
    """The cost at size n of growth class 0 to 7: 1, log, n, n log, square, cube, 2^n, n!."""
    log = F.when(n > 1, F.log2(n)).otherwise(0.0)
    return F.when(order == 0, 1.0).when(order == 1, log).when(order == 2, n).when(order == 3, n * log).when(order == 4, n * n).when(order == 5, n * n * n).when(order == 6, F.pow(F.lit(2.0), n)).when(order == 7, F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))


def growth_name(order: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in ("O(1)", "O(log n)", "O(n)", "O(n log n)", "O(n^2)", "O(n^3)", "O(2^n)", "O(n!)")]), order), F.lit("O(?)"))


def lint_density(violations: Column, sloc: Column) -> Column:
    return F.when(sloc > 0, violations / sloc).otherwise(0.0)


def master_theorem(calls: Column, divisor: Column, work: Column) -> Column:
    """The name of the growth of T(n) = calls * T(n / divisor) + n ** work, for work 0 or 1; null where the theorem says nothing.

    The exponent is log(calls) by the divisor, rounded up where it is not met
    exactly. One call with constant work is logarithmic.
    """
    exact = F.ln(calls) / F.ln(divisor)
    # powers are met exactly but for rounding
    power = F.when(F.abs(exact - F.round(exact)) < 1e-9, F.round(exact)).otherwise(F.ceil(exact)).cast("int")
    name = F.when(power == 0, "O(1)").when(power == 1, "O(n)").otherwise(F.concat(F.lit("O(n^"), power.cast("string"), F.lit(")")))
    constant = F.when(power == 0, "O(log n)").otherwise(name)
    linear = F.when(F.abs(exact - 1) < 0.01, "O(n log n)").when(exact < 1, "O(n)").otherwise(name)
    return F.when((calls >= 1) & (divisor > 1), F.when(work == 0, constant).when(work == 1, linear))
