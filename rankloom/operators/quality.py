"""Quality of pointwise predictions: classes, errors, correlations, ROC.

Values are counted before they are ordered, and the order runs over blocks
when there are many distinct values, so no global window sees the whole table.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.plans.durable import durable
from rankloom.plans.groups import (
    GroupSizes, group_totals, known_groups, measure_groups, salted_join, scan_groups,
)


# Distinct values that may be sent to every executor.
BROADCAST_ROWS = 1_000_000


def accuracy(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """Share of equal classes, in percent."""
    same = (F.col(label) == F.col(predicted)).cast("double")
    return df.agg((F.avg(same) * 100).alias("accuracy"))


def rmse(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    off = F.col(label) - F.col(score)
    return df.agg(F.sqrt(F.avg(off * off)).alias("rmse"))


def confusion_matrix(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(
    df: DataFrame, label: str = "label", predicted: str = "predicted"
) -> DataFrame:
    """Precision, recall, F1 and support of each class, and their means.

    A ratio over 0 counts as 0. The accuracy row repeats the accuracy in all
    three columns.
    """
    zero = F.lit(0).cast("long")
    sides = F.array(
        F.struct(
            F.col("label").alias("cls"),
            F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(zero).alias("hits"),
            zero.alias("predicted"),
            F.col("n").alias("support"),
        ),
        F.struct(
            F.col("predicted").alias("cls"),
            zero.alias("hits"),
            F.col("n").alias("predicted"),
            zero.alias("support"),
        ),
    )
    classes = (
        confusion_matrix(df, label, predicted)
        .select(F.inline(sides))
        .groupBy("cls")
        .agg(*[F.sum(c).alias(c) for c in ("hits", "predicted", "support")])
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("support"))
    f1 = _ratio(F.lit(2.0) * F.col("hits"), F.col("predicted") + F.col("support"))
    scored = classes.select(
        F.col("cls").cast("string").alias("cls"), "hits", "support",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )
    measures, n = ("precision", "recall", "f1"), F.sum("support")
    overall = scored.agg(
        (F.sum("hits") / n).alias("accuracy"),
        n.alias("support"),
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(f"weighted_{m}") for m in measures],
    )

    def row(name, source):
        return F.struct(
            F.lit(name).alias("cls"), *[F.col(source(m)).alias(m) for m in measures], "support"
        )

    means = overall.select(F.inline(F.array(
        row("accuracy", lambda m: "accuracy"),
        row("macro avg", lambda m: f"macro_{m}"),
        row("weighted avg", lambda m: f"weighted_{m}"),
    )))
    return scored.select("cls", *measures, "support").unionByName(means)


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def pearson(df: DataFrame, x: str = "label", y: str = "score") -> DataFrame:
    return df.agg(F.corr(x, y).alias("pearson"))


def _average_ranks(
    counted: DataFrame, by: str, then: str, name: str, sizes: GroupSizes
) -> DataFrame:
    """Add the average rank of ``by`` over all rows, of which each row stands for ``n``."""
    order = [F.col(by), F.col(then)]
    scanned = scan_groups(counted, [], order, running={"_to": F.col("n")}, sizes=sizes)
    ends = {"_first": F.min(F.col("_to") - F.col("n")), "_last": F.max("_to")}
    tied = group_totals(scanned, [by], ends, then, _of_parts(sizes))
    return tied.withColumn(name, (F.col("_first") + F.col("_last") + 1) / 2).drop("_to", "_first", "_last")


def _of_parts(sizes: GroupSizes) -> GroupSizes | None:
    """Sizes that hold for any grouping of a table that fits the bound as a whole."""
    return sizes if sizes.bounded else None


def _counted(df: DataFrame, x: str, y: str) -> DataFrame:
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return known.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str = "label", y: str = "score") -> DataFrame:
    """Pearson correlation of the average ranks."""
    counted = _counted(df, x, y)
    sizes = measure_groups(counted, [])
    ranked = _average_ranks(counted, "x", "y", "rx", sizes)
    ranked = _average_ranks(ranked, "y", "x", "ry", sizes)
    n, rx, ry = F.col("n").cast("double"), F.col("rx"), F.col("ry")
    sums = ranked.agg(
        F.sum(n).alias("n"), F.sum(n * rx).alias("x"), F.sum(n * ry).alias("y"),
        F.sum(n * rx * ry).alias("xy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"),
    )
    def spread(a, b, ab):
        return F.col(ab) - F.col(a) * F.col(b) / F.col("n")
    bottom = F.sqrt(spread("x", "x", "xx") * spread("y", "y", "yy"))
    return sums.select(F.when(bottom > 0, spread("x", "y", "xy") / bottom).alias("spearman"))


def corr_pvalue(r: float, n: int) -> float:
    """Two-sided p-value of a correlation of ``n`` rows, from the t distribution."""
    if n < 3:
        return math.nan
    if abs(r) >= 1.0:
        return 0.0
    freedom = n - 2
    t_square = r * r * freedom / (1.0 - r * r)
    if freedom > 1e6:
        # Normal tail with its first correction: the error is of the order of 1 / n^2.
        z = math.sqrt(t_square) * (1.0 - (t_square + 1.0) / (4.0 * freedom))
        return math.erfc(z / math.sqrt(2.0)) if t_square < 1500.0 else 0.0
    both = freedom + t_square
    return _incomplete_beta(freedom / 2.0, 0.5, freedom / both, t_square / both)


def _log_gamma_step(a: float, b: float) -> float:
    """log(gamma(a + b) / gamma(a)); for large a and small b without the difference of large terms."""
    if a < 1e3 or b > 1.0:
        return math.lgamma(a + b) - math.lgamma(a)
    return b * math.log(a) + b * (b - 1) / (2 * a) - b * (b - 1) * (2 * b - 1) / (12 * a * a)


def _incomplete_beta(a: float, b: float, x: float, y: float) -> float:
    """Regularised incomplete beta function at x = 1 - y by its continued fraction."""
    if x <= 0.0 or y <= 0.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, y, x)
    logs = [n * (math.log(p) if p < 0.5 else math.log1p(-q)) for n, p, q in ((a, x, y), (b, y, x))]
    steps = _log_gamma_step(max(a, b), min(a, b)) - math.lgamma(min(a, b))
    front = math.exp(steps + sum(logs)) / a
    # From the near end until it stands still, with numerators and denominators as ratios.
    tiny = 1e-300
    value, up, down = 1.0, 1.0, 0.0
    for step in itertools.count(1):
        m = step // 2
        if step % 2:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        up, down = (1.0 + term / up) or tiny, 1.0 / ((1.0 + term * down) or tiny)
        value *= up * down
        if step > 2 and abs(up * down - 1.0) < 1e-15:
            return front / value


def correlation_report(df: DataFrame, x: str = "label", y: str = "score") -> DataFrame:
    """Pearson and Spearman correlations with their p-values.

    The p-value is worked out on the driver from one aggregated row.
    """
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    row = known.agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n")).first()
    rho = spearman(known, x, y).first()["spearman"]
    values = [
        (name, value, None if value is None else corr_pvalue(value, row["n"]))
        for name, value in (("pearson", row["r"]), ("spearman", rho))
    ]
    return df.sparkSession.createDataFrame(values, "statistic string, value double, p_value double")


def kendall(df: DataFrame, x: str = "label", y: str = "score") -> DataFrame:
    """Kendall's tau-b.

    The side with fewer distinct values is numbered by rank. At each bit of
    that number the rows that agree on the higher bits form a group; running
    counts of zeros and ones by the other side give the concordant and
    discordant pairs that this bit decides. The work grows with rows times
    bits, never with pairs.
    """
    counted = durable(_counted(df, x, y))  # read by five branches
    distinct = counted.agg(
        F.countDistinct("x").alias("x"), F.countDistinct("y").alias("y"), F.count(F.lit(1)).alias("n")
    ).first()
    parts = _of_parts(known_groups(counted, distinct["n"]))
    few, other = ("x", "y") if distinct["x"] <= distinct["y"] else ("y", "x")
    levels = max(1, math.ceil(math.log2(max(2, distinct[few]))))
    codes = scan_groups(
        counted.select(few).distinct(), [], [F.col(few)], rank="_code", sizes=parts
    )
    coded = _with_codes(counted, codes, few, other, distinct[few])
    split = coded.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).select(
        "_level",
        F.expr("shiftright(_code - 1, _level + 1)").alias("_prefix"),
        F.expr("shiftright(_code - 1, _level) & 1").alias("_bit"),
        F.col(other).alias("_by"),
        "n",
    )
    one = F.when(F.col("_bit") == 1, F.col("n")).otherwise(0)
    sums = split.groupBy("_level", "_prefix", "_by").agg(
        F.sum(one).cast("double").alias("_ones"),
        F.sum(F.col("n") - one).cast("double").alias("_zeros"),
    )
    scanned = scan_groups(
        sums, ["_level", "_prefix"], [F.col("_by")],
        running={"_ones_to": F.col("_ones"), "_zeros_to": F.col("_zeros")},
        sizes=parts,
    )
    concordant = F.sum(F.col("_ones") * (F.col("_zeros_to") - F.col("_zeros")))
    discordant = F.sum(F.col("_zeros") * (F.col("_ones_to") - F.col("_ones")))
    score = scanned.agg(F.coalesce(concordant - discordant, F.lit(0.0)).alias("s"))

    def tied_pairs(by, name):
        n = F.col("n").cast("double")
        per_value = counted.groupBy(by).agg(F.sum("n").alias("n"))
        return per_value.agg(F.sum(n * (n - 1) / 2).alias(name))

    total = F.sum("n").cast("double")
    row = counted.agg((total * (total - 1) / 2).alias("n0"))
    # Four one-row aggregates side by side.
    for part in (tied_pairs("x", "n1"), tied_pairs("y", "n2"), score):
        row = row.withColumn("_one", F.lit(1)).join(part.withColumn("_one", F.lit(1)), "_one").drop("_one")
    bottom = F.sqrt((F.col("n0") - F.col("n1")) * (F.col("n0") - F.col("n2")))
    return row.select(F.when(bottom > 0, F.col("s") / bottom).alias("kendall"))


def _with_codes(counted, codes, few, other, n_codes):
    """Join the number of each value; a value of very many rows is spread out."""
    if n_codes <= BROADCAST_ROWS:
        return counted.join(F.broadcast(codes), few)
    if measure_groups(counted, [few]).bounded:
        return counted.join(codes, few)
    return salted_join(counted, codes, [few], other)


def _by_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    positive = (F.col(label) == 1).cast("long")
    return df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve: share of (positive, negative) pairs in order, ties half."""
    scanned = scan_groups(
        _by_threshold(df, label, score), [], [F.col("threshold")], running={"_neg_to": F.col("neg")}
    )
    neg_below = F.col("_neg_to") - F.col("neg") / 2
    bottom = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return scanned.agg(
        F.when(bottom > 0, F.sum(F.col("pos").cast("double") * neg_below) / bottom).alias("roc_auc")
    )


def roc_curve(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """False and true positive rate at every threshold (score >= threshold)."""
    steps = _by_threshold(df, label, score)
    sizes = measure_groups(steps, [])
    scanned = scan_groups(
        steps, [], [F.col("threshold").desc()], sizes=sizes,
        running={"_tp": F.col("pos"), "_fp": F.col("neg")},
    )
    totals = {"_pos": F.sum("pos"), "_neg": F.sum("neg")}
    full = group_totals(scanned, [], totals, "threshold", sizes)
    return full.select(
        "threshold",
        _ratio(F.col("_fp"), F.col("_neg")).alias("fpr"),
        _ratio(F.col("_tp"), F.col("_pos")).alias("tpr"),
    )
