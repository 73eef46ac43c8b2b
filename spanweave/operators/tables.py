"""Table operators: merging rows, filters, normalisation, joins of count tables, correlations and labels.

Defined results: null keys of a grouping are dropped; collapsing skips nulls, first and last keep them; a table without rows gives none.
"""

from __future__ import annotations

import statistics
from collections.abc import Iterable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.runtime import attach


def _numeric(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def _listed(c: str, order: str, sep: str, distinct: bool) -> Column:
    pairs = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), F.col(c).cast("string").alias("v")))))
    values = F.transform(pairs, lambda x: x["v"])
    return F.array_join(F.array_distinct(values) if distinct else values, sep)


def _aggregate(df: DataFrame, method: str, c: str, order: str, sep: str) -> Column:
    if method in ("mean", "median", "medium") and not _numeric(df, c):
        method = "distinct"
    plain = {
        "max": F.max, "min": F.min, "sum": F.sum, "count": F.count, "count_distinct": F.countDistinct, "mean": F.avg, "median": F.median, "medium": F.median,
    }
    if method in plain:
        return plain[method](c)
    if method in ("distinct", "collapse"):
        return _listed(c, order, sep, method == "distinct")
    if method in ("first", "last"):
        return (F.min_by if method == "first" else F.max_by)(F.col(c), F.col(order))
    raise ValueError(f"unknown method {method}")


def merge_row(df: DataFrame, by: list[str], columns: list[str], methods: str | list[str], order: str, sep: str = ",", count: bool = False) -> DataFrame:
    """A1: one row per key with an aggregate of each column; without columns the first row of each key."""
    if not columns:
        from spanweave.operators.flow import dedup

        return dedup(df, by, order)
    methods = [methods] * len(columns) if isinstance(methods, str) else methods
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in by])
    out = [_aggregate(df, m, c, order, sep).alias(c) for m, c in zip(methods, columns, strict=True)]
    return df.where(ok).groupBy(*by).agg(*out, *([F.count("*").alias("count")] if count else []))


def non_numeric(c: str) -> Column:
    """Is the text no number."""
    return F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()


def _scaled(df: DataFrame, samples: list[str], x: dict[str, Column], factor: float, total: dict[str, Column]) -> DataFrame:
    sums = df.agg(*[F.sum(total[s]).alias("_sum_" + s) for s in samples])  # one row
    return df.transform(attach, sums).withColumns({s: x[s] * factor / F.col("_sum_" + s) for s in samples}).drop(*["_sum_" + s for s in samples])


def _complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def cpm(df: DataFrame, samples: list[str]) -> DataFrame:
    """A2: counts per million of each sample; rows with a null are dropped (P10)."""
    df = _complete(df, samples)
    raw = {s: F.col(s) for s in samples}
    return _scaled(df, samples, raw, 1e6, raw)


def rpkm(df: DataFrame, samples: list[str], length: str = "Length") -> DataFrame:
    """A3: per length and million of raw counts."""
    df = _complete(df, [*samples, length])
    return _scaled(df, samples, {s: F.col(s) / F.col(length) for s in samples}, 1e9, {s: F.col(s) for s in samples})


def tpm(df: DataFrame, samples: list[str], length: str = "Length") -> DataFrame:
    """A4: per million of length-scaled counts."""
    df = _complete(df, [*samples, length])
    rate = {s: F.col(s) / F.col(length) * 1e3 for s in samples}
    return _scaled(df, samples, rate, 1e6, rate)


def without_zero_rows(df: DataFrame, samples: list[str]) -> DataFrame:
    """P10."""
    return df.where(reduce(lambda a, b: a + b, [F.col(s) for s in samples]) != 0)


def normalise(df: DataFrame, samples: list[str], method: str, length: str = "Length", digits: int = 2) -> DataFrame:
    """A5: normalise, drop rows that are all zero, round half to even, sort by the first sample, largest first."""
    out = {"CPM": lambda: cpm(df, samples), "RPKM": lambda: rpkm(df, samples, length), "TPM": lambda: tpm(df, samples, length)}[method]()
    out = without_zero_rows(out, samples).withColumns({s: F.bround(s, digits) for s in samples})
    return out.orderBy(F.col(samples[0]).desc())


def size_factors(df: DataFrame, samples: list[str]) -> DataFrame:
    """Median-of-ratios factor of each sample, over rows without a zero."""
    ok = reduce(lambda a, b: a & b, [F.col(s) > 0 for s in samples])
    mean = reduce(lambda a, b: a + b, [F.log(s) for s in samples]) / len(samples)
    rows = df.where(ok).withColumn("_m", mean)
    return rows.agg(*[F.exp(F.median(F.log(s) - F.col("_m"))).alias(s) for s in samples])


def name_filter(df: DataFrame, column: str, names: DataFrame, mode: str = "isin", exclude: bool = False, delimiter: str | None = None, name: str = "name") -> DataFrame:
    """Rows whose column is in the name list (``isin``), holds one as text (``contains``), or as one of its pieces (``token``); or the others.

    ``contains`` joins by the list in a nested loop over the rows: the list is a stated query set.
    """
    how = "left_anti" if exclude else "left_semi"
    n = names.select(F.col(name).alias("_name")).where("_name IS NOT NULL").distinct()
    if mode == "isin":
        return df.join(n, F.col(column) == F.col("_name"), how)
    if mode == "contains":
        return df.join(n, F.contains(F.col(column), F.col("_name")), how)
    texts = df.select(F.col(column).alias("_text")).where("_text IS NOT NULL").distinct()
    met = texts.select("_text", F.explode(F.split("_text", "\\Q" + (delimiter or ",") + "\\E")).alias("_p")).join(n, F.col("_p") == F.col("_name"), "left_semi").select("_text").distinct()
    return df.join(met, F.col(column) == F.col("_text"), how)


def stack_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of several tables by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def _mean_of_list(c: str) -> Column:
    x = F.transform(F.split(c, ","), lambda v: v.try_cast("double"))
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v) / F.size(x)


def splice_filter(df: DataFrame, p_value: float | None = None, fdr: float | None = None, diff: float | None = None, reads: float | None = None, top: int | None = None) -> DataFrame:
    """Splice events by thresholds (0 and None switch one off), strongest difference first, then lowest FDR; ``direction`` up, down or none."""
    out = df
    if p_value:
        out = out.where(F.col("PValue") < p_value)
    if fdr:
        out = out.where(F.col("FDR") < fdr)
    if diff:
        out = out.where(F.abs("IncLevelDifference") > diff)
    if reads:
        for i in (1, 2):
            out = out.where(_mean_of_list(f"IJC_SAMPLE_{i}") + _mean_of_list(f"SJC_SAMPLE_{i}") > reads)
    out = out.orderBy(F.abs("IncLevelDifference").desc(), F.col("FDR").asc())
    if top:
        out = out.limit(top)
    way = F.when(F.col("IncLevelDifference") > 0, "up").when(F.col("IncLevelDifference") < 0, "down").otherwise("none")
    return out.withColumn("direction", way)


def outer_merge(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """Count tables side by side, absent rows as 0."""
    out = reduce(lambda a, b: a.join(b, keys, "full"), tables)
    return out.na.fill(0, subset=[c for c in out.columns if c not in keys])


def pearson(df: DataFrame, samples: list[str], least: float | None = None) -> DataFrame:
    """(a, b, r) of each pair of samples: nulls are 0, all-zero rows are dropped, with ``least`` also rows with a smaller value."""
    df = without_zero_rows(df.na.fill(0, subset=samples), samples)
    if least is not None:
        df = df.where(F.least(*samples) >= least if len(samples) > 1 else F.col(samples[0]) >= least)
    pairs = list(combinations(samples, 2))
    one = df.agg(*[F.corr(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def venn(sets: dict[str, DataFrame], item: str) -> DataFrame:
    """(members, n): how many items lie in exactly these sets."""
    tagged = reduce(DataFrame.unionByName, [df.select(item).where(F.col(item).isNotNull()).withColumn("_tag", F.lit(name)) for name, df in sets.items()])
    return tagged.groupBy(item).agg(F.array_sort(F.collect_set("_tag")).alias("members")).groupBy("members").agg(F.count("*").alias("n"))


def trimmed(df: DataFrame, value: str, whisker: float = 1.5) -> DataFrame:
    """Values strictly between the whiskers of a box plot (quartiles by linear interpolation; the whiskers end at the furthest value within 1.5 ranges)."""
    q = df.agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    inside = F.col(value).between(F.col("_q1") - whisker * (F.col("_q3") - F.col("_q1")), F.col("_q3") + whisker * (F.col("_q3") - F.col("_q1")))
    with_q = df.transform(attach, q).where(inside)
    ends = with_q.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    return with_q.transform(attach, ends).where((F.col(value) > F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_q1", "_q3", "_lo", "_hi")


def weights(df: DataFrame, size: str, n: str, by: list[str]) -> DataFrame:
    """Share of each size within its group, and the group's most frequent size (the smallest of equals)."""
    total = df.groupBy(*by).agg(F.sum(n).alias("total"), F.max_by(F.col(size), F.struct(F.col(n), -F.col(size))).alias("mode"))
    return df.join(total, by).withColumn("weight", F.col(n) / F.col("total"))


def grouped_mean(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and standard error over replicates."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))


def percent(text: Column) -> Column:
    """A26: "12.5%" as 12.5."""
    return F.regexp_replace(text, "%", "").try_cast("double")


def diff_labels(df: DataFrame, lfc: str, padj: str, least_lfc: float = 1.0, most_padj: float = 0.05) -> DataFrame:
    """``label`` up, down or not; ``score`` is -log10 of padj, with 0 taken as the least double."""
    p = F.when(F.col(padj) == 0, F.lit(2.2250738585072014e-308)).otherwise(F.col(padj))
    strong = F.coalesce(F.col(padj) <= most_padj, F.lit(False))
    label = F.when(strong & (F.col(lfc) >= least_lfc), "up").when(strong & (F.col(lfc) <= -least_lfc), "down").otherwise("not")
    return df.withColumn("label", label).withColumn("score", -F.log10(p))


def ranked(df: DataFrame, value: str, ties: str, n: int = 5) -> DataFrame:
    """The lowest and highest ``n`` rows with their rank among all; ranks come from a distributed sort."""
    from spanweave.operators.flow import numbered

    placed = numbered(df.withColumn("_o", F.struct(value, ties)), "_o").withColumn("rank", F.col("_n") + 1)
    total = df.agg(F.count("*").alias("_c"))
    return placed.transform(attach, total).where((F.col("rank") <= n) | (F.col("rank") > F.col("_c") - n)).drop("_o", "_n", "_c")


def top_labels(df: DataFrame, by: Column, ok: Column, n: int, selected: Iterable[str], name: str) -> DataFrame:
    """Names of the first ``n`` rows that pass, together with the selected names that occur."""
    top = df.where(ok).orderBy(by, name).limit(n).select(name)
    some = df.where(F.col(name).isin(list(selected))).select(name)
    return top.union(some).distinct()


def t_test(a: list[float], b: list[float]) -> tuple[float, float]:
    """(t, two-sided p) of two samples, variances pooled if Levene's test (around the mean) finds them equal (p > 0.05), else Welch's form."""
    na, nb = len(a), len(b)
    va, vb = statistics.variance(a), statistics.variance(b)
    if levene(a, b)[1] > 0.05:
        df = na + nb - 2
        se = ((((na - 1) * va + (nb - 1) * vb) / df) * (1 / na + 1 / nb)) ** 0.5
    else:
        x, y = va / na, vb / nb
        se = (x + y) ** 0.5
        df = (x + y) ** 2 / (x**2 / (na - 1) + y**2 / (nb - 1)) if x + y else na + nb - 2
    if se == 0:
        return float("nan"), float("nan")
    t = (statistics.fmean(a) - statistics.fmean(b)) / se
    return t, _beta(df / (df + t * t), df / 2, 0.5)


def levene(a: list[float], b: list[float]) -> tuple[float, float]:
    """(W, p) with distances from the median."""
    za, zb = ([abs(x - statistics.median(s)) for x in s] for s in (a, b))
    every, n = za + zb, len(a) + len(b)
    mean = statistics.fmean(every)
    between = sum(len(z) * (statistics.fmean(z) - mean) ** 2 for z in (za, zb))
    within = sum((x - statistics.fmean(z)) ** 2 for z in (za, zb) for x in z)
    if within == 0:
        return float("nan"), 1.0
    w = (n - 2) * between / within
    return w, _beta((n - 2) / (n - 2 + w), (n - 2) / 2, 0.5)


def _beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta(1.0 - x, b, a)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(500):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1.0 - c * d) < 1e-15:
            break
    return front * (f - 1.0)


def compare_matrix(df: DataFrame, key: str, a: list[str], b: list[str]) -> DataFrame:
    """A wide matrix with difference, fold change (1 % of the column mean as pseudo value) and p value of two groups of samples; null and all-zero rows dropped."""
    samples = [*a, *b]
    df = without_zero_rows(_complete(df, samples), samples)

    def mean(some: list[str]) -> Column:
        return reduce(lambda x, y: x + y, [F.col(s) for s in some]) / len(some)

    pseudo = df.agg((F.avg((mean(a) + mean(b)) / 2) * 0.01).alias("_pseudo"))
    out = df.transform(attach, pseudo).withColumn("diff", mean(b) - mean(a)).withColumn("fc", (mean(b) + F.col("_pseudo")) / (mean(a) + F.col("_pseudo"))).drop("_pseudo")
    if len(a) < 2 or len(b) < 2:
        return out

    @F.pandas_udf("double")
    def p(x, y):
        import pandas as pd

        return pd.Series([t_test(list(u), list(v))[1] for u, v in zip(x, y)])

    return out.withColumn("p_value", p(F.array(*a), F.array(*b)))
