"""Operator 9: quality rules with robust multivariate outliers (native DataFrame functions only).

Per document: word, symbol, repeated-line and repeated-window counts.  Base
rules reject very short and very repetitive texts.  For the rest, the counts
are transformed to five statistics and every (language, source) group gets a
minimum-covariance-determinant estimate of centre and scatter: from two starts
(median with absolute deviation, and mean with variance), concentration steps
refit on the ``support`` share of rows with the smallest Mahalanobis distance;
the start that ends with the smaller determinant wins.  Rows beyond ``cutoff``
are rejected.

The statistics are whole thousandths, so sums are exact and reruns agree.

Scale: counts are made inside each row; only the small statistics table is
written (shared folder) and read by the steps.  Every step is an aggregate with
map-side combine per group (sums, or quantiles over a bounded set of values), so
a source with a third of all rows is combined before the shuffle.  The
parameter table has two rows per group and is broadcast only after its rows
have been counted.

Defined cases: null text is empty (base_failed); null lang or source is a group
of its own; groups with fewer than ``min_group`` usable rows take their
language's estimate, then the estimate over all rows; a statistic that does not
vary has the fixed floor of ``FLOORS`` as spread; repeated rows count as rows;
clashing input columns come back as ``<name>_in``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_clear, small, whole_text, words

MIN_WORDS = 10
MAX_REPEAT_PCT = 20
SUPPORT = 0.75        # share of a group's rows that the estimate concentrates on
STEPS = 3             # concentration steps
MIN_GROUP = 50
CHI2_MEDIAN = 4.351   # median of the chi-square law with 5 degrees of freedom
CUTOFF = 30.86        # squared distance that the chi-square law with 5 degrees of freedom exceeds once in 100,000 rows
# Least spread of each statistic (thousandths).
FLOORS = (400, 80, 60, 60, 150)
N = len(FLOORS)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
OUT = [*COUNTS, "base_failed", "distance", "kept"]
X = [f"_x{i}" for i in range(N)]
GROUP = ["_lang", "_source", "_level"]


def counts(docs: DataFrame) -> DataFrame:
    """Add the five counts (all long); uses ``text`` only."""
    t = whole_text()
    d = docs.withColumn("_w", words(t))
    d = d.withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("word_chars", F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"))
    lines = F.transform(F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x))
    d = d.withColumn("_l", lines)
    d = d.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    h = F.col("_h")
    # hashes of all 5-word windows, in order
    d = d.withColumn("_win", F.when(F.size("_h") >= 5, F.transform(
        F.sequence(F.lit(0), F.size("_h") - 5),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))).otherwise(F.expr("cast(array() as array<bigint>)")))
    # only rows in which a window repeats sort their windows
    d = d.withColumn("_s", F.when(
        F.size(F.array_distinct("_win")) < F.size("_win"),
        F.sort_array(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    d = d.withColumn("_pos", F.sort_array(F.transform(
        F.filter("_s", lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.when(i > 0, F.get(s, i - 1)["h"]) == x["h"])),
        lambda x: x["i"])))
    # words under the union of the windows [i, i + 5)
    cover = F.aggregate("_pos", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
                        lambda a, i: F.struct((a["n"] + i + 5 - F.greatest(i, a["end"])).alias("n"), (i + 5).alias("end")))
    d = d.withColumn("n_repeat_words", F.coalesce(cover["n"], F.lit(0)).cast("long"))
    return d.drop("_w", "_l", "_h", "_win", "_s", "_pos")


def _statistics(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    c = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    values = [F.log(n), F.log(c / n), F.sqrt(F.col("n_symbols") / c), F.sqrt(F.col("n_dup_lines") / n),
              F.sqrt(F.col("n_repeat_words") / n)]
    return d.withColumns({x: F.round(v * 1000).cast("long") for x, v in zip(X, values)})


def _cholesky(p: DataFrame, cov) -> DataFrame:
    """Add the lower factor ``_l{i}{j}`` of the matrix of columns ``cov(i, j)`` and ``_logdet``."""
    for i in range(N):
        for j in range(i + 1):
            s = reduce(lambda a, k: a - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}"), range(j), cov(i, j))
            p = p.withColumn(f"_l{i}{j}", F.sqrt(F.greatest(s, F.lit(float(FLOORS[i]) ** 2 / 4))) if i == j
                             else s / F.col(f"_l{j}{j}"))
    return p.withColumn("_logdet", reduce(lambda a, i: a + F.log(f"_l{i}{i}"), range(N), F.lit(0.0)))


def _distance(d: DataFrame) -> DataFrame:
    """Add the squared Mahalanobis distance ``_d2`` of rows joined with their group's parameters."""
    for i in range(N):
        z = reduce(lambda a, k: a - F.col(f"_l{i}{k}") * F.col(f"_z{k}"), range(i), F.col(X[i]) - F.col(f"_m{i}"))
        d = d.withColumn(f"_z{i}", z / F.col(f"_l{i}{i}"))
    d = d.withColumn("_d2", reduce(lambda a, i: a + F.col(f"_z{i}") * F.col(f"_z{i}"), range(N), F.lit(0.0)))
    return d.drop(*[f"_z{i}" for i in range(N)])


def _bin(d2: Column) -> Column:
    """Distance class: few distinct values, so a quantile's state is bounded."""
    return F.least(F.round(F.log1p(d2) * 200), F.lit(6000)).cast("int")




def _join(d: DataFrame, p: DataFrame, rows: int) -> DataFrame:
    p = p.select(*[F.col(g).alias("_p" + g) for g in GROUP], *[c for c in p.columns if c not in GROUP])
    on = reduce(lambda x, y: x & y, [d[g].eqNullSafe(p["_p" + g]) for g in GROUP])
    return d.join(small(p, rows), on).drop(*["_p" + g for g in GROUP])


def _moments(d: DataFrame, keys: list[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.sum(x).alias(f"_s{i}") for i, x in enumerate(X)]
    aggs += [F.sum(F.col(X[i]) * F.col(X[j])).alias(f"_c{i}{j}") for i in range(N) for j in range(i + 1)]
    return d.groupBy(*keys).agg(*aggs)


def _fit(m: DataFrame) -> DataFrame:
    """Parameters (centre, factor) from moments; the floors keep the scatter regular."""
    m = m.withColumns({f"_m{i}": F.col(f"_s{i}") / F.col("_n") for i in range(N)})
    cov = lambda i, j: (F.col(f"_c{i}{j}") / F.col("_n") - F.col(f"_m{i}") * F.col(f"_m{j}")
                        + (float(FLOORS[i]) ** 2 if i == j else 0.0))
    return _cholesky(m, cov)


PARAMS = [*[f"_m{i}" for i in range(N)], *[f"_l{i}{j}" for i in range(N) for j in range(i + 1)], "_logdet"]




def mcd(stats: DataFrame, support: float = SUPPORT, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per group (``_lang, _source, _level``): centre, factor and scale of its estimate.

    Level 0 is (language, source), 1 the language, 2 all rows; a row of ``stats``
    counts in all three.
    """
    d = stats.where(~F.col("base_failed")).select("lang", "source", *X)
    none = F.lit(None).cast("string")
    d = d.withColumn("_g", F.explode(F.array(
        F.struct(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.lit(0).alias("_level")),
        F.struct(F.col("lang").alias("_lang"), none.alias("_source"), F.lit(1).alias("_level")),
        F.struct(none.alias("_lang"), none.alias("_source"), F.lit(2).alias("_level")))))
    d = d.select("_g.*", *X)
    # start 0: median and absolute deviation; start 1: mean and variance
    med = cut(d.groupBy(*GROUP).agg(*[F.percentile(x, 0.5).alias(f"_m{i}") for i, x in enumerate(X)]), "medians")
    rows = med.count()
    dev = _join(d, med, rows)
    mad = dev.groupBy(*GROUP, *[f"_m{i}" for i in range(N)]).agg(
        *[F.percentile(F.abs(F.col(x) - F.col(f"_m{i}")), 0.5).alias(f"_d{i}") for i, x in enumerate(X)])
    p0 = _cholesky(mad, lambda i, j: (F.col(f"_d{i}") * 1.4826) ** 2 + float(FLOORS[i]) ** 2 if i == j else F.lit(0.0))
    p1 = _fit(_moments(d, GROUP))
    p = cut(p0.select(*GROUP, F.lit(0).alias("_start"), *PARAMS)
            .unionByName(p1.select(*GROUP, F.lit(1).alias("_start"), *PARAMS)), "start")
    for k in range(steps):
        x = _distance(_join(d, p, 2 * rows)).select(*GROUP, "_start", *X, _bin(F.col("_d2")).alias("_b"))
        limit = cut(x.groupBy(*GROUP, "_start").agg(F.percentile("_b", support).alias("_limit")), f"limit{k}")
        q = p.join(limit.select(*[F.col(g).alias("_q" + g) for g in GROUP], F.col("_start").alias("_qs"), "_limit"),
                   reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col("_q" + g)) for g in GROUP])
                   & (F.col("_start") == F.col("_qs"))).select(*p.columns, "_limit")
        x = _distance(_join(d, q, 2 * rows)).where(_bin(F.col("_d2")) <= F.col("_limit"))
        p = cut(_fit(_moments(x, [*GROUP, "_start"])).select(*GROUP, "_start", *PARAMS), f"step{k}")
    best = p.groupBy(*GROUP).agg(F.min_by(F.struct(*PARAMS), F.struct("_logdet", "_start")).alias("_best"))
    best = cut(best.select(*GROUP, "_best.*"), "best")
    x = _distance(_join(d, best, rows))
    scale = x.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_rows"), F.percentile(_bin(F.col("_d2")), 0.5).alias("_mid"))
    scale = scale.select(*[F.col(g).alias("_q" + g) for g in GROUP], "_rows",
                         F.greatest(F.expm1(F.col("_mid") / 200) / CHI2_MEDIAN, F.lit(1.0)).alias("_scale"))
    out = best.join(scale, reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col("_q" + g)) for g in GROUP]))
    return cut(out.select(*best.columns, "_rows", "_scale"), "estimate")


def quality(docs: DataFrame, cutoff: float = CUTOFF, support: float = SUPPORT, steps: int = STEPS,
            min_group: int = MIN_GROUP, with_text: bool = True) -> DataFrame:
    """The documents with the counts, ``base_failed``, ``distance`` (squared, scaled) and ``kept``.

    ``with_text=False`` leaves the text out of the table written between the steps.
    """
    docs = keep_clear(docs, OUT)
    d = counts(docs)
    d = d if with_text else d.drop("text")
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    d = cut(_statistics(d), "stats")
    est = mcd(d, support, steps, min_group)
    groups = est.count()
    sized = est.where(F.col("_level") < 2).select(*[F.col(g).alias("_e" + g) for g in GROUP], F.col("_rows").alias("_erows"))
    for level, on in ((0, ["lang", "source"]), (1, ["lang"])):
        e = sized.where(F.col("_e_level") == level).select(
            *[F.col("_e_" + c).alias(f"_e{level}_" + c) for c in on], F.col("_erows").alias(f"_r{level}"))
        d = d.join(small(e, groups), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{level}_" + c)) for c in on]), "left")
    r0, r1 = F.coalesce("_r0", F.lit(0)) >= min_group, F.coalesce("_r1", F.lit(0)) >= min_group
    d = d.withColumn("_level", F.when(r0, 0).when(r1, 1).otherwise(2))
    d = d.withColumn("_lang", F.when(F.col("_level") < 2, F.col("lang")))
    d = d.withColumn("_source", F.when(F.col("_level") < 1, F.col("source")))
    p = est.select(*[F.col(g).alias("_p" + g) for g in GROUP], *PARAMS, "_scale")
    on = reduce(lambda x, y: x & y, [d[g].eqNullSafe(p["_p" + g]) for g in GROUP])
    d = _distance(d.join(small(p, groups), on, "left"))
    d = d.withColumn("distance", F.col("_d2") / F.col("_scale"))
    d = d.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff))
    return d.select(*[F.col(f"`{c}`") for c in docs.columns if with_text or c != "text"], *OUT)
