"""L (folds) and M (metrics, feature weights, significance).

Folds are columns, never materialised copies: a fold id per row, and a
training set is ``fold != k``. Fold assignment is greedy (deterministic,
reproducible in SQL): groups in descending size (id breaks ties) go to the
lightest fold, the first on ties. Groups of one size are a run; a run is dealt
in periods, so the driver sees a row per distinct size and plans rank ranges,
and the groups get their folds by rank. Ranking is a range shuffle of the
one-row-per-group table (``frames.global_rank``).

Metrics are conditional counts over (label, prediction); p-values are
computed by pandas UDFs on the aggregated rows only.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import stats as st
from ..functions import text as tx
from ..functions.frames import carry_last, cut_lineage, global_rank, grouped_prefix_sum


# --- L: folds ---------------------------------------------------------------

def greedy_ranges(runs, k: int):
    """Folds of groups dealt one by one to the lightest fold, from runs
    (size, count) in descending size: (first rank, ranks, folds), the group of
    the range's i-th rank being in fold ``folds[i % len(folds)]``.

    Within a run, the folds lighter than the lightest one plus the size each
    get one group a period, in order of weight; that repeats until the next
    heavier fold joins them. So a run takes at most k periods, however many
    groups it has."""
    loads, rank = [0] * k, 0
    for size, count in runs:
        while count:
            order = sorted(range(k), key=lambda f: (loads[f], f))
            low = loads[order[0]]
            active = [f for f in order if loads[f] < low + size]
            periods = count // len(active)
            if len(active) < k:
                periods = min(periods, (loads[order[len(active)]] - low) // size)
            if not periods:  # fewer groups than active folds are left
                active, periods = active[:count], 1
            for f in active:
                loads[f] += periods * size
            n = periods * len(active)
            yield rank, n, active
            rank, count = rank + n, count - n


# Rank ranges that are broadcast; more of them are joined by shuffle.
BROADCAST_RANGES = 20_000


def greedy_folds(groups: DataFrame, k: int, group_col: str, size_col: str = "size", by: list[str] | None = None) -> DataFrame:
    """(group, fold) for a table of one row a group; within each value of
    ``by`` the folds start empty. Distinct sizes are few (their sum is at most
    the number of rows), so the runs pass through the driver."""
    spark, by = groups.sparkSession, by or []
    groups = cut_lineage(groups)
    ranked = global_rank(groups.withColumn("_neg", -F.col(size_col)), [*by, "_neg", group_col], out_col="grank")
    runs = groups.groupBy(*by, size_col).agg(F.count("*").alias("_c")).orderBy(*by, F.desc(size_col))
    ranges, base = [], 0
    for _, part in groupby(runs.toLocalIterator(), key=lambda r: tuple(r[c] for c in by)):
        sizes = [(r[size_col], r["_c"]) for r in part]
        ranges += [(base + start, base + start + n, folds) for start, n, folds in greedy_ranges(sizes, k)]
        base += sum(c for _, c in sizes)
    table = spark.createDataFrame(ranges, "_from long, _to long, _folds array<int>")
    if len(ranges) <= BROADCAST_RANGES:
        found = ranked.join(F.broadcast(table), (F.col("grank") >= F.col("_from")) & (F.col("grank") < F.col("_to")))
    else:
        both = ranked.select(F.col("grank").alias("_from"), F.lit(1).alias("_kind"), group_col).unionByName(
            table.select("_from", F.lit(0).alias("_kind"), F.struct("_from", "_folds").alias("_range")), allowMissingColumns=True)
        found = (carry_last(both, ["_from", "_kind"], "_range", "_r").filter("_kind = 1")
                 .select(group_col, F.col("_from").alias("grank"), F.col("_r._from").alias("_from"), F.col("_r._folds").alias("_folds")))
    return found.select(group_col, F.get("_folds", ((F.col("grank") - F.col("_from")) % F.size("_folds")).cast("int")).alias("fold"))


def group_kfold(df: DataFrame, k: int = 5, group_col: str = "group_id") -> DataFrame:
    """No group on both sides; the largest groups first, each to the
    fold with the fewest rows."""
    groups = df.groupBy(group_col).agg(F.count("*").alias("size"))
    return df.join(greedy_folds(groups, k, group_col), group_col)


def stratified_group_kfold(df: DataFrame, k: int = 5, group_col: str = "group_id",
                           label_col: str = "label") -> DataFrame:
    """Groups are dealt as in L01 inside their majority label, so each
    fold keeps the class mix."""
    g = df.groupBy(group_col).agg(F.count("*").alias("size"),
                                  F.mode(label_col, deterministic=True).alias("_maj"))
    return df.join(greedy_folds(g, k, group_col, by=["_maj"]), group_col)


def leave_one_out(df: DataFrame, key: str = "filename") -> DataFrame:
    """Each row its own fold (the key is the fold id; Quirk 26 fixed:
    an explicit option, not nfold = 8)."""
    return df.withColumn("fold", F.col(key).cast("string"))


def holdout(df: DataFrame, split_col: str, test_value) -> DataFrame:
    """A supplied test split (fold 0 = test, train otherwise)."""
    return df.withColumn("fold", F.when(F.col(split_col) == test_value, 0).otherwise(-1))


def paired_folds(a: DataFrame, b: DataFrame, k: int = 5, group_col: str = "group_id") -> DataFrame:
    """Group folds of two cohorts with shared fold ids, then a union."""
    return group_kfold(a, k, group_col).unionByName(group_kfold(b, k, group_col))


def leave_pairs_out(df: DataFrame, group_col: str = "group_id", label_col: str = "label") -> DataFrame:
    """Fold i holds out the i-th positive group and the i-th negative
    group (groups ranked by id within each label); unpaired groups stay in
    training everywhere."""
    g = df.groupBy(group_col).agg(F.max(label_col).alias("_l"))
    # rank inside each label = global rank over (label, group) minus the
    # number of groups with a smaller label (distributed, no one-task window)
    ranked = global_rank(g, ["_l", group_col], out_col="_g")
    per_label = g.groupBy("_l").agg(F.count("*").alias("_c"))
    offs = per_label.withColumn("_off", F.coalesce(F.sum("_c").over(
        Window.orderBy("_l").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    r = ranked.join(offs, "_l").withColumn("_i", F.col("_g") - F.col("_off")).drop("_g", "_off")
    pairs = r.groupBy("_i").agg(F.count("*").alias("_n")).filter("_n = 2").select("_i")
    fold = r.join(pairs, "_i", "left_semi").select(group_col, F.col("_i").cast("int").alias("fold"))
    return df.join(fold, group_col, "left")


def majority_baseline(df: DataFrame, fold_col: str = "fold", group_col: str = "group_id",
                      label_col: str = "label", classes=(0, 1)) -> DataFrame:
    """Per fold, predict the most frequent participant label of the
    training side (first label per participant; ties → the smaller label);
    returns (fold, label, prediction) for every row.

    Training counts are totals minus the fold's own counts, so no fold × row
    expansion is built; the class list is fixed, so both are one-row-wide
    conditional aggregates.
    """
    first = df.groupBy(fold_col, group_col).agg(F.min_by(label_col, "filename").alias("_pl"))
    own = first.groupBy(fold_col).agg(*[F.count_if(F.col("_pl") == c).alias(f"_own{i}")
                                        for i, c in enumerate(classes)])
    tot = first.agg(*[F.count_if(F.col("_pl") == c).alias(f"_tot{i}") for i, c in enumerate(classes)])
    j = tx.attach_scalar(own, tot)
    train = [F.col(f"_tot{i}") - F.col(f"_own{i}") for i in range(len(classes))]
    best = F.greatest(*train) if len(train) > 1 else train[0]
    pred = None
    for i, c in enumerate(classes):  # first class reaching the maximum wins ties
        pred = F.when(train[i] == best, F.lit(c)) if pred is None else pred.when(train[i] == best, F.lit(c))
    mode = j.select(fold_col, pred.alias("prediction"))
    return df.join(mode, fold_col).select(fold_col, label_col, "prediction")


# --- M: metrics -------------------------------------------------------------

def confusion_counts(df: DataFrame, label_col="label", pred_col="prediction", by: list[str] | None = None):
    by = by or []
    y, p = F.col(label_col), F.col(pred_col)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(y == p).alias("correct"),
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn"))


def binary_scores(df: DataFrame, label_col="label", pred_col="prediction", by: list[str] | None = None) -> DataFrame:
    """M01 accuracy, M02 binary F1 (0 when undefined), M03 macro F1."""
    c = confusion_counts(df, label_col, pred_col, by)
    f1_pos = F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    f1_neg = F.coalesce(F.try_divide(2.0 * F.col("tn"), 2 * F.col("tn") + F.col("fn") + F.col("fp")), F.lit(0.0))
    return c.select(*(by or []), "n", tx.round6(F.col("correct") / F.col("n")).alias("acc"),
                    tx.round6(f1_pos).alias("fms"), tx.round6((f1_pos + f1_neg) / 2).alias("macro_f1"))


def classification_report(df: DataFrame, label_col="label", pred_col="prediction",
                          names=("non-AD", "AD")) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy,
    macro and weighted averages — rows of one small table built from a
    GROUPING SETS style confusion aggregate."""
    y, p = F.col(label_col), F.col(pred_col)
    rows = []
    c = df.agg(*[F.count_if((y == k) & (p == k)).alias(f"tp{k}") for k in (0, 1)],
               *[F.count_if(p == k).alias(f"pp{k}") for k in (0, 1)],
               *[F.count_if(y == k).alias(f"sup{k}") for k in (0, 1)],
               F.count("*").alias("n"), F.count_if(y == p).alias("correct"))
    for k in (0, 1):
        prec = F.coalesce(F.try_divide(F.col(f"tp{k}").cast("double"), F.col(f"pp{k}")), F.lit(0.0))
        rec = F.coalesce(F.try_divide(F.col(f"tp{k}").cast("double"), F.col(f"sup{k}")), F.lit(0.0))
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(c.select(F.lit(names[k]).alias("class"), prec.alias("precision"), rec.alias("recall"),
                             f1.alias("f1"), F.col(f"sup{k}").alias("support")))
    per = rows[0].unionByName(rows[1])
    tot = c.select("n", "correct")
    macro = per.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    wsum = F.sum("support")
    weighted = per.agg(F.lit("weighted avg").alias("class"),
                       (F.sum(F.col("precision") * F.col("support")) / wsum).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / wsum).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / wsum).alias("f1"), wsum.alias("support"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"), (F.col("correct") / F.col("n")).alias("f1"),
                     F.col("n").alias("support"))
    out = per.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("class", *[tx.round6(c).alias(c) for c in ("precision", "recall", "f1")],
                      F.col("support").cast("bigint").alias("support"))


def regression_scores(df: DataFrame, label_col="label", pred_col="prediction", by=None) -> DataFrame:
    """MSE, RMSE (Quirk 28: both emitted) and R²."""
    by = by or []
    e = F.col(label_col) - F.col(pred_col)
    g = df.groupBy(*by).agg(F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
                            F.var_pop(label_col).alias("vy"), F.count("*").alias("n"))
    return g.select(*by, tx.round6("mse").alias("mse"), tx.round6(F.sqrt("mse")).alias("rmse"),
                    tx.round6(1 - F.try_divide(F.col("sse"), F.col("vy") * F.col("n"))).alias("r2"))


def fold_summary(scores: DataFrame, by: list[str], metrics=("acc", "fms")) -> DataFrame:
    """Nan-mean and population nan-std of fold scores."""
    aggs = []
    for m in metrics:
        v = F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double"))
        aggs += [tx.round6(F.avg(v)).alias(f"{m}_mean"), tx.round6(F.stddev_pop(v)).alias(f"{m}_std")]
    return scores.groupBy(*by).agg(F.count("*").alias("n_folds"), *aggs)


def pivot_features(coefs: DataFrame, feature_names: list[str], blocks: list[str], k: int = 10,
                   coef_col: str = "coefficients", by: list[str] | None = None) -> DataFrame:
    """Slice a coefficient array into named blocks of d features; top-k
    and bottom-k feature names per block (Quirk 30 fixed: the block name comes
    from the position)."""
    by = by or []
    d = len(feature_names)
    names = F.array(*[F.lit(n) for n in feature_names])
    blk = F.array(*[F.lit(b) for b in blocks])
    e = coefs.select(*by, F.posexplode(coef_col).alias("pos", "weight"))
    e = e.select(*by, F.element_at(blk, (F.floor(F.col("pos") / d) + 1).cast("int")).alias("block"),
                 F.element_at(names, (F.col("pos") % d + 1).cast("int")).alias("feature"), "weight")
    w_top = Window.partitionBy(*by, "block").orderBy(F.desc("weight"), "feature")
    w_bot = Window.partitionBy(*by, "block").orderBy("weight", "feature")
    r = e.withColumn("top_rank", F.row_number().over(w_top)).withColumn("bottom_rank", F.row_number().over(w_bot))
    return r.filter((F.col("top_rank") <= k) | (F.col("bottom_rank") <= k)).select(
        *by, "block", "feature", tx.round6("weight").alias("weight"), "top_rank", "bottom_rank")


def averaged_weights(weights: DataFrame, fold_col="fold", by=("block", "feature")) -> DataFrame:
    """Per feature, sum of weights over folds ÷ number of folds (Quirk 29
    fixed: the real fold count, not 5)."""
    nf = weights.select(fold_col).distinct().agg(F.count("*").alias("_nf"))
    return tx.attach_scalar(weights, nf).groupBy(*by).agg(
        tx.round6(F.sum("weight") / F.first("_nf")).alias("avg_weight"))


def welch_table(long_df: DataFrame, feature_col="feature", group_col="cohort", value_col="value",
                a=1, b=0) -> DataFrame:
    """Per feature the unequal-variance t between two cohorts and its
    Welch degrees of freedom (aggregates only; p-value by ``with_t_pvalue``)."""
    g = long_df.groupBy(feature_col).agg(
        *[F.avg(F.when(F.col(group_col) == v, F.col(value_col))).alias(f"m{i}") for i, v in ((0, a), (1, b))],
        *[F.var_samp(F.when(F.col(group_col) == v, F.col(value_col))).alias(f"v{i}") for i, v in ((0, a), (1, b))],
        *[F.count(F.when(F.col(group_col) == v, F.col(value_col))).alias(f"n{i}") for i, v in ((0, a), (1, b))])
    sa, sb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(sa + sb))
    dfree = F.try_divide((sa + sb) ** 2, sa ** 2 / (F.col("n0") - 1) + sb ** 2 / (F.col("n1") - 1))
    return g.select(feature_col, tx.round6("m0").alias("mean_a"), tx.round6("m1").alias("mean_b"),
                    tx.round6(t).alias("t"), tx.round6(dfree).alias("df"))


@F.pandas_udf(T.DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([st.t_pvalue(a, b) if pd.notna(a) and pd.notna(b) else np.nan for a, b in zip(t, df)])


@F.pandas_udf(T.DoubleType())
def _t_directional(t: pd.Series, df: pd.Series, alt: pd.Series) -> pd.Series:
    return pd.Series([st.t_pvalue(a, b, c) if pd.notna(a) and pd.notna(b) else np.nan
                      for a, b, c in zip(t, df, alt)])


@F.pandas_udf(T.DoubleType())
def _chi2_1(x: pd.Series) -> pd.Series:
    return pd.Series([st.chi2_1_sf(v) if pd.notna(v) else np.nan for v in x])


def with_t_pvalue(df: DataFrame, t_col="t", df_col="df", alt_col: str | None = None) -> DataFrame:
    """p-value column for t statistics (two-sided, or per-row alternative)."""
    p = _t_two_sided(t_col, df_col) if alt_col is None else _t_directional(t_col, df_col, alt_col)
    return df.withColumn("p_value", p)


def paired_t(scores: DataFrame, a: str, b: str, on: str = "fold", metric_cols=("acc", "fms"),
             method_col: str = "method") -> DataFrame:
    """Paired t of method ``a`` against ``b`` per metric, with the
    alternative chosen by the direction of the means (reference rule)."""
    x = scores.filter(F.col(method_col) == a).select(on, *[F.col(m).alias(f"a_{m}") for m in metric_cols])
    y = scores.filter(F.col(method_col) == b).select(on, *[F.col(m).alias(f"b_{m}") for m in metric_cols])
    j = x.join(y, on)
    outs = []
    for m in metric_cols:
        d = F.col(f"a_{m}") - F.col(f"b_{m}")
        g = j.agg(F.lit(m).alias("metric"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd"),
                  F.count("*").alias("n"), F.avg(f"a_{m}").alias("mean_a"), F.avg(f"b_{m}").alias("mean_b"))
        outs.append(g)
    g = outs[0]
    for o in outs[1:]:
        g = g.unionByName(o)
    t = F.try_divide(F.col("mean_diff"), F.col("sd") / F.sqrt("n"))
    alt = (F.when(F.col("mean_a") > F.col("mean_b"), "greater")
           .when(F.col("mean_a") < F.col("mean_b"), "less").otherwise("two-sided"))
    return g.select("metric", "n", tx.round6("mean_diff").alias("mean_diff"), tx.round6(t).alias("t"),
                    (F.col("n") - 1).alias("df"), alt.alias("alternative"))


EXACT_PAIRS = 1000  # pairs up to which the exact null distribution is built


@F.pandas_udf(T.StructType([T.StructField("p_value", T.DoubleType()), T.StructField("p_exact", T.DoubleType())]))
def _signed_rank_p(n: pd.Series, w: pd.Series, ties: pd.Series, zeros: pd.Series, alt: pd.Series, groups: pd.Series) -> pd.DataFrame:
    out = []
    for n_, w_, t, z, a, g in zip(n, w, ties, zeros, alt, groups):
        exact = None
        if n_ <= EXACT_PAIRS:
            g = [] if g is None else list(g)
            exact = st.signed_rank_exact([int(x["doubled"]) for x in g], [int(x["c"]) for x in g], round(2 * w_ - z * (z + 1) / 2), a)
        out.append((exact if exact is not None and not t and not z else st.signed_rank_p(n_, w_, t, z, a), exact))
    return pd.DataFrame(out, columns=["p_value", "p_exact"])


def signed_ranks(pairs: DataFrame, by: str = "metric") -> DataFrame:
    """Rank sums of paired differences ``d`` (with ``va``, ``vb``) per ``by``:
    n, w (rank sum of the positive differences, zeros split half and half),
    zeros, ties (sum of c³ − c), the direction of the means, and the tie groups
    (``doubled`` average rank, count) where n is at most EXACT_PAIRS.

    Equal |d| are counted first; a group's average rank is the number of pairs
    before it (a distributed prefix sum over the groups) plus (c + 1) / 2. So
    no task ranks all pairs of a metric."""
    g = pairs.groupBy(by, F.abs("d").alias("a")).agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"),
                                                     F.sum("va").alias("va"), F.sum("vb").alias("vb"))
    r = cut_lineage(grouped_prefix_sum(g, by, "a", "c", "before").withColumn("doubled", 2 * F.col("before") + F.col("c") + 1))
    zero = F.col("a") == 0
    rank = F.col("doubled") / 2
    s = r.groupBy(by).agg(
        F.sum("c").alias("n"), F.sum(rank * F.col("up") + F.when(zero, rank * F.col("c") / 2).otherwise(0)).alias("w"),
        F.coalesce(F.sum(F.when(zero, F.col("c"))), F.lit(0)).alias("zeros"),
        F.sum((F.col("c") * F.col("c") * F.col("c") - F.col("c")).cast("double")).alias("ties"),
        F.sum("va").alias("va"), F.sum("vb").alias("vb"))
    s = s.withColumn("alternative", F.when(F.col("va") > F.col("vb"), "greater").when(F.col("va") < F.col("vb"), "less").otherwise("two-sided"))
    few = r.filter(~zero).join(s.filter(F.col("n") <= EXACT_PAIRS).select(by), by, "left_semi")
    groups = few.groupBy(by).agg(F.collect_list(F.struct("doubled", "c")).alias("groups"))
    return s.drop("va", "vb").join(groups, by, "left")


def wilcoxon_table(scores: DataFrame, a: str, b: str, on: str = "fold", metric_cols=("acc", "fms"),
                   method_col: str = "method") -> DataFrame:
    """Signed-rank statistic (zsplit) with average ranks for ties per
    metric. ``p_value``: exact without ties and zeros, else the normal
    approximation with tie correction, as the reference has it; ``p_exact``:
    exact given the ranks, also with ties and zeros (null above EXACT_PAIRS
    pairs). The p-value UDF sees one row per metric."""
    x = scores.filter(F.col(method_col) == a).select(on, *[F.col(m).alias(f"a_{m}") for m in metric_cols])
    y = scores.filter(F.col(method_col) == b).select(on, *[F.col(m).alias(f"b_{m}") for m in metric_cols])
    pair = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("va"), F.col(f"b_{m}").alias("vb")) for m in metric_cols]))
    long = x.join(y, on).select(pair.alias("x")).select("x.*").withColumn("d", F.col("va") - F.col("vb"))
    p = _signed_rank_p("n", "w", "ties", "zeros", "alternative", "groups")
    return signed_ranks(long).withColumn("p", p).select("metric", "n", "w", "p.p_value", "p.p_exact", "alternative")


def mcnemar(df: DataFrame, label_col="label", a="pred_a", b="pred_b") -> DataFrame:
    """Continuity-corrected McNemar χ² of two prediction columns
    (b = only A right, c = only B right)."""
    y = F.col(label_col)
    g = df.agg(F.count_if((F.col(a) == y) & (F.col(b) != y)).alias("b"),
               F.count_if((F.col(a) != y) & (F.col(b) == y)).alias("c"))
    chi = F.try_divide((F.abs(F.col("b") - F.col("c")) - 1) ** 2, (F.col("b") + F.col("c")).cast("double"))
    return g.select("b", "c", tx.round6(F.coalesce(chi, F.lit(0.0))).alias("chi2"))


def mcnemar_pvalue(tbl: DataFrame) -> DataFrame:
    return tbl.withColumn("p_value", _chi2_1("chi2"))


def ranked_significance(weights: DataFrame, pvalues: DataFrame, key="feature") -> DataFrame:
    """Weight table joined with per-feature p-values, by weight."""
    return weights.join(pvalues, key).orderBy(F.desc("weight"), key)


def training_side_welch(long_df: DataFrame, fold_col: str = "fold", feature_col="feature", value_col="value",
                        label_col="label") -> DataFrame:
    """Welch t of every feature on the training side of every fold (rows with
    fold != k), from per-(fold, feature, label) moments: those of the other
    folds are combined, so no row is replicated per fold."""
    v = F.col(value_col)
    s = long_df.groupBy(fold_col, feature_col, label_col).agg(
        F.count(v).alias("n"), F.avg(v).alias("m"), (F.var_samp(v) * (F.count(v) - 1)).alias("m2")).filter("n > 0")
    # Everything below reads only the small per-(fold, feature, label) table.
    # Moments are combined about the feature's overall mean, so that large
    # values with a small spread lose no digits.
    mid = s.groupBy(feature_col, label_col).agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mid"))
    cells = s.join(mid, [feature_col, label_col]).withColumn("d", F.col("m") - F.col("mid")).withColumnRenamed(fold_col, "_own")
    folds = s.select(fold_col).distinct()
    others = tx.attach_scalar(cells, folds.agg(F.collect_list(fold_col).alias("_folds"))).withColumn(
        fold_col, F.explode("_folds")).filter(~F.col("_own").eqNullSafe(F.col(fold_col)))
    nd = F.sum(F.col("n") * F.col("d"))
    c = others.groupBy(fold_col, feature_col, label_col).agg(
        F.sum("n").alias("n"), (F.first("mid") + nd / F.sum("n")).alias("m"),
        F.try_divide(F.sum(F.coalesce("m2", F.lit(0.0)) + F.col("n") * F.col("d") * F.col("d")) - nd * nd / F.sum("n"), F.sum("n") - 1).alias("v"))
    a = c.filter(F.col(label_col) == 1).select(fold_col, feature_col, F.col("n").alias("na"),
                                               F.col("m").alias("ma"), F.col("v").alias("va"))
    b = c.filter(F.col(label_col) == 0).select(fold_col, feature_col, F.col("n").alias("nb"),
                                               F.col("m").alias("mb"), F.col("v").alias("vb"))
    j = a.join(b, [fold_col, feature_col])
    t = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(F.col("va") / F.col("na") + F.col("vb") / F.col("nb")))
    return j.select(fold_col, feature_col, t.alias("t"))
