"""J (+ A08, A09, A12): feature-table assembly — joins, filters, label and
group rules, sampling, polynomial terms, top-k selection, set operations.

Everything is a DataFrame → DataFrame plan. Feature families join on the
transcript key with shuffle (sort-merge or AQE-chosen) joins — they are all
one-row-per-transcript tables of similar size, so none is broadcast.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.frames import global_rank, permuted


def join_features(families: list[DataFrame], key: str = "filename", how: str = "inner") -> DataFrame:
    """Chained equi-join of feature families on the transcript key."""
    return reduce(lambda a, b: a.join(b, key, how), families)


def join_cohort(features: DataFrame, cohort: DataFrame | None, key: str = "filename") -> DataFrame:
    """Inner join to the cohort table; pass-through for an unlabelled set."""
    return features if cohort is None else features.join(cohort, key, "inner")


def drop_listed(df: DataFrame, exclusions: DataFrame, key: str = "filename") -> DataFrame:
    """Rows whose key is not in the exclusion (or other) list."""
    return df.join(exclusions.select(key).distinct(), key, "left_anti")


def label_rule(df: DataFrame, corpus_col: str, rules: dict, regression_col: str | None = None,
               scale: float = 30.0) -> DataFrame:
    """The label column chosen per corpus; with ``regression_col`` the
    target is that column / ``scale`` (MMSE / 30 in the reference)."""
    if regression_col is not None:
        return df.withColumn("label", F.col(regression_col).cast("double") / scale)
    e = None
    for corpus, c in rules.items():
        cond = F.col(corpus_col) == corpus
        e = F.when(cond, F.col(c)) if e is None else e.when(cond, F.col(c))
    return df.withColumn("label", e.cast("int"))


def group_key(df: DataFrame, mode: str, key: str = "filename", column: str | None = None) -> DataFrame:
    """Participant id — first three characters of the key, the key
    itself, or another column."""
    if mode == "prefix3":
        g = F.substring(F.col(key).cast("string"), 1, 3)
    elif mode == "key":
        g = F.col(key).cast("string")
    elif mode == "column":
        g = F.col(column).cast("string")
    else:
        raise ValueError(f"unknown group mode {mode!r}")
    return df.withColumn("group_id", g)


def domain_flag(df: DataFrame, is_test) -> DataFrame:
    """0 = training domain, 1 = sample / test domain."""
    return df.withColumn("domain", F.when(is_test, 1).otherwise(0))


def prune_columns(df: DataFrame, drop: list[str]) -> DataFrame:
    """Drop ids, labels, unnamed index columns and listed features."""
    unnamed = [c for c in df.columns if c.startswith("Unnamed")]
    return df.drop(*drop, *unnamed)


def coerce_numeric(df: DataFrame, feature_cols: list[str]) -> DataFrame:
    """Numeric when parseable (``try_cast``), then null → 0."""
    out = df.select(*[F.col(c).cast("string").try_cast("double").alias(c) if c in feature_cols else F.col(c)
                      for c in df.columns])
    return out.fillna(0.0, subset=feature_cols)


def seeded_shuffle(df: DataFrame, seed: int = 20) -> DataFrame:
    """A seeded random order, only where row order matters downstream."""
    return df.orderBy(F.rand(seed))


def seeded_permutation(df: DataFrame, key, seed: int = 20, out_col: str = "position") -> DataFrame:
    """Every row's place in a random order that only the keys' order and
    the seed decide. Two tables with the same keys get the same order (the
    paired shuffle). The rank is a range shuffle of the rows; the permutation
    of the ranks needs none."""
    n = df.count()
    ranked = global_rank(df, key, out_col="_rank")
    return ranked.withColumn(out_col, permuted(F.col("_rank"), max(n, 1), seed)).drop("_rank")


def concat_and_shuffle(parts: list[DataFrame], key: str = "filename", seed: int = 1, out_col: str = "position") -> DataFrame:
    """Labelled sets stacked (``part`` numbers them) and shuffled as one."""
    stacked = concat(*[p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return seeded_permutation(stacked, ["part", key], seed, out_col)


def participant_first(df: DataFrame, k: int, group_col: str = "group_id", order_col: str = "filename") -> DataFrame:
    """K rows, one per participant first (in input order), topped up with
    the participants' further rows in input order — a top-k, not a sample.
    ``order_col`` is a key: a participant's first row is the one at its
    smallest key, a combined aggregate instead of a sort of all its rows."""
    first = df.groupBy(F.col(group_col).alias("_g")).agg(F.min(order_col).alias("_first"))
    marked = df.join(first, F.col(group_col).eqNullSafe(F.col("_g")))
    return marked.orderBy((F.col(order_col) > F.col("_first")).cast("int"), order_col).limit(k).drop("_g", "_first")


def biased_cohort(df: DataFrame, label_col: str, pos: int, neg: int, **kw) -> DataFrame:
    """J12 on positives and on negatives, then a union."""
    return participant_first(df.filter(F.col(label_col) == 1), pos, **kw).unionByName(
        participant_first(df.filter(F.col(label_col) == 0), neg, **kw))


def split_two(df: DataFrame, cond) -> tuple[DataFrame, DataFrame]:
    """Two partitions of one table (e.g. controls and MCI)."""
    return df.filter(cond), df.filter(~cond)


def polynomial_terms(df: DataFrame, cols: list[str]) -> DataFrame:
    """Every product f1·f2 with repetition, ``sqr_`` / ``intr_`` names."""
    extra = []
    for a, b in combinations_with_replacement(cols, 2):
        name = ("sqr_" if a == b else "intr_") + a + "_" + b
        extra.append((F.col(a) * F.col(b)).alias(name))
    return df.select("*", *extra)


def top_k_features(weights: DataFrame, k: int, feature_col: str = "feature", weight_col: str = "weight") -> DataFrame:
    """The first k features of a ranked weight table (name breaks ties)."""
    return weights.orderBy(F.desc(weight_col), feature_col).limit(k)


def concat(*dfs: DataFrame) -> DataFrame:
    """Stack labelled sets (columns matched by name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedup_keep_first(df: DataFrame, key: str = "filename", order_col: str = "src_order") -> DataFrame:
    """Union result de-duplicated, first row per key by input order."""
    w = Window.partitionBy(key).orderBy(order_col)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def long_to_wide(long_df: DataFrame, key: str, name_col: str, value_col: str, names: list[str]) -> DataFrame:
    """(key, feature, value) → one wide row per key (fixed column list,
    so no value-discovery pass)."""
    return long_df.groupBy(key).pivot(name_col, names).agg(F.first(value_col))


def composition_shares(df: DataFrame, domain_col: str = "domain", label_col: str = "label") -> DataFrame:
    """Share of each domain among the rows and positive share per domain."""
    total = df.groupBy().agg(F.count("*").alias("total"))
    g = df.groupBy(domain_col).agg(F.count("*").alias("n"),
                                   tx.round6(F.avg(F.col(label_col).cast("double"))).alias("positive_share"))
    return tx.attach_scalar(g, total).select(
        domain_col, "n", tx.round6(F.col("n") / F.col("total")).alias("row_share"), "positive_share")


def chosen_features(families: dict[str, list[str]], flags, weights: DataFrame | None = None, k: int | None = None) -> list[str]:
    """The feature names of the families whose flag is set, in their order;
    with ``k``, only those among the first k of a ranked weight table (J16)."""
    names = [c for (_, cols), on in zip(families.items(), flags) if on for c in cols]
    if k is None:
        return names
    top = {r["feature"] for r in top_k_features(weights.filter(F.col("feature").isin(names)), k).collect()}
    return [c for c in names if c in top]


def target_source(table: DataFrame, sources: list, target, features: list[str], source_bias=None, target_bias=None,
                  exclude: DataFrame | None = None, key: str = "filename") -> DataFrame:
    """One training table from several corpora of a labelled feature
    table. ``sources`` and ``target`` are conditions; a bias is (positive,
    negative) rows per corpus, participants first (J13); ``exclude`` is a table
    of keys to leave out (J03). Returns the key, group_id, label, ``corpus``
    (0 .. n-1 the sources, n the target), ``domain`` and the ``features``
    array, zero where null (J10)."""
    if exclude is not None:
        table = drop_listed(table, exclude, key)
    parts = []
    for i, cond in enumerate([*sources, target]):
        last = i == len(sources)
        part, bias = table.filter(cond), target_bias if last else source_bias
        if bias:
            part = biased_cohort(part, "label", *bias)
        parts.append(part.withColumn("corpus", F.lit(i)).withColumn("domain", F.lit(int(last))))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    return concat(*parts).select(key, "group_id", "label", "corpus", "domain", x.alias("features"))
