"""Semantic entropy over sampled responses: clustering, and six ways to normalize."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, collapsed


def yes_no_cluster(response: Column) -> Column:
    """``yes``, ``no`` or ``unclear`` by keywords, as substrings."""
    t = F.lower(response)
    yes = any_of(t, ["yes", "mentioned", "discussed", "confirmed", "stated"]) & ~any_of(t, ["not", "no", "didn't", "wasn't", "unclear"])
    return F.when(yes, "yes").when(any_of(t, ["no", "not", "didn't", "wasn't", "never"]), "no").otherwise("unclear")


def verdict_cluster(response: Column, strict: bool = False) -> Column:
    """``verified``, ``contradiction``, ``uncertain`` or ``other``; the first rule wins. ``strict``: "incorrect" is not "correct"."""
    t = F.lower(response)
    right = F.rlike(t, F.lit(r"\bcorrect")) if strict else F.contains(t, F.lit("correct"))
    return F.when(any_of(t, ["verified", "confirmed"]) | right, "verified").when(any_of(t, ["contradiction", "incorrect", "error"]), "contradiction").when(any_of(t, ["uncertain", "cannot", "review"]), "uncertain").otherwise("other")


def exact_cluster(response: Column) -> Column:
    return collapsed(response)


def cluster_sizes(df: DataFrame, item: str, cluster: Column) -> DataFrame:
    """``item, cluster, size``: partial counts meet in one shuffle."""
    return df.groupBy(F.col(item), cluster.alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def semantic_entropy(sizes: DataFrame, item: str, requested: int | None = None) -> DataFrame:
    """Entropy of each item from its cluster sizes.

    ``entropy_bits`` (log2), ``entropy_of_n`` (over log2 of the responses), ``entropy_of_requested``
    (over log2 of the number asked for, 1 at most), ``entropy_of_k`` (natural, over the log of
    the clusters), ``entropy_floored`` (the same over 1 at least), ``n_responses``, ``n_clusters``.
    Sums over an item's clusters only, so no window is needed.
    """
    c = F.col("size").cast("double")
    per = sizes.groupBy(item).agg(F.sum("size").alias("n_responses"), F.count(F.lit(1)).alias("n_clusters"), F.sum(c * F.log2(c)).alias("_s"), F.collect_list(c).alias("_sizes"))
    n = F.col("n_responses").cast("double")
    bits = F.greatest(F.lit(0.0), F.log2(n) - F.col("_s") / n)
    smoothed = F.aggregate("_sizes", F.lit(0.0), lambda a, x: a - (x / n) * F.log(x / n + 1e-10))
    log_k = F.log(F.col("n_clusters").cast("double"))
    over_k = F.when(F.col("n_clusters") > 1, log_k).otherwise(1.0)
    asked = F.lit(requested).cast("double") if requested else n
    return per.select(
        item,
        "n_responses",
        "n_clusters",
        F.round(bits, 6).alias("entropy_bits"),
        F.round(F.when(n > 1, bits / F.log2(n)).otherwise(0.0), 6).alias("entropy_of_n"),
        F.round(F.when(asked > 1, F.least(F.lit(1.0), bits / F.log2(asked))).otherwise(0.0), 6).alias("entropy_of_requested"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), smoothed / over_k)), 6).alias("entropy_of_k"),
        F.round(F.greatest(F.lit(0.0), smoothed) / F.greatest(over_k, F.lit(1.0)), 4).alias("entropy_floored"),
    )


def consistency(df: DataFrame, item: str, response: Column) -> DataFrame:
    """Share of the most frequent response; 1 for a single one."""
    sizes = cluster_sizes(df, item, response)
    return sizes.groupBy(item).agg((F.max("size") / F.sum("size")).alias("consistency"), F.sum("size").alias("n_responses"))


def first_seen_clusters(df: DataFrame, item: str, order: str, response: Column) -> DataFrame:
    """Cluster numbers from 0 in order of first appearance of a response within its item."""
    marked = df.withColumn("_norm", response)
    first = marked.groupBy(item, "_norm").agg(F.min(order).alias("_first"))
    numbered = first.withColumn("cluster_id", F.dense_rank().over(Window.partitionBy(item).orderBy("_first")) - 1)
    return marked.join(numbered.select(item, "_norm", "cluster_id"), [item, "_norm"]).drop("_norm")


def equal_clusters(df: DataFrame, item: str, order: str, response: Column) -> DataFrame:
    """``entailment_clusters`` where equal responses of an item entail each other and no others do: linear, as no pairs are made.

    Clusters are numbered from 0 by their first place. A row without item, place or response is a cluster of its own;
    those without a place come last. Responses are told apart by SHA-256, rows are shuffled once.
    """
    alone = F.col(item).isNull() | F.col(order).isNull() | response.isNull()
    rows = df.select(item, F.col(order).cast("long").alias(order), F.when(~alone, F.unhex(F.sha2(response, 256))).alias("_k"), F.when(alone, F.monotonically_increasing_id()).alias("_own"))
    classes = rows.repartition(item).groupBy(item, "_k", "_own").agg(F.min(order).alias("_first"), F.collect_list(F.struct(order)).alias("_all"))
    place = F.row_number().over(Window.partitionBy(item).orderBy(F.col("_first").asc_nulls_last(), "_k", "_own"))
    return classes.select(item, "_all", (place - 1).alias("cluster_id")).select(item, F.explode("_all").alias("_x"), "cluster_id").select(item, f"_x.{order}", "cluster_id")


def entailment_clusters(df: DataFrame, pairs: DataFrame, item: str, order: str) -> DataFrame:
    """Greedy clusters by two-way entailment: a response joins the first cluster whose first member entails it and is entailed by it.

    ``pairs`` holds ``item, premise, hypothesis`` (places in ``order``) of entailments that hold.
    Items are independent, and each is a handful of sampled responses.
    """
    both = pairs.alias("a").join(pairs.alias("b"), (F.col(f"a.{item}") == F.col(f"b.{item}")) & (F.col("a.premise") == F.col("b.hypothesis")) & (F.col("a.hypothesis") == F.col("b.premise")))
    mutual = both.groupBy(F.col(f"a.{item}").alias(item), F.col("a.premise").alias(order)).agg(F.collect_set("a.hypothesis").alias("equal"))
    rows = df.select(item, F.col(order).cast("long").alias(order)).join(mutual.withColumn(order, F.col(order).cast("long")), [item, order], "left")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        heads: list[int] = []
        out = []
        for place, equal in group.sort_values(order)[[order, "equal"]].itertuples(index=False):
            known = set() if equal is None else set(equal)
            found = next((i for i, head in enumerate(heads) if head in known), None)
            if found is None:
                found = len(heads)
                heads.append(place)
            out.append(found)
        return pd.DataFrame({item: group[item], order: group.sort_values(order)[order].to_numpy(), "cluster_id": out})

    kind = dict(df.dtypes)[item]
    return rows.groupBy(item).applyInPandas(fold, f"{item} {kind}, {order} long, cluster_id int")
