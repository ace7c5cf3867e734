"""Catalogue scans: search, round-robin samples and runs, semi- and anti-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.text import ARCHIVE, token_overlap
from tessera.operators.numbering import numbered
from tessera.operators.tables import held


def search(synsets: DataFrame, phrase: str, limit: int, between: str = ARCHIVE) -> DataFrame:
    """Best matches by token overlap; ties by id."""
    scored = synsets.withColumn("score", token_overlap(phrase, F.col("description"), between))
    return scored.where("score > 0").orderBy(F.desc("score"), "synset_id").limit(limit)


def round_robin(images: DataFrame, group: str, order: str, per_round: int, limit: int | None = None) -> DataFrame:
    """Run r takes the r-th `per_round` images of every group, groups in order, up to a limit, or until all are exhausted.

    No run beyond `limit` images of a group is ever taken, so with a limit each group gives its
    first `limit` rows only and Spark can keep a partial top-k. Without one see exhausted().
    """
    if limit is None:
        return exhausted(images, group, order, per_round)
    ranked = images.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(order)).cast("long")).where(F.col("rank") <= limit)
    return ranked.withColumn("round", F.floor((F.col("rank") - 1) / per_round).cast("long")).orderBy("round", group, "rank").limit(limit)


def exhausted(images: DataFrame, group: str, order: str, per_round: int) -> DataFrame:
    """All images with rank, round and position (from 0) in the run of rounds until every group is exhausted.

    Ranks are places in the order of groups, less the place of the group's first; positions
    are places in the order of rounds. Both come from range exchanges, so neither a group
    nor the whole is one task's work. (group, order) must be unique. Images of a null group
    are one group, the first.
    """
    placed = numbered(images, [group, order], "_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first")).select(F.col(group).alias("_group"), "_first")
    # As many rows as groups, held, so that a large group of images can be split in the join.
    ranked = placed.join(held(first).hint("merge"), F.col(group).eqNullSafe(F.col("_group"))).withColumn("rank", F.col("_place") - F.col("_first") + 1).drop("_place", "_first", "_group")
    rounds = ranked.withColumn("round", F.floor((F.col("rank") - 1) / per_round).cast("long"))
    return numbered(rounds, ["round", group, "rank"], "position")


def annotated(images: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    return images.join(annotations, key, "left_semi")


def negatives(images: DataFrame, group: str, positive: str, order: str, limit: int | None = None) -> DataFrame:
    """Images of all other groups, one of each in turn, up to a limit or all of them."""
    return round_robin(images.where(F.col(group) != positive), group, order, 1, limit)


def replace_by_key(models: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Models with those of equal key replaced."""
    return models.join(new, key, "left_anti").unionByName(new)


def delete_by_key(models: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Models without those of the keys of another table."""
    return models.join(gone, key, "left_anti")


def append_components(models: DataFrame, new: DataFrame, by: str, number: str) -> DataFrame:
    """Components of both tables; those of `new` are numbered on from the class's highest number, which is looked up by a grouped maximum."""
    top = models.groupBy(by).agg(F.max(number).alias("_top"))
    later = new.join(top, by, "left").withColumn(number, F.col(number) + F.coalesce(F.col("_top") + 1, F.lit(0))).drop("_top")
    return models.unionByName(later)


def without_component(components: DataFrame, number: str, i: int, by: str) -> DataFrame:
    """Components without the i-th of each class; later ones move up."""
    kept = components.where(F.col(number) != i)
    return kept.withColumn(number, F.col(number) - (F.col(number) > i).cast("int"))
