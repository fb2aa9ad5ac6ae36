"""Writes as pure snapshots: each function returns the next state of a table, which one write then stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str], keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """New values win on the natural key; columns in keep stay as they were. Repeated keys of new: the greatest row."""
    once = new.groupBy(*key).agg(*[F.max(F.struct(*[c for c in new.columns if c not in key])).alias("_n")])
    j = old.withColumn("_old", F.lit(True)).join(once, key, "full")
    value = lambda c: F.when(F.col("_n").isNull(), F.col(c)).when(F.col("_old") & F.lit(c in keep), F.col(c)).otherwise(F.col(f"_n.{c}"))
    return j.select(*[F.col(c) if c in key else value(c).alias(c) for c in old.columns])


def insert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def replace_children(old: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """All rows of the parents that new has are replaced."""
    return old.join(new.select(*parent).distinct(), parent, "left_anti").unionByName(new.select(*old.columns))


def apply_decisions(old: DataFrame, decisions: DataFrame, key: list[str]) -> DataFrame:
    """Set the columns that decisions has beside the key, where it has a row; a null decision leaves the value."""
    names = [c for c in decisions.columns if c not in key]
    j = old.join(decisions.select(*key, *[F.col(c).alias(f"_d_{c}") for c in names]), key, "left")
    return j.select(*[F.coalesce(f"_d_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def set_columns(old: DataFrame, values: DataFrame, key: list[str]) -> DataFrame:
    """Set the columns that values has beside the key, where it has a row; a null there makes the column null."""
    names = [c for c in values.columns if c not in key]
    j = old.join(values.select(*key, F.struct(*names).alias("_v")), key, "left")
    return j.select(*[F.when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns])


def count_attempt(attempts: Column, status: Column, failed: Column, most: int = 3) -> tuple[Column, Column]:
    """(attempts, status) after one more attempt; the status is failed for good once there have been most."""
    n = attempts + failed.cast("int")
    return n, F.when(failed & (n >= most), "failed").otherwise(status)


def promote(old: DataFrame, bodies: DataFrame) -> DataFrame:
    """Stubs (signal_id, url, content_hash, raw_text) get their bodies, unless another row has that url and hash; of bodies
    with the same ones, that of the least id."""
    first = bodies.groupBy("url", "content_hash").agg(F.min("signal_id").alias("signal_id"))
    bodies = bodies.join(first, ["url", "content_hash", "signal_id"], "left_semi")
    taken = bodies.join(old.select("url", "content_hash", F.col("signal_id").alias("_o")), ["url", "content_hash"]).where("_o <> signal_id").select("signal_id").distinct()
    return apply_decisions(old, bodies.join(taken, "signal_id", "left_anti").select("signal_id", "content_hash", "raw_text"), ["signal_id"])


def get_or_create(dimension: DataFrame, wanted: DataFrame, key: str, name: str) -> DataFrame:
    """Dimension rows (key, name) with the wanted ones added; a name that another key has already falls back to the key."""
    new = wanted.dropDuplicates([key]).join(dimension.select(key), key, "left_anti")
    first = F.row_number().over(Window.partitionBy(name).orderBy(key))
    used = dimension.select(F.col(name).alias("_used")).distinct()
    new = new.withColumn("_n", first).join(used, F.col(name) == F.col("_used"), "left")
    return dimension.unionByName(new.select(key, F.when(F.col("_used").isNotNull() | (F.col("_n") > 1), F.col(key)).otherwise(F.col(name)).alias(name)))


def next_versions(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows with the version after the parent's latest (1 at first)."""
    last = stored.groupBy(key).agg(F.max("version").alias("_v"))
    return new.join(last, key, "left").withColumn("version", F.coalesce("_v", F.lit(0)) + 1).drop("_v")


def write_sorted_tsv(df: DataFrame, path: str, key: str) -> None:
    """A gzip TSV in one file, sorted by key: an artifact of bounded size, not a table."""
    df.orderBy(key).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True, compression="gzip", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """A result for readers as JSON lines."""
    df.write.mode("overwrite").json(path)
