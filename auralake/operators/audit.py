"""Dataset audit: distributions, near-duplicates, split leakage, imbalance and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import SPLIT_NAMES


def canonical_split(name: Column) -> Column:
    low = F.lower(F.trim(name))
    return F.when(low == "val", "validation").otherwise(low)


def split_of(path: Column, names: tuple[str, ...] = SPLIT_NAMES) -> Column:
    """The split named by the folder nearest the file; null without one."""
    parts = F.split(path, "/")
    folders = F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1))
    return canonical_split(F.try_element_at(F.filter(folders, lambda x: F.lower(x).isin(*names)), F.lit(1)))


def distributions(records: DataFrame) -> DataFrame:
    """kind, key and count of speakers, content types and splits of readable records."""
    ok = records.where("error is null").withColumn("split", F.coalesce(split_of(F.col("file")), F.lit("unassigned"))).withColumn("content_type", F.coalesce("content_type", F.lit("unknown")))
    each = ok.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("speaker", "speaker"), ("content", "content_type"), ("split", "split"))])).alias("e")).select("e.*")
    return each.where("key is not null").groupBy("kind", "key").agg(F.count("*").alias("n"))


def near_duplicates(records: DataFrame, source: str = "file") -> DataFrame:
    """Signatures shared by several records of more than one source: their number and splits, without gathering members in a row."""
    ok = records.where("error is null and signature is not null").withColumn("split", split_of(F.col("file")))
    groups = ok.groupBy("signature").agg(F.count("*").alias("n"), F.countDistinct(source).alias("sources"), F.array_sort(F.collect_set("split")).alias("splits"), F.array_sort(F.collect_set("declared")).alias("declared"), F.min("file").alias("kept"))
    return groups.where("n > 1 and sources > 1")


def split_leakage(records: DataFrame) -> DataFrame:
    """kind, key and splits of duplicate groups and speakers that are found in more than one split."""
    dup = near_duplicates(records).where(F.size("splits") > 1).select(F.lit("duplicate").alias("kind"), F.col("signature").alias("key"), "splits")
    ok = records.where("error is null and speaker is not null").withColumn("split", split_of(F.col("file")))
    spk = ok.groupBy("speaker").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)
    return dup.union(spk.select(F.lit("speaker").alias("kind"), F.col("speaker").alias("key"), "splits"))


def label_conflicts(records: DataFrame) -> DataFrame:
    """Duplicate groups that declare more than one label."""
    return near_duplicates(records).where(F.size("declared") > 1).select("signature", "n", "declared")


def remediation(records: DataFrame, imbalance_ratio: float = 0.6) -> DataFrame:
    """priority, action and number of items, for actions with any."""
    ok = records.where("error is null")
    speakers = ok.where("speaker is not null").groupBy("speaker").agg(F.count("*").alias("n"))
    one = lambda df, priority, action, items: df.agg(items.cast("long").alias("items")).select(F.lit(priority).alias("priority"), F.lit(action).alias("action"), "items")
    mismatch = ok.where("declared is not null and content_type is not null and content_type != 'unknown' and declared != content_type").select(F.lit(1).alias("x"))
    labelled = ok.select(F.size("labels").alias("k")).where("k > 0") if "labels" in records.columns else ok.select(F.lit(0).alias("k")).where(F.lit(False))
    plan = [
        one(near_duplicates(records), 1, "deduplicate", F.count("*")),
        one(split_leakage(records), 1, "remove_split_leakage", F.count("*")),
        one(records.where("error is not null"), 1, "fix_or_remove_unreadable", F.count("*")),
        one(speakers, 2, "rebalance_speakers", F.when(F.max("n") > F.greatest(F.lit(1), F.sum("n") * imbalance_ratio), F.count("*"))),
        one(mismatch.union(label_conflicts(records).select(F.lit(1))), 2, "review_content_labels", F.count("*")),
        one(labelled, 3, "repair_or_remove_quality_outliers", F.sum("k")),
    ]
    out = plan[0]
    for p in plan[1:]:
        out = out.union(p)
    return out.where("items > 0").orderBy("priority", "action")


def members(records: DataFrame, source: str = "file") -> DataFrame:
    """signature, file and whether it is the one to keep (the smallest), of near-duplicate groups: a row a member."""
    groups = near_duplicates(records, source).select("signature", "kept")
    ok = records.where("error is null and signature is not null")
    return ok.join(groups, "signature").select("signature", "file", (F.col("file") == F.col("kept")).alias("keep"))


def leaking_files(records: DataFrame) -> DataFrame:
    """kind, key and file of all records in duplicate groups or of speakers that are found in more than one split."""
    found = split_leakage(records).select("kind", "key")
    ok = records.where("error is null")
    each = ok.select("file", F.explode(F.array(F.struct(F.lit("duplicate").alias("kind"), F.col("signature").alias("key")), F.struct(F.lit("speaker").alias("kind"), F.col("speaker").alias("key")))).alias("e")).select("file", "e.*")
    with_split = each.where((F.col("kind") == "duplicate") | split_of(F.col("file")).isNotNull())
    return with_split.join(found, ["kind", "key"], "left_semi")


def label_distribution(records: DataFrame) -> DataFrame:
    """key and count of defect labels (array `labels` of ids) of readable records."""
    return records.where("error is null").select(F.explode("labels").alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def coverage(records: DataFrame) -> DataFrame:
    """One row: files, failed files, distinct speakers, content types and splits, and what the audit can't judge."""
    ok = F.col("error").isNull()
    when = lambda c: F.when(ok, c if isinstance(c, Column) else F.col(c))
    warnings = F.array_compact(F.array(F.when(F.count(when("signature")) == 0, "no fingerprints: near-duplicates were not checked"), F.when(F.count(when("speaker")) == 0, "no speakers: speaker leakage and balance were not checked")))
    return records.agg(F.count("*").alias("file_count"), F.count_if(~ok).alias("failed_files"), F.countDistinct(when("speaker")).alias("speakers"), F.countDistinct(when(F.coalesce("content_type", F.lit("unknown")))).alias("content_types"), F.countDistinct(when(F.coalesce(split_of(F.col("file")), F.lit("unassigned")))).alias("splits"), F.array_join(warnings, "; ").alias("warnings"))
