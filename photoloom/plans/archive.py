"""Queries of the core over the photo archive's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.functions.keys import place_key
from photoloom.functions.sql import place_sql
from photoloom.operators.integrity import Reference, orphan_references, orphan_report
from photoloom.session import table


def archive_references(spark: SparkSession, sf: str) -> list[Reference]:
    """Master gallery rows refer to inventory files, gold labels to master gallery images."""
    photos = table(spark, sf, "photo_info").select(
        place_key(F.col("path")).alias("key"), F.col("scanned_at").alias("begin"), F.col("deleted_at").alias("until"), F.col("photo_id").alias("row_id")
    )
    images = table(spark, sf, "master_gallery_images").select(place_key(F.col("path")).alias("key"), F.col("consolidated_at").alias("at"), F.col("image_id").alias("row_id"))
    gold = table(spark, sf, "gold_labels_v1").select(place_key(F.col("path")).alias("key"), F.col("labelled_at").alias("at"), F.col("gold_id").alias("row_id"))
    as_parent = images.select("key", F.col("at").alias("begin"), F.lit(None).cast("timestamp_ntz").alias("until"), "row_id")
    return [Reference("master_gallery_images", images, photos), Reference("gold_labels_v1", gold, as_parent)]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    orphans = orphan_references(archive_references(spark, sf))
    return orphans.select(F.col("reference").alias("table_name"), F.date_format("at", "yyyy-MM").alias("period"), "row_id")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(archive_references(spark, sf))


def queries() -> dict:
    return {"p2_found": p2_found, "p2_report": p2_report}


_ORPHANS = f"""
WITH photos AS (SELECT {place_sql('path')} AS place, scanned_at, deleted_at FROM photo_info),
images AS (SELECT image_id, {place_sql('path')} AS place, consolidated_at FROM master_gallery_images),
gold AS (SELECT gold_id, {place_sql('path')} AS place, labelled_at FROM gold_labels_v1),
orphans AS (
  SELECT 'master_gallery_images' AS table_name, strftime(consolidated_at, '%Y-%m') AS period, image_id AS row_id,
    EXISTS (SELECT 1 FROM photos p WHERE p.place = i.place AND p.scanned_at <= i.consolidated_at) AS began,
    EXISTS (SELECT 1 FROM photos p WHERE p.place = i.place AND p.scanned_at > i.consolidated_at) AS later
  FROM images i WHERE place IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM photos p WHERE p.place = i.place AND p.scanned_at <= i.consolidated_at AND (p.deleted_at IS NULL OR p.deleted_at > i.consolidated_at))
  UNION ALL
  SELECT 'gold_labels_v1', strftime(labelled_at, '%Y-%m'), gold_id, false,
    EXISTS (SELECT 1 FROM images i WHERE i.place = g.place AND i.consolidated_at > g.labelled_at)
  FROM gold g WHERE place IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM images i WHERE i.place = g.place AND i.consolidated_at <= g.labelled_at))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _ORPHANS + "SELECT table_name, period, row_id FROM orphans",
        "p2_report": _ORPHANS
        + """SELECT table_name, period, CASE WHEN began THEN 'deleted' WHEN later THEN 'late' ELSE 'missing' END AS reason, count(*) AS n_rows
        FROM orphans GROUP BY ALL""",
    }
