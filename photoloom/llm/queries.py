"""The dealt problems' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.functions.keys import category_key, content_key, place_key
from photoloom.llm.components import link_groups
from photoloom.llm.consensus import Field, best_fields, consensus_text
from photoloom.llm.diverse import varied_subset
from photoloom.llm.history import matches_in_batches, signatures
from photoloom.llm.leaks import leaked_items
from photoloom.llm.subjects import UNCLEAR, Model, assign_subjects, fit_subjects
from photoloom.llm.tokenizer import VOCABULARY, encode_corpus
from photoloom.llm.topn import top_n_per_group
from photoloom.operators.integrity import micros
from photoloom.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "master_gallery_images").select(
        "image_id", category_key(F.col("primary_master_category")).alias("category"), "year", "cluster_id", "review_priority", "mapping_confidence"
    )
    return top_n_per_group(images, ["category", "year", "cluster_id"], ["review_priority", "mapping_confidence"], "image_id", 3).select("image_id")


def photo_fields() -> list[Field]:
    """How a photo's surviving values are chosen among the rows of one content."""
    area = F.col("width").cast("long") * F.col("height")
    taken = F.col("capture_time")
    of_its_own = (taken >= F.lit("2004-01-01 00:00:00").cast("timestamp_ntz")) & F.coalesce(taken <= F.col("scanned_at"), F.lit(True)) & ~taken.eqNullSafe(F.col("mtime"))
    return [
        Field("dims", (F.col("width") > 0) & (F.col("height") > 0), (area, micros(F.col("scanned_at"))), ("width", "height")),
        Field("size", F.col("size") > 0, (micros(F.col("scanned_at")),), ("size",)),
        Field("time", of_its_own, (-micros(taken),), ("capture_time",)),
    ]


def p3_best(spark: SparkSession, sf: str) -> DataFrame:
    """The surviving records themselves: the values of the rows that p3_found names."""
    photos = table(spark, sf, "photo_info").select("photo_id", "width", "height", "size", "capture_time", "mtime", "scanned_at", "sha256")
    return best_fields(photos, content_key(F.col("sha256")), "photo_id", photo_fields())


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    best = p3_best(spark, sf)
    return best.select(F.col("group_id").alias("group_photo_id"), *[F.col(f"{f.name}_id").alias(f"{f.name}_photo_id") for f in photo_fields()])


def p3_consensus(spark: SparkSession, sf: str) -> DataFrame:
    """The relative path closest to the token consensus of each content."""
    photos = table(spark, sf, "photo_info").select("sha256", "relpath")
    return consensus_text(photos, content_key(F.col("sha256")), F.col("relpath"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    signed = signatures(table(spark, sf, "photo_info"), "photo_id", "batch_id", content_key(F.col("sha256")), place_key(F.col("relpath")), F.col("phash"))
    return matches_in_batches(signed).select(F.col("first_id").alias("first_photo_id"), F.col("row_id").alias("photo_id"))


def p5_subset(spark: SparkSession, sf: str) -> DataFrame:
    images = table(spark, sf, "master_gallery_images").select("image_id", "primary_master_category", "year", "cluster_id")
    sizes = {r["request_id"]: r["subset_size"] for r in table(spark, sf, "subset_requests").collect()}  # a fixed table of requests
    category = category_key(F.col("primary_master_category"))
    placed = F.col("cluster_id").isNotNull()
    # A cluster counts within its category too, else one that is in all categories is the nearest record of each.
    features = {
        "category": (category, 1.2), "year": (F.col("year"), 0.8), "cluster": (F.when(placed, F.struct("year", "cluster_id")), 0.5),
        "cluster_in_category": (F.when(placed & category.isNotNull(), F.struct(category, F.col("year"), F.col("cluster_id"))), 1.0),
    }
    return varied_subset(images, "image_id", features, sizes)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    photos = table(spark, sf, "photo_info").select("photo_id", place_key(F.col("path")).alias("place"))
    links = table(spark, sf, "photo_matches").where("is_match").select(place_key(F.col("path_a")).alias("a"), place_key(F.col("path_b")).alias("b"))
    return link_groups(photos, "photo_id", "place", links, "a", "b")


def p7_ids(spark: SparkSession, sf: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return encode_corpus(table(spark, sf, "documents"), "doc_id", "text", vocabulary)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text")


def p8_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where in the original text each leaked stretch lies."""
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_items"), "item_id", "item_text", spans=True)


def subject_model(spark: SparkSession, sf: str) -> Model:
    areas = [r["subject"] for r in table(spark, sf, "subject_areas").select("subject").collect()]  # a fixed table of codes
    labels = table(spark, sf, "subject_labels").select("doc_id", category_key(F.col("subject")).alias("subject"))
    return fit_subjects(table(spark, sf, "documents"), "doc_id", "text", labels, "doc_id", "subject", sorted(set(areas) - {UNCLEAR}))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return assign_subjects(table(spark, sf, "documents"), "doc_id", "text", subject_model(spark, sf)).select("doc_id", "subject")


def p9_composition(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and characters of the corpus by subject; a document of several subjects counts for each."""
    docs = table(spark, sf, "documents")
    subjects = assign_subjects(docs, "doc_id", "text", subject_model(spark, sf))
    sized = docs.select("doc_id", F.length("text").alias("chars"))
    return subjects.join(sized, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("chars", F.lit(0))).alias("n_chars"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p3_found": p3_found,
        "p3_best": p3_best,
        "p3_consensus": p3_consensus,
        "p4_found": p4_found,
        "p5_subset": p5_subset,
        "p6_found": p6_found,
        "p7_ids": p7_ids,
        "p8_found": p8_found,
        "p8_spans": p8_spans,
        "p9_found": p9_found,
        "p9_composition": p9_composition,
    }


def oracle_sql() -> dict[str, str]:
    from photoloom.llm.oracle import SQL

    return SQL
