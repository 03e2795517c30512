"""Reports over the consolidated gallery, evaluation against gold labels and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photoloom.functions.text import base_name, normalize, review_id, safe

#: The taxonomy in its order. Fixed values.
CATEGORIES = (
    "Landscape",
    "Waterside and Harbour",
    "Nature Detail",
    "Wildlife",
    "Farm Animals",
    "People and Human Presence",
    "Place and Travel",
    "Rural Life and Working Country",
    "Weather, Light, and Atmosphere",
    "Other / Uncertain",
)
UNCERTAIN = "Other / Uncertain"
LOW = 0.7


def confidence(c: str = "mapping_confidence") -> Column:
    """The confidence as a number, null for NaN."""
    x = F.col(c).try_cast("double")
    return F.when(~F.isnan(x), x)


def _firsts(rows: DataFrame, group: list[str], value: Column, order: str, n: int, name: str) -> DataFrame:
    """The first ``n`` values per group as a list."""
    ranked = rows.select(*group, value.alias("v"), order, F.row_number().over(Window.partitionBy(*group).orderBy(order)).alias("k")).where(F.col("k") <= n)
    return ranked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias(name))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    both = F.lit(True)
    for k in keys:
        both = both & a[k].eqNullSafe(b[k])
    return both


def category_summary(images: DataFrame, position: str) -> DataFrame:
    """Per category: images, years, the five most frequent themes and the first five examples."""
    own = images.where("primary_master_category is not null")
    key = ["primary_master_category"]
    base = own.groupBy(*key).agg(F.count(F.lit(1)).alias("image_count"), F.array_join(F.array_sort(F.collect_set("year")), ", ").alias("years_present"))
    themes = own.groupBy(*key, safe(F.col("theme_name")).alias("theme")).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    top = themes.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("n"), "first"))).where("k <= 5")
    top = top.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "theme", "n"))), lambda x: F.concat(x["theme"], F.lit(": "), x["n"].cast("string"))), "; ").alias("top_source_themes"))
    examples = _firsts(own, key, F.coalesce("archive_relative_path", "path"), position, 5, "examples")
    examples = examples.select(*key, F.array_join("examples", "; ", "").alias("example_images"))
    return base.join(top, key).join(examples, key).withColumnRenamed("primary_master_category", "master_category")


def mapping_diagnostics(images: DataFrame) -> DataFrame:
    """Per normalised theme, labels and category, nulls included: counts and confidence."""
    norm = images.select(*[normalize(F.col(c)).alias(n) for c, n in (("theme_name", "raw_theme"), ("theme_top_label_1", "top_label_1"), ("theme_top_label_2", "top_label_2"), ("theme_top_label_3", "top_label_3"))], F.col("primary_master_category").alias("assigned_master_category"), confidence().alias("c"), safe(F.col("review_flags")).alias("flags"))
    return norm.groupBy("raw_theme", "top_label_1", "top_label_2", "top_label_3", "assigned_master_category").agg(
        F.count(F.lit(1)).alias("image_count"), F.bround(F.avg("c"), 3).alias("avg_confidence"), F.bround(F.min("c"), 3).alias("min_confidence"), F.bround(F.max("c"), 3).alias("max_confidence"), F.count_if(F.length("flags") > 0).alias("review_flag_count")
    )


def mapping_diagnostics_whole(images: DataFrame, position: str) -> DataFrame:
    """``mapping_diagnostics`` with the first eight example images of each group."""
    base = mapping_diagnostics(images)
    key = ["raw_theme", "top_label_1", "top_label_2", "top_label_3", "assigned_master_category"]
    columns = ["theme_name", "theme_top_label_1", "theme_top_label_2", "theme_top_label_3"]
    norm = images.select(*[normalize(F.col(c)).alias(k) for k, c in zip(key, columns)], F.col("primary_master_category").alias(key[4]), F.coalesce("archive_relative_path", "path").alias("image"), position)
    examples = _firsts(norm, key, F.col("image"), position, 8, "example_images")
    return base.join(examples, _same(base, examples, key)).select(*[base[c] for c in base.columns], "example_images")


def category_counts(images: DataFrame) -> DataFrame:
    """Images per category as written; those without one are left out, as in the reference's counts."""
    return images.where("primary_master_category is not null").groupBy("primary_master_category").agg(F.count(F.lit(1)).alias("n"))


def theme_matrix(images: DataFrame) -> DataFrame:
    """Rows per normalised theme: files per category of the taxonomy, ``extras`` and ``total``.

    ``extras`` lists the categories outside the taxonomy as they are written, blank ones included, with their files. Only
    images without a category are left out, and themes without a file.
    """
    whole = theme_matrix_whole(images)
    extras = F.array_join(F.transform(F.map_entries("extras"), lambda e: F.concat(e["key"], F.lit(": "), e["value"].cast("string"))), "; ")
    return whole.withColumn("extras", extras).where("total > 0")


def theme_matrix_whole(images: DataFrame) -> DataFrame:
    """Rows per normalised theme: files per category of the taxonomy, per other category as written, and of all.

    ``extras`` maps each category outside the taxonomy, blank ones included, to its files; ``total`` counts them too.
    Only images without a category are left out.
    """
    norm = images.where("primary_master_category is not null").select(normalize(F.col("theme_name")).alias("raw_theme"), F.col("primary_master_category").alias("c"), "file")
    cells = norm.groupBy("raw_theme", "c").agg(F.count("file").alias("n"))
    own = [F.coalesce(F.sum(F.when(F.col("c") == c, F.col("n"))), F.lit(0).cast("long")).alias(c) for c in CATEGORIES]
    extras = F.map_from_entries(F.array_sort(F.collect_list(F.when(~F.col("c").isin(*CATEGORIES), F.struct("c", "n")))))
    return cells.groupBy("raw_theme").agg(*own, extras.alias("extras"), F.sum("n").alias("total"))


def audit_sample(images: DataFrame, tie: str, per_category: int = 50) -> DataFrame:
    """The rows of least confidence of each category."""
    order = [confidence().asc_nulls_last(), F.col("display_theme_name").asc_nulls_last(), F.col("relative_path").asc_nulls_last(), F.col(tie)]
    own = images.where(F.col("primary_master_category").isin(*CATEGORIES))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("primary_master_category").orderBy(*order))).where(F.col("rank") <= per_category)


def gallery_metrics(images: DataFrame) -> DataFrame:
    """One row of totals and rates."""
    c, n = confidence(), F.greatest(F.count(F.lit(1)), F.lit(1))
    low, odd = F.count_if(c < LOW), F.count_if(F.col("primary_master_category") == UNCERTAIN)
    return images.agg(
        F.count(F.lit(1)).alias("total_images"), F.bround(F.avg(c), 3).alias("avg_confidence"), low.alias("low_confidence_count"), F.bround(low / n, 3).alias("low_confidence_rate"), odd.alias("uncertain_count"), F.bround(odd / n, 3).alias("uncertain_rate")
    )


def inclusion_counts(candidates: DataFrame, included: Column, *by: str) -> DataFrame:
    """Candidates, those that were ``included``, and the others, per group or of all rows."""
    n, own = F.count(F.lit(1)), F.count_if(included)
    return candidates.groupBy(*by).agg(n.alias("candidate_count"), own.alias("included_count"), F.greatest(n - own, F.lit(0).cast("long")).alias("excluded_count"))


def reason_counts(rows: DataFrame, column: str, n: int = 12, sep: str = ", ") -> DataFrame:
    """The most frequent pieces of a joined column."""
    pieces = rows.select(F.explode(F.split(column, sep)).alias("reason")).where("reason <> ''")
    return pieces.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(n)


# --- evaluation ---------------------------------------------------------------------------------------------------


def evaluate(gold: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """Gold rows with every prediction of their key, matched and correct marks; unmatched gold rows stay."""
    both = gold.join(predicted.where(F.col(key).isNotNull()), key, "left")
    matched = F.col("predicted_category").isNotNull()
    return both.withColumns({"is_matched": matched, "is_correct": F.coalesce(F.col("correct_category") == F.col("predicted_category"), F.lit(False))})


def accuracy(evaluated: DataFrame) -> DataFrame:
    n = F.count_if("is_matched")
    right = F.count_if(F.col("is_matched") & F.col("is_correct"))
    return evaluated.agg(F.count(F.lit(1)).alias("gold_rows"), n.alias("matched_rows"), F.count_if(~F.col("is_matched")).alias("unmatched_rows"), right.alias("correct_rows"), F.bround(F.when(n > 0, right / n).otherwise(0.0), 6).alias("accuracy"))


def confusion(evaluated: DataFrame) -> DataFrame:
    """Counts by correct and predicted category with ``All`` margins, in long form."""
    matched = evaluated.where("is_matched and correct_category is not null")
    cube = matched.cube("correct_category", "predicted_category").agg(F.count(F.lit(1)).alias("n"), F.grouping("correct_category").alias("g1"), F.grouping("predicted_category").alias("g2"))
    return cube.select(F.when(F.col("g1") == 1, "All").otherwise(F.col("correct_category")).alias("correct_category"), F.when(F.col("g2") == 1, "All").otherwise(F.col("predicted_category")).alias("predicted_category"), "n")


def error_patterns(evaluated: DataFrame, n: int = 12) -> DataFrame:
    wrong = evaluated.where("is_matched and not is_correct")
    return wrong.groupBy("correct_category", "predicted_category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "correct_category", "predicted_category").limit(n)


# --- review -------------------------------------------------------------------------------------------------------


def review_defaults(images: DataFrame) -> DataFrame:
    """Adds the columns of the review queue that a table lacks, with their defaults."""
    has = set(images.columns)
    archive = next((F.col(c) for c in ("relative_path", "path") if c in has), F.lit(""))
    rows = images if "archive_relative_path" in has else images.withColumn("archive_relative_path", archive)
    defaults = {
        "mapping_confidence": F.lit(0.5), "primary_master_category": F.lit(UNCERTAIN), "review_flags": F.lit(""), "year": F.lit("Unknown"),
        "display_theme_name": F.col("theme_name") if "theme_name" in has else F.lit(""), "file": base_name(safe(F.col("archive_relative_path"))),
    }
    return rows.withColumns({c: v for c, v in defaults.items() if c not in has})


def review_rows(images: DataFrame, row_id: str) -> DataFrame:
    """Gallery rows with the defaults and the id of the review queue."""
    images = review_defaults(images)
    year = F.coalesce(F.nullif(F.col("year"), F.lit("")), F.lit("Unknown"))
    rid = review_id(*[F.col(c) for c in ("path", "archive_relative_path", "relative_path", row_id) if c in images.columns])
    return images.withColumns({"mapping_confidence": F.coalesce(confidence(), F.lit(0.0)), "year": year, "review_id": rid})


def review_page(rows: DataFrame, section: list[str], tie: str, cards: int = 500) -> DataFrame:
    """The first ``cards`` rows of each section in the order of the queue."""
    order = [F.col("review_priority").desc_nulls_last(), F.desc("mapping_confidence"), F.col("archive_relative_path").asc_nulls_last(), F.col(tie)]
    return rows.withColumn("card", F.row_number().over(Window.partitionBy(*section).orderBy(*order))).where(F.col("card") <= cards)


def review_metrics(rows: DataFrame) -> DataFrame:
    """Counts by bucket, year and category and of all rows, with low confidences and flags, in one pass."""
    sets = rows.groupingSets([["review_bucket"], ["year"], ["primary_master_category"], []], "review_bucket", "year", "primary_master_category")
    out = sets.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("mapping_confidence") < LOW).alias("low_confidence_count"), F.count_if(F.trim(safe(F.col("review_flags"))) != "").alias("review_flag_count"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "bucket").when(F.col("g") == 5, "year").when(F.col("g") == 6, "category").otherwise("all")
    value = F.when(F.col("g") == 3, F.col("review_bucket")).when(F.col("g") == 5, F.col("year")).when(F.col("g") == 6, F.col("primary_master_category"))
    return out.select(kind.alias("kind"), value.alias("value"), "n", "low_confidence_count", "review_flag_count")


def decided(rows: DataFrame, decisions: DataFrame, row_id: str, decision: str) -> DataFrame:
    """The rows whose latest decision is ``decision``. Of decisions at one time the greatest text counts."""
    latest = decisions.groupBy(row_id).agg(F.max(F.struct("reviewed_at", "decision")).alias("last")).where(F.col("last.decision") == decision)
    return rows.join(latest, row_id, "left_semi")
