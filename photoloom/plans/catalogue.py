"""Queries over the operators of the photo curation dataflows, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.functions.keys import place_key
from photoloom.functions.text import (
    base_name,
    cache_key,
    REVIEW_FIELDS,
    clean_prompt,
    display_name,
    first_folder,
    escape_html,
    escape_json,
    hits,
    normalize,
    prompt_category,
    review_id,
    safe,
    search_prompt,
    slug,
    split_list,
    stem_key,
    suffix,
    text_fields,
    tokens,
)
from photoloom.operators import dedupe, flags, reports, scoring, search, themes
from photoloom.operators.numbering import numbered
from photoloom.plans.evidence import COASTAL_WORDS, KEYWORDS, RURAL_WORDS, evidence_of, score_evidence, second_categories
from photoloom.plans.prompts import PROMPTS
from photoloom.plans.sql import SQL
from photoloom.session import Workspace, table

#: Every QUERY_STEP-th vector is a query; the first N_PROMPTS stand for prompts.
QUERY_STEP, N_PROMPTS, DIM = 20, 24, 64


def gallery(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "master_gallery_images")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*[F.lit(p) for p in PROMPTS])
    return vectors(spark, sf).where(F.col("vec_id") < N_PROMPTS).select(F.col("vec_id").alias("prompt_id"), F.col("embedding").alias("vector"), F.element_at(names, (F.col("vec_id") + 1).cast("int")).alias("prompt"))


def words_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


# --- search -------------------------------------------------------------------------------------------------------


def search_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(vectors(spark, sf), "vec_id", "embedding", words_queries(spark, sf), "query_id", "vector", 20)


def search_min_score(spark: SparkSession, sf: str) -> DataFrame:
    return search.top_k(vectors(spark, sf), "vec_id", "embedding", words_queries(spark, sf), "query_id", "vector", 200, min_score=0.2)


def search_counts(spark: SparkSession, sf: str) -> DataFrame:
    return search.result_counts(search_min_score(spark, sf), "query_id")


def search_score_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Score columns of the first five queries, as in the SQL; ``search_score_map`` has those of every query."""
    return search.score_columns(search_topk(spark, sf), "vec_id", "query_id", {QUERY_STEP * i: f"q{i}" for i in range(5)})


def search_score_map(spark: SparkSession, sf: str) -> DataFrame:
    return search.score_map(search_topk(spark, sf), "query_id")


def search_prompts(spark: SparkSession, sf: str) -> DataFrame:
    themes_ = gallery(spark, sf).select(F.col("theme_name").alias("query")).distinct()
    return themes_.select("query", search_prompt(F.col("query")).alias("prompt"), slug(F.col("query")).alias("slug"))


def embedding_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Files of later scans that the manifest of the first one doesn't hold unchanged."""
    files = table(spark, sf, "photo_info").select("photo_id", "batch_id", place_key(F.col("path")).alias("place"), F.coalesce("size", F.lit(-1).cast("long")).alias("size"), F.date_trunc("second", "mtime").alias("mtime"))
    cached = files.where("batch_id = 0")
    return search.unscored(files.where("batch_id > 0"), cached, ["place", "size", "mtime"]).select("photo_id")


# --- themes -------------------------------------------------------------------------------------------------------


def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = themes.centroids(vectors(spark, sf), "label", "embedding", DIM)
    return c.select("label", "n", F.transform("centroid", lambda x: F.round(x, 4) + 0.0).alias("centroid"))


def cluster_top_prompts(spark: SparkSession, sf: str) -> DataFrame:
    c = themes.centroids(vectors(spark, sf), "label", "embedding", DIM)
    return themes.top_prompts(c, "label", prompts(spark, sf), "prompt_id", "vector")


def cluster_representatives(spark: SparkSession, sf: str) -> DataFrame:
    v = vectors(spark, sf)
    return themes.representatives(v, "vec_id", "label", "embedding", themes.centroids(v, "label", "embedding", DIM))


def cluster_misc_merge(spark: SparkSession, sf: str) -> DataFrame:
    return themes.merge_small(vectors(spark, sf).select("vec_id", "label"), "label", 50).select("vec_id", "label", "theme_cluster")


def cluster_average_linkage(spark: SparkSession, sf: str) -> DataFrame:
    return themes.cluster_average_linkage(vectors(spark, sf), "vec_id", "embedding", ["label"], 0.9)


def theme_table(spark: SparkSession, sf: str) -> DataFrame:
    folder = F.concat(F.lit("folder "), (F.col("vec_id") % 7).cast("string"))
    return themes.theme_table(vectors(spark, sf), "vec_id", "label", "embedding", folder, prompts(spark, sf), "prompt_id", "vector", "prompt", DIM)


def theme_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector with the names and labels of its theme."""
    return themes.theme_rows(vectors(spark, sf).select("vec_id", "label"), "label", theme_table(spark, sf))


def dominant_folder(spark: SparkSession, sf: str) -> DataFrame:
    return themes.dominant(gallery(spark, sf), ["year", "cluster_id"], first_folder(safe(F.col("relative_path"))), F.col("image_id")).select("year", "cluster_id", F.col("value").alias("folder"), "n")


# --- duplicates ---------------------------------------------------------------------------------------------------


def photos(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.inventory(table(spark, sf, "photo_info"))


def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    return dedupe.group_rows(dedupe.exact_groups(p), p)


def exact_groups_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of exact groups under numbers from 1, as they are written to a list."""
    p = photos(spark, sf)
    groups = dedupe.exact_groups(p)
    numbers = numbered(groups.select("group_id").distinct(), ["group_id"], "number")
    return dedupe.group_rows(groups, p).join(numbers, "group_id").select("number", "group_id", "keeper", "photo_id", "relpath")


def inclusion_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Image files per scan, those that could be read, and the rest."""
    files = table(spark, sf, "photo_info").where(suffix(F.col("path")).isin(*dedupe.RAW, *dedupe.RENDERED, *dedupe.OTHER_IMAGES))
    return reports.inclusion_counts(files, (F.col("width") > 0) & (F.col("height") > 0), "batch_id")


def exact_keepers(spark: SparkSession, sf: str) -> DataFrame:
    p = photos(spark, sf)
    return dedupe.keepers(dedupe.exact_groups(p), p)


def near_pairs_time_window(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_pairs_in_time(photos(spark, sf))


def near_pairs_same_key(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_pairs_by_stem(photos(spark, sf))


def near_components(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_groups(photos(spark, sf))


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The photos, their exact groups and the near groups that are no exact one; groups are read several times, so they are written."""
    p, work = photos(spark, sf), Workspace(spark, "groups")
    exact = work.write(dedupe.exact_groups(p), "exact")
    return p, exact, work.write(dedupe.near_minus_exact(work.write(dedupe.near_groups(p), "near-all"), exact), "near")


def near_minus_exact(spark: SparkSession, sf: str) -> DataFrame:
    return _groups(spark, sf)[2]


def gallery_excludes(spark: SparkSession, sf: str) -> DataFrame:
    p, exact, near = _groups(spark, sf)
    return dedupe.excludes(exact, p).union(dedupe.excludes(near, p)).distinct()


def dedupe_summary(spark: SparkSession, sf: str) -> DataFrame:
    p, exact, near = _groups(spark, sf)
    return dedupe.dedupe_summary(p, exact, near, dedupe.excludes(exact, p).union(dedupe.excludes(near, p)).distinct())


def greedy_unique(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.greedy_unique(table(spark, sf, "photo_info"), "photo_id", "photo_id", "phash", 5).select("photo_id")


def greedy_top(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.greedy_unique(table(spark, sf, "photo_info"), "photo_id", "photo_id", "phash", 10, top_n=50).select("photo_id")


def exclude_anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Inventory files that are no keeper's copies, by relative path."""
    return photos(spark, sf).select("photo_id", "relpath").join(gallery_excludes(spark, sf), "relpath", "left_anti").select("photo_id")


def scan_predicates(spark: SparkSession, sf: str) -> DataFrame:
    """Files by kind and by whether a scan would pass them over."""
    path = F.col("path")
    ignored = F.startswith(base_name(path), F.lit(".")) | F.lower(path).rlike("metadata|preview|thumbnail|sidecar")
    kind = F.when(suffix(path).isin(*dedupe.RAW), "raw").when(suffix(path).isin(*dedupe.RENDERED, *dedupe.OTHER_IMAGES), "image").otherwise("other")
    return table(spark, sf, "photo_info").groupBy(suffix(path).alias("suffix"), kind.alias("kind"), ignored.alias("ignored")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(stem_key(path)).alias("n_stems"), F.sum(dedupe.name_score(path)).alias("name_score"))


# --- text ---------------------------------------------------------------------------------------------------------


def normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return gallery(spark, sf).select("image_id", normalize(F.col("display_theme_name")).alias("theme"), normalize(F.col("archive_relative_path")).alias("path"))


def token_hits(spark: SparkSession, sf: str) -> DataFrame:
    text = normalize(text_fields(gallery(spark, sf).columns))
    words = gallery(spark, sf).select("image_id", tokens(text).alias("w"))
    return words.select("image_id", F.size("w").cast("long").alias("n_words"), *[hits(F.col("w"), k).cast("long").alias(slug_name(c)) for c, k in KEYWORDS.items()])


def slug_name(category: str) -> str:
    return "_".join("".join(ch if ch.isalnum() else " " for ch in category.lower()).split())


def prompt_label_clean(spark: SparkSession, sf: str) -> DataFrame:
    return prompts(spark, sf).select("prompt_id", clean_prompt(F.col("prompt")).alias("label"), normalize(F.col("prompt")).alias("normal"))


def prompt_categories(spark: SparkSession, sf: str) -> DataFrame:
    """Categories of the prompts and of all theme names and labels of the gallery."""
    g = gallery(spark, sf)
    texts = reduce(DataFrame.union, [g.select(F.col(c).alias("text")) for c in ("theme_name", "theme_top_label_1", "theme_top_label_2", "theme_top_label_3")])
    every = texts.union(prompts(spark, sf).select("prompt")).where("text is not null").distinct()
    return every.select("text", prompt_category(F.col("text")).alias("category"))


def review_text(spark: SparkSession, sf: str) -> DataFrame:
    """The text that the review search looks through, and how it is written into a page."""
    g = gallery(spark, sf)
    text = text_fields(g.columns, REVIEW_FIELDS)
    return g.select("image_id", text.alias("text"), escape_html(text).alias("html"), F.length(escape_json(text)).cast("long").alias("json_length"))


def display_theme_names(spark: SparkSession, sf: str) -> DataFrame:
    g = gallery(spark, sf).where("cluster_id is not null")
    return g.select("image_id", display_name(F.col("theme_top_label_1"), F.col("theme_top_label_2"), first_folder(safe(F.col("relative_path"))), F.col("cluster_id")).alias("name"))


def text_ids(spark: SparkSession, sf: str) -> DataFrame:
    g = gallery(spark, sf)
    return g.select(
        "image_id", review_id(F.col("path"), F.col("archive_relative_path"), F.col("relative_path"), F.col("image_id")).alias("review_id"), slug(F.col("theme_name"), "-", "model", 12).alias("slug"), cache_key(F.lit("clip"), F.col("theme_name")).alias("cache_key"), F.size(split_list(safe(F.col("review_flags")))).cast("long").alias("n_flags")
    )


# --- evidence -----------------------------------------------------------------------------------------------------


def evidence_ranking(spark: SparkSession, sf: str) -> DataFrame:
    s = score_evidence(gallery(spark, sf))
    return s.select("image_id", F.col("category"), F.col("confidence"), F.array_join("flags", ", ").alias("flags"), F.coalesce(F.element_at("evidence", "Landscape"), F.lit(0.0)).alias("landscape"), F.size("evidence").cast("long").alias("n_evidence"))


def secondary_categories(spark: SparkSession, sf: str) -> DataFrame:
    text = normalize(text_fields(gallery(spark, sf).columns))
    words = gallery(spark, sf).select("image_id", "primary_master_category", tokens(text).alias("w"))
    return words.select("image_id", F.array_join(second_categories(F.col("primary_master_category"), F.col("w")), ", ").alias("secondary"))


def evidence_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return gallery(spark, sf).select("image_id", evidence_of(F.col("mapping_evidence"), F.coalesce("primary_master_category", F.lit(""))).alias("score"))


def suspicious_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose category, evidence and confidence don't agree, with the reasons."""
    own = evidence_of(F.col("mapping_evidence"), F.coalesce("primary_master_category", F.lit("")))
    best = F.array_max(F.map_values(F.from_json("mapping_evidence", "map<string,double>")))
    sure = reports.confidence()
    conditions = {
        "no_evidence_for_category": F.col("primary_master_category").isNotNull() & (own <= 0) & best.isNotNull(),
        "stronger_evidence_for_another": best - own >= 2,
        "low_confidence_without_flag": (sure < reports.LOW) & (safe(F.col("review_flags")) == "") & (F.col("primary_master_category") != reports.UNCERTAIN),
    }
    return flags.with_reasons(gallery(spark, sf), conditions).select("image_id", F.array_join("reasons", ", ").alias("reasons"))


def suspicion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.reason_counts(suspicious_mappings(spark, sf), "reasons")


def coastal_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Landscapes whose text has words of the coast, with a mark for words of the country."""
    text = normalize(text_fields(gallery(spark, sf).columns))
    own = gallery(spark, sf).where("primary_master_category = 'Landscape'").select("image_id", tokens(text).alias("w"))
    return own.where(hits(F.col("w"), COASTAL_WORDS) > 0).select("image_id", (hits(F.col("w"), RURAL_WORDS) > 0).alias("has_rural_terms"))


# --- reports ------------------------------------------------------------------------------------------------------


def category_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.category_summary(gallery(spark, sf), "image_id")


def mapping_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mapping_diagnostics(gallery(spark, sf))


def mapping_diagnostics_whole(spark: SparkSession, sf: str) -> DataFrame:
    return reports.mapping_diagnostics_whole(gallery(spark, sf), "image_id")


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.category_counts(gallery(spark, sf))


def theme_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return reports.theme_matrix(gallery(spark, sf))


def theme_matrix_whole(spark: SparkSession, sf: str) -> DataFrame:
    return reports.theme_matrix_whole(gallery(spark, sf))


def audit_sample(spark: SparkSession, sf: str) -> DataFrame:
    return reports.audit_sample(gallery(spark, sf), "image_id").select("primary_master_category", F.col("rank").cast("long").alias("rank"), "image_id")


def gallery_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.gallery_metrics(gallery(spark, sf))


def flag_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.reason_counts(gallery(spark, sf), "review_flags")


def flagged_rows(spark: SparkSession, sf: str) -> DataFrame:
    return gallery(spark, sf).where("review_flags <> ''").select("image_id", "year", "primary_master_category", "review_flags")


def union_years(spark: SparkSession, sf: str) -> DataFrame:
    """The yearly tables put together again by name, one of them without a column.

    Rows without a year are in no yearly table and are left out, as in the SQL; ``union_years_whole`` has them.
    """
    g = gallery(spark, sf).select("image_id", "year", "theme_name", "thumb")
    old, new = g.where("year < '2015'").drop("thumb"), g.where("year >= '2015'")
    both = old.unionByName(new, allowMissingColumns=True)
    return both.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("thumb").alias("n_thumbs"), F.countDistinct("theme_name").alias("n_themes"))


def union_years_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``union_years`` over every row: those without a year stay in the part that keeps all columns."""
    g = gallery(spark, sf).select("image_id", "year", "theme_name", "thumb")
    is_old = F.coalesce(F.col("year") < "2015", F.lit(False))
    both = g.where(is_old).drop("thumb").unionByName(g.where(~is_old), allowMissingColumns=True)
    return both.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count("thumb").alias("n_thumbs"), F.countDistinct("theme_name").alias("n_themes"))


# --- evaluation and review ----------------------------------------------------------------------------------------


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    gold = table(spark, sf, "gold_labels_v1").select("gold_id", F.trim(safe(F.col("path"))).alias("path_key"), "correct_category")
    predicted = gallery(spark, sf).select(F.trim(F.col("path")).alias("path_key"), "image_id", F.col("primary_master_category").alias("predicted_category"), "mapping_confidence")
    return reports.evaluate(gold, predicted, "path_key")


def gold_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf).select("gold_id", "image_id", "correct_category", "predicted_category", "is_matched", "is_correct")


def gold_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return reports.accuracy(evaluated(spark, sf))


def gold_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return reports.confusion(evaluated(spark, sf))


def gold_errors(spark: SparkSession, sf: str) -> DataFrame:
    return reports.error_patterns(evaluated(spark, sf))


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.review_rows(gallery(spark, sf), "image_id")
    return rows.select("image_id", "review_id", "review_bucket", "review_priority", "year", "mapping_confidence", safe(F.col("review_flags")).alias("review_flags"))


def review_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = reports.review_rows(gallery(spark, sf), "image_id")
    return reports.review_page(rows, ["review_bucket", "year"], "image_id", 20).select("review_bucket", "year", F.col("card").cast("long").alias("card"), "image_id")


def review_page_whole(spark: SparkSession, sf: str) -> DataFrame:
    """``review_page`` with the reference's 500 cards a section; the SQL of ``review_page`` has 20."""
    rows = reports.review_rows(gallery(spark, sf), "image_id")
    return reports.review_page(rows, ["review_bucket", "year"], "image_id").select("review_bucket", "year", F.col("card").cast("long").alias("card"), "image_id")


def review_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.review_metrics(reports.review_rows(gallery(spark, sf), "image_id"))


def review_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Images whose latest consolidation run put them into the best bucket, taken as decisions."""
    g = gallery(spark, sf)
    decisions = g.select("path", F.col("consolidated_at").alias("reviewed_at"), F.when(F.startswith("review_bucket", F.lit("01")), "keep").otherwise("maybe").alias("decision"))
    return reports.decided(g, decisions.where("path is not null"), "path", "keep").select("image_id")


# --- culling scores -----------------------------------------------------------------------------------------------


def prompt_vectors(spark: SparkSession, sf: str) -> list[list[float]]:
    return [list(r["vector"]) for r in prompts(spark, sf).orderBy("prompt_id").collect()]  # N_PROMPTS rows


def pair_softmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {f"{mode}_{name}": p for mode, own in scoring.MODES.items() for name, p in own.items()}
    v = scoring.signals(vectors(spark, sf), "embedding", prompt_vectors(spark, sf), pairs)
    return v.select("vec_id", *[F.bround(scoring.mode_score(mode, f"{mode}_"), 4).alias(mode) for mode in scoring.MODES])


def _stock(spark: SparkSession, sf: str) -> DataFrame:
    names = [*scoring.POSITIVE, *scoring.PENALTY]
    return scoring.signals(vectors(spark, sf), "embedding", prompt_vectors(spark, sf), {n: (i, i + 12) for i, n in enumerate(names)})


def stock_score(spark: SparkSession, sf: str) -> DataFrame:
    scored = _stock(spark, sf).withColumn("score", scoring.stock_score()).where(F.col("score") >= 0.35)
    return scored.select("vec_id", F.bround("score", 4).alias("score"), *[F.bround(n, 4).alias(n) for n in ("technical_quality", "clutter_penalty")])


def stock_reason(spark: SparkSession, sf: str) -> DataFrame:
    """Notes on signals that are stretched, as shares of raw dot products all lie near one half."""
    names = [*scoring.POSITIVE, *scoring.PENALTY]
    stretched = _stock(spark, sf).withColumns({n: F.round(0.5 + 4 * (F.col(n) - 0.5), 6) for n in names})
    return stretched.select("vec_id", scoring.stock_reason().alias("reason"))


def top_scores_all_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The best by score, then by its parts, all falling."""
    scored = _stock(spark, sf).withColumn("score", scoring.stock_score())
    keys = ["score", "technical_quality", "commercial_usefulness"]
    rounded = scored.select("vec_id", *[F.bround(k, 2).alias(k) for k in keys])
    return rounded.orderBy(*[F.desc(k) for k in keys], "vec_id").limit(50)


def review_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """The review queue of a table that lacks most of its columns."""
    bare = gallery(spark, sf).select("image_id", "path", "theme_name")
    return reports.review_rows(bare, "image_id").select("image_id", "mapping_confidence", "primary_master_category", "review_flags", "archive_relative_path", "display_theme_name", "year", "file")


def top_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stock_score(spark, sf).orderBy(F.desc("score"), "vec_id").limit(50).select("vec_id", "score")


_QUERIES = [
    search_topk, search_min_score, search_counts, search_score_columns, search_score_map, search_prompts, embedding_todo,
    cluster_centroids, cluster_top_prompts, cluster_representatives, cluster_misc_merge, cluster_average_linkage, theme_table, theme_rows, dominant_folder,
    exact_duplicates, exact_groups_numbered, inclusion_counts, exact_keepers, near_pairs_time_window, near_pairs_same_key, near_components, near_minus_exact, gallery_excludes, dedupe_summary,
    greedy_unique, greedy_top, exclude_anti_join, scan_predicates,
    normalize_text, token_hits, prompt_label_clean, prompt_categories, review_text, display_theme_names, text_ids,
    evidence_ranking, secondary_categories, evidence_lookup, suspicious_mappings, suspicion_counts, coastal_candidates,
    category_summary, mapping_diagnostics, mapping_diagnostics_whole, category_counts, theme_matrix, theme_matrix_whole, audit_sample, gallery_metrics, flag_reason_counts, flagged_rows, union_years, union_years_whole,
    gold_evaluation, gold_accuracy, gold_confusion, gold_errors, review_queue, review_page, review_page_whole, review_metrics, review_kept, review_defaults,
    pair_softmax_scores, stock_score, stock_reason, top_scores, top_scores_all_keys,
]


def queries() -> dict:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return SQL
