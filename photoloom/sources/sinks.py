"""Writers: CSV, text, JSON, cached vectors, pages and copies of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photoloom.functions.text import escape_html, safe
from photoloom.session import SharedFiles
from photoloom.sources.files import PIECE, opened


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header. Lists are joined with ``, `` and maps written as JSON. ``one_file`` is for small reports."""
    flat = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        flat.append((F.array_join(c, ", ") if kind == "array" else F.to_json(c) if kind in ("map", "struct") else c).alias(f.name))
    out = df.select(*flat)
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """One value a line, sorted over all files."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").orderBy("value").write.mode("overwrite").text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """A one-row summary as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_vectors(df: DataFrame, path: str, cache_key: str) -> None:
    """Adds vectors and their manifest columns to the cache of a model, with a note of how many there are."""
    df.withColumn("cache_key", F.lit(cache_key)).write.mode("append").partitionBy("cache_key").parquet(f"{path}/vectors")
    spark = df.sparkSession
    n = spark.read.parquet(f"{path}/vectors").where(F.col("cache_key") == cache_key).agg(F.lit(cache_key).alias("cache_key"), F.count(F.lit(1)).alias("n"), F.current_timestamp().alias("at"))
    n.write.mode("append").parquet(f"{path}/notes")


def read_cached(spark: SparkSession, path: str, cache_key: str) -> DataFrame | None:
    """The cached vectors of a model; null for none, or if they are not as many as the last note says (a broken write)."""
    if not SharedFiles(spark).exists(f"{path}/notes"):
        return None
    note = spark.read.parquet(f"{path}/notes").where(F.col("cache_key") == cache_key).agg(F.max_by("n", "at")).first()[0]
    held = spark.read.parquet(f"{path}/vectors").where(F.col("cache_key") == cache_key)
    return held if note is not None and held.count() == note else None


def insert_first(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with new columns in front of its own."""
    return df.select(*[c.alias(name) for name, c in columns.items()], *[c for c in df.columns if c not in columns])


def write_page(rows: DataFrame, path: str, title: str, section: str, position: str, text: list[str], image: str | None = None) -> None:
    """A page of cards, by section and position, as lines of HTML.

    Every card is written by column expressions and the page is sorted by ranges, so it may be as long as its rows; cap
    the rows first (``review_page``, ``audit_sample``). All text is escaped.
    """
    shown = [F.concat(F.lit("<p>"), escape_html(safe(F.col(c))), F.lit("</p>")) for c in text]
    picture = [F.concat(F.lit('<img loading="lazy" src="'), escape_html(safe(F.col(image))), F.lit('">'))] if image else []
    card = F.concat(F.lit('<div class="card">'), *picture, *shown, F.lit("</div>"))
    cards = rows.select(safe(F.col(section)).alias("s"), F.lit(2).alias("k"), F.col(position).cast("long").alias("p"), card.alias("value"))
    heads = rows.select(safe(F.col(section)).alias("s")).distinct().select("s", F.lit(1).alias("k"), F.lit(0).cast("long").alias("p"), F.concat(F.lit("<h2>"), escape_html(F.col("s")), F.lit("</h2>")).alias("value"))
    top = rows.sparkSession.range(1).select(F.lit("").alias("s"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("p"), F.concat(F.lit("<!doctype html><meta charset='utf-8'><title>"), escape_html(F.lit(title)), F.lit("</title>")).alias("value"))
    top.union(heads).union(cards).orderBy(F.col("k") > 0, "s", "k", "p").select("value").write.mode("overwrite").text(path)


def copy_files(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Copies the files of column ``source`` to the paths in ``target``, on the workers: ``source, target, copied``.

    Targets should be distinct: of several sources for one target any may remain. A file that can't be read is not copied.
    The copies are made when the result is read, and made again if a task is repeated.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = []
            for a, b in zip(f["source"], f["target"], strict=True):
                try:
                    (system, at), (other, to) = opened(a), opened(b)
                    other.create_dir(to.rsplit("/", 1)[0], recursive=True)
                    with system.open_input_stream(at) as i, other.open_output_stream(to) as o:
                        while piece := i.read(PIECE):
                            o.write(piece)
                    done.append(True)
                except (OSError, ValueError, TypeError, AttributeError):
                    done.append(False)
            yield f.assign(copied=done)

    return rows.select(F.col(source).alias("source"), F.col(target).alias("target")).mapInPandas(run, "source string, target string, copied boolean")


def dead_letters(df: DataFrame, failed: str, path: str, column: str = "path") -> DataFrame:
    """Writes ``column`` of the rows whose ``failed`` is null to a list, and returns the others."""
    write_lines(df.where(F.col(failed).isNull()), column, path)
    return df.where(F.col(failed).isNotNull())
