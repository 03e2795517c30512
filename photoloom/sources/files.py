"""Readers: image inventories, tables, lists, rules, yearly folders and cached vectors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from photoloom.functions.text import base_name, suffix
from photoloom.operators.dedupe import OTHER_IMAGES, RAW, RENDERED
from photoloom.plans.evidence import merge_rules
from photoloom.plans.prompts import DEFAULT_PROMPTS, DEFAULT_PROMPTS_LONG, DEFAULT_TERMS
from photoloom.session import SharedFiles

#: The suffixes of the plain scan, which knows fewer kinds of files. Fixed values.
PLAIN_SUFFIXES = (".jpg", ".jpeg", ".png", ".heic", ".dng", ".arw", ".cr2", ".nef")
#: Path parts of files that are no photos of their own. Fixed values.
IGNORED = ("metadata", "preview", "thumbnail", "sidecar")

SCORES = T.StructType([T.StructField("file", T.StringType()), T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())])
GOLD = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "correct_category", "notes")])
DECISIONS = T.StructType([T.StructField(c, T.StringType()) for c in ("review_id", "decision", "reviewed_at")])


def scan_images(spark: SparkSession, root: str, suffixes: Iterable[str] = (*RENDERED, *OTHER_IMAGES, *RAW), skip_ignored: bool = True, excluded: DataFrame | None = None, content: bool = False) -> DataFrame:
    """``path, relpath, size, mtime`` (and ``content``) of the image files below ``root``.

    Hidden files and the ignored path parts are left out, then the relative paths of ``excluded``. Without
    ``content`` no file is opened.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relpath = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    rows = files.select(F.col("path"), relpath.alias("relpath"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *["content"] * content)
    rows = rows.where(suffix(F.col("path")).isin(*suffixes))
    if skip_ignored:
        rows = rows.where(~F.startswith(base_name(F.col("path")), F.lit(".")) & ~F.lower("relpath").rlike("|".join(IGNORED)))
    return rows if excluded is None else rows.join(excluded.select("relpath"), "relpath", "left_anti")


def scan_plain(spark: SparkSession, root: str) -> DataFrame:
    """The plain scan: fewer suffixes; hidden files and paths with ``metadata`` are passed over."""
    rows = scan_images(spark, root, PLAIN_SUFFIXES, skip_ignored=False)
    return rows.where(~F.startswith(base_name(F.col("path")), F.lit(".")) & ~F.contains(F.lower("path"), F.lit("metadata")))


def opened(path: str):
    """A file system and a path in it, for workers: local paths and all that pyarrow reaches (``file:``, ``hdfs:``, ``s3:``, ...)."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


#: Bytes of a file that are read at once.
PIECE = 1 << 20


def _sha256(paths: pd.Series) -> pd.Series:
    def one(path: str | None) -> str | None:
        if path is None:
            return None
        digest = hashlib.sha256()
        try:
            system, at = opened(path)
            with system.open_input_stream(at) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
        except (OSError, ValueError):
            return None
        return digest.hexdigest()

    return paths.map(one)


def _there(paths: pd.Series) -> pd.Series:
    from pyarrow import fs

    def one(path: str | None) -> bool:
        try:
            system, at = opened(path or "")
            return bool(path) and system.get_file_info(at).type != fs.FileType.NotFound
        except (OSError, ValueError):
            return False

    return paths.map(one).astype(bool)


def with_sha256(photos: DataFrame) -> DataFrame:
    """Hashes of the files whose size occurs more than once; the others need none.

    Files are read in pieces on the workers, so their size has no bound; null for one that can't be read. Where the rows
    have ``content`` already, that is hashed instead.
    """
    shared = photos.groupBy("size").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size")
    marked = photos.join(shared.withColumn("__twice", F.lit(True)), "size", "left")
    wanted = F.when(F.col("__twice"), F.col("content" if "content" in photos.columns else "path"))
    digest = F.sha2(wanted, 256) if "content" in photos.columns else F.pandas_udf(_sha256, "string")(wanted)
    return marked.withColumn("sha256", digest).drop("__twice")


def capture_time(*written: str, fallback: str = "mtime") -> Column:
    """The first camera time that parses, else the file's."""
    return F.coalesce(*[F.try_to_timestamp(F.col(c), F.lit("yyyy:MM:dd HH:mm:ss")) for c in written], F.col(fallback))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """A table with a header line; quotes are doubled inside quoted fields."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, **defaults: object) -> DataFrame:
    """Adds the columns that ``df`` lacks."""
    return df.withColumns({c: v if isinstance(v, Column) else F.lit(v) for c, v in defaults.items() if c not in df.columns})


def present(df: DataFrame, *columns: str) -> DataFrame:
    """Those of ``columns`` that ``df`` has, in their order."""
    return df.select(*[c for c in columns if c in df.columns])


def _text(path: str) -> str | None:
    """A small file's text, through Hadoop where a session is active; null if there is none."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        files = SharedFiles(spark)
        return files.text(path) if files.exists(path) else None
    return Path(path).read_text(encoding="utf-8") if Path(path).exists() else None


def read_list(path: str, fallback: Iterable[str] = ()) -> list[str]:
    """Lines that aren't blank or comments, else ``fallback``: prompts and other short lists."""
    return [x.strip() for x in (_text(path) or "").splitlines() if x.strip() and not x.strip().startswith("#")] or list(fallback)


def theme_prompts(path: str, long: bool = False) -> list[str]:
    """The prompts of a list, or the default ones if it is missing or empty."""
    return read_list(path, DEFAULT_PROMPTS_LONG if long else DEFAULT_PROMPTS)


def read_excludes(spark: SparkSession, path: str) -> DataFrame:
    """``relpath`` of an exclude list, with ``/`` for ``\\``."""
    lines = spark.read.text(path).select(F.trim(F.translate("value", "\\", "/")).alias("relpath"))
    return lines.where("relpath <> ''").distinct()


def search_terms(given: str = "", file: str | None = None, fallback: Iterable[str] = DEFAULT_TERMS) -> list[str]:
    """Search terms of a comma list and a file, each once whatever its letter case, in their order."""
    terms = [x.strip() for x in given.split(",") if x.strip()] + (read_list(file) if file else [])
    firsts: dict[str, str] = {}
    for x in terms or list(fallback):
        firsts.setdefault(x.lower(), x)
    return list(firsts.values())


def read_rules(path: str, default: dict) -> dict:
    """Rules of a JSON file over the defaults, one level deep; the defaults if it is missing or broken."""
    try:
        return merge_rules(json.loads(_text(path) or ""), default)
    except (OSError, ValueError):
        return default


def year_folders(root: str, years: Iterable[str] | None = None) -> list[str]:
    """Names of the child folders that are numbers, sorted, limited to ``years`` if given."""
    names = [n for n in SharedFiles(SparkSession.active()).folders(root) if n.isdigit()]
    return [n for n in names if years is None or n in set(years)]


def read_years(spark: SparkSession, root: str, years: Iterable[str] | None = None, strict: bool = False) -> DataFrame | None:
    """The ``<year>_images.csv`` of all years by name, with ``year``; a year without both its files is left out, or an error.

    Years are few; those whose tables have the same header line are read together.
    """
    files, by_header = SharedFiles(spark), {}
    for y in year_folders(root, years):
        own = [f"{root}/{y}/{y}_{kind}.csv" for kind in ("images", "themes")]
        if not all(files.exists(f) for f in own):
            if strict:
                raise FileNotFoundError(f"year {y} is incomplete")
            continue
        columns = tuple(read_csv(spark, own[0]).columns)
        by_header.setdefault(columns, []).append(own[0])
    year = F.regexp_extract(F.input_file_name(), r"/(\d+)_images\.csv$", 1)
    tables = [read_csv(spark, paths).withColumn("year", year) for paths in by_header.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables) if tables else None


def clean_source(df: DataFrame, position: str, suffixes: Iterable[str] = (*RENDERED, *OTHER_IMAGES, *RAW), limit: int = 0, existing: bool = False) -> DataFrame:
    """Rows with a path, the first of each path, the first ``limit`` of them, then those whose file exists and has an image suffix.

    Files are looked up only with ``existing``, and then a source of which nothing is left is an error.
    """
    rows = df.where(F.trim("path") != "")
    firsts = rows.groupBy("path").agg(F.min(position).alias(position))
    rows = rows.join(firsts, ["path", position], "left_semi")
    if limit:
        rows = rows.orderBy(position).limit(limit)
    if existing:
        rows = rows.where(F.pandas_udf(_there, "boolean")("path"))
    rows = rows.where(suffix(F.col("path")).isin(*suffixes))
    if existing and not rows.limit(1).count():
        raise ValueError("the source has no image that exists")
    return rows


def _matrix_header(path: str) -> tuple[int, tuple[int, int], str]:
    """Where the numbers of an ``.npy`` matrix begin, its shape and their kind."""
    import numpy as np

    system, at = opened(path)
    with system.open_input_file(at) as f:
        version = np.lib.format.read_magic(f)
        shape, by_column, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if by_column and len(shape) > 1:
            raise ValueError("a matrix that is stored by columns")
        return f.tell(), shape, kind.str


def read_vectors(spark: SparkSession, matrix: str, manifest: DataFrame, key: str = "row_index") -> DataFrame:
    """The rows of an ``.npy`` matrix as vectors beside their manifest rows. Tasks read their own stretch of the file."""
    import numpy as np

    start, (n, width), kind = _matrix_header(matrix)
    if manifest.count() != n:
        raise ValueError("the manifest and the matrix differ in length")

    def load(frames):
        system, at = opened(matrix)
        size = np.dtype(kind).itemsize * width
        with system.open_input_file(at) as f:
            for frame in frames:
                for a, b in zip(frame["a"], frame["b"], strict=True):
                    f.seek(start + a * size)
                    m = np.frombuffer(f.read((b - a) * size), kind).reshape(b - a, width)
                    yield pd.DataFrame({"row_index": np.arange(a, b), "embedding": list(m.astype(np.float32))})

    step = 4096
    parts = spark.range(-(-n // step)).select((F.col("id") * step).alias("a"), F.least((F.col("id") + 1) * step, F.lit(n)).alias("b"))
    return manifest.join(parts.mapInPandas(load, "row_index long, embedding array<float>").withColumnRenamed("row_index", key), key)
