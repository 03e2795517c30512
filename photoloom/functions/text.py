"""Text kernels as column functions: normalising, tokens, labels, slugs and ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words cut out of labels wherever they occur. Fixed values.
LABEL_WORDS = ("photograph", "photo", "scene", "image")
#: Pieces cut out of prompts, one after the other. Fixed values.
PROMPT_PIECES = ("a ", "an ", " photograph", " photo", " scene", " image")
#: Second labels that say nothing in a display name. Fixed values.
WEAK_SECONDS = ("travel photograph showing a place", "village, town, or street", "indoor")
#: Search words with a prompt of their own. Fixed values.
CONDITION_PROMPTS = {
    "night": "a photograph taken at night",
    "day": "a photograph taken during the day",
    "daytime": "a daytime photograph",
    "winter": "a winter photograph with cold seasonal conditions",
    "summer": "a summer photograph with warm seasonal conditions",
    "spring": "a spring photograph",
    "autumn": "an autumn photograph",
    "fall": "an autumn photograph",
    "snow": "a photograph with snow",
    "rain": "a photograph with rain",
    "fog": "a foggy photograph",
    "mist": "a misty photograph",
    "sunset": "a sunset photograph",
    "sunrise": "a sunrise photograph",
}


def safe(c: Column) -> Column:
    """The value as text, empty for null."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize(c: Column) -> Column:
    """Label text in lower case without punctuation, articles and the words for a picture; null gives an empty text."""
    text = F.lower(F.trim(safe(c)))
    text = F.replace(F.replace(text, F.lit("&"), F.lit(" and ")), F.lit("_"), F.lit(" "))
    text = F.regexp_replace(text, r"[^a-z0-9\s,/-]", " ")
    text = F.regexp_replace(text, r"\b(a|an)\b", " ")
    for w in LABEL_WORDS:
        text = F.replace(text, F.lit(w), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def tokens(normalized: Column) -> Column:
    """Different words of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalized, " "), lambda w: w != ""))


def hits(words: Column, keywords: list[str]) -> Column:
    """How many of ``keywords`` are among the (different) words: one look-up in a constant set for each word."""
    return F.size(F.filter(words, lambda w: w.isin(*sorted(set(keywords)))))


def join_fields(*fields: Column) -> Column:
    """The fields that aren't null or blank, joined by `` | ``."""
    return F.concat_ws(" | ", *[F.when(F.trim(f.cast("string")) != "", f.cast("string")) for f in fields])


#: Columns whose text counts as evidence, and those of the review search. Fixed values.
EVIDENCE_FIELDS = ("theme_name", "display_theme_name", "theme_top_label_1", "theme_top_label_2", "theme_top_label_3", "relative_path", "folder", "dominant_folder")
REVIEW_FIELDS = (
    "primary_master_category", "secondary_master_categories", "theme_name", "display_theme_name", "theme_top_label_1", "theme_top_label_2", "theme_top_label_3",
    "review_flags", "archive_relative_path", "relative_path", "path", "folder", "dominant_folder",
)


def text_fields(columns: list[str], fields: tuple[str, ...] = EVIDENCE_FIELDS) -> Column:
    """``join_fields`` of those ``fields`` that are among ``columns``; absent ones are empty."""
    return join_fields(*[F.col(c) for c in fields if c in columns])


def escape_html(c: Column) -> Column:
    """Text for HTML, also inside quoted attributes."""
    for sign, written in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(written))
    return c


def escape_json(c: Column) -> Column:
    """The text as a JSON string in quotes; ``</`` can't end a script."""
    quoted = F.regexp_extract(F.to_json(F.struct(safe(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.replace(quoted, F.lit("</"), F.lit("<\\/"))


#: Categories by words of a prompt, the first that applies: parts of the text (without ``words``) or whole words. Fixed values.
PROMPT_CATEGORIES = (
    ("Farm Animals", "parts", ("farm animal",)),
    ("Other / Uncertain", "parts", ("pet",)),
    ("People and Human Presence", "parts", ("portrait", "people or group")),
    ("Weather, Light, and Atmosphere", "words", ("sunset", "sunrise", "misty", "foggy", "stormy", "dramatic", "moody", "atmospheric", "weather", "sky")),
    ("Wildlife", "words", ("bird", "wildlife")),
    ("Nature Detail", "words", ("flower", "plant", "macro", "texture", "garden", "foliage")),
    ("Waterside and Harbour", "words", ("harbour", "harbor", "port", "waterside", "river")),
    ("Place and Travel", "words", ("village", "town", "street", "travel", "architecture", "historic")),
    ("Other / Uncertain", "words", ("transport", "vehicle", "indoor")),
    ("Landscape", "words", ("coastal", "countryside", "woodland", "forest", "beach", "shoreline", "landscape")),
    ("Nature Detail", "words", ("tree",)),
    ("Nature Detail", "parts", ("abstract visual pattern",)),
)


def prompt_category(prompt: Column) -> Column:
    """The category that a prompt stands for."""
    label = normalize(prompt)
    found = []
    for category, how, words in PROMPT_CATEGORIES:
        applies = reduce(lambda a, b: a | b, [F.contains(label, F.lit(w)) for w in words]) if how == "parts" else hits(tokens(label), list(words)) > 0
        found.append(F.when(applies, category))
    return F.coalesce(*found, F.lit("Other / Uncertain"))


def clean_prompt(c: Column) -> Column:
    """A prompt as a label. The pieces are cut inside words too."""
    text = F.trim(c)
    for p in PROMPT_PIECES:
        text = F.replace(text, F.lit(p), F.lit(""))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def display_name(first: Column, second: Column, folder: Column, cluster: Column) -> Column:
    """First label, a second one that adds something, the folder and the cluster number in two digits or more."""
    a, b = clean_prompt(first), clean_prompt(second)
    number = F.when(cluster.between(0, 9), F.concat(F.lit("0"), cluster.cast("string"))).otherwise(cluster.cast("string"))
    return F.concat_ws(" • ", a, F.when((b != a) & ~b.isin(*WEAK_SECONDS), b), F.when((folder != "") & (folder != "."), folder), number)


def slug(c: Column, mark: str = "_", empty: str = "query", longest: int | None = None) -> Column:
    """Lower-case letters and digits with ``mark`` between runs of them."""
    text = F.regexp_replace(F.lower(F.trim(safe(c))), "[^a-z0-9]+", mark)
    text = F.regexp_replace(text, f"^{mark}+|{mark}+$", "")
    if longest:
        text = F.substring(text, 1, longest)
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(empty))


def cache_key(kind: Column, model: Column) -> Column:
    """The key of a model's cached vectors."""
    digest = F.substring(F.sha1(F.concat(kind, F.lit("|"), model).cast("binary")), 1, 10)
    return F.concat_ws("-", slug(kind, "-", "model", 80), slug(model, "-", "model", 80), digest)


def review_id(*sources: Column) -> Column:
    """An id of the first source that isn't empty: its last 180 characters with signs replaced."""
    first = F.coalesce(*[F.nullif(safe(s), F.lit("")) for s in sources])
    text = F.regexp_replace(F.regexp_replace(first, "[^a-zA-Z0-9_-]+", "_"), "^_+|_+$", "")
    return F.right(text, F.lit(180))


def search_prompt(query: Column) -> Column:
    """The prompt for a search word."""
    known = F.create_map(*[F.lit(x) for kv in CONDITION_PROMPTS.items() for x in kv])
    return F.coalesce(F.element_at(known, F.lower(F.trim(query))), F.concat(F.lit("a photograph of "), F.trim(query)))


def split_list(c: Column, sep: str = ",") -> Column:
    """The stripped, non-empty pieces of a joined list."""
    return F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "")


# --- paths --------------------------------------------------------------------------------------------------------


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """The file suffix with its point in lower case, empty for none."""
    return F.lower(F.regexp_extract(base_name(path), r"[^.](\.[^.]+)$", 1))


def stem_key(path: Column) -> Column:
    """The file name without suffix, blanks, ``_`` and ``-``, in lower case."""
    stem = F.regexp_replace(base_name(path), r"([^.])\.[^.]+$", "$1")
    return F.regexp_replace(F.lower(stem), r"[\s_-]+", "")


def first_folder(path: Column) -> Column:
    """The first folder of a relative path, ``.`` for none."""
    return F.when(F.instr(path, "/") > 1, F.substring_index(path, "/", 1)).otherwise(".")
