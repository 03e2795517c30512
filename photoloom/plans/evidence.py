"""Keyword evidence for taxonomy categories: a declarative scorer as column expressions.

A rule set is data: exact labels, keyword lists with weights, bonuses and a confidence ladder. The evidence of a row
is a map of positive scores; its winner is the greatest, ties going to the category whose evidence was named first.
The many hand-tuned exceptions of a particular archive are business rules and not part of this library; an
``Override`` gives one where it is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photoloom.functions.text import hits, normalize, text_fields, tokens
from photoloom.operators.reports import CATEGORIES, UNCERTAIN

#: Exact theme and prompt labels by category. Fixed values.
LABELS = {
    "Landscape": ["coastal landscape", "countryside landscape", "woodland or forest", "beach or shoreline"],
    "Waterside and Harbour": ["harbour or port with boats", "waterside or river"],
    "Place and Travel": ["village, town, or street", "old building or historic architecture"],
    "Weather, Light, and Atmosphere": ["dramatic sky", "sunset or sunrise", "misty or foggy landscape", "stormy weather", "moody atmospheric landscape", "where light and weather create the mood", "sky, cloud, or weather"],
    "Nature Detail": ["flower or plant close-up", "macro or texture detail", "garden", "tree or foliage"],
    "Wildlife": ["bird or wildlife"],
    "Farm Animals": ["farm animal"],
    "People and Human Presence": ["people or group", "portrait of one person"],
    "Other / Uncertain": ["pet", "indoor"],
}
#: Keywords by category. Fixed values.
KEYWORDS = {
    "Waterside and Harbour": "harbour harbor port boat boats pier quay jetty marina river waterside shore shoreline fishing dock docks".split(),
    "Wildlife": "wildlife bird birds bear bears deer fox foxes seal seals squirrel squirrels raptor raptors owl owls eagle eagles hawk hawks heron gull gulls otter otters".split(),
    "People and Human Presence": "people person portrait group crowd musician musicians performer performers judge judges police officer officers worker workers vendor vendors tourist tourists child children couple man woman women men family families".split(),
    "Rural Life and Working Country": "rural field fields farmland farm tractor barn barns hedgerow country countryside pasture".split(),
    "Weather, Light, and Atmosphere": "weather mist misty fog foggy storm stormy sunset sunrise dramatic rain rainy frost cloud clouds sky moody gloom golden dusk dawn atmospheric light".split(),
    "Nature Detail": "flower flowers plant plants leaf leaves foliage macro texture detail bark fungi mushroom mushrooms garden".split(),
    "Landscape": "landscape coast coastal beach shoreline woodland forest countryside scenic hill hills valley cliff moor".split(),
    "Place and Travel": "travel village town street architecture building historic city market place urban square plaza church cathedral".split(),
    "Other / Uncertain": "pet pets dog dogs cat cats puppy puppies kitten kittens".split(),
    "Farm Animals": "farm sheep cow cows goat goats pig pigs chicken chickens tractor barn barns grazing livestock calf calves".split(),
}
#: Words of the coast and of the open country. Fixed values.
COASTAL_WORDS = "coast coastal beach shore shoreline harbour harbor port pier quay jetty marina dock docks river waterside boat boats".split()
RURAL_WORDS = "countryside woodland forest field fields farmland pasture hill hills valley moor".split()
#: Second categories that go with a first one. Fixed values.
HINTS = {
    "Landscape": ["Weather, Light, and Atmosphere"],
    "Waterside and Harbour": ["Landscape"],
    "Farm Animals": ["Rural Life and Working Country"],
    "Rural Life and Working Country": ["Landscape"],
    "Weather, Light, and Atmosphere": ["Landscape"],
}


@dataclass(frozen=True)
class Override:
    """Where ``condition`` holds the category becomes ``category`` (if its evidence exists) and ``flag`` is noted."""

    condition: Column
    category: str
    flag: str = ""


@dataclass(frozen=True)
class RuleSet:
    labels: dict[str, list[str]] = field(default_factory=lambda: LABELS)
    keywords: dict[str, list[str]] = field(default_factory=lambda: KEYWORDS)
    theme_weight: float = 8.0
    label_weight: float = 5.0
    keyword_weight: float = 2.0
    keyword_weights: dict[str, float] = field(default_factory=lambda: {"Weather, Light, and Atmosphere": 1.0, "Landscape": 1.5})
    #: (least score, least lead, confidence), the first that holds counts
    ladder: tuple[tuple[float, float, float], ...] = ((10, 4, 0.96), (8, 3, 0.88), (6, 2, 0.78), (4, float("-inf"), 0.64))
    otherwise: float = 0.5
    least_score: float = 3.0
    uncertain_cap: float = 0.45
    nothing: float = 0.2
    overrides: tuple[Override, ...] = ()


def merge_rules(given: dict, default: dict) -> dict:
    """``given`` over ``default``, one level deep: a list given replaces the whole list, other entries stay."""
    return {k: {**v, **given.get(k, {})} if isinstance(v, dict) else given.get(k, v) for k, v in default.items()} | {k: v for k, v in given.items() if k not in default}


def score_evidence(images: DataFrame, rules: RuleSet | None = None) -> DataFrame:
    """``images`` with ``evidence`` (map of positive scores), ``category``, ``confidence`` and ``flags``.

    Expects the theme and its three labels; the text is that of EVIDENCE_FIELDS, of which absent and null ones are empty. The second score is that of the
    initial ranking and isn't changed by overrides.
    """
    r = rules or RuleSet()
    names = [c for c in r.keywords if c != "Farm Animals"] + ["Farm Animals"]
    with_text = images.withColumns({
        "__theme": normalize(F.col("theme_name")),
        **{f"__l{i}": normalize(F.col(f"theme_top_label_{i}")) for i in (1, 2, 3)},
        "__text": normalize(text_fields(images.columns)),
    })
    every = sorted({w for own in r.keywords.values() for w in own})
    with_hits = with_text.withColumn("__words", F.filter(tokens(F.col("__text")), lambda w: w.isin(*every)))
    scores, order = [], []
    for k, c in enumerate(names):
        labels = r.labels.get(c, [])
        exact = lambda col, w, labels=labels: F.when(F.col(col).isin(*labels), w).otherwise(0.0) if labels else F.lit(0.0)
        found = exact("__theme", r.theme_weight) + sum((exact(f"__l{i}", r.label_weight) for i in (2, 3)), exact("__l1", r.label_weight))
        scores.append(found + hits(F.col("__words"), r.keywords[c]) * float(r.keyword_weights.get(c, r.keyword_weight)))
        # Evidence is named by the theme first, then the labels, then the keyword lists in their order.
        named = [F.when(F.col(f"__{x}").isin(*labels), i) for i, x in enumerate(("theme", "l1", "l2", "l3"))] if labels else []
        order.append(F.coalesce(*named, F.lit(4 + k)))
    entries = F.array(*[F.struct(s.alias("score"), (-o).alias("first"), F.lit(c).alias("category")) for s, o, c in zip(scores, order, names, strict=True)])
    ranked = with_hits.withColumn("__ranked", F.reverse(F.array_sort(F.filter(entries, lambda e: e["score"] > 0))))
    out = ranked.withColumns({
        "evidence": F.map_from_entries(F.transform("__ranked", lambda e: F.struct(e["category"], e["score"]))),
        "category": F.coalesce(F.expr("get(__ranked, 0).category"), F.lit(UNCERTAIN)),
        "__second": F.coalesce(F.expr("get(__ranked, 1).score"), F.lit(0.0)),
        "flags": F.array().cast("array<string>"),
    })
    for o in r.overrides:
        takes = o.condition & F.coalesce(F.element_at("evidence", o.category) > 0, F.lit(False))
        flag = F.array(F.lit(o.flag)) if o.flag else F.array().cast("array<string>")
        out = out.withColumns({"__takes": F.coalesce(takes, F.lit(False))}).withColumns({"category": F.when(F.col("__takes"), o.category).otherwise(F.col("category")), "flags": F.when(F.col("__takes"), F.concat("flags", flag)).otherwise(F.col("flags"))}).drop("__takes")
    out = out.withColumn("__top", F.coalesce(F.element_at("evidence", F.col("category")), F.lit(0.0)))
    weak = F.col("__top") <= r.least_score
    out = out.withColumns({"category": F.when(weak, UNCERTAIN).otherwise(F.col("category")), "__top": F.when(weak, F.coalesce(F.element_at("evidence", F.lit(UNCERTAIN)), F.lit(0.0))).otherwise(F.col("__top"))})
    steps = F.lit(r.otherwise)
    for score, lead, value in reversed(r.ladder):
        holds = F.col("__top") >= score
        steps = F.when(holds & (F.col("__top") - F.col("__second") >= lead) if lead > float("-inf") else holds, value).otherwise(steps)
    sure = F.when(F.col("category") == UNCERTAIN, F.least(steps, F.lit(r.uncertain_cap))).otherwise(steps)
    out = out.withColumn("confidence", F.when(F.size("evidence") == 0, r.nothing).otherwise(sure))
    low = F.when(F.col("confidence") < 0.7, F.array(F.lit("low_mapping_confidence"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("flags", F.array_sort(F.array_distinct(F.concat("flags", low)))).select(*images.columns, "evidence", "category", "confidence", "flags")


def second_categories(primary: Column, words: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Categories besides the first, in the order of the taxonomy: its hints and those with keywords in the text."""
    kw = keywords or KEYWORDS
    least = {"Waterside and Harbour": 1}
    scored = [c for c in CATEGORIES if c in kw and c not in ("Wildlife", "Farm Animals", UNCERTAIN)]
    tests = []
    for c in CATEGORIES:
        hinted = [p for p, others in HINTS.items() if c in others]
        test = primary.isin(*hinted) if hinted else F.lit(False)
        if c in scored:
            test = test | (hits(words, kw[c]) >= least.get(c, 2))
        tests.append(F.when(F.coalesce(test, F.lit(False)) & ~primary.eqNullSafe(F.lit(c)) & F.lit(c != UNCERTAIN), c))
    return F.array_compact(F.array(*tests))


def evidence_of(json: Column, category: Column) -> Column:
    """The score of a category in evidence written as JSON, 0 for none or broken text."""
    return F.coalesce(F.element_at(F.from_json(json, "map<string,double>"), category), F.lit(0.0))
