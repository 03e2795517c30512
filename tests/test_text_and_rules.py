import re

from pyspark.sql import functions as F

from photoloom.functions import text
from photoloom.operators import flags, reports, scoring, themes
from photoloom.plans.evidence import Override, RuleSet, evidence_of, merge_rules, score_evidence, second_categories

IMAGE = "image_id long, theme_name string, display_theme_name string, theme_top_label_1 string, theme_top_label_2 string, theme_top_label_3 string, relative_path string"


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_normalize(spark):
    cases = {
        "A Photo_of & the village, town, or street scene!": "of and the village, town, or street",
        "2023/04/25/IMG_0001.jpg": "2023/04/25/img 0001 jpg",
        "imagery photographs": "ry s",
        "": "",
        None: "",
        "  An   ant a b-c ": "ant b-c",
    }
    for given, wanted in cases.items():
        assert one(spark, text.normalize(F.col("x")), x=given) == wanted


def test_prompts_and_names(spark):
    assert one(spark, text.clean_prompt(F.col("x")), x="a sea and sky photograph") == "seand sky"
    name = text.display_name(F.col("a"), F.col("b"), F.col("f"), F.col("c"))
    assert one(spark, name, a="a pet photograph", b="an indoor scene", f=".", c=7) == "pet • 07"
    assert one(spark, name, a="a pet photograph", b="a garden photograph", f="Holiday", c=123) == "pet • garden • Holiday • 123"
    assert one(spark, text.search_prompt(F.col("x")), x=" Night ") == "a photograph taken at night"
    assert one(spark, text.search_prompt(F.col("x")), x="red car") == "a photograph of red car"
    assert one(spark, text.slug(F.col("x")), x="--") == "query"
    assert one(spark, text.review_id(F.col("x"), F.col("y")), x=None, y="/a b/ü" + "z" * 300) == "z" * 180
    assert re.fullmatch(r"clip-vit-b-32-[0-9a-f]{10}", one(spark, text.cache_key(F.lit("clip"), F.col("x")), x="ViT B/32"))


def test_paths(spark):
    for path, wanted in {"a/b/IMG 1-x.JPG": (".jpg", "img1x", "a"), "x.tar.gz": (".gz", "x.tar", "."), ".hidden": ("", ".hidden", "."), "a/noext": ("", "noext", "a")}.items():
        got = tuple(one(spark, f(F.col("x")), x=path) for f in (text.suffix, text.stem_key, text.first_folder))
        assert got == wanted


def image(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], IMAGE)


def test_evidence(spark):
    df = image(
        spark,
        ("a farm animal photograph", None, None, None, None, "sheep/barn/1.jpg"),
        ("a harbour or port scene with boats", "", "a waterside or river scene", "a dramatic sky photograph", None, ""),
        (None, None, None, None, None, None),
        ("unknown", "", "", "", "", "a hill"),
    )
    got = {r["image_id"]: r for r in score_evidence(df).collect()}
    assert got[0]["category"] == "Farm Animals" and got[0]["evidence"]["Farm Animals"] == 8 + 2  # the label and the word "farm"
    # 8 + 5 exact, and the words harbour, port, boats, waterside, river
    assert got[1]["evidence"]["Waterside and Harbour"] == 8 + 5 + 5 * 2 and got[1]["confidence"] == 0.96
    assert (got[2]["category"], got[2]["confidence"], got[2]["flags"], got[2]["evidence"]) == ("Other / Uncertain", 0.2, ["low_mapping_confidence"], {})
    assert got[3]["category"] == "Other / Uncertain" and got[3]["confidence"] == 0.45  # 1.5 for "hill" is too weak


def test_ties_go_to_what_was_named_first(spark):
    df = image(spark, ("x", "", "a garden photograph", "a pet photograph", "", ""))
    rules = RuleSet(keywords={c: [] for c in RuleSet().keywords})
    assert score_evidence(df, rules).first()["category"] == "Nature Detail"
    df = image(spark, ("x", "", "a pet photograph", "a garden photograph", "", ""))
    assert score_evidence(df, rules).first()["category"] == "Other / Uncertain"


def test_overrides_and_rule_files(spark):
    df = image(spark, ("a dramatic sky photograph", "", "a bird or wildlife photograph", "", "", ""))
    rules = RuleSet(overrides=(Override(F.col("theme_name").contains("sky"), "Wildlife", "subject_first"), Override(F.lit(True), "Farm Animals", "never")))
    got = score_evidence(df, rules).first()
    assert got["category"] == "Wildlife" and "subject_first" in got["flags"] and "never" not in got["flags"]
    assert merge_rules({"k": {"a": [1]}, "new": 2}, {"k": {"a": [0], "b": [3]}, "t": 1}) == {"k": {"a": [1], "b": [3]}, "t": 1, "new": 2}


def test_second_categories_and_json(spark):
    words = text.tokens(F.col("w"))
    assert one(spark, second_categories(F.col("p"), words), p="Wildlife", w="river village town farm") == ["Waterside and Harbour", "Place and Travel"]
    assert one(spark, second_categories(F.col("p"), words), p=None, w="") == []
    assert one(spark, evidence_of(F.col("j"), F.lit("a b")), j='{"a b": 2.5}') == 2.5
    assert one(spark, evidence_of(F.col("j"), F.lit("a")), j="{bad") == 0.0


def test_scores(spark):
    names = [*scoring.POSITIVE, *scoring.PENALTY]
    df = spark.createDataFrame([tuple([0.8] * 6 + [0.1] * 6), tuple([0.5] * 12), tuple([0.1] * 6 + [0.9] * 6)], ", ".join(f"{n} double" for n in names))
    got = [tuple(r) for r in df.select(scoring.stock_score(), scoring.stock_reason()).collect()]
    assert abs(got[0][0] - (0.8 * 0.78 + 0.9 * 0.22)) < 1e-9
    assert got[0][1].startswith("strong commercial potential; looks technically solid") and got[1][1] == "mixed stock signals"
    assert got[2][1].endswith("more editorial than commercial")


def test_average_linkage(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = np.eye(8)[:4]
    x = np.concatenate([c + 0.05 * rng.standard_normal((5, 8)) for c in centres])
    rows = [(i, "g", [float(v) for v in r]) for i, r in enumerate(x)] + [(100, "one", [1.0] * 8), (101, "one", None)]
    df = spark.createDataFrame(rows, "id long, g string, v array<double>")
    got = {r["id"]: r["cluster_id"] for r in themes.cluster_average_linkage(df, "id", "v", ["g"], 0.22).collect()}
    assert [got[i] for i in range(20)] == [k for k in range(4) for _ in range(5)] and got[100] == 0 and 101 not in got


def test_average_linkage_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - x @ x.T
    groups = [{i} for i in range(40)]
    while True:
        best = min(((np.mean([d[i, j] for i in a for j in b]), k, m) for k, a in enumerate(groups) for m, b in enumerate(groups) if k < m), default=(9, 0, 0))
        if best[0] >= 0.22:
            break
        groups[best[1]] |= groups[best[2]]
        del groups[best[2]]
    roots = themes._average_linkage(d.copy(), 0.22)
    assert {frozenset(np.flatnonzero(roots == r)) for r in set(roots)} == {frozenset(g) for g in groups}


def test_report_edges(spark):
    gold = spark.createDataFrame([("a", "X"), ("a", "X"), ("b", None), ("zz", "X")], "path_key string, correct_category string")
    pred = spark.createDataFrame([("a", "X"), ("a", "Y"), ("b", "X"), (None, "X")], "path_key string, predicted_category string")
    ev = reports.evaluate(gold, pred, "path_key")
    assert ev.count() == 6  # two predictions of one path fan out
    a = reports.accuracy(ev).first()
    assert (a["matched_rows"], a["unmatched_rows"], a["correct_rows"]) == (5, 1, 2)
    assert reports.accuracy(ev.where("false")).first()["accuracy"] == 0.0
    cells = {(r[0], r[1]): r[2] for r in reports.confusion(ev).collect()}
    assert cells == {("X", "X"): 2, ("X", "Y"): 2, ("X", "All"): 4, ("All", "X"): 2, ("All", "Y"): 2, ("All", "All"): 4}


def test_row_rules(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "x int")
    x = F.col("x")
    assert [r["reasons"] for r in flags.with_reasons(df, {"small": x < 3, "odd": x % 2 == 1}).collect()] == [["small", "odd"], ["odd"]]
    got = df.select(flags.first_match([(x < 3, "a"), (x < 9, "b")], "c"), flags.additive_score(50, [(x > 0, 60), (x > 3, -80)], 1, 99), flags.first_match([], "z")).collect()
    assert [tuple(r) for r in got] == [("a", 99.0, "z"), ("b", 30.0, "z"), ("c", 50.0, "z")]
