"""DuckDB texts of the catalogue's queries, written apart from the Spark programs."""

from __future__ import annotations

from photoloom.functions.sql import content_sql, place_sql
from photoloom.functions.text import CONDITION_PROMPTS, LABEL_WORDS, PROMPT_CATEGORIES, PROMPT_PIECES, REVIEW_FIELDS, WEAK_SECONDS
from photoloom.operators import scoring
from photoloom.operators.dedupe import CAMERA_STARTS, DERIVED_PARTS, OTHER_IMAGES, RAW, RENDERED
from photoloom.operators.reports import CATEGORIES
from photoloom.plans.evidence import COASTAL_WORDS, HINTS, KEYWORDS, LABELS, RURAL_WORDS
from photoloom.plans.prompts import PROMPTS

DIM = 64


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def inside(xs) -> str:
    return "(" + ", ".join(q(x) for x in xs) + ")"


def normal(c: str) -> str:
    text = f"replace(replace(lower(trim(coalesce({c}, ''))), '&', ' and '), '_', ' ')"
    text = rf"regexp_replace(regexp_replace({text}, '[^a-z0-9\s,/-]', ' ', 'g'), '\b(a|an)\b', ' ', 'g')"
    for w in LABEL_WORDS:
        text = f"replace({text}, '{w}', ' ')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def prompt(c: str) -> str:
    text = f"trim({c})"
    for p in PROMPT_PIECES:
        text = f"replace({text}, '{p}', '')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def base(c: str) -> str:
    return f"regexp_extract({c}, '[^/]*$')"


def suffix(c: str) -> str:
    return rf"lower(regexp_extract({base(c)}, '[^.](\.[^.]+)$', 1))"


def stem(c: str) -> str:
    return rf"regexp_replace(lower(regexp_replace({base(c)}, '([^.])\.[^.]+$', '\1')), '[\s_-]+', '', 'g')"


def folder(c: str) -> str:
    return f"CASE WHEN instr({c}, '/') > 1 THEN split_part({c}, '/', 1) ELSE '.' END"


def name_score(c: str) -> str:
    name = f"lower({base(c)})"
    starts = " OR ".join(f"starts_with({name}, '{x}')" for x in CAMERA_STARTS)
    parts = " OR ".join(f"contains({name}, '{x}')" for x in DERIVED_PARTS)
    return f"(CASE WHEN {starts} THEN 1 ELSE 0 END - CASE WHEN {parts} THEN 1 ELSE 0 END)"


def far(a: str, b: str) -> str:
    return "(" + " + ".join(f"bit_count(xor({a}[{i}], {b}[{i}]))::INT" for i in range(1, 5)) + ")"


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"


TEXT = normal("array_to_string([x FOR x IN [theme_name, display_theme_name, theme_top_label_1, theme_top_label_2, theme_top_label_3, relative_path] IF trim(x) <> ''], ' | ')")
CONF = "CASE WHEN NOT isnan(mapping_confidence) THEN mapping_confidence END"
ID = "regexp_replace(regexp_replace(coalesce(nullif(path, ''), nullif(archive_relative_path, ''), nullif(relative_path, ''), image_id::VARCHAR), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g')"
REVIEW_ID = f"right({ID}, 180)"


def hit(words: str, keywords) -> str:
    return f"len(list_intersect({words}, {listed(sorted(set(keywords)))}))"


def slug(c: str, mark: str, empty: str, longest: int | None) -> str:
    text = rf"regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '{mark}', 'g'), '^{mark}+|{mark}+$', '', 'g')"
    if longest:
        text = f"substr({text}, 1, {longest})"
    return f"coalesce(nullif({text}, ''), '{empty}')"


# --- search and themes ----------------------------------------------------------------------------------------------

_SCORES = f"scores AS (SELECT q.vec_id AS query_id, e.vec_id, round({dot('e.embedding', 'q.embedding')}, 4) + 0.0::DOUBLE AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)"


def found(k: int, where: str = "true") -> str:
    return f"found AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scores WHERE {where}) WHERE rank <= {k})"


_CENTRES = f"""means AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, {DIM + 1}) t(i) GROUP BY label, i),
centres AS (SELECT label, [x / greatest(sqrt(list_dot_product(mean, mean)), 1e-8) FOR x IN mean] AS centroid FROM (SELECT label, list(m ORDER BY i) AS mean FROM means GROUP BY label)),
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)"""
_PROMPT_SCORES = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, prompt_id DESC) AS rank FROM (
  SELECT centres.label, p.vec_id AS prompt_id, round({dot('p.embedding', 'centroid')}, 4) AS score FROM centres, embeddings p WHERE p.vec_id < 24))"""
_REPS = f"""reps AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY CASE WHEN n > 3 THEN score END DESC NULLS LAST, vec_id) AS rank, vec_id, score FROM (
  SELECT label, n, vec_id, round_even({dot('embedding', 'centroid')}, 4) AS score FROM embeddings JOIN centres USING (label) JOIN sizes USING (label)))"""

_THEMES = f"""WITH {_CENTRES}, {_PROMPT_SCORES}, {_REPS},
named AS (SELECT label, {", ".join(f"max(CASE WHEN rank = {i} THEN {listed(PROMPTS)}[prompt_id + 1] END) AS top_label_{i}" for i in (1, 2, 3))} FROM ranked WHERE rank <= 3 GROUP BY label),
shown AS (SELECT label, {", ".join(f"max(CASE WHEN rank = {i} THEN vec_id END) AS representative_{i}" for i in (1, 2, 3))} FROM reps WHERE rank <= 3 GROUP BY label),
folders AS (SELECT label, f AS dominant_folder FROM (SELECT label, 'folder ' || (vec_id % 7) AS f, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, min(vec_id)) AS k FROM embeddings GROUP BY label, vec_id % 7) WHERE k = 1)
SELECT label AS theme_cluster, n AS image_count, {prompt("top_label_1")} AS theme_name, array_to_string([x FOR x IN [{prompt("top_label_1")},
  CASE WHEN {prompt("top_label_2")} <> {prompt("top_label_1")} AND {prompt("top_label_2")} NOT IN {inside(WEAK_SECONDS)} THEN {prompt("top_label_2")} END, dominant_folder, lpad(label::VARCHAR, 2, '0')] IF x IS NOT NULL], ' • ') AS display_theme_name,
  top_label_1, top_label_2, top_label_3, dominant_folder, representative_1, representative_2, representative_3
FROM sizes JOIN named USING (label) JOIN shown USING (label) JOIN folders USING (label)"""

# --- duplicates -----------------------------------------------------------------------------------------------------

_PHOTOS = f"""photos AS (SELECT photo_id, relpath, size, width, height, coalesce(capture_time, mtime) AS taken, CASE WHEN len(phash) = 4 THEN phash END AS phash, {content_sql('sha256')} AS content,
  {stem('relpath')} AS stem FROM photo_info WHERE deleted_at IS NULL),
scored AS (SELECT *, CASE WHEN {suffix('relpath')} IN {inside(RENDERED)} THEN 5 WHEN {suffix('relpath')} IN {inside(OTHER_IMAGES)} THEN 4 WHEN {suffix('relpath')} IN {inside(RAW)} THEN 2 ELSE 1 END AS f,
  coalesce(width, 0)::BIGINT * coalesce(height, 0) AS px, coalesce(size, 0) AS sz, {name_score('relpath')} AS nm FROM photos),
exact AS (SELECT min(photo_id) OVER (PARTITION BY size, content) AS group_id, photo_id, count(*) OVER (PARTITION BY size, content) AS n FROM photos WHERE size IS NOT NULL AND content IS NOT NULL),
exact_groups AS (SELECT group_id, photo_id FROM exact WHERE n > 1)"""


def keepers(groups: str) -> str:
    return f"""SELECT group_id, photo_id AS keeper_id, n FROM (SELECT group_id, photo_id, count(*) OVER (PARTITION BY group_id) AS n,
  row_number() OVER (PARTITION BY group_id ORDER BY f DESC, px DESC, sz DESC, nm DESC, relpath DESC, photo_id DESC) AS k FROM {groups} JOIN scored USING (photo_id)) WHERE k = 1"""


_TIME_CLASS = "time_class AS (SELECT phash, taken, min(photo_id) AS rep FROM photos WHERE phash IS NOT NULL AND taken IS NOT NULL GROUP BY ALL)"
_STEM_CLASS = "stem_class AS (SELECT phash, stem, min(photo_id) AS rep FROM photos WHERE phash IS NOT NULL GROUP BY ALL)"
_TIME_PAIRS = f"""time_pairs AS (SELECT DISTINCT least(a.rep, b.rep) AS a_id, greatest(a.rep, b.rep) AS b_id, {far('a.phash', 'b.phash')} AS distance
  FROM time_class a JOIN time_class b ON b.taken BETWEEN a.taken AND a.taken + INTERVAL 8 SECOND AND a.rep <> b.rep AND {far('a.phash', 'b.phash')} <= 6)"""
_STEM_PAIRS = f"""stem_pairs AS (SELECT DISTINCT a.rep AS a_id, b.rep AS b_id, {far('a.phash', 'b.phash')} AS distance
  FROM stem_class a JOIN stem_class b ON a.stem = b.stem AND a.rep < b.rep AND {far('a.phash', 'b.phash')} <= 8)"""
_NEAR = f"""{_PHOTOS}, {_TIME_CLASS}, {_STEM_CLASS}, {_TIME_PAIRS}, {_STEM_PAIRS},
links AS (SELECT a_id, b_id FROM time_pairs UNION SELECT a_id, b_id FROM stem_pairs
  UNION SELECT rep, photo_id FROM photos JOIN time_class USING (phash, taken) WHERE rep <> photo_id
  UNION SELECT rep, photo_id FROM photos JOIN stem_class USING (phash, stem) WHERE rep <> photo_id),
ways AS (SELECT a_id AS u, b_id AS v FROM links UNION SELECT b_id, a_id FROM links),
reach AS (SELECT DISTINCT u AS vertex, u AS root FROM ways UNION SELECT w.v, r.root FROM reach r JOIN ways w ON w.u = r.vertex WHERE r.root < w.v),
near_all AS (SELECT min(root) AS group_id, vertex AS photo_id FROM reach GROUP BY vertex),
near_sets AS (SELECT group_id, list(photo_id ORDER BY photo_id) AS s FROM near_all GROUP BY group_id),
exact_sets AS (SELECT DISTINCT list(photo_id ORDER BY photo_id) AS s FROM exact_groups GROUP BY group_id),
near_groups AS (SELECT group_id, photo_id FROM near_all WHERE group_id IN (SELECT group_id FROM near_sets WHERE s NOT IN (SELECT s FROM exact_sets))),
kept AS (SELECT 0 AS kind, * FROM ({keepers('exact_groups')}) UNION ALL SELECT 1, * FROM ({keepers('near_groups')})),
members AS (SELECT 0 AS kind, * FROM exact_groups UNION ALL SELECT 1, * FROM near_groups),
excluded AS (SELECT DISTINCT m.relpath FROM members JOIN kept USING (kind, group_id) JOIN photos m ON m.photo_id = members.photo_id JOIN photos k ON k.photo_id = keeper_id WHERE m.relpath <> k.relpath)"""

# --- evidence -------------------------------------------------------------------------------------------------------

_NAMES = [c for c in KEYWORDS if c != "Farm Animals"] + ["Farm Animals"]
_WEIGHT = {"Weather, Light, and Atmosphere": 1.0, "Landscape": 1.5}


def _evidence() -> str:
    entries = []
    for k, c in enumerate(_NAMES):
        own = inside(LABELS[c]) if LABELS.get(c) else None
        score = f"{hit('w', KEYWORDS[c])} * {_WEIGHT.get(c, 2.0)}::DOUBLE"
        first = str(4 + k)
        if own:
            score += f" + CASE WHEN t IN {own} THEN 8 ELSE 0 END" + "".join(f" + CASE WHEN l{i} IN {own} THEN 5 ELSE 0 END" for i in (1, 2, 3))
            first = f"CASE WHEN t IN {own} THEN 0 WHEN l1 IN {own} THEN 1 WHEN l2 IN {own} THEN 2 WHEN l3 IN {own} THEN 3 ELSE {first} END"
        entries.append(f"SELECT image_id, {q(c)} AS category, {score} AS score, {first} AS first FROM texts")
    return f"""texts AS (SELECT image_id, {normal('theme_name')} AS t, {normal('theme_top_label_1')} AS l1, {normal('theme_top_label_2')} AS l2, {normal('theme_top_label_3')} AS l3,
  [x FOR x IN list_distinct(string_split({TEXT}, ' ')) IF x <> ''] AS w FROM master_gallery_images),
entries AS ({' UNION ALL '.join(entries)}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, first) AS k FROM entries WHERE score > 0),
best AS (SELECT image_id, max(CASE WHEN k = 1 THEN category END) AS category, coalesce(max(CASE WHEN k = 1 THEN score END), 0) AS top, coalesce(max(CASE WHEN k = 2 THEN score END), 0) AS second,
  coalesce(max(CASE WHEN category = 'Other / Uncertain' THEN score END), 0) AS other, coalesce(max(CASE WHEN category = 'Landscape' THEN score END), 0) AS landscape, count(k) AS n
  FROM texts LEFT JOIN ranked USING (image_id) GROUP BY image_id),
weak AS (SELECT image_id, landscape, n, second, CASE WHEN top <= 3 THEN 'Other / Uncertain' ELSE category END AS category, CASE WHEN top <= 3 THEN other ELSE top END AS top FROM best),
sure AS (SELECT *, CASE WHEN top >= 10 AND top - second >= 4 THEN 0.96 WHEN top >= 8 AND top - second >= 3 THEN 0.88 WHEN top >= 6 AND top - second >= 2 THEN 0.78 WHEN top >= 4 THEN 0.64 ELSE 0.5 END::DOUBLE AS c FROM weak),
final AS (SELECT *, CASE WHEN n = 0 THEN 0.2 WHEN category = 'Other / Uncertain' THEN least(c, 0.45) ELSE c END::DOUBLE AS confidence FROM sure)"""


def _second() -> str:
    tests = []
    for c in CATEGORIES:
        if c == "Other / Uncertain":
            continue
        hinted = [p for p, o in HINTS.items() if c in o]
        arms = [f"p IN {inside(hinted)}"] if hinted else []
        if c not in ("Wildlife", "Farm Animals"):
            arms.append(f"{hit('w', KEYWORDS[c])} >= {1 if c == 'Waterside and Harbour' else 2}")
        test = " OR ".join(f"coalesce({a}, false)" for a in arms) or "false"
        tests.append(f"CASE WHEN ({test}) AND p IS DISTINCT FROM {q(c)} THEN {q(c)} END")
    return f"""SELECT image_id, array_to_string([x FOR x IN [{', '.join(tests)}] IF x IS NOT NULL], ', ') AS secondary FROM (
  SELECT image_id, primary_master_category AS p, list_distinct(string_split({TEXT}, ' ')) AS w FROM master_gallery_images)"""


_SUSPICIOUS = f"""WITH parsed AS (SELECT image_id, primary_master_category AS c, review_flags, {CONF} AS sure, CASE WHEN json_valid(mapping_evidence) THEN mapping_evidence END AS j FROM master_gallery_images),
scores AS (SELECT *, coalesce(TRY_CAST(json_extract_string(j, nullif(c, '')) AS DOUBLE), 0) AS own, (SELECT max(TRY_CAST(json_extract_string(j, k) AS DOUBLE)) FROM (SELECT unnest(json_keys(j)) AS k)) AS best FROM parsed),
named AS (SELECT image_id, array_to_string([x FOR x IN [CASE WHEN c IS NOT NULL AND own <= 0 AND best IS NOT NULL THEN 'no_evidence_for_category' END, CASE WHEN best - own >= 2 THEN 'stronger_evidence_for_another' END,
  CASE WHEN sure < 0.7 AND coalesce(review_flags, '') = '' AND c <> 'Other / Uncertain' THEN 'low_confidence_without_flag' END] IF x IS NOT NULL], ', ') AS reasons FROM scores),
suspicious AS (SELECT * FROM named WHERE reasons <> '')"""



def _category() -> str:
    arms = []
    for category, how, words in PROMPT_CATEGORIES:
        test = " OR ".join(f"contains(n, {q(w)})" for w in words) if how == "parts" else f"len(list_intersect(w, {listed(words)})) > 0"
        arms.append(f"WHEN {test} THEN {q(category)}")
    return f"CASE {' '.join(arms)} ELSE 'Other / Uncertain' END"


def _greedy(bits: int) -> str:
    """A pass over the photos that are near a later one, in their order, with the list of all that are dropped."""
    return f"""firsts AS (SELECT phash, min(photo_id) AS photo_id FROM photo_info WHERE len(phash) = 4 GROUP BY phash),
edges AS MATERIALIZED (SELECT a.photo_id AS early, b.photo_id AS late FROM firsts a JOIN firsts b ON a.photo_id < b.photo_id AND {far('a.phash', 'b.phash')} <= {bits}),
steps AS MATERIALIZED (SELECT early, list(late) AS lates, row_number() OVER (ORDER BY early) AS k FROM edges GROUP BY early),
walk AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS dropped UNION ALL
  SELECT s.k, CASE WHEN list_contains(dropped, early) THEN dropped ELSE list_concat(dropped, lates) END FROM walk w JOIN steps s ON s.k = w.k + 1),
picked AS (SELECT photo_id FROM firsts WHERE photo_id NOT IN (SELECT unnest(dropped) FROM walk WHERE k = (SELECT max(k) FROM walk)))"""


# --- scores ---------------------------------------------------------------------------------------------------------


def share(a: int, b: int) -> str:
    return f"(1 / (1 + exp({dot('embedding', f'p[{b + 1}]')} - {dot('embedding', f'p[{a + 1}]')})))"


_VECTORS = "vectors AS (SELECT vec_id, embedding, (SELECT list(embedding ORDER BY vec_id) FROM embeddings WHERE vec_id < 24) AS p FROM embeddings)"
_SIGNALS = [*scoring.POSITIVE, *scoring.PENALTY]
_STOCK = f"{_VECTORS}, signals AS (SELECT vec_id, {', '.join(f'{share(i, i + 12)} AS {n}' for i, n in enumerate(_SIGNALS))} FROM vectors)"


def _sum(weights: dict[str, float]) -> str:
    return " + ".join(f"{c} * {w}::DOUBLE" for c, w in weights.items())


def _mode(mode: str) -> str:
    pairs = {c: share(a, b) for c, (a, b) in scoring.MODES[mode].items()}
    weights = scoring.MODE_WEIGHTS.get(mode)
    if weights:
        return " + ".join(f"{pairs[c]} * {w}::DOUBLE" for c, w in weights.items())
    return f"({' + '.join(pairs.values())}) / {len(pairs)}"


_SCORED = f"""{_STOCK}, scored AS (SELECT *, greatest(0, least(1, ({_sum(scoring.POSITIVE)}) * 0.78::DOUBLE + (1 - ({_sum(scoring.PENALTY)})) * 0.22::DOUBLE)) AS s FROM signals)"""


def _notes() -> str:
    cases = []
    for c, high, good, low, bad in scoring.NOTES:
        cases.append(f"CASE WHEN {c} >= {high}::DOUBLE THEN {q(good)}" + (f" WHEN {c} < {low}::DOUBLE THEN {q(bad)}" if bad else "") + " END")
    return f"coalesce(nullif(array_to_string([x FOR x IN [{', '.join(cases)}] IF x IS NOT NULL], '; '), ''), 'mixed stock signals')"


# --- review and evaluation ------------------------------------------------------------------------------------------

_REVIEW = f"""rows_ AS (SELECT * REPLACE (coalesce({CONF}, 0) AS mapping_confidence, coalesce(nullif(year, ''), 'Unknown') AS year), {REVIEW_ID} AS review_id FROM master_gallery_images)"""
_EVAL = """both_ AS (SELECT gold_id, image_id, correct_category, primary_master_category AS predicted_category FROM gold_labels_v1 g LEFT JOIN master_gallery_images m
  ON trim(m.path) = trim(coalesce(g.path, ''))),
ev AS (SELECT *, predicted_category IS NOT NULL AS is_matched, coalesce(correct_category = predicted_category, false) AS is_correct FROM both_)"""
_COUNTS = "count(*) AS n, count(CASE WHEN mapping_confidence < 0.7 THEN 1 END) AS low_confidence_count, count(CASE WHEN trim(coalesce(review_flags, '')) <> '' THEN 1 END) AS review_flag_count FROM rows_"

SQL = {
    "search_topk": f"WITH {_SCORES}, {found(20)} SELECT * FROM found",
    "search_min_score": f"WITH {_SCORES}, {found(200, 'score >= 0.2')} SELECT * FROM found",
    "search_counts": f"WITH {_SCORES}, {found(200, 'score >= 0.2')} SELECT query_id, count(*) AS n_found FROM found GROUP BY query_id",
    "search_score_columns": f"WITH {_SCORES}, {found(20)} SELECT *, {', '.join(f'CASE WHEN query_id = {20 * i} THEN score END AS score_q{i}' for i in range(5))} FROM found",
    "search_prompts": f"SELECT DISTINCT theme_name AS query, coalesce(CASE lower(trim(theme_name)) {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in CONDITION_PROMPTS.items())} END, 'a photograph of ' || trim(theme_name)) AS prompt, {slug('theme_name', '_', 'query', None)} AS slug FROM master_gallery_images",
    "embedding_todo": f"WITH files AS (SELECT photo_id, batch_id, {place_sql('path')} AS place, coalesce(size, -1) AS size, date_trunc('second', mtime) AS mtime FROM photo_info) SELECT photo_id FROM files f WHERE batch_id > 0 AND NOT EXISTS (SELECT 1 FROM files c WHERE c.batch_id = 0 AND c.place = f.place AND c.size = f.size AND c.mtime = f.mtime)",
    "cluster_centroids": f"WITH {_CENTRES} SELECT label, n, [round(x, 4) + 0.0::DOUBLE FOR x IN centroid] AS centroid FROM centres JOIN sizes USING (label)",
    "cluster_top_prompts": f"WITH {_CENTRES}, {_PROMPT_SCORES} SELECT label, rank, prompt_id, score FROM ranked WHERE rank <= 3",
    "cluster_representatives": f"WITH {_CENTRES}, {_REPS} SELECT * FROM reps WHERE rank <= 3",
    "cluster_misc_merge": "SELECT vec_id, label, CASE WHEN count(*) OVER (PARTITION BY label) < 50 THEN (SELECT max(label) + 1 FROM embeddings) ELSE label END AS theme_cluster FROM embeddings",
    "theme_table": _THEMES,
    "prompt_label_clean": f"SELECT i - 1 AS prompt_id, {prompt('p')} AS label, {normal('p')} AS normal FROM (SELECT unnest({listed(PROMPTS)}) AS p, generate_subscripts({listed(PROMPTS)}, 1) AS i)",
    "dominant_folder": f"SELECT year, cluster_id, folder, n FROM (SELECT *, row_number() OVER (PARTITION BY year, cluster_id ORDER BY n DESC, first) AS k FROM (SELECT year, cluster_id, {folder("coalesce(relative_path, '')")} AS folder, count(*) AS n, min(image_id) AS first FROM master_gallery_images GROUP BY ALL)) WHERE k = 1",
    "exact_duplicates": f"WITH {_PHOTOS} SELECT group_id, CASE WHEN photo_id = keeper_id THEN 'yes' ELSE 'no' END AS keeper, photo_id, relpath, size, width, height, taken AS capture_time FROM exact_groups JOIN ({keepers('exact_groups')}) USING (group_id) JOIN photos USING (photo_id)",
    "exact_keepers": f"WITH {_PHOTOS} {keepers('exact_groups')}",
    "near_pairs_time_window": f"WITH {_PHOTOS}, {_TIME_CLASS}, {_TIME_PAIRS} SELECT * FROM time_pairs",
    "near_pairs_same_key": f"WITH {_PHOTOS}, {_STEM_CLASS}, {_STEM_PAIRS} SELECT * FROM stem_pairs",
    "near_components": f"WITH RECURSIVE {_NEAR} SELECT * FROM near_all",
    "near_minus_exact": f"WITH RECURSIVE {_NEAR} SELECT * FROM near_groups",
    "gallery_excludes": f"WITH RECURSIVE {_NEAR} SELECT * FROM excluded",
    "dedupe_summary": f"WITH RECURSIVE {_NEAR} SELECT (SELECT count(*) FROM photos) AS photo_count, (SELECT count(DISTINCT group_id) FROM exact_groups) AS exact_group_count, (SELECT count(DISTINCT group_id) FROM near_groups) AS near_group_count, (SELECT count(*) FROM excluded) AS excluded_count, 8 AS seconds_window, 6 AS phash_threshold",
    "exclude_anti_join": f"WITH RECURSIVE {_NEAR} SELECT photo_id FROM photos WHERE relpath NOT IN (SELECT relpath FROM excluded)",
    "scan_predicates": rf"SELECT {suffix('path')} AS suffix, CASE WHEN {suffix('path')} IN {inside(RAW)} THEN 'raw' WHEN {suffix('path')} IN {inside((*RENDERED, *OTHER_IMAGES))} THEN 'image' ELSE 'other' END AS kind, starts_with({base('path')}, '.') OR regexp_matches(lower(path), 'metadata|preview|thumbnail|sidecar') AS ignored, count(*) AS n, count(DISTINCT {stem('path')}) AS n_stems, sum({name_score('path')})::BIGINT AS name_score FROM photo_info GROUP BY ALL",
    "normalize_text": f"SELECT image_id, {normal('display_theme_name')} AS theme, {normal('archive_relative_path')} AS path FROM master_gallery_images",
    "token_hits": f"SELECT image_id, len([x FOR x IN w IF x <> '']) AS n_words, {', '.join(f'{hit('w', k)} AS ' + '_'.join(''.join(ch if ch.isalnum() else ' ' for ch in c.lower()).split()) for c, k in KEYWORDS.items())} FROM (SELECT image_id, list_distinct(string_split({TEXT}, ' ')) AS w FROM master_gallery_images)",
    "display_theme_names": f"SELECT image_id, array_to_string([x FOR x IN [a, CASE WHEN b <> a AND b NOT IN {inside(WEAK_SECONDS)} THEN b END, CASE WHEN f NOT IN ('', '.') THEN f END, CASE WHEN cluster_id BETWEEN 0 AND 9 THEN '0' ELSE '' END || cluster_id] IF x IS NOT NULL], ' • ') AS name FROM (SELECT image_id, cluster_id, {prompt('theme_top_label_1')} AS a, {prompt('theme_top_label_2')} AS b, {folder("coalesce(relative_path, '')")} AS f FROM master_gallery_images WHERE cluster_id IS NOT NULL)",
    "text_ids": f"SELECT image_id, {REVIEW_ID} AS review_id, {slug('theme_name', '-', 'model', 12)} AS slug, 'clip-' || {slug('theme_name', '-', 'model', 80)} || '-' || substr(sha1('clip|' || theme_name), 1, 10) AS cache_key, len([x FOR x IN string_split(coalesce(review_flags, ''), ',') IF trim(x) <> '']) AS n_flags FROM master_gallery_images",
    "evidence_ranking": f"WITH {_evidence()} SELECT image_id, coalesce(category, 'Other / Uncertain') AS category, confidence, CASE WHEN confidence < 0.7 THEN 'low_mapping_confidence' ELSE '' END AS flags, landscape::DOUBLE AS landscape, n AS n_evidence FROM final",
    "secondary_categories": _second(),
    "evidence_lookup": "SELECT image_id, coalesce(TRY_CAST(json_extract_string(j, c) AS DOUBLE), 0) AS score FROM (SELECT image_id, CASE WHEN json_valid(mapping_evidence) THEN mapping_evidence END AS j, nullif(primary_master_category, '') AS c FROM master_gallery_images)",
    "suspicious_mappings": f"{_SUSPICIOUS} SELECT * FROM suspicious",
    "suspicion_counts": f"{_SUSPICIOUS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ', ')) AS reason FROM suspicious) GROUP BY reason ORDER BY n DESC, reason LIMIT 12",
    "coastal_candidates": f"SELECT image_id, {hit('w', RURAL_WORDS)} > 0 AS has_rural_terms FROM (SELECT image_id, list_distinct(string_split({TEXT}, ' ')) AS w FROM master_gallery_images WHERE primary_master_category = 'Landscape') WHERE {hit('w', COASTAL_WORDS)} > 0",
    "category_summary": """WITH own AS (SELECT * FROM master_gallery_images WHERE primary_master_category IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY primary_master_category ORDER BY n DESC, first) AS k FROM (SELECT primary_master_category, coalesce(theme_name, '') AS theme, count(*) AS n, min(image_id) AS first FROM own GROUP BY ALL)),
e AS (SELECT primary_master_category, coalesce(archive_relative_path, path, '') AS v, row_number() OVER (PARTITION BY primary_master_category ORDER BY image_id) AS k FROM own)
SELECT primary_master_category AS master_category, count(*) AS image_count, coalesce(string_agg(DISTINCT year, ', ' ORDER BY year), '') AS years_present,
  (SELECT string_agg(theme || ': ' || n, '; ' ORDER BY k) FROM t WHERE t.primary_master_category = own.primary_master_category AND k <= 5) AS top_source_themes,
  (SELECT string_agg(v, '; ' ORDER BY k) FROM e WHERE e.primary_master_category = own.primary_master_category AND k <= 5) AS example_images FROM own GROUP BY primary_master_category""",
    "mapping_diagnostics": f"SELECT {normal('theme_name')} AS raw_theme, {', '.join(f'{normal(f"theme_top_label_{i}")} AS top_label_{i}' for i in (1, 2, 3))}, primary_master_category AS assigned_master_category, count(*) AS image_count, round_even(avg({CONF}), 3) AS avg_confidence, round_even(min({CONF}), 3) AS min_confidence, round_even(max({CONF}), 3) AS max_confidence, count(CASE WHEN coalesce(review_flags, '') <> '' THEN 1 END) AS review_flag_count FROM master_gallery_images GROUP BY ALL",
    "mapping_diagnostics_whole": f"SELECT {normal('theme_name')} AS raw_theme, {', '.join(f'{normal(f"theme_top_label_{i}")} AS top_label_{i}' for i in (1, 2, 3))}, primary_master_category AS assigned_master_category, count(*) AS image_count, round_even(avg({CONF}), 3) AS avg_confidence, round_even(min({CONF}), 3) AS min_confidence, round_even(max({CONF}), 3) AS max_confidence, count(CASE WHEN coalesce(review_flags, '') <> '' THEN 1 END) AS review_flag_count, list(coalesce(archive_relative_path, path) ORDER BY image_id)[1:8] AS example_images FROM master_gallery_images GROUP BY ALL",
    "theme_matrix": f"SELECT raw_theme, {', '.join(f'coalesce(sum(n) FILTER (c = {q(c)}), 0)::BIGINT AS "{c}"' for c in CATEGORIES)}, coalesce(string_agg(c || ': ' || n, '; ' ORDER BY c) FILTER (c NOT IN {inside(CATEGORIES)}), '') AS extras, sum(n)::BIGINT AS total FROM (SELECT {normal('theme_name')} AS raw_theme, primary_master_category AS c, count(file) AS n FROM master_gallery_images WHERE primary_master_category IS NOT NULL GROUP BY ALL) GROUP BY raw_theme HAVING sum(n) > 0",
    "category_counts": "SELECT primary_master_category, count(*) AS n FROM master_gallery_images WHERE primary_master_category IS NOT NULL GROUP BY ALL",
    "audit_sample": f"SELECT primary_master_category, rank, image_id FROM (SELECT *, row_number() OVER (PARTITION BY primary_master_category ORDER BY {CONF} NULLS LAST, display_theme_name NULLS LAST, relative_path NULLS LAST, image_id) AS rank FROM master_gallery_images WHERE primary_master_category IN {inside(CATEGORIES)}) WHERE rank <= 50",
    "gallery_metrics": f"SELECT count(*) AS total_images, round_even(avg(c), 3) AS avg_confidence, count(CASE WHEN c < 0.7 THEN 1 END) AS low_confidence_count, round_even(count(CASE WHEN c < 0.7 THEN 1 END) / greatest(count(*), 1), 3) AS low_confidence_rate, count(CASE WHEN primary_master_category = 'Other / Uncertain' THEN 1 END) AS uncertain_count, round_even(count(CASE WHEN primary_master_category = 'Other / Uncertain' THEN 1 END) / greatest(count(*), 1), 3) AS uncertain_rate FROM (SELECT *, {CONF} AS c FROM master_gallery_images)",
    "flag_reason_counts": "SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(review_flags, ', ')) AS reason FROM master_gallery_images) WHERE reason <> '' GROUP BY reason ORDER BY n DESC, reason LIMIT 12",
    "flagged_rows": "SELECT image_id, year, primary_master_category, review_flags FROM master_gallery_images WHERE review_flags <> ''",
    "union_years": "SELECT year, count(*) AS n, count(CASE WHEN year >= '2015' THEN thumb END) AS n_thumbs, count(DISTINCT theme_name) AS n_themes FROM master_gallery_images WHERE year IS NOT NULL GROUP BY year",
    "union_years_whole": "SELECT year, count(*) AS n, count(CASE WHEN coalesce(year >= '2015', true) THEN thumb END) AS n_thumbs, count(DISTINCT theme_name) AS n_themes FROM master_gallery_images GROUP BY year",
    "gold_evaluation": f"WITH {_EVAL} SELECT * FROM ev",
    "gold_accuracy": f"WITH {_EVAL} SELECT count(*) AS gold_rows, count(CASE WHEN is_matched THEN 1 END) AS matched_rows, count(CASE WHEN NOT is_matched THEN 1 END) AS unmatched_rows, count(CASE WHEN is_matched AND is_correct THEN 1 END) AS correct_rows, round_even(CASE WHEN count(CASE WHEN is_matched THEN 1 END) > 0 THEN count(CASE WHEN is_matched AND is_correct THEN 1 END) / count(CASE WHEN is_matched THEN 1 END) ELSE 0 END, 6) AS accuracy FROM ev",
    "gold_confusion": f"WITH {_EVAL} SELECT CASE WHEN grouping(correct_category) = 1 THEN 'All' ELSE correct_category END AS correct_category, CASE WHEN grouping(predicted_category) = 1 THEN 'All' ELSE predicted_category END AS predicted_category, count(*) AS n FROM ev WHERE is_matched AND correct_category IS NOT NULL GROUP BY CUBE (correct_category, predicted_category)",
    "gold_errors": f"WITH {_EVAL} SELECT correct_category, predicted_category, count(*) AS n FROM ev WHERE is_matched AND NOT is_correct GROUP BY ALL ORDER BY n DESC, correct_category NULLS FIRST, predicted_category NULLS FIRST LIMIT 12",
    "review_queue": f"WITH {_REVIEW} SELECT image_id, review_id, review_bucket, review_priority, year, mapping_confidence, coalesce(review_flags, '') AS review_flags FROM rows_",
    "review_page": f"WITH {_REVIEW} SELECT review_bucket, year, card, image_id FROM (SELECT *, row_number() OVER (PARTITION BY review_bucket, year ORDER BY review_priority DESC NULLS LAST, mapping_confidence DESC, archive_relative_path NULLS LAST, image_id) AS card FROM rows_) WHERE card <= 20",
    "review_page_whole": f"WITH {_REVIEW} SELECT review_bucket, year, card, image_id FROM (SELECT *, row_number() OVER (PARTITION BY review_bucket, year ORDER BY review_priority DESC NULLS LAST, mapping_confidence DESC, archive_relative_path NULLS LAST, image_id) AS card FROM rows_) WHERE card <= 500",
    "review_metrics": f"WITH {_REVIEW} SELECT 'bucket' AS kind, review_bucket AS value, {_COUNTS} GROUP BY review_bucket UNION ALL SELECT 'year', year, {_COUNTS} GROUP BY year UNION ALL SELECT 'category', primary_master_category, {_COUNTS} GROUP BY primary_master_category UNION ALL SELECT 'all', NULL, {_COUNTS}",
    "review_kept": "SELECT image_id FROM master_gallery_images WHERE path IN (SELECT path FROM (SELECT path, row_number() OVER (PARTITION BY path ORDER BY consolidated_at DESC, CASE WHEN starts_with(review_bucket, '01') THEN 'keep' ELSE 'maybe' END DESC) AS k, starts_with(review_bucket, '01') AS best FROM master_gallery_images WHERE path IS NOT NULL) WHERE k = 1 AND best)",
    "pair_softmax_scores": f"WITH {_VECTORS} SELECT vec_id, {', '.join(f'round_even({_mode(m)}, 4) AS "{m}"' for m in scoring.MODES)} FROM vectors",
    "stock_score": f"WITH {_SCORED} SELECT vec_id, round_even(s, 4) AS score, round_even(technical_quality, 4) AS technical_quality, round_even(clutter_penalty, 4) AS clutter_penalty FROM scored WHERE s >= 0.35",
    "stock_reason": f"WITH {_STOCK}, stretched AS (SELECT vec_id, {', '.join(f'round(0.5 + 4 * ({n} - 0.5), 6) AS {n}' for n in _SIGNALS)} FROM signals) SELECT vec_id, {_notes()} AS reason FROM stretched",
    "top_scores": f"WITH {_SCORED} SELECT vec_id, round_even(s, 4) AS score FROM scored WHERE s >= 0.35 ORDER BY 2 DESC, 1 LIMIT 50",
    "theme_rows": f"WITH themes AS ({_THEMES}) SELECT theme_cluster, vec_id, label, theme_name, display_theme_name, top_label_1, top_label_2, top_label_3 FROM embeddings JOIN themes ON theme_cluster = label",
    "exact_groups_numbered": f"WITH {_PHOTOS} SELECT dense_rank() OVER (ORDER BY group_id) AS number, group_id, CASE WHEN photo_id = keeper_id THEN 'yes' ELSE 'no' END AS keeper, photo_id, relpath FROM exact_groups JOIN ({keepers('exact_groups')}) USING (group_id) JOIN photos USING (photo_id)",
    "inclusion_counts": f"SELECT batch_id, count(*) AS candidate_count, count(CASE WHEN width > 0 AND height > 0 THEN 1 END) AS included_count, count(*) - count(CASE WHEN width > 0 AND height > 0 THEN 1 END) AS excluded_count FROM photo_info WHERE {suffix('path')} IN {inside((*RAW, *RENDERED, *OTHER_IMAGES))} GROUP BY batch_id",
    "prompt_categories": f"SELECT text, {_category()} AS category FROM (SELECT text, {normal('text')} AS n, string_split({normal('text')}, ' ') AS w FROM (SELECT theme_name AS text FROM master_gallery_images UNION SELECT theme_top_label_1 FROM master_gallery_images UNION SELECT theme_top_label_2 FROM master_gallery_images UNION SELECT theme_top_label_3 FROM master_gallery_images UNION SELECT unnest({listed(PROMPTS)})) WHERE text IS NOT NULL)",
    "review_text": f"SELECT image_id, text, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '{chr(34)}', '&quot;'), '{chr(39) * 2}', '&#x27;') AS html, length(replace(to_json(text)::VARCHAR, '</', '<_/')) AS json_length FROM (SELECT image_id, array_to_string([x FOR x IN [{', '.join(c for c in REVIEW_FIELDS if 'folder' not in c)}] IF trim(x) <> ''], ' | ') AS text FROM master_gallery_images)",
    "review_defaults": f"SELECT image_id, 0.5::DOUBLE AS mapping_confidence, 'Other / Uncertain' AS primary_master_category, '' AS review_flags, path AS archive_relative_path, theme_name AS display_theme_name, 'Unknown' AS year, {base("coalesce(path, '')")} AS file FROM master_gallery_images",
    "top_scores_all_keys": f"WITH {_SCORED} SELECT vec_id, round_even(s, 2) AS score, round_even(technical_quality, 2) AS technical_quality, round_even(commercial_usefulness, 2) AS commercial_usefulness FROM scored ORDER BY score DESC, technical_quality DESC, commercial_usefulness DESC, vec_id LIMIT 50",
    "greedy_unique": f"WITH RECURSIVE {_greedy(5)} SELECT photo_id FROM picked",
    "greedy_top": f"WITH RECURSIVE {_greedy(10)} SELECT photo_id FROM picked ORDER BY photo_id LIMIT 50",
}
