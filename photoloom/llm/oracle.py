"""DuckDB texts of the dealt problems' queries."""

from __future__ import annotations

from photoloom.functions.sql import category_sql, content_sql, place_sql

_SHA_GROUPS = f"""
WITH photos AS (SELECT *, {content_sql('sha256')} AS content FROM photo_info),
shared AS (SELECT * FROM photos WHERE content IN (SELECT content FROM photos GROUP BY content HAVING count(*) > 1)),
groups AS (SELECT content, min(photo_id) AS group_id, count(*) AS n_rows FROM shared GROUP BY content),
dims AS (SELECT content, photo_id, width, height FROM (SELECT *, row_number() OVER (PARTITION BY content
  ORDER BY width::BIGINT * height DESC, scanned_at DESC NULLS LAST, photo_id) AS k FROM shared WHERE width > 0 AND height > 0) WHERE k = 1),
sizes AS (SELECT content, photo_id, size FROM (SELECT *, row_number() OVER (PARTITION BY content
  ORDER BY scanned_at DESC NULLS LAST, photo_id) AS k FROM shared WHERE size > 0) WHERE k = 1),
times AS (SELECT content, photo_id, capture_time FROM (SELECT *, row_number() OVER (PARTITION BY content
  ORDER BY capture_time, photo_id) AS k FROM shared
  WHERE capture_time >= '2004-01-01' AND coalesce(capture_time <= scanned_at, true) AND capture_time IS DISTINCT FROM mtime) WHERE k = 1)
"""

SQL = {
    "p1_found": f"""
SELECT image_id FROM (
  SELECT image_id, row_number() OVER (PARTITION BY category, year, cluster_id
    ORDER BY review_priority DESC NULLS LAST, confidence DESC NULLS LAST, image_id) AS k
  FROM (SELECT *, {category_sql('primary_master_category')} AS category,
    CASE WHEN NOT isnan(mapping_confidence) THEN mapping_confidence END AS confidence FROM master_gallery_images)
  WHERE category IS NOT NULL AND year IS NOT NULL AND cluster_id IS NOT NULL)
WHERE k <= 3""",
    "p3_found": _SHA_GROUPS
    + """
SELECT group_id AS group_photo_id, coalesce(d.photo_id, -1) AS dims_photo_id, coalesce(s.photo_id, -1) AS size_photo_id, coalesce(t.photo_id, -1) AS time_photo_id
FROM groups LEFT JOIN dims d USING (content) LEFT JOIN sizes s USING (content) LEFT JOIN times t USING (content)""",
    "p3_best": _SHA_GROUPS
    + """
SELECT content AS group_key, group_id, n_rows, coalesce(d.photo_id, -1) AS dims_id, width, height, coalesce(s.photo_id, -1) AS size_id, size,
  coalesce(t.photo_id, -1) AS time_id, capture_time
FROM groups LEFT JOIN dims d USING (content) LEFT JOIN sizes s USING (content) LEFT JOIN times t USING (content)""",
    "p4_found": f"""
WITH photos AS (SELECT photo_id, batch_id, {content_sql('sha256')} AS content, {place_sql('relpath')} AS place,
    CASE WHEN len(phash) = 4 AND (phash[1] <> 0 OR phash[2] <> 0 OR phash[3] <> 0 OR phash[4] <> 0) THEN phash END AS h FROM photo_info),
hashes AS (SELECT batch_id, h, h[1] AS a, h[2] AS b, h[3] AS c, h[4] AS d, min(photo_id) AS photo_id FROM photos WHERE h IS NOT NULL GROUP BY ALL),
near AS (SELECT n.batch_id, n.h, min(o.photo_id) AS first FROM hashes n JOIN hashes o
  ON o.batch_id < n.batch_id AND bit_count(xor(n.a, o.a))::INT + bit_count(xor(n.b, o.b))::INT + bit_count(xor(n.c, o.c))::INT + bit_count(xor(n.d, o.d))::INT <= 6 GROUP BY ALL),
firsts AS (
  SELECT n.photo_id, min(o.photo_id) AS first FROM photos n JOIN photos o ON o.content = n.content AND o.batch_id < n.batch_id GROUP BY ALL
  UNION ALL SELECT n.photo_id, min(o.photo_id) FROM photos n JOIN photos o ON o.place = n.place AND o.batch_id < n.batch_id GROUP BY ALL
  UNION ALL SELECT p.photo_id, near.first FROM photos p JOIN near ON near.h = p.h AND near.batch_id = p.batch_id)
SELECT min(first) AS first_photo_id, photo_id FROM firsts GROUP BY photo_id""",
    "p6_found": f"""
WITH RECURSIVE photos AS (SELECT photo_id, {place_sql('path')} AS place FROM photo_info),
places AS (SELECT place, min(photo_id) AS v FROM photos WHERE place IS NOT NULL GROUP BY place),
links AS (SELECT a.v AS u, b.v AS v FROM (SELECT {place_sql('path_a')} AS pa, {place_sql('path_b')} AS pb FROM photo_matches WHERE is_match)
  JOIN places a ON a.place = pa JOIN places b ON b.place = pb WHERE a.v <> b.v),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u AS vertex, u AS root FROM both_ways UNION SELECT e.v, r.root FROM reach r JOIN both_ways e ON e.u = r.vertex WHERE r.root < e.v),
comp AS (SELECT vertex, min(root) AS group_id FROM reach GROUP BY vertex)
SELECT group_id, photo_id FROM photos JOIN places USING (place) JOIN comp ON comp.vertex = places.v""",
}
