"""The workload in plain SQL, for comparison on another engine over the same tables."""

from __future__ import annotations

from shelfmark.plans.standins import EMPTY_EVERY, SHORTEST, THRESHOLD
from shelfmark.plans.workload import IMAGE_ID, VOWEL_THRESHOLD

ASSET = """
asset AS (
  SELECT doc_id AS image_id,
         '/' || source || '/' || lang || '/' || doc_id || '.TXT' AS file_location,
         n_chars::INTEGER AS width,
         len(string_split(text, chr(10)))::INTEGER AS height,
         'txt' AS file_type,
         sha256(text) AS hash,
         octet_length(encode(text))::BIGINT AS file_size
  FROM documents)"""

LABEL = "label AS (SELECT doc_id AS image_id, quality, toxic FROM labels)"

REGISTERED = f"""{ASSET}, {LABEL},
known AS (
  SELECT * REPLACE (row_number() OVER (ORDER BY hash) AS image_id) FROM (
    SELECT * FROM asset WHERE image_id IN (SELECT image_id FROM label)
    QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1))"""

VOCAB = """
vocab AS (
  SELECT p_partkey AS idx, p_name || ' ' || p_partkey AS tag,
         CASE WHEN p_type = 'ECONOMY' THEN 'rating' WHEN p_type = 'STANDARD' THEN 'copyright'
              WHEN p_type = 'PROMO' THEN 'character' WHEN p_type = 'SMALL' THEN 'artist'
              WHEN p_type = 'MEDIUM' THEN 'general'
              WHEN p_type = 'LARGE' AND p_size > 25 THEN 'meta' ELSE 'unknown' END AS category
  FROM part)"""


def _tags(name: str, threshold: float) -> str:
    return f"""
{name} AS (
  SELECT c.vec_id AS image_id, category, tag, c.v::DOUBLE AS score, c.idx
  FROM (SELECT vec_id, unnest(embedding) AS v,
               (generate_subscripts(embedding, 1) - 1)::INTEGER AS idx FROM embeddings) c
  JOIN vocab ON vocab.idx = c.idx
  WHERE NOT isnan(c.v) AND c.v >= {threshold}::FLOAT)"""


TAGS = VOCAB + "," + _tags("tags", THRESHOLD)

OUTCOME = f"""{TAGS},
counted AS (SELECT image_id, count(*) AS n FROM tags GROUP BY image_id),
outcome AS (
  SELECT d.doc_id AS image_id, coalesce(n, 0)::BIGINT AS n_tags,
         CASE WHEN e.vec_id IS NULL THEN 'failure' WHEN n IS NULL THEN 'empty'
              ELSE 'success' END AS outcome
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN counted c ON c.image_id = d.doc_id)"""

FRESH = f"""{REGISTERED},
fresh AS (
  SELECT * FROM asset WHERE hash NOT IN (SELECT hash FROM known)
  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1)"""

IMAGE_FILE = """
sized AS (
  SELECT *, len(string_split(text, chr(10))) AS lines, printf('%08X', n_chars) AS w8,
         printf('%08X', len(string_split(text, chr(10)))) AS h8 FROM documents),
headed AS (
  SELECT *, CASE lang
    WHEN 'en' THEN '89504E470D0A1A0A0000000D49484452' || w8 || h8
    WHEN 'fr' THEN '424D00000000000000000000000028000000'
      || w8[7:8] || w8[5:6] || w8[3:4] || w8[1:2] || h8[7:8] || h8[5:6] || h8[3:4] || h8[1:2]
    WHEN 'de' THEN 'FFD8FFE000040000FFC0001108'
      || printf('%04X', least(lines, 65535)) || printf('%04X', least(n_chars, 65535))
    ELSE '' END AS header FROM sized),
file AS (
  SELECT text, header, 'file:/' || source || '/' || lang || '/' || doc_id || '.Png' AS path,
         '/' || source || '/' || lang || '/' || doc_id || '.Png' AS file_location,
         CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN least(n_chars, 65535)
                   ELSE n_chars END::INTEGER AS width,
         CASE lang WHEN 'es' THEN NULL WHEN 'de' THEN least(lines, 65535)
                   ELSE lines END::INTEGER AS height,
         'png' AS file_type,
         sha256(unhex(header) || encode(text)) AS hash,
         (octet_length(unhex(header)) + octet_length(encode(text)))::BIGINT AS file_size,
         CASE lang WHEN 'es' THEN 'unsupported' ELSE 'ok' END AS status
  FROM headed)"""

LISTED = """
listed AS (SELECT *, regexp_extract(file_location, '([0-9]+)[.]Png$', 1)::BIGINT AS id FROM file)"""


def _registered(files: str) -> str:
    return f"""WITH {IMAGE_FILE}, {LISTED}, {VOCAB},
kept AS (SELECT * FROM listed WHERE status = 'ok' AND {files}
         QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1),
letter AS (
  SELECT k.hash, l.idx,
         ((len(text) - len(replace(text, l.letter, ''))
           + len(list_filter(range(0, len(header) // 2),
                             lambda i: header[2 * i + 1 : 2 * i + 2] = l.code)))::DOUBLE
          / file_size)::FLOAT AS v
  FROM kept k, (VALUES (0, 'a', '61'), (1, 'e', '65'), (2, 'i', '69'), (3, 'o', '6F'),
                       (4, 'u', '75')) l(idx, letter, code)
  WHERE file_size >= {SHORTEST}),
hit AS (SELECT hash, category, tag, v::DOUBLE AS score FROM letter JOIN vocab USING (idx)
        WHERE v >= {VOWEL_THRESHOLD}::FLOAT),
stored AS (SELECT *, row_number() OVER (ORDER BY hash) AS image_id FROM kept
           WHERE hash IN (SELECT hash FROM hit))
SELECT image_id, category, tag, score, FALSE AS archived, file_location, width, height, hash
FROM stored JOIN hit USING (hash)"""


REGISTERED_FILES = _registered("TRUE")

ORACLE: dict[str, str] = {
    "asset_metadata": f"WITH {ASSET} SELECT * FROM asset",
    "asset_geometry": f"""WITH {ASSET}
        SELECT image_id, width::DOUBLE / height AS aspect_ratio,
               width::BIGINT * height AS total_pixels FROM asset""",
    "validate_assets": """
        SELECT doc_id AS image_id,
               CASE WHEN lang = 'es' THEN 'location' WHEN lang = 'fr' THEN 'hash'
                    WHEN n_chars - 7 <= 0 THEN 'size' ELSE 'ok' END AS validity
        FROM documents""",
    "probe_dimensions": f"""WITH {IMAGE_FILE}
        SELECT path, width::BIGINT AS width, height::BIGINT AS height FROM file""",
    "extract_metadata": f"""WITH {IMAGE_FILE}
        SELECT path, file_location, width, height, file_type, hash, file_size, status FROM file""",
    "extraction_status": f"""WITH {IMAGE_FILE}
        SELECT file_location, status FROM file WHERE status <> 'ok'""",
    "list_files": f"""WITH {IMAGE_FILE}, {LISTED}
        SELECT regexp_replace(file_location, '[0-9]+[.]Png$', '')
                 || CASE id % 5 WHEN 0 THEN '_' WHEN 1 THEN '.' ELSE '' END || id || '.Png' AS location,
               CASE WHEN id % {EMPTY_EVERY} = 0 THEN 0 ELSE file_size END AS length FROM listed""",
    "vocab_from_json": """
        SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS idx, 'k' AS tag,
               CASE event_type WHEN 'error' THEN 'unknown' ELSE event_type END AS category
        FROM events""",
    "dedup_against_registry": f"""WITH {REGISTERED}
        SELECT image_id, hash FROM asset WHERE hash NOT IN (SELECT hash FROM known)""",
    "dedup_buckets": f"""WITH {REGISTERED}
        SELECT image_id, hash FROM asset WHERE hash NOT IN (SELECT hash FROM known)""",
    "dedup_in_batch": f"""WITH {ASSET}
        SELECT image_id, hash, file_location FROM asset
        QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1""",
    "duplicate_hash_report": f"""WITH {ASSET}
        SELECT hash, count(*) AS copies FROM asset GROUP BY hash HAVING count(*) > 1""",
    "find_by_hashes": f"""WITH {ASSET}, {LABEL}
        SELECT image_id, file_location, hash FROM asset
        WHERE hash IN (SELECT hash FROM asset JOIN label USING (image_id) WHERE toxic = 1)""",
    "tag_decode": f"WITH {TAGS} SELECT * FROM tags",
    "tag_rank": f"""WITH {TAGS}
        SELECT *, row_number() OVER (PARTITION BY image_id, category
                                     ORDER BY score DESC, idx)::INTEGER AS rank FROM tags""",
    "tag_top1": f"""WITH {TAGS}
        SELECT image_id, category, tag, score FROM tags
        QUALIFY row_number() OVER (PARTITION BY image_id, category ORDER BY score DESC, idx) = 1""",
    "tag_allowed": f"""WITH {TAGS}
        SELECT image_id, category, tag, score FROM tags
        WHERE category IN ('rating', 'copyright', 'character', 'artist', 'general')""",
    "tag_nested": f"""WITH {TAGS}
        SELECT image_id, category, string_agg(tag, '|' ORDER BY score DESC, idx) AS tags,
               count(*) AS n_tags, first(tag ORDER BY score DESC, idx) AS top_tag,
               max(score) AS top_score FROM tags GROUP BY image_id, category""",
    "tag_explode": f"WITH {TAGS} SELECT image_id, category, tag, score FROM tags",
    "tagging_outcome": f"WITH {OUTCOME} SELECT * FROM outcome",
    "outcome_counts": f"""WITH {OUTCOME}
        SELECT count(*) FILTER (outcome = 'success') AS success,
               count(*) FILTER (outcome = 'failure') AS failure,
               count(*) FILTER (outcome = 'empty') AS empty,
               count(*) AS total, bool_or(outcome = 'success') AS any_success FROM outcome""",
    "orphan_tags": f"""WITH {TAGS}
        SELECT image_id, count(*) AS children FROM tags
        WHERE image_id NOT IN (SELECT doc_id FROM labels) GROUP BY image_id""",
    "assign_ids": f"""WITH {ASSET}
        SELECT hash, min(file_location) AS file_location,
               row_number() OVER (ORDER BY hash) AS image_id FROM asset GROUP BY hash""",
    "insert_images": f"""WITH {FRESH}
        SELECT * REPLACE ((SELECT count(*) FROM known) + row_number() OVER (ORDER BY hash)
                          AS image_id) FROM fresh""",
    "register_flow": f"""WITH {FRESH}, {OUTCOME},
        added AS (
          SELECT f.image_id AS doc_id,
                 (SELECT count(*) FROM known) + row_number() OVER (ORDER BY hash) AS image_id
          FROM fresh f JOIN outcome o USING (image_id) WHERE outcome = 'success')
        SELECT a.image_id, category, tag, score, FALSE AS archived
        FROM added a JOIN tags t ON t.image_id = a.doc_id""",
    "upsert_tags": f"""WITH {TAGS}, {LABEL}, {_tags("low", 0.0)},
        new AS (SELECT * FROM low WHERE image_id IN (SELECT image_id FROM label))
        SELECT image_id, category, tag, score, FALSE AS archived FROM new
        UNION ALL
        SELECT image_id, category, tag, score, score > 0.25 AS archived FROM tags
        WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.image_id = tags.image_id
                          AND n.category = tags.category AND n.tag = tags.tag)""",
    "update_images": f"""WITH {ASSET}, {LABEL}
        SELECT a.image_id,
               CASE WHEN l.image_id IS NULL THEN file_location
                    ELSE '/moved/' || l.image_id || '.png' END AS file_location,
               CASE WHEN l.image_id IS NULL THEN width WHEN toxic = 0 THEN quality + 640 END AS width,
               CASE WHEN l.image_id IS NULL THEN height ELSE 480 END AS height,
               CASE WHEN l.image_id IS NULL THEN file_type ELSE 'png' END AS file_type, hash,
               CASE WHEN l.image_id IS NULL THEN file_size ELSE l.image_id + 1 END AS file_size
        FROM asset a LEFT JOIN label l ON l.image_id = a.image_id""",
    "remove_images": f"""WITH {ASSET}, {LABEL}
        SELECT image_id, file_location, hash FROM asset
        WHERE image_id NOT IN (SELECT image_id FROM label WHERE toxic = 1)""",
    "remove_tags": f"""WITH {TAGS}, {LABEL}
        SELECT l.image_id, count(t.image_id) AS removed
        FROM label l LEFT JOIN tags t ON t.image_id = l.image_id
        WHERE toxic = 1 GROUP BY l.image_id""",
    "notes_upsert": """
        SELECT doc_id AS image_id, source AS content FROM documents WHERE lang = 'fr'
        UNION ALL
        SELECT doc_id, 'quality ' || quality FROM labels
        WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
    "get_image": f"WITH {ASSET} SELECT * FROM asset WHERE image_id = {IMAGE_ID}",
    "contains_image": f"""
        SELECT count(*) > 0 AS found FROM documents WHERE doc_id = {IMAGE_ID}""",
    "tags_of_image": f"""WITH {TAGS}
        SELECT image_id, category, tag, score, FALSE AS archived FROM tags
        WHERE image_id = {IMAGE_ID}""",
    "count_images": "SELECT count(*) AS n FROM documents",
    "count_tags": f"WITH {TAGS} SELECT count(*) AS n FROM tags",
    "list_images": f"WITH {ASSET} SELECT * FROM asset ORDER BY image_id LIMIT 20",
    "list_tags": f"""WITH {TAGS}
        SELECT image_id, category, tag, score, FALSE AS archived FROM tags
        ORDER BY image_id, category, tag LIMIT 20""",
    "images_by_tag": f"""WITH {ASSET}, {TAGS}
        SELECT image_id, file_location, hash FROM asset
        WHERE image_id IN (SELECT image_id FROM tags WHERE category = 'artist')""",
    "all_tags": f"""WITH {TAGS}
        SELECT image_id, category, tag, score, FALSE AS archived, 'model' AS source FROM tags
        UNION ALL
        SELECT doc_id, 'quality', 'q' || quality, NULL, NULL, 'manual' FROM labels""",
    "active_tags": f"""WITH {TAGS}, {LABEL}
        SELECT image_id, category, tag, score FROM tags
        WHERE image_id NOT IN (SELECT image_id FROM label WHERE toxic = 1)""",
    "score_assets": f"""
        WITH sized AS (SELECT doc_id, text, octet_length(encode(text)) AS size FROM documents)
        SELECT doc_id AS image_id, l.idx,
               ((len(text) - len(replace(text, l.letter, '')))::DOUBLE / size)::FLOAT::DOUBLE AS score,
               NULL::VARCHAR AS error
        FROM sized, (VALUES (0, 'a'), (1, 'e'), (2, 'i'), (3, 'o'), (4, 'u')) l(idx, letter)
        WHERE size >= {SHORTEST}
        UNION ALL
        SELECT doc_id, NULL, NULL, 'ValueError: too short' FROM sized WHERE size < {SHORTEST}""",
    "parallel_map": """
        SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN doc_id + 9007199254740993 END AS large,
               CASE WHEN lang <> 'es' THEN len(string_split(text, ' ')) + coalesce(large % 1000, 0) END AS value,
               CASE WHEN lang = 'es' THEN 'LookupError: es' END AS error FROM documents""",
    "register_files": REGISTERED_FILES,
    "stream_register": REGISTERED_FILES,
    "stream_state": f"SELECT category, tag, score, width, height, hash FROM ({REGISTERED_FILES})",
    "stream_files": f"""SELECT category, tag, score, width, height, hash
        FROM ({_registered(f"id % {EMPTY_EVERY} <> 0")})""",
    "commit_atomic": f"""WITH {ASSET}
        SELECT row_number() OVER (ORDER BY hash) AS image_id, hash,
               'bytes ' || min(file_size) AS tag FROM asset GROUP BY hash""",
    "registry_changes": f"""WITH {ASSET},
        first AS (SELECT * FROM asset
                  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1),
        numbered AS (SELECT * REPLACE (row_number() OVER (ORDER BY hash) AS image_id) FROM first)
        SELECT image_id, file_location, CASE WHEN height < 40 THEN width END AS width, height,
               CASE WHEN height < 40 THEN file_type ELSE 'long' END AS file_type, hash, file_size
        FROM numbered WHERE height <> 1
        UNION ALL
        SELECT (SELECT count(*) FROM numbered) + row_number() OVER (ORDER BY hash),
               file_location, width, height, file_type, hash, file_size
        FROM numbered WHERE height = 1""",
    "registry_tags": f"""WITH {ASSET},
        first AS (SELECT * FROM asset
                  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1),
        numbered AS (SELECT row_number() OVER (ORDER BY hash) AS image_id, 'w' || (width % 7) AS tag FROM first),
        all_tags AS (
            SELECT image_id, 'size' AS category, tag,
                   CASE WHEN image_id % 3 = 0 THEN 0.75 ELSE (image_id % 10) / 16.0 END::DOUBLE AS score,
                   image_id % 5 = 0 AS archived FROM numbered
            UNION ALL
            SELECT image_id, 'extra', tag, 0.75::DOUBLE, FALSE FROM numbered WHERE image_id % 3 = 0)
        SELECT * FROM all_tags WHERE image_id % 7 <> 0""",
    "bucket_lookups": f"""WITH {ASSET},
        first AS (SELECT * FROM asset
                  QUALIFY row_number() OVER (PARTITION BY hash ORDER BY file_location) = 1),
        numbered AS (SELECT *, row_number() OVER (ORDER BY hash) AS number FROM first)
        SELECT number AS image_id, CASE WHEN width % 7 = 2 OR height % 3 = 0 THEN hash END AS hash,
               CASE WHEN height <= 2 THEN 2 END::BIGINT AS children FROM numbered
        WHERE width % 7 = 2 OR height % 3 = 0 OR height <= 2""",
    "registry_notes": f"""WITH {ASSET},
        numbered AS (SELECT row_number() OVER (ORDER BY hash) AS image_id, hash FROM (SELECT DISTINCT hash FROM asset))
        SELECT image_id, CASE WHEN image_id % 2 = 0 THEN 'second' ELSE 'first ' || hash END AS content,
               CASE WHEN image_id % 4 = 0 THEN TRUE END AS fourth FROM numbered""",
}
