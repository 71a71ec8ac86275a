"""DuckDB SQL of the queries in more.py."""

_BLOCKS = """blocks AS (
  SELECT user_id AS source, event_id AS k, event_id AS block_idx, (event_id // 500)::INT AS page_idx,
    CASE event_type WHEN 'view' THEN 'text' WHEN 'click' THEN 'image' WHEN 'purchase' THEN 'table' WHEN 'error' THEN 'list' WHEN 'signup' THEN 'header' END AS type,
    event_id % 11 <> 0 AS has_box, CASE WHEN event_id % 11 <> 0 THEN (event_id * 7 % 300)::DOUBLE END AS x0, CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 800)::DOUBLE END AS y0,
    CASE WHEN event_id % 11 <> 0 THEN (event_id * 7 % 300 + 200)::DOUBLE END AS x1, CASE WHEN event_id % 11 <> 0 THEN (event_id * 37 % 800 + 60)::DOUBLE END AS y1,
    'Text ' || event_id AS text, 'a' || event_id || chr(10) || chr(10) || 'b' AS list_items, CASE WHEN event_id % 3 = 0 THEN 'Cap' || event_id ELSE '' END AS table_caption,
    CASE WHEN event_id % 4 <> 0 THEN '<table>' || event_id ELSE '' END AS table_body, CASE WHEN event_id % 5 = 0 THEN 'Note' || event_id ELSE '' END AS table_footnote,
    CASE WHEN event_id % 2 = 0 THEN 'Fig ' || event_id ELSE '' END AS image_caption, CASE WHEN event_id % 6 <> 0 THEN 'img/' || event_id || '.png' ELSE '' END AS img_path,
    CASE WHEN event_id % 4 = 0 THEN 'Shows ' || event_id ELSE '' END AS description, CASE WHEN event_id % 8 = 0 THEN 'required' ELSE '' END AS policy, event_id % 9 = 0 AS icon
  FROM events
)"""
_PAIRS = f"""{_BLOCKS}, pairs AS (
  SELECT t.source, t.block_idx, m.block_idx AS master_idx
  FROM (SELECT * FROM blocks WHERE type = 'table') t ASOF JOIN (SELECT * FROM blocks WHERE type = 'table' AND table_body <> '') m ON t.source = m.source AND t.block_idx >= m.block_idx
  WHERE t.table_body = '' AND t.table_caption = '' AND t.table_footnote = '' AND t.has_box AND m.has_box
    AND CASE WHEN t.page_idx < m.page_idx THEN false WHEN t.page_idx = m.page_idx THEN t.y0 >= m.y1 ELSE t.y0 <= 180 END
)"""
_ICONS = "icons AS (SELECT source, block_idx AS icon_idx, block_idx + block_idx % 4 + 1 AS target_idx, page_idx, x0, y0, x1, y1 FROM blocks WHERE type = 'image' AND icon AND has_box)"
_STATE = "CASE WHEN icon THEN 'inline_icon' WHEN img_path = '' THEN 'no_path' WHEN description <> '' AND policy <> '' THEN 'existing' ELSE 'candidate' END"
_NOTES = """ordered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY block_idx) AS r FROM blocks),
seen AS (SELECT *, type <> 'table' OR table_footnote <> '' AS stop FROM ordered WHERE type <> 'header'),
ends AS (SELECT t.source, t.block_idx, t.x0, t.x1, t.has_box, (SELECT max(s.r) FROM seen s WHERE s.source = t.source AND s.r >= t.r AND s.r < coalesce((SELECT min(z.r) FROM seen z WHERE z.source = t.source AND z.r > t.r AND z.stop), 1000000000)) AS last_r
  FROM seen t WHERE t.type = 'table'),
lasts AS (SELECT e.*, b.page_idx, b.y1 AS top, b.block_idx AS last_idx FROM ends e JOIN ordered b ON b.source = e.source AND b.r = e.last_r WHERE e.has_box AND b.has_box),
notes AS (
  SELECT l.source, l.block_idx, l.page_idx, greatest(0.0, l.x0 - 12)::DOUBLE AS x0, l.top AS y0, least(1000.0, l.x1 + 12)::DOUBLE AS x1,
    coalesce((SELECT arg_min(n.y0, n.block_idx) FROM blocks n WHERE n.source = l.source AND n.page_idx = l.page_idx AND n.block_idx > l.last_idx AND n.type <> 'header' AND n.y0 > l.top), 1000.0)::DOUBLE AS y1
  FROM lasts l
)"""
_BODY = """members AS (
  SELECT source, block_idx AS master_idx, block_idx FROM blocks b WHERE type = 'table' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source = b.source AND p.block_idx = b.block_idx)
  UNION ALL SELECT source, master_idx, block_idx FROM pairs
),
body AS (
  SELECT m.source, m.master_idx AS block_idx, m.block_idx AS part_idx, b.page_idx, least(b.x0, coalesce(min(i.x0), b.x0)) AS x0, least(b.y0, coalesce(min(i.y0), b.y0)) AS y0,
    greatest(b.x1, coalesce(max(i.x1), b.x1)) AS x1, greatest(b.y1, coalesce(max(i.y1), b.y1)) AS y1
  FROM members m JOIN blocks b ON b.source = m.source AND b.block_idx = m.block_idx AND b.has_box
  LEFT JOIN icons i ON i.source = m.source AND i.target_idx = m.master_idx AND i.page_idx = b.page_idx
  GROUP BY m.source, m.master_idx, m.block_idx, b.page_idx, b.x0, b.y0, b.x1, b.y1
)"""
_PATCHED = """f AS (SELECT o_orderkey % 20 AS source, o_orderkey AS block_idx, 'Click ' || o_orderpriority AS text, o_orderkey % 7 = 0 AS done FROM orders),
applied AS (
  SELECT source, block_idx, CASE WHEN done THEN 'checked_before' WHEN block_idx % 5 = 0 THEN 'pending' WHEN block_idx % 8 = 3 THEN 'same' WHEN block_idx % 4 = 0 THEN 'no_missing' WHEN block_idx % 4 = 1 THEN 'only_icon' WHEN block_idx % 4 = 2 THEN 'apply' ELSE 'empty' END AS decision, text FROM f
)"""


def _stats(keys: str) -> str:
    rank = ", ".join(f"coalesce(s[ceil(n * {q})::INT], 0) AS p{int(q * 100)}_tokens" for q in (0.5, 0.9, 0.95))
    key = f"{keys}, " if keys else ""
    return f"""WITH t AS (SELECT source, (len(regexp_extract_all(coalesce(text, ''), '[\\x{{3400}}-\\x{{9fff}}]')) + ceil((length(coalesce(text, '')) - len(regexp_extract_all(coalesce(text, ''), '[\\x{{3400}}-\\x{{9fff}}]'))) / 4.0))::BIGINT AS tokens FROM documents),
      g AS (SELECT {key}count(*) AS n, list_sort(list(tokens)) AS s, round(avg(tokens), 6) AS mean_tokens, count(*) FILTER (WHERE tokens >= 475) AS n_at_budget FROM t {'GROUP BY ' + keys if keys else ''})
      SELECT {key}n AS n_contexts, s[1] AS min_tokens, {rank}, s[n] AS max_tokens, mean_tokens, n_at_budget FROM g"""


_DENSE = """dense AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id // 50 AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)
  QUALIFY rank <= 10
)"""
_ASK = """ask AS (
  SELECT doc_id, doc_id % 5 AS kind, doc_id % 40 AS page, coalesce(text, '') AS body,
    CASE doc_id % 7 WHEN 0 THEN 'Foreword' WHEN 1 THEN '' WHEN 2 THEN 'Configuring Users' WHEN 3 THEN 'Adding a Device' ELSE 'Alarm List' END AS subject
  FROM documents
)"""
_NAMED = """named AS (
  SELECT doc_id, source || '/' || ['QSG_a.pdf', 'Installation-Guide.pdf', 'User''s Manual.pdf', 'Data_Sheet-V2.1.pdf', 'notes.pdf', 'How to Configure X.pdf', 'Hardening Guide.pdf', 'misc.pdf'][doc_id % 8 + 1] AS path,
    ['quick_start_guide', 'installation_guide', 'user_manual', 'datasheet', NULL, 'operation_manual', 'security_guide', NULL][doc_id % 8 + 1] AS by_name,
    CASE WHEN doc_id % 3 = 0 THEN 'Security Baseline ' || coalesce(text, '') ELSE coalesce(text, '') END AS content, CASE doc_id % 5 WHEN 0 THEN 'datasheet' WHEN 1 THEN 'junk' END AS known, lang, source
  FROM documents
)"""
_REVIEW = """p AS (SELECT p_partkey AS k, p_name AS name, p_size AS i, p_partkey % 9 <> 0 AS there FROM part),
work AS (
  SELECT r.dpi, r.run_id, 's' || k AS sample_id, k AS block_idx, 'text' AS field, name AS original_text, CASE WHEN NOT there THEN '' WHEN k % 5 = 0 THEN name || ' more' ELSE name || ' [Icon: gear]' END AS patched_text
  FROM p, (VALUES ('r1', 100), ('r2', 200)) r(run_id, dpi)
)"""


def _scored(known: str) -> str:
    return f"""counts AS (SELECT k, d.dpi, 's' || k AS sample_id, i % 4 AS target, i % 3 AS strict, i % 2 AS wrong, k % 2 AS missed, k % 3 AS extra FROM p, (VALUES (100), (200)) d(dpi)),
kept AS (SELECT c.*, CASE WHEN {known} THEN (w.block_idx % 5 <> 0 AND w.block_idx % 9 <> 0)::INT ELSE 1 END AS text_preserved FROM counts c JOIN work w USING (dpi, sample_id)),
raw AS (SELECT *, 5.0 - missed * 2.0 - wrong * 1.5 - extra AS base, CASE WHEN target > 0 THEN strict / target END AS recall FROM kept),
capped AS (SELECT *, CASE WHEN strict = 0 AND (wrong > 0 OR missed > 0) THEN least(base, 2.0) WHEN recall < 0.5 THEN least(base, 2.0) WHEN recall < 0.8 THEN least(base, 3.0) ELSE base END AS b FROM raw),
scored AS (SELECT dpi, sample_id, text_preserved, CASE WHEN text_preserved = 0 THEN 0 WHEN target <= 0 THEN CASE WHEN extra <= 0 THEN 5 WHEN extra = 1 THEN 3 WHEN extra = 2 THEN 2 ELSE 1 END ELSE greatest(0, least(5, trunc(b + 0.5)))::INT END AS quality_score FROM capped)"""


MORE_SQL: dict[str, str] = {
    "block_contexts": f"""WITH {_BLOCKS} SELECT source, block_idx, '--- [Block ' || block_idx || ', page ' || page_idx || ', type ' || type
        || CASE WHEN block_idx % 10 = 0 THEN ', continuation of table block ' || (block_idx - 1) || ', source block ' || (block_idx - 1) ELSE '' END || '] ---' || chr(10)
        || concat_ws(chr(10), text, list_items, nullif(table_caption, ''), nullif(table_body, ''), nullif(table_footnote, ''), nullif(image_caption, '')) AS context FROM blocks""",
    "source_metadata": r"""WITH p AS (SELECT page_id, trim(regexp_replace(url, '^https?://[^/]*', ''), '/') AS rel FROM pages)
        SELECT page_id, rel AS source_relpath, regexp_extract(rel, '[^/]*$') AS source_filename, array_to_string(list_filter(string_split(rel, '/'), lambda x: x <> ''), ' > ') || ' > S' || (page_id % 3) AS breadcrumb FROM p""",
    "patch_application": f"""WITH {_PATCHED} SELECT block_idx, CASE WHEN decision = 'apply' THEN 'Click [Icon: gear] ' || text ELSE text END AS text, decision = 'apply' AS patched, decision <> 'pending' AS checked, decision FROM applied""",
    "patch_counters": f"""WITH {_PATCHED} SELECT source, count(*) AS n_fields, count(*) FILTER (WHERE decision = 'apply') AS n_patched, count(*) FILTER (WHERE decision IN ('no_missing', 'same')) AS n_unchanged,
        count(*) FILTER (WHERE decision IN ('only_icon', 'empty')) AS n_rejected, count(*) FILTER (WHERE decision = 'pending') AS n_pending FROM applied GROUP BY source""",
    "caption_candidates": f"WITH {_BLOCKS} SELECT source, block_idx, img_path FROM blocks WHERE type = 'image' AND {_STATE} = 'candidate'",
    "caption_stats": f"""WITH {_BLOCKS}, s AS (SELECT source, block_idx, {_STATE} AS s FROM blocks WHERE type = 'image')
        SELECT source, count(*) AS n_images, count(*) FILTER (WHERE s = 'inline_icon') AS n_inline_icons, count(*) FILTER (WHERE s = 'no_path') AS n_without_path, count(*) FILTER (WHERE s = 'existing') AS n_existing,
          count(*) FILTER (WHERE s = 'candidate') AS n_candidates, count(*) FILTER (WHERE s = 'candidate' AND block_idx % 5 = 0) AS n_missing_files FROM s GROUP BY source""",
    "caption_worklist": f"""WITH {_BLOCKS} SELECT source, block_idx, page_idx, page_idx + 1 AS pdf_page, CASE WHEN image_caption LIKE 'Fig %0' THEN 'figure' WHEN image_caption LIKE 'Fig%' THEN 'other_figure' ELSE 'unclear' END AS image_type,
        image_caption AS caption_preview, description <> '' AND policy <> '' AS has_existing_description, 'near ' || block_idx AS context FROM blocks WHERE type = 'image' AND NOT icon AND img_path <> ''""",
    "context_token_stats": _stats(""),
    "context_token_stats_by_source": _stats("source"),
    "footnote_regions": f"WITH {_BLOCKS}, {_NOTES} SELECT * FROM notes",
    "body_regions": f"WITH {_PAIRS}, {_ICONS}, {_BODY} SELECT * FROM body",
    "patch_regions": f"""WITH {_PAIRS}, {_ICONS}, {_BODY}, {_NOTES},
        fields AS (SELECT source, block_idx, unnest(CASE type WHEN 'text' THEN ['text'] WHEN 'list' THEN ['list_items'] WHEN 'table' THEN list_filter([CASE WHEN table_footnote <> '' THEN 'table_footnote' END, CASE WHEN table_body <> '' THEN 'table_body' END], lambda x: x IS NOT NULL)
          WHEN 'image' THEN list_filter([CASE WHEN image_caption <> '' THEN 'image_caption' END], lambda x: x IS NOT NULL) ELSE []::VARCHAR[] END) AS field FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source = b.source AND p.block_idx = b.block_idx))
        SELECT f.source, b.page_idx, f.field, f.block_idx || ':table_body' || CASE WHEN b.part_idx <> b.block_idx THEN ':continuation' ELSE '' END AS label, b.x0, b.y0, b.x1, b.y1 FROM fields f JOIN body b USING (source, block_idx) WHERE f.field = 'table_body'
        UNION ALL SELECT f.source, n.page_idx, f.field, f.block_idx || ':table_footnote', n.x0, n.y0, n.x1, n.y1 FROM fields f JOIN notes n USING (source, block_idx) WHERE f.field = 'table_footnote'
        UNION ALL SELECT f.source, b.page_idx, f.field, f.block_idx || ':' || f.field, least(b.x0, coalesce(min(i.x0), b.x0)), least(b.y0, coalesce(min(i.y0), b.y0)), greatest(b.x1, coalesce(max(i.x1), b.x1)), greatest(b.y1, coalesce(max(i.y1), b.y1))
          FROM fields f JOIN blocks b USING (source, block_idx) LEFT JOIN icons i ON i.source = b.source AND i.target_idx = b.block_idx AND i.page_idx = b.page_idx WHERE f.field NOT LIKE 'table%' AND b.has_box GROUP BY f.source, b.page_idx, f.field, f.block_idx, b.x0, b.y0, b.x1, b.y1
        UNION ALL SELECT source, page_idx, 'inline_icon', icon_idx || ':inline-icon', x0, y0, x1, y1 FROM icons""",
    "caption_regions": f"""WITH {_BLOCKS}, t AS (SELECT source, block_idx AS target_idx FROM blocks WHERE type = 'image'),
        n AS (SELECT source, target_idx, target_idx AS block_idx, 'caption_target' AS field, target_idx || ':image' AS label FROM t
          UNION ALL SELECT source, target_idx, target_idx + d, 'context_' || s, target_idx || ':' || s || ':' || (target_idx + d) FROM t, (VALUES (-1, 'before'), (0, 'current'), (1, 'after')) v(d, s))
        SELECT n.*, b.page_idx, b.x0, b.y0, b.x1, b.y1 FROM n JOIN blocks b ON b.source = n.source AND b.block_idx = n.block_idx WHERE b.has_box""",
    "chunk_regions": f"""WITH {_BLOCKS}, r AS (SELECT source || '-' || (block_idx // 100) AS chunk_id, page_idx, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source, block_idx // 100) AS n, x0, y0, x1, y1 FROM blocks WHERE has_box WINDOW w AS (PARTITION BY source, block_idx // 100 ORDER BY block_idx))
        SELECT chunk_id, page_idx, pos, CASE WHEN pos = 0 THEN n END AS label_tokens, x0, y0, x1, y1 FROM r""",
    "chunk_items": f"""WITH {_PAIRS}, i AS (
        SELECT source, block_idx, page_idx, CASE type WHEN 'text' THEN text WHEN 'list' THEN list_items
            WHEN 'image' THEN concat_ws(chr(10), CASE WHEN image_caption <> '' THEN '[Image caption: ' || image_caption || ']' END, CASE WHEN description <> '' THEN '[Image VLM description: ' || description || ']' END, CASE WHEN policy <> '' THEN '[Image answering policy: ' || policy || ']' END)
            WHEN 'table' THEN concat_ws(chr(10), CASE WHEN table_caption <> '' THEN '[Table caption: ' || table_caption || ']' END, nullif(table_body, ''), CASE WHEN table_footnote <> '' THEN '[Table footnote: ' || table_footnote || ']' END) END AS text,
          CASE WHEN type = 'image' AND NOT icon THEN img_path ELSE '' END AS images, CASE WHEN type = 'table' THEN img_path ELSE '' END AS tables, 'S' || (block_idx // 1000) AS section_path
        FROM blocks b WHERE type <> 'header' AND NOT EXISTS (SELECT 1 FROM pairs p WHERE p.source = b.source AND p.block_idx = b.block_idx))
        SELECT * FROM i WHERE text <> '' OR images <> '' OR tables <> ''""",
    "embed_off": "SELECT doc_id, 4 AS size, 1.0::DOUBLE AS first, 1.0::DOUBLE AS norm FROM documents",
    "collection_columns": "SELECT * FROM (VALUES (0, 'id', 'string'), (1, 'chunk_id', 'string'), (2, 'page_idx', 'int'), (3, 'text_dense', 'array<float>'), (4, 'page_patches', 'array<array<float>>'), (5, 'text_sparse', 'map<string,float>'), (6, 'source', 'string')) v(place, name, type)",
    "payload_boxes": """SELECT o_orderkey, o_orderkey % 5 AS page_idx, 1 AS n_boxes FROM orders WHERE o_orderkey % 3 > 0 UNION ALL SELECT o_orderkey, o_orderkey % 5 + 5, 1 FROM orders WHERE o_orderkey % 12 < 9""",
    "chunk_keys": "SELECT o_orderkey, o_orderstatus || '|' || CASE o_orderkey % 3 WHEN 0 THEN 'c' || o_orderkey WHEN 1 THEN 'r' || o_orderkey ELSE 'chunk_idx:' || (o_orderkey % 100) END AS key FROM orders",
    "message_parts": """SELECT item_id, 'system' AS role, 'Answer from the context.' AS content FROM benchmark
        UNION ALL SELECT item_id, 'user', 'Question: ' || text || CASE WHEN item_id % 2 = 0 THEN chr(10) || chr(10) || 'Be brief.' ELSE '' END FROM benchmark""",
    "visual_pages": "SELECT user_id AS source, event_id AS block_idx FROM events WHERE event_id % 3 = 1",
    "naive_alignment": "SELECT o_orderkey, (o_orderkey % 5 BETWEEN 1 AND 3 AND o_orderkey % 6 BETWEEN o_orderkey % 4 AND o_orderkey % 4 + o_orderkey % 3)::INT::DOUBLE AS alignment FROM orders",
    "candidate_order": f"""WITH {_BLOCKS} SELECT source AS query_id, block_idx AS chunk_idx, row_number() OVER (PARTITION BY source ORDER BY block_idx % 4 DESC, page_idx, y0 NULLS LAST, x0 NULLS LAST, block_idx) AS position FROM blocks WHERE type = 'text'""",
    "gold_flags": f"""WITH {_DENSE}, p AS (SELECT query_id, unnest([vec_id % 11, vec_id % 5]) AS page FROM dense)
        SELECT query_id, count(*) AS n_hits, bool_or(vec_id = query_id * 50 + query_id % 3) AS chunk_hit, (SELECT bool_or(page = d.query_id % 7) FROM p WHERE p.query_id = d.query_id) AS page_hit,
          (SELECT string_agg(DISTINCT page::VARCHAR, '|' ORDER BY lpad(page::VARCHAR, 2, '0')) FROM (SELECT DISTINCT page, query_id FROM p) z WHERE z.query_id = d.query_id) AS pages FROM dense d GROUP BY query_id""".replace("string_agg(DISTINCT page::VARCHAR, '|' ORDER BY lpad(page::VARCHAR, 2, '0'))", "string_agg(page::VARCHAR, '|' ORDER BY page)"),
    "retrieval_run": f"""WITH {_DENSE}, gold AS (SELECT vec_id // 50 AS query_id, vec_id AS id FROM embeddings WHERE vec_id % 25 = 0), n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
        g AS (SELECT query_id, min(rank) AS first_rank, count(*) FILTER (WHERE rank <= 1) AS h1, count(*) AS h10 FROM dense JOIN gold ON gold.query_id = dense.query_id AND id = vec_id GROUP BY query_id),
        h AS (SELECT query_id, string_agg(vec_id::VARCHAR, '|' ORDER BY rank) AS hits FROM dense GROUP BY query_id)
        SELECT 'r1' AS run_id, query_id, n_gold, first_rank, (coalesce(h1, 0) > 0)::INT AS recall_1, (coalesce(h10, 0) > 0)::INT AS recall_10, round(coalesce(h10, 0) / n_gold, 6) AS coverage_10, hits FROM h JOIN n USING (query_id) LEFT JOIN g USING (query_id)""".replace("SELECT query_id, min(rank)", "SELECT dense.query_id, min(rank)").replace("id = vec_id GROUP BY query_id", "id = vec_id GROUP BY dense.query_id"),
    "answering_run": """WITH c AS (SELECT doc_id, left(coalesce(text, ''), 200) AS context FROM documents)
        SELECT 'a1' AS run_id, doc_id AS query_id, doc_id % 4 AS n_hits, context, greatest(1, ceil(length(context) / 4.0))::BIGINT AS context_tokens, CASE WHEN doc_id % 6 > 0 THEN CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Answer ' || doc_id END END AS answer,
          CASE WHEN doc_id % 6 > 0 THEN CASE WHEN doc_id % 3 = 0 THEN doc_id % 900 ELSE 0 END END AS total_tokens, CASE WHEN doc_id % 6 > 0 THEN doc_id % 13 / 4 END AS latency, CASE WHEN doc_id % 6 = 0 THEN 'no_answer' WHEN doc_id % 4 = 0 THEN 'empty' ELSE 'ok' END AS status FROM c""",
    "answering_run_skipped": "SELECT 'a2' AS run_id, doc_id AS query_id, greatest(1, ceil(length(coalesce(text, '')) / 4.0))::BIGINT AS context_tokens, NULL::VARCHAR AS answer, 'skipped' AS status FROM documents",
    "baseline_run": """SELECT 'b1' AS run_id, doc_id AS query_id, NULL::BIGINT AS n_hits, NULL::VARCHAR AS context, NULL::BIGINT AS context_tokens, CASE WHEN doc_id % 4 = 0 THEN '<think>so</think> ' ELSE 'Answer ' || doc_id END AS answer,
        NULL::INT AS total_tokens, NULL::DOUBLE AS latency, NULL::VARCHAR AS status FROM documents WHERE doc_id % 6 > 0""",
    "run_discovery": "SELECT lower(c_mktsegment) || '-' || c_nationkey AS run_id, max(c_acctbal) FILTER (WHERE c_nationkey % 5 > 0) AS mean_score FROM customer WHERE lower(c_mktsegment) LIKE 'furn%' OR lower(c_mktsegment) LIKE 'auto%' GROUP BY 1",
    "query_rows": """WITH p AS (SELECT item_id, text, list_sort(list_distinct([item_id % 9, item_id % 4])) AS pages FROM benchmark)
        SELECT CASE WHEN item_id % 2 = 0 THEN 'q' || item_id ELSE 'qa-' || lpad((item_id + 1)::VARCHAR, 4, '0') END AS query_id, coalesce(text, '') AS query, '' AS canonical_answer, array_to_string(pages, '|') AS gold_page_indices, array_to_string(list_transform(pages, lambda x: x + 1), '|') AS gold_page_numbers FROM p""",
    "service_calls": "SELECT item_id, CASE WHEN item_id % 5 = 0 THEN 'as it was' ELSE 'got ' || item_id END AS value, item_id % 5 = 0 AS fell_back FROM benchmark",
    "eligible_chunks": rf"""WITH {_ASK}, n AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\[Icon:[^\]]+\]', ' ', 'g'), '\[(?:Breadcrumb|Section|Table|Table caption|Table footnote|Image with illustration|Image caption|Image description|Image VLM description|Image footnote|Image answering policy|Footnote):[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g')) AS note FROM ask)
        SELECT doc_id FROM n WHERE doc_id % 11 > 0 AND doc_id % 7 > 0 AND page >= 10
          AND NOT (kind = 4 AND NOT regexp_matches(body, '\bStep\s+\d+') AND (CASE WHEN length(note) <= 80 THEN length(note) ELSE length(trim(regexp_replace(left(note, 80), ' [^ ]*$', ''))) + 1 END) < 40)""",
    "chunk_questions": f"""WITH {_ASK} SELECT doc_id, CASE
          WHEN kind = 0 THEN 'What parameters or information are described in Table ' || doc_id || '?'
          WHEN kind = 1 THEN 'What operation and visual information are described in ' || coalesce(nullif(subject, ''), 'this section') || '?'
          WHEN kind = 2 THEN 'What does ' || coalesce(nullif(subject, ''), 'this interface') || ' show in the manual?'
          WHEN kind = 3 THEN CASE WHEN subject = '' THEN 'How is this operation performed in the manual?' WHEN subject = 'Configuring Users' THEN 'How do I configure Users?' WHEN subject = 'Adding a Device' THEN 'How do I add a Device?' ELSE 'How do I use ' || subject || '?' END
          WHEN subject = '' THEN 'What information is provided in this section of the manual?' ELSE 'What does the manual say about ' || subject || '?' END AS question FROM ask""",
    "visual_page_queries": """WITH i AS (
          SELECT (event_id // 40)::INT AS page_idx, event_id AS block_idx, CASE event_id % 3 WHEN 0 THEN 'Figure ' || (event_id % 4) ELSE CASE WHEN event_id % 5 > 0 THEN 'Panel' ELSE 'page ' || (event_id // 40 + 1) END END AS subject,
            (event_id % 2 = 0)::INT + (event_id % 3 = 0)::INT AS richness FROM events WHERE event_type = 'click' AND event_id // 40 >= 10),
        c AS (SELECT *, count(*) OVER (PARTITION BY page_idx) AS n FROM i),
        o AS (SELECT *, row_number() OVER (PARTITION BY page_idx, lower(subject) ORDER BY richness DESC, block_idx) AS k FROM c QUALIFY k = 1),
        a AS (SELECT *, (row_number() OVER (PARTITION BY page_idx ORDER BY richness DESC, block_idx) > 1)::INT AS again FROM o),
        r AS (SELECT *, row_number() OVER (ORDER BY again, n DESC, richness DESC, page_idx DESC, block_idx) AS q FROM a QUALIFY q <= 60)
        SELECT 'full-visual-' || lpad(q::VARCHAR, 3, '0') AS query_id, CASE WHEN lower(subject) LIKE 'figure%' THEN 'What does ' || subject || ' show?' ELSE 'What visual information is shown in ' || subject || '?' END AS query, page_idx, block_idx FROM r""",
    "pilot_set": "SELECT * FROM (VALUES ('p-1', 'How is a device added?', 'operation', '3'), ('p-2', 'What does the panel show?', 'image_ui', '4|5')) v(query_id, query, query_type, gold_page_indices)",
    "assembled_questions": """WITH d AS (SELECT source AS pdf, doc_id AS n, 'Q' || doc_id AS question FROM documents),
        parts AS (SELECT *, 0 AS part FROM d WHERE n % 40 = 0 UNION ALL SELECT *, 1 FROM d WHERE n % 40 = 1),
        room AS (SELECT pdf, greatest(0, 12 - count(*) FILTER (WHERE n % 40 <= 1)) AS room FROM d GROUP BY pdf),
        fill AS (SELECT pdf, n, question, 2 AS part FROM (SELECT *, row_number() OVER (PARTITION BY pdf ORDER BY n) AS k FROM d WHERE n % 2 = 1 AND n % 40 <> 1) JOIN room USING (pdf) WHERE k <= room)
        SELECT pdf, n, question, 'qa-' || lpad((row_number() OVER (ORDER BY part, pdf, n))::VARCHAR, 4, '0') AS qa_id FROM (SELECT pdf, n, question, part FROM parts UNION ALL SELECT * FROM fill)""",
    "stage_page_sets": f"""WITH {_BLOCKS}, p AS (SELECT DISTINCT source, page_idx FROM blocks) SELECT 'dpi' AS stage, * FROM p WHERE page_idx % 4 < 3 UNION ALL SELECT 'dpi-more', * FROM p UNION ALL SELECT 'quality', * FROM p WHERE page_idx % 4 >= 2""",
    "quality_pool": f"""WITH {_BLOCKS}, f AS (SELECT source, block_idx, page_idx, 'text' AS field, CASE WHEN block_idx % 4 = 0 THEN 'Click on Text ' || block_idx ELSE 'Text ' || block_idx END AS preview FROM blocks WHERE type IN ('text', 'list')),
        c AS (SELECT * FROM f WHERE page_idx % 4 < 2 AND block_idx % 4 <> 0 QUALIFY row_number() OVER (ORDER BY sha1('7|' || source || '|' || block_idx || '|text'), source, block_idx) <= 25)
        SELECT source, block_idx, page_idx, page_idx + 1 AS pdf_page, field, 'quality_page' AS sample_label, preview FROM f WHERE page_idx % 4 >= 2 UNION ALL SELECT source, block_idx, page_idx, page_idx + 1, field, 'negative_control', preview FROM c""",
    "review_worklist": f"WITH {_REVIEW} SELECT * FROM work",
    "backfilled_scores": f"WITH {_REVIEW}, {_scored('w.block_idx % 6 <> 1')} SELECT * FROM scored",
    "preservation_rollup": f"WITH {_REVIEW}, {_scored('true')} SELECT count(*) AS n_rows, count(*) FILTER (WHERE text_preserved = 0) AS n_not_preserved, round(avg(quality_score), 6) AS mean_score FROM scored",
    "document_types": rf"""WITH {_NAMED}, t AS (SELECT *, trim(regexp_replace(lower(path), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' ' || trim(regexp_replace(lower(left(content, 900)), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS s FROM named)
        SELECT doc_id, coalesce(by_name, CASE WHEN s LIKE '%security recommendation%' OR s LIKE '%security baseline%' OR s LIKE '%hardening guide%' THEN 'security_guide' WHEN known = 'datasheet' THEN known ELSE 'other' END) AS kind FROM t""",
    "family_rules": f"""WITH {_NAMED}, f AS (SELECT doc_id, path, path ILIKE '%manual%' AS m, path ILIKE '%guide%' AS g, path LIKE 'src1/%' AS a, path ILIKE '%config%' AS c FROM named)
        SELECT doc_id, concat_ws('|', CASE WHEN (m OR g) AND NOT c THEN 'paper' END, CASE WHEN a THEN 'first' END, CASE WHEN c THEN 'setup' END) AS families, concat_ws('|', CASE WHEN m THEN 'manuals' END, CASE WHEN g THEN 'guides' END, CASE WHEN c THEN 'config' END) AS subfamilies FROM f""",
    "move_plan": f"""WITH {_NAMED}, r AS (SELECT doc_id, doc_id || '/' || path AS current_path, coalesce(lang, 'unsorted') || '/' || coalesce(by_name, 'other') || '/' || (doc_id // 2) || '.pdf' AS target_path FROM named)
        SELECT current_path, target_path, CASE doc_id % 3 WHEN 1 THEN 'out/b' WHEN 2 THEN 'out/a' END AS folder, true AS moves, CASE WHEN count(*) OVER (PARTITION BY target_path) > 1 THEN 'target_collision' WHEN doc_id % 3 = 0 THEN 'missing_output' WHEN doc_id % 3 = 2 THEN 'multiple_output' ELSE '' END AS problem FROM r""",
    "review_packets": f"""WITH {_NAMED} SELECT doc_id || '/' || path AS relpath, regexp_extract(path, '[^/]*$') AS filename, doc_id % 4 = 0 AS has_sidecar, CASE WHEN doc_id % 4 = 0 THEN 'doc: ' || doc_id ELSE '' END AS sidecar, CASE WHEN doc_id % 3 > 0 THEN 'e1|e2' ELSE '' END AS evidence FROM named""",
    "packet_counts": "SELECT count(*) AS n_packets, count(*) FILTER (WHERE doc_id % 4 <> 0) AS n_without_sidecar, count(*) FILTER (WHERE doc_id % 3 = 0) AS n_without_evidence FROM documents",
    "box_checks": """WITH b AS (SELECT o_orderkey AS k, (o_orderkey % 7)::DOUBLE AS x0, (o_orderkey % 5)::DOUBLE AS y0, (o_orderkey % 11)::DOUBLE AS x1, (o_orderkey % 13)::DOUBLE AS y1, o_orderkey % 900 + 100 AS w, o_orderkey % 700 + 50 AS h FROM orders),
        v AS (SELECT *, x1 > x0 AND y1 > y0 AS ok, least(1.0, 512.0::DOUBLE / greatest(w, h)) AS f FROM b)
        SELECT k AS o_orderkey, ok AS valid, CASE WHEN ok THEN (x1 - x0) * (y1 - y0) ELSE 0.0 END AS area, round(CASE WHEN ok THEN greatest(0.0, x0 * 0.595 - 4) ELSE 0.0 END, 6) AS px0, round(CASE WHEN ok THEN least(842.0, y1 * 0.842 + 4) ELSE 842.0 END, 6) AS py1,
          greatest(1, floor(w * f)::INT) AS width, greatest(1, floor(h * f)::INT) AS height FROM v""",
    "source_names": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a/' || page_id || '.pdf' ELSE page_id || '.pdf' END AS name FROM pages",
    "labels_and_parts": """SELECT item_id, 'T ' || item_id AS label, CASE WHEN item_id % 2 = 0 THEN 'a' ELSE '' END AS before, CASE WHEN item_id % 3 = 0 THEN 'cap' ELSE '' END AS current, item_id::VARCHAR AS after,
        CASE item_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 7 ELSE 0 END AS total_tokens, '{"a": ["' || ['old/0.pdf', 'new/1.pdf', 'z.pdf'][item_id % 3 + 1] || '"]}' AS json, item_id || chr(10) || 'x' AS joined FROM benchmark""",
    "audit_counts": "SELECT ['exact', 'normalized', 'fuzzy'][o_orderkey % 3 + 1] AS match_type, count(*) AS n, round(avg((o_orderkey % 100) / 128), 6) AS mean_confidence FROM orders GROUP BY 1",
    "patch_field_rows": """SELECT p_partkey % 9 AS source, p_partkey AS block_idx, 0 AS pos, 'text' AS field, p_name AS text FROM part UNION ALL SELECT p_partkey % 9, p_partkey, 1, 'caption', p_brand FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_partkey % 9, p_partkey, 2, 'note', p_type FROM part WHERE p_partkey % 4 = 0""",
    "direct_candidates": f"""WITH {_DENSE}, f AS (SELECT query_id, vec_id % 7 AS source, vec_id // 3 AS chunk_id, 1.0::DOUBLE / (rank + 60) AS d, CASE WHEN vec_id % 2 = 0 THEN 1.0::DOUBLE / (rank + 69) ELSE 0.0 END AS s FROM dense WHERE vec_id % 5 <> 0)
        SELECT query_id, source, chunk_id, round(max(d), 9) AS dense, round(max(s), 9) AS sparse, round(max(d) + max(s), 9) AS direct FROM f GROUP BY query_id, source, chunk_id""",
    "final_outputs": """WITH o AS (SELECT item_id, text AS value, 'text' AS type, 0 AS o FROM benchmark UNION ALL SELECT item_id, 'a' || item_id, 'image', 1 FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'c' || item_id, 'image', 2 FROM benchmark WHERE item_id % 3 = 0)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY o) - 1 AS pos, type, value FROM o""",
    "primary_golds": """WITH k AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey, CASE WHEN k % 4 = 0 THEN 'explicit' WHEN k % 3 = 0 THEN least('c' || (k * 3 % 50), 'c' || (k * 7 % 50)) WHEN k % 5 > 0 THEN least('c' || (k * 2 % 50), 'c' || (k * 9 % 50)) END AS primary FROM k""",
    "normalized_queries": "SELECT CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR ELSE 'i' || item_id END AS query_id, text AS query, NULL::VARCHAR AS answer, left('e ; more ; ' || text, 20) AS evidence FROM benchmark",
    "sentence_counts": r"""WITH s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))), ' ') AS s FROM documents)
        SELECT doc_id, count(*) FILTER (WHERE length(s) BETWEEN 45 AND 520)::INT AS n_sentences FROM s GROUP BY doc_id""",
    "pages_in_outline": """WITH o AS (SELECT user_id AS source, event_id AS i, event_id % 3 + 1 AS level, 't' || event_id AS title, event_id // 200 AS page FROM events WHERE event_type = 'signup'),
        s AS (SELECT *, (SELECT arg_min(n.page, n.i) FROM o n WHERE n.source = o.source AND n.i > o.i AND n.level <= o.level) AS until FROM o),
        p AS (SELECT DISTINCT user_id AS source, event_id // 200 AS page FROM events)
        SELECT p.source, p.page, string_agg(s.title, ' > ' ORDER BY s.level, s.i) AS path FROM p JOIN s ON s.source = p.source AND p.page >= s.page AND (s.until IS NULL OR p.page < s.until) GROUP BY p.source, p.page""",
    "mixed_queries": """WITH t AS (SELECT o_orderkey AS query_no, o_orderpriority AS kind, 0 AS turn FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 102), v AS (SELECT o_orderkey AS query_no, o_orderpriority AS kind, 1 AS turn FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 18)
        SELECT query_no, kind, 'full-' || lpad((row_number() OVER (ORDER BY turn, query_no))::VARCHAR, 3, '0') AS query_id FROM (SELECT * FROM t UNION ALL SELECT * FROM v)""",
    "run_rows": """SELECT n_name AS run_id, ['final', 'dpi', 'odd', 'baseline'][n_nationkey % 4 + 1] AS stage, CASE WHEN n_nationkey % 5 > 0 THEN nullif(count(c_custkey), 0) END AS n, CASE WHEN n_nationkey % 3 > 0 THEN max(c_acctbal) END AS top FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    "labelled_runs": "SELECT c_mktsegment AS run_id, count(*) AS n, CASE c_mktsegment WHEN 'FURNITURE' THEN 'home' ELSE 'site' END AS label FROM customer WHERE c_mktsegment IN ('FURNITURE', 'BUILDING') GROUP BY c_mktsegment",
    "listed_documents": "SELECT unnest(['benchmark', 'conversations', 'customer', 'documents', 'embeddings', 'events', 'labels', 'lineitem', 'nation', 'orders', 'pages', 'part', 'region', 'supplier']) AS name",
    "chosen_artifacts": """WITH f AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 END AS kind, p_partkey % 30 AS s FROM part WHERE p_partkey % 4 < 3), w AS (SELECT DISTINCT p_partkey % 40 AS s FROM part),
        c AS (SELECT 's' || s AS stem, CASE kind WHEN 0 THEN 'out/s' || s || '/x/content_list.json' WHEN 1 THEN 'out/b/s' || s || '_content_list.json' ELSE 'out/s' || s || '_content_list.json' END AS path, CASE kind WHEN 0 THEN 1 ELSE 0 END AS score, CASE kind WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 2 END AS depth FROM f JOIN w USING (s))
        SELECT stem, path FROM c QUALIFY row_number() OVER (PARTITION BY stem ORDER BY score, depth, path) = 1""",
    "stage_paths": "SELECT p_partkey, 'd/x' || p_partkey || CASE WHEN p_partkey % 3 = 1 THEN '_a' ELSE '' END || '_tagged.json' AS path FROM part",
    "json_array_scan": "SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS idx, n_nationkey, n_name FROM nation",
    "json_lines_round_trip": "SELECT c_custkey, c_name, c_acctbal, NULL::VARCHAR AS none FROM customer",
    "csv_round_trip": """SELECT p_partkey::VARCHAR AS p_partkey, p_brand || '|' || p_type AS kinds, 'say "' || p_name || '",' || chr(10) || 'new' AS text FROM part""",
    "sidecar_scan": "SELECT 'key' || n_nationkey AS key, 'a' || n_nationkey || '|b c' AS value FROM nation WHERE n_nationkey < 6",
    "manifest_scan": "SELECT 'a/' || p_partkey || '.pdf' AS relpath FROM part WHERE p_partkey % 5 > 1",
    "scrolled_points": "SELECT vec_id, label FROM embeddings WHERE vec_id % 3 = 0",
    "combined_arrays": "SELECT n_nationkey, n_name, NULL::INT AS r_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region",
    "markdown_table": r"""SELECT '| name | key |' AS line UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || n_name || '\| | ' || CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey::VARCHAR ELSE '' END || ' |' FROM nation""",
    "upserted_points": "SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND (source <> 'src1' OR doc_id % 3 = 0)",
    "stored_collection": "SELECT doc_id::VARCHAR AS id, source, 4 AS size FROM documents WHERE source IS NOT NULL",
    "folder_size": "SELECT sum(strlen(p_name) + 1)::BIGINT AS n_bytes FROM part",
    "outline_scan": """WITH RECURSIVE o AS (SELECT n_nationkey AS i, n_nationkey % 3 + 1 AS level, n_name AS title, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation WHERE n_nationkey % 7 > 0),
        f AS (SELECT i, level, title, r, [title] AS path FROM o WHERE r = 1 UNION ALL SELECT o.i, o.level, o.title, o.r, list_append(f.path[1:o.level - 1], o.title) FROM f JOIN o ON o.r = f.r + 1)
        SELECT i AS outline_index, level, title, array_to_string(path, ' > ') AS section_path FROM f""",
}
