"""DuckDB SQL of the registered queries, formulated on its own where another form exists."""

_TOKEN = r"[\x{3400}-\x{9fff}]|[A-Za-z0-9_]+|[^\s\p{Z}\x1c-\x1f\x{85}A-Za-z0-9_\x{3400}-\x{9fff}]"
_COST = rf"greatest(1, len(regexp_extract_all(text, '{_TOKEN}')))"
_APPROX = r"(len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]')) + ceil((length(text) - len(regexp_extract_all(text, '[\x{3400}-\x{9fff}]'))) / 4.0))::BIGINT"
_LINES = """lines AS (
  SELECT doc_id, p AS block_idx, p // 5 AS page_idx, l[p + 1] AS text
  FROM (SELECT doc_id, l, unnest(range(len(l))) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
)"""


def _fold(name: str, most: int, least: int = 20) -> str:
    """Greedy chunks by recursion over the lines of all documents at once."""
    return f"""{name}_items AS (SELECT *, {_COST} AS tokens FROM lines),
{name}_fold AS (
  SELECT doc_id, block_idx, tokens AS used, 0 AS chunk_idx FROM {name}_items WHERE block_idx = 0
  UNION ALL
  SELECT i.doc_id, i.block_idx,
    CASE WHEN f.used > 0 AND f.used + i.tokens > {most} AND f.used >= {least} THEN i.tokens ELSE f.used + i.tokens END,
    f.chunk_idx + CASE WHEN f.used > 0 AND f.used + i.tokens > {most} AND f.used >= {least} THEN 1 ELSE 0 END
  FROM {name}_fold f JOIN {name}_items i ON i.doc_id = f.doc_id AND i.block_idx = f.block_idx + 1
),
{name}_chunked AS (SELECT i.*, f.chunk_idx FROM {name}_items i JOIN {name}_fold f USING (doc_id, block_idx)),
{name} AS (
  SELECT doc_id, chunk_idx, 'doc_id-' || doc_id || '-chunk-' || lpad(chunk_idx::VARCHAR, 5, '0') AS chunk_id, sum(tokens)::BIGINT AS token_count,
    min(page_idx)::INT AS page_start, max(page_idx)::INT AS page_end, string_agg(block_idx::VARCHAR, '|' ORDER BY block_idx) AS block_indices,
    string_agg(text, chr(10) ORDER BY block_idx) AS content
  FROM {name}_chunked GROUP BY doc_id, chunk_idx
)"""


_CHUNKS = f"WITH RECURSIVE {_LINES}, {_fold('c', 120)} "

_TABLES = """tables AS (
  SELECT user_id AS source, event_id AS block_idx, event_id // 500 AS page_idx, event_type = 'purchase' AS is_master,
    event_type = 'view' AS is_open, (event_id % 900)::DOUBLE AS y0, (event_id % 900)::DOUBLE + 50 AS y1
  FROM events
),
pairs AS (
  SELECT t.source, t.block_idx, m.block_idx AS master_idx, t.page_idx
  FROM tables t ASOF JOIN (SELECT * FROM tables WHERE is_master) m ON t.source = m.source AND t.block_idx >= m.block_idx
  WHERE t.is_open AND CASE WHEN t.page_idx < m.page_idx THEN false WHEN t.page_idx = m.page_idx THEN t.y0 >= m.y1 ELSE t.y0 <= 180 END
)"""

_DENSE = """dense AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank
  FROM (
    SELECT q.vec_id // 50 AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0
  ) QUALIFY rank < 10
)"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2f\x3a-\x60\x7b-\x7f]+')"
_SPARSE = f"""words AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
stats AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM words),
terms AS MATERIALIZED (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark),
tf AS MATERIALIZED (
  SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM words)
  WHERE term IN (SELECT term FROM terms) GROUP BY doc_id, dl, term
),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY query_id, doc_id
),
sparse AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < 20
)"""

_FUSED = f"""{_DENSE}, {_SPARSE},
routes AS (
  SELECT query_id, vec_id AS id, 1.0::DOUBLE / (61 + rank) AS d, 0.0::DOUBLE AS s FROM dense
  UNION ALL SELECT query_id, doc_id, 0.0::DOUBLE, 1.0::DOUBLE / (61 + rank) FROM sparse
),
fused AS (SELECT query_id, id, sum(d) AS dense, sum(s) AS sparse, 0.0::DOUBLE AS visual, sum(d) + sum(s) AS score FROM routes GROUP BY query_id, id)"""

_RANKED = f"""{_FUSED},
ranked AS (
  SELECT f.query_id, f.id, round(f.score, 8) AS score, d.source, d.text, greatest(1, ceil(length(coalesce(d.text, '')) / 4.0))::BIGINT AS tokens
  FROM fused f JOIN documents d ON d.doc_id = f.id
)"""


def _budget(k: int, budget: int) -> str:
    return f"""chosen AS (
  SELECT * FROM (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM ranked) WHERE position <= {k}
  ) WHERE used_before <= {budget}
)"""


_SIMILARITY = """top AS (
  SELECT page_id, token_idx, patch_idx, score FROM (
    SELECT v.vec_id // 16 AS page_id, q.vec_id // 50 AS token_idx, v.vec_id % 16 AS patch_idx,
      round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0
  ) QUALIFY row_number() OVER (PARTITION BY page_id, token_idx ORDER BY score DESC, patch_idx) <= 3
)"""

_GOLD_CHUNKS = f"""WITH RECURSIVE {_LINES}, {_fold('c', 120)}, {_fold('n', 60)},
gold AS (SELECT doc_id AS query_id, doc_id, unnest([0, 2]) AS chunk_idx FROM documents),
anchors AS (
  SELECT g.query_id, list_sort(list_distinct(list(k.block_idx) FILTER (WHERE k.block_idx IS NOT NULL))) AS blocks,
    list_sort(list_distinct(list(k.page_idx) FILTER (WHERE k.page_idx IS NOT NULL))) AS pages,
    list_sort(list_distinct(list('120-' || g.doc_id || '-' || g.chunk_idx) FILTER (WHERE k.doc_id IS NULL))) AS missing
  FROM gold g LEFT JOIN c_chunked k ON k.doc_id = g.doc_id AND k.chunk_idx = g.chunk_idx GROUP BY g.query_id
)"""

_HITS = f"{_DENSE}, hits AS (SELECT query_id, rank + 1 AS rank, vec_id AS id, score FROM dense)"

_PASSES = """passes AS (
  SELECT l_orderkey % 4 AS run_id, l_orderkey AS query_id, l_linenumber AS pass_id,
    least(greatest(floor(l_quantity / 8), 0.0), 5.0)::DOUBLE AS s, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS failure
  FROM lineitem
),
scored AS (
  SELECT run_id, query_id, round(avg(s), 6) AS answer_score, round(max(s) - min(s), 6) AS disagreement,
    max(s) FILTER (WHERE pass_id = 1) AS score_pass_1, max(s) FILTER (WHERE pass_id = 2) AS score_pass_2, max(s) FILTER (WHERE pass_id = 3) AS score_pass_3,
    coalesce(string_agg(DISTINCT failure, '|' ORDER BY failure), '') AS failures
  FROM passes GROUP BY run_id, query_id
)"""

_TYPED = """typed AS (
  SELECT doc_id AS chunk_no, source || '/' || (doc_id % 37) AS section,
    ['table', 'mixed', 'image_ui', 'operation', 'text'][doc_id % 5 + 1] AS query_type
  FROM documents
)"""

_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), '\[Icon:[^\]]+\]', ' ', 'g'),
  '\[(?:Breadcrumb|Section|Table|Table caption|Table footnote|Image with illustration|Image caption|Image description|Image VLM description|Image footnote|Image answering policy|Footnote):[^\]]*\]', ' ', 'g'), '\s+', ' ', 'g'))"""


def _ndcg(k: int) -> str:
    return f"""(coalesce(dcg_{k}, 0) / list_sum(list_transform(range(1, least({k}, greatest(1, coalesce(n_gold, 0)))::INT + 1), lambda r: ln(2) / ln(r + 1.0))))"""


ORACLE_SQL = {
    "token_estimate": f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_TOKEN}'))::BIGINT AS n_tokens FROM documents",
    "approx_token_budget": f"SELECT doc_id, {_APPROX} AS approx_tokens, greatest(1, ceil(length(text) / 4.0))::BIGINT AS context_tokens FROM documents",
    "breadcrumbs": r"""SELECT page_id, array_to_string(list_filter(string_split(p, '/'), lambda x: x <> ''), ' > ') AS breadcrumb,
        trim(regexp_replace(lower(p), '[^a-z0-9]+', '-', 'g'), '-') AS slug
        FROM (SELECT page_id, regexp_extract(url, '^https?://([^?#]*)', 1) AS p FROM pages)""",
    "clean_notes": rf"""SELECT page_id, CASE WHEN length(t) <= 220 THEN t ELSE trim(regexp_replace(left(t, 220), ' [^ ]*$', '')) || '.' END AS note,
        left(trim(regexp_replace(html, '\s+', ' ', 'g')), 320) AS snippet FROM (SELECT page_id, html, {_CLEAN} AS t FROM pages)""",
    "point_ids": """WITH k AS (
          SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '::0::' || doc_id)) AS a,
            sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(source || '::__visual_page__:' || doc_id)) AS b FROM documents
        ), v AS (SELECT doc_id, unnest([a, b]) AS h, unnest([1, 2]) AS i FROM k),
        u AS (SELECT doc_id, i, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || printf('%02x', (('0x' || h[17:18])::INT & 63) | 128) || h[19:20] || '-' || h[21:32] AS id FROM v)
        SELECT doc_id, max(id) FILTER (WHERE i = 1) AS point_id, max(id) FILTER (WHERE i = 2) AS visual_id FROM u GROUP BY doc_id""",
    "titles_and_numbers": r"""WITH t AS (SELECT page_id, trim(regexp_replace('  ' || (page_id % 7) || '.' || (page_id % 3) || '   ' || regexp_extract(html, '<title>([^<]*)</title>', 1), '[\s\x{a0}]+', ' ', 'g')) AS title FROM pages)
        SELECT page_id, title, nullif(regexp_extract(title, '^\s*(\d+(?:\.\d+)*)\b', 1), '') AS number FROM t""",
    "lists_and_ranges": """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = o_orderkey % 5 THEN (o_orderkey % 7)::VARCHAR ELSE (o_orderkey % 7) || '|' || (o_orderkey % 5) END AS ints,
        array_to_string(list_sort(list_distinct([0, o_orderkey % 4 + 1, o_orderkey % 4 + 2, o_orderkey % 4 + 3])), '|') AS pages,
        array_to_string(range(least(o_orderkey % 9, o_orderkey % 4), greatest(o_orderkey % 9, o_orderkey % 4) + 1), '|') AS span FROM orders""",
    "icon_patches": r"""SELECT o_orderkey, ['no_missing', 'only_icon', 'apply', 'apply'][o_orderkey % 4 + 1] AS decision,
        ['', '[Icon: gear]', '[Icon: gear]', '[Icon: x]'][o_orderkey % 4 + 1] AS markers,
        trim(regexp_replace(lower(['no missing icons', '', 'click ' || o_orderpriority, 'tap [icon : x] ' || o_orderpriority][o_orderkey % 4 + 1]), '[^\p{L}\p{N}]+', ' ', 'g')) AS preserved FROM orders""",
    "blocks_from_documents": f"WITH {_LINES} SELECT doc_id, block_idx::INT AS block_idx, page_idx::INT AS page_idx, text FROM lines",
    "greedy_chunks": _CHUNKS + "SELECT doc_id, block_idx::INT AS block_idx, chunk_idx FROM c_chunked",
    "section_islands": """WITH e AS (
          SELECT conv_id, turn, coalesce(last_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn),
            first_value(CASE WHEN role <> 'system' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS effective_path FROM conversations
        ), n AS (SELECT *, coalesce(effective_path <> lag(effective_path) OVER (PARTITION BY conv_id ORDER BY turn), false)::INT AS new FROM e)
        SELECT conv_id, turn, effective_path, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS island FROM n""",
    "chunk_modes": "SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'section' ELSE 'token' END AS mode FROM conversations GROUP BY conv_id",
    "chunk_rollup": _CHUNKS + "SELECT * FROM c",
    "chunk_profile_stats": _CHUNKS + "SELECT count(*) AS n_chunks, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 2) AS mean_tokens, max(token_count) AS max_tokens, count(*) FILTER (WHERE token_count > 120) AS n_over FROM c",
    "profile_sweep": f"WITH RECURSIVE {_LINES}, {_fold('a', 60)}, {_fold('b', 240)} "
    + " UNION ALL ".join(f"SELECT count(*) AS n_chunks, sum(token_count)::BIGINT AS total_tokens, round(avg(token_count), 2) AS mean_tokens, max(token_count) AS max_tokens, count(*) FILTER (WHERE token_count > {n}) AS n_over, {n} AS profile FROM {t}" for t, n in (("a", 60), ("b", 240))),
    "section_asof": """SELECT e.event_id, s.event_id AS section FROM events e ASOF LEFT JOIN (SELECT user_id, event_id, (ts, event_id) AS k FROM events WHERE event_type = 'signup') s
        ON e.user_id = s.user_id AND (e.ts, e.event_id) >= s.k""",
    "continuation_groups": f"WITH {_TABLES} SELECT source, block_idx, master_idx FROM pairs",
    "continuation_members": f"WITH {_TABLES} SELECT source, master_idx, string_agg(block_idx::VARCHAR, '|' ORDER BY block_idx) AS members FROM pairs GROUP BY source, master_idx",
    "cross_page_tables": f"WITH {_TABLES} SELECT source, master_idx, count(DISTINCT page_idx) + 1 AS span_pages FROM pairs GROUP BY source, master_idx",
    "outline_path": f"""WITH RECURSIVE {_LINES}, o AS (SELECT doc_id AS source, block_idx, 1 + length(text) % 3 AS level, text AS title FROM lines),
        f AS (
          SELECT source, block_idx, [title] AS path FROM o WHERE block_idx = 0
          UNION ALL SELECT o.source, o.block_idx, list_append(f.path[1 : o.level - 1], o.title) FROM f JOIN o ON o.source = f.source AND o.block_idx = f.block_idx + 1
        ) SELECT source, block_idx AS outline_index, array_to_string(path, ' > ') AS section_path FROM f""",
    "outline_match_tiers": r"""WITH p AS (
          SELECT page_id AS source, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h, regexp_extract(html, '<p>([^<]*)', 1) AS b,
            CASE WHEN page_id % 3 = 0 THEN lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS t, CASE WHEN page_id % 2 = 0 THEN page_id % 5 * 50.0::DOUBLE END AS d FROM pages
        ), x AS (SELECT source, t, d, unnest([b, h]) AS c, unnest([0, 1]) AS block_idx FROM p),
        y AS (SELECT source, block_idx, d, abs(block_idx * 100 - d) AS away, CASE WHEN trim(c) <> '' AND trim(regexp_replace(c, '[ \t\r\n]+', ' ', 'g')) = trim(regexp_replace(t, '[ \t\r\n]+', ' ', 'g')) THEN 1
          WHEN trim(c) <> '' AND lower(trim(regexp_replace(c, '\s+', ' ', 'g'))) = lower(trim(regexp_replace(t, '\s+', ' ', 'g'))) THEN 2 ELSE 4 END AS tier FROM x)
        SELECT source, block_idx, ['exact', 'normalized', 'fuzzy', 'page_fallback'][tier] AS match_type,
          CASE tier WHEN 1 THEN CASE WHEN away <= 50 THEN 1.0 ELSE 0.95 END WHEN 2 THEN CASE WHEN away <= 50 THEN 0.98 ELSE 0.95 END ELSE CASE WHEN d IS NOT NULL THEN 0.78 ELSE 0.75 END END::DOUBLE AS confidence
        FROM y QUALIFY row_number() OVER (PARTITION BY source ORDER BY tier, CASE WHEN tier = 4 AND d IS NOT NULL THEN (block_idx * 100 < d)::INT ELSE 0 END, (away IS NULL)::INT, away, block_idx) = 1""",
    "page_windows": """WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
        i AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS g FROM d),
        w AS (SELECT *, (row_number() OVER (PARTITION BY l_orderkey, g ORDER BY l_linenumber) - 1) // 2 AS k FROM i)
        SELECT l_orderkey, min(l_linenumber) AS first_page, max(l_linenumber) AS last_page, count(*) AS n_pages FROM w GROUP BY l_orderkey, g, k""",
    "nearest_target": """WITH i AS (SELECT p_partkey // 500 AS source, p_partkey % 5 AS page_idx, p_partkey AS icon_idx, (p_partkey * 37 % 900)::DOUBLE AS ax, (p_partkey * 91 % 900)::DOUBLE AS ay, (20 + p_size)::DOUBLE AS w, 30.0::DOUBLE AS h FROM part),
        j AS (SELECT *, ax + w AS bx, ay + h AS "by" FROM i WHERE (w <= 80 AND h <= 80) OR w * h <= 5000),
        t AS (SELECT s_suppkey // 25 AS source, s_suppkey % 5 AS page_idx, s_suppkey AS target_idx, ['table', 'list', 'text'][s_suppkey % 3 + 1] AS kind, s_suppkey % 5 = 0 AND s_suppkey % 3 > 0 AS verb,
          (s_suppkey * 53 % 600)::DOUBLE AS cx, (s_suppkey * 71 % 800)::DOUBLE AS cy FROM supplier),
        p AS (SELECT j.source, j.page_idx, icon_idx, target_idx, kind, verb, ((ax + bx) / 2 >= cx AND (ax + bx) / 2 <= cx + 300 AND (ay + "by") / 2 >= cy AND (ay + "by") / 2 <= cy + 120) AS inside,
          greatest(0, cx - bx, ax - cx - 300) AS gx, greatest(0, cy - "by", ay - cy - 120) AS gy, greatest(0, least("by", cy + 120) - greatest(ay, cy)) AS up,
          greatest(0, least(bx, cx + 300) - greatest(ax, cx)) * greatest(0, least("by", cy + 120) - greatest(ay, cy)) / (w * h) AS share, abs(cy + 60 - (ay + "by") / 2) AS dy FROM j JOIN t USING (source, page_idx)),
        q AS (SELECT *, sqrt(gx * gx + gy * gy) AS away, kind = 'table' AND (inside OR share >= 0.5) AS in_table FROM p),
        r AS (SELECT *, round(CASE WHEN in_table THEN -1000 + away ELSE away + 0.1 * dy - CASE WHEN inside THEN 220 ELSE 0 END - CASE WHEN up > 0 THEN 70 ELSE 0 END - CASE WHEN up > 0 AND gx <= 80 THEN 90 ELSE 0 END - CASE WHEN verb THEN 140 ELSE 0 END END, 6) AS score FROM q),
        b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY source, page_idx, icon_idx ORDER BY in_table DESC, CASE WHEN in_table THEN target_idx ELSE score END, target_idx) = 1)
        SELECT source, page_idx, icon_idx, target_idx, kind AS target_kind, score FROM b WHERE in_table OR inside OR CASE WHEN verb THEN away <= 260 ELSE (up > 0 AND gx <= 90) OR score <= 130 END""",
    "context_neighbours": f"""WITH {_LINES}, b AS (SELECT doc_id, block_idx, text, {_APPROX} AS tokens FROM lines),
        t AS (SELECT doc_id, block_idx AS target_idx, 160 - least(tokens, 32) AS rest FROM b WHERE length(text) < 60),
        n AS (SELECT doc_id, target_idx, block_idx, tokens, rest, CASE WHEN block_idx < target_idx THEN 'before' WHEN block_idx > target_idx THEN 'after' ELSE 'current' END AS side FROM t JOIN b USING (doc_id)),
        u AS (SELECT *, sum(tokens) OVER (PARTITION BY doc_id, target_idx, side ORDER BY abs(block_idx - target_idx)) AS used FROM n)
        SELECT doc_id, target_idx::INT AS target_idx, block_idx::INT AS block_idx, side, tokens FROM u WHERE side = 'current' OR used <= CASE WHEN side = 'before' THEN rest // 2 ELSE rest - rest // 2 END""",
    "region_explode": _CHUNKS + """SELECT chunk_id, p::INT AS pos, string_split(block_indices, '|')[p + 1]::BIGINT AS block_idx, CASE WHEN p = 0 THEN token_count END AS label_tokens
        FROM (SELECT *, unnest(range(len(string_split(block_indices, '|')))) AS p FROM c)""",
    "subset_closure": f"""WITH {_TABLES}, chosen AS (SELECT source, block_idx FROM tables WHERE (source, page_idx) IN (SELECT (user_id, event_id // 500) FROM events WHERE event_type = 'error'))
        SELECT source, block_idx FROM chosen UNION SELECT source, master_idx FROM pairs WHERE (source, block_idx) IN (SELECT (source, block_idx) FROM chosen)
        UNION SELECT source, block_idx + 1 FROM chosen WHERE block_idx IN (SELECT event_id FROM events WHERE event_type = 'click')""",
    "tag_join": "SELECT d.doc_id, d.source, l.quality, l.toxic, l.doc_id IS NOT NULL AS tagged FROM documents d LEFT JOIN labels l USING (doc_id)",
    "tag_stats": "SELECT count(*) AS n_chunks, count(l.doc_id) AS n_tagged FROM documents d LEFT JOIN labels l USING (doc_id)",
    "replace_by_source": """SELECT doc_id, source, n_chars FROM documents WHERE source NOT IN (SELECT DISTINCT source FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 1000)
        UNION ALL SELECT doc_id, source, n_chars + 1 FROM documents WHERE source IN ('src1', 'src2') AND n_chars > 1000""",
    "upsert_latest": "SELECT o_custkey, coalesce(max(o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), max(o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey",
    "page_rollup": _CHUNKS + """SELECT doc_id, page_idx::INT AS page_idx, arg_min(token_count::VARCHAR, chunk_idx) AS section, string_agg(chunk_id, '|' ORDER BY chunk_idx) AS chunk_ids_on_page, count(*) AS n_chunks
        FROM (SELECT *, unnest(range(page_start, page_end + 1)) AS page_idx FROM c) GROUP BY doc_id, page_idx""",
    "page_batches": "SELECT p_partkey, k::INT AS batch, (k * 8 + 1)::INT AS first, least(k * 8 + 8, p_size)::INT AS last FROM (SELECT p_partkey, p_size, unnest(range((p_size + 7) // 8)) AS k FROM part WHERE p_size > 0)",
    "collection_inspect": "SELECT count(*) AS n_points, min(len(embedding))::INT AS min_size, max(len(embedding))::INT AS max_size FROM embeddings",
    "pending_sources": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "dense_topk": f"WITH {_DENSE} SELECT query_id, vec_id, score, rank::INT AS rank FROM dense",
    "sparse_bm25_topk": f"WITH {_SPARSE} SELECT query_id, doc_id, score, rank::INT AS rank FROM sparse",
    "maxsim_topk": """WITH b AS (
          SELECT q.vec_id // 50 % 2 AS query_id, q.vec_id // 50 AS token_idx, v.vec_id // 10 AS page_id, max(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])) AS best
          FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 GROUP BY ALL
        ), s AS (SELECT query_id, page_id, round(sum(best), 6) AS score FROM b GROUP BY query_id, page_id)
        SELECT query_id, page_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) - 1)::INT AS rank FROM s QUALIFY rank < 10""",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, id, round(dense, 8) AS dense, round(sparse, 8) AS sparse, visual, round(score, 8) AS score FROM fused",
    "route_ablation": f"""WITH {_FUSED}, m AS (
          SELECT query_id, id, round(dense + sparse, 8) AS score, 'text' AS mode FROM fused
          UNION ALL SELECT query_id, id, round(dense, 8), 'text-dense-only' FROM fused WHERE dense > 0 UNION ALL SELECT query_id, id, round(sparse, 8), 'text-sparse-only' FROM fused WHERE sparse > 0
        ) SELECT query_id, id, score, (row_number() OVER (PARTITION BY mode, query_id ORDER BY score DESC, id) - 1)::INT AS rank, mode FROM m QUALIFY rank < 3""",
    "score_prune": f"WITH {_RANKED} SELECT query_id, id, score FROM ranked QUALIFY score >= max(score) OVER (PARTITION BY query_id) * 0.8",
    "soft_budget": f"WITH {_RANKED}, {_budget(10, 2000)} SELECT query_id, id, position::INT AS position, used_before FROM chosen",
    "context_text": f"""WITH {_RANKED}, {_budget(3, 1000)},
        b AS (SELECT query_id, position, '[Source: ' || source || ', Page: ' || (id + 1) || ']' || chr(10) || '[Breadcrumb: ' || source || ']' || chr(10) || text AS block FROM chosen),
        g AS (SELECT query_id, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY position) AS c FROM b GROUP BY query_id)
        SELECT item_id AS query_id, coalesce(n, 0) AS n_hits, coalesce(c, 'No relevant information found in the manual.') AS context FROM benchmark LEFT JOIN g ON query_id = item_id""",
    "visual_bonus": f"""WITH {_FUSED}, h AS (SELECT vec_id % 10 AS query_id, vec_id // 10 AS page_idx, 2.5::DOUBLE / (61 + vec_id // 10) AS v FROM embeddings),
        p AS (SELECT vec_id, vec_id // 10 AS page_idx, CASE WHEN vec_id % 3 <> 0 AND vec_id % 4 = 0 THEN 0 WHEN vec_id % 4 = 0 THEN 0.65::DOUBLE
          ELSE CASE WHEN vec_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END * (0.5::DOUBLE + 0.5::DOUBLE * (vec_id % 4) / 4) END AS fit FROM embeddings),
        l AS (SELECT query_id, vec_id AS id, max(v * fit) AS visual FROM h JOIN p USING (page_idx) WHERE fit > 0 GROUP BY query_id, vec_id)
        SELECT query_id, id::VARCHAR AS chunk_id, round(coalesce(f.score, 0), 8) AS direct, round(coalesce(l.visual, 0), 8) AS visual, round(coalesce(f.score, 0) + coalesce(l.visual, 0), 8) AS score
        FROM fused f FULL JOIN l USING (query_id, id)""",
    "box_alignment": """SELECT l_orderkey, l_linenumber, l_quantity, round(CASE WHEN l_quantity <= 5 OR (l_linenumber % 2 = 1 AND l_linenumber % 4 = 0) THEN 0
          WHEN l_linenumber % 4 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 0.65 ELSE 0.5 END
          ELSE least(1.0::DOUBLE, CASE WHEN l_linenumber % 2 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END * (0.5::DOUBLE + 0.5::DOUBLE * (l_linenumber % 4) / (l_linenumber % 4 + l_linenumber % 3))) END, 6)::DOUBLE AS alignment FROM lineitem""",
    "image_refs_dedupe": """WITH l AS (SELECT page_id % 5 AS query_id, page_id // 5 AS rank, regexp_extract_all(html, 'href="([^"]*)"', 1) AS x FROM pages),
        e AS (SELECT query_id, rank, unnest(x) AS path, unnest(range(len(x))) AS pos FROM l),
        o AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id, path ORDER BY rank, pos) = 1)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos)::INT AS image_no, rank, path FROM o""",
    "patch_topk": f"WITH {_SIMILARITY} SELECT * FROM top",
    "patch_alignment": f"""WITH {_SIMILARITY}, b AS (SELECT p AS page_id, c AS chunk_idx, c * 300.0::DOUBLE AS x0 FROM (SELECT DISTINCT vec_id // 16 AS p FROM embeddings), range(3) z(c)),
        e AS (SELECT *, (patch_idx % 4) * 250.0::DOUBLE AS px, (patch_idx // 4) * 250.0::DOUBLE AS py FROM top),
        t AS (SELECT page_id, sum(greatest(0, score)) AS total FROM top GROUP BY page_id),
        o AS (SELECT e.page_id, chunk_idx, token_idx, score, greatest(0, least(px + 250, x0 + 350) - greatest(px, x0)) * greatest(0, least(py + 250, 700) - py) / 62500 AS o FROM e JOIN b USING (page_id)),
        r AS (SELECT page_id, chunk_idx, sum(greatest(0, score) * o) AS raw, count(DISTINCT token_idx) AS m, count(*) AS n FROM o WHERE o > 0 GROUP BY page_id, chunk_idx),
        s AS (SELECT page_id, chunk_idx, round(raw / total, 6) AS score, round(m / (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0), 6) AS coverage, round(raw / total / 0.245::DOUBLE, 6) AS density, n AS n_evidence FROM r JOIN t USING (page_id) WHERE raw > 0)
        SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, coverage DESC, density DESC, chunk_idx)::INT AS rank FROM s""",
    "evidence_anchor": _GOLD_CHUNKS + " SELECT query_id, coalesce(array_to_string(blocks, '|'), '') AS blocks, coalesce(array_to_string(pages, '|'), '') AS pages, coalesce(array_to_string(missing, '|'), '') AS missing FROM anchors",
    "evidence_remap": _GOLD_CHUNKS + """, f AS (SELECT a.query_id, n.chunk_idx, count(*) AS overlap, any_value(r.token_count) AS tokens
          FROM (SELECT query_id, unnest(blocks) AS block_idx FROM anchors) a JOIN n_chunked n ON n.doc_id = a.query_id AND n.block_idx = a.block_idx JOIN n r ON r.doc_id = n.doc_id AND r.chunk_idx = n.chunk_idx
          GROUP BY a.query_id, n.chunk_idx),
        p AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, tokens, chunk_idx) = 1),
        c2 AS (SELECT query_id, count(*) AS k FROM f GROUP BY query_id)
        SELECT doc_id AS query_id, coalesce(k, 0) AS n_chunks, '60-' || doc_id || '-' || p.chunk_idx AS primary_chunk_id, CASE WHEN k > 0 THEN 'block_overlap' ELSE 'none' END AS source
        FROM documents d LEFT JOIN p ON p.query_id = d.doc_id LEFT JOIN c2 ON c2.query_id = d.doc_id""",
    "snippet_match": "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE length(b.text) >= 40",
    "retrieval_metrics": f"""WITH {_HITS}, gold AS (SELECT q.vec_id // 50 AS query_id, e.vec_id AS id FROM embeddings q JOIN embeddings e USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> 150),
        n AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY query_id),
        g AS (SELECT query_id, min(rank) AS first_rank, """
    + ", ".join(f"count(*) FILTER (WHERE rank <= {k}) AS h_{k}, sum(ln(2) / ln(rank + 1.0)) FILTER (WHERE rank <= {k}) AS dcg_{k}" for k in (1, 3, 5, 10))
    + """ FROM hits JOIN gold USING (query_id, id) GROUP BY query_id)
        SELECT vec_id // 50 AS query_id, coalesce(n_gold, 0) AS n_gold, first_rank, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS reciprocal_rank, """
    + ", ".join(f"(coalesce(h_{k}, 0) > 0)::INT AS recall_{k}, round(coalesce(coalesce(h_{k}, 0) / n_gold, 0), 6) AS coverage_{k}, round({_ndcg(k)}, 6) AS ndcg_{k}" for k in (1, 3, 5, 10))
    + " FROM embeddings e LEFT JOIN n ON n.query_id = e.vec_id // 50 LEFT JOIN g ON g.query_id = e.vec_id // 50 WHERE vec_id % 50 = 0",
    "retrieval_features": f"""WITH {_HITS}, h AS (SELECT query_id, rank, score, CASE WHEN id % 3 = 0 THEN score * 0.7 ELSE 0 END AS v, id % 13 = 0 AS p, id % 2 = 0 AS g FROM hits)
        SELECT query_id, round(max(score) FILTER (WHERE rank = 1), 8) AS top_dense, 0.0::DOUBLE AS top_sparse, round(max(v) FILTER (WHERE rank = 1), 8) AS top_visual, round(max(score * 0.5) FILTER (WHERE rank = 1), 8) AS top_direct,
          count(*) FILTER (WHERE v > 0) AS n_visual, bool_or(g AND v > 0)::INT AS visual_gold_page, (bool_or(g) AND NOT bool_or(p))::INT AS misallocated,
          (bool_or(rank = 1 AND v > 0 AND v > score * 0.5) AND NOT bool_or(p))::INT AS visual_overweight FROM h GROUP BY query_id""",
    "page_score_spread": f"""WITH {_HITS}, p AS (SELECT query_id, floor(score / (id % 3 + 1) * 1e9 + 0.5)::BIGINT AS s, unnest(range(id % 4, id % 4 + id % 3 + 1)) AS page_idx FROM hits),
        g AS (SELECT query_id, page_idx, sum(s)::DOUBLE / 1e9 AS score FROM p GROUP BY query_id, page_idx)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_idx)::INT AS place FROM g""",
    "pass_scores": f"WITH {_PASSES} SELECT * FROM scored",
    "run_score_summary": f"""WITH {_PASSES}, x AS (SELECT *, (query_id % 900 + 100)::DOUBLE AS c, CASE WHEN query_id % 5 > 0 THEN (query_id % 700 + 200)::DOUBLE END AS t FROM scored)
        SELECT run_id, count(*) AS n_queries, round(avg(answer_score), 4) AS mean_score, round(median(answer_score), 4) AS median_score, round(avg((answer_score >= 4)::INT), 4) AS high_rate, round(avg((answer_score <= 2)::INT), 4) AS low_rate,
          round(avg(t), 2) AS mean_total_tokens, round(avg(c), 2) AS mean_context_tokens, round(avg(answer_score) / (avg(c) / 1000), 4) AS retrieval_efficiency, round(avg(answer_score) / (avg(t) / 1000), 4) AS answering_efficiency FROM x GROUP BY run_id""",
    "answer_summary": """SELECT count(*) AS n, sum((o_orderstatus = 'F')::BIGINT)::BIGINT AS n_leaked, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_missing_usage, round(avg(o_orderkey % 17), 6) AS mean_latency,
        round(avg(o_orderkey % 50) FILTER (WHERE o_orderkey % 3 > 0 AND o_orderkey % 50 > 0), 6) AS mean_tokens FROM orders""",
    "archived_contexts": """SELECT o_orderkey AS query_id, (o_orderkey % 7)::DOUBLE AS retrieval, CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 11 ELSE 0 END::DOUBLE AS answering,
        (o_orderkey % 7 + CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 11 ELSE 0 END)::DOUBLE AS latency, o_orderstatus <> 'F' AS pending FROM orders""",
    "request_log_summary": """WITH l AS (SELECT user_id % 10 AS run_id, event_type AS e, round(value, 4) AS d FROM events),
        p AS (SELECT run_id, list_sort(list(d) FILTER (WHERE d IS NOT NULL)) AS v FROM l GROUP BY run_id)
        SELECT run_id, count(*) AS n_requests, count(*) FILTER (WHERE e = 'view') AS n_ok, count(*) FILTER (WHERE e <> 'view') AS n_errors, count(*) FILTER (WHERE e = 'click') AS n_timeouts,
          count(*) FILTER (WHERE e = 'signup') AS n_fallbacks, count(*) FILTER (WHERE e = 'error') AS n_rejected, round(avg(d), 6) AS mean_duration, round(count(*) / 10.0, 6)::DOUBLE AS per_minute,
          any_value(v[floor((len(v) - 1) * 0.5 + 0.5)::INT + 1]) AS p50, any_value(v[floor((len(v) - 1) * 0.95 + 0.5)::INT + 1]) AS p95 FROM l JOIN p USING (run_id) GROUP BY run_id""",
    "checkpoint_gaps": "SELECT user_id, max(g) AS max_gap, count(*) AS n FROM (SELECT user_id, event_id - lag(event_id, 1, 0) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events) GROUP BY user_id",
    "checkpoint_reasons": "SELECT coalesce(o_orderpriority, 'unknown') AS reason, count(*) AS n, sum(o_custkey)::BIGINT AS total FROM orders GROUP BY 1",
    "sample_summary": "SELECT p_brand, round(avg(p_size), 6) AS mean, max(p_size) AS max FROM part WHERE p_partkey % 9 <> 0 GROUP BY p_brand",
    "group_metric": "SELECT o_orderpriority, o_orderstatus, round(avg(o_custkey), 6) AS mean, count(*) AS n FROM orders GROUP BY ALL",
    "best_per_stage": "SELECT o_orderpriority, o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey) = 1",
    "quality_ratios": """SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'l_returnflag' ELSE 'l_linenumber' END AS kind, coalesce(l_returnflag, l_linenumber::VARCHAR) AS key, count(*) AS n,
        sum((l_linestatus = 'O')::INT)::BIGINT AS hits, round(100.0::DOUBLE * sum((l_linestatus = 'O')::INT) / count(*), 6) AS percent, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linenumber))""",
    "patch_quality_scores": """WITH v AS (SELECT p_partkey, p_partkey % 6 AS t, p_partkey % 3 AS m, greatest(0, p_partkey % 6 - p_partkey % 3) AS s, p_partkey % 2 AS w, p_partkey % 4 AS f, p_partkey % 11 <> 0 AS ok FROM part),
        b AS (SELECT *, 5.0 - m * 2 - w * 1.5 - f AS x, CASE WHEN s = 0 AND (w > 0 OR m > 0) THEN 2 WHEN s < 0.5 * t THEN 2 WHEN s < 0.8 * t THEN 3 ELSE 5 END AS cap FROM v)
        SELECT p_partkey, (CASE WHEN NOT ok THEN 0 WHEN t = 0 THEN [5, 3, 2, 1][least(f, 3) + 1] ELSE greatest(0, least(5, trunc(least(x, cap) + 0.5))) END)::INT AS quality FROM b""",
    "early_stop": """WITH r AS (SELECT s_nationkey AS search, s_suppkey AS step, s_suppkey % 29 = 0 AS err, (s_suppkey % 7) / 100.0 AS tr, (s_suppkey * 37 % 100 + 50)::DOUBLE AS rate, (s_suppkey % 13 + 1)::DOUBLE AS p95 FROM supplier),
        b AS (SELECT *, max(rate) OVER w AS best, arg_max(p95, (rate, -step)) OVER w AS best_p95 FROM r WINDOW w AS (PARTITION BY search ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        c AS (SELECT search, step, CASE WHEN err THEN 'errors' WHEN tr > 0.05 THEN 'timeouts' WHEN best > 0 AND rate < best * 0.9 THEN 'throughput' WHEN best_p95 > 0 AND p95 > best_p95 * 2 THEN 'latency' ELSE '' END AS reason FROM b)
        SELECT search, step, reason, reason <> '' AS stop FROM c""",
    "run_grid": """SELECT row_number() OVER (ORDER BY dpi, concurrency, repeat)::INT AS run_no, dpi, concurrency, repeat FROM (VALUES (150), (200)) a(dpi), (VALUES (1), (2), (4)) b(concurrency), (VALUES (1), (2)) c(repeat)""",
    "query_typing": f"WITH {_TYPED} SELECT * FROM typed",
    "quota_sample": f"""WITH {_TYPED}, f AS (SELECT *, (row_number() OVER (PARTITION BY section ORDER BY chunk_no) > 1)::INT AS again FROM typed),
        p AS (SELECT * FROM f WHERE again = 0 OR (SELECT count(*) FROM f WHERE again = 0) < 50),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_type ORDER BY again, chunk_no) AS place FROM p),
        q AS (SELECT *, list_position(['text', 'operation', 'table', 'image_ui', 'mixed'], query_type) AS a, list_position(['operation', 'table', 'image_ui', 'mixed', 'text'], query_type) AS b FROM r),
        o AS (SELECT *, place <= [15, 12, 10, 8, 5][a] AS inside FROM q)
        SELECT row_number() OVER (ORDER BY NOT inside, CASE WHEN inside THEN a ELSE b END, place)::INT AS query_no, chunk_no, query_type FROM o QUALIFY query_no <= 50""",
    "keyword_topk": r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9-]{3,}') AS x FROM documents),
        e AS (SELECT doc_id, unnest(x) AS word, unnest(range(len(x))) AS pos FROM w),
        c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM e WHERE word NOT IN ('that', 'this', 'with') GROUP BY doc_id, word)
        SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first)::INT AS place FROM c QUALIFY place <= 5""",
    "keyword_groups": """SELECT doc_id, g AS "group" FROM (SELECT doc_id, unnest(list_filter([CASE WHEN contains(t, 'license') OR contains(t, 'released under') THEN 'license' END, CASE WHEN contains(t, 'token =') OR contains(t, 'password') THEN 'secret' END,
        CASE WHEN contains(t, '@mail') OR contains(t, '+1 (') THEN 'contact' END], lambda z: z IS NOT NULL)) AS g FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents))""",
    "systematic_sample": """WITH x AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, greatest(1, count(*) OVER (PARTITION BY source) // 5) AS step FROM documents)
        SELECT source, doc_id FROM x WHERE i % step = 0 AND i // step < 5""",
    "question_flags": """SELECT l_orderkey AS qa_id, count(DISTINCT (l_suppkey % 3, l_linenumber)) > 1 AS several_pages, count(DISTINCT l_suppkey % 3) > 1 AS several_files, bool_or(l_returnflag = 'R') AS visual FROM lineitem GROUP BY l_orderkey""",
    "qa_integrity": """WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE o_custkey IS NULL) AS a, count(*) FILTER (WHERE o_totalprice <= 0) AS b, count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')) AS d, count(*) FILTER (WHERE o_orderkey % 2 = 0) AS e FROM orders)
        SELECT unnest(['no_customer', 'price', 'priority', 'even']) AS rule, unnest([a, b, d, e]) AS n_broken, n AS n_rows FROM c""",
    "support_coverage": r"""WITH x AS (SELECT item_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9][a-z0-9.+/@_-]+')) AS c, list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), '[a-z0-9][a-z0-9.+/@_-]+')) AS p FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
        y AS (SELECT item_id, round(CASE WHEN len(c) > 0 THEN len(list_intersect(c, p))::DOUBLE / len(c) ELSE 0 END, 6) AS coverage FROM x) SELECT item_id, coverage, coverage >= 0.88 AS supported FROM y""",
    "version_model_extract": r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?i)(?:^|[_ -])V(\d+(?:\.\d+){1,4})(?:[_ )\-.]|$)', 1), ''), nullif(regexp_extract(text, '(?i)version\s+(\d+(?:\.\d+){1,4})', 1), '')) AS version,
        coalesce(array_to_string((SELECT list(m ORDER BY i) FROM (SELECT upper(m) AS m, min(i) AS i FROM (SELECT unnest(regexp_extract_all(text, '\b([A-Za-z]{2,6}\.[0-9]{2})@', 1)) AS m, generate_subscripts(regexp_extract_all(text, '\b([A-Za-z]{2,6}\.[0-9]{2})@', 1), 1) AS i) GROUP BY upper(m)))[1:12], '|'), '') AS models FROM documents""",
    "language_rules": r"""WITH x AS (SELECT doc_id, ['Manuale utente v2', 'polski_instrukcja', 'guide d''installation', 'doc', 'doc', 'doc', 'doc'][doc_id % 7 + 1] || chr(10) || left(coalesce(text, ''), 3000) AS t, CASE WHEN doc_id % 2 = 0 THEN nullif(trim(lang), '') END AS known FROM documents)
        SELECT doc_id, CASE WHEN regexp_matches(t, '[\x{ac00}-\x{d7af}]') THEN 'ko' WHEN regexp_matches(t, '[\x{0600}-\x{06ff}]') OR regexp_matches(lower(t), '(^|[^a-z0-9_])arabic($|[^a-z0-9_])') THEN 'ar'
          WHEN regexp_matches(lower(t), '(^|[^a-z0-9_])(francais|français|guide d''installation|manuel utilisateur)($|[^a-z0-9_])') THEN 'fr' WHEN regexp_matches(lower(t), '(^|[^a-z0-9_])(polish|polski|instrukcja|użytkownik)($|[^a-z0-9_])') THEN 'pl'
          WHEN regexp_matches(lower(t), '(^|[^a-z0-9_])(italiano|installazione|manuale utente)($|[^a-z0-9_])') THEN 'it' ELSE coalesce(known, 'en') END AS language FROM x""",
    "doc_type_rules": r"""WITH x AS (SELECT doc_id, lang, source, lower(text) AS t FROM documents),
        y AS (SELECT *, CASE WHEN contains(t, 'license') THEN 'license' WHEN regexp_matches(t, 'token\s*=') THEN 'credentials' WHEN contains(t, '@mail') THEN 'contact' ELSE 'prose' END AS kind FROM x)
        SELECT doc_id, kind, concat_ws('|', CASE WHEN contains(t, 'license') THEN 'license' END, CASE WHEN contains(t, 'version') THEN 'version' END, CASE WHEN contains(t, 'public') THEN 'public' END, CASE WHEN contains(t, 'token') THEN 'secret' END) AS topics,
        coalesce(lang, 'unsorted') || '/' || kind || '/' || source AS target FROM y""",
    "anomalies": """SELECT 'collision' AS kind, p_name AS key, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1
        UNION ALL SELECT 'orphan', p_partkey::VARCHAR, 1 FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)""",
    "decision_overlay": "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'xx' ELSE lang END AS lang, source FROM documents",
    "layout_summary": "SELECT lang, source, count(*) AS n, count(*) FILTER (WHERE n_chars > 500) AS n_moves FROM documents GROUP BY ALL",
    "content_digest": f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN block_idx = 0 THEN 'title' WHEN length(text) < 60 THEN 'short' ELSE 'body' END AS kind FROM lines),
        r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY doc_id, kind ORDER BY block_idx) <= 2)
        SELECT doc_id, kind, string_agg(text, ' / ' ORDER BY block_idx) AS digest FROM r GROUP BY doc_id, kind""",
}

from .more_sql import MORE_SQL  # noqa: E402  the SQL of more.py

ORACLE_SQL |= MORE_SQL
