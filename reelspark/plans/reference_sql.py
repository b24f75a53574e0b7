"""SQL with the results of reference_queries, for an engine that is not Spark."""

from __future__ import annotations

_LISTS = """
good AS (
  SELECT query_id, source, keyframe_uid, video_id, original_frame_id, timestamp_sec, score,
         row_number() OVER (PARTITION BY query_id, source, keyframe_uid
           ORDER BY score DESC, video_id, original_frame_id NULLS FIRST, timestamp_sec, keyframe_path NULLS FIRST) AS r
  FROM candidates WHERE isfinite(score) AND isfinite(timestamp_sec) AND video_id IS NOT NULL AND keyframe_uid IS NOT NULL
), lists AS (
  SELECT query_id, source, keyframe_uid, video_id, original_frame_id, timestamp_sec, score,
         CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, keyframe_uid) AS INTEGER) AS rank
  FROM good WHERE r = 1
)
"""
_WEIGHTS = "w AS (SELECT * FROM (VALUES ('asr', 0.7::DOUBLE), ('btc_clip', 1.0::DOUBLE), ('fgclip2', 1.0::DOUBLE), ('ocr', 0.7::DOUBLE), ('pecore', 1.0::DOUBLE)) t(source, weight))"
_FUSED = f"""
{_LISTS}, {_WEIGHTS}, fused AS (
  SELECT query_id, keyframe_uid, sum(weight / (60 + rank) ORDER BY source) AS score, count(*) AS n_sources FROM lists JOIN w USING (source) GROUP BY ALL
)
"""


def _greedy(source: str, group: str, item: str, order: str, kind: str, near: str, cap: str = "") -> str:
    """Rows of ``source`` that a greedy pass keeps in each group: a fold over an ordered list."""
    refused = f"len(list_filter(acc, lambda k: {near})) > 0" + (f" OR len(acc) >= {cap}" if cap else "")
    return f"""SELECT {group}, unnest(list_reduce(list({item} ORDER BY {order}), lambda acc, x: CASE WHEN {refused} THEN acc ELSE list_append(acc, x) END,
       CAST([] AS {kind}[]))) AS x FROM {source} GROUP BY {group}"""


_ROW = "STRUCT(t DOUBLE, uid VARCHAR, s DOUBLE, r BIGINT)"


def _nms(source: str) -> str:
    """Kept rows (query_id, video_id, x) of ``source`` (query_id, video_id, keyframe_uid, timestamp_sec, score, rank)."""
    return _greedy(
        source, "query_id, video_id", "{'t': timestamp_sec, 'uid': keyframe_uid, 's': score, 'r': CAST(rank AS BIGINT)}",
        "score DESC, rank, keyframe_uid", _ROW, "abs(k.t - x.t) <= 2",
    )


_KIS = f"""
{_FUSED}, meta AS (
  SELECT keyframe_uid, video_id, timestamp_sec FROM (
    SELECT *, row_number() OVER (PARTITION BY keyframe_uid ORDER BY video_id, original_frame_id NULLS FIRST, timestamp_sec) AS m FROM lists) WHERE m = 1
), placed AS (
  SELECT f.query_id, keyframe_uid, video_id, timestamp_sec, round(score, 12) AS score,
         row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 12) DESC, keyframe_uid) AS rank
  FROM fused f JOIN meta USING (keyframe_uid)
), kept AS ({_nms("placed")}), first AS (
  SELECT query_id, video_id, x.uid AS keyframe_uid, x.t AS timestamp_sec, x.s AS score,
         CAST(row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, x.r, x.uid) AS INTEGER) AS rank FROM kept
), shown AS (SELECT * FROM first WHERE rank <= 100)
"""

_EVENTS = f"""
{_LISTS}, events AS (
  SELECT query_id, CASE source WHEN 'btc_clip' THEN 0 WHEN 'fgclip2' THEN 1 ELSE 2 END AS e, video_id, original_frame_id AS f, timestamp_sec AS t, score AS s, keyframe_uid AS u
  FROM lists WHERE source IN ('btc_clip', 'fgclip2', 'pecore') AND rank <= 100 AND original_frame_id IS NOT NULL
)
"""
_EVIDENCE = f"""
{_EVENTS}, per AS (SELECT query_id, video_id, e, max(s) AS b, count(*) AS n FROM events GROUP BY ALL
), evidence AS (
  SELECT query_id, video_id, CAST(count(*) AS INTEGER) AS matched_events, round(sum(b ORDER BY e), 9) AS evidence_score, CAST(sum(n) AS BIGINT) AS n_candidates FROM per GROUP BY ALL
), chosen AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY matched_events DESC, evidence_score DESC, video_id) AS INTEGER) AS rank FROM evidence
)
"""


def _layer(previous: str, i: int, gapped: bool) -> str:
    cost = ("0.0001" if gapped else "0.0") + "::DOUBLE * greatest(0.0::DOUBLE, r.t - p.lt)"
    best, largest = (5, " AND r.t - p.lt <= 600") if gapped else (100, "")
    return f"""
l{i} AS (
  SELECT * FROM (
    SELECT p.query_id, p.video_id, p.total + r.s - {cost} AS total, p.penalty + {cost} AS penalty,
           list_append(p.frame_ids, r.f) AS frame_ids, list_append(p.times, r.t) AS times, list_append(p.uids, r.u) AS uids, r.f AS lf, r.t AS lt,
           row_number() OVER (PARTITION BY p.query_id, p.video_id, r.f
             ORDER BY p.total + r.s - {cost} DESC, list_append(p.frame_ids, r.f), list_append(p.uids, r.u)) AS place
    FROM {previous} p JOIN rows_ r ON r.query_id = p.query_id AND r.video_id = p.video_id AND r.e = {i}
    WHERE p.lf < r.f AND r.t - p.lt >= 0{largest}
  ) WHERE place <= {best}
)"""


def _paths(source: str, gapped: bool = False) -> str:
    return f"""
rows_ AS (
  SELECT query_id, video_id, e, f, t, s, u FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, video_id, e, f ORDER BY s DESC, u, t) AS r FROM {source}) WHERE r = 1
), l0 AS (
  SELECT query_id, video_id, s AS total, 0.0::DOUBLE AS penalty, [f] AS frame_ids, [t] AS times, [u] AS uids, f AS lf, t AS lt FROM rows_ WHERE e = 0
), {_layer("l0", 1, gapped)}, {_layer("l1", 2, gapped)}
"""


_SEQ = "STRUCT(neg DOUBLE, frame_ids BIGINT[], uids VARCHAR[], times DOUBLE[])"
_NEAR = "abs(k.times[1] - x.times[1]) <= 0.5 AND abs(k.times[2] - x.times[2]) <= 0.5 AND abs(k.times[3] - x.times[3]) <= 0.5"
_SEQUENCES = f"""
{_EVIDENCE}, picked AS (SELECT events.* FROM events JOIN chosen USING (query_id, video_id) WHERE chosen.rank <= 100), {_paths("picked")},
folded AS ({_greedy(
    "l2", "query_id, video_id", "{'neg': 0.0::DOUBLE - total, 'frame_ids': frame_ids, 'uids': uids, 'times': times}", "total DESC, frame_ids, uids", _SEQ, _NEAR, "100",
)}), final AS (
  SELECT query_id, video_id, x.frame_ids AS frame_ids, 0.0::DOUBLE - x.neg AS total,
         row_number() OVER (PARTITION BY query_id ORDER BY x.neg, video_id, x.frame_ids, x.uids) AS rank FROM folded
)
"""
_DIVERSE = f"""
{_LISTS}, fr AS (
  SELECT query_id, video_id, f, t, s FROM (
    SELECT query_id, video_id, original_frame_id AS f, timestamp_sec AS t, score AS s,
           row_number() OVER (PARTITION BY query_id, video_id, original_frame_id ORDER BY score DESC, timestamp_sec) AS r FROM lists WHERE original_frame_id IS NOT NULL) WHERE r = 1
), folded AS ({_greedy("fr", "query_id, video_id", "{'s': s, 'f': f, 't': t}", "s DESC, f, t", "STRUCT(s DOUBLE, f BIGINT, t DOUBLE)", "abs(k.t - x.t) <= 2", "20")}
), diverse AS (
  SELECT * FROM (SELECT query_id, video_id, x.f AS frame_id, x.s AS score,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, video_id, x.f) AS INTEGER) AS rank FROM folded) WHERE rank <= 100
)
"""
_TASK = "CASE CAST(substr(query_id, 2, 8) AS INTEGER) % 3 WHEN 0 THEN 'qna' WHEN 1 THEN 'trake' ELSE 'kis' END"
_IN = "CASE WHEN {f} BETWEEN t.f - 400 AND t.f + 400 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
_METRICS = f"""
{_DIVERSE}, truth AS (
  SELECT query_id, {_TASK} AS task, video_id, original_frame_id AS f FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY original_frame_id % 97 DESC, keyframe_uid DESC, video_id DESC, original_frame_id DESC) AS r
    FROM lists WHERE original_frame_id IS NOT NULL) WHERE r = 1
), scored AS (
  SELECT t.query_id, d.rank, CASE WHEN d.video_id <> t.video_id THEN 0.0::DOUBLE
    WHEN task = 'trake' THEN ({_IN.format(f="d.frame_id")} + {_IN.format(f="d.frame_id + 30")} + {_IN.format(f="d.frame_id + 900")}) / 3
    WHEN task = 'qna' AND d.frame_id % 4 = 3 THEN 0.0::DOUBLE ELSE {_IN.format(f="d.frame_id")} END AS r
  FROM truth t JOIN diverse d USING (query_id)
), m AS (
  SELECT truth.query_id, task, {", ".join(f"coalesce(max(r) FILTER (rank <= {k}), 0.0::DOUBLE) AS r_at_{k}" for k in (1, 5, 20, 50, 100))}
  FROM truth LEFT JOIN scored USING (query_id) GROUP BY ALL
), metrics AS (SELECT *, (r_at_1 + r_at_5 + r_at_20 + r_at_50 + r_at_100) / 5 AS final_score FROM m)
"""
_SCORES = f"WITH {_METRICS} SELECT query_id, task, r_at_1, r_at_5, r_at_20, r_at_50, r_at_100, round(final_score, 9) AS final_score FROM metrics"
_VIDEOS = """
vids AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ingested_at DESC NULLS LAST, load_id DESC NULLS LAST, fps DESC NULLS LAST, frame_count DESC NULLS LAST) AS vr
                 FROM videos WHERE video_id IS NOT NULL) WHERE vr = 1
), maps AS (
  SELECT DISTINCT video_id, keyframe_index, original_frame_id FROM keyframes WHERE original_frame_id IS NOT NULL AND keyframe_index IS NOT NULL AND video_id IS NOT NULL
), kfs AS (
  SELECT video_id, keyframe_index, bool_or(has_mapping) AS has_mapping FROM keyframes WHERE video_id IS NOT NULL AND keyframe_index IS NOT NULL GROUP BY ALL
), falling AS (
  SELECT DISTINCT video_id FROM (SELECT video_id, original_frame_id, lag(original_frame_id) OVER (PARTITION BY video_id ORDER BY keyframe_index, original_frame_id) AS p FROM maps)
  WHERE original_frame_id < p
)
"""
_BOUNDS = f"""
{_VIDEOS}, known AS (SELECT m.*, fps, frame_count, duration_sec FROM maps m JOIN vids USING (video_id)
), outside AS (SELECT * FROM known WHERE original_frame_id < 0 OR original_frame_id >= frame_count
), late AS (
  SELECT DISTINCT k.video_id FROM known k WHERE fps > 0 AND original_frame_id / fps > duration_sec + 1.0
    AND NOT EXISTS (SELECT 1 FROM outside o WHERE o.video_id = k.video_id AND o.keyframe_index = k.keyframe_index)
)
"""


def terms_sql(docs: str) -> str:
    """Scores of the documents (doc_id, text, key) that ``docs`` selects, for every twentieth document as a query."""
    return _SCORED.replace("$docs", docs)


_SCORED = """
docs AS ($docs
), tok AS (SELECT doc_id, key, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS w FROM docs
), size_ AS (SELECT count(*)::DOUBLE AS n, sum(len(w))::DOUBLE / count(*) AS mean FROM tok
), tf AS (SELECT doc_id, term, len AS length, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL
), df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY 1
), q AS (
  SELECT query_id, term, count(*) AS times FROM (
    SELECT doc_id AS query_id, unnest(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS term
    FROM documents WHERE doc_id % 20 = 0) GROUP BY ALL
), scores AS (
  SELECT query_id, doc_id, round(sum(CAST(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean)) * times / 1e-12::DOUBLE) AS HUGEINT))::DOUBLE * 1e-12::DOUBLE, 9) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), size_ GROUP BY ALL
)
"""
_TERMS = terms_sql("SELECT record_id AS doc_id, min(text) AS text, min(upper(trim(keyframe_uid))) AS key FROM ocr_records GROUP BY 1")
_FUSED_FRAMES = f"""
{_FUSED}, meta AS (
  SELECT keyframe_uid, video_id, original_frame_id FROM (
    SELECT *, row_number() OVER (PARTITION BY keyframe_uid ORDER BY video_id, original_frame_id NULLS FIRST, timestamp_sec) AS m FROM lists) WHERE m = 1
), ff AS (
  SELECT * FROM (SELECT f.query_id, keyframe_uid, video_id, original_frame_id, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY round(score, 12) DESC, keyframe_uid) AS INTEGER) AS rank
                 FROM fused f JOIN meta USING (keyframe_uid)) WHERE original_frame_id IS NOT NULL
)
"""
_REFINE = f"""
{_FUSED_FRAMES}, {_VIDEOS}, first_ AS (
  SELECT l.query_id, l.rank, l.keyframe_uid, l.video_id, l.original_frame_id, v.video_id IS NOT NULL AS known, v.fps, v.frame_count, v.is_readable
  FROM ff l LEFT JOIN vids v ON v.video_id = l.video_id WHERE l.rank <= 10
), checked AS (
  SELECT *, CASE WHEN NOT known THEN 'no such video' WHEN NOT coalesce(is_readable, FALSE) THEN 'unreadable video'
                 WHEN original_frame_id >= 0 AND fps > 0 AND isfinite(fps) AND coalesce(frame_count >= 1 AND original_frame_id < frame_count, TRUE) THEN NULL
                 ELSE 'frame or fps out of bounds' END AS error
  FROM first_
), win AS (
  SELECT *, greatest(0, original_frame_id - round_even(3.0 * fps, 0)::BIGINT) AS a,
         CASE WHEN frame_count IS NULL THEN original_frame_id + round_even(3.0 * fps, 0)::BIGINT ELSE least(frame_count - 1, original_frame_id + round_even(3.0 * fps, 0)::BIGINT) END AS b
  FROM checked WHERE error IS NULL
), asked AS (
  SELECT query_id, keyframe_uid, fps, frame_count, unnest(list_distinct(list_concat(range(a, b + 1, greatest(1, round_even(fps / 4.0, 0)::BIGINT)), [a, original_frame_id, b]))) AS f FROM win
), sparse AS (
  SELECT query_id, keyframe_uid, fps, frame_count, f AS sf FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, keyframe_uid ORDER BY (f * 7919) % 1009 DESC, f) AS r FROM asked) WHERE r = 1
), dense AS (
  SELECT query_id, keyframe_uid, sf, unnest(range(greatest(0, sf - round_even(fps, 0)::BIGINT),
         1 + CASE WHEN frame_count IS NULL THEN sf + round_even(fps, 0)::BIGINT ELSE least(frame_count - 1, sf + round_even(fps, 0)::BIGINT) END)) AS f FROM sparse
), refined AS (
  SELECT query_id, keyframe_uid, sf, f AS rf, ((f * 7919) % 1009) / 1009.0::DOUBLE AS ls FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, keyframe_uid ORDER BY (f * 7919) % 1009 DESC, f) AS r FROM dense) WHERE r = 1
)
"""


def _differences() -> str:
    sets = {
        "K": "SELECT video_id FROM keyframes",
        "V": "SELECT video_id FROM videos",
        "M": "SELECT video_id FROM keyframes WHERE original_frame_id IS NOT NULL",
        "O": "SELECT nullif(upper(regexp_extract(keyframe_uid, '(?i)L\\d+_V\\d+')), '') FROM ocr_records",
        "I": "SELECT video_id FROM documents",
    }
    pairs = [("K", "V"), ("V", "K"), ("M", "V"), ("V", "M"), ("O", "K"), ("K", "O"), ("I", "V"), ("V", "I")]
    one = lambda a, b: f"SELECT '{a} - {b}' AS difference, id FROM (SELECT id FROM (({sets[a]}) EXCEPT ({sets[b]})) t(id)) WHERE id IS NOT NULL"
    return "SELECT difference, count(*) AS n FROM (" + " UNION ALL ".join(one(*p) for p in pairs) + ") GROUP BY 1"


def _even() -> str:
    spaced = "list_transform(range(0, 8), lambda i: CAST(round_even(a + i * (b - a)::DOUBLE / 7, 0) AS BIGINT))"
    return f"""
s AS (SELECT *, {spaced} AS sp FROM wins
), c AS (SELECT *, list_position(list_transform(sp, lambda x: abs(x - center)), list_min(list_transform(sp, lambda x: abs(x - center)))) AS ci FROM s
), m AS (SELECT *, list_distinct(list_transform(sp, lambda x, i: CASE WHEN i = ci THEN center ELSE x END)) AS mv FROM c)
"""


SQL = {
    "ranked_lists": f"WITH {_LISTS} SELECT query_id, source, keyframe_uid, score, rank FROM lists",
    "rrf_fusion": f"WITH {_FUSED} SELECT query_id, keyframe_uid, round(score, 9) AS score, CAST(n_sources AS INTEGER) AS n_sources FROM fused",
    "rrf_breakdown": f"WITH {_LISTS}, {_WEIGHTS} SELECT query_id, keyframe_uid, source, rank, weight, round(weight / (60 + rank), 9) AS contribution FROM lists JOIN w USING (source)",
    "metadata_conflicts": """SELECT keyframe_uid, count(*) AS n_versions FROM (SELECT DISTINCT keyframe_uid, video_id, original_frame_id, timestamp_sec FROM candidates)
GROUP BY 1 HAVING count(*) > 1""",
    "temporal_nms": f"""WITH {_LISTS}, best AS (
  SELECT query_id, video_id, keyframe_uid, timestamp_sec, max(score) AS score, min(rank) AS rank FROM lists GROUP BY ALL
), kept AS ({_nms("best")})
SELECT query_id, video_id, x.uid AS keyframe_uid, x.t AS timestamp_sec, x.s AS score,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, x.r, x.uid) AS INTEGER) AS rank FROM kept""",
    "video_agg_max": f"""WITH {_LISTS}, v AS (
  SELECT query_id || ':' || source AS list_id, video_id, max(score) AS score, arg_min(keyframe_uid, (-score, rank, keyframe_uid)) AS best_keyframe_uid, count(*) AS contributing_keyframes
  FROM lists GROUP BY ALL)
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY round(score, 9) DESC, video_id) AS INTEGER) AS rank, video_id, score, best_keyframe_uid, contributing_keyframes FROM v""",
    "video_agg_mean_top_m": f"""WITH {_LISTS}, p AS (
  SELECT *, query_id || ':' || source AS list_id, row_number() OVER (PARTITION BY query_id, source, video_id ORDER BY score DESC, rank, keyframe_uid) AS place FROM lists
), v AS (
  SELECT list_id, video_id, sum(score ORDER BY place) FILTER (place <= 3) / least(3, count(*)) AS score, max(keyframe_uid) FILTER (place = 1) AS best_keyframe_uid, count(*) AS contributing_keyframes
  FROM p GROUP BY ALL)
SELECT list_id, CAST(row_number() OVER (PARTITION BY list_id ORDER BY round(score, 9) DESC, video_id) AS INTEGER) AS rank, video_id, round(score, 9) AS score, best_keyframe_uid, contributing_keyframes FROM v""",
    "kis_videos": f"""WITH {_KIS}, v AS (SELECT query_id, video_id, max(score) AS score, count(*) AS contributing_keyframes FROM shown GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, video_id) AS INTEGER) AS rank, video_id, round(score, 9) AS score, contributing_keyframes FROM v""",
    "kis_keyframes": f"WITH {_KIS} SELECT query_id, rank, keyframe_uid, round(score, 9) AS score FROM shown",
    "cosine_topk": """WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS item_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s)
SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "l2_normalize": """WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS l FROM embeddings)
SELECT vec_id, round(e[1] / l, 6) AS first, round(sqrt(list_sum(list_transform(e, lambda x: (x / l) * (x / l)))), 6) AS length FROM n""",
    "vector_validation": """WITH f AS (
  SELECT embedding AS e, embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AS good FROM keyframe_vectors
), n AS (SELECT *, CASE WHEN good THEN sqrt(coalesce(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE)), 0.0::DOUBLE)) END AS l FROM f)
SELECT count(*) AS n_vectors, count(*) FILTER (e IS NULL) AS n_null, CAST(min(len(e)) AS INTEGER) AS min_dim, CAST(max(len(e)) AS INTEGER) AS max_dim,
       count(*) FILTER (len(e) <> 48) AS n_wrong_dim, count(*) FILTER (len(list_filter(e, lambda x: isnan(x))) > 0) AS n_nan, count(*) FILTER (len(list_filter(e, lambda x: isinf(x))) > 0) AS n_inf,
       count(*) FILTER (l = 0) AS n_zero, round(min(l), 6) AS min_norm, round(max(l), 6) AS max_norm, coalesce(bool_and(abs(l - 1) < 0.001) FILTER (l > 0), FALSE) AS normalized FROM n""",
    "bm25_topk": f"""WITH {_TERMS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "bm25_best_per_key": f"""WITH {_TERMS}, k AS (
  SELECT query_id, key, doc_id, score, row_number() OVER (PARTITION BY query_id, key ORDER BY score DESC, doc_id) AS b FROM scores JOIN docs USING (doc_id) WHERE key IS NOT NULL
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INTEGER) AS rank FROM k WHERE b = 1)
SELECT query_id, key, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "bm25_df": """WITH d AS (SELECT DISTINCT record_id AS doc_id, text FROM ocr_records), t AS (
  SELECT doc_id, unnest(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS term, len(regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS length FROM d)
SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, term, length FROM t) GROUP BY 1""",
    "token_counts": """WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(coalesce(text, '')), 'ß', 'ss'), '[\\p{L}\\p{N}_]+') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS INTEGER) AS n_tokens, CAST(len(list_distinct(w)) AS INTEGER) AS n_distinct FROM t""",
    "representative_keyframe": """SELECT video_id, arg_min(keyframe_uid, (timestamp_sec, keyframe_uid)) AS keyframe_uid FROM keyframes
WHERE original_frame_id IS NOT NULL AND isfinite(timestamp_sec) AND video_id IS NOT NULL GROUP BY 1""",
    "metadata_documents": """SELECT video_id, concat_ws(' ', CASE WHEN trim(min(container)) <> '' THEN 'box: ' || trim(min(container)) END, CASE WHEN trim(min(video_codec)) <> '' THEN 'codec: ' || trim(min(video_codec)) END,
  CASE WHEN trim(min(group_id)) <> '' THEN 'group: ' || trim(min(group_id)) END) AS document FROM videos WHERE video_id IS NOT NULL GROUP BY 1""",
    "candidate_video_evidence": f"WITH {_EVIDENCE} SELECT query_id, rank, video_id, matched_events, round(evidence_score, 6) AS evidence_score, n_candidates FROM chosen WHERE rank <= 100",
    "trake_paths": f"WITH {_EVENTS}, {_paths('events')} SELECT query_id, video_id, frame_ids, uids, round(total, 8) AS total, round(penalty, 8) AS penalty FROM l2",
    "trake_paths_gapped": f"WITH {_EVENTS}, {_paths('events', True)} SELECT query_id, video_id, frame_ids, uids, round(total, 8) AS total, round(penalty, 8) AS penalty FROM l2",
    "trake_sequences": f"WITH {_SEQUENCES} SELECT query_id, video_id, frame_ids, round(total, 8) AS total FROM final WHERE rank <= 100",
    "frame_diversity": f"WITH {_DIVERSE} SELECT query_id, rank, video_id, frame_id, score FROM diverse",
    "sequence_diversity": f"""WITH {_EVENTS}, {_paths('events')}, sq AS (SELECT query_id, video_id, frame_ids, max(round(total, 8)) AS s FROM l2 GROUP BY ALL),
folded AS ({_greedy("sq", "query_id, video_id", "{'s': s, 'f': frame_ids}", "s DESC, frame_ids", "STRUCT(s DOUBLE, f BIGINT[])",
    "abs(k.f[1] - x.f[1]) <= 15 AND abs(k.f[2] - x.f[2]) <= 15 AND abs(k.f[3] - x.f[3]) <= 15", "20")}), r AS (
  SELECT query_id, video_id, x.f AS frame_ids, x.s AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x.s DESC, video_id, x.f) AS INTEGER) AS rank FROM folded)
SELECT query_id, rank, video_id, frame_ids, score FROM r WHERE rank <= 100""",
    "rank_metrics": _SCORES,
    "qna_metrics": f"{_SCORES} WHERE task = 'qna'",
    "trake_metrics": f"{_SCORES} WHERE task = 'trake'",
    "task_metrics": f"""WITH {_METRICS} SELECT task, count(*) AS n_queries, {", ".join(f"round(avg({c}), 9) AS {c}" for c in ("r_at_1", "r_at_5", "r_at_20", "r_at_50", "r_at_100", "final_score"))}
FROM metrics GROUP BY 1""",
    "submission_violations": f"""WITH {_FUSED_FRAMES}, k AS (
  SELECT query_id, rank, video_id AS v, original_frame_id AS f, rank % 13 AS k, CAST(substr(query_id, 2, 8) AS INTEGER) AS q FROM ff
), sub AS (
  SELECT query_id, rank, q, CASE WHEN k = 0 THEN 'other' WHEN k IN (5, 6) THEN 'kis' WHEN k = 7 THEN 'qna' WHEN k IN (8, 10) THEN 'trake' WHEN q % 3 = 0 THEN 'qna' ELSE 'kis' END AS task,
         CASE WHEN k = 1 THEN 'NOPE' WHEN k = 9 THEN 'L01_V001' ELSE v END AS video_id,
         CASE k WHEN 2 THEN [f + 1000000000] WHEN 3 THEN [-1] WHEN 4 THEN [] WHEN 5 THEN [f, f + 1] WHEN 8 THEN [f, f - 2] WHEN 9 THEN [7] WHEN 10 THEN [f, f + 1] ELSE [f] END AS frames, k
  FROM k
), s AS (SELECT *, CASE WHEN k = 6 THEN 'x' WHEN k = 7 THEN ' ' WHEN task = 'qna' THEN 'five' END AS answer, row_number() OVER (PARTITION BY query_id, video_id, frames ORDER BY rank) > 1 AS again FROM sub
), inv AS (SELECT video_id, max(frame_count) AS n FROM videos GROUP BY 1
), j AS (SELECT s.*, inv.video_id IS NOT NULL AS known, inv.n, q % 5 <> 4 AS due, CASE WHEN q % 3 = 0 THEN 'qna' ELSE 'kis' END AS due_task FROM s LEFT JOIN inv ON inv.video_id = s.video_id
), p AS (
  SELECT 'unknown task' AS problem FROM j WHERE task NOT IN ('kis', 'qna', 'trake')
  UNION ALL SELECT 'unknown video' FROM j WHERE NOT known
  UNION ALL SELECT 'frame outside the video' FROM j WHERE len(list_filter(frames, lambda x: x >= n)) > 0
  UNION ALL SELECT 'no valid frame' FROM j WHERE len(frames) = 0 OR len(list_filter(frames, lambda x: x < 0)) > 0
  UNION ALL SELECT 'needs exactly one frame' FROM j WHERE task IN ('kis', 'qna') AND len(frames) <> 1
  UNION ALL SELECT 'must not have an answer' FROM j WHERE task <> 'qna' AND answer IS NOT NULL
  UNION ALL SELECT 'needs an answer' FROM j WHERE task = 'qna' AND trim(coalesce(answer, '')) = ''
  UNION ALL SELECT 'frames must increase' FROM j WHERE task = 'trake' AND len(frames) > 1 AND frames[1] >= frames[2]
  UNION ALL SELECT 'duplicate' FROM j WHERE again
  UNION ALL SELECT 'query is not in the ground truth' FROM j WHERE NOT due
  UNION ALL SELECT 'wrong task' FROM j WHERE due AND task <> due_task
  UNION ALL SELECT 'wrong number of frames' FROM j WHERE due AND task = 'trake' AND len(frames) <> 3
  UNION ALL SELECT 'too many results' FROM (SELECT query_id FROM s GROUP BY 1 HAVING count(*) > 100)
  UNION ALL SELECT 'several tasks' FROM (SELECT query_id FROM s GROUP BY 1 HAVING count(DISTINCT task) > 1))
SELECT problem, count(*) AS n FROM p GROUP BY 1""",
    "submission_documents": f"""WITH {_DIVERSE}, j AS (
  SELECT query_id, {_TASK} AS task, rank, CASE {_TASK} WHEN 'trake' THEN '{{"video_id":"' || video_id || '","frame_ids":[' || frame_id || ',' || (frame_id + 30) || ',' || (frame_id + 900) || ']}}'
    ELSE '{{"video_id":"' || video_id || '","frame_id":' || frame_id || CASE WHEN {_TASK} = 'qna' THEN ',"answer":"' || ['Năm', '5 people', ' five! ', 'six'][1 + frame_id % 4] || '"}}' ELSE '}}' END END AS o FROM diverse
), d AS (SELECT query_id, task, '{{"query_id":"' || query_id || '","task":"' || task || '","results":[' || string_agg(o, ',' ORDER BY rank) || ']}}' AS json FROM j GROUP BY query_id, task)
SELECT query_id, task, CAST(length(json) AS INTEGER) AS n_chars, substr(sha256(query_id), 1, 16) AS artifact FROM d""",
    "mapping_validation": f"""WITH {_BOUNDS}
SELECT 'matched' AS metric, count(*) AS n FROM kfs WHERE EXISTS (SELECT 1 FROM maps m WHERE m.video_id = kfs.video_id AND m.keyframe_index = kfs.keyframe_index)
UNION ALL SELECT 'missing_mapping', count(*) FROM kfs WHERE NOT EXISTS (SELECT 1 FROM maps m WHERE m.video_id = kfs.video_id AND m.keyframe_index = kfs.keyframe_index)
UNION ALL SELECT 'missing_image', count(*) FROM maps m WHERE NOT EXISTS (SELECT 1 FROM kfs WHERE m.video_id = kfs.video_id AND m.keyframe_index = kfs.keyframe_index)
UNION ALL SELECT 'unknown_video', count(*) FROM maps WHERE video_id NOT IN (SELECT video_id FROM vids)
UNION ALL SELECT 'invalid_frame', (SELECT count(*) FROM outside) + (SELECT count(*) FROM late)
UNION ALL SELECT 'duplicate_index', count(*) FROM (SELECT 1 FROM maps GROUP BY video_id, keyframe_index HAVING count(*) > 1)
UNION ALL SELECT 'duplicate_frame', count(*) FROM (SELECT 1 FROM maps GROUP BY video_id, original_frame_id HAVING count(*) > 1)
UNION ALL SELECT 'non_monotonic', count(*) FROM falling""",
    "mapping_duplicates": f"WITH {_VIDEOS} SELECT video_id, original_frame_id, count(*) AS n FROM maps GROUP BY ALL HAVING count(*) > 1",
    "mapping_non_monotonic": f"WITH {_VIDEOS} SELECT video_id FROM falling",
    "mapping_summary": f"""WITH {_VIDEOS}, k AS (SELECT video_id, count(*) AS n, count(*) FILTER (has_mapping) AS m FROM kfs GROUP BY 1), c AS (SELECT video_id, count(*) AS n FROM maps GROUP BY 1)
SELECT video_id, coalesce(k.n, 0) AS n_keyframes, coalesce(c.n, 0) AS n_mappings, coalesce(k.m, 0) AS n_matched, coalesce(k.n, 0) - coalesce(k.m, 0) AS n_missing,
       video_id NOT IN (SELECT video_id FROM falling) AS monotonic FROM k FULL JOIN c USING (video_id)""",
    "mapped_keyframes": f"""WITH {_VIDEOS}, o AS (SELECT video_id, keyframe_index, max(original_frame_id) AS f FROM maps GROUP BY ALL)
SELECT kfs.video_id, count(*) AS n, count(f) AS n_mapped, round(max(CASE WHEN fps > 0 AND NOT isnan(f / fps) THEN f / fps END), 6) AS last_sec
FROM kfs LEFT JOIN o ON o.video_id = kfs.video_id AND o.keyframe_index = kfs.keyframe_index LEFT JOIN vids v ON v.video_id = kfs.video_id GROUP BY 1""",
    "keyframe_gaps": """WITH f AS (SELECT video_id, max(fps) AS fps FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ingested_at DESC NULLS LAST, load_id DESC NULLS LAST, fps DESC NULLS LAST) AS r FROM videos WHERE video_id IS NOT NULL) WHERE r = 1) WHERE fps > 0 GROUP BY 1
), m AS (SELECT DISTINCT video_id, keyframe_index, original_frame_id FROM keyframes WHERE original_frame_id IS NOT NULL
), g AS (SELECT video_id, original_frame_id - lag(original_frame_id) OVER (PARTITION BY video_id ORDER BY keyframe_index, original_frame_id) AS d FROM m WHERE video_id IS NOT NULL AND keyframe_index IS NOT NULL)
SELECT video_id, count(*) AS n, round(min(d / fps), 6) AS min_gap, round(max(d / fps), 6) AS max_gap FROM g JOIN f USING (video_id) WHERE d IS NOT NULL GROUP BY 1""",
    "numeric_profiles": """WITH u AS (
  SELECT 'fps' AS column_name, fps AS v FROM videos UNION ALL SELECT 'frame_count', frame_count::DOUBLE FROM videos UNION ALL SELECT 'duration_sec', duration_sec FROM videos
  UNION ALL SELECT 'bitrate', bitrate::DOUBLE FROM videos)
SELECT column_name, count(*) AS n_values, round(min(v), 7) AS min_value, round(avg(v), 7) AS mean_value, round(max(v), 7) AS max_value, round(quantile_cont(v, 0.1), 7) AS p10,
       round(quantile_cont(v, 0.5), 7) AS p50, round(quantile_cont(v, 0.9), 7) AS p90, round(quantile_cont(v, 0.95), 7) AS p95 FROM u WHERE isfinite(v) GROUP BY 1""",
    "value_distribution": """WITH u AS (
  SELECT unnest([{'c': 'video_codec', 'v': video_codec}, {'c': 'audio_codec', 'v': audio_codec}, {'c': 'container', 'v': container}, {'c': 'group_id', 'v': group_id},
                 {'c': 'audio_sample_rate', 'v': audio_sample_rate::VARCHAR}]) AS e FROM videos)
SELECT e.c AS column_name, e.v AS value, count(*) AS n FROM u WHERE e.v IS NOT NULL AND e.v NOT IN ('', 'N/A') GROUP BY ALL""",
    "group_durations": f"""WITH {_VIDEOS}
SELECT group_id, FALSE AS is_total, count(*) AS n_videos, round(sum(CASE WHEN isfinite(duration_sec) THEN duration_sec END) / 3600, 6) AS hours FROM vids WHERE group_id IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, TRUE, count(*), round(sum(CASE WHEN isfinite(duration_sec) THEN duration_sec END) / 3600, 6) FROM vids""",
    "video_checks": f"""WITH {_VIDEOS}, c AS (
  SELECT *, coalesce(isfinite(fps) AND fps > 0, FALSE) AS f, coalesce(isfinite(duration_sec) AND duration_sec > 0, FALSE) AS d, coalesce(is_readable, FALSE) AS r FROM vids)
SELECT video_id, 'unreadable' AS problem FROM c WHERE NOT r
UNION ALL SELECT video_id, 'invalid geometry' FROM c WHERE r AND NOT (f AND d AND coalesce(width > 0, FALSE) AND coalesce(height > 0, FALSE))
UNION ALL SELECT video_id, 'duration mismatch' FROM c WHERE f AND d AND frame_count > 0 AND abs(frame_count / fps - duration_sec) > 1.0""",
    "id_differences": _differences(),
    "frames_in_windows": f"""WITH {_VIDEOS}, u AS (SELECT unnest([1, 2, 3]) AS s, fps FROM vids), w AS (SELECT 'plus_minus_' || s || '_sec' AS "window", fps * 2 * s AS v FROM u WHERE isfinite(fps))
SELECT "window", count(*) AS n_values, round(min(v), 6) AS min_value, round(avg(v), 6) AS mean_value, round(max(v), 6) AS max_value, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95
FROM w WHERE isfinite(v) GROUP BY 1""",
    "json_profile": """WITH e AS (SELECT props, unnest(json_keys(props)) AS field FROM events WHERE json_type(props) = 'OBJECT'
), f AS (
  SELECT field, 'number' AS type, FALSE AS empty FROM e WHERE json_type(props, '$.' || field) <> 'NULL' UNION ALL SELECT field, 'null', TRUE FROM e WHERE json_type(props, '$.' || field) = 'NULL'
  UNION ALL SELECT 'video_id', CASE WHEN video_id IS NULL THEN 'null' ELSE 'string' END, coalesce(video_id, '') = '' FROM videos
  UNION ALL SELECT 'size', 'object', FALSE FROM videos UNION ALL SELECT 'codecs', 'array', video_codec IS NULL AND audio_codec IS NULL FROM videos
  UNION ALL SELECT 'has_audio', CASE WHEN has_audio IS NULL THEN 'null' ELSE 'boolean' END, has_audio IS NULL FROM videos
  UNION ALL SELECT 'frame_count', CASE WHEN frame_count IS NULL THEN 'null' ELSE 'number' END, frame_count IS NULL FROM videos
  UNION ALL SELECT 'count', CASE WHEN frame_count % 5 = 0 THEN 'string' ELSE 'null' END, coalesce(frame_count % 5 <> 0, TRUE) FROM videos
  UNION ALL SELECT 'group_id', 'string', coalesce(group_id, '') = '' FROM videos
), n AS (SELECT (SELECT count(*) FROM events WHERE json_type(props) = 'OBJECT') + (SELECT count(*) FROM videos) AS n)
SELECT field, type, count(*) AS n_present, round(sum(count(*)) OVER (PARTITION BY field) / max(n), 6) AS presence_rate, count(*) FILTER (empty) AS n_empty FROM f, n GROUP BY field, type""",
    "storage_by_component": """WITH f AS (SELECT 'keyframes' AS component, file_size_bytes AS b FROM keyframes UNION ALL SELECT 'videos', file_size_bytes FROM videos)
SELECT component, count(*) AS n_files, CAST(sum(b) AS BIGINT) AS total_bytes, count(*) FILTER (b = 0) AS n_empty, max(b) AS largest FROM f GROUP BY 1""",
    "largest_files": """SELECT video_path AS path, max(file_size_bytes) AS length FROM videos WHERE file_size_bytes IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "source_sheet_check": """WITH s AS (
  SELECT coalesce('Videos_' || video_id || '.zip', '') AS f, coalesce(CASE WHEN frame_count % 7 = 0 THEN 'ftp://host/' || video_id ELSE 'https://host.example/' || video_id END, '') AS u FROM videos
), c AS (SELECT *, row_number() OVER (PARTITION BY f, u) AS r FROM s WHERE f <> '' OR u <> '')
SELECT 'videos' AS category, CASE WHEN f = '' OR u = '' THEN 'empty field' WHEN u LIKE 'ftp%' THEN 'invalid address' WHEN r > 1 THEN 'repeated' END AS rejected, count(*) AS n FROM c GROUP BY ALL""",
    "path_fields": """WITH p AS (SELECT DISTINCT keyframe_path FROM keyframes WHERE keyframe_path IS NOT NULL), x AS (
  SELECT keyframe_path, upper(regexp_extract(keyframe_path, '(?i)L\\d+_V\\d+')) AS v, upper(regexp_extract(keyframe_path, '(?i)L\\d+')) AS g,
         CAST(regexp_extract(keyframe_path, '(\\d+)\\.[^./]+$', 1) AS BIGINT) AS i FROM p)
SELECT keyframe_path, nullif(v, '') AS video_id, nullif(g, '') AS group_id, i AS keyframe_index, concat_ws(':', nullif(v, ''), lpad(i::VARCHAR, greatest(6, length(i::VARCHAR))::INTEGER, '0')) AS keyframe_uid FROM x""",
    "frame_windows": f"""WITH {_VIDEOS}, n AS (SELECT video_id, fps, frame_count, frame_count // 2 AS center FROM vids WHERE frame_count IS NOT NULL AND fps IS NOT NULL
), wins AS (SELECT *, greatest(0, center - round_even(fps, 0)::BIGINT) AS a, least(frame_count - 1, center + round_even(fps, 0)::BIGINT) AS b FROM n WHERE center >= 0 AND fps > 0 AND isfinite(fps) AND frame_count >= 1 AND center < frame_count
), {_even()}
SELECT n.video_id, CASE WHEN a IS NOT NULL THEN list_sort(list_distinct(list_concat(range(a, b + 1, greatest(1, round_even(m.fps / 4.0, 0)::BIGINT)), [a, m.center, b]))) END AS sparse,
       CAST(b - a + 1 AS INTEGER) AS n_dense,
       CASE WHEN a IS NULL THEN NULL WHEN b - a + 1 <= 8 THEN range(a, b + 1)
            ELSE list_sort(list_concat(mv, list_slice(list_sort(list_filter(range(a, b + 1), lambda y: NOT list_contains(mv, y))), 1, 8 - len(mv)))) END AS even
FROM n LEFT JOIN m USING (video_id)""",
    "fractions": f"WITH {_VIDEOS} SELECT video_id, CASE WHEN isfinite(fps) THEN round(CAST(round(fps * 1000) AS BIGINT) / 1000, 6) END AS fps FROM vids",
    "answer_forms": """SELECT * FROM (VALUES (0, '5'), (1, '5'), (2, '5'), (3, 'yes'), (4, 'no'), (5, 'blue'), (6, 'blue'), (7, '5'), (8, 'nguyen van a'), (9, '7'), (10, 'red'), (11, 'no'), (12, NULL)) t(id, answer)""",
    "event_lists": """SELECT * FROM (VALUES (0, 0, 'a man opens a door'), (0, 1, 'he sits down'), (0, 2, 'he leaves'), (1, 0, 'first'), (1, 1, 'second'), (1, 2, 'third'), (2, 0, 'a'), (2, 1, 'b'), (2, 2, 'c'),
(3, 0, 'a'), (3, 1, 'b'), (4, 0, 'one'), (4, 1, 'two'), (4, 2, 'three'), (5, 0, 'someone (1) only in brackets'), (6, 0, 'prose with one (2) number'), (7, 0, 'spaced out')) t(query_id, event_index, text)""",
    "refined_frames": f"""WITH {_REFINE}
SELECT c.query_id, c.keyframe_uid, sf AS sparse_frame_id, rf AS refined_frame_id, round(ls, 6) AS local_score, CASE WHEN c.error IS NULL THEN 'refined' ELSE 'failed' END AS refinement_status, c.error
FROM checked c LEFT JOIN refined r USING (query_id, keyframe_uid)""",
    "refinement_overlay": f"""WITH {_REFINE}, shown AS (SELECT query_id, keyframe_uid FROM ff WHERE rank <= 100)
SELECT e.query_id, count(r.rf) AS n_refined, count(*) - count(r.rf) AS n_fallback, count(*) FILTER (c.error IS NOT NULL) AS n_failed
FROM shown e LEFT JOIN refined r USING (query_id, keyframe_uid) LEFT JOIN checked c USING (query_id, keyframe_uid) GROUP BY 1""",
    "asr_best_keyframe": """WITH seg AS (
  SELECT DISTINCT segment_id, upper(trim(video_id)) AS video_id, start_sec + (end_sec - start_sec) / 2 AS mid FROM asr_segments
), kf AS (SELECT DISTINCT keyframe_uid, video_id, timestamp_sec AS t FROM keyframes WHERE original_frame_id IS NOT NULL AND isfinite(timestamp_sec)
), pairs AS (SELECT segment_id, seg.video_id, keyframe_uid, abs(t - mid) AS d, row_number() OVER (PARTITION BY segment_id, seg.video_id, mid ORDER BY abs(t - mid), keyframe_uid) AS r
  FROM seg JOIN kf ON kf.video_id = seg.video_id WHERE isfinite(mid))
SELECT segment_id, video_id, keyframe_uid, round(d, 6) AS distance_sec FROM pairs WHERE r = 1""",
}
#: Parts that the queries of readers and writers share.
SHOWN_METRICS = {"diverse": _DIVERSE, "metrics": _METRICS, "task": _TASK}
