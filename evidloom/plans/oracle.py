"""The same queries in SQL for another engine, over the same tables: what the catalogue's results are held against."""

from __future__ import annotations

WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[ً-ْٰـ]', '', 'g'), '{WS}+', ' ', 'g'))"


def toks(x: str) -> str:
    return f"list_filter(string_split({norm(x)}, ' '), lambda t: t <> '')"


def seg(x: str) -> str:
    cut = f"string_split(regexp_replace(coalesce({x}, ''), '([.!?؟]+)({WS}|$)', '\\1' || chr(1) || '\\2', 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR regexp_matches({x}, '^{WS}*$'))"


def start(x: str) -> str:
    return f"try_cast(regexp_extract({x}, '^.*:(\\d+)-(\\d+)$', 1) AS BIGINT)"


def end(x: str) -> str:
    return f"try_cast(regexp_extract({x}, '^.*:(\\d+)-(\\d+)$', 2) AS BIGINT)"


def iou(a: str, b: str) -> str:
    inter = f"greatest(0, least({end(a)}, {end(b)}) - greatest({start(a)}, {start(b)}) + 1)::DOUBLE"
    both = f"({end(a)} - {start(a)} + 1 + {end(b)} - {start(b)} + 1)"
    return f"CASE WHEN {start(a)} IS NULL OR {end(a)} IS NULL OR {start(b)} IS NULL OR {end(b)} IS NULL OR {both} - {inter} <= 0 THEN 0.0::DOUBLE ELSE {inter} / ({both} - {inter}) END"


CHUNKS = "chunks AS (SELECT DISTINCT * FROM wikipedia_chunks)"
VER = """ver AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY found DESC NULLS LAST, verified_at DESC NULLS LAST, ingested_at DESC NULLS LAST, resolution_notes DESC NULLS LAST) rn
  FROM (SELECT DISTINCT * FROM source_verification)) WHERE rn = 1)"""
LOCATED = """g AS (SELECT final_id, source, gold_chunk_id, gold_match_type, judgement, "type", split FROM localization QUALIFY row_number() OVER (PARTITION BY final_id, source ORDER BY gold_chunk_id DESC NULLS LAST, gold_match_type DESC NULLS LAST, judgement DESC NULLS LAST, "type" DESC NULLS LAST, split DESC NULLS LAST) = 1),
t AS (SELECT final_id, source, claim, evidence, reasoning FROM arafa QUALIFY row_number() OVER (PARTITION BY final_id, source ORDER BY claim DESC NULLS LAST, evidence DESC NULLS LAST, reasoning DESC NULLS LAST) = 1),
located AS (SELECT * FROM g JOIN t USING (final_id, source))"""

CONTAIN = f"""CASE WHEN len(list_distinct({toks('claim')})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({toks('claim')}), list_distinct({toks('evidence')})))::DOUBLE / len(list_distinct({toks('claim')})) END"""


def bm25(text: str, tag: str = "") -> str:
    """CTEs: the scores of all chunks of each claim's article, ranked; needs chunks and located."""
    return f"""
ct{tag} AS (SELECT source, ord, chunk_id, {toks('text')} tk FROM chunks),
st{tag} AS (SELECT source, count(*)::DOUBLE n, avg(len(tk)) avgdl FROM ct{tag} GROUP BY source),
tf{tag} AS (SELECT source, ord, term, dl, count(*)::DOUBLE tf FROM (SELECT source, ord, unnest(tk) term, len(tk)::DOUBLE dl FROM ct{tag}) GROUP BY ALL),
df{tag} AS (SELECT source, term, count(*)::DOUBLE df FROM tf{tag} GROUP BY ALL),
w{tag} AS (SELECT source, ord, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) weight FROM tf{tag} JOIN df{tag} USING (source, term) JOIN st{tag} USING (source)),
qt{tag} AS (SELECT final_id, source, term, count(*)::DOUBLE q FROM (SELECT final_id, source, unnest({toks(text)}) term FROM located) GROUP BY ALL),
sc{tag} AS (SELECT final_id, source, ord, round(sum(q * weight), 6) score FROM qt{tag} JOIN w{tag} USING (source, term) GROUP BY ALL),
rk{tag} AS (SELECT final_id, source, chunk_id, ord, coalesce(score, 0) score, row_number() OVER (PARTITION BY final_id, source ORDER BY coalesce(score, 0) DESC, ord DESC) rk
  FROM (SELECT DISTINCT final_id, source FROM located WHERE len({toks(text)}) > 0) JOIN ct{tag} USING (source) LEFT JOIN sc{tag} USING (final_id, source, ord))"""


def ranks(text: str = "claim", tag: str = "") -> str:
    """CTE ranks: rank of each claim's gold chunk among the best 50."""
    return f"""{bm25(text, tag)},
ranks AS (SELECT l.final_id, l.source, l.gold_chunk_id, max(r.rk) FILTER (r.rk <= 50) AS rank FROM located l LEFT JOIN rk{tag} r ON r.final_id = l.final_id AND r.source = l.source AND r.chunk_id = l.gold_chunk_id GROUP BY ALL)"""


def recalls(rank: str = "rank") -> str:
    r = [f"round(avg(CASE WHEN {rank} <= {k} THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_at_{k}" for k in (1, 5, 10)]
    return ", ".join([*r, f"round(avg(coalesce(1.0::DOUBLE / {rank}, 0.0)), 4) AS mrr"])


def windows(sents: str, sizes: str, key: str = "source") -> str:
    """SELECT of all windows of the given sizes over a CTE s(key, sents)."""
    return f"""SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY k, i) - 1)::INTEGER AS ord, {key}::VARCHAR || ':' || i || '-' || (i + k - 1) AS chunk_id, i::INTEGER AS sentence_start, (i + k - 1)::INTEGER AS sentence_end,
  k::INTEGER AS window_size, array_to_string(sents[i + 1 : i + k], ' ') AS text
FROM (SELECT {key}, {sents} sents, unnest({sizes}) k FROM s), LATERAL (SELECT unnest(range(0, len(sents) - k + 1)) i) WHERE len(sents) >= k"""


EXAMPLES = f"""
one AS (SELECT DISTINCT source, sentence_start, text FROM chunks WHERE window_size = 1),
sen AS (SELECT source, list(text ORDER BY sentence_start, text) sents FROM one GROUP BY source HAVING count(*) = max(sentence_start) + 1 AND min(sentence_start) = 0),
ex AS (SELECT *, array_to_string(sents[gs + 1 : ge + 1], ' ') gold_text FROM (SELECT final_id, source, claim, sents, {start('gold_chunk_id')}::INTEGER gs, {end('gold_chunk_id')}::INTEGER ge FROM located JOIN sen USING (source))
  WHERE gs IS NOT NULL AND gs <= ge AND ge < len(sents) AND array_to_string(sents[gs + 1 : ge + 1], ' ') <> '')"""


def crop_range(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN [] WHEN {n} <= 6 THEN [0] ELSE range(0, (ceil(({n} - 6) / 3.0)::INTEGER * 3) + 1, 3) END"


CENTER = """gc AS (SELECT *, greatest(0, gs - greatest(0, 6 - (ge - gs + 1)) // 2) s0 FROM ex),
gd AS (SELECT *, least(len(sents), greatest(s0 + 6, ge + 1)) e0 FROM gc),
ge2 AS (SELECT *, least(greatest(0, least(s0, e0 - least(6, e0))), gs) c0 FROM gd)"""

GOLD_IN = """(CASE WHEN gs = c0 THEN 0 ELSE length(array_to_string(sents[c0 + 1 : gs], ' ')) + 1 END)::INTEGER"""

BIG = "CAST({} AS BIGINT)"

SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {norm('text')} AS norm FROM documents",
    "blank_texts": f"SELECT doc_id, {blank('text')} AS blank FROM documents",
    "segment_sentences": f"SELECT doc_id, (unnest(range(1, len(s) + 1)) - 1)::INTEGER AS i, unnest(s) AS sentence FROM (SELECT doc_id, {seg('text')} s FROM documents)",
    "token_stats": f"SELECT doc_id, len({toks('text')})::INTEGER AS n_tokens, len(list_distinct({toks('text')}))::INTEGER AS n_distinct, sha256(text) AS sha256, substring(text, 1, 80) AS preview FROM documents",
    "token_f1": f"""WITH {LOCATED}, x AS (SELECT final_id, source, claim, evidence, {toks('claim')} p, {toks('evidence')} g FROM located),
      y AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(g, lambda b: b = w))))), 0)::DOUBLE k FROM x)
      SELECT final_id, source, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2 * (k / len(p)) * (k / len(g)) / (k / len(p) + k / len(g)) END, 4)::DOUBLE AS f1, ({norm('evidence')} <> '' AND {norm('claim')} = {norm('evidence')}) AS exact FROM y""",
    "chunk_spans": f"SELECT DISTINCT chunk_id, {start('chunk_id')} AS s, {end('chunk_id')} AS e FROM wikipedia_chunks",
    "span_iou": f"WITH {LOCATED} SELECT source, gold_chunk_id, chunk_id, round({iou('chunk_id', 'gold_chunk_id')}, 6) AS iou FROM (SELECT DISTINCT source, gold_chunk_id FROM located) JOIN (SELECT DISTINCT source, chunk_id FROM wikipedia_chunks) USING (source)",
    "html_title": f"""SELECT source, nullif({strip("string_split(title, ' - ')[1]")}, '') AS title FROM (SELECT source, ' ' || coalesce(title, '') || ' - Wiki, the encyclopedia' AS title FROM articles)""",
    "model_inputs": f"WITH {LOCATED} SELECT final_id, source, 'query: ' || claim AS query, 'passage: ' || evidence AS passage, array_to_string({toks('claim')}[1:8], ' ') AS clipped FROM located",
    "sentence_windows": f"WITH s AS (SELECT source, {seg('text')} sents FROM articles) {windows('sents', '[1, 2, 3]')}",
    "windows_fixed_size": f"WITH s AS (SELECT source, {seg('text')} sents FROM articles) {windows('sents', '[2]')}",
    "corpus_flatten_dedup": f"WITH f AS (SELECT text, min(doc_id) source FROM documents WHERE coalesce(text, '') <> '' AND doc_id NOT IN (SELECT item_id FROM eval_items) GROUP BY text), s AS (SELECT source, {seg('text')} sents FROM f) {windows('sents', '[1]')}",
    "sliding_crops": f"SELECT source, (i // 3)::INTEGER AS i, i::INTEGER AS crop_start, least(i + 6, n)::INTEGER AS crop_end FROM (SELECT source, n, unnest({crop_range('n')}) i FROM (SELECT source, len({seg('text')}) n FROM articles))",
    "sentence_offsets": f"""WITH s AS (SELECT source, {seg('text')} sents FROM articles)
      SELECT source, i::INTEGER AS i, (CASE WHEN i < len(sents) THEN coalesce(list_sum(list_transform(sents[1:i], lambda x: length(x) + 1)), 0) ELSE greatest(coalesce(list_sum(list_transform(sents, lambda x: length(x) + 1)), 0) - 1, 0) END)::INTEGER AS at
      FROM (SELECT source, sents, unnest(range(0, len(sents) + 1)) i FROM s)""",
    "char_to_sentence": f"""WITH s AS (SELECT source, {seg('text')} sents FROM articles), o AS (SELECT source, i, len(sents) n, coalesce(list_sum(list_transform(sents[1:i], lambda x: length(x) + 1)), 0) a, coalesce(list_sum(list_transform(sents[1:i+1], lambda x: length(x) + 1)), 0) - (i = len(sents) - 1)::INTEGER b
      FROM (SELECT source, sents, unnest(range(0, len(sents))) i FROM s))
      SELECT source, min(i)::INTEGER AS first_sentence, max(i)::INTEGER AS last_sentence FROM (SELECT DISTINCT source FROM articles) LEFT JOIN (SELECT * FROM o WHERE a < 160 AND b > 40) USING (source) GROUP BY source""",
    "qa_examples": f"WITH {CHUNKS}, {LOCATED}, {EXAMPLES} SELECT final_id, source, gs AS gold_start, ge AS gold_end, len(sents)::INTEGER AS n_sents, gold_text FROM ex",
    "crops_with_gold": f"""WITH {CHUNKS}, {LOCATED}, {EXAMPLES}, c AS (SELECT *, unnest({crop_range('len(sents)')})::INTEGER c0 FROM ex), d AS (SELECT *, least(c0 + 6, len(sents))::INTEGER c1 FROM c)
      SELECT final_id, source, c0 AS crop_start, c1 AS crop_end, {GOLD_IN} AS char_start, ({GOLD_IN} + length(gold_text))::INTEGER AS char_end FROM d WHERE c0 <= gs AND ge < c1""",
    "centered_crops": f"""WITH {CHUNKS}, {LOCATED}, {EXAMPLES}, {CENTER}
      SELECT final_id, source, c0::INTEGER AS crop_start, e0::INTEGER AS crop_end, {GOLD_IN} AS char_start, ({GOLD_IN} + length(gold_text))::INTEGER AS char_end FROM ge2 WHERE c0 <= gs AND ge < e0""",
    "span_summary": f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim')}, tx AS (SELECT DISTINCT source, chunk_id, text FROM chunks),
      x AS (SELECT l.gold_match_type, p.text pt, gt.text gt, l.gold_chunk_id, r.chunk_id FROM located l JOIN rk r ON r.final_id = l.final_id AND r.source = l.source AND r.rk = 1 JOIN tx p ON p.source = r.source AND p.chunk_id = r.chunk_id JOIN tx gt ON gt.source = l.source AND gt.chunk_id = l.gold_chunk_id),
      y AS (SELECT *, {toks('pt')} p, {toks('gt')} g FROM x), z AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda w: least(len(list_filter(p, lambda a: a = w)), len(list_filter(g, lambda b: b = w))))), 0)::DOUBLE k FROM y),
      v AS (SELECT gold_match_type, ({norm('gt')} <> '' AND {norm('pt')} = {norm('gt')}) em, round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN k = 0 THEN 0.0 ELSE 2 * (k / len(p)) * (k / len(g)) / (k / len(p) + k / len(g)) END, 4)::DOUBLE f1, round({iou('chunk_id', 'gold_chunk_id')}, 4) io FROM z)
      SELECT gold_match_type, count(*) AS n, round(avg(em::INTEGER::DOUBLE), 4) AS exact_match, round(avg(f1), 4) AS token_f1, round(avg(io), 4) AS sentence_iou, round(avg((io >= 0.5)::INTEGER::DOUBLE), 4) AS iou_at_half FROM v GROUP BY gold_match_type""",
    "profile_totals": "SELECT count(*) AS records, count(DISTINCT final_id) AS distinct_keys, min(final_id) AS min_key, max(final_id) AS max_key, count(final_id) - count(DISTINCT final_id) AS duplicates FROM arafa",
    "profile_judgements": "SELECT lower(trim(judgement)) AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM arafa), 4) AS pct FROM arafa GROUP BY 1",
    "profile_types": 'SELECT "type" AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM arafa), 4) AS pct FROM arafa GROUP BY 1',
    "profile_crosstab": """SELECT coalesce("type", '(null)') AS "type", coalesce(judgement, '(null)') AS judgement, count(*) AS n FROM arafa GROUP BY 1, 2""",
    "profile_lengths": " UNION ALL ".join(f"""SELECT '{c}' AS field, count(*) AS n, min(length("{c}"))::BIGINT AS min_len, max(length("{c}"))::BIGINT AS max_len, round(avg(length("{c}")), 2) AS mean_len, sum(length("{c}"))::BIGINT AS total_len FROM arafa WHERE "{c}" IS NOT NULL""" for c in ("claim", "evidence", "reasoning", "type")),
    "field_completeness": " UNION ALL ".join(
        f"""SELECT '{c}' AS field, count(*) FILTER (NOT {blank(f'"{c}"')}) AS populated, count(*) FILTER ({blank(f'"{c}"')}) AS null_or_empty, round(100.0::DOUBLE * count(*) FILTER (NOT {blank(f'"{c}"')}) / count(*), 4) AS pct FROM arafa"""
        for c in ("claim", "evidence", "judgement", "reasoning", "entity_in_claim", "co_referenced_in_evidence", "co_referenced_in_text", "type")
    ),
    "json_completeness": " UNION ALL ".join(
        f"""SELECT '{f}' AS field, count(*) FILTER (k AND NOT e) AS populated, count(*) FILTER (k AND e) AS null_or_empty, count(*) FILTER (NOT k) AS missing, round(100.0::DOUBLE * count(*) FILTER (k AND NOT e) / count(*), 4) AS pct
      FROM (SELECT coalesce(list_contains(json_keys(props), '{f}'), false) k, {blank(f"(props::JSON ->> '$.{f}')")} e FROM events)"""
        for f in ("k", "absent")
    ),
    "unexpected_fields": "SELECT field, count(*) AS n FROM (SELECT unnest(list_filter(json_keys(props), lambda k: k <> 'other')) AS field FROM events) GROUP BY field",
    "records_per_source": "SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 2) AS mean_n, median(n)::DOUBLE AS median_n, count(*) AS keys FROM (SELECT source, count(*) n FROM arafa WHERE source IS NOT NULL GROUP BY source)",
    "records_per_customer": "SELECT min(n) AS min_n, max(n) AS max_n, round(avg(n), 2) AS mean_n, median(n)::DOUBLE AS median_n, count(*) AS keys FROM (SELECT o_custkey, count(*) n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey)",
    "top10_sources": "SELECT source, count(*) AS n FROM arafa WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 10",
    "first_seen_sources": "SELECT source, min(final_id) AS first FROM arafa GROUP BY source",
    "verification_counts": f"WITH {VER} SELECT count(*) AS sources, count(*) FILTER (NOT found) AS not_found, count(*) FILTER (resolution_method IS NULL AND NOT found) AS unresolved, count(*) FILTER (error = 'request_failed') AS failed FROM ver",
    "match_type_summary": f"WITH {LOCATED} SELECT gold_match_type AS value, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM located), 4) AS pct FROM located GROUP BY 1",
    "evidence_lengths": f"WITH {LOCATED}, x AS (SELECT gold_match_type, len({seg('evidence')}) n FROM located) SELECT gold_match_type, count(*) AS claims, round(avg(n), 3) AS mean_sentences, count(*) FILTER (n > 3) AS long, round(avg((n > 3)::INTEGER::DOUBLE), 4) AS share_long FROM x GROUP BY 1",
    "verified_left_join": f"WITH {VER} SELECT c.final_id, c.source, coalesce(v.found, false) AS found, v.title, v.url FROM (SELECT DISTINCT final_id, source FROM arafa) c LEFT JOIN ver v ON v.source = c.source",
    "verified_semi": f"WITH {VER} SELECT DISTINCT final_id, source FROM arafa WHERE source IN (SELECT source FROM ver WHERE found)",
    "exclude_known_anti": "SELECT source, title FROM articles WHERE source NOT IN (SELECT source FROM localization WHERE source IS NOT NULL AND gold_match_type = 'exact' AND split = 'val')",
    "update_join": """WITH f AS (SELECT source, max(error) error FROM source_verification WHERE NOT found GROUP BY source), p AS (SELECT source, max(resolved_pageid) resolved_pageid FROM source_verification WHERE resolved_pageid > 0 GROUP BY source)
      SELECT f.source, f.error, p.source IS NOT NULL AS found, p.resolved_pageid FROM f LEFT JOIN p USING (source)""",
    "upsert": f"WITH {VER}, n AS (SELECT source, title FROM ver WHERE title IS NOT NULL) SELECT * FROM n UNION ALL SELECT source, title FROM articles WHERE source NOT IN (SELECT source FROM n)",
    "append_extended": f"""WITH {CHUNKS}, s AS (SELECT source, {seg('text')} sents FROM articles), l AS ({windows('sents', '[4]')})
      SELECT source, ord, chunk_id, window_size FROM chunks UNION ALL SELECT source, ord, chunk_id, window_size FROM l WHERE source IN (SELECT source FROM chunks) AND (source, chunk_id) NOT IN (SELECT source, chunk_id FROM chunks)""",
    "reject_reasons": f"""WITH {CHUNKS}, c AS (SELECT DISTINCT final_id, source, judgement FROM arafa), g AS (SELECT DISTINCT final_id, source, gold_chunk_id, gold_match_type FROM localization), k AS (SELECT DISTINCT source, chunk_id FROM chunks)
      SELECT reason, count(*) AS n FROM (SELECT CASE WHEN coalesce(lower(trim(judgement)), '') NOT IN ('supported', 'refuted') THEN 'not_supported_refuted' WHEN gold_match_type IS NULL THEN 'no_gold' WHEN gold_match_type NOT IN ('exact', 'fuzzy') THEN 'match_' || gold_match_type
        WHEN coalesce(gold_chunk_id, '') = '' THEN 'no_chunk_id' WHEN k.chunk_id IS NULL THEN 'chunk_id_missing' ELSE 'kept' END AS reason
      FROM c LEFT JOIN g USING (final_id, source) LEFT JOIN k ON k.source = c.source AND k.chunk_id = g.gold_chunk_id) GROUP BY reason""",
    "set_differences": "SELECT 'left' AS side, source AS key FROM (SELECT source FROM articles WHERE num_sentences > 10 EXCEPT SELECT source FROM localization WHERE split = 'test') UNION ALL SELECT 'right', source FROM (SELECT source FROM localization WHERE split = 'test' EXCEPT SELECT source FROM articles WHERE num_sentences > 10)",
    "bookkeeping": f"""WITH {VER}, f AS (SELECT DISTINCT source FROM ver WHERE found), c AS (SELECT DISTINCT source FROM articles WHERE coalesce(text, '') <> ''), k AS (SELECT DISTINCT source FROM wikipedia_chunks)
      SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM c) AS cached, (SELECT count(*) FROM k) AS chunked, (SELECT count(*) FROM f WHERE source NOT IN (SELECT source FROM c)) AS found_not_cached, (SELECT count(*) FROM f WHERE source NOT IN (SELECT source FROM k)) AS found_not_chunked""",
    "cache_to_fetch": "SELECT DISTINCT source FROM arafa WHERE source NOT IN (SELECT source FROM articles WHERE coalesce(text, '') <> '' AND num_sentences > 10)",
    "read_through": "SELECT coalesce(a.source, d.doc_id) AS source, length(coalesce(nullif(a.text, ''), d.text))::INTEGER AS n FROM articles a FULL JOIN (SELECT doc_id, text FROM documents WHERE kind = 'article') d ON a.source = d.doc_id",
    "batches": "SELECT item_id // 20 AS batch, count(*) AS n FROM eval_items GROUP BY 1",
    "seeded_sample": "SELECT final_id FROM (SELECT DISTINCT final_id FROM arafa) ORDER BY md5('42:' || final_id::VARCHAR), final_id LIMIT 100",
    "stratified_split": """WITH p AS (SELECT source, count(*) n FROM arafa WHERE source IS NOT NULL GROUP BY source), b AS (SELECT *, CASE WHEN n <= 20 THEN 0 WHEN n <= 50 THEN 1 WHEN n <= 80 THEN 2 ELSE 3 END AS bucket FROM p),
      x AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('42:' || source::VARCHAR), source) - 1 AS i, count(*) OVER (PARTITION BY bucket) AS m FROM b),
      y AS (SELECT *, round_even(m * 0.8::DOUBLE, 0) t0, round_even(m * 0.1::DOUBLE, 0) v0 FROM x), z AS (SELECT *, CASE WHEN m >= 10 AND v0 < 1 THEN 1 ELSE v0 END v FROM y), w AS (SELECT *, CASE WHEN m >= 10 AND m - t0 - v < 1 THEN m - v - 1 ELSE t0 END t FROM z)
      SELECT source, n, bucket::INTEGER AS bucket, CASE WHEN i < t THEN 'train' WHEN i < t + v THEN 'val' ELSE 'test' END AS split FROM w""",
    "split_mix": f"""WITH {LOCATED} SELECT split, count(*) AS claims, count(DISTINCT source) AS articles, count(*) FILTER (lower(trim(judgement)) = 'supported') AS supported, count(*) FILTER (lower(trim(judgement)) = 'refuted') AS refuted,
      count(*) FILTER (gold_match_type = 'exact') AS exact, count(*) FILTER (gold_match_type = 'fuzzy') AS fuzzy FROM located GROUP BY split""",
    "split_leaks": 'SELECT "type", count(DISTINCT split) AS splits FROM localization WHERE split IS NOT NULL GROUP BY "type" HAVING count(DISTINCT split) > 1',
    "evidence_exact_window": f"""WITH {CHUNKS}, e AS (SELECT DISTINCT final_id, source, {norm('evidence')} e FROM arafa WHERE {norm('evidence')} <> ''), c AS (SELECT source, ord, chunk_id, window_size, {norm('text')} t FROM chunks)
      SELECT DISTINCT final_id, source, chunk_id FROM (SELECT final_id, source, e, arg_min(chunk_id, (window_size, ord)) chunk_id FROM e JOIN c USING (source) WHERE contains(t, e) GROUP BY final_id, source, e)""",
    "token_overlap": f"WITH {LOCATED} SELECT final_id, source, round({CONTAIN}, 6)::DOUBLE AS overlap FROM located",
    "bm25_topk": f"WITH {CHUNKS}, {LOCATED}, {bm25('claim')} SELECT final_id, source, chunk_id, score::DOUBLE AS score, rk::INTEGER AS rk FROM rk WHERE rk <= 10",
    "bm25_gold_ranks": f"WITH {CHUNKS}, {LOCATED}, {ranks()} SELECT final_id, source, gold_chunk_id, rank FROM ranks",
    "bm25_metrics": f"WITH {CHUNKS}, {LOCATED}, {ranks()} SELECT count(*) AS n, {recalls()} FROM ranks",
    "bm25_oracle_ceiling": f"WITH {CHUNKS}, {LOCATED}, {ranks('evidence')} SELECT count(*) AS n, {recalls()} FROM ranks",
    "bm25_relaxed_ranks": f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim')}, x AS (SELECT l.final_id, l.source, l.gold_chunk_id, r.chunk_id, r.rk, {iou('r.chunk_id', 'l.gold_chunk_id')} io FROM located l LEFT JOIN rk r ON r.final_id = l.final_id AND r.source = l.source AND r.rk <= 50)
      SELECT final_id, source, gold_chunk_id, min(rk) FILTER (chunk_id = gold_chunk_id) AS rank, coalesce(min(rk) FILTER (chunk_id = gold_chunk_id), min(rk) FILTER (io >= 0.5)) AS rank_relaxed FROM x GROUP BY ALL""",
    "bm25_open_topk": f"""WITH d AS (SELECT doc_id, {toks('text')} tk FROM documents WHERE coalesce(text, '') <> ''), st AS (SELECT count(*)::DOUBLE n, avg(len(tk)) avgdl FROM d), tf AS (SELECT doc_id, term, dl, count(*)::DOUBLE tf FROM (SELECT doc_id, unnest(tk) term, len(tk)::DOUBLE dl FROM d) GROUP BY ALL),
      df AS (SELECT term, count(*)::DOUBLE df FROM tf GROUP BY term), w AS (SELECT doc_id, term, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) weight FROM tf JOIN df USING (term), st),
      q AS (SELECT item_id, term, count(*)::DOUBLE q FROM (SELECT item_id, unnest({toks('text')}) term FROM eval_items WHERE coalesce(text, '') <> '') GROUP BY ALL), s AS (SELECT item_id, doc_id, round(sum(q * weight), 6) score FROM q JOIN w USING (term) GROUP BY ALL)
      SELECT item_id, doc_id, score, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id DESC) rk FROM s) WHERE rk <= 10""",
    "hard_negatives": f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim')}, a AS (SELECT DISTINCT l.final_id, l.source, c.chunk_id FROM located l JOIN chunks c USING (source) WHERE c.chunk_id <> l.gold_chunk_id),
      x AS (SELECT a.*, row_number() OVER (PARTITION BY a.final_id, a.source ORDER BY r.rk NULLS LAST, md5('42:' || a.chunk_id), a.chunk_id) place FROM a LEFT JOIN rk r ON r.final_id = a.final_id AND r.source = a.source AND r.chunk_id = a.chunk_id AND r.rk <= 40)
      SELECT final_id, source, chunk_id, place::INTEGER AS place FROM x WHERE place <= 7""",
    "reranker_pairs": f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim')}, p AS (SELECT DISTINCT l.final_id, l.gold_chunk_id chunk_id, 1 AS label FROM located l JOIN chunks c ON c.source = l.source AND c.chunk_id = l.gold_chunk_id),
      n AS (SELECT r.final_id, r.chunk_id, row_number() OVER (PARTITION BY r.final_id, r.source ORDER BY r.rk) p FROM rk r JOIN located l ON l.final_id = r.final_id AND l.source = r.source WHERE r.rk <= 40 AND r.chunk_id <> l.gold_chunk_id)
      SELECT * FROM p UNION SELECT final_id, chunk_id, 0 FROM n WHERE p <= 4""",
    "dense_topk": """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v FROM e),
      s AS (SELECT q.vec_id, u.vec_id id, round(list_dot_product(q.v, u.v), 6) score FROM u q, u WHERE q.vec_id % 100 = 0 AND q.vec_id <> u.vec_id)
      SELECT vec_id, id, score, rk::INTEGER AS rk FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, id) rk FROM s) WHERE rk <= 10""",
    "dataset_compare": """WITH b AS (SELECT doc_id, text, CASE WHEN doc_id % 50 = 0 THEN 'changed' ELSE title END title, source FROM documents WHERE doc_id % 70 <> 0)
      SELECT a.doc_id AS ord, CASE WHEN b.doc_id IS NULL THEN 'only_left' ELSE 'differs' END AS status, CASE WHEN b.doc_id IS NULL THEN NULL WHEN a.text IS DISTINCT FROM b.text THEN 'text' WHEN a.title IS DISTINCT FROM b.title THEN 'title' ELSE 'source' END AS field
      FROM documents a LEFT JOIN b ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.text IS DISTINCT FROM b.text OR a.title IS DISTINCT FROM b.title OR a.source IS DISTINCT FROM b.source""",
    "content_hash": """WITH l0 AS (SELECT doc_id o, sha256(coalesce(text, chr(0)) || chr(31) || coalesce(title, chr(0)) || chr(31) || coalesce(source, chr(0))) h, 1 k FROM documents),
      l1 AS (SELECT o // 4096 o, sum(k) k, sha256(string_agg(h, chr(10) ORDER BY o, h)) h FROM l0 GROUP BY o // 4096), l2 AS (SELECT o // 4096 o, sum(k) k, sha256(string_agg(h, chr(10) ORDER BY o, h)) h FROM l1 GROUP BY o // 4096)
      SELECT coalesce(sum(k), 0)::BIGINT AS records, sha256(string_agg(h, chr(10) ORDER BY o, h)) AS hash FROM l2""",
    "json_well_formed": "SELECT coalesce(json_valid(props), false) AS well_formed, count(*) AS n FROM events GROUP BY 1",
    "resume_stream": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "p5_found": "SELECT source FROM arafa WHERE source IS NOT NULL GROUP BY source HAVING count(*) > 0.03 * (SELECT count(*) FROM arafa)",
    "p5_sources": """SELECT source, count(*) AS records, sum(length(claim))::BIGINT AS claim_chars, max(length(evidence))::INTEGER AS longest_evidence, count(*) FILTER (lower(trim(judgement)) = 'supported') AS supported,
      count(*) FILTER (lower(trim(judgement)) = 'refuted') AS refuted, count(*) FILTER (lower(trim(judgement)) = 'nei') AS nei FROM arafa GROUP BY source""",
    "resolution_cascade": """SELECT * FROM (VALUES (1::BIGINT, true, 'live', 'Alpha', 1::BIGINT, false), (2, true, 'redirect', 'Beta', 22, false), (3, true, 'title_lookup', 'Gamma', 33, true), (4, true, 'move', 'Delta two', 44, true),
      (5, true, 'merge', 'Epsilon two', 55, true), (6, false, 'deleted', 'Zeta', NULL, true), (7, false, 'wayback_only', NULL, NULL, true), (8, false, 'unresolved', NULL, NULL, false)) t(source, resolved, resolution_method, title, resolved_pageid, wayback_found)""",
}

_OVER = f"WITH {CHUNKS}, {LOCATED}, {ranks()}, o AS (SELECT l.final_id, l.source, l.judgement, round({CONTAIN}, 6)::DOUBLE overlap, r.rank FROM located l JOIN ranks r USING (final_id, source))"
HIT = "round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_at_1"
SQL |= {
    "overlap_bins": f"{_OVER} SELECT b::INTEGER AS bin, count(*) AS n, {HIT} FROM (SELECT *, CASE "
    + " ".join(f"WHEN overlap >= {i / 10}::DOUBLE AND overlap < {1.01 if i == 9 else (i + 1) / 10}::DOUBLE THEN {i}" for i in range(10))
    + " END b FROM o) WHERE b IS NOT NULL GROUP BY b",
    "overlap_quintiles": f"""{_OVER}, x AS (SELECT *, row_number() OVER (ORDER BY overlap, final_id * 10000000000 + source) - 1 i, (SELECT count(*) FROM o) n FROM o), y AS (SELECT *, CASE WHEN i < n // 5 THEN 1 WHEN i < 2 * n // 5 THEN 2 WHEN i < 3 * n // 5 THEN 3 WHEN i < 4 * n // 5 THEN 4 ELSE 5 END q FROM x)
      SELECT q::INTEGER AS quintile, count(*) AS n, round(avg(overlap), 6) AS mean_value, {HIT} FROM y GROUP BY q""",
    "overlap_subgroups": f"{_OVER} SELECT judgement, count(*) AS n, round(avg(overlap), 3) AS mean_overlap FROM o GROUP BY judgement",
    "overlap_slices": f"""{_OVER} SELECT count(*) FILTER (overlap < 0.3::DOUBLE) AS n_low, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (overlap < 0.3::DOUBLE), 4) AS recall_low,
      count(*) FILTER (overlap >= 0.5::DOUBLE) AS n_high, round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (overlap >= 0.5::DOUBLE), 4) AS recall_high FROM o""",
    "metric_breakdown": f"""WITH {CHUNKS}, {LOCATED}, {ranks()}, x AS (SELECT r.rank, l.judgement, l."type", l.gold_match_type FROM ranks r JOIN located l USING (final_id, source)),
      y AS (SELECT 'overall' slice, 'all' AS value, rank FROM x UNION ALL SELECT 'judgement', judgement, rank FROM x UNION ALL SELECT 'match_type', gold_match_type, rank FROM x UNION ALL SELECT 'refuted_type', "type", rank FROM x WHERE judgement = 'refuted' AND "type" <> '')
      SELECT slice, value, count(*) AS n, {recalls()} FROM y GROUP BY slice, value""",
    "bm25_crops": f"""WITH {CHUNKS}, {LOCATED}, {EXAMPLES}, c1 AS (SELECT DISTINCT source, ord, chunk_id, text FROM chunks WHERE window_size = 1), c2 AS (SELECT * FROM c1), q AS (SELECT DISTINCT final_id, source, claim FROM ex),
      {bm25('claim', '1').replace('FROM chunks)', 'FROM c2)').replace('FROM located', 'FROM q')}, n AS (SELECT DISTINCT final_id, source, len(sents) n FROM ex),
      z AS (SELECT DISTINCT r.final_id, r.source, n, {start('r.chunk_id')} sp FROM rk1 r JOIN n USING (final_id, source) WHERE r.rk <= 5), z2 AS (SELECT *, greatest(0, sp - 2) s0 FROM z), z3 AS (SELECT *, least(n, greatest(s0 + 6, sp + 1)) e0 FROM z2),
      near AS (SELECT DISTINCT final_id, source, least(greatest(0, least(s0, e0 - least(6, e0))), sp)::INTEGER crop_start, e0::INTEGER crop_end FROM z3),
      rest AS (SELECT final_id, source, n, unnest({crop_range('n')}) i FROM n WHERE (final_id, source) NOT IN (SELECT final_id, source FROM near))
      SELECT final_id, source, crop_start, crop_end FROM near UNION ALL SELECT final_id, source, i::INTEGER, least(i + 6, n)::INTEGER FROM rest""",
    "training_triples": f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim')}, a AS (SELECT DISTINCT l.final_id, l.source, c.chunk_id FROM located l JOIN chunks c USING (source) WHERE c.chunk_id <> l.gold_chunk_id),
      x AS (SELECT a.*, row_number() OVER (PARTITION BY a.final_id, a.source ORDER BY r.rk NULLS LAST, md5('42:' || a.chunk_id), a.chunk_id) place FROM a LEFT JOIN rk r ON r.final_id = a.final_id AND r.source = a.source AND r.chunk_id = a.chunk_id AND r.rk <= 40), tx AS (SELECT DISTINCT source, chunk_id, text FROM chunks)
      SELECT l.final_id, l.source, l.claim, p.text AS positive, n.text AS negative FROM located l JOIN tx p ON p.source = l.source AND p.chunk_id = l.gold_chunk_id JOIN x ON x.final_id = l.final_id AND x.source = l.source AND x.place = 1 JOIN tx n ON n.source = x.source AND n.chunk_id = x.chunk_id""",
}

_FUSED = f"""WITH {CHUNKS}, {LOCATED}, {bm25('claim', 'a')}, {bm25('reasoning', 'b')}, u AS (SELECT final_id, source, chunk_id, rk, 0 l FROM rka WHERE rk <= 10 UNION ALL SELECT final_id, source, chunk_id, rk, 1 FROM rkb WHERE rk <= 10),
  f AS (SELECT final_id, source, chunk_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rk)), 9) score, min((l, rk)) fst FROM u GROUP BY ALL), fu AS (SELECT final_id || ':' || source AS qid, chunk_id, score, row_number() OVER (PARTITION BY final_id, source ORDER BY score DESC, fst) rk FROM f)"""
SQL |= {
    "rrf_fusion": f"{_FUSED} SELECT qid, chunk_id, score, rk::INTEGER AS rk FROM fu WHERE rk <= 10",
    "hybrid_metrics": f"{_FUSED}, r AS (SELECT l.final_id, fu.rk AS rank FROM located l LEFT JOIN fu ON fu.qid = l.final_id || ':' || l.source AND fu.chunk_id = l.gold_chunk_id AND fu.rk <= 10) SELECT count(*) AS n, {recalls()} FROM r",
}

RELAXED = SQL["bm25_relaxed_ranks"]


def relaxed(ranks_sql: str) -> str:
    near = recalls("rank_relaxed")
    for name in ("recall_at_10", "recall_at_1,", "recall_at_5", "mrr"):
        bare = name.rstrip(",")
        near = near.replace(f"AS {name}", f"AS {bare}_relaxed" + name[len(bare) :])
    return f"SELECT count(*) AS n, {recalls()}, {near} FROM ({ranks_sql})"


_DENSE = f"""WITH {CHUNKS}, {LOCATED},
  qh AS (SELECT final_id, source, md5(t) h FROM (SELECT final_id, source, unnest({toks('claim')}) t FROM located)), ch AS (SELECT source, ord, chunk_id, md5(t) h FROM (SELECT source, ord, chunk_id, unnest({toks('text')}) t FROM chunks)),
  qd AS (SELECT final_id, source, ('0x' || substr(h, 1, 2))::INTEGER % 64 d, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE v FROM qh GROUP BY ALL),
  cd AS (SELECT source, ord, chunk_id, ('0x' || substr(h, 1, 2))::INTEGER % 64 d, sum(CASE WHEN substr(h, 3, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE v FROM ch GROUP BY ALL),
  qn AS (SELECT final_id, source, sqrt(sum(v * v)) n FROM qd GROUP BY ALL), cn AS (SELECT source, ord, chunk_id, sqrt(sum(v * v)) n FROM cd GROUP BY ALL),
  dots AS (SELECT final_id, source, ord, chunk_id, sum(qd.v * cd.v) s FROM qd JOIN cd USING (source, d) GROUP BY ALL),
  sims AS (SELECT q.final_id, q.source, c.ord, c.chunk_id, CASE WHEN coalesce(q.n, 0) = 0 OR coalesce(cn.n, 0) = 0 THEN 0.0 ELSE round(coalesce(dots.s, 0) / (q.n * cn.n), 6) END::DOUBLE + 0.0 score
    FROM qn q JOIN chunks c USING (source) LEFT JOIN cn USING (source, ord, chunk_id) LEFT JOIN dots USING (final_id, source, ord, chunk_id)),
  dk AS (SELECT *, row_number() OVER (PARTITION BY final_id, source ORDER BY score DESC, ord DESC) rk FROM sims)"""
_DENSE_RANKS = f"""{_DENSE}, x AS (SELECT l.final_id, l.source, l.gold_chunk_id, r.chunk_id, r.rk, {iou('r.chunk_id', 'l.gold_chunk_id')} io FROM located l LEFT JOIN dk r ON r.final_id = l.final_id AND r.source = l.source AND r.rk <= 50)
  SELECT final_id, source, gold_chunk_id, min(rk) FILTER (chunk_id = gold_chunk_id) AS rank, coalesce(min(rk) FILTER (chunk_id = gold_chunk_id), min(rk) FILTER (io >= 0.5)) AS rank_relaxed FROM x GROUP BY ALL"""
SQL |= {
    "bm25_relaxed_metrics": relaxed(RELAXED),
    "bm25_recall_gate": f"WITH {CHUNKS}, {LOCATED}, {ranks()} SELECT count(*) AS n, round(avg(CASE WHEN rank <= 50 THEN 1.0::DOUBLE ELSE 0.0 END), 4) AS recall_at_50, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 4) AS mrr FROM ranks",
    "dense_in_article": f"{_DENSE} SELECT final_id, source, chunk_id, score, rk::INTEGER AS rk FROM dk WHERE rk <= 10",
    "dense_in_article_metrics": relaxed(_DENSE_RANKS),
    "hybrid_dense_metrics": f"""{_DENSE}, {bm25('claim')}, u AS (SELECT final_id, source, chunk_id, rk, 0 l FROM rk WHERE rk <= 50 UNION ALL SELECT final_id, source, chunk_id, rk, 1 FROM dk WHERE rk <= 50),
      f AS (SELECT final_id, source, chunk_id, round(sum(1.0::DOUBLE / (60.0::DOUBLE + rk)), 9) score, min((l, rk)) fst FROM u GROUP BY ALL), fu AS (SELECT *, row_number() OVER (PARTITION BY final_id, source ORDER BY score DESC, fst) rk FROM f),
      r AS (SELECT fu.rk AS rank FROM located l LEFT JOIN fu ON fu.final_id = l.final_id AND fu.source = l.source AND fu.chunk_id = l.gold_chunk_id AND fu.rk <= 50) SELECT count(*) AS n, {recalls()} FROM r""",
}
