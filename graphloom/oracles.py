"""SQL of the core's queries for DuckDB."""

SQL: dict[str, str] = {}

_REFS = """WITH t AS (
  SELECT triple_id, loaded_at,
    CASE WHEN raw_record IS NULL THEN head_id ELSE coalesce(raw_record->>'$.h', raw_record->>'$.head') END AS h,
    CASE WHEN raw_record IS NULL THEN tail_id ELSE coalesce(raw_record->>'$.t', raw_record->>'$.tail') END AS g
  FROM triples
), u AS (
  SELECT map_row, loaded_at, unnest(triple_ids) AS x, generate_subscripts(triple_ids, 1) - 1 AS p FROM title_triples
), refs AS (
  SELECT 'triples' AS src_table, triple_id AS src_key, 'head_id' AS ref_field, 0 AS ref_pos, 'e' AS kind, regexp_replace(lower(h), '[^\\p{L}\\p{N}]', '', 'g') AS k, loaded_at FROM t WHERE h IS NOT NULL
  UNION ALL SELECT 'triples', triple_id, 'tail_id', 0, 'e', regexp_replace(lower(g), '[^\\p{L}\\p{N}]', '', 'g'), loaded_at FROM t WHERE g IS NOT NULL
  UNION ALL SELECT 'title_triples', CAST(map_row AS VARCHAR), 'triple_ids', CAST(p AS INTEGER), 't', x, loaded_at FROM u WHERE x IS NOT NULL
), lives AS (
  SELECT 'e' AS kind, regexp_replace(lower(entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS k, loaded_at AS a, deleted_at AS z FROM (SELECT entity_id, loaded_at, deleted_at FROM entities UNION SELECT entity_id, loaded_at, deleted_at FROM core_entities)
  UNION ALL SELECT 't', triple_id, loaded_at, deleted_at FROM triples
), orphans AS (
  SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM lives l WHERE l.kind = r.kind AND l.k = r.k AND l.a <= r.loaded_at AND (l.z IS NULL OR l.z > r.loaded_at))
) """
SQL["p1_found"] = _REFS + "SELECT src_table, src_key, ref_field, ref_pos FROM orphans"
SQL["p1_report"] = _REFS + """, d AS (SELECT DISTINCT src_table, src_key FROM orphans), n AS (
  SELECT r.* FROM refs r JOIN d ON d.src_table = 'triples' AND r.kind = 't' AND r.k = d.src_key
  WHERE NOT EXISTS (SELECT 1 FROM orphans o WHERE o.src_table = r.src_table AND o.src_key = r.src_key AND o.ref_field = r.ref_field AND o.ref_pos = r.ref_pos)
), i AS (SELECT DISTINCT src_table, src_key, loaded_at FROM n WHERE NOT EXISTS (SELECT 1 FROM d e WHERE e.src_table = n.src_table AND e.src_key = n.src_key)
), o AS (SELECT src_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n, count(DISTINCT src_key) AS m FROM orphans GROUP BY ALL
), g AS (SELECT src_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n FROM n GROUP BY ALL
), h AS (SELECT src_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n FROM i GROUP BY ALL)
SELECT e.src_table, e.period, e.n_refs, coalesce(o.n, 0) AS n_orphan_refs, coalesce(g.n, 0) AS n_inherited_refs, coalesce(o.m, 0) AS n_direct_records, coalesce(h.n, 0) AS n_inherited_records
FROM (SELECT src_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS n_refs FROM refs GROUP BY ALL) e
LEFT JOIN o USING (src_table, period) LEFT JOIN g USING (src_table, period) LEFT JOIN h USING (src_table, period)"""


_E = """WITH e AS (
  SELECT triple_id, upstream_index, active, sources, title,
    regexp_replace(lower(CASE WHEN raw_record IS NULL THEN head_id ELSE coalesce(raw_record->>'$.h', raw_record->>'$.head') END), '[^\\p{L}\\p{N}]', '', 'g') AS head_key,
    trim(regexp_replace(lower(CASE WHEN raw_record IS NULL THEN relation ELSE coalesce(raw_record->>'$.r', raw_record->>'$.relation') END), '[\\s\\p{Z}]+', ' ', 'g')) AS relation,
    regexp_replace(lower(CASE WHEN raw_record IS NULL THEN tail_id ELSE coalesce(raw_record->>'$.t', raw_record->>'$.tail') END), '[^\\p{L}\\p{N}]', '', 'g') AS tail_key,
    CASE WHEN raw_record IS NULL THEN tail_literal ELSE raw_record->>'$.tail_literal' END AS tail_literal
  FROM triples
), ent AS (
  SELECT DISTINCT entity_id, canonical_name, aliases, entity_type FROM (SELECT entity_id, canonical_name, aliases, entity_type FROM core_entities UNION ALL SELECT entity_id, canonical_name, aliases, entity_type FROM entities)
), nm AS (
  SELECT DISTINCT entity_id, name, trim(regexp_replace(lower(name), '[\\s\\p{Z}]+', ' ', 'g')) AS norm
  FROM (SELECT entity_id, unnest(list_concat([canonical_name], coalesce(aliases, []))) AS name FROM ent)
  WHERE trim(regexp_replace(lower(name), '[\\s\\p{Z}]+', ' ', 'g')) <> ''
) """.replace("\\\\", "\\")


def _link(surfaces: str) -> str:
    return f""", s AS (SELECT DISTINCT surface, trim(regexp_replace(lower(surface), '[\\s\\p{{Z}}]+', ' ', 'g')) AS norm FROM ({surfaces}) WHERE surface IS NOT NULL
), link AS (
  SELECT surface, count(DISTINCT entity_id) AS n_matches, coalesce(max(CAST(name = surface AS INT)), 0) AS exact FROM s LEFT JOIN nm USING (norm) GROUP BY surface
) """


SQL["q01_norm_names"] = _E + "SELECT DISTINCT entity_id, norm FROM nm"
SQL["q02_match_surface_counts"] = _E + _link("SELECT head_surface AS surface FROM candidates") + "SELECT surface, n_matches FROM link"
SQL["q03_outgoing"] = _E + "SELECT head_key, count(*) AS n_edges, min(upstream_index) AS first_index, max(upstream_index) AS last_index FROM e WHERE active AND head_key IS NOT NULL GROUP BY 1"
SQL["q04_incoming"] = _E + "SELECT tail_key, count(*) AS n_edges, min(upstream_index) AS first_index, max(upstream_index) AS last_index FROM e WHERE active AND tail_key IS NOT NULL GROUP BY 1"
_T = "WITH x AS (SELECT map_row, unnest(triple_ids) AS triple_id, generate_subscripts(triple_ids, 1) - 1 AS pos FROM title_triples) "
SQL["q05_mask_active_titles"] = _T + "SELECT map_row, count(*) AS n_ids, count(*) FILTER (WHERE t.active AND t.deleted_at IS NULL) AS n_active FROM x LEFT JOIN triples t USING (triple_id) WHERE triple_id IS NOT NULL GROUP BY 1"
SQL["q06_forced_candidates"] = _T + "SELECT map_row, string_agg(triple_id, ',' ORDER BY pos) AS ids FROM x JOIN triples t USING (triple_id) WHERE t.active GROUP BY 1"
SQL["q07_both_endpoints"] = _E + "SELECT head_key, tail_key, count(*) AS n_edges, min(upstream_index) AS first_index FROM e WHERE active AND head_key IS NOT NULL AND tail_key IS NOT NULL GROUP BY 1, 2"
SQL["q08_entity_literal"] = _E + "SELECT head_key, tail_literal, count(*) AS n_edges, min(upstream_index) AS first_index FROM e WHERE active AND head_key IS NOT NULL AND tail_literal IS NOT NULL GROUP BY 1, 2"
SQL["q09_shape_classify"] = _E + _link("SELECT head_surface AS surface FROM candidates UNION SELECT tail_surface FROM candidates") + """, c AS (SELECT DISTINCT candidate_id, head_surface, tail_surface FROM candidates), r AS (
  SELECT candidate_id, coalesce(h.n_matches, 0) AS h, coalesce(t.n_matches, 0) AS t FROM c LEFT JOIN link h ON h.surface = head_surface LEFT JOIN link t ON t.surface = tail_surface)
SELECT candidate_id, CASE WHEN h > 1 OR t > 1 THEN 'ambiguous' WHEN h = 1 AND t = 1 THEN 'both_entity' WHEN h = 1 OR t = 1 THEN 'one_entity_one_var' ELSE 'wait' END AS shape FROM r"""
SQL["q10_first_supported_edge"] = _E + """, k AS (SELECT *, coalesce(len(list_filter(sources, lambda s: s.quote IS NOT NULL AND s.title IS NOT NULL)), 0) > 0 AS ok FROM e WHERE active AND head_key IS NOT NULL AND relation IS NOT NULL
), b AS (SELECT head_key, relation, min(upstream_index) AS f, arg_min(triple_id, upstream_index) AS triple_id FROM k WHERE ok GROUP BY 1, 2)
SELECT b.head_key, b.relation, b.triple_id, count(k.triple_id) AS n_rejected FROM b LEFT JOIN k ON k.head_key = b.head_key AND k.relation = b.relation AND k.upstream_index < b.f GROUP BY 1, 2, 3"""
SQL["q11_two_hop"] = _E + """, h AS (SELECT relation, head_key, arg_min(tail_key, upstream_index) AS tail_key FROM e WHERE active AND head_key IS NOT NULL AND tail_key IS NOT NULL GROUP BY 1, 2
), s AS (SELECT DISTINCT regexp_replace(lower(entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS head_key FROM core_entities)
SELECT s.head_key, a.tail_key AS middle, b.tail_key AS answer FROM s JOIN h a ON a.head_key = s.head_key AND a.relation = 'funded by' LEFT JOIN h b ON b.head_key = a.tail_key AND b.relation = 'supplied by'""".replace("\\\\", "\\")
SQL["q13_integrity_audit"] = _E + """, k AS (SELECT DISTINCT regexp_replace(lower(entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS k FROM ent)
SELECT 'dangling_end' AS issue, count(*) AS n FROM (SELECT head_key AS k FROM e UNION ALL SELECT tail_key FROM e) WHERE k IS NOT NULL AND k NOT IN (SELECT k FROM k)
UNION ALL SELECT 'id_with_two_records', count(*) FROM (SELECT entity_id FROM ent GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'null_head', count(*) FROM e WHERE head_key IS NULL
UNION ALL SELECT 'tail_missing', count(*) FROM e WHERE tail_key IS NULL AND tail_literal IS NULL
UNION ALL SELECT 'tail_twice', count(*) FROM e WHERE tail_key IS NOT NULL AND tail_literal IS NOT NULL""".replace("\\\\", "\\")
_LIST = "array_to_string(list_transform({0}, lambda x: coalesce(x, '~')), ',')"
SQL["q51_fingerprint"] = f"""WITH en AS (SELECT DISTINCT entity_id, canonical_name, CASE WHEN aliases IS NOT NULL THEN {_LIST.format("aliases")} END AS a FROM (SELECT * FROM core_entities UNION ALL BY NAME SELECT * FROM entities)
), l AS (
  SELECT concat_ws('|', 'entity', entity_id, coalesce(canonical_name, '~'), coalesce(a, '~')) AS line FROM en
  UNION ALL SELECT concat_ws('|', 'triple', triple_id, CAST(upstream_index AS VARCHAR), coalesce(head_id, '~'), coalesce(relation, '~'), coalesce(tail_id, '~'), coalesce(tail_literal, '~'), coalesce(raw_record, '~'), coalesce(CAST(active AS VARCHAR), '~')) FROM triples
  UNION ALL SELECT concat_ws('|', 'title', CAST(map_row AS VARCHAR), coalesce(title, '~'), coalesce(CASE WHEN triple_ids IS NOT NULL THEN {_LIST.format("triple_ids")} END, '~')) FROM title_triples
), d AS (SELECT sha256(line) AS h FROM l)
SELECT count(*) AS n_rows, concat_ws('-', {", ".join(f"CAST(sum(CAST('0x' || substring(h, {1 + 16 * n}, 16) AS UBIGINT)) AS VARCHAR)" for n in range(4))}) AS checksum FROM d"""
SQL["q53_scrub"] = """WITH k AS (SELECT event_id, props, ['k', 'api_key', 'K', 'Token', 'user_secret'][event_id % 5 + 1] AS key FROM events
), n AS (SELECT event_id, CASE WHEN regexp_matches(lower(key), 'api_key|authorization|secret|password|token') THEN regexp_replace(replace(props, '"k"', '"' || key || '"'), '(: *)[0-9]+', '\\1"[redacted]"') ELSE replace(props, '"k"', '"' || key || '"') END AS p FROM k)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN p ELSE '{"a": [1, ' || p || '], "password": "[redacted]"}' END AS props FROM n""".replace("\\\\", "\\")
SQL["q57_link_reject_reasons"] = _E + _link("SELECT tail_surface AS surface FROM candidates") + """, c AS (SELECT DISTINCT candidate_id, tail_surface AS surface FROM candidates)
SELECT CASE WHEN n_matches = 0 THEN 'UNLINKABLE' WHEN n_matches > 1 THEN 'AMBIGUOUS_ENTITY' WHEN exact = 1 THEN 'EXACT_NAME' ELSE 'ALIAS_UNIQUE' END AS reason, count(*) AS n_candidates FROM c JOIN link USING (surface) GROUP BY 1"""

_NEGATED = "没有|并未|并非|不是|从未|不曾|never|not "
_QUALIFIED = "预科|短期交流|访问学者|进修|荣誉学位|交换生"


def _negated(text: str, cue: str) -> str:
    return f"(contains({text}, {cue}) AND regexp_matches(substring({text}, greatest(1, instr({text}, {cue}) - 8), instr({text}, {cue}) - greatest(1, instr({text}, {cue}) - 8)), '{_NEGATED}'))"


#: What each sentence says is read from the sentence; the segment only words it.
_C = f"""WITH cl AS (
  SELECT c_custkey, c_name AS name, n_name AS nation, c_nationkey, r_name AS region, c_mktsegment AS seg, c_acctbal < 0 AS masked FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey
), q AS (
  SELECT *, CASE seg WHEN 'AUTOMOBILE' THEN name || ' is not located in ' || nation || '.' WHEN 'FURNITURE' THEN name || ' and ' || nation || ' are listed.'
    WHEN 'MACHINERY' THEN name || ' is located in ' || nation || '(访问学者).' ELSE name || ' is located in ' || nation || '.' END AS quote,
    CASE WHEN seg = 'HOUSEHOLD' THEN nation ELSE name END AS hs, CASE WHEN seg = 'HOUSEHOLD' THEN name ELSE nation END AS ts FROM cl
), m AS (SELECT * FROM q WHERE masked
), p(preset, method, binding, reentry, vt, vg) AS (VALUES ('core00', 'relation_commit', false, false, false, true), ('core01', 'relation_commit', false, false, true, true), ('core10', 'relation_commit', true, true, false, true),
  ('core11', 'relation_commit', true, true, true, true), ('simple_bind', 'simple_slot', true, true, true, true), ('cog_controlled', 'cog_notebook', true, true, true, false), ('iterative_text', 'iterative_text', true, false, true, true),
  ('no_reentry', 'relation_commit', true, false, true, true), ('verify_graph_off', 'relation_commit', true, true, true, false)
), s AS (
  SELECT q.*, p.*, contains(quote, 'located in') AS cue, {_negated("quote", "'located in'")} AS neg, regexp_matches(quote, '{_QUALIFIED}') AS qual, lower(hs) = lower(name) AS dir, contains(quote, ts) AS named FROM q CROSS JOIN p
), e AS (
  SELECT *, CASE WHEN masked THEN NULL WHEN NOT vg THEN 'GRAPH_UNVERIFIED_ACCEPT' WHEN cue AND NOT neg THEN 'GRAPH_SOURCE_OK' ELSE 'GRAPH_SOURCE_REJECT' END AS edge,
    CASE WHEN NOT dir THEN 'DIRECTION_MISMATCH' WHEN method IN ('simple_slot', 'cog_notebook') AND named THEN upper(method) WHEN NOT cue THEN 'COOCCURRENCE' WHEN vt AND neg THEN 'NEGATION' WHEN vt AND qual THEN 'QUALIFIER_MISMATCH' WHEN vt THEN 'TEXT_SUPPORTED' ELSE 'TEXT_PROGRAMMATIC_ACCEPT' END AS r,
    CASE WHEN vg THEN 'GRAPH_SOURCE_OK' ELSE 'GRAPH_UNVERIFIED_ACCEPT' END AS next FROM s
), f AS (SELECT *, coalesce(edge IN ('GRAPH_SOURCE_OK', 'GRAPH_UNVERIFIED_ACCEPT'), false) AS by_graph, r IN ('SIMPLE_SLOT', 'COG_NOTEBOOK', 'TEXT_SUPPORTED', 'TEXT_PROGRAMMATIC_ACCEPT') AS holds FROM e
), x AS (SELECT *, NOT by_graph AND holds AND binding AS committed FROM f
), y AS (SELECT *, by_graph OR committed AND (reentry OR method = 'iterative_text') AS done FROM x
), a AS (
  SELECT y.*, CASE WHEN done THEN 'COMPLETE' ELSE 'EXHAUSTED' END AS status, CASE WHEN done THEN region END AS answer, region AS gold,
    CASE WHEN by_graph THEN 'GRAPH,GRAPH' WHEN committed AND reentry THEN 'TEXT,GRAPH' WHEN committed AND done THEN 'TEXT,TEXT' WHEN committed THEN 'TEXT' ELSE '' END AS path,
    array_to_string(list_sort(list_distinct(list_filter([edge, CASE WHEN by_graph OR committed AND reentry THEN next END, CASE WHEN NOT by_graph THEN r END, CASE WHEN NOT by_graph AND holds THEN 'EXACT_NAME' END,
      CASE WHEN NOT by_graph AND holds AND NOT binding THEN 'TEXT_BINDING_DISABLED' END, CASE WHEN committed THEN 'FORKED' END, CASE WHEN committed THEN CASE WHEN method IN ('simple_slot', 'cog_notebook') THEN upper(method) ELSE 'TEXT_COMMIT' END END,
      CASE WHEN committed AND NOT reentry THEN 'REENTRY_DISABLED' END, CASE WHEN committed AND method = 'iterative_text' THEN 'TEXT_SUPPORTED' END], lambda c: c IS NOT NULL))), ',') AS reasons
  FROM y
) """
SQL["q22_verify_graph"] = _E + f""", v AS (SELECT triple_id, head_key, relation, string_split(relation, ' ')[1] AS w, array_to_string(list_filter(list_transform(sources, lambda s: s.quote), lambda x: x IS NOT NULL), ' ') AS q,
  coalesce(len(list_filter(sources, lambda s: s.quote IS NOT NULL AND s.title IS NOT NULL)), 0) > 0 AS located FROM e WHERE relation IS NOT NULL
), x AS (SELECT *, w <> '' AND (contains(relation, w) OR contains(w, relation)) OR contains(relation, 'located in') OR contains('located in', relation) AS fits, w <> '' AND contains(q, w) OR contains(q, 'Located  in') AS cue,
  w <> '' AND {_negated("q", "w")} OR {_negated("q", "'Located  in'")} AS neg FROM v
), y AS (SELECT triple_id, checked, forced, CASE WHEN head_key IS NULL THEN 'DIRECTION_MISMATCH' WHEN NOT checked AND (fits OR forced) THEN 'GRAPH_UNVERIFIED_ACCEPT' WHEN NOT checked THEN 'RELATION_MISMATCH'
  WHEN NOT located THEN 'SOURCE_UNLOCATABLE' WHEN fits AND coalesce(cue, false) AND NOT coalesce(neg, false) THEN 'GRAPH_SOURCE_OK' ELSE 'GRAPH_SOURCE_REJECT' END AS reason FROM x CROSS JOIN (VALUES (true), (false)) a(checked) CROSS JOIN (VALUES (true), (false)) b(forced))
SELECT triple_id, checked, forced, CASE WHEN reason IN ('GRAPH_UNVERIFIED_ACCEPT', 'GRAPH_SOURCE_OK') THEN 'SUPPORTED' WHEN reason = 'GRAPH_SOURCE_REJECT' THEN 'CONFLICT' ELSE 'UNKNOWN' END AS decision, reason FROM y"""
_A = "CAST(c_custkey AS BIGINT) AS c_custkey, preset, status, answer, path, reasons"
SQL["q12_three_hop"] = "SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE NOT c_acctbal < 0"
SQL["q18_relation_cue_match"] = _E + """, v AS (SELECT triple_id, relation, string_split(relation, ' ')[1] AS w, array_to_string(list_filter(list_transform(sources, lambda s: s.quote), lambda x: x IS NOT NULL), ' ') AS q FROM e WHERE relation IS NOT NULL)
SELECT triple_id, contains(relation, 'funded by') OR contains('funded by', relation) AS fits, coalesce(w <> '' AND contains(q, w) OR contains(q, 'located  in') OR contains(q, ' '), false) AS cue FROM v"""
SQL["q19_negation_window"] = _C + f"SELECT c_custkey, {_negated('quote', chr(39) + 'located in' + chr(39))} AS negated FROM m"
SQL["q20_qualifier"] = _C + f"SELECT c_custkey, regexp_matches(quote, '{_QUALIFIED}') AS conflict, lower(hs) = lower(name) AS direction FROM m"
SQL["q21_verify_text"] = f"""WITH c AS (SELECT DISTINCT candidate_id, passage_id, char_start, char_end, quote, predicate_surface AS p, head_surface AS h FROM candidates
), u AS (SELECT DISTINCT passage_id, raw_text FROM text_units
), x AS (SELECT *, string_split(p, ' ')[1] AS w, substring(raw_text, char_start + 1, char_end - char_start) = quote AND char_start >= 0 AND char_start < char_end AND char_end <= length(raw_text) AS span,
    coalesce(contains(trim(regexp_replace(lower(quote), '[\\s\\p{{Z}}]+', ' ', 'g')), trim(regexp_replace(lower(h), '[\\s\\p{{Z}}]+', ' ', 'g'))), false) AS dir FROM c JOIN u USING (passage_id) CROSS JOIN (VALUES (true), (false)) t(checked)
), y AS (SELECT *, CASE WHEN NOT span THEN 'INVALID_SPAN' WHEN NOT dir THEN 'DIRECTION_MISMATCH' WHEN w = '' OR NOT contains(quote, w) THEN 'COOCCURRENCE' WHEN checked AND {_negated('quote', 'w')} THEN 'NEGATION'
    WHEN checked AND len(list_filter(string_split('{_QUALIFIED}', '|'), lambda k: contains(quote, k) AND NOT contains(p, k))) > 0 THEN 'QUALIFIER_MISMATCH' WHEN checked THEN 'TEXT_SUPPORTED' ELSE 'TEXT_PROGRAMMATIC_ACCEPT' END AS reason FROM x)
SELECT candidate_id, checked, CASE WHEN reason = 'INVALID_SPAN' THEN reason WHEN reason = 'NEGATION' THEN 'CONFLICT' WHEN reason LIKE 'TEXT_%' THEN 'SUPPORTED' ELSE 'UNKNOWN' END AS decision, reason FROM y""".replace("\\\\", "\\")
SQL["q27_text_commit_children"] = _C + "SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'N:' || c_nationkey AS bound, quote, 1 AS depth FROM x WHERE preset = 'core11' AND committed"
SQL["q28_successor_reentry"] = _C + "SELECT o_orderkey, status, answer, path, reasons FROM orders JOIN a ON c_custkey = o_custkey WHERE preset = 'core11'"
SQL["q29_no_reentry"] = _C + f"SELECT {_A} FROM a WHERE preset = 'no_reentry'"
SQL["q30_core_matrix"] = _C + "SELECT preset, status, path, reasons, count(*) AS n FROM a WHERE preset IN ('core00', 'core01', 'core10', 'core11') GROUP BY ALL"
SQL["q31_simple_slot"] = _C + f"SELECT {_A} FROM a WHERE preset = 'simple_bind'"
SQL["q32_notebook"] = _C + """, z AS (SELECT CAST(c_custkey AS BIGINT) AS c_custkey, name, nation, quote, ts, by_graph, committed FROM x WHERE preset = 'cog_controlled')
SELECT c_custkey, 'followup_query' AS kind, name || ' located in' AS text FROM z WHERE NOT by_graph UNION ALL SELECT c_custkey, 'fact', quote FROM z WHERE NOT by_graph
UNION ALL SELECT c_custkey, 'judgment', '?nation located in ' || ts FROM z WHERE committed UNION ALL SELECT c_custkey, 'analysis', 'bound ?nation to ' || ts FROM z WHERE committed"""
SQL["q33_iterative_text"] = _C + "SELECT preset, status, path, reasons, count(*) AS n FROM a WHERE preset IN ('iterative_text', 'verify_graph_off') GROUP BY ALL"
#: Proofs of the chain with their ends: an edge spells the nation, a sentence what was read from it.
_S = _C + """, h AS (SELECT a.*, by_graph OR committed AND hs = name AND ts = nation AS bridge, done AS successor, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, ',')) END AS n_proofs FROM a
), sc AS (SELECT *, CAST(CASE WHEN answer IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS f1, CASE WHEN n_proofs > 0 THEN (bridge::INT + successor::INT) / n_proofs END AS precision FROM h) """
SQL["q45_method_report"] = _S + "SELECT preset, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg(successor::INT), 6) AS successor_rate, round(avg(precision), 6) AS mean_proof_precision, round(avg((precision IS NOT NULL)::INT), 6) AS precision_coverage FROM sc GROUP BY 1"
SQL["q45b_failures"] = _S + "SELECT status, count(*) AS n FROM sc WHERE status <> 'COMPLETE' GROUP BY 1"
SQL["q45c_score_cases"] = _S + """SELECT CAST(c_custkey AS BIGINT) AS c_custkey, preset, seg AS "group", status, answer, coalesce(answer = gold, false) AS exact_match, f1 AS token_f1, bridge AS bridge_acquired, successor AS successor_acquired,
  bridge AND path LIKE '%GRAPH' AS complete_support, precision AS proof_precision, CAST(n_proofs AS INT) AS proof_count, precision IS NOT NULL AS precision_coverage, false AS uncertain FROM sc WHERE preset IN ('core11', 'no_reentry')"""
SQL["q46_paired_delta"] = _S + """, pair(baseline, other) AS (VALUES ('core00', 'core11'), ('core11', 'simple_bind'), ('core11', 'cog_controlled'), ('core11', 'iterative_text'))
SELECT baseline, other, 'successor_acquired' AS field, count(*) AS n, round(avg(b.successor::INT - c.successor::INT), 6) AS mean_delta FROM pair JOIN sc c ON c.preset = baseline JOIN sc b ON b.preset = other AND b.c_custkey = c.c_custkey GROUP BY 1, 2"""
SQL["q58_binding_off"] = _C + "SELECT reasons, count(*) AS n FROM a WHERE preset = 'core01' GROUP BY 1"

_B = """WITH b AS (SELECT DISTINCT ON (question_id, branch_id) * FROM branch_states
), pr AS (SELECT question_id, branch_id, status, e FROM (SELECT question_id, branch_id, status, unnest(accepted_evidence) AS e FROM b) WHERE e IS NOT NULL
), unit AS (SELECT DISTINCT passage_id, question_id, doc_index, sent_index, visible, raw_text, data_version || ':' || question_id || ':' || doc_index || ':' || sent_index AS source_id FROM text_units
), nf AS (SELECT * FROM b WHERE NOT list_contains(coalesce(reason_codes, []), 'FORKED')
) """
SQL["q16_ready_constraints"] = _B + """, r AS (SELECT question_id, branch_id, list_distinct(list_filter(coalesce(pending_constraints, []), lambda c: c IS NOT NULL AND NOT list_contains(list_transform(list_filter(coalesce(accepted_evidence, []), lambda e: e IS NOT NULL AND NOT e.invalidated), lambda e: e.constraint_id), c))) AS x FROM b)
SELECT question_id, branch_id, CAST(len(x) AS INT) AS n_ready, list_min(x) AS first_ready FROM r"""
SQL["q17_span_ok"] = _B + "SELECT candidate_id, char_start >= 0 AND char_end <= length(raw_text) AND char_start < char_end AND substring(raw_text, char_start + 1, char_end - char_start) = quote AS ok FROM (SELECT DISTINCT candidate_id, passage_id, char_start, char_end, quote FROM candidates) JOIN (SELECT DISTINCT passage_id, raw_text FROM unit) USING (passage_id)"
_TOP = _B + ", t AS (SELECT question_id, passage_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_index, sent_index, passage_id) AS rank FROM (SELECT DISTINCT question_id, passage_id, doc_index, sent_index, visible, raw_text FROM text_units) WHERE visible) "
SQL["q23_ordered_topk"] = _TOP + "SELECT question_id, passage_id, CAST(rank AS INT) AS rank FROM t WHERE rank <= 8"
SQL["q55_scripted_semi"] = _TOP + "SELECT candidate_id FROM (SELECT DISTINCT candidate_id, question_id, passage_id FROM candidates) c WHERE EXISTS (SELECT 1 FROM t WHERE t.rank <= 8 AND t.question_id = c.question_id AND t.passage_id = c.passage_id)"
SQL["q23c_lexical_jaccard"] = _B + """, x AS (SELECT candidate_id, list_filter(list_distinct(string_split(trim(regexp_replace(lower(quote), '[\\s\\p{Z}]+', ' ', 'g')), ' ')), lambda w: w <> '') AS q, list_filter(list_distinct(string_split(trim(regexp_replace(lower(raw_text), '[\\s\\p{Z}]+', ' ', 'g')), ' ')), lambda w: w <> '') AS r
  FROM (SELECT DISTINCT candidate_id, passage_id, quote FROM candidates) JOIN (SELECT DISTINCT passage_id, raw_text FROM unit) USING (passage_id))
SELECT candidate_id, round(CASE WHEN len(q) + len(r) = 0 THEN 0 ELSE len(list_intersect(q, r)) / (len(q) + len(r) - len(list_intersect(q, r))) END, 6) AS score FROM x""".replace("\\\\", "\\")
SQL["q26_relation_cap"] = "SELECT candidate_id, CAST(place AS INT) AS place FROM (SELECT candidate_id, row_number() OVER (PARTITION BY question_id, constraint_id, branch_id ORDER BY retrieval_rank, candidate_id) AS place FROM (SELECT DISTINCT question_id, constraint_id, branch_id, candidate_id, retrieval_rank FROM candidates)) WHERE place <= 3"
SQL["q25_candidate_json_parse"] = """WITH x AS (SELECT candidate_id, quote, raw_text, CASE WHEN tail_surface IS NULL THEN 'PARSE_ERROR' WHEN trim(coalesce(head_surface, '')) = '' THEN 'DROPPED_ROW' WHEN raw_text IS NULL OR quote = '' THEN 'DROPPED_PASSAGE' WHEN instr(raw_text, quote) = 0 THEN 'NOT_IN_TEXT' ELSE 'LOCATED' END AS status
FROM (SELECT DISTINCT candidate_id, passage_id, quote, head_surface, tail_surface FROM candidates) LEFT JOIN (SELECT DISTINCT passage_id, raw_text FROM text_units) USING (passage_id))
SELECT candidate_id, CASE WHEN status <> 'PARSE_ERROR' THEN 0 END AS pos, status, CAST(CASE status WHEN 'LOCATED' THEN instr(raw_text, quote) - 1 WHEN 'NOT_IN_TEXT' THEN 0 END AS INT) AS char_start,
  CAST(CASE status WHEN 'LOCATED' THEN instr(raw_text, quote) - 1 + length(quote) WHEN 'NOT_IN_TEXT' THEN least(1, length(raw_text)) END AS INT) AS char_end FROM x"""
SQL["q34_fork_cap_ambiguous"] = _B + """SELECT b.question_id, b.branch_id, count(*) AS n_children, greatest(0, count(*) - greatest(0, coalesce(any_value(b.budget).max_active_branches, 3))) AS n_truncated
FROM b JOIN b k ON k.question_id = b.question_id AND k.parent_branch_id = b.branch_id GROUP BY 1, 2"""
SQL["q37_budget_cut"] = _B + """, s AS (SELECT question_id, branch_id, coalesce(budget.steps_used, 0) AS used, coalesce(budget.max_steps, 32) AS most, coalesce(sum(coalesce(budget.steps_used, 0)) OVER (PARTITION BY question_id ORDER BY depth, branch_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT question_id, branch_id, CAST(before AS BIGINT) AS steps_before, before + used <= most AS fits FROM s"""
SQL["q38_active_chain"] = _B + "SELECT b.question_id, b.branch_id, coalesce(string_agg(e.proof_id, ',' ORDER BY e.acquisition_order, e.proof_id) FILTER (WHERE NOT e.invalidated), '') AS chain FROM b LEFT JOIN pr ON pr.question_id = b.question_id AND pr.branch_id = b.branch_id GROUP BY 1, 2"
SQL["q39_reason_rollup"] = _B + """, r AS (SELECT question_id, depth, branch_id, unnest(reason_codes) AS r, generate_subscripts(reason_codes, 1) AS p FROM b), f AS (SELECT question_id, r, min({'d': depth, 'b': branch_id, 'p': p}) AS fst FROM r WHERE r IS NOT NULL GROUP BY 1, 2)
SELECT question_id, string_agg(r, ',' ORDER BY fst) AS reasons FROM f GROUP BY 1"""
_G = """WITH an AS (SELECT candidate_id, regexp_replace(lower(ground_truth_answer), '[^\\p{L}\\p{N}]', '', 'g') AS g, regexp_replace(lower(tail_surface), '[^\\p{L}\\p{N}]', '', 'g') AS t
  FROM (SELECT DISTINCT candidate_id, question_id, tail_surface FROM candidates) JOIN (SELECT DISTINCT id AS question_id, ground_truth_answer FROM phase2_records) USING (question_id)) """.replace("\\\\", "\\")
SQL["q40_exact_match"] = _G + "SELECT candidate_id, CASE WHEN g IS NULL THEN NULL ELSE coalesce(g = t, false) END AS em FROM an"
SQL["q41_token_f1"] = _G + """, gc AS (SELECT candidate_id, c, count(*) AS n FROM (SELECT candidate_id, unnest(string_split(g, '')) AS c FROM an) WHERE c <> '' GROUP BY 1, 2
), tc AS (SELECT candidate_id, c, count(*) AS n FROM (SELECT candidate_id, unnest(string_split(t, '')) AS c FROM an) WHERE c <> '' GROUP BY 1, 2
), s AS (SELECT candidate_id, sum(least(gc.n, tc.n)) AS s FROM gc JOIN tc USING (candidate_id, c) GROUP BY 1)
SELECT candidate_id, round(CASE WHEN g IS NULL OR g = '' THEN NULL WHEN t IS NULL OR t = '' THEN 0.0 ELSE 2.0 * coalesce(s, 0) / (length(g) + length(t)) END, 6) AS f1 FROM an LEFT JOIN s USING (candidate_id)"""
SQL["q42_proof_precision"] = _E + """, b AS (SELECT DISTINCT ON (question_id, branch_id) * FROM branch_states
), nf AS (SELECT * FROM b WHERE NOT list_contains(coalesce(reason_codes, []), 'FORKED')
), x AS (SELECT question_id, branch_id, unnest(accepted_evidence) AS p FROM nf
), y AS (SELECT question_id, branch_id, regexp_replace(lower(p.head_entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS h, regexp_replace(lower(p.tail_entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM x WHERE p IS NOT NULL AND NOT p.invalidated
), g AS (SELECT DISTINCT head_key, tail_key FROM e WHERE head_key IS NOT NULL AND tail_key IS NOT NULL)
SELECT question_id, branch_id, count(*) AS n_proofs, round(avg((g.head_key IS NOT NULL)::INT), 6) AS precision FROM y LEFT JOIN g ON g.head_key = y.h AND g.tail_key = y.t GROUP BY 1, 2""".replace("\\\\", "\\")
SQL["q43_support"] = _B + """, h AS (SELECT question_id, branch_id, e.proof_id AS pid, coalesce(max(contains(raw_text, e.source.quote)::INT), 0) AS held FROM pr p LEFT JOIN (SELECT DISTINCT source_id, raw_text FROM unit) u ON u.source_id = p.e.source.source_id
  WHERE NOT e.invalidated AND e.source IS NOT NULL GROUP BY question_id, branch_id, e.proof_id, e.source.source_id, e.source.quote)
SELECT question_id, branch_id, count(*) AS n_sources, CAST(sum(held) AS BIGINT) AS n_supported FROM h GROUP BY 1, 2""".replace("SELECT question_id, branch_id, e.proof_id", "SELECT p.question_id, p.branch_id, e.proof_id").replace("GROUP BY question_id, branch_id, e.proof_id", "GROUP BY p.question_id, p.branch_id, e.proof_id")
SQL["q44_cost_view"] = "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS n_access, count(*) FILTER (WHERE event_type = 'click') AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_errors, CAST(coalesce(sum(CAST(props->>'$.k' AS BIGINT)), 0) AS BIGINT) AS tokens FROM events GROUP BY 1"
SQL["q47_quote_locator"] = """WITH h AS (SELECT candidate_id, count(*) FILTER (WHERE contains(raw_text, quote)) AS n_hits FROM (SELECT DISTINCT candidate_id, question_id, quote FROM candidates WHERE quote <> '') JOIN (SELECT DISTINCT question_id, passage_id, doc_index, sent_index, visible, raw_text FROM text_units) USING (question_id) GROUP BY 1)
SELECT candidate_id, n_hits, CASE WHEN n_hits = 1 THEN 'unique' WHEN n_hits = 0 THEN 'unlocated' ELSE 'multiple_spans' END AS issue FROM h"""
SQL["q48_sentence_explode"] = "SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS INT) AS longest, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\\n]+')) AS s FROM documents) WHERE s <> '' GROUP BY 1"
SQL["q50_gold_split"] = "SELECT DISTINCT id, question, received_at FROM phase2_records"
SQL["q49_localization_audit"] = """WITH c AS (SELECT DISTINCT * FROM candidates), i AS (
  SELECT question_id, 'hard' AS severity, 'unknown passage' AS message FROM c WHERE passage_id NOT IN (SELECT passage_id FROM text_units)
  UNION ALL SELECT question_id, 'hard', 'unknown branch' FROM c WHERE NOT EXISTS (SELECT 1 FROM branch_states b WHERE b.question_id = c.question_id AND b.branch_id = c.branch_id)
  UNION ALL SELECT question_id, 'soft', 'blank head' FROM c WHERE head_surface IS NULL OR trim(head_surface) = ''
  UNION ALL SELECT question_id, 'hard', 'empty span' FROM c WHERE char_start >= char_end)
SELECT question_id, severity, message, count(*) AS n FROM i GROUP BY 1, 2, 3"""
_KEYS = _B + """, sg AS (SELECT question_id, branch_id, depth > 0 AS follows, array_to_string(list_sort(list_transform(list_filter(map_entries(coalesce(bindings, MAP {})), lambda e: e.value IS NOT NULL), lambda e: e.key || '=' || coalesce(e.value.entity_id, e.value.canonical_name))), ';') AS sig FROM b
), ck AS (SELECT candidate_id, sha256(concat_ws('|', 'v1', question_id, constraint_id, predicate_surface, coalesce(sig, ''), 'iterative_text', prompt_hash, '8', CAST(coalesce(follows, false) AS VARCHAR), 'ordered')) AS cache_key
  FROM (SELECT DISTINCT candidate_id, question_id, constraint_id, branch_id, predicate_surface, prompt_hash FROM candidates) LEFT JOIN sg USING (question_id, branch_id)) """
SQL["q52_cache_key"] = _KEYS + "SELECT candidate_id, cache_key FROM ck"
SQL["q52b_cache_probes"] = _KEYS + "SELECT cache_key, count(*) AS n_probes, count(*) - 1 AS n_hits FROM ck GROUP BY 1"
SQL["q54_extraction_prompts"] = _TOP + """, pc AS (SELECT DISTINCT question_id, cid FROM (SELECT question_id, unnest(pending_constraints) AS cid FROM b) WHERE cid IS NOT NULL
), tx AS (SELECT t.question_id, string_agg('[' || t.passage_id || '] ' || raw_text, chr(10) ORDER BY rank, t.passage_id, raw_text) AS lines FROM t JOIN (SELECT DISTINCT question_id, passage_id, raw_text FROM text_units) u ON u.question_id = t.question_id AND u.passage_id = t.passage_id WHERE rank <= 8 GROUP BY 1
), us AS (SELECT question_id || '/' || cid AS ask, 'constraint: ' || cid || chr(10) || 'relation: funded by' || chr(10) || 'known end: ' || question_id || chr(10) || 'passages:' || chr(10) || coalesce(lines, '') || chr(10)
  || 'Answer: {"relations": [{"passage_id": "", "quote": "", "head": "", "predicate": "", "tail": ""}]}' AS u FROM pc LEFT JOIN tx USING (question_id))
SELECT ask, sha256(u) AS prompt_hash, CAST(length(u) AS INT) AS token_bound FROM us"""
SQL["q59_no_successor_flag"] = _E + """, b AS (SELECT DISTINCT ON (question_id, branch_id) * FROM branch_states
), x AS (SELECT question_id, branch_id, unnest(map_values(bindings)) AS v FROM b
), y AS (SELECT DISTINCT question_id, branch_id, regexp_replace(lower(v.entity_id), '[^\\p{L}\\p{N}]', '', 'g') AS head_key FROM x WHERE v.entity_id IS NOT NULL AND NOT v.is_literal)
SELECT * FROM y WHERE head_key NOT IN (SELECT head_key FROM e WHERE active AND head_key IS NOT NULL)""".replace("\\\\", "\\")
SQL["q60_replay_chain"] = _B + """SELECT p.question_id, string_agg(p.e.proof_id, ',' ORDER BY p.e.acquisition_order, p.e.proof_id, branch_id) AS chain, count(DISTINCT p.e.proof_id) AS n_ids FROM pr p JOIN nf USING (question_id, branch_id) WHERE NOT p.e.invalidated AND nf.status <> 'INVALIDATED' GROUP BY 1"""
SQL["q24_vector_topk"] = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings q JOIN embeddings v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

SQL["q56_actionable"] = _B + """, x AS (SELECT question_id, branch_id, list_filter(pending_constraints, lambda c: c IS NOT NULL AND NOT list_contains(list_transform(list_filter(coalesce(accepted_evidence, []), lambda e: e IS NOT NULL AND NOT e.invalidated), lambda e: e.constraint_id), c)) AS o FROM b)
SELECT question_id, branch_id, o[1] AS cid FROM x WHERE len(o) > 0"""
SQL["q64_snapshot_ids"] = "SELECT DISTINCT entity_id, upstream_id FROM (SELECT entity_id, upstream_id FROM core_entities UNION ALL SELECT entity_id, upstream_id FROM entities) WHERE upstream_id IS NOT NULL"
SQL["q65_title_lookup"] = "SELECT DISTINCT candidate_id, u.passage_id FROM candidates c JOIN text_units u ON u.title = c.title WHERE c.quote <> '' AND contains(raw_text, quote)"
SQL["q66_usage_bound"] = "SELECT DISTINCT id, CAST(greatest(1, length(question)) AS INT) AS token_bound FROM phase2_records"


def _as_list(x: str) -> str:
    """A JSON list from a list, an object, or a text that spells a list; else null."""
    spelled = f"TRY_CAST({x}->>'$' AS JSON)"
    return f"CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN json_array({x}) WHEN 'VARCHAR' THEN CASE WHEN json_type({spelled}) = 'ARRAY' THEN {spelled} END END"


_P3 = f"""WITH j AS (SELECT DISTINCT id, TRY_CAST(phase2_json AS JSON) AS j FROM phase2_records WHERE json_valid(phase2_json)
), a AS (SELECT id, {_as_list("json_extract(j, '$.triples_evidence')")} AS l FROM j WHERE json_type(j) = 'OBJECT'
), b AS (SELECT id, i, json_extract(l, '$[' || i || ']') AS o FROM (SELECT id, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS i FROM a WHERE l IS NOT NULL)
), c AS (SELECT id, i, {_as_list("json_extract(o, '$.candidate_evidences')")} AS l FROM b WHERE json_type(o) = 'OBJECT'
), d AS (SELECT id, i, k, json_extract(l, '$[' || k || ']') AS o FROM (SELECT id, i, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS k FROM c WHERE l IS NOT NULL)
), s AS (SELECT DISTINCT ON (question_id, branch_id) question_id || '/' || branch_id AS key, accepted_evidence, bindings FROM branch_states
), e AS (SELECT key, unnest(accepted_evidence) AS e, generate_subscripts(accepted_evidence, 1) - 1 AS i FROM s
), m AS (SELECT key, unnest(map_keys(bindings)) AS name, unnest(map_values(bindings)) AS v FROM s)"""
SQL["p3_found"] = _P3 + """
SELECT 'phase2_records' AS rec_table, id AS rec_key, 'triples_evidence/' || i || '/candidate_evidences/' || k AS child_path FROM d WHERE json_type(o) = 'OBJECT'
UNION SELECT 'branch_states', key, 'accepted_evidence/' || i FROM e WHERE e IS NOT NULL
UNION SELECT 'branch_states', key, 'accepted_evidence/' || i || '/source' FROM e WHERE e.source IS NOT NULL
UNION SELECT 'branch_states', key, 'bindings/' || name FROM m WHERE v IS NOT NULL"""
SQL["p3_evidence"] = _P3 + """
SELECT DISTINCT id AS rec_key, 'triples_evidence/' || i || '/candidate_evidences/' || k AS path, CAST(k AS INT) AS pos, 'triples_evidence/' || i AS parent_path, CAST(i AS INT) AS parent_pos FROM d WHERE json_type(o) = 'OBJECT'"""
SQL["p3_sources"] = _P3 + """
SELECT DISTINCT key AS rec_key, 'accepted_evidence/' || i || '/source' AS path, 'accepted_evidence/' || i AS parent_path, CAST(i AS INT) AS parent_pos, 'source' AS place FROM e WHERE e.source IS NOT NULL"""


#: Plans compiled by rounds: every open pattern with one ungrounded variable proposes to write it, those without are
#: checks; the round in which a pattern settles is its rank.
_PLANS = _P3.replace("WITH j AS", "WITH RECURSIVE j AS", 1) + """, qt AS (
  SELECT id, i, min(CASE WHEN json_type(json_extract(o, '$.query_triple.head')) = 'VARCHAR' THEN json_extract_string(o, '$.query_triple.head') END) AS h,
    min(CASE WHEN json_type(json_extract(o, '$.query_triple.relation')) = 'VARCHAR' THEN json_extract_string(o, '$.query_triple.relation') END) AS rel,
    min(CASE WHEN json_type(json_extract(o, '$.query_triple.tail')) = 'VARCHAR' THEN json_extract_string(o, '$.query_triple.tail') END) AS g
  FROM b WHERE json_type(o) = 'OBJECT' GROUP BY 1, 2
), pt AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS n, h, coalesce(rel, '') AS rel, g, list_distinct(list_filter([h, g], lambda x: x LIKE '?%')) AS vars FROM qt WHERE h IS NOT NULL AND g IS NOT NULL
), pl AS (SELECT id, list({'n': n, 'vars': vars, 'loop': h = g AND h LIKE '?%'} ORDER BY n) AS pats FROM pt GROUP BY 1
), rd AS (
  SELECT id, pats, CAST([] AS VARCHAR[]) AS grounded, CAST([] AS BIGINT[]) AS settled, CAST([] AS STRUCT(n BIGINT, v VARCHAR)[]) AS writes, CAST([] AS STRUCT(n BIGINT, r INT)[]) AS ranks, 0 AS round, false AS clash, false AS stop FROM pl
  UNION ALL
  SELECT id, pats, list_concat(grounded, list_transform(props, lambda p: p.v)), list_concat(settled, list_concat(checks, list_transform(props, lambda p: p.n))), list_concat(writes, props),
    list_concat(ranks, list_transform(list_concat(checks, list_transform(props, lambda p: p.n)), lambda n: {'n': n, 'r': round})), round + 1, len(list_distinct(list_transform(props, lambda p: p.v))) < len(props),
    len(list_distinct(list_transform(props, lambda p: p.v))) < len(props) OR len(props) + len(checks) = 0 OR len(settled) + len(props) + len(checks) = len(pats)
  FROM (
    SELECT *, list_transform(list_filter(open, lambda p: len(p.free) = 1 AND NOT p.loop), lambda p: {'n': p.n, 'v': p.free[1]}) AS props, list_transform(list_filter(open, lambda p: len(p.free) = 0), lambda p: p.n) AS checks
    FROM (SELECT *, list_transform(list_filter(pats, lambda p: NOT list_contains(settled, p.n)), lambda p: {'n': p.n, 'loop': p.loop, 'free': list_filter(p.vars, lambda v: NOT list_contains(grounded, v))}) AS open FROM rd WHERE NOT stop)
  )
), fin AS (
  SELECT id, pats, writes, ranks, CASE WHEN clash THEN 'PLAN_AMBIGUOUS_WRITER' WHEN len(settled) < len(pats) THEN 'PLAN_CYCLE' END AS reason,
    list_distinct(flatten(list_transform(pats, lambda p: list_filter(p.vars, lambda v: NOT list_contains(writes, {'n': p.n, 'v': v}))))) AS read
  FROM rd WHERE stop
), ans AS (SELECT id, reason, ranks, writes, read, pats, CASE WHEN reason IS NULL THEN list_filter(list_transform(writes, lambda w: w.v), lambda v: NOT list_contains(read, v)) END AS unread FROM fin
) """
SQL["q14_plan_compile"] = _PLANS + "SELECT id AS question_id, CASE WHEN reason IS NULL THEN len(pats) ELSE 0 END AS n_constraints, CASE WHEN len(unread) = 1 THEN unread[1] END AS answer, reason FROM ans"
SQL["q15_topo_ranks"] = _PLANS + """SELECT id AS question_id, 'c' || x.n AS cid, CAST(x.r AS INT) AS rank, len(list_filter(writes, lambda w: w.n = x.n AND list_contains(read, w.v))) = 0 AS terminal
FROM (SELECT id, writes, read, unnest(ranks) AS x FROM ans WHERE reason IS NULL)"""


def _closure(verify: bool, told: str | None = None) -> str:
    """Closure of plans whose patterns depend on nothing, as all of these tables' do: each is answered by its first edge that holds."""
    fits = "coalesce(cn <> '' AND (contains(relation, cn) OR contains(cn, relation)), false)"
    ok = f"located AND {fits} AND rel <> '' AND contains(quotes, rel) AND NOT {_negated('quotes', 'rel')}" if verify else fits
    code = f"CASE WHEN {ok} THEN 'GRAPH_SOURCE_OK' WHEN NOT located THEN 'SOURCE_UNLOCATABLE' ELSE 'GRAPH_SOURCE_REJECT' END" if verify else f"CASE WHEN {ok} THEN 'GRAPH_UNVERIFIED_ACCEPT' ELSE 'RELATION_MISMATCH' END"
    graph = _E.removeprefix("WITH ")
    return _PLANS.rstrip() + ", " + graph.rstrip().replace("e AS (", "ge AS (", 1) + f""", kn AS (SELECT norm, count(DISTINCT k) AS n, min(k) AS k FROM (SELECT norm, regexp_replace(lower(entity_id), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k FROM nm) GROUP BY 1
), con AS (
  SELECT p.id, p.n AS c, p.h, p.g, p.rel, trim(regexp_replace(lower(p.rel), '[\\s\\p{{Z}}]+', ' ', 'g')) AS cn, hk.k AS h1, hk.n AS hn, gk.k AS g1, gk.n AS gn
  FROM pt p JOIN ans USING (id) LEFT JOIN kn hk ON p.h NOT LIKE '?%' AND hk.norm = trim(regexp_replace(lower(p.h), '[\\s\\p{{Z}}]+', ' ', 'g')) LEFT JOIN kn gk ON p.g NOT LIKE '?%' AND gk.norm = trim(regexp_replace(lower(p.g), '[\\s\\p{{Z}}]+', ' ', 'g')) WHERE ans.reason IS NULL
), sh AS (SELECT *, coalesce(hn, 0) > 1 OR coalesce(gn, 0) > 1 AS vague, CASE WHEN hn = 1 THEN h1 END AS hid, CASE WHEN gn = 1 THEN g1 END AS gid FROM con
), po AS (
  SELECT s.*, e.upstream_index AS ord, e.head_key, e.tail_key, e.relation, array_to_string(list_filter(list_transform(e.sources, lambda x: x.quote), lambda x: x IS NOT NULL), ' ') AS quotes,
    coalesce(len(list_filter(e.sources, lambda x: x.quote IS NOT NULL AND x.title IS NOT NULL)), 0) > 0 AS located
  FROM sh s JOIN ge e ON e.active AND (s.hid IS NOT NULL AND e.head_key = s.hid AND (s.g LIKE '?%' OR s.gid IS NOT NULL AND e.tail_key = s.gid) OR s.hid IS NULL AND s.h LIKE '?%' AND s.gid IS NOT NULL AND e.tail_key = s.gid) WHERE NOT vague
), ve AS (SELECT id, c, h, g, ord, head_key, tail_key, {code} AS code, coalesce({ok}, false) AS ok FROM po
), fi AS (SELECT id, c, min(ord) AS f, arg_min(CASE WHEN h LIKE '?%' THEN head_key WHEN g LIKE '?%' THEN tail_key ELSE 'x' END, ord) AS bound FROM ve WHERE ok GROUP BY 1, 2
), co AS (
  SELECT id, code FROM ve LEFT JOIN fi USING (id, c) WHERE f IS NULL OR ord <= f UNION SELECT id, 'AMBIGUOUS_ENTITY' FROM sh WHERE vague
), rs AS (SELECT id, string_agg(DISTINCT code, ',' ORDER BY code) AS reasons FROM co GROUP BY 1
), ct AS (SELECT s.id, count(f) FILTER (WHERE bound IS NOT NULL) AS np, count(f) FILTER (WHERE bound IS NOT NULL AND (s.h LIKE '?%' OR s.g LIKE '?%')) AS nb FROM sh s LEFT JOIN fi USING (id, c) GROUP BY 1)
""" + (told or "SELECT ct.id AS question_id, CAST(np AS INT) AS n_proofs, CAST(nb AS INT) AS n_bound, coalesce(reasons, '') AS reasons FROM ct LEFT JOIN rs USING (id)")


def _outcome(preset: str, verify: bool) -> str:
    """What a run ends with where no pattern leads to another, so that nothing is read from text."""
    return f"SELECT * FROM ({_closure(verify, _OUTCOME.format(preset))})"


_OUTCOME = """, cn AS (SELECT regexp_replace(lower(entity_id), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS k, min(canonical_name) AS name FROM ent GROUP BY 1
), wr AS (SELECT a.id, w.n AS c FROM (SELECT id, unnest(writes) AS w, unread FROM ans WHERE reason IS NULL AND len(unread) = 1) a WHERE w.v = unread[1]
), an AS (SELECT wr.id, name FROM wr JOIN fi USING (id, c) JOIN cn ON cn.k = fi.bound
), oc AS (SELECT ans.id, ans.reason, len(pats) AS n, coalesce(len(unread) = 1, false) AS asks, np, reasons, name FROM ans LEFT JOIN ct USING (id) LEFT JOIN rs USING (id) LEFT JOIN an USING (id))
SELECT id AS question_id, '{}' AS preset, CASE WHEN reason IS NOT NULL THEN 'PLAN_UNSUPPORTED' WHEN np = n THEN 'COMPLETE' ELSE 'EXHAUSTED' END AS status, CASE WHEN np = n AND asks THEN name END AS answer, false AS uncertain, coalesce(reason, reasons, '') AS reasons FROM oc"""


SQL["q63_answer_rounds"] = _outcome("core11", True) + " UNION ALL " + _outcome("verify_graph_off", False)
SQL["q62_plan_closure"] = _closure(True)
SQL["q62b_closure_unverified"] = _closure(False)


_STATES = _PLANS.rstrip() + """, bs AS (SELECT DISTINCT ON (question_id, branch_id) * FROM branch_states
), av AS (SELECT id AS question_id, CASE WHEN len(unread) = 1 THEN unread[1] END AS var FROM ans) """
SQL["q35_run_status"] = _STATES + """, u AS (SELECT bs.*, var, CASE WHEN var IS NOT NULL THEN element_at(bindings, var)[1] END AS bd FROM bs LEFT JOIN av USING (question_id) WHERE NOT list_contains(coalesce(reason_codes, []), 'FORKED')
), w AS (SELECT *, status = 'COMPLETE' AND (var IS NULL OR bd IS NOT NULL) AS done FROM u
), x AS (SELECT question_id, count(DISTINCT bd.canonical_name) FILTER (WHERE done) AS n, max(bd.canonical_name) FILTER (WHERE done) AS answer, bool_or(done AND var IS NULL) AS checked, bool_or(status = 'INVALIDATED') AS fell, bool_or(status = 'BUDGET_EXHAUSTED') AS cut, count(*) AS n_branches FROM w GROUP BY 1
), l AS (SELECT question_id, unnest(map_keys(bindings)) AS name, unnest(map_values(bindings)) AS v FROM u WHERE status <> 'INVALIDATED'
), k AS (SELECT question_id, max(n) > 1 AS competing FROM (SELECT question_id, name, count(DISTINCT coalesce(v.entity_id, 'lit:' || v.canonical_name)) AS n FROM l WHERE v IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT question_id, CASE WHEN checked THEN 'COMPLETE' WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'COMPLETE' WHEN fell THEN 'INVALIDATED' WHEN cut THEN 'BUDGET_EXHAUSTED' ELSE 'EXHAUSTED' END AS status,
  CASE WHEN NOT checked AND n = 1 THEN answer END AS answer, NOT checked AND n = 1 AND (cut OR coalesce(competing, false)) AS uncertain, n_branches FROM x LEFT JOIN k USING (question_id)"""
SQL["q36_revoke_cascade"] = _STATES + """, ev AS (SELECT question_id AS q, branch_id AS b, unnest(accepted_evidence) AS e FROM bs
), bd AS (SELECT q, b, name, v.binding_id AS bid FROM (SELECT question_id AS q, branch_id AS b, unnest(map_keys(bindings)) AS name, unnest(map_values(bindings)) AS v FROM bs) WHERE v IS NOT NULL
), ab AS (SELECT DISTINCT q, b, e.parent_binding_id AS bid FROM ev WHERE e.parent_binding_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.q = ev.q AND bd.b = ev.b AND bd.bid = ev.e.parent_binding_id)
), ids AS (SELECT q, b, name, bid FROM bd UNION SELECT q, b, bid, bid FROM ab
), pp AS (SELECT a.id AS q, v AS reads, w.v AS writes FROM (SELECT id, writes, unnest(pats) AS p FROM ans WHERE reason IS NULL) a, unnest(a.p.vars) t(v), unnest(a.writes) s(w) WHERE w.n = a.p.n AND v <> w.v
), pairs AS (SELECT ids.q, ids.b, name AS reads, e.produces_variable AS writes FROM ids JOIN ev ON ev.q = ids.q AND ev.b = ids.b AND ev.e.parent_binding_id = ids.bid WHERE e.produces_variable IS NOT NULL
  UNION SELECT bs.question_id, bs.branch_id, reads, writes FROM bs JOIN pp ON pp.q = bs.question_id
), roots AS (SELECT q, b, name AS root FROM bd UNION SELECT q, b, e.produces_variable FROM ev WHERE e.produces_variable IS NOT NULL UNION SELECT q, b, bid FROM ab
), cl AS (SELECT q, b, root, root AS var FROM roots UNION SELECT cl.q, cl.b, root, writes FROM cl JOIN pairs ON pairs.q = cl.q AND pairs.b = cl.b AND pairs.reads = cl.var
), dm AS (SELECT q, b, root, string_agg(var, ',' ORDER BY var) AS doomed FROM cl GROUP BY 1, 2, 3
), dr AS (SELECT cl.q, cl.b, root, string_agg(DISTINCT name, ',' ORDER BY name) AS dropped FROM cl JOIN bd ON bd.q = cl.q AND bd.b = cl.b AND bd.name = cl.var GROUP BY 1, 2, 3
), lv AS (SELECT q, b, row_number() OVER () AS no, e FROM ev WHERE e IS NOT NULL AND NOT e.invalidated
), rv AS (
  SELECT DISTINCT cl.q, cl.b, root, no FROM cl JOIN lv ON lv.q = cl.q AND lv.b = cl.b AND lv.e.produces_variable = cl.var
  UNION SELECT cl.q, cl.b, root, no FROM cl JOIN ids ON ids.q = cl.q AND ids.b = cl.b AND ids.name = cl.var JOIN lv ON lv.q = cl.q AND lv.b = cl.b AND lv.e.parent_binding_id = ids.bid
), rr AS (SELECT rv.q, rv.b, root, count(*) AS n, string_agg(e.proof_id, ',' ORDER BY e.proof_id) AS revoked FROM rv JOIN lv USING (no) GROUP BY 1, 2, 3
), np AS (SELECT q, b, count(*) AS n FROM lv GROUP BY 1, 2)
SELECT dm.q AS question_id, dm.b AS branch_id, dm.root AS variable, doomed, coalesce(dropped, '') AS dropped, CAST(coalesce(rr.n, 0) AS INT) AS n_revoked, coalesce(revoked, '') AS revoked, CAST(coalesce(np.n, 0) AS INT) AS n_proofs
FROM dm LEFT JOIN dr USING (q, b, root) LEFT JOIN rr USING (q, b, root) LEFT JOIN np USING (q, b)"""
SQL["q23b_followup_scores"] = _P3.replace("WITH j AS", "WITH j AS", 1) + """, rl AS (
  SELECT id, i, max(CASE WHEN json_type(json_extract(o, '$.query_triple_index')) IN ('BIGINT', 'UBIGINT', 'INTEGER', 'VARCHAR', 'DOUBLE') THEN json_extract_string(o, '$.query_triple_index') END) AS given,
    max(CASE WHEN json_type(json_extract(o, '$.query_triple.relation')) = 'VARCHAR' THEN json_extract_string(o, '$.query_triple.relation') END) AS rel, min(CASE WHEN json_type(json_extract(o, '$.query_triple.relation_variants[0]')) = 'VARCHAR' THEN json_extract_string(o, '$.query_triple.relation_variants[0]') END) AS var FROM b WHERE json_type(o) = 'OBJECT' GROUP BY 1, 2
), rr AS (SELECT id AS question_id, 'c' || coalesce(given, CAST(i AS VARCHAR)) AS cid, arg_min(coalesce(nullif(rel, ''), var), i) AS relation FROM rl WHERE coalesce(given, rel, var) IS NOT NULL GROUP BY 1, 2
), bs AS (SELECT DISTINCT ON (question_id, branch_id) * FROM branch_states
), nb AS (SELECT question_id, branch_id, list_filter(list_transform(list_filter(map_values(coalesce(bindings, MAP {})), lambda x: x IS NOT NULL), lambda x: x.canonical_name), lambda n: n IS NOT NULL AND n <> '') AS names,
    unnest(CASE WHEN len(list_filter(coalesce(pending_constraints, []), lambda c: c IS NOT NULL)) > 0 THEN list_distinct(list_filter(pending_constraints, lambda c: c IS NOT NULL)) ELSE [NULL] END) AS cid FROM bs
), un AS (SELECT DISTINCT question_id, passage_id, doc_index, sent_index, visible, raw_text FROM text_units
), sc AS (SELECT nb.question_id, branch_id, nb.cid, passage_id, doc_index, sent_index, 2 * (len(list_filter(names, lambda n: contains(raw_text, n))) + CAST(coalesce(relation <> '' AND contains(raw_text, relation), false) AS INT)) AS score
  FROM nb LEFT JOIN rr ON rr.question_id = nb.question_id AND rr.cid = nb.cid JOIN un ON un.question_id = nb.question_id)
SELECT question_id, branch_id, cid, passage_id, CAST(score AS INT) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id, branch_id, cid ORDER BY score DESC, doc_index, sent_index, passage_id) AS rank FROM sc) WHERE rank <= 8"""
SQL["q49c_audit_rollup"] = "WITH i AS (" + SQL["q49_localization_audit"] + """), s AS (SELECT question_id, sum(n) FILTER (WHERE severity = 'hard') AS h, sum(n) FILTER (WHERE severity = 'soft') AS w FROM i GROUP BY 1)
SELECT id AS question_id, CAST(coalesce(h, 0) AS BIGINT) AS n_hard, CAST(coalesce(w, 0) AS BIGINT) AS n_soft, coalesce(h, 0) = 0 AS passed FROM (SELECT DISTINCT id FROM phase2_records) LEFT JOIN s ON s.question_id = id"""
SQL["q49d_graph_hints"] = _P3 + f""", kl AS (SELECT id, i, {_as_list("json_extract(o, '$.kg_triples')")} AS l FROM b WHERE json_type(o) = 'OBJECT'
), ke AS (SELECT id, i, k, json_extract(l, '$[' || k || ']') AS o FROM (SELECT id, i, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS k FROM kl WHERE l IS NOT NULL)
), kg AS (SELECT id, i, k, max(json_extract_string(o, '$.kg_triple_id')) AS kg_triple_id, max(json_extract_string(o, '$.head_entity_id')) AS head_entity_id, max(json_extract_string(o, '$.tail_entity_id')) AS tail_entity_id, max(json_extract_string(o, '$.relation')) AS relation FROM ke WHERE json_type(o) = 'OBJECT' GROUP BY 1, 2, 3)
SELECT id AS question_id, CAST(row_number() OVER (PARTITION BY id ORDER BY i, k) - 1 AS INT) AS compact_index, kg_triple_id, head_entity_id, tail_entity_id, relation FROM kg"""
SQL["q50b_gold_records"] = """WITH x AS (SELECT id, received_at, array_to_string(list_filter([ground_truth_answer, nullif(string_split(question, ' ')[1], '')], lambda a: a IS NOT NULL), ' | ') AS a FROM phase2_records)
SELECT id, arg_max(a, received_at) AS answer FROM x GROUP BY 1"""
SQL["q24b_two_stage"] = "WITH t AS (" + SQL["q24_vector_topk"] + """), s AS (SELECT query_id, t.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM t JOIN embeddings q ON q.vec_id = query_id JOIN embeddings v ON v.vec_id = t.vec_id)
SELECT query_id, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""


def _leaf(path: str) -> str:
    """A field's value as text, where it is no container."""
    x = f"json_extract(o, '{path}')"
    return f"CASE WHEN json_type({x}) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(o, '{path}') END"


def _whole(path: str) -> str:
    x = f"json_extract(o, '{path}')"
    return f"CASE WHEN json_type({x}) IN ('BIGINT', 'UBIGINT', 'INTEGER', 'UINTEGER', 'HUGEINT') THEN TRY_CAST(json_extract_string(o, '{path}') AS BIGINT) END"


_KEYED = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
SQL["q49b_evidence_audit"] = _P3 + f""", ro AS (SELECT id, i, max({_whole("$.query_triple_index")}) AS nth FROM b GROUP BY 1, 2
), rn AS (SELECT *, coalesce(nth >= 0 AND nth < count(*) OVER (PARTITION BY id), false) AS inside FROM ro
), kl AS (SELECT id, i, {_as_list("json_extract(o, '$.kg_triples')")} AS l FROM b WHERE json_type(o) = 'OBJECT'
), ke AS (SELECT id, i, k, json_extract(l, '$[' || k || ']') AS o FROM (SELECT id, i, l, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS k FROM kl WHERE l IS NOT NULL)
), kg AS (SELECT id, i, k, bool_or(json_type(o) = 'OBJECT') AS obj, max({_leaf("$.kg_triple_id")}) AS t, max({_leaf("$.head_entity_id")}) AS h, max({_leaf("$.tail_entity_id")}) AS g, max({_leaf("$.relation")}) AS r, max({_whole("$.head_entity_id")}) AS hi, max({_whole("$.tail_entity_id")}) AS gi FROM ke GROUP BY 1, 2, 3
), rc AS (
  SELECT CAST(upstream_index AS VARCHAR) AS t, CAST(TRY_CAST(regexp_extract({_KEYED.format("CASE WHEN raw_record IS NULL THEN head_id ELSE coalesce(raw_record->>'$.h', raw_record->>'$.head') END")}, '(\\d+)$', 1) AS BIGINT) AS VARCHAR) AS head,
    CAST(TRY_CAST(regexp_extract({_KEYED.format("CASE WHEN raw_record IS NULL THEN tail_id ELSE coalesce(raw_record->>'$.t', raw_record->>'$.tail') END")}, '(\\d+)$', 1) AS BIGINT) AS VARCHAR) AS tail,
    {_KEYED.format("CASE WHEN raw_record IS NULL THEN relation ELSE coalesce(raw_record->>'$.r', raw_record->>'$.relation') END")} AS rel FROM triples
), nd AS (SELECT kg.*, rc.t IS NOT NULL AS known, head, tail, rel FROM kg LEFT JOIN rc USING (t) WHERE obj
), en AS (SELECT id, unnest([hi, gi]) AS n FROM kg WHERE obj
), ids AS (SELECT CAST(upstream_id AS BIGINT) AS n FROM core_entities UNION SELECT CAST(upstream_id AS BIGINT) FROM entities
), ev AS (SELECT id, i, k, max({_whole("$.paragraph_idx")}) AS doc, max({_whole("$.sent_idx")}) AS sent, max({_leaf("$.title")}) AS title, max({_leaf("$.evidence")}) AS evidence, max({_leaf("$.context")}) AS context FROM d WHERE json_type(o) = 'OBJECT' GROUP BY 1, 2, 3
), se AS (SELECT DISTINCT question_id, doc_index, sent_index, title AS ut, raw_text FROM text_units
), lo AS (
  SELECT ev.id, ev.i, ev.k, sent, count(*) FILTER (WHERE (doc IS NULL OR doc = doc_index) AND (sent IS NULL OR sent = sent_index) AND (nullif(title, '') IS NULL OR coalesce(nullif(title, '') = ut, false)) AND (coalesce(nullif(evidence, ''), nullif(context, '')) IS NULL OR contains(raw_text, coalesce(nullif(evidence, ''), nullif(context, ''))))) AS n
  FROM ev JOIN rn ON rn.id = ev.id AND rn.i = ev.i AND inside JOIN se ON se.question_id = ev.id GROUP BY 1, 2, 3, 4
), iss AS (
  SELECT id, 'hard' AS severity, 'no triples evidence' AS message FROM (SELECT DISTINCT id FROM phase2_records) WHERE id NOT IN (SELECT id FROM ro)
  UNION ALL SELECT id, 'hard', 'query index out of range' FROM rn WHERE NOT inside
  UNION ALL SELECT id, 'hard', 'kg triple is not an object' FROM kg WHERE NOT obj
  UNION ALL SELECT id, 'hard', 'kg triple id missing' FROM nd WHERE NOT known
  UNION ALL SELECT id, 'hard', 'kg triple head mismatch' FROM nd WHERE known AND h IS NOT NULL AND h IS DISTINCT FROM head
  UNION ALL SELECT id, 'hard', 'kg triple tail mismatch' FROM nd WHERE known AND g IS NOT NULL AND g IS DISTINCT FROM tail
  UNION ALL SELECT id, 'hard', 'kg triple relation mismatch' FROM nd WHERE known AND {_KEYED.format("r")} IS DISTINCT FROM rel
  UNION ALL SELECT id, 'hard', 'kg entity id missing' FROM en WHERE n IS NOT NULL AND n NOT IN (SELECT n FROM ids WHERE n IS NOT NULL)
  UNION ALL SELECT id, 'hard', 'sentence index does not locate quote' FROM lo WHERE sent IS NOT NULL AND n = 0
  UNION ALL SELECT id, 'soft', 'quote unlocated' FROM lo WHERE sent IS NULL AND n = 0
  UNION ALL SELECT id, 'soft', 'quote in multiple spans' FROM lo WHERE n > 1)
SELECT id AS question_id, severity, message, count(*) AS n FROM iss GROUP BY 1, 2, 3
UNION ALL SELECT * FROM ({SQL["q49_localization_audit"]})"""
SQL["q48b_context_sentences"] = """WITH u AS (SELECT DISTINCT question_id, doc_index, title, sent_index, raw_text FROM text_units
), d AS (SELECT *, dense_rank() OVER (PARTITION BY question_id ORDER BY doc_index, coalesce(title, '')) - 1 AS di, row_number() OVER (PARTITION BY question_id, doc_index, title ORDER BY sent_index, raw_text) - 1 AS si FROM u)
SELECT question_id, CAST(di AS INT) AS doc_index, trim(title, ' ') AS title, CAST(si AS INT) AS sent_index, raw_text AS sentence FROM d"""
SQL["q61_synthetic_cohort"] = "SELECT printf('q%04d', i) AS question_id, 2 AS n_edges, 1 AS n_real, 2 * i + 1 AS real_index, true AS ok FROM range(20) t(i)"
