"""The queries in DuckDB SQL. Patterns avoid look-around, which DuckDB lacks."""

from __future__ import annotations

from vaultspark import lexicons as L
from vaultspark.functions.validators import dihedral, permutations
from vaultspark.operators.vault import GROUP_ORDERS
from vaultspark.plans.fixtures import ctes


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(e: str) -> str:
    return rf"regexp_replace({e}, '^\s+|\s+\z', '', 'g')"


def match(e: str, pattern: str, flags: str = "", group: int = 0) -> str:
    return f"nullif(regexp_extract({e}, {q((f'(?{flags})' if flags else '') + pattern)}, {group}), '')"


def matches(e: str, pattern: str, flags: str = "", group: int = 0) -> str:
    return f"regexp_extract_all({e}, {q((f'(?{flags})' if flags else '') + pattern)}, {group})"


def _class(e: str) -> str:
    scores = {n: " + ".join(f"(length({e}) - length(replace({e}, {q(w)}, ''))) // {len(w)}" for w in words) for n, words in L.DOC_TYPES.items()}
    best = "greatest(" + ", ".join(f"s{k}" for k in range(len(scores))) + ")"
    return ", ".join(f"{x} AS s{k}" for k, x in enumerate(scores.values())), f"CASE WHEN {best} = 0 THEN 'unknown' " + " ".join(f"WHEN s{k} = {best} THEN {q(n)}" for k, n in enumerate(scores)) + " END"


def classed(source: str, key: str) -> str:
    """A CTE of key and doc_type."""
    scores, best = _class("t")
    return f"(SELECT {key}, {best} AS doc_type FROM (SELECT {key}, {scores} FROM (SELECT {key}, lower(text) AS t FROM {source})))"


def unique(e: str) -> str:
    """A list's distinct elements in order."""
    return f"list_filter({e}, lambda x, i: list_position({e}, x) = i)"


_DATE = f"coalesce({match('text', L.DATE_NUMERIC, 'i')}, {match('text', L.DATE_NAMED, 'i')})"
_DOCTOR = f"nullif({strip('regexp_extract(text, ' + q(L.DOCTOR) + ', 1)')}, '')"
_HOSPITAL = f"nullif({strip('regexp_extract(text, ' + q(L.HOSPITAL) + ', 1)')}, '')"
_SURGERY = f"nullif({strip('regexp_extract(text, ' + q('(?i)' + L.SURGERY) + ', 1)')}, '')"
_DIAGNOSES = unique(f"list_filter(list_transform({matches('text', L.DIAGNOSIS, 'i', 1)}, lambda y: rtrim({strip('y')}, '.,;')), lambda y: y <> '')")
_DRUGS = unique(f"list_transform({matches('text', L.DRUG, 'i', 1)}, lambda y: {strip('y')})")
_ALLERGENS = f"CASE WHEN regexp_matches(text, {q('(?i)' + L.NO_ALLERGY)}) THEN [{q(L.NO_ALLERGY_LABEL)}] ELSE list_filter(list_transform({matches('text', L.ALLERGY, 'i', 1)}, lambda y: rtrim({strip('y')}, '.,;')), lambda y: length(y) > 2) END"
_KINDS = ", ".join(map(q, L.DRUG_DOC_TYPES))
_SEM = lambda e: f"CASE {e} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.DOC_SEMANTIC.items()) + " ELSE 'patient_information' END"

NOTES = ctes("notes")
FIELDED = f"""{NOTES}, nc AS MATERIALIZED {classed('notes', 'note_id')},
nf AS MATERIALIZED (SELECT notes.*, doc_type, {_DATE} AS visit_date, {_DOCTOR} AS doctor_name, {_HOSPITAL} AS hospital, {_SURGERY} AS surgery_type, {_DIAGNOSES} AS diagnosis, CASE WHEN doc_type IN ({_KINDS}) THEN {_DRUGS} ELSE [] END AS drugs, {_ALLERGENS} AS allergens
  FROM notes JOIN nc USING (note_id))"""

_REGISTER = """hd AS (SELECT patient_id, note_id AS id, file_name AS name, k AS doc_type, CASE k WHEN 'prescription' THEN 'medication_history' WHEN 'imaging_scan' THEN 'lab_reports' WHEN 'lab_report' THEN 'lab_reports' ELSE 'patient_information' END AS semantic_type,
 CASE WHEN note_id % 2 = 0 THEN 'patient' ELSE 'doctor' END AS uploaded_by, CASE WHEN note_id % 7 <> 0 THEN '2024-03-0' || cast(note_id % 9 + 1 AS varchar) ELSE '' END AS date
 FROM (SELECT *, ['prescription', 'imaging_scan', 'admission_intake', 'lab_report', 'unknown'][note_id % 5 + 1] AS k FROM notes))"""

ORACLE: dict[str, str] = {
    "tokenize_counts": r"""SELECT doc_id, cast(len(t) AS bigint) AS n_tokens, cast(len(list_distinct(t)) AS bigint) AS n_distinct, cast(len(regexp_extract_all(text, '[^\s\p{Z}\x{85}\x0B]+')) AS bigint) AS n_words
FROM (SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS t FROM documents)""",
    "garbage_text": r"SELECT doc_id, len(w) = 0 OR len(list_filter(w, lambda x: length(x) <= 2)) / greatest(len(w), 1) > 0.5 AS is_garbage FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)",
    "doc_classify": f"{NOTES} SELECT * FROM {classed('notes', 'note_id')}",
    "doc_classify_corpus": f"SELECT * FROM {classed('documents', 'doc_id')}",
    "doc_semantic_default": f"{NOTES} SELECT doc_type, {_SEM('doc_type')} AS semantic_type, count(*) AS n FROM {classed('notes', 'note_id')} GROUP BY 1, 2",
    "field_date": f"{NOTES} SELECT note_id, {_DATE} AS visit_date FROM notes",
    "field_doctor": f"{NOTES} SELECT note_id, {_DOCTOR} AS doctor_name FROM notes",
    "field_hospital": f"{NOTES} SELECT note_id, {_HOSPITAL} AS hospital FROM notes",
    "field_surgery": f"{NOTES} SELECT note_id, {_SURGERY} AS surgery_type FROM notes",
    "field_diagnoses": f"{NOTES} SELECT note_id, array_to_string({_DIAGNOSES}, '|') AS diagnosis FROM notes",
    "field_drugs": f"{FIELDED} SELECT note_id, array_to_string(drugs, '|') AS drugs FROM nf",
}

_LABS = f"""{FIELDED}, pairs AS (SELECT note_id, unnest(list_transform({matches('text', L.LAB_VALUE, '', 1)}, lambda y: lower({strip('y')}))) AS name, unnest(list_transform({matches('text', L.LAB_VALUE, '', 2)}, lambda y: {strip('y')})) AS value, unnest(range(len({matches('text', L.LAB_VALUE)}))) AS pos FROM nf WHERE doc_type = 'lab_report'),
labs AS (SELECT note_id, name, arg_max(value, pos) AS value FROM pairs WHERE length(name) > 3 AND value <> '' GROUP BY 1, 2)"""
_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;')"

ORACLE |= {
    "field_lab_values": f"{_LABS} SELECT * FROM labs",
    "lab_json_roundtrip": f"{_LABS} SELECT note_id, max(value) FILTER (name = 'haemoglobin') AS haemoglobin, count(*) AS n_values FROM labs GROUP BY 1",
}

_HEAD = f"'(?im){L.SECTION_HEADER}'"
_SECTIONS = f"""{FIELDED}, sp AS (SELECT note_id, doc_type, regexp_split_to_array(text, {_HEAD}) AS parts, regexp_extract_all(text, {_HEAD}) AS heads, text FROM nf WHERE doc_type = 'discharge_summary'),
sx AS (SELECT note_id, doc_type, 0 AS o, '' AS header, CASE WHEN len(heads) = 0 THEN text ELSE {strip('parts[1]')} END AS section, len(heads) AS h FROM sp
  UNION ALL SELECT note_id, doc_type, unnest(range(1, len(heads) + 1)), unnest(list_transform(heads, lambda x: {strip('x')})), unnest(list_transform(heads, lambda x, i: {strip(f"({strip('x')} || chr(10) || {strip('parts[i + 1]')})")})), len(heads) FROM sp),
sections AS (SELECT note_id, doc_type, cast(row_number() OVER (PARTITION BY note_id ORDER BY o) - 1 AS integer) AS pos, header, section FROM sx WHERE length(section) > 20 OR h = 0)"""
_OF_HEADER = "CASE " + " ".join(f"WHEN contains(regexp_replace(lower(header), ':+$', ''), {q(k)}) THEN {q(v)}" for k, v in L.SECTION_SEMANTIC.items()) + f" ELSE {_SEM('doc_type')} END"
_FIND = r"nullif(regexp_extract(text, '(?is)(findings[:\s]+.*?)(?:impression|\z)', 1), '')"
_IMPR = r"nullif(regexp_extract(text, '(?is)impression[:\s]+.*\z'), '')"
_VERD = r"nullif(regexp_extract(text, '(?is)(?:diagnosis|conclusion)[:\s]+.*\z'), '')"
_LHEAD = f"'(?im){L.LAB_HEADER}'"
ORACLE |= {
    "section_split": f"{_SECTIONS} SELECT note_id, pos, header, section, {_OF_HEADER} AS semantic_type FROM sections",
    "chunk_dispatch": f"""{_SECTIONS}, lp AS (SELECT note_id, regexp_split_to_array(text, {_LHEAD}) AS parts, regexp_extract_all(text, {_LHEAD}) AS heads FROM nf WHERE doc_type = 'lab_report'),
lx AS (SELECT note_id, 0 AS o, {strip('parts[1]')} AS t FROM lp WHERE len(heads) > 0 UNION ALL SELECT note_id, unnest(range(1, len(heads) + 1)), unnest(list_transform(heads, lambda x, i: {strip(f"({strip('x')} || chr(10) || {strip('parts[i + 1]')})")})) FROM lp),
c AS (
 SELECT note_id, cast(pos AS bigint) AS o, {_OF_HEADER} AS semantic_type, section AS t FROM sections WHERE note_id IN (SELECT note_id FROM sections GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT note_id, o, 'lab_reports', t FROM lx WHERE length(t) > 20 AND note_id IN (SELECT note_id FROM lx WHERE length(t) > 20 GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT note_id, 0, 'medication_history', {strip('text')} FROM nf WHERE doc_type = 'prescription'
 UNION ALL SELECT note_id, 0, 'surgical_history', {strip('text')} FROM nf WHERE doc_type = 'operative_notes'
 UNION ALL SELECT note_id, 0, 'lab_reports', {strip(_FIND)} FROM nf WHERE doc_type = 'imaging_report' AND {_FIND} IS NOT NULL
 UNION ALL SELECT note_id, 1, 'diagnosis', {strip(_IMPR)} FROM nf WHERE doc_type = 'imaging_report' AND {_IMPR} IS NOT NULL
 UNION ALL SELECT note_id, 0, 'surgical_history', {strip(f"text[1:length(text) - length({_VERD})]")} FROM nf WHERE doc_type = 'biopsy_report' AND {_VERD} IS NOT NULL
 UNION ALL SELECT note_id, 1, 'diagnosis', {strip(_VERD)} FROM nf WHERE doc_type = 'biopsy_report' AND {_VERD} IS NOT NULL),
every AS (SELECT * FROM c UNION ALL SELECT note_id, 0, {_SEM('doc_type')}, text FROM nf WHERE note_id NOT IN (SELECT note_id FROM c)),
n AS (SELECT *, cast(row_number() OVER (PARTITION BY note_id ORDER BY o) - 1 AS integer) AS chunk_index, cast(count(*) OVER (PARTITION BY note_id) AS integer) AS total_chunks FROM every)
SELECT note_id, chunk_index, total_chunks, semantic_type, t AS text FROM n WHERE {strip('t')} <> ''""",
    "chunk_ids": f"{NOTES} SELECT note_id, md5(cast(patient_id AS varchar) || '::' || file_path || '::0') AS chunk_id, md5('scan::' || cast(patient_id AS varchar) || '::' || file_path || '::0') AS scan_id FROM notes",
    "llm_section_parse": f"""{NOTES} SELECT note_id, cast(0 AS integer) AS pos, CASE WHEN note_id % 3 <> 0 THEN 'diagnosis' ELSE 'follow_up_notes' END AS semantic_type, CASE WHEN note_id % 3 <> 0 THEN 'seen ' || file_name || chr(10) || 'more lines' ELSE {strip('text')} END AS text FROM notes
UNION ALL SELECT note_id, 1, 'medication_history', 'none' FROM notes WHERE note_id % 3 <> 0""",
    "extract_choose": f"""{ctes('candidates')} SELECT id, CASE id WHEN 0 THEN 'plaintext' WHEN 1 THEN 'pymupdf' WHEN 2 THEN 'pymupdf' WHEN 3 THEN 'doctr' WHEN 4 THEN 'gemini' WHEN 5 THEN 'doctr_fallback' WHEN 6 THEN 'gemini' WHEN 7 THEN 'doctr' ELSE 'doctr_fallback' END AS extraction_method,
CASE WHEN id = 0 THEN 'plain words' WHEN id IN (1, 2) THEN layer_text WHEN id IN (4, 6) THEN vision_text ELSE ocr_text END AS text FROM candidates""",
    "ocr_word_confidence": f"{ctes('words')} SELECT page_id, round(avg(confidence), 4) AS confidence FROM words GROUP BY 1",
    "upsert_latest": f"""{NOTES}, k AS (SELECT cast(patient_id AS varchar) || '/' || file_name AS key, note_id FROM notes),
new AS (SELECT key, max(note_id) AS note_id FROM k WHERE note_id % 2 = 1 GROUP BY 1) SELECT * FROM new UNION ALL SELECT key, min(note_id) FROM k WHERE note_id % 2 = 0 AND key NOT IN (SELECT key FROM new) GROUP BY 1""",
    "replace_file": f"{NOTES} SELECT patient_id, file_path, note_id FROM notes n WHERE note_id % 2 = 1 OR NOT EXISTS (SELECT 1 FROM notes m WHERE m.note_id % 2 = 1 AND m.patient_id = n.patient_id AND m.file_path = n.file_path)",
    "update_rows": f"{ctes('appts')} SELECT id, CASE WHEN id % 10 = 0 THEN 'completed' ELSE status END AS status, type FROM appts",
    "page_join": f"""{ctes('words')}, p AS (SELECT 'f' || cast(page_id % 500 AS varchar) AS file_path, words.at AS pg, max(CASE WHEN words.at % 3 > 0 THEN word END) AS t FROM words GROUP BY ALL),
j AS (SELECT file_path, length(string_agg('[PAGE ' || cast(pg AS varchar) || ']' || chr(10) || t, chr(10) || chr(10) ORDER BY pg)) AS n FROM p WHERE t IS NOT NULL GROUP BY 1)
SELECT file_path, cast(n AS integer) AS n_chars, d AS is_digital FROM j JOIN (SELECT file_path, coalesce(sum(length(t)), 0) >= 50 AS d FROM p GROUP BY 1) USING (file_path)""",
    "vision_pages": f"""{ctes('words')}, p AS (SELECT 'f' || cast(page_id % 500 AS varchar) AS file_path, words.at AS pg, max(word) AS w FROM words GROUP BY ALL)
SELECT file_path, string_agg('seen ' || cast(length(w) AS varchar) || ' bytes', chr(10) || chr(10) || '[PAGE BREAK]' || chr(10) || chr(10) ORDER BY pg) AS text FROM p GROUP BY 1""",
    "split_bars": f"""{ctes('appts')}, x AS (SELECT id, list_filter([type, coalesce(checked_in_at, ''), status], lambda y: y <> '') AS parts FROM appts)
SELECT id, unnest(range(len(parts)))::integer AS at, unnest(parts) AS part FROM x""",
    "document_headers": f"{NOTES}, {_REGISTER} SELECT * FROM hd",
    "patient_dashboard": f"""{ctes('notes', 'appts')}, {_REGISTER}, x AS (SELECT patient_id, count(*) AS n_documents, count(*) FILTER (semantic_type = 'medication_history') AS n_medication FROM hd GROUP BY 1), y AS (SELECT patient_id, count(*) AS n_appointments FROM appts GROUP BY 1)
SELECT patient_id, coalesce(n_documents, 0) AS n_documents, coalesce(n_medication, 0) AS n_medication, coalesce(n_appointments, 0) AS n_appointments FROM x FULL JOIN y USING (patient_id)""",
    "sink_append": f"{ctes('appts')} SELECT id, status FROM appts",
    "sink_reports": f"{ctes('arm_scores')} SELECT page_id, arm, chars::bigint AS chars, confidence FROM arm_scores WHERE confidence IS NOT NULL",
    "upload_route": f"{ctes('paths')} SELECT id, CASE WHEN regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tiff)$') THEN 'imaging' ELSE 'text' END AS pipeline FROM paths",
}


def _repair(e: str) -> str:
    for a, b in L.CHARACTER_FIXES:
        for _ in range(2):
            e = rf"regexp_replace({e}, '([a-zA-Z]){a}([a-zA-Z])', '\1{b}\2', 'g')"
    return rf"regexp_replace(regexp_replace({e}, '\brn([aeiou])', 'm\1', 'g'), '\s{{2,}}', ' ', 'g')"


def _expand(e: str) -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"  # DuckDB's \b knows ASCII alone
    for a, b in L.ABBREVIATIONS:
        for _ in range(1 if a in b.lower() else 2):
            e = rf"regexp_replace({e}, '(?i)(^|{edge}){a}($|{edge})', '\1{b}\2', 'g')"
    return e


def _route(pick: int) -> str:
    any_of = lambda words: " OR ".join(f"contains(lower(question), {q(w)})" for w in words)
    return "CASE " + " ".join(f"WHEN {any_of(r[2])} THEN {q(r[pick])}" for r in L.ROUTES) + f" ELSE {q((L.DEFAULT_CLASS, L.DEFAULT_ROUTE)[pick])} END"


_ASKED = ctes("asked")
ORACLE |= {
    "query_char_fix": f"{_ASKED} SELECT question_id, {_repair('question')} AS repaired FROM asked",
    "query_abbrev": f"{_ASKED} SELECT question_id, {_expand('question')} AS expanded FROM asked",
    "query_route": f"{_ASKED} SELECT question_id, {_route(0)} AS query_class, {_route(1)} AS route FROM asked",
    "agent_confidence": f"{_ASKED} SELECT question_id, CASE WHEN question = '' OR contains(lower(question), 'no records') OR contains(lower(question)[1:30], 'no ') THEN 40.0::double ELSE 85.0::double END AS confidence FROM asked",
    "agent_dispatch": f"""{FIELDED}, h AS (SELECT patient_id, bool_or(len(allergens) > 0) AS a, bool_or(len(drugs) > 0) AS m, bool_or(len(diagnosis) > 0) AS g, bool_or(surgery_type IS NOT NULL) AS s FROM nf GROUP BY 1),
x AS (SELECT c_custkey AS p, route, CASE route WHEN 'timeline_agent' THEN h.patient_id IS NOT NULL WHEN 'admission_agent' THEN coalesce(a OR m OR g OR s, false) WHEN 'medication_agent' THEN coalesce(m, false) WHEN 'allergy_agent' THEN coalesce(a, false) WHEN 'surgery_agent' THEN coalesce(s, false) ELSE true END AS f,
 route = 'admission_agent' AND NOT coalesce(g, false) AND NOT coalesce(m, false) AS low FROM customer CROSS JOIN (SELECT unnest(['timeline_agent', 'admission_agent', 'medication_agent', 'allergy_agent', 'surgery_agent', 'rag_agent']) AS route) LEFT JOIN h ON patient_id = c_custkey)
SELECT cast(p AS varchar) || '-' || route AS question_id, CASE WHEN f THEN route ELSE route || '->rag_fallback' END AS route, CASE WHEN f AND route <> 'rag_agent' THEN CASE WHEN low THEN 40.0::double ELSE 85.0::double END END AS confidence FROM x""",
}


def _bm25(source: str, where: str = "", late: str = "") -> str:
    """CTEs up to b(question_id, chunk_id, score, rank): the best 20 of each question. source: chunk_id, patient_id, text..."""
    return f"""tok AS MATERIALIZED (SELECT patient_id, chunk_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1) AS t FROM {source}),
post AS MATERIALIZED (SELECT patient_id, chunk_id, dl, token, count(*) AS tf FROM (SELECT patient_id, chunk_id, len(t) AS dl, unnest(t) AS token FROM tok) GROUP BY ALL),
size AS (SELECT patient_id, count(*) AS n, avg(len(t)) AS avgdl FROM tok GROUP BY 1),
term AS MATERIALIZED (SELECT patient_id, token, count(*) AS df, any_value(n) AS n, any_value(avgdl) AS avgdl, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post JOIN size USING (patient_id) GROUP BY 1, 2),
mean AS (SELECT patient_id, avg(raw) AS mean FROM term GROUP BY 1),
qt AS (SELECT question_id, patient_id, token, count(*) AS times FROM (SELECT question_id, patient_id, unnest(list_filter(regexp_extract_all(lower(question), '[a-z0-9]+'), lambda x: length(x) > 1)) AS token FROM questions) GROUP BY ALL),
sc AS (SELECT question_id, chunk_id, round(sum(times * CASE WHEN raw < 0 THEN {L.BM25_EPSILON} * mean ELSE raw END * tf * ({L.BM25_K1} + 1) / (tf + {L.BM25_K1} * (1 - {L.BM25_B} + {L.BM25_B} * dl / avgdl))), 6) AS score FROM qt JOIN term USING (patient_id, token) JOIN mean USING (patient_id) JOIN post USING (patient_id, token) GROUP BY 1, 2),
b AS MATERIALIZED (SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM sc) WHERE rank <= {L.TOP_CANDIDATES} AND score > 0)"""


_COS = "round(list_dot_product(embedding::double[], query_vector::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(query_vector::double[], query_vector::double[]))), 4)"
_DOCS = "(SELECT source AS patient_id, doc_id AS chunk_id, text FROM documents)"
_HYBRID = f"""{ctes('chunks', 'questions')}, {_bm25('chunks')},
v AS MATERIALIZED (SELECT * FROM (SELECT question_id, chunk_id, score, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM (SELECT question_id, chunk_id, {_COS} AS score FROM chunks JOIN questions USING (patient_id))) WHERE rank <= {L.TOP_CANDIDATES}),
u AS (SELECT question_id, chunk_id, rank, 0 AS l FROM v UNION ALL SELECT question_id, chunk_id, rank, 1 FROM b),
f AS (SELECT question_id, text, round(sum(1.0::double / ({L.RRF_K} + rank)), 6) AS rrf_score, arg_max(u.chunk_id, l * 1000 + rank) AS chunk_id, coalesce(min(rank) FILTER (l = 0), 1000000) AS v, coalesce(min(rank) FILTER (l = 1), 1000000) AS w FROM u JOIN chunks USING (chunk_id) GROUP BY 1, 2),
fused AS MATERIALIZED (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY rrf_score DESC, v, w) AS integer) AS position FROM f)"""
_SET = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[a-z0-9]+'))"
_HITS = f"""{_HYBRID}, ws AS (SELECT fused.*, {_SET('fused.text')} AS x, {_SET('question')} AS y FROM fused JOIN questions USING (question_id) WHERE position <= {L.TOP_FINAL}),
rr AS (SELECT *, round(coalesce(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0), 0), 6) AS rerank_score FROM ws),
hits AS MATERIALIZED (SELECT rr.*, cast(row_number() OVER (PARTITION BY question_id ORDER BY rerank_score DESC, position) AS integer) AS final, file_name, doc_type, semantic_type, visit_date FROM rr JOIN chunks USING (chunk_id))"""
ORACLE |= {
    "bm25_topk": f"{ctes('questions')}, {_bm25(_DOCS)} SELECT question_id, chunk_id, rank, score AS bm25_score FROM b",
    "bm25_filtered": f"{ctes('questions')}, {_bm25(_DOCS)} SELECT question_id, chunk_id, rank, score AS bm25_score FROM b JOIN documents ON doc_id = chunk_id WHERE lang = 'en'",
    "vector_topk": f"""SELECT question_id, patient_id, chunk_id, score, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM (
SELECT q.vec_id AS question_id, cast(q.label AS varchar) AS patient_id, e.vec_id AS chunk_id, {_COS.replace('query_vector', 'q.embedding').replace('(embedding', '(e.embedding').replace(', embedding', ', e.embedding')} AS score FROM embeddings e JOIN embeddings q ON e.label = q.label AND q.vec_id % 20 = 0)) WHERE rank <= {L.TOP_CANDIDATES}""",
    "vector_filtered": f"{ctes('chunks', 'questions')} SELECT * FROM (SELECT *, cast(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS integer) AS rank FROM (SELECT question_id, chunk_id, {_COS} AS score FROM chunks JOIN questions USING (patient_id) WHERE semantic_type = 'diagnosis')) WHERE rank <= {L.TOP_CANDIDATES}",
    "vector_unit": "SELECT vec_id, 1.0::double AS length2, round(embedding[1]::double / sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) AS x0 FROM embeddings",
    "rrf_fuse": f"{_HYBRID} SELECT question_id, position, chunk_id, rrf_score FROM fused WHERE position <= 40",
    "hybrid_topk": f"{_HYBRID} SELECT question_id, position, chunk_id, rrf_score FROM fused WHERE position <= {L.TOP_FINAL}",
    "rerank_topk": f"{_HITS} SELECT question_id, final, chunk_id, rerank_score FROM hits",
    "rag_context": f"""{_HITS}, w AS (SELECT question_id, string_agg('[' || cast(final AS varchar) || '] ' || file_name || ' (' || doc_type || ' / ' || semantic_type || CASE WHEN coalesce(visit_date, '') <> '' THEN ', ' || visit_date ELSE '' END || ')' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY final) AS c FROM hits GROUP BY 1)
SELECT question_id, CASE WHEN length(c) > {L.CONTEXT_CHARS} THEN c[1:{L.CONTEXT_CHARS}] || chr(10) || chr(10) || '[context truncated]' ELSE c END AS context FROM w""",
    "confidence_score": f"""{_HITS}, m AS (SELECT question_id, max(c) AS modal FROM (SELECT question_id, semantic_type, count(*) AS c FROM hits GROUP BY 1, 2) GROUP BY 1),
a AS (SELECT question_id, avg(rerank_score) AS rr, avg(rrf_score) AS rt, count(*) AS n FROM hits GROUP BY 1), s AS (SELECT question_id, round(least(greatest(least(greatest((rr + 1) / 2, 0), 1) * 40 + least(greatest(rt, 0), 1) * 30 + modal / n * 30, 0), 100), 1) AS confidence FROM a JOIN m USING (question_id))
SELECT question_id, confidence, CASE WHEN confidence >= {L.CONFIDENCE_HIGH} THEN 'HIGH' WHEN confidence >= {L.CONFIDENCE_MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS quality FROM s""",
    "rag_confidence": f"{_HITS} SELECT question_id, round(least(greatest((avg(rerank_score) + 5) / 10 * 100, 0), 100), 1) AS confidence FROM hits GROUP BY 1",
}

_YEAR = f"coalesce({match('visit_date', L.YEAR)}, 'Unknown Year')"
_TITLE = "array_to_string(list_transform(string_split(doc_type, '_'), lambda x: upper(x[1]) || x[2:]), ' ')"
_TIMELINE = f"""{FIELDED}, one AS (SELECT * FROM nf QUALIFY row_number() OVER (PARTITION BY patient_id, file_name ORDER BY chunk_index, chunk_id) = 1),
ev AS (SELECT patient_id, {_YEAR} AS year, visit_date AS date, coalesce(nullif(concat_ws(' | ', CASE WHEN len(diagnosis) > 0 THEN 'Diagnosed: ' || array_to_string(diagnosis, ', ') END, 'Surgery: ' || surgery_type, CASE WHEN len(drugs) > 0 THEN 'Medications: ' || array_to_string(drugs[1:3], ', ') END), ''), {_TITLE} || ' on file') AS event, doctor_name AS doctor, hospital, file_name AS source FROM one),
tl AS MATERIALIZED (SELECT *, cast(row_number() OVER (PARTITION BY patient_id ORDER BY year = 'Unknown Year', year, coalesce(date, ''), source) AS integer) AS place FROM ev)"""
_MEDS = f"""{FIELDED}, me AS (SELECT patient_id, file_name, chunk_index, visit_date AS date, unnest(drugs) AS name, unnest(range(len(drugs))) AS pos FROM nf),
meds AS (SELECT patient_id, name, file_name AS source, date FROM me QUALIFY row_number() OVER (PARTITION BY patient_id, lower(name), file_name ORDER BY chunk_index, pos) = 1)"""
_ALLS = f"""{FIELDED}, ae AS (SELECT patient_id, file_name, chunk_index, visit_date AS date, unnest(allergens) AS allergen, unnest(range(len(allergens))) AS pos FROM nf),
alls AS (SELECT patient_id, allergen, file_name AS source, date FROM ae QUALIFY row_number() OVER (PARTITION BY patient_id, lower(allergen), file_name ORDER BY chunk_index, pos) = 1)"""
_SURG = f"""{FIELDED}, surg AS (SELECT patient_id, surgery_type AS procedure, doctor_name AS doctor, hospital, visit_date AS date, file_name AS source FROM nf WHERE surgery_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY patient_id, lower(surgery_type), file_name ORDER BY chunk_index) = 1)"""
_NL = "chr(10)"


def _list(title: str, total: str, source: str, line: str, order: str) -> str:
    return f"SELECT patient_id, '{title} — ' || cast(patient_id AS varchar) || {_NL} || '{'=' * (50 if title == 'Admission Summary' else 40)}' || {_NL} || '{total}: ' || cast(count(*) AS varchar) || {_NL} || {_NL} || string_agg({line}, {_NL} ORDER BY {order}) AS answer FROM {source} GROUP BY patient_id"


def _opt(label: str, c: str) -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN {_NL} || '    {label}: ' || {c} ELSE '' END"


_ENTRY = lambda mark, c: f"'  {mark} ' || {c} || CASE WHEN date IS NOT NULL THEN '  [' || date || ']' ELSE '' END || '  (from: ' || source || ')'"
_FLAT = lambda c: f"list_sort(list_distinct(flatten(list({c}))))"
_ONE = lambda c: f"coalesce(list_sort(list(DISTINCT {c}) FILTER ({c} IS NOT NULL)), [])"
_SETS = {"allergies": _FLAT("allergens"), "medications": _FLAT("drugs"), "diagnoses": _FLAT("diagnosis"), "surgeries": _ONE("surgery_type"), "doctors": _ONE("doctor_name"), "hospitals": _ONE("hospital")}
_SUMMARY = f"{FIELDED}, su AS (SELECT patient_id, {', '.join(f'{e} AS {n}' for n, e in _SETS.items())}, max(visit_date) AS latest_visit, count(DISTINCT file_name) AS document_count FROM nf GROUP BY 1)"
_BUL = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string(list_transform({c}, lambda x: '  • ' || x), {_NL}) ELSE '  None on record' END"
_FORM = f" || {_NL} || ".join(["'Admission Summary — ' || cast(patient_id AS varchar)", f"'{'=' * 50}'", "'Documents on file: ' || cast(document_count AS varchar)", "'Latest visit: ' || coalesce(latest_visit, 'Unknown')", *(x for t, c in (("ALLERGIES:", "allergies"), ("CURRENT MEDICATIONS:", "medications"), ("DIAGNOSES / CONDITIONS:", "diagnoses"), ("SURGICAL HISTORY:", "surgeries"), ("TREATING DOCTORS:", "doctors"), ("HOSPITALS:", "hospitals")) for x in ("''", q(t), _BUL(c)))])
ORACLE |= {
    "vault_timeline": f"{_TIMELINE} SELECT * FROM tl",
    "timeline_text": f"""{_TIMELINE}, ln AS (SELECT *, CASE WHEN lag(year) OVER (PARTITION BY patient_id ORDER BY place) = year THEN '' ELSE {_NL} || year || {_NL} || repeat('-', length(year)) || {_NL} END
 || '  • ' || event || {_opt('Doctor', 'doctor')} || {_opt('Hospital', 'hospital')} || CASE WHEN date IS NOT NULL AND date <> year THEN {_NL} || '    Date: ' || date ELSE '' END || {_NL} || '    Source: ' || source AS t FROM tl)
SELECT patient_id, 'Medical Timeline — ' || cast(patient_id AS varchar) || {_NL} || '{'=' * 50}' || {_NL} || {_NL} || string_agg(t, {_NL} ORDER BY place) || {_NL} || {_NL} || '[' || cast(count(*) AS varchar) || ' event(s) found]' AS answer FROM ln GROUP BY 1""",
    "vault_medications": f"{_MEDS} SELECT * FROM meds",
    "vault_allergies": f"{_ALLS} SELECT * FROM alls",
    "vault_surgeries": f"{_SURG} SELECT * FROM surg",
    "vault_summary": f"{_SUMMARY} SELECT patient_id, {', '.join(f"array_to_string({n}, ' | ') AS {n}" for n in _SETS)}, latest_visit, document_count FROM su",
    "summary_text": f"{_SUMMARY} SELECT patient_id, CASE WHEN len(diagnoses) = 0 AND len(medications) = 0 THEN 'No records found to generate an admission summary.' ELSE {_FORM} END AS answer FROM su",
    "medications_text": f"{_MEDS} {_list('Medications', 'Total', 'meds', _ENTRY('•', 'name'), "coalesce(date, ''), name, source")}",
    "allergies_text": f"{_ALLS} {_list('Allergies', 'Total', 'alls', _ENTRY('⚠', 'allergen'), 'allergen, source')}",
    "surgeries_text": f"{_SURG} {_list('Surgical History', 'Total procedures', 'surg', f"'  • ' || procedure || {_opt('Date', 'date')} || {_opt('Surgeon', 'doctor')} || {_opt('Hospital', 'hospital')} || {_opt('Source', 'source')}", "coalesce(date, ''), procedure, source")}",
    "vault_inspect": f"""{FIELDED}, c AS (SELECT patient_id, file_name, {_SEM('doc_type')} AS s, count(*) AS n FROM nf GROUP BY ALL), h AS (SELECT patient_id, file_name, string_agg(s || '=' || cast(n AS varchar), ',' ORDER BY s || '=' || cast(n AS varchar)) AS semantic_counts FROM c GROUP BY 1, 2)
SELECT patient_id, file_name, count(*) AS n_chunks, arg_min(doc_type, chunk_index) AS doc_type, any_value(semantic_counts) AS semantic_counts FROM nf JOIN h USING (patient_id, file_name) GROUP BY 1, 2""",
    "vault_groups": f"{ctes('chunks')} SELECT patient_id, semantic_type, count(DISTINCT file_name) AS n_files, cast(CASE semantic_type {' '.join(f'WHEN {q(s)} THEN {k + 1}' for k, s in enumerate(GROUP_ORDERS['clinical']))} END AS integer) AS group_order FROM chunks GROUP BY 1, 2",
}

_TAKEN = "status NOT IN ('pending', 'declined')"
_MIN = f"CASE type {' '.join(f'WHEN {q(k)} THEN {v}' for k, v in L.CONSULT_MINUTES.items())} ELSE {L.OTHER_MINUTES} END"
_LIVE = "status IN ('checked_in', 'in_consultation')"


def _access(other: str) -> str:
    return f"""{ctes('requests', 'staff')}, taken AS (SELECT DISTINCT doctor_id, patient_id FROM appts WHERE {_TAKEN}), near AS (SELECT DISTINCT lower(hospital) AS h, patient_id FROM taken JOIN staff ON staff.id = doctor_id)
SELECT request_id, CASE WHEN requester_id = r.patient_id THEN true WHEN role = 'doctor' THEN t.patient_id IS NOT NULL WHEN role IN ('tpa', 'lab', 'admin') THEN n.patient_id IS NOT NULL ELSE {other} END AS allowed
FROM requests r LEFT JOIN taken t ON t.doctor_id = requester_id AND t.patient_id = r.patient_id LEFT JOIN near n ON n.h = lower(requester_hospital) AND n.patient_id = r.patient_id"""


ORACLE |= {
    "access_doctor_patients": f"{ctes('appts', 'users')} SELECT DISTINCT doctor_id, u.id, name FROM appts a JOIN users u ON u.id = a.patient_id WHERE {_TAKEN}",
    "access_hospital_patients": f"{ctes('appts', 'users', 'staff')} SELECT DISTINCT lower(hospital) AS hospital, u.id, u.name FROM appts a JOIN users u ON u.id = a.patient_id JOIN staff d ON d.id = doctor_id WHERE {_TAKEN}",
    "access_check": _access("true"),
    "access_check_fixed": _access("false"),
    "appointments_public": f"{ctes('appts', 'users', 'staff')} SELECT a.id, coalesce(u.name, cast(patient_id AS varchar)) AS patient_name, coalesce(d.name, cast(doctor_id AS varchar)) AS doctor_name, dept, hospital, status FROM appts a LEFT JOIN users u ON u.id = patient_id LEFT JOIN staff d ON d.id = doctor_id",
    "checkin_window": f"{ctes('appts')} SELECT id, status = 'accepted' AND (epoch(time) - epoch(TIMESTAMP '1996-06-15 10:00:00')) / 60 <= {L.CHECKIN_MINUTES} AS can_check_in FROM appts",
    "queue_position": f"""{ctes('appts', 'staff')}, l AS (SELECT *, row_number() OVER w AS position, coalesce(sum({_MIN}) OVER (PARTITION BY doctor_id, date_trunc('month', time) ORDER BY time, coalesce(checked_in_at, ''), id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM appts WHERE {_LIVE} WINDOW w AS (PARTITION BY doctor_id, date_trunc('month', time) ORDER BY time, coalesce(checked_in_at, ''), id))
SELECT a.id, a.status, cast(position AS integer) AS position, cast(position - 1 AS integer) AS ahead_count, cast(ahead AS bigint) AS estimated_wait_minutes, a.status = 'in_consultation' AS is_current, CASE WHEN position IS NOT NULL THEN strftime(a.time + INTERVAL '1' MINUTE * coalesce(drift, 0), '%Y-%m-%d %H:%M:%S') END AS estimated_call_time, coalesce(drift, 0) AS drift_minutes FROM appts a LEFT JOIN l ON l.id = a.id LEFT JOIN staff d ON d.id = a.doctor_id""",
    "next_appointment": f"{ctes('appts')} SELECT patient_id, id, status FROM appts WHERE {_LIVE} OR status = 'accepted' QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY CASE WHEN {_LIVE} THEN 0 ELSE 1 END, time, id) = 1",
    "doctor_lists": f"{ctes('appts')} SELECT doctor_id, list, cast(row_number() OVER (PARTITION BY doctor_id, list ORDER BY time, id) AS integer) AS place, id FROM (SELECT *, CASE WHEN {_LIVE} THEN 'queue' ELSE 'waiting' END AS list FROM appts WHERE {_LIVE} OR status = 'accepted')",
    "dashboard_counts": f"{ctes('appts')} SELECT doctor_id, count(*) AS n, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (type = 'new') AS n_new, count(*) FILTER (status = 'accepted') AS n_awaiting, count(*) FILTER ({_LIVE}) AS n_live FROM appts GROUP BY 1",
    "drift_sum": f"{ctes('adjustments')} SELECT doctor_id, cast(sum(delta_minutes) AS bigint) AS drift_minutes FROM adjustments GROUP BY 1",
}

_REQUIRED = f"""req AS (SELECT admission_id, unnest(['identity', 'medical_doc'] || CASE WHEN payment_path = 'insurance' THEN ['insurance_policy', 'preauth_form'] || CASE WHEN estimated_cost >= {L.PAN_COST} THEN ['kyc_pan'] ELSE [] END || CASE WHEN is_corporate THEN ['employee_id'] ELSE [] END ELSE [] END) AS item_key FROM adm)"""
_NEWEST = "nd AS MATERIALIZED (SELECT * FROM adm_docs QUALIFY row_number() OVER (PARTITION BY admission_id, slot ORDER BY uploaded_at DESC, id) = 1)"
_FLATD, _FLATP = ([x for row in t for x in row] for t in (dihedral(), permutations()))


def _verhoeff(e: str, n: int = 12) -> str:
    c = "0"
    for i in range(n):
        c = f"({_FLATD})[{c} * 10 + ({_FLATP})[{(i % 8) * 10} + cast({e}[{n - i}] AS integer) + 1] + 1]"
    return c


def _national(e: str) -> str:
    d = rf"regexp_replace({e}, '\s', '', 'g')"
    return f"CASE WHEN length({d}) = 12 AND {d}[1] NOT IN ('0', '1') THEN {_verhoeff('(' + d + ')')} = 0 ELSE false END"


_NID, _TAX = match("text", L.NATIONAL_ID), match("text", L.TAX_ID)
_HOLDER = f"(length({{0}}) = 10 AND upper({{0}})[4] IN ({', '.join(map(q, L.TAX_HOLDERS))}))"
_REG = f"regexp_matches(coalesce(text, ''), {q('(?i)' + L.REGISTRATION)})"
_MISSING = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN nullif(trim({c}), '') IS NULL THEN {q(n)} END" for n, c in zip(L.PREAUTH_FIELDS, ["policy_number", "sum_insured", "est", "pre_diagnosis", "stay", "room"], strict=True)) + "], lambda x: x IS NOT NULL), ', ')"
_TIER1 = f"""{ctes('adm', 'adm_docs')}, {_REQUIRED}, {_NEWEST},
met AS (SELECT r.admission_id, r.item_key, d.id AS doc, doc_type, text, {_MISSING} AS lacking, CASE WHEN {_NID} IS NOT NULL THEN {_national(_NID)} END AS nid, CASE WHEN {_TAX} IS NOT NULL THEN {_HOLDER.format(_TAX)} END AS tax, regexp_matches(text, {q(L.VOTER_ID)}) OR regexp_matches(text, {q(L.PASSPORT)}) AS other, {_REG} AS reg, a.k
 FROM req r JOIN adm a USING (admission_id) LEFT JOIN nd d ON d.admission_id = r.admission_id AND d.slot = r.item_key),
out AS (SELECT *, CASE item_key
 WHEN 'identity' THEN CASE WHEN doc IS NULL THEN 'm0:No identity document uploaded yet' WHEN nid THEN 'v1:Identity document recognized (Aadhaar checksum valid)' WHEN NOT nid THEN 'm1:Aadhaar number format matched but failed the standard Verhoeff checksum validation — could be an OCR digit error or a fabricated number.'
   WHEN tax THEN 'v1:Identity document recognized (PAN format valid)' WHEN NOT tax THEN 'm1:PAN format matched but the entity-type character (4th letter) is not a valid PAN holder type — could be an OCR error or a fabricated number.' WHEN other THEN 'v1:Identity document recognized' ELSE 'm1:No recognized ID number format (Aadhaar/PAN/Voter ID/passport) found in the document.' END
 WHEN 'medical_doc' THEN CASE WHEN doc IS NULL THEN 'm0:No medical document uploaded yet' WHEN doc_type NOT IN ({_KINDS}) THEN 'm1:Medical document: uploaded document didn''t classify as expected — needs a closer look' WHEN reg THEN 'v1:Classified as ' || doc_type || ' — doctor registration number present' ELSE 'm1:Classified as ' || doc_type || ', but no doctor registration number was found anywhere in the document — Indian medical regulations require this on every prescription.' END
 WHEN 'insurance_policy' THEN CASE WHEN doc IS NULL THEN 'm0:No insurance policy uploaded yet' WHEN doc_type = 'insurance' THEN 'v1:Classified as insurance' ELSE 'm1:Insurance policy: uploaded document didn''t classify as expected — needs a closer look' END
 WHEN 'preauth_form' THEN CASE WHEN lacking <> '' THEN 'm0:Missing fields: ' || lacking ELSE 'v0:All pre-authorization fields completed' END
 WHEN 'kyc_pan' THEN CASE WHEN tax IS NOT NULL THEN 'v1:PAN number pattern found' ELSE 'm0:No PAN card detected — required since estimated cost is ₹1 lakh or more' END
 ELSE CASE WHEN doc IS NULL THEN 'm0:No employee ID uploaded yet' ELSE 'v1:Employee ID document uploaded' END END AS r FROM met),
t1 AS MATERIALIZED (SELECT admission_id, item_key, 1::integer AS tier, CASE r[1] WHEN 'v' THEN 'verified' ELSE 'missing' END AS status, CASE WHEN r[2] = '1' THEN doc END AS source_document_id, r[4:] AS explanation, r[1:2] = 'm1' AND item_key <> 'preauth_form' AS escalate FROM out)"""
_WSET = lambda e: f"list_distinct(regexp_extract_all(lower({e}), '[a-z0-9]+'))"
_SUB = lambda a, b: f"(len({a}) > 0 AND len(list_intersect({a}, {b})) = len({a}))"
_SCORE = " + ".join(f"cast(contains(lower(text), {q(w)}) AS bigint)" for w in L.INSURERS + L.POLICY_MARKERS)
_TOLD = f"list_filter({_WSET('admission_reason')}, lambda x: length(x) > 3)"
ORACLE |= {
    "adm_required_items": f"{ctes('adm')}, {_REQUIRED} SELECT * FROM req",
    "adm_slot_docs": f"{ctes('adm_docs')}, {_NEWEST} SELECT admission_id, slot, id, 'page one' || chr(10) || text AS text, diagnosis FROM nd",
    "adm_tier1": f"{_TIER1} SELECT * FROM t1",
    "adm_verdicts": f"""{_TIER1} SELECT admission_id, item_key, CASE WHEN escalate THEN 2 ELSE 1 END::integer AS tier, CASE WHEN NOT escalate THEN status WHEN right(admission_id, 1) < '7' AND length(admission_id) % 2 = 0 THEN 'verified' ELSE 'needs_review' END AS status, CASE WHEN NOT escalate THEN explanation WHEN right(admission_id, 1) < '7' THEN 'judged' ELSE {q(L.UNAVAILABLE)} END AS explanation FROM t1""",
    "adm_derived": f"""{_TIER1}, held AS (SELECT t1.admission_id, t1.item_key AS parent, a.*, d.id AS doc, d.doc_type, coalesce(d.text, '') AS text, d.diagnosis FROM t1 JOIN adm a USING (admission_id) LEFT JOIN nd d ON d.admission_id = t1.admission_id AND d.slot = t1.item_key WHERE t1.status = 'verified' AND item_key IN ('identity', 'insurance_policy', 'medical_doc')),
x AS (SELECT admission_id, doc, CASE parent WHEN 'identity' THEN 'identity_name_match' WHEN 'insurance_policy' THEN 'insurance_policy_match' ELSE 'diagnosis_match' END AS item_key, CASE parent
 WHEN 'identity' THEN CASE WHEN nullif(trim(patient_name), '') IS NULL THEN '2m1:Patient name not on record' WHEN {_SUB(_WSET('patient_name'), _WSET('text'))} THEN '1v1:Name on the document matches the patient''s registered name' ELSE '2m1' END
 WHEN 'insurance_policy' THEN CASE WHEN nullif(trim(policy_number), '') IS NULL THEN '1m1:Enter your policy number in the pre-authorization form so it can be cross-checked against the document' WHEN contains(lower(text), lower(policy_number)) AND {_SCORE} >= 1 THEN '1v1:Policy number on the document matches the form' ELSE '2m1' END
 ELSE CASE WHEN nullif(trim(admission_reason), '') IS NULL THEN '2m0:Need both a medical document and a stated admission reason to compare' WHEN {_SUB(_TOLD, _WSET("coalesce(nullif(diagnosis, ''), text[1:500])"))} THEN '1v1:Stated reason matches the document''s diagnosis text' ELSE '2m1' END END AS r FROM held)
SELECT admission_id, item_key, cast(r[1] AS integer) AS tier, CASE r[2] WHEN 'v' THEN 'verified' ELSE 'missing' END AS status, CASE WHEN r[3] = '1' THEN doc END AS source_document_id, nullif(r[5:], '') AS explanation, length(r) = 3 AS escalate FROM x""",
    "status_update": f"""{ctes('appts')}, r AS (SELECT id AS request_id, CASE WHEN id % 4 = 0 THEN -id ELSE id END AS rid, ['accepted', 'checked_in', 'in_consultation', 'completed', 'gone'][id % 5 + 1] AS s FROM appts WHERE id % 3 = 0),
o AS (SELECT request_id, rid, s, a.status AS old, CASE WHEN s NOT IN ('pending', 'accepted', 'declined', 'in_consultation', 'completed', 'no_show') THEN 'invalid' WHEN a.id IS NULL THEN 'not_found' ELSE 'ok' END AS outcome FROM r LEFT JOIN appts a ON a.id = rid)
SELECT request_id, rid AS id, outcome, CASE WHEN outcome = 'ok' THEN s ELSE old END AS status, CASE WHEN outcome = 'ok' AND s = 'in_consultation' THEN '2024-01-01T09:00:00' END AS started_at, CASE WHEN outcome = 'ok' AND s = 'completed' THEN '2024-01-01T09:00:00' END AS completed_at FROM o""",
    "patients_listed": f"""{ctes('appts', 'users', 'staff')}, t AS (SELECT DISTINCT a.patient_id, a.doctor_id, lower(hospital) AS h FROM appts a LEFT JOIN staff d ON d.id = a.doctor_id WHERE {_TAKEN})
SELECT DISTINCT 'doctor' AS caller, u.id, name FROM users u JOIN t ON patient_id = u.id WHERE doctor_id = 3 UNION ALL SELECT DISTINCT 'hospital', u.id, name FROM users u JOIN t ON patient_id = u.id WHERE h = 'france' UNION ALL SELECT 'all', id, name FROM users""",
    "adm_status": f"{ctes('adm', 'checklist')}, d AS (SELECT admission_id, bool_and(status = 'verified') AS a FROM checklist GROUP BY 1) SELECT admission_id, CASE WHEN status IN ('in_progress', 'ready_for_payment') THEN CASE WHEN coalesce(a, false) THEN 'ready_for_payment' ELSE 'in_progress' END ELSE status END AS status, coalesce(a, false) AS all_verified FROM adm LEFT JOIN d USING (admission_id)",
    "adm_payment_gate": f"{ctes('adm', 'checklist')}, d AS (SELECT admission_id, bool_and(status = 'verified') AS a FROM checklist GROUP BY 1) SELECT admission_id, CASE WHEN coalesce(a, false) THEN 'confirmed' ELSE 'refused' END AS outcome, CASE WHEN coalesce(a, false) THEN upper(md5(admission_id)[1:8]) END AS token FROM adm LEFT JOIN d USING (admission_id)",
    "adm_redeem": f"""{ctes('adm')}, r AS (SELECT k AS request_id, CASE WHEN k % 2 = 0 THEN ' ' || lower(coalesce(token, 'none')) || ' ' ELSE 'ABCDEFGH' END AS t FROM adm)
SELECT request_id, admission_id, CASE WHEN admission_id IS NULL THEN 'not_found' WHEN token_redeemed THEN 'already_redeemed' WHEN status <> 'confirmed' THEN 'not_ready' ELSE 'redeemed' END AS outcome FROM r LEFT JOIN adm ON upper(trim(t)) = token""",
    "adm_resolution_overlay": f"""{ctes('checklist', 'resolutions')}, l AS (SELECT * FROM resolutions WHERE status IN ('verified', 'missing') QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY resolutions.at DESC, status DESC) = 1)
SELECT c.item_id, coalesce(l.status, c.status) AS status, CASE WHEN l.item_id IS NULL THEN explanation ELSE coalesce(nullif(note, ''), CASE WHEN l.status = 'verified' THEN 'Verified by hospital admin' ELSE 'There seems to be a problem with this document — please re-upload it.' END) END AS explanation FROM checklist c LEFT JOIN l USING (item_id)""",
    "adm_get_or_create": f"{ctes('adm')} SELECT id AS appointment_id, cast(cast(time AS date) AS varchar) AS admission_date, 'in_progress' AS status FROM appts WHERE type = 'admission' AND id NOT IN (SELECT k FROM adm WHERE k % 2 = 0)",
    "admission_public": f"""{ctes('adm', 'checklist', 'staff', 'users')}, c AS (SELECT admission_id, string_agg(item_key || '=' || status, ',' ORDER BY item_key) AS checklist FROM checklist GROUP BY 1)
SELECT admission_id, coalesce(u.name, cast(patient_id AS varchar)) AS patient_name, coalesce(d.name, cast(doctor_id AS varchar)) AS doctor_name, hospital, c.checklist FROM adm LEFT JOIN c USING (admission_id) LEFT JOIN users u ON u.id = patient_id LEFT JOIN staff d ON d.id = doctor_id""",
    "worklist_needs_review": f"{ctes('adm', 'checklist', 'staff', 'users')} SELECT lower(hospital) AS hospital, item_id, item_key, admission_id, patient_id, coalesce(u.name, cast(patient_id AS varchar)) AS patient_name FROM checklist c JOIN adm a USING (admission_id) JOIN staff d ON d.id = doctor_id LEFT JOIN users u ON u.id = patient_id WHERE c.status = 'needs_review'",
    "admissions_by_hospital": f"{ctes('adm', 'staff')} SELECT lower(hospital) AS hospital, admission_id, status FROM adm JOIN staff d ON d.id = doctor_id WHERE status IN ('confirmed', 'redeemed')",
    "valid_aadhaar": f"{ctes('id_numbers')} SELECT id, {_national('number')} AS valid FROM id_numbers",
    "valid_pan": f"{ctes('id_numbers')} SELECT id, {_HOLDER.format('tax')} AS valid FROM id_numbers",
    "valid_insurance": f"{NOTES} SELECT note_id, {_SCORE} AS score FROM notes",
    "valid_regno": f"{NOTES} SELECT note_id, {_REG} AS registered FROM notes",
    "parse_verdict": f"{ctes('replies')} SELECT id, v AS verdict, CASE v WHEN 'uncertain' THEN 'needs_review' ELSE v END AS status, CASE id WHEN 0 THEN 'fits' WHEN 1 THEN 'gone' WHEN 4 THEN 'No explanation provided.' WHEN 5 THEN 'all there' WHEN 7 THEN 'No explanation provided.' ELSE {q(L.UNAVAILABLE)} END AS explanation FROM (SELECT id, CASE id WHEN 0 THEN 'verified' WHEN 1 THEN 'missing' ELSE 'uncertain' END AS v FROM replies)",
    "parse_verification": f"{ctes('replies')} SELECT id, id IN (5, 6) AS verified, CASE id WHEN 0 THEN 'fits' WHEN 1 THEN 'gone' WHEN 4 THEN 'No explanation provided.' WHEN 5 THEN 'all there' WHEN 7 THEN 'No explanation provided.' WHEN 8 THEN 'Verification response was unreadable.' ELSE raw END AS explanation, contains(upper(raw), 'SUPPORTED') AND NOT contains(upper(raw), 'NOT SUPPORTED') AS supported FROM replies",
}

_STEM = r"regexp_replace(string_split(path, '/')[-1], '(.)\.[^.]*$', '\1')"
_TEXT = f"({_STEM} || ' ' || coalesce(string_split(path, '/')[-2], ''))"
_BAND = "CASE " + " ".join(f"WHEN {{0}} >= {v} THEN {q(n)}" for v, n in L.BANDS) + " ELSE 'low' END"
_BENT = f"(abs(skew) >= {L.SKEW_MODERATE} OR (occupancy < {L.OCCUPANCY_MODERATE} AND abs(skew) >= {L.SKEW_TRIVIAL}) OR occupancy < {L.OCCUPANCY_LOW})"
_FINE = f"(sharpness >= {L.SHARP_MIN} AND noise <= {L.NOISE_HIGH})"
_DIG, _HW = L.DIGITAL, L.HANDWRITING
_TIER = f"""CASE WHEN sharpness >= {_DIG['sharpness']} AND contrast >= {_DIG['contrast']} AND noise <= {_DIG['noise']} AND abs(skew) < {L.SKEW_MODERATE} AND occupancy >= {_DIG['occupancy']} THEN 'HIGH_QUALITY' WHEN {_BENT} AND {_FINE} THEN 'TILTED_SCAN'
 WHEN NOT {_BENT} AND (contrast < {L.CONTRAST_LOW} OR NOT {_FINE}) THEN 'LOW_QUALITY' WHEN {_BENT} THEN 'MOBILE_CAPTURE' WHEN handwriting >= {_HW['score']} AND component >= {_HW['component']} AND stroke >= {_HW['stroke']} THEN 'HANDWRITTEN' ELSE 'CLEAN_SCAN' END"""
_ARMS = "CASE " + _BAND.format("confidence")[5:]
for _n, _a in L.ARMS.items():
    _ARMS = _ARMS.replace(f"THEN {q(_n)}", f"THEN {_a}").replace(f"ELSE {q(_n)}", f"ELSE {_a}")
_HAS = lambda step: f"list_contains(steps, '{step}')"
_PCT = lambda b, a: f"CASE WHEN {b} = 0 THEN CASE WHEN {a} > 0 THEN 100.0::double ELSE 0.0::double END ELSE round(({a}::double - {b}::double) / {b}::double * 100, 2) END"
_WON = f"""{ctes('arm_scores')}, base AS (SELECT page_id, confidence AS baseline_conf, chars AS baseline_chars FROM arm_scores WHERE arm = 'original'),
top AS (SELECT page_id, arm, confidence, chars FROM arm_scores WHERE arm <> 'original' AND confidence IS NOT NULL QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, ordinal) = 1),
won AS MATERIALIZED (SELECT base.*, {_BAND.format('baseline_conf')} AS conf_band, CASE WHEN confidence > baseline_conf THEN arm ELSE 'original' END AS winner_arm, CASE WHEN confidence > baseline_conf THEN confidence ELSE baseline_conf END AS winner_conf, CASE WHEN confidence > baseline_conf THEN chars ELSE baseline_chars END AS winner_chars FROM base LEFT JOIN top USING (page_id))"""
_EVAL = f"""{ctes('preset_runs')}, ev AS (SELECT page_id, preset_name, round(after_confidence - before_confidence, 4) AS confidence_delta, {_PCT('before_chars', 'after_chars')} AS char_improvement_pct, {_PCT('before_words', 'after_words')} AS word_improvement_pct, CASE WHEN before_chars > 0 THEN round(after_chars::double / before_chars::double, 4) ELSE 0.0::double END AS text_length_ratio FROM preset_runs),
sc AS MATERIALIZED (SELECT *, round(0.55::double * confidence_delta + 0.30::double * (char_improvement_pct / 100.0::double) + 0.15::double * (word_improvement_pct / 100.0::double), 6) AS composite_score FROM ev),
rk AS (SELECT *, cast(row_number() OVER (PARTITION BY page_id ORDER BY composite_score DESC, preset_name) AS integer) AS place FROM sc)"""
ORACLE |= {
    "img_modality": f"{ctes('paths')} SELECT id, CASE {' '.join(f'WHEN regexp_matches({_TEXT}, {q("(?i)" + p)}) THEN {q(m)}' for p, m in L.MODALITIES)} ELSE 'unknown_scan' END AS modality FROM paths",
    "img_abnormal": f"""{ctes('phrases', 'described')}, f AS (SELECT image_id, string_agg(phrase, ' | ' ORDER BY ordinal) FILTER (score >= {L.ABNORMAL_SCORE} AND ordinal > 1) AS flags, CASE WHEN max(score) FILTER (ordinal = 1) > max(score) FILTER (ordinal = 0) THEN 'normal chest radiograph' ELSE 'no acute cardiopulmonary abnormality' END AS top_normal FROM phrases GROUP BY 1)
SELECT image_id, flags IS NOT NULL OR regexp_matches(description, '\\bABNORMAL\\b') AS is_abnormal, coalesce(flags, '') AS abnormal_flags, top_normal FROM described JOIN f USING (image_id)""",
    "img_tier": f"{ctes('img_metrics')}, t AS (SELECT page_id, sharpness, {_TIER} AS tier FROM img_metrics) SELECT page_id, tier, CASE tier WHEN 'HIGH_QUALITY' THEN 'digital_pdf' WHEN 'TILTED_SCAN' THEN 'tilted_scan' WHEN 'LOW_QUALITY' THEN 'low_quality_scan' WHEN 'MOBILE_CAPTURE' THEN 'mobile_capture' WHEN 'HANDWRITTEN' THEN 'handwritten' ELSE 'clean_scan' END AS preset, round(greatest(0.0::double, 1 - sharpness / {L.BLUR_SPAN}), 4) AS blur_score FROM t",
    "img_band": f"{ctes('img_metrics')} SELECT page_id, {_BAND.format('confidence')} AS band FROM img_metrics",
    "img_arms": f"""{ctes('img_metrics')}, a AS (SELECT *, {_ARMS} AS a0 FROM img_metrics), b AS (SELECT *, CASE WHEN abs(skew) >= {L.DESKEW_AT} AND NOT list_contains(a0, 'deskew_only') THEN a0 || ['deskew_only'] ELSE a0 END AS a1 FROM a)
SELECT page_id, CASE WHEN confidence >= 0.9 THEN '' ELSE array_to_string(CASE WHEN occupancy < {L.CROP_BELOW} THEN a1 || ['crop_only'] ELSE a1 END, ',') END AS arms FROM b""",
    "img_plan": f"""{ctes('img_metrics')}, m AS (SELECT *, ({list(L.PRESETS)})[page_id % {len(L.PRESETS)} + 1] AS preset, ({[list(steps) for steps in L.PRESETS.values()]})[page_id % {len(L.PRESETS)} + 1] AS steps FROM img_metrics)
SELECT page_id, preset, concat_ws(',', CASE WHEN {_HAS('perspective')} AND (abs(skew) >= {L.SKEW_MODERATE} OR boxed) THEN 'perspective' END, CASE WHEN {_HAS('deskew')} AND abs(skew) >= {L.SKEW_TRIVIAL} THEN 'deskew' END, CASE WHEN {_HAS('denoise')} AND noise >= {L.DENOISE_MIN} THEN 'denoise' END, CASE WHEN {_HAS('handwriting')} THEN 'handwriting' END, CASE WHEN {_HAS('clahe')} AND contrast < {L.CLAHE_MAX} THEN 'clahe' END,
 CASE WHEN {_HAS('blur_recovery')} AND sharpness < {L.BLUR_MAX} THEN 'blur_recovery' END, CASE WHEN {_HAS('sharpen')} AND NOT {_HAS('blur_recovery')} THEN 'sharpen' END, CASE WHEN {_HAS('threshold')} AND NOT {_HAS('handwriting')} AND contrast < {L.THRESHOLD_MAX} THEN 'threshold' END, CASE WHEN {_HAS('border')} THEN 'border' END) AS steps FROM m""",
    "img_winner": f"{_WON} SELECT * FROM won",
    "eval_arms": f"{_WON} SELECT page_id, arm, round(confidence - baseline_conf, 4) AS conf_delta, {_PCT('baseline_chars', 'chars')} AS char_delta_pct, arm = winner_arm AS is_winner FROM arm_scores JOIN won USING (page_id) WHERE confidence IS NOT NULL",
    "eval_improved": f"{_WON} SELECT page_id, round(winner_conf - baseline_conf, 4) AS conf_improvement, round(winner_conf - baseline_conf, 4) > 0 AS is_improved FROM won",
    "eval_composite": f"{_EVAL} SELECT * FROM sc",
    "eval_rank": f"{_EVAL} SELECT page_id, preset_name, place FROM rk",
    "eval_best": f"{_EVAL} SELECT page_id, preset_name, composite_score, composite_score < 0 AS negative FROM rk WHERE place = 1",
}

ORACLE |= {
    "adm_model_verdicts": f"SELECT admission_id, item_key, tier, CASE WHEN escalate THEN 'needs_review' ELSE status END AS status, CASE WHEN escalate THEN 'No model is at hand.' ELSE explanation END AS explanation FROM ({ORACLE['adm_derived']})",
    "answer_verification": f"{_ASKED} SELECT question_id, false AS verified, CASE WHEN length(question) % 3 > 0 AND length(question) % 2 = 0 THEN 'No model is at hand.' ELSE 'Verification skipped — answer or context is empty.' END AS explanation FROM asked",
    "scan_describe": f"SELECT cast(id AS bigint) AS image_id, modality, 'seen ' || cast(length(path) AS varchar) || ' bytes' AS description FROM ({ORACLE['img_modality']}) JOIN ({ctes('paths')} SELECT id, path FROM paths) USING (id)",
    "scan_prompts": f"SELECT id, CASE modality {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in L.SCAN_PROMPTS.items())} ELSE {q(L.DEFAULT_SCAN_PROMPT)} END || {q(L.SCAN_RULE)} AS prompt FROM ({ORACLE['img_modality']})",
    "xray_phrases": f"""{ctes('described')}, p AS (SELECT unnest([0, 1, 2])::integer AS ordinal, unnest(['no acute cardiopulmonary abnormality', 'normal chest radiograph', 'pneumonia with consolidation']) AS phrase)
SELECT image_id, ordinal, phrase, round(('0x' || md5('a/chest-xray-' || cast(image_id AS varchar) || '.png|' || phrase)[1:4])::integer / 65535.0::double, 4) AS score FROM described, p WHERE image_id % 2 = 0""",
    "stream_notify": "SELECT DISTINCT user_id AS id FROM events WHERE event_id % 4 <= 1",
    "stream_ingest": f"SELECT doc_type, semantic_type, count(*) AS n FROM ({ORACLE['chunk_dispatch']}) JOIN ({FIELDED} SELECT note_id, doc_type FROM nf) USING (note_id) GROUP BY ALL",
    "img_parameters": f"""{ctes('img_metrics')}, m AS (SELECT ({list(L.PRESETS)})[page_id % {len(L.PRESETS)} + 1] AS preset FROM img_metrics),
v(preset, step, name, value) AS (VALUES {', '.join(f"({q(p)}, {q(t)}, {q(n) if n else 'NULL'}, {v if n else 'NULL'}::double)" for p, steps in L.PRESETS.items() for t, values in steps.items() for n, v in (values or {None: None}).items())})
SELECT preset, step, name, value, count(*) AS n FROM m JOIN v USING (preset) GROUP BY ALL""",
    "shown_texts": f"""{_ASKED} SELECT question_id, {_ESCAPED.format("'<b>' || chr(39) || question || chr(39) || '</b> & ' || chr(34)")} AS shown, {_ESCAPED.format("cast(to_json('say ' || chr(34) || question || chr(92)) AS varchar)")} AS attribute FROM asked""",
    "name_initials": f"{ctes('staff')} SELECT id, 'D' || string_split(name, ' ')[2][1] AS initials, dept[1] AS dept FROM staff",
    "countdown": f"""{ctes('appts')}, x AS (SELECT id, cast(floor((id * 37 % 9000 - 100) / 2 + 0.5) AS bigint) AS n FROM appts)
SELECT id, CASE WHEN n <= 0 THEN 'Any moment now' WHEN n >= 3600 THEN printf('%d:%02d:%02d', n // 3600, n % 3600 // 60, n % 60) ELSE printf('%d:%02d', n // 60, n % 60) END AS "left" FROM x""",
    "password_check": 'SELECT n_nationkey AS id, 64 AS length, n_nationkey % 3 <> 0 AS "right" FROM nation',
}
