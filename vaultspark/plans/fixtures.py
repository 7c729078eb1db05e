"""Views that give every operator an input, derived from the given tables.

One SQL text serves both engines: names in braces are tables or other views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from vaultspark.session import kept, spread

#: Tables that text operators read.
SPREAD = ["documents", "orders"]
#: Views that are written once a session, as the tables that they stand for would be.
STORED = ["notes"]
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _pick(key: str, values: list[str]) -> str:
    return f"case {key} % {len(values)} " + " ".join(f"when {k} then '{v}'" for k, v in enumerate(values)) + " end"


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


_K = "o_orderkey"
_DRUG = _pick(_K, ["Metformin 500 mg", "Atorvastatin 20 mg", "Aspirin", "Amlodipine 5 mg", "Pantoprazole", "Warfarin 2 mg", "Insulin"])
_OTHER = _pick(_K, ["Omeprazole", "Ramipril 5 mg", "Digoxin", "Paracetamol 650 mg"])
_DOCTOR = _pick(_K, ["Anil Kumar", "Ravi Menon", "Sara Maria Jones", "Meera Nair", "John Smith"])
_PLACE = _pick(_K, ["City General Hospital", "Lake View Clinic", "North Heart Institute", "Green Medical Centre"])
_ILLNESS = _pick(_K, ["type two diabetes mellitus", "acute coronary syndrome", "chronic kidney disease.", "essential hypertension", "community acquired pneumonia;", "iron deficiency anaemia"])
_ALLERGEN = _pick(_K, ["penicillin", "sulfa drugs, latex", "ibuprofen", "peanuts", "shellfish"])
_PROCEDURE = _pick(_K, ["Laparoscopic appendectomy", "Coronary angioplasty", "Total knee replacement", "Cataract removal"])
_DATE = f"lpad(cast({_K} % 28 + 1 as varchar(2)), 2, '0') || '/' || lpad(cast({_K} % 12 + 1 as varchar(2)), 2, '0') || '/' || " + f"case when {_K} % 11 = 0 then '98' else cast(2005 + {_K} % 17 as varchar(4)) end"
_NUMBER = f"lpad(cast(({_K} * 104729 + 234100000000) % 1000000000000 as varchar(12)), 12, '0')"
_SPACED = f"substr({_NUMBER}, 1, 4) || ' ' || substr({_NUMBER}, 5, 4) || ' ' || substr({_NUMBER}, 9, 4)"

_NOTES = {
    0: _text(f"'At ' || {_PLACE}", f"'Dr. ' || {_DOCTOR}", f"'Date ' || {_DATE}", "'Rx'", f"'Tab. ' || {_DRUG} || ' once daily'", f"'Cap ' || {_OTHER} || ' twice daily'", "'inj TT'", f"'Diagnosis: ' || {_ILLNESS}", f"'Reg. No: KMC' || cast({_K} as varchar(12))"),
    1: _text("'DISCHARGE SUMMARY'", f"'Date of admission: ' || {_DATE}", "'History:'", "'Patient was admitted with fever and pain'", "'DIAGNOSIS'", f"'Confirmed as ' || {_ILLNESS}", "'Discharge medications'", f"'Tab ' || {_DRUG} || ' and tab ' || {_OTHER}", "'Follow-up:'", "'Review after two weeks in the clinic'", "'Plan'", "'Rest.'"),
    2: _text(f"'Seen on ' || {_DATE}", "'Laboratory results for the patient below'", "'CBC:'", f"'Haemoglobin: ' || cast({_K} % 9 + 6 as varchar(3)) || '.5 g/dL'", f"'Platelet count - ' || cast({_K} % 300 + 100 as varchar(4)) || ' lakh'", "'Renal function'", f"'Creatinine: 1.' || cast({_K} % 10 as varchar(2)) || ' mg/dL'", "'Urea : 30 mg/dL'", f"'Haemoglobin: ' || cast({_K} % 7 + 7 as varchar(3)) || ' g/dL'"),
    3: _text(f"'CT scan of the chest, radiologist Dr ' || {_DOCTOR}", f"'Findings: nodule of ' || cast({_K} % 9 + 1 as varchar(2)) || ' mm in the right lobe'", "'no effusion'", f"'Impression: ' || {_ILLNESS}", "'advise repeat'"),
    4: _text("'Histopathology of a biopsy specimen'", "'Gross examination: grey tissue, section shows glands'", f"'Diagnosis: ' || {_ILLNESS}", "'no malignant cells'"),
    5: _text("'Operation notes'", f"'Surgeon: Dr ' || {_DOCTOR}", f"'Procedure: ' || {_PROCEDURE}", "'Anaesthesia: general'", f"'Inj ' || {_OTHER}", f"'On 3 March ' || cast(2000 + {_K} % 20 as varchar(4))"),
    6: _text("'Cashless insurance claim'", f"'Policy number: POL' || cast({_K} as varchar(12))", f"{_pick(_K, ['Sum insured: 500000 with Star Health', 'TPA desk', 'nothing more'])}"),
    7: _text("'Government of India'", "'Unique Identification Authority'", f"'Name ' || {_DOCTOR}", _SPACED),
    8: _text(f"'Follow up visit ' || {_DATE} || ' at ' || {_PLACE}", f"{_pick(_K, ['Known case, feels well', 'No known drug allergies'])} || '.'", f"'Patient is allergic to ' || {_ALLERGEN} || '. Intolerant to ' || {_OTHER} || '.'"),
}

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_SLOTS = " union all ".join(f"select '{s}' as slot, {k} as s" for k, s in enumerate(["identity", "medical_doc", "insurance_policy", "kyc_pan", "employee_id"]))
_PAN = f"substr({_LETTERS}, cast(k % 26 + 1 as int), 1) || 'BC' || substr('PQFX', cast(k % 4 + 1 as int), 1) || 'E1234Z'"

VIEWS = {
    "chunks": """
select md5(source || '::' || cast(doc_id as varchar(20))) as chunk_id, source as patient_id, 'doc_' || cast(doc_id as varchar(20)) as file_name, doc_id,
  case doc_id % 9 when 0 then 'prescription' when 1 then 'discharge_summary' when 2 then 'lab_report' when 3 then 'biopsy_report' when 4 then 'imaging_report' when 5 then 'operative_notes' when 6 then 'insurance' when 7 then 'identity_proof' else 'unknown' end as doc_type,
  case doc_id % 6 when 0 then 'diagnosis' when 1 then 'medication_history' when 2 then 'lab_reports' when 3 then 'surgical_history' when 4 then 'follow_up_notes' else 'patient_information' end as semantic_type,
  case when doc_id % 3 = 0 then cast(2000 + doc_id % 20 as varchar(4)) end as visit_date, 0 as chunk_index, text, embedding
from {documents} join {embeddings} on doc_id = vec_id""",
    "questions": """
select s.source as question_id, s.source as patient_id, 'This and that from the onthe of by der que les' as question, e.embedding as query_vector
from (select distinct source from {documents}) s cross join (select embedding from {embeddings} where vec_id = 0) e""",
    "notes": f"""
select {_K} as note_id, o_custkey as patient_id, 'note_' || cast({_K} % 700 as varchar(6)) as file_name, 'vault/' || cast(o_custkey as varchar(12)) || '/note_' || cast({_K} % 700 as varchar(6)) as file_path,
  {_K} as chunk_index, 'n' || lpad(cast({_K} as varchar(12)), 12, '0') as chunk_id,
  case {_K} % 9 {" ".join(f"when {k} then {t}" for k, t in _NOTES.items())} end as text
from {{orders}}""",
    "appts": """
select o_orderkey as id, o_custkey as patient_id, o_orderkey % (select count(*) from {supplier}) as doctor_id,
  case o_orderstatus when 'F' then 'follow_up' when 'O' then 'new' else case when o_orderkey % 5 = 0 then 'walk_in' else 'admission' end end as type,
  case o_orderkey % 7 when 0 then 'pending' when 1 then 'accepted' when 2 then 'declined' when 3 then 'checked_in' when 4 then 'in_consultation' when 5 then 'completed' else 'checked_in' end as status,
  o_orderdate + interval '1' minute * (o_orderkey % 480) as time,
  case when o_orderkey % 3 = 0 then lpad(cast(o_orderkey % 24 as varchar(2)), 2, '0') || ':15' end as checked_in_at
from {orders}""",
    "staff": """
select s_suppkey as id, 'Dr ' || s_name as name, case s_suppkey % 3 when 0 then 'Cardiology' when 1 then 'Surgery' else 'Medicine' end as dept,
  case when s_suppkey % 2 = 0 then upper(n_name) else lower(n_name) end as hospital, cast((s_suppkey % 7) * 5 - 15 as int) as drift
from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "users": "select c_custkey as id, c_name as name from {customer} where c_custkey % 10 <> 0",
    "requests": """
select id as request_id, case id % 6 when 0 then 'patient' when 1 then 'doctor' when 2 then 'tpa' when 3 then 'lab' when 4 then 'admin' else 'visitor' end as role,
  case when id % 6 = 0 then patient_id + id % 2 when id % 6 = 1 then doctor_id + (id % 4) % 2 else -1 end as requester_id,
  case when id % 5 = 0 then null when id % 2 = 0 then 'France' else 'CHINA' end as requester_hospital, patient_id
from {appts}""",
    "adm": f"""
select 'A' || cast(id as varchar(12)) as admission_id, id as k, id as appointment_id, patient_id, doctor_id, cast(time as date) as admission_date,
  case id % 4 when 0 then 'Meera Nair' when 1 then 'Someone Else' when 2 then 'ravi MENON' end as patient_name,
  case id % 5 when 0 then null when 1 then 'kidney disease' else {_ILLNESS.replace(_K, "id")} end as admission_reason,
  case when id % 3 = 0 then 'self_pay' else 'insurance' end as payment_path, id % 2 = 0 as is_corporate, cast((id % 4) * 45000 as int) as estimated_cost,
  case when id % 7 = 0 then '' else 'pol' || cast(id as varchar(12)) end as policy_number, '500000' as sum_insured, case when id % 11 = 0 then null else '90000' end as est, 'fever' as pre_diagnosis, '3' as stay, case when id % 13 = 0 then '' else 'single' end as room,
  case id % 4 when 0 then 'in_progress' when 1 then 'ready_for_payment' when 2 then 'confirmed' else 'redeemed' end as status,
  case when id % 4 >= 2 then upper(substr(md5(cast(id as varchar(12))), 1, 8)) end as token, id % 4 = 3 as token_redeemed
from {{appts}} where type in ('admission', 'walk_in', 'new')""",
    "adm_docs": f"""
select 'D' || cast(k as varchar(12)) || '-' || cast(s as varchar(2)) || '-' || cast(v as varchar(2)) as id, admission_id, patient_id, slot, 'f' || cast(k as varchar(12)) || '_' || cast(s as varchar(2)) || '_' || cast(v as varchar(2)) as file_name,
  '2024-01-0' || cast(v + 1 as varchar(2)) as uploaded_at,
  case s when 0 then 'identity_proof' when 1 then case (k + v) % 4 when 0 then 'prescription' when 1 then 'discharge_summary' when 2 then 'lab_report' else 'operative_notes' end when 2 then case when k % 3 = 1 then 'insurance' else 'unknown' end else 'unknown' end as doc_type,
  case s when 0 then case (k + v) % 6 when 0 then 'Meera Nair 2341 2341 2346' when 1 then 'Nair Meera ' || {_SPACED.replace(_K, "k")} when 2 then 'Ravi Menon ' || {_PAN} when 3 then 'voter ABC1234567 ravi menon' when 4 then 'nothing here' else 'passport K1234567' end
    when 1 then 'Patient has ' || {_ILLNESS.replace(_K, "k")} || case when k % 2 = 0 then ' Reg No: MH-' || cast(k as varchar(12)) else '' end
    when 2 then 'Policy POL' || cast(k as varchar(12)) || case when k % 2 = 0 then ' sum insured 5 lakh by Tata AIG' else '' end
    when 3 then 'Card ' || case when k % 2 = 0 then {_PAN} else 'none' end else 'Employee card' end as text,
  case when s = 1 and k % 3 = 0 then 'chronic kidney disease' end as diagnosis
from {{adm}} cross join ({_SLOTS}) slots cross join (select 0 as v union all select 1 as v) versions where (k + 2 * s + 3 * v) % 5 > 1""",
    "checklist": """
select admission_id || ':' || item as item_id, admission_id, item as item_key, 1 as tier, case (k + n) % 5 when 0 then 'missing' when 1 then 'needs_review' else case when k % 3 = 0 or n = 0 then 'verified' else case when (k + n) % 2 = 0 then 'verified' else 'needs_review' end end end as status, 'D' || cast(k as varchar(12)) as source_document_id, 'why ' || cast(n as varchar(2)) as explanation
from {adm} cross join (select 'identity' as item, 0 as n union all select 'medical_doc', 1) items where k % 9 <> 8""",
    "resolutions": """
select item_id, case length(item_id) % 3 when 0 then 'verified' when 1 then 'missing' else 'open' end as status, case when v = 0 then '' else 'seen' end as note, '2024-02-0' || cast(v + 1 as varchar(2)) as at
from {checklist} cross join (select 0 as v union all select 1 as v) versions where status = 'needs_review' and (v = 0 or tier = 1 and length(item_id) % 2 = 0)""",
    "id_numbers": f"select {_K} as id, case {_K} % 5 when 0 then {_SPACED} when 1 then {_NUMBER} when 2 then substr({_NUMBER}, 1, 11) when 3 then '1' || substr({_NUMBER}, 2, 11) else substr({_NUMBER}, 2, 1) || substr({_NUMBER}, 1, 1) || substr({_NUMBER}, 3, 10) end as number, {_PAN.replace('k %', _K + ' %')} as tax from {{orders}}",
    "arm_scores": """
select page_id, arm, ordinal, case when (page_id + ordinal) % 17 = 0 and ordinal > 0 then cast(null as double) else cast((page_id * 7919 + ordinal * 6007) % 1000 as double) / 1000 end as confidence, cast((page_id * 31 + ordinal * 17) % 500 as int) as chars
from (select o_orderkey as page_id from {orders}) p cross join (select 'original' as arm, 0 as ordinal union all select 'grayscale_only', 1 union all select 'clahe_only', 2 union all select 'deskew_only', 3) a""",
    "img_metrics": """
select o_orderkey as page_id, cast((o_orderkey * 7919) % 700 as double) as sharpness, cast((o_orderkey * 31) % 250 as double) / 1000 as noise, cast((o_orderkey * 17) % 500 as double) / 1000 as contrast, cast((o_orderkey * 13) % 120 as double) / 10 - 6 as skew,
  cast((o_orderkey * 101) % 1000 as double) / 1000 as occupancy, cast((o_orderkey * 7) % 1000 as double) / 1000 as handwriting, cast((o_orderkey * 11) % 900 as double) / 1000 as component, cast((o_orderkey * 19) % 900 as double) / 1000 as stroke,
  o_orderkey % 3 = 0 as boxed, cast((o_orderkey * 37) % 1000 as double) / 1000 as confidence
from {orders}""",
    "preset_runs": """
select page_id, preset_name, cast((page_id * 13) % 1000 as double) / 1000 as before_confidence, cast((page_id * 29 + n * 71) % 1000 as double) / 1000 as after_confidence, page_id % 400 as before_chars, (page_id * 3 + n * 11) % 450 as after_chars, page_id % 80 as before_words, (page_id + n * 7) % 90 as after_words
from (select o_orderkey as page_id from {orders}) p cross join (select 'clean_scan' as preset_name, 0 as n union all select 'clahe_only', 1 union all select 'mobile_capture', 2 union all select 'deskew_only', 3) q""",
    "phrases": """
select image_id, ordinal, phrase, cast((image_id * 7919 + ordinal * 104729) % 300 as double) / 1000 as score
from (select o_orderkey as image_id from {orders}) i cross join (select 0 as ordinal, 'no acute cardiopulmonary abnormality' as phrase union all select 1, 'normal chest radiograph' union all select 2, 'pneumothorax' union all select 3, 'cardiomegaly' union all select 4, 'emphysema') p""",
    "described": "select o_orderkey as image_id, case o_orderkey % 4 when 0 then 'Clearly ABNORMAL study' when 1 then 'abnormal in part' when 2 then 'PREABNORMAL' else 'normal' end as description from {orders}",
    "paths": """
select id, path from (select 0 as id, 'a/chest-xray.png' as path union all select 1, 'scans/chest_xray.png' union all select 2, 'CT/brain.jpg' union all select 3, 'x/knee MRI flair.png' union all select 4, 'sono/abc.bmp' union all select 5, 'p/whole-body PET.tiff'
  union all select 6, 'p/mammogram.JPEG' union all select 7, 'p/bone-density.png' union all select 8, 'p/x ray hand.png' union all select 9, 'p/report.pdf' union all select 10, 'scan.png' union all select 11, 'p/computed_tomography.v2.png') t""",
    "asked": """
select cast(conv_id as varchar(20)) || '-' || cast(turn as varchar(6)) as question_id, text as question from {conversations} where role = 'user'
union all select 'L' || cast(n as varchar(2)), q from (select 1 as n, 'Any allergic reaction before surgery?' as q union all select 2, 'list the MEDICATION doses' union all select 3, 'when was the last operation' union all select 4, 'patient timeline over time' union all select 5, 'admit me to the ward'
  union all select 6, 'bp and htn with ckd' union all select 7, 'd1agn0sis of diab3tes  melitus' union all select 8, 'HbA1c and TSH, USG  on od' union all select 9, 'what is up' union all select 10, 'rnedication for 1 a5thma a@b user@mail' union all select 11, 'paracetmol, and metfromin' union all select 12, 'existent crash of outpatient') l""",
    "replies": """
select id, raw from (select 0 as id, '{{"verdict": "verified", "explanation": "fits"}}' as raw union all select 1, '```json' || chr(10) || '{{"verdict": "MISSING", "explanation": "gone"}}' || chr(10) || '```' union all select 2, 'not json' union all select 3, '[ERROR] down' union all select 4, '{{"verdict": "perhaps"}}'
  union all select 5, '{{"verified": true, "explanation": "all there"}}' union all select 6, 'I think it is TRUE' union all select 7, '```{{"verified": false}}```' union all select 8, '' union all select 9, 'SUPPORTED' union all select 10, 'not supported') t""",
    "candidates": """
select id, suffix, plain_text, layer_text, ocr_text, ocr_confidence, vision_text from (
  select 0 as id, '.txt' as suffix, '﻿plain words' as plain_text, cast(null as varchar(9)) as layer_text, cast(null as varchar(9)) as ocr_text, cast(null as double) as ocr_confidence, cast(null as varchar(9)) as vision_text
  union all select 1, '.pdf', null, 'Discharge summary of a patient with a long hospital course here', 'x', 0.1, 'y'
  union all select 2, '.pdf', null, 'words that belong to no class at all but are long enough to count', 'short text of thirty characters and', 0.9, null
  union all select 3, '.pdf', null, 'words that belong to no class at all but are long enough to count', 'tablet of thirty characters and more of them', 0.9, null
  union all select 4, '.png', null, null, 'tiny', 0.99, 'a vision reply that is certainly longer than fifty characters'
  union all select 5, '.png', null, null, 'tiny', 0.99, 'short'
  union all select 6, '.png', null, null, 'a b c d e f g h i j k l m n o p q r s', 0.95, 'vision text that is the longer one of these two'
  union all select 7, '.png', null, null, 'confident words without any doubt in them', 0.85, 'unused'
  union all select 8, '.png', null, null, 'doubtful words without much confidence in them', 0.5, 'too short') t""",
    "words": "select l_orderkey as page_id, l_linenumber * 1000 + l_partkey % 1000 as at, 'w' || cast(l_partkey as varchar(12)) as word, cast((l_partkey * 3571) % 9973 as double) / 9973 as confidence from {lineitem}",
    "adjustments": "select event_id % 50 as doctor_id, cast(event_id % 5 * 5 - 10 as int) as delta_minutes from {events}",
}


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a view over them."""
    if name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(table) if name in SPREAD else table
    if name in STORED:
        return kept(spark, f"{name} of {sf_dir}", lambda: _made(spark, sf_dir, name))
    return _made(spark, sf_dir, name)


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in _names(sql)}) if _names(sql) else spark.sql(sql.replace("{{", "{").replace("}}", "}"))


def ctes(*names: str) -> str:
    """The views as DuckDB common table expressions, in the order that they need."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in TABLES or n in order:
            return
        for m in _names(VIEWS[n]):
            add(m)
        order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n].format(**{m: m for m in _names(VIEWS[n])})})" for n in order)
