"""The queries: each applies an operator to a table or a fixture view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultspark import models
from vaultspark.functions import numbers, strings, validators
from vaultspark.operators import evaluation, imaging, questions, retrieval, text, vault, verdicts, workflow
from vaultspark.plans.fixtures import view
from vaultspark.session import kept, scratch, stored
from vaultspark.sources import files, sinks
from vaultspark.streaming import ingest

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def fielded(s: SparkSession, d: str) -> DataFrame:
    """Notes with their class and fields."""
    return text.extract_fields(text.classify(view(s, d, "notes")))


def vaulted(s: SparkSession, d: str) -> DataFrame:
    """The same as the vault holds them: classified and extracted at ingestion, once."""
    return kept(s, f"vault of {d}", lambda: fielded(s, d))


def hits(s: SparkSession, d: str) -> DataFrame:
    """Hybrid hits with their documents' fields and rerank scores."""
    chunks, asked = view(s, d, "chunks"), view(s, d, "questions")
    found = retrieval.rerank(retrieval.hybrid(chunks, asked), asked)
    return stored(found.join(chunks.select("chunk_id", "file_name", "doc_type", "semantic_type", "visit_date"), "chunk_id"))


def registered(s: SparkSession, d: str) -> DataFrame:
    """Notes as the register of documents has them."""
    kinds = F.array(*(F.lit(k) for k in ("prescription", "imaging_scan", "admission_intake", "lab_report", "unknown")))
    k = F.col("note_id")
    return view(s, d, "notes").select("patient_id", k.alias("id"), "file_name", F.get(kinds, (k % 5).cast("int")).alias("doc_type"), F.when(k % 2 == 0, "patient").otherwise("doctor").alias("uploaded_by"), F.when(k % 7 != 0, F.concat(F.lit("2024-03-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00"))).alias("uploaded_at"))


# -- text ----------------------------------------------------------------------------


@query
def tokenize_counts(s, d):
    return text.token_counts(view(s, d, "documents")).select("doc_id", "n_tokens", "n_distinct", "n_words")


@query
def garbage_text(s, d):
    return view(s, d, "documents").select("doc_id", strings.is_garbage(F.col("text")).alias("is_garbage"))


@query
def doc_classify(s, d):
    return text.classify(view(s, d, "notes")).select("note_id", "doc_type")


@query
def doc_classify_corpus(s, d):
    return text.classify(view(s, d, "documents")).select("doc_id", "doc_type")


@query
def doc_semantic_default(s, d):
    return text.classify(view(s, d, "notes")).withColumn("semantic_type", text.semantic_of(F.col("doc_type"))).groupBy("doc_type", "semantic_type").agg(F.count(F.lit(1)).alias("n"))


@query
def field_date(s, d):
    return view(s, d, "notes").select("note_id", text.visit_date(F.col("text")).alias("visit_date"))


@query
def field_doctor(s, d):
    return view(s, d, "notes").select("note_id", text.doctor(F.col("text")).alias("doctor_name"))


@query
def field_hospital(s, d):
    return view(s, d, "notes").select("note_id", text.hospital(F.col("text")).alias("hospital"))


@query
def field_surgery(s, d):
    return view(s, d, "notes").select("note_id", text.surgery(F.col("text")).alias("surgery_type"))


@query
def field_diagnoses(s, d):
    return view(s, d, "notes").select("note_id", F.array_join(text.diagnoses(F.col("text")), "|").alias("diagnosis"))


@query
def field_drugs(s, d):
    return fielded(s, d).select("note_id", F.array_join("drugs", "|").alias("drugs"))


@query
def field_lab_values(s, d):
    named = fielded(s, d).select("note_id", F.explode_outer("lab_values").alias("name", "value"))  # the inner form computes the map twice
    return named.filter("name is not null")


@query
def lab_json_roundtrip(s, d):
    back = F.from_json(F.to_json("lab_values"), "map<string,string>")
    return fielded(s, d).withColumn("b", back).select("note_id", F.element_at("b", "haemoglobin").alias("haemoglobin"), F.size("b").cast("long").alias("n_values")).filter("n_values > 0")


@query
def section_split(s, d):
    from vaultspark import lexicons

    each = text.classify(view(s, d, "notes")).filter("doc_type = 'discharge_summary'").select("note_id", "doc_type", text.sections(F.col("text"), lexicons.SECTION_HEADER).alias("parts"))
    each = strings.exploded(each, "parts", "pos", "x")
    return each.select("note_id", "pos", F.col("x.header").alias("header"), F.col("x.text").alias("section"), text.semantic_of_header(F.col("x.header"), F.col("doc_type")).alias("semantic_type"))


@query
def chunk_dispatch(s, d):
    return text.explode_chunks(text.classify(view(s, d, "notes").drop("chunk_index", "chunk_id"))).select("note_id", "chunk_index", "total_chunks", "semantic_type", "text")


@query
def chunk_ids(s, d):
    return view(s, d, "notes").select("note_id", text.chunk_id(F.col("patient_id").cast("string"), F.col("file_path"), F.lit(0)).alias("chunk_id"), text.chunk_id(F.col("patient_id").cast("string"), F.col("file_path"), F.lit(0), "scan").alias("scan_id"))


@query
def sentence_pack(s, d):
    packed = view(s, d, "documents").select("doc_id", text.pack_sentences(F.col("text")).alias("chunks"))
    return strings.exploded(packed, "chunks", "at", "chunk").select("doc_id", "at", F.length("chunk").alias("n_chars"))


@query
def llm_section_parse(s, d):
    reply = F.concat(F.lit("SECTION: diagnosis\nTEXT: seen "), F.col("file_name"), F.lit("\nmore lines\nSECTION: medication_history\nTEXT: none\nSECTION: lab_reports"))
    parsed = text.parse_sections(F.when(F.col("note_id") % 3 != 0, reply), F.col("text"))
    return strings.exploded(view(s, d, "notes").select("note_id", parsed.alias("parts")), "parts", "pos", "x").select("note_id", "pos", F.col("x.semantic_type").alias("semantic_type"), F.col("x.text").alias("text"))


@query
def extract_choose(s, d):
    return text.choose_extraction(view(s, d, "candidates")).select("id", "extraction_method", "text")


@query
def ocr_word_confidence(s, d):
    return evaluation.mean_confidence(view(s, d, "words")).select("page_id", "confidence")


@query
def upsert_latest(s, d):
    notes = view(s, d, "notes").select(F.concat_ws("/", F.col("patient_id").cast("string"), "file_name").alias("key"), "note_id")
    old, new = notes.filter("note_id % 2 = 0").groupBy("key").agg(F.min("note_id").alias("note_id")), notes.filter("note_id % 2 = 1")
    return sinks.upsert(old, new, "key", [F.col("note_id")])


@query
def replace_file(s, d):
    notes = view(s, d, "notes").select("patient_id", "file_path", "note_id")
    return sinks.replace_file(notes.filter("note_id % 2 = 0"), notes.filter("note_id % 2 = 1"))


@query
def update_rows(s, d):
    rows = view(s, d, "appts").select("id", "status", "type")
    changes = rows.filter("id % 5 = 0").select("id", F.when(F.col("id") % 10 == 0, "completed").alias("status"))
    return sinks.update(rows, changes, "id")


@query
def page_join(s, d):
    words = view(s, d, "words").select(F.concat(F.lit("f"), (F.col("page_id") % 500).cast("string")).alias("file_path"), F.col("at").alias("page"), F.when(F.col("at") % 3 > 0, F.col("word")).alias("text"))
    pages = words.groupBy("file_path", "page").agg(F.max("text").alias("text"))
    joined = files.join_pages(pages)
    return joined.join(files.is_digital(pages), "file_path").select("file_path", F.length("text").alias("n_chars"), "is_digital")


@query
def vision_pages(s, d):
    """Every page through the vision loop (without its pauses), then one text a file."""
    words = view(s, d, "words").groupBy((F.col("page_id") % 500).alias("f"), F.col("at").cast("int").alias("page")).agg(F.max("word").alias("w"))
    images = words.select(F.concat(F.lit("f"), F.col("f").cast("string")).alias("file_path"), "page", F.encode("w", "UTF-8").alias("image"))
    return files.broken_pages(files.see_pages(images, models.Offline(), pace=0))


@query
def scan_describe(s, d):
    images = view(s, d, "paths").select(F.col("id").cast("long").alias("image_id"), "path", F.encode("path", "UTF-8").alias("image"))
    return imaging.describe(images, models.Offline())


@query
def scan_prompts(s, d):
    return view(s, d, "paths").select("id", imaging.scan_prompt(imaging.modality(F.col("path"))).alias("prompt"))


@query
def xray_phrases(s, d):
    paths = view(s, d, "described").select("image_id", F.concat(F.when(F.col("image_id") % 2 == 0, "a/chest-xray-").otherwise("b/mri-"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"))
    return imaging.score_phrases(paths.withColumn("image", F.encode("path", "UTF-8")), models.Offline()).filter("ordinal < 3")


@query
def split_bars(s, d):
    packed = F.concat(F.lit(" | "), F.col("type"), F.lit(" |"), F.coalesce("checked_in_at", F.lit("")), F.lit("|  | "), F.col("status"), F.lit("|"))
    return strings.exploded(view(s, d, "appts").select("id", strings.split_pipe(packed).alias("parts")), "parts", "at", "part").select("id", "at", "part")


@query
def shown_texts(s, d):
    """What a page shows of questions: escaped, and as an attribute."""
    return view(s, d, "asked").select("question_id", strings.escaped(F.concat(F.lit("<b>'"), "question", F.lit("'</b> & \""))).alias("shown"), strings.attribute(F.concat(F.lit('say "'), "question", F.lit("\\"))).alias("attribute"))


@query
def name_initials(s, d):
    return view(s, d, "staff").select("id", strings.initials(F.concat("name", F.lit("  X"))).alias("initials"), strings.initials(F.concat(F.lit(" "), "dept")).alias("dept"))


@query
def countdown(s, d):
    return view(s, d, "appts").select("id", strings.countdown((F.col("id") * 37 % 9000 - 100) / 2).alias("left"))


@query
def password_check(s, d):
    salted = view(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("password"), F.md5("n_name").alias("salt")).withColumn("hash", strings.password_hash("password", "salt"))
    given = F.when(F.col("id") % 3 == 0, F.concat("password", F.lit("x"))).otherwise(F.col("password"))
    return salted.select("id", F.length("hash").alias("length"), (strings.password_hash(given, "salt") == F.col("hash")).alias("right"))


@query
def document_headers(s, d):
    return vault.headers(registered(s, d))


@query
def patient_dashboard(s, d):
    return vault.dashboard(vault.headers(registered(s, d)), view(s, d, "appts"))


@query
def sink_append(s, d):
    path, rows = scratch(s), view(s, d, "appts").select("id", "status")
    for part in (0, 1):
        sinks.append(rows.filter(F.col("id") % 2 == part), path, "status")
    return s.read.parquet(path).select("id", "status")


@query
def sink_reports(s, d):
    path, rows = scratch(s), view(s, d, "arm_scores").select("page_id", "arm", "confidence", "chars").filter("confidence is not null")
    sinks.csv(rows, f"{path}/csv", ["page_id", "arm", "chars"])
    sinks.json(rows.select("page_id", "arm", "confidence"), f"{path}/json")
    table = s.read.option("header", True).schema("page_id long, arm string, chars long").csv(f"{path}/csv")
    return table.join(s.read.schema("page_id long, arm string, confidence double").json(f"{path}/json"), ["page_id", "arm"])


@query
def upload_route(s, d):
    return view(s, d, "paths").select("id", imaging.pipeline_of(F.element_at(F.split("path", "/"), -1)).alias("pipeline"))


# -- questions -----------------------------------------------------------------------


@query
def query_char_fix(s, d):
    return view(s, d, "asked").select("question_id", questions.repair(F.col("question")).alias("repaired"))


@query
def query_abbrev(s, d):
    return view(s, d, "asked").select("question_id", questions.expand(F.col("question")).alias("expanded"))


@query
def query_fuzzy(s, d):
    return view(s, d, "asked").select("question_id", questions.correct(F.col("question")).alias("corrected"))


@query
def query_normalise(s, d):
    return questions.normalise(view(s, d, "asked"), passes=2).select("question_id", "normalised")


@query
def query_route(s, d):
    return questions.route(view(s, d, "asked")).select("question_id", "query_class", "route")


@query
def answer_verification(s, d):
    answers = view(s, d, "asked").select("question_id", F.when(F.length("question") % 3 > 0, F.col("question")).alias("answer"), F.when(F.length("question") % 2 == 0, "context").otherwise("").alias("context"))
    return verdicts.verify_answers(answers, models.Offline())


@query
def agent_dispatch(s, d):
    routes = F.array(*(F.lit(r) for r in ("timeline_agent", "admission_agent", "medication_agent", "allergy_agent", "surgery_agent", "rag_agent")))
    asked = view(s, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.explode(routes).alias("route")).withColumn("question_id", F.concat_ws("-", F.col("patient_id").cast("string"), "route"))
    return vault.dispatch(asked, vaulted(s, d)).select("question_id", "route", "confidence")


# -- retrieval -----------------------------------------------------------------------


@query
def bm25_topk(s, d):
    docs = view(s, d, "documents").select(F.col("source").alias("patient_id"), F.col("doc_id").alias("chunk_id"), "text")
    return retrieval.bm25_top(docs, view(s, d, "questions")).select("question_id", "chunk_id", "rank", "bm25_score")


@query
def bm25_filtered(s, d):
    docs = view(s, d, "documents").select(F.col("source").alias("patient_id"), F.col("doc_id").alias("chunk_id"), "text", "lang")
    return retrieval.bm25_top(docs, view(s, d, "questions"), {"lang": "en"}).select("question_id", "chunk_id", "rank", "bm25_score")


@query
def vector_topk(s, d):
    e = view(s, d, "embeddings").select(F.col("label").cast("string").alias("patient_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = view(s, d, "embeddings").filter("vec_id % 20 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").cast("string").alias("patient_id"), F.col("embedding").alias("query_vector"))
    return retrieval.vector_top(e, asked)


@query
def vector_filtered(s, d):
    return retrieval.vector_top(view(s, d, "chunks"), view(s, d, "questions"), {"semantic_type": "diagnosis"}).select("question_id", "chunk_id", "score", "rank")


@query
def vector_unit(s, d):
    u = numbers.unit(F.col("embedding"))
    return view(s, d, "embeddings").select("vec_id", F.round(numbers.dot(u, u), 6).alias("length2"), F.round(F.get(u, F.lit(0)), 6).alias("x0"))


@query
def rrf_fuse(s, d):
    chunks, asked = view(s, d, "chunks"), view(s, d, "questions")
    return retrieval.fuse(retrieval.vector_top(chunks, asked), retrieval.bm25_top(chunks, asked), chunks, k=40).select("question_id", "position", "chunk_id", "rrf_score")


@query
def hybrid_topk(s, d):
    return retrieval.hybrid(view(s, d, "chunks"), view(s, d, "questions")).select("question_id", "position", "chunk_id", "rrf_score")


@query
def rerank_topk(s, d):
    return hits(s, d).select("question_id", "final", "chunk_id", "rerank_score")


@query
def rag_context(s, d):
    return retrieval.context(hits(s, d), "final")


@query
def confidence_score(s, d):
    return retrieval.confidence(hits(s, d), "final").select("question_id", "confidence", "quality")


@query
def rag_confidence(s, d):
    return retrieval.rerank_confidence(hits(s, d))


@query
def agent_confidence(s, d):
    return view(s, d, "asked").select("question_id", retrieval.answer_confidence(F.col("question")).alias("confidence"))


# -- vault ---------------------------------------------------------------------------


@query
def vault_timeline(s, d):
    return vault.timeline(vaulted(s, d))


@query
def timeline_text(s, d):
    return vault.timeline_text(vault.timeline(vaulted(s, d)))


@query
def vault_medications(s, d):
    return vault.medications(vaulted(s, d))


@query
def vault_allergies(s, d):
    return vault.allergies(vaulted(s, d))


@query
def vault_surgeries(s, d):
    return vault.surgeries(vaulted(s, d))


@query
def vault_summary(s, d):
    names = ["allergies", "medications", "diagnoses", "surgeries", "doctors", "hospitals"]
    return vault.summary(vaulted(s, d)).select("patient_id", *(F.array_join(c, " | ").alias(c) for c in names), "latest_visit", "document_count")


@query
def summary_text(s, d):
    return vault.summary_text(vault.summary(vaulted(s, d)))


@query
def medications_text(s, d):
    return vault.medications_text(vault.medications(vaulted(s, d)))


@query
def allergies_text(s, d):
    return vault.allergies_text(vault.allergies(vaulted(s, d)))


@query
def surgeries_text(s, d):
    return vault.surgeries_text(vault.surgeries(vaulted(s, d)))


@query
def vault_inspect(s, d):
    return vault.inspect(vaulted(s, d).withColumn("semantic_type", text.semantic_of(F.col("doc_type"))))


@query
def vault_groups(s, d):
    return vault.groups(view(s, d, "chunks"))


# -- workflow ------------------------------------------------------------------------


@query
def access_doctor_patients(s, d):
    return workflow.doctor_patients(view(s, d, "appts"), view(s, d, "users"))


@query
def access_hospital_patients(s, d):
    return workflow.hospital_patients(view(s, d, "appts"), view(s, d, "users"), view(s, d, "staff"))


@query
def access_check(s, d):
    return workflow.access(view(s, d, "requests"), view(s, d, "appts"), view(s, d, "staff")).select("request_id", "allowed")


@query
def access_check_fixed(s, d):
    return workflow.access(view(s, d, "requests"), view(s, d, "appts"), view(s, d, "staff"), fix_access=True).select("request_id", "allowed")


@query
def appointments_public(s, d):
    return workflow.appointments_public(view(s, d, "appts"), view(s, d, "users"), view(s, d, "staff")).select("id", "patient_name", "doctor_name", "dept", "hospital", "status")


@query
def checkin_window(s, d):
    now = F.to_timestamp(F.lit("1996-06-15 10:00:00"))
    return workflow.checkin(view(s, d, "appts"), now).select("id", "can_check_in")


@query
def queue_position(s, d):
    found = workflow.queue(view(s, d, "appts"), view(s, d, "staff"), F.trunc("time", "month"))
    return found.select("id", "status", "position", "ahead_count", "estimated_wait_minutes", "is_current", F.date_format("estimated_call_time", "yyyy-MM-dd HH:mm:ss").alias("estimated_call_time"), "drift_minutes")


@query
def next_appointment(s, d):
    return workflow.next_appointment(view(s, d, "appts")).select("patient_id", "id", "status")


@query
def doctor_lists(s, d):
    return workflow.waiting(view(s, d, "appts"))


@query
def dashboard_counts(s, d):
    return workflow.dashboard(view(s, d, "appts"))


@query
def drift_sum(s, d):
    return workflow.drift(view(s, d, "adjustments"))


def admissions(s: SparkSession, d: str) -> DataFrame:
    """Admissions with the form as a struct."""
    form = {"policy_number": "policy_number", "sum_insured": "sum_insured", "estimated_cost": "est", "diagnosis": "pre_diagnosis", "length_of_stay": "stay", "room_category": "room"}
    return view(s, d, "adm").withColumn("preauth", F.struct(*(F.col(c).alias(n) for n, c in form.items())))


def checked(s: SparkSession, d: str) -> DataFrame:
    return workflow.tier1(workflow.required_items(admissions(s, d)), workflow.slot_documents(view(s, d, "adm_docs")))


@query
def adm_required_items(s, d):
    return workflow.required_items(admissions(s, d)).select("admission_id", "item_key")


@query
def adm_slot_docs(s, d):
    docs = view(s, d, "adm_docs")
    parts = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit("page one").alias("text"), F.lit("").alias("diagnosis")), F.struct(F.lit(1).alias("chunk_index"), F.col("text"), F.col("diagnosis")))
    chunks = docs.select("patient_id", "file_name", F.explode(parts).alias("x")).select("patient_id", "file_name", "x.*")
    return workflow.slot_documents(docs.drop("text", "diagnosis"), chunks).select("admission_id", "slot", "id", "text", "diagnosis")


@query
def adm_tier1(s, d):
    return checked(s, d).select("admission_id", "item_key", "tier", "status", "source_document_id", "explanation", "escalate")


@query
def adm_derived(s, d):
    return workflow.derived(admissions(s, d), checked(s, d), workflow.slot_documents(view(s, d, "adm_docs")))


@query
def adm_verdicts(s, d):
    judged = checked(s, d).filter("escalate").select("admission_id", "item_key", F.when(F.length("admission_id") % 2 == 0, "verified").otherwise("uncertain").alias("verdict"), F.lit("judged").alias("note")).filter("substr(admission_id, -1) < '7'")
    return workflow.with_verdicts(checked(s, d), judged).select("admission_id", "item_key", "tier", "status", "explanation")


@query
def adm_model_verdicts(s, d):
    documents = workflow.slot_documents(view(s, d, "adm_docs"))
    found = stored(workflow.derived(admissions(s, d), checked(s, d), documents))
    return workflow.judged(admissions(s, d), found, documents, models.Offline()).select("admission_id", "item_key", "tier", "status", "explanation")


@query
def status_update(s, d):
    wanted = F.array(*(F.lit(x) for x in ("accepted", "checked_in", "in_consultation", "completed", "gone")))
    asked = view(s, d, "appts").filter("id % 3 = 0").select(F.col("id").alias("request_id"), F.when(F.col("id") % 4 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"), F.get(wanted, (F.col("id") % 5).cast("int")).alias("status"))
    return workflow.set_status(view(s, d, "appts"), asked, F.lit("2024-01-01T09:00:00"))


@query
def patients_listed(s, d):
    """What a doctor sees whatever the hospital, what a hospital sees, and what all see."""
    tables = view(s, d, "appts"), view(s, d, "users"), view(s, d, "staff")
    listed = {"doctor": workflow.patients(*tables, doctor_id=3, hospital="FRANCE"), "hospital": workflow.patients(*tables, hospital="FRANCE"), "all": workflow.patients(*tables)}
    parts = [rows.select(F.lit(k).alias("caller"), "id", "name") for k, rows in listed.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def adm_status(s, d):
    return workflow.admission_status(view(s, d, "adm"), view(s, d, "checklist"))


@query
def adm_payment_gate(s, d):
    adm = view(s, d, "adm")
    return workflow.payment(adm, view(s, d, "checklist"), adm.select("admission_id", F.upper(F.substring(F.md5("admission_id"), 1, 8)).alias("token")))


@query
def adm_redeem(s, d):
    adm = view(s, d, "adm")
    asked = adm.select(F.col("k").alias("request_id"), F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), F.lower(F.coalesce("token", F.lit("none"))), F.lit(" "))).otherwise("ABCDEFGH").alias("token"))
    return workflow.redeem(asked, adm)


@query
def adm_resolution_overlay(s, d):
    return workflow.resolve(view(s, d, "checklist"), view(s, d, "resolutions")).select("item_id", "status", "explanation")


@query
def adm_get_or_create(s, d):
    adm = view(s, d, "adm").filter("k % 2 = 0")
    found = workflow.get_or_create(view(s, d, "appts").filter("type = 'admission'"), adm)
    return found.select("appointment_id", F.col("admission_date").cast("string").alias("admission_date"), "status")


@query
def admission_public(s, d):
    found = workflow.admission_public(view(s, d, "adm"), view(s, d, "checklist"), view(s, d, "staff"), view(s, d, "users"))
    return found.select("admission_id", "patient_name", "doctor_name", "hospital", F.array_join(F.transform("checklist", lambda x: F.concat_ws("=", x["item_key"], x["status"])), ",").alias("checklist"))


@query
def worklist_needs_review(s, d):
    return workflow.needs_review(view(s, d, "checklist"), view(s, d, "adm"), view(s, d, "staff"), view(s, d, "users"))


@query
def admissions_by_hospital(s, d):
    return workflow.hospital_admissions(view(s, d, "adm"), view(s, d, "staff")).select("hospital", "admission_id", "status")


@query
def token_mint(s, d):
    adm = view(s, d, "adm")
    return workflow.mint_tokens(adm, adm.filter("token is not null").select("token"))


# -- validators and verdicts ---------------------------------------------------------


@query
def valid_aadhaar(s, d):
    return view(s, d, "id_numbers").select("id", validators.national_id_valid(F.col("number")).alias("valid"))


@query
def valid_pan(s, d):
    return view(s, d, "id_numbers").select("id", validators.tax_holder_valid(F.col("tax")).alias("valid"))


@query
def valid_insurance(s, d):
    return view(s, d, "notes").select("note_id", validators.insurance_score(F.col("text")).cast("long").alias("score"))


@query
def valid_regno(s, d):
    return view(s, d, "notes").select("note_id", validators.has_registration(F.col("text")).alias("registered"))


@query
def parse_verdict(s, d):
    return view(s, d, "replies").select("id", verdicts.verdict(F.col("raw")).alias("v")).select("id", "v.verdict", "v.status", "v.explanation")


@query
def parse_verification(s, d):
    return view(s, d, "replies").select("id", verdicts.verification(F.col("raw")).alias("v"), verdicts.supported(F.col("raw")).alias("supported")).select("id", "v.verified", "v.explanation", "supported")


# -- images and evaluation -----------------------------------------------------------


@query
def img_modality(s, d):
    return view(s, d, "paths").select("id", imaging.modality(F.col("path")).alias("modality"))


@query
def img_abnormal(s, d):
    return imaging.findings(view(s, d, "phrases"), view(s, d, "described"))


@query
def img_tier(s, d):
    c = [F.col(x) for x in ("sharpness", "noise", "contrast", "skew", "occupancy", "handwriting", "component", "stroke")]
    t = view(s, d, "img_metrics").select("page_id", "sharpness", imaging.tier(*c).alias("tier"))
    return t.select("page_id", "tier", imaging.preset_of(F.col("tier")).alias("preset"), F.round(imaging.blur_score(F.col("sharpness")), 4).alias("blur_score"))


@query
def img_band(s, d):
    return view(s, d, "img_metrics").select("page_id", imaging.band(F.col("confidence")).alias("band"))


@query
def img_arms(s, d):
    return view(s, d, "img_metrics").select("page_id", F.array_join(imaging.arms(F.col("confidence"), F.col("skew"), F.col("occupancy")), ",").alias("arms"))


@query
def img_plan(s, d):
    from vaultspark import lexicons

    presets = F.array(*(F.lit(p) for p in lexicons.PRESETS))
    m = view(s, d, "img_metrics").withColumn("preset", F.get(presets, (F.col("page_id") % len(lexicons.PRESETS)).cast("int")))
    return m.select("page_id", "preset", F.array_join(imaging.plan(F.col("preset"), F.col("sharpness"), F.col("noise"), F.col("contrast"), F.col("skew"), F.col("boxed")), ",").alias("steps"))


@query
def img_parameters(s, d):
    from vaultspark import lexicons

    presets = F.array(*(F.lit(p) for p in lexicons.PRESETS))
    m = view(s, d, "img_metrics").select("page_id", F.get(presets, (F.col("page_id") % len(lexicons.PRESETS)).cast("int")).alias("preset"))
    steps = m.select("page_id", "preset", F.explode_outer(imaging.parameters(F.col("preset"))).alias("step", "values")).filter("step is not null")
    return steps.select("preset", "step", F.explode_outer("values").alias("name", "value")).groupBy("preset", "step", "name", "value").agg(F.count(F.lit(1)).alias("n"))


@query
def img_winner(s, d):
    return imaging.winner(view(s, d, "arm_scores"))


@query
def kernel_stats(s, d):
    pixels = F.unhex(F.substring(F.concat(*(F.md5(F.concat(F.col("o_orderkey").cast("string"), F.lit(f"-{k}"))) for k in range(16))), 1, 512))
    return imaging.measure(view(s, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(16).alias("width"), pixels.alias("pixels")))


@query
def eval_arms(s, d):
    return evaluation.arms(view(s, d, "arm_scores"))


@query
def eval_improved(s, d):
    return evaluation.improved(imaging.winner(view(s, d, "arm_scores"))).select("page_id", "conf_improvement", "is_improved")


@query
def eval_composite(s, d):
    return evaluation.presets(view(s, d, "preset_runs")).select("page_id", "preset_name", "confidence_delta", "char_improvement_pct", "word_improvement_pct", "text_length_ratio", "composite_score")


@query
def eval_rank(s, d):
    return evaluation.ranked(evaluation.presets(view(s, d, "preset_runs"))).select("page_id", "preset_name", "place")


@query
def eval_best(s, d):
    return evaluation.best(evaluation.presets(view(s, d, "preset_runs")))


# -- models and streams --------------------------------------------------------------


@query
def embed_offline(s, d):
    found = models.embed(view(s, d, "documents").select("doc_id", "text"), models.Offline())
    return found.select("doc_id", F.round(numbers.norm(F.col("embedding")), 4).alias("length"))


@query
def stream_ingest(s, d):
    folder = scratch(s)
    view(s, d, "notes").drop("chunk_index", "chunk_id").withColumn("extraction_method", F.lit("plaintext")).withColumn("patient_id", F.col("patient_id").cast("string")).write.parquet(f"{folder}/in")
    docs = ingest.documents(s, f"{folder}/in", "note_id long, patient_id string, file_name string, file_path string, text string, extraction_method string")
    ingest.start(ingest.chunks(docs), f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out").groupBy("doc_type", "semantic_type").agg(F.count(F.lit(1)).alias("n"))


@query
def stream_notify(s, d):
    folder = scratch(s)
    view(s, d, "events").select((F.col("user_id")).alias("id"), (F.col("event_id") % 4).alias("ahead_count"), F.to_timestamp(F.lit("2024-01-01")).alias("at")).write.parquet(f"{folder}/in")
    events = ingest.documents(s, f"{folder}/in", "id long, ahead_count long, at timestamp")
    ingest.start(ingest.notices(events), f"{folder}/out", f"{folder}/state").awaitTermination()
    return s.read.parquet(f"{folder}/out").select("id")
