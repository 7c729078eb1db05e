"""Access, appointments, queues and admissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark import models
from vaultspark.functions.strings import filled, first_match, holds_all, lookup, rx, word_set
from vaultspark.functions.validators import has_registration, insurance_score, national_id_valid, tax_holder_valid
from vaultspark.operators import verdicts
from vaultspark.session import stored


def taken_on(status: Column) -> Column:
    """Accepted or later."""
    return ~status.isin("pending", "declined")


def doctor_patients(appointments: DataFrame, users: DataFrame) -> DataFrame:
    """doctor_id, id and name of the patients that each doctor has taken on."""
    pairs = appointments.filter(taken_on(F.col("status"))).select("doctor_id", F.col("patient_id").alias("id")).distinct()
    return pairs.join(users.select("id", "name"), "id").select("doctor_id", "id", "name")


def hospital_patients(appointments: DataFrame, users: DataFrame, staff: DataFrame) -> DataFrame:
    """hospital (lower case), id and name of the patients taken on by any of its doctors."""
    at = staff.select(F.col("id").alias("doctor_id"), F.lower("hospital").alias("hospital"))
    pairs = appointments.filter(taken_on(F.col("status"))).join(at, "doctor_id").select("hospital", F.col("patient_id").alias("id")).distinct()
    return pairs.join(users.select("id", "name"), "id").select("hospital", "id", "name")


def patients(appointments: DataFrame, users: DataFrame, staff: DataFrame, doctor_id=None, hospital: str | None = None) -> DataFrame:
    """Patients that a caller may see: a doctor's own, or a hospital's, or all; by name."""
    if doctor_id is not None:
        return doctor_patients(appointments, users).filter(F.col("doctor_id") == doctor_id).select("id", "name").orderBy("name", "id")
    if hospital:
        return hospital_patients(appointments, users, staff).filter(F.col("hospital") == hospital.lower()).select("id", "name").orderBy("name", "id")
    return users.select("id", "name").orderBy("name", "id")


def access(requests: DataFrame, appointments: DataFrame, staff: DataFrame, fix_access: bool = False) -> DataFrame:
    """Add allowed. requests: request_id, role, requester_id, requester_hospital, patient_id.

    One's own records: yes. A doctor: after taking the patient on. Hospital
    staff: after a doctor of their hospital did. Any other role: yes, as it
    always was; with fix_access, no.
    """
    taken = appointments.filter(taken_on(F.col("status")))
    by_doctor = taken.select(F.col("doctor_id").alias("requester_id"), "patient_id").distinct().withColumn("__d", F.lit(True))
    at = staff.select(F.col("id").alias("doctor_id"), F.lower("hospital").alias("__h"))
    by_hospital = taken.join(at, "doctor_id").select("__h", "patient_id").distinct().withColumn("__s", F.lit(True))
    met = requests.withColumn("__h", F.lower("requester_hospital")).join(by_doctor, ["requester_id", "patient_id"], "left").join(by_hospital, ["__h", "patient_id"], "left")
    no = F.lit(False)
    allowed = F.when(F.col("requester_id") == F.col("patient_id"), True).when(F.col("role") == "doctor", F.coalesce("__d", no)).when(F.col("role").isin(L.STAFF_ROLES), F.coalesce("__s", no)).otherwise(not fix_access)
    return met.withColumn("allowed", allowed).select(*requests.columns, "allowed")


def appointments_public(appointments: DataFrame, users: DataFrame, staff: DataFrame) -> DataFrame:
    """Appointments with names (the raw id where there is none) and the doctor's place."""
    p = users.select(F.col("id").alias("patient_id"), F.col("name").alias("__p"))
    d = staff.select(F.col("id").alias("doctor_id"), F.col("name").alias("__d"), "dept", "hospital")
    met = appointments.join(p, "patient_id", "left").join(d, "doctor_id", "left")
    return met.select("id", "patient_id", F.coalesce("__p", F.col("patient_id").cast("string")).alias("patient_name"), "doctor_id", F.coalesce("__d", F.col("doctor_id").cast("string")).alias("doctor_name"), "dept", "hospital", "time", "type", "status", "checked_in_at")


def checkin(appointments: DataFrame, now: Column) -> DataFrame:
    """Add minutes_until and can_check_in: accepted, and at most 30 minutes ahead (any time later)."""
    minutes = (F.unix_timestamp("time") - F.unix_timestamp(now)) / 60.0
    return appointments.withColumn("minutes_until", minutes).withColumn("can_check_in", (F.col("status") == "accepted") & (F.col("minutes_until") <= L.CHECKIN_MINUTES))


def consult_minutes(kind: Column) -> Column:
    return lookup(kind, L.CONSULT_MINUTES, L.OTHER_MINUTES)


def queue(appointments: DataFrame, staff: DataFrame, period: Column | None = None) -> DataFrame:
    """Position, number and minutes ahead, and call time (slot plus the doctor's drift), within each doctor's day.

    Rows of any other status than checked in or in consultation have none.
    """
    live = F.col("status").isin("checked_in", "in_consultation")
    day = period if period is not None else F.to_date("time")
    drift = staff.select(F.col("id").alias("doctor_id"), F.col("drift").alias("__drift"))
    met = appointments.withColumn("__day", day).withColumn("__live", live)
    w = Window.partitionBy("doctor_id", "__day", "__live").orderBy("time", F.coalesce("checked_in_at", F.lit("")), "id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    ranked = met.withColumns({"position": F.row_number().over(w), "__ahead": F.coalesce(F.sum(consult_minutes(F.col("type"))).over(before), F.lit(0))}).join(drift, "doctor_id", "left")
    none = lambda c: F.when(F.col("__live"), c)
    minutes = F.coalesce("__drift", F.lit(0))
    return ranked.select(
        "id", "doctor_id", "status", none(F.col("position")).cast("int").alias("position"), none(F.col("position") - 1).cast("int").alias("ahead_count"), none(F.col("__ahead")).cast("long").alias("estimated_wait_minutes"),
        (F.col("status") == "in_consultation").alias("is_current"), none(F.col("time") + F.make_dt_interval(mins=minutes)).alias("estimated_call_time"), minutes.alias("drift_minutes"),
    )


def next_appointment(appointments: DataFrame) -> DataFrame:
    """Each patient's first: one that is live before one that is accepted, then by time."""
    order = F.when(F.col("status").isin("checked_in", "in_consultation"), 0).when(F.col("status") == "accepted", 1)
    open_ = appointments.withColumn("__o", order).filter("__o is not null")
    w = Window.partitionBy("patient_id").orderBy("__o", "time", "id")
    return open_.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("patient_id", "id", "status", "time")


def waiting(appointments: DataFrame) -> DataFrame:
    """Each doctor's open appointments with their list (queue or waiting) and place in it."""
    part = F.when(F.col("status").isin("checked_in", "in_consultation"), "queue").when(F.col("status") == "accepted", "waiting")
    listed = appointments.withColumn("list", part).filter("list is not null")
    return listed.withColumn("place", F.row_number().over(Window.partitionBy("doctor_id", "list").orderBy("time", "id"))).select("doctor_id", "list", "place", "id")


def dashboard(appointments: DataFrame) -> DataFrame:
    """Counts of a doctor's appointments by what they wait for."""
    return appointments.groupBy("doctor_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.count_if(F.col("type") == "new").alias("n_new"), F.count_if(F.col("status") == "accepted").alias("n_awaiting"), F.count_if(F.col("status").isin("checked_in", "in_consultation")).alias("n_live"))


def drift(adjustments: DataFrame) -> DataFrame:
    """Each doctor's running total of minutes."""
    return adjustments.groupBy("doctor_id").agg(F.sum("delta_minutes").alias("drift_minutes"))


# -- admissions ----------------------------------------------------------------------


def required_items(admissions: DataFrame) -> DataFrame:
    """A row per checklist item that an admission needs."""
    insured = F.col("payment_path") == "insurance"
    rules = [
        ("identity", F.lit(True)), ("medical_doc", F.lit(True)), ("insurance_policy", insured), ("preauth_form", insured),
        ("kyc_pan", insured & (F.coalesce("estimated_cost", F.lit(0)) >= L.PAN_COST)), ("employee_id", insured & F.coalesce("is_corporate", F.lit(False))),
    ]
    items = F.filter(F.array(*(F.struct(F.coalesce(on, F.lit(False)).alias("on"), F.lit(k).alias("k")) for k, on in rules)), lambda x: x["on"])
    return admissions.select("*", F.explode(F.transform(items, lambda x: x["k"])).alias("item_key"))


def slot_documents(documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The newest document of each admission's slot; with chunks, its text put together again in their order and the first filled diagnosis."""
    w = Window.partitionBy("admission_id", "slot").orderBy(F.desc("uploaded_at"), "id")
    newest = documents.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    if chunks is None:
        return newest
    texts = chunks.groupBy("patient_id", "file_name").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text", "diagnosis"))).alias("c"))
    found = F.filter(F.transform("c", lambda x: filled(x["diagnosis"])), lambda x: x.isNotNull())
    return newest.join(texts, ["patient_id", "file_name"], "left").withColumns({"text": F.coalesce(F.array_join(F.transform("c", lambda x: x["text"]), "\n"), F.lit("")), "diagnosis": F.get(found, F.lit(0))}).drop("c")


def _result(tier: int, status: str, source: Column | None, explanation) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(status).alias("status"), (source if source is not None else F.lit(None).cast("string")).alias("source_document_id"), (explanation if isinstance(explanation, Column) else F.lit(explanation)).alias("explanation"))


def tier1(items: DataFrame, documents: DataFrame) -> DataFrame:
    """Decide each item by fixed rules: add tier, status, source_document_id, explanation and escalate.

    items: rows of required_items with preauth (a struct); documents: rows of
    slot_documents. An item that is missing although its document is there is
    escalated to a model, but for the form and the tax card.
    """
    docs = documents.select("admission_id", F.col("slot").alias("item_key"), F.col("id").alias("__id"), F.col("doc_type").alias("__type"), F.coalesce("text", F.lit("")).alias("__text"))
    met = items.join(docs, ["admission_id", "item_key"], "left")
    doc, text, none = F.col("__id"), F.col("__text"), F.col("__id").isNull()
    national, tax = first_match(text, rx(L.NATIONAL_ID)), first_match(text, rx(L.TAX_ID))
    identity = (
        F.when(none, _result(1, "missing", None, L.MESSAGES["identity_absent"]))
        .when(national.isNotNull() & national_id_valid(national), _result(1, "verified", doc, L.MESSAGES["national_ok"]))
        .when(national.isNotNull(), _result(1, "missing", doc, L.MESSAGES["national_bad"]))
        .when(tax.isNotNull() & tax_holder_valid(tax), _result(1, "verified", doc, L.MESSAGES["tax_ok"]))
        .when(tax.isNotNull(), _result(1, "missing", doc, L.MESSAGES["tax_bad"]))
        .when(text.rlike(rx(L.VOTER_ID)) | text.rlike(rx(L.PASSPORT)), _result(1, "verified", doc, L.MESSAGES["identity_ok"]))
        .otherwise(_result(1, "missing", doc, L.MESSAGES["identity_unknown"]))
    )
    classed = F.concat(F.lit(L.MESSAGES["classified"]), F.col("__type"))

    def by_class(label: str, kinds: list[str], verified: Column) -> Column:
        return (
            F.when(none, _result(1, "missing", None, f"No {label.lower()} uploaded yet")).when(F.col("__type").isin(kinds), verified)
            .otherwise(_result(1, "missing", doc, f"{label}: uploaded document didn't classify as expected — needs a closer look"))
        )

    registered = F.when(has_registration(text), _result(1, "verified", doc, F.concat(classed, F.lit(L.MESSAGES["registered"])))).otherwise(
        _result(1, "missing", doc, F.concat(classed, F.lit(L.MESSAGES["unregistered"])))
    )
    lacking = F.filter(F.array(*(F.when(filled(F.col(f"preauth.{f}")).isNull(), F.lit(f)) for f in L.PREAUTH_FIELDS)), lambda x: x.isNotNull())
    form = F.when(F.size(lacking) > 0, _result(1, "missing", None, F.concat(F.lit(L.MESSAGES["fields_missing"]), F.array_join(lacking, ", ")))).otherwise(_result(1, "verified", None, L.MESSAGES["form_ok"]))
    card = F.when(~none & tax.isNotNull(), _result(1, "verified", doc, L.MESSAGES["card_ok"])).otherwise(_result(1, "missing", None, L.MESSAGES["card_absent"]))
    employee = F.when(none, _result(1, "missing", None, L.MESSAGES["employee_absent"])).otherwise(_result(1, "verified", doc, L.MESSAGES["employee_ok"]))
    key = F.col("item_key")
    decided = (
        F.when(key == "identity", identity).when(key == "medical_doc", by_class("Medical document", L.MEDICAL_DOC_TYPES, registered))
        .when(key == "insurance_policy", by_class("Insurance policy", ["insurance"], _result(1, "verified", doc, classed))).when(key == "preauth_form", form).when(key == "kyc_pan", card).when(key == "employee_id", employee)
    )
    kept = [c for c in items.columns if c not in ("tier", "status", "source_document_id", "explanation")]
    out = met.withColumn("__r", decided).select(*kept, "__r.*")
    return out.withColumn("escalate", (F.col("status") == "missing") & F.col("source_document_id").isNotNull() & (key != "preauth_form"))


def with_verdicts(checked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Escalated rows as a model judged them (admission_id, item_key, verdict, note); without a verdict they need review."""
    met = checked.join(verdicts, ["admission_id", "item_key"], "left")
    status = F.when(F.col("verdict").isin("verified", "missing"), F.col("verdict")).otherwise("needs_review")
    up = F.col("escalate")
    return met.withColumns({"tier": F.when(up, 2).otherwise(F.col("tier")), "status": F.when(up, status).otherwise(F.col("status")), "explanation": F.when(up, F.coalesce("note", F.lit(L.UNAVAILABLE))).otherwise(F.col("explanation"))}).drop("verdict", "note")


def derived(admissions: DataFrame, checked: DataFrame, documents: DataFrame) -> DataFrame:
    """Checks of name, policy and diagnosis for admissions whose own item is verified: admission_id, item_key, tier, status, source_document_id, explanation, escalate."""
    docs = documents.select("admission_id", F.col("slot").alias("parent"), F.col("id").alias("__id"), F.col("doc_type").alias("__type"), F.coalesce("text", F.lit("")).alias("__text"), F.col("diagnosis").alias("__diagnosis"))
    parents = {"identity": "identity_name_match", "insurance_policy": "insurance_policy_match", "medical_doc": "diagnosis_match"}
    held = checked.filter((F.col("status") == "verified") & F.col("item_key").isin(list(parents))).select("admission_id", F.col("item_key").alias("parent"))
    met = held.join(admissions, "admission_id").join(docs, ["admission_id", "parent"], "left")
    doc, text, none = F.col("__id"), F.col("__text"), F.col("__id").isNull()
    name, reason, number = filled(F.col("patient_name")), filled(F.col("admission_reason")), filled(F.col("preauth.policy_number"))
    ask = lambda: _result(2, "missing", doc, F.lit(None).cast("string"))
    named = (
        F.when(none, _result(2, "missing", None, L.MESSAGES["name_no_document"])).when(name.isNull(), _result(2, "missing", doc, L.MESSAGES["name_unknown"]))
        .when(holds_all(word_set(name), word_set(text)), _result(1, "verified", doc, L.MESSAGES["name_ok"])).otherwise(ask())
    )
    policy = (
        F.when(none | (F.col("__type") != "insurance"), _result(1, "missing", None, L.MESSAGES["policy_no_document"]))
        .when(number.isNull(), _result(1, "missing", doc, L.MESSAGES["policy_unknown"]))
        .when(F.contains(F.lower(text), F.lower(number)) & (insurance_score(text) >= 1), _result(1, "verified", doc, L.MESSAGES["policy_ok"])).otherwise(ask())
    )
    told = F.filter(word_set(reason), lambda w: F.length(w) > 3)
    diagnosed = (
        F.when(none | reason.isNull(), _result(2, "missing", None, L.MESSAGES["diagnosis_absent"]))
        .when(holds_all(told, word_set(F.coalesce(filled(F.col("__diagnosis")), F.substring(text, 1, 500)))), _result(1, "verified", doc, L.MESSAGES["diagnosis_ok"])).otherwise(ask())
    )
    decided = F.when(F.col("parent") == "identity", named).when(F.col("parent") == "insurance_policy", policy).otherwise(diagnosed)
    return met.withColumn("__r", decided).select("admission_id", lookup(F.col("parent"), parents, "").alias("item_key"), "__r.*").withColumn("escalate", F.col("explanation").isNull())


def match_prompts(admissions: DataFrame, found: DataFrame, documents: DataFrame) -> DataFrame:
    """admission_id, item_key and the prompt of each derived check that the rules leave open."""
    slots = {"identity_name_match": "identity", "insurance_policy_match": "insurance_policy", "diagnosis_match": "medical_doc"}
    docs = documents.select("admission_id", F.col("slot").alias("__slot"), F.coalesce("text", F.lit("")).alias("__text"), F.col("diagnosis").alias("__diagnosis"))
    open_ = found.filter("escalate").select("admission_id", "item_key", lookup(F.col("item_key"), slots, "").alias("__slot"))
    met = open_.join(admissions, "admission_id").join(docs, ["admission_id", "__slot"])
    number, text = F.col("preauth.policy_number"), F.substring("__text", 1, 1000)
    there = F.contains(F.lower("__text"), F.lower(filled(number)))
    on_form = F.when(F.col("item_key") == "identity_name_match", F.col("patient_name")).when(F.col("item_key") == "insurance_policy_match", F.concat(number, F.when(there, " (found in the document, which names no insurer or policy terms)").otherwise(" (not found as such in the document)"))).otherwise(F.col("admission_reason"))
    read = F.when(F.col("item_key") == "diagnosis_match", F.coalesce(filled(F.col("__diagnosis")), F.substring("__text", 1, 500))).otherwise(text)
    prompt = F.concat(lookup(F.col("item_key"), L.MATCH_PROMPTS, ""), F.lit(L.MATCH_REPLY + "\n\nFORM:\n"), on_form, F.lit("\n\nDOCUMENT:\n"), read)
    return met.select("admission_id", "item_key", prompt.alias("prompt"))


def judged(admissions: DataFrame, found: DataFrame, documents: DataFrame, provider) -> DataFrame:
    """The derived checks with a model's verdict on those that the rules leave open; an unreadable one needs review."""
    asked = models.ask(match_prompts(admissions, found, documents), provider)
    said = asked.select("admission_id", "item_key", verdicts.verdict(F.col("reply")).alias("v")).select("admission_id", "item_key", F.col("v.verdict").alias("verdict"), F.col("v.explanation").alias("note"))
    return with_verdicts(found, said)


def set_status(appointments: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """request_id, id, outcome (invalid for a status that can't be set by hand, not_found, or ok) and the appointment's status, started_at and completed_at after it. requests: request_id, id, status; one for each appointment."""
    rows = appointments.select("id", F.col("status").alias("__old"))
    met = requests.join(rows, "id", "left")
    outcome = F.when(~F.col("status").isin(L.SETTABLE), "invalid").when(F.col("__old").isNull(), "not_found").otherwise("ok")
    ok = F.col("outcome") == "ok"
    stamp = lambda s: F.when(ok & (F.col("asked") == s), now)
    done = met.select("request_id", "id", F.col("status").alias("asked"), "__old", outcome.alias("outcome"))
    return done.select("request_id", "id", "outcome", F.when(ok, F.col("asked")).otherwise(F.col("__old")).alias("status"), stamp("in_consultation").alias("started_at"), stamp("completed").alias("completed_at"))


def admission_status(admissions: DataFrame, checklist: DataFrame) -> DataFrame:
    """admission_id and status: ready for payment once every item is verified; later states stay."""
    done = checklist.groupBy("admission_id").agg(F.bool_and(F.col("status") == "verified").alias("__all"))
    met = admissions.join(done, "admission_id", "left")
    fresh = F.when(F.coalesce("__all", F.lit(False)), "ready_for_payment").otherwise("in_progress")
    return met.select("admission_id", F.when(F.col("status").isin("in_progress", "ready_for_payment"), fresh).otherwise(F.col("status")).alias("status"), F.coalesce("__all", F.lit(False)).alias("all_verified"))


def payment(admissions: DataFrame, checklist: DataFrame, tokens: DataFrame) -> DataFrame:
    """admission_id, outcome (confirmed or refused) and token. tokens: admission_id, token."""
    ok = F.col("all_verified")
    return admission_status(admissions, checklist).join(tokens, "admission_id", "left").select("admission_id", F.when(ok, "confirmed").otherwise("refused").alias("outcome"), F.when(ok, F.col("token")).alias("token"))


def redeem(requests: DataFrame, admissions: DataFrame) -> DataFrame:
    """request_id, admission_id and outcome: unknown token, redeemed before, not ready, or redeemed."""
    a = admissions.select("admission_id", F.col("token").alias("__t"), "token_redeemed", "status")
    met = requests.join(a, F.upper(F.trim(requests["token"])) == a["__t"], "left")
    outcome = F.when(F.col("admission_id").isNull(), "not_found").when(F.col("token_redeemed"), "already_redeemed").when(F.col("status") != "confirmed", "not_ready").otherwise("redeemed")
    return met.select("request_id", "admission_id", outcome.alias("outcome"))


def resolve(checklist: DataFrame, resolutions: DataFrame) -> DataFrame:
    """The checklist with each item's latest manual resolution (item_id, status, note, at) over it."""
    w = Window.partitionBy("item_id").orderBy(F.desc("at"), F.desc("status"))
    last = resolutions.filter(F.col("status").isin("verified", "missing")).withColumn("__n", F.row_number().over(w)).filter("__n = 1").select("item_id", F.col("status").alias("__s"), F.col("note").alias("__e"))
    default = F.when(F.col("__s") == "verified", L.MESSAGES["resolved"]).otherwise(L.MESSAGES["rejected"])
    met = checklist.join(last, "item_id", "left")
    set_ = F.col("__s").isNotNull()
    return met.withColumns({"status": F.coalesce("__s", "status"), "explanation": F.when(set_, F.coalesce(filled(F.col("__e")), default)).otherwise(F.col("explanation"))}).drop("__s", "__e")


def admission_public(admissions: DataFrame, checklist: DataFrame, staff: DataFrame, users: DataFrame) -> DataFrame:
    """Admissions with names, the doctor's place and the checklist in order of its keys."""
    items = checklist.groupBy("admission_id").agg(F.sort_array(F.collect_list(F.struct("item_key", "tier", "status", "source_document_id", "explanation"))).alias("checklist"))
    p = users.select(F.col("id").alias("patient_id"), F.col("name").alias("__p"))
    d = staff.select(F.col("id").alias("doctor_id"), F.col("name").alias("__d"), "dept", "hospital")
    met = admissions.drop("patient_name").join(items, "admission_id", "left").join(p, "patient_id", "left").join(d, "doctor_id", "left")
    return met.withColumns({"patient_name": F.coalesce("__p", F.col("patient_id").cast("string")), "doctor_name": F.coalesce("__d", F.col("doctor_id").cast("string"))}).drop("__p", "__d")


def needs_review(checklist: DataFrame, admissions: DataFrame, staff: DataFrame, users: DataFrame) -> DataFrame:
    """Items that wait for a hospital's staff: hospital (lower case), item_id, item_key, admission_id, patient_id and patient_name."""
    d = staff.select(F.col("id").alias("doctor_id"), F.lower("hospital").alias("hospital"))
    p = users.select(F.col("id").alias("patient_id"), F.col("name").alias("__p"))
    met = checklist.filter(F.col("status") == "needs_review").join(admissions.select("admission_id", "patient_id", "doctor_id"), "admission_id").join(d, "doctor_id").join(p, "patient_id", "left")
    return met.select("hospital", "item_id", "item_key", "admission_id", "patient_id", F.coalesce("__p", F.col("patient_id").cast("string")).alias("patient_name"))


def hospital_admissions(admissions: DataFrame, staff: DataFrame, status: str | None = None) -> DataFrame:
    """hospital (lower case), admission_id, status and date: those paid by default."""
    d = staff.select(F.col("id").alias("doctor_id"), F.lower("hospital").alias("hospital"))
    wanted = F.col("status") == status if status else F.col("status").isin("confirmed", "redeemed")
    return admissions.filter(wanted).join(d, "doctor_id").select("hospital", "admission_id", "status", "admission_date")


def get_or_create(requests: DataFrame, admissions: DataFrame) -> DataFrame:
    """Admissions to insert for appointments (id, time) that have none; the date is the slot's day."""
    return requests.join(admissions.select(F.col("appointment_id").alias("id")), "id", "left_anti").select(F.col("id").alias("appointment_id"), F.to_date("time").alias("admission_date"), F.lit("in_progress").alias("status"))


def mint_tokens(rows: DataFrame, taken: DataFrame, key: str = "admission_id", length: int = 8) -> DataFrame:
    """key and a token of unambiguous letters and digits, hashed from the key; one that is taken, or given to a lesser key, is minted anew from the next salt."""
    letters = F.split(F.lit(L.TOKEN_ALPHABET), "")

    def minted(salt: int) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.get(letters, F.pmod(F.xxhash64(F.col(key), F.lit(salt), i), F.lit(len(L.TOKEN_ALPHABET))).cast("int"))), "")

    left, out, used, salt = rows.select(key), None, taken.select("token"), 0
    while True:
        w = Window.partitionBy("token").orderBy(key)
        made = left.withColumn("token", minted(salt)).withColumn("__n", F.row_number().over(w))
        good = made.filter("__n = 1").drop("__n").join(used, "token", "left_anti").select(key, "token")
        good = stored(good)  # a round reads what the last one wrote and runs nothing again
        out = good if out is None else out.unionByName(good)
        left, used, salt = stored(left.join(good.select(key), key, "left_anti")), used.unionByName(good.select("token")), salt + 1
        if left.isEmpty():
            return out
