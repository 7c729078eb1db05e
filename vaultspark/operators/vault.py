"""What a patient's documents say, over all patients at once.

Input: a row per chunk with patient_id, file_name, chunk_index, text and the
extracted fields. Of rows for one document the first chunk's fields count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark.functions.strings import allergens, exploded, lookup, year

UNKNOWN_YEAR = "Unknown Year"
#: Groups of a vault page, in the two orders that it is shown in (fixed values).
GROUP_ORDERS = {
    "clinical": ["diagnosis", "medication_history", "lab_reports", "surgical_history", "follow_up_notes", "patient_information"],
    "all": ["patient_information", "diagnosis", "medication_history", "lab_reports", "surgical_history", "follow_up_notes"],
}


def first_of(rows: DataFrame, by: list, order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__n = 1").drop("__n")


def timeline(chunks: DataFrame) -> DataFrame:
    """An event per file: year, date, event, doctor, hospital, source and its place; known years first, then by raw date, then by file."""
    one = first_of(chunks, ["patient_id", "file_name"], ["chunk_index", "chunk_id"])
    parts = F.array_compact(F.array(
        F.when(F.size("diagnosis") > 0, F.concat(F.lit("Diagnosed: "), F.array_join("diagnosis", ", "))),
        F.when(F.col("surgery_type").isNotNull(), F.concat(F.lit("Surgery: "), "surgery_type")),
        F.when(F.size("drugs") > 0, F.concat(F.lit("Medications: "), F.array_join(F.slice("drugs", 1, 3), ", "))),
    ))
    plain = F.concat(F.initcap(F.replace("doc_type", F.lit("_"), F.lit(" "))), F.lit(" on file"))
    y = year(F.col("visit_date"))
    events = one.select("patient_id", F.coalesce(y, F.lit(UNKNOWN_YEAR)).alias("year"), F.col("visit_date").alias("date"), F.when(F.size(parts) > 0, F.array_join(parts, " | ")).otherwise(plain).alias("event"), F.col("doctor_name").alias("doctor"), "hospital", F.col("file_name").alias("source"))
    order = Window.partitionBy("patient_id").orderBy(F.col("year") == UNKNOWN_YEAR, F.when(F.col("year") != UNKNOWN_YEAR, F.col("year")), F.coalesce("date", F.lit("")), "source")
    return events.withColumn("place", F.row_number().over(order))


def timeline_text(events: DataFrame) -> DataFrame:
    """patient_id and the timeline as text, with a header at each new year."""
    w = Window.partitionBy("patient_id").orderBy("place")
    y, nl = F.col("year"), F.lit("\n")
    head = F.when(F.lag("year").over(w).eqNullSafe(y), F.lit("")).otherwise(F.concat(nl, y, nl, F.repeat(F.lit("-"), F.length(y)), nl))
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(nl, F.lit(f"    {label}: "), c)).otherwise("")
    date = F.when(F.col("date").isNotNull() & (F.col("date") != y), F.concat(nl, F.lit("    Date: "), "date")).otherwise("")
    body = F.concat(F.lit("  • "), "event", line("Doctor", "doctor"), line("Hospital", "hospital"), date, nl, F.lit("    Source: "), "source")
    lines = events.withColumn("__t", F.concat(head, body)).groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct("place", "__t"))).alias("l"), F.count(F.lit(1)).alias("n"))
    top = F.concat(F.lit("Medical Timeline — "), F.col("patient_id").cast("string"), nl, F.lit("=" * 50), F.lit("\n\n"))
    return lines.select("patient_id", F.concat(top, F.array_join(F.transform("l", lambda x: x["__t"]), "\n"), F.lit("\n\n["), F.col("n").cast("string"), F.lit(" event(s) found]")).alias("answer"))


def medications(chunks: DataFrame) -> DataFrame:
    """name, source and date, once per name (case aside) and file."""
    each = exploded(chunks.select("patient_id", "file_name", "chunk_index", "chunk_id", F.col("visit_date").alias("date"), "drugs"), "drugs", "at", "name")
    return first_of(each, ["patient_id", F.lower("name"), "file_name"], ["chunk_index", "chunk_id", "at"]).select("patient_id", "name", F.col("file_name").alias("source"), "date")


def allergies(chunks: DataFrame) -> DataFrame:
    """allergen, source and date, once per name (case aside) and file."""
    each = exploded(chunks.select("patient_id", "file_name", "chunk_index", "chunk_id", F.col("visit_date").alias("date"), allergens(F.col("text")).alias("named")), "named", "at", "allergen")
    return first_of(each, ["patient_id", F.lower("allergen"), "file_name"], ["chunk_index", "chunk_id", "at"]).select("patient_id", "allergen", F.col("file_name").alias("source"), "date")


def surgeries(chunks: DataFrame) -> DataFrame:
    """procedure, doctor, hospital, date and source, once per procedure (case aside) and file."""
    each = chunks.filter(F.col("surgery_type").isNotNull())
    one = first_of(each, ["patient_id", F.lower("surgery_type"), "file_name"], ["chunk_index", "chunk_id"])
    return one.select("patient_id", F.col("surgery_type").alias("procedure"), F.col("doctor_name").alias("doctor"), "hospital", F.col("visit_date").alias("date"), F.col("file_name").alias("source"))


def _all(c: Column) -> Column:
    """The distinct elements of a group's arrays, sorted: merged per partition as sets before the shuffle."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))


def summary(chunks: DataFrame) -> DataFrame:
    """Sorted sets of allergies, medications, diagnoses, surgeries, doctors and hospitals; the greatest raw date as text; distinct files."""
    one = lambda c: F.array_sort(F.collect_set(c))
    return chunks.withColumn("__a", allergens(F.col("text"))).groupBy("patient_id").agg(
        _all(F.col("__a")).alias("allergies"), _all(F.col("drugs")).alias("medications"), _all(F.col("diagnosis")).alias("diagnoses"),
        one("surgery_type").alias("surgeries"), one("doctor_name").alias("doctors"), one("hospital").alias("hospitals"),
        F.max("visit_date").alias("latest_visit"), F.count_distinct(F.coalesce("file_name", F.lit("unknown"))).alias("document_count"),
    )


def _bulleted(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("  • "), x)), "\n")).otherwise("  None on record")


def summary_text(totals: DataFrame) -> DataFrame:
    """patient_id and the summary as a form."""
    c = F.col
    pieces = [F.concat(F.lit("Admission Summary — "), c("patient_id").cast("string")), F.lit("=" * 50), F.concat(F.lit("Documents on file: "), c("document_count").cast("string")), F.concat(F.lit("Latest visit: "), F.coalesce(c("latest_visit"), F.lit("Unknown")))]
    for title, items in (("ALLERGIES:", "allergies"), ("CURRENT MEDICATIONS:", "medications"), ("DIAGNOSES / CONDITIONS:", "diagnoses"), ("SURGICAL HISTORY:", "surgeries"), ("TREATING DOCTORS:", "doctors"), ("HOSPITALS:", "hospitals")):
        pieces += [F.lit(""), F.lit(title), _bulleted(c(items))]
    empty = (F.size("diagnoses") == 0) & (F.size("medications") == 0)
    return totals.select("patient_id", F.when(empty, "No records found to generate an admission summary.").otherwise(F.concat_ws("\n", *pieces)).alias("answer"))


def list_text(rows: DataFrame, title: str, total: str, line: Column, order: list[Column], width: int = 40) -> DataFrame:
    """patient_id and the rows as lines under a title and their number."""
    listed = rows.groupBy("patient_id").agg(F.sort_array(F.collect_list(F.struct(*(o.alias(f"o{k}") for k, o in enumerate(order)), line.alias("t")))).alias("l"))
    head = F.concat(F.lit(f"{title} — "), F.col("patient_id").cast("string"), F.lit("\n" + "=" * width + f"\n{total}: "), F.size("l").cast("string"), F.lit("\n\n"))
    return listed.select("patient_id", F.concat(head, F.array_join(F.transform("l", lambda x: x["t"]), "\n")).alias("answer"))


def _dated(name: Column, mark: str) -> Column:
    return F.concat(F.lit(f"  {mark} "), name, F.when(F.col("date").isNotNull(), F.concat(F.lit("  ["), "date", F.lit("]"))).otherwise(""), F.lit("  (from: "), "source", F.lit(")"))


def medications_text(rows: DataFrame) -> DataFrame:
    return list_text(rows, "Medications", "Total", _dated(F.col("name"), "•"), [F.coalesce("date", F.lit("")), F.col("name"), F.col("source")])


def allergies_text(rows: DataFrame) -> DataFrame:
    return list_text(rows, "Allergies", "Total", _dated(F.col("allergen"), "⚠"), [F.col("allergen"), F.col("source")])


def surgeries_text(rows: DataFrame) -> DataFrame:
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n    {label}: "), c)).otherwise("")
    body = F.concat(F.lit("  • "), "procedure", line("Date", "date"), line("Surgeon", "doctor"), line("Hospital", "hospital"), line("Source", "source"))
    return list_text(rows, "Surgical History", "Total procedures", body, [F.coalesce("date", F.lit("")), F.col("procedure"), F.col("source")])


def inspect(chunks: DataFrame) -> DataFrame:
    """Per file: chunks, the first chunk's class and method, and a histogram of semantic types as text."""
    counts = chunks.groupBy("patient_id", "file_name", "semantic_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk_index", "chunk_id", "doc_type")).alias("f"))
    per = counts.groupBy("patient_id", "file_name").agg(F.sum("n").alias("n_chunks"), F.min("f").alias("f"), F.sort_array(F.collect_list(F.concat_ws("=", "semantic_type", F.col("n").cast("string")))).alias("h"))
    return per.select("patient_id", "file_name", "n_chunks", F.col("f.doc_type").alias("doc_type"), F.array_join("h", ",").alias("semantic_counts"))


def groups(chunks: DataFrame, order: str = "clinical") -> DataFrame:
    """Files per semantic type, in one of the fixed orders; other types are left out."""
    place = {s: k + 1 for k, s in enumerate(GROUP_ORDERS[order])}
    per = chunks.filter(F.col("semantic_type").isin(list(place))).groupBy("patient_id", "semantic_type").agg(F.count_distinct("file_name").alias("n_files"))
    return per.withColumn("group_order", lookup(F.col("semantic_type"), place, 0))


def headers(documents: DataFrame) -> DataFrame:
    """The list of documents as it is shown: id, name, doc_type, semantic_type (of the register, by class), uploaded_by and the day of uploaded_at."""
    return documents.select("patient_id", "id", F.col("file_name").alias("name"), "doc_type", lookup(F.col("doc_type"), L.REGISTER_SEMANTIC, "patient_information").alias("semantic_type"), "uploaded_by", F.substring(F.coalesce("uploaded_at", F.lit("")), 1, 10).alias("date"))


def dashboard(headers_: DataFrame, appointments: DataFrame) -> DataFrame:
    """Each patient's numbers of documents, of those on medication, and of appointments."""
    docs = headers_.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("semantic_type") == "medication_history").alias("n_medication"))
    met = docs.join(appointments.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_appointments")), "patient_id", "full")
    return met.select("patient_id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_documents", "n_medication", "n_appointments")))


def dispatch(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, route and confidence. routed: question_id, patient_id, route.

    A structured agent that has nothing on a patient gives way to retrieval;
    its answer's confidence is the fixed one, of an empty-looking answer the
    lower (an admission summary without diagnoses and medications says that it
    has no records even if allergies are known).
    """
    has = summary(chunks).select("patient_id", *((F.size(c) > 0).alias(c) for c in ("allergies", "medications", "diagnoses", "surgeries")), (F.col("document_count") > 0).alias("events"))
    met = routed.join(has, "patient_id", "left")
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    found = (
        F.when(F.col("route") == "timeline_agent", on("events")).when(F.col("route") == "admission_agent", on("diagnoses") | on("medications") | on("allergies") | on("surgeries"))
        .when(F.col("route") == "medication_agent", on("medications")).when(F.col("route") == "allergy_agent", on("allergies")).when(F.col("route") == "surgery_agent", on("surgeries")).otherwise(F.lit(True))
    )
    low = (F.col("route") == "admission_agent") & ~on("diagnoses") & ~on("medications")
    structured = (F.col("route") != L.DEFAULT_ROUTE) & found
    route = F.when(found, F.col("route")).otherwise(F.concat("route", F.lit("->rag_fallback")))
    return met.select("question_id", "patient_id", route.alias("route"), F.when(structured, F.when(low, 40.0).otherwise(85.0)).alias("confidence"))
