"""From raw text to classified, field-extracted, sectioned chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaultspark import lexicons as L
from vaultspark.functions.strings import exploded, first_match, is_garbage, lookup, rx, strip, tokens, without_bom, words

#: Words of a chunk, and of the sentence that the next one repeats.
CHUNK_WORDS, OVERLAP_WORDS = 384, 48
CHUNK = "array<struct<text:string,semantic_type:string>>"


def doc_type(text: str) -> Column:
    """The class of a column of texts whose keywords occur most often; the first of equals; `unknown` without any.

    One expression that names its input a hundred times: SQL text is parsed at
    once, and lower case is computed once a row.
    """
    q = "`" + text.replace("`", "``") + "`"
    quote = lambda w: "'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'"
    hits = lambda terms: " + ".join(f"(octet_length(lower({q})) - octet_length(replace(lower({q}), {quote(w)}, ''))) div {len(w.encode())}" for w in terms)
    scored = [f"named_struct('n', {hits(terms)}, 'k', {-k}, 'name', {quote(name)})" for k, (name, terms) in enumerate(L.DOC_TYPES.items())]
    none = "named_struct('n', 0L, 'k', 1, 'name', 'unknown')"  # before any class without a hit
    return F.expr(f"if({q} is null, 'unknown', array_max(array({none}, {', '.join(scored)})).name)")


def classify(docs: DataFrame, text: str = "text", to: str = "doc_type") -> DataFrame:
    return docs.withColumn(to, doc_type(text))


def visit_date(text: Column) -> Column:
    """The first numeric date, or else the first with a month's name."""
    return F.coalesce(first_match(text, rx(L.DATE_NUMERIC, "i")), first_match(text, rx(L.DATE_NAMED, "i")))


def doctor(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, rx(L.DOCTOR), 1)), F.lit(""))


def hospital(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, rx(L.HOSPITAL), 1)), F.lit(""))


def surgery(text: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(text, rx(L.SURGERY, "i"), 1)), F.lit(""))


def diagnoses(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(rx(L.DIAGNOSIS, "i")), F.lit(1)), lambda x: F.rtrim(strip(x), F.lit(".,;")))
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def drugs(text: Column, kind: Column) -> Column:
    """Names after a form word, for the classes that list drugs."""
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rx(L.DRUG, "i")), F.lit(1)), strip))
    return F.when(kind.isin(L.DRUG_DOC_TYPES), found).otherwise(F.array().cast("array<string>"))


def lab_values(text: Column, kind: Column) -> Column:
    """Names and values of a lab report as a map; the last value of a name counts."""
    pattern = F.lit(rx(L.LAB_VALUE))
    keys, values = (F.regexp_extract_all(text, pattern, F.lit(g)) for g in (1, 2))
    pairs = F.zip_with(keys, values, lambda k, v: F.struct(F.lower(strip(k)).alias("k"), strip(v).alias("v")))
    last = F.reverse(F.filter(pairs, lambda p: (F.length(p["k"]) > 3) & (p["v"] != "")))
    names = F.transform(last, lambda p: p["k"])
    once = F.filter(last, lambda p, i: F.array_position(names, p["k"]) == i + 1)
    return F.when(kind == "lab_report", F.map_from_entries(once)).otherwise(F.create_map().cast("map<string,string>"))


def extract_fields(docs: DataFrame, text: str = "text", kind: str = "doc_type") -> DataFrame:
    """Add visit_date, doctor_name, hospital, diagnosis, drugs, lab_values and surgery_type."""
    t, k = F.col(text), F.col(kind)
    return docs.withColumns({"visit_date": visit_date(t), "doctor_name": doctor(t), "hospital": hospital(t), "diagnosis": diagnoses(t), "drugs": drugs(t, k), "lab_values": lab_values(t, k), "surgery_type": surgery(t)})


def semantic_of(kind: Column) -> Column:
    return lookup(kind, L.DOC_SEMANTIC, "patient_information")


def semantic_of_header(header: Column, kind: Column) -> Column:
    """By the first key that the header holds, or else by the document's class."""
    h, found = F.regexp_replace(strip(F.lower(header)), r":+\z", ""), F
    for key, sem in L.SECTION_SEMANTIC.items():
        found = found.when(F.contains(h, F.lit(key)), sem)
    return found.otherwise(semantic_of(kind))


def sections(text: Column, header: str) -> Column:
    """Parts between header lines, each with its header (array of text, header). Short parts go; without any header, the text."""
    pattern = rx(header, "im")
    heads, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lead = F.array(F.struct(strip(F.get(parts, F.lit(0))).alias("text"), F.lit("").alias("header")))
    rest = F.zip_with(heads, F.slice(parts, 2, 1_000_000), lambda h, b: F.struct(strip(F.concat(strip(h), F.lit("\n"), strip(b))).alias("text"), strip(h).alias("header")))
    whole = F.array(F.struct(text.alias("text"), F.lit("").alias("header")))
    return F.when(F.size(heads) == 0, whole).otherwise(F.filter(F.concat(lead, rest), lambda x: F.length(x["text"]) > 20))


def sentences(text: Column) -> Column:
    """Sentences: up to a mark of their end and white space, or an empty line."""
    return F.filter(F.transform(F.split(text, rx(r"(?<=[.!?])\s+|\n\s*\n")), strip), lambda x: x != "")


def pack_sentences(text: Column, most: int = CHUNK_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Chunks of whole sentences, of at most so many words where sentences allow; a short last sentence is repeated in the next chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("now"), F.lit(0).alias("n"))

    def step(a: Column, s: Column) -> Column:
        n = F.size(words(s))
        full = (a["n"] > 0) & (a["n"] + n > most)
        last = F.get(a["now"], F.size(a["now"]) - 1)
        again = F.when(F.size(words(last)) <= overlap, F.array(last)).otherwise(F.array().cast("array<string>"))
        now = F.when(full, F.concat(again, F.array(s))).otherwise(F.concat(a["now"], F.array(s)))
        count = F.when(full, n + F.when(F.size(again) > 0, F.size(words(last))).otherwise(0)).otherwise(a["n"] + n)
        done = F.when(full, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"])
        return F.struct(done.alias("done"), now.alias("now"), count.alias("n"))

    packed = F.aggregate(sentences(text), start, step, lambda a: F.when(F.size(a["now"]) > 0, F.concat(a["done"], F.array(F.array_join(a["now"], " ")))).otherwise(a["done"]))
    return F.when(F.size(words(text)) <= most, F.when(strip(text) == "", F.array().cast("array<string>")).otherwise(F.array(text))).otherwise(packed)


def _same(texts: Column, sem: Column) -> Column:
    return F.transform(texts, lambda x: F.struct(x.alias("text"), sem.alias("semantic_type")))


def parse_sections(reply: Column, text: Column) -> Column:
    """Chunks of a model's reply in SECTION: and TEXT: lines; the whole text as follow-up notes if it has none."""
    lines = F.split(strip(reply), "\n")
    start = F.struct(F.array().cast(CHUNK).alias("done"), F.lit("follow_up_notes").alias("sem"), F.array().cast("array<string>").alias("now"))

    def shut(a: Column) -> Column:
        one = F.array(F.struct(strip(F.array_join(a["now"], "\n")).alias("text"), a["sem"].alias("semantic_type")))
        return F.when(F.size(a["now"]) > 0, F.concat(a["done"], one)).otherwise(a["done"])

    def step(a: Column, line: Column) -> Column:
        head, body = line.startswith("SECTION:"), line.startswith("TEXT:")
        sem = F.when(head, strip(F.replace(line, F.lit("SECTION:"), F.lit("")))).otherwise(a["sem"])
        now = F.when(head, F.array().cast("array<string>")).otherwise(F.concat(a["now"], F.array(F.when(body, strip(F.replace(line, F.lit("TEXT:"), F.lit("")))).otherwise(line))))
        return F.struct(F.when(head, shut(a)).otherwise(a["done"]).alias("done"), sem.alias("sem"), now.alias("now"))

    found = F.filter(F.aggregate(lines, start, step, shut), lambda x: strip(x["text"]) != "")
    single = F.array(F.struct(strip(text).alias("text"), F.lit("follow_up_notes").alias("semantic_type")))
    return F.when(reply.isNotNull() & (F.size(found) > 0), found).otherwise(single)


def chunks(text: Column, kind: Column, method: Column | None = None, reply: Column | None = None) -> Column:
    """The chunks of a document by its class. reply: a model's split of a handwritten note of unknown class."""
    t = strip(text)

    def one(x: Column, sem: str) -> Column:
        return F.struct(x.alias("text"), F.lit(sem).alias("semantic_type"))

    parts, groups = sections(text, L.SECTION_HEADER), sections(text, L.LAB_HEADER)

    def section(s: Column) -> Column:
        sem = semantic_of_header(s["header"], kind)
        return F.when(F.length(s["text"]) > 4 * CHUNK_WORDS, _same(pack_sentences(s["text"]), sem)).otherwise(F.array(F.struct(s["text"].alias("text"), sem.alias("semantic_type"))))

    findings = first_match(text, rx(r"findings[:\s]+(.*?)(?=impression|\z)", "is"))
    impression = first_match(text, rx(r"impression[:\s]+(.*?)\z", "is"))
    scan = F.filter(F.array(one(strip(findings), "lab_reports"), one(strip(impression), "diagnosis")), lambda x: x["text"].isNotNull())
    verdict = first_match(text, rx(r"(?:diagnosis|conclusion)[:\s]+(.*?)\z", "is"))
    before = F.substring(text, F.lit(1), F.length(text) - F.length(verdict))
    rest = _same(pack_sentences(text), semantic_of(kind))
    out = F.when(kind == "prescription", F.array(one(t, "medication_history"))).when(kind == "operative_notes", F.array(one(t, "surgical_history")))
    if method is not None:
        out = out.when((method == "gemini") & (kind == "unknown"), parse_sections(reply if reply is not None else F.lit(None).cast("string"), text))
    out = out.when((kind == "discharge_summary") & (F.size(parts) > 1), F.flatten(F.transform(parts, section)))
    out = out.when((kind == "lab_report") & (F.size(groups) > 1), F.transform(groups, lambda g: one(g["text"], "lab_reports")))
    out = out.when((kind == "imaging_report") & (F.size(scan) > 0), scan)
    out = out.when((kind == "biopsy_report") & verdict.isNotNull(), F.array(one(strip(before), "surgical_history"), one(strip(verdict), "diagnosis")))
    return out.otherwise(rest)


def chunk_id(patient: Column, path: Column, index: Column, prefix: str = "") -> Column:
    """A stable key; images have the prefix `scan`."""
    return F.md5(F.concat_ws("::", *([F.lit(prefix)] if prefix else []), patient, path, index.cast("string")))


def explode_chunks(docs: DataFrame, text: str = "text", kind: str = "doc_type", patient: str = "patient_id", path: str = "file_path") -> DataFrame:
    """A row per chunk that is not blank: chunk_id, chunk_index (with gaps for blanks), total_chunks, semantic_type and its text, beside the document's columns."""
    each = docs.withColumn("__c", chunks(F.col(text), F.col(kind)))
    rows = exploded(each.withColumn("total_chunks", F.size("__c")), "__c", "chunk_index", "__x")
    rows = rows.withColumns({"text": F.col("__x.text"), "semantic_type": F.col("__x.semantic_type"), "chunk_id": chunk_id(F.col(patient), F.col(path), F.col("chunk_index"))})
    return rows.filter(strip(F.col("text")) != "").drop("__c", "__x")


def choose_extraction(candidates: DataFrame) -> DataFrame:
    """The text and method out of a file's candidates: suffix, plain_text, layer_text, ocr_text, ocr_confidence, vision_text.

    Plain text first; then a PDF's text layer if it has 50 characters and a
    class; then OCR that is long, confident and not garbage; then vision if it
    is better. A layer without a class still beats OCR that has none either
    and is not longer.
    """
    n = lambda c: F.length(strip(F.coalesce(F.col(c), F.lit(""))))
    pick = lambda text, method: F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(method).alias("method"))
    layer, ocr, vision = F.col("layer_text"), F.col("ocr_text"), F.col("vision_text")
    digital = (F.lower("suffix") == ".pdf") & (n("layer_text") >= 50)
    scanned = (
        F.when(n("ocr_text") < 30, F.when(n("vision_text") >= 50, pick(vision, "gemini")).otherwise(pick(ocr, "doctr_fallback")))
        .when((F.col("ocr_confidence") >= 0.80) & ~is_garbage(ocr), pick(ocr, "doctr"))
        .when(n("vision_text") > n("ocr_text"), pick(vision, "gemini"))
        .otherwise(pick(ocr, "doctr_fallback"))
    )
    candidates = candidates.withColumns({"__layer_type": doc_type("layer_text"), "__s": scanned}).withColumn("__scanned", F.col("__s.text"))
    scanned, layer_type = F.col("__s"), F.col("__layer_type")
    better = (doc_type("__scanned") != "unknown") | (F.length(strip(F.col("__scanned"))) > n("layer_text"))
    chosen = (
        F.when(F.lower("suffix").isin(".txt", ".md", ".text"), pick(F.col("plain_text"), "plaintext"))
        .when(digital & (layer_type != "unknown"), pick(layer, "pymupdf"))
        .when(digital & ~better, pick(layer, "pymupdf"))
        .otherwise(scanned)
    )
    return candidates.withColumn("__p", chosen).withColumns({"text": without_bom(F.col("__p.text")), "extraction_method": F.col("__p.method")}).drop("__p", "__s", "__scanned", "__layer_type")


def ingest(docs: DataFrame) -> DataFrame:
    """The whole way from (patient_id, file_name, file_path, text, extraction_method) to chunks with fields."""
    return explode_chunks(extract_fields(classify(docs)))


def token_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_tokens, n_distinct and n_words."""
    t = tokens(F.col(text))
    return docs.withColumns({"n_tokens": F.size(t).cast("long"), "n_distinct": F.size(F.array_distinct(t)).cast("long"), "n_words": F.size(words(F.col(text))).cast("long")})


