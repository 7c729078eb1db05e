"""Word lists, patterns and tables that results depend on.

Everything in this module is a fixed value: lists keep their order, since ties
go to the first. Patterns are written for Java; (?U) gives \\w, \\s and \\b
their Unicode meaning and (?d) leaves \\n as the only line end.
"""

# -- fixed values: document classes and their keywords, in order ---------------------
DOC_TYPES = {
    "prescription": ["rx", "prescribed", "prescription", "tablet", "capsule", "syrup", "once daily", "twice daily", "sos", "tab.", "cap.", "mg", "ml", "pharmacy"],
    "discharge_summary": ["discharge summary", "discharged", "date of admission", "date of discharge", "diagnosis at discharge", "hospital course", "inpatient"],
    "lab_report": ["haemoglobin", "hemoglobin", "platelet", "wbc", "rbc", "creatinine", "urea", "sodium", "potassium", "glucose", "hba1c", "tsh", "liver function", "renal function", "lipid profile", "cbc", "complete blood count", "reference range", "normal range"],
    "biopsy_report": ["biopsy", "histopathology", "histology", "specimen", "microscopy", "gross examination", "microscopic", "section shows", "malignant", "benign", "carcinoma", "pathology"],
    "imaging_report": ["mri", "ct scan", "x-ray", "ultrasound", "usg", "pet scan", "impression:", "findings:", "technique:", "contrast", "radiologist"],
    "operative_notes": ["operative notes", "operation notes", "procedure:", "incision", "anaesthesia", "anesthesia", "surgeon", "intraoperative", "hemostasis"],
    "insurance": ["insurance", "policy number", "claim", "tpa", "mediclaim", "pre-authorization", "cashless", "reimbursement"],
    "identity_proof": ["aadhaar", "aadhar", "unique identification authority", "uidai", "permanent account number", "income tax department", "election commission", "voter id", "epic no", "passport no", "republic of india", "government of india", "date of birth", "father's name"],
}
#: Semantic type of a document class; the last two are known to the document register only.
DOC_SEMANTIC = {
    "prescription": "medication_history", "discharge_summary": "patient_information", "lab_report": "lab_reports", "biopsy_report": "surgical_history", "imaging_report": "lab_reports",
    "operative_notes": "surgical_history", "insurance": "patient_information", "identity_proof": "patient_information", "unknown": "patient_information",
}
REGISTER_SEMANTIC = {**DOC_SEMANTIC, "imaging_scan": "lab_reports", "admission_intake": "patient_information"}
#: Semantic type of the first key that a section header holds.
SECTION_SEMANTIC = {
    "history": "patient_information", "chief complaint": "patient_information", "hpi": "patient_information", "past medical history": "patient_information",
    "diagnosis": "diagnosis", "impression": "diagnosis", "discharge diagnosis": "diagnosis",
    "medications on discharge": "medication_history", "discharge medications": "medication_history", "medication": "medication_history", "drugs given": "medication_history",
    "plan": "follow_up_notes", "follow up": "follow_up_notes", "instructions": "follow_up_notes", "advice": "follow_up_notes",
    "investigations": "lab_reports", "labs": "lab_reports", "reports": "lab_reports",
    "procedure": "surgical_history", "operation": "surgical_history", "hospital course": "patient_information",
}
SECTION_HEADER = r"^\s*(?:history|chief complaint|hpi|past medical history|diagnosis|impression|discharge diagnosis|medications on discharge|discharge medications|medication|drugs given|plan|follow.?up|instructions|advice|investigations|labs?|reports?|procedure|operation|hospital course)\s*[:\-]?\s*$"
LAB_HEADER = r"^\s*(?:CBC|complete blood count|liver function|lft|renal function|rft|lipid profile|thyroid|blood glucose|urine|coagulation|serology)\s*[:\-]?\s*$"

# -- fixed values: field patterns ----------------------------------------------------
DATE_NUMERIC = r"\b(\d{1,2})[\-/\.](\d{1,2})[\-/\.](\d{2,4})\b"
DATE_NAMED = r"\b(\d{1,2})\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{4})\b"
DRUG = r"\b(?:tab|cap|inj|syp|syr|susp|oint|gel|drops?)\.?\s+([A-Za-z][\w\-]+(?:\s+\d+\s*mg)?)"
DOCTOR = r"\bDr\.?\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
HOSPITAL = r"\b([A-Z][\w\s]+(?:Hospital|Medical|Clinic|Centre|Center|Institute)[\w\s]*)\b"
DIAGNOSIS = r"(?:diagnosis|impression|final diagnosis|assessment)[:\s]+([^\n]{5,120})"
LAB_VALUE = r"([A-Za-z][\w\s]{2,30}?)\s*[:\-]\s*([\d\.]+\s*(?:g/dL|mg/dL|mmol/L|U/L|%|lakh|/uL|IU/L)?)"
SURGERY = r"(?:procedure|operation|surgery)\s*[:\-]\s*([^\n]{5,80})"
DRUG_DOC_TYPES = ["prescription", "discharge_summary", "operative_notes"]
ALLERGY = r"(?:allerg(?:ic|y|ies)\s+to|hypersensitive\s+to|intolerant\s+to|known\s+allerg(?:y|ies)[:\s]+|NKDA|no\s+known\s+drug\s+allergies)(?:[:\s]+)?([\w\s,/\-]+?)(?:\.|,\s+(?:and\s+)?(?:[A-Z]|\d)|$)"
NO_ALLERGY = r"\b(?:NKDA|no\s+known\s+drug\s+allerg(?:y|ies))\b"
NO_ALLERGY_LABEL = "NKDA (No Known Drug Allergies)"
YEAR = r"\b(?:19|20)\d{2}\b"

# -- fixed values: identity numbers and insurance ------------------------------------
NATIONAL_ID = r"\b\d{4}\s?\d{4}\s?\d{4}\b"
TAX_ID = r"\b[A-Z]{5}\d{4}[A-Z]\b"
VOTER_ID = r"\b[A-Z]{3}\d{7}\b"
PASSPORT = r"\b[A-Z][1-9]\d{5}[1-9]\b"
TAX_HOLDERS = "CPHFATBLJG"
REGISTRATION = r"reg(?:istration|d)?\.?\s*no\.?\s*[:\-]?\s*[A-Za-z0-9/\-]{3,}"
INSURERS = ["star health", "hdfc ergo", "icici lombard", "niva bupa", "max bupa", "care health", "religare", "bajaj allianz", "new india assurance", "national insurance", "tata aig", "united india", "oriental insurance", "sbi health", "aditya birla health"]
POLICY_MARKERS = ["sum insured", "sum assured", "tpa", "irdai", "irda"]

# -- fixed values: questions ---------------------------------------------------------
CHARACTER_FIXES = [("0", "o"), ("3", "e"), ("1", "i"), ("5", "s"), ("8", "b"), ("@", "a")]
ABBREVIATIONS = [
    ("hba1c", "HbA1c glycated hemoglobin"), ("bp", "blood pressure"), ("hr", "heart rate"), ("rr", "respiratory rate"), ("spo2", "oxygen saturation"), ("dm", "diabetes mellitus"), ("htn", "hypertension"),
    ("cad", "coronary artery disease"), ("copd", "chronic obstructive pulmonary disease"), ("ckd", "chronic kidney disease"), ("cbc", "complete blood count"), ("lft", "liver function test"), ("rft", "renal function test"),
    ("tsh", "thyroid stimulating hormone"), ("ecg", "electrocardiogram"), ("ekg", "electrocardiogram"), ("usg", "ultrasound"), ("uti", "urinary tract infection"), ("urti", "upper respiratory tract infection"), ("lrti", "lower respiratory tract infection"),
    ("mi", "myocardial infarction"), ("icu", "intensive care unit"), ("od", "once daily"), ("bd", "twice daily"), ("tds", "three times daily"), ("qid", "four times daily"), ("sos", "as needed"), ("op", "outpatient"), ("ip", "inpatient"), ("prn", "as needed"),
    ("iv", "intravenous"), ("im", "intramuscular"), ("sc", "subcutaneous"), ("rbs", "random blood sugar"), ("fbs", "fasting blood sugar"), ("ppbs", "postprandial blood sugar"), ("echo", "echocardiogram"), ("efef", "ejection fraction"), ("ivf", "intravenous fluids"), ("nsr", "normal sinus rhythm"),
]
VOCABULARY = [
    "diabetes", "hypertension", "pneumonia", "tuberculosis", "malaria", "typhoid", "appendicitis", "cholecystitis", "pancreatitis", "hepatitis", "cirrhosis", "nephritis", "pyelonephritis", "anemia", "leukemia", "lymphoma", "carcinoma",
    "infarction", "angina", "arrhythmia", "atherosclerosis", "thrombosis", "embolism", "hemorrhage", "fracture", "osteoporosis", "arthritis", "asthma", "bronchitis", "emphysema", "pleuritis", "peritonitis", "hypertensive", "diabetic", "cardiac",
    "renal", "hepatic", "pulmonary", "coronary", "cerebral", "vascular", "surgical", "chronic", "acute",
    "metformin", "insulin", "glipizide", "glimepiride", "sitagliptin", "amlodipine", "atenolol", "metoprolol", "lisinopril", "ramipril", "atorvastatin", "rosuvastatin", "aspirin", "clopidogrel", "warfarin", "amoxicillin", "azithromycin",
    "ciprofloxacin", "metronidazole", "omeprazole", "pantoprazole", "ranitidine", "paracetamol", "ibuprofen", "tramadol", "morphine", "prednisolone", "dexamethasone", "furosemide", "spironolactone", "hydrochlorothiazide", "digoxin",
    "amiodarone", "salbutamol", "ipratropium", "budesonide", "fluticasone",
    "hemoglobin", "hematocrit", "leukocyte", "erythrocyte", "platelet", "creatinine", "urea", "sodium", "potassium", "chloride", "bicarbonate", "glucose", "cholesterol", "triglycerides", "albumin", "bilirubin", "alanine", "aspartate", "alkaline",
    "phosphatase", "amylase", "lipase", "hemoglobin", "hematocrit", "neutrophil", "lymphocyte", "eosinophil",
    "appendectomy", "cholecystectomy", "laparoscopy", "laparotomy", "colonoscopy", "endoscopy", "bronchoscopy", "catheterization", "angioplasty", "bypass", "hemodialysis", "biopsy", "mastectomy", "prescription", "discharge", "diagnosis",
    "medication", "surgery", "treatment", "admission", "investigation", "laboratory", "radiology", "allergies", "allergy", "symptoms", "history", "examination",
]
#: Classes of questions, first match wins, with their route.
ROUTES = [
    ("ALLERGY_QUERY", "allergy_agent", ["allerg", "allergic", "intoleran", "reaction", "rash", "anaphyl", "hypersensitiv", "contraindicated"]),
    ("SURGERY_QUERY", "surgery_agent", ["surgery", "surgeries", "surgical", "operation", "operated", "procedure", "appendectomy", "cholecystectomy", "laparoscop", "bypass", "transplant", "removal", "resection", "amputation", "catheteriz", "angioplasty", "stent", "incision"]),
    ("MEDICATION_QUERY", "medication_agent", ["medication", "medicine", "drug", "drugs", "tablet", "capsule", "prescription", "prescribed", "dose", "dosage", "mg", "ml", "taking", "currently on", "pharma", "pills", "pill"]),
    ("ADMISSION_QUERY", "admission_agent", ["admission", "admit", "intake", "hospital form", "discharge summary", "admit me", "admitting", "check in", "check-in", "hospitaliz"]),
    ("TIMELINE_QUERY", "timeline_agent", ["timeline", "history", "chronolog", "year", "years", "over time", "past", "progression", "journey", "records over", "when did", "first time", "previous", "sequence", "dates"]),
]
DEFAULT_CLASS, DEFAULT_ROUTE = "RAG_QUERY", "rag_agent"

# -- fixed values: retrieval ---------------------------------------------------------
TOP_CANDIDATES, TOP_FINAL, RRF_K, CONTEXT_CHARS = 20, 5, 60, 6000
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
CONFIDENCE_HIGH, CONFIDENCE_MEDIUM = 75, 50

# -- fixed values: workflow ----------------------------------------------------------
CONSULT_MINUTES, OTHER_MINUTES, CHECKIN_MINUTES = {"follow_up": 10, "new": 20, "admission": 30}, 15, 30
STAFF_ROLES = ["tpa", "lab", "admin"]
PREAUTH_FIELDS = ["policy_number", "sum_insured", "estimated_cost", "diagnosis", "length_of_stay", "room_category"]
MEDICAL_DOC_TYPES = ["prescription", "discharge_summary", "operative_notes"]
PAN_COST = 100_000
TOKEN_ALPHABET = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789"
UNAVAILABLE = "Could not complete an automatic check right now — a hospital staff member will review this shortly."

#: Explanations of checklist results (fixed values).
MESSAGES = {
    "identity_absent": "No identity document uploaded yet",
    "national_ok": "Identity document recognized (Aadhaar checksum valid)",
    "national_bad": "Aadhaar number format matched but failed the standard Verhoeff checksum validation — could be an OCR digit error or a fabricated number.",
    "tax_ok": "Identity document recognized (PAN format valid)",
    "tax_bad": "PAN format matched but the entity-type character (4th letter) is not a valid PAN holder type — could be an OCR error or a fabricated number.",
    "identity_ok": "Identity document recognized",
    "identity_unknown": "No recognized ID number format (Aadhaar/PAN/Voter ID/passport) found in the document.",
    "classified": "Classified as ",
    "registered": " — doctor registration number present",
    "unregistered": ", but no doctor registration number was found anywhere in the document — Indian medical regulations require this on every prescription.",
    "fields_missing": "Missing fields: ",
    "form_ok": "All pre-authorization fields completed",
    "card_ok": "PAN number pattern found",
    "card_absent": "No PAN card detected — required since estimated cost is ₹1 lakh or more",
    "employee_absent": "No employee ID uploaded yet",
    "employee_ok": "Employee ID document uploaded",
    "name_no_document": "No identity document to check the name against",
    "name_unknown": "Patient name not on record",
    "name_ok": "Name on the document matches the patient's registered name",
    "policy_no_document": "No insurance document to cross-check yet",
    "policy_unknown": "Enter your policy number in the pre-authorization form so it can be cross-checked against the document",
    "policy_ok": "Policy number on the document matches the form",
    "diagnosis_absent": "Need both a medical document and a stated admission reason to compare",
    "diagnosis_ok": "Stated reason matches the document's diagnosis text",
    "resolved": "Verified by hospital admin",
    "rejected": "There seems to be a problem with this document — please re-upload it.",
}

# -- fixed values: images ------------------------------------------------------------
MODALITIES = [
    (r"\b(?:chest|cxr|xray|x[\-_\s]ray)\b", "chest_xray"), (r"\b(?:ct|computed[\-_]tomography|ctscan)\b", "ct_scan"), (r"\b(?:mri|magnetic[\-_]resonance|flair|dwi)\b", "mri"),
    (r"\b(?:usg|ultrasound|sonography|sono)\b", "ultrasound"), (r"\b(?:pet|positron)\b", "pet_scan"), (r"\b(?:mammo|mammogram|mammography)\b", "mammogram"), (r"\b(?:dexa|bone[\-_]density)\b", "bone_density"),
]
CHEST_PHRASES = [
    "no acute cardiopulmonary abnormality", "normal chest radiograph", "pneumonia with consolidation", "lobar consolidation", "pleural effusion", "pneumothorax", "tension pneumothorax", "cardiomegaly", "pulmonary edema", "pulmonary nodule", "pulmonary mass",
    "atelectasis", "emphysema", "interstitial lung disease", "mediastinal widening", "pleural thickening", "rib fracture", "lung hyperinflation", "hilar lymphadenopathy", "air space opacity", "reticulonodular pattern", "cavitary lesion",
]
NORMAL_PHRASES, ABNORMAL_SCORE = ["no acute cardiopulmonary abnormality", "normal chest radiograph"], 0.22
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".tiff"]
BANDS = [(0.90, "high"), (0.80, "medium_high"), (0.60, "medium")]
ARMS = {
    "high": [], "medium_high": ["grayscale_only", "clahe_only"], "medium": ["clahe_only", "deskew_only", "moderate"],
    "low": ["clahe_only", "deskew_only", "moderate", "low_quality_pipeline", "mobile_capture"],
}
DESKEW_AT, CROP_BELOW = 3.0, 0.50
SHARP_MIN, NOISE_HIGH, CONTRAST_LOW, SKEW_TRIVIAL, SKEW_MODERATE, OCCUPANCY_LOW, OCCUPANCY_MODERATE = 80.0, 0.15, 0.15, 1.0, 3.0, 0.30, 0.50
DIGITAL = {"sharpness": 500.0, "contrast": 0.20, "noise": 0.06, "occupancy": 0.80}
HANDWRITING = {"score": 0.78, "component": 0.55, "stroke": 0.45}
DENOISE_MIN, CLAHE_MAX, BLUR_MAX, THRESHOLD_MAX, BLUR_SPAN = 0.055, 0.30, 120.0, 0.28, 600.0
#: Steps of each preset in the order that they run, each with its parameters; every preset converts to gray first.
PRESETS = {
    "digital_pdf": {},
    "grayscale_only": {},
    "auto_adaptive": {},
    "deskew_only": {"deskew": {}},
    "clahe_only": {"clahe": {"clip_limit": 1.5, "tile_grid": 8}},
    "crop_only": {"perspective": {}},
    "clean_scan": {"deskew": {}, "clahe": {"clip_limit": 1.5, "tile_grid": 8}},
    "tilted_scan": {"perspective": {}, "deskew": {}, "clahe": {"clip_limit": 1.5, "tile_grid": 8}, "border": {"fraction": 0.005}},
    "lab_report": {"deskew": {}, "clahe": {"clip_limit": 1.5, "tile_grid": 8}},
    "prescription": {"deskew": {}, "denoise": {"h": 5.0, "template_size": 7, "search_size": 21}, "handwriting": {"dilate_kernel": 2}, "clahe": {"clip_limit": 2.5, "tile_grid": 8}},
    "discharge_summary": {"deskew": {}, "clahe": {"clip_limit": 1.8, "tile_grid": 8}},
    "handwritten": {"deskew": {}, "denoise": {"h": 5.0, "template_size": 7, "search_size": 21}, "handwriting": {"dilate_kernel": 2}, "clahe": {"clip_limit": 3.0, "tile_grid": 8}, "border": {"fraction": 0.01}},
    "low_quality_scan": {"deskew": {}, "denoise": {"h": 9.0, "template_size": 7, "search_size": 21}, "clahe": {"clip_limit": 2.5, "tile_grid": 8}, "sharpen": {"amount": 0.4}, "threshold": {"block_size": 21, "c": 8}, "border": {"fraction": 0.01}},
    "mobile_capture": {"perspective": {}, "deskew": {}, "denoise": {"h": 7.0, "template_size": 7, "search_size": 21}, "clahe": {"clip_limit": 3.0, "tile_grid": 8}, "blur_recovery": {"strength": 0.5}, "threshold": {"block_size": 25, "c": 10}, "border": {"fraction": 0.01}},
}

# -- prompts: our own wording; only the keys, the mark ABNORMAL: and the reply formats are fixed values
SCAN_PROMPTS = {
    "chest_xray": "Describe this chest radiograph under the heads TECHNICAL, CARDIAC, LUNGS, BONES, SOFT TISSUES and IMPRESSION.",
    "ct_scan": "Describe this CT slice: region, plane, organs, densities, calcifications and collections.",
    "mri": "Describe this MR image: region, likely sequence, signal of each structure, focal lesions and asymmetry.",
    "ultrasound": "Describe this ultrasound image: organ, echogenicity, masses, cysts, fluid and visible measures.",
    "pet_scan": "Describe this PET image: region, uptake, its distribution and landmarks.",
    "mammogram": "Describe this mammogram: density, masses, calcifications, distortion and asymmetry.",
}
DEFAULT_SCAN_PROMPT = "Describe what this medical image shows: region, structures and anything unusual."
SCAN_RULE = " Put ABNORMAL: before each finding that looks pathological. Describe only; give no diagnosis."
PAGE_PROMPT = "Transcribe all text on this page in reading order. Add nothing."
MATCH_PROMPTS = {
    "identity_name_match": "Does the identity document belong to the registered patient? Allow for reading errors, order of names, titles and small spelling differences; say missing only for clearly different people.",
    "insurance_policy_match": "Does the insurance document belong to the policy number on the form, and does it look like a real policy? Say missing if it holds no plausible number.",
    "diagnosis_match": "Do the stated reason for admission and the document's diagnosis name one condition, in whatever words? Say missing only for clearly unrelated ones.",
}
MATCH_REPLY = ' Answer as JSON: {"verdict": "verified" or "missing" or "uncertain", "explanation": "one sentence for the patient"}'
VERIFY_PROMPT = 'Is every claim of the ANSWER supported by the CONTEXT alone? Paraphrase is fine. Answer as JSON: {"verified": true or false, "explanation": "one or two sentences"}'
VERIFY_SKIPPED = "Verification skipped — answer or context is empty."

# -- fixed values: appointment statuses that may be set by hand
SETTABLE = ["pending", "accepted", "declined", "in_consultation", "completed", "no_show"]
PAGE_BREAK = "\n\n[PAGE BREAK]\n\n"
PAGE_WAITS, PAGE_PACE = (10, 20), 2
