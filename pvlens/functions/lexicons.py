"""Word lists, label maps and palettes.

FIXED VALUES: everything in this module must equal the values the original
pipeline uses, in the order given there (order is semantic for the keyword
levels and the entity rules).
"""

from __future__ import annotations

# --- FIXED VALUES: severity keyword levels of the labeller, tried in this order
SEVERITY_KEYWORDS: list[tuple[str, list[str]]] = [
    ("mild", ["mild", "slight", "minor", "minimal", "light", "low", "small"]),
    ("moderate", ["moderate", "medium", "intermediate", "average"]),
    ("severe", ["severe", "serious", "extreme", "high", "intense", "major",
                "critical", "life-threatening", "lethal"]),
]

# --- FIXED VALUES: built-in symptom dictionary (one alternation, this order)
DEFAULT_SYMPTOMS: list[str] = [
    "headache", "nausea", "vomiting", "fever", "pain", "dizziness",
    "fatigue", "rash", "swelling", "itching", "cough", "shortness of breath",
    "diarrhea", "constipation", "blurred vision", "chest pain", "abdominal pain",
    "insomnia", "anxiety", "depression", "confusion", "weakness", "numbness",
    "tingling", "seizure", "tremor", "muscle pain", "joint pain", "back pain",
    "throat pain", "ear pain", "eye pain", "chills", "sweating", "loss of appetite",
    "weight loss", "weight gain", "edema", "hypertension", "hypotension",
    "tachycardia", "bradycardia", "arrhythmia", "palpitations", "syncope",
    "dyspnea", "wheezing", "hemoptysis", "jaundice", "hematuria", "dysuria",
    "polyuria", "oliguria", "anuria", "hematochezia", "melena", "hematemesis",
    "dysphagia", "odynophagia", "heartburn", "indigestion", "bloating", "flatulence",
    "pruritus", "eczema", "urticaria", "petechiae", "ecchymosis", "paresthesia",
    "paralysis", "ataxia", "aphasia", "dysarthria", "diplopia", "photophobia",
    "tinnitus", "vertigo", "epistaxis", "amenorrhea", "menorrhagia", "dysmenorrhea",
    "anaphylaxis", "dyspepsia",
]

# --- FIXED VALUES: lexicon entity rules, emitted in this order.
# (type, term); all SEVERITY rules together yield at most one entity, first hit wins.
ENTITY_RULES: list[tuple[str, str]] = [
    ("DRUG", "ibuprofen"),
    ("SYMPTOM", "headache"),
    ("SYMPTOM", "nausea"),
    ("SYMPTOM", "fever"),
    ("SYMPTOM", "pain"),
]
SEVERITY_ENTITY_TERMS: list[str] = ["severe", "moderate", "mild"]

# --- FIXED VALUES: severity classifier rule (term, label, confidence), tried in order
CLASSIFIER_RULES: list[tuple[str, str, float]] = [
    ("severe", "severe", 0.9),
    ("moderate", "moderate", 0.8),
    ("mild", "mild", 0.9),
]
CLASSIFIER_DEFAULT: tuple[str, float] = ("mild", 0.7)
CLASSIFIER_BASE_PROB = 0.1
SEVERITY_LABELS: list[str] = ["mild", "moderate", "severe"]

# --- FIXED VALUES: explanation weights
EXPLAIN_TOP_WORDS = 5
EXPLAIN_POS_START, EXPLAIN_POS_STEP = 0.5, -0.1
EXPLAIN_NEG_START, EXPLAIN_NEG_STEP = -0.3, 0.05

# --- FIXED VALUES: label encodings
SEVERITY_LABEL_IDS: dict[str, int] = {"mild": 0, "moderate": 1, "severe": 2}
BIO_LABEL_IDS: dict[str, int] = {
    "O": 0, "B-DRUG": 1, "I-DRUG": 2, "B-SYMPTOM": 3, "I-SYMPTOM": 4,
}

# --- FIXED VALUES: entity types offered for annotation
ENTITY_TYPES: list[str] = ["DRUG", "SYMPTOM", "SEVERITY", "DOSAGE", "DURATION",
                           "FREQUENCY", "ROUTE"]

# --- FIXED VALUES: annotation label palette, default #999999
LABEL_COLORS: dict[str, str] = {
    "DRUG": "#ff9900", "SYMPTOM": "#33cc33", "SEVERITY": "#ff3333",
    "DOSAGE": "#9966ff", "DURATION": "#3399ff", "FREQUENCY": "#ffcc00",
    "ROUTE": "#cc66ff",
}
LABEL_COLOR_DEFAULT = "#999999"

# --- FIXED VALUES: highlight palette, default #cccccc
HIGHLIGHT_COLORS: dict[str, str] = {
    "DRUG": "#ffcccc", "SYMPTOM": "#ccffcc", "SEVERITY": "#ccccff",
    "DOSAGE": "#ffffcc", "DURATION": "#ffccff", "FREQUENCY": "#ccffff",
    "ROUTE": "#ffddcc",
}
HIGHLIGHT_COLOR_DEFAULT = "#cccccc"

# --- FIXED VALUES: feature importance colours (positive, other)
IMPORTANCE_POSITIVE_COLOR, IMPORTANCE_NEGATIVE_COLOR = "#99ff99", "#ff9999"

# --- FIXED VALUES: state code clean-up, exact match only
STATE_CASE_FIXES: dict[str, str] = {
    "Ne": "NE", "Mi": "MI", "Tx": "TX", "Fl": "FL", "or": "OR", "Ar": "AR",
    "Co": "CO", "Ca": "CA",
}
# The original literal lists QW twice (WA, then WI); the later one is in force.
TERRITORY_FIXES: dict[str, str] = {
    "XB": "TX", "XL": "FL", "XV": "VA", "QM": "NM", "QW": "WI",
}

# --- FIXED VALUES: tokens read as null from CSV text
NULL_TOKENS: list[str] = ["", "NA", "N/A", "n/a", "None", "null", "NULL", "NaN",
                          "nan", "#N/A", "<NA>"]

# --- FIXED VALUES: report columns kept by the clean job, in order (ORDER is
# listed twice there; a Spark projection keeps one)
CLEAN_KEEP_COLUMNS: list[str] = [
    "VAERS_ID", "STATE", "AGE_YRS", "SEX", "SYMPTOM_TEXT", "RECOVD", "VAX_DATE",
    "ONSET_DATE", "NUMDAYS", "V_ADMINBY", "HISTORY", "FORM_VERS", "ALLERGIES",
    "ORDER", "ORDER", "SYMPTOM1", "SYMPTOMVERSION1", "SYMPTOM2",
    "SYMPTOMVERSION2", "SYMPTOM3", "SYMPTOMVERSION3", "VAX_TYPE", "VAX_MANU",
    "VAX_LOT", "VAX_DOSE_SERIES", "VAX_ROUTE", "VAX_SITE", "VAX_NAME",
]

# --- FIXED VALUES: null-rate bands (percent, lower bound exclusive) used by
# the profiling report
NULL_BANDS: list[tuple[str, float, float]] = [
    (">90", 90.0, 100.0), ("50-90", 50.0, 90.0), ("20-50", 20.0, 50.0),
    ("1-20", 1.0, 20.0),
]

# --- FIXED VALUES: circle layout of symptom clusters
CLUSTER_MAX = 3
LAYOUT_CENTER, LAYOUT_RADIUS, LAYOUT_PI = 0.5, 0.4, 3.14159

# --- FIXED VALUES: sampling and split parameters
SAMPLE_SEED = 42
TRAIN_FRACTION = 0.8
BATCH_PAGE_LIMIT = 100

# --- Annotation QA vocabularies. These are OUR values, taken from the
# examples of the annotation guide (not from code, which has none).
# Span labels recorded for the gold mentions: the lexicon rules plus one rule
# per severity term.
ANNOTATION_RULES: list[tuple[str, str]] = ENTITY_RULES + [("SEVERITY", t) for t in SEVERITY_ENTITY_TERMS]
# Q2: time expressions that must stay outside a span (lower-cased text)
QA_TIME_PATTERN = (r"\b(for|since|after|within|over)?\s*(\d+|a|an|one|two|three|several|few)\s+"
                   r"(minutes?|hours?|days?|weeks?|months?|years?)\b|\b(yesterday|overnight|today)\b")
# Q3: severity modifiers that belong inside the finding's span
QA_MODIFIERS: list[str] = ["severe", "mild", "moderate", "extreme", "slight", "serious",
                           "intense", "acute", "life-threatening"]
# Q4: phrases the guide says to skip, with the reason
QA_SKIP_TERMS: list[tuple[str, str]] = [
    ("not feeling well", "vague"), ("body temperature", "vague"),
    ("product dose omission", "administrative"), ("died", "outcome only"),
    ("death", "outcome only"), ("patient died", "outcome only"),
    ("hospitalization", "outcome only"), ("fell asleep", "non-medical"),
]
# Q5: compounds that are one finding
COMPOUND_FIXED_EXPRESSIONS: list[str] = ["nausea and vomiting"]
# Q6: COVID-19 mention disposition, tried in order (lower-cased text)
COVID_DISPOSITION_RULES: list[tuple[str, str]] = [
    (r"tested negative|negative (test|result)", "negative test"),
    (r"exposed to|contact with|close contact", "exposure"),
    (r"history of covid|covid-?19 last year|prior covid|previous covid", "history"),
    (r"covid-?19 vaccin", "vaccine name"),
    (r"covid-?19 (infection|pneumonia)|tested positive|positive for covid", "infection"),
]
# ML4: further entity types as regexes over lower-cased text (OUR patterns,
# shaped after the demo sentence of the original app)
EXTRA_ENTITY_PATTERNS: list[tuple[str, str]] = [
    ("DOSAGE", r"\b\d+(\.\d+)?\s?(mg|mcg|g|ml|units?|iu)\b"),
    ("DURATION", r"\bfor \d+ (minutes?|hours?|days?|weeks?|months?|years?)\b"),
    ("FREQUENCY", r"\b(once|twice|three times) (daily|a day|weekly|per day)\b|\bevery \d+ hours\b"),
    ("ROUTE", r"\b(oral|orally|intravenous|intravenously|intramuscular|subcutaneous|topical|by mouth)\b"),
]
