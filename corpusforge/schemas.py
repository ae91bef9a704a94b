"""Schemas of the relations, and fixed values."""

from __future__ import annotations

from pyspark.sql import types as T

# Languages in output order, classification prefixes, limits, templates of wording rules.
LANGUAGES = ["en", "de", "fr", "es", "ja", "ko", "zh", "ru", "pt", "it", "nl", "ar", "fa", "tr", "pl", "hi"]
TARGET_LANGUAGES = [x for x in LANGUAGES if x != "en"]
LANGUAGE_NAMES = {
    "de": "German", "fr": "French", "es": "Spanish", "ja": "Japanese", "ko": "Korean", "zh": "Chinese", "ru": "Russian", "pt": "Portuguese",
    "it": "Italian", "nl": "Dutch", "ar": "Arabic", "fa": "Farsi", "tr": "Turkish", "pl": "Polish", "hi": "Hindi", "en": "English",
}
CLASS_PREFIXES = ["C", "A61K", "A61P"]
MIN_WORDS = 50
MIN_CHARS = 300
CHARS_PER_WORD = 5
SNIPPET_CHARS = 1500
GENERATION_CHARS = 4000
REVIEW_CHARS = 5000
OVERFETCH_FACTOR = 1.25
OVERFETCH_LEAST = 10
SOURCE_NAME = "google_patents"
DOCUMENT_PHRASES = [
    "described in the invention", "mentioned in the invention", "according to the invention", "in the text",
    "described in the text", "described in the present disclosure", "used in the invention",
]
BROAD_OPENINGS = [
    "what is the application of", "what are the advantages of", "what advantages does", "what is the benefit of",
    "what is the main technical advantage of", "what is the purpose of", "what types of products", "what is the role of",
]
QUESTION_TYPES = ["purpose", "application", "composition", "method", "property", "advantage", "operating_condition", "material_relationship", "other"]
QUESTION_FAILURES = ["title-lift", "high-overlap", "overly-extractive", "broad-summary", "bundled-facts", "weak-query-shape"]
TRANSLATION_FAILURES = [
    "none", "wrong-language", "meaning-error", "missing-technical-detail", "too-generic", "unnatural-phrasing",
    "grammar-morphology", "terminology-register", "translation-artifact",
]
SEVERITIES = ["low", "medium", "high"]

# White space as Python's str.isspace has it: Java's, RE2's and SQL's own classes all differ from it.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_localized = T.ArrayType(T.StructType().add("text", "string").add("language", "string").add("truncated", "boolean"))
_codes = T.ArrayType(T.StructType().add("code", "string").add("inventive", "boolean").add("first", "boolean").add("tree", T.ArrayType(T.StringType())))

PUBLICATIONS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("publication_number", "family_id", "country_code")]
    + [T.StructField("publication_date", T.IntegerType())]
    + [
        T.StructField(n, _localized)
        for n in ("title_localized", "abstract_localized", "description_localized", "description_localized_html", "claims_localized", "claims_localized_html")
    ]
    + [T.StructField(n, _codes) for n in ("cpc", "ipc")]
)
CORPUS_COLUMNS = [
    "id", "language", "title", "abstract", "description", "first_claim", "context", "publication_number", "country_code",
    "publication_date", "source",
]
CORPUS = T.StructType([T.StructField(n, T.StringType()) for n in CORPUS_COLUMNS])
QAC_COLUMNS = ["corpus_id", "language", "question", "answer"]
QAC = T.StructType([T.StructField(n, T.StringType()) for n in QAC_COLUMNS])
SAMPLE_RESULT = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("corpus_id", T.StringType()),
        T.StructField("rows", T.ArrayType(QAC)),
        T.StructField("status", T.StringType()),
    ]
)
