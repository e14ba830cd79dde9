"""Small fixed dimensions: probe variants, instruction texts, sentence templates, model families."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The variants in display order with (user present, document present, user correct,
# document correct, which source stands first).
VARIANTS = [
    ("bare", False, False, False, False, ""),
    ("upos", True, False, True, False, ""),
    ("uneg", True, False, False, False, ""),
    ("dpos", False, True, False, True, ""),
    ("dneg", False, True, False, False, ""),
    ("updp", True, True, True, True, "u"),
    ("updn", True, True, True, False, "u"),
    ("undp", True, True, False, True, "u"),
    ("undn", True, True, False, False, "u"),
    ("dpup", True, True, True, True, "d"),
    ("dpun", True, True, False, True, "d"),
    ("dnup", True, True, True, False, "d"),
    ("dnun", True, True, False, False, "d"),
]
VARIANT_SCHEMA = "probe_variant string, user_present boolean, doc_present boolean, user_correct boolean, doc_correct boolean, first string, variant_rank int"
SINGLES = ["bare", "upos", "uneg", "dpos", "dneg"]
#: Order in which sampling draws variants and a weight string names them.
SAMPLING_ORDER = ["bare", "upos", "uneg", "dpos", "dneg", "dpup", "updp", "dnun", "undn", "dpun", "dnup", "updn", "undp"]

# Model families by key prefix, first match wins.
FAMILIES = [("llama3_2", "llama3.2"), ("llama3", "llama3"), ("qwen2_5", "qwen2.5"), ("qwen3", "qwen3"), ("gpt", "gpt"), ("gemma3", "gemma3")]
INSTRUCTIONS = {"n": "neutral", "d": "based_on_docs", "u": "based_on_user", "o": "own_knowledge_only"}
STRENGTHS = {"w": "weak", "n": "neutral", "c": "confident"}

# What each instruction appends to the system prompt.
APPENDIX = {
    "neutral": "",
    "based_on_docs": " Base your answer ONLY on the information provided in the document statement. Ignore all other sources including your own knowledge and the user statement.",
    "based_on_user": " Base your answer ONLY on the user's statement. Ignore all other sources including your own knowledge and any document statement.",
    "own_knowledge_only": " Base your answer ONLY on your own internal knowledge. Completely ignore any statements from users or documents.",
}
# Where the wording for API models differs.
API_APPENDIX = APPENDIX | {"based_on_user": " Base your answer ONLY on the user's statement. Ignore all other sources including your own knowledge and any document information."}
# Tier-1 sentence templates and their words.
USER_TEMPLATES = ["I {user_verb} the answer is {answer}.", "My {user_noun} is that the answer is {answer}.", "The answer is {answer}, I {user_verb}."]
DOC_TEMPLATES = ["{doc_noun_plural} {doc_verb} the answer is {answer}.", "The {doc_noun} {doc_verb_singular} the answer is {answer}.", "The answer is {answer}, {doc_noun_plural_lower} {doc_verb}."]
WORDS = {
    "default": {
        "user_verb": ["think", "believe", "suppose", "reckon", "assume"],
        "user_noun": ["belief", "opinion", "view", "impression", "understanding"],
        "doc_verb": ["indicate", "suggest", "state", "note", "mention", "say"],
        "doc_verb_singular": ["states", "indicates", "says", "notes", "mentions"],
        "doc_noun": ["record", "document", "source", "report", "material"],
        "doc_noun_plural": ["Records", "Documents", "Sources", "Reports", "Materials"],
        "doc_noun_plural_lower": ["records", "documents", "sources", "reports", "materials"],
    },
    "math": {
        "user_verb": ["calculate", "determine", "estimate", "compute", "figure"],
        "user_noun": ["calculation", "estimate", "computation", "assessment", "determination"],
        "doc_verb": ["show", "demonstrate", "indicate", "specify", "present", "reveal"],
        "doc_verb_singular": ["shows", "demonstrates", "indicates", "specifies", "presents"],
        "doc_noun": ["calculation", "solution", "analysis", "method", "result"],
        "doc_noun_plural": ["Calculations", "Solutions", "Analyses", "Methods", "Results"],
        "doc_noun_plural_lower": ["calculations", "solutions", "analyses", "methods", "results"],
    },
    "code": {
        "user_verb": ["deduce", "conclude", "determine", "assess", "infer"],
        "user_noun": ["assessment", "conclusion", "analysis", "understanding", "interpretation"],
        "doc_verb": ["indicate", "show", "state", "confirm", "demonstrate", "suggest"],
        "doc_verb_singular": ["indicates", "shows", "states", "confirms", "suggests"],
        "doc_noun": ["reference", "documentation", "resource", "material", "source"],
        "doc_noun_plural": ["References", "Documentation", "Resources", "Materials", "Sources"],
        "doc_noun_plural_lower": ["references", "documentation", "resources", "materials", "sources"],
    },
}

# Tier-2 templates and the words that fill them.
T2_USER_TEMPLATES = ["{user_phrase} {contextual_claim}.", "{contextual_claim}, from what {user_phrase}.", "Based on {user_perspective}, {contextual_claim}."]
T2_DOC_TEMPLATES = ["{doc_phrase} {contextual_claim}.", "{contextual_claim}, according to {doc_source}.", "As per {doc_source}, {contextual_claim}."]
T2_WORDS = {
    "default": {
        "user_phrase": ["I've noticed", "I've seen", "I've heard", "I recall", "I've observed", "I believe", "I think"],
        "user_perspective": ["my experience", "my understanding", "what I've seen", "my observation"],
        "doc_phrase": ["Studies suggest", "Papers indicate", "Documents suggest", "Sources mention", "Reports note"],
        "doc_source": ["recent reports", "available data", "published studies", "the literature", "the documentation", "recent findings", "available materials", "available sources"],
    },
    "math": {
        "user_phrase": ["I've calculated", "I've worked out", "I've computed", "I've solved", "I've derived", "I've determined"],
        "user_perspective": ["my calculations", "my workings", "my analysis", "my solution approach"],
        "doc_phrase": ["Calculations show", "Solutions indicate", "Analysis reveals", "Methods demonstrate", "Results confirm"],
        "doc_source": ["the calculations", "the solution method", "the analysis", "the mathematical approach", "the problem solution", "the computational results"],
    },
    "code": {
        "user_phrase": ["I've analyzed", "I've examined", "I've reviewed", "I've studied", "I've evaluated", "I've investigated"],
        "user_perspective": ["my analysis", "my examination", "my review", "my evaluation"],
        "doc_phrase": ["Documentation states", "References indicate", "Resources show", "Technical materials confirm", "Sources reveal"],
        "doc_source": ["the documentation", "technical references", "available resources", "reference materials", "technical sources", "the reference guide"],
    },
}


def variants(spark: SparkSession) -> DataFrame:
    """The thirteen variants: 13 rows, fit to be broadcast."""
    return spark.createDataFrame([(*v, i) for i, v in enumerate(VARIANTS)], VARIANT_SCHEMA)


def conditions(spark: SparkSession) -> DataFrame:
    """Condition keys of the breakdown with the variant that has them, for both orders."""
    rows = []
    for order in ("d", "u"):
        for v, up, dp, uc, dc, first in VARIANTS:
            if first in ("", order):
                rows.append((order == "u", f"U{int(up)}D{int(dp)}_Ucorr{int(uc)}Dcorr{int(dc)}", v))
    return spark.createDataFrame(rows, "user_first boolean, condition string, probe_variant string")
