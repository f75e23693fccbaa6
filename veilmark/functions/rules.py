"""Detection rules and the PII type dimension.

Everything in the FIXED VALUES block must stay exactly as written: the
rule patterns, their order, the type remap, token prefixes, labels and
severities decide which spans are found and how they are shown, and they
have to agree with the behaviour this engine reproduces.  Rules are plain
data: a list of ``Rule`` objects that ``veilmark.functions.spans`` compiles
into Catalyst expressions.  Order matters (the index is the rank used for
equal-length ties).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: str           # Python/Java-compatible regex, no inline flags
    score: float
    source: str
    validator: str | None = None        # e.g. "luhn": keep only matches passing the check
    needs: str | None = None            # cheap regex that every text with a match contains (None: not known)
    begins: str | None = None           # class of the characters that a match may begin with (None: not known)


# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced behaviour; do not reorder)
# ---------------------------------------------------------------------------

# Stage-2 business rules, in priority order, score 0.85, source "rule".
RULE_SCORE = 0.85
BUSINESS_RULES: list[tuple[str, str]] = [
    ("NIP", r"\b[0-9]{3}-?[0-9]{2}-?[0-9]{2}-?[0-9]{3}\b|\b[0-9]{3}-?[0-9]{3}-?[0-9]{2}-?[0-9]{2}\b"),
    ("REGON", r"\b[0-9]{9}\b|\b[0-9]{14}\b"),
    ("PHONE_NUMBER", r"(?:\+48|0048)?\s*(?:[1-9][0-9]{2}[\s\-]?[0-9]{3}[\s\-]?[0-9]{3}|[1-9][0-9][\s\-]?[0-9]{3}[\s\-]?[0-9]{2}[\s\-]?[0-9]{2})\b"),
    ("KRS", r"\b0000[0-9]{6}\b"),
    ("PESEL", r"\b[0-9]{11}\b"),
    ("IBAN_CODE", r"\b(?:PL)?[\s]*[0-9]{2}[\s]*[0-9]{4}[\s]*[0-9]{4}[\s]*[0-9]{4}[\s]*[0-9]{4}[\s]*[0-9]{4}[\s]*[0-9]{4}\b"),
]

# Analyzer entity names and the type they are reported as.
TYPE_REMAP: dict[str, str] = {
    "PERSON": "PERSON",
    "EMAIL_ADDRESS": "EMAIL_ADDRESS",
    "PHONE_NUMBER": "PHONE_NUMBER",
    "IBAN_CODE": "IBAN_CODE",
    "NRP": "PESEL",
    "LOCATION": "LOCATION",
    "DATE_TIME": "DATE_TIME",
    "CREDIT_CARD": "CREDIT_CARD",
    "CRYPTO": "CRYPTO",
    "IP_ADDRESS": "IP_ADDRESS",
}

# Token prefix per type; unknown types use the upper-cased type name.
TOKEN_PREFIX: dict[str, str] = {
    "PERSON": "OSOBA",
    "EMAIL_ADDRESS": "EMAIL",
    "PHONE_NUMBER": "TELEFON",
    "IBAN_CODE": "IBAN",
    "PESEL": "PESEL",
    "NIP": "NIP",
    "NRP": "PESEL",
    "LOCATION": "ADRES",
    "DATE_TIME": "DATA",
    "CREDIT_CARD": "KARTA",
    "CRYPTO": "CRYPTO",
    "IP_ADDRESS": "IP",
    "SALARY": "KWOTA",
    "FINANCIAL": "KWOTA",
    "PROJECT_ID": "PROJEKT",
    "CLIENT_NAME": "KLIENT",
    "CONTRACT_NUMBER": "UMOWA",
    "INTERNAL_ID": "ID_WEWN",
    "SECRET_PROJECT": "PROJEKT_TAJNY",
}

# Display label per type; unknown types show the type name.
TYPE_LABEL: dict[str, str] = {
    "PERSON": "Full Name",
    "EMAIL_ADDRESS": "Email Address",
    "PHONE_NUMBER": "Phone Number",
    "IBAN_CODE": "IBAN Code",
    "NRP": "ID / VAT Number",
    "PESEL": "PESEL (ID)",
    "NIP": "VAT Number",
    "LOCATION": "Address",
    "DATE_TIME": "Date",
    "CREDIT_CARD": "Credit Card",
    "CRYPTO": "Crypto Address",
    "SECRET_PROJECT": "Secret Project",
    "FINANCE": "Financial Amount",
    "INTERNAL_ID": "Internal ID",
    "IT_INFRA": "IT Infrastructure",
    "SALARY": "Salary Amounts",
    "FINANCIAL": "Financial Data",
    "PROJECT_ID": "Project Code",
    "CLIENT_NAME": "Client Name",
    "CONTRACT_NUMBER": "Contract Number",
    "IP_ADDRESS": "IP Address",
}

# Severity per type; unknown types are "info".  Ranks: critical 0, warning 1, info 2.
TYPE_SEVERITY: dict[str, str] = {
    "SECRET_PROJECT": "critical",
    "FINANCE": "warning",
    "INTERNAL_ID": "warning",
    "IT_INFRA": "critical",
    "PERSON": "critical",
    "NRP": "critical",
    "PESEL": "critical",
    "NIP": "critical",
    "CREDIT_CARD": "critical",
    "IBAN_CODE": "critical",
    "EMAIL_ADDRESS": "warning",
    "PHONE_NUMBER": "warning",
    "SALARY": "warning",
    "FINANCIAL": "warning",
    "LOCATION": "info",
    "CLIENT_NAME": "warning",
    "CONTRACT_NUMBER": "warning",
}
SEVERITY_RANK: dict[str, int] = {"critical": 0, "warning": 1, "info": 2}

# Deep-scan and guard constants.
DEEP_SCORE = 0.6
DEEP_FRAGMENT_CHARS = 4000
DECLENSION_LETTERS = "a-ząęółńśćźż"
GUARD_THREAT_WORD = "ZAGROZENIE"
GUARD_CLEAN_WORD = "CZYSTE"
# Types the guard prompt lists as leaks: name, PESEL, account number (plus card), ID numbers.
GUARD_CRITICAL_TYPES = ["PERSON", "PESEL", "IBAN_CODE", "CREDIT_CARD", "NIP"]

# Overlap thresholds: within one stage, and across stages / deep scan.
THETA_WITHIN = 0.1
THETA_ACROSS = 0.5

# Token shape accepted on reinjection (4 hex in the classic format, up to 32 here).
PREFIX_LETTERS = "A-ZĄĆĘŁŃÓŚŹŻ_"
TOKEN_PATTERN = rf"\[[{PREFIX_LETTERS}]+_[a-f0-9]{{4,32}}\]"

# Placeholder filename of a raw-text submission and default conversation title.
TEXT_PLACEHOLDER_FILENAME = "text_message.txt"
UNTITLED_CONVERSATION = "Untitled conversation"
SOLUTION_TAG = "ROZWIAZANIE"
SOLUTION_DEFAULT_MESSAGE = "Plik został przetworzony. Sprawdź podgląd poniżej i pobierz wynik."
SHEET_HEADER_PREFIX = "[Arkusz:"
DEFAULT_SHEET_NAME = "Arkusz1"
REBUILD_DEFAULT_SHEET = "Wynik"
SUPPORTED_EXTENSIONS = [".docx", ".xlsx", ".pdf", ".eml", ".msg", ".txt"]

# Provider registry: provider -> models (id, name, tier, context) and default model.
MODEL_REGISTRY: dict[str, list[tuple[str, str, str, int]]] = {
    "claude": [
        ("claude-sonnet-4-6-20260217", "Claude Sonnet 4.6", "flagship", 1_000_000),
        ("claude-opus-4-6-20260205", "Claude Opus 4.6", "flagship", 1_000_000),
        ("claude-sonnet-4-5-20250929", "Claude Sonnet 4.5", "standard", 1_000_000),
        ("claude-opus-4-5-20251124", "Claude Opus 4.5", "standard", 200_000),
        ("claude-opus-4-1-20250805", "Claude Opus 4.1", "standard", 200_000),
        ("claude-sonnet-4-20250514", "Claude Sonnet 4", "standard", 1_000_000),
        ("claude-opus-4-20250522", "Claude Opus 4", "standard", 200_000),
        ("claude-haiku-4-5-20251015", "Claude Haiku 4.5", "fast", 200_000),
        ("claude-3-5-haiku-20241104", "Claude 3.5 Haiku", "fast", 200_000),
        ("claude-3-7-sonnet-20250224", "Claude 3.7 Sonnet", "legacy", 200_000),
        ("claude-3-5-sonnet-20241022", "Claude 3.5 Sonnet", "legacy", 200_000),
    ],
    "openai": [
        ("gpt-5.4", "GPT-5.4", "flagship", 272_000),
        ("gpt-5.4-pro", "GPT-5.4 Pro", "flagship", 272_000),
        ("gpt-5.3-instant", "GPT-5.3 Instant", "standard", 400_000),
        ("gpt-5-mini", "GPT-5 Mini", "fast", 128_000),
        ("gpt-5-nano", "GPT-5 Nano", "fast", 32_000),
        ("gpt-5.2", "GPT-5.2", "legacy", 400_000),
        ("gpt-5.1", "GPT-5.1", "legacy", 400_000),
        ("gpt-5.3-codex", "GPT-5.3 Codex", "codex", 1_000_000),
        ("gpt-4.1", "GPT-4.1", "legacy", 1_000_000),
    ],
    "gemini": [
        ("gemini-3.1-pro-preview", "Gemini 3.1 Pro (Preview)", "flagship", 1_048_000),
        ("gemini-3-flash-preview", "Gemini 3 Flash (Preview)", "flagship", 1_048_000),
        ("gemini-3-pro-preview", "Gemini 3 Pro (Preview)", "standard", 1_048_000),
        ("gemini-2.5-pro", "Gemini 2.5 Pro", "standard", 1_048_000),
        ("gemini-2.5-flash", "Gemini 2.5 Flash", "fast", 1_048_000),
        ("gemini-2.5-flash-lite", "Gemini 2.5 Flash Lite", "fast", 1_048_000),
    ],
    "openrouter": [
        ("anthropic/claude-sonnet-4", "Claude Sonnet 4 (via OR)", "flagship", 1_000_000),
        ("anthropic/claude-haiku-4", "Claude Haiku 4 (via OR)", "fast", 200_000),
        ("openai/gpt-5.4", "GPT-5.4 (via OR)", "flagship", 272_000),
        ("google/gemini-2.5-flash", "Gemini 2.5 Flash (via OR)", "fast", 1_048_000),
        ("meta-llama/llama-4-maverick", "Llama 4 Maverick (via OR)", "standard", 1_000_000),
        ("mistralai/mistral-large", "Mistral Large (via OR)", "standard", 128_000),
        ("deepseek/deepseek-r1", "DeepSeek R1 (via OR)", "standard", 128_000),
        ("qwen/qwen3-235b-a22b", "Qwen 3 235B (via OR)", "flagship", 128_000),
    ],
    "ollama": [
        ("llama3.3:8b", "Llama 3.3 8B", "standard", 128_000),
        ("qwen2.5:7b", "Qwen 2.5 7B", "standard", 128_000),
        ("mistral:7b", "Mistral 7B", "standard", 32_000),
        ("phi4-mini", "Phi-4 Mini", "fast", 16_000),
        ("deepseek-r1:8b", "DeepSeek R1 8B", "standard", 128_000),
        ("gemma3:12b", "Gemma 3 12B", "standard", 128_000),
    ],
}
DEFAULT_MODEL: dict[str, str] = {
    "claude": "claude-sonnet-4-6-20260217",
    "openai": "gpt-5.4",
    "gemini": "gemini-2.5-flash",
    "openrouter": "anthropic/claude-sonnet-4",
    "ollama": "llama3.3:8b",
}
PROVIDERS = ["claude", "openai", "gemini", "openrouter", "ollama"]
# Configured default model of the service (note: differs from the registry id).
CONFIGURED_DEFAULT_PROVIDER = "claude"
CONFIGURED_DEFAULT_MODEL = "claude-sonnet-4.6-20260217"

# Audit event display labels (unknown events show their own name).
EVENT_LABEL: dict[str, str] = {
    "file_uploaded": "File uploaded",
    "pii_detected": "PII detected",
    "task_created": "Task created",
    "ai_response_received": "AI Response",
    "reinjection_complete": "Re-injection complete",
    "task_failed": "Task failed",
}
# Dashboard event groups.
FILE_EVENTS = ["file_uploaded", "text_submitted"]
TASK_EVENTS = ["task_created"]
INCIDENT_EVENTS = ["security_incident", "auth_failed"]
AUDIT_PAGE_MAX = 1_000
# Last column (XFD) and row of the sheet format.
SHEET_MAX_COL = 16_384
SHEET_MAX_ROW = 1_048_576
SESSION_TTL_SECONDS = 3600

# ---------------------------------------------------------------------------
# end of fixed values
# ---------------------------------------------------------------------------

# Stage-1 recognizers (re-aimed analyzer: pattern recognizers, no NLP model).
# These are this engine's own choices, ranked in this order for ties.  Digits
# are ASCII: the checks on a match read its digits as numbers.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
BASE_RECOGNIZERS: list[Rule] = [
    Rule("CREDIT_CARD", r"\b(?:[0-9][ -]?){15}[0-9]\b", 1.0, "base", validator="luhn", needs="[0-9]", begins="[0-9]"),
    # the domain ends in a word character, so a sentence's full stop is not part of it
    Rule("EMAIL_ADDRESS", r"[\w.+-]+@(?:[\w-]+\.)+\w+", 1.0, "base", needs="@"),
    Rule("IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", 0.6, "base", needs="[0-9]", begins="[0-9]"),
]
# Words of a text and of a gazetteer name.
WORD_PATTERN = r"[\p{L}\p{N}#]+"
WORD_PIECE_PATTERN = r"\G[^\p{L}\p{N}#]*[\p{L}\p{N}#]+"
# Further recognizers a user may add to the stage-1 list (query ``detect_extra``).
EXTRA_RECOGNIZERS: list[Rule] = [
    Rule("CRYPTO", r"\b(?:bc1|[13])[a-zA-HJ-NP-Z0-9]{25,39}\b", 1.0, "base", needs="[0-9]"),
    Rule("DATE_TIME", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2})?)?\b", 0.6, "base", needs="[0-9]", begins="[0-9]"),
    Rule("IBAN_CODE", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,4})?\b", 0.9, "base", needs="[0-9]"),
]


# What the matches of a business rule may begin with (of the others: a digit).
RULE_BEGINS = {"PHONE_NUMBER": r"[+0-9\s]", "IBAN_CODE": r"[Pp0-9\s]"}


def business_rules() -> list[Rule]:
    return [Rule(t, p, RULE_SCORE, "rule", needs="[0-9]", begins=RULE_BEGINS.get(t, "[0-9]")) for t, p in BUSINESS_RULES]


def default_base_recognizers() -> list[Rule]:
    return list(BASE_RECOGNIZERS)


def _map_literal(d: dict[str, str | int]) -> Column:
    items: list[Column] = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def type_remap(col: Column) -> Column:
    """Analyzer type -> reported type; unknown names pass through."""
    return F.coalesce(F.try_element_at(_map_literal(TYPE_REMAP), col), col)


def token_prefix(col: Column) -> Column:
    """Prefix of a type's tokens; an unknown type's name is written in the letters of the token grammar."""
    name = F.regexp_replace(F.upper(F.coalesce(col, F.lit(""))), f"[^{PREFIX_LETTERS}]", "_")
    return F.coalesce(F.try_element_at(_map_literal(TOKEN_PREFIX), col), F.when(name == "", F.lit("_")).otherwise(name))


def type_label(col: Column) -> Column:
    return F.coalesce(F.try_element_at(_map_literal(TYPE_LABEL), col), col)


def type_severity(col: Column) -> Column:
    return F.coalesce(F.try_element_at(_map_literal(TYPE_SEVERITY), col), F.lit("info"))


def severity_rank(col: Column) -> Column:
    return F.try_element_at(_map_literal(SEVERITY_RANK), col)


def pii_types_dim(spark: SparkSession) -> DataFrame:
    """D15 as a small dimension table (type, label, severity, severity_rank, prefix)."""
    names = sorted(set(TOKEN_PREFIX) | set(TYPE_LABEL) | set(TYPE_SEVERITY) | {"REGON", "KRS"})
    df = spark.createDataFrame([(n,) for n in names], "type string")
    sev = type_severity(F.col("type"))
    return df.select(
        "type",
        type_label(F.col("type")).alias("label"),
        sev.alias("severity"),
        severity_rank(sev).alias("severity_rank"),
        token_prefix(F.col("type")).alias("prefix"),
    )


def model_registry(spark: SparkSession) -> DataFrame:
    """(provider, model_id, name, tier, context, is_default)."""
    rows = [
        (p, mid, name, tier, ctx, DEFAULT_MODEL.get(p) == mid)
        for p, models in MODEL_REGISTRY.items()
        for (mid, name, tier, ctx) in models
    ]
    return spark.createDataFrame(
        rows, "provider string, model_id string, name string, tier string, context int, is_default boolean"
    )


def provider_catalog(spark: SparkSession, configured: DataFrame | None = None) -> DataFrame:
    """One row per provider with its models (nested), default model and a configured flag.

    ``configured`` is a (provider, api_key) settings table; a provider counts as
    configured when its key is non-blank; the local provider always is.
    """
    reg = model_registry(spark)
    models = reg.groupBy("provider").agg(
        F.array_sort(F.collect_list(F.struct("model_id", "name", "tier", "context"))).alias("models"),
        F.max(F.when(F.col("is_default"), F.col("model_id"))).alias("default_model"),
    )
    if configured is None:
        flag = F.col("provider") == F.lit("ollama")
        return models.withColumn("configured", flag)
    keys = configured.select("provider", (F.trim(F.coalesce("api_key", F.lit(""))) != "").alias("has_key"))
    j = models.join(keys, "provider", "left")
    return j.withColumn("configured", (F.col("provider") == "ollama") | F.coalesce(F.col("has_key"), F.lit(False))).drop("has_key")
