"""Conversations and tasks: summaries, titles, lists, filters, states, payloads (A9, A10, W1, W2, W5,
P16, P17, P19, T4, J1, M14, M15, prompt assembly).

Per-conversation facts are mergeable aggregates (count, max_by, min_by), so a
conversation with a huge number of turns is pre-aggregated map-side and never
collected into one list.  The outbound payload is emitted as ordered lines, the
masked document and then one per turn, instead of one concatenated string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.operators.joins import salted_join
from veilmark.operators.mask import remask
from veilmark.operators.ordering import ranked_in_groups
from veilmark.operators.reinject import solution_extract

# FIXED VALUES: characters of a list entry's preview and title
PREVIEW_CHARS = 160
TITLE_CHARS = 72


def conv_facts(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """A9/W1 + first user instruction: one row per conversation."""
    is_user = F.col("role") == "user"
    return turns.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max_by("text", "turn").alias("last_text"),
        F.max_by("role", "turn").alias("last_role"),
        F.min_by(F.when(is_user, F.col("text")), F.when(is_user, F.col("turn"))).alias("instruction"),
    )


def conversation_title(filename: Column, instruction: Column, chars: int | None = None) -> Column:
    """Filename unless it is the raw-text placeholder; else the instruction with whitespace
    collapsed (its first ``chars`` characters, if given); else the filename or 'Untitled conversation'."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(instruction, F.lit("")), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    fn = F.coalesce(filename, F.lit(""))
    return (
        F.when((fn != "") & (fn != R.TEXT_PLACEHOLDER_FILENAME), fn)
        .when(cleaned != "", cleaned if chars is None else F.substring(cleaned, 1, chars))
        .when(fn != "", fn)
        .otherwise(F.lit(R.UNTITLED_CONVERSATION))
    )


def conv_summary(turns: DataFrame, tasks: DataFrame, files: DataFrame, title_chars: int | None = None, preview_chars: int | None = None) -> DataFrame:
    """W5 record per task: title, status, provider, model, times, counts, last message.

    ``title_chars`` and ``preview_chars`` cut the title and the last message.
    """
    preview = F.coalesce(F.col("last_text"), F.lit(""))
    facts = conv_facts(turns).withColumnRenamed("conv_id", "task_id")
    t = tasks.drop("message_count").join(facts, "task_id", "left").join(files.select("file_id", "filename"), "file_id", "left")
    return t.select(
        "task_id",
        conversation_title(F.col("filename"), F.col("instruction"), title_chars).alias("title"),
        F.coalesce(F.col("filename"), F.lit("")).alias("filename"),
        F.coalesce(F.col("provider"), F.lit("")).alias("provider"),
        F.coalesce(F.col("model"), F.lit("")).alias("model"),
        F.coalesce(F.col("status"), F.lit("unknown")).alias("status"),
        F.col("created_at"),
        F.coalesce(F.col("last_activity_at"), F.col("created_at")).alias("last_activity_at"),
        F.coalesce(F.col("message_count"), F.lit(0)).alias("message_count"),
        (preview if preview_chars is None else F.substring(preview, 1, preview_chars)).alias("last_message_preview"),
    )


def conv_filter(summary: DataFrame, provider: str = "all", model: str = "all", status: str = "all") -> DataFrame:
    """Conjunctive equality filters; 'all' means no filter."""
    out = summary
    for col, val in (("provider", provider), ("model", model), ("status", status)):
        if val != "all":
            out = out.filter(F.col(col) == val)
    return out


def conv_options(summary: DataFrame) -> DataFrame:
    """A10: distinct non-empty providers and models (kind, value), sorted."""
    p = summary.select(F.lit("provider").alias("kind"), F.col("provider").alias("value"))
    m = summary.select(F.lit("model").alias("kind"), F.col("model").alias("value"))
    return p.unionByName(m).filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct().orderBy("kind", "value")


def owner_key(user_id: Column, username: Column, legacy_user: Column | None = None) -> Column:
    """Record owner by the fallback chain user_id -> username -> user -> anonymous.

    Returns a tagged key so a user id never equals a username by accident.
    """
    def clean(c: Column) -> Column:
        return F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))

    uname = clean(username) if legacy_user is None else F.coalesce(clean(username), clean(legacy_user))
    return F.coalesce(
        F.concat(F.lit("id:"), clean(user_id)),
        F.concat(F.lit("name:"), uname),
        F.lit("id:anonymous"),
    )


def owned(records: DataFrame, identities: DataFrame, user_id: str = "user_id", username: str = "username",
          legacy_user: str | None = None) -> DataFrame:
    """P16 as an equi-join: records x identities(ident_user_id, ident_username) on the owner rule.

    A record with a user id matches that id; one with only a username matches that
    name; one with neither belongs to the anonymous identity.
    """
    legacy = F.col(legacy_user) if legacy_user else None
    rec = records.withColumn("_owner", owner_key(F.col(user_id), F.col(username), legacy))
    ids = identities.select(
        "*",
        F.explode(F.array(
            F.concat(F.lit("id:"), F.col("ident_user_id")),
            F.concat(F.lit("name:"), F.col("ident_username")),
        )).alias("_owner"),
    )
    # a username match only applies to records without user id (the key tags ensure that)
    return rec.join(ids, "_owner", "inner").drop("_owner")


def task_state(tasks: DataFrame, solution: Column | None = None) -> DataFrame:
    """Availability flags of a task."""
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    expired = F.coalesce(F.col("context_expired"), F.lit(False)) if "context_expired" in tasks.columns else F.lit(False)
    has_solution = solution.isNotNull() if solution is not None else F.lit(False)
    return tasks.select(
        "task_id",
        status.alias("status"),
        (status == "processing").alias("processing"),
        (status == "failed").alias("failed"),
        (status == "completed").alias("ready"),
        has_solution.alias("has_solution"),
        ((status != "processing") & ~expired).alias("can_continue"),
    )


ROLE_NAMES = {
    "gemini": {"user": "user", "_other": "model"},
    "ollama": {"user": "Użytkownik", "_other": "Asystent"},
}


def payload_role(provider: Column, role: Column) -> Column:
    """Role label per target provider (assistant/system renamed where the target needs it)."""
    out = role
    for p, names in ROLE_NAMES.items():
        out = F.when(provider == p, F.when(role == "user", F.lit(names["user"])).otherwise(F.lit(names["_other"]))).otherwise(out)
    return out


def outbound_payload(turns: DataFrame, documents: DataFrame, vault: DataFrame, tasks: DataFrame, key: str = "conv_id") -> DataFrame:
    """What leaves the boundary, as ordered lines (key, seq, role, line) of each conversation.

    Line 0 is the masked document (``documents``: key, masked_text); turn t (0, 1, ...)
    is line t + 1, re-masked with every value of the conversation's vault, with the
    role names of the target provider.  No text enters without re-masking.
    """
    masked = remask(turns.select(key, "turn", "role", "text"), vault, key, "text", [key, "turn"])
    provider = tasks.select(F.col("task_id").alias("_task"), "provider")
    t = salted_join(masked, provider, F.col(key), "_task", F.xxhash64("turn"))
    lines = t.select(key, (F.col("turn") + 1).cast("bigint").alias("seq"), payload_role(F.col("provider"), F.col("role")).alias("role"), F.col("text").alias("line"))
    of = turns.select(key).distinct()
    head = documents.join(of, key, "left_semi").select(key, F.lit(0).cast("bigint").alias("seq"), F.lit("document").alias("role"), F.col("masked_text").alias("line"))
    return head.unionByName(lines)


def payload_leaks(payload: DataFrame, vault: DataFrame, key: str = "conv_id") -> DataFrame:
    """Check of a payload: (key, seq) of lines with a vault value outside tokens (none if it is safe)."""
    pieces = payload.select(key, "seq", F.posexplode(F.split("line", R.TOKEN_PATTERN, -1)).alias("n", "piece")).where("piece <> ''")
    # a value that is found is replaced by a mark that no text contains
    marked = remask(pieces, vault.withColumn("token", F.lit("\x00")), key, "piece", [key, "seq", "n"])
    return marked.where(F.contains("piece", F.lit("\x00"))).select(key, "seq").distinct()


def result_text(answers: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation the latest solution of any turn, else the last assistant answer, else ''.

    A conversation without an assistant turn gives an empty text.
    """
    sol, msg = solution_extract(F.col("text"))
    says = F.col("role") == "assistant"
    per = answers.select(key, "turn", F.when(says, sol).alias("solution"), F.when(says, F.col("text")).alias("text"))
    # a later solution replaces an earlier one; turns without one leave it
    got = per.groupBy(key).agg(
        F.max_by("solution", F.when(F.col("solution").isNotNull(), F.col("turn"))).alias("solution_text"),
        F.max_by("text", F.when(F.col("text").isNotNull(), F.col("turn"))).alias("last_text"),
    )
    last = F.regexp_replace(F.coalesce("last_text", F.lit("")), r"^\s+|\s+$", "")
    return got.select(key, "solution_text", F.coalesce(F.nullif(F.col("solution_text"), F.lit("")), last).alias("result_text"))


def conv_list(summary: DataFrame, owners: DataFrame) -> DataFrame:
    """Each owner's conversations, last activity first (ties by task): (owner, rank, task_id, title, last_activity_at).

    ``owners``: (owner, task_id), from ``owned``.  An owner with very many conversations
    (the fallback owner) is ranked by many tasks.
    """
    j = owners.join(summary, "task_id").select("owner", "task_id", "title", "last_activity_at")
    ranked = ranked_in_groups(j, "owner", ["last_activity_at", "task_id"], [F.col("last_activity_at").desc_nulls_last(), F.col("task_id")], "rank")
    return ranked.select("owner", F.col("rank").cast("int").alias("rank"), "task_id", "title", "last_activity_at")
