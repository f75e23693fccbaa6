"""Reinjection and answer post-processing.

At scale the answers are joined with the vault on (session, token) — not on
the session alone — so a session with millions of tokens never becomes one
group: each answer only pulls the vault rows of the tokens it contains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import rules as R
from veilmark.functions.arrays import explode_kept, posexplode_kept
from veilmark.operators.joins import SALTS, salted_join

TOKEN_RE = R.TOKEN_PATTERN
_EMPTY_MAP = "map<string,string>"


def token_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_RE), 0)


def reinject_text(text: Column, tmap: Column) -> Column:
    """Single pass; every token-shaped piece is looked up, unknown tokens stay as they are."""
    toks = token_list(text)
    pieces = F.split(text, TOKEN_RE, -1)
    resolved = F.transform(toks, lambda t: F.coalesce(F.try_element_at(tmap, t), t))
    return F.array_join(
        F.zip_with(pieces, resolved, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), ""
    )


def unresolved(text: Column, tmap: Column, session_known: Column | None = None) -> Column:
    """Token-shaped strings not in the map, duplicates kept; empty session map -> none.

    ``tmap`` may be the per-answer slice of the session map; ``session_known``
    then says whether the session map itself is non-empty.
    """
    m = F.coalesce(tmap, F.create_map().cast(_EMPTY_MAP))
    known = session_known if session_known is not None else F.size(m) > 0
    return F.when(~known, F.array().cast("array<string>")).otherwise(
        F.filter(token_list(text), lambda t: ~F.map_contains_key(m, t))
    )


def answer_maps(answers: DataFrame, vault: DataFrame, answer_key: str, session_col: str) -> DataFrame:
    """Per answer: the map of the tokens it contains that the vault of its session knows."""
    toks = answers.select(
        answer_key,
        F.col(session_col).cast("string").alias("session_id"),
        explode_kept(F.array_distinct(token_list(F.col("text")))).alias("token"),
    ).filter(F.col("token").isNotNull())
    hits = toks.join(vault.select("session_id", "token", "value"), ["session_id", "token"], "inner")
    return hits.groupBy(answer_key).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("tmap"))


def reinject(answers: DataFrame, vault: DataFrame, answer_key: str, session_col: str, text_col: str = "text") -> DataFrame:
    """Answers (answer_key, session, text) -> + ``reinjected``, ``tmap``, token counts.

    ``n_tokens`` token-shaped strings in the answer, ``n_resolved`` of them
    replaced, ``n_unresolved`` left (M11 semantics for a non-empty map).
    """
    a = answers.withColumnRenamed(text_col, "text") if text_col != "text" else answers
    maps = answer_maps(a, vault, answer_key, session_col)
    # one row per session that still has vault entries (an empty map reports nothing); a session's
    # answers are dealt to several tasks
    known = vault.groupBy("session_id").agg(F.lit(True).alias("_known"))
    j = (
        salted_join(a.join(maps, answer_key, "left"), known, F.col(session_col).cast("string"), "session_id", F.xxhash64(answer_key))
        .withColumn("tmap", F.coalesce(F.col("tmap"), F.create_map().cast(_EMPTY_MAP)))
        .withColumn("session_known", F.coalesce(F.col("_known"), F.lit(False)))
        .drop("_known")
    )
    # the token list is computed once into a column and reused
    j = j.withColumn("_toks", token_list(F.col("text")))
    toks = F.col("_toks")
    j = j.withColumn("n_tokens", F.size(toks)).withColumn(
        "n_resolved", F.size(F.filter(toks, lambda t: F.map_contains_key(F.col("tmap"), t)))
    )
    return j.select(
        *[c for c in j.columns if c != "_toks"],
        reinject_text(F.col("text"), F.col("tmap")).alias("reinjected"),
    ).withColumn("n_unresolved", F.when(F.col("session_known"), F.col("n_tokens") - F.col("n_resolved")).otherwise(F.lit(0)))


def reinject_stats(answers_reinjected: DataFrame, session_sizes: DataFrame, answer_key: str, session_col: str) -> DataFrame:
    """Per answer — tokens of the session map, distinct ones used, missing from the response."""
    used = F.size(F.map_keys(F.col("tmap")))
    j = salted_join(
        answers_reinjected, session_sizes, F.col(session_col).cast("string"), "session_id", F.xxhash64(answer_key))
    total = F.coalesce(F.col("n_session_tokens"), F.lit(0))
    return j.select(
        answer_key,
        total.alias("total_tokens"),
        used.alias("resolved_tokens"),
        (total - used).alias("missing_tokens"),
    )


def missing_tokens(answers: DataFrame, vault: DataFrame, answer_key: str, session_col: str, text_col: str = "text") -> DataFrame:
    """Rows (answer, token) of the session's tokens that an answer does not contain.

    The rows asked for are answers x tokens of their session less those used.  The
    tokens of a session are dealt to ``SALTS`` tasks, and every answer visits each.
    """
    a = answers.select(F.col(answer_key), F.col(session_col).cast("string").alias("_sid"), F.col(text_col).alias("_text"))
    asked = a.select(answer_key, "_sid", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_asalt"))
    tokens = vault.select("session_id", "token").distinct().withColumn("_vsalt", F.pmod(F.xxhash64("token"), F.lit(SALTS)).cast("int"))
    owed = asked.join(tokens, (F.col("_sid") == F.col("session_id")) & (F.col("_asalt") == F.col("_vsalt"))).select(answer_key, "token")
    used = a.select(answer_key, explode_kept(F.array_distinct(token_list(F.col("_text")))).alias("token")).filter(F.col("token").isNotNull())
    return owed.join(used, [answer_key, "token"], "left_anti")


def token_pieces(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """(key, pos, piece, is_token) — text split into token and non-token pieces, empty ones dropped."""
    t = F.col(text_col)
    toks = token_list(t)
    pieces = F.split(t, TOKEN_RE, -1)
    inter = F.flatten(
        F.zip_with(
            pieces, toks,
            lambda g, k: F.array(
                F.struct(g.alias("piece"), F.lit(False).alias("is_token")),
                F.struct(k.alias("piece"), F.lit(True).alias("is_token")),
            ),
        )
    )
    inter = F.filter(inter, lambda p: p["piece"].isNotNull() & (F.length(p["piece"]) > 0))
    return df.select(key, posexplode_kept(inter).alias("pos", "p")).filter(F.col("p").isNotNull()).select(
        key, "pos", F.col("p.piece").alias("piece"), F.col("p.is_token").alias("is_token")
    )


def solution_extract(text: Column) -> tuple[Column, Column]:
    """(solution, message) — first tagged block, stripped; message = text without all blocks."""
    tag = R.SOLUTION_TAG
    block = f"(?s)<{tag}>(.*?)</{tag}>"
    has = text.rlike(block)
    solution = F.when(has, F.regexp_replace(F.regexp_extract(text, block, 1), r"^\s+|\s+$", ""))
    cleaned = F.regexp_replace(F.regexp_replace(text, block, ""), r"^\s+|\s+$", "")
    message = F.when(has, F.when(cleaned == "", F.lit(R.SOLUTION_DEFAULT_MESSAGE)).otherwise(cleaned)).otherwise(text)
    return solution, message
