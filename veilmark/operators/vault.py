"""Vault at rest, key/value upserts and retention.

Parquet has no in-place update: an upsert appends a new version and readers
take the latest per key with ``max_by`` (a mergeable aggregate: a key holding
a third of all versions is combined map-side first, so the final step for that
key sees one partial row per map task).
Deletion is a ``left_anti`` join against an erase list.  Time is always an
explicit ``as_of`` parameter, never the wall clock inside a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def vault_key(passphrase: Column | str) -> Column:
    """SHA-256 of the passphrase -> 32-byte AES key."""
    p = F.lit(passphrase) if isinstance(passphrase, str) else passphrase
    return F.unhex(F.sha2(p, 256))


def encrypt(value: Column, passphrase: Column | str) -> Column:
    """AES-GCM with a random IV (never join or group on the ciphertext)."""
    return F.aes_encrypt(value.cast("binary"), vault_key(passphrase), F.lit("GCM"))


def decrypt(blob: Column, passphrase: Column | str) -> Column:
    """Plaintext, or null when the key is wrong or the blob is damaged."""
    return F.try_aes_decrypt(blob, vault_key(passphrase), F.lit("GCM")).cast("string")


def seal(vault: DataFrame, passphrase: str | None) -> DataFrame:
    """Vault rows with ``value_enc`` (no passphrase -> plaintext bytes, as in the original)."""
    enc = encrypt(F.col("value"), passphrase) if passphrase else F.col("value").cast("binary")
    return vault.withColumn("value_enc", enc).drop("value")


def open_vault(sealed: DataFrame, passphrase: str | None) -> DataFrame:
    """Decrypt ``value_enc``; rows that do not decrypt get a null value (S15: field dropped, row kept)."""
    val = decrypt(F.col("value_enc"), passphrase) if passphrase else F.col("value_enc").cast("string")
    return sealed.withColumn("value", val)


def session_entries(vault: DataFrame) -> DataFrame:
    """The token map of every session as rows (session_id, token, value); undecryptable values left out."""
    return vault.filter(F.col("value").isNotNull()).select("session_id", "token", "value").distinct()


def session_sizes(vault: DataFrame) -> DataFrame:
    """Entries per session (merged map-side, however large a session is)."""
    return session_entries(vault).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_tokens"))


def upsert_latest(versions: DataFrame, key: str | list[str], version: str) -> DataFrame:
    """Latest version per key wins (append-only store, read-time compaction)."""
    keys = [key] if isinstance(key, str) else list(key)
    payload = [c for c in versions.columns if c not in keys]
    latest = versions.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.col(version)).alias("_v"))
    return latest.select(*keys, "_v.*")


def lookup(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of a list of keys (an equi-join; each key once)."""
    return table.join(keys.select(key).distinct(), key, "left_semi")


def erase(table: DataFrame, erase_list: DataFrame, key: str = "session_id") -> DataFrame:
    """Rows whose key is in the erase list are removed."""
    return table.join(erase_list.select(key).distinct(), key, "left_anti")


def ttl_split(df: DataFrame, ts: Column, as_of: str, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed).  Removed iff age > ttl strictly; rows without a timestamp are kept."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)
    expired = ts.isNotNull() & (age > F.lit(ttl_seconds))
    return df.filter(~expired), df.filter(expired)


def expire_task_contexts(tasks: DataFrame, as_of: str, ttl_seconds: int) -> DataFrame:
    """Flag tasks whose last activity (else creation) is older than the TTL; once only."""
    ts = F.coalesce(F.col("last_activity_at"), F.col("created_at"))
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)
    already = F.coalesce(F.col("context_expired"), F.lit(False)) if "context_expired" in tasks.columns else F.lit(False)
    newly = (~already) & ts.isNotNull() & (age > F.lit(ttl_seconds))
    return tasks.withColumn("newly_expired", newly).withColumn("context_expired", already | newly)


def erase_expired_contexts(vault: DataFrame, tasks: DataFrame, as_of: str, ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """T2 + S14: (vault without the rows of newly expired tasks, tasks with their flag)."""
    t = expire_task_contexts(tasks, as_of, ttl_seconds)
    gone = t.where("newly_expired").select(F.col("task_id").cast("string").alias("session_id"))
    return erase(vault, gone), t


def vault_expired(vault: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) by ``expires_at < as_of``; rows without expiry are kept."""
    exp = F.col("expires_at").isNotNull() & (F.col("expires_at") < F.lit(as_of).cast("timestamp"))
    return vault.filter(~exp), vault.filter(exp)


def parse_store(rows: DataFrame, value_col: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, corrupt) — JSON payloads that do not parse are split off, not fatal."""
    parsed = rows.withColumn("_p", F.from_json(F.col(value_col), schema))
    # a payload that is not valid JSON at all (from_json alone would give a struct of nulls)
    bad = F.col(value_col).isNotNull() & F.get_json_object(F.col(value_col), "$").isNull()
    return parsed.filter(~bad), parsed.filter(bad).drop("_p")
