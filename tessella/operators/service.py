"""The service's small rules over rooms, accounts, results and feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from .relational import alive, latest

#: Characters of a nickname, per file and per job, agreement kinds, states that are announced.
NICKNAME, FILE_CHARS, JOB_CHARS = 20, 50_000, 150_000
AGREEMENTS = ("terms", "privacy", "marketing")
ANNOUNCED = ("COMPLETED", "FAILED")


def filled(c: Column) -> Column:
    """The text, or null if it is blank."""
    return F.nullif(strip(c), F.lit(""))


def nickname(*sources: Column) -> Column:
    """The first source that isn't blank, cut."""
    return F.substring(F.coalesce(*map(filled, sources)), 1, NICKNAME)


def display_title(title: Column, files: Column, fallback: str) -> Column:
    """The stored title, else the first file, else the fallback; empty texts don't count."""
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.try_element_at(files, F.lit(1)), F.lit("")), F.lit(fallback))


def has_provider(one: Column, several: Column, name: str) -> Column:
    return F.coalesce(one == name, F.lit(False)) | F.coalesce(F.array_contains(several, name), F.lit(False))


def failed_for_display(status: Column, level: Column) -> Column:
    """Whether a finished job shows as failed: anything but a success with a level."""
    return status.isin("SUCCEEDED", "FAILED", "CANCELED") & ~((status == "SUCCEEDED") & level.isNotNull())


def backfilled_rooms(rooms: DataFrame) -> DataFrame:
    """Older rooms lack the time of their last chat: it is that of their update, else of their creation."""
    return rooms.withColumn("last_chat_at", F.coalesce("last_chat_at", "updated_at", "created_at"))


def backfilled_notifications(notes: DataFrame) -> DataFrame:
    """Older notifications have flags in place of times: a flag becomes the time of creation."""
    at = lambda time, flag: F.coalesce(time, F.when(F.col(flag), F.col("created_at"))).alias(time)
    return notes.select(*(at(c, {"read_at": "is_read", "deleted_at": "is_deleted"}[c]) if c in ("read_at", "deleted_at") else F.col(c) for c in notes.columns if c not in ("is_read", "is_deleted")))


def touched(rooms: DataFrame, messages: DataFrame) -> DataFrame:
    """rooms with last_chat_at moved to their newest message."""
    newest = messages.groupBy(F.col("room_id").alias("_room")).agg(F.max("created_at").alias("_at"))
    joined = rooms.join(newest, rooms["id"] == newest["_room"], "left")
    return joined.withColumn("last_chat_at", F.greatest("last_chat_at", "_at")).select(*rooms.columns)


def room_texts(rooms: DataFrame, jobs: DataFrame, results: DataFrame, user) -> DataFrame:
    """(id, text) of the user's rooms: the analysed text of the job attached to the room, null if the room has
    none, the job or result is missing or another user's, or the text is blank or no string."""
    mine = alive(rooms, user).select("id", "analysis_job_id")
    job = alive(jobs, user).select(F.col("id").alias("_job"))
    text = F.try_variant_get(F.try_parse_json("payload"), "$.sanitized_text", "variant")
    text = F.when(F.schema_of_variant(text) == "STRING", F.try_variant_get(F.try_parse_json("payload"), "$.sanitized_text", "string"))
    found = results.select(F.col("job_id").alias("_of"), filled(text).alias("text"))
    out = mine.join(job, mine["analysis_job_id"] == job["_job"], "left").join(found, F.col("_job") == F.col("_of"), "left")
    return out.select("id", "text")


def length_verdict(files: DataFrame) -> DataFrame:
    """(job_id, verdict) of files (job_id, text): file_too_long, job_too_long or ok."""
    n = F.length("text")
    return files.groupBy("job_id").agg(F.when(F.max(n) > FILE_CHARS, "file_too_long").when(F.sum(n) > JOB_CHARS, "job_too_long").otherwise("ok").alias("verdict"))


def provision(identities: DataFrame, members: DataFrame, social: str) -> dict[str, DataFrame]:
    """Rows for identities (user_id, email, provider, nickname, marketing) that are no members yet: users,
    profiles, three agreements each, and a welcome notification.  Identities of the social provider set
    themselves up elsewhere.  Of rows of one user that with the smallest email (then nickname, then marketing) counts."""
    mine = identities.where(~F.coalesce(F.col("provider") == social, F.lit(False)) & F.col("user_id").isNotNull())
    new = mine.groupBy("user_id").agg(F.min(F.struct("email", "nickname", "marketing")).alias("_x")).select("user_id", "_x.*")
    new = new.join(members.select("user_id"), "user_id", "left_anti")
    name = F.coalesce(filled(F.col("nickname")), F.split_part("email", F.lit("@"), F.lit(1)))
    agreed = F.explode(F.array(*(F.struct(F.lit(k).alias("agreement_type"), (F.coalesce("marketing", F.lit(False)) if k == "marketing" else F.lit(True)).alias("is_agreed")) for k in AGREEMENTS)))
    return {
        "users": new.select("user_id", F.col("email").alias("username")),
        "profiles": new.select("user_id", name.alias("nickname")),
        "agreements": new.select("user_id", agreed.alias("a")).select("user_id", "a.*"),
        "notifications": new.select("user_id", F.lit("welcome").alias("dedupe_key")),
    }


def announcements(feed: DataFrame, seen: DataFrame | None) -> DataFrame:
    """Feed rows (id, type, created_at) to announce, oldest first: none on the first poll (seen is None), later
    those of announced types that weren't seen."""
    if seen is None:
        return feed.where(F.lit(False))
    return feed.where(F.col("type").isin(*ANNOUNCED)).join(seen.select("id"), "id", "left_anti").orderBy("created_at", "id")


def recent_turns(messages: DataFrame, n: int = 10) -> DataFrame:
    """The last n messages of each room that aren't errors."""
    place = W.partitionBy("room_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return messages.where(~F.coalesce("is_error", F.lit(False))).withColumn("_p", F.row_number().over(place)).where(F.col("_p") <= n).drop("_p")


def rooms_page_source(rooms: DataFrame, messages: DataFrame, user) -> DataFrame:
    """The user's rooms with the newest message of each, ready for a keyset page."""
    last = latest(messages, ["room_id"], ["created_at", "id"], ["content"])
    mine = alive(rooms, user)
    return mine.join(last, mine["id"] == last["room_id"], "left").select(*mine.columns, "content")


def roll_up(files: DataFrame) -> DataFrame:
    """One row for each job_id of files (job_id, redaction_scope, mask_count, coarse_mask_count, review_required):
    the sorted union of scopes, the sums of counts, and whether any file asks for a review."""
    scopes = files.select("job_id", F.explode_outer("redaction_scope").alias("s")).groupBy("job_id").agg(F.array_sort(F.collect_set("s")).alias("redaction_scope"))
    sums = files.groupBy("job_id").agg(
        F.sum(F.coalesce("mask_count", F.lit(0))).alias("mask_count"),
        F.sum(F.coalesce("coarse_mask_count", F.lit(0))).alias("coarse_mask_count"),
        F.coalesce(F.bool_or("review_required"), F.lit(False)).alias("review_required"),
    )
    return sums.join(scopes, "job_id")
