"""Relational operators of the service's reads and writes, as transforms of DataFrames."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a page unless asked for, and at most.
PAGE, MAX_PAGE = 30, 100


def alive(rows: DataFrame, owner=None) -> DataFrame:
    """Rows that are not soft-deleted, of one owner if given."""
    rows = rows.where(F.col("deleted_at").isNull())
    return rows if owner is None else rows.where(F.col("user_id") == owner)


def withdrawn() -> Column:
    """Whether an account is withdrawn: by its flag or, in older rows, by its time alone."""
    return F.coalesce(F.col("is_deleted"), F.lit(False)) | F.col("deleted_at").isNotNull()


def encode_cursor(ts: str, key) -> str:
    return base64.urlsafe_b64encode(json.dumps({"t": ts, "i": key}).encode()).decode()


def decode_cursor(raw: str | None) -> tuple | None:
    """(time, id), or None for no cursor and for a malformed one, which means the first page."""
    try:
        got = json.loads(base64.urlsafe_b64decode((raw or "").encode()))
        return got["t"], got["i"]
    except (ValueError, KeyError, TypeError):
        return None


def keyset_page(rows: DataFrame, ts: str, key: str, limit: int | None = None, cursor: tuple | None = None) -> DataFrame:
    """The `limit` newest rows after the cursor (time, id), newest first, with has_more (whether another
    row follows).  One row more than the page is fetched to tell; Spark plans a top-k, not a sort."""
    limit = PAGE if limit is None else max(1, min(limit, MAX_PAGE))
    if cursor is not None:
        t, i = F.lit(cursor[0]).cast(rows.schema[ts].dataType), F.lit(cursor[1]).cast(rows.schema[key].dataType)
        rows = rows.where((F.col(ts) < t) | ((F.col(ts) == t) & (F.col(key) < i)))
    got = rows.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit + 1)
    place = W.partitionBy(F.lit(0)).orderBy(F.col(ts).desc(), F.col(key).desc())
    got = got.withColumn("_place", F.row_number().over(place)).withColumn("has_more", F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > limit)
    return got.where(F.col("_place") <= limit).drop("_place")


def append_page(shown: DataFrame, page: DataFrame, key: str = "id") -> DataFrame:
    """The rows of the next page that aren't shown yet: new rows move others across the edge of a page."""
    return page.join(shown.select(key), key, "left_anti")


def keyset_pages(rows: DataFrame, groups: list[str], ts: str, key: str, limit: int) -> DataFrame:
    """Every page of a walk through each group at once: page number (from 0) of each row."""
    place = W.partitionBy(*groups).orderBy(F.col(ts).desc(), F.col(key).desc())
    return rows.withColumn("page", F.floor((F.row_number().over(place) - 1) / limit).cast("long"))


def latest(rows: DataFrame, group: list[str], order: list[str], take: list[str]) -> DataFrame:
    """For each group, `take` of its last row by `order` (ties by what is taken).  An aggregation, so
    groups are summed up before the shuffle."""
    best = F.max(F.struct(*order, *(c for c in take if c not in order))).alias("_x")
    return rows.groupBy(*group).agg(best).select(*group, *(F.col("_x")[c].alias(c) for c in take))


def last_n(rows: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    place = W.partitionBy(*group).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_place", F.row_number().over(place)).where(F.col("_place") <= n).drop("_place")


def having_all(rows: DataFrame, group: str, item: str, wanted: list) -> DataFrame:
    """Groups that hold every wanted item (relational division)."""
    has = rows.where(F.col(item).isin(*wanted)).groupBy(group).agg(F.count_distinct(item).alias("_n"))
    return has.where(F.col("_n") == len(set(wanted))).select(group)


def first_wins(incoming: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The first row of each key by `order`, of keys that `existing` lacks: deleted rows in it count too.
    Rows with a null key are all kept."""
    keyed = incoming.where(" and ".join(f"{k} is not null" for k in key))
    loose = incoming.where(" or ".join(f"{k} is null" for k in key))
    place = W.partitionBy(*key).orderBy(*order)
    keyed = keyed.withColumn("_place", F.row_number().over(place)).where("_place = 1").drop("_place")
    if existing is not None:
        keyed = keyed.join(existing.select(*key).distinct(), key, "left_anti")
    return keyed.unionByName(loose)


def last_wins(existing: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Upsert: for each key the last row by `order`, incoming after existing where order ties."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    rest = [c for c in both.columns if c not in key]
    best = both.groupBy(*key).agg(F.max(F.struct(*order, "_new", *(c for c in rest if c not in order and c != "_new"))).alias("_x"))
    return best.select(*(F.col(c) if c in key else F.col("_x")[c].alias(c) for c in existing.columns))


def guarded_update(rows: DataFrame, column: str, value: Column, ids: list | None, key: str = "id") -> DataFrame:
    """rows with `column` set where it is null, and affected; ids None means all rows, an empty list none."""
    if ids is None:
        chosen = F.lit(True)
    else:
        chosen = F.col(key).isin(*ids) if ids else F.lit(False)
    hit = F.coalesce(chosen, F.lit(False)) & F.col(column).isNull()
    return rows.withColumn("affected", hit).withColumn(column, F.when(hit, value).otherwise(F.col(column)))


def islands(rows: DataFrame, group: list[str], order: list[str], label: str) -> DataFrame:
    """Number of the run of equal labels that each row is in, within its group by `order`."""
    w = W.partitionBy(*group).orderBy(*order)
    new = (~F.col(label).eqNullSafe(F.lag(label).over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_new", new.cast("long")).withColumn("island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def visible_messages(messages: DataFrame, rooms: DataFrame, user) -> DataFrame:
    """Messages of rooms that the user owns and has not deleted."""
    return messages.join(alive(rooms, user), messages["room_id"] == rooms["id"], "left_semi")


def pending_identities(identities: DataFrame, members: DataFrame, agreements: DataFrame, wanted: list[str]) -> DataFrame:
    """Pending identities without an alive member that holds every wanted agreement."""
    full = having_all(agreements.where("is_agreed"), "user_id", "agreement_type", wanted)
    ok = alive(members).join(full, "user_id", "left_semi").select("user_id")
    return identities.where("pending").join(ok, "user_id", "left_anti")


def merge_counts(rows: DataFrame, group: list[str], counts: str) -> DataFrame:
    """Maps summed key by key within each group, in order of key; groups without entries have an empty map."""
    each = rows.select(*group, F.explode_outer(counts).alias("k", "n")).groupBy(*group, "k").agg(F.sum("n").alias("n"))
    pairs = F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "n"))))
    return each.groupBy(*group).agg(F.map_from_entries(pairs).alias(counts))


def upsert_profile(old: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Profiles (user_id, nickname, nickname_at): the nickname's time changes only with the nickname."""
    n = new.select("user_id", F.col("nickname").alias("_n"), F.lit(True).alias("_there"))
    both = old.join(n, "user_id", "full_outer")
    changed = F.col("_there") & ~F.col("nickname").eqNullSafe(F.col("_n"))
    return both.select("user_id", F.when(F.col("_there"), F.col("_n")).otherwise(F.col("nickname")).alias("nickname"), F.when(changed, now).otherwise(F.col("nickname_at")).alias("nickname_at"))
