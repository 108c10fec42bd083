"""Who may see and change what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Roles from the least to the most that they may do.
ROLES = ("reader", "contributor", "editor", "librarian", "owner")


def granted(memberships: DataFrame, grants: DataFrame, kind: str) -> DataFrame:
    """(user_id, target_id): what the groups of a user have been granted."""
    mine = grants.where(F.col("target_type") == kind).select("group_id", "target_id").distinct()
    # Users of the same groups have the same targets: these are told apart once for each set of groups.
    groups = F.array_sort(F.collect_set("group_id")).alias("_groups")
    users = memberships.where("group_id is not null").groupBy("user_id").agg(groups)
    sets = users.select("_groups").distinct().select("_groups", F.explode("_groups").alias("group_id"))
    targets = sets.join(mine, "group_id").select("_groups", "target_id").distinct()
    return users.join(targets, "_groups").select("user_id", "target_id")


def at_least(role: Column, least: str) -> Column:
    ranks = F.array(*[F.lit(r) for r in ROLES])
    return F.array_position(ranks, role) >= ROLES.index(least) + 1


def container_rights(users: DataFrame, containers: DataFrame, grants: DataFrame) -> DataFrame:
    """(user_id, target_id, sees, changes) for each user and container (id, access_level).

    Owners may all.  Open and visible containers are seen by all, private ones
    by grant.  Librarians change open ones, and others by grant.  Containers are
    a short list.
    """
    short = F.broadcast(containers.select(F.col("id").alias("target_id"), F.coalesce("access_level", F.lit("open")).alias("level")))
    # A user's grants among the few containers are one row, so pairs are made and judged where the user is.
    mine = grants.join(short.select("target_id"), "target_id", "left_semi").groupBy("user_id").agg(F.collect_set("target_id").alias("_mine"))
    pairs = users.join(mine, "user_id", "left").crossJoin(short).withColumn("granted", F.coalesce(F.array_contains("_mine", F.col("target_id")), F.lit(False)))
    owner, librarian = at_least(F.col("role"), "owner"), at_least(F.col("role"), "librarian")
    sees = owner | F.col("level").isin("open", "visible") | F.col("granted")
    changes = owner | (librarian & ((F.col("level") == "open") | F.col("granted")))
    return pairs.select("user_id", "target_id", sees.alias("sees"), changes.alias("changes"))


def paper_rights(works: DataFrame, shelf_works: DataFrame, shelves: DataFrame, granted_ids: list[int], role: str, user: int) -> DataFrame:
    """(id, changes): papers (id, owner_id) that one user may change: by role, own ones only below editor, on an open or granted shelf or on none."""
    if role == "owner":
        return works.select("id", F.lit(True).alias("changes"))
    if ROLES.index(role) < ROLES.index("contributor"):
        return works.select("id", F.lit(False).alias("changes"))
    opens = (F.coalesce("access_level", F.lit("open")) == "open") | F.col("shelf_id").isin(granted_ids)
    by = shelf_works.join(shelves, "shelf_id").groupBy(F.col("work_id").alias("id")).agg(F.max(opens).alias("_opens"))
    mine = F.lit(True) if ROLES.index(role) >= ROLES.index("editor") else F.coalesce(F.col("owner_id") == user, F.lit(False))
    return works.join(by, "id", "left").select("id", (mine & F.coalesce("_opens", F.lit(True))).alias("changes"))


def visible_files(files: DataFrame, links: DataFrame, visible: DataFrame) -> DataFrame:
    """Files that belong to no paper or to one that is visible."""
    seen = links.join(visible.select(F.col("id").alias("work_id")), "work_id", "left_semi").select("file_id").distinct().withColumn("_seen", F.lit(True))
    linked = links.select("file_id").distinct().withColumn("_linked", F.lit(True))
    return files.join(linked, "file_id", "left").join(seen, "file_id", "left").where("_linked is null or _seen").drop("_linked", "_seen")


def visible_pairs(candidates: DataFrame, visible: DataFrame) -> DataFrame:
    """Candidates (a, b) both of which are visible."""
    v = visible.select(F.col("id").alias("_id"))
    return candidates.join(v, F.col("a") == F.col("_id"), "left_semi").join(v, F.col("b") == F.col("_id"), "left_semi")
