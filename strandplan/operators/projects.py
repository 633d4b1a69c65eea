"""Saved projects, their owners and sessions; map layers and trees of map nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(projects: DataFrame, user_id: Column | None, skip: int = 0, take: int = 100) -> DataFrame:
    """A user's projects (all, for an administrator: None), the last updated first, then by id."""
    seen = projects if user_id is None else projects.where(F.col("user_id") == user_id)
    return seen.orderBy(F.desc("updated_at"), "id").offset(skip).limit(take)


def access(requests: DataFrame, projects: DataFrame) -> DataFrame:
    """``requests``(project_id, user_id, is_admin) with status 404 (no such project), 403 (not its owner) or 200."""
    owner = projects.select(F.col("id").alias("project_id"), F.col("user_id").alias("__owner"), F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), 404).when(~F.col("is_admin") & ~F.col("__owner").eqNullSafe(F.col("user_id")), 403).otherwise(200)
    return requests.join(owner, "project_id", "left").withColumn("status", status).drop("__owner", "__known")


def sessions_with_users(sessions: DataFrame, users: DataFrame, now: Column | None = None) -> DataFrame:
    """Sessions with their user; with ``now`` those that have expired are left out."""
    known = sessions if now is None else sessions.where(F.col("expires_at") > now)
    return known.join(users, known.user_id == users.id).select(known["*"], users.email, users.role)


def updated(projects: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """Projects after changes(id, set array<string>, columns): a column changes only if it is in ``set``, even to null."""
    new = changes.select("id", F.col("set").alias("__set"), *(F.col(c).alias(f"__{c}") for c in columns))
    kept = [F.when(F.array_contains("__set", c), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in projects.columns]
    return projects.join(new, "id", "left").select(*kept)


def of_known_users(owned: DataFrame, users: DataFrame) -> DataFrame:
    """Rows(user_id, ...) after users are deleted: those of users that are left, and those of no user."""
    left = users.select(F.col("id").alias("__user"))
    return owned.where("user_id IS NULL").unionByName(owned.join(left, owned.user_id == F.col("__user"), "left_semi"))


def upserted(layers: DataFrame, changed: DataFrame, key: str = "id") -> DataFrame:
    """Layers without those that are replaced, and the new ones."""
    return layers.join(changed, key, "left_anti").unionByName(changed)


def visible_features(features: DataFrame, flags: dict[str, Column], shown: dict[str, str]) -> DataFrame:
    """Features that no switched-off class hides; ``shown`` names the switch column of a flag.

    Features of the layer "boundary" are always shown, as are those of no class.
    """
    hidden = F.lit(False)
    for flag, switch in shown.items():
        hidden = hidden | (flags[flag] & ~F.col(switch))
    return features.where((F.col("layer_id") == "boundary") | ~hidden)


def visible_in_tree(features: DataFrame, tree: DataFrame) -> DataFrame:
    """Features but for those whose node in tree(node_id, visible) is switched off; others stay."""
    off = tree.where(~F.col("visible")).select(F.col("node_id").alias("__node"))
    return features.join(off, features.node_id == F.col("__node"), "left_anti")


def toggled(tree: DataFrame, node_id: Column) -> DataFrame:
    """tree(node_id, path, visible) after a node is toggled: all below it take its new state.  path ends with the node."""
    state = tree.where(F.col("node_id") == node_id).select((~F.col("visible")).alias("__state"))
    joined = tree.join(F.broadcast(state.limit(1)), F.array_contains("path", node_id), "left")
    return joined.withColumn("visible", F.coalesce("__state", "visible")).drop("__state")


def role_layers(layers: DataFrame, *by: str) -> DataFrame:
    """(by, role, id): the first visible layer, by ordinal, that serves as boundary or as POP."""
    low = F.lower("name")
    role = F.when(low.contains("boundary"), "boundary").when(low.contains("pop") | low.contains("olt"), "pop")
    known = layers.where(F.col("visible") & ~F.col("is_design")).withColumn("role", role).where("role IS NOT NULL")
    return known.groupBy(*by, "role").agg(F.min_by("id", "ordinal").alias("id"))
