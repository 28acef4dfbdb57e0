"""Row-level access and permissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Permissions in their order, and what each implies.
ORDER = ("READ", "WRITE", "REVIEW", "ADMIN")
IMPLIED = {"READ": ("READ",), "WRITE": ("READ", "WRITE"), "REVIEW": ("READ", "REVIEW"), "ADMIN": ORDER}


def visible(rows: DataFrame, grants: DataFrame, key: str, user: str, roles: list[str], allowed: list[str], is_admin: bool = False) -> DataFrame:
    """Rows that an administrator, the user's own grant or one of the roles' grants lets through.

    ``grants`` has the key, subject_type, subject_id and permissions.
    """
    if is_admin:
        return rows
    mine = (F.col("subject_type") == "USER") & (F.col("subject_id") == user) | (F.col("subject_type") == "ROLE") & F.col("subject_id").isin(roles)
    useful = grants.filter(mine & F.arrays_overlap("permissions", F.array(*[F.lit(p) for p in allowed])))
    return rows.join(useful.select(key).distinct(), key, "left_semi")


def permission_union(grants: DataFrame, *by: str) -> DataFrame:
    """All permissions of a group's grants with those they imply, in fixed order."""
    implied = F.create_map(*[x for p in ORDER for x in (F.lit(p), F.array(*[F.lit(q) for q in IMPLIED[p]]))])
    each = grants.select(*by, F.explode("permissions").alias("p")).select(*by, F.explode(F.coalesce(implied[F.col("p")], F.array().cast("array<string>"))).alias("p"))
    got = each.distinct().groupBy(*by).agg(F.collect_set("p").alias("has"))
    return got.select(*by, F.filter(F.array(*[F.lit(p) for p in ORDER]), lambda p: F.array_contains("has", p)).alias("permissions"))


def in_scope(requested: Column, allowed: Column) -> Column:
    """Allowed ones of those requested, in the order of the request; all allowed if nothing was asked for."""
    return F.when(requested.isNull(), allowed).otherwise(F.array_intersect(requested, allowed))


def all_allowed(sources: Column, allowed: Column) -> Column:
    """Whether every source may still be read; fails closed on nulls."""
    return F.coalesce(F.size(F.array_except(sources, allowed)) == 0, F.lit(False))


def too_few_admins(grants: DataFrame, *by: str, least: int = 1) -> DataFrame:
    """Groups whose grants have fewer administrators than needed."""
    return grants.groupBy(*by).agg(F.count_if(F.array_contains("permissions", "ADMIN")).alias("admins")).filter(F.col("admins") < least)


def mapped_roles(tokens: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """user, role: the distinct roles that a user's external groups map to; unknown groups map to none."""
    table = tokens.sparkSession.createDataFrame([(g, r) for g, roles in mapping.items() for r in roles], "grp string, role string")
    return tokens.select("user", F.explode("groups").alias("grp")).join(F.broadcast(table), "grp").select("user", "role").distinct()
