"""Who may see what, and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def role_grants(grants: DataFrame, roles: DataFrame) -> DataFrame:
    """Grants (role_id, org_id, ...) with the role's name, within a tenant."""
    return grants.join(roles.select("role_id", "org_id", "role"), ["role_id", "org_id"])


def scopes(grants: DataFrame, resource: str, action: str) -> tuple[DataFrame, DataFrame]:
    """(people without limits, (person, id) of the others): a person's scopes unite, and one grant without a scope lifts all limits. Ids stay rows, so a scope of any size is no array."""
    own = grants.where((F.col("resource") == resource) & (F.col("action") == action))
    every = own.where("scope is null").select("person").distinct()
    some = own.join(every, "person", "left_anti").select("person", F.explode(F.split("scope", ",")).alias("id")).distinct()
    return every, some


def permitted(grants: DataFrame, rows: DataFrame, resource: str, action: str, key: str) -> DataFrame:
    """(person, row) for what each person may see. Limited scopes join by id; only people without limits meet every row, which is what they may see."""
    every, some = scopes(grants, resource, action)
    limited = rows.join(some, rows[key].cast("string") == F.col("id")).select("person", *rows.columns)
    return limited.unionByName(rows.crossJoin(every).select("person", *rows.columns))


# Why a request is refused, in the order in which it is asked.
NO_ROLE, NO_ACTION, NO_SCENE, NO_DOCUMENT = "no_role_assignment", "action_not_permitted", "scene_not_in_scope", "document_not_in_scope"


def decisions(requests: DataFrame, roles: DataFrame, matrix: DataFrame, scenes: DataFrame, limits: DataFrame) -> DataFrame:
    """requests with `reason`: null where they are permitted, else the first thing that forbids them.

    requests: person, resource, action, scene (null: the resource's own), document_id (null: none). roles: person, role.
    matrix: role, resource, action. scenes: resource, scene. limits: person, kind (`scene` or `document`), id: a person with
    limits of a kind may reach those alone (a null id limits to nothing), others all; scopes stay rows, whatever their size.
    """
    flag = lambda df, keys, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    allowed = roles.join(matrix, "role")
    rows = requests.join(scenes.withColumnRenamed("scene", "own_scene"), "resource", "left").withColumn("asked", F.coalesce("scene", "own_scene"))
    rows = rows.join(flag(roles, ["person"], "known"), "person", "left").join(flag(allowed, ["person", "resource", "action"], "may"), ["person", "resource", "action"], "left")
    for kind, column in (("scene", "asked"), ("document", "document_id")):
        own = limits.where(F.col("kind") == kind)
        rows = rows.join(flag(own, ["person"], f"{kind}_limited"), "person", "left")
        rows = rows.join(flag(own.where("id is not null").select("person", F.col("id").alias(column)), ["person", column], f"{kind}_in"), ["person", column], "left")
    out = lambda kind, column: F.col(column).isNotNull() & F.col(f"{kind}_limited").isNotNull() & F.col(f"{kind}_in").isNull()
    reason = F.when(F.col("known").isNull(), NO_ROLE).when(F.col("may").isNull(), NO_ACTION).when(out("scene", "asked"), NO_SCENE).when(out("document", "document_id"), NO_DOCUMENT)
    return rows.select(*requests.columns, reason.alias("reason"))


def page(rows: DataFrame, order: list[Column], size: int, offset: int) -> DataFrame:
    """One page in a total order, with the number of all rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))
