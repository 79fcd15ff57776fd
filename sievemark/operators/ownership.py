"""Who answers for a file: store rules, data subjects, stewards, and per-person file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import fixed_values as V
from sievemark.functions.strings import base_name, strip


def _first_rule(path: Column, position: int, default: str | None) -> Column:
    name = F.lower(base_name(path))
    chain = F
    for rule in V.STORE_RULES:
        chain = chain.when(name.contains(rule[0]), F.lit(rule[position]))
    return chain.otherwise(F.lit(default))


def source_type(path: Column) -> Column:
    return _first_rule(path, 1, V.DEFAULT_STORE[0])


def steward(path: Column) -> Column:
    return _first_rule(path, 2, V.DEFAULT_STORE[1])


def primary_name(findings: Column) -> Column:
    """Snippet of the surest ``name`` finding, the earliest on ties; NULL without one."""
    ranked = F.transform(
        F.filter(findings, lambda f: f["category"] == "name"),
        lambda f: F.struct((-f["confidence"]).alias("doubt"), f["start"].alias("start"),
                           f["snippet"].alias("snippet")))
    return F.array_min(ranked)["snippet"]


def resolve_ownership(files: DataFrame, users: DataFrame) -> DataFrame:
    """Add source_type, owner_user_id and master_of_data_user_id to (path, primary_name) rows.

    A personal file goes to the employee named in it, else to the first employee; a shared file
    goes to its steward, else to the first employee. The fallback employee and the stewards
    present are scalar subqueries. Files without a usable name get a key of their own; a name found
    in very many files is left to the skew handling of adaptive execution.
    """
    employees = users.filter(F.col("role") == "employee")
    first = employees.agg(F.min_by("id", F.struct("name", "id"))).scalar()
    stewards = sorted({r[2] for r in V.STORE_RULES if r[2]} | {V.DEFAULT_STORE[1]})
    present = users.filter(F.col("id").isin(*stewards)).agg(F.collect_set("id")).scalar()
    by_name = employees.groupBy(F.lower("name").alias("_target")).agg(
        F.min_by("id", F.struct("name", "id")).alias("_subject"))

    typed = files.withColumns({
        "source_type": source_type(F.col("path")), "_steward": steward(F.col("path")),
        "_first": first, "_present": present})
    personal = F.col("source_type") == V.PERSONAL_STORE
    target = F.when(personal & (F.col("primary_name") != ""), F.lower(strip(F.col("primary_name"))))
    typed = typed.withColumn(
        "_target", F.coalesce(target, F.concat(F.lit("\x00"), F.col("path"))))
    matched = typed.join(by_name, "_target", "left")
    kept_steward = F.when(F.array_contains("_present", F.col("_steward")), F.col("_steward"))
    return matched.select(
        *files.columns, "source_type",
        F.when(personal, F.coalesce("_subject", "_first")).alias("owner_user_id"),
        F.when(~personal, F.coalesce(kept_steward, F.col("_first"))).alias(
            "master_of_data_user_id"))


def responsibilities(files: DataFrame) -> DataFrame:
    """One row per file and responsible person, so that owner-or-steward is an equi-join."""
    people = F.array_distinct(F.array("owner_user_id", "master_of_data_user_id"))
    return files.withColumn("user_id", F.explode(people)).filter(F.col("user_id").isNotNull())


def findings_per_file(findings: DataFrame) -> DataFrame:
    """Counts and distinct categories per file, combined before the shuffle."""
    return findings.groupBy("file_id").agg(
        F.count("*").alias("n_findings"),
        F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


def files_by_responsible(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Flagged files of every person with their finding count and categories."""
    per_file = findings_per_file(findings).withColumnRenamed("file_id", "id")
    return responsibilities(files.join(per_file, "id"))


def files_for_user(files: DataFrame, findings: DataFrame, user_id: str,
                   newest_first: bool = False) -> DataFrame:
    """One person's flagged files. The person is filtered before anything is joined."""
    mine = files.filter((F.col("owner_user_id") == user_id)
                        | (F.col("master_of_data_user_id") == user_id))
    per_file = findings_per_file(findings).withColumnRenamed("file_id", "id")
    order = F.desc("last_modified") if newest_first else F.asc("last_modified")
    return mine.join(per_file, "id").orderBy(order, "id")


def source_breakdown(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Files, findings and bytes per store; findings are counted per file before the join."""
    per_file = findings.groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("_n"))
    return files.join(per_file, "id", "left").groupBy("source_type").agg(
        F.count("*").alias("n_files"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_findings"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def with_user_name(rows: DataFrame, users: DataFrame, key: str, out: str = "user_name") -> DataFrame:
    """Show the person's name, or the id itself for an unknown one."""
    names = users.select(F.col("id").alias(key), F.col("name").alias("_name"))
    return rows.join(names, key, "left").withColumn(
        out, F.coalesce("_name", key)).drop("_name")
