"""Which application does an observed container or process belong to?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jumptrail.functions.ids import parse_id
from jumptrail.operators.lookup import join_lookup

NO_APPID = "no AppID"


def applications(cands: DataFrame) -> DataFrame:
    """One row per AppID: its first candidate by path and how many distinct paths lead to it."""
    return cands.groupBy(F.lower("appid").alias("appid")).agg(
        F.min(F.struct("path", "variant", "class")).alias("first"),
        F.count_distinct("path").alias("n_matches"),
    )


def identify_apps(containers: DataFrame, cands: DataFrame) -> DataFrame:
    """One row per container with the application its AppID stands for.

    Candidates are brought to one row per AppID first, so the result never outgrows the containers.
    `candidate_matches` lists all the paths.
    """
    observed = containers.select("host", "file", F.lower("appid").alias("appid"))
    known = applications(cands).select(
        "appid", "first.path", "first.class", "first.variant", "n_matches"
    )
    return join_lookup(observed, known, ["appid"], "left").select(
        "host", "file", "appid", "path", "class", "variant",
        F.coalesce("n_matches", F.lit(0)).alias("n_matches"),
    )


def candidate_matches(containers: DataFrame, cands: DataFrame) -> DataFrame:
    """Every candidate path of an observed AppID, with the number of containers observed."""
    observed = containers.groupBy(F.lower("appid").alias("appid")).agg(
        F.count("*").alias("n_containers")
    )
    paths = cands.select(F.lower("appid").alias("appid"), "path", "class", "variant").distinct()
    return join_lookup(paths, observed, ["appid"], "inner").select(
        "appid", "path", "class", "variant", "n_containers"
    )


def unidentified(containers: DataFrame, cands: DataFrame) -> DataFrame:
    """Containers whose AppID no candidate has."""
    observed = containers.select("host", "file", F.lower("appid").alias("appid"))
    known = cands.select(F.lower("appid").alias("appid")).distinct()
    return join_lookup(observed, known, ["appid"], "left_anti").select("host", "file", "appid")


def resolve_processes(processes: DataFrame, cands: DataFrame) -> DataFrame:
    """Every process with the AppIDs of its executable; an error text where there is none.

    Where a table repeats a path_id, a process has the AppIDs of all its paths. Candidates without a path_id belong to
    no process.
    """
    each = cands.filter(F.col("path_id").isNotNull()).select("path_id", "variant", "appid").distinct()
    per_path = each.groupBy("path_id").agg(F.collect_list(F.struct("variant", "appid")).alias("found"))
    return (
        join_lookup(processes, per_path, ["path_id"], "left")
        .select("host", "pid", "process_name", F.explode_outer("found").alias("one"))
        .select(
            "host",
            "pid",
            "process_name",
            "one.variant",
            "one.appid",
            F.when(F.col("one").isNull(), NO_APPID).alias("error"),
        )
    )


def select_process(df: DataFrame, id_text: str, key: str = "pid") -> DataFrame:
    """Rows whose key is the id written in the text; a bad id or 0 selects nothing."""
    wanted = parse_id(F.lit(id_text))
    return df.filter((F.col(key) == wanted) & (wanted != 0))


def select_processes(df: DataFrame, ids: DataFrame, key: str = "pid") -> DataFrame:
    """`select_process` for a table of id texts: rows whose key any of them names."""
    wanted = ids.select(parse_id("id_text").alias(key)).filter(F.col(key) != 0).distinct()
    return join_lookup(df, wanted, [key], "left_semi")
