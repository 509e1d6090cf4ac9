r"""From a table of executable paths to the application identifiers each path can have.

Everything up to the checksum is one chain of projections: no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jumptrail.functions.crc64 import crc64
from jumptrail.functions.text import appid_hex, file_stem, upper_invariant
from jumptrail.known_folders import FOLDER_IDS, GUIDS, known_folders, reachable_paths

EXTENSION = ".automaticDestinations-ms"

# Directory pattern, stand-in; case-insensitive, applied in this order.
ENV_REWRITES = [
    (r"C:\\Windows", "%windir%"),
    (r"C:\\Users\\([^\\]+?)\\appdata\\roaming", "%APPDATA%"),
    (r"C:\\Users\\([^\\]+?)\\appdata\\local", "%LOCALAPPDATA%"),
    (r"C:\\Users\\([^\\]+?)", "%USERPROFILE%"),
    (r"C:\\Users\\public", "%PUBLIC%"),
    (r"C:\\ProgramData", "%ALLUSERSPROFILE%"),
    (r"C:\\ProgramData", "%ProgramData%"),
    (r"C:\\Program Files \(x86\)", "%ProgramFiles%"),
    (r"C:\\Program Files", "%ProgramFiles%"),
    (r"C:", "%SystemDrive%"),
]

# The two that never fire: an earlier pattern has taken every place they could match.
_SPENT = {"%PUBLIC%", "%ProgramData%"}

# Class, pattern on the upper-cased env form; the last group is the kept tail.
CLASS_PATTERNS = [
    ("system", r"(?s)%WINDIR%\\(?:SYSTEM32|SYSWOW64|SYSNATIVE)(\\.+)?\z"),
    ("windows", r"(?s)%WINDIR%(\\.+)?\z"),
    ("common_files", r"(?s)%PROGRAMFILES%\\COMMON FILES(\\.+)\z"),
    ("program_files", r"(?s)%PROGRAMFILES%(\\.+)\z"),
]

# Class, shown root, then variant and folder of each candidate.
CLASS_VARIANTS = [
    ("system", r"%windir%\system32", [("1", "System"), ("2/x86", "SystemX86")]),
    ("windows", "%windir%", [("1", "Windows")]),
    (
        "common_files",
        r"%ProgramFiles%\Common Files",
        [
            ("1", "ProgramFilesCommon"),
            ("2/X64", "ProgramFilesCommonX64"),
            ("3/x86", "ProgramFilesCommonX86"),
        ],
    ),
    (
        "program_files",
        "%ProgramFiles%",
        [("1", "ProgramFiles"), ("2/X64", "ProgramFilesX64"), ("3/x86", "ProgramFilesX86")],
    ),
]

# The env form is upper-cased, so an identifier with a lower-case letter cannot occur in it.
_KNOWN_GUID = r"\{(?:" + "|".join(re.escape(g[1:-1]) for g in GUIDS if g == g.upper()) + r")\}"

# Directory and file name: at least one character on each side of the last backslash.
_LAST_CUT = r"\A([^\n]+)\\[^\\]+\z"

# Whatever has the shape of an identifier; two of them cannot overlap.
_ANY_GUID = r"\{[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}"


def with_split(df: DataFrame) -> DataFrame:
    """Adds `dir` and `fname`, cut at the last backslash; both null where there is no such cut."""
    folder = F.nullif(F.regexp_extract("path", _LAST_CUT, 1), F.lit(""))
    name = F.when(F.col("dir").isNotNull(), F.substring_index("path", "\\", -1))
    return df.withColumn("dir", folder).withColumn("fname", name)


def env_form(folder: Column) -> Column:
    """Directory with its well-known beginnings as environment variables, in its own case."""
    for pattern, variable in ENV_REWRITES:
        if variable not in _SPENT:
            folder = F.regexp_replace(folder, "(?i)" + pattern, variable)
    return folder


def with_env_dir(df: DataFrame) -> DataFrame:
    """Adds `env_dir`; needs `dir`."""
    rewritten = df.withColumn("env_dir", env_form(F.col("dir")))
    return rewritten.withColumn("env_dir", upper_invariant("env_dir"))


def with_known_folder_form(df: DataFrame, column: str) -> DataFrame:
    """Adds `known_folder_form`: known directories of the column as folder identifiers."""
    form = F.col(column)
    for key, guid in reachable_paths():
        form = F.replace(form, F.lit(key), F.lit(guid))
    return df.withColumn("known_folder_form", form)


def with_class(df: DataFrame) -> DataFrame:
    """Adds `class`; needs `dir` and `env_dir`."""
    chain = F.when(F.coalesce("path", F.lit("")) == "", "invalid")
    chain = chain.when(F.col("dir").isNull(), "explicit")
    for name, pattern in CLASS_PATTERNS:
        chain = chain.when(F.rlike("env_dir", F.lit(pattern)), name)
    chain = chain.when(F.rlike("env_dir", F.lit(_KNOWN_GUID)), "known_guid")
    return df.withColumn("class", chain.otherwise("unresolved"))


def classified(paths: DataFrame) -> DataFrame:
    """Paths with `dir`, `fname`, `env_dir` and `class`."""
    return with_class(with_env_dir(with_split(paths)))


def _candidate(variant: str, env_path: Column, guid_path: Column) -> Column:
    return F.struct(
        F.lit(variant).alias("variant"),
        env_path.alias("env_path"),
        guid_path.alias("guid_path"),
    )


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds `candidates`, an array of 1 to 3 candidates, null where there is none."""
    tail = F.lit("")
    for name, pattern in CLASS_PATTERNS:
        # The system class drops its sub-directory.
        if name != "system":
            tail = F.when(F.col("class") == name, F.regexp_extract("env_dir", pattern, 1)).otherwise(tail)
    rest = F.concat(F.lit("\\"), F.col("fname"))
    below = F.concat("_tail", rest)

    arrays = F.when(
        F.col("class") == "explicit", F.array(_candidate("", F.col("path"), F.col("path")))
    ).when(
        F.col("class") == "known_guid",
        F.array(_candidate("", F.col("path"), F.concat("env_dir", rest))),
    )
    for name, root, variants in CLASS_VARIANTS:
        options = [
            _candidate(
                variant,
                F.concat(F.lit(root), below),
                F.concat(F.lit(FOLDER_IDS["FOLDERID_" + folder]), below),
            )
            for variant, folder in variants
        ]
        arrays = arrays.when(F.col("class") == name, F.array(*options))
    return df.withColumn("_tail", tail).withColumn("candidates", arrays).drop("_tail")


def candidates(paths: DataFrame) -> DataFrame:
    """0 to 3 rows per path: its columns, class, variant, env_path, guid_path."""
    listed = with_candidates(classified(paths))
    # The outer form, as Spark would copy the whole chain into a filter before a plain explode.
    one = listed.select(*paths.columns, "class", F.explode_outer("candidates").alias("one"))
    return one.select(*paths.columns, "class", "one.*").filter("variant IS NOT NULL")


def appids(paths: DataFrame) -> DataFrame:
    """Candidates with their AppID."""
    return candidates(paths).withColumn("appid", appid_hex(crc64("guid_path")))


def file_name(appid: Column | str) -> Column:
    """Jump-list file name of an AppID."""
    return F.concat(F.lower(appid), F.lit(EXTENSION))


def decode_name(df: DataFrame, name: str = "name") -> DataFrame:
    """Adds `appid`, the file name without its extension, and `is_hex`."""
    return df.withColumn("appid", file_stem(name)).withColumn(
        "is_hex", F.rlike("appid", F.lit(r"\A[0-9A-Fa-f]{1,16}\z"))
    )


def path_ambiguity(paths: DataFrame) -> DataFrame:
    """(class, n_candidates, n_paths), counted before the candidates become rows."""
    listed = with_candidates(classified(paths))
    n_candidates = F.size(F.coalesce("candidates", F.array())).alias("n_candidates")
    return listed.groupBy("class", n_candidates).agg(F.count("*").alias("n_paths"))


def appid_collisions(cands: DataFrame) -> DataFrame:
    """AppIDs that more than one distinct path leads to."""
    return (
        cands.groupBy("appid")
        .agg(F.count_distinct("path").alias("n_paths"))
        .filter("n_paths > 1")
    )


def named_guids(paths: DataFrame) -> DataFrame:
    """(path_id, guid): every identifier-shaped text in the env form, once per path."""
    found = F.array_distinct(F.regexp_extract_all("env_dir", F.lit(_ANY_GUID), 0))
    named = with_env_dir(with_split(paths)).select("path_id", F.explode_outer(found).alias("guid"))
    return named.filter("guid IS NOT NULL")


def guid_containment(paths: DataFrame) -> DataFrame:
    """(path_id, guid, name): known folders whose identifier the env form contains.

    Known identifiers are looked up by equality among the ones found in the text, so the
    dimension of 92 rows is a hash join and not a comparison with every row.
    """
    folders = known_folders(paths.sparkSession).select("guid", "name")
    return named_guids(paths).join(F.broadcast(folders), "guid").select("path_id", "guid", "name")
