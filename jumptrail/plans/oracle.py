"""The results of the catalog as DuckDB SQL over the given tables alone.

Written from the definitions, with DuckDB's own operators; nothing comes from a Spark result.
"""

from __future__ import annotations

from jumptrail.functions.crc64 import START, byte_table
from jumptrail.known_folders import FOLDER_IDS, FOLDER_PATHS, ROWS
from jumptrail.operators.appid import CLASS_VARIANTS, ENV_REWRITES, EXTENSION
from jumptrail.plans.catalog import PIECE, TOP
from jumptrail.plans.fixtures import VIEWS

_B = "chr(92)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_TABLE = "[" + ",".join(f"{value}::UBIGINT" for value in byte_table().tolist()) + "]"


def _upper(text: str) -> str:
    """Upper case that leaves the sharp s alone; DuckDB has a capital for it."""
    return f"array_to_string(list_transform(string_split({text}, 'ß'), lambda s: upper(s)), 'ß')"


def _crc(text: str) -> str:
    """AppID of a text expression; `tb` is the table of single-byte values."""
    units = (
        f"list_transform(string_split({_upper(text)}, ''), lambda s: (unicode(s) & 255)::UBIGINT)"
    )
    low = "xor(c >> 8, tb[(xor(c, u) & 255)::INTEGER + 1])"
    both = f"xor({low} >> 8, tb[({low} & 255)::INTEGER + 1])"
    return f"ltrim(printf('%016X', list_reduce({units}, lambda c, u: {both}, {START}::UBIGINT)), '0')"


def _env(folder: str) -> str:
    for pattern, variable in ENV_REWRITES:
        folder = f"regexp_replace({folder}, {_quoted(pattern)}, {_quoted(variable)}, 'gi')"
    return f"upper({folder})"


_SPLIT = rf"""
SELECT *, {_env("dir")} AS env_dir FROM (
 SELECT path_id, path,
  CASE WHEN regexp_matches(path, '^[^\n]+\\[^\\]+$') THEN regexp_extract(path, '^([^\n]+)\\([^\\]+)$', 1) END AS dir,
  CASE WHEN regexp_matches(path, '^[^\n]+\\[^\\]+$') THEN regexp_extract(path, '^([^\n]+)\\([^\\]+)$', 2) END AS fname
 FROM fx_paths) s
"""

_FOLDERS = (
    "SELECT * FROM (VALUES "
    + ", ".join(f"({_quoted(s)}, {i}, {_quoted(n)}, {_quoted(g)})" for s, i, n, g in ROWS)
    + ") t(folder_set, seq, name, guid)"
)

_CLASSED = r"""
SELECT *, CASE
 WHEN path IS NULL OR path = '' THEN 'invalid'
 WHEN dir IS NULL THEN 'explicit'
 WHEN regexp_matches(env_dir, '%WINDIR%\\(SYSTEM32|SYSWOW64|SYSNATIVE)(\\.+)?$') THEN 'system'
 WHEN regexp_matches(env_dir, '%WINDIR%(\\.+)?$') THEN 'windows'
 WHEN regexp_matches(env_dir, '%PROGRAMFILES%\\COMMON FILES(\\.+)$') THEN 'common_files'
 WHEN regexp_matches(env_dir, '%PROGRAMFILES%(\\.+)$') THEN 'program_files'
 WHEN EXISTS (SELECT 1 FROM folders WHERE contains(env_dir, folders.guid)) THEN 'known_guid'
 ELSE 'unresolved' END AS class
FROM split
"""


def _candidate_list() -> str:
    tails = {
        "system": "''",
        "windows": r"regexp_extract(env_dir, '%WINDIR%(\\.+)?$', 1)",
        "common_files": r"regexp_extract(env_dir, '%PROGRAMFILES%\\COMMON FILES(\\.+)$', 1)",
        "program_files": r"regexp_extract(env_dir, '%PROGRAMFILES%(\\.+)$', 1)",
    }
    arms = [
        "WHEN 'explicit' THEN [{'variant': '', 'env_path': path, 'guid_path': path}]",
        f"WHEN 'known_guid' THEN [{{'variant': '', 'env_path': path, 'guid_path': env_dir || {_B} || fname}}]",
    ]
    for name, root, variants in CLASS_VARIANTS:
        options = ", ".join(
            f"{{'variant': '{variant}', 'env_path': {_quoted(root)} || {tails[name]} || {_B} || fname, "
            f"'guid_path': {_quoted(FOLDER_IDS['FOLDERID_' + folder])} || {tails[name]} || {_B} || fname}}"
            for variant, folder in variants
        )
        arms.append(f"WHEN '{name}' THEN [{options}]")
    return "CASE class " + " ".join(arms) + " END"


_CANDS = f"""
SELECT path_id, path, class, v.variant, v.env_path, v.guid_path
FROM (SELECT *, unnest({_candidate_list()}) AS v FROM classed) c
"""

_OBSERVED = """
SELECT path_id, lower(appid) AS appid FROM cands_id WHERE variant IN ('1', '')
"""


def _observed(view: str) -> str:
    return (
        f"SELECT e.*, coalesce(o.appid, '0bad' || CAST(e.path_id AS VARCHAR)) AS appid "
        f"FROM {view} e LEFT JOIN observed o USING (path_id)"
    )


_PLACED = (
    "SELECT *, row_number() OVER (PARTITION BY host, appid ORDER BY entry_number, event_id) AS position FROM {}"
)

_ELIGIBLE = """
SELECT DISTINCT host, appid, appid || '.xml' AS file FROM entries SEMI JOIN lnks USING (host, appid)
"""

_REPORT = """
SELECT host, appid || '.xml' AS file, appid, 'DestList' AS section, position, CAST(entry_number AS VARCHAR) AS c1,
 path AS c2, CAST(last_modified AS VARCHAR) AS c3, CAST(NULL AS VARCHAR) AS c4
FROM entries_placed SEMI JOIN eligible USING (host, appid)
UNION ALL
SELECT host, appid || '.xml', appid, 'LNKs', position, CAST(position AS VARCHAR), local_base_path, name_string, arguments
FROM lnks_placed SEMI JOIN eligible USING (host, appid)
"""

_PAIRS = r"""
SELECT doc_id, length(hex_text) % 2 = 1 AS odd_length, regexp_extract_all(hex_text, '(?s)..') AS pairs FROM fx_hex
"""

# name -> (SQL, parts it reads); parts may read parts.
_PARTS: dict[str, tuple[str, list[str]]] = {
    **{name: (sql.replace("{text}", "text"), reads) for name, (sql, reads) in VIEWS.items()},
    "folders": (_FOLDERS, []),
    "split": (_SPLIT, ["fx_paths"]),
    "classed": (_CLASSED, ["split", "folders"]),
    "cands": (_CANDS, ["classed"]),
    "crc_table": (f"SELECT {_TABLE} AS tb", []),
    "cands_id": (
        f"SELECT cands.*, {_crc("guid_path")} AS appid FROM cands, crc_table",
        ["cands", "crc_table"],
    ),
    "observed": (_OBSERVED, ["cands_id"]),
    "entries": (_observed("fx_entries"), ["fx_entries", "observed"]),
    "lnks": (_observed("fx_lnks"), ["fx_lnks", "observed"]),
    "containers": (
        f"SELECT DISTINCT host, appid, appid || '{EXTENSION}' AS file FROM entries",
        ["entries"],
    ),
    "entries_placed": (_PLACED.format("entries"), ["entries"]),
    "lnks_placed": (_PLACED.format("lnks"), ["lnks"]),
    "eligible": (_ELIGIBLE, ["entries", "lnks"]),
    "report": (_REPORT, ["entries_placed", "lnks_placed", "eligible"]),
    "pairs": (_PAIRS, ["fx_hex"]),
    "latest": (
        "SELECT appid, path, max(last_modified) AS last_modified FROM entries "
        "WHERE path IS NOT NULL AND path <> '' GROUP BY appid, path",
        ["entries"],
    ),
    "apps": (
        "SELECT lower(appid) AS appid, count(DISTINCT path) AS n_matches, "
        "min({'path': path, 'variant': variant, 'class': class}) AS f FROM cands_id GROUP BY 1",
        ["cands_id"],
    ),
}


def _closure(names: list[str]) -> list[str]:
    needed: set[str] = set()

    def add(name: str) -> None:
        if name not in needed:
            needed.add(name)
            for other in _PARTS[name][1]:
                add(other)

    for name in names:
        add(name)
    order: list[str] = []

    def place(name: str) -> None:
        if name not in order:
            for other in _PARTS[name][1]:
                place(other)
            order.append(name)

    for name in _PARTS:
        if name in needed:
            place(name)
    return order


def _sql(select: str, *reads: str) -> str:
    parts = _closure(list(reads))
    if not parts:
        return select
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_PARTS[n][0]})" for n in parts) + " " + select


def _known_form() -> str:
    form = "env_dir"
    for key, guid in FOLDER_PATHS:
        form = f"replace({form}, {_quoted(key)}, {_quoted(guid)})"
    return form


def _top(source: str, order: str, limit: bool) -> str:
    rows = f"SELECT *, row_number() OVER (PARTITION BY appid ORDER BY {order}) AS rank FROM {source}"
    return f"SELECT * FROM ({rows}) r" + (f" WHERE rank <= {TOP}" if limit else "")


def _rank(order: str) -> str:
    return (
        "SELECT host, appid, event_id, row_number() OVER "
        f"(PARTITION BY host, appid ORDER BY {order}, event_id) AS rank FROM entries"
    )


def _escaped(cell: str) -> str:
    return (
        f"'<td>' || replace(replace(replace(coalesce({cell}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</td>'"
    )


_HTML = f"""
SELECT host, file, appid, section, 1 AS part, position,
 '<tr>' || {_escaped("c1")} || {_escaped("c2")} || {_escaped("c3")}
 || CASE section WHEN 'LNKs' THEN {_escaped("c4")} ELSE '' END || '</tr>' AS html FROM report
UNION ALL
SELECT host, file, appid, 'DestList', 0, 0, '<h2>' || file || '</h2><h2>DestList</h2><table border="1" id="_t' || appid || '"><tr bgcolor="#9acd32"><th>Entry #</th><th>Path</th><th>Last Modified</th></tr>' FROM eligible
UNION ALL
SELECT host, file, appid, 'LNKs', 0, 0, '<h2>LNKs</h2><table border="1"><tr bgcolor="#9acd32"><th>Entry #</th><th>Path</th><th>Name string</th><th>Command line arguments</th></tr>' FROM eligible
UNION ALL
SELECT host, file, appid, s.section, 2, 0, '</table>' FROM eligible, (VALUES ('DestList'), ('LNKs')) s(section)
"""

_BLANKS = "[' ', chr(9), chr(10), chr(11), chr(12), chr(13)]"
_PAIR_VALUE = (
    "CASE WHEN regexp_matches(p, '^[0-9A-Fa-f]{2}$') THEN upper(p)"
    f" WHEN list_contains({_BLANKS}, p[1]) AND regexp_matches(p[2], '^[0-9A-Fa-f]$') THEN '0' || upper(p[2])"
    f" WHEN list_contains({_BLANKS}, p[2]) AND regexp_matches(p[1], '^[0-9A-Fa-f]$') THEN '0' || upper(p[1])"
    " ELSE '00' END"
)

_ID = r"""
CASE WHEN lower(id_text[1:2]) = '0x' THEN
  CASE WHEN regexp_matches(id_text, '^0[xX] *0*[0-9A-Fa-f]{1,8} *$')
   THEN CAST('0x' || regexp_extract(id_text, '^0[xX] *0*([0-9A-Fa-f]{1,8}) *$', 1) AS BIGINT) ELSE 0 END
 WHEN regexp_matches(id_text, '^ *\+?[0-9]+ *$') THEN
  CASE WHEN coalesce(TRY_CAST(trim(id_text, ' +') AS HUGEINT), 4294967296) <= 4294967295 THEN TRY_CAST(trim(id_text, ' +') AS BIGINT) ELSE 0 END
 ELSE 0 END
"""

_DUMP = r"""
SELECT doc_id, 16 * (nr - 1) AS "offset", rpad(array_to_string(b, ' '), 50, ' ') AS hex,
 array_to_string(list_transform(list_transform(b, lambda x: CAST('0x' || x AS INTEGER)),
  lambda v: CASE WHEN v > 32 AND v < 254 AND v <> 127 THEN chr(v) ELSE '.' END), '') AS text
FROM (SELECT doc_id, regexp_extract_all(unnest(p), '..') AS b, generate_subscripts(p, 1) AS nr
 FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '.{1,32}') AS p FROM documents) d) r
"""

ORACLE: dict[str, str] = {
    "path_split": _sql("SELECT path_id, dir, fname FROM split", "split"),
    "env_form": _sql("SELECT path_id, env_dir FROM split", "split"),
    "known_folder_form": _sql(
        f"SELECT path_id, {_known_form()} AS known_folder_form FROM split", "split"
    ),
    "path_class": _sql("SELECT path_id, class FROM classed", "classed"),
    "candidates": _sql("SELECT * FROM cands", "cands"),
    "appid_candidates": _sql("SELECT * FROM cands_id", "cands_id"),
    "appid_sql": _sql("SELECT path_id, variant, appid FROM cands_id", "cands_id"),
    "jumplist_names": _sql(
        f"SELECT path_id, variant, lower(appid) || '{EXTENSION}' AS name FROM cands_id", "cands_id"
    ),
    "decode_names": _sql(
        "SELECT host, file AS name, appid, regexp_matches(appid, '^[0-9A-Fa-f]{1,16}$') AS is_hex FROM containers",
        "containers",
    ),
    "path_ambiguity": _sql(
        "SELECT class, n_candidates::INTEGER AS n_candidates, count(*) AS n_paths FROM ("
        "SELECT classed.path_id, class, (SELECT count(*) FROM cands WHERE cands.path_id = classed.path_id) AS n_candidates "
        "FROM classed) n GROUP BY 1, 2",
        "classed", "cands",
    ),
    "appid_collisions": _sql(
        "SELECT appid, count(DISTINCT path) AS n_paths FROM cands_id GROUP BY appid HAVING count(DISTINCT path) > 1",
        "cands_id",
    ),
    "guid_containment": _sql(
        "SELECT DISTINCT path_id, guid, name FROM split, folders WHERE contains(env_dir, guid)",
        "split", "folders",
    ),
    "known_guids": _sql(
        "SELECT guid, (SELECT count(*) FROM split WHERE contains(env_dir, g.guid)) AS n_paths "
        "FROM (SELECT DISTINCT guid FROM folders) g",
        "split", "folders",
    ),
    "identify_apps": _sql(
        "SELECT c.host, c.file, c.appid, a.f.path AS path, a.f.class AS class, a.f.variant AS variant, "
        "coalesce(a.n_matches, 0) AS n_matches FROM containers c LEFT JOIN apps a USING (appid)",
        "containers", "apps",
    ),
    "candidate_matches": _sql(
        "SELECT DISTINCT lower(c.appid) AS appid, path, class, variant, n_containers FROM cands_id c JOIN "
        "(SELECT appid, count(*) AS n_containers FROM containers GROUP BY appid) o ON o.appid = lower(c.appid)",
        "containers", "cands_id",
    ),
    "unidentified": _sql(
        "SELECT host, file, appid FROM containers WHERE appid NOT IN (SELECT appid FROM apps)",
        "containers", "apps",
    ),
    "resolve_processes": _sql(
        "SELECT host, pid, process_name, variant, appid, CASE WHEN appid IS NULL THEN 'no AppID' END AS error "
        "FROM fx_processes LEFT JOIN cands_id USING (path_id)",
        "fx_processes", "cands_id",
    ),
    "process_by_id": _sql(
        f"SELECT host, pid, process_name FROM fx_processes WHERE pid IN (SELECT {_ID} FROM fx_ids) AND pid <> 0",
        "fx_processes", "fx_ids",
    ),
    "window_by_id": _sql(
        "SELECT host, pid AS window_id, process_name FROM fx_processes "
        f"WHERE pid IN (SELECT {_ID} FROM fx_ids) AND pid <> 0",
        "fx_processes", "fx_ids",
    ),
    "parse_ids": _sql(f"SELECT row_id, id_text, {_ID} AS id FROM fx_ids", "fx_ids"),
    "container_counts": _sql(
        "SELECT host, appid, coalesce(n_entries, 0) AS n_entries, coalesce(n_lnks, 0) AS n_lnks FROM "
        "(SELECT host, appid, count(*) AS n_entries FROM entries GROUP BY ALL) FULL JOIN "
        "(SELECT host, appid, count(*) AS n_lnks FROM lnks GROUP BY ALL) USING (host, appid)",
        "entries", "lnks",
    ),
    "recent_docs": _sql(_top("latest", "last_modified DESC, path", False), "latest"),
    "recent_docs_top": _sql(_top("latest", "last_modified DESC, path", True), "latest"),
    "frequent_docs": _sql(
        _top(
            "(SELECT appid, path, count(*) AS n FROM entries WHERE path <> '' GROUP BY ALL) c",
            "n DESC, path",
            True,
        ),
        "entries",
    ),
    "usage_summary": _sql(
        "SELECT host, appid, count(*) AS n, count(DISTINCT path) AS n_docs, min(last_modified) AS first_seen, "
        "max(last_modified) AS last_seen FROM entries GROUP BY host, appid",
        "entries",
    ),
    "mac_attribution": _sql(
        "SELECT droid_uuid[25:36] AS mac, host, count(*) AS n, min(last_modified) AS first_seen, "
        "max(last_modified) AS last_seen FROM fx_droids WHERE droid_uuid[15] = '1' GROUP BY 1, 2",
        "fx_droids",
    ),
    "activity_by_day": _sql(
        "SELECT host, CAST(CAST(last_modified AS DATE) AS TIMESTAMP) AS day, count(*) AS n FROM fx_entries GROUP BY 1, 2",
        "fx_entries",
    ),
    "timeline_gaps": _sql(
        "SELECT *, date_diff('microsecond', prev, last_modified) / 1000000.0::DOUBLE AS gap_seconds FROM ("
        "SELECT host, event_id, last_modified, path, lag(last_modified) OVER (PARTITION BY host ORDER BY last_modified, event_id) AS prev "
        "FROM fx_entries) l",
        "fx_entries",
    ),
    "admissible_adds": _sql(
        "SELECT event_id, host, path FROM fx_entries WHERE lower(path) LIKE '%.txt' AND path IN (SELECT path FROM fx_known_files)",
        "fx_entries", "fx_known_files",
    ),
    "top_entries": _sql(
        f"SELECT event_id, host, path, last_modified FROM fx_entries ORDER BY last_modified DESC, host, event_id LIMIT {TOP}",
        "fx_entries",
    ),
    "sort_by_number": _sql(_rank("entry_number"), "entries"),
    "sort_by_number_desc": _sql(_rank("entry_number DESC"), "entries"),
    "sort_by_path": _sql(_rank("lower(coalesce(path, ''))"), "entries"),
    "sort_by_modified": _sql(_rank("CAST(last_modified AS VARCHAR) DESC"), "entries"),
    "sort_all_by_path": _sql(
        "SELECT event_id, row_number() OVER (ORDER BY lower(coalesce(path, '')), host, event_id) AS rank FROM fx_entries",
        "fx_entries",
    ),
    "container_inventory": _sql(
        f"SELECT host, appid, appid || '{EXTENSION}' AS file, sum(strlen(coalesce(path, '')) + 1)::BIGINT AS length "
        "FROM entries GROUP BY host, appid",
        "entries",
    ),
    "reference_export": _sql(
        "SELECT host, row_number() OVER (PARTITION BY host ORDER BY file) AS place, file, appid, 1 AS n_documents, "
        "(SELECT count(*) FROM entries e WHERE e.host = x.host AND e.appid = x.appid) AS n_entries, "
        "(SELECT count(*) FROM lnks l WHERE l.host = x.host AND l.appid = x.appid) AS n_lnks FROM eligible x",
        "eligible", "entries", "lnks",
    ),
    "index_order": _sql("SELECT host, file, appid, row_number() OVER (ORDER BY host, file) AS place FROM eligible", "eligible"),
    "hosts_union": _sql(
        "SELECT host, appid || '.xml' AS file, position, path FROM entries_placed SEMI JOIN eligible USING (host, appid) "
        "WHERE host IN ('HOST-0', 'HOST-1')",
        "entries_placed", "eligible",
    ),
    "file_accounts": _sql(
        "SELECT host, file, CASE WHEN host IN ('HOST-2', 'HOST-3', 'HOST-5') THEN 0 ELSE 1 END AS n_documents, "
        "CASE WHEN host IN ('HOST-2', 'HOST-3', 'HOST-5') THEN 1 ELSE 0 END AS n_rejects, CASE WHEN host IN ('HOST-2', 'HOST-3', 'HOST-5') "
        "THEN 0 ELSE (SELECT count(*) FROM entries e WHERE e.host = x.host AND e.appid = x.appid) END AS n_entries, "
        "CASE host WHEN 'HOST-2' THEN 'no document' WHEN 'HOST-3' THEN 'no document' WHEN 'HOST-5' THEN 'empty file' ELSE '' END AS reason "
        "FROM eligible x",
        "eligible", "entries",
    ),
    "encoded_entries": _sql(
        "SELECT host, appid || '.xml' AS file, position, CASE WHEN host = 'HOST-4' THEN replace(path, 'Doc', 'D\u00f6c') ELSE path END AS path "
        "FROM entries_placed SEMI JOIN eligible USING (host, appid) WHERE host NOT IN ('HOST-2', 'HOST-3', 'HOST-5')",
        "entries_placed", "eligible",
    ),
    "incomplete_containers": _sql(
        f"SELECT host, appid || '.xml' AS file, (n + {PIECE - 1}) // {PIECE} - CASE WHEN host = 'HOST-5' THEN 1 ELSE 0 END AS n_documents, "
        "CASE WHEN host = 'HOST-3' THEN 1 ELSE 0 END AS n_broken FROM (SELECT host, appid, count(*) AS n FROM entries GROUP BY ALL) c "
        f"WHERE host = 'HOST-3' AND n > {PIECE} OR host = 'HOST-5' AND n > {2 * PIECE}",
        "entries",
    ),
    "whole_containers": _sql(
        "SELECT host, appid || '.xml' AS file, position, path FROM entries_placed JOIN "
        "(SELECT host, appid, count(*) AS n FROM entries GROUP BY ALL) c USING (host, appid) "
        f"WHERE NOT (host = 'HOST-3' AND n > {PIECE} OR host = 'HOST-5' AND n > {2 * PIECE})",
        "entries_placed", "entries",
    ),
    "stream_rescan": _sql(
        "SELECT host, appid || '.xml' AS file, position, CASE WHEN host = 'HOST-1' THEN replace(path, 'Doc', 'Note') ELSE path END AS path "
        "FROM entries_placed SEMI JOIN eligible USING (host, appid)",
        "entries_placed", "eligible",
    ),
    "entries_xml_roundtrip": _sql(
        "SELECT host, appid, appid || '.xml' AS file, position, entry_number, path, last_modified FROM entries_placed",
        "entries_placed",
    ),
    "lnks_xml_roundtrip": _sql(
        "SELECT host, appid, appid || '.xml' AS file, position, local_base_path, name_string, arguments FROM lnks_placed",
        "lnks_placed",
    ),
    "lnk_positions": _sql(
        "SELECT host, appid || '.xml' AS file, position, local_base_path FROM lnks_placed", "lnks_placed"
    ),
    "eligible_containers": _sql("SELECT * FROM eligible", "eligible"),
    "index_roundtrip": _sql("SELECT * FROM eligible", "eligible"),
    "index_join": _sql(
        "SELECT host, appid || '.xml' AS file, position, path FROM entries_placed SEMI JOIN eligible USING (host, appid)",
        "entries_placed", "eligible",
    ),
    "report_rows": _sql("SELECT * FROM report", "report"),
    "report_html": _sql(_HTML, "report"),
    "custom_report": _sql(
        "SELECT host, file, section, count(*) AS n_rows, count(c2) AS n_paths FROM report GROUP BY 1, 2, 3",
        "report",
    ),
    "rejects": _sql(
        "SELECT DISTINCT host || '/' || appid || '.xml/' || CAST((position - 1) // 1000 * 1000 AS VARCHAR) AS file, true AS has_text "
        "FROM entries_placed WHERE host = 'HOST-3'",
        "entries_placed",
    ),
    "crc64_values": _sql(
        f"SELECT doc_id, {_crc("text")} AS crc FROM documents, crc_table", "crc_table"
    ),
    "invariant_upper": f"SELECT doc_id, {_upper('text')} AS upper_text FROM documents",
    "hexdump": _DUMP,
    "reverse_bytes": (
        "SELECT doc_id, array_to_string(list_reverse(p), '') AS whole, "
        "CASE WHEN len(p) >= 100 THEN array_to_string(list_reverse(p[101:]), '') END AS after_100 FROM ("
        "SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS p FROM documents) b"
    ),
    "bytes_from_hex": _sql(
        f"SELECT doc_id, CASE WHEN NOT odd_length THEN array_to_string(list_transform(pairs, lambda p: {_PAIR_VALUE}), '') END AS bytes, "
        "odd_length FROM pairs",
        "pairs",
    ),
    "stream_ingest": _sql(
        "SELECT host, appid, appid || '.xml' AS file, position, entry_number, path, last_modified FROM entries_placed",
        "entries_placed",
    ),
    "survivors": _sql(
        "SELECT host, appid || '.xml' AS file, position, path FROM entries_placed WHERE host <> 'HOST-3'", "entries_placed"
    ),
    "stream_ingest_lnks": _sql(
        "SELECT host, appid, appid || '.xml' AS file, position, local_base_path, name_string, arguments FROM lnks_placed",
        "lnks_placed",
    ),
    "stream_recents": _sql(
        "SELECT appid, path, max(last_modified) AS last_modified FROM entries WHERE lower(path) LIKE '%.txt' "
        "AND path IN (SELECT path FROM fx_known_files) GROUP BY 1, 2",
        "entries", "fx_known_files",
    ),
}
