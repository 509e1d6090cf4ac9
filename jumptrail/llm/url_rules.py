"""URL filters: pattern rules found through their rarest literal token.

A rule is literal text in which `*` stands for anything, matched against the host (lower-cased) followed by the
rest of the URL as it is. `||` at the start means: at the host or at any domain above it. Every whole run of
letters and digits inside a rule is one of its literal tokens; a run at an open end or beside `*` may be only part
of a longer one and is none. A first pass counts, over all URLs, the tokens that occur in rules. Each rule is then
filed under its rarest token. A URL fetches the rules filed under its own tokens, and only those run their regular
expression. Rules without a whole token are tried on every URL.

Of the ranked rules that fit, the longest decides; if none fits, any plain block rule that fits blocks; else the
URL is allowed.

Defined results: a URL that is null or has no `://` has an empty host and path, fits no rule and is allowed.
Repeated rows are judged each; an empty table gives an empty table; other columns do not matter.
The index is as large as the list of rules, which the caller writes; it is never a function of the data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"[A-Za-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """`ranked` rules say allow or block by length; others only block what no ranked rule decides."""

    text: str
    verdict: str = "block"
    ranked: bool = False

    @property
    def pattern(self) -> str:
        body = self.text.removeprefix("||")
        anchor = r"\A(?:[^/?#]*\.)?" if body != self.text else ""
        return anchor + ".*".join(re.escape(part) for part in body.split("*"))

    @property
    def tokens(self) -> list[str]:
        """Runs of letters and digits that must stand whole in any URL the rule fits."""
        anchored = self.text.startswith("||")
        body = self.text.removeprefix("||")
        found = []
        for run in TOKEN.finditer(body):
            left = anchored if run.start() == 0 else body[run.start() - 1] != "*"
            right = run.end() < len(body) and body[run.end()] != "*"
            if left and right:
                found.append(run.group())
        return found


# The rules of the query, as (verdict, host and path): fixed values of its contract.
CONTRACT = (
    Rule("||org/", "allow", True),
    Rule("||example.org/es/", "block", True),
    Rule("||example.org/en/1", "block", True),
    Rule("||com/fr/", "allow", True),
    Rule("||com/de/", "block", True),
)

# What the query blocks where none of those fits.
BLOCKED = (
    Rule("||adult-"),
    Rule("||casino-"),
    Rule("||spam-farm."),
    Rule("||ads-track."),
    Rule("||free-bets."),
    Rule(".exe?"),
    Rule("/login/"),
    Rule("/cart/"),
    Rule("?sessionid="),
    Rule("&sessionid="),
)

RULES = CONTRACT + BLOCKED


def host_of(url: str | None) -> tuple[str, str, str]:
    """Host, path and everything after the host; empty where there is no `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    ends = [at for at in map(rest.find, "/?#") if at >= 0]
    host, tail = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    host = host.encode().lower().decode()
    stops = [at for at in map(tail.find, "?#") if at >= 0]
    return host, tail[: min(stops)] if stops else tail, tail


def token_counts(pages: DataFrame, rules: Sequence[Rule], url: str = "url") -> dict[str, int]:
    """How many URLs have each token that some rule has; at most one number per such token."""
    wanted = sorted({token for rule in rules for token in rule.tokens})
    if not wanted:
        return {}
    found = F.explode(F.array_distinct(F.regexp_extract_all(F.col(url), F.lit("([A-Za-z0-9]+)"))))
    counts = pages.select(found.alias("token")).filter(F.col("token").isin(wanted)).groupBy("token").count()
    return dict.fromkeys(wanted, 0) | {row["token"]: row["count"] for row in counts.collect()}


def file_rules(rules: Sequence[Rule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by rarest token; those without any are under the empty text."""
    index: dict[str, list[int]] = {}
    for number, rule in enumerate(rules):
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t), default="")
        index.setdefault(token, []).append(number)
    return index


def judge_urls(
    pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url", keep: Sequence[str] = ("page_id",)
) -> DataFrame:
    """`keep` columns with host, path, rule (text of the ranked rule that decided, else null) and verdict."""
    rules = tuple(rules)
    index = file_rules(rules, token_counts(pages, rules, url))
    patterns = [rule.pattern for rule in rules]
    ranked = [(len(rule.text), rule.text.removeprefix("||"), rule.verdict) if rule.ranked else None for rule in rules]
    everywhere = index.get("", [])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(pattern, re.DOTALL) for pattern in patterns]
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                host, path, tail = host_of(text)
                whole = host + tail
                numbers = set(everywhere) if whole else set()
                for token in set(TOKEN.findall(whole)):
                    numbers.update(index.get(token, ()))
                fits = [number for number in numbers if compiled[number].search(whole)]
                best = max((ranked[number] for number in fits if ranked[number]), default=None)
                if best:
                    rows.append((host, path, best[1], best[2]))
                else:
                    rows.append((host, path, None, "block" if fits else "allow"))
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(column, pa.string()) for column in columns)],
                [*batch.schema.names[:-1], "host", "path", "rule", "verdict"],
            )

    given = pages.select(*keep, F.col(url).alias("_url"))
    types = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in given.schema.fields[:-1])
    out = "host string, path string, rule string, verdict string"
    return given.mapInArrow(judge, f"{types}, {out}" if types else out)


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1) AS tail
  FROM cut
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(tail, '^[^?#]*') AS path, tail FROM parts
), rules(h, p, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM urls) u JOIN rules
    ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)
  GROUP BY page_id, host, path
)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN regexp_matches(host || tail,
    '^([^/?#]*\.)?(adult-|casino-|spam-farm\.|ads-track\.|free-bets\.)|\.exe\?|/login/|/cart/|[?&]sessionid=') THEN 'block' ELSE 'allow' END) AS verdict
FROM urls LEFT JOIN fits USING (page_id)
"""
