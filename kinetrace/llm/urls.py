"""URL filters: pattern rules indexed by their rarest literal token.

A rule's literal tokens are the letter-and-digit runs that any URL it fits must hold as whole runs. Token counts over
all URLs pick each rule's rarest; a URL's tokens then fetch candidate rules, and only those run regular expressions.
All of it is row-local expressions over a folded constant, so no URL is shuffled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Index entries per hash bucket (a Spark map is searched linearly).
PER_BUCKET = 4
TOKEN = "[a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``regex`` is searched in the lower-case host followed by the rest of the URL; ``tokens`` must all be in it."""

    name: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    tier: int = 0

    @property
    def weight(self) -> int:
        return len(self.name)


def place_rule(action: str, place: str) -> Rule:
    """A host with its subdomains and a path prefix, such as ``example.net/en/``; outranks pattern rules."""
    host, slash, path = place.partition("/")
    tokens = re.findall(TOKEN, host.lower())
    inner = (slash + path).lower()
    tokens += [m[0] for m in re.finditer(TOKEN, inner) if m.end() < len(inner)]  # a run at the end may go on in the URL
    return Rule(place, action, rf"^(?:[^/?#]*\.)?{_quote(host.lower())}{_quote(slash + path)}", tuple(dict.fromkeys(tokens)), 1)


def pattern_rule(action: str, pattern: str) -> Rule:
    """Literal text with ``*`` for anything and ``|`` at either end for the URL's end; ASCII case is ignored."""
    body, parts = pattern.strip("|"), []
    start, stop = pattern.startswith("|"), pattern.endswith("|")
    regex = ".*".join(_quote(x) for x in body.split("*"))
    for m in re.finditer(TOKEN, body.lower()):
        before, after = body[m.start() - 1 : m.start()] if m.start() else ("" if start else "*"), body[m.end() : m.end() + 1] or ("" if stop else "*")
        if before != "*" and after != "*":
            parts.append(m[0])
    return Rule(pattern, action, f"(?is){'^' if start else ''}{regex}{'$' if stop else ''}", tuple(dict.fromkeys(parts)))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9/_-])", r"\\\1", text)


#: Rules of the query; the longest place that fits wins, then the longest pattern.
PLACES = [place_rule("block", "net/"), place_rule("allow", "example.net/en/"), place_rule("block", "example.com/de/"), place_rule("allow", "org/fr/")]
PATTERNS = [
    pattern_rule(*x)
    for x in (
        ("block", "/ads/"), ("block", "/adserver/"), ("block", "/banners/"), ("block", "/casino/"), ("block", "/viagra/"), ("block", "/porn/"), ("block", "/xxx/"), ("block", "/phishing/"),
        ("block", "/malware/"), ("block", "/warez/"), ("block", "/torrent/"), ("block", ".exe|"), ("block", ".apk|"), ("block", "/wp-login.php"), ("block", "&affiliate_id="), ("allow", "/ads/policy/"),
    )
]


def split_url(url):
    """host (A-Z lower-cased), path and the target that rules search; all empty for a null or a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.substring(rest, F.length(raw) + 1, F.length(rest)))


def tokens_of(target):
    low = F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1)))


def token_counts(df: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens is, over all rows; at most one short row per token."""
    if not tokens:
        return {}
    _, _, target = split_url(df[url].cast("string"))
    found = df.select(F.explode(F.array_intersect(tokens_of(target), F.lit(tokens))).alias("token")).groupBy("token").count()
    return {r["token"]: r["count"] for r in found.collect()}


def judge(df: DataFrame, key: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = (*PLACES, *PATTERNS), default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule (a fitting place rule or null), verdict, pattern (a fitting pattern or null).

    Null URLs and URLs without :// have an empty host and path, fit no rule and get the default verdict. Ties go to
    the longer rule, then to block, then by name. Repeated rows each get a row; an empty table gives an empty result;
    extra columns are ignored.
    """
    counts = token_counts(df, url, sorted({t for r in rules for t in r.tokens}))
    buckets: list[dict[str, list]] = [{} for _ in range(max(1, len(rules) // PER_BUCKET))]
    always = []
    for r in rules:
        entry = {"tier": r.tier, "weight": r.weight, "block": r.action == "block", "name": r.name, "regex": r.regex}
        if r.tokens:
            token = min(r.tokens, key=lambda t: (counts.get(t, 0), t))
            buckets[_bucket(token, len(buckets))].setdefault(token, []).append(entry)
        else:
            always.append(entry)
    kind = "array<struct<tier:int,weight:int,block:boolean,name:string,regex:string>>"
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<map<string,{kind}>>")
    host, path, target = split_url(df[url].cast("string"))
    rows = df.select(df[key].alias("id"), host.alias("host"), path.alias("path"), target.alias("target"))
    bucket = lambda t: F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(len(buckets))).cast("int") + 1
    fetched = F.flatten(F.transform(tokens_of(F.col("target")), lambda t: F.coalesce(F.try_element_at(F.element_at(index, bucket(t)), t), F.from_json(F.lit("[]"), kind))))
    candidates = F.concat(fetched, F.from_json(F.lit(json.dumps(always)), kind))
    fitting = F.filter(candidates, lambda r: F.regexp(F.col("target"), r["regex"]) & (F.col("host") != ""))
    rows = rows.withColumn("best", F.array_max(F.transform(fitting, lambda r: F.struct(r["tier"], r["weight"], r["block"], r["name"]))))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.block"), "block").otherwise("allow")
    place = F.when(F.col("best.tier") == 1, F.col("best.name"))
    return rows.select(F.col("id").alias(key), "host", "path", place.alias("rule"), verdict.alias("verdict"), F.when(F.col("best.tier") == 0, F.col("best.name")).alias("pattern"))


def _bucket(token: str, n: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % n


def reference_sql(rules: tuple[Rule, ...] = (*PLACES, *PATTERNS), default: str = "allow") -> str:
    """DuckDB SQL that tries every rule on every URL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({r.tier}, {r.weight}, {int(r.action == 'block')}, {quote(r.name)}, {quote(r.regex)})" for r in rules)
    return f"""
WITH r AS (SELECT * FROM (VALUES {values}) v(tier, weight, block, name, regex)),
u AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT page_id, path, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, substr(rest, length(raw) + 1) AS tail FROM h),
b AS (SELECT page_id, host, path, (SELECT max((tier, weight, block, name)) FROM r WHERE host <> '' AND regexp_matches(host || tail, regex)) AS best FROM t)
SELECT page_id, host, path, CASE WHEN best[1] = 1 THEN best[4] END AS rule,
       CASE WHEN best IS NULL THEN '{default}' WHEN best[3] = 1 THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN best[1] = 0 THEN best[4] END AS pattern
FROM b"""
