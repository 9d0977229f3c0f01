"""URL filters: rules indexed by their rarest literal token.

A URL's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; its path
is what follows up to ``?``, ``#`` or the end. Rules are of two kinds. A host rule (host, path) fits that host and all
its subdomains where the URL's path starts with the rule's. A pattern rule is a regular expression, searched in host +
path in lower case, with its literal tokens: sets of whole tokens of which every match holds one set, one for each way
in which its alternatives can match. Tokens are runs of ``[a-z0-9]``.

Of each of its sets a rule is filed under the token which the fewest URLs have. A URL's tokens fetch the rules filed
under them; only those run their regular expression. Of the host rules that fit, the longest decides; else block wins over
allow among the pattern rules that fit; else ``default`` decides, and a URL without a host is blocked.

Edge cases: a null URL or one without ``://`` has an empty host and path; rules without a token are filed under the
empty token, which every URL has; of equal rules the first decides; repeated pages are judged alike; no rules or no
pages work; other columns, clashing names included, are not touched, as verdicts meet pages by host and path only.

Scale: judged are the distinct (host, path); a popular URL is one row. The rules are a small local table, which Spark
broadcasts while it is under its own threshold and joins by shuffle beyond it.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import lower_ascii


@dataclass(frozen=True)
class Rule:
    """Allow or block what the pattern finds in host + path; tokens: sets of whole tokens, of which every URL that it fits has one.

    size: for host rules the length, by which the longest wins; 0 for pattern rules.
    """

    action: str
    name: str
    pattern: str
    tokens: tuple[tuple[str, ...], ...]
    size: int = 0


def host_rule(action: str, host: str, path: str = "/") -> Rule:
    whole = f"{host}{path}"
    # The last token may go on in the URL, unless something that is no token's part ends it.
    tokens = re.findall(r"[a-z0-9]+(?![a-z0-9])", host)
    tokens += re.findall(r"[a-z0-9]+(?=[^A-Za-z0-9])", re.sub(r"[A-Za-z0-9]*[A-Z][A-Za-z0-9]*", "-", path))
    return Rule(action, whole, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (tuple(dict.fromkeys(tokens)),), len(whole))


def words_rule(action: str, name: str, *parts: Sequence[str], between: str = "[-_./]") -> Rule:
    """A pattern rule: one token of each part, one after the other with one separator between, as whole tokens."""
    body = between.join(f"(?:{'|'.join(map(re.escape, p))})" for p in parts)
    return Rule(action, name, rf"(?:^|[^a-z0-9]){body}(?:[^a-z0-9]|$)", tuple(product(*parts)))


#: The rules of op10: host rules as the contract has them, then pattern rules.
HOST_RULES = (host_rule("allow", "com"), host_rule("block", "example.com", "/en/"), host_rule("allow", "www.example.com", "/en/"), host_rule("block", "net", "/es/"), host_rule("block", "net", "/fr/"))
PATTERN_RULES = (
    words_rule("block", "pills", ("cheap", "discount", "online"), ("pills", "meds", "pharmacy")),
    words_rule("block", "farms", ("spam", "link"), ("farm", "farms"), between="-"),
    words_rule("block", "bonus", ("casino", "poker", "slots"), ("bonus", "free", "online")),
    words_rule("block", "gated", ("track", "click", "out"), ("redirect", "go"), between="/(?:[a-z0-9]+/)*"),
    words_rule("block", "adult", ("porn", "xxx")),
    words_rule("block", "junk", ("casino", "viagra", "torrent", "phishing")),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def tokens_of(place: Column) -> Column:
    """Distinct tokens, and the empty one."""
    return F.array_union(F.array_distinct(F.split(place, "[^a-z0-9]+")), F.array(F.lit("")))


def index(rules: Sequence[Rule], urls: DataFrame) -> DataFrame:
    """(token, nr, action, name, pattern, size): each rule under that token of each of its sets which the fewest of the URLs have."""
    spark = urls.sparkSession
    rows = [(nr, k, r.action, r.name, r.pattern, r.size, t) for nr, r in enumerate(rules) for k, held in enumerate(r.tokens or ((),)) for t in (held or ("",))]
    table = spark.createDataFrame(rows, "nr int, way int, action string, name string, pattern string, size int, token string")
    seen = urls.select(F.explode("tokens").alias("token")).join(table.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    best = table.join(seen, "token", "left").groupBy("nr", "way", "action", "name", "pattern", "size").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("rarest"))
    return best.select(F.col("rarest.token").alias("token"), "nr", "action", "name", "pattern", "size").distinct()


def judge(places: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """For distinct (host, path): rule, verdict, candidates (rules fetched), matched (those that fit) and by: which rule decided, if one did."""
    urls = places.select("host", "path").distinct().withColumn("place", F.concat("host", lower_path()))
    urls = urls.withColumn("tokens", tokens_of(F.col("place")))
    fetched = urls.select("host", "path", F.explode("tokens").alias("token")).join(index(rules, urls), "token")
    text = F.when(F.col("size") > 0, F.concat("host", "path")).otherwise(F.concat("host", lower_path()))
    fits = F.regexp_like(text, F.col("pattern"))
    # A URL that has several of a rule's tokens fetches it for each; it is one candidate all the same.
    # max: the longest host rule, else a pattern rule, block first; among equals the first
    rank = F.struct("size", (F.col("action") == "block").alias("block"), (-F.col("nr")).alias("first"), "name", "action")
    best = fetched.groupBy("host", "path").agg(F.max(F.when(fits, rank)).alias("best"), F.size(F.collect_set("nr")).cast("long").alias("candidates"), F.size(F.collect_set(F.when(fits, F.col("nr")))).cast("long").alias("matched"))
    out = urls.select(F.col("host").alias("h"), F.col("path").alias("p")).join(best, (F.col("h") == F.col("host")) & (F.col("p") == F.col("path")), "left")
    rule = F.when(F.col("best.size") > 0, F.col("best.name"))
    fallback = F.when(F.col("h") == "", F.lit("block")).otherwise(F.lit(default))
    return out.select(F.col("h").alias("host"), F.col("p").alias("path"), rule.alias("rule"), F.coalesce("best.action", fallback).alias("verdict"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("candidates", "matched")], F.col("best.name").alias("by"))


def lower_path() -> Column:
    return lower_ascii(F.col("path"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = (*HOST_RULES, *PATTERN_RULES), default: str = "allow") -> DataFrame:
    """The pages whose verdict is allow, with all their columns."""
    host, path = parts(F.col("url"))
    places = pages.select(host.alias("host"), path.alias("path"))
    good = judge(places, rules, default).where("verdict = 'allow'").select(F.struct("host", "path").alias("_allowed"))
    return pages.join(good, F.struct(host.alias("host"), path.alias("path")) == F.col("_allowed"), "left_semi")


def report(pages: DataFrame) -> DataFrame:
    """The contract's columns for every page."""
    host, path = parts(F.col("url"))
    placed = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    return placed.join(judge(placed, (*HOST_RULES, *PATTERN_RULES)), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict")


REPORT_SQL = (
    r"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages)),
rules(action, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
places AS (SELECT DISTINCT host, path FROM split),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(action, length(h || p)) AS action
  FROM places JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT s.page_id, s.host, s.path, b.rule,
       CASE WHEN b.action IS NOT NULL THEN b.action WHEN s.host = '' THEN 'block'
            WHEN regexp_matches(translate(s.host || s.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '@PATTERNS@') THEN 'block'
            ELSE 'allow' END AS verdict
FROM split s LEFT JOIN best b USING (host, path)
""".replace("@PATTERNS@", "|".join(r.pattern for r in PATTERN_RULES))
)
