"""URL filter rules, found through their rarest literal token. DataFrame functions only.

A rule is an action with a regular expression; its literal tokens are the runs of ``[a-z0-9]`` outside the expression's
operators. Each rule is filed under the one of its tokens that the fewest rules share. A URL is cut into the same kind of
tokens once, the tokens fetch rules from the file, and only those rules' expressions run on the URL. Up to ``MAX_RULES``
rules the file is a map literal, so a URL never leaves its row and nothing is shuffled; a longer file is a table that the
tokens of distinct URLs are joined with, with the same results.

Prefix rules (host with subdomains, path prefix) become such expressions by ``prefix_rule``.

Defined results: a null URL, or one without ``://``, has an empty host and an empty path, meets no rule and gets the
default verdict. Repeated rows are judged one by one. An empty table gives an empty table. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    """pattern: a regular expression over ``host + path``. literals: text that each match contains whole, between
    characters that are not ``[a-z0-9]``. rank: the highest rank among matching rules wins, then the longer name."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = 0
    reported: bool = True


def prefix_rule(name: str, action: str, rank: int = 1) -> Rule:
    """``example.org/es/``: the host and all its subdomains, and paths that start with ``/es/``.

    Tokens at the open end of the path may go on in a URL, so only tokens that something follows are literals."""
    host, slash, path = name.partition("/")
    path = slash + path
    host = host.lower()
    whole = re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"{host}{path}".lower())
    return Rule(name, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(whole), rank)


#: The rules that the contract states.
STATED = [
    prefix_rule("org/", "allow"), prefix_rule("example.org/es/", "block"), prefix_rule("example.org/en/1", "block"),
    prefix_rule("com/fr/", "allow"), prefix_rule("com/de/", "block"),
]


def _label(name: str, words: str) -> Rule:
    """Hosts in which a label has these hyphenated words."""
    return Rule(name, "block", rf"^[^/]*\b{words}\b", tuple(words.split("-")), 0, False)


#: The method's own rules: they give a verdict where no stated rule fits.
OWN = [
    _label("farm", "spam-farm"), _label("pills", "cheap-pills"), _label("casino", "casino"), _label("poker", "poker"),
    _label("viagra", "viagra"), _label("cialis", "cialis"), _label("porn", "porn"), _label("xxx", "xxx"), _label("warez", "warez"),
    _label("torrent", "torrent"), _label("loans", "payday-loans"), _label("replica", "replica-watches"), _label("phishing", "phishing"),
    Rule("tracker", "block", r"^(?:[^/]*\.)?(?:ads|adserver)\.", ("ads",), 0, False),
    Rule("adserver", "block", r"^(?:[^/]*\.)?adserver\.", ("adserver",), 0, False),
]


def rule_index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Each rule under its rarest literal token; among equals the longer, then the smaller one."""
    seen = Counter(t for r in rules for t in set(r.literals))
    index: dict[str, list[Rule]] = {}
    for r in rules:
        if not r.literals:
            raise ValueError(f"rule {r.name!r} has no literal token")
        index.setdefault(min(set(r.literals), key=lambda t: (seen[t], -len(t), t)), []).append(r)
    return index


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, after the first ``://`` with A-Z in lower case, and path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _tokens(target: Column) -> Column:
    lower = F.translate(target, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.regexp_extract_all(lower, F.lit("[a-z0-9]+"), 0))


RULE = "rank int, length int, name string, action string, pattern string, reported boolean"


def _fields(r: Rule) -> tuple:
    return r.rank, len(r.name), r.name, r.action, r.pattern, r.reported


def judge_urls(pages: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", default: str = "allow", in_plan: int = MAX_RULES) -> DataFrame:
    """Per row: key, host, path, rule (the winning stated rule's name), verdict, n_candidates (rules whose expression ran).
    in_plan: up to so many rules are a literal of the plan."""
    index = rule_index(rules)
    names = [f.split()[0] for f in RULE.split(", ")]
    host, path = url_parts(F.col("url"))
    parts = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).select("key", host.alias("host"), path.alias("path"))
    target = F.concat("host", "path")
    if len(rules) <= in_plan:
        one = lambda r: F.struct(*[F.lit(v).alias(n) for n, v in zip(names, _fields(r), strict=True)])
        file = F.create_map(*[x for t, found in sorted(index.items()) for x in (F.lit(t), F.array(*map(one, found)))])
        fetched = F.flatten(F.transform(F.filter(_tokens(target), lambda t: F.map_contains_key(file, t)), lambda t: F.element_at(file, t)))
        run = parts.withColumn("fetched", fetched)
        met = F.filter("fetched", lambda r: F.rlike(target, r["pattern"]))
        best = run.select("key", "host", "path", F.array_max(met).alias("best"), F.size("fetched").alias("n_candidates"))
    else:
        file = pages.sparkSession.createDataFrame([(t, *_fields(r)) for t, found in index.items() for r in found], f"token string, {RULE}")
        asked = parts.select("host", "path").distinct().withColumn("token", F.explode(_tokens(target)))
        run = asked.join(file.select("token", F.struct(*names).alias("r")), "token")
        met = F.when(F.rlike(target, F.col("r.pattern")), F.col("r"))
        judged = run.groupBy("host", "path").agg(F.max(met).alias("best"), F.count("*").alias("n_candidates"))
        best = parts.join(judged, ["host", "path"], "left")
    return best.select(
        F.col("key").alias(key), "host", "path", F.when(F.col("best.reported"), F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"),
    )


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), STATED + OWN).drop("n_candidates")


#: The contract's rules and the method's own, written out once more, so that the query is held against the contract and not against itself.
SQL_OP7 = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM rest
), rules(name, h, p, action) AS (VALUES
    ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
    ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')
), judged AS (
  SELECT page_id, host, path, (SELECT max(struct_pack(n := length(name), name := name, action := action)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS best FROM parts
)
SELECT page_id, host, path, best.name AS rule,
       CASE WHEN best IS NOT NULL THEN best.action
            WHEN regexp_matches(host, '\b(spam-farm|cheap-pills|casino|poker|viagra|cialis|porn|xxx|warez|torrent|payday-loans|replica-watches|phishing)\b')
              OR regexp_matches(host || path, '^([^/]*\.)?(ads|adserver)\.') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


QUERIES = {"op7_url_filters": op7_url_filters}
SQL = {"op7_url_filters": SQL_OP7}
