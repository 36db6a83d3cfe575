"""URL rules indexed by their rarest literal token [native].

Every rule is a regular expression over ``host + path + query`` together with the literal tokens
(runs of [a-z0-9] between separators) that any URL matching it must contain. How often each such
token occurs among the URLs is counted over the whole table; the rule is filed under its rarest
one. A URL's tokens fetch the rules filed under them, and only these run their expression.

Rules come as a list or as a table of any size (:func:`rules_from_table`). A rule whose pattern has no whole
literal token is tried on every URL.

Two layers: listed (host, path) rules, where the longest that fits wins; and pattern rules in
the style of blocking lists, asked only where no listed rule fits. Rules with equal rank: allow
before block, then by name.

One shuffle, of (id, url) after map-side grouping; one row per URL row and token before it. A hot
host or a URL that a third of the rows share stays spread, since the id is in the key. Null URLs
and URLs without ``://`` have an empty host and path and fit no rule; repeated rows stay
repeated; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm.common import LOWER, UPPER, ascii_lower, saved

TO_LOWER = str.maketrans(UPPER, LOWER)

#: More rules than this and the index is joined by a shuffle instead of a broadcast.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str  # allow or block
    regex: str  # over host + path + query
    tokens: tuple[str, ...]  # lower case, at least one
    layer: int  # 1: listed, 0: pattern
    rank: int  # the larger wins within a layer


def host_path_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the path; ``host`` alone fits any path."""
    host, slash, path = rule.partition("/")
    host, path = host.translate(TO_LOWER), slash + path
    regex = r"^(?:[^/?#]*\.)?" + re.escape(host) + (re.escape(path) if path else "(?:[/?]|$)")
    whole = [t for t in re.split(r"[^a-z0-9]+", host) if t]
    parts = re.split(r"[^a-z0-9]+", path.translate(TO_LOWER))
    whole += [t for t in parts[:-1] if t]  # the last may go on in the URL
    return Rule(rule, verdict, regex, tuple(dict.fromkeys(whole)), 1, len(rule))


def pattern_rule(verdict: str, pattern: str) -> Rule:
    """``||``: start of a host label, ``^``: a separator or the end, ``*``: anything; else literal. The host after ``||`` fits in any case."""
    body, start = (pattern[2:], r"^(?:[^/?#]*\.)?") if pattern.startswith("||") else (pattern, "")
    if start:
        host = re.match("[^/?^]*", body)[0]
        body = host.translate(TO_LOWER) + body[len(host) :]
    made = "".join({"*": ".*", "^": r"(?:[^A-Za-z0-9_.%-]|$)"}.get(c) or re.escape(c) for c in body)
    tokens = [
        m[0].translate(TO_LOWER)
        for m in re.finditer(r"[A-Za-z0-9]+", body)
        if (m.start() > 0 and body[m.start() - 1] != "*" or m.start() == 0 and start)
        and (m.end() < len(body) and body[m.end()] != "*")
    ]
    if not tokens:
        raise ValueError(f"no whole literal token in {pattern!r}")
    return Rule(pattern, verdict, "(?s)" + start + made, tuple(dict.fromkeys(tokens)), 0, len(pattern))


#: Listed rules of the query.
HOST_RULES = [
    host_path_rule("allow", "com/"),
    host_path_rule("block", "example.com/en/"),
    host_path_rule("allow", "www.example.com/en/"),
    host_path_rule("block", "net/es/"),
    host_path_rule("block", "net/fr/"),
]
#: Patterns for URLs that no listed rule fits.
PATTERN_RULES = [
    pattern_rule("block", p)
    for p in (
        "||spam-farm.", "||link-farm.", "||adserver.", "||ads.", "||ads-track.", "||doubleclick.", "||casino.", "||casino-win.", "||free-bets.",
        "||cheap-pills.", "||adult-x.", "||porn.", "||xxx.",
        "/adclick/", "/affiliate/", "/casino/", "/poker/", "/porn/", "/viagra/", "/warez/", "/banner/ads/",
        "/wp-login.php^", "/cgi-bin/formmail.", "?action=login&", "/torrent/download/",
    )
] + [pattern_rule("allow", "||ads.gov/")]


def parsed(url: Column) -> dict[str, Column]:
    """host (A-Z lower-cased), path and what follows it. Null or no ``://``: all empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    return {
        "host": ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        "query": F.regexp_extract(rest, r"^[^/?#]*[^?#]*(\?[^#]*)", 1),
    }


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [(r.name, r.verdict, r.regex, list(r.tokens), r.layer, r.rank) for r in rules]
    return spark.createDataFrame(rows, "name string, verdict string, regex string, tokens array<string>, layer int, rank int")


def rules_from_table(table: DataFrame) -> DataFrame:
    """Compiles a table (kind, verdict, rule) to what :func:`judge_urls` takes, without Python.

    kind ``listed``: host/path as :func:`host_path_rule`; ``pattern``: as :func:`pattern_rule`. Rows of another
    kind, with a verdict other than allow and block, or with a null or empty rule are left out; equal rows count once.
    """
    rows = table.select("kind", "verdict", F.col("rule").alias("name")).where("verdict in ('allow', 'block') and name != ''").distinct()
    quoted = lambda c: F.regexp_replace(c, r"([^A-Za-z0-9*^/])", r"\\$1")
    slash = F.instr("name", "/")
    host = ascii_lower(F.when(slash > 0, F.substring("name", F.lit(1), slash - 1)).otherwise(F.col("name")))
    path = F.when(slash > 0, F.substring("name", slash, F.length("name"))).otherwise(F.lit(""))
    literal = lambda c: F.regexp_replace(quoted(c), r"([*^])", r"\\$1")
    path_tokens = F.split(ascii_lower(path), "[^a-z0-9]+")
    host_tokens = F.concat(F.split(host, "[^a-z0-9]+"), F.slice(path_tokens, F.lit(1), F.size(path_tokens) - 1))
    listed = rows.where("kind = 'listed'").select(
        "name", "verdict", F.concat(F.lit(r"^(?:[^/?#]*\.)?"), literal(host), F.when(path == "", F.lit("(?:[/?]|$)")).otherwise(literal(path))).alias("regex"), host_tokens.alias("tokens"), F.lit(1).alias("layer")
    )
    start = F.startswith("name", F.lit("||"))
    after = F.substring("name", F.lit(3), F.length("name"))
    head = F.regexp_extract(after, "^[^/?^]*", 0)  # the host, in lower case as those of the URLs
    body = F.when(start, F.concat(ascii_lower(head), F.substring(after, F.length(head) + 1, F.length(after)))).otherwise(F.col("name"))
    made = F.replace(F.replace(quoted(body), F.lit("*"), F.lit(".*")), F.lit("^"), F.lit(r"(?:[^A-Za-z0-9_.%-]|$)"))
    whole = F.lit("(?<=[^A-Za-z0-9*])[A-Za-z0-9]+(?=[^A-Za-z0-9*])")
    first = F.when(start, F.regexp_extract(body, "^[A-Za-z0-9]+(?=[^A-Za-z0-9*])", 0)).otherwise(F.lit(""))
    pattern = rows.where("kind = 'pattern'").select(
        "name", "verdict", F.concat(F.lit("(?s)"), F.when(start, F.lit(r"^(?:[^/?#]*\.)?")).otherwise(F.lit("")), made).alias("regex"),
        F.transform(F.concat(F.array(first), F.regexp_extract_all(body, whole, F.lit(0))), ascii_lower).alias("tokens"), F.lit(0).alias("layer"),
    )
    tokens = F.array_distinct(F.filter("tokens", lambda t: t != ""))
    return listed.unionByName(pattern).select("name", "verdict", "regex", F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit(""))).alias("tokens"), "layer", F.length("name").alias("rank"))


def token_index(urls: DataFrame, rules: DataFrame, small: bool = False) -> DataFrame:
    """token -> array of the rules whose rarest token it is. urls: a column ``tokens``. small: the rules may be broadcast."""
    of_rules = rules.select("name", "layer", F.explode("tokens").alias("token"))
    wanted = of_rules.select("token").distinct()
    if small:
        wanted = F.broadcast(wanted)
    seen = urls.select(F.explode("tokens").alias("token")).join(wanted, "token").groupBy("token").count()
    rarest = (
        of_rules.join(seen, "token", "left")
        .groupBy("name", "layer")
        .agg(F.min(F.struct(F.coalesce("count", F.lit(0)), F.col("token"))).getField("token").alias("token"))
    )
    return (
        rules.join(rarest, ["name", "layer"])
        .groupBy("token")
        .agg(F.collect_list(F.struct("layer", "rank", "verdict", "name", "regex")).alias("rules"))
    )


def judge_urls(pages: DataFrame, rules: list[Rule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, url, host, path, rule, verdict, pattern): rule is the listed rule, pattern the pattern that decided."""
    spark = pages.sparkSession
    id_, url = F.col(id_col), F.col(url_col)
    urls = pages.select(id_.alias("id"), url.alias("url"), *(c.alias(k) for k, c in parsed(url).items()))
    urls = urls.withColumn("subject", F.concat("host", "path", "query"))
    # every URL has the empty token, under which rules without one are filed
    urls = urls.withColumn("tokens", F.array_union(F.split(ascii_lower(F.col("subject")), "[^a-z0-9]+"), F.array(F.lit(""))))
    if isinstance(rules, DataFrame):
        rules = saved(rules, "rules")
        n = rules.count()
    else:
        rules, n = rules_frame(spark, rules), len(rules)
    small = n <= BROADCAST_RULES
    index = token_index(urls, rules, small)
    if small:
        index = F.broadcast(index)
    fits = F.filter("rules", lambda r: F.rlike(F.col("subject"), r["regex"]))
    # min() of (-layer, -rank, verdict, name): the strongest; allow before block among equals
    best = F.array_min(F.transform(fits, lambda r: F.struct((-r["layer"]).alias("layer"), (-r["rank"]).alias("rank"), r["verdict"].alias("verdict"), r["name"].alias("name"))))
    won = (
        urls.select("id", "url", "host", "path", "subject", F.posexplode("tokens").alias("pos", "token"))
        .join(index, "token", "left")
        .groupBy("id", "url", "host", "path")
        .agg(F.min(best).alias("best"), F.count(F.when(F.col("pos") == 0, 1)).alias("copies"))
    )
    listed = F.col("best.layer") == -1
    return won.select(
        F.col("id").alias(id_col),
        F.col("url").alias(url_col),
        "host",
        "path",
        F.when(listed, F.col("best.name")).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.when(~listed, F.col("best.name")).alias("pattern"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")
