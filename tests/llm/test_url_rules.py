import random
import re

import pytest
from pyspark.sql import functions as F

from plumeria.llm import url_rules as U

RULES = U.HOST_RULES + U.PATTERN_RULES


def brute(url, rules=RULES):
    host = path = query = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        end = min((rest.index(c) for c in "?#" if c in rest), default=len(rest))
        path = rest[:end]
        query = rest[end:].split("#")[0] if rest[end:].startswith("?") else ""
    best = min(((-r.layer, -r.rank, r.verdict, r.name) for r in rules if re.search(r.regex, host + path + query)), default=None)
    return host, path, best[3] if best and best[0] == -1 else None, best[2] if best else "allow", best[3] if best and best[0] == 0 else None


URLS = [
    None, "", "no scheme/en/", "http://", "http:///en/", "http://com", "http://com/", "http://a.com/x", "http://acom/x", "HTTP://EXAMPLE.com/en/", "http://example.com/en", "http://example.com/EN/x",
    "http://www.example.com/en/1", "http://x.www.example.com/en/1", "http://wwwexample.com/en/1", "https://a.b.example.com/en/?q=/", "http://example.com?/en/", "http://example.com#/en/", "http://net/es/", "http://a.net/es/x",
    "http://a.net/fr/x#y", "http://a.net/en/es/", "http://a.org/x?u=http://b.net/es/", "http://u@example.com:80/en/", "http://example.com:80/en/", "http://spam-farm.org/x", "http://my.spam-farm.example.org/x", "http://notspam-farm.org/x",
    "http://x.org/adclick/1", "http://x.org/noadclick/1", "http://x.org/wp-login.php", "http://x.org/wp-login.phpx", "http://ads.gov/x", "http://ads.x.org/", "http://x.org/a?action=login&b", "http://Ä.com/é漢", "a://b://c.com/x", "http://a.com\n/x", "http://ads.x.org/casino/",
]


def test_verdicts_against_all_rules(spark):
    r = random.Random(1)
    made = ["http://" + ".".join(r.choice(["www", "example", "com", "net", "a", "ads"]) for _ in range(r.randint(1, 4))) + "".join(r.choice(["/", "/en/", "/es/", "/fr/", "en", "?", "#", "/casino/"]) for _ in range(r.randint(0, 4))) for _ in range(400)]
    urls = URLS + made + URLS[:12]
    df = spark.createDataFrame([(i % 350, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.url, r.host, r.path, r.rule, r.verdict, r.pattern) for r in U.judge_urls(df, RULES).collect()), key=repr)
    assert got == sorted(((i % 350, u, *brute(u)) for i, u in enumerate(urls)), key=repr)


def test_shuffled_index_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    want = sorted(map(str, U.judge_urls(df, RULES).collect()))
    monkeypatch.setattr(U, "BROADCAST_RULES", 0)
    assert sorted(map(str, U.judge_urls(df, RULES).collect())) == want


def test_rules_are_filed_under_their_rarest_token(spark):
    urls = spark.createDataFrame([(["a", "b"],)] * 3 + [(["b"],)] * 2, "tokens array<string>")
    rules = U.rules_frame(spark, [U.Rule("r", "block", "x", ("b", "a"), 0, 1), U.Rule("s", "block", "x", ("b", "never"), 0, 1)])
    assert {r.token: [x.name for x in r.rules] for r in U.token_index(urls, rules).collect()} == {"a": ["r"], "never": ["s"]}


def test_patterns_need_a_whole_token():
    with pytest.raises(ValueError):
        U.pattern_rule("block", "*ads*")


@pytest.mark.parametrize("broadcast", [U.BROADCAST_RULES, 0])
def test_thousands_of_rules_from_a_table(spark, monkeypatch, broadcast):
    """Compiled without Python to what the list of rules says; rows that are no rules are left out."""
    monkeypatch.setattr(U, "BROADCAST_RULES", broadcast)
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randint(1, 4)))
    listed = {(r.choice(["allow", "block"]), ".".join(word() for _ in range(r.randint(1, 3))) + r.choice(["", "/", f"/{word()}/", f"/{word()}+(1)?x"])) for _ in range(1500)}
    pattern = {(r.choice(["allow", "block"]), p) for p in [f"||{word()}.{word()}^" for _ in range(700)] + [f"/{word()}/*{word()}-{word()}." for _ in range(700)] + [f"?{word()}=*&" for _ in range(100)]}
    rules = [U.host_path_rule(*x) for x in listed | {("block", "net/es/")}] + [U.pattern_rule(*x) for x in pattern]
    rows = [("listed", v, n) for v, n in listed | {("block", "net/es/")}] + [("pattern", v, n) for v, n in pattern]
    rows += rows[:5] + [("listed", "block", None), ("listed", "block", ""), ("other", "block", "a.b"), ("pattern", "maybe", "||a.b"), (None, None, None)]
    table = spark.createDataFrame(rows, "kind string, verdict string, rule string").withColumn("layer", F.lit("x"))
    compiled = U.rules_from_table(table)
    want = {(x.name, x.verdict): (set(x.tokens), x.layer, x.rank) for x in rules}
    assert {(x.name, x.verdict): (set(x.tokens), x.layer, x.rank) for x in compiled.collect()} == want
    urls = ["http://" + ".".join(word() for _ in range(r.randint(1, 4))) + "".join(r.choice(["/", "/" + word() + "/", word(), "-", ".", "?" + word() + "=1&", "+(1)?x"]) for _ in range(r.randint(0, 5))) for _ in range(300)]
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), compiled)
    assert sorted(((x.page_id, x.host, x.path, x.rule, x.verdict, x.pattern) for x in got.collect()), key=repr) == sorted(((i, *brute(u, rules)) for i, u in enumerate(urls)), key=repr)


def test_rules_without_a_whole_token_are_tried_everywhere(spark):
    table = spark.createDataFrame([("pattern", "block", "*ads*"), ("pattern", "allow", "good")], "kind string, verdict string, rule string")
    urls = spark.createDataFrame([(1, "http://x.org/loadsof"), (2, "http://x.org/"), (3, "http://goodness.org/ads"), (4, None)], "page_id long, url string")
    got = {x.page_id: (x.verdict, x.pattern) for x in U.judge_urls(urls, U.rules_from_table(table)).collect()}
    assert got == {1: ("block", "*ads*"), 2: ("allow", None), 3: ("block", "*ads*"), 4: ("allow", None)}


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


@pytest.mark.parametrize("compiled", [False, True])
def test_upper_case_rules_fit_alike_in_both_compilers(spark, compiled):
    """Hosts in any case; paths and other literals as they are."""
    listed, pattern = [("block", "Example.COM/Ab/"), ("allow", "ORG")], [("block", "||Ads.Example^X"), ("block", "||CDN.net/Q/")]
    rules = [U.host_path_rule(*x) for x in listed] + [U.pattern_rule(*x) for x in pattern]
    if compiled:
        rules = U.rules_from_table(spark.createDataFrame([("listed", *x) for x in listed] + [("pattern", *x) for x in pattern], "kind string, verdict string, rule string"))
    urls = ["http://www.EXAMPLE.com/Ab/c", "http://example.com/ab/c", "http://a.Org/", "http://ads.EXAMPLE/X", "http://ads.example/x", "http://cdn.NET/Q/1", "http://cdn.net/q/1"]
    got = U.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules)
    assert {x.page_id: x.rule or x.pattern for x in got.collect()} == {0: "Example.COM/Ab/", 1: None, 2: "ORG", 3: "||Ads.Example^X", 4: None, 5: "||CDN.net/Q/", 6: None}
