import collections
import math
import random
import re

import pytest

from plumeria.llm import quality_divergence as Q
from plumeria.llm import queries

WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def brute(text):
    words = WORDS(text or "")
    grams = list(zip(words, words[1:], words[2:]))
    seen = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def texts():
    r = random.Random(1)
    some = [None, "", " \t\n\x0b\r", "a", "a b", "a b c a b c", "a a a a a", "x\n x\nx\n\ny\x0bx", "é漢😀 <#> | $", "\x1c\x85  b c", "a b c\n" * 400]
    for n in (60, 300, 3000):
        some += [" ".join(r.choice("ab c\n d é the").strip() + r.choice("abcdef") for _ in range(n)) for _ in range(3)]
        some += [" ".join(str(r.randint(0, n * 3)) for _ in range(n)) + r.choice(["", " 1 2 3 1 2 3"]) for _ in range(3)]
    return some


def test_base_counts_against_brute_force(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts())] + [(3, "a", None)]
    out = Q.rate_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = sorted((r["doc_id"], *(r["_quality"][c] for c in Q.BASE)) for r in out.collect())
    assert got == sorted((i, *brute(t)) for i, t, _ in rows)


def js(p, q):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a > 0)
    return math.sqrt(max(0, (kl(p) + kl(q)) / 2))


def test_distances_on_whole_table(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rated, (langs, words) = Q.rate_documents(docs), Q.vocabulary(docs)
    refs = Q.references(rated, langs, len(words))
    assert set(refs) == {"en", "fr", "de", "es"} == set(langs) and {"the", "of", "de", "la", "der", "el"} <= set(words)
    for c, w in refs.values():
        assert abs(sum(c) - 1) < 1e-9 and abs(sum(w) - 1) < 1e-9
    for r in rated.collect():
        q = r["_quality"]
        assert sum(q["char_counts"]) == q["word_chars"] and sum(q["word_counts"]) == q["n_words"]
        dist = lambda counts, n, k: min(js([x / n for x in counts], ref[k]) for ref in refs.values())
        bad = q["base_failed"]
        if q["word_chars"] >= Q.MIN_CHARS:
            d = dist(q["char_counts"], q["word_chars"], 0)
            assert abs(d - r["_char_distance"]) < 1e-9
            bad |= d > Q.MAX_CHAR_DISTANCE
        else:
            assert r["_char_distance"] is None
        if q["n_words"] >= Q.MIN_WORDS:
            d = dist(q["word_counts"], q["n_words"], 1)
            assert abs(d - r["_word_distance"]) < 1e-9
            bad |= d > Q.MAX_WORD_DISTANCE
        else:
            assert r["_word_distance"] is None
        assert r["_kept"] == (not bad)


def test_keeps_good_and_rejects_most_junk(spark, sf_dir):
    rated = Q.rate_documents(queries.table(spark, "/root/testdata/sf0.01", "documents"))
    rows = rated.join(queries.table(spark, "/root/testdata/sf0.01", "labels"), "doc_id").where("not _quality.base_failed").collect()
    good, junk = ([r["_kept"] for r in rows if r["quality"] == y] for y in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(junk) / len(junk) < 0.35


def test_empty_table_and_no_reference(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, _kept int")
    assert Q.rate_documents(none).count() == 0
    one = spark.createDataFrame([(1, "w " * 10, None)], "doc_id long, text string, lang string")
    assert Q.rate_documents(one).first()["_kept"] is False


def speech(r, words, n=150):
    """Invented text: a third function words of a language, the rest longer words of its own letters."""
    return " ".join(r.choice(words) if r.random() < 0.35 else "".join(r.choice(words) for _ in range(3)) for _ in range(n)).capitalize() + "."


def test_any_language_is_learned_and_unknown_ones_are_not_judged(spark):
    r = random.Random(2)
    talk = {x: ["".join(r.choice("aeioumnrst" if x != "zz" else "\u4e00\u4e8c\u4e09") for _ in range(2)) + x[0] for _ in range(14)] for x in ("aa", "bb", "zz", "fi")}
    rows = [(x, speech(r, talk[x])) for x in ("aa", "bb", "zz") for _ in range(25)] + [("fi", speech(r, talk["fi"])) for _ in range(5)]
    rows += [(None, speech(r, talk["fi"]))] * 2 + [("aa", " ".join("%08x" % r.randrange(2**32) for _ in range(150))) for _ in range(5)]
    rows += [("aa", speech(r, talk["bb"])), ("aa", None), ("fi", "%% " * 100)]
    docs = spark.createDataFrame([(i, t, x, i) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, n_words int")
    out = {x["doc_id"]: x for x in Q.rate_documents(docs).collect()}
    assert all(out[i]["_kept"] and out[i]["_word_distance"] is not None for i in range(75))
    assert all(out[i]["_kept"] and out[i]["_word_distance"] is None for i in range(75, 82))  # too few to learn from, or not declared
    assert not any(out[i]["_kept"] for i in range(82, 87)) and out[87]["_kept"] and not out[88]["_kept"] and not out[89]["_kept"]
    assert Q.vocabulary(docs, languages=2)[0] == ["aa", "bb"] and len(Q.vocabulary(docs, common=3)[1]) <= 12


def js_of(text, words, ref):
    found = [w.lower() for w in WORDS(text)]
    shares = [found.count(w) / len(found) for w in words]
    return js(shares + [1 - sum(shares)], ref)


def shares_of(texts, words):
    each = [[WORDS(t.lower()).count(w) / len(WORDS(t)) for w in words] for t in texts]
    means = [sum(c) / len(each) for c in zip(*each)] if words else []
    return means + [1 - sum(means)]


@pytest.mark.parametrize("broadcast", [5_000, 0])
def test_languages_beyond_the_widespread_are_judged_by_their_own(spark, monkeypatch, broadcast):
    """Word distances of eleven languages, three of them beyond the eight, from plain loops."""
    monkeypatch.setattr(Q, "BROADCAST_LANGUAGES", broadcast)
    r = random.Random(5)
    names = ["l%02d" % k for k in range(11)]
    talk = {x: ["".join(r.choice("aeioumnrst") for _ in range(2)) + chr(97 + k) for _ in range(15)] for k, x in enumerate(names)}
    rows = [(x, speech(r, talk[x])) for k, x in enumerate(names) for _ in range(30 - k)] + [("rare", speech(r, talk["l00"])), (None, speech(r, talk["l10"]))]
    junk = " ".join("%08x" % r.randrange(2**32) for _ in range(150))
    rows += [("l10", junk), ("l10", speech(r, talk["l00"])), ("l10", None), ("l09", "")]
    docs = spark.createDataFrame([(i, t, x, i, None) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string, own_words int, _kept string")
    out = {x["doc_id"]: x for x in Q.rate_documents(docs).collect()}
    assert len(out) == len(rows) and all(out[i]["own_words"] == i for i in out)

    def common(x):
        seen = collections.Counter(w for lang, t in rows if lang == x and t for w in set(WORDS(t.lower())) if w.isalpha())
        return sorted(seen, key=lambda w: (-seen[w], w))[: Q.COMMON]

    wide = sorted({w for x in names[:8] for w in common(x)})
    good = {x: [t for lang, t in rows if lang == x and t and not brute(t)[-1]] for x in names}
    refs = {x: shares_of(good[x], wide) for x in names[:8]}
    for i, (x, t) in enumerate(rows):
        if x in names and t and len(WORDS(t)) >= Q.MIN_WORDS:
            each = [js_of(t, wide, refs[y]) for y in refs]
            if x in names[8:]:
                own = wide + sorted(set(common(x)) - set(wide))
                each.append(js_of(t, own, shares_of(good[x], own)))
            assert abs(min(each) - out[i]["_word_distance"]) < 1e-9
        else:
            assert out[i]["_word_distance"] is None
    n = len(rows) - 6
    assert all(out[i]["_kept"] for i in range(n + 2)) and not out[n + 2]["_kept"] and out[n + 3]["_kept"] and not out[n + 4]["_kept"] and not out[n + 5]["_kept"]


def test_trusted_samples_judge_a_table_of_junk(spark):
    """A language whose documents here are mostly junk: by itself junk is its reference, by the samples it is rejected."""
    r = random.Random(6)
    talk = ["".join(r.choice("aeioumnrst") for _ in range(3)) for _ in range(14)]
    junk = lambda: " ".join("%08x" % r.randrange(2**32) for _ in range(150))
    docs = spark.createDataFrame([(i, "aa", junk() if i < 30 else speech(r, talk)) for i in range(33)], "doc_id long, lang string, text string")
    samples = spark.createDataFrame([("aa", speech(r, talk)) for _ in range(20)], "lang string, text string")
    kept = lambda **k: {x["doc_id"] for x in Q.rate_documents(docs, **k).where("_kept").collect()}
    assert kept() & set(range(30)) and kept(samples=samples) == {30, 31, 32}
