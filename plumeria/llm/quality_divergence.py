"""Quality rules by distribution divergence [native].

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. The
method's verdict compares two histograms of a document with those of each language:

* character classes: lower-case letters, upper-case letters, digits, punctuation, other;
* common words of the languages, and all other words together.

Both are learned from the table, or from a table of trusted samples, for any number of languages: the
common words of a language are the ``COMMON`` words (of letters only) that most of the documents declared
to be in it hold; its reference is the mean histogram of those of them that pass the base rules and both
length guards, if these are ``MIN_DOCUMENTS`` at least. The distance is that of Jensen and Shannon (root
of the divergence, base 2: 0 to 1), taken to the nearest of these references: those of the ``WIDESPREAD``
most frequent languages, over the bins of their common words, and that of the document's own language,
which for another language has bins for its own common words as well. So a document costs the same
however many languages there are. A document is rejected if a distance exceeds its threshold and the
text is long enough for that histogram; shorter texts, and documents whose language is not declared or
has no reference, are not judged by it.

Two passes over the texts. The first shuffles what is left of the words after counting them in each
task, and keeps a few for each language and task before they are ranked; the second needs no
shuffle: what crosses the network is one row of sums for each language and task. What comes to the
driver are the bins of the widespread languages; words and references of the others are tables, a row
for each, broadcast up to ``BROADCAST_LANGUAGES`` rows and joined by shuffle beyond.
Repeated windows are found inside the row: 64-bit hashes of the windows are sorted, and where
only few windows repeat, their places are looked up directly.

Nulls: a null text has no words (and fails the base rules); a null language adds to no reference.
With no reference at all (an empty table, say) only the base rules decide. Repeated rows stay
repeated. Columns of the input named _quality, _char_distance, _word_distance or _kept are replaced;
others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumeria.llm.common import SPACE, fresh, let, saved

#: Languages that every document is compared with, common words of each, and documents that a reference takes at least.
WIDESPREAD, COMMON, MIN_DOCUMENTS = 8, 12, 10
#: Rows of languages (some kB each) that a join broadcasts at most.
BROADCAST_LANGUAGES = 5_000
#: Length guards, in words and in code points that are no white space.
MIN_WORDS, MIN_CHARS = 80, 300
#: Distances above which a document resembles no language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.28
#: With more repeated windows than this, places are found by sorting instead of by looking them up.
FEW = 24

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
#: The column that carries the counts of a row; a column of the input by that name is replaced.
COUNTS = "_quality"


def common_words(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> DataFrame:
    """(lang, n, words): the declared languages, the documents of each and its common words; ties in frequency go to the smaller word."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    words = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), SPACE))
    counts = known.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").count()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("count"), "word"))
    top = counts.where(F.col("word").rlike(r"^\p{L}+$")).withColumn("place", place).where(F.col("place") <= common)
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    words = top.groupBy("lang").agg(F.collect_set("word").alias("words"))
    return sizes.join(words, "lang", "left").select("lang", "n", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


def widespread(languages: DataFrame, most: int = WIDESPREAD) -> tuple[list[str], list[str]]:
    """(languages, their common words), each sorted, of the most frequent languages; ties go to the smaller name."""
    rows = languages.orderBy(F.desc("n"), "lang").limit(most).collect()
    return sorted(r["lang"] for r in rows), sorted({w for r in rows for w in r["words"]})


def vocabulary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", languages: int = WIDESPREAD, common: int = COMMON) -> tuple[list[str], list[str]]:
    """:func:`widespread` of docs."""
    return widespread(common_words(docs, text_col, lang_col, common), languages)


def by_language(rows: DataFrame, per_language: DataFrame, lang_col: str, n: int) -> DataFrame:
    """rows with the columns of the n rows of per_language, whose ``lang`` is named ``lang_col`` here; null without one."""
    key = fresh([*rows.columns, *per_language.columns], "lang_key")
    side = per_language.withColumnRenamed("lang", key)
    return rows.join(F.broadcast(side) if n <= BROADCAST_LANGUAGES else side, F.col(lang_col) == F.col(key), "left").drop(key)


def _repeat_words(words: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that are found twice or more, each word once."""
    n = F.size(words)
    hashes = F.transform(
        F.slice(words, F.lit(1), F.greatest(n - (width - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *(F.get(words, i + k) for k in range(1, width))),
    )

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(places, k + 1), p + width) - p))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")

    def by_lookup(h: Column, repeated: Column) -> Column:
        at = F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i))
        return let(F.filter(at, lambda i: i.isNotNull()), covered)

    def by_sorting(h: Column) -> Column:
        def places(s: Column) -> Column:
            same = F.filter(s, lambda x, i: (F.get(s, i + 1)["h"] == x["h"]) | (F.get(s, i - 1)["h"] == x["h"]))
            return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

        return let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), places)

    def counted(h: Column) -> Column:
        def known(repeated: Column) -> Column:
            return F.when(F.size(repeated) == 0, F.lit(0).cast("long")).when(F.size(repeated) <= FEW, by_lookup(h, repeated)).otherwise(by_sorting(h))

        repeats = let(F.sort_array(h), lambda s: F.filter(s, lambda x, i: F.get(s, i - 1) == x))
        return let(repeats, known)

    return let(hashes, counted)


def features(docs: DataFrame, vocabulary: list[str], text_col: str = "text", own_col: str | None = None) -> DataFrame:
    """Adds the base counts, base_failed, and the count vectors (char_counts, word_counts, own_counts) in one column.

    own_counts are those of word_counts with bins for the words of ``own_col`` before the last; null where that is.
    """
    listed = F.array(*map(F.lit, vocabulary)).cast("array<string>")
    own = F.col(own_col) if own_col else F.lit(None).cast("array<string>")
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    other = F.regexp_replace(text, r"[\p{Ll}\x20\x09-\x0D]+", "")  # what is neither a lower-case letter nor white space

    def of_words(words: Column) -> Column:
        def counts(of: Column, held) -> Column:
            common = F.filter(F.transform(words, lambda w: F.lower(w)), held)
            return let(common, lambda c: F.transform(of, lambda v: (F.size(c) - F.size(F.array_remove(c, v))).cast("long")))

        owned = F.when(own.isNotNull(), counts(own, lambda w: F.array_contains(own, w))) if own_col else F.lit(None).cast("array<long>")
        return F.struct(
            F.size(words).cast("long").alias("n_words"), _repeat_words(words).alias("n_repeat_words"), counts(listed, lambda w: w.isin(vocabulary)).alias("common"), owned.alias("own")
        )

    def of_other(rest: Column) -> Column:
        def without(pattern: str) -> Column:
            return (F.length(rest) - F.length(F.regexp_replace(rest, pattern, ""))).cast("long")

        return F.array(without(r"\p{Lu}+"), without("[0-9]+"), without(r"[.,;:!?'\"()-]+"), F.length(rest).cast("long"))

    raw = F.struct(
        F.length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        let(F.array_remove(F.split(text, SPACE), ""), of_words).alias("w"),
        let(other, of_other).alias("c"),
    )
    def counted(q: Column) -> Column:
        c, n_words = q["c"], q["w"]["n_words"]
        total = lambda counts: F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
        common, owned = total(q["w"]["common"]), q["w"]["own"]
        return F.struct(
            n_words.alias("n_words"),
            q["word_chars"].alias("word_chars"),
            q["n_symbols"].alias("n_symbols"),
            q["n_dup_lines"].alias("n_dup_lines"),
            q["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((n_words < 50) | (100 * q["w"]["n_repeat_words"] > 50 * n_words)).alias("base_failed"),
            F.array(q["word_chars"] - c[3], c[0], c[1], c[2], c[3] - c[0] - c[1] - c[2]).alias("char_counts"),
            F.concat(q["w"]["common"], F.array(n_words - common)).alias("word_counts"),
            F.concat(q["w"]["common"], owned, F.array(n_words - common - total(owned))).alias("own_counts"),
        )

    return docs.withColumn(COUNTS, let(raw, counted))


def _shares(counts: Column, total: Column) -> Column:
    return F.transform(counts, lambda x: F.try_divide(x.cast("double"), total.cast("double")))


def _means(rated: DataFrame, lang_col: str, which: Column, counts: str, bins: int) -> DataFrame:
    """(lang, c0 to c4, w0 to ...): mean shares of the character classes and of the words in ``counts``, of languages with documents enough."""
    q = F.col(COUNTS)
    good = rated.where(which & ~q["base_failed"] & (q["n_words"] >= MIN_WORDS) & (q["word_chars"] >= MIN_CHARS))
    good = good.select(F.col(lang_col).alias("lang"), _shares(q["char_counts"], q["word_chars"]).alias("c"), _shares(q[counts], q["n_words"]).alias("w"))
    means = [F.avg(F.get("c", F.lit(i))).alias(f"c{i}") for i in range(5)] + [F.avg(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(bins)]
    return good.groupBy("lang").agg(F.count("*").alias("n"), *means).where(F.col("n") >= MIN_DOCUMENTS)


def references(rated: DataFrame, languages: list[str], n_words: int, lang_col: str = "lang") -> dict[str, tuple[list[float], list[float]]]:
    """language -> mean shares of the character classes and of the n_words common words and the rest. At most one row for each language."""
    rows = _means(rated, lang_col, F.col(lang_col).isin(languages), "word_counts", n_words + 1).collect()
    return {r["lang"]: ([r[f"c{i}"] for i in range(5)], [r[f"w{i}"] for i in range(n_words + 1)]) for r in sorted(rows, key=lambda r: r["lang"])}


def own_references(rated: DataFrame, n_words: int, lang_col: str = "lang", common: int = COMMON) -> DataFrame:
    """(lang, c, w) of the languages that are not widespread: mean shares, w with the bins of own_counts."""
    bins = n_words + common + 1
    means = _means(rated, lang_col, F.col(COUNTS)["own_counts"].isNotNull(), "own_counts", bins)
    # documents of a language have the same bins, so those that it lacks are null
    return means.select("lang", F.array(*(f"c{i}" for i in range(5))).alias("c"), F.filter(F.array(*(f"w{i}" for i in range(bins))), lambda x: x.isNotNull()).alias("w"))


def distance(shares: Column, reference: list[float] | Column) -> Column:
    """Jensen-Shannon distance, base 2."""
    ref = reference if isinstance(reference, Column) else F.array(*map(F.lit, reference))

    def term(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(F.lit(0.0))

    both = F.zip_with(shares, ref, lambda p, q: term(p, q) + term(q, p))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def judged(rated: DataFrame, languages: list[str], n_words: int, lang_col: str = "lang", learned: DataFrame | None = None, others: bool = False) -> DataFrame:
    """Adds to counted rows: _char_distance, _word_distance (null where not judged) and _kept.

    References come from the counted rows of ``learned``, with lang; of rated, if None. others: there are languages beyond the widespread.
    """
    source, source_lang = (rated, lang_col) if learned is None else (learned, "lang")
    refs = references(source, languages, n_words, source_lang)
    q, columns, own = F.col(COUNTS), [c for c in rated.columns if c.lower() not in ("_char_distance", "_word_distance", "_kept")], None
    known = F.coalesce(F.col(lang_col).isin(list(refs)), F.lit(False))
    if others:
        name = fresh(rated.columns, "own_reference")
        table = saved(own_references(source, n_words, source_lang).select("lang", F.struct("c", "w").alias(name)), "references")
        rated, own = by_language(rated, table, lang_col, table.count()), F.col(name)
        known = known | own.isNotNull()
    long_chars, long_words = known & (q["word_chars"] >= MIN_CHARS), known & (q["n_words"] >= MIN_WORDS)

    def nearest(counts: str, own_counts: str, total: str, k: int, long: Column) -> Column:
        each = []
        if refs:
            each.append(let(_shares(q[counts], q[total]), lambda s: F.array_min(F.array(*(distance(s, r[k]) for r in refs.values())))))
        if own is not None:
            each.append(F.when(own.isNotNull(), distance(_shares(q[own_counts], q[total]), own["cw"[k]])))
        return F.when(long, F.array_min(F.array(*each))) if each else F.lit(None).cast("double")

    out = rated.withColumn("_char_distance", nearest("char_counts", "char_counts", "word_chars", 0, long_chars))
    out = out.withColumn("_word_distance", nearest("word_counts", "own_counts", "n_words", 1, long_words))
    odd = (F.coalesce("_char_distance", F.lit(0.0)) > MAX_CHAR_DISTANCE) | (F.coalesce("_word_distance", F.lit(0.0)) > MAX_WORD_DISTANCE)
    out = out.withColumn("_kept", ~q["base_failed"] & ~odd)
    # without own_reference, and at the end what was there before by these names
    named = ["`" + c.replace("`", "``") + "`" for c in columns]
    return out.select(*named, "_char_distance", "_word_distance", "_kept")


def rate_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", drop_text: bool = False, samples: DataFrame | None = None) -> DataFrame:
    """docs with the counts, _char_distance, _word_distance and _kept. The counts are written once, with the columns of docs (without the text if ``drop_text``).

    samples: trusted texts (text, lang) that common words and references are learned from; from docs, if None.
    """
    trusted = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) if samples is None else samples.select("text", "lang")
    found = saved(common_words(trusted), "languages")
    languages, words = widespread(found)
    listed = F.array(*map(F.lit, words)).cast("array<string>")
    own = found.where((F.col("n") >= MIN_DOCUMENTS) & ~F.col("lang").isin(languages))
    n = own.count()

    def counted(rows: DataFrame, text: str, lang: str) -> DataFrame:
        if not n:
            return features(rows, words, text)
        name = fresh(rows.columns, "own_words")
        own_words = own.select("lang", F.array_sort(F.array_except("words", listed)).alias(name))
        return features(by_language(rows, own_words, lang, n), words, text, name).drop(name)

    learned = None if samples is None else saved(counted(trusted, "text", "lang").select("lang", COUNTS), "samples")
    rated = counted(docs, text_col, lang_col)
    return judged(saved(rated.drop(text_col) if drop_text else rated, "quality"), languages, len(words), lang_col, learned, n > 0)
