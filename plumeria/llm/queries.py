"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeria.llm import byte_bpe, decontaminate, dom_extract, mixture, quality_divergence, ranked_search, shards, simhash_join, token_counts, toxicity, url_rules, whitening, zip_warc
from plumeria.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_divergence.rate_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), drop_text=True)
    q = F.col(quality_divergence.COUNTS)
    return rated.select("doc_id", *(q[c].alias(c) for c in quality_divergence.BASE), F.col("_kept").alias("kept"), F.round("_char_distance", 6).alias("char_distance"), F.round("_word_distance", 6).alias("word_distance"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return n.withColumn("over_limit", F.col("n_tokens") > 4096)


def op4_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zip_warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.score_documents(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op7_dom_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"), 40).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_simhash_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_join.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def embedding_whitening(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component."""
    model, kinds = whitening.fit(vectors), "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None:
        return vectors.sparkSession.createDataFrame([], kinds)
    v = F.col("embedding")
    rows = vectors.where(whitening.fits(model, v)).select("vec_id", whitening.whitened(model, v).alias("w"))
    rows = rows.select("vec_id", "w.deviation", F.explode(F.arrays_zip(whitening.components(model).alias("c"), F.col("w.whitened").alias("w"))).alias("r"))
    return rows.select(
        "vec_id", "r.c.component", F.lit(model.n).cast("long").alias("n"), F.expr("try_cast(deviation AS long)").alias("deviation"),
        F.col("r.w").alias("whitened"), "r.c.explained", F.lit(model.identity_error).cast("double").alias("identity_error"),
    )


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"))


def op12_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_divergence": op1_quality_divergence,
    "op2_decontaminate": op2_decontaminate,
    "op3_token_counts": op3_token_counts,
    "op4_zip_warc": op4_zip_warc,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_dom_extract": op7_dom_extract,
    "op8_url_rules": op8_url_rules,
    "op9_byte_shards": op9_byte_shards,
    "op10_simhash_tries": op10_simhash_tries,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_mixture": op12_source_mixture,
    "op13_ranked_search": op13_ranked_search,
}

def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def quality_sql() -> str:
    """The quality rules in DuckDB SQL: counts, common words, references and distances with the same definitions.

    For tables without languages beyond the widespread ones (the given ones have four); a test has others.
    """
    q = quality_divergence
    space = "[\\x20\\x09-\\x0D]+"
    side = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y})) ELSE 0 END"
    return f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT *, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS ws, regexp_replace(t, '[\\p{{Ll}}\\x20\\x09-\\x0D]+', '', 'g') AS rest,
list_transform(ws, lambda x: lower(x)) AS lw, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
known AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {q.WIDESPREAD}),
df AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(list_distinct(lw)) AS word FROM w JOIN known USING (lang)) WHERE regexp_matches(word, '^\\p{{L}}+$') GROUP BY ALL),
v AS MATERIALIZED (SELECT DISTINCT word FROM (SELECT word FROM df QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {q.COMMON})),
cw AS MATERIALIZED (SELECT k, word, count(*) AS n FROM (SELECT k, unnest(lw) AS word FROM w) JOIN v USING (word) GROUP BY ALL),
t3 AS (SELECT k, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS ts FROM w),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, three) AS c FROM (SELECT k, unnest(ts) AS three, generate_subscripts(ts, 1) AS i FROM t3)),
p AS (SELECT k, count(DISTINCT i + o) AS n_repeat_words FROM g, range(0, 3) y(o) WHERE c > 1 GROUP BY k),
f AS (SELECT k, doc_id, lang, len(ws) AS n_words, length(regexp_replace(t, '{space}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, length(rest) AS r, length(rest) - length(regexp_replace(rest, '\\p{{Lu}}+', '', 'g')) AS u,
length(rest) - length(regexp_replace(rest, '[0-9]+', '', 'g')) AS n, length(rest) - length(regexp_replace(rest, '[.,;:!?''"()-]+', '', 'g')) AS q FROM w LEFT JOIN p USING (k)),
b AS MATERIALIZED (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, word_chars >= {q.MIN_CHARS} AS long_c, n_words >= {q.MIN_WORDS} AS long_w,
list_transform([word_chars - r, u, n, q, r - u - n - q], lambda x: x::DOUBLE / word_chars) AS c FROM f),
h AS MATERIALIZED (SELECT k, 'c' AS kind, i::VARCHAR AS bin, c[i] AS x FROM b, range(1, 6) t(i) WHERE long_c
UNION ALL SELECT k, 'w', word, coalesce(cw.n, 0)::DOUBLE / n_words FROM b CROSS JOIN v LEFT JOIN cw USING (k, word) WHERE long_w
UNION ALL SELECT k, 'w', '', (n_words - coalesce(s, 0))::DOUBLE / n_words FROM b LEFT JOIN (SELECT k, sum(n) AS s FROM cw GROUP BY k) USING (k) WHERE long_w),
m AS MATERIALIZED (SELECT lang, kind, bin, avg(x) AS m FROM h JOIN b USING (k) JOIN known USING (lang) WHERE NOT base_failed AND long_c AND long_w GROUP BY ALL HAVING count(*) >= {q.MIN_DOCUMENTS}),
e AS (SELECT h.k, kind, m.lang, sqrt(greatest(0, sum({side("x", "m")} + {side("m", "x")}) / 2)) AS dist FROM h JOIN m USING (kind, bin) GROUP BY ALL),
o AS (SELECT k, min(dist) FILTER (WHERE kind = 'c' AND long_c) AS dc, min(dist) FILTER (WHERE kind = 'w' AND long_w) AS dw FROM e JOIN b USING (k) WHERE b.lang IN (SELECT lang FROM m) GROUP BY k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
NOT base_failed AND NOT (coalesce(dc, 0) > {q.MAX_CHAR_DISTANCE} OR coalesce(dw, 0) > {q.MAX_WORD_DISTANCE}) AS kept, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance FROM b LEFT JOIN o USING (k)"""


def warc_sql() -> str:
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS first FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {zip_warc.MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {zip_warc.MIN_REVISIT} AND page_id <> first THEN first END AS refers_to FROM f"""


def shard_sql(n_shards: int = 40) -> str:
    """Prefix sums over all rows; CRC-32 byte by byte, with its table made from the polynomial."""
    return f"""WITH t AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {0xEDB88320}) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM documents),
s AS (SELECT doc_id, (len(bs) + 16)::BIGINT AS size, xor(list_reduce(list_prepend(4294967295, bs), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM b, t),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS pos, sum(size) OVER () AS total FROM s),
p AS (SELECT *, (pos * {n_shards} // total)::INT AS shard FROM o)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY pos) - 1 AS slot, NULL::INT AS grown_shard FROM p"""


def url_sql() -> str:
    """Every rule tried on every URL."""
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES
    values = ", ".join(f"({_quoted([r.name])}, {_quoted([r.verdict])}, {_quoted([r.regex])}, {r.layer}, {r.rank})" for r in rules)
    return f"""WITH r AS (SELECT * FROM (VALUES {values}) t(name, verdict, regex, layer, rank)),
s AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT k, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*[^?#]*([?][^#]*)', 1) AS query FROM s),
m AS (SELECT k, arg_min((layer, verdict, name), (-layer, -rank, verdict, name)) AS best FROM u, r WHERE regexp_matches(host || path || query, regex) GROUP BY k)
SELECT page_id, host, path, CASE WHEN best[1] = 1 THEN best[3] END AS rule, coalesce(best[2], 'allow') AS verdict, CASE WHEN best[1] = 0 THEN best[3] END AS pattern FROM u LEFT JOIN m USING (k)"""


def search_sql(top: int = ranked_search.TOP) -> str:
    """Every document scored for every item."""
    terms = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {terms} AS ts FROM documents),
n AS (SELECT k, doc_id, len(ts) AS n FROM d WHERE len(ts) > 0), s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
q AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
f AS MATERIALIZED (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
c AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::BIGINT AS score
FROM q JOIN w USING (term) JOIN f USING (term) JOIN n USING (k), s GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {top}"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_divergence": quality_sql(),
    "op4_zip_warc": warc_sql(),
    "op8_url_rules": url_sql(),
    "op9_byte_shards": shard_sql(),
    "op13_ranked_search": search_sql(),
}
