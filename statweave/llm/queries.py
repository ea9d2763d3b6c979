"""Registered queries of the training-data operators: thin digests over each operator's own interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, num=9, den=10)


@_query
def op1_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    from pyspark.sql import functions as F

    from .packing import pack

    pieces = pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, window=4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


@_query
def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, sized

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = sized(docs).selectExpr("named_struct() as row", "doc_id", "source", "size", "tag")
    return mix(rows).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op3_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix:' || coalesce(md5(text), '')) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(rn - 1) % 3 + 1] AS w FROM s),
o AS (SELECT *, CAST(sum(n) OVER () AS BIGINT) AS t, CAST(coalesce(sum(n) OVER (ORDER BY n / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before, sum(w) OVER (ORDER BY n / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
c AS (SELECT *, (3 * t - 4 * before) * w >= 4 * n * w_from AS stops FROM o),
f AS (SELECT *, coalesce(sum(n) FILTER (stops) OVER (), 0) AS c, sum(w) FILTER (NOT stops) OVER () AS w_rest FROM c),
g AS (SELECT source, n, CASE WHEN stops THEN 2.0::DOUBLE * n ELSE CAST(w * (3 * t - 4 * c) AS DOUBLE) / (2.0::DOUBLE * w_rest) END AS target FROM f),
p AS (SELECT d.*, g.n AS source_size, g.target, CASE WHEN g.n > 0 THEN CAST(floor(g.target) AS BIGINT) // g.n ELSE 0 END AS e, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(e * size + greatest(0, least(size, floor(target) - e * source_size - ahead)) AS BIGINT) AS taken FROM p
"""


@_query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .secret_scan import STRONG, listed, scan

    rows = scan(_table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k.name) for k in STRONG]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("strong")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _secret_oracle() -> str:
    from .secret_scan import SCOPE, STRONG, WEAK

    q = lambda s: s.replace("'", "''")
    kinds = [(k, i) for i, k in enumerate((*STRONG, *WEAK))]
    role = {k.name: k.role for k, _ in kinds}
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{k.name}' AS kind, '{k.role}' AS role, {i < len(STRONG)} AS strong, {k.least} AS least, unnest(range(0, len(regexp_extract_all(text, '{q(k.pattern)}')))) AS i, "
        f"regexp_extract_all(text, '{q(k.pattern)}') AS m, regexp_extract_all(text, '{q(k.pattern)}', {k.value}) AS v, regexp_split_to_array(text, '{q(k.pattern)}') AS g FROM d"
        for k, i in kinds
    )
    roles = sorted(set(role.values()))
    weak_rules = " OR ".join(
        f"(w.role = '{r}' AND (EXISTS (FROM s WHERE s.doc_id = w.doc_id AND s.strong AND s.role <> '{r}' AND w.a <= s.b + {SCOPE} AND s.a <= w.b + {SCOPE}) OR ("
        + " AND ".join(f"EXISTS (FROM c WHERE c.doc_id = w.doc_id AND c.role = '{o}' AND w.a <= c.b + {SCOPE} AND c.a <= w.b + {SCOPE})" for o in roles if o != r)
        + ")))"
        for r in roles
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({parts}),
placed AS (SELECT doc_id, rank, kind, role, strong, least, v[i + 1] AS value, CAST(coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i + 1]) AS n FROM raw),
s AS (SELECT doc_id, rank, kind, role, strong, a, a + n AS b FROM placed WHERE length(value) >= least),
c AS (SELECT * FROM s w WHERE NOT strong AND NOT EXISTS (FROM s x WHERE x.doc_id = w.doc_id AND x.strong AND x.a < w.b AND w.a < x.b)),
reported AS (SELECT * FROM s WHERE strong UNION ALL SELECT * FROM c w WHERE {weak_rules}),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (strong), '') AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM reported GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN j USING (doc_id)
"""


ORACLES["op5_secret_scan"] = _secret_oracle()


@_query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _rules_oracle() -> str:
    from .quality_rules import RULES, STOP_SET

    stop = ", ".join(f"'{w}'" for w in STOP_SET)
    tests = [f"(n_words >= {r.words} AND {f'{r.given} >= 0.5' if r.given else 'true'} AND ({' OR '.join([f'{r.measure} < {r.low}'] * (r.low is not None) + [f'{r.measure} > {r.high}'] * (r.high is not None))}))" for r in RULES]
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
t AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
r AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM t) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines, coalesce(r.n, 0) AS n_repeat_words, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS n_stop,
 length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS n_latin, length(text) - length(regexp_replace(text, '[^A-Za-z\x20\x09-\x0D\x{{80}}-\x{{10FFFF}}.,]', '', 'g')) AS n_marks FROM w LEFT JOIN r USING (doc_id)),
x AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_share, coalesce(n_stop / nullif(n_words, 0), 0) AS stop_share, coalesce(n_latin / nullif(word_chars, 0), 0) AS latin_share, coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_share, coalesce(n_marks / nullif(word_chars, 0), 0) AS mark_share, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT (base_failed OR {" OR ".join(tests)}) AS kept FROM x
"""


ORACLES["op6_quality_rules"] = _rules_oracle()


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .toxicity import fit, score

    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string"))
    model = fit(docs, _table(spark, sf_dir, "labels"), crc % 3 != 1)
    out = score(docs, model)
    return out.select("doc_id", (crc % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@_query
def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality_model import fit, score

    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string"))
    model = fit(docs, _table(spark, sf_dir, "labels"), crc % 4 != 2)
    out = score(docs, model)
    return out.select("doc_id", (crc % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@_query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language_id import fit, identify

    docs = _table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string"))
    out = identify(docs, fit(docs, crc % 4 != 2))
    return out.select("doc_id", (crc % 4 == 2).alias("held_out"), "lang_pred", "score", "accepted")


@_query
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"), cos=0.98)
