"""The registered queries of the corpus operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.llm.bpe import round_trip
from skarn.llm.exact_dedup import exact_dedup
from skarn.llm.language_id import language_id
from skarn.llm.ngram_join import ngram_join
from skarn.llm.packing import pack
from skarn.llm.quality import CUTOFFS, quality_rules
from skarn.llm.sharding import shard_documents
from skarn.llm.substring_dedup import repeated_passages
from skarn.llm.token_counts import token_counts
from skarn.llm.url_filter import url_filter

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents")).drop("text_hash")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents")).drop("group_sha256")


def _quality_sql(alpha: float = 0.004, delta: float = 0.05, most: int = 256) -> str:
    """op9 in SQL: the measures, then score after score the tests on joint rejections, with binomial sums by lgamma()."""
    scores = {"symbols": "n_symbols / greatest(word_chars, 1)::DOUBLE", "dup_lines": "n_dup_lines * 5 / greatest(n_words, 1)::DOUBLE", "repeats": "n_repeat_words / greatest(n_words, 1)::DOUBLE", "word_length": "word_chars / greatest(n_words, 1)::DOUBLE"}

    def cdf(k: str, n: str) -> str:
        return f"coalesce(list_sum(list_transform(range(0, ({k}) + 1), lambda i: exp(lgamma({n} + 1) - CASE WHEN i > 1 THEN lgamma(i + 1) ELSE 0 END - CASE WHEN {n} - i > 1 THEN lgamma({n} - i + 1) ELSE 0 END + i * ln({alpha}) + ({n} - i) * ln(1 - {alpha})))), 0)"

    stages, starts = [], 1
    for nth, (k, cs) in enumerate(CUTOFFS.items()):
        given = list(CUTOFFS)[:nth]
        rejected = " OR ".join([*(f"coalesce({s} > a_{s}, false)" for s in given), f"{k} > c"])
        kept = "".join(f"any_value(a_{s}) AS a_{s}, " for s in given)
        stages.append(f"""
             c_{k} AS (SELECT unnest({cs!r}::DOUBLE[]) AS c, unnest(range({len(cs)})) AS i),
             h_{k} AS (SELECT test, c, i, count(*) AS n, count(*) FILTER (WHERE {rejected}) AS hits, {kept}any_value(failed) AS failed FROM tg JOIN {f"a_{given[-1]}" if given else "a_none"} USING (test), c_{k} GROUP BY test, c, i),
             p_{k} AS (SELECT *, {cdf("hits", "n")} > (SELECT part FROM plan) / 2 / CASE WHEN failed THEN 3.0 * {starts} ELSE 1 END AS bad FROM h_{k}),
             s_{k} AS (SELECT *, coalesce(min(i) FILTER (WHERE bad) OVER (PARTITION BY test), {len(cs)}) AS stop FROM p_{k}),
             a_{k} AS (SELECT test, {kept}arg_max(c, i) FILTER (WHERE i < stop) AS a_{k}, any_value(failed) OR any_value(stop) < {len(cs)} AS failed FROM s_{k} GROUP BY test),
             o_{k} AS (SELECT stratum, c, i, count(*) AS n, count(*) FILTER (WHERE {rejected}) AS hits FROM tg JOIN s_{k} USING (test) WHERE test = '*' AND s_{k}.i < stop AND r > (SELECT own FROM plan) GROUP BY stratum, c, i),
             m_{k} AS (SELECT stratum, arg_max(c, i) FILTER (WHERE 1 - {cdf("hits - 1", "n")} >= {delta}) AS m_{k} FROM o_{k} GROUP BY stratum)""")
        starts *= len(cs) + 1
    last = list(CUTOFFS)[-1]
    verdict = " ".join(f"WHEN {k} > coalesce(a_{k}, m_{k}) THEN '{k}'" for k in CUTOFFS)
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[ 	-]+'), lambda x: x <> '') AS w,
                          list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-]')) AS lines FROM documents),
             win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, unnest(range(len(w) - 4)) AS i, unnest(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS g FROM t WHERE len(w) >= 5)),
             rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM win, range(5) r(o) WHERE c > 1 GROUP BY doc_id),
             b AS (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
                          (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep USING (doc_id)),
             f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {", ".join(f"{e} AS {k}" for k, e in scores.items())} FROM b),
             g AS (SELECT * FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0)),
             sizes AS (SELECT stratum, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, stratum) AS r FROM g GROUP BY stratum),
             al AS (SELECT count(*) AS strata, coalesce(sum(n), 0) AS total FROM sizes),
             ow AS (SELECT coalesce(max(r), 0) AS own FROM sizes, al WHERE r <= {most} AND pow(1 - {alpha}, n) <= {delta} / (r + CASE WHEN r < strata THEN 1 ELSE 0 END) / 2),
             po AS (SELECT own, coalesce(sum(n) FILTER (WHERE r > own), 0) AS pooled FROM ow LEFT JOIN sizes ON true GROUP BY own),
             plan AS (SELECT own, {delta} / greatest(1, own + CASE WHEN pooled > 0 THEN 1 ELSE 0 END) AS part, pooled > 0 AND pow(1 - {alpha}, pooled) > {delta} / greatest(1, own + 1) / 2 AS all_pooled FROM po),
             tg AS (SELECT '=' || stratum AS test, g.*, r FROM g JOIN sizes USING (stratum), plan WHERE r <= own UNION ALL
                    SELECT '*', g.*, r FROM g JOIN sizes USING (stratum), plan, al WHERE strata > own AND (all_pooled OR r > own)),
             a_none AS (SELECT DISTINCT test, false AS failed FROM tg),{",".join(stages)},
             v AS (SELECT f.*, CASE {verdict} END AS failed_score FROM f LEFT JOIN a_{last} ON test = '=' || f.stratum {" ".join(f"LEFT JOIN m_{k} USING (stratum)" for k in CUTOFFS)})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_score IS NULL AS kept, stratum, failed_score FROM v
    """


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_ngram_join, op3_token_counts, op4_url_filter, op5_language_id, op6_substring_dedup, op7_bpe_round_trip, op8_best_fit_packing, op9_quality_rules, op10_sharding)}

ORACLE_SQL = {
    "op9_quality_rules": _quality_sql(),
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
        FROM n JOIN g USING (t)
    """,
    "op2_ngram_join": r"""
        WITH RECURSIVE
             w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
             e AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                   ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g FROM w),
             n AS (SELECT doc_id, count(g) AS n_shingles FROM documents LEFT JOIN e USING (doc_id) GROUP BY doc_id),
             shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
             links AS (SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 70 * (nx.n_shingles + ny.n_shingles - c)),
             reach AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT y, root FROM reach JOIN links ON x = reach.doc_id)
        SELECT doc_id, n_shingles, (SELECT count(*) FROM links WHERE x = n.doc_id) AS n_similar, (SELECT min(root) FROM reach WHERE reach.doc_id = n.doc_id) AS component_id FROM n
    """,
    "op4_url_filter": r"""
        WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
             u AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS p, coalesce(url, '') AS url FROM pages),
             s AS (SELECT page_id, CASE WHEN p > 0 THEN substr(url, p + 3) ELSE '' END AS rest FROM u),
             h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM s),
             x AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
             m AS (SELECT page_id, host, path, rhost || rpath AS rule, verdict, length(rhost || rpath) AS len FROM x JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
             b AS (SELECT page_id, arg_max(rule, len) AS rule, arg_max(verdict, len) AS verdict FROM m GROUP BY page_id)
        SELECT x.page_id, x.host, x.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM x LEFT JOIN b USING (page_id)
    """,
}
