"""The operators' queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, packing, quality_classifier, quality_rules, simhash, token_counts, token_output, toxicity, url_filter
from .shared import fresh_path, sized, written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_output.write_tokens(table(spark, sf_dir, "documents"), fresh_path(spark, "tokens"), vocabulary(), end_id=0)
    return token_output.token_positions(tokens)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    mined = url_filter.mine(url_filter.labelled_urls(pages, table(spark, sf_dir, "labels")))
    return url_filter.judged(pages, mined)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extracted(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), end_id=1).drop("ids")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.scored(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), threshold=0.5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents under two tokenizer versions, kept by signed deltas.

    All counts are inserted, and the same batch comes again, which adds nothing; the word counts are
    revised to hold an end mark for each document; documents without a word are deleted.
    """
    docs, rollup = table(spark, sf_dir, "documents"), token_counts.Rollup(spark, fresh_path(spark, "rollup"))
    counted = written(token_counts.counts(docs, {"byte_bpe_50k": vocabulary()}).unionByName(token_counts.word_counts(docs)), "counted")
    rollup.commit("load", token_counts.inserts(counted))
    rollup.commit("load", token_counts.inserts(counted))
    words = counted.where("tokenizer = 'words-1'")
    marked = words.withColumns({"n_tokens": words["n_tokens"] + 1})
    rollup.commit("end-marks", token_counts.revisions(words, marked))
    blank = written(words.where("n_tokens = 0").select("doc_id").where("doc_id is not null").distinct(), "blank")
    held = counted.where("tokenizer <> 'words-1'").unionByName(marked)
    rollup.commit("blank", token_counts.deletes(held.join(sized(blank), "doc_id", "left_semi")))
    return rollup.totals()


def token_rollup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts kept by an insert of all documents, a revision of every count and a delete of what one source holds."""
    docs, rollup = table(spark, sf_dir, "documents"), token_counts.Rollup(spark, fresh_path(spark, "rollup"))
    counted = token_counts.word_counts(docs)
    rollup.commit("insert", token_counts.inserts(counted))
    rollup.commit("revise", token_counts.revisions(counted, counted.withColumns({"n_tokens": counted["n_tokens"] + 2})))
    gone = counted.where("source = 'src1'")
    rollup.commit("delete", token_counts.deletes(gone.withColumn("n_tokens", gone["n_tokens"] + 2)))
    rollup.commit("insert", token_counts.inserts(counted))
    return rollup.totals()


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def url_listed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the listed rules alone say of every url; null where none fits."""
    return url_filter.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("said"))


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and rules of every whole text, without the method's verdict."""
    return quality_rules.statistics(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_output, op3_url_filter, op4_html_extraction, op5_quality_rules, op6_packing, op7_quality_classifier, op8_token_counts, op9_simhash_dedup, op10_toxicity, token_rollup_words, url_listed_rules, quality_base_counts)}
ORACLES: dict[str, str] = {
    "token_rollup_words": r"""
        SELECT source, lang, 'words-1' AS tokenizer, count(*)::BIGINT AS n_docs,
               sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 2)::BIGINT AS n_tokens
        FROM documents WHERE source <> 'src1' OR source IS NULL GROUP BY source, lang""",
    "url_listed_rules": r"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
        s AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
        r AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(rule_host, rule_path, said)),
        f AS (SELECT page_id, host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(said, length(rule_host || rule_path)) AS said
              FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY ALL)
        SELECT h.page_id, h.host, h.path, f.rule, f.said FROM h LEFT JOIN f ON f.page_id = h.page_id""",
    "quality_base_counts": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
        g AS (SELECT doc_id, unnest(range(1, len(words) - 3)) AS k, words FROM w WHERE len(words) >= 5),
        x AS (SELECT doc_id, k, words[k:k + 4] AS gram FROM g),
        o AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM x) WHERE n > 1),
        c AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM o) GROUP BY doc_id),
        l AS (SELECT doc_id, (count(*) - count(DISTINCT line)) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        b AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda v: length(v))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols FROM w)
        SELECT b.*, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
               n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed
        FROM b LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)""",
}
