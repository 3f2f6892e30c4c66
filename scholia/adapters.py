"""Views of the driver tables as the engine's logical tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("p"), F.col("doc_id")).alias("paper_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), (2000 + F.col("doc_id") % 25).cast("int").alias("year"), F.col("lang").alias("venue"),
        F.array(F.concat(F.lit("Ada "), F.col("doc_id") % 7), F.concat(F.lit("Bo "), F.col("doc_id") % 11)).alias("authors"), F.array("source", "lang").alias("tags"), "text", "doc_id",
    )


ARTICLES = """articles AS (SELECT 'p' || doc_id AS paper_id, split_part(text, chr(10), 1) AS title, (2000 + doc_id % 25)::INT AS year, lang AS venue,
  ['Ada ' || (doc_id % 7), 'Bo ' || (doc_id % 11)] AS authors, [source, lang] AS tags, text, doc_id FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: eight lines a chapter, four a section; every fifth is an equation; one exhibit each."""
    p = articles(spark, sf_dir)
    rows = p.select("paper_id", "title", "year", "venue", "authors", "tags", "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    place = F.col("pos")
    return rows.select(
        F.concat_ws("/", "paper_id", place).alias("chunk_id"), "paper_id", "title", "year", "venue", "authors", "tags", F.floor(place / 8).cast("int").alias("chapter_idx"), (F.floor(place / 4) % 2).cast("int").alias("section_idx"), (place % 4).alias("chunk_idx"),
        F.concat(F.lit("Section "), (F.floor(place / 4) % 2)).alias("section_title"), F.when(place % 5 == 4, "equation").otherwise("text").alias("block_type"), "text", F.array(F.concat(F.lit("fig"), place % 3)).alias("exhibit_ids"), "pos", "doc_id",
    )


CHUNKS = f"""{ARTICLES}, lines AS (SELECT *, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM articles),
chunks AS (SELECT paper_id || '/' || pos AS chunk_id, paper_id, title, year, venue, authors, tags, (pos // 8)::INT AS chapter_idx, ((pos // 4) % 2)::INT AS section_idx, (pos % 4)::INT AS chunk_idx,
  'Section ' || ((pos // 4) % 2) AS section_title, CASE WHEN pos % 5 = 4 THEN 'equation' ELSE 'text' END AS block_type, line AS text, ['fig' || (pos % 3)] AS exhibit_ids, pos, doc_id FROM lines)"""


def exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three exhibits for every third paper."""
    p = articles(spark, sf_dir).where("doc_id % 3 = 0").select("paper_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("n"))
    return p.select(F.concat(F.lit("fig"), "n").alias("exhibit_id"), "paper_id", F.element_at(F.array(F.lit("figure"), F.lit("table"), F.lit("algorithm")), F.col("n") + 1).alias("exhibit_type"), F.concat(F.lit("Caption "), "n").alias("caption"), F.col("n").alias("chapter_idx"))


EXHIBITS = """exhibits AS (SELECT 'fig' || n AS exhibit_id, paper_id, ['figure', 'table', 'algorithm'][n + 1] AS exhibit_type, 'Caption ' || n AS caption, n::INT AS chapter_idx
  FROM articles, unnest([0, 1, 2]) t(n) WHERE doc_id % 3 = 0)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as chunk vectors."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("p"), "label").alias("paper_id"), (F.col("vec_id") % 4).cast("int").alias("chapter_idx"), (F.col("vec_id") % 3).cast("int").alias("section_idx"), (2000 + F.col("vec_id") % 20).cast("int").alias("year"), F.concat(F.lit("Text of "), "vec_id").alias("text"), F.col("embedding").alias("vector"), "label")


VECTORS = """vectors AS (SELECT vec_id AS chunk_id, 'p' || label AS paper_id, (vec_id % 4)::INT AS chapter_idx, (vec_id % 3)::INT AS section_idx, (2000 + vec_id % 20)::INT AS year, 'Text of ' || vec_id AS text,
  round(pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 2), 6) AS score, label FROM embeddings)"""


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The first embedding, as a query."""
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").head()["embedding"])


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested catalog works, of authors (customers), with a hierarchy (nation in region) and locations (suppliers of their first lines)."""
    t = lambda n: table(spark, sf_dir, n)
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = t("orders").join(people, F.col("o_custkey") == F.col("c_custkey"))
    author = F.struct(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("display_name")).alias("author"), F.array(F.struct(F.col("n_name").alias("country_code"))).alias("institutions"))
    return o.select(
        F.concat(F.lit("W"), "o_orderkey").alias("id"), F.concat(F.lit("Work "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey")).alias("display_name"), F.concat(F.lit("https://doi.org/10.1/ABC"), "o_orderkey").alias("doi"),
        F.year("o_orderdate").alias("publication_year"), F.col("o_orderstatus").alias("type"), F.array(author).alias("authorships"), F.floor("o_totalprice").cast("long").alias("cited_by_count"), (F.col("o_orderkey") % 2 == 0).alias("is_oa"),
        F.struct(F.col("n_name").alias("id"), F.col("n_name").alias("display_name"), F.struct(F.col("r_name").alias("id")).alias("domain")).alias("primary_topic"),
        F.struct(F.struct(F.col("c_mktsegment").alias("display_name")).alias("source")).alias("primary_location"), F.struct((F.col("o_orderkey") % 2 == 0).alias("is_oa"), F.lit(None).cast("string").alias("oa_url")).alias("open_access"), F.col("o_orderkey").alias("n"),
    )


WORKS = """works AS (SELECT 'W' || o_orderkey AS id, 'Work ' || o_orderpriority || ' ' || o_orderkey AS display_name, 'https://doi.org/10.1/ABC' || o_orderkey AS doi, year(o_orderdate)::INT AS publication_year, o_orderstatus AS type,
  c_custkey::VARCHAR AS author_id, c_name AS author_name, n_name AS country, floor(o_totalprice)::BIGINT AS cited_by_count, o_orderkey % 2 = 0 AS is_oa, n_name AS topic, r_name AS domain, c_mktsegment AS journal, o_orderkey AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as library items: a third are children of the item before."""
    e = table(spark, sf_dir, "events")
    child = F.col("event_id") % 3 == 2
    return e.select(
        F.concat(F.lit("I"), "event_id").alias("item_key"), F.col("event_id").alias("version"), F.col("event_type").alias("item_type"), F.when(child, F.concat(F.lit("I"), F.col("event_id") - 1)).alias("parent_key"),
        F.array(F.concat(F.lit("t"), F.col("event_id") % 5), F.concat(F.lit("u"), F.col("user_id") % 3)).alias("tags"), F.array(F.concat(F.lit("C"), F.col("user_id") % 4)).alias("collections"), (F.col("event_id") % 11 == 0).alias("deleted"),
        F.when(~child, F.concat(F.lit("doi:10.1/abc"), "event_id")).alias("doi"), F.when(child, F.element_at(F.array(F.lit("application/pdf"), F.lit("text/html"), F.lit("image/png")), (F.col("event_id") % 9 / 3).cast("int") + 1)).alias("content_type"),
        F.when(F.col("event_id") % 2 == 0, "imported_file").otherwise("linked_url").alias("link_mode"), F.concat(F.lit("Title "), F.col("event_type"), F.lit(" "), F.col("event_id")).alias("title"), F.lit("").alias("creators"), F.lit("2020").alias("year"), F.col("event_id"), F.col("user_id"),
    )


ITEMS = """items AS (SELECT 'I' || event_id AS item_key, event_id AS version, event_type AS item_type, CASE WHEN event_id % 3 = 2 THEN 'I' || (event_id - 1) END AS parent_key, ['t' || (event_id % 5), 'u' || (user_id % 3)] AS tags,
  ['C' || (user_id % 4)] AS collections, event_id % 11 = 0 AS deleted, CASE WHEN event_id % 3 <> 2 THEN 'doi:10.1/abc' || event_id END AS doi,
  CASE WHEN event_id % 3 = 2 THEN ['application/pdf', 'text/html', 'image/png'][(event_id % 9) // 3 + 1] END AS content_type, CASE WHEN event_id % 2 = 0 THEN 'imported_file' ELSE 'linked_url' END AS link_mode,
  'Title ' || event_type || ' ' || event_id AS title, event_id, user_id FROM events)"""


def entries(spark: SparkSession, sf_dir: str, times: int) -> DataFrame:
    """Documents as a selection's entries; keys are made of ``times`` their ids, so selections of different ``times`` share some."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id") * times
    return d.select(F.col("doc_id").alias("entry"), F.when(n % 2 == 0, F.concat(F.lit("K"), n)).alias("item_key"), F.when(n % 7 == 0, F.concat(F.lit("W"), n)).alias("entity_id"), F.when(n % 3 == 0, F.concat(F.lit("https://doi.org/10.5/D"), F.floor(n / 2))).alias("doi"), F.col("text").alias("title"))


def entries_sql(times: int) -> str:
    n = f"(doc_id * {times})"
    return f"SELECT doc_id AS entry, CASE WHEN {n} % 2 = 0 THEN 'K' || {n} END AS item_key, CASE WHEN {n} % 7 = 0 THEN 'W' || {n} END AS entity_id, CASE WHEN {n} % 3 = 0 THEN 'https://doi.org/10.5/D' || ({n} // 2) END AS doi, text AS title FROM documents"


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as page regions: boxes from their numbers, forty to a page."""
    o = table(spark, sf_dir, "lineitem")
    k, x, y = F.col("l_orderkey") * 7 + F.col("l_linenumber"), (F.col("l_partkey") * 37 % 500).cast("double"), (F.col("l_suppkey") * 91 % 700).cast("double")
    return o.select(F.concat(F.lit("d"), F.floor(F.col("l_orderkey") / 400)).alias("doc"), F.floor(F.col("l_orderkey") / 20 % 20).cast("int").alias("page"), F.lpad(k.cast("string"), 9, "0").alias("id"), F.element_at(F.array(*[F.lit(v) for v in ("Image", "Chart", "Text", "Table", "FigureTitle")]), (k % 5).cast("int") + 1).alias("kind"), x.alias("x1"), y.alias("y1"), (x + F.col("l_quantity") * 2).alias("x2"), (y + F.col("l_quantity") * 3).alias("y2"), (F.col("l_quantity") / 50).alias("confidence"))


REGIONS = """regions AS (SELECT 'd' || (l_orderkey // 400) AS doc, ((l_orderkey // 20) % 20)::INT AS page, lpad((l_orderkey * 7 + l_linenumber)::VARCHAR, 9, '0') AS id, ['Image', 'Chart', 'Text', 'Table', 'FigureTitle'][(l_orderkey * 7 + l_linenumber) % 5 + 1] AS kind,
  (l_partkey * 37 % 500)::DOUBLE AS x1, (l_suppkey * 91 % 700)::DOUBLE AS y1, (l_partkey * 37 % 500) + l_quantity * 2 AS x2, (l_suppkey * 91 % 700) + l_quantity * 3 AS y2, l_quantity / 50 AS confidence FROM lineitem)"""


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections of pages: twenty documents are the pages of one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return d.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20)).alias("doc"), (F.col("doc_id") % 20).cast("int").alias("page"), F.col("pos").alias("seq"), "text")


SECTIONS = """sections AS (SELECT 'd' || (doc_id // 20) AS doc, (doc_id % 20)::INT AS page, unnest(range(len(string_split(text, chr(10)))))::INT AS seq, unnest(string_split(text, chr(10))) AS text FROM documents)"""
