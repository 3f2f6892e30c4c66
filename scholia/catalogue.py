"""The engine's queries over the driver tables, each beside the same as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import adapters as ad
from .functions import boxes, code, repair, tables, text
from .operators import blocks as page_lines
from .operators import catalog, crosspage, filters, index, ingest, layout, library, reflow, selection, toc, vector
from .plans import dsl
from .sources import blocks, store
from .streaming import incremental

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_PREVIEW = """CASE WHEN length({0}) <= 120 THEN {0} WHEN regexp_extract({0}, '(?s)^(.{{120,299}}?[.?!])(?:\\s|\\z)', 1) <> '' THEN regexp_extract({0}, '(?s)^(.{{120,299}}?[.?!])(?:\\s|\\z)', 1)
  WHEN length({0}) > 300 THEN substr({0}, 1, 300) || '...' ELSE {0} END"""


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- filters ----


@query(f"WITH {ad.ARTICLES} SELECT paper_id, title FROM articles WHERE paper_id IN ('p1', 'p5', 'p''x', 'p12')")
def flt_in(spark, sf):
    return filters.matching(ad.articles(spark, sf), filters.articles(["p1", "p5", "p'x", "p12"])).select("paper_id", "title")


@query(f"WITH {ad.ARTICLES} SELECT count(*)::BIGINT AS articles FROM articles")
def flt_empty_list(spark, sf):
    return filters.matching(ad.articles(spark, sf), filters.articles([])).agg(F.count("*").alias("articles"))


@query(f"WITH {ad.ARTICLES} SELECT paper_id, year FROM articles WHERE year >= 2005 AND year <= 2011 AND venue = 'en'")
def flt_year_range(spark, sf):
    return filters.matching(ad.articles(spark, sf), filters.years(2005, 2011), filters.equals("venue", "en")).select("paper_id", "year")


@query(f"WITH {ad.ARTICLES} SELECT paper_id FROM articles WHERE list_has_any(tags, ['src3', 'fr'])")
def flt_tags_any(spark, sf):
    return filters.matching(ad.articles(spark, sf), filters.any_tag(["src3", "fr"])).select("paper_id")


@query(f"WITH {ad.ARTICLES} SELECT paper_id FROM articles WHERE len(list_filter(authors, lambda a: contains(lower(a), 'ada 3') OR contains(lower(a), 'bo 1'))) > 0")
def flt_author_any(spark, sf):
    return filters.matching(ad.articles(spark, sf), filters.any_author(["ADA 3", "bo 1"])).select("paper_id")


@query(f"WITH {ad.CHUNKS} SELECT chunk_id, text FROM chunks WHERE paper_id = 'p1' AND chapter_idx = 0 AND section_idx = 1")
def flt_scope(spark, sf):
    return filters.matching(ad.chunks(spark, sf), *filters.scope("p1", 0, 1)).select("chunk_id", "text")


# ---- scalar functions ----


@query(f"SELECT doc_id, {_PREVIEW.format('text')} AS preview FROM documents")
def fn_preview(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query(r"SELECT doc_id, ceil(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3)::BIGINT AS tokens FROM documents")
def fn_tokens(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>?|>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def fn_strip_html(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query('''SELECT page_id, regexp_extract(html, 'href="([^"]*)"', 1) AS href, regexp_extract(html, 'class="([^"]*)"', 1) AS class FROM pages''')
def fn_attribute(spark, sf):
    return ad.table(spark, sf, "pages").select("page_id", text.attribute(F.col("html"), "href").alias("href"), text.attribute(F.col("html"), "class").alias("class"))


@query("SELECT doc_id, '10.1000/x' || doc_id AS doi FROM documents")
def fn_doi_norm(spark, sf):
    head = F.element_at(F.array(*[F.lit(x) for x in ("https://doi.org/10.1000/X", "doi:10.1000/x", "10.1000/X", "http://dx.doi.org/10.1000/X")]), (F.col("doc_id") % 4).cast("int") + 1)
    return ad.table(spark, sf, "documents").select("doc_id", text.bare_doi(F.concat(head, "doc_id")).alias("doi"))


@query(r"""SELECT doc_id, array_to_string(list_transform(list_sort(list_transform(range(len(w)), lambda k: lpad(k::VARCHAR, 9, '0') || w[k + 1])), lambda x: substr(x, 10)), ' ') AS text
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS w FROM documents)""")
def fn_inverted_index(spark, sf):
    index_ = text.inverted_index(text.words(F.col("text")))
    return ad.table(spark, sf, "documents").select("doc_id", text.inverted_index_text(index_).alias("text"))


@query("SELECT doc_id, 'x$^{' || doc_id || '}$ and y$_{i}$' AS text FROM documents")
def fn_scripts(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", text.scripts_to_math(F.concat(F.lit("x <sup class='a'>"), "doc_id", F.lit("</sup> and y<sub>i</sub>"))).alias("text"))


@query("SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(a), ' ')), list_distinct(string_split(lower(b), ' ')))) / least(len(list_distinct(string_split(lower(a), ' '))), len(list_distinct(string_split(lower(b), ' ')))) AS ratio FROM (SELECT doc_id, source || ' ' || lang || ' x' AS a, 'X ' || lang || ' en' AS b FROM documents)")
def fn_word_overlap(spark, sf):
    rows = ad.table(spark, sf, "documents").select("doc_id", F.concat_ws(" ", "source", "lang", F.lit("x")).alias("a"), F.concat_ws(" ", F.lit("X"), "lang", F.lit("en")).alias("b"))
    return rows.select("doc_id", text.word_overlap(F.col("a"), F.col("b")).alias("ratio"))


@query("SELECT doc_id, (doc_id % 400 + 1)::INT AS value FROM documents")
def fn_roman(spark, sf):
    """Numbers written as Roman numerals and read back."""
    n = (F.col("doc_id") % 400 + 1).cast("int")
    digit = lambda one, five, ten, d: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), d.cast("int") + 1)
    roman = F.concat(digit("C", "D", "M", F.floor(n / 100)), digit("X", "L", "C", F.floor(n / 10) % 10), digit("I", "V", "X", n % 10))
    return ad.table(spark, sf, "documents").select("doc_id", text.roman_value(roman).alias("value"))


@query("SELECT doc_id, repeat('ab', doc_id::INT % 9) AS text FROM documents")
def fn_doubled_characters(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", text.doubled_characters(F.repeat(F.lit("aabb"), (F.col("doc_id") % 9).cast("int"))).alias("text"))


@query("SELECT item_type, count(*)::BIGINT AS n FROM (SELECT CASE event_type WHEN 'click' THEN 'document' ELSE 'document' END AS item_type FROM events UNION ALL SELECT CASE WHEN event_id % 3 = 0 THEN 'journalArticle' WHEN event_id % 3 = 1 THEN 'thesis' ELSE 'conferencePaper' END FROM events) GROUP BY item_type")
def fn_item_type(spark, sf):
    e = ad.table(spark, sf, "events")
    kinds = F.element_at(F.array(F.lit("review"), F.lit("dissertation"), F.lit("proceedings")), (F.col("event_id") % 3).cast("int") + 1)
    rows = e.select(text.item_type(F.col("event_type")).alias("item_type")).unionAll(e.select(text.item_type(kinds)))
    return rows.groupBy("item_type").agg(F.count("*").alias("n"))


@query("SELECT doc_id, (doc_id % 9 + 1)::INT AS a, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 50 + 3)::INT ELSE (doc_id % 50 + 1)::INT END AS b, '1.' || (doc_id % 12) AS section, CASE WHEN doc_id % 12 > 2 THEN 'later' ELSE 'earlier' END AS side FROM documents")
def fn_pages_and_sections(spark, sf):
    d, page = ad.table(spark, sf, "documents"), (F.col("doc_id") % 50).cast("int")
    value = F.when(F.col("doc_id") % 2 == 0, page + 1).otherwise(-(page + 1))
    number = F.concat(F.lit("1."), (F.col("doc_id") % 12))
    side = F.when(text.section_key(number) > F.array(F.lit(1), F.lit(2)), "later").otherwise("earlier")
    return d.select("doc_id", text.lenient_int(F.concat(F.lit(" "), F.col("doc_id") % 9 + 1)).cast("int").alias("a"), text.mapped_page(value, F.lit(3), F.lit(1)).alias("b"), number.alias("section"), side.alias("side"))


@query("SELECT event_id, exp((ln(1.0 / (event_id % 7 + 1)) + ln(0.5)) / 2)::DECIMAL(18, 6)::DOUBLE AS confidence, CASE WHEN value >= 50 THEN 0 ELSE 1 END::INT AS best FROM events")
def fn_confidence_argmax(spark, sf):
    e = ad.table(spark, sf, "events")
    logs = F.array(F.log(F.lit(1.0) / (F.col("event_id") % 7 + 1)), F.log(F.lit(0.5)))
    return e.select("event_id", F.round(text.sequence_confidence(logs), 6).alias("confidence"), text.argmax(F.array(F.col("value"), F.lit(100.0) - F.col("value"))).alias("best"))


@query("SELECT doc_id, md5('u' || chr(10) || 'a=' || doc_id || '&b=2' || chr(10)) AS key FROM documents")
def fn_request_key(spark, sf):
    return ad.table(spark, sf, "documents").select("doc_id", text.request_key(F.lit("u"), F.array(F.lit("b=2"), F.concat(F.lit("a="), "doc_id")), F.lit(None).cast("string")).alias("key"))


@query(r"""SELECT p_partkey, regexp_matches(s, '^10\..*/') AS doi, regexp_matches(s, '^(?:https?://\S+/)?[WATSPIF]\d+$') OR regexp_matches(s, '^(?:(?:domains|fields|subfields)/)?\d+$') AS entity, regexp_matches(s, '^[A-Z0-9]{8}$') AS item_key
  FROM (SELECT p_partkey, ['10.1/x', 'W123', 'https://host/A9', 'fields/3', 'ABCD1234', 'title words'][p_partkey % 6 + 1] AS s FROM part)""")
def fn_recognised_ids(spark, sf):
    s = F.element_at(F.array(*[F.lit(x) for x in ("10.1/x", "W123", "https://host/A9", "fields/3", "ABCD1234", "title words")]), (F.col("p_partkey") % 6).cast("int") + 1)
    return ad.table(spark, sf, "part").select("p_partkey", text.is_doi(s).alias("doi"), text.is_entity_id(s).alias("entity"), text.is_item_key(s).alias("item_key"))


@query()
def fn_table_markdown(spark, sf):
    """Tables with spans made of parts, as Markdown."""
    html = F.concat(F.lit("<table><tr><th colspan=2>"), "p_name", F.lit("</th><th>size</th></tr><tr><td rowspan=2>"), "p_brand", F.lit("</td><td>a</td><td>"), "p_size", F.lit("</td></tr><tr><td>b</td></tr></table>"))
    return ad.table(spark, sf, "part").select("p_partkey", tables.table_markdown(html).alias("markdown"))


@query(r"""SELECT doc_id, (regexp_matches(t, '[;{}]\s*(?:\n|$)'))::INT + (regexp_matches(t, '\w+\([^)]*\)'))::INT + (regexp_matches(t, '(?:==|!=|<=|>=|\+=|-=|->|=>|::|&&|\|\|)'))::INT AS score
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'x = f(' || doc_id || ');' ELSE 'plain words ' || doc_id END AS t FROM documents)""")
def fn_code_score(spark, sf):
    t = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("x = f("), "doc_id", F.lit(");"))).otherwise(F.concat(F.lit("plain words "), "doc_id"))
    return ad.table(spark, sf, "documents").select("doc_id", code.code_score(t).alias("score"))


# ---- vectors ----


@query(f"WITH {ad.VECTORS} SELECT chunk_id, paper_id, score FROM vectors WHERE label <> 3 AND year >= 2003 ORDER BY score, chunk_id LIMIT 10")
def vec_chunks(spark, sf):
    rows = filters.matching(ad.vectors(spark, sf).where("label <> 3"), filters.years(2003, None))
    return vector.nearest(rows, ad.query_vector(spark, sf), 10, "chunk_id").select("chunk_id", "paper_id", "score")


@query(f"WITH {ad.VECTORS} SELECT chunk_id AS exhibit_id, score FROM vectors WHERE paper_id IN ('p1', 'p2') ORDER BY score, chunk_id LIMIT 5")
def vec_exhibits(spark, sf):
    rows = filters.matching(ad.vectors(spark, sf), filters.articles(["p1", "p2"])).withColumnRenamed("chunk_id", "exhibit_id")
    return vector.nearest(rows, ad.query_vector(spark, sf), 5, "exhibit_id").select("exhibit_id", "score")


def _grouped_sql(keys: str, wide: int, extra: str = "") -> str:
    return f"""WITH {ad.VECTORS}, hits AS (SELECT * FROM vectors WHERE label <> 3 ORDER BY score, chunk_id LIMIT {wide})
  SELECT {keys}, min(score) AS score, arg_min(chunk_id, (score, chunk_id)) AS best_id, arg_min(text, (score, chunk_id)) AS preview, count(*)::BIGINT AS hits{extra} FROM hits GROUP BY {keys} ORDER BY score, {keys} LIMIT 5"""


@query(_grouped_sql("paper_id", 75))
def vec_works(spark, sf):
    return vector.search_works(ad.vectors(spark, sf).where("label <> 3"), ad.query_vector(spark, sf))


@query(_grouped_sql("paper_id, chapter_idx, section_idx", 50))
def vec_sections(spark, sf):
    return vector.search_sections(ad.vectors(spark, sf).where("label <> 3"), ad.query_vector(spark, sf))


@query(_grouped_sql("paper_id, chapter_idx", 75, ", count(DISTINCT section_idx)::BIGINT AS sections"))
def vec_chapters(spark, sf):
    return vector.search_chapters(ad.vectors(spark, sf).where("label <> 3"), ad.query_vector(spark, sf))


@query("""SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20""")
def vec_find(spark, sf):
    rows = ad.table(spark, sf, "embeddings").select("vec_id", vector.cosine(F.col("embedding"), ad.query_vector(spark, sf)).alias("score"))
    return rows.orderBy(F.desc("score"), "vec_id").limit(20)


@query(f"WITH {ad.CHUNKS} SELECT chunk_id, concat_ws(' — ', nullif(title, ''), 'Chapter ' || chapter_idx, nullif(section_title, '')) || chr(10) || chr(10) || text AS text FROM chunks")
def vec_embedding_text(spark, sf):
    rows = ad.chunks(spark, sf)
    return rows.select("chunk_id", vector.embedding_text(F.col("title"), F.concat(F.lit("Chapter "), "chapter_idx"), F.col("section_title"), F.col("text")).alias("text"))


@query()
def vec_embedder(spark, sf):
    """Hashed embeddings of conversation turns and the nearest of them to the first."""
    rows = ad.table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("chunk_id"), "text")
    embedded = lambda r: r.select("chunk_id", vector.hashing_embedder()(F.col("text")).alias("vector"))
    # One text comes to the driver; no other is embedded to find the first.
    first = embedded(spark.createDataFrame([rows.orderBy("chunk_id", "text").head()], rows.schema).coalesce(1)).head()
    return vector.nearest(embedded(rows), list(first["vector"]), 10, "chunk_id")


# ---- the index ----

_FIRST = "arg_min({0}, pos)"


@query(f"""WITH {ad.CHUNKS}, {ad.EXHIBITS}, c AS (SELECT paper_id, count(*) AS n FROM exhibits GROUP BY paper_id)
  SELECT p.paper_id, title, year, venue, array_to_string(authors, ';') AS authors, chunk_count, coalesce(n, 0)::BIGINT AS exhibit_count
  FROM (SELECT paper_id, {_FIRST.format('title')} AS title, {_FIRST.format('year')} AS year, {_FIRST.format('venue')} AS venue, {_FIRST.format('authors')} AS authors, count(*)::BIGINT AS chunk_count FROM chunks GROUP BY paper_id) p LEFT JOIN c USING (paper_id)
  WHERE len(list_filter(authors, lambda a: contains(lower(a), 'ada 2'))) > 0 ORDER BY year DESC NULLS LAST, p.paper_id LIMIT 20""")
def list_articles(spark, sf):
    rows = index.list_articles(ad.chunks(spark, sf), ad.exhibits(spark, sf), filters.any_author(["Ada 2"]), limit=20)
    return rows.select("paper_id", "title", "year", "venue", F.array_join("authors", ";").alias("authors"), "chunk_count", "exhibit_count")


@query(f"WITH {ad.CHUNKS} SELECT tag, count(DISTINCT paper_id)::BIGINT AS articles FROM (SELECT paper_id, unnest(tags) AS tag FROM chunks) GROUP BY tag")
def list_tags(spark, sf):
    return index.list_tags(ad.chunks(spark, sf))


@query(f"WITH {ad.CHUNKS} SELECT paper_id, chapter_idx, section_idx, any_value(section_title) AS section_title, count(*)::BIGINT AS chunk_count FROM chunks GROUP BY paper_id, chapter_idx, section_idx")
def list_sections(spark, sf):
    return index.list_sections(ad.chunks(spark, sf))


@query(f"WITH {ad.CHUNKS} SELECT paper_id, chapter_idx, count(DISTINCT section_idx)::BIGINT AS section_count, count(*)::BIGINT AS chunk_count FROM chunks GROUP BY paper_id, chapter_idx")
def list_chapters(spark, sf):
    return index.list_chapters(ad.chunks(spark, sf))


@query(f"WITH {ad.CHUNKS} SELECT paper_id, chapter_idx, count(*)::BIGINT AS chunk_count, count(DISTINCT section_idx)::BIGINT AS section_count FROM chunks GROUP BY ROLLUP (paper_id, chapter_idx)")
def outline_rollup(spark, sf):
    return index.outline_rollup(ad.chunks(spark, sf))


@query(f"""WITH {ad.CHUNKS}, {ad.EXHIBITS}, s AS (SELECT chapter_idx, section_idx, count(*) AS n FROM chunks WHERE paper_id = 'p3' GROUP BY ALL), e AS (SELECT chapter_idx, count(*) AS m FROM exhibits WHERE paper_id = 'p3' GROUP BY ALL)
  SELECT chapter_idx, string_agg(section_idx || ':' || n, ',' ORDER BY section_idx) AS sections, sum(n)::BIGINT AS chunk_count, coalesce(any_value(m), 0)::BIGINT AS exhibit_count FROM s LEFT JOIN e USING (chapter_idx) GROUP BY chapter_idx""")
def outline(spark, sf):
    return index.outline(ad.chunks(spark, sf), ad.exhibits(spark, sf), "p3")


@query(f"""WITH {ad.CHUNKS} SELECT paper_id, chapter_idx, section_idx, chunk_idx, chunk_id, count(*) OVER s::BIGINT AS chunks_in_section, (SELECT count(DISTINCT section_idx) FROM chunks d WHERE d.paper_id = c.paper_id AND d.chapter_idx = c.chapter_idx)::BIGINT AS sections_in_chapter,
  (SELECT count(DISTINCT chapter_idx) FROM chunks d WHERE d.paper_id = c.paper_id)::BIGINT AS chapters_in_paper, chunk_idx = min(chunk_idx) OVER s AS is_first, chunk_idx = max(chunk_idx) OVER s AS is_last FROM chunks c WINDOW s AS (PARTITION BY paper_id, chapter_idx, section_idx)""")
def position(spark, sf):
    return index.positions(ad.chunks(spark, sf))


_SHOW = _PREVIEW.format("{0}")


@query(f"""WITH {ad.CHUNKS}, w AS (SELECT *, lag(chunk_id) OVER s AS prev_id, lead(chunk_id) OVER s AS next_id, lag(text) OVER s AS p1, lag(text, 2) OVER s AS p2, lead(text) OVER s AS n1, lead(text, 2) OVER s AS n2, lag(block_type) OVER s AS pt, lead(block_type) OVER s AS nt
  FROM chunks WINDOW s AS (PARTITION BY paper_id, chapter_idx, section_idx ORDER BY chunk_idx))
  SELECT paper_id, chapter_idx, section_idx, chunk_idx, chunk_id, prev_id, next_id, CASE WHEN pt = 'equation' THEN concat_ws(' ', p2, p1) ELSE {_PREVIEW.format('p1')} END AS prev_preview, CASE WHEN nt = 'equation' THEN concat_ws(' ', n1, n2) ELSE {_PREVIEW.format('n1')} END AS next_preview FROM w""")
def neighbors(spark, sf):
    return index.neighbours(ad.chunks(spark, sf))


@query(f"WITH {ad.CHUNKS} SELECT paper_id, title, CASE WHEN paper_id = 'the' THEN 0 ELSE 1 END::INT AS rank FROM chunks WHERE paper_id = 'the' OR contains(lower(title), 'the') ORDER BY rank, paper_id LIMIT 1")
def resolve_paper(spark, sf):
    return index.resolve_paper(ad.chunks(spark, sf), "The")


@query(f"WITH {ad.ARTICLES} SELECT x AS paper_id, x IN (SELECT paper_id FROM articles) AS indexed FROM unnest(['p1', 'p2', 'nope']) t(x)")
def is_indexed(spark, sf):
    return index.is_indexed(ad.chunks(spark, sf), spark.createDataFrame([("p1",), ("p2",), ("nope",)], "paper_id string"))


@query(f"WITH {ad.CHUNKS} SELECT chunk_id, chunk_idx, text, count(*) OVER ()::BIGINT AS total FROM chunks WHERE paper_id = 'p3' AND chapter_idx = 0 AND section_idx = 0")
def get_section(spark, sf):
    return index.get_section(ad.chunks(spark, sf), "p3", 0, 0)


@query(f"""WITH {ad.CHUNKS}, x AS (SELECT section_idx, chunk_idx, chunk_id, unnest(exhibit_ids) AS e FROM chunks WHERE paper_id = 'p3' AND chapter_idx = 0), f AS (SELECT section_idx, e, min(chunk_idx) AS place FROM x GROUP BY ALL)
  SELECT section_idx, (SELECT string_agg(chunk_id, ',' ORDER BY chunk_idx) FROM chunks c WHERE c.paper_id = 'p3' AND c.chapter_idx = 0 AND c.section_idx = f.section_idx) AS chunk_ids, string_agg(e, ',' ORDER BY place) AS exhibit_ids FROM f GROUP BY section_idx""")
def get_chapter(spark, sf):
    return index.get_chapter(ad.chunks(spark, sf), "p3", 0)


@query(f"WITH {ad.CHUNKS} SELECT e AS exhibit_id, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM (SELECT chunk_id, unnest(exhibit_ids) AS e FROM chunks) GROUP BY e")
def exhibit_referenced_by(spark, sf):
    return index.referenced_by(ad.chunks(spark, sf))


@query(f"WITH {ad.CHUNKS}, {ad.EXHIBITS} SELECT chunk_id, x.exhibit_id, caption FROM (SELECT chunk_id, paper_id, unnest(exhibit_ids) AS exhibit_id FROM chunks WHERE paper_id = 'p3') x JOIN exhibits e ON e.exhibit_id = x.exhibit_id AND e.paper_id = 'p3'")
def chunk_exhibits(spark, sf):
    return index.referenced_exhibits(ad.chunks(spark, sf).where("paper_id = 'p3'"), ad.exhibits(spark, sf).where("paper_id = 'p3'"))


@query(f"WITH {ad.CHUNKS} SELECT paper_id, chapter_idx, section_idx, chunk_idx, chunk_id, {_PREVIEW.format('text')} AS preview FROM chunks ORDER BY paper_id, chapter_idx, section_idx, chunk_idx, chunk_id LIMIT 50")
def list_chunks(spark, sf):
    return index.list_chunks(ad.chunks(spark, sf))


# ---- ingest ----


@query(f"""WITH {ad.CHUNKS}, said AS (SELECT DISTINCT paper_id, chunk_id, doc_id % 3 AS number FROM chunks), {ad.EXHIBITS}
  SELECT s.paper_id, s.chunk_id, e.exhibit_id FROM said s JOIN exhibits e ON e.paper_id = s.paper_id AND e.exhibit_type = 'figure' AND s.number = e.chapter_idx""")
def xlink_mentions(spark, sf):
    c = ad.chunks(spark, sf).withColumn("text", F.concat(F.lit("see Figs. "), F.col("doc_id") % 3, F.lit(" and fig. "), F.col("doc_id") % 3))
    e = ad.exhibits(spark, sf).select("paper_id", "exhibit_id", F.col("chapter_idx").alias("exhibit_no"), F.concat(F.initcap("exhibit_type"), F.lit(" "), "chapter_idx", F.lit(": what it shows")).alias("caption"))
    return ingest.cross_links(c, e)


@query(f"""WITH {ad.CHUNKS} SELECT e AS exhibit_id, count(*)::BIGINT AS ref_count, arg_min(chunk_id, (chapter_idx, section_idx, chunk_idx, chunk_id)) AS first_ref_chunk_id
  FROM (SELECT *, paper_id || '/' || exhibit_ids[1] AS e FROM chunks) GROUP BY e""")
def exhibit_ref_stats(spark, sf):
    c = ad.chunks(spark, sf)
    return ingest.reference_stats(c.select("chunk_id", F.concat_ws("/", "paper_id", F.element_at("exhibit_ids", 1)).alias("exhibit_id")), c)


@query(f"""WITH {ad.SECTIONS}, l AS (SELECT doc AS paper_id, page, seq, CASE WHEN seq = 0 THEN 2 WHEN seq % 3 = 0 THEN 3 ELSE 6 END AS level FROM sections), c AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY paper_id ORDER BY page, seq) AS chapter_idx FROM l)
  SELECT paper_id, page, seq, chapter_idx::BIGINT AS chapter_idx, sum((level IN (3, 4))::INT) OVER (PARTITION BY paper_id, chapter_idx ORDER BY page, seq)::BIGINT AS section_idx FROM c""")
def heading_counters(spark, sf):
    rows = ad.sections(spark, sf).withColumnRenamed("doc", "paper_id").withColumn("level", F.when(F.col("seq") == 0, 2).when(F.col("seq") % 3 == 0, 3).otherwise(6))
    return ingest.heading_counters(rows, ["page", "seq"]).select("paper_id", "page", "seq", "chapter_idx", "section_idx")


@query()
def chunk_fold(spark, sf):
    """Documents' lines as blocks, folded into token-budgeted chunks."""
    s = ad.sections(spark, sf)
    kind = F.when(F.col("seq") == 0, "SectionHeader").otherwise("Text")
    html = F.when(F.col("seq") == 0, F.concat(F.lit("<h2>"), F.col("text"), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), "text", F.lit("</p>")))
    return ingest.folded(s.select(F.col("doc").alias("paper_id"), F.col("page").alias("page_no"), F.col("seq").alias("block_no"), kind.alias("block_type"), html.alias("html"), "page"))


@query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'skipped' WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ingested' END AS status, count(*)::BIGINT AS articles FROM documents GROUP BY ALL")
def ingest_outcomes(spark, sf):
    p = ad.articles(spark, sf).select("paper_id", "doc_id")
    return store.outcome_counts(p.select("paper_id"), p.where("doc_id % 2 = 0"), p.where("doc_id % 5 = 0"))


@query("SELECT doc_id, unnest(range(1 + doc_id % 5, 4 + doc_id % 5)) AS page FROM documents WHERE doc_id % 2 = 0")
def page_ranges(spark, sf):
    a = (1 + F.col("doc_id") % 5).cast("int")
    spec = F.when(F.col("doc_id") % 2 == 0, F.concat_ws(",", F.concat_ws("-", a, a + 1), a + 2, a)).otherwise("5-2")
    return ad.table(spark, sf, "documents").select("doc_id", F.explode(blocks.page_range_column(spec)).alias("page")).withColumn("page", F.col("page").cast("long"))


# ---- the catalog ----


@query(f"WITH {ad.WORKS} SELECT id FROM works WHERE author_id IN ('1', '5', '7') AND domain <> 'ASIA' AND publication_year >= 1993 AND publication_year <= 1996")
def cat_filter_and_or_not(spark, sf):
    text_ = catalog.alias_filter("works", {"author": "1|5|7", "year": "1993-1996", "open": False}, "!primary_topic.domain.id:ASIA")
    return dsl.filtered(ad.works(spark, sf), text_).select("id")


@query(f"WITH {ad.WORKS} SELECT id, cited_by_count FROM works WHERE cited_by_count > 150000 AND cited_by_count < 250000 AND country = 'CHINA' AND is_oa")
def cat_range(spark, sf):
    text_ = catalog.alias_filter("works", {"citations": ">150000", "country": "CHINA", "open": True}, "publication_year:>1990")
    return dsl.filtered(dsl.filtered(ad.works(spark, sf), text_), "cited_by_count:<250000").select("id", "cited_by_count")


@query(f"WITH {ad.WORKS} SELECT id, cited_by_count FROM works ORDER BY publication_year DESC, cited_by_count, id LIMIT 25 OFFSET 50")
def cat_sort_page(spark, sf):
    return dsl.page(ad.works(spark, sf), "publication_year:desc,cited_by_count", "id", 3, 25).select("id", "cited_by_count")


@query(f"WITH {ad.WORKS}, p AS (SELECT cited_by_count AS c, id AS i FROM works ORDER BY c DESC, i LIMIT 1 OFFSET 9) SELECT id, cited_by_count FROM works, p WHERE cited_by_count < c OR cited_by_count = c AND id > i ORDER BY cited_by_count DESC, id LIMIT 10")
def cat_cursor(spark, sf):
    works = ad.works(spark, sf).select("id", "cited_by_count")
    last = dsl.after(works, "cited_by_count", "id", None, 10).collect()[-1]
    return dsl.after(works, "cited_by_count", "id", (last["cited_by_count"], last["id"]), 10)


@query(f"WITH {ad.WORKS} SELECT id FROM works ORDER BY md5('7-' || id), id LIMIT 30")
def cat_sample(spark, sf):
    return dsl.sample(ad.works(spark, sf), 30, 7, "id").select("id")


@query(f"WITH {ad.WORKS} SELECT domain AS key, domain AS key_display_name, count(*)::BIGINT AS count FROM works GROUP BY domain")
def cat_group_by(spark, sf):
    return dsl.group_by(ad.works(spark, sf), "primary_topic.domain.id")


@query(f"WITH {ad.WORKS} SELECT id, doi FROM works WHERE publication_year = 1995")
def cat_select(spark, sf):
    return dsl.selected(dsl.filtered(ad.works(spark, sf), "publication_year:1995"), "id, doi")


@query(f"WITH {ad.WORKS} SELECT id FROM works WHERE list_contains(regexp_split_to_array(lower(display_name), '[^\\p{{L}}\\p{{N}}]+'), 'urgent')")
def cat_search(spark, sf):
    return dsl.searched(ad.works(spark, sf), "URGENT work", ["display_name"]).select("id")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '00001') ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 1")
def cat_resolve(spark, sf):
    return catalog.resolve_name(ad.table(spark, sf, "customer"), "00001", "c_custkey", "c_name", "c_acctbal").select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(lower(p_name), 'p') ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 10")
def cat_autocomplete(spark, sf):
    return catalog.autocomplete(ad.table(spark, sf, "part"), "P", "p_partkey", "p_name", "p_retailprice").select("p_partkey", "p_name")


@query(f"WITH {ad.WORKS} SELECT id, display_name AS title, doi, publication_year, type, author_name AS authors, journal, is_oa, NULL::VARCHAR AS oa_url, cited_by_count, topic AS primary_topic FROM works")
def cat_work_summary(spark, sf):
    return catalog.work_summary(ad.works(spark, sf))


@query(f"WITH {ad.WORKS} SELECT domain, id, place FROM (SELECT domain, id, row_number() OVER (PARTITION BY domain ORDER BY cited_by_count DESC, id)::INT AS place FROM works) WHERE place <= 3")
def cat_top_of_each(spark, sf):
    rows = ad.works(spark, sf).select(F.col("primary_topic.domain.id").alias("domain"), "id", "cited_by_count")
    return catalog.best_per_group(rows, "domain", [F.desc("cited_by_count"), F.col("id")], 3).select("domain", "id", "place")


# ---- the library ----


@query(f"WITH {ad.ITEMS} SELECT item_key, version FROM items WHERE version > 500")
def lib_since(spark, sf):
    return library.since(ad.items(spark, sf), 500).select("item_key", "version")


@query(f"WITH {ad.ITEMS} SELECT item_key, (version + CASE WHEN event_id % 4 = 0 THEN 100000 ELSE 0 END)::BIGINT AS version FROM items WHERE event_id % 10 <> 3")
def lib_tombstones(spark, sf):
    held = ad.items(spark, sf).select("item_key", "version", "event_id")
    changed = held.where("event_id % 4 = 0").withColumn("version", F.col("version") + 100000)
    return library.synced(held, changed, held.where("event_id % 10 = 3")).select("item_key", "version")


@query(f"WITH {ad.ITEMS} SELECT item_key FROM items WHERE (list_contains(tags, 't1') OR list_contains(tags, 't2')) AND NOT list_contains(tags, 'u0') AND item_type <> 'click'")
def lib_tag_expr(spark, sf):
    return ad.items(spark, sf).where(library.tagged("t1 || t2", "-u0") & library.of_type("-click")).select("item_key")


@query(f"WITH {ad.ITEMS} SELECT item_key FROM items WHERE NOT deleted AND parent_key IS NULL AND list_contains(collections, 'C2')")
def lib_scope(spark, sf):
    return library.scoped(ad.items(spark, sf), "collection top", "C2").select("item_key")


@query(f"WITH {ad.ITEMS} SELECT p.item_key, c.item_key AS child FROM items p JOIN items c ON c.parent_key = p.item_key WHERE c.content_type = 'application/pdf' AND c.link_mode IN ('imported_file', 'imported_url')")
def lib_children(spark, sf):
    items = ad.items(spark, sf)
    pdf = items.where(library.is_pdf()).select(F.col("item_key").alias("child"), F.col("parent_key").alias("item_key"))
    return items.select("item_key").join(pdf, "item_key")


@query(f"WITH {ad.ITEMS} SELECT item_key FROM items WHERE contains(lower(title), 'click 1')")
def lib_quick_search(spark, sf):
    return ad.items(spark, sf).where(library.quick_search("CLICK 1")).select("item_key")


@query(f"""WITH {ad.WORKS}, {ad.ITEMS}, pdf AS (SELECT DISTINCT parent_key FROM items WHERE content_type = 'application/pdf' AND link_mode = 'imported_file')
  SELECT w.id, i.item_key, pdf.parent_key IS NOT NULL AS has_pdf FROM works w JOIN items i ON '10.1/abc' || w.n = replace(i.doi, 'doi:', '') AND i.parent_key IS NULL LEFT JOIN pdf ON pdf.parent_key = i.item_key""")
def lib_linked_works(spark, sf):
    return library.linked_works(ad.works(spark, sf).select("id", "doi"), ad.items(spark, sf)).select("id", "item_key", "has_pdf")


@query(f"WITH {ad.ITEMS} SELECT item_key, CASE WHEN event_id % 3 = 0 THEN 'updated' WHEN event_id % 3 = 1 THEN 'conflict' ELSE 'created' END AS outcome FROM items")
def lib_versioned_writes(spark, sf):
    items = ad.items(spark, sf)
    expected = F.when(F.col("event_id") % 3 == 0, F.col("version")).when(F.col("event_id") % 3 == 1, F.col("version") + 7)
    return library.written_if_current(items.where("event_id % 3 <> 2"), items.select("item_key", expected.alias("expected")))


@query("SELECT max(event_id)::BIGINT AS version FROM events")
def lib_checkpoint(spark, sf):
    return library.checkpoint(ad.items(spark, sf))


# ---- selections ----


@query(f"""WITH a AS ({ad.entries_sql(1)}), b AS ({ad.entries_sql(3)}), n AS (SELECT b.*, lower(replace(doi, 'https://doi.org/', '')) AS bare FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.item_key = b.item_key OR a.entity_id = b.entity_id OR a.doi = b.doi)),
  f AS (SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY entry) AS x, row_number() OVER (PARTITION BY entity_id ORDER BY entry) AS y, row_number() OVER (PARTITION BY bare ORDER BY entry) AS z FROM n)
  SELECT entry FROM a UNION ALL SELECT entry FROM f WHERE (item_key IS NULL OR x = 1) AND (entity_id IS NULL OR y = 1) AND (bare IS NULL OR z = 1)""")
def sel_merge(spark, sf):
    return selection.merged(ad.entries(spark, sf, 1), ad.entries(spark, sf, 3), "entry").select("entry")


@query(f"WITH a AS ({ad.entries_sql(1)}) SELECT entry FROM a WHERE NOT coalesce(contains(lower(title), 'the'), false)")
def sel_remove(spark, sf):
    return selection.removed(ad.entries(spark, sf, 1), "the").select("entry")


@query(f"WITH a AS ({ad.entries_sql(1)}) SELECT count(*)::BIGINT AS entries, count(*) FILTER (entity_id IN (SELECT 'W' || (doc_id * 4) FROM documents))::BIGINT AS in_index, count(item_key)::BIGINT AS in_library FROM a")
def sel_status(spark, sf):
    indexed = ad.table(spark, sf, "documents").select(F.concat(F.lit("W"), F.col("doc_id") * 4).alias("paper_id"))
    return selection.status_counts(selection.status(ad.entries(spark, sf, 1), indexed))


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.lang, b.lang) AS lang, coalesce(a.source, b.source) AS source FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang, source FROM documents) a FULL JOIN (SELECT doc_id * 3 AS doc_id, 'x' AS lang, 'y' AS source FROM documents) b ON a.doc_id = b.doc_id")
def sel_coalesce(spark, sf):
    d = ad.table(spark, sf, "documents")
    mine = d.select("doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("lang")).alias("lang"), "source")
    return selection.filled(mine, d.select((F.col("doc_id") * 3).alias("doc_id"), F.lit("x").alias("lang"), F.lit("y").alias("source")), "doc_id", ["lang", "source"])


@query("SELECT doc_id AS entry, unnest(list_filter([CASE WHEN doc_id % 2 = 1 THEN 'create item' END, CASE WHEN doc_id % 3 <> 0 THEN 'upload file' END, CASE WHEN doc_id % 5 <> 0 THEN 'add to index' END], lambda x: x IS NOT NULL)) AS action FROM documents")
def sel_sync_plan(spark, sf):
    d = ad.table(spark, sf, "documents")
    return selection.sync_plan(d.select(F.col("doc_id").alias("entry"), F.when(F.col("doc_id") % 2 == 0, "K").alias("item_key"), (F.col("doc_id") % 3 == 0).alias("has_pdf"), (F.col("doc_id") % 5 == 0).alias("in_index")))


@query("SELECT n_name AS name, place::INT AS place FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS place FROM nation) WHERE place = 4")
def sel_by_place(spark, sf):
    return selection.by_place(ad.table(spark, sf, "nation").select(F.col("n_name").alias("name")), "4")


# ---- across pages ----


@query(f"""WITH {ad.SECTIONS}, k AS (SELECT DISTINCT doc, page, lower(trim(text)) AS key FROM sections WHERE strlen(lower(trim(text))) BETWEEN 3 AND 150)
  SELECT doc, key, count(*)::BIGINT AS pages FROM k GROUP BY doc, key HAVING count(*) >= 3""")
def running_text(spark, sf):
    return crosspage.running_text(ad.sections(spark, sf))


@query(f"""WITH {ad.SECTIONS}, p AS (SELECT doc, count(DISTINCT page) AS all_pages FROM sections GROUP BY doc), k AS (SELECT DISTINCT doc, page, 'draft of ' || doc AS key FROM sections WHERE page % 4 <> 0)
  SELECT doc, key, count(*)::BIGINT AS pages FROM k JOIN p USING (doc) GROUP BY doc, key, all_pages HAVING all_pages >= 5 AND count(*) > 0.5 * all_pages AND length(key) BETWEEN 5 AND 40""")
def watermarks(spark, sf):
    rows = ad.sections(spark, sf).select("doc", "page", F.when(F.col("page") % 4 != 0, F.concat(F.lit(" draft of "), "doc")).otherwise("x").alias("text"))
    return crosspage.watermarks(rows)


_FONTS = f"""{ad.SECTIONS}, seg AS (SELECT doc, page, seq, length(text) AS chars, CASE WHEN seq % 7 = 0 THEN 'Head' ELSE 'Body' END AS family, CASE WHEN seq % 7 = 0 THEN 28 + (seq % 3) * 2 ELSE 20 END::INT AS bucket, CASE WHEN seq % 7 = 0 THEN 14.0 + seq % 3 ELSE 10.0 END::DOUBLE AS height FROM sections),
fonts AS (SELECT doc, family, bucket, sum(chars)::BIGINT AS chars, count(*)::BIGINT AS segments, count(DISTINCT page)::BIGINT AS pages, list_sort(list(height))[count(*) // 2 + 1] AS height FROM seg GROUP BY ALL)"""


def _segments(spark, sf):
    head = F.col("seq") % 7 == 0
    s = ad.sections(spark, sf)
    return s.select("doc", "page", "seq", "text", F.when(head, "Head").otherwise("Body").alias("family"), F.when(head, 28 + (F.col("seq") % 3) * 2).otherwise(20).alias("bucket"), F.when(head, F.lit(14.0) + F.col("seq") % 3).otherwise(F.lit(10.0)).alias("height"))


@query(f"WITH {_FONTS} SELECT * FROM fonts")
def font_table(spark, sf):
    return crosspage.font_table(_segments(spark, sf))


@query(f"WITH {_FONTS} SELECT doc, family, bucket, chars, height FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, family, bucket) AS n FROM fonts) WHERE n = 1")
def body_font(spark, sf):
    return crosspage.body_font(crosspage.font_table(_segments(spark, sf)))


@query(f"""WITH {_FONTS}, body AS (SELECT doc, height AS h FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY chars DESC, family, bucket) AS n FROM fonts) WHERE n = 1)
  , c AS (SELECT *, coalesce(max(height) FILTER (segments >= 5) OVER (PARTITION BY doc), 0) AS tallest FROM fonts JOIN body USING (doc) WHERE height > h AND pages >= 2)
  SELECT doc, family, bucket, row_number() OVER (PARTITION BY doc ORDER BY height DESC, chars, family, bucket)::INT AS level FROM c WHERE (segments >= 5 OR height > tallest) AND chars >= 10""")
def heading_levels(spark, sf):
    pages = ad.sections(spark, sf).groupBy("doc").agg(F.countDistinct("page").alias("n_pages"))
    return crosspage.heading_levels(crosspage.font_table(_segments(spark, sf)), pages)


@query(f"""WITH {ad.SECTIONS} SELECT doc, 1::INT AS depth, 'part # of ' || doc_ AS pattern, count(DISTINCT page)::BIGINT AS pages FROM (SELECT *, regexp_replace(doc, '\\d+', '#', 'g') AS doc_ FROM sections) GROUP BY doc, doc_ HAVING count(DISTINCT page) >= 3""")
def repeated_headings(spark, sf):
    return crosspage.repeated_headings(ad.sections(spark, sf).select("doc", F.lit(1).alias("depth"), "page", F.concat(F.lit("Part "), "page", F.lit(" of "), "doc").alias("text")))


@query(f"""WITH {ad.REGIONS}, r AS (SELECT doc, page, x1 + 0.5 AS cx FROM regions), b AS (SELECT doc, page, floor(cx)::BIGINT AS bin, count(*) AS n FROM r GROUP BY ALL), s AS (SELECT doc, page, min(bin) AS low, max(bin) AS high, max(n) AS top FROM b GROUP BY ALL),
  e AS (SELECT doc, page, top, unnest(range(low, high + 1)) AS bin FROM s), f AS (SELECT e.* FROM e LEFT JOIN b USING (doc, page, bin) WHERE coalesce(n, 0) <= 0.1 * top), g AS (SELECT *, bin - row_number() OVER (PARTITION BY doc, page ORDER BY bin) AS run FROM f)
  SELECT doc, page, min(bin) AS gap_start, max(bin) AS gap_end FROM g GROUP BY doc, page, run HAVING max(bin) - min(bin) + 1 >= 8""")
def column_gaps(spark, sf):
    return crosspage.column_gaps(ad.regions(spark, sf).select("doc", "page", (F.col("x1") + 0.5).alias("cx")))


@query(f"""WITH {ad.SECTIONS}, t AS (SELECT doc, page, seq, CASE seq % 3 WHEN 0 THEN 'Running head of ' || doc ELSE 'note ' || seq END AS text, CASE seq % 3 WHEN 0 THEN 5.0 ELSE 400.0 END AS y1 FROM sections), k AS (SELECT DISTINCT doc, page, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{{L}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS key FROM t WHERE y1 < 96)
  SELECT doc, key, count(*)::BIGINT AS pages FROM k WHERE length(key) BETWEEN 3 AND 80 GROUP BY doc, key HAVING count(*) >= 3""")
def margin_stamps(spark, sf):
    head = F.col("seq") % 3 == 0
    rows = ad.sections(spark, sf).select("doc", "page", F.when(head, F.concat(F.lit("Running head of "), "doc")).otherwise(F.concat(F.lit("note "), "seq")).alias("text"), F.when(head, 5.0).otherwise(400.0).alias("y1"), F.when(head, 15.0).otherwise(410.0).alias("y2"), F.lit(200.0).alias("x1"), F.lit(300.0).alias("x2"), F.lit(800.0).alias("height"), F.lit(600.0).alias("width"))
    return crosspage.margin_stamps(rows)


@query("SELECT event_type AS kind, count(value)::BIGINT AS n, round(median(value), 6) AS median, min(value) AS low, max(value) AS high, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY event_type")
def numeric_summary(spark, sf):
    rows = crosspage.numeric_summary(ad.table(spark, sf, "events").withColumnRenamed("event_type", "kind"), "kind", "value")
    return rows.withColumns({"median": F.round("median", 6), "deviation": F.round("deviation", 6)})


_HEADS = f"{ad.SECTIONS}, h AS (SELECT doc, (page * 1000 + seq) AS seq, (1 + seq % 3)::INT AS depth, length(text) AS chars FROM sections)"


def _heads(spark, sf):
    return ad.sections(spark, sf).select("doc", (F.col("page") * 1000 + F.col("seq")).alias("seq"), (1 + F.col("seq") % 3).alias("depth"), F.length("text").alias("chars"))


@query(f"WITH {_HEADS} SELECT a.doc, a.seq, max(b.seq) AS parent_seq FROM h a LEFT JOIN h b ON a.doc = b.doc AND b.seq < a.seq AND b.depth < a.depth GROUP BY a.doc, a.seq")
def heading_tree(spark, sf):
    return crosspage.tree_parents(_heads(spark, sf))


@query(f"""WITH {_HEADS}, e AS (SELECT a.doc, a.seq, min(b.seq) AS nxt FROM h a LEFT JOIN h b ON a.doc = b.doc AND b.seq > a.seq AND b.depth <= a.depth GROUP BY a.doc, a.seq)
  SELECT e.doc, e.seq, sum(s.chars)::BIGINT AS chars FROM e JOIN h s ON s.doc = e.doc AND s.seq > e.seq AND (nxt IS NULL OR s.seq < nxt) GROUP BY e.doc, e.seq""")
def contained_characters(spark, sf):
    h = _heads(spark, sf)
    return crosspage.contained_characters(h.select("doc", "seq", "depth"), h.select("doc", "seq", "chars"))


@query(f"""WITH {_HEADS}, e AS (SELECT a.doc, a.seq, min(b.seq) AS nxt FROM h a LEFT JOIN h b ON a.doc = b.doc AND b.seq > a.seq AND b.depth <= a.depth GROUP BY a.doc, a.seq), k AS (SELECT e.doc, e.seq, sum(s.chars)::BIGINT AS chars FROM e JOIN h s ON s.doc = e.doc AND s.seq > e.seq AND (nxt IS NULL OR s.seq < nxt) GROUP BY e.doc, e.seq)
  SELECT doc, seq, chars FROM k WHERE chars >= 2000 OR seq % 5 IN (0, 3)""")
def substantial_headings(spark, sf):
    """Headings with much text under them, with a number, or of front matter."""
    h = _heads(spark, sf)
    held = crosspage.contained_characters(h.select("doc", "seq", "depth"), h.select("doc", "seq", "chars"))
    titles = F.array(*[F.lit(x) for x in ("2.1 Results", "Some results", "x 2 Results", "3 PREFACE ", "The preface")])
    return crosspage.substantial_headings(held.withColumn("title", F.get(titles, (F.col("seq") % 5).cast("int")))).select("doc", "seq", "chars")


@query(f"""WITH {ad.SECTIONS}, s AS (SELECT doc, page, seq, text, CASE WHEN seq % 7 = 0 THEN 'Head' ELSE 'Body' END AS family, ['AB+Text', 'CMMI10', 'Text-Bold', 'Other'][(seq // 7) % 4 + 1] AS raw FROM sections), f AS (SELECT doc, family, raw, min(page * 100000 + seq) AS place FROM s GROUP BY ALL),
  n AS (SELECT doc, family, array_to_string(list_slice(list(raw ORDER BY place), 1, 3), ',') AS raw_names FROM f GROUP BY ALL), t AS (SELECT doc, family, arg_min(text, page * 100000 + seq) AS first FROM s WHERE trim(text) <> '' GROUP BY ALL)
  SELECT n.doc, n.family, raw_names, contains(raw_names, 'CMMI10') AS is_math, CASE WHEN NOT contains(raw_names, 'CMMI10') THEN CASE WHEN strlen(first) > 60 THEN substr(first, 1, 57) || '...' ELSE first END END AS sample FROM n LEFT JOIN t ON t.doc = n.doc AND t.family = n.family""")
def font_names(spark, sf):
    """Raw names and samples of fonts, and which hold symbols."""
    raw = F.get(F.array(F.lit("AB+Text"), F.lit("CMMI10"), F.lit("Text-Bold"), F.lit("Other")), (F.floor(F.col("seq") / 7) % 4).cast("int"))
    rows = ad.sections(spark, sf).select("doc", "page", "seq", "text", F.when(F.col("seq") % 7 == 0, "Head").otherwise("Body").alias("family"), F.lit(20).alias("bucket"), F.lit(10.0).alias("height"), raw.alias("raw_name"))
    return crosspage.font_table(rows).select("doc", "family", F.array_join("raw_names", ",").alias("raw_names"), "is_math", "sample")


@query(f"""WITH {ad.VECTORS}, t AS (SELECT *, row_number() OVER (PARTITION BY paper_id, chapter_idx, section_idx ORDER BY chunk_id) AS k FROM vectors), h AS (SELECT * FROM t ORDER BY score, chunk_id LIMIT 10)
  SELECT h.chunk_id, h.score, a.chunk_id AS prev_id, b.chunk_id AS next_id FROM h LEFT JOIN t a ON a.paper_id = h.paper_id AND a.chapter_idx = h.chapter_idx AND a.section_idx = h.section_idx AND a.k = h.k - 1 LEFT JOIN t b ON b.paper_id = h.paper_id AND b.chapter_idx = h.chapter_idx AND b.section_idx = h.section_idx AND b.k = h.k + 1""")
def vec_context(spark, sf):
    """Nearest chunks with the chunks around them."""
    rows = ad.vectors(spark, sf).withColumns({"chunk_idx": F.col("chunk_id"), "block_type": F.lit("text"), "text": F.col("chunk_id").cast("string")})
    return vector.search_chunks(rows, ad.query_vector(spark, sf), 10).select("chunk_id", "score", "prev_id", "next_id")


@query("SELECT CASE WHEN count(*) = 0 THEN 'not found' WHEN count(*) = 1 THEN 'found' ELSE 'suggestions' END AS outcome, CASE WHEN count(*) = 1 THEN min(c_custkey) END AS id, CASE WHEN count(*) > 1 THEN string_agg(c_name || ' (' || c_nationkey || ')', '; ' ORDER BY c_nationkey DESC, c_custkey) END AS suggestions FROM (SELECT * FROM customer WHERE contains(lower(c_name), '0001') ORDER BY c_nationkey DESC, c_custkey LIMIT 200)")
def cat_resolve_work(spark, sf):
    return catalog.resolve_work(ad.table(spark, sf, "customer"), "0001", "c_custkey", "c_name", "c_nationkey")


@query(f"WITH {ad.ARTICLES}, {ad.EXHIBITS} SELECT paper_id, string_agg(CASE WHEN n = 1 THEN '1 ' || exhibit_type ELSE n || ' ' || exhibit_type || 's' END, ', ' ORDER BY exhibit_type) AS types FROM (SELECT paper_id, exhibit_type, count(*) AS n FROM exhibits GROUP BY ALL) GROUP BY paper_id")
def exhibit_types(spark, sf):
    return ingest.type_counts(ad.exhibits(spark, sf))


@query("SELECT event_id, event_id % 3 <> 0 AS is_ok, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'I' || event_id END AS keys, 'zotero://select/library/items/I' || event_id AS uri FROM events")
def lib_write_outcomes(spark, sf):
    n = F.col("event_id")
    e = ad.table(spark, sf, "events").select("event_id", F.create_map(F.lit("0"), F.when(n % 4 == 0, "{}").otherwise(F.concat(F.lit('{"key": "I'), n, F.lit('"}')))).alias("successful"), F.when(n % 3 == 0, F.create_map(F.lit("1"), F.lit("400"))).otherwise(F.from_json(F.lit("{}"), "map<string,string>")).alias("failed"))
    return library.write_outcomes(e).select("event_id", "is_ok", F.array_join("keys", ",").alias("keys"), library.item_uri(F.concat(F.lit("I"), "event_id")).alias("uri"))


@query(f"WITH {ad.ARTICLES}, {ad.EXHIBITS} SELECT * FROM exhibits WHERE exhibit_id = 'fig1' AND paper_id = 'p3'")
def exhibit_record(spark, sf):
    return index.get_exhibit(ad.exhibits(spark, sf).where("paper_id = 'p3'"), "fig1")


# ---- page geometry ----

_AREA = "(greatest({0}.x2 - {0}.x1, 0) * greatest({0}.y2 - {0}.y1, 0))"
_BOTH = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"""WITH {ad.REGIONS} SELECT DISTINCT a.doc, a.page, CASE WHEN {_AREA.format('a')} < {_AREA.format('b')} OR ({_AREA.format('a')} = {_AREA.format('b')} AND a.confidence < b.confidence) THEN a.id ELSE b.id END AS id FROM regions a JOIN regions b ON a.doc = b.doc AND a.page = b.page AND a.id < b.id
  WHERE a.kind IN ('Image', 'Chart', 'Seal') AND b.kind IN ('Image', 'Chart', 'Seal') AND least({_AREA.format('a')}, {_AREA.format('b')}) > 0 AND {_BOTH} / least({_AREA.format('a')}, {_AREA.format('b')}) > 0.5""")
def contained_visuals(spark, sf):
    return layout.contained_visuals(ad.regions(spark, sf))


@query(f"WITH {ad.REGIONS} SELECT a.doc, a.page, a.id AS a_id, b.id AS b_id, round({_BOTH}, 4) AS shared FROM regions a JOIN regions b ON a.doc = b.doc AND a.page = b.page AND a.id < b.id AND {_BOTH} > 0")
def box_overlap(spark, sf):
    """Boxes of a page that share area."""
    return layout.meeting_pairs(ad.regions(spark, sf)).select("doc", "page", "a_id", "b_id", F.round(boxes.intersection(boxes.box("a_"), boxes.box("b_")), 4).alias("shared"))


_NEXT_BOX = f"{ad.REGIONS}, p AS (SELECT *, lead(id) OVER w AS nid, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1, lead(x2) OVER w AS nx2, lead(y2) OVER w AS ny2 FROM regions WINDOW w AS (PARTITION BY doc, page ORDER BY id, x1, y1, x2, y2))"


@query(f"WITH {_NEXT_BOX} SELECT doc, page, id, round(sqrt(pow(greatest(x1 - nx2, nx1 - x2, 0), 2) + pow(greatest(y1 - ny2, ny1 - y2, 0), 2)), 4) AS distance FROM p WHERE nid IS NOT NULL")
def box_distance(spark, sf):
    """The distance of each box from the next one of its page."""
    w = Window.partitionBy("doc", "page").orderBy("id", "x1", "y1", "x2", "y2")
    rows = ad.regions(spark, sf).select("*", *[F.lead(c).over(w).alias(f"n_{c}") for c in ("id", "x1", "y1", "x2", "y2")]).where("n_id is not null")
    return rows.select("doc", "page", "id", F.round(boxes.edge_distance(boxes.box(), boxes.box("n_")), 4).alias("distance"))


@query(f"WITH {ad.REGIONS} SELECT DISTINCT t.doc, t.page, t.id FROM regions t JOIN regions o ON t.doc = o.doc AND t.page = o.page WHERE t.kind = 'Text' AND o.kind IN ('Image', 'Chart', 'Seal', 'PageHeader') AND t.x1 >= o.x1 - 1 AND t.y1 >= o.y1 - 1 AND t.x2 <= o.x2 + 1 AND t.y2 <= o.y2 + 1")
def inside_figures(spark, sf):
    return layout.inside_figures(ad.regions(spark, sf))


@query()
def reading_order(spark, sf):
    return layout.reading_order(ad.regions(spark, sf))


@query()
def figure_captions(spark, sf):
    return layout.captions(ad.regions(spark, sf))


@query()
def figure_groups(spark, sf):
    return layout.figure_groups(ad.regions(spark, sf))


# ---- contents ----


@query()
def toc_entries(spark, sf):
    """Contents pages made of documents' lines, parsed."""
    at = F.col("page") * 1000 + F.col("seq")
    rows = ad.sections(spark, sf).select("doc", at.alias("seq"), F.concat(at + 1, F.lit(" "), F.regexp_replace("text", r"[^\p{L} ]", ""), F.lit(" ......... "), at % 500 + 1).alias("text"))
    return toc.entries(rows)


_TOC = f"{ad.SECTIONS}, toc AS (SELECT doc, page * 1000 + seq AS seq, (1 + (page + seq) % 3)::INT AS depth, 'Title ' || chr(65 + page) || ' ' || seq AS title, (page * 1000 + seq + 1)::INT AS page_value FROM sections)"


def _toc(spark, sf):
    page, seq = F.col("page"), F.col("seq")
    at = page * 1000 + seq
    return ad.sections(spark, sf).select("doc", at.alias("seq"), (1 + (page + seq) % 3).alias("depth"), F.concat(F.lit("Title "), F.chr(F.lit(65) + page), F.lit(" "), seq).alias("title"), (at + 1).cast("int").alias("page_value"))


@query(f'WITH {_TOC} SELECT doc, 4::INT AS "offset", count(*)::BIGINT AS votes FROM toc WHERE seq % 4 <> 1 GROUP BY doc')
def toc_page_offset(spark, sf):
    t = _toc(spark, sf)
    heads = t.select("doc", F.concat(F.lit("1.2 "), F.upper("title"), F.lit(".")).alias("text"), F.when(F.col("seq") % 4 == 1, F.col("page_value") + 9 + F.col("seq")).otherwise(F.col("page_value") + 4).alias("page"))
    return toc.page_offsets(t, heads)


@query(f"""WITH {_TOC} SELECT a.doc, a.seq, a.page_value AS page_from, coalesce(greatest((SELECT arg_min(b.page_value, b.seq) FROM toc b WHERE b.doc = a.doc AND b.seq > a.seq AND b.depth <= a.depth) - 1, a.page_value), 120)::INT AS page_to FROM toc a""")
def toc_range(spark, sf):
    return toc.section_ranges(_toc(spark, sf), 120)


# ---- events ----


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_window(spark, sf):
    return incremental.windowed(ad.table(spark, sf, "events"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 minutes THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 minutes AS session_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, sf):
    return incremental.sessions(ad.table(spark, sf, "events"))


# ---- reflow ----


_NODES = f"{ad.SECTIONS}, nodes AS (SELECT doc, (page * 1000 + seq)::INT AS seq, page, (1 + seq % 2)::INT AS depth, CASE WHEN seq % 3 = 1 THEN NULL ELSE '1.' || (seq % 5 + 1) END AS number, text FROM sections)"


def _nodes(spark, sf):
    s = ad.sections(spark, sf)
    return s.select("doc", (F.col("page") * 1000 + F.col("seq")).cast("int").alias("seq"), "page", (1 + F.col("seq") % 2).cast("int").alias("depth"), F.when(F.col("seq") % 3 != 1, F.concat(F.lit("1."), F.col("seq") % 5 + 1)).alias("number"), "text")


@query()
def reflow_document(spark, sf):
    """Lines of documents as nodes, through all passes."""
    rows = _nodes(spark, sf).withColumn("kind", F.when(F.col("seq") % 1000 == 0, "heading").otherwise("text"))
    return reflow.reflowed(rows.select("doc", "seq", "kind", "depth", F.lit(None).cast("string").alias("number"), "text"))


@query()
def reflow_markdown(spark, sf):
    rows = _nodes(spark, sf).withColumn("kind", F.when(F.col("seq") % 1000 == 0, "heading").otherwise("text"))
    return reflow.rendered(rows.select("doc", "seq", "kind", "depth", "number", "text"))


@query(f"""WITH {_NODES}, k AS (SELECT *, regexp_replace(number, '\\.?\\d+$', '') AS parent, regexp_extract(number, '(\\d+)$', 1)::INT AS last FROM nodes WHERE number IS NOT NULL), s AS (SELECT doc, seq AS low, depth AS at_depth, last, lead(seq) OVER w AS high, lead(last) OVER w AS next_last FROM k WINDOW w AS (PARTITION BY doc, parent, depth ORDER BY seq))
  SELECT DISTINCT n.doc, n.seq FROM nodes n JOIN s ON s.doc = n.doc AND n.number IS NULL AND next_last = last + 1 AND n.seq > low AND n.seq < high AND n.depth <= at_depth""".replace("\\\\", "\\"))
def heading_interrupters(spark, sf):
    return reflow.interrupters(_nodes(spark, sf))


@query("SELECT 'd' || (doc_id // 20) AS doc, chr(65 + (doc_id % 3)::INT) AS letter, min(doc_id)::BIGINT AS before_seq FROM documents WHERE doc_id % 3 <> 1 GROUP BY ALL")
def appendix_parents(spark, sf):
    d = ad.table(spark, sf, "documents")
    letter = F.chr(F.lit(65) + F.col("doc_id") % 3)
    return reflow.appendix_parents(d.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20)).alias("doc"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 3 == 1, letter).otherwise(F.concat(letter, F.lit("."), F.col("doc_id") % 7 + 1)).alias("number")))


@query("SELECT doc, marker, seq FROM (SELECT 'd' || (doc_id // 20) AS doc, CASE WHEN doc_id % 4 = 0 THEN '' ELSE (doc_id % 6)::VARCHAR END AS marker, doc_id AS seq, row_number() OVER (PARTITION BY doc_id // 20, CASE WHEN doc_id % 4 = 0 THEN '' ELSE (doc_id % 6)::VARCHAR END ORDER BY doc_id) AS n FROM documents) WHERE n = 1 OR marker = ''")
def first_notes(spark, sf):
    d = ad.table(spark, sf, "documents")
    return reflow.first_notes(d.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20)).alias("doc"), F.when(F.col("doc_id") % 4 == 0, "").otherwise((F.col("doc_id") % 6).cast("string")).alias("marker"), F.col("doc_id").alias("seq")))


_LABELLED = "['Figure 3: ', 'Fig 12 ', 'Proof. ', 'figment of ', 'Thm. 2 ', ' Table iv) ', 'Lemma', 'ALG. 7.1a. ', 'Code 9 ', 'Tip '][doc_id % 10 + 1] || split_part(text, chr(10), 1 + (doc_id % 3)::INT)"
_WORDS = "|".join(w.replace(".", "[.]") for w in repair.VISUAL_LABELS + repair.STATEMENT_LABELS)
_VISUAL = ", ".join(f"'{w}'" for w in repair.VISUAL_LABELS)


@query(rf"""WITH t AS (SELECT doc_id, {_LABELLED} AS text FROM documents), w AS (SELECT *, lower(ltrim(text)) AS low, regexp_extract(lower(ltrim(text)), '^({_WORDS})($|[ .:0-9-])', 1) AS word FROM t), r AS (SELECT *, trim(substr(low, length(word) + 1)) AS rest FROM w)
  SELECT doc_id, CASE WHEN word <> '' AND CASE WHEN word IN ({_VISUAL}) THEN regexp_matches(rest, '^[.:]?\s*[0-9ivxlc]+([.][0-9]+)*[a-z]?\s*[.:)*]') OR (length(rest) < 80 AND regexp_matches(rest, '^[.:]?\s*[0-9]')) ELSE rest <> '' OR length(trim(text)) < 80 END THEN word END AS label FROM r""")
def fn_label(spark, sf):
    """Lines of documents behind openings that are labels or look like them."""
    forms = F.array(*[F.lit(x) for x in ("Figure 3: ", "Fig 12 ", "Proof. ", "figment of ", "Thm. 2 ", " Table iv) ", "Lemma", "ALG. 7.1a. ", "Code 9 ", "Tip ")])
    n = F.col("doc_id")
    line = F.concat(F.get(forms, (n % 10).cast("int")), F.split_part("text", F.lit("\n"), (1 + n % 3).cast("int")))
    return ad.table(spark, sf, "documents").select("doc_id", repair.label(line).alias("label"))


_LIGATURES = "CASE WHEN regexp_matches({0}, 'fifi|flfl|ffff') THEN replace(replace(replace(replace(replace({0}, 'ffiffi', 'ffi'), 'fflffl', 'ffl'), 'fifi', 'fi'), 'flfl', 'fl'), 'ffff', 'ff') ELSE {0} END"


@query(rf"""WITH d AS (SELECT doc_id, text, strlen(text) AS size, length(text) - length(replace(text, ' ', '')) AS spaces, length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters FROM documents),
  c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CASE WHEN size >= 51 AND spaces >= 5 AND NOT contains(text, '\') AND (letters + spaces) / size >= 0.7 THEN 'P' || text WHEN size > 50 AND spaces < 5 AND letters / size > 0.8 THEN 'P' || regexp_replace(text, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')
    ELSE 'P^{{' || text || '}}' END WHEN 1 THEN replace(text, 'ti', 'fifi') WHEN 2 THEN text || ' x ' ELSE text END AS text FROM d)
  SELECT doc_id, {_LIGATURES.format('text')} AS text FROM c""")
def fn_clean_block(spark, sf):
    """Documents as formulas, with doubled ligatures, with production marks, and twice over."""
    n, t = F.col("doc_id") % 4, F.col("text")
    raw = F.when(n == 0, F.concat(F.lit("P^{"), t, F.lit("}"))).when(n == 1, F.replace(t, F.lit("ti"), F.lit("fifi"))).when(n == 2, F.concat(t, F.lit(" x 53292_ch08.indd 206 9/14/17 10:10 AM"))).otherwise(F.concat(t, F.lit("\n\n"), t))
    return ad.table(spark, sf, "documents").select("doc_id", repair.clean_block(raw).alias("text"))


@query(r"""WITH d AS (SELECT doc_id, string_split(replace(text, 'e', chr(321)), '') AS c FROM documents)
  SELECT doc_id, array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN c[i] = chr(321) AND i > 1 AND i < len(c) AND regexp_matches(c[i - 1], '[\p{L}\p{N}]') AND regexp_matches(c[i + 1], '[\p{L}\p{N}]') THEN chr(8217) ELSE c[i] END), '') || ' ' || chr(8217) || 's ' || chr(8220) || 'q' || chr(8221) AS text FROM d""")
def fn_mojibake(spark, sf):
    """Documents with every e as the letter that stands for an apostrophe, and wrongly coded quotation marks behind."""
    t = F.concat(F.replace("text", F.lit("e"), F.lit("\u0141")), F.lit(" \u00e2\u0141\u2122s \u00e2\u0141\u201cq\u00e2\u0141\u201d"))
    return ad.table(spark, sf, "documents").select("doc_id", repair.without_mojibake(t).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, ' der ', 'd-' || chr(10) || 'x'), '(\p{Ll})-\n(\p{Ll})', '\1\2', 'g'), '\s*\n\s*', ' ', 'g'), '[ \t]+', ' ', 'g')) AS text FROM documents")
def fn_repairs(spark, sf):
    """Documents with words cut at line ends, joined into one line."""
    raw = F.replace("text", F.lit(" der "), F.lit("d-\nx"))
    return ad.table(spark, sf, "documents").select("doc_id", repair.single_spaces(repair.joined_hyphens(raw)).alias("text"))


@query("SELECT c_custkey, c_custkey % 2 = 0 AS same FROM customer")
def fn_title_match(spark, sf):
    a = F.concat(F.lit("2.1 Results of "), "c_mktsegment")
    b = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("RESULTS OF "), "c_mktsegment", F.lit("."))).otherwise("Quite another heading")
    return ad.table(spark, sf, "customer").select("c_custkey", repair.title_match(a, b).alias("same"))


@query("SELECT p_partkey, 'https://arxiv.org/pdf/' || p_partkey AS url FROM part")
def fetch_candidates(spark, sf):
    arxiv = F.concat(F.lit("https://arxiv.org/pdf/"), "p_partkey")
    urls = repair.fetch_candidates(F.lit("https://elsewhere.test/x"), arxiv, F.lit(None).cast("string"), arxiv)
    return ad.table(spark, sf, "part").select("p_partkey", F.explode(urls).alias("url"))


# ---- more geometry and cross-page statistics ----


@query()
def region_duplicates(spark, sf):
    return layout.without_duplicates(ad.regions(spark, sf))


@query()
def formula_numbers(spark, sf):
    kinds = F.when(F.col("kind") == "Image", "FormulaNumber").when(F.col("kind") == "Chart", "DisplayFormula").otherwise(F.col("kind"))
    return layout.formula_numbers(ad.regions(spark, sf).withColumn("kind", kinds))


@query()
def reference_columns(spark, sf):
    return layout.same_columns(ad.regions(spark, sf), "Text")


@query(f"""WITH {ad.REGIONS}, d AS (SELECT doc, page, id, kind, x1, y1, x2, y2, confidence FROM regions WHERE kind = 'Text' UNION ALL SELECT doc, page, 'a' || id, 'Abstract', x1, y1, x2 + (CASE WHEN page % 2 = 0 THEN 0 ELSE 90 END), y2, confidence FROM regions WHERE kind = 'Text')
  SELECT DISTINCT t.doc, t.page, CASE WHEN a.confidence > 0.5 THEN t.id ELSE a.id END AS id FROM d t JOIN d a ON t.doc = a.doc AND t.page = a.page AND t.kind = 'Text' AND a.kind = 'Abstract'
  WHERE greatest(least(t.x2, a.x2) - greatest(t.x1, a.x1), 0) * greatest(least(t.y2, a.y2) - greatest(t.y1, a.y1), 0) / greatest((t.x2 - t.x1) * (t.y2 - t.y1), (a.x2 - a.x1) * (a.y2 - a.y1)) >= 0.95""")
def abstract_duplicates(spark, sf):
    t = ad.regions(spark, sf).where("kind = 'Text'")
    a = t.withColumns({"id": F.concat(F.lit("a"), "id"), "kind": F.lit("Abstract"), "x2": F.col("x2") + F.when(F.col("page") % 2 == 0, 0).otherwise(90)})
    return layout.abstract_duplicates(t.unionByName(a))


@query(f"""WITH {ad.REGIONS} SELECT doc, page, id, string_agg(ch, '' ORDER BY seq) AS text FROM (SELECT r.doc, r.page, r.id, g.l_linenumber AS seq, chr(65 + g.l_linenumber) AS ch FROM regions r JOIN lineitem g ON r.doc = 'd' || (g.l_orderkey // 400) AND r.page = ((g.l_orderkey // 20) % 20) AND r.kind = 'Table'
  AND (g.l_linenumber * 60 + 5) BETWEEN r.x1 AND r.x2 AND (g.l_linenumber * 90 + 5) BETWEEN r.y1 AND r.y2) GROUP BY ALL""")
def glyphs_in_regions(spark, sf):
    g = ad.table(spark, sf, "lineitem")
    n = F.col("l_linenumber")
    glyphs = g.select(F.concat(F.lit("d"), F.floor(F.col("l_orderkey") / 400)).alias("doc"), F.floor(F.col("l_orderkey") / 20 % 20).cast("int").alias("page"), n.alias("seq"), F.chr(65 + n).alias("char"), (n * 60).alias("gx1"), (n * 60 + 10).alias("gx2"), (n * 90).alias("gy1"), (n * 90 + 10).alias("gy2"))
    return layout.glyphs_in_regions(glyphs, ad.regions(spark, sf).where("kind = 'Table'"))


@query(f"""WITH {ad.SECTIONS}, r AS (SELECT doc, page, CASE seq WHEN 0 THEN 'the head' ELSE 'line of ' || chr(97 + seq % 26) END AS key, 10.0 + seq * 100 AS y1 FROM sections), e AS (
  SELECT doc, page, key FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y1) AS n FROM r) WHERE n = 1 UNION ALL SELECT doc, page, key FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY y1 DESC) AS n FROM r) WHERE n = 1 UNION ALL SELECT doc, page, key FROM r WHERE y1 < 96 OR y1 + 10 > 680)
  SELECT doc, key, count(*)::BIGINT AS times FROM e GROUP BY doc, key HAVING count(*) >= 4""")
def running_headers(spark, sf):
    s = ad.sections(spark, sf)
    y = 10.0 + F.col("seq") * 100
    rows = s.select("doc", "page", F.when(F.col("seq") == 0, "The Head 12").otherwise(F.concat(F.lit("line of "), F.chr(97 + F.col("seq") % 26))).alias("text"), y.alias("y1"), (y + 10).alias("y2"), F.lit(50.0).alias("x1"), F.lit(90.0).alias("x2"), F.lit(800.0).alias("height"), F.lit(600.0).alias("width"))
    return crosspage.running_headers(rows)


@query(f"WITH {ad.SECTIONS} SELECT doc, (1 + seq % 3)::INT AS depth, avg((seq % 4 = 0)::INT) < 0.3 AS auto FROM sections GROUP BY doc, seq % 3")
def auto_numbered(spark, sf):
    s = ad.sections(spark, sf)
    return crosspage.auto_numbered(s.select("doc", (1 + F.col("seq") % 3).cast("int").alias("depth"), F.when(F.col("seq") % 4 == 0, "1.2 Head").otherwise("Head").alias("text")))


@query(f"""WITH {ad.SECTIONS}, g AS (SELECT doc, page, seq, CASE WHEN seq % 5 < 3 THEN 'A' ELSE 'B' END AS family, chr(97 + seq % 26) AS text FROM sections), c AS (SELECT *, CASE WHEN lag(family) OVER w = family THEN 0 ELSE 1 END AS fresh FROM g WINDOW w AS (PARTITION BY doc, page ORDER BY seq)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc, page ORDER BY seq)::BIGINT AS run FROM c)
  SELECT doc, page, run, any_value(family) AS family, string_agg(text, '' ORDER BY seq) AS text FROM r GROUP BY doc, page, run""")
def font_runs(spark, sf):
    s = ad.sections(spark, sf)
    return crosspage.font_runs(s.select("doc", "page", "seq", F.when(F.col("seq") % 5 < 3, "A").otherwise("B").alias("family"), F.chr(97 + F.col("seq") % 26).alias("text")))


@query(f"""WITH {_NODES} SELECT doc, seq, coalesce(len(string_split(number, '.')), last_value(len(string_split(number, '.')) IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, 1)::INT AS depth FROM nodes""")
def inferred_depths(spark, sf):
    return crosspage.inferred_depths(_nodes(spark, sf)).select("doc", "seq", F.col("depth").cast("int").alias("depth"))


@query(f"""WITH {ad.SECTIONS}, h AS (SELECT doc, page, 1 AS depth, seq, 'part ' || seq AS text, seq % 3 = 0 AS starts FROM sections), p AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc, page ORDER BY seq) AS part FROM h)
  SELECT doc, page, depth::INT AS depth, min(seq)::INT AS seq, string_agg(text, ' ' ORDER BY seq) AS text FROM p GROUP BY doc, page, depth, part""")
def merged_headings(spark, sf):
    s, seq = ad.sections(spark, sf), F.col("seq")
    y = seq * 12.0 + F.floor(seq / 3) * 50
    return reflow.merged_headings(s.select("doc", "page", F.lit(1).alias("depth"), "seq", F.concat(F.lit("part "), "seq").alias("text"), y.alias("y1"), (y + 10).alias("y2"), F.lit(10.0).alias("height")))


@query("SELECT 'd' || (doc_id // 20) AS doc, ['references', 'index'][doc_id % 2 + 1] AS title, count(*)::BIGINT AS times, count(*) = 1 AS sole FROM documents WHERE doc_id % 7 < 2 GROUP BY ALL")
def back_matter_titles(spark, sf):
    d = ad.table(spark, sf, "documents")
    title = F.when(F.col("doc_id") % 7 < 2, F.get(F.array(F.lit(" References"), F.lit("INDEX ")), (F.col("doc_id") % 2).cast("int"))).otherwise("Body")
    return reflow.back_matter_titles(d.select(F.concat(F.lit("d"), F.floor(F.col("doc_id") / 20)).alias("doc"), title.alias("text")), ["references", "index"])


@query(f"WITH {ad.REGIONS} SELECT doc, page, id, least(greatest(x1, 0), 400.0)::DOUBLE AS x1, least(greatest(x2, 0), 400.0)::DOUBLE AS x2 FROM regions WHERE confidence >= 0.5 AND kind IN ('Text', 'Table')")
def detections(spark, sf):
    rows = ad.regions(spark, sf).withColumns({"score": F.col("confidence"), "width": F.lit(400.0), "height": F.lit(500.0), "order_key": F.col("id")})
    return layout.detections(rows, ["Text", "Table"], 0.5).select("doc", "page", "id", "x1", "x2")


# ---- more of library, lines and contents ----


@query(f"WITH {ad.ITEMS} SELECT item_key, title FROM items ORDER BY title DESC NULLS LAST, item_key LIMIT 25 OFFSET 25")
def lib_listing(spark, sf):
    return library.listing(ad.items(spark, sf), "title", True, 25, 25).select("item_key", "title")


@query(f"WITH {ad.ITEMS} SELECT tag, count(DISTINCT item_key)::BIGINT AS items FROM (SELECT item_key, unnest(tags) AS tag FROM items) WHERE starts_with(lower(tag), 'u') GROUP BY tag")
def lib_tag_search(spark, sf):
    return library.searched_tags(ad.items(spark, sf), "U", "startsWith")


@query(f"WITH {ad.ITEMS} SELECT i.item_key, string_agg('Name ' || c, '; ' ORDER BY c) AS names FROM (SELECT item_key, unnest(collections) AS c FROM items) i WHERE c <> 'C3' GROUP BY i.item_key")
def lib_item_collections(spark, sf):
    names = spark.createDataFrame([(f"C{k}", f"Name C{k}") for k in range(3)], "collection_key string, name string")
    return library.item_collections(ad.items(spark, sf), names)


@query(f"""WITH {ad.ITEMS}, x AS (SELECT item_key, parent_key, CASE WHEN event_id % 2 = 0 THEN 'annotation' ELSE item_type END AS item_type, CASE WHEN event_id % 3 = 1 THEN 'text/html' ELSE content_type END AS content_type, event_id FROM items),
  y AS (SELECT item_key, CASE WHEN event_id % 3 = 1 THEN 'I' || (event_id - 1) ELSE parent_key END AS parent_key, item_type, content_type FROM x)
  SELECT w.item_key AS work_key, a.item_key AS attachment_key, n.item_key AS annotation_key FROM y w JOIN y a ON a.parent_key = w.item_key AND a.content_type IN ('application/pdf', 'application/epub+zip', 'text/html') JOIN y n ON n.parent_key = a.item_key AND n.item_type = 'annotation' WHERE w.parent_key IS NULL""")
def lib_annotations(spark, sf):
    items = ad.items(spark, sf)
    second = F.col("event_id") % 3 == 1
    rows = items.select("item_key", F.when(second, F.concat(F.lit("I"), F.col("event_id") - 1)).otherwise(F.col("parent_key")).alias("parent_key"), F.when(F.col("event_id") % 2 == 0, "annotation").otherwise(F.col("item_type")).alias("item_type"), F.when(second, "text/html").otherwise(F.col("content_type")).alias("content_type"))
    return library.annotations_of(rows).select("work_key", "attachment_key", "annotation_key")


@query("SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), '0002') ORDER BY c_custkey LIMIT 1")
def lib_resolve(spark, sf):
    rows = ad.table(spark, sf, "customer").select("c_custkey", "c_name")
    return library.found_by_key_or_name(rows.withColumn("k", F.lpad(F.col("c_custkey").cast("string"), 12, "0")), "0002", "k", "c_name").select("c_custkey", "c_name")


@query("SELECT 'I' || (event_id % 50) AS item_key, max(event_id)::BIGINT AS version FROM events WHERE event_id > 300 GROUP BY event_id % 50")
def lib_fulltext_versions(spark, sf):
    e = ad.table(spark, sf, "events")
    return library.fulltext_versions(e.select(F.concat(F.lit("I"), F.col("event_id") % 50).alias("item_key"), F.col("event_id").alias("version")), 300)


@query("SELECT event_id FROM events WHERE 500 - event_id <= 120")
def cache_fresh(spark, sf):
    return blocks.fresh(ad.table(spark, sf, "events").select("event_id", F.col("event_id").alias("ts")), F.lit(500), 120).select("event_id")


@query()
def page_blocks(spark, sf):
    """Regions as lines, grouped into blocks."""
    rows = ad.regions(spark, sf).select("doc", "page", "x1", "y1", "x2", "y2", (F.col("confidence") * 10 + 5).alias("size"), F.concat(F.lit("line "), "id").alias("text"))
    return page_lines.page_blocks(rows)


@query(f"WITH {ad.SECTIONS}, h AS (SELECT doc, page, (page * 1000 + seq) AS seq, seq * 10.0 AS y2 FROM sections WHERE seq % 3 = 0), c AS (SELECT doc, page, seq * 10.0 AS y1 FROM sections WHERE seq % 3 = 1) SELECT doc, seq FROM h WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = h.doc AND c.page = h.page AND c.y1 >= h.y2)")
def empty_headings(spark, sf):
    s = ad.sections(spark, sf)
    return page_lines.empty_headings(s.where("seq % 3 = 0").select("doc", "page", (F.col("page") * 1000 + F.col("seq")).alias("seq"), (F.col("seq") * 10.0).alias("y2")), s.where("seq % 3 = 1").select("doc", "page", (F.col("seq") * 10.0).alias("y1")))


@query(f"WITH {ad.SECTIONS}, n AS (SELECT doc, page * 1000 + seq AS seq, CASE WHEN seq = 0 THEN 1 ELSE 2 END AS depth, CASE WHEN seq = 0 AND page % 4 = 0 THEN TRUE WHEN seq = 0 THEN FALSE END AS top FROM sections), m AS (SELECT *, last_value(top IGNORE NULLS) OVER (PARTITION BY doc ORDER BY seq ROWS UNBOUNDED PRECEDING) AS f FROM n) SELECT doc, seq FROM m WHERE depth = 1 OR NOT coalesce(f, false)")
def front_matter_collapse(spark, sf):
    s, first = ad.sections(spark, sf), F.col("seq") == 0
    rows = s.select("doc", (F.col("page") * 1000 + F.col("seq")).alias("seq"), F.when(first, 1).otherwise(2).alias("depth"), F.when(first & (F.col("page") % 4 == 0), "Preface ").otherwise("Body").alias("text"))
    return page_lines.collapsed_front_matter(rows, ["preface"]).select("doc", "seq")


@query(f"WITH {_TOC}, b AS (SELECT doc, page * 1000 + seq AS page, unnest([0, 1, 2]) AS block FROM sections) SELECT t.doc, t.seq, min(block)::INT AS block FROM toc t JOIN b ON b.doc = t.doc AND b.page = t.seq AND b.block > 0 GROUP BY t.doc, t.seq")
def contents_anchors(spark, sf):
    t = _toc(spark, sf)
    b = t.select("doc", F.col("seq").alias("page"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("block"), F.upper("title").alias("title"))
    b = b.withColumn("text", F.when(F.col("block") == 0, "other words").otherwise(F.concat("title", F.lit(": and on"))))
    return page_lines.contents_anchors(t.select("doc", "seq", F.col("seq").alias("page"), "title"), b)


@query()
def chunk_fold_tree(spark, sf):
    """Lines as reflow nodes, folded into chunks by the tree's rules."""
    s = ad.sections(spark, sf)
    kind = F.when(F.col("seq") == 0, "heading").when(F.col("seq") % 9 == 8, "formula").otherwise("text")
    return ingest.folded_trees(s.select(F.col("doc").alias("paper_id"), (F.col("page") * 1000 + F.col("seq")).alias("seq"), kind.alias("type"), F.when(F.col("seq") == 0, 1 + F.col("page") % 3).cast("int").alias("depth"), "text", F.lit("{}").alias("payload")))
