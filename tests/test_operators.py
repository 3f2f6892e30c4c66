"""Folds, compilers and stores on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from scholia import schemas
from scholia.functions import code, formula, repair, tables, text
from scholia.operators import blocks as page_lines
from scholia.operators import ann, catalog, crosspage, filters, ingest, layout, library, ordered, reflow, selection, toc, vector
from scholia.plans import dsl
from scholia.sources import blocks
from scholia.sources.embeddings import EmbeddingCache
from scholia.sources.selections import Selections
from scholia.sources.store import Store
from scholia.streaming import incremental


def column(spark, expression, **values):
    return spark.range(1).select(expression(*[F.lit(v) for v in values.values()]).alias("x")).head()["x"]


# ---- scalar functions ----


@pytest.mark.parametrize(("given", "want"), [("short.", "short."), ("a" * 119 + ". tail " + "b" * 100, "a" * 119 + ". tail " + "b" * 100), ("a" * 120 + ". tail " + "b" * 100, "a" * 120 + "."), ("a" * 400, "a" * 300 + "..."), ("é" * 130 + "! x" + "y" * 200, "é" * 130 + "!")])
def test_preview(spark, given, want):
    assert column(spark, text.preview, t=given) == want


@pytest.mark.parametrize(("given", "want"), [("", 0), ("one", 2), ("a b c d e f g h i j", 13), ("  spaced \n out ", 3)])
def test_tokens(spark, given, want):
    assert column(spark, text.estimate_tokens, t=given) == want == ingest.tokens(given)


def test_text_functions(spark):
    one = lambda f, *v: spark.range(1).select(f(*[F.lit(x) for x in v]).alias("x")).head()["x"]
    assert one(text.strip_html_keep_math, "<p>a <math display='x'>y^2</math> b</p>") == "a $y^2$ b"
    assert one(text.scripts_to_math, "CO <sub>2</sub> and x<sup>n</sup>") == "CO$_{2}$ and x$^{n}$"
    assert one(text.bare_doi, "https://doi.org/10.1/AbC") == one(text.bare_doi, "doi:10.1/abc") == "10.1/abc"
    assert [one(text.roman_value, x) for x in ("xiv", "MCMXC", "iiii", "", "vx")] == [14, 1990, None, None, None]
    assert one(text.distinct_paragraphs, "a\n\na\n\nb") == "a\n\nb"
    assert one(text.doubled_characters, "HHeelllloo wwoorrlldd") == "Hello world" and one(text.doubled_characters, "hello world") == "hello world"
    assert one(text.single_ligatures, "eﬃ fifind flflow") == "eﬃ find flow"
    assert one(text.without_production_marks, "Body p.indd 12/3/04 10:22 AM") == "Body "
    assert one(text.heading_level, "<h3>x</h3>") == 3 and one(text.heading_level, "<p>") == 6
    assert [tuple(x) for x in one(text.mentions, "Table 2, Figs. 3 and fig. 3; Listing 9")] == [("figure", 3), ("table", 2), ("algorithm", 9)]
    assert tuple(one(text.caption_key, "Tab. 7: what")) == ("table", 7) and one(text.caption_key, "no") is None
    assert one(text.date_year, "2021-03-04") == 2021 and one(text.date_year, "n.d.") is None
    assert one(text.item_type, "preprint") == "preprint" and one(text.item_type, "odd") == "document"
    assert one(text.has_leader_dots, "Intro . . . . . 12") and not one(text.has_leader_dots, "Intro 12")
    m = spark.sql("select map('b', array(1), 'a', array(0, 2)) m").select(text.inverted_index_text(F.col("m")).alias("x")).head()["x"]
    assert m == "a b a"


LONG = "hysics is a hot topic in computer animation and has been for many years"


@pytest.mark.parametrize(("raw", "want"), [
    ("P^{" + LONG + "}", "P" + LONG), (" W_{" + LONG + "} ", "W" + LONG), ("P^{short}", None), ("p^{" + LONG + "}", None), ("P{" + LONG + "}", None), ("P^{" + LONG.replace("hot", r"\\hot") + "}", None),
    ("P^{" + "1 2 3 + 4 5 6 = 7 8 9 " * 4 + "}", None), ("B^{" + "eforeweLookAtSimulatingthePhysicsOfparticlesinAnimation" + "}", "Beforewe Look At Simulatingthe Physics Ofparticlesin Animation"), ("B^{" + "x+1" * 20 + "}", None), ("", None), (None, None),
])
def test_drop_caps(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(repair.drop_cap(F.col("t"))).head()[0] == want


def test_quotation_marks_and_whole_blocks(spark):
    one = lambda f, *v: spark.range(1).select(f(*[F.lit(x) for x in v]).alias("x")).head()["x"]
    wrong = "\u00e2\u0141"
    assert one(repair.without_mojibake, f"it{wrong}\u2122s {wrong}\u201cso{wrong}\u201d Euler\u0141s \u0141\u00f3d\u017a a\u0141 1\u01412 Ã©") == "it\u2019s \u201cso\u201d Euler\u2019s \u0141\u00f3d\u017a a\u0141 1\u20192 Ã©"
    assert one(repair.clean_block, "P^{" + LONG + " of fifind}") == "P" + LONG + " of find"
    assert one(repair.clean_block, "x^{2} of fifind\n\nx^{2} of fifind\n\nend a_1.indd 9 1/2/03 1:10 AM") == "x^{2} of find\n\nend "
    assert one(repair.clean_block, "ffiffi") == "ffiffi" and one(repair.clean_block, "ffiffi fifi") == "ffi fi"


def test_tables():
    html = "<table><tr><th colspan='2'>A</th><th>B</th></tr><tr><td rowspan=2>x</td><td>1</td><td>2</td></tr><tr><td>3</td><td>p|q &amp; r</td></tr></table>"
    assert tables.markdown(html) == "| A | A | B |\n| --- | --- | --- |\n| x | 1 | 2 |\n| x | 3 | p\\|q & r |"
    assert tables.markdown("") == tables.markdown(None) == tables.markdown("no table") == ""


def test_code(spark):
    one = lambda f, v: spark.range(1).select(f(F.lit(v)).alias("x")).head()["x"]
    assert one(code.looks_like_code, "int f(int a) {\n  return a[0] == 2;\n}") and not one(code.looks_like_code, "A sentence about functions and classes, no more.")
    assert one(code.looks_like_pseudocode, "1. for each x do\n2. if y then\n3. return z\nend for")
    assert code.list_items("1. a\n2) b") == ("numbered", ["a", "b"]) and code.list_items("- a\n• b") == ("bulleted", ["a", "b"]) and code.list_items("2. a\n3. b") is None
    assert one(code.footnote_marker, "[3] note") == "[3]" and one(code.footnote_marker, "word") is None


# ---- the filter language ----


@pytest.fixture(scope="module")
def works(spark):
    rows = [{"id": "W1", "year": 1999, "oa": True, "authors": [{"a": {"id": "A1", "n": None}}, {"a": {"id": "A2", "n": "x"}}]}, {"id": "W2", "year": 2005, "oa": False, "authors": []}, {"id": "W3", "year": None, "oa": None, "authors": None}]
    return spark.createDataFrame(rows, "id string, year int, oa boolean, authors array<struct<a:struct<id:string,n:string>>>")


@pytest.mark.parametrize(
    ("given", "want"),
    [("", "123"), ("year:1999", "1"), ("year:>2000", "2"), ("year:<2000", "1"), ("year:1990-2010", "12"), ("year:2000-", "2"), ("year:1999|2005", "12"), ("!year:1999", "23"), ("year:!1999|2005", "3"), ("authors.a.id:A2", "1"), ("!authors.a.id:A2", "23"), ("oa:true", "1"), ("oa:false,year:>1", "2"), ("authors.a.n:x,authors.a.id:A1", "1")],
)
def test_filters(works, given, want):
    assert sorted(r.id for r in dsl.filtered(works, given).collect()) == [f"W{c}" for c in want]


@pytest.mark.parametrize("given", ["year", "year:", "none:1", "authors.b:1", "year:x", "id:" + "|".join("abcdefghij" * 6)])
def test_bad_filters(works, given):
    with pytest.raises(dsl.FilterError):
        dsl.filtered(works, given).collect()


def test_aliases():
    resolve = lambda kind, name: f"{kind}/{name.lower()}"
    assert catalog.alias_filter("works", {"year": "2020", "author": "Ada|Bo", "open": True}, "doi:x", resolve) == "authorships.author.id:authors/ada|authors/bo,publication_year:2020,is_oa:true,doi:x"
    assert catalog.alias_filter("works", {"open": False, "year": None}) == ""
    with pytest.raises(dsl.FilterError):
        catalog.alias_filter("works", {"year": "2020"}, "!publication_year:1999")
    with pytest.raises(dsl.FilterError):
        catalog.alias_filter("domains", {"year": "2020"})


def test_pages_and_scopes(works):
    with pytest.raises(dsl.FilterError):
        dsl.page(works, "id", "id", 101, 100)
    with pytest.raises(ValueError):
        filters.scope(None, 1, None)
    with pytest.raises(ValueError):
        filters.scope("p", None, 1)
    assert filters.matching(works, filters.articles([])).count() == 3


# ---- folds ----


def words(n, tag="w"):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_chunk_fold():
    rows = ingest.fold_document("p", [
        ("SectionHeader", "<h1>Paper</h1>", 1), ("SectionHeader", "<h2>Intro</h2>", 1), ("Text", f"<p>{words(100)}</p>", 1), ("Text", f"<p>{words(100, 'x')}</p>", 2), ("PageHeader", "<p>skip</p>", 2),
        ("Text", f"<p>One. Two. Three {words(200, 'y')}</p>", 3), ("SectionHeader", "<h3>Sub</h3>", 3), ("Text", "<p>tiny</p>", 4), ("Figure", "<img>", 4), ("Caption", "<p>Figure 1: F</p>", 4), ("Picture", "<img>", 4),
        ("SectionHeader", "<h5>Algorithm 2 Sort</h5>", 5), ("Text", "<p>for all do</p>", 5), ("SectionHeader", "<h2>References</h2>", 6), ("Text", "<p>[1] gone</p>", 6), ("Table", "<table>", 6),
    ])
    chunks = [r for r in rows if r[1] == "chunk"]
    assert [(r[2], r[3], r[4], r[8], r[9]) for r in chunks] == [(1, 0, 0, 1, 2), (1, 0, 1, 3, 3), (1, 1, 0, 4, 4)]
    assert chunks[2][7] == "tiny" and chunks[0][10] == 260
    assert [(r[1], r[4], r[7]) for r in rows if r[1] != "chunk"] == [("figure", 1, "Figure 1: F"), ("algorithm", 2, "Algorithm 2 Sort\nfor all do"), ("table", 3, "")]


def test_fold_invariants():
    rnd = random.Random(1)
    for _ in range(30):
        blocks_ = [("SectionHeader", f"<h{rnd.randint(2, 4)}>T</h2>", k) if rnd.random() < 0.2 else ("Text", " ".join(rnd.choices(["word", "end.", "more"], k=rnd.randint(1, 200))), k) for k in range(60)]
        rows = [r for r in ingest.fold_document("p", blocks_) if r[1] == "chunk"]
        by = {}
        for r in rows:
            by.setdefault((r[2], r[3]), []).append(r[4])
            assert r[10] <= 600
        assert all(v == list(range(len(v))) for v in by.values())


def test_overlap():
    assert ingest.overlap_tail("A one. B two. C three. tail") == "B two. C three. tail"
    assert ingest.overlap_tail("Only one. end") == "" and ingest.overlap_tail("É é. Ü ü.") == "É é. Ü ü."


def test_reading_order():
    columns = [("a", 0, 0, 40, 50), ("b", 0, 60, 40, 100), ("c", 60, 0, 100, 50), ("d", 60, 60, 100, 100)]
    assert layout.xy_cut(random.Random(2).sample(columns, 4)) == ["a", "b", "c", "d"]
    assert layout.xy_cut([("t", 0, 0, 100, 10), *[(i, x, y + 30, x2, y2 + 30) for i, x, y, x2, y2 in columns]]) == ["t", "a", "b", "c", "d"]
    assert layout.xy_cut([]) == [] and layout.lines([(0, 10, 5, "b"), (1, 9, 0, "a"), (30, 40, 0, "c")]) == ["ab", "c"]


def test_captions_are_one_to_one():
    figure = lambda i, y: {"id": i, "x1": 0, "x2": 100, "y1": y, "y2": y + 50}
    caption = lambda i, y: {"id": i, "x1": 10, "x2": 90, "y1": y, "y2": y + 10}
    assert layout.match_captions([caption("c1", 55), caption("c2", 125)], [figure("f1", 0), figure("f2", 70)], 40) == {"c1": "f1", "c2": "f2"}
    assert layout.match_captions([caption("c", 300)], [figure("f", 0)], 40) == {}


def test_contents():
    got = toc.parse(["Contents", "Preface .......... ix", "Part I Basics", "1 Start of", "Chapter 1 Roads .... 1", "1.1 Small roads . . . . . 3", "Appendix A  77", "Index 99"])
    assert got == [(1, "Preface", "ix", -9, "front"), (0, "Part I Basics", None, None, "part"), (1, "Chapter 1 Roads", "1", 1, "chapter"), (2, "1.1 Small roads", "3", 3, "section"), (1, "Appendix A", "77", 77, "appendix"), (1, "Index", "99", 99, "back")]
    assert toc.parse(["One ... 1", "Two ... 2"]) == []


def test_page_ranges(spark):
    assert blocks.page_range("5,1-3, 2") == [1, 2, 3, 5]
    for bad in ("0", "3-2"):
        with pytest.raises(ValueError):
            blocks.page_range(bad)
    df = spark.createDataFrame([("5,1-3, 2",), ("3-2",), ("x",)], "s string")
    assert [r.p for r in df.select(blocks.page_range_column(F.col("s")).alias("p")).collect()] == [[1, 2, 3, 5], None, None]


# ---- sources and stores ----


def test_sources(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/doc.json").write_text(json.dumps({"children": [{"block_type": "Page", "children": [{"block_type": "Text", "id": "t", "page": 1, "html": "<p>x</p>", "section_hierarchy": {"1": "a"}}, {"block_type": "Figure", "id": "f", "html": ""}]}]}, indent=1))
    assert [(r.page_no, r.block_no, r.block_type, r.page) for r in blocks.read_blocks(spark, str(tmp_path / "b")).collect()] == [(0, 0, "Text", 1), (0, 1, "Figure", None)]
    (tmp_path / "r").mkdir()
    (tmp_path / "r/doc.json").write_text(json.dumps({"title": "T", "children": [{"type": "heading", "depth": 1, "text": "H", "children": [{"type": "text", "content": "c"}]}]}))
    assert [(r.seq, r.parent_seq, r.type, r.depth, r.text) for r in blocks.read_reflow(spark, str(tmp_path / "r")).orderBy("seq").collect()] == [(0, None, "document", None, None), (1, 0, "heading", 1, "H"), (2, 1, "text", None, "c")]


def chunk_rows(spark, articles):
    return spark.createDataFrame([(f"{p}/{k}", p, [0.0], "c", 0, "s", 0, k, "paragraph", "text", t, None, None, "T", ["A"], 2000, None, ["x"], []) for p, t in articles for k in range(2)], schemas.CHUNKS)


@pytest.mark.parametrize("buckets", [0, 4, 256])
def test_store(spark, tmp_path, buckets):
    held = Store(spark, str(tmp_path / "index"), buckets)
    assert held.table("chunks").count() == 0 and held.table("exhibits").schema == schemas.EXHIBITS
    held.upsert("chunks", chunk_rows(spark, [("10.1/a:b", "one"), ("q", "two")]))
    held.upsert("chunks", chunk_rows(spark, [("q", "three")]))
    assert sorted((r.paper_id, r.text) for r in held.table("chunks").collect()) == [("10.1/a:b", "one")] * 2 + [("q", "three")] * 2
    new = spark.createDataFrame([("q",), ("z",)], "paper_id string")
    assert [r.paper_id for r in held.to_ingest(new).collect()] == ["z"]
    held.remove(["10.1/a:b"])
    assert {r.paper_id for r in held.table("chunks").collect()} == {"q"}
    assert held.table("chunks").columns == [f.name for f in schemas.CHUNKS.fields]


def test_a_table_that_cannot_be_read_is_an_error(spark, tmp_path):
    held = Store(spark, str(tmp_path / "index"))
    held.upsert("chunks", chunk_rows(spark, [("a", "1")]))
    for f in (tmp_path / "index/chunks").rglob("*.parquet"):
        f.write_bytes(b"not a table")
    with pytest.raises(Exception, match="(?i)parquet|footer|magic"):
        held.upsert("chunks", chunk_rows(spark, [("b", "2")]))


def test_migrations(spark):
    old = chunk_rows(spark, [("p", "t")]).drop("block_type")
    assert {r.block_type for r in schemas.migrated(old, "chunks", 0).collect()} == {"text"}
    assert "block_type" not in schemas.migrated(old, "chunks", schemas.VERSION).columns
    rows = spark.createDataFrame([(None, None), ("a", ["x", None])], "s string, l array<string>")
    assert [tuple(r) for r in schemas.without_nulls(rows).collect()] == [("", []), ("a", ["x"])]


def test_selection_merge_and_remove(spark):
    schema = "entry int, item_key string, entity_id string, doi string, title string"
    a = spark.createDataFrame([(1, "K1", None, "10.1/A", "One")], schema)
    b = spark.createDataFrame([(2, None, None, "https://doi.org/10.1/a", "dup by doi"), (3, "K2", "W2", None, "Two"), (4, None, "W2", None, "dup in source"), (5, None, None, None, "no keys"), (6, None, None, None, "no keys either")], schema)
    assert sorted(r.entry for r in selection.merged(a, b, "entry").collect()) == [1, 3, 5, 6]
    assert sorted(r.entry for r in selection.removed(a.union(b), "KEYS").collect()) == [1, 2, 3, 4]
    assert sorted(r.entry for r in selection.removed(a.union(b), "doi:10.1/a").collect()) == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        selection.checked_name("a b")


def test_annotations(spark):
    rows = [("W", None, "book", None), ("P", "W", "attachment", "application/pdf"), ("N", "P", "annotation", None), ("I", "W", "attachment", "image/png"), ("M", "I", "annotation", None)]
    items = spark.createDataFrame(rows, "item_key string, parent_key string, item_type string, content_type string")
    assert [tuple(r) for r in library.annotations_of(items).select("work_key", "attachment_key", "annotation_key").collect()] == [("W", "P", "N")]


def test_running_headers_count_occurrences(spark):
    rows = [("d", p, "The Head", 5.0, 9.0, 10.0, 20.0, 100.0, 100.0) for p in (1, 2)] + [("d", p, f"body {p} text", 40.0, 50.0, 10.0, 20.0, 100.0, 100.0) for p in (1, 2)]
    regions = spark.createDataFrame(rows, "doc string, page int, text string, y1 double, y2 double, x1 double, x2 double, height double, width double")
    assert [(r.key, r.times) for r in crosspage.running_headers(regions).collect()] == [("the head", 4)]


def test_margin_stamps_keep_the_shortest_opening(spark):
    rows = [("d", p, t, 1.0, 2.0, 40.0, 60.0, 100.0, 100.0) for p in (1, 2, 3) for t in ("Journal of things", f"Journal of things vol {'x' * 3}", "ab cd", "ab cd efghij")]
    regions = spark.createDataFrame(rows, "doc string, page int, text string, y1 double, y2 double, x1 double, x2 double, height double, width double")
    assert sorted(r.key for r in crosspage.margin_stamps(regions).collect()) == ["ab cd efghij", "journal of things"]


# ---- streams ----


def test_streams_give_what_tables_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    for build, mode in ((incremental.windowed, "complete"), (incremental.first_deliveries, "append")):
        name = f"out_{build.__name__}"
        run = build(incremental.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode(mode).format("memory").queryName(name).start()
        run.processAllAvailable()
        run.stop()
        assert sorted(map(str, spark.table(name).collect())) == sorted(map(str, build(events).collect()))


def test_upsert_stream_is_idempotent(spark, tmp_path):
    chunk_rows(spark, [("a", "1"), ("b", "2")]).write.parquet(str(tmp_path / "in"))
    held = Store(spark, str(tmp_path / "index"))
    for k in range(2):
        stream = spark.readStream.schema(schemas.CHUNKS).parquet(str(tmp_path / "in"))
        run = incremental.upsert_stream(stream, held, "chunks", str(tmp_path / f"checkpoint{k}")).start()
        run.processAllAvailable()
        run.stop()
    assert held.table("chunks").count() == 4


def nodes(*rows):
    return [{"kind": k, "depth": d, "text": t} for k, d, t in rows]


def test_reflow_passes():
    got = reflow.without_echoes(nodes(("heading", 1, "Big Results"), ("text", None, "Big results. Then the text."), ("text", None, "Other")))
    assert [n["text"] for n in got] == ["Big Results", "Then the text.", "Other"]
    assert len(reflow.without_echoes(nodes(("heading", 1, "Big Results"), ("text", None, "BIG RESULTS")))) == 1
    got = reflow.without_repeats(nodes(("text", None, "a b c d e"), ("formula", None, "x"), ("text", None, "a b c d e f"), ("text", None, "quite other words stand here")))
    assert [n["text"] for n in got] == ["a b c d e f", "x", "quite other words stand here"]
    got = reflow.split_notes(nodes(("text", None, "A sentence long enough here.1The note says so much"), ("footnote", None, "1 again"), ("footnote", None, "* star")))
    assert [(n["kind"], n.get("number"), n["text"]) for n in got] == [("text", None, "A sentence long enough here."), ("footnote", "1", "The note says so much"), ("footnote", "*", "star")]
    got = reflow.with_lists_and_code(nodes(("text", None, "1. a\n2. b"), ("text", None, "int f(int a) {\n  return a[0] == 2;\n}"), ("text", None, "x = g(1);\n  y[2] != z(3);\n")))
    assert [n["kind"] for n in got] == ["list", "code"]
    assert [n["text"] for n in reflow.rejoined(nodes(("text", None, "cut wo-"), ("text", None, "rd here"), ("text", None, "and on."), ("text", None, "next")))] == ["cut word here and on.", "next"]
    got = reflow.numbered(nodes(("heading", 1, "A"), ("heading", 2, "B"), ("heading", 2, "C"), ("heading", 1, "D"), ("heading", 2, "E")))
    assert [n["number"] for n in got] == ["1", "1.1", "1.2", "2", "2.1"]
    got = reflow.numbered(nodes(("heading", 1, "3 A"), ("heading", 2, "B")))
    assert [(n["number"], n["text"]) for n in got] == [("3", "A"), ("3.1", "B")]
    assert reflow.markdown(got + nodes(("list", None, "- a\n- b"), ("code", None, "x"))) == "# 3 A\n\n## 3.1 B\n\n- a\n- b\n\n```\nx\n```"


def test_embedding_cache(spark, tmp_path):
    held = EmbeddingCache(spark, str(tmp_path / "e"))
    assert held.table().count() == 0
    rows = spark.createDataFrame([("m", "K/1", k, [float(k), 1.0]) for k in range(3)], "model string, item_key string, row int, vector array<float>")
    held.save(rows, 2)
    assert [r.vector[0] for r in held.load("m", "K/1").collect()] == [0.0, 1.0, 2.0] and held.load("m", "K/1", 2).count() == 1
    assert held.is_fresh("m", "K/1", 3) and not held.is_fresh("m", "K/1", 4) and held.pairs().count() == 1
    with pytest.raises(FileExistsError):
        held.save(rows, 2)
    with pytest.raises(ValueError):
        held.save(rows, 3)
    held.save(rows.where("row = 0"), 2, replace=True)
    assert held.load("m", "K/1").count() == 1


def test_duplicate_regions():
    box = lambda i, kind, x: {"id": i, "kind": kind, "x1": x, "x2": x + 10, "y1": 0, "y2": 10}
    assert layout.kept_of_duplicates([box("a", "Text", 0), box("b", "Table", 2), box("c", "Text", 3), box("d", "Text", 40)]) == ["b", "d"]


def test_tree_fold():
    long = words(455)
    rows = ingest.fold_tree("p", [
        {"type": "heading", "depth": 1, "text": "Intro", "section": "1"}, {"type": "text", "text": long}, {"type": "footnote", "text": "note", "marker": "a"}, {"type": "formula", "text": ""}, {"type": "heading", "depth": 3, "text": "Deep"},
        {"type": "list", "items": ["x", "y"], "list_type": "numbered"}, {"type": "code_block", "text": "f()", "language": "py"}, {"type": "figure", "caption": "Figure 1: c"}, {"type": "heading", "depth": 2, "text": "Sub", "section": "1.1"}, {"type": "text", "text": "tiny"},
        {"type": "heading", "depth": 1, "text": "References"}, {"type": "text", "text": "gone"},
    ])
    chunks = [r for r in rows if r[1] == "chunk"]
    assert [(r[2], r[3], r[4], r[5], r[6]) for r in chunks] == [(1, 0, 0, "1 Intro", ""), (1, 0, 1, "1 Intro", ""), (1, 1, 0, "1 Intro", "1.1 Sub")]
    assert chunks[0][7].endswith("[a] note\n\n[display formula]") and chunks[1][7] == "**Deep**\n\n1. x\n2. y\n\n```py\nf()\n```"
    assert [(r[1], r[7]) for r in rows if r[1] != "chunk"] == [("figure", "Figure 1: c")]


def test_selections_on_disk(spark, tmp_path):
    held = Selections(spark, f"file://{tmp_path}/s")
    assert held.names() == [] and held.active() is None
    held.create("first", spark.createDataFrame([(1, "K1")], "entry long, item_key string"))
    held.create("Zweite_2")
    held.activate("1")
    assert held.names() == ["Zweite_2", "first"] and held.active() == "Zweite_2" and held.resolve("FIRST") == "first"
    assert [r.item_key for r in held.read("first").collect()] == ["K1"]
    held.rename("zweite_2", "third")
    assert held.active() == "third"
    held.delete("third")
    assert held.names() == ["first"] and held.active() is None
    with pytest.raises(FileExistsError):
        held.create("first")
    with pytest.raises(KeyError):
        held.read("none")
    with pytest.raises(ValueError):
        held.create("../x")


def test_formulas():
    assert formula.looks_like_formula("x = y + ∑ z_i") and not formula.looks_like_formula("A line of plain prose = so") and not formula.looks_like_formula("x=")
    assert formula.split_tag("a = b + c (3.1)") == ("a = b + c", "3.1") and formula.split_tag("see page (3)") == ("see page (3)", None)
    assert formula.table_of_tokens(["ched", "lcel", "nl", "fcel", "ecel", "nl", "ucel", "fcel", "nl"], ["H", "a", "b"]) == '<table><tr><th colspan="2">H</th></tr><tr><td rowspan="2">a</td><td></td></tr><tr><td>b</td></tr></table>'


def test_lines_to_blocks():
    line = lambda y, t, x=0, size=10: {"x1": x, "x2": x + 100, "y1": y, "y2": y + 10, "size": size, "text": t}
    got = page_lines.line_blocks([line(0, "Heading here", size=16), line(14, "first line"), line(26, "second line"), line(38, "x = y + ∑ z_i"), line(50, "more prose text"), line(90, "far below here")])
    assert [[x["text"] for x in b] for b in got] == [["Heading here"], ["first line", "second line"], ["x = y + ∑ z_i"], ["more prose text"], ["far below here"]]
    wide = {**line(0, "title"), "x2": 300}
    assert [[x["text"] for x in c] for c in page_lines.columns([wide, line(20, "l"), line(20, "r", 200)], 320, 150)] == [["title"], ["l"], ["r"]]


def test_numbers_in_order_and_assembly():
    head = lambda n, t: {"kind": "heading", "depth": n.count(".") + 1, "number": n, "text": t}
    text = lambda t: {"kind": "text", "depth": None, "text": t}
    got = reflow.in_number_order([text("start"), head("1", "A"), head("1.2", "C"), text("c"), head("1.1", "B"), text("b"), head("2.1", "E"), head("2", "D")])
    assert [n["text"] for n in got] == ["start", "A", "B", "b", "C", "c", "D", "E"]
    assert reflow.assembled(["A hyphen-", "ated word, state-", "Of ", "", " the art"]) == "A hyphenated word, state-Of the art"
    assert reflow.without_stamps("Body\nJournal of X 12\nmore", {"journal of x"}) == "Body\nmore"


def test_buckets_recall(spark):
    import numpy as np

    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    at = ann.centres(df, 8)
    held = ann.bucketed(df, at).persist()
    hits = total = 0
    for r in df.where("chunk_id % 50 = 0").collect():
        exact = {x.chunk_id for x in vector.nearest(df, list(r.vector), 5, "chunk_id").collect()}
        got = {x.chunk_id for x in ann.probe(held, at, list(r.vector), 5, "chunk_id", probes=4).collect()}
        hits, total = hits + len(exact & got), total + len(exact)
    assert hits / total >= 0.9
    assert ann.centres(df.limit(10), 8) is None and np.isfinite(at).all()


def test_contents_listing(spark):
    rows = spark.createDataFrame([("d", 0, 1, "One", "1"), ("d", 1, 2, "Two", None)], "doc string, seq int, depth int, title string, page_label string")
    assert toc.rendered(rows).head()["markdown"] == "- One (1)\n  - Two"


def test_heading_levels_with_rare_and_short_fonts(spark):
    """A rare font taller than all common ones has a level; rarer shorter ones don't; candidates shorter than the body come last."""
    fonts = [("d", "Body", 20, 9000, 100, 40, 10.0), ("d", "Part", 60, 40, 3, 3, 30.0), ("d", "Chap", 40, 300, 20, 9, 20.0), ("d", "Rare", 30, 50, 3, 3, 15.0), ("d", "Few", 44, 9, 9, 9, 22.0), ("d", "Run", 18, 80, 30, 12, 9.0), ("d", "Note", 16, 200, 30, 12, 8.0)]
    table = spark.createDataFrame(fonts, "doc string, family string, bucket int, chars long, segments long, pages long, height double")
    pages = spark.createDataFrame([("d", 40)], "doc string, n_pages long")
    level = lambda rows: {r.family: r.level for r in rows.collect()}
    assert level(crosspage.heading_levels(table, pages)) == {"Part": 1, "Chap": 2}
    assert level(crosspage.heading_levels(table, pages, candidates=table.where("family <> 'Body'"))) == {"Part": 1, "Chap": 2, "Run": 3, "Note": 4}
    assert level(crosspage.heading_levels(table, spark.createDataFrame([("d", 60)], "doc string, n_pages long"))) == {"Chap": 1}
    with_math = table.withColumn("is_math", F.col("family") == "Body")
    assert crosspage.body_font(with_math).head().family == "Chap"


def test_fonts_numbers_and_matter(spark):
    one = lambda f, v: spark.range(1).select(f(F.lit(v)).alias("x")).head()["x"]
    assert [one(crosspage.holds_symbols, x) for x in ("cmmi10", "Times-Roman", "MathJax_Main", "AB+CMMI10", "", "Wingdings", "Outline")] == [True, False, True, False, False, True, False]
    rows = spark.createDataFrame([(t, 10) for t in ("1.2 Results", "A Proofs", "IV Ends", "B-2 More", "A1.3 x", "Results", "1.2", "a Proofs", "2 Contents", "Preface", "12 index ")] + [("Long one", 2000)], "title string, chars long")
    assert {r.title for r in crosspage.substantial_headings(rows).collect()} == {"1.2 Results", "A Proofs", "IV Ends", "B-2 More", "A1.3 x", "2 Contents", "Preface", "12 index ", "Long one"}


def test_titles_meant(spark):
    works = spark.createDataFrame([("W1", "Deep Nets", 5), ("W2", "On deep nets", 9), ("W3", "Other", 1)], "id string, display_name string, cited_by_count long")
    meant = lambda text: tuple(catalog.resolve_work(works, text).head())
    assert meant("deep nets")[:2] == ("found", "W1") and meant("other")[:2] == ("found", "W3") and meant("on deep")[:2] == ("found", "W2") and meant("zzz")[0] == "not found"
    assert meant("deep")[0] == "suggestions" and meant("deep")[2] == "On deep nets (9); Deep Nets (5)"
    with pytest.raises(ValueError):
        vector.found_by_meaning(works, [0.0], 0, "id")


def test_nested_headings_in_order(spark):
    """Parents, ends and contents against plain loops, over several documents and tasks."""
    rnd = random.Random(6)
    heads = [(f"d{d}", 2 * k, rnd.randint(1, 6), k) for d in range(9) for k in range(rnd.choice([1, 3, 60]))]
    segments = [(f"d{d}", rnd.randrange(130), rnd.randrange(50)) for d in range(9) for _ in range(120)]
    h, s = spark.createDataFrame(heads, "doc string, seq int, depth int, value int"), spark.createDataFrame(segments, "doc string, seq int, chars long")
    parent, ends, held = {}, {}, {}
    for doc, seq, depth, _ in heads:
        same = [x for x in heads if x[0] == doc]
        parent[doc, seq] = max((x[1] for x in same if x[1] < seq and x[2] < depth), default=None)
        ends[doc, seq] = min((x[1] for x in same if x[1] > seq and x[2] <= depth), default=None)
        inside = [c for d, q, c in segments if d == doc and q > seq and (ends[doc, seq] is None or q < ends[doc, seq])]
        if inside:
            held[doc, seq] = sum(inside)
    rows = ordered.nested(h).collect()
    assert {(r.doc, r.seq): r.parent_seq for r in rows} == parent and {(r.doc, r.seq): r.next_seq for r in rows} == ends and len(rows) == len(heads)
    assert {(r.doc, r.seq): r.chars for r in ordered.contents(h.select("doc", "seq", "depth"), s).collect()} == held


def test_boxes_meet_in_cells(spark):
    rnd = random.Random(7)
    rows = [("d", k % 3, f"{k:03}", x := rnd.uniform(-150, 500), y := rnd.uniform(0, 700), x + rnd.choice([0, 20, 300]), y + rnd.choice([5, 150])) for k in range(90)]
    want = {(a[2], b[2]) for a in rows for b in rows if a[1] == b[1] and a[2] < b[2] and min(a[5], b[5]) > max(a[3], b[3]) and min(a[6], b[6]) > max(a[4], b[4])}
    got = [(r.a_id, r.b_id) for r in layout.meeting_pairs(spark.createDataFrame(rows, "doc string, page int, id string, x1 double, y1 double, x2 double, y2 double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_selections_by_place(spark):
    names = spark.createDataFrame([("b",), ("A",), ("c",)], "name string")
    at = lambda asked: [tuple(r) for r in selection.by_place(names, asked).collect()]
    assert at("1") == [("A", 1)] and at("3") == [("c", 3)] and at("4") == at("0") == [] and at("B") == [("b", 2)] and at("zz") == []
