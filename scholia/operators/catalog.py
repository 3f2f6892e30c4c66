"""Catalog entities: alias filters, name resolution, completion, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import dsl

#: Aliases of each entity: name, path, and the entity of its values ("" as they are, "?" a flag).
ALIASES = {
    "works": [
        ("author", "authorships.author.id", "authors"),
        ("topic", "primary_topic.id", "topics"),
        ("domain", "primary_topic.domain.id", "domains"),
        ("field", "primary_topic.field.id", "fields"),
        ("subfield", "primary_topic.subfield.id", "subfields"),
        ("publisher", "primary_location.source.publisher_lineage", "publishers"),
        ("source", "primary_location.source.id", "sources"),
        ("institution", "authorships.institutions.lineage", "institutions"),
        ("year", "publication_year", ""),
        ("citations", "cited_by_count", ""),
        ("country", "authorships.institutions.country_code", ""),
        ("continent", "authorships.institutions.continent", ""),
        ("type", "type", ""),
        ("open", "is_oa", "?"),
    ],
    "authors": [
        ("institution", "last_known_institutions.id", "institutions"),
        ("country", "last_known_institutions.country_code", ""),
        ("continent", "last_known_institutions.continent", ""),
        ("citations", "cited_by_count", ""),
        ("works", "works_count", ""),
        ("h_index", "summary_stats.h_index", ""),
    ],
    "sources": [
        ("publisher", "host_organization_lineage", "publishers"),
        ("country", "country_code", ""),
        ("continent", "continent", ""),
        ("type", "type", ""),
        ("open", "is_oa", "?"),
        ("citations", "cited_by_count", ""),
        ("works", "works_count", ""),
    ],
    "institutions": [("country", "country_code", ""), ("continent", "continent", ""), ("type", "type", ""), ("citations", "cited_by_count", ""), ("works", "works_count", "")],
    "topics": [("domain", "domain.id", "domains"), ("field", "field.id", "fields"), ("subfield", "subfield.id", "subfields"), ("citations", "cited_by_count", ""), ("works", "works_count", "")],
    "publishers": [("country", "country_codes", ""), ("continent", "continent", ""), ("citations", "cited_by_count", ""), ("works", "works_count", "")],
    "funders": [("country", "country_code", ""), ("continent", "continent", ""), ("citations", "cited_by_count", ""), ("works", "works_count", "")],
    "domains": [("works", "works_count", "")],
    "fields": [("domain", "domain.id", "domains"), ("works", "works_count", "")],
    "subfields": [("domain", "domain.id", "domains"), ("field", "field.id", "fields"), ("works", "works_count", "")],
}


def alias_filter(entity: str, given: dict[str, object], raw: str = "", resolve=None) -> str:
    """One filter text from aliases, in the table's order, and a raw filter behind them.

    ``resolve(entity, name)`` turns a name into an id; values between bars are resolved one by one.  A
    flag counts only when true.  A raw condition on an alias's own path is an error.
    """
    known = {name: (path, kind) for name, path, kind in ALIASES[entity]}
    if unknown := set(given) - set(known):
        raise dsl.FilterError(f"no alias {sorted(unknown)} for {entity}")
    active = {known[n][0]: n for n, v in given.items() if v is not None and v is not False}
    for part in filter(None, raw.split(",")):
        path = part.split(":", 1)[0].strip().removeprefix("!")
        if path in active:
            raise dsl.FilterError(f"{path} is set by both the filter and {active[path]!r}")
    out = []
    for name, path, kind in ALIASES[entity]:
        value = given.get(name)
        if value is None or kind == "?" and value is not True:
            continue
        if kind == "?":
            value = "true"
        elif kind:
            value = "|".join(resolve(kind, v.strip()) if resolve else v.strip() for v in str(value).split("|"))
        out.append(f"{path}:{value}")
    return ",".join([*out, *([raw] if raw else [])])


def resolve_name(entities: DataFrame, text: str, ident: str, name: str, cited: str, exact: bool = False) -> DataFrame:
    """The one entity meant by a name: the most cited whose name holds it; ``exact``: whose name it is, whatever the case."""
    low = F.lower(name)
    hit = low == text.lower() if exact else F.contains(low, F.lit(text.lower()))
    return entities.where(hit).orderBy(F.desc_nulls_last(cited), ident).limit(1)


#: Fixed value: works by a title that are looked at.
MOST_CANDIDATES = 200


def resolve_work(works: DataFrame, text: str, ident: str = "id", name: str = "display_name", cited: str = "cited_by_count") -> DataFrame:
    """outcome, id, suggestions of a title: the work whose title it is, whatever the case; else the sole one whose title holds it; else all of these as suggestions.

    At most the 200 most cited works whose titles hold the text are looked at; no such work: not found.
    """
    hits = works.where(F.contains(F.lower(name), F.lit(text.lower()))).orderBy(F.desc_nulls_last(cited), ident).limit(MOST_CANDIDATES)
    one = F.struct(F.coalesce(-F.col(cited), F.lit(0)).alias("rank"), F.col(ident).alias("id"), F.col(name).alias("name"), F.coalesce(cited, F.lit(0)).alias("cited"), (F.lower(name) == text.lower()).alias("exact"))
    rows = hits.agg(F.array_sort(F.collect_list(one)).alias("c"))
    exact = F.get(F.filter("c", lambda x: x["exact"]), F.lit(0))
    found = F.coalesce(exact["id"], F.when(F.size("c") == 1, F.get("c", F.lit(0))["id"]))
    outcome = F.when(F.size("c") == 0, "not found").when(found.isNotNull(), "found").otherwise("suggestions")
    names = F.when(outcome == "suggestions", F.transform("c", lambda x: F.concat(x["name"], F.lit(" ("), x["cited"].cast("string"), F.lit(")"))))
    return rows.select(outcome.alias("outcome"), found.alias("id"), F.array_join(names, "; ").alias("suggestions"))


def autocomplete(entities: DataFrame, text: str, ident: str, name: str, cited: str, limit: int = 10) -> DataFrame:
    """Entities whose names begin with the text, most cited first."""
    return entities.where(F.lower(name).startswith(text.lower())).orderBy(F.desc_nulls_last(cited), ident).limit(limit)


def best_per_group(entities: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each group; Spark prunes before the shuffle."""
    w = Window.partitionBy(group).orderBy(*order)
    return entities.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def work_summary(works: DataFrame) -> DataFrame:
    """Flat summaries of nested works: author names in order, journal, open access, topic."""
    names = F.array_compact(F.transform("authorships", lambda a: a["author"]["display_name"]))
    return works.select(
        "id", F.col("display_name").alias("title"), "doi", "publication_year", "type", F.array_join(F.coalesce(names, F.array().cast("array<string>")), "; ").alias("authors"),
        F.col("primary_location.source.display_name").alias("journal"), F.col("open_access.is_oa").alias("is_oa"), F.col("open_access.oa_url").alias("oa_url"), "cited_by_count", F.col("primary_topic.display_name").alias("primary_topic"),
    )


def entity_summary(entities: DataFrame, name: str = "display_name", topics: str = "topics") -> DataFrame:
    """id, name, counts, h-index out of the summary statistics, the first three topics."""
    return entities.select("id", F.col(name).alias("name"), "works_count", "cited_by_count", F.col("summary_stats.h_index").alias("h_index"), F.array_join(F.transform(F.slice(F.coalesce(topics, F.array().cast(entities.schema[topics].dataType)), 1, 3), lambda t: t["display_name"]), "; ").alias("top_topics"))
