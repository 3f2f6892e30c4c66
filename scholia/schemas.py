"""Schemas of the index tables, their version, and migrations from older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION, VERSION_KEY = 2, "schema_version"
_S, _I, _A, _V = T.StringType(), T.IntegerType(), T.ArrayType(T.StringType()), T.ArrayType(T.FloatType())


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, k, null) for n, k, null in fields])


CHUNKS = _struct(
    ("chunk_id", _S, False), ("paper_id", _S, False), ("vector", _V, False), ("chapter_title", _S, False), ("chapter_idx", _I, False), ("section_title", _S, False), ("section_idx", _I, False),
    ("chunk_idx", _I, False), ("depth", _S, False), ("block_type", _S, False), ("text", _S, False), ("page_start", _I, True), ("page_end", _I, True), ("title", _S, False), ("authors", _A, False),
    ("year", _I, True), ("venue", _S, True), ("tags", _A, False), ("exhibit_ids", _A, False),
)
EXHIBITS = _struct(
    ("exhibit_id", _S, False), ("paper_id", _S, False), ("vector", _V, False), ("exhibit_type", _S, False), ("caption", _S, False), ("description", _S, True), ("image_path", _S, True), ("content", _S, True),
    ("page", _I, True), ("chapter_idx", _I, False), ("section_idx", _I, False), ("title", _S, False), ("authors", _A, True), ("year", _I, True), ("venue", _S, True), ("tags", _A, True),
    ("first_ref_chunk_id", _S, True), ("ref_count", _I, False),
)
#: Columns that later versions added: version, table, column, SQL for rows written before.
MIGRATIONS = [(1, "chunks", "block_type", "'text'"), (2, "exhibits", "content", "cast(null as string)")]


def migrated(df: DataFrame, table: str, stored: int) -> DataFrame:
    """``df`` of an older version with the columns that came since, in the current order.  A current table is not repaired."""
    if stored >= VERSION:
        return df
    for version, of, column, default in MIGRATIONS:
        if of == table and stored < version and column not in df.columns:
            df = df.withColumn(column, F.expr(default))
    order = [f.name for f in (CHUNKS if table == "chunks" else EXHIBITS).fields]
    return df.select(*[c for c in order if c in df.columns], *[c for c in df.columns if c not in order])


def without_nulls(df: DataFrame) -> DataFrame:
    """Null strings as empty ones, null lists as empty lists, null items of lists dropped."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = F.coalesce(c, F.lit("")).alias(f.name)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_compact(F.coalesce(c, F.array().cast("array<string>"))).alias(f.name)
        out.append(c)
    return df.select(*out)
