"""Scans: directories, CSV with codes, JSON, optional and loosely named tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def by_file_name(spark: SparkSession, path: str, schema: T.StructType | str, out: str = "country", suffix: str = "parquet") -> DataFrame:
    """Parquet files named after a key, in one scan; Spark skips names that begin with a dot, and empty files have no rows."""
    name = F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*)\.{suffix}$", 1)
    return spark.read.schema(schema).parquet(path).withColumn(out, F.url_decode(name))


def coded_csv(spark: SparkSession, path: str, schema: T.StructType | str, codes: DataFrame, code: str) -> DataFrame:
    """CSV rows whose code is known, with the codes' other columns."""
    return spark.read.schema(schema).option("header", True).csv(path).join(codes, code)


def harmonised(parts: Sequence[DataFrame]) -> DataFrame:
    """Union in order with ``src_priority``; a column whose types differ becomes a string; missing ones are null."""
    kinds: dict[str, set] = {}
    for p in parts:
        for f in p.schema:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = {c for c, k in kinds.items() if len(k) > 1}
    out = None
    for i, p in enumerate(parts):
        own = p.select(*[F.col(c).cast("string").alias(c) if c in mixed else F.col(c) for c in p.columns], F.lit(i).alias("src_priority"))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def empty_like(df: DataFrame) -> DataFrame:
    """No rows, the same columns: the stand-in for a missing source."""
    return df.where(F.lit(False))


def windowed(df: DataFrame, first: str, last: str, columns: Sequence[str], day: str = "day") -> DataFrame:
    """Rows of a date window, pruned to some columns; both reach the scan."""
    return df.where(F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))).select(*columns)


def non_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: the window holds no rows")
    return df


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """JSON files that each hold a list of objects, or an object per line."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).json(path)


def embedded_json(pages: DataFrame, html: str, blocks: Mapping[str, str], required: bool = True) -> DataFrame:
    """JSON script blocks of pages: blocks[id] = schema.  With ``required`` pages lacking any block raise when they are read."""
    out = []
    for name, schema in blocks.items():
        body = F.regexp_extract(html, rf'(?s)<script[^>]*\bid="{name}"[^>]*>(.*?)</script>', 1)
        found = F.from_json(F.nullif(F.trim(body), F.lit("")), schema)
        out.append((F.when(found.isNull(), F.raise_error(F.lit(f"block {name} is missing"))).otherwise(found) if required else found).alias(name))
    return pages.select("*", *out)


def optional(spark: SparkSession, name: str, fallback: DataFrame) -> DataFrame:
    """A catalog table, or another plan where there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else fallback


def resolved(df: DataFrame, fields: Mapping[str, tuple[Sequence[str], object]]) -> DataFrame:
    """fields[out] = (candidate columns, default): the first candidate present, in any case, else the default; no default is an error."""
    there = {c.lower(): c for c in df.columns}
    out = []
    for name, (candidates, default) in fields.items():
        hit = next((there[c.lower()] for c in candidates if c.lower() in there), None)
        if hit is None and default is ...:
            raise ValueError(f"none of {list(candidates)} for {name}")
        out.append((F.col(hit) if hit else F.lit(default)).alias(name))
    return df.select(*out)
