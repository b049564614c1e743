"""The full snapshot: every domain as documents of bounded size, one per key, from one description of the domains.

A domain is a table; its description says what keys it, which rows of a key are the newest and how many of them a document may hold. Documents
are built alike for all domains and read back with the schema that the description implies, so a new domain is one entry.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.guards import finite_or_null

#: Rows of a key that a document holds unless its domain says otherwise.
MOST = 50


class Domain(NamedTuple):
    """``key`` names the document, ``newest`` the columns by which its rows are ranked, the greatest first; ties must not occur in them."""

    key: str
    newest: Sequence[str] = ()
    most: int = MOST


def _clean(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    return (finite_or_null(c) if field.dataType.typeName() == "double" else c).alias(field.name)


def blocks(rows: DataFrame, name: str, domain: Domain) -> DataFrame:
    """(domain, key, document): ``{"n": rows of the key, "rows": [the newest, newest first]}``; a null key is the key ``null``.

    Ranks with a literal bound let the group limit act before the shuffle, so a key with very many rows sends few of them to one task. The
    count covers all rows. NaN and infinities are null, and nulls stay visible.
    """
    key = F.coalesce(F.col(domain.key).cast("string"), F.lit("null"))
    own = rows.select(key.alias("_key"), F.struct(*[_clean(f) for f in rows.schema.fields]).alias("_row"), *[F.col(c).alias(f"_by_{c}") for c in domain.newest])
    by = [F.desc(f"_by_{c}") for c in domain.newest] or [F.desc("_key")]
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy(*by))).where(F.col("_rank") <= domain.most)
    newest = ranked.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_rank", "_row"))).alias("_rows"))  # at most `most`
    counted = own.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).join(newest, "_key")
    body = F.to_json(F.struct("n", F.transform("_rows", lambda r: r["_row"]).alias("rows")), {"ignoreNullFields": "false"})
    return counted.select(F.lit(name).alias("domain"), F.col("_key").alias("key"), body.alias("document"))


def snapshot(tables: Mapping[str, DataFrame], domains: Mapping[str, Domain]) -> DataFrame:
    """Blocks of all domains that have a table, in one table."""
    made = [blocks(tables[name], name, domain) for name, domain in domains.items() if name in tables]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def read_blocks(documents: DataFrame, name: str, rows: T.StructType) -> DataFrame:
    """Rows of one domain back from its documents: key, n and the columns of ``rows``."""
    whole = T.StructType([T.StructField("n", T.LongType()), T.StructField("rows", T.ArrayType(rows))])
    parsed = documents.where(F.col("domain") == name).select("key", F.from_json("document", whole).alias("d"))
    return parsed.select(F.col("key").alias("_key"), F.col("d.n").alias("_n"), F.explode("d.rows").alias("r")).select("_key", "_n", "r.*")
