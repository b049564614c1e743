"""Labelled bins: the value belongs to the bin whose lower edge it reaches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def edge_text(edge: float) -> str:
    return f"{edge:g}"


def bin_labels(edges: Sequence[float]) -> list[str]:
    inner = [f"{edge_text(a)}~{edge_text(b)}" for a, b in zip(edges, edges[1:])]
    return [f"<{edge_text(edges[0])}", *inner, f">={edge_text(edges[-1])}"]


def bin_label(value: Column, edges: Sequence[float]) -> Column:
    labels = bin_labels(edges)
    chain = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        chain = chain.when(value < F.lit(edge), F.lit(label))
    return chain.otherwise(F.lit(labels[-1]))
