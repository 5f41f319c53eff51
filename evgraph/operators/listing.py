"""Reading a generation's tables: filtered listings and rows by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: As many rows as a listing gives at most (a fixed value).
MOST = 10_000


def listing(table: DataFrame, generation: str | None, order: list[str], limit: int = MOST, **equal: str | None) -> DataFrame:
    """Rows of one generation in order, those only whose columns ``equal`` what is given; 1 to MOST of them. No generation:
    none. The filters reach the scan; the limit is a top-k, not a sort of the table."""
    rows = table.where(F.lit(False)) if generation is None else table.where(F.col("generation_id") == generation)
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy(*order).limit(max(1, min(MOST, limit or MOST)))


def edges_where(edges: DataFrame, **equal: str | None) -> DataFrame:
    """Edges whose kind, source, target or generation are those given."""
    for name, value in equal.items():
        if value is not None:
            edges = edges.where(F.col(name) == value)
    return edges


def hydrate(tables: list[DataFrame], ids: DataFrame) -> DataFrame:
    """The rows with the ids (id, and any columns such as their place), of whichever table has them; each table is filtered
    before the union, and ids that none has are left out."""
    out = None
    for t in tables:
        rows = t.join(ids, "id")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
