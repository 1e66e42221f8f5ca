"""Projections of sources onto one schema of line items, declared as data.

A source states, for each field of the schema that it has, the column or
expression it comes from; fields it does not have are null of the right
type, and unknown ones raise.  What fits no field goes into ``extra``, a
map that leaves out null and empty values and keeps zeros.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

#: The fields of a line item and their types.
SCHEMA = {
    "id": "string", "dataset": "string", "level": "string", "buyer": "string", "buyer_key": "string", "supplier": "string", "supplier_key": "string", "person": "string", "description": "string",
    "category": "string", "method": "string", "amount": "decimal(18,2)", "currency": "string", "date": "date", "period_start": "date", "period_end": "date", "fiscal_year": "string", "city": "string",
    "locator": "string", "extra": "map<string,string>",
}


def _column(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extra(values: dict[str, str | Column]) -> Column:
    """A map of what is stated: null and empty values go, zeros stay."""
    pairs = [x for name, v in values.items() for x in (F.lit(name), _column(v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.coalesce(v != "", F.lit(False))) if pairs else F.create_map().cast("map<string,string>")


def conform(source: DataFrame, dataset: str, fields: dict[str, str | Column], receipt: list[str], more: dict[str, str | Column] | None = None) -> DataFrame:
    """The line items of one source.

    ``fields``: by field of ``SCHEMA``, a column or an expression.  ``receipt``:
    the columns that tell a record's place in its source, of which id and
    locator are made.  ``more``: what goes into ``extra``.
    """
    unknown = set(fields) - set(SCHEMA)
    if unknown:
        raise ValueError(f"{dataset}: no such fields: {', '.join(sorted(unknown))}")
    place = [F.col(c) for c in receipt]
    made = {"id": ids.item_id(F.lit(dataset), *place), "dataset": F.lit(dataset), "locator": F.concat_ws("/", *(c.cast("string") for c in place)), "extra": extra(more or {})}
    made |= {name: _column(x) for name, x in fields.items()}
    return source.select(*(made.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in SCHEMA.items()))


def ledger(*sources: DataFrame) -> DataFrame:
    """All line items; each source must have the schema, in any order."""
    for df in sources:
        if {f.name: f.dataType.simpleString() for f in df.schema} != SCHEMA:
            raise ValueError("a source does not have the schema of line items")
    return reduce(DataFrame.unionByName, sources)
