"""the two kernels as table functions for SQL.

`parse_pages` and `split_texts` take a table and read it in Arrow batches:
`SELECT * FROM parse_pages(TABLE(SELECT page_id, html FROM pages) PARTITION BY page_id)`. `parse_nodes` and `split_units` take
one value, for LATERAL, which Spark does not join with Arrow functions: `SELECT * FROM documents, LATERAL split_units(text)`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..kernels import ship_by_value
from ..operators.units import _SPACES, split_text
from ..sources.html import parse_page

ship_by_value(__name__)

NODE = [("node_id", pa.int32()), ("end_id", pa.int32()), ("parent_id", pa.int32()), ("depth", pa.int32()), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string()))]
UNIT = [("unit_pos", pa.int32()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]
NODE_DDL = "node_id int, end_id int, parent_id int, depth int, tag string, attrs map<string,string>"
UNIT_DDL = "unit_pos int, text string, start int, end int"


def nodes_of(html: str | None) -> list[dict]:
    return [{name: n[name] for name, _ in NODE} for n in parse_page(html or "")[0]]


def units_of(text: str | None) -> list[dict]:
    flat = _SPACES.sub(" ", text or "").strip(" ")
    return [{"unit_pos": i, "text": flat[a:b], "start": a, "end": b} for i, (a, b) in enumerate(split_text(flat) if flat else [])]


def rows_of_batch(batch: pa.RecordBatch, read, fields: list) -> pa.Table:
    """Per row of (id, value): what is read from the value, beside the id."""
    ids, values = batch.column(0), batch.column(1).to_pylist()
    made = [read(v) for v in values]
    owners = ids.take(pa.array([i for i, rows in enumerate(made) for _ in rows], pa.int64()))
    flat = pa.Table.from_pylist([row for rows in made for row in rows], pa.schema(fields))
    return flat.add_column(0, "id", owners)


class ParsePages:
    """Elements of the pages of a table (id, html)."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield rows_of_batch(batch, nodes_of, NODE)


class SplitTexts:
    """Units of the texts of a table (id, text)."""

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        yield rows_of_batch(batch, units_of, UNIT)


class ParseNodes:
    """Elements of one page."""

    def eval(self, html: str):
        for row in nodes_of(html):
            yield tuple(dict(v) if name == "attrs" else v for name, v in row.items())


class SplitUnits:
    """Units of one text."""

    def eval(self, text: str):
        for row in units_of(text):
            yield tuple(row.values())


def register_table_functions(spark: SparkSession, id_type: str = "bigint") -> None:
    """Registers the four functions; `id_type` is the type of the first column of their tables."""
    spark.udtf.register("parse_pages", arrow_udtf(ParsePages, returnType=f"id {id_type}, {NODE_DDL}"))
    spark.udtf.register("split_texts", arrow_udtf(SplitTexts, returnType=f"id {id_type}, {UNIT_DDL}"))
    spark.udtf.register("parse_nodes", udtf(ParseNodes, returnType=NODE_DDL))
    spark.udtf.register("split_units", udtf(SplitUnits, returnType=UNIT_DDL))
