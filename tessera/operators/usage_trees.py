"""Token sums over report trees of any depth, and redaction of nested values.

A report's tree is walked once, without recursion, in the task that reads it; the walk only picks the usage blocks that count, and their
numbers are read and added in Spark.  A node's own numbers shadow its steps and records, which would count them twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tessera.operators.graph import kept

# The numbers of a usage block, and the words that make a name sensitive.
KEYS = ["prompt_tokens", "completion_tokens", "total_tokens", "api_calls", "successful_api_calls", "failed_api_calls"]
SENSITIVE = ["api_key", "authorization", "token", "secret", "password"]
REDACTED = "<redacted>"


def _numbers(block: Column) -> dict[str, Column]:
    """A usage block's numbers; what isn't a number is 0, and a missing total the sum of its parts."""
    def of(k: str) -> Column:
        value = F.expr(f"try_cast(try_variant_get(block, '$.{k}', 'string') AS double)")
        return F.coalesce(F.when(F.isnan(value), None).otherwise(value), F.lit(0.0))

    out = {k: of(k) for k in KEYS}
    out["total_tokens"] = F.when(of("total_tokens") > 0, of("total_tokens")).otherwise(of("prompt_tokens") + of("completion_tokens"))
    return out


def _blocks(tree: object) -> list[str]:
    """The usage blocks that count in a tree, as JSON."""
    out, open_ = [], [tree]
    while open_:
        node = open_.pop()
        if isinstance(node, list):
            open_ += node
        elif isinstance(node, dict):
            own, skip = node.get("token_usage"), ("token_usage", "steps", "usage_records")
            if not isinstance(own, dict):
                own, skip = node.get("usage"), ("usage", "usage_records")
                if not isinstance(own, dict) or own.keys().isdisjoint(KEYS):
                    own, skip = None, ()
            if own is not None:
                out.append(json.dumps({k: own[k] for k in KEYS if k in own}))
            open_ += [v for k, v in node.items() if k not in skip]
    return out


def usage_sums(reports: DataFrame, by: list[str], tree: str) -> DataFrame:
    """``<by>`` and the six numbers summed over the JSON trees in ``tree`` (text; null or no JSON: nothing).

    An object with an object ``token_usage`` adds that and goes on without its ``steps`` and ``usage_records``; one with an object
    ``usage`` that has any of the numbers adds that and goes on without ``usage_records``; all others go on with everything in them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, blocks = [], []
            for i, text in enumerate(batch.column(len(by)).to_pylist()):
                found = _blocks(json.loads(text)) if text is not None else []
                at += [i] * len(found)
                blocks += found
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in batch.columns[:-1]] + [pa.array(blocks, pa.string())], names=batch.schema.names)

    # what Spark doesn't read as JSON is null here
    trees = reports.select(*by, F.to_json(F.try_parse_json(tree)).alias("block"))
    own = trees.mapInArrow(run, trees.schema).withColumn("block", F.parse_json("block"))
    own = own.select(*by, *[c.alias(k) for k, c in _numbers(F.col("block")).items()])
    return kept(own.groupBy(*by).agg(*[F.sum(k).alias(k) for k in KEYS]), "usage")


def sensitive(name: str) -> bool:
    return any(word in name.lower() for word in SENSITIVE)


def redacted_column(column: Column, kind: t.DataType) -> Column:
    """``column`` with the value of every sensitive name replaced, through structs, arrays and maps of any depth."""
    if isinstance(kind, t.StructType):
        fields = [F.lit(REDACTED).alias(f.name) if sensitive(f.name) else redacted_column(column.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, t.ArrayType):
        return F.transform(column, lambda x: redacted_column(x, kind.elementType))
    if isinstance(kind, t.MapType) and isinstance(kind.keyType, t.StringType):
        pattern = "|".join(SENSITIVE)
        if isinstance(kind.valueType, t.StringType):
            return F.transform_values(column, lambda k, v: F.when(F.lower(k).rlike(pattern), F.lit(REDACTED)).otherwise(v))
        # values of other types have no such text: sensitive ones become null
        return F.transform_values(column, lambda k, v: F.when(~F.lower(k).rlike(pattern), redacted_column(v, kind.valueType)))
    return column


def redact(df: DataFrame) -> DataFrame:
    """``df`` with sensitive names redacted in every column, by its schema; a column that is sensitive itself goes whole."""
    return df.select(*[F.lit(REDACTED).alias(f.name) if sensitive(f.name) else redacted_column(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def _walk(value: object) -> object:
    if isinstance(value, dict):
        return {k: REDACTED if sensitive(k) else _walk(v) for k, v in value.items()}
    return [_walk(v) for v in value] if isinstance(value, list) else value


def redacted_json(df: DataFrame, column: str) -> DataFrame:
    """``df`` with sensitive names redacted in a column of JSON texts, whose shape may differ from row to row.
    Nulls stay, and texts that aren't JSON become null, as nothing can be said of them."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                try:
                    out.append(text and json.dumps(_walk(json.loads(text)), separators=(",", ":"), ensure_ascii=False))
                except (ValueError, RecursionError):
                    out.append(None)
            yield batch.set_column(at, column, pa.array(out, pa.string()))

    return df.mapInArrow(run, df.schema)
