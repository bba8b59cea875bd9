"""The columns of a bundle's tables, and a check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.sources.cases import LEDGER

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


TABLES = {
    "documents": _of(doc_id=S, path=S, n_units=L, parse_confidence=D, review_state=S, status=S),
    "blobs": _of(doc_id=S, content=T.BinaryType()),
    "nodes": _of(node_id=S, doc_id=S, seq=L, unit=S, kind=S, level=I, raw=S, byte_start=I, byte_end=I, parent_id=S, section_path=S, normalized=S, is_assertive=B, section_id=S, prev_id=S, next_id=S),
    "terms": _of(term_id=S, doc_id=S, definition_id=S, scope_id=S, surface=S, canonical=S, definition_kind=S, gloss=S, confidence=D),
    "edges": _of(edge_id=S, src=S, dst=S, type=S, confidence=D, provenance=S, source=I, doc_id=S),
    "vectors": _of(node_id=S, doc_id=S, model_id=S, dim=I, vector=T.ArrayType(D), computed_at=T.TimestampType()),
    "ledger": LEDGER,
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in their types, further ones after them. Raises if one is missing or can't be cast without a doubt."""
    wanted, there = TABLES[table], {f.name: f.dataType for f in df.schema.fields}
    if missing := [f.name for f in wanted.fields if f.name not in there]:
        raise ValueError(f"{table} lacks {', '.join(missing)}")
    numbers = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
    for f in wanted.fields:
        same = there[f.name] == f.dataType or isinstance(there[f.name], T.NullType)
        wider = isinstance(f.dataType, (T.LongType, T.DoubleType)) and isinstance(there[f.name], (*numbers, T.FloatType))
        if not same and not wider and not (isinstance(f.dataType, T.ArrayType) and isinstance(there[f.name], T.ArrayType)):
            raise ValueError(f"{table}.{f.name} is {there[f.name].simpleString()}, not {f.dataType.simpleString()}")
    cast = [F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields]
    return df.select(*cast, *[F.col(f"`{c}`") for c in df.columns if c not in wanted.names])


def doc_order(nodes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """nodes, of the documents in ids (doc_id) if given, sorted by document and place: within partitions dealt out by document, so no total sort."""
    own = nodes if ids is None else nodes.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return own.repartition("doc_id").sortWithinPartitions("doc_id", "seq")
