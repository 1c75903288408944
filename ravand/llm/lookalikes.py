"""Visually identical text with different characters: one consistent form, and pairs of rows it makes equal.

Arrow text becomes numpy code-point arrays; lookup-table gathers with expansion offsets fold and decompose;
marks are ordered and composed by array operations (see codepoints.look).

Defined cases: a null text stays null; an empty text stays empty; blanks are kept one for one; an existing
column of the output's name is replaced; all other columns pass through unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravand.llm import codepoints as cp
from ravand.session import free, materialize


def _text_hash(cps: np.ndarray, offs: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each text's code points and their places."""
    size = np.diff(offs)
    place = np.arange(len(cps)) - np.repeat(offs[:-1], size)
    with np.errstate(over="ignore"):
        mixed = cp.mix((cps.astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + np.uint64(salt))
        total = np.concatenate([[np.uint64(0)], np.cumsum(mixed, dtype=np.uint64)])
        out = cp.mix(total[offs[1:]] - total[offs[:-1]] + size.astype(np.uint64))
    return out.view(np.int64)


def normalize_look(df: DataFrame, text: str, out: str = "norm_text") -> DataFrame:
    """`df` with column `out`: the text in the form in which texts that look the same are equal."""
    rest = [c for c in df.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in rest]).schema) + f", `{out}` string"
    at = rest.index(text) if text in rest else None
    source = df.select(*[F.col(f"`{c}`") for c in rest], *([F.col(f"`{text}`").alias("__ravand_text")] if at is None else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at if at is not None else batch.num_columns - 1)
            parts = []
            for a, b in cp.blocks(column):
                piece = column.slice(a, b - a)
                parts.append(cp.encode(*cp.look(*cp.decode(piece)), valid=piece.is_valid().to_numpy(zero_copy_only=False)))
            norm = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], norm], names=[*rest, out])

    return source.mapInArrow(run, schema)


def normalized_texts(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_name, id, norm_text) of every row of every table. `tables` maps a name to (DataFrame, id column, text column)."""
    rows = None
    for name, (df, row_id, text) in tables.items():
        part = normalize_look(df.select(F.col(f"`{row_id}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text")), "text")
        part = part.select(F.lit(name).alias("table_name"), "id", "norm_text")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def look_keys(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(id, k1, k2, raw) of every row whose text holds a letter: hashes of its normal form and of its raw text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = cp.letter_class() == 1
        for batch in batches:
            ids = batch.column(0)
            for a, b in cp.blocks(batch.column(1)):
                cps, offs = cp.decode(batch.column(1).slice(a, b - a))
                raw = _text_hash(cps, offs, 1)
                cps, offs = cp.look(cps, offs)
                count = np.concatenate([[0], np.cumsum(letters[cps])])
                keep = pa.array(count[offs[1:]] > count[offs[:-1]])
                columns = [ids.slice(a, b - a), *(pa.array(x) for x in (_text_hash(cps, offs, 2), _text_hash(cps, offs, 3), raw))]
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], names=["id", "k1", "k2", "raw"])

    return df.select(F.col(f"`{row_id}`").cast("bigint"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).mapInArrow(run, "id bigint, k1 bigint, k2 bigint, raw bigint")


def lookalike_pairs(tables: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(table_name, id_a, id_b): pairs of rows of one table that look the same but are not the same string.

    `tables` maps a name to (DataFrame, id column, text column). Rows of one raw text are a class; the classes of
    one look are paired, and each pair of classes is then expanded to its members, so copies of one and the same
    text, however many, never meet each other. Rows without an id are no case.
    """
    rows = None
    for name, (df, row_id, text) in tables.items():
        part = look_keys(df.where(F.col(f"`{row_id}`").isNotNull()), row_id, text).withColumn("table_name", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    rows = materialize(rows)
    look = ["table_name", "k1", "k2"]
    mixed = rows.groupBy(*look).agg(F.min("raw").alias("lo"), F.max("raw").alias("hi")).where("lo <> hi").select(*look)
    members = materialize(rows.join(mixed, look, "left_semi"))
    free(rows)
    classes = members.select(*look, "raw").distinct()
    pairs = classes.withColumnRenamed("raw", "raw_a").join(classes.withColumnRenamed("raw", "raw_b"), look).where("raw_a < raw_b")
    for side in "ab":
        pairs = pairs.join(members.select(*look, F.col("raw").alias(f"raw_{side}"), F.col("id").alias(f"id_{side}")), [*look, f"raw_{side}"])
    return pairs.select("table_name", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
