"""Problem 4: entity, attribute, value rows reshaped into one typed row per entity.

Rows are sorted by entity, attributes are encoded as column indices, and runs of one entity stream into sparse columnar builders: an index matrix
with its validity mask picks the cells of each column, which become typed buffers. This happens twice. First within each
input split, before anything moves, so that an entity with a third of all rows leaves a split as one partial row; then over the partial rows, sorted
by entity. Both steps keep no more than one batch and one open row.

Defined results: the first value in order wins in a single-valued column; the values of a listed column are joined in order, repeats
kept; null values give no cell; attributes without a column are left out; an entity without any cell gives no row here; a null entity gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.functions.attributes import SYNONYMS, key_reader, raw_pairs

#: The columns of the wide table, and other names of some keys.
GTF_COLUMNS = {
    "gene_id": "string", "transcript_id": "string", "gene_name": "string", "gene_type": "string", "transcript_type": "string",
    "tag": "string", "exon_number": "bigint", "level": "bigint", "support": "bigint",
}
GTF_LISTED = ("tag",)



def attribute_rows(df: DataFrame, entity: str, attributes: str, synonyms: dict[str, str] | None = None) -> DataFrame:
    """(entity, attribute, pos, value) of each pair of a GTF attribute column in any house style; keys in lower case, values bare or null."""
    names = dict(SYNONYMS if synonyms is None else synonyms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = key_reader(names)
        for b in batches:
            rows, keys, pos, values = [], [], [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                for i, (k, v) in enumerate(raw_pairs(text) if text else ()):
                    rows.append(r)
                    keys.append(key(k))
                    pos.append(i)
                    values.append(None if v == "" or v == "." else v)
            ids = b.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(keys, pa.string()), pa.array(pos, pa.int64()), pa.array(values, pa.string())], names=[entity, "attribute", "pos", "value"])

    schema = f"`{entity}` {df.schema[entity].dataType.simpleString()}, attribute string, pos bigint, value string"
    return df.select(entity, attributes).mapInArrow(run, schema)


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def to_wide(rows: DataFrame, entity: str, attribute: str, order: str, value: str, columns: dict[str, str], listed: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity (a BIGINT or STRING column) with the typed ``columns`` (string or bigint); a bigint cell is null unless it is a signed whole number of 64 bits."""
    names, width = list(columns), len(columns)
    ids = F.create_map(*[F.lit(y) for i, n in enumerate(names) for y in (n, i)])
    whole = F.array(*[F.lit(columns[n] == "bigint") for n in names])
    kind = rows.schema[entity].dataType
    typed = (
        rows.select(F.col(entity).alias("e"), F.col(order).cast("bigint").alias("o"), ids[F.col(attribute)].alias("c"), F.col(value).alias("v"))
        .where(F.col("e").isNotNull() & F.col("c").isNotNull() & F.col("v").isNotNull())
        .withColumn("v", F.when(~whole[F.col("c")], F.col("v")).otherwise(F.when(F.col("v").rlike(r"^[+-]?[0-9]+\z"), F.expr("try_cast(v AS BIGINT)").cast("string"))))
        .where(F.col("v").isNotNull())
    )
    arrow = [pa.string() if n in listed or columns[n] != "bigint" else pa.int64() for n in names]
    many = [n in listed for n in names]
    fields = ", ".join(f"c{i} array<string>, o{i} array<bigint>" if many[i] else f"c{i} {columns[n]}, o{i} bigint" for i, n in enumerate(names))
    schema = f"e {kind.simpleString()}, {fields}"  # of each cell the value and where it stood
    labels = ["e", *[x for i in range(width) for x in (f"c{i}", f"o{i}")]]

    def lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by entity and order within the split to partial wide rows; a run cut by a batch's end gives two."""
        for b in batches:
            if not len(b):
                continue
            e, o, v = b.column("e"), b.column("o"), b.column("v").cast(pa.string())
            starts = _starts(pc.dictionary_encode(e).indices.to_numpy().astype(np.int64))
            group = np.zeros(len(b), np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            col, at = b.column("c").to_numpy(), np.arange(len(b))
            first = np.full(width * len(starts), len(b))
            np.minimum.at(first, col * len(starts) + group, at)  # the earliest row of each cell
            first = first.reshape(width, -1)
            out = [e.take(pa.array(starts))]
            for i in range(width):
                if many[i]:
                    mine = at[col == i]
                    ends = np.r_[0, np.cumsum(np.bincount(group[mine], minlength=len(starts)))]
                    out += [lists(v.take(pa.array(mine)), ends), lists(o.take(pa.array(mine)), ends)]
                else:
                    pick = pa.array(first[i], mask=first[i] == len(b))
                    out += [v.take(pick).cast(arrow[i]), o.take(pick)]
            yield pa.RecordBatch.from_arrays(out, names=labels)

    def merged(t: pa.Table) -> pa.Table:
        """Partial rows sorted by entity to one row per entity."""
        t = t.combine_chunks()
        starts = _starts(pc.dictionary_encode(t.column("e").combine_chunks()).indices.to_numpy().astype(np.int64))
        if len(starts) == len(t):
            return t
        group = np.zeros(len(t), np.int64)
        group[starts[1:]] = 1
        group = np.cumsum(group)
        out = [t.column("e").combine_chunks().take(pa.array(starts))]
        for i in range(width):
            c, o = t.column(f"c{i}").combine_chunks(), t.column(f"o{i}").combine_chunks()
            if many[i]:
                values, places = c.flatten(), o.flatten().to_numpy(zero_copy_only=False)
                owner = np.repeat(group, pc.list_value_length(c).to_numpy())
                order = np.lexsort((places, owner))
                ends = np.r_[0, np.cumsum(np.bincount(owner, minlength=len(starts)))]
                out += [lists(values.take(pa.array(order)), ends), lists(pa.array(places[order]), ends)]
            else:
                gone = pc.is_null(c).to_numpy(zero_copy_only=False)
                order = np.lexsort((pc.fill_null(o, 0).to_numpy(zero_copy_only=False), gone, group))  # cells with a value first, the earliest ahead
                best = order[_starts(group[order])]
                out += [c.take(pa.array(best)), o.take(pa.array(best))]
        return pa.Table.from_arrays(out, names=labels)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row: pa.Table | None = None
        for b in batches:
            if len(b):
                t = pa.Table.from_batches([b])
                t = merged(pa.concat_tables([open_row, t.cast(open_row.schema)]) if open_row is not None else t)
                open_row = t.slice(len(t) - 1)
                yield from t.slice(0, len(t) - 1).to_batches()
        if open_row is not None:
            yield from open_row.combine_chunks().to_batches()

    partial = typed.sortWithinPartitions("e", "o").mapInArrow(build, schema)
    wide = partial.repartition("e").sortWithinPartitions("e").mapInArrow(merge, schema)
    cells = [F.when(F.size(f"c{i}") > 0, F.array_join(f"c{i}", ",")) if many[i] else F.col(f"c{i}") for i in range(width)]
    return wide.select(F.col("e").alias(entity), *[c.alias(n) for c, n in zip(cells, names)])


def gtf_wide(gtf: DataFrame) -> DataFrame:
    """record_id and the nine typed columns of each gtf record; a record without any usable pair keeps its row, all null."""
    rows = attribute_rows(gtf, "record_id", "attributes")
    wide = to_wide(rows, "record_id", "attribute", "pos", "value", GTF_COLUMNS, GTF_LISTED)
    return gtf.select("record_id").join(wide, "record_id", "left")


def cells(wide: DataFrame, entity: str, columns: list[str]) -> DataFrame:
    """(entity, col_name, cell) of each non-null cell."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col_name"), F.col(c).cast("string").alias("cell")) for c in columns])
    return wide.select(entity, F.explode(pairs).alias("x")).select(entity, "x.*").where(F.col("cell").isNotNull())
