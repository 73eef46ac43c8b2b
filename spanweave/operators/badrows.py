"""Problem 1: lines that do not become records, set apart with their reason while the sound ones load.

Every line is read permissively under an explicit typed schema, ``.`` being null, that keeps the raw text of what the reader cannot place: a wrong number of
columns, or a value that its type does not hold. These lines are reclassified by column count, quoting and casts. Of the placed ones only what the reader cannot judge is checked: the
quoting inside the attributes, and spellings of scores that its casts take but the formats do not.

Defined results: a null line, an empty one and one that starts with ``#`` is neither record nor case; one trailing carriage
return is no part of a line; repeated lines are judged one by one; an unknown or null kind is left out; further columns of the
input pass through untouched, names that clash with the parsed ones included (parsed values stay inside one struct column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = "_corrupt_line"
#: Pieces of a line that the reader sees; a line with more has too many columns anyway.
_MOST = 10_000


def _schema(spec: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "i": T.IntegerType(), "d": T.DoubleType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in spec.split())])


#: The columns of the two formats, in file order.
SCHEMAS = {
    "gtf": _schema("seqname:s source:s feature:s start:l end:l score:d strand:s frame:s attributes:s"),
    "bed12": _schema("chrom:s start:l end:l name:s score:i strand:s thickStart:l thickEnd:l itemRgb:s blockCount:i blockSizes:s blockStarts:s"),
}

_TOKEN = r'[^\s";]+'
_PAIR = rf'{_TOKEN}\s+(?:"[^"]*"|{_TOKEN})'
#: A pair between the start or a semicolon and a semicolon or the end. Pairs are found one by one, as a repeated group would overflow the stack on long columns.
_PLACED_PAIR = rf"(?:^|;)\s*{_PAIR}\s*(?=;|\z)"
#: A quoted value in its place: after key and white space, before a semicolon or the end.
_PLACED = rf'(^|;)(\s*{_TOKEN}\s+)"[^"]*"(?=\s*(?:;|\z))'
NUMBER = r"^[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?\z"
SCORE_0_1000 = r"^0*(?:[0-9]{1,3}|1000)\z"


def attributes_sound(attributes: Column) -> Column:
    """One or more ``key value`` pairs between single semicolons, the last one optional."""
    marked = F.regexp_replace(F.translate(attributes, "\x01", "x"), _PLACED_PAIR, "\x01")
    return marked.rlike("^\x01+(?:;\\s*)?\\z") & ~attributes.rlike(r"^\s*;")


def quotes_at_fault(attributes: Column) -> Column:
    """Double quotes odd in number, or one left over where no value starts or ends."""
    bare = F.regexp_replace(attributes, _PLACED, "$1$2v")
    return ((F.length(attributes) - F.length(F.replace(attributes, F.lit('"'), F.lit("")))) % 2 == 1) | bare.contains('"')


def parse_lines(df: DataFrame, kind: str, line: str = "line", reason: str = "reason", record: str = "record") -> DataFrame:
    """``df`` with ``record`` (struct of the typed columns; null for a failing line) and ``reason`` (null for a sound one).

    Comment, blank and null lines are dropped. Reasons, the first that applies: ``column_count``, ``quoting``, ``value``
    and, for any other column that its type does not hold, ``type``.
    """
    schema = SCHEMAS[kind]
    wide = T.StructType([*schema.fields, T.StructField(RAW, T.StringType())])
    text = F.regexp_replace(F.col(line), r"\r\z", "")
    options = {"mode": "PERMISSIVE", "nullValue": ".", "sep": "\t", "quote": "", "escape": "", "columnNameOfCorruptRecord": RAW, "maxCharsPerColumn": "-1", "maxColumns": str(2 * _MOST)}
    parts = F.split(F.col("_text"), "\t", -1)
    score = F.get(F.col("_parts"), F.lit(schema.fieldNames().index("score")))
    if kind == "gtf":
        attributes = F.get(F.col("_parts"), F.lit(8))
        broken = ~attributes_sound(attributes)
        quoting, value = broken & quotes_at_fault(attributes), broken | ~((score == ".") | score.rlike(NUMBER))
    else:
        quoting, value = F.lit(False), ~score.rlike(SCORE_0_1000)
    corrupt = F.col(f"_read.{RAW}").isNotNull()
    why = (
        F.when(corrupt & (F.size("_parts") != len(schema)), "column_count")
        .when(quoting, "quoting")
        .when(value, "value")
        .when(corrupt, "type")
    )

    def field(i: int, f: T.StructField) -> Column:
        read = F.col(f"_read.{f.name}")
        return (F.coalesce(read, F.get("_parts", F.lit(i))) if isinstance(f.dataType, T.StringType) else read).alias(f.name)  # texts as they stand, dots too

    fields = F.struct(*[field(i, f) for i, f in enumerate(schema)])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wide)
    read = (
        df.select(F.struct(*df.columns).alias("_in"), text.alias("_text"))
        .where((F.col("_text") != "") & ~F.col("_text").startswith("#"))
        .withColumn("_read", F.from_csv(F.substring_index("_text", "\t", _MOST), ddl, options))
        .withColumn("_parts", parts)
        .select("_in", "_read", "_parts", why.alias("_why"))
    )
    keep = [F.col(f"_in.`{c}`").alias(c) for c in df.columns if c not in (reason, record)]
    return read.select(*keep, F.col("_why").alias(reason), F.when(F.col("_why").isNull(), fields).alias(record))


def failing_lines(raw: DataFrame) -> DataFrame:
    """(line_id, reason) of each failing line of both kinds."""
    one = [parse_lines(raw.select("line_id", "line").where(F.col("kind") == k), k).select("line_id", "reason") for k in SCHEMAS]
    return one[0].unionByName(one[1]).where(F.col("reason").isNotNull())


def sound_records(raw: DataFrame, kind: str) -> DataFrame:
    """line_id and the typed columns of each sound line of ``kind``."""
    got = parse_lines(raw.select("line_id", "line").where(F.col("kind") == kind), kind)
    return got.where(F.col("reason").isNull()).select("line_id", "record.*")
