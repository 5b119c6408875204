"""Documents to indexed rows: typed columns beside the documents' own."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.plans.schema import KEY, NUMERIC, TAG, TEXT, Field, IndexSchema, Settings

#: What a numeric field may hold as text: a decimal number or an infinity, with spaces around.
NUMBER = r"^\s*[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?)\s*$"
#: The name of the raw document of a JSON index.
DOCUMENT = "$"


def to_number(value: Column, dtype: str) -> Column:
    """A double; null where the value is no number or NaN."""
    if dtype == "string":
        number = F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    elif dtype == "boolean":
        return F.lit(None).cast("double")
    elif dtype in ("timestamp", "timestamp_ntz", "date"):
        number = value.cast("timestamp").cast("double")
    elif dtype in ("tinyint", "smallint", "int", "bigint"):
        return value.cast("double")
    else:
        number = value.cast("double")
    return F.when(~F.isnan(number), number)


def to_tags(value: Column, field: Field) -> Column:
    """The distinct tags, perhaps none; null for a null."""
    parts = F.transform(F.split(value, _literal(field.separator), -1), lambda t: F.regexp_replace(t, r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", ""))
    if not field.case_sensitive:
        parts = F.transform(parts, ascii_lower)
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def ascii_lower(value: Column) -> Column:
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _literal(char: str) -> str:
    return "\\" + char if char in "\\^$.|?*+()[]{}-" else char


def to_vector(value: Column, dtype: str, dim: int) -> Column:
    """array<float> of exactly dim finite-length components, else null: from arrays, little-endian blobs or bracketed lists."""
    if dtype.startswith("array"):
        vector = value.cast("array<float>")
    elif dtype == "binary":
        # four bytes, last first, are the bits of a float
        raw = F.hex(value)
        word = lambda i: F.conv(F.concat(*(F.substring(raw, i * 8 + 7 - 2 * k, 2) for k in range(4))), 16, 10).cast("bigint")
        whole = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: _float_of_bits(word(i)))
        vector = F.when(F.octet_length(value) == 4 * dim, whole).cast("array<float>")
    else:
        listed = F.when(value.rlike(r"^\s*\[.*\]\s*$"), F.split(F.regexp_replace(value, r"^\s*\[\s*|\s*\]\s*$", ""), r"\s*,\s*"))
        vector = F.transform(listed, lambda t: F.trim(t).try_cast("float"))
    return F.when((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), vector)


def _float_of_bits(bits: Column) -> Column:
    sign = F.when(F.shiftright(bits, 31) % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent, fraction = F.shiftright(bits, 23).bitwiseAND(0xFF), bits.bitwiseAND(0x7FFFFF)
    normal = (F.lit(1.0) + fraction / F.lit(float(1 << 23))) * F.pow(F.lit(2.0), exponent - 127)
    small = fraction / F.lit(float(1 << 23)) * F.pow(F.lit(2.0), F.lit(-126.0))
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return (sign * F.when(exponent == 0, small).when(exponent == 255, special).otherwise(normal)).cast("float")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed one time, however often f names it: for values that are dear to get."""
    return F.get(F.transform(F.array(value), f), 0)


def is_path(schema: IndexSchema, field: Field) -> bool:
    """Whether a field is a path into the JSON document."""
    return schema.on == "JSON" and field.identifier.startswith(DOCUMENT)


def raw_value(df: DataFrame, schema: IndexSchema, field: Field) -> tuple[Column, str]:
    """A field's raw column and its type: a column of that name, or a path into the JSON document."""
    if is_path(schema, field):
        return once(F.get_json_object(F.col(f"`{DOCUMENT}`"), field.identifier), lambda v: F.nullif(v, F.lit(""))), "string"
    if field.identifier not in df.columns:
        return F.lit(None).cast("string"), "string"
    return F.col(f"`{field.identifier}`"), dict(df.dtypes)[field.identifier]


def typed(df: DataFrame, schema: IndexSchema, field: Field) -> tuple[Column, Column]:
    """(prepared column, whether the raw value is there but invalid)."""
    value, dtype = raw_value(df, schema, field)
    dear = is_path(schema, field)
    if field.kind == NUMERIC:
        out = once(value, lambda v: to_number(v, dtype)) if dear else to_number(value, dtype)
    elif field.kind == TAG:
        if dtype.startswith("array"):
            listed = F.transform(value.cast("array<string>"), lambda t: t if field.case_sensitive else ascii_lower(t))
            out = F.array_distinct(F.filter(listed, lambda t: t.isNotNull() & (t != "")))
        else:
            out = once(value, lambda v: to_tags(v, field)) if dear else to_tags(value.cast("string"), field)
        return out, F.lit(False)
    elif field.kind == TEXT:
        text = value.cast("string")
        return F.when(text.isNotNull(), tokens(text, schema.punctuation, schema.stop_words)), F.lit(False)
    else:
        out = to_vector(value, dtype, field.dim)
    return out, value.isNotNull() & out.isNull()


def prepare(df: DataFrame, schema: IndexSchema, settings: Settings, key: str = KEY) -> DataFrame:
    """df with the key as KEY and a typed column for each field; a row belongs to the index if its key has one of the prefixes.

    A field that cannot be read is null (the document is indexed without it); from release
    (1, 3, 0) on such a document is left out. Only columns that a query uses are computed, as
    Catalyst prunes the others.
    """
    rows = df if key == KEY else df.withColumnRenamed(key, KEY)
    rows = rows.withColumn(KEY, F.col(KEY).cast("string")).where(F.col(KEY).isNotNull())
    if schema.prefixes and "" not in schema.prefixes:
        rows = rows.where(reduce(or_, (F.col(KEY).startswith(p) for p in schema.prefixes)))
    ready = {f: typed(rows, schema, f) for f in schema.fields}
    if settings.since(1, 3, 0):
        rows = rows.where(~reduce(or_, (bad for _, bad in ready.values())))
    out = rows.withColumns({f.column: column for f, (column, _) in ready.items()})
    if schema.score_field and schema.score_field in rows.columns:
        own = to_number(F.col(schema.score_field), dict(rows.dtypes)[schema.score_field])
        return out.withColumn("__score", F.coalesce(own, F.lit(schema.score)))
    return out.withColumn("__score", F.lit(schema.score))
