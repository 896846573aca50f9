"""Envelope rows -> one flat text table per entity type.

Output columns: ``id, name, <record fields...>, dst_id, dst_name``, every value
text, every text value decoded (``clean_string``). The whole transformation is one
projection - a narrow stage inside whole-stage codegen, no UDF. The only job it
starts is a small aggregate that tells which union member an entity populates
(typed sources), which schema its records have (JSON text) or which keys occur (maps).

JSON text is parsed once per record into the schema learned from all records and then
takes the typed path; only keys whose values are of several types stay variants.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_string

MEMBER_RE = re.compile(r"^member\d+$")
# Nested values are joined with this separator.
LIST_SEP = ";"
# Fixed value: the record field that is renamed to "<entity>_name".
NAME_FIELD = "name"
# Fixed value: the record field that may itself be a union.
STATE_FIELD = "state"


def fmt_double(c: Column) -> Column:
    """Text of a double with 15 significant digits and no trailing zeros.

    Fast path: Spark's own text of the double when it is plain decimal with at most
    15 digits (then it is exactly the 15-digit rounding); otherwise ``%.15g``.
    """
    plain = c.cast("string")
    n_digits = F.length(plain) - F.when(plain.startswith("-"), 2).otherwise(1)   # minus sign and point
    fast_ok = ~plain.contains("E") & (n_digits <= 15)
    fast = F.when(plain.endswith(".0"), F.left(plain, F.length(plain) - 2)).otherwise(plain)
    s = F.format_string("%.15g", c)
    s = F.regexp_replace(s, r"\.?0+e", "e")                      # mantissa zeros before an exponent
    s = F.regexp_replace(F.regexp_replace(s, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return (F.when(c.isNull(), F.lit(None).cast("string")).when(F.isnan(c), F.lit("NaN"))
            .when(c == float("inf"), F.lit("Inf")).when(c == float("-inf"), F.lit("-Inf"))
            .when(fast_ok, fast).otherwise(s))


def scalarize(c: Column, dt: T.DataType) -> Column:
    """Any value -> text: scalars printed, nested values reduced to their leaves joined by ';'.

    NULL and empty nested values become NULL; NULL leaves are skipped.
    """
    if isinstance(dt, T.StringType):
        return c
    if isinstance(dt, T.BooleanType):
        return F.when(c, F.lit("TRUE")).when(~c, F.lit("FALSE"))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        return fmt_double(c.cast("double"))
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return c.cast("string")
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if isinstance(dt, T.DateType):
        return F.date_format(c, "yyyy-MM-dd")
    if isinstance(dt, T.BinaryType):
        return F.hex(c)
    if isinstance(dt, T.ArrayType):
        return F.nullif(F.array_join(F.transform(c, lambda x: scalarize(x, dt.elementType)), LIST_SEP), F.lit(""))
    if isinstance(dt, T.MapType):
        return scalarize(F.map_values(c), T.ArrayType(dt.valueType))
    if isinstance(dt, T.StructType):
        leaves = [scalarize(c[f.name], f.dataType) for f in dt.fields]
        return F.nullif(F.concat_ws(LIST_SEP, *leaves), F.lit("")) if leaves else F.lit(None).cast("string")
    return c.cast("string")


MOST_FIELDS = 200       # of a nested JSON object: one with more keys is a dictionary and stays a variant
DOUBLE_DIGITS = 15      # JSON fractions of up to so many digits are read as doubles


def _json_type(dt: T.DataType, nested: bool = False) -> T.DataType:
    """The type in which values of a learned variant type are read."""
    if isinstance(dt, T.DecimalType):
        if dt.scale == 0:
            return T.DecimalType(38, 0)
        return T.DoubleType() if dt.precision <= DOUBLE_DIGITS else T.VariantType()
    if isinstance(dt, T.ArrayType):
        inner = _json_type(dt.elementType, True)
        return T.VariantType() if isinstance(inner, T.VariantType) else T.ArrayType(inner)
    if isinstance(dt, T.StructType):
        fields = [T.StructField(f.name, _json_type(f.dataType, True)) for f in dt.fields]
        if nested and (len(fields) > MOST_FIELDS or any(isinstance(f.dataType, T.VariantType) for f in fields)
                       or len({f.name.lower() for f in fields}) < len(fields)):
            return T.VariantType()
        return T.StructType(fields)
    if isinstance(dt, T.NullType):
        return T.StringType()
    return dt


def json_schemas(envelope: DataFrame, per_entity: bool = True) -> dict[str | None, T.StructType]:
    """Record schema of every entity type with a JSON text payload, merged over all its records in one job.

    Keys come in the order of their first place in a record. Without ``per_entity`` one schema for all rows, under None.
    """
    fields = envelope.select(F.col("name") if per_entity else F.lit(None).cast("string").alias("name"), F.posexplode(
        F.map_entries(F.from_json("object", "map<string,variant>"))).alias("p", "e"))
    rows = fields.groupBy("name", F.col("e.key").alias("k")).agg(
        F.min("p").alias("p"), F.schema_of_variant_agg("e.value").alias("s")).orderBy("name", "p", "k").collect()
    out: dict[str | None, T.StructType] = {} if per_entity else {None: T.StructType([])}
    for r in rows:
        # quoted names are left alone
        ddl = re.sub(r"(`(?:[^`]|``)*`)|\bOBJECT<", lambda m: m[1] or "STRUCT<", r["s"] or "VOID")
        dt = _json_type(T.StructType.fromDDL(f"o {ddl}").fields[0].dataType, True)
        out[r["name"]] = T.StructType([*out.get(r["name"], T.StructType([])).fields, T.StructField(r["k"], dt)])
    return out


# one JSON scalar, or a key with its colon
JSON_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?|-?[0-9][0-9.eE+-]*+|true|false|null'


def json_value(raw: Column) -> Column:
    """JSON text of one value -> the same text as ``scalarize`` gives for the typed value.

    Leaves at any depth are joined by ';' (keys and nulls are left out); strings are unescaped,
    booleans print TRUE/FALSE, numbers with a fraction or exponent print as doubles.
    """
    def leaf(t: Column) -> Column:
        return (F.when(t.startswith('"'), F.get(F.from_json(F.concat(F.lit("["), t, F.lit("]")), "array<string>"), F.lit(0)))
                .when(t == "true", F.lit("TRUE")).when(t == "false", F.lit("FALSE"))
                .when(t.rlike("[.eE]"), fmt_double(t.cast("double"))).otherwise(t))

    tokens = F.filter(F.regexp_extract_all(raw, F.lit(JSON_TOKEN), F.lit(0)), lambda t: ~t.endswith(":") & (t != "null"))
    leaves = F.transform(tokens, leaf)
    # an empty text is a value of its own, an empty list or object is none
    return F.when(F.size(leaves) == 1, leaves[0]).when(F.size(leaves) > 1, F.nullif(F.array_join(leaves, LIST_SEP), F.lit("")))


def state_member(n: str, c: Column, dt: T.DataType) -> Column:
    """A field's text; of a ``state`` with a populated ``member0`` only that member counts."""
    whole = scalarize(c, dt)
    if n == STATE_FIELD and isinstance(dt, T.StructType) and "member0" in dt.fieldNames():
        first = scalarize(c["member0"], dt["member0"].dataType)
        return F.when(c["member0"].isNotNull(), first).otherwise(whole)
    return whole


def has_text(dt: T.DataType) -> bool:
    """Whether a value of this type can render to text the decoding could change.

    Numbers, dates, timestamps and booleans render without underscores, double
    spaces, "- " or edge whitespace, so decoding leaves them unchanged.
    """
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return True
    if isinstance(dt, T.ArrayType):
        return has_text(dt.elementType)
    if isinstance(dt, T.MapType):
        return has_text(dt.valueType)
    if isinstance(dt, T.StructType):
        return any(has_text(f.dataType) for f in dt.fields)
    return False


def _is_union(dt: T.DataType) -> bool:
    return isinstance(dt, T.StructType) and len(dt.fields) > 0 and all(MEMBER_RE.match(f.name) for f in dt.fields)


def _keys(df: DataFrame, obj: Column) -> list[str]:
    """Keys that occur (one metadata job), ordered by their first position in a record."""
    return [r["k"] for r in df.select(F.posexplode(F.map_keys(obj)).alias("p", "k"))
            .groupBy("k").agg(F.min("p").alias("p")).orderBy("p", "k").collect()]


def union_members(envelope: DataFrame) -> dict[str, list[str] | T.StructType] | None:
    """What one job tells of the payloads of all entity types: the populated members of a union, the schema of
    JSON text; None for other payloads.

    Pass the result to ``flatten_entity`` when several entities are flattened.
    """
    dt = envelope.schema["object"].dataType if "object" in envelope.columns else None
    if isinstance(dt, T.StringType):
        return json_schemas(envelope)
    if dt is None or not _is_union(dt):
        return None
    names = dt.fieldNames()
    rows = envelope.groupBy("name").agg(*[F.bool_or(F.col("object")[m].isNotNull()).alias(m) for m in names]).collect()
    return {r["name"]: [m for m in names if r[m]] for r in rows}


def _json_fields(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[tuple[str, Column, bool]]]:
    """As ``_record_fields``, for JSON text of a learned schema."""
    if len({n.lower() for n in schema.names}) < len(schema.names):
        # names that differ by case only cannot be told apart in a struct
        df = df.withColumn("object", F.from_json("object", "map<string,variant>"))
        return df, [(n, _variant_text(n, F.col("object")[n]), True) for n in schema.names]
    obj, out = F.col("object"), []
    for f in schema.fields:
        if isinstance(f.dataType, T.VariantType):
            out.append((f.name, _variant_text(f.name, obj[f.name]), True))
        else:
            out.append((f.name, state_member(f.name, obj[f.name], f.dataType), has_text(f.dataType)))
    return df.withColumn("object", F.from_json("object", schema)) if schema.fields else df, out


def _variant_text(n: str, c: Column) -> Column:
    return json_value(F.to_json(F.coalesce(F.try_variant_get(c, "$.member0", "variant"), c) if n == STATE_FIELD else c))


def _record_fields(df: DataFrame, learned: list[str] | T.StructType | None = None
                   ) -> tuple[DataFrame, list[tuple[str, Column, bool]]]:
    """(frame, [(field name, text column, may hold text)]) of the entity record inside ``object``.

    ``learned`` is an entity's entry of ``union_members``; null learns it from ``df``.
    """
    if "object" not in df.columns:
        return df, []
    dt = df.schema["object"].dataType
    obj = F.col("object")
    used_members = learned
    if isinstance(dt, T.StringType):
        return _json_fields(df, json_schemas(df, per_entity=False)[None] if learned is None else learned or T.StructType([]))
    if isinstance(dt, T.MapType):
        return df, [(k, scalarize(obj[k], dt.valueType), has_text(dt.valueType)) for k in _keys(df, obj)]
    if _is_union(dt):
        members = [f for f in dt.fields]
        if used_members is None:
            flags = df.agg(*[F.max(obj[m.name].isNotNull().cast("int")).alias(m.name) for m in members]).first()
            used_members = [m.name for m in members if flags and flags[m.name]]
        used = [m for m in members if m.name in used_members]
        if len(used) == 1:
            m = used[0]
            return df, [(f.name, state_member(f.name, obj[m.name][f.name], f.dataType), has_text(f.dataType))
                        for f in m.dataType.fields]
        # several members in one entity type: per row, the first populated member wins
        names: list[str] = []
        for m in used:
            for f in m.dataType.fields:
                if f.name not in names:
                    names.append(f.name)
        out = []
        for n in names:
            expr = F.lit(None).cast("string")
            text = False
            for m in reversed(used):
                fields = {f.name: f for f in m.dataType.fields}
                val = state_member(n, obj[m.name][n], fields[n].dataType) if n in fields else F.lit(None).cast("string")
                text = text or (n in fields and has_text(fields[n].dataType))
                expr = F.when(obj[m.name].isNotNull(), val).otherwise(expr)
            out.append((n, expr, text))
        return df, out
    if isinstance(dt, T.StructType):
        return df, [(f.name, state_member(f.name, obj[f.name], f.dataType), has_text(f.dataType)) for f in dt.fields]
    return df, []


def _first_relation(df: DataFrame) -> tuple[Column, Column]:
    none = F.lit(None).cast("string")
    if "relations" not in df.columns:
        return none, none
    dt = df.schema["relations"].dataType
    if not isinstance(dt, T.ArrayType) or not isinstance(dt.elementType, T.StructType):
        return none, none
    first = F.get(F.col("relations"), F.lit(0))
    fields = {f.name: f.dataType for f in dt.elementType.fields}
    dst_id = scalarize(first["dst_id"], fields["dst_id"]) if "dst_id" in fields else none
    dst_name = scalarize(first["dst_name"], fields["dst_name"]) if "dst_name" in fields else none
    return dst_id, dst_name


def flatten_entity(envelope: DataFrame, entity_name: str | None = None, decode: bool = True,
                   members: dict[str, list[str] | T.StructType] | None = None) -> DataFrame:
    """Flatten one entity type (``entity_name``) or an already filtered frame.

    ``members`` (from ``union_members``) saves the metadata job of a union or JSON payload.
    """
    df = envelope if entity_name is None else envelope.where(F.col("name") == entity_name)
    label = entity_name
    df, fields = _record_fields(df, members.get(entity_name, []) if members is not None and entity_name is not None else None)
    if label is None:
        row = df.select("name").limit(1).collect()
        label = row[0]["name"] if row else "entity"
    # the record's own "name" becomes "<entity>_name" and moves to the end of the record
    renamed = [(n, c, t) for n, c, t in fields if n != NAME_FIELD]
    renamed += [(f"{label}_{NAME_FIELD}", c, t) for n, c, t in fields if n == NAME_FIELD]
    dst_id, dst_name = _first_relation(df)
    rel_text = "relations" in df.columns and has_text(df.schema["relations"].dataType)
    cols = [("id", scalarize(F.col("id"), df.schema["id"].dataType), has_text(df.schema["id"].dataType)),
            ("name", F.col("name").cast("string"), True)] + renamed + \
        [("dst_id", dst_id, rel_text), ("dst_name", dst_name, rel_text)]
    seen, out = set(), []
    for n, c, text in cols:
        if n in seen:  # a record field that repeats an envelope column keeps the envelope value
            continue
        seen.add(n)
        out.append((clean_string(c) if (decode and text) else c).alias(n))
    return df.select(*out)


def flatten_summary(envelope: DataFrame) -> DataFrame:
    """Records per entity type."""
    return envelope.groupBy("name").agg(F.count(F.lit(1)).alias("n_records"))


def flatten_status(flat: DataFrame, entity_names: list[str]) -> str:
    """'Flattened N records for a, b' (one count job on the flattened frame)."""
    n = flat.agg(F.count(F.lit(1))).first()[0]
    return f"Flattened {n} records for {', '.join(entity_names)}"
