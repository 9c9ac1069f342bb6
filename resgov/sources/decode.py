"""Decode warehouse-style results (manifest + string matrix) to typed rows.

Each result row is exploded with its position; fields are fetched by their
name in that result's own manifest, so results whose column order differs
decode alike.  BOOLEAN follows ``lower(v) = 'true'``; other types use a
``try_cast`` to the declared type (bad values become null, rows survive).

``decode_result`` takes the types a caller declares.  ``decode_variants`` takes
them from each result's own manifest (``type_name``) and gives a row as one
VARIANT object, so results whose types differ fit one table and no schema is
declared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T


def decode_result(raw: DataFrame, schema: T.StructType, keep=("result_id",)) -> DataFrame:
    names = F.transform("columns", lambda c: c["name"])
    exploded = raw.select(*keep, names.alias("_names"),
                          F.posexplode("data_array").alias("row_pos", "_row"))
    out = []
    for field in schema.fields:
        # of columns with one name the last counts; a row too short for its manifest has nulls
        behind = F.array_position(F.reverse("_names"), field.name).cast("int")
        value = F.when(behind > 0, F.try_element_at(F.col("_row"), F.size("_names") - behind + 1))
        if isinstance(field.dataType, T.BooleanType):
            typed = F.lower(value) == "true"
        elif isinstance(field.dataType, T.StringType):
            typed = value
        else:
            typed = value.try_cast(field.dataType)
        out.append(typed.alias(field.name))
    return exploded.select(*keep, "row_pos", *out)


# The type names of a result's manifest.
WHOLE = ("BYTE", "SHORT", "INT", "LONG")
FLOATING = ("FLOAT", "DOUBLE")
NESTED = ("ARRAY", "MAP", "STRUCT")


def variant_value(type_name: Column, value: Column) -> Column:
    """A cell's text as a VARIANT of its manifest type; a bad value is null, an unknown type stays text."""
    kind = F.upper(type_name)
    return (F.when(kind.isin(*WHOLE), value.try_cast("bigint").cast("variant"))
            .when(kind.isin(*FLOATING), value.try_cast("double").cast("variant"))
            .when(kind == "BOOLEAN", (F.lower(value) == "true").cast("variant"))
            .when(kind == "DECIMAL", value.try_cast("decimal(38,10)").cast("variant"))
            .when(kind == "DATE", value.try_cast("date").cast("variant"))
            .when(kind.startswith("TIMESTAMP"), value.try_cast("timestamp_ntz").cast("variant"))
            .when(kind.isin(*NESTED), F.try_parse_json(value))
            .otherwise(value.cast("variant")))


def decode_variants(raw: DataFrame, keep=("result_id",)) -> DataFrame:
    """keep, row_pos and ``row``: a VARIANT object of the manifest's names and types.

    Of columns with one name the last counts, one without a name is left out; a row too short for its manifest has nulls.
    """
    columns = F.transform("columns", lambda c, i: F.named_struct(F.lit("name"), c["name"], F.lit("type_name"), c["type_name"], F.lit("at"), i))
    later = lambda c, i: F.exists(F.slice("columns", i + 2, F.size("columns")), lambda o: o["name"] == c["name"])
    named = F.filter(columns, lambda c, i: c["name"].isNotNull() & ~F.coalesce(later(c, i), F.lit(False)))
    exploded = raw.select(*keep, named.alias("_columns"), F.posexplode("data_array").alias("row_pos", "_row"))
    cells = F.transform("_columns", lambda c: F.struct(c["name"].alias("key"), variant_value(c["type_name"], F.get("_row", c["at"])).alias("value")))
    return exploded.select(*keep, "row_pos", F.to_variant_object(F.map_from_entries(cells)).alias("row"))


def typed(rows: DataFrame, schema: T.StructType, row: str = "row", keep=("result_id",)) -> DataFrame:
    """Columns read out of the VARIANT rows; a field that is missing or does not fit its type is null."""
    def path(name: str) -> str:
        quote = '"' if "'" in name else "'"
        return f"$[{quote}{name}{quote}]"

    return rows.select(*keep, *[F.try_variant_get(row, path(f.name), f.dataType.simpleString()).alias(f.name) for f in schema.fields])


def result_schemas(rows: DataFrame, by=("result_id",), row: str = "row") -> DataFrame:
    """The merged schema of the VARIANT rows of each group, as Spark writes it."""
    return rows.groupBy(*by).agg(F.schema_of_variant_agg(row).alias("row_schema"), F.count(F.lit(1)).alias("n_rows"))


def type_clashes(raw: DataFrame) -> DataFrame:
    """Columns to which results give different types: name and the types, from the manifests alone."""
    listed = raw.select(F.explode("columns").alias("c")).select("c.name", F.upper("c.type_name").alias("type_name")).distinct()
    return (listed.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("type_name")), ",").alias("types"), F.count(F.lit(1)).alias("n_types"))
            .filter(F.col("n_types") > 1))
