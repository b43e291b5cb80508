"""Text-and-data-mining reservation files: JSON groups per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitestance.functions import rows, text
from sitestance.operators import robots

# --- Fixed values: error texts -----------------------------------------------
NOT_AN_ARRAY = "JSON object is not an array"
NOT_PARSED = "JSON object cannot be parsed"
NOT_JSON = "invalid JSON"

GROUP_TYPE = "struct<location:string,tdm_reservation:int,tdm_policy:string>"


def _field(element: Column, name: str) -> Column:
    return F.try_variant_get(element, f"$.{name}", "variant")


def as_text(value: Column) -> Column:
    """Scalars as text, a null literal as ``null``, containers as nothing."""
    kind = F.schema_of_variant(value)
    container = F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY"))
    return (
        F.when(F.is_variant_null(value), F.lit("null"))
        .when(container, F.lit(""))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def as_int(value: Column) -> Column:
    """Numbers are cut, numeric text is read, true counts one, the rest zero."""
    kind = F.schema_of_variant(value)
    truth = F.try_variant_get(value, "$", "boolean").cast("int")
    written = F.btrim(F.try_variant_get(value, "$", "string"))
    number = F.when(
        written.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"),
        written.try_cast("double"),
    )
    towards_zero = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
    return F.coalesce(F.when(kind == "BOOLEAN", truth).otherwise(towards_zero.try_cast("int")), F.lit(0))


def profile(docs: DataFrame) -> DataFrame:
    """Adds ``groups``, ``error``, ``num_groups`` and ``groups_text`` per document."""
    admitted = robots.admit(docs)
    decoded = F.when(F.col("is_parsed"), text.decode_text(F.col("content")))
    staged = (
        admitted.withColumn("_text", decoded)
        .withColumn("_root", F.try_parse_json("_text"))
        .withColumn("_elements", F.try_variant_get("_root", "$", "array<variant>"))
    )
    broken = F.exists(
        "_elements",
        lambda x: _field(x, "location").isNull() | _field(x, "tdm-reservation").isNull(),
    )
    blank = text.control_trim(F.col("_text")) == ""
    error = (
        F.when(~F.col("is_parsed"), None)
        .when(F.col("_root").isNull() & ~blank, F.lit(NOT_JSON))
        .when(F.col("_elements").isNull(), F.lit(NOT_AN_ARRAY))
        .when(broken, F.lit(NOT_PARSED))
    )
    groups = F.transform(
        "_elements",
        lambda x: F.struct(
            as_text(_field(x, "location")).alias("location"),
            as_int(_field(x, "tdm-reservation")).alias("tdm_reservation"),
            F.when(_field(x, "tdm-policy").isNotNull(), as_text(_field(x, "tdm-policy"))).alias(
                "tdm_policy"
            ),
        ),
    )
    return (
        staged.withColumn("error", error)
        .withColumn("groups", F.when(F.col("error").isNull(), groups))
        .withColumns(
            {
                "num_groups": F.when(F.col("groups").isNotNull(), F.size("groups")),
                "groups_text": _rendered(F.col("groups")),
            }
        )
        .drop("_text", "_root", "_elements", "content")
    )


def _rendered(groups: Column) -> Column:
    """T4."""

    def one(g: Column) -> Column:
        return F.concat(
            F.lit("Group{location='"), g["location"],
            F.lit("', tdmReservation="), g["tdm_reservation"].cast("string"),
            F.coalesce(F.concat(F.lit(", tdmPolicy='"), g["tdm_policy"], F.lit("'")), F.lit("")),
            F.lit("}"),
        )

    return F.concat(F.lit("["), F.array_join(F.transform(groups, one), ", "), F.lit("]"))


def group_rows(profiles: DataFrame, *carry: str) -> DataFrame:
    """T5: one row per group."""
    return rows.numbered(profiles, list(carry), "groups", "pos", "g").select(
        *carry, "pos", "g.location", "g.tdm_reservation", "g.tdm_policy"
    )


def as_metadata(prefix: str = "tdmrep.") -> list[Column]:
    """The statistics as dotted name/value structs; NULL values are dropped by the caller."""
    fields = {
        "content-length": F.col("content_length"),
        "content-type": F.col("content_type"),
        "error": F.col("error"),
        "num-groups": F.col("num_groups"),
        "groups": F.col("groups_text"),
    }
    return [
        F.struct(
            F.lit(prefix + k).alias("key"),
            F.when(v.isNotNull(), F.array(v.cast("string"))).alias("value"),
        )
        for k, v in fields.items()
    ]
