"""What a contract is, from its specification entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import snake_case
from ..schemas import BUILT_IN_EVENTS


def classify_contracts(entries: DataFrame) -> DataFrame:
    """Per contract: type, wasm_hash, event names and how they were found.

    ``entries``: network, contract_id, executable_type (sac, wasm or another), wasm_hash, entry_kind (event or
    function), name, ordinal, readable.
    """

    def names(kind: str) -> Column:
        found = F.collect_list(F.when((F.col("entry_kind") == kind) & F.col("readable"), F.struct("ordinal", snake_case(F.col("name")).alias("name"))))
        return F.transform(F.array_sort(found), lambda x: x["name"])

    rows = entries.groupBy("network", "contract_id").agg(
        F.max("executable_type").alias("_exec"), F.max("wasm_hash").alias("wasm_hash"), names("event").alias("_events"), names("function").alias("_functions")
    )
    sac, wasm = F.col("_exec") == "sac", F.col("_exec") == "wasm"
    none = F.array().cast("array<string>")
    has_events, has_functions = wasm & (F.size("_events") > 0), wasm & (F.size("_functions") > 0)
    return rows.select(
        "network",
        "contract_id",
        F.when(sac, "sac").when(wasm, "wasm").otherwise("external").alias("type"),
        F.when(wasm, F.col("wasm_hash")).alias("wasm_hash"),
        F.when(sac, F.array(*[F.lit(e) for e in BUILT_IN_EVENTS])).when(has_events, F.col("_events")).when(has_functions, F.col("_functions")).otherwise(none).alias("events"),
        F.when(sac, "sac_builtin").when(has_events, "spec_events").when(has_functions, "function_names").otherwise("opaque").alias("method"),
    )


def default_kinds(rows: DataFrame) -> DataFrame:
    """``kinds`` of registrations that name none: events and state, and transfers for built-in asset contracts."""
    usual = F.array(F.lit("events"), F.lit("state"))
    own = F.when(F.col("type") == "sac", F.concat(usual, F.array(F.lit("transfers")))).otherwise(usual)
    return rows.withColumn("kinds", F.when(F.size(F.coalesce("kinds", F.array().cast("array<string>"))) > 0, F.col("kinds")).otherwise(own))
