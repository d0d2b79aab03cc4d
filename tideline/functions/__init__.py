"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def chain_order_id(ledger: Column, tx_index: Column, index: Column) -> Column:
    """Zero-padded id whose text order is chain order: ledger in the high 32 bits, transaction in the next 20."""
    place = F.shiftleft(ledger.cast("long"), 32) + F.shiftleft(tx_index.cast("long"), 12)
    return F.format_string("%019d-%010d", place, index)


def snake_case(name: Column) -> Column:
    """``NFTMinted`` becomes ``nft_minted``."""
    cut = r"(?s)(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})|(?<=.)(?=\p{Lu}\p{Ll})"
    return F.lower(F.regexp_replace(name, cut, "_"))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def muxed_id_text(v: Column) -> Column:
    """Text of a multiplexed id: numbers and strings as they are, bytes in hex, null for anything else."""
    return (
        F.when(v["t"].isin("u64", "string"), v["v"]).when(v["t"] == "bytes", F.lower(F.hex(F.unbase64(v["v"]))))
    )


def gap_id(network: Column, first: Column, last: Column) -> Column:
    return F.concat_ws(":", F.lit("gap"), network, first.cast("string"), last.cast("string"))
