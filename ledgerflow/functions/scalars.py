"""Column functions shared by the operators. All of them stay inside codegen."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerflow.constants import BLOCK_SECONDS, BLOCKS_PER_DAY, SATOSHI

# A satoshi amount: exact to sum in any order, no overflow on the whole chain.
MONEY = "decimal(20,0)"

# Leading number of a text, the rest ignored.
_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"

# Display names of the party types.
PARTY_LABELS = {
    "node_operator": "Node Operator",
    "node": "Node Operator",
    "exchange": "Exchange",
    "foundation": "Foundation",
    "unknown": "Unknown Wallet",
}


def leading_number(text: Column) -> Column:
    """The number a text starts with, as a double; null when there is none."""
    return F.regexp_extract(text.cast("string"), _LEADING_NUMBER, 1).try_cast("double")


def satoshi(text: Column) -> Column:
    """Satoshi from number or text; null when unreadable."""
    exact = text.try_cast(MONEY)
    return F.coalesce(exact, leading_number(text).try_cast(MONEY))


def satoshi_or_zero(text: Column) -> Column:
    return F.coalesce(satoshi(text), F.lit(0).cast(MONEY))


def coins(amount: Column) -> Column:
    """Satoshi to coins as a double, to be applied after summing."""
    return amount.cast("double") / F.lit(float(SATOSHI))


def first_nonzero(*candidates: Column) -> Column:
    """First argument that is neither null nor zero."""
    return F.coalesce(*[F.nullif(c, F.lit(0)) for c in candidates])


def array_length(arr: Column) -> Column:
    """Length of an array, null (not -1) for a null array."""
    return F.when(arr.isNotNull(), F.size(arr))


def days_of_blocks(blocks: Column) -> Column:
    """Whole days in a number of blocks."""
    return F.floor(blocks / F.lit(BLOCKS_PER_DAY)).cast("long")


def blocks_to_time(blocks: Column) -> Column:
    """Text such as ``3d 4h``, ``4h 5m`` or ``6m``."""
    seconds = blocks * F.lit(BLOCK_SECONDS)
    days = F.floor(seconds / F.lit(86400)).cast("long").cast("string")
    hours = F.floor(seconds % F.lit(86400) / F.lit(3600)).cast("long").cast("string")
    minutes = F.floor(seconds % F.lit(3600) / F.lit(60)).cast("long").cast("string")
    return (
        F.when(seconds >= 86400, F.concat(days, F.lit("d "), hours, F.lit("h")))
        .when(seconds >= 3600, F.concat(hours, F.lit("h "), minutes, F.lit("m")))
        .otherwise(F.concat(minutes, F.lit("m")))
    )


def time_to_blocks(hours: Column) -> Column:
    """Whole blocks in a number of hours."""
    return F.floor(hours * F.lit(3600) / F.lit(BLOCK_SECONDS)).cast("long")


def format_bytes(size: Column) -> Column:
    """Size text: plain bytes, else KB, MB or GB with two decimals."""

    def scaled(power: int, unit: str) -> Column:
        return F.concat(F.format_string("%.2f", size / F.lit(float(1024**power))), F.lit(unit))

    return (
        F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
        .when(size < 1024**2, scaled(1, " KB"))
        .when(size < 1024**3, scaled(2, " MB"))
        .otherwise(scaled(3, " GB"))
    )


def shorten(text: Column) -> Column:
    """First 8 and last 6 characters; empty text for null or empty input."""
    return F.when(
        F.length(text) > 0,
        F.concat(
            F.substring(text, 1, 8),
            F.lit("..."),
            F.substring(text, F.greatest(F.length(text) - F.lit(5), F.lit(1)), F.lit(6)),
        ),
    ).otherwise(F.lit(""))


def party_label(party_type: Column) -> Column:
    """Display name of a party type; unknown codes show as they are."""
    labels = F.create_map(*[F.lit(x) for x in chain.from_iterable(PARTY_LABELS.items())])
    return F.coalesce(F.try_element_at(labels, party_type), party_type)
