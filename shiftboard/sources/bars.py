"""Hourly price bars from landed exchange payloads (one JSON text per response)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.calendar import ColumnLike, _c
from ..functions.labels import code_to_label

# How the exchange names some assets, and its payload layout.
SYMBOLS = {"BTC": "XBT"}
PAYLOAD = "error array<string>, result map<string,string>"
BAR = ("close_time", "open", "high", "low", "close", "vwap", "volume", "count")
NOT_A_PAIR = "last"


def pair_name(symbol: ColumnLike, quote: str = "USD", alias: Mapping[str, str] = SYMBOLS) -> Column:
    """Exchange pair for a symbol: ``btc`` with USD is ``XBTUSD``."""
    upper = {k.upper(): v for k, v in alias.items()}
    return F.concat(code_to_label(F.upper(_c(symbol)), upper), F.lit(quote))


NUMBERS = ("open", "high", "low", "close", "volume")


def ohlc_rows(d: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """All that payloads hold, each read once: ``(keep…, pair, close_time, numbers…, bar, reason)``.

    A row is a bar, or what gives none: a payload with an error or no pair, a list that cannot be read, a bar with an unreadable
    field.  Those have a ``reason``, and ``bar`` as landed.
    """
    parsed = d.withColumn("__p", F.from_json(F.col(json_col), PAYLOAD))
    pairs = F.map_filter(F.col("__p.result"), lambda k, _: k != NOT_A_PAIR)
    wrong_payload = (
        F.when(F.col("__p").isNull() | F.col("__p.result").isNull() & F.col("__p.error").isNull(), "unreadable")
        .when(F.size("__p.error") > 0, F.array_join("__p.error", "; "))
        .when(F.col("__pairs").isNull() | (F.size("__pairs") == 0), "no pair")
    )
    read = parsed.withColumn("__pairs", pairs).withColumn("__payload", wrong_payload)
    # a payload that is wrong stays as one row, and so does a list that cannot be read
    held = F.when(F.col("__payload").isNull(), F.col("__pairs"))
    per_pair = read.select(*keep, "__payload", F.explode_outer(held).alias("pair", "__bars"))
    lists = per_pair.withColumn("__list", F.from_json("__bars", "array<array<string>>"))
    bars = lists.select(*keep, "__payload", "pair", "__bars", F.col("__list").isNull().alias("__broken"), F.explode_outer("__list").alias("b"))
    field = {name: F.get("b", F.lit(i)) for i, name in enumerate(BAR)}
    typed = bars.withColumns(
        {"close_time": F.timestamp_seconds(field["close_time"].try_cast("bigint"))}
        | {n: field[n].try_cast("double") for n in NUMBERS}
    )
    unread = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in ("close_time", *NUMBERS)]))
    reason = F.coalesce(
        "__payload",
        F.when(F.col("__broken"), "unreadable bars"),
        F.when(F.size(unread) > 0, F.concat(F.lit("unreadable "), F.array_join(unread, ", "))),
    )
    there = F.col("b").isNotNull() | F.col("__broken")  # an empty list is no bar and no fault
    landed = F.coalesce(F.to_json("b"), F.col("__bars")).alias("bar")
    return typed.filter(there).withColumn("reason", reason).select(*keep, "pair", "close_time", *NUMBERS, landed, "reason")


def ohlc_ingest(d: DataFrame, json_col: str, keep: Sequence[str] = ()) -> DataFrame:
    """Typed bars ``(keep…, pair, close_time, open, high, low, close, volume)`` of good payloads.

    A bar with an unreadable field, and a list that cannot be read, go to ``ohlc_rejects`` and stop nothing.
    """
    return ohlc_rows(d, json_col, keep).filter(F.col("reason").isNull()).drop("bar", "reason")


def ohlc_rejects(d: DataFrame, json_col: str) -> DataFrame:
    """What gives no bar, with the reason: payloads with an error or no pair, unreadable lists and bars."""
    found = ohlc_rows(d, json_col, d.columns).filter(F.col("reason").isNotNull())
    return found.select(*d.columns, "pair", "bar", "reason")
