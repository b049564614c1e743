"""Broker symbol resolution, contract roll, symbol metadata, account snapshots and server offsets."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import (
    INDEX_NAMES, INDEX_PREFIX, OFFSET_MAX_SEC, OFFSET_MIN_SEC, OFFSET_TOLERANCE_SEC)
from tidemark.functions import price as P
from tidemark.operators.ordering import order_blocks, running_last


def resolve_symbols(bases: DataFrame, listed: DataFrame) -> DataFrame:
    """Best broker name per base: a name or stem (text before '.') equal to it, else any stem it begins.

    Among candidates: exact spelling, then shortest, then alphabetical. The prefix search is an equality on exploded
    prefixes of the short listed names, never a pairing of every base with every name. Bases without a match are omitted.
    """
    key = F.upper("base")
    names = listed.select("name", F.upper("name").alias("_up")).distinct()
    stems = names.withColumn("_stem", F.split_part("_up", F.lit("."), F.lit(1)))
    # a prefix equal to the whole name or stem is an equal match, others are begins-with matches
    prefixes = stems.select("name", "_up", "_stem", F.explode(F.array_distinct(F.concat(
        F.array("_up"), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_stem"))),
                                    lambda i: F.substring("_stem", F.lit(1), i))))).alias("_key"))
    matches = bases.select("base", key.alias("_key")).join(prefixes, "_key")
    equal = (F.col("_up") == F.col("_key")) | (F.col("_stem") == F.col("_key"))
    order = F.struct(~equal, F.col("_up") != F.col("_key"), F.length("name"), F.col("name"))
    return matches.groupBy("base").agg(F.min_by("name", order).alias("broker_name"))


def front_contract(quotes: DataFrame, now: Column, keys: Sequence[str] = ("broker",), names: Sequence[str] = INDEX_NAMES,
                   prefix: str = INDEX_PREFIX) -> DataFrame:
    """A live continuous index in priority order; else the nearest contract month not past; else the earliest; else the
    freshest quote. Only names quoting a positive bid count."""
    upper = F.upper("name")
    priority = F.create_map(*chain.from_iterable((F.lit(n.upper()), F.lit(i)) for i, n in enumerate(names)))[upper]
    month = P.contract_month(F.col("name"), now)
    current = F.year(now) * 100 + F.month(now)
    tier = (
        F.when(priority.isNotNull(), 0)
        .when(~upper.startswith(prefix.upper()), F.lit(None).cast("int"))
        .when(month >= current, 1).when(month.isNotNull(), 2).otherwise(3)
    )
    place = F.when(tier == 0, priority.cast("long")).when(tier == 3, -F.col("tick_time")).otherwise(month)
    live = quotes.where(F.col("bid") > 0).withColumn("_t", tier).withColumn("_o", place).where(F.col("_t").isNotNull())
    return live.groupBy(*keys).agg(
        F.min_by("name", F.struct("_t", "_o", "name")).alias("name"), F.min("_t").alias("tier"))


def symbol_metadata(symbols: DataFrame) -> DataFrame:
    """Digits, point, pip size, tick size/value and contract size; missing or zero fields take their defaults."""
    def or_default(c: str, default: Column) -> Column:
        return F.coalesce(F.when(F.col(c) != 0, F.col(c)), default)

    return symbols.select(
        "base", "digits", "point", P.pip_size(F.col("base"), F.col("digits"), F.col("point")).alias("pip_size"),
        or_default("trade_tick_size", F.col("point")).alias("trade_tick_size"),
        or_default("trade_tick_value", F.lit(0.0)).alias("trade_tick_value"),
        or_default("trade_contract_size", F.lit(0.0)).alias("trade_contract_size"))


def open_position_rows(positions: DataFrame) -> DataFrame:
    """Open tickets with side names, signed pips and R (a stop of 0 means none)."""
    side = F.when(F.col("side") == 0, "BUY").otherwise("SELL")
    move = P.trade_move(F.col("type"), F.col("price_open"), F.col("price_current"))
    return positions.withColumn("type", side).drop("side").select(
        "*", (move / P.pip_price(F.col("symbol"))).alias("pips"),
        P.position_r(F.col("type"), F.col("price_open"), F.col("price_current"), F.col("sl")).alias("r_open"))


def account_snapshot(accounts: DataFrame, positions: DataFrame, terminals: DataFrame) -> DataFrame:
    """Account rows with open count, floating result and the combined trade permission.

    Positions stay a table of their own (:func:`open_position_rows`): one account may hold any number of them, so they
    are summed here, which combines map-side, and never gathered into one row.
    """
    held = positions.groupBy("login").agg(
        F.count(F.lit(1)).alias("open_count"), F.sum(F.col("profit") + F.col("swap")).alias("floating"))
    joined = accounts.join(held, "login", "left").join(terminals, "login", "left")
    allowed = F.coalesce("account_allowed", F.lit(False)) & F.coalesce("terminal_allowed", F.lit(True))
    return joined.select(
        *[c for c in accounts.columns if c != "account_allowed"],
        F.coalesce("open_count", F.lit(0)).alias("open_count"), F.coalesce("floating", F.lit(0.0)).alias("floating"),
        allowed.alias("trade_allowed"))


def server_offsets(samples: DataFrame) -> DataFrame:
    """Whole-hour server offset after each sample of (server, tick_time, ingest_time), in seconds.

    A sample counts when it is within three minutes of a whole hour and in range. The first accepted value is adopted
    at once, a different one only when two accepted samples in a row show it; otherwise the last good value stands.
    """
    delta = F.col("tick_time") - F.col("ingest_time")
    hours = F.rint(delta / 3600.0) * 3600.0
    fresh = (F.abs(delta - hours) <= OFFSET_TOLERANCE_SEC) & hours.between(OFFSET_MIN_SEC, OFFSET_MAX_SEC)
    good = samples.where(F.col("tick_time") > 0).withColumn("_h", F.when(fresh, hours.cast("long")))
    accepted = good.where(F.col("_h").isNotNull())
    by_time = ["ingest_time"]
    blocked = order_blocks(accepted.select("server", "ingest_time", "_h"), "ingest_time")
    seen = running_last(blocked, ["server"], by_time, F.col("_h"), "_prev", inclusive=False)
    confirmed = F.when(F.col("_prev").isNull() | (F.col("_h") == F.col("_prev")), F.col("_h"))
    out = running_last(seen, ["server"], by_time, confirmed, "offset_sec")
    return out.select("server", "ingest_time", F.col("_h").alias("sample_offset"), "offset_sec")
