"""Event titles, categories, filters and link checks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import dims
from tidemark.functions.guards import compact_number


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def impact_allowed(impact: Column, allowed: Iterable[str] = dims.IMPACT_ALLOWED) -> Column:
    return F.lower(F.trim(impact)).isin(*[a.lower() for a in allowed])


def currency_allowed(currency: Column, allowed: Iterable[str] = dims.FIAT_CURRENCIES) -> Column:
    return F.upper(F.trim(currency)).isin(*[a.upper() for a in allowed])


def title_allowed(title: Column, keywords: Sequence[str] = dims.EVENT_KEYWORDS) -> Column:
    """Any keyword as a substring; an empty set lets everything through."""
    return contains_any(title, keywords) if keywords else F.lit(True)


def category(title: Column) -> Column:
    return (
        F.when(contains_any(title, dims.CATEGORY_EMPLOYMENT), "emp")
        .when(contains_any(title, dims.CATEGORY_RATE), "rate").otherwise("oth")
    )


def localised_title(title: Column, currency: Column) -> Column:
    by_bank = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in dims.TITLE_RATE_BY_CURRENCY.items()))
    return (
        F.when(contains_any(title, ("adp",)), dims.TITLE_ADP)
        .when(contains_any(title, ("non-farm", "nonfarm", "payroll")), dims.TITLE_PAYROLL)
        .when(contains_any(title, ("unemployment", "jobless", "claimant")), dims.TITLE_UNEMPLOYMENT)
        .when(contains_any(title, ("press conference",)), dims.TITLE_PRESS)
        .when(contains_any(title, dims.TITLE_RATE_KEYWORDS), F.coalesce(by_bank[currency], F.lit(dims.TITLE_RATE_DEFAULT)))
        .otherwise(title)
    )


def importance_label(level: Column) -> Column:
    return F.when(level == 3, "High").when(level == 2, "Medium").otherwise("Low")


def value_text(value: Column) -> Column:
    return compact_number(value)


def source_link(url: Column, hosts: Sequence[str] = dims.SOURCE_HOSTS) -> Column:
    """The link when it is https and points at a listed host, else ''."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.when(F.lower(url).startswith("https://") & host.isin(*hosts), url).otherwise(F.lit(""))


def displayed_currencies(symbol: Column) -> Column:
    """Currencies a symbol puts on the calendar: the quote of gold, both legs of a six-letter pair."""
    return (
        F.when(symbol.startswith("XAU"), F.array(F.substr(symbol, F.lit(4))))
        .when(F.length(symbol) == 6, F.array(F.substring(symbol, 1, 3), F.substring(symbol, 4, 3)))
        .otherwise(F.array().cast("array<string>"))
    )


def looks_like_feed(body: Column) -> Column:
    """An event document, not the web page a throttled server answers with."""
    return F.contains(F.lower(F.coalesce(body, F.lit(""))), F.lit("<weeklyevents"))
