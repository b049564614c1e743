"""Observation payloads: JSON, SDMX CSV, two-column CSV, HTML tables and quote documents.

Every parser takes a table of landed bodies (any key columns plus ``body``) and returns dated rows per body. Bodies
without a usable row are found with :func:`rejected_bodies`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dims import HTML_ROW
from tidemark.functions.guards import to_double

OBSERVATIONS = "observations array<struct<date: string, value: string>>"
POSITIONING_FIELDS = {
    "report_date": "report_date_as_yyyy_mm_dd",
    "noncomm_long": "noncomm_positions_long_all",
    "noncomm_short": "noncomm_positions_short_all",
    "comm_long": "comm_positions_long_all",
    "comm_short": "comm_positions_short_all",
    "open_interest": "open_interest_all",
}
# commas inside double quotes do not separate fields
CSV_COMMA = ',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def _dated(rows: DataFrame, keys: Sequence[str], day: Column, value: Column) -> DataFrame:
    return rows.select(*keys, day.alias("obs_date"), value.alias("value")).where(
        F.col("obs_date").isNotNull() & F.col("value").isNotNull())


def parse_observation_json(bodies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``{"observations": [{"date", "value"}]}``; "." marks a missing value."""
    rows = bodies.select(*keys, F.explode(F.from_json("body", OBSERVATIONS)["observations"]).alias("o"))
    return _dated(rows, keys, F.substring("o.date", 1, 10).try_cast("date"), to_double(F.col("o.value")))


def _lines(bodies: DataFrame, keys: Sequence[str]) -> DataFrame:
    text = F.replace(F.trim("body"), F.lit("\r"), F.lit(""))
    return bodies.select(*keys, F.split(text, "\n").alias("_lines"))


def parse_sdmx_csv(bodies: DataFrame, keys: Sequence[str], day: str = "TIME_PERIOD", value: str = "OBS_VALUE") -> DataFrame:
    """Columns are found by header name, so their order may change; blank values are dropped."""
    split = _lines(bodies, keys).select(
        *keys, F.split(F.col("_lines")[0], CSV_COMMA).alias("_head"), F.explode("_lines").alias("_line"))
    at = {c: F.array_position("_head", c).cast("int") for c in (day, value)}
    cells = split.select(*keys, at[day].alias("_d"), at[value].alias("_v"), F.split("_line", CSV_COMMA, -1).alias("_cells"))
    cells = cells.where((F.col("_d") > 0) & (F.col("_v") > 0))
    return _dated(cells, keys, F.substring(F.try_element_at("_cells", F.col("_d")), 1, 10).try_cast("date"),
                  to_double(F.try_element_at("_cells", F.col("_v"))))


def parse_rate_csv(bodies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``DATE,<series>`` with dates like ``02 Jan 2020`` (ISO accepted); headers and rows without a value are skipped.

    ``raw_date`` is the date as it was written; where it has another format, ``obs_date`` is null and the row stays.
    """
    rows = _lines(bodies, keys).select(*keys, F.explode("_lines").alias("_line"))
    cells = rows.select(*keys, F.split("_line", ",").alias("_c"))
    raw = F.trim(F.try_element_at("_c", F.lit(1)))
    day = F.coalesce(F.try_to_timestamp(raw, F.lit("dd MMM yyyy")).cast("date"), raw.try_cast("date"))
    value = to_double(F.try_element_at("_c", F.lit(2)))
    return cells.select(*keys, day.alias("obs_date"), value.alias("value"), raw.alias("raw_date")).where(
        F.col("value").isNotNull() & (F.col("raw_date") != ""))


def parse_rate_html(bodies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Table rows ``YYYY/MM/DD</th><td>value``; NA rows are skipped. Matching runs over the whole page."""
    zipped = F.arrays_zip(F.regexp_extract_all("body", F.lit(HTML_ROW), F.lit(1)).alias("d"),
                          F.regexp_extract_all("body", F.lit(HTML_ROW), F.lit(2)).alias("v"))
    rows = bodies.select(*keys, F.explode(zipped).alias("m"))
    return _dated(rows, keys, F.replace(F.col("m.d"), F.lit("/"), F.lit("-")).try_cast("date"), F.col("m.v").try_cast("double"))


def parse_quotes(bodies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Live price and previous close of a nested quote document; the previous close falls back twice."""
    meta = F.from_json("body", "chart struct<result: array<struct<meta: struct<regularMarketPrice: double, "
                               "chartPreviousClose: double, previousClose: double>>>>")["chart"]["result"]
    first = F.get(meta, F.lit(0))["meta"]
    rows = bodies.select(*keys, first["regularMarketPrice"].alias("live"),
                         F.coalesce(first["chartPreviousClose"], first["previousClose"], first["regularMarketPrice"]).alias("prev"))
    return rows.where(F.col("live").isNotNull())


def parse_release_dates(bodies: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``{"release_dates": [{"date"}]}`` -> distinct non-blank dates."""
    rows = bodies.select(*keys, F.explode(F.from_json("body", "release_dates array<struct<date: string>>")["release_dates"]).alias("r"))
    return rows.select(*keys, F.col("r.date").alias("day")).where("day IS NOT NULL AND day <> ''").distinct()


def parse_positioning(bodies: DataFrame, market: str | None = None) -> DataFrame:
    """Weekly report rows with delivered text fields renamed; one market is matched exactly."""
    fields = ", ".join(f"{f}: string" for f in ["market_and_exchange_names", *POSITIONING_FIELDS.values()])
    rows = bodies.select(F.explode(F.from_json("body", f"array<struct<{fields}>>")).alias("r"))
    out = rows.select(F.col("r.market_and_exchange_names").alias("market"),
                      *[F.col(f"r.{src}").alias(name) for name, src in POSITIONING_FIELDS.items()])
    return out if market is None else out.where(F.col("market") == market)


def rejected_bodies(bodies: DataFrame, parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bodies that gave no usable row, for quarantine."""
    return bodies.join(parsed.select(*keys).distinct(), list(keys), "left_anti")
