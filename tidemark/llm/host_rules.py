"""Quality rules per document and per host, in DataFrame functions only.

Each document is measured in its own row. A host's failure rate is shrunk with a beta prior whose two parameters are matched to the mean
and the variance of all hosts' rates: (failed + alpha) / (documents + alpha + beta). Hosts with few documents stay near the common rate.
A document is kept if it passes its own rules and its host's shrunk rate is not over `most`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACES, staged

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: A host fails if more than every second of its documents is expected to fail.
MOST_FAILING = 0.5
#: Prior documents of a host: at least, and where hosts differ by no more than chance.
LEAST_STRENGTH = 1.0
MOST_STRENGTH = 1000.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`, also inside lambdas, where the optimiser might repeat it per element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text: runs without space or the controls tab to carriage return. Null and blank texts have none."""
    bare = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(bare) > 0, F.split(bare, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def repeated_words(ws: Column, width: int = WINDOW) -> Column:
    """Words that lie in a window of `width` words found twice or more; sorting the windows' hashes keeps it linear but for the sort."""
    n = F.size(ws)

    def covered(starts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda acc, s: F.struct((acc["n"] + s + width - F.greatest(s, acc["end"])).alias("n"), (s + width).alias("end"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def starts(pairs: Column) -> Column:
        twice = lambda p, k: (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(pairs, lambda p, k: F.coalesce(twice(p, k), F.lit(False))), lambda p: p["i"]))

    def count(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(let(pairs, starts)))

    at = F.sequence(F.lit(1), n - width + 1)
    hashes = let(ws, lambda bound: F.transform(at, lambda i: F.xxhash64(F.slice(bound, i, width))))
    return F.when(n < 2, F.lit(0)).when(n <= width, F.lit(0)).otherwise(let(hashes, count)).cast("bigint")


def repeated_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of `docs`, with the measures and base_failed. Null texts have no words and fail; columns of these names are replaced."""
    t = F.col(text)
    bare = F.coalesce(t, F.lit(""))
    cut = docs.withColumn("_words", words(t))
    measured = cut.withColumns({
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": (F.length(bare) - F.length(F.translate(bare, SYMBOLS, ""))).cast("bigint"),
        "n_dup_lines": repeated_lines(t),
        "n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words")
    short = F.col("n_words") < LEAST_WORDS
    return measured.withColumn("base_failed", short | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")))


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """One row per host, null being one: documents, failed ones, and the shrunk rate. An empty table gives none.

    Mean and variance of a beta-binomial are matched over all documents: of the rates' variance, weighted by documents, only what exceeds the
    binomial noise of hosts of these sizes counts as difference between hosts. So hosts of a document or two stay near the common rate.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("docs"), F.sum(F.col("base_failed").cast("bigint")).alias("failed"))
    total = hosts.agg(F.sum("docs").cast("double").alias("n"), F.sum("failed").cast("double").alias("x"), F.count("*").alias("k"),
                      F.sum(F.col("docs") * F.col("docs")).cast("double").alias("n2"), F.sum(F.col("failed") * F.col("failed") / F.col("docs")).alias("x2"))
    # what the rates of hosts of these sizes vary by if all share one rate, and how much room is left for hosts that differ
    mean = F.col("x") / F.col("n")
    noise = mean * (1 - mean) * (F.col("k") - 1)
    over = F.col("x2") - F.col("x") * mean - noise
    room = mean * (1 - mean) * (F.col("n") - F.col("n2") / F.col("n")) - noise
    matched = F.when((over > 0) & (room > 0), F.greatest(room / over - 1, F.lit(LEAST_STRENGTH)))
    prior = total.select(mean.alias("mean"), F.least(F.coalesce(matched, F.lit(MOST_STRENGTH)), F.lit(MOST_STRENGTH)).alias("strength"))
    shrunk = (F.col("failed") + F.col("mean") * F.col("strength")) / (F.col("docs") + F.col("strength"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "docs", "failed", shrunk.alias("host_rate"))  # prior: one row


def judged_by_host(docs: DataFrame, text: str = "text", host: str = "source", most: float = MOST_FAILING, keep_text: bool = False) -> DataFrame:
    """All columns of `docs` (the text only with `keep_text`) with measures, base_failed, host_rate and kept.

    The measures are written once to the shared folder, and the hosts' counts are read from there. The rates are written too, so that their
    join is planned by their size: texts are dealt by host only where hosts are too many to be sent to every task. Rows and repeated rows are all kept in
    place, with their verdict. A null host is a host of its own. Columns of the added names are replaced.
    """
    fresh = docs.drop("_words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "_host", "host_rate", "kept")
    measured = base_rules(fresh, text)
    judged = staged(measured if keep_text else measured.drop(text), "rules", dense=True)
    hosts = staged(host_rates(judged, host).select(F.col("host").alias("_host"), "host_rate"), "host-rates")
    joined = judged.join(hosts, judged[host].eqNullSafe(hosts["_host"]), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= most))
