"""Quality rules of documents and of their hosts, in DataFrame functions only.

Per document: word, symbol, line and repetition counts and the base rules.
Per host: the failures of its documents, shrunk towards the rate of all hosts
with a beta prior fitted to the hosts' rates (method of moments).  A host whose
shrunk failure rate is over ``host_rate`` loses all its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import SPACE, named, stored

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
HOST_RATE = 0.5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def _pairs(hashes: str, step: int):
    """Hash of each window from the hashes of its two halves, ``step`` apart."""
    n = F.size(hashes) - step
    ahead = F.when(n > 0, F.slice(hashes, step + 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    kept = F.when(n > 0, F.slice(hashes, 1, F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<bigint>"))
    return F.zip_with(kept, ahead, lambda a, b: F.xxhash64(a, b))


def measured(docs: DataFrame, text_col: str = "text", lines: bool = True) -> DataFrame:
    """``docs`` plus __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.  The windows of a
    text are first compared by hash; only a text with equal hashes compares the
    windows themselves, so the count is exact.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("__words", F.array_remove(F.split(text, f"[{SPACE}]+"), ""))
    out = out.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        out = out.withColumn("__h", _pairs("__h", step))
    out = out.withColumn("__repeats", F.size(F.array_distinct("__h")) < F.size("__h"))
    n = F.size("__words")
    # For texts with a repeat: windows with their places, sorted, so equal ones are neighbours.
    windows = F.transform(
        F.arrays_zip(*[F.slice("__words", k + 1, F.greatest(n - REPEAT_WINDOW + 1, F.lit(1))).alias(f"w{k}") for k in range(REPEAT_WINDOW)]),
        lambda w, i: F.struct(F.concat_ws(" ", *[w[f"w{k}"] for k in range(REPEAT_WINDOW)]).alias("w"), i.alias("at")),
    )
    none = F.array().cast("array<struct<w:string,at:int>>")
    out = out.withColumn("__s", F.when(F.col("__repeats"), F.sort_array(windows)).otherwise(none))
    m = F.size("__s")
    later = F.concat(F.slice("__s", 2, F.greatest(m - 1, F.lit(1))), F.array(F.lit(None).cast("struct<w:string,at:int>")))
    out = out.withColumn("__same", F.when(m > 1, F.zip_with("__s", later, lambda a, b: F.coalesce(a.w == b.w, F.lit(False)))))
    # place of a window that equals its neighbour on either side, else null
    places = F.zip_with(
        F.zip_with("__same", F.concat(F.array(F.lit(False)), F.slice("__same", 1, F.greatest(m - 1, F.lit(1)))), lambda a, b: a | b),
        "__s", lambda f, s: F.when(f, s["at"]),
    )
    out = out.withColumn("__at", F.sort_array(F.array_compact(F.coalesce(F.when(m > 1, places), F.array().cast("array<int>")))))
    covered = F.aggregate(
        "__at", F.struct(F.lit(0).alias("sum"), F.lit(-REPEAT_WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["sum"] + F.least(F.lit(REPEAT_WINDOW), p - acc["last"])).alias("sum"), p.alias("last")),
        lambda acc: acc["sum"],
    )
    new = {"__n_words": n.cast("long"), "__n_repeat_words": covered.cast("long")}
    if lines:
        filled = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
        new["__word_chars"] = F.length(F.translate(text, BLANKS, "")).cast("long")
        new["__n_symbols"] = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
        out = out.withColumn("__lines", filled)
        new["__n_dup_lines"] = (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")
    return out.withColumns(new).drop("__words", "__h", "__repeats", "__s", "__same", "__at", "__lines")


def base_failed():
    return (F.col("__n_words") < MIN_WORDS) | (100 * F.col("__n_repeat_words") > REPEAT_PERCENT * F.col("__n_words"))


def host_verdicts(rows: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """(__host, docs, failures, rate, rejected) from rows with __host and __failed; a null host is a host.

    The beta prior has the failure rate of all documents as its mean.  Its strength comes from the
    spread of the hosts' rates beyond what chance gives hosts of their sizes (beta-binomial moments,
    weighted by size).  Where there is no such spread, or no host has two documents, the prior weighs as
    much as an infinite sample: every host gets the common rate.
    """
    hosts = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("__failed").cast("long")).alias("failures"))
    x, n = F.col("failures").cast("double"), F.col("docs").cast("double")
    sums = hosts.agg(
        F.sum(n).alias("n"), F.sum(x).alias("x"), F.sum(x * x / n).alias("s"), F.sum(n * n).alias("nn"), (F.count(F.lit(1)) - 1).alias("k")
    ).withColumn("m", F.col("x") / F.col("n"))
    chance = F.col("m") * (1 - F.col("m"))
    spread = F.try_divide(F.col("s") - F.col("n") * F.col("m") * F.col("m"), chance) - F.col("k")
    # the share of the variance that lies between hosts; null without any
    between = F.try_divide(spread, F.greatest(F.col("n") - F.col("nn") / F.col("n") - F.col("k"), F.lit(0.0)))
    prior = sums.select("m", F.when(between > 0, F.least(between, F.lit(1.0))).alias("between"))
    strength = 1 / F.col("between") - 1
    rate = F.coalesce((F.col("failures") + strength * F.col("m")) / (F.col("docs") + strength), F.col("m"))
    # the prior is one row
    return hosts.crossJoin(F.broadcast(prior)).select("__host", "docs", "failures", rate.alias("rate"), (rate > host_rate).alias("rejected"))


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE
) -> DataFrame:
    """One row per input row: id, the counts, ``base_failed``, ``host_rate`` and ``kept``.

    ``kept`` is false if the document fails a base rule or its host is rejected.
    Repeated rows count each; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("__host"), F.col(text_col).alias("__text"))
    rows = stored(measured(rows, "__text").withColumn("__failed", base_failed()).drop("__text"))
    hosts = host_verdicts(rows, host_rate).withColumnRenamed("__host", "h")
    # Narrow rows; adaptive execution broadcasts the hosts only if small, and splits a hot host.
    out = rows.join(hosts, F.col("__host").eqNullSafe(F.col("h")), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(
        "id", *[F.col(f"__{c}").alias(c) for c in counts], F.col("__failed").alias("base_failed"),
        (~F.col("__failed") & ~F.col("rejected")).alias("kept"), F.col("rate").alias("host_rate"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns unchanged.

    The rules are computed in two scans of the documents, one for the hosts and
    one for the rows, so no text is shuffled.
    """
    failed = measured(docs.select(F.col(host_col).alias("__host"), F.col(text_col).alias("__text")), "__text", lines=False)
    hosts = stored(host_verdicts(failed.select("__host", base_failed().alias("__failed")), host_rate).where("rejected").select(F.col("__host").alias("__bad")))
    # A filter would be pushed through the projections above, and each of its references
    # would then repeat their whole expressions; exploding no element drops a row in place.
    # The caller's columns travel in one, so none of them can clash with a measure.
    whole = F.struct(*[named(c) for c in docs.columns]).alias("__doc")
    rows = measured(docs.select(whole, F.col(host_col).alias("__host"), F.col(text_col).alias("__t")), "__t", lines=False)
    rows = rows.withColumn("__ok", F.explode(F.when(~base_failed(), F.array(F.lit(1)))))
    return rows.join(hosts, F.col("__host").eqNullSafe(F.col("__bad")), "left_anti").select("__doc.*")
