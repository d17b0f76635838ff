"""Operator 8, URL filter: explicit rules first, then the ratio of two character language models.

URLs that a rule accepts or rejects train one variable-order Markov model each: counts of every context of up to ORDER characters over all
such URLs, interpolated by Witten-Bell smoothing. The verdict of other URLs is their log-likelihood difference per character against a
threshold calibrated on the ruled URLs. Counts and probabilities are Spark tables, nothing of them is cut or collected: a character's
probabilities depend only on its window (the character and the ORDER before it), so they are computed once per distinct window, and batches
of URLs fetch each of their windows once, which also keeps windows that every URL has from gathering in one task.
"""

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendloom.llm.graph import stored

ORDER = 5
BATCH_CHARACTERS = 1 << 17
BINS = 200
START = "\x02"
#: Verdict, host, path of the production rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host with A-Z lower-cased and path of a URL column; both empty for null and for text without ://."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(text, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def longest_rule(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host, or a subdomain of it, and path start fit; ties in text order; null without one."""
    text = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        text = F.when(fits, h + p) if text is None else text.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (F.lit(None).cast("string"), F.lit(None).cast("string")) if text is None else (text, verdict)


def batch_windows(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(batch, w, accepted, rejected): every window of a batch's URLs once, with its occurrences in ruled URLs by verdict."""
    line = F.concat(F.lit(START * order), F.col("host"), F.col("path"))
    at = F.sequence(F.lit(order + 1), F.length(line))
    some = urls.where(F.length(F.concat("host", "path")) > 0).select("batch", "host", "path", "ruling").repartition("batch")
    windows = some.select("batch", "ruling", F.explode(F.transform(at, lambda i: F.substring(line, i - order, F.lit(order + 1)))).alias("w"))
    ruled = lambda kind: F.sum(F.coalesce((F.col("ruling") == kind).cast("long"), F.lit(0)))
    return windows.groupBy("batch", "w").agg(ruled("allow").alias("good"), ruled("block").alias("bad"))


def window_models(full: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, p_good, p_bad) per row of `full` (distinct w, good, bad): probability of the last character under both models.

    From the shortest context to the longest, each gram takes its suffix's probabilities on; a context never seen changes nothing. Rows of
    one context or suffix differ in one character, so no group exceeds the alphabet.
    """
    lower = None
    for k in range(order + 1):
        grams = full.groupBy(F.expr(f"substring(w, {order} + 1 - {k}, {k} + 1)").alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
        context = Window.partitionBy(F.expr(f"substring(gram, 1, {k})"))
        for c in ("good", "bad"):
            grams = grams.withColumns({f"{c}_seen": F.sum(c).over(context), f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(context)})
        if lower is None:
            grams = grams.withColumns({"below_good": F.lit(1 / 256), "below_bad": F.lit(1 / 256)})
        else:
            grams = grams.join(lower, F.expr("substring(gram, 2)") == F.col("suffix"))
        mixed = lambda c: F.when(
            F.col(f"{c}_seen") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"below_{c}")) / (F.col(f"{c}_seen") + F.col(f"{c}_kinds"))
        ).otherwise(F.col(f"below_{c}"))
        lower = grams.select(F.col("gram").alias("suffix"), mixed("good").alias("below_good"), mixed("bad").alias("below_bad"))
    return lower.toDF("w", "p_good", "p_bad")


def scored(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """`urls` (batch, host, path, ruling and others) with score: log-likelihood difference per character, accepted less rejected; 0 for no text."""
    pieces = stored(batch_windows(urls, order), "windows")
    full = stored(pieces.groupBy("w").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "grams")
    values = pieces.select("batch", "w").join(window_models(full, order), "w")

    def score(rows: pa.Table, windows: pa.Table) -> pa.Table:
        columns = (windows.column(c).to_pylist() for c in ("w", "p_good", "p_bad"))
        ratio = {w: math.log(good) - math.log(bad) for w, good, bad in zip(*columns)}
        out = []
        for host, path in zip(rows.column("host").to_pylist(), rows.column("path").to_pylist()):
            line, total = START * order + host + path, 0.0
            for i in range(order, len(line)):
                total += ratio[line[i - order : i + 1]]
            out.append(total / max(1, len(line) - order))
        return rows.append_column("score", pa.array(out, pa.float64()))

    schema = T.StructType([*urls.schema.fields, T.StructField("score", T.DoubleType())])
    return urls.groupBy("batch").cogroup(values.groupBy("batch")).applyInArrow(score, schema)


def calibrated(ruled: DataFrame, bins: int = BINS) -> float:
    """Threshold of least balanced error on the scored ruled URLs, from a histogram of 20 * bins cells; 0 without both verdicts."""
    cell = F.round(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), "score")) * bins).cast("int")
    rows = ruled.groupBy(cell.alias("cell")).agg(F.sum((F.col("ruling") == "allow").cast("long")), F.sum((F.col("ruling") == "block").cast("long"))).orderBy("cell").collect()
    good, bad = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not good or not bad:
        return 0.0
    best, lost, caught, where = 0.0, 0, 0, [(rows[0][0] - 0.5) / bins]
    for i, (c, g, b) in enumerate(rows):
        lost, caught = lost + g, caught + b
        gain = caught / bad - lost / good
        edge = (c + (rows[i + 1][0] if i + 1 < len(rows) else c + 1)) / 2 / bins
        if gain > best:
            best, where = gain, [edge]
    return where[0]


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = ORDER) -> DataFrame:
    """(id, host, path, rule, verdict, score) per input row; verdict is allow or block.

    The score is the length-normalised log-likelihood difference; empty and unreadable URLs score 0. Without ruled URLs of both kinds every
    unruled URL is judged against 0. Repeated rows are judged alike; other columns are left behind; an empty table gives an empty result.
    """
    host, path = host_and_path(url_col)
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("__row"))
    rule, ruling = longest_rule(rules, F.col("host"), F.col("path"))
    rows = stored(parsed.select("*", rule.alias("rule"), ruling.alias("ruling")), "urls")
    characters = rows.agg(F.sum(F.length("host") + F.length("path"))).first()[0] or 0
    batch = F.pmod(F.xxhash64("__row"), F.lit(1 + characters // BATCH_CHARACTERS)).alias("batch")
    judged = stored(scored(rows.select(batch, id_col, "host", "path", "rule", "ruling"), order), "scores")
    cut = calibrated(judged.where("ruling IS NOT NULL"))
    method = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select(id_col, "host", "path", "rule", F.coalesce("ruling", method).alias("verdict"), "score")
