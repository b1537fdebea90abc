"""Operator 1: quality by hierarchical empirical Bayes.

A document classifier over style features of the whole text gives each document's evidence.
Grouped aggregation sums it by host and by path within the host; a host's rate is shrunk toward the
global rate and a path's toward its host, with strengths estimated from the spread between
sites. A document's score combines its own evidence with the posterior of its path's other documents.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, pieces, texts

#: Names of the style features, in the order of ``style``.
STYLE = ("log_bytes", "upper", "digit", "space", "newline", "symbol", "stop", "comma", "other", "word_length", "distinct_words", "short_words", "long_words", "marked_words", "bar_words", "distinct_lines")


def byte_classes():
    """Class of each byte: 0 lower, 1 upper, 2 digit, 3 space, 4 newline, 5 symbol, 6 sentence end, 7 comma, 8 other."""
    import numpy as np

    out = np.full(256, 5, np.int64)
    out[128:] = 8
    for i in range(128):
        c = chr(i)
        out[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c == "\n" else 3 if c.isspace() else 6 if c in ".!?" else 7 if c in ",;:'\"()-" else 5
    return out


def style(raw: bytes, classes) -> list[float]:
    import numpy as np

    n = max(1, len(raw))
    counts = np.bincount(classes, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=9)
    words = raw.split()
    distinct = set(words)
    lines = raw.split(b"\n")
    m, d = max(1, len(words)), max(1, len(distinct))
    return [
        np.log1p(len(raw)), *(counts[1:9] / n), (len(raw) - counts[3] - counts[4]) / m / 10, d / m,
        sum(len(x) <= 3 for x in distinct) / d, sum(len(x) > 12 for x in distinct) / d,
        sum(not (x[-1:].isalnum() or x[-1] > 127 or x[-1:] in b".,") for x in distinct) / d, words.count(b"|") / m, len(set(lines)) / len(lines),
    ]


def style_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the style features of every whole text. No shuffle."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        classes = byte_classes()
        for batch in pieces(batches):
            rows = [style(t.as_py().encode(), classes) for t in batch.column(1)]
            flat = pa.array(np.array(rows, np.float64).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, len(STYLE)), pa.int32()), flat)], names=["doc_id", "x"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text"):
    """(means, spreads, weights, bias) of a logistic regression on about ``max_rows`` labelled rows at most, chosen by a hash of the id."""
    import numpy as np

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    chosen = texts(docs, id_col, text_col).join(F.broadcast(known.select("doc_id")), "doc_id")  # max_rows bounds the rows
    rows = style_features(chosen).join(F.broadcast(known), "doc_id").toPandas().sort_values("doc_id")
    if not len(rows):
        return np.zeros(len(STYLE)), np.ones(len(STYLE)), np.zeros(len(STYLE)), 0.0
    x, y = np.array(rows.x.tolist()), rows.label.to_numpy(float)
    means, spreads = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - means) / spreads, -6, 6), np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):  # Newton steps; the ridge keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 0.5 * np.eye(z.shape[1])
        w = w + np.linalg.solve(h, z.T @ (y - p) - 0.5 * w)
    return means, spreads, w[:-1], float(w[-1])


def evidence(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path, p: the classifier's probability of good quality. No shuffle."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    means, spreads, weights, bias = model

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        classes = byte_classes()
        for batch in pieces(batches):
            x = np.array([style(t.as_py().encode(), classes) for t in batch.column(1)]).reshape(-1, len(STYLE))
            logit = np.clip((x - means) / spreads, -6, 6) @ weights + bias
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))], names=["doc_id", "host", "path", "p"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"))
    return rows.mapInArrow(run, "doc_id long, host string, path string, p double")


def moments(sites: DataFrame, within: list[str]) -> DataFrame:
    """Strength of the prior for each parent: rate(1 - rate) over the variance between its sites, by moments."""
    rate = F.sum("s") / F.sum("n")
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("parent_rate"), 2))
    noise = F.col("parent_rate") * (1 - F.col("parent_rate"))
    out = sites.groupBy(*within, "parent_rate").agg(spread.alias("spread"), F.count("*").alias("k"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), rate.alias("rate"))
    between = (F.col("spread") - (F.col("k") - 1) * noise) / F.greatest(F.col("total") - F.col("squares") / F.col("total"), F.lit(1e-9))
    return out.select(*within, F.least(F.greatest(noise / F.greatest(between, F.lit(1e-9)), F.lit(2.0)), F.lit(1000.0)).alias("strength"))


def posteriors(rows: DataFrame) -> DataFrame:
    """host, path, n, s (the evidence's sum), strength, global_rate, host_rate, path_rate of each path, from the classifier's evidence."""
    paths = rows.groupBy("host", "path").agg(F.sum("p").alias("s"), F.count("*").cast("double").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    overall = hosts.agg((F.sum("s") / F.sum("n")).alias("parent_rate"))
    hosts = hosts.crossJoin(F.broadcast(overall))  # one row
    hosts = hosts.crossJoin(F.broadcast(moments(hosts, []))).select("host", F.col("parent_rate").alias("global_rate"), ((F.col("s") + F.col("strength") * F.col("parent_rate")) / (F.col("n") + F.col("strength"))).alias("host_rate"))
    sites = paths.join(hosts, "host").withColumn("parent_rate", F.col("host_rate"))
    strengths = moments(sites, ["host"])
    return sites.join(strengths, "host").select("host", "path", F.col("n").cast("long").alias("n"), "s", "strength", "global_rate", "host_rate", ((F.col("s") + F.col("strength") * F.col("host_rate")) / (F.col("n") + F.col("strength"))).alias("path_rate"))


def classify(docs: DataFrame, model, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """doc_id, host, path, evidence, host_rate, path_rate, score, kept for every row.

    The score's log odds are the evidence's, plus those of the path's rate without the row's own share, less the global rate's: so
    a row's evidence counts once. A null text counts as empty, a null host or path as the empty name; repeated rows
    each give a row and count in their site; an empty table gives an empty one; other columns are left out. Texts are
    judged once; sites are summed map-side first, and a hot site's rows are dealt over several tasks.
    """
    rows = cut(evidence(docs, model, id_col, text_col, host, path))
    logit = lambda c: F.log(F.greatest(c, F.lit(1e-9)) / F.greatest(1 - c, F.lit(1e-9)))
    sites = cut(posteriors(rows)).withColumn("rows", F.col("n"))
    others = (F.col("s") - F.col("p") + F.col("strength") * F.col("host_rate")) / (F.col("rows") - 1 + F.col("strength"))
    total = logit(F.col("p")) + logit(others) - logit(F.col("global_rate"))
    scored = join_hot(rows, sites, ["host", "path"], ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-total)))
    return scored.select("doc_id", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", "score", (F.col("score") >= threshold).alias("kept"))
