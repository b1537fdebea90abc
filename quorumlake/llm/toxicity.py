"""Operator 9: toxicity by weak supervision.

Voters are words (a lexicon) and word beginnings (patterns) that labelled rows suggest, beside a
fixed lexicon. A voter that fires speaks for toxic, one that doesn't abstains. A generative model of the votes
estimates by EM how often each voter fires on toxic and on other documents, how often none does, and
how the voters correlate given the class; correlated voters share their weight. EM starts from the votes alone; a row's label is
no voter: it enters as evidence of one fixed, weak accuracy, which the votes can outweigh. A linear
classifier over words and word beginnings is trained on the posteriors.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: A general lexicon of insults: fixed values.
LEXICON = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
PREFIXES = (3, 4, 5, 6)
WORD = r"[^\W\d_]+"
#: Log odds that a row's label adds to its posterior: right in 88 of 100 rows. Without it the votes decide alone.
ANCHOR = 2.0


def features(word: str) -> list[str]:
    """A word is a feature, and so are its beginnings, marked by a closing star."""
    return [word, *(f"{word[:k]}*" for k in PREFIXES if len(word) > k)]


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label) of at most about ``max_rows`` labelled rows that are not held out, chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label")).where(~held_out())
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    # under 20 bytes a row, and max_rows bounds the rows
    return texts(docs, id_col, text_col).join(F.broadcast(known), "doc_id")


def suggested(train: DataFrame, n_voters: int, n_features: int) -> tuple[list[str], list[str], float]:
    """Voters and classifier features from document frequencies in the training rows; the share of toxic rows."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import pyarrow as pa

        find = re.compile(WORD).findall
        counts, rows = (Counter(), Counter()), [0, 0]
        for batch in pieces(batches):
            for text, label in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                label = int(bool(label))
                rows[label] += 1
                counts[label].update({f for w in set(find(text.as_py().lower())) for f in features(w)})
        names = [*(counts[0] | counts[1]), ""]
        both = [[*(c[x] for x in names[:-1]), r] for c, r in zip(counts, rows, strict=True)]
        for at in range(0, len(names), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000]), *(pa.array(x[at : at + 50_000], pa.int64()) for x in both)], names=["feature", "clean", "toxic"])

    counted = train.select("doc_id", "text", "label").mapInArrow(run, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    total = counted.where("feature = ''").first()
    clean, toxic = max(1, (total and total.clean) or 0), max(1, (total and total.toxic) or 0)
    odds = F.log((F.col("toxic") + 0.2) / (toxic + 0.4)) - F.log((F.col("clean") + 0.2) / (clean + 0.4))
    scored = counted.where("feature <> '' and clean + toxic >= 3").withColumn("odds", odds)
    voters = [r.feature for r in scored.where("toxic >= 3 and odds > 2").orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "feature").limit(n_voters).collect()]
    others = [r.feature for r in scored.orderBy(F.desc(F.abs("odds") * F.sqrt(F.col("toxic") + F.col("clean"))), "feature").limit(n_features).collect()]
    counted.unpersist()
    voters = list(dict.fromkeys([*voters, *LEXICON]))
    return voters, list(dict.fromkeys([*voters, *others])), toxic / (clean + toxic)


def fired(train: DataFrame, names: list[str]):
    """Row and feature indices of the features that occur in each training row (a sparse 0/1 matrix), and the rows' labels."""
    import numpy as np

    shared = train.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        index, find = shared.value, re.compile(WORD).findall
        for batch in pieces(batches):
            out = [sorted({index[f] for w in set(find(t.as_py().lower())) for f in features(w) if f in index}) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "label", "on"])

    rows = train.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, on array<int>").toPandas().sort_values("doc_id")
    sizes = np.array([len(x) for x in rows.on], np.int64)
    return np.repeat(np.arange(len(rows)), sizes), np.concatenate([np.zeros(0, np.int64), *rows.on]).astype(np.int64), (rows.label.to_numpy() > 0).astype(float)


def label_model(row, on, n_voters: int, n_rows: int, prior: float, labels=None, anchor: float = ANCHOR, rounds: int = 25):
    """Posterior of toxic for each training row, from votes.

    EM over a two-class model: voter j fires with rate r[j, y], and a row of class y is one without votes with rate q[y]. Given
    the posteriors, the correlation of two voters within the classes says how much of their evidence is the same;
    a voter's weight is divided by one plus its squared correlations with the others.
    """
    import numpy as np

    keep = on < n_voters
    dense = np.zeros((n_rows, n_voters), np.float32)
    dense[row[keep], on[keep]] = 1
    none = dense.sum(axis=1) == 0
    posterior = np.where(none, 0.02, 0.9)
    weak = 0.0 if labels is None else anchor * (2 * np.asarray(labels) - 1)
    for _ in range(rounds):
        p = np.stack([1 - posterior, posterior])
        mass = p.sum(axis=1, keepdims=True) + 2
        rate = np.clip((p @ dense + np.array([[0.02], [0.2]])) / mass, 1e-5, 0.98)
        covariance = 0
        for y in (0, 1):
            centred = (dense - rate[y].astype(np.float32)) * np.sqrt(p[y])[:, None].astype(np.float32)
            covariance = covariance + centred.T @ centred
        spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
        correlation = covariance / spread[:, None] / spread[None, :]
        np.fill_diagonal(correlation, 0)
        share = 1 / (1 + (correlation**2).sum(axis=1))
        quiet = np.log(((p @ none) + 0.2) / mass[:, 0])
        balance = np.clip(posterior.mean(), 0.3 * prior, 3 * prior)
        logit = np.log(balance / (1 - balance)) + dense @ (np.log(rate[1] / rate[0]) * share) + none * (quiet[1] - quiet[0]) + weak
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def linear_classifier(row, on, n_rows: int, n_features: int, target, rounds: int = 12, penalty: float = 1.0):
    """Weights and bias of a logistic regression on soft targets: Newton steps by conjugate gradients on the sparse 0/1 matrix."""
    import numpy as np

    target = np.asarray(target)
    ridge = np.append(np.full(n_features, penalty), 1e-6)

    def forward(w):
        return np.bincount(row, weights=w[:-1][on], minlength=n_rows) + w[-1]

    def back(x):
        return np.append(np.bincount(on, weights=x[row], minlength=n_features), x.sum())

    def loss(w, z):
        return np.logaddexp(0, z).sum() - target @ z + 0.5 * (ridge * w * w).sum()

    w = np.zeros(n_features + 1)
    z = forward(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        gradient, curve = back(p - target) + ridge * w, p * (1 - p) + 1e-9
        step, left = np.zeros_like(w), -gradient
        way, size = left.copy(), left @ left
        for _ in range(25):
            if size < 1e-10 * (gradient @ gradient) + 1e-12:
                break
            bent = back(curve * forward(way)) + ridge * way
            rate = size / (way @ bent)
            step, left = step + rate * way, left - rate * bent
            size, before = left @ left, size
            way = left + size / before * way
        now, scale = loss(w, z), 1.0
        while scale > 1e-3 and loss(w + scale * step, forward(w + scale * step)) > now:
            scale /= 2
        w = w + scale * step
        z = forward(w)
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, n_voters: int = 200, n_features: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[str, float], float]:
    """Weight of each feature and the bias. The fit sees about ``max_rows`` labelled rows at most."""
    train = training_rows(docs, labels, max_rows, id_col, text_col).persist()
    voters, names, share = suggested(train, n_voters, n_features)
    row, on, known = fired(train, names)
    train.unpersist()
    if not len(known):
        return {x: 4.0 for x in LEXICON}, -2.0
    posterior = label_model(row, on, len(voters), len(known), share, known)
    weights, bias = linear_classifier(row, on, len(known), len(names), posterior)
    return dict(zip(names, weights.tolist(), strict=True)), float(bias)


def scorer(model: tuple[dict[str, float], float]):
    """A function from a text to its score."""
    import math

    weights, bias = model
    find = re.compile(WORD).findall
    weights = {f: w for f, w in weights.items() if abs(w) > 1e-6}

    class Known(dict):
        def __missing__(self, word: str) -> tuple:
            if len(self) >= 400_000:
                self.clear()
            self[word] = out = tuple(f for f in features(word) if f in weights)
            return out

    known = Known().__getitem__

    def of(text: str) -> float:
        on = set().union(*map(known, set(find(text.lower()))))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + sum(weights[f] for f in sorted(on))))))

    return of


def score(docs: DataFrame, model: tuple[dict[str, float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every whole text.

    The empty text, and null as empty, gets the score of the bias alone. Each row gives one row,
    repeated rows too; an empty table gives an empty one; other columns are left out.
    The model has a few thousand weights. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = scorer(shared.value)
        for batch in pieces(batches):
            out = [of(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64()), pa.array([int(x >= 0.5) for x in out], pa.int32())], names=["doc_id", "score", "predicted"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: tuple[dict[str, float], float], threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text scores below the threshold. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        of = scorer(shared.value)
        for batch in pieces(batches):
            yield batch.filter(pa.array([of(text.as_py() or "") < threshold for text in batch.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
