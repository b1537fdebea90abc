"""Operator 5: secret scans with character Markov models.

Three patterns give the base spans. Two first-order Markov models over the characters that
tokens are made of, one of random strings and one of ordinary identifiers, score every long
token outside them; where the log-likelihood ratio is high, a span of kind ``markov`` is added.
Labelled samples train the models: strings drawn at random and the values of base spans are random;
identifiers put together from words and all other runs of token characters are ordinary. Transition counts are taken over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: Fixed values of the contract: the kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "markov")
WORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = r"[A-Za-z0-9+/_.=-]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Characters of tokens that the Markov models know; state 0 is the start of a token.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
STATES = len(ALPHABET) + 1


class Scanner:
    """Base spans of one text."""

    def __init__(self):
        either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)  # noqa: E731  ASCII letters only
        self.assign = re.compile(rf"""({"|".join(map(either, WORDS))})["']?\x20*[:=]\x20*["']?({VALUE})""")
        self.access = re.compile(r"AKIA[A-Z0-9]+")
        self.hex = re.compile(f"[0-9a-f]{{{MIN_HEX},}}")  # runs are maximal, so the shorter ones may be passed over at once
        self.hints = re.compile("passw|secret|token|api_?key")
        self.digits = bytes(104 if chr(i) in "0123456789abcdef" else 0 for i in range(256))

    def spans(self, text: str, raw: bytes) -> list[tuple[int, int, int, int, int]]:
        """(start, kind, end, value start, value end) in order."""
        out = []
        if self.hints.search(text.lower()):
            out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if "AKIA" in text:
            out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        if b"h" * MIN_HEX in raw.translate(self.digits):
            out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in self.hex.finditer(text)]
        return sorted(out)


def state_table():
    import numpy as np

    table = np.zeros(256, np.int64)
    for i, c in enumerate(ALPHABET):
        table[ord(c)] = i + 1
    return table


def transition_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """label (1 random, 0 ordinary), code (state before * STATES + state), n, over all documents."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        scanner, table = Scanner(), state_table()
        counts = np.zeros((2, STATES * STATES), np.int64)

        def add(label: int, raw: bytes) -> None:
            states = table[np.frombuffer(b"\x00" + raw, np.uint8)]
            counts[label] += np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)

        for batch in pieces(batches):
            for text in batch.column(1):
                text = text.as_py()
                raw = text.encode()
                rest, at = [], 0
                for start, _, end, a, b in scanner.spans(text, raw):
                    add(1, text[a:b].encode())
                    rest.append(text[at:start])
                    at = max(at, end)
                add(0, "\x00".join([*rest, text[at:]]).encode() if rest else raw)
        label, code = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(code, pa.int32()), pa.array(counts[label, code], pa.int64())], names=["label", "code", "n"])

    return texts(docs, id_col, text_col).mapInArrow(run, "label int, code int, n long").groupBy("label", "code").agg(F.sum("n").alias("n"))


#: Words of the labelled ordinary identifiers: fixed values.
IDENTIFIER_WORDS = ("access", "account", "build", "cache", "client", "config", "count", "data", "default", "error", "file", "handler", "index", "key", "manager", "message", "name", "number", "password", "path", "request", "reset", "response", "secret", "server", "session", "size", "state", "string", "test", "token", "type", "update", "user", "value", "version")


def labelled_samples(n: int = 4000, seed: int = 0):
    """Transition counts of ``n`` labelled strings of each class: keys drawn at random, and identifiers put together from words."""
    import random

    import numpy as np

    rnd, table, counts = random.Random(seed), state_table(), np.zeros((2, STATES * STATES))
    letters = ALPHABET[:62]

    def identifier() -> str:
        words = rnd.choices(IDENTIFIER_WORDS, k=rnd.randrange(2, 6))
        style = rnd.randrange(5)
        if style == 0:
            words = [words[0], *map(str.title, words[1:])]
        out = ("", "_", "-", "/", "_")[style].join(words)
        return (out.upper() if style == 4 else out) + rnd.choice(("", "", "_v2", "01", "-2024"))

    keys = ["".join(rnd.choices(letters + rnd.choice(("", "", "", "+/", "-_")), k=32)) for _ in range(n)]
    for label, strings in enumerate(([identifier() for _ in range(n)], keys)):
        states = table[np.frombuffer(("\x00" + "\x00".join(strings)).encode(), np.uint8)]
        counts[label] = np.bincount(states[:-1] * STATES + states[1:], minlength=STATES * STATES)
    return counts


#: Transitions that each class's corpus counts weigh, whatever the size of the corpus, beside the labelled samples.
CORPUS_WEIGHT = (1_500_000, 30_000)


def log_ratio(counts):
    """Log-likelihood ratio of each transition, random over ordinary, from the corpus's counts (label, code).

    Both classes' corpus counts are brought to a fixed weight first, so the ratio doesn't depend on the corpus's size.
    """
    import numpy as np

    inside = np.array(counts, float).reshape(2, STATES, STATES)[:, :, 1:]  # tokens have token characters only
    total = np.maximum(inside.sum(axis=(1, 2), keepdims=True), 1e-9)
    counts = inside / total * np.array(CORPUS_WEIGHT)[:, None, None] + labelled_samples().reshape(2, STATES, STATES)[:, :, 1:]
    single = counts.sum(axis=1, keepdims=True) + 0.5
    counts = counts + 50 * single / single.sum(axis=2, keepdims=True)  # rare states back off to single characters
    logs = np.log(counts) - np.log(counts.sum(axis=2, keepdims=True))
    ratio = np.zeros((STATES, STATES))
    ratio[:, 1:] = logs[1] - logs[0]
    return ratio


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The log-likelihood ratios of ``log_ratio`` over all documents: a table of the alphabet's size squared."""
    import numpy as np

    counts = np.zeros((2, STATES * STATES))
    for row in transition_counts(docs, id_col, text_col).toLocalIterator():  # at most 2 * STATES ** 2 rows
        counts[row.label, row.code] = row.n
    return log_ratio(counts)


def scan(docs: DataFrame, ratio, min_length: int = 16, min_score: float = 14.0, min_mean: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and secrets, an array of (kind, start, end) in code points, end exclusive, by start and then kind.

    Tokens of ``min_length`` characters or more outside base spans become spans of kind markov if
    their log-likelihood ratio reaches ``min_score`` in all and ``min_mean`` a character. A null
    text counts as empty and has no spans; each row gives one row, repeated rows too; an
    empty table gives an empty one; other columns are left out. No shuffle.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scanner, states = Scanner(), {c: i + 1 for i, c in enumerate(ALPHABET)}
        weights = {(a, b): ratio[states.get(a, 0)][states[b]] for a in ["", *ALPHABET] for b in ALPHABET}
        tokens = re.compile(rf"[A-Za-z0-9+/_=-]{{{min_length},}}")
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches):
            out = []
            for text in batch.column(1):
                text = text.as_py()
                base = scanner.spans(text, text.encode())
                found = [(s, k, e) for s, k, e, _, _ in base]
                for m in tokens.finditer(text):
                    token = m[0]
                    score = weights["", token[0]] + sum(map(weights.__getitem__, zip(token, token[1:], strict=False)))
                    if score >= min_score and score >= min_mean * len(token) and not any(s < m.end() and m.start() < e for s, _, e, _, _ in base):
                        found.append((m.start(), 3, m.end()))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(found)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["doc_id", "secrets"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """The columns of the contract from what ``scan`` returns."""
    base = F.filter("secrets", lambda x: x["kind"] != "markov")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return scanned.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
