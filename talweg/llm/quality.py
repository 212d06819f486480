"""Quality by weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over the counts of all vote patterns (every document
counts) estimates how often each labeller is right, without any labels.  The
posterior labels of a bounded sample (``SAMPLE`` documents, smallest hashes of
their ids) then train a linear scorer over hashed features of a text's token
shapes and layout, which scores every document.
"""

from __future__ import annotations

import functools
import itertools
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from talweg.llm._common import materialize, pick
from talweg.llm.bpe import slices
from talweg.llm.linear import BUCKETS, Design, bucket, logistic, sigmoid

SAMPLE, FEATURES, ROUNDS = 8000, 1000, 50
LABELLERS = ("symbols", "token_ends", "capitals", "commonest", "stutter", "lines", "distinct", "word_length", "sentences")
_ENDS = re.compile(r"[^\w\s.,;:?)\]}'\"»”’-]{2,}$")
_PLAIN = frozenset(".,;:?!'\"-()[]/")
_RUNS = re.compile(r"(.)\1+")
#: Tokens remembered by a worker; a full memory is emptied.
CACHE = 400_000


def _kind(c: str) -> int:
    """1 for letters, 2 for upper case, 4 for symbols that prose has few of."""
    return c.isalpha() + 2 * c.isupper() + 4 * (not c.isalnum() and not c.isspace() and c not in _PLAIN)


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    return np.array([_kind(chr(i)) for i in range(1 << 16)], np.uint8)


def _characters(text: str) -> tuple[int, int, int]:
    """Letters, upper-case letters and odd symbols."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = points < 1 << 16
    n = np.bincount(_kinds()[points[low]], minlength=8)
    for c in map(chr, points[~low].tolist()):
        n[_kind(c)] += 1
    return tuple(int(n[[k for k in range(8) if k & bit]].sum()) for bit in (1, 2, 4))


class _Tokens(dict):
    """Shape, odd end, length and sentence end of each token met."""

    def __missing__(self, t: str) -> tuple[str, bool, int, bool]:
        if len(self) > CACHE:
            self.clear()
        shape = "".join("X" if x.isupper() else "x" if x.isalpha() else "9" if x.isdigit() else x for x in t)
        found = self[t] = (_RUNS.sub(r"\1\1", shape), bool(_ENDS.search(t)), len(t), t[-1] in ".?!")
        return found


_tokens = _Tokens()


def measures(text: str | None) -> dict[str, float] | None:
    """What the labellers look at; None without words."""
    text = text or ""
    tokens = text.split()
    if not tokens:
        return None
    n, kinds = len(tokens), Counter(tokens)
    letters, upper, odd = _characters(text)
    ends = length = stops = 0
    for t, c in kinds.items():
        _, end, size, stop = _tokens[t]
        length += size * c
        if end:
            ends += c
        if stop:
            stops += c
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "n": n,
        "symbols": odd / len(text),
        "token_ends": ends / n,
        "capitals": upper / max(1, letters),
        "commonest": max(kinds.values()) / n,
        "stutter": sum(map(operator.eq, tokens, itertools.islice(tokens, 1, None))) / n,
        "lines": 1 - len(set(lines)) / max(1, len(lines)),
        "distinct": -len(kinds) / n**0.5,
        "word_length": length / n,
        "sentences": stops / n,
    }


def votes(m: dict[str, float] | None) -> str:
    """One character a labeller: ``+`` good, ``-`` bad, ``0`` no vote."""
    if m is None:
        return "0" * len(LABELLERS)

    def between(name: str, good: float, bad: float, least: int = 5) -> str:
        return "0" if m["n"] < least else "+" if m[name] <= good else "-" if m[name] >= bad else "0"

    return "".join(
        (
            between("symbols", 0.01, 0.05),
            between("token_ends", 0.02, 0.2),
            between("capitals", 0.2, 0.4),
            between("commonest", 0.2, 0.4, 10),
            between("stutter", 0.05, 0.2, 10),
            between("lines", 0.2, 0.6),
            between("distinct", -4, -2.5, 30),
            "0" if m["n"] < 10 else "+" if 2 <= m["word_length"] <= 12 else "-",
            "0" if m["n"] < 40 else "+" if 0.005 <= m["sentences"] <= 0.4 else "-",
        )
    )


def features(text: str | None, m: dict[str, float] | None) -> set[int]:
    """Hashed features: which share of tokens has which shape, and the measures in steps."""
    if m is None:
        return {bucket("empty")}
    step = lambda v: int(np.searchsorted((0.005, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7), v))
    shapes: Counter = Counter()
    for t, c in Counter((text or "").split()).items():
        shapes[_tokens[t][0]] += c
    out = {bucket(f"s {s} {step(c / m['n'])}") for s, c in shapes.items() if c * 50 >= m["n"]}
    out |= {bucket(f"m {k} {step(m[k])}") for k in LABELLERS if k not in ("word_length", "distinct")}
    out.add(bucket(f"d {int(-m['distinct'])}" if m["n"] >= 30 else "d"))
    return out | {bucket(f"l {int(min(m['word_length'], 30))}"), bucket(f"n {int(np.log2(m['n']))}")}


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and each labeller's chance of each vote for bad and good ones.

    Chances are among the votes cast; a labeller that casts none says nothing.
    """

    good: float
    table: np.ndarray  # (labellers, 2, 3): votes -, 0, +

    def posterior(self, patterns: list[str]) -> np.ndarray:
        v = _codes(patterns)
        logs = (np.log(self.table)[np.arange(v.shape[1])[None, :], :, v] * (v != 1)[:, :, None]).sum(axis=1)
        logs += np.log([max(1e-9, 1 - self.good), max(1e-9, self.good)])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -60, 60)))

    def accuracy(self) -> dict[str, float]:
        """Chance that a vote is right."""
        right = self.good * self.table[:, 1, 2] + (1 - self.good) * self.table[:, 0, 0]
        cast = right + self.good * self.table[:, 1, 0] + (1 - self.good) * self.table[:, 0, 2]
        return dict(zip(LABELLERS, (right / np.maximum(cast, 1e-12)).tolist()))


def _codes(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) for c in p] for p in patterns], np.int64).reshape(len(patterns), -1)


def fit_labels(patterns: list[str], counts: list[int]) -> LabelModel:
    """Expectation-maximisation over pattern counts.

    It starts from the number of bad votes: labellers vote good on most
    documents, so that one bad vote outweighs several good ones.
    """
    v, n = _codes(patterns), np.array(counts, float)
    p = np.array([0.95, 0.3, 0.05])[np.minimum((v == 0).sum(axis=1), 2)]
    for _ in range(ROUNDS):
        good = float((n * p).sum() / max(n.sum(), 1))
        table = np.empty((v.shape[1], 2, 3))
        for k, w in enumerate((n * (1 - p), n * p)):
            for vote in range(3):
                table[:, k, vote] = (w[:, None] * (v == vote)).sum(axis=0) + 0.5
            table[:, k] /= table[:, k, ::2].sum(axis=1, keepdims=True)
        model = LabelModel(good, table)
        p = model.posterior(patterns)
    return model


@dataclass(frozen=True)
class Scorer:
    columns: dict[int, int]
    weights: np.ndarray
    labels: LabelModel


def read_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A table ``doc_id, place, pattern, hashed`` of all rows: hash of the id, votes and features, from one reading of the whole texts."""
    rows = pick(df, id=id_col, text=text_col)
    rows = rows.select("text", F.col("id").alias("doc_id"), F.xxhash64(F.col("id").cast("string"), F.lit(11)).alias("place"))
    schema = rows.drop("text").schema.add("pattern", "string").add("hashed", ArrayType(IntegerType()))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                out, hashed = [], []
                for text in batch.column(0).to_pylist():
                    m = measures(text)
                    out.append(votes(m))
                    hashed.append(sorted(features(text, m)))
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(out, pa.string()), pa.array(hashed, pa.list_(pa.int32()))], schema.names)

    return materialize(rows.mapInArrow(run, schema), "votes")


def train_on(read: DataFrame) -> Scorer | None:
    """Fit label model and scorer on the rows of :func:`read_texts`; None for an empty table.

    The label model counts all documents.  The scorer is fitted on the SAMPLE
    documents with the smallest hashes of their ids.
    """
    patterns = read.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** labellers
    if not patterns:
        return None
    patterns.sort()
    model = fit_labels([r["pattern"] for r in patterns], [r["n"] for r in patterns])
    total = sum(r["n"] for r in patterns)
    # About twice the sample is sorted, so that SAMPLE rows are there.
    part = read.where(F.pmod("place", F.lit(max(1, total // (2 * SAMPLE)))) == 0)
    rows = part.orderBy("place", "pattern", "hashed").limit(SAMPLE).select("pattern", "hashed").collect()
    counted = Counter(b for r in rows for b in r["hashed"])
    columns = {b: i for i, (b, _) in enumerate(sorted(((b, c) for b, c in counted.items() if c >= 3), key=lambda x: (-x[1], x[0]))[:FEATURES])}
    x = Design.of([sorted({columns[b] for b in r["hashed"] if b in columns}) for r in rows], len(columns))
    y = model.posterior([r["pattern"] for r in rows]) if rows else np.empty(0)
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1e-9), 0.5 / max((1 - y).sum(), 1e-9)) * len(y)
    return Scorer(columns, logistic(x, y, weight, ridge=0.1, steps=200), model)


def score_read(read: DataFrame, scorer: Scorer | None, limit: float = 0.5) -> DataFrame:
    """``doc_id, quality, keep`` of the rows of :func:`read_texts`."""
    rows = read.select("hashed", "doc_id")
    schema = rows.drop("hashed").schema.add("quality", "double")
    empty = bucket("empty")

    def run(batches):
        weights = np.zeros(BUCKETS + 1)
        for b, i in scorer.columns.items() if scorer else ():
            weights[b] = scorer.weights[i]
        for batch in batches:
            lists = batch.column(0)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat, owner = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
            p = sigmoid(np.bincount(owner, weights[flat], len(sizes)) + scorer.weights[-1]) if scorer else np.full(len(sizes), 0.5)
            p = np.where(np.bincount(owner, flat == empty, len(sizes)) > 0, 0.0, p)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(p)], schema.names)

    return rows.mapInArrow(run, schema).withColumn("keep", F.col("quality") >= limit)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Scorer | None:
    """Fit label model and scorer on a table of texts; None for an empty table.  Null ids and repeated rows count like any other."""
    return train_on(read_texts(df, id_col, text_col))


def score(df: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``doc_id, quality`` (probability of good) and ``keep``: it reaches ``limit``.

    Whole texts are scored.  Texts without words (null, empty, blank) have
    quality 0 and are not kept.  Repeated rows each get their own result; an
    empty table gives an empty result; other columns are ignored.
    """
    return score_read(read_texts(df, id_col, text_col), scorer, limit)


def train_and_score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """:func:`score` by a scorer trained on the same table, with each text read once."""
    read = read_texts(df, id_col, text_col)
    return score_read(read, train_on(read), limit)
