"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models over hashed
features; each model also sees the probabilities of the categories before it.
In training those are out-of-fold predictions, so that later models learn from
probabilities as unsure as they will meet.

``labels`` holds one label.  The chain's last category is that label; the two
before it are marked in the labelled sample: a toxic document has an abusive
word (stem) if it has a word (stem) that toxic documents share and clean ones
do not.  What those words are, and which features a model sees, is chosen anew
for each fold from the other folds alone, so that an out-of-fold prediction
knows nothing of the fold's own labels.

Features are a text's words and the words' first four and five characters.
The models are fitted on at most ``LABELLED`` labelled documents (those with
the smallest hashes of their ids); features are chosen on the same sample by
how unevenly the classes use them, at most ``FEATURES`` of them.
"""

from __future__ import annotations

import functools
import operator
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talweg.llm._common import at, lean, materialize, pick, positional
from talweg.llm.bpe import slices
from talweg.llm.linear import Design, apply, bucket, logistic, sigmoid

LABELLED, FEATURES, FOLDS = 8000, 2000, 3
#: Words remembered by a worker; a full memory is emptied.
CACHE = 400_000
#: Rows scored at a time, as a dense matrix.
SCORED = 250
CATEGORIES = ("abusive_word", "abusive_stem", "toxic")
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[tuple[str, int]]:
    """Kind and bucket of a word's features."""
    out = [("word", bucket("w " + word))]
    if len(word) > 4:
        out += [("stem", bucket("4 " + word[:4])), ("stem", bucket("5 " + word[:5]))]
    return out


@dataclass(frozen=True)
class Chain:
    """Column of each feature's bucket, and one weight vector a category (features, earlier categories, bias)."""

    columns: dict[int, int]
    weights: tuple[np.ndarray, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category, predicted in order."""
        known = np.empty((len(x), 0))
        for w in self.weights:
            known = np.concatenate([known, apply(np.concatenate([x, known], 1), w)[:, None]], 1)
        return known


@dataclass(frozen=True)
class Choice:
    """Column of each chosen feature's bucket, and the buckets that mark the two earlier categories."""

    columns: dict[int, int]
    strong: tuple[frozenset[int], frozenset[int]]

    def design(self, hits: list[list[int]]) -> Design:
        return Design.of([sorted({self.columns[b] for b in h if b in self.columns}) for h in hits], len(self.columns))

    def marks(self, hits: list[list[int]], y: np.ndarray) -> np.ndarray:
        """One column a category."""
        earlier = [np.array([not s.isdisjoint(h) for h in hits], bool) & y for s in self.strong]
        return np.stack([*earlier, y], 1).astype(float)


def fit_chain(hits: list[list[int]], y: np.ndarray, fold: np.ndarray, choices: list[Choice]) -> Chain:
    """Fit one model a category.

    ``choices[k]`` was made without fold k, the last one with all folds.  In
    fold k's rows the earlier categories' probabilities come from models and
    choices that never saw fold k.
    """
    known = np.empty((len(y), 0))
    sides = []
    for k in range(FOLDS):
        rest = fold != k
        own = [h for h, r in zip(hits, rest) if r]
        sides.append((rest, choices[k].design(own), choices[k].marks(own, y[rest]), choices[k].design([h for h, r in zip(hits, rest) if not r])))
    x, marks = choices[-1].design(hits), choices[-1].marks(hits, y)
    weights = []
    for c in range(len(CATEGORIES)):
        out = np.zeros(len(y))
        for rest, inner, labels, held in sides:
            w = logistic(inner.with_dense(known[rest]), labels[:, c], _balance(labels[:, c])) if rest.any() else np.zeros(inner.columns + c)
            out[~rest] = sigmoid(held.with_dense(known[~rest]).dot(w))
        weights.append(logistic(x.with_dense(known), marks[:, c], _balance(marks[:, c])))
        known = np.concatenate([known, out[:, None]], 1)
    return Chain(choices[-1].columns, tuple(weights))


def _balance(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str) -> DataFrame:
    """Text and label of the labelled sample, as a table."""
    marks = pick(labels, id=label_id, y=label_col).where("id is not null and y is not null")
    marks = marks.groupBy("id").agg(F.max(F.col("y").cast("int")).alias("y")).orderBy(F.xxhash64("id"), "id").limit(LABELLED)
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(marks), "id")
    return materialize(rows.groupBy("id").agg(F.max("text").alias("text"), F.max("y").alias("y")), "labelled")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic") -> Chain | None:
    """Fit the chain; None if the sample does not have both classes.

    Labels with null ids or values are passed over; of several labels of one
    document the largest counts, and of several texts of one id the largest.
    """
    sample = _sample(docs, labels, id_col, text_col, label_id, label_col).withColumn("fold", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(FOLDS)).cast("int"))
    size: dict[tuple[int, bool], int] = {}
    for r in sample.groupBy("fold", (F.col("y") > 0).alias("bad")).agg(F.count(F.lit(1)).alias("n")).collect():
        size[r["fold"], r["bad"]] = r["n"]
    if {bad for _, bad in size} != {False, True}:
        return None

    def count(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, y, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                side = 2 * fold + (y > 0)
                seen.update((*f, side) for f in {f for w in words_of(text) for f in features_of(w)})
            columns = zip(*((*k, n) for k, n in seen.items())) if seen else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64()))], ["kind", "bucket", "side", "n"])

    counted = sample.select("text", "y", "fold").mapInArrow(lean(count), "kind string, bucket long, side int, n long")
    sides = [F.sum(F.when(F.col("side") == i, F.col("n")).otherwise(0)).alias(f"s{i}") for i in range(2 * FOLDS)]
    counted = materialize(counted.groupBy("kind", "bucket").agg(*sides), "feature-counts")

    def choose(without: int | None) -> Choice:
        folds = [k for k in range(FOLDS) if k != without]
        bad_n, good_n = (max(1, sum(size.get((k, bad), 0) for k in folds)) for bad in (True, False))
        bad, good = (functools.reduce(operator.add, [F.col(f"s{2 * k + i}") for k in folds]) for i in (1, 0))
        rows = counted.select("kind", "bucket", bad.alias("toxic"), good.alias("clean"))
        p, q = F.col("toxic") / bad_n, F.col("clean") / good_n
        pooled = (F.col("toxic") + F.col("clean")) / (bad_n + good_n)
        z = (p - q) / F.sqrt(pooled * (1 - pooled) * (1 / bad_n + 1 / good_n) + 1e-12)
        chosen = rows.where("toxic + clean >= 5").withColumn("z", z).orderBy(F.abs(F.col("z")).desc(), "kind", "bucket").limit(FEATURES).collect()
        columns = {b: i for i, b in enumerate(dict.fromkeys(r["bucket"] for r in chosen))}
        strong = [frozenset(r["bucket"] for r in chosen if r["kind"] == kind and r["toxic"] >= 5 and r["z"] > 4 and r["toxic"] * good_n >= 10 * (r["clean"] + 1) * bad_n) for kind in ("word", "stem")]
        return Choice(columns, tuple(strong))

    choices = [choose(k) for k in [*range(FOLDS), None]]
    wanted = frozenset(b for c in choices for b in c.columns)

    def found(batches):
        for batch in batches:
            hit = [sorted({b for w in words_of(t) for _, b in features_of(w) if b in wanted}) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["hit", "y", "fold"])

    rows = sample.orderBy("id").select("text", "y", "fold").mapInArrow(lean(found), "hit array<int>, y int, fold int").collect()  # at most LABELLED
    return fit_chain([r["hit"] for r in rows], np.array([r["y"] > 0 for r in rows]), np.array([r["fold"] for r in rows]), choices)


class _Finder:
    """A worker's memory of which columns a word has."""

    def __init__(self, chain: Chain):
        self.chain, self.known = chain, {}

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.chain.columns)))
        for i, text in enumerate(texts):
            for w in words_of(text):
                hit = self.known.get(w)
                if hit is None:
                    if len(self.known) > CACHE:
                        self.known.clear()
                    hit = self.known[w] = tuple(self.chain.columns[b] for _, b in features_of(w) if b in self.chain.columns)
                if hit:
                    x[i, hit] = 1
        return x


def _scored(rows: DataFrame, chain: Chain | None, text: str, names: list[str]) -> DataFrame:
    """The columns ``names`` of the rows, with one probability column a category for the column ``text``."""
    schema = rows.select(*names).schema
    for name in CATEGORIES:
        schema = schema.add(f"p_{name}", "double")

    def run(batches):
        finder = _Finder(chain) if chain else None
        for whole in batches:
            for batch in slices(whole, text):
                for start in range(0, len(batch), SCORED):
                    part = batch.slice(start, SCORED)
                    texts = part.column(text).to_pylist()
                    p = chain.scores(finder.matrix(texts)) if chain else np.zeros((len(texts), len(CATEGORIES)))
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *(pa.array(c) for c in p.T)], schema.names)

    return rows.mapInArrow(lean(run), schema)


def score(df: DataFrame, chain: Chain | None, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``doc_id``, a probability for each category, and ``toxic``: the last one reaches ``limit``.

    Whole texts are scored; null and empty ones have no features and are not
    toxic.  Without a chain (no labels of both classes) nothing is.  Repeated
    rows each get their own result; an empty table gives an empty result.
    """
    rows = pick(df, doc_id=id_col, text=text_col)
    out = _scored(rows.withColumn("blank", F.coalesce(F.trim("text"), F.lit("")) == ""), chain, "text", ["doc_id", "blank"])
    return out.withColumn("toxic", ~F.col("blank") & (F.col(f"p_{CATEGORIES[-1]}") >= limit)).drop("blank")


def drop_toxic(df: DataFrame, chain: Chain | None, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows that are not toxic, all columns as they were."""
    names, text_at = [f"c{i}" for i in range(len(df.columns))], at(df, text_col)
    kept = _scored(positional(df), chain, text_at, names).where((F.coalesce(F.trim(text_at), F.lit("")) == "") | (F.col(f"p_{CATEGORIES[-1]}") < limit))
    return kept.select(*names).toDF(*df.columns)
