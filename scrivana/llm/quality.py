"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Ratings are grades 0 < 1 < ... < K. One weight for each hashed feature of the text is shared by all grades, and
K ordered thresholds cut the resulting score: P(grade >= k) = sigmoid(score - threshold[k-1]). The expected grade
is the sum of these tail probabilities; documents are selected by one of them.

Features of the whole text, hashed into 2**BITS places: presence of each word (letters only, lower case), the
share of each word shape (its character classes), the share of words equal to the one before, and coarse sizes.

The model is fitted on at most ``sample`` rated documents, those with the smallest hash of seed and key, so the
driver's memory has a bound; every document is scored. Nulls and empty texts have only the size features.
Unrated rows, null grades and grades out of range are not fitted on; of several ratings of one key the lowest counts,
of several texts the least; without two grades to learn from, every document gets the same score. Repeated rows are
scored alike. Other columns pass through; where one has the name of a result, the result's name gets an underscore.
An empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scrivana import ship
from scrivana.llm.common import Words, blocks, free_name

BITS = 18
SAMPLE = 10_000
SEED = 11
BLOCK = 2 << 20
RESULTS = (("quality_score", "double"), ("expected_grade", "double"), ("tail_probability", "double"), ("selected", "boolean"))

#: Classes of bytes for word shapes: capital, small letter (or any byte beyond ASCII), digit; others stand for themselves.
_CLASSES = bytes(0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_EDGES = bytes(b for b in range(1, 128) if not chr(b).isalpha())
_RUN = re.compile(rb"(.)\1+", re.DOTALL)
_shapes: dict[bytes, int] = {}


def place(feature: bytes) -> int:
    return xxhash.xxh3_64_intdigest(feature) >> (64 - BITS)


def shape(classes: bytes) -> bytes:
    """Runs of a class count as one of it, of another character as two; a capital first letter as a small one."""
    out = _RUN.sub(lambda m: m[1] if m[1] in b"aA0" else m[1] * 2, classes)
    return b"a" + out[2:] if out.startswith(b"Aa") else b"a" + out[1:] if classes[:2] == b"A" else out


def of_word(word: bytes) -> tuple[int, int]:
    core, classes = word.strip(_EDGES).lower(), word.translate(_CLASSES)
    at = _shapes.get(classes)
    if at is None:
        at = place(b"s:" + shape(classes))
        if len(_shapes) < 20_000 and len(classes) <= 64:
            _shapes[classes] = at
    return place(b"w:" + core) if core else -1, at


_known: dict[bytes, tuple[int, int]] = {}


def word_places(lexicon: list[bytes]) -> np.ndarray:
    if len(_known) > 120_000:
        _known.clear()
    out = []
    for w in lexicon:
        p = _known.get(w)
        if p is None:
            p = of_word(w)
            if len(w) <= 64:
                _known[w] = p
        out.append(p)
    return np.array(out, dtype=np.int64).reshape(-1, 2)


def distinct_shares(doc: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc, feature and number of times, for each distinct pair."""
    pairs, n = np.unique((doc << BITS) | what, return_counts=True)
    return pairs >> BITS, pairs & ((1 << BITS) - 1), n


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc (position), place and value of every feature of a block of texts."""
    words = Words(texts)
    n_docs = len(words.start) - 1
    sizes = np.diff(words.start)
    doc = np.repeat(np.arange(n_docs), sizes)
    places = word_places(words.lexicon.to_pylist())
    at = places[words.ids] if len(words.ids) else np.zeros((0, 2), dtype=np.int64)
    real = at[:, 0] >= 0
    d1, f1, _ = distinct_shares(doc[real], at[real, 0])
    d2, f2, n2 = distinct_shares(doc, at[:, 1])
    same = np.zeros(len(doc), dtype=bool)
    same[1:] = (words.ids[1:] == words.ids[:-1]) & (doc[1:] == doc[:-1])
    total = np.maximum(sizes, 1)
    again = np.bincount(doc, weights=same, minlength=n_docs) / total
    kinds = np.bincount(np.unique((doc << 32) | words.ids) >> 32, minlength=n_docs) / total
    every = np.arange(n_docs)
    rarity = np.array([place(b"d:%d" % i) for i in range(6)])[np.minimum((kinds * 5).astype(int), 5)]
    length = np.array([place(b"n:%d" % i) for i in range(40)])[np.log2(total).astype(int)]
    return (
        np.concatenate([d1, d2, every, every, every]),
        np.concatenate([f1, f2, np.full(n_docs, place(b"r:")), rarity, length]),
        np.concatenate([np.ones(len(d1)), 4.0 * n2 / total[d2], 4.0 * again, np.ones(n_docs), np.ones(n_docs)]),
    )


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        doc, what, value = features(texts)
        return np.bincount(doc, weights=self.weights[what] * value, minlength=len(texts))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K, one row for each score."""
        return sigmoid(scores[:, None] - self.thresholds[None, :])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def slopes(score: np.ndarray, cut: np.ndarray, grades: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Minus the log likelihood of the grades, each counted by ``each``, and its slopes by score and by threshold."""
    n, own = len(grades), np.arange(len(grades))
    tails = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - cut[None, :]), np.zeros((n, 1))], axis=1)
    upper, lower = tails[own, grades], tails[own, grades + 1]
    p = np.maximum(upper - lower, 1e-9)
    by_upper, by_lower = each * upper * (1 - upper) / p, each * lower * (1 - lower) / p
    by_cut = np.array([by_upper[grades == j + 1].sum() - by_lower[grades == j].sum() for j in range(len(cut))])
    return float(-(each * np.log(p)).sum()), by_lower - by_upper, by_cut


def fit(doc: np.ndarray, what: np.ndarray, value: np.ndarray, grades: np.ndarray, n_grades: int, rounds: int = 150, rate: float = 0.3, lasso: float = 1e-3, least_docs: int = 3) -> Ordinal:
    """Full-batch proximal AdaGrad on the likelihood of the grades, with an L1 penalty that leaves most weights 0.

    Thresholds stay ordered as a start and positive gaps; a grade counts by the root of its rarity.

    Features in fewer than ``least_docs`` rated documents keep weight 0.
    """
    w = np.zeros(1 << BITS)
    n, k = len(grades), n_grades - 1
    share = np.array([(grades >= j).mean() if n else 0.5 for j in range(1, n_grades)])
    cut = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    cut = np.maximum.accumulate(cut + np.arange(k) * 1e-3)
    if n == 0 or len(np.unique(grades)) < 2:
        return Ordinal(w, cut)
    often = np.bincount(what, minlength=len(w)) >= least_docs
    doc, what, value = (x[often[what]] for x in (doc, what, value))
    start, gaps = cut[0], np.log(np.maximum(np.diff(cut), 1e-3))
    seen_w, seen_t = np.full(len(w), 1e-8), np.full(k, 1e-8)
    each = np.sqrt(1 / np.maximum(np.bincount(grades, minlength=n_grades) / n, 1e-3))[grades]
    each /= each.mean()
    for _ in range(rounds):
        cut = start + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        _, by_score, by_cut = slopes(np.bincount(doc, weights=w[what] * value, minlength=n), cut, grades, each)
        g, gc = np.bincount(what, weights=by_score[doc] * value, minlength=len(w)) / n, by_cut / n
        seen_w += g * g
        step_w = rate / np.sqrt(seen_w)
        w -= step_w * g
        w = np.sign(w) * np.maximum(np.abs(w) - lasso * step_w, 0)
        gt = np.concatenate([[gc.sum()], [gc[j + 1 :].sum() * np.exp(gaps[j]) for j in range(k - 1)]])
        seen_t += gt * gt
        step = rate * gt / np.sqrt(seen_t)
        start -= step[0]
        gaps -= step[1:]
    return Ordinal(w, start + np.concatenate([[0], np.cumsum(np.exp(gaps))]))


def train(spark: SparkSession, docs: DataFrame, ratings: DataFrame, n_grades: int = 3, sample: int = SAMPLE, seed: int = SEED, key: str = "doc_id", text: str = "text", grade: str = "grade") -> Ordinal:
    """Fits on at most ``sample`` rows of ``ratings`` (key, grade); their texts are found by a broadcast of the keys."""
    ship(spark)
    rated = ratings.select(F.col(key).alias("rated_key"), F.col(grade).cast("int").alias("rated_grade")).where(F.col("rated_key").isNotNull() & F.col("rated_grade").between(0, n_grades - 1))
    chosen = rated.groupBy("rated_key").agg(F.min("rated_grade").alias("rated_grade")).orderBy(F.xxhash64(F.lit(seed), "rated_key"), "rated_key").limit(sample)
    rows = docs.select(F.col(key).alias("rated_key"), F.col(text).alias("rated_text")).join(F.broadcast(chosen), "rated_key")
    rows = rows.groupBy("rated_key", "rated_grade").agg(F.min("rated_text").alias("rated_text"))  # one row a key, so no more than ``sample``

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in blocks(batches, "rated_text", BLOCK):
            doc, what, value = features(table.column("rated_text"))
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(table.num_rows + 1))
            what, value = what[order].astype(np.int32), value[order].astype(np.float32)
            yield pa.RecordBatch.from_arrays([table.column("rated_key").combine_chunks().cast(pa.string()), table.column("rated_grade").combine_chunks(), pa.array([what[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary()), pa.array([value[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())], names=["rated_key", "rated_grade", "what", "value"])

    got = rows.mapInArrow(extract, "rated_key string, rated_grade int, what binary, value binary").toArrow().sort_by("rated_key")
    parts = [np.frombuffer(x, dtype=np.int32) for x in got.column("what").to_pylist()]
    sizes = [len(x) for x in parts]
    what = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    value = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in got.column("value").to_pylist()]) if parts else np.zeros(0)
    return fit(np.repeat(np.arange(len(sizes)), sizes), what, value, np.array(got.column("rated_grade").to_pylist(), dtype=np.int64), n_grades)


def score(spark: SparkSession, docs: DataFrame, model: Ordinal, at_least: int, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with quality_score, expected_grade, tail_probability of ``at_least``, and selected."""
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))
    added = [(free_name(docs, name), kind) for name, kind in RESULTS]
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*sent.value)
        for table in blocks(batches, text, BLOCK):
            scores = own.scores(table.column(text))
            tails = own.tails(scores)
            tail = tails[:, at_least - 1]
            values = [pa.array(scores), pa.array(tails.sum(axis=1)), pa.array(tail), pa.array(tail >= threshold)]
            columns = [c.combine_chunks() for c in table.columns]
            yield from pa.Table.from_arrays(columns + values, names=names + [name for name, _ in added]).to_batches()

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in added:
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def grades(labels: DataFrame) -> DataFrame:
    """Graded ratings of the labels table: 0 toxic, 1 neither toxic nor good, 2 good."""
    toxic, good = F.coalesce(F.col("toxic"), F.lit(0)), F.col("quality")
    return labels.where(good.isNotNull() | (toxic == 1)).select("doc_id", F.when(toxic == 1, 0).when(good == 1, 2).otherwise(1).alias("grade"))


def rate_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """Every document with its scores; selected: probably of grade 2."""
    model = train(spark, docs, grades(labels), 3, **options)
    return score(spark, docs, model, at_least=2, threshold=threshold)
