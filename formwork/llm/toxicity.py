"""Toxicity grades by cumulative-link ordinal regression on the words of a document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StructField, StructType

from formwork.llm.common import text_chunks, type_of

_LETTERS = regex.compile(r"\p{L}+")


def word_counts(text: str) -> Counter:
    """How often each word (a run of letters, lower-cased) occurs."""
    return Counter(_LETTERS.findall(text.lower()))


def features(words: Counter) -> Counter:
    """Counts of the words and of their beginnings of 3 to 8 letters (marked by a tilde), so that
    what is learned of a stem holds for its other endings."""
    out = Counter(words)
    for w, n in words.items():
        for k in range(3, min(9, len(w))):
            out[w[:k] + "~"] += n
    return out


@dataclass(frozen=True)
class Ordinal:
    """P(grade <= k) = logistic(cuts[k] - sum of weights * (1 + log2(count))): one weight for each
    feature, shared by the ordered cuts."""

    weights: dict[str, float] = field(default_factory=dict)
    cuts: tuple[float, ...] = ()

    def above(self, words: Counter) -> np.ndarray:
        """P(grade > k) for each k."""
        return Scorer(self).above([words])[0]


class Scorer:
    """The model with its features by number, and the features of words that it has met."""

    KNOWN = 200_000

    def __init__(self, model: Ordinal):
        self.number = {f: i for i, f in enumerate(sorted(model.weights))}
        self.weights = np.array([model.weights[f] for f in sorted(model.weights)])
        self.cuts = np.array(model.cuts)
        self.met: dict[str, tuple[int, ...]] = {}

    def of(self, word: str) -> tuple[int, ...]:
        """The numbers of the word and of its beginnings that have weights."""
        found = self.met.get(word)
        if found is None:
            names = [word, *(word[:k] + "~" for k in range(3, min(9, len(word))))]
            found = tuple(self.number[n] for n in names if n in self.number)
            if len(self.met) >= self.KNOWN:
                self.met.clear()
            self.met[word] = found
        return found

    def above(self, texts: list[Counter]) -> np.ndarray:
        """P(grade > k) for each k (columns) and text (rows)."""
        place, often, width = [], [], max(1, len(self.weights))
        for i, words in enumerate(texts):
            for w, n in words.items():
                for f in self.of(w):
                    place.append(i * width + f)
                    often.append(n)
        keys, which = np.unique(np.array(place, np.int64), return_inverse=True)
        counts = np.bincount(which, often, len(keys)) if len(keys) else np.zeros(0)
        z = np.bincount(keys // width, self.weights[keys % width] * (1 + np.log2(counts)), len(texts)) if len(keys) else np.zeros(len(texts))
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -500, 500)))


def fit_ordinal(x: np.ndarray, y: np.ndarray, grades: int, penalty: float = 0.0005, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts of the model, by accelerated proximal gradient steps with an
    absolute-value penalty on the weights."""
    n, m = x.shape
    w, cuts = np.zeros(m), np.linspace(0.0, grades - 2.0, grades - 1)
    norm = np.ones(m)
    for _ in range(15):
        norm = x.T @ (x @ norm)
        norm /= np.linalg.norm(norm) or 1
    bound = float(np.linalg.norm(x @ norm) ** 2 / n) + 1.0
    step, ahead_w, ahead_c, t = 1 / (0.5 * bound), w, cuts, 1.0
    edges = lambda c: np.concatenate([[-1e3], c, [1e3]])
    for _ in range(rounds):
        z, e = x @ ahead_w, edges(ahead_c)
        hi, lo = (1 / (1 + np.exp(np.clip(z - b, -500, 500))) for b in (e[y + 1], e[y]))
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi) / p, lo * (1 - lo) / p
        gw = x.T @ (dhi - dlo) / n
        gc = np.array([-(dhi * (y == k)).sum() + (dlo * (y == k + 1)).sum() for k in range(grades - 1)]) / n
        new = ahead_w - step * gw
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        cut = np.maximum.accumulate(ahead_c - step * gc + 1e-6 * np.arange(grades - 1))
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead_w, ahead_c = new + (t - 1) / s * (new - w), np.maximum.accumulate(cut + (t - 1) / s * (cut - cuts))
        w, cuts, t = new, cut, s
    return w, cuts


def _chosen(sample: list[tuple[int, Counter]], most: int, least: int = 3) -> list[str]:
    """The features whose presence tells positive from zero grades best, by a score of their odds."""
    bad, good = Counter(), Counter()
    for grade, words in sample:
        (bad if grade else good).update(features(words).keys())
    n_bad, n_good = sum(1 for g, _ in sample if g), sum(1 for g, _ in sample if not g)
    score = {}
    for w in bad.keys() | good.keys():
        if bad[w] + good[w] >= least:
            odds = np.log((bad[w] + 0.5) / (n_bad + 1)) - np.log((good[w] + 0.5) / (n_good + 1))
            score[w] = abs(odds) / np.sqrt(1 / (bad[w] + 0.5) + 1 / (good[w] + 0.5))
    return sorted(score, key=lambda w: (-score[w], w))[:most]


def _severities(sample: list[tuple[int, Counter]]) -> list[int]:
    """Three grades for labels of two: a positive row is severe (2) if the words typical of positive
    rows occur in it more often than in the median positive row."""
    bad, good = Counter(), Counter()
    for grade, words in sample:
        (bad if grade else good).update(features(words).keys())
    n_bad, n_good = max(1, sum(1 for g, _ in sample if g)), max(1, sum(1 for g, _ in sample if not g))
    typical = {w for w, n in bad.items() if n >= max(3, 0.05 * n_bad) and n / n_bad > 10 * (good[w] + 1) / n_good}
    uses = [sum(n for f, n in features(words).items() if f in typical) for _, words in sample]
    middle = float(np.median([u for u, (g, _) in zip(uses, sample) if g]))
    return [0 if not g else 1 + (u > middle) for u, (g, _) in zip(uses, sample)]


def fit(docs: DataFrame, labels: DataFrame, grade_column: str = "toxic", per_grade: int = 1500, most: int = 2000, id_column: str = "doc_id", text_column: str = "text") -> Ordinal:
    """Fit the model on labelled documents.

    ``labels`` has ``id_column`` and a whole ``grade_column`` (0: clean, up to 9), which are the
    ordered grades.  Where only 0 and 1 occur, there are no labelled degrees: positive rows are
    divided into two severities derived from how much they use typical words and stems, so that
    grade 2 of such a model means "much of it", not a label.

    Up to ``per_grade`` labelled ids of each grade, least hash first, are the sample, with one text
    each (the one of least hash): a bound that doesn't grow with the data, so the sample's ids are
    broadcast and its word counts come to the driver.  The model has up to ``most`` features, those that tell grades
    best; words and stems in fewer than three rows of the sample are none.  Of labels that disagree the least counts.
    The grades' shares in all labels correct the cuts.  Rows with a null id, grade or text don't
    count; without both a zero and a positive grade the model rejects nothing.
    """
    usable = labels.select(F.col(id_column).alias("of"), F.col(grade_column).cast("int").alias("grade")).filter("of is not null and grade between 0 and 9")
    usable = usable.groupBy("of").agg(F.min("grade").alias("grade"))
    shares = {r.grade: r.n for r in usable.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if 0 not in shares or len(shares) < 2:
        return Ordinal()
    some = None
    for g in sorted(shares):
        part = usable.filter(F.col("grade") == g).orderBy(F.xxhash64("of"), "of").limit(per_grade)
        some = part if some is None else some.unionByName(part)

    def counted(batches) -> Iterator[pa.RecordBatch]:
        for part, chunk in text_chunks(batches):
            counts = [word_counts(t.decode("utf-8")) for t in chunk]
            columns = [part.column(0), part.column(1), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["of", "grade", "words", "counts"])

    rows = docs.select(F.col(id_column).alias("of"), F.col(text_column).alias("text")).filter("text is not null").join(F.broadcast(some), "of")
    rows = rows.groupBy("of", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    found = rows.select("of", "grade", "text").mapInArrow(counted, f"of {type_of(rows, 'of')}, grade int, words array<string>, counts array<int>").collect()
    sample = [(r.grade, Counter(dict(zip(r.words, r.counts)))) for r in sorted(found, key=lambda r: r.of)]
    return fit_sample(sample, shares, most)


def fit_sample(sample: list[tuple[int, Counter]], shares: dict[int, int], most: int = 2000) -> Ordinal:
    """The model for (grade, word counts) rows; ``shares``: how many rows each grade has in all."""
    if len({g > 0 for g, _ in sample}) < 2:
        return Ordinal()
    levels = sorted({g for g, _ in sample})
    y = np.array([levels.index(g) for g, _ in sample]) if len(levels) > 2 else np.array(_severities(sample))
    levels = sorted(set(y.tolist()))
    y = np.array([levels.index(g) for g in y.tolist()])
    chosen = _chosen(sample, most)
    place = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(sample), len(chosen)))
    for i, (_, words) in enumerate(sample):
        for f, n in features(words).items():
            if f in place:
                x[i, place[f]] = 1 + np.log2(n)
    w, cuts = fit_ordinal(x, y, len(levels))
    in_all = shares.get(0, 0), sum(n for g, n in shares.items() if g)
    here = sum(1 for g, _ in sample if not g), sum(1 for g, _ in sample if g)
    shift = max(0.0, float(np.log((in_all[0] / here[0]) / (in_all[1] / here[1]))))
    return Ordinal({t: float(v) for t, v in zip(chosen, w) if v}, tuple(float(c + shift) for c in cuts))


def grade(docs: DataFrame, model: Ordinal, text_column: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (the most grades that are exceeded with
    probability one half) and ``rejected`` (grade > 0).

    Whole texts count.  A null or empty text has no words and is judged by the cuts alone; where
    that would reject it, it isn't.  ``prefix`` goes before the three names if the table has them.
    """
    names = [prefix + c for c in ("severity", "grade", "rejected")]
    clash = set(names) & set(docs.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist; give a prefix")
    columns = [*docs.columns, *names]
    schema = StructType([*docs.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType()), StructField(names[2], BooleanType())])
    at = docs.columns.index(text_column)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            severity, grades = graded(model, batch.column(at))
            new = [pa.array(severity, pa.float64()), pa.array(grades, pa.int32()), pa.array([g > 0 for g in grades], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], columns)

    return docs.mapInArrow(rows, schema)


def graded(model: Ordinal, texts: pa.Array, at_once: int = 500) -> tuple[list[float], list[int]]:
    """Expected severity and grade of each text."""
    scorer, severity, grades = Scorer(model), [], []
    for i in range(0, len(texts), at_once):
        counts = [word_counts(x or "") for x in texts.slice(i, at_once).to_pylist()]
        p = scorer.above(counts) * np.array([bool(c) for c in counts])[:, None]
        severity += p.sum(axis=1).tolist()
        grades += (p >= 0.5).sum(axis=1).tolist()
    return severity, grades


def accepted(docs: DataFrame, model: Ordinal, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject (grade 0), all columns as they are."""
    at = docs.columns.index(text_column)

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([g == 0 for g in graded(model, batch.column(at))[1]], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)
