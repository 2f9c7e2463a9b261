"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts; all texts together are the
unlabelled sample, good and bad in unknown places, with an estimated class
prior pi.  The non-negative risk

    R(g) = pi E_p[l(g)] + max(0, E_u[l(-g)] - pi E_p[l(-g)])

with the logistic loss l is minimised over a linear g in a text's shape
features (lengths, letter classes, repetition, symbol words; squares and all).
While the second part is not negative the risk is convex and takes Newton
steps; when it turns negative (overfitting to the positives) the step goes up
that part's own gradient instead, as the estimator's authors have it.

Spark computes features once, writes them to the shared folder and sums
gradient and Hessian over ALL unlabelled texts in each step; about a thousand
sums reach the driver, whatever the corpus.  Features never see labels, lang,
source or doc_id.

The prior is the good share among labelled training rows unless it is given.

Defined results: null and empty texts have zero features and get the score of
those; rows repeated in doc_id count each; a doc labelled twice is positive if
any label is; with no positive labels all scores are the prior (0 without any
labels); ``scored`` keeps all columns.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TokenTable, crc_mod, mix, text_slices, stored, text_of

STEPS, RIDGE, STEP_UP = 12, 1e-3, 0.1
SLICE_CHARS = 2 << 20
_SENTENCE_END = ".!?"


_MARKS = string.punctuation + "“”‘’…«»"
_PLAIN_TAILS = frozenset(".,;:!?)\"'”’")


def _describe(w: str):
    """Lengths and letter classes of one spelling, in the order of NAMES."""
    core = w if w.isalpha() else w.strip(_MARKS)
    if core.isalpha():
        letters, digits = len(core), 0
        upper = 0 if core.islower() else letters if core.isupper() else sum(map(str.isupper, core))
    else:
        letters, digits, upper = (sum(map(f, w)) for f in (str.isalpha, str.isdigit, str.isupper))
    tail, n = w[-1], len(w)
    odd_tail = letters > 0 and n > letters and not tail.isalnum() and tail not in _PLAIN_TAILS
    return (n, letters, digits, upper, not (letters or digits), odd_tail, letters > 1 and upper == letters,
            tail in _SENTENCE_END, tail == "!", not w.isascii(),
            n > letters and (w.count("!") > 1 or w.count("?") > 1))


N_COUNTS = 11
NAMES = ("log_words", "word_length", "letters", "digits", "upper", "bare_symbols", "odd_tails", "capitals",
         "sentence_ends", "exclaimed", "beyond_ascii", "repeated_marks", "distinct", "top_word", "adjacent",
         "symbols", "distinct_pairs")
D = 2 * len(NAMES) + 1


def features(texts: list[str], table: TokenTable) -> np.ndarray:
    """(texts, D): shape features, their squares and a constant."""
    table.fresh()
    rows, owner, lens = table.rows_of([t.split() for t in texts])
    described = table.columns()
    n = len(texts)
    one = np.maximum(lens, 1)
    sums = [np.bincount(owner, weights=c[rows].astype(np.float64), minlength=n) for c in described]
    chars, letters, digits, upper = sums[:4]
    many = np.maximum(chars, 1)
    pairs = owner.astype(np.int64) << 32 | rows
    distinct, count = np.unique(pairs, return_counts=True)
    whose = distinct >> 32
    n_distinct = np.bincount(whose, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, whose, count)
    inside = np.zeros(len(rows), bool)
    inside[1:] = owner[1:] == owner[:-1]
    same = np.zeros(len(rows), bool)
    same[1:] = inside[1:] & (rows[1:] == rows[:-1])
    follow = np.flatnonzero(inside)
    # Distinct neighbours of each text, by a 64-bit hash of (text, word, word).
    pair = mix(mix(owner[follow].astype(np.uint64)) ^ (rows[follow - 1] << 32 | rows[follow]).astype(np.uint64))
    bigram = owner[follow][np.unique(pair, return_index=True)[1]]
    f = np.stack([
        np.log1p(lens) / 10, chars / one / 10, letters / many, digits / many, upper / np.maximum(letters, 1),
        *(s / one for s in sums[4:N_COUNTS]), n_distinct / one, top / one,
        np.bincount(owner, weights=same, minlength=n) / one, (chars - letters - digits) / many,
        np.bincount(bigram, minlength=n) / np.maximum(lens - 1, 1)], axis=1)
    return np.hstack([f, f * f, np.ones((n, 1))])


def new_table() -> TokenTable:
    return TokenTable(_describe, (np.int32,) * 4 + (bool,) * (N_COUNTS - 4))


def feature_column(text: Column) -> Column:
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = new_table()
        for column in batches:
            out = [features(texts, table) for _, _, texts in text_slices(column, SLICE_CHARS)]
            flat = np.concatenate(out).ravel() if out else np.zeros(0)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, D), pa.int32()), pa.array(flat))
    return run(text)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float
    steps_up: int

    def value(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights


def _sums(rows: DataFrame, partial) -> dict[int, float]:
    """Sum the vectors that ``partial(features, positive)`` gives per batch:
    one small vector a batch, added up by Spark element by element."""
    def run(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column("f").flatten()).reshape(b.num_rows, -1)
                v = partial(x, np.asarray(b.column("positive").to_numpy(zero_copy_only=False), bool))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)],
                                             names=["i", "v"])
    return {r["i"]: r["v"] for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}


def _vector(sums: dict, n: int) -> np.ndarray:
    return np.array([sums.get(i, 0.0) for i in range(n)])


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def minimise(rows: DataFrame, prior: float, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """rows(f array<double>, positive boolean): every row is unlabelled, the
    positive ones are trusted as well."""
    def moments(x, pos):
        return np.concatenate([[len(x), pos.sum()], x.sum(0), (x * x).sum(0)])
    m = _vector(_sums(rows, moments), 2 + 2 * D)
    n_u, n_p = max(m[0], 1), m[1]
    mean, square = m[2:2 + D] / n_u, m[2 + D:] / n_u
    scale = np.sqrt(np.maximum(square - mean * mean, 0))
    scale[scale < 1e-9] = 1.0
    mean[-1], scale[-1] = 0.0, 1.0  # the constant stays
    if not n_p:
        odds = min(max(prior, 1e-9), 1 - 1e-9)
        return Model(mean, scale, np.append(np.zeros(D - 1), math.log(odds / (1 - odds))), prior, 0)
    w, penalty, up = np.zeros(D), np.append(np.full(D - 1, ridge), 1e-9), 0
    w[-1] = math.log(min(max(prior, 1e-3), 1 - 1e-3) / (1 - min(max(prior, 1e-3), 1 - 1e-3)))

    def terms(at):
        def partial(x, pos):
            z = (x - mean) / scale
            g = z @ at
            s = 1 / (1 + np.exp(-np.clip(g, -500, 500)))
            gp, zp, sp = g[pos], z[pos], s[pos]
            hess = (z.T * (s * (1 - s))) @ z
            return np.concatenate([
                [_softplus(g).sum(), _softplus(gp).sum(), _softplus(-gp).sum()],
                z.T @ s, zp.sum(0), zp.T @ sp, hess.ravel()])
        v = _vector(_sums(rows, partial), 3 + 3 * D + D * D)
        negative = v[0] / n_u - prior * v[1] / n_p  # E_u[l(-g)] - pi E_p[l(-g)]
        risk = prior * v[2] / n_p + max(0.0, negative) + 0.5 * (penalty * at * at).sum()
        grad_u, mean_p, grad_p = (v[3 + i * D:3 + (i + 1) * D] for i in range(3))
        full = grad_u / n_u - prior * mean_p / n_p + penalty * at
        upward = -(grad_u / n_u - prior * grad_p / n_p)
        return negative, risk, full, upward, v[3 + 3 * D:].reshape(D, D) / n_u + np.diag(penalty + 1e-9)

    negative, risk, full, upward, hess = terms(w)
    for _ in range(steps):
        if negative < 0:
            up += 1
            w = w - STEP_UP * upward
            negative, risk, full, upward, hess = terms(w)
            continue
        step, shrink = np.linalg.solve(hess, full), 1.0
        if full @ step < 1e-7:
            break
        while shrink > 0.05:
            found = terms(w - shrink * step)
            if found[1] <= risk or found[0] < 0:
                break
            shrink *= 0.3
        w = w - shrink * step
        negative, risk, full, upward, hess = found
    return Model(mean, scale, w, prior, up)


def training_rows(rows: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(f, positive) of rows(doc_id, f).  Positive: labelled good in a row whose
    crc32(doc_id) modulo ``folds`` is not ``held``.  Only ids and features
    move; rows without an id stay where they are."""
    good = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (crc_mod("doc_id", folds) != held))
            .select(F.col("doc_id").cast("bigint")).distinct().withColumn("positive", F.lit(True)))
    known = rows.where("doc_id is not null").join(good, "doc_id", "left").select(
        "f", F.coalesce("positive", F.lit(False)).alias("positive"))
    return known.unionByName(rows.where("doc_id is null").select("f", F.lit(False).alias("positive")))


def class_prior(labels: DataFrame, folds: int = 4, held: int = 2) -> float:
    rows = labels.where(F.col("quality").isin(0, 1) & (crc_mod("doc_id", folds) != held))
    return float(rows.agg(F.avg("quality").alias("p")).first()["p"] or 0.0)


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, f) of every row, written to the shared folder."""
    return stored(docs.select(F.col("doc_id").cast("bigint"), feature_column(text_of(text)).alias("f")), "features")


def fit(rows: DataFrame, labels: DataFrame, prior: float | None = None, folds: int = 4, held: int = 2) -> Model:
    """Learn from the ``featured`` rows of all texts."""
    prior = class_prior(labels, folds, held) if prior is None else prior
    return minimise(stored(training_rows(rows, labels, folds, held), "training"), prior)


def probability(value: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(value, -500, 500)))


def scored_rows(rows: DataFrame, model: Model, into: str = "quality_score") -> DataFrame:
    """``featured`` rows with their score instead of their features."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for f in batches:
            yield pa.array(probability(model.value(np.asarray(f.flatten()).reshape(len(f), D))))
    return rows.withColumn(into, run("f")).drop("f")


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "quality_score") -> DataFrame:
    """docs with the probability that the whole text is good; map-only."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = new_table()
        for column in batches:
            out = [model.value(features(texts, table)) for _, _, texts in text_slices(column, SLICE_CHARS)]
            value = np.concatenate(out) if out else np.zeros(0)
            yield pa.array(probability(value))
    return docs.withColumn(into, run(text_of(text)))
