"""Toxicity by a subsequence string-kernel support vector machine.

The kernel of two words counts their common subsequences of ``ORDER`` letters,
each weighted by ``DECAY`` to the power of the span it covers in both, and is
normalised; ``idxiot`` or ``stuupid`` still match their insult.  Words are
read by their letters and digits alone (``i-d-i-o-t!``).  Landmarks are the
words that tell toxic from clean labelled texts best.  A sentence is the
sum of its words' kernel values with every landmark (a convolution kernel),
mapped by the Nystroem factor K^(-1/2) of the landmark kernel, and judged by a
linear SVM (squared hinge).

Training sentences come from at most ``FIT_ROWS`` labelled texts of each class,
from each the ``SENTENCES`` with the most support and one for all without.
A toxic text is known to hold a toxic sentence, not which one: in each round
its best sentence so far is its positive example; sentences of clean texts are
negatives.  The values of a text's ``TOP`` best sentences are turned into a
probability by Platt scaling with the classes weighted back to the labels'
proportions: one plain insult is enough, several doubtful words add up.

A word counts for a landmark only if their longest common subsequence has at
least ``SUPPORT`` of the landmark's letters (and ORDER); otherwise the kernel
is taken as zero.  That is decided for whole vocabularies at once: letter masks
first, then a bit-parallel common-subsequence count.  Runs of three and more
single-character words are also read as one word (``i d i o t``).  Words longer
than ``WIDTH`` are read in overlapping windows, so no text is cut.

Defined results: null and empty texts have no sentences and get the score of
the bias alone; without labelled rows of both classes every score is the
labels' toxic share (0 if there are none); of a labelled id's several texts the
smallest is learnt from; all columns are kept, ties among landmark candidates
go to the smaller word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TokenTable, labelled_sample, slices_by_bytes, text_slices, text_of

ORDER, DECAY, SUPPORT = 3, 0.7, 0.75
FIT_ROWS, CANDIDATES, LANDMARKS, ALIKE = 4000, 1000, 128, 0.97
STRENGTH, TOP, SENTENCES = 5.0, 3, 8
WIDTH = 24
SLICE_CHARS = 2 << 20
ROUNDS = 3
_SPLIT = r"[^\p{L}\p{N}]+"


# ------------------------------------------------------------------ the kernel
def codes(words: list[str], width: int) -> np.ndarray:
    return np.array(words, f"<U{width}").view(np.uint32).reshape(len(words), width) if words else np.zeros(
        (0, width), np.uint32)


def used(matrix: np.ndarray) -> int:
    """Columns up to the longest word."""
    filled = np.flatnonzero(matrix.any(axis=0)) if matrix.size else []
    return int(filled[-1]) + 1 if len(filled) else 0


def subsequence_kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of every row pair of two code matrices (0: padding)."""
    s, t = s[:, :used(s)], t[:, :used(t)]
    n, width = s.shape
    other = t.shape[1]
    prefix = [np.ones((n, other + 1))] + [np.zeros((n, other + 1)) for _ in range(order - 1)]
    total = np.zeros(n)
    for p in range(width):
        letter = s[:, p]
        live = letter != 0
        if not live.any():
            break
        match = (t == letter[:, None]) & live[:, None]
        total += decay * decay * (prefix[order - 1][:, :other] * match).sum(axis=1)
        for i in range(order - 1, 0, -1):
            run, updated = np.zeros(n), prefix[i] * decay
            for q in range(other):
                run = decay * run + decay * decay * match[:, q] * prefix[i - 1][:, q]
                updated[:, q + 1] += run
            prefix[i] = np.where(live[:, None], updated, prefix[i])
    return total


def normalised(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    norm = np.sqrt(subsequence_kernel(s, s) * subsequence_kernel(t, t))
    return np.divide(subsequence_kernel(s, t), norm, out=np.zeros(len(s)), where=norm > 0)


class Landmarks:
    def __init__(self, words: list[str]):
        self.words = words
        self.codes = codes(words, max([1, *map(len, words)]))
        self.own = subsequence_kernel(self.codes, self.codes)
        self.need = [max(ORDER, math.ceil(SUPPORT * len(w))) for w in words]
        self.least = min(self.need, default=ORDER)
        # Letters by small numbers, 0 for letters of no landmark; a bit per letter (64 and more share one).
        letters = sorted({c for w in words for c in w})
        self.known = np.array([ord(c) for c in letters], np.uint32)
        number = {c: i + 1 for i, c in enumerate(letters)}
        self.bit = np.array([0] + [1 << (i & 63) for i in range(len(letters))], np.uint64)
        self.tables = []
        for w in words:
            table = np.zeros(len(letters) + 1, np.uint64)
            for i, c in enumerate(w):
                table[number[c]] |= np.uint64(1 << i)
            self.tables.append(table)
        self.masks = [np.bitwise_or.reduce(self.bit[[number[c] for c in w]]) for w in words]

    def _numbers(self, matrix: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, matrix), len(self.known) - 1)
        return np.where(self.known[at] == matrix, at + 1, 0).astype(np.uint16)

    def forms(self, forms: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(form, landmark, kernel) of the supported pairs of some distinct
        words of at most WIDTH letters."""
        matrix = codes(forms, WIDTH)
        numbers = self._numbers(matrix)
        letters = np.bitwise_or.reduce(self.bit[numbers], axis=1)
        rows, cols = [], []
        for m, word in enumerate(self.words):
            spare = len(word) - self.need[m]
            at = np.flatnonzero(np.bitwise_count(letters & self.masks[m]) >= max(
                1, int(np.bitwise_count(self.masks[m])) - spare))
            if len(at):
                at = at[common_length(numbers[at], self.tables[m], len(word)) >= self.need[m]]
                rows.append(at)
                cols.append(np.full(len(at), m))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        r, c = np.concatenate(rows), np.concatenate(cols)
        order = np.argsort((matrix[r] != 0).sum(axis=1), kind="stable")  # short words together
        r, c = r[order], c[order]
        out = np.zeros(len(r))
        for lo in range(0, len(r), 20_000):
            x, y = r[lo:lo + 20_000], c[lo:lo + 20_000]
            one, back = np.unique(x, return_inverse=True)
            norm = np.sqrt(subsequence_kernel(matrix[one], matrix[one])[back] * self.own[y])
            out[lo:lo + 20_000] = np.divide(subsequence_kernel(matrix[x], self.codes[y]), norm, out=np.zeros(len(x)),
                                            where=norm > 0)
        return r, c, out

    def supported(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index, kernel row) of the words that any landmark supports."""
        forms: dict[str, int] = {}
        owner, form = [], []
        for i, w in enumerate(words):
            if not w.isalnum():
                w = "".join(filter(str.isalnum, w))
            if len(w) < self.least:
                continue
            for piece in (w,) if len(w) <= WIDTH else [w[j:j + WIDTH] for j in range(0, len(w) - WIDTH // 2, WIDTH // 2)]:
                owner.append(i)
                form.append(forms.setdefault(piece, len(forms)))
        none = np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        if not forms or not self.words:
            return none
        r, c, k = self.forms(list(forms))
        if not len(r):
            return none
        place = np.full(len(forms), -1)
        hit = np.unique(r)
        place[hit] = np.arange(len(hit))
        rows = np.zeros((len(hit), len(self.words)), np.float32)
        rows[place[r], c] = k
        owner, at = np.array(owner), place[np.array(form)]
        owner, at = owner[at >= 0], at[at >= 0]
        found, back = np.unique(owner, return_inverse=True)
        out = np.zeros((len(found), len(self.words)), np.float32)
        np.maximum.at(out, back, rows[at])
        return found, out

    def kernel(self, words: list[str]) -> np.ndarray:
        """(words, landmarks) kernel values, zero without support."""
        out = np.zeros((len(words), len(self.words)), np.float32)
        at, rows = self.supported(words)
        out[at] = rows
        return out


def common_length(numbers: np.ndarray, table: np.ndarray, length: int) -> np.ndarray:
    """Longest common subsequence of rows of letter numbers (0 counts for
    nothing) with one word of at most 64 letters, whose ``table`` has the bits
    of every letter's places."""
    full = np.uint64((1 << length) - 1)
    state = np.full(len(numbers), full)
    with np.errstate(over="ignore"):
        for p in range(used(numbers)):
            hit = table[numbers[:, p]]
            both = state & hit
            state = ((state + both) | (state & ~hit)) & full
    return length - np.bitwise_count(state).astype(np.int64)


# ------------------------------------------------------------------ sentences
_ENDS = (".", "!", "?", "…", "。")  # fixed values


def _describe(word: str):
    return word[-1] in _ENDS, len(word) == 1


class Reader:
    """Finds the sentences of texts that hold a supported word."""

    def __init__(self, marks: Landmarks):
        self.marks = marks
        self.table = TokenTable(_describe, (bool, bool))
        self.known: dict[int, np.ndarray] = {}
        self.checked = 0

    def sentences(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(text index, pooled kernel row) of every sentence with support."""
        if len(self.table) > self.table.most:
            self.table.fresh()
            self.known, self.checked = {}, 0
        words = [t.lower().split() for t in texts]
        rows, owner, lens = self.table.rows_of(words)
        ends, single = self.table.columns()
        if len(self.table) > self.checked:  # dicts keep their order: the new spellings are the last ones
            new = list(islice(self.table, self.checked, None))
            for i, k in zip(*self.marks.supported(new)):
                self.known[self.checked + int(i)] = k
            self.checked = len(self.table)
        first = np.zeros(len(rows), bool)
        first[np.concatenate([[0], np.cumsum(lens)[:-1]])[lens > 0].astype(np.int64)] = True
        starts = first.copy()
        starts[1:] |= ends[rows[:-1]]
        sentence = np.cumsum(starts)
        hit = np.zeros(len(self.table) + 1, bool)
        hit[list(self.known)] = True
        at = np.flatnonzero(hit[rows])
        found = [(sentence[i], owner[i], self.known[int(rows[i])]) for i in at]
        found += self._spelt_out(words, rows, owner, sentence, single)
        pooled: dict[int, list] = {}
        for s, o, k in found:
            if s in pooled:
                pooled[s][1] = pooled[s][1] + k
            else:
                pooled[s] = [o, k]
        values = list(pooled.values())
        return (np.array([v[0] for v in values], np.int64),
                np.array([v[1] for v in values], np.float32).reshape(len(values), len(self.marks.words)))

    def _spelt_out(self, words, rows, owner, sentence, single) -> list:
        """Runs of three and more one-character words, read as one word."""
        alone = single[rows].astype(np.int8) if len(rows) else np.zeros(0, np.int8)
        if not alone.any():
            return []
        edge = np.diff(np.concatenate([[0], alone, [0]]))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= ORDER
        flat, runs = None, []
        for b, e in zip(begin[long], end[long]):
            if flat is None:
                flat = [w for ws in words for w in ws]
            cuts = [b] + [i for i in range(b + 1, e) if owner[i] != owner[i - 1]] + [e]
            runs += [(x, "".join(flat[x:y])) for x, y in zip(cuts, cuts[1:]) if y - x >= ORDER]
        if not runs:
            return []
        k = self.marks.kernel([w for _, w in runs])
        return [(sentence[x], owner[x], k[i]) for i, (x, _) in enumerate(runs) if k[i].any()]


# ------------------------------------------------------------------ the model
@dataclass(frozen=True)
class Model:
    landmarks: tuple[str, ...]
    weights: np.ndarray  # on raw kernel rows: K^(-1/2) w
    bias: float
    slopes: np.ndarray  # of the best, second best, ... sentence
    offset: float

    def value(self, kernels: np.ndarray) -> np.ndarray:
        return kernels @ self.weights + self.bias

    def probability(self, best: np.ndarray) -> np.ndarray:
        """best: (texts, TOP) values, the largest first."""
        return 1 / (1 + np.exp(-np.clip(best @ self.slopes + self.offset, -500, 500)))


def best_values(value: np.ndarray, owner: np.ndarray, n: int, bias: float) -> np.ndarray:
    """(n, TOP) largest sentence values of each text; sentences without
    support, of which every text has some, hold ``bias``."""
    out = np.full((n, TOP), bias)
    order = np.lexsort((-value, owner))
    o, v = owner[order], value[order]
    first = np.searchsorted(o, o, "left")
    rank = np.arange(len(o)) - first
    keep = (rank < TOP) & (v > bias)
    out[o[keep], rank[keep]] = v[keep]
    return out


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, steps: int = 30) -> np.ndarray:
    """Linear SVM in the primal by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], 1.0)
    ridge[-1] = 1e-3
    for _ in range(steps):
        margin = 1 - y * (x @ w)
        on = margin > 0
        grad = ridge * w - c * (x[on].T @ (weight[on] * y[on] * margin[on]))
        hess = np.diag(ridge) + c * (x[on].T * weight[on]) @ x[on]
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def platt(best: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    x = np.hstack([best, np.ones((len(best), 1))])
    w = np.zeros(x.shape[1])
    target = np.where(y > 0, 1 - 1e-3, 1e-3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - target)) + 1e-5 * w
        hess = (x.T * (weight * p * (1 - p))) @ x + 1e-5 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(hess, grad), -3, 3)
    return w[:-1], float(w[-1])


def choose_landmarks(rows: list, n_toxic: int, n_clean: int, most: int = LANDMARKS) -> list[str]:
    """rows: (word, toxic texts, clean texts) with the strongest first."""
    chosen: list[str] = []
    for word, toxic, clean in rows:
        if toxic * n_clean <= 3 * clean * n_toxic:  # three times as frequent at least
            continue
        if chosen:
            width = max(map(len, [word, *chosen]))
            k = normalised(codes([word] * len(chosen), width), codes(chosen, width))
            if k.max() > ALIKE:
                continue
        chosen.append(word)
        if len(chosen) == most:
            break
    return chosen


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, folds: int = 4, held: int = 2) -> Model:
    """Learn from at most ``fit_rows`` labelled texts of each class (rows whose
    crc32(doc_id) modulo ``folds`` is ``held`` are never looked at)."""
    sample = labelled_sample(labels, "toxic", fit_rows, folds, held)
    share = labels.where(F.col("toxic").isin(0, 1)).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held)
    share = share.agg(F.avg("toxic").alias("s")).first()["s"] or 0.0
    rows = (docs.select(F.col("doc_id").cast("bigint"), text_of("text").alias("text"))
            .join(F.broadcast(sample), "doc_id")  # at most 2 * fit_rows ids
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))
    words = F.array_distinct(F.split(F.lower("text"), _SPLIT))
    counted = (rows.select("label", F.explode(words).alias("word"))
               .where(F.char_length("word").between(ORDER, WIDTH))
               .groupBy("word").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        odds = min(max(share, 1e-9), 1 - 1e-9)
        return Model((), np.zeros(0), 0.0, np.zeros(TOP), math.log(odds / (1 - odds)))
    # Signed root of the likelihood ratio of the word's rates in both classes.
    t, c = F.col("t") + 0.5, F.col("c") + 0.5
    rate = (t + c) / (n_toxic + n_clean + 1.0)
    strength = t * F.log(t / (rate * (n_toxic + 0.5))) + c * F.log(c / (rate * (n_clean + 0.5)))
    best = (counted.where(t / (n_toxic + 0.5) > c / (n_clean + 0.5)).select("word", "t", "c", strength.alias("s"))
            .where(F.col("s") >= STRENGTH).orderBy(F.desc("s"), "word").limit(CANDIDATES).collect())
    marks = choose_landmarks([(r["word"], r["t"], r["c"]) for r in best], n_toxic, n_clean)
    if not marks:
        return Model((), np.zeros(0), 0.0, np.zeros(TOP), math.log(max(share, 1e-9) / (1 - min(share, 1 - 1e-9))))
    # At most 2 * fit_rows * (SENTENCES + 1) rows of LANDMARKS four-byte numbers: 37 MB.
    found = rows.mapInArrow(_training_rows(tuple(marks)), "doc_id bigint, label int, kernel binary").toArrow()
    doc, label = found["doc_id"].to_numpy(), found["label"].to_numpy()
    kernel = np.frombuffer(b"".join(found["kernel"].to_pylist()), np.float32).reshape(len(doc), -1)
    del found
    return _learn(marks, doc, label, kernel, share, n_toxic, n_clean)


def _training_rows(marks: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Landmarks(list(marks)))
        for b in batches:
            texts = b.column("text").to_pylist()
            ids, label = b.column("doc_id").to_pylist(), b.column("label").to_pylist()
            for lo, hi in slices_by_bytes(np.fromiter(map(len, texts), np.int64, len(texts)), SLICE_CHARS):
                owner, kernel = reader.sentences(texts[lo:hi])
                order = np.lexsort((-kernel.sum(axis=1), owner))
                owner, kernel = owner[order], kernel[order]
                few = np.arange(len(owner)) - np.searchsorted(owner, owner, "left") < SENTENCES
                # Every text has one row without support, standing for its other sentences.
                kernel = np.vstack([kernel[few], np.zeros((hi - lo, len(marks)), np.float32)])
                at = np.concatenate([owner[few], np.arange(hi - lo)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo + i] for i in at], pa.int64()), pa.array([label[lo + i] for i in at], pa.int32()),
                     pa.array([k.tobytes() for k in kernel.astype(np.float32)], pa.binary())],
                    names=["doc_id", "label", "kernel"])
    return run


def _learn(marks, doc, label, kernel, share, n_toxic, n_clean) -> Model:
    order = np.argsort(doc, kind="stable")
    doc, label, kernel = doc[order], label[order], kernel[order]
    _, at, member = np.unique(doc, return_index=True, return_inverse=True)
    toxic = label[at]
    width = max(map(len, marks))
    pair = np.array([(i, j) for i in range(len(marks)) for j in range(len(marks))])
    c = codes(list(marks), width)
    gram = normalised(c[pair[:, 0]], c[pair[:, 1]]).reshape(len(marks), -1)
    value, vector = np.linalg.eigh(gram)
    factor = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = kernel @ factor.astype(np.float32)
    score = kernel.sum(axis=1)
    pos_weight, neg_weight = share / n_toxic, (1 - share) / n_clean
    for _ in range(ROUNDS):
        top = np.zeros(len(doc), bool)
        rank = np.lexsort((-score, member))
        lead = np.ones(len(rank), bool)
        lead[1:] = member[rank][1:] != member[rank][:-1]
        top[rank[lead]] = True
        use = (label == 0) | top
        y = np.where(label[use] == 1, 1.0, -1.0)
        weight = np.where(y > 0, pos_weight, neg_weight)
        w = squared_hinge(x[use], y, weight, c=200.0)
        score = x @ w[:-1] + w[-1]
    bias = float(w[-1])
    slopes, offset = platt(best_values(score, member, len(at), bias), toxic,
                           np.where(toxic == 1, pos_weight, neg_weight))
    return Model(tuple(marks), factor @ w[:-1], bias, slopes, offset)


def scored(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with the probability that the whole text is toxic; map-only."""
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(Landmarks(list(model.landmarks)))
        for column in batches:
            best = np.full((len(column), TOP), model.bias)
            for lo, hi, texts in text_slices(column, SLICE_CHARS):
                if model.landmarks:
                    owner, kernel = reader.sentences(texts)
                    best[lo:hi] = best_values(model.value(kernel), owner, hi - lo, model.bias)
            yield pa.array(model.probability(best))
    return docs.withColumn(into, run(text_of(text)))
