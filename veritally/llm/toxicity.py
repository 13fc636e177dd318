"""Toxicity by weak supervision.

Many voters look at a document: the words of a seed lexicon and patterns, and a second lexicon of
words and stems that stand out in labelled training rows. A voter speaks for class 1 or abstains,
which says nothing (most voters know one language); one more voter speaks where all others are
silent. A generative model takes each to speak with its own rate under either class. Expectation
maximisation over labelled and unlabelled rows, whose labels it doesn't see, estimates these
rates and the correlations of voters beyond what the class explains; a voter's weight is one
through the number of voters that it is worth with those that speak along with it. A linear
classifier over word, stem and pattern indicators is then trained on the posterior labels, not
on the given ones, and scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritally.llm import textnum as tn
from veritally.llm.ngram_sets import fold, sample

STEMS = (4, 5, 6)
#: The bound of the rows that voters, label model and classifier are fitted on.
MAX_TRAIN, MAX_UNLABELLED = 4000, 2000
MAX_VOTERS, MIN_FIRES = 256, 4

#: Seed lexicon: common words of abuse.
LEXICON = (
    "idiot moron stupid loser scum trash pathetic worthless disgusting clown dumb fool jerk bastard "
    "idiota imbécil estúpido basura asqueroso imbecile stupide ordure débile connard "
    "dumm dummkopf trottel arschloch abschaum wertlos schwachkopf"
).split()

_letter = np.zeros(256, dtype=bool)
_letter[97:123] = True
_letter[128:] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit feature) with repeats: the words, stems and patterns of each row."""
    low = tn.lowered_latin(buf)
    s, e, ptr = tn.spans(_letter[low], off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(ptr))
    rows, found = [row], [tn.span_hashes(low, s, e)]
    with np.errstate(over="ignore"):
        for n in STEMS:
            has = e - s > n
            rows.append(row[has])
            found.append(tn.span_hashes(low, s[has], s[has] + n) * np.uint64(2 * n + 1))
    # patterns: two or more marks in a row, and runs of capitals
    for kind, member in ((101, buf == 33), (102, buf == 63), (103, (buf >= 65) & (buf <= 90))):
        a, b, p = tn.spans(member, off)
        rows.append(np.repeat(np.arange(len(off) - 1), np.diff(p))[b - a >= (2 if kind < 103 else 4)])
        found.append(np.full(len(rows[-1]), kind, np.uint64))
    return np.concatenate(rows), np.concatenate(found)


def _rows(texts) -> list[np.ndarray]:
    """The sorted distinct features of each of a bounded list of texts."""
    out = []
    for _, buf, off in tn.slices(pa.array(list(texts), pa.string())):
        row, own = features(buf, off)
        order = np.lexsort((own, row))
        row, own = row[order], own[order]
        new = np.append(True, (row[1:] != row[:-1]) | (own[1:] != own[:-1]))[: len(row)]
        row, own = row[new], own[new]
        ptr = np.searchsorted(row, np.arange(len(off)))
        out += [own[a:b] for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return out


def choose_voters(rows: list[np.ndarray], y: np.ndarray, n_all: int, seeds: np.ndarray) -> np.ndarray:
    """Voters among features 0 to n_all: the seeds (lexicon and patterns), all of them, and what best
    tells labelled rows (y 0 or 1; -1 for none) apart."""
    count = [np.bincount(np.concatenate([r for r, own in zip(rows, y, strict=True) if own == k] or [np.zeros(0, np.int64)]), minlength=n_all) for k in (0, 1)]
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    odds = np.log((count[1] + 0.5) / (n[1] + 1)) - np.log((count[0] + 0.5) / (n[0] + 1))
    good = np.flatnonzero((count[1] >= MIN_FIRES) & (odds > 3.5))
    good = good[np.argsort(-odds[good] * np.sqrt(count[1][good]), kind="stable")][:MAX_VOTERS]
    return np.unique(np.concatenate([good, seeds]))


@dataclass
class LabelModel:
    """Firing rates by class, weights from correlations, and the share of class 1."""

    rates: np.ndarray
    weights: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = np.log(self.prior / (1 - self.prior)) + votes @ (np.log(self.rates[1] / self.rates[0]) * self.weights)
        return 1 / (1 + np.exp(-np.clip(odds, -35, 35)))


def label_model(votes: np.ndarray, prior: float, weak: np.ndarray | None = None, rounds: int = 25) -> LabelModel:
    """Fits votes (rows x voters, 0 or 1; the last voter speaks for class 0) alone.

    prior is where the share of class 1 starts; weak voters (a mask) have no say in the start.
    """
    n, k = votes.shape
    prior = min(max(prior, 0.01), 0.99)
    # start from a vote: two voters that speak make class 1 likely
    q = np.array([0.02, 0.5, 0.95])[np.minimum((votes if weak is None else votes * ~weak)[:, :-1].sum(axis=1), 2).astype(int)]
    weights = np.ones(k)
    for _ in range(rounds):
        rates = np.stack([(((1 - q) @ votes) + 0.1) / ((1 - q).sum() + 1.0), ((q @ votes) + 0.1) / (q.sum() + 0.2)]).clip(1e-5, 1 - 1e-5)
        # a voter never speaks against its class
        rates[1, :-1], rates[0, -1] = np.maximum(rates[1, :-1], rates[0, :-1] * 1.01), max(rates[0, -1], rates[1, -1] * 1.01)
        # correlations of what the class leaves unexplained; of independent voters they are noise
        left = votes - (q[:, None] * rates[1] + (1 - q[:, None]) * rates[0])
        scale = np.sqrt((left**2).sum(axis=0)) + 1e-9
        linked = np.maximum((left / scale).T @ (left / scale) - 2 / np.sqrt(n), 0)
        np.fill_diagonal(linked, 0)
        beside = (votes * q[:, None]).T @ votes / np.maximum((votes * q[:, None]).sum(axis=0), 1e-9)[:, None]
        weights = 1 / (1 + (linked * beside).sum(axis=1))
        model = LabelModel(rates, weights, prior)
        new = model.posterior(votes)
        done = np.abs(new - q).max() < 1e-4
        q, prior = new, min(max(float(new.mean()), 0.01), 0.99)
        if done:
            break
    return LabelModel(rates, weights, prior)


@dataclass
class Model:
    """A linear classifier: sorted features, their weights, and the offset."""

    keys: np.ndarray
    weights: np.ndarray
    offset: float

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        total = np.full(len(off) - 1, self.offset)
        if len(self.keys):
            likely = np.zeros(1 << 16, dtype=bool)
            likely[self.keys >> np.uint64(48)] = True
            row, own = features(buf, off)
            some = likely[own >> np.uint64(48)]
            row, own = row[some], own[some]
            at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
            met = self.keys[at] == own
            hit = np.unique(row[met] * len(self.keys) + at[met])  # each feature of a row counts once
            total += np.bincount(hit // len(self.keys), self.weights[hit % len(self.keys)], minlength=len(total))
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(texts: list[str | None], y: np.ndarray) -> Model:
    """From a bounded number of texts with label 0, 1 or -1 (none); with one class or no labels, the
    constant of their share."""
    known = y[y >= 0]
    share = (known.sum() + 0.5) / (len(known) + 1) if len(known) else 0.0
    none = np.zeros(0, np.uint64)
    if len(set(known.tolist())) < 2:
        return Model(none, np.zeros(0), float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))))
    hashed = _rows(texts)
    # features of fewer than four rows have no use: most fall by the counts of their hashes' heads
    heads = np.zeros(1 << 24, np.int32)
    for r in hashed:
        np.add.at(heads, (r >> np.uint64(40)).astype(np.int64), 1)
    hashed = [r[heads[(r >> np.uint64(40)).astype(np.int64)] >= 4] for r in hashed]
    del heads
    lens = np.array([len(r) for r in hashed])
    keys, flat = np.unique(np.concatenate(hashed), return_inverse=True)
    rows = np.split(flat, np.cumsum(lens)[:-1])
    # near copies would make chance words stand out: of rows with the same three least rare
    # features one stays (unrelated rows may share one, hardly three)
    met = np.bincount(flat)
    rare = (met > 1) & (met <= 64)
    heads = [r[rare[r]][:3].tolist() for r in rows]
    least = np.array([(h[0] * len(met) + h[1]) * len(met) + h[2] if len(h) == 3 else -1 - i for i, h in enumerate(heads)], dtype=object)
    least = np.array([hash(x) for x in least.tolist()])
    order = np.argsort(-y, kind="stable")  # of near copies a labelled one stays
    first = order[np.unique(least[order], return_index=True)[1]]
    first.sort()
    y, lens, rows = y[first], lens[first], [rows[i] for i in first]
    flat = np.concatenate(rows)
    seeds = np.concatenate([tn.span_hashes(b, np.array([0]), np.array([len(b)])) for b in (np.frombuffer(w.encode(), np.uint8) for w in LEXICON)])
    seeds = np.concatenate([seeds, np.array([101, 102, 103], np.uint64)])  # and the patterns
    voters = choose_voters(rows, y, len(keys), np.flatnonzero(np.isin(keys, seeds)))
    votes = np.stack([np.isin(voters, r) for r in rows]).astype(np.float64)
    weak = np.append(keys[voters] < 1000, False)  # patterns: many texts of either class have them
    votes = np.concatenate([votes, votes[:, ~weak[:-1]].sum(axis=1, keepdims=True) == 0], axis=1)
    q = label_model(votes, float(share), weak).posterior(votes)
    # the classifier sees features that lean to class 1 by the posterior labels
    yes = np.bincount(flat, np.repeat(q, lens), minlength=len(keys))
    no = np.bincount(flat, np.repeat(1 - q, lens), minlength=len(keys))
    lean = np.log((yes + 0.5) / (q.sum() + 1)) - np.log((no + 0.5) / ((1 - q).sum() + 1))
    use = (yes + no >= 4) & (lean > 2.0)
    keys, place = keys[use], np.cumsum(use) - 1
    own, row_of = place[flat[use[flat]]], np.repeat(np.arange(len(rows)), lens)[use[flat]]
    w, b = np.zeros(len(keys)), float(np.log(q.mean() / (1 - q.mean())))
    pace = 1 / np.sqrt(np.maximum(np.bincount(own, minlength=len(keys)), 1))
    for _ in range(1000):  # full-batch logistic steps, slower for features that are met often
        z = np.bincount(row_of, w[own], minlength=len(rows)) + b
        error = q - 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        w = np.maximum(w + 0.5 * (np.bincount(own, error[row_of], minlength=len(keys)) * pace - 0.002 * w), 0)
        b += 2.0 * error.mean()
    return Model(keys[w > 0], w[w > 0], b)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train: int = MAX_TRAIN, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text, ...).

    Labels (doc_id, toxic 0/1) are learnt only from rows whose fold of 3 isn't 1. A null text is
    scored as an empty one; rows without doc_id are scored and not held out; of labels that
    repeat a doc_id the greatest counts, and of texts that do the least is learnt from. Texts
    without labels that the label model sees are of rows that aren't held out either. Other
    columns are ignored.
    """
    learnt = fold(F.col("doc_id"), 3) != 1
    rows = sample(docs.select("doc_id", "text").where(learnt), labels.where(learnt), "toxic", max_train, unlabelled=max_unlabelled)
    model = fit(rows["text"].tolist(), rows["toxic"].fillna(-1).to_numpy().astype(int))
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for first, buf, off in tn.slices(batch.column(1)):
                out[first : first + len(off) - 1] = model.scores(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=["doc_id", "score"])

    out = docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())]))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
