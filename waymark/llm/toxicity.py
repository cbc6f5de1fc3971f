"""Toxicity scores by weak supervision.

1. Voters.  From a bounded sample of labelled training rows, words (lexicon voters), word beginnings and beginnings
   of two different words (pattern voters) that mark toxic texts are mined by a likelihood-ratio test, in which copies of
   a text count once.  From all that are significant, voters are chosen one by one, each for the toxic texts that don't
   yet hold two chosen ones, so that words which toxic texts only share because they are copies of each other stay out.  Some style voters and a voter for texts without any
   hit join them.  A voter votes or abstains.
2. Label model.  A two-class generative model estimates how often each voter votes in either class, by expectation
   maximisation over the votes, with the rates among the labelled rows as prior; correlations that remain between voters within a class lower the weight of
   each in the second fit, so that near copies of a voter don't count twice.
3. Classifier.  A logistic regression is trained on the posterior labels, with votes and hit densities as inputs,
   and scores every whole text.  Neither labels nor language, source or id are inputs.

The sample's size (TRAIN_ROWS) is a parameter; all else covers all rows, and voters are chosen until none is significant.

Defined cases: null counts as empty; an empty text gets the score of a text without hits; without training labels
of both classes every score is the share of toxic labels (0 without labels) and so below the threshold, or the
share alone decides; repeated labels of a document count once, the larger one; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from waymark.llm.common import Scope, map_arrow, materialize
from waymark.llm.tokens import slices

TRAIN_ROWS = 20_000
#: Of the likelihood-ratio statistic, for a mined voter: odds of about 10^-6 for a term that marks nothing.
SIGNIFICANT = 24.0
SUPPORT = 3
#: A mined voter marks at least this share of the toxic texts.
SHARE = 0.02
#: And of the labelled texts that it marks, at least this share is toxic.
PRECISION = 0.8
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3
HELD_OUT = 2
_WORD = re.compile(r"[^\W\d_]+")
STYLES = 3
#: Terms that a task counts before it hands them on.
HELD_TERMS = 150_000


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def starts_of(words: set[str], length: int) -> dict[str, int]:
    """How many of the ``words`` longer than ``length`` begin with each string of that length."""
    out: dict[str, int] = {}
    for w in words:
        if len(w) > length:
            out[w[:length]] = out.get(w[:length], 0) + 1
    return out


def terms_of(words: set[str]) -> set[str]:
    """Words, beginnings of longer words (marked with a star), and of two different ones (two stars)."""
    out = set(words)
    for n in PREFIXES:
        for p, c in starts_of(words, n).items():
            out.add(p + "*")
            if c > 1:
                out.add(p + "**")
    return out


def styles(text: str, words: set[str]) -> list[bool]:
    n = max(1, len(words))
    capitals = sum(map(str.isupper, text))
    return [text.count("!") > n / 5, capitals * 2 > len(text), text.count("?") > n / 5]


@dataclass
class Model:
    """Terms by kind, and the classifier's weights: bias, votes, log of distinct hits, hits in 100 distinct words."""

    words: dict[str, int] = field(default_factory=dict)
    once: dict[int, dict[str, int]] = field(default_factory=dict)
    twice: dict[int, dict[str, int]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    base: float = 0.0

    @classmethod
    def of(cls, terms: list[str], base: float) -> Model:
        m = cls(base=base)
        for i, t in enumerate(terms):
            if t.endswith("**"):
                m.twice.setdefault(len(t) - 2, {})[t[:-2]] = i
            elif t.endswith("*"):
                m.once.setdefault(len(t) - 1, {})[t[:-1]] = i
            else:
                m.words[t] = i
        return m

    @property
    def n_terms(self) -> int:
        return len(self.words) + sum(map(len, self.once.values())) + sum(map(len, self.twice.values()))

    def hits(self, words: set[str]) -> tuple[list[int], int]:
        """The terms that hold, and how many words take part."""
        found = [self.words[w] for w in words & self.words.keys()]
        n = len(found)
        for size in self.once.keys() | self.twice.keys():
            one, two = self.once.get(size, {}), self.twice.get(size, {})
            some = {p: c for p, c in starts_of(words, size).items() if p in one or p in two}
            for p, c in some.items():
                if p in one:
                    found.append(one[p])
                    n += c
                if p in two and c > 1:
                    found.append(two[p])
                    n += c
        return found, n

    def votes(self, text: str) -> tuple[np.ndarray, float]:
        """Votes of all voters (terms, styles, none), and hits in 100 distinct words."""
        words = words_of(text)
        out = np.zeros(self.n_terms + STYLES + 1)
        found, n = self.hits(words)
        out[found] = 1
        out[self.n_terms : self.n_terms + STYLES] = styles(text, words)
        out[-1] = not found
        return out, 100.0 * n / max(1, len(words))

    def features(self, votes: np.ndarray, density: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(votes)), votes, np.log1p(votes[:, : self.n_terms].sum(axis=1)), np.minimum(density, 20) / 10])

    def score(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.base)
        got = [self.votes(t) for t in texts]
        x = self.features(np.array([v for v, _ in got]), np.array([d for _, d in got]))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def evidence(a: float, b: float, toxic: int, clean: int, share: float = SHARE) -> float:
    """Likelihood-ratio statistic of a term in ``a`` of the toxic and ``b`` of the clean texts; 0 if it doesn't mark toxic ones."""
    if a < max(SUPPORT, share * toxic) or a < PRECISION * (a + b) or (a + 0.5) / (toxic + 1) < 5 * (b + 0.5) / (clean + 1):
        return 0.0
    n, g = toxic + clean, 0.0
    for x, row, col in ((a, toxic, a + b), (toxic - a, toxic, n - a - b), (b, clean, a + b), (clean - b, clean, n - a - b)):
        if x:
            g += 2 * x * math.log(x * n / (row * col))
    return g


def candidates(counts: list[tuple[str, int, int]], toxic: int, clean: int) -> list[str]:
    """All terms that mark toxic texts significantly, the best first, from (term, toxic texts, clean texts)."""
    scored = sorted((-evidence(a, b, toxic, clean), -len(t.rstrip("*")), t) for t, a, b in counts)
    return [t for g, _, t in scored if -g >= SIGNIFICANT]


def choose(held: list[list[int]], marked: list[bool], terms: list[str]) -> list[int]:
    """Of the candidate ``terms``, those that mark toxic texts which hold fewer than two chosen ones.

    ``held`` lists each text's candidates.  Of terms that begin alike, so that one word holds both, one is chosen.
    """
    stems = [t.rstrip("*") for t in terms]
    open_ = set(range(len(terms)))
    toxic = [set(h) for h, y in zip(held, marked, strict=True) if y]
    clean = Counter(i for h, y in zip(held, marked, strict=True) if not y for i in set(h))
    counts = Counter(i for h in toxic for i in h)  # of the texts that still need some
    n_clean, need, chosen = len(marked) - len(toxic), [2] * len(toxic), []
    while True:
        best = max(((evidence(counts[i], clean[i], len(toxic), n_clean, 0.0), -i) for i in open_), default=(0, 0))
        if best[0] < SIGNIFICANT:
            break
        chosen.append(-best[1])
        stem = stems[-best[1]]
        open_ = {i for i in open_ if not (stems[i].startswith(stem) or stem.startswith(stems[i]))}
        for n, h in enumerate(toxic):
            if need[n] and -best[1] in h:
                need[n] -= 1
                if not need[n]:
                    counts.subtract(h)
    return chosen


def label_model(votes: np.ndarray, start: np.ndarray, prior: np.ndarray | None = None, strength: tuple[float, float] = (0.0, 0.0), rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, each voter's rates in both classes, and its weight.

    ``start`` holds first posteriors; ``prior`` the rates that are expected in the clean and the toxic class, which
    count as so many rows as ``strength`` says.  Without them, a class could drift to the largest group of voters
    that agree, such as those of one language.  Voters that nearly always vote alike share one vote.  After a first fit, the
    correlations that are left within the classes give each voter the weight 1 / (1 + their sum), and the fit is repeated.
    """
    n, m = votes.shape
    spread = votes - votes.mean(axis=0)
    norm = np.sqrt((spread**2).sum(axis=0)) + 1e-9
    weight, post = 1 / np.maximum(1, (spread.T @ spread / np.outer(norm, norm) > 0.9).sum(axis=1)), start.copy()  # copies share one vote

    def fit(post):
        rates = np.zeros((2, m))
        for _ in range(rounds):
            for c, p in enumerate((1 - post, post)):
                known = strength[c] * prior[c] if prior is not None else 0.0
                rates[c] = (votes.T @ p + known + 0.05) / (p.sum() + strength[c] + 0.1)
            rates[:] = np.clip(rates, 1e-4, 1 - 1e-4)
            share = np.clip(post.mean(), 1e-3, 0.5)
            odds = np.log(share / (1 - share)) + (votes * (weight * np.log(rates[1] / rates[0]))).sum(axis=1)
            odds += ((1 - votes) * (weight * np.log((1 - rates[1]) / (1 - rates[0])))).sum(axis=1)
            new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        return new, rates

    post, rates = fit(post)
    left = votes - (post[:, None] * rates[1] + (1 - post[:, None]) * rates[0])
    size = np.sqrt((left**2).sum(axis=0)) + 1e-9
    corr = np.abs(left.T @ left / np.outer(size, size))
    np.fill_diagonal(corr, 0)
    weight = 1 / (1 + np.where(corr > 0.1, corr, 0).sum(axis=1))
    post, rates = fit(post)
    return post, rates, weight


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton steps."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        scale = min(1.0, 5 / (np.abs(step).max() + 1e-12))
        w -= scale * step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Mine voters, fit the label model and train the classifier on at most ``rows`` labelled rows that aren't held out."""
    with Scope(docs.sparkSession):
        return _train(docs, labels, doc_id, text, rows)


def _train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows: int) -> Model:
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_w_id")).agg(F.max("toxic").alias("toxic"))
        .where(~held_out(F.col("_w_id")))
    )
    marked = marked.orderBy(F.xxhash64("_w_id"), "_w_id").limit(rows)
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = materialize(sample.join(F.broadcast(marked), F.col("doc_id") == F.col("_w_id")).select("text", "toxic"), "toxic-sample")  # at most ``rows`` ids
    sizes = {r[0]: r[1] for r in sample.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    model = Model(base=toxic / max(1, toxic + clean))
    if not toxic or not clean:
        return model

    single = materialize(sample.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxic-single")  # copies tell nothing twice
    sizes = {r[0]: r[1] for r in single.groupBy((F.col("toxic") > 0).alias("y")).count().collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not clean:
        return model

    def mine(batches):
        both = Counter(), Counter()
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                both[y > 0].update(terms_of(words_of(t)))
                if len(both[0]) + len(both[1]) > HELD_TERMS:
                    yield from emit(*both)
                    both = Counter(), Counter()
        yield from emit(*both)

    def emit(c, t):
        terms = list(t | c)
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array([t[x] for x in terms], pa.int64()), pa.array([c[x] for x in terms], pa.int64())], ["term", "a", "b"]
        )

    counts = map_arrow(single, mine, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    strong = counts.where(
        (F.col("a") >= max(SUPPORT, SHARE * toxic)) & (F.col("a") >= PRECISION * (F.col("a") + F.col("b")))
        & ((F.col("a") + 0.5) * (clean + 1) >= (F.col("b") + 0.5) * 5 * (toxic + 1))
    )
    terms = candidates([tuple(r) for r in strong.collect()], toxic, clean)  # each in a share of the toxic texts: at most terms of a text / SHARE
    first = Model.of(terms, model.base)

    def hold(batches):
        for b in batches:
            got = [sorted(first.hits(words_of(t))[0]) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.int32())), pa.array([y > 0 for y in b.column(1).to_pylist()])], ["held", "marked"])

    known = map_arrow(single, hold, "held array<int>, marked boolean").toArrow()  # at most ``rows`` rows
    chosen = choose(known.column(0).to_pylist(), known.column(1).to_pylist(), terms)
    model = Model.of([terms[i] for i in chosen], model.base)

    def vote(batches):
        for b in batches:
            got = [model.votes(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bytes(v.astype(np.uint8)) for v, _ in got], pa.binary()), pa.array([d for _, d in got], pa.float64()),
                    pa.array([y > 0 for y in b.column(1).to_pylist()]),
                ],
                ["votes", "density", "marked"],
            )

    cast = map_arrow(sample, vote, "votes binary, density double, marked boolean").toArrow().combine_chunks()  # at most ``rows`` short rows
    votes = np.frombuffer(b"".join(cast.column(0).to_pylist()), np.uint8).reshape(cast.num_rows, -1).astype(float)
    density, marked = cast.column(1).to_numpy(), cast.column(2).to_numpy(zero_copy_only=False)
    order = np.lexsort((marked, *votes.T, density))  # the same sums whatever the order of rows
    votes, density, marked = votes[order], density[order], marked[order]
    prior = np.stack([votes[~marked].mean(axis=0), votes[marked].mean(axis=0)])
    start = np.where(votes[:, : model.n_terms].sum(axis=1) >= 1, 0.9, 0.02)
    post, _, _ = label_model(votes, start, prior, (clean, toxic))
    model.weights = logistic(model.features(votes, density), post)
    return model


def score_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score([t or "" for t in b.column(1).to_pylist()]), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = map_arrow(rows, run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold."""
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for b in slices(whole, at):
                ok = model.score([t or "" for t in b.column(at).to_pylist()]) < threshold
                yield pa.RecordBatch.from_arrays(b.columns, b.schema.names).filter(pa.array(ok))

    return map_arrow(docs, run, docs.schema).select(*[F.col(f"`{c}`") for c in names])
