"""Toxicity by weak supervision (operator 3).

Voters look at one document each and may fire or not: lexicons of insults,
lexicon entries (words and word beginnings) mined from the labelled training
rows, and patterns. A generative model takes the votes of labelled and unlabelled
documents, without their labels, as drawn from trees of voters given the hidden
class: how often a voter fires for either class is its accuracy, how often given
also what its parent in the tree does is their correlation. Both are estimated by
EM, the trees from the votes' correlations within the classes. A logistic
regression over word features is then trained on the posterior labels of all
these documents, its bias and scale are set on the labelled ones, and it scores
every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_sample, cut, held_out, short_batches
from tidemark.llm.textvec import LETTERS, Block, blocks, distinct, mix, row_numbers

#: Lexicon voters: plain insults and slurs of contempt, one voter a line.
LEXICONS = (
    "idiot idiots moron morons imbecile fool fools stupid dumb",
    "loser losers worthless pathetic useless clown",
    "scum trash garbage filth vermin disgusting",
    "idiota idiotas imbécil estúpido estúpida basura asqueroso inútil",
    "dummkopf idioten trottel abschaum müll widerlich wertlos versager",
    "idiote idiots imbécile crétin ordure minable dégoûtant débile",
)
#: Byte lengths of word beginnings that are features beside whole words.
BEGINNINGS = (3, 4, 5, 6, 7)


@dataclass(frozen=True)
class Params:
    """Bounds of the sample that is fitted on, and of the model.

    At most toxic_rows and other_rows labelled training rows are drawn, and at
    most free_rows rows without a label that are not held out. Features that
    toxic ones have lift times as often as others serve the classifier; of those
    that they have voter_lift times as often the mined best are voters. Voters
    are tied in trees where their correlation within the classes is at least tie.
    """

    toxic_rows: int = 3000
    other_rows: int = 5000
    free_rows: int = 3000
    mined: int = 400
    features: int = 2000
    min_z: float = 4.0
    min_rows: int = 4
    lift: float = 3.0
    voter_lift: float = 20.0
    tie: float = 0.8
    rounds: int = 30
    ridge: float = 0.02


def _ready(docs: DataFrame, *more: str) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(text).alias("text"), F.coalesce(F.length(F.regexp_replace(text, r"[^!]", "")), F.lit(0)).alias("marks"), F.coalesce(F.length(text), F.lit(0)).alias("chars"), *more)


def features(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct features of a block's rows: words, and beginnings of longer words."""
    row = row_numbers(b)
    rows, found = [row], [b.hash]
    for k in BEGINNINGS:
        at, h = b.prefixes(k)
        rows.append(row[at])
        found.append(mix(h + np.uint64(k)))
    r, h = np.concatenate(rows), np.concatenate(found)
    order = np.argsort(r, kind="stable")
    return distinct(r[order], h[order])


def word_hashes(words: str) -> np.ndarray:
    b = next(blocks(pa.array([words], pa.large_string()), space=LETTERS))
    return b.hash


def draw(docs: DataFrame, labels: DataFrame, p: Params) -> tuple[DataFrame, float]:
    """doc_id and y (1: toxic, 0: not, -1: no label) of the bounded sample of rows that are not held out, and the toxic share of all labelled ones."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("y"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    each = ids.where(~held_out(F.col("doc_id"))).join(known, "doc_id", "left").select("doc_id", F.coalesce("y", F.lit(-1)).alias("y"))
    n = {r["y"]: r["count"] for r in each.groupBy("y").count().collect()}
    share = n.get(1, 0) / max(1, n.get(1, 0) + n.get(0, 0))
    return bounded_sample(each, "y", F.when(F.col("y") == 1, p.toxic_rows).when(F.col("y") == 0, p.other_rows).otherwise(p.free_rows)), share


def mine(sample: DataFrame, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Features that toxic rows of the sample have more often than others, the most significant first, and how many times as often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for b in blocks(batch.column(0), space=LETTERS):
                r, h = features(b)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(y[b.lo + r].astype(np.int64))], names=["feature", "y"])

    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return np.zeros(0, np.uint64), np.zeros(0)
    counted = sample.select("text", "y").mapInArrow(run, "feature long, y long").groupBy("feature").agg(F.sum("y").alias("a"), F.count(F.lit(1)).alias("n"))
    pa_, pb_ = F.col("a") / n1, (F.col("n") - F.col("a")) / n0
    both = F.col("n") / (n1 + n0)
    z = (pa_ - pb_) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0) + 1e-12)
    best = counted.where(F.col("n") >= p.min_rows).select("feature", z.alias("z"), (pa_ / (pb_ + 0.5 / n0)).alias("lift")).where((F.col("z") >= p.min_z) & (F.col("lift") >= p.lift)).orderBy(F.desc("z"), "feature").limit(p.features).toArrow()
    return best.column("feature").to_numpy().view(np.uint64), best.column("lift").to_numpy()


def hits(b: Block, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place in sorted_ of the listed features that a block's rows have."""
    r, h = features(b)
    if not len(sorted_):
        return r[:0], h[:0].astype(np.int64)
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    found = sorted_[at] == h
    return r[found], at[found]


@dataclass
class LabelModel:
    """Trees of voters given the class: tables[y, j, u, v] is the chance that voter j votes v if its parent votes u.

    A root has itself as parent, and the same chance for either u.
    """

    prior: float  # share of class 1
    parent: np.ndarray
    tables: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance of class 1 for each row of votes (bool)."""
        v = votes.astype(np.int64)
        ratio = np.log(self.tables[1] / self.tables[0])
        logit = np.log(self.prior / (1 - self.prior)) + ratio[np.arange(v.shape[1]), v[:, self.parent], v].sum(1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def spanning_tree(weight: np.ndarray) -> np.ndarray:
    """Each node's parent in a tree of the greatest total weight; the first node is its own."""
    n = len(weight)
    parent, best, inside = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        inside[at] = True
        nearer = ~inside & (weight[at] > best)
        best[nearer], parent[nearer] = weight[at][nearer], at
        at = int(np.argmax(np.where(inside, -np.inf, best)))
    return parent


def trees(votes: np.ndarray, q: np.ndarray, tie: float) -> np.ndarray:
    """Each voter's parent in trees of the strongest correlations within the classes, none of them below tie."""
    v = votes.astype(np.float64)
    rest = v - np.outer(q, q @ v / max(1e-9, q.sum())) - np.outer(1 - q, (1 - q) @ v / max(1e-9, (1 - q).sum()))
    rest /= np.sqrt((rest**2).sum(0)) + 1e-9
    alike, own = rest.T @ rest, np.arange(v.shape[1])
    parent = spanning_tree(alike)
    return np.where(alike[own, parent] >= tie, parent, own)


def fit_tables(votes: np.ndarray, q: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The tables of the votes whose rows belong to class 1 with chance q."""
    v = votes.astype(np.float64)
    roots = parent == np.arange(v.shape[1])
    tables = np.zeros((2, v.shape[1], 2, 2))
    for y, w in enumerate((1 - q, q)):
        n, n1 = w.sum(), w @ v
        base = (n1 + 0.5) / (n + 1)
        fired = w @ (v * v[:, parent])  # with the parent
        given = np.stack(((n1 - fired + 2 * base) / (n - n1[parent] + 2), (fired + 2 * base) / (n1[parent] + 2)), axis=1)
        given[roots] = base[roots][:, None]
        tables[y, :, :, 1] = np.clip(given, 1e-6, 1 - 1e-6)
        tables[y, :, :, 0] = 1 - tables[y, :, :, 1]
    return tables


def label_model(votes: np.ndarray, prior: float, rounds: int, tie: float = 0.8) -> tuple[LabelModel, np.ndarray]:
    """The label model of some votes (bool), all of which speak for class 1, and each row's posterior.

    EM from rows with more votes than most down; prior, the share of class 1, is
    given and kept, as it says which of the two classes is meant.
    """
    count = votes.sum(1)
    q = np.where((count > 0) & (count >= np.quantile(count, 1 - prior)), 0.9, 0.05)
    for step in range(rounds):
        if step % 5 == 0:
            parent = trees(votes, q, tie)
        model = LabelModel(prior, parent, fit_tables(votes, q, parent))
        new = model.posterior(votes)
        if step % 5 and np.abs(new - q).max() < 1e-6:
            break
        q = new
    return model, new


def calibrated(raw: np.ndarray, y: np.ndarray, share: float | None = None, rounds: int = 50) -> tuple[float, float]:
    """Scale and shift by which raw scores become the log-odds of y; Newton's method with a small ridge.

    Classes weigh as they do among all labelled rows (share: that of the toxic
    ones), however many of each were drawn, so a score does not depend on that.
    """
    share = float(y.mean()) if share is None else share
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    x, w = np.column_stack((raw, np.ones(len(raw)))), np.array([1.0, 0.0])
    for _ in range(rounds):
        s = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (s - y)) + 1e-3 * (w - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
        w = w - np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


@dataclass
class Sparse:
    """A matrix of zeros and ones, by the row and the column of its ones."""

    row: np.ndarray
    col: np.ndarray
    shape: tuple[int, int]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], minlength=self.shape[0])

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], minlength=self.shape[1])

    def columns(self, which: np.ndarray) -> np.ndarray:
        """The named columns as a dense matrix of bool."""
        place = np.full(self.shape[1], -1)
        place[which] = np.arange(len(which))
        out = np.zeros((self.shape[0], len(which)), bool)
        at = place[self.col]
        out[self.row[at >= 0], at[at >= 0]] = True
        return out


def logistic(x: Sparse, q: np.ndarray, ridge: float, rounds: int = 1200) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, classes weighing the same, by accelerated descent."""
    share = np.where(q > 0.5, 1 / max(1e-9, q.sum()), 1 / max(1e-9, (1 - q).sum())) / 2
    keep = np.append(np.full(x.shape[1], ridge / x.shape[0] * 10), 0)
    forward = lambda w: x.times(w[:-1]) + w[-1]
    back = lambda g: np.append(x.transposed_times(g), g.sum())
    u = np.ones(len(keep))
    for _ in range(50):  # the greatest curvature, by power iteration
        top = float(np.linalg.norm(u))
        u = back(share * forward(u / top))
    top = 1.1 * float(np.linalg.norm(u)) / 4 + keep.max()
    w = old = np.zeros(len(keep))
    for k in range(rounds):
        y = w + k / (k + 3) * (w - old)
        grad = back(share * (1 / (1 + np.exp(-np.clip(forward(y), -30, 30))) - q)) + keep * y
        old, w = w, y - grad / top
    return w[:-1], float(w[-1])


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the features
    weight: np.ndarray
    bias: float


def fit(docs: DataFrame, labels: DataFrame, p: Params) -> Model:
    # at most toxic_rows + other_rows + free_rows ids
    sampled, share = draw(docs, labels, p)
    drawn = cut(sampled, "toxicity-sample")
    sample = _ready(docs).join(F.broadcast(drawn), "doc_id")
    mined, lift = mine(sample.where("y >= 0"), p)
    lexicon = [word_hashes(x) for x in LEXICONS]
    keys = np.unique(np.concatenate([mined, *lexicon]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1), space=LETTERS):
                r, at = hits(b, keys)
                lists = np.split(at, np.cumsum(np.bincount(r, minlength=b.hi - b.lo))[:-1])
                rows = slice(b.lo, b.hi)
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], pa.array(lists, pa.list_(pa.int64())), batch.column(2)[rows], batch.column(3)[rows], batch.column(4)[rows]], names=["doc_id", "hits", "marks", "chars", "y"])

    got = sample.select("doc_id", "text", "marks", "chars", "y").mapInArrow(run, "doc_id long, hits array<long>, marks int, chars int, y int").toArrow()
    n = got.num_rows
    y = got.column("y").to_numpy() if n else np.zeros(0)
    if not ((y == 1).any() and (y == 0).any()):  # nothing to tell apart
        return Model(keys, np.zeros(len(keys)), 4.0 if (y == 1).any() else -4.0)
    order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
    got, y = got.take(pa.array(order)), y[order]
    lists = got.column("hits").combine_chunks()
    x = Sparse(np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), (n, len(keys)))
    top = np.searchsorted(keys, mined[lift >= p.voter_lift][: p.mined])
    mine_, in_lexicon = x.columns(top), np.column_stack([x.columns(np.searchsorted(keys, h)).sum(1) for h in lexicon])
    loud = got.column("marks").to_numpy() > 2 + got.column("chars").to_numpy() / 200
    several = (in_lexicon.sum(1) > 1) | (mine_.sum(1) > 2)
    votes = np.column_stack([mine_, in_lexicon > 0, loud & (in_lexicon.sum(1) > 0), several])
    known = y >= 0
    prior = ((y == 1).sum() + share * (~known).sum()) / n  # rows without a label are toxic as often as all labelled ones
    _, q = label_model(votes, float(np.clip(prior, 0.01, 0.6)), p.rounds, p.tie)
    w, b = logistic(x, q, p.ridge)
    scale, shift = calibrated((x.times(w) + b)[known], y[known], share)
    return Model(keys, scale * w, scale * b + shift)


def score(docs: DataFrame, labels: DataFrame, p: Params = Params()) -> DataFrame:
    """Score every whole text for toxicity.

    Returns doc_id, held_out, score (0 to 1) and predicted. Null and empty texts
    get the score of a text without features; long texts are read whole. Several
    labels of a document count as their highest; null labels count as none;
    without labels of both classes every score says the class there is, or not
    toxic. Repeated rows give repeated results; an empty table gives an empty one;
    other columns are left behind, whatever their names.
    """
    spark = docs.sparkSession
    short_batches(spark)
    model = fit(docs, labels, p)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            total = np.full(batch.num_rows, m.bias)
            for b in blocks(batch.column(1), space=LETTERS):
                r, at = hits(b, m.keys)
                total[b.lo : b.hi] += np.bincount(r, m.weight[at], minlength=b.hi - b.lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))))], names=["doc_id", "score"])

    out = _ready(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
