"""Toxicity by weak supervision.

Many voters look at a text: the words of a lexicon, and patterns (words and word beginnings, seen at least once, twice
or four times) mined from labelled rows. A generative label model, fitted by expectation maximisation on the votes alone,
estimates correlations between voters, from them the blocks of voters that fire together, and each voter's accuracy in
each block's component. Its posterior labels train a linear classifier, which Platt scaling on the labelled rows
calibrates. Every step is deterministic.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checkpointed, process_cache, releasing, table, two_generations

#: English insults that vote on their own, whatever the labelled rows hold.
LEXICON = ("idiot", "moron", "loser", "clown", "scum", "trash", "pathetic", "worthless", "stupid", "disgusting", "imbecile", "vermin", "filth", "garbage", "dumb", "crap", "bastard", "jerk")
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES, TIMES = (4, 5, 6), (1, 2, 4)
#: Most labelled rows that the classifier is fitted on, by label; chosen by a hash of doc_id.
FIT_ROWS = {1: 6000, 0: 10000}
VOTERS, FEATURES = 150, 4000
THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """True for the rows whose labels are never learnt from: crc32 of doc_id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _hash(key: str) -> int:
    """30 bits, so that a pattern fits in 32."""
    return zlib.crc32(key.encode("utf-8", "replace")) >> 2


def _keys(word: str) -> tuple[int, ...]:
    """The patterns that a word counts for, as hashes: itself and its beginnings."""
    return (_hash(word), *[_hash(f"{word[:n]}*") for n in PREFIXES if len(word) >= n])


def _counts(text: str | None, cache) -> Counter:
    """How often each of a text's patterns is seen; cache holds the patterns of words."""
    cache.age()
    hits: Counter = Counter()
    for word, n in Counter(WORDS.findall((text or "").lower())).items():
        keys = cache.get(word)
        if keys is None:
            keys = cache[word] = cache.old.get(word) or _keys(word)
        for key in keys:
            hits[key] += n
    return hits


def patterns(text: str | None, cache) -> np.ndarray:
    """All patterns of a text, ascending: hash * 4 + i for a key seen at least TIMES[i] times."""
    hits = _counts(text, cache)
    return np.array(sorted(key * 4 + i for key, n in hits.items() for i, t in enumerate(TIMES) if n >= t), np.uint32)


def label_model(votes: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, dict]:
    """Posterior of label 1 for each row of a votes matrix (rows x voters, 0/1), by EM without any labels.

    Voters of one language or style fire together, so independence given the label does not hold. Correlations of the
    votes are estimated first; voters linked by one of 0.15 or more form a block, and label 1 is a mixture with one
    component for each block, in which every voter has its own rate of voting (its accuracy on that kind of text). Label 0 is
    one component. Within a component votes are independent.
    """
    v = votes.astype(float)
    n, m = v.shape
    centred = v - v.mean(axis=0)
    scale = np.sqrt((centred**2).mean(axis=0)).clip(1e-6)
    correlation = (centred.T @ centred) / n / np.outer(scale, scale)
    block = list(range(m))
    for i in range(m):
        for j in range(i):
            if correlation[i, j] >= 0.15 and block[i] != block[j]:
                old, new = max(block[i], block[j]), min(block[i], block[j])
                block = [new if x == old else x for x in block]
    names = sorted(set(block))
    member = np.array([[b == x for x in names] for b in block], float)
    cast = v @ member
    r = np.zeros((n, 1 + len(names)))
    r[:, 0] = np.array([0.98, 0.5, 0.1])[np.minimum(cast.sum(axis=1).astype(int), 2)]
    r[:, 1:] = (1 - r[:, :1]) * (cast + 0.01) / (cast + 0.01).sum(axis=1, keepdims=True)
    for _ in range(rounds):
        mass = r.sum(axis=0)
        prior = (mass + 0.5) / (mass.sum() + 0.5 * len(mass))
        rate = (r.T @ v + np.array([[0.05]] + [[0.3]] * len(names))) / (mass[:, None] + np.array([[1.0]] + [[1.5]] * len(names)))
        log = np.log(prior)[None, :] + v @ np.log(rate).T + (1 - v) @ np.log(1 - rate).T
        r = np.exp(log - log.max(axis=1, keepdims=True))
        r /= r.sum(axis=1, keepdims=True)
    return 1 - r[:, 0], {"rate": rate, "prior": prior, "correlation": correlation, "block": block}


def _logistic(rows: list[np.ndarray], width: int, y: np.ndarray, rounds: int = 300, ridge: float = 0.003) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier on binary features, by full-batch Adam."""
    lens = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if lens.sum() else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lens)
    w, b = np.zeros(width), -2.0
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(owner, w[flat], len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
        grad = np.append(np.bincount(flat, g[owner], width) + ridge * w / width, g.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        move = 0.05 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _least(toxic: int) -> int:
    """Toxic rows of the sample that a pattern must be seen in."""
    return max(3, toxic // 200)


def select_features(keys: np.ndarray, k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(patterns, ascending; their bounds; whether each is a word of the lexicon): at most FEATURES patterns that may get a weight.

    keys were seen in k1 of n1 toxic and k0 of n0 clean rows.
    """
    odds = np.log((k1 + 0.5) / (n1 - k1 + 0.5)) - np.log((k0 + 0.5) / (n0 - k0 + 0.5))
    # a lower bound: few sightings say little
    bound = odds - 2 * np.sqrt(1 / (k1 + 0.5) + 1 / (k0 + 0.5))
    listed = np.isin(keys, [_hash(w) * 4 for w in LEXICON]) & ((k1 > k0) | (k0 == 0))
    best = np.lexsort((keys, -bound, ~listed))
    best = np.sort(best[(listed | (bound > 0.5))[best]][:FEATURES])
    return keys[best], bound[best], listed[best]


def lexicon_model() -> dict:
    """What is used where no labelled rows tell more: only the lexicon speaks."""
    return {"weights": {str(w): 6.0 for w in sorted({_hash(w) * 4 for w in LEXICON})}, "bias": -3.0, "voters": 0}


def fit(rows: list[tuple[np.ndarray, int]], features: np.ndarray, bound: np.ndarray, listed: np.ndarray) -> dict:
    """The classifier {weights: {pattern: weight}, bias} from labelled rows (the features they hold, label) of both labels."""
    y = np.array([r[1] for r in rows])
    n1, n0 = int(y.sum()), int((1 - y).sum())
    least = _least(n1)
    index = [np.searchsorted(features, found).astype(np.int64) for found, _ in rows]
    holders: dict[int, list[int]] = {}
    for i, found in enumerate(index):
        for f in found.tolist():
            holders.setdefault(f, []).append(i)
    # voters: the lexicon's words, then patterns that are precise and add rows that few voters cover so far
    voters, covered = [], np.zeros(len(rows), np.int64)
    for f in sorted(holders, key=lambda f: (-10.0 * listed[f] - bound[f], f)):
        own = np.array(holders[f])
        toxic_rows = own[y[own] == 1]
        if listed[f] or len(toxic_rows) >= 0.8 * len(own) and (covered[toxic_rows] < 3).sum() >= least:
            voters.append(f)
            covered[toxic_rows] += 1
        if len(voters) >= VOTERS:
            break
    if not voters:
        return lexicon_model()
    votes = np.zeros((len(rows), len(voters)), np.int8)
    for j, f in enumerate(voters):
        votes[holders[f], j] = 1
    posterior, _ = label_model(votes)
    w, b = _logistic(index, len(features), posterior)
    z = b + np.array([w[i].sum() for i in index])
    # Platt scaling on the labels, by Newton steps on (slope, shift); the slope stays positive so the order is kept
    slope, shift, t = 1.0, 0.0, np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -40, 40)))
        g = np.array([((p - t) * z).mean(), (p - t).mean()])
        h = p * (1 - p)
        hess = np.array([[(h * z * z).mean(), (h * z).mean()], [(h * z).mean(), h.mean()]]) + 1e-4 * np.eye(2)
        d = np.linalg.solve(hess, g)
        slope, shift = max(0.05, slope - float(np.clip(d[0], -0.5, 0.5))), shift - float(np.clip(d[1], -1, 1))
    kept = {str(features[i]): float(slope * w[i]) for i in np.flatnonzero(np.abs(w) > 1e-3)}
    return {"weights": kept, "bias": float(slope * b + shift), "voters": len(voters)}


def train(docs: DataFrame, labels: DataFrame, fit_rows: dict[int, int] = FIT_ROWS) -> dict:
    """Fit on a bounded sample of labelled rows outside the held-out third; returns the model.

    Patterns are extracted and counted in parallel; one task then fits on the FEATURES chosen, and sees no text.
    Without toxic or without clean rows among the labelled ones, only the lexicon speaks.
    At most fit_rows[1] toxic and fit_rows[0] clean rows are taken, those of smallest hash; a doc_id labelled more than
    once counts as toxic if any of its labels says so, and of rows that share a doc_id one is taken. Only the sample's ids (a few hundred kB) are broadcast.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    parts = [usable.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(n) for k, n in fit_rows.items()]
    sample = docs.select("doc_id", "text").join(F.broadcast(parts[0].union(parts[1])), F.col("doc_id") == F.col("_id")).select("_id", "text", "_toxic", F.xxhash64("_id", "text").alias("_h"))
    sample = sample.groupBy("_id").agg(F.min(F.struct("_h", "text", "_toxic")).alias("_row")).select("_row.text", "_row._toxic", "_row._h")

    def extract(batches):
        cache = two_generations(50_000)
        for batch in batches:
            found = [patterns(t.as_py(), cache).astype("<u4").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1), pa.array(found, pa.binary())], ["h", "label", "patterns"])

    found = checkpointed(sample.mapInArrow(releasing(extract), "h long, label int, patterns binary"))
    rows = {r["label"]: r["n"] for r in found.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not rows.get(0) or not rows.get(1):
        return lexicon_model()
    least = _least(rows[1])

    def count(batches):
        for batch in batches:
            labels = batch.column(1).to_numpy()
            own = [np.frombuffer(v.as_buffer(), "<u4") for v in batch.column(2)]
            label = np.repeat(labels, [len(v) for v in own])
            both, n = np.unique(np.concatenate([*own, np.zeros(0, "<u4")]).astype(np.int64) * 2 + label, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(np.where(both & 1, n, 0)), pa.array(np.where(both & 1, 0, n))], ["key", "k1", "k0"])

    # patterns that enough of the toxic sample has: at most all of its patterns / least of them come to the driver
    words = [_hash(w) * 4 for w in LEXICON]
    seen = found.mapInArrow(releasing(count), "key long, k1 long, k0 long").groupBy("key").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0")).filter((F.col("k1") >= least) | (F.col("key").isin(words) & (F.col("k1") > 0)))
    keys, k1, k0 = (c.to_numpy() for c in seen.sort("key").toArrow().columns)
    features, bound, listed = select_features(keys.astype(np.uint32), k1, k0, rows[1], rows[0])
    if not len(features):
        return lexicon_model()

    def thin(batches):
        for batch in batches:
            kept = []
            for v in batch.column(2):
                own = np.frombuffer(v.as_buffer(), "<u4")
                kept.append(own[np.isin(own, features)].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(kept, pa.binary())], ["h", "label", "patterns"])

    def run(batches):
        rows = []
        for batch in batches:
            rows += [(h, np.frombuffer(v.as_buffer(), "<u4"), label) for h, label, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))]
        rows.sort(key=lambda r: (r[0], r[1].tobytes(), r[2]))
        yield pa.RecordBatch.from_arrays([pa.array([json.dumps(fit([r[1:] for r in rows], features, bound, listed))])], ["model"])

    model = found.mapInArrow(releasing(thin), "h long, label int, patterns binary").repartition(1).mapInArrow(releasing(run), "model string").collect()
    return json.loads(model[0][0])


def _scorer(model: dict):
    """texts -> probabilities; the patterns of a word are looked up once per process while it stays in the cache."""
    held, name = process_cache(), ("toxicity", json.dumps(model, sort_keys=True))
    if name in held:
        return held[name]
    steps: dict[int, list[tuple[int, float]]] = {}
    for pattern, weight in model["weights"].items():
        steps.setdefault(int(pattern) >> 2, []).append((TIMES[int(pattern) & 3], weight))
    bias, cache = model["bias"], two_generations(100_000)

    def score(text: str | None) -> float:
        """Only words with a weighted pattern are counted; the cache holds those patterns of each word."""
        cache.age()
        hits: Counter = Counter()
        for word, n in Counter(WORDS.findall((text or "").lower())).items():
            keys = cache.get(word)
            if keys is None:
                keys = cache.old.get(word)
                if keys is None:
                    keys = tuple(k for k in _keys(word) if k in steps)
                cache[word] = keys
            for key in keys:
                hits[key] += n
        z = bias + math.fsum(w for key, n in hits.items() for t, w in steps[key] if n >= t)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

    held[name] = score
    return score


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """docs' columns plus _score, the probability that a text is toxic; only `text` is looked at (null: empty)."""
    at, names = docs.columns.index("text"), [*docs.columns, "_score"]

    def run(batches):
        score = _scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([score(t.as_py()) for t in batch.column(at)], pa.float64())], names)

    schema = StructType([*docs.schema.fields, StructField("_score", DoubleType())])
    return docs.mapInArrow(releasing(run), schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more."""
    return score_documents(docs, train(docs, labels)).filter(F.col("_score") < threshold).drop("_score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    score = F.col("_score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
