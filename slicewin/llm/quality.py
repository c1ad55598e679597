"""Operator 9: quality classifier from weak labels.

Four faults are judged: marks, repeats and tables, which are junk, and toxicity. For each, overlapping heuristics
vote yes, no or not at all on every document; of toxicity three see a third of the words each, one their repeats. Expectation-
maximisation over the counts of vote patterns (at most 3**heuristics of them, over all documents) estimates how
accurate each heuristic is and how likely each pattern means the fault. These posteriors label the documents on which
a linear scorer over hashed features is trained. The scorer judges all documents, and the posterior of a document's
own votes, which covers all documents, counts where it is higher: a fault too rare to be among the trained ones is
found by its votes.

Of the labelled rows at most LABELLED are used, those of the smallest hashes of their ids: the words that the toxicity
heuristics look for are learned from their labels, and the scorer is trained on their documents, by the posteriors.
Everything else covers all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from slicewin.llm.common import table, unfolded, whole_row
from slicewin.llm.textscan import ALNUM, Words, grams, mixed, portions, stretches

LABELLED = 20_000
CHANCE = 1.0
FEATURES = 1 << 16
#: Words from which on repeats can be told.
ENOUGH = 21
#: Heuristics of each fault, by measure. Votes: yes from the second number, no below the first, none between.
FAULTS = {
    "marks": {"marks": (0.06, 0.12), "runs": (0.1, 0.4), "capitals": (0.35, 0.6)},
    "repeats": {"most": (0.2, 0.4), "doubled": (0.3, 0.5), "same": (0.05, 0.3)},
    "tables": {"bars": (0.05, 0.3), "lone": (0.1, 0.3)},
    "toxic": {"first": (1, 1), "second": (1, 1), "third": (1, 1), "again": (2, 2)},
}
MEASURES = [m for h in FAULTS.values() for m in h]
DENSE = len(MEASURES) - len(FAULTS["toxic"])
U = np.uint64


def measures(w: Words, t: int, bad: np.ndarray) -> tuple[list[float], np.ndarray]:
    """Numbers about text t (shares, nan where it is too short for one, bad words of each third and all their occurrences), and the hashes of its distinct words."""
    a, b = int(w.first[t]), int(w.first[t + 1])
    raw = w.raw[w.offsets[t] : w.offsets[t + 1]]
    hashes = w.hashes[a:b]
    n, size = max(1, b - a), max(1, len(raw))
    letters = np.count_nonzero(ALNUM[raw] | ((raw >= 65) & (raw <= 90)))
    space = np.count_nonzero((raw == 32) | ((raw >= 9) & (raw <= 13)))
    common = np.isin(raw, np.frombuffer(b".,;:'\"-()", np.uint8)).sum()
    marks = (size - letters - space - common) / size if len(raw) else 0.0
    solid = (raw > 32) & (raw < 128) & ~ALNUM[raw] & ~((raw >= 65) & (raw <= 90))
    same = solid[1:] & (raw[1:] == raw[:-1])
    runs = (np.count_nonzero(same[1:] & ~same[:-1]) + int(same[:1].sum())) / n
    upper = np.count_nonzero((raw >= 65) & (raw <= 90))
    lower = np.count_nonzero(ALNUM[raw] & (raw > 57))
    distinct, counts = np.unique(hashes, return_counts=True)
    pairs = hashes[1:] + hashes[:-1] * U(31)
    triples = pairs[1:] + hashes[:-2] * U(961) if b - a > 2 else pairs
    doubled = 1 - len(np.unique(triples)) / len(triples) if b - a >= ENOUGH else np.nan
    same_word = np.count_nonzero(hashes[1:] == hashes[:-1]) / n
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    alone = white[:-2] & white[2:] & solid[1:-1] if size > 2 and len(raw) else np.zeros(0, bool)
    bars = np.count_nonzero(alone & (raw[1:-1] == 124)) / n if len(alone) else 0.0
    inside = np.isin(distinct, bad)
    found = np.bincount((distinct[inside] % U(3)).astype(np.int64), minlength=3)
    most = float(counts.max() / n) if b - a >= ENOUGH else np.nan
    return [marks, runs, upper / max(1, upper + lower), most, doubled, same_word, bars, np.count_nonzero(alone) / n, *found.tolist(), int(counts[inside].sum())], distinct


def votes(m: list[float]) -> list[str]:
    out, i = [], 0
    for heuristics in FAULTS.values():
        out.append("".join("1" if x >= hi else "0" if x < lo else "-" for x, (lo, hi) in zip(m[i:], heuristics.values(), strict=False)))
        i += len(heuristics)
    return out


def expectation_maximisation(patterns: dict[str, int], rounds: int = 50, prior: float = 0.1) -> tuple[dict[str, float], np.ndarray]:
    """P(fault) of each vote pattern, and each heuristic's (P(yes | fault), P(yes | none)).

    The start holds each heuristic for better than chance, which tells fault from none.
    """
    if not patterns:
        return {}, np.zeros((0, 2))
    keys = sorted(patterns)
    n = np.array([patterns[k] for k in keys], float)
    v = np.array([[{"1": 1, "0": 0, "-": -1}[c] for c in k] for k in keys])
    yes, no = v == 1, v == 0
    theta = np.tile([0.7, 0.02], (v.shape[1], 1))
    for _ in range(rounds):
        logs = [np.where(yes, np.log(theta[:, c]), 0).sum(1) + np.where(no, np.log1p(-theta[:, c]), 0).sum(1) for c in (0, 1)]
        p = 1 / (1 + np.exp(np.clip(logs[1] - logs[0] + np.log((1 - prior) / prior), -50, 50)))
        for c, w in enumerate((n * p, n * (1 - p))):
            ones, zeros = (w[:, None] * yes).sum(0), (w[:, None] * no).sum(0)
            fresh = (ones + (1 if c == 0 else 0.02)) / (ones + zeros + (1.5 if c == 0 else 1))
            theta[:, c] = np.clip(fresh, 1e-4, 1 - 1e-4)
        prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 0.5))
    return dict(zip(keys, p.tolist(), strict=True)), theta


def words_of(texts: list[str | None]) -> Iterator[tuple[Words, int]]:
    for _, data, offsets in stretches(pa.array(texts, pa.large_string())):
        w = Words(data, offsets, ALNUM)
        for t in range(len(offsets) - 1):
            yield w, t


def sampled(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, toxic) of at most ``limit`` labelled documents; a bound on what is broadcast."""
    chosen = labels.where("doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL)").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    return chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def learn_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the words that mark toxic ``rows`` (text, toxic): mostly in toxic texts, and in more than chance gives.

    With p the share of toxic texts, k toxic texts and no other have a word with a chance of p**k; k is so large that
    among all words that are in as many texts CHANCE of one is expected.

    Texts with the same smallest hashes of five words, of two hash functions, are taken for copies and count once, so
    that the other words of a toxic text that was copied are not held for toxic.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            for (w, t), y in zip(words_of(b.column(0).to_pylist()), b.column(1).to_pylist(), strict=True):
                hashes = w.hashes[w.first[t] : w.first[t + 1]]
                if len(hashes):
                    h = np.unique(hashes).view(np.int64)
                    five = grams(hashes, min(5, len(hashes)))
                    copy = (five.min() ^ mixed(mixed(five) + U(1)).min()).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), copy)), pa.array(np.full(len(h), y), pa.int64())], names=["h", "copy", "y"])

    each = rows.where("toxic IS NOT NULL").mapInArrow(run, "h long, copy long, y long").groupBy("h", "copy").agg(F.max("y").alias("y"))
    words = each.groupBy("h").agg(F.sum("y").alias("bad"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    tried = words.count()
    share = rows.where("toxic IS NOT NULL").agg(F.avg("toxic")).first()[0] or 0.0
    if not tried or not 0 < share < 1:
        return np.zeros(0, U)
    least = max(3, math.ceil(math.log(CHANCE / tried) / math.log(share)))
    found = words.where((F.col("bad") >= least) & (F.col("bad") > 0.8 * F.col("n"))).select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(U))


def features(m: list[float], distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A one and steps of the measures, for the first places; and the places into which the words are hashed."""
    dense = np.array([1.0, *[0.0 if np.isnan(x) else 3 * min(x, 1.0) for x in m[:DENSE]]])
    return dense, (DENSE + 1 + np.unique(distinct % U(FEATURES - DENSE - 1))).astype(np.int32)


def train(dense: np.ndarray, places: np.ndarray, lengths: np.ndarray, y: np.ndarray, passes: int = 400) -> np.ndarray:
    """Logistic weights by adaptive gradient steps, over the measures and the hashed words that go with the fault.

    ``places`` holds the places of the words of all documents, ``lengths`` of them for each.
    """
    weights, n = np.zeros(FEATURES), len(y)
    if not (y > 0.5).any():
        weights[0] = -8.0
        return weights
    pos, all_ = np.bincount(places, np.repeat(y, lengths), FEATURES), np.bincount(places, minlength=FEATURES)
    base = max(y.mean(), 1e-4)
    use = (pos - all_ * base) / (np.sqrt(all_ * base * (1 - base)) + 1e-9) > 5
    which, kept = np.flatnonzero(use), use[places]
    at = np.searchsorted(which, places[kept])
    row = np.repeat(np.arange(n, dtype=np.int32), lengths)[kept]
    w, v = np.zeros(dense.shape[1]), np.zeros(len(which))
    w2, v2 = np.full(len(w), 1e-8), np.full(len(v), 1e-8)
    for _ in range(passes):
        error = 1 / (1 + np.exp(-np.clip(dense @ w + np.bincount(row, v[at], n), -30, 30))) - y
        g, h = error @ dense / n + 1e-5 * w, np.bincount(at, error[row], len(v)) / n + 1e-5 * v
        w2 += g * g
        v2 += h * h
        w -= 0.5 * g / np.sqrt(w2)
        v -= 0.5 * h / np.sqrt(v2)
    weights[: len(w)], weights[which] = w, v
    return weights


def classify(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, keep: bool = False) -> DataFrame:
    """doc_id or (keep) all columns as struct ``row``, with p_junk, p_toxic (double) and accepted (both at most 0.5).

    A null text counts as empty; an empty text gets no word features and is not junk by itself. Very long texts are
    judged whole; of texts of fewer than ENOUGH words two heuristics abstain. Null labels and labels of unknown
    documents are not used; repeated rows are judged alike. Other columns are not read, or stay as they are in ``row``,
    whatever their names. An empty table gives no rows; without toxic labels no word is held for toxic, and without
    labels the votes judge alone.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(sampled(labels, labelled)), "doc_id").select("text", "toxic")
    bad = learn_words(chosen)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            v = [votes(measures(w, t, bad)[0]) for w, t in words_of(b.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in v], pa.string()) for k in range(len(FAULTS))], names=list(FAULTS))

    counts = docs.select("text").mapInArrow(vote, ", ".join(f"{f} string" for f in FAULTS)).groupBy(*FAULTS).count().collect()
    models = []
    for fault in FAULTS:
        seen: Counter = Counter()
        for r in counts:
            seen[r[fault]] += r["count"]
        models.append(expectation_maximisation(dict(seen))[0])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            at, val, y = [], [], []
            for w, t in words_of(b.column(0).to_pylist()):
                m, distinct = measures(w, t, bad)
                dense, places = features(m, distinct)
                at.append(places)
                val.append(dense)
                y.append([model.get(p, 0.0) for model, p in zip(models, votes(m), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float64())), pa.array(y, pa.list_(pa.float64()))], names=["at", "v", "y"])

    sample = chosen.select("text").mapInArrow(learn, "at array<int>, v array<double>, y array<double>").toArrow()
    at, dense, y = (sample[c].combine_chunks() for c in ("at", "v", "y"))
    dense, y = dense.flatten().to_numpy().reshape(-1, DENSE + 1), y.flatten().to_numpy().reshape(-1, len(FAULTS))
    weights = [train(dense, at.flatten().to_numpy(), at.value_lengths().to_numpy(), y[:, k]) for k in range(len(FAULTS))]
    del sample, at, dense, y
    first = whole_row(docs).alias("row") if keep else F.col("doc_id")
    frame = docs.select(first, F.col("text").alias("words"))
    name = frame.columns[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches):
            p = np.zeros((b.num_rows, len(FAULTS)))
            for i, (w, t) in enumerate(words_of(b.column(1).to_pylist())):
                m, distinct = measures(w, t, bad)
                dense, places = features(m, distinct)
                for k, pattern in enumerate(votes(m)):
                    x = weights[k][: DENSE + 1] @ dense + weights[k][places].sum()
                    p[i, k] = max(1 / (1 + np.exp(-np.clip(x, -30, 30))), models[k].get(pattern, 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p[:, :-1].max(axis=1)), pa.array(p[:, -1])], names=[name, "p_junk", "p_toxic"])

    schema = StructType([frame.schema[0]]).add("p_junk", "double").add("p_toxic", "double")
    return frame.mapInArrow(score, schema).withColumn("accepted", F.expr("p_junk <= 0.5 AND p_toxic <= 0.5"))


def keep_accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows of ``docs`` in their own columns, whatever their names; see ``classify`` for nulls and the rest."""
    return unfolded(classify(docs, labels, keep=True).where("accepted"), docs.columns)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
