"""Quality classifier without hand-made labels.

Overlapping heuristic labellers each vote good, bad or nothing on a document. How often
each labeller votes what, given the true class, is estimated by expectation-maximisation
over the counts of vote patterns; these are at most 3^labellers rows whatever the corpus,
and they count every document. The posterior of a document's pattern is its weak label.
A logistic scorer over hashed features (byte trigrams, and each measurement's bin) is then
fitted on the posteriors of at most `sample` different texts drawn by hash (a documented
bound: fitting only), and it judges every document, also where the labellers say nothing.

Defined cases: null, empty and blank texts get no votes and the posterior of that pattern,
and are scored on the features they have; a score is always a number in 0..1; very long
texts are read whole; repeated rows get equal scores; an empty table gives an empty result;
input columns named weak_label, score or kept are replaced in classify(), others are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.shipping import map_in_arrow

from .common import read

SAMPLE = 4000
DIMENSIONS = 2048
THRESHOLD = 0.5
#: Bytes of a text whose trigrams are hashed at once.
CHUNK = 1 << 20
#: Votes need this many words; shorter texts get none.
LEAST_WORDS = 5

#: name -> (measure, bad from, good up to): votes bad at or above the first, good below the second.
LABELLERS = {
    "symbols": ("symbols", 0.30, 0.05),
    "shouting": ("upper", 0.50, 0.25),
    "exclaiming": ("bangs", 0.30, 0.05),
    "tables": ("pipes", 0.20, 0.05),
    "stammering": ("same_as_last", 0.20, 0.03),
    "monotony": ("repeats", 0.80, 0.60),
    "no_short_words": ("long_words", 0.90, 0.80),
}
MEASURES = ("symbols", "upper", "bangs", "pipes", "same_as_last", "repeats", "long_words", "digits")
#: Edges of the bins that become hashed features.
BINS = (0.0, 0.01, 0.03, 0.1, 0.2, 0.3, 0.5, 0.7, 0.8, 0.9, 0.97)

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[[ord(c) for c in "#*$%&<>"]] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_CLASS[48:58] = 6


def measure(text: bytes) -> np.ndarray:
    """The measures of a text: shares of its words, letters or characters; all 0 for a text without words."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(len(MEASURES))
    kinds = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    same = sum(map(bytes.__eq__, words, words[1:]))
    longer = sum(map((3).__lt__, map(len, words))) + min(int(kinds[4]), words.count(b"|"))
    distinct = len(set(words))
    return np.array([
        kinds[3] / n, kinds[1] / max(1, kinds[1] + kinds[2]), kinds[5] / n, kinds[4] / n, same / n,
        (1 - distinct / n) if n >= 20 else 0.0, longer / n if n >= 20 else 0.0, kinds[6] / len(text),
    ])


def pattern(measures: np.ndarray, n_words: int) -> int:
    """The votes as digits to base 3: 0 nothing, 1 good, 2 bad."""
    code = 0
    for name, bad, good in LABELLERS.values():
        x = measures[MEASURES.index(name)]
        vote = 0 if n_words < LEAST_WORDS else 2 if x >= bad else 1 if x < good else 0
        code = 3 * code + vote
    return code


def votes_of(code: int) -> list[int]:
    return [code // 3**i % 3 for i in range(len(LABELLERS) - 1, -1, -1)]


def fit_accuracies(patterns: dict[int, int], rounds: int = 100) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
    """EM over pattern counts: the share of good documents, P(vote | class) as (2, labellers, 3), and each pattern's posterior of good."""
    codes = sorted(patterns)
    n = np.array([patterns[c] for c in codes], float)
    votes = np.array([votes_of(c) for c in codes]).reshape(len(codes), len(LABELLERS))
    good = np.where((votes == 2).any(axis=1), 0.05, 0.95)
    one_hot = (votes[:, :, None] == np.arange(3)).astype(float)
    for _ in range(rounds):
        mass = np.stack([n * (1 - good), n * good])
        prior = (mass.sum(axis=1) + 1) / (n.sum() + 2)
        chance = np.einsum("cp,plv->clv", mass, one_hot) + 0.1
        chance /= chance.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + np.einsum("plv,clv->cp", one_hot, np.log(chance))
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    if not codes:
        return np.array([0.5, 0.5]), np.full((2, len(LABELLERS), 3), 1 / 3), {}
    return prior, chance, dict(zip(codes, good.tolist(), strict=True))


def features(text: bytes, measures: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Hashed byte trigrams (root of their share) and the hashed bin of each measure."""
    out = np.zeros(dimensions, np.float32)
    if len(text) >= 3:
        counts = np.zeros(dimensions, np.int64)
        for at in range(0, len(text) - 2, CHUNK):
            b = np.frombuffer(text, np.uint8, min(CHUNK + 2, len(text) - at), at).astype(np.uint32)
            h = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(16)
            counts += np.bincount(h % np.uint32(dimensions), minlength=dimensions)
        out += np.sqrt(counts / (len(text) - 2))
    for k, x in enumerate(measures):
        out[(k * 7919 + int(np.searchsorted(BINS, x)) * 104729) % dimensions] += 1
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 200, rate: float = 1.0, penalty: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by gradient descent with momentum; the last weight is the bias."""
    w, v = np.zeros(x.shape[1] + 1, np.float32), np.zeros(x.shape[1] + 1, np.float32)
    for _ in range(rounds if len(x) else 0):
        off = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))) - y
        v = 0.9 * v - rate * 0.1 * (np.append(off @ x, off.sum()) / len(x) + penalty * w)
        w = (w + v).astype(np.float32)
    return w


def _texts(batch: pa.RecordBatch):
    for text in batch.column(batch.schema.get_field_index("text")):
        yield text.as_buffer().to_pybytes() if text.is_valid else b""


def vote_patterns(docs: DataFrame) -> dict[int, int]:
    """How many documents have each pattern of votes."""

    def run(batches):
        seen: dict[int, int] = {}
        for batch in batches:
            for text in _texts(batch):
                code = pattern(measure(text), len(text.split()))
                seen[code] = seen.get(code, 0) + 1
        yield pa.RecordBatch.from_pydict({"code": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = map_in_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "code bigint, n bigint")
    return {r["code"]: r["n"] for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}  # at most 3^labellers rows


def fit(docs: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS) -> dict:
    """{"posterior": by pattern, "weights": of the scorer, "accuracies": P(vote | class)}."""
    patterns = vote_patterns(docs)
    prior, chance, posterior = fit_accuracies(patterns)
    share = min(1.0, sample / max(1, sum(patterns.values())))

    def run(batches):
        for batch in batches:
            rows, values, labels = [], [], []
            for text in _texts(batch):
                m = measure(text)
                x = features(text, m, dimensions)
                at = np.flatnonzero(x)
                rows.append(at.astype(np.uint16 if dimensions <= 1 << 16 else np.uint32).tobytes())
                values.append(x[at].tobytes())
                labels.append(posterior[pattern(m, len(text.split()))])
            yield pa.RecordBatch.from_pydict({"at": pa.array(rows, pa.binary()), "x": pa.array(values, pa.binary()), "y": pa.array(labels, pa.float64())})

    text = F.col("text").cast("string")
    drawn = docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("h")).where(F.col("h") < int(share * (1 << 30)))
    drawn = drawn.groupBy("h").agg(F.any_value("text").alias("text")).orderBy("h").limit(sample)  # a text that repeats is drawn once
    rows = map_in_arrow(drawn.select("text"), run, "at binary, x binary, y double").toArrow()  # at most `sample` rows, of the features that are not 0
    x, y = np.zeros((len(rows), dimensions), np.float32), rows["y"].to_numpy().astype(np.float32)
    for k, (at, row) in enumerate(zip(rows["at"], rows["x"], strict=True)):
        x[k, np.frombuffer(at.as_buffer(), np.uint16 if dimensions <= 1 << 16 else np.uint32)] = np.frombuffer(row.as_buffer(), np.float32)
    del rows
    pa.default_memory_pool().release_unused()
    return {"posterior": posterior, "weights": fit_scorer(x, y), "accuracies": chance, "prior": prior, "dimensions": dimensions}


def classify(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """docs with weak_label (posterior of good by votes), score and kept."""
    new = ("weak_label", "score", "kept")
    docs = docs.drop(*new).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("weak_label", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    posterior, weights, dimensions = model["posterior"], model["weights"], model["dimensions"]

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                weak, x = [], []
                for text in _texts(part):
                    m = measure(text)
                    weak.append(posterior.get(pattern(m, len(text.split())), 0.5))
                    x.append(features(text, m, dimensions))
                z = np.array(x, np.float32).reshape(len(x), dimensions) @ weights[:-1] + weights[-1]
                score = 1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30)))
                columns = [*part.columns, pa.array(weak, pa.float64()), pa.array(score), pa.array(score >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *new])

    return map_in_arrow(docs, run, schema)


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, fit(docs)).select("doc_id", "weak_label", "score", "kept")
