"""Language-model scoring by masked pseudo-likelihood.

Every word of a document is hidden in turn and predicted from the two words on either
side; the sum of the log-probabilities scores the document. P(word | sides) is the mean of
two predictions, from the word before and the word after:

    (n(beside, word) - 1 + own * net(word)) / (n(beside) - 1 + own),  own = 4 + 2 * sqrt(n(beside) - 1)

n counts words and neighbours, as words and without a bound on the vocabulary, over all
places of the whole corpus; the hidden place itself is taken off. The ends of a text are
a neighbour like a word. net(word) = P(bucket | sides) * n(word) / n(bucket) is what a
bidirectional window network in numpy says: words are hashed to 65,536 buckets; the four
words around give vectors (a table of 32,768 rows, scaled by place) whose sum goes through
tanh; the bucket is predicted as four digits to base 16, each by a softmax over the digits
that may follow those before it, so that all buckets sum to one exactly. A digit's softmax
starts from the exact counts of the corpus under the same digits before, so the network
begins as the unigram model and learns what the sides tell beyond it.

It is trained where the data lie. Texts are hashed once into chunks of about CHUNK_WORDS
words, a row each, written to the shared folder. In each of ROUNDS rounds every task
starts from the common weights and descends over every word of its chunks of that round
(each chunk has one round, so each word of the corpus is a target once and context four
times); the changes are averaged row by row, weighted by how often a task met the row.
Which chunks share a task depends on how Spark splits the input, so scores differ a
little between layouts; on the same files and settings reruns agree.

The counts stay distributed: a chunk counts its own keys, parts of the keys (by hash) are
summed over all chunks, and the sums go back to the chunks that asked. A frequent word is
one entry of a chunk. What reaches the driver is bound by parameters (bucket counts,
weights), not by the corpus.

Words are known by 32-bit hashes and pairs by 48-bit ones, so a few in a million share their counts; the network
sees buckets only, which rare words share.

Defined cases: null, empty and blank texts have n_tokens 0, log_prob 0 and null
mean_log_prob; very long texts are scored whole, as one chunk; repeated rows score alike
up to the rounding of sums; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow, ship

from .common import WordCache, materialize, mixed, read, release

DIGITS, BASE = 4, 16
BUCKETS = BASE**DIGITS
INPUTS = 1 << 15
HIDDEN = 16
PLACES = (-2, -1, 1, 2)
ROUNDS = 2
BATCH = 4096
RATE = 0.3
#: Words and documents of a chunk, about, and keys of a part.
CHUNK_WORDS, CHUNK_DOCS = 1 << 19, 100_000
PART_KEYS = 2_000_000
#: The neighbour at the ends of a text.
OUTSIDE = np.uint32(0)
#: Rows of weights that travel together.
BLOCK = 2048


@lru_cache(maxsize=1)
def _words() -> WordCache:
    import xxhash

    return WordCache(lambda word: xxhash.xxh32_intdigest(word) or 1)


def hashed(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_words().__getitem__, words), np.uint32, len(words))


def chunks(docs: DataFrame) -> DataFrame:
    """chunk, doc_ids, lengths, words (32-bit hashes): whole documents, a row per chunk."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids, texts, words = [], [], 0

        def row():
            chunk = (task << 32) + number
            lengths = np.array([len(t) for t in texts], np.int64).tobytes()
            ids_of = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([pa.array([chunk]), ids_of, pa.array([lengths]), pa.array([np.concatenate(texts).tobytes()])], names=["chunk", "doc_ids", "lengths", "words"])

        for batch in batches:
            begin = 0
            for k, text in enumerate(batch.column(1)):
                texts.append(hashed(text.as_buffer().to_pybytes() if text.is_valid else b""))
                words += len(texts[-1])
                if words >= CHUNK_WORDS or len(texts) >= CHUNK_DOCS:
                    ids.append(batch.column(0).slice(begin, k + 1 - begin))
                    yield row()
                    begin, number, ids, texts, words = k + 1, number + 1, [], [], 0
            ids.append(batch.column(0).slice(begin))
        _words().clear()  # the worker lives on
        if texts:
            yield row()

    return map_in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"chunk bigint, doc_ids array<{kind}>, lengths binary, words binary")


def _bytes(column: pa.Array, dtype) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), dtype) for v in column]


def bucket_of(words: np.ndarray) -> np.ndarray:
    return (words & np.uint32(BUCKETS - 1)).astype(np.int32)


def bucket_counts(made: DataFrame) -> np.ndarray:
    """Words in each bucket, over all chunks."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for words in _bytes(batch.column(0), np.uint32):
                counts += np.bincount(bucket_of(words), minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen, pa.int64()), "n": pa.array(counts[seen])})

    counts = np.zeros(BUCKETS, np.int64)
    rows = map_in_arrow(made.select("words"), run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS rows
    counts[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return counts


class Network:
    """Rows of HIDDEN weights: a vector per input (the last one, outside, stays 0), a scale per place, a vector per digit and value."""

    SCALES = INPUTS + 1
    OUT = SCALES + len(PLACES)
    ROWS = OUT + DIGITS * BASE
    _SUMS = np.kron(np.eye(DIGITS), np.ones((BASE, 1))).astype(np.float32)

    def __init__(self, flat: np.ndarray, counts: np.ndarray):
        self.flat = flat.astype(np.float32).reshape(self.ROWS, HIDDEN)
        self.input, self.scale, self.out = self.flat[: self.SCALES], self.flat[self.SCALES : self.OUT], self.flat[self.OUT :]
        n, shares = counts.astype(float) + 0.01, []
        for level in range(DIGITS):
            upto = n.reshape(BASE ** (level + 1), -1).sum(axis=1).reshape(-1, BASE)
            shares.append(np.log(upto / upto.sum(axis=1, keepdims=True)).astype(np.float32))
        two = np.arange(BASE**2)
        self.upper = np.concatenate([shares[0][two >> 8], shares[1][two >> 4], shares[2][two]], axis=1)  # of the first three digits, by the first two
        self.lowest = shares[3]
        self.met = np.zeros(self.ROWS)
        self.heat = np.full(self.ROWS, 1e-4, np.float32)

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        flat = np.random.default_rng(5).normal(0, 0.3, (cls.ROWS, HIDDEN))
        flat[INPUTS] = 0
        flat[cls.SCALES : cls.OUT] = 1
        flat[cls.OUT :] = 0
        return cls(flat, counts)

    def _forward(self, line: np.ndarray):
        """Rows and vectors of the whole line; of its places but two at each end the bucket, the hidden layer, the logits and where their digits are in them."""
        rows = np.where(line < 0, INPUTS, line & (INPUTS - 1))
        x, bucket, n = self.input[rows], line[2:-2], len(line) - 4
        h = sum(x[2 + p : 2 + p + n] * self.scale[k] for k, p in enumerate(PLACES))
        np.tanh(h, out=h)
        z = h @ self.out.T
        z[:, : 3 * BASE] += self.upper[bucket >> 8]
        z[:, 3 * BASE :] += self.lowest[bucket >> 4]
        own = np.stack([d * BASE + (bucket >> 4 * (DIGITS - 1 - d) & (BASE - 1)) for d in range(DIGITS)], axis=1) + np.arange(n)[:, None] * (DIGITS * BASE)
        return rows, x, bucket, h, z, own

    def log_probs(self, line: np.ndarray) -> np.ndarray:
        """Log P(bucket | the two on either side) of every word of a line of buckets, -1 being outside."""
        found = [np.empty(0)]
        for i in range(0, len(line) - 4, BATCH):
            _, _, bucket, _, z, own = self._forward(line[i : i + BATCH + 4])
            chosen = z.reshape(-1)[own].sum(axis=1, dtype=float)
            np.exp(z, out=z)
            found.append((chosen - np.log(z @ self._SUMS).sum(axis=1))[bucket >= 0])
        return np.concatenate(found)

    def gradient(self, line: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of minus the summed log-probability of all words but two at each end: rows and their gradients."""
        rows, x, bucket, h, z, own = self._forward(line)
        np.exp(z, out=z)
        z *= (1 / (z @ self._SUMS)) @ self._SUMS.T
        z.reshape(-1)[own] -= 1
        z[bucket < 0] = 0
        back = (z @ self.out) * (1 - h * h)
        n, dx, scales = len(bucket), np.zeros_like(x), np.empty_like(self.scale)
        for k, p in enumerate(PLACES):
            dx[2 + p : 2 + p + n] += self.scale[k] * back
            scales[k] = np.einsum("ij,ij->j", x[2 + p : 2 + p + n], back)
        order = np.argsort(rows.astype(np.uint16), kind="stable")
        ordered = rows[order]
        begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        inputs, sums = ordered[begin], np.add.reduceat(dx[order], begin, axis=0)
        sums[inputs == INPUTS] = 0
        return [(inputs, sums), (np.arange(self.SCALES, self.OUT), scales), (np.arange(self.OUT, self.ROWS), z.T @ h)]

    def step(self, line: np.ndarray, rate: float) -> None:
        """One descent, each row's step scaled by the gradients it has had."""
        for rows, g in self.gradient(line):
            self.heat[rows] += np.einsum("ij,ij->i", g, g) / HIDDEN
            self.flat[rows] -= (rate / np.sqrt(self.heat[rows]))[:, None] * g
            self.met[rows] += 1


def laid_out(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words with two places outside (-1) around each text, and the number of each word's text."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    line = np.full(len(words) + 2 * (len(lengths) + 1), -1, np.int32)
    line[np.arange(len(words)) + 2 * (owner + 1)] = bucket_of(words)
    return line, owner


def train(made: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    network = Network.start(counts)
    for turn in range(rounds):
        shared = made.sparkSession.sparkContext.broadcast(pickle.dumps((network.flat, counts)))  # bound by parameters

        def run(batches):
            own = Network(*pickle.loads(shared.value))
            start = own.flat.copy()
            for batch in batches:
                for lengths, words in zip(_bytes(batch.column(0), np.int64), _bytes(batch.column(1), np.uint32), strict=True):
                    line = laid_out(words, lengths)[0]
                    for i in range(0, len(line) - 4, BATCH):
                        own.step(line[i : i + BATCH + 4], rate)
            if own.met.any():
                for i in range(0, Network.ROWS, BLOCK):
                    met = own.met[i : i + BLOCK].astype(np.float32)
                    change = (own.flat[i : i + BLOCK] - start[i : i + BLOCK]) * met[:, None]
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i // BLOCK]), "change": pa.array([change.tobytes()]), "met": pa.array([met.tobytes()])})

        def add(table: pa.Table) -> pa.Table:
            change = sum(x.astype(float) for x in _bytes(table["change"].combine_chunks(), np.float32)).reshape(-1, HIDDEN)
            met = sum(x.astype(float) for x in _bytes(table["met"].combine_chunks(), np.float32))
            return pa.table({"block": table["block"].slice(0, 1), "change": pa.array([(change / np.maximum(met, 1)[:, None]).astype(np.float32).tobytes()])})

        of_turn = made.where(F.pmod(F.xxhash64("chunk"), F.lit(rounds)) == turn).select("lengths", "words")
        changes = map_in_arrow(of_turn, run, "block bigint, change binary, met binary").groupBy("block").applyInArrow(add, "block bigint, change binary").toArrow()  # Network.ROWS rows of weights
        flat = network.flat.copy()
        for block, change in zip(changes["block"].to_pylist(), _bytes(changes["change"].combine_chunks(), np.float32), strict=True):
            flat[block * BLOCK : (block + 1) * BLOCK] += change.reshape(-1, HIDDEN)
        network = Network(flat, counts)
        shared.unpersist()
    return network


def keys_of(words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """The words of all texts that have any, each text followed by one end; and 48-bit keys of these places, and of each with the one before it."""
    lengths = lengths[lengths > 0]
    ends = np.cumsum(lengths + 1)
    line = np.full(len(words) + len(lengths), OUTSIDE, np.uint64)
    inside = np.ones(len(line), bool)
    inside[ends - 1] = False
    line[inside] = words
    before = np.concatenate([np.full(min(1, len(line)), OUTSIDE, np.uint64), line[:-1]])
    return line, (mixed(line) >> np.uint64(16), mixed((before << np.uint64(32)) | line) >> np.uint64(16))


def parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where each part of sorted keys begins, and their end: equal ranges of the key."""
    return np.append(np.searchsorted(keys, np.array([(i << 48) // parts for i in range(parts)], np.uint64)), len(keys))


def packed(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as the steps between them; their high parts are mostly zero and compress away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.astype(np.uint32).tobytes() + (steps >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.cumsum(np.frombuffer(raw, np.uint32, n).astype(np.uint64) | np.frombuffer(raw, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def short(counts: np.ndarray) -> bytes:
    """Counts in a byte each; larger ones follow at the end."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype(np.uint64).tobytes()


def long(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, np.uint64, -1, n) if len(raw) > n else 0
    return counts


def key_totals(made: DataFrame, parts: int) -> DataFrame:
    """chunk, part, asked (number of keys), totals: how often the distinct keys that a chunk has in a part, in order, occur in all. Parts from `parts` on are of pairs."""

    def ask(batches):
        for batch in batches:
            for chunk, lengths, words in zip(batch.column(0).to_pylist(), _bytes(batch.column(1), np.int64), _bytes(batch.column(2), np.uint32), strict=True):
                rows = []
                for kind, keys in enumerate(keys_of(words, lengths)[1]):
                    keys.sort()
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else keys.astype(int)
                    n, keys = np.diff(np.append(first, len(keys))), keys[first]
                    begin = parts_of(keys, parts).tolist()
                    rows += [(chunk, kind * parts + i, packed(keys[a:z]), short(n[a:z])) for i, (a, z) in enumerate(zip(begin[:-1], begin[1:], strict=True)) if a < z]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["chunk", "part", "keys", "n"])

    def add(table: pa.Table) -> pa.Table:
        keys = [unpacked(x.as_buffer()) for x in table["keys"].combine_chunks()]
        _, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.concatenate([long(x.as_buffer(), len(k)) for x, k in zip(table["n"].combine_chunks(), keys, strict=True)])
        total = np.bincount(place, n)[place].astype(np.int64)
        pieces = np.split(total, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table({"chunk": table["chunk"], "part": table["part"], "asked": pa.array([len(k) for k in keys]), "totals": pa.array([short(x) for x in pieces], pa.binary())})

    asked = map_in_arrow(made.select("chunk", "lengths", "words"), ask, "chunk bigint, part bigint, keys binary, n binary")
    return asked.groupBy("part").applyInArrow(add, "chunk bigint, part bigint, asked bigint, totals binary")


def mixed_with_counts(net: np.ndarray, pair: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """P(word | one neighbour): the counts without the hidden place, and the network's prediction for the rest."""
    own = 4 + 2 * np.sqrt(beside - 1)
    return (pair - 1 + own * net) / (beside - 1 + own)


def score(made: DataFrame, network: Network, counts: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob; the counts are those of the chunks."""
    spark = made.sparkSession
    ship(spark)
    parts = 1 + 2 * int(counts.sum()) // PART_KEYS
    shared = spark.sparkContext.broadcast(pickle.dumps((network.flat, counts)))  # bound by parameters

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        own = Network(*pickle.loads(shared.value))
        out = []
        for ids, n, words in zip(table["doc_ids"].combine_chunks(), _bytes(table["lengths"].combine_chunks(), np.int64), _bytes(table["words"].combine_chunks(), np.uint32), strict=True):
            total = np.zeros(len(n))
            if len(words):
                line, keys = keys_of(words, n)
                inside = np.flatnonzero(line != OUTSIDE)
                places = [np.unique(k, return_inverse=True)[1] for k in keys]
                answers = answers.sort_by("part").combine_chunks()
                totals = np.concatenate([long(x.as_buffer(), k) for x, k in zip(answers["totals"], answers["asked"].to_pylist(), strict=True)]).astype(float)
                single, double = totals[places[0]], totals[places[1] + places[0].max() + 1]
                buckets, owner = laid_out(words, n)
                net = np.exp(own.log_probs(buckets)) * single[inside] / counts[bucket_of(words)]
                before = mixed_with_counts(net, double[inside], single[inside - 1])  # at the very first place this is the last one, an end too
                after = mixed_with_counts(net, double[inside + 1], single[inside + 1])
                total = np.bincount(owner, np.log((before + after) / 2), len(n))
            total[n == 0] = 0
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            out.append(pa.table({"doc_id": ids.values, "n_tokens": pa.array(n), "log_prob": pa.array(total), "mean_log_prob": mean}))
        return pa.concat_tables(out)

    kind = made.schema["doc_ids"].dataType.elementType.simpleString()
    return (
        made.groupBy("chunk")
        .cogroup(key_totals(made, parts).groupBy("chunk"))
        .applyInArrow(run, f"doc_id {kind}, n_tokens bigint, log_prob double, mean_log_prob double")
    )


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, log_prob, mean_log_prob; the chunks stay in the shared folder until the result has been read."""
    made = materialize(chunks(docs), "chunks")
    counts = bucket_counts(made)
    return score(made, train(made, counts, rounds), counts)


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(read(spark, sf_dir, "documents"))
