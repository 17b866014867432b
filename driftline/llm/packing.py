"""Best-fit packing of documents into sequences of at most 2048 tokens.

Documents become ids (with an end id), documents longer than a sequence are cut into
pieces, and pieces are packed by their lengths alone: the counts of lengths are at most
2048 numbers whatever the corpus, so the plan is made from them on the driver, and pieces
take their places by rank within their length. The plan goes through the lengths from the
longest; the gap each leaves is looked up among the sums of one, two and three lengths
still there, a combination that fills it exactly is used as often as the counts allow, and
what has no exact complement is filled by the longest lengths that fit.

Ranks within one length are counted per salt and then offset; a length has a salt for every
`rows_per_salt` pieces, so one that a third of all pieces have is spread over as many tasks as it
needs. Slots of a length are looked up by blocks of ranks, about two to a block.

Defined cases: a null or empty text is the end id alone; a very long text is cut, every
piece but the last full; repeated rows are packed as rows of their own; null doc_ids are
kept; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import materialize, read

CAPACITY = 2048
END_ID = 0
ROWS_PER_SALT = 250_000
#: Cached words per Python worker, of at most so many bytes (about 200 with what they map to); beyond it the cache starts anew.
CACHE_WORDS, LONGEST = 700_000, 64


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """Ids, as little-endian unsigned 32-bit bytes, of what stands between white space.

    The tokenizer never joins anything across white space, so a text's ids are those of its
    words in turn. Words of plain letters go through the same merges held as ranks, which
    is three times as fast; all others go through the tokenizer itself.
    """

    #: The tokenizer's own pattern for lower-case Latin text.
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ranks = None
        if model.get("end_of_word_suffix") == "</w>":
            ranks, ids = _as_ranks(model)
            self.ranks = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
            self.ids = [i.to_bytes(4, "little") for i in ids]

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if self.ranks and self.PLAIN.fullmatch(text) and "<|" not in text:
            parts = "\0".join(self.PARTS.findall(text.lower())) + "\0"
            out = b"".join(map(self.ids.__getitem__, self.ranks.encode_ordinary(parts)))
        else:
            out = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        if len(word) <= LONGEST:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


def _as_ranks(model: dict) -> tuple[dict[bytes, int], list[int]]:
    """The merges as ranks of byte strings, a zero byte standing for the end of a word, and each rank's id."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}

    def raw(token: str) -> bytes:
        stem = token.removesuffix("</w>")
        return bytes(byte_of[c] for c in stem) + b"\0" * (stem != token)

    ranks: dict[bytes, int] = {}
    ids: list[int] = []

    def add(key: bytes, token: str) -> None:
        if key not in ranks:
            ranks[key] = len(ids)
            ids.append(model["vocab"].get(token, 0))

    by_byte = sorted(byte_of.items(), key=lambda x: x[1])
    for char, b in by_byte:
        add(bytes([b]), char)
    for char, b in by_byte:
        if b:
            add(bytes([b, 0]), char + "</w>")
    for merge in model["merges"]:
        token = "".join(merge if isinstance(merge, list) else merge.split(" "))
        add(raw(token), token)
    return ranks, ids


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""
    path = tokenizer or default_tokenizer()
    end = END_ID.to_bytes(4, "little")
    fields = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]

    def pieces(batches):
        ids = word_ids(path)
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                rows, values = [], []
                for k, text in enumerate(part.column(1)):
                    raw = b"".join(map(ids.__getitem__, (text.as_buffer().to_pybytes() if text.is_valid else b"").split())) + end
                    view = memoryview(raw)
                    for n, i in enumerate(range(0, len(raw), 4 * capacity)):
                        piece = view[i : i + 4 * capacity]
                        rows.append((k, n, i // 4, len(piece) // 4, zlib.crc32(piece)))
                        if with_ids:
                            values.append(piece.cast("I").tolist())
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                out = [part.column(0).take(pa.array(columns[0], pa.int32()))]
                out += [pa.array(c, t) for c, (_, t) in zip(columns[1:], fields, strict=True)]
                if with_ids:
                    out.append(pa.array(values, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *(f for f, _ in fields), *["ids"] * with_ids])
        ids.clear()  # the worker lives on, beside others

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return map_in_arrow(docs.select("doc_id", F.col("text").cast("string").alias("text")), pieces, schema)


class _Sums:
    """Which lengths, and sums of two and three of them, are available: bit s of a big integer stands for s."""

    def __init__(self, counts: list[int]):
        self.counts = counts
        self.stale = True

    def index(self) -> None:
        if self.stale:
            self.lengths = [n for n in range(len(self.counts) - 1, 0, -1) if self.counts[n]]
            self.one = sum(1 << n for n in self.lengths)
            self.two = 0
            for n in self.lengths:
                self.two |= self.one << n
            self.three = None
            self.stale = False

    def exact(self, gap: int, taken: list[int]) -> list[int] | None:
        """One, two or three lengths that sum to gap, the longest first, within the counts left beside those taken."""
        if self._left(gap, taken):
            return [gap]
        self.index()
        if self.two >> gap & 1 and (found := self._pair(gap, taken)):
            return found
        if self.three is None:
            self.three = 0
            for n in self.lengths:
                self.three |= self.two << n
        if self.three >> gap & 1:
            for n in self.lengths:
                if n < gap and self.two >> (gap - n) & 1 and self._left(n, taken) and (found := self._pair(gap - n, [*taken, n])):
                    return [n, *found]
        return None

    def _pair(self, gap: int, taken: list[int]) -> list[int] | None:
        for n in self.lengths:
            if n < gap and 2 * n >= gap and self.one >> (gap - n) & 1 and self._left(n, taken) and self._left(gap - n, [*taken, n]):
                return [n, gap - n]
        return None

    def _left(self, n: int, taken: list[int]) -> bool:
        return self.counts[n] > taken.count(n)

    def best_fit(self, gap: int, taken: list[int]) -> list[int]:
        self.index()
        found: list[int] = []
        for n in self.lengths:
            while n <= gap and self._left(n, [*taken, *found]):
                found.append(n)
                gap -= n
        return found


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """[(lengths of one sequence, how many such sequences)] that use up the counts of lengths."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    sums, plan = _Sums(left), []
    for longest in range(capacity, 0, -1):
        while left[longest]:
            items = [longest]
            if longest < capacity:
                items += sums.exact(capacity - longest, items) or sums.best_fit(capacity - longest, items)
            times = min(left[n] // items.count(n) for n in set(items))
            for n in items:
                left[n] -= times
                sums.stale |= not left[n]
            plan.append((items, times))
    return plan


def pack_sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """The pieces with sequence_id and offset."""
    spark = docs.sparkSession
    pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, first, sequences = [], {}, 0
    for items, times in packing_plan(counts, capacity):
        at = 0
        for n in items:
            slots.append((n, first.get(n, 0), times, sequences, at))
            first[n] = first.get(n, 0) + times
            at += n
        sequences += times
    many = Counter(slot[0] for slot in slots)
    ranks = {n: -(-counts[n] // many[n]) for n in many}  # of a block; a length has no more blocks than slots
    blocks = [(*slot, b) for slot in slots for b in range(slot[1] // ranks[slot[0]], (slot[1] + slot[2] - 1) // ranks[slot[0]] + 1)]
    slots = spark.createDataFrame(blocks, "slot_length bigint, first bigint, times bigint, sequence bigint, offset bigint, slot_block bigint")
    lengths = spark.createDataFrame([(n, -(-counts[n] // rows_per_salt), ranks[n]) for n in many], "length bigint, salts bigint, ranks bigint")
    pieces = pieces.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "salts"))  # at most `capacity` rows
    salted = pieces.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        F.col("length").alias("o_length"), F.col("salt").alias("o_salt"), "before"
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        pieces.withColumn("own", F.row_number().over(own) - 1)
        .join(offsets, (F.col("length") == F.col("o_length")) & (F.col("salt") == F.col("o_salt")))  # pieces lie by these keys since the window
        .withColumn("rank", F.col("own") + F.col("before"))
        .withColumn("block", F.expr("rank div ranks"))
    )
    placed = ranked.join(
        F.broadcast(slots),  # its size is bound by the capacity, not by the corpus
        (F.col("length") == F.col("slot_length")) & (F.col("block") == F.col("slot_block")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("times")),
    )
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset", *["ids"] * with_ids,
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_sequences(read(spark, sf_dir, "documents"))
