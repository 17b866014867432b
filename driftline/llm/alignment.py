"""Alignment of two tokenizers: which tokens of one cover which of the other, over the corpus.

Texts are deduplicated exactly: rows are grouped by their whole text, so each distinct text
is tokenised and aligned once, however many documents have it, and what it says of pairs of
ids weighs as many documents. Measures go back to the documents by a join on the SHA-256 of
the text (copies are counted before the shuffle, and a very common text on the documents'
side of that join is one that adaptive execution splits).

Neither tokenizer joins anything across a single space or line end between two characters
that are no white space (the pieces of the second are searched for such ones), so a text is
cut there into units, and units are aligned once a worker: a text of n words costs n look-ups,
and new units are encoded and aligned together, as arrays. Whatever else a unit holds (runs of
spaces, tabs) goes through the tokenizers as it stands.

Two tokenisations of the same bytes overlap in as many pairs as there are ends of tokens of
either kind; where both end, a group ends.

The counts of pairs are at most as many as pairs of ids that ever overlap. They are sent to
all executors only if they number at most BROADCAST_PAIRS, else they are joined by a shuffle.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte
by byte (U+2581 for the second), have no tokens: zeros and an empty digest; a very long text
is aligned whole; repeated rows give repeated results, and each counts as a document; null
doc_ids are kept; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

from .common import materialize, read

#: Pairs with counts that are sent to all executors; about 24 bytes each there.
BROADCAST_PAIRS = 1_000_000
#: Units a Python worker keeps, and the longest one that it keeps; beyond it starts anew.
CACHE_UNITS, LONGEST = 250_000, 48
#: Words of the texts that are aligned together.
CHUNK = 1 << 17
#: Fixed value: how byte-level BPE cuts a text before its merges.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """ids of texts, and the bytes of each id, of a byte-level BPE in a tokenizers file; special tokens are ordinary text."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = {t["content"] for t in whole["added_tokens"]}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in whole["model"]["vocab"].items() if token not in special}
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.own = tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})  # merges are in the order of ids

    def encode(self, units: list[str]) -> list[list[int]]:
        return [self.own.encode_ordinary(u) for u in units]


class Pieces:
    """ids of texts (with a space before), and the bytes of each id, of a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.vocab_size())]
        self.bytes_of = {i: bytes([int(p[1:-1], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)}
        #: Whether no piece reaches across a space or the start of a line.
        self.cut = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        """Units begin with a space, which the model adds, or with a line end, before which its own space goes."""
        found = self.own.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return [ids if u[0] == " " else ids[1:] for u, ids in zip(units, found, strict=True)]


class Side:
    """By id: the length in bytes, and the text of an id after each of the separators."""

    def __init__(self, bytes_of: dict[int, bytes], separators: tuple[bytes, ...]):
        self.bytes_of, n = bytes_of, max(bytes_of) + 1
        self.size = np.zeros(n, np.int64)
        self.size[list(bytes_of)] = list(map(len, bytes_of.values()))
        texts = [[sep + b"%d" % i for i in range(n)] for sep in separators]
        self.text = np.array(texts, object)
        self.long = np.array([[len(t) for t in row] for row in texts])


def align_units(a: Side, b: Side, ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """measures (four columns), the groups as text, and the pairs of units whose two lists of ids have the same bytes."""
    n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    flat_a, flat_b = (np.array([i for x in ids for i in x], np.int64) for ids in (ids_a, ids_b))
    ends_a, ends_b = np.cumsum(a.size[flat_a]), np.cumsum(b.size[flat_b])  # over all units, which follow each other without a gap
    cuts = np.union1d(ends_a, ends_b)
    pairs = flat_a[np.searchsorted(ends_a, cuts)] << 32 | flat_b[np.searchsorted(ends_b, cuts)]
    groups = np.intersect1d(ends_a, ends_b, assume_unique=True)
    unit_ends = ends_a[np.cumsum(n_a) - 1]
    n_groups = np.diff(np.searchsorted(groups, unit_ends, side="right"), prepend=0)
    n_links = np.diff(np.searchsorted(cuts, unit_ends, side="right"), prepend=0)
    # the ids in the order of the groups' text, each after `;` or nothing, `,` or `|`
    group_a, group_b = np.searchsorted(groups, ends_a), np.searchsorted(groups, ends_b)
    starts_unit = np.zeros(len(groups), bool)
    starts_unit[np.cumsum(n_groups) - n_groups] = True
    first_a, first_b = np.r_[True, group_a[1:] != group_a[:-1]], np.r_[True, group_b[1:] != group_b[:-1]]
    kind_a = np.where(first_a, np.where(starts_unit[group_a], 2, 0), 1)
    order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    kind_b = np.where(first_b, 0, 1)
    texts = np.concatenate([a.text[kind_a, flat_a], b.text[kind_b, flat_b]])[order]
    long = np.concatenate([a.long[kind_a, flat_a], b.long[kind_b, flat_b]])[order]
    whole = b"".join(texts.tolist())
    ends = np.cumsum(long)[np.cumsum(n_a + n_b) - 1].tolist()
    return np.stack([n_a, n_b, n_groups, n_links], axis=1), [whole[x:y] for x, y in zip([0, *ends], ends, strict=False)], pairs


class Units(dict):
    """The number of each unit met; what is known of units is held by number."""

    CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

    def __init__(self, path_a: str, path_b: str):
        super().__init__()
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.side_a, self.side_b = Side(self.a.bytes_of, (b";", b",", b"")), Side(self.b.bytes_of, (b"|", b","))
        self.forget()

    def cut(self, text: str) -> list[str]:
        """The units of a text with a space before it."""
        return self.CUT.split(" " + text) if self.b.cut else [" " + text]

    def forget(self) -> None:
        self.clear()
        self.groups: list[bytes] = []
        self.whole = np.empty(0, bool)
        self.measures = np.empty((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.pairs = np.empty(0, np.int64)

    def learn(self, units: list[str]) -> None:
        if not units:
            return
        ids_a, ids_b = self.a.encode(units), self.b.encode(units)
        bytes_a, bytes_b = self.side_a.bytes_of, self.side_b.bytes_of
        whole = [b"".join([bytes_a[i] for i in x]) == b"".join([bytes_b[i] for i in y]) == u.encode() for u, x, y in zip(units, ids_a, ids_b, strict=True)]
        if not all(whole):
            units = [u for u, w in zip(units, whole, strict=True) if w] + [u for u, w in zip(units, whole, strict=True) if not w]
            ids_a, ids_b = ([x for x, w in zip(ids, whole, strict=True) if w] for ids in (ids_a, ids_b))
        sound, n = sum(whole), len(self.groups)
        self.update(zip(units, range(n, n + len(units)), strict=True))
        self.whole = np.concatenate([self.whole, np.arange(len(units)) < sound])
        measures, groups, pairs = align_units(self.side_a, self.side_b, ids_a, ids_b) if sound else (np.empty((0, 4), np.int64), [], self.pairs[:0])
        lost = len(units) - sound
        self.groups += groups + [b""] * lost
        self.measures = np.concatenate([self.measures, measures, np.zeros((lost, 4), np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.r_[measures[:, 3], np.zeros(lost, np.int64)])])
        self.pairs = np.concatenate([self.pairs, pairs])


@lru_cache(maxsize=1)
def units_of(path_a: str, path_b: str) -> Units:
    return Units(path_a, path_b)


def _aligned(known: Units, raw: list[bytes]) -> list[tuple]:
    """Per text: the four measures, the groups, the distinct pairs and how often each is linked; None for texts that do not come back."""
    texts = []
    for t in raw:
        try:
            texts.append(known.cut(t.decode()) if t else None)
        except UnicodeDecodeError:
            texts.append(None)
    valid = [t for t in texts if t is not None]
    new = set().union(*valid) - known.keys()
    if len(known) + len(new) > CACHE_UNITS:
        known.forget()
        new = set().union(*valid)
    known.learn(sorted(new))
    out: list[tuple | None] = []
    for t in texts:
        numbers = list(map(known.__getitem__, t or ()))
        at = np.array(numbers, np.int64)
        if not numbers or not known.whole[at].all():
            out.append(None)
            continue
        first, many = known.starts[at], known.starts[at + 1] - known.starts[at]
        flat = known.pairs[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        pairs, links = np.unique(flat, return_counts=True)
        out.append((*known.measures[at].sum(axis=0).tolist(), b";".join(map(known.groups.__getitem__, numbers)), pairs, links))
    for u in [u for u in new if len(u) > LONGEST]:
        del known[u]
    return out


def align_texts(texts: DataFrame, tokenizers: tuple[str, str] | None = None) -> DataFrame:
    """All columns but text, n_a, n_b, n_groups, n_links, groups (`a1,a2|b1;a3|b2,b3`, null
    without tokens), pairs (id of the first tokenizer * 2**32 + id of the second) and links (how
    often each pair is linked). texts: text (string) and others.
    """
    paths = tokenizers or default_tokenizers()
    others = [c for c in texts.columns if c != "text"]

    def run(batches):
        known = units_of(*paths)
        for batch in batches:
            column, rest = batch.column(len(others)), batch.select(others) if others else None
            begun, part, n = 0, [], 0
            for k, text in enumerate(column):
                part.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
                n += len(part[-1]) // 6 + 1
                if n < CHUNK and k + 1 < len(column):
                    continue
                found = [x or (0, 0, 0, 0, None, (), ()) for x in _aligned(known, part)]
                measures, groups, pairs, links = zip(*[x[:4] for x in found], strict=True), *([x[i] for x in found] for i in (4, 5, 6))
                offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.asarray(v, np.int64) for v in values]), pa.int64())) for values in (pairs, links)]
                columns = [rest.column(c).slice(begun, len(part)) for c in range(len(others))] + [pa.array(m, pa.int64()) for m in measures]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(groups, pa.binary()), *lists], names=[*others, *MEASURES, "groups", "pairs", "links"])
                begun, part, n = k + 1, [], 0

    fields = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in others] + [f"{m} bigint" for m in MEASURES]
    schema = ", ".join([*fields, "groups binary", "pairs array<bigint>", "links array<bigint>"])
    found = map_in_arrow(texts.select(*others, F.col("text").cast("string").alias("text")), run, schema)
    return found.withColumn("groups", F.col("groups").cast("string"))


def pair_counts(aligned: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """pair, n (documents that hold it linked) and best (whether no pair of its first id has more). aligned: pairs, copies."""
    pairs = aligned.select(F.explode("pairs").alias("pair"), "copies")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("copies").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    highest = counts.groupBy(first.alias("a")).agg(F.max("n").alias("highest"))
    told = counts.join(highest, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    return F.broadcast(told) if counts.count() <= broadcast_pairs else told


def _key(text) -> object:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def align_documents(docs: DataFrame, tokenizers: tuple[str, str] | None = None, broadcast_pairs: int = BROADCAST_PAIRS, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups of each document."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", text.alias("text"))
    distinct = rows.where("text <> ''").groupBy("text").agg(F.count("*").alias("copies"))
    aligned = align_texts(distinct.withColumn("key", _key(F.col("text"))), tokenizers)
    digest = F.sha2(F.col("groups").cast("binary"), 256)
    aligned = materialize(aligned.select("key", "copies", *MEASURES, digest.alias("groups_sha256"), *["groups"] * with_groups, "pairs", "links").where("groups is not null" if with_groups else "groups_sha256 is not null"), "aligned")
    linked = aligned.select("key", F.explode(F.arrays_zip("pairs", "links")).alias("l")).select("key", F.col("l.pairs").alias("pair"), F.col("l.links").alias("links"))
    scored = linked.join(pair_counts(aligned, broadcast_pairs), "pair").groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("n")).alias("count_sum")
    )
    measures = aligned.drop("pairs", "links", "copies").join(scored, "key")
    # a document without text gets a key of its own, so that such documents are spread
    keyed = rows.select("doc_id", F.when(F.col("text") != "", _key(F.col("text"))).otherwise(F.col("doc_id").cast("string").cast("binary")).alias("key"))
    zero = F.lit(0).cast("long")
    return keyed.join(measures, "key", "left").select(
        "doc_id", *[F.coalesce(m, zero).alias(m) for m in (*MEASURES, "n_best", "count_sum")], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"), *["groups"] * with_groups
    )


def op11_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
