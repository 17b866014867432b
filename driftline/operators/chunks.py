"""Objects in pieces: checked and written piece by piece, so that no row or task ever holds a whole object.

pieces: rel_path, offset, data (binary), in any order. An object's pieces go to one task, which
takes them in order of their offsets; its memory is that of an Arrow batch, whatever the object's size. A checksum of a
whole object is sequential by nature; objects are what is done in parallel.

Defined cases: a piece that comes again at the same offset counts once; with a gap, an overlap, null data or no piece at
offset 0 an object is not whole: size and sum are null and nothing is written; an empty object is one empty piece.
"""

from __future__ import annotations

import hashlib
import os
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.shipping import map_in_arrow

RESULT = "rel_path string, size bigint, sum string, whole boolean"


class _Object:
    """What is known of an object after some of its pieces."""

    def __init__(self, path: str | None):
        self.path, self.size, self.last, self.whole, self.sha = path, 0, None, True, hashlib.sha256()

    def take(self, offset: int | None, data: pa.Scalar) -> None:
        if not self.whole or (offset is not None and offset == self.last):
            return
        if offset != self.size or not data.is_valid:
            self.whole = False
            return
        piece = data.as_buffer()
        self.sha.update(piece)
        self.keep(piece)
        self.last, self.size = offset, self.size + piece.size

    def keep(self, piece: pa.Buffer) -> None:
        """Nothing is kept where only the sum is asked for."""

    def end(self) -> tuple:
        return (self.path, self.size, self.sha.hexdigest(), True) if self.whole else (self.path, None, None, False)


class _File(_Object):
    """An object written to a name of its own beside its place, which it takes when it is whole."""

    def __init__(self, path: str | None, folder: str):
        super().__init__(path)
        if not path or ".." in path or path.startswith("/"):
            raise ValueError(f"refused path {path!r}")
        self.place = os.path.join(folder, path)
        os.makedirs(os.path.dirname(self.place), exist_ok=True)
        self.part = f"{self.place}.{uuid.uuid4().hex}.part"
        self.file = open(self.part, "wb")

    def keep(self, piece: pa.Buffer) -> None:
        self.file.write(piece)

    def end(self) -> tuple:
        self.file.close()
        if self.whole:
            os.replace(self.part, self.place)
        else:
            os.remove(self.part)
        return super().end()


def _in_order(pieces: DataFrame, begin) -> DataFrame:
    def run(batches):
        now = None
        for b in batches:
            ended = []
            data = b.column(2)
            for i, (path, offset) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if now is None or now.path != path:
                    if now is not None:
                        ended.append(now.end())
                    now = begin(path)
                now.take(offset, data[i])
            yield _batch(ended)
        if now is not None:
            yield _batch([now.end()])

    ordered = pieces.select(F.col("rel_path").cast("string").alias("rel_path"), F.col("offset").cast("long").alias("offset"), "data")
    return map_in_arrow(ordered.repartition("rel_path").sortWithinPartitions("rel_path", "offset"), run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["rel_path", "size", "sum", "whole"])


def stream_sums(pieces: DataFrame) -> DataFrame:
    """rel_path, size, sum (SHA-256 as content_sum() gives it) and whole, a row per object."""
    return _in_order(pieces, _Object)


def verify_pieces(src: DataFrame, dst: DataFrame) -> DataFrame:
    """rel_path, ok: whether both sides hold the object whole and with the same content; for objects of either side."""
    a, b = (stream_sums(side).select("rel_path", F.col("sum").alias(name)) for side, name in ((src, "a"), (dst, "b")))
    return a.join(b, "rel_path", "full").select("rel_path", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("ok"))


def write_objects(pieces: DataFrame, folder: str) -> DataFrame:
    """As stream_sums(), and each whole object is a file below a folder that all executors mount.

    Nothing is written before the result is read. A file appears whole or not at all, and a task
    that runs again replaces it by the same content.
    """
    return _in_order(pieces, lambda path: _File(path, folder))
