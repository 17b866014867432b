"""A mounted tree as a listing: spark.read.format("posix_listing").option("root", ...).

The tree must be mounted on every executor. A shallow first listing on the driver gives one
input partition per subtree; one with very many names is cut into slices of `slice` names,
each a partition that looks up its own names only. Entries are never followed through links,
`.` and `..` do not occur, and an entry that vanishes while it is read is no error. Extended
attributes (ACLs among them) are read where `xattrs` is true; null where they cannot be.
"""

from __future__ import annotations

import os
import stat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, StringStartsWith

_SCHEMA = (
    "rel_path string, type string, mode int, uid bigint, gid bigint, size bigint, atime_ns bigint, mtime_ns bigint, dev bigint, ino bigint, nlink int, "
    "rdev_major bigint, rdev_minor bigint, blocks bigint, link_target string, xattrs map<string,binary>, stat_errno int"
)
_KINDS = (
    (stat.S_ISREG, "FILE"), (stat.S_ISDIR, "DIR"), (stat.S_ISLNK, "SYMLINK"), (stat.S_ISCHR, "CHARDEV"),
    (stat.S_ISBLK, "BLOCKDEV"), (stat.S_ISFIFO, "FIFO"), (stat.S_ISSOCK, "SOCKET"),
)


class Subtree(InputPartition):
    """A directory, read with everything beneath it or for its own entries only; or some of its names."""

    def __init__(self, path: str, deep: bool, names: tuple[str, ...] | None = None):
        super().__init__((path, deep, names))
        self.path = path
        self.deep = deep
        self.names = names


def _xattrs(path: str) -> dict[str, bytes] | None:
    try:
        return {name: os.getxattr(path, name, follow_symlinks=False) for name in os.listxattr(path, follow_symlinks=False)}
    except OSError:
        return None


def _row(root: str, rel: str, xattrs: bool = False) -> tuple | None:
    path = os.path.join(root, rel)
    try:
        s = os.lstat(path)
        target = os.readlink(path) if stat.S_ISLNK(s.st_mode) else None
    except FileNotFoundError:
        return None
    except OSError as e:
        return (rel, *[None] * 15, e.errno)
    kind = next((k for test, k in _KINDS if test(s.st_mode)), None)
    signed = lambda n: n - 2**64 if n >= 2**63 else n
    size = 0 if kind == "DIR" else s.st_size
    return (
        rel, kind, stat.S_IMODE(s.st_mode), s.st_uid, s.st_gid, size, s.st_atime_ns, s.st_mtime_ns, signed(s.st_dev), signed(s.st_ino), s.st_nlink,
        os.major(s.st_rdev), os.minor(s.st_rdev), s.st_blocks, target, _xattrs(path) if xattrs else None, 0,
    )


def _children(root: str, rel: str) -> tuple[list[str], list[str]]:
    """Names in a directory, and those of them that are directories; none if it vanished."""
    try:
        with os.scandir(os.path.join(root, rel)) as found:
            entries = sorted((e.name, e.is_dir(follow_symlinks=False)) for e in found)
    except OSError:
        return [], []
    join = lambda name: f"{rel}/{name}" if rel else name
    return [join(n) for n, _ in entries], [join(n) for n, d in entries if d]


class PosixReader(DataSourceReader):
    def __init__(self, root: str, split_depth: int, names: int, xattrs: bool):
        self.root, self.split_depth, self.slice, self.xattrs, self.prefix = root, split_depth, names, xattrs, ""

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("rel_path",):
                self.prefix = f.value
            yield f  # Spark filters again: pruning is by directory only

    def _may_hold(self, rel: str) -> bool:
        return not rel or f"{rel}/".startswith(self.prefix) or self.prefix.startswith(f"{rel}/")

    def partitions(self):
        parts, level = [], [""]
        for depth in range(self.split_depth + 1):
            last, below = depth == self.split_depth, []
            for rel in level:
                names, dirs = _children(self.root, rel)
                dirs = [d for d in dirs if self._may_hold(d)]
                if len(names) > self.slice:  # a wide directory: its names in slices, and what lies beneath them
                    parts += [Subtree(rel, last, tuple(names[i : i + self.slice])) for i in range(0, len(names), self.slice)]
                else:
                    parts.append(Subtree(rel, last))
                below += dirs
            level = below
            if last or not level:
                break
        return parts

    def read(self, partition):
        if partition.names is None:
            todo = [partition.path]
        else:
            todo = []
            for rel in partition.names:
                yield from self._entry(rel)
                if partition.deep and self._may_hold(rel) and _is_dir(self.root, rel):
                    todo.append(rel)
        while todo:
            names, dirs = _children(self.root, todo.pop())
            for rel in names:
                yield from self._entry(rel)
            if partition.deep:
                todo += [d for d in dirs if self._may_hold(d)]

    def _entry(self, rel: str):
        row = _row(self.root, rel, self.xattrs) if rel.startswith(self.prefix) else None
        if row:
            yield row


def _is_dir(root: str, rel: str) -> bool:
    path = os.path.join(root, rel)
    return os.path.isdir(path) and not os.path.islink(path)


class PosixListing(DataSource):
    """Options: root, split_depth (levels of directories that become partitions, default 1), slice (names of a partition, default 4000), xattrs (default true)."""

    @classmethod
    def name(cls):
        return "posix_listing"

    def schema(self):
        return _SCHEMA

    def reader(self, schema):
        return PosixReader(self.options["root"].rstrip("/") or "/", int(self.options.get("split_depth", 1)), int(self.options.get("slice", 4000)), str(self.options.get("xattrs", "true")).lower() == "true")


def read_posix(spark, root: str, split_depth: int = 1, names: int = 4000, xattrs: bool = True):
    """The listing of a mounted tree; directories of the first levels with more than `names` entries are read in slices."""
    from driftline.shipping import ship

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PosixListing)
    return spark.read.format("posix_listing").option("root", root).option("split_depth", split_depth).option("slice", names).option("xattrs", xattrs).load()
