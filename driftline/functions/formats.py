"""Sizes, durations, numbers, modes, checksums, errno names and journal labels as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of byte sizes.
SIZE_UNITS = {"": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40}
#: Errno symbols of Linux that file operations give.
ERRNO_NAMES = {
    1: "EPERM", 2: "ENOENT", 4: "EINTR", 5: "EIO", 6: "ENXIO", 7: "E2BIG", 9: "EBADF", 11: "EAGAIN", 12: "ENOMEM", 13: "EACCES",
    14: "EFAULT", 16: "EBUSY", 17: "EEXIST", 18: "EXDEV", 19: "ENODEV", 20: "ENOTDIR", 21: "EISDIR", 22: "EINVAL", 23: "ENFILE",
    24: "EMFILE", 26: "ETXTBSY", 27: "EFBIG", 28: "ENOSPC", 29: "ESPIPE", 30: "EROFS", 31: "EMLINK", 32: "EPIPE", 34: "ERANGE",
    36: "ENAMETOOLONG", 38: "ENOSYS", 39: "ENOTEMPTY", 40: "ELOOP", 61: "ENODATA", 75: "EOVERFLOW", 95: "ENOTSUP", 107: "ENOTCONN",
    110: "ETIMEDOUT", 111: "ECONNREFUSED", 112: "EHOSTDOWN", 113: "EHOSTUNREACH", 116: "ESTALE", 121: "EREMOTEIO", 122: "EDQUOT",
}
#: Journal record types in display order, with label and category.
JOURNAL_TYPES = (
    ("COPIED", "copied", "nominal"),
    ("META_FIXED", "meta fixed", "nominal"),
    ("DELETED", "deleted", "nominal"),
    ("DIR_META", "dir meta", "nominal"),
    ("SKIPPED_CLEAN", "skipped (clean)", "nominal"),
    ("VERIFY_OK", "verify ok", "nominal"),
    ("LINK_CREATED", "hardlinks created", "nominal"),
    ("WOULD_COPY", "would copy (dry-run)", "informational"),
    ("WOULD_DELETE", "would delete (dry-run)", "informational"),
    ("NLINK_DUP", "hardlink duplicates", "informational"),
    ("ORPHAN", "orphans observed", "informational"),
    ("SRC_CHANGED", "source changed mid-copy", "informational"),
    ("LINK_FALLBACK", "hardlink groups fell back", "informational"),
    ("ERROR", "errors", "failure"),
    ("FIDELITY_EXCEPTION", "fidelity exceptions", "failure"),
    ("VERIFY_FAIL", "verify failed", "failure"),
)


def _lookup(key: Column, values: dict) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def parse_byte_size(text: Column) -> Column:
    """Bytes of a number with an optional KiB, MiB, GiB or TiB; null if it is neither."""
    form = r"^([0-9]+(?:\.[0-9]+)?)\s*(KiB|MiB|GiB|TiB)?$"
    s = F.trim(text)
    number = F.regexp_extract(s, form, 1).try_cast("double")
    return F.floor(number * _lookup(F.regexp_extract(s, form, 2), SIZE_UNITS)).cast("long")


def human_bytes(n: Column) -> Column:
    """Plain below 1024, else one decimal and the largest binary unit that gives 1 or more.

    The decimal is that of C and Go: the nearest to the double, a tie to the even digit. format_string() rounds ties up, so whole numbers are used.
    """
    whole = n.cast("double").cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate("KMGTPE", 1):
        half = 10 * k - 1
        fives = whole.bitwiseAND(F.lit((2 << half) - 1)) * 5  # tenths times half the unit: within a long for all units
        below, left = F.shiftright(whole, half + 1) * 10 + F.shiftright(fives, half), fives.bitwiseAND(F.lit((1 << half) - 1))
        tie = 1 << (half - 1)
        tenths = below + F.when(left > tie, 1).when(left == tie, below % 2).otherwise(0)
        scaled = F.concat(_div(tenths, 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
        out = F.when(n >= (1 << (10 * k)), F.concat(scaled, F.lit(f" {unit}iB"))).otherwise(out)
    return out


def _div(a: Column, n: int) -> Column:
    return F.call_function("div", a, F.lit(n))


def human_duration(ms: Column) -> Column:
    s = _div(ms, 1000)
    m = _div(s, 60)
    h = _div(m, 60)
    return (
        F.when(ms <= 0, "0s")
        .when(s < 60, F.format_string("%ds", s))
        .when(m < 60, F.format_string("%dm %ds", m, s % 60))
        .otherwise(F.format_string("%dh %dm", h, m % 60))
    )


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def octal_mode(mode: Column) -> Column:
    return F.lpad(F.conv(mode.cast("string"), 10, 8), 4, "0")


def mode_bits(mode: Column) -> dict[str, Column]:
    """The permission mask and the three special bits."""
    return {
        "perm": mode.bitwiseAND(F.lit(0o7777)),
        "setuid": mode.bitwiseAND(F.lit(0o4000)) != 0,
        "setgid": mode.bitwiseAND(F.lit(0o2000)) != 0,
        "sticky": mode.bitwiseAND(F.lit(0o1000)) != 0,
    }


def sum_hex(high: Column, low: Column) -> Column:
    """128 bits as 32 hexadecimal digits, both halves unsigned."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def unsigned(n: Column) -> Column:
    """A long whose bits are an unsigned 64-bit number, as a decimal."""
    n = n.cast("decimal(20,0)")
    return F.when(n < 0, n + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(n).cast("decimal(20,0)")


def verify_text(ok: Column, fail: Column) -> Column:
    return F.when(fail > 0, F.concat(commas(ok), F.lit(" ok / "), commas(fail), F.lit(" FAIL"))).otherwise(F.concat(commas(ok), F.lit(" ok")))


def errno_class(errno: Column) -> Column:
    return F.coalesce(_lookup(errno.cast("int"), ERRNO_NAMES), errno.cast("string"))


def type_category(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, {t: c for t, _, c in JOURNAL_TYPES}), F.lit("unknown"))


def type_order(kind: Column) -> Column:
    """Display order from 0; unknown types come last."""
    return F.coalesce(_lookup(kind, {t: i for i, (t, _, _) in enumerate(JOURNAL_TYPES)}), F.lit(len(JOURNAL_TYPES)))


def journal_label(kind: Column) -> Column:
    return F.coalesce(_lookup(kind, {t: label for t, label, _ in JOURNAL_TYPES}), F.lower(kind))


def ns_to_ts(ns: Column) -> Column:
    """Nanoseconds since the epoch as a timestamp, cut to microseconds."""
    return F.timestamp_micros(_div(ns - F.pmod(ns, F.lit(1000)), 1000))


def ts_to_ns(ts: Column) -> Column:
    return F.unix_micros(ts) * 1000


def temp_name(prefix: str, job: Column, pass_no: Column, item: Column, seq: Column) -> Column:
    parts = [F.lower(F.hex(x.cast("long"))) for x in (job, pass_no, item, seq)]
    return F.concat(F.lit(prefix), parts[0], F.lit("-"), parts[1], F.lit("."), parts[2], F.lit("."), parts[3])


def temp_tag(tail: Column) -> tuple[Column, Column]:
    """Job and pass of what follows the prefix, as hexadecimal without leading zeros; null if malformed or over 64 bits."""
    form = r"^([0-9a-f]+)-([0-9a-f]+)\."

    def part(i: int) -> Column:
        digits = F.regexp_replace(F.regexp_extract(tail, form, i), "^0+(?=.)", "")
        return F.when(tail.rlike(form) & (F.length(digits) <= 16), digits)

    return part(1), part(2)


def tag_matches(tail: Column, job: Column, pass_no: Column) -> Column:
    a, b = temp_tag(tail)
    return F.coalesce((a == F.lower(F.hex(job.cast("long")))) & (b == F.lower(F.hex(pass_no.cast("long")))), F.lit(False))
