"""Tables derived from the supplied Parquet files, for queries and their SQL.

The text of each table is SQL that Spark and DuckDB both run; only the microseconds of a
timestamp are spelt differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.storage import dealt, materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
TEMP_PREFIX = ".sync.tmp."

_LISTINGS = f"""
g AS (SELECT l_orderkey ok, l_linenumber ln, min(l_returnflag) rf, min(l_linestatus) ls, min(l_partkey) pk, min(l_suppkey) sk,
        cast(min(l_quantity) AS bigint) q, cast(round(min(l_extendedprice) * 100) AS bigint) size,
        EPOCH_US(min(l_shipdate)) * 1000 mtime_ns, year(min(l_shipdate)) y
      FROM lineitem GROUP BY l_orderkey, l_linenumber),
f AS (SELECT 'f' || rf || '/s' || ls || '/y' || y || '/o' || ok || '_' || ln || '.dat' rel_path,
        CASE WHEN q % 2 = 0 THEN 420 ELSE 416 END mode, 1000 + sk % 7 uid, 100 + pk % 5 gid, size, mtime_ns,
        CASE WHEN ln <= 2 THEN ok * 10 ELSE ok * 10 + ln END ino,
        CASE WHEN pk % 6 = 0 THEN cast(0 AS bigint) ELSE cast(floor((size + 511) / 512.0) AS bigint) END blocks, (ok * 7 + ln) % 20 k FROM g),
dirs AS (SELECT 'f' || rf rel_path FROM g UNION SELECT 'f' || rf || '/s' || ls FROM g UNION SELECT 'f' || rf || '/s' || ls || '/y' || y FROM g
      UNION SELECT 'sl' FROM region UNION SELECT 'sp' FROM region),
common AS (SELECT rel_path, 'DIR' type, 493 mode, cast(0 AS bigint) uid, cast(0 AS bigint) gid, cast(0 AS bigint) size, cast(0 AS bigint) mtime_ns,
        cast(0 AS bigint) ino, 2 nlink, cast(0 AS bigint) blocks, cast(NULL AS varchar(99)) link_target, cast(0 AS bigint) rdev_major, cast(0 AS bigint) rdev_minor FROM dirs),
src AS (SELECT rel_path, 'FILE' type, mode, uid, gid, size, mtime_ns, ino, cast(count(*) OVER (PARTITION BY ino) AS int) nlink, blocks,
        cast(NULL AS varchar(99)) link_target, cast(0 AS bigint) rdev_major, cast(0 AS bigint) rdev_minor FROM f
      UNION ALL SELECT * FROM common
      UNION ALL SELECT 'sl/n' || n_nationkey, 'SYMLINK', 511, 0, 0, 0, 0, n_nationkey + 1, 1, 0, 't' || n_regionkey, 0, 0 FROM nation
      UNION ALL SELECT 'sp/r' || r_regionkey, 'CHARDEV', 384, 0, 0, 0, 0, r_regionkey + 100, 1, 0, NULL, r_regionkey, 1 FROM region),
dst AS (SELECT rel_path, CASE WHEN k = 6 THEN 'DIR' ELSE 'FILE' END type, CASE WHEN k = 5 THEN mode + 1 ELSE mode END mode,
        CASE WHEN k = 4 THEN uid + 1 ELSE uid END uid, gid, CASE WHEN k = 1 THEN size + 1 ELSE size END size,
        CASE WHEN k = 2 THEN mtime_ns + 5000000000 WHEN k = 3 THEN mtime_ns + 500000 ELSE mtime_ns END mtime_ns,
        ino, 1 nlink, blocks, cast(NULL AS varchar(99)) link_target, cast(0 AS bigint) rdev_major, cast(0 AS bigint) rdev_minor FROM f WHERE k <> 0
      UNION ALL SELECT * FROM common
      UNION ALL SELECT 'sl/n' || n_nationkey, 'SYMLINK', 511, 0, 0, 0, 0, n_nationkey + 1, 1, 0, CASE WHEN n_nationkey % 3 = 1 THEN 'u' ELSE 't' END || n_regionkey, 0, 0 FROM nation WHERE n_nationkey % 3 <> 2
      UNION ALL SELECT 'sp/r' || r_regionkey, 'CHARDEV', 384, 0, 0, 0, 0, r_regionkey + 100, 1, 0, NULL, r_regionkey, 1 + r_regionkey % 2 FROM region
      UNION ALL SELECT DISTINCT 'orph', 'DIR', 493, 0, 0, 0, 0, 0, 2, 0, NULL, 0, 0 FROM part
      UNION ALL SELECT DISTINCT 'orph/p' || p_partkey % 10, 'DIR', 493, 0, 0, 0, 0, 0, 2, 0, NULL, 0, 0 FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT 'orph/p' || p_partkey % 10 || '/' || p_partkey || '.dat', 'FILE', 420, 0, 0, 10 + p_partkey, 0, p_partkey, 1, 1, NULL, 0, 0 FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT rel_path || '/kid' || ino % 3, 'FILE', 420, 0, 0, 11, 0, ino, 1, 1, NULL, 0, 0 FROM f WHERE k = 6 AND ino % 2 = 0
      UNION ALL SELECT 'fA/extra' || n_nationkey || '.dat', 'FILE', 420, 0, 0, 7, 0, n_nationkey, 1, 1, NULL, 0, 0 FROM nation
      UNION ALL SELECT 'fA/{TEMP_PREFIX}1-' || (r_regionkey % 2 + 1) || '.' || r_regionkey || '.0', 'FILE', 420, 0, 0, 7, 0, r_regionkey, 1, 1, NULL, 0, 0 FROM region)"""

_JOURNAL = """
jr AS (SELECT user_id % 3 + 1 job_id, cast(floor((day(ts) - 1) / 10.0) AS int) + 1 pass_no, 'agent-' || user_id % 10 agent_id, event_id,
        CASE event_type WHEN 'view' THEN 'COPIED' WHEN 'signup' THEN 'META_FIXED' WHEN 'click' THEN 'VERIFY_OK' WHEN 'purchase' THEN 'ORPHAN'
          ELSE CASE WHEN event_id % 3 = 0 THEN 'VERIFY_FAIL' ELSE 'ERROR' END END type,
        'u' || user_id % 50 || '/k' || JSON_K rel_path, EPOCH_US(ts) * 1000 ts_ns,
        CASE WHEN event_type = 'error' AND event_id % 3 = 1 THEN 13 WHEN event_type = 'error' AND event_id % 3 = 2 THEN 116 ELSE 0 END errno,
        CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'mtime mismatch' ELSE '' END detail,
        420 + cast(event_id % 8 AS int) mode, event_id * 1315423911 sum_hi, event_id * 2654435761 - 9007199254740993 sum_lo
      FROM events),
jn AS (SELECT *, row_number() OVER (PARTITION BY agent_id, job_id, pass_no ORDER BY event_id) - 1 k FROM jr),
jb AS (SELECT *, cast(floor(k / 5.0) AS int) b FROM jn),
journal AS (SELECT job_id, pass_no, agent_id, cast(dense_rank() OVER (PARTITION BY agent_id ORDER BY pass_no, job_id, b) AS bigint) seq, cast(k % 5 AS int) place,
        cast(count(*) OVER (PARTITION BY agent_id, job_id, pass_no, b) AS int) record_count, event_id, type, rel_path, ts_ns, errno, detail, mode, sum_hi, sum_lo FROM jb)"""

_LEDGER = """
oc AS (SELECT o.*, c_nationkey nk, c_custkey % 10 ag, cast(round(o_totalprice * 100) AS bigint) cents, EPOCH_US(o_orderdate) / 1000 odate_us FROM orders o JOIN customer ON o_custkey = c_custkey),
od AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, nk, ag, cents, cast(floor(odate_us) AS bigint) date_ms, year(o_orderdate) y FROM oc),
jobs AS (SELECT nk job_id, 'job-' || nk name,
        CASE nk % 7 WHEN 0 THEN 'CREATED' WHEN 1 THEN 'READY' WHEN 2 THEN 'RUNNING' WHEN 3 THEN 'PAUSED' WHEN 4 THEN 'COMPLETED' WHEN 5 THEN 'CANCELLED' ELSE 'FAILED' END state,
        CASE WHEN nk % 2 = 0 THEN '/dst/' || nk % 5 ELSE '/dst/' || nk % 5 || '/sub' || nk END destination,
        nk % 6 = 0 dry_run, min(date_ms) created_ms, max(date_ms) updated_ms FROM od GROUP BY nk),
py AS (SELECT nk job_id, cast(y - 1994 AS int) pass_no, count(*) n, sum(cents) cents, min(date_ms) started_ms, max(date_ms) finished_ms,
        sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) n_open, max(y) OVER (PARTITION BY nk) last_y, y FROM od GROUP BY nk, y),
passes AS (SELECT job_id, pass_no,
        CASE WHEN y = last_y THEN CASE job_id % 4 WHEN 1 THEN 'SCANNING' WHEN 2 THEN 'VERIFY' ELSE 'COMPLETE' END ELSE 'COMPLETE' END state,
        started_ms, CASE WHEN y = last_y AND job_id % 4 IN (1, 2) THEN NULL ELSE finished_ms END finished_ms,
        CASE WHEN y = last_y AND job_id % 4 = 0 THEN 0 ELSE n * 10 END entries_walked,
        CASE WHEN (job_id + pass_no) % 5 = 0 THEN 0 ELSE n END files_copied, CASE WHEN (job_id + pass_no) % 5 = 0 THEN 0 ELSE cents END bytes_copied,
        CASE WHEN (job_id + pass_no) % 5 = 0 THEN 0 ELSE n_open END meta_fixed, n * 9 clean, n % 11 + 1 orphans, n % 3 errors, n % 2 verify_fail, n verify_ok, n % 4 items_reaped FROM py),
work_items AS (SELECT o_orderkey item_id, nk job_id, cast(y - 1994 AS int) pass_no,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'dir' WHEN '2' THEN 'entrylist' WHEN '3' THEN 'verify' WHEN '4' THEN 'dirfix' ELSE 'probe' END kind,
        CASE WHEN o_orderkey % 11 = 0 THEN 'PARKED' WHEN o_orderstatus = 'F' THEN 'DONE' WHEN o_orderstatus = 'O' THEN 'QUEUED' ELSE 'LEASED' END state,
        'd' || o_orderkey % 100 || '/o' || o_orderkey rel_path, cast(o_orderkey % 6 AS int) attempt, 'agent-' || ag holder, 'agent-' || (o_custkey % 12) target,
        o_orderkey * 3 lease_id, date_ms + 30000 lease_expiry_ms, date_ms updated_ms, CASE WHEN o_orderkey % 11 = 0 THEN 'gave up' ELSE '' END error, cents % 600000 wall_ms FROM od),
agents AS (SELECT 'agent-' || c_custkey agent_id, 'host-' || c_custkey % 4 host, c_custkey % 2 = 0 enabled, c_custkey % 3 <> 0 connected,
        cast(c_custkey % 4 AS int) proto_minor, 1700000000000 + c_custkey * 1000 heartbeat_ms FROM customer)"""

_TELEMETRY = """
stats AS (SELECT agent_id, ts_us, seq, cast(sum(d) OVER (PARTITION BY agent_id, epoch ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bigint) entries FROM
        (SELECT agent_id, ts_us, seq, d, sum(reset) OVER (PARTITION BY agent_id ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) epoch FROM
          (SELECT 'agent-' || user_id % 10 agent_id, EPOCH_US(ts) ts_us, event_id seq, cast(floor(value * 100) AS bigint) d,
             CASE WHEN event_type = 'purchase' AND event_id % 97 = 0 THEN 1 ELSE 0 END reset FROM events) e0) e1),
inflight AS (SELECT 'agent-' || user_id % 10 agent_id, user_id lease_id, CASE WHEN user_id % 4 = 0 THEN 'chunk' ELSE 'dir' END kind, EPOCH_US(ts) ts_us, event_id seq,
        'u' || user_id % 50 rel_path, EPOCH_US(ts) / 1000 - 1704067200000 running_raw, event_type <> 'signup' running,
        CASE WHEN user_id % 9 = 0 THEN user_id ELSE event_id END entries_done FROM events),
op_latency AS (SELECT CASE event_type WHEN 'view' THEN 'stat' WHEN 'click' THEN 'open' WHEN 'error' THEN 'fchmod' WHEN 'purchase' THEN 'rename' ELSE 'fchown' END op,
        CASE user_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 8 ELSE 16 END threads, user_id % 2 dirs, CASE user_id % 3 WHEN 0 THEN 'baseline' WHEN 1 THEN 'no-fsync' ELSE 'no-xattr' END variant,
        event_id % 7 run, cast(floor(value * 100) AS bigint) latency_us FROM events)"""

_CONTENT = """
content AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' rel_path, doc_id, text, lang, source, 'FILE' type, 420 mode, 1000 uid, 100 gid, doc_id * 1000000007 mtime_ns FROM documents),
content_dst AS (SELECT rel_path, doc_id, CASE WHEN doc_id % 10 = 1 THEN text || 'x' ELSE text END text, lang, source, type, mode, uid, gid, mtime_ns FROM content WHERE doc_id % 10 <> 0)"""

PARTS = {"listings": _LISTINGS, "journal": _JOURNAL, "ledger": _LEDGER, "telemetry": _TELEMETRY, "content": _CONTENT}
_PART_OF = {
    "src": "listings", "dst": "listings", "journal": "journal", "jobs": "ledger", "passes": "ledger", "work_items": "ledger", "agents": "ledger",
    "stats": "telemetry", "inflight": "telemetry", "op_latency": "telemetry", "content": "content", "content_dst": "content",
}


#: What the listings are made of in Spark: files, grouped and counted in one shuffle, and directories, both written once; the rows are those of the SQL above.
_INO = "CASE WHEN l_linenumber <= 2 THEN l_orderkey * 10 ELSE l_orderkey * 10 + l_linenumber END"
_FILE_ROWS = f"""
SELECT 'f' || rf || '/s' || ls || '/y' || y || '/o' || ok || '_' || ln || '.dat' rel_path, rf, ls, y, CASE WHEN q % 2 = 0 THEN 420 ELSE 416 END mode, 1000 + sk % 7 uid, 100 + pk % 5 gid, size, mtime_ns, ino,
  CASE WHEN pk % 6 = 0 THEN cast(0 AS bigint) ELSE cast(floor((size + 511) / 512.0) AS bigint) END blocks, (ok * 7 + ln) % 20 k, cast(count(*) OVER (PARTITION BY ino) AS int) nlink
FROM (SELECT ino, l_orderkey ok, l_linenumber ln, min(l_returnflag) rf, min(l_linestatus) ls, min(l_partkey) pk, min(l_suppkey) sk,
        cast(min(l_quantity) AS bigint) q, cast(round(min(l_extendedprice) * 100) AS bigint) size, EPOCH_US(min(l_shipdate)) * 1000 mtime_ns, year(min(l_shipdate)) y
      FROM (SELECT *, {_INO} ino FROM lineitem ) GROUP BY ino, l_orderkey, l_linenumber)"""
_DIRS = """
SELECT 'f' || rf rel_path FROM {g} UNION SELECT 'f' || rf || '/s' || ls FROM {g} UNION SELECT 'f' || rf || '/s' || ls || '/y' || y FROM {g} UNION SELECT 'sl' FROM {region} UNION SELECT 'sp' FROM {region}"""

_MADE: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table, written as Parquet in the shared folder once a session and read from there by every query. The two
    listings read the same written files, of which each is a projection, and what else they have.
    """
    return _once(spark, sf_dir, name, _listing if name in ("src", "dst") else lambda *of: materialize(_derived(*of), f"table-{name}"))


def _once(spark: SparkSession, sf_dir: str, name: str, made) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _MADE:
        _MADE[key] = made(spark, sf_dir, name)
    return _MADE[key]


def _supplied(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The files of both listings. All that is grouped, and all names of a file, share its number, so the rows are shuffled once, by that."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    lines = _supplied(spark, sf_dir, "lineitem")
    placed = dealt(lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"), lines.count(), F.expr(_INO))
    text = _micros(_FILE_ROWS).replace("FROM lineitem ", "FROM {lineitem} ")
    return materialize(spark.sql(text, lineitem=placed), "table-files", "zstd")


def _directories(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    kinds = _once(spark, sf_dir, "files", _files).select("rf", "ls", "y").distinct()
    return materialize(spark.sql(_DIRS, g=kinds, region=_supplied(spark, sf_dir, "region")).coalesce(1), "table-dirs")  # some tens of rows


def _listing(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """What follows from the files as a view of them, and the rest, written."""
    text = "f AS (SELECT * FROM {files}), dirs AS (SELECT * FROM {dirs}),\n" + _LISTINGS[_LISTINGS.index("common AS ") :].replace("cast(count(*) OVER (PARTITION BY ino) AS int) nlink", "nlink")
    files, dirs = _once(spark, sf_dir, "files", _files), _once(spark, sf_dir, "dirs", _directories)
    rest = materialize(_query(spark, sf_dir, text, name, files=files.where("false"), dirs=dirs), f"table-{name}")
    nothing = {t: _supplied(spark, sf_dir, t).where("false") for t in ("region", "nation", "part")}
    return _query(spark, sf_dir, text, name, files=files, dirs=dirs.where("false"), **nothing).unionByName(rest)


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return _query(spark, sf_dir, PARTS[_PART_OF[name]], name)


def _query(spark: SparkSession, sf_dir: str, text: str, name: str, **more: DataFrame) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    text = _micros(text.replace("varchar(99)", "string").replace("JSON_K", "get_json_object(props, '$.k')"))
    for t in TABLES:
        text = _named(text, t)
    used = [t for t in TABLES if f"{{{t}}}" in text]
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **{t: _supplied(spark, sf_dir, t) for t in used} | more)


def _micros(text: str) -> str:
    """EPOCH_US(x) as Spark spells it."""
    text = text.replace("EPOCH_US(", "driftline_us(")
    while "driftline_us(" in text:
        at = text.index("driftline_us(") + len("driftline_us(")
        level, end = 1, at
        while level:
            level += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        text = f"{text[: at - len('driftline_us(')]}unix_micros(cast({text[at : end - 1]} AS timestamp)){text[end:]}"
    return text


def _named(text: str, table_name: str) -> str:
    for word in ("FROM", "JOIN"):
        text = text.replace(f"{word} {table_name} ", f"{word} {{{table_name}}} ").replace(f"{word} {table_name})", f"{word} {{{table_name}}})").replace(f"{word} {table_name}\n", f"{word} {{{table_name}}}\n")
    return text


def duckdb_with(*names: str) -> str:
    """WITH clause that defines the named tables and those they come with."""
    parts = dict.fromkeys(_PART_OF[n] for n in names)
    text = ",".join(PARTS[p] for p in parts).replace("varchar(99)", "varchar").replace("JSON_K", "(props->>'$.k')").replace("EPOCH_US(", "epoch_us(")
    for name in ("g", "f", "src", "dst", "od", "journal", "content", "content_dst"):
        text = text.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")
    return "WITH" + text
