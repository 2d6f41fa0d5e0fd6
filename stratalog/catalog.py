"""Queries of the engine over the driver tables, and their SQL.

The tables hold no key-value log, so a log (``sources.events_log``), traces and samples are
derived from ``events``, ``orders`` and ``lineitem`` by fixed expressions; the SQL derives the same.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars
from .functions.hashing import shard_of
from .operators import audit, benchstats, compaction, fold, moves, scans, sessions, shards
from .operators import versions as V
from .plans import access
from .sources.events_log import command_log, table, versions
from .sources.segments import Store
from .streaming import apply, timeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOG = """log AS (
  SELECT event_id + 1 AS idx, user_id % 8 AS client_id, event_id // 8 - event_id % 5 + 5 AS req_seq,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' WHEN event_type = 'error' THEN 'delete'
      WHEN event_type = 'click' THEN 'cas' ELSE 'get' END AS op,
    'user' || user_id AS key, event_id::VARCHAR AS value,
    CASE WHEN event_id % 3 <> 0 THEN (event_id - 1)::VARCHAR END AS expected
  FROM events)"""
VERSIONS = LOG + """, versions AS (
  SELECT key, idx AS seq, CASE WHEN op = 'put' THEN 1 ELSE 0 END AS kind, CASE WHEN op = 'put' THEN value END AS value
  FROM log WHERE op IN ('put', 'delete'))"""
NEWEST = VERSIONS + """, newest AS (
  SELECT * FROM versions QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, value, seq FROM newest WHERE kind = 1)"""
FOLD = """, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx) AS n FROM ({source})),
folded AS (
  SELECT key, n, idx, op, NULL::VARCHAR AS before,
    CASE WHEN op = 'put' OR (op = 'cas' AND expected IS NULL) THEN value END AS after, op = 'cas' AND expected IS NULL AS ok
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.key, o.n, o.idx, o.op, f.after,
    CASE WHEN o.op = 'put' OR (o.op = 'cas' AND f.after IS NOT DISTINCT FROM o.expected) THEN o.value WHEN o.op = 'delete' THEN NULL ELSE f.after END,
    o.op = 'cas' AND f.after IS NOT DISTINCT FROM o.expected
  FROM folded f JOIN ordered o ON o.key = f.key AND o.n = f.n + 1),
results AS (
  SELECT idx, op IN ('cas', 'get') AND before IS NOT NULL AS found, CASE WHEN op IN ('cas', 'get') THEN before END AS value,
    op IN ('put', 'delete') OR ok AS success FROM folded)"""
SESSIONS = """, marked AS (
  SELECT *, CASE WHEN client_id = 0 THEN -idx ELSE client_id END AS client FROM log),
dups AS (
  SELECT *, coalesce(req_seq <= max(req_seq) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup
  FROM marked)"""
HASH = """, bytes AS (
  SELECT key, list_transform(range(1, strlen(key) + 1), lambda i: ascii(substr(key, i, 1))::UBIGINT) AS b FROM ({source})),
fnv AS (
  SELECT key, list_reduce(list_prepend(14695981039346656037::UBIGINT, b),
    lambda h, c: ((xor(h, c)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM bytes),
mixed AS (
  SELECT key, ((xor(h, h >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM fnv),
sharded AS (
  SELECT key, ((((xor(h, h >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) >> 60)::INTEGER AS shard FROM mixed)"""


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(command_log(spark, sf_dir))


# -- reads ---------------------------------------------------------------------------------------


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key = 'user7'")
def get_latest(spark, sf_dir):
    return V.get(_versions(spark, sf_dir), "user7")


@query(
    f"""WITH {VERSIONS}, opening AS (SELECT key, seq FROM versions WHERE kind = 1 ORDER BY seq LIMIT 1),
found AS (SELECT v.* FROM versions v, opening f WHERE v.key = f.key AND v.seq <= f.seq + 5 ORDER BY v.seq DESC LIMIT 1) SELECT key, value, seq FROM found WHERE kind = 1"""
)
def get_as_of(spark, sf_dir):
    """The key that is put first, five commands later."""
    v = _versions(spark, sf_dir)
    first = v.where("kind = 1").orderBy("seq").select("key", "seq").limit(1).collect()[0]
    return V.get(v, first.key, first.seq + 5)


@query(f"WITH {NEWEST} SELECT * FROM live")
def state_lww(spark, sf_dir):
    return V.state(_versions(spark, sf_dir))


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key >= 'user2' AND key < 'user6'")
def scan_range(spark, sf_dir):
    return V.scan(_versions(spark, sf_dir), "user2", "user6")


@query(f"WITH {VERSIONS} SELECT key, value, seq FROM (SELECT * FROM versions WHERE seq <= 500 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1")
def scan_as_of(spark, sf_dir):
    return V.scan(_versions(spark, sf_dir), as_of=500)


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key >= 'user1' AND key < 'user9' ORDER BY key LIMIT 20")
def scan_limit(spark, sf_dir):
    return scans.bounded(V.newest(_versions(spark, sf_dir).where(V.in_range("user1", "user9"))), limit=20)


_RUNNING = f"""WITH {NEWEST}, sums AS (
  SELECT *, row_number() OVER (ORDER BY key) AS n,
    coalesce(sum(strlen(key) + strlen(value)) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM live)
SELECT key, value, seq FROM sums WHERE """


@query(_RUNNING + "before < 200")
def scan_byte_bound(spark, sf_dir):
    return scans.bounded(V.newest(_versions(spark, sf_dir)), max_bytes=200)


@query(_RUNNING + "before < 200 AND n <= 12")
def scan_limit_and_bytes(spark, sf_dir):
    return scans.bounded(V.newest(_versions(spark, sf_dir)), limit=12, max_bytes=200)


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key > 'user2' ORDER BY key LIMIT 10")
def page_cursor(spark, sf_dir):
    return scans.page(_versions(spark, sf_dir), "user2", 10)


def _grouped(spark, sf_dir):
    live = V.newest(_versions(spark, sf_dir)).select("key", "value")
    return shards.route(live, shards.default_map(spark, [2, 3, 4])).select("grp", "key", "value")


_GROUPED = f"WITH {NEWEST}" + HASH.format(source="SELECT key FROM live") + ", grouped AS (SELECT 2 + shard % 3 AS grp, key, value FROM live JOIN sharded USING (key))"


@query(_GROUPED + " SELECT key, value FROM grouped ORDER BY key LIMIT 25")
def scan_merged(spark, sf_dir):
    return scans.merged(_grouped(spark, sf_dir), limit=25)


@query(
    _GROUPED
    + """, sums AS (SELECT *, coalesce(sum(strlen(key) + strlen(value)) OVER (PARTITION BY grp ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM grouped)
SELECT key, value FROM sums WHERE before < 60 ORDER BY key LIMIT 15"""
)
def scan_merged_group_bounds(spark, sf_dir):
    return scans.merged(_grouped(spark, sf_dir), limit=15, max_bytes=60, compat_per_group_bound=True)


@query(
    f"""WITH {VERSIONS}, life AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS until FROM versions),
scans AS (SELECT idx, key AS lo FROM log WHERE op = 'get'),
hit AS (SELECT s.idx, l.key, l.value FROM scans s JOIN life l ON l.kind = 1 AND l.key >= s.lo AND l.seq < s.idx AND (l.until IS NULL OR l.until >= s.idx))
SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY idx ORDER BY key) <= 5"""
)
def scan_commands(spark, sf_dir):
    """Every get of the log as a scan from its key on."""
    log = command_log(spark, sf_dir)
    own = log.where(F.col("op") == "get").select("idx", F.col("key").alias("scan_start"), F.lit(None).cast("string").alias("scan_end"), F.lit(5).alias("scan_limit"), F.lit(0).alias("scan_max_bytes"))
    return scans.scan_commands(own, versions(log))


# -- folds and sessions --------------------------------------------------------------------------


@query(f"WITH RECURSIVE {LOG}" + FOLD.format(source="SELECT * FROM log") + " SELECT key, after AS value FROM folded f WHERE after IS NOT NULL QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC) = 1 AND n = (SELECT max(n) FROM ordered o WHERE o.key = f.key)")
def fold_cas_state(spark, sf_dir):
    return fold.state(command_log(spark, sf_dir))


@query(f"WITH RECURSIVE {LOG}" + FOLD.format(source="SELECT * FROM log") + " SELECT * FROM results")
def fold_cas_results(spark, sf_dir):
    return fold.results(command_log(spark, sf_dir))


@query(f"WITH {NEWEST} SELECT key, value FROM live")
def state_planned(spark, sf_dir):
    return access.state(command_log(spark, sf_dir).where(F.col("op").isin("put", "delete")))


@query(f"WITH {LOG}{SESSIONS} SELECT idx, dup FROM dups")
def session_dedup(spark, sf_dir):
    return sessions.mark_duplicates(command_log(spark, sf_dir)).select("idx", "dup")


@query(f"WITH {LOG} SELECT client_id, max(req_seq) AS seq FROM log WHERE client_id > 0 GROUP BY 1")
def session_table(spark, sf_dir):
    return sessions.sessions(command_log(spark, sf_dir))


@query(
    f"WITH RECURSIVE {LOG}{SESSIONS}"
    + FOLD.format(source="SELECT * FROM dups WHERE NOT dup")
    + """, own AS (SELECT d.idx, d.dup, d.client, CASE WHEN r.idx IS NOT NULL THEN struct_pack(found := r.found, value := r.value, success := r.success) END AS r
  FROM dups d LEFT JOIN results r USING (idx)),
got AS (SELECT idx, dup, last_value(r IGNORE NULLS) OVER (PARTITION BY client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM own)
SELECT idx, dup, r.found AS found, r.value AS value, r.success AS success FROM got"""
)
def session_replies(spark, sf_dir):
    marked = sessions.mark_duplicates(command_log(spark, sf_dir))
    return sessions.replies(marked, fold.results(marked.where(~F.col("dup"))))


# -- shards --------------------------------------------------------------------------------------


@query(f"WITH {LOG}" + HASH.format(source="SELECT DISTINCT key FROM log") + " SELECT * FROM sharded")
def shard_of_keys(spark, sf_dir):
    return command_log(spark, sf_dir).select("key").distinct().select("key", shard_of(F.col("key")).alias("shard"))


@query("WITH RECURSIVE keys AS (SELECT DISTINCT 'order' || o_orderkey AS key FROM orders)" + HASH.format(source="SELECT key FROM keys") + " SELECT shard, count(*) AS n FROM sharded GROUP BY 1")
def shard_histogram(spark, sf_dir):
    return shards.histogram(table(spark, sf_dir, "orders").select(F.concat(F.lit("order"), "o_orderkey").alias("key")).distinct())


@query(_GROUPED + " SELECT key, grp FROM grouped")
def shard_route(spark, sf_dir):
    return _grouped(spark, sf_dir).select("key", "grp")


@query("SELECT i::INTEGER AS shard, (2 + i % 3)::BIGINT AS grp, 0::BIGINT AS moving FROM range(16) t(i)")
def default_map(spark, sf_dir):
    return shards.default_map(spark, [4, 2, 3])


def _admin(spark, sf_dir):
    e = F.col("event_id")
    op = F.when(F.col("event_type") == "error", "freeze").when((F.col("event_type") == "signup") & (e % 3 == 0), "purge").otherwise("import")
    return table(spark, sf_dir, "events").select((e % 2).alias("grp"), (F.col("user_id") % 16).cast("int").alias("shard"), (e + 1).alias("idx"), op.alias("op"), (e % 4 == 0).alias("last"))


_ADMIN = """admin AS (
  SELECT event_id % 2 AS grp, (user_id % 16)::INTEGER AS shard, event_id + 1 AS idx,
    CASE WHEN event_type = 'error' THEN 'freeze' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'purge' ELSE 'import' END AS op,
    event_id % 4 = 0 AS last FROM events),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp, shard ORDER BY idx) AS n FROM admin),
line AS (
  SELECT grp, shard, idx, op, n, true AS accepted, CASE WHEN op = 'purge' THEN 2 WHEN op = 'freeze' THEN 1 WHEN last THEN 0 END AS state FROM numbered WHERE n = 1
  UNION ALL
  SELECT a.grp, a.shard, a.idx, a.op, a.n, a.op <> 'import' OR coalesce(l.state = 2, true),
    CASE WHEN a.op = 'purge' THEN 2 WHEN a.op = 'freeze' THEN CASE WHEN l.state = 2 THEN 2 ELSE 1 END
      WHEN coalesce(l.state = 2, true) AND a.last THEN 0 ELSE l.state END
  FROM line l JOIN numbered a ON a.grp = l.grp AND a.shard = l.shard AND a.n = l.n + 1)"""


@query(f"WITH RECURSIVE {_ADMIN} SELECT grp, shard, idx, op, accepted, state FROM line")
def shard_state_timeline(spark, sf_dir):
    return shards.timeline(_admin(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_ADMIN}, v AS (SELECT event_id % 2 AS grp, (user_id % 16)::INTEGER AS shard, event_id * 2 AS seq FROM events),
last AS (SELECT grp, shard, max(idx) AS purged FROM admin WHERE op = 'purge' GROUP BY 1, 2)
SELECT v.* FROM v LEFT JOIN last USING (grp, shard) WHERE purged IS NULL OR seq > purged"""
)
def purge_visibility(spark, sf_dir):
    e = F.col("event_id")
    v = table(spark, sf_dir, "events").select((e % 2).alias("grp"), (F.col("user_id") % 16).cast("int").alias("shard"), (e * 2).alias("seq"))
    return shards.visible_after_purges(v, _admin(spark, sf_dir).where(F.col("op") == "purge"))


@query(
    f"""WITH RECURSIVE {_ADMIN}, asked AS (SELECT event_id % 2 AS grp, (user_id % 16)::INTEGER AS shard, event_id + 1 AS idx FROM events),
known AS (SELECT grp, shard, idx, state FROM line WHERE state IS NOT NULL)
SELECT a.grp, a.shard, a.idx, k.state FROM asked a ASOF LEFT JOIN known k ON a.grp = k.grp AND a.shard = k.shard AND a.idx > k.idx"""
)
def shard_state_as_of(spark, sf_dir):
    e = F.col("event_id")
    asked = table(spark, sf_dir, "events").select((e % 2).alias("grp"), (F.col("user_id") % 16).cast("int").alias("shard"), (e + 1).alias("idx"))
    return shards.with_state(asked, shards.timeline(_admin(spark, sf_dir)))


@query(_GROUPED + " SELECT CASE WHEN shard = 5 THEN 4 ELSE grp END AS grp, key, value FROM grouped JOIN sharded USING (key)")
def shard_move(spark, sf_dir):
    return shards.move(_grouped(spark, sf_dir), shards.default_map(spark, [2, 3, 4]), 5, 4)[0]


@query(
    f"WITH RECURSIVE {NEWEST}"
    + HASH.format(source="SELECT key FROM live")
    + """, pairs AS (
  SELECT 2 + shard % 3 AS part, key, value, strlen(key) + strlen(value) AS size, row_number() OVER (PARTITION BY 2 + shard % 3 ORDER BY key) AS n FROM live JOIN sharded USING (key)),
cut AS (
  SELECT part, key, value, n, size AS bytes, 1 AS rows, 0::BIGINT AS chunk FROM pairs WHERE n = 1
  UNION ALL
  SELECT p.part, p.key, p.value, p.n, CASE WHEN c.rows >= 7 OR c.bytes + p.size > 60 THEN p.size ELSE c.bytes + p.size END,
    CASE WHEN c.rows >= 7 OR c.bytes + p.size > 60 THEN 1 ELSE c.rows + 1 END, c.chunk + CASE WHEN c.rows >= 7 OR c.bytes + p.size > 60 THEN 1 ELSE 0 END
  FROM cut c JOIN pairs p ON p.part = c.part AND p.n = c.n + 1)
SELECT part, key, value, chunk FROM cut"""
)
def import_chunks(spark, sf_dir):
    pairs = _grouped(spark, sf_dir).select(F.col("grp").alias("part"), "key", "value")
    return shards.import_chunks(pairs, 7, 60)


@query(
    f"WITH {LOG} SELECT idx, strlen(key) + strlen(value) + coalesce(strlen(expected), 0) AS bytes, strlen(key) + strlen(value) + coalesce(strlen(expected), 0) <= 1048576 AS fits FROM log"
)
def request_sizes(spark, sf_dir):
    parts = (F.col("key"), F.col("value"), F.col("expected"))
    return command_log(spark, sf_dir).select("idx", scalars.request_bytes(*parts).alias("bytes"), scalars.fits(*parts).alias("fits"))


def _replay(spark, sf_dir):
    """Logs of two groups, whose indexes are the same, with a freeze, a purge or an import of one
    pair now and then."""
    log = command_log(spark, sf_dir)
    i = F.col("idx")
    admin = F.when(i % 53 == 0, "freeze").when(i % 59 == 0, "purge").when(i % 61 == 0, "import")
    pair = F.array(F.struct("key", "value"))
    return shards.replay(
        log.select(
            (i % 2 + 1).alias("grp"), F.floor(i / 2).alias("idx"), F.when(admin.isNull(), F.col("client_id")).otherwise(0).alias("client_id"), "req_seq", F.coalesce(admin, "op").alias("op"), "key", "value", "expected",
            shard_of(F.col("key")).alias("shard"), pair.alias("kvs"), (i % 4 >= 2).alias("last"),
        )
    )


_REPLAY = (
    f"WITH RECURSIVE {LOG}"
    + HASH.format(source="SELECT DISTINCT key FROM log")
    + """, logs AS (
  SELECT idx % 2 + 1 AS grp, idx // 2 AS idx, CASE WHEN idx % 53 = 0 THEN 'freeze' WHEN idx % 59 = 0 THEN 'purge' WHEN idx % 61 = 0 THEN 'import' END AS admin,
    client_id, req_seq, op, key, value, expected, shard, idx % 4 >= 2 AS last FROM log JOIN sharded USING (key)),
marked AS (SELECT * EXCLUDE (op, admin, client_id), coalesce(admin, op) AS op, CASE WHEN admin IS NOT NULL OR client_id = 0 THEN -idx ELSE client_id END AS client FROM logs),
dups AS (
  SELECT *, coalesce(req_seq <= max(req_seq) OVER (PARTITION BY grp, client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS dup FROM marked),
fresh AS (SELECT * FROM dups WHERE NOT dup),
numbered AS (SELECT *, row_number() OVER (PARTITION BY grp, shard ORDER BY idx) AS n FROM fresh WHERE op IN ('freeze', 'purge', 'import')),
line AS (
  SELECT grp, shard, idx, op, n, true AS accepted, CASE WHEN op = 'purge' THEN 2 WHEN op = 'freeze' THEN 1 WHEN last THEN 0 END AS state FROM numbered WHERE n = 1
  UNION ALL
  SELECT a.grp, a.shard, a.idx, a.op, a.n, a.op <> 'import' OR coalesce(l.state = 2, true),
    CASE WHEN a.op = 'purge' THEN 2 WHEN a.op = 'freeze' THEN CASE WHEN l.state = 2 THEN 2 ELSE 1 END
      WHEN coalesce(l.state = 2, true) AND a.last THEN 0 ELSE l.state END
  FROM line l JOIN numbered a ON a.grp = l.grp AND a.shard = l.shard AND a.n = l.n + 1),
known AS (SELECT grp, shard, idx, state FROM line WHERE state IS NOT NULL),
keyed AS (SELECT a.*, k.state FROM (SELECT * FROM fresh WHERE op IN ('put', 'delete', 'cas', 'get')) a ASOF LEFT JOIN known k ON a.grp = k.grp AND a.shard = k.shard AND a.idx > k.idx),
judged AS (SELECT *, CASE WHEN op = 'get' THEN coalesce(state, 0) = 2 ELSE coalesce(state, 0) <> 0 END AS moving FROM keyed),
commands AS (
  SELECT grp, idx, op, key, shard, value, expected FROM judged WHERE NOT moving
  UNION ALL
  SELECT f.grp, f.idx, 'put', f.key, f.shard, f.value, NULL FROM fresh f JOIN line i ON i.grp = f.grp AND i.idx = f.idx WHERE i.op = 'import' AND i.accepted),
everything AS (
  SELECT * FROM commands
  UNION ALL
  SELECT p.grp, p.idx, 'purge', k.key, k.shard, NULL, NULL FROM fresh p JOIN (SELECT DISTINCT grp, key, shard FROM commands) k ON k.grp = p.grp AND k.shard = p.shard WHERE p.op = 'purge'),
ordered AS (SELECT *, row_number() OVER (PARTITION BY grp, key ORDER BY idx) AS n FROM everything),
folded AS (
  SELECT grp, key, n, idx, op, NULL::VARCHAR AS before, CASE WHEN op = 'put' OR (op = 'cas' AND expected IS NULL) THEN value END AS after, op = 'cas' AND expected IS NULL AS ok
  FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.grp, o.key, o.n, o.idx, o.op, f.after,
    CASE WHEN o.op = 'put' OR (o.op = 'cas' AND f.after IS NOT DISTINCT FROM o.expected) THEN o.value WHEN o.op IN ('delete', 'purge') THEN NULL ELSE f.after END,
    o.op = 'cas' AND f.after IS NOT DISTINCT FROM o.expected
  FROM folded f JOIN ordered o ON o.grp = f.grp AND o.key = f.key AND o.n = f.n + 1),
results AS (
  SELECT j.grp, j.idx, struct_pack(found := coalesce(j.op IN ('cas', 'get') AND f.before IS NOT NULL, false), value := CASE WHEN j.op IN ('cas', 'get') THEN f.before END,
    success := coalesce(NOT j.moving AND (j.op IN ('put', 'delete') OR f.ok), false), client_id := 0::BIGINT, moving := j.moving) AS r
  FROM judged j LEFT JOIN folded f ON f.grp = j.grp AND f.idx = j.idx AND f.op <> 'purge'
  UNION ALL
  SELECT grp, idx, struct_pack(found := false, value := NULL::VARCHAR, success := accepted, client_id := 0::BIGINT, moving := false) FROM line)
"""
)


@query(_REPLAY + "SELECT grp, key, after AS value FROM (SELECT * FROM folded QUALIFY row_number() OVER (PARTITION BY grp, key ORDER BY n DESC) = 1) WHERE after IS NOT NULL")
def replay_state(spark, sf_dir):
    return _replay(spark, sf_dir)[0]


@query(
    _REPLAY
    + """, got AS (SELECT grp, idx, dup, last_value(CASE WHEN NOT dup THEN r END IGNORE NULLS) OVER (PARTITION BY grp, client ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r
  FROM dups LEFT JOIN results USING (grp, idx))
SELECT grp, idx, dup, r.found AS found, r.value AS value, r.success AS success, r.client_id AS client_id, r.moving AS moving FROM got"""
)
def replay_replies(spark, sf_dir):
    return _replay(spark, sf_dir)[1]


# -- segments ------------------------------------------------------------------------------------


@query(f"WITH {NEWEST} SELECT key, seq, kind, value FROM newest")
def compaction_keep_newest(spark, sf_dir):
    return compaction.compact(_versions(spark, sf_dir), bottom=False)


@query(f"WITH {NEWEST} SELECT key, seq, kind, value FROM newest WHERE kind = 1")
def compaction_tombstones_bottom(spark, sf_dir):
    return compaction.compact(_versions(spark, sf_dir), bottom=True)


@query(
    f"""WITH {VERSIONS}, old AS (SELECT * FROM versions WHERE seq <= 300 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)
SELECT key, seq, kind, value FROM versions WHERE seq > 300 UNION ALL SELECT key, seq, kind, value FROM old WHERE kind = 1"""
)
def compaction_for_snapshots(spark, sf_dir):
    return compaction.compact(_versions(spark, sf_dir), bottom=True, keep_from=300)


@query(
    f"""WITH {VERSIONS}, s AS (SELECT seq // 50 AS pos, sum(strlen(key) + coalesce(strlen(value), 0))::BIGINT AS bytes FROM versions GROUP BY 1),
w AS (SELECT pos, (sum(bytes) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))::BIGINT AS bytes, count(*) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS n FROM s)
SELECT pos, bytes FROM w WHERE n = 4 ORDER BY bytes, pos LIMIT 1"""
)
def compaction_pick_window(spark, sf_dir):
    v = _versions(spark, sf_dir)
    sizes = v.groupBy(F.floor(F.col("seq") / 50).alias("pos")).agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"))
    return compaction.pick_window(sizes)


@query(f"WITH {NEWEST} SELECT key, value, seq FROM live")
def export_snapshot(spark, sf_dir):
    return V.newest(_versions(spark, sf_dir)).orderBy("key")


@query(f"WITH {VERSIONS} SELECT count(*) AS entries, min(key) AS smallest, max(key) AS largest, max(seq) AS max_seq FROM versions")
def table_statistics(spark, sf_dir):
    return V.table_statistics(_versions(spark, sf_dir))


@query(
    f"""WITH {NEWEST}, a AS (SELECT key, value FROM live), b AS (
  SELECT key, value FROM (SELECT * FROM versions WHERE seq <= 600 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1)
SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""
)
def state_difference(spark, sf_dir):
    v = _versions(spark, sf_dir)
    return V.equal(V.newest(v).select("key", "value"), V.newest(v, 600).select("key", "value"))


_STORED = VERSIONS + """, stored AS (SELECT key, row_number() OVER (ORDER BY seq) AS seq, kind, value FROM versions)"""


def _stored(spark, sf_dir, batches: int = 5) -> Store:
    """A store with the log's puts and deletes, committed in batches."""
    store = Store(spark, f"{_scratch(spark)}/table")
    v = _versions(spark, sf_dir).select(F.col("seq").alias("pos"), "key", "value")
    top = v.agg(F.max("pos")).collect()[0][0]
    for i in range(batches):
        store.write(v.where((F.col("pos") > top * i // batches) & (F.col("pos") <= top * (i + 1) // batches)))
    return store


@query(f"WITH {_STORED} SELECT key, value, seq FROM (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1")
def store_scan(spark, sf_dir):
    return _stored(spark, sf_dir).scan()


@query(f"WITH {_STORED} SELECT key, value, seq FROM (SELECT * FROM stored QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1 AND key >= 'user3' AND key < 'user7'")
def store_compacted(spark, sf_dir):
    """A range after a merge of segments and the removal of those that it replaced."""
    store = _stored(spark, sf_dir)
    store.compact()
    store.vacuum()
    return store.scan("user3", "user7")


@query(
    f"""WITH {_STORED}, half AS (SELECT max(seq) // 2 AS upto FROM stored),
old AS (SELECT key, value, seq FROM (SELECT * FROM stored WHERE seq <= (SELECT upto FROM half) QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) WHERE kind = 1),
gone AS (SELECT min(key) AS key, max(seq) AS top FROM old)
SELECT old.* FROM old, gone WHERE old.key <> gone.key UNION ALL SELECT 'new', 'one', top + 1 FROM gone"""
)
def store_export_restore(spark, sf_dir):
    """Contents as of half the log, exported, restored elsewhere, then a put and a delete."""
    store = _stored(spark, sf_dir)
    at = _scratch(spark)
    store.export(f"{at}/export", store.manifest().max_seq // 2)
    other = Store(spark, f"{at}/table")
    other.put("old", "gone with the restore")
    other.restore(f"{at}/export")
    other.put("new", "one")
    other.delete(other.scan().agg(F.min(F.when(F.col("key") != "new", F.col("key")))).collect()[0][0])
    return other.scan()


@query("SELECT * FROM (VALUES (1::BIGINT, true, NULL::VARCHAR), (2, false, '1'), (3, false, '1'), (4, true, '1'), (5, true, '2')) t(step, success, found)")
def store_cas(spark, sf_dir):
    """Compare-and-swap on one key: absent, present, wrong, right, and again with the new value."""
    store = Store(spark, f"{_scratch(spark)}/table")
    steps = [("1", None), ("x", None), ("x", "2"), ("2", "1"), ("3", "2")]
    rows = [(i + 1, *store.cas("k", value, expected)) for i, (value, expected) in enumerate(steps)]
    return spark.createDataFrame(rows, "step long, success boolean, found string")


@query(f"WITH {VERSIONS} SELECT count(*) AS entries, count(*) AS max_seq, 5::BIGINT AS commits, 5::BIGINT AS segments FROM versions")
def store_stats(spark, sf_dir):
    s = _stored(spark, sf_dir).stats()
    return spark.createDataFrame([(s["entries"], s["max_seq"], s["commits"], s["segments"])], "entries long, max_seq long, commits long, segments long")


# -- audits --------------------------------------------------------------------------------------


def _trace(spark, sf_dir):
    e, kind = F.col("event_id"), F.col("event_type")
    term = F.floor(e / 40) - F.when(kind == "error", F.lit(1)).otherwise(F.lit(0))
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("grp"), (F.col("user_id") % 5).alias("node"), e.alias("event_no"), term.alias("term"),
        F.when(kind == "purchase", "leader").otherwise("follower").alias("state"), (F.floor(e / 50) % 5).alias("leader"), F.floor(e / 3).alias("commit"),
    )


_TRACE = """trace AS (
  SELECT user_id % 3 AS grp, user_id % 5 AS node, event_id AS event_no, event_id // 40 - CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS term,
    CASE WHEN event_type = 'purchase' THEN 'leader' ELSE 'follower' END AS state, (event_id // 50) % 5 AS leader, event_id // 3 AS commit FROM events)"""


@query(f"WITH {_TRACE} SELECT grp, term, count(DISTINCT node) AS leaders FROM trace WHERE state = 'leader' GROUP BY 1, 2 HAVING count(DISTINCT node) > 1")
def audit_leader_per_term(spark, sf_dir):
    return audit.leaders_per_term(_trace(spark, sf_dir))


@query(f"WITH {_TRACE}, w AS (SELECT grp, node, event_no, lag(term) OVER (PARTITION BY grp, node ORDER BY event_no) AS term_before, term FROM trace) SELECT * FROM w WHERE term < term_before")
def audit_term_monotone(spark, sf_dir):
    return audit.term_regressions(_trace(spark, sf_dir))


def _entries(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).alias("grp"), (F.col("user_id") % 5).alias("node"), F.floor(e / 5).alias("idx"), F.floor(e / 40).alias("term"),
        F.when(F.col("event_type") == "view", 1).otherwise(0).alias("entry_type"), F.when(e % 7 == 0, e).otherwise(0).alias("data_hash"), e.alias("event_no"), F.col("event_type").alias("kind"),
    )


_ENTRIES = """entries AS (
  SELECT user_id % 3 AS grp, user_id % 5 AS node, event_id // 5 AS idx, event_id // 40 AS term,
    CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS entry_type, CASE WHEN event_id % 7 = 0 THEN event_id ELSE 0 END AS data_hash, event_id AS event_no, event_type AS kind FROM events)"""


@query(f"WITH {_ENTRIES} SELECT grp, idx, count(DISTINCT (term, data_hash)) AS variants FROM entries GROUP BY 1, 2 HAVING count(DISTINCT (term, data_hash)) > 1")
def audit_commit_agreement(spark, sf_dir):
    return audit.disagreements(_entries(spark, sf_dir))


@query(
    f"""WITH {_ENTRIES}, applied AS (SELECT grp, node, event_no, idx FROM entries WHERE kind <> 'signup'),
o AS (SELECT *, coalesce(lag(idx) OVER (PARTITION BY grp, node ORDER BY event_no), 0) AS before FROM applied),
top AS (SELECT grp, node, max(idx) AS top FROM applied GROUP BY 1, 2)
SELECT grp, node, event_no, idx, 'order' AS reason FROM o WHERE idx <= before
UNION ALL
SELECT e.grp, e.node, NULL AS event_no, e.idx, 'skipped' AS reason FROM entries e JOIN top USING (grp, node)
WHERE entry_type <> 1 AND e.idx < top AND NOT EXISTS (SELECT 1 FROM applied a WHERE a.grp = e.grp AND a.node = e.node AND a.idx = e.idx)"""
)
def audit_apply_gaps(spark, sf_dir):
    """Entries of signups were never applied."""
    e = _entries(spark, sf_dir)
    return audit.apply_gaps(e.where(F.col("kind") != "signup").select("grp", "node", "event_no", "idx"), e)


@query(
    f"""WITH {_TRACE}, r AS (SELECT grp, node, event_no, commit - event_no % 4 AS last_idx, commit // 2 AS snap_idx FROM trace WHERE event_no % 13 = 0),
w AS (SELECT r.*, (SELECT max(commit) FROM trace t WHERE t.grp = r.grp AND t.node = r.node AND t.event_no < r.event_no AND t.event_no % 13 <> 0) AS committed FROM r)
SELECT grp, node, event_no, last_idx, committed FROM w WHERE committed > last_idx AND committed > snap_idx"""
)
def audit_lost_commits(spark, sf_dir):
    t = _trace(spark, sf_dir)
    restart = F.col("event_no") % 13 == 0
    restarts = t.where(restart).select("grp", "node", "event_no", (F.col("commit") - F.col("event_no") % 4).alias("last_idx"), F.floor(F.col("commit") / 2).alias("snap_idx"))
    return audit.lost_commits(restarts, t.where(~restart).select("grp", "node", "event_no", "commit"))


@query(
    f"""WITH {_TRACE}, w AS (SELECT grp, node, leader, lag(leader) OVER (PARTITION BY grp, node ORDER BY event_no) AS before FROM trace WHERE leader <> 0)
SELECT grp, node, count(*) FILTER (WHERE coalesce(before <> leader, true)) AS changes FROM w GROUP BY 1, 2"""
)
def leader_changes(spark, sf_dir):
    return audit.leader_changes(_trace(spark, sf_dir))


@query(f"WITH {_TRACE} SELECT state, count(*) AS events, max(term) AS max_term FROM trace GROUP BY 1")
def event_counts(spark, sf_dir):
    return audit.event_counts(_trace(spark, sf_dir))


@query(
    """WITH rows AS (SELECT user_id AS scan_id, event_id AS pos, 'k' || lpad((event_id // 3)::VARCHAR, 8, '0') AS key FROM events),
w AS (SELECT *, lag(key) OVER (PARTITION BY scan_id ORDER BY pos) AS before FROM rows) SELECT scan_id, pos, key FROM w WHERE key <= before"""
)
def audit_scan_order(spark, sf_dir):
    e = F.col("event_id")
    return audit.unsorted_scans(table(spark, sf_dir, "events").select(F.col("user_id").alias("scan_id"), e.alias("pos"), F.format_string("k%08d", F.floor(e / 3)).alias("key")))


@query(
    """WITH r AS (SELECT DISTINCT 1 AS grp, event_id % 3 AS node, 'user' || user_id AS key, CASE WHEN event_type = 'error' THEN 'x' ELSE 'y' END AS value FROM events)
SELECT grp::BIGINT AS grp, key, count(DISTINCT node) AS holders, count(DISTINCT value) AS variants FROM r GROUP BY 1, 2 HAVING count(DISTINCT node) < 3 OR count(DISTINCT value) > 1"""
)
def replica_diff(spark, sf_dir):
    r = table(spark, sf_dir, "events").select(F.lit(1).cast("long").alias("grp"), (F.col("event_id") % 3).alias("node"), F.concat(F.lit("user"), "user_id").alias("key"), F.when(F.col("event_type") == "error", "x").otherwise("y").alias("value"))
    return audit.replica_difference(r.distinct())


@query(
    """WITH m AS (SELECT event_id // 5 AS grp, event_id + (event_id * 7) % 5 AS match_idx FROM events),
c AS (SELECT grp, list_sort(list(match_idx), 'DESC')[count(*) // 2 + 1] AS commit FROM m GROUP BY 1),
t AS (SELECT event_id // 5 AS grp, event_id AS idx, event_id % 3 AS term FROM events)
SELECT c.grp, commit FROM c JOIN t ON t.grp = c.grp AND t.idx = commit WHERE t.term = c.grp % 3"""
)
def quorum_commit(spark, sf_dir):
    e = F.col("event_id")
    ev = table(spark, sf_dir, "events")
    g = F.floor(e / 5)
    return audit.quorum_commit(ev.select(g.alias("grp"), (e + (e * 7) % 5).alias("match_idx")), ev.select(g.alias("grp"), e.alias("idx"), (e % 3).alias("term")), ev.select(g.alias("grp"), (g % 3).alias("term")).distinct())


@query(
    """SELECT event_id // 5 AS grp, 1::BIGINT AS term, 2::BIGINT AS candidate, count(*) FILTER (WHERE event_type <> 'error') AS granted,
  count(*) FILTER (WHERE event_type <> 'error') >= count(*) // 2 + 1 AS won FROM events GROUP BY 1"""
)
def votes_won(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return audit.votes_won(ev.select(F.floor(F.col("event_id") / 5).alias("grp"), F.lit(1).cast("long").alias("term"), F.lit(2).cast("long").alias("candidate"), (F.col("event_type") != "error").alias("granted")))


@query(
    """WITH a AS (SELECT user_id % 3 AS grp, event_id AS pos, event_id // 2 - CASE WHEN event_type = 'error' THEN event_id % 9 ELSE 0 END AS idx FROM events),
w AS (SELECT *, min(idx) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM a)
SELECT grp, pos, idx FROM w WHERE next IS NULL OR next > idx"""
)
def log_truncation(spark, sf_dir):
    e = F.col("event_id")
    idx = F.floor(e / 2) - F.when(F.col("event_type") == "error", e % 9).otherwise(0)
    return audit.truncated(table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), e.alias("pos"), idx.alias("idx")))


@query(
    """WITH e AS (SELECT 0::BIGINT AS grp, event_id + event_id // 50 AS idx, event_id // 40 + CASE WHEN event_id % 100 > 90 THEN 5 ELSE 0 END AS term FROM events),
w AS (SELECT *, CASE WHEN coalesce(lag(term) OVER (ORDER BY idx) <> term OR lag(idx) OVER (ORDER BY idx) <> idx - 1, true) THEN 1 ELSE 0 END AS new FROM e),
r AS (SELECT *, sum(new) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM w)
SELECT grp, any_value(term) AS term, min(idx) AS first_idx, max(idx) AS last_idx FROM r GROUP BY grp, run"""
)
def term_runs(spark, sf_dir):
    """All events, with an index left out after every 50."""
    e = F.col("event_id")
    own = table(spark, sf_dir, "events")
    return audit.term_runs(own.select(F.lit(0).cast("long").alias("grp"), (e + F.floor(e / 50)).alias("idx"), (F.floor(e / 40) + F.when(e % 100 > 90, 5).otherwise(0)).alias("term")))


@query(
    """WITH e AS (SELECT user_id AS grp, event_id AS idx, (event_id * 37) % 900 AS size FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY idx) AS n, sum(size) OVER (PARTITION BY grp ORDER BY idx ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT grp, idx, size FROM w WHERE n <= 8 AND (s <= 2000 OR n = 1)"""
)
def fit_batch(spark, sf_dir):
    e = F.col("event_id")
    return scans.fit_batch(table(spark, sf_dir, "events").select(F.col("user_id").alias("grp"), e.alias("idx"), ((e * 37) % 900).alias("size")), 8, 2000)


@query()
def linearizability(spark, sf_dir):
    """A history whose replies follow the log, one in 50 of them made up."""
    log = command_log(spark, sf_dir)
    wrong = F.col("idx") % 50 == 0
    results = fold.results(log).select("idx", "found", F.col("value").alias("out_value"), "success")
    own = log.join(results, "idx")
    history = own.select(
        (F.col("idx") % 3).cast("int").alias("client_id"), F.col("op").alias("kind"), "key", "value", "expected", F.col("expected").isNull().alias("absent"),
        F.when(wrong, "?").otherwise(F.coalesce("out_value", F.lit(""))).alias("out_value"), F.col("found").alias("out_found"), F.col("success").alias("out_ok"),
        (F.col("idx") * 10).alias("call_ns"), (F.col("idx") * 10 + 25).alias("return_ns"),
    )
    return audit.linearizable(history)


def _journal(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(F.col("event_type") == "signup", "state").when((F.col("event_type") == "error") & (e % 40 == 0), "snapshot").otherwise("entry")
    idx = F.floor(e / 2) - F.when(F.col("event_type") == "click", e % 9).otherwise(0)
    return table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), e.alias("pos"), kind.alias("kind"), idx.alias("idx"), F.floor(e / 40).alias("term"))


_JOURNAL = """journal AS (
  SELECT user_id % 3 AS grp, event_id AS pos, CASE WHEN event_type = 'signup' THEN 'state' WHEN event_type = 'error' AND event_id % 40 = 0 THEN 'snapshot' ELSE 'entry' END AS kind,
    event_id // 2 - CASE WHEN event_type = 'click' THEN event_id % 9 ELSE 0 END AS idx, event_id // 40 AS term FROM events)"""


@query(
    f"""WITH {_JOURNAL}, e AS (SELECT grp, pos, idx, term, min(idx) OVER (PARTITION BY grp ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM journal WHERE kind = 'entry'),
s AS (SELECT grp, max(idx) AS snap FROM journal WHERE kind = 'snapshot' GROUP BY 1)
SELECT e.grp, pos, idx, term FROM e LEFT JOIN s USING (grp) WHERE (next IS NULL OR next > idx) AND (snap IS NULL OR idx > snap)"""
)
def log_repair(spark, sf_dir):
    return audit.repaired(_journal(spark, sf_dir))


@query(f"WITH {_JOURNAL} SELECT grp, term, pos FROM journal WHERE kind = 'state' QUALIFY row_number() OVER (PARTITION BY grp ORDER BY pos DESC) = 1")
def hard_state(spark, sf_dir):
    return audit.hard_state(_journal(spark, sf_dir))


@query(
    """WITH p AS (SELECT user_id % 3 AS grp, event_id AS idx, event_id // 40 AS term FROM events),
e AS (SELECT grp, idx, term + CASE WHEN idx % 11 = 0 THEN 1 ELSE 0 END AS term FROM p WHERE idx <= (SELECT max(idx) * 9 // 10 FROM p))
SELECT p.grp, p.idx, p.term, CASE WHEN e.term IS NULL THEN 'pending' WHEN e.term = p.term THEN 'committed' ELSE 'rejected' END AS outcome FROM p LEFT JOIN e ON e.grp = p.grp AND e.idx = p.idx"""
)
def proposals_settled(spark, sf_dir):
    """Proposals at every index; the last tenth has no entry yet."""
    i = F.col("event_id")
    p = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("grp"), i.alias("idx"), F.floor(i / 40).alias("term"))
    known = p.agg(F.floor(F.max("idx") * 9 / 10)).collect()[0][0]
    return audit.settled(p, p.where(F.col("idx") <= known).withColumn("term", F.col("term") + (F.col("idx") % 11 == 0).cast("long")))


@query(f"WITH {_TRACE}, w AS (SELECT *, row_number() OVER (PARTITION BY grp, node ORDER BY event_no DESC) AS n, count(*) OVER (PARTITION BY grp, node) AS events FROM trace) SELECT grp, node, term, commit, leader, events FROM w WHERE n = 1")
def group_metrics(spark, sf_dir):
    return audit.group_metrics(_trace(spark, sf_dir))


@query("SELECT event_id // 3 * 10 AS at, event_id AS seq FROM events")
def event_order(spark, sf_dir):
    e = F.col("event_id")
    return audit.in_time_order(table(spark, sf_dir, "events").select((F.floor(e / 3) * 10).alias("at"), e.alias("seq")))


@query(f"WITH {_ENTRIES} SELECT grp, idx, count(DISTINCT (term, data_hash)) AS prints FROM entries GROUP BY 1, 2")
def entry_fingerprints(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("print", scalars.fingerprint(F.col("term"), F.col("data_hash")))
    return e.groupBy("grp", "idx").agg(F.countDistinct("print").alias("prints"))


@query(f"WITH {VERSIONS} SELECT key, seq, kind, row_number() OVER (ORDER BY key, seq DESC) AS place FROM versions")
def internal_key_order(spark, sf_dir):
    """Versions in the order of their sort keys, which is split again into key, number and kind."""
    from .operators.ordered import running_sum

    v = _versions(spark, sf_dir).select(scalars.internal_key(F.col("key"), F.col("seq"), F.col("kind")).alias("k"))
    ranked = v.orderBy("k").select("k", F.monotonically_increasing_id().alias("at"))
    placed = running_sum(ranked, [], "at", F.lit(1), "place")
    return placed.select("k.key", (-F.col("k.newest_first")).alias("seq"), "k.kind", "place")


@query(f"WITH {NEWEST} SELECT * FROM live WHERE key IN (SELECT 'user' || c_custkey FROM customer)")
def get_many(spark, sf_dir):
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("user"), "c_custkey").alias("key"))
    return V.get_many(_versions(spark, sf_dir), keys)


@query(
    f"""WITH {VERSIONS}, opening AS (SELECT key, seq FROM versions WHERE kind = 1 ORDER BY seq LIMIT 1),
found AS (SELECT v.* FROM versions v, opening f WHERE v.key = f.key AND v.seq <= f.seq + 5 ORDER BY v.seq DESC LIMIT 1)
SELECT mode, key, value FROM found, (VALUES ('log'), ('index')) m(mode) WHERE kind = 1"""
)
def read_modes(spark, sf_dir):
    """The key that is put first, five commands later, by both modes."""
    log = command_log(spark, sf_dir).where(F.col("op").isin("put", "delete"))
    first = log.where("op = 'put'").orderBy("idx").select("key", "idx").limit(1).collect()[0]
    both = [access.read(log, first.key, mode, first.idx + 5).select(F.lit(mode).alias("mode"), "key", "value") for mode in ("log", "index")]
    return both[0].unionByName(both[1])


@query(f"WITH {LOG} SELECT client_id, idx, row_number() OVER (PARTITION BY client_id ORDER BY idx) AS req_seq FROM log")
def session_sequence(spark, sf_dir):
    return sessions.number_requests(command_log(spark, sf_dir).select("client_id", "idx"))


@query(_GROUPED + " SELECT CASE WHEN shard = 5 THEN 4 ELSE grp END AS grp, key, value FROM grouped JOIN sharded USING (key)")
def shard_move_resumed(spark, sf_dir):
    """A move that is stopped before each of its steps and run again; what the owning groups hold then."""
    groups = moves.Groups(spark, _scratch(spark))
    groups.create_map([2, 3, 4])
    none = F.lit(None).cast("string")
    live = shards.route(V.newest(_versions(spark, sf_dir)), groups.map_rows())
    groups.append(
        live.select(
            "grp", F.col("seq").alias("idx"), F.lit(0).cast("long").alias("client_id"), F.lit(0).cast("long").alias("req_seq"), F.lit("put").alias("op"), "key", "value", none.alias("expected"), "shard",
            F.lit(None).cast("array<struct<key:string,value:string>>").alias("kvs"), F.lit(False).alias("last"),
        )
    )
    for step in ("freeze", "import", "purge", "flip", None):
        groups.move(5, 4, max_rows=3, stop_before=step)
    return shards.owned(groups.pairs(), groups.map_rows()).select("grp", "key", "value")


# -- benchmark statistics ------------------------------------------------------------------------


def _samples(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("method"), ((e * 7919) % 100003 + 1000).alias("ns"), (e * 1500000 + (e * 31) % 9 * 100000).alias("t"), ((e * 7919) % 1000 / 1000.0).alias("seconds"))


_SAMPLES = "samples AS (SELECT event_type AS method, (event_id * 7919) % 100003 + 1000 AS ns, event_id * 1500000 + (event_id * 31) % 9 * 100000 AS t, (event_id * 7919) % 1000 / 1000.0::DOUBLE AS seconds FROM events)"


@query(
    f"""WITH {_SAMPLES}, o AS (SELECT method, list_sort(list(ns)) AS v, count(*) AS n FROM samples GROUP BY 1)
SELECT method, n AS ops, v[n // 2 + 1] AS p50, v[n * 99 // 100 + 1] AS p99, v[n * 999 // 1000 + 1] AS p999 FROM o"""
)
def latency_ranks(spark, sf_dir):
    return benchstats.latency(_samples(spark, sf_dir), "method", "ns")


@query(f"WITH {_SAMPLES} SELECT method, count(*) AS ops, count(*) / ((max(t + ns) - min(t)) / 1e9) AS throughput FROM samples GROUP BY 1")
def throughput(spark, sf_dir):
    return benchstats.throughput(_samples(spark, sf_dir), "method", F.col("t"), F.col("t") + F.col("ns"))


@query(
    f"""WITH {_SAMPLES}, w AS (SELECT method, t, lag(t) OVER (PARTITION BY method ORDER BY t) AS before FROM samples)
SELECT method, max(t - before) AS gap FROM w WHERE t >= (SELECT min(t) FROM samples) AND (before IS NULL OR before <= (SELECT max(t) FROM samples)) GROUP BY 1"""
)
def longest_gap(spark, sf_dir):
    """Over the whole time that the samples take."""
    s = _samples(spark, sf_dir)
    since, until = s.agg(F.min("t"), F.max("t")).collect()[0]
    return benchstats.longest_gap(s, "method", "t", F.lit(since), F.lit(until))


@query(
    f"""WITH {_SAMPLES}, c AS (SELECT t // 1000000 AS bucket, count(*) AS n FROM samples GROUP BY 1)
SELECT i AS bucket, coalesce(n, 0) AS n FROM range((SELECT max(t) FROM samples) // 1000000 + 1) r(i) LEFT JOIN c ON c.bucket = i"""
)
def timeline_buckets(spark, sf_dir):
    """All samples, in buckets of a millisecond, shorter than the time between most of them."""
    s = _samples(spark, sf_dir)
    return benchstats.buckets(s, "t", 1000000, s.agg(F.max("t")).collect()[0][0])


@query(
    f"""WITH {_SAMPLES} SELECT method, i::INTEGER AS bucket, 0.0001::DOUBLE * (1 << i) AS le, count(*) FILTER (WHERE seconds <= 0.0001::DOUBLE * (1 << i)) AS n
FROM samples, range(16) r(i) GROUP BY 1, 2, 3"""
)
def latency_histogram(spark, sf_dir):
    return benchstats.histogram(_samples(spark, sf_dir), "method", "seconds")


@query(
    """SELECT l_returnflag AS flag, max(n) FILTER (WHERE s = 'F') AS "F", max(n) FILTER (WHERE s = 'O') AS "O" FROM (
  SELECT l_returnflag, l_linestatus AS s, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1"""
)
def chart_series(spark, sf_dir):
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), "l_linestatus").agg(F.count("*").alias("n"))
    return benchstats.series(counts, "flag", "l_linestatus", "n", ["F", "O"])


@query("SELECT event_id, 'key' || lpad(event_id::VARCHAR, 8, '0') AS key, 'mshard/' || lpad((event_id % 16)::VARCHAR, 2, '0') AS shard_key, event_id // 2 + 1 AS quorum FROM events")
def formatted_keys(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.bench_key(e).alias("key"), scalars.shard_key(e % 16).alias("shard_key"), scalars.quorum(e).alias("quorum"))


@query(
    """SELECT event_id, CASE WHEN x >= 1e6 THEN printf('%.1fM', x / 1e6) WHEN x >= 1e3 THEN printf('%.1fk', x / 1e3) WHEN x >= 100 THEN printf('%.0f', x)
  WHEN x >= 10 THEN printf('%.1f', x) ELSE printf('%.2f', x) END AS label FROM (SELECT event_id, (event_id * event_id)::DOUBLE / 4 + 0.3 AS x FROM events)"""
)
def short_numbers(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", scalars.short_number((e * e).cast("double") / 4 + 0.3).alias("label"))


# -- streams -------------------------------------------------------------------------------------


def _scratch(spark: SparkSession) -> str:
    import tempfile

    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp()
    return f"{at.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(ORACLES["fold_cas_state"])
def stream_state(spark, sf_dir):
    """In several micro-batches, each of a part of the log, so state is carried from one to the next."""
    at = _scratch(spark)
    log = command_log(spark, sf_dir).select(*apply.LOG.names)
    top = log.agg(F.max("idx")).collect()[0][0]
    for i in range(4):
        own = log.where((F.col("idx") > top * i // 4) & (F.col("idx") <= top * (i + 1) // 4))
        own.write.mode("append").parquet(f"{at}/log")
        # A batch is a part whole, of as many files as tasks wrote; the next run goes on behind it.
        out = apply.run_available(apply.results(apply.read_log(spark, f"{at}/log", 1_000_000)), f"{at}/out", f"{at}/checkpoint")
    return apply.last_states(out)


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events WHERE ts < (SELECT time_bucket(INTERVAL '1 hour', max(ts)) FROM events) GROUP BY 1")
def stream_timeline(spark, sf_dir):
    """Windows that the watermark has closed: all but the newest."""
    at = _scratch(spark)
    own = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))  # a watermark needs an instant
    own.repartitionByRange(2, "ts").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(own.schema).parquet(f"{at}/in")
    closed = apply.run_available(timeline.counts(stream, "ts", "1 hour", "0 seconds"), f"{at}/out", f"{at}/checkpoint")
    return closed.select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query(
    """WITH c AS (SELECT DISTINCT user_id AS transfer, (event_id % 12 + event_id % 12 // (user_id % 7 + 5)) * 10 AS offs FROM events),
w AS (SELECT *, (row_number() OVER (PARTITION BY transfer ORDER BY offs) - 1) * 10 AS expected FROM c)
SELECT transfer, offs AS "offset", 10::BIGINT AS size FROM w WHERE offs = expected"""
)
def snapshot_chunks(spark, sf_dir):
    """Of each user 12 chunks, with a hole behind the first few."""
    e = F.col("event_id") % 12
    hole = F.floor(e / (F.col("user_id") % 7 + 5))
    own = table(spark, sf_dir, "events")
    return timeline.contiguous_chunks(own.select(F.col("user_id").alias("transfer"), ((e + hole) * 10).alias("offset"), F.lit(10).cast("long").alias("size")))
