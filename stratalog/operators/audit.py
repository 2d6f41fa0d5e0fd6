"""Checks over traces of replicated groups.  Every check returns its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ordered


def leaders_per_term(trace: DataFrame) -> DataFrame:
    """Terms of a group with more than one leader."""
    led = trace.where(F.col("state") == "leader")
    return led.groupBy("grp", "term").agg(F.countDistinct("node").alias("leaders")).where("leaders > 1")


def term_regressions(trace: DataFrame) -> DataFrame:
    """Events at which a node's term is lower than at its event before."""
    own = ordered.previous(trace.select("grp", "node", "event_no", "term"), ["grp", "node"], "event_no", {"term_before": "term"})
    return own.where(F.col("term") < F.col("term_before")).select("grp", "node", "event_no", "term_before", "term")


def disagreements(entries: DataFrame) -> DataFrame:
    """Indexes of a group at which nodes hold different entries ``term, data_hash``."""
    return entries.groupBy("grp", "idx").agg(F.countDistinct("term", "data_hash").alias("variants")).where("variants > 1")


def apply_gaps(applied: DataFrame, entries: DataFrame, no_op: int = 1) -> DataFrame:
    """Applied entries ``grp, node, event_no, idx`` out of order, or behind a skipped entry that is
    not a no-op.  ``entries``: ``grp, node, idx, entry_type``, those above the node's snapshot."""
    own = ordered.previous(applied, ["grp", "node"], "event_no", {"_before": "idx"})
    own = own.withColumn("idx_before", F.coalesce("_before", F.lit(0)))
    backwards = own.where(F.col("idx") <= F.col("idx_before")).select("grp", "node", "event_no", "idx", F.lit("order").alias("reason"))
    # An entry is skipped if its node applied a higher index but never this one.
    done = applied.select("grp", "node", "idx").distinct()
    top = applied.groupBy("grp", "node").agg(F.max("idx").alias("top"))
    skipped = entries.where(F.col("entry_type") != no_op).join(done, ["grp", "node", "idx"], "left_anti").join(top, ["grp", "node"]).where(F.col("idx") < F.col("top"))
    return backwards.unionByName(skipped.select("grp", "node", F.lit(None).cast("long").alias("event_no"), "idx", F.lit("skipped").alias("reason")))


def lost_commits(restarts: DataFrame, commits: DataFrame) -> DataFrame:
    """Restarts ``grp, node, event_no, last_idx, snap_idx`` of a node that had reported a higher
    commit ``grp, node, event_no, commit`` before and holds neither entry nor snapshot of it."""
    both = restarts.select("grp", "node", "event_no", "last_idx", "snap_idx", F.lit(None).cast("long").alias("commit"))
    both = both.unionByName(commits.select("grp", "node", "event_no", F.lit(None).cast("long").alias("last_idx"), F.lit(None).cast("long").alias("snap_idx"), "commit"))
    before = Window.partitionBy("grp", "node").orderBy("event_no").rowsBetween(Window.unboundedPreceding, -1)
    own = both.withColumn("committed", F.max("commit").over(before)).where(F.col("last_idx").isNotNull())
    return own.where((F.col("committed") > F.col("last_idx")) & (F.col("committed") > F.col("snap_idx"))).select("grp", "node", "event_no", "last_idx", "committed")


def quorum_commit(matches: DataFrame, log_terms: DataFrame, current: DataFrame) -> DataFrame:
    """``grp, commit``: the highest index that a majority of ``grp, node, match_idx`` has reached,
    if its entry is of the leader's own term (``log_terms``: grp, idx, term; ``current``: grp, term)."""
    descending = matches.groupBy("grp").agg(F.sort_array(F.collect_list("match_idx"), asc=False).alias("m"))
    at = descending.select("grp", F.element_at("m", (F.floor(F.size("m") / 2) + 1).cast("int")).alias("commit"))
    own = at.join(log_terms.select("grp", F.col("idx").alias("commit"), F.col("term").alias("entry_term")), ["grp", "commit"]).join(current, "grp")
    return own.where(F.col("entry_term") == F.col("term")).select("grp", "commit")


def votes_won(votes: DataFrame) -> DataFrame:
    """``grp, term, candidate, granted, won`` of votes with ``granted``: a majority of all nodes."""
    out = votes.groupBy("grp", "term", "candidate").agg(F.count_if("granted").alias("granted"), F.count("*").alias("n"))
    return out.select("grp", "term", "candidate", "granted", (F.col("granted") >= F.floor(F.col("n") / 2) + 1).alias("won"))


def truncated(appends: DataFrame) -> DataFrame:
    """Entries ``grp, pos, idx, ...`` of an append journal that survive: a later append at an index
    voids what was at and above it."""
    own = ordered.least_behind(appends, ["grp"], "pos", "idx", "_next")
    return own.where(F.col("_next").isNull() | (F.col("_next") > F.col("idx"))).drop("_next")


def repaired(records: DataFrame) -> DataFrame:
    """``grp, pos, idx, term`` of the entries that a journal of records ``grp, pos, kind, idx, term``
    (kind: entry, state or snapshot) leaves: those that no later entry at or below their index voids
    and that lie above the last snapshot."""
    entries = truncated(records.where(F.col("kind") == "entry").select("grp", "pos", "idx", "term"))
    snapshots = records.where(F.col("kind") == "snapshot").groupBy("grp").agg(F.max("idx").alias("_snap"))
    return entries.join(snapshots, "grp", "left").where(F.col("_snap").isNull() | (F.col("idx") > F.col("_snap"))).drop("_snap")


def hard_state(records: DataFrame) -> DataFrame:
    """``grp, term, pos`` of the newest state record of each group's journal."""
    states = records.where(F.col("kind") == "state")
    return states.groupBy("grp").agg(F.max_by("term", "pos").alias("term"), F.max("pos").alias("pos"))


def settled(proposals: DataFrame, entries: DataFrame) -> DataFrame:
    """Proposals ``grp, idx, term`` with ``outcome``: committed if the entry ``grp, idx, term`` that came
    to stand at their index is of their term, rejected if it is of another, else pending."""
    own = proposals.join(entries.select("grp", "idx", F.col("term").alias("_term")), ["grp", "idx"], "left")
    outcome = F.when(F.col("_term").isNull(), "pending").when(F.col("_term") == F.col("term"), "committed").otherwise("rejected")
    return own.select("grp", "idx", "term", outcome.alias("outcome"))


def group_metrics(trace: DataFrame) -> DataFrame:
    """Gauges and counters of each node: its newest term, commit and leader, and its events."""
    newest = F.max_by(F.struct("term", "commit", "leader"), "event_no").alias("s")
    return trace.groupBy("grp", "node").agg(newest, F.count("*").alias("events")).select("grp", "node", "s.term", "s.commit", "s.leader", "events")


def in_time_order(events: DataFrame) -> DataFrame:
    """Events ``at, seq`` by time, and by their number where times are equal."""
    return events.orderBy("at", "seq")


def term_runs(entries: DataFrame) -> DataFrame:
    """``grp, term, first_idx, last_idx`` of every run of entries of one term, with no index
    missing."""
    own = ordered.previous(entries, ["grp"], "idx", {"_term": "term", "_idx": "idx"})
    new = F.coalesce((F.col("_term") != F.col("term")) | (F.col("_idx") != F.col("idx") - 1), F.lit(True)).cast("int")
    own = ordered.running_sum(own, ["grp"], "idx", new, "_run")
    return own.groupBy("grp", "_run").agg(F.first("term").alias("term"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx")).drop("_run")


def leader_changes(trace: DataFrame) -> DataFrame:
    """``grp, changes``: transitions to another leader; 0 is none."""
    own = ordered.previous(trace.where(F.col("leader") != 0), ["grp", "node"], "event_no", {"_before": "leader"})
    return own.groupBy("grp", "node").agg(F.count_if(F.coalesce(F.col("_before") != F.col("leader"), F.lit(True))).alias("changes"))


def unsorted_scans(rows: DataFrame) -> DataFrame:
    """Rows ``scan_id, pos, key`` of scan replies whose key is not above the one before."""
    order = Window.partitionBy("scan_id").orderBy("pos")
    return rows.withColumn("_before", F.lag("key").over(order)).where(F.col("key") <= F.col("_before")).drop("_before")


def replica_difference(replicas: DataFrame) -> DataFrame:
    """``grp, key, holders, variants`` of keys that not all replicas of a group ``grp, node, key,
    value`` hold with one value."""
    nodes = replicas.groupBy("grp").agg(F.countDistinct("node").alias("nodes"))
    own = replicas.groupBy("grp", "key").agg(F.countDistinct("node").alias("holders"), F.countDistinct("value").alias("variants"))
    return own.join(F.broadcast(nodes), "grp").where((F.col("holders") < F.col("nodes")) | (F.col("variants") > 1)).drop("nodes")


def event_counts(trace: DataFrame) -> DataFrame:
    return trace.groupBy("state").agg(F.count("*").alias("events"), F.max("term").alias("max_term"))


def linearizable(history: DataFrame, most_states: int = 200_000) -> DataFrame:
    """``key, operations, verdict`` (ok, violation or unknown) of a history of put, delete, get and
    cas operations: whether some order that respects real time explains every reply.  An empty value
    stands for an absent key, so no operation may write one.

    A key's operations stream through in order of their calls and are decided in pieces, cut where
    no operation is pending; the states that a piece may end in are carried into the next, so a
    worker holds one piece however long the history is.  The problem is exponential in overlapping
    operations: a key whose search would hold more than ``most_states`` states at once is reported
    as unknown, never as ok.
    """
    names = ["key", *(c for c in history.columns if c != "key")]
    sorted_ = history.select(*names).repartition("key").sortWithinPartitions("key", "call_ns", "return_ns")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("operations", pa.int64()), ("verdict", pa.string())])
        one, done = None, []
        for batch in batches:
            for op in batch.to_pylist():
                if one is None or op["key"] != one.key:
                    if one is not None:
                        done.append((one.key, one.operations, one.verdict()))
                    one = _Search(op["key"], most_states)
                one.add(op)
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in done], schema=schema)
                done = []
        if one is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (one.key, one.operations, one.verdict()), strict=True))], schema=schema)

    return sorted_.mapInArrow(run, "key string, operations long, verdict string")


class _Search:
    """Of one key: the states that its operations up to the last cut may leave, and those since."""

    def __init__(self, key: str | None, most: int):
        self.key, self.most = key, most
        self.operations = 0
        self.states: set[str] | None = {""}  # None: unknown
        self.piece: list[dict] = []
        self.last_return = None

    def add(self, op: dict) -> None:
        self.operations += 1
        if not self.states:
            return
        if self.piece and op["call_ns"] > self.last_return:
            self._cut()
        self.last_return = op["return_ns"] if not self.piece else max(self.last_return, op["return_ns"])
        self.piece.append(op)

    def _cut(self) -> None:
        self.states = _explain(self.piece, self.states, self.most)
        self.piece = []

    def verdict(self) -> str:
        if self.states and self.piece:
            self._cut()
        return "unknown" if self.states is None else "ok" if self.states else "violation"


def _apply(state: str, op: dict) -> str | None:
    """State after an operation, or None if its reply contradicts the state; "" is absent."""
    if op["kind"] == "put":
        return op["value"]
    if op["kind"] == "delete":
        return ""
    if (op["out_value"] or "") != state or bool(op["out_found"]) != (state != ""):
        return None
    if op["kind"] == "get":
        return state
    holds = state == "" if op["absent"] else state == (op["expected"] or "")
    if bool(op["out_ok"]) != holds:
        return None
    return op["value"] if holds else state


def _explain(ops: list[dict], states: set[str], most: int) -> set[str] | None:
    """States after all operations (ordered by call), from any of ``states``: none if no order
    explains the replies, None if a level and the one that follows it, which are held together,
    have more than ``most`` states.

    Breadth-first over (operations done, state), a level an operation; a step may take any that was
    called before every operation left has returned.  What is done is all before ``first``, and the
    bits of ``done`` from there on.
    """
    n = len(ops)
    level = {(0, 0, x) for x in states}
    for _ in range(n):
        following = set()
        for first, done, state in level:
            left, i, first_return = [], first, None
            while i < n and (first_return is None or ops[i]["call_ns"] <= first_return):
                if not done >> (i - first) & 1:
                    left.append(i)
                    first_return = ops[i]["return_ns"] if first_return is None else min(first_return, ops[i]["return_ns"])
                i += 1
            for i in left:
                if ops[i]["call_ns"] > first_return:
                    break
                after = _apply(state, ops[i])
                if after is not None:
                    now = done | 1 << (i - first)
                    skip = (~now & (now + 1)).bit_length() - 1  # done ones in a row from first on
                    following.add((first + skip, now >> skip, after))
            if len(level) + len(following) > most:
                return None
        level = following
    return {state for _, _, state in level}
