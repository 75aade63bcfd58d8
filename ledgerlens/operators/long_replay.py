"""J5 for histories that no task should fold: windows, then pointer doubling.

An exception's history has two phases, because nothing leads back from
RESOLVED, APPROVED or CLOSED to an earlier status.

* Open: every valid assign is accepted; between two of them the first start of
  the assignee is, and no other.  So the state before each action follows from
  the last assign, the last such start and a running count.  The first
  resolve, approve or close that the rules accept in that state is the head and
  ends the phase.
* Versioned: only actions of the current version are accepted, and each raises
  it by one.  So each action points at the first later one that expects the
  next version, and the accepted ones are those that the head reaches.  They
  are marked by doubling: the marked ones jump as far as they are many.

In strict mode the second phase has two actions at most (approve, close), which
are looked up one after the other.  Histories are cut into pieces
(``running.Pieces``), positions are numbered by ranges, and each step is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.operators.running import LEAST_ROWS, Pieces
from ledgerlens.operators.workflow import STRICT_FROM, VERSIONED, new_status, own_code, reject_code
from ledgerlens.session import materialize, new_run_dir, with_dense_ids

ACTION = ["seq", "action", "actor", "actor_role", "expected_version", "assign_to", "note"]



def _action() -> dict[str, Column]:
    return {c: F.col(c) for c in ACTION}


def _state(status: str, version: str, owner: str) -> dict[str, Column]:
    return {"status": F.col(status), "version": F.col(version), "assigned_to": F.col(owner)}


def _open_phase(exc: DataFrame, actions: DataFrame, strict: bool, run_dir: str, least: int) -> DataFrame:
    """Every action with its place ``pos``, the state before it if the open phase lasted till there, and its ``code`` in that state."""
    acts = actions.select("exception_id", F.col("seq").cast("long").alias("seq"), "action", "actor", "actor_role",
                          F.col("expected_version").cast("int").alias("expected_version"), "assign_to", "note")
    first = exc.select("exception_id", F.col("status").alias("s0"), F.col("version").cast("int").alias("v0"), F.col("assigned_to").alias("a0"))
    rows = with_dense_ids(acts, ["exception_id", *ACTION], "pos").join(first, "exception_id").withColumn("own", own_code(_action()))
    pieces = Pieces(materialize(rows, "numbered", run_dir), ["exception_id"], "pos", least)
    valid = F.col("own").isNull()
    is_open = ~F.coalesce(F.col("s0").isin(S.NO_REASSIGN_STATUSES), F.lit(False))
    rows = pieces.rows.withColumn("assigns", valid & is_open & (F.col("action") == "assign"))
    rows = pieces.last(rows, F.when(F.col("assigns"), F.struct("pos", "assign_to")), ["pos"], "since", strict=True)
    rows = rows.withColumn("owner", F.when(F.col("since").isNotNull(), F.col("since.assign_to")).otherwise(F.col("a0")))
    startable = F.col("since").isNotNull() | F.coalesce(F.col("s0") == "ASSIGNED", F.lit(True))
    starts = valid & startable & (F.col("action") == "start") & F.coalesce(F.col("owner") == F.col("actor"), F.lit(False))
    rows = materialize(rows.withColumn("starts", starts), "assigned", run_dir)
    rows = pieces.last(rows, F.when(F.col("starts"), F.col("pos")), ["pos"], "started", strict=True)
    working = F.col("started").isNotNull() & (F.col("since").isNull() | (F.col("started") > F.col("since.pos")))
    rows = materialize(rows.withColumn("working", working), "started", run_dir)
    rows = pieces.total(rows, (F.col("assigns") | (F.col("starts") & ~F.col("working"))).cast("int"), ["pos"], "accepted")
    status = F.when(F.col("working"), "IN_PROGRESS").when(F.col("since").isNotNull(), "ASSIGNED").otherwise(F.col("s0"))
    rows = rows.withColumn("status", status).withColumn("version", F.col("v0") + F.col("accepted").cast("int"))
    return materialize(rows.withColumn("code", reject_code(_state("status", "version", "owner"), _action(), strict)), "open", run_dir)


def _reached(nodes: DataFrame, heads: DataFrame, run_dir: str, least: int) -> DataFrame:
    """Of ``nodes`` (exception_id, pos, expected_version), the places that the heads reach, themselves included: pos."""
    own = nodes.select("exception_id", F.col("expected_version").alias("bucket"), "pos", F.lit(0).alias("asks"))
    asks = nodes.select("exception_id", (F.col("expected_version") + 1).alias("bucket"), "pos", F.lit(1).alias("asks"))
    pieces = Pieces(materialize(own.unionByName(asks), "asked", run_dir), ["exception_id", "bucket"], "pos", least)
    # from the end: an action that asks comes before one of its own place, so it never finds itself
    found = pieces.last(pieces.rows, F.when(F.col("asks") == 0, F.col("pos")), ["pos", "asks"], "next", descending=True, strict=True)
    jump = materialize(found.filter("asks = 1 AND next IS NOT NULL").select("pos", "next"), "jump_00", run_dir)
    marked, rnd = materialize(heads.select("pos"), "marked_00", run_dir), 0
    while True:
        rnd += 1
        more = materialize(marked.join(jump, "pos").select(F.col("next").alias("pos")), f"more_{rnd:02d}", run_dir)
        if more.isEmpty():
            return marked
        marked = materialize(marked.unionByName(more), f"marked_{rnd:02d}", run_dir)
        ahead = jump.select(F.col("pos").alias("next"), F.col("next").alias("after"))
        jump = materialize(jump.join(ahead, "next").select("pos", F.col("after").alias("next")), f"jump_{rnd:02d}", run_dir)


def _strict_phase(later: DataFrame, heads: DataFrame) -> DataFrame:
    """The codes of the actions after the heads, if the status is checked as well."""
    after = {v: a for a, (v, *_) in STRICT_FROM.items()}
    needed = lambda status: F.coalesce(*[F.when(status == s, F.lit(a)) for s, a in after.items()])
    at = heads.select("exception_id", F.col("pos").alias("p0"), new_status(F.col("action")).alias("t0"), (F.col("version") + 1).alias("w0"), "owner")
    for k in range(2):
        fits = later.join(at, "exception_id").filter((F.col("pos") > F.col(f"p{k}")) & F.col("own").isNull() & (F.col("action") == needed(F.col(f"t{k}")))
                                                     & F.col("expected_version").eqNullSafe(F.col(f"w{k}")))
        found = fits.groupBy("exception_id").agg(F.min("pos").alias(f"p{k + 1}"))
        # without such an action the state stays as it is
        at = at.join(found, "exception_id", "left").withColumn(f"t{k + 1}", F.when(F.col(f"p{k + 1}").isNotNull(), new_status(needed(F.col(f"t{k}"))))) \
            .withColumn(f"w{k + 1}", F.when(F.col(f"p{k + 1}").isNotNull(), F.col(f"w{k}") + 1))
    rows = later.join(at.drop("owner"), "exception_id")
    state = lambda c: F.when(F.col("pos") > F.col("p2"), F.col(f"{c}2")).when(F.col("pos") > F.col("p1"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    rows = rows.withColumn("t", state("t")).withColumn("w", state("w"))
    return rows.select("exception_id", "seq", "action", "pos", "assign_to",
                       reject_code(_state("t", "w", "head_owner"), _action(), True).alias("code"),
                       F.col("head_owner").alias("assigned_to"))


def long_replay(exc: DataFrame, actions: DataFrame, strict: bool = False, run_dir: str | None = None,
                least: int = LEAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(final state, per-action outcomes), equal to those of ``workflow.fold_views``.

    Null statuses, versions and assignees behave as in the fold; actions that
    are equal in all columns are both replayed; actions of other exceptions are
    left out; exceptions without actions keep their state."""
    run_dir = run_dir or new_run_dir(exc.sparkSession, "replay")
    rows = _open_phase(exc, actions, strict, run_dir, least)
    ends = rows.filter(F.col("action").isin(VERSIONED) & F.col("code").isNull()).groupBy("exception_id").agg(F.min("pos").alias("pos"))
    heads = materialize(rows.join(ends, ["exception_id", "pos"], "left_semi"), "heads", run_dir)
    known = heads.select("exception_id", F.col("pos").alias("head"), F.col("owner").alias("head_owner"), F.col("version").alias("head_version"))
    rows = rows.join(known, "exception_id", "left")
    sooner = rows.filter("head IS NULL OR pos <= head")
    told = sooner.select("exception_id", "seq", "action", "pos", "assign_to", "code",
                         F.when(F.col("code").isNull() & (F.col("action") == "assign"), F.col("assign_to")).otherwise(F.col("owner")).alias("assigned_to"))
    later = rows.filter("pos > head")
    if strict:
        told = told.unionByName(_strict_phase(later, heads))
    else:
        versioned = F.col("own").isNull() & F.col("action").isin(VERSIONED)
        nodes = rows.filter(versioned & (F.col("pos") >= F.col("head")) & F.col("head_version").isNull().eqNullSafe(F.col("expected_version").isNull()))
        taken = _reached(nodes.select("exception_id", "pos", "expected_version"), heads, run_dir, least).withColumn("taken", F.lit(True))
        code = F.coalesce("own", F.when(~F.col("action").isin(VERSIONED), "INVALID_STATE"), F.when(F.col("taken").isNull(), "VERSION_CONFLICT"))
        told = told.unionByName(later.join(taken, "pos", "left").select("exception_id", "seq", "action", "pos", "assign_to", code.alias("code"),
                                                                        F.col("head_owner").alias("assigned_to")))
    told = materialize(told, "told", run_dir)
    ok = F.col("code").isNull()
    sums = told.groupBy("exception_id").agg(
        F.sum(ok.cast("long")).alias("n_accepted"), F.sum((~ok).cast("long")).alias("n_rejected"),
        F.max_by(F.when(ok, F.col("action")), F.when(ok, F.col("pos"))).alias("last"),
        F.max_by(F.struct("assign_to"), F.when(ok & (F.col("action") == "assign"), F.col("pos"))).alias("given"))
    none = F.lit(0).cast("long")
    state = exc.select("exception_id", "status", "version", "assigned_to").join(sums, "exception_id", "left").select(
        "exception_id", F.when(F.col("last").isNotNull(), new_status(F.col("last"))).otherwise(F.col("status")).alias("status"),
        (F.col("version").cast("long") + F.coalesce("n_accepted", none)).alias("version"),
        F.when(F.col("given").isNotNull(), F.col("given.assign_to")).otherwise(F.col("assigned_to")).alias("assigned_to"),
        F.coalesce("n_accepted", none).alias("n_accepted"), F.coalesce("n_rejected", none).alias("n_rejected"))
    return state, told.select("exception_id", "seq", "action", "code", "assigned_to")
