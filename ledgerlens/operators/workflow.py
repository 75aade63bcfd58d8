"""Ordered per-key state machines and notifications.

The reference applies these one request at a time under row locks.  Here a
log of events is replayed per key: events are grouped by key, sorted by
their sequence, and folded with the SQL ``aggregate`` higher-order
function -- JVM-side, no Python.  What one task folds is bounded: a login
history is cut into blocks, and a workflow history of more than
``LONGEST_FOLD`` actions goes to ``long_replay``; the shuffle itself spreads keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.operators.running import Pieces
from ledgerlens.session import materialize, new_run_dir

# ---------------------------------------------------------------------------
# J5 workflow replay
# ---------------------------------------------------------------------------

NEW_STATUS = {"assign": "ASSIGNED", "start": "IN_PROGRESS", "resolve": "RESOLVED",
              "approve": "APPROVED", "close": "CLOSED"}
#: Actions that are checked against the version; the first accepted one ends the open phase.
VERSIONED = ["resolve", "approve", "close"]
#: A longer history is replayed by ``long_replay``, not folded in one task.
LONGEST_FOLD = 4096


# strict mode: the status an action requires (the reference checks only the version)
STRICT_FROM = {"resolve": ["ASSIGNED", "IN_PROGRESS"], "approve": ["RESOLVED"], "close": ["APPROVED"]}


def own_code(a) -> Column:
    """Why an action (columns by name) is rejected whatever the state is, else NULL."""
    act, role = a["action"], a["actor_role"]
    # a missing role may do nothing
    approver = F.coalesce(role.isin(S.APPROVER_ROLES), F.lit(False))
    worker = F.coalesce(role.isin(S.WORKER_ROLES), F.lit(False))
    note_ok = F.coalesce(F.length(F.trim(a["note"])), F.lit(0)) >= S.RESOLUTION_NOTE_MIN
    return (F.when(act.isin("assign", "approve", "close"), F.when(~approver, "FORBIDDEN"))
            .when(act == "start", F.when(~worker, "FORBIDDEN"))
            .when(act == "resolve", F.when(~worker, "FORBIDDEN").when(~note_ok, "VALIDATION"))
            .otherwise(F.lit("UNKNOWN_ACTION")))


def state_code(st, a, strict: bool = False) -> Column:
    """Why an action that is right by itself is rejected in state ``st``, else NULL."""
    act = a["action"]
    # a missing version is never the current one
    stale = ~st["version"].eqNullSafe(a["expected_version"])
    code = (F.when(act == "assign", F.when(st["status"].isin(S.NO_REASSIGN_STATUSES), "INVALID_STATE"))
            .when(act == "start", F.when(F.coalesce(st["assigned_to"] != a["actor"], F.lit(True)) | (st["status"] != "ASSIGNED"), "INVALID_STATE"))
            .when(act.isin(VERSIONED), F.when(stale, "VERSION_CONFLICT")))
    if not strict:
        return code
    wrong = F.lit(False)
    for action, allowed in STRICT_FROM.items():
        wrong = wrong | ((act == action) & ~st["status"].isin(allowed))
    return F.coalesce(code, F.when(wrong, F.lit("INVALID_STATE")))


def reject_code(st, a, strict: bool = False) -> Column:
    """NULL when the action is accepted in state ``st``, else the reason."""
    return F.coalesce(own_code(a), state_code(st, a, strict))


def new_status(act: Column) -> Column:
    e = F.lit(None).cast("string")
    for k, v in NEW_STATUS.items():
        e = F.when(act == k, F.lit(v)).otherwise(e)
    return e


def replay_workflow(exc: DataFrame, actions: DataFrame, strict: bool = False, longest: int = LONGEST_FOLD,
                    run_dir: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(final state, per-action outcomes); the rules are told at ``fold_workflow``.

    A history of up to ``longest`` actions is folded, longer ones are replayed
    by windows and pointer doubling (``long_replay``), so no list is longer."""
    from ledgerlens.operators.long_replay import long_replay
    run_dir = run_dir or new_run_dir(exc.sparkSession, "workflow")
    actions = actions.filter(F.col("exception_id").isNotNull())
    counts = actions.groupBy("exception_id").agg(F.count(F.lit(1)).alias("n"))
    long = materialize(counts.filter(F.col("n") > longest).select("exception_id"), "long", run_dir)
    if long.isEmpty():
        return fold_views(materialize(fold_workflow(exc, actions, strict), "folded", run_dir))
    short = fold_workflow(exc.join(long, "exception_id", "left_anti"), actions.join(long, "exception_id", "left_anti"), strict)
    folded = fold_views(materialize(short, "folded", run_dir))
    replayed = long_replay(exc.join(long, "exception_id", "left_semi"), actions.join(long, "exception_id", "left_semi"), strict, run_dir)
    return folded[0].unionByName(replayed[0]), folded[1].unionByName(replayed[1])


def fold_workflow(exc: DataFrame, actions: DataFrame, strict: bool = False) -> DataFrame:
    """(exceptions(exception_id, status, version, assigned_to), actions(exception_id,
    seq, action, actor, actor_role, expected_version, assign_to, note))
    -> (final state per exception, outcome of every action: code NULL when
    accepted, and the assignee in force after it).

    Rules: assign needs APPROVER/ADMIN and a status before RESOLVED; start
    needs the assignee and status ASSIGNED; resolve needs a note of 5+
    characters and the expected version; approve/close need APPROVER/ADMIN
    and the expected version (the status is not checked, as in the
    reference; ``strict=True`` also requires resolve from ASSIGNED/IN_PROGRESS,
    approve from RESOLVED and close from APPROVED).  AUDITORs may do nothing.
    Every accepted action adds 1 to the version.
    """
    # what doesn't depend on the state is decided before the fold (last in the
    # struct: it adds nothing to the order)
    acts = actions.withColumn("own", own_code(actions)).select("exception_id", F.struct(
        F.col("seq").cast("long").alias("seq"), "action", "actor", "actor_role",
        F.col("expected_version").cast("int").alias("expected_version"), "assign_to", "note", "own").alias("a"))
    per = acts.groupBy("exception_id").agg(F.sort_array(F.collect_list("a")).alias("acts"))
    init = exc.select("exception_id", F.struct(
        F.col("status"), F.col("version").cast("int").alias("version"), F.col("assigned_to"),
        F.lit(0).alias("accepted"),
        F.array().cast("array<struct<seq:bigint,action:string,code:string,assigned_to:string>>")
        .alias("out")).alias("s0"))

    def once(c, f):
        """``f`` of the column: a lambda's argument is worked out once, a column wherever it stands."""
        return F.transform(F.array(c), f)[0]

    def step(st, a):
        def told(status, version, assignee, accepted, code):
            out = F.struct(a["seq"].alias("seq"), a["action"].alias("action"), code.alias("code"), assignee.alias("assigned_to"))
            return F.struct(status.alias("status"), version.alias("version"), assignee.alias("assigned_to"), accepted.alias("accepted"),
                            F.concat(st["out"], F.array(out)).alias("out"))

        def taken(assignee):
            return told(new_status(a["action"]), st["version"] + 1, assignee, st["accepted"] + 1, F.lit(None).cast("string"))

        def after(code):
            assignee = F.when(a["action"] == "assign", a["assign_to"]).otherwise(st["assigned_to"])
            return F.when(code.isNull(), once(assignee, taken)).otherwise(
                told(st["status"], st["version"], st["assigned_to"], st["accepted"], code))

        # a code of its own spares the look at the state
        return once(F.coalesce(a["own"], state_code(st, a, strict)), after)

    folded = (init.join(per, "exception_id", "left")
              .select("exception_id",
                      F.aggregate(F.coalesce("acts", F.array().cast(per.schema["acts"].dataType)),
                                  F.col("s0"), step).alias("s")))
    return folded.select("exception_id", "s.*")


def fold_views(folded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(final state, per-action outcomes) of a folded frame; write ``folded``
    once (``materialize``) when both views are used, so the fold runs once."""
    state = folded.select("exception_id", "status", F.col("version").cast("long").alias("version"), "assigned_to",
                          F.col("accepted").cast("long").alias("n_accepted"),
                          (F.size("out") - F.col("accepted")).cast("long").alias("n_rejected"))
    outcomes = folded.select("exception_id", F.explode("out").alias("r")).select("exception_id", "r.*")
    return state, outcomes


def rejected_actions(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.col("code").isNotNull()).select("exception_id", "seq", "action", "code")


def accepted_actions(actions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Accepted actions with the assignee in force after each of them."""
    ok = outcomes.filter(F.col("code").isNull()).select("exception_id", "seq", "assigned_to")
    return actions.join(ok, ["exception_id", "seq"])


# ---------------------------------------------------------------------------
# J6 / J7 notifications
# ---------------------------------------------------------------------------

# Notification texts (fixed values; {id} is the exception id, {type} its type).
NOTIFY = {
    "assign": ("Exception Assigned", "Exception #{id} ({type}) has been assigned to you.", "/exceptions?status=ASSIGNED"),
    "resolve": ("Exception Pending Approval", "Exception #{id} has been resolved and is waiting for your review.",
                "/exceptions?status=RESOLVED"),
    "approve": ("Exception Resolution Approved", "Your resolution for Exception #{id} has been approved.",
                "/exceptions?status=APPROVED"),
    "close": ("Exception Closed", "Exception #{id} has been closed.", "/exceptions?status=CLOSED"),
}


def _text(template: str) -> Column:
    parts = []
    rest = template
    while rest:
        i = min([p for p in (rest.find("{id}"), rest.find("{type}")) if p >= 0], default=-1)
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i > 0:
            parts.append(F.lit(rest[:i]))
        if rest.startswith("{id}", i):
            parts.append(F.col("exception_id").cast("string"))
            rest = rest[i + 4:]
        else:
            parts.append(F.col("exception_type"))
            rest = rest[i + 6:]
    return F.concat(*parts)


NOTIFY_KEY = ["exception_id", "seq", "kind"]


def approvers(users: DataFrame) -> DataFrame:
    """Live ADMIN/APPROVER user ids (the audience of resolve notifications)."""
    return (users.filter(F.col("deleted_at").isNull() & F.col("role").isin(S.APPROVER_ROLES))
            .select("user_id"))


def notification_facts(accepted: DataFrame, exc_types: DataFrame) -> DataFrame:
    """J6 as compact facts, one row per accepted action that notifies:
    assign -> the new assignee, approve/close -> the assignee (user_id set);
    resolve -> the approver role (audience 'APPROVERS', user_id NULL), i.e.
    every live ADMIN/APPROVER except the actor.  Storing the role instead of
    one row per approver keeps the table the size of the action log."""
    a = accepted.join(exc_types, "exception_id", "left")
    act = F.col("action")
    user = F.when(act == "assign", F.col("assign_to")).when(act.isin("approve", "close"), F.col("assigned_to"))
    facts = a.filter(act.isin("assign", "resolve", "approve", "close")).select(
        user.alias("user_id"), F.when(act == "resolve", F.lit("APPROVERS")).alias("audience"), "actor",
        "exception_id", F.col("seq").cast("long").alias("seq"), act.alias("kind"), "exception_type",
        F.col("acted_at").alias("created_at"))
    return facts.filter(F.col("audience").isNotNull() | F.col("user_id").isNotNull())


def render_notifications(df: DataFrame) -> DataFrame:
    """Title, message and link of notification facts (the texts are fixed
    templates of the kind)."""
    title = link = msg = F.lit(None).cast("string")
    for kind, (t, m, l) in NOTIFY.items():
        is_kind = F.col("kind") == kind
        title = F.when(is_kind, F.lit(t)).otherwise(title)
        link = F.when(is_kind, F.lit(l)).otherwise(link)
        msg = F.when(is_kind, _text(m)).otherwise(msg)
    return df.withColumn("title", title).withColumn("message", msg).withColumn("link", link)


def own_notifications(facts: DataFrame, users: DataFrame, user_id: str) -> DataFrame:
    """One user's notifications: the direct ones, and the role facts of others'
    resolves if the user is a live approver."""
    cols = ["user_id", "exception_id", "seq", "kind", "exception_type", "created_at"]
    mine = facts.filter(F.col("audience").isNull() & (F.col("user_id") == user_id)).select(*cols)
    if approvers(users).filter(F.col("user_id") == user_id).isEmpty():
        return mine
    role = facts.filter((F.col("audience") == "APPROVERS") & ~F.col("actor").eqNullSafe(F.lit(user_id)))
    return mine.unionByName(role.withColumn("user_id", F.lit(user_id)).select(*cols))


def inbox(facts: DataFrame, reads: DataFrame, users: DataFrame, user_id: str, unread_only: bool = True,
          page_no: int = 1, page_size: int = 20) -> DataFrame:
    """One page of a user's notifications, newest first, with read flags
    from the read-event log (user_id, exception_id, seq, kind); texts are
    rendered for the page only."""
    r = (reads.filter(F.col("user_id") == user_id).select(*NOTIFY_KEY).distinct()
         .withColumn("is_read", F.lit(True)))
    n = (own_notifications(facts, users, user_id)
         .join(r, NOTIFY_KEY, "left").withColumn("is_read", F.coalesce("is_read", F.lit(False))))
    if unread_only:
        n = n.filter(~F.col("is_read"))
    page = (n.orderBy(F.col("created_at").desc(), F.col("exception_id").desc(), F.col("seq").desc(), F.col("kind"))
            .offset((page_no - 1) * page_size).limit(page_size))
    return render_notifications(page)


def mark_read(facts: DataFrame, reads: DataFrame, users: DataFrame, user_id: str, only: DataFrame | None = None) -> DataFrame:
    """The read events (user_id, exception_id, seq, kind) that marking adds:
    the user's unread notifications, all of them or those in ``only``
    (exception_id, seq, kind).  What isn't the user's, or is read, adds nothing."""
    key = ["user_id", *NOTIFY_KEY]
    mine = own_notifications(facts, users, user_id).select(*key)
    if only is not None:
        mine = mine.join(only.select(*NOTIFY_KEY).distinct(), NOTIFY_KEY, "left_semi")
    return mine.join(reads.select(*key).distinct(), key, "left_anti").select(*key)


def unread_counts(facts: DataFrame, reads: DataFrame, users: DataFrame) -> DataFrame:
    """E15 on the compact facts, without expanding role facts:
    direct unread = direct facts not in the read log, per user; for each live
    approver u, role unread = all role facts - those u acted on - those u read
    (reads of own resolves do not count).  -> (user_id, unread_count > 0)."""
    direct = facts.filter(F.col("audience").isNull())
    d_unread = (direct.join(reads.select("user_id", *NOTIFY_KEY).distinct(), ["user_id"] + NOTIFY_KEY, "left_anti")
                .groupBy("user_id").agg(F.count(F.lit(1)).alias("n")))
    role = facts.filter(F.col("audience") == "APPROVERS")
    total = role.count()   # one scalar
    own = role.groupBy(F.col("actor").alias("user_id")).agg(F.count(F.lit(1)).alias("own"))
    read = (reads.select("user_id", *NOTIFY_KEY).distinct().join(role.select(*NOTIFY_KEY, "actor"), NOTIFY_KEY)
            .filter(F.col("user_id") != F.col("actor")).groupBy("user_id").agg(F.count(F.lit(1)).alias("rd")))
    r_unread = (approvers(users).join(own, "user_id", "left").join(read, "user_id", "left")
                .select("user_id", (F.lit(total) - F.coalesce("own", F.lit(0)) - F.coalesce("rd", F.lit(0)))
                        .alias("n")))
    return (d_unread.unionByName(r_unread).groupBy("user_id").agg(F.sum("n").cast("long").alias("unread_count"))
            .filter(F.col("unread_count") > 0))


# ---------------------------------------------------------------------------
# J11 idempotent request dedupe
# ---------------------------------------------------------------------------

GUARDED_METHODS = ["POST", "PATCH", "PUT"]


def guarded(log: DataFrame) -> Column:
    """Requests that the idempotency check applies to: they change something and bring a key."""
    return F.coalesce(F.col("method").isin(GUARDED_METHODS) & (F.col("idempotency_key") != ""), F.lit(False))


def request_key(log: DataFrame) -> Column:
    """sha256(user:method:path:key), null for requests that aren't ``guarded``."""
    text = F.concat(F.coalesce("user_id", F.lit("anonymous")), F.lit(":"), "method", F.lit(":"), F.coalesce("path", F.lit("")),
                    F.lit(":"), "idempotency_key")
    return F.when(guarded(log), F.sha2(text, 256))


def dedupe_requests(log: DataFrame) -> DataFrame:
    """Per key in (ts, id) order: a request while the owning request runs
    (or if that never ended) -> CONFLICT; after it finished with a status below
    500 -> REPLAYED (cached response); after a 5xx the key was cleared, so the
    request owns the key again -> FIRST.  Requests without a key, or of other
    methods, pass by -> BYPASS.

    Nothing is folded row by row: a failed owner's successor is the first
    request after it finished (a running frame over requests and finishes),
    owners are what the first request of a key reaches through successors
    (pointer doubling), and the owner in force at a request is the last one
    before it (a running frame).  -> (key_hash, request_id, outcome)
    """
    from ledgerlens.session import materialize
    ev = log.select(request_key(log).alias("key_hash"), F.col("request_id").cast("long").alias("request_id"), "ts",
                    F.greatest("finished_at", "ts").alias("done"), F.col("finished_at").isNull().alias("open"),
                    F.col("status_code").cast("int").alias("code"))
    ev = materialize(ev, "requests")
    keyed = ev.filter("key_hash is not null")
    cleared = F.coalesce((F.col("code") >= 500) & ~F.col("open"), F.lit(False))
    # requests, and for each cleared one its end; on equal times only later ids come after
    marks = (keyed.select("key_hash", F.col("ts").alias("at"), F.col("request_id").alias("id"), F.lit(0).alias("kind"), "request_id")
             .unionByName(keyed.filter(cleared).select(
                 "key_hash", F.col("done").alias("at"),
                 F.when(F.col("done") > F.col("ts"), F.lit(-2 ** 63)).otherwise(F.col("request_id")).alias("id"),
                 F.lit(1).alias("kind"), "request_id")))
    pieces = Pieces(marks, ["key_hash"], "at")
    after = pieces.last(pieces.rows, F.when(F.col("kind") == 0, F.col("request_id")), ["at", "id", "kind"], "next", descending=True, strict=True)
    jump = materialize(after.filter("kind = 1 and next is not null").select(F.col("request_id").alias("owner"), "next"), "successors")
    owners = materialize(keyed.groupBy("key_hash").agg(F.min(F.struct("ts", "request_id")).alias("m"))
                         .select(F.col("m.request_id").alias("owner")), "owners")
    while True:
        found = owners.join(jump, "owner").select(F.col("next").alias("owner"))
        if found.isEmpty():
            break
        owners = materialize(owners.unionByName(found).distinct(), "owners")
        twice = jump.alias("a").join(jump.alias("b"), F.col("a.next") == F.col("b.owner"))
        jump = materialize(twice.select(F.col("a.owner"), F.col("b.next")), "successors")
    own = keyed.join(owners.select(F.col("owner").alias("request_id"), F.lit(True).alias("is_owner")), "request_id", "left")
    pieces = Pieces(own, ["key_hash"], "ts")
    told = pieces.last(pieces.rows, F.when(F.col("is_owner"), F.struct("done", "open")), ["ts", "request_id"], "h").select(
        "key_hash", "request_id", F.when(F.col("is_owner"), "FIRST")
        .when(F.col("h.open") | (F.col("ts") < F.col("h.done")), "CONFLICT").otherwise("REPLAYED").alias("outcome"))
    return told.unionByName(ev.filter("key_hash is null").select("key_hash", "request_id", F.lit("BYPASS").alias("outcome")))


# ---------------------------------------------------------------------------
# J12 login lockout
# ---------------------------------------------------------------------------

#: Attempts of a block.
LOCKOUT_BLOCK = 4096

_AUTH_OUT = "array<struct<event_id:bigint,ts:timestamp,outcome:string,locked_until:timestamp>>"


def _lockout_fold(es, fails0, lock0, failures: int, lock_minutes: int, with_outcomes: bool):
    """Fold a sorted array of attempts from the entry state (fails0, lock0)."""
    s0 = F.struct(fails0.cast("int").alias("fails"), lock0.cast("timestamp").alias("locked_until"),
                  (F.array().cast(_AUTH_OUT) if with_outcomes else F.lit(None).cast(_AUTH_OUT)).alias("out"))

    def step(st, e):
        locked = F.coalesce(e["ts"] < st["locked_until"], F.lit(False))
        hits = ~locked & ~e["success"] & (st["fails"] + 1 >= failures)
        until = F.timestamp_add("MINUTE", F.lit(lock_minutes), e["ts"])
        outcome = F.when(locked, "REFUSED").when(e["success"], "OK").when(hits, "LOCKED").otherwise("FAILED")
        fails = F.when(locked, st["fails"]).when(e["success"] | hits, F.lit(0)).otherwise(st["fails"] + 1)
        new_until = F.when(locked, st["locked_until"]).when(hits, until).otherwise(F.lit(None).cast("timestamp"))
        out = (F.concat(st["out"], F.array(F.struct(e["event_id"].alias("event_id"), e["ts"].alias("ts"),
                                                   outcome.alias("outcome"),
                                                   F.when(hits, until).alias("locked_until"))))
               if with_outcomes else st["out"])
        return F.struct(fails.alias("fails"), new_until.alias("locked_until"), out.alias("out"))

    return F.aggregate(es, s0, step)


def login_lockouts(auth: DataFrame, failures: int = S.LOCKOUT_FAILURES,
                   lock_minutes: int = S.LOCKOUT_MINUTES, run_dir: str | None = None,
                   block: int = LOCKOUT_BLOCK) -> DataFrame:
    """Per user in (ts, event_id) order: attempts while locked are
    REFUSED and not counted; a success resets the counter (OK); a failure
    adds one (FAILED) and the Nth consecutive one locks the account for M
    minutes and resets the counter (LOCKED).  -> every attempt's outcome.

    Distributed as a chunked fold, so no task holds a user's whole history:
      1. attempts are numbered in order and cut into blocks of at most
         ``block`` attempts of one user; each is folded from all lock-free
         entry states (0..N-1 pending failures) in parallel;
      2. per user, the blocks' transitions are chained (one small summary per
         block) to find every block's true entry state;
      3. a lock set at the end of a block can reach into the next one: such
         blocks are folded again from their locked entry and the chain is
         re-run, until no block's locked entry lacks its own fold (exact, no
         cap; each round only touches the blocks that changed);
      4. every block is folded once more from its true entry, with outcomes.
    """
    from ledgerlens.session import materialize, new_run_dir, with_dense_ids
    spark = auth.sparkSession
    run_dir = run_dir or new_run_dir(spark, "lockout")
    numbered = with_dense_ids(auth.select("user_id", "ts", "event_id", "success"), ["user_id", "ts", "event_id"], "place")
    chunks = materialize(
        numbered.groupBy("user_id", F.floor(F.col("place") / block).alias("block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("ts"), F.col("event_id").cast("long").alias("event_id"),
                                                  F.col("success")))).alias("es"),
             F.min("ts").alias("first_ts")), "chunks", run_dir)
    # element f: exit state when the chunk is entered with f pending failures and no lock
    lockfree = F.array(*[_lockout_fold("es", F.lit(f), F.lit(None), failures, lock_minutes, False)
                         for f in range(failures)])
    summ = materialize(chunks.select("user_id", "block", "first_ts", lockfree.alias("t")), "transitions", run_dir)
    # corrections: (user, block, lock) -> exit state of a chunk entered while locked
    fixes = spark.createDataFrame([], "user_id string, block long, lock timestamp, fails int, locked_until timestamp")
    rnd = 0
    while True:
        rnd += 1
        entries = _chain_entries(summ, fixes)
        need = (entries.filter(F.col("entry_lock").isNotNull())
                .join(fixes.select("user_id", "block", F.col("lock").alias("entry_lock")),
                      ["user_id", "block", "entry_lock"], "left_anti"))
        if need.isEmpty():
            break
        new = (need.join(chunks, ["user_id", "block"])
               .select("user_id", "block", F.col("entry_lock").alias("lock"),
                       _lockout_fold("es", F.col("entry_fails"), F.col("entry_lock"), failures, lock_minutes,
                                     False).alias("x"))
               .select("user_id", "block", "lock", "x.fails", "x.locked_until"))
        fixes = materialize(fixes.unionByName(new), f"fixes_{rnd:03d}", run_dir)
    entries = materialize(entries, "entries", run_dir)
    res = (chunks.join(entries, ["user_id", "block"])
           .select("user_id", _lockout_fold("es", F.col("entry_fails"), F.col("entry_lock"), failures, lock_minutes,
                                            True)["out"].alias("out")))
    return res.select("user_id", F.explode("out").alias("o")).select("user_id", "o.*")


def _chain_entries(summ: DataFrame, fixes: DataFrame) -> DataFrame:
    """Per user, chain the blocks' transitions in order -> each chunk's entry
    state (entry_fails, entry_lock); a lock still running at the chunk's first
    attempt makes a locked entry (its exit comes from ``fixes`` when known)."""
    f = fixes.select("user_id", "block", F.struct(F.col("lock"), F.col("fails"), F.col("locked_until")).alias("fx"))
    f = f.groupBy("user_id", "block").agg(F.collect_list("fx").alias("fx"))
    blocks = (summ.join(f, ["user_id", "block"], "left")
            .groupBy("user_id")
            .agg(F.array_sort(F.collect_list(F.struct("block", "first_ts", "t", "fx"))).alias("ds")))
    s0 = F.struct(F.lit(0).alias("fails"), F.lit(None).cast("timestamp").alias("locked_until"),
                  F.array().cast("array<struct<block:bigint,entry_fails:int,entry_lock:timestamp>>").alias("out"))

    def step(st, d):
        locked = F.coalesce(st["locked_until"] > d["first_ts"], F.lit(False))
        lock = F.when(locked, st["locked_until"])
        fix = F.filter(F.coalesce(d["fx"], F.array().cast(
            "array<struct<lock:timestamp,fails:int,locked_until:timestamp>>")), lambda x: x["lock"] == lock)
        free = F.try_element_at(d["t"], st["fails"] + 1)
        nxt_f = F.when(locked, F.try_element_at(fix, F.lit(1))["fails"]).otherwise(free["fails"])
        nxt_l = F.when(locked, F.try_element_at(fix, F.lit(1))["locked_until"]).otherwise(free["locked_until"])
        out = F.concat(st["out"], F.array(F.struct(d["block"].alias("block"),
                                                   F.when(locked, F.lit(0)).otherwise(st["fails"]).alias("entry_fails"),
                                                   lock.alias("entry_lock"))))
        # an unknown locked fold leaves the rest of the chain unknown for this round
        return F.struct(F.coalesce(nxt_f, F.lit(0)).alias("fails"), nxt_l.alias("locked_until"), out.alias("out"))

    chained = blocks.select("user_id", F.aggregate("ds", s0, step)["out"].alias("out"))
    return chained.select("user_id", F.explode("out").alias("o")).select("user_id", "o.block", "o.entry_fails",
                                                                         "o.entry_lock")
