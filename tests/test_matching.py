"""Matching passes: the reference's tiny cases, a tie case, brute force."""
import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.config import MatchConfig
from ledgerlens.operators import matching as M
from ledgerlens.plans.reconcile import reconcile
from ledgerlens.sources.tables import match_rules

D = dt.date(2026, 7, 18)


def frames(spark, ledger, external, rules=None):
    acc = spark.createDataFrame([(1, "ACC-TEST", 1, 1, "GBP", "ACTIVE")], S.ACCOUNTS)
    led = spark.createDataFrame(
        [(i, 1, f"L{i}", "CREDIT", Decimal(a), "GBP", d, None) for i, a, d in ledger], S.LEDGER)
    ext = spark.createDataFrame(
        [(i, 1, 4, f"E{i}", "ACC-TEST", Decimal(a), "GBP", d, d, flag) for i, a, d, flag in external], S.EXTERNAL)
    return led, ext, acc, rules if rules is not None else match_rules(spark)


def test_exact_one_to_one(spark):
    r = reconcile(*frames(spark, [(1, "100.00", D)], [(10, "100.00", D, False)]))
    assert [tuple(x) for x in r.exact.select("ledger_txn_id", "ext_line_id").collect()] == [(1, 10)]
    assert r.exceptions.count() == 0


def test_tolerance_confidence(spark):
    r = reconcile(*frames(spark, [(1, "100.00", D)], [(10, "100.50", D + dt.timedelta(days=3), False)]))
    rows = r.tolerance.collect()
    assert len(rows) == 1 and rows[0].confidence_score == Decimal("80.00")
    assert r.exceptions.count() == 0


def test_tolerance_score_is_100_minus_min_20(spark):
    r = reconcile(*frames(spark, [(1, "100.00", D)], [(10, "100.50", D, False)]))
    assert r.tolerance.collect()[0].confidence_score == Decimal("80.00")


def test_batched_settlement(spark):
    led = [(1, "10.00", D), (2, "20.00", D), (3, "30.00", D)]
    r = reconcile(*frames(spark, led, [(10, "60.00", D, True)]))
    assert sorted(x.ledger_txn_id for x in r.batched.collect()) == [1, 2, 3]
    assert r.groups.count() == 1 and r.exceptions.count() == 0


def test_end_to_end_two_exceptions(spark):
    r = reconcile(*frames(spark, [(1, "200.00", D)], [(10, "150.00", D, False)]))
    assert sorted(x.exception_type for x in r.exceptions.collect()) == ["MISSING_EXTERNAL", "MISSING_INTERNAL"]


def test_one_round_mutual_best_tie(spark):
    led = [(1, "50.00", D), (2, "50.00", D)]
    ext = [(10, "50.00", D, False), (11, "50.00", D, False)]
    r = reconcile(*frames(spark, led, ext))
    assert [tuple(x) for x in r.exact.select("ledger_txn_id", "ext_line_id").collect()] == [(1, 10)]
    assert [tuple(x) for x in r.tolerance.select("ledger_txn_id", "ext_line_id").collect()] == [(2, 11)]


def test_no_tolerance_rule_no_matches(spark):
    rules = match_rules(spark).filter(F.col("rule_type") != "TOLERANCE")
    r = reconcile(*frames(spark, [(1, "100.00", D)], [(10, "100.50", D, False)], rules))
    assert r.tolerance.count() == 0 and r.exceptions.count() == 2


def _brute_mutual(led, ext, key):
    """Direct form: all candidate pairs, rank per side, keep 1/1."""
    pairs = [(l, e, key(l, e)) for l in led for e in ext if key(l, e) is not None]
    best_l = {}
    best_e = {}
    for l, e, k in pairs:
        if l[0] not in best_l or (k, e[0]) < best_l[l[0]][0]:
            best_l[l[0]] = ((k, e[0]), e[0])
        if e[0] not in best_e or (k, l[0]) < best_e[e[0]][0]:
            best_e[e[0]] = ((k, l[0]), l[0])
    return sorted((l, e) for l, (_, e) in best_l.items() if best_e[e][1] == l)


def test_exact_and_tolerance_match_brute_force(spark):
    rnd = random.Random(7)
    base = dt.date(2024, 1, 1)
    led = [(i, 1, f"{rnd.choice([10, 11, 12, 100])}.{rnd.choice(['00', '05', '50'])}",
            base + dt.timedelta(days=rnd.randint(0, 6))) for i in range(1, 60)]
    ext = [(100 + i, 1, f"{rnd.choice([10, 11, 12, 100])}.{rnd.choice(['00', '05', '50', '10'])}",
            base + dt.timedelta(days=rnd.randint(0, 6))) for i in range(1, 60)]
    L = spark.createDataFrame([(i, a, "GBP", Decimal(x), d) for i, a, x, d in led],
                              "ledger_txn_id long, account_id long, currency string, amount decimal(18,2), value_date date")
    E = spark.createDataFrame([(i, a, "GBP", Decimal(x), d, False) for i, a, x, d in ext],
                              "ext_line_id long, account_id long, currency string, amount decimal(18,2), "
                              "value_date date, is_batched_settlement boolean")
    got = sorted(tuple(r) for r in M.exact_matches(L, E, 2).select("ledger_txn_id", "ext_line_id").collect())
    want = _brute_mutual(led, ext, lambda l, e: abs((l[3] - e[3]).days)
                         if Decimal(l[2]) == Decimal(e[2]) and abs((l[3] - e[3]).days) <= 2 else None)
    assert got == want
    rule = match_rules(spark).filter(F.col("rule_type") == "TOLERANCE")
    got_t = sorted(tuple(r) for r in M.tolerance_matches(L, E, rule).select("ledger_txn_id", "ext_line_id").collect())

    def tkey(l, e):
        d = abs(Decimal(l[2]) - Decimal(e[2]))
        return d if d <= Decimal(l[2]) * Decimal("0.01") and abs((l[3] - e[3]).days) <= 3 else None
    assert got_t == _brute_mutual(led, ext, tkey)


def _greedy_batches(led, lines):
    """The reference's application loop over running-sum candidates."""
    used, groups = set(), []
    for ext_id, acct, total in sorted(lines):
        rows = sorted((d, i, a) for i, ac, a, d in led if ac == acct)
        run, cands = Decimal(0), []
        for d, i, a in rows:
            run += a
            if run <= total:
                cands.append((i, a))
        s, subset = Decimal(0), []
        for i, a in cands:
            if i in used:
                continue
            s += a
            subset.append(i)
            if s == total:
                groups.append((ext_id, tuple(subset)))
                used.update(subset)
                break
            if s > total:
                break
    return sorted((e, i) for e, ids in groups for i in ids)


def test_batched_matches_brute_force(spark):
    rnd = random.Random(11)
    base = dt.date(2024, 1, 1)
    for trial in range(3):
        led = [(i, rnd.randint(1, 4), Decimal(rnd.randint(1, 9)), base + dt.timedelta(days=rnd.randint(0, 3)))
               for i in range(1, 40)]
        lines = []
        for k in range(1, 12):
            acct = rnd.randint(1, 4)
            rows = sorted((d, i, a) for i, ac, a, d in led if ac == acct)
            n = rnd.randint(1, max(1, len(rows)))
            total = sum(a for _, _, a in rows[:n]) + (Decimal(rnd.choice([0, 0, 1])))
            lines.append((1000 + k, acct, total))
        L = spark.createDataFrame([(i, a, "GBP", x, d) for i, a, x, d in led],
                                  "ledger_txn_id long, account_id long, currency string, amount decimal(18,2), "
                                  "value_date date")
        E = spark.createDataFrame([(e, a, "GBP", t, base, True) for e, a, t in lines],
                                  "ext_line_id long, account_id long, currency string, amount decimal(18,2), "
                                  "value_date date, is_batched_settlement boolean")
        got = sorted(tuple(r) for r in M.batch_matches(L, E).collect())
        assert got == _greedy_batches(led, lines), trial


def test_running_totals_chunked_equals_single_window(spark):
    from pyspark.sql import Window
    rnd = random.Random(3)
    base = dt.date(2024, 1, 1)
    rows = [(rnd.randint(0, 5000), rnd.randint(1, 3), Decimal(rnd.randint(1, 999)) / 100,
             base + dt.timedelta(days=rnd.randint(0, 4))) for _ in range(400)]
    rows = list({r[0]: r for r in rows}.values())
    L = spark.createDataFrame(rows, "ledger_txn_id long, account_id long, amount decimal(18,2), value_date date")
    got = {r.ledger_txn_id: r.running_total for r in M.running_totals(L, chunk_bits=6).collect()}
    w = Window.partitionBy("account_id").orderBy("value_date", "ledger_txn_id").rowsBetween(
        Window.unboundedPreceding, 0)
    want = {r.ledger_txn_id: r.rt for r in L.withColumn("rt", F.sum("amount").over(w)).collect()}
    assert got == want


def test_scoped_run_uses_run_date_and_batch(spark):
    acc = spark.createDataFrame([(1, "ACC-TEST", 1, 1, "GBP", "ACTIVE")], S.ACCOUNTS)
    d1, d2 = D, D + dt.timedelta(days=1)
    led = spark.createDataFrame([(1, 1, "L1", "CREDIT", Decimal("10.00"), "GBP", d1, None),
                                 (2, 1, "L2", "CREDIT", Decimal("20.00"), "GBP", d2, None)], S.LEDGER)
    ext = spark.createDataFrame([
        (10, 7, 4, "E10", "ACC-TEST", Decimal("10.00"), "GBP", d2, d2, False),   # batch 7, next day: matches L1
        (11, 8, 4, "E11", "ACC-TEST", Decimal("10.00"), "GBP", d1, d1, False),   # other batch: ignored
        (12, 7, 4, "E12", "ACC-TEST", Decimal("99.00"), "GBP", d1, d1, False),   # batch 7, run date: MISSING_INTERNAL
        (13, 7, 4, "E13", "ACC-TEST", Decimal("98.00"), "GBP", d2, d2, False),   # batch 7, other date: no exception
    ], S.EXTERNAL)
    r = reconcile(led, ext, acc, match_rules(spark), MatchConfig(run_date=d1, batch_id=7))
    assert [tuple(x) for x in r.exact.select("ledger_txn_id", "ext_line_id").collect()] == [(1, 10)]
    assert [(x.ext_line_id, x.exception_type) for x in r.exceptions.collect()] == [(12, "MISSING_INTERNAL")]
    run = r.run.collect()[0]
    assert (run.total_internal, run.total_external, run.matched_count, run.exception_count) == (1, 1, 1, 1)


def test_two_rounds_of_mutual_best(spark):
    led = [(1, "50.00", D), (2, "50.00", D)]
    ext = [(10, "50.00", D, False), (11, "50.00", D, False)]
    r = reconcile(*frames(spark, led, ext), MatchConfig(rounds=2))
    assert sorted(tuple(x) for x in r.exact.select("ledger_txn_id", "ext_line_id").collect()) == [(1, 10), (2, 11)]
    assert r.tolerance.count() == 0 and r.exceptions.count() == 0


def test_rules_from_config_and_classified_breaks(spark):
    from decimal import Decimal as Dd
    led, ext, acc, _ = frames(spark, [(1, "100.00", D), (2, "300.00", D)],
                              [(10, "100.50", D, False), (11, "200.00", D, False)])
    none = reconcile(led, ext, acc, None, MatchConfig())
    assert none.tolerance.count() == 0 and none.exceptions.count() == 4
    cfg = MatchConfig(tolerance=Dd("0.01"), tolerance_window_days=3, classify_breaks=True)
    r = reconcile(led, ext, acc, None, cfg)
    assert [tuple(x) for x in r.tolerance.select("ledger_txn_id", "ext_line_id").collect()] == [(1, 10)]
    kinds = {(x.ledger_txn_id, x.ext_line_id): (x.exception_type, x.amount_diff) for x in r.exceptions.collect()}
    assert kinds == {(2, None): ("AMOUNT_MISMATCH", Dd("100.00")), (None, 11): ("AMOUNT_MISMATCH", Dd("100.00"))}


def test_tolerance_dense_brute_force(spark):
    rnd = random.Random(21)
    base = dt.date(2024, 1, 1)
    led = [(i, rnd.randint(1, 2), rnd.choice(["GBP", "EUR"]), Decimal(rnd.randint(9900, 10100)) / 100,
            base + dt.timedelta(days=rnd.randint(0, 5))) for i in range(1, 120)]
    ext = [(1000 + i, rnd.randint(1, 2), rnd.choice(["GBP", "EUR"]), Decimal(rnd.randint(9900, 10100)) / 100,
            base + dt.timedelta(days=rnd.randint(0, 5))) for i in range(1, 120)]
    L = spark.createDataFrame(led, "ledger_txn_id long, account_id long, currency string, amount decimal(18,2), "
                                   "value_date date")
    E = spark.createDataFrame([r + (False,) for r in ext],
                              "ext_line_id long, account_id long, currency string, amount decimal(18,2), "
                              "value_date date, is_batched_settlement boolean")
    for tol, win in (("0.0100", 3), ("0.0000", 2), ("0.0500", 1), ("1.5000", 2)):
        rule = spark.createDataFrame([(tol, win)], "t string, w int").select(
            F.col("t").cast("decimal(6,4)").alias("amount_tolerance"), F.col("w").alias("date_window_days"))
        got = sorted(tuple(r) for r in
                     M.tolerance_matches(L, E, rule).select("ledger_txn_id", "ext_line_id").collect())

        def key(l, e, tol=Decimal(tol), win=win):
            if l[1] != e[1] or l[2] != e[2] or abs((l[4] - e[4]).days) > win:
                return None
            d = abs(l[3] - e[3])
            return d if d <= l[3] * tol else None
        want = _brute_mutual(led, ext, key)
        assert got == want, tol


def test_exact_windows_across_blocks_of_days(spark):
    """Repeated amounts on many days (before 1970 as well), equal keys and null dates: as comparing all pairs finds them."""
    import datetime as dt
    import random
    from ledgerlens.operators import matching as M
    rnd = random.Random(5)
    schema = "{} long, account_id long, currency string, amount decimal(18,2), value_date date"
    days = [dt.date(1969, 11, 1) + dt.timedelta(days=k) for k in range(130)] + [None]
    side = lambda n: [(i, rnd.randrange(2), "GBP", rnd.choice([5, 6]), rnd.choice(days)) for i in range(n)]
    led, ext = side(150), side(140)
    from decimal import Decimal
    frame = lambda rows, key: spark.createDataFrame([(i, a, c, Decimal(m), d) for i, a, c, m, d in rows], schema.format(key))
    for window in (0, 2, 20):
        near = [(abs((l[4] - e[4]).days), l[0], e[0]) for l in led for e in ext if l[4] and e[4] and l[1:4] == e[1:4] and abs((l[4] - e[4]).days) <= window]
        best_l = {l: min((d, e) for d, k, e in near if k == l) for _, l, _ in near}
        best_e = {e: min((d, l) for d, l, k in near if k == e) for _, _, e in near}
        want = sorted((l, e, d) for l, (d, e) in best_l.items() if best_e[e] == (d, l))
        got = M.exact_matches(frame(led, "ledger_txn_id"), frame(ext, "ext_line_id"), window)
        assert sorted((r.ledger_txn_id, r.ext_line_id, r.day_diff) for r in got.collect()) == want


def test_tolerance_probes_only_dates_of_the_other_side(spark, monkeypatch):
    """A run date's ledger is of one date: lines probe that one, not all seven of their window."""
    import datetime as dt
    import decimal
    from ledgerlens.operators import matching as M
    d, money = dt.date(2024, 3, 10), lambda x: decimal.Decimal(x).scaleb(-2)
    side = "{} long, account_id long, currency string, amount decimal(18,2), value_date date"
    led = [(i, i % 3, "EUR", money(10000 + 7 * i), d) for i in range(20)]
    ext = [(100 + i, i % 3, "EUR", money(10000 + 7 * i + 30), d + dt.timedelta(days=i % 5 - 2)) for i in range(20)]
    probed, nearest = [], M._nearest

    def counted(probes, *args):
        probed.append(probes.count())
        return nearest(probes, *args)

    monkeypatch.setattr(M, "_nearest", counted)
    rule = spark.createDataFrame([(2, decimal.Decimal("0.0100"), 3)], "rule_id int, amount_tolerance decimal(6,4), date_window_days int")
    got = M.tolerance_matches(spark.createDataFrame(led, side.format("ledger_txn_id")), spark.createDataFrame(ext, side.format("ext_line_id")), rule).collect()
    assert probed == [20 * 5, 20]  # five dates of lines, one of the ledger
    cand = [(abs(a - b), i, e, abs((x - y).days)) for i, c, _, a, x in led for e, f, _, b, y in ext
            if c == f and abs((x - y).days) <= 3 and abs(a - b) <= a * decimal.Decimal("0.01")]
    best_l = {i: min((g, e) for g, k, e, _ in cand if k == i) for _, i, _, _ in cand}
    best_e = {e: min((g, i) for g, i, k, _ in cand if k == e) for _, _, e, _ in cand}
    want = {(i, e, g) for i, (g, e) in best_l.items() if best_e[e][1] == i}
    assert {(r.ledger_txn_id, r.ext_line_id, r.amount_diff) for r in got} == want and want
