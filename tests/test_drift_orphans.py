"""Schema drift and orphan references, against brute force."""

import datetime as dt
import random

from weftline.operators import drift, orphans
from weftline.operators.keys import resolve_values, with_keys

T0 = dt.datetime(2024, 1, 1)


def test_lattice():
    assert drift.join_types(["int", "float"]) == "float" and drift.join_types(["int", "date"]) == "string"
    assert drift.join_types([None, "date", "timestamp"]) == "timestamp" and drift.join_types([None]) is None and drift.join_types(["odd"]) == "string"


def brute_changes(files, cols):
    out = set()
    series = {}
    for f, s, p in set(files):
        series.setdefault(s, {})[p] = f
    for s, by in series.items():
        ps = sorted(by)
        for a, b in zip(ps, ps[1:]):
            old = {k: (c, n, t) for c, f, k, n, t, _ in cols if f == by[a]}
            new = {k: (c, n, t) for c, f, k, n, t, _ in cols if f == by[b]}
            out |= {(by[b], "added", new[k][0]) for k in new.keys() - old.keys()}
            out |= {(by[b], "removed", old[k][0]) for k in old.keys() - new.keys()}
            for k in old.keys() & new.keys():
                if old[k][1] != new[k][1]:
                    out.add((by[b], "renamed", new[k][0]))
                if old[k][2] != new[k][2]:
                    out.add((by[b], "retyped", new[k][0]))
    return out


def test_changes_are_brute_force(spark):
    rng = random.Random(2)
    files, cols, c = [], [], 0
    for s in range(6):
        for p in rng.sample(range(700), 12):
            f = len(files)
            files.append((f, s, p))
            for k in rng.sample("abcdefg", rng.randint(0, 6)):
                c += 1
                cols.append((c, f, k, k + rng.choice(["", "x"]), rng.choice(["int", "date", None]), str(c)))
    fs = spark.createDataFrame(files + files[:5], "file_id bigint, series_id bigint, period_no int")
    cs = spark.createDataFrame(cols, "column_id bigint, file_id bigint, key string, name string, data_type string, position string")
    got = {(r.file_id, r.change_kind, r.column_id) for r in drift.changes(fs, cs).collect()}
    assert got == brute_changes(files, cols)
    u = {(r.series_id, r.key): r.data_type for r in drift.union_schema(cs.join(fs.distinct(), "file_id")).collect()}
    for s in range(6):
        for k in "abcdefg":
            kinds = [t for _, f, key, _, t, _ in cols if key == k and files[f][1] == s]
            if kinds:
                assert u[s, k] == drift.join_types(kinds)
    assert drift.changes(fs.limit(0), cs.limit(0)).count() == 0


def test_repeated_keys_pair_by_name(spark):
    fs = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 1), (4, 1, None)], "file_id bigint, series_id bigint, period_no int")
    cs = spark.createDataFrame([(1, 1, "t", "a", "int", "1"), (2, 1, "t", "b", "int", "2"), (3, 2, "t", "b", "int", "1"), (4, 2, "t", "c", "int", "2"), (5, 2, "t", "d", None, "3")], "column_id bigint, file_id bigint, key string, name string, data_type string, position string")
    got = {(r.change_kind, r.column_id) for r in drift.changes(fs, cs).collect()}
    assert got == {("renamed", 4), ("added", 5)}


def test_files(spark, tmp_path):
    spark.range(3).selectExpr("id as a", "cast(id as string) as b").coalesce(1).write.parquet(str(tmp_path / "1"))
    spark.range(2).selectExpr("id / 2 as A2", "id as c").coalesce(1).write.parquet(str(tmp_path / "2"))
    (tmp_path / "3.csv").write_text("a,b\n7,x\n")
    paths = [*map(str, tmp_path.glob("1/*.parquet")), *map(str, tmp_path.glob("2/*.parquet")), str(tmp_path / "3.csv")]
    table, log = drift.read_drifting(spark, paths, {"A2": "a"})
    assert dict(table.dtypes)["a"] == "string" and table.count() == 6
    kinds = {(r.file_id, r.change_kind, r.key) for r in log.collect()}
    assert kinds == {(1, "removed", "b"), (1, "added", "c"), (1, "renamed", "a"), (1, "retyped", "a"), (2, "added", "b"), (2, "removed", "c"), (2, "renamed", "a"), (2, "retyped", "a")}


def test_keys(spark):
    terms = [(1, "net_amount", ["montant_net"]), (2, "order_date", None)]
    df = spark.createDataFrame([("Montant Net",), ("odd",), (None,), ("order_date",), ("odd",)], "name string")
    keys = sorted((r.name or "", r.key) for r in with_keys(df, terms, "name").collect())
    assert keys == [("", "n"), ("Montant Net", "t1"), ("odd", "nodd"), ("odd", "nodd"), ("order_date", "t2")]
    assert resolve_values(df.toDF("value"), terms).count() == 3


def test_orphans_are_brute_force_in_any_batches(spark):
    rng = random.Random(3)
    day = lambda: T0 + dt.timedelta(days=rng.randint(0, 90))
    parents = []
    for _ in range(60):
        since = day()
        parents.append((rng.randint(1, 2), rng.randint(1, 12), since, since + dt.timedelta(days=rng.randint(1, 40)) if rng.random() < 0.6 else None))
    refs = [(n, rng.choice([1, 2, None]), rng.choice([*range(1, 15), None]), day()) for n in range(120)]
    lives = lambda s, k, t: any(p[0] == s and p[1] == k and p[2] <= t and (p[3] is None or p[3] > t) for p in parents)
    want = {r[0] for r in refs if not lives(r[1], r[2], r[3])}
    R, P = "ref_id bigint, scope bigint, key bigint, at timestamp_ntz", "scope bigint, key bigint, since timestamp_ntz, until timestamp_ntz"
    rs, ps = spark.createDataFrame(refs + refs[:7], R), spark.createDataFrame(parents + parents[:7], P)
    one = orphans.advance(orphans.empty(rs), rs, ps)
    opened = lambda s: {r.ref_id for r in s.log.where("event = 'opened'").select("ref_id").collect()}
    assert opened(one) == want
    state, before = orphans.empty(spark.createDataFrame([], R)), dt.datetime(2000, 1, 1)
    for cut in (T0 + dt.timedelta(days=30), T0 + dt.timedelta(days=61), dt.datetime(2030, 1, 1)):
        mine = lambda xs, k: [x for x in xs if before < x[k] <= cut]  # noqa: B023, E731
        state = orphans.advance(state, spark.createDataFrame(mine(refs, 3), R), spark.createDataFrame(mine(parents, 2), P), cut)
        before = cut
        now = {r[0] for r in refs if r[3] <= cut and not lives(r[1], r[2], cut)}
        assert {r.ref_id for r in state.pending.collect()} == now
    assert opened(state) == want
    c = orphans.counts(state.log, "refs").collect()
    assert sum(r.opened for r in c) == len(want) and any(r.resolved for r in c) and any(r.reopened for r in c)
    assert orphans.advance(orphans.empty(rs), rs.limit(0), ps.limit(0)).log.count() == 0
    assert len(opened(orphans.advance(orphans.empty(rs), rs, ps.limit(0)))) == 120


def test_orphan_events_are_brute_force_in_any_batches(spark):
    rng = random.Random(5)
    at = lambda n: T0 + dt.timedelta(days=n)
    parents = [(1, rng.randint(1, 9), at(a), rng.choice([None, at(a + rng.randint(0, 12))])) for a in (rng.randint(0, 60) for _ in range(45))]
    parents += [(1, 20, at(0), at(5)), (1, 21, at(0), at(20)), (1, 21, at(30), None), (1, 22, at(0), at(20)), (1, 22, at(20), at(40))]
    refs = [(n, 1, rng.randint(1, 9), at(rng.randint(0, 60))) for n in range(60)] + [(100, 1, 20, at(9)), (101, 1, 21, at(9)), (102, 1, 22, at(9))]
    lives = lambda k, t: any(p[1] == k and p[2] <= t and (p[3] is None or p[3] > t) for p in parents)
    want = set()
    for r, _, k, t in refs:
        days = [d for d in map(at, range(90)) if d >= t]
        if not lives(k, t):
            want.add((r, t, "opened"))
        for a, b in zip(days, days[1:]):
            if lives(k, a) != lives(k, b):
                want.add((r, b, "resolved" if lives(k, b) else "reopened"))
    assert {(101, at(20), "reopened"), (101, at(30), "resolved"), (102, at(40), "reopened"), (100, at(9), "opened")} <= want
    R, P = "ref_id bigint, scope bigint, key bigint, at timestamp_ntz", "scope bigint, key bigint, since timestamp_ntz, until timestamp_ntz"
    events = lambda s: sorted((r.ref_id, r.at, r.event) for r in s.log.collect())
    assert events(orphans.advance(orphans.empty(spark.createDataFrame(refs, R)), spark.createDataFrame(refs, R), spark.createDataFrame(parents, P))) == sorted(want)
    state, before = orphans.empty(spark.createDataFrame([], R)), dt.datetime(2000, 1, 1)
    again = [(102, 1, 22, at(45))]  # delivered again, with no parent alive
    for cut in (at(20), at(41), dt.datetime(2030, 1, 1)):
        mine = lambda xs, k: [x for x in xs if before < x[k] <= cut]  # noqa: B023, E731
        state = orphans.advance(state, spark.createDataFrame(mine(refs + again, 3), R), spark.createDataFrame(mine(parents, 2), P), cut)
        before = cut
    assert events(state) == sorted(want)
    replayed = orphans.replay(spark.createDataFrame(refs + again, R), spark.createDataFrame(parents, P))
    assert events(replayed) == sorted(want)
    assert {r.ref_id for r in replayed.pending.collect()} == {r[0] for r in refs if not lives(r[2], dt.datetime(2099, 1, 1))}
    # a state that has lost an event would not resolve it: the pending ones come from the log alone
    assert orphans.replay(spark.createDataFrame([], R), spark.createDataFrame(parents, P)).log.count() == 0
