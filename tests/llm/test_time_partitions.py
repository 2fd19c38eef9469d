import datetime as dt
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from stillwater.llm import time_partitions as T

CUT = dt.datetime(2024, 3, 1)


def moment(ts, i):
    if ts is None or i is None:
        return ts
    k = zlib.crc32(str(i).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    return dt.datetime.combine(ts.date() - dt.timedelta(days=ts.weekday()), dt.time()) if k > 111 else ts


def children(name):
    if name.count("/") == 0:
        return [f"{name}/{m:02}" for m in range(1, 13)]
    if name.count("/") == 1:
        y, m = map(int, name.split("/"))
        return [f"{name}/{d:02}" for d in range(1, 32) if d <= (dt.date(y + m // 12, m % 12 + 1, 1) - dt.timedelta(1)).day]
    return [f"{name}/{h:02}" for h in range(24)]


def layout(rows, limit):
    """leaf -> rows in order, by the rules, in plain Python."""
    by, null, fmt = defaultdict(list), [], ("%Y", "%Y/%m", "%Y/%m/%d", "%Y/%m/%d/%H")
    for r in rows:
        m = moment(r[1], r[0])
        if m is None:
            null.append(r)
        else:
            for f in fmt:
                by[m.strftime(f)].append(r)
    years = [int(k) for k in by if len(k) == 4]
    out = {}

    def group(siblings):
        run = None
        for s in siblings:
            n = len(by[s])
            if n > limit:
                run = None
                if s.count("/") == 3:
                    out[f"{s}-{s[-2:]}"] = list(by[s])
                else:
                    group(children(s))
            elif run is not None and len(out[run]) + n <= limit:
                longer = f"{run.rpartition('-')[0]}-{s.rpartition('/')[2]}"
                out[longer] = out.pop(run) + by[s]
                run = longer
            else:
                run = f"{s}-{s.rpartition('/')[2]}"
                out[run] = list(by[s])

    if years:
        group([f"{y:04}" for y in range(min(years), max(years) + 1)])
    if null:
        out["null"] = null
    last = dt.datetime(9999, 1, 1)
    order = lambda r: (moment(r[1], r[0]) or last, r[2] is None, r[2] or last, r[0] is None, r[0] or 0)
    return {k: sorted(v, key=order) for k, v in out.items() if v}


def expected(rows, limit):
    files = lambda rows: {(leaf, p + 1): v[p * limit : (p + 1) * limit] for leaf, v in layout(rows, limit).items() for p in range(-(-len(v) // limit))}
    old = lambda r: r[2] is not None and r[2] < CUT
    start, final = files([r for r in rows if old(r)]), files(rows)
    out = set()
    for (leaf, part), v in final.items():
        sha = hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in v).encode()).hexdigest()
        stays = (leaf, part) in start and Counter(map(repr, start[leaf, part])) == Counter(map(repr, v))
        out.add((leaf, part, len(v), sum(not old(r) for r in v), not stays, sha))
    return out


def on_disk(spark, got):
    """Each listed file holds the rows that it says, and the folder holds no others."""
    root = got[0].path.removeprefix("file:").replace("//", "/").rsplit("/", 2)[0]
    files = {str(p) for p in __import__("pathlib").Path(root).rglob("*.parquet")}
    assert files == {r.path.removeprefix("file:").replace("//", "/") for r in got}
    for r in got:
        t = pq.read_table(r.path.removeprefix("file:"), partitioning=None)
        assert ",".join(t.column_names) == r.columns and t.num_rows == r.n_rows
        ids = ",".join("" if i is None else str(i) for i in t.column("click_id").to_pylist())
        assert hashlib.sha256(ids.encode()).hexdigest() == r.ids_sha256


def listed(got):
    return {(r.leaf, r.part, r.n_rows, r.n_new, r.rewritten, r.ids_sha256) for r in got}


def test_clicks(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/clicks.parquet")
    rows = [(r.click_id, r.ts, r.arrived_at, *r[3:]) for r in table.collect()]
    got = T.partitioned_twice(table).collect()
    assert listed(got) == expected(rows, 1 + len(rows) // 650) and len({r.path for r in got}) == len(got)
    assert any(r.rewritten for r in got) and any(not r.rewritten for r in got) and any(r.part > 1 for r in got)
    on_disk(spark, got)


NAMES = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, moment string, file int, `of` string, m map<string,int>, row string"


@pytest.mark.parametrize("digit", [12, 2])
def test_hot_hours_ties_and_awkward_rows(spark, monkeypatch, digit):
    """Hours above the limit, equal rows across several parts, equal keys of different rows, nulls, clashing names."""
    monkeypatch.setattr(T, "DIGIT", digit)
    monkeypatch.setattr(T, "COPIES", 3)
    hour, rows = dt.datetime(2024, 2, 7, 5), []
    rows += [(7, hour, hour, "same")] * 45  # fills several parts
    rows += [(i, hour + dt.timedelta(microseconds=i // 3), hour + dt.timedelta(days=i % 40), "x") for i in range(60)]
    rows += [(i, None, hour if i % 3 else None, "y") for i in range(30)] + [(None, None, None, "z")] * 12
    rows += [(-(1 << 62) + i, hour, hour, None) for i in range(5)] + [((1 << 62) + i, hour, hour, None) for i in range(5)]
    rows += [(8, hour, hour, f"d{i % 2}") for i in range(14)]
    rows += [(i, dt.datetime(1999, 12, 31, 23, 59, 59, 999_999), CUT, "n") for i in range(3)]
    full = [(*r, 1, "f", {"k": 1}, "r") for r in rows]
    table = spark.createDataFrame(full, NAMES).repartition(5)
    limit = 1 + len(rows) // 20
    got = T.partitioned_twice(table, share=20).collect()
    assert listed(got) == expected(full, limit)
    assert got[0].columns == "click_id,ts,arrived_at,moment,file,of,m,row"
    on_disk(spark, got)


def test_empty(spark):
    assert T.partitioned_twice(spark.createDataFrame([], NAMES)).collect() == []
    one = spark.createDataFrame([(1, None, None, None, None, None, None, None)], NAMES)
    [r] = T.partitioned_twice(one).collect()
    assert (r.leaf, r.part, r.n_rows, r.n_new, r.rewritten) == ("null", 1, 1, 1, True)


def test_search():
    rng = np.random.default_rng(3)
    bounds = np.array(sorted(rng.integers(0, 4, (40, 3)).tolist()))
    keys = rng.integers(0, 4, (200, 3))
    assert T.search(keys, bounds).tolist() == [sum(b < k for b in bounds.tolist()) for k in keys.tolist()]
    assert T.search(keys, bounds[:0].reshape(0, 3)).tolist() == [0] * 200
