import random

from jobscope.operators import snapshot as C


def brute(procs, roots):
    """Reference walk: from each root through alive parents; a vanished child
    gives only I/O and RSS and its children are not reached."""
    kids = {}
    for p in procs.values():
        if p["ppid"] != p["pid"]:
            kids.setdefault(p["ppid"], []).append(p["pid"])
    out = {}
    for r in roots:
        tot = dict(u=0, s=0, f=0, rc=0, wc=0, rss=0, n=0)
        stack = [r]
        while stack:
            x = stack.pop()
            p = procs[x]
            tot["n"] += 1
            tot["rc"] += p["rchar"]
            tot["wc"] += p["wchar"]
            tot["rss"] = max(tot["rss"], p["rss"])
            if p["alive"]:
                tot["u"] += p["utime"] + p["cutime"]
                tot["s"] += p["stime"] + p["cstime"]
                tot["f"] += p["minflt"] + p["cminflt"]
                stack.extend(c for c in kids.get(x, []) if c not in roots)
        out[r] = tot
    return out


def test_process_tree_rollup_matches_walk(spark):
    rnd = random.Random(5)
    n = 300
    procs = {}
    for pid in range(n):
        procs[pid] = dict(pid=pid, ppid=pid // 2 if pid else 0, utime=rnd.randint(0, 9), stime=rnd.randint(0, 9),
                          cutime=rnd.randint(0, 3), cstime=rnd.randint(0, 3), minflt=rnd.randint(0, 9),
                          cminflt=rnd.randint(0, 3), rss=rnd.randint(0, 99), rchar=rnd.randint(0, 9),
                          wchar=rnd.randint(0, 9), alive=rnd.random() > 0.15, comm="p")
    roots = {r for r in range(1, n) if rnd.random() < 0.1 and procs[r]["alive"]}
    pdf = spark.createDataFrame([("h", 0, p["pid"], p["ppid"], p["comm"], p["utime"], p["stime"], p["cutime"],
                                  p["cstime"], p["minflt"], p["cminflt"], p["rss"], p["rchar"], p["wchar"], p["alive"])
                                 for p in procs.values()],
                                "host string, ts long, pid long, ppid long, comm string, utime long, stime long, "
                                "cutime long, cstime long, minflt long, cminflt long, rss long, rchar long, "
                                "wchar long, alive boolean")
    rdf = spark.createDataFrame([("h", 0, r, r, 0) for r in roots], "host string, ts long, pid long, jobid long, stepid long")
    got = {r.root: dict(u=r.utime, s=r.stime, f=r.minor_pagefault, rc=r.rchar, wc=r.wchar, rss=r.res, n=r.nproc)
           for r in C.process_tree_rollup(pdf, rdf).collect()}
    assert got == brute(procs, roots)


def test_node_partition_order(spark):
    p = spark.createDataFrame([("small", "n[1-2]", 2, 60), ("big", "n[2-3]", 8, None), ("all", "n3", 0, None),
                               ("fast", "n1", 2, 30)], "name string, nodes string, max_nodes long, max_time long")
    got = {r.node: r.partition for r in C.node_partition(p).collect()}
    assert got == {"n1": "fast", "n2": "big", "n3": "all"}


def test_parent_cycles_are_an_error(spark):
    import pytest

    from jobscope.operators import snapshot as C
    procs = spark.createDataFrame([("h", 0, p, pp, True) for p, pp in ((1, 2), (2, 3), (3, 1), (4, 1))],
                                  "host string, ts long, pid long, ppid long, alive boolean")
    roots = spark.createDataFrame([("h", 0, 9)], "host string, ts long, pid long")
    with pytest.raises(ValueError, match="cycle"):
        C.nearest_root(procs, roots)
