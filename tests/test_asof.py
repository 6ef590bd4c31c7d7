"""The bucketed as-of fill against brute force, across bucket widths, so
in-bucket scans and carries between buckets are both exercised."""

import random

import pytest

from touchline.operators.asof import asof_backward, asof_forward


def _data(seed):
    rnd = random.Random(seed)
    probes, build = [], []
    for u in ("a", "b", "c"):
        keys = rnd.sample(range(-40, 60), 25)
        for k in keys[:12]:
            build.append((u, k, rnd.choice([None, "x", "y", "z"]), rnd.choice([None, 1, 2])))
        for k in keys[12:] + [keys[0], None]:
            probes.append((u, k, f"p{len(probes)}"))
    return probes, build


def _brute(probes, build, forward=False):
    out = {}
    for u, k, pid in probes:
        if k is None:
            out[pid] = (None, None, 0)
            continue
        cand = [b for b in build if b[0] == u and (b[1] >= k if forward else b[1] <= k)]
        cand.sort(key=lambda b: b[1], reverse=not forward)
        v = next((b[2] for b in cand if b[2] is not None), None)
        w = next((b[3] for b in cand if b[3] is not None), None)
        out[pid] = (v, w, len(cand))
    return out


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
@pytest.mark.parametrize("forward", [False, True])
def test_asof_matches_brute_force(spark, width, forward):
    probes, build = _data(width * 2 + forward)
    p = spark.createDataFrame(probes, "u string, k bigint, pid string")
    b = spark.createDataFrame(build, "u string, bk bigint, v string, w int")
    fn = asof_forward if forward else asof_backward
    got = {
        r.pid: (r.v, r.w, r.n)
        for r in fn(p, b, ["u"], "k", ["v", "w"], width, count_col="n", build_key="bk").collect()
    }
    assert got == _brute(probes, build, forward)
