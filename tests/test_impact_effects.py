"""Effects of every customer against a walk over the same calls in plain Python."""

from collections import defaultdict

from tracewell.plans.views import load
from tracewell.queries import QUERIES


def test_every_customer_is_a_root(spark, sf_dir):
    v = load(spark, sf_dir, ["v_call", "part"])
    calls, status = defaultdict(set), {}
    for r in v["v_call"].select("caller", "callee", "status").collect():
        calls[r.caller].add(r.callee)
        status[r.caller, r.callee] = max(r.status, status.get((r.caller, r.callee), ""))
    told = {f"p{r.p_partkey}" for r in v["part"].collect() if r.p_size % 3 < 2}
    want = defaultdict(set)
    for root in (c for c in calls if c.startswith("c")):
        direct = {x for x in calls[root] if status[root, x] == "verified"}
        if len(direct) < 40:
            want[root] = direct & told
    got = defaultdict(set)
    for r in QUERIES["impact_effects"](spark, sf_dir).filter("direct").collect():
        got[r.root].add(r.node)
    assert {root: got[root] for root in want} == want and len([x for x in want.values() if x]) > 20
    assert all(got[c] for c in calls if c.startswith("c") and c not in want)
