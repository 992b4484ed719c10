"""The union of all rules has the cycles, by a walk of its own."""

import os

import pytest

import __spark_entry__ as entry
from strataspark.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_cycles_count(spark):
    following: dict = {}
    for r in catalogue._path_edges(spark, SF).collect():
        following.setdefault(r.src, set()).add(r.dst)
        following.setdefault(r.dst, set())
    state, back = {}, []

    def walk(node):
        state[node] = "open"
        for other in sorted(following[node]):
            if state.get(other) == "open":
                back.append(other)
            elif other not in state:
                walk(other)
        state[node] = "done"

    for node in sorted(following):
        if node not in state:
            walk(node)
    assert back
    found = entry.entry(spark).collect()
    assert sorted(r.file for r in found if r.rule_id == "rule.circular-dependency") == sorted(back)
    assert len(found) == len(back) + catalogue.QUERIES["rule_union_sorted"](spark, SF).count()
    (whole,), (part,) = (catalogue.QUERIES[q](spark, SF).collect() for q in ("all_violations_score", "structural_score"))
    assert whole.circular == len(back) and (whole.layer, whole.size, whole.god_object) == (part.layer, part.size, part.god_object)
    print("rows", len(found), "circular", len(back), whole, part)
