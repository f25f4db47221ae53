"""The evidence ledger: entries of nested outputs, citations, recording twice."""

import json
import random
from uuid import UUID

from opinara.operators import ledger as L
from opinara.sources.stored import read_table


def uuid(k):
    return str(UUID(int=k))


def test_ledger_equals_sets(spark, tmp_path):
    rng = random.Random(3)
    outputs, want = [], set()
    for run in range(3):
        for step, tool in enumerate(("search", "security", "empty")):
            ids = [rng.randint(0, 30) for _ in range(12)] if tool != "empty" else []
            shape = {"items": [{"reviewId": uuid(k), "inner": {"supportingEvidenceIds": [uuid(k + 1).upper(), "no id"]}} for k in ids]}
            outputs.append((run, tool, step, json.dumps(shape)))
            want |= {(run, tool, uuid(j), f"s{j % 3}" if j % 5 else "unknown") for k in ids for j in (k, k + 1) if j < 25}
    frame = spark.createDataFrame(outputs, "run_id int, tool string, step int, payload string")
    evidence = spark.createDataFrame([(uuid(k), f"s{k % 3}" if k % 5 else None) for k in range(25)], "evidence_id string, source string")
    led = L.entries(frame, evidence)
    assert {tuple(r) for r in led.collect()} == want
    # a run takes five ids at most, those of its earliest step, and all rows of these
    some = {tuple(r) for r in L.entries(frame, evidence, most=5).collect()}
    for run in range(3):
        first = {}
        for r, tool, e, _ in want:
            if r == run:
                first[e] = min(first.get(e, 9), 0 if tool == "search" else 1)
        kept = sorted(first, key=lambda e: (first[e], e))[:5]
        assert {x for x in some if x[0] == run} == {x for x in want if x[0] == run and x[2] in kept}
    path = str(tmp_path / "ledger")
    assert L.record(led, path)["inserted"] == len(want)
    assert L.record(led, path) == {"inserted": 0, "updated": 0, "kept": len(want)} and {tuple(r) for r in read_table(spark, path).collect()} == want
    shares = L.composition(led).collect()
    for run in range(3):
        mine = {x[2:] for x in want if x[0] == run}
        assert {r.source: r.evidence for r in shares if r.run_id == run} == {s: sum(y == s for _, y in mine) for _, s in mine}
        assert abs(sum(r.share for r in shares if r.run_id == run) - 100) < 0.05
    said = {r.run_id: r.claim for r in L.answer(led, frame).collect()}
    assert said[0] == f"3 tools returned {len({x[2] for x in want if x[0] == 0})} distinct eligible evidence records from {len({x[3] for x in want if x[0] == 0})} sources."


def test_findings_stand_on_their_own_run(spark):
    led = spark.createDataFrame([(1, "a", uuid(1), "x"), (1, "b", uuid(1), "x"), (1, "a", uuid(2), "y"), (2, "a", uuid(3), "x")], "run_id int, tool string, evidence_id string, source string")
    findings = spark.createDataFrame(
        [(1, "ok", [uuid(1), uuid(2).upper(), "{" + uuid(1) + "}"]), (1, "foreign", [uuid(1), uuid(3)]), (1, "none", []), (1, "null", None), (2, "bad", ["not an id"]), (2, "own", [uuid(3)])],
        "run_id int, finding_id string, evidence_ids array<string>",
    )
    got = {r.finding_id: (r.cited, r.unavailable, r.state) for r in L.checked(findings, led).collect()}
    assert got == {"ok": (2, 0, "valid"), "foreign": (2, 1, "rejected"), "none": (0, 0, "uncited"), "null": (0, 0, "uncited"), "bad": (1, 1, "rejected"), "own": (1, 0, "valid")}
    held = {r.finding_id: (r.evidence, r.tools, r.sources) for r in L.support(findings, led).collect()}
    assert held == {"ok": (2, 2, 2), "own": (1, 1, 1)}
