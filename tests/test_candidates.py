"""The detector protocol, the audit of angles, the board's fold, and versioned contracts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddglass.operators import audit as A
from oddglass.operators.interest import diversity_board
from oddglass.plans import candidates as CA
from oddglass.plans.roles import Tables
from oddglass.sources import contracts as K

c = F.col


@pytest.fixture()
def detectors(monkeypatch):
    found = {}
    monkeypatch.setattr(CA, "DETECTORS", found)
    return found


def test_a_failing_detector_stops_no_other(spark, place, detectors):
    rows = spark.createDataFrame([(1, .4, "x"), (2, 1.7, None), (3, None, "z"), (None, -1.0, "n")], "who int, p double, note string")

    def broken(t):
        raise LookupError("no such table")
    CA.register(CA.Detector("good", lambda t: rows, "who", "p"))
    CA.register(CA.Detector("unplanned", broken, "who", "p"))
    CA.register(CA.Detector("no_column", lambda t: rows, "who", "missing / 2"))
    CA.register(CA.Detector("at_run_time", lambda t: rows.withColumn("p", F.raise_error(F.lit("bad row")).cast("double")), "who", "p"))
    CA.register(CA.Detector("quiet", lambda t: rows.where("1 = 0"), "who", "p", "team"))
    ledger = {r.detector: (r.complete, r.error) for r in CA.run_all(Tables(spark, "none"), place).collect()}
    assert {k: v[0] for k, v in ledger.items()} == {"good": True, "quiet": True, "unplanned": False, "no_column": False, "at_run_time": False}
    assert "no such table" in ledger["unplanned"][1] and "missing" in ledger["no_column"][1]
    got = {r.subject: r for r in CA.read_candidates(spark, place).collect()}
    assert {k: r.interest for k, r in got.items()} == {"1": .4, "2": 1.0, "3": 0.0, None: 0.0}
    assert got["1"].payload == {"who": "1", "p": "0.4", "note": "x"} and got["2"].payload["note"] is None and {r.detector for r in got.values()} == {"good"}
    assert len({r.candidate_id for r in got.values()}) == 4
    again = {r.candidate_id for r in CA.candidate_rows(CA.get_detector("good"), None).collect()}
    assert again == {r.candidate_id for r in got.values()}


def test_registry_of_detectors(detectors):
    CA.register(CA.Detector("a", lambda t: None, "s", "p"))
    with pytest.raises(ValueError):
        CA.register(CA.Detector("a", lambda t: None, "s", "p"))
    with pytest.raises(KeyError):
        CA.get_detector("b")


def test_numbers_are_backed_as_whole_tokens(spark):
    stat = "array<struct<value: double, unit: string>>"
    rows = [
        (1, "5 of them", [(150.0, "count")], .5, "moderate", ["c"]), (2, "5 of them", [(5.0, "count")], .5, "moderate", ["c"]), (3, "a .312 rate", [(.3121, "rate")], .8, "high", ["c"]),
        (4, "ERA 3.40", [(3.4, "runs")], .1, "low", ["c"]), (5, "no number", [], .1, "low", ["c"]), (6, "7", [(7.0, "count")], .9, "low", []), (7, "7", [(7.0, "count")], 1.2, "high", ["c"]), (8, "7", [(7.0, "count")], None, "high", ["c"])]
    df = spark.createDataFrame(rows, f"k int, headline string, stats {stat}, reliability double, tier string, caveats array<string>")
    got = {}
    for r in A.angle_audit(df, ["k"], "headline", "stats", "reliability", "tier", "caveats").collect():
        got.setdefault(r.k, set()).add(r.check)
    assert got == {1: {"headline"}, 5: {"corpus"}, 6: {"tier", "caveat"}, 7: {"reliability"}, 8: {"tier", "reliability"}}


def test_the_board_is_a_fold(spark):
    rows = [(f"c{i}", f"d{i % 3}", None if i % 5 == 0 else f"s{i % 4}", .9 - i / 100, 1 - i / 90) for i in range(40)]
    board = diversity_board(spark.createDataFrame(rows, "id string, detector string, subject string, score double, rank_value double"))
    plan = board._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and board.count() == 9
    assert diversity_board(spark.createDataFrame([], "id string, detector string, subject string, score double, rank_value double")).count() == 0


def test_schemas_are_compared_by_path(spark):
    have = T.StructType.fromDDL("a int, b bigint, c array<struct<x: float, z: int>>, d map<string, date>, e string, f decimal(10,2)")
    want = T.StructType.fromDDL("a bigint, b int, c array<struct<x: double, y: int>>, d map<string, timestamp_ntz>, e int, f decimal(12,2), g int")
    assert sorted(K.compare(have, want)) == sorted([
        ("a", "narrowed"), ("b", "widened"), ("c[].x", "narrowed"), ("c[].y", "missing"), ("c[].z", "added"), ("d.value", "narrowed"), ("e", "changed"), ("f", "narrowed"), ("g", "missing")])
    strict = T.StructType([T.StructField("a", T.IntegerType(), False)])
    assert K.compare(T.StructType.fromDDL("a int"), strict) == [("a", "nullable")] and K.compare(strict, strict) == []


def test_versions_only_add_and_widen(spark, place):
    with pytest.raises(ValueError):
        K.Contracts(K.contract("r", 1, "a bigint, b int"), K.contract("r", 2, "a int, b int")).newest("r")
    with pytest.raises(ValueError):
        K.Contracts(K.contract("r", 1, "a bigint, b int"), K.contract("r", 2, "a bigint")).newest("r")
    both = K.Contracts(K.contract("r", 2, "a bigint, b int, c string"), K.contract("r", 1, "a int, b int"))
    spark.createDataFrame([(1, 2)], "a int, b int").write.parquet(f"{place}/v1")
    got = both.read(spark, "r", f"{place}/v1")
    assert [f.simpleString() for f in got.schema.fields] == ["a:bigint", "b:int", "c:string"] and tuple(got.first()) == (1, 2, None)
    spark.createDataFrame([(1, 2**40)], "a int, b bigint").write.parquet(f"{place}/v3")
    with pytest.raises(TypeError):
        both.read(spark, "r", f"{place}/v3")
    kinds = {(r.version, r.path, r.kind, r.breaking) for r in both.violations(spark, {"r": spark.read.parquet(f"{place}/v3")}).collect()}
    assert kinds == {(1, "b", "widened", False), (2, "a", "narrowed", True), (2, "b", "widened", False), (2, "c", "missing", True)}


def test_every_role_meets_its_contract(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    tables = {role: getattr(t, role) for role in K.CONTRACTS.of}
    bad = [tuple(r) for r in K.CONTRACTS.violations(spark, tables).collect() if r.version == K.CONTRACTS.newest(r.role).version]
    assert bad == []
