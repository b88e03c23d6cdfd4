"""Calls one origin at a time give what the batch plans give, also after the state was read back."""

import json
import math

import pytest

from bandwright.operators import calibrate
from bandwright.streaming import ledger

LAST, HORIZON = 9, 2


def value(node, t):
    return float((t * 7 + len(node) * 3) % 11)


def guess(node, o, h):
    return float((o + h + len(node)) % 5)


@pytest.fixture(scope="module")
def issued(spark):
    """Issues of every origin, both columns, as the batch plans take them."""
    rows = []
    for node in ("a", "bb"):
        for o in range(LAST + 1):
            for h in range(1, HORIZON + 1):
                y = value(node, o + h) if o + h <= LAST else None
                p = guess(node, o, h)
                rows.append((node, h, h, o, p, y, None if y is None else abs(y - p)))
    return spark.createDataFrame(rows, "node string, c int, last_step int, origin int, point double, target double, score double").cache()


def play(spark, tmp_path, make, cover, score="absolute", state=None):
    nodes = spark.createDataFrame([("a",), ("bb",)], "node string")
    state, got = state if state is not None else ledger.initial_state(nodes, cover, make), {}
    for o in range(LAST + 1):
        points = spark.createDataFrame([(n, h, guess(n, o, h)) for n in ("a", "bb") for h in range(1, HORIZON + 1)], "node string, h int, point double")
        actuals = spark.createDataFrame([(n, o, value(n, o)) for n in ("a", "bb")], "node string, t int, value double")
        path = str(tmp_path / f"state-{o}")
        ledger.step(state, o, points, actuals, path, cover=cover, make=make, score=score)
        state = ledger.load_state(spark, path)
        got |= {(r["node"], r["c"], r["origin"]): r for r in ledger.issues(state).collect()}
    return got, state


@pytest.mark.parametrize(
    "make",
    [lambda c: calibrate.Tracker(0.8, 0.5), lambda c: calibrate.Adaptive(0.6, 0.05, 5), lambda c: calibrate.Adaptive(0.6, 0.05, 5, 0.9)],
    ids=["tracker", "aci", "aci of recency"],
)
def test_recursive_methods_resume_as_the_fold(spark, tmp_path, issued, make):
    got, _ = play(spark, tmp_path, make, ledger.per_step(HORIZON))
    want = {(r["node"], r["c"], r["origin"]): r["threshold"] for r in calibrate.fold(issued, lambda: make(0)).collect()}
    assert want.keys() == got.keys()
    assert all(got[k]["threshold"] == (pytest.approx(t) if t is not None else None) for k, t in want.items())


def test_retained_scores_resume_as_the_window_plan(spark, tmp_path, issued):
    got, _ = play(spark, tmp_path, lambda c: calibrate.Retained(0.6, 4), ledger.per_step(HORIZON))
    want = {(r["node"], r["c"], r["origin"]): r["threshold"] for r in calibrate.split(issued, 0.6, 4).collect()}
    assert {k: r["threshold"] for k, r in got.items()} == want
    assert any(t is not None for t in want.values()) and any(t is None for t in want.values())
    assert all((r["lower"] is None) == (r["threshold"] is None) for r in got.values())


def test_lead_time_waits_for_all_its_steps(spark, tmp_path):
    got, state = play(spark, tmp_path, lambda c: calibrate.ShortestInterval(0.5, 20), ledger.lead_time(2, HORIZON), "asymmetric")
    kept = json.loads(state.filter("node = 'a'").first()["kept"])
    sums = [sum(value("a", o + h) - guess("a", o, h) for h in (1, 2)) for o in range(LAST - 1)]
    assert kept["cells"][0]["scores"] == pytest.approx(sums)
    assert [w["origin"] for w in kept["waiting"]] == [LAST - 1, LAST]
    assert not got["a", 1, 1]["ready"] and got["a", 1, 2]["ready"] and got["a", 1, 2]["t_lo"] == pytest.approx(sums[0])


def test_seeded_pid_and_risk(spark, tmp_path):
    seeds = spark.createDataFrame([(n, c, k, float(k + c)) for n in ("a", "bb") for c in (1, 2) for k in range(4)], "node string, c int, k int, score double")
    make = lambda c: calibrate.ConformalPID(0.75, window=3)
    got, _ = play(spark, tmp_path / "pid", make, ledger.per_step(HORIZON), state=ledger.seeded_state(seeds, ledger.per_step(HORIZON), make))
    assert got["a", 1, 0]["threshold"] == 4.0 and all(r["ready"] for r in got.values())  # scores 2, 3, 4 are retained
    miss = lambda y, lo, hi: float(not lo <= y <= hi)
    grid = [0.0, 2.0, 4.0, 20.0]
    got, _ = play(spark, tmp_path / "risk", lambda c: calibrate.Risk(grid, 0.5, miss), ledger.per_step(HORIZON))
    errors = [abs(value("a", o + 1) - guess("a", o, 1)) for o in range(LAST)]
    fit = [g for g in grid if sum(e > g for e in errors) + 1 <= 0.5 * (len(errors) + 1)]
    assert got["a", 1, LAST]["threshold"] == fit[0] and got["a", 1, 0]["threshold"] is None


def test_what_a_call_refuses(spark, tmp_path):
    make, cover = (lambda c: calibrate.Tracker(0.9, 1.0)), ledger.per_step(1)
    nodes = spark.createDataFrame([("a",)], "node string")
    points = spark.createDataFrame([("a", 1, 2.0)], "node string, h int, point double")
    none = spark.createDataFrame([], "node string, t int, value double")
    at = lambda *ts: spark.createDataFrame([("a", t, 1.0) for t in ts], "node string, t int, value double")
    call = lambda state, o, p, y, name, cover=cover: ledger.step(state, o, p, y, str(tmp_path / name), cover=cover, make=make)
    state = call(ledger.initial_state(nodes, cover, make), 5, points, none, "first")
    for o, y in ((5, at(5)), (7, at(7)), (6, none), (6, at(6, 6))):
        with pytest.raises(Exception, match="periods between"):
            call(state, o, points, y, f"bad-{o}-{y.count()}-{id(y)}")
    with pytest.raises(Exception, match="finite points"):
        call(state, 6, points.limit(0), at(6), "bad-points")
    with pytest.raises(Exception, match="saved state"):
        call(state, 6, points, at(6), "bad-cover", ledger.lead_time(1, 1) * 2)
    with pytest.raises(ValueError):
        ledger.lead_time(3, 2)
    after = call(state, 6, points, spark.createDataFrame([("a", 6, None)], "node string, t int, value double"), "missing")
    assert ledger.issues(after).first()["threshold"] == 0.0  # a missing target teaches nothing


def test_method_rules():
    with pytest.raises(ValueError):
        calibrate.Retained(0.95, 5, 0.9)
    with pytest.raises(ValueError):
        calibrate.Risk([1.0, 1.0], 0.1, None)
    p = calibrate.ConformalPID(0.9)
    with pytest.raises(ValueError):
        p.seed([math.nan])
    p.seed([1.0, 3.0])
    with pytest.raises(ValueError):
        p.update(-1.0, False)
    with pytest.raises(ValueError):
        p.seed([1.0])


@pytest.mark.parametrize("make", [lambda c: calibrate.Tracker(0.8, 0.5), lambda c: calibrate.Retained(0.6, 4)], ids=["tracker", "retained"])
def test_many_origins_in_one_call_are_as_single_calls(spark, tmp_path, make):
    cover = ledger.per_step(HORIZON)
    want, _ = play(spark, tmp_path, make, cover)
    points = spark.createDataFrame([(n, o, h, guess(n, o, h)) for n in ("a", "bb") for o in range(LAST + 1) for h in (1, 2)], "node string, origin int, h int, point double")
    actuals = spark.createDataFrame([(n, t, value(n, t)) for n in ("a", "bb") for t in range(LAST + 1)], "node string, t int, value double")
    state, got = ledger.initial_state(points.select("node").distinct(), cover, make), {}
    for k, part in enumerate((range(4), range(4, LAST + 1))):
        new = actuals.filter(f"t between {part[0]} and {part[-1]}")
        ledger.replay(state, list(part), points, new, str(tmp_path / f"many-{k}"), cover=cover, make=make)
        state = ledger.load_state(spark, str(tmp_path / f"many-{k}"))
        got |= {(r["node"], r["c"], r["origin"]): r for r in ledger.issues(state).collect()}
    assert got == want
    with pytest.raises(ValueError):
        ledger.replay(state, [3, 3], points, actuals, str(tmp_path / "bad"), cover=cover, make=make)


class Counting(calibrate.Tracker):
    STATE = ("theta", "flagged")

    def __init__(self):
        super().__init__(0.8, 0.5)
        self.flagged = 0

    def update_censored(self, score, missed, censored):
        self.flagged += censored
        self.update(score, missed)


def test_a_target_is_censored_if_a_covered_value_is(spark, tmp_path):
    cover, make = ledger.lead_time(3, 3), lambda c: Counting()
    points = spark.createDataFrame([("n", o, h, 1.0) for o in range(9) for h in (1, 2, 3)], "node string, origin int, h int, point double")
    actuals = spark.createDataFrame([("n", t, 2.0, t == 5) for t in range(9)], "node string, t int, value double, censored boolean")
    state = ledger.replay(ledger.initial_state(points.select("node").distinct(), cover, make), list(range(9)), points, actuals, str(tmp_path / "s"), cover=cover, make=make)
    assert json.loads(state.first()["kept"])["cells"][0]["flagged"] == 3  # origins 2, 3 and 4 cover period 5
    done = {r["origin"]: (r["target"], r["censored"]) for r in ledger.realised(ledger.issues(state), actuals, cover).collect()}
    assert done == {o: (6.0 if o + 3 < 9 else None, o in (2, 3, 4)) for o in range(9)}


def test_scores_of_origins_without_a_bound_miss_nothing(spark):
    rows = [("n", 3, 3, o, 0.0, float(o % 4), float(o % 4)) for o in range(12)]
    issues = spark.createDataFrame(rows, "node string, c int, last_step int, origin int, point double, target double, score double")
    got = {r["origin"]: r for r in calibrate.fold(issues, lambda: calibrate.ConformalPID(0.5, gain=0.0, window=50), seed_rows=4).collect()}
    # seeds are the scores of origins 0 to 3, known at 6; those of 4 and 5 were never issued for
    method = calibrate.ConformalPID(0.5, gain=0.0, window=50)
    method.seed([0.0, 1.0, 2.0, 3.0])
    assert not any(got[o]["ready"] for o in range(6)) and all(got[o]["threshold"] == method.threshold() for o in (6, 7, 8))


def test_forecast_scorecaster():
    cast = calibrate.ForecastScorecaster(lambda y, h: [y[-1] + k for k in range(h)], least=2)
    assert cast([], 3) == 0.0 and cast([4.0], 3) == 4.0 and cast([4.0, 6.0], 3) == 8.0
    p = calibrate.ConformalPID(0.5, scorecaster=cast, ahead=2)
    p.seed([1.0, 5.0])
    assert p.p == 1.0 - 6.0 and p.threshold() == 1.0
