"""Readers on small files of the published forms, covariate visibility, and reconciliation of points that do not add up."""

import gzip
from datetime import datetime

import numpy as np
import pytest

from bandwright.operators import covariates, forecast, hierarchy
from bandwright.sources import datasets


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_vn2(spark, tmp_path):
    put(tmp_path / "week_8_sales.csv", "Store,Product,2024-04-08,2024-04-15\n0,126,2.0,\n1,7,3.0,4.0\n")
    put(tmp_path / "week_0_in_stock.csv", "Store,Product,2024-04-08\n0,126,False\n1,7,True\n")
    put(tmp_path / "week_0_master.csv", "Store,Product,Division\n0,126,d\n1,7,e\n")
    put(tmp_path / "week_0_initial_state.csv", "Store,Product,End Inventory,In Transit W+1,In Transit W+2\n0,126,5,1,2\n1,7,0,0,3\n")
    panel, stock = datasets.vn2(spark, str(tmp_path))
    got = {(r["series"], r["period"].day): (r["value"], r["censored"], r["Division"]) for r in panel.collect()}
    assert got == {("0_126", 8): (2.0, True, "d"), ("0_126", 15): (0.0, False, "d"), ("1_7", 8): (3.0, False, "e"), ("1_7", 15): (4.0, False, "e")}
    assert {tuple([r[0], r[1], *r[2]]) for r in stock.collect()} == {("0_126", 5.0, 1.0, 2.0), ("1_7", 0.0, 0.0, 3.0)}


def test_m5(spark, tmp_path):
    put(tmp_path / "sales_train_evaluation.csv", "id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\nx,i,d,c,s,CA,1,2\n")
    put(tmp_path / "calendar.csv", "date,wm_yr_wk,d\n2011-01-29,1,d_1\n2011-01-30,2,d_2\n2011-01-31,3,d_3\n")
    put(tmp_path / "sell_prices.csv", "store_id,item_id,wm_yr_wk,sell_price\ns,i,2,9.5\n")
    assert [(r["series"], r["t"], r["value"], r["period"]) for r in datasets.m5(spark, str(tmp_path)).orderBy("t").collect()] == [("i_s", 0, 1.0, datetime(2011, 1, 29)), ("i_s", 1, 2.0, datetime(2011, 1, 30))]
    assert [tuple(r) for r in datasets.m5_prices(spark, str(tmp_path), 1, 2).orderBy("t").collect()] == [("i_s", k, 9.5) for k in range(3)]
    with pytest.raises(ValueError):
        datasets.m5_prices(spark, str(tmp_path), 2, 2)


def test_matrix_and_single_columns(spark, tmp_path):
    with gzip.open(tmp_path / "m.txt.gz", "wt") as f:
        f.write("1,2\n3,4\n5,6\n")
    got = datasets.matrix_text(spark, str(tmp_path / "m.txt.gz"), "1 hour").orderBy("series", "t").collect()
    assert [(r["series"], r["t"], r["value"]) for r in got] == [("column_001", 0, 1.0), ("column_001", 1, 3.0), ("column_001", 2, 5.0), ("column_002", 0, 2.0), ("column_002", 1, 4.0), ("column_002", 2, 6.0)]
    assert got[1]["period"] == datetime(2000, 1, 1, 1)
    path = put(tmp_path / "ETTh1.csv", "date,HUFL,OT\n2016-07-01 00:00:00,1,30.5\n")
    assert tuple(datasets.ett(spark, path).first()) == ("OT", datetime(2016, 7, 1), 30.5)


def test_gaps_are_filled_from_the_past_only(spark, tmp_path):
    put(tmp_path / "air" / "a.csv", "No,year,month,day,hour,PM2.5,station\n1,2013,3,1,0,NA,A\n2,2013,3,1,1,4,A\n3,2013,3,1,3,6,A\n")
    put(tmp_path / "air" / "b.csv", "No,year,month,day,hour,PM2.5,station\n1,2013,3,1,0,1,B\n2,2013,3,1,1,2,B\n3,2013,3,1,2,NA,B\n4,2013,3,1,3,3,B\n")
    got = {(r["series"], r["t"]): (r["value"], r["observed"]) for r in datasets.beijing(spark, str(tmp_path / "air")).collect()}
    assert got == {("A", 0): (4.0, True), ("A", 1): (4.0, False), ("A", 2): (6.0, True), ("B", 0): (2.0, True), ("B", 1): (2.0, False), ("B", 2): (3.0, True)}
    path = put(tmp_path / "hour.csv", "instant,dteday,hr,cnt\n1,2011-01-01,0,16\n2,2011-01-01,2,9\n")
    assert [(r["t"], r["value"], r["observed"]) for r in datasets.bike(spark, path).orderBy("t").collect()] == [(0, 16.0, True), (1, 16.0, False), (2, 9.0, True)]


def test_favorita_and_freshretail(spark, tmp_path):
    put(tmp_path / "train.csv", "id,date,store_nbr,family,sales\n0,2013-01-01,1,F,5\n1,2013-01-03,1,F,7\n")
    put(tmp_path / "stores.csv", "store_nbr,city,state,type,cluster\n1,Q,P,D,13\n")
    got = datasets.favorita(spark, str(tmp_path)).orderBy("t").collect()
    assert [(r["series"], r["value"], r["observed"], r["city"], r["cluster"]) for r in got] == [("1:F", 5.0, True, "Q", "13"), ("1:F", 5.0, False, "Q", "13"), ("1:F", 7.0, True, "Q", "13")]
    kinds = "store_id int, product_id int, dt string, sale_amount double, stock_hour6_22_cnt int, other int"
    for name, day in (("train.parquet", "2024-06-25"), ("eval.parquet", "2024-06-26")):
        spark.createDataFrame([(1, 2, day, 0.5, int(name[0] == "e"), 0)], kinds).write.parquet(str(tmp_path / name))
    fresh = datasets.freshretail(spark, str(tmp_path / "train.parquet"), str(tmp_path / "eval.parquet"), ["store_id", "product_id"]).orderBy("period").collect()
    assert [(r["series"], r["value"], r["censored"]) for r in fresh] == [("1:2", 0.5, False), ("1:2", 0.5, True)]


def test_covariates_show_what_an_origin_may_see(spark):
    rows = spark.createDataFrame([(s, t, float(10 * k + t)) for k, s in enumerate("ab") for t in range(6)], "series string, t int, value double")
    series = rows.select("series").distinct()
    edge = hierarchy.edges(series.selectExpr("series", "'x' as g"), [["g"]])
    grid = spark.createDataFrame([("a", 3, 1), ("total", 3, 2)], "node string, origin int, h int")
    past, ahead = covariates.Covariate(rows), covariates.Covariate(rows, known_ahead=True, aggregate="sum")
    assert covariates.visible(past, 3, 2).agg({"t": "max"}).first()[0] == 3 and covariates.visible(ahead, 3, 2).agg({"t": "max"}).first()[0] == 5
    assert {r["node"]: r["x"] for r in covariates.at_steps(grid, ahead, edge, "x").collect()} == {"a": 4.0, "total": 20.0}
    assert {r["node"]: r["x"] for r in covariates.at_lag(grid, past, edge, "x", 1).collect()} == {"a": 2.0, "total": 7.0}
    with pytest.raises(ValueError):
        covariates.at_steps(grid, past, edge, "x")
    shared = covariates.Covariate(rows.filter("series = 'a'").select("t", "value"), known_ahead=True)
    assert {r["x"] for r in covariates.at_steps(grid, shared, edge, "x").collect()} == {4.0, 5.0}
    static = covariates.Covariate(rows.filter("t = 0").select("series", "value"))
    assert static.kind == "static" and {r["node"]: r["x"] for r in covariates.at_steps(grid, static, edge, "x").collect()} == {"a": 0.0, "total": 5.0}
    covariates.check(ahead, series, 3, 2)
    for cov, last in ((ahead, 4), (past, 6), (covariates.Covariate(rows.filter("series = 'a'")), 3)):
        with pytest.raises(ValueError):
            covariates.check(cov, series, last, 2)


def test_reconciled_points_are_the_structural_least_squares(spark):
    attrs = spark.createDataFrame([("a", "x", "p"), ("b", "x", "q"), ("c", "y", "p"), ("d", "y", "q"), ("e", "y", "q")], "series string, g string, k string")
    edge = hierarchy.edges(attrs, [["g"], ["k"], ["g", "k"]])
    rows = [tuple(r) for r in edge.select("node", "series", "level").collect()]
    names = sorted({r[0] for r in rows})
    draw = np.random.default_rng(3)
    base = {(n, h): float(draw.normal(10, 3)) for n in names for h in (1, 2)}
    given = spark.createDataFrame([(n, 7, h, v) for (n, h), v in base.items()], "node string, origin int, h int, point double")
    got = {(r["node"], r["h"]): r["point"] for r in hierarchy.wls_struct(given, edge).collect()}
    under = {n: {m for x, m, _ in rows if x == n} for n in names}
    upper = [n for n in names if n not in "abcde"]
    j = np.array([[-1.0 if m == n else float(m in under[n]) for m in names] for n in upper])
    w = np.array([float(len(under[n])) for n in names])
    dense = {}
    for h in (1, 2):
        b = np.array([base[n, h] for n in names])
        dense |= {(n, h): v for n, v in zip(names, b - w * (j.T @ np.linalg.solve((j * w) @ j.T, j @ b)))}
    assert got.keys() == dense.keys() and all(got[k] == pytest.approx(dense[k]) for k in dense)
    assert got["total", 1] == pytest.approx(sum(got[s, 1] for s in "abcde"))
    with pytest.raises(ValueError):
        hierarchy.wls_struct(given, edge, most_edges=2)


def test_global_models_see_the_past_only(spark):
    rows = [(n, t, float(np.sin(t * 0.7 + k) + 3)) for k, n in enumerate(("a", "b", "c")) for t in range(80)]
    panel = spark.createDataFrame(rows, "node string, t int, value double")
    seen = []

    def fit(frame):
        seen.append((frame["t"].min(), frame["t"].max(), frame["node"].nunique()))
        shift = len(seen)
        return lambda y, horizon: [y[-1] + shift] * horizon

    got = {(r["node"], r["origin"], r["h"]): r["point"] for r in forecast.global_model(panel, fit, 2, 60, 65, 3, 10, 5, 2).collect()}
    assert seen == [(51, 60, 2), (54, 63, 2)] and len(got) == 3 * 6 * 2
    truth = {(n, t): v for n, t, v in rows}
    assert all(p == pytest.approx(truth[n, o] + (1 if o < 63 else 2)) for (n, o, h), p in got.items())
    with pytest.raises(ValueError):
        forecast.global_model(panel, fit, 0, 60, 65)
    with pytest.raises(Exception, match="the model gave"):
        forecast.global_model(panel, lambda frame: lambda y, h: [1.0], 2, 60, 65).collect()

    network = forecast.lag_network(9, 2, quantiles=(0.1, 0.5, 0.9))
    made = forecast.global_model(panel, network, 2, 60, 75, None, 60, 9, outputs=("q_lo", "point", "q_hi")).collect()
    errors = [abs(r["point"] - truth[r["node"], r["origin"] + r["h"]]) for r in made]
    assert np.mean(errors) < 0.3 and all(r["q_lo"] <= r["point"] <= r["q_hi"] for r in made)
    again = forecast.global_model(panel, network, 2, 60, 75, None, 60, 9, outputs=("q_lo", "point", "q_hi")).collect()
    assert sorted(map(tuple, made)) == sorted(map(tuple, again))


def test_a_series_has_one_set_of_attributes(spark):
    twice = spark.createDataFrame([("a", "x"), ("a", "y")], "series string, g string")
    with pytest.raises(Exception, match="series must be unique"):
        hierarchy.edges(twice, [["g"]]).collect()
