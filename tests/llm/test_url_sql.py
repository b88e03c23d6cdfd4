"""The URL filter's whole result against its SQL, on addresses of every kind."""

import random

import duckdb
import pytest

from bandwright.llm import queries

ODD = [None, "", "no scheme", "://", "http://", "HTTP://B.Com/en/ABC", "http://a.example.com/en/71", "http://example.com/en/8", "http://example.net/de/8?x=1", "ftp://x.net/de/9#y",
       "http://notorg/es/1", "http://x.org/es/é/ü", "http://例え.org/es/テスト", "http://q.io/" + "long/" * 3000, "http://a.com/en/" + "z" * 5000, "x://y://z/en/", "http://a b.com/en/\nline"]


def addresses(seed):
    draw = random.Random(seed)
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(3, 9)))
    out = list(ODD)
    for _ in range(150):
        out.append(f"https://{word('abcde')}.net/de/{word('abcde')}-{draw.randint(0, 99)}")
        out.append(f"http://{word('vwxyz')}.com/en/{word('vwxyz')}_{draw.randint(0, 9999)}?q={word('vwxyz')}")
        out.append(f"http://{word(draw.choice(['abcde', 'vwxyz']))}.io/{word(draw.choice(['abcde', 'vwxyz']))}")
    return out + out[100:140]


@pytest.mark.parametrize("given", [addresses(1), addresses(2), ODD, ["http://a.com/en/1", "http://b.io/x"], [None], []], ids=["one", "two", "odd", "one-sided", "null", "empty"])
def test_urls_equal_their_sql(spark, tmp_path, given):
    pages = spark.createDataFrame([(k % 400, u, "clash", "clash") for k, u in enumerate(given)], "page_id long, url string, host string, score string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = queries.op1_url_markov_ratio(spark, str(tmp_path))
    with duckdb.connect() as base:
        base.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = base.execute(queries.ORACLE_SQL["op1_url_markov_ratio"])
        names = [d[0] for d in want.description]
        rows = want.fetchall()
    assert names == got.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr) and len(rows) == len(given)
