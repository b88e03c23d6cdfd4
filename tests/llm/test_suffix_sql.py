"""The SQL of the suffix-array dedup and the operator, row by row, on odd texts."""

import random

import duckdb
import pyarrow as pa

from bandwright.llm.suffix_sql import remove_repeats_sql
from bandwright.llm.suffixes import remove_repeats
from tests.llm.test_operators import sentence

SCHEMA = "doc_id long, text string"


def by_sql(rows):
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    with duckdb.connect() as db:
        db.register("documents", documents)
        return sorted(db.execute(remove_repeats_sql()).fetchall())


def test_sql_and_operator_agree(spark):
    draw = random.Random(5)
    passage, other = sentence(draw, 90), "ü½語 " * 60 + sentence(draw, 40)
    texts = [None, "", "a" * 399, "a" * 400, "b" * 401, "ab" * 700, sentence(draw, 400)]
    texts += [passage[:399] + "|", passage[:399] + "/", passage, "x " + passage + " y " + passage + " z", other + passage, sentence(draw, 30) + other, other, other]
    rows = list(enumerate(texts))
    got = remove_repeats(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    expected = by_sql(rows)
    assert sorted(map(tuple, got.collect())) == expected
    removed = {r[0]: r[2] for r in expected}
    assert removed[2] == removed[3] == 0 and removed[4] == 401 and removed[5] == 1400 and removed[9] == len(passage)


def test_sql_of_an_empty_table():
    assert by_sql([]) == []
