"""Each pipeline stage on nulls, repeats, ties, long texts and clashing columns, against what it must keep."""

import random
from collections import Counter

import corpus_pipeline
from bandwright.llm import sharding
from tests.llm.test_operators import sentence

STAGE = dict(corpus_pipeline.STAGES)
KINDS = "doc_id long, text string, lang string, source string, n_chars long, __row long, __copy int, place string, size string, rank int, id string, row string"


def odd_documents(spark):
    draw = random.Random(21)
    texts = [sentence(draw, 60) for _ in range(12)]
    rows = [(k, t, "en", ("a", "b", None)[k % 3]) for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], "en", "a"), (20, texts[2], None, "b"), (20, sentence(draw, 60), "en", ""), (21, sentence(draw, 20_000), "en", "a")]
    rows += [(30, None, "en", "a"), (31, "", None, None), (None, None, None, None), (32, "12 34 !?", "en", "b")]
    return spark.createDataFrame([(*r, None if k % 2 else k, 7, 8, "p", "s", 9, "i", "r") for k, r in enumerate(rows)], KINDS)


def given(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def test_each_stage_on_odd_rows(spark, tmp_path):
    docs = odd_documents(spark)
    rows = docs.collect()
    by = {r["doc_id"]: r["text"] for r in rows}
    items = [(1, by[3]), (None, " ".join(by[4].split()[10:40])), (2, None), (3, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = lambda name: STAGE[name](spark, docs, str(tmp_path))

    got = {name: run(name) for name in STAGE}
    for name in list(STAGE)[:-1]:
        assert got[name].columns == docs.columns and [f.dataType for f in got[name].schema] == [f.dataType for f in docs.schema], name

    lettered = [r for r in rows if r["text"] and any(map(str.isalpha, r["text"]))]
    assert given(got["language ID"].collect()) == given(lettered)  # one language: all with a letter are sure

    once = given(got["SimHash near-dedup"].collect())
    assert all(n == 1 for n in once.values()) and Counter(t for _, t in once) == Counter({t: 1 for t in {r["text"] or "" for r in rows if r["text"]}} | {next(t for i, t in once if i == 30): 1})
    assert (1, by[1]) in once and (2, by[2]) in once  # the smallest id stays, null ids last

    clean = [r for r in rows if r["text"] not in (by[3], by[4])]
    assert given(got["benchmark decontamination"].collect()) == given(clean)

    mixed = given(got["mixing sources"].collect())
    assert all(t and t.strip() for _, t in mixed) and all(n <= 3 * given(rows)[k] for k, n in mixed.items())
    assert given(run("mixing sources").collect()) == mixed

    dealt = got["sharding"].collect()
    assert sorted(map(repr, (tuple(r)[:-2] for r in dealt))) == sorted(map(repr, map(tuple, rows)))
    each = Counter(r["shard"] for r in dealt)
    assert max(each.values()) - min(each.values()) <= 1 and all(sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(n)) for s, n in each.items())


def test_shards_keep_columns_that_clash(spark):
    names = ["doc_id", "source", "place", "__spot", "__hash", "__size", "__stratum", "__total", "__f", "__s", "__place", "a.b", "shard"]
    df = spark.createDataFrame([(k, "x", *[f"{c}{k}" for c in names[2:]]) for k in range(40)], "doc_id long, source string, " + ", ".join(f"`{c}` string" for c in names[2:]))
    got = sharding.interleave(df, "source", ["doc_id"], 4)
    assert got.columns == [*names[:-1], "shard", "slot"]
    assert all(r[c] == f"{c}{r['doc_id']}" for r in got.collect() for c in names[2:-1])
    assert sharding.sharded_rows(df, "source", 4).columns == got.columns
