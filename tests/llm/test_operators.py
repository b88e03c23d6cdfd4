"""Each operator against brute force on small rows, with nulls, empties, ties, repeats, no rows and clashing columns."""

import hashlib
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash

from bandwright.llm import decontam, langid, mixing, nndescent, quality, sharding, simhash, suffixes, urls, warc

DOCS = "doc_id long, text string, lang string, source string, size long, id long, row long"


def sentence(draw, n):
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7))) for _ in range(n))


def documents(spark, texts, langs=None, sources=None):
    rows = [(k, t, (langs or {}).get(k, "en"), (sources or {}).get(k, "s"), -1, -2, -3) for k, t in texts]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(1)
    base = [sentence(draw, n) for n in (300, 250, 40, 3, 1, 120)]
    near = base[0].split()
    near[150] = "changed"
    out = base + [base[0], " ".join(near), "", None, base[1] + " " + base[0][:900], base[5].upper(), "   ", sentence(draw, 4000)]
    return list(enumerate(out))


# 1


def test_urls_rules_and_model(spark):
    rules = [urls.Rule("com", "/en/", False), urls.Rule("example.com", "/en/7", True)]
    given = ["http://A.Example.com/en/71?x", "http://b.com/en/2", "http://notexample.com/en/7", "https://example.com", None, "", "no scheme", "http://x.org/en/7#y://z", "http://com/en/"]
    pages = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(given)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages, rules).collect()}
    assert (got[0]["host"], got[0]["path"], got[0]["rule"], got[0]["verdict"]) == ("a.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[1]["rule"] == "com/en/" and got[1]["verdict"] == "block"
    assert got[2]["rule"] == "com/en/"
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("example.com", "", None)
    assert all((got[k]["host"], got[k]["path"], got[k]["rule"], got[k]["verdict"]) == ("", "", None, "allow") for k in (4, 5, 6))
    assert (got[7]["host"], got[7]["path"]) == ("x.org", "/en/7") and got[8]["rule"] == "com/en/"
    assert urls.filter_urls(pages.limit(0), rules).count() == 0


def test_url_ratio_is_that_of_the_two_models(spark):
    taught = [("aab", True), ("abb", True), ("bba", False), ("bbbb", False)]
    codes = urls.symbols(urls.F.col("u"))
    model = urls.ratio_model(spark.createDataFrame(taught, "u string, allow boolean").select(codes.alias("codes"), "allow"))
    got = {r["u"]: r["score"] for r in urls.scores(spark.createDataFrame([("ab",), ("ba",)], "u string").select("u", codes.alias("codes")), model).collect()}

    def probability(side, text, k):
        grams = [("~~~" + t)[i : i + 4] for t, allow in taught if allow == side for i in range(len(t))]
        context, p = ("~~~" + text)[k : k + 3], 1 / urls.SYMBOLS
        for order in range(4):
            tail = context[3 - order :]
            after = Counter(g[3] for g in grams if g[3 - order : 3] == tail)
            if after:
                n, q = sum(after.values()), len(after)
                p = (after[text[k]] + q * p) / (n + q)
        return p

    for text, score in got.items():
        want = np.mean([np.log2(probability(True, text, k) / probability(False, text, k)) for k in range(len(text))])
        assert abs(want - score) < 1e-5


# 2


def test_warc_round_trip(spark, tmp_path):
    long = "ä\r\n\r\nWARC/1.1\r\n" * 3000
    given = [(5, "u", "x" * 200), (3, None, "x" * 200), (9, "u", "x" * 200), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (7, "a\r\nb", long), (8, "u", long), (8, "u", long), (None, "u", "x" * 200), (6, "u", "")]
    pages = spark.createDataFrame([(*g, "kept") for g in given], "page_id long, url string, html string, digest string")
    got = warc.archive_digests(pages, segment_bytes=1000, path=str(tmp_path / "w")).collect()
    want = []
    for k, _, html in given:
        data = (html or "").encode()
        head = min(x[0] for x in given if x[2] == html and x[0] is not None) if len(data) >= 100 else None
        revisit = head is not None and k != head
        want.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", head if revisit else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert warc.archive_digests(pages.limit(0), path=str(tmp_path / "e")).count() == 0


def test_warc_long_and_alike_rows(spark, tmp_path):
    long = "0123456789é" * 300_000
    rows = [(1, "u", long), (2, "u", long), *[(None, "u", "n" * 150)] * 30, (3, "u", long + "x")]
    got = sorted(map(tuple, warc.archive_digests(spark.createDataFrame(rows, "page_id long, url string, html string"), path=str(tmp_path / "l")).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(1, 3_600_000, sha(long), "response", None), (2, 3_600_000, sha(long), "revisit", 1), (3, 3_600_001, sha(long + "x"), "response", None), *[(None, 150, sha("n" * 150), "response", None)] * 30]
    assert got == sorted(want, key=repr)


def test_warc_faults():
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc")
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")
    assert warc.dechunk(b"3\r\nabc\r\n1;x=y\r\nd\r\n0\r\n\r\n") == b"abcd"


# 3


def test_targets_and_exact_fit():
    t = mixing.share_targets([("b", 10), ("a", 100), (None, 1000)], (5.0, 2.0, 1.0), 3.0)
    assert t["a"] == 300 and t["b"] == 30 and t[None] == 780
    draw = np.random.default_rng(0)
    for _ in range(60):
        length, count = np.unique(draw.integers(1, 30, 6)), None
        count = draw.integers(1, 5, len(length))
        budget = int(draw.integers(0, (length * count).sum() + 3))
        take = mixing.fit_counts(length, count, budget)
        reach = {0}
        for n, c in zip(length, count):
            reach = {r + n * k for r in reach for k in range(c + 1)}
        assert (take <= count).all() and (take >= 0).all()
        if budget <= 2 * length.max():  # all of it is the knapsack's
            assert (take * length).sum() == max(r for r in reach if r <= budget)
        base = np.where(budget >= (length * count).sum(), count, mixing.proportional_part(length, count, min(budget, int((length * count).sum()))))
        rest = {int((base * length).sum())}
        for n, c in zip(length, count - base):
            rest = {r + n * k for r in rest for k in range(c + 1)}
        assert (take * length).sum() == max(r for r in rest if r <= budget)


def test_one_law_at_every_size():
    draw = np.random.default_rng(1)
    for scale in (1, 50, 5000):
        length = np.unique(draw.integers(1, 40 * scale, 60))
        count = draw.integers(1, 2000, len(length))
        budget = int((length * count).sum() * 0.37)
        take = mixing.fit_counts(length, count, budget)
        assert (take * length).sum() == budget and (np.abs(take / count - 0.37) < 0.05 + 3 / count).mean() > 0.9


def test_mix_meets_targets(spark, texts):
    rows = [(k, t) for k, t in texts] * 3 + [(None, "a b c")]
    docs = documents(spark, rows, sources={0: "b", 1: None, 2: "b"})
    got = mixing.mix(docs, per_bucket=4).collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        taken, size = sum(r["size"] * r["times"] for r in own), sum(r["size"] for r in own)
        assert own[0]["source_size"] == size and abs(taken - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(r["times"] <= 3 for r in own)
    want = {k: len((t or "").encode().split()) for k, t in texts}
    assert all(r["size"] == want[r["id"]] for r in got if r["id"] is not None)
    assert rows_of(mixing.mix(docs, per_bucket=4)) == rows_of(mixing.mix(docs, per_bucket=4))
    assert mixing.mixed_rows(docs).count() == sum(r["times"] for r in mixing.mix(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0


# 4


def test_quality_learns_order(spark):
    draw = random.Random(3)
    texts = [(k, sentence(draw, 60) if k % 2 else "| # ".join(["spam"] * 40)) for k in range(120)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(120)] + [(999, 1, 0), (5, None, 0)], "doc_id long, quality int, text int")
    got = {r["doc_id"]: r for r in quality.bradley_terry(documents(spark, texts), labels).collect()}
    assert all(got[k]["predicted"] == k % 2 for k in range(120))
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.7) == (r["predicted"] == 1) for r in got.values())
    assert got[200]["score"] == got[201]["score"]
    assert quality.bradley_terry(documents(spark, texts).limit(0), labels).count() == 0
    assert quality.bradley_terry(documents(spark, texts), labels.limit(0)).count() == len(texts)


def test_weights_are_the_best_of_the_logistic_loss():
    draw = np.random.default_rng(6)
    x = draw.normal(size=(300, 4))
    good = x @ [1.0, -2.0, 0.5, 0.0] + draw.normal(size=300) > 0
    weight = quality.fit_pairs(x, good, 4000, 1e-2, 1)
    again = np.random.default_rng(1)
    diff = x[again.choice(np.flatnonzero(good), 4000)] - x[again.choice(np.flatnonzero(~good), 4000)]
    loss = lambda w: np.log1p(np.exp(-diff @ w)).mean() + 0.005 * w @ w
    w = np.zeros(4)
    for _ in range(4000):  # plain descent
        p = 1 / (1 + np.exp(diff @ w))
        w = w + 0.3 * ((diff * p[:, None]).mean(0) - 1e-2 * w)
    assert np.allclose(weight, w, atol=1e-4)
    assert all(loss(weight) <= loss(weight + 0.01 * d) for d in np.vstack([np.eye(4), -np.eye(4)]))


def test_quality_of_repeated_rows_and_null_ids(spark):
    draw = random.Random(5)
    texts = [(k, sentence(draw, 50) if k % 2 else "| # ".join(["spam"] * 30)) for k in range(60)]
    odd = [(None, texts[1][1]), (None, None), (3, texts[3][1]), (3, texts[3][1]), (70, sentence(draw, 40_000))]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = quality.bradley_terry(documents(spark, texts + odd), labels).collect()
    assert len(got) == 65 and sum(r["doc_id"] is None for r in got) == 2 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert all(not r["held_out"] for r in got if r["doc_id"] is None) and all(0 <= r["score"] <= 1 for r in got)


# 5


def test_shards_are_even_and_mixed(spark):
    rows = [(k % 50, None if k % 7 == 0 else "big" if k % 3 else "small", "x") for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, place string")
    got = sharding.interleave(df, "source", ["doc_id"], 16, per_bucket=20).collect()
    count = Counter(r["shard"] for r in got)
    assert set(count) == set(range(16)) and max(count.values()) - min(count.values()) <= 1
    for shard in count:
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(count[shard]))
    for source in {r[1] for r in rows}:
        each = Counter(r["shard"] for r in got if r["source"] == source)
        assert max(each[s] for s in range(16)) - min(each[s] for s in range(16)) <= 2
    assert sharding.interleave(df.limit(0), "source", ["doc_id"], 16).count() == 0
    assert sharding.sharded_rows(df, "source", 16).count() == 500


def test_shards_are_those_of_a_plain_ranking(spark):
    draw = random.Random(4)
    rows = [(None if k % 31 == 0 else k % 90, draw.choice(["p", "q", "q", "q", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumn("h", sharding.F.xxhash64(sharding.F.lit(42), "doc_id"))
    hashed = [tuple(r) for r in df.collect()]
    unsigned = lambda h: h % (1 << 64)
    names, placed = sorted({s for _, s, _ in hashed if s}) + [None], []
    for stratum, name in enumerate(names):
        own = sorted((r for r in hashed if r[1] == name), key=lambda r: (unsigned(r[2]) >> 24, r[2], r[0] is not None, r[0] or 0))
        placed += [(int((k + 0.5) / len(own) * (1 << 40)), stratum, k, r[0], name) for k, r in enumerate(own)]
    want = [(i, s, 16 * k // 400) for k, (_, _, _, i, s) in enumerate(sorted(placed, key=lambda p: p[:3]))]
    got = [(r["doc_id"], r["source"], r["shard"]) for r in sharding.interleave(df.drop("h"), "source", ["doc_id"], 16, per_bucket=30).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# 6


def test_masks_find_any_two_substitutions():
    for bad in combinations(range(decontam.WINDOW), 2):
        assert any(all(p + k not in bad for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(decontam.WINDOW - len(m) + 1))


def test_contaminated_against_brute_force(spark, texts):
    draw = random.Random(5)
    items = [(k, sentence(draw, n)) for k, n in enumerate((30, 20, 8, 3))] + [(9, None), (10, "")]
    given = []
    for k, (_, item) in enumerate(items[:4]):
        words = item.split()
        swapped = [w if i % 6 else "other" for i, w in enumerate(words)]
        broken = [w if i % 3 else "other" for i, w in enumerate(words)]
        for j, part in enumerate((words, swapped, broken, words[:10])):
            given.append((100 + 10 * k + j, sentence(draw, 30) + " " + ", ".join(part).upper() + " " + sentence(draw, 30)))
    docs = documents(spark, given + texts + [(None, items[0][1])])
    bench = spark.createDataFrame(items, "item_id long, text string")

    def overlaps(doc, item):
        d, t = decontam.tokens((doc or "").encode()), decontam.tokens((item or "").encode())
        width = min(decontam.WINDOW, len(t))
        if width < decontam.SHORTEST:
            return False
        need = width - {8: 1, 13: 2}[width]
        return any(sum(d[i + k] == t[j + k] for k in range(width)) >= need for i in range(len(d) - width + 1) for j in range(len(t) - width + 1))

    small = [r for r in given + texts if len((r[1] or "").split()) < 1000]
    want = {(k, i) for k, t in small for i, x in items if overlaps(t, x)}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert {g for g in got if g[0] is not None} == want and (None, 0) in got
    blocks = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench, block_bytes=100).collect()}
    assert blocks == got
    assert decontam.drop_contaminated(docs, bench).count() == docs.count() - len({k for k, _ in got})
    assert decontam.contaminated(docs.limit(0), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_short_items_with_substitutions_against_brute_force():
    """Every item of 1 to 16 tokens, every choice of up to three substitutions in it: found just if the law says so."""
    reach = {n: max(k for k in range(n // 5 + 1) if all(any(all(p + at not in bad for at, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(n - len(m) + 1)) for bad in combinations(range(n), k))) for n in range(5, 14)}
    assert [decontam.sure_substitutions(n) for n in reach] == list(reach.values()) and reach[5] == 0 and reach[13] == 2
    for n in range(1, 17):
        item = [f"w{k}" for k in range(n)]
        index = decontam.Index([(0, " ".join(item).encode())])
        texts, want = [], []
        for k in range(4):
            for bad in combinations(range(n), k):
                texts.append((" ".join(["before", *("x" if i in bad else w for i, w in enumerate(item)), "after"])).encode())
                width = min(n, decontam.WINDOW)
                equal = max(sum(i not in bad for i in range(a, a + width)) for a in range(n - width + 1))
                want.append(n >= 5 and equal >= width - reach[width])
        found = {r for r, _, _ in index.hits(texts)}
        assert found == {r for r, w in enumerate(want) if w}, n


def test_tokens_beyond_ascii(spark):
    assert decontam.tokens("“Été”, déjà—vu…".encode()) == [w.encode() for w in ("été", "déjà", "vu")]
    assert decontam.tokens("東京は大きい。Tokyo is".encode()) == [w.encode() for w in (*"東京は大きい", "tokyo", "is")]
    assert decontam.tokens(b"\xff\xfe a") == ["\ufffd\ufffd".encode(), b"a"] and decontam.tokens(None) == []
    item = "富士山は日本で一番高い山であり静岡県にある"
    bench = spark.createDataFrame([(1, item), (2, "그것은 정말로 좋은 아침 이었다 모두에게")], "item_id long, text string")
    docs = documents(spark, [(0, "前文" + item[:6] + "国" + item[7:] + "後文"), (1, "前文" + item[:8] + "後文"), (2, "“그것은 정말로 좋은 아침 이었다 모두에게”")])
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()} == {(0, 1), (2, 2)}


def test_items_of_any_id_and_very_common_seeds(spark, monkeypatch):
    common = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(f"i{k}", common + f" tail{k}") for k in range(40)] + [(None, "alpha beta gamma delta epsilon"), ("", "zeta eta theta iota kappa")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = documents(spark, [(0, "so " + common + " end"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "none of it")])
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert got == {(0, f"i{k}") for k in range(40)} | {(1, None), (1, "")}
    index = decontam.Index([(i, t.encode()) for i, t in items])
    text = [("so " + common).encode()] * 3
    assert sorted(index.hits(text, step=7)) == sorted(index.hits(text))


# 7


def stripped(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[p : p + length] for x in data for p in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[x[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_against_brute_force(spark, texts):
    draw = random.Random(8)
    passage = sentence(draw, 100)
    more = [(50 + k, sentence(draw, 20) + passage[k * 7 :] + "é" * k + sentence(draw, 30)) for k in range(6)] + [(60, "ab" * 900), (61, "a" * 401), (62, passage[:399])]
    given = texts + more
    want = stripped([t for _, t in given], 400)
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(documents(spark, given)).collect()}
    assert got == {k: w for (k, _), w in zip(given, want)}
    twice = given[:3] + given[:1] + [(None, given[1][1])]
    want = sorted((repr(k), *w) for (k, _), w in zip(twice, stripped([t for _, t in twice], 400)))
    assert sorted((repr(r["doc_id"]), *tuple(r)[1:]) for r in suffixes.remove_repeats(documents(spark, twice)).collect()) == want
    assert suffixes.remove_repeats(documents(spark, given).limit(0)).count() == 0


def test_a_cover_has_every_difference():
    for most in (7, 13, 33, 133, 400):
        period, residues = suffixes.difference_cover(most)
        assert period <= most and {(i - j) % period for i in residues for j in residues} == set(range(period))
    with pytest.raises(ValueError):
        suffixes.difference_cover(6)


@pytest.mark.parametrize("length", [20, 64, 150])
def test_repeats_of_other_lengths_and_ids(spark, length, monkeypatch):
    draw = random.Random(length)
    parts = [sentence(draw, 40)[: draw.randint(length // 2, 3 * length)] for _ in range(12)]
    given = ["".join(draw.choice(parts) + sentence(draw, 3) for _ in range(draw.randint(0, 6))) for _ in range(40)]
    ids = ["1", "01", "x", None, *[f"k{k}" for k in range(36)]]
    df = spark.createDataFrame(list(zip(ids, given)), "doc_id string, text string")
    got = sorted(((r["doc_id"], *tuple(r)[1:]) for r in suffixes.remove_repeats(df, length=length).collect()), key=repr)
    assert got == sorted(((i, *w) for i, w in zip(ids, stripped(given, length))), key=repr)


def test_repeats_of_long_periodic_texts_across_chunks(spark, monkeypatch):
    noise = sentence(random.Random(2), 300)
    given = ["a" * 2_000_000, "ab" * 700_000 + noise, noise[:500] + "c" * 900_000, "b" + "a" * 1000]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.remove_repeats(documents(spark, list(enumerate(given)))).collect()}
    for k, text in enumerate(given):  # all strings of the periodic parts repeat; the noise that two texts share has 500 bytes
        removed = {0: 2_000_000, 1: 1_400_000 + 500, 2: 900_500, 3: 1000}[k]
        kept = {0: "", 1: noise[500:], 2: "", 3: "b"}[k]
        if k in (0, 3):
            assert got[k] == (len(text), removed, 1, hashlib.sha256(kept.encode()).hexdigest())
        assert got[k][0] == len(text) and abs(got[k][1] - removed) <= 1


# 8


def test_fingerprint_by_its_definition():
    for text in ("", "one", "one Two", "A b\tc\nd  e", "x y z x y z x y z"):
        words = text.lower().split()
        parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        assert simhash.fingerprint(text.encode(), 3) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_trie_pairs_are_all_pairs():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 2**63, 300, dtype=np.uint64)
    x = np.unique(np.concatenate([x, x[:100] ^ np.uint64(5), x[:50] ^ np.uint64(1 << 40)]))[:, None]
    i, j = simhash.trie_pairs(x, None, 0, 2)
    want = {(a, b) for a in range(len(x)) for b in range(a + 1, len(x)) if int(x[a, 0] ^ x[b, 0]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_components_against_brute_force(spark, texts):
    given = texts + [(30, "same words here"), (31, "Same  words here"), (None, "same words here"), (30, "same words here")]
    got = simhash.simhash_components(documents(spark, given)).collect()
    fps = [simhash.fingerprint((t or "").encode(), 3) for _, t in given]
    label = list(range(len(given)))
    for _ in label:
        label = [min(label[b] for b in range(len(given)) if (fps[a] ^ fps[b]).bit_count() <= 2) for a in range(len(given))]
    least = {c: min(k for (k, _), m in zip(given, label) if m == c and k is not None) for c in label}
    want = [(k, f"{fp:016x}", least[c]) for (k, _), fp, c in zip(given, fps, label)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert simhash.simhash_components(documents(spark, given).limit(0)).count() == 0


def test_near_copies_leave_one(spark, texts):
    kept = {r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, texts)).collect()}
    assert {0, 1, 2, 3, 4, 5, 13} <= kept and not {6, 7, 11} & kept
    assert len(kept & {8, 9, 12}) == 1
    assert simhash.keep_one_of_each(documents(spark, texts).limit(0)).count() == 0
    split = {r["doc_id"] for r in simhash.keep_one_of_each(documents(spark, texts), per_group=1).collect()}
    assert split == kept


# 9


def test_links_against_brute_force(spark):
    draw = np.random.default_rng(4)
    centre = draw.standard_normal((12, 16))
    x = [c + 0.1 * draw.standard_normal(16) for c in centre for _ in range(20)] + [draw.standard_normal(16) for _ in range(60)]
    x += [x[0], x[0]]
    rows = [(k, [float(v) for v in vec], k % 2, 0.0) for k, vec in enumerate(x)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0] * 16, None), (904, [None] * 16, 1), (905, [], 1), (906, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame([*rows, *[(*o, 0.0) for o in odd]], "vec_id long, embedding array<double>, label int, sim double")
    got = {r["vec_id"]: tuple(r)[1:] for r in nndescent.near_duplicates(df).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    np.fill_diagonal(near, False)
    found = sum(got[k][0] for k in range(len(rows)))
    assert [got[k][0] for k in range(len(rows))] == near.sum(1).tolist() and found == near.sum()
    label = simhash.least_labels(len(rows), *np.nonzero(near))
    assert [got[k][1] for k in range(len(rows))] == label.tolist()
    assert all(got[k] == (0, k, True) for k, *_ in odd)
    assert nndescent.near_duplicates(df.limit(0)).count() == 0


def test_full_lists_are_counted_whole(spark):
    draw = np.random.default_rng(5)
    centre = draw.standard_normal((2, 32))
    x = [c + 0.05 * draw.standard_normal(32) for c in centre for _ in range(150)] + [draw.standard_normal(32) for _ in range(200)]
    df = spark.createDataFrame([(f"v{k:03d}", [float(v) for v in vec], "l") for k, vec in enumerate(x)], "vec_id string, embedding array<float>, label string")
    unit = np.array(x, np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(df).collect()}
    label = simhash.least_labels(len(x), *np.nonzero(near))
    assert got == {f"v{k:03d}": (int(near[k].sum()), f"v{label[k]:03d}") for k in range(len(x))}


# 10


def test_ppm_lengths_by_definition():
    taught = {"xx": [b"abcabcabd"], "yy": [b"cbacbacba", b"zz"]}
    langs, lang, code, n = sorted(taught), [], [], []
    for k, name in enumerate(langs):
        codes, counts = langid._tally(langid.text_grams(taught[name]))
        lang += [k] * len(codes)
        code += codes.tolist()
        n += counts.tolist()
    model = langid.Model(langs, np.array(lang), np.array(code, np.uint32), np.array(n), 1000)

    def bits(k, text):
        own = [(int(c).to_bytes(4, "big"), m) for c, m, w in zip(code, n, lang) if w == k]
        total = 0.0
        for i in range(len(text)):
            context, p = (langid.PAD + text)[i : i + 3], np.full(256, 1 / 256)
            for order in range(4):
                after = Counter()
                for g, m in own:
                    if g[3 - order : 3] == context[3 - order :]:
                        after[g[3]] += m
                if not after:
                    continue
                q, t = len(after), sum(after.values())
                fresh = np.array([0.0 if s in after else p[s] for s in range(256)])
                p = np.array([after[s] / (t + q) for s in range(256)]) + q / (t + q) * fresh / fresh.sum()
            total -= np.log2(p[text[i]])
        return total

    for text in (b"abcab", b"zzcba", b"", b"q\xff"):
        got = model.lengths([b"pad", text])[1]
        assert np.allclose(got, [bits(0, text), bits(1, text)], atol=1e-3)


def test_language_of_edge_cases(spark):
    draw = random.Random(6)
    word = {"aa": "abcdab", "bb": "wxyzwx"}
    texts = [(k, " ".join("".join(draw.choice(word[x]) for _ in range(5)) for _ in range(20))) for k in range(60) for x in [("aa", "bb")[k % 2]]]
    langs = {k: ("aa", "bb")[k % 2] for k in range(60)}
    odd = [(100, None), (101, ""), (102, "123 !?"), (103, "é"), (None, "abcd")]
    docs = documents(spark, texts + odd + texts[:1], langs)
    got = langid.identify(docs, langid.learn_rows(docs), carry=["size"]).collect()
    assert len(got) == len(texts) + len(odd) + 1
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == langs[k] for k in range(60))
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (100, 101, 102)) and by[103]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.learn_rows(docs)).count() == 0
