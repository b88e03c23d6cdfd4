"""A language that is rare beside another keeps the contexts of its own tree."""

import random

import numpy as np

from bandwright.llm import langid
from tests.llm.test_operators import documents, sentence


def test_rare_languages_keep_their_contexts(spark):
    draw = random.Random(4)
    texts = [sentence(draw, 400) for _ in range(60)] + ["xxyy" * 20 for _ in range(10)] + ["".join(draw.choice("xy") for _ in range(80)) for _ in range(10)]
    langs = dict(enumerate(["big"] * 60 + ["period"] * 10 + ["random"] * 10))
    docs = documents(spark, list(enumerate(texts)), langs)
    got = langid.identify(docs, docs, contexts=16).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == langs


def test_kept_counts_are_whole_in_each_language(spark):
    draw = random.Random(5)
    texts = [sentence(draw, 50) for _ in range(6)]
    langs = {k: "ab"[k % 2] for k in range(6)}
    got = {(r["lang"], r["order"], r["code"]): r["n"] for r in langid.kept_counts(langid.gather_counts(documents(spark, list(enumerate(texts)), langs).coalesce(1), "text", "lang"), 9).collect()}
    expected = {}
    for lang in "ab":
        grams = [(langid.PAD + t.encode())[i : i + 4] for k, t in enumerate(texts) if langs[k] == lang for i in range(len(t))]
        codes, n = langid._tally(np.array([int.from_bytes(g, "big") for g in grams], np.uint32))
        for k in (1, 2, 3):
            cells, place = np.unique(codes.astype(np.int64) & ((1 << (8 * k + 8)) - 1), return_inverse=True)
            total = np.bincount(place, n)
            context, inverse = np.unique(cells >> 8, return_inverse=True)
            best = context[np.lexsort((context, -np.bincount(inverse, total)))[: 9 if k > 1 else None]]
            expected |= {(lang, k, int(c)): int(m) for c, m in zip(cells, total) if c >> 8 in best}
    assert got == expected and all(isinstance(m, int) for m in got.values())


def test_counts_do_not_depend_on_the_layout(spark):
    draw = random.Random(6)
    texts = [sentence(draw, draw.randint(0, 30)) for _ in range(60)] + ["", "a", "ab"]
    docs = documents(spark, list(enumerate(texts)), {k: "ab"[k % 2] for k in range(63)})
    counts = lambda df: {(r["lang"], r["code"]): r["n"] for r in langid.gather_counts(df, "text", "lang").collect()}
    one = counts(docs.coalesce(1))
    assert one == counts(docs.repartition(13)) and sum(one.values()) == sum(map(len, texts))


def test_a_text_longer_than_a_chunk_is_counted_and_coded_whole(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    text = sentence(random.Random(7), 200).encode()
    grams = [(langid.PAD + text)[i : i + 4] for i in range(len(text))]
    assert [int(g).to_bytes(4, "big") for g in langid.text_grams([text])] == grams
    codes, n = langid._tally(langid.text_grams([text]))
    model = langid.Model(["x"], np.zeros(len(codes), np.int8), codes, n, 1000)
    whole = model.lengths([text, b"ab"])
    monkeypatch.setattr(langid, "CHUNK", 1 << 19)
    assert np.allclose(whole, model.lengths([text, b"ab"]))


def test_numerals_are_no_letters():
    assert not any(langid.has_letter(t.encode()) for t in ("", "½ ² 12", "\u0661 \u2167", "!?"))
    assert all(langid.has_letter(t.encode()) for t in ("a", "é", "½ ñ", "中", "ª"))
