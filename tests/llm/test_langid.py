import itertools
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from textloom.llm import langid


@pytest.mark.parametrize("block", [1, 2, 3, 100])
def test_forward_backward_is_exact(block):
    random = np.random.default_rng(1)
    sizes, k = np.array([1, 2, 5, 6, 3, 1]), 3
    s, a, start = random.normal(size=(sizes.sum(), k)), random.normal(size=(k, k)), random.normal(size=k)
    got = langid.forward_backward(s, sizes, a, start, block=block)
    at = 0
    for n in sizes.tolist():
        want = np.zeros((n, k))
        for y in itertools.product(range(k), repeat=n):
            w = np.exp(start[y[0]] + sum(s[at + t, y[t]] for t in range(n)) + sum(a[y[t - 1], y[t]] for t in range(1, n)))
            for t in range(n):
                want[t, y[t]] += w
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_gradient_is_that_of_the_likelihood():
    random = np.random.default_rng(2)
    s, a, start = random.normal(size=(2, 4, 3)), random.normal(size=(3, 3)), random.normal(size=3)

    def log_z(s, a):
        total = 0
        for seq in s:
            total += np.log(sum(np.exp(start[y[0]] + sum(seq[t, y[t]] for t in range(4)) + sum(a[y[t - 1], y[t]] for t in range(1, 4))) for y in itertools.product(range(3), repeat=4)))
        return total

    p, pair, _ = langid._expectations(s, a, start)
    step = 1e-5
    for i, t, k in itertools.product(range(2), range(4), range(3)):
        d = np.zeros_like(s)
        d[i, t, k] = step
        assert (log_z(s + d, a) - log_z(s - d, a)) / 2 / step == pytest.approx(p[i, t, k], abs=1e-6)
    for i, j in itertools.product(range(3), repeat=2):
        d = np.zeros_like(a)
        d[i, j] = step
        assert (log_z(s, a + d) - log_z(s, a - d)) / 2 / step == pytest.approx(pair[i, j], abs=1e-6)


def test_accuracy_on_held_out_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    rows = df.collect()
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    right = [got[r.doc_id].lang_pred == r.lang for r in held if got[r.doc_id].lang_pred != "und"]
    assert sum(right) / len(right) > 0.97
    again = {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in langid.identify(df.repartition(5)).collect()}
    assert again == {d: (r.lang_pred, round(r.score, 6)) for d, r in got.items()}


def test_code_switched_words(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").collect()]
    train, rest = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if i % 3 == 0]
    model = langid.train(train)
    pieces = [(lang, langid.words_of(text)[:40]) for lang, text in rest if len(langid.words_of(text)) > 60]
    right = total = 0
    for (x, a), (y, b) in zip(pieces, pieces[1:]):
        if x != y:
            got = model.label_words(" ".join(a + b))
            right += sum(g[1] == z for g, z in zip(got, [x] * len(a) + [y] * len(b)))
            total += len(a) + len(b)
    assert total > 500 and right / total > 0.93


def test_odd_rows(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", "de"), (102, "123 !!", None), (103, "the dog " * 20000, None), (None, "der hund", "de"), (3, "the cat", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "doc_id long, text string, lang string, score string").repartition(3)
    got = langid.identify(df).collect()
    by = {(str(r.doc_id), r.lang_pred) for r in got}
    assert len(got) == len(rows) + len(odd)
    assert {("100", "und"), ("101", "und"), ("102", "und"), ("103", "en"), ("None", "de")} <= by
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.where("doc_id < 0")).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"w{i} " * (1 + i % 3000), "hot" if i % 10 else "rare") for i in range(1000)], "doc_id long, text string, lang string")
    got = langid.sample(df, rows=7)
    assert sorted(x for x, _ in got) == ["hot"] * 7 + ["rare"] * 7 and all(len(t) <= langid.SAMPLE_CHARS for _, t in got)
    assert langid.sample(df.repartition(7), rows=7) == got


DE, EN = "der hund und die katze liegen im garten und schlafen", "the cat and the dog sleep in the garden all day"


@pytest.mark.parametrize("ids", ["null", "equal"])
def test_rows_without_own_ids_are_learned_from(spark, ids):
    rows = [(None if ids == "null" else 11, f"{(DE, EN)[i % 2]} {i}", ("de", "en")[i % 2]) for i in range(600)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert {r.lang_pred for r in got} == {"de", "en"}


def test_one_row_repeated_is_learned_from(spark):
    rows = [(None, (DE, EN)[i % 2], ("de", "en")[i % 2]) for i in range(600)]
    assert {r.lang_pred for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {"de", "en"}


def test_a_language_of_long_texts_is_learned(spark):
    rows = [(3 * i, f"{DE} " * 1000 if i % 2 else EN, "de" if i % 2 else "en") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert all(got[d] == lang for d, _, lang in rows)
    cut = dict(langid.sample(df))["de"]
    assert len(cut) <= langid.SAMPLE_CHARS and set(cut.split()) <= set(DE.split())


def test_query_by_brute_force(spark):
    """Labels and scores by the sum over all paths of a text's words, text by text, from the trained weights."""
    mix = (DE + " " + EN).split()
    rows = [(i, " ".join(mix[(7 * i + k) % len(mix)] for k in range(1 + i % 6)), ("de", "en")[i % 2]) for i in range(40)]
    df = spark.createDataFrame([*rows, (50, None, "de"), (51, "1 2", "en")], "doc_id long, text string, lang string")
    model = langid.train(langid.sample(df.where("crc32(cast(doc_id as string)) % 3 <> 1")))
    want = {}
    for r in df.collect():
        words = langid.words_of(r.text or "")
        if not words:
            want[r.doc_id] = ("und", 0.0)
            continue
        e, k, total = model.emissions(words), len(model.labels), 0.0
        share = np.zeros(k)
        for path in itertools.product(range(k), repeat=len(words)):
            p = np.exp(model.start[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(model.transitions[x, y] for x, y in zip(path, path[1:])))
            total += p
            for y in path:
                share[y] += p / len(words)
        want[r.doc_id] = (model.labels[int(share.argmax())], float(share.max() / total))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 1e-9 for d in want)
