import math
import re
import zlib

import numpy as np
import pytest

from textloom.llm import lattice
from textloom.llm.lattice import Pieces

VOCAB = ["▁", "a", "b", "ab", "▁a", "ba", "▁ab", "bb", "c", "abc", "é", "▁é"]


def segmentations(word, logp, spell, longest):
    """Probability by listing every way to cut the marked word."""
    text = "▁" + word

    def go(i):
        if i == len(text):
            return 1.0
        total = 0.0
        for j in range(i + 1, min(len(text), i + longest) + 1):
            if text[i:j] in logp:
                total += math.exp(logp[text[i:j]]) * go(j)
        if text[i] not in logp:
            total += math.exp(spell - len(text[i].encode()) * math.log(256)) * go(i + 1)
        return total

    return math.log(go(0))


def weights(p):
    return {w: float(p.logp[np.searchsorted(p.keys, np.uint64(lattice._hash(w)))]) for w in VOCAB}


WORDS = ["a", "ab", "abab", "babbaab", "xyz", "aéb", "é", "😀a", "abcabc", "aaaaaaaaaaaa", "cab"]


def test_forward_sums_all_segmentations():
    p = Pieces.of(VOCAB)
    logp = weights(p)
    with np.errstate(over="ignore"):
        got = lattice.word_scores(WORDS, p)
    assert np.allclose(got, [segmentations(w, logp, p.spell, p.longest) for w in WORDS])
    assert abs(sum(np.exp(p.logp)) + math.exp(p.spell) + math.exp(p.end) - 1) < 1e-9


def test_long_words_agree():
    p = Pieces.of(VOCAB)
    words = ["abcé" * 16, "abcéx" * 100, "z" * 300, "a", "😀" * 30, "ab" * 20]
    with np.errstate(over="ignore", invalid="ignore"):
        for w in words:
            points = np.array([[0x2581, *map(ord, w)]], np.uint32)
            long, short = lattice.LongWord(points[0], p), lattice.Lattice(points, p)
            assert np.allclose(long.forward(), short.forward()[:, 0])
            one, two = np.zeros(len(VOCAB)), np.zeros(len(VOCAB))
            assert long.expected(3.0, one) == pytest.approx(short.expected(np.array([3.0]), two))
            assert np.allclose(one, two)
        assert lattice.LongWord(np.array([97] * 300_000, np.uint32), p).forward()[-1] < 0


def expected_weights(p, count, ends):
    """New weights from all segmentations of all training words, one by one."""
    logp = weights(p)
    use, spelled = dict.fromkeys(logp, 0.0), 0.0
    for w, c in count.items():
        total = segmentations(w, logp, p.spell, p.longest)

        def walk(i, sofar, uses, misses, text="▁" + w, total=total, c=c):
            nonlocal spelled
            if i == len(text):
                share = c * math.exp(sofar - total)
                spelled += share * misses
                for x in uses:
                    use[x] += share
                return
            for j in range(i + 1, min(len(text), i + p.longest) + 1):
                if text[i:j] in logp:
                    walk(j, sofar + logp[text[i:j]], [*uses, text[i:j]], misses)
            if text[i] not in logp:
                walk(i + 1, sofar + p.spell - len(text[i].encode()) * math.log(256), uses, misses + 1)

        walk(0, 0.0, [], 0)
    return p.reweighted(np.array([use[{lattice._hash(x): x for x in use}[int(k)]] for k in p.keys]), spelled, ends)


def brute(rows, vocab, rounds=1):
    """The whole model by its definition on a small table."""
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    train = [words(t) for d, t in rows if not held(d)]
    count = {}
    for ws in train:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(train), len(count) + bool(train)
    q = Pieces.of(vocab)
    for _ in range(rounds):
        q = expected_weights(q, count, len(train))
    logq = weights(q)
    out = []
    for d, t in rows:
        ws = words(t)
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in ws) + math.log10((len(train) + 1) / (n + v + 1))
        score = (sum(segmentations(w, logq, q.spell, q.longest) for w in ws) + q.end) / math.log(10)
        out.append((d, held(d), len(ws) + 1, sum(w in count for w in ws) + bool(train), n, base, score))
    return out


ROWS = [(i, " ".join(["ab", "ABAB", "cab\x0bx", "é", "abc"][: i % 5 + 1]) + f" w{i % 3}") for i in range(40)] + [(41, None), (42, ""), (43, " \n"), (None, "abba"), (1, "ab abab"), (44, "ab " * 5000)]


def same(got, want):
    key = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-6)


@pytest.mark.parametrize(("head", "rounds"), [(0, 1), (3, lattice.ROUNDS), (1000, 0)])
def test_matches_brute_force(spark, head, rounds):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, word string, n int").repartition(3)
    same(lattice.score(df, vocabulary=VOCAB, head_words=head, rounds=rounds).collect(), brute(ROWS, VOCAB, rounds))


def test_all_held_out_and_empty(spark):
    held = [d for d in range(60) if zlib.crc32(str(d).encode()) % 7 == 2]
    rows = [(d, "ab c") for d in held]
    same(lattice.score(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary=VOCAB, rounds=1).collect(), brute(rows, VOCAB))
    assert lattice.score(spark.createDataFrame([], "doc_id long, text string"), vocabulary=VOCAB).collect() == []


def test_driver_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lattice.score(df, head_words=2000).collect()
    assert len(got) == df.count() and all(r.score < 0 and r.base_score < 0 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -6
    again = lattice.score(df.repartition(5)).collect()
    assert sorted((r.doc_id, round(r.score, 5), round(r.base_score, 6)) for r in again) == sorted((r.doc_id, round(r.score, 5), round(r.base_score, 6)) for r in got)
    print("held out, log10 a token:", sum(r.score for r in held) / sum(r.n_tokens for r in held), "base", sum(r.base_score for r in held) / sum(r.n_tokens for r in held))


def test_scores_of_a_unigram_vocabulary_are_its_weights():
    """Log probabilities are kept in proportion; whole numbers are ranks and weighed by Zipf's law."""
    scored = {"a": -1.5, "b": -2.25, "ab": -0.75}
    p = Pieces.scored(scored)
    got = {w: float(p.logp[np.searchsorted(p.keys, np.uint64(lattice._hash(w)))]) for w in scored}
    assert all(got[w] - got["a"] == pytest.approx(scored[w] - scored["a"]) for w in scored)
    assert sum(math.exp(x) for x in got.values()) == pytest.approx(0.8)
    ranks = Pieces.scored({w: -float(i) for i, w in enumerate(VOCAB)})
    assert np.allclose(ranks.logp, Pieces.of(VOCAB).logp)
