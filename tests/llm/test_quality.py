import re
from collections import Counter

import pytest

from textloom.llm import quality

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def brute_base(text):
    text = text or ""
    w = words(text)
    wins = Counter(zip(w, w[1:], w[2:]))
    inside = {j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def brute_kept(rows, min_docs, min_share, left_share):
    """rows: (host, text); the rule by its definition: distinct documents per host and normalised line."""
    norm = lambda x: " ".join(words(x)).encode().lower().decode()
    lines = {}
    for h, t in rows:
        lines[h, t] = Counter()
        for x in (t or "").split("\n"):
            if words(x):
                lines[h, t][norm(x)] += len(words(x))
    document = {(h, t): tuple(norm(x) for x in (t or "").split("\n") if words(x)) for h, t in rows}
    hosts = {}
    for (h, _), d in document.items():
        hosts.setdefault(h, set()).add(d)
    bad = {(h, x) for h, docs in hosts.items() for x in {x for d in docs for x in d} if sum(x in d for d in docs) > max(min_docs, min_share * len(docs))}
    out = []
    for h, t in rows:
        n, _, _, _, rep = brute_base(t)
        gone = sum(v for x, v in lines[h, t].items() if (h, x) in bad)
        failed = n < 50 or 100 * rep > 50 * n
        out.append((failed, not failed and n - gone >= left_share * n, gone))
    return out


def prose(i, n=80):
    return "\n".join(" ".join(f"w{i}x{j}y{k}" for k in range(10)) for j in range(n // 10))


MENU = "\n".join(f"menu line {j} with Some words in  it for all pages here" for j in range(6))
ROWS = (
    [("a", prose(i)) for i in range(40)]
    + [("a", prose(i) + "\n" + MENU) for i in range(40, 60)]
    + [("a", MENU.upper() + f"\nextra {i}") for i in range(6)]
    + [("a", prose(99) + f"\nchanged {i}") for i in range(50)]  # the host says these lines in 50 documents
    + [("b", prose(98))] * 20 + [("b", prose(98).upper().replace(" ", "\t "))] * 20  # copies are one document
    + [("b", MENU + f"\nextra {i}") for i in range(4)]  # few documents of this host hold it
    + [(None, prose(97)), (None, None), ("a", ""), ("a", " \n\n"), ("a", "abc " * 100), ("a", "one\none\none\n two # | <x>"), ("b", "é" * 20000 + " ü\x0bñ"), ("c", "x " * 60), ("c", prose(5, 4000))]
)
LIMITS = {"min_docs": 10, "min_share": 0.005, "left_share": 0.3}


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, h, "x", "y") for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string, host string, line string").repartition(3)


def check(spark, df, rows, limits):
    got = sorted(quality.judge(df, **limits).collect(), key=lambda r: r.doc_id)
    for r, (h, t), (failed, kept, gone) in zip(got, rows, brute_kept(rows, **limits), strict=True):
        assert tuple(r)[1:6] == brute_base(t)
        assert (r.base_failed, r.kept, r.n_removed_words) == (failed, kept, gone), (h, t and t[:60])
    return got


def test_matches_brute_force(spark):
    got = check(spark, frame(spark), ROWS, LIMITS)
    assert all(r.kept for r in got[:60]) and not any(r.kept for r in got[60:66]) and not any(r.kept for r in got[66:116]) and all(r.kept for r in got[116:156])


@pytest.mark.parametrize("limits", [LIMITS, {"min_docs": 1, "min_share": 0.0, "left_share": 0.8}])
def test_driver_table(spark, limits):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    rows = df.select("doc_id", "source", "text").collect()
    assert [r.doc_id for r in rows] == list(range(len(rows)))
    check(spark, df, [(r.source, r.text) for r in rows], limits)


def test_stub_pages_go_and_copies_stay(spark):
    menu = "\n".join(" ".join(f"menu{j}x{k}" for k in range(12)) for j in range(6))
    stubs = [("h", f"{menu}\nonly line of page {i}") for i in range(500)]  # shared lines are over 90 % of their words
    copies = [("h", prose(1))] * 40
    got = sorted(quality.judge(frame(spark, stubs + copies)).collect(), key=lambda r: r.doc_id)
    assert not any(r.kept or r.base_failed for r in got[:500]) and all(r.n_removed_words == 72 for r in got[:500])
    assert all(r.kept and not r.n_removed_words for r in got[500:])


def test_limits_are_exclusive(spark):
    """A line in exactly as many documents as the limit stays."""
    rows = [("h", f"{prose(i, 60)}\nshared line number one") for i in range(10)] + [("h", prose(i, 60)) for i in range(10, 30)]
    assert not any(r.n_removed_words for r in quality.judge(frame(spark, rows)).collect())
    more = [*rows, ("h", prose(77, 60) + "\nSHARED  line number one")]
    assert sum(r.n_removed_words for r in quality.judge(frame(spark, more)).collect()) == 11 * 4


def test_empty_nulls_repeats(spark):
    assert quality.judge(frame(spark, [])).collect() == []
    df = spark.createDataFrame([(None, prose(1), "a"), (None, prose(1), "a"), (1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert sorted((str(r.doc_id), r.kept) for r in quality.judge(df).collect()) == [("1", False), ("1", False), ("None", True), ("None", True)]
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 2
