

import corpus_pipeline
from test_similar import groups
from textloom.llm import decontam, mixing, quality, simhash

DIR = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    """Each stage, on what the one before kept, keeps what its operator's own verdicts say."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]
    q, d, c, m, s = (f for _, f in corpus_pipeline.STAGES)
    one = q(spark, docs, DIR).cache()
    assert one.columns == columns and ids(one) == sorted(r.doc_id for r in quality.judge(docs).collect() if r.kept)
    two = d(spark, one, DIR).cache()
    # Of the fingerprints' groups one stays, then one of the groups by five-word shingles, each the smallest id.
    first = {r.component_id for r in simhash.near_duplicates(one).collect()}
    left = sorted((r.doc_id, r.text) for r in one.where(one.doc_id.isin(*first)).collect())
    assert two.columns == columns and ids(two) == sorted({left[g][0] for g in groups([t for _, t in left])}) and len(ids(two)) < len(first)
    three = c(spark, two, DIR).cache()
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    assert three.columns == columns and ids(three) == sorted(r.doc_id for r in decontam.contamination(two, bench).collect() if not r.contaminated)
    assert 0 < three.count() < two.count() < docs.count()
    four = m(spark, three, DIR).cache()
    assert four.columns == columns and ids(four) == sorted(r.doc_id for r in mixing.mix(three).collect() for _ in range(r.copies))
    five = s(spark, four, DIR)
    assert ids(five) == ids(four)


def test_run(spark):
    got = sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect())
    assert got == sorted(r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()) and got


def test_stages_by_brute_force(spark, tmp_path):
    """Null and repeated ids, equal rows, empty texts, columns named like private ones: every stage row by row."""
    from test_decontam import brute as brute_hits
    from test_quality import brute_kept, prose
    from test_simhash import brute as brute_groups

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    menu = "\n".join(f"menu line {j} with some words in it for all pages here" for j in range(7))
    rows = [(i % 5 or None, prose(i), "ab"[i % 2]) for i in range(30)]
    rows += [(7, f"{menu}\nstub {i}", "a") for i in range(15)] + [(None, prose(90), "b")] * 4 + [(3, prose(90).upper(), "b")]
    rows += [(None, f"{prose(91)} {item}", "a"), (1, f"{prose(92)} {item}", None), (1, None, None), (None, "", "a"), (2, "too short", "b"), (None, prose(93, 4000), None)]
    df = spark.createDataFrame([(i, t, s, 1, "x", k % 2, 5) for k, (i, t, s) in enumerate(rows)], "doc_id long, text string, source string, n int, __id string, key0 int, copies int")
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("q1", item), (None, None)], "item_id string, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    d = f"{tmp_path}/in"
    plain = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)
    quality_, near, clean, mix, shard = (f for _, f in corpus_pipeline.STAGES)

    one = quality_(spark, df, d).cache()
    said = brute_kept([(s, t) for _, t, s in rows], 10, 0.005, 0.3)
    want = [r for r, v in zip(rows, said) if v[1]]
    assert one.columns == df.columns and plain(one) == sorted(want, key=str)

    two = near(spark, one, d).cache()
    # Groups by texts: ids of their own tell the rows apart for the brute force.
    groups = {}
    for (k, _, component), row in zip(sorted(brute_groups([(k, t) for k, (_, t, _) in enumerate(want)])), want):
        groups.setdefault(component, []).append(row)
    got = plain(two)
    assert two.columns == df.columns and len(got) == len(groups)
    least = [min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()]
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(least) and all(r in {x for g in groups.values() for x in g} for r in got)

    three = clean(spark, two, d).cache()
    hit = lambda t: brute_hits([(0, t)], [("q1", item)])[0][5]
    assert plain(three) == [r for r in got if not hit(r[1])] and len(plain(three)) == len(got) - 2

    four = mix(spark, three, d).cache()
    words = lambda rs: {s: sum(len((t or "").split()) for _, t, x in rs if x == s) for s in {x for *_, x in rs}}
    goal = mixing.targets(words(plain(three)))
    assert four.columns == df.columns and set(plain(four)) <= set(plain(three))
    for s, n in words(plain(four)).items():
        assert abs(n - goal[s]) <= max(len(t.split()) for _, t, x in plain(three) if x == s)
    assert all(plain(four).count(r) <= 3 for r in plain(three))
    five = shard(spark, four, d)
    assert sorted(str(r.doc_id) for r in five.collect()) == sorted(str(r[0]) for r in plain(four))


def test_an_empty_table_goes_through(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
