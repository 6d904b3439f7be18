import gzip

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from textloom import cli
from textloom.errors import InputOutputError, TokenizerError
from textloom.operators import tokenize, vocab
from textloom.operators.dedup import fnv1a
from textloom.operators.tokenize import Words
from textloom.plans.engine import Engine
from textloom.shared import store
from textloom.sources import text
from textloom.streaming.embed import embed_stream, read_stream
from textloom.streaming.monitor import watch

LINES = [
    '{"id":"a","text":"hello wide world"}',
    '{"id":5,"text":"second line here"}',
    "not json",
    '{"text":123}',
    '{"text":null}',
    '{"text":"   "}',
    "",
    '{"text":"123456789"}',
    '{"text":"1234567890"}',
    '{"text":"a","text":"duplicate key last"}',
    '{"id":"z","text":"carriage return line"}\r',
]


def write(folder):
    (folder / "sub").mkdir()
    (folder / "b.jsonl").write_text("\n".join(LINES) + "\n")
    (folder / "sub" / "a.jsonl.gz").write_bytes(gzip.compress(b'{"id":"g","text":"from a gzip file"}\n'))
    (folder / "c.jsonl.zst").write_bytes(zstandard.compress(b'{"id":"s","text":"from a zstd file"}\n'))
    return f"file://{folder}"


def test_jsonl(spark, tmp_path):
    path = write(tmp_path)
    files = text.resolve_inputs(spark, [path, f"{path}/b.jsonl"])
    assert [f.rpartition("/")[2] for f in files] == ["b.jsonl", "c.jsonl.zst", "a.jsonl.gz"]
    parsed = text.parse_jsonl(text.read_lines(spark, [f"{path}/b.jsonl"]))
    assert text.input_stats(parsed).first().asDict() == {"lines": 10, "malformed": 4, "short": 1, "accepted": 5}
    got = [tuple(r) for r in text.read_messages(spark, [path]).orderBy("seq").collect()]
    assert got == [(0, "a", "hello wide world"), (1, "", "second line here"), (2, "", "1234567890"), (3, "", "duplicate key last"), (4, "z", "carriage return line"), (5, "s", "from a zstd file"), (6, "g", "from a gzip file")]
    assert text.read_messages(spark, [path], limit=2).count() == 2
    with pytest.raises(InputOutputError):
        text.resolve_inputs(spark, [f"{path}/none"])
    assert text.resolve_inputs(spark, [f"{path}/none"], missing="ignore") == []
    with pytest.raises(InputOutputError):
        text.validate_jsonl(text.read_lines(spark, [f"{path}/b.jsonl"]))
    assert text.validate_jsonl(text.read_lines(spark, [f"{path}/sub"])) == 1


def test_plain(spark, tmp_path):
    (tmp_path / "x.txt").write_text("  first long line \n\n \nshort\nsecond long line\n")
    got = [tuple(r) for r in text.read_messages(spark, [f"file://{tmp_path}"], "plain").orderBy("seq").collect()]
    assert got == [(0, "0", "first long line"), (1, "1", "second long line")]


def test_dense_seq(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, None) for i in range(1000)], "k long, v string").repartition(7)
    got = sorted((r.seq, r.k) for r in text.dense_seq(df, "k").collect())
    assert got == [(i, i) for i in range(1000)]
    assert text.dense_seq(df.where("k < 0"), "k").collect() == []


def test_conversions(spark):
    df = spark.createDataFrame([("T", "body text"), ("", "only body"), (None, "no title")], "title string, text string")
    assert [r.x for r in df.select(text.with_title(df.title, df.text).alias("x")).collect()] == ["T. body text", "only body", "no title"]
    df = spark.createDataFrame([("d", " " + "x" * 50 + " "), ("e", "short")], "docid string, text string")
    assert [r.text for r in text.passages(df, "text").collect()] == ["passage: " + "x" * 50]
    assert text.renamed_corpus(df).columns == ["id", "text"] and text.posts(df, "text", most=5).count() == 1


class Letters:
    """A tokenizer of single letters."""

    def token_to_id(self, t):
        return {"<s>": 7}.get(t)

    def get_vocab(self):
        return {"▁ab": 1, "cd": 2, "e": 3, "▁" + "x" * 45: 4, "▁" + "x" * 46: 6, "12": 5}

    def encode_batch(self, words, add_special_tokens=False):
        return [self.encode(w) for w in words]

    def encode(self, s, add_special_tokens=False):
        if "!" in s:
            raise ValueError(s)
        return type("E", (), {"ids": [ord(c) for c in s if c != "▁"]})


def test_first_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_text("".join(f"line {i}\n\n" for i in range(50)))
    path = f"file://{tmp_path}/x.txt"
    assert text.count_lines(spark, [path]) == 100
    out = text.first_rows(spark, path, 7, f"file://{tmp_path}/kept")
    assert sorted(r.value for r in spark.read.text(out).collect()) == [f"line {i}" for i in range(7)]
    assert text.first_rows(spark, path, 7, f"file://{tmp_path}/kept") == out


def test_vocab_files_and_tokenizer(spark, tmp_path):
    path = str(tmp_path / "v.bin")
    entries = {"▁ab": [1, 2], "▁é": [], "▁z": [9]}
    vocab.save(path, entries)
    assert vocab.load(path) == entries and vocab.count(path) == 3 and vocab.count(str(tmp_path / "none")) is None
    (tmp_path / "bad.bin").write_bytes(b"nonsense")
    with pytest.raises(TokenizerError):
        vocab.load(str(tmp_path / "bad.bin"))
    (tmp_path / "cut.bin").write_bytes(open(path, "rb").read()[:-3])
    with pytest.raises(TokenizerError):
        vocab.load(str(tmp_path / "cut.bin"))
    for batches in ([["ab cd cd no!", "no! ab"]], [["ab cd cd no!"], ["no! ab"]]):
        t = Words(Letters(), 8, entries)
        assert [ids for b in batches for ids in t(b)] == [[7, 1, 2, 99, 100, 99, 100, 2], [7, 3, 1, 2, 2]]
        assert (t.hits, t.runtime_hits, t.misses) == (3, 1, 2) and t.hit_rate == 0.6
    assert Words(Letters(), 8, entries)(["", "é é é", "ab ab ab ab"]) == [[7, 2], [7, 2], [7, 1, 2, 1, 2, 1, 2, 2]]
    assert set(vocab.from_tokenizer(Letters())) == {"▁ab", "cd", "▁" + "x" * 45}
    df = spark.createDataFrame([("Ab ab 12 cd",), ("ab 7 cd ef",)], "text string")
    assert [tuple(r) for r in vocab.top_words(df, most=2).collect()] == [("ab", 3), ("cd", 2)]
    assert set(vocab.from_corpus(df, Letters(), most=2)) == {"▁ab", "▁cd"}
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    path = write(tmp_path / "in")
    assert cli.main(["embed", "--input", path, "--output", f"file://{tmp_path}/o.npy"]) == 0
    assert np.load(tmp_path / "o.npy").shape == (6, 8)
    assert "embedded 6, skipped 1" in capsys.readouterr().out
    assert cli.main(["embed", "--input", f"{path}/none", "--quiet"]) == 2
    arrivals = ["stream", "--input", f"file://{tmp_path}/in/*", "--output", f"file://{tmp_path}/s", "--state", f"file://{tmp_path}/st"]
    assert cli.main(arrivals) == 0 and spark.read.parquet(f"file://{tmp_path}/s").count() > 0


def test_stream(spark, tmp_path):
    said = []
    monitor = watch(spark, said.append)
    (tmp_path / "in").mkdir()
    write(tmp_path / "in")
    for k in range(2):
        query = embed_stream(read_stream(spark, f"file://{tmp_path}/in/*"), Engine(), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
        query.awaitTermination()
        assert query.exception() is None
        if k == 0:
            first = spark.read.parquet(f"file://{tmp_path}/out").count()
            (tmp_path / "in" / "later.jsonl").write_text('{"id":"n","text":"a line that came later"}\n')
    rows = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert first == 7 and len(rows) == 8 and {r.id for r in rows if r.status == "ok"} >= {"a", "z", "s", "g", "n"}
    spark.streams.removeListener(monitor)
    assert monitor.total > 0 and any("rows" in x for x in said)


def test_unreadable_files_and_bytes(spark, tmp_path):
    import gzip

    whole = gzip.compress(b"".join(b'{"text":"line number %d of it"}\n' % i for i in range(5000)))
    (tmp_path / "cut.jsonl.gz").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "good.jsonl").write_bytes(b'{"text":"a good line"}\n{"text":"bad \xff\xfe bytes here"}\nnot json at all\n')
    path = f"file://{tmp_path}"
    with pytest.raises(Exception, match="(?i)eof|end of|corrupt|FAILED_READ_FILE"):
        text.read_messages(spark, [path]).count()
    got = text.read_messages(spark, [path], corrupt="skip")
    assert got.where("text = 'a good line'").count() == 1
    stats = text.input_stats(text.parse_jsonl(text.read_lines(spark, [f"{path}/good.jsonl"]))).first()
    assert (stats.lines, stats.malformed, stats.accepted) == (3, 2, 1)


@pytest.mark.parametrize("taken", [text.TAKEN_ROWS, 0])
def test_first_rows_by_order(spark, monkeypatch, taken):
    monkeypatch.setattr(text, "TAKEN_ROWS", taken)
    df = spark.createDataFrame([(i * 7919 % 1000, f"some text number {i}") for i in range(1000)], "k long, text string").repartition(5)
    assert sorted(r.k for r in text.first_of(df, 17, "k").collect()) == list(range(17))
    assert text.posts(df, "text", most=23).count() == 23 and text.posts(df, "text").count() == 1000
    assert "SinglePartition" not in text.posts(df, "text", most=23)._jdf.queryExecution().toString()


def test_lines_are_parsed_once(spark, tmp_path):
    write(tmp_path)
    parsed = text.parse_jsonl(text.read_lines(spark, [f"file://{tmp_path}/b.jsonl"]))
    good = parsed.where(parsed.ok & (F.octet_length("text") >= 10)).select("id", "text")
    assert good._jdf.queryExecution().optimizedPlan().toString().lower().count("parsejson") == 1
    assert good.count() == 5


def test_joined_tokens_make_texts_and_counts_once(spark, monkeypatch):
    """Dear texts are made once for a vocabulary that is joined, and a large one isn't sorted by one task."""
    monkeypatch.setattr(tokenize, "BROADCAST_WORDS", 1)
    monkeypatch.setattr(text, "TAKEN_ROWS", 1)
    monkeypatch.setattr(vocab, "TAKEN_ROWS", 1)
    made = spark.sparkContext.accumulator(0)
    rows = [(i, f"ab w{i % 7} cd zz") for i in range(50)]

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "k long, text string").mapInArrow(seen, "k long, text string")
    top = vocab.top_words(df, most=4)
    assert sorted(map(tuple, top.collect()), key=lambda r: (-r[1], r[0])) == [("ab", 50), ("cd", 50), ("zz", 50), ("w0", 8)] and made.value == 50
    assert "TakeOrdered" not in top._jdf.queryExecution().toString()
    known = store(top.select("word", F.array(F.lit(9)).alias("ids")), "known")
    made.value = 0
    got = {r.k: r.ids for r in tokenize.token_ids(df, known, key="k").collect()}
    assert got[0] == [0, 9, 9, 9, 9, 2] and got[1] == [0, 9, 3, 9, 9, 2] and len(got) == 50 and made.value == 50
