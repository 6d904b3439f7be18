"""Language-model scores over the lattice of all subword segmentations.

A text is a row of words and an end. A word, with a mark in front, may be cut into pieces of an
existing vocabulary in many ways; its probability is the sum over all of them of the product of
the pieces' unigram probabilities, found by a forward recursion in log space. The vocabulary is
never trained. Its scores give the first weights (of a vocabulary that has merge ranks instead,
Zipf's law over the ranks); a few rounds of forward and backward recursions over the training words' lattices turn these into expected
counts of pieces, which the final weights are made of.

Every distinct word is scored once. The commonest words, a fixed number of them, go to every
task; the rest are joined, so that no table that grows with the corpus is held by a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_fold, store

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Commonest words, sent to every task.
HEAD_WORDS = 100_000
#: Distinct words that a task counts before it passes its counts on.
FLUSH_WORDS = 250_000
#: Rounds of expected counts.
ROUNDS = 3
#: Code points of a word that one step of the vectorised recursion takes; longer words go one by one.
LONG_WORD = 64
MARK = 0x2581
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
LN10 = math.log(10)


@dataclass
class Pieces:
    """A vocabulary with natural-log weights; what is no piece is spelled in bytes."""

    keys: np.ndarray  # sorted 64-bit polynomial hashes of the pieces' code points
    logp: np.ndarray  # by key
    spell: float  # weight of leaving the vocabulary for a code point
    end: float
    longest: int

    def __post_init__(self):
        self._some = np.zeros(1 << 20, bool)  # which leading 20 bits keys have: most strings fail here
        self._some[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``hashes``, numbers of the pieces there)."""
        likely = np.flatnonzero(self._some[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(likely):
            return likely, likely
        at = np.searchsorted(self.keys, hashes[likely])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == hashes[likely]
        return likely[hit], at[hit]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Pieces:
        """The pieces of a sentencepiece model with its scores."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [model.is_unknown, model.is_control, model.is_byte, model.is_unused]
        return cls.scored({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special)})

    @classmethod
    def scored(cls, scores: dict[str, float]) -> Pieces:
        """Weights in proportion to the scores' probabilities; scores that are whole numbers are ranks, as merges have them."""
        order = sorted((-s, p) for p, s in scores.items())
        if all(float(s).is_integer() for s in scores.values()):
            return cls.of([p for _, p in order])
        return cls.of([p for _, p in order], np.exp(np.array([-s for s, _ in order], float)))

    @classmethod
    def of(cls, pieces: list[str], weight: np.ndarray | None = None) -> Pieces:
        """``pieces``, each once, with ``weight``; without one, in the order of Zipf's law."""
        some = [i for i, p in enumerate(pieces) if p] if weight is not None else []
        pieces = [pieces[i] for i in some] if weight is not None else [p for p in dict.fromkeys(pieces) if p]
        weight = 1.0 / (np.arange(len(pieces)) + 2.7) if weight is None else weight[some]
        hashes = np.array([_hash(p) for p in pieces], np.uint64)
        order = np.argsort(hashes)
        # A tenth of the mass each for spelling and the end, until counts say better.
        logp = np.log(0.8 * weight / weight.sum()) if len(pieces) else np.zeros(0)
        return cls(hashes[order], logp[order], math.log(0.1), math.log(0.1), max(map(len, pieces), default=1))

    def reweighted(self, counts: np.ndarray, spelled: float, ends: float, prior: float = 1.0) -> Pieces:
        """Weights from expected counts, with ``prior`` counts a piece dealt by the weights so far."""
        counts = counts + prior * len(self.keys) * np.exp(self.logp) / max(1e-300, np.exp(self.logp).sum())
        total = counts.sum() + spelled + ends + 2 * prior
        with np.errstate(divide="ignore"):
            return Pieces(self.keys, np.log(counts / total), math.log((spelled + prior) / total), math.log((ends + prior) / total), self.longest)


def _hash(text: str) -> int:
    h = 0
    for c in text:
        h = (h * int(_SPREAD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _utf8_length(points: np.ndarray) -> np.ndarray:
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


class Lattice:
    """Arcs of words of one length, marks included: (words, places) code points."""

    def __init__(self, points: np.ndarray, pieces: Pieces):
        self.n, self.size = points.shape
        self.points, self.pieces = points, pieces
        prefix = np.zeros((self.size + 1, self.n), np.uint64)
        for j in range(self.size):
            prefix[j + 1] = prefix[j] * _SPREAD + points[:, j].astype(np.uint64) + np.uint64(1)
        self.arcs: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}  # (from, to) -> (words, piece numbers)
        power = np.uint64(1)
        single = np.zeros((self.size, self.n), bool)
        for k in range(1, min(pieces.longest, self.size) + 1):
            power = power * _SPREAD
            for i in range(self.size - k + 1):
                found, numbers = pieces.find(prefix[i + k] - prefix[i] * power)
                if len(found):
                    self.arcs[i, i + k] = (found, numbers)
                    if k == 1:
                        single[i, found] = True
        # Code points that are no piece: leave the vocabulary, then each byte alike.
        spelled = pieces.spell - _utf8_length(points).T * math.log(256)
        self.spelled = np.where(single, -np.inf, spelled)

    def forward(self) -> np.ndarray:
        alpha = np.full((self.size + 1, self.n), -np.inf)
        alpha[0] = 0
        for j in range(1, self.size + 1):
            terms = alpha[j]
            terms[:] = alpha[j - 1] + self.spelled[j - 1]
            for i in range(max(0, j - self.pieces.longest), j):
                if (arc := self.arcs.get((i, j))) is not None:
                    words, at = arc
                    terms[words] = np.logaddexp(terms[words], alpha[i, words] + self.pieces.logp[at])
        return alpha

    def expected(self, weight: np.ndarray, counts: np.ndarray) -> float:
        """Add each piece's expected uses, times the words' ``weight``, to ``counts``; returns those of spelling.

        Products of probabilities where they fit a double, which short words' do; words whose
        product vanishes are taken again in log space.
        """
        gain = np.exp(self.pieces.logp)
        alone = np.exp(self.spelled)
        ends: list[list[int]] = [[] for _ in range(self.size + 1)]
        for i, j in self.arcs:
            ends[j].append(i)
        alpha = np.zeros((self.size + 1, self.n))
        alpha[0] = 1
        for j in range(1, self.size + 1):
            terms = alpha[j]
            np.multiply(alpha[j - 1], alone[j - 1], out=terms)
            for i in ends[j]:
                words, at = self.arcs[i, j]
                terms[words] += alpha[i, words] * gain[at]
        beta = np.zeros_like(alpha)
        beta[self.size] = 1
        for j in range(self.size, 0, -1):  # every arc into j has its end's message by now
            beta[j - 1] += beta[j] * alone[j - 1]
            for i in ends[j]:
                words, at = self.arcs[i, j]
                beta[i, words] += beta[j, words] * gain[at]
        total = alpha[self.size]
        scale = np.where(total > 1e-280, weight / np.maximum(total, 1e-280), 0.0)
        if self.arcs:
            ats, shares = zip(*((at, alpha[i, words] * gain[at] * beta[j, words] * scale[words]) for (i, j), (words, at) in self.arcs.items()))
            counts += np.bincount(np.concatenate(ats), np.concatenate(shares), len(counts))
        spelled = float((alpha[:-1] * alone * beta[1:] * scale).sum())
        for w in np.flatnonzero(total <= 1e-280).tolist():
            spelled += LongWord(self.points[w], self.pieces).expected(float(weight[w]), counts)
        return spelled


def _grouped(words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Words by length: (their numbers, code points with the mark in front)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    for size, numbers in by.items():
        step = max(1, 400_000 // (size + 1)) if size + 1 <= LONG_WORD else 1
        for at in range(0, len(numbers), step):
            some = numbers[at : at + step]
            flat = np.frombuffer("".join(words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(some), size)
            yield some, np.concatenate([np.full((len(some), 1), MARK, np.uint32), flat], axis=1)


def word_scores(words: list[str], pieces: Pieces) -> np.ndarray:
    """Natural log of each word's probability over all its segmentations."""
    out = np.empty(len(words))
    for some, points in _grouped(words):
        long = points.shape[1] > LONG_WORD
        out[some] = LongWord(points[0], pieces).forward()[-1] if long else Lattice(points, pieces).forward()[-1]
    return out


class LongWord:
    """The same recursions along one long word, with arrays of its arcs only: memory follows its length."""

    CHUNK = 1 << 16

    def __init__(self, points: np.ndarray, pieces: Pieces):
        self.n, self.pieces = len(points), pieces
        prefix = np.zeros(self.n + 1, np.uint64)
        h, spread, bits = 0, int(_SPREAD), 0xFFFFFFFFFFFFFFFF
        for j, c in enumerate(points.tolist()):
            h = (h * spread + c + 1) & bits
            prefix[j + 1] = h
        starts, ends, numbers = [], [], []
        power = np.uint64(1)
        self.spelled = pieces.spell - _utf8_length(points) * math.log(256)
        with np.errstate(over="ignore"):
            for k in range(1, min(pieces.longest, self.n) + 1):
                power = power * _SPREAD
                at, number = pieces.find(prefix[k:] - prefix[:-k] * power)
                starts.append(at.astype(np.int64))
                ends.append(at.astype(np.int64) + k)
                numbers.append(number.astype(np.int64))
                if k == 1:
                    self.spelled[at] = -np.inf
        self.starts, self.ends, self.numbers = (np.concatenate(x) for x in (starts, ends, numbers))

    def _run(self, here: np.ndarray, other: np.ndarray, numbers: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        """Messages at 0..n; ``here`` ascends, ``other`` lies before it, ``spelled[j - 1]`` leads from j - 1 to j."""
        out = np.empty(self.n + 1)
        recent = [0.0]  # the last messages, as Python numbers; recent[-1] is at j - 1
        out[0] = 0.0
        longest = self.pieces.longest
        bounds = np.searchsorted(here, np.arange(self.n + 2))
        weights = self.pieces.logp
        for low in range(1, self.n + 1, self.CHUNK):
            high = min(self.n + 1, low + self.CHUNK)
            first = int(bounds[low])
            cuts = (bounds[low : high + 1] - first).tolist()
            back = (here[first : bounds[high]] - other[first : bounds[high]]).tolist()
            gain = weights[numbers[first : bounds[high]]].tolist()
            alone = spelled[low - 1 : high - 1].tolist()
            for i in range(high - low):
                terms = [recent[-back[x]] + gain[x] for x in range(cuts[i], cuts[i + 1])]
                terms.append(recent[-1] + alone[i])
                top = max(terms)
                value = top + math.log(sum(math.exp(t - top) for t in terms))
                recent.append(value)
                out[low + i] = value
                if len(recent) > 4 * longest + 64:
                    del recent[: -longest - 1]
        return out

    def forward(self) -> np.ndarray:
        order = np.argsort(self.ends, kind="stable")
        return self._run(self.ends[order], self.starts[order], self.numbers[order], self.spelled)

    def expected(self, weight: float, counts: np.ndarray) -> float:
        """As of ``Lattice``, for the one word."""
        alpha = self.forward()
        order = np.argsort(-self.starts, kind="stable")  # the word read backwards
        beta = self._run(self.n - self.starts[order], self.n - self.ends[order], self.numbers[order], self.spelled[::-1])[::-1]
        share = np.exp(alpha[self.starts] + self.pieces.logp[self.numbers] + beta[self.ends] - alpha[-1])
        counts += np.bincount(self.numbers, share * weight, len(counts))
        return float(np.exp(alpha[:-1] + self.spelled + beta[1:] - alpha[-1]).sum() * weight)


def _text(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("")).alias("text")


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences of every lower-cased word of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for b in batches:
            for t in b.column(0):
                seen.update(t.as_buffer().to_pybytes().lower().split())
                if len(seen) > FLUSH_WORDS:
                    yield flush()
        yield flush()

    return docs.select(_text(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, ends: int, pieces: Pieces) -> Pieces:
    """Weights from the expected counts of pieces in all training words (word, n)."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts, spelled = np.zeros(len(own.keys)), 0.0
        for b in batches:
            texts, n = b.column(0).to_pylist(), b.column(1).to_numpy().astype(float)
            for some, points in _grouped(texts):
                if points.shape[1] > LONG_WORD:
                    spelled += LongWord(points[0], own).expected(float(n[some[0]]), counts)
                    continue
                with np.errstate(over="ignore"):
                    spelled += Lattice(points, own).expected(n[some], counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(counts[at], spelled))], names=["piece", "n"])

    # At most a vocabulary's size of rows comes back; summed in a fixed order so that reruns agree.
    parts = words.mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.array_sort(F.collect_list("n")).alias("n")).select("piece", F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("n"))
    counts, spelled = np.zeros(len(pieces.keys)), 0.0
    for r in parts.collect():
        if r.piece < 0:
            spelled = r.n
        else:
            counts[r.piece] = r.n
    return pieces.reweighted(counts, spelled, ends)


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """At most ``most`` of the words of the highest counts: all those of a count or more.

    The count comes from a histogram in steps of a twentieth of a natural logarithm, so that no
    task sends more than its own part of the words.
    """
    step = F.floor(F.log(F.col("n")) * 20)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):
        if r["count"] > left:
            break
        left, least = left - r["count"], r.step
    return counts.where(step >= least) if least is not None else counts.where("false")


def score(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | list[str] = VOCABULARY,
    folds: int = 7,
    held_fold: int = 2,
    rounds: int = ROUNDS,
    head_words: int = HEAD_WORDS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows whose crc32(doc_id as text) modulo ``folds`` is not ``held_fold``.
    score is the log10 of the text's probability under the lattice model; base_score adds
    log10((c+1)/(N+V+1)) over tokens, the end being one. Null and empty texts have the end only;
    a null id counts as the empty text for its fold. Very long texts and words are scored whole.
    Repeated rows are repeated in training and result; extra columns, whatever their names, are
    ignored; an empty table gives no rows. ``head_words`` changes the cost, never the result.
    """
    spark: SparkSession = docs.sparkSession
    fold = crc_fold(F.col(id_col), folds)
    train = docs.where(fold != held_fold)
    counts = store(count_words(train, text_col), "words")
    ends = train.count()
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n_train, distinct = (sums.n or 0) + ends, sums.v + (ends > 0)
    scale = math.log10(n_train + distinct + 1)
    first = Pieces.load(vocabulary) if isinstance(vocabulary, str) else Pieces.of(vocabulary)
    for _ in range(rounds):
        first = fit(counts, ends, first)
    pieces = spark.sparkContext.broadcast(first)

    head = _commonest(counts, head_words).collect()
    spelled = [r.word for r in head]
    with np.errstate(over="ignore"):
        table = {w.encode(): i for i, w in enumerate(spelled)}
        values = np.stack([np.log10(np.array([r.n for r in head], float) + 1), word_scores(spelled, pieces.value) / LN10]) if head else np.zeros((2, 0))
    shared = spark.sparkContext.broadcast((table, values))
    end_base, end_score = math.log10(ends + 1), pieces.value.end / LN10

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A text's sums over common words, and its other words, those with their numbers of uses."""
        known, weights = shared.value
        for b in batches:
            n_tokens, n_known, base, total, words, uses = [], [], [], [], [], []
            for t in b.column(2):
                bag = Counter(t.as_buffer().to_pybytes().lower().split())
                size = len(bag)
                numbers = np.fromiter(map(known.get, bag, repeat(-1)), np.int64, size)
                counts = np.fromiter(bag.values(), np.int64, size)
                common = numbers >= 0
                i, n = numbers[common], counts[common]
                rest = [w.decode() for w, other in zip(bag, (~common).tolist()) if other]
                n_tokens.append(int(counts.sum()) + 1)
                n_known.append(int(n.sum()) + (ends > 0))
                base.append(float(weights[0, i] @ n) + end_base)
                total.append(float(weights[1, i] @ n) + end_score)
                words.append(rest)
                uses.append(counts[~common].tolist())
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip((n_tokens, n_known, base, total, words, uses), kinds))], names=names)

    slim = docs.select(F.col(id_col).alias("doc_id"), (fold == held_fold).alias("held_out"), _text(text_col))
    shape = docs.select(F.col(id_col).alias("doc_id")).schema.add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base", "double").add("total", "double")
    from pyspark.sql.types import ArrayType, LongType, StringType

    shape = shape.add("words", ArrayType(StringType())).add("uses", ArrayType(LongType()))
    names = shape.names
    texts = slim.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id())
    texts = store(texts, "texts")
    rare = texts.select("row", F.explode(F.arrays_zip("words", "uses")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.uses").alias("uses"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with np.errstate(over="ignore"):
                got = word_scores(b.column(0).to_pylist(), pieces.value) / LN10
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got)], names=["word", "n", "score"])

    # Each distinct rare word once: those of the training counts, and those met elsewhere only.
    unseen = rare.select("word").distinct().join(counts, "word", "left_anti").select("word", F.lit(0).cast("long").alias("n"))
    head_names = F.broadcast(spark.createDataFrame([(w,) for w in spelled], "word string"))  # head_words at most
    weighed = store(counts.join(head_names, "word", "left_anti").unionByName(unseen).mapInArrow(weigh, "word string, n long, score double"), "weighed")
    found = rare.join(weighed, "word")
    sums = found.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("uses")).otherwise(0)).alias("more_known"),
        F.sum(F.col("uses") * F.log10(F.col("n") + F.lit(1.0))).alias("more_base"),
        F.sum(F.col("uses") * F.col("score")).alias("more_total"),
    )
    out = texts.drop("words", "uses").join(sums, "row", "left")
    zero = F.lit(0.0)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero) - F.col("n_tokens") * scale).alias("base_score"),
        (F.col("total") + F.coalesce("more_total", zero)).alias("score"),
    )
