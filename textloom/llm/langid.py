"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams and its entry in a lexicon; transitions say
how languages follow one another. The field is trained on sequences in which passages of
different languages alternate, so that it labels words of code-switched text; forward-backward
gives each word's posterior, and a document's language is the one with the most of them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, digest

#: The training sample: at most this many distinct labelled rows of each language, those of the smallest hashes...
SAMPLE_ROWS = 400
#: ...and of each of them a stretch of at most this many characters, from a hashed place on.
SAMPLE_CHARS = 10_000
#: Words that a training epoch draws from the sample at most.
EPOCH_WORDS = 600_000
#: Bits of the hashed feature space.
BITS = 17
#: Words of a training sequence, and of a block in which inference runs side by side.
SEQUENCE, BLOCK = 64, 128
#: Characters of text that a step of inference takes together, and words whose scores a task keeps.
STEP_CHARS, KEPT_WORDS = 3_000_000, 300_000

_WORD = re.compile(r"[^\W\d_]+")
_A = np.uint64(0x9E3779B97F4A7C15)
_LEFT, _RIGHT = "\x02", "\x03"


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _slot(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * _A >> np.uint64(64 - BITS)).astype(np.int64)


def features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, word numbers) of all features of non-empty words, word by word not sorted."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    flat = np.frombuffer("".join(f"{_LEFT}{w}{_RIGHT}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - starts[owner]
    slots, owners = [], []
    with np.errstate(over="ignore"):
        gram = flat + np.uint64(1)
        for k in (2, 3, 4):
            gram = gram[:-1] * _A + flat[k - 1 :] + np.uint64(1)
            inside = place[: len(gram)] + k <= sizes[owner[: len(gram)]]
            if k == 4:  # affixes of three letters only
                inside &= (place[: len(gram)] == 0) | (place[: len(gram)] + k == sizes[owner[: len(gram)]])
            at = np.flatnonzero(inside)
            slots.append(_slot(gram[at] + np.uint64(k)))
            owners.append(owner[at])
        names = word_hashes(flat, place, starts)
        found = np.searchsorted(lexicon, names)
        found[found == len(lexicon)] = 0
        known = lexicon[found] == names if len(lexicon) else np.zeros(len(names), bool)
        slots.append(_slot(np.where(known, names, np.uint64(7))))
        owners.append(np.arange(len(words)))
    return np.concatenate(slots), np.concatenate(owners)


def word_hashes(flat: np.ndarray, place: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words laid out in ``flat``."""
    with np.errstate(over="ignore"):
        mixed = (flat + np.uint64(11)) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _A
        mixed ^= mixed >> np.uint64(31)
        return np.add.reduceat(mixed * _A, starts) if len(starts) else np.zeros(0, np.uint64)


def lexicon_of(counts: Counter, least: int = 2) -> np.ndarray:
    words = sorted(w for w, n in counts.items() if n >= least)
    if not words:
        return np.zeros(0, np.uint64)
    sizes = np.array([len(w) + 2 for w in words])
    flat = np.frombuffer("".join(f"{_LEFT}{w}{_RIGHT}" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(sizes) - sizes
    return np.sort(word_hashes(flat, np.arange(len(flat)) - np.repeat(starts, sizes), starts))


@dataclass
class Field:
    """A trained field over ``labels``."""

    labels: list[str]
    lexicon: np.ndarray
    weights: np.ndarray  # (slots, labels)
    transitions: np.ndarray  # (from, to)
    start: np.ndarray
    _kept: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def emissions(self, words: list[str]) -> np.ndarray:
        slots, owners = features(words, self.lexicon)
        n = np.bincount(owners, minlength=len(words))
        w = self.weights[slots]
        sums = np.stack([np.bincount(owners, w[:, k], len(words)) for k in range(w.shape[1])], axis=1)
        return sums / np.sqrt(n)[:, None]

    def scores(self, words: list[str]) -> np.ndarray:
        """Emissions of words in a text's order; a bounded number of distinct words is remembered."""
        kept = self._kept
        at = np.fromiter((kept.get(w, -1) for w in words), np.int64, len(words))
        missing = list(dict.fromkeys(words[i] for i in np.flatnonzero(at < 0).tolist()))
        if missing:
            if len(kept) + len(missing) > KEPT_WORDS and kept:
                kept.clear()
                self._scores = None
                return self.scores(words)
            for i, w in enumerate(missing, len(kept)):
                kept[w] = i
            new = self.emissions(missing)
            self._scores = new if self._scores is None else np.concatenate([self._scores, new])
            gaps = np.flatnonzero(at < 0)
            at[gaps] = np.fromiter((kept[words[i]] for i in gaps.tolist()), np.int64, len(gaps))
        return self._scores[at]

    def posteriors(self, words: list[str], sizes: np.ndarray) -> np.ndarray:
        """Marginal label probabilities of all words of texts of ``sizes`` words (none zero), one after another."""
        return forward_backward(self.scores(words), np.asarray(sizes, np.int64), self.transitions, self.start)

    def label_words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, language, probability) in order."""
        words = words_of(text or "")
        if not words:
            return []
        p = self.posteriors(words, np.array([len(words)]))
        return [(w, self.labels[k], float(p[i, k])) for i, (w, k) in enumerate(zip(words, p.argmax(1).tolist()))]


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Exact posteriors of many chains, in blocks that run side by side.

    A block's transfer matrix is the product of its steps; the chain of blocks gives each block
    the messages at its ends, from which it runs forward and backward by itself. The number of
    numpy steps follows the block's size and the longest chain's number of blocks.
    """
    total, k = scores.shape
    m = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(transitions - transitions.max())
    first = np.cumsum(sizes) - sizes
    n_blocks = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), n_blocks)
    index = np.arange(len(chain)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    begin = first[chain] + index * block
    length = np.minimum(block, first[chain] + sizes[chain] - begin)
    order = np.argsort(-length, kind="stable")  # blocks by length, so that those still running lead
    begin, length, chain, index = begin[order], length[order], chain[order], index[order]
    running = [int((length > t).sum()) for t in range(int(length.max()) if len(length) else 0)]

    def unit(x):
        return x / np.maximum(x.sum(-1, keepdims=True), 1e-300)

    # Transfer matrices: row i is the forward message when the word before the block has label i.
    transfer = np.repeat(np.eye(k)[None], len(chain), axis=0)
    for t, n in enumerate(running):
        x = (transfer[:n].reshape(-1, k) @ a).reshape(n, k, k) * m[begin[:n] + t][:, None, :]
        transfer[:n] = x / np.maximum(x.max((1, 2), keepdims=True), 1e-300)
    # Messages into and out of blocks. Before a chain's first word stands the start's own step.
    entry = np.exp(start - start.max())
    into = np.ones((len(chain), k))
    out = np.ones((len(chain), k))
    where = {}
    rank = np.argsort(index, kind="stable")
    cuts = np.flatnonzero(np.diff(index[rank], prepend=-1)) if len(rank) else np.zeros(0, np.int64)
    levels = np.split(rank, cuts[1:]) if len(rank) else []
    slot = np.full(len(sizes), -1)
    for level, blocks in enumerate(levels):
        if level:
            into[blocks] = carried[slot[chain[blocks]]]
            now = unit(np.einsum("ni,nij->nj", into[blocks], transfer[blocks]))
        else:
            now = _first_block(m, a, entry, begin[blocks], length[blocks], k)
        carried = now
        slot[chain[blocks]] = np.arange(len(blocks))
        where[level] = blocks
    back = np.ones((len(sizes), k))
    for level in range(len(levels) - 1, -1, -1):
        blocks = where[level]
        out[blocks] = back[chain[blocks]]
        x = np.einsum("nij,nj->ni", transfer[blocks], out[blocks])
        back[chain[blocks]] = unit(x)
    # Inside the blocks.
    alpha = np.empty((total, k))
    now = into.copy()
    for t, n in enumerate(running):
        x = now[:n] @ a
        if t == 0:
            x[index[:n] == 0] = entry
        now[:n] = unit(x * m[begin[:n] + t])
        alpha[begin[:n] + t] = now[:n]
    beta = np.empty((total, k))
    now = out.copy()
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        more = running[t + 1] if t + 1 < len(running) else 0
        if more:
            now[:more] = unit((now[:more] * m[begin[:more] + t + 1]) @ a.T)
        beta[begin[:n] + t] = now[:n]
    return unit(alpha * beta)


def _first_block(m: np.ndarray, a: np.ndarray, entry: np.ndarray, begin: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Forward messages at the ends of chains' first blocks."""
    now = np.empty((len(begin), k))
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    x = np.empty((len(begin), k))
    for t in range(int(length[0]) if len(length) else 0):
        n = int((length > t).sum())
        x[:n] = (entry if t == 0 else x[:n] @ a) * m[begin[:n] + t]
        x[:n] /= np.maximum(x[:n].sum(1, keepdims=True), 1e-300)
    now[order] = x
    return now


def train(rows: list[tuple[str, str]], *, epochs: int = 3, epoch_words: int = EPOCH_WORDS, rate: float = 0.5, seed: int = 5) -> Field:
    """A field from (language, text) rows by AdaGrad on the log-likelihood of alternating passages."""
    labels = sorted({lang for lang, _ in rows})
    k = len(labels)
    texts = [(labels.index(lang), words_of(t)) for lang, t in sorted(rows)]
    texts = [(y, w) for y, w in texts if w]
    counts: Counter = Counter(w for _, ws in texts for w in ws)
    lexicon = lexicon_of(counts)
    names = sorted(counts)
    number = {w: i for i, w in enumerate(names)}
    made = Field(labels, lexicon, np.zeros((1 << BITS, k)), np.zeros((k, k)), np.zeros(k))
    if not names or k < 2:
        return made
    slots, owners = features(names, lexicon)
    order = np.argsort(owners, kind="stable")
    slots, width = slots[order], np.bincount(owners, minlength=len(names))
    begin = np.cumsum(width) - width
    scale = 1 / np.sqrt(width)
    random = np.random.default_rng(seed)
    squares, squares_t = np.full((1 << BITS, k), 1e-2), np.full((k, k), 1.0)
    # Every language has the same share of passages, whatever its share of the rows.
    pools = [[np.array([number[w] for w in ws]) for y, ws in texts if y == j] for j in range(k)]
    live = [j for j in range(k) if pools[j]]
    n_words = min(sum(map(len, (ws for _, ws in texts))), epoch_words)
    for _ in range(epochs):
        xs, ys, have = [], [], 0
        while have < n_words:
            j = live[random.integers(len(live))]
            doc = pools[j][random.integers(len(pools[j]))]
            size = int(random.geometric(1 / 25))
            at = int(random.integers(max(1, len(doc) - size + 1)))
            xs.append(doc[at : at + size])
            ys.append(np.full(len(xs[-1]), j))
            have += len(xs[-1])
        x, y = np.concatenate(xs), np.concatenate(ys)
        n = len(x) // SEQUENCE
        if not n:
            x, y, n = x[None], y[None], 1
        else:
            x, y = x[: n * SEQUENCE].reshape(n, SEQUENCE), y[: n * SEQUENCE].reshape(n, SEQUENCE)
        for b in range(0, n, 128):
            bx, by = x[b : b + 128], y[b : b + 128]
            own, inverse = np.unique(bx, return_inverse=True)
            reach = np.repeat(begin[own] - np.concatenate(([0], np.cumsum(width[own])[:-1])), width[own]) + np.arange(width[own].sum())
            fs, fo = slots[reach], np.repeat(np.arange(len(own)), width[own])
            w = made.weights[fs]
            e = np.stack([np.bincount(fo, w[:, c], len(own)) for c in range(k)], axis=1) * scale[own][:, None]
            scores = e[inverse.ravel()].reshape(*bx.shape, k)
            p, pair, entry = _expectations(scores, made.transitions, made.start)
            truth = np.eye(k)[by]
            gap = (truth - p).reshape(-1, k)
            by_word = np.stack([np.bincount(inverse.ravel(), gap[:, c], len(own)) for c in range(k)], axis=1) * scale[own][:, None]
            g = by_word[fo]
            used, fu = np.unique(fs, return_inverse=True)
            grad = np.stack([np.bincount(fu.ravel(), g[:, c], len(used)) for c in range(k)], axis=1) / len(bx)
            squares[used] += grad**2
            made.weights[used] += rate * grad / np.sqrt(squares[used])
            moves = np.zeros((k, k))
            np.add.at(moves, (by[:, :-1].ravel(), by[:, 1:].ravel()), 1)
            grad = (moves - pair) / len(bx)
            squares_t += grad**2
            made.transitions += rate * grad / np.sqrt(squares_t)
            made.start += 0.1 * (truth[:, 0].mean(0) - entry)
    return made


def _expectations(scores: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors, expected transitions in all, and mean posteriors of first labels, of equally long sequences."""
    n, size, k = scores.shape
    m = np.exp(scores - scores.max(2, keepdims=True))
    a = np.exp(transitions)
    alpha, beta = np.empty_like(m), np.ones_like(m)
    now = np.exp(start) * m[:, 0]
    for t in range(size):
        if t:
            now = (now @ a) * m[:, t]
        now = now / now.sum(1, keepdims=True)
        alpha[:, t] = now
    for t in range(size - 2, -1, -1):
        x = (beta[:, t + 1] * m[:, t + 1]) @ a.T
        beta[:, t] = x / x.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = np.zeros((k, k))
    if size > 1:
        right = beta[:, 1:] * m[:, 1:]
        z = np.einsum("nti,ij,ntj->nt", alpha[:, :-1], a, right)
        pair = np.einsum("nti,ntj,nt->ij", alpha[:, :-1], right, 1 / z) * a
    return p, pair, p[:, 0].mean(0)


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of at most ``rows`` distinct labelled rows of each language, a stretch of at most ``chars`` characters of each.

    Rows are drawn by a hash of (id, text, language), so that equal ids or texts do not fall
    together, and the same whatever the partitions. Texts of every length are drawn alike; long
    ones give a stretch whose place is hashed, without the words that it cuts.
    """
    text, lang = F.col(text_col).cast("string"), F.col(lang_col).cast("string")
    own = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    key = dict(zip(("key0", "key1"), digest(F.col(id_col).cast("string"), F.col(id_col).isNull(), text, lang), strict=True))
    own = own.select(lang.alias("lang"), *[k.alias(n) for n, k in key.items()], text.alias("text"))
    distinct = own.select("lang", "key0", "key1").distinct()
    counts = {r.lang: r.n for r in distinct.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return []
    # A row's hash, from 0 to 1, is held against its language's share: no task sorts or ranks a
    # language's rows. Some four deviations more than are wanted are drawn, the last left out here.
    u, v = (F.shiftrightunsigned(F.xxhash64(F.lit(k), "key0", "key1"), 11) / F.lit(float(1 << 53)) for k in (3, 4))
    shares = [(lang, (rows + 4 * rows**0.5 + 8) / n) for lang, n in counts.items()]
    shares = F.broadcast(docs.sparkSession.createDataFrame(shares, "lang string, share double"))
    at = F.floor(v * F.greatest(F.length("text") - chars, F.lit(0))).cast("int")
    cut = F.struct(at.alias("at"), F.length("text").alias("whole"), F.substring("text", at + 1, F.lit(chars)).alias("text"))
    drawn = own.join(shares, "lang").where(u < F.col("share")).select("lang", u.alias("u"), "key0", "key1", cut.alias("cut"))
    got = drawn.groupBy("lang", "u", "key0", "key1").agg(F.first("cut").alias("cut")).select("lang", "u", "key0", "key1", "cut.*").collect()
    out: list[tuple[str, str]] = []
    kept: Counter = Counter()
    for r in sorted(got, key=lambda r: (r.lang, r.u, r.key0, r.key1)):
        if kept[r.lang] < rows:
            kept[r.lang] += 1
            out.append((r.lang, _whole_words(r.text, r.at > 0, r.at + chars < r.whole)))
    return out


def _whole_words(text: str, cut_before: bool, cut_after: bool) -> str:
    """``text`` without the run of letters that a cut goes through."""
    first = _RUN.match(text).end() if cut_before else 0
    last = len(text) - _RUN.match(text[::-1]).end() if cut_after else len(text)
    return text[first:last] if first < last else text


_RUN = re.compile(r"[^\W\d_]*")


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held_fold: int = 1, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from a bounded sample (``sample``) of the rows with a language whose crc32(doc_id as
    text) modulo ``folds`` is not ``held_fold``; predictions see whole texts only, however long.
    lang_pred is the label with the largest sum of word posteriors, the first of equal ones by
    name, score its share of them. Texts that are null or have no letter get ``und`` with score
    0, and so do all where nothing could be learned. A null id counts as the empty text. Repeated
    rows are kept, and learned from once; extra columns, whatever their names, are ignored; an
    empty table gives no rows. Languages are few: the model holds 2^17 weights of each.
    """
    fold = crc_fold(F.col(id_col), folds)
    model = train(sample(docs.where(fold != held_fold), id_col=id_col, text_col=text_col, lang_col=lang_col, rows=rows))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("doc_id"), (fold == held_fold).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = docs.select(F.col(id_col).alias("doc_id")).schema.add("held_out", "boolean").add("lang_pred", "string").add("score", "double")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            texts = b.column(2)
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            words: list[str] = []
            at, sizes, chars = [], [], 0
            for i in range(b.num_rows):
                found = words_of(texts[i].as_py())
                if found:
                    words += found
                    at.append(i)
                    sizes.append(len(found))
                    chars += sum(map(len, found))
                if words and own.labels and (chars > STEP_CHARS or i == b.num_rows - 1):
                    p = own.posteriors(words, np.array(sizes))
                    share = np.add.reduceat(p, np.cumsum(sizes) - np.array(sizes)) / np.array(sizes)[:, None]
                    for j, k, v in zip(at, share.argmax(1).tolist(), share.max(1).tolist()):
                        pred[j], score[j] = own.labels[k], min(1.0, v)
                    words, at, sizes, chars = [], [], [], 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=names)

    return slim.mapInArrow(run, schema)
