"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. Each language has a
probability for each piece; the probability of a word is the sum, over all ways
to cut it into pieces, of the products of theirs. A forward pass gives that sum.
The probabilities come from a few rounds of expectation maximisation, whose
expected counts need a backward pass as well.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch, durable

#: The model is fitted on about so many documents of each language, those with the smallest hashes.
TRAIN_DOCS = 800
ROUNDS = 2
#: A character that is no piece of its own has this probability; a piece never seen with a language has this share of a count.
UNKNOWN, SMOOTH = 1e-8, 0.01
#: Words of more characters than this are summed with scaled numbers, as a double cannot hold their probability.
PLAIN = 30
#: A worker keeps the scores of words from one text to the next, so many numbers at most; a forward pass holds about so many.
KEPT, AT_ONCE = 2_000_000, 2_000_000

WORD = re.compile(r"[^\W\d_]+")


class Vocabulary(dict):
    """Pieces and their numbers."""

    @cached_property
    def longest(self) -> int:
        return max(map(len, self), default=1)


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Lower-cased pieces of a sentencepiece model, numbered; a mark for a word's start stays, control pieces go.

    Words are lower-cased runs of letters. So pieces that differ in case alone
    are one, and a piece with anything but letters is left out, as no word holds it.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = Vocabulary()
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            piece = sp.id_to_piece(i).lower()
            if WORD.fullmatch(piece.replace("▁", "")):
                out.setdefault(piece, len(out))
    return out


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, each marked at its start."""
    return ["▁" + w for w in WORD.findall(text.lower())]


def _spans(word: str, vocab: Vocabulary) -> list[tuple[int, int, int]]:
    """Start, end and piece of each piece in the word, by end; -1 for a single character that is no piece."""
    out, longest = [], vocab.longest
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            p = vocab.get(word[i:j])
            if p is not None:
                out.append((i, j, p))
            elif i == j - 1:
                out.append((i, j, -1))
    return out


def forward(words: list[str], vocab: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language; ``p`` has a row for each piece and one more for unknown characters.

    All words take their step to the same end together.
    """
    if not words:
        return np.zeros((0, p.shape[1]))
    reach = vocab.longest
    if any(len(w) > PLAIN for w in words):
        out = np.empty((len(words), p.shape[1]))
        short = [k for k, w in enumerate(words) if len(w) <= PLAIN]
        out[short] = forward([words[k] for k in short], vocab, p)
        for k in set(range(len(words))) - set(short):
            out[k] = scaled_forward(words[k], vocab, p, reach)
        return out
    get, unknown = vocab.get, len(p) - 1
    longest = max(map(len, words))
    steps: list[tuple[list, list, list]] = [([], [], []) for _ in range(longest + 1)]
    for k, w in enumerate(words):
        for j in range(1, len(w) + 1):
            at, start, piece = steps[j]
            for i in range(j - reach if j > reach else 0, j):
                x = get(w[i:j])
                if x is not None:
                    at.append(k)
                    start.append(i)
                    piece.append(x)
                elif i == j - 1:
                    at.append(k)
                    start.append(i)
                    piece.append(unknown)
    alpha = np.zeros((longest + 1, len(words), p.shape[1]))
    alpha[0] = 1.0
    for j, (at, start, piece) in enumerate(steps):
        if at:
            at = np.array(at)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            alpha[j, at[first]] = np.add.reduceat(alpha[start, at] * p[piece], first, axis=0)
    return np.log(alpha[np.fromiter(map(len, words), np.int64, len(words)), np.arange(len(words))])


def scaled_forward(word: str, vocab: Vocabulary, p: np.ndarray, reach: int) -> np.ndarray:
    """The same for one word of any length: sums are kept as shares of the last one, whose logarithms add up."""
    get, unknown = vocab.get, len(p) - 1
    window, total = np.zeros((reach, p.shape[1])), np.zeros(p.shape[1])
    window[-1] = 1.0
    for j in range(1, len(word) + 1):
        low = max(0, j - reach)
        found = [(i, x) for i in range(low, j) if (x := get(word[i:j])) is not None]
        if not found or found[-1][0] != j - 1:
            found.append((j - 1, unknown))
        start, piece = zip(*found)
        new = (window[np.array(start) - j] * p[list(piece)]).sum(axis=0)
        total += np.log(new)
        window[:-1] = window[1:] / new
        window[-1] = 1.0
    return total


def expected(word: str, vocab: Vocabulary, p: np.ndarray) -> list[tuple[int, float]]:
    """Expected count of each piece over all segmentations of the word in one language; ``p`` is a vector."""
    spans = _spans(word, vocab)
    if len(word) > PLAIN:
        return _scaled_expected(spans, len(word), p)
    alpha, beta = [1.0] + [0.0] * len(word), [0.0] * len(word) + [1.0]
    for i, j, piece in spans:
        alpha[j] += alpha[i] * p[piece]
    for i, j, piece in sorted(spans, key=lambda s: -s[1]):
        beta[i] += beta[j] * p[piece]
    total = alpha[-1]
    return [(piece, alpha[i] * p[piece] * beta[j] / total) for i, j, piece in spans if piece >= 0] if total > 0 else []


def _scaled_expected(spans: list[tuple[int, int, int]], length: int, p) -> list[tuple[int, float]]:
    """The same by logarithms, for words of any length."""

    def add(x: float, y: float) -> float:
        high, low = max(x, y), min(x, y)
        return high if low == -math.inf else high + math.log1p(math.exp(low - high))

    alpha, beta = [0.0] + [-math.inf] * length, [-math.inf] * length + [0.0]
    logs = [math.log(p[piece]) if p[piece] > 0 else -math.inf for _, _, piece in spans]
    for (i, j, _), x in zip(spans, logs):
        alpha[j] = add(alpha[j], alpha[i] + x)
    for (i, j, _), x in sorted(zip(spans, logs), key=lambda s: -s[0][1]):
        beta[i] = add(beta[i], beta[j] + x)
    return [(piece, math.exp(alpha[i] + x + beta[j] - alpha[-1])) for (i, j, piece), x in zip(spans, logs) if piece >= 0] if alpha[-1] > -math.inf else []


class Model:
    """Languages, in order, and each piece's probability in each."""

    def __init__(self, path: str, languages: list[str], p: np.ndarray):
        self.path, self.languages, self.p = path, languages, p
        self._forget()

    def _forget(self) -> None:
        self.lexicon: dict = defaultdict()
        self.lexicon.default_factory = self.lexicon.__len__
        self.logs = np.zeros((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {"path": self.path, "languages": self.languages, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def sums(self, words: list[str]) -> Iterator[np.ndarray]:
        """The words' log-probabilities, so many words at a time as the languages leave room for."""
        vocab, step = vocabulary(self.path), max(1, AT_ONCE // ((PLAIN + 1) * max(1, len(self.languages))))
        for i in range(0, len(words), step):
            yield forward(words[i : i + step], vocab, self.p)

    def _said(self, total: np.ndarray | None) -> tuple[str, float]:
        if total is None:
            return "und", 0.0
        best = int(total.argmax())
        return self.languages[best], float(1.0 / np.exp(total - total[best]).sum())

    def _totals(self, waiting: list[np.ndarray | None]) -> Iterator[tuple[str, float]]:
        """The results of texts whose words have their numbers; each new word is summed once."""
        self.logs = np.concatenate([self.logs, *self.sums(list(islice(self.lexicon, len(self.logs), None)))])
        for at in waiting:
            yield self._said(None if at is None else self.logs[at].sum(axis=0))

    def score(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        """Language and share of the likelihoods of each text, in order.

        Texts are taken one by one. Those whose words find room are scored
        together; what is held depends on ``KEPT`` and a text's own words, not
        on how many texts or languages there are.
        """
        room, waiting = max(1, KEPT // max(1, len(self.languages))), []
        for text in texts:
            words = words_of(text or "") if self.languages else []
            # words hold letters and such signs as fractions
            if not words or not any(map(str.isalpha, text)):
                waiting.append(None)
                continue
            count = Counter(words)
            if len(self.lexicon) + len(count) > room:
                yield from self._totals(waiting)
                waiting = []
                self._forget()
            if len(count) > room:
                own, n = list(count), np.array(list(count.values()), np.float64)
                total, at = np.zeros(len(self.languages)), 0
                for part in self.sums(own):
                    total += n[at : at + len(part)] @ part
                    at += len(part)
                yield self._said(total)
                continue
            waiting.append(np.fromiter(map(self.lexicon.__getitem__, words), np.int64, len(words)))
        yield from self._totals(waiting)


def train(labelled: DataFrame, path: str, train_docs: int = TRAIN_DOCS, rounds: int = ROUNDS, seed: int = 3, max_languages: int | None = None) -> Model:
    """Fits the model on ``labelled(text, lang)``, on about ``train_docs`` documents of each language.

    The sample is of a bounded size, and is drawn by hashes of the texts. Words
    are counted in Spark, expected piece counts too; the driver holds a number
    for each piece of the vocabulary and language. Rows with a null text or
    language take no part. All languages are learned, or, where a user sets
    ``max_languages``, the ones with the most distinct texts, ties by name.
    """
    rows = labelled.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.select("lang", F.xxhash64("text").alias("h")).distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sorted(sizes, key=lambda lang: (-sizes[lang], lang))[:max_languages])
    vocab = vocabulary(path)
    uniform = np.full((len(vocab) + 1, len(languages)), 1.0 / max(1, len(vocab)))
    uniform[-1] = UNKNOWN
    if not languages:
        return Model(path, [], uniform)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, train_docs / sizes[lang])))])
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)
    counted = "lang string, word string, n long"
    counted_out = arrow_schema(T._parse_datatype_string(counted))

    def count(batches):
        seen: Counter = Counter()
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w, n in Counter(words_of(text)).items():
                    seen[lang, w] += n
            if len(seen) > 500_000:
                yield batch(counted_out, *zip(*((lang, w, n) for (lang, w), n in seen.items())))
                seen.clear()
        if seen:
            yield batch(counted_out, *zip(*((lang, w, n) for (lang, w), n in seen.items())))

    # copies of a text are drawn together, so only one of them counts, here as in the sizes
    words = durable(rows.where(drawn).select("text", "lang").dropDuplicates().mapInArrow(count, counted).groupBy("lang", "word").agg(F.sum("n").alias("n")))
    summed = "lang int, piece int, n double"
    summed_out = arrow_schema(T._parse_datatype_string(summed))
    number = {lang: i for i, lang in enumerate(languages)}
    p = uniform
    for _ in range(rounds):

        def expect(batches, p=p):
            sums: dict = {}
            vocab = vocabulary(path)
            lists = p.T.tolist()
            for b in batches:
                for lang, w, n in zip(*(c.to_pylist() for c in b.columns)):
                    lang = number[lang]
                    for piece, x in expected(w, vocab, lists[lang]):
                        sums[lang, piece] = sums.get((lang, piece), 0.0) + n * x
            if sums:
                yield batch(summed_out, *zip(*((a, b, n) for (a, b), n in sums.items())))

        # sums of doubles in a fixed order, so that a run gives the same model again
        total = words.mapInArrow(expect, summed).groupBy("lang", "piece").agg(F.sum(F.round(F.col("n"), 6).cast("decimal(28,6)")).cast("double").alias("n")).toArrow()
        c = np.full(uniform.shape, SMOOTH)
        c[total.column("piece").to_numpy(), total.column("lang").to_numpy()] += total.column("n").to_numpy()
        p = c / c[:-1].sum(axis=0)
        p[-1] = UNKNOWN
    return Model(path, languages, p)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)``, a row for each row of ``docs(doc_id, text, ...)``.

    ``lang_pred`` is the language under which the text is likeliest, ties to the
    first in order; ``score`` is its share of the likelihoods, from 0 to 1. A
    text that is null or has no letter, and any text if no language was learned,
    is ``und`` with score 0. Letters are what Unicode calls so. Repeated rows
    stay; other columns are not used.
    """
    spark = docs.sparkSession
    schema = "doc_id long, lang_pred string, score double"
    out = arrow_schema(T._parse_datatype_string(schema))
    shared = spark.sparkContext.broadcast(model)  # as large as vocabulary times languages

    def scan(batches):
        model = shared.value
        for b in batches:
            if len(b):
                yield batch(out, b.column(0), *zip(*model.score(t.as_py() for t in b.column(1))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)
