"""Secrets: fixed patterns, and random-looking words that a battery of tests tells from ordinary ones.

A word that no pattern has is read in the smallest alphabet that holds it, its
inferred encoding. Three tests ask whether its symbols could have been drawn
uniformly from that alphabet: chi-squared for their counts, runs for changes
between digits, capitals and small letters, serial correlation for neighbours.
Fisher's sum of the three is held against what ordinary words of the same
encoding and length reach. Few symbols tell little, so a short ordinary word may
reach a low sum by chance, and its p-value says so. False discoveries are
controlled by Benjamini and Hochberg's rule over the different words of all rows,
for each encoding and range of lengths by itself: many long secrets do not
license a guess about a short word.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, durable
from .pii import masked

KINDS = ("assign", "access", "hex", "random")
RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Words of this many symbols and more are tested; padding may follow them.
SHORTEST = 16
WORD = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}={{0,2}}")
SEPARATORS = "+/_-"

DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet to the largest. Decimal numbers stand outside: uniform digits are ordinary there.
ENCODINGS = {
    "hex": DIGITS + LOWER[:6],
    "HEX": DIGITS + UPPER[:6],
    "lower": LOWER,
    "upper": UPPER,
    "base32": "234567" + UPPER,
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": DIGITS + UPPER + LOWER,
    "base64": "+/" + DIGITS + UPPER + LOWER,
    "base64url": "-_" + DIGITS + UPPER + LOWER,
}
MEMBERS = {name: frozenset(a) for name, a in ENCODINGS.items()}
POSITION = {name: {c: i for i, c in enumerate(a)} for name, a in ENCODINGS.items()}

#: What ordinary words are put together from: common words of four languages, numbers and filler.
ORDINARY = (
    "the and for with from this that have request response user name table index value count first last file path data test config default service client server message "
    "error handler manager factory builder controller version update delete create insert select order customer account number address street city country date time "
    "und der die das nicht eine werden schaft heit ung keit straße haus zeit arbeit verein gesellschaft verwaltung entwicklung les des une dans pour avec tion ment "
    "maison temps travail association gouvernement information el la los para una con cion mente casa tiempo trabajo desarrollo gobierno sociedad add bad cafe feed "
    "face dead beef decade fade ace dad abc abcdef aaaa ffff bbbb xxxx"
).replace("ß", "ss").split()
NUMBERS = "2024 2023 1999 2000 100 1000 000 0000 00 01 12 31 123 1234 123456 404 64 32 1 2 3 7 9 10".split()

#: Lengths at which ordinary words are measured, and how many at each.
KNOTS, DRAWN = (16, 20, 24, 32, 48, 64, 96, 128), 600
#: A secret must pass for uniform at this level; such a share of the discoveries may be false; steps of p-values to a power of ten.
UNIFORM, FALSE, STEPS = 0.001, 0.01, 20

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the patterns, leftmost and without overlap for each kind, by start and then kind."""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(kind, *m.span()) for kind, p in (("access", ACCESS), ("hex", HEX)) for m in p.finditer(text) if m.end() - m.start() >= LEAST[kind]]
    return sorted(out, key=lambda s: (s[1], RANK[s[0]]))


def encoding(word: str) -> str | None:
    """The smallest alphabet that holds all symbols; none for decimal numbers and words of two alphabets."""
    symbols = set(word)
    return None if symbols <= set(DIGITS) else next((name for name, a in MEMBERS.items() if symbols <= a), None)


@cache
def groups(name: str) -> np.ndarray:
    """The group of each symbol for the runs test: its class, or the half of the alphabet where all are of one class."""
    kind = np.array([next(i for i, c in enumerate((DIGITS, UPPER, LOWER, SEPARATORS)) if s in c) for s in ENCODINGS[name]])
    return kind if len(set(kind.tolist())) > 1 else np.arange(len(kind)) * 2 // len(kind)


_two_sided = np.vectorize(lambda z: max(math.erfc(abs(z) / math.sqrt(2)), 1e-300), otypes=[float])
_below = np.vectorize(lambda z: 0.5 * math.erfc(-z / math.sqrt(2)), otypes=[float])


def battery(codes: np.ndarray, name: str) -> np.ndarray:
    """p-values of the three tests, a row for each row of ``codes(words, n)``, under uniform draws from the alphabet.

    The moments of chi-squared and of the number of changes are exact at any
    length; the distribution of the first is taken as a gamma of these moments
    (by its cube root), the others as normal.
    """
    m, n = codes.shape
    a = len(ENCODINGS[name])
    counts = np.zeros((m, a), np.int64)
    np.add.at(counts, (np.repeat(np.arange(m), n), codes.ravel()), 1)
    chi = a / n * np.square(counts).sum(axis=1) - n
    mean, var = a - 1, 2 * (a - 1) * (n - 1) / n
    shape = mean**2 / var
    z_chi = (np.cbrt(np.maximum(chi, 0) / mean) - (1 - 1 / (9 * shape))) * 3 * math.sqrt(shape)

    g = groups(name)
    share = np.bincount(g) / a
    change = 1 - np.square(share).sum()
    twice = (share * np.square(1 - share)).sum()
    spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (twice - change**2)
    at = g[codes]
    z_runs = ((at[:, 1:] != at[:, :-1]).sum(axis=1) - (n - 1) * change) / math.sqrt(max(spread, 1e-9))

    x = codes - codes.mean(axis=1, keepdims=True)
    own = np.square(x).sum(axis=1)
    r = np.where(own > 0, (x[:, 1:] * x[:, :-1]).sum(axis=1) / np.where(own > 0, own, 1), 1.0)
    z_serial = (r + 1 / n) * math.sqrt(n)
    return np.stack([_two_sided(z_chi), _two_sided(z_runs), _two_sided(z_serial)], axis=1)


def fisher(p: np.ndarray) -> np.ndarray:
    """Minus twice the summed logarithms."""
    return -2 * np.log(p).sum(axis=1)


def uniform_p(total: np.ndarray) -> np.ndarray:
    """The chance that uniform draws reach Fisher's sum of three tests (chi-squared with six degrees of freedom)."""
    h = total / 2
    return np.exp(-h) * (1 + h + h * h / 2)


def ordinary_words(name: str, n: int, how_many: int, seed: int) -> np.ndarray:
    """Codes of ordinary words of ``n`` symbols: words, names and numbers joined in the usual styles, as far as the alphabet has them."""
    rng, symbols, place = np.random.default_rng([seed, n, list(ENCODINGS).index(name)]), MEMBERS[name], POSITION[name]
    fits = lambda x: set(x) <= symbols
    styles = [list(filter(fits, map(f, ORDINARY))) for f in (str.lower, str.upper, str.capitalize)]
    styles = [s for s in styles if s]
    numbers, joints = list(filter(fits, NUMBERS)), ["", ""] + [c for c in SEPARATORS if c in symbols]
    out = np.empty((how_many, n), np.int64)
    for i in range(how_many):
        words, joint, with_numbers = styles[rng.integers(len(styles))], joints[rng.integers(len(joints))], numbers and rng.random() < 0.6
        text = ""
        while len(text) < n:
            piece = numbers[rng.integers(len(numbers))] if with_numbers and rng.random() < 0.35 else words[rng.integers(len(words))]
            text += (joint if text else "") + piece
        out[i] = [place[c] for c in text[:n]]
    return out


@cache
def ordinary_sums(name: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the logarithm of Fisher's sum of ordinary words, at each of ``KNOTS``; once for a worker process."""
    logs = [np.log(fisher(battery(ordinary_words(name, n, DRAWN, 11), name))) for n in KNOTS]
    return np.array([x.mean() for x in logs]), np.array([x.std() for x in logs])


def ordinary_p(total: np.ndarray, name: str, n: int) -> np.ndarray:
    """The chance that an ordinary word of this encoding and length looks as random; beyond the last knot as at it, which errs towards ordinary."""
    mean, spread = (np.interp(math.log(n), np.log(KNOTS), x) for x in ordinary_sums(name))
    return _below((np.log(np.maximum(total, 1e-12)) - mean) / spread)


def stratum(name: str, n: int) -> int:
    """Words of one encoding and of lengths from one knot to the next are held against each other."""
    return list(ENCODINGS).index(name) * len(KNOTS) + int(np.searchsorted(KNOTS, n, side="right")) - 1


def step_of(p: np.ndarray) -> np.ndarray:
    """p-values on a grid, rounded up to it; higher steps are smaller p-values."""
    return np.floor(-STEPS * np.log10(np.maximum(p, 1e-300))).astype(np.int64)


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, int, int]]:
    """``(start, end, stratum, step, word's hash)`` of each word of a text that touches no pattern span and has an encoding.

    The step is that of :func:`ordinary_p`, and of 1 for a word that uniform
    draws would not make.
    """
    taken: list[list[int]] = []
    for _, a, b in base:
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    places, like, k = [], {}, 0
    for m in WORD.finditer(text):
        body = m[0].rstrip("=")
        start = m.start() + len(body) - len(body.lstrip(SEPARATORS))
        end = m.end() if len(body) < len(m[0]) else m.start() + len(body.rstrip(SEPARATORS))
        word = text[start:end].rstrip("=")
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if len(word) >= SHORTEST and not (k < len(taken) and taken[k][0] < end) and (name := encoding(word)):
            places.append((start, end, word))
            like.setdefault((name, len(word)), {})[word] = None
    step = {}
    for (name, n), same in like.items():
        total = fisher(battery(np.array([[POSITION[name][c] for c in w] for w in same]), name))
        steps = step_of(np.where(uniform_p(total) >= UNIFORM, ordinary_p(total, name, n), 1.0))
        step.update({w: (stratum(name, n), int(s), xxhash.xxh64_intdigest(w) - (1 << 63)) for w, s in zip(same, steps)})
    return [(a, b, *step[w]) for a, b, w in places]


SPANS = "array<struct<kind:string,start:long,end:long>>"
WORDS = "array<struct<start:long,end:long,stratum:int,step:int,word:long>>"


def scanned(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, words)``: the pattern spans and the candidates of each row, each text read whole and by itself."""
    schema = f"doc_id long, base {SPANS}, words {WORDS}"
    out = arrow_schema(T._parse_datatype_string(schema))
    structs = lambda f, rows: pa.array([[dict(zip(f.type.value_type.names, x)) for x in r] for r in rows], f.type)

    def scan(batches):
        for b in batches:
            texts = [t.as_py() or "" for t in b.column(1)]
            base = [base_spans(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), structs(out.field(1), base), structs(out.field(2), map(candidates, texts, base))], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def cuts(found: DataFrame, level: float = FALSE) -> dict[int, int]:
    """For each stratum the least step that Benjamini and Hochberg's rule rejects among the different words of all rows.

    What comes to the driver are counts of words by stratum and step, bounded by the grid.
    """
    words = found.select(F.explode("words").alias("w")).select("w.stratum", "w.step", "w.word").distinct()
    counts: dict[int, list] = {}
    for r in words.groupBy("stratum", "step").count().collect():
        counts.setdefault(r["stratum"], []).append((r["step"], r["count"]))
    out = {}
    for s, steps in counts.items():
        m, below = sum(n for _, n in steps), 0
        for step, n in sorted(steps, reverse=True):
            below += n
            if 10 ** (-step / STEPS) <= level * below / m:
                out[s] = step
    return out


def find_secrets(docs: DataFrame, level: float = FALSE) -> DataFrame:
    """``(doc_id, base, spans)``, a row for each row of ``docs(doc_id, text, ...)``; both hold ``(kind, start, end)``.

    ``base`` are the spans of the patterns, ``spans`` all, in code points with
    the end left out, by start and then kind. A null text is empty and has none.
    Repeated rows stay, other columns are not used. The random words are those
    whose p-value lies under the cut of their stratum, taken over all rows.
    """
    found = durable(scanned(docs))
    cut = cuts(found, level)
    least = F.create_map(*[F.lit(x) for kv in cut.items() for x in kv]) if cut else F.create_map().cast("map<int,int>")
    random = F.transform(F.filter("words", lambda w: F.coalesce(w["step"] >= F.try_element_at(least, w["stratum"]), F.lit(False))), lambda w: F.struct(F.lit("random").alias("kind"), w["start"].alias("start"), w["end"].alias("end")))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(F.concat("base", random), lambda s: F.struct(s["start"].alias("a"), rank(s).alias("r"), s["end"].alias("b"), s["kind"].alias("k"))))
    return found.select("doc_id", "base", F.transform(ordered, lambda s: F.struct(s["k"].alias("kind"), s["a"].alias("start"), s["b"].alias("end"))).alias("spans"))


def redact(docs: DataFrame, level: float = FALSE) -> DataFrame:
    """The rows of ``docs`` with all spans in ``text`` replaced by their kinds; a null text stays null."""
    cut, at = cuts(durable(scanned(docs)), level), docs.columns.index("text")

    def clean(text: str) -> str:
        base = base_spans(text)
        added = [("random", a, b) for a, b, s, step, _ in candidates(text, base) if s in cut and step >= cut[s]]
        return masked(text, sorted(base + added, key=lambda s: (s[1], RANK[s[0]])))

    def scan(batches):
        for b in batches:
            columns = list(b.columns)
            columns[at] = pa.array([None if (t := x.as_py()) is None else clean(t) for x in b.column(at)], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(scan, docs.schema)


def joined(spans: str) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: str) -> Column:
    return F.size(F.filter(F.col(spans), lambda s: s["kind"] == kind)).cast("long")
