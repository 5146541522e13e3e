"""Personal data: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns are found by linear scans. The field labels the words of whole
lines by word-shape features; it is trained here from a small labelled table of
invented lines, and decoded by Viterbi's algorithm for many lines at once. A span
of the field stays if it touches no span of the patterns and can be of its kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, batch

KINDS = ("email", "ip", "card", "phone")
RANK = {k: i for i, k in enumerate(KINDS)}

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """From one at sign to the next: the local part is what stands before it, back to the last match."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        else:
            end = at + 1  # no match can reach over this sign
        at = text.find("@", end)
    return out


def ips(text: str) -> list[Span]:
    """Dotted chains of numbers, cut into groups of four from the left."""
    out = []
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        if len(parts) < 4:
            continue
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            group = parts[i : i + 4]
            length = sum(map(len, group)) + 3
            if all(len(p := x.lstrip("0") or "0") <= 3 and int(p) <= 255 for x in group):
                out.append(("ip", start, start + length))
            start += length + 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    return out


def phones(text: str) -> list[Span]:
    out = []
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def base_spans(text: str) -> list[Span]:
    """All pattern spans, by start and then by kind as listed."""
    found = (emails(text) if "@" in text else []) + ips(text) + cards(text) + phones(text)
    return sorted(found, key=lambda s: (s[1], RANK[s[0]]))


#: The labelled table: lines with spans marked as [kind:words].
LABELLED = """
call me at [phone:(316) 555-0148] tomorrow
my number is [phone:555-123-4567] and I am home
phone: [phone:(414) 555 1791] or mail
[phone:(628) 555-0173]
[phone:(917) 555 0135] , thanks
or [phone:(303) 555-0122] in the evening
ring [phone:(646)555-0111] , please
[phone:415-555-0186]
[phone:206.555.0119] is the office
tel [phone:0171 555 2368] please
Tel.: [phone:030 5550 1234] Berlin
fax [phone:(212) 555-0199] , office
reach us on [phone:1-800-555-0147] now
mobile [phone:07700 900 461] after six
call [phone:555-0123] today
téléphone [phone:01 55 55 12 34] merci
teléfono [phone:91 555 12 34] gracias
Handy [phone:0151-5550-1234] danke
phone [phone:555.310.0142] ext
number [phone:(555)555-0100] is mine
write to [email:jane.doe (at) example.com] soon
mail [email:john at example dot com] please
[email:lea at example dot net]
or [email:PAT AT EXAMPLE DOT ORG] today
contact [email:info [at] example [dot] org] for more
[email:sales [at] example.com]
email: [email:a.smith [at] mail3.org] thanks
e-mail [email:mary_jones (at) mail.example.net] there
send it to [email:bob at mail5 dot org] or wait
ask [email:eve (at) example (dot) com] first
card [card:4111.1111.1111.1111] expires soon
visa [card:4012 - 8888 - 8888 - 1881] and name
credit card number [card:5500/0000/0000/0004] is old
pay with [card:3782.822463.10005] today
card no. [card:6011_0009_9013_9424] or cash
card [card:4000  0566  5566  5556] soon
the number 4111 1111 1111 1112 is no card
order 5500 0000 0000 0007 was sent
the server at ip [ip:10 . 0 . 0 . 12] answered
from ip [ip:172-16-254-1] we saw
host [ip:192 . 168 . 4 . 20] is up
ip [ip:10-20-30-40] again
address 192.168.1.256 is not reachable
host ip 300.12.1.7 failed
the order number is 4821 and costs 19.99 in 2024
version 3.11.2 was released on 2024-05-17 at 10:30
token = "0f7c19ab54de6083c2b7710ee94d5a3f8816cc20" from
key 5d41e0c79ab2f8836c1d and 9e107f2b1c4402aa
it rose by 12.5 % to 1,234,567 in 1999
chapter 12 verse 7 of 40 , page 103
see section 4.2.1 and table 7-3 below
room 1204 , floor 12 , building 5
the years 1914-1918 and 1939-1945 were hard
13 . of the 27 . were here
at 5 o'clock we met 3 of 10 people
12 34 56 78 were drawn
id 8f3a-22 and key 77b9 with 0x7ffe
pi is 3.14159265 or so
@ noon the shop closes
follow @someone for 100 days
we were at home and at the dot on the map
she is at work . It is late
score 21-14 after 60 minutes
the sum of 120 and 35 is 155
zip 90210 and 10115 are codes
lot 5 5 5 of 1000000 units
he ran 100 m in 9.58 s on 16 August 2009
ISBN 978-3-16-148410-0 is a book
the matrix is 4x4 with 16 entries
rows 10 - 20 - 30 - 40 of the table
on 2019-03-04 and 04.03.2019 it rained
wir sind unter [phone:0221-5550-7781] da
[phone:0331-5550-4410] , bitte nachmittags
she said [phone:0441-5550-9034] to me
der Anschluss [phone:069 5550 3321] ist neu
auf [phone:020 5550 1177] warten
it rang at [phone:011 5550 6672] today
composez le [phone:03 44 55 90 17] ce soir
c' est [phone:02 31 55 46 80] ou rien
[phone:05 61 55 72 39] à midi
marque el [phone:93 555 21 46] mañana
al [phone:95 555 40 71] , por favor
[phone:96 555 83 02] está libre
text [phone:718.555.0161] or come
text [phone:805-555-0143] or come
line [phone:(409)555-0188] is busy
so [phone:1-760-555-0126] it is
try [phone:07700 900 733] again
extension [phone:(361) 555 0170] works
mi correo: [email:luis at servidor dot es]
mon courriel , [email:anne at courrier dot fr] , marche
an [email:jan (at) postfach.de] senden
por [email:eva [at] buzon [dot] es] responde
help: [email:dan at mailhost dot com]
copy [email:ben at mail.host dot net] too
meine Mail ist [email:PIA AT POSTFACH DOT DE] danke
visa [card:4539  1488  0343  6467] here
card [card:5105  1051  0510  5100] today
[card:4916  3385  0608  2832] was charged
Karte [card:4485.0403.7153.6584] gilt
la tarjeta [card:5425.2334.3010.9903] pasa
[card:4716.1089.9971.6531] is hers
number [card:4024/0071/4500/8392] on file
account [card:5300/0000/0000/0006] closed
carte [card:4532_7153_3790_1241] refusée
amex [card:3714/496353/98431] is fine
with [card:3787_344936_71000] we paid
carte [card:3714.496353.98431] valide
the [card:3782/822463/10005] was hers
[card:3400_000000_00009] expired
use [card:5454 - 5454 - 5454 - 5454] then
pay [card:4444 . 3333 . 2222 . 1111] now
by [card:5111 . 0051 . 1105 . 1128] today
ping to [ip:172-31-255-9] failed
[ip:192-168-100-20] is ours
le poste [ip:10-8-44-201] est là
der Rechner [ip:81-12-7-160] läuft
nodo [ip:203-0-113-77] caído
via [ip:100-64-12-1] , then
[ip:198 . 51 . 100 . 23] again
to [ip:203 . 0 . 113 . 5] we sent
der Rechner [ip:8 . 8 . 4 . 4] schweigt
por [ip:172 . 20 . 10 . 2] pasa
le poste [ip:192 . 0 . 2 . 146] tombe
points 77 105 18 64 for the teams
grades 90 85 70 66 and 12
we met at noon dot com was not yet there
he looked at home dot and dash
laps 12-14-11-300 and 40
sets 6-4-7-6 and 3-6-2-6 they played
sizes 10 . 12 . and 14 . were sold
dial 9 for 1000 of 2000 lines
"""

CUES = frozenset("call phone tel tel. tel.: telephone mobile fax number reach téléphone teléfono handy card visa credit pay mail email e-mail contact write send ip host server address at dot (at) [at] (dot) [dot] version isbn page chapter token zip room id key order section".split())
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WORD = re.compile(r"\S+")
SPELLED = re.compile(r"(?i)[\w.%+-]+\s*(?:@|[(\[]at[)\]]|\sat\s)\s*[\w-]+(?:\s*(?:\.|[(\[]dot[)\]]|\sdot\s)\s*[\w-]+)+")
#: A line without any of these holds no span that the field could add: digits, at signs, and at signs and dots in words.
TRIGGER = re.compile(r"(?i)[0-9@]|[(\[]at[)\]]|\sat\s+[\w-]+\s*(?:\.|[(\[]dot[)\]]|\sdot\s)")
#: Sequences of about so many words in all are decoded together.
AT_ONCE = 200_000
PUNCTUATION = "\"'.,;:!?<>*#$%&`"


#: Four numbers of up to three digits between equal signs.
FOUR = re.compile(r"[0-9]{1,3}([.-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")


def shape(word: str) -> str:
    """Letters as x, digits as d with their number, other characters as they are; four short numbers as such, long words only by their kinds."""
    if four := FOUR.fullmatch(word):
        return f"four{four[1]}"
    out = re.sub(r"[^\W\d_]+", "x", word)
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 13)}", out)
    return out if len(out) <= 24 else "".join(sorted(set(out)))[:24]


def word_features(word: str) -> tuple[str, ...]:
    """What a word shows by itself."""
    core = word.strip(PUNCTUATION)
    low = word.lower().rstrip(":,") if len(word) < 12 else ""
    digits = sum(map(str.isdigit, core))
    kind = "letters" if core.isalpha() else "digits" if core.isdigit() else "none" if not digits and "@" not in core else "mixed"
    return (f"s={shape(core)}", f"k={kind}{min(digits, 17)}", f"c={low}" if low in CUES or low.rstrip(".") in CUES else "c=")


class Field:
    """The trained field: weights of features at a word and at its neighbours, and of label steps."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.train()
        self.memo: dict[str, int] = {}
        self.known: dict[tuple[int, int, int], int] = {(1, 1, 1): 0}  # what stands before the first word and after the last
        self.plain = self.known.setdefault(self.ids("word"), 1)
        self.summed = np.zeros((3, 0, len(LABELS)))

    def ids(self, word: str) -> tuple[int, int, int]:
        """The word's features among those of the labelled table; 0 is for any other."""
        return tuple(self.index.get(f, 0) for f in word_features(word))

    def code(self, word: str) -> int:
        """A number for the word's features; words of letters alone that are no cue have the same."""
        if word.isalpha() and word.lower() not in CUES:
            return self.plain
        got = self.memo.get(word)
        if got is None:
            got = self.known.setdefault(self.ids(word), len(self.known))
            if len(self.memo) < 100_000:
                self.memo[word] = got
        return got

    def scores(self) -> np.ndarray:
        """What each number adds to the label scores at the word after, at its own and at the word before."""
        if self.summed.shape[1] < len(self.known):
            features = np.array(list(self.known))
            self.summed = np.stack([w[features].sum(axis=1) for w in self.unary])
        return self.summed

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Label scores at each word; ``x`` (B, T, 3) holds feature numbers, with one row of padding before and after."""
        w = self.unary
        return w[0][x[:, :-2]].sum(axis=2) + w[1][x[:, 1:-1]].sum(axis=2) + w[2][x[:, 2:]].sum(axis=2)

    def pad(self, sequences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        longest = max(map(len, sequences))
        x = np.ones((len(sequences), longest + 2, 3), np.int64)
        for b, words in enumerate(sequences):
            if words:
                x[b, 1 : len(words) + 1] = [self.ids(w) for w in words]
        return x, np.array([len(s) for s in sequences])

    def train(self, rounds: int = 250, rate: float = 0.1, ridge: float = 0.02) -> None:
        """Gradient ascent on the labelled table's conditional likelihood; the same weights each time."""
        sequences, gold = [], []
        for line in LABELLED.strip().split("\n"):
            words, labels, inside = [], [], None
            for w in line.split():
                m = re.match(rf"\[({'|'.join(KINDS)}):(.+)", w)
                first = m is not None
                if m:
                    inside, w = m[1], m[2]
                ends = inside is not None and w.endswith("]") and w.lower() not in ("[at]", "[dot]")
                labels.append(LABELS.index(f"{'B' if first else 'I'}-{inside}") if inside else 0)
                words.append(w[:-1] if ends else w)
                inside = None if ends else inside
            sequences.append(words)
            gold.append(labels)
        self.index = {"": 0, "edge": 1}
        for words in sequences:
            for w in words:
                for f in word_features(w):
                    self.index.setdefault(f, len(self.index))
        n, k = len(self.index), len(LABELS)
        self.unary, self.step = np.zeros((3, n, k)), np.zeros((k, k))
        x, lengths = self.pad(sequences)
        y = np.full(x.shape[:2], -1)
        for b, labels in enumerate(gold):
            y[b, 1 : len(labels) + 1] = labels
        y = y[:, 1:-1]
        real = np.arange(y.shape[1])[None, :] < lengths[:, None]
        barred = self.barred()
        moments = [np.zeros_like(self.unary), np.zeros_like(self.step), np.zeros_like(self.unary), np.zeros_like(self.step)]
        for t in range(1, rounds + 1):
            node, edge = self.marginals(self.emissions(x), lengths)
            d = -node
            bs, ts = np.nonzero(real)
            d[bs, ts, y[bs, ts]] += 1
            d[~real] = 0
            gu = np.zeros_like(self.unary)
            for o in range(3):
                for f in range(3):
                    np.add.at(gu[o], x[:, o : o + y.shape[1], f], d)
            gs = -edge
            both = real[:, 1:]
            np.add.at(gs, (y[:, :-1][both], y[:, 1:][both]), 1)
            gu[:, 0] = 0  # unknown features stay neutral
            for i, (g, v) in enumerate(((gu - ridge * self.unary, self.unary), (gs - ridge * self.step, self.step))):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                moments[i + 2] = 0.999 * moments[i + 2] + 0.001 * g * g
                v += rate * (moments[i] / (1 - 0.9**t)) / (np.sqrt(moments[i + 2] / (1 - 0.999**t)) + 1e-8)
        self.step = np.where(barred, -1e9, self.step)

    @staticmethod
    def barred() -> np.ndarray:
        """Steps that cannot be: into the inside of a span from anything but the same kind."""
        k = len(LABELS)
        out = np.zeros((k, k), bool)
        for j, b in enumerate(LABELS):
            if b[0] == "I":
                out[:, j] = [a[2:] != b[2:] or a == "O" for a in LABELS]
        return out

    def marginals(self, e: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels at each word, and expected numbers of label steps."""
        step = np.where(self.barred(), -1e9, self.step)
        start = np.array([-1e9 if label[0] == "I" else 0.0 for label in LABELS])
        b, t, k = e.shape
        lse = lambda v, axis: (m := v.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis=axis))
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = start + e[:, 0]
        for i in range(1, t):
            alpha[:, i] = lse(alpha[:, i - 1][:, :, None] + step[None], 1) + e[:, i]
        for i in range(t - 2, -1, -1):
            on = (i + 1 < lengths)[:, None]
            beta[:, i] = np.where(on, lse(step[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
        z = lse(alpha[np.arange(b), lengths - 1], 1)
        node = np.exp(np.minimum(alpha + beta - z[:, None, None], 0))
        edge = np.zeros((k, k))
        for i in range(1, t):
            on = i < lengths
            if on.any():
                edge += np.exp(np.minimum(alpha[on, i - 1][:, :, None] + step[None] + (e[on, i] + beta[on, i])[:, None, :] - z[on][:, None, None], 0)).sum(axis=0)
        return node, edge

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels of each sequence, those of like length together."""
        out: list = [None] * len(sequences)
        order = sorted(range(len(sequences)), key=lambda i: len(sequences[i]))
        start = np.array([-1e9 if label[0] == "I" else 0.0 for label in LABELS])
        step = np.ascontiguousarray(self.step.T)
        at = 0
        while at < len(order):
            upto = at + 1
            while upto < min(len(order), at + 512) and len(sequences[order[upto]]) * (upto + 1 - at) <= AT_ONCE:
                upto += 1
            rows, at = order[at:upto], upto
            lengths = np.array([len(sequences[i]) for i in rows])
            # words run down, so that a step takes one row of the table
            x = np.zeros((lengths[-1] + 2, len(rows)), np.int64)
            for k, i in enumerate(rows):
                x[1 : lengths[k] + 1, k] = np.fromiter(map(self.code, sequences[i]), np.int64, lengths[k])
            after, own, before = self.scores()
            best, back = start + (after[x[0]] + own[x[1]] + before[x[2]]), np.zeros((lengths[-1], len(rows), len(LABELS)), np.int8)
            for t in range(1, int(lengths[-1])):
                live = np.searchsorted(lengths, t, side="right")  # shorter ones have ended
                through = best[live:, None, :] + step
                back[t, live:] = came = through.argmax(axis=2)
                best[live:] = np.take_along_axis(through, came[:, :, None], axis=2)[:, :, 0] + (after[x[t, live:]] + own[x[t + 1, live:]] + before[x[t + 2, live:]])
            last = best.argmax(axis=1)
            labels = np.zeros((lengths[-1], len(rows)), np.int8)
            for t in range(int(lengths[-1]) - 1, -1, -1):
                live = np.searchsorted(lengths, t, side="right")
                labels[t, live:] = last[live:]
                if t:
                    last[live:] = back[t, np.arange(live, len(rows)), last[live:]]
            for k, i in enumerate(rows):
                out[i] = labels[: lengths[k], k]
        return out


@cache
def field() -> Field:
    """The trained field; one for each worker process."""
    return Field()


def possible(kind: str, text: str) -> bool:
    """Whether a text can be of a kind at all."""
    if kind == "email":
        return bool(SPELLED.fullmatch(text))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p := x.lstrip("0") or "0") <= 3 and int(p) <= 255 for x in parts)
    digits = re.sub("[^0-9]", "", text)
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def lines_of(text: str) -> list[tuple[int, str]]:
    """Where each line begins that can hold a span of the field, and the line."""
    if not TRIGGER.search(text):
        return []
    out, at = [], 0
    for line in text.split("\n"):
        if TRIGGER.search(line):
            out.append((at, line))
        at += len(line) + 1
    return out


def runs(labels: np.ndarray):
    """Label, first and last word of each span that the labels mark."""
    marked = np.flatnonzero(labels)
    t = 0
    while t < len(marked):
        first = last = int(marked[t])
        kind, t = LABELS[labels[first]][2:], t + 1
        while t < len(marked) and marked[t] == last + 1 and LABELS[labels[marked[t]]] == f"I-{kind}":
            last, t = last + 1, t + 1
        yield kind, first, last


def find_all(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the pattern spans, and all spans with those that the field adds; both in order."""
    crf, found = field(), [(base_spans(text), []) for text in texts]
    places = [(i, at, line) for i, text in enumerate(texts) for at, line in lines_of(text)]
    for (i, at, line), labels in zip(places, crf.decode([WORD.findall(line) for _, _, line in places])):
        if not labels.any():
            continue
        words, base = [m.span() for m in WORD.finditer(line)], found[i][0]
        starts, ends = [a for _, a, _ in base], list(accumulate((b for _, _, b in base), max))
        for kind, first, last in runs(labels):
            start, end = words[first][0], words[last][1]
            while start < end and (line[start] in PUNCTUATION or line[start].isspace()):
                start += 1
            while end > start and (line[end - 1] in PUNCTUATION or line[end - 1].isspace()):
                end -= 1
            if possible(kind, line[start:end]):
                before = bisect_left(starts, at + end)  # so many pattern spans begin before its end
                if not before or ends[before - 1] <= at + start:
                    found[i][1].append((kind, at + start, at + end))
    return [(base, sorted(base + added, key=lambda s: (s[1], RANK[s[0]]))) for base, added in found]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _slices(batches, column: int, rows: int = 1000):
    for b in batches:
        for i in range(0, len(b), rows):
            part = b.slice(i, rows)
            yield part, [t or "" for t in part.column(column).to_pylist()]


def find_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, a row for each row of ``docs(doc_id, text, ...)``.

    The counts and the hash are those of the pattern spans; ``spans`` holds all,
    in code points with the end left out. A null text is empty and has none.
    Repeated rows stay; other columns are not used.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    out = arrow_schema(T._parse_datatype_string(schema))

    def scan(batches):
        for part, texts in _slices(batches, 1):
            rows = [(*(sum(s[0] == k for s in base) for k in KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)) for base, spans in find_all(texts)]
            yield batch(out, part.column(0), *zip(*rows))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the union, by the first one's."""
    out, at = [], 0
    merged: list[list] = []
    for k, a, b in spans:
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([k, a, b])
    for k, a, b in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all spans in ``text`` replaced by their kinds; a null text stays null.

    ``n_chars``, where there is such a column, follows the text.
    """
    import pyarrow as pa

    names = docs.columns
    at = names.index("text")

    def scan(batches):
        for part, texts in _slices(batches, at):
            new = [masked(t, spans) if valid else None for t, (_, spans), valid in zip(texts, find_all(texts), part.column(at).is_valid().to_pylist())]
            columns = list(part.columns)
            columns[at] = pa.array(new, part.schema.field(at).type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([None if t is None else len(t) for t in new], part.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(scan, docs.schema)
