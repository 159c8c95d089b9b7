"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns find what is written in the usual way.  The field adds what they miss: phone
numbers without a plus sign, addresses with ``(at)`` and ``[dot]``, cards and network
addresses written with other separators.  Steps:

1. A text's code points become classes and, by differences of these, tokens: a run of
   letters, a run of digits, or one other sign.  All is array work, over many texts at once.
2. A token's shape is a small number: what kind of run, how long, how capitalised, which
   sign, and whether white space stands before it.  Features of a token are the shapes at
   and around it (five alone, two pairs).
3. ``fit`` learns a weight for each feature and label, and for each pair of neighbouring
   labels, from a small labelled table, by the gradient of the exact likelihood (forward and
   backward sums over padded sentences).  Labels are O and the kinds.
4. Most tokens can be nothing but O: no stretch through them can make up by the tokens'
   own weights what changing label and back costs.  Running sums find the others exactly;
   they form short runs, which Viterbi decodes in batches of runs of like length.
5. A decoded span is kept if it holds what its kind needs (digits of a card that pass Luhn,
   four parts of an address of at most 255, and so on) and touches no span of a pattern.

Defined results: a null or empty text has no spans; positions are code points; a text is
judged whole, in the same way whatever stands around it in its batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

KINDS = ("email", "ip", "card", "phone")
#: Labels: none, then the kinds.
N_LABELS = 1 + len(KINDS)
#: Code points that a task takes at once (a longer text is taken alone), and cells of a Viterbi batch.
AT_ONCE, CELLS = 1 << 20, 1 << 20

# ------------------------------------------------------------------------- patterns

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits that fails at its first digit fails at the others, so runs are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    d = _digits(text)
    return 12 <= len(d) <= 19 and luhn(d)


def is_ip(parts: list[str]) -> bool:
    return len(parts) == 4 and all(len(p.lstrip("0")) <= 3 and int(p[-3:] if len(p) > 3 else p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of each match of the patterns, sorted; no pattern scans a stretch twice."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if is_ip(m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if is_card(m.group())]
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return sorted(out)


# --------------------------------------------------------------------------- shapes

LETTER, DIGIT, SIGN, GAP = 1, 2, 3, 0
#: Signs with a shape of their own; any other ASCII sign has the shape after them.
SIGNS = "@.-_+()[]{}<>/\\:,;=#%&*!?\"'|~"
_AT_DOT = {"at": 0, "dot": 1}
#: Shapes: 0 beyond the text, 1..8 letters, 9..18 digits, then signs, then the words of _AT_DOT; each with and without a gap before it.
FIRST_SIGN = 19
N_SHAPES = 2 * (FIRST_SIGN + len(SIGNS) + 1 + len(_AT_DOT))


def _class_table() -> tuple[np.ndarray, np.ndarray]:
    """Class and sign shape of each ASCII code."""
    kinds, signs = np.full(128, SIGN, np.uint8), np.full(128, FIRST_SIGN + len(SIGNS), np.uint8)
    for c in range(128):
        if chr(c) in "\t\n\x0b\x0c\r ":
            kinds[c] = GAP
        elif chr(c).isdigit():
            kinds[c] = DIGIT
        elif chr(c).isalpha():
            kinds[c] = LETTER
    for i, c in enumerate(SIGNS):
        signs[ord(c)] = FIRST_SIGN + i
    return kinds, signs


_KIND, _SIGN = _class_table()
_DIGIT_SHAPE = np.array([0, 9, 10, 11, 12, 13, 14, 15, *[16] * 4, *[17] * 8, 18], np.uint8)  # by length, 20 and over: 18


def tokens(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shapes) of the tokens of an array of code points; code 0x110000 parts texts (a gap)."""
    ascii_code = np.minimum(codes, 127)
    kind = _KIND[ascii_code]
    kind[codes > 127] = LETTER
    kind[(codes == 0x110000) | (codes == 0x85) | (codes == 0xA0)] = GAP
    edge = np.empty(len(kind), bool)
    edge[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge |= kind == SIGN
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], len(kind))
    kinds = kind[starts]
    gap = np.zeros(len(starts), np.uint8)
    gap[1:] = kinds[:-1] == GAP
    gap[:1] = 1
    real = kinds != GAP
    starts, ends, kinds, gap = starts[real], ends[real], kinds[real], gap[real]
    n = ends - starts
    shape = np.zeros(len(starts), np.uint8)
    first = codes[starts]
    shape[kinds == SIGN] = _SIGN[np.minimum(first[kinds == SIGN], 127)]
    digit = kinds == DIGIT
    shape[digit] = _DIGIT_SHAPE[np.minimum(n[digit], 20)]
    letter = np.flatnonzero(kinds == LETTER)
    upper = np.concatenate([[0], np.cumsum((codes >= 65) & (codes <= 90))])
    ups, size = upper[ends[letter]] - upper[starts[letter]], n[letter]
    head = (first[letter] >= 65) & (first[letter] <= 90)
    plain = np.where(size == 1, 1, np.where(size <= 3, 2, 3))
    own = np.where(ups == 0, plain, np.where(ups == size, np.where(size == 1, 4, 5), np.where(head & (ups == 1), 6, 7)))
    own[first[letter] > 127] = 8
    for word, i in _AT_DOT.items():
        some = np.flatnonzero(size == len(word))
        same = np.ones(len(some), bool)
        for k, c in enumerate(word):
            same &= (codes[starts[letter[some]] + k] | 32) == ord(c)
        own[some[same]] = FIRST_SIGN + len(SIGNS) + 1 + i
    shape[letter] = own
    return starts, ends, shape * 2 + gap


#: Features of a token: shapes at these distances alone, and these pairs of neighbours.
ALONE, PAIRS = (-2, -1, 0, 1, 2), ((-1, 0), (0, 1))
N_FEATURES = len(ALONE) * N_SHAPES + len(PAIRS) * N_SHAPES**2


def windows(shapes: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Shapes two before to two after each token (a column each), 0 beyond its text."""
    out = np.zeros((len(shapes), 5), np.int64)
    for j, d in enumerate(ALONE):
        a, b = max(0, -d), len(shapes) - max(0, d)
        if b > a:
            out[a:b, j] = np.where(texts[a + d : b + d] == texts[a:b], shapes[a + d : b + d], 0)
    return out


def features(window: np.ndarray) -> np.ndarray:
    """Numbers of the features of each window (a row of seven)."""
    alone = window + np.arange(len(ALONE)) * N_SHAPES
    base = len(ALONE) * N_SHAPES
    pairs = [base + i * N_SHAPES**2 + window[:, 2 + a] * N_SHAPES + window[:, 2 + b] for i, (a, b) in enumerate(PAIRS)]
    return np.column_stack([alone, *pairs])


# ---------------------------------------------------------------------------- field


class Field:
    """Weights of features (N_FEATURES x labels) and of neighbouring labels."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights.astype(np.float32), moves  # a text begins and ends beside O
        self.stay = moves[1:, 1:].max() - moves[0, 0]
        self.change = moves[0, 1:].max() + moves[1:, 0].max() - 2 * moves[0, 0]

    def emissions(self, window: np.ndarray) -> np.ndarray:
        """Scores of the labels of each token, found once for each distinct window."""
        key = window[:, 0]
        for j in range(1, 5):
            key = key * N_SHAPES + window[:, j]
        _, first, where = np.unique(key, return_index=True, return_inverse=True)
        return self.weights[features(window[first])].sum(axis=1, dtype=np.float64)[where]

    def open(self, emissions: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Tokens that a stretch of labels other than O may cover in a best sequence.

        Such a stretch beats O on the same tokens by at most ``change``, the tokens' own
        advantages, and ``stay`` for each step within it; a token is open if a stretch
        through it has a positive bound.  Running sums and their extremes find all at once.
        """
        own = emissions[:, 1:].max(axis=1) - emissions[:, 0] + self.stay
        part = np.zeros(len(own))
        part[1:] = np.where(texts[1:] != texts[:-1], -1e6, 0)  # no stretch crosses texts
        after = np.cumsum(own + part)
        before = after - own  # sums up to the token, its own left out
        return np.maximum.accumulate(after[::-1])[::-1] - np.minimum.accumulate(before) + self.change - self.stay > -1e-3

    def viterbi(self, emissions: np.ndarray) -> np.ndarray:
        """Best labels of runs (runs x length x labels) that begin and end beside O."""
        runs, length, _ = emissions.shape
        back = np.zeros((length, runs, N_LABELS), np.int8)
        best = emissions[:, 0] + self.moves[0]
        for t in range(1, length):
            through = best[:, :, None] + self.moves
            back[t] = through.argmax(axis=1)
            best = through.max(axis=1) + emissions[:, t]
        out = np.zeros((runs, length), np.int8)
        out[:, -1] = (best + self.moves[:, 0]).argmax(axis=1)
        for t in range(length - 1, 0, -1):
            out[:, t - 1] = back[t, np.arange(runs), out[:, t]]
        return out

    def labels(self, window: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """The best label of every token of whole texts."""
        out = np.zeros(len(window), np.int8)
        emissions = self.emissions(window)
        open_at = np.flatnonzero(self.open(emissions, texts)) if len(out) else out
        if not len(open_at):
            return out
        new = np.concatenate([[True], (np.diff(open_at) != 1) | (texts[open_at][1:] != texts[open_at][:-1])])
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(open_at)))
        emissions = np.concatenate([emissions[open_at], [[0.0] + [-1e9] * len(KINDS)]])  # the last one fills up runs: O only
        padded = 1 << np.ceil(np.log2(length)).astype(np.int64)
        for n in np.unique(padded).tolist():
            runs, own = first[padded == n], length[padded == n]
            step = max(1, CELLS // (n * N_LABELS))
            for i in range(0, len(runs), step):
                inside = np.arange(n) < own[i : i + step, None]
                at = np.where(inside, runs[i : i + step, None] + np.arange(n), len(open_at))
                out[open_at[at[inside]]] = self.viterbi(emissions[at])[inside]
        return out


def fit(sentences: list[tuple[str, list[tuple[int, int, int]]]], rounds: int = 300, penalty: float = 0.003, move_penalty: float = 1.0) -> Field:
    """The field of most penalised likelihood for labelled sentences (text, spans as ``base_spans`` gives them)."""
    parts = []
    for text, spans in sentences:
        starts, ends, shapes = tokens(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        own = np.zeros(len(starts), np.int64)
        for a, kind, b in spans:
            own[(starts >= a) & (ends <= b)] = 1 + kind
        parts.append((features(windows(shapes.astype(np.int64), np.zeros(len(shapes), np.int64))), own))
    longest, n = max(len(own) for _, own in parts), len(parts)
    x = np.zeros((n, longest, len(ALONE) + len(PAIRS)), np.int64)
    y, mask = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (f, own) in enumerate(parts):
        x[i, : len(own)], y[i, : len(own)], mask[i, : len(own)] = f, own, True
    used, x = np.unique(x, return_inverse=True)
    x = x.reshape(n, longest, -1)
    k = N_LABELS
    w, m = np.zeros((len(used), k)), np.zeros((k, k))
    gw, gm = np.full_like(w, 1e-8), np.full_like(m, 1e-8)
    seen_w, seen_m = np.zeros_like(w), np.zeros_like(m)
    for j in range(x.shape[2]):
        np.add.at(seen_w, (x[:, :, j][mask], y[mask]), 1)
    before = np.concatenate([np.zeros((n, 1), np.int64), y[:, :-1]], axis=1)
    np.add.at(seen_m, (before[mask], y[mask]), 1)
    last = mask.sum(axis=1) - 1
    np.add.at(seen_m, (y[np.arange(n), last], 0), 1)
    log_sum = lambda v, axis: np.squeeze(t := v.max(axis=axis, keepdims=True), axis) + np.log(np.exp(v - t).sum(axis=axis))
    for _ in range(rounds):
        e = w[x].sum(axis=2)
        ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = e[:, 0] + m[0]
        for t in range(1, longest):
            step = log_sum(ahead[:, t - 1, :, None] + m, 1) + e[:, t]
            ahead[:, t] = np.where(mask[:, t, None], step, ahead[:, t - 1])
        total = log_sum(ahead[:, -1] + m[:, 0], 1)
        behind[:, -1] = m[:, 0]
        for t in range(longest - 2, -1, -1):
            step = log_sum(m + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(mask[:, t + 1, None], step, m[:, 0])
        own = np.exp(ahead + behind - total[:, None, None]) * mask[:, :, None]
        dw, dm = seen_w - penalty * w, seen_m - move_penalty * m
        for j in range(x.shape[2]):
            np.subtract.at(dw, x[:, :, j], own)
        dm[0] -= own[:, 0].sum(axis=0)
        for t in range(1, longest):
            pair = np.exp(ahead[:, t - 1, :, None] + m + (e[:, t] + behind[:, t])[:, None, :] - total[:, None, None]) * mask[:, t, None, None]
            dm -= pair.sum(axis=0)
        dm[:, 0] -= own[np.arange(n), last].sum(axis=0)
        gw += dw**2
        gm += dm**2
        w += 0.5 * dw / np.sqrt(gw)
        m += 0.5 * dm / np.sqrt(gm)
    weights = np.zeros((N_FEATURES, k))
    weights[used] = w
    return Field(weights, m)


#: The labelled table: sentences with their spans marked ``{kind:text}``.
LABELLED = """
Write to {email:jo.smith@mail.example.org} before noon.
write to {email:anna at example dot org} or call
Her address is {email:k.meyer (at) web.example.net}, she said.
Mail {email:p_lopez [at] site [dot] com} for the list.
contact {email:info(at)example.com}.
reach {email:max.braun[at]post[dot]de} soon
Ask {email:first.last @ example.com} about it.
the desk, {email:help <at> corp.example.org}, is open
{email:lee dot wong at example dot net}
mail: {email:m.rossi{at}example.it}
Send it to {email:ops+news@example.co.uk}, please.
from {email:a.b@c.example.com} to {email:d-e@f.example.org}
enoi.42@x {email:noun.17@mail3.example.com} thing
The server is {ip:10.0.12.254} today.
from {ip:192 . 168 . 1 . 20} port 80
host {ip:172[.]16[.]254[.]3} was seen
seen {ip:203,0,113,77} twice
block {ip:198-51-100-23} now
login from {ip:8.8.8.8}, then {ip:1.1.1.1}.
at {ip:93(.)184(.)216(.)34} and on
Paid with {card:4111 1111 1111 1111} on Monday.
card {card:5500-0000-0000-0004}, thanks
Number {card:4012888888881881} was used.
card no. {card:3782.822463.10005} expired
use {card:4111.1111.1111.1111} for it
the {card:6011/0009/9013/9424} one
his card {card:4222_2222_2222_2} is old
card: {card:4111  1111  1111  1111}.
Call {phone:+44 20 7946 0958} after six.
call {phone:(212) 555-0143} or write
phone {phone:212-555-0187} today
tel. {phone:030/1234567}, ask for her
Phone: {phone:0049 30 901820}.
ring {phone:555.867.5309} now
his number is {phone:(030) 123 4567}
dial {phone:1-800-555-0199} for help
mobile {phone:0171 2345678} only
reach us: {phone:+1 (415) 555-2671}
call me {phone:06 12 34 56 78} tonight
fax {phone:(0221) 4710-123}.
The {phone:+1 (017) 555-7713} line
There were 1200 people and 35 dogs at 12:30.
On 2024-01-31 and 01.02.2023 it rained 12.5 mm.
Version 1.2.3 came before 2.10.0 and 3.4.
The price rose from 1,299.00 to 1,450.50 in 2023.
He looked at the dot on the map at noon.
they met at home at ten, dot by dot
The ratio 16/9 is 1.78, or 178%.
Sections 4.1.2 and 4.1.3, pages 100-120, are new.
token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" here
key: 04dbebab91ab85687d33eeaaf9ac699e1188f962
id 9807915762804490 of 2024
the order 20240131 123456 was late
a@ b and c @ d are no addresses
see @name and @other_one (at the door) [not here]
It is 10 - 20 - 30 and 40, or 5 + 6 = 11.
1 2 3 4 5 6 7 8 9 10
x = 3.14159265358979, y = 2.718281828
In 1984 (or 1985) about 2,000,000 came.
ISBN 978-3-16-148410-0 is a book.
from 09:00 to 17:00, Mon - Fri
http://www.example.com/a/b?c=1 is a link
www.example.org and example.net/de/8 are hosts
# ** && %% $$ ## and | a | b | c |
Room 101, floor 3, building 12-A.
The files a.txt and b.tar.gz, 10 MB each.
He said: "no." They (all of them) left; some stayed!
In the end, the thing was done. It was late.
und der von zu, an für ist. Das ist so
le de la et, en un. Que sur les
el de la que, en los. Para con su
Éa öb ñc. Üd èe ßf, ça.
word word word. Word, word; word: word?
A B C. d e f, g h i.
Total 12345, 67890 and 4455; 1,2,3,4 or 1 - 2 - 3.
score 3-2, 21-19, 7:5 and 100-99
Chapter 12. 34 people. 56 dogs.
Licensed under the terms of 2.0, see section 4(b).
one plain line of small words that goes on and on with no end at all in sight
Another line, of longer words; nothing within identifies anybody. Everything continues
word*** another%%% third### fourth&&& fifth,$$$ sixth.%%% A$$$ b### Next*** Last|||
WORDS!! IN,!! CAPITALS!! AND!! MORE.!! A!! BC!! THEN!!
Été öde ñu, über ça. Ähnlich éa ß, ob èt élan ñandú. Œuvre île à où
a b c, d e. It is at the at of an at to. The dot is at a dot. Dot at at dot
Mixed caSes and iPhone or McDonald; CamelCase, snake_case, kebab-case or a/b.
some. some. some. some. of of of of is is is is on. on. on. on. an an an other. other. other.
| one | two three | four. | five, | Six | seven
AT THE DOT, AT AN END. At. At at. at! At, at; at: (at) [at] dot. dot, dot
"""
_MARK = re.compile(r"\{(email|ip|card|phone):((?:[^{}]|\{at\})+)\}")


def labelled_sentences(text: str = LABELLED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(sentence, spans) of each line of a labelled table."""
    out = []
    for line in text.strip("\n").split("\n"):
        plain, spans, end = "", [], 0
        for m in _MARK.finditer(line):
            plain += line[end : m.start()]
            spans.append((len(plain), KINDS.index(m.group(1)), len(plain) + len(m.group(2))))
            plain, end = plain + m.group(2), m.end()
        out.append((plain + line[end:], spans))
    return out


_PARTS = re.compile("[0-9]+")
_OPEN, _CLOSE = r"\s*[\[({<]\s*", r"\s*[\])}>]\s*"
_DOTS = rf"(?:\.|{_OPEN}(?:dot|\.){_CLOSE}|\s+dot\s+)"
#: An address with its signs written out; a bare "at" counts only beside a bare "dot".
_ADDRESS = re.compile(rf"[\w%+-]+(?:{_DOTS}[\w%+-]+)*(?:{_OPEN}(?:at|@){_CLOSE}|\s*@\s*)[\w-]+(?:{_DOTS}[\w-]+)+", re.I)
_SPOKEN = re.compile(r"[\w%+-]+(?:(?:\.|\s+dot\s+)[\w%+-]+)*\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+", re.I)
_NETWORK = re.compile(r"[0-9]+(?:(?:[^\w]{1,5}|\s+dot\s+)[0-9]+){3}", re.I)


def is_whole(kind: int, text: str) -> bool:
    """Does a decoded span hold what its kind needs?"""
    if kind == 0:
        return bool(_ADDRESS.fullmatch(text) or _SPOKEN.fullmatch(text))
    if kind == 1:
        return bool(_NETWORK.fullmatch(text)) and is_ip(_PARTS.findall(text))
    if any(map(str.isalpha, text)):
        return False
    return is_card(text) if kind == 2 else 7 <= len(_digits(text)) <= 15


def decoded(field: Field, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """Spans (start, kind, end) that the field finds in each text, before any check."""
    codes = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32).copy()
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths + 1) - 1
    codes[ends[:-1]] = 0x110000
    starts, stops, shapes = tokens(codes)
    of = np.searchsorted(ends, starts, side="right")
    labels = field.labels(windows(shapes.astype(np.int64), of), of)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(labels)) - 1
    for i, j in zip(first[labels[first] > 0].tolist(), last[labels[first] > 0].tolist()):
        base = int(ends[of[i]] - lengths[of[i]])
        out[of[i]].append((int(starts[i]) - base, int(labels[i]) - 1, int(stops[j]) - base))
    return out


def judged(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """(spans of the patterns, all spans) of each text."""
    out = []
    for text, more in zip(texts, decoded(field, texts)):
        base = base_spans(text) if re.search("[0-9@]", text) else []
        taken = sorted((a, b) for a, _, b in base)
        added = []
        for a, kind, b in more:
            if is_whole(kind, text[a:b]) and not any(a < y and x < b for x, y in taken):
                added.append((a, kind, b))
        out.append((base, sorted(base + added)))
    return out


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(documents: DataFrame, field: Field, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every text; counts and digest are of the patterns' spans."""
    shared = documents.sparkSession.sparkContext.broadcast(field)  # N_FEATURES rows of nine weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            sizes = [len(t.as_py() or "") if t.is_valid else 0 for t in batch.column(1)]
            while at < batch.num_rows:
                end, size = at, 0
                while end < batch.num_rows and (end == at or size + sizes[end] <= AT_ONCE):
                    size, end = size + sizes[end], end + 1
                part = batch.slice(at, end - at)
                at = end
                found = judged(shared.value, [t or "" for t in part.column(1).to_pylist()])
                counts = [pa.array([sum(k == i for _, k, _ in base) for base, _ in found], pa.int64()) for i in range(len(KINDS))]
                digests = pa.array([sha256(shown(base).encode()).hexdigest() for base, _ in found])
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digests, pa.array([shown(spans) for _, spans in found])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    kind = documents.schema[id_col].dataType.simpleString()
    return documents.select(documents[id_col].alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, {OUT}")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``."""
    return find(table(spark, sf_dir, "documents"), fit(labelled_sentences()))
