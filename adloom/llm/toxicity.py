"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks, on sentences.

Documents are cut into sentences (at a full stop, exclamation or question mark before
white space, and at blank lines), and a sentence is read as letters with a mark before
each word.  Kernel: gap-weighted common subsequences of four letters that span at most
six, each worth a power of ``DECAY`` in its span, with starts in a stretch of eight
letters, between runs of one, two or three words (divided by the length of a run in
feature space, so short words count as long ones).  A sentence scores by its worst run
of each number of words, so insults of several words are seen whole.  A letter put into
an insult, left out or changed leaves most subsequences in place; characters that are no
letters are passed over, and three or more single letters in a row are read as one word.
Letters of other scripts have eight codes of their own, by their place in Unicode: two of one
script may share one, but none is that of a Latin letter.

Training, on sentences of labelled documents, which have their document's label: (1)
letter groups that toxic documents have too often (z-scores of document counts, summed
by Spark) point at witness sentences of each toxic document and at the most misleading
ones of clean ones, and in each at the worst stretch of its runs of each number of words
(the stretch that scores it, with what its eight starts reach); (2) frequent witnesses and
misleading stretches become landmarks, and a squared-hinge SVM is fitted in their Nyström space; (3) witnesses are chosen again by
that SVM and it is fitted anew.  This is done for all labelled documents and for each
half of them; the halves score each other's documents, and a logistic curve over the
worst sentences' scores of these, all left out of the fit that scored them, calibrates.

The decision is linear in the landmarks' subsequences, so it collapses into one table
of subsequence weights, and scoring a sentence is a sum of table look-ups.

The fit uses at most ``MAX_LABELLED`` labelled rows (by a hash of the id); scoring
covers every row and whole texts.  Labels, lang, source and doc_id are no inputs of
a score.  Defined results: a null or wordless text gets the score of no evidence;
where a half of the labelled rows has one class only, or there are none, every score is
the smoothed share of toxic rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table
from .learning import fold, labelled_sample

#: Bound of the labelled documents of a fit.
MAX_LABELLED = 12_000
#: Held-out rows are those with fold HELD_OUT of FOLDS.
FOLDS, HELD_OUT = 3, 1
DECAY = 0.7
ORDER, SPAN, STRETCH = 4, 6, 8
TOXIC_LANDMARKS, CLEAN_LANDMARKS = 192, 96
#: Bound of the distinct stretches of each side in a fit, the most frequent ones; a half's fit takes half as many.
TOXIC_RUNS, CLEAN_RUNS = 4_000, 12_000
#: Sentences of a toxic and of a clean document that are instances of the fit.
WITNESSES, MISLEADING = 2, 3
NO_EVIDENCE, EVIDENCE, RUN = -2.0, 4, 3
#: Characters that a task reads at once, about; longer texts are cut, between sentences only.
PIECE = 1 << 18
_STOP = re.compile("[.!?\u3002\uff01\uff1f][\t\n\x0b\x0c\r \x85\xa0\u2028\u2029\u3000]")
_COMBOS = [c for c in combinations(range(1, SPAN), ORDER - 1)]
#: Letters: 0 the gap between sentences, 1..26 a to z, 27..30 other Latin ones, 31 the mark before a word, 32..39 other scripts.
BASE = 40
_CODES = BASE**ORDER
_WORD, _SPACE, _LINE, _END, _TEXT, _FILL = 31, 40, 41, 42, 43, 44
_OTHER = BASE - 1 - _WORD
_LETTER = np.full(0x32000, _WORD + 1, np.uint8)  # any other sign, and what lies beyond
_LETTER[:0x300] = _FILL
_LETTER[ord("a") : ord("z") + 1] = np.arange(1, 27)
_LETTER[0xC0:0x300] = 27 + np.arange(0xC0, 0x300) % 4
_LETTER[0x2FF] = 30
for _c in range(0x370, len(_LETTER)):
    if unicodedata.category(chr(_c))[0] in "LM":
        _LETTER[_c] = _WORD + 1 + _c % _OTHER
_LETTER[[9, 11, 12, 13, 32, 0x85, 0xA0, 0x3000]] = _SPACE
_LETTER[[10, 0x2028, 0x2029]] = _LINE
_LETTER[[ord(c) for c in ".!?。！？"]] = _END
_LETTER[0] = _TEXT
#: Codes of four letters, none of them the gap between sentences.
_VALID = np.all([np.arange(_CODES) // BASE**i % BASE != 0 for i in range(ORDER)], axis=0)


def _norms() -> np.ndarray:
    """Length of a stretch of n letters in feature space (as if no group repeats)."""
    out = np.ones(STRETCH + SPAN)
    for n in range(1, len(out)):
        out[n] = np.sqrt(max(1e-9, sum(max(0, min(STRETCH, n - c[-1])) * DECAY ** (2 * (c[-1] + 1)) for c in _COMBOS)))
    return np.maximum(out, out[ORDER])


_NORM = _norms()


class Letters:
    """Sentences as one flat array of letter codes, with STRETCH zeros before each and after the last."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray):
        self.flat, self.start, self.end, self.text = flat, start, end, text

    @classmethod
    def of_texts(cls, texts: list[str | None]) -> Letters:
        points = np.frombuffer("\0".join((t or "").replace("\0", " ") for t in texts).lower().encode("utf-32-le", "replace"), np.uint32)
        raw = _LETTER[np.minimum(points, len(_LETTER) - 1)]
        after = np.r_[raw[1:], _TEXT]
        raw = np.where((raw == _END) & ((after < _SPACE) | (after == _FILL) | (after == _END)), _FILL, raw)  # within a word
        at = np.flatnonzero(raw < _SPACE)
        n = len(at)
        if not n:
            return cls(np.zeros(STRETCH, np.int32), *(np.zeros(0, np.int64),) * 3)
        gaps = np.cumsum((raw >= _SPACE) & (raw < _FILL))[at]
        breaks = np.cumsum(np.array([0, 1, 2, 2, 0], np.int8)[np.clip(raw, _SPACE, _FILL) - _SPACE], dtype=np.int64)[at]
        of = np.cumsum(raw == _TEXT)[at]
        first = np.r_[True, np.diff(breaks) > 1]  # a blank line, or the end of a sentence or text
        word = np.r_[True, np.diff(gaps) > 0] | first
        one = word & np.r_[word[1:], True]  # words of one letter
        joined = np.r_[False, one[1:] & one[:-1] & ~first[1:]]  # to the one before
        run = joined & (np.r_[False, joined[:-1]] | np.r_[joined[1:], False])
        word &= ~run
        place = np.cumsum(1 + word + STRETCH * first) - 1
        flat = np.zeros(place[-1] + 1 + STRETCH, np.int32)
        flat[place] = raw[at]
        flat[place[word] - 1] = _WORD
        start = place[first] - 1
        return cls(flat, start, np.r_[place[np.flatnonzero(first)[1:] - 1], place[-1]] + 1, of[first])

    @classmethod
    def of_codes(cls, pieces: list[bytes]) -> Letters:
        sizes = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(sizes + STRETCH) - sizes
        flat = np.frombuffer(b"".join(bytes(STRETCH) + p for p in pieces) + bytes(STRETCH), np.uint8).astype(np.int32)
        return cls(flat, start, start + sizes, np.arange(len(pieces)))

    def groups(self, combos=_COMBOS) -> Iterator[tuple[np.ndarray, float]]:
        """Codes of all subsequences of each shape, by their first place, and their weight."""
        parts = [self.flat * BASE**i for i in range(ORDER)]
        for c in combos:
            n = max(0, len(self.flat) - c[-1])
            code = parts[3][:n] + parts[2][c[0] : c[0] + n] + parts[1][c[1] : c[1] + n] + parts[0][c[2] : c[2] + n]
            yield code, DECAY ** (c[-1] + 1)

    def values(self, weights: np.ndarray, combos=_COMBOS) -> list[np.ndarray]:
        """For runs of 1, 2, ... RUN words, at each place in the run's first word: the normalised weight of the stretch from there."""
        word = np.cumsum(self.flat == _WORD)
        t = np.zeros((RUN, len(self.flat) + 1))
        sums: dict[int, np.ndarray] = {}
        for (code, w), c in zip(self.groups(combos), combos):
            own = weights[code] * np.float32(w)
            sums[c[-1]] = sums[c[-1]] + own if c[-1] in sums else own
        for last, own in sums.items():
            wide = word[last:] - word[: len(own)]
            for r in range(RUN):
                t[r, 1 : len(own) + 1] += np.where(wide <= r, own, 0)
        total = np.cumsum(t, axis=1)
        at = np.flatnonzero(self.flat)
        first = np.flatnonzero(self.flat == _WORD)
        sentence = np.searchsorted(self.start, first, side="right") - 1
        ends = np.minimum(np.r_[first[1:], len(self.flat)], self.end[sentence])
        w = word[at] - 1
        out = []
        for r in range(RUN):
            have = np.r_[sentence[r:] == sentence[: len(sentence) - r], np.zeros(min(r, len(sentence)), bool)]
            own = have[w]
            place, a = at[own], w[own]
            stop = np.minimum(place + STRETCH, ends[a + r])
            value = np.zeros(len(place))
            low = place
            for k in range(r + 1):  # starts in the run's k-th word reach into what is left of the run
                high = np.maximum(low, np.minimum(stop, ends[a + k]))
                value += total[r - k][high] - total[r - k][low]
                low = high
            value /= _NORM[np.minimum(ends[a + r] - first[a], len(_NORM) - 1)]
            value[(place != first[a]) & (place + STRETCH > ends[a + r])] = -np.inf
            whole = np.full(len(self.flat), -np.inf)
            whole[place] = value
            out.append(whole)
        return out

    def scores(self, weights: np.ndarray, combos=_COMBOS) -> np.ndarray:
        """[sentence, words of a run]: the greatest weight of any stretch, -inf without such a run."""
        if not len(self.start):
            return np.zeros((0, RUN))
        return np.stack([np.maximum.reduceat(v, self.start) for v in self.values(weights, combos)], axis=1)

    def norms(self) -> np.ndarray:
        return _NORM[np.minimum(self.end - self.start, len(_NORM) - 1)]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int]]]:
    """Texts in lots of about PIECE characters, and which text each part belongs to.

    Long texts are cut after sentences, so every sentence is whole in one part.
    """
    own, of, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while True:
            stop = _STOP.search(text, at + PIECE - 1) if len(text) - at > PIECE else None
            end = stop.end() if stop else len(text)
            own.append(text[at:end])
            of.append(i)
            size += end - at
            if size >= PIECE:
                yield own, of
                own, of, size = [], [], 0
            at = end
            if at >= len(text):
                break
    if own:
        yield own, of


def evidence_of(texts: list[str | None], weights: np.ndarray, combos=_COMBOS) -> np.ndarray:
    """EVIDENCE numbers about the worst sentences of each text, for runs of each number of words."""
    scores, text = [np.zeros((0, RUN))], [np.zeros(0, np.int64)]
    for own, of in _pieces(texts):
        letters = Letters.of_texts(own)
        scores.append(letters.scores(weights, combos))
        text.append(np.array(of, np.int64)[letters.text])
    scores, text = np.concatenate(scores), np.concatenate(text)
    out = np.zeros((len(texts), RUN, EVIDENCE))
    out[:, :, :2] = NO_EVIDENCE
    starts = np.searchsorted(text, np.arange(len(texts) + 1))
    for i, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        for r in range(RUN if b > a else 0):
            s = np.unique(scores[a:b, r])  # sentences alike count once
            best = np.maximum(s[-3:], NO_EVIDENCE)
            over = int((s > 0).sum())
            out[i, r] = best[-1], best.mean(), np.log1p(over), np.log1p(100 * over / len(s))
    return out.reshape(len(texts), RUN * EVIDENCE)


#: A table of weights by its codes that are not zero, as drivers hold and send it: few of BASE ** ORDER.
Packed = tuple[np.ndarray, np.ndarray]
NOTHING: Packed = (np.zeros(0, np.int32), np.zeros(0, np.float32))


def unpacked(table: Packed) -> np.ndarray:
    out = np.zeros(_CODES, np.float32)
    out[table[0]] = table[1]
    return out


class Model:
    def __init__(self, share: float):
        self.table = NOTHING
        self.curve: np.ndarray | None = None
        self.prior = share

    @property
    def weights(self) -> np.ndarray:
        return unpacked(self.table)

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(evidence), self.prior)
        return 1 / (1 + np.exp(-np.clip(np.c_[evidence, np.ones(len(evidence))] @ self.curve, -30, 30)))


def _group_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes of runs of four letters, and [half, label, code] the documents of each half and label that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((4, _CODES), np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                kind = 2 * few.column("half").to_numpy() + few.column("y").to_numpy().astype(np.int64)
                seen = [np.zeros(0, np.int64)]
                for own, of in _pieces(few.column("text").to_pylist()):
                    letters = Letters.of_texts(own)
                    code = next(letters.groups(_COMBOS[:1]))[0]
                    place = np.flatnonzero(_VALID[code])
                    text = np.array(of, np.int64)[letters.text[np.searchsorted(letters.start, place, side="right") - 1]] if len(place) else place
                    seen.append(np.unique(text * _CODES + code[place]))
                text, code = np.divmod(np.unique(np.concatenate(seen)), _CODES)
                np.add.at(counts, (kind[text], code), 1)
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(counts[i, some].astype(np.int64)) for i in range(4))], names=["code", "n0", "n1", "n2", "n3"])

    sums = rows.select("text", "y", "half").mapInArrow(run, "code int, n0 long, n1 long, n2 long, n3 long").groupBy("code").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(4)])
    got = sums.where("n0 + n1 + n2 + n3 > 1").toArrow()  # at most BASE ** ORDER rows of five numbers
    return got["code"].to_numpy(), np.array([got[f"n{i}"].to_numpy() for i in range(4)], float).reshape(2, 2, -1)


def _worst_stretch(letters: Letters, value: np.ndarray, r: int, sentence: int) -> bytes:
    """The letters that a sentence's worst stretch reaches in its run of r + 1 words."""
    a, b = int(letters.start[sentence]), int(letters.end[sentence])
    p = a + int(np.argmax(value[a:b]))
    words = np.flatnonzero(letters.flat[p + 1 : b] == _WORD)
    stop = p + 1 + int(words[r]) if len(words) > r else b
    return letters.flat[p : min(stop, p + STRETCH + SPAN - 1)].astype(np.uint8).tobytes()


def _chosen(text: np.ndarray, scores: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sentences to learn from: the worst of each text, alike ones once, and of clean texts two others, by their places."""
    there = np.flatnonzero(np.isfinite(scores))
    order = there[np.lexsort((-scores[there], text[there]))]
    t, s = text[order], scores[order]
    new = np.r_[True, (t[1:] != t[:-1]) | (s[1:] != s[:-1])][: len(t)]
    order, t = order[new], t[new]
    begin = np.searchsorted(t, t)
    worst = order[np.arange(len(t)) - begin < np.where(toxic[t], WITNESSES, MISLEADING)]
    clean = np.unique(t[~toxic[t]])
    first, size = np.searchsorted(text[there], clean), np.searchsorted(text[there], clean, side="right") - np.searchsorted(text[there], clean)
    return np.concatenate([worst, there[first + size // 3], there[first + 2 * size // 3]])


def _instances(rows: DataFrame, tables: list[Packed], combos) -> list[tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]]:
    """For each table of weights the witness stretches of toxic documents, and misleading and other ones of clean ones, with counts.

    Table 0 and 1 are of the halves, and get their own half's documents; table 2 gets all.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [unpacked(t) for t in shared.value]
        for batch in batches:
            out: list[tuple[int, bytes, int]] = []
            for half in (0, 1):
                own = batch.filter(pa.array(batch.column("half").to_numpy() == half))
                toxic = own.column("y").to_numpy() > 0.5
                lot, size = [], 0
                texts = own.column("text").to_pylist()
                for i, t in enumerate(texts):  # whole texts, for each is judged as one
                    lot.append(t)
                    size += len(t or "")
                    if size < PIECE and i < len(texts) - 1:
                        continue
                    letters, base = Letters.of_texts(lot), i + 1 - len(lot)
                    lot, size = [], 0
                    if not len(letters.start):
                        continue
                    text = letters.text + base
                    for which in (half, 2):
                        values = letters.values(weights[which], combos)
                        for r in range(RUN):
                            for s in _chosen(text, np.maximum.reduceat(values[r], letters.start), toxic).tolist():
                                out.append((which, _worst_stretch(letters, values[r], r, s), int(toxic[text[s]])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.int32())], names=["which", "run", "y"])

    counted = rows.select("text", "y", "half").mapInArrow(run, "which int, run binary, y int").groupBy("which", "run", "y").count()
    times: list[dict[tuple[bytes, int], int]] = [{}, {}, {}]
    for r in counted.toLocalIterator():  # a few runs a sampled document
        times[r["which"]][bytes(r["run"]), r["y"]] = r["count"]
    out = []
    for own, share in zip(times, (2, 2, 1)):
        n_toxic, n_clean = (max(1, sum(n for (_, y), n in own.items() if y == k)) for k in (1, 0))
        # A witness that is as usual in clean documents is none.
        toxic = [(w, n) for (w, y), n in own.items() if y and n / n_toxic > 4 * own.get((w, 0), 0) / n_clean]
        clean = [(w, n) for (w, y), n in own.items() if not y]
        most = lambda runs, n: sorted(runs, key=lambda x: (-x[1], _mixed(x[0])))[:n]
        out.append((most(toxic, TOXIC_RUNS // share), most(clean, CLEAN_RUNS // share)))
    return out


def _mixed(run: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(run)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> np.ndarray:
    """Weights and bias of a squared-hinge SVM, by Newton steps."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1])
    keep[-1, -1] = 1e-3
    for i in range(30):
        active = y * (x @ w) < 1
        a = x[active] * (cost * weight[active])[:, None]
        new = np.linalg.solve(keep + a.T @ x[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * (w + new) if i > 15 else new
    return w


def landmark_features(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the landmarks' subsequences, and their weights in each landmark, of unit length."""
    letters = Letters.of_codes(marks)
    code, mark, value = [], [], []
    for c, w in letters.groups():
        at = np.flatnonzero(_VALID[c])
        own = np.searchsorted(letters.start, at, side="right") - 1
        at, own = at[at - letters.start[own] < STRETCH], own[at - letters.start[own] < STRETCH]
        code.append(c[at])
        mark.append(own)
        value.append(np.full(len(at), w))
    codes, column = np.unique(np.concatenate(code), return_inverse=True)
    phi = np.zeros((len(codes), len(marks)))
    np.add.at(phi, (column, np.concatenate(mark)), np.concatenate(value))
    return codes, phi / (np.sqrt((phi**2).sum(axis=0)) + 1e-12)


def kernel(runs: list[bytes], codes: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Normalised kernel values of runs with landmarks."""
    at_code = np.full(_CODES, -1, np.int32)
    at_code[codes] = np.arange(len(codes))
    out = np.zeros((len(runs), phi.shape[1]))
    small = phi.astype(np.float32)
    for i in range(0, len(runs), 4000):
        own = Letters.of_codes(runs[i : i + 4000])
        for code, w in own.groups():
            hit = np.flatnonzero(at_code[code] >= 0)
            run = np.searchsorted(own.start, hit, side="right") - 1
            hit, run = hit[hit - own.start[run] < STRETCH], run[hit - own.start[run] < STRETCH]
            first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]]) if len(run) else run
            if len(run):
                out[i + run[first]] += w * np.add.reduceat(small[at_code[code[hit]]], first)
        out[i : i + 4000] /= own.norms()[:, None]
    return out


def _fit_runs(toxic: list[tuple[bytes, int]], clean: list[tuple[bytes, int]]) -> Packed:
    """The table of subsequence weights of an SVM over Nyström landmarks."""
    marks = [w for w, _ in toxic[:TOXIC_LANDMARKS]] + [w for w, _ in clean[:CLEAN_LANDMARKS]]
    if not toxic or not clean:
        return NOTHING
    codes, phi = landmark_features(marks)
    y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
    weight = np.minimum(np.array([n for _, n in toxic] + [n for _, n in clean], float), 20)
    for side in (1, -1):
        weight[y == side] /= weight[y == side].sum()
    weight *= len(y) / 2
    values, vectors = np.linalg.eigh(phi.T @ phi + 1e-6 * np.eye(len(marks)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # Nyström map
    w = _svm(kernel([w for w, _ in toxic] + [w for w, _ in clean], codes, phi) @ root, y, weight)
    return codes, (phi @ (root @ w[:-1])).astype(np.float32)


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model from labelled rows outside the held-out fold."""
    sample = labelled_sample(labels, label, FOLDS, HELD_OUT, MAX_LABELLED)
    joined = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # MAX_LABELLED rows of two numbers
    rows = cut(joined.select("text", "y", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")))
    sizes = np.zeros((2, 2))
    for r in rows.groupBy("half", "y").count().collect():
        sizes[r["half"], int(r["y"])] = r["count"]
    model = Model((sizes[:, 1].sum() + 1) / (sizes.sum() + 2))
    if (sizes == 0).any():
        return model

    codes, counts = _group_counts(rows)
    tables: list[Packed] = []
    for own, n in ((counts[0], sizes[0]), (counts[1], sizes[1]), (counts.sum(axis=0), sizes.sum(axis=0))):
        expected = own.sum(axis=0) * n[1] / n.sum()
        tables.append((codes, np.clip((own[1] - expected) / np.sqrt(expected + 1), -5, 25).astype(np.float32)))
    combos = _COMBOS[:1]
    for _ in range(2):
        tables = [_fit_runs(*own) for own in _instances(rows, tables, combos)]
        combos = _COMBOS
    model.table = tables[2]
    other = _evidence(rows, [tables[1], tables[0]]).collect()  # MAX_LABELLED rows of a few numbers
    model.curve = _logistic(np.array([r[1] for r in other], float), np.array([r[0] for r in other]))
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients and constant of a logistic curve, lightly held back."""
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    centre, width = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - centre) / width, np.ones(len(x))]
    hold = 0.3 * np.eye(z.shape[1])
    hold[-1, -1] = 1e-6
    w = np.zeros(z.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + hold
        w -= np.clip(np.linalg.solve(h, z.T @ (p - target) + hold @ w), -2, 2)
    slopes = w[:-1] / width
    return np.r_[slopes, w[-1] - centre @ slopes]


def _evidence(rows: DataFrame, tables: list[Packed]) -> DataFrame:
    """(y, evidence) of each text, by the table at the place of its half."""
    shared = rows.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [unpacked(t) for t in shared.value]
        for batch in batches:
            for half in (0, 1):
                own = batch.filter(pa.array(batch.column("half").to_numpy() == half))
                found = evidence_of(own.column("text").to_pylist(), weights[half])
                yield pa.RecordBatch.from_arrays([own.column("y"), pa.array(list(found), pa.list_(pa.float64()))], names=["y", "evidence"])

    return rows.select("text", "y", "half").mapInArrow(run, "y double, evidence array<double>")


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns to keep and the score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value.weights
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                found = evidence_of(few.column("text").to_pylist(), weights)
                yield pa.RecordBatch.from_arrays([*(few.column(c) for c in keep), pa.array(shared.value.probability(found))], names=[*keep, "score"])

    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    source = documents.select(*[f"`{c}`" for c in keep], *([] if "text" in keep else ["text"]))
    return source.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    documents = table(spark, sf_dir, "documents")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
