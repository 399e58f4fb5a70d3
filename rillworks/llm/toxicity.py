"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks."""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sample import bounded
from ._scratch import stored
from ._send import received, sent
from ._text import SPACE, Chunk, chunks

#: Decay of a subsequence for each character that it spans; the most that three letters may span; landmarks of each class; rows of a class that train, about.
DECAY, SPAN, LANDMARKS, PER_CLASS = 0.9, 5, (160, 40), 1000
#: Added to a unit's squared norm, so that one of three letters isn't as near to a longer one that has them as its own kind are.
SMOOTH = 0.2
#: The least share of toxic rows that have a telling pair.
PAIRS = 0.03
#: Sets of disguised witnesses; how many rows one weighs as.
COPIES, SHARE = 1, 0.5
#: The margin of a text without a unit, and the least.
LOW = -3.0
#: How much more frequent in toxic rows a telling unit is; rounds; one of how many other pairs trains; clean units that train, drawn and scored highest; units among which landmarks are chosen; the longest unit that trains.
TELLS, ROUNDS, OTHERS, EASY, HARD, SPREAD, LONGEST = 4, 3, 64, 6000, 4000, 3000, 60
#: Letters regardless of case are 1 to 26, continuation bytes 27 to 31; all else is a gap.
_LETTER = np.zeros(256, np.uint8)
_LETTER[97:123] = _LETTER[65:91] = np.arange(1, 27)
_LETTER[128:192] = 27 + np.arange(64) % 5
_CODES = 1 << 15
_VALID = np.array([(i >> 10 > 0) & (i >> 5 & 31 > 0) & (i & 31 > 0) for i in range(_CODES)])
PATTERNS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


@dataclass
class ToxicityModel:
    table: np.ndarray  # weight of each three letters: landmarks, kernel and SVM in one
    bias: float
    slope: float
    offset: float
    landmarks: list[str]
    pairs: bool = False  # whether two neighbours may tell what neither does


class Units:
    """A chunk's words, and runs of words of one character taken together: letters `code`, `unit` of each byte, `start`, first units of rows `first`."""

    def __init__(self, c: Chunk) -> None:
        keep = c.buf < 0xC0  # one byte for each letter of two
        self.buf = buf = c.buf[keep]
        off = np.append(0, np.cumsum(keep))[c.off]
        word = ~SPACE[buf]
        before = np.append(False, word[:-1])
        cuts = off[1:-1][off[1:-1] < len(buf)]
        before[cuts] = False
        start = np.flatnonzero(word & ~before)
        after = np.append(word[1:], False)
        after[cuts[cuts > 0] - 1] = False
        end = np.flatnonzero(word & ~after)
        row = np.searchsorted(off, start, side="right")
        one = end == start
        join = np.zeros(len(start), bool)
        join[1:] = one[1:] & one[:-1] & (row[1:] == row[:-1])
        self.start = start[~join]
        self.end = np.append(end[np.flatnonzero(~join)[1:] - 1], end[-1:]) if len(start) else end
        self.first = np.searchsorted(self.start, off)
        mark = np.zeros(len(buf), np.int32)
        mark[self.start] = 1
        self.unit = np.cumsum(mark, dtype=np.int32)
        self.code = _LETTER[buf].astype(np.int32)

    def subsequences(self) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each way to pick three positions: the three letters' code, whether all lie in one unit, the characters spanned."""
        n = len(self.code)
        for a, b in PATTERNS:
            m = max(0, n - b)
            yield self.code[:m] << 10 | self.code[a : a + m] << 5 | self.code[b:], self.unit[:m] == self.unit[b:], b + 1

    def sums(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each unit, its features times the table, whose imaginary part marks three letters, and its squared norm; whether the next unit is of the same row.

        A word of two units, or two words side by side, adds both."""
        n = len(self.code)
        num, den = np.zeros(n, np.float32), np.zeros(n, np.float32)
        for code, inside, span in self.subsequences():
            got = table[code] * inside
            num[: len(code)] += np.float32(DECAY**span) * got.real
            den[: len(code)] += np.float32(DECAY ** (2 * span)) * got.imag
        m = len(self.start)
        if not m:
            return num[:0], den[:0], np.zeros(0, bool)
        row = np.searchsorted(self.first, np.arange(m), side="right")
        return np.add.reduceat(num, self.start), np.add.reduceat(den, self.start), np.append(row[1:] == row[:-1], False)

    def words(self) -> tuple[list[str], np.ndarray]:
        """All units as plain strings; whether the next one is of the same row."""
        m = len(self.start)
        row = np.searchsorted(self.first, np.arange(m), side="right")
        return [_plain(self.buf[i : j + 1]) for i, j in zip(self.start.tolist(), self.end.tolist())], np.append(row[1:] == row[:-1], False)[:m]


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised features of single units: unit, three letters, weight."""
    row, at, weight = [], [], []
    for c in chunks(pa.array(words, pa.string())):
        u = Units(c)
        owner = np.searchsorted(np.append(u.first[1:], len(u.start) + 1), np.arange(len(u.start)), side="right") + c.lo
        for code, inside, span in u.subsequences():
            k = np.flatnonzero(inside & _VALID[code])
            row.append(owner[u.unit[k] - 1])
            at.append(code[k])
            weight.append(np.full(len(k), DECAY**span))
    row, at, weight = map(np.concatenate, (row, at, weight))
    norm = np.sqrt(np.bincount(row, weight**2, minlength=len(words)) + SMOOTH)
    return row, at, weight / norm[row]


def _kernel(words: list[str], dense: np.ndarray) -> np.ndarray:
    """Kernel values of words against landmarks' dense features (codes x landmarks)."""
    out = []
    for lo in range(0, len(words), 2000):
        row, at, weight = _features(words[lo : lo + 2000])
        part = np.zeros((len(words[lo : lo + 2000]), dense.shape[1]), np.float32)
        order = np.argsort(row, kind="stable")
        row, at, weight = row[order], at[order], weight[order].astype(np.float32)
        if len(row):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            part[row[begin]] = np.add.reduceat(dense[at] * weight[:, None], begin, axis=0)
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, dense.shape[1]), np.float32)


def _dense(words: list[str]) -> np.ndarray:
    out = np.zeros((_CODES, len(words)), np.float32)
    row, at, weight = _features(words)
    np.add.at(out, (at, row), weight)
    return out


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 10.0) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, rows of given weight and classes of equal weight, by Newton steps on the rows inside the margin."""
    x = np.column_stack([z, np.ones(len(z))]).astype(float)
    c = cost * len(y) / 2 * weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum())
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(30):
        on = y * (x @ w) < 1
        new = np.linalg.solve(ridge + (x[on] * c[on, None]).T @ x[on], x[on].T @ (c[on] * y[on]))
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", most: int = PER_CLASS) -> ToxicityModel:
    """Trains on about `most` rows with label 1 and three times as many with label 0 at most, whole texts, as bags of units: words of three letters or more, up to LONGEST, and pairs of neighbours.

    A row's label holds for its bag, and a toxic row may have no toxic unit that can be told. A unit tells only if it is TELLS times as frequent in toxic rows
    as in others, with one standard error to spare; pairs are taken up, besides a sample of others, if there are any in PAIRS of the toxic rows that tell where neither word does, with three. The first
    witnesses are the toxic rows' units with the four letters that most tell the classes apart; then the machine's own choice among units that aren't as frequent in clean rows,
    against the clean rows' units that it scores highest, for ROUNDS rounds. A fifth of the rows, by a hash of the id, chooses the round and sets where the score is one half, over their whole texts. Units of
    either class also train with gaps and with a letter put in. Landmarks are spread over the witnesses and over clean units. Their maps and the machine's
    weights add up to one table, so that a unit's sum costs as much for a thousand landmarks as for one.

    Tasks reduce a text to its distinct units; EASY and HARD bound the clean units that train in a round, SPREAD those among which landmarks are chosen.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    marked = bounded(marked.where("y = 1"), "y", "id", most).unionByName(bounded(marked.where("y = 0"), "y", "id", 3 * most))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(marked), "id")  # about 4 * most ids
    rows = stored(rows.where("text is not null").select(F.col("id").cast("string").alias("id"), "text", "y"), "labelled")
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return ToxicityModel(np.zeros(_CODES, np.complex64), 0.0, 1.0, 3.0 if 1 in n else -3.0, [])

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pairs = [], []
            for c in chunks(batch["text"]):
                u = Units(c)
                w, beside = u.words()
                for lo, hi in zip(u.first[:-1].tolist(), u.first[1:].tolist()):
                    own.append(sorted({x for x in w[lo:hi] if 2 < len(x) <= LONGEST}))
                    pairs.append(sorted({f"{w[i]} {w[i + 1]}" for i in range(lo, hi) if beside[i] and 3 < len(w[i]) + len(w[i + 1]) < LONGEST and w[i] != w[i + 1] and w[i] and w[i + 1]}))
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(own, pa.list_(pa.string())), pa.array(pairs, pa.list_(pa.string()))], names=["id", "y", "own", "pairs"])

    bags = stored(rows.mapInArrow(units, "id string, y int, own array<string>, pairs array<string>"), "units")

    def counts(column: str, errors: int) -> DataFrame:
        got = bags.select("y", F.explode(column).alias("x")).groupBy("x").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("a"))
        return got.where((F.col("b") - errors * F.sqrt("b")) * n[0] > TELLS * n[1] * (F.col("a") + 1))

    tell = counts("own", 1).select("x")
    pairs = counts("pairs", 3).where(F.col("b") >= PAIRS * n[1]).withColumn("w", F.split("x", " "))
    pairs = pairs.join(tell.withColumnRenamed("x", "w0"), F.col("w")[0] == F.col("w0"), "left_anti").join(tell.withColumnRenamed("x", "w1"), F.col("w")[1] == F.col("w1"), "left_anti")
    told = [r.x for r in pairs.select("x").collect()]  # each in PAIRS of the toxic rows
    taken = F.filter("pairs", lambda x: x.isin(told) | (F.pmod(F.xxhash64(x), F.lit(OTHERS)) == 0)) if told else F.array().cast("array<string>")
    got = bags.select("id", "y", F.array_sort(F.concat("own", taken)).alias("bag")).collect()
    got.sort(key=lambda r: (r.id, r.y, r.bag))
    aside = np.array([_aside(r.id) for r in got], bool)
    model = train([r.bag for r in got], np.array([r.y for r in got], np.int8), aside)
    model.pairs = bool(told)
    if model.landmarks:  # scores of whole texts
        held = [(r.y, r.margin) for r in _margins(rows, model, ["id", "y"]).select("id", "y", "margin").collect() if not aside.any() or _aside(r.id)]
        model.slope, model.offset, _ = _cutoff(np.array([m for _, m in held]), np.array([y for y, _ in held], float))
    return model


def _aside(id: str) -> bool:
    return zlib.crc32(b"aside " + id.encode()) % 5 == 0


def train(bags: list[list[str]], y: np.ndarray, aside: np.ndarray) -> ToxicityModel:
    """The machine of bags of units and their labels, of which there are both; the rows aside don't train but choose the round."""
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    if min(np.bincount(y[aside], minlength=2)) < 5 or min(np.bincount(y[~aside], minlength=2)) < 5:
        aside[:] = False  # too few
    seen: dict[str, list[int]] = {}
    rate: dict[str, list[int]] = {}
    for bag, label in zip(bags, y.tolist()):
        for w in bag:
            rate.setdefault(w, [0, 0])[label] += 1
        for g in {w[i : i + 4] for w in bag for i in range(max(1, len(w) - 3))}:
            seen.setdefault(g, [0, 0])[label] += 1
    odds = {g: np.log((b + 0.5) / (n1 + 1)) - np.log((a + 0.5) / (n0 + 1)) for g, (a, b) in seen.items() if (b - b**0.5) * n0 > TELLS * n1 * (a + 1)}

    def common(w: str) -> bool:
        """Whether clean rows have the unit nearly as often."""
        a, b = rate[w]
        return b * n0 < TELLS * n1 * a

    def first(bag: list[str]) -> str | None:
        """The unit with the two most telling runs of four letters."""
        found = [(sum(sorted((odds.get(w[i : i + 4], 0.0) for i in range(max(1, len(w) - 3))))[-2:]), w) for w in bag]
        found = [x for x in found if x[0] > 0 and not common(x[1])]
        return max(found)[1] if found else None

    witness = {w for bag, label, out in zip(bags, y.tolist(), aside.tolist()) if label and not out and (w := first(bag))}
    rng = np.random.default_rng(7)
    clean = sorted({w for bag, label, out in zip(bags, y.tolist(), aside.tolist()) if not label and not out for w in bag})
    easy, hard = [clean[i] for i in rng.permutation(len(clean))[:EASY]], []
    flat, owner = [w for bag in bags for w in bag], np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    skip = np.array([common(w) for w in flat], bool)
    choice = None
    for _ in range(ROUNDS):
        if not witness:
            break
        good = sorted(witness)
        marks = _spread(good, LANDMARKS[0]) + _spread([*hard, *easy[: 10 * LANDMARKS[1]]], LANDMARKS[1])
        dense = _dense(marks)
        values, vectors = np.linalg.eigh(_kernel(marks, dense).astype(float))
        use = values > 1e-4
        into = vectors[:, use] / np.sqrt(values[use])
        bad = sorted({*hard, *easy} - witness)
        own = [*good, *_disguised(good * COPIES, rng)], [*bad, *_disguised(bad[:: max(1, len(bad) // SPREAD)], rng)]
        told = set(hard)  # a clean unit weighs as the rows that have it, one that was scored high five times
        weight = [rate.get(x, (0, SHARE))[1] ** 0.5 for x in own[0]] + [(rate.get(x, (0.25, 0))[0] or 1) ** 0.5 * (5 if x in told else 1) for x in own[1]]
        w, bias = _svm(_kernel(own[0] + own[1], dense) @ into, np.append(np.ones(len(own[0])), -np.ones(len(own[1]))), np.array(weight, float))
        table = (dense @ (into @ w)).astype(np.float32) + 1j * _VALID.astype(np.float32)
        f = _scores(flat, table) + bias
        best = np.full(len(bags), LOW)
        np.maximum.at(best, owner, f)
        # the held-out rows' loss, or all rows' if there are too few
        held = aside if aside.any() else np.ones(len(bags), bool)
        slope, offset, loss = _cutoff(best[held], y[held])
        if choice is None or loss < choice[0]:
            choice = loss, table, bias, slope, offset, marks
        order = np.lexsort((-np.where(skip, -9, f), owner))
        lead = order[np.append(True, owner[order][1:] != owner[order][:-1])]
        witness = {flat[i] for i in lead.tolist() if y[owner[i]] and not aside[owner[i]] and not skip[i] and f[i] > 0}
        worst = np.argsort(-np.where((y[owner] == 0) & ~aside[owner], f, -9), kind="stable")[:HARD]
        hard = sorted({*hard, *(flat[i] for i in worst.tolist() if y[owner[i]] == 0)})
    if choice is None:  # nothing tells the classes apart
        return ToxicityModel(np.zeros(_CODES, np.complex64), 0.0, 1.0, -3.0, [])
    _, table, bias, slope, offset, marks = choice
    return ToxicityModel(table.astype(np.complex64), bias, slope, offset, marks)


def _cutoff(best: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and offset from a row's highest sum to a score of one half where F1 is highest; one less F1. Rows of wrong labels move neither."""
    order = np.argsort(-best, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    f1[:-1][best[order][1:] == best[order][:-1]] = 0  # equal sums aren't parted
    k = int(f1.argmax())
    low = best[order][k + 1] if k + 1 < len(y) else best[order][k] - 1
    return 4.0, float(-4.0 * (best[order][k] + low) / 2), float(1 - f1[k])


def _disguised(words: list[str], rng: np.random.Generator) -> list[str]:
    """The words with a gap after each letter, with one gap, and with one other letter inside."""
    out = []
    for w in words:
        i, j, k = rng.integers(1, max(2, len(w) - 1)), rng.integers(1, max(2, len(w) - 1)), rng.integers(97, 123)
        out += ["-".join(w), f"{w[:i]}-{w[i:]}", f"{w[:j]}{chr(k)}{w[j:]}"]
    return out


def _plain(b: np.ndarray) -> str:
    """A unit as a string of its letters, gaps as '-'; outer gaps go."""
    return "".join("-" if k == 0 else chr(96 + k) if k < 27 else chr(0x80 + k - 27) for k in _LETTER[b].tolist()).strip("-")


def _scores(words: list[str], table: np.ndarray) -> np.ndarray:
    """The sum of each string, of one unit or several taken together."""
    out = []
    for c in chunks(pa.array(words, pa.string())):
        u = Units(c)
        num, den, _ = u.sums(table.astype(np.complex64))
        row = np.searchsorted(u.first[1:], np.arange(len(u.start)), side="right")
        out.append(np.bincount(row, num, minlength=c.n) / np.sqrt(np.bincount(row, den, minlength=c.n) + SMOOTH))
    return np.concatenate(out) if out else np.zeros(0)


def _spread(words: list[str], most: int) -> list[str]:
    """Words that lie far apart, each the farthest from those chosen."""
    words = words[:: max(1, len(words) // SPREAD)]
    if len(words) <= most:
        return words
    k = _kernel(words, _dense(words[:1]))[:, 0]
    out = [words[0]]
    near = k.copy()
    while len(out) < most and near.min() < 0.999:
        i = int(near.argmin())
        out.append(words[i])
        near = np.maximum(near, _kernel(words, _dense([words[i]]))[:, 0])
    return out


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on), worst (the word or two neighbours with the highest sum) for each row, from its whole text.

    Null and empty texts score as a text without any word does, low. Repeated rows stay; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.lit(model.slope) * F.col("margin") + model.offset))
    rows = _margins(rows, model, ["doc_id"]).withColumn("score", 1 / (1 + F.exp(-z)))
    return rows.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst")


def _margins(rows: DataFrame, model: ToxicityModel, keys: list[str]) -> DataFrame:
    """The keys, margin (the highest sum, at least LOW) and worst of rows with a text."""
    held = sent(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(held)
        for batch in batches:
            out, worst = [], []
            for c in chunks(batch["text"]):
                u = Units(c)
                num, den, beside = u.sums(m.table)
                f = num / np.sqrt(den + SMOOTH)
                two = np.full(len(f), -9.0)
                k = np.flatnonzero(beside & m.pairs)
                two[k] = (num[k] + num[k + 1]) / np.sqrt(den[k] + den[k + 1] + SMOOTH)
                pair = two > f
                f = np.append(np.maximum(f, two) + m.bias, LOW)
                for lo, hi in zip(u.first[:-1].tolist(), u.first[1:].tolist()):
                    i = lo + int(f[lo:hi].argmax()) if hi > lo else -1
                    out.append(max(float(f[i]), LOW))
                    worst.append(" ".join(_plain(u.buf[u.start[j] : u.end[j] + 1]) for j in range(i, i + 1 + pair[i])) if i >= 0 else None)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(out, pa.float64()), pa.array(worst, pa.string())], names=[*keys, "margin", "worst"])

    types = {k: rows.schema[k].dataType.simpleString() for k in keys}
    return rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in types.items()) + ", margin double, worst string")
