"""Quality rules as a short-circuit cascade, ordered by what they reject for what they cost."""

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._native import SPACES, let, words
from ._scratch import stored

#: Rows of the sample that costs and selectivities are estimated on, about; words of a repeated window; timed runs of a rule.
SAMPLE, WINDOW, RUNS = 2000, 8, 2


@dataclass(frozen=True)
class Rule:
    """Rejects the rows for which `reject`, a function of the columns named in `needs`, is true; null is false."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[..., Column]

    def of(self, have: Mapping[str, Column]) -> Column:
        return F.coalesce(self.reject(*(have[k] for k in self.needs)), F.lit(False))


@dataclass(frozen=True)
class Estimate:
    name: str
    share: float
    seconds: float


def repeated_words(w: Column) -> Column:
    """Of an array of words, how many stand in windows of eight that it has twice or more. Words are hashed once, windows from their words' hashes."""
    last = F.size(w) - WINDOW

    def covered(at: Column) -> Column:
        step = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1), p + WINDOW) - p))
        return F.aggregate(step, F.lit(0), lambda a, x: a + x)

    def twice(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: (F.get(pairs, k - 1)["h"] == x["h"]) | (F.get(pairs, k + 1)["h"] == x["h"]))
        return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

    def found(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(pairs, twice))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(last < 1, 0).otherwise(let(hashes, found))


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)


def _less(text: Column, characters: str) -> Column:
    """How many of these characters a text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def _long(c: Column) -> Column:
    return c.cast("long")


#: What rules may need, each from the text alone: words; characters in words; of #*$%&|<>; lines with a word, and those equal to an earlier one; repeated_words(); exclamation marks; letters.
STATISTICS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda t: _long(F.size(words(t))),
    "word_chars": lambda t: _long(F.length(F.translate(t, SPACES, ""))),
    "n_symbols": lambda t: _less(t, "#*$%&|<>"),
    "n_lines": lambda t: _long(F.size(_lines(t))),
    "n_dup_lines": lambda t: _long(let(_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x)))),
    "n_repeat_words": lambda t: _long(let(words(t), repeated_words)),
    "bangs": lambda t: _less(t, "!"),
    "letters": lambda t: _long(F.length(F.regexp_replace(t, r"[^\p{L}]", ""))),
}


def text_statistics(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, as one struct, with words and lines parted once. Null is an empty text."""
    text = F.coalesce(text, F.lit(""))
    own = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    line = let(_lines(text), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return let(F.struct(own.alias("w"), line.alias("l")), lambda s: F.struct(
        _long(s["w"]["n"]).alias("n_words"), STATISTICS["word_chars"](text).alias("word_chars"), STATISTICS["n_symbols"](text).alias("n_symbols"),
        _long(s["l"]["n"]).alias("n_lines"), _long(s["l"]["d"]).alias("n_dup_lines"), _long(s["w"]["r"]).alias("n_repeat_words")))


def default_rules() -> list[Rule]:
    """Over STATISTICS: too short, repetitive, symbols, repeated lines, word lengths, shouting, few letters."""
    return [
        Rule("short", ("n_words",), lambda n: n < 20),
        Rule("repeats", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 30 * n),
        Rule("symbols", ("n_symbols", "n_words"), lambda x, n: x > n),
        Rule("lines", ("n_lines", "n_dup_lines"), lambda n, d: (n >= 4) & (2 * d > n)),
        Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
        Rule("shouting", ("bangs", "n_words"), lambda b, n: b > n),
        Rule("letters", ("letters", "word_chars"), lambda x, c: 2 * x < c),
    ]


def estimate(rows: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Estimate]:
    """Each rule's share of rejected rows and seconds on the sample, from the texts, with all that it needs and nothing else: the least of RUNS runs, less that of a run without a rule.
    The sample is about `sample` rows, chosen by a hash of the key, written and dealt to all cores."""
    total = rows.select(key).count()
    some = rows.select(F.col(key).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    some = some.where(F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("rules")), F.lit(1 << 20)) < min(1.0, sample / max(1, total)) * (1 << 20))
    some = stored(some.select("text").repartition(rows.sparkSession.sparkContext.defaultParallelism), "sample")
    have = {k: f(F.col("text")) for k, f in STATISTICS.items()}

    def timed(reject: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = some.agg(F.avg(reject.cast("double")), F.sum(F.length("text"))).first()[0] or 0.0
        return time.perf_counter() - began, share

    timed(F.lit(False))  # starts what isn't running yet
    none = min(timed(F.lit(False))[0] for _ in range(RUNS))
    out = []
    for r in rules:
        runs = [timed(r.of(have)) for _ in range(RUNS)]
        out.append(Estimate(r.name, runs[0][1], max(0.0, min(x for x, _ in runs) - none)))
    return out


def order(rules: Sequence[Rule], estimates: Sequence[Estimate]) -> list[Rule]:
    """The rules by rejected share per second, the most first; equal ones in the order given. A millisecond is the least that counts."""
    rate = {e.name: e.share / max(e.seconds, 1e-3) for e in estimates}
    return sorted(rules, key=lambda r: -rate[r.name])


def cascade(rows: DataFrame, rules: Sequence[Rule], key: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows with rejected_by (the first rule that rejects, null if none) and kept. The order of the rules decides only which of them is named
    and what is spent: once one rejects, the others are not computed for that row. What a rule needs is taken from the rows' column of that name, or computed from the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    have = {k: F.col(k) if k in rows.columns else f(text) for k, f in STATISTICS.items()}
    verdict = F.lit(None).cast("string")
    for r in reversed(order(rules, estimate(rows, rules, key, text_col, sample))):
        verdict = F.when(r.of(have), F.lit(r.name)).otherwise(verdict)
    return rows.withColumn("rejected_by", verdict).withColumn("kept", F.col("rejected_by").isNull())


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """doc_id, the statistics, rejected_by, kept for each row. Null and empty texts have no words and go as too short. Repeated rows stay; other columns are ignored.

    The statistics are results and computed for every row; bangs and letters only where the cascade comes to their rules."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("s", text_statistics(F.col("text")))
    return cascade(rows.select("doc_id", "text", "s.*"), rules or default_rules()).drop("text")
