"""Secret scans by blob: every text is addressed by its content and scanned once by each version of a rule, whatever paths and versions hold it."""

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scratch import stored

#: Rows of keys, or of findings, up to which they are sent to all tasks.
FEW, FEW_FOUND = 1 << 20, 1 << 18
SCHEMA = "blob binary, rules array<string>, found array<struct<rule: string, start: long, end: long>>"


@dataclass(frozen=True)
class Rule:
    """Leftmost matches of `pattern` without overlap, kept if their `group` has `least` characters or more; a match that fails is passed over whole.

    `gate`: a plainer pattern that each text with a match holds, so that other texts are passed over without Python.
    """

    name: str
    pattern: str
    gate: str
    group: int = 0
    least: int = 0

    @property
    def version(self) -> str:
        """Name and content: another pattern or length is another version."""
        return f"{self.name}@{hashlib.sha256(repr((self.pattern, self.group, self.least)).encode()).hexdigest()[:16]}"

    def spans(self, text: str) -> list[tuple[int, int]]:
        """In code points, the end exclusive."""
        return [m.span() for m in re.compile(self.pattern, re.ASCII).finditer(text) if len(m[self.group]) >= self.least]


_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE_RULES = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _KEYWORD + r"""["']?\x20*[:=]""", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{16}", 0, 20),
    Rule("hex", "[0-9a-f]+", "[0-9a-f]{24}", 0, 24),
)
RULES = (
    *BASE_RULES,
    Rule("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}", "gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"\bxox[abpr]-[0-9A-Za-z-]{10,}", "xox[abpr]-[0-9A-Za-z-]{10}"),
    Rule("google", r"\bAIza[0-9A-Za-z_-]{35}", "AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"\.eyJ[A-Za-z0-9_-]{8}"),
    Rule("url", r"""\b(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20/:@"']+:[^\x00-\x20/:@"']+@""", r"://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@"),
)


def content_address(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, at: str) -> DataFrame:
    """blob, rules, found: a row for each blob and run that scanned it. Empty where there is no ledger yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(at)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def _few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """With a broadcast hint if they are counted few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def unseen(blobs: DataFrame, ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows of blobs (blob, ...) with `todo`, the rule versions that the ledger has no scan of, where there are any. Ledger rows of other blobs are left out before they are grouped."""
    own = ledger.join(_few(blobs.select("blob")), "blob", "left_semi")
    seen = own.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    every = F.array(*(F.lit(r.version) for r in rules))
    return blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0).drop("seen")


def _scan(texts: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, rules, found for each text (blob, text) that its task hasn't scanned before."""
    versions = [r.version for r in rules]
    any_gate = "|".join(f"(?:{r.gate})" for r in rules)
    kinds = pa.schema([("blob", pa.binary()), ("rules", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for b in batches:
            blobs, new = b.column("blob").to_pylist(), []
            for i, x in enumerate(blobs):
                if x not in done:
                    done.add(x)
                    new.append(i)
            found = {i: [] for i in new}
            text = b.column("text").take(pa.array(new, pa.int64()))
            maybe = pc.indices_nonzero(pc.match_substring_regex(text, any_gate))
            text, at = text.take(maybe), [new[i] for i in maybe.to_pylist()]
            for r in rules:
                for i in pc.indices_nonzero(pc.match_substring_regex(text, r.gate)).to_pylist():
                    found[at[i]] += [{"rule": r.version, "start": s, "end": e} for s, e in r.spans(text[i].as_py())]
            yield pa.RecordBatch.from_pydict({"blob": [blobs[i] for i in new], "rules": [versions] * len(new), "found": [found[i] for i in new]}, schema=kinds)

    return texts.mapInArrow(run, SCHEMA)


def scan_history(versions: DataFrame, at: str, rules: Sequence[Rule] = RULES, path_cols: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """path (struct of path_cols), blob, found (array of start, rule, end by start, then the rules' order) for each row of versions: every version of every path, old ones as well.

    `at` is the ledger, a Parquet folder that all executors share. Blobs, or pairs of blob and rule version, that it lacks are scanned and
    appended in one commit for each set of missing rules; all others aren't. A run that fails has appended a set whole or not at all, so the next
    one goes on from there. Runs at the same time may scan a blob twice, which changes no result.

    One row of each new blob is scanned, a copy on one path once for each task at most. Texts aren't shuffled if the new blobs or the rows
    that needn't be scanned are counted few; else rows are dealt by blob and path, never by blob alone, so a hot blob stays spread. Copies meet
    as hashes in partial aggregates; findings return to paths by broadcast if counted few, else by a join whose hot blobs Spark splits.

    Null and empty texts are one blob, with no findings under these rules. Null, repeated and equal paths have a row for each of theirs. Other
    columns aren't read. No rows give none. Texts of any length are scanned whole.
    """
    if len({r.name for r in rules}) < len(rules):
        raise ValueError("each rule needs a name of its own")
    spark, text = versions.sparkSession, F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.struct(*(F.col(c) for c in path_cols))
    texts = versions.select(text.alias("text"), content_address(text).alias("blob"), F.xxhash64(*path_cols).alias("name"))
    paths = stored(versions.select(path.alias("path"), content_address(text).alias("blob"), F.xxhash64(*path_cols).alias("name")), "paths")
    todo = stored(unseen(paths.groupBy("blob").agg(F.min("name").alias("name")), read_ledger(spark, at), rules), "todo")
    n_paths = paths.count()
    for missing, n in todo.groupBy("todo").count().collect():  # a row for each set of rules that some blob lacks
        wanted = todo.where(F.col("todo") == F.array(*map(F.lit, missing))).select("blob", "name")
        if n > FEW and n_paths - n <= FEW:
            rest = paths.select("blob", "name").join(wanted, ["blob", "name"], "left_anti").distinct()
            picked = texts.join(F.broadcast(rest), ["blob", "name"], "left_anti")
        else:
            picked = texts.join(F.broadcast(wanted) if n <= FEW else wanted, ["blob", "name"], "left_semi")
        _scan(picked.select("blob", "text"), [r for r in rules if r.version in missing]).write.mode("append").parquet(at)
    return paths.select("path", "blob").join(_few(findings(read_ledger(spark, at), rules), FEW_FOUND), "blob", "left").select("path", "blob", F.coalesce("found", F.array().cast("array<struct<start: bigint, rule: string, end: bigint>>")).alias("found"))


def findings(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """blob, found for blobs with findings of these versions of the rules."""
    order, name = F.create_map(*(F.lit(x) for n, r in enumerate(rules) for x in (r.version, n))), F.create_map(*(F.lit(x) for r in rules for x in (r.version, r.name)))
    own = ledger.select("blob", F.filter("found", lambda x: x["rule"].isin([r.version for r in rules])).alias("found")).where(F.size("found") > 0)
    items = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct(x["start"].alias("start"), order[x["rule"]].alias("order"), x["end"].alias("end"), name[x["rule"]].alias("rule")))
    return own.groupBy("blob").agg(F.transform(F.array_sort(F.array_distinct(items)), lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end"))).alias("found"))
