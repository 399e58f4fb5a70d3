"""Cutting documents into chunks."""

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..functions.vector import cosine, let

PY_TOKEN = re.compile(r"\w+|[^\w\s]")
Splitter = Callable[[str], list[str]]
#: A user's tokens of a text: parts of it, in order.
Tokenizer = Callable[[str], list[str]]


def _size(s: str) -> int:
    return len(PY_TOKEN.findall(s))


def _starts(text: str, tokenizer: Tokenizer) -> list[int]:
    out, at = [], 0
    for token in tokenizer(text):
        at = text.find(token, at)
        if at < 0:
            raise ValueError(f"token {token!r} isn't part of the text behind the one before")
        out.append(at)
        at += len(token)
    return out


def count_tokens_by(rows: DataFrame, tokenizer: Tokenizer, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """The rows with the number of tokens by a user's tokenizer, called on Arrow batches; 0 for null."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([len(tokenizer(s)) if isinstance(s, str) else 0 for s in x.tolist()], dtype="int32")

    return rows.withColumn(into, count(text))


class Measure:
    """Sizes of a text's ranges, in tokens, by the default expression or a user's tokenizer, or characters: tokens are found once."""

    def __init__(self, text: str, tokens: bool | Tokenizer = True) -> None:
        self.text = text
        self.at = _starts(text, tokens) if callable(tokens) else [m.start() for m in PY_TOKEN.finditer(text)] if tokens else None

    def of(self, begin: int, end: int) -> int:
        return end - begin if self.at is None else bisect_left(self.at, end) - bisect_left(self.at, begin)

    def cut(self, begin: int, end: int, most: int) -> list[tuple[int, int]]:
        """The range in pieces of `most` units, the last one of what is left."""
        if self.at is None:
            marks = list(range(begin, end, most))
        else:
            marks = [begin, *self.at[bisect_left(self.at, begin) : bisect_left(self.at, end)][most::most]]
        return list(zip(marks, [*marks[1:], end]))


def _parts(text: str, begin: int, end: int, separator: str, keep: bool) -> list[tuple[int, int]]:
    """The ranges between separators; each with the separator behind it if those are kept."""
    marks = [m.start() for m in re.finditer(re.escape(separator), text[begin:end])]
    begins = [begin, *(begin + k + len(separator) for k in marks)]
    ends = [*(begin + k + len(separator) * keep for k in marks), end]
    return list(zip(begins, ends))


def _atoms(m: Measure, most: int, separators: Sequence[str], keep: bool) -> list[tuple[int, int]]:
    """Ranges in order that fit, each from the first separator that makes it fit; an empty separator cuts every `most` units, and what no separator cuts stays whole."""
    out, work = [], [(0, len(m.text), 0)]
    while work:
        begin, end, level = work.pop()
        if m.of(begin, end) <= most and (level or keep) or level == len(separators):
            out.append((begin, end))
        elif separators[level]:
            work += [(x, y, level + 1) for x, y in reversed(_parts(m.text, begin, end, separators[level], keep))]
        else:
            out += m.cut(begin, end, most)
    return out


def _packed(sizes: Sequence[int], most: int, overlap: int | None) -> Iterator[tuple[int, int]]:
    """Runs of pieces that fit together, at least one new piece in each; a run begins with the last whole pieces of the one before that are `overlap` together, or with its last piece if overlap is None."""
    upto = [0, *accumulate(sizes)]
    begin = new = 0
    while new < len(sizes):
        end = max(new + 1, bisect_right(upto, upto[begin] + most) - 1)
        yield begin, end
        begin = max(begin, end - 1 if overlap is None else bisect_left(upto, upto[end] - overlap))
        new = end


def recursive_splitter(most: int, separators: Sequence[str] = ("\n\n", "\n", ". ", "; ", ", ", " "), tokens: bool | Tokenizer = True) -> Splitter:
    """Chunks of at most `most` units: as many parts between separators as fit together, with the separators between them; a part that doesn't fit is cut by the next separator, in the end every `most` units. Blank chunks go."""

    def run(s: str) -> list[str]:
        m = Measure(s or "", tokens)
        out, work = [], [(0, len(m.text), 0)]
        while work:
            begin, end, level = work.pop()
            if m.of(begin, end) <= most:
                out.append(m.text[begin:end])
            elif level == len(separators):
                out += [" ".join(PY_TOKEN.findall(m.text[x:y])) if tokens is True else m.text[x:y] for x, y in m.cut(begin, end, most)]
            else:
                parts = [x for x in _parts(m.text, begin, end, separators[level], False) if x[0] < x[1]]
                ends, runs, k = [y for _, y in parts], [], 0
                while k < len(parts):
                    # the last part up to which all from this one on fit, by the size of the range
                    n = max(k + 1, bisect_right(ends, most, key=lambda y: m.of(parts[k][0], y)))
                    runs.append((parts[k][0], ends[n - 1], level + 1))
                    k = n
                work += reversed(runs)
        return [x for c in out if (x := c.strip())]

    return run


def piece_splitter(most: int = 1000, overlap: int = 200, separators: Sequence[str] = ("\n\n", "\n", ". ", " "), tokens: bool | Tokenizer = True) -> Splitter:
    """Pieces between separators, each as large as the first separator that makes it fit leaves it, packed with a space between; a chunk begins with as many of the last whole pieces of the one before as fit in `overlap`, and may exceed `most` by them."""

    def run(s: str) -> list[str]:
        m = Measure(s or "", tokens)
        pieces = [(x, y) for x, y in _atoms(m, most, separators, False) if m.text[x:y].strip()]
        return [" ".join(m.text[x:y] for x, y in pieces[i:j]).strip() for i, j in _packed([m.of(*x) for x in pieces], most, overlap)]

    return run


def paragraph_splitter(most: int = 2000, tokens: bool | Tokenizer = True) -> Splitter:
    """Paragraphs, else sentences, else words, delimiters kept; a chunk begins with the last piece of the one before, whether or not that fits."""

    def run(s: str) -> list[str]:
        m = Measure(s or "", tokens)
        pieces = [x for x in _atoms(m, most, ("\n\n", ". ", " "), True) if x[0] < x[1]] if m.of(0, len(m.text)) > most else [(0, len(m.text))]
        chunks = (m.text[pieces[i][0] : pieces[j - 1][1]].strip() for i, j in _packed([m.of(*x) for x in pieces], most, None))
        return [x for x in chunks if x]

    return run


def char_splitter(most: int = 500, overlap: int = 50, separators: Sequence[str] = ("\n\n", "\n", ".", " ", ""), tokens: bool | Tokenizer = False) -> Splitter:
    """Chunks of at most `most` characters or tokens, of pieces between separators, in the end of single units; a chunk begins with the last whole pieces of the one before that are at most `overlap` and leave room for the next."""

    def run(s: str) -> list[str]:
        m = Measure(s or "", tokens)
        pieces = _atoms(m, most, separators, True)
        out, begin, new = [], 0, 0
        while new < len(pieces):
            while begin < new and m.of(pieces[begin][0], pieces[new][1]) > most:
                begin += 1
            end = new + 1
            while end < len(pieces) and m.of(pieces[begin][0], pieces[end][1]) <= most:
                end += 1
            out.append(m.text[pieces[begin][0] : pieces[end - 1][1]].strip())
            begin = new = end
            while begin and m.of(pieces[begin - 1][0], pieces[end - 1][1]) <= overlap:
                begin -= 1
        return [x for x in out if x]

    return run


def fixed_splitter(separator: str = "\n\n", most: int = 1000) -> Splitter:
    """Segments between one separator, packed while they fit; a longer one stays whole."""

    def run(s: str) -> list[str]:
        out, held = [], ""
        for part in (s or "").split(separator):
            if held and len(held) + len(separator) + len(part) > most:
                out.append(held)
                held = part
            else:
                held = held + separator + part if held else part
        return [x for x in (*out, held) if x.strip()]

    return run


#: Bytes of texts that are cut at once.
TEXTS = 1 << 20


def split_batches(batches: Iterator[pa.RecordBatch], splitter: Splitter, text: str, into: str) -> Iterator[pa.RecordBatch]:
    """The chunks of Arrow batches of rows, some rows at a time, so that a task holds the batch and the chunks of `TEXTS` bytes of it, or of one longer text."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        keep = [n for n in b.schema.names if n != text]
        begins = np.flatnonzero(np.r_[True, np.diff(np.cumsum(size) // TEXTS) > 0]) if len(b) else []
        for lo, hi in zip(begins, [*begins[1:], len(b)]):
            rows = b.slice(lo, hi - lo)
            parts = [splitter(x) if isinstance(x, str) else [] for x in rows.column(text).to_pylist()]
            if not any(parts):
                continue
            at = pa.array(np.repeat(np.arange(len(parts)), [len(p) for p in parts]))
            number = pa.array([i for p in parts for i in range(len(p))], pa.int32())
            yield pa.RecordBatch.from_arrays([*(rows.column(n).take(at) for n in keep), number, pa.array([x for p in parts for x in p], pa.string())], names=[*keep, "chunk_no", into])


def split_text(rows: DataFrame, splitter: Splitter, text: str = "text", into: str = "chunk") -> DataFrame:
    """A row for each chunk: the row's other columns, chunk_no from 0, and the chunk."""
    keep = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("chunk_no", T.IntegerType()), T.StructField(into, T.StringType())])
    return rows.mapInArrow(lambda batches: split_batches(batches, splitter, text, into), schema)


def table_blocks(rows: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """key, block_no, kind (table or text), block: runs of |...| lines are tables, what stands between is stripped; a blank text is one text block."""
    lines = rows.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    w = W.partitionBy(*key).orderBy("line_no")
    is_table = F.col("line").rlike(r"^\s*\|.*\|\s*$")
    lines = lines.withColumn("is_table", is_table).withColumn("run", F.sum((F.col("is_table") != F.coalesce(F.lag("is_table").over(w), ~F.col("is_table"))).cast("int")).over(w))
    blocks = lines.groupBy(*key, "run", "is_table").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("block"))
    blocks = blocks.withColumn("block", F.when(F.col("is_table"), F.col("block")).otherwise(F.regexp_replace("block", r"^\s+|\s+$", "")))
    alone = F.count("*").over(W.partitionBy(*key)) == 1
    blocks = blocks.withColumn("alone", alone).where("block <> '' OR alone")
    number = F.row_number().over(W.partitionBy(*key).orderBy("run")) - 1
    return blocks.select(*key, number.alias("block_no"), F.when(F.col("is_table"), "table").otherwise("text").alias("kind"), "block")


def add_overlap(chunks: DataFrame, group: Sequence[str], number: str = "chunk_no", text: str = "chunk", n: int = 30) -> DataFrame:
    """Each chunk but a group's first begins with the last n tokens of the one before, as it was."""
    if n <= 0:
        return chunks
    own = t.tokens(F.lag(text).over(W.partitionBy(*group).orderBy(number)))
    tail = F.array_join(F.slice(own, F.greatest(F.lit(1), F.size(own) - n + 1), n), " ")
    return chunks.withColumn(text, F.when(F.lag(text).over(W.partitionBy(*group).orderBy(number)).isNotNull(), F.concat(tail, F.lit(" "), F.col(text))).otherwise(F.col(text)))


def parent_child_chunks(pages: DataFrame, parent: int = 1000, child: int = 150, overlap: int = 30, key: Sequence[str] = ("filename", "page")) -> DataFrame:
    """key, parent_no, child_no, kind, parent_text, child_text: tables are parents as they are, other text in parts of `parent` tokens; children of `child` tokens overlap."""
    blocks = table_blocks(pages, key)
    tables = blocks.where("kind = 'table'").select(*key, "block_no", F.lit(0).alias("part"), "kind", F.col("block").alias("parent_text"))
    other = split_text(blocks.where("kind = 'text'").select(*key, "block_no", "kind", F.col("block").alias("text")), recursive_splitter(parent), into="parent_text").withColumnRenamed("chunk_no", "part")
    parents = tables.unionByName(other)
    parents = parents.withColumn("parent_no", F.row_number().over(W.partitionBy(*key).orderBy("block_no", "part")) - 1).drop("block_no", "part")
    children = split_text(parents.withColumn("text", F.col("parent_text")), recursive_splitter(child), into="child_text").withColumnRenamed("chunk_no", "child_no")
    children = add_overlap(children, [*key, "parent_no"], "child_no", "child_text", overlap)
    return children.select(*key, "parent_no", "child_no", "kind", "parent_text", "child_text").withColumn("chunk_id", chunk_id("filename", "page", "child_text"))


def chunk_id(filename: str, page: str, text: str, full_text: bool = False) -> Column:
    """MD5 of file, page and the chunk's first 100 characters, or of all of it."""
    return F.md5(F.concat_ws("-", F.col(filename), F.col(page).cast("string"), F.col(text) if full_text else F.substring(text, 1, 100)))


def adjacent_similarity(sentences: DataFrame, group: str, number: str, vector: str) -> DataFrame:
    """Similarity of each sentence to the one before; null for a group's first."""
    return sentences.withColumn("similarity", cosine(F.lag(vector).over(W.partitionBy(group).orderBy(number)), F.col(vector)))


def similarity_profile(rows: DataFrame, group: str) -> DataFrame:
    """Quartiles, least and most similarity of each group of three sentences or more."""
    q = [F.percentile("similarity", F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return rows.groupBy(group).agg(F.count("*").alias("n"), *q, F.min("similarity").alias("low"), F.max("similarity").alias("high")).where("n >= 3")


def semantic_chunks(rows: DataFrame, group: str, number: str, text: str, threshold: float = 0.75, max_tokens: int = 500, overlap: int = 50) -> DataFrame:
    """group, chunk_no, n_sentences, chunk: sentences in order, a new chunk where the similarity to the one before is below the threshold, or where `max_tokens` would be passed.

    A sentence of more tokens is cut into pieces of max_tokens first, and each piece counts as a sentence. A chunk that only its size parts from the one before
    begins with that one's last `overlap` tokens, which its size doesn't count. A chunk's sentences are gathered from one stretch without a break.
    """
    stretch = F.sum(F.coalesce((F.col("similarity") < threshold).cast("int"), F.lit(0))).over(W.partitionBy(group).orderBy(number))
    n = t.count_tokens(F.col(text))
    pieces = rows.select(group, stretch.alias("_stretch"), F.col(number).alias("_no"), F.posexplode(F.when(n > max_tokens, t.split_by_tokens(F.col(text), max_tokens)).otherwise(F.array(text))).alias("_piece", "_text"))
    items = F.array_sort(F.collect_list(F.struct("_no", "_piece", "_text", t.count_tokens(F.col("_text")).alias("_n"))))
    held = lambda text, count, size: F.struct(text.alias("text"), count.cast("long").alias("count"), size.cast("long").alias("size"))

    def add(s: Column, x: Column) -> Column:
        last = s["open"]
        full = (last["count"] > 0) & (last["size"] + x["_n"] > max_tokens)
        begun = full | (last["count"] == 0)
        done = F.when(full, F.concat(s["done"], F.array(last))).otherwise(s["done"])
        return F.struct(done.alias("done"), held(F.when(begun, x["_text"]).otherwise(F.concat_ws(" ", last["text"], x["_text"])), F.when(begun, 1).otherwise(last["count"] + 1), F.when(begun, x["_n"]).otherwise(last["size"] + x["_n"])).alias("open"))

    none = held(F.lit(""), F.lit(0), F.lit(0))
    packed = F.aggregate("_items", F.struct(F.slice(F.array(none), 1, 0).alias("done"), none.alias("open")), add, lambda s: F.concat(s["done"], F.array(s["open"])))
    rows = pieces.groupBy(group, "_stretch").agg(items.alias("_items")).select(group, "_stretch", packed.alias("_chunks"))
    tail = lambda text: let(t.tokens(text), lambda w: F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - overlap + 1), max(1, overlap)), " "))
    lapped = F.transform("_chunks", lambda c, i: F.struct(c["count"].alias("n_sentences"), F.when((i > 0) & F.lit(overlap > 0), F.concat_ws(" ", tail(F.get("_chunks", i - 1)["text"]), c["text"])).otherwise(c["text"]).alias("chunk")))
    rows = rows.select(group, "_stretch", F.posexplode(lapped).alias("_at", "_c"))
    place = F.row_number().over(W.partitionBy(group).orderBy("_stretch", "_at")) - 1
    return rows.select(group, place.cast("long").alias("chunk_no"), "_c.n_sentences", "_c.chunk")


def sweep_thresholds(rows: DataFrame, group: str, number: str, text: str, thresholds: Sequence[float]) -> DataFrame:
    """Chunks that each threshold (a short list) would give: their number, characters, and whether 4 to 15."""
    w = W.partitionBy("threshold", group).orderBy(number)
    rows = rows.select(group, number, "similarity", F.length(text).alias("size"), F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    rows = rows.withColumn("chunk_no", F.sum(F.coalesce((F.col("similarity") < F.col("threshold")).cast("int"), F.lit(0))).over(w))
    chunks = rows.groupBy("threshold", group, "chunk_no").agg(F.sum("size").alias("size"))
    out = chunks.groupBy("threshold", group).agg(F.count("*").alias("n_chunks"), F.round(F.avg("size"), 4).alias("mean_chars"), F.min("size").alias("min_chars"), F.max("size").alias("max_chars"))
    return out.withColumn("verdict", F.when(F.col("n_chunks") < 4, "few").when(F.col("n_chunks") > 15, "many").otherwise("ok"))


def sentence_window(rows: DataFrame, group: str, number: str, text: str, k: int) -> DataFrame:
    """Each sentence with k neighbours on either side."""
    w = W.partitionBy(group).orderBy(number).rowsBetween(-k, k)
    return rows.withColumn("window", F.array_join(F.collect_list(text).over(w), " "))


def heading_sections(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section_no, breadcrumb, body for Markdown with #, ## and ### headings; text before the first heading has an empty breadcrumb."""
    lines = rows.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("level", F.length(F.regexp_extract("line", r"^(#{1,3}) ", 1))).withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,3} ", "")))
    w = W.partitionBy(key).orderBy("line_no")
    lines = lines.withColumn("section_no", F.sum((F.col("level") > 0).cast("int")).over(w))
    crumbs = []
    for n in (1, 2, 3):
        at = F.last(F.when(F.col("level") == n, F.struct("line_no", "title")), ignorenulls=True).over(w)
        above = F.coalesce(F.last(F.when((F.col("level") > 0) & (F.col("level") < n), F.col("line_no")), ignorenulls=True).over(w), F.lit(-1))
        crumbs.append(F.when(at["line_no"] > above, at["title"]))
    lines = lines.withColumn("breadcrumb", F.concat_ws(" > ", *crumbs))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    return lines.groupBy(key, "section_no").agg(F.max_by("breadcrumb", "line_no").alias("breadcrumb"), F.trim(body).alias("body"))


def context_prefix(content: Column, *breadcrumb: Column) -> Column:
    """The text to search by: where the chunk stands, then the chunk; the chunk itself stays apart."""
    return F.concat_ws("\n", F.concat_ws(" > ", *breadcrumb), content)


def faq_chunks(faq: DataFrame, most: int) -> DataFrame:
    """record_type, chunk_no, content, retrieval_text for rows of faq_id, breadcrumb, question, answer. A longer answer than `most` tokens is a parent without search text and children that each carry the question."""
    n = t.count_tokens(F.col("answer"))
    line = lambda a: F.concat_ws("\n", "breadcrumb", "question", a)
    short = faq.where(n <= most).select("faq_id", F.lit("single").alias("record_type"), F.lit(0).alias("chunk_no"), F.col("answer").alias("content"), line("answer").alias("retrieval_text"))
    long = faq.where(n > most)
    parent = long.select("faq_id", F.lit("parent").alias("record_type"), F.lit(0).alias("chunk_no"), F.col("answer").alias("content"), F.lit(None).cast("string").alias("retrieval_text"))
    child = long.select("faq_id", "breadcrumb", "question", F.posexplode(t.split_by_tokens(F.col("answer"), most)).alias("chunk_no", "content"))
    child = child.select("faq_id", F.lit("child").alias("record_type"), F.col("chunk_no") + 1, "content", line("content"))
    return short.unionByName(parent).union(child)


def record_chunks(blocks: DataFrame, key: Sequence[str], block: str = "block", breadcrumb: str = "") -> DataFrame:
    """key, record_no, record for Markdown tables: each body row as "column: value" pairs behind the breadcrumb."""
    rows = F.transform(F.split(block, "\n"), lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))
    body = F.filter(F.slice(rows, 2, F.greatest(F.lit(0), F.size(rows) - 1)), lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$")))
    out = blocks.select(*key, rows[0].alias("head"), F.posexplode(body).alias("record_no", "cells"))
    pairs = F.array_join(F.zip_with("head", "cells", lambda h, c: F.concat(h, F.lit(": "), F.coalesce(c, F.lit("")))), "; ")
    return out.select(*key, "record_no", F.concat(F.lit(f"{breadcrumb} | " if breadcrumb else ""), pairs).alias("record"))


def step_chunks(steps: DataFrame, group: str, number: str = "step_index", text: str = "text", most: int = 120) -> DataFrame:
    """Consecutive steps packed in order: chunk k holds the steps whose running size ends in (k * most, (k + 1) * most]."""
    w = W.partitionBy(group).orderBy(number)
    steps = steps.withColumn("chunk_no", F.floor((F.sum(F.length(text)).over(w) - 1) / most))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda x: x[text]), " ")
    return steps.groupBy(group, "chunk_no").agg(F.min(number).alias("first_step"), F.max(number).alias("last_step"), joined.alias("chunk"))


def dedupe_faq(new: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(those whose question isn't known, those known with another answer), by the question in lower case without outer or double space."""
    name = F.lower(F.trim(F.regexp_replace("question", r"\s+", " ")))
    a, b = new.withColumn("_q", name), known.select(name.alias("_q"), F.col("answer").alias("known_answer"))
    return a.join(b, "_q", "left_anti").drop("_q"), a.join(b, "_q").where("answer <> known_answer").drop("_q")


def flag_truncated(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    """For each chunk and model: tokens, the model's limit, whether the model would cut it."""
    limits = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(n).alias("limit")) for m, n in t.MODEL_LIMITS.items())))
    return chunks.withColumn("tokens", t.count_tokens(F.col(text))).withColumn("m", limits).select("*", "m.*").drop("m").withColumn("truncated", F.col("tokens") > F.col("limit"))


# Strategies by kind of document.
STRATEGIES = {
    "faq": ("qa_record", "parent_child"), "regulation": ("section", "parent_child"), "table": ("record", "parent_child"), "exception": ("semantic", "parent_child"),
    "procedure": ("procedure", "section"), "steps": ("step", "parent_child"), "metadata": ("metadata", "payload_filter"),
}


def chunk_strategy(kind: Column) -> Column:
    """primary and secondary strategy; fixed size with overlap for what isn't recognised."""
    known = F.create_map(*(x for k, (a, b) in STRATEGIES.items() for x in (F.lit(k), F.struct(F.lit(a).alias("primary"), F.lit(b).alias("secondary")))))
    return F.coalesce(F.try_element_at(known, F.lower(F.coalesce(kind, F.lit("")))), F.struct(F.lit("fixed_size").alias("primary"), F.lit("overlap").alias("secondary")))


def map_reduce_text(chunks: DataFrame, group: str, number: str = "chunk_no", text: str = "chunk", map_fn: Callable[[Column], Column] | None = None) -> DataFrame:
    """Each chunk's digest (by default its leading sentence), a group's digests joined in order."""
    mapped = (map_fn or (lambda c: F.regexp_extract(c, r"(?s)^(.*?[.!?])(?:\s|$)", 1)))(F.col(text))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(number), mapped.alias("m")))), lambda x: x["m"]), "\n\n---\n\n")
    return chunks.groupBy(group).agg(joined.alias("digest"))
