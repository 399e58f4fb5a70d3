"""Scalar text operators as column expressions."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import let

#: The default tokenizer: runs of letters, digits and underscores, or one other visible character.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"

# models' input limits in tokens.
MODEL_LIMITS = {"all-MiniLM-L6-v2": 256, "all-mpnet-base-v2": 514, "nomic-embed-text": 8192, "text-embedding-3-small": 8191}

# Terms of risk in news, in the order in which hits are listed.
RISK_TERMS = [
    "kiện tụng", "khởi tố", "tranh chấp", "nợ thuế", "trốn thuế", "vi phạm", "đình chỉ", "thu hồi giấy phép", "phá sản", "vỡ nợ", "trái phiếu vỡ hạn", "nợ xấu",
    "CIC nhóm 3", "CIC nhóm 4", "CIC nhóm 5", "bị bắt", "hầu tòa", "bị điều tra",
]

#: Phrases that address a model rather than a reader.
INSTRUCTIONS = ["ignore (all )?(the )?previous instructions", "disregard (all )?(the )?(above|previous)", "you are now ", "system prompt", "do not tell the user"]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def count_tokens(text: Column) -> Column:
    return F.size(tokens(text))


def split_by_tokens(text: Column, most: int) -> Column:
    """Pieces of `most` tokens, joined by a space; none for a text without tokens."""

    def cut(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own), F.lit(most))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(own, i, most), " "))

    return let(tokens(text), cut)


def split_sentences(text: Column, least: int = 21) -> Column:
    """Parts behind ., ! or ? and white space, stripped; shorter ones than `least` characters go."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) >= least)


def mask_accounts(text: Column) -> Column:
    return F.regexp_replace(text, r"(\d{4})\d{4,6}(\d{4})", "$1****$2")


def parse_decision(text: Column) -> Column:
    found = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)DECISION:\s*(RAG|WEB|CALC|FINISH)", 1))
    return F.when(found == "", "FINISH").otherwise(found)


def extract_json_block(text: Column, schema: str, defaults: dict[str, str], clamp: dict[str, float] | None = None) -> Column:
    """The struct in the text's outermost braces; for what is missing or can't be read the defaults (SQL literals); fields of `clamp` are at most that."""
    got = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\{.*\}", 0), schema, {"mode": "PERMISSIVE"})
    fields = []
    for name, default in defaults.items():
        x = F.coalesce(got[name], F.expr(default))
        fields.append((F.least(x, F.lit(clamp[name])) if clamp and name in clamp else x).alias(name))
    return F.struct(*fields)


def flag_untrusted(text: Column, phrases: Sequence[str] = tuple(INSTRUCTIONS)) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(f"({p})" for p in phrases)), F.lit(False))


def wrap_untrusted(text: Column, source: Column) -> Column:
    return F.concat(F.lit('<untrusted_document source="'), source, F.lit('">\n'), text, F.lit("\n</untrusted_document>"))


def contained_terms(text: Column, terms: Sequence[str]) -> Column:
    """The terms that a text contains, regardless of case, in the list's order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in terms)))


def table_to_markdown(cells: Column) -> Column:
    """Rows of cells as a Markdown table, the first as its head; a null cell is empty, no cells give an empty text."""
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    lines = F.transform(cells, row)
    rule = F.concat(F.lit("| "), F.array_join(F.transform(cells[0], lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.when((F.size(cells) < 1) | (F.size(cells[0]) < 1), "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))), "\n"))


def json_to_markdown(text: Column, most: int = 50) -> Column:
    """A JSON list of objects as a Markdown table: the first object's keys, missing ones empty, at most `most` rows."""
    rows = F.slice(F.from_json(text, "array<map<string,string>>"), 1, most)
    keys = F.map_keys(rows[0])
    body = F.transform(rows, lambda r: F.transform(keys, lambda k: F.try_element_at(r, k)))
    return table_to_markdown(F.concat(F.array(keys), body))
