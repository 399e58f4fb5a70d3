"""URL filters: many wildcard rules in one bit-parallel Shift-And automaton."""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ONE = np.uint64(1)


@dataclass(frozen=True)
class Rule:
    """A glob over `.host/path`: * is any run without a slash, ** any run, ? one character. `rank` decides between rules that match: the highest wins, then the first."""

    glob: str
    verdict: str
    name: str | None = None
    rank: int = 0


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule for a host and all its subdomains, for paths that start with `path`; the longest wins."""
    return Rule(f"*.{host}{path}**", verdict, host + path, len(host) + len(path))


def host_and_path(url: Column | str) -> tuple[Column, Column]:
    """The host, A to Z in lower case: from after the first :// up to a slash, ?, # or the end; the path: from there up to ? or #. Null or no :// leaves both empty."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, url.substr(at + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


class Automaton:
    """One bit a character of each glob, in as many 64-bit words as they need; a wildcard is a bit that its characters keep set."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        bits: list[set[int]] = []  # of each position: the bytes it takes
        stay: list[tuple[int, set[int]]] = []  # positions that these bytes keep set
        begin, accept = [], []
        for r in rules:
            begin.append(len(bits))
            bits.append(set())  # before the first character
            glob = r.glob
            while glob:
                if glob.startswith("*"):
                    deep = glob.startswith("**")
                    stay.append((len(bits) - 1, set(range(256)) - (set() if deep else {0x2F})))
                    glob = glob[1 + deep :]
                elif glob[0] == "?":  # a character's first byte, and those that continue it
                    bits.append(set(range(0x80)) | set(range(0xC0, 256)))
                    stay.append((len(bits) - 1, set(range(0x80, 0xC0))))
                    glob = glob[1:]
                else:
                    bits += [{b} for b in glob[0].encode()]
                    glob = glob[1:]
            accept.append(len(bits) - 1)
        self.words = max(1, -(-len(bits) // 64))
        self.next, self.keep = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.accept = [(k >> 6, np.uint64(k & 63)) for k in accept]
        for k, own in enumerate(bits):
            for b in own:
                self.next[b, k >> 6] |= _ONE << np.uint64(k & 63)
        for k, own in stay:
            for b in own:
                self.keep[b, k >> 6] |= _ONE << np.uint64(k & 63)
        for k in begin:
            self.start[k >> 6] |= _ONE << np.uint64(k & 63)

    def matches(self, texts: pa.Array) -> np.ndarray:
        """Texts x rules: whether the whole text fits. All texts step together, a byte at a time, the longest first so that ended ones drop out."""
        raw = [x.encode() for x in texts.to_pylist()]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        size = np.array([len(raw[i]) for i in order])
        state = np.tile(self.start, (len(raw), 1))
        buf, off = np.frombuffer(b"".join(raw[i] for i in order), np.uint8), np.append(0, np.cumsum(size))[:-1]
        for at in range(int(size.max(initial=0))):
            m = int(np.searchsorted(-size, -at, side="left"))  # texts longer than `at`
            b = buf[off[:m] + at]
            s = state[:m]
            moved = s << _ONE
            moved[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:m] = (moved & self.next[b]) | (s & self.keep[b])
        out = np.zeros((len(raw), len(self.accept)), bool)
        for j, (w, bit) in enumerate(self.accept):
            out[order, j] = (state[:, w] >> bit) & _ONE == 1
        return out


def filter_urls(pages: DataFrame, rules: Sequence[Rule], otherwise: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (the winner's name; null if none matches), verdict (its, else `otherwise`) for each row.

    A url is made canonical as `.host/path` first: no scheme, query or fragment, the host in lower case. Null urls and ones without ://
    are empty, which only a rule of wildcards fits. Repeated rows stay; other columns are ignored. Rules are a short list, sent to all tasks.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rank = np.array([r.rank for r in rules], np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(rules)
        for batch in batches:
            host, path = batch["host"].to_pylist(), batch["path"].to_pylist()
            hit = auto.matches(pa.array([f".{h}{p}" if h or p else "" for h, p in zip(host, path)], pa.string()))
            best = np.where(hit, rank, np.iinfo(np.int64).min).argmax(axis=1) if len(rules) else np.zeros(len(host), int)
            won = [rules[j] if len(rules) and hit[i, j] else None for i, j in enumerate(best.tolist())]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["host"], batch["path"], pa.array([r.name if r else None for r in won], pa.string()), pa.array([r.verdict if r else otherwise for r in won], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
