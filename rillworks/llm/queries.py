"""One query for each operator, over the whole table, and SQL for those that SQL can express."""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._native import let, words
from ._scratch import folder
from .centroid_clusters import cluster_vectors, with_inertia
from .decontaminate import build_index, find_leaks
from .html_render import render_html
from .jaccard_join import jaccard_components
from .language_id import fit_language_model, fold, identify_language
from .mix_sources import mix_sources
from .periodic_runs import periodic_runs
from .quality_rules import judge_quality
from .secret_ledger import BASE_RULES, RULES, scan_history
from .shards import shard
from .substring_dedup import substring_dedup
from .toxicity import fit_toxicity_model, score_toxicity
from .url_filter import Rule, filter_urls, host_rule

URL_RULES = [
    host_rule("com", "/en/", "block"), host_rule("example.com", "/en/7", "allow"), host_rule("net", "/de/", "allow"),
    host_rule("example.net", "/de/8", "block"), host_rule("org", "/es/", "block"), Rule("*spam-farm*/**", "block", rank=-1), Rule("*spam-farm*", "block", rank=-1),
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    docs = _read(spark, sf_dir, "documents")
    return find_leaks(docs, build_index(docs, _read(spark, sf_dir, "benchmark")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity_model(docs, _read(spark, sf_dir, "labels").where(~fold("doc_id", 5, 0)))
    return score_toxicity(docs, model).withColumn("held_out", fold("doc_id", 5, 0))


def op3_html_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render_html(_read(spark, sf_dir, "pages"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_read(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard(_read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge_quality(_read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language_model(docs.where(~fold("doc_id", 4, 2)))
    return identify_language(docs, model).withColumn("held_out", fold("doc_id", 4, 2))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(cluster_vectors(_read(spark, sf_dir, "embeddings")))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are the first versions that a new ledger meets."""
    rows = scan_history(_read(spark, sf_dir, "documents"), f"{folder(spark)}/ledger-{uuid.uuid4().hex}", RULES)

    def of(*rules: str) -> Column:
        return F.filter("found", lambda x: x["rule"].isin(*rules))

    def joined(found: Column) -> Column:
        return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = [r.name for r in BASE_RULES]
    return rows.select("path.doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(joined(of(*base)).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: where the crc32 h of the decimal doc_id is divisible by ten and there are words, they repeat from word a = h div 10 mod n on, with a period that depends on h."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        return let(F.struct((g % n).alias("a"), (1 + F.floor((n - g % n) / (3 + g % 8))).alias("p")), lambda x: F.array_join(F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "))

    text = F.when(h % 10 == 0, let(words(F.col("text")), lambda w: F.when(F.size(w) > 0, repeated(w)))).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic_runs(with_periods(_read(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("down"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "x.start", (-F.col("x.down")).alias("length"), "x.period", F.floor(1000 * -F.col("x.down") / F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES = {
    f.__name__: f
    for f in (op1_decontaminate, op2_toxicity, op3_html_render, op4_jaccard_join, op5_mix_sources, op6_shards, op7_quality_rules, op8_url_filter, op9_language_id, op10_substring_dedup, op11_centroid_clusters, op12_secret_scan, op13_periodic_runs)
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_HOST = "translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda x, c: list_reduce(list_prepend(xor(x, c), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
_FITS = "('.' || host) LIKE '%.{0}' AND starts_with(path, '{1}')"

_FLOORED = "(s - ((s % n) + n) % n) // n"


def _clusters_sql(k: int, rounds: int, width: int) -> str:
    """The rounds one after the other: a (assignment), then m (means), as tables of their own."""
    near = "a{0} AS MATERIALIZED (SELECT i, x, arg_min(c, (d, c)) AS c, MIN(d) AS d FROM (SELECT v.i, v.x, m.c, CAST(list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, m{0} m) GROUP BY i, x)"
    means = f"s{{1}} AS (SELECT c, p, SUM(x[p])::BIGINT AS s, COUNT(*) AS n FROM a{{0}}, UNNEST(range(1, {width + 1})) u(p) GROUP BY 1, 2), m{{1}} AS MATERIALIZED (SELECT o.c, COALESCE(l.x, o.x) AS x FROM m{{0}} o LEFT JOIN (SELECT c, list({_FLOORED} ORDER BY p) AS x FROM s{{1}} GROUP BY 1) l USING (c))"
    steps = ", ".join(f"{near.format(r)}, {means.format(r, r + 1)}" for r in range(rounds))
    return (
        f"WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS x FROM embeddings WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0), "
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v QUALIFY c < {k}), {steps}, {near.format(rounds)} "
        f"SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(SUM(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(SUM(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (i) JOIN m{rounds} m ON m.c = a.c"
    )


_QUOTED = [(n, r, r.pattern.replace("'", "''")) for n, r in enumerate(RULES)]
_SPANS = " UNION ALL ".join(f"SELECT doc_id, '{r.name}' AS kind, {n} AS o, {r.least} AS least, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS v, regexp_split_to_array(text, '{p}') AS gaps FROM documents" for n, r, p in _QUOTED)

ORACLES = {
    "op4_jaccard_join": (
        f"WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents), "
        "s AS (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM w, UNNEST(range(1, greatest(2, len(w) - 3))) u(i) WHERE len(w) > 0), n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1), "
        "o AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS both_have FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2), "
        "l AS MATERIALIZED (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_have >= 80 * (p.n + q.n - both_have)), "
        "r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.x, r.c FROM r JOIN l ON l.y = r.doc_id) "
        "SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, MIN(c) AS c FROM r GROUP BY 1) m USING (doc_id)"
    ),
    "op5_mix_sources": (
        f"WITH d AS (SELECT doc_id, source, len({_WORDS.format("COALESCE(text, '')")}) AS size, -ln((CAST('0x' || substr(md5('mix' || doc_id), 1, 13) AS BIGINT) + 1) / 4503599627370498e0) / COALESCE(greatest(0.05e0, length(translate(text, '#*$%&|<>', '')) / NULLIF(length(text), 0)), 0.05e0) AS k FROM documents), "
        "z AS (SELECT source, SUM(size) AS ss FROM d GROUP BY 1), w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM z), a AS (SELECT *, 3e0 * ss AS stop, 3e0 * ss / w AS reach FROM w), "
        "v AS (SELECT *, (SUM(ss) OVER () - COALESCE(SUM(stop) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(w) OVER (ORDER BY reach, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM a), "
        "t AS (SELECT source, ss, least(stop, (SELECT arg_min(level, reach) FROM v WHERE level <= reach) * w) AS target FROM v), e AS (SELECT *, CAST(floor(target / NULLIF(ss, 0)) AS BIGINT) AS epochs FROM t), f AS (SELECT *, CAST(round(target) AS BIGINT) - epochs * ss AS rest FROM e), "
        "x AS (SELECT d.*, f.ss, f.target, f.epochs, f.rest, SUM(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source) "
        "SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ss AS BIGINT) AS source_size, target, CAST(epochs * size + greatest(0, least(size, rest - (upto - size))) AS BIGINT) AS taken FROM x"
    ),
    "op7_quality_rules": (
        f"WITH d AS (SELECT doc_id, COALESCE(text, '') AS t, {_WORDS.format("COALESCE(text, '')")} AS w FROM documents), k AS (SELECT doc_id, i, hash(w[i:i + 7]) AS g FROM d, UNNEST(range(1, greatest(1, len(w) - 6))) u(i)), "
        "c AS (SELECT doc_id, COUNT(DISTINCT i + j) AS n FROM (SELECT *, COUNT(*) OVER (PARTITION BY doc_id, g) AS m FROM k), UNNEST(range(0, 8)) u(j) WHERE m > 1 GROUP BY 1), "
        r"l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d), "
        "s AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS bangs, "
        r"length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s) "
        "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines) OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR bangs > n_words OR 2 * letters < word_chars) AS kept FROM b"
    ),
    "op8_url_filter": (
        "WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages), "
        f"h AS (SELECT page_id, {_HOST} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r), "
        f"w AS (SELECT *, CASE WHEN {_FITS.format('example.com', '/en/7')} THEN 'example.com/en/7' WHEN {_FITS.format('example.net', '/de/8')} THEN 'example.net/de/8' WHEN {_FITS.format('com', '/en/')} THEN 'com/en/' WHEN {_FITS.format('net', '/de/')} THEN 'net/de/' WHEN {_FITS.format('org', '/es/')} THEN 'org/es/' END AS rule FROM h) "
        "SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN contains(host, 'spam-farm') THEN 'block' ELSE 'allow' END AS verdict FROM w"
    ),
    "op10_substring_dedup": (
        f"WITH d AS (SELECT doc_id, {_WORDS.format("COALESCE(text, '')")} AS w FROM documents), k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM d, UNNEST(range(1, greatest(1, len(w) - 48))) u(i)), "
        "o AS (SELECT doc_id, i, MIN(doc_id) OVER (PARTITION BY g) AS first FROM k), c AS (SELECT DISTINCT doc_id, i + j AS p FROM o, UNNEST(range(0, 50)) u(j) WHERE first < doc_id), "
        "x AS (SELECT d.doc_id, p, w[p] AS word FROM d, UNNEST(range(1, len(w) + 1)) u(p)), y AS (SELECT x.doc_id, COUNT(c.p) AS gone, COALESCE(string_agg(word, ' ' ORDER BY x.p) FILTER (c.p IS NULL), '') AS kept FROM x LEFT JOIN c USING (doc_id, p) GROUP BY 1) "
        "SELECT d.doc_id, len(w) AS n_words, COALESCE(gone, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)"
    ),
    "op11_centroid_clusters": _clusters_sql(40, 5, 64),
    "op12_secret_scan": (
        f"WITH m AS ({_SPANS}), f AS (SELECT doc_id, kind, o, CAST(COALESCE(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n FROM m, UNNEST(range(1, len(m) + 1)) u(i) WHERE length(v[i]) >= least), "
        "g AS (SELECT doc_id, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access, COUNT(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) AS spans, string_agg(kind || ':' || s || ':' || (s + n), ',' ORDER BY s, o) FILTER (o < 3) AS base FROM f GROUP BY 1) "
        "SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex, sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans FROM documents d LEFT JOIN g USING (doc_id)"
    ),
    "op13_periodic_runs": (
        f"WITH h AS (SELECT doc_id, {_WORDS.format("COALESCE(text, '')")} AS w, {_CRC32.format('doc_id')} AS h FROM documents), g AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM h), "
        "a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g), p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a), "
        "d AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) ELSE w END AS w FROM p), "
        "k AS MATERIALIZED (SELECT doc_id, n, i, hash(w[i + 1:i + 5]) AS k FROM d, UNNEST(range(0, n - 4)) u(i)), q AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.doc_id = y.doc_id AND x.k = y.k AND y.i > x.i AND 4 * (y.i - x.i) <= x.n), "
        "s AS (SELECT doc_id, q, MIN(i) AS s, COUNT(*) + 4 + q AS l FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM q) GROUP BY doc_id, q, island), "
        "r AS MATERIALIZED (SELECT doc_id, s, l, MIN(q) AS q FROM s WHERE l >= greatest(6, 4 * q) GROUP BY 1, 2, 3), "
        "o AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS lines, MIN(struct_pack(down := -l, s := s, q := q)) AS x FROM r GROUP BY 1), "
        "c AS (SELECT DISTINCT doc_id, p FROM r, UNNEST(range(s + q, s + l)) u(p)), t AS (SELECT d.doc_id, string_agg(w[u.p + 1], ' ' ORDER BY u.p) AS kept FROM d, UNNEST(range(0, n)) u(p) LEFT JOIN c ON c.doc_id = d.doc_id AND c.p = u.p WHERE c.p IS NULL GROUP BY 1) "
        "SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, x.s AS start, -x.down AS length, x.q AS period, 1000 * -x.down // x.q AS exponent_milli, sha256(COALESCE(lines, '')) AS runs_sha256, sha256(COALESCE(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN o USING (doc_id) LEFT JOIN t USING (doc_id)"
    ),
}
