"""Host-level quality rules (operator 3), with built-in expressions only.

Each document is measured by rules of its own; failures are counted by host, each host's
failure rate is shrunk with a beta prior that is fitted to all hosts by the method of moments,
and hosts whose shrunk rate exceeds ``HOST_LIMIT`` lose their documents. One failing document
of a small host so doesn't condemn it, and a large host is judged by its own rate.

The measures of a document are taken in one pass and written (a few numbers a row); host counts
are pre-aggregated where the rows lie, so a host with a third of all rows costs no more.

Edge cases: a null text counts as empty (0 words: base_failed). A null host has no verdict: its
documents stand by their own rules. Hosts without spread between them (or a single host) get a
prior of ``PRIOR_ROWS`` rows at the common rate. Repeated rows count each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.llm.common import WHITE_SPACE, keep, small, table
from sextant.llm.native import let, words

WINDOW = 8
LEAST_WORDS = 20
#: Percent of words in repeated windows above which a text fails.
MOST_REPEATED = 30
#: Symbols for each word, and share of repeated lines, above which a text counts against its host.
MOST_SYMBOLS = 0.5
MOST_DUP_LINES = 0.5
HOST_LIMIT = 0.5
PRIOR_ROWS = 20.0


def repeated_words(w: Column, n: int = WINDOW) -> Column:
    """Words in n-word windows that occur twice or more, first occurrences included; n: a power of two."""

    def covered(hashes: Column) -> Column:
        order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(o: Column) -> Column:
            same = lambda a, b: F.get(o, a)["h"].eqNullSafe(F.get(o, b)["h"])
            k = F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda j: ((j > 0) & same(j, j - 1)) | ((j < F.size(o) - 1) & same(j, j + 1)))
            return F.sort_array(F.transform(k, lambda j: F.get(o, j)["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda a, p: F.struct((p + n).alias("end"), (a["n"] + n - F.greatest(a["end"] - p, F.lit(0))).alias("n"))
        return let(order, lambda o: F.aggregate(places(o), start, add, lambda a: a["n"]))

    def joined(h: Column, size: int) -> Column:
        """Hashes of runs of 2 * size words from those of ``size`` words: each with its neighbour ``size`` on."""
        left = F.slice(h, F.lit(1), F.size(h) - size)
        return F.zip_with(left, F.slice(h, F.lit(size + 1), F.size(h) - size), lambda a, b: F.xxhash64(a, b))

    def runs(h: Column, size: int) -> Column:
        return h if size == n else let(joined(h, size), lambda x: runs(x, 2 * size))

    def of(h: Column) -> Column:
        return F.when(F.size(h) < n, F.lit(0).cast("long")).otherwise(
            let(runs(h, 1), lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), F.lit(0).cast("long")).otherwise(covered(x)))
        )

    return let(F.transform(w, lambda x: F.xxhash64(x)), of)


def measures(docs: DataFrame, carry: list[str], host: str = "source") -> DataFrame:
    """``carry`` and host of each document with its measures and base verdict."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE_SPACE))) > 0)

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    measured = docs.select(*carry, F.col(host).cast("string").alias("host"), let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"))
    return measured.select(*carry, "host", "w.*", "l.*", "n_symbols").withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def failures() -> Column:
    """Whether a document counts against its host."""
    return F.col("base_failed") | (F.col("n_symbols") > MOST_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"))


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, rows, failed, rate, host_kept): shrunk failure rate of each host that is not null."""
    hosts = keep(measured.where("host is not null").groupBy("host").agg(F.count("*").alias("rows"), F.sum(failures().cast("long")).alias("failed")), "hosts")
    share = F.col("failed") / F.col("rows")
    # one row: method of moments, the hosts weighted by their rows
    all_rows = hosts.agg(F.sum("failed").alias("f"), F.sum("rows").alias("n"), F.sum(F.col("rows") * share * share).alias("q"), F.sum(1.0 * F.col("failed") * (F.col("rows") - F.col("failed")) / (F.col("rows") * F.col("rows"))).alias("noise")).first()
    mean = (all_rows.f / all_rows.n) if all_rows.n else 0.5
    variance = (all_rows.q / all_rows.n - mean * mean - all_rows.noise / all_rows.n) if all_rows.n else 0.0
    strength = mean * (1 - mean) / variance - 1 if variance > 1e-12 and 0 < mean < 1 else PRIOR_ROWS
    strength = min(max(strength, 1.0), 1e6)
    rate = (F.col("failed") + mean * strength) / (F.col("rows") + strength)
    return hosts.withColumn("rate", rate).withColumn("host_kept", F.col("rate") <= limit)


def judge(docs: DataFrame, carry: list[str] | None = None, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Measures, base_failed and kept of each document, with its host's rate."""
    carry = carry or ["doc_id"]
    measured = keep(measures(docs, carry, host), "measures")
    verdicts = keep(host_verdicts(measured, limit).select("host", F.col("rate").alias("host_rate"), "host_kept"), "verdicts")
    joined = measured.join(small(verdicts), "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
covered AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, unnest(range(0, 8)) AS v(j) GROUP BY rid),
m AS (SELECT w.doc_id, w.source AS host, len(ws) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
      FROM w LEFT JOIN covered USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT host, count(*) AS n, sum(CASE WHEN base_failed OR n_symbols > 0.5 * n_words OR n_dup_lines > 0.5 * n_lines THEN 1 ELSE 0 END)::DOUBLE AS f
      FROM b WHERE host IS NOT NULL GROUP BY host),
moments AS (SELECT sum(f) / sum(n) AS mean, sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)) - sum(f * (n - f) / (n * n)) / sum(n) AS variance FROM h),
prior AS (SELECT mean, least(greatest(CASE WHEN variance > 1e-12 AND mean > 0 AND mean < 1 THEN mean * (1 - mean) / variance - 1 ELSE 20.0 END, 1.0), 1e6) AS strength FROM moments),
v AS (SELECT host, (f + mean * strength) / (n + strength) <= 0.5 AS ok FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, true) AS kept
FROM b LEFT JOIN v USING (host)
"""
