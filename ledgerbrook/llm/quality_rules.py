"""Quality rules with host-level verdicts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, arrow_map, arrow_type, covered, dense_ids, kept_names, released, stored, table, utf8, window_codes, with_columns

SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Rejected hosts are broadcast up to this many bytes; beyond, they join by a salted shuffle.
BROADCAST_BYTES = 16 << 20
SALTS = 64
#: A host goes if its shrunk rate on a rule exceeds MOST, or the prior's mean by DEVIATIONS and by FACTOR.
MOST, DEVIATIONS, FACTOR = 0.5, 3, 2


def measure(text: bytes | None, window: int = 5) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, lines equal to an earlier one, words in repeated windows."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    repeated = 0
    if len(words) > window:
        codes = window_codes(*dense_ids(words), window)
        _, which, times = np.unique(codes, return_inverse=True, return_counts=True)
        if len(times) < len(codes):
            repeated = int(covered(np.flatnonzero(times[which] > 1), window, len(words)).sum())
    return len(words), len(text.translate(None, SPACE + _CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs, without the text if so asked, with the measures of each whole text; columns of those names are replaced."""
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    kept, schema = [n for n in kept_names(docs, MEASURES) if not (drop_text and n == text_col)], arrow_type(MEASURES)

    def each(batches):
        released()
        for batch in batches:
            rows = [measure(x) for x in utf8(batch, text_col)]
            yield with_columns(batch, kept, schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 5)

    return arrow_map(docs, MEASURES, each, keep=kept)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failures() -> dict[str, Column]:
    """What counts against a host, by rule: the base rules; over a symbol per ten words; three repeated lines; words of under 2 or over 14 letters on average."""
    n = F.col("n_words")
    return {"base": base_failed(), "symbols": 10 * F.col("n_symbols") > n, "lines": F.col("n_dup_lines") >= 3, "letters": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 14 * n)}


def host_rates(docs: DataFrame, host: Column, failures: dict[str, Column]) -> DataFrame:
    """One row per host and rule: n, fails, the failure rate shrunk to a beta prior that is fitted to all hosts by moments, and the prior's mean and deviation.

    The prior's mean is the pooled rate; its variance is the spread of the hosts' rates beyond binomial noise (none: every
    rate is the pooled one). Sums are taken by partial aggregation, so one host may hold most rows. Only a few sums per
    rule reach the driver.
    """
    names = list(failures)
    sums = docs.select(host.alias("__host"), *(f.cast("long").alias(r) for r, f in failures.items())).groupBy("__host").agg(F.count("*").alias("n"), *(F.sum(r).alias(r) for r in names))
    long = sums.select("__host", "n", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("fails")) for r in names))))
    hosts = stored(long, "hosts")
    pooled = {r.rule: r for r in hosts.groupBy("rule").agg(F.sum("n").alias("n"), F.sum("fails").alias("x"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.count("*").alias("h")).collect()}  # one row per rule
    if not pooled:
        return hosts.withColumns({x: F.lit(0.0) for x in ("rate", "mean", "deviation")})
    pick = lambda values: F.element_at(F.create_map(*(F.lit(v) for r, x in values.items() for v in (r, float(x)))), F.col("rule"))
    means = {r: p.x / p.n for r, p in pooled.items()}
    spread = {r.rule: r.s for r in hosts.groupBy("rule").agg(F.sum(F.col("n") * F.pow(F.col("fails") / F.col("n") - pick(means), 2)).alias("s")).collect()}
    between, strength = {}, {}
    for r, p in pooled.items():
        noise = means[r] * (1 - means[r])
        between[r] = max(0.0, (spread[r] / p.n - noise * p.h / p.n) / max(1e-9, 1 - p.n2 / p.n**2)) if p.h > 1 else 0.0
        strength[r] = max(noise / between[r] - 1, 0.0) if between[r] > 0 else -1.0  # -1: without bound
    k, mean = pick(strength), pick(means)
    rate = F.when(k < 0, mean).otherwise((F.col("fails") + mean * k) / (F.col("n") + k))
    return hosts.withColumn("mean", mean).withColumn("deviation", F.sqrt(pick(between))).withColumn("rate", rate)


def rejected() -> Column:
    """A host's verdict on one rule: most of its documents fail, or it stands out of the prior, by deviations and by a factor."""
    return (F.col("rate") > MOST) | (F.col("rate") > F.greatest(F.col("mean") + DEVIATIONS * F.col("deviation"), FACTOR * F.col("mean")))


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", drop_text: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs plus measures, base_failed, host_rule and host_rate (of rejected hosts: the worst rule and its rate) and kept.

    A document is kept if it passes the base rules and its host is rejected on no rule. Texts are measured once; what
    is measured is stored (with drop_text, without the texts). Null text: no words, so the base rules fail. Texts may be
    of any length; memory grows with the longest. Null hosts form one host. Empty table: empty result. Repeated rows count and
    stay each. Input columns with the names of results are replaced.
    """
    host = F.coalesce(F.col("__host_text"), F.lit("\0null"))
    rows = docs.drop("base_failed", "kept", "host_rule", "host_rate").withColumn("__host_text", F.col(host_col).cast("string"))
    rows = stored(measured(rows, text_col, drop_text), "measures")
    worst = F.max(F.struct(F.col("rate").alias("host_rate"), F.col("rule").alias("host_rule"))).alias("x")
    bad = stored(host_rates(rows, host, rule_failures()).where(rejected()).groupBy("__host").agg(worst).select(F.col("__host").alias("__bad"), "x.*"), "rejected")
    size = int(bad.agg(F.sum(F.octet_length("__bad") + F.lit(40))).first()[0] or 0)
    rows = rows.withColumn("base_failed", base_failed()).withColumn("__host", host)
    if size <= broadcast_bytes:
        out = rows.join(F.broadcast(bad), F.col("__host") == F.col("__bad"), "left")
    else:  # each rejected host meets its rows in SALTS places
        bad = bad.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("__s", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int"))
        out = rows.join(bad, (F.col("__host") == F.col("__bad")) & (F.col("__s") == F.col("__salt")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__host_text", "__bad", "__s", "__salt")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs, drop_text=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: The method's verdict follows from rates over all rows, in the same arithmetic.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) >= 2),
cov AS (SELECT rid, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest(range(0, 5)) AS o) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w) w
  LEFT JOIN cov ON cov.rid = w.rid),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m),
f AS (
  SELECT host, 'base' AS rule, base_failed AS x FROM b UNION ALL SELECT host, 'symbols', 10 * n_symbols > n_words FROM b
  UNION ALL SELECT host, 'lines', n_dup_lines >= 3 FROM b UNION ALL SELECT host, 'letters', word_chars < 2 * n_words OR word_chars > 14 * n_words FROM b),
h AS (SELECT host, rule, count(*) AS n, sum(CAST(x AS INT)) AS x FROM f GROUP BY host, rule),
p AS (SELECT rule, sum(n) AS n, sum(x) / sum(n) AS mean, sum(CAST(n AS DOUBLE) * n) AS n2, count(*) AS h FROM h GROUP BY rule),
q AS (SELECT rule, p.n, mean, n2, p.h, mean * (1 - mean) AS noise, (SELECT sum(h.n * pow(h.x / h.n - p.mean, 2)) FROM h WHERE h.rule = p.rule) / p.n AS spread FROM p),
r AS (SELECT *, CASE WHEN q.h > 1 THEN greatest(0, (spread - noise * q.h / n) / greatest(1e-9, 1 - n2 / (n * n))) ELSE 0 END AS btw FROM q),
s AS (SELECT rule, mean, sqrt(btw) AS dev, CASE WHEN btw > 0 THEN greatest(noise / btw - 1, 0) END AS k FROM r),
v AS (SELECT host, mean, dev, coalesce((x + mean * k) / (n + k), mean) AS rate FROM h JOIN s USING (rule)),
g AS (SELECT DISTINCT host FROM v WHERE rate > 0.5 OR rate > greatest(mean + 3 * dev, 2 * mean))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host NOT IN (SELECT host FROM g)) AS kept
FROM b
"""
