"""Operator 4: quality rules with host verdicts, in DataFrame functions only.

Each text is judged by rules of its own. Failures are then summed by host; as small
hosts have wild rates, a rate is shrunk by a beta prior fitted to all hosts' rates by
their moments without what sampling adds to their spread, and a host whose shrunk rate
exceeds ``reject_at`` is rejected. Verdicts
are joined back to the documents. Sums by host are combined before the shuffle, and
the join is left to adaptive execution, which broadcasts verdicts only when they turn
out to be small and splits hot hosts otherwise.

Words within a window are compared by 64-bit hashes of windows. Windows are sorted
within a row only where the row has a window twice.

Rows: a null text has no words, lines or symbols and fails the base rules; an empty
one too. Hosts that are null are one host. Repeated and tied rows are judged and
counted one by one. An empty table gives an empty result. Columns that the result names
again are not carried over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorscape.llm.shared import materialise, table

# The contract's words, symbols and windows.
WORD, SYMBOL, WINDOW = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]", 5
#: Rules besides the base ones: symbols a word, share of repeated lines, code points a word.
MAX_SYMBOLS, MAX_DUP_LINES, WORD_LENGTH = 0.5, 0.3, (2.0, 20.0)
#: A host is rejected if this share of its documents fails, after shrinking.
REJECT_AT = 0.6
#: The prior counts as so many documents at least.
LEAST_WEIGHT = 4.0


def text_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = docs.select(
        F.col(key).alias("_key"), F.col(host).alias("_host"),
        F.regexp_extract_all(t, F.lit(WORD), 0).alias("_w"), lines.alias("_lines"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
    )
    df = df.select(
        "_key", "_host", "word_chars", "n_symbols", F.size("_w").cast("long").alias("n_words"), F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"),
    )
    # Each array that a lambda looks into is a column of its own, so that it is computed once a row.
    last = F.size("_h") - WINDOW

    def window(x: Column, i: Column) -> Column:
        return F.when(i <= last, F.xxhash64(x, *(F.get("_h", i + k) for k in range(1, WINDOW))))

    df = df.withColumn("_win", F.slice(F.transform("_h", window), F.lit(1), F.greatest(last + 1, F.lit(0))))
    df = df.withColumn("_twice", F.size(F.array_distinct("_win")) < F.size("_win"))
    pairs = F.when(F.col("_twice"), F.array_sort(F.transform("_win", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    df = df.select(*[c for c in df.columns if c not in ("_h", "_win", "_twice")], pairs.alias("_s"))

    def twice(x: Column, j: Column) -> Column:
        before, after = F.get("_s", j - 1), F.get("_s", j + 1)
        return F.coalesce(before["h"] == x["h"], F.lit(False)) | F.coalesce(after["h"] == x["h"], F.lit(False))

    df = df.withColumn("_p", F.array_sort(F.transform(F.filter("_s", twice), lambda x: x["i"])))
    covered = F.aggregate(F.transform("_p", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return df.select(F.col("_key").alias(key), F.col("_host").alias("host"), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def any_failed() -> Column:
    """Whether a document fails any rule, the base ones included."""
    per_word = F.col("word_chars") / F.greatest("n_words", F.lit(1))
    return base_failed() | (F.col("n_symbols") > MAX_SYMBOLS * F.col("n_words")) | (F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_lines")) | ~per_word.between(*WORD_LENGTH)


def host_verdicts(judged: DataFrame, reject_at: float = REJECT_AT) -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, rejected) from documents (host, failed).

    The prior has the mean m of all documents. Its weight a + b is 1 / r - 1, where r is the correlation of two
    documents of a host, so that sampling noise of small hosts is no spread (analysis of variance): with S = sum of
    n (rate - m)^2 over H hosts and N documents, r = (S / (m (1 - m)) - (H - 1)) / (N - sum n^2 / N - (H - 1)).
    It is held within LEAST_WEIGHT and 1000; without spread, or with one host, it is 1000. With four documents at
    least, one failing document rejects no host while half of all documents or fewer fail.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("s"), F.sum(n * n).alias("nn"), (F.count("*") - 1).cast("double").alias("h"))
    m = F.col("k") / F.col("n")
    spread = F.col("s") - F.col("k") * m
    free = F.col("n") - F.col("nn") / F.col("n") - F.col("h")
    r = F.try_divide(spread - F.col("h") * m * (1 - m), m * (1 - m) * free)
    weight = F.when((r > 0) & (free > 0), F.least(F.lit(1000.0), F.greatest(F.lit(LEAST_WEIGHT), F.try_divide(F.lit(1.0), r) - 1))).otherwise(1000.0)
    prior = sums.select(m.alias("m"), weight.alias("weight"))  # one row
    shrunk = (F.col("n_failed") + F.col("m") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk_rate"), (shrunk > reject_at).alias("rejected"))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", reject_at: float = REJECT_AT) -> DataFrame:
    """The counts of every document with base_failed, failed, shrunk_rate of its host, and kept."""
    counts = text_counts(docs, key, text, host)
    judged = materialise(counts.withColumns({"base_failed": base_failed(), "failed": any_failed()}), "quality")
    verdicts = host_verdicts(judged, reject_at).select(F.col("host").alias("_h"), "shrunk_rate", "rejected")
    joined = judged.join(verdicts, F.col("host").eqNullSafe(F.col("_h")), "left").drop("_h")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
c AS (SELECT doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines FROM a),
win AS (SELECT doc_id, k, array_to_string(w[k : k + 4], ' ') AS s FROM a, unnest(range(1, greatest(1, len(w) - 3))) AS u(k)),
dup AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM dup) GROUP BY doc_id),
j AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words,
  n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, base_failed OR n_symbols > {MAX_SYMBOLS}e0 * n_words OR n_dup_lines > {MAX_DUP_LINES}e0 * n_lines
  OR NOT (word_chars / greatest(n_words, 1) BETWEEN {WORD_LENGTH[0]}e0 AND {WORD_LENGTH[1]}e0) AS failed FROM j),
h AS (SELECT source, count(*) AS n, sum(CAST(failed AS INT)) AS k FROM f GROUP BY source),
q AS (SELECT sum(n) AS n, sum(k) / sum(n) AS m, sum(k * k / n) AS s, sum(n * n) AS nn, count(*) - 1 AS h
  FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k FROM h)),
v AS (SELECT m, CASE WHEN m > 0 AND m < 1 AND n - nn / n - h > 0
  THEN (s - m * m * n - h * m * (1 - m)) / (m * (1 - m) * (n - nn / n - h)) ELSE 0 END AS r FROM q),
p AS (SELECT m, CASE WHEN r > 0 THEN least(1000e0, greatest({LEAST_WEIGHT}e0, 1 / r - 1)) ELSE 1000e0 END AS s FROM v),
r AS (SELECT source, (k + m * s) / (n + s) > {REJECT_AT}e0 AS rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
