"""Quality rules with risk-controlled thresholds.

Each rule rejects a document whose measure exceeds a cutoff. Labelled good documents decide how
strict a cutoff may be: for every stratum and rule, cutoffs are tested from the most lenient to the
strictest, and a cutoff holds if an exact binomial test rules out that it rejects more than the
rule's share of the allowed rate of good documents. Testing in a fixed order needs no correction
inside a sequence; the error level is divided by the number of sequences (Bonferroni). So, with
probability 1 - LEVEL, in every stratum at most RATE of good documents fall to all rules together,
beyond those that fail the base rule. A stratum with too few labels has no cutoffs: it rejects less.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, durable, text_of

#: Allowed rate of good documents rejected in a stratum, and the chance that some stratum exceeds it.
RATE, LEVEL = 0.02, 0.05
#: Languages with a stratum of their own, the most labelled ones; all others share one.
STRATA = 64
WINDOW, MIN_WORDS = 8, 20
SYMBOLS = "#*$%&|<>"

#: Measures and cutoffs, from lenient to strict; they are fixed before any label is seen.
RULES = {
    "symbol_rate": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01],
    "stutter_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "dup_line_rate": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_rate": [0.3, 0.25, 0.2, 0.15, 0.1],
    "mean_word": [40.0, 30.0, 20.0, 15.0, 12.0, 10.0],
}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the
    measures of RULES, all in columns that start with an underscore."""
    blank_less = F.translate(text_of(), BLANKS, "")
    words = F.filter(F.split(F.translate(text_of(), BLANKS, " " * len(BLANKS)), " ", -1), lambda w: w != "")
    lines = F.filter(F.split(text_of(), "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    df = docs.select("*", words.alias("_words"), lines.alias("_lines"), F.length(blank_less).cast("long").alias("_word_chars"),
                     (F.length(text_of()) - F.length(F.translate(text_of(), SYMBOLS, ""))).cast("long").alias("_n_symbols"))
    df = df.select(
        *[c for c in df.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("long").alias("_n_words"), F.size("_lines").alias("_n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("_n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    windows = F.when(F.col("_n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.col("_n_words").cast("int") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    stutter = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size("_hashes") - 1, F.lit(1))), lambda i: F.get("_hashes", i) == F.get("_hashes", i - 1)))
    df = df.select(*[c for c in df.columns if c != "_hashes"], windows.alias("_windows"), stutter.alias("_n_stutter"))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.when(twice, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    df = df.select(*[c for c in df.columns if c != "_windows"], ordered.alias("_ordered"))
    beside = lambda x, i: F.coalesce(F.get("_ordered", i)["h"] == x["h"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("_ordered", lambda x, i: beside(x, i - 1) | beside(x, i + 1)), lambda x: x["i"]))
    df = df.select(*[c for c in df.columns if c != "_ordered"], starts.alias("_starts"))
    covered = _sum(F.transform("_starts", lambda p, j: F.least(F.coalesce(F.get("_starts", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")))
    df = df.select(*[c for c in df.columns if c != "_starts"], covered.alias("_n_repeat_words"))
    n = F.greatest(F.col("_n_words"), F.lit(1)).cast("double")
    measures = {
        "_base_failed": (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > 30 * F.col("_n_words")),
        "_symbol_rate": F.col("_n_symbols") / F.greatest(F.col("_word_chars"), F.lit(1)).cast("double"),
        "_stutter_rate": F.col("_n_stutter") / n,
        "_dup_line_rate": F.col("_n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)).cast("double"),
        "_repeat_rate": F.col("_n_repeat_words") / n,
        "_mean_word": F.col("_word_chars") / n,
    } | {c: F.col(c) for c in ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")}
    # One struct in an array, unpacked again: the optimiser doesn't move conditions on what a generator
    # makes below it, where it would write out the whole chain above for every use of a measure.
    return df.select(*docs.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in measures.items()]))))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift of eight; relative error below 1e-13 for x >= 1."""
    z, shift = x + 8.0, x
    for k in range(1, 8):
        shift = shift * (x + float(k))
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * z) - 1 / (360.0 * z * z * z) + 1 / (1260.0 * z * z * z * z * z) - F.ln(shift)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) for X of n trials at ``rate``; terms further below k than twelve deviations are nil."""
    x, m = k.cast("double"), n.cast("double")
    least = F.greatest(F.lit(0), k.cast("int") - (F.lit(200) + 12 * F.sqrt(m).cast("int")))
    log_p = lambda i: _log_gamma(m + 1.0) - _log_gamma(i + 1.0) - _log_gamma(m - i + 1.0) + i * math.log(rate) + (m - i) * math.log1p(-rate)
    below = F.aggregate(F.transform(F.sequence(least, k.cast("int")), lambda i: F.exp(log_p(i.cast("double")))), F.lit(0.0), lambda a, p: a + p)
    return F.when(x >= m * rate, F.lit(1.0)).otherwise(below)


def cutoffs(measures: DataFrame, labels: DataFrame, rate: float = RATE, level: float = LEVEL) -> dict[str, dict[str, float]]:
    """Per stratum and rule, the strictest cutoff that holds; a language not named has those of ''.

    Every named language has an entry, an empty one if none of its cutoffs holds.

    ``measures`` has doc_id, lang, _base_failed and the measures; ``labels`` doc_id and quality
    (1: good). An id labelled more than once is good only if all its labels say so.
    """
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1")
    held = measures.join(good, "doc_id", "left_semi").where(~F.col("_base_failed"))
    counts = [F.sum((F.col(f"_{rule}") > c).cast("long")).alias(f"{rule}_{j}") for rule, cuts in RULES.items() for j, c in enumerate(cuts)]
    own = held.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(STRATA)
    names = sorted(r["lang"] for r in own.collect())
    stratum = F.when(F.col("lang").isin(names), F.col("lang")).otherwise("") if names else F.lit("")
    table = held.withColumn("_stratum", stratum).groupBy("_stratum").agg(F.count("*").alias("_n"), *counts)
    tests = (len(names) + 1) * len(RULES)
    each = F.explode(F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(j).alias("j"), F.col(f"{rule}_{j}").alias("k")) for rule, cuts in RULES.items() for j in range(len(cuts))]))
    tested = table.select("_stratum", "_n", each.alias("t")).select("_stratum", "t.rule", "t.j", (binomial_tail(F.col("t.k"), F.col("_n"), rate / len(RULES)) <= level / tests).alias("ok"))
    held_up = tested.groupBy("_stratum", "rule").agg(F.min(F.when(~F.col("ok"), F.col("j"))).alias("failed"))
    chosen: dict[str, dict[str, float]] = {name: {} for name in names}
    for r in held_up.collect():  # a row for each stratum and rule
        n_held = len(RULES[r["rule"]]) if r["failed"] is None else r["failed"]
        if n_held:
            chosen.setdefault(r["_stratum"], {})[r["rule"]] = RULES[r["rule"]][n_held - 1]
    return chosen


def verdict(chosen: dict[str, dict[str, float]]) -> Column:
    """Whether a measured row stays."""
    def within(limits: dict[str, float]) -> Column:
        ok = F.lit(True)
        for rule, cut in limits.items():
            ok = ok & (F.col(f"_{rule}") <= F.lit(cut))
        return ok

    named = [F.when(F.col("lang") == name, within(limits)) for name, limits in sorted(chosen.items()) if name]
    return ~F.col("_base_failed") & F.coalesce(*named, within(chosen.get("", {})))


def _narrow(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "lang", "_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words", "_base_failed", *[f"_{r}" for r in RULES])


def quality(docs: DataFrame, labels: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept.

    Null and empty texts have no words and fail the base rule. A null lang belongs to the shared
    stratum. Repeated rows are measured alike. Without labels no rule has a cutoff and the base rule
    decides alone. An empty table gives an empty result; columns besides doc_id, text, lang are not read.
    """
    found = durable(_narrow(measured(docs.select("doc_id", "text", "lang"))))
    kept = verdict(cutoffs(found, labels, rate, level))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return found.select("doc_id", *[F.col(f"_{c}").alias(c) for c in names], kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, rate: float = RATE, level: float = LEVEL) -> DataFrame:
    """The rows of ``docs`` whose verdict is to stay, with all their columns.

    Texts are measured once, and kept with their measures while the cutoffs are chosen.
    """
    whole = docs.select(F.struct("*").alias("_row"), F.col("doc_id"), F.col("text"), F.col("lang"))  # own names can't clash with the measures'
    found = measured(whole)
    found = durable(found.select("_row", *_narrow(found).columns))
    return found.where(verdict(cutoffs(_narrow(found), labels, rate, level))).select("_row.*")


def _oracle() -> str:
    rows = [f"('{rule}', {j}, CAST({c} AS DOUBLE))" for rule, cuts in RULES.items() for j, c in enumerate(cuts)]
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, stratum, {r} AS v FROM held" for r in RULES)
    over = " OR ".join(f"{r} > (SELECT c FROM chosen WHERE chosen.stratum = s.stratum AND chosen.rule = '{r}')" for r in RULES)
    blank = "[\\x20\\x09-\\x0D]"
    return f"""
WITH raw AS (
  SELECT row_number() OVER () AS row, doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(regexp_split_to_array(t, '{blank}+'), lambda w: w <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{blank}', '', 'g') <> '') AS ls FROM raw
), grams AS (
  SELECT row, i, ws[i : i + {WINDOW - 1}] AS g FROM (SELECT row, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split)
), twice AS (
  SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, g) AS c FROM grams) WHERE c > 1
), covered AS (
  SELECT row, count(DISTINCT i + k) AS n FROM twice, range({WINDOW}) AS r(k) GROUP BY row
), m AS (
  SELECT s.row, doc_id, lang, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{blank}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM split s LEFT JOIN covered c ON s.row = c.row
), rates AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE) AS symbol_rate, n_stutter / CAST(greatest(n_words, 1) AS DOUBLE) AS stutter_rate,
    n_dup_lines / CAST(greatest(n_lines, 1) AS DOUBLE) AS dup_line_rate, n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) AS repeat_rate,
    word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS mean_word FROM m
), good AS (
  SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1
), labelled AS (
  SELECT * FROM rates WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
), own AS (
  SELECT lang FROM labelled WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT {STRATA}
), s AS (
  SELECT *, CASE WHEN lang IN (SELECT lang FROM own) THEN lang ELSE '' END AS stratum FROM rates
), held AS (
  SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)
), each_rule AS ({each}), cut(rule, j, c) AS (VALUES {", ".join(rows)}), counted AS (
  SELECT stratum, cut.rule, j, c, count(*) AS n, count(*) FILTER (v > c) AS k FROM each_rule JOIN cut ON each_rule.rule = cut.rule GROUP BY ALL
), tested AS (
  SELECT *, k < n * {RATE / len(RULES)!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
    + i * ln({RATE / len(RULES)!r}) + (n - i) * ln(1 - {RATE / len(RULES)!r})))) <= {LEVEL!r} / ((SELECT count(*) + 1 FROM own) * {len(RULES)}) AS ok FROM counted
), chosen AS (
  SELECT stratum, rule, min(c) AS c FROM (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY j) AS held_so_far FROM tested) WHERE held_so_far GROUP BY ALL
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce({over}, false) AS kept FROM s
"""


ORACLE_SQL = _oracle()
