"""Quality rules whose cutoffs bound how many good documents they reject.

Each rule compares a ratio of counts with a cutoff, chosen for each stratum (by default the
language) on labelled documents that are held out for it: cutoffs are tried from lenient to
strict; a cutoff is taken while the exact binomial test rejects, from the good labelled
documents that it would reject, that the true rate is above the rule's share of ``MAX_FALSE``.
The first cutoff that fails ends the trial (fixed-sequence testing needs no correction within a rule), and
the level ``DELTA`` is divided by the number of strata and rules (Bonferroni). So with
probability 1 - ``DELTA`` no stratum loses more than ``MAX_FALSE`` of its good documents to
all its rules together. A stratum with too few labels has no cutoff and loses none.

All in DataFrame functions; the texts are read once and what is counted of them is written.

Defined cases: a null text has no word and fails; labels without a document, a null label and a
null ``doc_id`` teach nothing; of several labels for a document the least counts; a null stratum is one of
its own; a ratio without denominator fails no rule; equal rows are judged alike; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.functions.storage import materialize, scratch

WINDOW = 5
LEAST_WORDS = 10
MAX_REPEATED = 20  # of 100 words
MAX_FALSE = 0.04
DELTA = 0.05
#: Rules: a document is rejected if 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "long_words": ("word_chars", "n_words"),
}
#: Cutoffs from lenient to strict; the same for all rules, ratios being in thousandths.
CUTOFFS = (50_000, 30_000, 20_000, 15_000, 12_000, 10_000, 9000, 8000, 7000, 6000, 5000, 900, 800, 700, 600, 500, 400, 300, 250, 200, 160, 130, 100, 80, 60, 40, 25, 10)

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, stratum, counts): what the rules need of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).cast("string").alias("stratum"), text.alias("text"))
    filled = F.filter(F.split("text", "\n"), lambda x: _without(x, _SPACE) != "")
    df = df.select(
        "doc_id", "stratum",
        F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "").alias("words"),
        F.length(_without(F.col("text"), _SPACE)).alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), _SYMBOLS))).alias("n_symbols"),
        filled.alias("lines"),
    )
    n = F.size("words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)])
    df = df.select(
        "doc_id", "stratum", n.alias("n_words"), "word_chars", "n_symbols", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform(starts, window).alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("placed", F.when(repeats, placed)).drop("windows")
    # Sorted by hash, a repeated window has an equal one beside it.
    none, rest = F.array(F.lit(None).cast("bigint")), F.size("placed") - 1
    hashes = F.transform("placed", lambda p: p["h"])
    df = df.withColumn("hashes", hashes)
    beside = F.arrays_zip(
        F.col("placed").alias("own"), F.concat(none, F.slice("hashes", 1, rest)).alias("before"), F.concat(F.slice("hashes", 2, rest), none).alias("after")
    )
    again = F.filter(beside, lambda x: (x["own"]["h"] == x["before"]) | (x["own"]["h"] == x["after"]))
    places = F.sort_array(F.transform(again, lambda x: x["own"]["i"]))
    covered = F.aggregate(
        places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines"]
    return df.select("doc_id", "stratum", *[F.col(c).cast("long").alias(c) for c in counts], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEATED)


def _tail(n: Column, k: Column, rate: float) -> Column:
    """Probability that at most ``k`` of ``n`` happen at ``rate``; 1 if ``k`` is above the mean."""
    odds = math.log(rate / (1 - rate))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log(n - i) - F.log(i + 1) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(acc["log"])).alias("sum"))

    start = F.struct((n * math.log(1 - rate)).alias("log"), F.lit(0.0).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k), start, step, lambda acc: acc["sum"])
    return F.when(k > n * rate, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, *, max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """(stratum, a cutoff by rule): the strictest that the good labelled documents allow."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).filter("quality = 1")
    held = measured.filter(~base_failed()).join(good.select("doc_id"), "doc_id")
    grid = F.array(*[F.lit(c).cast("bigint") for c in CUTOFFS])
    level = lambda num, den: F.size(F.filter(grid, lambda c: F.col(num) * 1000 > c * F.col(den)))
    levels = held.select("stratum", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.when(F.col(den) > 0, level(num, den)).otherwise(0).alias("level")) for r, (num, den) in RULES.items()
    ])).alias("x")).groupBy("stratum", "x.rule", "x.level").agg(F.count("*").alias("n"))
    # One row for each cutoff. A document whose ratio is above so many of the last ones is rejected by those.
    per = levels.groupBy("stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("level", "n")).alias("levels"))
    tried = per.select("stratum", "rule", "n", "levels", F.posexplode(grid).alias("at", "cutoff"))
    lost = F.aggregate(
        F.filter("levels", lambda x: x["level"] > len(CUTOFFS) - 1 - F.col("at")), F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]
    )
    tried = tried.withColumn("lost", lost)
    every = Window.partitionBy(F.lit(0))
    lenient = Window.partitionBy("stratum", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    n_strata = F.size(F.collect_set(F.coalesce(F.concat(F.lit("="), F.col("stratum").cast("string")), F.lit(""))).over(every))  # null is a stratum, and not the empty one
    level_of_test = F.lit(delta) / (n_strata * len(RULES))
    tested = tried.withColumn("p", _tail(F.col("n"), F.col("lost"), max_false / len(RULES))).withColumn("most", level_of_test)
    taken = tested.withColumn("taken", F.min((F.col("p") <= F.col("most")).cast("int")).over(lenient)).filter("taken = 1")
    least = [F.min(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cutoff_{r}") for r in RULES]
    return taken.groupBy("stratum").agg(*least)


def judge(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang",
          max_false: float = MAX_FALSE, delta: float = DELTA) -> DataFrame:
    """Counts, ``base_failed``, ``failed_rules`` and ``kept`` of each document."""
    path = scratch(docs.sparkSession, "quality")
    measured = materialize(measures(docs, id_col=id_col, text_col=text_col, stratum_col=stratum_col), f"{path}/measures")
    chosen = materialize(cutoffs(measured, labels, max_false=max_false, delta=delta), f"{path}/cutoffs")
    joined = measured.join(chosen.withColumnRenamed("stratum", "_of"), F.col("stratum").eqNullSafe(F.col("_of")), "left")
    failed = F.array_compact(F.array(*[
        F.when((F.col(den) > 0) & (F.col(num) * 1000 > F.col(f"cutoff_{r}") * F.col(den)), F.lit(r)) for r, (num, den) in RULES.items()
    ]))
    judged = joined.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("_of")
