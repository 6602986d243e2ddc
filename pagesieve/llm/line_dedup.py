"""Removal of repeated lines by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct lower-cased words. A line with tokens is removed if an
earlier line (by ``doc_id``, then by place) has a Jaccard similarity of at least 0.8 to it.

* Equal token sets are reduced to their first line before anything is joined.
* Tokens are ordered by rarity, rare first. Rarity is the number of lines that have a token of the hash
  bucket, in all documents; there are ``BUCKETS`` of them whatever the input, so the table is a constant of the plan. Any common order
  gives the same result; this one keeps the join small.
* Prefix filter: similar sets of n tokens share one of their n - ceil(0.8 n) + 1 first ones.
  Of two sets the smaller, of n tokens, needs but the first n - ceil(8/9 n) + 1, as they share 4/9 of both sizes.
  Length filter: the smaller has at least 0.8 times the tokens of the larger. Positional filter: what
  follows the shared token must suffice for the overlap that 0.8 asks for. 128 bits of each set, 256 of a large one,
  say for some of its tokens each whether their number is odd, and
  rule out pairs that differ in more bits than they may in tokens (odd numbers, as long lines have some of each).
* Before all pairs each set meets one earlier set, and goes if they are similar. Of those about as large that share one of
  ``LEADS`` prefix tokens, it is the first or the next before it, whichever differs in the fewest bits. So a group of near
  copies costs a comparison for each, not for each pair. What stays is then compared with all earlier sets that the
  filters leave, also with those that went: first, of those that a part of the
  tokens leads to, with the one that differs in the fewest bits; what goes by this takes no part in the other passes.
* The texts of the lines in candidate pairs are read again, and their token sets compared in full.

Token sets and tokens are known by hashes of 128 and 56 bits.

Defined cases: lines without a word are kept; a null or empty text stays as it is; rows with one
``doc_id``, or without, are documents of their own if their texts differ, by a hash of the text; equal ones are treated
alike; an empty table gives no row; other columns are kept as they are, but ``n_lines`` and ``n_removed`` of the input are replaced;
long texts are split into lines like others, and a long line is one set of tokens.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagesieve.functions.storage import scratch
from pagesieve.llm.stages import settings, written

BUCKETS = 1 << 16
#: Similarity as a fraction of whole numbers, so that comparisons are exact.
NUMERATOR, DENOMINATOR = 4, 5
#: Steps in which prefix tokens are joined, so that only a part of their shuffle files exists at a time.
PASSES = 2
#: Prefix tokens by which a set meets one earlier set; those of the least numbers, so that near copies mostly have the same.
LEADS = 2
#: Columns of a set's bits; the last two are zero for sets of at most ``LARGE`` tokens.
WORDS = ["w0", "w1", "w2", "w3"]
LARGE = 160


_SPACE = "\t\x0b\x0c\r"


def _plain(text: Column) -> Column:
    """Lower-cased, with the space as only white space within lines."""
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), _SPACE, F.lower(text))  # several times as fast as translate


def row_key(id_col: str, text_col: str) -> Column:
    """What tells documents apart, and orders them."""
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))


def tokens_of(line: Column) -> Column:
    """Hashes of the distinct words of a plain line."""
    hashes = F.transform(F.split(line, " "), lambda w: F.xxhash64(w))
    return F.array_distinct(F.array_remove(hashes, F.xxhash64(F.lit(""))))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, tokens) of lines that have a word."""
    lines = docs.select(F.col(id_col).alias("doc"), F.posexplode(F.split(_plain(F.col(text_col)), "\n")).alias("line_no", "line"))
    lines = lines.filter(F.trim("line") != "")  # a filter on the tokens would make them twice
    return lines.select("doc", "line_no", tokens_of(F.col("line")).alias("tokens"))


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity_classes(lines: DataFrame) -> list[int]:
    """For each bucket of token hashes a small number that grows with the lines that have its tokens."""
    seen = lines.select(F.explode("tokens").alias("t")).groupBy(_bucket(F.col("t")).alias("b")).count()
    table = [0] * BUCKETS
    for r in seen.collect():  # at most BUCKETS rows
        table[r["b"]] = 1 + min(93, int(2 * math.log2(r["count"])))
    return table


def _ranked(table: list[int]) -> Column:
    """Tokens as longs, rare first: seven bits of rarity above 56 bits of hash."""
    classes = F.from_json(F.lit(json.dumps(table, separators=(",", ":"))), "array<bigint>")  # folded to a constant; of small numbers, as plans are kept as texts
    rarity = lambda h: F.coalesce(F.get(classes, _bucket(h)), F.lit(0).cast("bigint"))  # noqa: E731  # never null, so that longs are sorted as such
    return F.sort_array(F.transform("tokens", lambda h: F.shiftleft(rarity(h), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def _words(tokens: Column) -> list[Column]:
    """Words whose bits say whether the number of some tokens is odd: of all tokens, of two halves, and of the quarter in both.

    ``_differ`` has 256 bits of them, one for each token, or 128 of the first two; sets differ in at least as many tokens as
    such bits differ. The last two words are left out for sets that are not large.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    at = lambda t: t.bitwiseAND(F.lit(63)).cast("int")
    flag = lambda t, j: F.shiftright(t, j).bitwiseAND(one)

    def odd(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(tokens, none, lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", of(t), at(t))))

    large = lambda c: F.when(F.size(tokens) > LARGE, c).otherwise(none)
    third, fourth = odd(lambda t: flag(t, 7)), odd(lambda t: flag(t, 6).bitwiseAND(flag(t, 7)))
    words = odd(lambda t: one), odd(lambda t: flag(t, 6)), large(third), large(fourth)
    return [c.alias(w) for c, w in zip(words, WORDS)]


def _needed(n: Column) -> Column:
    """The least number of tokens that a set similar to one of ``n`` shares with it."""
    return F.floor((n * NUMERATOR + DENOMINATOR - 1) / DENOMINATOR).cast("int")


def _pruned_scans(spark: SparkSession):
    """Let joins with a small side drop rows of the large side while it is read."""
    return settings(
        spark, spark__sql__optimizer__runtime__bloomFilter__enabled="true",
        spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="1",
        spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="64m",
    )


def _differ(a: str, b: str, words: list[str]) -> Column:
    """In how many bits two sets differ: of 256 if both are large and all words are given, else of 128."""
    every, half, *others = (F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}")) for w in words)
    count = lambda *ws: sum(map(F.bit_count, ws))
    few = count(every.bitwiseXOR(half), half)
    if not others:
        return few
    third, both = others
    all_bits = count(both, half.bitwiseXOR(both), third.bitwiseXOR(both), every.bitwiseXOR(half).bitwiseXOR(third).bitwiseXOR(both))
    return F.when((F.col(f"{a}.n") > LARGE) & (F.col(f"{b}.n") > LARGE), all_bits).otherwise(few)


def _may_be_similar(a: str, b: str, words: list[str]) -> Column:
    """Length filter and bits of two sets."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * DENOMINATOR >= F.greatest(n, m) * NUMERATOR) & (_differ(a, b, words) * (NUMERATOR + DENOMINATOR) <= (n + m) * (DENOMINATOR - NUMERATOR))


def _in_passes(make: Callable[[int], DataFrame], path: str) -> DataFrame:
    """The union of the ``PASSES`` steps from the second on, each written and its shuffle files gone before the next."""
    return reduce(DataFrame.unionByName, [written(make(k), f"{path}-{k}") for k in range(1, PASSES)])


def _band(n: Column) -> Column:
    """Sizes by powers of 1.25: of two similar sets the larger is in the band of the smaller or in the next."""
    return F.floor(F.log(n) / math.log(DENOMINATOR / NUMERATOR)).cast("bigint")


def _banded(band: Column, token: Column) -> Column:
    return F.shiftleft(band, 32).bitwiseOR(token.cast("bigint"))


def _first_met(sets: DataFrame) -> DataFrame:
    """(later, earlier): sets with one earlier set about as large that shares a prefix token, the likeliest of a few."""
    leads = F.transform(F.slice(F.sort_array("prefix"), 1, LEADS), lambda t: _banded(F.col("band"), t))
    words = WORDS[:2]
    rows = sets.filter("n > 3").withColumn("band", _band(F.col("n"))).select(F.explode(leads).alias("key"), "id", "n", *words)
    order, this = Window.partitionBy("key").orderBy("id"), F.struct("id", "n", *words)
    met = rows.withColumns({"a": F.lag(this).over(order), "c": F.first(this).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    met = met.filter(F.col("a").isNotNull()).select(this.alias("b"), F.explode(F.array("a", "c")).alias("a"))
    differ = _differ("a", "b", words) / (F.col("a.n") + F.col("b.n"))
    likely = met.filter(_may_be_similar("a", "b", words)).groupBy(F.col("b.id").alias("later"))
    return likely.agg(F.min(F.struct(differ.alias("differ"), F.col("a.id").alias("earlier"))).alias("best")).select("later", "best.earlier")


def _without(left: DataFrame, gone: DataFrame) -> DataFrame:
    flags = gone.select(F.col("later").alias("id"), F.lit(True).alias("now"))
    return left.join(flags.hint("shuffle_hash"), "id", "left").withColumn("gone", F.col("gone") | F.coalesce("now", F.lit(False))).drop("now")


def _all_met(left: DataFrame, k: int) -> DataFrame:
    """(later, earlier, differ): sets that are not gone with all earlier ones that no filter rules out, by the tokens of pass ``k``."""
    prefixes = left.select("id", "n", *WORDS, "gone", _band(F.col("n")).alias("band"), F.posexplode("prefix").alias("at", "token")).filter(F.col("token") % PASSES == k)
    # The most tokens of another set with which what follows the shared token suffices.
    most = F.floor(((F.col("n") - F.col("at")) * (NUMERATOR + DENOMINATOR) - F.col("n") * NUMERATOR) / NUMERATOR).cast("int")
    prefixes = prefixes.withColumn("most", most)
    columns = ["id", "n", "most", "gone", *WORDS]
    # The smaller of two sets is sought, by its first tokens, in the bands that the larger may be in.
    small = prefixes.filter("most >= n").select(F.explode(F.sequence("band", _band(F.col("most")))).alias("band"), "token", *columns)
    small, large = (df.select(_banded(F.col("band"), F.col("token")).alias("key"), *columns) for df in (small, prefixes))
    n, m, x, y = F.col("a.n"), F.col("b.n"), F.col("a.id"), F.col("b.id")
    once = (n < m) | ((n == m) & (x < y))
    enough = (m <= F.col("a.most")) & (n <= F.col("b.most"))
    later_stays = ~F.when(x < y, F.col("b.gone")).otherwise(F.col("a.gone"))
    likely = (F.col("a.key") == F.col("b.key")) & once & enough & later_stays & _may_be_similar("a", "b", WORDS)
    differ = _differ("a", "b", WORDS) / (n + m)
    return small.alias("a").join(large.alias("b"), likely).select(F.greatest(x, y).alias("later"), F.least(x, y).alias("earlier"), differ.alias("differ")).distinct()


def _tokens(docs: DataFrame, sets: DataFrame, pairs: DataFrame, rank: Column, path: str) -> DataFrame:
    """(id, tokens) of the sets in pairs, read again; ``docs`` has ``doc`` and ``text``."""
    ids = pairs.select(F.explode(F.array("later", "earlier")).alias("id")).distinct()
    wanted = sets.join(ids.hint("shuffle_hash"), "id").groupBy("doc").agg(F.collect_list(F.struct("line_no", "id", "h1")).alias("wanted"))
    wanted = written(wanted, f"{path}-wanted").filter(F.size("wanted") > 0)
    with _pruned_scans(docs.sparkSession):
        # The one-element generate has each text split once, not for each of its lines.
        texts = docs.join(wanted, "doc").select("wanted", F.explode(F.array(F.split(F.col("text"), "\n"))).alias("lines"))
        texts = texts.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["h1"].alias("h1"), F.get("lines", w["line_no"]).alias("line")))).alias("x"))
        # A line of another text with the document's key is told by its hash.
        tokens = texts.select("x.id", "x.h1", F.explode(F.array(tokens_of(_plain(F.col("x.line"))))).alias("tokens"))
        ranked = tokens.select("id", "h1", F.explode(F.array(rank)).alias("tokens"))
        return written(ranked.filter(F.xxhash64("tokens") == F.col("h1")).drop("h1"), f"{path}-tokens")


def _similar(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """The later sets of pairs that are similar."""
    left = tokens.select(F.col("id").alias("earlier"), F.col("tokens").alias("ta"))
    right = tokens.select(F.col("id").alias("later"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))  # named once, as each mention is computed
    enough = both * (NUMERATOR + DENOMINATOR) >= (F.size("ta") + F.size("tb")) * NUMERATOR
    return pairs.join(left, "earlier").join(right, "later").filter(enough).select("later").distinct()


def kept_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, lines): the places of the lines with words that stay, for each document (``row_key``) that has some."""
    path = scratch(docs.sparkSession, "lines")
    docs = docs.select(row_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    # Texts are split into words once: the hashes stay on the executors' disks until the sets are written.
    lines = lines_of(docs, "doc", "text").persist(StorageLevel.DISK_ONLY)
    rank = _ranked(rarity_classes(lines))
    n = F.size("k")
    prefix = F.transform(F.slice("k", 1, n - _needed(n) + 1), lambda t: t.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))  # low bits of the hash
    ranked = lines.select("doc", "line_no", rank.alias("k")).select(
        F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2"),
        F.struct("doc", "line_no", n.alias("n"), prefix.alias("prefix"), *_words(F.col("k"))).alias("line"),
    )
    first = ranked.groupBy("h1", "h2").agg(F.min("line").alias("line"))
    # In order of place, so that of two sets the one with the lesser number is the earlier.
    numbered = first.orderBy("line.doc.id", "line.doc.hash", "line.line_no").select(F.monotonically_increasing_id().alias("id"), "h1", "line.*")
    sets = written(numbered, f"{path}/sets")
    lines.unpersist(blocking=True)
    # One similar earlier set is enough: near copies go with one that is likely, and only what that leaves is compared with all.
    pairs = written(_first_met(sets), f"{path}/first/pairs")
    gone = written(_similar(pairs, _tokens(docs, sets, pairs, rank, f"{path}/first/texts")), f"{path}/gone")
    left = _without(sets.filter("n > 3").select("id", "n", *WORDS, "prefix", F.lit(False).alias("gone")), gone)  # smaller sets must be equal
    some = written(_all_met(left, 0), f"{path}/some")
    likely = some.groupBy("later").agg(F.min(F.struct("differ", "earlier")).alias("best")).select("later", "best.earlier")
    likely = written(likely, f"{path}/likely/pairs")
    settled = written(_similar(likely, _tokens(docs, sets, likely, rank, f"{path}/likely/texts")), f"{path}/settled")
    more = _in_passes(lambda k: _all_met(_without(left, settled), k), f"{path}/all/met")
    pairs = some.join(settled, "later", "left_anti").unionByName(more).select("later", "earlier").distinct()
    pairs = written(pairs, f"{path}/all/pairs")
    others = written(_similar(pairs, _tokens(docs, sets, pairs, rank, f"{path}/all/texts")), f"{path}/others")
    gone = gone.unionByName(settled).unionByName(others)
    stay = sets.select("id", "doc", "line_no").join(gone.withColumnRenamed("later", "id").hint("shuffle_hash"), "id", "left_anti")
    return written(stay.groupBy("doc").agg(F.collect_set("line_no").alias("lines")), f"{path}/kept")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with later matches taken out of their texts, and two more columns.

    ``n_lines`` counts the lines of the text, ``n_removed`` those taken out.
    """
    kept = kept_lines(docs, id_col=id_col, text_col=text_col)
    tag = "_" * (1 + max(map(len, docs.columns)))  # longer than any name, so that none clashes
    kept_doc, kept_lines_, lines, places = (tag + x for x in ("doc", "kept", "lines", "places"))
    joined = docs.join(kept.select(F.col("doc").alias(kept_doc), F.col("lines").alias(kept_lines_)), row_key(id_col, text_col) == F.col(kept_doc), "left")
    joined = joined.withColumn(lines, F.split(F.col(text_col), "\n"))
    blank = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~F.get(lines, i).rlike(r"[^\x20\x09-\x0D]"))
    wanted = F.sort_array(F.array_union(blank, F.coalesce(kept_lines_, F.array().cast("array<int>"))))
    joined = joined.withColumn(places, F.when(F.col(text_col).isNotNull(), F.filter(wanted, lambda i: i < F.size(lines))))
    text = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines))
    out = {text_col: F.coalesce(text, F.col(text_col))}
    columns = [out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return joined.select(*columns, n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size(places), F.lit(0))).alias("n_removed"))
