"""Comments of source files in twenty families of languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.catalog.languages import (
    EXCLUDED_DIRS,
    LANGUAGES,
    Language,
    block_markers,
    line_markers,
    token,
)
from pagesieve.functions.regex import lookup, quoted
from pagesieve.functions.scan import scan
from pagesieve.functions.totals import size
from pagesieve.functions.text import basename, count_newlines, slug, strip, suffix

COLUMNS = ["path", "language", "line_start", "line_end", "text", "type", "offset"]


def _keys(marks: str) -> dict[str, str]:
    """Lower-cased file names or extensions -> language key; of two languages the first counts."""
    out: dict[str, str] = {}
    for lang in LANGUAGES:
        for mark in getattr(lang, marks):
            out.setdefault(mark.lower(), lang.key)
    return out


def _constant(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def detect_language(corpus: DataFrame, *, path: str = "path") -> DataFrame:
    """Add ``lang_key`` and ``language``: exact file name first, then last extension, else null."""
    name = F.lower(basename(F.col(path)))
    by_name = F.try_element_at(_constant(_keys("filenames")), name)
    key = F.coalesce(by_name, F.try_element_at(_constant(_keys("extensions")), suffix(name)))
    titles = _constant({lang.key: lang.name for lang in LANGUAGES})
    return corpus.withColumn("lang_key", key).withColumn("language", F.try_element_at(titles, F.col("lang_key")))


def _marks(lang: Language) -> dict[str, object]:
    """Comment markers of ``lang``, longest first: start, end (empty for line comments)."""
    pairs = [*block_markers(lang), *[(m, "") for m in line_markers(lang)]]
    marks = ", ".join(f"named_struct('start', {quoted(s)}, 'end', {quoted(e)})" for s, e in pairs)
    return {"name": lang.name, "marks": _Sql(f"array({marks})")}


class _Sql(str):
    """SQL text that is not a string value."""


def comments(
    corpus: DataFrame,
    *,
    path: str = "path",
    text: str = "content",
    languages: list[str] | None = None,
    min_length: int = 0,
) -> DataFrame:
    """Every comment with its lines; files of unknown language give none.  No shuffle."""
    docs = corpus.select(F.col(path).alias("path"), F.col(text).alias("_text"))
    docs = detect_language(docs).filter(F.col("lang_key").isNotNull())
    if languages is not None:
        docs = docs.filter(F.col("lang_key").isin(languages))
    keys = F.create_map(*[F.lit(x) for i, lang in enumerate(LANGUAGES) for x in (lang.key, i)])
    pick = F.array(F.try_element_at(keys, F.col("lang_key")))
    found = scan(docs, "_text", [token(lang) for lang in LANGUAGES], pick=pick, keep=["path", "language"])
    found = found.withColumn("_lang", lookup("rx", [_marks(lang) for lang in LANGUAGES]))
    # the marker a token starts with; strings start with none and drop out
    found = found.withColumn("_mark", F.expr("get(filter(_lang.marks, x -> startswith(hit, x.start)), 0)"))
    found = found.filter("_mark IS NOT NULL")
    hit, opened = F.col("hit"), F.length("_mark.start")
    block = F.col("_mark.end") != ""
    closed = block & F.endswith(hit, F.col("_mark.end")) & (F.length(hit) >= opened + F.length("_mark.end"))
    ended = F.when(block, closed).otherwise(F.endswith(hit, F.lit("\n")))
    # a comment cut off by the end of the text counts only if it holds anything
    found = found.filter(ended | (F.length(hit) > opened))
    close = F.when(closed, F.length("_mark.end")).otherwise(0)
    body = F.substring(hit, opened + 1, F.length(hit) - opened - close)
    out = found.select(
        "path", "language", F.col("line").alias("line_start"),
        (F.col("line") + F.when(block, count_newlines(hit)).otherwise(0)).alias("line_end"),
        strip(body).alias("text"), F.when(block, "block").otherwise("line").alias("type"),
        F.col("off").alias("offset"),
    )
    return out.filter(F.length("text") >= min_length) if min_length > 0 else out


def select_paths(
    corpus: DataFrame,
    *,
    path: str = "path",
    extensions: list[str] | None = None,
    exclude_dirs: list[str] | None = None,
) -> DataFrame:
    """Files of the given extensions or names, outside the excluded folders."""
    dirs = EXCLUDED_DIRS if exclude_dirs is None else exclude_dirs
    out = corpus
    if dirs:
        folders = F.slice(F.split(F.col(path), "/"), 1, F.greatest(F.size(F.split(F.col(path), "/")) - 1, F.lit(0)))
        out = out.filter(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dirs])))
    if extensions:
        wanted = [e.strip().lower() for e in extensions]
        name = F.lower(basename(F.col(path)))
        out = out.filter(suffix(name).isin(wanted) | name.isin(wanted))
    return out


def stats(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row: files scanned, files with comments, comments."""
    per_file = found.groupBy("path").agg(F.count("*").alias("n"))
    hits = per_file.select(F.lit(0).alias("scanned"), F.lit(1).alias("files"), F.col("n").alias("comments"))
    scanned = size(corpus).select(F.col("n").alias("scanned"), F.lit(0).alias("files"), F.lit(0).alias("comments"))
    return scanned.unionByName(hits).agg(
        F.sum("scanned").alias("files_scanned"), F.sum("files").alias("files_with_comments"),
        F.sum("comments").alias("total_comments"),
    )


def by_language(found: DataFrame) -> DataFrame:
    """Files and comments per language, most comments first."""
    per_file = found.groupBy("language", "path").agg(F.count("*").alias("n"))
    per_language = per_file.groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("comments"))
    return per_language.orderBy(F.desc("comments"), "language")


def per_file(found: DataFrame) -> DataFrame:
    """Comments of each file as an ordered array.

    ``path`` is the key of the corpus, so a group is no larger than one document.
    """
    packed = F.struct("offset", "line_start", "line_end", "text", "type")
    grouped = found.groupBy("path", "language").agg(F.array_sort(F.collect_list(packed)).alias("comments"))
    return grouped.select("path", "language", F.size("comments").alias("comment_count"), "comments")


def language_slug(language: Column) -> Column:
    """Language name as part of a file name."""
    return slug(language)

