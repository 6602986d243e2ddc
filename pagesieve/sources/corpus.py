"""Readers that turn stored crawls, folders and source maps into ``corpus(path, content, kind)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.catalog.languages import EXCLUDED_DIRS, LANGUAGES
from pagesieve.functions.text import basename, strip, suffix

# Extensions and folders left out by each kind of scan, bytes looked at for a NUL.
SCAN_DEFAULTS = {
    "endpoints": (
        [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".html", ".htm"],
        ["node_modules", ".git", "__pycache__", ".svn", ".idea", ".vscode"],
    ),
    "items": ([".js", ".mjs", ".cjs", ".jsx", ".ts", ".tsx", ".vue", ".svelte"], []),
    "findings": ([".js", ".mjs", ".cjs", ".jsx"], ["node_modules", ".git", "dist", "build"]),
    "comments": ([e for language in LANGUAGES for e in language.extensions], EXCLUDED_DIRS),
}
SOURCE_MAP = ".js.map"
BINARY_PROBE = 8192


def pages_corpus(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """A crawl table as a corpus."""
    return pages.select(F.col(url).alias("path"), F.col(html).alias("content"), F.lit("html").alias("kind"))


def text_corpus(df: DataFrame, path: Column, content: Column, kind: str = "text") -> DataFrame:
    """Any text column as a corpus."""
    return df.select(path.alias("path"), content.alias("content"), F.lit(kind).alias("kind"))


def is_binary(raw: Column) -> Column:
    """A NUL among the first bytes."""
    return F.contains(F.substring(raw, 1, BINARY_PROBE), F.lit(bytearray(b"\x00")))


def decode_text(df: DataFrame, *, raw: str = "raw", out: str = "content", newlines: bool = False) -> DataFrame:
    """Decode bytes as UTF-8, else as Latin-1; binary rows are dropped.

    ``newlines`` turns every line ending into ``\\n``.
    """
    src = F.col(raw)
    latin = F.decode(src, "ISO-8859-1")
    text = F.when(F.is_valid_utf8(src.cast("string")), src.cast("string")).otherwise(latin)
    if newlines:
        text = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return df.filter(~is_binary(src)).withColumn(out, text).drop(raw)


def path_filter(
    df: DataFrame, extensions: list[str] | None, skipped_dirs: list[str], *, path: str | Column = "path", root: str = "",
    more: Column | None = None,
) -> DataFrame:
    """Keep files by extension (or by ``more``) and drop those under a skipped folder at any depth below ``root``."""
    where = F.col(path) if isinstance(path, str) else path
    below = F.substring(where, F.locate(root, where) + len(root), F.length(where)) if root else where
    name = F.lower(basename(where))
    out = df
    if extensions:
        wanted = suffix(name).isin([e.lower() if e.startswith(".") else f".{e.lower()}" for e in extensions])
        out = out.filter(wanted if more is None else wanted | more)
    for d in skipped_dirs:
        out = out.filter(~F.contains(F.concat(F.lit("/"), below), F.lit(f"/{d}/")))
    return out


def _root_path(spark: SparkSession, folder: str) -> str:
    """The path of ``folder`` as file metadata spell it, without scheme and host."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri().getRawPath()


def scan_files(
    spark: SparkSession,
    folder: str,
    *,
    purpose: str = "findings",
    extensions: list[str] | None = None,
    extra_extensions: list[str] | None = None,
    skipped_dirs: list[str] | None = None,
    recursive: bool = True,
    glob: str | None = None,
    newlines: bool = True,
    kind: str = "js",
    source_maps: bool | None = None,
) -> DataFrame:
    """Text files of a folder as a corpus, read by the cluster; the listing stays in Spark.

    ``purpose`` names the defaults for extensions and skipped folders.  Paths are tested on the
    files' metadata, so files that are left out are never opened.  ``source_maps`` (by default for
    items) also reads ``.js.map`` files and puts the sources they hold in their place.
    """
    wanted, skipped = SCAN_DEFAULTS[purpose]
    extensions = [*(extensions or wanted), *(extra_extensions or [])]
    skipped_dirs = skipped if skipped_dirs is None else skipped_dirs
    source_maps = purpose == "items" if source_maps is None else source_maps
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    where = F.col("_metadata.file_path")
    more = F.lower(where).endswith(SOURCE_MAP) if source_maps else None
    files = path_filter(reader.load(folder), extensions, skipped_dirs, path=where, root=_root_path(spark, folder), more=more)
    text = decode_text(files.select("path", F.col("content").alias("raw")), newlines=newlines)
    if source_maps:
        own = F.array(F.struct(F.col("path"), F.col("content")))
        held = F.when(F.lower("path").endswith(SOURCE_MAP), _held_sources(F.col("path"), F.col("content"))).otherwise(own)
        text = text.select(F.inline(held))
    return text.select("path", "content", F.lit(kind).alias("kind"))


def _held_sources(path: Column, content: Column) -> Column:
    """(path, content) of the sources in a source map."""
    parsed = F.from_json(content, "struct<sources:array<string>,sourcesContent:array<string>>")
    pairs = F.filter(F.arrays_zip(parsed["sources"].alias("s"), parsed["sourcesContent"].alias("c")), lambda p: (p["c"] != "") & p["s"].isNotNull())
    return F.transform(pairs, lambda p: F.struct(F.concat(path, F.lit(" -> "), p["s"]).alias("path"), p["c"].alias("content")))


def list_source(lines: DataFrame, *, value: str = "value", remarks: bool = True) -> DataFrame:
    """One value per line: trimmed, blank lines dropped, ``#`` remarks too unless kept."""
    v = strip(F.col(value))
    out = lines.select(v.alias("value")).filter(F.col("value") != "")
    return out.filter(~F.startswith(F.col("value"), F.lit("#"))) if remarks else out


def read_list(spark: SparkSession, path: str, *, remarks: bool = True) -> DataFrame:
    return list_source(spark.read.text(path), remarks=remarks)


def explode_source_maps(maps: DataFrame, *, path: str = "path", content: str = "content") -> DataFrame:
    """Original sources held in source maps; unreadable maps and empty sources give nothing."""
    schema = "struct<sources:array<string>,sourcesContent:array<string>>"
    parsed = F.from_json(F.col(content), schema)
    pairs = F.arrays_zip(parsed["sources"].alias("s"), parsed["sourcesContent"].alias("c"))
    rows = maps.select(F.col(path).alias("_map"), F.posexplode_outer(pairs).alias("position", "_p"))
    rows = rows.filter((F.col("_p.c") != "") & F.col("_p.s").isNotNull())
    return rows.select(
        F.concat(F.col("_map"), F.lit(" -> "), F.col("_p.s")).alias("path"),
        F.col("_p.c").alias("content"), F.lit("js").alias("kind"),
    )


def parse_response_log(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """Distinct log lines of at least three fields: url, status, length, and the hash if any."""
    distinct = lines.select(F.col(value).alias("_line")).distinct()
    rows = distinct.select(F.split(strip(F.col("_line")), r"(?U)\s+").alias("_f")).filter(F.size("_f") >= 3)
    return rows.select(*[F.get("_f", F.lit(k)).alias(n) for k, n in enumerate(["url", "status", "length", "hash"])])
