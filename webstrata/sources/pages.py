"""Page sources: parquet tables and dumps of HTML files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_SCHEMA = "page_id bigint, url string, html string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, html)`` from parquet; unused columns are never read."""
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def read_html_files(spark: SparkSession, path: str, pattern: str = "*.html") -> DataFrame:
    """One page per UTF-8 text file below ``path``; the file path stands in for the URL."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    url = F.col("_metadata.file_path")
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


# Labels of character sets by what Spark decodes them with; the rest is read as the default.
_CHARSETS = {
    "UTF-8": ["utf-8", "utf8", "unicode-1-1-utf-8"],
    "ISO-8859-1": ["iso-8859-1", "iso8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii"],
    "UTF-16LE": ["utf-16", "utf-16le"],
    "UTF-16BE": ["utf-16be"],
}
_META = r"""(?is)<meta[^>]*?charset\s*=\s*["']?\s*([a-z0-9_:.-]+)"""
# Where the Windows code page differs from Latin-1.
_WINDOWS = {k: c for k in range(128, 160) if (c := bytes([k]).decode("cp1252", "replace")) != "\ufffd"}


def decoded(content: Column, charset: str = "UTF-8") -> Column:
    """Text of raw HTML: by byte order mark, else by the ``<meta charset>`` of the first 1024 bytes, else ``charset``.

    Latin-1 is read as the Windows code page, as browsers do.
    """
    mark = F.hex(F.substring(content, 1, 3))
    label = F.lower(F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), _META, 1))
    after = lambda n: F.substring(content, F.lit(n + 1), F.length(content))
    text = (
        F.when(mark == "EFBBBF", F.decode(after(3), "UTF-8"))
        .when(mark.startswith("FEFF"), F.decode(after(2), "UTF-16BE"))
        .when(mark.startswith("FFFE"), F.decode(after(2), "UTF-16LE"))
    )
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, _WINDOWS)), "".join(_WINDOWS.values()))
    for name, labels in _CHARSETS.items():
        if not name.startswith("UTF-16"):  # a page whose meta tag could be read byte by byte is not UTF-16
            text = text.when(label.isin(labels), latin if name == "ISO-8859-1" else F.decode(content, name))
    known = next((n for n, labels in _CHARSETS.items() if charset.lower() in labels), charset)
    return text.otherwise(latin if known == "ISO-8859-1" else F.decode(content, known))


def read_html_bytes(
    spark: SparkSession, path: str, pattern: str = "*.html", charset: str = "UTF-8"
) -> DataFrame:
    """One page per binary file; the character set is found per file, ``charset`` where nothing tells it."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return files.select(
        F.xxhash64("path").alias("page_id"), F.col("path").alias("url"), decoded(F.col("content"), charset).alias("html")
    )
