"""Wordlists: uploads, import with counters, and the lexicon builder."""

from __future__ import annotations

import base64
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from guildward import config
from guildward.functions import text

#: The folder's excluded file, and what a line with an address looks like.
EXCLUDED_FILES = ("非法网址.txt",)
COLLATION = "zh_Hans"
URL = r"(?i)(?:https?://|www\.)|(?:[a-z0-9-]+\.)+(?:com|cn|net|org|cc|top|xyz|vip|club|site|info|me|io|tk)(?:[/:?#]|$)"


def decode_upload(encoded: str) -> str:
    """The text of a base64 upload; ValueError if it is too large or not strictly UTF-8."""
    data = base64.b64decode(encoded, validate=True)
    if len(data) > config.WORDLIST_BYTES:
        raise ValueError(f"a wordlist may have {config.WORDLIST_BYTES} bytes")
    return data.decode("utf-8")


def lines(texts: DataFrame, column: str = "text", by: list[str] | None = None) -> DataFrame:
    """(by..., line_no, line): lines of whole texts, without the byte order mark."""
    body = F.regexp_replace(F.col(column), "^\\uFEFF", "")
    return texts.select(*(by or []), F.posexplode(F.split(body, "\\r?\\n", -1)).alias("line_no", "line"))


def check_text(content: str) -> None:
    """ValueError if a wordlist text is over the import's limits."""
    if len(content.encode()) > config.WORDLIST_BYTES:
        raise ValueError(f"a wordlist may have {config.WORDLIST_BYTES} bytes")
    if content.count("\n") + 1 > config.WORDLIST_LINES:
        raise ValueError(f"a wordlist may have {config.WORDLIST_LINES} lines")


def classified(numbered: DataFrame) -> DataFrame:
    """Lines (line_no, line) that hold a pattern, with n (normal form) and state: new, duplicate or invalid."""
    df = numbered.withColumn("pattern", text.trim(F.col("line"))).where("pattern <> '' and not startswith(pattern, '#')")
    df = df.withColumn("n", text.normalize(F.col("pattern")))
    valid = (F.char_length("pattern") <= config.WORDLIST_PATTERN) & (F.col("n") != "")
    first = F.row_number().over(Window.partitionBy("n", valid).orderBy("line_no")) == 1
    state = F.when(~valid, "invalid").when(first, "new").otherwise("duplicate")
    return df.withColumn("state", state).select("line_no", "pattern", "n", "state")


def patterns(numbered: DataFrame) -> DataFrame:
    """(line_no, pattern): the first line of each normal form."""
    return classified(numbered).where("state = 'new'").select("line_no", "pattern")


def counters(numbered: DataFrame) -> DataFrame:
    """One row: read_count, pattern_count, duplicate_count, invalid_count."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    return classified(numbered).agg(
        F.count("*").alias("read_count"), is_("new").alias("pattern_count"), is_("duplicate").alias("duplicate_count"), is_("invalid").alias("invalid_count")
    )


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the .txt files of a folder, whole."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return df.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def lexicon_lines(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_FILES) -> DataFrame:
    """Lines of all files but the excluded, with state: skipped, url, short, duplicate or new, and n."""
    df = lines(files.where(~F.col("file").isin(*excluded)), "text", ["file"]).withColumn("line", text.trim(F.col("line")))
    skip = (F.col("line") == "") | F.col("line").startswith("#") | F.col("line").startswith("//") | F.col("line").startswith("```") | (F.col("line") == "---")
    df = df.withColumn("n", text.normalize(F.col("line"), word_joiner=False))
    kind = F.when(skip, "skipped").when(F.col("line").rlike(URL), "url").when(F.char_length("n") < 2, "short").otherwise("word")
    df = df.withColumn("kind", kind)
    # only words need an order among equals: other lines, of which many are alike, don't enter the window
    words = df.where("kind = 'word'")
    first = F.row_number().over(Window.partitionBy("n").orderBy("file", "line_no")) == 1
    words = words.withColumn("state", F.when(first, "new").otherwise("duplicate"))
    return words.unionByName(df.where("kind <> 'word'").withColumn("state", F.col("kind"))).drop("kind")


def lexicon(files: DataFrame) -> DataFrame:
    """(word): distinct normal forms, sorted as Chinese is: by sound, Latin letters last."""
    return lexicon_lines(files).where("state = 'new'").select(F.col("n").alias("word")).orderBy(F.collate("word", COLLATION), "word")


def lexicon_stats(files: DataFrame, excluded: tuple[str, ...] = EXCLUDED_FILES) -> DataFrame:
    """One row of counters over files and lines."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    of_lines = lexicon_lines(files, excluded).agg(
        F.count("*").alias("source_lines"), is_("skipped").alias("skipped_lines"), is_("url").alias("skipped_urls"),
        is_("short").alias("skipped_short"), is_("duplicate").alias("duplicate_lines"), is_("new").alias("output_words"),
        F.coalesce(F.sum(F.when(F.col("state") == "new", F.octet_length("n") + 1)), F.lit(0)).alias("output_bytes"),
    )
    gone = F.col("file").isin(*excluded)
    of_files = files.agg(F.count_if(~gone).alias("source_files"), F.count_if(gone).alias("skipped_files"))
    one = F.lit(1).alias("_one")
    return of_lines.select("*", one).join(of_files.select("*", one), "_one").drop("_one")


def progress(total: int) -> list[tuple[int, int, str]]:
    """(rows done, percent, message) of each report of an import of total rows: batches of 100, a report about every tenth.

    The text of a report is a fixed value.
    """
    step, last, out = max(100, math.ceil(total / 10 / 100) * 100), 0, []
    for done in [*range(100, total, 100), *([total] if total else [])]:
        if done == total or done - last >= step:
            last, percent = done, math.floor(100 * done / total + 0.5)
            out.append((done, percent, f"词库导入进度：{done}/{total}（{percent}%），已新增 {done} 条。"))
    return out


def summary(counts: DataFrame, scope: str) -> DataFrame:
    """(message): what an import with these counters (and created_count, known_count, failed_count) reports; its texts are fixed values."""
    n = lambda c: F.col(c).cast("string")
    failed = F.when(F.col("failed_count") > 0, F.concat(F.lit("，失败 "), n("failed_count"), F.lit(" 条"))).otherwise("")
    duplicates = (F.col("duplicate_count") + F.col("known_count")).cast("string")
    return counts.select(
        F.concat(
            text.scope_name(F.lit(scope)), F.lit("词库导入完成：读取 "), n("read_count"), F.lit(" 条，新增 "), n("created_count"), F.lit(" 条，重复 "), duplicates,
            F.lit(" 条，无效 "), n("invalid_count"), F.lit(" 条"), failed, F.lit("。"),
        ).alias("message")
    )


def write_lexicon(files: DataFrame, folder: str, stats: str | None = None) -> None:
    """One word a line in one file, sorted: a lexicon is bounded by its language, not by the message stream. stats: a folder for its counters, as JSON."""
    lexicon(files).coalesce(1).write.mode("overwrite").text(folder)
    if stats is not None:
        lexicon_stats(files).coalesce(1).write.mode("overwrite").json(stats)
