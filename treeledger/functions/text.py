"""Text as lines, statements and tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What counts as white space in a line, as code points.
SPACE_CLASS = r"\x09-\x0D\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LINE_BREAK = r"\r\n|\n|\r"
#: A word, or one other visible sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x09-\x0D\x20]"
WORD_START = r"^[\p{L}\p{N}_]"


def split_lines(text: Column) -> Column:
    """Lines of a text: none of an empty or null text; a break at the end makes a last empty line."""
    return F.when(F.length(text) > 0, F.split(text, LINE_BREAK, -1)).otherwise(F.array().cast("array<string>"))


def is_blank(line: Column) -> Column:
    return line.rlike(f"^[{SPACE_CLASS}]*$")


def tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(TOKEN), F.lit(0))


def is_word(token: Column) -> Column:
    return token.rlike(WORD_START)


def well_formed(text: Column) -> Column:
    """Text read from bytes, with what isn't UTF-8 replaced by U+FFFD."""
    return F.make_valid_utf8(text)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def lines_of(files: DataFrame) -> DataFrame:
    """file, line_no (from 1), line, blank; from file and code."""
    return files.select("file", F.posexplode(split_lines(F.col("code"))).alias("at", "line")).select(
        "file", (F.col("at") + 1).alias("line_no"), "line", is_blank(F.col("line")).alias("blank")
    )


def statements_of(lines: DataFrame) -> DataFrame:
    """Lines that aren't blank, as statements: file, container (their paragraph), pos, line_no, line."""
    order = Window.partitionBy("file").orderBy("line_no")
    marked = lines.withColumn("container", F.sum(F.col("blank").cast("int")).over(order))
    stated = marked.where(~F.col("blank"))
    return stated.withColumn("pos", F.row_number().over(Window.partitionBy("file", "container").orderBy("line_no")))
