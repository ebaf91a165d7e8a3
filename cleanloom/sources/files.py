"""Reading folders of delimited text files of unknown encoding, delimiter and header place.

How a file is laid out comes from its first block, its footer from its last one (``blocks``); nothing else is read for it. Then
all files are read in one pass: a line's fields are cut by the delimiter of its file and put in the columns of its file's header.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import blocks
from ..functions import scan, textfn
from ..functions.core import OpError, as_list, col
from ..operators.rows import head_rows

# delimiters tried, in order of preference (fixed values)
DELIMITERS = (",", ";", "\t", "|")

# encodings by the name Spark's readers know
CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1"}

# words of a summary row (fixed values)
SUMMARY_WORDS = ("total", "sum", "average", "avg", "count", "grand total", "subtotal", "sub-total", "sum total", "overall")

# values that are data rather than labels (fixed values)
DATA_VALUE = (
    r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$",
    r"^\d{4}-\d{2}-\d{2}$",
    r"^\d{1,2}/\d{1,2}/\d{2,4}$",
    r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    r"^https?://[^\s]+$",
)


def lines(spark: SparkSession, paths) -> DataFrame:
    """(file, block, id, line): every line with the place that restores its order in the file."""
    raw = spark.read.text(as_list(paths))
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))


def head_lines(spark: SparkSession, paths, n: int) -> DataFrame:
    """(file, row, line): the first n lines of each file, numbered from 0; one block of each file is read."""
    return _first_lines(blocks.edges(spark, paths, n), n)


def _first_lines(edges: DataFrame, n: int) -> DataFrame:
    text = blocks.decoded(F.col("head"), ~blocks.is_utf8(F.col("head")))
    return edges.select("file", F.posexplode(F.slice(_split_lines(text), 1, n)).alias("row", "line"))


def _split_lines(text: Column) -> Column:
    """The lines of a text; the break at its end begins no line."""
    return F.split(F.regexp_replace(text, f"(?:{blocks.BREAK})$", ""), blocks.BREAK)


def detect_encoding(spark: SparkSession, paths) -> DataFrame:
    """(file, encoding): utf-8 when the file's first block is valid UTF-8, else latin-1, which reads any bytes."""
    return _encodings(blocks.edges(spark, paths))


def _encodings(edges: DataFrame) -> DataFrame:
    return edges.select("file", F.when(blocks.is_utf8(F.col("head")), "utf-8").otherwise("latin-1").alias("encoding"))


def detect_delimiter(heads: DataFrame) -> DataFrame:
    """(file, delimiter): the best of the candidates by mean columns x consistency over the first five lines."""
    used = heads.where((F.col("row") < 5) & (F.length(F.trim("line")) > 0))
    scores = []
    for i, d in enumerate(DELIMITERS):
        n = F.size(F.split("line", textfn.splitter(d)))
        steady = 1 - (F.max(n) - F.min(n)) / F.greatest(F.max(n), F.lit(1))
        score = F.when(F.avg(n) > 1, F.avg(n) * steady).otherwise(0.0)
        scores.append(F.struct(score.alias("score"), F.lit(-i).alias("place"), F.lit(d).alias("delimiter")))
    best = used.groupBy("file").agg(F.array_max(F.array(*scores)).alias("b"))
    return best.select("file", F.when(F.col("b.score") > 0, F.col("b.delimiter")).otherwise(",").alias("delimiter"))


def cells(line: Column, delimiter: Column) -> Column:
    """Fields of a line; delimiters inside double quotes do not split. One pass over the line: quotes cut it into parts, every
    second one is quoted, and only the others' delimiters become marks."""
    mark = "\x1f"
    parts = F.transform(F.split(line, '"'), lambda p, i: F.when(i % 2 == 0, F.replace(p, delimiter, F.lit(mark))).otherwise(p))
    return F.transform(F.split(F.array_join(parts, '"'), mark), lambda c: F.regexp_replace(F.regexp_replace(F.trim(c), '(?s)^"(.*)"$', "$1"), '""', '"'))


def _data_like(v: Column) -> Column:
    bare = F.translate(v, ",$%", "")
    hit = bare.rlike(DATA_VALUE[0])
    for p in DATA_VALUE[1:]:
        hit = hit | v.rlike(p)
    return hit


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def score_headers(heads: DataFrame, delimiters: DataFrame, max_rows: int = 20, expected_columns: Sequence[str] | None = None,
                  min_string_columns: int = 2) -> DataFrame:
    """(file, row, fields, score) of the first lines of each file."""
    d = heads.where(F.col("row") < max_rows).join(delimiters, "file").select("file", "row", cells(F.col("line"), F.col("delimiter")).alias("fields"))
    return score_fields(d, expected_columns, min_string_columns)


def score_fields(rows: DataFrame, expected_columns: Sequence[str] | None = None, min_string_columns: int = 2) -> DataFrame:
    """Score (file, row, fields) rows as headers: +30 per expected name found, +10 per text field when there
    are enough, +20 without blanks, +15 when name-like, +5 per field whose kind changes in the next row."""
    w = Window.partitionBy("file").orderBy("row")  # a few rows per file
    d = rows.withColumn("next", F.lead("fields").over(w)).withColumn("width", F.max(F.size("fields")).over(Window.partitionBy("file")))
    filled = F.filter("fields", lambda v: v != "")
    number = r"^[0-9]+$"
    texty = _count(filled, lambda v: ~F.translate(v, ".-", "").rlike(number))
    score = F.when(texty >= min_string_columns, texty * 10).otherwise(0)
    score = score + F.when((F.size(filled) == F.col("width")), 20).otherwise(0)
    score = score + F.when(_count(filled, lambda v: F.length(v) < 50) >= F.size(filled) * 0.7, 15).otherwise(0)
    kind = lambda v: F.when(v == "", "none").when(_is_number(v), "number").otherwise("text")
    changes = F.zip_with("fields", "next", lambda a, b: F.when(kind(a) != kind(b), 1).otherwise(0))
    score = score + F.when(F.col("next").isNotNull(), F.aggregate(changes, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) * 5).otherwise(0)
    for name in expected_columns or []:
        score = score + F.when(F.exists(filled, lambda v: F.lower(v).contains(name.lower())), 30).otherwise(0)
    return d.select("file", "row", "fields", score.alias("score"))


def _is_number(v: Column) -> Column:
    return v.try_cast("double").isNotNull()


def detect_header(heads: DataFrame, delimiters: DataFrame, **options) -> DataFrame:
    """(file, header_row, score, fields): the best-scoring row, the first on a tie."""
    return best_header(score_headers(heads, delimiters, **options))


def best_header(scores: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("row", "score", "fields"), F.struct("score", (-F.col("row")).alias("r")))
    return scores.groupBy("file").agg(best.alias("b")).select("file", F.col("b.row").alias("header_row"), F.col("b.score").alias("score"), F.col("b.fields").alias("fields"))


def detect_header_row(heads: DataFrame, delimiters: DataFrame, max_rows_to_scan: int = 10) -> DataFrame:
    """(file, header_row, confidence): 0.2 no blanks + 0.3 share of label-like fields + 0.2 unique fields
    + 0.3 share of columns with one kind of value in the five rows below; confidence is best score / 0.8."""
    d = heads.where(F.col("row") < max_rows_to_scan).join(delimiters, "file").select("file", "row", cells(F.col("line"), F.col("delimiter")).alias("fields"))
    by_file = Window.partitionBy("file")  # at most max_rows_to_scan rows per file
    d = d.withColumn("width", F.max(F.size("fields")).over(by_file))
    below = F.collect_list("fields").over(by_file.orderBy("row").rowsBetween(1, Window.unboundedFollowing))
    d = d.withColumn("below", below)
    filled = F.filter("fields", lambda v: v != "")
    score = F.when(F.size(filled) == F.col("width"), 0.2).otherwise(0.0)
    score = score + F.lit(0.3) * _count(filled, lambda v: ~_data_like(v)) / F.col("width")
    score = score + F.when((F.size(filled) > 0) & (F.size(F.array_distinct(filled)) == F.size(filled)), 0.2).otherwise(0.0)

    def steady(i: Column) -> Column:
        seen = F.slice(F.filter(F.transform("below", lambda r: F.get(r, i)), lambda v: v.isNotNull() & (v != "")), 1, 5)
        return (F.size(seen) > 0) & (F.size(F.array_distinct(F.transform(seen, _data_like))) <= 1)

    places = F.sequence(F.lit(0), F.col("width") - 1)
    score = score + F.when(F.size("below") > 0, F.lit(0.3) * F.size(F.filter(places, steady)) / F.col("width")).otherwise(0.0)
    best = F.max_by(F.struct("row", "s"), F.struct("s", (-F.col("row")).alias("r")))
    out = d.withColumn("s", score).groupBy("file").agg(best.alias("b"), F.count(F.lit(1)).alias("n"))
    row = F.when((F.col("n") < 2) | (F.col("b.s") <= 0), 0).otherwise(F.col("b.row"))
    sure = F.when(F.col("n") < 2, 1.0).when(F.col("b.s") > 0, F.least(F.lit(1.0), F.col("b.s") / 0.8)).otherwise(0.5)
    return out.select("file", row.alias("header_row"), F.bround(sure, 4).alias("confidence"))


def apply_detected_header(df: DataFrame, max_rows_to_check: int = 20, expected_columns: Sequence[str] | None = None,
                          min_string_columns: int = 2, apply_header: bool = True, order_by=None) -> DataFrame:
    """A frame read with junk lines or a wrong header: name the columns by the best of its first rows and drop the rows up to it.

    The first rows are a top-k by the order, and no row is numbered: rows up to the header go by the header's order keys,
    which come to the driver with its fields, as column names must. The order must be total.
    """
    keys = scan.need_order(df, order_by)
    names = [c for c in df.columns if c not in {k.name for k in keys}]
    first = df.orderBy(*[k.column() for k in keys]).limit(max_rows_to_check)
    fields = F.array(*[F.coalesce(textfn.strip(F.col(c).cast("string")), F.lit("")) for c in names])
    kept = first.select(F.array(*[col(k.name).cast("string") for k in keys]).alias("keys"), fields.alias("fields")).collect()  # max_rows_to_check rows
    if not kept or not apply_header:
        return df
    rows = df.sparkSession.createDataFrame([("", i, r["fields"]) for i, r in enumerate(kept)], "file string, row int, fields array<string>")
    best = best_header(score_fields(rows, expected_columns, min_string_columns)).first()
    below = df.where(scan.later_than(df, keys, kept[best["header_row"]]["keys"]))
    return below.withColumnsRenamed({c: f or f"col_{i}" for i, (c, f) in enumerate(zip(names, best["fields"]))})


def detect_footer_rows(rows: DataFrame, columns: Sequence[str], file: str = "file", order: Sequence[str] = ("row",), max_rows_to_check: int = 5) -> DataFrame:
    """(file, footer_rows, footer_type): the unbroken run of blank or summary rows at the end of each file.

    Only the last rows of a file reach the shuffle (``row_number`` limit pushed down).
    """
    blank = F.lit(0)
    for c in columns:
        blank = blank + F.col(c).isNull().cast("int")
    words = F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in columns]))
    summary = F.lit(False)
    for k in SUMMARY_WORDS:
        summary = summary | words.contains(k)
    # 0 for data, else the kind of footer: the cells themselves need not travel
    kind = F.when(blank / len(columns) > 0.5, 1).when(summary, 2).otherwise(0)
    slim = rows.select(F.col(file), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], kind.alias("__kind"))
    w = Window.partitionBy(file).orderBy(*[F.col(f"__o{i}").desc() for i in range(len(order))])
    last = slim.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= max_rows_to_check)
    # of fixed size: the least place of data, and the kind of each place
    data_at = F.coalesce(F.min(F.when(F.col("__kind") == 0, F.col("__rn"))), F.max("__rn") + 1)
    at = lambda k: F.coalesce(F.max(F.when(F.col("__rn") == k, F.col("__kind"))), F.lit(0))
    run = last.groupBy(file).agg(data_at.alias("stop"), F.array(*[at(k + 1) for k in range(max_rows_to_check)]).alias("kinds"))
    named = F.get("kinds", F.col("stop") - 2)
    return run.select(file, (F.col("stop") - 1).alias("footer_rows"), F.when(named == 1, "empty").when(named == 2, "summary").alias("footer_type"))


def sniff(spark: SparkSession, paths, **header_options) -> DataFrame:
    """(file, encoding, delimiter, header_row, fields, footer_rows, footer_type, blank_above): how to read each file, from one block at
    either end of it.

    ``footer_rows`` counts the lines of the footer, blank lines among and below them included, ``blank_above`` those above the header.
    """
    # looked at several times: written once, so that the files are opened once
    edges = scan.written(blocks.edges(spark, paths, 20, FOOTER_LINES))
    heads = _first_lines(edges, 20)
    delim = detect_delimiter(heads)
    top = edges.select("file").join(_encodings(edges), "file").join(delim, "file").join(detect_header(heads, delim, **header_options), "file")
    blank = heads.join(top.select("file", "header_row"), "file").where((F.col("row") < F.col("header_row")) & (F.trim("line") == "")).groupBy("file").agg(F.count(F.lit(1)).alias("blank_above"))
    out = top.join(_footers(edges, top), "file", "left").join(blank, "file", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("footer_rows", "blank_above")})


#: Lines looked at for a footer.
FOOTER_LINES = 5


def _footers(edges: DataFrame, top: DataFrame) -> DataFrame:
    """(file, footer_rows, footer_type) by the rule of ``detect_footer_rows`` on the last lines of each file."""
    text = blocks.decoded(F.col("tail"), F.col("encoding") != "utf-8")
    d = edges.where("tail IS NOT NULL").join(top, "file").select("file", "whole", "delimiter", "header_row", F.size("fields").alias("width"), _split_lines(text).alias("lines"))
    body = F.when(F.col("whole"), F.slice("lines", F.col("header_row") + 2, F.greatest(F.size("lines") - F.col("header_row") - 1, F.lit(0)))).otherwise(F.col("lines"))
    full = F.filter(F.transform(body, lambda v, i: F.struct(i.alias("i"), v.alias("line"))), lambda x: F.trim(x["line"]) != "")
    d = d.withColumn("all", F.size(body)).withColumn("lines", full)
    lasts = F.reverse(F.slice("lines", F.greatest(F.size("lines") - FOOTER_LINES + 1, F.lit(1)), FOOTER_LINES))  # last line first

    def kind(x: Column) -> Column:
        values = F.filter(cells(x["line"], F.col("delimiter")), lambda v: v != "")
        words = F.lower(F.array_join(values, " "))
        named = F.lit(False)
        for k in SUMMARY_WORDS:
            named = named | words.contains(k)
        return F.when((F.col("width") - F.size(values)) / F.col("width") > 0.5, "empty").when(named, "summary").otherwise("data")

    d = d.where(F.size("lines") > 1).withColumn("kinds", F.transform(lasts, kind)).withColumn("at", F.transform(lasts, lambda x: x["i"]))
    run = F.coalesce(F.nullif(F.array_position("kinds", "data"), F.lit(0)) - 1, F.size("kinds"))
    start = F.get("at", run.cast("int") - 1)
    return d.withColumn("run", run).where("run > 0").select("file", (F.col("all") - start).alias("footer_rows"), F.get("kinds", F.col("run").cast("int") - 1).alias("footer_type"))


def column_names(fields: Column) -> Column:
    """Names of a header's fields: stripped, ``col_<i>`` for empty ones, repeated ones with a number behind."""
    named = F.transform(fields, lambda f, i: F.when(textfn.strip(f) == "", F.concat(F.lit("col_"), i)).otherwise(textfn.strip(f)))

    def once(f: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice(named, 1, i), lambda x: x == f))
        return F.when((i > 0) & (before > 0), F.concat(f, F.lit("."), before)).otherwise(f)

    return F.transform(named, once)


def read_csv_safe(spark: SparkSession, paths, encoding: str | None = None, delimiter: str | None = None, find_header: bool = True,
                  multi_line: bool = False, mark_footers: bool = False) -> DataFrame:
    """All files as text columns plus ``source_file``, ``row_block``, ``row_id`` (their line order) and ``bad_line``; with
    ``mark_footers`` also ``is_footer``, true for the summary and blank rows at the end of a file.

    Every file is read once, whatever its layout: fields go to the columns of the file's own header. Only files with lines above
    the header, or with a footer to mark, are passed over before, to find where those end. A line that is not UTF-8 is read as
    Latin-1. The paths and the column names come to the driver, as a read needs them. ``multi_line`` reads quoted line breaks, at
    the price that a file is not split and that each layout is a read of its own.
    """
    plan = sniff(spark, paths).withColumn("names", column_names(F.col("fields")))
    if encoding:
        plan = plan.withColumn("encoding", F.lit("utf-8" if _charset(encoding) == "UTF-8" else "latin-1"))
    if delimiter:
        plan = plan.withColumn("delimiter", F.lit(delimiter))
    plan = scan.written(plan.withColumn("skip", F.col("header_row") + 1 if find_header else F.lit(0)))
    layouts = plan.select("delimiter", "names").distinct().orderBy("delimiter", "names").collect()  # one row for each layout
    if not layouts:
        raise OpError("no readable file")
    if multi_line:
        return _read_multi_line(spark, plan, encoding)
    names = list(dict.fromkeys(n for g in layouts for n in g["names"]))
    place = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position("names", n).cast("int") - 1)
    how = plan.select(F.col("file").alias("_file"), F.col("encoding"), "delimiter", F.size("names").alias("width"), place.alias("place"), "skip", "footer_rows")
    lines = None
    deep = (F.col("skip") > 1) | (F.col("footer_rows") > 0) if mark_footers else F.col("skip") > 1
    for inner, kind in ((False, ~deep), (True, deep)):
        files = [unquote_path(r["file"]) for r in plan.where(kind).select("file").collect()]  # the paths that the read is given
        if files:
            part = _numbered_lines(spark, files, how) if inner else _lines_below_header(spark, files, how, find_header)
            lines = part if lines is None else lines.unionByName(part)
    parsed = lines.withColumn("_cells", _fields(sorted({(g["delimiter"], len(g["names"])) for g in layouts})))
    value = lambda i: F.when(F.get("place", F.lit(i)) >= 0, F.get("_cells.cells", F.get("place", F.lit(i))))
    out = [value(i).alias(n) for i, n in enumerate(names)]
    return parsed.select(*out, F.col("_cells.bad").alias("bad_line"), "source_file", "row_block", "row_id", *(["is_footer"] if mark_footers else []))


def unquote_path(file: str) -> str:
    """A file's address as a path for Spark's readers, which take it literally: pattern characters are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _located(lines: DataFrame) -> list[Column]:
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("row_block"), F.monotonically_increasing_id().alias("row_id")]


#: A delimiter that no line holds: the reader then takes whole lines.
NO_DELIMITER = "\x00\x1f<no delimiter>\x1f\x00"


def _lines_below_header(spark: SparkSession, files: list[str], how: DataFrame, header: bool) -> DataFrame:
    """The lines of files whose first line is the header, or that have none. The reader drops the first line itself; it reads
    bytes as Latin-1, which loses none of them, so each line can still be told to be UTF-8."""
    raw = (spark.read.schema("line string").option("sep", NO_DELIMITER).option("quote", "\u0000").option("encoding", "ISO-8859-1").option("header", header)
           .option("enforceSchema", True).option("mode", "PERMISSIVE").csv(files))
    d = raw.select(F.encode("line", "ISO-8859-1").alias("_bytes"), *_located(raw))
    return d.join(how, F.col("source_file") == F.col("_file")).select(_text().alias("line"), "delimiter", "width", "place", "source_file", "row_block", "row_id", F.lit(False).alias("is_footer"))


def _numbered_lines(spark: SparkSession, files: list[str], how: DataFrame) -> DataFrame:
    """The lines of files with junk above the header or a footer. A first pass finds the ids of each file's first and last line."""
    raw = spark.read.text(files)
    d = raw.select(F.col("value").cast("binary").alias("_bytes"), *_located(raw))
    ends = d.groupBy("source_file").agg(F.min(F.when(F.col("row_block") == 0, F.col("row_id"))).alias("first"), F.max_by("row_id", F.struct("row_block", "row_id")).alias("last"))
    ends = ends.withColumnRenamed("source_file", "_of").join(how, F.col("_of") == F.col("_file"))
    out = d.join(ends, F.col("source_file") == F.col("_file")).where((F.col("row_block") > 0) | (F.col("row_id") >= F.col("first") + F.col("skip")))
    # the lines of a file's last block have consecutive ids; a footer that began in the block before is cut short to it
    is_footer = F.col("row_id") > F.col("last") - F.col("footer_rows")
    return out.select(_text().alias("line"), "delimiter", "width", "place", "source_file", "row_block", "row_id", is_footer.alias("is_footer")).where(F.trim("line") != "")


def _text() -> Column:
    """A line's text: UTF-8 unless its file or the line itself is not."""
    return blocks.decoded(F.col("_bytes"), (F.col("encoding") != "utf-8") | ~blocks.is_utf8(F.col("_bytes")))


def _fields(kinds: Sequence[tuple[str, int]]) -> Column:
    """(cells, bad) of ``line``: parsed by the delimiter and the width of its file."""
    out = None
    for sep, width in kinds:
        schema = ", ".join(f"c{i} string" for i in range(width)) + ", bad string"
        row = F.from_csv("line", schema, {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false"})
        row = F.struct(F.array(*[row[f"c{i}"] for i in range(width)]).alias("cells"), row["bad"].alias("bad"))
        test = (F.col("delimiter") == sep) & (F.col("width") == width)
        out = F.when(test, row) if out is None else out.when(test, row)
    return out


def _read_multi_line(spark: SparkSession, plan: DataFrame, encoding: str | None) -> DataFrame:
    """Files with quoted line breaks: one read for each layout, and each file whole. The reader leaves out blank lines, which count to no record."""
    plan = plan.withColumn("skip", F.greatest(F.col("skip") - F.col("blank_above"), F.lit(0)).cast("int"))
    groups = plan.groupBy("encoding", "delimiter", "skip", "names").agg(F.collect_list("file").alias("files")).collect()
    out = None
    for g in groups:
        schema = ", ".join(f"`{n}` string" for n in g["names"]) + ", `bad_line` string"
        part = (spark.read.schema(schema).option("sep", g["delimiter"]).option("encoding", _charset(encoding or g["encoding"]))
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_line").option("header", g["skip"] == 1).option("multiLine", True)
                .option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).csv([unquote_path(f) for f in g["files"]]))
        part = part.select("*", *_located(part))
        if g["skip"] > 1:
            part = _drop_first_lines(part, g["skip"])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def _drop_first_lines(part: DataFrame, skip: int) -> DataFrame:
    """Drop the junk and header lines on top of each file; the reader itself skips only one line."""
    first = part.groupBy(F.col("source_file").alias("f")).agg(F.min("row_id").alias("first"))
    return part.join(first, F.col("source_file") == F.col("f")).where(F.col("row_id") >= F.col("first") + skip).drop("f", "first")


def _charset(name: str) -> str:
    return CHARSETS.get(name.lower(), name)


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """A CSV folder with known layout, all columns as text."""
    return spark.read.csv(path, header=True, sep=sep, encoding=_charset(encoding), escape='"')


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("escape", '"').csv(path, header=True)


def export(df: DataFrame, path: str, format: str = "csv", limit: int | None = None, order_by=None) -> None:
    """CSV or JSON download; a limit takes the first rows of a given order."""
    if format not in ("csv", "json"):
        raise OpError("format must be csv or json")
    if limit is not None:
        if limit < 1:
            raise OpError("limit must be at least 1")
        df = head_rows(df, limit, order_by)
    write_csv(df, path, "overwrite") if format == "csv" else df.write.mode("overwrite").json(path)
