"""File scans: listings, text decoding, rows, cues and shortcuts."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import fixed_values as V, text as T, udfs
from ..functions.text import col


def _scan(reader, root: str, course_depth: int, package_suffixes, skip_dirs, folders=None) -> DataFrame:
    base = root.rstrip("/")
    rows = reader.load(base if folders is None else [f"{base}/{f}" for f in folders])
    full = F.regexp_replace(F.try_url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), r"\A[A-Za-z0-9]+:/*(?=/)", "")
    plain = base.split(":", 1)[-1] if ":" in base.split("/", 1)[0] else base
    plain = "/" + plain.lstrip("/")
    inside = F.regexp_replace(F.expr("_full"), "\\A" + _literal(plain) + "/*", "")
    parts = F.split("_inside", "/")
    course = F.array_join(F.slice(parts, 1, course_depth), "/") if course_depth else F.lit("")
    rest = F.array_join(F.slice(parts, course_depth + 1, F.size(parts)), "/")
    out = (rows.withColumn("_full", full).withColumn("_inside", inside)
               .withColumn("course_id", course).withColumn("_rest", rest))
    dirs = F.slice(F.split("_rest", "/"), 1, F.size(F.split("_rest", "/")) - 1)
    keep = (F.col("_rest") != "") & ~F.arrays_overlap(F.concat(dirs, F.array(F.lit(""))), F.array(*map(F.lit, skip_dirs)))
    for end in package_suffixes:
        keep = keep & ~F.col("_rest").endswith(end)
    return out.filter(keep)


def _literal(text: str) -> str:
    """Regular expression that matches exactly this text, in Java syntax."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def plain_folder(spark: SparkSession, folder: str) -> str | None:
    """Path of a folder that is in the file system of the machine (or mounted there), else null."""
    if folder.startswith("/"):
        folder = (spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:/").rstrip("/") + folder
    return re.sub(r"\Afile:/*", "/", folder) if folder.startswith("file:") else None


def scan_files(spark: SparkSession, root: str, course_depth: int = 1, content: bool = False,
               package_suffixes=(".corpus.zip",), skip_dirs=V.SKIP_DIRS, folders: list[str] | None = None) -> DataFrame:
    """Regular files below a root: course_id, path, ext, size, mtime (, content).

    The first ``course_depth`` directories name the course. Without ``content``
    the column is pruned and no byte of a file is read. Spark lists all files on the driver;
    ``folders`` of the root bound how many at a time.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return _columns(_scan(reader, root, course_depth, package_suffixes, skip_dirs, folders), content)


def stream_files(spark: SparkSession, root: str, course_depth: int = 1, package_suffixes=(".corpus.zip",),
                 skip_dirs=V.SKIP_DIRS, max_files: int = 10_000) -> DataFrame:
    """The same rows as a stream, with content."""
    from pyspark.sql import types as S

    schema = S.StructType([S.StructField("path", S.StringType()), S.StructField("modificationTime", S.TimestampType()),
                           S.StructField("length", S.LongType()), S.StructField("content", S.BinaryType())])
    reader = (spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
                   .option("maxFilesPerTrigger", max_files))
    return _columns(_scan(reader, root, course_depth, package_suffixes, skip_dirs), True)


def _columns(rows: DataFrame, content: bool) -> DataFrame:
    cols = ["course_id", F.col("_rest").alias("path"), T.suffix("_rest").alias("ext"), F.col("length").alias("size"),
            F.col("modificationTime").alias("mtime")]
    return rows.select(*cols, "content") if content else rows.select(*cols)


def decode_text(files: DataFrame, content: str = "content", out: str = "text") -> DataFrame:
    """Text of file bytes: UTF-8 in the JVM, older encodings in one Arrow helper."""
    utf8 = F.try_validate_utf8(F.col(content).cast("string"))
    legacy = udfs.decode_legacy(F.when(utf8.isNull(), F.col(content)))
    return files.withColumn(out, T.clean_block(F.coalesce(utf8, legacy))).drop(content)


def rendered_row(cols: list[str]) -> Column:
    """``column i: v`` parts of a row, empty cells left out."""
    cells = [T.clean_block(F.col(c).cast("string")) for c in cols]
    parts = [F.when(v != "", F.concat(F.lit(f"column {i}: "), v)) for i, v in enumerate(cells, 1)]
    return F.concat_ws(" | ", *parts)


def row_units(df: DataFrame, cols: list[str], row_no: str, keys: list[str] | None = None) -> DataFrame:
    """Table rows as text units with locator ``row n``; empty rows are dropped."""
    keys = keys or []
    return (df.withColumn("unit_no", F.col(row_no).cast("long"))
              .withColumn("text", rendered_row(cols)).filter(F.col("text") != "")
              .select(*keys, "unit_no", F.concat(F.lit("row "), F.col("unit_no")).alias("locator"), "text"))


def csv_units(texts: DataFrame, text: str = "text") -> DataFrame:
    """Units of decoded CSV files; the separator is the most frequent of ``, ; tab |``
    in the first line. A quoted cell keeps its separators and line ends, so a row
    may take several lines; ``unit_no`` counts rows."""
    files = texts.select("course_id", "source_id", F.regexp_replace(F.replace(F.col(text), F.lit("\ufeff"), F.lit("")), "\r\n?", "\n").alias("_t"))
    head = F.substring_index("_t", "\n", 1)
    counts = [(sep, F.regexp_count(head, F.lit(pattern))) for sep, pattern in ((",", ","), (";", ";"), ("\t", "\t"), ("|", "\\|"))]
    best = F.greatest(*[n for _, n in counts])
    sep = reduce(lambda acc, p: acc.when(p[1] == best, p[0]), counts[1:], F.when(counts[0][1] == best, counts[0][0]))

    def pattern(template: str) -> Column:
        """The template with the separator of the file in place of ``SEP``."""
        parts = template.split("SEP")
        return F.concat(*[x for p in parts for x in (F.lit(p), F.col("_sep"))][:-1])

    cell = r'(?:"(?:[^"]++|"")*+"?+[^SEP\n]*+|[^SEP"\n][^SEP\n]*+|)'
    row = F.regexp_extract_all("_t", pattern(f"({cell}(?:[SEP]{cell})*+)(?:\\n|\\z)"), F.lit(1))
    rows = T.unnest(files.withColumn("_sep", sep), ["course_id", "source_id", "_sep"], row, "_i", "_line")
    cells = F.regexp_extract_all("_line", pattern(f"(?:\\A|[SEP])({cell})"), F.lit(1))
    # of a quoted cell the quotes go, and a doubled quote is one; what follows the closing quote stays
    quoted = r'(?s)\A"((?:[^"]++|"")*+)"?+(.*)\z'
    bare = lambda v: F.when(v.startswith('"'), F.concat(
        F.replace(F.regexp_extract(v, quoted, 1), F.lit('""'), F.lit('"')), F.regexp_extract(v, quoted, 2))).otherwise(v)
    clean = F.transform(cells, lambda v: T.clean_block(bare(v)))
    parts = F.filter(F.transform(clean, lambda v, i: F.when(v != "", F.concat(
        F.lit("column "), (i + 1).cast("string"), F.lit(": "), v))), lambda v: v.isNotNull())
    return (rows.withColumn("unit_no", (F.col("_i") + 1).cast("long")).withColumn("text", F.array_join(parts, " | "))
                .filter(F.col("text") != "")
                .select("course_id", "source_id", "unit_no", F.concat(F.lit("row "), "unit_no").alias("locator"), "text"))


def subtitle_cues(texts: DataFrame, text: str = "text") -> DataFrame:
    """Cues of subtitle files as units: locator = start time."""
    stamp = r"(\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3})\s*-->\s*\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3}"
    body = F.regexp_replace(T.clean_block(text), r"(?is)\AWEBVTT.*?\n+", "")
    blocks = texts.withColumn("_blocks", F.split(body, r"\n\s*\n")).drop(text)
    keep = [c for c in blocks.columns if c != "_blocks"]
    rows = T.unnest(blocks, keep, "_blocks", "_i", "_block")
    lines = F.filter(F.transform(F.split("_block", "\n"), T.strip), lambda l: l != "")
    rows = rows.withColumn("_lines", lines).withColumn(
        "_at", F.array_position(F.transform("_lines", lambda l: l.contains("-->")), F.lit(True)))
    rows = rows.filter(F.col("_at") > 0).withColumn("_time", F.element_at("_lines", F.col("_at").cast("int")))
    start = F.regexp_extract("_time", stamp, 1)
    said = F.array_join(F.slice("_lines", F.col("_at").cast("int") + 1, F.size("_lines")), " ")
    return (rows.withColumn("text", T.clean_block(said)).filter(F.col("text") != "")
                .select(*keep, (F.col("_i") + 1).alias("unit_no"),
                        F.when(start != "", start).otherwise(T.strip(F.substring_index("_time", "-->", 1))).alias("locator"),
                        "text"))


def shortcut_links(texts: DataFrame, text: str = "text") -> DataFrame:
    """Target of shortcut files; an unreadable one stays null."""
    url = F.nullif(T.strip(F.regexp_extract(text, r"(?im)^URL=(.+)$", 1)), F.lit(""))
    return texts.select("course_id", T.title_of("path").alias("title"), F.col("path").alias("source_path"),
                        url.alias("url"), col("group"))
