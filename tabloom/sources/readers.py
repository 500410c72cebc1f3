"""Tables from files whose format, separator and encoding are not known beforehand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.functions import fixed_values as V
from tabloom.functions.scalars import named, quoted
from tabloom.sources.ranges import array_elements, quoted_records, text_rows

HEAD_LINES = 10
READABLE = ("ISO-8859-1", "US-ASCII", "UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE")     # without a further setting
HEAD_CHARS = 100_000       # of a line that are looked at for separators


def head_lines(spark: SparkSession, path: str, n: int = HEAD_LINES, characters: int = HEAD_CHARS) -> list[str]:
    """First lines of a file, each cut to ``characters`` before it reaches the driver."""
    lines = spark.read.text(path).limit(n).select(F.substring("value", 1, characters).alias("value"))
    return [r["value"] for r in lines.collect() if r["value"] and r["value"].strip()]


def separator_by_columns(lines: Sequence[str]) -> str | None:
    """First separator that splits the header into more than one column."""
    header = lines[0] if lines else ""
    return next((s for s in V.SEPARATORS if s in header.strip()), None)


def separator_by_count(lines: Sequence[str]) -> str | None:
    """Separator that occurs most often in the first lines."""
    counts = {s: sum(line.count(s) for line in lines) for s in V.COUNTED_SEPARATORS}
    best = max(counts, key=counts.get)
    return best if counts[best] else None


def separator_of_first_match(lines: Sequence[str], default: str = ";") -> str:
    """``,`` or ``;`` of the first line that holds one, the comma first."""
    for line in lines:
        for s in (",", ";"):
            if s in line:
                return s
    return default


def get_delimiter(spark: SparkSession, path: str, max_lines: int = 100) -> str:
    return separator_of_first_match(head_lines(spark, path, max_lines))


def separator_report(spark: SparkSession, path: str, n: int = HEAD_LINES) -> DataFrame:
    """How often each separator occurs in the first lines."""
    lines = spark.read.text(path).limit(n)
    return lines.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("separator"),
                 (F.length("value") - F.length(F.replace("value", F.lit(s), F.lit("")))).alias("n"))
        for s in V.COUNTED_SEPARATORS])).alias("e")).groupBy("e.separator").agg(F.sum("e.n").alias("n"))


def file_encodings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Encoding of each file, decided from all of its bytes.

    Lines are read as raw bytes in ordinary splits and only counted: a byte order mark or many zero bytes stand for
    UTF-16, valid UTF-8 lines for UTF-8. The rest is told apart by the pairs and ranges of its high bytes: lead bytes
    of Shift-JIS with their trail bytes, runs of Cyrillic letters, the letters of Central Europe, the punctuation
    80-9F of Windows-1252; what is left is Latin-1.
    """
    # a plain view of the bytes: Latin-1 gives every byte one character
    raw = F.decode(F.col("value").cast("binary"), "ISO-8859-1")

    def hits(pattern: str) -> Column:
        return F.sum(F.regexp_count(raw, F.lit(pattern)))
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.min(F.is_valid_utf8("value")).alias("utf8"), F.sum(F.length(raw)).alias("n"),
        F.max(raw.rlike("^(\u00ff\u00fe|\u00fe\u00ff)")).alias("marked"),
        hits("[^\\x00]\\x00").alias("low"), hits("\\x00[^\\x00]").alias("high_first"), hits("\\x00").alias("zeros"),
        hits("[\u0080-\u00ff]").alias("high"), hits("[\u0080-\u009f]").alias("control"),
        hits("[\u0081-\u009f\u00e0-\u00ef][\u0040-\u007e\u0080-\u00fc]").alias("sjis"),
        hits("[\u0082\u0083][\u0040-\u00f1]").alias("kana"),
        hits("[\u00c0-\u00ff]{3,}").alias("cyrillic"),
        hits("[\u009c\u009d\u009e\u009a\u009f\u00b3\u00b9\u00bf\u00a3\u00e6\u00ea\u00f1\u00ec\u00f8\u00e8]").alias("central"),
        hits("[\u009c\u009d\u009e\u009a\u009f\u00b3\u00b9\u00bf]").alias("central_only"))
    encoding = (F.when(F.col("marked"), "UTF-16")
                .when((F.col("zeros") * 3 > F.col("n")) & (F.col("high_first") > F.col("low")), "UTF-16BE")
                .when(F.col("zeros") * 3 > F.col("n"), "UTF-16LE")
                .when(F.col("utf8"), "UTF-8")
                .when((F.col("kana") > 0) & (F.col("sjis") * 4 > F.col("high")), "Shift_JIS")
                .when(F.col("cyrillic") * 6 > F.col("high"), "windows-1251")
                .when((F.col("central_only") * 4 > F.col("high")), "windows-1250")
                .when(F.col("control") > 0, "windows-1252").otherwise("ISO-8859-1"))
    return found.select("path", encoding.alias("encoding"))


def flatten_structs(df: DataFrame) -> DataFrame:
    """Nested objects as columns with dotted names."""
    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield (*path, f.name)
    return df.select(*[F.col(".".join(quoted(p) for p in parts)).alias(".".join(parts))
                       for parts in leaves(df.schema, ())])


def json_layouts(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """Files that hold a record per line (``True``) and files that hold one document or array (``False``).

    A file has a record per line if its first line that isn't blank is a whole object and so is every other; only a
    flag per file is gathered.
    """
    value = F.trim("value")
    whole = F.try_parse_json(value).isNotNull() & value.startswith("{")
    found = (spark.read.text(path).where(value != "")
             .groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(whole).alias("lines")).collect())
    return {kind: sorted(r["path"] for r in found if r["lines"] == kind) for kind in (True, False)}


def array_files(spark: SparkSession, files: list[str]) -> list[str]:
    """Files whose first character that isn't blank opens an array."""
    start = F.ltrim(F.regexp_replace("value", "^\ufeff", ""))
    rows = spark.read.text(files).where((start != "") & (F.col("_metadata.file_block_start") == 0)).select(
        F.col("_metadata.file_path").alias("path"), F.substring(start, 1, 1).alias("first"),
        F.monotonically_increasing_id().alias("place"))
    found = rows.groupBy("path").agg(F.min_by("first", "place").alias("first")).where("first = '['").collect()
    return sorted(r["path"] for r in found)


def read_json(spark: SparkSession, path: str, flatten: bool = True, lines: bool | None = None) -> DataFrame:
    """JSON records, one per line or as documents and arrays.

    Which of the two is seen per file unless ``lines`` says so; files with a record per line are read in splits, and so are
    arrays, which are cut into their elements. A broken element shows in ``_corrupt_record``, as a broken line does.
    """
    if lines is None:
        layouts = json_layouts(spark, path)
        arrays = array_files(spark, layouts[False]) if layouts[False] else []
        documents = [f for f in layouts[False] if f not in set(arrays)]
        parts = [spark.read.json(files, multiLine=multi) for files, multi in ((layouts[True], False), (documents, True)) if files]
        if arrays:
            elements = array_elements(spark, arrays)
            parts.append(DataFrame(spark.read._jreader.json(text_rows(elements, F.col("data"))), spark))
        if not parts:
            return spark.read.json(path)
        df = parts[0]
        for other in parts[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
    else:
        df = spark.read.json(path, multiLine=not lines)
    return flatten_structs(df) if flatten else df


def open_quotes(spark: SparkSession, path: str | list[str]) -> dict[bool, list[str]]:
    """Files where some line leaves a quote open (``True``), so that a value may go on in the next line, and the others."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    found = spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.max(quotes % 2 == 1).alias("open")).collect()
    return {kind: sorted(r["path"] for r in found if r["open"] == kind) for kind in (True, False)}


def _common_types(schemas: list[T.StructType]) -> T.StructType:
    """The first schema, with a type for every column that holds the values of all the others."""
    def joined(types: list[T.DataType]) -> T.DataType:
        kinds = set(types) - {T.NullType()} or set(types)
        if len(kinds) == 1:
            return kinds.pop()
        ranked = [T.IntegerType(), T.LongType(), T.DoubleType()]
        return max(kinds, key=ranked.index) if kinds <= set(ranked) else T.StringType()
    same = [s for s in schemas if len(s) == len(schemas[0])]
    return T.StructType([T.StructField(f.name, joined([s[k].dataType for s in same])) for k, f in enumerate(schemas[0])])


def read_delimited(spark: SparkSession, path: str | list[str], separator: str | None = None,
                   encoding: str | None = None, schema: str | T.StructType | None = None,
                   keep_broken: bool = False) -> DataFrame:
    """Delimited text with a header; types are inferred unless a schema is given.

    Values in quotes may hold separators, doubled quotes and line ends. Files where a line leaves a quote open are cut into
    records by byte ranges, so that a single file is read by many tasks too; only where quotes stand inside values
    without quotes, or in UTF-16, such a file is one task. Malformed lines are left out, or kept in the column ``_broken``
    when asked for; ``broken_lines`` counts them.
    """
    if separator is None:
        lines = head_lines(spark, path)
        separator = separator_by_columns(lines) or separator_by_count(lines) or ","
    western = (encoding or "").lower() in ("windows-1252", "cp1252")
    # Spark has no reader for Windows-1252; it is Latin-1 with letters in place of control codes
    charset = "ISO-8859-1" if western else encoding
    if charset and charset.upper() not in READABLE:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")     # else only a few encodings are accepted

    def reader(multi: bool, header: bool = True):
        found = (spark.read.option("header", header).option("sep", separator).option("multiLine", multi)
                 .option("ignoreLeadingWhiteSpace", True).option("quote", '"').option("escape", '"'))
        return found.option("encoding", charset) if charset else found

    # ways to read some of the files: a reader that is told the schema, and what it reads
    wide = bool(encoding) and encoding.upper().startswith("UTF-16")      # line ends are two bytes, so splits can't find them
    kinds = {True: [path] if isinstance(path, str) else path, False: []} if wide else open_quotes(spark, path)
    ways, names = [], None
    if kinds[True] and not wide:
        first, others, stray = quoted_records(spark, kinds[True], separator)

        def text(rows: DataFrame):
            return text_rows(rows, F.decode("data", charset) if charset else F.col("data"))
        if len(stray) < len(kinds[True]):
            heads = first.orderBy("path").limit(1)
            names = DataFrame(reader(True)._jreader.csv(text(heads)), spark).columns
            ways.append((reader(True, header=False), lambda r: DataFrame(r._jreader.csv(text(others)), spark)))
        kinds[True] = stray
    if kinds[False]:
        ways.insert(0, (reader(False), lambda r, files=kinds[False]: r.csv(files)))
    if kinds[True]:
        ways.append((reader(True), lambda r, files=kinds[True]: r.csv(files)))
    if not ways:
        ways.append((reader(False), lambda r: r.csv(path)))
    if schema is None:
        schemas = [read(r.option("inferSchema", True)).schema for r, read in ways]
        typed = _common_types(schemas)
        if names and len(names) == len(typed):
            typed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, typed)])
    else:
        typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if keep_broken:
        typed = T.StructType([*typed.fields, T.StructField("_broken", T.StringType())])
    df = None
    for way, read in ways:
        # whole lines are split, so that a wrong number of fields shows whatever columns are asked for;
        # a value of the wrong type shows in the columns that are read
        way = way.option("columnPruning", False).schema(typed)
        if keep_broken:
            way = way.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken")
        else:
            way = way.option("mode", "DROPMALFORMED")
        part = read(way)
        df = part if df is None else df.unionByName(part)
    return _western_letters(df) if western else df


def broken_lines(spark: SparkSession, path: str | list[str], **options) -> int:
    """How many records ``read_delimited`` leaves out as malformed."""
    df = read_delimited(spark, path, keep_broken=True, **options)
    # the other columns must be read too, or nothing is parsed that could be broken
    return df.agg(F.count("_broken").alias("n"), *[F.count(named(c)) for c in df.columns if c != "_broken"]).first()["n"]


def _western_letters(df: DataFrame) -> DataFrame:
    """Control codes 80-9F of Latin-1 text as the letters they stand for in Windows-1252."""
    codes = {chr(b): bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0xA0)}
    codes = {k: v for k, v in codes.items() if v}
    source, target = "".join(codes), "".join(codes.values())
    table = str.maketrans(codes)
    return df.select(*[
        (F.translate(named(f.name), source, target) if isinstance(f.dataType, T.StringType) else named(f.name))
        .alias(f.name.translate(table)) for f in df.schema])


def read_or_retry(spark: SparkSession, path: str, first: str = ",", second: str = ";") -> DataFrame:
    """Read with one separator and again with another when a single column came back."""
    df = read_delimited(spark, path, first)
    return df if len(df.columns) > 1 else read_delimited(spark, path, second)


def read_data_flexible(spark: SparkSession, path: str, detect_encoding: bool = True) -> DataFrame:
    """Table from a file or folder, by the ending of its name."""
    lower = path.lower().rstrip("/")
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    if lower.endswith(".json"):
        return read_json(spark, path)
    if lower.endswith((".jsonl", ".ndjson")):
        return read_json(spark, path, lines=True)
    if not detect_encoding:
        return read_delimited(spark, path)
    files: dict[str, list[str]] = {}
    for r in file_encodings(spark, path).collect():
        files.setdefault(r["encoding"], []).append(r["path"])
    parts = [read_delimited(spark, sorted(files[e]), encoding=None if e == "UTF-8" else e) for e in sorted(files)]
    if not parts:
        return read_delimited(spark, path)
    df = parts[0]
    for other in parts[1:]:
        df = df.unionByName(other, allowMissingColumns=True)
    return df


def read_folder(spark: SparkSession, path: str, kind: str = "json", **options) -> DataFrame:
    """All files of a folder with the path each row came from."""
    df = spark.read.format(kind).options(**options).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("source_file"))


def preview(spark: SparkSession, path: str, lines: int = V.PREVIEW_LINES,
            characters: int = V.PREVIEW_CHARS) -> str:
    """The first lines of a file as one text of limited length."""
    head = spark.read.text(path).limit(lines).select(F.substring("value", 1, characters).alias("value"))
    return "\n".join(r["value"] for r in head.collect())[:characters]


def from_records(spark: SparkSession, records: dict | Sequence[dict]) -> DataFrame:
    """Table from one record or a list of records held by the caller."""
    return spark.createDataFrame([records] if isinstance(records, dict) else list(records))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    return named(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
