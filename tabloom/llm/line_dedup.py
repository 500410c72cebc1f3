"""Lines that repeat up to one edit, by a deletion-neighbourhood join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import binary_hash, stored

BLOCK = 256            # characters hashed together; a deletion changes one block and shifts those after it
MIN_CHARS = 16         # shorter lines are only compared for equality
_PRUNE = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"


def _halves(line: str) -> Column:
    """Hashed keys of which two lines within one edit share at least one: their first or last half is untouched.

    Halves are taken for the line's own length and for one character less, so that both lines of a pair have the
    halves of the shorter one.
    """
    sizes = f"array(length({line}) div 2, (length({line}) - 1) div 2)"
    return F.expr(f"""array_distinct(concat(
        transform({sizes}, n -> xxhash64('first', n, left({line}, int(n)))),
        transform({sizes}, n -> xxhash64('last', n, right({line}, int(n))))))""")


def _distinct_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Distinct lines that aren't blank, without their text: id, first place, and half keys of those long enough."""
    lines = (docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
             .where(F.trim("line") != ""))
    keys = F.when(F.length("line") >= min_chars, _halves("line"))
    place = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "version", "line_no", keys.alias("halves"))
    first = lines.groupBy(binary_hash(F.col("line")).alias("digest")).agg(F.min(place).alias("place"))
    return first.select(F.monotonically_increasing_id().alias("line_id"),
                        F.struct(*[f"place.{c}" for c in ("unnamed", "doc_id", "version", "line_no")]).alias("place"),
                        "place.halves")


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted lines with their text, fetched from the document of their first place."""
    spark = docs.sparkSession
    if spark.conf.get(_PRUNE, None) != "0":
        spark.conf.set(_PRUNE, "0")    # documents without a wanted line are dropped before the shuffle
    places = stored(wanted.groupBy("place.doc_id", F.col("place.version").alias("wanted_version"))
                    .agg(F.collect_list(F.struct("line_id", "place")).alias("wanted"), F.count(F.lit(1)).alias("n")),
                    "line-places").where("n > 0").withColumnRenamed("doc_id", "wanted_doc")
    return (docs.join(places, (F.col("version") == F.col("wanted_version"))
                      & F.col("doc_id").eqNullSafe(F.col("wanted_doc")))
            .withColumn("lines", F.split("text", "\n"))
            .select(F.explode(F.expr("transform(wanted, w -> struct(w.line_id, w.place, "
                                     "get(lines, w.place.line_no) AS line))")).alias("found"))
            .select("found.*").dropDuplicates(["line_id"]))


def _variants(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed variants of the lines: the lines themselves, and the lines less the character at each ``position``.

    A variant's key is the exclusive-or of the hashes of its numbered blocks. Blocks before a deletion are those of
    the line, blocks after it those of the line shifted by one, so a deletion only hashes its own block anew.
    """
    last = f"int((length(line) - 1) div {BLOCK})"
    blocks = lines.withColumns({
        "plain": F.expr(f"transform(sequence(0, {last}), b -> xxhash64(b, substring(line, b * {BLOCK} + 1, {BLOCK})))"),
        "moved": F.expr(f"""transform(sequence(0, {last}), b -> if(length(line) > b * {BLOCK} + 1,
            xxhash64(b, substring(line, b * {BLOCK} + 2, {BLOCK})), 0L))"""),
    })
    fold = "aggregate({}, 0L, (x, y) -> x ^ y)"
    known = lambda c, kind: F.coalesce(c, F.lit(0).cast(kind))  # noqa: E731  never NULL, and the planner knows it
    whole = blocks.select("rank", known(F.expr(fold.format("plain")), "bigint").alias("key"),
                          known(F.length("line"), "int").alias("size"))
    parts = blocks.select("rank", F.length("line").alias("n"), F.explode(F.expr(f"""transform(sequence(0, {last}),
        b -> struct(b AS block, substring(line, b * {BLOCK} + 1, {BLOCK} + 1) AS part,
                    {fold.format('slice(plain, 1, b)')} ^ {fold.format(f'slice(moved, b + 2, {last} + 1)')} AS others))""")).alias("p"))
    less = parts.select("rank", "n", "p.*", F.explode(F.expr(
        f"sequence(1, least(length(p.part), {BLOCK}))")).alias("i"))
    key = F.expr("others ^ if(length(part) = 1, 0L, xxhash64(block, concat(left(part, i - 1), substring(part, i + 1))))")
    return whole, less.select(known(F.col("rank"), "bigint").alias("rank"), known(key, "bigint").alias("key"),
                              known(F.col("n") - 1, "int").alias("size"),
                              known(F.expr(f"block * {BLOCK} + i"), "int").alias("position"))


def _near_repeats(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Ids of the lines that have an earlier line at one edit."""
    halves = lines.select("line_id", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").count().where("count > 1").select("half")
    chosen = halves.join(shared, "half", "left_semi").select("line_id").distinct()
    texts = _with_text(docs, lines.select("line_id", "place").join(chosen, "line_id", "left_semi"))
    # numbered in the order of their places, so that one number tells which of two lines comes first
    texts = stored(texts.orderBy("place").select(F.monotonically_increasing_id().alias("rank"), "line_id", "line"), "line-texts")
    # moved once by key and length; the aggregate and both joins below find their rows in place
    whole, deleted = _variants(texts)
    deleted = deleted.repartition("key", "size")
    # A replaced character: equal after a deletion at one position. Whoever comes first there is within one edit of
    # all the others, so each is paired with that one only.
    heads = (deleted.groupBy("key", "size", "position").agg(F.min("rank").alias("early"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").withColumnRenamed("position", "at"))
    replaced = (deleted.join(heads, ["key", "size"]).where("position - at = 0 AND rank > early")
                .select(F.col("rank").alias("late"), "early"))
    # An added or missing character: one line is a variant of the other.
    added = (deleted.join(whole.withColumnRenamed("rank", "short"), ["key", "size"])
             # naming the position, which is never 0, keeps all columns, so that the exchange is shared
             .select(F.when(F.col("position") > 0, F.greatest("rank", "short")).otherwise(F.col("position")).alias("late"),
                     F.least("rank", "short").alias("early")))
    pairs = replaced.unionByName(added).distinct()
    late = texts.select(F.col("rank").alias("late"), "line_id", F.col("line").alias("late_line"))
    early = texts.select(F.col("rank").alias("early"), F.col("line").alias("early_line"))
    return (pairs.join(late, "late").join(early, "early")
            .where(F.levenshtein("late_line", "early_line", 1).between(0, 1)).select("line_id").distinct())


def drop_repeated_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Documents without the lines that an earlier line repeats, in order of document id, then line number.

    Columns: ``doc_id``, ``text`` (the lines that stay), ``n_lines``, ``n_kept``. A line goes if an equal line, or, with
    ``max_edits`` 1, a line at one inserted, deleted or replaced character, stands earlier, whether that one stays or
    not. Lines under ``min_chars`` characters are only compared for equality. Blank lines stay and are never compared.

    Only lines that share a half with another line can have a neighbour at one edit; these alone get their deletion
    variants, are joined on them and verified by edit distance. With one edit, whoever comes first among the lines
    that are equal after a deletion at one position is a neighbour of all of them, so no group is paired with itself.
    Two edits don't have that property and are refused.

    NULL text counts as empty. Documents without id come last. Rows of one id with different texts are ordered by the
    hash of the text; rows equal in id and text are the same document and keep the same lines. An empty table gives an
    empty result.
    """
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = (docs.select(docs[id_column].alias("doc_id"), F.coalesce(docs[text_column], F.lit("")).alias("text"))
            .withColumn("version", F.xxhash64("text")))
    lines = stored(_distinct_lines(docs, min_chars), "lines")
    kept = lines
    if max_edits:
        kept = lines.join(stored(_near_repeats(docs, lines), "line-repeats"), "line_id", "left_anti")
    kept = (kept.groupBy(F.col("place.doc_id").alias("kept_doc"), F.col("place.version").alias("kept_version"))
            .agg(F.collect_list("place.line_no").alias("kept")))
    rebuilt = docs.join(kept, (F.col("version") == F.col("kept_version"))
                        & F.col("doc_id").eqNullSafe(F.col("kept_doc")), "left")
    rebuilt = rebuilt.select("doc_id", F.split("text", "\n").alias("lines"),
                             F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))
    chosen = F.expr("array_sort(concat(kept, filter(sequence(0, size(lines) - 1), i -> trim(lines[i]) = '')))")
    return (rebuilt.withColumn("chosen", chosen)
            .select("doc_id", F.expr("array_join(transform(chosen, i -> lines[i]), '\n')").alias("text"),
                    F.size("lines").cast("bigint").alias("n_lines"), F.size("chosen").cast("bigint").alias("n_kept")))
