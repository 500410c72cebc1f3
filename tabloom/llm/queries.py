"""The queries of the operators in this package, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm.decontaminate import contaminated
from tabloom.llm.exact_dedup import exact_groups
from tabloom.llm.filter_audit import audit, filter_masks
from tabloom.llm.language import label_documents
from tabloom.llm.licenses import license_spans
from tabloom.llm.line_dedup import drop_repeated_lines
from tabloom.llm.pieces import encode_documents
from tabloom.llm.sharding import shard_documents
from tabloom.llm.simhash import near_groups
from tabloom.llm.substrings import drop_repeated_passages
from tabloom.llm.token_count import token_counts
from tabloom.llm.warc import archived_pages
from tabloom.llm.whitening import whitened_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARD_BYTES = 256 * 1024


def query(sql: str | None = None):
    """Registers a query under its function name, with its SQL where there is one."""
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLES[run.__name__] = sql
        return run
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers
    return public_tokenizers.path(name)


LINE_SQL = """
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS no
    FROM documents),
firsts AS (
    SELECT line, doc_id, no, row_number() OVER (ORDER BY doc_id, no) AS place FROM (
        SELECT line, doc_id, no, row_number() OVER (PARTITION BY line ORDER BY doc_id, no) AS nth
        FROM lines WHERE trim(line) <> '') WHERE nth = 1),
deleted AS (
    SELECT place, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS rest
    FROM (SELECT place, line, unnest(range(1, length(line) + 1)) AS i FROM firsts)),
heads AS (SELECT rest, i, min(place) AS place FROM deleted GROUP BY ALL),
whole AS (SELECT place, hash(line) AS line FROM firsts),
late AS (
    SELECT d.place FROM deleted d JOIN heads h ON d.rest = h.rest AND d.i = h.i WHERE h.place < d.place
    UNION
    SELECT greatest(d.place, w.place) FROM deleted d JOIN whole w ON d.rest = w.line),
kept AS (
    SELECT doc_id, no FROM firsts WHERE place NOT IN (SELECT place FROM late)
    UNION ALL SELECT doc_id, no FROM lines WHERE trim(line) = '')
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE k.no IS NOT NULL), '') AS text,
       count(*) AS n_lines, count(k.no) AS n_kept
FROM lines l LEFT JOIN kept k ON k.doc_id = l.doc_id AND k.no = l.no GROUP BY l.doc_id
"""


@query(LINE_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the lines that an earlier line repeats up to one edit."""
    return drop_repeated_lines(table(spark, folder, "documents"), min_chars=1)


@query("""
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its group of identical texts; the largest id stays."""
    return exact_groups(table(spark, folder, "documents"), keep="largest")


def shard_sql(limit: int) -> str:
    """SQL for the shards of ``documents`` at a byte limit."""
    return f"""
WITH rows AS (
    SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
           lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0') AS bits FROM documents),
start AS (SELECT greatest(0, floor(log2(greatest(1, sum(n_bytes)) / {limit})))::BIGINT AS d FROM rows),
levels AS (SELECT doc_id, n_bytes, unnest(range(d, 61)) AS depth, bits FROM rows, start),
buckets AS (SELECT depth, substr(bits, 1, depth) AS shard, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
            FROM levels GROUP BY ALL),
ends AS (SELECT l.doc_id, min(l.depth) AS depth FROM levels l
         JOIN buckets b ON b.depth = l.depth AND b.shard = substr(l.bits, 1, l.depth)
         WHERE b.shard_bytes <= {limit} OR b.shard_rows = 1 GROUP BY l.doc_id)
SELECT r.doc_id, r.n_bytes, b.shard, b.depth::INTEGER AS depth, b.shard_bytes, b.shard_rows
FROM rows r JOIN ends e USING (doc_id) JOIN buckets b ON b.depth = e.depth AND b.shard = substr(r.bits, 1, e.depth)
"""


@query(shard_sql(SHARD_BYTES))
def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of every document; no shard of several documents is above 256 KiB of text."""
    return shard_documents(table(spark, folder, "documents"), SHARD_BYTES)


@query()
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document, over fingerprints that differ in at most two bits."""
    return near_groups(table(spark, folder, "documents"), words=3, max_bits=2)


@query()
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document by a SentencePiece model, verified against that library, and whether they decode back."""
    return encode_documents(table(spark, folder, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query()
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether there are over 512 tokens."""
    return token_counts(table(spark, folder, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


@query()
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    """What archives that were written from all pages and read back say of each page."""
    return archived_pages(table(spark, folder, "pages"))


@query()
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item, the similarity and the place."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query()
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all documents that match a licence text or notice."""
    return license_spans(table(spark, folder, "documents"))


@query()
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learnt from the labelled four fifths."""
    return label_documents(table(spark, folder, "documents"))


AUDIT_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
flags AS (
    SELECT doc_id, part, len(words) < 100 AS a, 100 * len(list_distinct(words)) < 80 * len(words) AS b,
           100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS c,
           regexp_matches(text, '[#$%&*|]') AS d,
           coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM d),
marked AS (
    SELECT part, (CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
        || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END) AS fails,
        coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
    FROM flags LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1)
    USING (doc_id)),
masks AS (SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
          FROM marked GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders),
each AS (
    SELECT part, filter_order, step, fails, n, good, toxic, contains(fails, substr(filter_order, step, 1)) AS own,
           len(regexp_extract_all(substr(filter_order, 1, step - 1), '[' || fails || '_]')) > 0 AS early
    FROM masks, steps),
rows AS (
    SELECT part, filter_order, step,
           sum(CASE WHEN NOT own AND NOT early THEN n ELSE 0 END)::BIGINT AS kept,
           sum(CASE WHEN own AND NOT early THEN n ELSE 0 END)::BIGINT AS removed,
           sum(CASE WHEN own AND early THEN n ELSE 0 END)::BIGINT AS redundant,
           sum(CASE WHEN own AND length(fails) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
           sum(CASE WHEN own AND NOT early THEN good ELSE 0 END)::BIGINT AS good_lost,
           sum(CASE WHEN own AND NOT early THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM each GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM rows
"""


@query(AUDIT_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from each language, in all 120 orders and at every step."""
    return audit(filter_masks(table(spark, folder, "documents"), table(spark, folder, "labels")), "ABCDE")


PASSAGE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
    SELECT doc_id, no, array_to_string(words[no:no + 12], ' ') AS passage
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS no FROM d)),
late AS (SELECT doc_id, no FROM (SELECT doc_id, no, min(doc_id) OVER (PARTITION BY passage) AS least FROM windows)
         WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(no, no + 13)) AS no FROM late),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS no FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY no) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, no)
         GROUP BY doc_id)
SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""


@query(PASSAGE_SQL)
def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that stay once passages of 13 words that a smaller id has are taken out."""
    return drop_repeated_passages(table(spark, folder, "documents"), 13, texts=False)


@query()
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every embedding on the 32 leading components of all of them, whitened."""
    return whitened_vectors(table(spark, folder, "embeddings"), 32)
