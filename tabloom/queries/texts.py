"""JSON fields and proposals in answers, on texts that Spark renders from the tables."""

from pyspark.sql import functions as F

from tabloom.functions import fixed_values as V
from tabloom.operators import documents as D
from tabloom.queries.base import query, table

REST = V.PROPOSAL_DEFAULTS


@query("""SELECT event_type, (props->>'k')::INT AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL""")
def json_props(spark, folder):
    """Fields of a JSON column."""
    k = F.from_json("props", "k int")["k"]
    return table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query(f"""WITH p AS (SELECT c_custkey, 0 AS position, 'Predict ' || c_mktsegment AS title, c_name AS description, 'accuracy;speed' AS kpis, 'c_mktsegment' AS target_variable, 'classification' AS model_type FROM customer
    UNION ALL SELECT c_custkey, 1, '{REST['title']}', '{REST['description']}', '', 'c_acctbal', CASE WHEN c_custkey % 2 = 0 THEN 'regression' ELSE '{REST['model_type']}' END FROM customer)
    SELECT *, '{REST['use_case_implementation_complexity']}' AS use_case_implementation_complexity, '{REST['business_value']}' AS business_value FROM p""")
def extract_proposals(spark, folder):
    """JSON proposals inside prose, one answer per customer."""
    one = F.struct(F.concat(F.lit("Predict "), "c_mktsegment").alias("title"), F.col("c_name").alias("description"),
                   F.array(F.lit("accuracy"), F.lit("speed")).alias("kpis"), F.lit("c_mktsegment").alias("target_variable"),
                   F.lit("classification").alias("model_type"))
    none = F.lit(None).cast("string")
    two = F.struct(none.alias("title"), none.alias("description"), F.lit(None).cast("array<string>").alias("kpis"),
                   F.lit("c_acctbal").alias("target_variable"),
                   F.when(F.col("c_custkey") % 2 == 0, "regression").alias("model_type"))
    answers = table(spark, folder, "customer").select("c_custkey", F.concat(
        F.lit("Sure, here are two ideas:\n"), F.to_json(F.array(one, two)), F.lit("\nAnything else?")).alias("answer"))
    rows = D.proposal_rows(answers, "answer", "c_custkey")
    return rows.select("c_custkey", "position", "title", "description", F.array_join("kpis", ";").alias("kpis"),
                       "target_variable", "model_type", "use_case_implementation_complexity", "business_value")


def prose_answers(spark, folder):
    """Answers in four shapes, by customer number."""
    k, name, segment = F.col("c_custkey") % 4, F.col("c_name"), F.col("c_mktsegment")

    def text(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    titled = text("Here is what I suggest.\n\nUse Case 1: Predict **", segment, "**\nDescription of ", name,
                  ".\nTARGET_VARIABLE: c_mktsegment\nMODEL_TYPE: Classification\nKPIs:\n- accuracy\n  over time\n- **speed**\n\n",
                  "Use Case 2: Group ", segment, "\nGroups of ", name, "\nMODEL_TYPE: magic")
    numbered = text("1. Rank ", name, "\nRank by balance\nTARGET_VARIABLE: c_acctbal\nKey Performance Indicators\nlift of ", segment, "\n2) Score ", name, "\nScore them")
    spaced = text("First idea for ", name, " is to look at the balance of the customer\nand its trend\n\n\n\nshort\n\n\n",
                  "Second idea for ", segment, " is to look at the orders of the customer\nand their trend")
    prose = text("Nothing certain about ", name)
    return table(spark, folder, "customer").select("c_custkey", F.when(k == 0, titled).when(k == 1, numbered)
                                                   .when(k == 2, spaced).otherwise(prose).alias("answer"))


@query("""WITH p AS (
    SELECT c_custkey, 0 AS position, 'Predict ' || c_mktsegment AS title, 'Description of ' || c_name || '.' AS description, 'accuracy' || chr(10) || '  over time;speed' AS kpis, 'c_mktsegment' AS target_variable, 'classification' AS model_type FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, 1, 'Group ' || c_mktsegment, 'Groups of ' || c_name, '', 'Unknown', 'auto' FROM customer WHERE c_custkey % 4 = 0
    UNION ALL SELECT c_custkey, 0, 'Rank ' || c_name, 'Rank by balance', 'lift of ' || c_mktsegment, 'c_acctbal', 'auto' FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT c_custkey, 1, 'Score ' || c_name, 'Score them', '', 'Unknown', 'auto' FROM customer WHERE c_custkey % 4 = 1
    UNION ALL SELECT c_custkey, 0, 'First idea for ' || c_name || ' is to look at the balance of the customer', 'and its trend', '', 'Unknown', 'auto' FROM customer WHERE c_custkey % 4 = 2
    UNION ALL SELECT c_custkey, 1, 'Second idea for ' || c_mktsegment || ' is to look at the orders of the customer', 'and their trend', '', 'Unknown', 'auto' FROM customer WHERE c_custkey % 4 = 2
    UNION ALL SELECT c_custkey, 0, 'AI Use Case Proposal', 'Nothing certain about ' || c_name, '', 'Unknown', 'auto' FROM customer WHERE c_custkey % 4 = 3)
    SELECT * FROM p""")
def split_text_proposals(spark, folder):
    """Proposals from prose by headline, by number, by gap and as a whole."""
    rows = D.proposal_rows(prose_answers(spark, folder), "answer", "c_custkey")
    return rows.select("c_custkey", "position", "title", "description", F.array_join("kpis", ";").alias("kpis"),
                       "target_variable", "model_type")


@query("""SELECT CASE WHEN i = 0 AND c_custkey % 4 = 0 THEN 'classification' ELSE 'auto' END AS model_type, count(*) AS n
    FROM customer, (VALUES (0), (1)) t(i) WHERE i = 0 OR c_custkey % 4 <> 3 GROUP BY 1""")
def proposal_counts(spark, folder):
    """Proposals by kind of model."""
    return D.proposal_counts(D.proposal_rows(prose_answers(spark, folder), "answer", "c_custkey"))


@query(r"""SELECT doc_id, array_to_string(list_distinct_ordered, ' ') AS words FROM (
    SELECT doc_id, [x FOR x, i IN w IF list_position(w, x) = i][1:5] AS list_distinct_ordered FROM (
        SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7f]', ' ', 'g'), '\b([a-zA-Z_][a-zA-Z0-9_]*)\b', 1) AS w FROM documents))""")
def identifier_words(spark, folder):
    """The first five distinct words of every document."""
    plain = F.regexp_replace("text", r"[^\x00-\x7f]", " ")
    return table(spark, folder, "documents").select("doc_id", F.array_join(D.identifier_words(plain), " ").alias("words"))


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def without_fences(spark, folder):
    """Code fences around whole documents taken off again."""
    docs = table(spark, folder, "documents")
    fenced = F.concat(F.lit("```sql\n"), "text", F.lit("```"))
    text = D.without_fences(fenced)
    return docs.select("doc_id", F.length(text).cast("bigint").alias("n"), F.md5(text.cast("binary")).alias("digest"))
