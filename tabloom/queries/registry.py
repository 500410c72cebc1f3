"""Registry lookups on the star tables: customers as users, orders as models, lines as logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabloom.operators import joins as J
from tabloom.operators.encode import category_index
from tabloom.queries.base import query, r, rounded, table
from tabloom.session import work_folder
from tabloom.sources import readers, registry, sinks


def users(spark, folder):
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def models(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("model_type"),
        F.col("o_totalprice").alias("accuracy"), F.col("o_orderdate").alias("created_at"),
        F.lit("target").alias("target_variable"), F.array(F.lit("a")).alias("feature_names"))


def logs(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.col("l_orderkey").alias("model_id"), F.col("l_suppkey").alias("user_id"),
        F.col("l_shipdate").alias("timestamp"))


LOG_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)"


@query(f"""SELECT {LOG_ID} AS id, l_orderkey AS model_id, l_suppkey AS user_id, l_shipdate::VARCHAR AS at, o_orderpriority AS model_name, o_orderstatus AS model_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 7 ORDER BY l_shipdate DESC, id LIMIT 100""")
def prediction_log_latest(spark, folder):
    """Newest hundred log rows of one user with their model."""
    found = registry.user_prediction_logs(logs(spark, folder), models(spark, folder), 7)
    return found.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).withColumnRenamed("timestamp", "at")


@query(f"""SELECT {LOG_ID} AS id, o_orderpriority AS model_name, o_orderstatus AS model_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_suppkey = 3""")
def embeddings_of_user(spark, folder):
    """Rows of one user joined to their model."""
    rows = logs(spark, folder).withColumnRenamed("timestamp", "created_at")
    return registry.user_embeddings(rows, models(spark, folder), 3).select("id", "model_name", "model_type")


@query("""SELECT l_orderkey AS model_id, o_orderstatus AS model_type, 'target' AS target_variable, o_totalprice AS accuracy, 'a' AS features, count(*) AS n
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def embedding_metadata(spark, folder):
    """Every row with the metadata struct of its model."""
    m = models(spark, folder)
    rows = registry.with_model(logs(spark, folder), m, "target_variable", "feature_names", "accuracy")
    packed = rows.withColumn("metadata", F.struct("model_type", "target_variable",
                                                  F.col("feature_names").alias("features"), "accuracy"))
    return packed.groupBy("model_id", "metadata.model_type", "metadata.target_variable", "metadata.accuracy",
                          F.array_join("metadata.features", ",").alias("features")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority AS name, o_orderstatus AS model_type, o_orderdate::VARCHAR AS at, c_name AS owner FROM orders JOIN customer ON o_custkey = c_custkey
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def recent_models(spark, folder):
    """Ten newest models with their owner."""
    found = registry.recent_models(models(spark, folder), users(spark, folder))
    return found.select("name", "model_type", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at"), "owner")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def load_new_only(spark, folder):
    """Orders that no line refers to."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    there = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.only_new(orders, there, "o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""")
def parents_exist(spark, folder):
    """Customers that have a large order."""
    big = table(spark, folder, "orders").where("o_totalprice > 450000")
    return J.with_parent(table(spark, folder, "customer").select("c_custkey", "c_name"), big, "c_custkey", "o_custkey")


@query("""SELECT l_linestatus, CASE l_returnflag WHEN 'A' THEN 'Accepted' WHEN 'R' THEN 'Returned' ELSE 'Unknown' END AS state, count(*) AS n FROM lineitem GROUP BY ALL""")
def dictionary_lookup(spark, folder):
    """Names through a small mapping with a default."""
    state = J.look_up("l_returnflag", {"A": "Accepted", "R": "Returned"}, "Unknown")
    return table(spark, folder, "lineitem").groupBy("l_linestatus", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS rows, sum((quality = (length(text) > 200)::INT)::INT)::BIGINT AS hits, round(avg((quality = (length(text) > 200)::INT)::INT), 6) AS accuracy
    FROM labels JOIN documents USING (doc_id)""")
def actual_vs_predicted(spark, folder):
    """Labels against a rule on the whole text."""
    predicted = table(spark, folder, "documents").select("doc_id", (F.length("text") > 200).cast("int").alias("predicted"))
    found = J.compare_predictions(table(spark, folder, "labels"), predicted, "doc_id", "quality", "predicted")
    return rounded(found, accuracy=6)


@query("""SELECT r_name, count(*) AS n, round(avg(l_discount), 6) AS importance FROM region JOIN nation ON n_regionkey = r_regionkey
    JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def importance_walk(spark, folder):
    """A chain of one-to-many joins."""
    projects = (table(spark, folder, "region").join(table(spark, folder, "nation"), F.col("r_regionkey") == F.col("n_regionkey"))
                .select("r_name", F.col("n_nationkey").alias("project_id")))
    cases = table(spark, folder, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("use_case_id"))
    built = table(spark, folder, "orders").select(F.col("o_custkey").alias("use_case_id"), F.col("o_orderkey").alias("model_id"))
    weights = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("model_id"), "l_discount")
    walked = registry.importance_walk(projects, cases, built, weights)
    return walked.groupBy("r_name").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_discount")).alias("importance"))


def uid(number):
    """A number written as a UUID."""
    digits = F.lpad(F.hex(number), 12, "0")
    return F.lower(F.concat(F.lit("00000000-0000-4000-8000-"), digits))


def uid_sql(number):
    return f"lower('00000000-0000-4000-8000-' || lpad(hex({number}), 12, '0'))"


@query(f"""SELECT {uid_sql('o_orderkey')} AS id, {uid_sql('o_custkey')} AS user_id, CASE WHEN o_orderkey % 4 = 0 THEN 'Untitled Model' ELSE o_orderpriority END AS name,
    CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE o_orderstatus END AS model_type, round(o_totalprice, 2) AS accuracy, '' AS description,
    CASE WHEN o_orderkey % 6 = 0 THEN '2000-01-01 00:00:00' ELSE o_orderdate::VARCHAR END AS created
    FROM orders WHERE o_custkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def bulk_load_models(spark, folder):
    """Model documents written as JSON, read and loaded with defaults."""
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    metadata = F.struct(F.when(key % 5 != 0, F.col("o_orderstatus")).alias("model_type"),
                        F.col("o_totalprice").alias("accuracy"))
    documents = orders.select(
        uid(key).alias("id"),
        F.when(F.col("o_custkey") % 11 == 0, F.lit("nobody")).otherwise(uid(F.col("o_custkey"))).alias("user_id"),
        F.when(key % 4 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(key % 6 == 0, F.lit("soon")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        metadata.alias("metadata"))
    path = work_folder(spark, "documents")
    documents.write.json(path)
    read = spark.read.schema(registry.MODEL_DOCUMENT).json(path)
    parents = table(spark, folder, "customer").where("c_acctbal > 0").select(uid(F.col("c_custkey")).alias("id"))
    existing = orders.where(key % 7 == 0).select(uid(key).alias("id"))
    loaded = registry.models_from_documents(
        registry.load_new(read, existing, parents, "user_id"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
    return loaded.select("id", "user_id", "name", "model_type", r(F.col("accuracy"), 2).alias("accuracy"), "description",
                         F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


NOW = "2000-01-01 00:00:00"


@query("""SELECT c_name AS username, CASE WHEN c_custkey % 3 = 0 THEN c_name || '@example.com' ELSE c_mktsegment END AS email,
    '2000-01-01 00:00:00' AS created, CASE WHEN c_custkey % 2 = 0 THEN '2024-01-02 03:04:05' END AS login, true AS own_id, true AS is_active
    FROM customer WHERE c_custkey % 7 <> 0""")
def load_users(spark, folder):
    """User documents, each twice in the load, less those whose name is there."""
    key = F.col("c_custkey")
    customers = table(spark, folder, "customer")
    documents = customers.select(
        F.when(key % 4 == 0, F.lit("none")).otherwise(uid(key)).alias("id"), F.col("c_name").alias("username"),
        F.when(key % 3 != 0, F.col("c_mktsegment")).alias("email"), F.lit("soon").alias("created_at"),
        F.when(key % 2 == 0, F.lit("2024-01-02 03:04:05")).otherwise(F.lit("never")).alias("last_login"))
    path = work_folder(spark, "users")
    documents.unionByName(documents).write.json(path)
    read = spark.read.schema(registry.USER_DOCUMENT).json(path)
    loaded = registry.users_from_documents(read, customers.where(key % 7 == 0).select(F.col("c_name").alias("username")),
                                           F.lit(NOW).cast("timestamp"))
    moment = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return loaded.select("username", "email", moment("created_at").alias("created"), moment("last_login").alias("login"),
                         F.col("id").isNotNull().alias("own_id"), "is_active")


@query(f"""SELECT {uid_sql('o_orderkey')} AS id, {uid_sql('o_custkey')} AS user_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Unknown file' ELSE o_orderpriority END AS filename,
    CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS file_path, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS proposals, '2000-01-01 00:00:00' AS created
    FROM orders WHERE o_custkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def load_use_cases(spark, folder):
    """Use-case documents with their proposals, each twice in the load."""
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    documents = orders.select(
        uid(key).alias("id"), F.when(F.col("o_custkey") % 11 == 0, F.lit("nobody")).otherwise(uid(F.col("o_custkey"))).alias("user_id"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("filename"),
        F.when(key % 2 == 0, F.create_map(F.lit("preserved_file_path"), F.col("o_orderstatus"))).alias("metadata"),
        F.when(key % 5 != 0, F.array(F.struct(F.lit("t").alias("title")))).alias("proposals"))
    path = work_folder(spark, "use-cases")
    documents.unionByName(documents).write.json(path)
    read = spark.read.schema(registry.USE_CASE_DOCUMENT).json(path)
    parents = table(spark, folder, "customer").where("c_acctbal > 0").select(uid(F.col("c_custkey")).alias("id"))
    new = registry.load_new(read, orders.where(key % 7 == 0).select(uid(key).alias("id")), parents, "user_id")
    loaded = registry.use_cases_from_documents(new, F.lit(NOW).cast("timestamp"))
    return loaded.select("id", "user_id", "filename", "file_path", F.size("proposals").alias("proposals"),
                         F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(f"""SELECT {uid_sql('o_orderkey')} AS id, {uid_sql('o_custkey')} AS model_id, CASE WHEN o_orderkey % 3 = 0 THEN 'Unnamed Embedding' ELSE o_orderpriority END AS name,
    CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS settings FROM orders
    WHERE o_orderkey % 7 <> 0 AND o_orderkey % 13 <> 0 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def load_embeddings(spark, folder):
    """Embedding documents whose user and model exist, each twice in the load."""
    orders, key = table(spark, folder, "orders"), F.col("o_orderkey")
    documents = orders.select(
        F.when(key % 13 == 0, F.lit("none")).otherwise(uid(key)).alias("id"), uid(F.col("o_custkey")).alias("user_id"),
        uid(F.col("o_custkey")).alias("model_id"), F.when(key % 3 != 0, F.col("o_orderpriority")).alias("name"),
        F.when(key % 2 == 0, F.create_map(F.lit("k"), F.lit("v"))).alias("settings"))
    path = work_folder(spark, "embeddings")
    documents.unionByName(documents).write.json(path)
    read = spark.read.schema(registry.EMBEDDING_DOCUMENT).json(path)
    customers = table(spark, folder, "customer")
    models = customers.where("c_acctbal > 0").select(uid(F.col("c_custkey")).alias("id"))
    loaded = registry.embeddings_from_documents(read, orders.where(key % 7 == 0).select(uid(key).alias("id")),
                                                customers.select(uid(F.col("c_custkey")).alias("id")), models)
    return loaded.select("id", "model_id", "name", F.size("settings").alias("settings"))


@query("""SELECT user_id::VARCHAR AS user_id, event_type, (props->>'k')::INT AS k, count(*) AS n FROM events GROUP BY ALL""")
def log_append(spark, folder):
    """Predictions appended to the log and read back from its JSON."""
    events = table(spark, folder, "events").select(
        "user_id", "event_type", F.from_json("props", "k int")["k"].alias("k"))
    store = registry.Registry(spark, work_folder(spark, "registry"))
    store.append("prediction_logs", registry.log_rows(events, "u", "m", ["user_id", "event_type"], ["k"]))
    held = store.table("prediction_logs").select(
        F.from_json("input_data", "user_id string, event_type string").alias("i"),
        F.from_json("prediction_result", "k int").alias("p"))
    return held.groupBy("i.user_id", "i.event_type", "p.k").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey AS id, len(list_distinct([o_orderpriority, o_orderstatus]))::INT AS proposal_count, o_orderkey % 3 = 0 AS file_exists
    FROM orders WHERE o_custkey = 7""")
def use_case_list(spark, folder):
    """Use cases of a user with counts and a flag for their file."""
    orders = table(spark, folder, "orders")
    path = F.concat(F.lit("/data/"), F.col("o_orderkey").cast("string"))
    cases = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), path.alias("file_path"),
                          F.array("o_orderpriority", "o_orderstatus").alias("proposals"), F.col("o_orderdate").alias("created_at"))
    files = orders.where(F.col("o_orderkey") % 3 == 0).select(path.alias("path"))
    return registry.use_case_list(cases, files, 7).select("id", "proposal_count", "file_exists")


@query("""SELECT count(*) AS loaded, (SELECT count(*) FROM orders) AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def load_report(spark, folder):
    """A29."""
    orders = table(spark, folder, "orders").select("o_orderkey")
    there = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return registry.load_report(J.only_new(orders, there, "o_orderkey"), orders)


# --- files -----------------------------------------------------------------------------------

@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_any_separator(spark, folder):
    """Written with bars, read back without being told so."""
    path = work_folder(spark, "customer")
    df = table(spark, folder, "customer")
    df.write.csv(path, header=True, sep="|")
    read = readers.read_data_flexible(spark, path)
    return read.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"), "c_acctbal", "c_mktsegment")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_retry(spark, folder):
    """One column came back, so the semicolon is tried."""
    path = work_folder(spark, "nation")
    table(spark, folder, "nation").write.csv(path, header=True, sep=";")
    return readers.read_or_retry(spark, path)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 50 <> 0")
def csv_broken_lines(spark, folder):
    """Lines that do not fit the schema are left out."""
    path = work_folder(spark, "broken")
    orders = table(spark, folder, "orders")
    broken = F.col("o_orderkey") % 50 == 0
    orders.select(F.when(broken, F.concat(F.lit("x"), F.col("o_orderkey").cast("string")))
                  .otherwise(F.col("o_orderkey").cast("string")).alias("o_orderkey"), "o_totalprice").write.csv(path, header=True, sep=";")
    return readers.read_delimited(spark, path, ";", schema="o_orderkey bigint, o_totalprice double")


ENCODED = {"en": "UTF-8", "de": "ISO-8859-1", "fr": "windows-1252", "es": "UTF-16LE"}


@query("""SELECT doc_id, md5(text) AS digest FROM documents""")
def json_lines(spark, folder):
    """Files named .json with a record per line."""
    path = work_folder(spark, "records")
    table(spark, folder, "documents").select("doc_id", "text").write.json(f"{path}/records.json")
    return readers.read_data_flexible(spark, f"{path}/records.json").select("doc_id", F.md5("text").alias("digest"))


@query("""SELECT doc_id, md5(text || '"q", ' || lang) AS digest FROM documents""")
def csv_quoted(spark, folder):
    """Values in quotes with line ends, doubled quotes and separators."""
    path = work_folder(spark, "quoted")
    docs = table(spark, folder, "documents").select("doc_id", F.concat("text", F.lit('"q", '), "lang").alias("text"))
    docs.write.csv(path, header=True, escape='"', quoteAll=True)
    return readers.read_data_flexible(spark, path).select(F.col("doc_id").cast("bigint"), F.md5("text").alias("digest"))


@query("""SELECT doc_id, md5(text) AS digest, lang AS "place.lang", n_chars AS "place.size" FROM documents""")
def json_array(spark, folder):
    """Files that hold one array each, cut into elements by byte ranges."""
    path = work_folder(spark, "arrays")
    docs = table(spark, folder, "documents")
    files = max(1, docs.count() // 500)
    order = Window.partitionBy("file").orderBy("doc_id")
    element = F.to_json(F.struct("doc_id", "text", F.struct("lang", F.col("n_chars").alias("size")).alias("place")))
    rows = docs.withColumn("file", F.pmod("doc_id", F.lit(files))).select("file", "doc_id", F.concat(
        F.when(F.row_number().over(order) == 1, "[").otherwise(","), element,
        F.when(F.lead("doc_id").over(order).isNull(), "]").otherwise("")).alias("value"))
    rows.repartition("file").sortWithinPartitions("file", "doc_id").select("file", "value").write.partitionBy("file").text(path)
    read = readers.read_json(spark, f"{path}/file=*")
    return read.select("doc_id", F.md5("text").alias("digest"), "`place.lang`", "`place.size`")


@query("""SELECT doc_id, md5(regexp_replace(text, '[\\s"]+', ' ', 'g')) AS digest FROM documents WHERE lang IN ('en', 'de', 'fr', 'es')""")
def encodings(spark, folder):
    """A folder with files of several encodings, each found out from all its bytes."""
    path = work_folder(spark, "encoded")
    docs = table(spark, folder, "documents").select("doc_id", "lang", F.regexp_replace("text", r'[\s"]+', " ").alias("text"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    for lang, encoding in ENCODED.items():
        # the mark at the end holds letters that tell the encodings apart, and is cut off again
        mark = {"de": " ß", "fr": " €”é", "es": " ñ"}.get(lang, "")
        docs.where(F.col("lang") == lang).select("doc_id", F.concat("text", F.lit(mark + "|" + lang)).alias("text")).write.option(
            "encoding", encoding).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).csv(
            f"{path}/{lang}", header=True, quoteAll=True)
    read = readers.read_data_flexible(spark, f"{path}/*")
    text = F.regexp_replace("text", r"( ß| €”é| ñ)?\|(en|de|fr|es)$", "")
    return read.select(F.col("doc_id").cast("bigint"), F.md5(text).alias("digest"))


@query("""SELECT o_orderkey, o_custkey AS "customer.id", c_mktsegment AS "customer.segment", c_nationkey AS "customer.place.nation" FROM orders JOIN customer ON o_custkey = c_custkey""")
def json_nested(spark, folder):
    """Nested JSON records as dotted columns."""
    path = work_folder(spark, "nested.jsonl")
    joined = table(spark, folder, "orders").join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    joined.select("o_orderkey", F.struct(F.col("o_custkey").alias("id"), F.col("c_mktsegment").alias("segment"),
                                         F.struct(F.col("c_nationkey").alias("nation")).alias("place")).alias("customer")).write.json(path)
    read = readers.read_json(spark, path)
    return read.withColumn("customer.place.nation", F.col("`customer.place.nation`").cast("int")).select(
        "o_orderkey", "`customer.id`", "`customer.segment`", "`customer.place.nation`")


@query("SELECT o_orderpriority AS folder, count(*) AS n FROM orders GROUP BY 1")
def folder_of_files(spark, folder):
    """A folder of documents partitioned by owner, with the file of each row."""
    path = work_folder(spark, "parts")
    table(spark, folder, "orders").select(F.translate("o_orderpriority", " ", "_").alias("user_id"), "o_orderkey").write.partitionBy("user_id").json(path)
    read = readers.read_folder(spark, path)
    owner = F.translate(F.regexp_extract("source_file", "user_id=([^/]+)/", 1), "_", " ")
    return read.groupBy(owner.alias("folder")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT row_number() OVER (ORDER BY o_orderpriority)::INT - 1 AS "Class_ID", o_orderpriority AS "Class_Name" FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def class_mapping(spark, folder):
    """Class numbers of a label."""
    index = category_index(table(spark, folder, "orders"), "o_orderpriority")
    values = [r[0] for r in index.orderBy("index").select("o_orderpriority").collect()]
    return sinks.class_map(spark, values).select(F.col("Class_ID").cast("int").alias("Class_ID"), "Class_Name")
