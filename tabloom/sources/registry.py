"""Registry of users, models, use cases, embeddings and prediction logs as Parquet tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.scalars import named
from tabloom.operators.columns import valid_id
from tabloom.operators.documents import PROPOSAL
from tabloom.operators.joins import latest, only_new, with_parent


@dataclass
class Registry:
    """Tables below one folder; each is a folder of Parquet files that only grows."""

    spark: SparkSession
    folder: str

    def path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path(name))

    def log_predictions(self, results: DataFrame, user_id: str, model_id: str,
                        inputs: list[str], outputs: list[str]) -> None:
        self.append("prediction_logs", log_rows(results, user_id, model_id, inputs, outputs))

    def save_use_cases(self, rows: DataFrame) -> None:
        rows.write.mode("append").partitionBy("user_id").json(self.path("use_case_documents"))


def log_rows(results: DataFrame, user_id: str, model_id: str, inputs: list[str],
             outputs: list[str]) -> DataFrame:
    """Scored rows as log records with JSON input and result."""
    return results.select(
        F.uuid().alias("id"), F.lit(user_id).alias("user_id"), F.lit(model_id).alias("model_id"),
        F.to_json(F.struct(*[named(c) for c in inputs])).alias("input_data"),
        F.to_json(F.struct(*[named(c) for c in outputs])).alias("prediction_result"),
        F.current_timestamp().alias("timestamp"))


def owned(df: DataFrame, user_id, newest: str = "created_at") -> DataFrame:
    """Rows of one owner, newest first."""
    return latest(df.where(named("user_id") == F.lit(user_id)), newest)


def with_model(rows: DataFrame, models: DataFrame, *extra: str) -> DataFrame:
    """Rows joined to the models they belong to; rows without one are left out."""
    chosen = models.select(F.col("id").alias("model_id"), F.col("name").alias("model_name"),
                           "model_type", *extra)
    return rows.join(chosen, "model_id")


def user_prediction_logs(logs: DataFrame, models: DataFrame, user_id, limit: int = 100) -> DataFrame:
    mine = with_model(logs.where(F.col("user_id") == F.lit(user_id)), models)
    return latest(mine, "timestamp", limit, tie=["id"])


def user_embeddings(embeddings: DataFrame, models: DataFrame, user_id) -> DataFrame:
    return latest(with_model(embeddings.where(F.col("user_id") == F.lit(user_id)), models), "created_at",
                  tie=["id"])


def embedding_by_id(embeddings: DataFrame, models: DataFrame, embed_id) -> DataFrame:
    """One embedding with what is known of its model as a struct."""
    found = with_model(embeddings.where(F.col("id") == F.lit(embed_id)), models,
                       "target_variable", "feature_names", "accuracy")
    return found.withColumn("metadata", F.struct(
        "model_type", "target_variable", F.col("feature_names").alias("features"), "accuracy"))


def recent_models(models: DataFrame, users: DataFrame, n: int = 10) -> DataFrame:
    """Newest models with the name of their owner."""
    owners = users.select(F.col("id").alias("user_id"), F.col("username").alias("owner"))
    return latest(models.join(owners, "user_id"), "created_at", n, tie=["id"]).select(
        "name", "model_type", "created_at", "owner")


def use_case_list(use_cases: DataFrame, files: DataFrame, user_id) -> DataFrame:
    """Use cases of a user with proposal counts and whether their file is still listed."""
    listed = files.select(F.col("path").alias("file_path")).distinct().withColumn("__there", F.lit(True))
    return (owned(use_cases, user_id).join(listed, "file_path", "left")
            .withColumn("file_exists", F.coalesce("__there", F.lit(False)))
            .withColumn("proposal_count", F.coalesce(F.array_size("proposals"), F.lit(0)))
            .drop("__there"))


def file_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths below a folder, without reading the files."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
            .select("path", "length", F.col("modificationTime").alias("modified")))


MODEL_DOCUMENT = (
    "id string, user_id string, name string, path string, created_at string, "
    "metadata struct<description: string, model_type: string, target_variable: string, "
    "accuracy: double, features: array<string>, feature_importance: map<string, double>>")
USE_CASE_DOCUMENT = (
    "id string, user_id string, filename string, file_path string, created_at string, "
    f"proposals array<struct<{', '.join(f.strip().replace(' ', ': ', 1) for f in PROPOSAL.split(','))}>>, "
    "metadata map<string, string>")


USER_DOCUMENT = "id string, username string, email string, password_hash string, created_at string, last_login string"
EMBEDDING_DOCUMENT = ("id string, user_id string, model_id string, name string, embed_path string, created_at string, "
                      "settings map<string, string>")


def parsed_moment(text: Column, now: Column | None = None) -> Column:
    return F.coalesce(F.try_to_timestamp(text), now if now is not None else F.current_timestamp())


def load_new(documents: DataFrame, existing: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Documents with a valid parent that exists and an id that is not there yet."""
    kept = documents.where(valid_id(parent))
    kept = kept.withColumn("id", F.when(valid_id("id"), F.col("id")).otherwise(F.uuid()))
    return only_new(with_parent(kept, parents, parent, "id"), existing, "id")


def users_from_documents(documents: DataFrame, existing: DataFrame, now: Column | None = None) -> DataFrame:
    """User documents whose name is not there yet, as registry rows; repeats of a name inside the load count once.

    An id that is none gives a new one; a missing password hash stays NULL, since accounts are not run here.
    """
    new = only_new(documents.where("username IS NOT NULL"), existing, "username")
    return new.select(
        F.when(valid_id("id"), F.col("id")).otherwise(F.uuid()).alias("id"), "username",
        F.coalesce("email", F.concat("username", F.lit("@example.com"))).alias("email"), "password_hash",
        parsed_moment(F.col("created_at"), now).alias("created_at"),
        F.try_to_timestamp("last_login").alias("last_login"), F.lit(True).alias("is_active"))


def use_cases_from_documents(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """Use-case documents as registry rows with defaults for what they lack."""
    return documents.select(
        "id", "user_id", F.coalesce("filename", F.lit("Unknown file")).alias("filename"),
        F.col("metadata")["preserved_file_path"].alias("file_path"),
        F.coalesce("proposals", F.array().cast(documents.schema["proposals"].dataType)).alias("proposals"),
        parsed_moment(F.col("created_at"), now).alias("created_at"),
        F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"))


def embeddings_from_documents(documents: DataFrame, existing: DataFrame, users: DataFrame, models: DataFrame,
                              now: Column | None = None) -> DataFrame:
    """Embedding documents with an own id that is not there yet, and a user and a model that exist."""
    kept = documents.where(valid_id("id") & valid_id("user_id") & valid_id("model_id"))
    kept = with_parent(with_parent(kept, users, "user_id", "id"), models, "model_id", "id")
    return only_new(kept, existing, "id").select(
        "id", "user_id", "model_id", F.coalesce("name", F.lit("Unnamed Embedding")).alias("name"), "embed_path",
        F.coalesce("settings", F.create_map().cast("map<string,string>")).alias("settings"),
        parsed_moment(F.col("created_at"), now).alias("created_at"))


def models_from_documents(documents: DataFrame, now: Column | None = None) -> DataFrame:
    """Model documents as registry rows with defaults for what they lack."""
    m = F.col("metadata")
    created = parsed_moment(F.col("created_at"), now)
    return documents.select(
        "id", "user_id", F.coalesce("name", F.lit("Untitled Model")).alias("name"),
        F.coalesce(m["description"], F.lit("")).alias("description"), F.col("path").alias("model_path"),
        F.coalesce(m["model_type"], F.lit("unknown")).alias("model_type"),
        F.coalesce(m["target_variable"], F.lit("")).alias("target_variable"), m["accuracy"].alias("accuracy"),
        F.coalesce(m["features"], F.array().cast("array<string>")).alias("feature_names"),
        F.coalesce(m["feature_importance"], F.create_map().cast("map<string,double>")).alias("feature_importance"),
        created.alias("created_at"), created.alias("updated_at"))


def load_report(loaded: DataFrame, total: DataFrame) -> DataFrame:
    """Rows loaded and rows offered."""
    return loaded.agg(F.count(F.lit(1)).alias("loaded")).withColumn(
        "total", total.select(F.count(F.lit(1))).scalar())


def importance_walk(projects: DataFrame, use_cases: DataFrame, models: DataFrame,
                    importances: DataFrame) -> DataFrame:
    """Project to use case to model to feature importance."""
    return (projects.join(use_cases, "project_id").join(models, "use_case_id")
            .join(importances, "model_id"))
