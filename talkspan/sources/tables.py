"""Readers and writers: tables, and dialogue files in JSON and CSV."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONVERSATION = "conv_id string, content array<struct<agent:string,message:string,knowledge_source:array<string>>>"
ANNOTATION = "annotation_id string, violation_type string, context string, evidence string, response string, quantity_score string, quality_score string, relation_score string, manner_score string, annotator_notes string"

#: CSV whose texts come back as they were: quotes doubled, white space at the ends kept.
AS_IS = {"escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Turns (conv_id, turn, role, text, evidence) of one-conversation-a-line JSON; broken lines are left out."""
    raw = spark.read.schema(CONVERSATION + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path).where("_corrupt_record is null")
    return raw.select("conv_id", F.posexplode("content").alias("turn", "c")).select("conv_id", "turn", F.col("c.agent").alias("role"), F.col("c.message").alias("text"), F.col("c.knowledge_source").alias("evidence"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Gold annotations; a score that is no integer is null."""
    raw = spark.read.schema(ANNOTATION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.withColumns({c: F.expr(f"try_cast({c} as int)") for c in ("quantity_score", "quality_score", "relation_score", "manner_score")})


def write_annotations(rows: DataFrame, path: str) -> None:
    """Annotation sheet: texts shortened for display, empty score columns."""
    short = {"context": 500, "evidence": 300, "response": 500}
    out = rows.withColumns({c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in short.items()})
    out.withColumns({c: F.lit("") for c in ("quantity_score", "quality_score", "relation_score", "manner_score", "annotator_notes")}).write.mode("overwrite").option("header", True).options(**AS_IS).csv(path)


def write_splits(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").partitionBy("split").json(path)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path that all executors share: under spark.checkpoint.dir, or in a local folder where there is no cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="talkspan-")
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_conversations(turns: DataFrame, path: str) -> None:
    """One conversation a line, its turns in order; what read_conversations() reads. A conversation fits one row."""
    said = F.struct("turn", F.col("role").alias("agent"), F.col("text").alias("message"), F.array().cast("array<string>").alias("knowledge_source"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("content"))
    own = F.transform("content", lambda c: F.struct(c["agent"].alias("agent"), c["message"].alias("message"), c["knowledge_source"].alias("knowledge_source")))
    whole.select(F.col("conv_id").cast("string").alias("conv_id"), own.alias("content")).write.mode("overwrite").json(path)


def read_splits(spark: SparkSession, path: str, schema: str, split: str | None = None) -> DataFrame:
    """What write_splits() wrote; with a split only its folder is read."""
    rows = spark.read.schema(schema + ", split string").json(path)
    return rows if split is None else rows.where(F.col("split") == split)


def read_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All JSON files under a folder; lines that cannot be read are left out."""
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return raw.where("_corrupt_record is null").drop("_corrupt_record")


def first_existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first of the parquet tables that exists; without any it is an error, never made-up rows."""
    for path in paths:
        try:
            return spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError(f"none of {paths}")


def explode_by_maxim(rows: DataFrame, groups: str) -> DataFrame:
    """One row an entry of a map maxim -> array of items, with the maxim as source_maxim."""
    entries = rows.select(*(c for c in rows.columns if c != groups), F.explode(F.map_entries(groups)).alias("g"))
    return entries.select("*", F.col("g.key").alias("source_maxim"), F.explode("g.value").alias("item")).drop("g")


def write_pairs(pairs: DataFrame, path: str, columns: list[str]) -> None:
    pairs.select(*columns).write.mode("overwrite").option("header", True).options(**AS_IS).csv(path)


def write_blinded(rows: DataFrame, key: list[str], sample: str, hidden: str) -> None:
    """rows: sample_id, the columns of key, and what raters see; the key goes to a table of its own."""
    rows.drop(*(k for k in key)).write.mode("overwrite").json(sample)
    rows.select("sample_id", *key).write.mode("overwrite").json(hidden)


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, all of whose values of the columns must be there; a missing column or value is an error when read."""
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    bad = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in columns))
    return rows.where(F.assert_true(bad == "", F.concat(F.lit("missing values: "), bad)).isNull())
