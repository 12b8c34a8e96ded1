"""The optional model step: prompts, calls, and reading replies.

A model is any picklable ``str -> str`` the user passes in; nothing here reaches a network
by itself. Operators use deterministic rules when no model is given.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.json_text import extract_json
from landwatch.functions.text import table_key
from landwatch.schemas import CHANGE_TYPES
from landwatch.session import materialize, path_exists, shared_dir

_ASK = {
    "change": "A landed table changed between two snapshots. Decide which of "
    + ", ".join(CHANGE_TYPES)
    + " it is. Related names make a rename plausible; a reorder next to a type change is "
    "usually a side effect and deserves low confidence; ordinal_delta is a hint only. Below "
    "0.6 means a person should look. Reply with one JSON object with the keys change_type, "
    "confidence (0 to 1), rationale and remediation_sql (a view keeping the old contract, "
    "or an empty string).",
    "readiness": "Grade how ready this connection's data is for AI use, from these signals. "
    "Reply with one JSON object with the keys grade (A to F), narrative and "
    "top_remediations (at most three strings).",
    "volatility": "Judge how stable this connection's schema is. Reply with one JSON object "
    "with the keys stability_class (STABLE, VOLATILE or CRITICAL), narrative and "
    "recommendation.",
    "docs": "Describe this column of the named table in one plain sentence. Reply with a JSON array "
    "of objects with the keys column_name and description.",
    "sensitivity": "Classify this column of the named table as PII, FINANCIAL, HEALTH or SAFE and "
    "choose HASH, REDACT, TOKENIZE or GENERALIZE for it unless it is SAFE. Reply with a "
    "JSON array of objects with the keys table, column, sensitivity_class and "
    "masking_strategy.",
    "requirements": "List the data entities and fields this use case needs. Reply with a JSON "
    "array of objects with the keys entity, required_fields (array of names) and why.",
    "missing": "No landed column supplies this field. Suggest the kind of source that would. "
    "Reply with one JSON object with the keys suggested_connector_type and why.",
    "entity": "Name the business entity this table holds and its join key. Reply with one JSON "
    "object with the keys entity_name, join_key and confidence (0 to 1).",
    "flatten": "Write a view that replaces this JSON column by one typed column per key. Reply "
    "with the SQL only.",
    "diagnosis": "Explain these sync failures and how to fix them. Reply with one JSON object "
    "with the keys diagnosis, recommended_actions (array) and severity (LOW, MEDIUM, HIGH "
    "or CRITICAL).",
}


def build_prompts(
    df: DataFrame, kind: str, keys: tuple[str, ...] = ("connection_id",), told: tuple[str, ...] | None = None
) -> DataFrame:
    """Add a ``prompt`` column: what is asked, then the row's data as JSON (all columns, or ``told``).

    One prompt per row. Column-level questions (``docs``, ``sensitivity``) take landed columns
    and ask about each column by itself, with its table as context: a question does not depend
    on how wide the table is, and nothing is collected. The keys are not part of such a
    question, so connections with the same tables ask the same thing, and ``run_model`` asks
    it once.
    """
    if kind not in _ASK:
        raise ValueError(f"unknown prompt kind: {kind}")
    told = told or df.columns
    if kind in ("docs", "sensitivity"):
        told = ["table_key", "ordinal_position", "column_name", "data_type"]
        df = df.select(*keys, table_key().alias("table_key"), *told[1:])
    facts = F.to_json(F.struct(*told), {"ignoreNullFields": "false"})
    return df.withColumn("prompt", F.concat(F.lit(_ASK[kind] + "\n\nDATA:\n"), facts))


class RememberedModel:
    """A model whose replies are kept under ``root`` and reused by later runs.

    ``name`` stands for the model and its settings: a question is asked again under another
    name. Pass it wherever an operator takes a ``model_fn``.
    """

    def __init__(self, model_fn: Callable[[str], str], root: str, name: str = ""):
        self.model_fn, self.name = model_fn, name
        self.path = f"{root.rstrip('/')}/model_replies"

    def __call__(self, prompt: str) -> str:
        return self.model_fn(prompt)


# Kept replies have the question's whole digest, those of one run the key they are joined by.
REPLIES = "question string, raw string"
RUN_REPLIES = "question binary, raw string"


def _question_key(digest: Column) -> Column:
    """What tells questions apart: 128 bits of the digest, a quarter of its text's size."""
    return F.substring(F.unhex(digest), 1, 16)


def run_model(
    prompts: DataFrame, model_fn: Callable[[str], str], partitions: int | None = None
) -> DataFrame:
    """Add the model's reply as ``raw``; NULL where the call raised or there is no prompt.

    Replies are stored by a digest of the question and joined back by it, so equal questions
    are asked once however many rows have them, and a ``RememberedModel`` asks only what no
    earlier run has asked. Failed calls are not stored and are tried again by the next run.
    Calls run in the tasks, one Arrow batch of questions at a time; ``partitions`` spreads the
    questions evenly over that many tasks, which bounds the number of parallel calls. Replies
    are costly and may differ on a second call, so they are written at once: a lost executor or
    a second reader does not repeat them. Of two replies to one question, which only runs at
    the same time leave, the smaller counts.
    """
    if "raw" in prompts.columns:
        raise ValueError("prompts already have a raw column")
    spark = prompts.sparkSession
    kept = isinstance(model_fn, RememberedModel)
    path = model_fn.path if kept else f"{shared_dir(spark).rstrip('/')}/landwatch/replies-{uuid.uuid4().hex}"
    model, name = (model_fn.model_fn, model_fn.name) if kept else (model_fn, "")

    def reply(prompt: str) -> str | None:
        try:
            answer = model(prompt)
        except Exception:  # a failed call must not fail the other rows
            return None
        return None if answer is None else str(answer)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw = pd.Series([reply(p) for p in batch["prompt"]], index=batch.index, dtype=object)
            yield pd.DataFrame({"question": batch["question"], "raw": raw})[raw.notna()]

    digest = F.sha2(F.concat(F.lit(f"{len(name)}:{name}"), "prompt"), 256)
    asked = materialize(prompts.withColumn("_question", _question_key(digest)), "questions", "zstd")
    fresh = asked.where("prompt IS NOT NULL").groupBy(F.col("_question").alias("question")).agg(F.first("prompt").alias("prompt"))
    schema = REPLIES if kept else RUN_REPLIES
    if kept:
        fresh = fresh.withColumn("question", digest)
        if path_exists(spark, path):
            fresh = fresh.join(spark.read.schema(REPLIES).parquet(path), "question", "left_anti")
    if partitions is not None:
        fresh = fresh.repartition(partitions)
    fresh.mapInPandas(call, schema).write.mode("append").parquet(path, compression="zstd")
    replies = spark.read.schema(schema).parquet(path).withColumnRenamed("question", "_question")
    if kept:  # a run's own replies are to distinct questions
        replies = replies.groupBy(_question_key(F.col("_question")).alias("_question")).agg(F.min("raw").alias("raw"))
    return asked.join(replies, "_question", "left").select(*prompts.columns, "raw")


def validate_classification(replies: DataFrame) -> DataFrame:
    """Read classification replies; adds ``is_valid`` and ``error``.

    A reply must be a JSON object with all four keys, a known change type and a confidence
    between 0 and 1. The confidence may be quoted.
    """
    text = extract_json(F.col("raw"))
    reply = F.from_json(text, "map<string,variant>")

    def field(name: str) -> Column:
        return F.try_variant_get(F.col("_reply")[name], "$", "string")

    present = [F.map_contains_key(F.col("_reply"), n) for n in ("change_type", "confidence", "rationale", "remediation_sql")]
    all_present = present[0] & present[1] & present[2] & present[3]
    confidence = field("confidence").try_cast("double")
    error = (
        F.when(F.col("raw").isNull(), "the model call failed")
        .when(F.col("_reply").isNull(), "the reply is not a JSON object")
        .when(~all_present, "the reply lacks a required key")
        .when(~F.coalesce(field("change_type").isin(*CHANGE_TYPES), F.lit(False)), "unknown change type")
        .when(confidence.isNull() | F.isnan(confidence), "confidence is not a number")
        .when(~confidence.between(0.0, 1.0), "confidence is out of range")
    )
    read = replies.withColumn("_reply", reply).withColumn("error", error)
    valid = F.col("error").isNull()
    outputs = {
        "is_valid": valid,
        "change_type": F.when(valid, field("change_type")),
        "classification_conf": F.when(valid, confidence),
        "rationale": F.when(valid, F.coalesce(field("rationale"), F.lit("None"))),
        "remediation_sql": F.when(valid, F.coalesce(field("remediation_sql"), F.lit("None"))),
    }
    if "change_type" in replies.columns:
        read = read.withColumnRenamed("change_type", "candidate_type")
        outputs["change_type"] = F.coalesce(outputs["change_type"], F.col("candidate_type"))
    return read.withColumns(outputs).drop("_reply", "candidate_type")


# Shape of each tool's reply, and the value a bad reply falls back to.
REPLY_SCHEMAS = {
    "readiness": "grade string, narrative string, top_remediations array<string>",
    "volatility": "stability_class string, narrative string, recommendation string",
    "docs": "array<struct<column_name string, description string>>",
    "sensitivity": "array<struct<table string, `column` string, sensitivity_class string, masking_strategy string>>",
    "requirements": "array<struct<entity string, required_fields array<string>, why string>>",
    "missing": "suggested_connector_type string, why string",
    "entity": "entity_name string, join_key string, confidence string",
    "diagnosis": "diagnosis string, recommended_actions array<string>, severity string",
}


def read_reply(raw: Column, kind: str) -> Column:
    """The reply as a typed value, NULL when it is not JSON of the expected outer shape."""
    text = extract_json(raw)
    opener = "[" if REPLY_SCHEMAS[kind].startswith("array") else "{"
    # from_json is lenient about the outer shape; a parse check keeps garbage out.
    readable = text.startswith(opener) & F.try_parse_json(text).isNotNull()
    return F.when(readable, F.from_json(text, REPLY_SCHEMAS[kind]))


def with_fallbacks(replies: DataFrame, kind: str) -> DataFrame:
    """Replies as columns, with the tool's fallback where the reply cannot be read.

    readiness: grade '?', the raw text as narrative, no remediations; a letter outside A–F
    also becomes '?'. volatility: UNKNOWN and empty texts. diagnosis: the raw text, no
    actions, NULL severity (the count decides). missing: empty texts. Array-valued kinds:
    an empty array in ``items``.
    """
    r = F.col("_r")
    raw_text = F.coalesce(F.trim("raw"), F.lit(""))
    none = F.array().cast("array<string>")
    out = replies.withColumn("_r", read_reply(F.col("raw"), kind))
    if kind == "readiness":
        grade = F.upper(F.trim(r["grade"]))
        columns = {
            "grade": F.when(grade.isin(*"ABCDF"), grade).otherwise(F.lit("?")),
            "narrative": F.when(r.isNull(), raw_text).otherwise(F.coalesce(r["narrative"], F.lit(""))),
            "top_remediations": F.coalesce(F.slice(r["top_remediations"], 1, 3), none),
        }
    elif kind == "volatility":
        columns = {
            "stability_class": F.coalesce(r["stability_class"], F.lit("UNKNOWN")),
            "narrative": F.coalesce(r["narrative"], F.lit("")),
            "recommendation": F.coalesce(r["recommendation"], F.lit("")),
        }
    elif kind == "diagnosis":
        severity = F.upper(r["severity"])
        columns = {
            "diagnosis": F.when(r.isNull(), raw_text).otherwise(F.coalesce(r["diagnosis"], F.lit(""))),
            "recommended_actions": F.coalesce(r["recommended_actions"], none),
            "severity": F.when(severity.isin("LOW", "MEDIUM", "HIGH", "CRITICAL"), severity),
        }
    elif kind == "missing":
        columns = {
            "suggested_connector_type": F.coalesce(r["suggested_connector_type"], F.lit("")),
            "why": F.coalesce(r["why"], F.lit("")),
        }
    elif kind == "entity":
        columns = {
            "entity_name": r["entity_name"],
            "join_key": r["join_key"],
            "confidence": r["confidence"].try_cast("double"),
        }
    else:
        columns = {"items": F.coalesce(r, F.from_json(F.lit("[]"), REPLY_SCHEMAS[kind]))}
    return out.withColumns(columns).drop("_r")


def merge_model_rows(
    df: DataFrame, rows: DataFrame, keys: list[str], defaults: dict[str, str]
) -> DataFrame:
    """Left join of model output by key, with defaults where the model said nothing.

    A key the model answers twice takes the larger row, so the merge never multiplies rows.
    """
    payload = F.max(F.struct(*defaults)).alias("_m")
    one = rows.groupBy(*keys).agg(payload)
    return df.join(one, keys, "left").select(
        *df.columns, *[F.coalesce(F.col(f"_m.{n}"), F.lit(v)).alias(n) for n, v in defaults.items()]
    )
