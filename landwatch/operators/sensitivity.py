"""Column sensitivity and masking."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landwatch.functions.crypto import hmac_sha256_hex
from landwatch.functions.text import table_key
from landwatch.operators.model import build_prompts, run_model, with_fallbacks
from landwatch.schemas import MASKING_STRATEGIES, SENSITIVITY_CLASSES

# -- fixed values: keywords of each class, in order of rank ------------------------------
KEYWORDS = {
    "PII": "email, phone, SSN, name, date of birth, address, IP address, user_id, device_id",
    "FINANCIAL": "amount, revenue, balance, account_number, credit_card, price, salary",
    "HEALTH": "diagnosis, medication, condition, lab_result, patient_id",
}
# Names that hold a PII keyword as a token but describe things, not people (ours).
_NOT_PERSONAL = "file, table, column, product, event, display, host, domain, schema"
# Strategy by keyword (ours): ids stay joinable, account and card numbers can be read back,
# amounts and dates lose precision, everything else is blanked.
_STRATEGY_KEYWORDS = {
    "HASH": "user_id, device_id, patient_id, SSN, email",
    "TOKENIZE": "account_number, credit_card",
    "GENERALIZE": "amount, revenue, balance, price, salary, date of birth, lab_result",
}


def _has_keyword(name: Column, keywords: str) -> Column:
    """Whether the name contains one of the keywords as whole tokens, e.g. ``phone`` in
    ``phone_number`` but not in ``phonetic``."""
    normal = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")
    alternatives = "|".join(k.strip().lower().replace(" ", "_") for k in keywords.split(","))
    return normal.rlike(f"(?:^|_)(?:{alternatives})(?:_|$)")


def sensitivity_class(name: Column) -> Column:
    thing = _has_keyword(name, _NOT_PERSONAL)
    only_name = _has_keyword(name, "name") & ~_has_keyword(
        name, KEYWORDS["PII"].replace(", name", "")
    )
    return (
        F.when(_has_keyword(name, KEYWORDS["PII"]) & ~(thing & only_name), "PII")
        .when(_has_keyword(name, KEYWORDS["FINANCIAL"]), "FINANCIAL")
        .when(_has_keyword(name, KEYWORDS["HEALTH"]), "HEALTH")
        .otherwise("SAFE")
    )


def masking_strategy(name: Column, klass: Column) -> Column:
    chosen = F
    for strategy, keywords in _STRATEGY_KEYWORDS.items():
        chosen = chosen.when(_has_keyword(name, keywords), strategy)
    return F.when(klass != "SAFE", chosen.otherwise(F.lit("REDACT")))


def classify_sensitivity(
    landed: DataFrame, model_fn: Callable[[str], str] | None = None
) -> DataFrame:
    """``(connection_id, table_key, column_name, sensitivity_class, masking_strategy)`` of
    every landed column. With a model, one prompt per distinct column; a column the model leaves out
    keeps the rule's answer."""
    name = F.col("column_name")
    ruled = landed.select(
        "connection_id",
        table_key().alias("table_key"),
        "column_name",
        sensitivity_class(name).alias("sensitivity_class"),
    ).withColumn("masking_strategy", masking_strategy(name, F.col("sensitivity_class")))
    if model_fn is None:
        return ruled
    replies = with_fallbacks(run_model(build_prompts(landed, "sensitivity"), model_fn), "sensitivity")
    said = (
        replies.select("connection_id", "table_key", F.explode("items").alias("i"))
        .select(
            "connection_id",
            "table_key",
            F.col("i.column").alias("column_name"),
            F.struct(
                F.upper(F.coalesce("i.sensitivity_class", F.lit("SAFE"))).alias("klass"),
                F.col("i.masking_strategy").alias("strategy"),
            ).alias("m"),
        )
        .groupBy("connection_id", "table_key", "column_name")
        .agg(F.max("m").alias("m"))
    )
    answered = F.col("m").isNotNull()
    return ruled.join(said, ["connection_id", "table_key", "column_name"], "left").select(
        "connection_id",
        "table_key",
        "column_name",
        F.when(answered, F.col("m.klass")).otherwise(F.col("sensitivity_class")).alias("sensitivity_class"),
        F.when(answered, F.col("m.strategy")).otherwise(F.col("masking_strategy")).alias("masking_strategy"),
    )


def sensitivity_rank(klass: Column) -> Column:
    """0 for PII to 3 for SAFE; 4 for an unknown class."""
    ladder = F
    for rank, name in enumerate(SENSITIVITY_CLASSES):
        ladder = ladder.when(F.upper(klass) == name, rank)
    return ladder.otherwise(F.lit(len(SENSITIVITY_CLASSES)))


def sensitivity_tier_filter(classified: DataFrame, min_sensitivity: str = "PII") -> DataFrame:
    """Columns at or above a tier. An unknown tier means PII; an unknown class never passes."""
    wanted = min_sensitivity.upper()
    limit = SENSITIVITY_CLASSES.index(wanted) if wanted in SENSITIVITY_CLASSES else 0
    return classified.filter(sensitivity_rank(F.col("sensitivity_class")) <= limit)


def sensitive_columns(
    landed: DataFrame,
    min_sensitivity: str = "PII",
    model_fn: Callable[[str], str] | None = None,
    active: DataFrame | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Sensitive columns of the fleet at or above a tier, highest tier first when ``ordered``.
    ``active`` limits the fleet to connections that have synced."""
    if active is not None:
        landed = landed.join(active.select("connection_id").distinct(), "connection_id", "left_semi")
    out = sensitivity_tier_filter(classify_sensitivity(landed, model_fn), min_sensitivity)
    if ordered:
        out = out.orderBy(
            sensitivity_rank(F.col("sensitivity_class")), "connection_id", "table_key", "column_name"
        )
    return out


def mask_columns(df: DataFrame, plan: dict[str, str | dict], salt: str) -> DataFrame:
    """Apply masking strategies to rows as one projection, without a shuffle.

    ``plan`` maps a column to a strategy name or to ``{"strategy": ..., options}``:
    HASH gives sha256 of salt and value; REDACT gives NULL or the option ``value``;
    TOKENIZE gives a keyed token that ``build_token_vault`` can resolve; GENERALIZE rounds
    numbers down to a multiple of ``bucket`` (whole or fractional, above 0), truncates times
    to ``unit``, or keeps the first ``prefix`` characters of a text. A generalized column
    keeps its type; one of another type, such as a boolean, is an error.

    The salt is a literal of the plan and so of the query's event log: restrict who reads
    that log, or set ``spark.sql.redaction.string.regex`` to a pattern that covers the salt.
    """
    unknown = [c for c in plan if c not in df.columns]
    if unknown:
        raise ValueError(f"columns to mask do not exist: {unknown}")
    masked = {}
    for name, spec in plan.items():
        options = {"strategy": spec} if isinstance(spec, str) else dict(spec)
        strategy = options.pop("strategy")
        if strategy not in MASKING_STRATEGIES:
            raise ValueError(f"unknown masking strategy: {strategy}")
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType.typeName()
        if strategy == "HASH":
            masked[name] = F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)
        elif strategy == "REDACT":
            value = options.get("value")
            masked[name] = F.lit(value) if value is not None else F.lit(None).cast(df.schema[name].dataType)
        elif strategy == "TOKENIZE":
            masked[name] = token_of(c, salt)
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            masked[name] = F.date_trunc(options.get("unit", "month"), c).cast(df.schema[name].dataType)
        elif kind in ("string", "varchar", "char"):
            masked[name] = F.substring(c, 1, int(options.get("prefix", 1)))
        elif kind in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            masked[name] = _rounded_down(c, str(options.get("bucket", 10)), kind).cast(df.schema[name].dataType)
        else:
            raise ValueError(f"{name}: a {kind} column cannot be generalized")
    return df.withColumns(masked)


def _rounded_down(value: Column, bucket: str, kind: str) -> Column:
    """The largest multiple of ``bucket`` that is not above the value.

    Whole numbers and decimals are computed as decimals, so a bucket of 0.1 is exactly that;
    floating-point values that hold no decimal (NaN, very large ones) become NULL.
    """
    size = Decimal(bucket)
    if size <= 0:
        raise ValueError("the bucket must be above 0")
    scale = max(0, -size.as_tuple().exponent)
    if kind in ("byte", "short", "integer", "long") and scale == 0:
        step = F.lit(int(size)).cast("bigint")
        return value.cast("bigint") - F.pmod(value.cast("bigint"), step)
    exact = value.try_cast(f"decimal(38,{max(scale, 12)})")
    step = F.lit(bucket).cast(f"decimal({len(size.as_tuple().digits) + scale + 1},{scale})")
    return exact - F.pmod(exact, step)


def token_of(value: Column, key: str) -> Column:
    return F.concat(F.lit("tok_"), F.substring(hmac_sha256_hex(value.cast("string"), key.encode()), 1, 32))


def build_token_vault(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    """``(token, value)`` of every distinct value of the given columns. Tokens are computed
    in place when masking; only reading back needs the vault."""
    values = reduce(
        DataFrame.unionByName,
        [df.select(F.col(f"`{c}`").cast("string").alias("value")) for c in columns],
    )
    distinct = values.filter(F.col("value").isNotNull()).distinct()
    return distinct.select(token_of(F.col("value"), key).alias("token"), "value")


def detokenize(df: DataFrame, column: str, vault: DataFrame) -> DataFrame:
    """Replace tokens by their values; a token the vault does not know becomes NULL.

    The vault has one row per token, so a token that fills a third of the rows only makes
    the left side skewed, which AQE splits.
    """
    lookup = vault.select(F.col("token").alias(column), F.col("value").alias("_value"))
    return df.join(lookup, column, "left").select(
        *[F.col("_value").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns]
    )
