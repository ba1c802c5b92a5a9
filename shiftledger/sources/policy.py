"""Policies: thresholds and active rules from JSON documents, merged over the factory values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftledger import dims

NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*|BOOLEAN)$"


def policies_from_json(docs: DataFrame) -> DataFrame:
    """(policy_id, doc) -> one row of four thresholds and active_rule_keys per document.

    A key is taken only if its value has the right type; a broken document yields the factory policy.
    """
    df = docs.withColumn("_v", F.try_parse_json("doc"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    def threshold(name: str) -> Column:
        path = f"$.thresholds.{name}"
        number = F.coalesce(F.try_variant_get("_v", path, "double"),
                            F.try_variant_get("_v", path, "boolean").cast("int").cast("double"))
        return F.coalesce(F.when(kind(path).rlike(NUMERIC), number.try_cast("int")), F.lit(dims.FACTORY_POLICY[name]))
    keys = F.when(kind("$.active_rule_keys").isin("ARRAY<STRING>", "ARRAY<VOID>"),
                  F.try_variant_get("_v", "$.active_rule_keys", "array<string>"))
    clean = F.when(~F.exists(F.coalesce(keys, F.array().cast("array<string>")), lambda k: k.isNull()), keys)
    return df.select("policy_id", *[threshold(n).alias(n) for n in dims.FACTORY_POLICY], clean.alias("active_rule_keys"))


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """One policy per JSON file; the file name is its id."""
    docs = spark.read.text(path, wholetext=True).select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("policy_id"), F.col("value").alias("doc"))
    return policies_from_json(docs)


def check_policy(policy: DataFrame) -> DataFrame:
    """Add ``errors``: missing thresholds, values out of range, a floor that is not below the cap."""
    tests = []
    for name, (lo, hi) in dims.POLICY_RANGES.items():
        tests.append(F.when(F.col(name).isNull(), f"{name}: missing"))
        tests.append(F.when(~F.col(name).between(lo, hi), f"{name}: must be between {lo} and {hi}"))
    tests.append(F.when(F.col("min_week_hrs") >= F.col("max_week_hrs"), "min_week_hrs: must be less than max_week_hrs"))
    return policy.withColumn("errors", F.array_compact(F.array(*tests)))


#: What a value of a wrong type is called.
KINDS = {"STRING": "str", "BOOLEAN": "bool", "VOID": "NoneType", "ARRAY.*": "list", "OBJECT.*": "dict"}


def check_documents(docs: DataFrame) -> DataFrame:
    """(policy_id, error) of raw documents that are to be saved: null, or the first thing that is wrong.

    ``thresholds`` must be an object of exactly the four names, each a number and no boolean; ``active_rule_keys`` must be null or a list of
    strings. Numbers are looked at in the order of their names.
    """
    df = docs.withColumn("_v", F.try_parse_json("doc"))

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", path, "variant"))

    def called(k: Column) -> Column:
        name = F.lit("int")
        for pattern, word in KINDS.items():
            name = F.when(k.rlike(f"^{pattern}"), word).otherwise(name)
        return name
    names = sorted(dims.FACTORY_POLICY)
    thresholds = kind("$.thresholds")
    keys = F.array_sort(F.map_keys(F.try_variant_get("_v", "$.thresholds", "map<string,variant>")))
    wrong = [F.when(~kind(f"$.thresholds.{n}").rlike(NUMERIC.replace("|BOOLEAN", "")),
                    F.concat(F.lit(f"thresholds['{n}'] must be numeric, got "), called(kind(f"$.thresholds.{n}")))) for n in names]
    active = kind("$.active_rule_keys")
    listed = active.isNull() | active.isin("VOID", "ARRAY<STRING>", "ARRAY<VOID>")
    no_null = ~F.exists(F.coalesce(F.try_variant_get("_v", "$.active_rule_keys", "array<string>"), F.array().cast("array<string>")), lambda k: k.isNull())
    error = F.coalesce(
        F.when(F.col("_v").isNull(), "not a JSON document"),
        F.when(~F.coalesce(thresholds.rlike("^OBJECT"), F.lit(False)), "thresholds must be a dict"),
        F.when(keys != F.array(*[F.lit(n) for n in names]), "thresholds must contain exactly these keys: [" + ", ".join(f"'{n}'" for n in names) + "]"),
        *wrong, F.when(~(listed & no_null), "active_rule_keys must be None or a list[str]"))
    return df.select("policy_id", error.alias("error"))
