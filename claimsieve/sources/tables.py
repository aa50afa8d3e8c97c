"""Reading and writing tables, column dialects, contracts and latest-row upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from claimsieve.functions.columns import PROHIBITED

#: Date columns of the domain tables.
DATE_COLUMNS = ("service_date", "referral_date", "dob", "enrolled_date", "death_date", "enrollment_end", "termination_date", "admission_date", "discharge_date", "open_date", "close_date")
#: Other names that claims come with.
CLAIM_ALIASES = {
    "billing_provider_id": "provider_id",
    "cpt_code": "procedure_code",
    "service_from": "service_date",
    "date_of_service": "service_date",
    "claim_status": "status",
    "patient_id": "member_id",
    "billed": "billed_amount",
    "paid": "paid_amount",
}


def read_csv_tables(spark: SparkSession, folder: str, schemas: Mapping[str, StructType]) -> dict[str, DataFrame]:
    """Named tables ``folder/name.csv`` with a declared schema; dates that can't be parsed become NULL."""
    out = {}
    for name, schema in schemas.items():
        as_text = ", ".join(f"`{f.name}` {'string' if f.name in DATE_COLUMNS else f.dataType.simpleString()}" for f in schema.fields)
        raw = spark.read.option("header", True).schema(as_text).csv(f"{folder}/{name}.csv")
        out[name] = raw.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c))) for c in raw.columns if c in DATE_COLUMNS})
    return out


def read_either(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV artefact; if that extension isn't there, the other one is tried."""
    stem = path.rsplit(".", 1)[0]
    order = (path, f"{stem}.csv" if path.endswith(".parquet") else f"{stem}.parquet")
    for p in order:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.parquet(p) if p.endswith(".parquet") else spark.read.option("header", True).csv(p)
    raise FileNotFoundError(f"neither of {order}")


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for formats without nesting."""
    return df.select(*(F.to_json(c).alias(c) if isinstance(df.schema[c].dataType, (ArrayType, MapType, StructType)) else F.col(c) for c in df.columns))


def write_both(df: DataFrame, stem: str) -> None:
    """Parquet with native nesting and CSV with JSON text, compressed; the table is computed once, for the first."""
    df.write.mode("overwrite").parquet(f"{stem}.parquet")
    flat(df.sparkSession.read.schema(df.schema).parquet(f"{stem}.parquet")).write.mode("overwrite").option("header", True).option("compression", "gzip").csv(f"{stem}.csv")


def write_report(metrics: DataFrame, path: str) -> None:
    """A table of metrics as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def canonical(df: DataFrame, optional: Mapping[str, str], aliases: Mapping[str, str] = CLAIM_ALIASES) -> DataFrame:
    """Rename known dialects and add missing optional columns as typed NULL."""
    df = df.withColumnsRenamed({a: b for a, b in aliases.items() if a in df.columns and b not in df.columns})
    return df.withColumns({c: F.lit(None).cast(t) for c, t in optional.items() if c not in df.columns})


def has_columns(df: DataFrame | None, *columns: str) -> bool:
    return df is not None and set(columns) <= set(df.columns)


class ContractError(ValueError):
    pass


def check_contract(df: DataFrame, checks: Mapping[str, Column], key: Sequence[str] = ()) -> DataFrame:
    """Add ``failed array<string>``: names of checks that are not true (NULL fails), and ``duplicate_key``."""
    names = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None).cast("string")).otherwise(F.lit(name)) for name, ok in checks.items()]
    if key:
        n = F.count(F.lit(1)).over(Window.partitionBy(*key))
        names.append(F.when(n > 1, F.lit("duplicate_key")))
    return df.withColumn("failed", F.filter(F.array(*names), lambda x: x.isNotNull()))


def split_valid(checked: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejects; in strict mode a reject raises, naming a row."""
    rejects = checked.where(F.size("failed") > 0)
    if strict and (row := rejects.first()) is not None:
        raise ContractError(f"row breaks its contract: {row.asDict()}")
    return checked.where(F.size("failed") == 0).drop("failed"), rejects


def _fair(text: str) -> str:
    """An expression that is true of text without prohibited wording."""
    return " and ".join(f"not contains(lower({text}), '{p}')" for p in PROHIBITED)


#: Contracts of outputs, as check names and expressions.
CONTRACTS: dict[str, dict[str, str]] = {
    "alerts": {"rule_id": "rule_id rlike '^R(0[1-9]|10)$'", "entity_id": "entity_id is not null", "severity": "severity in ('LOW','MEDIUM','HIGH','CRITICAL')", "est_dollars": "est_dollars >= 0", "evidence": "size(evidence) >= 1"},
    "cases": {"case_id": "case_id is not null", "risk_score": "risk_score between 0 and 1", "priority": "priority in ('LOW','MEDIUM','HIGH','CRITICAL')", "status": "status in ('NEW','IN_REVIEW','ESCALATED','CLOSED')", "exposure": "exposure_high >= exposure_low"},
    "risk_scores": {"provider_id": "provider_id is not null", "risk_score": "risk_score between 0 and 1", "confidence": "confidence between 0 and 1"},
    "claim_ml": {"claim_id": "claim_id is not null", "ml_probability": "ml_probability between 0 and 1"},
    "networks": {"network_id": "network_id is not null", "size": "size >= 2"},
    "queue": {"case_id": "case_id is not null", "priority_score": "priority_score between 0 and 1", "rank": "queue_rank >= 1", "signals": " and ".join(f"coalesce(q_{k}, 0) between 0 and 1" for k in ("risk", "evidence", "exposure", "network", "anomaly", "future", "behaviour")), "wording": _fair("array_join(queue_reasons, ' ')")},
    "case_evidence": {"case_id": "case_id is not null", "source": "source is not null", "kind": "kind is not null"},
    "case_wording": {"wording": _fair("concat(title, ' ', summary)")},
}


def contract(name: str) -> dict[str, Column]:
    return {k: F.expr(v) for k, v in CONTRACTS[name].items()}


def latest_by_key(old: DataFrame, new: DataFrame, key: Sequence[str], order: str = "load_ts") -> DataFrame:
    """The last row of each key over both tables, with the columns of ``old`` only (what it lacks is dropped, what new lacks is NULL)."""
    keep = [c for c in old.columns if c in new.columns]
    both = old.withColumn("_source", F.lit(0)).unionByName(new.select(*keep).withColumn("_source", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(order), F.desc("_source"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_source")


def require_outputs(mode: str, outputs: Mapping[str, DataFrame | None]) -> None:
    """In real mode, missing or empty upstream outputs are an error; in fixture mode they may be synthesised."""
    if mode not in ("real", "fixture"):
        raise ValueError(f"mode {mode!r}")
    missing = sorted(k for k, v in outputs.items() if v is None or v.isEmpty()) if mode == "real" else []
    if missing:
        raise ContractError(f"missing or empty: {', '.join(missing)}")
