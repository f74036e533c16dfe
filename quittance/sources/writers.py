"""Writers: stage artifacts, token CSV, receipt JSON."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quittance.functions.parse import pair_literal


def artifact_name(directory: str, file: str, description: str, as_json: bool, at: datetime | None = None) -> str:
    """<directory>/<time>_<file>_<description>.<json or txt>; the time has no colons, which Hadoop paths refuse."""
    at = at or datetime.now(timezone.utc)
    return f"{directory}/{at:%Y-%m-%dT%H-%M-%S}_{file}_{description}.{'json' if as_json else 'txt'}"


def write_stage(df: DataFrame, directory: str, stage: str) -> str:
    """A stage's result as a JSON table, parted by receipt where there is one; what was there is replaced."""
    path = f"{directory}/{stage}"
    df.write.mode("overwrite").json(path, ignoreNullFields=False)
    return path


def write_documents(docs: DataFrame, path: str, column: str = "json") -> None:
    """One document a line."""
    docs.select(F.regexp_replace(column, r"\s*\n\s*", " ").alias("value")).write.mode("overwrite").text(path)


def one_decimal(v: Column) -> Column:
    """A number with one decimal; whole ones need no format string, which costs most of a row."""
    v = v.cast("double")
    whole = v.try_cast("long")
    plain = (v == whole) & (whole != 0) & (F.abs(v) < 1e15)
    return F.when(plain, F.concat(whole.cast("string"), F.lit(".0"))).otherwise(F.format_string("%.1f", v))


def token_csv(tokens: DataFrame) -> DataFrame:
    """Rows of the token CSV: image, quad literal, text literal, label (empty: to be filled in)."""
    quad = F.concat(F.lit("["), F.array_join(F.transform("quad", lambda p: F.concat(F.lit("["), one_decimal(p["x"]), F.lit(", "), one_decimal(p["y"]), F.lit("]"))), ", "), F.lit("]"))
    label = F.coalesce(F.col("label").cast("string"), F.lit("")) if "label" in tokens.columns else F.lit("")
    return tokens.select("image", quad.alias("quad_literal"), pair_literal(F.col("text"), F.col("ocr_milli")).alias("text_conf_literal"), label.alias("label"))


def write_token_csv(tokens: DataFrame, path: str) -> None:
    token_csv(tokens).write.mode("overwrite").csv(path, quoteAll=True, escape='"')
