"""Audits: sealed columns, re-sealing, leaks, accuracy; A12 to A16, A20, F30, F34, U2, U4."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quillspark.functions.crypto import is_sealed, seal, unseal
from quillspark.functions.ddl import is_sealed_name, table_columns


def sealed_columns(df: DataFrame) -> list[str]:
    """columns that must be sealed by their names."""
    return [c for c in df.columns if c.endswith("_envelope") or c == "filename"]


def sealed_by_ddl(schemas: DataFrame, ddl: str = "ddl") -> DataFrame:
    """table_name and column_name of every column that texts of DDL define and that must be sealed."""
    found = schemas.select(F.explode(table_columns(F.col(ddl))).alias("c")).select("c.*")
    return found.where(is_sealed_name(F.col("column_name"))).distinct()


def uncovered_by(schemas: DataFrame, audited: DataFrame, ddl: str = "ddl") -> DataFrame:
    """Sealed columns of the DDL for which the audit (table_name, column_name) has no row."""
    return sealed_by_ddl(schemas, ddl).join(audited, ["table_name", "column_name"], "left_anti")


def ciphertext_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows and malformed envelopes of every sealed column."""
    parts = [df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~is_sealed(F.col(c))).alias("malformed")).select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "total", "malformed") for t, df in tables.items() for c in sealed_columns(df)]
    return reduce(DataFrame.unionByName, parts)


def uncovered(tables: dict[str, DataFrame], audited: set[tuple[str, str]]) -> list[tuple[str, str]]:
    """Sealed columns that the audit does not list."""
    return sorted({(t, c) for t, df in tables.items() for c in sealed_columns(df)} - audited)


def reseal(df: DataFrame, column: str, old_key: Column, new_key: Column) -> DataFrame:
    """Envelopes under the new key and what was done: skipped if it opens already, resealed, failed or not an envelope."""
    now, before = unseal(F.col(column), new_key), unseal(F.col(column), old_key)
    action = F.when(~is_sealed(F.col(column)), "ignored").when(now.isNotNull(), "skipped").when(before.isNotNull(), "resealed").otherwise("failed")
    return df.withColumn("action", action).withColumn(column, F.when(F.col("action") == "resealed", seal(before, new_key)).otherwise(F.col(column)))


def leak_check(df: DataFrame, column: str, forbidden: list[str]) -> DataFrame:
    """Malformed envelopes, and values that hold forbidden plain text."""
    terms = F.array(*map(F.lit, forbidden))
    value = F.coalesce(column, F.lit(""))
    return df.agg(F.count_if(~is_sealed(F.col(column))).alias("malformed"), F.count_if(F.exists(terms, lambda t: F.contains(value, t))).alias("leaks"))


def _flat(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


@F.pandas_udf(DoubleType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str, y: str) -> float:
        xs, ys = x.split(), y.split()
        row = list(range(len(ys) + 1))
        for i, w in enumerate(xs, 1):
            left, row[0] = row[0], i
            for j, v in enumerate(ys, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (w != v))
        return float(row[-1])

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)])


def edit_accuracy(truth: Column, output: Column) -> Column:
    """exactness and the share of characters and words that are right, of texts with single spaces."""
    a, b = _flat(truth), _flat(output)
    share = lambda d, n: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / F.greatest(F.lit(1), n))), 4)
    words = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, " ")))
    return F.struct((a == b).alias("exact"), share(F.levenshtein(a, b), F.length(a)).alias("char_accuracy"), share(_word_distance(a, b), words(a)).alias("word_accuracy"), F.length(b).alias("chars_out"), words(b).alias("words_out"))


def accuracy_summary(measured: DataFrame) -> DataFrame:
    """Per path; means leave out nulls and are null where all are."""
    return measured.groupBy("path").agg(
        F.count(F.lit(1)).alias("fixtures"), F.count_if("exact").alias("exact"), F.round(F.avg("char_accuracy"), 4).alias("mean_char_accuracy"), F.round(F.avg("word_accuracy"), 4).alias("mean_word_accuracy")
    )


def smoke_summary(receipts: DataFrame) -> DataFrame:
    """A14."""
    return receipts.agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in ("pass", "fail", "skip")))


def dashboard(submissions: DataFrame, documents: DataFrame, angles: DataFrame, lines: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of tallies from five one-row aggregates."""
    flagged = F.size("flags") > 0
    parts = [
        submissions.agg(F.count(F.lit(1)).alias("submissions")), documents.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "held").alias("held_documents")),
        angles.agg(F.count_if((F.col("status") == "queued") & ~flagged).alias("queued_angles"), F.count_if(flagged).alias("held_angles")),
        lines.agg(F.count_if(F.col("status") == "held").alias("held_lines")), reports.agg(F.count_if(F.col("current_version") > 0).alias("published_reports")),
    ]
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts)  # one row each
