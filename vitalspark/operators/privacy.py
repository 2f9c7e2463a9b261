"""Personal-data detection and anonymisation (PHI-1, PHI-2, ANO-1..5).

Column names are schema, so the name patterns run on the driver.  Value
patterns run over EVERY value of every column in one aggregate (the
reference looked at 20 values); hit counts come back per column.
Value patterns use ASCII character classes and explicit ASCII boundaries so
that Spark (Java regex) and SQL engines (RE2) agree on multilingual text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import qcol
from ..plans.aggregates import wide_to_long
from ..plans.ordered import ordered_prefix

# Personal-data column-name patterns (searched in the
# lower-cased name), and the subset that makes a column HIGH risk.
NAME_PATTERNS = (
    r"\bname\b", r"\bfirst.?name\b", r"\blast.?name\b", r"\bfull.?name\b",
    r"\bemail\b", r"\bphone\b", r"\bmobile\b", r"\bcontact\b",
    r"\baddress\b", r"\bstreet\b", r"\bcity\b", r"\bpostcode\b", r"\bzip\b",
    r"\bnhs.?number\b", r"\bpatient.?id\b", r"\bssn\b", r"\bnational.?id\b",
    r"\bpassport\b", r"\bdob\b", r"\bdate.?of.?birth\b", r"\bbirthdate\b",
    r"\bip.?address\b", r"\burl\b", r"\bdevice.?id\b",
)
HIGH_RISK_NAME_PATTERNS = (
    r"\bname\b", r"\bemail\b", r"\bphone\b", r"\bssn\b", r"\bnhs\b", r"\bpatient.?id\b", r"\bdob\b",
)
# Value patterns (e-mail, phone number, day/month/year date).
_B_START = r"(^|[^A-Za-z0-9_])"
_B_END = r"($|[^A-Za-z0-9_])"
EMAIL_PATTERN = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[a-z]{2,}"
PHONE_PATTERN = _B_START + r"[0-9]{10,11}" + _B_END + r"|\+[0-9]{1,3}\s?[0-9]{6,}"
DATE_PATTERN = _B_START + r"[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}" + _B_END
# The same texts are found by these: an e-mail address needs one character before
# its '@' (a long word is then read once, not from each of its characters), and
# a phone number or date its digits, which are looked for first.
_EMAIL_FOUND = r"[A-Za-z0-9_.+-]@[A-Za-z0-9_-]+\.[a-z]{2}"
_PHONE_DIGITS = r"[0-9]{6}"
_DATE_DIGITS = r"[0-9][/-][0-9]{1,2}[/-][0-9]{2}"

REVIEW_SCORE = 60
HIGH_PENALTY, MEDIUM_PENALTY = 20, 10
PSEUDONYM_FORMAT = "PATIENT_%05d"
HASH_CHARS = 12


def name_match(column: str, patterns: Sequence[str] = NAME_PATTERNS, split_underscore: bool = False) -> bool:
    name = column.lower()
    if split_underscore:
        name = name.replace("_", " ")
    return any(re.search(p, name) for p in patterns)


def value_hits(v: Column) -> tuple[Column, Column, Column]:
    """Whether a text holds an e-mail address, a phone number, a date."""
    return (v.contains("@") & v.rlike(_EMAIL_FOUND), v.rlike(_PHONE_DIGITS) & v.rlike(PHONE_PATTERN),
            v.rlike(_DATE_DIGITS) & v.rlike(DATE_PATTERN))


def detect_phi(df: DataFrame, key_cols: Sequence[str] | None = None, split_underscore: bool = False,
               sample_rows: int | None = None) -> DataFrame:
    """PHI-1: per column the name verdict, value hit counts over the whole
    column (or, with ``sample_rows`` and ``key_cols``, over the first values
    in key order as the reference does with 20), the PHI flag and its risk
    level (HIGH only by name)."""
    if sample_rows is not None:
        if not key_cols:
            raise ValueError("sample_rows needs key_cols to define 'first'")
        return _detect_phi_sampled(df, key_cols, split_underscore, sample_rows)
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, f in enumerate(fields):
        v = qcol(f.name).cast("string")
        email, phone, date = value_hits(v)
        aggs += [F.count(v).alias(f"n{i}"), F.count_if(email).alias(f"e{i}"), F.count_if(phone).alias(f"p{i}"),
                 F.count_if(date).alias(f"d{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, f in enumerate(fields):
        by_name = name_match(f.name, NAME_PATTERNS, split_underscore)
        high = name_match(f.name, HIGH_RISK_NAME_PATTERNS, split_underscore)
        hits = (F.col(f"e{i}") + F.col(f"p{i}") + F.col(f"d{i}")) > 0
        is_phi = F.lit(True) if by_name else hits
        rows.append({"column": F.lit(f.name), "position": F.lit(i), "dtype": F.lit(f.dataType.simpleString()),
                     "name_match": F.lit(by_name), "non_null": F.col(f"n{i}"),
                     "email_hits": F.col(f"e{i}"), "phone_hits": F.col(f"p{i}"), "date_hits": F.col(f"d{i}"),
                     "is_phi": is_phi,
                     "risk_level": F.when(is_phi, F.lit("HIGH" if high else "MEDIUM"))})
    report = wide_to_long(wide, rows)
    if key_cols:
        from .profile import first_values
        sample = first_values(df, df.columns, key_cols, 1).select("column", F.col("value").alias("sample"))
        report = report.join(sample, "column", "left").withColumn("sample", F.coalesce("sample", F.lit("")))
    return report


def _detect_phi_sampled(df: DataFrame, key_cols: Sequence[str], split_underscore: bool,
                        sample_rows: int) -> DataFrame:
    from .profile import first_values
    vals = first_values(df, df.columns, key_cols, sample_rows)
    v = F.col("value")
    email, phone, date = value_hits(v)
    hits = vals.groupBy("column").agg(F.count(F.lit(1)).alias("non_null"),
                                      F.count_if(email).alias("email_hits"),
                                      F.count_if(phone).alias("phone_hits"),
                                      F.count_if(date).alias("date_hits"),
                                      F.min_by(v, "rank").alias("sample"))
    spark = df.sparkSession
    meta = spark.createDataFrame(
        [(f.name, i, f.dataType.simpleString(), name_match(f.name, NAME_PATTERNS, split_underscore),
          name_match(f.name, HIGH_RISK_NAME_PATTERNS, split_underscore)) for i, f in enumerate(df.schema.fields)],
        "column string, position int, dtype string, name_match boolean, _high boolean")
    j = meta.join(hits, "column", "left").fillna(0, ["non_null", "email_hits", "phone_hits", "date_hits"])
    is_phi = F.col("name_match") | ((F.col("email_hits") + F.col("phone_hits") + F.col("date_hits")) > 0)
    return j.select("column", "position", "dtype", "name_match", F.col("non_null").cast("long").alias("non_null"),
                    F.col("email_hits").cast("long").alias("email_hits"),
                    F.col("phone_hits").cast("long").alias("phone_hits"),
                    F.col("date_hits").cast("long").alias("date_hits"), is_phi.alias("is_phi"),
                    F.when(is_phi, F.when(F.col("_high"), "HIGH").otherwise("MEDIUM")).alias("risk_level"),
                    F.coalesce("sample", F.lit("")).alias("sample"))


# The advice texts of the reference.
ADVICE_URGENT = "⛔ URGENT: High-risk PHI columns detected. Anonymise before sharing or analysing."
ADVICE_HIGH, ADVICE_MEDIUM = "Mask or hash columns: ", "Review medium-risk columns: "
ADVICE_ALWAYS = ("Use pseudonymisation for patient ID columns to allow re-linkage if needed.",
                 "Never export raw PHI data — always anonymise before sharing with third parties.")
ADVICE_NONE = " No PHI columns detected. Dataset appears safe for analysis."


def privacy_advice(report: DataFrame) -> DataFrame:
    """PHI-2: what to do about a detection report, in order: (position,
    recommendation).  One aggregate over a row per column."""
    def named(level):
        hit = F.when(F.col("risk_level") == level, F.struct("position", "column"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(hit)), lambda s: s["column"]), ", ")
    one = report.agg(named("HIGH").alias("high"), named("MEDIUM").alias("medium"),
                     F.count_if(F.col("is_phi")).alias("flagged"),
                     F.count_if(F.col("risk_level") == "HIGH").alias("h"),
                     F.count_if(F.col("risk_level") == "MEDIUM").alias("m"))
    status = F.when(_score(F.col("h"), F.col("m")) < REVIEW_SCORE, F.lit(ADVICE_URGENT))
    texts = [status, F.when(F.col("h") > 0, F.concat(F.lit(ADVICE_HIGH), "high")),
             F.when(F.col("m") > 0, F.concat(F.lit(ADVICE_MEDIUM), "medium")),
             *[F.lit(t) for t in ADVICE_ALWAYS], F.when(F.col("flagged") == 0, F.lit(ADVICE_NONE))]
    return one.select(F.posexplode(F.filter(F.array(*texts), lambda t: t.isNotNull())).alias("position", "recommendation"))


def _score(high: Column, medium: Column) -> Column:
    return F.greatest(F.lit(0), 100 - HIGH_PENALTY * high - MEDIUM_PENALTY * medium).cast("long")


def privacy_check(report: DataFrame) -> DataFrame:
    """PHI-2: compliance score 100 - 20/HIGH - 10/MEDIUM (>= 0) and status."""
    out = report.agg(F.count(F.lit(1)).alias("total_columns"),
                     F.count_if(F.col("is_phi")).alias("flagged_columns"),
                     F.count_if(F.col("risk_level") == "HIGH").alias("high_risk_count"),
                     F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_risk_count"))
    score = _score(F.col("high_risk_count"), F.col("medium_risk_count"))
    status = F.when(score >= 90, "COMPLIANT").when(score >= REVIEW_SCORE, "REVIEW_NEEDED").otherwise("NON_COMPLIANT")
    return out.select("total_columns", "flagged_columns", "high_risk_count", "medium_risk_count",
                      score.alias("compliance_score"), status.alias("status"))


def hash_value(c: Column, salt: str = "") -> Column:
    """ANO-1: first 12 hex characters of SHA-256 of the string form; nulls
    stay null.  An unsalted digest is linkable, not reversible: pass a salt
    to stop linkage across datasets."""
    s = c.cast("string")
    text = F.concat(F.lit(salt), s) if salt else s
    return F.when(c.isNotNull(), F.substring(F.sha2(text, 256), 1, HASH_CHARS))


def mask_value(c: Column) -> Column:
    """ANO-2: length <= 2 -> all '*'; otherwise first char, '*' x (len-2),
    last char."""
    s = c.cast("string")
    n = F.length(s)
    inner = F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(0)))
    return F.when(c.isNull(), F.lit(None).cast("string")) \
        .when(n <= 2, F.repeat(F.lit("*"), n)) \
        .otherwise(F.concat(F.substring(s, 1, 1), inner, F.substring(s, -1, 1)))


@dataclass
class Anonymised:
    data: DataFrame
    audit: DataFrame
    mapping: DataFrame | None = None


def pseudonym_map(df: DataFrame, column: str, order_cols: Sequence[str]) -> DataFrame:
    """ANO-4 mapping: distinct non-null values numbered in order of first
    appearance (smallest ``order_cols``): (value, pseudonym).  The numbering
    is a distributed row index over the distinct values."""
    first = df.where(qcol(column).isNotNull()).groupBy(qcol(column).alias("value")) \
        .agg(F.min(F.struct(*[qcol(c) for c in order_cols])).alias("_first"))
    numbered = ordered_prefix(first, ["_first", "value"], [], index_name="_i")
    return numbered.select("value", F.format_string(PSEUDONYM_FORMAT, F.col("_i") + 1).alias("pseudonym"))


def anonymise(df: DataFrame, columns: Sequence[str], method: str = "hash",
              order_cols: Sequence[str] | None = None, salt: str = "") -> Anonymised:
    """ANO-1..5: hash | mask | drop | pseudonymise the given columns, with
    an audit row per column (method, rows affected, distinct identifiers)."""
    cols = [c for c in columns if c in df.columns]
    spark = df.sparkSession
    audit_rows = []
    out = df
    mapping = None
    if method == "drop":
        out = df.drop(*cols)
        total = df.count() if cols else 0
        audit = spark.createDataFrame([(c, "dropped", total, None) for c in cols],
                                      "column string, method string, rows_affected long, unique_identifiers long")
        return Anonymised(out, audit)
    if method == "hash":
        out = df.withColumns({c: hash_value(qcol(c), salt) for c in cols})
        label = "hashed_sha256"
    elif method == "mask":
        out = df.withColumns({c: mask_value(qcol(c)) for c in cols})
        label = "masked"
    elif method == "pseudonymise":
        if not order_cols:
            raise ValueError("pseudonymise needs order_cols (first-appearance order)")
        label = "pseudonymised"
        for c in cols:
            m = pseudonym_map(df, c, order_cols)
            mapping = m.withColumn("column", F.lit(c)) if mapping is None else \
                mapping.unionByName(m.withColumn("column", F.lit(c)))
            out = out.join(m.withColumnRenamed("value", c), c, "left") \
                .withColumn(c, F.coalesce(F.col("pseudonym"), qcol(c).cast("string"))).drop("pseudonym")
        out = out.select(*df.columns)
    else:
        raise ValueError(f"unknown anonymisation method {method!r}")
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(qcol(c)).alias(f"n{i}"), F.count_distinct(qcol(c)).alias(f"u{i}")]
    wide = out.agg(*aggs) if cols else None
    if wide is None:
        audit = spark.createDataFrame([], "column string, method string, rows_affected long, unique_identifiers long")
    else:
        for i, c in enumerate(cols):
            audit_rows.append({"column": F.lit(c), "method": F.lit(label), "rows_affected": F.col(f"n{i}"),
                               "unique_identifiers": (F.col(f"u{i}") if method == "pseudonymise"
                                                      else F.lit(None)).cast("long")})
        audit = wide_to_long(wide, audit_rows)
    return Anonymised(out, audit, mapping)
