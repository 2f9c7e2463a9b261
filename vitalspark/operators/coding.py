"""Clinical coding hints (ICD-1, ICD-2) and drug-interaction flags (DRG-1, DRG-2).

Dictionary matching is a single CASE chain in dictionary order (first match
wins), evaluated map-side on every distinct lower-cased value -- no join
with the dictionary, no per-value Python.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_text, qcol

# Keyword -> (ICD-10 code, description), in matching order.
ICD10_COMMON = (
    ("diabetes", "E11", "Type 2 diabetes mellitus"),
    ("hypertension", "I10", "Essential hypertension"),
    ("heart_failure", "I50", "Heart failure"),
    ("obesity", "E66", "Obesity"),
    ("asthma", "J45", "Asthma"),
    ("copd", "J44", "Chronic obstructive pulmonary disease"),
    ("depression", "F32", "Major depressive episode"),
    ("anxiety", "F41", "Anxiety disorders"),
    ("stroke", "I63", "Cerebral infarction"),
    ("pneumonia", "J18", "Pneumonia, unspecified"),
    ("sepsis", "A41", "Other sepsis"),
    ("ckd", "N18", "Chronic kidney disease"),
    ("anemia", "D64", "Other anaemias"),
    ("fracture", "M84", "Disorders of continuity of bone"),
    ("cancer", "C80", "Malignant neoplasm, primary site unknown"),
    ("infection", "B99", "Other and unspecified infectious diseases"),
    ("atrial_fib", "I48", "Atrial fibrillation and flutter"),
    ("mi", "I21", "Acute myocardial infarction"),
    ("liver", "K76", "Other diseases of liver"),
    ("alzheimer", "G30", "Alzheimer's disease"),
)

# Interacting pairs (drug_a, drug_b, severity, message).
DRUG_INTERACTIONS = (
    ("warfarin", "aspirin", "HIGH", "Increased bleeding risk"),
    ("metformin", "alcohol", "MEDIUM", "Lactic acidosis risk"),
    ("ssri", "maoi", "HIGH", "Serotonin syndrome — CONTRAINDICATED"),
    ("statins", "grapefruit", "MEDIUM", "Increased statin levels"),
    ("ace", "potassium", "MEDIUM", "Hyperkalaemia risk"),
    ("nsaid", "warfarin", "HIGH", "Bleeding risk — avoid combination"),
    ("digoxin", "amiodarone", "HIGH", "Digoxin toxicity risk"),
    ("lithium", "nsaid", "HIGH", "Lithium toxicity risk"),
)


def _phrase(keyword: str) -> str:
    return keyword.replace("_", " ")


def _contains(text: Column, keyword: str, word_boundary: bool) -> Column:
    phrase = _phrase(keyword)
    return text.rlike(r"(^|[^a-z0-9_])" + re.escape(phrase) + r"($|[^a-z0-9_])") if word_boundary \
        else F.contains(text, F.lit(phrase))


def first_keyword(text: Column, dictionary: Sequence[tuple] = ICD10_COMMON, word_boundary: bool = False) -> Column:
    """Index of the first dictionary keyword contained in ``text`` (already
    lower-cased), NULL when none.  ``word_boundary`` stops the reference's
    over-matching ('mi' in 'bmi', 'liver' in 'delivery')."""
    expr = None
    for i, entry in enumerate(dictionary):
        hit = _contains(text, entry[0], word_boundary)
        expr = F.when(hit, F.lit(i)) if expr is None else expr.when(hit, F.lit(i))
    return expr


def all_keywords(text: Column, dictionary: Sequence[tuple] = ICD10_COMMON, word_boundary: bool = False) -> Column:
    """Indices of all dictionary keywords contained in ``text`` (already
    lower-cased), for texts that name several conditions."""
    return F.filter(F.array(*[F.when(_contains(text, entry[0], word_boundary), F.lit(i))
                              for i, entry in enumerate(dictionary)]), lambda x: x.isNotNull())


def _dictionary_df(spark, dictionary):
    return spark.createDataFrame([(i, k, c, d) for i, (k, c, d) in enumerate(dictionary)],
                                 "_kw int, keyword string, icd10_code string, description string")


def detect_icd_codes(df: DataFrame, order_cols: Sequence[str], dictionary: Sequence[tuple] = ICD10_COMMON,
                     max_values: int | None = None, word_boundary: bool = False) -> DataFrame:
    """ICD-1 + ICD-2: one suggestion per (column, code).  Column-name
    matches come first; then every distinct lower-cased text value (or only
    the first ``max_values`` distinct values per column, for parity with the
    reference's 20) in first-appearance order.  Substring matching
    over-fires exactly like the reference ('mi' in 'bmi')."""
    spark = df.sparkSession
    name_rows = []
    for pos, col in enumerate(df.columns):
        low = col.lower().replace("_", " ")
        for i, (kw, code, desc) in enumerate(dictionary):
            found = re.search(r"(^|[^a-z0-9_])" + re.escape(_phrase(kw)) + r"($|[^a-z0-9_])", low) \
                if word_boundary else _phrase(kw) in low
            if found:
                name_rows.append((col, pos, 0, None, i))
                break
    names = spark.createDataFrame(name_rows, "column string, position int, _stage int, value string, _kw int")
    txt = [(pos, f.name) for pos, f in enumerate(df.schema.fields) if is_text(f.dataType) and f.name not in order_cols]
    found = names
    if txt:
        long = df.select(*[qcol(c) for c in order_cols], F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lit(pos).alias("position"), F.lower(qcol(c)).alias("value"))
            for pos, c in txt])).alias("_u")).select(*order_cols, "_u.*").where(F.col("value").isNotNull())
        first_seen = F.struct(*[qcol(c) for c in order_cols])
        if max_values is None:
            # Every value counts: the keyword is a function of the value, so
            # match row by row and keep the first-appearing value per code --
            # no shuffle of distinct texts.
            hits = long.withColumn("_kw", first_keyword(F.col("value"), dictionary, word_boundary)) \
                .where(F.col("_kw").isNotNull())
            per_code = hits.groupBy("column", "position", "_kw").agg(F.min_by("value", first_seen).alias("value"))
        else:
            from pyspark.sql import Window
            distinct = long.groupBy("column", "position", "value").agg(F.min(first_seen).alias("_first"))
            w = Window.partitionBy("column").orderBy("_first")
            distinct = distinct.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_values).drop("_r")
            hits = distinct.withColumn("_kw", first_keyword(F.col("value"), dictionary, word_boundary)) \
                .where(F.col("_kw").isNotNull())
            per_code = hits.groupBy("column", "position", "_kw").agg(F.min_by("value", "_first").alias("value"))
        found = names.unionByName(per_code.withColumn("_stage", F.lit(1)))
    dic = F.broadcast(_dictionary_df(spark, dictionary))
    joined = found.join(dic, "_kw")
    # ICD-2: first suggestion per (column, code): name match before values.
    best = joined.groupBy("column", "position", "icd10_code").agg(
        F.min_by(F.struct("_stage", "value", "keyword", "description"), F.struct("_stage", "_kw")).alias("b"))
    return best.select("column", "position", "icd10_code", F.col("b.keyword").alias("keyword"),
                       F.col("b.description").alias("description"),
                       F.when(F.col("b._stage") == 0, "column_name").otherwise("value").alias("match_type"),
                       F.col("b.value").alias("value"))


def _terms(pairs) -> list[str]:
    seen = []
    for a, b, _, _ in pairs:
        for t in (a, b):
            if t not in seen:
                seen.append(t)
    return seen


def drug_interactions(df: DataFrame, pairs: Sequence[tuple] = DRUG_INTERACTIONS) -> DataFrame:
    """DRG-1: pairs whose two terms both occur somewhere in the column names
    or in any lower-cased text value (whole columns, one aggregate)."""
    terms = _terms(pairs)
    names = " ".join(df.columns).lower()
    txt = [f.name for f in df.schema.fields if is_text(f.dataType)]
    aggs = []
    for i, t in enumerate(terms):
        hit = F.lit(t in names)
        for c in txt:
            hit = hit | F.coalesce(F.contains(F.lower(qcol(c)), F.lit(t)), F.lit(False))
        aggs.append(F.bool_or(hit).alias(f"t{i}"))
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(a).alias("drug_a"), F.lit(b).alias("drug_b"), F.lit(sev).alias("severity"),
                     F.lit(msg).alias("message"),
                     (F.coalesce(F.col(f"t{terms.index(a)}"), F.lit(False))
                      & F.coalesce(F.col(f"t{terms.index(b)}"), F.lit(False))).alias("_found"))
            for a, b, sev, msg in pairs]
    return wide.select(F.explode(F.array(*rows)).alias("r")).where("r._found") \
        .select("r.drug_a", "r.drug_b", "r.severity", "r.message")


def drug_interactions_by(df: DataFrame, key_cols: Sequence[str], text_col: str,
                         pairs: Sequence[tuple] = DRUG_INTERACTIONS) -> DataFrame:
    """DRG-2: interacting pairs whose two terms occur within the same entity
    (e.g. a conversation).  Each row yields the (<= #terms) terms it contains;
    (entity, term) is deduplicated with partial aggregation, so an entity's
    state is bounded by the term list however many rows it has."""
    terms = _terms(pairs)
    low = F.lower(qcol(text_col))
    present = F.filter(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in terms]),
                       lambda x: x.isNotNull())
    per = df.select(*[qcol(k) for k in key_cols], F.explode(present).alias("term")) \
        .groupBy(*key_cols).agg(F.collect_set("term").alias("_terms"))
    rows = [F.struct(F.lit(a).alias("drug_a"), F.lit(b).alias("drug_b"), F.lit(sev).alias("severity"),
                     F.lit(msg).alias("message"),
                     (F.array_contains("_terms", a) & F.array_contains("_terms", b)).alias("_found"))
            for a, b, sev, msg in pairs]
    return per.select(*key_cols, F.explode(F.array(*rows)).alias("r")).where("r._found") \
        .select(*key_cols, "r.drug_a", "r.drug_b", "r.severity", "r.message")
