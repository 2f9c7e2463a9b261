"""Privacy and clinical-coding queries (PHI, ANO, ICD, DRG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding, privacy
from .base import register, table

_DOC_COLS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def _phi_sql() -> str:
    parts = []
    for i, (c, t) in enumerate(_DOC_COLS.items()):
        v = f"CAST({c} AS VARCHAR)"
        hit = (f"count_if(regexp_matches({v}, '{privacy.EMAIL_PATTERN}')) + count_if(regexp_matches({v},"
               f" '{privacy.PHONE_PATTERN}')) + count_if(regexp_matches({v}, '{privacy.DATE_PATTERN}')) > 0")
        by_name = privacy.name_match(c)
        high = privacy.name_match(c, privacy.HIGH_RISK_NAME_PATTERNS)
        phi = "true" if by_name else hit
        parts.append(
            f"SELECT '{c}' AS \"column\", {i} AS position, '{t}' AS dtype, {str(by_name).lower()} AS name_match,"
            f" count({c}) AS non_null, count_if(regexp_matches({v}, '{privacy.EMAIL_PATTERN}')) AS email_hits,"
            f" count_if(regexp_matches({v}, '{privacy.PHONE_PATTERN}')) AS phone_hits,"
            f" count_if(regexp_matches({v}, '{privacy.DATE_PATTERN}')) AS date_hits, {phi} AS is_phi,"
            f" CASE WHEN {phi} THEN '{'HIGH' if high else 'MEDIUM'}' END AS risk_level,"
            f" coalesce(arg_min({v}, doc_id), '') AS sample FROM documents")
    return " UNION ALL ".join(parts)


PHI_SQL = _phi_sql()


@register("phi_detect", "PHI-1", PHI_SQL)
def phi_detect(spark, sf_dir):
    return privacy.detect_phi(table(spark, sf_dir, "documents").select(*_DOC_COLS), key_cols=["doc_id"])


@register("privacy_check", "PHI-2",
          f"WITH r AS ({PHI_SQL}), c AS (SELECT count(*) AS total_columns, count_if(is_phi) AS flagged_columns,"
          " count_if(risk_level = 'HIGH') AS high_risk_count, count_if(risk_level = 'MEDIUM') AS medium_risk_count"
          " FROM r) SELECT *, CAST(greatest(0, 100 - 20 * high_risk_count - 10 * medium_risk_count) AS BIGINT)"
          " AS compliance_score, CASE WHEN greatest(0, 100 - 20 * high_risk_count - 10 * medium_risk_count) >= 90"
          " THEN 'COMPLIANT' WHEN greatest(0, 100 - 20 * high_risk_count - 10 * medium_risk_count) >= 60"
          " THEN 'REVIEW_NEEDED' ELSE 'NON_COMPLIANT' END AS status FROM c")
def privacy_check_q(spark, sf_dir):
    return privacy.privacy_check(privacy.detect_phi(table(spark, sf_dir, "documents").select(*_DOC_COLS)))


def _advice_sql() -> str:
    q = lambda t: "'" + t.replace("'", "''") + "'"
    part = lambda n, text, when: f"SELECT {n} AS n, {text} AS recommendation FROM a WHERE {when}"
    return (f"WITH r AS ({PHI_SQL}), a AS (SELECT count_if(is_phi) AS flagged, count_if(risk_level = 'HIGH') AS h,"
            " count_if(risk_level = 'MEDIUM') AS m,"
            " string_agg(CASE WHEN risk_level = 'HIGH' THEN \"column\" END, ', ' ORDER BY position) AS high,"
            " string_agg(CASE WHEN risk_level = 'MEDIUM' THEN \"column\" END, ', ' ORDER BY position) AS medium FROM r),"
            " t AS (" + " UNION ALL ".join([
                part(0, q(privacy.ADVICE_URGENT), "greatest(0, 100 - 20 * h - 10 * m) < 60"),
                part(1, q(privacy.ADVICE_HIGH) + " || high", "h > 0"),
                part(2, q(privacy.ADVICE_MEDIUM) + " || medium", "m > 0"),
                part(3, q(privacy.ADVICE_ALWAYS[0]), "true"), part(4, q(privacy.ADVICE_ALWAYS[1]), "true"),
                part(5, q(privacy.ADVICE_NONE), "flagged = 0")]) + ")"
            " SELECT CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS position, recommendation FROM t")


@register("privacy_advice", "PHI-2", _advice_sql())
def privacy_advice(spark, sf_dir):
    return privacy.privacy_advice(privacy.detect_phi(table(spark, sf_dir, "documents").select(*_DOC_COLS)))


CUSTOMER_MASK_SQL = ("SELECT c_custkey, c_name, c_acctbal,"
                     " CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN substring(c_mktsegment, 1, 2)"
                     " ELSE c_mktsegment END AS c_mktsegment FROM customer")


def _customer_masked_input(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    seg = F.when(F.col("c_custkey") % 7 == 0, None).when(F.col("c_custkey") % 5 == 0,
                                                          F.substring("c_mktsegment", 1, 2)) \
        .otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", "c_name", "c_acctbal", seg.alias("c_mktsegment"))


@register("anonymise_hash", "ANO-1",
          f"SELECT c_custkey, substring(sha256(c_name), 1, 12) AS c_name, substring(sha256(CAST(c_acctbal AS VARCHAR)),"
          f" 1, 12) AS c_acctbal, CASE WHEN c_mktsegment IS NOT NULL THEN substring(sha256(c_mktsegment), 1, 12) END"
          f" AS c_mktsegment FROM ({CUSTOMER_MASK_SQL})")
def anonymise_hash(spark, sf_dir):
    return privacy.anonymise(_customer_masked_input(spark, sf_dir), ["c_name", "c_acctbal", "c_mktsegment"]).data


def _mask_sql(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN length({c}) <= 2 THEN repeat('*', length({c}))"
            f" ELSE substring({c}, 1, 1) || repeat('*', length({c}) - 2) || substring({c}, length({c}), 1) END")


@register("anonymise_mask", "ANO-2 ANO-3",
          f"SELECT c_custkey, {_mask_sql('c_name')} AS c_name, {_mask_sql('c_mktsegment')} AS c_mktsegment"
          f" FROM ({CUSTOMER_MASK_SQL})")
def anonymise_mask(spark, sf_dir):
    df = _customer_masked_input(spark, sf_dir)
    masked = privacy.anonymise(df, ["c_name", "c_mktsegment"], "mask").data
    return privacy.anonymise(masked, ["c_acctbal"], "drop").data


PSEUDO_SQL = ("WITH f AS (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey),"
              " m AS (SELECT o_custkey, printf('PATIENT_%05d', row_number() OVER (ORDER BY k, o_custkey)) AS p FROM f)")


@register("anonymise_pseudo", "ANO-4",
          PSEUDO_SQL + " SELECT o_orderkey, p AS o_custkey, o_orderstatus FROM orders JOIN m USING (o_custkey)")
def anonymise_pseudo(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return privacy.anonymise(o, ["o_custkey"], "pseudonymise", order_cols=["o_orderkey"]).data


@register("anonymise_audit", "ANO-5",
          "SELECT 'o_custkey' AS \"column\", 'pseudonymised' AS method, count(o_custkey) AS rows_affected,"
          " count(DISTINCT o_custkey) AS unique_identifiers FROM orders")
def anonymise_audit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return privacy.anonymise(o, ["o_custkey"], "pseudonymise", order_cols=["o_orderkey"]).audit


# ---------------------------------------------------------------- coding


def _kw_case(v: str) -> str:
    whens = " ".join(f"WHEN contains({v}, '{k.replace('_', ' ')}') THEN {i}"
                     for i, (k, _, _) in enumerate(coding.ICD10_COMMON))
    return f"CASE {whens} END"


def _dict_values() -> str:
    return ", ".join(f"({i}, '{k}', '{c}', '{d.replace(chr(39), chr(39) * 2)}')"
                     for i, (k, c, d) in enumerate(coding.ICD10_COMMON))


_ICD_COLS = (("text", 1), ("lang", 2), ("source", 3))


@register("icd_codes", "ICD-1 ICD-2",
          "WITH l AS (" + " UNION ALL ".join(
              f"SELECT doc_id, '{c}' AS \"column\", {p} AS position, lower({c}) AS value FROM documents"
              f" WHERE {c} IS NOT NULL" for c, p in _ICD_COLS)
          + f"), h AS (SELECT *, {_kw_case('value')} AS kw FROM l),"
          " g AS (SELECT \"column\", position, kw, arg_min(value, doc_id) AS value FROM h WHERE kw IS NOT NULL"
          f" GROUP BY ALL), dic(kw, keyword, icd10_code, description) AS (VALUES {_dict_values()})"
          " SELECT \"column\", position, icd10_code, keyword, description, 'value' AS match_type, value"
          " FROM g JOIN dic USING (kw)")
def icd_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return coding.detect_icd_codes(d, ["doc_id"])


@register("icd_documents", "ICD-1",
          f"WITH dic(kw, keyword, icd10_code, description) AS (VALUES {_dict_values()})"
          " SELECT doc_id, keyword, icd10_code FROM documents JOIN dic"
          " ON contains(lower(text), replace(keyword, '_', ' '))")
def icd_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    kw = F.explode(coding.all_keywords(F.lower("text")))
    dic = F.broadcast(spark.createDataFrame([(i, k, c) for i, (k, c, _) in enumerate(coding.ICD10_COMMON)],
                                            "_kw int, keyword string, icd10_code string"))
    return d.select("doc_id", kw.alias("_kw")).join(dic, "_kw") \
        .select("doc_id", "keyword", "icd10_code")


# Drug terms injected into the invented conversation prose, the same way in
# Spark and SQL, so the interaction tables have something to find.
CONV_SQL = ("SELECT conv_id, turn, role, text || CASE WHEN turn % 5 = 0 THEN ' Patient takes Warfarin daily.'"
            " ELSE '' END || CASE WHEN conv_id % 3 = 0 AND turn = 1 THEN ' Also aspirin.' ELSE '' END"
            " || CASE WHEN conv_id % 4 = 0 THEN ' lithium, NSAID' ELSE '' END AS text FROM conversations")


def conversations_with_terms(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    extra = F.concat(
        F.when(F.col("turn") % 5 == 0, F.lit(" Patient takes Warfarin daily.")).otherwise(F.lit("")),
        F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 1), F.lit(" Also aspirin.")).otherwise(F.lit("")),
        F.when(F.col("conv_id") % 4 == 0, F.lit(" lithium, NSAID")).otherwise(F.lit("")))
    return c.select("conv_id", "turn", "role", F.concat("text", extra).alias("text"))


def _pairs_values() -> str:
    return ", ".join(f"('{a}', '{b}', '{s}', '{m}')" for a, b, s, m in coding.DRUG_INTERACTIONS)


_TERMS = []
for _a, _b, _, _ in coding.DRUG_INTERACTIONS:
    for _t in (_a, _b):
        if _t not in _TERMS:
            _TERMS.append(_t)


@register("drug_flags", "DRG-1",
          f"WITH c AS ({CONV_SQL}), t AS (SELECT " + ", ".join(
              f"bool_or(contains(lower(role), '{t}') OR contains(lower(text), '{t}')"
              f" OR {str(t in 'conv_id turn role text').lower()}) AS \"{t}\"" for t in _TERMS)
          + f" FROM c), p(drug_a, drug_b, severity, message) AS (VALUES {_pairs_values()})"
          " SELECT drug_a, drug_b, severity, message FROM p, t WHERE " + " OR ".join(
              f"(drug_a = '{a}' AND drug_b = '{b}' AND t.\"{a}\" AND t.\"{b}\")"
              for a, b, _, _ in coding.DRUG_INTERACTIONS))
def drug_flags(spark, sf_dir):
    return coding.drug_interactions(conversations_with_terms(spark, sf_dir))


@register("drug_pairs", "DRG-2",
          f"WITH c AS ({CONV_SQL}), t AS (SELECT conv_id, " + ", ".join(
              f"bool_or(contains(lower(text), '{t}')) AS \"{t}\"" for t in _TERMS)
          + f" FROM c GROUP BY conv_id), p(drug_a, drug_b, severity, message) AS (VALUES {_pairs_values()})"
          " SELECT conv_id, drug_a, drug_b, severity, message FROM p, t WHERE " + " OR ".join(
              f"(drug_a = '{a}' AND drug_b = '{b}' AND t.\"{a}\" AND t.\"{b}\")"
              for a, b, _, _ in coding.DRUG_INTERACTIONS))
def drug_pairs(spark, sf_dir):
    return coding.drug_interactions_by(conversations_with_terms(spark, sf_dir), ["conv_id"], "text")
