from pyspark.sql import functions as F

from vitalspark.operators import coding, privacy


def test_phi_golden(patients):
    rep = privacy.detect_phi(patients.drop("row_index"))
    flagged = [(r["column"], r["risk_level"]) for r in rep.where("is_phi").collect()]
    assert flagged == [("patient_id", "HIGH")]
    chk = privacy.privacy_check(rep).first()
    assert (chk["compliance_score"], chk["status"]) == (80, "REVIEW_NEEDED")


def test_value_patterns(spark):
    df = spark.createDataFrame([("mail me at a.b@example.org",), ("call 07700900123 now",), ("born 12/05/1980",),
                                ("nothing here",), ("iso 1980-05-12",)], "note string")
    r = privacy.detect_phi(df).first()
    assert (r["email_hits"], r["phone_hits"], r["date_hits"]) == (1, 1, 1) and r["risk_level"] == "MEDIUM"


def test_hash_and_mask_golden(spark):
    df = spark.createDataFrame([("P001",), ("ab",), (None,)], "v string")
    out = df.select(privacy.hash_value(F.col("v")).alias("h"), privacy.mask_value(F.col("v")).alias("m")).collect()
    assert out[0]["h"] == "df1e40051eff" and out[0]["m"] == "P**1" and out[1]["m"] == "**"
    assert out[2]["h"] is None and out[2]["m"] is None


def test_pseudonymise_first_seen(spark):
    df = spark.createDataFrame([(3, "z"), (1, "y"), (2, "z"), (4, None)], "k int, v string")
    res = privacy.anonymise(df, ["v"], "pseudonymise", order_cols=["k"])
    got = {r["k"]: r["v"] for r in res.data.collect()}
    assert got == {1: "PATIENT_00001", 2: "PATIENT_00002", 3: "PATIENT_00002", 4: None}
    audit = res.audit.first()
    assert (audit["rows_affected"], audit["unique_identifiers"]) == (3, 2)


def test_icd_golden(patients):
    got = {(r["column"], r["icd10_code"]) for r in coding.detect_icd_codes(patients, ["patient_id"]).collect()}
    assert got == {("diabetes_risk", "E11"), ("bmi", "I21")}
    assert coding.drug_interactions(patients).count() == 0


def test_drug_pairs_per_entity(spark):
    df = spark.createDataFrame([(1, "takes Warfarin"), (1, "and aspirin"), (2, "aspirin only"),
                                (3, "lithium with NSAID")], "conv long, text string")
    got = sorted((r["conv"], r["drug_a"], r["drug_b"]) for r in coding.drug_interactions_by(df, ["conv"], "text")
                 .collect())
    assert got == [(1, "warfarin", "aspirin"), (3, "lithium", "nsaid")]


def test_icd_word_boundary_mode(patients):
    got = {(r["column"], r["icd10_code"]) for r in
           coding.detect_icd_codes(patients, ["patient_id"], word_boundary=True).collect()}
    assert got == {("diabetes_risk", "E11")}   # 'mi' no longer matches 'bmi'


def test_icd_parity_mode_first_values(spark):
    df = spark.createDataFrame([(i, "asthma" if i == 25 else f"note {i}") for i in range(30)], "k int, t string")
    assert coding.detect_icd_codes(df, ["k"], max_values=20).count() == 0
    assert coding.detect_icd_codes(df, ["k"]).count() == 1


def test_phi_sample_rows_parity(spark):
    rows = [(i, f"note {i}" if i < 25 else "write to a@b.org") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, note string")
    whole = {r["column"]: r for r in privacy.detect_phi(df, ["id"]).collect()}
    first20 = {r["column"]: r for r in privacy.detect_phi(df, ["id"], sample_rows=20).collect()}
    assert whole["note"]["is_phi"] and whole["note"]["email_hits"] == 5
    assert not first20["note"]["is_phi"] and first20["note"]["non_null"] == 20
    assert first20["note"]["sample"] == "note 0"


def test_value_hits_equal_the_patterns(spark):
    import random
    rng = random.Random(9)
    texts = ["".join(rng.choice("aZ0159_.+-@/ \né\U0001f600") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += [a + b + c for a in ("", " ", "x", "é", "_") for c in ("", " ", "\n", "y", "é", "_", ".")
              for b in ("a@b.co", "@b.co", "a@b.c", "a@.co", "a.@b-1.cC", "0123456789", "01234567890", "012345678901", "012345678",
                        "+1 234567", "+44123456", "+1234 56789", "1/2/34", "11-12-2024", "111/2/34", "1/2/3", "1/2/34567")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    hits = privacy.value_hits(F.col("t"))
    old = [F.col("t").rlike(p) for p in (privacy.EMAIL_PATTERN, privacy.PHONE_PATTERN, privacy.DATE_PATTERN)]
    assert df.where(~F.array(*hits).eqNullSafe(F.array(*old))).count() == 0
    assert all(df.where(h).count() > 5 for h in hits)


def test_a_long_word_is_read_once(spark):
    """The text of one word of 600,000 characters is checked in linear time."""
    import time
    df = spark.createDataFrame([("a" * 600_000,), ("b" * 600_000 + "@x.org",)], "t string")
    start = time.time()
    row = privacy.detect_phi(df).first()
    assert (row["email_hits"], row["phone_hits"], row["date_hits"]) == (1, 0, 0)
    assert time.time() - start < 30
