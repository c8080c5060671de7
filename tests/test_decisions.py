"""Groups of decisions: as folded names, found before lines are joined."""

from pyspark.sql import functions as F

from claimspark.functions.text import ascii_fold
from claimspark.operators import evaluate


def test_groups_are_those_of_folded_names(spark):
    names = [*[n for group in evaluate.EQUIVALENT.values() for n in group], "Medically necessary", " Not-Covered ", "TỪ CHỐI", "đồng ý", "inK", "Pay Full", "pay  full", "", " ", None, "Dény", "reject́"]
    name = F.translate(F.trim(ascii_fold(F.col("n"))), " -", "__")
    want = name
    for group, of in evaluate.EQUIVALENT.items():
        want = F.when(name.isin(*of), group).otherwise(want)
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", evaluate.decision_group(F.col("n")).alias("got"), want.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got] and {r.n: r.got for r in got}[" Not-Covered "] == "deny"


def test_decisions_are_folded_before_lines_are_joined(spark):
    kinds = "case_id long, line_no long, medical string, insurance string, final string"
    gold = spark.createDataFrame([(1, 1, "approve", "deny", "review"), (1, 2, "approve", None, "x"), (2, 1, "approve", "deny", "review"), (3, 1, "pay", "pay", "pay")], kinds)
    sub = spark.createDataFrame([("a", 1, 1, "Pay", "Từ chối", "REVIEW"), ("a", 2, 1, "deny", "reject", "conditional-indication"), ("b", 1, 2, "covered", None, "X")], f"participant string, {kinds}")
    claims = spark.createDataFrame([("a", 1, True, False), ("a", 2, False, True), ("b", 1, True, True), ("b", 9, True, False)], "participant string, case_id long, disease_hit boolean, claim_hit boolean")
    df = evaluate.score_submissions(gold, sub, claims)
    assert df.columns == ["participant", "case_id", "disease_hit", "claim_hit", "medical_score", "insurance_score", "final_score", "weighted_score"]
    got = {(r.participant, r.case_id): tuple(r)[4:] for r in df.collect()}
    assert got == {("a", 1): (0.5, 0.0, 0.5, 0.475), ("a", 2): (0.0, 1.0, 1.0, 0.5), ("b", 1): (0.5, 0.0, 0.5, 0.675), ("b", 9): (0.0, 0.0, 0.0, 0.15)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" in plan and not [line for line in plan.split("\n") if "Aggregate" in line and "translate(" in line]
