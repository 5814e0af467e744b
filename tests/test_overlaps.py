"""Pairs of claims: counted exactly, and never written or shuffled before they are few."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import overlaps
from quern.functions import text as tx
from quern.operators import rules
from quern.plans import rules as plans


def test_shared_words_like_sets(monkeypatch):
    rng = random.Random(5)
    for rare in (0.0, 1 / 64, 0.3, 2.0):
        monkeypatch.setattr(overlaps, "RARE", rare)
        sides = [[sorted({f"w{int(rng.random() ** 3 * 90)}" for _ in range(rng.randrange(1, 20))}) for _ in range(n)] for n in (37, 61)]
        i, j, similarity = overlaps.overlapping(*(pa.array(x) for x in sides), 0.2)
        got = dict(zip(zip(i.tolist(), j.tolist()), similarity.tolist()))
        each = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for a, x in enumerate(sides[0]) for b, y in enumerate(sides[1])}
        assert got == {k: v for k, v in each.items() if v >= 0.2}


def claims(spark, n=60):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(40)]
    rows = [(f"p{k % 3}", f"d{k}.md", "project_md", "instruction", "\n".join(f"{rng.choice(('never', 'always'))} {' '.join(rng.sample(words, 9))}" for _ in range(6))) for k in range(n)]
    return spark.createDataFrame(rows, "project string, rel string, kind string, category string, content string")


def test_tiles_like_joins(spark, monkeypatch):
    classes = rules.claim_classes(rules.claims_of(claims(spark)))
    columns = ["similarity", "prohibits.rel", "prohibits.line_no", "prohibit_members", "allows.rel", "allows.line_no", "allow_members"]
    rows = lambda most: sorted(tuple(r) for r in rules.opposing_claims(classes, most=most).select(columns).collect())
    joined = rows(1_000_000)  # few enough for the join
    assert len(joined) > 100
    monkeypatch.setattr(rules, "FEW", 0)
    assert joined == rows(1_000_000) == rows(400)


def test_pairs_are_not_shuffled(spark):
    pairs = rules.opposing_claims(rules.claim_classes(rules.claims_of(claims(spark, 3))))
    plan = pairs._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Aggregate(keys=[a#" not in plan


def test_findings_are_not_written(spark, sf_dir, monkeypatch):
    written = []
    monkeypatch.setattr(plans, "cut_lineage", lambda df: written.append({r["rule"] for r in df.select("rule").distinct().collect()}) or df)
    for name in ("f10_finding_ids", "f13_ranked", "f14_summary", "f16_suppression"):
        plans.QUERIES[name](spark, sf_dir)
    assert len(written) == 1 and "CA-C001" not in written[0]


def test_contradictions_are_masked_by_class(spark):
    rows = [("p", "home/ann@x.example.md", "a", "instruction", "never push the branch"), ("p", "token=abcdefgh12.md", "a", "instruction", "always push the branch"), ("p", "-----BEGIN A", "a", "instruction", "always push one branch")]
    targets = spark.createDataFrame([(*r, None, None) for r in rows], "project string, rel string, kind string, category string, content string, path string, skill_name string")
    plain = rules.masked_findings(rules.rule_contradiction(targets, None))
    masked = rules.run_rules(targets, {"CA-C001": rules.rule_contradiction})
    assert sorted(map(tuple, masked.collect())) == sorted(map(tuple, plain.collect())) and masked.where(F.col("what").contains("REDACTED")).count() == 1


def test_no_claim_is_passed_over(spark):
    lines = ["You MUST not push", "Mustn’t", "NEVER", "ALWAYS", "Cannot", "is not permitted", "avoid it", "should", "allowed", "禁止", "してよい", "許可", "すること。", "べきでない", "するな", "plain"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert df.where(tx.polarity_of(F.col("line")).isNotNull() & ~tx.may_point(F.col("line"))).count() == 0 and df.where(tx.may_point(F.col("line"))).count() == 15
