"""Values per position come from a model that meets the text before it is taken apart."""

import math

from respmosaic.operators import scoring


def test_positions_of_own_items_are_not_shuffled(spark):
    seqs = spark.createDataFrame([("a", 1, "ACGTAC"), ("b", 2, "GGXGG"), ("b", 3, "A"), ("b", 4, None)], "entity string, item long, seq string")
    model = scoring.fit_markov(seqs.select("entity", "seq"), 1)
    rows = scoring.ar_positions(model, seqs.select("item", "seq"), 1, seqs.select("entity", "item"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")  # texts are taken apart after the last join
    got = {(r["entity"], r["item"], r["pos"]): r["logp"] for r in rows.collect()}
    ln = math.log
    want = {("a", 1, p): ln(n / d) for p, (n, d) in {1: (3, 6), 2: (2, 5), 3: (2, 5), 4: (2, 5), 5: (3, 6)}.items()}
    want |= {("b", 2, 1): ln(3 / 6), ("b", 2, 4): ln(3 / 6)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
