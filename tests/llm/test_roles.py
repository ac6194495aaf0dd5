"""Problem 7: roles as typed against the vocabulary."""

import __spark_entry__

VOCAB = [
    ("central_bank", "economic", "monetary authority lending in the last resort", ["bank of issue", "monetary authority"]),
    ("kingmaker", "court", "installs rulers without taking the seat", ["maker of kings", "power behind the throne"]),
    ("merchant_class", "economic", "trading interest that favours openness", ["traders of the port", "shipping merchants"]),
]
WANT = {
    "Central Bank": "central_bank", "bk. of issue": "central_bank", "lender of last resort": "central_bank", "MAKER OF KINGS": "kingmaker",
    "acting mkaer of kings": "kingmaker", "installer of rulers": "kingmaker", "openness_trading_interest": "merchant_class",
    "Merch. Cl.": "merchant_class", "traders of the port, so called": "merchant_class", "merchantclass": "merchant_class", "kings, maker of": "kingmaker",
    "merchant weather": "unmatched", "central railway station": "unmatched", "n/a": "unmatched", "": "unmatched", None: "unmatched",
}


def test_p7_found(spark, tmp_path):
    rows = [(f"w{k:02d}", r, None if k % 2 else "kingmaker", None if k % 3 else 0.4) for k, r in enumerate(WANT)]
    actors = [*rows, *rows[:4], ("strong", "kingmaker", "kingmaker", 0.5)]
    spark.createDataFrame(actors, "id string, role string, canonical_role string, role_fit_confidence double").write.parquet(f"{tmp_path}/actors.parquet")
    spark.createDataFrame(VOCAB, "canonical_role string, family string, gloss string, aliases array<string>").write.parquet(f"{tmp_path}/role_vocab.parquet")
    got = [tuple(r) for r in __spark_entry__.queries()["p7_found"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((i, WANT[r]) for i, r, _, _ in rows)
