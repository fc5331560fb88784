"""Operator 10: every byte of a word that occurs nowhere else has its price, however long the word is."""

import numpy as np

from isotherm.llm import lm


def test_long_words_are_priced_whole(spark):
    rows = [(k, " ".join(f"w{i % 7}" for i in range(k, k + 40))) for k in range(20)]
    sizes = [65_535, 65_536, 200_000, 2_000_000]
    rows += [(100 + i, chr(97 + i) * n) for i, n in enumerate(sizes)]
    got = {r["doc_id"]: r["log_probability"] for r in lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    longest = [got[100 + i] for i in range(len(sizes))]
    # alone in their texts, all are predicted alike but for their bytes
    assert np.allclose(np.diff(longest), -lm.SPELLED * np.diff(sizes), atol=0.002)  # scores have three decimals
