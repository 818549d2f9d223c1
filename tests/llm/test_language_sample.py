"""Rows that the language model is fitted on."""

import numpy as np

from palaver.llm import language


def test_copies_are_drawn_one_by_one(spark):
    # One text has a third of the rows; every text is one trigram, so counts of cells are counts of rows.
    rows = [(i, "qqq" if i % 3 == 0 else f"zz{chr(97 + i % 20)}", "en") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, weights = language.fit_text_model(df, rows=600)
    share = np.exp(weights[names.index("en")])
    drawn = 0.5 * share.max() / share.min() - 0.5  # a cell without counts has 0.5
    total = 0.5 / share.min() - 0.5 * language.CELLS
    assert 500 <= total <= 700 and 140 <= drawn <= 260
