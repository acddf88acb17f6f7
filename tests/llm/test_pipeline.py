"""Stages of the pipeline against brute-force versions, null and repeated ids among the rows."""

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from test_operators import DOCS, like_components, odd, sentence  # noqa: F401

from millrace.llm import quality
from millrace.llm.common import ARROW_BYTES, arrow_bytes


def test_near_dedup_stage(spark):
    """One row a group, whatever ids its rows have."""
    a, b, c, d, e = (sentence(300 + i, 120) for i in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (1, c), (1, d), (1, d), (2, d + " more"), (None, c), (None, e), (3, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect())
    assert [x for x in got if x[1] not in (b, b + " more")] == sorted([(0, a), (1, c), (1, d), (0, e), (3, "")])
    assert sum(t in (b, b + " more") for _, t in got) == 1


def test_batches_are_bounded(spark):
    """Inside arrow_bytes() no batch of several rows is much over the bound; the setting is as before after it, errors included."""
    was = spark.conf.get(ARROW_BYTES, None)
    df = spark.range(40, numPartitions=1).selectExpr("repeat('x', 100000) as t")
    sizes = lambda: [r.n for r in df.mapInPandas(lambda it: (pd.DataFrame({"n": [len(x)]}) for x in it), "n long").collect()]
    with pytest.raises(KeyError), arrow_bytes(spark, 1 << 20):
        got = sizes()
        raise KeyError
    assert sum(got) == 40 and max(got) <= 11 and sizes() == [40] and spark.conf.get(ARROW_BYTES, None) == was


def test_scores_carry_columns_in_order(spark):
    """The text and others come back as they were, whatever order they are asked for, over more rows than one batch out."""
    n = quality.OUT + 7
    docs = spark.createDataFrame([(i, None if i % 5 == 0 else f"t{i}", f"s{i}") for i in range(n)], "doc_id long, text string, source string").coalesce(1)
    model = quality.Model({}, np.zeros((0, 1), "f4"), np.zeros((0, 1), "f4"), np.zeros(0), 0.5)
    out = quality.score(docs, model, carry=("source", "text"))
    assert out.columns == ["doc_id", "source", "text", "score"]
    assert sorted(map(tuple, out.collect())) == sorted((i, s, t, 0.5) for i, t, s in map(tuple, docs.collect()))
