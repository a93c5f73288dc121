"""Rules on long texts, and samples of tables with many copies."""

import numpy as np
from pyspark.sql import functions as F

from airspan.llm import langid
from airspan.llm.quality import BAD, GOOD, default_rules


def test_few_different_words_are_bad_at_any_length(spark):
    rows = [(n, k) for n, k in ((4999, 50), (5000, 50), (200_000, 50), (4999, 515), (5001, 515), (100_000, 9000))]
    rule = default_rules()[5]
    got = [r[0] for r in spark.createDataFrame(rows, "n_words long, n_distinct long").select(rule.vote()).collect()]
    assert got == [BAD] * 5 + [GOOD]


def test_copies_of_a_text_are_one_of_the_sample(spark, monkeypatch):
    seen = []
    clustered = langid._clustered
    monkeypatch.setattr(langid, "_clustered", lambda x, k: seen.append(len(x)) or clustered(x, k))
    rows = [(f"text number {i} about thing {i * 7}", "en") for i in range(40)]
    rows += [("the same page", "en")] * 300
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    langid.fit(df, sample_rows=1000)
    assert seen == [41]
