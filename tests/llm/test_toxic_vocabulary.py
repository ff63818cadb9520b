"""Recall of the chain where toxic texts draw on many different words."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from llm import toxicity
from llm.registry import ship


def test_many_toxic_words_are_recalled(spark):
    ship(spark)
    rng = random.Random(4)
    make = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(6, 11)))
    plain, bad = [make() for _ in range(500)], [make() for _ in range(120)]
    rows = []
    for i in range(3000):
        w, toxic = rng.choices(plain, k=40), i % 5 == 0
        if toxic:
            for word in rng.sample(bad, 2):
                w[rng.randrange(len(w))] = word
        rows.append((i, " ".join(w), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4).cache()
    chain = toxicity.fit_chain(frame, frame.filter("doc_id % 3 != 0"), {"toxic": F.col("toxic")})
    out = toxicity.score(frame.filter("doc_id % 3 = 0").withColumnRenamed("toxic", "label"), chain).select("label", "toxic").collect()
    recall = np.mean([r.toxic for r in out if r.label])
    alarms = np.mean([r.toxic for r in out if not r.label])
    assert recall > 0.9 and alarms < 0.05, (recall, alarms)
