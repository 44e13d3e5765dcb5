import zlib

import numpy as np
import pytest

from barflow.llm import quality, registry
from barflow.llm.common import load

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return registry.op2_quality_classifier(spark, SF).join(load(spark, SF, "labels"), "doc_id").toPandas()


def test_held_out_accuracy(scored):
    held = scored[scored.held_out]
    assert len(held) > 300 and (held.predicted == held.quality).mean() >= 0.97
    assert ((scored.score >= 0.3) == (scored.predicted == 1)).all() and scored.score.between(0, 1).all()
    assert (scored.held_out == scored.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_edges_are_scored(spark, docs, corpus, no_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(None, 1, 1), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels, steps=100)
    assert quality.score(docs, model).count() == len(corpus)
    kept = quality.score(docs, model, keep=True)
    assert kept.columns == docs.columns and kept.count() <= len(corpus)
    assert quality.score(no_docs, model).count() == 0
    none = quality.fit(no_docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_negative_risk_stays_bounded():
    r = np.random.default_rng(0)
    p, u = r.normal(1, 1, (400, 4)), np.vstack([r.normal(1, 1, (500, 4)), r.normal(-1, 1, (500, 4))])
    first = quality._train(p[:200], u[::2], None, 8, 500, 1)
    prior = quality.estimate_prior(first.score(p[200:]), first.score(u[1::2]))
    assert 0.35 <= prior <= 0.7
    model = quality._train(p, u, prior, 8, 1500, 1)
    assert (model.score(r.normal(1, 1, (300, 4))) >= 0.5).mean() > 0.85 and (model.score(r.normal(-1, 1, (300, 4))) < 0.5).mean() > 0.85
