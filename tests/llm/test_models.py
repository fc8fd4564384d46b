"""Licences and toxicity: held-out accuracy, and odd input."""

import random

import numpy as np
import pytest

from tests.llm.helpers import documents
from tidemark.llm import licenses, toxicity


def test_license_held_out():
    m = licenses.trained()
    texts, y = licenses.training_texts(11, 6)
    index = {g: i for i, g in enumerate(m.grams)}
    p = licenses.softmax(licenses.matrix(texts, index) @ m.weights + m.bias)
    assert (p.argmax(axis=1) == y).mean() > 0.95
    unknown = p[y == len(licenses.FAMILIES) - 1][:, :-1].max(axis=1) >= m.cutoff
    assert unknown.mean() < 0.05


def test_license_paragraphs(spark):
    texts = ["Intro.\nReleased under the MIT License.\nmore", "She renewed her driver license.", "", None, "licensed under the apache license, version 2.0.\nAll rights reserved.", "Licensed under CC BY-NC 4.0.", ("Released under the MIT License.",), "x " * 50000 + "Released under the MIT License."]
    got = {}
    for r in licenses.scan_paragraphs(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["paragraph"]] = r["family"]
    assert got[0] == {1: "mit"} and got[1] == {0: "unknown"} and got[4] == {0: "apache-2.0", 1: "proprietary"} and got[5] == {0: "cc-by-nc"}
    assert got.keys() <= {0, 1, 4, 5, 7}
    assert licenses.scan_paragraphs(documents(spark, texts).limit(0)).count() == 0


def test_license_rows_of_one_id(spark):
    """Different texts of one doc_id, and of none, are each reported; rows that are the same get the same."""
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (1, apache), (1, apache), (None, mit), (None, "none"), (2, f"{mit}\n{mit}\n{apache}"), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, paragraph int, content string")
    assert sorted((r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan_paragraphs(docs).collect()) == [(1, 0, "apache-2.0"), (1, 0, "mit"), (2, 0, "mit"), (2, 1, "mit"), (2, 2, "apache-2.0")]
    got = sorted((str(r["doc_id"]), r["licenses"], r["n_confirmed"], r["n_unknown"]) for r in licenses.document_licenses(docs).collect())
    assert got == sorted([("1", "mit", 1, 0), ("1", "apache-2.0", 1, 0), ("1", "apache-2.0", 1, 0), ("None", "mit", 1, 0), ("None", "", 0, 0), ("2", "apache-2.0,mit", 3, 0), ("3", "", 0, 0), ("3", "", 0, 0)])


NOTICES = {
    "mit": "Released under the MIT terms.", "apache-2.0": "Apache, Version 2.0", "gpl-2.0": "General Public version 2 only", "gpl-3.0": "GNU GPL v3.", "lgpl": "GNU Lesser General Public", "agpl": "under the terms of the GNU Affero General Public",
    "mpl-2.0": "Mozilla Public v. 2.0.", "bsd": "Distributed under the BSD 3-Clause terms.", "isc": "Released under the ISC terms.", "cc-by": "Text is available under Creative Commons Attribution 4.0 International.",
    "cc-by-sa": "Content available under CC BY-SA 4.0.", "cc-by-nc": "Available under CC BY-NC 4.0.", "public-domain": "CC0 1.0 Universal.", "proprietary": "No part of this publication may be reproduced",
}


#: Notices as projects write them, none of them a template or made from one.
SEEN = {
    "mit": ["This code is distributed under the MIT license.", "MIT License - see LICENSE for details.", "Code released under the MIT License, docs elsewhere."],
    "apache-2.0": ["Distributed under the Apache License 2.0.", "This project is licensed under the Apache License, Version 2.0 - see the LICENSE.md file.", "Apache License, Version 2.0, January 2004"],
    "gpl-2.0": ["It is distributed under the GNU General Public License version 2.", "Licensed under the GNU GPL version 2 or later."],
    "gpl-3.0": ["Distributed under the GNU General Public License, version 3.", "It is free software, licensed under the GNU GPL v3."],
    "lgpl": ["Distributed under the GNU Lesser General Public License.", "It is covered by the GNU Lesser General Public License, version 2.1."],
    "agpl": ["Distributed under the GNU Affero General Public License.", "Our server is covered by the GNU Affero General Public License."],
    "mpl-2.0": ["Our code is subject to the terms of the Mozilla Public License.", "Distributed under the Mozilla Public License, version 2.0."],
    "bsd": ["Distributed under the BSD 3-Clause License.", "This package is licensed under the BSD 2-Clause License."],
    "isc": ["Distributed under the ISC License.", "This package is released under the ISC license."],
    "cc-by": ["Our photographs are licensed under CC BY 4.0.", "Pictures: licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Our texts are licensed under CC BY-SA 4.0.", "Maps: licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Our songs are licensed under CC BY-NC 4.0.", "Films: licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["These maps have been released into the public domain.", "The data are dedicated to the public domain under CC0."],
    "proprietary": ["(c) Our Company. All rights reserved.", "Unauthorized copying of this document is strictly prohibited."],
    "unknown": ["The fishing licence costs ten pounds a year.", "Public houses need permission to open late.", "The general reserved the right to withdraw.", "Copyright law was reformed in that decade.", "Her domain was the public library.", "Version 2 of the play was a success.", "The apache helicopter landed near the foundation.", "Free copies were distributed under the bridge.", "All conditions were met by the builder.", "They licensed the song to a film company."],
}


def test_license_notices_of_other_hands(spark):
    """Accuracy on notices and sentences that were written apart from the training texts."""
    pairs = [(f, t) for f, ts in SEEN.items() for t in ts]
    made = {x for ts in licenses.TEMPLATES.values() for x in ts} | set(licenses.OTHERS)
    assert not made & {t for _, t in pairs}
    got = {r["doc_id"]: r["family"] for r in licenses.scan_paragraphs(documents(spark, [t for _, t in pairs])).collect()}
    right = [got.get(i, "unknown") == f for i, (f, _) in enumerate(pairs)]
    print([(f, got.get(i), t) for i, (f, t) in enumerate(pairs) if got.get(i, "unknown") != f])
    assert sum(right) >= 0.85 * len(pairs)
    # a sentence that is no notice is never taken for one
    assert all(got.get(i, "unknown") == "unknown" for i, (f, _) in enumerate(pairs) if f == "unknown")


def test_license_notices_without_the_word(spark):
    assert NOTICES.keys() == licenses.TEMPLATES.keys() and not any("licen" in t.lower() for t in NOTICES.values())
    texts = [*NOTICES.values(), "He sat in the shade of the tree.", "Distributed under MPL 2.0."]
    got = {r["doc_id"]: r["family"] for r in licenses.scan_paragraphs(documents(spark, texts)).collect()}
    assert got == dict(enumerate(NOTICES)) | {len(NOTICES) + 1: "unknown"}


def toxic_corpus(seed, n=400):
    rng = random.Random(seed)
    clean, bad = [f"word{i}" for i in range(80)], ["foul", "nasty", "awful", "vile"]
    texts, y = [], []
    for i in range(n):
        t = [rng.choice(clean) for _ in range(rng.randint(5, 60))]
        y.append(int(i % 5 == 0))
        if y[-1]:
            for _ in range(rng.randint(2, 6)):
                t.insert(rng.randrange(len(t)), rng.choice(bad).upper() + rng.choice(["", "!", ","]))
        texts.append(" ".join(t))
    return texts, y


def test_toxicity(spark):
    texts, y = toxic_corpus(1)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([*((i, None, v) for i, v in enumerate(y)), (None, 1, 1), (5, 1, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, per_class=60)
    assert model.thresholds[0] < model.thresholds[1] and len(model.words) <= toxicity.VOCABULARY
    test, want = toxic_corpus(2)
    test += ["", None, "word1 " * 20000, ("FOUL nasty vile awful",)]
    out = toxicity.grade_documents(documents(spark, test).withColumnRenamed("lang", "grade"), model)
    assert out.columns == ["doc_id", "text", "source", "n_chars", *toxicity.OUT]
    rows = out.collect()
    got = [r["toxic"] for r in rows]
    assert np.mean(np.array(got[:400]) == np.array(want, bool)) > 0.99
    assert got[400:] == [False, False, False, True]
    assert all(0 <= r["p_severe"] <= r["p_toxic"] <= 1 and abs(r["expected_severity"] - r["p_toxic"] - r["p_severe"]) < 1e-12 for r in rows)
    assert np.mean([r["expected_severity"] for r, w in zip(rows, want) if w]) > np.mean([r["expected_severity"] for r, w in zip(rows, want) if not w]) + 0.5
    assert toxicity.grade_documents(docs.limit(0), model).count() == 0


def test_toxicity_of_repeated_rows(spark):
    """Rows that share a labelled doc_id, and repeated labels, train the model as one."""
    texts, y = toxic_corpus(3, 200)
    docs, labels = documents(spark, texts), spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int")
    want = toxicity.train(docs, labels)
    for more in (docs.filter("doc_id < 20"), docs.filter("doc_id = 7")):
        got = toxicity.train(docs.unionByName(more).unionByName(more), labels.unionByName(labels.filter("doc_id < 50")))
        assert got.words == want.words and np.allclose(got.weights, want.weights) and abs(got.cutoff - want.cutoff) < 1e-6


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a", None])
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r["expected_severity"] for r in toxicity.grade_documents(docs, model).collect()] == [0.0, 0.0]


def test_cumulative_link_fit():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (3000, 6))
    w = np.array([2.0, -1.5, 1.0, 0, 0, 0.5])
    u = x @ w + rng.logistic(size=3000)
    grade = (u > 1).astype(int) + (u > 3)
    row, f = np.nonzero(x)
    weights, thresholds = toxicity.fit(row, f, grade, 6)
    assert np.corrcoef(weights, w)[0, 1] > 0.95 and thresholds[0] < thresholds[1]
    assert pytest.approx(thresholds[1] - thresholds[0], abs=1.0) == 2.0
