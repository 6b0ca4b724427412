"""Every training word gets a class from its neighbours, rare words too."""

import numpy as np

from plumbline.llm import brown


def test_rare_words_are_classed_by_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown, "SEEDS", 30)
    monkeypatch.setattr(brown, "SHARED_WORDS", 30)
    rng = np.random.default_rng(3)
    kinds = ("noun", "verb")
    rows = []
    for i in range(3000):
        noun, verb = rng.integers(400), rng.integers(400)
        rows.append((i, f"the noun{noun} will verb{verb} the noun{rng.integers(400)} and will verb{rng.integers(400)}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, classes = brown.fit_classes(docs, brown.vocabulary(docs))
    names = {int(h): kind for kind in kinds for h in brown.signed([f"{kind}{i}".encode() for i in range(400)])}
    found = {kind: [] for kind in kinds}
    for r in classes.collect():
        assert r.cls < len(model.transition) - 1  # no word is left in the class of unseen ones
        if r.word in names:
            found[names[r.word]].append(r.cls)
    assert len(found["noun"]) > 390 and len(found["verb"]) > 390
    assert not set(found["noun"]) & set(found["verb"])


def test_classes_grow_with_the_vocabulary():
    assert brown.class_number(100) == brown.CLASSES < brown.class_number(10**6) < brown.class_number(10**8)
