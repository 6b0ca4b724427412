"""Insults beyond the first letters of long runs, and landmarks from scripts without spaces."""

import random

import pandas as pd
import pytest

from plumbline.llm import records, toxicity
from plumbline.llm.queries import tokenizer_path

CASES = [
    "y o u a r e s u c h a v e r y v e r y w o r t h l e s s i d i o t",
    "nobody/would_ever-think,that/you,idiot,know",
    "Donaudampfschifffahrtsgesellschaftskapitaensidiot",
    "a" * 20 + "bc" * 4000 + "idiot" + "bd" * 3000,
    "sie,idiot",
]


@pytest.mark.parametrize("text", CASES)
def test_insult_late_in_a_run(text):
    assert toxicity.Matcher(["idiot"]).values([text])[0, 0] > 0.9


def test_whole_words_keep_their_values():
    matcher = toxicity.Matcher(["idiot", "worthless"])
    found = matcher.values(["an iddiot", "i.d.i.o.t", "thereon", None, "x" * 5000])
    assert found[0, 0] == pytest.approx(matcher.landmarks.near(["iddiot"])[2].max())
    assert found[1, 0] == pytest.approx(1) and not found[2:].any()


def test_script_without_spaces():
    text = "今日は天気がとても良いので公園へ散歩に行きましたが君は本当に救いようのない馬鹿野郎だと思います"
    assert toxicity.Matcher(["馬鹿野郎"]).values([text])[0, 0] > 0.9
    words = next(toxicity.distinct_words(iter([pd.DataFrame({"text": [text], "toxic": [1]})])))["word"]
    assert any("馬鹿野郎" in w for w in words) and words.str.len().max() <= toxicity.LONGEST


def test_long_texts_are_encoded_in_parts(monkeypatch):
    monkeypatch.setattr(records, "BATCH_CHARS", 40)
    path = tokenizer_path()
    encoder = records.Encoder(path, True)
    draw = random.Random(4)
    pieces = ["word", "a", ".", ",", " ", "  ", "\n", "\t", "\u00e9t\u00e9", "\u00a0", "\u3000", "\u4e2d", "don't", "12", " x", "\r\n", "<|endoftext|>", "_", "-- "]
    for _ in range(300):
        text = "".join(draw.choices(pieces, k=draw.randrange(1, 200)))
        cut = list(records.parts(text, 40))
        assert "".join(cut) == text and all(len(part) >= 40 for part in cut[:-1])
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
