"""Parcels by relays give what direct ones give."""

import pytest

from tablescout.llm import dealing, ngrams, substrings, suffixes

from .test_operators import made, texts


@pytest.mark.parametrize("run", [substrings.drop_repeated_windows, suffixes.drop_repeated_bytes, ngrams.score_texts])
def test_relays(spark, monkeypatch, run):
    monkeypatch.setattr(dealing, "parts", lambda frame, each_mb=8: 11)
    direct = sorted(map(str, run(made(spark, texts())).collect()))
    monkeypatch.setattr(dealing, "WIDE", 2)
    assert sorted(map(str, run(made(spark, texts())).collect())) == direct
