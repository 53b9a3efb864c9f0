"""Long texts take time in proportion to their length."""

import random
import time

from flowloom.llm import pii


def test_names_of_a_long_title_case_text():
    """A megabyte of capitalised words, each of them looked up among all words of the text."""
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(7)).title() for _ in range(130_000)]
    text = " ".join(w if i % 3 else w.lower() for i, w in enumerate(words))
    began = time.perf_counter()
    votes = [pii.name_votes(text, m.start(), m.end()) for m in pii.PERSON.finditer(text)]
    assert len(votes) > 10_000 and time.perf_counter() - began < 30
    low = f" {text} ".replace("\n", " ")
    for m, vote in list(zip(pii.PERSON.finditer(text), votes))[1:200]:
        assert (vote[3] == 0) == any(f" {w.lower()} " in low for w in m[0].split())
