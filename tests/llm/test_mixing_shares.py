"""Expected shares of the sample against their targets, with a hot source."""

import random
from collections import defaultdict

import pytest

from tapeloom.llm.mixing import AXES, DAMPING, SHARE, mixed


def wanted(own, power, budget):
    """Damped shares of the budget; what a value lacks is asked of the others alike."""
    raised, full = {v: n**power for v, n in own.items()}, set()
    while True:
        scale = (budget - sum(own[v] for v in full)) / sum(x for v, x in raised.items() if v not in full)
        over = {v for v in own if raised[v] * scale >= own[v]}
        if over <= full:
            return {v: own[v] if v in full else raised[v] * scale for v in own}
        full |= over


def test_sample_has_the_target_shares(spark, docs_of):
    rng = random.Random(5)
    rows = []
    for k in range(900):
        source = "hot" if k % 3 == 0 else f"s{rng.randrange(8)}"
        lang = rng.choices(["en", "de", "es"], [6, 2, 1])[0]
        text = " ".join(["word"] * rng.randint(20, 200)) + rng.choices(["", " licence", " | cell"], [8, 1, 1])[0]
        rows.append((k, text, lang, source))
    got = mixed(docs_of(rows)).collect()
    total = sum(r.tokens for r in got)
    assert sum(r.probability > 0.999 for r in got) > 40
    assert sum(r.probability * r.tokens for r in got) == pytest.approx(SHARE * total)
    for axis in AXES:
        own, drawn = defaultdict(int), defaultdict(float)
        for r in got:
            own[r[axis]] += r.tokens
            drawn[r[axis]] += r.probability * r.tokens
        for value, tokens in wanted(own, DAMPING[axis], SHARE * total).items():
            assert drawn[value] / total == pytest.approx(tokens / total, abs=2e-4)
