"""License rules: written out, findable, and suppressed as a brute-force version does it."""

import random
import re

import pytest

from plumbline.llm import licenses


def brute(found):
    kept = []
    for d in sorted(found, key=lambda d: (-d[0], d[1] - d[2], d[1], d[3])):
        if not any(k[1] <= d[1] and d[2] <= k[2] for k in kept):
            kept.append(d)
    return kept


@pytest.mark.parametrize("seed", range(30))
def test_suppression_is_the_brute_force_one(seed):
    draw = random.Random(seed)
    found = []
    for _ in range(draw.randint(0, 120)):
        start = draw.randint(0, 60)
        found.append((draw.choice([40, 60, 60, 80]), start, start + draw.choice([1, 3, 3, 10, 40]), draw.choice("abc")))
    assert licenses.unsuppressed(found) == brute(found)


def test_suppression_in_texts_of_many_phrases():
    draw = random.Random(2)
    phrases = ["gnu general public license version 3 or later", "general public license", "cc by nc sa 4 0", "cc by", "apache license version 2 0", "all rights reserved", "mozilla public license", "zope public license 2 1", "x", "of"]
    for _ in range(60):
        text = " ".join(draw.choice(phrases) for _ in range(draw.randint(1, 30))).encode()
        every = [(p, m.start(), m.end(), label) for label, p, gate, pattern in licenses.rules() if gate in text for m in pattern.finditer(text)]
        assert licenses.detections(text) == brute(every)
        # The gate only saves time: without it, the same is found.
        ungated = [(p, m.start(), m.end(), label) for label, p, _, pattern in licenses.rules() for m in pattern.finditer(text)]
        assert sorted(ungated) == sorted(every)


def sample(pattern):
    """A text that a rule finds: options left out, first alternatives taken."""
    out = pattern
    while (shorter := re.sub(r"\(\?:[^()]*\)\?", "", out)) != out:
        out = shorter
    while (shorter := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", out)) != out:
        out = shorter
    out = re.sub(r"\[\^ \]\+", "e", out)
    out = re.sub(r"\.\{0,\d+\}", "", re.sub(r"\\w\*", "oo", out))
    out = re.sub(r"\[([^\]])[^\]]*\](?:\{(\d)\})?", lambda m: m[1] * int(m[2] or 1), out)
    return re.sub(r" +", " ", re.sub(r"\w\?|\?", "", out)).strip()


def test_every_rule_finds_its_text():
    listed = [line.split("; ", 3) for line in licenses.RULES.strip().splitlines()]
    assert len(listed) >= 200 and len({tuple(x) for x in listed}) == len(listed)
    missed = []
    for label, priority, gate, pattern in listed:
        text = sample(pattern)
        if gate not in text or not re.search(rf"(?<![^ ])(?:{pattern})(?![^ ])", text):
            missed.append((label, text))
        elif not any(d[3] == label or d[0] >= int(priority) for d in licenses.detections(text.encode())):
            missed.append((label, text))
    assert not missed
