"""Entities as long as the operator claims are found whole."""

import random

from quireflow.llm import pii


def found(text):
    return set(pii.added_spans(text, pii.base_spans(text), pii.trained()))


def test_full_ipv6_whole():
    rng, whole = random.Random(3), 0
    texts = ["2a01:4f8:c2c:123f:64:5:6a0b:c1d2", *(":".join(f"{rng.randint(0, 65535):{rng.choice(['x', '04x'])}}" for _ in range(8)) for _ in range(400))]
    for k, body in enumerate(texts):
        head = ("ther ", "host ", "erin ionou ip ")[k % 3]
        hit = ("ip", len(head), len(head) + len(body)) in found(f"{head}{body} ining")
        assert hit or k
        whole += hit
    assert whole >= 0.99 * len(texts)


def test_numbers_of_prefix_00_whole():
    for body in ("00 33 1 23 45 67 89", "00 49 15 12 34 56 78 90", "0033 1 23 45 67 89", "00 7 495 123 45 67"):
        for head in ("call ", "ther "):
            assert ("phone", len(head), len(head) + len(body)) in found(f"{head}{body} ining"), body


def test_long_spelt_address_is_proposed_whole():
    text = ".".join("abcdefghijklmnop") + " (at) mail-1.dept-2 (dot) uni (dot) ac (dot) uk"
    (a, b), = pii.stretches(text)
    tokens, candidates = pii.segments(text, a, b)
    assert len(tokens) > pii.MAX_TOKENS and (len(tokens)) in [n for n, _ in candidates[0]]
    assert ("email", 0, len(text)) in found(text)
