"""Disguised addresses in texts that hold nothing else of the kind."""

import time

import pytest

from pagedelta.llm import pii


@pytest.mark.parametrize(
    "found",
    [
        "name@example(punkt)de", "name@example[punto]it", "name@example [point] com", "name@example .com", "name [  at ] example.com",
        "name [\nat ] example.com", "name\n@example.com", "a.b.c.d.e.f.g.h.i [at] example.com", "a-at-b (at) example.com", "x" * 80 + " [at] example.com",
    ],
)
def test_found_without_any_other_hint(found):
    for text in (f"write to: {found}, please", f"the polka dots; @ home: {found}, please"):
        assert [(k, text[a:b]) for k, a, b, _ in pii.find(text) if k == "email"] == [("email", found)]


@pytest.mark.parametrize(
    "text",
    [
        "at" + " " * 600_000 + "x", "a dot " * 90_000 + "at", "a.b" * 200_000 + " at x", "a-at-" * 200_000, "@a-at-" * 100_000, "a_at_" * 200_000, "a-at-b_at_c@d" * 50_000,
        "a-at-b-dot-" * 100_000, "x [at] b.c " * 50_000, "x at b.c " * 50_000, "a@" * 300_000, "a-dot-" * 200_000 + "@", "one " * 200_000, "plus " * 100_000, "a -at- b. " * 60_000,
    ],
    ids=lambda t: t[:14].replace(" ", "."),
)
def test_disguises_are_linear_in_the_text(text):
    began = time.process_time()
    pii.find(text)
    assert time.process_time() - began < 6


@pytest.mark.parametrize(
    "text, want",
    [
        ("write b  at at com dot  at", ["at at com dot  at"]),
        ("c a-at-b-at-c.org d", ["a-at-b-at-c.org"]),
        ("call + ſix one two three four five six seven eight nine", ["+ ſix one two three four five six seven eight nine"]),
        ("x_at_y_at_z dot com", ["x_at_y_at_z dot com"]),
    ],
)
def test_signs_beside_each_other(text, want):
    assert [text[a:b] for _, a, b, _ in pii.find(text)] == want
