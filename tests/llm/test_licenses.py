import time

import pytest

from relispan.llm import licenses


@pytest.mark.parametrize(
    "text, want",
    [
        ("mozila public license mozilla public license", ["mpl:0:3:1", "mpl:3:6:0"]),
        ("mozilla public license mozila public license", ["mpl:0:3:0", "mpl:3:6:1"]),
        ("mozila publik license mozila public license mozilla public license mozilla public licence", ["mpl:0:3:2", "mpl:3:6:1", "mpl:6:9:0", "mpl:9:12:1"]),
        ("ünï mozila public license ünï mozilla public license", ["mpl:1:4:1", "mpl:5:8:0"]),
    ],
)
def test_notices_before_a_cleaner_one(text, want):
    found = licenses.Scanner().scan(text.encode())[2]
    assert sorted(f"{x}:{a}:{b}:{e}" for a, b, x, e, _ in found if x == "mpl") == sorted(want)


def test_a_long_text_of_many_notices():
    """50,000 notices in 1 MB take seconds: windows are short, and no place is counted from the start of the text."""
    text = "all rights reserved " * 25_000 + "all rigths reserved mozila public license " * 12_500
    began = time.time()
    n, base, more = licenses.Scanner().scan(text.encode())
    assert time.time() - began < 60
    assert n == 25_000 * 3 + 12_500 * 6 and base == [(3 * i, "reserved") for i in range(25_000)]
    spans = sorted((a, b, x) for a, b, x, _, _ in more)
    assert [s for s in spans if s[2] == "mpl"] == [(75_000 + 6 * i + 3, 75_000 + 6 * i + 6, "mpl") for i in range(12_500)]
    assert [s for s in spans if s[2] == "reserved"][:25_000] == [(3 * i, 3 * i + 3, "reserved") for i in range(25_000)]
