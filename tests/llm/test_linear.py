"""Broken and wide pages take time in proportion to their size."""

import re
import resource
import time

import numpy as np
import pytest

from corpusloom.llm import html_wrapper, language_id


def slow(html):
    """What the one pass stands for, by patterns that look ahead again and again."""
    return re.sub(r"(?is)<(script|style|nav|footer)\b.*?</\1>|<[^>]*>|&#?\w+;", " ", html)


def test_bare_text_equals_the_patterns():
    g = np.random.default_rng(0)
    parts = ["<nav>", "</nav>", "<NAV class='a>b'>", "<script>", "</script>", "<p>", "</p>", "<", ">", "text", " a ", "&amp;", "&#12;", "& b", "<navel>", "</style>", "<style x>", "<footer>", "</Footer>", "\n", "<!-- x -->"]
    tidy = lambda s: " ".join(s.split())
    for _ in range(3000):
        page = "".join(g.choice(parts, int(g.integers(1, 14)))) + ">"
        assert tidy(language_id.bare(page)) == tidy(slow(page)), page


@pytest.mark.parametrize("page", ["<nav>" * 800_000, "<nav" * 1_000_000, "<" * 4_000_000, "<script>a" * 400_000, "&" * 4_000_000, "<nav>x</nav><style>" * 200_000, "<p>" * 1_300_000])
def test_four_megabytes_of_broken_markup(page):
    start = time.perf_counter()
    language_id.bare(page)
    assert time.perf_counter() - start < 5


def glossary(n, extra=""):
    return "<html><body><nav><a>Home</a></nav><article><h1>T</h1><dl>" + "".join(f"<dt>term {i}</dt><dd>what {i} means{extra}</dd>" for i in range(n)) + "</dl></article><footer>end</footer></body></html>"


def test_wide_pages_are_matched_in_time():
    """A megabyte of terms against another: seconds, not hours, and little memory."""
    page, reference = html_wrapper.parse(glossary(22_000)), html_wrapper.plain(html_wrapper.fold(html_wrapper.parse(glossary(20_000, " here"))))
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.perf_counter()
    html_wrapper.align(reference, page)
    assert time.perf_counter() - start < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert html_wrapper.extract(page, None).count("\n") == 44_000


def test_wide_siblings_are_paired_in_order():
    """Beyond the tables the pairs still have one kind, do not cross, and are all where both pages are alike."""
    small = glossary(30)
    t = html_wrapper.fold(html_wrapper.parse(small))
    assert html_wrapper.match(html_wrapper.plain(t), t, {}, [0]) == html_wrapper.match(html_wrapper.plain(t), t, {})
    g = np.random.default_rng(1)
    for _ in range(300):
        xs, ys = ([(k, []) for k in g.choice(list("abc"), int(g.integers(0, 12)))] for _ in range(2))
        pairs = html_wrapper._in_order(xs, ys)[::-1]
        assert all(xs[i][0] == ys[j][0] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
