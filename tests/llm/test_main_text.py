"""Main text: names that only look like those of menus, pages of several articles, shapes of any size and order."""

import random

import pytest

from pagedelta.llm import wrapper

PAGES = "page_id long, url string, html string"
TEXT = "<h1>Head</h1><p>One two three."


def text(page):
    return "\n".join(wrapper.chosen(wrapper.blocks(page)))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content no-sidebar"><article>{TEXT}</article></div>', "Head\nOne two three."),
        (f'<article class="post has-comments">{TEXT}</article>', "Head\nOne two three."),
        (f'<article>{TEXT}<div class="social-history"><p>Of the town</div></article>', "Head\nOne two three.\nOf the town"),
        (f'<article><header class="entry">{TEXT}</header><p>More</article>', "Head\nOne two three.\nMore"),
        (f"<article>{TEXT}</article><article><p>Second one</article>", "Head\nOne two three.\nSecond one"),
        (f'<div>{TEXT}<p><a href="/x">All of it a link</a></div>', "Head\nOne two three.\nAll of it a link"),
        (f'<article>{TEXT}<p class="byline">By me<div class="disclaimer">No warranty</div></article>', "Head\nOne two three.\nBy me\nNo warranty"),
        (f'<article>{TEXT}<div class="post-comments"><p>Nice</div><div id="cookieNotice">We</div><div class="ad-slot">Buy</div></article>', "Head\nOne two three."),
        (f'<div class="site-header">Top</div><ul><li><a href="/">Home</a></ul><div>{TEXT}</div>', "Head\nOne two three."),
    ],
)
def test_names(page, want):
    assert text(f"<html><body>{page}</body></html>") == want


def test_groups_of_any_length_repeat():
    for size in (1, 2, 4, 7):
        group = "".join(f"<div class=c{'x' * k}>t{k}</div>" for k in range(size))
        assert len(wrapper.wrap(wrapper.blocks(group * 5))["nodes"]) == size


def test_alignment_of_long_pages():
    rng = random.Random(4)
    pool = [f"/body/{'a' * k}" for k in range(1, 60)]
    x = [rng.choice(pool) for _ in range(6000)] + ["/once"] + [rng.choice(pool) for _ in range(6000)]
    y = [p for p in x if rng.random() < 0.9 or p == "/once"]
    got = wrapper.matched(x, y)
    assert got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert all(x[i] == y[j] for i, j in got) and (x.index("/once"), y.index("/once")) in got


def test_order_of_pages_does_not_change_wrappers(spark):
    parts = ["<h2>S {0}</h2>", "<p>P {0}</p>", "<ul><li>L {0}</ul>", "<blockquote>Q {0}</blockquote>", "<p>We thank our readers</p>"]
    rng = random.Random(1)
    rows = [(i, "https://a.org/x", "<div class=page>" + "".join(rng.choice(parts).format(f"{i} {k}") for k in range(rng.randrange(1, 9))) + "</div>") for i in range(40)]
    rows += [rows[3], (90, "https://a.org/x", None), (91, None, "<p>x"), (92, "https://b.org", "<p>" + "word " * 50_000)]
    seen = set()
    for k in (1, 4):
        rng.shuffle(rows)
        pages = spark.createDataFrame(rows, PAGES).repartition(k)
        found = wrapper.wrappers(pages).collect()
        texts = wrapper.main_text(pages).collect()
        assert len(texts) == len(rows) and {len(r.text) for r in texts if r.page_id == 92} == {249_999}
        seen.add((str(sorted((r.host, r.layout, r.wrapper, sorted(r.marks)) for r in found)), str(sorted((r.page_id, r.text) for r in texts))))
    assert len(seen) == 1


def test_clashing_columns(spark):
    rows = [(i, f"https://a.org/{i}", f"<article><p>One {i}</article>", "h", 3, "k") for i in range(3)]
    pages = spark.createDataFrame(rows, PAGES + ", host string, layout long, key string")
    assert {r.page_id: r.text for r in wrapper.main_text(pages).collect()} == {i: f"One {i}" for i in range(3)}
