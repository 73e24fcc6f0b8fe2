"""Tag-path selection decides, and pages take time in proportion to their length."""

import time

import numpy as np
import pytest

from marquee.llm import html_paths

PROSE = ["One long sentence, with words in it, and then some more of them. " * n for n in (3, 5, 4, 6)]
MENU = "<ul>" + "<li>Home</li><li>News</li><li>About us</li><li>Contact</li><li>Shop</li>" + "</ul>"
PAGES = [f"<html><body><h1>Title</h1>{MENU}{''.join(f'<p>{x}</p>' for x in PROSE)}<div>Buy now</div>{MENU}</body></html>" for _ in range(2)]


def test_scores_decide_on_pages_without_an_article(monkeypatch):
    usual = html_paths.main_text(PAGES[0])
    assert "Contact" not in usual and all(x.strip() in usual for x in PROSE)
    scores = html_paths.path_scores

    def constant(blocks, width=1.0):
        fused, smooth, least = scores(blocks, width)
        return np.ones_like(fused), np.ones_like(smooth), 0.5

    monkeypatch.setattr(html_paths, "path_scores", constant)
    assert html_paths.main_text(PAGES[0]) != usual
    rng = np.random.default_rng(1)
    monkeypatch.setattr(html_paths, "path_scores", lambda blocks, width=1.0: (rng.random(len(blocks)), rng.random(len(blocks)), 0.5))
    assert html_paths.main_text(PAGES[0]) != usual


@pytest.mark.parametrize("page", ["<a " * 20_000, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<div>x" * 20_000, '<a b="' * 20_000 + ">", "<a x='\">t" * 20_000, "<" * 60_000, "<!x" * 20_000, "<p>" + "<b>" * 20_000 + "<div>x" * 5_000, "<p>a<b>" * 20_000 + "</p>" * 20_000])
def test_odd_pages_take_linear_time(page):
    began = time.perf_counter()
    html_paths.main_text(page)
    assert time.perf_counter() - began < 8


def test_odd_markup():
    text = html_paths.main_text
    assert text("<article><p title='a > b'>One, two.</p><p>x < y & z</p></article>") == "One, two.\nx < y & z"
    assert text('<article><p title="never closed>One</p><p>Two, three.</p></article>').endswith("Two, three.")
    assert text("<article><p>a<!-- <p>no</p> -->b</p></article>") == "ab"
    assert text("<article><p>kept, here.</p><script>if (a < b) { '</p>' }</script><p>Also kept.</p></article>") == "kept, here.\nAlso kept."


def test_extract_on_odd_tables(spark):
    rows = [(1, "u", None, 7), (2, None, "", 7), (None, "u", "<p>A, b.</p>", 7), (4, "u", "plain, text. " * 20_000, 7), (4, "u", "<p>A, b.</p>", 7)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = html_paths.extract(d).collect()
    assert len(got) == 5 and {(r.page_id, r.text) for r in got if r.n_chars < 20} == {(1, ""), (2, ""), (None, "A, b."), (4, "A, b.")}
    assert all(r.n_chars == len(r.text) for r in got) and html_paths.extract(d.limit(0)).count() == 0
