"""Main text of pages that name, repeat or lay out their noise in odd ways; the style tree by brute force."""

import math
import random
from collections import Counter, defaultdict

import pytest

from equipoise.llm import site_style

SCHEMA = "page_id bigint, url string, html string, host string, removed string"


def words(n, kind="w"):
    return " ".join(f"{kind}{i}" for i in range(n))


def text_of(page):
    return site_style.main_text(page, frozenset())


def test_apostrophes_in_unquoted_values():
    page = "<p>First <a href=x title=it's>link</a> second part</p><p>Third isn't lost</p>"
    assert text_of(page) == "First link second part\nThird isn't lost"
    assert text_of("<p title = 'a > b' data-x=\"c > d\">one</p><p class=x'y>two</p>") == "one\ntwo"
    assert text_of("<p>one</p><p title='open>two</p>") .startswith("one")


@pytest.mark.parametrize("size", [10, 39, 40, 45, 150])
def test_noise_within_an_article_goes_at_any_length(size):
    noise = f"<div class=advert><p>{words(size, 'ad')}</p></div><div class='newsletter'>{words(size, 'nl')}</div><div id=cookie-notice>{words(size, 'ck')}</div>"
    text = text_of(f"<article><h1>T</h1><p>{words(400)}</p>{noise}<p>end</p></article>")
    assert text == f"T\n{words(400)}\nend"


@pytest.mark.parametrize("size", [30, 60, 150])
def test_noise_beside_plain_parts_goes(size):
    noise = f"<div class=sidebar><p>{words(size, 'sb')}</p></div><div class=cookie-consent>{words(size, 'ck')}</div>"
    assert text_of(f"<body><div><p>{words(400)}</p></div>{noise}</body>") == words(400)


def test_a_story_is_kept_whatever_its_wrapper_is_called():
    page = f"<body><div class='content-with-sidebar'><p>{words(200)}</p><p>more</p></div><div class=sidebar><p>{words(60, 'sb')}</p></div></body>"
    assert text_of(page) == words(200) + "\nmore"
    assert text_of(f"<article><p>{words(200)}</p><section id=discussion><p>{words(90, 'd')}</p></section></article>") == words(200) + "\n" + words(90, "d")
    # An advert does not become the story because the article is short.
    assert text_of("<div class=ad>buy this thing now and here</div><article><h1>Short</h1></article>") == "Short"


def layout_pages(layouts, n=60):
    rows = []
    for i in range(n):
        at, rng = "abcd"[i % layouts], random.Random(i)
        story = " ".join(rng.choice("abcdefg") * rng.randint(2, 6) for _ in range(80))
        page = f"<html><body><div class='lay{at}x'><div class='mm{at}y'><a href=/>Home {at}</a> <a href=/a>About menu words</a></div><div class='bb'><p>{story}</p></div></div></body></html>"
        rows.append((i, f"http://h.example/{i}", page, "x", "y"))
    return rows


@pytest.mark.parametrize("layouts", [1, 2, 3, 4])
def test_each_layout_has_its_template(spark, layouts):
    rows = layout_pages(layouts)
    found = site_style.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(found) == len(rows)
    assert all("menu" not in r.text and len(r.text.split()) == 80 and r.n_chars == len(r.text) for r in found)


def test_style_tree_against_brute_force(spark):
    rows = layout_pages(2, 12) + [(99, None, None, "x", "y"), (3, "http://h.example/3", layout_pages(2)[3][2], "x", "y")]
    shown = defaultdict(Counter)
    for _, url, page, *_ in rows:
        blocks, elements = site_style.parse(page or "")
        seen = defaultdict(list)
        for path, children in elements:
            seen[0, ">".join(path)].append(children)
        for block in blocks:
            seen[1, ">".join(block.path)].append(block.text)
        for (kind, path), parts in seen.items():
            shown["h.example" if url else "", path, kind]["\n".join(parts)] += 1
    want = {}
    for key, kinds in shown.items():
        m = sum(kinds.values())
        entropy = -sum(n / m * math.log(n / m) for n in kinds.values())
        want[key] = (m, entropy / math.log(m) if m > 1 else 1.0)
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {(r.host, r.path, r.kind): (r.m, r.importance) for r in site_style.style_trees(pages).collect()}
    assert set(got) == set(want)
    for key, (m, importance) in want.items():
        assert got[key][0] == m and got[key][1] == pytest.approx(importance, abs=1e-9)
    # Removed: shown on enough pages, of low importance, and no branch of a removed one.
    low = set()
    for (host, path, kind), (m, style) in want.items():
        if kind == 0 and m >= site_style.LEAST_PAGES:
            below = [v for (h, p, k), (_, v) in want.items() if h == host and k == 1 and (p == path or p.startswith(path + ">"))]
            if below and site_style.PRESENTATION_WEIGHT * style + (1 - site_style.PRESENTATION_WEIGHT) * max(below) < site_style.LEAST_IMPORTANCE:
                low.add((host, path))
    top = {(h, p) for h, p in low if not any((h, ">".join(p.split(">")[:i])) in low for i in range(1, p.count(">") + 1))}
    found = {(r.host, p) for r in site_style.removed_paths(pages).collect() for p in r.removed}
    assert found == top and top
