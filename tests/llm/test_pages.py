"""Main text of labelled pages: what a reader would call the article, by words, over layouts and languages."""

import random

import pytest

from pitloom.llm import html

TOLD = "It is the part of the text in which the authors tell what they have found and how it was done by them, and what was there before them."


@pytest.mark.parametrize(
    "page",
    [
        f'<section id="related-work"><p>{TOLD}</p></section>',
        f'<p class="discussion">{TOLD}</p>',
        f'<div class="share-price">{TOLD}</div>',
        f'<main><section id="login-flow"><p>{TOLD}</p></section></main>',
        f'<article><section class="search-engines"><p>{TOLD}</p></section></article>',
        f'<article><p class="side">{TOLD}</p></article>',
    ],
)
def test_names_do_not_drop_prose(page):
    assert html.main_text(page) == TOLD


@pytest.mark.parametrize("name", ["ad", "ad-slot", "google-ad", "ad_unit_2", "cookie-notice", "comments-wrapper", "newsletter-box", "sponsored"])
@pytest.mark.parametrize("around", ["<article><p>{0}</p>{1}</article>", "<div><p>{0}</p>{1}</div>"])
def test_names_that_say_what_a_block_is(name, around):
    assert html.main_text(around.format(TOLD, f'<div class="{name}"><p>{TOLD}</p></div>')) == TOLD


def test_what_is_doubtful_must_be_good_by_itself():
    for inside in ('<div class="share-links">Share this</div>', f'<div class="related"><p>{TOLD[:90]}</p></div>', f'<div class="related"><a href="/a">{TOLD * 3}</a></div>', '<div class="search-history">Back to it</div>'):
        assert html.main_text(f"<article><p>{TOLD}</p>{inside}</article>") == TOLD
    assert html.main_text(f'<article><p>{TOLD}</p><div class="discussion"><p>{TOLD} {TOLD}</p></div></article>') == f"{TOLD} {TOLD} {TOLD}"


def test_short_pages_and_formulas():
    assert html.main_text("<body><p>It was the end of the day.</p></body>") == "It was the end of the day."
    assert html.main_text('<nav><a href="/">Home</a></nav><p>It was the end of the day.</p><footer>All of it is ours.</footer>') == "It was the end of the day."
    assert html.main_text("<body><p>Log in</p><p><a href='/'>It was the end.</a></p></body>") == ""
    assert html.main_text(f"<p>{TOLD}</p><p>Let <math><mi>x</mi></math> be it.</p>") == f"{TOLD} Let x be it."


def _pages():
    """(html, words of the article): seven layouts in five languages."""
    rng = random.Random(17)
    for language in (*html.STOP_WORDS, "other"):
        common = html.STOP_WORDS.get(language, "ola uki beno tari mele sovu").split()

        def sentence(n, mark="c", common=common):
            return " ".join([*(rng.choice(common) if rng.random() < 0.4 else f"{mark}{rng.randrange(10**6)}" for _ in range(n - 1)), f"{mark}{rng.randrange(10**6)}."])

        def prose(n):
            return [" ".join(sentence(rng.randint(8, 20)) for _ in range(rng.randint(2, 5))) for _ in range(n)]

        links = "<ul>" + "".join(f'<li><a href="/{k}">b{k} section</a></li>' for k in range(8)) + "</ul>"
        notes = [f'<div class="cookie-banner">{sentence(25, "b")}</div>', f'<div class="ad">{sentence(20, "b")}</div>', f"<form><label>b1</label><p>{sentence(20, 'b')}</p></form>", f"<aside>{sentence(30, 'b')}</aside>", "<script>var b = '</p>';</script>"]
        comments = f'<section class="comments"><p>{sentence(40, "b")}</p><p>{sentence(30, "b")}</p></section>'
        for layout in range(7):
            texts = prose(rng.randint(3, 6))
            title, short = f"c{rng.randrange(10**6)} c{rng.randrange(10**6)}", sentence(5)
            body = [f"<h1>{title}</h1>", f"<p>{texts[0]}</p>", f"<p>{short}</p>", *(f"<p>{t}</p>" for t in texts[1:])]
            want = [title, texts[0], short, *texts[1:]]
            note = rng.sample(notes, 3)
            if layout == 0:
                page = f"<header><nav>{links}</nav></header><article>{''.join(body)}</article>{''.join(note)}<footer>{links}</footer>"
            elif layout == 1:
                page = f"<div id='nav'>{links}</div><div id='content'>{''.join(body)}</div>{''.join(note)}{comments}"
            elif layout == 2:
                page = f"<main>{''.join(body[:3])}{note[0]}{''.join(body[3:])}{note[1]}</main>{comments}<div class='site-footer'>{links}</div>"
            elif layout == 3:
                page = f"<table><tr><td>{links}</td><td>{''.join(body)}</td></tr></table>{''.join(note)}"
            elif layout == 4:
                page = f"<article><div class='share-bar'>b share</div>{''.join(body)}<div class='related'>{links}</div>{comments}</article>"
            elif layout == 5:
                page = f"<article>{body[0]}<section id='related-work'>{''.join(body[1:])}</section>{note[0]}</article><footer>© {sentence(9, 'b')}</footer>"
            else:
                page = f"{''.join(note)}<article>{''.join(body[:2])}<blockquote>{texts[1]}</blockquote>{''.join(body[2:])}</article>{links}"
                want.insert(2, texts[1])
            yield f"<!DOCTYPE html><html><head><title>b</title></head><body>{page}</body></html>", " ".join(want).split()


def test_precision_and_recall_by_words():
    pages = list(_pages())
    both = found = wanted = 0
    for page, want in pages:
        got = html.main_text(page).split()
        wanted, found = wanted + len(want), found + len(got)
        left = {}
        for w in want:
            left[w] = left.get(w, 0) + 1
        for w in got:
            if left.get(w, 0):
                left[w] -= 1
                both += 1
    assert len(pages) == 35 and both / found >= 0.98 and both / wanted >= 0.98
