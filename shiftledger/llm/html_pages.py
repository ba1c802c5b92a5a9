"""Labelled pages for the block model: layouts in common use, put together at random from a seed.

The text of a block says nothing about its label beyond its form; what is content follows from the layout. A page is
the pair (html, texts of its content blocks).
"""

from __future__ import annotations

import random
from functools import cache

from shiftledger.llm import html_crf

SYLLABLES = "ta ren mo li sa ver no du ki pal or en the il ran qu es".split()
WRAPPERS = ["<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", '<div class="content">{}</div>',
            '<div id="main-content"><article class="post">{}</article></div>', '<section class="entry">{}</section>',
            '<div role="main">{}</div>', '<article class="article-body">{}</article>']
LINKS = ["<nav>{}</nav>", '<div class="menu">{}</div>', '<div id="navbar">{}</div>', '<ul class="breadcrumbs">{}</ul>', '<div role="navigation">{}</div>']
HEADERS = ["<header>{}</header>", '<div class="header">{}</div>', '<div role="banner">{}</div>', '<div id="masthead">{}</div>']
FOOTERS = ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="colophon">{}</div>', '<div role="contentinfo">{}</div>']
SIDES = ["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="related">{}</div>', '<section class="recommended">{}</section>',
         '<aside class="sidebar">{}</aside>', '<div class="widget">{}</div>']
NOTICES = ['<div class="cookie-notice">{}</div>', '<div id="consent">{}</div>', '<section role="alert">{}</section>', '<div class="newsletter">{}</div>',
           '<div class="notice">{}</div>', '<div class="modal popup">{}</div>']
ADVERTS = ['<div class="ad">{}</div>', '<aside class="advert">{}</aside>', '<div id="promo">{}</div>', '<div class="sponsored">{}</div>',
           '<div class="ads banner-ad">{}</div>', '<section class="advertisement">{}</section>']
COMMENTS = ['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<div id="disqus">{}</div>', '<section class="responses comment-list">{}</section>']
COMMENT = ['<div class="comment">{}</div>', '<article class="comment">{}</article>', "<li>{}</li>", "<p>{}</p>", '<div class="reply"><p>{}</p></div>']
FORMS = ["<form>{}</form>", '<form class="search">{}</form>', '<form id="login">{}</form>', '<div class="contact"><form>{}</form></div>']
SHARES = ['<div class="share">{}</div>', '<ul class="social">{}</ul>']


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.content: list[str] = []

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 3)))

    def phrase(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def sentences(self, n: int = 6) -> str:
        return " ".join(self.phrase(3, 18).capitalize() + self.r.choice(".....!?") for _ in range(self.r.randint(1, n)))

    def any_text(self) -> str:
        return self.r.choice([self.phrase(1, 6), self.sentences(1), self.sentences(4), self.phrase(4, 30)])

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.phrase(1, 3)}</a>' for _ in range(self.r.randint(2, 6))]
        return self.r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", "".join(f"<li>{x}</li>" for x in items), "<p>" + " ".join(items) + "</p>"])

    def keep(self, text: str, shape: str) -> str:
        self.content.append(text)
        return shape.format(text)

    def body(self) -> str:
        r, out = self.r, []
        if r.random() < 0.8:
            out.append(self.keep(r.choice([self.phrase(2, 12), self.sentences(1)]), r.choice(["<h1>{}</h1>", "<h1>{}", "<header><h1>{}</h1></header>", "<h2>{}</h2>"])))
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.6:
                text = r.choice([self.sentences(6), self.sentences(10), self.sentences(1), self.phrase(1, 8), self.phrase(20, 60)])
                out.append(self.keep(text, r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p><b>{}</b></p>", "<div>{}</div>", "<p><span>{}</span></p>"])))
            elif kind < 0.75:
                out.append("<ul>" + "".join(self.keep(self.any_text(), "<li>{}</li>") for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.85:
                out.append(self.keep(self.phrase(1, 8), r.choice(["<h2>{}</h2>", "<h3>{}</h3>", "<b>{}</b>"])))
            elif kind < 0.92:
                out.append(self.keep(self.sentences(3), r.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<blockquote><p>{}</p></blockquote>"])))
            else:
                out.append("<table><tr>" + "".join(self.keep(self.phrase(1, 4), "<td>{}</td>") for _ in range(r.randint(2, 4))) + "</tr></table>")
            if r.random() < 0.25:
                out.append(r.choice([self.advert, self.side, self.form, self.share, self.menu, self.notice])())
        return "".join(out)

    def _in(self, shapes: list[str], inner: str) -> str:
        return self.r.choice(shapes).format(inner)

    def paragraph(self) -> str:
        return self.r.choice(["<p>{}</p>", "{}", "<div>{}</div>", "<h3>{}</h3>"]).format(self.any_text())

    def menu(self) -> str:
        return self._in(LINKS, self.links())

    def header(self) -> str:
        return self._in(HEADERS, self.r.choice(["", self.paragraph(), "<h1>" + self.phrase(1, 4) + "</h1>"]) + self.r.choice(["", self.menu()]) + self.paragraph())

    def footer(self) -> str:
        return self._in(FOOTERS, self.r.choice(["&copy; ", "", "© "]) + self.any_text() + self.r.choice(["", self.links(), self.paragraph()]))

    def side(self) -> str:
        return self._in(SIDES, self.paragraph() + self.r.choice([self.links(), self.paragraph(), ""]))

    def notice(self) -> str:
        return self._in(NOTICES, self.paragraph())

    def advert(self) -> str:
        return self._in(ADVERTS, self.r.choice([self.any_text(), self.paragraph()]))

    def form(self) -> str:
        return self._in(FORMS, f"<label>{self.phrase(1, 3)}</label><input><p>{self.any_text()}</p><button>Go</button>")

    def share(self) -> str:
        return self._in(SHARES, self.links())

    def comments(self) -> str:
        return self._in(COMMENTS, self.r.choice(["", "<h2>" + self.phrase(1, 3) + "</h2>"]) + "".join(
            self.r.choice(COMMENT).format(self.any_text()) for _ in range(self.r.randint(1, 5))))

    def page(self) -> str:
        r = self.r
        some = lambda odds, *parts: "".join(r.choice(parts)() for _ in range(2) if r.random() < odds)
        article = self.body()
        if r.random() < 0.2:
            article += self.comments()
        return ("<!DOCTYPE html><html><head><title>" + self.phrase(2, 6) + "</title><style>p{margin:0}</style></head><body>"
                + some(0.6, self.header, self.menu) + some(0.4, self.notice, self.advert, self.form, self.side) + r.choice(WRAPPERS).format(article)
                + some(0.4, self.side, self.advert, self.share, self.form, self.notice) + some(0.4, self.comments, self.side)
                + some(0.6, self.footer) + "</body></html>")


def labelled(n: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    out = []
    for k in range(n):
        writer = _Writer(seed * 1_000_003 + k)
        out.append((writer.page(), writer.content))
    return out


def examples(n: int, seed: int = 0) -> list[tuple[list[html_crf.Block], list[int]]]:
    """Blocks and labels; content texts are matched in order, as equal texts may stand elsewhere."""
    out = []
    for page, content in labelled(n, seed):
        blocks, labels, left = html_crf.blocks(page), [], list(content)
        for b in blocks:
            labels.append(int(bool(left) and b.text == left[0].strip()))
            if labels[-1]:
                left.pop(0)
        if not left:
            out.append((blocks, labels))
    return out


@cache
def default_model(pages: int = 300) -> html_crf.Model:
    return html_crf.train(examples(pages))
