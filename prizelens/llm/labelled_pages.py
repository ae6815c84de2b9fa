"""Labelled pages for the extraction model: invented pages whose blocks say what they are.

Every block element carries ``data-label`` (1: part of the article). The layouts vary how
sites name and nest the same things, so that the model learns from tags, names, links and
lengths rather than from one template. The number of pages is the documented bound.
"""

from __future__ import annotations

import random

N_PAGES = 400
SEED = 7
# How sites name the parts of a page, as tag and class or id.
ARTICLE = [
    ("article", ""), ("main", ""), ("div", "content"), ("div", "post-body"), ("section", "entry-content"),
    ("div", "main"), ("div", ""), ("td", ""), ("div", "story"), ("article", "post"), ("div", "article-text"),
]
MENU = [("nav", ""), ("div", "menu"), ("ul", "nav"), ("div", "navbar"), ("nav", "breadcrumbs"), ("div", "toc-links")]
HEADER = [("header", ""), ("div", "header"), ("div", "masthead"), ("header", "site-header"), ("div", "topbar")]
FOOTER = [("footer", ""), ("div", "footer"), ("div", "copyright"), ("footer", "site-footer"), ("div", "legal")]
SIDE = [("aside", ""), ("div", "sidebar"), ("div", "widget"), ("aside", "related"), ("div", "recommended"), ("section", "popular")]
NOTICE = [("div", "cookie-notice"), ("div", "banner"), ("div", "notice"), ("section", "alert"), ("div", "gdpr-consent"), ("div", "popup"), ("div", "newsletter-signup"), ("aside", "subscribe")]
ADVERT = [("div", "ad"), ("div", "ads"), ("div", "advert"), ("aside", "sponsored"), ("div", "promo"), ("ins", "adsbygoogle"), ("section", "advertisement"), ("p", "ad")]
COMMENTS = [("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("section", "reader-comments"), ("div", "discussion"), ("div", "replies")]
SHARE = [("div", "share"), ("ul", "social"), ("div", "tags"), ("div", "author-box"), ("div", "pagination")]


class Page:
    def __init__(self, rng: random.Random):
        self.rng = rng
        self.low, self.high = rng.choice([(1, 3), (1, 8), (1, 25), (1, 90), (1, 90), (5, 90), (40, 400)])
        self.stops = rng.choice([0.1, 0.9, 0.9, 1])
        self.most = rng.choice([3, 14, 14, 40])

    def words(self, low: int, high: int) -> str:
        r = self.rng
        n = r.randint(low, high)
        out = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9))) for _ in range(n)]
        text = " ".join(out).capitalize()
        return text + (r.choice(".!?") if r.random() < self.stops else "")

    def element(self, kind: tuple[str, str], label: int, inside: str) -> str:
        tag, name = kind
        attr = "id" if self.rng.random() < 0.3 else "class"
        named = f' {attr}="{name}"' if name else ""
        return f'<{tag}{named} data-label="{label}">{inside}</{tag}>'

    def links(self, label: int = 0) -> str:
        r = self.rng
        items = [f'<a href="#">{self.words(1, 4)}</a>' for _ in range(r.randint(2, 8))]
        if r.random() < 0.7:
            return f'<ul data-label="{label}">' + "".join(f'<li data-label="{label}">{x}</li>' for x in items) + "</ul>"
        return " | ".join(items)

    def prose(self, label: int, low: int = 0, high: int = 0) -> str:
        if not high:
            low, high = self.low, self.high
        return f'<p data-label="{label}">{self.inline(low, high)}</p>'

    def inline(self, low: int, high: int) -> str:
        text, r = self.words(low, high), self.rng
        if r.random() < 0.25:
            text += f' <a href="#">{self.words(1, 5)}</a> {self.words(1, 12)}'
        if r.random() < 0.2:
            text = f"<b>{text}</b>"
        if r.random() < 0.1:
            text += "<br>" + self.words(2, 10)
        return text

    def boiler(self, kinds: list) -> str:
        r, kind = self.rng, self.rng.choice(kinds)
        if kinds is MENU:
            inside = self.links()
        elif kinds is COMMENTS:
            inside = f'<h3 data-label="0">{self.words(1, 3)}</h3>' + "".join(
                self.element(r.choice([("div", "comment"), ("li", ""), ("article", "comment"), ("div", "reply")]), 0,
                             self.prose(0, 2, 60)) for _ in range(r.randint(1, 5)))
        elif r.random() < 0.4:
            inside = self.words(2, 25)
        elif r.random() < 0.5:
            inside = self.prose(0, 2, 40)
        else:
            inside = f'<h4 data-label="0">{self.words(1, 4)}</h4>' + self.links()
        if kinds in (FOOTER,) and r.random() < 0.5:
            inside = "&copy; 2024 " + inside
        return self.element(kind, 0, inside)

    def form(self) -> str:
        return (f'<form data-label="0"><label>{self.words(1, 3)}</label><input>'
                f'<p data-label="0">{self.words(2, 12)}</p><button>{self.words(1, 2)}</button></form>')

    def article(self) -> str:
        r = self.rng
        parts = [f'<h1 data-label="1">{self.words(2, 12)}</h1>'] if r.random() < 0.85 else []
        if r.random() < 0.2:
            parts[:] = [f'<header data-label="1">{"".join(parts)}{self.prose(1, 4, 20)}</header>']
        for _ in range(r.randint(1, self.most)):
            x = r.random()
            if x < 0.68:
                parts.append(self.prose(1))
            elif x < 0.74:
                parts.append(f'<h2 data-label="1">{self.words(1, 8)}</h2>')
            elif x < 0.79:
                tag = r.choice(["ul", "ol"])
                parts.append(f'<{tag} data-label="1">' + "".join(
                    f'<li data-label="1">{self.inline(1, 20)}</li>' for _ in range(r.randint(2, 6))) + f"</{tag}>")
            elif x < 0.83:
                parts.append(f'<blockquote data-label="1">{self.prose(1, 5, 40)}</blockquote>')
            elif x < 0.86:
                parts.append('<table data-label="1">' + "".join(
                    f'<tr data-label="1"><td data-label="1">{self.words(1, 5)}</td><td data-label="1">{self.words(1, 5)}</td></tr>'
                    for _ in range(r.randint(1, 4))) + "</table>")
            elif x < 0.89:
                parts.append(f'<figure data-label="1"><img><figcaption data-label="1">{self.words(2, 15)}</figcaption></figure>')
            elif x < 0.92:
                parts.append(f'<div data-label="1">{r.choice([self.prose(1), self.inline(3, 60)])}</div>')
            elif x < 0.97:
                parts.append(self.boiler(r.choice([ADVERT, ADVERT, SHARE, NOTICE, SIDE])))
            else:
                parts.append(self.form())
        if r.random() < 0.25:
            parts.append(self.boiler(COMMENTS))
        inside = "".join(parts)
        kind = r.choice(ARTICLE)
        if kind[0] == "td":
            return f'<table data-label="1"><tr data-label="1">{self.element(kind, 1, inside)}</tr></table>'
        return self.element(kind, 1, inside)

    def html(self) -> str:
        r = self.rng
        top = [self.boiler(k) for k in (HEADER, MENU, NOTICE, ADVERT) if r.random() < 0.55]
        rest = [self.boiler(k) for k in (SIDE, COMMENTS, SHARE, NOTICE, ADVERT) if r.random() < 0.4]
        if r.random() < 0.35:
            rest.append(self.form())
        r.shuffle(rest)
        if r.random() < 0.8:
            rest.append(self.boiler(FOOTER))
        middle = self.article()
        if r.random() < 0.4:
            middle = f'<div class="{r.choice(["wrapper", "page", "container", "row"])}" data-label="1">{middle}{"".join(rest[:1])}</div>'
            rest = rest[1:]
        return f"<html><head><title>x</title></head><body>{''.join(top)}{middle}{''.join(rest)}</body></html>"


def labelled_pages(n: int = N_PAGES, seed: int = SEED) -> list[str]:
    rng = random.Random(seed)
    return [Page(rng).html() for _ in range(n)]
