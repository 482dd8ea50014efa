"""Labelled pages to learn from: invented sites of many shapes, whose main text is known because it is put there.

Each page comes from a seed: a shape, its parts in and around the article, and filler words. Words tell nothing about
what is main text, as no model here looks at them; marks, places and lengths do.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Names that sites give to their parts; one of a row at a time.
NAMES = {
    "menu": ("menu", "nav", "navbar", "main-nav", "site-navigation", "topnav", "breadcrumbs", "breadcrumb", "nav-links", "pagination", "skip-link", "toc"),
    "header": ("header", "site-header", "masthead", "top-bar", "branding", "logo", "page-header-bar", "banner"),
    "footer": ("footer", "site-footer", "colophon", "bottom", "copyright", "legal", "footer-widgets"),
    "sidebar": ("sidebar", "side", "aside", "widget", "widget-area", "right-column", "rail", "related", "related-posts", "recommended", "popular", "trending", "tags", "archives", "more-stories"),
    "notice": ("notice", "cookie-notice", "cookie-banner", "cookies", "consent", "gdpr", "alert", "popup", "modal", "paywall", "subscribe-box", "newsletter", "announcement", "disclaimer", "message"),
    "advert": ("ad", "ads", "advert", "advertisement", "adbox", "ad-slot", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "teaser"),
    "form": ("form", "search-form", "contact-form", "login", "signup", "comment-form", "subscribe-form", "newsletter-signup"),
    "comments": ("comments", "comment", "comment-list", "comments-area", "responses", "replies", "reply", "discussion", "disqus", "reader-comments", "user-comments"),
    "share": ("share", "social", "share-buttons", "social-links", "byline", "meta", "post-meta", "entry-meta", "author-box", "author-bio"),
    "main": ("content", "main", "main-content", "post", "post-content", "entry", "entry-content", "article", "article-body", "story", "story-body", "text", "body-text", "post-body", "blog-post", "page-content", "prose"),
    "wrapper": ("wrapper", "container", "page", "site", "row", "layout", "inner", "col", "grid", "outer"),
}
VOWELS, CONSONANTS = "aeiou", "bdfghklmnprstvz"


class Writer:
    """A page and, beside it, the blocks that are main text."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.html: list[str] = []
        self.main: list[str] = []

    def word(self) -> str:
        pick = self.random.choice
        return "".join(pick(CONSONANTS) + pick(VOWELS) for _ in range(self.random.randint(1, 3)))

    def phrase(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.random.randint(least, most)))

    def sentence(self) -> str:
        return self.phrase(4, 18).capitalize() + self.random.choice("....!?")

    def prose(self, short: float = 0.2) -> str:
        if self.random.random() < short:
            return self.phrase(1, 4).capitalize() + self.random.choice((".", "", ","))
        return " ".join(self.sentence() for _ in range(self.random.randint(1, 8)))

    def link(self, least: int = 1, most: int = 4) -> str:
        text = self.phrase(least, most)
        return f'<a href="/{text.replace(" ", "-")}">{text}</a>'

    def named(self, part: str) -> str:
        return f' {self.random.choice(("class", "class", "id"))}="{self.random.choice(NAMES[part])}"'

    def add(self, *pieces: str) -> None:
        self.html += pieces

    def keep(self, tag: str, text: str, dress: Callable[[str], str] = lambda t: t) -> None:
        """A block of main text."""
        self.main.append(text)
        self.add(f"<{tag}>", dress(text), self.random.choice((f"</{tag}>", f"</{tag}>", f"</{tag}>\n")))

    def shut(self, element: str, part: str, *inner: str) -> None:
        """A part that is no main text."""
        self.add(f"<{element}{self.named(part) if part and self.random.random() < 0.85 else ''}>", *inner, f"</{element}>")

    def items(self, n: int) -> str:
        return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"

    # parts around the article

    def menu(self) -> None:
        element = self.random.choice(("nav", "nav", "div"))
        name = self.named("menu") if element == "div" or self.random.random() < 0.4 else ""
        self.add(f"<{element}{name}>", self.items(self.random.randint(2, 9)), f"</{element}>")

    def header(self) -> None:
        inner = [f"<h1>{self.link()}</h1>" if self.random.random() < 0.3 else f"<div>{self.link()}</div>", f"<p>{self.phrase(2, 8)}</p>" if self.random.random() < 0.5 else ""]
        element = self.random.choice(("header", "header", "div"))
        self.add(f"<{element}{self.named('header') if element == 'div' or self.random.random() < 0.4 else ''}>", *inner)
        if self.random.random() < 0.5:
            self.menu()
        self.add(f"</{element}>")

    def advert(self) -> None:
        text = " ".join(self.sentence() for _ in range(self.random.randint(1, 3)))
        self.add(self.random.choice(("", "<!-- ad -->")), f'<div{self.named("advert")}>', self.random.choice((text, f"<p>{text}</p>", self.link(3, 9))), "</div>")

    def notice(self) -> None:
        text = " ".join(self.sentence() for _ in range(self.random.randint(1, 3)))
        self.add(f'<{(e := self.random.choice(("div", "div", "section", "p")))}{self.named("notice")}>', text if e == "p" else self.random.choice((text, f"<p>{text}</p>")), f"</{e}>")

    def form(self) -> None:
        labels = "".join(f"<label>{self.phrase(1, 3)}</label><input type=text>" for _ in range(self.random.randint(1, 3)))
        self.add(f"<form{self.named('form') if self.random.random() < 0.5 else ''}>", f"<p>{self.sentence()}</p>" if self.random.random() < 0.5 else "", labels, f"<button>{self.word()}</button></form>")

    def sidebar(self) -> None:
        element = self.random.choice(("aside", "aside", "div", "section"))
        self.add(f"<{element}{self.named('sidebar') if element != 'aside' or self.random.random() < 0.5 else ''}>")
        for _ in range(self.random.randint(1, 3)):
            self.add(f"<h3>{self.phrase(1, 4)}</h3>", self.random.choice((self.items(self.random.randint(2, 7)), f"<p>{self.prose()}</p>")))
        self.add(f"</{element}>")

    def comments(self) -> None:
        element, inner = self.random.choice((("div", "div"), ("section", "div"), ("section", "article"), ("ol", "li"), ("div", "li"), ("ul", "li")))
        self.add(f"<{element}{self.named('comments')}>", f"<h{(h := self.random.choice((2, 3, 4)))}>{self.phrase(1, 3)}</h{h}>" if element not in ("ol", "ul") else "")
        for _ in range(self.random.randint(1, 6)):
            name = self.named("comments") if self.random.random() < 0.6 else ""
            who = f"<{(e := self.random.choice(('span', 'b', 'cite', 'h4', 'div')))}>{self.phrase(1, 2)}</{e}>" if self.random.random() < 0.7 else ""
            self.add(f"<{inner}{name}>", who, "".join(f"<p>{self.prose(0.3)}</p>" for _ in range(self.random.randint(1, 3))) if self.random.random() < 0.7 else self.prose(), f"</{inner}>")
        self.add(f"</{element}>")
        if self.random.random() < 0.4:
            self.form()

    def footer(self) -> None:
        element = self.random.choice(("footer", "footer", "div"))
        name = self.named("footer") if element == "div" or self.random.random() < 0.4 else ""
        text = self.random.choice((f"&copy; {self.phrase(1, 3)} &middot; {self.sentence()}", f"<p>&copy; {self.phrase(2, 9)}</p>", f"<p>{self.sentence()}</p>{self.items(3)}", " ".join(self.sentence() for _ in range(3))))
        self.add(f"<{element}{name}>", text, f"</{element}>")

    def share(self) -> None:
        self.add(f"<div{self.named('share')}>", self.random.choice((" ".join(self.link() for _ in range(3)), self.phrase(2, 6), f"<span>{self.phrase(1, 3)}</span>")), "</div>")

    # the article

    def article(self) -> None:
        chance = self.random.random
        kind = self.random.choice(("article", "article", "main", "div", "div", "section", "bare"))
        open_, close = ("", "") if kind == "bare" else (f"<{kind}{self.named('main') if kind in ('div', 'section') or chance() < 0.3 else ''}>", f"</{kind}>")
        self.add(open_)
        inner = chance() < 0.25
        if chance() < 0.85:
            headed = chance() < 0.2
            self.add("<header>" if headed else "")
            self.keep(self.random.choice(("h1", "h1", "h2")), self.phrase(1, 12))
            if chance() < 0.2:
                self.share()
            self.add("</header>" if headed else "")
        if inner:
            self.add(f"<div{self.named('main') if chance() < 0.7 else ''}>")
        for k in range(self.random.randint(1, 14)):
            self.passage()
            if k and chance() < 0.06:
                self.random.choice((self.advert, self.notice, self.form, self.sidebar, self.share))()
        if inner:
            self.add("</div>")
        if chance() < 0.12:
            self.share()
        if kind in ("article", "div", "main") and chance() < 0.12:
            self.comments()
        self.add(close)

    def passage(self) -> None:
        chance = self.random.random()
        if chance < 0.7:
            text = self.prose(0.25)
            dress = self.random.choice((lambda t: t, lambda t: t, lambda t: f"<b>{t}<br>", lambda t: f"<em>{t}</em>", self.linked))
            self.keep("p", text, dress)
        elif chance < 0.78:
            self.keep(self.random.choice(("h2", "h3")), self.phrase(1, 8))
        elif chance < 0.86:
            self.add("<ul>")
            for _ in range(self.random.randint(1, 6)):
                self.keep("li", self.phrase(1, 14), self.linked if self.random.random() < 0.3 else lambda t: t)
            self.add("</ul>")
        elif chance < 0.91:
            self.add("<blockquote>")
            self.keep("p", self.prose(0))
            self.add("</blockquote>")
        elif chance < 0.95:
            self.add("<table><tr>")
            for _ in range(self.random.randint(1, 4)):
                self.keep("td", self.phrase(1, 5))
            self.add("</tr></table>")
        else:
            self.add("<figure><img src=x>")
            self.keep("figcaption", self.phrase(3, 12))
            self.add("</figure>")

    def linked(self, text: str) -> str:
        words = text.split(" ")
        at = self.random.randrange(len(words))
        return " ".join([*words[:at], f'<a href="/x">{words[at]}</a>', *words[at + 1 :]])

    def page(self) -> tuple[str, list[str]]:
        chance = self.random.random
        self.add("<!DOCTYPE html><html><head><title>", self.phrase(2, 8), "</title><style>p{margin:0}</style><script>x='</p>'</script></head><body>")
        wrapped = self.random.randint(0, 2)
        self.add(*(f"<div{self.named('wrapper')}>" for _ in range(wrapped)))
        for part, odds in ((self.notice, 0.2), (self.header, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.sidebar, 0.15)):
            if chance() < odds:
                part()
        self.article()
        parts = [(self.share, 0.15), (self.comments, 0.4), (self.sidebar, 0.4), (self.advert, 0.2), (self.form, 0.15), (self.menu, 0.1)]
        self.random.shuffle(parts)
        for part, odds in parts:
            if chance() < odds:
                part()
        if chance() < 0.85:
            self.footer()
        if chance() < 0.15:
            self.notice()
        self.add("</div>" * wrapped, "</body></html>" if chance() < 0.9 else "")
        return "".join(self.html), self.main


def labelled_pages(n: int, seed: int = 0) -> list[tuple[str, list[str]]]:
    """n pages, each with the blocks of its main text in order."""
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
