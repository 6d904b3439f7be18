"""Generated web pages with known main text, which the extraction's trees are trained on.

Words are random syllables, so that nothing is learned about any language; layouts, element
names, attribute names, lengths and the places of what surrounds an article vary from page to page.
"""

from __future__ import annotations

import numpy as np

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu an er in on un st tr pl é ü ñ ß å the of".split()


class _Page:
    def __init__(self, random: np.random.Generator):
        self.r = random
        self.blocks: dict[str, bool] = {}
        self.n = 0

    def pick(self, *options):
        return options[int(self.r.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, n: int) -> str:
        """``n`` words, the last with a number that no other block of the page has."""
        parts = ["".join(_SYLLABLES[i] for i in self.r.integers(len(_SYLLABLES), size=int(k))) for k in self.r.integers(1, 5, size=n)]
        self.n += 1
        return " ".join(parts) + f"q{self.n}q"

    def prose(self, sentences: int) -> str:
        out = []
        for _ in range(sentences):
            s = self.words(int(self.r.integers(1, 24)))
            if self.chance(0.3) and " " in s:
                s = s.replace(" ", ", ", 1)
            out.append(s[0].upper() + s[1:] + self.pick(".", ".", ".", ".", "!", "?", "", "&amp;", "***"))
        return " ".join(out)

    def block(self, text: str, main: bool) -> str:
        """``text`` as it will be read, remembered with its label."""
        from html import unescape

        self.blocks[" ".join(unescape(text).split())] = main
        return text

    def cls(self, *names: str) -> str:
        """A class or id attribute with one of ``names``, or sometimes none that says anything."""
        name = self.pick(*names)
        if self.chance(0.15):
            name = self.pick("a1", "c-block", "row", "col", "wrap", "inner", "x9")
        elif self.chance(0.25):
            name = self.pick("site-", "js-", "my_", "l-", "block ") + name
        return f' {self.pick("class", "class", "class", "id")}="{name}"'

    def link(self, n: int) -> str:
        return f'<a href="/{self.r.integers(10**6)}">{self.words(n)}</a>'

    def p(self, main: bool, sentences: int | None = None) -> str:
        n = sentences or int(self.pick(1, 1, 2, 3, 5, 8, 14))
        text = self.block(self.prose(n) if not self.chance(0.3 if sentences else 0.08) else self.words(1) + self.pick(".", ""), main)
        if self.chance(0.2):
            first, _, rest = text.partition(" ")
            text = self.pick(f"<b>{first} {rest}", f"<em>{first}</em> {rest}", f'<a href="/x">{first}</a> {rest}')
        return f"<p>{text}</p>" if not self.chance(0.1) else f"<p>{text}<br>"

    def menu(self, *names: str) -> str:
        items = [self.link(int(self.r.integers(1, 4))) for _ in range(int(self.r.integers(2, 12)))]
        for i in items:
            self.block(i[i.index(">") + 1 : -4], False)
        body = self.pick("".join(f"<li>{i}</li>" for i in items), "".join(f"<div>{i}</div>" for i in items))
        body = f"<ul>{body}</ul>" if "<li>" in body else body
        return self.pick(f"<nav>{body}</nav>", f"<nav>{body}</nav>", f"<div{self.cls(*names)}>{body}</div>", f"<ul{self.cls(*names)}>{body}</ul>")

    def few(self, low: int = 1, high: int = 3) -> str:
        return self.block(self.prose(int(self.r.integers(low, high + 1))), False)

    def ad(self) -> str:
        text = self.few(1, 3)
        return self.pick(
            f"<div{self.cls('ad', 'ads', 'advert', 'sponsored', 'promo', 'advertisement', 'ad-slot')}>{self.pick(text, f'<p>{text}</p>', f'<a href=/>{text}</a>')}</div>",
            f"<aside{self.cls('ad', 'advertisement', 'sponsor', 'promo')}><p>{text}</p></aside>",
            f"<section{self.cls('promotion', 'sponsored-content', 'ads')}><div>{text}</div></section>",
        )

    def notice(self) -> str:
        text = self.few(1, 3)
        names = self.cls("cookie-banner", "cookie-notice", "consent", "gdpr", "notice", "alert", "site-notice", "popup", "modal")
        button = f"<button>{self.block(self.words(1), False)}</button>" if self.chance(0.5) else ""
        return f"<{(t := self.pick('div', 'div', 'section', 'aside'))}{names}>{self.pick(text, f'<p>{text}</p>')}{button}</{t}>"

    def form(self) -> str:
        text = self.few(1, 2)
        inside = self.pick(f"<label>{text}</label><input name=q>", f"<p>{text}</p><input type=email><button>{self.block(self.words(2), False)}</button>", f"{text}<input>")
        return self.pick(f"<form{self.cls('newsletter', 'search', 'signup', 'subscribe', 'login')}>{inside}</form>", f"<form>{inside}</form>", f"<div{self.cls('newsletter', 'subscribe', 'signup')}><form>{inside}</form></div>")

    def share(self) -> str:
        return self.menu("share", "social", "share-buttons", "social-links").replace("nav>", "div>")

    def side(self) -> str:
        parts = []
        for _ in range(int(self.r.integers(1, 4))):
            head = f"<h3>{self.block(self.words(2), False)}</h3>"
            parts.append(head + self.pick(self.menu("widget", "related", "popular"), f"<p>{self.few()}</p>", f"<div{self.cls('teaser', 'card', 'related')}><p>{self.few()}</p></div>", self.ad(), self.form()))
        body = "".join(parts)
        return self.pick(f"<aside>{body}</aside>", f"<aside{self.cls('sidebar', 'rail', 'related')}>{body}</aside>", f"<div{self.cls('sidebar', 'side', 'right-rail', 'widgets', 'related-posts', 'secondary')}>{body}</div>")

    def comments(self) -> str:
        rows = []
        for _ in range(int(self.r.integers(1, 8))):
            t, who, text = self.pick("span", "div", "h4"), self.words(2), self.prose(int(self.pick(1, 2, 4, 8)))
            if t == "span":
                said = f"<p><span>{who}</span> {text}</p>"
                self.block(f"{who} {text}", False)
            else:
                said = f"<{t}>{self.block(who, False)}</{t}><p>{self.block(text, False)}</p>"
            rows.append(self.pick(f"<li{self.cls('comment', 'reply')}>{said}</li>", f"<div{self.cls('comment', 'comment-body', 'review')}>{said}</div>", f"<article{self.cls('comment', 'comment-item')}>{said}</article>"))
        head = f"<h{self.pick(2, 3)}>{self.block(self.words(2), False)}</h3>" if self.chance(0.6) else ""
        body = "".join(rows)
        body = f"<ol>{body}</ol>" if "<li" in body else body
        tail = self.form() if self.chance(0.4) else ""
        names = self.cls("comments", "comment-list", "discussion", "responses", "reader-comments", "respond")
        return f"<{(t := self.pick('section', 'div', 'div', 'aside'))}{names}>{head}{body}{tail}</{t}>"

    def header(self) -> str:
        name = f"<{(t := self.pick('h1', 'div', 'p', 'span', 'h2'))}>{self.block(self.words(int(self.r.integers(1, 5))), False)}</{t}>"
        body = name + (f"<p>{self.few(1, 1)}</p>" if self.chance(0.3) else "") + (self.menu("menu", "nav", "main-nav", "navbar") if self.chance(0.5) else "")
        return self.pick(f"<header>{body}</header>", f"<header>{body}</header>", f"<div{self.cls('header', 'masthead', 'site-header', 'top-bar', 'branding')}>{body}</div>")

    def footer(self) -> str:
        text = self.block(self.pick("&copy; ", "&#169; ", "") + self.words(2) + self.pick(" &middot; ", " ") + self.prose(int(self.r.integers(1, 4))), False)
        body = self.pick(text, f"<p>{text}</p>", f"<div>{text}</div>") + (self.menu("footer-links", "legal") if self.chance(0.3) else "")
        return self.pick(f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{self.cls('footer', 'site-footer', 'copyright', 'bottom')}>{body}</div>")

    def article(self) -> str:
        parts = []
        if self.chance(0.85):
            parts.append(f"<h{(k := self.pick(1, 1, 1, 2))}>{self.block(self.words(int(self.r.integers(2, 14))), True)}</h{k}>")
        many = int(self.pick(1, 1, 1, 1, 2, 2, 4, 8, 12, 20, 35))
        odd, short = self.chance(0.3), self.chance(0.35)
        for _ in range(many):
            what = self.r.random()
            if what < 0.82 or not odd:
                parts.append(self.p(True, 1 if short else None))
            elif what < 0.87:
                parts.append(f"<h{(k := self.pick(2, 3))}>{self.block(self.words(int(self.r.integers(1, 8))), True)}</h{k}>")
            elif what < 0.91:
                parts.append("<ul>" + "".join(f"<li>{self.block(self.prose(self.pick(1, 2)), True)}</li>" for _ in range(int(self.r.integers(2, 7)))) + "</ul>")
            elif what < 0.94:
                parts.append(f"<blockquote><p>{self.block(self.prose(2), True)}</p></blockquote>")
            elif what < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{self.block(self.prose(1), True)}</figcaption></figure>")
            elif what < 0.98:
                parts.append("<table>" + "".join(f"<tr><td>{self.block(self.words(2), True)}</td><td>{self.block(self.prose(1), True)}</td></tr>" for _ in range(int(self.r.integers(1, 5)))) + "</table>")
            else:
                parts.append(f"<pre>{self.block(self.words(6), True)}</pre>")
        # What gets between an article's paragraphs.
        for make, p in ((self.ad, 0.2), (self.share, 0.12), (self.form, 0.08), (self.notice, 0.06), (self.side, 0.06), (lambda: self.menu("toc", "breadcrumb"), 0.05), (self.comments, 0.05)):
            if self.chance(p):
                parts.insert(int(self.r.integers(len(parts) + 1)), make())
        body = "".join(parts)
        names = self.cls("content", "article-body", "post", "entry-content", "main", "story", "text", "post-body")
        return self.pick(
            f"<article>{body}</article>",
            f"<article>{body}</article>",
            f"<article{names}>{body}</article>",
            f"<main>{body}</main>",
            f"<main><article>{body}</article></main>",
            f"<div{names}>{body}</div>",
            f"<div{names}><div>{body}</div></div>",
            f"<section{names}>{body}</section>",
        )


def page(random: np.random.Generator) -> tuple[str, dict[str, bool]]:
    """(html, its blocks of text with whether they belong to the article)."""
    g = _Page(random)
    before = [f() for f, p in ((g.notice, 0.2), (g.header, 0.45), (lambda: g.menu("menu", "nav", "navbar", "navigation"), 0.65), (g.ad, 0.4), (lambda: g.menu("breadcrumb", "breadcrumbs"), 0.15), (g.form, 0.12), (g.side, 0.12)) if g.chance(p)]
    after = [f() for f, p in ((g.share, 0.12), (g.ad, 0.15), (g.comments, 0.3), (g.side, 0.3), (g.form, 0.15), (g.notice, 0.15), (g.footer, 0.75)) if g.chance(p)]
    parts = [*before, g.article() if not g.chance(0.02) else "", *after]
    body = "<!-- x -->".join(parts)
    if g.chance(0.35):
        body = f"<div{g.cls('wrapper', 'page', 'container', 'layout')}>{body}</div>"
    if g.chance(0.1):
        body = f"<table><tr><td>{body}</td></tr></table>"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{g.words(4)}</title><style>p{{margin:0}}</style></head><body>{body}</body></html>", g.blocks
