"""Labelled pages for the extraction model: made by rule, with the label of every block in ``data-y``."""

from __future__ import annotations

import random

_WORDS = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work government number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name president team minute idea".split()
_LINKS = "Home News Sport About Contact Login Search Shop More Archive Help Terms Privacy Jobs Team Blog Forum".split()


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        out = [self.r.choice(_WORDS) for _ in range(self.r.randint(low, high))]
        for k in range(7, len(out), 8):
            out[k] += self.r.choice([",", ".", ".", ";"])
        return " ".join(out).capitalize() + self.r.choice([".", ".", "!", ""])

    def links(self, low: int, high: int, y: int) -> str:
        return f'<ul data-y="{y}">' + "".join(f'<li data-y="{y}"><a href="/x">{self.r.choice(_LINKS)}</a></li>' for _ in range(self.r.randint(low, high))) + "</ul>"

    def box(self, tag: str, name: str, y: int, inner: str) -> str:
        key = self.r.choice(["class", "class", "id"])
        return f'<{tag} {key}="{name}" data-y="{y}">{inner}</{tag}>' if name else f'<{tag} data-y="{y}">{inner}</{tag}>'

    def part(self, y: int, low: int = 1, high: int = 3, long: int = 40) -> str:
        return "".join(f'<p data-y="{y}">{self.words(4, long)}</p>' for _ in range(self.r.randint(low, high)))

    def noise(self, where: str) -> str:
        r = self.r
        links = lambda: self.links(3, 9, 0)
        kinds = {
            "top": [
                lambda: self.box("nav", r.choice(["", "menu", "main-nav"]), 0, links()),
                lambda: self.box("header", r.choice(["", "site-header", "masthead"]), 0, f'<h1 data-y="0">{self.words(1, 4)}</h1>' + r.choice([links(), self.part(0, 1, 1, 8)])),
                lambda: self.box("div", r.choice(["header", "topbar", "menu", "navbar", "breadcrumbs", "nav"]), 0, r.choice([links(), self.part(0, 1, 1, 12)])),
                lambda: self.box("div", r.choice(["cookie-notice", "cookie", "notice", "consent", "gdpr-banner", "alert", "message"]), 0, self.part(0, 1, 2)),
                lambda: self.box("div", r.choice(["ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot"]), 0, r.choice([self.words(4, 20), self.part(0, 1, 2)])),
                lambda: self.box("form", r.choice(["", "search", "login"]), 0, f'<label data-y="0">{self.words(1, 4)}</label><input name="q"><button data-y="0">Go</button>'),
            ],
            "side": [
                lambda: self.box("aside", r.choice(["", "sidebar", "related"]), 0, r.choice([links(), self.part(0)])),
                lambda: self.box("div", r.choice(["sidebar", "side", "widget", "related", "recommended", "popular", "share", "social", "tags", "newsletter", "subscribe", "popup", "toolbar", "pagination"]), 0, r.choice([links(), self.part(0)])),
                lambda: self.box("div", r.choice(["ad", "ads", "advert", "sponsor", "promo"]), 0, self.words(4, 30)),
            ],
            "bottom": [
                lambda: self.box("footer", r.choice(["", "site-footer"]), 0, r.choice([self.words(3, 14), links(), self.part(0)])),
                lambda: self.box("div", r.choice(["footer", "bottom", "copyright", "legal", "disclaimer"]), 0, r.choice([self.words(3, 14), links(), self.part(0)])),
                lambda: self.box(r.choice(["section", "div", "ol", "ul"]), r.choice(["comments", "comment-list", "responses", "discussion"]), 0, "".join(self.box(r.choice(["div", "article", "li"]), r.choice(["comment", "reply", "comment-body"]), 0, r.choice([self.words(4, 60), self.part(0)])) for _ in range(r.randint(1, 5)))),
                lambda: self.box("form", r.choice(["", "comment-form", "contact"]), 0, f'<p data-y="0">{self.words(2, 10)}</p><textarea></textarea>'),
            ],
        }
        return r.choice(kinds[where])()

    def article(self) -> str:
        r = self.r
        parts = [f'<h1 data-y="1">{self.words(2, 9)}</h1>'] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 9)):
            parts.append(
                r.choice(
                    [
                        lambda: self.part(1, 1, 3, 90),
                        lambda: self.part(1, 1, 3, 90),
                        lambda: self.part(1, 1, 2, 12),
                        lambda: f'<p data-y="1">{self.words(3, 30)} <a href="/y">{self.words(1, 5)}</a> {self.words(3, 30)}</p>',
                        lambda: f'<h2 data-y="1">{self.words(1, 6)}</h2>',
                        lambda: '<ul data-y="1">' + "".join(f'<li data-y="1">{self.words(2, 25)}</li>' for _ in range(r.randint(1, 5))) + "</ul>",
                        lambda: f'<blockquote data-y="1">{r.choice([self.words(5, 40), self.part(1)])}</blockquote>',
                        lambda: f'<table data-y="1"><tr data-y="1"><td data-y="1">{self.words(1, 6)}</td><td data-y="1">{self.words(1, 6)}</td></tr></table>',
                        lambda: f'<pre data-y="1">{self.words(3, 20)}</pre>',
                        lambda: f'<figure data-y="1"><img src="a"><figcaption data-y="1">{self.words(3, 12)}</figcaption></figure>',
                        lambda: f'<section data-y="1">{self.part(1, 1, 3, 60)}</section>',
                        lambda: f'<div data-y="1">{r.choice([self.words(5, 80), self.part(1, 1, 3, 60)])}</div>',
                    ]
                )()
            )
            if r.random() < 0.12:
                parts.append(self.noise("side"))
        return "".join(parts)

    def page(self) -> str:
        r = self.r
        tops = "".join(self.noise("top") for _ in range(r.randint(0, 3)))
        ends = "".join(self.noise("bottom") for _ in range(r.randint(0, 3)))
        sides = "".join(self.noise("side") for _ in range(r.randint(0, 2)))
        tag, name = r.choice([("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post"), ("div", "entry-content"), ("div", "story"), ("section", "main"), ("div", "text"), ("div", "")])
        body = self.box(tag, name, 1, self.article() + (self.noise("bottom") if r.random() < 0.15 else ""))
        if r.random() < 0.4:
            body = self.box(r.choice(["div", "main"]), r.choice(["", "wrapper", "page", "container"]), 1, (sides if r.random() < 0.5 else "") + body)
        body = r.choice([sides + body, body + sides, body])
        return f'<html><head><title>{self.words(2, 6)}</title></head><body data-y="1">{tops}{body}{ends}</body></html>'


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    maker = _Maker(seed)
    return [maker.page() for _ in range(n)]
