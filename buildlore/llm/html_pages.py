"""Pages with known main text, for training: a fixed set, made by rule from layouts, name lists and pseudo-words."""

from __future__ import annotations

import numpy as np

MAIN, WRAPPER, BOILER = 0, 1, 2

#: Names that sites give to parts of a page.
NAMES = {
    "main": "article content post entry story main body text post-content article-body entry-content page-content blog-post news".split(),
    "nav": "nav menu navbar navigation main-menu breadcrumb breadcrumbs topnav pagination pager site-nav links toc".split(),
    "header": "header masthead site-header top-bar topbar banner branding logo page-header".split(),
    "footer": "footer site-footer colophon copyright bottom legal page-footer credits".split(),
    "sidebar": "sidebar aside widget related recommended rail secondary popular trending archive tags".split(),
    "notice": "cookie cookie-notice consent notice alert popup modal newsletter subscribe gdpr overlay paywall disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner-ad adslot ad-box".split(),
    "form": "form search search-form login signup contact-form".split(),
    "comments": "comments comment comment-list respond replies discussion disqus reader-comments".split(),
    "share": "share social sharing follow share-buttons".split(),
    "wrapper": "wrapper container page site layout row col grid inner outer wrap columns".split(),
}
TAGS = {
    "nav": ["nav", "div", "nav", "ul"], "header": ["header", "div"], "footer": ["footer", "div", "footer"], "sidebar": ["aside", "div", "section"],
    "notice": ["div", "section", "p", "aside"], "ad": ["div", "div", "aside", "p"], "form": ["form"], "comments": ["div", "section", "ul"], "share": ["div", "ul"],
}


class PageMaker:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.out: list[str] = []
        self.labels: list[int] = []

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def word(self) -> str:
        return "".join(self.pick(["an", "er", "th", "on", "is", "le", "que", "ment", "sch", "ei", "do", "ra", "ti", "sta", "in", "é"]) for _ in range(int(self.rng.integers(1, 4))))

    def sentence(self, most: int = 20) -> str:
        words = [self.word() for _ in range(int(self.rng.integers(1, most)))]
        if self.chance(0.1):
            words = [w + self.pick(["&amp;", "***", "%%%", "&nbsp;"]) for w in words]
        comma = "," if self.chance(0.3) else ""
        return words[0].capitalize() + comma + " " + " ".join(words[1:]) + "."

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 8))))

    def attribute(self, kind: str, p: float = 0.8) -> str:
        if not self.chance(p):
            return ""
        return f' {self.pick(["class", "class", "id"])}="{self.pick(NAMES[kind])}"'

    def open(self, tag: str, attributes: str, label: int) -> None:
        self.out.append(f"<{tag}{attributes}>")
        self.labels.append(label)

    def links(self, n: int, label: int, listed: bool) -> None:
        for _ in range(n):
            text = self.word() + (" " + self.word() if self.chance(0.4) else "")
            if listed:
                self.open("li", "", label)
            self.out.append(f'<a href="/{self.word()}">{text}</a>' + ("</li>" if listed else " "))

    def boiler(self, kind: str) -> None:
        tag = self.pick(TAGS[kind])
        plain = tag in ("nav", "header", "footer", "aside", "form")
        self.open(tag, self.attribute(kind, 0.4 if plain else 1.0), BOILER)
        if kind in ("nav", "share"):
            listed = tag == "ul" or self.chance(0.7)
            inner = listed and tag != "ul"
            if inner:
                self.open("ul", "", BOILER)
            self.links(int(self.rng.integers(2, 10)), BOILER, listed)
            self.out.append("</ul>" if inner else "")
        elif kind == "header":
            if self.chance(0.5):
                title = self.pick(["h1", "div", "div"])
                self.open(title, "", BOILER)
                self.out.append(f"{self.sentence(5)}</{title}>")
            if self.chance(0.4):
                self.boiler("nav")
        elif kind == "form":
            self.out.append(f"<label>{self.word()}</label> <input type=text> ")
            if self.chance(0.5):
                self.open("p", "", BOILER)
                self.out.append(self.sentence() + "</p>")
        elif kind == "comments":
            if self.chance(0.5):
                self.open("h3", "", BOILER)
                self.out.append(self.sentence(5) + "</h3>")
            for _ in range(int(self.rng.integers(1, 6))):
                inner = "li" if tag == "ul" else self.pick(["div", "article", "div"])
                self.open(inner, self.attribute("comments", 0.7), BOILER)
                for _ in range(int(self.rng.integers(1, 3))):
                    self.open("p", "", BOILER)
                    self.out.append(self.prose() + "</p>")
                self.out.append(f"</{inner}>")
        elif kind == "sidebar":
            for _ in range(int(self.rng.integers(1, 4))):
                title = self.pick(["h2", "h3", "h4"])
                self.open(title, "", BOILER)
                self.out.append(self.sentence(4) + f"</{title}>")
                if self.chance(0.6):
                    self.open("ul", "", BOILER)
                    self.links(int(self.rng.integers(2, 7)), BOILER, True)
                    self.out.append("</ul>")
                else:
                    self.open("p", "", BOILER)
                    self.out.append(self.prose() + "</p>")
        else:
            inner = tag != "p" and self.chance(0.4)
            if inner:
                self.open("p", "", BOILER)
            self.out.append(("&copy; " if kind == "footer" else "") + " ".join(self.sentence() for _ in range(int(self.rng.integers(1, 4)))))
            if self.chance(0.3):
                self.links(int(self.rng.integers(1, 4)), BOILER, False)
            if inner:
                self.out.append("</p>")
        self.out.append(f"</{tag}>")

    def article(self) -> None:
        style = self.rng.random()
        tag = "article" if style < 0.5 else "main" if style < 0.6 else self.pick(["div", "section"])
        self.open(tag, self.attribute("main", 0.4 if tag in ("article", "main") else 0.95), MAIN)
        if self.chance(0.75):
            boxed = self.chance(0.15)
            if boxed:
                self.open("header", "", MAIN)
            self.open("h1", "", MAIN)
            self.out.append(self.sentence(12) + "</h1>" + ("</header>" if boxed else ""))
        inner = self.chance(0.25)
        if inner:
            self.open("div", self.attribute("main", 0.7), MAIN)
        for _ in range(int(self.rng.integers(1, 12))):
            kind = self.rng.random()
            if kind < 0.7:
                self.open("p", "", MAIN)
                text = self.prose() if self.chance(0.9) else self.sentence(3)
                if self.chance(0.2):
                    text += f' <a href="#">{self.word()}</a> ' + self.sentence(5)
                if self.chance(0.15):
                    text = "<b>" + text + ("<br>" if self.chance(0.7) else "</b>")
                self.out.append(text + ("</p>" if self.chance(0.85) else ""))
            elif kind < 0.78:
                h = self.pick(["h2", "h3"])
                self.open(h, "", MAIN)
                self.out.append(self.sentence(8) + f"</{h}>")
            elif kind < 0.84:
                lst = self.pick(["ul", "ol"])
                self.open(lst, "", MAIN)
                for _ in range(int(self.rng.integers(1, 5))):
                    self.open("li", "", MAIN)
                    self.out.append(self.sentence() + "</li>")
                self.out.append(f"</{lst}>")
            elif kind < 0.88:
                quote = self.pick(["blockquote", "pre", "figure"])
                self.open(quote, "", MAIN)
                self.out.append(self.prose() + f"</{quote}>")
            elif kind < 0.9:
                self.open("table", "", MAIN)
                for _ in range(2):
                    self.open("tr", "", MAIN)
                    for _ in range(2):
                        self.open("td", "", MAIN)
                        self.out.append(self.sentence(4) + "</td>")
                    self.out.append("</tr>")
                self.out.append("</table>")
            else:
                self.boiler(self.pick(["ad", "ad", "share", "sidebar", "notice", "form", "nav"]))
        self.out.append("</div>" if inner else "")
        if self.chance(0.12):
            self.boiler("comments")
        self.out.append(f"</{tag}>")

    def page(self) -> tuple[str, list[int]]:
        """A page's HTML and the label of each of its block elements, in page order."""
        self.out, self.labels = ["<!DOCTYPE html>"], [WRAPPER]
        self.open("html", "", WRAPPER)
        self.out.append(f"<head><title>{self.sentence(8)}</title><script>var t='</p>';</script></head>")
        self.open("body", "", WRAPPER)
        depth = int(self.rng.integers(0, 3)) if self.chance(0.5) else 0
        for kind in ("notice", "header", "nav", "ad"):
            if self.chance(0.25 if kind == "notice" else 0.55):
                self.boiler(kind)
        around = [self.pick(["div", "div", "main", "section"]) for _ in range(depth)]
        for tag in around:
            self.open(tag, self.attribute("wrapper"), WRAPPER)
        sides = [k for k in ("ad", "sidebar", "form", "nav") if self.chance(0.25)]
        for kind in sides[: len(sides) // 2]:
            self.boiler(kind)
        self.article()
        for kind in sides[len(sides) // 2 :]:
            self.boiler(kind)
        if self.chance(0.25):
            self.boiler("comments")
        self.out += [f"</{tag}>" for tag in reversed(around)]
        for kind in ("ad", "footer", "notice"):
            if self.chance(0.6 if kind == "footer" else 0.15):
                self.boiler(kind)
        self.out.append("</body></html>" if self.chance(0.9) else "")
        return "".join(self.out), self.labels
