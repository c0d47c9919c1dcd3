"""Made-up web pages with known main text, to train the block labeller on.

A page puts an article among menus, headers, footers, side bars, notices, adverts, forms and
reader comments, under the element names, classes and ids that sites commonly give them.
"""

from __future__ import annotations

import random

from concord.llm.htmlblocks import FURNITURE

LETTERS = "etaoinsrhldcumfpgwybvkäöüßéèêçñóíáàô"
SMALL_TALK = sorted(FURNITURE)
# Names that sites give such parts.
NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs links pagination toc",
    "header": "header masthead top banner branding site-header logo",
    "footer": "footer bottom site-footer foot copyright colophon legal",
    "aside": "sidebar aside side related widget rail popular recommended more-stories",
    "notice": "cookie notice consent gdpr banner alert popup modal newsletter subscribe paywall promo-bar cookie-banner",
    "ad": "ad ads advert advertisement sponsor sponsored promo adsbygoogle ad-slot banner-ad",
    "comments": "comments comment comment-list replies discussion disqus reader-comments responses commentlist",
    "form": "form search searchform login contact signup subscribe-form",
    "share": "share social sharing share-buttons tools meta-share",
    "toc": "toc contents table-of-contents toctree page-nav",
    "references": "references reflist footnotes citations notes sources",
}
MAIN_NAMES = "content article post entry main story text body post-content article-body entry-content page-content hentry single blog-post news-item"
#: Names that tell nothing of a part, alone or joined to one that does.
NEUTRAL = "wrapper wrap container inner outer row col column grid layout site page block section box area primary secondary group list item wp js top main left right center large small home blog theme body default panel unit module".split()


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[int] = []
        #: Names of this page tell nothing, as those that build tools make.
        self.hashed = False

    def hash_name(self) -> str:
        mark = "".join(self.r.choices("abcdefghjkmnpqrstuvwxyz0123456789", k=self.r.randint(3, 6)))
        return f"{self.r.choice(['css', 'sc', 'jsx', 'x', 'c', 'style', '_'])}-{mark}"

    def word(self) -> str:
        return "".join(self.r.choices(LETTERS, k=self.r.randint(2, 9)))

    def prose(self, low: int, high: int) -> str:
        """Sentences, or now and then something unlike them, as articles may hold anything."""
        odd = self.r.random()
        if odd < 0.2:
            words = [self.word() for _ in range(self.r.randint(low, high))]
            if odd < 0.05:
                return " | ".join(words) + self.r.choice(["", " |"])
            if odd < 0.09:
                return " ".join(f"{w.upper()}!!" for w in words)
            if odd < 0.13:
                return " ".join(w + self.r.choice(["###", "$$$", "&amp;&amp;", "%%%", "***"]) for w in words)
            if odd < 0.16:
                return " ".join([words[0]] * len(words))
            return " ".join(words) + self.r.choice(["", " 2024", ":", " +1 555 0100", " a@b.example"])
        out, left = [], self.r.randint(low, high)
        while left > 0:
            n = min(left, self.r.randint(1, 14))
            words = [self.word() for _ in range(n)]
            out.append(" ".join(words).capitalize() + self.r.choice("...?!"))
            left -= n
        return " ".join(out)

    def chatter(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(SMALL_TALK) if self.r.random() < 0.5 else self.word() for _ in range(self.r.randint(low, high))).capitalize()

    def some(self) -> str:
        return self.prose(2, 40) if self.r.random() < 0.5 else self.chatter(1, 12)

    def put(self, html: str, *labels: int) -> None:
        self.parts.append(html)
        self.labels += labels

    def attribute(self, kind: str) -> str:
        if self.hashed:
            return "" if self.r.random() < 0.3 else f' class="{" ".join(self.hash_name() for _ in range(self.r.randint(1, 2)))}"'
        name = self.r.choice((MAIN_NAMES if kind == "main" else NAMES[{"letter": "notice", "said": "comments"}.get(kind, kind)]).split())
        chance = self.r.random()
        if chance < 0.2:
            name = f"{self.r.choice(NEUTRAL)}-{name}"
        elif chance < 0.4:
            name = f"{name}-{self.r.choice(NEUTRAL)}"
        if self.r.random() < 0.25:
            name = " ".join(self.r.sample([name, self.r.choice(NEUTRAL)], 2))
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def neutral(self) -> str:
        """Attributes that tell nothing, or none."""
        if self.hashed:
            return "" if self.r.random() < 0.4 else f' class="{self.hash_name()}"'
        names = " ".join("-".join(self.r.choices(NEUTRAL, k=self.r.randint(1, 2))) for _ in range(self.r.randint(1, 2)))
        return f' {self.r.choice(["class", "id"])}="{names}"' if self.r.random() < 0.75 else ""

    def wrapped(self, parts, most: int) -> None:
        """What parts() puts, inside some elements that tell nothing."""
        depth = self.r.randint(0, most) if self.r.random() < 0.6 else 0
        for _ in range(depth):
            self.put(f"<div{self.neutral()}>")
        parts()
        self.put("</div>" * depth)

    def opened(self, tag: str, kind: str) -> tuple[str, str]:
        """An element of the part's own tag, or a div that is named after it."""
        if tag and self.r.random() < 0.6:
            return f"<{tag}{self.attribute(kind) if self.r.random() < 0.3 else ''}>", f"</{tag}>"
        other = self.r.choice(["div", "div", "section", "ul" if kind == "nav" else "div"])
        return f"<{other}{self.attribute(kind)}>", f"</{other}>"

    def links(self, low: int, high: int) -> None:
        n = self.r.randint(low, high)
        listed = self.r.random() < 0.7
        self.put("<ul>" if listed else "")
        for _ in range(n):
            text = self.word() if self.r.random() < 0.6 else self.chatter(1, 3)
            self.put(f'<li><a href="/{self.word()}">{text}</a></li>' if listed else f'<div><a href="#">{text}</a></div>', 0)
        self.put("</ul>" if listed else "")

    def part(self, kind: str) -> None:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "toc": "nav" if self.r.random() < 0.3 else ""}.get(kind, "")
        a, b = self.opened(tag, kind)
        self.put(a)
        if kind == "nav":
            self.links(2, 9)
        elif kind in ("header", "footer"):
            if self.r.random() < 0.5:
                self.put(f"<{(h := self.r.choice(['p', 'div', 'h1' if kind == 'header' else 'p', 'span']))}>{'&copy; ' if kind == 'footer' else ''}{self.some()}</{h}>", 0)
            else:
                self.put(("&copy; " if kind == "footer" and self.r.random() < 0.8 else "") + self.some(), 0)
            if self.r.random() < 0.4:
                self.links(1, 5)
        elif kind == "aside":
            for _ in range(self.r.randint(1, 3)):
                self.put(f"<h3>{self.chatter(1, 4)}</h3>", 0)
                self.put(f"<p>{self.some()}</p>", 0) if self.r.random() < 0.5 else self.links(2, 5)
        elif kind == "comments":
            self.put(f"<h3>{self.chatter(1, 3)}</h3>", 0)
            for _ in range(self.r.randint(1, 5)):
                e = self.r.choice(["p", "li", "div", "article" if self.r.random() < 0.3 else "p"])
                self.put(f"<{e}>{self.prose(3, 50)}</{e}>", 0)
        elif kind == "toc":
            self.put(f"<{(h := self.r.choice(['h2', 'p', 'span', 'div']))}>{self.r.choice(['Contents', 'On this page', 'Table of contents', self.chatter(1, 2)])}</{h}>", 0)
            self.links(2, 7)
        elif kind == "references":
            if self.r.random() < 0.7:
                self.put(f"<h2>{self.r.choice(['References', 'Notes', 'Sources', 'Footnotes', 'External links'])}</h2>", 0)
            n = self.r.randint(1, 6)
            self.put("<ol>" + "".join(f'<li><a href="#r{i}">{self.r.choice(["^", "[1]", self.word()])}</a> {self.chatter(1, 4) if self.r.random() < 0.5 else self.prose(2, 12)}</li>' for i in range(n)) + "</ol>", *[0] * n)
        elif kind == "letter":
            self.put(f"<{(h := self.r.choice(['p', 'h3', 'div']))}>{self.r.choice(['Get', 'Sign up for', 'Subscribe to', 'Never miss'])} {self.chatter(2, 9)}</{h}>", 0)
            if self.r.random() < 0.6:
                self.put(f"<form><input type=email><button>{self.r.choice(['Subscribe', 'Sign up', 'Submit', self.chatter(1, 2)])}</button></form>", 0)
        elif kind == "said":
            self.put(f"<h2>{self.r.choice([f'{self.r.randint(1, 90)} comments', 'Comments', 'Discussion', f'{self.r.randint(1, 9)} replies', 'What readers say'])}</h2>", 0)
            for _ in range(self.r.randint(1, 4)):
                self.put(f"<div{self.neutral()}>")
                if self.r.random() < 0.6:
                    self.put(f"<span{self.neutral()}>{self.word().capitalize()} · {self.r.randint(1, 59)} {self.r.choice(['min', 'h', 'days'])} ago</span><br>", 0)
                self.put(f"<p>{self.prose(3, 40)}</p>", 0)
                if self.r.random() < 0.6:
                    self.put(f"<div><a href=#>{self.r.choice(['Reply', 'Like', 'Share'])}</a></div>", 0)
                self.put("</div>")
        elif kind == "form":
            self.put(f"<label>{self.chatter(1, 3)}</label><input name=q>", 0)
            self.put(f"<button>{self.chatter(1, 2)}</button>", 0)
        elif self.r.random() < 0.5:
            self.put(self.some(), 0)
        else:
            self.put(f"<p>{self.some()}</p>", 0)
        self.put(b)

    def article(self) -> None:
        tag = self.r.choice(["article", "article", "main", "", ""] if self.hashed else ["article", "article", "main", ""])
        outside = self.r.random() < 0.2
        if outside:  # the title stands before the element of the text
            around = self.r.choice(["", "", "header", "div"])
            self.put((f"<{around}{self.neutral()}>" if around else "") + f"<h1{self.neutral() if self.r.random() < 0.5 else ''}>{self.prose(1, 9)}</h1>" + (f"</{around}>" if around else ""), 1)
        a, b = (f"<{tag}{self.attribute('main') if self.r.random() < 0.3 else ''}>", f"</{tag}>") if tag else (f"<div{self.attribute('main')}>", "</div>")
        outer = self.r.random() < 0.2 and tag == "article"
        self.put(("<main>" if outer else "") + a)
        if not outside and self.r.random() < 0.85:
            head = self.r.random() < 0.15
            self.put("<header>" * head + f"<h1{self.attribute('main') if self.r.random() < 0.2 else ''}>{self.prose(2, 9)}</h1>" + "</header>" * head, 1)
        inner = self.r.random() < 0.4
        if inner:
            self.put(f"<div{self.attribute('main') if self.r.random() < 0.7 else self.neutral()}>")
        if self.r.random() < 0.15:
            self.part("toc")
        loose, section = self.r.random() < 0.3, False
        sections = self.r.random() < 0.2
        for _ in range(self.r.randint(1, 14)):
            if sections and self.r.random() < 0.3:
                self.put("</section>" * section + f"<section{self.neutral() if self.r.random() < 0.3 else ''}>")
                section = True
            kind = self.r.random()
            if kind < 0.68:
                # a named article may say anything, even what menus and footers say
                text = self.prose(1, 90) if self.hashed or self.r.random() < 0.88 else self.chatter(1, 6) + self.r.choice([".", "", "."])
                if self.r.random() < 0.2:
                    text += f' <a href="/{self.word()}">{self.word()}</a> <em>{self.prose(1, 6)}</em>'
                self.put(f"<p>{text}" + ("" if loose and self.r.random() < 0.5 else "</p>"), 1)
            elif kind < 0.76:
                self.put(f"<p><b>{self.prose(1, 30)}<br>", 1)
            elif kind < 0.82:
                h = self.r.choice(["h2", "h2", "h3", "h4"])
                self.put(f"<{h}>{self.prose(1, 6)}</{h}>", 1)
            elif kind < 0.86:
                n = self.r.randint(2, 5)
                self.put("<ul>" + "".join(f"<li>{self.prose(1, 12)}</li>" for _ in range(n)) + "</ul>", *[1] * n)
            elif kind < 0.89:
                self.put(f"<blockquote>{self.prose(3, 30)}</blockquote>", 1)
            elif kind < 0.92:
                head = self.r.random() < 0.6
                rows = self.r.randint(1, 4)
                cell = lambda: self.prose(1, 6) if self.r.random() < 0.5 else f"{self.r.randint(1, 3000)}" if self.r.random() < 0.5 else self.word()
                top = f"<tr><th>{cell()}</th><th>{cell()}</th></tr>" if head else ""
                self.put(f"<table{self.r.choice(['', '', ' class=wikitable', ' class=table'])}>" + top + "".join(f"<tr><td>{cell()}</td><td>{cell()}</td></tr>" for _ in range(rows)) + "</table>", *[1] * (2 * rows + 2 * head))
            elif kind < 0.93:
                self.put(f"<pre>{self.prose(2, 20)}</pre>", 1)
            elif kind < 0.94:
                self.put(f"<figure><img src=a.png><figcaption>{self.prose(1, 9)}</figcaption></figure>", 1)
            else:
                self.part(self.r.choice(["ad", "ad", "aside", "share", "notice", "form", "letter", "letter"]))
        self.put("</section>" * section)
        if self.r.random() < 0.1:
            self.part("references")
        self.put("</div>" if inner else "")
        if self.r.random() < 0.2:
            self.part(self.r.choice(["comments", "said"]))
        self.put(b + ("</main>" if outer else ""))

    def page(self) -> tuple[str, list[int]]:
        """(html, label of each block in order)."""
        self.parts, self.labels = [], []
        self.hashed = self.r.random() < 0.25
        self.put(f"<!DOCTYPE html><html><head><title>{self.prose(1, 6)}</title><style>p{{}}</style></head><body{self.neutral()}>")

        def some(*chances: tuple[str, float]) -> None:
            for kind, chance in chances:
                if self.r.random() < chance:
                    self.wrapped(lambda kind=kind: self.part(kind), 2)

        def middle() -> None:
            some(("aside", 0.15))
            self.wrapped(self.article, 3)
            some(("share", 0.15), ("ad", 0.25), ("comments", 0.25), ("said", 0.15), ("letter", 0.1), ("aside", 0.35), ("form", 0.15))

        def whole() -> None:
            some(("notice", 0.2), ("header", 0.4), ("nav", 0.8), ("ad", 0.5), ("form", 0.15))
            if self.r.random() < 0.04:
                for _ in range(self.r.randint(1, 5)):
                    self.put(f"<p>{self.prose(2, 60)}</p>", 1)
            else:
                self.wrapped(middle, 2)
            some(("nav", 0.15), ("notice", 0.15), ("footer", 0.85))

        self.wrapped(whole, 2)
        self.put("" if self.r.random() < 0.1 else "</body></html>")
        return "".join(self.parts), self.labels
