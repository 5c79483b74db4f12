"""A grammar of page layouts with known labels, on which the block labeller is trained."""

from __future__ import annotations

import random

from quarrystone.llm.html_blocks import leaf_blocks

_SYLLABLES = "an be ci de er fo ga hi in jo ka le mi no os pra qua re so ti un ve wo xi ya zu éa öß ñi ão 中文 日本".split()
_MENU = "home about contact news login register search help shop archive next previous subscribe english more top start".split()
#: Class and id names by what they hold.
_NAMES = {
    "main": "content post entry article story text body main post-content entry-content article-body page-content story-body content-main single markdown articlebody",
    "nav": "menu navbar nav navigation topnav main-menu breadcrumb breadcrumbs nav-links tabs toc pagination",
    "header": "header site-header masthead topbar banner-top branding logo page-header banner",
    "footer": "footer site-footer bottom copyright colophon page-footer legal contentinfo",
    "side": "sidebar side widget related related-posts recommended trending popular aside right-rail tags more-stories complementary",
    "ad": "ad ads advert advertisement sponsored promo banner promotion ad-slot sponsor",
    "notice": "cookie cookie-notice consent notice alert gdpr cookie-banner newsletter popup modal overlay paywall subscribe disclaimer warning message",
    "form": "search login-form signup contact-form subscribe-form form search-box",
    "comments": "comments comment-list comment reply replies discussion responses disqus user-comment reader-comments",
    "share": "share social social-share share-buttons follow byline-tools toolbar meta-tools",
}
#: Of elements round the whole page, its upper part or its article.
_WRAPPERS = "wrap wrapper container page site row col column inner outer layout app root grid main-wrapper content-wrapper site-content page-wrap main content body".split()
#: Every word of a name or tag that the labeller knows by itself; all others are one.
KNOWN = sorted({w for names in (*_NAMES.values(), " ".join(_WRAPPERS)) for n in names.split() for w in n.split("-")} | {"hidden"})
#: Frequent words of four languages, as a general sample of running text.
_COMMON = (
    "the of and to in is was for with on that it as at by from this be are have not had which their they one were all there been more "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont "
    "el y los del las por con para su al lo como más pero sus fue este ha si porque esta son entre cuando"
).split()
_PHRASES = {
    "footer": ["© {w} {w}", "&copy; 2021 {w} {w}. All rights reserved.", "Privacy policy", "Terms of {w}", "{s}", "&copy; {w}.example.com &middot; {s}"],
    "notice": ["We use cookies to {w} {w} {w}.", "Accept all cookies", "Sign up for our newsletter {w}!", "Please enable {w} {w}.", "{s}", "This site uses {w}. {s}"],
    "ad": ["Advertisement", "Sponsored: {s}", "Buy {w} {w} now!", "{s}", "{s} {s}", "50% off {w}"],
    "comments": ["{w} says: {s}", "Great {w}! {s}", "{s} {s}", "Reply", "{n} comments", "{w} {w}, 3 days ago", "{s}"],
    "side": ["Related articles", "Most read", "{t}", "{s}", "Tags: {w}, {w}", "About the author {s}"],
    "share": ["Share on {w}", "Follow us", "Tweet", "Print", "{n} shares"],
    "header": ["{w} {w}", "{t}", "{w} News", "The {w} Times", "{s}"],
    "form": ["Search", "Your e-mail", "Name", "Submit", "Password {w}", "{s}"],
}


class Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.main: list[str] = []
        self.common = self.r.choice([0.0, 0.3, 0.6])

    def word(self) -> str:
        if self.r.random() < self.common:
            return self.r.choice(_COMMON)
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 5)))

    def sentence(self, low: int = 2, high: int = 18) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high))).capitalize() + self.r.choice([".", ".", ".", "!", "?"])

    def title(self) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(1, 9))).capitalize() + self.r.choice(["", "", "."])

    def phrase(self, kind: str) -> str:
        held = self.r.choice(_PHRASES[kind])
        while "{" in held:
            held = held.replace("{w}", self.word(), 1).replace("{s}", self.sentence(), 1).replace("{t}", self.title(), 1).replace("{n}", str(self.r.randint(1, 99)), 1)
        return held

    def attributes(self, kind: str, chance: float = 1.0) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(_NAMES[kind].split())
        if self.r.random() < 0.25:  # a name that tells nothing
            name = self.unknown()
        elif self.r.random() < 0.15:
            name += " " + self.unknown()
        return f' {self.r.choice(["class", "class", "id"])}="{name}"'

    def unknown(self) -> str:
        return self.r.choice(["c-", "css-", "x", "b_", ""]) + "".join(self.r.choice("abcdefghikmnoprstuvwz0123456789") for _ in range(self.r.randint(2, 7)))

    def wrapped(self, html: str, most: int) -> str:
        """``html`` in up to ``most`` elements that hold no text of their own."""
        for _ in range(self.r.randint(0, most)):
            name = self.r.choice(_WRAPPERS) if self.r.random() < 0.6 else self.unknown()
            attributes = "" if self.r.random() < 0.2 else f' {self.r.choice(["class", "class", "id"])}="{name}"'
            tag = self.r.choice(["div", "div", "div", "div", "section", "main"])
            html = f"<{tag}{attributes}>{html}</{tag}>"
        return html

    def links(self, low: int, high: int) -> str:
        each = [f'<a href="/{i}">{self.r.choice(_MENU).title() if self.r.random() < 0.4 else self.word()}</a>' for i in range(self.r.randint(low, high))]
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>"
        return self.r.choice([" ", " | ", "</div><div>"]).join(each)

    def boiler(self, kind: str) -> str:
        r, tags = self.r, {"nav": ["nav", "nav", "div", "ul"], "header": ["header", "header", "div"], "footer": ["footer", "footer", "div"], "side": ["aside", "aside", "div", "section"], "form": ["form", "form", "div"], "comments": ["section", "div", "div", "ol"]}
        tag = r.choice(tags.get(kind, ["div", "div", "section", "p"]))
        plain = {"nav", "header", "footer", "aside", "form"}
        attributes = self.attributes(kind, 0.4 if tag in plain else 1.0)
        if kind == "nav":
            inner = self.links(2, 9)
        elif kind == "comments":
            inner = "".join(f"<{t}{self.attributes(kind, 0.5)}><p>{self.phrase(kind)}</p></{t}>" for t in r.choices(["div", "div", "article", "li"], k=r.randint(1, 6)))
            inner = r.choice(["", "<h3>Comments</h3>", f"<h2>{r.randint(1, 90)} comments</h2>"]) + inner
        elif kind == "form":
            inner = "".join(r.choice([f"<label>{self.phrase(kind)}</label><input name=x>", f"<button>{self.phrase(kind)}</button>", f"<p>{self.phrase(kind)}</p>"]) for _ in range(r.randint(1, 4)))
        else:
            inner = "".join(r.choice([f"<p>{self.phrase(kind)}</p>", self.phrase(kind), f"<div>{self.phrase(kind)}</div>", f"<h3>{self.phrase(kind)}</h3>"]) for _ in range(r.choice([1, 1, 1, 2, 3])))
            if kind in ("footer", "header", "side") and r.random() < 0.4:
                inner += self.links(1, 5)
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def keep(self, text: str) -> str:
        self.main.append(text)
        return text

    def body_text(self) -> str:
        kind = self.r.random()
        if kind < 0.25:
            return self.keep(self.sentence(1, 4))
        if kind < 0.33:  # lists run together, and text full of signs
            words = [self.word() for _ in range(self.r.randint(2, 30))]
            if kind < 0.28:
                return self.keep(self.r.choice([" | ", " · ", ", ", " > "]).join(words))
            return self.keep(" ".join(w + self.r.choice(["", *"%$#*~^="]) * self.r.randint(1, 4) for w in words))
        return self.keep(" ".join(self.sentence() for _ in range(self.r.choice([1, 1, 2, 3, 5, 9]))))

    def part(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.72:
            text = self.body_text()
            if r.random() < 0.15:
                return f"<p><b>{text}<br>"
            if r.random() < 0.15:
                cut = text.find(" ")
                if cut > 0:
                    return f'<p>{text[:cut]} <a href="/x">{text[cut + 1:]}</a></p>'
            return f"<p>{text}</p>"
        if kind < 0.82:
            return f"<h{(n := r.randint(2, 4))}>{self.keep(self.title())}</h{n}>"
        if kind < 0.9:
            return "<ul>" + "".join(f"<li>{self.body_text()}</li>" for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote>{self.body_text()}</blockquote>"
        if kind < 0.97:
            return f"<table><tr><th>{self.keep(self.title())}</th><td>{self.body_text()}</td></tr></table>"
        return r.choice([f"<div>{self.body_text()}</div>", f"<pre>{self.body_text()}</pre>", f"<figure><img src=x><figcaption>{self.body_text()}</figcaption></figure>"])

    def article(self) -> str:
        r = self.r
        inner = [f"<h1>{self.keep(self.title())}</h1>"] if r.random() < 0.85 else []
        if inner and r.random() < 0.1:
            inner = [f"<header>{inner[0]}</header>"]
        n = r.choice([0, 1, 1, 1, 2, 2, 3, 4, 6, 10, 18])
        for _ in range(n):
            inner.append(self.part())
            if r.random() < 0.04:
                inner.append(f"<p>{self.keep(self.sentence(1, 4))}</p>" * r.choice([2, 3, 6, 12, 25]))
            if r.random() < 0.07:
                inner.append(self.boiler(r.choice(["ad", "ad", "side", "share", "form", "notice"])))
        if r.random() < 0.08:
            inner.append(self.boiler("comments"))
        while r.random() < 0.25:
            inner.append(f"<p>{self.keep(self.sentence(1, 4))}</p>")
        tag = r.choice(["article", "article", "article", "main", "div", "div", "section"])
        out = f"<{tag}{self.attributes('main', 0.3 if tag in ('article', 'main') else 0.9)}>{''.join(inner)}</{tag}>"
        return f'<div{self.attributes("main", 0.5)}>{out}</div>' if r.random() < 0.2 else out

    def build(self) -> tuple[str, list[tuple], list[bool]]:
        r = self.r
        top = [self.boiler(k) for k in ("header", "nav", "notice", "ad", "form") if r.random() < (0.75 if k == "nav" else 0.45)]
        r.shuffle(top)
        middle = [self.article()]
        if r.random() < 0.4:
            middle.insert(r.randint(0, 1), self.boiler("side"))
        low = [self.boiler(k) for k in ("share", "comments", "ad", "side", "form", "notice") if r.random() < 0.25]
        r.shuffle(low)
        if r.random() < 0.85:
            low.append(self.boiler("footer"))
        if r.random() < 0.3:
            top = [self.wrapped(x, 2) for x in top]
        if r.random() < 0.4:
            middle = [self.wrapped("".join(middle), 2)]
        page = "".join(top) + "".join(middle) + "".join(low)
        if r.random() < 0.3:  # all but what comes first and last
            page = "".join(top[:1]) + self.wrapped("".join(top[1:]) + "".join(middle) + "".join(low[:-1]), 3) + "".join(low[-1:])
        if r.random() < 0.6:
            page = self.wrapped(page, 4)
        html = f"<!DOCTYPE html><html><head><title>x</title><script>var t='</p>';</script></head><body>{page}</body></html>"
        blocks = leaf_blocks(html)
        main = {" ".join(t.split()) for t in self.main}
        return html, blocks, [b[1] in main for b in blocks]


def labelled_pages(n: int, seed: int = 0) -> list[tuple[list[tuple], list[bool]]]:
    return [Page(seed * 1_000_003 + i).build()[1:] for i in range(n)]
