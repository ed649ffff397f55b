"""Made-up pages whose main text is known, to train the page classifier on.

Layouts are drawn at random: with and without telling tags and class names, well-formed and not, with
menus, notices, adverts, sidebars, forms, reader comments and footers in and around the article. Words
are made of random syllables, so that nothing but structure can be learned.
"""

from __future__ import annotations

from random import Random

SYLLABLES = "an en er in on re st th ti es or ing ent ion un de la que le os ar ie ch au be ei"
NAMES = {
    "content": "content post entry article story main body text single page".split(),
    "nav": "nav menu navbar navigation breadcrumb links topbar tabs".split(),
    "header": "header masthead top banner branding site-header".split(),
    "footer": "footer bottom copyright legal colophon site-footer".split(),
    "sidebar": "sidebar widget related recent popular rail aside secondary".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsbygoogle".split(),
    "notice": "cookie notice consent gdpr alert newsletter subscribe popup banner message modal".split(),
    "comments": "comments comment discussion replies disqus respond reader-comments feedback".split(),
    "share": "share social sharing buttons follow".split(),
    "form": "search login contact signup form subscribe".split(),
}


#: Share of pages that are an article without a frame.
BARE = 0.2


class Maker:
    def __init__(self, seed: int):
        self.r = Random(seed)
        self.syllables = SYLLABLES.split()
        self.telling = self.r.random() < 0.75

    def words(self, a: int, b: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(self.syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(a, b)))

    def sentence(self) -> str:
        words = self.words(4, 18)
        if self.r.random() < 0.4:
            words = words.replace(" ", ", ", 1)
        return words.capitalize() + "."

    def prose(self, a: int, b: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(a, b)))

    def named(self, kind: str, tags: str) -> tuple[str, str]:
        """Opening and closing tag; with a telling name or tag, mostly."""
        r = self.r
        tag = r.choice(tags.split())
        shown = self.telling or kind not in ("content", "sidebar")
        name = f' {r.choice(["class", "class", "id"])}="{r.choice(NAMES[kind])}"' if (tag == "div" and shown) or r.random() < 0.4 else ""
        return f"<{tag}{name}>", f"</{tag}>"

    def inside(self, kind: str, tags: str, html: str) -> str:
        a, b = self.named(kind, tags)
        return a + html + b

    def links(self, a: int, b: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.r.randint(a, b))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if self.r.random() < 0.7 else " | ".join(items)

    def form(self) -> str:
        return self.inside("form", "form", f"<label>{self.words(1, 3)}</label><input type=text><button>{self.words(1, 2)}</button>")

    def ad(self) -> str:
        return self.inside("ad", "div div aside", self.r.choice([self.prose(1, 2), self.words(2, 8), f'<a href="/x">{self.words(3, 8)}</a>', f"<p>{self.prose(1, 2)}</p>"]))

    def notice(self) -> str:
        return self.inside("notice", "div div section", f"<p>{self.prose(1, 2)}</p><button>{self.words(1, 2)}</button>" if self.r.random() < 0.6 else self.prose(1, 2))

    def share(self) -> str:
        return self.inside("share", "div ul", "".join(f'<a href="#">{self.words(1, 2)}</a>' for _ in range(self.r.randint(2, 5))))

    def comments(self) -> str:
        r = self.r
        one = lambda: r.choice([f"<p>{self.prose(1, 4)}</p>", f"<div><b>{self.words(1, 2)}</b><p>{self.prose(1, 3)}</p></div>"])
        body = "".join(f"<li>{one()}</li>" if r.random() < 0.4 else one() for _ in range(r.randint(1, 6)))
        head = f"<h{r.choice('234')}>{self.words(1, 3)}</h3>" if r.random() < 0.6 else ""
        return self.inside("comments", "div div section", head + body + (self.form() if r.random() < 0.4 else ""))

    def sidebar(self) -> str:
        head = f"<h3>{self.words(1, 3)}</h3>"
        return self.inside("sidebar", "aside div", head + self.r.choice([self.links(3, 8), f"<p>{self.prose(1, 2)}</p>" + self.links(2, 4)]))

    def paragraph(self) -> str:
        r = self.r
        text = self.prose(1, 7) if r.random() < 0.85 else self.words(1, 6)
        if r.random() < 0.3:
            x = text.split(" ")
            k = r.randrange(len(x))
            x[k] = r.choice([f'<a href="/{k}">{x[k]}</a>', f"<b>{x[k]}</b>", f"<em>{x[k]}</em>", f"<span>{x[k]}</span>"])
            text = " ".join(x)
        shape = r.random()
        if shape < 0.12:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if shape < 0.9 else f"<p>{text}"

    def article(self) -> str:
        """Content, in which marks \\x02 and \\x03 stand around what doesn't belong to it."""
        r = self.r
        parts = [f"<h1>{self.words(2, 9)}</h1>"] if r.random() < 0.85 else []
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12, 20])):
            k = r.random()
            if k < 0.66:
                parts.append(self.paragraph())
            elif k < 0.74:
                parts.append(f"<h{r.choice('23')}>{self.words(1, 6)}</h2>")
            elif k < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self.words(3, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.84:
                parts.append(f"<blockquote>{self.paragraph()}</blockquote>")
            elif k < 0.87:
                parts.append("<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif k < 0.89:
                parts.append(f'<figure><img src="/i.png"><figcaption>{self.words(3, 9)}</figcaption></figure>')
            else:
                parts.append("\x02" + r.choice([self.ad, self.share, self.form, self.notice])() + "\x03")
        if r.random() < 0.15:
            parts.append("\x02" + r.choice([self.comments, self.share, self.sidebar])() + "\x03")
        body = "".join(parts)
        if r.random() < 0.25:
            body = self.inside("content", "div section", body)
        return self.inside("content", "article article main div div section", body)

    def bare(self) -> str:
        """An article without a frame: one to five blocks, or text and nothing else."""
        r = self.r
        one = lambda: r.choice([
            f"<p>{self.prose(1, 5)}</p>", f"<p>{self.prose(1, 5)}</p>", self.paragraph(), f"<div>{self.prose(1, 4)}</div>", f"<h{r.choice('123')}>{self.words(1, 6)}</h2>",
            "<ul>" + "".join(f"<li>{self.words(3, 14)}</li>" for _ in range(r.randint(1, 6))) + "</ul>",
            "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 8)}</td></tr>" for _ in range(r.randint(1, 4))) + "</table>",
        ])
        kind = r.random()
        body = self.prose(1, 6) if kind < 0.15 else one() if kind < 0.45 else "".join(f"<p>{self.prose(1, 5)}</p>" for _ in range(r.randint(1, 5))) if kind < 0.7 else "".join(one() for _ in range(r.randint(2, 5)))
        around = r.choice([("", ""), ("", ""), ("<body>", ""), ("<html><body>", "</body></html>"), (f"<html><head><title>{self.words(1, 4)}</title></head><body>", "</body></html>")])
        return around[0] + "\x01" + body + "\x04" + around[1]

    def page(self) -> str:
        """A page, in which marks \\x01 and \\x04 stand around the article."""
        r = self.r
        if r.random() < BARE:
            return self.bare()
        some = lambda p, make: make() if r.random() < p else ""
        nav = lambda: self.inside("nav", "nav nav div", self.links(3, 10))
        top = self.inside("header", "header div", f'<a href="/">{self.words(1, 3)}</a>' + some(0.6, nav) + some(0.3, self.form)) if r.random() < 0.6 else some(0.8, nav)
        middle = "\x01" + self.article() + "\x04"
        before, after = some(0.25, self.sidebar) + some(0.3, self.ad), some(0.35, self.sidebar) + some(0.35, self.comments) + some(0.2, self.ad)
        if r.random() < 0.4:
            middle = f"<div>{before}{middle}{after}</div>" if r.random() < 0.5 else f'<main>{before}{middle}{after}</main>'
            before = after = ""
        foot = self.inside("footer", "footer footer div", r.choice([f"&copy; {self.words(2, 8)}", f"<p>{self.prose(1, 2)}</p>", self.links(2, 6) + self.words(2, 5)])) if r.random() < 0.9 else ""
        end = "</body></html>" if r.random() < 0.8 else ""
        body = f"{some(0.3, self.notice)}{top}{some(0.3, self.ad)}{before}{middle}{after}{some(0.15, self.notice)}{foot}"
        whole = r.random()
        if whole < 0.2:  # a piece of a page
            return body if whole < 0.1 else f"<body>{body}"
        for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
            body = f"<div>{body}</div>"
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{}}</style></head><body>{body}{end}"


MARKS = str.maketrans("", "", "\x01\x02\x03\x04")


def labelled(seed: int) -> tuple[str, list[tuple[int, int, bool]]]:
    """A page, and its text ranges (start, end, in the article)."""
    source, at, ranges, inside, cut, start = Maker(seed).page(), 0, [], False, 0, 0
    for c in source:
        if c in "\x01\x02\x03\x04":
            ranges.append((start, at, inside and not cut))
            start = at
            inside = inside and c != "\x04" or c == "\x01"
            cut += (c == "\x02") - (c == "\x03")
        else:
            at += 1
    ranges.append((start, at, inside and not cut))
    return source.translate(MARKS), ranges
