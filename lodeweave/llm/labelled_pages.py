"""Labelled pages for training: invented pages whose main blocks are known.

Templates vary in the tags and class names of the article and of what
surrounds it, in the order of both, and in the text they hold.  The text is
invented from syllables, so a model can learn no words from it beyond those
that pages put on buttons and in notices.
"""

from __future__ import annotations

import random

_SYLLABLES = "an er in on re th en ti es or te at ed ar st al le ou ve ra co de la mo su pre ion ment ing ly qué üb ßé но про".split()
_MENU = "Home About Contact News Blog Archive Products Services Help Search Login Sign-up Account Shop FAQ Jobs Team Press".split()
_NOTICE = [
    "We use cookies to improve your experience.", "Accept all", "Please enable JavaScript.", "Subscribe to our newsletter!", "This site uses cookies.",
    "Sign up for free updates", "You have 3 free articles left.",
]
_FOOT = ["All rights reserved.", "Privacy policy", "Terms of use", "Imprint", "Powered by", "Copyright", "Back to top", "Follow us"]
_ADS = ["Buy now and save 50%!", "Sponsored", "Advertisement", "Limited offer", "Click here to win", "Best deals today"]

#: Share of pages whose article has no element of its own around it, and of pages that are an article and nothing else.
BARE, ALONE = 0.15, 0.08
#: Ways to wrap the article: opening and closing markup.
_MAIN = [
    ("<article>", "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div id="content">', "</div>"),
    ('<div class="post-content">', "</div>"), ('<div class="entry">', "</div>"), ('<section class="story-body">', "</section>"),
    ('<div class="article-text">', "</div>"), ('<div class="page"><div class="main">', "</div></div>"), ('<article class="post">', "</article>"),
    ('<div class="container"><article>', "</article></div>"), ('<div role="main">', "</div>"),
]
_MENUS = [
    "<nav>{}</nav>", '<div class="menu">{}</div>', '<ul class="nav">{}</ul>', '<div id="navigation">{}</div>', "<header><nav>{}</nav></header>",
    '<div class="breadcrumbs">{}</div>', '<div class="topbar">{}</div>', '<nav role="navigation">{}</nav>',
]
_SIDES = [
    "<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar-right">{}</div>', '<div class="related">{}</div>', '<div class="widget">{}</div>',
    '<section class="recommended">{}</section>', '<aside class="side">{}</aside>',
]
_ADVERTS = ['<div class="ad">{}</div>', '<div class="ads">{}</div>', '<div class="advert">{}</div>', '<div class="sponsored">{}</div>', '<div class="promo">{}</div>',
            '<div id="banner-ad">{}</div>', '<aside class="ad">{}</aside>']
_NOTICES = ['<div class="cookie-notice">{}</div>', '<div class="banner">{}</div>', '<div id="consent">{}</div>', '<div class="newsletter">{}</div>', '<div class="notice">{}</div>',
            '<div class="alert">{}</div>', '<div role="alert">{}</div>', '<div class="popup">{}</div>', '<div class="subscribe">{}</div>']
_COMMENTS = ['<div class="comments">{}</div>', '<section id="comments">{}</section>', '<ol class="comment-list">{}</ol>', '<div class="comment">{}</div>',
             '<div class="discussion">{}</div>', '<section class="comments">{}</section>']
_FOOTS = ["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="footer">{}</div>', '<footer class="site-footer">{}</footer>']
_HEADS = ["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<header class="site-header">{}</header>']
_FORMS = ["<form>{}</form>", '<form class="search">{}</form>', '<form id="login">{}</form>']


class _Writer:
    def __init__(self, rng: random.Random):
        self.rng, self.parts, self.labels = rng, [], []

    def word(self) -> str:
        return "".join(self.rng.choices(_SYLLABLES, k=self.rng.choice((1, 2, 2, 3, 4))))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(low, high)))

    def prose(self, low: int = 3, high: int = 60) -> str:
        left, out = self.rng.randint(low, high), []
        mark = self.rng.choice(("", "", "", "", "!!", "***", "&amp;&amp;"))
        while left > 0:
            n = min(left, self.rng.randint(1, 16))
            out.append((self.words(n, n) + mark).capitalize() + self.rng.choice((".", ".", ".", ",", "", "?")))
            left -= n
        return " ".join(out)

    def block(self, markup: str, text: str, main: bool) -> str:
        self.labels.append(int(main))
        return markup.format(text)

    def menu(self) -> str:
        items = []
        for _ in range(self.rng.randint(2, 9)):
            name = self.rng.choice(_MENU) if self.rng.random() < 0.4 else self.word()
            items.append(self.block('<li><a href="/x">{}</a></li>', name, False))
        return self.rng.choice(_MENUS).format("<ul>" + "".join(items) + "</ul>")

    def boxed(self, wraps: list[str], texts: list[str], prose: float) -> str:
        inner = []
        for _ in range(self.rng.choice((1, 1, 2, 3))):
            text = self.prose(2, 25) if self.rng.random() < prose else self.rng.choice(texts)
            tag = self.rng.choice(("<p>{}</p>", "<div>{}</div>", '<p><a href="/y">{}</a></p>', "<h3>{}</h3>"))
            inner.append(self.block(tag, text, False))
        if len(inner) == 1 and self.rng.random() < 0.5:
            self.labels.pop()
            return self.block(self.rng.choice(wraps), self.prose(2, 25) if self.rng.random() < prose else self.rng.choice(texts), False)
        return self.rng.choice(wraps).format("".join(inner))

    def article(self) -> str:
        opening, closing = ("", "") if self.rng.random() < BARE else self.rng.choice(_MAIN)
        out = [opening]
        if self.rng.random() < 0.85:
            out.append(self.block(self.rng.choice(("<h1>{}</h1>", "<h2>{}</h2>", "<h1 class=\"title\">{}</h1>")), self.prose(2, 10), True))
        for _ in range(self.rng.randint(1, 12)):
            kind = self.rng.random()
            if kind < 0.66:
                out.append(self.block(self.rng.choice(("<p>{}</p>",) * 5 + ("<p><b>{}</b></p>", "<p>{}", "<div>{}</div>")), self.prose(1, 90), True))
            elif kind < 0.74:
                out.append(self.block("<h2>{}</h2>", self.prose(1, 8), True))
            elif kind < 0.82:
                out.append("<ul>" + "".join(self.block("<li>{}</li>", self.prose(2, 20), True) for _ in range(self.rng.randint(1, 5))) + "</ul>")
            elif kind < 0.88:
                out.append(self.block("<blockquote>{}</blockquote>", self.prose(4, 30), True))
            elif kind < 0.92:
                out.append("<table><tr>" + "".join(self.block("<td>{}</td>", self.words(1, 3), True) for _ in range(3)) + "</tr></table>")
            elif kind < 0.95:
                out.append(self.block('<p>{} <a href="/z">here</a>.</p>', self.prose(3, 20), True))
            elif kind < 0.98:
                out.append(self.boxed(_ADVERTS, _ADS, 0.6))
            else:
                out.append(self.boxed(_NOTICES, _NOTICE, 0.4))
        if self.rng.random() < 0.1:
            out.append(self.boxed(_COMMENTS, ["Great post!", "Thanks", "I disagree."], 0.8))
        return "".join([*out, closing])


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """(html, label of each leaf block in page order); 1 is main text."""
    rng = random.Random(seed)
    w = _Writer(rng)
    if rng.random() < ALONE:
        body = w.block("{}", w.prose(3, 60), True) if rng.random() < 0.3 else w.article()
        return rng.choice(("{}", "<body>{}</body>", "<html><body>{}</body></html>")).format(body), w.labels
    parts = ["<!DOCTYPE html><html><head><title>", w.prose(2, 9), "</title><style>p{margin:0}</style><script>var a='<p>';</script></head><body>"]
    if rng.random() < 0.3:
        parts.append(w.boxed(_NOTICES, _NOTICE, 0.3))
    if rng.random() < 0.4:
        parts.append(w.boxed(_HEADS, ["My site", "The daily page", "Welcome"], 0.4))
    if rng.random() < 0.9:
        parts.append(w.menu())
    before = [w.boxed(wraps, texts, p) for wraps, texts, p, often in ((_ADVERTS, _ADS, 0.7, 0.5), (_SIDES, _MENU, 0.7, 0.25), (_FORMS, ["Search", "Your e-mail"], 0.1, 0.15)) if rng.random() < often]
    parts += before
    parts.append(w.article())
    for wraps, texts, p, often in (
        (_COMMENTS, ["Great post!", "Thanks for this", "First!"], 0.85, 0.35), (_SIDES, _MENU, 0.7, 0.3), (_ADVERTS, _ADS, 0.7, 0.25),
        (_FORMS, ["Send", "Your name", "Leave a reply"], 0.1, 0.2), (_NOTICES, _NOTICE, 0.3, 0.15),
    ):
        if rng.random() < often:
            parts.append(w.boxed(wraps, texts, p))
    if rng.random() < 0.2:
        parts.append(w.menu())
    if rng.random() < 0.85:
        text = rng.choice(_FOOT) if rng.random() < 0.5 else "&copy; " + w.word() + ".example.com &middot; " + w.prose(2, 14)
        parts.append(w.block(rng.choice(_FOOTS), text, False))
    parts.append("</body></html>" if rng.random() < 0.9 else "")
    return "".join(parts), w.labels


def labelled_pages(count: int, seed: int = 1) -> list[tuple[str, list[int]]]:
    return [labelled_page(seed * 1_000_003 + k) for k in range(count)]
