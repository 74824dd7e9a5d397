"""Made-up labelled pages, to train the content model on."""

from __future__ import annotations

import random
from html import escape

_SYLLABLES = "ka lo mi ru ten sar vo del pri an est ol qui ba no fe tur ix mo la".split()


def _words(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
    for k in range(len(words)):
        if r.random() < 0.1:
            words[k] += r.choice(",,,;.")
    return escape((" ".join(words)).capitalize() + r.choice(["", "", " & co"]))


def _text(r: random.Random, low: int, high: int) -> str:
    out = " ".join(_words(r, low, high).rstrip(",;.") + "." for _ in range(r.randint(1, 4)))
    if r.random() < 0.1:
        out = (out.split(" ")[0] + r.choice([" ", ", ", " | "])) * r.randint(3, 60)
    elif r.random() < 0.1:
        out = out.replace(".", "").replace(",", "")
    if r.random() < 0.15:
        out = out.replace(" ", f' <a href="/{r.randint(1, 99)}">see here</a> ', 1)
    if r.random() < 0.1:
        out = f"<b>{out}<br>"
    return out


def _attr(r: random.Random, names: str, chance: float = 0.8) -> str:
    name = r.choice(names.split())
    return f' {r.choice(["class", "id", "class"])}="{r.choice(["", "", "site-", "x1 "])}{name}"' if r.random() < chance else ""


def _in_table(r: random.Random, body: list[str], c: str) -> str:
    """An old page laid out by a table: a row on top, menus and adverts in cells beside the article, a row below."""
    plain = lambda n, between: between.join(f'<a href="/{k}">{_words(r, 1, 3)}</a>' for k in range(n))
    style = lambda: r.choice(["", " bgcolor=white", " width=120", " valign=top", " width=20%", " class=cell"])
    links = lambda: f"<td{style()}>{r.choice(['', '<b>' + _words(r, 1, 2) + '</b><br>'])}{plain(r.randint(1, 8), r.choice(['<br>', ' | ', '<br><br>']))}</td>"
    span = r.choice([" colspan=2", " colspan=3", ""])
    top = r.choice([f"<tr><td{span}><b>{_words(r, 1, 4)}</b></td></tr>", f"<tr><td{span}><img src=l.gif> <font size=4>{_words(r, 1, 4)}</font></td></tr>", f"<tr><td{span}>{plain(r.randint(2, 7), ' | ')}</td></tr>", ""])
    below = r.choice([f"<tr><td{span}><font size=1>&copy; {r.randint(1995, 2009)} {_words(r, 1, 6)}</font></td></tr>", f"<tr><td{span}>{plain(r.randint(2, 5), ' - ')}</td></tr>", ""])
    left, right = (links() if r.random() < p else "" for p in (0.8, 0.5))
    rows = f"{top}<tr{c}>{left}<td{style()}{c}>{''.join(body)}</td>{right}</tr>{below}"
    return f"<table{r.choice(['', ' width=100%', ' border=0 cellpadding=4'])}{c}>{r.choice(['', f'<tbody{c}>'])}{rows}</table>"


def labelled_page(r: random.Random) -> str:
    """HTML of one page.

    Every block of content, and the blocks around it, carries the attribute `data-c`, no other does.
    """
    links = lambda n: "".join(f'<li><a href="/{k}">{_words(r, 1, 3)}</a></li>' for k in range(n))
    c = " data-c"
    close_p = "</p>" if r.random() < 0.8 else ""
    menu = lambda: r.choice([f"<nav{_attr(r, 'menu nav main-nav', 0.4)}><ul>{links(r.randint(3, 9))}</ul></nav>", f"<div{_attr(r, 'menu navbar nav topnav', 1)}><ul>{links(r.randint(3, 9))}</ul></div>"])
    ad = lambda: f"<{(t := r.choice(['div', 'div', 'section', 'aside', 'p']))}{_attr(r, 'ad ads advert banner promo sponsored ad-box', 1)}>{_text(r, 2, 12)}</{t}>"
    notice = lambda: f"<div{_attr(r, 'cookie consent notice cookie-banner popup gdpr alert newsletter', 1)}><p>{_text(r, 3, 14)}</p><button>{_words(r, 1, 2)}</button></div>"
    form = lambda: f"<form{_attr(r, 'search login subscribe newsletter', 0.5)}><p>{_text(r, 2, 8)}</p><input name=q><button>{_words(r, 1, 1)}</button></form>"
    share = lambda: f"<div{_attr(r, 'share social related tags breadcrumb widget', 1)}><ul>{links(r.randint(2, 5))}</ul></div>"
    comments = lambda: f"<{(t := r.choice(['section', 'div', 'ol']))}{_attr(r, 'comments comment-list replies discussion responses', 1)}>" + "".join(f"<{(u := r.choice(['div', 'li', 'article']))}{_attr(r, 'comment reply comment-body', 0.9)}><p>{_text(r, 3, 25)}</p></{u}>" for _ in range(r.randint(1, 5))) + f"</{t}>"
    side = lambda: f"<{(t := r.choice(['aside', 'div']))}{_attr(r, 'sidebar side widget related aside', 1 if t == 'div' else 0.5)}><h3>{_words(r, 1, 4)}</h3><p>{_text(r, 2, 12)}</p><ul>{links(r.randint(0, 5))}</ul></{t}>"
    header = lambda: f"<{(t := r.choice(['header', 'header', 'div']))}{_attr(r, 'header masthead site-header topbar', 1 if t == 'div' else 0.5)}><{(h := r.choice(['h1', 'p', 'div', 'h2']))}>{_words(r, 1, 4)}</{h}>{menu() if r.random() < 0.5 else ''}</{t}>"
    footer = lambda: f"<{(t := r.choice(['footer', 'footer', 'div']))}{_attr(r, 'footer site-footer copyright bottom', 1 if t == 'div' else 0.3)}>{r.choice(['<p>', ''])}&copy; {_text(r, 2, 10)}</{t}>"

    def paragraph() -> str:
        kind = r.random()
        if kind < 0.78:
            return f"<p{c}>{_text(r, 1 if r.random() < 0.2 else 4, 30)}{close_p}"
        if kind < 0.84:
            return f"<h{(k := r.randint(2, 4))}{c}>{_words(r, 1, 8)}</h{k}>"
        if kind < 0.89:
            return f"<ul{c}>" + "".join(f"<li{c}>{_text(r, 3, 15)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if kind < 0.93:
            return f"<blockquote{c}><p{c}>{_text(r, 5, 25)}</p></blockquote>"
        if kind < 0.96:
            return f"<table{c}><tr{c}><td{c}>{_words(r, 1, 5)}</td><td{c}>{_words(r, 1, 5)}</td></tr></table>"
        return f"<div{c}>{_text(r, 6, 30)}</div>"

    body = [f"<h1{c}>{_words(r, 2, 12)}</h1>"] + [paragraph() for _ in range(r.choice([r.randint(1, 3), r.randint(1, 12), r.randint(1, 12), r.randint(10, 60)]))]
    for extra in (ad, share, form, notice, comments, side):
        if r.random() < 0.15:
            body.insert(r.randint(1, len(body)), close_p and extra() or "</p>" + extra())
    wrap, marks = r.choice([("article", ""), ("article", ""), ("article", _attr(r, "post entry story", 0.7)), ("main", ""), ("div", _attr(r, "content article post entry-content story article-body main", 1)), ("section", _attr(r, "content article post", 1)), ("div", "")])
    article = f"<{wrap}{marks}{c}>{''.join(body)}</{wrap}>"
    if r.random() < 0.3:
        article = f"<{(o := r.choice(['main', 'div', 'section']))}{_attr(r, 'container page wrapper content main', 0.7)}{c}>{article}</{o}>"
    before = [f() for f, p in ((header, 0.5), (menu, 0.8), (notice, 0.3), (ad, 0.5), (form, 0.2)) if r.random() < p]
    after = [f() for f, p in ((comments, 0.4), (side, 0.5), (ad, 0.3), (share, 0.3), (notice, 0.15), (form, 0.2)) if r.random() < p]
    r.shuffle(before)
    r.shuffle(after)
    whole = "".join(before) + article + "".join(after) + footer()
    if r.random() < 0.3:
        whole = f"<div{_attr(r, 'page wrapper root container site', 0.8)}{c}>{whole}</div>"
    if r.random() < 0.3:
        whole = _in_table(r, body, c)
    tail = "</body></html>" if r.random() < 0.9 else ""
    return f'<!DOCTYPE html><html><head><title>{_words(r, 2, 8)}</title><style>p{{margin:0}}</style></head><body{c}>' + whole + tail


def labelled_pages(n: int, seed: int = 5) -> list[str]:
    """n pages; blocks of content, and those around them, carry the attribute data-c."""
    r = random.Random(seed)
    return [labelled_page(r) for _ in range(n)]
