"""Labelled pages for the extraction model: layouts drawn by rule, each block element marked as content (c), boilerplate (b) or a
container of both (m) in a `data-l` attribute that the model never sees."""
from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wo xi zo".split()
#: Names that sites give to parts of a page.
_NAMES = {
    "nav": ["nav", "menu", "main-menu", "navbar", "breadcrumb", "topnav", "navigation"],
    "head": ["header", "site-header", "masthead", "top-bar", "branding"],
    "foot": ["footer", "site-footer", "copyright", "colophon", "legal"],
    "side": ["sidebar", "side", "aside", "widget", "related", "recommended", "rail"],
    "ad": ["ad", "ads", "advert", "sponsored", "promo", "banner", "ad-slot"],
    "notice": ["cookie", "notice", "cookie-banner", "consent", "alert", "gdpr", "disclaimer"],
    "form": ["form", "search", "newsletter", "subscribe", "login", "signup"],
    "comment": ["comments", "comment", "comment-list", "replies", "discussion", "respond"],
    "share": ["share", "social", "tags", "byline-tools", "toolbar"],
    "content": ["content", "article", "post", "entry-content", "main", "story", "article-body", "post-body", "text"],
}
_TAGS = {"nav": ["nav", "div", "ul"], "head": ["header", "div"], "foot": ["footer", "div"], "side": ["aside", "div", "section"], "ad": ["div", "aside", "section"],
         "notice": ["div", "section", "p"], "form": ["form", "div"], "comment": ["section", "div", "ol"], "share": ["div", "ul"], "content": ["article", "main", "div", "section"]}


def _words(r: random.Random, n: int) -> str:
    words = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(n)]
    return (" ".join(words).capitalize() + r.choice([".", ".", ".", "!", "", ","]))


def _prose(r: random.Random) -> str:
    text = _words(r, r.choice([1, 2, 4, 9, 15, 30, 60, 120]))
    return text if r.random() < 0.8 else f"{text} <a href='#'>{_words(r, 2)}</a> {_words(r, r.randint(2, 20))}"


def _open(r: random.Random, kind: str, label: str, tag: str | None = None) -> tuple[str, str]:
    tag = tag or r.choice(_TAGS[kind])
    plain = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "content": "article"}.get(kind)
    named = f' {r.choice(["class", "class", "id"])}="{r.choice(_NAMES[kind])}"' if tag != plain or r.random() < 0.4 else ""
    return f'<{tag}{named} data-l="{label}">', f"</{tag}>"


def _boilerplate(r: random.Random, kind: str) -> str:
    start, end = _open(r, kind, "b")
    if kind in ("nav", "share") or (kind in ("side", "foot") and r.random() < 0.5):
        items = "".join(f'<li data-l="b"><a href="#">{_words(r, r.randint(1, 5))}</a></li>' for _ in range(r.randint(2, 8)))
        inner = items if start.startswith("<ul") else f'<ul data-l="b">{items}</ul>'
    elif kind == "form":
        inner = f'<label data-l="b">{_words(r, 3)}</label><input name=q><button data-l="b">{_words(r, 1)}</button>'
    elif kind == "comment":
        one = lambda: f'<{"li" if start.startswith("<ol") else "div"} class="comment" data-l="b"><p data-l="b">{_words(r, r.randint(3, 40))}</p>'
        inner = "".join(one() for _ in range(r.randint(1, 4)))
    else:
        text = _words(r, r.choice([3, 6, 12, 25, 50]))
        inner = text if r.random() < 0.6 else f'<p data-l="b">{text}</p>'
        if kind in ("head", "side") and r.random() < 0.4:
            inner = f'<h2 data-l="b">{_words(r, 3)}</h2>' + inner
    return start + inner + end


def _content(r: random.Random) -> str:
    parts = [f'<h1 data-l="c">{_words(r, r.randint(2, 10))}</h1>'] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 9)):
        kind = r.random()
        if kind < 0.75:
            close = "</p>" if r.random() < 0.85 else "<br>"
            parts.append(f'<p data-l="c">{_prose(r)}{close}')
        elif kind < 0.82:
            parts.append(f'<h2 data-l="c">{_words(r, 4)}</h2>')
        elif kind < 0.88:
            parts.append('<ul data-l="c">' + "".join(f'<li data-l="c">{_prose(r)}</li>' for _ in range(r.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            parts.append(f'<blockquote data-l="c"><p data-l="c">{_prose(r)}</p></blockquote>')
        elif kind < 0.95:
            parts.append(f'<table data-l="c"><tr data-l="c"><td data-l="c">{_words(r, 3)}</td><td data-l="c">{_words(r, 2)}</td></tr></table>')
        else:
            parts.append(_boilerplate(r, r.choice(["ad", "share", "side"])))
    if r.random() < 0.1:
        parts.append(_boilerplate(r, "comment"))
    start, end = _open(r, "content", "c")
    inner = "".join(parts)
    if r.random() < 0.15:
        inner = f'<div data-l="c">{inner}</div>'
    return start + inner + end


def labelled_pages(n: int = 500, seed: int = 3) -> list[str]:
    r, pages = random.Random(seed), []
    for i in range(n):
        if i % 25 == 0:  # hardly any structure
            pages.append(f'<html data-l="m"><body data-l="m">' + "".join(f'<p data-l="c">{_prose(r)}</p>' for _ in range(r.randint(1, 6))) + "</body></html>")
            continue
        before = [_boilerplate(r, k) for k in ("notice", "head", "nav", "ad", "form", "share") if r.random() < 0.45]
        after = [_boilerplate(r, k) for k in ("side", "ad", "share", "comment", "comment", "form", "notice", "foot") if r.random() < 0.45]
        r.shuffle(before)
        body = "".join(before) + _content(r) + "".join(after)
        if r.random() < 0.3:
            body = f'<div{r.choice(["", " class=wrapper", " id=page", " class=container"])} data-l="m">{body}</div>'
        pages.append(f'<!DOCTYPE html><html data-l="m"><head data-l="b"><title>{_words(r, 5)}</title></head><body data-l="m">{body}</body></html>')
    return pages
