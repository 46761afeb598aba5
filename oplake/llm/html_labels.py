"""Labelled pages from which the extraction weights are learned: ``<!--[-->`` and ``<!--]-->``
enclose the main text.  All were written for this purpose: layouts, the names that sites give to
their blocks, and what stands in them, put together in many ways by a seeded choice."""

from __future__ import annotations

import random

#: Blocks beside the main text: names of class or id, an element, and what stands in it.
FURNITURE = [
    (["nav", "navbar", "main-nav", "top-nav", "topnav", "nav-menu", "site-nav", "subnav", "sidenav", "navigation", "menu", "main-menu", "submenu", "menu-links"], "ul", "links"),
    (["breadcrumb", "breadcrumbs", "pagination", "pager", "page-nav", "toolbar", "topbar", "skip-link", "tabs-nav"], "div", "links"),
    (["header", "site-header", "page-header", "masthead", "banner", "top-banner"], "div", "title"),
    (["footer", "site-footer", "page-footer", "foot", "colophon", "copyright", "legal-copyright"], "div", "small"),
    (["sidebar", "side-bar sidebar", "left-sidebar", "right-sidebar", "sidebars", "widget-area", "widget", "widgets sidebar", "complementary"], "div", "teasers"),
    (["ad", "ads", "ad-box", "ad-slot", "AdSlot", "top-ad", "advert", "adverts", "advertisement", "advertising", "adsbygoogle", "adsense", "sponsor", "sponsored", "sponsored-links", "promo", "promotion", "promo-box"], "div", "sell"),
    (["cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-consent", "consent", "gdpr", "notice", "notices", "site-notice", "notification", "alert", "popup", "modal", "overlay"], "div", "notice"),
    (["newsletter", "newsletter-signup", "newsletterSignup", "subscribe", "subscription", "signup", "login", "search", "search-form", "searchform", "site-search"], "div", "form"),
    (["share", "share-bar", "sharing", "social", "social-links", "social-share"], "div", "links"),
    (["related", "related-posts", "recommended", "recommendations", "trending", "more-trending", "read-next related"], "div", "teasers"),
    (["comments", "comment", "comment-list", "commentlist", "post-comments", "user-comments", "respond", "disqus", "disqus-thread", "replies", "reader-replies", "discussion"], "div", "replies"),
    (["hidden", "visually-hidden", "is-hidden"], "div", "small"),
]
#: What elements around the main text are called, layout flags that name furniture among them.
AROUND = ["content", "main-content", "page-content", "content-widget", "content widget", "post", "post has-sidebar", "post no-comments", "entry", "entry-content", "article", "article-body", "post-body", "story", "story-body", "text", "body-text", "has-sidebar content", "with-menu content", "no-sidebar", "without-ads story", "main", "main-column", "column", "container", "wrapper", "page", "blog-post", "news-article", "layout has-sidebar", "has-ads page", "no-comments post", "page with-sidebar", "results", "search-results-page content", "no-menu page", "has-banner wrapper", "with-footer page"]
#: What elements inside it are called.
WITHIN = ["lead", "intro", "entry-header", "post-header", "article-header", "story-header", "entry-title", "title", "post-title", "headline", "byline", "note", "quote", "figure", "caption", "gallery", "section", "section-text", "paragraph", "first", "dropcap", "summary", "abstract", "list", "search-results-list", "results-list", "steps", "hidden-gem", "social-history", "comment-on-text note", "ad-hoc", "menu-of-dishes text", "share-of-votes", "table", "example", "footnote", "footnotes", "box", "info"]

_NAMES = ["river", "bridge", "valley", "council", "walk", "garden", "harbour", "school", "market", "winter"]
_TEXT = [
    "It rained in the valley for most of the week and the river rose over the lower path, so the walkers had to take the longer way around the hill.",
    "The council met on Tuesday evening to hear the plan for the bridge. Several members asked what it would cost and who would pay for the repairs later.",
    "Nobody in the village could say who had planted the old apple trees behind the school, but every autumn somebody came to pick them.",
    "She had kept a record of the harbour's tides for forty years, in pencil, in notebooks that her grandson has now given to the library.",
    "The market opens at six. By eight the best of the fish is gone, and by noon the square is empty again and swept.",
    "A report on the winter's storms puts the damage lower than was feared: two roofs, a wall, and the small boats on the north side.",
]
_REPLIES = ["Lovely walk, I went there too last year.", "Which way did you go around? I could not find the path at all when we tried.", "Thank you for this, I did not know that about the harbour."]


def _links(rng: random.Random, tag: str = "ul") -> str:
    some = [f'<a href="/{n}">{n.title()}</a>' for n in rng.sample(_NAMES, rng.randrange(3, 8))]
    return "".join(f"<li>{a}</li>" for a in some) if tag == "ul" else rng.choice([" | ", " ", " &gt; ", "<br>"]).join(some)


def _inside(rng: random.Random, kind: str, tag: str) -> str:
    name = rng.choice(_NAMES)
    if kind == "links":
        return _links(rng, tag)
    if kind == "teasers":
        return f"<h3>{rng.choice(['Most read', 'Related', 'See also'])}</h3><ul>" + "".join(f'<li><a href="/{i}">The {rng.choice(_NAMES)} and the {rng.choice(_NAMES)}</a></li>' for i in range(rng.randrange(2, 6))) + "</ul>" + (f"<p>{rng.choice(_TEXT)}</p>" if rng.random() < 0.3 else "")
    if kind == "replies":
        return "<h3>Comments</h3>" + "".join(f'<div class="{rng.choice(["comment", "comment-body", "reply comment"])}"><b>{rng.choice(["Ann", "Bo", "Cy"])}</b><p>{r}</p></div>' for r in rng.sample(_REPLIES, rng.randrange(1, 4)))
    if kind == "form":
        return "<p>Get a weekly letter from us.</p><form><input type=email><input type=submit></form>"
    return {"title": f'<h1><a href="/">The {name.title()} Site</a></h1>', "small": f"&copy; {name}.example &middot; All rights reserved. Contact us. Terms.", "sell": f"Buy new boots for the {name} today. <a href=/shop/>Shop</a>", "notice": "We use cookies to improve this site. <button>Accept</button>"}[kind]


def furniture(rng: random.Random, kind: int) -> str:
    names, tag, inside = FURNITURE[kind]
    tag = tag if rng.random() < 0.6 else rng.choice(["section", "section", "div", "p"] if inside in ("small", "sell", "notice") else ["section", "div"] if tag == "div" else [tag])
    return f"<{tag} {rng.choice(['class', 'class', 'id'])}=\"{rng.choice(names)}\">{_inside(rng, inside, tag)}</{tag}>"


def main_text(rng: random.Random) -> str:
    def attrs(share: float) -> str:
        return f' class="{rng.choice(WITHIN)}"' if rng.random() < share else ""

    out = [f"<h{1 + rng.randrange(2)}{attrs(0.4)}>{rng.choice(_NAMES).title()} notes</h1>"]
    for _ in range(rng.randrange(3, 9)):
        text, form = rng.choice(_TEXT), rng.random()
        if form < 0.55:
            text = f"{text} See <a href=/x/>the report</a>." if rng.random() < 0.15 else f"{text}<br>{rng.choice(_TEXT)}" if rng.random() < 0.15 else text
            out.append(f"<p{attrs(0.4)}>{text}" + rng.choice(["</p>", "</p>", ""]))
        elif form < 0.7:
            out.append(f"<div{attrs(0.6)}>{text}</div>")
        elif form < 0.78:
            out.append(f"<ul{attrs(0.5)}><li>{text}</li><li>{rng.choice(_TEXT)}</li></ul>")
        elif form < 0.86:
            out.append(f"<h2{attrs(0.3)}>{rng.choice(_NAMES).title()}</h2><section{attrs(0.5)}><p>{text}</p></section>")
        elif form < 0.92:
            out.append(f"<blockquote{attrs(0.4)}>{text}</blockquote>")
        elif form < 0.96:
            out.append(f"<table{attrs(0.3)}><tr><th>Item</th><th>Cost</th></tr><tr><td>{text}</td><td>12,000</td></tr></table>")
        else:
            out.append("<pre>open 9 to 5</pre>")
    return "".join(out)


def page(rng: random.Random) -> str:
    before = [furniture(rng, k) for k in rng.sample(range(len(FURNITURE)), rng.randrange(0, 4))]
    after = [furniture(rng, k) for k in rng.sample(range(len(FURNITURE)), rng.randrange(0, 4))]
    layout, text = rng.random(), f"<!--[-->{main_text(rng)}<!--]-->"
    if layout < 0.3:
        body = rng.choice(["article", "main"])
        text = f"<{body}>{text}</{body}>"
    elif layout < 0.4:
        text = f"<table><tr><td>{_links(rng, 'div')}</td><td>{text}</td></tr></table>"
    for _ in range(rng.randrange(0 if layout < 0.4 else 1, 3)):
        text = f"<div {rng.choice(['class', 'id'])}=\"{rng.choice(AROUND)}\">{furniture(rng, rng.randrange(len(FURNITURE))) if rng.random() < 0.15 else ''}{text}{furniture(rng, rng.randrange(len(FURNITURE))) if rng.random() < 0.15 else ''}</div>"
    nav = f"<nav><ul>{_links(rng)}</ul></nav>" if rng.random() < 0.4 else f"<ul>{_links(rng)}</ul>" if rng.random() < 0.3 else ""
    foot = "<footer>Contact us. Terms. Privacy.</footer>" if rng.random() < 0.4 else ""
    return f"<!DOCTYPE html><html><head><title>River</title><style>p{{margin:0}}</style><script src=a.js />var a=\"</p>\";</script></head><body>{nav}{''.join(before)}{text}{''.join(after)}{foot}</body></html>"


def pages(n: int = 600, seed: int = 11) -> list[str]:
    rng = random.Random(seed)
    return [page(rng) for _ in range(n)]
