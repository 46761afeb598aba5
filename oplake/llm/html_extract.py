"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of words and tags.  Each token's score is the log odds, learned from
labelled pages, of standing inside the main text; one linear scan finds the contiguous region
of the largest total.  Elements beside the main text (menus, notices, adverts, reader comments)
are told by what their names say, by weights learned from the same pages: what stands in them
scores nothing and is never output, and nothing else is left out of the region.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is not text of the page (fixed values).
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "math", "object", "canvas", "audio", "video", "noembed", "noframes", "xmp", "plaintext"])
#: Elements that hold page furniture (fixed values).
FURNITURE = frozenset(["nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "option", "label", "fieldset", "input", "datalist", "head"])
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
BLOCKS = frozenset(["address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "td", "th", "ul", "caption"])
#: Elements of other markup, in which a slash closes a tag (fixed values).
FOREIGN = frozenset(["svg", "math"])
#: A link after so many words of its block stands in running text.
INLINE = 3
#: A tag speaks this much at most for or against what the names on it say.
TAG = 2.0
#: An element's names count only as far as they weigh more than this against the main text.
FURNITURE_MARGIN = 1.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|(?P<text>[^<]++|<)",
    re.DOTALL,
)
_ATTR = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role|style|aria-hidden|hidden)(?=[\s=/>]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


@dataclass(frozen=True)
class Weights:
    """Log odds of token kinds inside against outside the main text, and of elements' names beside against around or in it."""

    kinds: dict[str, float]
    names: dict[str, float]


def name_features(name: str, attrs: str) -> list[str]:
    """What an element's tag and names say: the tag, each name whole, its parts, and pairs of neighbouring parts."""
    out = [f"<{name}>"]
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'")
        if key in ("class", "id", "role"):
            for word in value.split():
                parts = [p.lower() for p in _PARTS.findall(word)]
                out += parts
                out.append("=" + "-".join(parts))
                out += [f"{a}-{b}" for a, b in zip(parts, parts[1:])]
    return out


def unseen(attrs: str) -> bool:
    """Whether a browser would not show the element."""
    for m in _ATTR.finditer(attrs):
        key, value = m.group(1).lower(), (m.group(2) or "").strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def _furniture(name: str, attrs: str, names: dict[str, float]) -> bool:
    if name in FURNITURE:
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return False
    if unseen(attrs):
        return True
    found = name_features(name, attrs)
    return len(found) > 1 and sum(names.get(f, 0.0) for f in found) > FURNITURE_MARGIN


@functools.lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE)


def tokens(page: str, names: dict[str, float] | None = None) -> list[tuple[str, str, bool]]:
    """(kind, text, furniture) of each token: kind is ``<name>``, ``</name>``, ``word:...`` or ``mark``
    (a comment, which only labelled pages use).  A link within the main text, or after words of its
    own block, reads on like any text.  Works on any string, in time that follows its length;
    unclosed tags end with the page."""
    names = default_weights().names if names is None else names
    out: list[tuple[str, str, bool]] = []
    stack: list[tuple[str, bool]] = []
    open_: Counter = Counter()  # names on the stack
    at, size, before = 0, len(page), 0  # before: words of the block up to here, outside links
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"]
        if text is not None:
            noise = bool(stack) and stack[-1][1]
            link = open_["a"] and any(n == "a" for n, _ in stack[-4:])
            where = "main" if open_["article"] or open_["main"] else "link" if link and before < INLINE else "plain"
            if not link:
                before += _words(text)
            out.append((f"word:{where}", text, noise))
            continue
        name = m["name"] or m["name2"]
        if name is None:
            out.append(("mark", m.group(), False))
            continue
        name = name.lower()
        closing = m["close"] if m["name"] else m["close2"]
        if name in BLOCKS:
            before = 0
        shown = "inline" if name == "a" and (before >= INLINE or open_["article"] or open_["main"]) else name
        if closing:
            if name == "body" or name == "html":
                stack.clear()
                open_.clear()
            elif open_[name]:
                while True:
                    gone = stack.pop()[0]
                    open_[gone] -= 1
                    if gone == name:
                        break
            out.append((f"</{shown}>", "", bool(stack) and stack[-1][1]))
            continue
        attrs = (m["attrs"] if m["name"] else m["attrs2"]) or ""
        if name in RAW:
            if not (name in FOREIGN and attrs.endswith("/")):  # elsewhere a slash closes nothing
                end = _end_of(name).search(page, at)
                at = end.end() if end else size
            continue
        if name in BLOCKS and stack and stack[-1][0] == "p":
            open_[stack.pop()[0]] -= 1
        above = bool(stack) and stack[-1][1]
        noise = _furniture(name, attrs, names) or (above and name not in ("article", "main"))
        if name not in VOID:
            stack.append((name, noise))
            open_[name] += 1
        out.append((f"<{shown}>", "", noise))
    return out


@functools.lru_cache(maxsize=1)
def default_weights() -> Weights:
    from oplake.llm.html_labels import pages

    return learn(pages())


def learn_names(pages: list[str]) -> dict[str, float]:
    """Log odds of each name on the outermost elements beside the main text, against elements around
    or in it, smoothed by one half; a page counts a name once on either side."""
    beside, near = Counter(), Counter()
    for page in pages:
        inside, depth, held = False, [], []  # held: (features, whether main text stood in it)
        for m in _TOKEN.finditer(page):
            if (m.group() == "<!--[-->") or m.group() == "<!--]-->":
                inside = m.group() == "<!--[-->"
                for e in depth:
                    e[2] = True
                continue
            name = (m["name"] or m["name2"] or "").lower()
            if not name or name in VOID or name in RAW:
                continue
            if m["close"] or m["close2"]:
                while depth:
                    e = depth.pop()
                    held.append((e[1], e[2], e[3]))
                    if e[0] == name:
                        break
            else:
                if name in BLOCKS and depth and depth[-1][0] == "p":
                    e = depth.pop()
                    held.append((e[1], e[2], e[3]))
                # an element counts as beside the text where none of those around it does so already
                depth.append([name, name_features(name, m["attrs"] or m["attrs2"] or ""), inside, len(depth)])
        held += [(e[1], e[2], e[3]) for e in depth]
        ours = {f for features, main, _ in held if main for f in features}
        theirs = {f for features, main, _ in held if not main and len(features) > 1 for f in features if not f.startswith("<")}
        near.update(ours)
        beside.update(theirs)
        beside.update({features[0] for features, main, _ in held if not main and len(features) > 1})
    a, b = max(1, sum(beside.values())), max(1, sum(near.values()))
    odds = {f: math.log((beside[f] + 0.5) / a) - math.log((near[f] + 0.5) / b) for f in beside | near}
    return {f: min(max(x, -TAG), TAG) if f.startswith("<") else x for f, x in odds.items()}


def learn(pages: list[str]) -> Weights:
    """Weights of names, then of token kinds: log odds of each kind inside against outside the marked
    region, furniture aside, smoothed by one; words must gain and tags must cost, so weights of the
    wrong sign are cut to a small one."""
    names = learn_names(pages)
    inside, outside = Counter(), Counter()
    for page in pages:
        in_ = False
        for kind, text, noise in tokens(page, names):
            if kind == "mark":
                in_ = {"<!--[-->": True, "<!--]-->": False}.get(text, in_)
            elif not noise:
                (inside if in_ else outside)[kind] += _words(text) if kind.startswith("word") else 1
    weights = {}
    for kind in inside | outside:
        odds = math.log((inside[kind] + 1) / (outside[kind] + 1))
        weights[kind] = max(odds, 0.05) if kind.startswith("word") and kind != "word:link" else min(odds, -0.01)
    return Weights(weights, names)


def _words(text: str) -> float:
    """Words of a run of text; what only separates (``|``, ``>``) is hardly one."""
    if len(text) > 40:
        return len(text.split())
    return sum(1.0 if any(map(str.isalnum, w)) else 0.05 for w in (html.unescape(text) if "&" in text else text).split())


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the largest sum, the first of equal ones; (0, 0) if none is positive."""
    best, top = (0, 0), 0.0
    total, start = 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0.0:
            total, start = 0.0, i
        total += s
        if total > top:
            top, best = total, (start, i + 1)
    return best


def token_scores(found: list[tuple[str, str, bool]], weights: Weights) -> list[float]:
    """What each token adds to a region."""
    article = any(k == "word:main" and not noise and not t.isspace() for k, t, noise in found)
    scores = []
    for kind, text, noise in found:
        if noise or kind == "mark":
            scores.append(0.0)
        elif kind.startswith("word"):
            w = weights.kinds.get(kind, weights.kinds.get("word:plain", 0.05))
            if article and kind == "word:plain":
                w = -w  # a page that names its article keeps its text there
            scores.append(w * _words(text))
        else:
            scores.append(weights.kinds.get(kind, -0.05))
    return scores


def extract(page: str, weights: Weights | None = None) -> str:
    weights = weights or default_weights()
    found = tokens(page, weights.names)
    scores = token_scores(found, weights)
    a, b = best_region(scores)
    while b and b < len(found) and found[b][0] != "word:link" and found[b][0].strip("</>") not in BLOCKS:
        b += 1  # the block it ends in goes on to its end
    blocks, now = [], []
    for kind, text, noise in found[a:b]:
        if kind.startswith("word"):
            if not noise:
                now.append(text)
        elif kind == "mark":
            continue
        elif kind.strip("</>") in BLOCKS:
            blocks.append("".join(now))
            now = []
        elif kind == "<br>":
            now.append(" ")
    blocks.append("".join(now))
    clean = (" ".join(html.unescape(x).split()) for x in blocks)
    return "\n".join(x for x in clean if x)


def extract_pages(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null html is empty; a page without main text has empty text and 0; repeated rows repeat;
    an empty table gives no rows; other columns are ignored.  Whole pages, no length limit; no shuffle.
    """
    w = weights or default_weights()
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "", w) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {source.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
