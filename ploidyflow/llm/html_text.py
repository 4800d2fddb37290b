"""Main text of a web page: the contiguous region of words and tags with the largest score.

The page is one sequence. A word scores by its place (plain, or in a link), a tag costs
what its name, its side (start or end) and its place (inside a container or not)
cost. The costs are learned from labelled pages: text blocks cost next to nothing and what
parts the article from all else (sections, menus, footers, asides, ...) a lot, so a single linear scan
finds the region. An element whose tag, class, id or role may mark it as no article (an advert, a form,
comments, ...) is judged as a whole: by its tag, the words of its names, and what it holds (its
share of the page's words, headings, paragraphs, links), with weights learned from labelled elements. One that is judged no article
scores nothing, and where it lies inside of the region it is left out of the text. No name alone decides, so a wrapper of the article stays whatever it is called.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_setup

# Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ASIDE = frozenset("aside button dialog fieldset footer form head menu nav option select svg math object audio video canvas".split())
#: An element with one of these words in its class, id or role is judged.
ASIDE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay comment comments respond disqus reply replies sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead share sharing social related recommended newsletter subscribe signup login search toolbar contentinfo complementary dialog hidden".split()
)

#: Elements that parts of a page lie in, and those that hold text.
CONTAINERS = frozenset("div section article main aside nav header footer form".split())
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address".split())

#: A tag whose quoted values hold no "<": nearly all do. Others go to _Quotes.
_TAG = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<rest>(?:[^\"'<>]++|\"[^\"<]*+\"|'[^'<]*+')*+)>")
_NAME = re.compile(r"<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)")
_RAW_END = {name: re.compile(rf"</{name}(?![\w:-])", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")

PLAIN, LINK = "word", "word in a link"
MAIN, MAIN_END = "<!--main-->", "<!--/main-->"
#: kind, number of words, text (of a tag its name), and whether it is set aside.
Token = tuple[str, int, str, bool]


def _named(name: str, rest: str, inside_article: bool) -> tuple[str, ...] | None:
    """What an element is judged by: its tag, whole names, and words of names; None if nothing marks it as no article."""
    marks = [f"<{name}>"] if name in ASIDE or (name == "header" and not inside_article) else []
    if rest and ("=" in rest or "hidden" in rest.lower()) and name not in ("html", "body", "article", "main"):
        if _HIDDEN.search(rest):
            marks.append("is hidden")
        for found in _NAMES.findall(rest):
            for token in "".join(found).lower().split():
                words = _WORDS.findall(token)
                hits = [w for w in words if w in ASIDE_WORDS]
                marks += ["is named so"] if hits and len(words) == 1 else ["has it in a name", "leads a name" if words[0] in ASIDE_WORDS else "ends a name"] if hits else []
                marks += [f"word {w}" for w in words if w not in ASIDE_WORDS]
        if not any(x.startswith(("<", "is", "has")) for x in marks):
            return None
    return tuple(marks) or None


#: Marks by which an element is set aside even if nothing else on the page is left.
SURE = frozenset(("is named so", "is hidden", *(f"<{x}>" for x in ASIDE - {"form", "fieldset", "aside", "dialog"}), "<header>"))


@dataclass
class Judge:
    """Weights of what elements are judged by; above zero an element is no article."""

    by_mark: dict[str, float]

    def is_aside(self, marks: list[tuple[str, float]]) -> bool:
        return sum(self.by_mark.get(k, 0.0) * v for k, v in marks) > 0


class _Quotes:
    """Ends of tags by their quotes. All that is asked of a page takes time in proportion to its length."""

    def __init__(self, page: str):
        self.at, self.chars, self.after = [], [], []
        for m in re.finditer("[\"'>]", page):
            self.at.append(m.start())
            self.chars.append(m[0])
        last = {}
        for k in range(len(self.at) - 1, -1, -1):
            self.after.append(last.get(self.chars[k]))
            last[self.chars[k]] = k
        self.after.reverse()
        self.dead: set[int] = set()

    def end(self, begin: int) -> int | None:
        """Where the tag that begins there ends; None if a quote of it stays open."""
        k, passed = bisect_left(self.at, begin), []
        while k < len(self.at) and k not in self.dead:
            if self.chars[k] == ">":
                return self.at[k] + 1
            passed.append(k)
            if self.after[k] is None:
                break
            k = self.after[k] + 1
        self.dead.update(passed)
        return None


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """Begin, end, whether an end tag, name (lower case) and rest of every tag, comment (no name) and raw element."""
    at, last, quotes = 0, page.rfind(">"), None
    while (begin := page.find("<", at)) >= 0:
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 2)
            at = len(page) if at < 0 else at + 3
            yield begin, at, False, "", page[begin:at]
            continue
        if begin > last:
            return
        m = _TAG.match(page, begin)
        if m:
            end, rest = m.end(), m["rest"]
        elif m := _NAME.match(page, begin):
            quotes = quotes or _Quotes(page)
            end = quotes.end(m.end()) or page.index(">", begin) + 1
            rest = page[m.end() : end - 1]
        elif page[begin + 1 : begin + 2] in ("/", "!", "?"):
            at = page.index(">", begin) + 1
            yield begin, at, False, "", ""
            continue
        else:
            at = begin + 1
            continue
        name = m["name"].lower()
        if name in RAW and not m["end"]:
            close = _RAW_END[name].search(page, end)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or len(page)
            yield begin, at, False, "", ""
            continue
        at = end
        yield begin, at, bool(m["end"]), name, rest


def sequence(page: str, judge: Judge | None = None) -> list[Token]:
    """Every text and tag in order. A tag's kind is its name, its side and its place; a label in a comment is its own kind."""
    return parsed(page, judge)[0]


def parsed(page: str, judge: Judge | None = None) -> tuple[list[Token], list[tuple[int, int]]]:
    """The page's sequence, and first and end in it of what each container holds."""
    out, parts, judged = _read(page)
    judge = judge or default_judge()
    asides = [(first, end, marks) for first, end, marks in _described(out, judged) if judge.is_aside(marks)]

    def covered() -> list[bool]:
        edges = [0] * (len(out) + 1)
        for first, end, _ in asides:
            edges[first] += 1
            edges[end] -= 1
        return [x > 0 for x in accumulate(edges)]

    aside = covered()
    if asides and not any(t[1] and t[0] == PLAIN and not x for t, x in zip(out, aside, strict=False)):
        # nothing would be left: only what is surely no article stays aside
        asides = [x for x in asides if any(k in SURE for k, _ in x[2])]
        aside = covered()
    return [(kind, n, shown, x) for (kind, n, shown, _), x in zip(out, aside, strict=False)], parts


def _described(out: list[Token], judged: list[tuple[int, int, tuple[str, ...], str]]) -> Iterator[tuple[int, int, list[tuple[str, float]]]]:
    """First, end and marks, with their values, of each element that is to be judged."""
    if not judged:
        return
    sums = {name: [0, *accumulate(map(of, out))] for name, of in (("words", lambda t: t[1]), ("linked", lambda t: t[1] * (t[0] == LINK)), ("h1", lambda t: t[0].startswith("<h1>")), ("article", lambda t: t[0].startswith(("<article>", "<main>"))), ("p", lambda t: t[0].startswith("<p>")), ("menus", lambda t: t[0].startswith(("<nav>", "<footer>"))))}
    for first, end, marks, _ in judged:
        own = {name: x[end] - x[first] for name, x in sums.items()}
        total = sums["words"][-1] - sums["linked"][-1] or 1
        values = {"always": 1.0, "share": (own["words"] - own["linked"]) / total, "all": float(own["words"] == sums["words"][-1]), "mostly": float(own["words"] - own["linked"] > 0.5 * total), "links": own["linked"] / (own["words"] or 1)}
        values |= {f"holds {name}": float(own[name] > 0) for name in ("h1", "article", "menus")} | {"holds paragraphs": min(own["p"], 4) / 4}
        yield first, end, [*dict.fromkeys((x, 1.0) for x in marks), *values.items()]


def _read(page: str) -> tuple[list[Token], list[tuple[int, int]], list[tuple[int, int, tuple[str, ...], str]]]:
    """The sequence, what containers hold, and elements that are to be judged: first, end, what names them, and their tag's text."""
    out: list[Token] = []
    parts: list[tuple[int, int]] = []
    judged: list[tuple[int, int, tuple[str, ...], str]] = []
    open_tags: list[tuple[str, tuple[str, ...] | None, str, int]] = []
    count: Counter[str] = Counter()
    depth = at = 0

    def close(upto: int) -> None:
        nonlocal depth
        for name, named, rest, first in open_tags[upto:]:
            count[name] -= 1
            if named:
                judged.append((first - 1, len(out), named, rest))
            if name in CONTAINERS:
                depth -= 1
                parts.append((first, len(out)))
        del open_tags[upto:]

    def last_open(name: str) -> int:
        return next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name)

    def text(raw: str) -> None:
        if raw:
            shown = html.unescape(raw)
            out.append((LINK if count["a"] else PLAIN, len(shown.split()), shown, False))

    for begin, end, is_end, name, rest in _tags(page):
        text(page[at:begin])
        at = end
        if not name:
            if rest in (MAIN, MAIN_END):
                out.append((rest, 0, "", False))
            continue
        if is_end:
            if count[name]:
                close(last_open(name))
            out.append((f"</{name}>{'+' * (depth > 0)}", 0, name, False))
            continue
        if name not in VOID and not rest.endswith("/"):
            if open_tags and open_tags[-1][0] == name and name in ("p", "li", "tr", "td", "th", "dt", "dd", "option"):
                close(len(open_tags) - 1)
            elif name not in INLINE and count["p"]:
                close(last_open("p"))
            out.append((f"<{name}>{'+' * (depth > 0)}", 0, name, False))
            open_tags.append((name, _named(name, rest, count["article"] + count["main"] > 0), rest, len(out)))
            count[name] += 1
            depth += name in CONTAINERS
        else:
            out.append((f"<{name}>{'+' * (depth > 0)}", 0, name, False))
    text(page[at:])
    close(0)
    return out, parts, judged


@dataclass
class Weights:
    """What each kind of word and tag scores, and tags that weren't learned. lists: whether what is set aside scores nothing."""

    by_kind: dict[str, float]
    text_tag: float = -0.01
    other: float = -0.05
    lists: bool = True

    def score(self, kind: str, words: int, shown: str = "", aside: bool = False) -> float:
        if aside and self.lists:
            return 0.0
        if kind in (PLAIN, LINK):
            return self.by_kind.get(kind, 0.0) * words
        known = self.by_kind.get(kind)
        return known if known is not None else self.text_tag if shown in INLINE or shown in TEXT_BLOCKS else self.other


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the region with the largest sum; of equal ones the first, and (0, 0) if none is positive."""
    best, first, end = 0.0, 0, 0
    total, begin = 0.0, 0
    for i, x in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += x
        if total > best:
            best, first, end = total, begin, i + 1
    return first, end


def region_text(tokens: list[Token], lists: bool = True) -> str:
    """Blocks of a region, white space made single, joined by line breaks; without what is set aside, if lists are asked for."""
    blocks, block = [], []
    for kind, _, shown, aside in tokens:
        if kind in (PLAIN, LINK):
            if not (aside and lists):
                block.append(shown)
        elif shown == "br":
            block.append(" ")
        elif shown not in INLINE and block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    blocks.append(" ".join("".join(block).split()))
    return "\n".join(x for x in blocks if x)


def labelled_pages(n: int = 240, seed: int = 7) -> list[str]:
    """Pages made by rule, whose article stands between two labels in comments."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeiourstlnmdkp") for _ in range(draw.randint(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randint(a, b)))
    links = lambda k, tag: "".join(f'<{tag}><a href="/{word()}">{words(1, 3)}</a></{tag}>' for _ in range(k))

    def article() -> str:
        body = [f"<h1>{words(1, 9)}</h1>"]
        for _ in range(draw.randint(4, 16)):
            kind = draw.random()
            if kind < 0.55:
                body.append(f"<p>{words(1, 70)}</p>")
            elif kind < 0.7:
                body.append(f"<p><b>{words(2, 40)}<br><p>{words(1, 40)}</p>")
            elif kind < 0.8:
                body.append(f'<p>{words(3, 20)} <a href="/x">{words(1, 3)}</a> {words(3, 20)} <em>{word()}</em>.</p>')
            elif kind < 0.87:
                body.append("<ul>" + "".join(f"<li>{words(3, 15)}</li>" for _ in range(draw.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                body.append(f"<div><p>{words(10, 60)}</p></div>")
            elif kind < 0.96:
                body.append(f"<blockquote><p>{words(3, 30)}</p></blockquote><table><tr><td>{words(1, 9)}</td></tr></table>")
            else:
                body.append(f"<h2>{words(1, 6)}</h2>")
        return "".join(body)

    pages = []
    for _ in range(n):
        wrap = draw.choice(("article", "article", "main", "div", "section"))
        menu = draw.choice(("nav", "nav", "div", "header"))
        parts = [f"<{menu}><ul>{links(draw.randint(3, 12), 'li')}</ul></{menu}>", f"<header><p>{words(2, 20)}</p></header>"][: draw.randint(1, 2)]
        parts += draw.choice(([f'<div class="ad">{words(3, 60)}</div>'], [f"<aside><p>{words(3, 60)}</p></aside>"], []))
        parts.append(f"<{wrap}>{MAIN}{article()}{MAIN_END}</{wrap}>")
        parts += draw.choice(([f'<div id="comments"><p>{words(3, 40)}</p><p>{words(3, 20)}</p></div>'], [f"<aside><ul>{links(4, 'li')}</ul><p>{words(3, 40)}</p></aside>"], [f"<form><label>{words(1, 30)}</label><input></form>"], []))
        parts.append(f"<footer>&copy; {words(3, 60)}</footer>")
        inside = draw.random() < 0.25 and wrap in ("article", "main")
        pages.append(f"<html><head><title>{words(2, 8)}</title></head><body>{'<div>' * inside}{''.join(parts)}{'</div>' * inside}</body></html>")
    return pages


#: What the author of a labelled element may call it besides. Made-up names of pages, not of HTML.
_WRAPPERS = "content post article story entry text body page row results main wide layout block".split()
_TURNS = "no not without with has enabled disabled free none off on open hidden default".split()
_PIECES = "box block section container wrapper list area item top bottom left right big inner".split()


def labelled_elements(n: int = 900, seed: int = 11) -> list[str]:
    """Pages of several layouts, made by rule, in which data-kept tells of elements that may look like no article whether they are (1) or hold the article (0)."""
    draw = random.Random(seed)
    names = sorted(ASIDE_WORDS)
    words = lambda a, b: " ".join("".join(draw.choices("aeiourstlnm", k=draw.randint(2, 9))) for _ in range(draw.randint(a, b)))
    links = lambda k: "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(k))

    def paragraphs(a: int, b: int, most: int) -> str:
        return "".join(f"<p>{words(3, most)}</p>" for _ in range(draw.randint(a, b)))

    def junk_name() -> str:
        w = draw.choice(names)
        return draw.choice((w, w, w, f"{w}-{draw.choice(_PIECES)}", f"{draw.choice(_PIECES)}-{w}", f"{w}_{draw.choice(names)}", f"{w} {draw.choice(_PIECES)}"))

    def kept_name() -> str:
        w, wrapper, turn = draw.choice(names), draw.choice(_WRAPPERS), draw.choice(_TURNS)
        return draw.choice((f"{wrapper} {turn}-{w}", f"{wrapper} {w}-{turn}", f"{wrapper}-{turn}-{w}", f"{w}-{turn} {wrapper}", f"{wrapper} {w}-{wrapper}-{draw.choice(_WRAPPERS)}", f"{wrapper}-{w}"))

    def junk(tags: tuple[str, ...] = ("aside", "form", "nav", "footer", "header", "fieldset", "button", "select")) -> str:
        tag = draw.choice(("div", "div", "section", "p", "ul"))
        inner = draw.choice((lambda: words(2, 60), lambda: f"<ul>{links(draw.randint(2, 9))}</ul>", lambda: paragraphs(1, 12, 40)))()
        if draw.random() < 0.35:
            tag = draw.choice(tags)
            return f'<{tag} data-kept="1">{inner}</{tag}>'
        return f'<{tag} {draw.choice(("class", "id", "class", "role"))}="{junk_name()}" data-kept="1">{inner}</{tag}>'

    pages = []
    for _ in range(n):
        parts = [draw.choice(("", f"<h1>{words(2, 8)}</h1>")), paragraphs(1, 9, 60)]
        if draw.random() < 0.5:
            parts.insert(draw.randint(1, 2), junk())
        text = "".join(parts)
        if draw.random() < 0.3:
            text = f"<article>{text}</article>"
        layout = draw.random()
        if draw.random() < 0.2:  # next to nothing but what is no article
            text, layout = draw.choice(("", "<article></article>", f"<p>{words(1, 4)}</p>")), 1.0
        if layout < 0.45:
            text = f'<div class="{kept_name()}" data-kept="0">{text}</div>'
        elif layout < 0.55:
            text = f'<div id="{kept_name()}" data-kept="0"><div>{text}</div></div>'
        around = [f'<nav data-kept="1"><ul>{links(draw.randint(2, 9))}</ul></nav>'] * draw.randint(0, 1) + [junk() for _ in range(draw.randint(0, 2))]
        after = [junk() for _ in range(draw.randint(0, 2))] + [f'<footer data-kept="1">{words(2, 40)}</footer>'] * draw.randint(0, 1)
        page = "".join([*around, text, *after])
        if draw.random() < 0.25 and layout < 1:
            page = f'<{(tag := draw.choice(("form", "form", "fieldset", "aside")))} data-kept="0">{page}</{tag}>' if draw.random() < 0.7 else f'<div class="{kept_name()}" data-kept="0">{page}</div>'
        pages.append(f"<html><body>{page}</body></html>")
    return pages


def learn_judge(pages: list[str], rounds: int = 30, margin: float = 1.0) -> Judge:
    """Averaged perceptron, with a margin, over the labelled elements."""
    rows = []
    for page in pages:
        out, _, judged = _read(page)
        rows += [(marks, kept == "1") for (*_, marks), (*_, rest) in zip(_described(out, judged), judged, strict=True) for kept in re.findall(r'data-kept="([01])"', rest)]
    own: dict[str, float] = {}
    sums: dict[str, float] = {}
    draw = random.Random(3)
    for _ in range(rounds):
        draw.shuffle(rows)
        for marks, is_junk in rows:
            if sum(own.get(k, 0.0) * v for k, v in marks) * (1 if is_junk else -1) <= margin:
                for k, v in marks:
                    own[k] = own.get(k, 0.0) + (v if is_junk else -v)
        for k, v in own.items():
            sums[k] = sums.get(k, 0.0) + v
    return Judge({k: v / rounds for k, v in sums.items()})


@cache
def default_judge() -> Judge:
    return learn_judge(labelled_elements())


def _bounds(kind: str) -> tuple[float, float]:
    """The least and the most that a kind of token may score."""
    if kind == PLAIN:
        return 1.0, 1.0
    if kind == LINK:
        return 0.05, 0.4
    name = kind.strip("</>+")
    return (-0.02, -0.01) if name in INLINE or name in TEXT_BLOCKS else (-200.0, -0.02)


def learn_weights(pages: list[str], rounds: int = 12, margin: float = 0.5) -> Weights:
    """Averaged perceptron over regions; the lists of what is set aside take no part.

    In learning, words outside the article score so much more, and those in it so much less, so what is learned holds by that margin.
    """
    own: dict[str, float] = {PLAIN: 1.0, LINK: 0.2}
    sums: dict[str, float] = {}
    labelled = []
    for page in pages:
        raw = sequence(page)
        a, b = (next(i for i, x in enumerate(raw) if x[0] == label) for label in (MAIN, MAIN_END))
        tokens = raw[:a] + raw[a + 1 : b] + raw[b + 1 :]
        inner = [i for i in range(a, b - 1) if tokens[i][1]]
        if inner:
            labelled.append((tokens, inner[0], inner[-1] + 1))
    for _ in range(rounds):
        for tokens, first, end in labelled:
            scale = Weights(own, lists=False)
            a, b = best_region([scale.score(*t) + t[1] * (-margin if first <= i < end else margin) * (t[0] == PLAIN) for i, t in enumerate(tokens)])
            for i in {*range(first, end)} ^ {*range(a, b)}:
                kind, n, *_ = tokens[i]
                low, high = _bounds(kind)
                step = (0.001 * n if n else 1.0) * (1 if first <= i < end else -1)
                own[kind] = min(max(own.get(kind, high) + step, low), high)
            for kind, v in own.items():
                sums[kind] = sums.get(kind, 0.0) + v
    return Weights({k: v / (rounds * len(labelled)) for k, v in sums.items()})


def main_text(page: str, weights: Weights, judge: Judge | None = None) -> str:
    """Text of the best region; without lists, of that alone.

    With them a region within a container is taken to the container's bounds, so
    a short block at its edge isn't lost.
    """
    tokens, parts = parsed(page, judge)
    first, end = best_region([weights.score(*t) for t in tokens])
    if weights.lists and end:
        first, end = min(((a, b) for a, b in parts if a <= first and end <= b), key=lambda x: x[1] - x[0], default=(first, end))
    return region_text(tokens[first:end], weights.lists)


def extract(pages: DataFrame, weights: Weights | None = None, judge: Judge | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from the whole html.

    A null or empty page, and one where no region scores above zero, has an empty
    text. The time for a page is in proportion to its length, whatever is left open or nested in it. Character references are decoded; a region is never shortened. Repeated
    rows are answered each; rows without page_id keep a null one.
    """
    session_setup(pages.sparkSession)
    weights, judge = weights or learn_weights(labelled_pages()), judge or default_judge()

    def run(batches):
        for b in batches:
            texts = [main_text(x, weights, judge) if x else "" for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
