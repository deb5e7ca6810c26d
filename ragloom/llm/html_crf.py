"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

1. *Blocks* (per page, whole html). One pass over tags and text keeps the stack of open elements (paragraphs, list items
   and table cells close their like; a stray end tag is ignored). Text between block-level tags is a leaf block; inline
   tags don't cut it, ``<br>`` is a space in it. Scripts, styles, titles and other text that isn't shown are skipped, to
   the end of the page only where a raw-text element is unclosed: an svg or select ends at a block at the latest, and an
   unclosed template or noscript and a self-closed svg hide nothing.
   Character references are decoded, runs of white space become one space, empty blocks are left out.
2. *Features* of a block: the tags and the class and id words of all its ancestors, its parent tag, number of words, share
   of linked text, sentence end, and words that mark page furniture.
3. *Model*. Two labels (main text or not), feature weights per label, transitions, starts and ends. Trained by stochastic
   gradient ascent with per-coordinate rates on the likelihood of labelled pages (forward-backward), decoded by Viterbi.
   The labelled pages are written by a rule from many layouts (``labelled_pages``), with every kind of furniture beside,
   before, after and inside the article, and with texts of every kind on both sides, so that structure decides.
4. The blocks labelled main text, in page order, joined by one space, are the text.

Scoring is per row, without a shuffle; the model is a few hundred numbers. Ancestor features are summed once per distinct
stack of open elements and kept by the worker.

Defined cases: null and empty html, and pages without main text, give the empty text; unclosed and misnested tags are read
as above, at linear cost; repeated rows are extracted each; an empty table gives an empty result; other columns are kept.
"""
from __future__ import annotations

import html as html_lib
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|title|textarea|iframe)(?=[\s/>])(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-z][a-z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][a-z0-9:-]*)[^>]*>", re.S | re.I)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table article section div body main aside nav header footer form blockquote".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
FURNITURE = re.compile(r"cookie|copyright|©|subscribe|newsletter|sign in|log in|sponsored|advert|all rights|privacy|share this|read more|reply", re.I)
#: elements that aren't shown but may lack an end tag, and what ends the skipping: the end tag, for some a block before it
HIDDEN = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "svg", "select")}
BLOCK = re.compile(rf"</?(?:{'|'.join(sorted(ENDS_P - {'hr'} | {'body', 'li', 'td', 'th', 'tr'}))})(?=[\s/>])", re.I)
UNENDED = {"svg": BLOCK, "select": BLOCK, "noscript": re.compile(r"<noscript(?=[\s/>])", re.I)}
LABELS = 2


class Block:
    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: tuple[tuple[str, str], ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def names_of(attributes: str) -> str:
    """Class, id and role values, lower case, joined by spaces."""
    return " ".join(" ".join(m).strip().lower() for m in NAMED.findall(attributes)) if "=" in attributes else ""


def blocks_of(page: str) -> list[Block]:
    out, stack, parts, at, links, linked = [], [], [], 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(e for e in stack if e[0] not in INLINE), linked))
            parts.clear()
        linked = 0

    def text(s: str) -> None:
        nonlocal linked
        s = html_lib.unescape(s) if "&" in s else s
        parts.append(s)
        linked += links * len(s.strip())

    ahead: dict[re.Pattern, int] = {}

    def next_of(pattern: re.Pattern) -> int:
        """Where the pattern is found next, or the end of the page; looked up again only once that is passed."""
        if ahead.get(pattern, -1) < at:
            found = pattern.search(page, at)
            ahead[pattern] = found.start() if found else len(page)
        return ahead[pattern]

    while m := TOKEN.search(page, at):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        closing = m[2] if m[3] else m[5]
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
        if name in HIDDEN and not closing and page[m.start() + 1 + len(name)] in " \t\n\r\f/>":
            if name != "svg" or not m[0].endswith("/>"):
                end, other = next_of(HIDDEN[name]), next_of(UNENDED[name]) if name in UNENDED else len(page)
                if end < other:
                    at = page.index(">", end) + 1
                elif other < len(page) and name != "noscript":
                    at = other
        elif closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    links -= any(e[0] == "a" for e in stack[k:]) if links else 0
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] in SCOPES:
                    break
        elif name not in VOID:
            shut = CLOSES.get(name, ()) + (("p",) if name in ENDS_P else ())
            if shut:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in shut:
                        links -= any(e[0] == "a" for e in stack[k:]) if links else 0
                        del stack[k:]
                        break
                    if stack[k][0] in SCOPES:
                        break
            if name == "a":
                if links:
                    while stack and stack[-1][0] == "a":
                        stack.pop()
                links = 1
            stack.append((name, names_of(m[4] or "")))
    if at < len(page):
        text(page[at:])
    flush()
    return out


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    found = {f"t:{tag}" for tag, _ in path} | {f"w:{w}" for _, names in path for w in re.split(r"[^a-z]+", names) if w}
    return [*sorted(found), f"p:{path[-1][0] if path else ''}"]


def text_features(block: Block) -> list[str]:
    words = block.text.count(" ") + 1
    size = "1" if words < 3 else "3" if words < 6 else "6" if words < 12 else "12" if words < 30 else "30"
    share = block.linked / len(block.text)
    out = ["bias", f"n:{size}", f"l:{0 if share == 0 else 1 if share < 0.5 else 2}"]
    if block.text[-1] in ".!?…":
        out.append("end")
    if FURNITURE.search(block.text):
        out.append("furniture")
    return out


class Crf:
    """weights: feature -> one number per label; moves[a][b], first[a], last[a]."""

    def __init__(self, weights: dict[str, tuple[float, float]], moves, first, last):
        self.weights, self.moves, self.first, self.last = weights, moves, first, last
        self.paths: dict[tuple, tuple[float, float]] = {}

    def sums(self, features: list[str]) -> tuple[float, float]:
        a = b = 0.0
        for f in features:
            w = self.weights.get(f)
            if w:
                a += w[0]
                b += w[1]
        return a, b

    def emissions(self, blocks: list[Block]) -> list[tuple[float, float]]:
        out = []
        for block in blocks:
            p = self.paths.get(block.path)
            if p is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                p = self.paths[block.path] = self.sums(path_features(block.path))
            t = self.sums(text_features(block))
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        scores = self.emissions(blocks)
        (m00, m01), (m10, m11) = self.moves
        s0, s1 = self.first[0] + scores[0][0], self.first[1] + scores[0][1]
        back = []
        for e0, e1 in scores[1:]:
            a0, b0, a1, b1 = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((int(b0 > a0), int(b1 > a1)))
            s0, s1 = max(a0, b0) + e0, max(a1, b1) + e1
        label = int(s1 + self.last[1] > s0 + self.last[0])
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def extract(crf: Crf, page: str) -> str:
    blocks = blocks_of(page)
    return " ".join(b.text for b, label in zip(blocks, crf.viterbi(blocks)) if label)


def log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 8, rate: float = 0.5, decay: float = 1e-4, seed: int = 3) -> Crf:
    """Stochastic gradient ascent on the conditional likelihood; per-coordinate rates."""
    w: dict = defaultdict(float)
    g2: dict = defaultdict(float)
    rows = [([path_features(b.path) + text_features(b) for b in blocks], labels) for blocks, labels in pages if blocks]
    rng = random.Random(seed)

    def up(key, gradient: float) -> None:
        gradient -= decay * w[key]
        g2[key] += gradient * gradient
        w[key] += rate * gradient / (1e-6 + math.sqrt(g2[key]))

    for _ in range(epochs):
        rng.shuffle(rows)
        for features, labels in rows:
            n = len(features)
            e = [[sum(w[f, y] for f in fs) for y in (0, 1)] for fs in features]
            move = [[w["move", a, b] for b in (0, 1)] for a in (0, 1)]
            first, last = [w["first", y] for y in (0, 1)], [w["last", y] for y in (0, 1)]
            forward = [[first[y] + e[0][y] for y in (0, 1)]]
            for k in range(1, n):
                forward.append([log_add(forward[-1][0] + move[0][y], forward[-1][1] + move[1][y]) + e[k][y] for y in (0, 1)])
            backward = [last]
            for k in range(n - 1, 0, -1):
                backward.append([log_add(move[y][0] + e[k][0] + backward[-1][0], move[y][1] + e[k][1] + backward[-1][1]) for y in (0, 1)])
            backward.reverse()
            total = log_add(forward[-1][0] + last[0], forward[-1][1] + last[1])
            moved = [[0.0, 0.0], [0.0, 0.0]]
            for k in range(n):
                one = math.exp(forward[k][1] + backward[k][1] - total)
                error = (labels[k] == 1) - one
                if abs(error) > 1e-4:
                    for f in features[k]:
                        up((f, 1), error)
                        up((f, 0), -error)
                if k:
                    moved[labels[k - 1]][labels[k]] += 1
                    for a in (0, 1):
                        for b in (0, 1):
                            moved[a][b] -= math.exp(forward[k - 1][a] + move[a][b] + e[k][b] + backward[k][b] - total)
                if k in (0, n - 1):
                    for key in (("first",) if n > 1 and k == 0 else ("last",) if k else ("first", "last")):
                        up((key, 1), error)
                        up((key, 0), -error)
            for a in (0, 1):
                for b in (0, 1):
                    up(("move", a, b), moved[a][b])
    weights = {key[0]: (w[key[0], 0], w[key[0], 1]) for key in list(w) if len(key) == 2 and key[0] not in ("first", "last")}
    return Crf(weights, [[w["move", a, b] for b in (0, 1)] for a in (0, 1)], [w["first", 0], w["first", 1]], [w["last", 0], w["last", 1]])


class PageWriter:
    """Writes one labelled page: furniture and article in a layout drawn at random."""

    SYLLABLES = "an be ca de en fo ga hi in ka le mo na or pe ra se ti un vo wa zu".split()

    def __init__(self, rng: random.Random):
        self.rng, self.main, self.out = rng, set(), []

    def words(self, least: int, most: int) -> str:
        r = self.rng
        style = r.random()
        made = ["".join(r.choice(self.SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
        if style < 0.1:
            made = [w.upper() + "!!" for w in made]
        elif style < 0.2:
            made = [w + r.choice(["###", "%%%", "***", "$$$"]) for w in made]
        elif style < 0.27:
            made = [made[0]] * len(made)
        text = " ".join(made)
        return text[0].upper() + text[1:] + r.choice([".", ".", ".", "", "!", "?"])

    def block(self, tag: str, text: str, main: bool, inner: str = "") -> str:
        if main:
            self.main.add(" ".join(text.split()))
        return f"<{tag}>{inner or text}</{tag}>"

    def links(self, tag: str, n: int) -> str:
        texts = [self.words(1, 3) for _ in range(n)]
        return "".join(f'<{tag}><a href="/{t[:5]}">{t}</a></{tag}>' for t in texts)

    def named(self, words: str, tags: str = "div section") -> tuple[str, str]:
        tag = self.rng.choice(tags.split())
        word = self.rng.choice(words.split())
        return f'<{tag} {self.rng.choice(["class", "class", "id"])}="{word}">', f"</{tag}>"

    def wrap(self, bare: str, words: str, body: str, tags: str = "div section") -> str:
        if bare and self.rng.random() < 0.5:
            return f"<{bare}>{body}</{bare}>"
        start, end = self.named(words, bare + " div" if bare else tags)
        return start + body + end

    def furniture(self, kind: str) -> str:
        r, p = self.rng, lambda a, b: self.block(r.choice(["p", "div", "p", "span"]), self.words(a, b), False)
        if kind == "menu":
            return self.wrap("nav", "menu nav navbar navigation breadcrumb toc pagination topics", "<ul>" + self.links("li", r.randint(2, 9)) + "</ul>" if r.random() < 0.7 else self.links("span", r.randint(2, 6)))
        if kind == "header":
            return self.wrap("header", "header masthead banner topbar site-header logo", self.block(r.choice(["h1", "div", "p"]), self.words(1, 8), False) + (p(2, 10) if r.random() < 0.4 else ""))
        if kind == "footer":
            return self.wrap("footer", "footer copyright legal bottom site-footer", "&copy; " + self.words(2, 14) + (self.links("li", 3) if r.random() < 0.4 else ""))
        if kind == "sidebar":
            return self.wrap("aside", "sidebar widget related popular rail trending recommended", f"<h3>{self.words(1, 4)}</h3>" + (self.links("li", r.randint(2, 6)) if r.random() < 0.6 else p(4, 40)))
        if kind == "notice":
            return self.wrap("", "cookie notice alert consent gdpr warning message banner popup modal", p(4, 30))
        if kind == "ad":
            return self.wrap("", "ad ads advert advertisement sponsored promo promotion sponsor", r.choice([self.words(2, 40), p(2, 40)]), "div aside section")
        if kind == "form":
            return f'<form class="{r.choice(["search", "login", "newsletter", "subscribe", "f"])}">' + p(2, 12) + f"<label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind == "share":
            return self.wrap("", "share social tags byline author meta buttons", r.choice([self.links("li", 3), p(1, 6)]))
        comments = "".join(f'<{t}>{self.block("p", self.words(3, 60), False)}</{t}>' for t in [r.choice(["li", "div", "article"])] for _ in range(r.randint(1, 5)))
        return self.wrap("", "comments comment commentlist discussion responses replies reader-comments disqus", f"<h2>{self.words(1, 3)}</h2>" + comments, "div section ol ul")

    def article(self) -> str:
        r, body = self.rng, []
        body.append(self.block(r.choice(["h1", "h1", "h2"]), self.words(1, 14), True))
        for _ in range(r.randint(1, 12)):
            kind, text = r.random(), self.words(1, r.choice([3, 12, 60, 120]))
            if kind < 0.72:
                inner = text if r.random() < 0.7 else "<b>" + text + ("</b>" if r.random() < 0.7 else "<br>")
                body.append(self.block("p", text, True, inner) if r.random() < 0.85 else self.block("p", text, True, inner)[:-4])
            elif kind < 0.8:
                body.append(self.block(r.choice(["h2", "h3"]), text, True))
            elif kind < 0.88:
                body.append(f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(self.block("li", self.words(1, 20), True) for _ in range(r.randint(1, 5))) + f"</{t}>")
            elif kind < 0.94:
                body.append(self.block(r.choice(["blockquote", "pre", "div", "figcaption"]), text, True))
            else:
                body.append("<table><tr>" + self.block("td", text, True) + self.block("td", self.words(1, 6), True) + "</tr></table>")
            if r.random() < 0.12:
                body.append(self.furniture(r.choice(["ad", "share", "sidebar", "form", "menu", "notice"])))
        if r.random() < 0.12:
            body.append(self.furniture(r.choice(["comments", "footer", "share"])))
        return "".join(body)

    def page(self) -> tuple[list[Block], list[int]]:
        r = self.rng
        start, end = r.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>")] * 2 + [self.named("content post article entry story text main article-body entry-content post-content", "div section article td")] * 4 + [("", "")])
        kinds = ["menu", "header", "footer", "sidebar", "notice", "ad", "form", "comments", "share"]
        before = [k for k in r.sample(kinds, 5) if k not in ("footer", "comments") and r.random() < 0.6]
        after = [k for k in r.sample(kinds, 6) if k not in ("header",) and r.random() < 0.6]
        page = f"<html><head><title>{self.words(2, 6)}</title><script>x=1</script></head><body>" + "".join(map(self.furniture, before))
        outer = r.choice(["", "", "<div class='page'>", "<div id=wrapper>", "<div class=container>"])
        page += outer + start + self.article() + end + ("</div>" if outer else "") + "".join(map(self.furniture, after)) + "</body></html>"
        blocks = blocks_of(page)
        return blocks, [int(b.text in self.main) for b in blocks]


def labelled_pages(n: int = 600, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    rng = random.Random(seed)
    return [PageWriter(rng).page() for _ in range(n)]


def trained(n: int = 600, seed: int = 1) -> Crf:
    return fit(labelled_pages(n, seed))


def text_column(spark, crf: Crf):
    shared = spark.sparkContext.broadcast((crf.weights, crf.moves, crf.first, crf.last))

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Crf(*shared.value)
        for pages in parts:
            yield pd.Series([extract(model, p or "") for p in pages], dtype=object)
    return run


def main_text(df: DataFrame, html_col: str = "html", text_col: str = "text", crf: Crf | None = None) -> DataFrame:
    """``df`` with ``text_col``: the page's main text."""
    return df.withColumn(text_col, text_column(df.sparkSession, crf or trained())(F.col(html_col)))
