"""Main text of web pages, by a linear-chain conditional random field over their leaf blocks.

A page is read once into leaf blocks: runs of text between block-level tags, with character references decoded, white
space made one space, and the tags and class words of their ancestors. Unclosed and misnested tags are closed as far as
their block needs; what scripts, styles, titles, templates and controls hold is no block. A block's features are its
ancestors' tags and class words, the nearest tags, its length, links, punctuation, place in the page and, where it is
short, its words; all hashed. Two states, main and other, are tied by transitions; Viterbi decoding takes the best
sequence of a whole page, and the main blocks joined are its text.

Labelled pages. A page with one ``article`` (or, without one, one ``main``) element says what is main: what lies in it,
but not in a part marked as something else. A sample bounded by ``train_pages``, of pages up to ``TRAIN_BYTES``, trains
the field, each page as it is and ``DRESSES`` times dressed anew: its paragraphs in other containers (or none), among
menus, notices, adverts, sidebars, forms, comments and footers in many wrappings, all labelled as they are written. So
the field also knows pages without such elements. Some made-up prose is dressed too, for tables with few labelled pages.
Training runs in one task, by stochastic gradient descent, with expectations from forward-backward; the driver gets the
weights only.

Results: a null or empty page, or one without main blocks, has an empty text. Pages of any size and depth are read whole;
a block knows its outermost 48 distinct ancestor marks. Rows repeat as they come. A kept column that is named as an
output column gives way to it. An empty table gives no rows.
"""

import html
import random
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.llm.common import row_slices

#: Labelled pages that training takes at most, bytes of such a page at most, and how often each is dressed anew.
TRAIN_PAGES = 400
TRAIN_BYTES = 65_536
DRESSES = 3
#: Articles of made-up prose that are dressed too, for tables whose labelled pages are few or all alike.
MADE_UP = 80
BUCKETS = 1 << 16
EPOCHS = 8
RATE = 0.3
SEED = 12
#: Bytes of pages that a task reads at once; a longer page is read alone.
SLICE = 4 << 20
#: Distinct ancestor marks that a block knows.
MARKS = 48

#: Private characters that mark the leaves of dressed pages.
MAIN, OTHER = "\ue000", "\ue001"

# Elements of HTML by how they are read.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template svg math".split())
_HIDDEN = frozenset("head select datalist object canvas audio video button".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr input".split()
)
#: Opening one of these closes an open one of the same kind within the nearest container.
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: A paragraph is closed by any block; containers stop the search for what to close.
_CONTAINERS = frozenset("article aside blockquote body div dl fieldset figure footer form header html main nav ol section table tbody td th ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|</?[a-zA-Z][^\s/<>]*+(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+>|</?[a-zA-Z][^<>]*+>?", re.S
)
_NAME = re.compile(r"[a-zA-Z][^\s/<>]*")
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in _RAW}


class Block(NamedTuple):
    text: str
    tags: tuple[str, ...]
    marks: frozenset
    linked: int
    parent: int


class _Open(NamedTuple):
    tag: str
    marks: frozenset
    number: int


def _marks_of(tag: str, attributes: str, above: frozenset) -> frozenset:
    if len(above) >= MARKS:
        return above
    found = {tag}
    for groups in _MARKS.findall(attributes):
        for name in groups:
            found.update("." + w.lower().removesuffix("s") for w in _WORD.findall(name[:200]))
    return above if found <= above else above | found


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in their order."""
    out: list[Block] = []
    stack = [_Open("", frozenset(), 0)]
    parts: list[str] = []
    numbers = linked = hidden = at = 0
    in_link = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, tuple(o.tag for o in stack[:0:-1][:3]), top.marks, min(linked, len(text)), top.number))
            parts, linked = [], 0

    def say(text):
        nonlocal linked
        if hidden or not text:
            return
        text = html.unescape(text) if "&" in text else text
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    def close(names, within):
        """Close the nearest open element of these names, and all in it."""
        nonlocal hidden
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                hidden -= sum(o.tag in _HIDDEN for o in stack[i:])
                del stack[i:]
                return
            if within and stack[i].tag in _CONTAINERS:
                return

    while at < len(page):
        token = _TOKEN.search(page, at)
        if not token:
            say(page[at:])
            break
        say(page[at : token.start()])
        at = token.end()
        tag = token.group()
        if tag[1] in "!?":
            continue
        name = _NAME.search(tag).group().lower()
        ends = tag[1] == "/"
        if name == "br":
            say(" ")
        elif name == "a":
            in_link = not ends
        elif name in _INLINE:
            continue
        elif name in _RAW:
            if not ends and not tag.endswith("/>"):
                stop = _RAW_END[name].search(page, at)
                at = stop.end() if stop else len(page)
        else:
            flush()
            if ends:
                close((name,), False)
                continue
            if name in _VOID:
                continue
            if stack[-1].tag == "head":
                close(("head",), False)
            close(_CLOSES.get(name, ("p",)), True)
            if name in _CLOSES and name != "p":
                close(("p",), True)
            numbers += 1
            stack.append(_Open(name, _marks_of(name, tag, stack[-1].marks), numbers))
            hidden += name in _HIDDEN
            in_link = False
    flush()
    return out


@lru_cache(maxsize=200_000)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


@lru_cache(maxsize=20_000)
def _place_features(tags: tuple[str, ...], marks: frozenset) -> tuple[int, ...]:
    near = [f"n{i}:{t}" for i, t in enumerate(tags)]
    return tuple(_bucket(f) for f in (*(f"a:{m}" for m in marks), *near, "t:" + ">".join(tags[:2])))


def _share(part: float, whole: float) -> int:
    return 0 if part <= 0 else 3 if part >= 0.9 * whole else 1 if part < 0.33 * whole else 2


_SHORT_WORD = re.compile(r"[^\W\d_]+")


def features(page: list[Block]) -> list[list[int]]:
    """The hashed features of each block of a page."""
    out = []
    for i, b in enumerate(page):
        size = len(b.text)
        length, links = size.bit_length(), _share(b.linked, size)
        stops = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + (b.text[-1] in ".?!…")
        near = b.tags[0] if b.tags else ""
        names = [
            "one", f"l:{length}", f"k:{links}", f"lk:{length}:{links}", f"nl:{near}:{min(length, 8)}", f"s:{min(stops, 4)}", f"e:{b.text[-1] in '.?!…:;,'}",
            f"d:{_share(sum(map(str.isdigit, b.text[:200])), min(size, 200))}", f"c:{b.text[0].isupper()}", f"f:{min(i, 3)}", f"z:{min(len(page) - 1 - i, 3)}",
            f"w:{bool(i) and page[i - 1].parent == b.parent}", f"r:{'©' in b.text or '|' in b.text or '»' in b.text}",
        ]
        if size <= 30 and not stops:
            names += ["x:" + w.lower() for w in _SHORT_WORD.findall(b.text)]
        out.append([*_place_features(b.tags, b.marks), *map(_bucket, names)])
    return out


class Field(NamedTuple):
    """weights: by bucket, what a feature adds to the main state; moves: log weights of state and next state; start: of main."""

    weights: np.ndarray
    moves: np.ndarray
    start: float


def marginals(emission: np.ndarray, moves: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """P(main) of each block of a page, and the expected counts of moves, by forward-backward."""
    n = len(emission)
    score = np.stack([np.zeros(n), emission], axis=1)
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    forward[0] = score[0] + (0.0, start)
    for t in range(1, n):
        forward[t] = score[t] + np.logaddexp(forward[t - 1, 0] + moves[0], forward[t - 1, 1] + moves[1])
    for t in range(n - 2, -1, -1):
        after = score[t + 1] + backward[t + 1]
        backward[t] = np.logaddexp(moves[:, 0] + after[0], moves[:, 1] + after[1])
    total = np.logaddexp(*forward[-1])
    p = np.exp(forward[:, 1] + backward[:, 1] - total)
    pairs = forward[:-1, :, None] + moves + (score[1:] + backward[1:])[:, None, :] - total
    return p, np.exp(pairs).sum(axis=0)


def viterbi(emission: list[float], moves, start: float) -> list[bool]:
    """The best states of a page's blocks; of equal sequences the one with other for main, from the end."""
    if not emission:
        return []
    (oo, om), (mo, mm) = moves
    other, main, back = 0.0, start + emission[0], []
    for e in emission[1:]:
        back.append((main + mo > other + oo, main + mm > other + om))
        other, main = max(other + oo, main + mo), max(other + om, main + mm) + e
    out = [main > other]
    for from_other, from_main in reversed(back):
        out.append(from_main if out[-1] else from_other)
    return out[::-1]


def fit(pages: list[tuple[list[list[int]], list[bool]]], seed: int = SEED) -> Field:
    """A field from pages, each given by its blocks' features and labels."""
    weights, moves, start = np.zeros(BUCKETS), np.zeros((2, 2)), 0.0
    square, square_moves, square_start = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6), 1e-6
    made = []
    for blocks, labels in pages:
        if blocks:
            made.append((np.concatenate(blocks), np.cumsum([0] + [len(b) for b in blocks]), np.array(labels, np.int64)))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(made)):
            ids, bounds, y = made[i]
            p, expected = marginals(np.add.reduceat(weights[ids], bounds[:-1]), moves, start)
            touched, place = np.unique(ids, return_inverse=True)
            grade = np.bincount(place, np.repeat(p - y, np.diff(bounds))) + 1e-3 * weights[touched]
            square[touched] += grade**2
            weights[touched] -= RATE * grade / np.sqrt(square[touched])
            seen = np.bincount(2 * y[:-1] + y[1:], minlength=4).reshape(2, 2)
            square_moves += (expected - seen) ** 2
            moves -= 0.1 * (expected - seen) / np.sqrt(square_moves)
            square_start += (p[0] - y[0]) ** 2
            start -= 0.1 * (p[0] - y[0]) / np.sqrt(square_start)
    return Field(weights.astype(np.float32), moves, float(start))


# Labelled pages ------------------------------------------------------------------------------------------------------

#: Marks by which a part within the main element is something else.
_ASIDE = frozenset(
    "nav aside footer form .ad .advert .advertisement .sponsored .promo .comment .respond .sidebar .related .share .sharing .social .newsletter "
    ".subscribe .cookie .notice .banner .menu .breadcrumb".split()
)


def labels_by_markup(page: list[Block]) -> list[bool] | None:
    """Which blocks the page's own main element holds; None where the page has no such element."""
    for element in ("article", "main"):
        inside = [element in b.marks for b in page]
        if any(inside):
            return [held and not b.marks & _ASIDE for held, b in zip(inside, page)]
    return None


# How other parts of pages are usually written: (wrappings, short texts). A wrapping is a tag with its attributes.
_PARTS = {
    "menu": (
        "nav|ul class=menu|div class=navbar|div id=nav|div class=main-menu|div class=breadcrumbs|header class=site-header|div role=navigation|ul class=navigation|div class=top-links",
        "Home|About|About us|Contact|News|Blog|Products|Services|Archive|Login|Sign in|Register|Search|Sitemap|Help|FAQ|Next|Previous|Sports|Politics|Culture|Shop",
    ),
    "header": (
        "header|div class=header|div id=header|div class=site-title|div class=masthead|div class=banner|div id=top|div class=logo|div role=banner",
        "The Daily Page|Welcome|Your source for stories|My Site|Skip to content|Menu|Weekly|Journal|Breaking news|Official site",
    ),
    "notice": (
        "div class=cookie-notice|div class=notice|div class=alert|div id=cookie-banner|div class=consent|div class=gdpr|div role=alert|section class=notice|div class=message|div class=disclaimer|p class=notice|div class=warning",
        "We use cookies to improve your experience. Accept|This site uses cookies.|Accept all cookies|Please enable JavaScript.|You have 3 free articles left.|Subscribe to continue reading|"
        "By using this site you agree to our terms.|We value your privacy|Privacy settings|Your browser is out of date.",
    ),
    "advert": (
        "div class=ad|div class=ads|div class=advert|div class=advertisement|aside class=ad|div class=sponsored|div id=ad-top|div class=promo|ins class=adsbygoogle|div class=banner-ad|section class=sponsored|div class=adslot",
        "Advertisement|Sponsored|Buy now|Limited offer!|Save 50% today|Ad|Free shipping on all orders|Order now|Best deals|Click here|Promoted|Learn more",
    ),
    "sidebar": (
        "aside|aside class=sidebar|div class=sidebar|div id=sidebar|div class=widget|div class=related|div class=related-posts|section class=popular|div role=complementary|div class=recommended|div class=tags|div class=share|div class=social|ul class=archive",
        "Related articles|Popular posts|Read more|Recent posts|Tags|Categories|Archives|Share|Tweet|Follow us|You may also like|Most read|Trending|Share this|Print|Email this|Author",
    ),
    "form": (
        "form|form class=search|form id=newsletter|div class=newsletter|form class=signup|div class=subscribe|form action=/login|div class=search-box|fieldset|div class=contact-form",
        "Name|Email|Your email address|Subscribe|Submit|Search|Password|Sign up for our newsletter|Send|Message|Remember me|Enter your email|Your name",
    ),
    "comments": (
        "section class=comments|div id=comments|div class=comments|div class=comment-list|ol class=commentlist|div class=comment|section id=responses|div class=discussion|div id=disqus-thread|div class=replies|ul class=comments|aside class=comments|section class=reader-comments|div class=user-comment",
        "Comments|3 comments|Leave a reply|Reply|Post a comment|Great post!|Thanks for sharing.|I agree.|anonymous says:|Posted by guest|Report|Like|Leave a comment|First!|Show more comments",
    ),
    "footer": (
        "footer|div class=footer|div id=footer|div class=copyright|footer class=site-footer|div class=bottom|div role=contentinfo|div class=legal|div class=colophon",
        "© 2024 All rights reserved.|Privacy policy|Terms of use|Copyright|Imprint|Contact us|About|All rights reserved|Powered by a blog|Back to top|Cookie policy|© example.com",
    ),
}
_HOMES = (
    "article|main|div class=content|div id=content|div class=post|div class=entry-content|div class=article-body|div class=story|section class=article|div class=post-content|div class=text|"
    "div id=main|main class=content|article class=post|div class=page-content|section|div|td|div class=body|article class=entry"
).split("|")


def _element(spec: str, inner: str) -> str:
    tag, _, rest = spec.partition(" ")
    attribute = f' {rest.replace("=", "=" + chr(34), 1)}"' if rest else ""
    return f"<{tag}{attribute}>{inner}</{tag}>"


def dressed(paragraphs: list[str], prose: list[str], rng: random.Random) -> str:
    """A page of these paragraphs among other parts; each leaf begins with MAIN or OTHER. ``prose`` fills other parts."""

    def leaf(text, mark):
        return mark + html.escape(text, quote=False)

    def part(kind):
        wrappings, words = (x.split("|") for x in _PARTS[kind])
        long = kind in ("comments", "advert", "notice", "sidebar", "footer", "header") and prose
        texts = [rng.choice(words) for _ in range(rng.choice((1, 1, 2, 4, 6)))]
        if long and rng.random() < 0.6:
            texts += [rng.choice(prose) for _ in range(rng.randint(1, 3))]
        made = []
        for text in texts:
            body = leaf(text, OTHER)
            if kind in ("menu", "sidebar", "footer") and rng.random() < 0.7 or rng.random() < 0.1:
                body = f'<a href="/x">{body}</a>'
            inner = {"menu": "li", "form": "label"}.get(kind, "p")
            if text is texts[0] and rng.random() < 0.3:
                inner = rng.choice(("h1", "h2") if kind == "header" else ("h2", "h3", "h3", "h4"))
            made.append(f"<{inner}>{body}</{inner}>" if rng.random() < 0.7 else f"<div>{body}</div>")
        if kind == "form":
            made = [m + "<br>" if m.startswith("<label") else m + "<input>" for m in made]
            made = ["<div>" + m + "</div>" for m in made]
        if kind == "menu" and rng.random() < 0.7:
            made = ["<ul>" + "".join(made) + "</ul>"]
        if len(texts) == 1 and rng.random() < 0.5:
            made = [leaf(texts[0], OTHER)]
        whole = _element(rng.choice(wrappings), "".join(made))
        return _element(rng.choice(("div", "div class=row", "section")), whole) if rng.random() < 0.15 else whole

    body = []
    short = 0.7 if rng.random() < 0.25 else 0.15
    for i, text in enumerate(paragraphs):
        if rng.random() < short:
            text = text[: rng.randint(8, 80)].rsplit(" ", 1)[0].rstrip(".,") + (rng.choice((".", ".", "!", "")) if i else "")
        tag = rng.choice(("h1", "h1", "h2")) if i == 0 else rng.choice(("p",) * 12 + ("h2", "h3", "blockquote", "li", "div", "pre", "td"))
        inner = leaf(text, MAIN)
        cut = inner.find(" ", 5)
        if cut > 0 and rng.random() < 0.2:
            inner = f"{inner[:cut]}<{rng.choice(('b', 'em', 'br', 'span'))}>{inner[cut:]}"
        if rng.random() < 0.06:
            inner = inner.replace(MAIN, MAIN + '<a href="/y">', 1) + "</a>"
        made = f"<{tag}>{inner}" + (f"</{tag}>" if rng.random() < 0.9 or tag in ("h1", "h2", "h3", "td", "div", "pre", "blockquote") else "")
        made = {"li": f"<ul>{made}</ul>", "td": f"<table><tr>{made}</tr></table>"}.get(tag, made)
        body.append(f"<header>{made}</header>" if i == 0 and rng.random() < 0.15 else made)
    for kind, often in (("advert", 0.3), ("notice", 0.2), ("sidebar", 0.25), ("form", 0.15)):
        if rng.random() < often:
            body.insert(rng.randint(1, len(body)), part(kind))
    if rng.random() < 0.3:
        body.append(part("comments"))
    home = rng.choice(_HOMES)
    whole = "".join(body) if rng.random() < 0.08 else _element(home, "".join(body))
    if rng.random() < 0.3:
        whole = _element(rng.choice(("div id=wrapper", "div class=container", "main", "div class=page", "section")), whole)
    before = [part(k) for k, often in (("notice", 0.35), ("header", 0.6), ("menu", 0.8), ("form", 0.2), ("advert", 0.5), ("sidebar", 0.25)) if rng.random() < often]
    after = [part(k) for k, often in (("comments", 0.45), ("sidebar", 0.4), ("form", 0.3), ("advert", 0.3), ("footer", 0.85), ("notice", 0.2)) if rng.random() < often]
    rng.shuffle(before)
    if rng.random() < 0.1:
        before, after = [], []
    return f"<html><head><title>x</title></head><body>{''.join(before)}{whole}{''.join(after)}</body></html>"


def labelled_blocks(page: str) -> tuple[list[Block], list[bool]]:
    """The blocks of a dressed page without their marks, and which are main."""
    found = blocks_of(page)
    clean = [b._replace(text=b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-") for b in found]
    return clean, [MAIN in b.text for b in found]


def made_up_prose(rng: random.Random, n: int) -> list[str]:
    """Paragraphs of invented words, for tables without labelled pages."""

    def word():
        return "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))

    def sentence():
        return " ".join(word() for _ in range(rng.randint(4, 18))).capitalize() + "."

    return [" ".join(sentence() for _ in range(rng.choice((1, 2, 4, 8)))) for _ in range(n)]


def training_pages(pages: list[str], seed: int = SEED) -> list[tuple[list[list[int]], list[bool]]]:
    """Features and labels of the pages as they are, and dressed anew."""
    rng = random.Random(seed)
    out, bodies = [], []
    for page in pages:
        blocks = blocks_of(page)
        labels = labels_by_markup(blocks)
        if labels and any(labels):
            out.append((features(blocks), labels))
            bodies.append([b.text for b, main in zip(blocks, labels) if main])
    bodies += [made_up_prose(rng, rng.randint(2, 14)) for _ in range(MADE_UP)]
    for i, body in enumerate(bodies):
        # Other parts are filled with other pages' prose, so that prose alone tells nothing.
        prose = [t for t in bodies[(i + 1) % len(bodies)] if len(t) < 1_000][:8] + made_up_prose(rng, 2)
        for _ in range(DRESSES):
            most = rng.choice((2, 4, 8, 16, 64))
            blocks, labels = labelled_blocks(dressed(body[:most], prose, rng))
            out.append((features(blocks), labels))
    return out


def train(pages: DataFrame, html: str = "html", train_pages: int = TRAIN_PAGES) -> Field:
    """A field from the pages whose own markup names their main element."""
    short = pages.select(F.col(html).alias("html")).filter((F.octet_length("html") <= TRAIN_BYTES) & F.lower("html").rlike("<(article|main)[\\s>]"))
    place = F.xxhash64("html")
    # Only pages below a hash that about four times as many pass are sorted.
    share = 4 * train_pages / max(1, short.count())
    near = short.withColumn("place", place).filter(F.pmod("place", F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30))).orderBy("place").limit(train_pages)

    def task(batches):
        texts = [t for batch in batches for t in batch.column("html").to_pylist()]
        field = fit(training_pages(sorted(texts)))
        yield pa.RecordBatch.from_pydict({"weights": [field.weights.tobytes()], "moves": [field.moves.tobytes()], "start": [field.start]})

    found = near.select("html").repartition(1).mapInArrow(task, "weights binary, moves binary, start double").first()
    if found is None:
        return fit(training_pages([]))
    return Field(np.frombuffer(found["weights"], np.float32), np.frombuffer(found["moves"]).reshape(2, 2), found["start"])


def main_text(page: str | None, field: Field, weights: list[float]) -> str:
    """The main text of a page; ``weights`` are the field's as a list."""
    blocks = blocks_of(page or "")
    emission = [sum(map(weights.__getitem__, ids)) for ids in features(blocks)]
    states = viterbi(emission, field.moves.tolist(), field.start)
    return " ".join(b.text for b, main in zip(blocks, states) if main)


def extract(pages: DataFrame, field: Field, html: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (all by default) with main_text."""
    keep = tuple(c for c in (pages.columns if keep is None else keep) if c != "main_text")
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        weights = shared.value.weights.tolist()
        for batch in batches:
            for at, n in row_slices(batch.column("__html"), SLICE):
                part = batch.slice(at, n)
                texts = [main_text(p, shared.value, weights) for p in part.column("__html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "main_text"])

    rows = pages.select(*keep, F.col(html).alias("__html"))
    return rows.mapInArrow(run, T.StructType([*[pages.schema[c] for c in keep], T.StructField("main_text", T.StringType())]))


def op12(spark, sf_dir):
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = extract(pages, train(pages), keep=("page_id", "url"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))
