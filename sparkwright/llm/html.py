"""HTML extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: runs of text between block-level tags. Each
block has features of its ancestors (tags and the words of class, id and role) and of
its text (length, share of links, punctuation, form). The field's two states are main
text and the rest. Its weights are trained by gradient ascent on the conditional
log-likelihood of labelled pages and a page is decoded by Viterbi.

The labelled pages are written here by a seeded generator (``labelled_pages``): layouts
with menus, headers, sidebars, notices, adverts, forms, comments and footers about an
article, in invented words. So training is bounded, the same everywhere, and reads no corpus.

Only scripts and styles are left out before the field sees a page; everything else is its decision. A page is read in
one pass, in time and memory that follow its length: an element knows its parent and which of its tag and names no
ancestor has, so that a block's ancestors are one sum.

Defined results: null, empty or text-free html gives the empty string; character
references are decoded once (numbers of 8 digits or more are U+FFFD); white space inside a block becomes one space; broken
markup is read as far as tags can be told: a tag that no ``>`` ends is text, an end tag that nothing opened is
ignored, what is open at the end of the page ends there; repeated rows each have a result; states that tie are not main
text; pages of any length and depth are read whole; only page_id, url and html are read, whatever other columns there are; an empty table
gives no rows.
"""

import html as references
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents

TRAINING_PAGES, STEPS, RATE, L2 = 300, 120, 0.2, 1e-3

#: Elements by the HTML standard.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object param svg g path text tspan defs use".split())
#: Of MathML, whose text is part of the line that it stands in.
INLINE |= set("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose mfenced maction msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr semantics annotation annotation-xml".split())
HIDDEN = "script|style"

TAG = re.compile(
    rf"<!--.*?(?:(?P<ended>-->)|\Z)|<(?P<hidden>{HIDDEN})(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:(?P<ended2></(?P=hidden)\s*+>)|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][\w:-]*+)(?P<attributes2>[^>]*+)>|<[!?][^>]*+>",
    re.S | re.I,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
WORD = re.compile(r"[a-z]+")
#: Numeric references that are no code point; Python refuses to read very long ones.
HUGE = re.compile(r"&#(?:0*+[0-9]{8,}+|[xX]0*+[0-9a-fA-F]{7,}+);?")


class Element:
    """An open element: its parent, its tag, and those of its tag and names that no ancestor has."""

    __slots__ = ("parent", "tag", "fresh", "named", "gain")

    def __init__(self, parent, tag, fresh, named):
        self.parent, self.tag, self.fresh, self.named, self.gain = parent, tag, fresh, named, None


def leaf_blocks(page: str | None) -> list[tuple[str, int, Element | None]]:
    """(text, characters inside links, innermost element) of each block with text."""
    page = page or ""
    out, stack, parts, linked, links = [], [], [], 0, 0
    tags: dict[str, int] = {}  # of open elements, how many have a tag, a name
    names: dict[str, int] = {}
    own_names: list[tuple] = []

    def close_block():
        nonlocal parts, linked
        if parts:
            text = " ".join(references.unescape(HUGE.sub("\ufffd", "".join(parts))).split())
            if text:
                out.append((text, min(linked, len(text)), stack[-1] if stack else None))
        parts, linked = [], 0

    def add(text):
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text)

    def pop():
        tags[stack.pop().tag] -= 1
        for n in own_names.pop():
            names[n] -= 1

    at = 0
    for tag in TAG.finditer(page, 0, page.rfind(">") + 1):  # beyond the last > there is no tag's end to look for
        if tag.start() > at:
            add(page[at : tag.start()])
        at = tag.end()
        if (tag["hidden"] or page.startswith("<!--", tag.start())) and not (tag["ended"] or tag["ended2"]):
            at = len(page)  # what is not ended hides the rest
        name = tag["name"] or tag["name2"]
        if name is None:
            continue
        name, closing = name.lower(), bool(tag["close"] or tag["close2"])
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            elif name == "br":
                parts.append(" ")
            continue
        close_block()
        links = 0
        attributes = tag["attributes"] or tag["attributes2"] or ""
        if closing:
            if tags.get(name):
                while stack[-1].tag != name:
                    pop()
                pop()
        elif name not in VOID and not attributes.endswith("/"):
            if stack and stack[-1].tag == "p" or name in ("li", "dt", "dd", "option", "td", "th", "tr") and stack and stack[-1].tag == name:
                pop()  # these end where the next block begins
            own = tuple(dict.fromkeys(WORD.findall(" ".join(x for found in NAMES.findall(attributes) for x in found).lower())))
            fresh = [*([] if tags.get(name) else [f"in {name}"]), *(f"name {n}" for n in own if not names.get(n))]
            tags[name] = tags.get(name, 0) + 1
            for n in own:
                names[n] = names.get(n, 0) + 1
            parent = stack[-1] if stack else None
            stack.append(Element(parent, name, fresh, bool(own) or parent is not None and parent.named))
            own_names.append(own)
    if at < len(page):
        add(page[at:].partition("<!--")[0])
    close_block()
    return out


def own_features(element: Element | None) -> list[str]:
    """Of a block in an element, besides the elements' own."""
    return [f"leaf {element.tag if element else '-'}", "named" if element and element.named else "unnamed"]


def ancestor_features(element: Element | None) -> list[str]:
    out, at = own_features(element), element
    while at is not None:
        out += at.fresh
        at = at.parent
    return out


def text_features(text: str, linked: int, place: float) -> list[str]:
    n = len(text)
    marks = sum(map(text.count, ".,;:!?"))
    return [
        f"length {min(8, int(math.log2(n + 1)))}",
        f"links {min(3, int(4 * linked / n))}",
        f"marks {min(3, int(60 * marks / n))}",
        f"ends {text[-1] in '.!?\"'}",
        f"sign {'©' in text or '·' in text or '|' in text or '»' in text}",
        f"digits {sum(map(str.isdigit, text)) * 4 > n}",
        f"place {min(3, int(place * 4))}",
    ]


def features(blocks) -> list[list[str]]:
    n = len(blocks)
    return [ancestor_features(a) + text_features(t, l, k / n) for k, (t, l, a) in enumerate(blocks)]


# --- labelled pages ---------------------------------------------------------------------

SYLLABLES = "ba be bi bo bu ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu ra re ri ro ru sa se si so su ta te ti to tu en er on an ist ung tion ment".split()
#: Names that pages commonly give to these parts.
REST = {
    "advert": "ad ads advert advertisement sponsor sponsored banner promo promotion".split(),
    "notice": "notice cookie cookies consent alert popup modal newsletter subscribe message warning".split(),
    "menu": "nav navbar menu breadcrumb breadcrumbs pagination tabs toc links".split(),
    "side": "sidebar side widget related recommended popular trending more tags share social meta author byline".split(),
    "comments": "comment comments replies reply discussion respond disqus thread reader".split(),
    "head": "header top masthead logo branding site title".split(),
    "foot": "footer bottom copyright legal imprint credits".split(),
}
MAIN = "content main article post entry story body text single page".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7):
    """(html, [(block text, True for main text), ...]) of generated pages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))

    def sentence(least, most):
        s = " ".join(word() for _ in range(rng.randint(least, most)))
        return s.capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose():
        text = " ".join(sentence(1, 18) for _ in range(rng.choice([1, 1, 2, 3, 4, 7])))
        roll = rng.random()
        if roll < 0.1:  # tables, code, shouting and symbols occur in main text too
            return text.replace(" ", " | ")
        if roll < 0.15:
            return " ".join(w + rng.choice(["###", "%", "$$", "· ", "©", "» "]) for w in text.split())
        if roll < 0.2:
            return text.upper() + "!!"
        return " ".join(w if rng.random() < 0.6 else str(rng.randint(1, 10**9)) for w in text.split()) if roll < 0.25 else text

    for _ in range(n):
        truth: list[tuple[str, bool]] = []

        def block(tag, text, main, attributes="", truth=truth):
            truth.append((" ".join(text.split()), main))
            inner = text
            if rng.random() < 0.15:
                a, _, b = text.partition(" ")
                inner = f"<b>{a}</b> {b}"
            return f"<{tag}{attributes}>{inner}</{tag}>"

        def named(kind):
            return rng.choice([' class="{}"', ' id="{}"', ' class="{}"']).format(" ".join(rng.sample(REST[kind], rng.choice([1, 1, 2]))))

        def listing(rng=rng, block=block):
            items = "".join(block("li", f'<a href="/{word()}">{(w := " ".join(word() for _ in range(rng.randint(1, 3))))}</a>', False) if rng.random() < 0.9 else block("li", word(), False) for _ in range(rng.randint(2, 7)))
            return f"<ul>{items}</ul>"

        def rest(kind):
            if kind == "menu":
                return rng.choice(["<nav>{}</nav>", f"<div{named('menu')}>{{}}</div>", f"<nav{named('menu')}>{{}}</nav>"]).format(listing())
            if kind == "head":
                tag = rng.choice(["header", "div" + named("head")])
                return f"<{tag}>{block('div', sentence(1, 4), False)}{listing() if rng.random() < 0.5 else ''}</{tag.split()[0]}>"
            if kind == "foot":
                tag = rng.choice(["footer", "footer", "div" + named("foot")])
                own = f"© {word()} · {sentence(1, 6)}"
                truth.append((own, False))
                return f"<{tag}>{own}</{tag.split()[0]}>"
            if kind == "form":
                own = block("label", word(), False) + "<input name=q>"
                if rng.random() < 0.4:
                    own += "<select name=s>" + "".join(block("option", word(), False) for _ in range(rng.randint(1, 3))) + "</select>"
                if rng.random() < 0.3:
                    own += block("textarea", sentence(1, 8), False)
                own += block("button", word(), False)
                return f"<form>{own}</form>" if rng.random() < 0.8 else f"<div>{own}</div>"
            if kind == "side":
                tag = rng.choice(["aside", "aside" + named("side"), "div" + named("side")])
                return f"<{tag}>{block('h3', sentence(1, 3), False)}{listing() if rng.random() < 0.5 else block('p', prose(), False)}</{tag.split()[0]}>"
            if kind == "comments":
                tag = rng.choice(["section", "div", "ul", "ol"])
                item = "li" if tag in ("ul", "ol") else "div"
                own = "".join(f"<{item}{named('comments')}>{block('p', prose(), False)}</{item}>" for _ in range(rng.randint(1, 5)))
                return f"<{tag}{named('comments')}>{block('h2' if tag in ('section', 'div') else 'li', sentence(1, 3), False)}{own}</{tag}>"
            tag = rng.choice(["div", "div", "section", "aside", "p"])
            if tag == "p" or rng.random() < 0.4:
                own = prose()
                truth.append((own, False))
                return f"<{tag}{named(kind)}>{own}</{tag}>"
            return f"<{tag}{named(kind)}>{block('p', prose(), False)}</{tag}>"

        title = sentence(1, 10)
        page = [f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title><style>p{{}}</style></head><body>"]
        truth.append((title, False))
        page += [rest(k) for k in rng.sample(["menu", "head", "advert", "notice", "side", "form", "menu", "advert"], rng.randint(1, 5))]
        wrapper = rng.choice(["article", "article", "article", f'article class="{rng.choice(MAIN)}"', "main", f'div class="{rng.choice(MAIN)}"', f'div id="{rng.choice(MAIN)}"', f'div class="{rng.choice(MAIN)}-{rng.choice(MAIN)}"', f'section class="{rng.choice(MAIN)}"'])
        outer = rng.random() < 0.25
        page += ["<main>" if outer else "", f"<{wrapper}>"]
        page.append(block(rng.choice(["h1", "h1", "h2"]), title if rng.random() < 0.6 else sentence(1, 10), True))
        for _ in range(rng.choice([1, 2, 3, 5, 8, 12, 18])):
            roll = rng.random()
            if roll < 0.75:
                page.append(block("p", prose(), True))
            elif roll < 0.8:
                page.append(block(rng.choice(["h2", "h3"]), sentence(1, 6), True))
            elif roll < 0.85:
                page.append("<ul>" + "".join(block("li", sentence(1, 12), True) for _ in range(rng.randint(1, 4))) + "</ul>")
            elif roll < 0.89:
                page.append(f"<blockquote>{block('p', prose(), True)}</blockquote>")
            elif roll < 0.92:
                page.append(block("pre", prose(), True))
            elif roll < 0.925:
                page.append(f"<{(t := rng.choice(['noscript', 'details', 'figure', 'template']))}>{block('p', prose(), True)}</{t}>")
            elif roll < 0.94:
                page.append("<table><tr>" + "".join(block("td", sentence(1, 3), True) for _ in range(2)) + "</tr></table>")
            else:
                page.append(rest(rng.choice(["advert", "notice", "side", "form"])))
        if rng.random() < 0.2:
            page.append(rest("comments"))
        page += [f"</{wrapper.split()[0]}>", "</main>" if outer else ""]
        page += [rest(k) for k in rng.sample(["comments", "side", "advert", "form", "menu", "notice"], rng.randint(0, 3))]
        page.append(rest("foot"))
        yield "".join(page) + "</body></html>", truth


# --- the field --------------------------------------------------------------------------


def train(pages=None, steps: int = STEPS) -> dict:
    """Weights: feature -> log-odds of main text; transition, start and end scores. Adam on the penalised log-likelihood."""
    index: dict[str, int] = {}
    xs, ys = [], []
    for page, truth in pages or labelled_pages():
        blocks = leaf_blocks(page)
        known: dict[str, list[bool]] = {}
        for text, main in truth:
            known.setdefault(" ".join(references.unescape(re.sub(r"<[^>]*>", "", text)).split()), []).append(main)
        labels = [queue.pop(0) if (queue := known.get(t)) else False for t, _, _ in blocks]
        xs.append([[index.setdefault(f, len(index)) for f in own] for own in features(blocks)])
        ys.append(labels)
    n, longest = len(xs), max(map(len, xs))
    row = np.array([i * longest + t for i, x in enumerate(xs) for t, own in enumerate(x) for _ in own])
    col = np.array([f for x in xs for own in x for f in own])
    mask, y = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    for i, labels in enumerate(ys):
        mask[i, : len(labels)], y[i, : len(labels)] = True, labels
    last = mask.sum(axis=1) - 1
    pages_at, w, size = np.arange(n), np.zeros(len(index) + 8), len(index)
    first, second = np.zeros_like(w), np.zeros_like(w)
    pair_mask = mask[:, 1:]
    truth_pairs = np.zeros((2, 2))
    np.add.at(truth_pairs, (y[:, :-1][pair_mask], y[:, 1:][pair_mask]), 1)
    for step in range(1, steps + 1):
        score = np.zeros((n, longest, 2))
        score[..., 1] = np.bincount(row, w[col], n * longest).reshape(n, longest)
        move, start, end = w[size : size + 4].reshape(2, 2), w[size + 4 : size + 6], w[size + 6 :]
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = start + score[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(forward[:, t - 1, 0, None] + move[0], forward[:, t - 1, 1, None] + move[1]) + score[:, t]
            forward[:, t] = np.where(mask[:, t, None], new, forward[:, t - 1])
        total = np.logaddexp(*(forward[pages_at, last] + end).T)
        backward[pages_at, last] = end
        for t in range(longest - 2, -1, -1):
            after = backward[:, t + 1] + score[:, t + 1]
            new = np.logaddexp(move[:, 0] + after[:, 0, None], move[:, 1] + after[:, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None], new, backward[:, t])
        p = np.exp(forward + backward - total[:, None, None]) * mask[..., None]
        gradient = np.zeros_like(w)
        gradient[:size] = np.bincount(col, (y - p[..., 1]).ravel()[row], size)
        joint = np.exp(forward[:, :-1, :, None] + move + (score + backward)[:, 1:, None, :] - total[:, None, None, None]) * pair_mask[..., None, None]
        gradient[size : size + 4] = (truth_pairs - joint.sum(axis=(0, 1))).ravel()
        gradient[size + 4 : size + 6] = np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(axis=0)
        gradient[size + 6 :] = np.bincount(y[pages_at, last], minlength=2) - p[pages_at, last].sum(axis=0)
        gradient = gradient / n - L2 * w
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w += RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return {"weights": {f: float(w[k]) for f, k in index.items()}, "move": w[size : size + 4].reshape(2, 2).tolist(), "start": w[size + 4 : size + 6].tolist(), "end": w[size + 6 :].tolist()}


class Extractor:
    def __init__(self, model: dict):
        self.model, self.weights = model, model["weights"]

    def gain(self, element: Element | None) -> float:
        """The sum over an element and its ancestors; each element's is made once."""
        way = []
        while element is not None and element.gain is None:
            way.append(element)
            element = element.parent
        total = element.gain if element is not None else 0.0
        for e in reversed(way):
            total = e.gain = total + sum(self.weights.get(f, 0.0) for f in e.fresh)
        return total

    def main_blocks(self, blocks) -> list[bool]:
        """Viterbi."""
        weights, (to0, to1), n = self.weights, self.model["move"], len(blocks)
        back: list[tuple[int, int]] = []
        rest, main = self.model["start"]
        for k, (text, linked, element) in enumerate(blocks):
            fixed = self.gain(element) + sum(weights.get(f, 0.0) for f in own_features(element))
            gain = fixed + sum(weights.get(f, 0.0) for f in text_features(text, linked, k / n))
            if k:
                a, b, c, d = rest + to0[0], main + to1[0], rest + to0[1], main + to1[1]
                back.append((int(b > a), int(d > c)))
                rest, main = max(a, b), max(c, d)
            main += gain
        state = int(main + self.model["end"][1] > rest + self.model["end"][0])
        states = [state]
        for pointers in reversed(back):
            state = pointers[state]
            states.append(state)
        return [bool(s) for s in reversed(states)]

    def text(self, page: str | None) -> str:
        blocks = leaf_blocks(page)
        if not blocks:
            return ""
        return "\n".join(t for (t, _, _), main in zip(blocks, self.main_blocks(blocks), strict=True) if main)


def extracted(pages: DataFrame, model: dict) -> DataFrame:
    """page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        extractor = Extractor(held.value)
        for batch in batches:
            found = [extractor.text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(documents(spark, sf_dir, "pages"), train())
