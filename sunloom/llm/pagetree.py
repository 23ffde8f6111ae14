"""Web pages as trees of block elements, and made-up labelled pages to learn from."""
from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass, field

#: fixed values: what HTML says about elements
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style title noscript template iframe svg object canvas audio video select textarea button datalist head".split())
RAW = frozenset("script style title textarea noscript iframe template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark meter nobr output progress q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math annotation menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: what an open head can hold; any other element, or text, ends it, as </head> may be left out
IN_HEAD = frozenset("base link meta title style script noscript template".split())
#: an element that begins ends an open element of these names before it
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: elements that an implied end does not reach over
WALLS = frozenset("ul ol dl table".split())

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])|[^A-Za-z]+")


@dataclass
class Block:
    """A block element: its place in the tree, and what the model sees of it."""

    tag: str
    parent: int
    marks: tuple[str, ...] = ()
    label: bool | None = None
    chars: int = 0
    linked: int = 0
    texts: list[int] = field(default_factory=list)  # the page's text runs that are directly in it


def _marks(attributes: str) -> tuple[tuple[str, ...], bool | None]:
    found: dict[str, None] = {}
    label = None
    for name, double, single, bare in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), double or single or bare
        if name in ("class", "id", "role"):
            for part in _CAMEL.split(value):
                if part:
                    found[part.lower()] = None
        elif name == "data-content":
            label = value == "1"
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            found["hidden"] = None
    return tuple(found), label


class Tags:
    """The tags of a page in order, in one pass: no part of a page is looked at again however broken its markup is."""

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.absent: dict[str, bool] = {}  # quotes that do not occur any more

    def _closing(self, position: int) -> int:
        """Where the tag ends that `position` is in: at a `>` outside quotes, else at the next one at all."""
        page, at = self.page, position
        while stop := _STOP.search(page, at):
            mark, at = stop.group(), stop.end()
            if mark == ">":
                return stop.start()
            if not self.absent.get(mark):
                end = page.find(mark, at)
                if end < 0:
                    self.absent[mark] = True
                else:
                    at = end + 1
        return page.find(">", position)

    def next(self, position: int) -> tuple[int, int, str | None, bool, str] | None:
        """(begin, end, name or None, is it an end tag, attributes) of the next tag or comment from `position`."""
        page = self.page
        while 0 <= (begin := page.find("<", position)):
            after = page[begin + 1 : begin + 2]
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, len(page) if end < 0 else end + 3, None, False, ""
            if begin > self.last:
                return None  # nothing is closed any more
            if after in ("!", "?"):
                return begin, page.find(">", begin) + 1, None, False, ""
            if name := _NAME.match(page, begin + 1):
                end = self._closing(name.end())
                return begin, end + 1, name.group(2).lower(), name.group(1) == "/", page[name.end() : end]
            position = begin + 1
        return None


class Open:
    """Open elements, with the places of each name and of those that are no inline elements."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, tag: str, block: int) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, block))

    def pop(self) -> None:
        tag, _ = self.stack.pop()
        self.places[tag].pop()
        if tag not in INLINE:
            self.blocks.pop()

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 without one."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)


def parse(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """(blocks in page order with a root first, text runs as (block, text)); character references decoded, white space made one.

    A text run is what stands in one block between two of its block children, inline elements included. Elements that end
    nowhere end with their parent, a head with the first thing that it cannot hold; unknown elements are blocks. An end tag
    without an open element is nothing, a tag that is not closed by the page's end is text. Time and memory grow with the
    page, whatever is nested in it or left open.
    """
    blocks = [Block("#root", -1)]
    runs: list[tuple[int, str]] = []
    opened = Open()
    stack = opened.stack
    silent = 0  # open elements without visible text
    parts: list[str] = []
    linked = 0
    links = 0

    def close_run() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                at = stack[-1][1]
                blocks[at].texts.append(len(runs))
                blocks[at].chars += len(text)
                blocks[at].linked += min(linked, len(text))
                runs.append((at, text))
            parts.clear()
        linked = 0

    def pop_to(depth: int) -> None:
        nonlocal silent, links
        while len(stack) > depth:
            tag = stack[-1][0]
            if tag not in INLINE:
                close_run()
            opened.pop()
            silent -= tag in SILENT
            links -= tag == "a"

    def text(piece: str) -> None:
        nonlocal linked
        if stack[-1][0] == "head" and piece.strip():
            pop_to(len(stack) - 1)
        if piece and not silent:
            parts.append(piece)
            if links:
                linked += len(piece.strip())

    tags, position, size = Tags(page), 0, len(page)
    while position < size:
        found = tags.next(position)
        if found is None:
            text(page[position:])
            break
        begin, end, tag, ending, attributes = found
        text(page[position:begin])
        position = end
        if tag is None:
            continue
        if ending:
            depth = opened.last((tag,))
            # an inline element ends inside its block only
            if depth and not (tag in INLINE and depth < opened.blocks[-1]):
                pop_to(depth)
            continue
        if stack[-1][0] == "head" and tag not in IN_HEAD:
            pop_to(len(stack) - 1)
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                text(" " if tag != "wbr" else "")
                if tag == "hr":
                    close_run()
            continue
        if tag in ENDS:
            over = ("p", *ENDS[tag])
            while (depth := opened.last(over)) > opened.last(WALLS):
                name = stack[depth][0]
                pop_to(depth)
                if name == "p":
                    break
        elif tag not in INLINE and tag not in SILENT and stack[opened.blocks[-1]][0] == "p":
            pop_to(opened.blocks[-1])
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}\\b", re.IGNORECASE).search(page, position)
            after = page.find(">", close.end()) if close else -1
            position = after + 1 if after >= 0 else size
            continue
        if tag in INLINE or tag in SILENT:
            opened.push(tag, stack[-1][1])
            silent += tag in SILENT
            links += tag == "a"
            continue
        close_run()
        marks, label = _marks(attributes) if attributes else ((), None)
        parent = stack[-1][1]
        blocks.append(Block(tag, parent, marks, blocks[parent].label if label is None else label))
        opened.push(tag, len(blocks) - 1)
    pop_to(1)
    close_run()
    return blocks, runs


# ---- labelled pages -------------------------------------------------------------------------------------------------

#: fixed values: names that sites give to the parts of a page
CONTENT_NAMES = "article content post entry story body text main post-content entry-content article-body page-content single hentry prose".split()
SECTION_NAMES = {
    "nav": "nav navbar menu main-menu navigation breadcrumb breadcrumbs pagination pager toc topbar".split(),
    "header": "header masthead site-header banner logo branding top".split(),
    "footer": "footer site-footer copyright colophon bottom legal".split(),
    "aside": "sidebar side widget aside related related-posts recommended popular trending rail tags tag-list share social author-box".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo promotion ad-slot adsbygoogle banner-ad commercial".split(),
    "notice": "cookie cookie-notice notice alert consent gdpr popup modal overlay message warning hidden".split(),
    "form": "form search login newsletter subscribe signup search-form contact-form".split(),
    "comments": "comments comment comment-list comment-body reply replies discussion disqus respond reader-comments".split(),
}
SECTION_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "ad": "aside", "notice": "div", "form": "form", "comments": "section"}
_SYLLABLES = "an er in on the re es ti ou al ne ra de lo mi ka so vu pe".split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        pick = self.rng
        return " ".join("".join(pick.choices(_SYLLABLES, k=pick.randint(1, 4))) for _ in range(pick.randint(least, most)))

    def sentences(self, most: int = 6) -> str:
        return " ".join(self.words(1, 18).capitalize() + self.rng.choice(".....!?") for _ in range(self.rng.randint(1, most)))

    def links(self, least: int, most: int) -> str:
        many = [f'<a href="/{self.words(1, 1)}">{self.words(1, 3)}</a>' for _ in range(self.rng.randint(least, most))]
        if self.rng.random() < 0.7:
            return "<ul>" + "".join(f"<li>{a}{'</li>' if self.rng.random() < 0.8 else ''}" for a in many) + "</ul>"
        return self.rng.choice([" ", " | ", " &middot; "]).join(many)

    def paragraph(self) -> str:
        open_bold = self.rng.random() < 0.1
        draw = self.rng.random()
        # some authors end no sentence, some go on for long
        body = self.words(1, 40) if draw < 0.08 else self.words(100, 400) if draw < 0.11 else self.sentences(40) if draw < 0.16 else self.sentences()
        if self.rng.random() < 0.15:
            body += f' <a href="#">{self.words(1, 4)}</a> {self.sentences(1)}'
        return f"<p>{'<b>' if open_bold else ''}{body}{'<br>' if open_bold else '</p>' if self.rng.random() < 0.9 else ''}"

    def part(self, kind: str) -> str:
        """A part that is not content."""
        pick = self.rng
        body = {
            "nav": lambda: pick.choice(["", "", f"<h{(n := pick.randint(2, 6))}>{self.words(1, 3)}</h{n}>"]) + self.links(3, 9), "header": lambda: f"<div>{self.words(1, 4)}</div>" + (self.links(2, 6) if pick.random() < 0.5 else ""),
            "footer": lambda: f"&copy; {self.words(1, 6)} " + pick.choice(["", self.sentences(2), self.links(2, 6), f"<p>{self.sentences(2)}</p>"]),
            "aside": lambda: pick.choice([f"<h3>{self.words(1, 3)}</h3>", ""]) + pick.choice([self.links(2, 8), f"<p>{self.sentences(2)}</p>", f"<ul><li>{self.words(2, 8)}</li></ul>"]),
            "ad": lambda: pick.choice([self.sentences(3), f"<p>{self.sentences(2)}</p>", f'<a href="#">{self.words(2, 8)}</a>']),
            "notice": lambda: pick.choice([self.sentences(3), f"<p>{self.sentences(3)}</p><a href='#'>{self.words(1, 2)}</a>"]),
            "form": lambda: f"<label>{self.words(1, 4)}</label><input name=q><p>{self.sentences(1)}</p><button>{self.words(1, 2)}</button>",
            "comments": lambda: f"<h3>{self.words(1, 3)}</h3>" + "".join(
                pick.choice([f"<div class='{pick.choice(SECTION_NAMES['comments'])}'><p>{self.sentences(5)}</p></div>", f"<p>{self.sentences(5)}</p>", f"<li>{self.sentences(3)}</li>"]) for _ in range(pick.randint(1, 5))
            ),
        }[kind]()
        name = pick.choice(SECTION_NAMES[kind])
        if pick.random() < 0.45:
            tag, names = SECTION_TAGS[kind], pick.choice(["", f' class="{name}"'])
            if tag in ("div", "section"):
                names = f' class="{name}"'
        else:
            tag, names = pick.choice(["div", "div", "section"]), f' {pick.choice(["class", "class", "id"])}="{name}"'
        return f'<{tag}{names} data-content="0">{body}</{tag}>'

    def items(self, tag: str) -> str:
        """A list of an article: of phrases, sentences, paragraphs or links."""
        pick = self.rng
        kind = pick.randint(0, 3)
        item = (lambda: self.words(1, 15), lambda: self.sentences(2), lambda: f"<p>{self.sentences(2)}</p>", lambda: f'<a href="/{self.words(1, 1)}">{self.words(1, 6)}</a>')[kind]
        return f"<{tag}>" + "".join(f"<li>{item()}{'</li>' if pick.random() < 0.8 else ''}" for _ in range(pick.randint(1, 6))) + f"</{tag}>"

    def element(self) -> str:
        """A part of an article other than a paragraph, of any kind that HTML has for it."""
        pick = self.rng
        rows = lambda cell: "".join("<tr>" + "".join(f"<{cell}>{self.words(1, 3)}</{cell}>" for _ in range(3)) + "</tr>" for _ in range(pick.randint(1, 3)))
        return pick.choice([
            lambda: f"<h{(n := pick.randint(2, 6))}>{self.words(1, 6)}</h{n}>", lambda: f"<h{(n := pick.randint(2, 4))}>{self.words(1, 6)}</h{n}>{self.paragraph()}",
            lambda: self.items("ul"), lambda: self.items("ol"), lambda: f"<p>{self.words(2, 6)}:</p>{self.items(pick.choice(['ul', 'ol']))}",
            lambda: "<dl>" + "".join(f"<dt>{self.words(1, 3)}<dd>{self.sentences(2)}" for _ in range(pick.randint(1, 4))) + "</dl>",
            lambda: f"<pre>{self.words(2, 20)}</pre>", lambda: f"<pre><code>{self.words(2, 9)}\n  {self.words(2, 9)}</code></pre>",
            lambda: f"<figure><img src=x alt=y><figcaption>{pick.choice([self.words(2, 8), self.sentences(1)])}</figcaption></figure>",
            lambda: f"<details><summary>{self.words(1, 6)}</summary>{self.paragraph()}</details>",
            lambda: f"<blockquote>{pick.choice([self.sentences(2), f'<p>{self.sentences(2)}</p>'])}{pick.choice(['', f'<cite>{self.words(1, 3)}</cite>'])}</blockquote>",
            lambda: f"<table>{rows('th') if pick.random() < 0.4 else ''}{rows('td')}</table>", lambda: f"<address>{self.words(2, 8)}</address>",
            self.section, self.section, self.section, lambda: f"<div>{pick.choice([self.sentences(2), self.paragraph() + self.paragraph()])}</div>", lambda: f"<hr>{self.paragraph()}",
        ])()

    def section(self, depth: int = 0) -> str:
        """A section of an article, with sections of its own at times."""
        pick = self.rng
        title = pick.choice(["", f"<h{(n := pick.randint(2, 4))}>{self.words(1, 5)}</h{n}>"])
        inner = self.section(depth + 1) if depth < 2 and pick.random() < 0.4 else pick.choice(["", "", self.items("ul"), self.paragraph()])
        return f"<section>{title}{self.paragraph()}{inner}</section>"

    def article(self) -> str:
        pick = self.rng
        body = [f"<h1>{self.words(2, 12) if pick.random() < 0.6 else self.sentences(1)}</h1>"] if pick.random() < 0.8 else []
        for _ in range(pick.randint(1, 12)):
            draw = pick.random()
            if draw < 0.62:
                body.append(self.paragraph())
            elif draw < 0.94:
                body.append(self.element())
            else:
                body.append(self.part(pick.choice(["ad", "ad", "aside", "notice", "form"])))
        if pick.random() < 0.25:
            body.append(self.part("comments"))
        if pick.random() < 0.12:  # no element around the article
            inside = "".join(re.sub(r"^<(\w+)", r'<\1 data-content="1"', x) if "data-content" not in x.split(">", 1)[0] else x for x in body)
            return inside
        text = "".join(body)
        if pick.random() < 0.5:
            return f'<article{pick.choice(["", f" class={pick.choice(CONTENT_NAMES)}"])} data-content="1">{text}</article>'
        tag, name = pick.choice(["div", "div", "section", "main"]), pick.choice(CONTENT_NAMES)
        if pick.random() < 0.3:
            text = f'<div class="{pick.choice(CONTENT_NAMES)}">{text}</div>'
        return f'<{tag} {pick.choice(["class", "id"])}="{name}" data-content="1">{text}</{tag}>'

    def page(self) -> str:
        pick = self.rng
        before = [self.part(k) for k in ("nav", "header", "notice", "ad", "form") if pick.random() < 0.45]
        after = [self.part(k) for k in ("aside", "ad", "comments", "footer", "nav", "form", "notice") if pick.random() < 0.4]
        pick.shuffle(before)
        pick.shuffle(after)
        middle = self.article()
        if pick.random() < 0.3:
            wrapper = pick.choice(["div", "main"])
            middle = f'<{wrapper} class="{pick.choice(["container", "wrapper", "page", "main", "row"])}" data-content="0">{middle}{after.pop() if after else ""}</{wrapper}>'
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{}}</style><script>var a='<p>';</script></head>"
        return f"<!DOCTYPE html><html>{head}<body data-content=\"0\">{''.join(before)}{middle}{''.join(after)}</body></html>"


def labelled_page(seed: int) -> str:
    """A made-up page whose elements say by data-content whether they are content; an element without it is like its parent."""
    return _Maker(seed).page()
