"""Leaf blocks of an HTML page: text runs between block boundaries, with the elements around them."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from html import unescape

PATH_BINS, WORD_BINS = 8192, 512

# Element names of the HTML standard by their role.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = set("math maction annotation merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE |= MATH
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the first kind ends an open element of the second kinds.
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS_LIKE = set("ul ol menu dl table select body article section div".split())

# Nothing between quotes and brackets is tried twice (possessive), and a tag ends before the next "<", so no part is read over and over.
_inside = r"""(?:(?:"[^"]*"|'[^']*'|[^'"<>])*+|[^<>]*+)"""
_token = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<(script|style|template|title)(?=[\s/>]){_inside}>.*?(?:</\1\s*>|\Z)"""
    rf"""|<(/?)([A-Za-z][^\s/<>]*)({_inside})>|<[!?][^<>]*+>""",
    re.S | re.I,
)
_svg_end = re.compile(r"</svg\s*>", re.I)
#: Of deeper pages, so many of the outermost and innermost elements are in a path.
OUTER, INNER = 16, 32
_attribute = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_part = re.compile(r"[a-z0-9]+")


def _bin(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BINS


def element_names(tag: str, attributes: str) -> tuple[str, ...]:
    """The names of an element: its tag, the words of its class, id and role, and their parts."""
    out = [tag]
    for m in _attribute.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            out.append(f"{m[1][0].lower()}:{name}")
            out += [f"part:{p}" for p in _part.findall(name)]
    return tuple(dict.fromkeys(out))


class Blocks:
    """Splits pages into blocks (text, path, characters inside links).

    The path holds the hashed names of the elements around a block, or the names themselves. What has
    been met is kept.
    """

    def __init__(self, hashed: bool = True):
        self.code = _bin if hashed else str
        self.met: dict[tuple[str, str], tuple] = {}

    def _element(self, tag: str, attributes: str) -> tuple:
        key = (tag, attributes)
        if key not in self.met:
            if len(self.met) > 1 << 16:
                self.met.clear()
            self.met[key] = tuple(map(self.code, element_names(tag, attributes if "=" in attributes else "")))
        return self.met[key]

    def split(self, html: str) -> list[tuple[str, tuple, int]]:
        stack: list[tuple[str, tuple]] = []
        out, parts, linked, path = [], [], 0, ()
        open_tags: dict[str, int] = defaultdict(int)

        def pop_from(i: int) -> None:
            for t, _ in stack[i:]:
                open_tags[t] -= 1
            del stack[i:]

        def close() -> None:
            nonlocal parts, linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    out.append((text, path, linked))
                parts, linked = [], 0

        def text_run(raw: str) -> None:
            nonlocal path, linked
            if not raw:
                return
            if "&" in raw:
                raw = unescape(raw)
            if not parts:
                if raw.isspace():
                    return
                around = stack if len(stack) <= OUTER + INNER else stack[:OUTER] + stack[-INNER:]
                bins = [b for _, e in around for b in e]
                blocks = [t for t, _ in around if t not in INLINE]
                bins += [self.code(f"{a}>{b}") for a, b in zip(blocks, blocks[1:])] + [self.code(f"leaf:{stack[-1][0] if stack else ''}")]
                path = tuple(dict.fromkeys(bins))
            parts.append(raw)
            if open_tags["a"]:
                linked += len(raw)

        at, closed_svg = 0, True
        for m in _token.finditer(html):
            if m.start() < at:  # inside an svg
                at = max(at, m.end())
                continue
            text_run(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "svg" and not m[2]:
                if m[4].endswith("/"):
                    continue
                if closed_svg and (end := _svg_end.search(html, at)):
                    at = end.end()
                    continue
                closed_svg = False
            if tag not in INLINE:
                close()
            if m[2]:
                if stack and stack[-1][0] == tag:
                    open_tags[tag] -= 1
                    stack.pop()
                elif open_tags[tag]:
                    pop_from(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                continue
            if tag in VOID or tag in MATH and m[4].endswith("/"):
                continue
            ends = ENDS_LIKE.get(tag) or ({"p"} if tag in ENDS_P else None)
            if ends and any(map(open_tags.__getitem__, ends)):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        pop_from(i)
                        break
                    if stack[i][0] in HOLDS_LIKE:
                        break
            stack.append((tag, self._element(tag, m[4])))
            open_tags[tag] += 1
        text_run(html[at:])
        close()
        return out
