"""A tolerant reading of one HTML page into blocks of text with the containers around them."""

from __future__ import annotations

import html
import re

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that are left out with all inside them, and of these the two where a slash ends a tag and tags of HTML end the element.
SILENT = frozenset("svg math template noscript".split())
FOREIGN = frozenset("svg math".split())
#: Elements of svg and math that hold HTML.
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strike strong sub sup table tt u ul var "
    "article aside footer header main nav section".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
HEAD_ONLY = frozenset("base link meta script style title noscript template".split())
CONTAINERS = frozenset("article main section div td body center blockquote".split())
BOILERPLATE_TAGS = frozenset("head nav footer aside form button select option dialog menu object audio video canvas map fieldset".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments cookie cookies copyright disqus footer form gdpr header login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies respond share sharing shoutbox sidebar signup skip social "
    "sponsor sponsored subscribe tags toolbar topbar widget".split()
)
#: Of these, words that the prose of an article has on its own elements as well.
PROSE_WORDS = frozenset("banner copyright form header menu notice notification promo promotion related share sharing social tags".split())
#: First parts of class names that say what an element has, has not or is, as in has-sidebar and no-comments.
ABOUT_WORDS = frozenset("has hide is no non show with without".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
TITLES = frozenset("h1 h2".split())
CONTENT_WORDS = frozenset("article body content entry main page post story text".split())

#: What a character in a link counts for beside one of running text.
LINK_WEIGHT = 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest2>[^>]*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^>]*+\Z|</?\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))", re.I)
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*+(?:>|\Z)", re.I) for name in RAW}
_SILENT_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in SILENT}
_NAME_PARTS = re.compile(r"[A-Za-z]+")
_DIGITS = re.compile(r"\d+")


class Page:
    """blocks: (text, container) in page order; parent and path of each container, by number. Container 0 is the page.

    links: of each block the characters that are in links, headings apart, and how many links it has.
    """

    def __init__(self, source: str, by_class: bool = True):
        self._by_class, self._any_by_class = by_class, False
        #: Elements that their classes may hide: the one around each, whether a whole name matched, and whether it is prose of an article.
        self._doubtful: list[tuple[int, bool, bool]] = [(0, False, False)]
        self._doubt, self._in_doubt = 0, []
        self._articles: list[tuple[int, str]] = []
        self.parent, self.path, self.bonus = [-1], [""], [1.0]
        self.tag = [""]
        self.blocks: list[tuple[str, int]] = []
        self.links: list[tuple[int, int]] = []
        self._linked, self._n_links, self._anchors, self._headings = 0, 0, 0, 0
        self._stack: list[tuple[str, int, int, bool]] = []
        self._container, self._hidden = 0, 0
        self._silent = -1  # height of the outermost silent element on the stack
        self._last_ends: dict[str, int] = {}
        self._parts: list[str] = []
        at = 0
        while True:
            token = _TOKEN.search(source, at)
            if not self._hidden and (text := source[at : token.start() if token else len(source)]):
                self._parts.append(text)
                if self._anchors and not self._headings:
                    self._linked += len(" ".join(text.split()))
            if not token:
                break
            at = token.end()
            if name := token["name"] or token["name2"]:
                name, rest = name.lower(), token["rest"] or token["rest2"] or ""
                if token["end"] or token["end2"]:
                    self._close(name)
                elif rest.endswith("/") and (name in FOREIGN or (self._silent >= 0 and self._foreign())):
                    pass
                elif name in SILENT and not self._ends_after(source, name, at):
                    pass  # without an end tag in the page it leaves out nothing
                elif name in RAW:
                    end = _RAW_END[name].search(source, at)
                    # a title without an end would hide the whole page: it ends at the next tag
                    at = end.end() if end else max(source.find("<", at), at) if name == "title" else len(source)
                else:
                    self._open(name, rest)
        self._flush()
        self._settle()
        if not self.blocks and self._any_by_class:
            self.__init__(source, False)

    def _settle(self) -> None:
        """Leave out the blocks of elements that their classes hide.

        An element with an article or main in it, but for articles beside another one, is shown; so is one that
        a part of a class name would hide though it has most of the page's text, and prose of an article that
        isn't mostly links.
        """
        if len(self._doubtful) == 1:
            return
        size, linked = [0] * len(self._doubtful), [0] * len(self._doubtful)
        for (text, _), (chars, _), doubt in zip(self.blocks, self.links, self._in_doubt):
            size[doubt] += len(text)
            linked[doubt] += chars
        for i in range(len(size) - 1, 0, -1):
            size[self._doubtful[i][0]] += size[i]
            linked[self._doubtful[i][0]] += linked[i]
        direct = {doubt for doubt, name in self._articles if name == "article"}
        holds = set()
        for doubt, name in self._articles:
            while doubt and (name == "main" or self._doubtful[doubt][0] not in direct):
                holds.add(doubt)
                doubt = self._doubtful[doubt][0]
        hidden = [False] * len(size)
        for i, (around, whole, prose) in enumerate(self._doubtful[1:], 1):
            shown = i in holds or (not whole and 2 * size[i] > size[0]) or (prose and 2 * linked[i] <= size[i])
            hidden[i] = hidden[around] or not shown
        kept = [not hidden[doubt] for doubt in self._in_doubt]
        self.blocks = [b for b, k in zip(self.blocks, kept) if k]
        self.links = [x for x, k in zip(self.links, kept) if k]

    def _flush(self) -> None:
        if self._parts:
            text = " ".join(html.unescape("".join(self._parts)).split())
            if text:
                self.blocks.append((text, self._container))
                self.links.append((self._linked, self._n_links))
                self._in_doubt.append(self._doubt)
            self._parts = []
        self._linked = self._n_links = 0

    def _pop(self, height: int) -> None:
        while len(self._stack) > height:
            name, container, doubt, hidden = self._stack.pop()
            self._doubt = doubt
            self._anchors -= name == "a"
            self._headings -= name in TITLES
            self._hidden -= hidden
            self._container = container
        if self._silent >= height:
            self._silent = -1

    def _ends_after(self, source: str, name: str, at: int) -> bool:
        if name not in self._last_ends:
            self._last_ends[name] = max((m.start() for m in _SILENT_END[name].finditer(source)), default=-1)
        return self._last_ends[name] >= at

    def _foreign(self) -> bool:
        """Whether the innermost silent element is svg or math, outside of HTML in it."""
        return next((n in FOREIGN for n, *_ in reversed(self._stack) if n in SILENT or n in HTML_INSIDE), False)

    def _close(self, name: str) -> None:
        if self._silent >= 0:
            for height in range(len(self._stack) - 1, self._silent - 1, -1):
                if self._stack[height][0] == name:
                    self._pop(height)
                    return
            if not any(n == name for n, *_ in self._stack):
                return
            self._pop(self._silent)
        if name not in INLINE and name not in SILENT:
            self._flush()
        for height in range(len(self._stack) - 1, -1, -1):
            if self._stack[height][0] == name:
                if name not in INLINE or not any(n not in INLINE for n, *_ in self._stack[height:]):
                    self._pop(height)
                return

    def _open(self, name: str, rest: str) -> None:
        if self._silent >= 0 and (name == "body" or (name in BREAKOUT and self._stack[self._silent][0] in FOREIGN and self._foreign())):
            self._pop(self._silent)
        if self._silent >= 0 or name in SILENT:
            if name in VOID and not self._foreign():
                return
            if self._silent < 0:
                if name in FOREIGN and self._stack and self._stack[-1][0] == "head":
                    self._pop(len(self._stack) - 1)
                self._silent = len(self._stack)
            self._stack.append((name, self._container, self._doubt, self._silent == len(self._stack)))
            self._hidden += self._stack[-1][3]
            self._anchors += name == "a"
            self._headings += name in TITLES
            return
        if name in INLINE:
            if name == "br":
                self._parts.append(" ")
                return
            if name in VOID:
                return
        else:
            self._flush()
            self._imply(name)
            if name in VOID:
                return
        found = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(rest)} if "=" in rest else {}
        names = [n.lower() for key in ("class", "id") for n in found.get(key, "").split()]
        words = {w for n in names for w in _NAME_PARTS.findall(n)}
        article = any(n in ("article", "main") for n, *_ in self._stack)
        hidden = name in BOILERPLATE_TAGS or (name == "header" and not article) or found.get("role", "").lower() in BOILERPLATE_ROLES
        matched = self._matched(name, names, article) if words & BOILERPLATE_WORDS and self._by_class and not hidden else set()
        doubt = self._doubt
        if matched:
            self._any_by_class = True
            prose = article and matched <= PROSE_WORDS
            if name in INLINE:
                hidden = not prose
            else:
                self._doubtful.append((self._doubt, bool(matched & set(names)), prose))
                doubt = len(self._doubtful) - 1
        self._stack.append((name, self._container, self._doubt, hidden))
        self._doubt = doubt
        self._anchors += name == "a"
        self._n_links += name == "a"
        self._headings += name in TITLES
        self._hidden += hidden
        if name in ("article", "main") and not self._hidden and not words & BOILERPLATE_WORDS and not any(n == "article" for n, *_ in self._stack[:-1]):
            self._articles.append((doubt, name))
        if name in CONTAINERS and not self._hidden:
            classes = ".".join(sorted(_DIGITS.sub("#", found.get("class", "").lower()).split()))
            self.parent.append(self._container)
            self.tag.append(name)
            self.path.append(f"{self.path[self._container]}/{name}" + f".{classes}" * bool(classes))
            self.bonus.append((1.5 if name in ("article", "main") else 1.0) * (1.25 if words & CONTENT_WORDS else 1.0))
            self._container = len(self.path) - 1

    def _matched(self, name: str, names: list[str], article: bool) -> set[str]:
        """Boilerplate words in the class names and id of an element that they may hide."""
        if name in ("html", "body", "article", "main") or (name in ("h1", "h2", "h3") and article):
            return set()
        parts = [_NAME_PARTS.findall(n) for n in names]
        return {w for p in parts if p and p[0] not in ABOUT_WORDS and p[-1] != "free" for w in p} & BOILERPLATE_WORDS

    def _imply(self, name: str) -> None:
        """Close what a start tag ends: a head at the first tag of the body, a paragraph at a block, items at the next."""
        if name not in HEAD_ONLY and self._stack and self._stack[-1][0] == "head":
            self._pop(len(self._stack) - 1)
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ())
        for height in range(len(self._stack) - 1, -1, -1):
            inside = self._stack[height][0]
            if inside == "p" or inside in ends:
                self._pop(height)
                return
            if inside not in INLINE:
                return

    def scores(self) -> list[float]:
        """Characters of each container's own blocks, half of those one container further down, and so on; those of links hardly count."""
        own = [0.0] * len(self.path)
        for (text, container), (linked, _) in zip(self.blocks, self.links):
            own[container] += len(text) - (1 - LINK_WEIGHT) * min(linked, len(text))
        for i in range(len(own) - 1, 0, -1):
            own[self.parent[i]] += 0.5 * own[i]
        return [s * b for s, b in zip(own, self.bonus)]

    def votes(self, most: int | None = None) -> list[tuple[str, float]]:
        """Paths of containers, the best first (``most`` of them, or all), with their shares of the sum of all scores."""
        by_path: dict[str, float] = {}
        for path, score in zip(self.path[1:], self.scores()[1:]):
            by_path[path] = max(by_path.get(path, 0.0), score)
        total = sum(by_path.values())
        return [(p, s / total) for p, s in sorted(by_path.items(), key=lambda x: (-x[1], x[0]))[:most] if s > 0]

    def _within(self, roots: list[bool]) -> list[bool]:
        """The containers marked in ``roots`` and all inside them."""
        inside = list(roots)
        for i in range(1, len(inside)):
            inside[i] = inside[i] or inside[self.parent[i]]
        return inside

    def _around(self, chosen: list[bool]) -> tuple[list[bool], list[bool]]:
        """Containers whose text is whole the main text, and those around them that add all but lists of links.

        A chosen container stands for the article or main it is in, and that for all articles or mains around
        it. Outside of both it stands for the outermost container below the body, to which the body adds its
        own blocks and sections: other columns of the page are not taken.
        """
        whole, more = list(chosen), [False] * len(chosen)
        for i in range(1, len(chosen)):
            if not chosen[i]:
                continue
            chain = [i]
            while self.parent[chain[-1]] >= 0:
                chain.append(self.parent[chain[-1]])
            marked = [c for c in chain if self.tag[c] in ("article", "main")]
            if marked:
                whole[marked[0]] = True
                more[marked[-1]] = True
                continue
            below = [c for c in chain if self.tag[c] not in ("", "body")]
            if below:
                more[below[-1]] = True
                for c in (c for c in chain if self.tag[c] in ("", "body")):
                    more[c] = True
        inside, around = self._within(whole), list(more)
        for i in range(1, len(around)):
            up = self.parent[i]
            around[i] = around[i] or (around[up] and (self.tag[up] not in ("", "body") or self.tag[i] in ("section", "blockquote")))
        return inside, around

    def _main_blocks(self, chosen: list[bool]) -> list[str]:
        inside, around = self._around(chosen)
        found: list[str] = []
        run: list[str] = []  # blocks that are mostly links, and how many links they have
        run_links = 0
        for (text, container), (linked, links) in [*zip(self.blocks, self.links), (("", -1), (0, 0))]:
            if container >= 0 and not inside[container] and around[container] and 2 * linked > len(text):
                run.append(text)
                run_links += links
                continue
            if run_links < 2:
                found += run
            run, run_links = [], 0
            if container >= 0 and (inside[container] or around[container]):
                found.append(text)
        return found

    def text(self, path: str | None) -> str:
        """Main text around the containers of ``path``; where the page has none with text, around its own best container."""
        for chosen in (path, next(iter(self.votes(1)), (None,))[0], ""):
            if chosen is None:
                continue
            roots = [p == chosen for p in self.path]
            inside = self._within(roots)
            if any(inside[container] for _, container in self.blocks):
                return "\n".join(self._main_blocks(roots))
        return ""
