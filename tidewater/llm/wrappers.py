"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a stream of tags and texts. A wrapper is a union-free regular expression over
such tokens: a tag, a text that all pages share, a text slot, and optional or repeated
groups of these. It begins as one page of the host; further pages are aligned with it
one by one, and each mismatch is resolved: two texts become a slot, a stretch that
recurs right before becomes a repeated group, a stretch that one side lacks becomes
optional.

Pages of a host fall into shapes: the stream of tags with neighbouring repeats of a group
folded, in which long texts are hashes. The streams of a shape, which differ in texts only,
are aligned first, all of them, each by the task that reads its page. Then all shapes of a
host are aligned, in groups of ``GROUP`` whose wrappers are aligned in turn, so a host that
holds a third of all pages is many small tasks. Streams of any length take part: to align
two takes time in proportion to their tokens.

What a wrapper tells: the texts that are the same on all pages (frame), and the region,
the deepest container that holds half of the host's text in slots, summed over all its
pages; an <article> that holds it is taken whole. Every page is extracted whole: the texts
of the region that aren't frame, without the parts that tags (navigation, footers, forms,
scripts) or names (adverts, notices, comments) tell to be none. A name tells so if a whole
class, id or role does, as in "ad", "share-buttons" or "comment-list"; one that merely holds
such a word, as in "share-price" or "ad-hoc", is in doubt, and such a part goes only by its
frame texts, or where it stands outside of an article or region. Tags and names weigh in
where the region is chosen, and a named part that holds half of the region's text stays. A
page that lacks its host's region is extracted by tags alone: <article>, else <main>, else
the body.

Defined results: a null or empty page has an empty text; a null url belongs to a host of
its own; repeated rows and ties get equal results; a page of any length is read in linear
time; columns named wr_* and ``text`` are replaced, others pass through; an empty table
gives no rows.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterable
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import stored, table, text_or_empty

#: Shapes, or wrappers, that are aligned in one step, and about how many bytes of them.
GROUP, GROUP_BYTES = 64, 1 << 25
#: Tokens of shapes that a task holds before it passes them on.
HELD = 1 << 19
#: Tokens beyond which a wrapper stands without its optional groups, which pages of free form add to without end: these never are in what it tells.
WIDEST = 1 << 15
#: Longest text that is compared as it is; longer ones are hashed.
TEXT = 120
#: Texts are frame only if the host has so many different examples; inside the region they are left out only if they are so small a part of it.
LEAST_PAGES, MOST_FRAME = 4, 0.2
#: Weight of a text where the region is chosen: in parts that tags tell to be no content, that names tell so, in an article.
LOW, DOUBTED, HIGH = 0.02, 0.1, 2.0
#: Weight of a frame text there.
FIXED = 0.01
#: Containers inside each other that can be told apart. Streams of more tokens have like neighbours of any length folded.
DEEPEST, LONGEST = 32, 4096
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template", "svg", "textarea", "select", "iframe")}
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)")
STOP = re.compile(r"[>\"']")
NAMED = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")
UNEVEN = re.compile(r"[\t\n\r\x0b\x0c]|  ")

#: Fixed values of HTML: elements that end a block of text, and those that are never content.
BLOCKS = set("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FRAME = set("nav header footer aside form script style noscript template svg button select textarea iframe head dialog menu".split())
TAGGED = FRAME - {"header"}  # an article may have a header of its own
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that may be a region, and those that a second one of their kind ends.
CONTAINERS = set("body main article section div td center table form nav aside header footer ul ol dl figure details".split())
ENDED = set("p li tr td th dt dd option".split())
#: Words in a class, id or role that name what is no content.
NOISE = set("ad ads advert adverts advertisement banner promo sponsor sponsored notice notices cookie consent popup modal menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead comment comments reply replies respond share social related newsletter subscribe login search".split())
#: Words that beside one of NOISE only say what kind of part it is.
PARTS = set("area bar block body bottom box button buttons col column container content form group head inner item items left link links list main outer panel posts right row section site slot text thread title top unit wrap wrapper".split())


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """Place after the tag that begins at ``at``; quoted values may hold a >."""
    while m := STOP.search(page, at):
        at, c = m.end(), m.group()
        if c == ">":
            return at
        if page[m.start() - 1] in "= " and at <= last[c]:
            at = page.find(c, at) + 1
    return -1


def naming(label: str) -> str:
    """".word" if a class, id or role is made of words of NOISE, or of these and PARTS; ".?word" if one holds such a word beside others; else nothing."""
    sure, doubted = set(), set()
    for name in label.split():
        words = set(re.findall(r"[^\W\d_]+", name))
        (sure if words <= NOISE | PARTS else doubted).update(words & NOISE)
    return f".{min(sure)}" if sure else f".?{min(doubted)}" if doubted else ""


def labelled(page: str) -> list[tuple[str, str, str]]:
    """("<", name, label), (">", name, "") or ("", text, ""); scripts, styles and comments are left out.

    A name is followed by what its class, id or role says (``naming``); the label is the
    class, id or role without digits.
    """
    out, at, n = [], 0, len(page)
    close, last = page.rfind(">"), {q: page.rfind(q) for q in "\"'"}

    def text(t: str) -> None:
        if t:
            out.append(("", t, ""))

    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > close:  # no tag ends any more
            text(page[at:])
            break
        text(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.find(">", begin) + 1
            continue
        t = TAG.match(page, begin)
        bare = t and page[t.end()] == ">"
        end = t.end() + 1 if bare else _tag_end(page, t.end(), last) if t else -1
        if end < 0:
            end = page.find(">", begin) + 1 if t else begin + 1
            if not t:
                text("<")
                at = end
                continue
        at, name = end, t.group(2).lower()
        if t.group(1):
            out.append((">", name, ""))
            continue
        if name in RAW:
            ending = RAW[name].search(page, end)
            at = ending.end() if ending else n
            continue
        if bare:
            out.append(("<", name, ""))
            continue
        label = " ".join("".join(g) for g in NAMED.findall(page[begin:end])).lower()
        out.append(("<", name + naming(label), re.sub(r"[\d/]+", "", label)[:TEXT]))
    return out


def tokens(page: str) -> list[tuple[str, str]]:
    """("<", name), (">", name) or ("", text) of a page."""
    return [t[:2] for t in labelled(page) if not blank(t)]


def blank(token: tuple) -> bool:
    """White space between tags: it parts words of a block, and is no text of a wrapper."""
    return not token[0] and not token[1].strip()


def squeezed(text: str) -> str:
    """A text with character references decoded and white space made one space, trimmed."""
    if "&" in text:
        text = entities.unescape(text)
    return (SPACE.sub(" ", text) if UNEVEN.search(text) else text).strip(" ")


def folded(items: list[tuple]) -> list[tuple]:
    """A stream with neighbouring repeats of a group of up to 4 tokens left out; texts that differ in these are slots."""
    out, keys = [], []
    for x in items:
        out.append(x)
        keys.append(x if x[0] in ("<", ">") else "#")
        changed = True
        while changed:
            changed = False
            for w in range(1, 5):
                if len(keys) >= 2 * w and keys[-1] == keys[-1 - w] and keys[-w:] == keys[-2 * w : -w]:
                    again = out[-w:]
                    del out[-w:], keys[-w:]
                    out[-w:] = [a if a == b else ("#", "") for a, b in zip(out[-w:], again)]
                    changed = True
                    break
    return out


def folded_elements(items: list[tuple]) -> list[tuple]:
    """A stream in which an element that has the tags of its neighbour right before, however many, is left out; texts that differ in these are slots."""
    key = lambda x: x if x[0] in ("<", ">") else "#"
    out, names = [], Counter()
    open_ = [["", 0, (0, 0)]]  # for each open element: its tag, its place, and begin and end of the last one inside it
    for x in items:
        if x[0] == "<" and x[1].split(".")[0] not in EMPTY:
            open_.append([x[1].split(".")[0], len(out), (0, 0)])
            names[open_[-1][0]] += 1
        out.append(x)
        if x[0] != ">" or not names[x[1]]:
            continue
        name = None
        while name != x[1]:
            name, begin, _ = open_.pop()
            names[name] -= 1
        first, end = open_[-1][2]
        if 0 < end == begin and begin - first == len(out) - begin and all(key(a) == key(b) for a, b in zip(out[first:begin], out[begin:])):
            out[first:] = [a if a == b else ("#", "") for a, b in zip(out[first:begin], out[begin:])]
            begin = first
        open_[-1][2] = (begin, len(out))
    return out


def stream(labelled_tokens: list[tuple]) -> list[tuple]:
    """What is aligned of a page: folded, texts squeezed and long ones hashed."""
    brief = lambda t: t if len(t) <= TEXT else "~" + md5(t.encode("utf-8", "surrogatepass")).hexdigest()
    items = folded([(x[0], x[1] if x[0] else brief(squeezed(x[1]))) for x in labelled_tokens if not blank(x)])
    return items if len(items) <= LONGEST else folded_elements(items)


def shape(page: str) -> str:
    return " ".join(k + n if k not in ("", "#") else "#" for k, n in stream(labelled(page)))


def same(a, b) -> bool:
    return a[0] == b[0] and (a[0] in ("#", "opt", "rep") or a[1] == b[1])


def align(wrapper: list[tuple], page: list[tuple]) -> list[tuple]:
    """The wrapper generalised to match ``page``, a stream or another wrapper, too.

    Items are ("<", name), (">", name), ("", shared text), ("#", ""), ("opt", items) and
    ("rep", items).
    """
    out, i, j = [], 0, 0
    group = ("opt", "rep")
    last: dict = {}  # where each tag stands last in ``out``, behind its last group
    while i < len(wrapper) or j < len(page):
        w = wrapper[i] if i < len(wrapper) else None
        p = page[j] if j < len(page) else None
        if w and p and w[0] in group and p[0] in group and _begins(w[1], p[1]):
            out.append(("rep" if "rep" in (w[0], p[0]) else "opt", align(w[1], p[1])))
            last.clear()
            i, j = i + 1, j + 1
        elif w and w[0] in group:
            body, j = _taken(w, page, j)
            out.append((w[0], body))
            last.clear()
            i += 1
        elif p and p[0] in group:
            body, i = _taken(p, wrapper, i)
            out.append((p[0], body))
            last.clear()
            j += 1
        elif w and p and w[0] in ("", "#") and p[0] in ("", "#"):
            out.append(w if w == p else ("#", ""))
            i, j = i + 1, j + 1
        elif w and p and w == p:
            last[w] = len(out)
            out.append(w)
            i, j = i + 1, j + 1
        else:
            # a group that stands right before and comes again is repeated
            again = _repeat(out, last, page, j) if p else 0
            back = 0 if again else (_repeat(out, last, wrapper, i) if w else 0)
            if again or back:
                n = again or back
                found = out[-n:]
                source, at = (page, j) if again else (wrapper, i)
                while at + n <= len(source) and all(_fits(a, b) for a, b in zip(found, source[at : at + n])):
                    found = [a if a == b else ("#", "") if a[0] in ("", "#") else a for a, b in zip(found, source[at : at + n])]
                    at += n
                out[-n:] = [("rep", found)]
                last.clear()
                i, j = (i, at) if again else (at, j)
                continue
            # else the nearest place where the two go on alike; what is skipped is optional
            a, b = _meet(wrapper, i, page, j)
            if a > i:
                out.append(("opt", wrapper[i:a]))
            if b > j:
                out.append(("opt", page[j:b]))
            last.clear()
            i, j = a, b
    return out


def _begins(a: list[tuple], b: list[tuple]) -> bool:
    """Do two groups begin with tokens that fit?"""
    return bool(a and b) and a[0][0] not in ("opt", "rep") and b[0][0] not in ("opt", "rep") and _fits(a[0], b[0])


def _taken(item: tuple, stream_: list[tuple], at: int) -> tuple[list[tuple], int]:
    """The body of an optional or repeated group, generalised by what it takes of a stream, and where the stream goes on."""
    body = item[1]
    n = len(body)
    while n and at + n <= len(stream_) and all(x[0] not in ("opt", "rep") and (b[0] in ("opt", "rep") or _fits(b, x)) for b, x in zip(body, stream_[at : at + n])):
        body = align(body, stream_[at : at + n])
        at += n
        if item[0] == "opt" or len(body) != n:
            break
    return body, at


def _fits(a, b) -> bool:
    return a == b or a[0] in ("", "#") and b[0] in ("", "#")


def _repeat(out, last, stream_, at) -> int:
    """Tokens of the group that stands at the end of ``out`` and again in ``stream_``; it begins with a tag and may be of any length."""
    if stream_[at][0] != "<" or stream_[at] not in last:
        return 0
    n = len(out) - last[stream_[at]]
    return n if at + n <= len(stream_) and all(_fits(a, b) for a, b in zip(out[-n:], stream_[at : at + n])) else 0


def _meet(wrapper, i, page, j) -> tuple[int, int]:
    """The nearest places with a tag in common, the two ends if there is none; looks no further than what it skips."""
    best, cost = (len(wrapper), len(page)), len(wrapper) - i + len(page) - j
    here, there = {}, {}
    far = 0
    while far <= cost and (i + far < len(wrapper) or j + far < len(page)):
        for stream_, begin, own, others in ((wrapper, i, here, there), (page, j, there, here)):
            if begin + far < len(stream_) and (x := stream_[begin + far])[0] in ("<", ">"):
                own.setdefault(x, begin + far)
                if x in others:
                    skipped = here[x] - i + there[x] - j
                    if (skipped, here[x]) < (cost, best[0]):
                        best, cost = (here[x], there[x]), skipped
        far += 1
    return best


def size(wrapper: list[tuple]) -> int:
    """Tokens of a wrapper."""
    return sum(size(x[1]) if x[0] in ("opt", "rep") else 1 for x in wrapper)


def needed(wrapper: list[tuple]) -> list[tuple]:
    """A wrapper without what is optional."""
    rest = ((x[0], needed(x[1])) if x[0] == "rep" else x for x in wrapper if x[0] != "opt")
    return [x for x in rest if x[0] != "rep" or x[1]]


def merged(streams: Iterable[list[tuple]]) -> list[tuple]:
    """The wrapper of some streams or wrappers."""
    wrapper, most = None, 0
    for x in streams:
        wrapper = x if wrapper is None else align(wrapper, x)
        most += size(x)
        if most > WIDEST and (most := size(wrapper)) > WIDEST:
            wrapper = needed(wrapper)
            most = size(wrapper)
    return wrapper or []


def flat(wrapper: list[tuple], repeated: bool = False):
    """The items of a wrapper without its groups, and whether they stand in a repeated one."""
    for x in wrapper:
        if x[0] in ("opt", "rep"):
            yield from flat(x[1], repeated or x[0] == "rep")
        else:
            yield x, repeated


def frame_texts(wrapper: list[tuple]) -> list[str]:
    """Texts that a wrapper has in one form only: an optional text may be that of one page, and isn't among them."""
    top = [x for x in wrapper if x[0] != "opt"]
    return sorted({x[1] for x, _ in flat([("rep", [y for y in x[1] if y[0] != "opt"]) if x[0] == "rep" else x for x in top]) if x[0] == ""})


def fit(pages: list[str]) -> set[str]:
    """The texts that are frame by the wrapper of some pages."""
    streams = [stream(labelled(p)) for p in pages]
    # one page tells nothing: all its texts are the same on all pages
    return set(frame_texts(merged(streams))) if len(streams) > 2 else set()


def noisy(tag: str, name: str, inside: bool) -> bool:
    """Does its name tell an element to be no content? A doubtful one doesn't ``inside`` of an article or region."""
    return "." in name and tag not in ("body", "html", "article", "main") and not (inside and ".?" in name)


class Walk:
    """A way through a page's tokens: which elements and containers are open, how many of them named or tagged as no content."""

    def __init__(self):
        self.stack, self.open, self.named, self.framed = [], Counter(), 0, 0
        self.paths, self.children = [], [Counter()]

    def start(self, name: str, label: str) -> str | None:
        """Open an element; the path if it is a container."""
        tag = name.split(".")[0]
        if tag in ENDED and self.stack and self.stack[-1][0] == tag:
            self.end(tag)
        named, path = noisy(tag, name, bool(self.open["article"] or self.open["main"])), None
        if tag in CONTAINERS and len(self.paths) < DEEPEST:
            key = f"{tag}.{label}" if label else tag
            self.children[-1][key] += 1
            path = f"{self.paths[-1]}/{key}:{self.children[-1][key]}" if self.paths else f"{key}:{self.children[-1][key]}"
            self.paths.append(path)
            self.children.append(Counter())
        self.stack.append((tag, named, path is not None))
        self.open[tag] += 1
        self.named += named
        self.framed += tag in TAGGED
        return path

    def end(self, tag: str) -> None:
        while self.open[tag]:
            name, named, container = self.stack.pop()
            self.open[name] -= 1
            self.named -= named
            self.framed -= name in TAGGED
            if container:
                self.paths.pop()
                self.children.pop()
            if name == tag:
                return


def masses(page: list[tuple], frame: set[str]) -> dict[str, list[float]]:
    """Path of a container -> code points of the texts in it: weighed by frame, tags and names, and as they are."""
    walk, out = Walk(), {}
    for kind, name, label in page:
        if kind == "<" and name.split(".")[0] not in EMPTY:
            walk.start(name, label)
        elif kind == ">":
            walk.end(name)
        elif not kind and walk.paths and name.strip():
            tags, text = walk.open, squeezed(name)
            inside = tags["article"] or tags["main"]
            low = walk.framed or (tags["header"] and not inside)
            weight = len(text) * (LOW if low else DOUBTED if walk.named else HIGH if inside else 1) * (FIXED if text in frame else 1)
            for path in walk.paths:
                sums = out.setdefault(path, [0.0, 0])
                sums[0] += weight
                sums[1] += len(text)
    return out


def main_text(page: str, frame: set[str], region: str | None = None, keep: frozenset = frozenset()) -> str:
    """The blocks of the region in page order, joined by a space.

    ``region``: path of a container; without one, or where the page lacks it, the page is
    taken by tags alone. ``keep``: paths of parts that stay whatever their name.
    """
    all_ = labelled(page)
    if region is not None:
        found = _blocks(all_, frame, region, keep)
        if found is not None:
            return " ".join(found)
        return " ".join(_blocks(all_, set(), None, keep))
    return " ".join(_blocks(all_, frame, None, keep))


def _blocks(all_: list[tuple], frame: set[str], region: str | None, keep: frozenset) -> list[str] | None:
    names = {n.split(".")[0] for k, n, _ in all_ if k == "<"}
    root = next((r for r in ("article", "main", "body") if r in names), None)
    by_tag = region is None
    walk, blocks, block, inner, seen = Walk(), [], [], 0, False
    stack: list[tuple[bool, bool]] = []  # for each open element: hides its texts, is the region
    hidden = 0
    # the body tells nothing of what is inside it
    told = root in ("article", "main") if by_tag else region.rsplit("/", 1)[-1].split(":")[0].split(".")[0] != "body"
    drop = frame if not by_tag or root not in ("article", "main") else set()

    def flush() -> None:
        text = "".join(block)
        text = (SPACE.sub(" ", text) if UNEVEN.search(text) else text).strip(" ")
        block.clear()
        if text.strip() and text not in drop:
            blocks.append(text)

    for kind, name, label in all_:
        tag = name.split(".")[0] if kind else ""
        if kind and (tag in BLOCKS or tag in FRAME):
            flush()
        if kind == "<" and tag not in EMPTY:
            path = walk.start(name, label)
            while len(stack) >= len(walk.stack):
                h, r = stack.pop()
                hidden -= h
                inner -= r
            is_region = tag == root if by_tag else path == region
            bad = tag in FRAME and not (tag == "header" and inner) or noisy(tag, name, told and inner > 0)
            if not by_tag and (is_region or not inner or path in keep):
                bad = False  # the wrapper has decided
            stack.append((bad, is_region))
            hidden += bad
            inner += is_region
            seen = seen or is_region
        elif kind == ">":
            walk.end(tag)
            while len(stack) > len(walk.stack):
                h, r = stack.pop()
                hidden -= h
                inner -= r
        elif not kind and not hidden and (inner or by_tag and root is None):
            block.append(entities.unescape(name) if "&" in name else name)
    flush()
    return blocks if seen or by_tag else None


def host(url: str = "url"):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#]+)", 1)), F.lit(""))


class Shapes:
    """The wrappers of shapes: host and key of a shape -> the stream with texts that differ made slots, pages, and up to ``LEAST_PAGES`` digests of different streams."""

    def __init__(self):
        self.held: dict[tuple[str, str], list] = {}
        self.tokens = 0

    def add(self, key: tuple[str, str], items: list[tuple], pages: int = 1, seen: Iterable[str] = ()) -> None:
        known = self.held.get(key)
        if known is None:
            known = self.held[key] = [items, 0, set()]
            self.tokens += len(items)
        elif known[0] != items:
            known[0] = [a if a == b else ("#", "") for a, b in zip(known[0], items)]
        known[1] += pages
        if len(known[2]) < LEAST_PAGES:
            known[2].update(seen or [_digest((k + n for k, n in items), "\0")])

    def passed(self) -> pa.RecordBatch:
        """What is held, which then is nothing."""
        rows = [(*key, json.dumps(items), pages, sorted(seen)[:LEAST_PAGES]) for key, (items, pages, seen) in self.held.items()]
        self.__init__()
        kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 5, kinds)], names=_SHAPE.names)


def _digest(words: Iterable[str], by: str) -> str:
    return md5(by.join(words).encode("utf-8", "surrogatepass")).hexdigest()


def _surveyed(batches):
    """The shapes of all pages of a task, each with what its streams have in common."""
    shapes = Shapes()
    for batch in batches:
        for where, page in zip(*(batch.column(c).to_pylist() for c in (0, 1))):
            items = stream(labelled(page))
            key = where, _digest((k + n if k not in ("", "#") else "#" for k, n in items), " ")
            shapes.add(key, items)
            if shapes.tokens > HELD:
                yield shapes.passed()
    yield shapes.passed()


def _shaped(batches):
    """Parts of shapes in order of their keys -> a row a shape."""
    shapes, before = Shapes(), None
    for batch in batches:
        for where, shape_, items, pages, seen in zip(*(batch.column(c).to_pylist() for c in range(5))):
            if shapes.tokens > HELD and before != (where, shape_):
                yield shapes.passed()
            before = where, shape_
            shapes.add(before, _read(items), pages, seen)
    yield shapes.passed()


def _weighed(batches):
    """The masses of each host's containers, summed over a batch."""
    for batch in batches:
        sums: dict = {}
        for where, page, frame in zip(*(batch.column(c).to_pylist() for c in range(3))):
            for path, (w, n) in masses(labelled(page), set(frame or ())).items():
                total = sums.setdefault((where, path), [0.0, 0])
                total[0] += w
                total[1] += n
        rows = [(where, path, w, n) for (where, path), (w, n) in sums.items()]
        kinds = (pa.string(), pa.string(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 4, kinds)], names=_PART.names)


_SHAPE = T.StructType().add("wr_host", "string").add("wr_shape", "string").add("wr_items", "string").add("wr_pages", "long").add("wr_seen", T.ArrayType(T.StringType()))
_PART = T.StructType().add("wr_host", "string").add("wr_path", "string").add("wr_weight", "double").add("wr_n", "long")
_WRAPPER = T.StructType().add("wr_host", "string").add("wr_group", "long").add("wr_items", "string")


def _read(items: str) -> list[tuple]:
    back = lambda x: (x[0], [back(y) for y in x[1]]) if x[0] in ("opt", "rep") else tuple(x)
    return [back(x) for x in json.loads(items)]


def _merge(group: pa.Table) -> pa.Table:
    items = sorted(set(group.column("wr_items").to_pylist()))
    return pa.table({"wr_host": [group.column("wr_host")[0].as_py()], "wr_group": pa.array([group.column("wr_group")[0].as_py()], pa.int64()), "wr_items": [json.dumps(merged(_read(x) for x in items))]})


def _frames(batches):
    for batch in batches:
        texts = [frame_texts(_read(x)) for x in batch.column("wr_items").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("wr_host"), pa.array(texts, pa.list_(pa.string()))], names=["wr_host", "wr_frame"])


def _dealt(level: DataFrame, group: int) -> DataFrame:
    """Shapes or wrappers of a host dealt to fewer groups: of ``group``, or of ``GROUP_BYTES`` but two at least."""
    n, size_ = F.count("*"), F.sum(F.length("wr_items"))
    groups = level.groupBy("wr_host").agg(F.greatest(F.ceil(n / group), F.least(F.ceil(n / 2), F.ceil(size_ / GROUP_BYTES))).alias("wr_groups"))
    return level.join(groups, "wr_host").select("wr_host", F.pmod("wr_group", "wr_groups").alias("wr_group"), "wr_items")


def wrappers(pages: DataFrame, url: str = "url", html: str = "html", group: int = GROUP) -> DataFrame:
    """(wr_host, wr_frame, wr_drop, wr_region, wr_keep): what each host's wrapper tells, from all its shapes and pages.

    wr_frame: the texts that are frame; wr_drop: whether they are left out inside the
    region too; wr_keep: the containers in the region that stay whatever their name.
    """
    given = pages.select(host(url).alias("wr_host"), text_or_empty(html).alias("wr_html")).filter("wr_html != ''")
    shapes = given.mapInArrow(_surveyed, _SHAPE).repartition("wr_host", "wr_shape").sortWithinPartitions("wr_host", "wr_shape")
    shapes = stored(shapes.mapInArrow(_shaped, _SHAPE))
    sizes = shapes.groupBy("wr_host").agg(F.sum("wr_pages").alias("wr_pages"), F.sum(F.size("wr_seen")).alias("wr_examples"))
    level = shapes.select("wr_host", F.xxhash64("wr_shape").alias("wr_group"), "wr_items")
    level = stored(_dealt(level, group).groupBy("wr_host", "wr_group").applyInArrow(_merge, _WRAPPER))
    while level.filter("wr_group > 0").limit(1).count():
        level = stored(_dealt(level, group).groupBy("wr_host", "wr_group").applyInArrow(_merge, _WRAPPER), level)
    frames = level.mapInArrow(_frames, T.StructType().add("wr_host", "string").add("wr_frame", T.ArrayType(T.StringType())))
    none = F.expr("cast(array() as array<string>)")
    told = stored(sizes.join(frames, "wr_host", "left").select("wr_host", "wr_pages", F.when(F.col("wr_examples") >= LEAST_PAGES, F.col("wr_frame")).otherwise(none).alias("wr_frame")), shapes, level)
    # the deepest container with half of the weighed text of the host; at most one on each depth has it
    parts = given.join(told, "wr_host").select("wr_host", "wr_html", "wr_frame").mapInArrow(_weighed, _PART)
    parts = stored(parts.groupBy("wr_host", "wr_path").agg(F.sum("wr_weight").alias("wr_weight"), F.sum("wr_n").alias("wr_n")))
    total = parts.groupBy("wr_host").agg(F.max("wr_weight").alias("wr_total"))
    half = parts.join(total, "wr_host").filter("wr_total > 0 and 2 * wr_weight >= wr_total").filter(~F.col("wr_path").rlike("(^|/)article[.:][^/]*/"))
    region = half.groupBy("wr_host").agg(F.max(F.struct(F.length("wr_path").alias("n"), F.col("wr_path").alias("wr_region"), F.col("wr_n").alias("wr_text"))).alias("r")).select("wr_host", "r.wr_region", "r.wr_text")
    inner = parts.join(region, "wr_host").filter(F.col("wr_path").startswith(F.concat("wr_region", F.lit("/"))) & (2 * F.col("wr_n") >= F.col("wr_text")))
    keep = inner.groupBy("wr_host").agg(F.collect_set("wr_path").alias("wr_keep"))
    size = F.aggregate("wr_frame", F.lit(0).cast("long"), lambda a, x: a + F.length(x)) * F.col("wr_pages")
    drop = F.coalesce(size <= MOST_FRAME * F.col("wr_text"), F.lit(False)).alias("wr_drop")
    out = told.join(region, "wr_host", "left").join(keep, "wr_host", "left").select("wr_host", "wr_frame", drop, "wr_region", F.coalesce("wr_keep", none).alias("wr_keep"))
    return stored(out, told, parts)


def with_main_text(pages: DataFrame, url: str = "url", html: str = "html", group: int = GROUP) -> DataFrame:
    """``pages`` without the html, with ``text``: each page's main text."""
    own = [c for c in pages.columns if c not in (html, "text") and not c.startswith("wr_")]
    told = wrappers(pages, url, html, group)
    told = told.withColumn("wr_frame", F.when(F.col("wr_drop"), F.col("wr_frame"))).drop("wr_drop")
    both = pages.withColumn("wr_host", host(url)).join(told, "wr_host", "left").select(*own, text_or_empty(html).alias("wr_html"), "wr_frame", "wr_region", "wr_keep")

    def extract(batches):
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in range(len(own), len(own) + 4)]
            out = [main_text(h, set(f or ()), r, frozenset(k or ())) for h, f, r, k in zip(*columns)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(out, pa.string())], names=[*own, "text"])

    return both.mapInArrow(extract, pages.select(*own).schema.add("text", "string"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
