"""Operator 8: main text of pages, by equivalence classes of tokens across a host's pages."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, made_by, quoted
from .urlfilter import host_of

BROADCAST_TEMPLATES = 200_000  # template tokens (of all hosts) that are broadcast; beyond, the join shuffles
LEAST_PAGES = 3  # pages of a host that a template's token is on, at least
LEAST_SHARE = 0.5  # of the host's pages

_PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.S)
_RAW = frozenset(["script", "style", "noscript", "template", "textarea", "title", "iframe", "svg"])
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
_CLOSES_P = _BLOCK - {"td", "th", "tr", "li", "dd", "dt", "option", "caption", "tbody", "thead", "tfoot", "body", "html", "head"}
#: Parts of a page: a form around one of these holds the page, as themes and frameworks write it.
_PARTS = frozenset("article main h1 nav footer".split())
_HARD = frozenset("aside button dialog footer head header iframe input menu nav noscript script select style svg template textarea title".split())
_CHROME = frozenset("aside button dialog footer head iframe input menu nav noscript script select style svg template textarea title".split())
#: Whole words of class, id and role that mark what isn't the article; parts of a compound count if all of them are of these or neutral.
_CHROME_WORD = re.compile(r"ads?|advert\w*|banner|breadcrumbs?|comments?|commentlist|disqus|consent|cookies?|disclaimer|footer|form|masthead|menu|modal|nav\w*|newsletter|notices?|notification|popup|promo\w*|recommend\w*|related|replies|respond|share|sharing|sidebar|side|social|sponsor\w*|subscribe|toolbar|widgets?|contentinfo|complementary|search", re.I)
#: Words of an article element that is a reader's comment.
_COMMENT_WORD = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|responses?", re.I)
#: Words that a part of an article is named by as well: in an article they mark only what the host's classes confirm.
_LOOSE_WORD = re.compile(r"forms?|menu|notices?|search|side|social", re.I)
#: The same outside an article, whose own header belongs to it.
_HEADER_WORD = re.compile(r"header|topbar|top-bar|branding|logo", re.I)
_NEUTRAL = re.compile(r"site|page|global|main|top|bottom|left|right|primary|secondary|bar|box|list|reader|user|visitor|thread|section|links?|buttons?|icons?|items?|area|panel|block|inner|posts?|articles?|stories|reply|signup|\d+", re.I)
#: Elements that an opening tag of the same kind ends.
_SAME = {"li": {"li"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_FENCE = frozenset(["ul", "ol", "table", "dl", "article", "main", "section", "div", "body"])


@dataclass
class Page:
    """Blocks of text in page order: (token, text, whether within an article, whether chrome, whether what is around the article is, the
    loosely named element around it); tokens in page order; loosely named elements: (token, the one around it), at 0 none."""

    blocks: list[tuple[int, str, bool, bool, bool, int]] = field(default_factory=list)
    tokens: list[int] = field(default_factory=list)
    loose: list[tuple[int, int]] = field(default_factory=lambda: [(0, 0)])

    def templated(self, template: frozenset[int]) -> list[bool]:
        """Of each loosely named element, whether it or one around it belongs to the template."""
        found = [False]
        for token, above in self.loose[1:]:
            found.append(found[above] or token in template)
        return found


class _Open(NamedTuple):
    """An open element: its path as a number, whether in an article, whether chrome, whether what is around its article is, the form it is in,
    the loosely named element that it is or is in, and its own token as such (0 without one)."""

    tag: str
    path: int
    inside: bool
    chrome: bool
    around: bool
    form: int
    loose: int = 0
    own: int = 0


@lru_cache(10_000)
def _marks(word: str, inside: bool) -> bool:
    """Whether one word of a class, id or role says chrome: "cookie-banner" and "site-header" do, "has-sidebar" and "search-results" don't."""
    said = lambda x: _CHROME_WORD.fullmatch(x) or not inside and _HEADER_WORD.fullmatch(x)
    parts = [x for x in re.split("[-_]+", word) if x]
    return bool(said(word)) or any(map(said, parts)) and all(said(x) or _NEUTRAL.fullmatch(x) for x in parts)


def _named(attributes: str):
    """Names and unquoted values of an opening tag's attributes; None for those without one."""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes and not attributes.isspace() else ():
        yield name.lower(), value.strip("\"'")


def _comment(attributes: str) -> bool:
    """Whether a class, id or role says that an article element is a reader's comment."""
    for name, value in _named(attributes):
        if name in ("class", "id", "role") and any(_COMMENT_WORD.fullmatch(x) for word in value.split() for x in re.split("[-_]+", word)):
            return True
    return False


def _marked(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """(whether words mark the element as chrome, the words that may do so if the host's classes confirm it).

    In an article an id is an anchor that any heading may have, so only words of comments mark it at once.
    """
    loose = ""
    for name, value in _named(attributes):
        if name == "hidden":
            return True, ""
        if name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            for word in value.split():
                if _marks(word, inside):
                    parts = [x for x in re.split("[-_]+", word) if x]
                    comment = any(_COMMENT_WORD.fullmatch(x) for x in parts)
                    if not inside or comment or name != "id" and not _LOOSE_WORD.fullmatch(word):
                        return True, ""
                    loose = loose or word.lower()
    return False, loose


@lru_cache(100_000)
def _path(above: int, tag: str) -> int:
    return _number(f"{above}/{tag}")


def _chrome(tag: str, inside: bool) -> bool:
    return tag in _CHROME or tag == "header" and not inside


def parse(source: str) -> Page:
    """Tolerant of unclosed elements; raw elements are skipped whole, comments and markup declarations too.

    Paths are numbers, so that time and memory are linear in the page however deep it nests.
    """
    page, stack, held, at = Page(), [], [], 0
    opened: Counter = Counter()  # open elements by tag
    forms: list[int] = []  # of each block: the form around it that marks it, 0 without one
    around_form: dict[int, int] = {}  # the form that a form is in
    whole: set[int] = {0}  # forms around a page's parts: they aren't chrome
    endless: set[str] = set()  # raw elements that aren't closed any more
    top = _Open("", 0, False, False, False, 0)

    def flush():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                x = stack[-1] if stack else top
                token = _number(f"{x.path}>{text}")
                page.blocks.append((token, text, x.inside, x.chrome, x.around, x.loose))
                forms.append(x.form)
                if not x.inside:
                    page.tokens.append(token)

    def close(to: int):
        for x in reversed(stack[to:]):
            opened[x.tag] -= 1
            if x.own:
                page.tokens.append(_path(x.own, "end"))
        del stack[to:]

    n = len(source)
    while at < n:
        m = _PIECE.match(source, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not m[0].startswith(("<!", "<?")):
                held.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag] > 0:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        if tag in _BLOCK or any(x.tag in _BLOCK for x in stack[i:]):
                            flush()
                        close(i)
                        break
                    if stack[i].tag in ("article", "main", "body", "table") and tag not in ("body", "html", "main", "article", "table", "div", "section"):
                        break
            continue
        if tag in _RAW:
            end = None if tag in endless else re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            if not end:
                endless.add(tag)
            at = end.end() if end else (n if tag in ("script", "style", "title", "textarea") else at)
            continue
        if tag in _VOID:
            if tag in ("br", "wbr"):
                held.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in _BLOCK:
            flush()
            ends = _SAME.get(tag, ()) if tag not in _CLOSES_P else ("p",)
            if any(opened[x] > 0 for x in ends):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in _FENCE:
                        break
        if m[3].endswith("/"):
            continue
        above = stack[-1] if stack else top
        chrome, around, form, part = above.chrome, above.around, above.form, tag in ("article", "main")
        if tag in _PARTS:
            whole.add(form)
        if part and not above.inside:
            # words of what is around an article don't mark what is in it, kinds of elements do
            hard = any(opened[x] > 0 for x in _HARD)
            chrome, around = hard, chrome and not hard or tag == "article" and _comment(m[3])
        elif tag == "article" and _comment(m[3]):
            chrome = True
        if tag == "form":
            around_form[at], form = form, at
        marked, word = _marked(tag, m[3], above.inside)
        path = _path(above.path, tag)
        # a loosely named element is a token of its own, at its begin and at its end
        own = _path(path, f"#{word}") if word else 0
        if own:
            page.loose.append((own, above.loose))
        stack.append(_Open(tag, path, above.inside or part, chrome or marked or _chrome(tag, above.inside), around, form, len(page.loose) - 1 if own else above.loose, own))
        opened[tag] += 1
        page.tokens.append(path)
        if own:
            page.tokens.append(own)
    flush()
    close(0)
    for f, outer in reversed(around_form.items()):
        if f in whole:
            whole.add(outer)
    for f, outer in around_form.items():
        if outer not in whole:
            whole.discard(f)
    page.blocks = [(token, text, inside, chrome or f not in whole, around, loose) for (token, text, inside, chrome, around, loose), f in zip(page.blocks, forms, strict=True)]
    return page


def _number(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_tokens(source: str) -> list[int]:
    """The page's tokens in order: opening tags by path, loosely named elements of an article by path and name, and texts by path outside an article."""
    return parse(source).tokens


def order_of(tokens: list[int], size: int) -> int:
    """A class's tokens on a page, as one number for their order; 0 if they aren't one order of all of them, repeated."""
    first = tokens[:size]
    if len(tokens) % size or len(set(first)) < size or any(t != first[i % size] for i, t in enumerate(tokens)):
        return 0
    return _number(" ".join(map(str, first))) or 1


def gaps_of(tokens: list[int], level: dict[int, int], sizes: dict[int, int]) -> dict[int, int]:
    """For each class (level) of the page, the token of a class above after which it lies: 1 at the top.

    0 if a token of a class above is between the tokens of one repetition, or if repetitions
    lie after different tokens: the class isn't contained in one gap then.
    """
    seq = [(level[t], t) for t in tokens if t in level]
    before, after, open_ = [1] * len(seq), [len(seq)] * len(seq), []
    for i, (k, _) in enumerate(seq):
        while open_ and seq[open_[-1]][0] > k:
            after[open_.pop()] = i
        # of an equal level is a token of the same class: what is above it is above this one
        before[i] = (before[open_[-1]] if seq[open_[-1]][0] == k else seq[open_[-1]][1]) if open_ else 1
        open_.append(i)
    places: dict[int, list[int]] = {}
    for i, (k, _) in enumerate(seq):
        places.setdefault(k, []).append(i)
    found = {}
    for k, at in places.items():
        n = sizes[k]
        whole = all(after[at[j]] > at[min(j + n, len(at)) - 1] for j in range(0, len(at), n))
        above = {before[at[j]] for j in range(0, len(at), n)}
        found[k] = above.pop() if whole and len(above) == 1 else 0
    return found


def main_text(source: str, template: frozenset[int] = frozenset()) -> str:
    """Slots of the template that hold the article, in page order.

    Chrome is left out. Within an article (or main) element everything else is the text, but for elements
    that a word names as chrome or as any part of an article may be, if they belong to the host's template;
    on pages without one, texts that belong to the host's template are left out too, unless
    nothing else is there (pages that are copies of each other have nothing but template).
    Articles in elements that words mark as chrome (cards of related articles, or a wrapper's
    loose word) are the text if no other article is there and they have more text than the rest.
    """
    page = parse(source)
    gone = page.templated(template)
    found = [b for b in page.blocks if not b[3] and not gone[b[5]]]
    article = [b for b in found if b[2] and not b[4]]
    if not article:
        wrapped, article = [b for b in found if b[2]], [b for b in found if not b[2]]
        if template:
            article = [b for b in article if b[0] not in template] or article
        if sum(len(b[1]) for b in wrapped) > sum(len(b[1]) for b in article):
            article = wrapped
    return "\n".join(b[1] for b in article)


def _joined(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Each row with its host's classes as arrays: ``levels``, and ``tokens`` (an array for each level)."""
    named = classes.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("level", "tokens"))).alias("c")).select("host", F.col("c.level").alias("levels"), F.col("c.tokens").alias("tokens"))
    tokens = classes.agg(F.sum(F.size("tokens"))).first()[0] or 0
    return rows.join(F.broadcast(named) if tokens <= BROADCAST_TEMPLATES else named, "host", "left")


def _agreed(pages: DataFrame, classes: DataFrame, nested: bool) -> DataFrame:
    """The classes that have one order (or, nested, one gap) on all pages they are on."""
    import pandas as pd

    def run(batches):
        for b in batches:
            seen: dict[tuple[str, int], tuple[int, int]] = {}
            for host, sequence, levels, tokens in zip(b["host"], b["sequence"], b["levels"], b["tokens"], strict=True):
                level = {int(t): int(k) for k, ts in zip(levels, tokens, strict=True) for t in ts}
                sizes = {int(k): len(ts) for k, ts in zip(levels, tokens, strict=True)}
                sequence = sequence.tolist()
                if nested:
                    marks = gaps_of(sequence, level, sizes)
                else:
                    parts: dict[int, list[int]] = {}
                    for t in sequence:
                        if t in level:
                            parts.setdefault(level[t], []).append(t)
                    marks = {k: order_of(ts, sizes[k]) for k, ts in parts.items()}
                for k, m in marks.items():
                    low, high = seen.get((host, k), (m, m))
                    seen[host, k] = (min(low, m), max(high, m))
            yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["host", "level", "low", "high"])

    marked = _joined(pages.select("host", "sequence"), classes).where("levels IS NOT NULL").mapInPandas(run, "host string, level int, low long, high long")
    same = marked.groupBy("host", "level").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high AND low != 0")
    return classes.join(same.select("host", "level"), ["host", "level"], "left_semi")


def templates(rows: DataFrame, work: Workspace) -> DataFrame:
    """(host, level, tokens): the nested valid equivalence classes of each host.

    A token's occurrence vector says how often it is on each page of the host; vectors are
    compared by a hash of their entries that doesn't depend on order, so a host's pages never
    meet in one task. Tokens of equal vectors are a class. It is a template's if it has more
    than one token, is on at least LEAST_PAGES pages and LEAST_SHARE of the host's, has its
    tokens in the same order on each of its pages (all of them, as often as they occur), and
    lies as a whole in the same gap between tokens of the classes above it on each page.
    Classes on more pages, then those with fewer occurrences, are above. As the tokens are on
    at least that share, a host's template is at most 1 / LEAST_SHARE mean pages long.
    """
    import pandas as pd

    def run(batches):
        for b in batches:
            out = []
            for host, page, source in zip(b["host"], b["page"], b["source"], strict=True):
                sequence = page_tokens(source)
                counts = Counter(sequence)
                out.append((host, page, sequence, list(counts), list(counts.values())))
            yield pd.DataFrame(out, columns=["host", "page", "sequence", "token", "n"])

    made = rows.select("host", F.xxhash64("page", "source").alias("page"), "source").mapInPandas(run, "host string, page long, sequence array<long>, token array<long>, n array<long>")
    pages = work.write(made, "sequences")
    seen = pages.select("host", "page", F.explode(F.arrays_zip("token", "n")).alias("x")).select("host", "page", "x.token", "x.n")
    h = F.xxhash64("page", "n")
    # sums, as equal rows would cancel each other in an exclusive or
    vector = F.xxhash64(F.sum(h.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(h, 33)))
    vectors = seen.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), vector.alias("vector")).where(F.col("pages") >= LEAST_PAGES)
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    often = vectors.join(hosts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all"))
    classes = often.groupBy("host", "pages", "n", "vector").agg(F.collect_set("token").alias("tokens")).where(F.size("tokens") > 1)
    level = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("pages"), "n", "vector"))
    classes = work.write(classes.select("host", level.alias("level"), "tokens"), "classes")
    ordered = work.write(_agreed(pages, classes, False), "ordered")
    return work.write(_agreed(pages, ordered, True).select("host", "level", "tokens"), "nested")


def extract_main(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """id, url, text, n_chars of every row.

    Null html is empty and gives an empty text; null urls share one host. A repeated row is a
    page of its host once more and gets its text each time; null and repeated ids pass. Very
    long and very deep pages are read whole, in time and memory linear in them. Classes that
    tie in pages and occurrences are ordered by their vectors. An empty table gives an empty
    table. Other columns, whatever they are called, aren't read.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "html")
    host, html_ = F.coalesce(host_of(pages[quoted(url)]), F.lit("")), F.coalesce(pages[quoted(source)], F.lit(""))
    rows = pages.select(pages[quoted(id)].alias("page"), pages[quoted(url)].alias("url"), host.alias("host"), html_.alias("source"))
    found = templates(rows, work)
    size = found.agg(F.sum(F.size("tokens"))).first()[0] or 0
    named, few = found.groupBy("host").agg(F.flatten(F.collect_list("tokens")).alias("tokens")), size <= BROADCAST_TEMPLATES
    # at most BROADCAST_TEMPLATES tokens are held by the driver and sent to each worker once
    sent = spark.sparkContext.broadcast({r["host"]: frozenset(r["tokens"]) for r in named.collect()} if few else {})
    if few:
        both = rows.select("page", "url", F.struct("source", "host").alias("x"))
    else:
        both = rows.join(named, "host", "left").select("page", "url", F.struct("source", "host", "tokens").alias("x"))

    def start():
        known = sent.value

        def f(values: list[dict]):
            out = [main_text(v["source"], known.get(v["host"]) or frozenset(v.get("tokens") or ())) for v in values]
            return out, [len(x) for x in out]

        return f

    made = both.select("page", "url", made_by(start, {"text": "string", "n_chars": "long"}, F.col("x")).alias("made"))
    return made.select(F.col("page").alias(id), F.col("url").alias(url), "made.text", "made.n_chars")
