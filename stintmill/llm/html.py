"""Operator 7: main text of web pages by wrappers, inferred as union-free regular expressions.

A page is a tree of elements keyed by tag and class. Adjacent elements of one key are one repeated
group, as are sequences of elements that follow themselves, and text is a slot. The pages of a host are
aligned one after another: elements of equal key are aligned inside, elements that one side lacks become
optional, and what thereby becomes adjacent to its like is repeated. The result is the host's wrapper, a
union-free regular expression such as ``body(nav(ul(li+(a(#))))article(h1(#)p+(b?(#)#)))footer(#)``.
Wrappers are merged from the distinct trees of a host, in rounds of groups of bounded size.
A wrapper's slots are then chosen: those inside its article, and those elsewhere in its body, that stand
in no menu, header, footer, sidebar, notice, advert, form, or comment. Slots outside an article that say
the same on every page of a host are part of its template and hold no text. A page's text is what its own
tokens put into the article's slots, or into the others where it puts nothing into those.
"""

from __future__ import annotations

import bisect
import html as entities
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, staged, table

# Elements by what they are in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object canvas noembed noframes xmp".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"body", "html"}
DROPPED = set("head nav footer aside form script style noscript template button select option input label textarea iframe svg math menu dialog object canvas title".split())
MAIN = set("article main".split())
PAGE = set("html body".split())
DROPPED_WORDS = set(
    "ad ads adbox advert adverts advertisement advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus dropdown footer gdpr hidden login masthead menu meta-nav modal nav navbar navigation newsletter notice notices notification overlay "
    "pager pagination paywall popup popups promo promoted promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip "
    "social sponsor sponsored subscribe subscription tags toolbar widget widgets".split()
)
MAIN_WORDS = set("article articlebody articlecontent article-body article-content content-body entry-content main-content maincontent post-body post-content story-body".split())
# Words that only say where or what kind of box a named thing is.
BOX_WORDS = set(
    "area banner bar block body bottom box button buttons center col column container content entry fixed footer form global group header holder icon icons "
    "inner item items left link links list main media module outer page panel popup post posts primary right row secondary section site slot thread top "
    "unit wrap wrapper zone".split()
)
DEEPEST = 256  # elements nested deeper belong to their ancestor at this depth
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>|(?P<text>[^<]+|<)",
    re.S,
)
ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
SLOT = "#"


def _key(tag: str, attrs: str) -> str:
    """tag, and the words of class, id and role: ``div.ad``; digits are one, so ids that count agree."""
    if not attrs or ("=" not in attrs and "hidden" not in attrs.lower()):
        return tag
    words = []
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("hidden", "aria-hidden"):
            if value in ("", "hidden", "true"):
                words.append("hidden")
        elif name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                words.append("hidden")
        else:
            words.extend(re.sub(r"\d+", "0", w) for w in value.split())
    return ".".join([tag, *sorted(set(words))])


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", key), ("close", key) and ("text", raw text), well nested whatever the markup.

    Elements below DEEPEST are ("in", key) and ("out", key) instead.
    """
    stack: list[tuple[str, str]] = []
    opened, at = dict[str, int](), 0

    def shut() -> tuple[str, str]:
        tag, key = stack.pop()
        opened[tag] -= 1
        return ("close" if len(stack) < DEEPEST else "out"), key

    while m := TOKEN.match(page, at):
        at = m.end()
        if (text := m["text"]) is not None or (text := m["cdata"]) is not None:
            yield "text", text
            continue
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["close"]:
            if opened.get(tag):
                while stack:
                    t = stack[-1][0]
                    yield shut()
                    if t == tag:
                        break
            elif tag in BLOCK or tag == "br":
                yield "text", " "
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if tag in ("br", "hr", "wbr"):
                yield ("text", " ") if tag != "wbr" else ("text", "")
            continue
        if tag in CLOSES_P or tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            ends = {"p"} if tag in CLOSES_P else set()
            ends |= {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag, set())
            depth = len(stack)
            while depth and any(map(opened.get, ends)) and (stack[depth - 1][0] not in BLOCK or stack[depth - 1][0] in ends):
                depth -= 1
                if stack[depth][0] in ends and not (depth and stack[depth - 1][0] in ends):
                    break
            if depth < len(stack) and stack[depth][0] in ends:
                while len(stack) > depth:
                    yield shut()
        key = _key(tag, m["attrs"])
        if m["attrs"].endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, key))
        opened[tag] = opened.get(tag, 0) + 1
        yield ("open" if len(stack) <= DEEPEST else "in"), key
    while stack:
        yield shut()


# A node is [key, optional, repeated, children]; a slot's key is "#", that of a repeated sequence "(" and its keys.
LONGEST_GROUP = 6
ALIGNED = 250_000  # cells of a table of longest common subsequences; longer sequences are aligned greedily


def _fold(nodes: list) -> list:
    """Adjacent nodes of one key become one repeated node, and so do sequences that follow themselves."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0]:
            out[-1] = _merge(out[-1], node)
            out[-1][2] = True
            continue
        out.append(node)
        for k in range(2, LONGEST_GROUP + 1):
            last = [x[0] for x in out[-k:]]
            key = "(" + " ".join(last)
            if len(out) > k and out[-k - 1][0] == key:
                whole = out[-k - 1]
                out[-k - 1 :] = [[key, whole[1], True, [_merge(x, y) for x, y in zip(whole[3], out[-k:], strict=True)]]]
                break
            if len(out) >= 2 * k and [x[0] for x in out[-2 * k : -k]] == last:
                out[-2 * k :] = [[key, False, True, [_merge(x, y) for x, y in zip(out[-2 * k : -k], out[-k:], strict=True)]]]
                break
    return out


def _merge(a: list, b: list) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2], _align(a[3], b[3])]


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places of two sequences of keys: a longest common subsequence, or for very long ones the next equal keys."""
    n, m = len(a), len(b)
    out = []
    if n * m > ALIGNED:
        places: dict[str, list[int]] = {}
        for j, key in enumerate(b):
            places.setdefault(key, []).append(j)
        least = 0
        for i, key in enumerate(a):
            own = places.get(key, ())
            at = bisect.bisect_left(own, least)
            if at < len(own) and own[at] - least <= 2 * LONGEST_GROUP:
                out.append((i, own[at]))
                least = own[at] + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n and j < m:
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _align(a: list, b: list) -> list:
    """Two sequences as one: common keys are aligned, the rest is optional."""
    own, other = [x[0] for x in a], [x[0] for x in b]
    if own == other:
        return [_merge(x, y) for x, y in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for to_i, to_j in [*_common(own, other), (len(a), len(b))]:
        out.extend([k, True, r, c] for k, _, r, c in [*a[i:to_i], *b[j:to_j]])
        if to_i < len(a):
            out.append(_merge(a[to_i], b[to_j]))
        i, j = to_i + 1, to_j + 1
    return _fold(out)


def tree(page: str) -> list:
    """A page's own wrapper: its element tree with repeated groups folded and text as slots."""
    top: list = []
    stack: list[list] = [top]
    for what, value in tokens(page):
        if what == "open":
            node = [value, False, False, []]
            stack[-1].append(node)
            stack.append(node[3])
        elif what == "close":
            own = stack.pop()
            own[:] = _fold(own)
        elif value.strip():
            stack[-1].append([SLOT, False, False, []])
    return _fold(top)


def expression(nodes: list) -> str:
    """A wrapper written out as a union-free regular expression."""
    marks = lambda o, r: ("+" if r else "") + ("?" if o else "")
    return "".join([f"({expression(c)}){marks(o, r)}" if k[0] == "(" else k + marks(o, r) + (f"({expression(c)})" if c else "") for k, o, r, c in nodes])


def _parts(key: str) -> tuple[str, list[str]]:
    tag, *words = key.split(".")
    return tag, words


def _is_main(key: str) -> bool:
    tag, words = _parts(key)
    return tag in MAIN or (tag not in PAGE and any(w in MAIN_WORDS or w in ("main", "article") for w in words))


def _speaks_of(word: str, names: set[str]) -> bool:
    """True for a class that is one of the names, or a name and words for boxes: ``ad-box``, not ``social-science``."""
    parts = [p for p in re.split(r"[-_]+", word) if p and p != "0"]
    return word in names or (any(p in names for p in parts) and all(p in names or p in BOX_WORDS for p in parts))


def _is_dropped(key: str, in_main: bool) -> bool:
    """Classes of html and body speak of the page, those of an article or main of its kind: neither drops it."""
    tag, words = _parts(key)
    if tag in PAGE:
        return False
    if tag in MAIN:
        return "hidden" in words
    if tag in DROPPED or (tag == "header" and not in_main):
        return True
    if _is_main(key):
        return any(w in DROPPED_WORDS for w in words)
    if not in_main and any(_speaks_of(w, {"header", "branding", "logo"}) for w in words):
        return True
    return any(_speaks_of(w, DROPPED_WORDS) for w in words)


def chosen_slots(nodes: list, constant: set[str] = frozenset()) -> list[list[str]]:
    """Paths of the slots that may hold the main text, in the order in which a page tries them: those in an
    article, those in an article or main that is named like a comment or a notice, and those of the body,
    without those that are ``constant`` unless all are."""
    inside, named, anywhere = [], [], []

    def visit(children: list, path: str, into: list) -> None:
        for key, _, _, own in children:
            main = into is not anywhere
            if key == SLOT:
                into.append(path)
            elif key[0] == "(":
                visit(own, path, into)
            elif not _is_dropped(key, main):
                tag, words = _parts(key)
                if tag in MAIN and any(w in DROPPED_WORDS for w in words):
                    visit(own, f"{path}/{key}", named)
                else:
                    visit(own, f"{path}/{key}", inside if not main and _is_main(key) else into)

    visit(nodes, "", anywhere)
    said = set(anywhere) - set(constant)
    return [sorted(set(slots)) for slots in (inside, named, said or anywhere)]


def outer_slots(page: str) -> dict[str, int]:
    """Path and hash of the text of each slot outside an article; a path that repeats has one hash for all."""
    found: dict[str, list[str]] = {}
    path, inside = [""], 0
    for what, value in tokens(page):
        if what == "text":
            if not inside and value.strip():
                found.setdefault(path[-1], []).append(" ".join(value.split()))
        elif what == "open":
            inside += bool(inside) or _is_main(value)
            path.append(f"{path[-1]}/{value}")
        elif what == "close":
            inside -= bool(inside)
            path.pop()
    return {p: zlib.crc32("\n".join(t).encode("utf-8", "surrogatepass")) for p, t in found.items()}


def main_text(page: str, slots: set[str]) -> str:
    """The text that a page puts into the chosen slots, a line a block."""
    blocks: list[str] = []
    run: list[str] = []
    path = [""]
    deep: list[bool] = []  # of the elements below the deepest: whether they stand in one that is dropped

    def flush() -> None:
        if run and (line := " ".join(entities.unescape("".join(run)).split())):
            blocks.append(line)
        run.clear()

    for what, value in tokens(page):
        if what == "text":
            if (path[-1] in slots and not (deep and deep[-1])) or (run and not value.strip()):
                run.append(value)
        else:
            if value.split(".", 1)[0] in BLOCK:
                flush()
            if what == "open":
                path.append(f"{path[-1]}/{value}")
            elif what == "in":
                deep.append((deep and deep[-1]) or _is_dropped(value, True))
            elif what == "out":
                deep.pop()
            else:
                path.pop()
    flush()
    return "\n".join(blocks)


def host_of(url: F.Column) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))


GROUP = 200  # trees that one task merges into one wrapper
LEAST_PAGES = 3  # pages that must say the same in a slot for it to count as constant


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        outer = [outer_slots(h or "") for h in pdf["html"]]
        page = [zlib.crc32((h or "").encode("utf-8", "surrogatepass")) for h in pdf["html"]]
        trees = [json.dumps(tree(h or "")) for h in pdf["html"]]
        yield pd.DataFrame({"host": pdf["host"], "page": page, "tree": trees, "paths": [list(o) for o in outer], "said": [list(o.values()) for o in outer]})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    """One wrapper of a group's trees, the most frequent first."""
    wrapper = None
    for t in pdf.sort_values(["n", "tree"], ascending=[False, True])["tree"]:
        nodes = json.loads(t)
        wrapper = nodes if wrapper is None else _align(wrapper, nodes)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "tree": [json.dumps(wrapper)], "n": [int(pdf["n"].sum())]})


def wrappers(pages: DataFrame) -> DataFrame:
    """Staged (host, wrapper, slots) from every page (host, html): the distinct trees of a host are merged
    in groups of about GROUP, the groups' wrappers again, and so on until a host has one."""
    small_batches(pages.sparkSession, 500)
    seen = staged(pages.select("host", "html").mapInPandas(_signatures, "host string, page long, tree string, paths array<string>, said array<long>"), "page-trees")
    level = staged(seen.groupBy("host", "tree").agg(F.count("*").alias("n")), "trees")
    while (most := level.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salt = F.pmod(F.xxhash64("tree"), F.lit(-(-most // GROUP)))
        level = staged(level.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(lambda pdf: _merged(pdf), "host string, tree string, n long"), "trees")
    # slots outside an article that say the same on every page
    each = seen.select("host", "page", F.explode(F.arrays_zip("paths", "said")).alias("s")).select("host", "page", "s.paths", "s.said")
    each = each.groupBy("host", "paths").agg(F.min("said").alias("a"), F.max("said").alias("b"), F.approx_count_distinct("page").alias("n"))
    constant = each.where((F.col("a") == F.col("b")) & (F.col("n") >= LEAST_PAGES)).groupBy("host").agg(F.collect_set("paths").alias("constant"))
    choose = F.pandas_udf(lambda t, c: pd.Series([chosen_slots(json.loads(x), set(y if y is not None else ())) for x, y in zip(t, c, strict=True)]), "array<array<string>>")
    written = F.pandas_udf(lambda s: pd.Series([expression(json.loads(t)) for t in s]), "string")
    both = level.join(constant, "host", "left")
    return staged(both.select("host", written("tree").alias("wrapper"), choose("tree", "constant").alias("slots")), "wrappers")


BROADCAST_HOSTS = 20_000  # wrappers are broadcast up to this many hosts, and joined by a shuffle beyond


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page.

    Null and empty html give an empty text; a null URL or one without a host shares the host "".
    Rows come back one for one, null and repeated ids too; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host_of(F.col("url")))
    known = wrappers(rows)
    few = known.count() <= BROADCAST_HOSTS
    slots = known.select("host", "slots")
    text = F.pandas_udf(_texts, "string")
    joined = rows.join(F.broadcast(slots) if few else slots, "host", "left")
    return joined.select("page_id", "url", text("html", "slots").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def _first_text(page: str, slots) -> str:
    return next((text for own in slots if len(own) and (text := main_text(page, set(own)))), "")


def _texts(pages: pd.Series, slots: pd.Series) -> pd.Series:
    return pd.Series([_first_text(p, s) if p and s is not None else "" for p, s in zip(pages, slots, strict=True)])


def op7_extract_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
