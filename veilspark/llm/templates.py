"""Main text of web pages, by template deduction over the pages of a host.

1. A page is a sequence of tokens: its tags, told apart by their path, and its text blocks.  A
   token's occurrence vector is its number of occurrences on every page of the host; the vector is
   carried as the number of pages and sums of page hashes, so it is summed up inside
   the tasks before the shuffle, and a host with a third of all pages is no single task.
2. Tokens with equal vectors form an equivalence class, which comes some whole number of times on a page.  A class is
   valid if it holds a tag and another token, is on at least `min_pages` pages, and is ordered and nested: each time its tokens come
   in one order, before the class comes again, and no other class begins in one of its slots and goes on in the next.  Tokens out
   of the most frequent order on some page leave their class; of two classes that cross the one on fewer pages goes.
3. Then tokens get roles: one that comes in several slots of classes is told apart by the innermost class around it and the slot.
   Vectors and classes are made again of the roles, so that a token that comes more than once on a page gets a class in
   each of its roles, until the classes stay the same.
4. Text blocks of valid classes are template text.  The blocks that remain fill the slots.  Of
   these the main text is what stands in the main part, or else the body, and only in its articles
   if they hold at least half of that, without the parts whose tag, class or id says menu, header,
   footer, sidebar, notice, advert, form or comment.  A form, class or id around an article or main
   part with more text than all else that would stay drops nothing, nor does a form around all text.
5. If template text would take half or more of a page's main text, the pages are copies of one
   article rather than one template, and nothing is taken.

Defined results: null html is an empty page with an empty text; a page without a host, or one of
fewer than `min_pages`, is taken by its own tags alone; repeated rows get equal results; broken
and cut-off markup is read up to its end; pages are read whole; other columns are not read.
"""
from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.llm.common import BROADCAST_ROWS, materialize, plain, small_batches, whole

MIN_PAGES = 3
TOKEN = re.compile(
    r"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|$)", re.S
)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
#: Start tags that end an open element of these names.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",),
}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split()
)
SCOPE = frozenset("article aside blockquote body div dl footer form header html main nav ol section table td th ul".split())
DROPPED = frozenset(
    "head nav footer aside form button select menu dialog script style noscript template iframe object svg canvas audio video "
    "textarea title datalist".split()
)
NAMED = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner banners sponsor sponsored promo promotion cookie cookies "
    "consent gdpr notice notices notification popup modal overlay sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead comment comments commentlist reply replies disqus respond share sharing social related "
    "recommended recommendations newsletter subscribe subscription signup login pagination pager toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts that hold articles of their own kind.
COMMENTS = frozenset("comment comments commentlist reply replies disqus respond".split())
#: First words of class names that tell of the page, as in has-sidebar.
STATES = frozenset("has no with without is".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def dropped(name: str, attributes: str, in_article: bool) -> str:
    """How an element holds no main text, by its tag, class, id and role: "" if it may hold some,
    "hard", or "soft" if an article or main part inside can tell that it holds the page."""
    if name in DROPPED or (name == "header" and not in_article):
        return "soft" if name == "form" else "hard"
    if not attributes or name in ("html", "body", "main"):
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            if value.lower() in ROLES:
                return "hard"
            continue
        for one in value.split():
            words = [w.lower() for w in WORD.findall(one)]
            if not words or words[0] in STATES or "by" in words:
                continue
            if name == "article":
                if not {"comment", "reply", "ad", "advert", "sponsored"}.isdisjoint(words):
                    return "hard"
            elif not COMMENTS.isdisjoint(words):
                return "hard"
            elif not NAMED.isdisjoint(words):
                found = "soft"
            if "header" in words and not in_article:
                found = "soft"
    return found


Block = tuple[str, str, int]


def in_area(blocks: list[Block]) -> list[Block]:
    """The blocks of the main part, or else of the body; only of its articles if they hold half of it."""
    size = [0] * 5
    for _, text, area in blocks:
        size[area] += len(text)
    around, articles = (2, 4) if size[2] + size[4] else (1, 3)
    own = {articles} if size[articles] >= max(size[around], 1) else {around, articles}
    return [b for b in blocks if b[2] in own]


def settled(found: list[tuple[str, str, int, tuple[int, ...], int]], forms: set[int]) -> list[Block]:
    """Blocks with area 0 for those in soft parts, unless such a part turns out to hold the page."""
    sizes: dict[tuple[tuple[int, ...], int], int] = {}
    for _, text, area, parts, region in found:
        if area and parts and region:
            sizes[parts, region] = sizes.get((parts, region), 0) + len(text)
    kept: set[int] = set()

    def blocks() -> list[Block]:
        return [(path, text, area if kept.issuperset(parts) else 0) for path, text, area, parts, _ in found]

    if sizes:
        (parts, _), most = max(sizes.items(), key=lambda x: x[1])
        if most > sum(len(text) for _, text, _ in in_area(blocks())):
            kept.update(parts)
    out = blocks()
    if forms and not any(area for *_, area in out):
        kept |= forms
        out = blocks()
    return out


def parse(page: str) -> tuple[list[str], list[Block]]:
    """Tag paths in page order, and text blocks as (path, text, area)."""
    return read(page)[:2]


def read(page: str) -> tuple[list[str], list[Block], list[int]]:
    """Tag paths in page order, text blocks as (path, text, area), and the number of tags before the end of each block.

    The area is 0 for dropped parts, 1 for the body, 2 for the main part, 3 for an article, 4 for one in the main part.
    """
    tags: list[str] = []
    found: list[tuple[str, str, int, tuple[int, ...], int]] = []
    # name, path, area, soft parts around, the outermost article or main part inside the last of them
    stack: list[tuple[str, str, int, tuple[int, ...], int]] = [("", "", 1, (), 0)]
    forms: set[int] = set()
    places: list[int] = []
    pieces: list[str] = []
    path_held, held = "", (1, (), 0)

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append((path_held, text, *held))
                places.append(len(tags))
            pieces.clear()

    def add(text: str) -> None:
        nonlocal path_held, held
        if not text:
            return
        _, path, *inside = stack[-1]
        if not pieces or tuple(inside) != held:
            flush()
            path_held, held = path, tuple(inside)
        pieces.append(text)

    def close(name: str, scoped: bool) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return
            if scoped and stack[k][0] in SCOPE:
                return

    at = 0
    while True:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            close(name, name not in SCOPE)
            continue
        if name in BLOCK:
            flush()
        if name in ENDS_P:
            close("p", True)
        for other in CLOSES.get(name, ()):
            close(other, True)
        attributes = m[3] or m[6] or ""
        _, path, area, parts, region = stack[-1]
        path = f"{path}/{name}"
        if attributes:
            path += "".join(f".{x[2] or x[3] or x[4]}" for x in ATTRIBUTE.finditer(attributes) if x[1].lower() == "class")
        tags.append(path)
        if name in VOID or attributes.endswith("/") and name not in BLOCK:
            continue
        how = dropped(name, attributes, area >= 3) if area else ""
        if how == "hard":
            area = 0
        elif how:
            parts, region = (*parts, len(tags)), 0
            if name == "form":
                forms.add(len(tags))
        if area and (name == "article" or name == "main" or "role=\"main\"" in attributes):
            if name == "article":
                area = 4 if area in (2, 4) else 3
            else:
                area = area if area >= 3 else 2
            region = region or len(tags)
        if name in RAW:
            end = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
            at = len(page) if end is None else end.start()
            if name in ("textarea", "title") or end is not None:
                after = page.find(">", at)
                at = len(page) if after < 0 else after + 1
            continue
        stack.append((name, path, area, parts, region))
    flush()
    return tags, settled(found, forms), places


def token(path: str, text: str = "") -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}" if text else path)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sequence(tags: list[str], blocks: list[Block], places: list[int]) -> tuple[list[int], list[int]]:
    """The tokens of a page in page order, the page itself first, and where among them its blocks are."""
    out, at, done = [signed(token(""))], [], 0
    for (path, text, _), place in zip(blocks, places):
        out.extend(signed(token(x)) for x in tags[done:place])
        done = place
        at.append(len(out))
        out.append(signed(token(path, text)))
    out.extend(signed(token(x)) for x in tags[done:])
    return out, at


def main_blocks(blocks: list[Block], template: Collection[int] = ()) -> list[str]:
    """The blocks of the main text, without the blocks whose numbers are given as template text."""
    own = in_area([b for b in blocks if b[2]])
    if template:
        slots = in_area([b for k, b in enumerate(blocks) if b[2] and k not in template])
        if 2 * sum(len(text) for _, text, _ in slots) > sum(len(text) for _, text, _ in own):
            own = slots
    return [text for _, text, _ in own]


def host_of(url: Column) -> Column:
    """Host of an address in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))


#: A member of a class: class, place in its order, members, pages, whether it is text.
Member = tuple[int, int, int, int, bool]
MEMBER = ("step", "role", "class", "place", "members", "pages", "is_text")


def steps_of(packed: np.ndarray | None, n: int) -> list[dict[int, Member]]:
    """The classes of each of n steps, by role, of a host's packed members."""
    steps: list[dict[int, Member]] = [{} for _ in range(n)]
    for step, role, *member, is_text in [] if packed is None else np.asarray(packed).reshape(-1, len(MEMBER)).tolist():
        steps[step][role] = (*member, bool(is_text))
    return steps


def refined(roles: list[int], classes: dict[int, Member]) -> list[int]:
    """Every role with the innermost class around it and the slot of that class."""
    around: list[tuple[int, int]] = []
    out = []
    for role in roles:
        of = classes.get(role)
        if of is not None and of[1] and around:
            around.pop()
        if around:
            out.append(signed(xxhash.xxh3_64_intdigest("%d:%d:%d" % (role, *around[-1]))))
        else:
            out.append(role)
        if of is not None and of[1] + 1 < of[2]:
            around.append((of[0], of[1]))
    return out


def words(roles: list[int], classes: dict[int, Member]) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """(class, its members in page order), each time that a class comes; None if it comes again before all its members came."""
    found: dict[int, list[int]] = {}
    for role in roles:
        if role in classes:
            found.setdefault(classes[role][0], []).append(role)
    for c, members in found.items():
        m = classes[members[0]][2]
        for k in range(0, len(members), m):
            word = tuple(members[k : k + m])
            yield c, word if len(set(word)) == m else None


def longest_ordered(ranks: list[int]) -> set[int]:
    """Where a longest part with rising ranks is."""
    tails: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, rank in enumerate(ranks):
        j = bisect_left(tails, rank)
        before.append(ends[j - 1] if j else -1)
        tails[j : j + 1] = [rank]
        ends[j : j + 1] = [k]
    kept, k = set(), ends[-1] if ends else -1
    while k >= 0:
        kept.add(k)
        k = before[k]
    return kept


def misplaced(word: list[int], order: list[int], texts: set[int]) -> list[int]:
    """The members of a word that are not in the given order: as few tags as can be, then texts between other tags or out of order."""
    rank = {role: k for k, role in enumerate(order)}
    tags = [role for role in word if role not in texts]
    kept = {tags[k] for k in longest_ordered([rank[role] for role in tags])}

    def slots(roles: list[int]) -> dict[int, int]:
        out, n = {}, 0
        for role in roles:
            n += role in kept
            if role in texts:
                out[role] = n
        return out

    want = slots(order)
    near = [role for role, n in slots(word).items() if want[role] == n]
    kept |= {near[k] for k in longest_ordered([rank[role] for role in near])}
    return [role for role in word if role not in kept]


def crossing(roles: list[int], classes: dict[int, Member]) -> set[int]:
    """Of each two classes that cross on a page the one on fewer pages, or with fewer members."""
    begun: dict[int, tuple[int, int, Member]] = {}
    out = set()
    for k, role in enumerate(roles):
        of = classes.get(role)
        if of is None:
            continue
        start, last, _ = begun.get(of[0], (k, k, of)) if of[1] else (k, k, of)
        for other_start, _, other in begun.values():
            if other[0] != of[0] and other_start > last:
                out.add(min(of, other, key=lambda x: (x[3], x[2], x[0]))[0])
        begun[of[0]] = (start, k, of)
        if of[1] + 1 == of[2]:
            del begun[of[0]]
    return out


def template_blocks(roles: list[int], at: list[int], steps: list[dict[int, Member]]) -> set[int]:
    """The numbers of a page's blocks that are template text, by its tokens and where among them the blocks are."""
    for classes in steps[:-1]:
        roles = refined(roles, classes)
    return {k for k, i in enumerate(at) if roles[i] in steps[-1]}


def sequences(pages: DataFrame) -> DataFrame:
    """(page, host, roles, texts) over pages of (page, host, html): the tokens in page order, and which are text."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            roles, texts = [], []
            for page in plain(batch["html"]):
                tokens, at = sequence(*read(page))
                is_text = np.zeros(len(tokens), dtype=bool)
                is_text[at] = True
                roles.append(tokens)
                texts.append(is_text)
            yield pd.DataFrame({"page": batch["page"], "host": batch["host"], "roles": roles, "texts": texts})

    return pages.where("host <> ''").mapInPandas(run, "page long, host string, roles array<long>, texts array<boolean>")


def pages_with(sequences: DataFrame, classes: DataFrame | None) -> DataFrame:
    """(page, host, roles, texts, packed): the sequences with the members of their host's classes."""
    if classes is None:
        return sequences.withColumn("packed", F.lit(None).cast("array<long>"))
    return sequences.join(small_lists(classes), "host")


def small_lists(classes: DataFrame) -> DataFrame:
    """Stored members per host, marked for broadcast only if they are few."""
    numbers = classes.agg(F.sum(F.size("packed"))).first()[0] or 0
    return F.broadcast(classes) if numbers <= BROADCAST_ROWS else classes


def packed(members: DataFrame) -> DataFrame:
    """(host, packed): the members of a host as one list of numbers, stored."""
    numbers = F.array(*(F.col(x).cast("long") for x in MEMBER))
    return materialize(members.groupBy("host").agg(F.flatten(F.collect_list(numbers)).alias("packed")), "classes")


def per_page(rows: DataFrame, found, schema: str, steps: int, after: int) -> DataFrame:
    """What `found(sums, page, host, roles, texts, classes)` adds to a batch's sums for each page: its roles after some of the steps,
    and the classes of the last step."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[dict[int, Member]]] = {}
        for batch in batches:
            sums: dict = {}
            for page, host, roles, texts, lists in zip(batch["page"].tolist(), batch["host"], batch["roles"], batch["texts"], batch["packed"]):
                if host not in known:
                    known[host] = steps_of(lists, steps)
                own = roles.tolist()
                for classes in known[host][:after]:
                    own = refined(own, classes)
                found(sums, page, host, own, texts.tolist(), known[host][-1] if steps else {})
            yield pd.DataFrame([(*k, *v) for k, v in sums.items()], columns=[x.split()[0] for x in schema.split(", ")])

    return rows.mapInPandas(run, schema)


VECTORS = "host string, token long, is_text boolean, pages long, total long, low long, high long"


def role_vectors(rows: DataFrame, steps: int = 0) -> DataFrame:
    """(host, token, is_text, pages, total, vector) of the roles after the steps of `packed`."""

    def found(sums, page, host, roles, texts, classes):
        counts: dict[tuple[int, bool], int] = {}
        for t in zip(roles, texts):
            counts[t] = counts.get(t, 0) + 1
        hashes: dict[int, int] = {}
        for (t, is_text), n in counts.items():
            h = hashes.get(n)
            if h is None:
                h = hashes[n] = xxhash.xxh3_64_intdigest(f"{page}:{n}")
            s = sums.setdefault((host, t, is_text), [0, 0, 0, 0])
            s[0] += 1
            s[1] += n
            s[2] += h & 0xFFFFFFFF
            s[3] += h >> 32

    total = lambda x: F.sum(x).alias(x)
    each = per_page(rows, found, VECTORS, steps, steps).groupBy("host", "token").agg(F.max("is_text").alias("is_text"), *map(total, ("pages", "total", "low", "high")))
    return each.select("host", "token", "is_text", "pages", "total", F.xxhash64("low", "high").alias("vector"))


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """(host, token, is_text, pages, total, vector) over pages of (page, host, html)."""
    return role_vectors(pages_with(sequences(pages), None))


def _classes(members: DataFrame, step: int) -> DataFrame:
    """(host, step, role, class, ...) of (host, class, pages, tokens), lists in order of (token, is_text), with a tag and another token."""
    some = members.where(F.exists("tokens", lambda t: ~t["is_text"]) & (F.size("tokens") > 1))
    each = some.select("host", "class", "pages", F.size("tokens").alias("members"), F.posexplode("tokens").alias("place", "t"))
    return each.select("host", F.lit(step).alias("step"), F.col("t.token").alias("role"), "class", "place", "members", "pages", "t.is_text")


def _ordered(rows: DataFrame, classes: DataFrame, step: int) -> DataFrame:
    """The classes in the order of their members, without those that are out of it on some page."""

    def found(sums, page, host, roles, texts, known):
        for c, word in words(roles, known):
            s = sums.setdefault((host, c, word), [0])
            s[0] += 1

    @F.pandas_udf("array<long>")
    def outside(each: pd.Series, orders: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([misplaced(word.tolist(), order.tolist(), set(own.tolist())) for word, order, own in zip(each, orders, texts)], dtype=object)

    came = per_page(rows, found, "host string, class long, word array<long>, n long", step + 1, step)
    came = materialize(came.groupBy("host", "class", "word").agg(F.sum("n").alias("n")), "words")
    # the most frequent order, unless the class came again within itself
    orders = came.groupBy("host", "class").agg(F.max(F.struct("n", "word"))["word"].alias("order"), F.bool_or(F.col("word").isNull()).alias("broken"))
    texts = classes.groupBy("host", "class").agg(F.collect_list(F.when(F.col("is_text"), F.col("role"))).alias("texts"))
    orders = materialize(orders.where("not broken").drop("broken").join(texts, ["host", "class"]), "orders")
    other = came.join(orders, ["host", "class"]).where("word <> order")
    out = other.select("host", "class", F.explode(outside("word", "order", "texts")).alias("role")).groupBy("host", "class").agg(F.collect_set("role").alias("out"))
    kept = F.array_except("order", F.coalesce("out", F.array().cast("array<long>")))
    left = orders.join(out, ["host", "class"], "left").select("host", "class", F.posexplode(kept).alias("place", "role"))
    left = left.join(classes.select("host", "role", "class", "pages", "is_text"), ["host", "role", "class"])
    members = left.groupBy("host", "class", "pages").agg(F.array_sort(F.collect_list(F.struct("place", F.col("role").alias("token"), "is_text"))).alias("tokens"))
    return materialize(_classes(members, step), "ordered")


def _nested(rows: DataFrame, classes: DataFrame, step: int) -> DataFrame:
    """The classes without those that cross another."""

    def found(sums, page, host, roles, texts, known):
        for c in crossing(roles, known):
            sums[host, c] = []

    gone = materialize(per_page(rows, found, "host string, class long", step + 1, step).distinct(), "crossing")
    return materialize(classes.join(gone, ["host", "class"], "left_anti").select("host", *MEMBER), "members")


def host_templates(pages: DataFrame, min_pages: int) -> tuple[DataFrame, int]:
    """(host, packed) with the members of each host's valid classes, and the number of steps; texts in classes of the last step are template.

    A class is no longer than a page.
    """
    rows = materialize(sequences(pages), "sequences")
    before, known, last = None, None, None
    step = 0
    while True:
        vectors = role_vectors(pages_with(rows, known), step).where(F.col("pages") >= min_pages)
        same = vectors.groupBy("host", "pages", "total", F.col("vector").alias("class")).agg(
            F.array_sort(F.collect_list(F.struct("token", "is_text"))).alias("tokens"))
        found = materialize(_classes(same, step).select("host", *MEMBER), "found")
        with_them = lambda x: packed(x if before is None else before.unionByName(x))
        ordered = _ordered(pages_with(rows, with_them(found)), found, step).select("host", *MEMBER)
        members = _nested(pages_with(rows, with_them(ordered)), ordered, step)
        # roles only split, so classes that are the same again have the same slots and split no more
        state = members.agg(F.count(F.lit(1)), F.sum(F.xxhash64("host", "class", "place", "members").cast("decimal(20,0)"))).first()
        if state == last:
            return known, step
        last, before = state, members if before is None else before.unionByName(members)
        known = packed(before)
        step += 1
        if not state[0]:
            return known, step


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per page: `page_id`, `url`, `text`, `n_chars`."""
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), whole(F.col(f"`{html_col}`")).alias("html"))
    rows = rows.select("*", host_of(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("page"))
    found, n = host_templates(rows.select("page", "host", "html"), min_pages)
    rows = rows.join(small_lists(found), "host", "left")

    @F.pandas_udf(T.StringType())
    def extract(pages: pd.Series, hosts: pd.Series, templates: pd.Series) -> pd.Series:
        out, known = [], {}
        for page, host, template in zip(plain(pages), hosts, templates):
            if host not in known:
                known[host] = steps_of(template, n)
            tags, blocks, places = read(page)
            of_template = template_blocks(*sequence(tags, blocks, places), known[host]) if known[host][-1] else ()
            out.append("\n".join(main_blocks(blocks, of_template)))
        return pd.Series(out, dtype=object)

    out = rows.select("page_id", "url", extract.asNondeterministic()("html", "host", "packed").alias("text"))
    return out.select("*", F.length("text").cast("long").alias("n_chars"))
