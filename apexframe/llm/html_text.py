"""Operator 9: main text of web pages, with host suffix arrays against boilerplate.

1. Blocks. A page is cut at tags into blocks of text, each marked by its place: `main` (inside article, main or
   role=main), `chrome` (menus, headers, footers, sidebars, notices, adverts, forms, comments, recognised by tag, role,
   id or class) or `open` (neither). Scripts, styles, templates and markup comments are no text. The tokenizer takes linear
   time: a quote that is never closed makes the rest of the page's tags end at their first ">".
2. Host suffix array. The token streams of all blocks of all pages of a host are one string with a border after each page.
   Its suffixes are sorted by prefix doubling (only ties are sorted on), the longest common prefix of neighbours follows from
   the ranks of each doubling, and neighbours that share RUN tokens or more are one repeated substring. Pages of equal words
   count once, so copies don't make each other boilerplate. A host of more than PART_PAGES pages is parted by the pages' words
   and each part is a string of its own. What a share of the host's pages repeat, that share of some part's pages repeat: the
   runs that the arrays of the parts find are counted again on all parts, so counts and shares are those of the whole host.
3. Text, the same way for every page: the runs that the array leaves, less what tags tell to be no text. An `open` block (where
   the page has no main region) loses the repeated substrings at its ends, and goes if they cover all of it: repeated on
   LEAST_PAGES pages and one in SHARE of the host's. What repeats inside a block (a quotation) stays. A `main` block goes if it
   is repeated as a whole on LEAST_PAGES pages and half of the host's, while its neighbours in the region are not repeated:
   pages share article text (copies, quotations), and such text goes on beyond a block, a notice or a line to subscribe does not.
   `chrome` blocks go, repeated or not: a host with a single page repeats nothing.

Defined results: null and empty html give the empty text; unclosed and stray tags never drop content of main; repeated
rows (equal in all three columns) count as one page and give equal results; a null url is a host of its own; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, mix64, pieces, shingle_hashes, table, word_hashes

RUN = 8  # tokens
LEAST_PAGES, SHARE, MAIN_SHARE = 3, 20, 2
PART_PAGES = 512
BROADCAST_ROWS = 200_000  # hosts of more pages than that; 16 bytes each
MAIN, OPEN, CHROME = 0, 1, 2

RAW_TAGS = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
CHROME_TAGS = frozenset("nav footer aside form menu dialog button select svg canvas object audio video map head".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices overlay popup promo promoted promotion related respond share sharing sidebar signup site-footer site-header social sponsor sponsored subscribe subscription widget widgets".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|(!\[CDATA\[)|[!?])")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: What may stand beside a name of CHROME_NAMES in a class or id of several parts (share-bar, menu-item).
PART_NAMES = frozenset("area bar block body bottom box btn button buttons container content form global icon icons inner item items left link links list main outer page panel primary row secondary section site slot top toggle right unit wrap wrapper".split())
#: A start tag of the key ends an open element of the first set, up to one of the second.
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())), "tr": (frozenset(["tr"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
}
ENDS_P = BLOCK_TAGS - {"br", "caption", "html", "head", "body", "title", "option"}


def _attributes(attrs: str) -> dict[str, str]:
    """Values by name, both in lower case; the first of a repeated name counts."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(attrs):
        out.setdefault(name.lower(), "".join(values).lower())
    return out


def _names_chrome(word: str) -> bool:
    """Whether a class or id is a chrome name as a whole, or made of such names and PART_NAMES only."""
    parts = [x for x in re.split(r"[-_]+", word) if x]
    return word in CHROME_NAMES or any(x in CHROME_NAMES for x in parts) and all(x in CHROME_NAMES or x in PART_NAMES or x.isdigit() for x in parts)


def _is_chrome(tag: str, attrs: dict[str, str], inside_main: bool) -> bool:
    if tag in CHROME_TAGS or (tag == "header" and not inside_main):
        return True
    names = [*attrs.get("class", "").split(), *attrs.get("id", "").split()]
    if not attrs or tag in ("html", "body", "article", "main") and not any("comment" in x for x in names):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role") in CHROME_ROLES:
        return True
    return any(map(_names_chrome, names))


def _closed(tags: list[tuple[str, bool]]) -> list[int]:
    """Of every start tag the index of the tag that ends its element, or the number of tags; -1 - that index where this is
    not its own end tag. An end tag of other elements does not reach out of article and main.
    """
    ends, stack = [len(tags)] * len(tags), []
    where: dict[str, list[int]] = {}  # places on the stack, by tag

    def pop_to(depth: int, k: int, own: bool):
        while len(stack) > depth:
            i = stack.pop()
            where[tags[i][0]].pop()
            ends[i] = k if own and len(stack) == depth else -1 - k

    def last(names) -> int:
        return max((where[x][-1] for x in names if where.get(x)), default=-1)

    for k, (tag, closing) in enumerate(tags):
        if closing:
            at = last((tag,))
            if at >= 0 and (tag in ("article", "main", "body", "html") or at > last(("article", "main"))):
                pop_to(at, k, True)
            continue
        if tag in IMPLIED_ENDS:
            open_, bounds = IMPLIED_ENDS[tag]
            if (at := last(open_)) > last([*bounds, "article", "main"]):
                pop_to(at, k, False)
        if tag in ENDS_P and stack and tags[stack[-1]][0] == "p":
            pop_to(len(stack) - 1, k, False)
        if tag not in VOID_TAGS:
            where.setdefault(tag, []).append(len(stack))
            stack.append(k)
    pop_to(0, len(tags), False)
    return ends


def _markup(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of all markup, in one pass; tag is "" for comments and raw elements, which are
    closing where they part blocks."""
    found, pos, n, last, blind = [], 0, len(page), page.rfind(">"), False
    while (m := _OPEN.search(page, pos)) is not None:
        pos = m.end()
        if m[3] or m[4]:
            end = page.find("-->" if m[3] else "]]>", pos)
            pos = end + 3 if end >= 0 else n
            found.append((m.start(), pos, "", False, ""))
            continue
        if pos > last:
            continue  # no tag can end any more
        rest = None if blind or not m[2] else _REST.match(page, pos)
        blind = blind or bool(m[2]) and rest is None
        end = rest.end() if rest else page.find(">", pos) + 1
        tag, closing, attrs = (m[2] or "").lower(), bool(m[1]), page[pos : end - 1]
        pos = end
        if tag in RAW_TAGS and not closing:
            stop = re.compile(rf"</{tag}\b", re.I).search(page, pos)
            end = page.find(">", stop.end()) if stop else -1
            pos = end + 1 if end >= 0 else n
            found.append((m.start(), pos, "", tag in BLOCK_TAGS, ""))
        elif tag and attrs.endswith("/") and tag in CHROME_TAGS:
            found.append((m.start(), pos, "", tag in BLOCK_TAGS, ""))
        else:
            found.append((m.start(), pos, tag, closing, attrs))
    return found


def blocks_of(page: str) -> list[tuple[int, str]]:
    """(place, text) of every block with text, in page order.

    A chrome element goes to its end tag. Where it has none it goes to its parent's end, to a tag that ends it (li, td, a
    block after p), or to the next article or main, whichever comes first.
    """
    found, n = _markup(page), len(page)
    tags = [k for k, x in enumerate(found) if x[2]]
    ends = dict(zip(tags, _closed([(found[k][2], found[k][3]) for k in tags]), strict=True))
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    chrome_to = -1  # number among tags at which the open chrome element ends
    loose, mains, nth, pos = False, [], 0, 0

    def close():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append((CHROME if chrome_to >= 0 else MAIN if mains else OPEN, text))

    for k, (start, end, tag, closing, raw) in enumerate(found):
        if start > pos:
            parts.append(page[pos:start])
        pos = end
        if not tag:
            if closing:  # a block without text of its own
                close()
            continue
        if tag in BLOCK_TAGS:
            close()
        if chrome_to == nth or chrome_to >= 0 and loose and not closing and tag in ("article", "main"):
            close()
            chrome_to = -1
        while mains and mains[-1] <= nth:
            close()
            mains.pop()
        nth += 1
        if closing or chrome_to >= 0 or tag in VOID_TAGS:
            continue
        attrs, to = _attributes(raw) if raw.strip() else {}, ends[k]
        if _is_chrome(tag, attrs, bool(mains)):
            close()
            chrome_to, loose = (to, False) if to >= 0 and to < len(tags) else (-1 - to if to < 0 else to, True)
        elif tag in ("article", "main") or not mains and attrs.get("role") == "main":
            close()
            mains.append(-1 - to if to < 0 else to)
    if pos < n:
        parts.append(page[pos:])
    close()
    return out


def _parse(batches):
    for b in pieces(batches, "html"):
        found = [blocks_of(x or "") for x in b.column("html").to_pylist()]
        words, _, begin = _words_of([[t for _, t in x] for x in found])
        content = [hashlib.blake2b(words[lo:hi].tobytes(), digest_size=8).digest() for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([
            b.column("host"), b.column("parts"), pa.array(np.frombuffer(b"".join(content), np.int64)), b.column("page_id"), b.column("url"),
            pa.array([[p for p, _ in x] for x in found], pa.list_(pa.int8())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string())),
        ], ["host", "parts", "content", "page_id", "url", "places", "blocks"])


def _words_of(blocks: list[list[str]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Hashes of all words, of every page the first word of each block and the end of the last, and of every page the first
    word (one more than pages)."""
    words, first = word_hashes(pa.array([x for one in blocks for x in one], pa.string()))
    edges = np.concatenate(([0], np.cumsum([len(x) for x in blocks], dtype=np.int64)))
    return words, [first[lo : hi + 1] for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], first[edges]


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order, and of each but the last the longest common prefix with the next. The tokens at the ends of the
    strings that are put together must be unique.

    Prefix doubling: the rank of a suffix by its first 2h tokens follows from the ranks by h tokens at its place and h on.
    A rank is the number of smaller suffixes, so only suffixes that still share a rank are sorted again.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    new = np.concatenate(([True], tokens[order][1:] != tokens[order][:-1])) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, h = [(1, rank)], 1
    tied = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(tied):
        beyond = np.where(tied + h < n, rank[np.minimum(tied + h, n - 1)], -1)
        by = np.lexsort((beyond, rank[tied]))
        sub, old, beyond = tied[by], rank[tied][by], beyond[by]
        at = np.arange(len(sub))
        begin = np.concatenate(([True], old[1:] != old[:-1]))
        new = begin | np.concatenate(([True], beyond[1:] != beyond[:-1]))
        rank = rank.copy()
        rank[sub] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(begin, at, 0))
        h *= 2
        levels.append((h, rank))
        tied = tied[np.bincount(rank[tied], minlength=n)[rank[tied]] > 1]
    order = np.argsort(rank, kind="stable")
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, n - 1), np.int64)
    for h, r in reversed(levels):
        live = np.flatnonzero((a < n) & (b < n))
        live = live[r[a[live]] == r[b[live]]]
        common[live] += h
        a[live] += h
        b[live] += h
    return order, common


def repeated_on(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Of every place, the number of distinct pages that hold the `run` tokens from here; 0 where a page ends before."""
    order, common = suffix_array(tokens)
    group = np.concatenate(([0], np.cumsum(common < run))) if len(order) else np.zeros(0, np.int64)
    pairs = np.unique(np.stack((group, page[order])), axis=1) if len(order) else np.zeros((2, 0), np.int64)
    out = np.empty(len(order), np.int64)
    out[order] = np.bincount(pairs[0], minlength=len(order))[group]
    return out


def _covered(starts: np.ndarray, run: int, n: int) -> np.ndarray:
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    return np.cumsum(edge)[:n] > 0


_SPLIT = re.compile(r"[\x20\x09-\x0D]+")


def _kept(places: list[int], blocks: list[str], cut: np.ndarray, hit: np.ndarray, half: np.ndarray, run: int) -> str:
    """The text of a page. cut: first word of each block and the end; hit, half: where runs start that repeat, and those on
    half of the host's pages."""
    size = int(cut[-1]) if len(cut) else 0
    block = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    anywhere, within = _covered(hit, run, size), _covered(hit[block[hit] == block[hit + run - 1]], run, size)
    often = _covered(half, run, size)
    spans = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    mains, kept = [k for k, p in enumerate(places) if p == MAIN], []
    full, some = [bool(often[x:y].all()) for x, y in spans], [bool(anywhere[x:y].any()) for x, y in spans]
    for nth, k in enumerate(mains):
        beside = mains[max(0, nth - 1) : nth] + mains[nth + 1 : nth + 2]
        if not full[k] or not beside or any(some[x] for x in beside):
            kept.append(blocks[k])
    if not mains:
        for k, (p, (x, y)) in enumerate(zip(places, spans, strict=True)):
            if p == OPEN and not anywhere[x:y].all():
                own = np.flatnonzero(~within[x:y])
                kept += [" ".join(_SPLIT.split(blocks[k])[own[0] : own[-1] + 1])] if len(own) else []
    return "\n".join(kept)


def _counted(group: np.ndarray, content: np.ndarray, blocks: list[list[str]], run: int):
    """(page, hashes of its words, number of pages of its group that hold the run from each word) of one page of each content,
    and of every group its number of contents; all pages of the groups that occur."""
    _, whose = np.unique(np.stack((group, content)), axis=1, return_index=True)
    words, _, begin = _words_of([blocks[i] for i in whose])
    string, owner = [], np.repeat(np.arange(len(whose)), np.diff(begin) + 1)
    for k, i in enumerate(whose.tolist()):
        string += [mix64(words[begin[k] : begin[k + 1]] ^ U64(int(group[i]) & 0xFFFFFFFFFFFFFFFF)), mix64(np.array([k], np.uint64) + U64(0xA5A5A5A5A5A5))]
    times = repeated_on(np.concatenate(string) if string else words[:0], owner, run)
    total = dict(zip(*(x.tolist() for x in np.unique(group[whose], return_counts=True)), strict=True))
    return [(i, words[begin[k] : begin[k + 1]], times[begin[k] + k : begin[k + 1] + k]) for k, i in enumerate(whose.tolist())], total


def _repeating(times: np.ndarray, n: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs start that repeat on enough of n pages, and those on half of them."""
    hit = np.flatnonzero((times >= LEAST_PAGES) & (times * SHARE >= n))
    hit = hit[hit + run <= len(times)]
    return hit, hit[times[hit] * MAIN_SHARE >= n]


def _whole_groups(batches):
    """Tables of whole groups; rows come sorted by group."""
    held = None
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            rows = pa.Table.from_batches([b.slice(lo, 256)])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            group = rows.column("group").to_numpy()
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield rows.slice(0, cut)
            held = rows.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _texts(rows: pa.Table, text: list[str]) -> list[pa.Array]:
    return [rows.column("page_id").combine_chunks(), rows.column("url").combine_chunks(), pa.array(text, pa.string())]


def _unique_runs(run: int, batches):
    """Texts of hosts of one part."""
    for rows in _whole_groups(batches):
        group, content = rows.column("group").to_numpy(), rows.column("content").to_numpy()
        places, blocks = rows.column("places").to_pylist(), rows.column("blocks").to_pylist()
        pages, total = _counted(group, content, blocks, run)
        runs = {(int(group[i]), int(content[i])): _repeating(times, total[int(group[i])], run) for i, _, times in pages}
        cuts = [x - x[0] for x in _words_of(blocks)[1]]
        text = [_kept(*page, *runs[g, c], run) for *page, g, c in zip(places, blocks, cuts, group.tolist(), content.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(_texts(rows, text), ["page_id", "url", "text"])


def _candidates(run: int, batches):
    """Of every part: one row without key, with its number of pages, and the runs that repeat on one in SHARE of them; rest is
    the most pages of the part that a run can be on without being among these."""
    for rows in _whole_groups(batches):
        group, host = rows.column("group").to_numpy(), rows.column("host").to_numpy()
        pages, total = _counted(group, rows.column("content").to_numpy(), rows.column("blocks").to_pylist(), run)
        found = {g: (int(host[np.searchsorted(group, g)]), {}) for g in total}
        for i, words, times in pages:
            g = int(group[i])
            at = np.flatnonzero(times[: max(0, len(words) - run + 1)] * SHARE >= total[g])
            found[g][1].update(zip(shingle_hashes(words, run)[at].view(np.int64).tolist(), times[at].tolist(), strict=True))
        out = [(h, g, key, n, (total[g] - 1) // SHARE) for g, (h, runs) in found.items() for key, n in [(None, total[g]), *runs.items()]]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["host", "group", "key", "pages", "rest"])


def _as_they_are(batches):
    yield from batches


def _count_again(run: int, rows: pa.Table, wanted: pa.Table) -> pa.Table:
    """Of a part: the number of its pages that hold each wanted run."""
    counts = np.zeros(wanted.num_rows, np.int64)
    keys = np.sort(wanted.column("key").to_numpy())
    if len(keys):
        _, whose = np.unique(rows.column("content").to_numpy(), return_index=True)
        words, _, begin = _words_of(rows.column("blocks").take(pa.array(whose)).to_pylist())
        for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            own = np.unique(shingle_hashes(words[lo:hi], run).view(np.int64))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            counts[at[keys[at] == own]] += 1
    host = np.full(len(keys), rows.column("host")[0].as_py() if rows.num_rows else 0, np.int64)
    return pa.table({"host": host, "key": keys, "pages": counts})


def _unique_runs_of_part(run: int, rows: pa.Table, repeated: pa.Table) -> pa.Table:
    """Texts of a part's pages, by the runs that repeat on its host."""
    by = np.argsort(repeated.column("key").to_numpy())
    keys, half = repeated.column("key").to_numpy()[by], repeated.column("half").to_numpy()[by]
    blocks, text = rows.column("blocks").to_pylist(), []
    words, firsts, begin = _words_of(blocks)
    for places, own, first, lo, hi in zip(rows.column("places").to_pylist(), blocks, firsts, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        runs = shingle_hashes(words[lo:hi], run).view(np.int64)
        at = np.minimum(np.searchsorted(keys, runs), max(0, len(keys) - 1))
        hit = np.flatnonzero(keys[at] == runs) if len(keys) else np.zeros(0, np.int64)
        text.append(_kept(places, own, first - first[0], hit, hit[half[at[hit]]] if len(hit) else hit, run))
    return pa.Table.from_arrays(_texts(rows, text), ["page_id", "url", "text"])


def _by_whole_host(pages: DataFrame, run: int) -> DataFrame:
    """Texts of hosts of several parts. What can't be on enough pages of the host by the counts of its parts is not counted
    again, so the runs to count are few however many parts there are."""
    columns = "host long, group long, key long, pages long, rest long"
    told = pages.sortWithinPartitions("group").mapInArrow(partial(_candidates, run), columns).repartition("host", "key")
    told = told.mapInArrow(_as_they_are, columns)  # filters stay above the shuffle, so Spark makes it once for all its readers
    groups = told.where("key IS NULL").select("host", "group", "pages", "rest")
    hosts = groups.groupBy("host").agg(F.sum("pages").alias("n"), F.sum("rest").alias("rests"))
    found = told.where("key IS NOT NULL").groupBy("host", "key").agg(F.sum("pages").alias("pages"), F.sum("rest").alias("rest")).join(hosts, "host")
    most = F.col("pages") + F.col("rests") - F.col("rest")
    wanted = found.where((most >= LEAST_PAGES) & (most * SHARE >= F.col("n"))).select("host", "key")
    of_parts = lambda runs: runs.join(groups.select("host", "group"), "host").drop("host").groupBy("group")
    counts = pages.groupBy("group").cogroup(of_parts(wanted)).applyInArrow(lambda a, b: _count_again(run, a, b), "host long, key long, pages long")
    counts = counts.groupBy("host", "key").agg(F.sum("pages").alias("pages")).join(hosts, "host")
    repeated = counts.where((F.col("pages") >= LEAST_PAGES) & (F.col("pages") * SHARE >= F.col("n"))).select("host", "key", (F.col("pages") * MAIN_SHARE >= F.col("n")).alias("half"))
    return pages.groupBy("group").cogroup(of_parts(repeated)).applyInArrow(lambda a, b: _unique_runs_of_part(run, a, b), "page_id long, url string, text string")


def main_text(pages: DataFrame, run: int = RUN) -> DataFrame:
    """(page_id, url, html) to (page_id, url, text)."""
    name = F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)", 1)
    rows = pages.select(F.xxhash64(F.lower(name)).alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    large = rows.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") > PART_PAGES).select("host", F.ceil(F.col("pages") / PART_PAGES).alias("parts"))
    if large.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        large = F.broadcast(large)

    def parted(rows: DataFrame) -> DataFrame:
        parsed = rows.select("host", "parts", "page_id", "url", "html").mapInArrow(_parse, "host long, parts long, content long, page_id long, url string, places array<byte>, blocks array<string>")
        group = F.xxhash64("host", F.pmod("content", "parts")).alias("group")
        return parsed.select(group, "host", "content", "page_id", "url", "places", "blocks").repartition("group")

    small = parted(rows.join(large, "host", "left_anti").withColumn("parts", F.lit(1).cast("long")))
    texts = small.sortWithinPartitions("group").mapInArrow(partial(_unique_runs, run), "page_id long, url string, text string")
    return texts.unionByName(_by_whole_host(parted(rows.join(large, "host")), run))


def op9_host_suffix_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
