"""Main text of web pages: markup rules, then a suffix array per host against repeated runs.

A page becomes text blocks in page order; containers that are never content (menus, headers, footers,
sidebars, forms, scripts, adverts, notices, comments) are left out by tag, role, class or id.
The token streams of a host's pages are then concatenated into a suffix array; runs of tokens that
occur on several distinct pages are boilerplate and are removed, unique runs stay. What a page
marks as its article is the author's statement of content: there a run counts as boilerplate only
where most pages of the host carry it. Outside the article of a page that has one nothing is kept.

Hosts are cut into shards of a bounded number of pages by a hash of what a page says, so a host of any
size is spread over tasks; the many copies of a page are dealt to further shards, where they are not
counted. Runs are counted over all shards of a host: each shard offers the first bits of its runs'
hashes, then the whole 64-bit hashes of those that enough pages of all shards hold, and gets back the totals.

Defined cases: null or empty html gives an empty text; a page without a host (null or broken url) is
grouped with the others of that kind; unclosed, broken or cut tags end where the page ends, and an
unclosed side container where an article starts; pages of equal content count as one page, so copies
never remove each other; repeated pages are extracted each; an empty table gives no rows.
Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeflow.llm.words import shingle

# fixed values: elements of the markup language
RAW_TEXT = ("script", "style", "textarea", "noscript", "template", "iframe", "noframes", "noembed", "xmp", "title", "svg", "math", "object", "select", "option", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_CONTENT = frozenset("nav header footer aside form button dialog menu fieldset label head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MAIN = frozenset(("article", "main"))
#: Words that mark a container as no content when they are a whole part of its class or id.
SIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner nav navbar navigation menu menus breadcrumb "
    "breadcrumbs sidebar sidebars aside footer header masthead comment comments commentlist disqus respond reply replies discussion notice notices cookie "
    "cookies consent gdpr alert newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations "
    "widget widgets pagination pager toolbar skip copyright disclaimer teaser teasers tags toc".split())

#: Words that stand beside them in such names.
LAYOUT_WORDS = frozenset(
    "a area article b bar block blog body bottom box btn button buttons c card col column columns container content count desktop entry fixed float floating "
    "form global group holder icon icons inner item items js l layout left link links list m main media message mobile o outer page panel part post primary "
    "region right row secondary section site slot small sticky text thread title top u ul unit user web wide wrap wrapper zone".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW_TEXT) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?P<end>>|\Z)"
    r"|</?[a-zA-Z][^>]*\Z",
    re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_BLANK = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    main: bool


def _side_name(name: str) -> bool:
    """Whether a class or id names a side container: side words and words of layout only.

    "with-sidebar" and the like describe the layout, "social-security" the subject.
    """
    parts = [p.lower() for p in _PARTS.findall(name)]
    if not parts or parts[0] in ("has", "with", "no", "without", "is") or SIDE_WORDS.isdisjoint(parts):
        return False
    return all(p in SIDE_WORDS or p in LAYOUT_WORDS for p in parts)


def _is_side(tag: str, attrs: str) -> bool:
    if tag in NEVER_CONTENT:
        return True
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "role":
            if value.lower().strip() in SIDE_ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
        elif tag not in ("body", "html", "article", "main") and any(_side_name(v) for v in value.split()):
            return True
    return False


def page_blocks(page: str) -> list[Block]:
    """Text blocks outside side containers, each marked if it lies in an article or main element."""
    blocks: list[Block] = []
    stack: list[str] = []
    side: int | None = None  # depth of the outermost side container
    open_ended: bool | None = None  # whether that container is never closed; looked up when an article starts inside
    main = 0
    parts: list[str] = []

    def flush():
        if parts:
            text = _BLANK.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append(Block(text, main > 0))
            parts.clear()

    at = 0
    for m in _TOKEN.finditer(page):
        if side is None and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"] and side is None:
                flush()
            continue
        if not m["end"]:  # a tag cut off by the end of the page
            continue
        tag = tag.lower()
        if not m["close"]:
            if tag in VOID:
                if side is None and tag in ("br", "hr"):
                    if tag == "hr":
                        flush()
                    else:
                        parts.append(" ")
                continue
            if side is None and tag not in INLINE:
                flush()
            if tag == "body":  # whatever the head left open ends here
                stack.clear()
                side, main = None, 0
            if tag == "p" and side is None and "p" in stack:  # a paragraph ends the one before it
                above = stack[len(stack) - stack[::-1].index("p") :]
                if all(t in INLINE for t in above):
                    _pop(stack, "p")
            if tag in MAIN and side is not None:
                if open_ended is None:
                    open_ended = _never_closed(page, m.end(), stack[side - 1])
                if open_ended:  # an unclosed menu ends where the article starts
                    del stack[side - 1 :]
                    side = None
            stack.append(tag)
            if side is None and _is_side(tag, m["attrs"]):
                flush()
                side, open_ended = len(stack), None
            elif side is None and tag in MAIN:
                main += 1
        elif tag in stack:
            if side is None and tag not in INLINE:
                flush()
            for gone in _pop(stack, tag):
                if side is None and gone in MAIN:
                    main -= 1
            if side is not None and len(stack) < side:
                side = None
    if side is None:
        parts.append(page[at:])
    flush()
    return blocks


def _never_closed(page: str, at: int, tag: str) -> bool:
    """Whether the page holds no end for an element that is open at this place."""
    rest = page[at:]
    return len(re.findall(rf"</{tag}\b", rest, re.I)) <= len(re.findall(rf"<{tag}\b", rest, re.I))


def _pop(stack: list[str], tag: str) -> list[str]:
    """Close ``tag`` and what is open inside it; inline elements never close blocks around them."""
    i = len(stack) - 1 - stack[::-1].index(tag)
    if tag in INLINE and any(t not in INLINE for t in stack[i + 1 :]):
        return [stack.pop(i)]
    gone = stack[i:]
    del stack[i:]
    return gone


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` tokens or more (prefix doubling), and the rank of each place."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, known = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while known < depth and n:
        second = np.zeros(n, np.int64)
        second[: n - known if n > known else 0] = rank[known:] + 1
        key = rank.astype(np.int64) * (n + 2) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]) if n else np.zeros(0, np.int64)
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        known *= 2
        if n and fresh[-1] == n - 1:
            break
    return order, rank


def run_pages(tokens: np.ndarray, page: np.ndarray, length: int, counted: np.ndarray | None = None) -> np.ndarray:
    """For each token, the number of distinct (``counted``) pages with the run of ``length`` tokens that starts at it.

    Runs are read off the suffix array: neighbouring suffixes that agree on ``length`` tokens form an
    interval, and an interval's distinct pages are counted once. A run never crosses two streams
    when the caller puts a unique token between them.
    """
    n = len(tokens)
    if n < length:
        return np.ones(n, np.int64)
    order, rank = suffix_array(tokens, length)
    same = np.ones(n - 1, bool)  # suffix neighbours agree on `length` tokens
    a, b = order[:-1], order[1:]
    same &= (a + length <= n) & (b + length <= n)
    equal_rank = rank[a] == rank[b]
    check = np.flatnonzero(same & ~equal_rank)
    for k in range(length):
        check = check[tokens[np.minimum(a[check] + k, n - 1)] == tokens[np.minimum(b[check] + k, n - 1)]]
    agree = equal_rank & same
    agree[check] = True
    group = np.cumsum(np.r_[0, ~agree])
    pages = int(page.max()) + 1
    pairs = np.unique(group.astype(np.int64) * pages + page[order])
    count = np.bincount(pairs // pages, None if counted is None else counted[pairs % pages], minlength=int(group[-1]) + 1)
    start = np.ones(n, np.int64)
    start[order] = count[group]
    return start


def covered(start: np.ndarray, length: int) -> np.ndarray:
    """For each token, the largest of the numbers of the runs over it; a run covers the ``length`` tokens from its start."""
    cover, n = start.copy(), len(start)
    for k in range(1, min(length, n)):
        cover[k:] = np.maximum(cover[k:], start[: n - k])
    return cover


def repeated_pages(tokens: np.ndarray, page: np.ndarray, length: int) -> np.ndarray:
    """For each token, the largest number of distinct pages on which a run of ``length`` tokens over it occurs."""
    return np.maximum(covered(run_pages(tokens, page, length), length), 1)


PARSED = "page_id long, url string, texts array<string>, mains array<boolean>, content long"
#: Shards whose runs are counted in one task.
SHARDS_TOGETHER = 16
OFFERED = "host string, bucket int, shard int, keys binary, counts binary"
SHARED = "host string, shard int, keys binary, counts binary"
CLEANED = "page_id long, url string, text string, n_chars long"


def said(texts: list[str], mains: list[bool]) -> tuple[str, ...]:
    """The blocks that can be content: those of the articles if the page has any."""
    return tuple(t for t, m in zip(texts, mains) if m) if any(mains) else tuple(texts)


def _parse(batches):
    for batch in batches:
        texts, mains, content = [], [], []
        for page in batch.column(2):
            blocks = page_blocks(page.as_py() or "")
            texts.append([b.text for b in blocks])
            mains.append([b.main for b in blocks])
            content.append(xxhash.xxh64_intdigest("\n".join(said(texts[-1], mains[-1])).encode()))  # blocks hold no line ends
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.list_(pa.string())), pa.array(mains, pa.list_(pa.bool_())),
             pa.array(np.array(content, np.uint64).view(np.int64))],
            ["page_id", "url", "texts", "mains", "content"])


class Shard:
    """The distinct contents of a shard's pages as one stream of tokens, a token of its own behind each block."""

    def __init__(self, table: pa.Table):
        texts, mains = table.column("texts").to_pylist(), table.column("mains").to_pylist()
        number: dict[tuple[str, ...], int] = {}
        # pages that say the same count as one: what repeats must do so beside other text
        self.of = [number.setdefault(said(own, main), len(number)) for own, main in zip(texts, mains)]
        self.main = [any(main) for main in mains]
        self.shards = table.column("shards")[0].as_py()
        self.contents = table.column("contents")[0].as_py() if self.shards > 1 else len(number)
        self.counted = np.zeros(len(number), np.int64)
        self.counted[np.array(self.of)[table.column("counted").to_numpy()]] = 1
        code: dict[str, int] = {}
        stream, owner, self.blocks = [], [], [[] for _ in number]
        for n, own in enumerate(number):
            for text in own:
                words = text.split(" ")
                self.blocks[n].append((text, len(stream), len(words)))
                stream.extend([code.setdefault(w, len(code)) for w in words])
                stream.append(-1 - len(stream))  # runs stay inside a block
                owner.extend([n] * (len(words) + 1))
        self.tokens, self.owner, self.words = np.array(stream, np.int64), np.array(owner, np.int64), list(code)

    def keys(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all runs and the runs' 64-bit hashes, the same in every shard."""
        if len(self.tokens) < length:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in self.words), np.uint64, len(self.words))
        ends = np.cumsum(self.tokens < 0)
        start = np.flatnonzero((ends[length - 1 :] == ends[: len(ends) - length + 1]) & (self.tokens[: len(ends) - length + 1] >= 0))
        return start, shingle(hashes[np.maximum(self.tokens, 0)], length)[start]

    def counts(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs' hashes, ascending, and the number of counted contents that hold each."""
        start, keys = self.keys(length)
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], self.owner[start[order]]
        fresh = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        first = np.flatnonzero(fresh)
        once = fresh | np.r_[True, owner[1:] != owner[:-1]][: len(keys)]
        return keys[first], np.add.reduceat(once * self.counted[owner], first) if len(first) else np.zeros(0, np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as gaps, byte plane by byte plane, which compresses well."""
    return np.diff(keys, prepend=np.uint64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint64)


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _offer(table: pa.Table, shards: int, keys: np.ndarray, bucket: np.ndarray, counts: np.ndarray, pack) -> pa.Table:
    """One row per bucket with the shard's keys there."""
    edges = np.searchsorted(bucket, np.arange(-(-shards // SHARDS_TOGETHER) + 1))
    rows = [(b, lo, hi) for b, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if hi > lo]
    n = len(rows)
    return pa.table({
        "host": pa.array(table.column("host")[:1].to_pylist() * n, pa.string()), "bucket": pa.array([b for b, _, _ in rows], pa.int32()),
        "shard": pa.array(table.column("shard")[:1].to_pylist() * n, pa.int32()), "keys": pa.array([pack(keys[lo:hi]) for _, lo, hi in rows], pa.binary()),
        "counts": pa.array([counts[lo:hi].astype(np.uint32).tobytes() for _, lo, hi in rows], pa.binary())})


def _short(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The first bits of the hashes, so many that few of a host's runs agree on them by chance, and their buckets."""
    bits = min(32, 24 + (shards - 1).bit_length())
    short = keys >> np.uint64(64 - bits)
    return short, (short * np.uint64(-(-shards // SHARDS_TOGETHER))) >> np.uint64(bits)


def _offer_short(length: int):
    """The first bits of the hashes of a shard's runs, if its host has others."""

    def run(table: pa.Table) -> pa.Table:
        shards = table.column("shards")[0].as_py()
        if shards == 1:
            return _offer(table, 1, *[np.zeros(0, np.uint64)] * 3, _pack)
        keys, counts = Shard(table).counts(length)
        short, bucket = _short(keys, shards)
        first = np.flatnonzero(np.r_[True, short[1:] != short[:-1]][: len(short)])
        counts = np.add.reduceat(counts, first) if len(first) else counts
        return _offer(table, shards, short[first], bucket[first], counts, _pack)

    return run


def _offer_whole(length: int):
    """The whole hashes of the runs whose first bits are frequent enough over all shards."""

    def run(table: pa.Table, wanted: pa.Table) -> pa.Table:
        shards = table.column("shards")[0].as_py()
        if not wanted.num_rows:
            return _offer(table, 1, *[np.zeros(0, np.uint64)] * 3, np.ndarray.tobytes)
        keys, counts = Shard(table).counts(length)
        short, bucket = _short(keys, shards)
        on = np.isin(short, np.concatenate([_wide(k) for k in wanted.column("keys").to_pylist()]))
        return _offer(table, shards, keys[on], bucket[on], counts[on], np.ndarray.tobytes)

    return run


def _totals(least: int, unpack):
    """For each shard of a host, its keys that ``least`` contents hold over all shards, if others add to its own count."""

    def run(table: pa.Table) -> pa.Table:
        keys = [unpack(k) for k in table.column("keys").to_pylist()]
        own = [np.frombuffer(c, np.uint32) for c in table.column("counts").to_pylist()]
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, np.concatenate(own)).astype(np.int64)[at]
        ends = np.cumsum([0, *map(len, keys)])
        out = []
        for shard, k, c, lo in zip(table.column("shard").to_pylist(), keys, own, ends.tolist()):
            mine = total[lo : lo + len(k)]
            on = (mine >= least) & (mine > c)
            if on.any():
                out.append((shard, k[on].astype(np.uint64).tobytes(), mine[on].tobytes()))
        columns = list(zip(*out)) if out else [(), (), ()]
        return pa.table({
            "host": pa.array(table.column("host")[:1].to_pylist() * len(out), pa.string()), "shard": pa.array(columns[0], pa.int32()),
            "keys": pa.array(columns[1], pa.binary()), "counts": pa.array(columns[2], pa.binary())})

    return run


def _clean(length: int, least_pages: int, most_share: float, enough_pages: int):
    def run(table: pa.Table, shared: pa.Table) -> pa.Table:
        shard = Shard(table)
        start = run_pages(shard.tokens, shard.owner, length, shard.counted) if len(shard.tokens) else shard.tokens
        if shared.num_rows:  # runs that other shards of the host hold too
            known, total = (np.concatenate([np.frombuffer(v, t) for v in shared.column(c).to_pylist()]) for c, t in (("keys", np.uint64), ("counts", np.int64)))
            order = np.argsort(known)
            known, total = known[order], total[order]
            place, keys = shard.keys(length)
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = known[at] == keys
            start[place[hit]] = total[at[hit]]
        cover = covered(start, length)
        main_bar = max(enough_pages, int(np.floor(most_share * shard.contents)) + 1)
        done: dict[tuple[int, bool], str] = {}

        def cleaned(n: int, main: bool) -> str:
            out = []
            for text, at, size in shard.blocks[n]:
                gone = cover[at : at + size] >= (main_bar if main else least_pages)
                if not gone.any():
                    out.append(text)
                elif not gone.all():
                    out.append(" ".join(w for w, g in zip(text.split(" "), gone.tolist()) if not g))
            return " ".join(out)

        text = []
        for key in zip(shard.of, shard.main):
            if key not in done:
                done[key] = cleaned(*key)
            text.append(done[key])
        return pa.table({
            "page_id": table.column("page_id"), "url": table.column("url"),
            "text": pa.array(text, pa.string()), "n_chars": pa.array(map(len, text), pa.int64())})

    return run


def host(url: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit("")), F.lit(""))


def extract_text(
    pages: DataFrame, run_length: int = 8, least_pages: int = 3, most_share: float = 0.6, enough_pages: int = 20, shard_pages: int = 400
) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    ``run_length`` tokens repeated on ``least_pages`` pages of a host are boilerplate; inside an
    article on more than ``most_share`` of them and at least ``enough_pages``.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    parsed = rows.mapInArrow(_parse, PARSED).withColumn("host", host(F.col("url")))
    contents = parsed.groupBy("host", "content").count()
    many = F.when(F.col("count") > shard_pages, F.struct("content", "count"))
    hosts = contents.groupBy(F.col("host").alias("h")).agg(
        F.sum("count").alias("pages"), F.count("*").alias("contents"), F.map_from_entries(F.collect_list(many)).alias("copies"))
    hosts = hosts.filter(F.col("pages") > shard_pages)  # hosts and copies: at most one for each shard_pages pages
    spread = F.ceil(F.coalesce(F.try_element_at("copies", F.col("content")), F.lit(1)) / shard_pages)
    dealt = (
        parsed.join(F.broadcast(hosts), F.col("host") == F.col("h"), "left")
        .withColumn("shards", F.ceil(F.coalesce("pages", F.lit(1)) / shard_pages).cast("int"))
        .withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), spread))
        .select("page_id", "url", "texts", "mains", "host", F.pmod(F.pmod("content", F.col("shards")) + F.col("salt"), F.col("shards")).cast("int").alias("shard"),
                "shards", "contents", (F.col("salt") == 0).alias("counted"))
    )
    least = min(least_pages, enough_pages)
    shards = dealt.groupBy("host", "shard")
    shared = lambda offered, unpack: offered.groupBy("host", "bucket").applyInArrow(_totals(least, unpack), SHARED).groupBy("host", "shard")
    wanted = shared(shards.applyInArrow(_offer_short(run_length), OFFERED), _unpack)
    totals = shared(shards.cogroup(wanted).applyInArrow(_offer_whole(run_length), OFFERED), _wide)
    return shards.cogroup(totals).applyInArrow(_clean(run_length, least_pages, most_share, enough_pages), CLEANED)
