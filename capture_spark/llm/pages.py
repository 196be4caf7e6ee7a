"""Main text of web pages: block structure of each page, boilerplate by host suffix arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capture_spark.llm import text as tx
from capture_spark.llm.tables import stored

# Element names, the words in class, id and role that mark furniture, and words beside which they don't.
FURNITURE = frozenset("nav footer aside form script style noscript template button select textarea svg iframe menu dialog head title object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Words that mark furniture wherever they stand in a name.
STRONG = frozenset(
    "adsense advert adverts advertisement advertising breadcrumb breadcrumbs commentlist comments contentinfo cookie cookies disqus footer gdpr masthead menu nav navbar navigation newsletter pager pagination paywall "
    "popup promo share sharing sidebar signup sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# Words that mark furniture in names that hold nothing else but such words and places.
MARKS = frozenset(
    "ad ads adv banner comment consent copyright disclaimer discussion legal login modal notice notices overlay promoted promotion recommended related replies respond search social complementary alert dialog".split()
)
PLACES = frozenset(
    "area bar block body bottom box button buttons card col column container content contents form global group header home icons inner item items left link links list main mobile module outer panel primary right row secondary "
    "section site small large slot thread top unit wrap wrapper".split()
)
DENIALS = frozenset("has is no not without with category tag topic".split())
STATES = frozenset("enabled disabled open closed active visible on off ready loaded".split())
COMMENT = frozenset("comment comments reply replies".split())
ROOT_MARKS = frozenset("articlebody main".split())
LISTS = frozenset("ul ol li dl dt dd".split())
# End of fixed values.
LONG = 8  # a power of two
FEW = 3  # distinct pages
OPEN_SHARE, MAIN_SHARE = 0.25, 0.5
PAGES_PER_SHARD = 128
CHARS_PER_SHARD = 8 << 20
BROADCAST_RUNS = 1 << 18
PROSE_WORDS = 10


def _names(said: dict[str, str]) -> Iterator[list[str]]:
    """The words of each name in class, id and role."""
    for name in f"{said.get('class', '')} {said.get('id', '')} {said.get('role', '')}".split():
        yield re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())


def _furniture(said: dict[str, str], inline: bool) -> bool:
    """Whether a class, id or role names furniture, by all its words: one that always means it, or none that means anything else.

    A name that denies, classifies or tells a state (no-sidebar, tag-menu,
    search-enabled) names none, nor do weak words on an inline element.
    """
    for words in _names(said):
        if not words or (len(words) > 1 and (words[0] in DENIALS or words[-1] in STATES)):
            continue
        if not STRONG.isdisjoint(words):
            return True
        if not inline and not MARKS.isdisjoint(words) and all(w in MARKS or w in PLACES for w in words):
            return True
    return False


class _Blocks(HTMLParser):
    """Blocks of visible text in page order, each with the outermost marked part that it lies in (0: none) and its words outside links.

    Furniture elements that are numbered in ``unclosed`` end where the first
    block begins in them that is no list.
    """

    def __init__(self, unclosed: frozenset[int] = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, bool, int]] = []
        self.hidden = self.root = self.roots = self.links = self.starts = self.prose = 0
        self.parts: list[str] = []
        self.blocks: list[tuple[str, int, int]] = []
        self.given, self.unclosed = unclosed, set()

    def flush(self) -> None:
        if self.parts:
            line = " ".join("".join(self.parts).split())
            if line:
                self.blocks.append((line, self.roots if self.root else 0, self.prose))
            self.parts, self.prose = [], 0

    def _leave(self, k: int, closed: bool) -> None:
        """Take all elements from the kth on off the stack; all, or all but the kth if it is closed, were left open."""
        for j, (name, away, root, number) in enumerate(self.stack[k:]):
            if away:
                self.parts, self.prose = [], 0
                if not (closed and not j):
                    self.unclosed.add(number)
            self.hidden -= away
            self.root -= root
            self.links -= name == "a"
        del self.stack[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag not in INLINE:
            self.flush()
            if self.given and tag not in LISTS:
                for k, (_, away, _, number) in enumerate(self.stack):
                    if away and number in self.given:
                        self._leave(k, True)
                        break
        if tag in VOID:
            return
        away = tag in FURNITURE or (tag == "header" and not self.root)
        root = tag in ("article", "main")
        if attrs:
            said = {k: v or "" for k, v in attrs}
            if tag in ("article", "main"):  # whose classes speak of what they hold, unless it is a comment
                away = away or any(words and words[0] in COMMENT for words in _names(said))
            elif tag not in ("body", "html"):
                away = away or _furniture(said, tag in INLINE) or (not self.root and any("header" in words for words in _names(said)))
            away = away or "hidden" in said or said.get("aria-hidden") == "true" or "display:none" in said.get("style", "").replace(" ", "")
            root = root or said.get("role") == "main" or said.get("itemprop", "").lower() in ROOT_MARKS
        root = root and not away
        if away:
            self.flush()
        self.starts += 1
        self.stack.append((tag, away, root, self.starts))
        self.hidden += away
        self.roots += root and not self.root
        self.root += root
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE and tag != "br":
            self.flush()
        weak = tag in INLINE or tag == "p"
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                self._leave(k, True)
                return
            if weak and name not in INLINE and name != "p":
                return

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)
            if not self.links:
                self.prose += len(data.split())

    def done(self) -> list[tuple[str, int, int]]:
        self.close()
        self.flush()
        self._leave(0, False)
        return self.blocks


def page_blocks(html: str | None) -> list[tuple[str, bool]]:
    """(text, in the marked main part) of the blocks that a page's text may have.

    Where a page marks main parts, they count alone if they hold as many words
    of prose (blocks with ``PROSE_WORDS`` words outside links) as what lies
    outside; otherwise they are cards or the like, and only what lies outside counts.
    Furniture that is never closed ends before the first block in it that is no list.
    """
    if not html:
        return []
    parser = _Blocks()
    parser.feed(html)
    found = parser.done()
    if parser.unclosed:
        again = _Blocks(frozenset(parser.unclosed))
        again.feed(html)
        found = again.done()
    prose = [0, 0]
    for _, part, words in found:
        prose[part > 0] += words if words >= PROSE_WORDS else 0
    inside = any(part for _, part, _ in found) and prose[1] >= prose[0]
    return [(text, inside) for text, part, _ in found if (part > 0) == inside]


def suffix_order(tokens: np.ndarray, depth: int = LONG) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in order of their first ``depth`` tokens (a power of two), and their ranks in it, by prefix doubling.

    Suffixes of one rank have a longest common prefix of ``depth`` tokens or more.
    """
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size, order = 1, np.argsort(rank, kind="stable")
    while size < depth:
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - size] = rank[size:] + 1
        key = rank * (len(rank) + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(len(rank), np.int64)
        rank[order] = fresh
        size *= 2
    return order, rank


class _Stream:
    """The words of some pages' blocks, end to end, and the places where ``LONG`` words of one block begin."""

    def __init__(self, blocks: list[list[str]]):
        counts = [len(x) for x in blocks]
        self.words = tx.Words(pa.array([b for x in blocks for b in x], pa.large_string()))
        self.page_of = np.repeat(np.arange(len(blocks)), counts)
        self.hashes = self.words.hashes()
        self.starts = self.words.windows(LONG)

    def runs(self) -> np.ndarray:
        """The same number for the same words, in any stream."""
        return tx.Rolling(self.hashes).spans(self.starts, self.starts + LONG).view(np.int64)


def repeats(blocks: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """(run, distinct pages) of all substrings of ``LONG`` words: in suffix order they are runs of equal rank."""
    s = _Stream(blocks)
    if not len(s.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, rank = suffix_order(s.hashes.view(np.int64))
    rank = rank[s.starts]
    page = s.page_of[s.words.text[s.starts]]
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    return s.runs()[order[first]], np.add.reduceat(new.astype(np.int64), first)


def _shard_runs(group: pd.DataFrame) -> pd.DataFrame:
    """(host, run, n): the substrings on ``OPEN_SHARE`` of a shard's distinct pages, with their number; a null run counts the pages.

    A substring on that share of a host's pages is on that share of the pages of
    one of its shards at least.
    """
    once = group.drop_duplicates("key")
    runs, n = repeats(once["blocks"].tolist())
    often = n >= max(OPEN_SHARE * len(once), 1 if group["shards"].iloc[0] > 1 else FEW)
    run = pd.concat([pd.Series(runs[often], dtype="Int64"), pd.Series([None], dtype="Int64")], ignore_index=True)
    return pd.DataFrame({"host": group["host"].iloc[0], "shards": group["shards"].iloc[0], "run": run, "n": np.append(n[often], len(once))})


def _shard_counts(group: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """(host, run, n): on how many distinct pages of a shard the wanted substrings are."""
    if not len(group) or not len(wanted):
        return pd.DataFrame({"host": pd.Series([], dtype=str), "run": pd.Series([], dtype="int64"), "n": pd.Series([], dtype="int64")})
    s = _Stream(group.drop_duplicates("key")["blocks"].tolist())
    runs = s.runs()
    hit = np.isin(runs, wanted["run"].to_numpy(np.int64))
    pairs = np.unique(np.stack([runs[hit], s.page_of[s.words.text[s.starts[hit]]]], 1), axis=0)
    found, n = np.unique(pairs[:, 0], return_counts=True)
    return pd.DataFrame({"host": group["host"].iloc[0], "run": found, "n": n})


def kept_text(blocks: list[str], main: bool, runs: np.ndarray, often: np.ndarray) -> str:
    """A page's text without the words that boilerplate covers; ``often`` marks the substrings that count in a main part too.

    If boilerplate covers half of a marked part, or nine tenths of a page
    without one, the article itself is printed on several pages and all stays.
    """
    s = _Stream([blocks])
    marked = s.starts[np.isin(s.runs(), runs[often] if main else runs)]
    if not len(marked):
        return "\n".join(blocks)
    edge = np.zeros(len(s.words.start) + 1, np.int64)
    np.add.at(edge, marked, 1)
    np.add.at(edge, marked + LONG, -1)
    covered = np.cumsum(edge[:-1]) > 0
    if covered.mean() >= (0.5 if main else 0.9):
        return "\n".join(blocks)
    kept = []
    for k, b in enumerate(blocks):
        gone = covered[s.words.first[k] : s.words.first[k + 1]]
        kept.append(" ".join(w for w, x in zip(b.split(" "), gone, strict=True) if not x) if gone.any() else b)
    return "\n".join(b for b in kept if b)


def main_text(pages: DataFrame, per_shard: int = PAGES_PER_SHARD, broadcast_runs: int = BROADCAST_RUNS) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    One pass cuts each page into blocks of visible text, without elements that
    are furniture by name, class, id or role, and decodes character references.
    Where a page marks its main part (article, main), only blocks there count.
    The blocks of a host's distinct pages, in shards of about ``per_shard`` pages
    or ``CHARS_PER_SHARD`` characters by a digest of their text, are then put end
    to end, and a suffix array over their words finds the substrings of ``LONG``
    words on ``OPEN_SHARE`` of a shard's pages.  Those of a host with several
    shards are counted in all of them, so that how pages are dealt does not
    matter: boilerplate is on ``OPEN_SHARE`` of the host's distinct pages, in a
    marked part on ``MAIN_SHARE`` of them, and on ``FEW`` pages at least.  The words
    that it covers go, and what is left of each block stays.  A page keeps all
    if boilerplate covers half of its marked part, or nine tenths of a page
    without one: then the article itself is printed on several pages.
    A null or empty page has empty text; a page whose url names no host is
    judged alone; copies of a page count once and have one text; pages of any
    length, null ids, repeated rows and extra columns are allowed; an empty
    table gives no rows.

    Pages are parsed twice, once for the arrays and once for the texts, as a
    stored copy of the blocks takes more than that is worth.  Boilerplate is
    broadcast while it has at most ``broadcast_runs`` substrings, and joined by
    host beyond that.  Only hosts and boilerplate are written.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    source = pages.select("page_id", "url", "html", host.alias("host"))
    kind = dict(pages.dtypes)["page_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            blocks = pa.array([[t for t, _ in page_blocks(h)] for h in b.column(2).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blocks], names=["host", "shards", "blocks"])

    sizes = source.filter("host <> '' AND html <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars")).filter(F.col("pages") >= FEW)
    sizes = stored(sizes.select("host", F.greatest(F.ceil(F.col("pages") / per_shard), F.ceil(F.col("chars") / CHARS_PER_SHARD)).cast("long").alias("shards")), "hosts")
    parsed = source.join(sizes, "host").select("host", "shards", "html").mapInArrow(cut, "host string, shards long, blocks array<string>")
    # Copies of a page come to one shard, so that the counts of the shards add up.
    dealt = parsed.filter("size(blocks) > 0").withColumn("key", F.xxhash64(F.array_join("blocks", "\n"))).withColumn("shard", F.pmod("key", "shards"))
    runs = stored(dealt.groupBy("host", "shard").applyInPandas(_shard_runs, "host string, shards long, run long, n long"), "shard-runs")
    many = runs.filter("shards > 1 AND run IS NOT NULL").select("host", "shards", "run").distinct()
    counts = runs.filter("shards = 1 AND run IS NOT NULL").select("host", "run", "n")
    if many.limit(1).count():
        wanted = many.withColumn("shard", F.explode(F.expr("sequence(0L, shards - 1)")))
        large = dealt.filter("shards > 1").join(many.select("host").distinct(), "host", "left_semi")
        each = large.groupBy("host", "shard").cogroup(wanted.groupBy("host", "shard")).applyInPandas(_shard_counts, "host string, run long, n long")
        counts = counts.unionByName(each.groupBy("host", "run").agg(F.sum("n").alias("n")))
    whole = runs.filter("run IS NULL").groupBy("host").agg(F.sum("n").alias("pages"))
    marked = counts.join(whole, "host").filter((F.col("n") >= FEW) & (F.col("n") >= OPEN_SHARE * F.col("pages")))
    marked = stored(marked.select("host", "run", (F.col("n") >= MAIN_SHARE * F.col("pages")).alias("often")), "boilerplate")
    of_host = marked.groupBy("host").agg(F.collect_list("run").alias("runs"), F.collect_list("often").alias("often"))
    if marked.count() <= broadcast_runs:
        of_host = F.broadcast(of_host)

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.slices(batches, "html"):
            texts = []
            for html, r, o in zip(b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
                found = page_blocks(html)
                blocks = [t for t, _ in found]
                if r.is_valid and blocks:
                    texts.append(kept_text(blocks, found[0][1], r.values.to_numpy(), o.values.to_numpy(zero_copy_only=False)))
                else:
                    texts.append("\n".join(blocks))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    with_runs = source.join(of_host, "host", "left").select("page_id", "url", "html", "runs", "often")
    return with_runs.mapInArrow(text, f"page_id {kind}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
