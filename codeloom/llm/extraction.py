"""Main text of web pages by equivalence-class template deduction.

The tokens of a page are its elements (by path) and its text blocks (with their path). Over the pages of a host, each token has
an occurrence vector: how often it occurs on each page. Tokens with one vector form an equivalence class; its fingerprint is a sum
and an exclusive or of hashes over pages, so vectors are compared without gathering a host's pages. Classes with enough tokens and
pages are valid; the class that covers most pages is the root of the host's template, and a valid class whose tokens lie between
two tokens of another is nested in that slot. Text tokens of the template are boilerplate; what stands in its containers otherwise
are the slots. The main one is the deepest container of the template that holds MAIN_SHARE of the host's text outside links and
boilerplate; containers that hold links for the most part are no slots of text. Hosts with fewer than LEAST_PAGES pages share the
template of their domain (the host without its first label), whose vectors are sums of theirs.

Where a page has its template's main slot, that slot decides, and the page's markup only strikes what it names as other (forms,
asides, comments) inside. Pages without a template, or without its slot, are read by their markup: the article, else the fullest
container.

Statistics are sums per host and token, aggregated before the shuffle; hosts with very many pages are joined by broadcast. The
templates are counted: up to MOST_BROADCAST entries they are broadcast and no page is shuffled; beyond that they are joined to pages
by host and salt, so a host with a third of all pages is no hot key.

Defined cases: null and empty pages give an empty text; pages without host form one group of their own; equal pages get equal
texts; cut-off pages keep what they have; pages of any length are read whole; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import arrow_rows, cut
from codeloom.llm.html_blocks import PIECES, Block, blocks
from codeloom.llm.url_rules import host_and_path
from codeloom.operators.joins import hot_join

#: Pages of a host or domain, pages of a class, share of the pages, and tokens that a valid class needs.
LEAST_PAGES, LEAST_OF_CLASS, LEAST_SHARE, LEAST_TOKENS = 4, 3, 0.3, 2
#: Share of text that the main slot holds; share of pages from which a text inside it is boilerplate, and the most of it that may go so.
MAIN_SHARE, IN_ARTICLE_SHARE, MOST_OF_ARTICLE = 0.6, 0.8, 0.5
SALTS = 64
#: Template entries (8 bytes each) that are broadcast at most.
MOST_BROADCAST = 1_000_000
TEXT, CONTAINER, PIECE = 1, 0, 2


def _hash(kind: str, path: str, text: str = "") -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x1f{path}\x1f{text}".encode("utf-8", "surrogatepass")) >> 1


def parts(path: str) -> list[str]:
    """The paths of all elements around a block, the outermost first."""
    out, at = [], path.find(">", 1)
    while at > 0:
        out.append(path[:at])
        at = path.find(">", at + 1)
    return [*out, path] if path else []


def page_tokens(found: list[Block]) -> dict[int, list]:
    """Token -> [kind, occurrences, first position, depth, characters, of those in links, characters outside links that the markup
    does not name as other, paths around it]. A container has what all blocks inside it have."""
    out: dict[int, list] = {}
    held: dict[str, int] = {}
    elements: dict[int, set[int]] = {}

    def add(key: int, kind: int, at: int, depth: int, b: Block, ups: list[int]) -> list:
        x = out.setdefault(key, [kind, 0, at, depth, 0, 0, 0, ups])
        x[4] += len(b.text)
        x[5] += b.links
        x[6] += 0 if b.other else len(b.text) - b.links
        return x

    for at, b in enumerate(found):
        ups = []
        for depth, part in enumerate(parts(b.path)):
            key = held.get(part)
            if key is None:
                key = held[part] = _hash("path", part)
            ups.append(key)
            name = part[part.rfind(">") + 1 :].partition(".")[0]
            add(key, PIECE if name in PIECES else CONTAINER, at, depth, b, [])
            elements.setdefault(key, set()).add(b.ids[depth])
        add(_hash("text", b.path, b.text), TEXT, at, len(ups), b, ups)[1] += 1
    for key, own in elements.items():
        out[key][1] = len(own)
    return out


def _statistics(pages: DataFrame) -> DataFrame:
    """(host, token, kind, depth, pages, vector, position, chars, links, free, ups) over the pages of each host."""

    def each(batch) -> dict:
        cols: dict[str, list] = {k: [] for k in ("host", "token", "kind", "mark", "at", "depth", "chars", "links", "free", "ups")}
        for host, url, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            html = h.as_py() or ""
            found = blocks(html)
            page = f"{url}\x1f{xxhash.xxh64_intdigest(html.encode('utf-8', 'surrogatepass'))}"
            marks: dict[int, int] = {}
            for token, (kind, count, at, depth, chars, links, free, ups) in page_tokens(found).items():
                if count not in marks:
                    marks[count] = int(np.uint64(xxhash.xxh64_intdigest(f"{page}\x1f{count}")).astype(np.int64))
                for k, v in zip(cols, (host, token, kind, marks[count], at / max(1, len(found)), depth, chars, links, free, ups)):
                    cols[k].append(v)
        return cols

    raw = arrow_rows(pages, ["host", "url", "html"], "host string, token long, kind int, mark long, at double, depth int, chars long, links long, free long, ups array<long>", each)
    # 20 bits a page: the sum holds for 2^43 pages
    return raw.groupBy("host", "token", "kind", "depth").agg(
        F.count(F.lit(1)).alias("pages"), F.bit_xor("mark").alias("vector"), F.sum(F.col("mark").bitwiseAND(0xFFFFF)).alias("total"), F.sum("at").alias("at"),
        *[F.sum(c).alias(c) for c in ("chars", "links", "free")], F.first("ups").alias("ups"),
    )


def _scopes(pages: DataFrame) -> DataFrame:
    """(host, host_pages, scope, scope_pages): a host with enough pages by itself, others by their domain."""
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    domain = F.regexp_extract("host", r"^[^.]*\.(.*\..*)$", 1)
    scope = F.when((F.col("host_pages") >= LEAST_PAGES) | (domain == ""), F.concat(F.lit("host "), "host")).otherwise(F.concat(F.lit("domain "), domain))
    scoped = cut(hosts.withColumn("scope", scope), "hosts")
    return scoped.join(scoped.groupBy("scope").agg(F.sum("host_pages").alias("scope_pages")), "scope").where(F.col("scope_pages") >= LEAST_PAGES)


def templates(pages: DataFrame) -> DataFrame:
    """(host, boilerplate, frequent, main, linked): hashes of the host's template texts, of those on nearly all pages, of the path of
    the main slot, and of the containers of links."""
    scopes = cut(_scopes(pages), "scopes")
    own = hot_join(cut(_statistics(pages), "tokens"), scopes.withColumn("times", F.col("host_pages")), ["host"], "times", pages.count())
    sums = [F.sum(c).alias(c) for c in ("pages", "total", "at", "chars", "links", "free")]
    # what is on few pages of a large host goes here, so such a host brings few rows
    by_scope = own.where((F.col("host_pages") < LEAST_PAGES) | (F.col("pages") >= F.greatest(F.lit(LEAST_OF_CLASS), F.ceil(LEAST_SHARE * F.col("scope_pages")))))
    summed = by_scope.groupBy("scope", "scope_pages", "token", "kind", "depth").agg(*sums, F.bit_xor("vector").alias("vector"), F.first("ups").alias("ups"))
    frequent = summed.where(F.col("pages") >= F.greatest(F.lit(LEAST_OF_CLASS), F.ceil(LEAST_SHARE * F.col("scope_pages")))).withColumn("position", F.col("at") / F.col("pages"))
    # an equivalence class: tokens with one occurrence vector; frequent tokens are bounded by those of 1 / LEAST_SHARE pages
    classes = frequent.groupBy("scope", "scope_pages", "pages", "vector", "total").agg(F.collect_list(F.struct("position", "token", "kind", "depth", "chars", "links", "free", "ups")).alias("tokens"), F.min("position").alias("low"), F.max("position").alias("high"))
    valid = classes.where(F.size("tokens") >= LEAST_TOKENS)
    widest = F.struct("pages", F.size("tokens"), "vector")
    root = valid.groupBy("scope").agg(F.max_by("low", widest).alias("root_low"), F.max_by("high", widest).alias("root_high"))
    nested = valid.join(root, "scope").where((F.col("low") >= F.col("root_low")) & (F.col("high") <= F.col("root_high")))
    token = cut(nested.select("scope", "scope_pages", "pages", F.explode("tokens").alias("t")).select("scope", "scope_pages", "pages", "t.*"), "template")
    # boilerplate is no content of the containers around it
    fixed = token.where(F.col("kind") == TEXT).select("scope", F.explode("ups").alias("token"), "free").groupBy("scope", "token").agg(F.sum("free").alias("fixed"))
    held = token.where(F.col("kind") == CONTAINER).join(fixed, ["scope", "token"], "left").withColumn("mass", F.col("free") - F.coalesce("fixed", F.lit(0)))
    most = held.groupBy("scope").agg(F.max("mass").alias("most"))
    full = (F.col("mass") >= MAIN_SHARE * F.col("most")) & (F.col("mass") > 0)
    slots = held.join(most, "scope").groupBy("scope").agg(
        F.max_by(F.when(full, F.col("token")), F.when(full, F.struct("depth", "mass", "token"))).alias("main"),
        F.collect_set(F.when(F.col("links") * 2 >= F.col("chars"), F.col("token"))).alias("linked"),
    )
    texts = token.groupBy("scope").agg(
        F.collect_set(F.when(F.col("kind") == TEXT, F.col("token"))).alias("boilerplate"),
        F.collect_set(F.when((F.col("kind") == TEXT) & (F.col("pages") >= IN_ARTICLE_SHARE * F.col("scope_pages")), F.col("token"))).alias("frequent"),
    )
    return scopes.select("host", "scope").join(texts, "scope").join(slots, "scope", "left").select("host", "boilerplate", "frequent", "main", F.coalesce("linked", F.array().cast("array<long>")).alias("linked"))


def _size(found: list[Block]) -> int:
    return sum(len(b.text) for b in found)


def _without(found: list[Block], texts: set[int]) -> list[Block]:
    """The blocks without frequent texts, unless these are most of them (copies of one page)."""
    left = [b for b in found if _hash("text", b.path, b.text) not in texts] if texts else found
    return left if _size(left) >= MOST_OF_ARTICLE * _size(found) else found


def by_template(found: list[Block], frequent: set[int], main: int | None, linked: set[int]) -> list[str]:
    """Texts of the template's main slot, in page order; empty if the page does not have it."""
    if main is None:
        return []
    held: dict[str, list[int]] = {}
    inside = []
    for b in found:
        if b.path not in held:
            held[b.path] = [_hash("path", p) for p in parts(b.path)]
        ups = held[b.path]
        if main in ups and not b.other and not any(u in linked for u in ups[ups.index(main) + 1 :]):
            inside.append(b)
    return [b.text for b in _without(inside, frequent)]


def by_markup(found: list[Block], boilerplate: set[int], frequent: set[int]) -> list[str]:
    """Texts of what the page's markup names as its article, else of its fullest container, in page order."""
    rest = [b for b in found if not b.other]
    for rank in (3, 2, 1):
        own = [b for b in rest if b.main >= rank]
        if own:
            return [b.text for b in _without(own, frequent)]
    rest = [b for b in rest if _hash("text", b.path, b.text) not in boilerplate] if boilerplate else rest
    if not rest:
        return []
    mass: dict[str, float] = {}
    for b in rest:
        for part in parts(b.path):
            mass[part] = mass.get(part, 0) + len(b.text) - 2 * b.links
    total = max(mass.values(), default=0)
    inside = max([p for p in mass if mass[p] >= MAIN_SHARE * total] or [""], key=lambda p: p.count(">"))
    inside = inside.rpartition(">")[0] if inside.rpartition(">")[2].partition(".")[0] in PIECES else inside
    return [b.text for b in rest if (b.path + ">").startswith(inside + ">") and b.links * 2 <= len(b.text)] or [b.text for b in rest]


def choose(found: list[Block], boilerplate: set[int], frequent: set[int], main: int | None, linked: set[int]) -> list[str]:
    """Texts of a page's article, in page order: the template's main slot, or what the markup says."""
    return by_template(found, frequent, main, linked) or by_markup(found, boilerplate, frequent)


def extract(pages: DataFrame, most_broadcast: int = MOST_BROADCAST, deduce: bool = True) -> DataFrame:
    """(page_id, url, text) of every page. Without `deduce`, no templates are made and markup alone decides."""
    host, _ = host_and_path(F.col("url"))
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    known = cut(templates(keyed) if deduce else templates(keyed.limit(0)), "templates")
    entries = known.agg(F.sum(F.size("boilerplate") + F.size("frequent") + F.size("linked") + 8)).first()[0] or 0
    if entries <= most_broadcast:
        joined = keyed.join(F.broadcast(known), "host", "left")
    else:
        salted = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

    def each(batch) -> dict:
        out = []
        for h, boiler, often, main, linked in zip(batch.column(2), *(batch.column(k) for k in (3, 4, 5, 6))):
            known = [set(x.as_py() or []) for x in (boiler, often, linked)]
            out.append(" ".join(choose(blocks(h.as_py() or ""), known[0], known[1], main.as_py(), known[2])))
        return {"page_id": batch.column(0), "url": batch.column(1), "text": out}

    return arrow_rows(joined, ["page_id", "url", "html", "boilerplate", "frequent", "main", "linked"], "page_id long, url string, text string", each)
