"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative: each
kind of token by the log odds of its share in content and outside it, counted on
labelled pages. These are pages of the table itself, labelled by their structure
(what a page's only <article> or <main> holds is content), and seven written for this library, for tags that the
table may lack. One linear scan (keep the best sum that ends here, start anew
where it falls below zero) finds the contiguous region with the greatest sum: a
sentence that tags part from the article costs more than its words give.

Words inside elements whose tag or role holds no content on the labelled pages (a
menu, a form) score negative as well, and the same scan over the negated scores
takes them out of the region. Names of classes and ids are not looked at.
"""

from __future__ import annotations

import html
import math
from collections import Counter, defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import mapped, table

# A quote opens a value only after an equals sign; elsewhere it is a character like any other.
_token = regex.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^<>])*+)(?:>|(?=<)|$)|([^<]+|<)",
    regex.S,
)
_attribute = regex.compile(r"\b(role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", regex.I)
_raw = {t: regex.compile(rf"</{t}\s*[^>]*(?:>|$)", regex.I) for t in ("script", "style", "textarea", "title", "template", "iframe", "svg", "select")}

# Fixed values of HTML: elements without content, and elements that stand inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br label button math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics".split())
#: A closing tag that is missing: opening one of these ends an open one of the same set.
_ends = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_block_closes_p = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: A form that holds so great a share of the page's words outside links is no form of the page but the page itself.
MOST = 0.75
#: Log odds from which on an element counts as free of content, and the least that a word in it scores.
CLEAR, LOWEST = -1.5, -3.0
#: Pages of the table from which weights are learned, and the share of a page's words that its article must hold.
SAMPLE, ARTICLE = 2_000, 0.5
SPREAD = 1 << 40
#: What the learned costs of tags may be multiplied by; the factor under which the labelled pages come out best is taken, the greater of equals.
SCALES = (1.0, 0.75, 0.5, 0.35, 0.25)


@dataclass
class Token:
    kind: str  # "word" (a text run), "tag", "break" (a block's edge)
    name: str
    text: str
    odds: float  # of the enclosing elements: 0, or the lowest that is clearly free of content
    link: bool = False
    home: float = 0.0  # of the enclosing elements: 0, or the greatest that is clearly content


class Odds:
    """Learned log odds of elements: by tag within its parent, by tag, by role."""

    def __init__(self, seen: dict[str, float]):
        self.seen = seen

    def low(self, own: set[str]) -> float:
        """The lowest of an element's features that is clear, else 0, as `of` sees it in training."""
        low = min(self.seen.get(f, 0.0) for f in own if ">" not in f)
        return low if low <= CLEAR else 0.0

    def of(self, name: str, parent: str, attributes: str) -> float:
        """The lowest that is clear, else 0. A tag's parent can clear it of what its name says."""
        tag = self.seen.get(name, 0.0)
        found = [self.seen.get(f"{parent}>{name}", tag) if tag <= CLEAR else 0.0, *(self.seen.get(f"role={r}", 0.0) for r in roles(attributes))]
        low = min(found)
        return max(low, LOWEST) if low <= CLEAR else 0.0


    def up(self, name: str) -> float:
        """The log odds of a tag that clearly holds content, else 0."""
        own = self.seen.get(name, 0.0)
        return own if own >= -CLEAR else 0.0


def roles(attributes: str) -> list[str]:
    return [v for m in _attribute.finditer(attributes) if m[1].lower() == "role" and (v := (m[2] or "").strip("\"'").lower())]


def features(name: str, parent: str, attributes: str) -> set[str]:
    """What an element is learned by."""
    return {name, f"{parent}>{name}"} | {f"role={r}" for r in roles(attributes)}


def hidden(attributes: str) -> bool:
    """Attributes that keep an element from being shown."""
    return any(m[1].lower() == "hidden" or (m[1].lower() == "aria-hidden" and (m[2] or "").strip("\"'").lower() == "true") for m in _attribute.finditer(attributes))


def elements(page: str):
    """The page in order: ("word", text), ("open", name, attributes, place), ("close", name, place of the open one), ("mark", name).

    Missing and stray closing tags are allowed; a mark is a tag without an element. Scripts and their like are skipped.
    """
    stack: list[tuple[str, int]] = []
    depth: dict[str, list[int]] = defaultdict(list)

    def close(upto: int):
        while len(stack) > upto:
            name, place = stack.pop()
            depth[name].pop()
            yield ("close", name, place)

    at, size = 0, len(page)
    while at < size and (m := _token.match(page, at)):
        at = m.end()
        if m[4] is not None:
            yield ("word", m[4])
            continue
        if m[2] is None:
            continue
        name, attributes = m[2].lower(), m[3] or ""
        if m[1]:
            if depth[name]:
                yield from close(depth[name][-1])
            else:
                yield ("mark", name)
            continue
        if name in _raw:
            found = _raw[name].search(page, at)
            at = found.end() if found else size
            yield ("mark", name)
            continue
        if name in _block_closes_p and depth["p"]:
            yield from close(depth["p"][-1])
        elif name in _ends and stack and stack[-1][0] in _ends[name]:
            yield from close(len(stack) - 1)
        if name in VOID or attributes.rstrip().endswith("/"):
            yield ("mark", name)
            continue
        depth[name].append(len(stack))
        stack.append((name, m.start()))
        yield ("open", name, attributes, m.start())
    yield from close(0)


def tokens(page: str, odds: Odds) -> list[Token]:
    """Text runs and tags in page order, each with the odds of what encloses it."""
    large = holders(page)
    out: list[Token] = []
    stack: list[tuple[str, float, int]] = []
    low, home, links, unseen = [0.0], [0.0], 0, 0
    for e in elements(page):
        if e[0] == "word":
            if not unseen:
                out.append(Token("word", "", e[1], low[-1], links > 0, home[-1]))
        elif e[0] == "open":
            _, name, attributes, place = e
            # A form may hold the whole page.
            here = 0.0 if place in large and name == "form" else odds.of(name, stack[-1][0] if stack else "", attributes)
            hides = hidden(attributes)
            out.append(Token("tag", name, "", min(low[-1], here)))
            if name not in INLINE:
                out.append(Token("break", name, "", low[-1]))
            stack.append((name, here, hides))
            low.append(min(low[-1], here))
            home.append(max(home[-1], odds.up(name)))
            links += name == "a"
            unseen += hides
        elif e[0] == "close":
            name, _, hides = stack.pop()
            low.pop()
            home.pop()
            links -= name == "a"
            unseen -= hides
            out.append(Token("tag", name, "", low[-1]))
            if name not in INLINE:
                out.append(Token("break", name, "", low[-1]))
        else:
            out.append(Token("tag", e[1], "", low[-1]))
            if e[1] == "br":
                out.append(Token("word", "", " ", low[-1], links > 0, home[-1]))
            elif e[1] not in INLINE:
                out.append(Token("break", e[1], "", low[-1]))
    return out


def holders(page: str) -> set[int]:
    """Places of the elements that hold most of the page's words outside links."""
    words, links = 0, 0
    before: dict[int, int] = {}
    held: list[tuple[int, int]] = []
    for e in elements(page):
        if e[0] == "word":
            words += 0 if links else len(e[1].split())
        elif e[0] == "open":
            before[e[3]] = words
            links += e[1] == "a"
        elif e[0] == "close":
            links -= e[1] == "a"
            held.append((e[2], words - before[e[2]]))
    return {place for place, n in held if n and n >= MOST * words}


@dataclass
class Weights:
    word: float
    link: float
    tag: dict[str, float]
    other: float
    odds: Odds


def counted(pages: Iterable[Iterable[tuple]]) -> tuple[dict[bool, Counter], dict[bool, Counter]]:
    """Words by the features of the elements around them, and words, linked words and tags, in content and outside it."""
    named, tokens_ = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}
    for page in pages:
        for content, inside, kind, what in page:
            if kind == "word":
                n = len(what.split())
                for f in set().union(*(x for _, x in inside)):
                    named[content][f] += n
                tokens_[content]["link" if any(name == "a" for name, _ in inside) else "word"] += n
            else:
                tokens_[content][f"<{what}"] += 1
    return named, tokens_


def learn(pages: Iterable[str] = ()) -> Weights:
    """Log odds of content: of elements by the words in them, of words, linked words and tags by their share of all tokens.

    pages are labelled by their structure; those without a single article are left out, and of pages
    built of the same elements one counts, so that no site outweighs the others. A tag that no page has gets the mean of all. Words never score below a tenth, tags never above 0.
    """
    kinds = {frozenset(f for _, inside, *_ in page for _, own in inside for f in own): (html_, page) for html_ in pages if (page := structured(html_))}
    named, tokens_ = counted([*map(marked, LABELLED), *(page for _, page in kinds.values())])
    total = {c: sum(n.values()) for c, n in tokens_.items()}
    words = {c: n["word"] + n["link"] for c, n in tokens_.items()}
    odds = lambda c, k, of: math.log((c[True][k] + 0.5) / (of[True] + 1) * (of[False] + 1) / (c[False][k] + 0.5))
    seen = Odds({k: odds(named, k, words) for c in named.values() for k in c if k not in ("a", "html", "body") and not k.endswith(">a")})
    cost = {k[1:]: min(odds(tokens_, k, total), 0.0) for c in tokens_.values() for k in c if k[0] == "<"}
    made = lambda scale: Weights(max(odds(tokens_, "word", total), 0.1), min(odds(tokens_, "link", total), 0.1), {k: scale * v for k, v in cost.items()}, scale * sum(cost.values()) / len(cost), seen)
    asked = [(regex.sub(r"\[\[|\]\]", "", p), list(marked(p))) for p in LABELLED] + list(kinds.values())
    return max((made(scale) for scale in SCALES), key=lambda w: sum(agreement(p, page, w) for p, page in asked))


def agreement(page: str, labels: list[tuple], weights: Weights) -> float:
    """F1 of the words of a page's text against those of its labelled content, each as a bag."""
    want = Counter(w for content, _, kind, what in labels if kind == "word" and content for w in html.unescape(what).split())
    got = Counter(main_text(page, weights).split())
    return 2 * (got & want).total() / max(got.total() + want.total(), 1)


def marked(page: str):
    """(whether it is content, the open elements with their features, "word" and a text or "tag" and its name) of a page whose content stands between [[ and ]]."""
    content, inside = False, []
    for e in elements(page):
        if e[0] == "word":
            for k, piece in enumerate(regex.split(r"(\[\[|\]\])", e[1])):
                if k % 2:
                    content = piece == "[["
                elif piece.split():
                    yield content, inside, "word", piece
            continue
        if e[0] == "open":
            inside = [*inside, (e[1], features(e[1], inside[-1][0] if inside else "", e[2]))]
        yield content, inside, "tag", e[1]
        if e[0] == "close":
            inside = inside[:-1]


def structured(page: str) -> list[tuple]:
    """The same of a page with exactly one article or main that holds ARTICLE of its words: its content is in there. Else nothing."""
    out, inside, open_, found = [], [], 0, 0
    for e in elements(page):
        if e[0] == "word":
            if e[1].split():
                out.append((open_ > 0, inside, "word", e[1]))
            continue
        if e[0] == "open":
            inside = [*inside, (e[1], features(e[1], inside[-1][0] if inside else "", e[2]))]
        elif e[0] == "close" and e[1] in ("article", "main"):
            open_ -= 1
        out.append((open_ > 0, inside, "tag", e[1]))
        if e[0] == "open" and e[1] in ("article", "main"):
            open_ += 1
            found += open_ == 1
        elif e[0] == "close":
            inside = inside[:-1]
    words = {c: sum(len(x[3].split()) for x in out if x[2] == "word" and x[0] == c) for c in (True, False)}
    return out if found == 1 and words[True] >= ARTICLE * sum(words.values()) > 0 else []


def gains(page: list[Token], weights: Weights) -> list[float]:
    """The score of each token: a word's is positive but where its element is free of content, a tag's negative."""
    out = []
    for t in page:
        if t.kind == "word":
            out.append(len(t.text.split()) * (t.odds or (weights.link if t.link else weights.word) + t.home))
        else:
            out.append(weights.tag.get(t.name, weights.other) if t.kind == "tag" else 0.0)
    return out


def best(scores: list[float]) -> tuple[int, int, float]:
    """Range with the greatest sum and the sum, by one scan; the earliest and shortest of equals; empty if none is above 0."""
    top, found, here, start = 0.0, (0, 0), 0.0, 0
    for k, gain in enumerate(scores):
        if here <= 0:
            here, start = 0.0, k
        here += gain
        if here > top:
            top, found = here, (start, k + 1)
    return *found, top


#: Pages from which the weights are learned; their content stands between [[ and ]]. Written for this library.
LABELLED = (
    """<body><div><header><h1>Town Paper</h1><p>Your town, every day</p></header>
    <nav role=navigation><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>
    <div>Home / News / Local</div>
    <div><article>[[<header><h1>River floods the old town</h1></header><p>Water rose over the quay on Monday night and reached the market before dawn.</p>
    <figure><figcaption>The market square on Tuesday</figcaption></figure><p>Shops stayed shut while crews pumped out the cellars along the main street.</p>]]
    <div>Share this with your friends</div></article></div>
    <aside><h3>Most read</h3><ul><li><a href=/1>Mayor resigns</a></li><li><a href=/2>Bus fares rise</a></li></ul></aside>
    <footer role=contentinfo>Copyright Town Paper. All rights reserved.</footer></div></body>""",
    """<body><div><div>Products Prices Contact</div><div>[[<h2>How to sharpen a plane iron</h2>
    <p>Hold the iron flat on the stone and draw it back with even pressure until a burr forms.</p><ol><li>Turn it over.</li><li>Take the burr off.</li></ol>
    <p>Then <b>strop</b> the edge on <a href=/l>leather</a>.</p>]]</div><div>Buy our oil stones today</div>
    <div role=complementary><h3>Popular</h3><p>Saws and how to set them</p></div><div>Imprint and privacy policy</div></div></body>""",
    """<body><header role=banner><h1>Daily Notes</h1><p>Walks, birds and bread from a small valley in the west</p><form role=search><label>Search the notes</label><input name=q><button>Go now</button></form></header>
    <main>[[<h1>A walk in the hills</h1><p>We left early and had the ridge to ourselves until noon, when the first clouds came in from the west.</p>
    <blockquote>Nothing is as quiet as snow on heather.</blockquote><p>The way down was slow.</p>]]</main>
    <section><h3>Comments</h3><p>Nice pictures!</p><p>Thanks for this, we shall go there too.</p><div>Glad to hear that</div></section>
    <div>Comments by readers load here</div></body>""",
    """<body><div role=dialog><p>We use cookies to make this site better.</p><button>Accept all</button></div>
    <div>[[<h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast and let the dough rest for a night.</p>
    <ul><li>Heat the pot for half an hour.</li><li>Bake with the lid on, then without it.</li></ul><table><tr><th>Flour</th><td>five hundred grams</td></tr><tr><th>Water</th><td>four hundred</td></tr></table>]]
    <div>You may also like pizza dough</div></div><p>Buy cast iron pots now</p>
    <div><form>Enter your address to get our letter <input><button>Sign up</button></form></div>
    <footer><a href=/i>Imprint</a> <a href=/p>Privacy</a> made with care</footer></body>""",
    """<body><div><div role=alert>Wait before you go! Ten percent off.</div><div>Log in or make an account</div>
    <section>[[<h2>The heron returns</h2><p>After thirty years a pair nests again by the lower lake, and the wardens keep the path closed.</p><dl><dt>Eggs</dt><dd>three, laid in March</dd></dl>]]</section>
    <div>birds lakes spring</div><div>Previous page Next page</div><div>Paid content from our partners</div>
    <noscript>Please switch scripts on to see this page.</noscript><menu role=menu><li>Print this</li></menu></div></body>""",
    """<body><div><div>[[See the charter of 1312 in the town's archive.]]</div>
    [[<h3>What the charter says</h3><pre>Item, no cart shall pass the gate after dusk.</pre><p>The clerk who wrote it spelled the gate's name in three ways, <i>which</i> has puzzled readers since.</p>
    <details><summary>On the seal</summary>It shows a bridge with two arches.</details>]]</div>
    <aside><p>Guided tours on Sundays, book at the desk</p></aside><div role=form>Write to the editor about this page</div><div role=toolbar>Larger text Smaller text</div>
    <div role=menubar>File Edit View</div><nav><a href=/a>About the archive</a> opening hours</nav><footer>Town archive, second floor</footer></body>""",
    """<body><div>Our shop is closed for the holidays</div><div>All courses and dates</div><header><p>Evening school for everyone, since the year of the great flood, in the house by the bridge</p></header>
    <article>[[<h1>Course in bookbinding</h1><p>Over six evenings we sew, glue and cover a book with blank pages; all tools are there.</p><p>E = <math><mi>m</mi></math> is not on the programme.</p>]]
    <footer>Filed under crafts by the office</footer></article><dialog>Do you want to stay logged in</dialog></body>""",
)


def own(page: list[Token], scores: list[float]) -> list[float]:
    """The scores of a page for the region: an element without content costs LOWEST at most, so that it doesn't part what stands around it."""
    out, left = [], 0.0
    for t, gain in zip(page, scores, strict=True):
        if t.odds == 0:
            left = LOWEST
            out.append(gain)
        elif t.kind == "word":
            out.append(max(gain, left))
            left -= out[-1]
        else:
            out.append(0.0)
    return out


def foreign(page: list[Token], scores: list[float], lo: int, hi: int) -> set[int]:
    """Text runs of the region that the scan over the negated scores takes out: each stretch with a sum above 0 that no content parts."""
    out, here, start = set(), 0.0, lo
    for k in range(lo, hi):
        if page[k].kind == "word" and page[k].text.strip() and not page[k].odds:
            here, start = 0.0, k + 1
        elif page[k].odds:
            here -= scores[k] if page[k].kind == "word" else 0.0
            if here > 0:
                out.update(j for j in range(start, k + 1) if page[j].odds)
                start = k + 1
    return out


def main_text(page: str, weights: Weights) -> str:
    """Blocks of the best region in page order, joined by an empty line; '' if the page has none.

    The scan starts a region at a text; the block's own beginning is part of it.
    """
    if not page:
        return ""
    got = tokens(page, weights.odds)
    scores = gains(got, weights)
    lo, hi, _ = best(own(got, scores))
    if lo == hi:
        return ""
    while lo > 0 and got[lo - 1].kind == "word" and not got[lo - 1].odds:
        lo -= 1
    while hi < len(got) and got[hi].kind == "word" and not got[hi].odds:
        hi += 1
    out, held = [], []
    gone = foreign(got, scores, lo, hi)
    for k in range(lo, hi):
        if got[k].kind == "word" and k not in gone:
            held.append(got[k].text)
        elif got[k].kind == "break" and held:
            out.append("".join(held))
            held = []
    out.append("".join(held))
    parts = (" ".join(html.unescape(b).split()) for b in out)
    return "\n\n".join(p for p in parts if p)


def fit(df: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> Weights:
    """Weights from about `sample` pages, chosen by a hash of their bytes; repeated pages count once.

    The hash's bound follows from the number of rows, so no task sees more than its share of the sample.
    """
    pages = df.select(F.col(html_col).cast("string").alias("html")).filter("html IS NOT NULL").withColumn("h", F.xxhash64("html"))
    n = df.count()
    some = pages.filter(F.pmod("h", F.lit(SPREAD)) < -(-SPREAD * sample // max(n, 1))).groupBy("h").agg(F.min("html").alias("html"))
    return learn(r["html"] for r in sorted(some.collect(), key=lambda r: r["h"])[: 2 * sample])


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", extra: tuple[str, ...] = ("url",), weights: Weights | None = None) -> DataFrame:
    """id, the extra columns and `text` of every row, from the whole page; local to a row.

    Without weights these are learned from the table. Null, empty and unreadable pages give
    the empty text; repeated rows give repeated results; an empty table gives none; other columns are not read, and
    the extra ones may have any name but `text`. Time grows with a page's length,
    however deep its elements are nested.
    """
    weights = fit(df, html_col) if weights is None else weights

    def make(block: pa.Table) -> dict:
        text = [main_text(h, weights) for h in block.column("_html").to_pylist()]
        return {c: block.column(c).combine_chunks() for c in block.column_names if c != "_html"} | {"text": text}

    rows = df.select(id_col, *extra, F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("_html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_html")
    return mapped(rows, make, f"{kinds}, text string", size_of="_html", most=4 << 20)


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
