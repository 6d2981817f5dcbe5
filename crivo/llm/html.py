"""Main text of web pages from flat text blocks.

A page is cut into blocks where block-level tags stand. Each block has its words
and its link density (the share of its characters inside links), those of the
blocks before and behind it, and what its surroundings say: whether it stands in
an article, or in a part that tags or class names mark as something else. A
decision tree over these numbers, fitted to a small table of labelled blocks,
tells whether a block belongs to the main text.

Null and empty pages, and pages without main text, give an empty text. Broken
markup is read as far as it goes: a tag that isn't closed ends with what holds
it, and "<" before anything but a name is text. Rows that repeat, null ids and other
columns pass through.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


#: Comments, the text of elements that hold no text, other tags with their attributes in quotes, text.
_CLOSED = r"<!\[CDATA\[.*?\]\]>|"
_PARTS = (
    r"<!--(?:.*?-->|.*\Z)|" + _CLOSED + r"<(script|style|noscript|template|svg|annotation(?:-xml)?|title|textarea|iframe|select)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][\w:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(<?[^<]++|<)"
)
PARTS = re.compile(_PARTS, re.DOTALL | re.IGNORECASE)
#: The parts behind the last end of marked data: what opens there is a tag.
LATER = re.compile(_PARTS.replace(_CLOSED, ""), re.DOTALL | re.IGNORECASE)
#: The parts behind the last tag: text.
REST = re.compile(r"()()()()(.+)", re.DOTALL)
#: Tags that end a block, tags that hold blocks, and those among them that hold no main text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math object output param q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | set(
    "maction math menclose merror mfenced mfrac mi mlabeledtr mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub "
    "msubsup msup mtable mtd mtext mtr munder munderover none semantics annotation annotation-xml".split()
)
HOLDERS = set("article aside body button dialog div dl fieldset figure footer form header html li main menu nav ol section table td th tr ul".split())
APART = set("aside button dialog fieldset footer form header menu nav".split())
#: Words in class, id and role that mark such a part.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments cookie cookies copyright disclaimer disqus footer "
    "form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination popup privacy "
    "promo promoted promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar widget contentinfo complementary".split()
)
#: What only says where a part stands, so that a layout around the article may be named after it; words that say whether a page has such a part.
PLACES = set("banner footer header menu menubar nav navbar navigation sidebar toolbar".split())
HAVING = set("has have no with without".split())
CONTENT = set("article articlebody content entry maincontent post story main".split())
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)

NAMES = ["words", "links", "words_before", "links_before", "words_behind", "links_behind", "apart", "article", "heading"]
#: How far a holder sets apart: not at all, as a layout up to an article, by a class up to the main element, for all it holds.
OPEN, LAYOUT, MARKED, SHUT = range(4)


def _told(tag: str, attributes: str, inside_article: bool) -> tuple[int, bool]:
    """What a holder says of its blocks: (how far they are apart, article)."""
    apart, article = SHUT if tag in APART and not (tag == "header" and inside_article) else OPEN, tag in ("article", "main")
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                apart = SHUT
            elif name in ("class", "id", "role"):
                words = set(re.split(r"[^a-z]+", value))
                marked, layout = set(), True
                for token in value.split():
                    parts = [w for w in re.split(r"[^a-z]+", token) if w]
                    here = set() if HAVING & set(parts) else MARKS & set(parts)
                    marked |= here
                    layout &= not here or here <= PLACES and parts[0] not in MARKS
                if inside_article and marked <= {"header", "byline", "tags"} or tag in ("body", "html"):
                    marked = set()
                if marked:
                    apart = max(apart, LAYOUT if layout else MARKED)
                article |= bool(words & CONTENT) and not marked and tag not in ("body", "html")
    return apart, article


def _parts(page: str):
    """Matches of the parts of a page, in time that goes with its length however it is broken.

    What never closes is not looked for again from every place where it opens: the last ends are looked up once.
    """
    at = 0
    for pattern, until in ((PARTS, page.rfind("]]>")), (LATER, page.rfind(">"))):
        for m in pattern.finditer(page, at):
            if m.start() > until:
                break
            yield m
            at = m.end()
    if rest := page[at:].split("<!--", 1)[0]:
        yield REST.match(rest)


def blocks(page: str | None) -> list[tuple[str, list[float]]]:
    """(text, the numbers of NAMES) of each block of a page, in order."""
    out: list[tuple[str, float, int, bool, bool, bool]] = []
    holders: list[tuple[str, int, bool]] = []  # tag, apart, article, with what stands around
    texts: list[str] = []
    linked, in_link, heading = 0, False, False
    held: Counter = Counter()  # how many holders of each tag are open

    def end():
        nonlocal linked
        text = " ".join(entities.unescape("".join(texts)).split())
        if text:
            _, apart, article = holders[-1] if holders else ("", OPEN, False)
            out.append((text, min(1.0, linked / len(text)), len(text.split()), apart > OPEN, article, heading))
        texts.clear()
        linked = 0

    for m in _parts(page or ""):
        if m[5] is not None:
            texts.append(m[5])
            if in_link:
                linked += len(" ".join(entities.unescape(m[5]).split()))
        elif m[3] is not None:
            tag, closing = m[3].lower(), bool(m[2])
            if tag == "a":
                in_link = not closing
            if tag in INLINE:
                continue
            end()
            in_link = in_link and tag == "br"
            heading = not closing and re.fullmatch(r"h[1-6]", tag) is not None
            if tag in HOLDERS:
                if closing:
                    while held[tag]:
                        gone = holders.pop()[0]
                        held[gone] -= 1
                        if gone == tag:
                            break
                elif not m[4].rstrip().endswith("/"):
                    _, apart, article = holders[-1] if holders else ("", OPEN, False)
                    if apart <= {"article": LAYOUT, "main": MARKED}.get(tag, OPEN):
                        apart = OPEN
                    more_apart, more_article = _told(tag, m[4], article)
                    held[tag] += 1
                    holders.append((tag, max(apart, more_apart), article or more_article))
        elif m[1] is not None and m[1].lower() not in INLINE:
            end()
    end()
    edge = (0, 1.0)
    around = [edge] + [(b[2], b[1]) for b in out] + [edge]
    return [
        (b[0], [float(b[2]), b[1], float(around[i][0]), around[i][1], float(around[i + 2][0]), around[i + 2][1], float(b[3]), float(b[4]), float(b[5])])
        for i, b in enumerate(out)
    ]


#: Labelled pages, written by hand: each block is followed by its label, + for main text.
LABELLED = (
    "<nav><a>Home</a> <a>News</a></nav>-<article><h1>A day at the sea</h1>+<p>We left early in the morning and came back late at night, tired and glad.</p>+<p>Never again.</p>+</article><footer>All rights reserved by us and our friends</footer>-",
    "<header>The Daily Paper</header>-<main><h2>Short news</h2>+<p>Rain.</p>+<p>It rained all day in the north, and the rivers rose quickly over their banks.</p>+</main><aside>Read also what others wrote about rain</aside>-",
    "<div class=menu><a>One</a> <a>Two</a> <a>Three</a></div>-<h1>A page without article tags</h1>+<p>This page has long paragraphs that nothing marks, and all the same they are what its reader came to see today.</p>+<p>Another long paragraph follows the first one, with enough words in it to look like text that somebody wrote down.</p>+<p><a>Next page</a></p>-<div>Contact</div>-",
    "<article><p>See <a>this</a> and <a>that</a> for more on the way things were done before.</p>+<div class=ad>Buy two of these, get three more for free today</div>-<p>Then all was well.</p>+<div class=comments><p>I liked this text very much, thank you for it, it was good to read.</p>-</div></article>",
    "<div id=sidebar><p>A few words about the author of this page, who lives in the south with two cats.</p>-</div><div class=content><p>Where it began</p>+<ul><li>First thing</li>+<li>Second thing</li>+</ul></div>",
    "<form>Your name Your address Send</form>-<section><p>When the train stopped between two stations nobody said anything for a quarter of an hour at least.</p>+<p>Then somebody laughed, and so did all the others in that carriage and in the next.</p>+</section><p><a>About us</a> <a>Terms</a> <a>Help</a></p>-",
    "<div class=cookie-notice>We use cookies to make this site better for you, agree here</div>-<article><h1>Soup</h1>+<ol><li>Boil water</li>+<li>Add salt</li>+</ol><p><a>Everything here is one link to the recipe</a></p>+</article><div class=share>Share this with all your friends now</div>-",
    "<p><a>Login</a></p>-<p><a>Register</a></p>-<table><tr><td>The table of this page holds its text, as pages did long ago when nobody knew better than that.</td>+</tr><tr><td>A second cell goes on with the text and is long enough to be seen as such by anyone.</td>+</tr></table><p>Last change in May</p>-",
    "<h2>Old page</h2>+<p>There is no article here, only paragraphs one after another, each of some length and without any links at all.</p>+<p>The last one of them stands at the end of the page, and nothing at all comes behind it, as here.</p>+",
    "<div>Menu</div>-<div><a>Start</a></div>-<div><p>A paragraph between short boxes is the main text of this page, since it has many words and no links in it.</p>+</div><div>Top</div>-<div>2024</div>-",
    "<p>One long line of text, with a <a>link</a> or two in the midst of it, is still text that people came here to read.</p>+<p>And one more long line of text to close the whole matter, with enough words to be sure of it.</p>+<p><a>Imprint</a> <a>Privacy</a></p>-",
    "<article><p><a>All of it is a link</a></p>+<p>Word</p>+<p>Word</p>+</article><p>This paragraph stands behind the article and outside of anything, yet it has the length and the looks of text.</p>+<p>Bye</p>-",
    "<ul><li><a>What happened in the north this week</a></li>-<li><a>Prices rise again in spring, say shops</a></li>-<li><a>Team wins the final of the year</a></li>-</ul><p>Beside those lists stands the text itself, a paragraph of many words without links, and that is what we want.</p>+<ul><li><a>An older story of some length</a></li>-<li><a>The oldest story that we have here</a></li>-</ul>",
    "<div class=content-sidebar-wrap><main><h1>Wrapped</h1>+<p>The text of this page stands in a wrapper that is named after the part beside it.</p>+</main><div class=sidebar><p>Old posts of ours</p>-</div></div>",
    "<div class='site no-sidebar with-nav'><nav><a>Home</a></nav>-<article><p>Short.</p>+<p>A page without a sidebar says so in the class of what holds it all.</p>+</article><div class=comments><article><p>What a reader had to say about it</p>-</article></div></div>",
    "<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> solves it.</p>+<object data=plan.svg><p>A drawing of the house</p>+</object><p>That was all.</p>+</article><p><a>Top</a></p>-",
    "<div class=main><h3>Part one</h3>+<p>It was.</p>+<p>It is.</p>+</div><div class=related><a>More like this one here</a>-<p>What you could read next if you liked this text</p>-</div>",
)


#: Kinds of paragraphs: whatever stands in an article is main text; outside of one, short ones and links between long ones aren't.
SHORT_KINDS = ("<p>Word</p>", "<p>A few words more</p>", "<p><a>Link</a></p>", "<p><a>A link of a few words</a></p>")
LONG_KINDS = ("<p>This paragraph has as many words as a sentence of fair length may have in any text.</p>",
              "<p>This paragraph is about as long, has <a>a link</a> in it, and many words beside the link to outweigh it.</p>",
              "<p>" + "A long paragraph says the same thing again and again until it is long. " * 4 + "</p>")


def labelled_pages() -> tuple[str, ...]:
    kinds = SHORT_KINDS + LONG_KINDS
    articles = tuple(f"<p><a>Top</a></p>-<article>{a}+{b}+{c}+</article><p>End</p>-" for a in kinds for b in kinds for c in kinds[::2])
    apart = tuple(f"<aside>{c}-{a}-</aside><div>{a}+{b}+</div><footer>{c}-{a}-{c}-</footer>" for a in LONG_KINDS for b in LONG_KINDS for c in kinds)
    within = tuple(f"<article>{a}+<div class={m}>{c}-</div>{b}+</article>" for a in kinds for b in LONG_KINDS for c in kinds for m in ("ad", "comments"))
    bare = tuple(f"<div>{s}-</div><div>{a}+{b}+{a}+</div><div>{t}-</div>" for a in LONG_KINDS for b in LONG_KINDS for s in SHORT_KINDS[2:] for t in SHORT_KINDS[2:])
    return LABELLED + articles + apart + within + bare


def labelled_rows() -> list[tuple[float, ...]]:
    """The numbers and the label of each block of the labelled pages."""
    rows = []
    for page in labelled_pages():
        signs = re.findall(r">([+-])(?=<|$)", page)
        found = blocks(re.sub(r">[+-](?=<|$)", ">", page))
        if len(signs) != len(found):
            raise ValueError(f"{len(signs)} labels for {len(found)} blocks: {page}")
        rows += [(*numbers, float(s == "+")) for (_, numbers), s in zip(found, signs)]
    return rows


def fit(spark: SparkSession, rows: list[tuple[float, ...]] | None = None, depth: int = 6) -> tuple:
    """Decision tree as nested tuples: (number, bound, tree up to it, tree above it), or the label."""
    table = spark.createDataFrame(rows or labelled_rows(), ", ".join(f"{n} double" for n in [*NAMES, "label"]))
    data = VectorAssembler(inputCols=NAMES, outputCol="vector").transform(table.coalesce(1))
    model = DecisionTreeClassifier(labelCol="label", featuresCol="vector", maxDepth=depth, minInstancesPerNode=4, seed=1).fit(data)
    lines = [line.strip() for line in model.toDebugString.splitlines()[1:] if line.strip()]

    def tree():
        line = lines.pop(0)
        if m := re.match(r"Predict: ([\d.]+)", line):
            return float(m[1])
        at = re.match(r"If \(feature (\d+) <= ([-\d.eE]+)\)", line)
        low = tree()
        lines.pop(0)
        return int(at[1]), float(at[2]), low, tree()

    return tree()


def is_main(tree, numbers: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if numbers[tree[0]] <= tree[1] else tree[3]
    return tree > 0.5


def main_text(page: str | None, tree: tuple) -> str:
    return "\n".join(text for text, numbers in blocks(page) if is_main(tree, numbers))


def extract(df: DataFrame, tree: tuple, html: str = "html", name: str = "text") -> DataFrame:
    """``df`` without ``html``, with the main text under ``name``."""
    keep = [f for f in df.schema.fields if f.name != html]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(html)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array([main_text(x, tree) for x in batch.column(at).to_pylist()], pa.string())],
                names=[n for n in batch.schema.names if n != html] + [name])

    return df.mapInArrow(run, T.StructType([*keep, T.StructField(name, T.StringType())]))
