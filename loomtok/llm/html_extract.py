"""HTML extraction: words score for, tags against, and the region of the greatest sum is the content."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtok.llm.common import strings

#: What isn't text: comments, declarations, and elements whose body is code. An unclosed one reaches to the end.
MARKUP = re.compile(r"(<!--.*?(?:-->|\Z)|<(?:script|style|noscript|template)\b.*?(?:</(?:script|style|noscript|template)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z))", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9]*)")
ITEMS, LISTS = frozenset(("li", "td", "dd")), frozenset(("ul", "ol", "tr", "dl"))
BLOCKS = frozenset("p br div article section h1 h2 h3 h4 h5 h6 ul ol li table tr td th blockquote pre header footer nav aside main title figure form hr dl dt dd".split())


def tokens(page: str) -> list[tuple[str, str]]:
    """(kind, text): kind "" for text between tags, "-" for what isn't shown, else the tag's lower-case name, closing tags with a slash.

    A link that is alone between tags has an @ after its name, and so has an item or cell that begins or ends with one,
    and a list that begins or ends with such an item: these make menus, while other links and lists may be content.
    """
    out = []
    for k, part in enumerate(MARKUP.split(page)):
        if not part:
            continue
        if not k % 2:
            out.append(("", part))
        elif m := NAME.match(part):
            name = m[1].lower()
            out.append(("-" if name in ("script", "style", "noscript", "template") else "/" + name if part[1] == "/" else name, part))
        else:
            out.append(("-", part))
    shown = [k for k, (kind, text) in enumerate(out) if kind or not text.isspace()]
    kinds = ["/", *(out[k][0] for k in shown), "/"]  # the page's ends are like tags
    for i, kind in enumerate(kinds):
        if kind == "a" and kinds[i - 1]:
            end = next((j for j in range(i + 1, min(i + 8, len(kinds))) if kinds[j] == "/a"), 0)
            if end and kinds[end + 1]:
                kinds[i] = kinds[end] = "@"
    menu = {i for i, kind in enumerate(kinds) if kind == "@"}
    for names in (ITEMS, LISTS):
        menu |= {i for i, kind in enumerate(kinds) if kind in names and i + 1 in menu or kind[1:] in names and kind[0] == "/" and i - 1 in menu}
    for i in menu:
        k = shown[i - 1]
        out[k] = (out[k][0] + "@", out[k][1])
    return out


def labelled_pages(seed: int = 11, pages: int = 60) -> list[tuple[str, str]]:
    """(html, content): a small labelled table of made-up pages in several layouts; content is markup that stands in the page once."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ta", "re", "in", "so", "the", "an", "er", "lo", "mi", "und"]) for _ in range(r.randint(1, 3)))
    text = lambda n: " ".join(word() for _ in range(n))

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{word()}">{text(r.randint(1, 3))}</a></li>' for _ in range(n)) + "</ul>"

    out = []
    for _ in range(pages):
        parts = [f"<h1>{text(r.randint(3, 9))}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.randint(1, 8)):
            body = text(r.randint(5, 120))
            roll = r.random()
            if roll < 0.2:
                body = body.replace(" ", f" <b>{text(2)}</b> ", 1)
            elif roll < 0.3:
                body = body.replace(" ", f' <a href="/{word()}">{text(2)}</a> ', 1)
            elif roll < 0.4:
                body += "<br>" + text(20)
            elif roll < 0.5:
                body = body.replace(" ", f" {r.choice(['<em>{}</em>', '<i>{}</i>', '<strong>{}</strong>', '<span>{}</span>', '<code>{}</code>', '<img src=x>{}', '<sup>{}</sup>'])} ".format(text(1)), 1)
            parts.append(f"<p>{body}</p>" if r.random() < 0.9 else f"<h2>{text(4)}</h2><p><b>{body}<br>")
            if r.random() < 0.3:
                cells = [text(r.randint(2, 25)) for _ in range(r.randint(2, 7))]
                parts.append(r.choice([
                    "<ul>" + "".join(f"<li>{c}</li>" for c in cells) + "</ul>",
                    "<ol>" + "".join(f"<li>{c}</li>" for c in cells) + "</ol>",
                    "<table>" + "".join(f"<tr><th>{text(1)}</th><td>{c}</td></tr>" for c in cells) + "</table>",
                    f"<blockquote><p>{' '.join(cells)}</p></blockquote>",
                    f"<pre><code>{cells[0]}</code></pre>",
                    f"<figure><img src=x><figcaption>{cells[0]}</figcaption></figure>",
                    "<dl>" + "".join(f"<dt>{text(1)}</dt><dd>{c}</dd>" for c in cells) + "</dl>",
                    f"<h3>{text(3)}</h3>",
                ]))
        content = "".join(parts)
        inner = r.choice([f"<article>{content}</article>", f"<main><article>{content}</article></main>", f'<div class="content">{content}</div>', f"<section>{content}</section>"])
        extra = r.choice(["", f'<div class="ad">{text(r.randint(3, 14))}</div>', f"<aside><h3>{text(2)}</h3>{links(4)}</aside>", f"<form><input><button>{text(1)}</button></form>"])
        page = (
            f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{text(6)}</title><style>p{{}}</style><script>var x=1;</script></head><body>"
            f"{r.choice(['<header>' + text(3) + '</header>', ''])}<nav>{links(r.randint(3, 9))}</nav>{extra}{inner}"
            f"{r.choice(['', extra])}<footer>{r.choice(['&copy; ' + text(2), text(r.randint(2, 16)), '&copy; ' + word() + ' &middot; ' + text(12)])}{r.choice(['', '</footer></body></html>', '</footer></body></html>'])}"
        )
        out.append((page, content))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_pages(), "html string, content string")


def train(pages: list[tuple[str, str]], smooth: float = 0.5, scale: int = 1000, words: float = 25.0) -> dict[str, int]:
    """Whole-number weights of the kinds in :func:`tokens`, from pages with their content.

    A tag weighs ``words`` times the log-odds of finding it within the content, -scale at most: each tag costs a word.
    A word weighs ``scale`` times the share of content among words that follow the same tag, at least 1; that is kept
    under the tag's name with a # before it. "*" and "#" are for tags that no page has.
    """
    within, beyond = Counter(), Counter()
    for page, content in pages:
        at = page.find(content) if content else -1
        if at < 0:
            continue
        for region, count in ((page[:at], beyond), (content, within), (page[at + len(content) :], beyond)):
            last = ""
            for kind, text in tokens(region):
                if kind not in ("", "-"):
                    last = kind
                    count[kind] += 1
                elif not kind:
                    count["#" + last] += len(text.split())
    kinds = sorted(within.keys() | beyond.keys())
    total_in, total_out = (sum(n for k, n in c.items() if k[0] != "#") or 1 for c in (within, beyond))
    weights = {"-": 0, "*": -5 * scale, "#": scale}
    for kind in kinds:
        if kind[0] == "#":
            weights[kind] = max(1, round(scale * (within[kind] + smooth) / (within[kind] + beyond[kind] + 2 * smooth)))
            continue
        odds = math.log((within[kind] + smooth) / (total_in + smooth)) - math.log((beyond[kind] + smooth) / (total_out + smooth))
        weights[kind] = min(-scale, round(words * scale * (min(0.0, odds))))
    return weights


def fit(labelled: DataFrame, max_pages: int = 2000) -> dict[str, int]:
    """Weights from at most ``max_pages`` labelled pages, the first in order of their text."""
    return train([tuple(row) for row in labelled.select("html", "content").orderBy("html", "content").limit(max_pages).collect()])


def best_region(scores: list[int]) -> tuple[int, int]:
    """(start, end) of the contiguous run with the greatest sum, in one scan; of equals the first to end, and of those the shortest. (0, 0) if none is over 0."""
    best, found, total, start = 0, (0, 0), 0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0, k
        total += s
        if total > best:
            best, found = total, (start, k + 1)
    return found


def scores(parts: list[tuple[str, str]], weights: dict[str, int]) -> list[int]:
    """Of each token: its number of words times their weight after the last tag, or the tag's weight."""
    out, word, other = [], weights["#"], weights["*"]
    for kind, text in parts:
        if not kind:
            out.append(word * len(text.split()))
        else:
            plain = kind.rstrip("@")
            out.append(weights.get(kind, weights.get(plain, other)))
            if kind != "-":
                word = weights.get("#" + kind, weights.get("#" + plain, weights["#"]))
    return out


def extract(page: str | None, weights: dict[str, int]) -> str | None:
    """The text of the best region: blocks as lines, entities decoded, runs of blanks as one."""
    if page is None:
        return None
    parts = tokens(page)
    start, end = best_region(scores(parts, weights))
    out: list[str] = []
    for kind, text in parts[start:end]:
        if not kind:
            out.append(text.replace("\n", " "))
        elif kind.strip("/@") in BLOCKS:
            out.append("\n")
    lines = (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n"))
    return "\n".join(line for line in lines if line)


def html_extraction(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text): the content of each page.

    A page is a row of words and tags; words score for being content and tags against, with weights that
    :func:`train` learns from ``labelled`` (html, content), by default :func:`labelled_table`. Content is the run
    with the greatest sum, found by one scan of the whole page.

    Null html gives null text; an empty page, or one without words, an empty text. A null page_id or url stays null.
    Repeated rows give the same. Of runs of equal sums the one that ends first is taken, and of those the shortest. Other columns are left out. An empty table
    gives an empty table.
    """
    weights = fit(labelled if labelled is not None else labelled_table(pages.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([extract(p, weights) for p in strings(batch.column(2))], pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id bigint, url string, text string")
