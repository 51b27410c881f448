import random

import pytest
from loomtok.llm import html_extract as H
from loomtok.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def weights():
    return H.train(H.labelled_pages())


def brute_region(scores):
    """All runs: the greatest sum, then the first start, then the shortest."""
    best, found = 0, (0, 0)
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best:
                best, found = total, (i, j + 1)
    return best, found


@pytest.mark.parametrize("seed", range(200))
def test_the_scan_finds_the_greatest_sum(seed):
    r = random.Random(seed)
    scores = [r.randint(-5, 5) for _ in range(r.randint(0, 25))]
    start, end = H.best_region(scores)
    assert sum(scores[start:end]) == brute_region(scores)[0]
    assert (start, end) == (0, 0) or (scores[start] > 0 and scores[end - 1] > 0)


def test_query_against_brute_force(spark, weights):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op2_html_extraction(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        parts = H.tokens(pages[r.page_id])
        assert "".join(t for _, t in parts) == pages[r.page_id]
        scores = H.scores(parts, weights)
        start, end = H.best_region(scores)
        assert sum(scores[start:end]) == brute_region(scores)[0]
        assert r.text == H.extract(pages[r.page_id], weights)


def test_held_out_pages(weights):
    """Made-up pages of another seed: words of content against words of the rest."""
    right = wrong = missed = 0
    for page, content in H.labelled_pages(seed=99, pages=120):
        expected = H.extract(content, {**dict.fromkeys(weights, 0), "#": 1, "*": 0} | {k: 1 for k in weights if k[0] == "#"})
        got, want = H.extract(page, weights).split(), expected.split()
        hits = len(set(got) & set(want))
        right, wrong, missed = right + hits, wrong + len(set(got) - set(want)), missed + len(set(want) - set(got))
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_labels_need_content_in_the_page():
    assert H.train([("<p>x</p>", "absent"), ("", "")]) == {"-": 0, "*": -5000, "#": 1000}


def test_awkward_pages(spark):
    long = "<div>" + "<p>some words of text here</p>" * 20_000 + "</div>"
    rows = [(1, "u", "<p>a b c d e f g</p>", "x"), (1, "u", "<p>a b c d e f g</p>", "x"), (2, "u", "", "x"), (None, "u", "<p>one two three four five six</p>", "x"), (3, None, None, None), (4, "u", long, "x"), (5, "u", "<p><br></p>", "x"), (6, "u", "plain words &amp; more <b>unclosed", "x"), (7, "u", "<script>var a = 1", "x"), (8, "u", "<<p>>< p> text & <!-- never closed", "x")]
    out = [(r.page_id, r.text) for r in H.html_extraction(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()]
    got = dict(out)
    assert len(out) == len(rows) and got[1] == "a b c d e f g" and sum(p == 1 for p, _ in out) == 2
    assert got[2] == got[5] == got[7] == "" and got[3] is None and got[None] == "one two three four five six"
    assert got[4].count("some words of text here") == 20_000
    assert got[6].startswith("plain words & more")
    assert H.html_extraction(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
    own = spark.createDataFrame([("<nav>a b</nav><p>c d e f</p>", "<p>c d e f</p>")], "html string, content string")
    assert H.html_extraction(spark.createDataFrame([(1, "u", "<nav>a b</nav><p>c d e f</p>")], "page_id bigint, url string, html string"), own).first().text == "c d e f"


@pytest.mark.parametrize("block", ["<ul>" + "<li>a point of some words in a list</li>" * 6 + "</ul>", "<ol>" + "<li>short point</li>" * 4 + "</ol>", "<table>" + "<tr><th>name</th><td>some words here</td></tr>" * 5 + "</table>", "<blockquote><p>what someone said once</p></blockquote>", "<pre><code>x = 1</code></pre>", "<figure><img src=a><figcaption>what it shows</figcaption></figure>"])
def test_content_goes_on_after_a_block_in_its_middle(weights, block):
    before, after = ("word " * 60).strip(), ("later " * 60).strip()
    menu = "<ul>" + '<li><a href="/x">go here</a></li>' * 8 + "</ul>"
    page = f"<html><body><nav>{menu}</nav><article><h1>A title</h1><p>{before}</p>{block}<p>{after}</p></article><aside>{menu}</aside><footer>all rights</footer></body></html>"
    got = H.extract(page, weights)
    assert before in got and after in got and "go here" not in got and len(got.split("\n")) >= 3


def test_of_equal_regions_the_first_to_end_and_the_shortest():
    import itertools

    for scores in itertools.product([-1, 0, 1, 2], repeat=5):
        runs = [(sum(scores[a:b]), a, b) for a in range(5) for b in range(a + 1, 6)]
        best = max(s for s, *_ in runs)
        want = min(((b, b - a, (a, b)) for s, a, b in runs if s == best), default=None)[2] if best > 0 else (0, 0)
        assert H.best_region(list(scores)) == want, scores
