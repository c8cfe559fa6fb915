import random
import time

import pytest

from lorekeep.llm import html_text as H
from tests.llm.conftest import same

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var t='</p>';</script></head><body><header>Top</header><nav><ul>"
    "<li><a href='/a'>A</a></li><li><a href='/b'>B</a></li></ul></nav><!-- ad --><div class='ad'>Buy</div><article><h1>{0}</h1>"
    "<p><b>{1}<br><p>x &amp; y  z</p>{2}<div class='comments'><article class='comment'>no</article></div></article>"
    "<aside>s</aside><form>f</form><footer>&copy;</footer></body></html>"
)
SCHEMA = "page_id long, url string, html string, host string, marks string"


def test_pages_of_every_kind(spark):
    rows = [
        (1, "http://h.example/1", PAGE.format("T1", "one", ""), None, None),
        (2, "http://h.example/2", PAGE.format("T2", "two", "<p>more</p><p>still</p>"), "x", "y"),
        (2, "http://h.example/2", PAGE.format("T2", "two", "<p>more</p><p>still</p>"), "x", "y"),
        (3, None, None, None, None),
        (4, "not an address", "", None, None),
        (5, "http://[bad", "plain", None, None),
        (None, "http://h.example/3", "<p>un<i>clo</i>sed", None, None),
        (6, "http://long.example/", "<div>" * 200 + "w " * 5000, None, None),
    ]
    got = H.extract_main(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    long = "w " * 4999 + "w"
    texts = {1: "T1 one x & y z", 2: "T2 two x & y z more still", 3: "", 4: "", 5: "plain", None: "unclosed", 6: long}
    same(got, [(row[0], row[1], texts[row[0]], len(texts[row[0]])) for row in rows])


def test_no_rows(spark):
    assert H.extract_main(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_wrapper_folds_and_aligns(spark):
    rows = [(at, f"http://h.example/{at}", PAGE.format("t", at, "<p>p</p>" * at), None, None) for at in range(4)]
    rows.append((9, "http://h.example/9", PAGE.format("t", "u", "<table><tr><td>1</table>"), None, None))
    wrapper = H.wrappers(spark.createDataFrame(rows, SCHEMA).repartition(4)).first().wrapper
    text = H.expression(H.unpacked(wrapper))
    assert H.packed(H.unpacked(wrapper)) == wrapper
    assert "ul(li(#)+)" in text and "table(tr(td(#)))?" in text and "p(#)+" in text


def test_hosts_without_marks_lose_what_never_differs():
    pages = [f"<div>Menu of ours</div><div class='x'><p>Text number {at}</p></div>" for at in range(4)]
    trees = list(map(H.page_tree, pages))
    wrapper = H.folded(trees[0])
    for tree in trees[1:]:
        wrapper = H.joined(wrapper, H.folded(tree))
    assert H.main_text(trees[2], H.marked(wrapper)) == "Text number 2"


@pytest.mark.parametrize("page", [None, "", "<", "<a href='x", "</p></p>", "<div" * 50, "<p>" * 300 + "x"])
def test_broken_markup_does_not_fail(page):
    tree = H.page_tree(page)
    H.main_text(tree, H.marked(H.folded(tree)))


def alone(page):
    tree = H.page_tree(page)
    return H.main_text(tree, H.marked(H.unpacked(H.packed(H.folded(tree)))))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="layout sidebar-right"><nav>n</nav><article><p>t</p></article></div>', "t"),
        ('<header>top</header><article><header class="entry-header"><h1>T</h1></header><p>b</p></article>', "T b"),
        ('<article>a</article><div class="sidebar"><article>teaser</article></div>', "a"),
        ('<div class="comments"><article class="comment">c</article></div><div class="x"><p>words</p></div>', "words"),
        ('<div class="sidebar"><p>s</p></div><div><p>words</p></div>', "words"),
        ('<article>a<!-- <p>no</p> -->b<p title="1 > 0">c</p><p title="open>d</p></article>', "ab c d"),
        ("<p>before<!-- never closed <p>no</p>", "before"),
    ],
)
def test_roots_and_names(page, text):
    assert alone(page) == text


def test_a_root_on_one_page_says_nothing_about_another():
    pages = [PAGE.format(f"T{at}", f"words {at}", "") for at in range(3)]
    pages += [f"<header>Top</header><div class='x'><p>Other template {at}</p></div>" for at in range(3)]
    trees = list(map(H.page_tree, pages))
    wrapper = H.folded(trees[0])
    for tree in trees[1:]:
        wrapper = H.joined(wrapper, H.folded(tree))
    marks = H.marked(wrapper)
    assert H.main_text(trees[1], marks) == "T1 words 1 x & y z"
    assert H.main_text(trees[4], marks) == "Other template 1"


def table_pairs(one, two):
    """The alignment by the full table."""
    n, m = len(one), len(two)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if one[i] == two[j] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    while i < n or j < m:
        if i < n and j < m and one[i] == two[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            yield i, None
            i += 1
        else:
            yield None, j
            j += 1


def test_alignments_are_those_of_the_full_table(monkeypatch):
    draw = random.Random(3)
    for _ in range(500):
        monkeypatch.setattr(H, "ROWS_KEPT", draw.randint(1, 5))
        one, two = ([[draw.choice("abcd")] for _ in range(draw.randint(0, 14))] for _ in range(2))
        assert list(H._pairs(one, two)) == list(table_pairs(one, two))


def test_generated_pages_give_back_the_words_of_their_articles():
    """Hosts of two templates, blocks in any number and order: what was put into the articles comes out."""
    draw = random.Random(7)
    words = lambda: " ".join("".join(draw.choice("abcdeé") for _ in range(draw.randint(1, 7))) for _ in range(draw.randint(1, 9)))
    wrapper, pages = None, []
    for _ in range(60):
        blocks = [(draw.choice(("p", "h2", "blockquote", "pre", "div")), words()) for _ in range(draw.randint(1, 12))]
        body = "".join(f"<{tag}>{text.replace(' ', chr(10))}</{tag}>" for tag, text in blocks)
        noise = f"<nav><ul>{'<li><a>x</a>' * draw.randint(1, 5)}</ul></nav><div class='ad-{draw.randint(1, 9)}'>{words()}</div>"
        around = draw.choice(("<article>{}</article>", "<div class='page with-sidebar'><main>{}</main></div>"))
        tree = H.page_tree(noise + around.format(body) + f"<footer>{words()}</footer>")
        wrapper = H.joined(wrapper, H.folded(tree)) if wrapper else H.folded(tree)
        pages.append((tree, " ".join(text for _, text in blocks)))
    marks = H.marked(wrapper)
    for tree, text in pages:
        assert H.main_text(tree, marks) == text


@pytest.mark.parametrize(
    "page",
    ["<div>" * 20000 + "x", "<div " * 10000, "<!" * 30000, "<ul>" * 20000 + "x", "<a \"><a\"\"><a\"\"><a\"" * 4000 + "'",
     "".join(f"<h3>{at}</h3><p>{at}</p>" for at in range(4000))],
    ids=["deep", "open", "declarations", "lists", "quotes", "many"],
)
def test_hard_markup_takes_little_time(page):
    start = time.time()
    tree = H.page_tree(page)
    wrapper = H.joined(H.folded(tree), H.folded(H.page_tree("<p>other</p>" + page)))
    H.main_text(tree, H.marked(H.unpacked(H.packed(wrapper))))
    assert time.time() - start < 15
