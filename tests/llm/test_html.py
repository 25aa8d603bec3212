import random
import re
from html import unescape

from callweave.llm import html


def page(title, paragraphs, n, layout="article"):
    body = "".join(f"<p>{p}</p>" if i % 2 else f"<p>{p}" for i, p in enumerate(paragraphs))
    core = {"article": f"<article><h1>{title}</h1>{body}</article>", "div": f"<div id=text{n}><h2>{title}</h2>{body}</div>"}[layout]
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t='</p>'</script></head><body><nav><ul><li><a href=/a>menu {n}</a></ul></nav><div id=top>Welcome to our site</div>{core}<div class='user-comments'><p>nice post</p></div><form><label>mail</label><input></form><footer>about {n}</footer></body></html>"


def test_layouts(spark):
    rng = random.Random(7)
    words = lambda k: " ".join(rng.choice("alpha beta gamma delta &amp; &eacute;psilon".split()) for _ in range(k))
    rows, want = [], {}
    for i in range(60):
        layout = "article" if i % 2 else "div"
        title, paragraphs = words(4), [words(rng.randint(3, 30)) for _ in range(rng.randint(1, 7))]
        rows.append((i, f"http://{layout}.example.com/{i}", page(title, paragraphs, i, layout), 0))
        want[i] = "\n\n".join(unescape(x) for x in [title, *paragraphs])
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    for r in html.main_text(df).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)
    assert {r.host for r in html.wrappers(df).collect()} == {"article.example.com", "div.example.com"}


PAGE = "<body><div class='kopf'>Die Zeitung, {n}. Seite</div><div class='inhalt'><h1>{title}</h1><p>{a}</p><div class='kasten'>Jetzt abonnieren und sparen</div><p>{b}</p><div class='meinungen'>Leser {n}: toll</div></div><div class='fuss'>Kontakt und Impressum</div></body>"


def test_template_nodes_without_telling_names(spark):
    """Constant boxes go inside the text as well, also if a number in them varies; text that varies stays."""
    rng = random.Random(2)
    words = lambda k: " ".join(rng.choice("eins zwei drei vier acht neun".split()) for _ in range(k))
    rows, want = [], {}
    for i in range(6):
        title, a, b = words(3), words(9), words(12)
        rows.append((i, "http://zeitung.example/x", PAGE.format(title=title, a=a, b=b, n=i + 1)))
        want[i] = f"{title}\n\n{a}\n\n{b}"
    rows.append((6, "http://zeitung.example/y", "<body><section>another <i>layout</i></section><div class='fuss'>Kontakt und Impressum</div></body>"))
    want[6] = "another layout"
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df.union(df)).collect()}
    assert {i: got[i] for i in range(6)} == {i: want[i] for i in range(6)}
    rare = {r.page_id: r.text for r in html.main_text(spark.createDataFrame([*rows * 2, *[(9, r[1], r[2]) for r in rows[:6]] * 20], "page_id long, url string, html string")).collect()}
    assert rare[6] == "another layout"


def test_names_do_not_delete_parts_of_an_article():
    article = "<article><div class='search results'>a b</div><p id='social-history'>c</p><section class='case-discussion'>d</section>{}</article>"
    assert html.extract(article.format("")) == "a b\n\nc\n\nd"
    assert html.extract(article.format("<div class='comments'>e</div><div class='user-comment-list'>e</div><div role='navigation'>f</div>")) == "a b\n\nc\n\nd"
    assert html.extract("<article><div class='header'><h1>T</h1></div><p>a</p></article><div class='site-header'>s</div>") == "T\n\na"
    for name in ("reader-comments", "cookie-consent-banner", "newsletter signup", "related-posts", "share-buttons", "ad-slot", "comment-12", "main-nav", "page-footer"):
        assert html.extract(f"<div><h1>Title of it</h1><p>text of it</p><div class='{name}'>x</div><p>more of it</p></div>") == "Title of it\n\ntext of it\n\nmore of it"
        assert html.extract(f"<div><h1>Title of it</h1><section id='{name}'>x</section></div>") == "Title of it"
    for name in ("article-header", "entry-header", "banner-history", "notice-of-meeting", "advertising-law"):
        assert html.extract(f"<div><div class='{name}'>Title of it</div><p>text</p></div>") == "Title of it\n\ntext"
    assert html.extract("<div class='ad'>an offer</div><article><p>text of it</p></article><div class='teaser'>more</div>") == "text of it"
    assert html.extract("<article>teaser</article><section>a much longer text beside the article</section>") == "teaser\n\na much longer text beside the article"
    assert html.extract("<article>one</article><article>two</article>") == "one\n\ntwo"


def test_pages_alike_lose_nothing(spark):
    same = page("t", ["one", "two"], 1)
    df = spark.createDataFrame([(i, "http://a/", same) for i in range(5)] + [(9, None, None), (10, "no url", ""), (11, "http://b/", "<p>just <b>a</b><br>line")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert all(got[i] == "t\n\none\n\ntwo" for i in range(5))
    assert (got[9], got[10], got[11]) == ("", "", "just a line")
    assert html.main_text(df.limit(0)).count() == 0


def test_the_shuffled_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, "http://a/", page("t", [f"p{i}"], i, "div")) for i in range(9)], "page_id long, url string, html string")
    want = sorted(map(tuple, html.main_text(df).collect()))
    monkeypatch.setattr(html, "small_enough", lambda *_: False)
    assert sorted(map(tuple, html.main_text(df).collect())) == want


def test_tag_soup():
    assert html.extract("<p>a<p>b<ul><li>c<li>d</ul>e") == "a\n\nb\n\nc\n\nd\n\ne"
    assert html.extract("<table><tr><td>1<td>2<tr><td>3</table>") == "1\n\n2\n\n3"
    assert html.extract("<div>x &lt; y &#233; <!-- no --> <script>if (a<b) {}</script>z</div") == "x < y é z"
    assert html.extract("<p>a</b></p></div><b>c<p>d</b></p>") == "a\n\nc\n\nd"
    assert html.extract("<div class=content>" * 3000 + "deep") == "deep"
    assert html.extract("<style>p{}") == ""
    assert html.extract("<article><header><h1>T</h1></header><p>x</p><aside>no</aside></article><header>site</header>") == "T\n\nx"


def random_tree(rng, depth=0):
    return rng.choice("abc"), [random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))]


def as_outline(tree, known):
    signs, kids = [], []

    def add(node):
        at = len(signs)
        signs.append(node[0])
        kids.append([])
        for c in node[1]:
            kids[at].append(len(signs))
            add(c)

    add(tree)
    return html.Outline(signs, kids).number(known)


def best(a, b):
    """Size of the greatest matching, by trying each choice."""
    if a[0] != b[0]:
        return 0

    def rest(x, y):
        return max(rest(x[1:], y), rest(x, y[1:]), (w := best(x[0], y[0])) and w + rest(x[1:], y[1:])) if x and y else 0

    return 1 + rest(a[1], b[1])


def test_tree_matching_equals_brute_force():
    rng = random.Random(5)
    for cells in (html.CELLS, 0):
        for _ in range(700):
            x, y = ("r", random_tree(rng)[1]), ("r", random_tree(rng)[1])
            known = {}
            a, b = as_outline(x, known), as_outline(y, known)
            m = html.Matching(a, b, cells)
            found = m.nodes()
            assert len(found) == best(x, y) == m.weight(0, 0)
            parent = lambda o: {c: i for i, own in enumerate(o.kids) for c in own}
            up_a, up_b = parent(a), parent(b)
            for j, i in found.items():
                assert a.signs[i] == b.signs[j] and (j == 0 or found[up_b[j]] == up_a[i])
            for j, k in zip(sorted(found), sorted(found)[1:], strict=False):
                if up_b.get(j) == up_b.get(k):
                    assert found[j] < found[k]


def test_deep_and_wide_pages():
    deep = "<div class=x>" * 20_000 + "deep" + "</div>" * 20_000
    wide = "".join(f"<p>a{i}</p><ul><li>b{i}</ul>" for i in range(1500))
    known = html.Wrapper(html.outline(deep).dump(), [1])
    assert html.extract(deep, known) == "deep" == html.extract(deep.replace("x", "y", 7), known)
    other = html.Wrapper(html.outline("<h1>t</h1>" + wide + "<h2>u</h2>").dump(), [1])
    assert html.extract("<h3>t</h3>" + wide + "<h4>u</h4>", other).count("\n\n") == 3001


def test_against_the_tables(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
        blocks = [" ".join(unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in parts]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
