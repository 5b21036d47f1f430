from pyspark.sql import functions as F

from cellseason.llm.html_wrapper import BESIDE, Matcher, align, drive, extract, fit_wrappers, infer, loads, main_text, parse

from .helpers import clashing


def page(i, extra="", tail="</body></html>", body=None):
    blocks = body or "".join(f"<p>Text {i} block {j}.</p>" for j in range(1 + i % 4))
    return (f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/{i}'>go {i}</a></li></ul></nav>"
            f"<!-- <p>no</p> -->{extra}<article><h1>Head {i}</h1>{blocks}</article><footer>&copy; site {i}</footer>{tail}")


def run(spark, rows):
    df = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    return {r.page_id: r.text for r in extract(df).collect()}


def test_articles_without_what_stands_beside(spark):
    beside = ("<header>Site</header><aside>Side</aside><div class='ad'>Buy</div><div id='cookie-notice'>Cookies</div><form><input>Name</form>"
              "<section class='comments'><p>First!</p></section><noscript>No</noscript>")
    rows = [(i, f"http://h{i % 2}.x/{i}", page(i, beside if i % 3 else "")) for i in range(20)]
    want = {i: "\n".join([f"Head {i}", *(f"Text {i} block {j}." for j in range(1 + i % 4))]) for i in range(20)}
    assert run(spark, rows) == want


def test_classes_of_the_whole_page_do_not_hide_it():
    assert main_text("<body class='no-sidebar'><article class='post comments-open'><p>In</p><div class='share'>x</div></article>", None) == "In"


def test_messy_markup(spark):
    body = "<p><b>One &amp; two &#233;<br>three.<p>Four\n  <i>fi</i>ve</p>six<ul><li>a<li>b</ul><table><tr><td>c<td>d</table> < 7 & 8"
    cut = page(3, tail="")[:-30]
    rows = [(1, None, page(1, body=body)), (2, "", page(2)), (3, "no host", cut), (4, "http://a/", None), (5, "http://a/", ""), (6, "http://a/", "<div>only "), (7, "http://b/", "plain text\n here"),
            (2, "", page(2))]
    got = run(spark, rows)
    assert got[1] == "Head 1\nOne & two é three.\nFour five\nsix\na\nb\nc\nd\n< 7 & 8"
    assert got[2] == "Head 2\nText 2 block 0.\nText 2 block 1.\nText 2 block 2."
    assert got[3].startswith("Head 3\nText 3 block 0.") and got[4] == got[5] == "" and got[6] == "only" and got[7] == "plain text here"


def test_template_texts_of_pages_without_article_go(spark):
    rows = [(i, "http://a/x", f"<body><div>Our site</div><div><p>Story {i} a</p><p>Story {i} b</p></div><div>Made by us</div>") for i in range(6)]
    assert run(spark, rows) == {i: f"Story {i} a\nStory {i} b" for i in range(6)}


def test_wrappers_have_optional_and_repeated_parts():
    got = infer([page(1), page(2, "<div class='ad'>x</div>"), page(3)])

    def find(parts, key):
        for p in parts:
            if p["k"] == key:
                return p
            inner = find(p.get("c", p.get("g", [])), key)
            if inner:
                return inner

    assert find(got, "p")["rep"] and find(got, "div.ad")["opt"] and not find(got, "article")["opt"]
    assert find(got, "div.ad")["c"][0]["at"] == BESIDE
    groups = infer(["<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"])
    assert groups[0]["c"][0]["k"] == "(dt dd)" and groups[0]["c"][0]["rep"]
    assert main_text("<dl><dt>1<dd>2<dt>3<dd>4<dt>5<dd>6<dt>7<dd>8</dl>", Matcher(groups)) == "1\n2\n3\n4\n5\n6\n7\n8"


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep, None) == "x"
    long = "<article>" + "<p>word</p>" * 50000 + "</article>"
    assert main_text(long, Matcher(infer([long]))).count("\n") == 49999
    assert parse("<a href='" + '"' * 5000).children == []


def test_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert extract(none).collect() == [] and extract(none.withColumn("wrapper", F.lit(1))).columns == ["page_id", "url", "text", "n_chars"]


def test_whole_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    for p in pages.collect():
        article = p.html.split("<article>", 1)[1].split("</article>")[0].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert got[p.page_id].text == "\n".join(b for b in blocks if b) and got[p.page_id].n_chars == len(got[p.page_id].text)


def test_deep_pages_in_the_sample_of_their_host(spark):
    deep = {i: "<html><body>" + "<div>" * 3000 + f"<p>x{i}" for i in range(3)}
    got = run(spark, [(i, "http://a/", d) for i, d in deep.items()] + [(3, "http://a/", page(3, body="<p>In</p>"))])
    assert got == {0: "x0", 1: "x1", 2: "x2", 3: "Head 3\nIn"}


def test_layout_boxes_around_the_article_do_not_hide_it():
    article = "<article><h1>Head</h1><p>A long text of the article.</p><div class='share'>x</div></article>"
    boxes = ["<div class='layout has-sidebar'>", "<div class='content-sidebar-wrap'>", "<div class='elementor-widget'>", "<div id='page' class='no-header'>", "<section class='search-page'>"]
    for box in [*boxes, "".join(boxes)]:
        close = "</section>" if box.endswith("<section class='search-page'>") else "</div>"
        one = f"<body><nav>Menu</nav><p>Home</p>{box}{article}<div class='widget'>Tags</div>{close}<footer>Foot</footer>"
        assert main_text(one, None) == main_text(one, Matcher(infer([one]))) == "Head\nA long text of the article."
    assert main_text("<div id='page' class='no-header'><p>All of the text</p><div class='ad'>Buy</div></div>", None) == "All of the text"
    assert main_text("<article>Short</article><div class='related'><article>Another article that is longer</article></div>", None) == "Short"
    assert main_text("<div class='comments'><article>First!</article></div><p>Text</p>", None) == "Text"


def test_only_texts_frequent_over_all_pages_are_template(spark):
    rows = [(i, "http://a/x", f"<body><div>Our site</div><p>{'Shared' if i < 2 else f'Own {i}'}</p><p>Story {i}</p>") for i in range(40)]
    rows += [(100 + i, "http://b/x", f"<body><div class='m{i}'>Menu {i}</div><p>One article</p>") for i in range(2)]
    rows += [(200 + i, "http://c/x", "<body><div>All</div><p>Same</p>") for i in range(4)]
    got = run(spark, rows)
    assert all(got[i] == f"{'Shared' if i < 2 else f'Own {i}'}\nStory {i}" for i in range(40))
    assert all("One article" in got[100 + i] for i in range(2)) and all(got[200 + i] == "All\nSame" for i in range(4))


def test_wrappers_come_from_all_pages_of_the_host(spark):
    def keys(parts):
        return {k for p in parts for k in ({p["k"]} | keys(p.get("c", p.get("g", []))))}

    rows = [(i, f"http://h{i % 2}.x/{i}", page(i, f"<div class='own-{chr(97 + i % 26)}{chr(97 + i // 26)}'>x</div>")) for i in range(300)]
    rows.append((300, "http://h0.x/long", "<main>" + "<p>word</p>" * 30000 + "<section class='last'>x</section></main>"))
    got = {r.host: keys(loads(r.wrapper)) for r in fit_wrappers(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()}
    assert set(got) == {"h0.x", "h1.x"} and "section.last" in got["h0.x"] - got["h1.x"]
    for i in range(300):
        assert ".".join(["div", *sorted({"own", f"{chr(97 + i % 26)}{chr(97 + i // 26)}"})]) in got[f"h{i % 2}.x"]


def test_long_lists_of_parts_keep_every_part():
    many = lambda n: infer(["".join(f"<div class='k{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}{n if i % 3 else ''}'>t</div><p>u</p>" for i in range(600))])
    got = drive(align(many("v"), many("w")))
    assert {p["k"] for p in many("v") + many("w")} <= {p["k"] for p in got}
