import random

from segmill.llm.queries import op8_html_text
from segmill.llm.site_style import blocks_of, host_of, main_text


def kept(page):
    return " ".join(t for _, noise, _, t in blocks_of(page) if not noise)


def test_malformed_markup():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></ul></nav>
    <!-- <p>no</p> --><div class="ad">buy</div><article><h1>A &amp; B&nbsp;&lt;3</h1><p><b>bold <i>run</b>on<br>next<p>second  line
    here<p>1 < 2 and <a title="a>b" href=x>link</a><form><input>send</form></article><aside>side</aside><div id="comments"><p>first!</p></div><footer>&copy; x"""
    assert kept(page) == "A & B <3 bold runon next second line here 1 < 2 and link"


def test_unclosed_noise_ends_at_the_article():
    assert kept("<body><nav>menu<ul><li>x<article><p>text</article><footer>f") == "text"
    assert kept("plain & simple") == "plain & simple" and kept("") == "" and kept("<p>") == "" and kept("</p></div>x") == "x"
    assert kept("<script>never closed <p>x") == "" and kept("<!-- never closed <p>x") == ""
    assert kept("<table><tr><td>a<td>b<tr><td>c</table><ul><li>d<li>e<ul><li>f</ul></ul>") == "a b c d e f"


def test_host():
    assert [host_of(u) for u in ("https://A.b:80/c", "http://u@h?x", None, "", "x/y")] == ["a.b", "h", "", "", ""]


def site(n, host, rnd):
    pages = []
    for i in range(n):
        words = [" ".join(rnd.choice("alpha beta gamma delta eps zeta".split()) + str(rnd.randrange(500)) for _ in range(30)) for _ in range(3)]
        body = "".join(f"<div class='para'>{w}</div>" for w in words)
        pages.append((len(pages), f"https://{host}/p{i}", f"<body><div class='top'>Welcome to our site</div><div class='body'>{body}</div><div class='end'>All rights {i % 2}</div></body>", "x", " ".join(words)))
    return pages


def test_templates_without_meaningful_tags_are_found_by_entropy(spark):
    rnd = random.Random(3)
    rows = site(60, "one.example", rnd)
    small = [(1000 + i, u, h, x, t) for i, u, h, x, t in site(4, "two.example", rnd)]
    extra = [(5000, None, "<p>alone", "x", ""), (5001, "https://one.example/e", None, "x", ""), (5002, "https://one.example/e", "", "x", ""), (5003, "https://one.example/f", "<article>" + "<p>long text" * 20_000 + "</article>", "x", "")]
    rows += [(2000 + i, *r[1:]) for i, r in enumerate([rows[0]] * 30)]  # copies of one page are no template
    df = spark.createDataFrame([r[:4] for r in rows + small + extra], "page_id long, url string, html string, text string").repartition(7)
    got = {r.page_id: r for r in main_text(df).collect()}
    assert len(got) == len(rows) + len(small) + len(extra)
    assert all(got[r[0]].text == r[4] and got[r[0]].n_chars == len(r[4]) for r in rows)
    assert all(r[4] in got[r[0]].text and "Welcome" not in got[r[0]].text for r in small)
    assert [got[i].text for i in (5000, 5001, 5002)] == ["alone", "", ""] and got[5003].text == " ".join(["long text"] * 20_000)
    assert main_text(df.where("page_id < 0")).count() == 0


def test_elements_that_are_not_raw_text_do_not_cut_the_page():
    assert kept("<article><p>a<svg class='i'/>b</p><p>c</p>") == "ab c"
    assert kept("<article><p>a<svg class='i'><title>t</title><g><text>no</text></g></svg>b</p><p>c<math><mi>x</mi></math>d") == "ab cd"
    assert kept("<article><p>a<button>b</p><p>c</p></article>") == "ab c"
    assert kept("<article><p>a<button>no<p>no</p></button>b</p><p>c<select><option>no</select>d</p><div>e<button>no</div><p>f<button>no</button>g") == "a b cd e fg"
    assert kept("<article><p>a<svg><svg/><svg>no</svg>no</svg>b<p>c<video>no<p>no</video>d<canvas>e<p>f") == "ab c de f"


def test_template_of_a_small_host_goes(spark, tmp_path):
    rows = site(4, "two.example", random.Random(3)) + [(10 + i, *r[1:]) for i, r in enumerate(site(1, "one.example", random.Random(4)))]
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.text for r in op8_html_text(spark, str(tmp_path)).collect()}
    assert all(r[4] in got[r[0]] and "Welcome" not in got[r[0]] for r in rows[:4])
    assert got[10] == f"Welcome to our site {rows[4][4]} All rights 0"  # one page tells nothing


def test_repeated_text_inside_articles_goes_and_varied_text_stays(spark):
    rows = [(i, "https://h.example/%d" % i, f"<article><header><h1>Title {i}</h1></header><p>Own words {i}</p><p>Share this page with friends</p><div class='ad-hoc'>free {i}</div>"
             f"<div class='legal-history'>law {i}</div><div class='comment-list'>c {i}</div><p>{'said twice' if i < 2 else f'said once {i}'}</p></article>") for i in range(12)]  # fmt: skip
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i} Own words {i} free {i} law {i} " + ("said twice" if i < 2 else f"said once {i}") for i in range(12)}


def test_entropies_same_as_brute_force(spark):
    """Over given pages: every block of every page is in the tree, with importances recomputed from their definition."""
    import math
    from collections import Counter, defaultdict

    import pyarrow.parquet as pq

    from segmill.llm.site_style import BLOCKS, GAMMA, _parsed, nodes_of, style_tree

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist()
    nodes, contents = defaultdict(list), defaultdict(set)
    for p in pages:
        seen = {}
        for path, style, whole, content, _, _ in nodes_of(p["html"]):
            seen[path] = (style, whole)
            contents[host_of(p["url"]), path, content].add(p["html"])
        for path, x in seen.items():
            nodes[host_of(p["url"]), path].append(x)

    def entropy(values):
        n = len(values)
        return -sum(c / n * math.log(c / n) for c in Counter(values).values()) / math.log(max(2, n))

    want = {}
    for (host, path, content), on in contents.items():
        x = nodes[host, path]
        n = len(x)
        node = GAMMA * entropy([c for _, c in x]) + (1 - GAMMA) * entropy([s for s, _ in x])
        want[host, path, content] = (n, (node * (n - 1) + 1) / n, ((1 - math.log(len(on)) / math.log(max(2, n))) * (n - 1) + 1) / n)
    df = spark.createDataFrame([(p["page_id"], p["url"], p["html"]) for p in pages], "page_id long, url string, html string")
    got = {(r.host, r.path, r.content): (r.pages, r.node, r.own) for r in style_tree(df.mapInArrow(_parsed, f"page_id long, url string, host string, page long, blocks {BLOCKS}")).collect()}
    assert got.keys() == want.keys() and len(got) > 100
    assert all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k], strict=True))
