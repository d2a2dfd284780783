import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import pages

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.fixture(scope="module")
def model(rows):
    return pages.fit_labeller(rows)


def test_blocks_of_broken_markup():
    page = '<!-- <p>no</p> --><p>one <b>bo</b>ld<br>x<p class="a b">&lt;two&gt; &amp\n three<script>var t="</p>";</script><ul><li>l1<li>l2</ul>tail<a href="x'
    got = pages.leaf_blocks(page)
    assert [b.text for b in got] == ["one bold x", "<two> & three", "l1", "l2", "tail"]
    assert got[1].path == ["p", ".a", ".b"] and got[2].path == ["ul", "li"] and got[4].path == []
    assert pages.leaf_blocks(None) == pages.leaf_blocks("<title>x</title>") == []


def test_elements_that_close_themselves_or_never_cut_nothing_off():
    texts = lambda page: [b.text for b in pages.leaf_blocks(page)]
    for tag in ('<svg class="i"/>', "<math/>", "<svg><title/><path d=x /></svg>", "<SVG><text>no</text></SVG>", "<svg><svg/>no<svg>no</svg>no</svg>", "<title-bar>", "<template><p>no</p></template>", "<select><option>no<hr><option>no</select>"):
        assert texts(f"<article><p>one {tag} two</p><p>three</p></article><p>x</p>") == ["one two", "three", "x"], tag
    for tag in ("<button>no", "<svg>no", "<select><option>no", "<template><p>no"):
        assert texts(f"<article><div>one {tag}</div><p>two</p></article><p>x</p>") == ["one", "two", "x"], tag
        if "template" not in tag:
            assert texts(f"<article>one {tag}<p>two</p>three</article><p>x</p>") == ["one", "two", "three", "x"], tag
    for tag in ("object", "noscript", "video", "audio", "canvas"):
        assert texts(f"<p>one<{tag} a=b>two</{tag}>three</p><p>x</p>") == ["one two three", "x"]
        assert texts(f"<article>one<{tag}>two<p>three</p></article><p>x</p>") == ["one two", "three", "x"]
    assert texts("<p>if <math><mi>x</mi><mo>=</mo><mn>1</mn></math> then") == ["if x=1 then"]
    assert texts("<p>one<script>no</p><p>") == ["one"] and texts("<p>one<title/>no</title>two") == ["onetwo"]


def test_article_text_of_pages_not_trained_on(spark, rows, model):
    import html

    out = rows.select("html", pages.main_text(model).alias("text")).collect()
    for r in out:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:h1|p)>", inside)]
        assert r["text"] == " ".join(p for p in parts if p)


def test_other_layouts(model):
    page = (
        '<html><body><div class="header"><p>Site</p></div><div class="menu"><ul><li><a href=x>Home</a></li><li><a>News</a></li></ul></div><main><h1>Title here</h1>'
        "<p>Thtion on the in, that thing erand. Thes were on.</p><p>Anheth or the inge on that the by. Er.</p><aside><p>Related: foo bar</p></aside></main>"
        '<div class="comments"><p>I think so.</p></div><form><label>Email</label></form><footer>&copy; 2020</footer></body></html>'
    )
    blocks = pages.leaf_blocks(page)
    assert model.text(blocks, model.label(pages.Encoder(), [blocks])[0]) == "Title here Thtion on the in, that thing erand. Thes were on. Anheth or the inge on that the by. Er."


def test_gradients_match_differences():
    """Training lowers the loss of a tiny problem that needs the neighbours."""
    page = lambda order: [pages.Block(["article" if m else "nav", "p"], w, 0) for w, m in order]
    sample = [page([("menu one", 0), ("alpha beta. gamma", 1), ("delta", 1), ("foot", 0)]) for _ in range(4)]
    model = pages.train(sample, steps=60, batch=4)
    got = model.label(pages.Encoder(), sample)[0]
    assert got.tolist() == [False, True, True, False]


def test_batches_do_not_change_labels(model, rows):
    some = [pages.leaf_blocks(r["html"]) for r in rows.limit(12).collect()]
    whole = model.label(pages.Encoder(), some)
    single = [model.label(pages.Encoder(), [p], cells=1)[0] for p in some]
    assert all((a == b).all() for a, b in zip(whole, single))
    assert [x.tolist() for x in model.label(pages.Encoder(), [[], some[0]])][0] == []


def test_tables_without_article_tags_give_the_same_texts(rows, model):
    """Neither tag occurs in the whole table, so layout has to name the training blocks."""
    bare = rows.withColumn("html", F.regexp_replace("html", r"(?i)(</?)(?:article|main)\b", "$1div"))
    assert bare.where(F.lower("html").rlike("<(article|main)")).count() == 0
    other = pages.fit_labeller(bare)
    want = {r[0]: r[1] for r in rows.select("page_id", pages.main_text(model)).collect()}
    got = {r[0]: r[1] for r in bare.select("page_id", pages.main_text(other)).collect()}
    assert sum(map(len, want.values())) > 10_000 and got == want


def test_layout_names_the_container_of_running_text():
    block = lambda path, text, linked=0: pages.Block(path.split(), text, linked)
    page = [
        block("html body div ul li", "Home", 4), block("html body div div h1", "A title"), block("html body div div p", "One sentence. And one more of it."),
        block("html body div div p", "See all of these links.", 20), block("html body div div p", "Same on every page."), block("html body div p", "Side note."),
        block("html body div div div .comments p", "I like this very much. Thank you for this long and kind text."),
    ]
    assert pages.placed_main(page, frozenset({"Same on every page."})) == [False, True, True, False, True, False, False]
    assert pages.placed_main([block("html body nav a", "Home", 4)]) == [False] and pages.placed_main([]) == []


def test_odd_rows_and_empty_tables(spark):
    long = "<article>" + "<p>word and word.</p>" * 20_000 + "</article>"
    data = [(1, None, None), (2, "u", ""), (3, "u", "<nav>only menu</nav>"), (4, "u", long), (4, "u", long), (None, None, "plain text & more")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "path": F.lit("mine")})
    model = pages.fit_labeller(df)
    out = df.withColumn("text", pages.main_text(model)).collect()
    assert len(out) == 6 and [r["text"] for r in out if r["page_id"] in (1, 2)] == ["", ""]
    assert len({r["text"] for r in out if r["page_id"] == 4}) == 1
    none = df.limit(0)
    assert none.select(pages.main_text(pages.fit_labeller(none))).count() == 0
    assert isinstance(model.weights["out"], np.ndarray)
