"""HTML extraction on hand-made pages, the pipeline stage by stage, and the registry."""
import pytest

import corpus_pipeline
from riskloom.llm import op10_html_text as o10
from riskloom.llm import queries
from tests.llm.conftest import DOCS, odd_rows, para

SF = "/root/testdata/sf0.001"


def page(body: str, wrap: str = "article") -> str:
    return (f'<!DOCTYPE html><html><head><title>t</title><script>var t="</p><p>no";</script></head><body><nav><ul>'
            + "".join(f'<li><a href="/{k}">menu{k}</a></li>' for k in range(6)) + '</ul></nav><!-- ad --><div class="ad">buy this now</div>'
            + f"<{wrap}>{body}</{wrap}><footer>&copy; site &middot; imprint words</footer></body></html>")


def test_op10_blocks_entities_and_boilerplate(spark):
    long1, long2 = para(1, 40), para(2, 40)
    pages = [
        (1, "u1", page(f"<h1>A &amp; B</h1><p>{long1}<br>next   line\n here</p><p><b>{long2}<br><p>last &lt;x&gt; &eacute;")),
        (2, "u2", page(f"<h1>T</h1><p>{long1}</p><form><input name=q><label>search me</label></form><div class='comments'><p>reader says</p></div>"
                       f"<p>{long2}</p><aside>side words</aside>")),
        (3, None, None), (4, "u4", ""), (5, "u5", "<html><body></body></html>"),
        (6, "u6", page(f"<p>{long1}</p><p>{long2}</p>", "section")), (6, "u6", page(f"<p>{long1}</p><p>{long2}</p>", "section")),
        (None, "u7", page(f"<p>{long1} <a href='/x'>a link</a> and < more &unknown; text</p>")[:-30]),
        (8, "u8", "plain words only, no markup at all"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {}
    for r in o10.html_text(df).collect():
        got.setdefault(r.url, []).append(r.text)
        assert r.n_chars == len(r.text)
    assert got["u1"] == [f"A & B\n{long1} next line here\n{long2}\nlast <x> é"]
    assert got["u2"] == [f"T\n{long1}\n{long2}"]
    assert got[None] == [""] and got["u4"] == [""] and got["u5"] == [""]
    assert got["u6"] == [f"{long1}\n{long2}"] * 2
    assert got["u7"] == [f"{long1} a link and < more &unknown; text"]
    assert got["u8"] == ["plain words only, no markup at all"]
    assert o10.html_text(df.limit(0)).count() == 0


def test_op10_layout_words_do_not_lose_the_article(spark):
    long1, long2 = para(1, 40), para(2, 40)
    art = f"<article><header class='entry-header'><h1>Big new title</h1></header><p>{long1}</p><p>{long2}</p></article>"
    bare = f"<p>{long1}</p><p>{long2}</p>"
    menu = "<nav><a href='/'>menu one</a></nav>"
    bodies = {
        "has-sidebar": f"<div class='page has-sidebar'>{menu}{art}<div class='sidebar'><p>side words here</p></div></div>",
        "comments-open": f"{menu}<div class='post comments-open'>{bare}</div>",
        "form": f"<form id='aspnetForm'>{menu}<div class='header'>site name</div>{art}<div class='site-footer'>imprint</div></form>",
        "form no mark": f"<form id='aspnetForm'>{menu}{bare}</form>",
        "one word": f"<div class='menu share'>{menu}{art}</div>",
        "comments": f"{menu}{art[:-10]}<div class='comments'><article class='comment-body'><p>{para(3, 300)}</p></article></div></article>"
                    f"<ol class='comment-list'><li class='comment'><article class='comment-body'><p>{para(4, 300)}</p></article></li></ol>",
        "hidden": f"{menu}<template><main><p>{para(5, 50)}</p></main></template>{art}",
    }
    df = spark.createDataFrame([(1, k, f"<html><body>{b}</body></html>") for k, b in bodies.items()], "page_id long, url string, html string")
    got = {r.url: r.text for r in o10.html_text(df).collect()}
    title = f"Big new title\n{long1}\n{long2}"
    want = {k: f"{long1}\n{long2}" if k in ("comments-open", "form no mark") else title for k in bodies}
    assert got == want


def test_op10_keeps_the_whole_article_and_drops_comments(spark):
    paras = [para(k, 35) for k in range(6)]
    ps = lambda a, b: "".join(f"<p>{t}</p>" for t in paras[a:b])                                      # noqa: E731
    menu = "<nav>" + "".join(f"<a href='/{k}'>menu{k}</a>" for k in range(8)) + "</nav>"
    links = "".join(f"<li><a href='/{k}'>see {k}</a></li>" for k in range(60))
    entries = "".join(f"<li>entry {k}</li>" for k in range(50))
    bodies = {
        "aside": (f"<article>{ps(0, 3)}<aside><ul>{links}</ul></aside>{ps(3, 6)}</article>", paras),
        "newsletter": (f"<article>{ps(0, 3)}<div class='newsletter'>{'<span><b>x</b></span>' * 60}</div>{ps(3, 6)}</article>", paras),
        "list": (f"<main><h1>Heading</h1><p>{paras[0]}</p><ul>{entries}</ul><p>{paras[1]}</p></main>",
                 ["Heading", paras[0], *[f"entry {k}" for k in range(50)], paras[1]]),
        "comments": (f"<div id=content><p>only seven words are the article text</p></div><div class=comments><p>{para(9, 150)}</p></div>",
                     ["only seven words are the article text"]),
        "comment articles": (f"<article><h1>Title</h1>{ps(0, 1)}</article><div id='comments'><article class='comment'><p>{para(9, 200)}</p></article></div>",
                             ["Title", paras[0]]),
        "long": ("<article>" + "".join(f"<p>{para(k, 90)}</p>" for k in range(400)) + "</article>", [para(k, 90) for k in range(400)]),
    }
    df = spark.createDataFrame([(1, k, f"<html><body>{menu}{b}<footer>imprint</footer></body></html>") for k, (b, _) in bodies.items()],
                               "page_id long, url string, html string")
    want = {k: "\n".join(t) for k, (_, t) in bodies.items()}
    assert {r.url: r.text for r in o10.html_text(df).collect()} == want
    learned = o10.learn(spark.read.parquet(f"{SF}/pages.parquet"))
    clash = df.selectExpr("*", "'x' AS text", "'y' AS n_chars", "1 AS events")
    assert {r.url: r.text for r in o10.html_text(clash, learned).collect()} == want


def test_op10_region_is_the_maximum(spark):
    import random
    rng = random.Random(4)
    for _ in range(50):
        p = o10.Page("")
        p.events = [("w", rng.randint(1, 5), 0) if rng.random() < 0.5 else ("<t>", 0, -1) for _ in range(30)]
        weights = {"w": 0.7, "<t>": -1.9}
        value = [n * 0.7 if n else -1.9 for _, n, _ in p.events]
        i, j = p.region(weights)
        best = max(sum(value[a:b]) for a in range(31) for b in range(a, 31))
        assert abs(sum(value[i:j]) - best) < 1e-9


def test_pipeline_stages(spark, tmp_path):
    item = para(900, 30)
    rows = odd_rows() + [(500, para(500, 60) + " " + item + " " + para(501, 20), "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumnRenamed("n_chars", "score")
    labels = [(i, 1, 0) for i in range(20, 60)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "ngram_join", "decontaminate", "pack"]
    good = stages["quality"](spark, docs, str(tmp_path))
    assert good.columns == docs.columns and good.count() == len(rows)       # one class only: nothing is rejected
    one = stages["ngram_join"](spark, good, str(tmp_path))
    ids = sorted(str(r.doc_id) for r in one.collect())
    assert one.columns == docs.columns
    assert ids == sorted([str(r[0]) for r in rows if r[0] not in (2, 3, 8, 10)] + ["10"])
    clean = stages["decontaminate"](spark, one, str(tmp_path))
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == [x for x in ids if x != "500"]
    packed = stages["pack"](spark, clean, str(tmp_path))
    assert {str(r.doc_id) for r in packed.collect()} == set(ids) - {"500"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and len(df.columns) == len(set(df.columns))


def test_op1_equals_its_sql(spark):
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.ORACLES["op1_ngram_join"]).fetchall())
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op1_ngram_join"](spark, SF).collect())
    assert got == want
