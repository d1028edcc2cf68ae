import re

from pyspark.sql import functions as F

from tessera.functions import markdown, text as tx, urls


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[0]}" for k, v in values.items()) or "x int"
    row = tuple(v[1] for v in values.values()) or (1,)
    return spark.createDataFrame([row], schema).select(column.alias("o")).first()["o"]


def test_normalize_url(spark):
    def norm(u):
        return one(spark, urls.normalize_url(F.col("u"), {"www.a.example": "a.example"}), u=("string", u))

    assert norm("HTTPS://WWW.A.example/docs/x/#top") == "https://a.example/docs/x"
    assert norm("//B.example") == "https://b.example/"
    assert norm("http://b.example/a//?q=1") == "http://b.example/a/?q=1"
    assert norm(None) == "https:///"


def test_valid_origin(spark):
    ok = lambda u: one(spark, urls.is_valid_origin(F.col("u"), "d.example"), u=("string", u))
    assert ok("https://d.example/docs") and ok("https://d.example/docs/a-b/c_1")
    for bad in ("http://d.example/docs", "https://d.example/docsx", "https://d.example/docs/a%20", "https://d.example/docs/ä", "https://d.example/docs/a.md", "https://d.example/docs/_resources/a", "https://e.example/docs"):
        assert not ok(bad)


def test_candidates(spark):
    c = lambda u: one(spark, urls.data_candidates(F.col("u"), "b"), u=("string", u))
    assert c("https://d.example/docs/") == ["b/home/home_CN.md", "b/overview/overview_CN.md"]
    assert c("https://d.example/docs/a/index") == ["b/a/index/index_CN.md", "b/a/index_CN.md", "b/a/a_CN.md"]
    assert c("https://d.example/docs/quick-started")[-1] == "b/quick-start_CN.md"


def test_front_lines(spark):
    t = "> Source URL: https://a.example/x \n> Title: T\nbody"
    front = markdown.front_columns(F.col("t"))
    assert one(spark, front["source_url"], t=("string", t)) == "https://a.example/x"
    assert one(spark, front["data_type"], t=("string", t)) == "doc"
    assert one(spark, front["title"], t=("string", "> Title: T")) is None  # no line break after it


def test_images(spark):
    t = "see ![a](img/x.png) and ![b](https://c.example/y.png)"
    col = markdown.absolute_images(F.col("t"), F.lit("https://d.example/p/q.md"), F.lit("https://s.example/"))
    assert one(spark, col, t=("string", t)) == "see ![a](https://d.example/p/img/x.png) and ![b](https://c.example/y.png)"
    out = one(spark, markdown.enriched_images(F.col("t"), F.lit("doc-1")), t=("string", t))
    assert out["image_map"] == {"1": "img/x.png", "2": "https://c.example/y.png"}
    assert "placeholder: [[IMG:doc-1:2]]" in out["text"] and "图片内容与“a”相关。" in out["text"]

    def broken(url, alt, around):
        raise RuntimeError

    out = one(spark, markdown.enriched_images(F.col("t"), F.lit("d"), broken), t=("string", "![](u)"))
    assert "文档配图，建议结合上下文理解。" in out["text"]


def test_rendered(spark):
    html = "<body><nav>n</nav><main><h2>H</h2><p>a <b>b</b><script>x()</script></p><ul><li>i</li></ul><a href='/l'>l</a></main></body>"
    assert one(spark, markdown.rendered(F.col("h")), h=("string", html)) == "## H\n\na **b**\n\n- i\n\n[l](/l)"
    assert one(spark, markdown.rendered(F.col("h")), h=("string", None)) == ""
    both = "<body><div class='markdown-body'>no</div><div id='content'>yes</div></body>"
    assert one(spark, markdown.rendered(F.col("h")), h=("string", both)) == "yes"
    page = markdown.page_document(F.col("u"), F.col("t"), F.lit("g"), F.lit("now"), F.col("b"))
    assert one(spark, page, u=("string", "https://x"), t=("string", "T"), b=("string", " body ")) == "> Source URL: https://x\n> Title: T\n> Data Type: doc\n> Source Group: g\n> Crawled At: now\n\n# T\n\nbody\n"


def test_links(spark):
    t = "[a](https://x.example/a) [m](mailto:q) [r](other.md) [k](/docs/x.md) [u](../C/#f) [s](Data:z) https://y.example/b/ [a](https://x.example/a)"
    want = ["https://x.example/a", "https://x.example/docs/x.md", "https://x.example/C", "data://z", "https://y.example/b"]
    found = one(spark, markdown.markdown_links(F.col("t"), F.col("b")), t=("string", t), b=("string", "https://x.example/d/e"))
    assert [x for x in found if not x.startswith("data")] == [x for x in want if not x.startswith("data")]


def test_anchors(spark):
    """Expected rows by hand: any case and quotes, character references, no comments, no blank or missing targets."""
    html = """<!-- <a href="no"> --><A class=x HREF='/one'>1</A><a href=two>2</a><a href="/q?a=1&amp;b=2">3</a><a name=n>4</a><a href=" ">5</a><script>'<a href="s">'</script><a
    href="/six ">6</a>"""
    assert one(spark, urls.anchors(F.col("h")), h=("string", html)) == ["/one", "two", "/q?a=1&b=2", "/six"]
    assert one(spark, urls.anchors(F.col("h")), h=("string", None)) == []
    assert one(spark, urls.resolved(F.col("b"), F.col("l")), b=("string", "https://x.example/a/b"), l=("string", "../c")) == "https://x.example/c"


def test_reader_page(spark):
    t = "[Home](x)\nnav\n# Title\n![Image 1](blob:http://q)\ntext\n\n\n\nmore\n隐私政策\nafter"
    assert one(spark, markdown.clean_reader_page(F.col("t")), t=("string", t)) == "# Title\ntext\n\nmore"
    title, body = markdown.reader_fields(F.col("t"))
    assert one(spark, title, t=("string", "Title: T\n\nMarkdown Content:\nb")) == "T"
    assert one(spark, body, t=("string", "Title: T\n\nMarkdown Content:\nb")) == "b"


def test_docids(spark):
    a = lambda i, t, d=None: one(spark, tx.content_docid(F.col("d"), F.lit("u"), F.col("i"), F.col("t")), d=("string", d), i=("int", i), t=("string", t))
    assert a(0, "x  y") == a(0, "x y") != a(0, "x z")
    assert a(0, "x", "given") == "given"


def test_text(spark):
    s = lambda c, v: one(spark, c, t=("string", v))
    t = F.col("t")
    assert s(tx.slugify(t), " A b/C!! ") == "a-b-c" and s(tx.slugify(t), "！") == "index"
    assert s(tx.query_key(t), "Wie, 如何 X？") == "wie如何x"
    assert s(tx.normalize_query(t), " a \n b？？") == "a b？"
    assert s(tx.repair_mojibake(t), "你好".encode().decode("gbk", "ignore")) in ("你好", "浣犲ソ")
    assert s(tx.repair_mojibake(t), "plain é") == "plain é"
    assert s(tx.json_object(t), '```json\n{"a": 1}\n```') == '{"a": 1}' and s(tx.json_object(t), "x {a") is None and s(tx.json_object(t), "[1]") is None
    assert s(tx.safe_double(t), "x") == 0.0 and s(tx.safe_double(t), "1.5") == 1.5
    assert s(tx.clean_message(t), "a<div class='inline-feedback'>\nx</div>b") == "ab"
    assert s(tx.fallback_caption(t), "") == "文档配图，建议结合上下文理解。"
    assert one(spark, tx.text_similarity(F.col("a"), F.col("b")), a=("string", "abc"), b=("string", "abc")) == 1.0
    assert one(spark, tx.reference_overlap(F.col("a"), F.col("b")), a=("string", "x y"), b=("string", "y z y")) == 0.5
    assert s(tx.normalize_title(t, F.lit("https://a.example/b/my-page/")), "概览") == "my page"
    assert s(tx.is_weak_question(t), "它主要介绍了什么？")
    parts = F.array(F.struct(F.lit("text").alias("type"), F.lit(" a  b ").alias("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text")))
    assert one(spark, tx.caption_text(parts)) == "a b"


def test_only_targets_and_runs_go_to_python(spark):
    """What Python is given of a text are its image targets, or its runs beyond ASCII; the whole text stays with Spark."""
    df = spark.createDataFrame([(1, "word " * 400 + "![a](b.png) é")], "id long, t string")
    for c in (markdown.absolute_images(F.col("t"), F.lit(None).cast("string"), F.lit("https://x/d/")), tx.repair_mojibake(F.col("t"))):
        plan = df.select(c.alias("c"))._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in plan.splitlines() if "EvalPython" in line]
        assert len(sent) == 1 and re.search(r"EvalPython \[\w+\(regexp_extract_all\(t#\d+, ", sent[0]) and sent[0].count("pythonUDF") == 1, plan


def test_images_and_mojibake_on_odd_texts(spark):
    from urllib.parse import urljoin

    def repaired(t):
        try:
            return t.encode("gbk").decode("utf-8")
        except UnicodeError:
            return t

    def absolute(t, base):
        return markdown.IMAGE.sub(lambda m: m[0] if m[2].strip().startswith(("http://", "https://", "data:")) else f"![{m[1]}]({urljoin(base, m[2].strip()) if base else m[2].strip()})", t)

    texts = ["", "plain", "浣犲ソ and 浣犲ソ", "浣犲ソ ñ", "浣犲ソ é", "浣一a犲ソ", "ü浣犲ソ€", "![](a)![b](http://z/ )![c]( d e )", "x![a\nb](../q.png)y ![n](data:1)", "![a](b", "![]()", "🙂![i](/r)🙂浣犲ソ"]
    df = spark.createDataFrame([(k, t, b) for k, t in enumerate([*texts, None]) for b in (None, "", "https://h/d/p")], "k long, t string, b string")
    got = df.select("t", "b", tx.repair_mojibake(F.col("t")).alias("m"), markdown.absolute_images(F.col("t"), F.col("b"), F.lit(None).cast("string")).alias("a")).collect()
    for r in got:
        assert (r["m"], r["a"]) == ((None, None) if r["t"] is None else (repaired(r["t"]), absolute(r["t"], r["b"]))), r


def test_pages_are_parsed_one_at_a_time(spark):
    df = spark.createDataFrame([("<main>x</main>",)], "t string").select(markdown.rendered(F.col("t")).alias("m"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"EvalPython \[run\(t#\d+\).*, 250\n", plan), plan  # Arrow arrays, not a pandas series of all pages of a batch
    assert df.first()["m"] == "x"
