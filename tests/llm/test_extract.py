import re
from html import unescape

from pyspark.sql import functions as F

from farepanel.llm import extract

PARA = "The house on the hill was built in the spring of that year, and the people who lived in it had come from the coast with all that they owned."
OTHER = "It was not until the end of the war that the road to the village was opened again, and with it came the first of the new settlers from the north."


def test_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no</p>";</script></head>
    <body class="page"><header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <div class="ad">{OTHER}</div><article><header><h1>A &amp; B</h1></header><p>{PARA}<p>Short.
    <p>With <b>bold&nbsp;text</b>, <a href="x">a link</a><br>and more.</p><aside>{OTHER}</aside><form><input value="x">Send</form></article>
    <div id="sidebar">{OTHER}</div><section class="comments"><article><p>{OTHER}</p></article></section><footer>&copy; x</footer></body></html>"""
    assert extract.main_text(page) == f"A & B\n{PARA}\nShort.\nWith bold text, a link and more."


def test_density_decides_without_an_article():
    page = f"""<body><div>Home</div><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li></ul>
    <div id=content><h1>Title</h1><div>{PARA}</div><div>Brief note.</div><div>{OTHER}</div></div>
    <ul><li><a href=4>Imprint</a></li><li><a href=5>Jobs</a></li></ul><div>Version 7</div></body>"""
    assert extract.main_text(page) == f"Title\n{PARA}\nBrief note.\n{OTHER}"


def test_languages_without_stop_words():
    texts = {
        "ru": "Дом на холме построили весной того года, и люди, которые жили там, пришли с побережья со всем своим имуществом, чтобы начать новую жизнь вдали от моря.",
        "el": "Το σπίτι πάνω στον λόφο χτίστηκε την άνοιξη εκείνης της χρονιάς και οι άνθρωποι που ζούσαν εκεί είχαν έρθει από την ακτή με όλα τα υπάρχοντά τους.",
        "fi": "Mäellä oleva talo rakennettiin sinä keväänä, ja siellä asuneet ihmiset olivat tulleet rannikolta kaiken omaisuutensa kanssa aloittaakseen uuden elämän.",
        "zh": "山上的房子是那年春天建成的,住在里面的人带着他们所有的家当从海边来到这里,希望在远离大海的地方开始新的生活,并把孩子抚养成人。",
    }
    menu = "<ul><li><a href=1>1</a></li><li><a href=2>2</a></li></ul>"
    for text in texts.values():
        assert extract.main_text(f"<body><div><div>{text}</div><div>{text}!</div></div></body>") == f"{text}\n{text}!"
        assert extract.main_text(f"<body>{menu}<div>{text}</div><div>{text}!</div>{menu}</body>") == f"{text}\n{text}!"


def test_stop_words_break_ties():
    half = " ".join(["<a href=1>Shoes Boots</a> Sandals Slippers Trainers"] * 6)
    assert extract.main_text(f"<div>{PARA}</div><div>{OTHER}</div><div>{half}</div>") == f"{PARA}\n{OTHER}"
    russian = "Дом на холме построили весной того года, и люди пришли туда с побережья. "
    linked = (russian * 4).replace("весной того года", "<a href=1>весной того года</a>")
    assert len(extract.main_text(f"<div>{russian * 3}</div><div>{linked}</div>").split("\n")) == 2


def test_marks_on_containers_of_the_text():
    assert extract.main_text(f'<div class="site has-sidebar"><article><p>{PARA}</p></article><div class="sidebar">{OTHER}</div></div>') == PARA
    assert extract.main_text(f'<form id="aspnetForm"><div class="header">Site</div><div>{PARA}</div><div>{OTHER}</div></form>') == f"{PARA}\n{OTHER}"
    assert extract.main_text(f'<div class="widget share"><div>{PARA}</div><div>{OTHER}</div></div><div>Short</div>').startswith(f"{PARA}\n{OTHER}")
    assert extract.main_text(f'<article><header class="entry-header"><h1>Title</h1></header><p>{PARA}</p></article>') == f"Title\n{PARA}"
    assert extract.main_text(f'<article class="adventure"><p>{PARA}</p></article>') == PARA


def test_weak_marks_decide_block_by_block():
    page = f'<article><p>{PARA}</p><section class="related-work"><p>{OTHER * 4}</p><p><a href=1>{OTHER}</a></p></section><div class="share">{OTHER}</div></article>'
    assert extract.main_text(page) == f"{PARA}\n{OTHER * 4}"
    page = f'<article><p>{PARA}</p></article><section class="comments"><article><p>{OTHER * 9}</p></article></section>'
    assert extract.main_text(page) == PARA


def test_teaser_article_and_body_in_divs():
    page = f"<article><h2>Teaser</h2><p>Read on.</p></article><div><div>{PARA}</div><div>{OTHER}</div></div>"
    assert f"{PARA}\n{OTHER}" in extract.main_text(page)
    page = f"<main><div>{PARA * 3}</div><div>{OTHER * 3}</div><article><p>{PARA}</p></article></main><div>{OTHER}</div>"
    assert extract.main_text(page) == f"{PARA * 3}\n{OTHER * 3}\n{PARA}"
    assert extract.main_text(f"<article><p>{PARA}</p></article><div>{OTHER * 4}</div>").startswith(PARA)


def test_links_decide_inside_an_article():
    linked = f"<p><a href=1>{OTHER}</a> more</p>"
    page = f"<article><h1><a href=0>Title</a></h1><p>{PARA}</p>{linked}<p><a href=2>Read more</a></p></article>"
    assert extract.main_text(page) == f"Title\n{PARA}"


def test_main_and_roles():
    page = f'<main><div role="complementary">{OTHER}</div><p>{PARA}</p><div style="display: none">{OTHER}</div><div hidden>x</div></main><p>{OTHER}</p>'
    assert extract.main_text(page) == PARA


def test_names_are_whole_words():
    page = f'<article><div class="headline download-page">{PARA}</div><div class="postComments">{OTHER}</div><div class="address">{OTHER}</div></article>'
    assert extract.main_text(page) == f"{PARA}\n{OTHER}"


def test_broken_markup():
    assert extract.main_text(f"<article><p>{PARA}") == PARA
    assert extract.main_text(f"<article><p title='a > b'>{PARA}</p><script>never closed <p>x") == PARA
    assert extract.main_text(f"<article><p>{PARA}</p><!-- open <p>x</p>") == PARA
    assert extract.main_text(f"<article><p>1 < 2 and 3 > 2</p><p>{PARA}</p></article>") == f"1 < 2 and 3 > 2\n{PARA}"
    assert extract.main_text("<article></div></p></article>") == ""


def test_long_page_and_quotes():
    assert extract.main_text("<article>" + f"<p>{PARA}</p>" * 3000 + "</article>") == "\n".join([PARA] * 3000)
    assert len(extract.main_text("<article>" + '<a "x ' * 3000)) == 0


def test_table(spark):
    rows = [(1, "u", f"<article><p>{PARA}</p></article>"), (2, None, None), (3, "u", ""), (1, "u", f"<article><p>{PARA}</p></article>"), (None, "w", "plain words")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "__x": F.lit(1)})
    got = extract.extract(df).collect()
    assert sorted((str(r.page_id), r.text) for r in got) == [("1", PARA), ("1", PARA), ("2", ""), ("3", ""), ("None", "")]
    assert extract.extract(df.limit(0)).collect() == []


def test_query_against_article_by_pattern(spark):
    from farepanel.llm import queries

    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
