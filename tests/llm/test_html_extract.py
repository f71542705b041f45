import random

import pytest

from gridloom.llm import html_extract as H

P1 = "The first paragraph of the article, which is long enough, has commas, and says something about gardens in winter."
P2 = "A second one follows, again with commas, words and a <a href='/x'>short link</a>, so that it counts as prose &amp; more."
HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
NAV = "<nav><ul><li><a href='/a'>Home, page</a></li><li><a href='/b'>News</a></li></ul></nav><div class='ad'>Buy, buy, buy this now, cheap.</div>"
FOOT = "<footer>&copy; 2020 someone, somewhere</footer></body></html>"


def text(page):
    return "\n".join(H.main_blocks(page))


def test_article_only():
    page = f"{HEAD}{NAV}<article><h1>Head line</h1><p>{P1}</p>\n <p>{P2}</p></article>{FOOT}"
    assert text(page) == f"Head line\n{P1}\n" + P2.replace("<a href='/x'>", "").replace("</a>", "").replace("&amp;", "&")


@pytest.mark.parametrize("wrap", ["<div id='content'>%s</div>", "<div class='post-body'><div>%s</div></div>", "<main>%s</main>", "<section>%s</section>", "%s"])
def test_containers_without_article(wrap):
    body = f"<p>{P1}</p><p>{P1[4:]}</p><p>Short end.</p>"
    page = f"{HEAD}<header><a href='/'>Site, name</a></header>{NAV}{wrap % body}<aside>Related, things, to read, here</aside><div id='comments'><p>I, for one, liked this article very much, thanks.</p></div><form><p>Sign up, now, please</p></form>{FOOT}"
    assert text(page) == f"{P1}\n{P1[4:]}\nShort end."


def test_siblings_of_the_best_container():
    page = f"{HEAD}<div><div class='part'><p>{P1}</p><p>{P1}</p></div><p>{P1[2:]}</p><ul><li><a href='/q'>a link, only</a></li></ul></div>{FOOT}"
    assert text(page).split("\n") == [P1, P1, P1[2:]]


def test_broken_markup():
    assert text(f"<body><article><p><b>{P1}<br><p>Next, one.") == f"{P1}\nNext, one."
    assert text(f"<article><p>{P1}</p><!-- <p>no</p> --><script>x('<p>no</p>')</script><p>1 < 2 &lt; 3&nbsp;&#233;</p></article>") == f"{P1}\n1 < 2 < 3 é"
    assert text(f"<article><ul><li>one, two<li>three</ul><p>{P1}</article><p") == f"one, two\nthree\n{P1}"
    deep = "<div>" * 3000 + f"<p>{P1}</p>" + "</div>" * 3000
    assert text(deep) == P1


def test_empty():
    assert [text(x) for x in (None, "", "   ", "<html></html>", "<script>a</script>")] == [""] * 5
    assert text("just words, no tags") == "just words, no tags"


def test_rows(spark):
    rng = random.Random(1)
    long = "<article>" + "".join(f"<p>{P1} {rng.random()}</p>" for _ in range(5000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (3, "v", f"<article><p>{P1}</p></article>", None), (3, "v", f"<article><p>{P1}</p></article>", None), (None, "w", long, "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars == len(r.text), r.text[:20]) for r in got) == sorted([("1", True, ""), ("2", True, ""), ("3", True, P1[:20]), ("3", True, P1[:20]), ("None", True, P1[:20])])
    assert max(r.n_chars for r in got) > 500_000
    assert H.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ("<div title='A hidden gem'>Real article text, with commas, and length.</div>", ["Real article text, with commas, and length."]),
    ("<div data-role='banner' data-id=\"nav\" data-class=menu><p>Real article text, with commas.</p></div>", ["Real article text, with commas."]),
    ("<div class=a hidden><p>Gone, of course.</p></div><div><p>Kept, of course, it is.</p></div>", ["Kept, of course, it is."]),
    ("<article><p class='notice'>Advert<p>First real paragraph, long enough.<p>Second one.</article>", ["First real paragraph, long enough.", "Second one."]),
    ("<article><div class='promo'>Buy<p>now</article><p>", []),
    ("<ul><li class=ad>x<ul><li>y</ul><li>Real item text, long enough, yes</ul>", ["Real item text, long enough, yes"]),
    ("<article><p>Body text, long and good, with commas.</p><ul><li><a href=x>Source one</a></li><li><a href=y>Source two</a></li></ul></article>", ["Body text, long and good, with commas.", "Source one", "Source two"]),
])
def test_markup_that_swallowed_articles(page, want):
    assert H.main_blocks(page) == want


def test_planted_articles_come_back_exactly():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: ", ".join(" ".join(word() for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."
    for i in range(60):
        paras = [" ".join(sentence(rng.randint(1, 3)) for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(3, 7))]
        shown = [p.replace(" ", rng.choice([" ", "\n  "]), 3) for p in paras]
        tag = rng.choice(["article", "main", "div class='post-content'"])
        body = "".join(f"<p title='see the hidden menu'>{p}{rng.choice(['</p>', ''])}" for p in shown)
        menu = "<ul>" + "".join(f"<li><a href='/{k}'>{word()}</a></li>" for k in range(6)) + "</ul>"
        note = rng.choice(["", "<p class='notice'>We use cookies", "<aside><p>Subscribe to our letter</aside>", "<div class=share>Share <b>this</div>"])
        page = f"<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header>{menu}</header><nav>{menu}</nav><{tag}>{note}{body}</{tag.split()[0]}><section class='comments'><p>Nice, really nice text, I say.</p></section><footer><p>Copyright, all rights, reserved.</p></footer></body></html>"
        assert H.main_blocks(page) == paras, i
