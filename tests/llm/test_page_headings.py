"""Headings that pages of a host share, and articles that are comments."""

from plumbline.llm import pages


def texts(spark, sources):
    rows = [(i, f"https://one.example/{i}", s) for i, s in enumerate(sources)]
    return {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_shared_headings_stay_with_their_sections(spark):
    recipe = lambda i: f"<article><h1>Cake {i}</h1><h2>Ingredients</h2><p>Flour {i} and more</p><h2>Method</h2><p>Bake it {i} hours</p><h2>About</h2><p>All rights of this text are kept by us.</p></article>"
    got = texts(spark, [recipe(i) for i in range(6)])
    for i in range(6):
        assert got[i] == f"Cake {i}\n\nIngredients\n\nFlour {i} and more\n\nMethod\n\nBake it {i} hours"


def test_comment_articles_are_no_articles():
    found = pages.blocks("<div><p>The story of a day.</p></div><article class='comment'><p>A much longer comment of a reader, who has a lot to say about it all.</p></article>")
    assert pages.main_text(found, frozenset()) == "The story of a day."
