"""Pages with an article are differenced like all others: shared lines outside it go, lines of their own stay."""
from turfline.llm import pages

MENU = "<div>Home</div><div>Latest</div>"


def extracted(spark, rows):
    return {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_lines_outside_the_article_are_differenced(spark):
    rows = [(1, "http://a.org/x/1", f"{MENU}<p>Lead one</p><article><p>Story one</p><p>Same end</p></article><div>Imprint</div>"),
            (2, "http://a.org/x/2", f"{MENU}<article><p>Story two</p><p>Same end</p></article><p>Written by two</p><div>Imprint</div>"),
            (3, "http://b.org/1", f"{MENU}<p>Lead three</p><article><p>Story three</p></article>"),
            (4, None, f"{MENU}<main><p>Story four</p></main>"), (5, "http://c.org/1", f"{MENU}<main><p>Main five</p></main>"),
            (6, "http://c.org/2", f"{MENU}<p>Own six</p>")]
    assert extracted(spark, rows) == {1: "Lead one\n\nStory one\n\nSame end", 2: "Story two\n\nSame end\n\nWritten by two", 3: "Story three",
                                      4: "Story four", 5: "Main five", 6: "Own six"}


def test_cards_of_other_stories_do_not_hide_the_page(spark):
    """Each teaser is an article element of its own; the story itself is not in one."""
    card = "<article><p>Card {}</p></article>"
    rows = [(i, f"http://a.org/{i}", f"{MENU}<div>Story {i}</div>" + card.format(i)) for i in (1, 2)]
    assert extracted(spark, rows) == {i: f"Story {i}\n\nCard {i}" for i in (1, 2)}
