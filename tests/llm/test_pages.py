"""Main text of pages against a truth written by hand: what the style tree saves and what it sinks."""

import pytest

from idlattice.llm import html_pages


def texts(spark, rows):
    return {r.page_id: r.text for r in html_pages.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_stories_outside_an_article_stay(spark):
    rows = [(1, "http://a.example/", "<div class=post><p>The whole story.</p></div><article>Teaser</article>"), (2, "http://b.example/", "<article><p>It began.</p></article><p>The rest of the story.</p>")]
    assert texts(spark, rows) == {1: "The whole story.\n\nTeaser", 2: "It began.\n\nThe rest of the story."}


@pytest.mark.parametrize("frame", ["<article><div class=menu>story {0}</div></article>", "<main><div class=widget><p>story {0}</p></div></main>", "<article></article><div class='with-ads'>story {0}</div>"])
def test_entropy_saves_what_names_speak_against(spark, frame):
    """Thirty pages whose only story stands in or beside an article, in an element named like furniture, with furniture that repeats."""
    shell = "<nav>home about</nav><div class=box>about us</div>" + frame + "<footer>all rights</footer>"
    out = texts(spark, [(k, "http://host.example/", shell.format(k)) for k in range(30)])
    assert out == {k: f"story {k}" for k in range(30)}


def test_entropy_sinks_what_nothing_speaks_against(spark):
    frame = "<div class=lead><p>words of every page</p></div><div class=text><p>story {0}</p></div><p class=last>more words of every page</p>"
    out = texts(spark, [(k, "http://host.example/", frame.format(k)) for k in range(30)])
    assert out == {k: f"story {k}" for k in range(30)}


def test_hand_made_hosts(spark):
    """Ten hosts of three kinds with three pages each; ids are made up by the page."""
    rows, want = [], {}
    for h in range(10):
        for k in range(3):
            page = 10 * h + k
            story = [f"Title {page}", f"first {page}", f"second {page}"]
            body = "".join(f"<p>{x}</p>" for x in story[1:])
            frame = (
                "<header>site</header><nav>menu</nav><article id=a{n}><h1>{t}</h1>{b}</article><aside>related</aside><footer>f</footer>",
                "<div class=navbar id=n{n}>menu</div><div class=story id=s{n}><h1>{t}</h1>{b}</div><div class='ad' id=ad-{n}>buy</div><div class=comments><p>nice</p></div>",
                "<main><h1>{t}</h1>{b}<form>name</form><div class=share>share this</div></main><div class=cookie-notice>we use them</div>",
            )[h % 3]
            rows.append((page, f"https://host{h}.example/{page}", frame.format(t=story[0], b=body, n="xyzuvw"[k] * 5)))
            want[page] = "\n\n".join(story)
    assert texts(spark, rows) == want


def test_entropy_sinks_what_names_speak_against(spark):
    frame = "<article><p>story {0}</p><div class=menu>every page</div></article><p class=after>every page has this</p>"
    assert texts(spark, [(k, "http://host.example/", frame.format(k)) for k in range(30)]) == {k: f"story {k}" for k in range(30)}
    assert html_pages.FURNITURE < html_pages.LOWEST < min(html_pages.INNER, html_pages.OUTSIDE, html_pages.HINT)


def test_made_up_ids_add_no_places(spark):
    rows = [(k, "http://host.example/", f"<div id=slot-{chr(97 + k % 26)}{chr(97 + k // 26)}zz class=ad>buy this</div><p>story {k}</p>") for k in range(200)]
    low = html_pages.low_places(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [len(r.low) for r in low] == [1]
