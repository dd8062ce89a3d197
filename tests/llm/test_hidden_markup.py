"""Content that never shows ends where its element ends, whatever it holds."""

import pytest

from gazetta.llm.html_extract import leaves


def texts(page):
    return [t for _, t, _ in leaves(page)]


@pytest.mark.parametrize(
    "hidden",
    [
        "<script>for(var i=0;i<n;i++){x()}</script>",
        "<script>if (a<b && c>d) y('</p>')</SCRIPT\n>",
        "<script>var s = '<!--';</script>",
        "<script><!-- document.write('<script>x</script>') --></script>",
        "<script><!--> a<b </script>",
        "<style>a<b{}</style>",
        "<textarea>a<b <!-- </textarea>",
        "<svg><script>i<n</script><svg></svg><text>no</text></svg>",
        "<template><!-- </template> --><p>no</p><script>'</template>'</script></template>",
        "<title>a<b</title>",
    ],
)
def test_text_after_a_hidden_element_stays(hidden):
    assert texts(f"<p>before</p>{hidden}<p>after</p>") == ["before", "after"]


def test_unclosed_hidden_elements_keep_what_came_before():
    assert texts("<p>one</p>two<script>x<p>no</p>") == ["one", "two"]
    assert texts("<div>one <style>p{}") == ["one"] and texts("<p>one<svg><p>no") == ["one"]


def test_an_end_without_a_bracket():
    assert texts("<p>a < b <c") == ["a < b <c"] and texts("<p>x<!-- y") == ["x"] and texts("<p>x<![CDATA[y<z") == ["xy<z"]


def test_quotes_that_never_end():
    assert texts('<p>a</p><p title="x>b</p><p>c</p>') == ["a", "b", "c"]
    assert texts('<p title="a>b">c</p>') == ["c"]


@pytest.mark.parametrize("unit", ["<a ", "<div>", "<div>x", "<a b=\"x>", "<script><!--<script></script>", "<!-- ", "</p><li>x", "<svg>", "<p class=", "a&#", "<![CDATA["])
def test_no_page_takes_quadratic_time(unit):
    import time

    began = time.time()
    leaves(unit * (120_000 // len(unit)))
    assert time.time() - began < 1.5


def test_deep_nests_keep_their_text():
    got = leaves("<div>" * 500 + "deep" + "</div>" * 499 + "<p>out")
    assert [t for _, t, _ in got] == ["deep", "out"] and len(got[0][0]) == 32
