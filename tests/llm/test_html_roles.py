"""Role names that stand around or inside the main text."""

import pytest

from stopflow.llm import html_text

LONG = "one two three four five six seven"
CASES = [
    (f"<div class='page has-sidebar'><article><p>{LONG}</p></article><div id=comments><article>no</article></div></div>", LONG),
    (f"<div id='search-results'><p>{LONG}</p></div><div class=ad>buy</div>", LONG),
    (f"<form><main><p>{LONG}</p></main><input></form>", LONG),
    (f"<form><div class=b><p>{LONG}</p></div></form><nav>{LONG * 5}</nav>", LONG),
    ("<article><p>a</p><section class=notice>b</section><div class=related>c</div><p id=skip>d</p><div class=share>no</div></article>", "a\n\nb\n\nc\n\nd"),
    (f"<article><p>{LONG}</p></article><div class=comments><article>no</article></div>", LONG),
    (f"<p>{LONG} <span class=ad>no no</span> end</p>", f"{LONG} end"),
]


@pytest.mark.parametrize("body,text", CASES)
def test_roles_do_not_hide_the_main_text(body, text):
    got = html_text.main_text(f"<html><body>{body}<footer>f</footer></body></html>", frozenset())
    assert got == text
