"""Labelled pages: common page layouts with their article marked by ``data-part``.

``data-part="article"`` marks an element whose whole text belongs to the article, ``data-part="other"`` one inside it that
does not. Layouts are made from lists of wrappers and page parts, so that every part is seen in several surroundings.
"""

from __future__ import annotations

from itertools import cycle, islice

_FILLER = (
    "The river rose again during the night, and by morning the lower fields were under water. Nobody had expected it so early in the year. "
    "Farmers moved their animals to the hills, as their parents had done, and waited. By noon the first boats came through the main street."
).split(" ")
#: Elements that hold an article.
WRAPPERS = [
    "article", "main", "div class='content'", "div class='post'", "div id='article-body'", "section class='entry-content'", "div class='story text'",
    "div role='main'", "td class='main-text'", "div class='article'", "div",
]
#: Page parts that are no article text; LINKS becomes a list of links, TINY a word or three, TEXT a sentence, LONG a paragraph.
PARTS = [
    "<nav>LINKS</nav>", "<div class='menu'>LINKS</div>", "<ul id='navigation'>LINKS</ul>", "<header><div class='logo'>TEXT</div>LINKS</header>", "<div class='header'>TEXT</div>",
    "<div class='breadcrumb'>LINKS</div>", "<aside><h3>TEXT</h3>LINKS</aside>", "<div class='sidebar'><p>LONG</p>LINKS</div>", "<div id='sidebar-right'><h4>TEXT</h4><p>TEXT</p></div>",
    "<div class='ad'>TEXT</div>", "<div class='ad-banner'><p>LONG</p></div>", "<div class='advert'>TEXT</div>", "<div class='advertisement'><a href='/x'>TEXT</a></div>", "<section class='sponsored promo'><p>LONG</p></section>",
    "<div class='cookie-notice'><p>LONG</p><button>OK</button></div>", "<div id='cookie-consent'>TEXT</div>", "<div class='notice'>TEXT</div>", "<div role='alert' class='alert banner'><p>TEXT</p></div>", "<div class='popup modal'><p>LONG</p></div>",
    "<form action='/s'><label>TEXT</label><input><button>Go</button></form>", "<div class='newsletter subscribe'><p>LONG</p><form><input></form></div>", "<form class='login'><p>TEXT</p></form>", "<div class='search'><form><input></form></div>",
    "<div class='comments'><h3>TEXT</h3><div class='comment'><p>LONG</p></div><div class='comment'><p>LONG</p></div></div>", "<section id='comments'><ol><li class='comment-body'><p>LONG</p></li><li class='reply'>TEXT</li></ol></section>",
    "<ul class='discussion replies'><li>LONG</li><li>TEXT</li></ul>", "<div class='share social'>LINKS</div>", "<div class='related'><h4>TEXT</h4>LINKS</div>", "<div class='recommended more-stories'><p>LONG</p>LINKS</div>",
    "<div class='tags'>LINKS</div>", "<div class='pagination'>LINKS</div>", "<div class='widget'>TEXT</div>", "<div class='toolbar'>TINY TINY</div>", "<aside><p>TINY</p><p>TINY</p></aside>", "<footer>TEXT</footer>", "<footer><p>LONG</p>LINKS</footer>", "<div class='footer'>TEXT LINKS</div>", "<div id='copyright'>TEXT</div>",
    "<noscript>TEXT</noscript>", "<dialog><p>TEXT</p></dialog>", "<div class='disclaimer legal'>LONG</div>", "<select><option>TEXT</option><option>TEXT</option></select>",
]
#: Shapes of an article's own text.
BODIES = [
    "<h1>HEAD</h1><p>LONG</p><p>LONG</p><p>TEXT</p>", "<header><h1>HEAD</h1></header><p>TEXT</p><h2>HEAD</h2><p>LONG</p><ul><li>TEXT</li><li>LONG</li></ul>", "<h1>HEAD</h1><div>LONG</div><div>TEXT</div><blockquote><p>LONG</p></blockquote>",
    "<h2>HEAD</h2><section><p>LONG</p><p>TEXT</p></section><section><h3>HEAD</h3><p>LONG</p></section>", "LONG<br><br>LONG", "<h1>HEAD</h1><p>TEXT</p>", "<p>LONG</p><pre>LONG</pre><table><tr><td>TEXT</td><td>TEXT</td></tr></table><p>TEXT</p>",
    "<h1>HEAD</h1><p>LONG</p>" + "<p>TINY</p>" * 14, "<h1>TINY</h1><p>TINY</p><p>TEXT</p><p>TINY</p><p>TINY</p>", "<h1>HEAD</h1>" + "<p>TEXT</p><p>TINY</p>" * 9,
    "<h1>HEAD</h1><figure><img src='x'><figcaption>TEXT</figcaption></figure><p>LONG</p><p>HEAD</p><p>LONG</p>",
]


def seed_pages(pages: int = 160) -> list[str]:
    """Labelled html of so many layouts."""
    at = 0

    def words(n: int) -> str:
        nonlocal at
        at += 7
        return " ".join(islice(cycle(_FILLER), at % len(_FILLER), at % len(_FILLER) + n))

    def fill(part: str) -> str:
        for name, sizes in (("LONG", (60, 35, 110, 24)), ("TEXT", (7, 12, 4, 9)), ("TINY", (2, 1, 3, 2)), ("HEAD", (6, 9, 4, 11))):
            while name in part:
                part = part.replace(name, words(sizes[at % len(sizes)]), 1)
        while "LINKS" in part:
            part = part.replace("LINKS", "<ul>" + "".join(f"<li><a href='/{k}'>{words(1 + (at + k) % 3)}</a></li>" for k in range(3 + at % 5)) + "</ul>", 1)
        return part

    out, step = [], 0
    for k in range(pages):
        wrapper, body = WRAPPERS[k % len(WRAPPERS)], BODIES[(k * 3) % len(BODIES)]
        parts = [PARTS[(step + j) % len(PARTS)] for j in range(5)]
        step += 5
        inner = fill(body)
        tag = wrapper.split(" ")[0]
        if k % 4 == 3:  # another part inside the article
            inner += fill(parts.pop()).replace(">", " data-part='other'>", 1)
            article = f"<{wrapper}><div data-part='article'>{inner}</div></{tag}>" if k % 8 == 3 else f"<{wrapper} data-part='article'>{inner}</{tag}>"
        else:
            article = f"<{wrapper} data-part='article'>{inner}</{tag}>"
        above, below = "".join(map(fill, parts[: len(parts) // 2])), "".join(map(fill, parts[len(parts) // 2 :]))
        page = above + article + below
        if k % 3 == 1:
            page = f"<div class='{('container', 'wrapper', 'page')[k % 9 // 3]}'>{page}</div>"
        out.append(f"<html><head><title>{words(5)}</title><style>p{{}}</style></head><body>{page}</body></html>")
    return out
