"""Pages labelled by hand: the training set of the page text model.

Each page is one common layout, written out, with ``data-k`` on every element whose own text is the
article's. ``$t``, ``$h``, ``$s``, ``$p`` and ``$w`` stand for a title, a heading, a sentence, a paragraph
and a word; ``$n`` for some list items that are links; ``{a|b}`` for one of its parts (they don't nest);
``[[..]]`` for what may be missing and ``((..))`` for what stands one to six times. A page that begins
with text has it in a marked body.
"""

from __future__ import annotations

import random
import re

_NAV = '<nav{| class="main-nav"| id="navigation"| class="menu"}><ul>$n</ul></nav>'
_TOP = "<header{| class=site-header| id=masthead| class=banner}><a href=/>$w</a> $s " + _NAV + "</header>"
_END = "<footer{| class=site-footer| id=footer| class=bottom}>{<p>&copy; $w $s</p><ul>$n</ul>|&copy; $w $s|<p>$p</p>}</footer>"
_AD = '<div {class|id}="{ad|ads|ad-slot|advert|advertisement|sponsored|promo|promotion|banner-ad}">{$s|<p>$p</p>|$p|<a href=/x>$w $w</a>}</div>'
_NOTICE = '<div {class|id}="{cookie-notice|cookie-banner|consent|gdpr|notice|alert|popup|modal|overlay}">{$s|<p>$p</p>|$p}[[<button>$w</button>]]</div>'
_SIDE = "<aside{| class=sidebar| id=sidebar}>[[<h3>$w</h3>]]{<p>$p</p>|$s}[[<ul>$n</ul>]]</aside>"
_PARTS = '<div {class|id}="{sidebar|widget|widget-area|related|related-posts|recommended|more|share|social|tags|breadcrumbs|breadcrumb|pagination|toolbar|newsletter|subscribe|login|search|follow|meta|byline|copyright|toc|legal}">{<h3>$w</h3><ul>$n</ul>|$s|<p>$p</p>|<h3>$w</h3><p>$p</p><p>$p</p>|<ul>$n</ul>|<p>$s</p><div>$p</div>}</div>'
_FORM = "<form><p>$s</p><label>$w</label><input name=q><button>$w</button></form>"
_TALK = (
    '<div {class|id}="{comments|comment-area|comments-section|responses|replies|discussion|disqus_thread}">[[<h3>$w $w</h3>]](({<p>$p</p>|<div class="comment">$p</div>|<div class=reply><b>$w</b><p>$s</p></div>}))</div>',
    '<section {class|id}="{comments|responses|discussion}"><h2>$w</h2><ol class="comment-list">((<li class="comment"><article class="comment-body"><p>$p</p></article></li>))</ol></section>',
    '<ol class="{comment-list|commentlist|comments|replies}">((<li{| class=comment}>{<p>$p</p>|$s|<div class=comment-content><p>$p</p></div>}</li>))</ol>',
    '<ul {class|id}="{comments|comment-list}">((<li>$p</li>))</ul>',
)
_TEXT = "(({<p data-k>$p</p>|<p data-k>$p</p>|<p data-k>$p|<p data-k>$s</p>|<p data-k>$w.</p>|<p data-k>$h</p>}))"
_MORE = "[[<h2 data-k>$h</h2>]]" + _TEXT + "[[<ul>((<li data-k>{$s|$h}</li>))</ul>]][[<blockquote><p data-k>$p</p></blockquote>]]" + _TEXT
_LIST = "{<ul>((<li data-k>$s</li>))</ul>|<ol>((<li data-k>$s</li>))</ol>|<ul>((<li data-k>$h</li>))</ul>|<ol>((<li data-k>$p</li>))</ol>}"
_RICH = _TEXT + "[[" + _LIST + "]]{<blockquote data-k>$p</blockquote>|<div data-k>$p</div>|<div class=para data-k>$p</div><div class=para data-k>$p</div>|<div class=line data-k>$s</div>|<pre data-k>$s</pre>|<ol>((<li data-k>$s</li>))</ol>|<table><tr><th data-k>$w</th><td data-k>$h</td></tr><tr><td data-k>$w</td><td data-k>$s</td></tr></table>|<figure><img src=a><figcaption data-k>$s</figcaption></figure>|<dl><dt data-k>$w</dt><dd data-k>$s</dd></dl>|<h3 data-k>$h</h3><p data-k>$p</p>}" + _TEXT

PAGES = (
    # nothing but text
    *("<p data-k>{$p|$p|$s|$h}</p>",) * 8,
    *("{$p|$s|$p<br>$p|<b>$h</b> $p|$h}",) * 6,
    "$s<p data-k>$p</p>$p",
    *(_TEXT,) * 4,
    *("<h1 data-k>$t</h1>" + _TEXT,) * 2,
    "<h1 data-k>$t</h1>" + _MORE,
    "<h2 data-k>$t</h2>" + _RICH,
    *("<div>{<p data-k>$p</p>|<p data-k>$p</p><p data-k>$s</p>}</div>", "<div data-k>{$p|$s|$h}</div>") * 2,
    # plain wrappers without names, or with names that say nothing
    "<div>" + _TEXT + "</div>",
    '<div class="{x1|c-a|row|col|inner|wrap|box|q}"><div class="{y2|col-md|outer|k}"><h1 data-k>$t</h1>' + _MORE + "</div></div>",
    _NAV + "<div><h1 data-k>$t</h1>" + _RICH + "</div>" + _END,
    "<table><tr><td><a href=/a>$w</a> <a href=/b>$w</a></td><td><h1 data-k>$t</h1>" + _TEXT + "</td></tr></table>[[<center>$s</center>]]",
    # the elements' own meaning
    _NAV + "[[" + _AD + "]]<article>[[<h1 data-k>$t</h1>]]" + _MORE + "</article>" + _END,
    _TOP + "<main><h1 data-k>$t</h1>" + _RICH + "</main>" + _SIDE + _END,
    _TOP + "<main><article><h1 data-k>$t</h1>" + _TEXT + _AD + _TEXT + "</article>[[" + _SIDE + "]]</main>" + _END,
    "[[" + _NOTICE + "]]" + _TOP + "<section><h1 data-k>$t</h1>" + _MORE + "</section>" + _FORM + _END,
    _TOP + "<article><header><h1 data-k>$t</h1><p class={byline|meta|author}>$w $w</p></header>" + _RICH + _PARTS + "</article>" + _END,
    # what blogs and newspapers make of it
    _NOTICE + '<div id="{page|wrapper|container|layout|site}">' + _TOP + '<div id="{content|primary|main}"><main><article class="{post|hentry|entry}"><header class=entry-header><h1 data-k class=entry-title>$t</h1><div class=entry-meta>$w $w</div></header><div class="{entry-content|post-content|content}">' + _MORE + "</div><footer class=entry-footer>$w <a href=/t>$w</a></footer></article></main></div>" + _PARTS + _END + "</div>",
    _TOP + _PARTS + '<div class="{article|article-body|story|story-body|text|prose|post|body-copy|single|page}"><h1 data-k>$t</h1>' + _TEXT + "[[" + _AD + "]]" + _RICH + "</div>" + _PARTS + _FORM + _END,
    '<div id="{main|content|text}">' + _MORE + "</div><div class=side>" + _PARTS + "</div>" + _END,
    _NAV + '<div class="{container|layout|main-container}"><div class="{sidebar|menu|toc}"><ul>$n</ul></div><div class="{markdown-body|document|content}"><h1 data-k>$t</h1>' + _RICH + "<h2 data-k>$h</h2>" + _RICH + "</div></div>" + _END,
    '<div id=header>$w $s</div><div id=nav><ul>$n</ul></div><div id="{content|bodyContent}"><h1 data-k>$t</h1>' + _RICH + _PARTS + "</div><div id=footer>$s <a href=/>$w</a></div>",
    "[[" + _NOTICE + "]]" + _NAV + _AD + _AD + '<div class="{article|content|post}">' + _TEXT + "</div>" + _PARTS + _PARTS + _END,
    "<dialog>$p</dialog><menu>$n</menu>" + _TOP + "<main><div>" + _RICH + "</div></main>" + _SIDE + _SIDE + _END,
    # what readers add, after the article or within it
    *(_TOP + "<article><h1 data-k>$t</h1>" + _MORE + "</article>" + talk + _END for talk in _TALK),
    *("<article>[[<h1 data-k>$t</h1>]]" + _TEXT + talk + "</article>" for talk in _TALK),
    *('<article><h1 data-k>$t</h1><div class="{inner|x7|wrap|col}">' + _RICH + "</div>" + talk + "[[" + _PARTS + "]]</article>" + _END for talk in _TALK),
    *("[[" + _NAV + "]]<h1 data-k>$t</h1>" + _TEXT + talk for talk in _TALK),
    *('<div class="{post|entry|content}">' + _TEXT + "</div>" + talk + _SIDE for talk in _TALK),
)

_SYLLABLES = "ka lo mi ner tas vu rel on esh dra pi qua sto ber".split()
_CHOICE, _MAYBE, _OFTEN, _MARK = re.compile(r"\{([^{}]*)\}"), re.compile(r"\[\[((?:(?!\[\[|\]\]).)*)\]\]"), re.compile(r"\(\(((?:(?!\(\(|\)\)).)*)\)\)"), re.compile(r"\$([thspwn])")


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))


def _sentence(rng: random.Random, least: int = 3, most: int = 14) -> str:
    return " ".join(_word(rng) for _ in range(rng.randint(least, most))).capitalize() + rng.choice(". . . . ! ?".split())


def _filled(kind: str, rng: random.Random) -> str:
    if kind == "w":
        return _word(rng)
    if kind == "n":
        return "".join(f'<li><a href="/{_word(rng)}">{_word(rng)}</a></li>' for _ in range(rng.randint(2, 7)))
    if kind == "p":
        return " ".join(_sentence(rng) for _ in range(rng.choice((1, 1, 2, 3, 4, 6))))
    text = _sentence(rng, 1, 10) if kind in "th" else _sentence(rng, 2, 12)
    return text[:-1] if kind in "th" and rng.random() < 0.7 else text


def written(page: str, rng: random.Random) -> str:
    """One page of a layout: its choices made, its texts filled in; ``data-k`` still marks the article's."""
    while (m := _MAYBE.search(page)) is not None:
        page = page[: m.start()] + (m[1] if rng.random() < 0.5 else "") + page[m.end() :]
    while (m := _OFTEN.search(page)) is not None:
        page = page[: m.start()] + m[1] * rng.randint(1, 6) + page[m.end() :]
    page = _CHOICE.sub(lambda m: rng.choice(m[1].split("|")), page)
    page = _MARK.sub(lambda m: _filled(m[1], rng), page)
    marked = "" if page.startswith("<") and not page.startswith("<b>") else " data-k"
    head = f"<head><title>{_sentence(rng)}</title></head>" if rng.random() < 0.7 else ""
    return f"<!DOCTYPE html><html>{head}<body{marked}>{page}</body></html>" if marked or rng.random() < 0.8 else page


def labelled(times: int = 10, seed: int = 11, layouts: tuple[str, ...] = PAGES) -> list[str]:
    """Every layout ``times`` times, each time with other choices and texts."""
    rng = random.Random(seed)
    return [written(page, rng) for _ in range(times) for page in layouts]
