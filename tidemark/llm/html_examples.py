"""The small labelled table of the HTML extractor: pages whose main blocks carry ``data-main``.

The pages combine every body below with places before, inside and after it by a fixed rule, so
that neither a place on the page, nor a length, nor a class name alone tells main text.
"""

_S = (
    "The harbour authority said on Monday that the northern quay will stay closed until the survey of the seabed is finished, which may take another three weeks.",
    "Two ferries were moved to the older pier, and passengers were asked to arrive forty minutes before departure because the road there has a single lane.",
    "Knead the dough for ten minutes, cover it with a damp cloth and let it rest in a warm corner of the kitchen until it has doubled.",
    "The second edition adds a chapter on bridges.", "He left.", "Nobody was hurt, the police said on the same evening.", "So far.",
    "When the old mill stopped working in 1931, the village lost its only employer, and within ten years half of the houses along the river stood empty.",
    "Open the valve slowly and wait until the needle rests between the two red marks before you start the pump.", "She stayed.", "It was worth it.",
    "Between the two wars the museum bought nearly four hundred paintings, most of them from families that had to sell, and it has never published a full list.",
    "Our measurements disagree with the older ones by about two percent, which is more than the error of either instrument and still unexplained.",
    "Rain is expected in the west.", "The train was late again.", "Not yet.", "A reader from the north sent us this recipe after the long winter, and we have cooked it three times since.",
)
_N = (
    "Save forty percent on walking boots this week only, with free returns and delivery to every island in the region.", "Buy now", "All rights reserved, 12 Pier Street.",
    "I live there and every word of it is true, my neighbours say the same and so does the man from the shop.", "Thanks!", "We use cookies to improve this site and to show adverts that may interest you, as our policy explains.",
    "Get our letter every morning before breakfast, without charge and without adverts.", "Sign in to read without adverts on every device you own.", "Contact", "Great read, although the second part could have been shorter in my view.",
)


def _p(*texts: str) -> str:
    return "".join(f"<p data-main>{t}</p>" for t in texts)


def _links(*texts: str) -> str:
    return "<ul>" + "".join(f"<li><a href=/{i}>{t}</a></li>" for i, t in enumerate(texts)) + "</ul>"


def _main_links(*texts: str) -> str:
    return "<ul>" + "".join(f"<li data-main><a href=/{i}>{t}</a></li>" for i, t in enumerate(texts)) + "</ul>"


_BODIES = (
    "<h1 data-main>Quay closed</h1>" + _p(_S[0], _S[6], _S[1], "<b>No ferry.</b>", "See <a href=/t>the timetable</a>.", "<a href=/s>The survey report</a>"),
    _p("Short story.", _S[4], _S[9]),
    _p("Yes.", "No.") + _main_links("Old charts", "New ships", "Storm reports") + _p(_S[2]),
    "<h1 data-main>How to bake</h1>" + _p(_S[2]) + "<ul><li data-main>Flour</li><li data-main>Salt and water</li><li data-main>" + _S[8] + "</li></ul>" + _p(_S[16]),
    "<h1 data-main>Notes</h1><p data-main>" + _S[11] + " " + _S[12] + "</p><blockquote data-main>" + _S[7] + "</blockquote>" + _p(_S[13]),
    "<h2 data-main>The mill</h2>" + _p(_S[7], _S[14], _S[11], _S[15]) + "<h2 data-main>Afterwards</h2>" + _p(_S[5], _S[10]),
    _p(_S[12]), "<h1 data-main>Closed</h1>", "<h1 data-main>Pump</h1><table><tr><td data-main>Valve</td><td data-main>open</td></tr></table>" + _p(_S[8], _S[3]),
    "<h1 data-main>Weather</h1>" + _p(_S[13], _S[14], _S[4], _S[6], _S[15]),
    "<h1 data-main>Reading list</h1>" + _p(_S[16]) + _main_links(_S[3], "A history of the northern harbours in six volumes", "Bridges") + _p(_S[5]),
    _p(_S[7] + " " + _S[11], _S[5], _S[0] + " " + _S[1], _S[13], _S[12] + " " + _S[11], _S[3], _S[10]),
    "<h1 data-main>Two weeks</h1>" + _p(_S[1] + " " + _S[7] + " " + _S[0], _S[14], _S[8], _S[2] + " " + _S[16], _S[15]),
    "<h1 data-main>Letter</h1>" + _p(_S[0] + " " + _S[7], _S[1] + " " + _S[11], _S[12] + " " + _S[2]),
)
# Containers of main text; several have a telling word in their name.
_BOXES = (
    "article", "main", "div", 'div id="content"', 'div class="post-content category-social"', 'div class="search-engine-history"', 'section class="legal-news"',
    'div class="article-body share-enabled"', 'article class="post"', 'div class="entry"', 'div class="story related-law"', 'div class="notice-of-meeting"', "body",
)
_BEFORE = (
    "", f"<nav>{_links('Home', 'News', 'People')}</nav>", f'<header><h1>Harbour News</h1><p>{_N[6]}</p></header>', f'<div class="cookie-notice"><p>{_N[5]}</p><p>OK</p></div>',
    "<p><a href=/>Home</a> | <a href=/x>Archive</a> | <a href=/y>Contact us</a></p>", f'<div id="menu">{_links("Start", "Map of the islands", "Shop")}</div><div class="ad-banner"><p>{_N[0]}</p></div>',
    f'<div class="site-header"><p>Harbour News</p><p>{_N[7]}</p></div>',
)
_INSIDE = (
    "", f'<div class="advert"><p>{_N[0]}</p><p>{_N[1]}</p></div>', f"<aside><h3>Most read</h3><p>{_N[3]}</p></aside>", '<div class="share"><a href=/f>Share</a></div>',
    f"<form><label>Email</label><p>{_N[6]}</p></form>", f'<div class="related-posts">{_links(_S[3], _S[1])}</div>',
)
_AFTER = (
    "", "", f"<footer><p>&copy; Harbour News</p><p>{_N[2]}</p></footer>", f'<div class="site-footer"><p>{_N[2]}</p><p>{_N[8]}</p></div>',
    f'<section class="comments"><h3>3 comments</h3><p>{_N[3]}</p><p>{_N[4]}</p><p>{_N[9]}</p></section>', f'<div id="c7"><h3>2 comments</h3><p>{_N[9]}</p><p>{_N[3]}</p></div>',
    f'<div class="sidebar"><h3>About</h3><p>{_N[9]}</p></div><div class="footer"><p>{_N[2]}</p></div>', f"<p>{_links('Older minutes of the council', 'Newer minutes')}</p><p><a href=/top>Back to top</a></p>",
    f'<div class="comment-list"><p>{_N[3]}</p><p>{_N[4]}</p></div>', f'<div class="newsletter-signup"><p>{_N[6]}</p></div><footer>{_links("Imprint", "Contact")}</footer>',
)


def _page(number: int) -> str:
    rest, parts = number * 40_503 % 65_521, []  # a fixed walk over the combinations
    for choices in (_BODIES, _BOXES, _INSIDE, _BEFORE, _AFTER):
        parts.append(choices[rest % len(choices)])
        rest //= len(choices)
    body, box, inside, before, after = parts
    cut = body.find("</p>") + 4 if number % 2 and "</p>" in body else len(body)
    filled = body[:cut] + inside + body[cut:]
    if box != "body":
        filled = f"<{box}>{filled}</{box.split()[0]}>"
    return f"<html><head><title>Page {number}</title><style>p{{}}</style></head><body>{before}{filled}{after}</body></html>"


EXAMPLES = tuple(_page(n) for n in range(360))
