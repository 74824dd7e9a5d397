"""Pages written by hand, unlike those the content model is trained on, with their main text."""

from __future__ import annotations

#: (html, main text) pairs.
PAGES = [
    # An old layout: a table with a menu cell, the article in the middle, a footer row.
    (
        """<html><head><title>Old</title></head><body bgcolor=white><table width=100%><tr><td colspan=3><img src=logo.gif> <b>The County Gazette</b></td></tr>
<tr><td width=120><a href=/>Home</a><br><a href=/news>News</a><br><a href=/about>About us</a><br><a href=/mail>Mail</a></td>
<td><h2>Bridge opens after long repairs</h2><p>The bridge over the river was opened on Monday, after repairs that took eleven months and cost more than had been planned.</p>
<p>Traffic was heavy in the first hours, the police said, but there were no accidents.</p></td>
<td width=140><a href=/ad1>Cheap tyres</a><br><a href=/ad2>Fly to the sun</a></td></tr>
<tr><td colspan=3><font size=1>&copy; 1999 The County Gazette. All rights reserved.</font></td></tr></table></body></html>""",
        "Bridge opens after long repairs\nThe bridge over the river was opened on Monday, after repairs that took eleven months and cost more than had been planned.\nTraffic was heavy in the first hours, the police said, but there were no accidents.",
    ),
    # Two menu words in cells.
    (
        """<body><table class=menu><tr><td><a href=1>One</a></td><td><a href=2>Two</a></td></tr></table><div class=story><h1>A walk by the sea</h1>
<p>We left early, when the fog still lay on the water, and walked along the shore until noon.</p><p>Nobody spoke much; the gulls did that for us.</p></div></body>""",
        "A walk by the sea\nWe left early, when the fog still lay on the water, and walked along the shore until noon.\nNobody spoke much; the gulls did that for us.",
    ),
    # A blog of the two-thousands: everything is a div, comments below.
    (
        """<!DOCTYPE html><html><body><div id="wrap"><div id="head"><div id="logo">My little blog</div><ul id="tabs"><li><a href="/">Start</a></li><li><a href="/me">Me</a></li></ul></div>
<div id="main-column"><div class="post hentry"><h2 class="entry-title">Baking bread at home</h2><div class="meta">Posted by Ann in <a href="/c/food">Food</a></div>
<div class="entry-content"><p>Bread needs only flour, water, salt and time. Of these, time is what most people lack.</p><blockquote><p>Give us this day our daily bread.</p></blockquote>
<ol><li>Mix everything and let it rest for an hour.</li><li>Fold it four times, then wait until the next morning.</li></ol><p>Bake it hot, with steam, until the crust is dark.</p></div></div>
<div id="comments"><h3>2 comments</h3><ol class="commentlist"><li class="comment"><p>Mine did not rise at all, what did I do wrong?</p></li><li class="comment"><p>Use warmer water.</p></li></ol></div></div>
<div id="sidebar-right"><h4>Archive</h4><ul><li><a href="/2008">2008</a></li><li><a href="/2007">2007</a></li></ul></div><div id="foot">Powered by hand.</div></div></body></html>""",
        "Baking bread at home\nPosted by Ann in Food\nBread needs only flour, water, salt and time. Of these, time is what most people lack.\nGive us this day our daily bread.\nMix everything and let it rest for an hour.\nFold it four times, then wait until the next morning.\nBake it hot, with steam, until the crust is dark.",
    ),
    # Modern markup with a table of data inside the article, a figure and an inline advert.
    (
        """<body><header class="site-header"><a href="/">Numbers Daily</a><nav aria-label="Main"><a href="/a">World</a> <a href="/b">Markets</a></nav></header><main><article><h1>Harvest down by a fifth</h1>
<p>Farmers brought in a fifth less grain than last year, the ministry said, because spring came late and summer was dry.</p><figure><img src="x.jpg" alt=""><figcaption>A field in July.</figcaption></figure>
<table><tr><th>Year</th><th>Tonnes</th></tr><tr><td>2021</td><td>48,000</td></tr><tr><td>2022</td><td>39,000</td></tr></table>
<div class="ad-slot">Advertisement: Tractors at half the price!</div><p>Prices have not moved yet, but traders expect them to rise before winter.</p></article></main>
<section class="related"><h2>Read next</h2><ul><li><a href="/1">Rain at last</a></li></ul></section><footer><p>Numbers Daily, imprint and contact.</p></footer></body>""",
        "Harvest down by a fifth\nFarmers brought in a fifth less grain than last year, the ministry said, because spring came late and summer was dry.\nA field in July.\nYear\nTonnes\n2021\n48,000\n2022\n39,000\nPrices have not moved yet, but traders expect them to rise before winter.",
    ),
    # Links within sentences, a code block, headings of three levels, a newsletter form in the middle.
    (
        """<body><div class="cookie-notice"><p>We use cookies to improve your visit. <a href="/privacy">More</a></p><button>Accept</button></div><div role="main"><h1>Sorting in place</h1>
<p>Most libraries sort with <a href="/quick">quicksort</a> or <a href="/merge">merge sort</a>, and often with both of them.</p><h2>Why two</h2><p>One is fast on average, the other never slow.</p>
<pre>for x in xs:
    place(x)</pre><form class="newsletter"><label>Your mail</label><input><button>Subscribe</button></form><h3>What remains</h3><p>Short runs are sorted by insertion, which beats both when there are fewer than about twenty items.</p></div><footer>About | Terms</footer></body>""",
        "Sorting in place\nMost libraries sort with quicksort or merge sort, and often with both of them.\nWhy two\nOne is fast on average, the other never slow.\nfor x in xs: place(x)\nWhat remains\nShort runs are sorted by insertion, which beats both when there are fewer than about twenty items.",
    ),
    # No article at all: only a menu and a form.
    ("""<body><nav><ul><li><a href=/a>Shop</a></li><li><a href=/b>Cart</a></li></ul></nav><form id=login><p>User</p><input><p>Password</p><input></form><footer>&copy; Shop</footer></body>""", ""),
]
