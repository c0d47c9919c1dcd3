"""Forty further hand-written pages in the style of sites of many kinds, with the text that is theirs; written once, never used to tune the labeller.

M and N mark markup whose text is main text or not. Bylines, dates, reference lists and lists of contents do not count as main text.
"""

M, N = True, False


def page(*parts):
    return [(html, label) for label, html in parts]


P = "The council will vote on the plan next week, after two years of hearings and one long winter of repairs."
Q = "Nobody in the valley remembers a summer as dry as this one, and the river shows it."
S = "Three samples were taken at each site. All of them were sent to the laboratory on the same day."

MORE = [
    page((N, '<html><body><div id="mw-page-base"><a href="#n">Jump to navigation</a></div>'), (M, '<div id="content"><h1 id="firstHeading">River otter</h1><div id="bodyContent"><p>The river otter is a mammal of the northern streams. It eats fish, crabs and now and then a frog.</p>'), (N, '<div id="toc" class="toc"><h2>Contents</h2><ul><li><a href="#1">1 Habitat</a></li><li><a href="#2">2 Diet</a></li></ul></div>'), (M, '<h2>Habitat</h2><p>It lives on banks with dense cover.</p><table class="wikitable"><tr><th>Region</th><th>Count</th></tr><tr><td>North</td><td>1200</td></tr></table>'), (N, '<h2>References</h2><ol class="references"><li><a href="#c">^</a> Field guide, 1998</li></ol></div></div>'), (N, '<div id="footer"><ul><li>This page was last edited in May.</li><li><a href="/p">Privacy policy</a></li></ul></div></body></html>')),
    page((N, '<html><body><div class="css-1a"><div class="css-4d"><a href="/">Daily Globe</a><a href="/s">Sign in</a></div>'), (M, f'<div class="css-9k"><h1 class="css-77">Valley runs dry</h1><p class="css-x1">{Q}</p><p class="css-x1">{P}</p>'), (N, '<div class="css-n3"><p>Get our morning newsletter</p><form><input><button>Sign up</button></form></div>'), (M, f'<p class="css-x1">{S}</p></div>'), (N, '<div class="css-c9"><h2>12 comments</h2><div><span>Ann · 2 h ago</span><p>We saw this coming, I think.</p><a href="#">Reply</a></div></div><div class="css-ft"><a href="/t">Terms</a> <a href="/p">Privacy</a></div></div></body></html>')),
    page((N, "<html><body><p><a href=/>Home</a> | <a href=/bio>Bio</a> | <a href=/links>Links</a></p>"), (M, f"<h1>A week on the moor</h1><p>{Q}</p><p>{P}</p><p>{S}</p>"), (N, "<hr><p><a href=/prev>Previous</a> <a href=/next>Next</a></p></body></html>")),
    page((N, '<html><body><header><nav><a href="/">Recipes</a><a href="/new">New</a></nav></header>'), (M, "<main><h1>Bean soup</h1><p>A soup for cold evenings, and better on the second day.</p><h2>Ingredients</h2><ul><li>Two cups of white beans</li><li>One onion</li><li>Salt</li></ul><h2>Method</h2><ol><li>Soak the beans overnight.</li><li>Boil them with the onion until soft.</li></ol></main>"), (N, '<aside><h3>More recipes</h3><ul><li><a href="/r1">Lentil stew</a></li></ul></aside><footer>© Kitchen notes</footer></body></html>')),
    page((N, '<html><body><div class="topbar"><a href="/login">Login</a></div>'), (M, f'<div class="post"><h2>Release 2.4</h2><p>This release fixes the import of large files.</p><ul><li>Faster start</li><li>Fewer warnings</li></ul><p>{S}</p></div>'), (N, '<div class="sidebar"><h4>Archives</h4><ul><li><a href="/05">May</a></li><li><a href="/04">April</a></li></ul></div><div class="footer">Powered by a small engine</div></body></html>')),
    page((N, '<html><body><nav class="navbar"><a href="/">Start</a><a href="/docs">Docs</a></nav><div class="sidebar"><a href="#a">Setup</a><a href="#b">Usage</a></div>'), (M, "<article><h1>Setup</h1><p>Install the tool first.</p><pre>tool install --all</pre><p>Then start the service, which listens on a local port.</p><table><tr><th>Option</th><th>Meaning</th></tr><tr><td>port</td><td>where it listens</td></tr></table></article>"), (N, '<div class="pager"><a href="/b">Next page</a></div><footer>Version 3.1</footer></body></html>')),
    page((N, '<html><body><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><header class="site"><a href="/">Museum</a></header>'), (M, f"<section class=\"content\"><h1>The glass room</h1><p>{P}</p><figure><img src=a.jpg><figcaption>The room in spring</figcaption></figure><p>{Q}</p></section>"), (N, '<section class="related"><h2>Related</h2><a href="/x">The tower</a></section><footer><p>Opening hours: 10 to 5</p></footer></body></html>')),
    page((N, '<html><body><ul class="menu"><li><a href="/">Home</a></li><li><a href="/team">Team</a></li></ul>'), (M, f'<div class="entry-content"><h1>Minutes of the meeting</h1><p>{P}</p><ol><li>The budget was approved.</li><li>The roof will be mended.</li></ol></div>'), (N, '<div class="share"><a href="?f">Share</a><a href="?t">Tweet</a></div><div class="foot">Contact the office</div></body></html>')),
    page((N, '<html><body><div><div><a href="/">Forum</a> <a href="/rules">Rules</a></div></div>'), (M, f"<div><h1>How the lock was rebuilt</h1></div><div><p>{S}</p><p>{Q}</p><p>{P}</p></div>"), (N, "<div><h3>Comments</h3><div><p>Lovely pictures, thank you.</p></div><div><p>I worked there once.</p></div></div><div>All rights reserved</div></body></html>")),
    page((N, '<html><body><div class="advert">Half price this week only</div><nav><ul><li><a href="/a">Politics</a></li><li><a href="/b">Arts</a></li></ul></nav>'), (M, f"<article><header><h1>A theatre closes</h1></header><p>{P}</p>"), (N, '<div class="ad-slot">Advertisement</div>'), (M, f"<p>{Q}</p><blockquote>It was our second home.</blockquote></article>"), (N, '<div id="comments"><p>So sad.</p></div><footer>© The Paper</footer></body></html>')),
    page((N, '<html><body class="wp"><div id="wrapper"><div id="header"><a href="/">My garden</a></div>'), (M, f'<div id="main"><div class="post"><h1>Pruning roses</h1><div class="entry"><p>Wait until the frost is over.</p><p>{S}</p><h3>Tools</h3><p>A sharp pair of shears is all that you need.</p></div></div>'), (N, '<div class="navigation"><a href="/p">Older posts</a></div></div><div id="sidebar"><h2>Categories</h2><ul><li><a href="/c">Vegetables</a></li></ul></div><div id="footer">Theme by nobody</div></div></body></html>')),
    page((N, '<html><body><div class="jsx-11"><span>Times of the Isle</span></div>'), (M, f'<div class="jsx-20"><h1 class="jsx-3">The ferry is late</h1><div class="jsx-8"><p class="jsx-8">{P}</p><p class="jsx-8">{Q}</p><p class="jsx-8">{S}</p></div></div>'), (N, '<div class="jsx-40"><a href="/1">Ten walks on the isle</a><a href="/2">Where to eat</a></div><div class="jsx-90"><a href="/i">Imprint</a></div></body></html>')),
    page((N, '<html><body><form class="search"><input name="q"><button>Search</button></form><div class="crumbs"><a href="/">Library</a></div>'), (M, f'<div role="main"><h1>Opening of the reading room</h1><p>{P}</p><p>{S}</p></div>'), (N, '<div class="footer-links"><a href="/a">Accessibility</a><a href="/c">Contact</a></div></body></html>')),
    page((N, '<html><body><header><a href="/">City hospital</a></header>'), (M, f"<main><article><h1>Visiting hours</h1><p>Visitors are welcome from two to six.</p><dl><dt>Ward one</dt><dd>Ground floor</dd></dl><p>{Q}</p></article></main>"), (N, '<aside class="widget"><h3>Emergency</h3><p>Call the front desk.</p></aside><footer><a href="/x">Sitemap</a></footer></body></html>')),
    page((N, '<html><body><div class="sc-a1"><div class="sc-b2"><button>Menu</button></div>'), (M, f'<div class="sc-f9"><h1 class="sc-h">An honest machine</h1><p class="sc-p">{S}</p><h2 class="sc-q">Inside</h2><p class="sc-p">{P}</p><ul class="sc-u"><li>A drum</li><li>A belt</li></ul></div>'), (N, '<div class="sc-z"><h3>You may also like</h3><a href="/m">Older machines</a></div><div class="sc-zz">© 2021</div></div></body></html>')),
    page((N, '<html><body><nav><a href="/1">One</a><a href="/2">Two</a></nav>'), (M, f"<article><h1>Letters</h1><p>{P}</p><h2>From the coast</h2><p>{Q}</p><h2>From the hills</h2><p>{S}</p></article>"), (N, "<footer><p>Send us your letters by post.</p></footer></body></html>")),
    page((N, '<html><body><div id="top"><a href="/">University</a></div><div id="menu"><a href="/r">Research</a><a href="/s">Study</a></div>'), (M, f'<div id="text"><h1>A new telescope</h1><p>{S}</p><p>{P}</p></div>'), (N, '<div id="bottom"><a href="/print">Print</a> <a href="/imprint">Imprint</a></div></body></html>')),
    page((N, '<html><body><header class="masthead"><p>The Weekly</p></header><div class="promo">Subscribe for one coin a week</div>'), (M, f'<main class="story"><h1>Bread</h1><p>{Q}</p><p>{P}</p>'), (N, '<div class="newsletter-signup"><h4>Never miss a story</h4><button>Subscribe</button></div>'), (M, f"<p>{S}</p></main>"), (N, '<section class="comments"><h2>Comments</h2><p>Best bread in town.</p></section></body></html>')),
    page((N, "<html><body><table><tr><td><a href=/>Home</a></td><td><a href=/m>Mail</a></td></tr></table>"), (M, f"<div class=article><h1>The old mill</h1><p>{P}<p>{Q}<p>{S}</div>"), (N, "<div class=footer>Last changed in March</div></body></html>")),
    page((N, '<html><body><div class="popup"><p>Join our mailing list</p></div><nav class="main-nav"><a href="/">News</a></nav>'), (M, f'<div class="article-body"><h1>Snow in May</h1><p>{Q}</p><p>Schools were closed for a day.</p><p>{P}</p></div>'), (N, '<div class="tags"><a href="/t/snow">snow</a><a href="/t/may">may</a></div><div class="related"><h3>Related stories</h3><a href="/q">Hail in June</a></div></body></html>')),
    page((N, '<html><body><div class="header"><h2>Chess club</h2></div>'), (M, f"<article class=\"post\"><h1>Report of round three</h1><p>{S}</p><table><tr><td>White</td><td>Black</td></tr><tr><td>Meyer</td><td>Olsen</td></tr></table><p>{P}</p></article>"), (N, '<footer class="footer"><p>Meetings on Fridays</p></footer></body></html>')),
    page((N, '<html><body><div class="x-1"><a href="/">Portal</a><a href="/w">Weather</a><a href="/m">Mail</a></div>'), (M, f'<article class="x-2"><h1>Trains return</h1><p>{P}</p><p>{S}</p></article>'), (N, '<div class="x-3"><a href="/v">Video of the day</a></div><footer class="x-4">Imprint</footer></body></html>')),
    page((N, '<html><body><nav class="toctree"><ul><li><a href="#q">Quick start</a></li></ul></nav>'), (M, "<div class=\"document\"><h1>Reference</h1><h2>open</h2><p>Opens a file and gives a handle to it.</p><pre>open(path)</pre><h2>close</h2><p>Closes the handle.</p></div>"), (N, '<div class="footer">Built with a generator</div></body></html>')),
    page((N, '<html><body><div class="site-header"><a class="logo" href="/">Bakery</a><nav><a href="/shop">Shop</a></nav></div>'), (M, f'<div class="page-content"><h1>Our flour</h1><p>{Q}</p><p>{S}</p></div>'), (N, '<div class="cart"><p>Your cart is empty</p></div><div class="site-footer"><p>© Bakery</p></div></body></html>')),
    page((N, '<html><body><div><span>Blog of a sailor</span></div>'), (M, f"<div><h1>Day nine</h1><p>{Q}</p><p>We changed the sail at noon.</p><p>{S}</p></div>"), (N, '<div><a href="/8">Day eight</a><a href="/10">Day ten</a></div></body></html>')),
    page((N, '<html><body><header><nav><ul><li><a href="/law">Law</a></li></ul></nav></header>'), (M, f"<main><h1>Regulation of boats</h1><section><h2>Scope</h2><p>{P}</p></section><section><h2>Duties</h2><ol><li>Every boat carries a light.</li><li>Every light is tested once a year.</li></ol></section></main>"), (N, "<footer><p>Official journal</p></footer></body></html>")),
    page((N, '<html><body><div class="notice">The site will be down on Sunday.</div><div class="nav"><a href="/">Index</a></div>'), (M, f'<div class="content"><h1>Bees in the city</h1><p>{S}</p><p>{Q}</p></div>'), (N, '<div class="comment-list"><div class="comment"><p>We keep two hives.</p></div></div></body></html>')),
    page((N, '<html><body><div class="css-aa"><nav class="css-ab"><a href="/">A</a><a href="/b">B</a></nav>'), (M, f'<main class="css-ba"><h1 class="css-bb">Fewer stars</h1><p class="css-bc">{P}</p><h2 class="css-bd">Light</h2><p class="css-bc">{Q}</p><p class="css-bc">{S}</p></main>'), (N, '<footer class="css-ca"><a href="/terms">Terms</a></footer></div></body></html>')),
    page((N, '<html><body><div class="banner">Sale ends today</div>'), (M, f'<article><h1>How to mend a net</h1><p>{S}</p><ol><li>Cut away the torn mesh.</li><li>Tie a new row from the left.</li></ol><p>{Q}</p></article>'), (N, '<div class="sponsored"><a href="/n">Cheap nets here</a></div></body></html>')),
    page((N, '<html><body><div id="nav"><a href="/">Parish</a></div>'), (M, f'<div id="content"><h1>Bell tower</h1><p>{P}</p><p>{S}</p>'), (N, '<div class="share-buttons"><a href="#">Share</a></div></div><div id="side"><h3>Events</h3><p>Choir on Monday</p></div></body></html>')),
    page((N, '<html><body><header class="top"><a href="/">Science today</a></header>'), (M, f'<div class="story-wrap"><div class="story"><h1>Cold light</h1><p class="lead">{Q}</p><p>{S}</p><h3>Methods</h3><p>{P}</p></div></div>'), (N, '<div class="footnotes"><h2>References</h2><ol><li>Journal of light, 12</li></ol></div><footer>© Science today</footer></body></html>')),
    page((N, '<html><body><div class="login-form"><label>User</label><input><button>Log in</button></div>'), (M, f'<div class="main-text"><h1>The lighthouse keeper</h1><p>{P}</p><p>{Q}</p></div>'), (N, '<div class="bottom"><a href="/h">Help</a></div></body></html>')),
    page((N, '<html><body><nav><a href="/">Travel</a></nav>'), (M, f'<article><h1>Two days in the port</h1><p>{Q}</p><h2>Where to sleep</h2><p>There are three inns near the quay.</p><h2>Where to eat</h2><p>{S}</p></article>'), (N, '<aside><h4>Popular</h4><a href="/i">Islands</a></aside><footer>Contact</footer></body></html>')),
    page((N, '<html><body><div class="wrap"><div class="crumb"><a href="/">Start</a></div>'), (M, f'<div class="col"><h1>Water prices</h1><p>{P}</p><table><tr><th>Year</th><th>Price</th></tr><tr><td>2019</td><td>4</td></tr><tr><td>2020</td><td>5</td></tr></table><p>{Q}</p></div>'), (N, '<div class="col-side"><h3>Latest</h3><ul><li><a href="/1">Power prices</a></li></ul></div></div></body></html>')),
    page((N, '<html><body><div class="ribbon">Free trial</div><header><nav><a href="/p">Product</a></nav></header>'), (M, f'<main><h1>Why we moved our data</h1><p>{S}</p><p>{P}</p><blockquote>It took one night.</blockquote></main>'), (N, '<footer><ul><li><a href="/j">Careers</a></li></ul></footer></body></html>')),
    page((N, '<html><body><div><div><a href="/">N</a></div>'), (M, f'<div><div><h1>The tide mill</h1><p>{P}</p><p>{Q}</p><p>{S}</p></div>'), (N, '<div><p>Subscribe to our newsletter</p><button>Subscribe</button></div></div><div><a href="/c">Contact</a><a href="/p">Privacy</a></div></div></body></html>')),
    page((N, '<html><body><div class="menu"><a href="/">Radio</a><a href="/live">Live</a></div>'), (M, f'<div class="text"><h1>A voice at night</h1><p>{Q}</p><p>She reads for an hour and never says her name.</p><p>{P}</p></div>'), (N, '<div class="player"><button>Play</button></div><div class="legal">All rights reserved</div></body></html>')),
    page((N, '<html><body><nav id="nav"><a href="/">Wiki</a></nav>'), (M, '<div id="content" class="mw-body"><h1>Copper</h1><p>Copper is a metal that people have used for ten thousand years.</p><h2>Uses</h2><ul><li>Wires</li><li>Pots</li></ul><p>Most of it is used again.</p>'), (N, '<div class="reflist"><ol><li>Metals, 3rd edition</li></ol></div></div><div id="catlinks"><a href="/c">Metals</a></div></body></html>')),
    page((N, '<html><body><div class="head"><a href="/">Sports desk</a></div>'), (M, f'<div class="report"><h1>A draw in the rain</h1><p>{S}</p><p>The second half was better than the first.</p></div>'), (N, '<div class="table-box"><h3>Table</h3><table><tr><td>1</td><td>Harbour</td></tr></table></div><div class="footer"><a href="/i">Imprint</a></div></body></html>')),
    page((N, '<html><body><aside class="sidebar"><ul><li><a href="/a">About</a></li></ul></aside>'), (M, f'<section class="post-body"><h1>On keeping a diary</h1><p>{Q}</p><p>{P}</p><p>{S}</p></section>'), (N, '<section class="responses"><h2>Responses</h2><p>I burned mine.</p></section><footer>© 2020</footer></body></html>')),
]
