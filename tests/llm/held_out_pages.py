"""Hand-written pages in the style of real sites, with the text that is theirs; never used to tune the labeller.

Each page is a list of (markup, whether its text is main text). Written once and left alone since.
"""

PAGES = [
    [  # a daily paper with a subscription bar and a related box in the text
        ('<html><head><title>Harbour reopens</title></head><body class="page-article theme-light"><div class="skip"><a href="#c">Skip to content</a></div>', False),
        ('<div class="top-strip"><a href="/epaper">E-paper</a> <a href="/login">Sign in</a></div>', False),
        ('<header class="masthead"><a href="/">The Harbour Post</a></header>', False),
        ('<nav class="sections"><ul><li><a href="/w">World</a></li><li><a href="/e">Economy</a></li><li><a href="/c">Culture</a></li></ul></nav>', False),
        ('<main id="c"><article class="story"><h1>Harbour reopens after the storm</h1>', True),
        ("<p>The first ferries left the northern pier on Tuesday morning, two days earlier than the port authority had expected.</p>", True),
        ('<p>Engineers had worked through the night to clear <a href="/t/debris">debris</a> from the channel.</p>', True),
        ('<aside class="related-inline"><h4>More on this</h4><ul><li><a href="/a1">Storm damage in pictures</a></li></ul></aside>', False),
        ("<h2>What comes next</h2>", True),
        ("<p>Freight will follow on Thursday. The cranes must be inspected one by one, a spokesman said.</p>", True),
        ('<div class="newsletter-box"><p>Get the morning briefing in your inbox.</p><form><input type="email"><button>Subscribe</button></form></div>', False),
        ("<p>Insurers put the losses at some forty million.</p></article></main>", True),
        ('<section id="comments" class="reader-comments"><h3>3 comments</h3><p>About time they fixed that pier!</p><p>Great work by everybody.</p></section>', False),
        ('<footer class="site-footer"><p>&copy; Harbour Post Media</p><ul><li><a href="/imprint">Imprint</a></li><li><a href="/privacy">Privacy</a></li></ul></footer></body></html>', False),
    ],
    [  # a blog of a common kind
        ('<html><body class="home blog"><div id="page" class="site"><header id="masthead" class="site-header"><p class="site-title"><a href="/">Notes from the shed</a></p></header>', False),
        ('<nav id="site-navigation" class="main-navigation"><ul><li><a href="/about">About</a></li><li><a href="/tools">Tools</a></li></ul></nav>', False),
        ('<div id="content" class="site-content"><div id="primary" class="content-area"><article id="post-7" class="post hentry"><h1 class="entry-title">Sharpening a plane iron</h1>', True),
        ('<div class="entry-content"><p>I used to avoid this job. Now it takes me five minutes, most of which is finding the stone.</p>', True),
        ("<ul><li>Flatten the back first.</li><li>Raise a burr on the bevel.</li></ul>", True),
        ("<p>Strop it, and try it on end grain.</p>", True),
        ("<blockquote>A dull tool is a dangerous one.</blockquote></div>", True),
        ('<div class="sharedaddy"><h3>Share this:</h3><ul><li><a href="?s=x">Mail</a></li></ul></div></article>', False),
        ('<div id="comments" class="comments-area"><ol class="comment-list"><li>Thanks, this helped me a lot.</li><li>Which grit do you start with?</li></ol></div></div>', False),
        ('<div id="secondary" class="widget-area"><section class="widget"><h2>Recent posts</h2><ul><li><a href="/p6">A bench hook</a></li><li><a href="/p5">Glue</a></li></ul></section></div></div>', False),
        ('<footer id="colophon" class="site-footer">Proudly powered by a shed.</footer></div></body></html>', False),
    ],
    [  # pages of a manual
        ('<html><body><div class="navbar"><a href="/">Docs</a><a href="/api">API</a><a href="/changelog">Changelog</a></div>', False),
        ('<div class="wrapper"><div class="sidebar-menu"><ul><li><a href="#i">Install</a></li><li><a href="#c">Configure</a></li><li><a href="#r">Run</a></li></ul></div>', False),
        ('<div role="main" class="document"><h1>Getting started</h1>', True),
        ("<p>You need a recent compiler and about two gigabytes of disk.</p>", True),
        ("<h2>Install</h2>", True),
        ("<pre>make all\nmake install</pre>", True),
        ("<p>If the second step fails, look into the log that the first one wrote.</p>", True),
        ("<table><tr><td>prefix</td><td>where files go</td></tr></table>", True),
        ("</div></div>", False),
        ('<div class="pagination"><a href="/prev">Previous</a> <a href="/next">Next</a></div><footer>Built with care. Version 4.2</footer></body></html>', False),
    ],
    [  # a magazine without any telling element in the middle
        ('<html><body><div class="cookie-layer"><p>We use cookies to improve your experience.</p><button>Accept all</button></div>', False),
        ('<div class="hdr"><span>Culture Weekly</span></div><ul class="menu"><li><a href="/f">Film</a></li><li><a href="/b">Books</a></li></ul>', False),
        ('<div class="l-wrap"><div class="l-col"><h1>The quiet novelist</h1>', True),
        ("<p>She has written nine books and given three interviews. This is the fourth, and it took a year to arrange.</p>", True),
        ("<p>We meet in a station café, which she chose because nobody stays there for long.</p>", True),
        ('<div class="ad-container"><span>Advertisement</span><a href="/buy">Half price until Sunday</a></div>', False),
        ("<p>Her desk, she says, faces a wall. A view would only offer her other people's sentences.</p>", True),
        ("</div></div>", False),
        ('<div class="teaser-list"><h3>You may also like</h3><a href="/1">Ten novels for the train</a><a href="/2">A festival in the rain</a></div>', False),
        ('<div class="ftr">Imprint | Contact | Terms</div></body></html>', False),
    ],
    [  # a council's notice
        ('<html><body><header><h2>Town of Aldmoor</h2><form class="search"><label>Search this site</label><input></form></header>', False),
        ('<nav aria-label="Breadcrumb" class="breadcrumb"><ol><li><a href="/">Home</a></li><li><a href="/news">News</a></li></ol></nav>', False),
        ('<main><h1>Road works in Mill Lane</h1>', True),
        ("<p>Mill Lane is closed between the bridge and the school from 3 to 14 June.</p>", True),
        ("<p>Buses stop at the church. Residents may use the farm track.</p>", True),
        ("<h3>Why is this needed?</h3>", True),
        ("<p>The water main is from 1911 and leaks.</p>", True),
        ('<div class="feedback-form"><p>Was this page useful?</p><button>Yes</button><button>No</button></div></main>', False),
        ('<footer><a href="/a">Accessibility</a> <a href="/c">Contact us</a><p>Town Hall, Aldmoor</p></footer></body></html>', False),
    ],
]
