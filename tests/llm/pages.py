"""Pages written by hand in layouts of many kinds of sites. What stands between [[ and ]] is main text; the marks are taken out before use."""

import re

PAGES = {
    "encyclopedia": """<!DOCTYPE html><html><body class="mediawiki ltr skin-vector"><div id="mw-page-base"></div><div id="mw-head"><div id="p-personal"><ul><li><a href="/l">Log in</a></li><li><a href="/c">Create account</a></li></ul></div></div>
<div id="content" class="mw-body" role="main"><h1 id="firstHeading" class="firstHeading">[[Tidal lagoon]]</h1><div id="bodyContent"><div id="mw-content-text" class="mw-body-content"><div class="mw-parser-output"><p>[[A tidal lagoon is an enclosed body of salt water that fills and empties with the sea.]]</p>
<h2><span class="mw-headline">[[History]]</span></h2><p>[[Early basins were dug by hand near river mouths. <a href="/w/Mill">Tide mills</a> used them from the twelfth century.]]</p><ul><li>[[Woodbridge, rebuilt in 1793]]</li><li>[[Eling, rebuilt in 1785]]</li></ul>
<table class="wikitable"><tr><th>[[Site]]</th><th>[[Area]]</th></tr><tr><td>[[Eling]]</td><td>[[4 ha]]</td></tr></table></div></div></div></div>
<div id="mw-navigation"><h2>Navigation menu</h2><div class="vector-menu portal"><h3>Tools</h3><ul><li><a href="/a">What links here</a></li><li><a href="/b">Related changes</a></li></ul></div></div><footer id="footer" class="mw-footer"><ul id="footer-info"><li>This page was last edited on 3 May.</li></ul><ul id="footer-places"><li><a href="/p">Privacy policy</a></li><li><a href="/d">Disclaimers</a></li></ul></footer></body></html>""",
    "blog": """<html><body class="home blog"><div id="page" class="hfeed site"><header id="masthead" class="site-header"><h1 class="site-title"><a href="/">Notes from the shed</a></h1><p class="site-description">Wood, glue, patience</p></header><nav id="site-navigation" class="main-navigation"><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul></nav>
<div id="primary" class="content-area"><main id="main" class="site-main"><article id="post-88" class="post-88 post type-post hentry"><header class="entry-header"><h1 class="entry-title">[[Sharpening a spokeshave]]</h1></header><div class="entry-content"><p>[[The blade is short, so it needs a holder. I made mine from a scrap of ash.]]</p><p>[[Work up to a fine stone and stop when the burr is gone.]]</p><blockquote><p>[[A dull tool is a dangerous tool.]]</p></blockquote></div></article>
<div id="comments" class="comments-area"><h2 class="comments-title">2 thoughts on Sharpening a spokeshave</h2><ol class="comment-list"><li class="comment"><article class="comment-body"><p>I always used a strop for this, works wonders on old steel.</p></article></li><li class="comment"><article class="comment-body"><p>Thank you for writing this up!</p></article></li></ol><div id="respond" class="comment-respond"><h3>Leave a Reply</h3><form><label>Name</label><input><label>Email</label><input></form></div></div></main></div>
<div id="secondary" class="widget-area"><aside class="widget widget_recent_entries"><h3 class="widget-title">Recent Posts</h3><ul><li><a href="/1">A bench hook</a></li><li><a href="/2">Winding sticks</a></li></ul></aside></div><footer id="colophon" class="site-footer"><div class="site-info">Proudly powered by a press</div></footer></div></body></html>""",
    "old table page": """<html><head><title>x</title></head><body bgcolor="#ffffff"><center><font size="5">Riverside Model Railway Club</font></center><hr><table width="100%" border="0"><tr><td width="120" valign="top"><a href="i.html">Home</a><br><br></td></tr></table><table width="100%"><tr><td width="130" valign="top" bgcolor="#ccccff"><font size="2"><p><a href="n.html">News</a><p><a href="m.html">Meetings</a><p><a href="l.html">Links</a></font></td>
<td valign="top"><h2>[[Winter exhibition]]</h2><p>[[The winter exhibition was visited by more than four hundred people, and the narrow gauge layout won the cup for the second year.]]<p>[[We thank all who brought their stock and stayed late to pack the hall.]]<p>[[The next exhibition will take place in the autumn, when the new hall is ready.]]</td></tr></table><hr><center><font size="1">Copyright 1999 Riverside Model Railway Club. All rights reserved.</font></center></body></html>""",
    "news with utility classes": """<html><body class="antialiased bg-white"><div class="flex flex-col min-h-screen"><div class="sticky top-0 z-50 border-b px-4 py-2"><div class="flex justify-between items-center max-w-7xl mx-auto"><nav class="hidden md:flex space-x-4 text-sm"><a href="/w">World</a></nav><nav class="space-x-2"><a href="/s">Sport</a></nav></div></div>
<main class="flex-1 max-w-3xl mx-auto px-4 py-8"><div class="mb-4"><div class="flex flex-col gap-2"><div class="text-4xl font-bold leading-tight tracking-tight"><h1>[[Harbour bridge closes for repairs]]</h1></div></div></div><div class="prose prose-lg mt-6"><div class="relative"><div class="space-y-4"><p class="text-base leading-7">[[The bridge over the harbour will close on Monday for eleven weeks, the city said.]]</p><p class="text-base leading-7">[[Ferries will run every ten minutes from both banks.]]</p></div><div class="my-6 bg-gray-100 ad-slot"><p class="text-xs uppercase">Advertisement</p><p>New shoes at half the price</p></div><div class="space-y-4"><p class="text-base leading-7">[[Shops near the ramp fear for their trade. Some will open a market on the quay.]]</p></div></div></div></main>
<footer class="bg-gray-900 text-white px-4 py-12"><div class="grid grid-cols-4 gap-8"><div class="text-sm"><p>About us</p></div><div class="text-sm"><p>Terms of use</p></div></div></footer></div></body></html>""",
    "documentation": """<html><body><div class="document"><div class="documentwrapper"><div class="bodywrapper"><div class="body" role="main"><section id="install"><h1>[[Installation]]</h1><p>[[Run the installer and follow the steps. It needs no network.]]</p><div class="highlight-default notranslate"><div class="highlight"><pre>[[make && make install]]</pre></div></div><dl><dt>[[prefix]]</dt><dd>[[Where the files go.]]</dd><dt>[[jobs]]</dt><dd>[[How many tasks run at once.]]</dd></dl></section></div></div></div><div class="sphinxsidebar" role="navigation" aria-label="main navigation"><div class="sphinxsidebarwrapper"><h3>Table of Contents</h3><ul><li><a href="#">Installation</a></li><li><a href="#">Usage</a></li></ul><div id="searchbox" role="search"><h3>Quick search</h3><form action="s"><input type="text"></form></div></div></div></div><div class="footer">2021, The authors. Created using a generator.</div></body></html>""",
    "recipe": """<html><body><div class="cookie-banner"><p>We value your privacy and use cookies.</p><button>Accept all</button></div><header class="top-bar"><a class="brand" href="/">Kitchen Table</a></header><main><article class="recipe"><h1>[[Barley soup]]</h1><figure><img src="a.jpg"><figcaption>[[A bowl of barley soup with leeks]]</figcaption></figure><p>[[This soup is better on the second day.]]</p><h2>[[Ingredients]]</h2><ul class="ingredients"><li>[[200 g pearl barley]]</li><li>[[2 leeks]]</li><li>[[1 l stock]]</li></ul><h2>[[Method]]</h2><ol><li>[[Soak the barley overnight.]]</li><li>[[Fry the leeks, add all, and simmer for an hour.]]</li></ol><div class="share-buttons"><span>Share this</span></div></article><section class="related-recipes"><h3>You may also like</h3><ul><li><a href="/p">Pea soup</a></li><li><a href="/o">Onion tart</a></li></ul></section></main><footer><p>Kitchen Table 2020</p></footer></body></html>""",
    "bare": """<h1>[[Letter to the editor]]</h1><p>[[Your last issue claimed that owls cannot move their eyes. This is true, and yet they see us.]]<p>[[Yours, a reader]]""",
    "thread below article": """<html><body><ul class="nav navbar-nav"><li><a href="/">Start</a></li><li><a href="/k">Kontakt</a></li></ul><div class="container"><div class="row"><div class="col-md-8"><div class="post-content"><h1>[[Der alte Turm]]</h1><p>[[Der Turm am Markt wird in diesem Jahr zum ersten Mal seit dem Brand wieder geöffnet.]]</p><p>[[Die Treppe hat 212 Stufen.]]</p></div><div class="discussion"><div class="thread"><div class="msg"><p>Endlich! Ich habe so lange darauf gewartet, wieder hinauf zu gehen und über die Stadt zu sehen.</p></div><div class="replies"><div class="msg"><p>Ich auch.</p></div></div></div></div></div><div class="col-md-4"><div class="sidebar"><h4>Archiv</h4><ul><li><a href="/1">Mai</a></li><li><a href="/2">Juni</a></li></ul></div></div></div></div><div class="footer"><p>Impressum</p></div></body></html>""",
    "mailing list": """<html><body><h1>[[Re: build order on slow disks]]</h1><ul><li><a href="p.html">Previous message</a></li><li><a href="n.html">Next message</a></li></ul><hr><pre>[[I measured it again with the new kernel and the order makes no difference once the cache is warm.]]</pre><hr><ul><li><a href="p.html">Previous message</a></li><li><a href="n.html">Next message</a></li></ul><hr><a href="i.html">More information about the list</a></body></html>""",
    "product": """<html><body><nav class="navbar"><ul><li><a href="/">Shop</a></li><li><a href="/cart">Cart</a></li></ul></nav><ol class="breadcrumb"><li><a href="/">Home</a></li><li><a href="/l">Lamps</a></li></ol><div id="content"><h1>[[Desk lamp, brass]]</h1><div class="description"><p>[[A heavy lamp with a jointed arm. The shade turns freely.]]</p><p>[[Height 40 cm, weight 2 kg.]]</p></div></div><div class="newsletter-signup"><h4>Stay in touch</h4><p>Sign up and save 10 percent</p><form><input><button>Subscribe</button></form></div><footer class="page-footer"><p>Returns</p><p>Shipping</p></footer></body></html>""",
    "magazine": """<html><body><div id="wrap"><div id="header"><div id="logo">The Weekly Lantern</div><div id="menu"><ul><li><a href="/a">Arts</a></li><li><a href="/b">Books</a></li><li><a href="/c">Culture</a></li></ul></div></div><div id="leaderboard" class="advert">Subscribe for one pound a week</div><div id="story"><h1>[[The last lighthouse keeper]]</h1><p>[[For thirty years she climbed the same stairs each evening.]]</p><div class="pullquote"><p>[[The sea is never the same twice.]]</p></div><p>[[When the lamp was made automatic she stayed on as a guide.]]</p><p>[[Visitors ask about storms. She tells them of the calm.]]</p></div><div id="rightcol"><h3>Most read</h3><ul><li><a href="/1">A city of bells</a></li><li><a href="/2">Bread at dawn</a></li></ul></div><div id="bottom"><p>All rights reserved. Contact the editors.</p></div></div></body></html>""",
    "menu only": """<html><body><nav><ul><li><a href="/a">Products</a></li><li><a href="/b">Prices</a></li><li><a href="/c">Support</a></li></ul></nav><footer><p>Terms and conditions apply</p></footer></body></html>""",
    "science": """<html><body><header role="banner"><a href="/">Journal of Small Things</a></header><main role="main"><article><h1>[[On the drift of dust]]</h1><section><h2>[[Abstract]]</h2><p>[[We follow single grains through a beam of light and find that their paths are not random.]]</p></section><section><h2>[[Model]]</h2><p>[[The drift speed is]]</p><math display="block"><mi>[[v]]</mi><mo>[[=]]</mo><mi>[[kt]]</mi></math><p>[[where k depends on the size alone.]]</p><table><tr><td>[[size]]</td><td>[[k]]</td></tr><tr><td>[[2]]</td><td>[[0.31]]</td></tr></table></section></article></main><aside role="complementary"><h2>Cited by</h2><ul><li><a href="/x">Grains in motion</a></li></ul></aside><footer role="contentinfo"><p>ISSN 0000</p></footer></body></html>""",
    "french news": """<html><body><div class="bandeau-cookies"><p>Nous utilisons des cookies pour améliorer votre visite.</p></div><div class="entete"><ul class="menu"><li><a href="/">Accueil</a></li><li><a href="/p">Politique</a></li></ul></div><div class="contenu"><div class="article"><h1>[[Le pont sera fermé tout l'été]]</h1><p>[[La mairie a annoncé hier que le pont serait fermé de juin à septembre.]]</p><p>[[Les riverains demandent une passerelle.]]</p></div></div><div class="pied"><p>Mentions légales</p></div></body></html>""",
    "spanish": """<html><body><header><nav><a href="/">Inicio</a></nav></header><section class="noticia"><h2>[[El mercado vuelve a la plaza]]</h2><p>[[Después de dos años, los puestos de fruta vuelven a la plaza mayor cada sábado.]]</p><p>[[Los vecinos celebraron con música.]]</p></section><section class="comentarios" id="comments"><h3>Comentarios</h3><div class="comment"><p>Qué alegría, por fin, después de tanto tiempo sin mercado en el barrio.</p></div></section><footer><p>Aviso legal</p></footer></body></html>""",
    "deep divs": "<html><body><div class='app'><div class='top nav-wrapper'><div><div><div><ul><li><a href='/'>Home</a></li><li><a href='/q'>Questions</a></li></ul></div></div></div></div>" + "<div class='layer'>" * 9 + "<div class='article-body'>" + "<div class='block inner'>" * 6 + "<p>[[The well behind the school was dug in a dry year and has never failed since.]]</p><p>[[Children draw from it in the morning.]]</p>" + "</div>" * 6 + "</div><div class='comments'>" + "<div class='block inner'>" * 6 + "<p>We had the same at our school when I was little, and the water was always cold.</p><p>Nice.</p>" + "</div>" * 6 + "</div>" + "</div>" * 9 + "<div class='site-footer'><div><div><p>Made by pupils</p></div></div></div></div></body></html>",
    "government": """<html><body><a class="skip-link" href="#main">Skip to main content</a><div class="cookie-message" role="alert"><p>Tell us whether you accept cookies</p></div><header class="gov-header" role="banner"><a href="/">Public Services</a></header><div class="breadcrumbs"><ol><li><a href="/">Home</a></li><li><a href="/t">Transport</a></li></ol></div><main id="main" role="main"><div class="grid-row"><div class="column-two-thirds"><h1>[[Renew a boat licence]]</h1><p>[[You need a licence for any boat kept on the river for more than a day.]]</p><h2>[[Before you start]]</h2><ul><li>[[your boat's number]]</li><li>[[proof of insurance]]</li></ul></div><div class="column-one-third"><aside class="related-navigation"><h2>Related content</h2><ul><li><a href="/m">Moorings</a></li></ul></aside></div></div></main><footer class="gov-footer" role="contentinfo"><ul><li><a href="/h">Help</a></li><li><a href="/c">Cookies</a></li></ul></footer></body></html>""",
    "poem": """<html><body><div id="nav"><a href="p1.html">Prev</a></div><div id="poem"><h2>[[Evening]]</h2><p>[[The gate is shut,<br>the hens are in,<br>and somewhere down the lane<br>a lamp is lit.]]</p></div><div id="footer">Page 12</div></body></html>""",
    "unclosed": """<html><body><div class=menu><ul><li><a href=/>Home<li><a href=/x>Map</ul></div><div class=main><h1>[[Walks in the hills]]<p>[[Start at the church and follow the wall.<p>]][[Turn left at the barn.]]<ul><li>[[Three miles]]<li>[[Two stiles]]</ul></div><div class=footer>Updated yesterday</div>""",
    "school": """<html><body><table class="layout"><tr><td colspan="2" class="header"><b>Hill School</b></td></tr><tr><td class="menu"><a href="/1">Pupils</a></td><td class="content"><h1>[[Sports day]]</h1><p>[[The relay was won by the blue team in the last few yards, to much cheering from the bank.]]</p><p>[[Tea was served in the hall.]]</p></td></tr><tr><td colspan="2" class="footer">Contact the office</td></tr></table></body></html>""",
    "video page": """<html><body><header class="site-head"><div class="branding">Channel Nine</div></header><article><h1>[[How a bell is cast]]</h1><div class="player"><noscript>Please enable JavaScript to watch this video.</noscript></div><p>[[The mould is made of loam and horse hair, and is dried for weeks.]]</p><h2>[[Transcript]]</h2><p>[[Here you see the core being turned.]]</p></article><div class="recommended"><h3>Watch next</h3><ul><li><a href="/1">How glass is blown</a></li><li><a href="/2">How rope is laid</a></li></ul></div><footer><p>Licence fee information</p></footer></body></html>""",
    "question and notes": """<html><body><div class="topbar"><form class="search"><label>Search</label><input></form></div><div class="page"><div class="story-wrap"><h1>[[Why bread goes stale]]</h1><p>[[It is not drying out. The starch turns back into crystals.]]</p><p>[[Warming the loaf melts them again for an hour.]]</p><aside class="promo"><p>Try our baking course, now with a discount</p></aside><p>[[Freezing stops it altogether.]]</p></div></div><div class="legal"><p>No part may be copied.</p></div></body></html>""",
    "tagged post": """<html><body><div id="header-wrapper"><h1 class="title">Field diary</h1></div><div class="main section" id="main"><div class="blog-posts hfeed"><h2 class="date-header">Tuesday, 4 April</h2><div class="post hentry"><h3 class="post-title entry-title">[[First swallows]]</h3><div class="post-body entry-content"><p>[[Two came in over the weir at noon, low and fast.]]</p><p>[[By evening there were nine on the wire.]]</p></div><div class="post-footer"><span class="post-labels">Labels: <a href="/l">birds</a></span></div></div></div></div><div class="sidebar section" id="sidebar"><div class="widget"><h2>Blog Archive</h2><ul><li><a href="/1">March</a></li><li><a href="/2">February</a></li></ul></div></div></body></html>""",
    "portal": """<html><body><div class="masthead"><ul class="topnav"><li><a href="/m">Mail</a></li><li><a href="/w">Weather</a></li></ul></div><div class="ad-container"><div class="ad">Sponsored: the quiet car</div></div><div class="article__body"><h1 class="article__headline">[[Night trains return]]</h1><div class="article__text"><p>[[Sleeping cars will run again between the two capitals from December.]]</p><p>[[Fares start at thirty, with a bed at ninety.]]</p><p>[[The first train sold out within a day.]]</p></div></div><div class="article__tags"><ul><li><a href="/t">trains</a></li><li><a href="/e">europe</a></li></ul></div><div class="popup modal"><p>Subscribe to read more without adverts</p></div><div class="foot"><p>Imprint and privacy</p></div></body></html>""",
    "tutorial": """<html><body><nav class="toc"><ul><li><a href="#1">Setup</a></li><li><a href="#2">Loops</a></li></ul></nav><main><h1>[[Counting things]]</h1><p>[[A loop does the same step for each item.]]</p><pre><code>[[for x in items: total += 1]]</code></pre><p>[[The total starts at zero.]]</p><table><thead><tr><th>[[step]]</th><th>[[total]]</th></tr></thead><tbody><tr><td>[[1]]</td><td>[[1]]</td></tr></tbody></table></main><nav class="pagination"><a href="/p">Previous</a></nav><footer>Found a mistake? Tell us.</footer></body></html>""",
    "village": """<html><body><center><h1>Lower Marsh Village</h1></center><table><tr><td><a href="a.htm">Church</a></td><td><a href="b.htm">Pub</a></td><td><a href="c.htm">Map</a></td></tr></table><h2>[[The flood of 1953]]</h2><p>[[On the last night of January the wall gave way in three places, and by morning the water stood at the sills of the school.]]</p><p>[[Boats came from the next village at first light.]]</p><p>[[A stone by the green marks how high it rose.]]</p><hr><address>Webmaster: see the parish clerk</address></body></html>""",
    "opinion": """<html><body><div class="o-header"><div class="o-header__nav"><ul><li><a href="/u">US</a></li><li><a href="/c">Companies</a></li></ul></div></div><div class="n-layout__row--content"><div class="o-topper"><h1 class="o-topper__headline">[[In praise of slow post]]</h1></div><div class="n-content-body"><p>[[A letter that takes three days has been thought about for four.]]</p><p>[[It cannot be unsent, and so it is read twice before the flap is shut.]]</p><div class="n-content-recommended"><h3>Recommended</h3><p><a href="/r">The end of the stamp</a></p></div><p>[[We should keep it.]]</p></div><div id="o-comments" class="o-comments"><p>I disagree with the author, as someone who waited two weeks for a cheque that was already spent.</p></div></div><footer class="o-footer"><p>Markets data delayed</p></footer></body></html>""",
    "museum": """<html><body><header><div class="logo">City Museum</div><nav><ul><li><a href="/v">Visit</a></li><li><a href="/s">Shop</a></li></ul></nav></header><main class="page-content"><section class="hero"><h1>[[Clocks of the old town]]</h1></section><section class="text"><p>[[Forty clocks from the town's workshops are on show until spring.]]</p><p>[[The oldest still runs, and strikes a minute late.]]</p></section><section class="text"><h2>[[Opening hours]]</h2><p>[[Daily from ten to five.]]</p></section></main><section class="newsletter"><p>Get news by email</p></section><footer><ul><li>Press</li><li>Jobs</li></ul></footer></body></html>""",
    "forum notice": """<html><body><div class="notice"><p>The forum will be down on Sunday night.</p></div><div class="header"><ul><li><a href="/f">FAQ</a></li><li><a href="/r">Register</a></li></ul></div><div class="entry"><h1>[[Guide to repotting]]</h1><p>[[Choose a pot one size larger. Water the plant the day before.]]</p><ol><li>[[Loosen the roots.]]</li><li>[[Fill with fresh soil.]]</li><li>[[Water and leave in the shade.]]</li></ol></div><div class="footer"><p>Powered by a board</p></div></body></html>""",
    "company": """<html><body><div class="site-header"><div class="nav-links"><a href="/">Home</a></div></div><div class="section"><div class="wrapper"><h1>[[How we make paper]]</h1><p>[[Old cotton is cut, soaked and beaten to a pulp.]]</p><p>[[Each sheet is lifted by hand on a wire frame, pressed between felts and dried in the loft.]]</p><img src="a.png"><p>[[The mill has worked in this way since 1610.]]</p></div></div><div class="cta banner"><p>Order samples now</p></div><div class="site-footer"><p>Registered office</p></div></body></html>""",
    "weather report": """<html><body><div id="topmenu"><ul><li><a href="/n">North</a></li><li><a href="/s">South</a></li></ul></div><div id="text"><h1>[[Storm expected by Friday]]</h1><p>[[A deep low will cross the coast on Thursday night.]]</p><h2>[[What to do]]</h2><p>[[Tie down what is loose, and stay away from the shore.]]</p><svg><title>wind icon</title></svg><p>[[Warnings will be given every three hours.]]</p></div><div id="ads"><p>Waterproof boots from forty</p></div><div id="copyright">The office 2018</div></body></html>""",
}


def split(marked):
    """The page, and for each of its blocks whether it is main text."""
    from fieldloom.llm.html_blocks import blocks

    labels, inside = [], False
    for b in blocks(marked):
        labels.append(inside or "[[" in b.text)
        inside = b.text.rfind("[[") > b.text.rfind("]]") or (inside and "]]" not in b.text)
    page = re.sub(r"\[\[|\]\]", "", marked)
    assert len(blocks(page)) == len(labels)
    return page, labels
