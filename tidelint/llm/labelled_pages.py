"""Labelled pages for training the page model.

Invented layouts. ``y="c"`` marks an element whose text is main content, ``y="b"``
one whose text is not; both hold for what is inside until another mark. Unmarked
elements around marked ones only give structure.
"""

_S = ("The river rose by two feet over night and the lower fields were under water by noon. "
      "Farmers moved their stock to the hill and waited for the rain to end. ")
_T = "Few people in the valley could recall a wetter spring than this one. "
_L = _S + _T + _S

PAGES = [
    f"""<html><body><nav y="b"><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul></nav>
    <div class="ad" y="b">Best prices on boots today.</div><article y="c"><h1>Floods in the valley</h1><p><b>{_T}</b></p><p>{_L}</p><p>{_T}</p><p>Yes.</p></article>
    <footer y="b">&copy; example.org &middot; {_T}</footer></body></html>""",
    f"""<html><body><header y="b"><div class="logo">The Valley Post</div><nav><a href="/a">World</a> <a href="/b">Local</a></nav></header>
    <main><article y="c"><header><h1>Rain again</h1><p>By a reporter</p></header><p>{_L}</p><h2>More to come</h2><p>{_T}</p><ul><li>First the hill road was closed to all traffic.</li>
    <li>Then the bridge.</li></ul><blockquote>{_T}</blockquote></article><aside class="sidebar" y="b"><h3>Most read</h3><ul><li><a href="/1">Ten walks for a wet day</a></li>
    <li><a href="/2">What to cook now</a></li></ul><p>{_T}</p></aside></main><footer y="b"><p>Contact us</p><ul><li><a href="/i">Imprint</a></li></ul></footer></body></html>""",
    f"""<html><body><div id="wrap"><div id="menu" y="b"><ul><li><a href="/x">Start</a></li><li><a href="/y">About</a></li></ul></div>
    <div id="content"><div class="post" y="c"><h2>A note on dikes</h2><div class="entry"><p>{_S}{_S}</p><p>{_T}</p>{_S}</div></div>
    <div id="comments" y="b"><h3>2 comments</h3><div class="comment"><p>{_L}</p></div><div class="comment"><p>I agree. {_T}</p></div>
    <form action="/c"><label>Your name</label><p>Write a comment below.</p></form></div></div><div id="footer" y="b"><p>All rights reserved. {_T}</p></div></div></body></html>""",
    f"""<html><body><div class="cookie-notice" y="b"><p>We use cookies to make this site better. {_T}</p></div><div class="banner" y="b">Sale now on.</div>
    <section class="story" y="c"><h1>Harvest</h1><p>{_T}</p><p>{_L}</p><p>Short.</p><div class="advert" y="b"><p>Buy two, pay one.</p></div><p>{_L}</p><table><tr><td>Wheat</td><td>12</td></tr></table></section>
    <section class="related" y="b"><h3>Related</h3><ul><li><a href="/r">Seeds for dry ground</a></li><li><a href="/q">Old ploughs</a></li></ul></section></body></html>""",
    f"""<html><body><header role="banner" y="b"><h1>My diary</h1><p>Notes from the hill</p></header><div role="navigation" y="b"><a href="/o">Older</a> <a href="/n">Newer</a></div>
    <div role="main"><div class="article-body" y="c"><h1>Monday</h1>{_S}<p>{_T}</p><p>{_L}</p><pre>level 4.2 m</pre><figure><figcaption>The dam at dusk</figcaption></figure></div></div>
    <div role="complementary" class="widget" y="b"><p>{_T}</p></div><div role="contentinfo" y="b">{_T}</div></body></html>""",
    f"""<html><body><form class="search" y="b"><p>Search this site</p></form><div class="breadcrumb" y="b"><a href="/">Home</a> / <a href="/k">Kitchen</a></div>
    <article y="c"><h1>Soup</h1><p>{_T}</p><ol><li>Chop the leeks and wash them well under cold water.</li><li>Boil.</li></ol><p>{_L}</p></article>
    <div class="newsletter" y="b"><h3>Stay in touch</h3><p>Sign up for our letter. {_T}</p></div><div class="share" y="b"><ul><li><a href="/f">Share</a></li></ul></div>
    <section id="responses" class="comments" y="b"><article class="comment"><p>{_L}</p></article><article class="comment"><p>{_T}</p></article></section></body></html>""",
    f"""<html><body><div><div y="b"><a href="/1">One</a> <a href="/2">Two</a> <a href="/3">Three</a></div><div><div y="c"><h1>Plain page</h1><p>{_L}</p><p>{_T}</p><p>{_S}{_T}</p><p>The end.</p></div></div>
    <div y="b"><a href="/t">Terms</a> <a href="/p">Privacy</a></div></div></body></html>""",
    f"""<html><body><header y="b"><p>Weather desk</p></header><p y="c">{_L}</p><p y="c">{_T}</p><p y="c">Dry.</p><h2 y="c">Outlook</h2><p y="c">{_L}</p><footer y="b"><p>{_T}</p></footer></body></html>""",
    f"""<html><body><aside class="notice" y="b"><p>This page is out of date. {_T}</p></aside><main class="content" y="c"><h1>Guide</h1><p>{_L}</p><h2>Steps</h2><ul><li>Read all of this first, then begin with the gate.</li><li>Wait.</li></ul>
    <dl><dt>Gate</dt><dd>{_T}</dd></dl><p>See the <a href="/z">long guide</a> for more. {_T}</p></main><div class="popup" y="b"><p>{_T}</p></div><div class="sponsored" y="b">{_T}</div></body></html>""",
    f"""<html><body><nav class="menu" y="b"><p>Sections</p><ul><li>Art</li><li>Law</li></ul></nav><div class="ad" y="b">{_S}</div><div class="ad" y="b">Cheap.</div><article y="c"><h1>Court rules</h1><p>{_L}</p><p>{_L}</p></article><footer y="b">{_S}</footer></body></html>""",
    f"""<html><body><header y="b"><h1>The long read</h1><p>{_T}</p></header><nav y="b"><a href="/">Home</a></nav><main><article y="c"><h1>Dams</h1><p>{_L}</p><p>Rain.</p></article>
    <aside y="b"><h2>From our partners</h2><p>{_L}</p><p>{_S}</p></aside></main><footer y="b"><p>{_L}</p></footer></body></html>""",
    f"""<html><body><div id="header" y="b"><p>The gazette</p></div><div class="content" y="c"><h1>Wells</h1><p>{_L}</p><p>{_S}</p></div><section class="comments" y="b"><h2>Comments</h2>
    <article><p>{_L}</p></article><article><h4>A reader</h4><p>{_L}</p></article><div><p>{_S}</p></div><p>Nice.</p></section></body></html>""",
    f"""<html><body><article y="c"><h1>Mud</h1><p>{_L}</p><p>{_S}</p><div class="comments" y="b"><p>{_L}</p><p>Nice.</p><p>{_S}</p><div class="reply"><p>{_L}</p></div></div>
    <form y="b"><p>Write to us. {_S}</p><label>Mail</label><p>{_L}</p></form></article><div class="sidebar" y="b"><h3>About</h3><p>{_L}</p></div></body></html>""",
    f"""<html><body><header y="b"><p>{_T}</p><div><p>Since 1901</p></div></header><div class="notice" y="b"><p>{_L}</p><p>{_S}</p></div><div class="article" y="c"><h1>Ice</h1><p>{_L}</p>{_S}</div>
    <div class="comment-list" y="b"><ul><li><p>{_L}</p></li><li><p>{_S}</p></li></ul></div><footer y="b"><p>{_L}</p><p>{_S}</p></footer></body></html>""",
    f"""<html><body><main y="c"><h1>Ferry times</h1><p>{_L}</p><p>{_S}</p></main><aside y="b"><p>{_L}</p><p>{_L}</p><h3>More</h3></aside><form y="b"><p>{_S}</p><p>{_L}</p></form><nav y="b"><p>{_S}</p></nav></body></html>""",
    f"""<html><body><article y="c"><h1>Bees</h1><p>{_L}</p><div class="ad" y="b"><p>{_L}</p><p>Call now.</p></div><p>{_L}</p><p>Hum.</p><aside class="promo" y="b"><p>Buy honey.</p></aside><p>{_L}</p></article></body></html>""",
    f"""<html><body><h1 y="c">Locks</h1><p y="c">{_L}</p><p y="c">Low.</p><p y="c">{_L}</p><p y="c">{_S}</p></body></html>""",
    f"""<html><body><div><div y="b"><a href="/1">One</a> <a href="/2">Two</a></div></div><div><div y="c"><h1>Hedges</h1><p>{_L}</p><p>Green.</p><p>{_L}</p></div></div><div y="b">Copyright</div></body></html>""",
    f"""<html><body><article y="c"><h1>Tides</h1><p>{_L}</p><p>{_L}</p><p>{_S}</p><table><tr><td>High</td><td>Noon</td></tr></table><section class="comments" y="b"><h3>Replies</h3><p>{_L}</p><p>{_L}</p></section>
    <form y="b"><p>{_S}</p><label>Name</label></form></article><footer y="b"><p>{_T}</p></footer></body></html>""",
    f"""<html><body><nav y="b"><p>{_T}</p></nav><article y="c"><h1>Salt</h1><p>{_L}</p><p>{_S}</p><p>{_L}</p><ul><li>{_T}</li><li>Dry.</li></ul></article><div y="b"><form><p>{_T}</p></form></div><footer y="b">{_L}</footer></body></html>""",
]
