"""Pages written and labelled by hand, in layouts of their own: (html, main-text blocks)."""

HAND_PAGES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Harbour bridge reopens | The Evening Post</title>
<style>.a{color:red}</style></head><body class="page-template">
<div id="skip"><a href="#c">Skip to content</a></div>
<header class="site-header"><a href="/">The Evening Post</a><nav><ul><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li><li><a href="/w">Weather</a></li></ul></nav></header>
<main><article><h1>Harbour bridge reopens after two years</h1>
<p>The old harbour bridge opened to traffic again on Monday, two years after engineers found cracks in its northern pier.</p>
<p>Some four hundred people walked across it before the first cars came, the mayor among them.</p>
<aside class="promo"><a href="/sub">Get our newsletter</a></aside>
<h2>What was repaired</h2><ul><li>The northern pier was rebuilt from the river bed up.</li><li>Both decks have new bearings.</li></ul>
<p>The work cost eleven million, two million less than planned.</p></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>About time, I had to drive round for two years.</p></div><div class="comment"><p>Looks lovely!</p></div></section></main>
<footer><p>&copy; 2023 The Evening Post. All rights reserved.</p><ul><li><a href="/p">Privacy</a></li><li><a href="/t">Terms</a></li></ul></footer></body></html>""",
        [
            "Harbour bridge reopens after two years",
            "The old harbour bridge opened to traffic again on Monday, two years after engineers found cracks in its northern pier.",
            "Some four hundred people walked across it before the first cars came, the mayor among them.",
            "What was repaired",
            "The northern pier was rebuilt from the river bed up.",
            "Both decks have new bearings.",
            "The work cost eleven million, two million less than planned.",
        ],
    ),
    (
        """<html><body><div class="navbar"><a href="/">Home</a> | <a href="/r">Recipes</a> | <a href="/about">About</a></div>
<div class="breadcrumb"><a href="/">Home</a> &gt; <a href="/r">Recipes</a> &gt; Soup</div>
<div class="content"><h1>Lentil soup</h1><p>A warm soup for cold days, ready in <b>forty minutes</b>. It keeps well, so make enough for two days.</p>
<table><tr><td>Lentils</td><td>Two cups, washed well.</td></tr><tr><td>Onion</td><td>One, chopped finely.</td></tr></table>
<p>Fry the onion until it is golden.<br>Add the lentils and a litre of water, and let it simmer.</p>
<p>Season with salt, pepper &amp; a little lemon.</p></div>
<div class="sidebar"><h3>More recipes</h3><ul><li><a href="/1">Bean stew</a></li><li><a href="/2">Potato pie</a></li></ul></div>
<div class="cookie-notice"><p>We use cookies to make this site work better for you.</p><button>OK</button></div>
<div class="footer"><p>© Kitchen notes</p></div></body></html>""",
        [
            "Lentil soup",
            "A warm soup for cold days, ready in forty minutes. It keeps well, so make enough for two days.",
            "Lentils",
            "Two cups, washed well.",
            "Onion",
            "One, chopped finely.",
            "Fry the onion until it is golden. Add the lentils and a litre of water, and let it simmer.",
            "Season with salt, pepper & a little lemon.",
        ],
    ),
    (
        """<HTML><BODY><FORM class=search action=/q><INPUT name=q><BUTTON>Search</BUTTON></FORM>
<DIV id=main><DIV class=post><H1>Notes on keeping bees</H1>
<P>I have kept bees for nine years now, and I still learn something each spring.
<P>The first hive I bought was far too small, which I noticed only in July.
<BLOCKQUOTE><P>A hive that is quiet in May is a hive to open.</BLOCKQUOTE>
<P>That is what my neighbour says, and she has been right most years.
<DIV class=share><A href=/f>Share</A> <A href=/t>Tweet</A></DIV></DIV>
<OL class=comment-list><LI class=comment><B>Ann</B><P>My own bees were late too this year, it was so cold.<LI class=comment><B>Bo</B><P>Thank you for this!</OL></DIV>
<ASIDE><UL><LI><A href=/a>Archive</A><LI><A href=/b>Blogroll</A></UL></ASIDE>
<SCRIPT>document.write("<p>Not text at all.</p>")</SCRIPT></BODY></HTML>""",
        [
            "Notes on keeping bees",
            "I have kept bees for nine years now, and I still learn something each spring.",
            "The first hive I bought was far too small, which I noticed only in July.",
            "A hive that is quiet in May is a hive to open.",
            "That is what my neighbour says, and she has been right most years.",
        ],
    ),
    (
        """<html><head><title>install</title></head><body><div class="topbar"><a href="/">docs</a><a href="/api">api</a></div>
<nav class="toc"><ul><li><a href="#1">Install</a></li><li><a href="#2">Configure</a></li></ul></nav>
<article class="prose"><h1>Getting started</h1><p>The tool runs on any machine that has a recent interpreter, and it needs no other package.</p>
<h2>Install</h2><p>Fetch the archive, unpack it and put the folder on your path.</p><pre>tar xf tool.tar.gz
cd tool</pre><h2>Configure</h2><p>Copy the sample settings to your home folder, then change the port if another program uses it.</p>
<dl><dt>port</dt><dd>The port that the server listens on, 8080 by default.</dd><dt>root</dt><dd>The folder that it serves.</dd></dl></article>
<div class="pager"><a href="/prev">Previous</a> <a href="/next">Next</a></div>
<footer class="site-footer"><p>Built with care.</p></footer></body></html>""",
        [
            "Getting started",
            "The tool runs on any machine that has a recent interpreter, and it needs no other package.",
            "Install",
            "Fetch the archive, unpack it and put the folder on your path.",
            "tar xf tool.tar.gz cd tool",
            "Configure",
            "Copy the sample settings to your home folder, then change the port if another program uses it.",
            "port",
            "The port that the server listens on, 8080 by default.",
            "root",
            "The folder that it serves.",
        ],
    ),
    (
        """<html><body><div><div><a href="/">Valley museum</a></div><div><ul><li><a href="/v">Visit</a></li><li><a href="/c">Collection</a></li><li><a href="/j">Join</a></li></ul></div></div>
<div><h1>The mill at Upper Ford</h1><p>The mill was built in 1782, when the valley grew more corn than it could grind by hand.</p>
<p>Its wheel turned until 1931. After a flood in that year the owner sold the stones, and the house stood empty.</p>
<div><img src="m.jpg"><p>Volunteers began to rebuild it in 1974, and today it grinds again on the first Sunday of each month.</p></div>
<p>Bread that is baked from its flour is sold at the door.</p></div>
<div class="advert"><p>Book your summer holiday now and save a third!</p></div>
<div class="widget related"><h4>You may also like</h4><ul><li><a href="/k">The kiln</a></li><li><a href="/f">The forge</a></li></ul></div>
<form class="login"><label>Name</label><input><label>Password</label><input><button>Sign in</button></form>
<div><p>© Valley museum, all rights reserved</p></div></body></html>""",
        [
            "The mill at Upper Ford",
            "The mill was built in 1782, when the valley grew more corn than it could grind by hand.",
            "Its wheel turned until 1931. After a flood in that year the owner sold the stones, and the house stood empty.",
            "Volunteers began to rebuild it in 1974, and today it grinds again on the first Sunday of each month.",
            "Bread that is baked from its flour is sold at the door.",
        ],
    ),
    (
        """<!DOCTYPE html><html><body><header><div class="logo"><a href="/">Campus weekly</a></div></header>
<div class="consent"><p>By reading on you accept our use of cookies.</p><button>Accept</button></div>
<div class="story"><h1>Library stays open at night</h1><p class="lead">From next term on, the main library will not close before two in the morning, the board said on Friday.</p>
<p>Students had asked for longer hours since the spring; more than <a href="/petition">nine hundred of them</a> signed a letter.</p>
<figure><img src="l.jpg"><figcaption>The reading room, which seats three hundred people.</figcaption></figure>
<p>The extra hours are paid for by a gift, so fees will not rise.</p></div>
<div class="tags"><a href="/t/1">library</a> <a href="/t/2">campus</a></div>
<div id="disqus" class="discussion"><h3>Replies</h3><div><p>Finally, thank you so much to all who signed.</p></div></div>
<aside><h3>Trending</h3><ul><li><a href="/x">Canteen prices</a></li></ul></aside></body></html>""",
        [
            "Library stays open at night",
            "From next term on, the main library will not close before two in the morning, the board said on Friday.",
            "Students had asked for longer hours since the spring; more than nine hundred of them signed a letter.",
            "The reading room, which seats three hundred people.",
            "The extra hours are paid for by a gift, so fees will not rise.",
        ],
    ),
    ("""<html><body><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav><footer><p>© Nobody</p></footer></body></html>""", []),
]
