"""Labelled pages: (html, strings that only the article's blocks contain)."""

_A = "Main story sentence one, which goes on for a while. It has a second sentence, too."
_B = "The main report continues with more detail; nobody had expected this much of it."
_C = "Main short note."
_M = f"<p>{_A}</p><p>{_B} <a href='/x'>Main link</a> and the main text after it.</p><p>{_C}</p>"
_NAV = "<ul><li><a href='/'>Home</a></li><li><a href='/news'>News</a></li><li><a href='/about'>About us</a></li></ul>"
_SIDE = "<h3>Popular now</h3><p>Another headline that leads elsewhere, with a few words on it.</p><ul><li><a href='/1'>One more</a></li></ul>"
_COMMENTS = "<h2>3 comments</h2><div class='comment'><b>anna</b><p>I liked this very much. Thanks for writing it up, it was a good read.</p></div><div class='comment'><p>I disagree with all of it.</p></div>"
_FORM = "<label>Your e-mail</label><input name='e'><p>Sign up for our newsletter and never miss a thing.</p><button>Send</button>"
_COOKIE = "<p>We use cookies to make this site work. By going on you agree to them.</p>"
_FOOT = "<p>&copy; 2020 The site. All rights reserved.</p><p>Some words of the house, about who we are and what we do here.</p>"
_AD = "Buy the best shoes in town now. They are cheap, and they last."
_MAIN = ("Main ", "main ")


def _page(body: str) -> str:
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LABELLED = [
    (_page(x), _MAIN)
    for x in (
        f"<header><h1>Site</h1></header><nav>{_NAV}</nav><article><h1>Main title</h1>{_M}</article><aside>{_SIDE}</aside><footer>{_FOOT}</footer>",
        f"<nav>{_NAV}</nav><div class='ad'>{_AD}</div><article><h1>Main title</h1>{_M}</article><footer>&copy; site &middot; {_SIDE}</footer>",
        f"<div id='header'><p>Site name</p>{_NAV}</div><div id='content'><h1>Main title</h1>{_M}</div><div id='sidebar'>{_SIDE}</div><div id='footer'>{_FOOT}</div>",
        f"<div class='menu'>{_NAV}</div><main><h1>Main title</h1>{_M}<div class='advert'>{_AD}</div><p>{_B}</p></main><section class='comments' id='comments'>{_COMMENTS}</section><footer>{_FOOT}</footer>",
        f"<div class='cookie-notice'>{_COOKIE}</div><nav>{_NAV}</nav><article><header><h1>Main title</h1></header>{_M}<aside class='related'>{_SIDE}</aside><p>{_B}</p><form>{_FORM}</form></article><div class='comments'>{_COMMENTS}</div><footer>{_FOOT}</footer>",
        f"<div class='topbar'>{_NAV}</div><div class='post-body entry-content'><h2>Main title</h2>{_M}</div><div class='comment-list'>{_COMMENTS}</div><div class='sidebar widget'>{_SIDE}</div><div class='site-footer'>{_FOOT}</div>",
        f"<article><h1>Main title</h1>{_M}<section class='comments'>{_COMMENTS}</section><div class='share social'><p>Share this with all of your friends.</p></div></article><div class='banner promo'>{_AD}</div>",
        f"<header>{_NAV}<p>The paper of the town, since long ago. Read it daily.</p></header><div class='sponsored'><p>{_AD}</p></div><div class='article-text'><p>{_A}</p><blockquote>Main quote of somebody.</blockquote><ul><li>Main first point</li><li>Main second point</li></ul><p>{_C}</p></div><form class='subscribe'>{_FORM}</form><footer>{_FOOT}</footer>",
        f"<table class='nav'><tr><td>{_NAV}</td></tr></table><div role='main'><h1>Main title</h1>{_M}</div><div role='complementary'>{_SIDE}</div><div role='contentinfo'>{_FOOT}</div><div id='comments'>{_COMMENTS}</div>",
        f"<div class='notice'><p>This site will be down on Monday. We are sorry.</p></div><article><p>{_A}</p><div class='ad'>{_AD}</div><p>{_B}</p><figure><img src='a'></figure><p>{_C}</p></article><div class='related-posts'>{_SIDE}</div>",
        f"<nav>{_NAV}</nav><div class='ads'><p>{_AD}</p></div><article><h1>Main title</h1><p>{_C}</p></article><footer>{_FOOT}</footer>",
        f"<div class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/n'>News</a></div><article class='post'><h1>Main title</h1><p>{_A}<br>{_B}</p><table><tr><td>Main cell one</td><td>Main cell two</td></tr></table></article><aside>{_SIDE}</aside><div class='newsletter'>{_FORM}</div>",
    )
]
