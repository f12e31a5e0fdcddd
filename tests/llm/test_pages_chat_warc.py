import base64
import hashlib
import html
import random
import re

import pytest

from tidewatch.llm import chatformat, maintext, warc

# ---------------------------------------------------------------- main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><h1>Head &amp; more</h1><p><b>First&nbsp;  one.<br><p>Second <i>it</i>alic &lt;x&gt;</p><div class="share-box">Share</div>
<ul><li>One<li>Two</ul><table><tr><td>a</td><td>b</td></tr></table><form><button>Go</button></form><p hidden>no</p>
<section class="comments"><article><p>I disagree</p></article></section></article>
<aside>Side</aside><div role="alert">Notice</div><footer>&copy; foot</footer>"""


def test_roles_of_elements():
    assert maintext.main_text(PAGE, "h", ()) == "Head & more\n\nFirst one.\n\nSecond italic <x>\n\nOne\n\nTwo\n\na\n\nb"


def test_without_article_and_broken_markup():
    assert maintext.main_text("<main><p>a</main><p>b", "h", ()) == "a"
    assert maintext.main_text("plain &eacute; text", "h", ()) == "plain é text"
    assert maintext.main_text("<p>x < y</p><p", "h", ()) == "x < y"
    for page in (None, "", "<!-- open", "<script>never closed", "</p></b>", "<a href='x>y</a>", "<" * 50, "<p " + "a='" * 500):
        assert isinstance(maintext.main_text(page, "h", ()), str)


def test_wrappers_that_only_look_unwanted():
    story = "<article><h1>Head</h1><p>Text</p></article>"
    for wrapper in ('class="content has-sidebar"', 'id="no-comments-main"', 'style="overflow:hidden"', 'title="a hidden role=menu"', 'data-id="sidebar"', "data-role=banner",
                    'class="menu-open with_banner"', 'data-hidden="1"', 'class="widget"', "id=sidebar", 'role="form"', 'aria-hidden="true"'):
        assert maintext.main_text(f'<nav>Menu</nav><div {wrapper}><div class="ad">Buy</div>{story}</div>', "h", ()) == "Head\n\nText", wrapper
        assert maintext.main_text(f"<div {wrapper}><main>{story}</main></div>", "h", ()) == "Head\n\nText", wrapper
    assert maintext.main_text(f"<form action=x><aside><article>Card</article></aside>{story}</form>", "h", ()) == "Head\n\nText"
    for wrapper in ('class="a sidebar"', "hidden", 'HIDDEN=""', 'class="site-nav"', 'id="comments_area"', "role=menu", 'style="x" aria-hidden="true"'):
        assert maintext.main_text(f"<div {wrapper}><p>no</p></div>{story}", "h", ()) == "Head\n\nText", wrapper
        assert maintext.main_text(f"<div {wrapper}><article><p>no</p></article></div>{story}", "h", ()) == "Head\n\nText", wrapper


def test_template_is_removed_by_count(spark):
    rows = [(k, f"https://a.example/{k}", f"<body><div>Welcome to the site</div><div><p>Text number {k}</p></div></body>") for k in range(6)]
    rows += [(10 + k, f"https://b.example/{k}", f"<body><div>Welcome to the site</div><p>Other {k}</p></body>") for k in range(3)]
    rows += [(20 + k, "https://a.example/same", "<article><div><p>A copy</p></div></article>") for k in range(8)] + [(None, None, None), (30, "::bad[", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as key", "url as page")
    expected = {k: f"Text number {k}" for k in range(6)} | {10 + k: f"Welcome to the site\n\nOther {k}" for k in range(3)} | {20 + k: "A copy" for k in range(8)} | {None: "", 30: ""}
    for keys in (250_000, 0):
        got = maintext.extract_main_text(df, broadcast_keys=keys).collect()
        assert len(got) == len(rows) and {r.page_id: r.text for r in got} == expected
        assert all(r.n_chars == len(r.text) for r in got)
    assert maintext.extract_main_text(df.filter("false")).count() == 0


def test_host_counts_decide_before_roles(spark):
    story = lambda k: f"<div><p>Story number {k} told at some length, with words enough</p></div>"
    rows, expected = [], {}

    def add(host, k, page, text):
        expected[len(rows)] = text
        rows.append((len(rows), f"https://{host}/{k}", page))

    for k in range(12):
        told = story(k)[8:-10]
        # The same teaser card as the only article; one paragraph inside each article; a card of its own on each page.
        add("card.example", k, f"<div>Menu</div>{story(k)}<article><p>Card</p></article>", told)
        add("plea.example", k, f"<div>Menu</div><article>{story(k)}<p>Please give</p></article>", told)
        add("own.example", k, f"<div>Menu</div>{story(k)}<article><p>Card {k}</p></article>", f"{told}\n\nCard {k}")
    for k in range(200):
        # No article: a paragraph met six times by chance among two hundred pages stays, and what one page in five has goes.
        add("large.example", k, f"<div>Menu</div>{story(k)}{'<p>Chance</p>' if k < 6 else ''}{'<div>Section</div>' if k % 5 == 0 else ''}", story(k)[8:-10] + ("\n\nChance" if k < 6 else ""))
    for k in range(4):
        add("four.example", k, f"<div>Menu</div>{story(k)}", story(k)[8:-10])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for keys in (250_000, 0):
        assert {r.page_id: r.text for r in maintext.extract_main_text(df, broadcast_keys=keys).collect()} == expected


def test_pages_query(spark, sf):
    from tidewatch.llm.queries import op3_html_extraction
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op3_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b)


# ---------------------------------------------------------------- chat

def test_escapes_read_back():
    random.seed(2)
    bits = [*chatformat.CONTROLS, "\\", "<", "[", "\n", "a", "|>", "INST]", "é"]
    turns = [(random.choice(["user", "assistant", "system", "", "to[SEP]ol", "\\"]), "".join(random.choice(bits) for _ in range(random.randint(0, 12)))) for _ in range(400)]
    text = chatformat.BEGIN + "".join(chatformat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in turns)
    assert [(r, t) for r, t, *_ in chatformat.read_turns(text)] == turns
    assert all(not any(c in chatformat.escape(t) for c in chatformat.CONTROLS) for _, t in turns)


def test_typed_parts():
    piece, start, end, attachments = chatformat.format_turn("user", [
        {"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 29, "height": 14}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": None, "text": " and "}, {"type": "document", "ref": None, "pages": 2}])
    assert piece == "[INST]see <|media:image:0|><|media:audio:1|> and <|media:document:2|>[/INST]"
    assert [(k, ref, n) for k, ref, _, n in attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", None, 512)]
    assert all(piece[at:].startswith(f"<|media:{k}:{n}|>") for n, (k, _, at, _) in enumerate(attachments))
    assert piece[start:end].startswith("see ") and piece[end:] == "[/INST]"


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b</s>"), (1, 0, "user", "a[INST]"), (2, 0, None, None), (3, 0, "assistant", ""), (3, 1, "assistant", "x\\"), (3, 1, "assistant", "x\\"),
            (None, 0, "user", "q"), (None, None, "user", "p"), (4, 0, "user", "é" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "text as piece", "turn as first")
    expected = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        expected[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    formatted = chatformat.format_conversations(df)
    got = chatformat.read_conversations(formatted).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected and len(got) == len(expected)
    assert {r.conv_id: r.formatted_chars for r in got} == {r[0]: r[1] for r in formatted.selectExpr("conv_id", "length(piece) as n").groupBy("conv_id").sum("n").collect()}
    assert chatformat.read_conversations(chatformat.format_conversations(df.filter("false"))).count() == 0


def test_chat_query(spark, sf):
    from tidewatch.llm.queries import op4_chat_formatting
    got = {r.conv_id: r for r in op4_chat_formatting(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
    said = "</s>[INST] ok [/INST]"
    assert got[-7].loss_chars == len(said) and got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


# ---------------------------------------------------------------- archives

def test_seekable_bundle_frames():
    frames = [warc.zstandard.ZstdCompressor().compress(x) for x in (b"one", b"two" * 50)]
    bundle = b"".join(frames) + warc.footer([(len(frames[0]), 3), (len(frames[1]), 150)])
    assert [warc.read_frame(bundle, e) for e in warc.seek_table(bundle)] == [b"one", b"two" * 50]
    assert warc.zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"onetwo" + b"two" * 49


def test_archives(spark, monkeypatch):
    rows = [(5, "http://a/", "same"), (3, "http://b/é x\n", "same"), (9, None, "same"), (4, "u", ""), (2, "u", None), (7, "u", "big" * 200_000), (None, "u", "same"),
            (8, "u", "only"), (8, "u", "only"), (None, "v", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as digest", "page_id as refers_to").repartition(2)
    for least in (0, 5):
        first = {}
        for page, _, text in rows:
            key = text or ""
            first[key] = min((x for x in (first.get(key), page) if x is not None), default=None)
        expected = []
        for page, _, text in rows:
            body = (text or "").encode()
            revisit = len(body) >= least and page != first[text or ""]
            expected.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", first[text or ""] if revisit else None))
        got = warc.archive_pages(df, least)
        assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(expected, key=str)
    assert warc.archive_pages(df.filter("false")).count() == 0


def test_archive_query(spark, sf):
    from tidewatch.llm.queries import op5_warc
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op5_warc(spark, sf).collect()
    assert {r.page_id: r.payload_digest for r in got} == {i: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode() for i, t in pages.items()}


STORY = "The harbour master counted the boats twice that morning, and each time one more had come in under the fog than the log allowed for. " * 3
EXTRA = "Readers wrote that the tide tables had been wrong for a week and that nobody had told the ferry crews about any of it at all."


@pytest.mark.parametrize("wrap", ['<div class="legal">', '<div id="related">', '<section class="modal">', '<div class="copyright notice">', '<div class="has-comments">', '<div class="skip">'])
def test_doubtful_names_do_not_lose_a_story(wrap):
    page = f"<html><body><nav><a href=/>home</a></nav>{wrap}<p>{STORY}</p></div></section></body></html>"
    assert maintext.main_text(page, "h", ()) == " ".join(STORY.split())


@pytest.mark.parametrize("other", ["user-comments", "comment-thread", "post-comments", "cookie-notice", "newsletter-signup", "breadcrumb-trail"])
def test_compound_names_go_on_small_hosts(other):
    page = f"<body><div class=story><p>{STORY}</p></div><div class='{other}'><p>{EXTRA}</p></div></body>"
    assert maintext.main_text(page, "h", ()) == " ".join(STORY.split())


def test_teasers_short_notices_and_hidden_text_go():
    teasers = "".join(f"<li><a href=/{i}>Another headline of the day number {i}</a></li>" for i in range(9))
    page = (f"<body><p>{STORY}</p><div class='related-posts'><ul>{teasers}</ul></div><div class=notice>Saved for later.</div><div style='display:none'><p>{EXTRA}</p></div>"
            f"<p style='color:red; visibility: hidden'>{EXTRA}</p><div style='overflow:hidden'><p>{EXTRA}</p></div></body>")
    assert maintext.main_text(page, "h", ()) == " ".join(STORY.split()) + "\n\n" + EXTRA


def test_a_story_outside_a_short_main_stays():
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(50))
    assert maintext.main_text(f"<body><main><p>{a}</p></main><div><p>{b}</p></div></body>", "h", ()) == f"{a}\n\n{b}"
    assert maintext.main_text(f"<body><main><p>{a} {a} {a}</p></main><div><p>{b}</p></div></body>", "h", ()) == f"{a} {a} {a}"
