"""Extraction, chat formatting, secrets, the pipeline and the registered SQL."""

import base64
import bz2
import glob
import gzip
import hashlib
import html
import lzma
import os
import random
import re
import urllib.parse
import weakref
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tesselon.llm import chat_format, decontaminate, html_text, near_dup, pieces, registry, secret_scan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = c.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    df = registry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, map(list, df.select(*names).collect()))) == sorted(map(repr, map(list, cur.fetchall())))


def test_chat_template_is_reversible(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "BLOCK", 3)
    odd = ["<|turn|>", "<|", "<||", "a<", "|b", "<|end|>user", "", None, "é漢\n", "<|part|><|part|>", "<|||x"]
    r = random.Random(0)
    rows = []
    for conv in range(8):
        for turn in range(r.randint(1, 14)):
            rows.append((conv, turn, r.choice(["user", "assistant", "assistant", "<|x", None]), r.choice(odd), "extra"))
    rows += [(50, None, "user", "n", "x"), (50, 1, "user", "b", "x"), (50, 1, "user", "b", "x"), (50, 1, "user", "a", "x"), (None, 1, "user", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_format.format_chats(df)
    got = {x["conv_id"]: x for x in chat_format.digests(chats).collect()}
    parsed = {x["conv_id"]: [(t["role"], t["text"]) for t in x["t"]] for x in chats.select("conv_id", chat_format.parsed(F.col("formatted")).alias("t")).collect()}
    strings = {x["conv_id"]: x for x in chats.select("conv_id", "formatted", chat_format.loss_spans(F.col("formatted")).alias("s")).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted((((t is not None), t or 0, role or "", text or "") for c, t, role, text, _ in rows if c == conv))
        turns = [(x[2], x[3]) for x in turns]
        assert parsed[conv] == turns
        g = got[conv]
        assert g["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        s = strings[conv]
        masked = "".join(re.sub(r"<\|(\|+)", r"<\1", s["formatted"][a["start"] : a["end"]]) for a in s["s"])
        assert masked == loss
        merged = sum(1 for i, x in enumerate(turns) if i == 0 or turns[i - 1][0] != x[0])
        assert s["formatted"].count("<|turn|>") == merged and s["formatted"].count("<|end|>") == merged
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> -->
<article><h1>Head&amp;line</h1><p>One <b>bold</b>&nbsp;word<br>next<p>Two   lines
here</p><aside>Aside</aside><form><p>Mail</p></form><div id="comments"><p>Reader says</p></div><p>x &lt; y &eacute;</p></article>
<div class="ad">Buy</div><footer>&copy; me</footer></body></html>"""


def test_article_text(spark):
    assert html_text.main_text(PAGE) == "Head&line One bold word next Two lines here x < y é"
    assert html_text.main_text("<article><p>a</p><p>b<script>x") == "a b"
    assert html_text.main_text("<article>a <b>b</b>c</article><p>tail") == "a bc"
    df = spark.createDataFrame([(1, "u", PAGE, "q"), (2, "u", None, "q"), (3, None, "", "q"), (3, None, "", "q")], "page_id long, url string, html string, text string")
    got = html_text.extract(df.select("page_id", "url", "html"), ["page_id", "url"]).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 51), (2, 0), (3, 0), (3, 0)]


def test_block_rules_without_structure():
    prose = "This is the text of a story that was told to us by the people who have lived in the old town for many years. " * 3
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><h2>Title here</h2><div>{prose}</div><div>Short one.</div><div>{prose}</div><div>© 2020</div><div>Contact</div></body>"
    clean = " ".join(prose.split())
    assert html_text.main_text(page) == f"Title here {clean} Short one. {clean}"


PROSE = "This is the text of a story that was told to us by the people who have lived in the old town for many years. " * 3


def test_density_decides_on_pages_with_articles():
    clean = PROSE.strip()
    card = "<article><h3><a href=1>Other story</a></h3><p>A teaser about what the mayor said in the town.</p></article>"
    wrapped = "<article><a href=1><h3>Other story</h3><p>A teaser about what the mayor said in the town.</p></a></article>"
    for c in (card, wrapped):
        assert html_text.main_text(f"<body><div>{PROSE}</div><div>{PROSE}</div>{c * 3}</body>") == f"{clean} {clean}"
        assert html_text.main_text(f"<main><h1>Title</h1><div>{PROSE}</div>{c}</main>") == f"Title {clean}"
    lead = "The people of the old town have told us what they have seen in it for many years."
    assert html_text.main_text(f"<article><p>{lead}</p></article><div>{PROSE}</div><div>{PROSE}</div><div>{PROSE}</div>") == f"{lead} {clean} {clean} {clean}"
    junk = "<p>Share this</p><p>Print</p><ul><li><a href=1>Another story of the town</a></li><li><a href=2>And one more</a></li></ul><p>© 2020 Paper</p>"
    assert html_text.main_text(f"<article><h1>Title</h1><p>By A. Writer</p><p>{PROSE}</p><p>Short one.</p><ul><li>Milk</li><li>Eggs</li></ul><p>See <a href=3>this</a> for more of it.</p>{junk}</article><p>tail</p>") == f"Title By A. Writer {clean} Short one. Milk Eggs See this for more of it."
    assert html_text.main_text(f"<article><p>{PROSE}</p><aside>Buy</aside><p>The end.</p></article>") == f"{clean} The end."


def test_scripts_end_at_their_end_tag_and_long_notices_stay():
    clean = PROSE.strip()
    assert html_text.main_text(f"<script src=x />var a = 'the of and to in';</script><div>{PROSE}</div><svg/><div>{PROSE}</div>") == f"{clean} {clean}"
    assert html_text.main_text(f"<div>{PROSE}</div><div>© {PROSE}</div><div>© 2020 The Paper</div>") == f"{clean} © {clean}"


def test_names_are_matched_whole():
    clean = PROSE.strip()
    for wrapper in ('div class="content-sidebar-wrap"', 'div class="layout has-sidebar"', 'div data-id="comments"', 'div title="hidden gem"', 'a name="x"', "title-bar", "map-view", "video-player", "nav-page"):
        assert html_text.main_text(f"<{wrapper}><div>{PROSE}</div></{wrapper.split()[0]}>") == clean, wrapper
    for name in ("sidebar", "cookie-notice", "site-footer", "post-comments"):
        assert html_text.main_text(f'<div>{PROSE}</div><div class="x {name}">{PROSE}</div>') == clean


BOILERPLATE = """id="disqus_thread"|class="user-comments"|class="comment-body"|class="sidebar-left"|class="main-nav"|class="ad-container"|class="cookie-consent-wrapper"|class="comments"|class="related-posts"
class="userComments"|id="sidebarLeft"|class="x c-comment__body y"|class="comments-area"|class="share-buttons"|class="newsletter-signup-form"|class="post-navigation"|class="article-comments"
class="header-ad-slot"|class="widget_text"|class="block--ad"|class="comment_content"|id='google-ad-1'|class=gdpr-popup""".replace("\n", "|").split("|")
CONTENT = """content-with-sidebar|has-sidebar|comment-policy-article|main-content|no-comments|page--sidebar-left|elementor-widget-container|ad-hoc-report|cookie-recipes|side-effects|navigation-guide
article-body|post-content|entry-content|with-comments|article-and-comments|story-text|shadow|download|content-sidebar-wrap""".replace("\n", "|").split("|")


@pytest.mark.parametrize("name", BOILERPLATE)
def test_boilerplate_by_its_name(name):
    clean, other = PROSE.strip(), PROSE.replace("story", "rumour")
    box = f"<div {name}><p>{other}</p><p>{other}</p></div>"
    assert html_text.main_text(f"<article><h1>Title</h1><p>{PROSE}</p></article>{box}") == f"Title {clean}"
    assert html_text.main_text(f"<article><h1>Title</h1><p>{PROSE}</p>{box}<p>The end.</p></article>") == f"Title {clean} The end."
    assert html_text.main_text(f"<div><p>{PROSE}</p><p>{PROSE}</p></div>{box}") == f"{clean} {clean}"


@pytest.mark.parametrize("name", CONTENT)
def test_content_by_its_name(name):
    clean = PROSE.strip()
    for page in (f'<div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div>', f'<div>{PROSE}</div><div id="{name}"><p>{PROSE}</p></div>'):
        assert html_text.main_text(page) == f"{clean} {clean}"


def test_a_page_inside_a_box_of_boilerplate_is_read_by_whole_names():
    clean = PROSE.strip()
    assert html_text.main_text(f'<div class="three-col-sidebar"><p>{PROSE}</p><p>{PROSE}</p><div class="comments">{PROSE}</div></div>') == f"{clean} {clean}"


def test_generated_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in html_text.op4_html_text(spark, SF).collect()}
    for p in pages:
        m = re.search(r"<article>(.*?)(</article>|\Z)", p["html"], re.S)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", m[1])) if m else ""
        assert got[p["page_id"]] == " ".join(html.unescape(inner).split())


SECRET = 'token = "abcdef0123456789abcd"'
B64 = base64.b64encode(SECRET.encode()).decode()


@pytest.mark.parametrize(
    "hidden",
    [B64, base64.b64encode(B64.encode()).decode(), urllib.parse.quote(B64), base64.b64encode(zlib.compress(SECRET.encode())).decode(), base64.b64encode(gzip.compress(B64.encode())).decode(), "".join(f"\\u{ord(c):04x}" for c in SECRET), "".join(f"&#{ord(c)};" for c in SECRET)],
)
def test_layers_are_decoded_and_mapped(hidden):
    text = f"é before {hidden} after"
    base, added = secret_scan.scan(text)
    assert not [x for x in base if x[0] == "assign"]
    kind, a, z = next(x for x in added if x[0] == "assign")
    assert 8 <= a and z <= 9 + len(hidden) and z - a >= len(hidden) - 6


@pytest.mark.parametrize(
    "hidden",
    ["&quot;password&quot;: &quot;abcdefghijklmnop&quot;", "\\u0022token\\u0022: \\u0022abcdefghijklmnop\\u0022", "token: abcdef%2Bghijklmnop", "pass&#119;ord = abcdefghijkl", 'password%3D"abcdefghijklmnop"', "p%61ss&#119;ord\\u003a abcdefghijkl"],
)
def test_partly_encoded_secrets(spark, hidden):
    text = f"é a %41 line\n{hidden} 漢 after"
    kind, a, z = next(x for x in secret_scan.scan(text)[1] if x[0] == "assign")
    value = re.search(r"abc\S*[lp]", hidden)
    assert 12 <= a < 12 + value.start() and z == 13 + value.end()
    got = secret_scan.redacted(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert "abcdef" not in got and got.startswith("é a %41 line\n") and " 漢 after" in got


def packed(*members, junk=b""):
    return base64.b64encode(junk + b"".join(map(gzip.compress, members))).decode()


@pytest.mark.parametrize(
    "hidden",
    ["http://h/?q=caf%E9&api_key%3Dabcdefghijklmnop", base64.b64encode(b"\xff\x00\x01\x02 " + SECRET.encode()).decode(), base64.b64encode(zlib.compress(b"\xfe\x01\x02" + SECRET.encode())).decode(), packed(b"first member", SECRET.encode()), packed(SECRET.encode(), junk=b"\xff"), packed(b"a " * 40_000_000 + SECRET.encode())],
    ids=["latin", "binary", "zlib", "members", "beside", "large"],
)
def test_unclean_layers_are_scanned(hidden):
    assert any(x[0] == "assign" and 2 <= x[1] < x[2] <= 2 + len(hidden) for x in secret_scan.scan(f"x {hidden} y")[1])


@pytest.mark.parametrize("wide", [20, 64, 76])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n  "])
def test_wrapped_base64(wide, end):
    body = base64.b64encode(f"some words first, then password = {'q9' * 12} and some more of them after that".encode()).decode()
    hidden = end.join(body[i : i + wide] for i in range(0, len(body), wide))
    found = [x for x in secret_scan.scan(f"é\n{hidden}\nafter")[1] if x[0] == "assign"]
    if wide < secret_scan.BASE64_MIN:
        return
    a, z = found[-1][1:]
    part = "".join(f"é\n{hidden}\nafter"[a:z].split())
    assert body.index(part) // 4 <= len("some words first, then password") // 3 and b"q9q9q9q9" in base64.b64decode(part[-body.index(part) % 4 :][: len(part) // 4 * 4 - 4])


@pytest.mark.parametrize("pack", [zlib.compress, gzip.compress, bz2.compress, lzma.compress, lambda x: zlib.compress(x, wbits=-15)], ids=["zlib", "gzip", "bz2", "xz", "deflate"])
def test_kinds_of_compression(pack):
    for inside in (SECRET.encode(), pack(SECRET.encode() * 3)):
        hidden = base64.b64encode(pack(inside) + (b"" if inside[:1] == b"t" else b"")).decode()
        if inside[:1] == b"t":
            assert any(x == ("assign", 2, 2 + len(hidden)) for x in secret_scan.scan(f"x {hidden} y")[1])
    assert any(x[0] == "assign" for x in secret_scan.scan("".join(f"%{c:02X}" for c in pack(SECRET.encode())))[1])


def plain_layers(cells):
    """Layers of a list of (character, start, end) by the rules, cell by cell."""
    text = "".join(c for c, _, _ in cells)

    def of_bytes(data, where):  # where(first byte, last byte) -> span
        out, at = [], 0
        while at < len(data):
            for n in (1, 2, 3, 4):
                try:
                    ch = data[at : at + n].decode()
                    break
                except UnicodeDecodeError:
                    continue
            else:
                ch, n = chr(data[at]), 1
            out.append((ch, *where(at, at + n)))
            at += n
        return out

    def packed(data, span):
        for wbits in (47, -15):
            try:
                d = zlib.decompressobj(wbits)
                got = d.decompress(data)
                if d.eof and got and (wbits > 0 or not d.unused_data and not re.search(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]", data)):
                    return [(c, *span) for c, _, _ in of_bytes(got, lambda a, z: span)]
            except zlib.error:
                pass
        return None

    for m in re.finditer(r"[^\n]+", text):
        for one in (r"%[0-9A-Fa-f]{2}", r"\\u[0-9A-Fa-f]{4}", r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,31});"):
            if not re.search(one, m[0]):
                continue
            out, at = [], m.start()
            for x in re.finditer(f"(?:{one})+" if one[0] == "%" else one, text[: m.end()][m.start() :]):
                a, z = m.start() + x.start(), m.start() + x.end()
                out += cells[at:a]
                if one[0] == "%":
                    out += of_bytes(bytes.fromhex(x[0].replace("%", "")), lambda b, e, a=a: (cells[a + 3 * b][1], cells[a + 3 * e - 1][2]))
                else:
                    got = html.unescape(x[0]) if x[0][0] == "&" else chr(int(x[0][2:], 16))
                    out += [(c, cells[a][1], cells[z - 1][2]) for c in got]
                at = z
            yield out + cells[at : m.end()], text[m.start() : m.end()]
    for m in re.finditer(r"[^\s<>\"]+", text):
        if re.search(r"%[0-9A-Fa-f]{2}", m[0]):
            got = packed(urllib.parse.unquote_to_bytes(m[0]), (cells[m.start()][1], cells[m.end() - 1][2]))
            if got:
                yield got, m[0]
    for m in re.finditer(r"[A-Za-z0-9+/]{22,}={0,2}", text):
        body = m[0].rstrip("=")
        if len(body) % 4 != 1:
            data = base64.b64decode(body + "=" * (-len(body) % 4))
            got = packed(data, (cells[m.start()][1], cells[m.end() - 1][2]))
            if got:
                yield got, m[0]
            yield of_bytes(data, lambda b, e, m=m, n=len(body): (cells[m.start() + b * 8 // 6][1], cells[m.start() + min(n, -(-e * 8 // 6)) - 1][2])), m[0]


def plain_scan(text):
    base, added, done = set(base_spans(text)), set(), set()

    def go(cells, seen):
        for out, source in plain_layers(cells):
            inner = "".join(c for c, _, _ in out)
            if not inner or inner in seen or inner == source or tuple(out) in done:
                continue
            done.add(tuple(out))
            added.update((k, out[a][1], out[z - 1][2]) for k, a, z in base_spans(inner))
            go(out, seen | {inner})

    go([(c, i, i + 1) for i, c in enumerate(text)], {text})
    return sorted(added - base)


def test_added_spans_equal_brute_force():
    r = random.Random(11)
    some = lambda f: lambda t: "".join(f(c) if r.random() < 0.4 else c for c in t)
    ways = [urllib.parse.quote, some(lambda c: "".join(f"%{b:02x}" for b in c.encode())), some(lambda c: f"\\u{ord(c):04x}" if ord(c) < 65536 else c), some(lambda c: f"&#{ord(c)};"), lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode())).decode(), lambda t: base64.b64encode(zlib.compress(t.encode())).decode(), lambda t: urllib.parse.quote(zlib.compress(t.encode())), html.escape]
    things = [SECRET, "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, "api_key: 'é" + "k" * 14 + "'", "passwd=" + "Z" * 13 + "é secret : " + "y" * 12]
    hits = 0
    for _ in range(120):
        t = r.choice(things)
        for _ in range(r.randint(1, 3)):
            t = f"{r.choice(['', 'é ', 'a=b '])}{r.choice(ways)(t)}"
        t = f"{r.choice(['', 'one é two ', 'line\n'])}{t}{r.choice(['', ' tail', '\né next'])}"
        got, want = secret_scan.scan(t)[1], plain_scan(t)
        hits += bool(want)
        assert sorted(got) == want, t
    assert hits > 60


def test_long_texts_stay_small():
    import tracemalloc

    line = "word " * 400_000 + "&amp; password%3D" + "q1" * 10 + " " + "\\u0041" * 200_000 + " " + "%41" * 300_000
    tracemalloc.start()
    _, added = secret_scan.scan(line)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert any(x[0] == "assign" and x[1] == 2_000_006 for x in added) and peak < 30 * len(line)


def test_compressed_pieces_overlap(monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 20)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    for n in range((1 << 20) - 40, (1 << 20) + 40, 7):
        assert secret_scan.scan(packed(b"-" * n + b" " + SECRET.encode() + b"." * (1 << 21)))[1], n


def base_spans(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if m.end() - m.start() >= 16]
    return sorted(out, key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))


def test_base_spans_equal_brute_force(spark):
    odd = ["PassWD: 'abcdefghijkl'", "a" * 15, "a" * 16, "AKIA" + "B" * 13, "AKIA" + "B" * 14, "api_key=short token=longenough123", None, "", "%41%41 \\u0041 &amp;", "ſecret=abcdefghijkl", "0" * 10, "0" * 10]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(odd)], "doc_id long, text string, spans string")
    df = df.unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit("s").alias("spans")))
    texts = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for r in secret_scan.scan_documents(df, ["doc_id"]).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["base_spans"]] == base_spans(texts[r["doc_id"]])


def test_redaction(spark):
    df = spark.createDataFrame([(1, f"x {SECRET} y {B64} z", 7), (2, "plain", 7), (3, None, 7)], "doc_id long, text string, n int")
    got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df).collect()}
    assert got[2] == "plain" and got[3] is None and "abcdef0123456789" not in got[1] and B64[:20] not in got[1] and got[1].startswith("x ") and got[1].endswith(" z")


def test_cycles_end():
    assert secret_scan.scan("%2525252525" * 50) is not None
    assert secret_scan.scan("A" * 4000) == ([], [])


def test_pipeline_stages(spark, tmp_path):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    prose = "the cat sat on the mat and looked at the dog while it was raining outside"
    docs = [(1, prose, "en", "s", 1), (2, prose.upper(), None, "s", 1), (3, "12 34 !!", "en", "s", 1), (4, f"words before {item} words after that", "en", "s", 1), (5, f"my {SECRET} is here for all of you to read", "en", "s", 1), (6, "der hund und die katze sind im haus und schlafen", "de", "s", 1), (None, "a text without any number at all", "en", "s", 1)]
    d = tmp_path / "t"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(d)).collect()}
    assert set(out) == {1, 5, 6, None}
    back = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame(list(out.values())), ["doc_id"], pieces.Vocabulary.load()).collect()}
    assert back[1] == prose and "abcdef0123456789" not in back[5] and back[5].endswith("to read")
    frame = spark.read.parquet(str(d / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, str(d))
        assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_equals_brute_force(spark):
    """Rows of the pipeline on the generated documents, stage by stage in plain code."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"]: r["text"] for r in corpus_pipeline.identify(spark, docs, SF).collect()}
    assert set(kept) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    sets = {}
    for d, t in kept.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    kept = {d: t for d, t in kept.items() if group[d] == d}
    items = [tuple((r["text"] or "").encode().lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [{w[i : i + 5] for i in range(len(w) - 4)} for w in items]
    kept = {d: t for d, t in kept.items() if not any(s and 100 * len(s & sets[d]) >= 80 * len(s) for s in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(kept)
    back = {r["doc_id"]: r["text"] for r in pieces.decode(spark.createDataFrame(list(got.values()), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean"), ["doc_id"], pieces.Vocabulary.load()).collect()}
    for d, t in kept.items():
        base, more = secret_scan.scan(t)
        marks = sorted((a, z) for _, a, z in [*base, *more])
        out, at = "", 0
        while marks:
            a, z = marks.pop(0)
            while marks and marks[0][0] < z:
                z = max(z, marks.pop(0)[1])
            out, at = out + t[at:a] + "[SECRET]", z
        assert back[d] == out + t[at:]


def test_stages_on_odd_tables(spark, tmp_path):
    """Empty tables, tables of nulls, and columns with the names that stages use inside."""
    item = "alpha beta gamma delta epsilon zeta eta theta"
    names = ["__text", "_text", "lang_found", "lang_score", "key", "n_tokens", "component_id", "node"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    row = lambda i, t, lang="en": (i, t, lang, "s", 1, *names)
    tables = {
        "empty": ([], []),
        "nulls": ([row(None, None, None), row(None, "", None), row(None, f"one {item} two"), row(None, f"{SECRET} stays here for now"), row(7, None)], [(None, item), (None, None), (1, "")]),
        "none": ([row(1, "plain words of this text", None), row(None, "und noch ein paar worte", None)], []),
    }
    for name, (docs, items) in tables.items():
        d = str(tmp_path / name)
        spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        frame = spark.read.parquet(f"{d}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, d)
            assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", *names]
            assert all(tuple(r)[5:] == tuple(names) for r in frame.collect())
        out = corpus_pipeline.run(spark, d).collect()
        assert len(out) == {"empty": 0, "nulls": 1, "none": 2}[name]
        for query in ("op1_decontaminate", "op6_secret_scan", "op9_near_dup", "op10_lang_id", "op8_pieces", "op3_ngram_lm"):
            got = registry.queries()[query](spark, d)
            assert got.count() == (len(docs) if query != "op1_decontaminate" else sum(bool(t and item in t) for _, t, *_ in docs) * bool(items))


def test_modules_have_documented_edge_cases():
    from tesselon.llm import lang_id, ngram_lm, topk_search, toxicity

    for m in (chat_format, decontaminate, html_text, near_dup, pieces, secret_scan, corpus_pipeline, lang_id, ngram_lm, topk_search, toxicity):
        assert "Defined results" in m.__doc__


def test_unfolding_holds_one_layer_of_each_depth(monkeypatch):
    """Memory is bounded by pieces, not by what a text unfolds to."""
    live, most = weakref.WeakSet(), [0]

    class Layer(secret_scan._Layer):
        def __init__(self, *args, **more):
            super().__init__(*args, **more)
            live.add(self)
            most[0] = max(most[0], len(live))

    monkeypatch.setattr(secret_scan, "_Layer", Layer)
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 15)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 10)
    plain = "".join(f"line {i} of words\n" for i in range(200_000)) + "password = abcdefghijklmnop\n"
    text = base64.b64encode(gzip.compress(plain.encode())).decode()
    base, added = secret_scan.scan(f"x {text} y")
    assert not base and added == [("assign", 2, 2 + len(text))]
    assert len(plain) > 100 * secret_scan.PIECE and most[0] <= 4
