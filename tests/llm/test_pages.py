import base64
import gzip
import hashlib
import os
import random

from sparrowlog.llm.html_text import blocks_of, main_text
from sparrowlog.llm.url_filters import evaluate, intervals
from sparrowlog.llm.warc import derivatives, plain_text, read_warc, responses, split_block, write_warc


def page(body, title="T"):
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>{body}<footer>&copy; us</footer></body></html>"


def test_blocks():
    html = page('<div class="ad">Buy</div><article><h1>Head &amp; tail</h1><p>One\n  two<br>three<p>Four <b>five</b><p></article><div class="cookie-notice">We use</div><div id="comments"><p>First!</p></div>')
    assert blocks_of(html) == [("Head & tail", True), ("One two three", True), ("Four five", True)]
    assert blocks_of("<article><p>cut off <b") == [("cut off", True)]
    assert blocks_of("") == [] and blocks_of("plain &lt; text") == [("plain < text", False)]


def test_main_text(spark):
    same = "".join(f"<div>shared line of the site number {i} with some more words in it</div>" for i in range(2))
    rows = [(i, f"http://a.example/{i}", page(f"<p>Unique text {i} " + " ".join(f"w{i}x{j}" for j in range(20)) + f"</p>{same}")) for i in range(6)]
    rows += [(10 + i, f"http://a.example/c{i}", page("<article><p>" + "the same article on many pages of the site again</p></article>")) for i in range(5)]
    rows += [(20, None, None), (21, "http://b.example/", ""), (22, "", "<p>x</p>"), (22, "", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as host", "3 as lot")
    got = {}
    for r in main_text(df).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert all(got[i][0].startswith(f"Unique text {i}") and "shared" not in got[i][0] for i in range(6))
    assert all(got[10 + i] == ["the same article on many pages of the site again"] for i in range(5))
    assert got[20] == [""] and got[21] == [""] and got[22] == ["x", "x"]
    assert main_text(df.limit(0)).collect() == []


def test_text_beside_an_article_is_kept_unless_repeated(spark):
    story = [" ".join(f"s{i}x{j}" for j in range(30)) for i in range(4)]
    line = "the same line of this site on each of its pages again"
    rows = [(i, f"http://a.example/{i}", page(f"<div>{story[i]}</div><article><p>teaser</p></article><div>{line}</div>")) for i in range(4)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"{story[i]}\n\nteaser" for i in range(4)}


def test_boilerplate_on_few_pages_of_a_large_host(spark):
    line = "a notice that stands on few of the many pages of this site"
    body = lambda i: " ".join(f"t{i}x{j}" for j in range(9))
    rows = [(i, f"http://a.example/{i}", f"<div>{body(i)}</div>" + (f"<div>{line}</div>" if i % 800 == 0 else "")) for i in range(4000)]
    rows += [(5000 + i, f"http://b.example/{i}", f"<div>{body(i)}</div><div>{line}</div>") for i in range(2)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: body(i) for i in range(4000)} | {5000 + i: f"{body(i)}\n\n{line}" for i in range(2)}


def test_intervals_and_as_of(spark):
    e = [("l", "domain", "x.org", "add", 5), ("l", "domain", "x.org", "add", 6), ("l", "domain", "x.org", "remove", 10), ("l", "domain", "x.org", "add", 20), ("m", "prefix", "x.org/a/", "add", 0), ("m", "word", "bad", "add", 3), ("m", "word", "bad", "remove", 3), (None, "word", "x", "add", 1)]
    entries = spark.createDataFrame(e, "list string, kind string, pattern string, action string, at int")
    assert sorted((r.pattern, r.since, r.until) for r in intervals(entries).collect()) == [("x.org", 5, 10), ("x.org", 20, None), ("x.org/a/", 0, None)]
    c = [(1, "http://www.X.org/a/b?q", 5), (2, "https://x.org:80/", 10), (3, "http://u@x.org/a", 25), (4, None, 7), (5, "not a url", 7), (6, "http://notx.org/", None), (7, "http://y.x.org", 9), (7, "http://y.x.org", 9), (None, "http://x.org/a/", 6)]
    caps = spark.createDataFrame(c, "page_id long, url string, fetched int").selectExpr("*", "'z' as list", "0 as salt")
    got = sorted((str(r.page_id), r.n_rules, r.lists) for r in evaluate(caps, entries).collect())
    assert got == sorted([("1", 1, "l"), ("2", 0, ""), ("3", 1, "l"), ("4", 0, ""), ("5", 0, ""), ("6", 0, ""), ("7", 1, "l"), ("7", 1, "l"), ("None", 2, "l,m")])
    assert evaluate(caps.limit(0), entries).collect() == []
    assert evaluate(caps, entries.limit(0)).where("blocked").count() == 0


def test_warc_links_and_digests(spark, tmp_path):
    rows = [(1, "http://a/", "<p>Hi &amp; <b>you</b></p><script>no</script>"), (2, None, None), (None, "http://b/\r\nx", "é"), (1, "http://a/", "<p>Hi &amp; <b>you</b></p><script>no</script>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as block", "2 as key")
    src = responses(df)
    of = {r.record_id: r for r in src.collect()}
    out = derivatives(src).collect()
    assert len(out) == 8 and len({r.record_id for r in out}) == 6
    for r in out:
        source = of[r.refers_to]
        data = r.block.encode()
        assert r.content_length == len(data) and r.block_digest == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert f"WARC-Refers-To: {source.record_id}\r\n" in r.header and r.target_uri == source.target_uri
        payload = split_block(bytes(source.block))[2]
        digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if r.warc_type == "conversion":
            assert r.payload_digest == digest
        else:
            assert f"source-payload-digest: {digest}\r\n" in r.block and "http-header-content-type: text/html; charset=utf-8" in r.block
    assert {r.block for r in out if r.warc_type == "conversion"} == {"Hi & you", "", "é"}
    write_warc(derivatives(src), str(tmp_path / "w"))
    raw = b"".join(gzip.open(tmp_path / "w" / f).read() for f in os.listdir(tmp_path / "w") if f.endswith(".gz"))
    assert raw.count(b"WARC/1.1\r\n") == 8
    back = read_warc(spark, str(tmp_path / "w")).collect()
    assert sorted((r.record_id, r.refers_to, r.warc_type, bytes(r.block).decode(), r.content_length) for r in back) == sorted((r.record_id, r.refers_to, r.warc_type, r.block, r.content_length) for r in out)
    assert [x.split(":")[0] for x in out[0].header.split("\r\n")[1:4]] == ["WARC-Type", "WARC-Record-ID", "WARC-Refers-To"]
    assert derivatives(src.limit(0)).collect() == []


def test_plain_text_of_a_response():
    page_ = "<html><head><title>T</title><style>p{}</style></head><body><h1>A &amp; b</h1><p>one\n two<br>three</p><script>x</script><ul><li>four<li>five</ul><!-- six --><p></p>&lt;seven&gt;</body></html>"
    assert plain_text(page_) == "A & b\none\ntwo\nthree\nfour\nfive\n<seven>"
    assert plain_text("<head><title>T</title><body>b") == "b" and plain_text("") == ""
    status, fields, payload = split_block(b"HTTP/1.1 200 OK\r\nA: 1\r\nX: y\r\na: 2\r\n\r\nbody\r\n\r\nrest")
    assert (status, fields, payload) == ("HTTP/1.1 200 OK", {"a": "1, 2", "x": "y"}, b"body\r\n\r\nrest")


def plain_main_text(rows):
    """The same by counting every run of every page with dictionaries."""
    from sparrowlog.llm.html_text import PAGES, RUN

    parsed, places, contents = [], {}, {}
    for key, url, html in rows:
        blocks = blocks_of(html or "")
        host = (url or "").split("/")[2] if "//" in (url or "") else ("" if url else None)
        words = [(w, main) for t, main in blocks for w in t.split(" ")]
        runs = [(host, tuple(w for w, _ in words[i : i + RUN])) for i in range(len(words) - RUN + 1)]
        content = (host, tuple(t for t, _ in blocks))
        for i, r in enumerate(runs):
            places.setdefault(r, []).append(words[i][1])
            contents.setdefault(r, set()).add(content)
        parsed.append((key, blocks, runs))
    bad = {r for r, where in places.items() if len(contents[r]) >= PAGES and 2 * where.count(False) >= len(where) and False in where}
    out = []
    for key, blocks, runs in parsed:
        gone = {j for i, r in enumerate(runs) if r in bad for j in range(i, i + RUN)}
        kept, at = [], 0
        for t, _ in blocks:
            words = t.split(" ")
            left = " ".join(w for j, w in enumerate(words, at) if j not in gone)
            at += len(words)
            if left:
                kept.append(left)
        out.append((key, "\n\n".join(kept)))
    return out


def test_runs_against_brute_force(spark):
    rng = random.Random(11)
    phrase = [" ".join(f"p{i}x{j}" for j in range(rng.randint(6, 14))) for i in range(12)]
    rows = []
    for n in range(160):
        parts = [rng.choice(phrase) if rng.random() < 0.6 else " ".join(f"u{n}x{j}" for j in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        inner = [rng.choice(phrase[:4]) if rng.random() < 0.4 else f"story {n} " * 4 for _ in range(rng.randint(0, 3))]
        article = "<article>" + "".join(f"<p>{x}</p>" for x in inner) + "<div class='legal'>" + rng.choice(phrase) + "</div></article>" if inner else ""
        rows.append((n, f"http://{rng.choice('abc')}.example/{n}", "<body>" + "".join(f"<div>{x}</div>" for x in parts) + article))
    rows += [(200, None, rows[0][2]), (201, "", rows[1][2]), rows[2], rows[2]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.text) for r in main_text(df).collect())
    want = sorted(plain_main_text(rows))
    assert got == want
    assert sum(t != "\n\n".join(x for x, _ in blocks_of(h)) for (_, t), (_, _, h) in zip(sorted(want), sorted(rows))) > 20  # it does cut


def test_text_does_not_change_with_the_size_of_its_host(spark):
    line = "a line that stands on four pages of this site and no more"
    page_of = lambda i: f"<div>{' '.join(f't{i}x{j}' for j in range(9))}</div>" + (f"<div>{line}</div>" if i < 4 else "")
    got = []
    for n in (6, 3000):
        df = spark.createDataFrame([(i, f"http://a.example/{i}", page_of(i)) for i in range(n)], "page_id long, url string, html string")
        got.append({r.page_id: r.text for r in main_text(df).where("page_id < 6").collect()})
    assert got[0] == got[1] and not any(line in t for t in got[0].values())


def test_markup_that_authors_leave_open():
    assert blocks_of("<html><head><title>T</title><body><article><p>x</article>") == [("x", True)]
    assert blocks_of("<head><meta charset=utf8><title>T</title><p>Hello") == [("Hello", False)]
    assert blocks_of("<body><button>Go<article>a</article>") == [("a", True)]
    assert blocks_of("<body><video><p>none<main>m<footer>f</footer></main><nav>n") == [("m", True)]
    whole = "<article>a<div class='legal'>terms</div><div class='search-results'>r</div><figure><figcaption>cap</figcaption></figure><label>lab</label><math>x</math><div class='comments'>c</div></article>"
    assert blocks_of(whole) == [("a", True), ("terms", False), ("r", False), ("cap", True), ("labx", True)]
    long = "<article>" + "<p>" + "word " * 200_000 + "</article>"
    assert len(blocks_of(long)[0][0]) == 5 * 200_000 - 1
