import base64
import hashlib

from pyspark.sql import types as T

from runwise.llm import html_diff, warc_archive

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())]
                     + [T.StructField(c, T.StringType()) for c in ("key", "host", "lines", "address", "payload")])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], PAGES)


ROWS = [(5, "http://a.example/x", "<p>é</p>"), (2, "http://a.example/y", "<p>é</p>"), (9, None, "<p>é</p>"), (7, "u\r\nv", None),
        (8, "w", ""), (1, "z", "q" * 70_000), (None, "n", "<p>é</p>"), (3, "three", "once"), (3, "three", "once"), (None, "only", "alone")]


def test_archive_round_trip(llm, tmp_path):
    folder = warc_archive.write_archive(pages(llm, ROWS), f"file://{tmp_path}/warc")
    out = warc_archive.read_archive(llm, folder).collect()
    assert len(out) == len(ROWS) and llm.read.parquet(f"{folder}/payloads").count() == len({(h or "") for *_, h in ROWS})
    by = {}
    for i, u, h in ROWS:
        by.setdefault(h or "", []).append(i)
    want = []
    for i, u, h in ROWS:
        raw = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        first = min(ids) if ids else None
        response = first is None or i == first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else first))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    for r in out:
        record = bytes(r["record"])
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode()) and record.endswith(b"\r\n\r\n")
        head, rest = record.split(b"\r\n\r\n", 1)
        length = int([x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: ")][0].split()[1])
        assert len(rest) == length + 4 and (r["record_type"] == "revisit" or rest[:-4].endswith(bytes(r["payload"])))
    assert warc_archive.read_archive(llm, warc_archive.write_archive(pages(llm, []), f"file://{tmp_path}/none")).collect() == []


def test_archive_detects_damage(llm, tmp_path):
    import pytest
    folder = warc_archive.write_archive(pages(llm, ROWS[:3]), f"file://{tmp_path}/warc")
    stored = llm.read.parquet(f"{folder}/payloads").selectExpr("address", "cast('other' as binary) payload")
    stored.write.parquet(f"file://{tmp_path}/bad/payloads")
    llm.read.parquet(f"{folder}/records").write.parquet(f"file://{tmp_path}/bad/records")
    with pytest.raises(Exception, match="does not match its address"):
        warc_archive.read_archive(llm, f"file://{tmp_path}/bad").collect()


def page(body, article=True):
    inner = f"<article>{body}</article>" if article else body
    return (f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t=\"</p>\";</script></head><body><header>Site</header>"
            f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><!-- c --><div class=\"ad\">Buy <div>now</div></div>{inner}"
            f"<div id='comments'><p>first!</p></div><form><p>Mail</p></form><footer>&copy; x</footer></body></html>")


def test_main_text():
    html = page("<h1>A &amp; B&nbsp;C</h1><p><b>One.<br>two\n  three<p>Fo<i>ur</i> &lt;x&gt;</p><aside>no</aside><script>x</script><p hidden>h</p><ul><li>i</li></ul>")
    assert html_diff.main_text(html, None) == "A & B C\n\nOne. two three\n\nFour <x>\n\ni"
    assert html_diff.main_text(None, None) == html_diff.main_text("", None) == ""
    assert html_diff.main_text("plain &amp text", None) == "plain & text"
    assert html_diff.main_text("<p>a<p>b <nav>x", None) == "a\n\nb"
    assert html_diff.main_text("<article><p>open " + "w " * 50_000, None) == "open " + ("w " * 50_000).strip()


def test_main_text_of_marked_and_broken_pages():
    text = lambda x: html_diff.main_text(x, None)
    assert text('<nav><script>var a="</nav>"</script>MENU</nav><p>Body</p>') == "Body"
    assert text("<article><p>own</p></article><article class='comment'><p>first!</p></article><article class='related teaser'>more</article>") == "own"
    assert text("<article><p class='alert'>said</p><p>a <span class='share'>b</span></p><section class='related-work'><p>c</p></section>"
                "<div class='post-share buttons'>tweet</div><div class='cookie-notice'>ok?</div><div id='comments-list'>me</div></article>") == "said\n\na b\n\nc"
    assert text("<article><p>a</p><form><p>b</p><p>c</p></article><footer>d</footer>") == "a\n\nb\n\nc"
    assert text("<article><form><form>x</form><p>b</p></article>") == "b"
    assert text("<article>" + "<form><p>w</p>" * 2000 + "</article>") == "\n\n".join(["w"] * 2000)  # read twice, not once per form
    assert text("<div class='header-image'><p>kept</p></div><div class='download'>kept too</div>") == "kept\n\nkept too"


def test_long_boilerplate_over_short_texts(llm):
    """Shared lines far longer than the page's own: a line that both neighbours have goes, whatever its share."""
    shell = "".join(f"<p>{'long line of the shell ' * 9} {j}</p>" for j in range(8))
    rows = [(k, f"http://s.example/a/{k:02d}", f"<body>{shell}<p>short {k}</p></body>") for k in range(12)]
    rows += [(20, "http://t.example/1", f"<body>{shell}<p>same</p></body>"), (21, "http://t.example/2", f"<body>{shell}<p>same</p></body>"),
             (22, "http://t.example/3", f"<body>{shell}<p>other</p></body>")]
    out = {r["page_id"]: r["text"] for r in html_diff.extract(pages(llm, rows)).collect()}
    assert [out[k] for k in range(1, 11)] == [f"short {k}" for k in range(1, 11)]
    assert out[22].endswith("other")


def test_longest_common_subsequence():
    import itertools
    import random
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(4) for _ in range(rng.randrange(8))]
        b = [rng.randrange(4) for _ in range(rng.randrange(8))]
        got = html_diff.common_lines(a, b)
        best = max((n for n in range(min(len(a), len(b)) + 1) if any(
            _is_sub([a[i] for i in pick], b) for pick in itertools.combinations(range(len(a)), n))), default=0)
        assert len(got) == best and got == sorted(set(got)) and _is_sub([a[i] for i in got], b)


def _is_sub(x, y):
    it = iter(y)
    return all(v in it for v in x)


def test_differencing_deletes_shared_lines(llm):
    menu, foot = "<p>All rights of this page belong here</p>", "<p>Contact us by mail</p>"
    body = lambda k: menu + "".join(f"<p>line {k} {j} with some own words</p>" for j in range(5)) + foot
    rows = [(k, f"http://h.example/news/{k:03d}?q=1", f"<html><body>{body(k)}</body></html>") for k in range(30)]
    rows += [(100, "http://other.example/a", f"<body>{body(100)}</body>"), (101, None, f"<body>{body(101)}</body>"), (102, "http://h.example/none", None),
             (200, "http://c.example/1", f"<body>{body(200)}</body>"), (201, "http://c.example/2", f"<body>{body(200)}</body>"),
             (300, "http://h.example/marked", page("<p>Contact us by mail</p><p>own</p>")), (5, "http://h.example/news/005?q=1", f"<html><body>{body(5)}</body></html>")]
    out = {}
    for r in html_diff.extract(pages(llm, rows)).collect():
        out.setdefault(r["page_id"], []).append(r)
        assert r["n_chars"] == len(r["text"])
    own = lambda k: "\n\n".join(f"line {k} {j} with some own words" for j in range(5))
    for k in range(30):
        assert all(r["text"] == own(k) for r in out[k]), k
    assert len(out[5]) == 2 and out[102][0]["text"] == ""
    whole = lambda k: f"All rights of this page belong here\n\n{own(k)}\n\nContact us by mail"
    assert out[100][0]["text"] == whole(100) and out[101][0]["text"] == whole(101)  # no neighbour
    assert out[200][0]["text"] == out[201][0]["text"] == whole(200)  # copies say nothing
    assert out[300][0]["text"] == "Contact us by mail\n\nown"  # in a marked article
    assert html_diff.extract(pages(llm, [])).collect() == []


def test_extract_on_table(llm, sf):
    import html
    import re
    from runwise.llm.queries import QUERIES
    rows = {r["page_id"]: r for r in QUERIES["op3_html_diff"](llm, sf).collect()}
    for r in llm.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert rows[r["page_id"]]["text"] == "\n\n".join(x for x in blocks if x) and rows[r["page_id"]]["url"] == r["url"]


def test_marked_pages_are_differenced_too(llm):
    """Differencing judges pages that mark their article; lines of the article that it finds shared are taken back."""
    rows = [(k, f"http://h.example/news/{k:02d}", f"<body><p>Shared by all pages</p><article><p>passage of several pages</p>"
             f"<p>{'own words ' * 9}{k}</p></article><p>drawn for {k}</p></body>") for k in range(6)]
    found = {r["key"]: r["deleted"] for r in html_diff.decisions(pages(llm, rows)).collect()}
    assert len(found) == 6 and all(d == [0] for d in found.values())
    out = {r["page_id"]: r for r in html_diff.extract(pages(llm, rows)).collect()}
    assert all(out[k]["text"] == f"passage of several pages\n\n{'own words ' * 9}{k}" and out[k]["n_deleted"] == 1 for k in range(6))
