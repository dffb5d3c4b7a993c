from __future__ import annotations

import base64
import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import warc
from graphloom.llm.html_extract import extract, host, host_paths
from graphloom.llm.html_page import Page
from graphloom.llm.merging import LoserTree, merge_runs

PAGES = "page_id long, url string, html string, text string, host string, id string"


def pages(spark, data):
    return spark.createDataFrame([(i, u, h, "t", "h", "i") for i, u, h in data], PAGES).repartition(3)


@given(st.lists(st.lists(st.integers(0, 50)), max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree(runs):
    tuples = [sorted((x,) for x in r) for r in runs]
    assert list(LoserTree([iter(r) for r in tuples])) == sorted(x for r in tuples for x in r)


@given(st.lists(st.integers(0, 99), max_size=300), st.integers(1, 40), st.integers(2, 4))
@settings(max_examples=100, deadline=None)
def test_external_merge_spills_and_narrows(values, buffer_rows, fan_in):
    assert list(merge_runs([(v,) for v in values], buffer_rows, fan_in)) == sorted((v,) for v in values)


def test_merge_leaves_no_files(tmp_path, monkeypatch):
    monkeypatch.setattr("tempfile.tempdir", str(tmp_path))
    merged = merge_runs([(i % 7,) for i in range(100)], 10)
    next(merged)
    assert list(tmp_path.iterdir())
    merged.close()
    assert not list(tmp_path.iterdir())


def web():
    shared = "<p>same payload</p>"
    return [
        (5, "http://www.b.example.org/x?q=1#f", shared), (2, "https://a.example.org/", shared), (9, "http://a.example.org/", shared), (1, "http://c.org/é x", "Ünï"), (3, None, None), (4, "", ""),
        (6, "not a url", "x" * 300_000), (7, "http://[bad", "y"), (None, "http://a.example.org/", shared), (8, "http://a.example.org/z", "once"), (8, "http://a.example.org/z", "once"),
    ]


def records(data):
    least = {}
    for i, _, h in data:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    out = []
    for i, _, h in data:
        payload = (h or "").encode()
        first = least.get(h or "")
        revisit = first is not None and i != first
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return Counter(out)


def read_back(df):
    return Counter(
        (None if r["id"] is None else int(r["id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], None if r["refers_to"] is None else int(r["refers_to"])) for r in df.collect()
    )


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 500)
    manifest = warc.write_archives(pages(spark, web()))
    assert manifest.count() > 3 and manifest.agg({"records": "sum"}).first()[0] == len(web())
    runs = warc.capture_runs(manifest)
    assert read_back(runs) == records(web())
    history = warc.capture_histories(runs, merged_together=4)
    rows = history.select("urlkey", "timestamp", F.coalesce("id", F.lit("")).alias("id"), F.spark_partition_id().alias("part")).collect()
    assert len({r["part"] for r in rows}) > 1
    keys = [(r["urlkey"], r["timestamp"], r["id"]) for r in sorted(rows, key=lambda r: r["part"])]
    assert keys == sorted(keys)  # collect keeps each partition's order
    assert read_back(history) == records(web())


def test_record_ids_are_unique_and_revisits_name_a_response(spark):
    import gzip

    data = [(1, "http://a/", "same"), (1, "http://a/", "same"), (1, "http://a/", "other"), (2, "http://b/", "same"), (None, None, "same"), (None, None, None), (None, None, None)]
    manifest = warc.write_archives(pages(spark, data)).collect()
    heads = [x.split("\r\n\r\n")[0] for r in manifest for x in gzip.open(r["archive"].removeprefix("file:"), "rt", newline="").read().split("WARC/1.1\r\n")[1:]]
    fields = [dict(line.split(": ", 1) for line in h.split("\r\n")) for h in heads]
    ids = {f["WARC-Record-ID"] for f in fields}
    assert len(ids) == len(data)
    revisits = [f for f in fields if f["WARC-Type"] == "revisit"]
    responses = {f["WARC-Record-ID"]: f["WARC-Payload-Digest"] for f in fields if f["WARC-Type"] == "response"}
    assert len(revisits) == 2 and all(responses[f["WARC-Refers-To"]] == f["WARC-Payload-Digest"] for f in revisits)


def test_empty_and_broken_archives(spark, tmp_path):
    assert warc.capture_histories(warc.capture_runs(warc.write_archives(pages(spark, [])))).count() == 0
    data = warc.record("1", "f-0", "http://a/", 0, b"payload", None, None, False)

    def read(content):
        from pyarrow import BufferReader

        return [warc.capture("x", *found) for found in warc.read_records(BufferReader(content))]

    assert [r[4:6] for r in read(data + data)] == [(0, len(data)), (len(data), len(data))]
    with pytest.raises(ValueError):
        read(data[:-5])
    wrong = warc.zlib.compress(warc.zlib.decompress(data, 31).replace(b"payload\r\n\r\n", b"PAYLOAD\r\n\r\n"), wbits=31)
    with pytest.raises(ValueError, match="digest"):
        read(wrong)


@pytest.mark.parametrize(
    "html,text",
    [
        ("", ""),
        ("plain &lt;text&gt; &amp", "plain <text> &"),
        ("<html><head><title>t</title></head><body><nav>n</nav><article><h1>A&nbsp;B</h1><p>x  y<br>z<p>q <b>bold</b>er</p></article><footer>f</footer>", "A B\nx y z\nq bolder"),
        ("<body><div class='side-bar sidebar'>s<div>in</div></div><div id=content><p>one</p><ul><li>two<li>three</ul></div><div class=comments><p>c</p></div>", "one\ntwo\nthree"),
        ("<article><p>a</p><script>var x = '</p><p>no</p>';</script><form>f</form><p>b</p><p unterm", "a\nb"),
        ("<article><p>a <!-- x > y --> b</p><aside>s</aside><div class='ad'>buy</div>c &mdash; d", "a b\nc — d"),
        ('<main><p title="a > b">q</p><p>1 < 2</p></main>', "q\n1 < 2"),
        ("<article>cut &am", "cut &am"),
        ("<div><div>x</div></div><header>h</header><article><header><h2>in</h2></header>y</article>", "in\ny"),
    ],
)
def test_page_text(html, text):
    assert Page(html).text(None) == text


LONG = "a long paragraph of the body " * 30


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<body><article><h1>T</h1><p>lead</p><div class=body><p>{LONG}</p></div></article>", f"T\nlead\n{LONG.strip()}"),
        (f"<body><article><section class=intro>in</section><section class=main>{LONG}</section></article>", f"in\n{LONG.strip()}"),
        (f"<main><h1><a href=x>T</a></h1><article><div class=text>{LONG}</div></article><ul><li><a href=a>one</a><li><a href=b>two</a></ul></main>", f"T\n{LONG.strip()}"),
        (f"<body><div class=post><h1>T</h1><div>lead</div><div class=body>{LONG}</div><p><a href=a>x</a> <a href=b>y</a></p></div>", f"T\nlead\n{LONG.strip()}"),
        (f"<body><h1>T</h1><section>in</section><section class=main>{LONG}</section><div>column</div>", f"T\nin\n{LONG.strip()}"),
    ],
)
def test_text_around_the_best_container(html, text):
    assert Page(html).text(None) == text


@pytest.mark.parametrize(
    "html,text",
    [
        (f"<div class='wrapper has-sidebar'><div class=post><p>{LONG}</p></div><div class=sidebar>s</div></div>", LONG.strip()),
        (f"<div id=page class=header-fixed><div class=post><p>{LONG}</p></div></div><p>x</p>", f"{LONG.strip()}\nx"),
        (f"<div class='content no-comments'><p>{LONG}</p></div>", LONG.strip()),
        (f"<div class='site ad-free'><article>{LONG}</article></div>", LONG.strip()),
        (f"<div class='widget'><article>{LONG}</article><div class=related><article>other</article></div></div><div class=nav>n</div>", LONG.strip()),
        (f"<div class=banner><p>{LONG}</p></div>", LONG.strip()),
        ("<article>a<p class=notice>b</p><p class=related>c</p><p class=tags>d <a href=x>e</a></p><div class=copyright>f</div><div class=share><a href=x>g</a></div><div class=comments>h</div></article>", "a\nb\nc\nd e\nf"),
        ("<article>a <span class=notice>b</span> c<figure><img><figcaption>caption</figcaption></figure></article>", "a b c\ncaption"),
        ("<article>a</article><div id=comments><article class=comment>c</article><article>d</article></div>", "a"),
        (f"<article>a</article><div class=sidebar><p>{LONG}</p></div>", "a"),
    ],
)
def test_classes_hide_no_content(html, text):
    assert Page(html).text(None) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<svg class='icon'/><article><p>a <math/>b</p><p>c</p></article>", "a b\nc"),
        ("<article>a<p>b <svg/> c</p>d<p>e</p><svg><text>no</text></svg>f</article>", "a\nb c\nd\ne\nf"),
        ("<article>a <svg><path d='x'/><g><text>no</text></g><title>no</title></svg>b</article><svg></svg>", "a b"),
        ("<article><p>a<svg class=icon><p>b</p><p>c</p></article><svg></svg>", "a\nb\nc"),
        ("<article><p>a<svg><foreignObject><div>no</div></foreignObject></svg>b</p></article>", "ab"),
        ("<article><p>a</p><div><noscript>no</div><p>b</p></article><noscript>no</noscript>", "a\nb"),
        ("<article>a<template>b</article>", "ab"),
        ("<article>a<noscript><p>no</p></noscript><template><div><p>no</p><template>no</template></div>no</template>b</article>", "ab"),
        ("<head><noscript><link></head><body><article>a</article><noscript>n</noscript>", "a"),
        ("<article><p>a<script>no</article>", "a"),
        ("<article><p>a</p><svg><style/><text>no</text></svg><p>b</p></article>", "a\nb"),
    ],
)
def test_elements_without_an_end(html, text):
    assert Page(html).text(None) == text


def test_hosts_keep_headings_and_leads(spark):
    data = [(i, f"http://h.example.org/{i}", f"<body><article><h1>T{i}</h1><p>lead</p><div class=body><p>{LONG * (i % 3)}end</p></div></article>") for i in range(6)]
    found = {r["page_id"]: r["text"] for r in extract(pages(spark, data)).collect()}
    assert all(found[i] == f"T{i}\nlead\n{LONG * (i % 3)}end" for i in range(6))


def test_links_dont_make_a_container_the_main_one():
    menu = "<a href=x>an entry of some words</a> " * 40
    assert Page(f"<body><div class=list>{menu}</div><div class=text>{LONG}</div>").text(None) == LONG.strip()


def test_votes_and_second_reading_against_brute_force(spark):
    rng = random.Random(4)
    blocks = ["alpha", "post", "box", "col"]

    def page(k):
        order = rng.sample(blocks, 4)
        return "<body>" + "".join(f"<div class='{c}{rng.randrange(9)}'><p>{'word ' * rng.randrange(1, 40 if c != blocks[k % 4] else 200)}</p></div>" for c in order)

    data = [(i, f"http://h{i % 5}.org/{i}", page(i % 5)) for i in range(60)] + [(100, "http://h0.org/x", None), (101, "http://h1.org/y", "<p>no container</p>")]
    votes = {}
    for _, url, source in data:
        # shares of the scores of all containers, without a limit on how many paths a page votes for
        one = Page(source or "")
        best = {}
        for path, score in zip(one.path[1:], one.scores()[1:]):
            best[path] = max(best.get(path, 0), score)
        for path, score in best.items():
            key = (url[7:9], path)
            votes[key] = votes.get(key, 0) + round(score / sum(best.values()) * 1_000_000)
    want = {h: min((p for g, p in votes if g == h), key=lambda p: (-votes[h, p], p)) for h in {h for h, _ in votes}}
    frame = pages(spark, data)
    assert {r["host"][:2]: r["path"] for r in host_paths(frame).collect()} == want
    found = {r["page_id"]: r["text"] for r in extract(frame).collect()}
    assert found == {i: Page(x or "").text(want[u[7:9]]) for i, u, x in data}
    inside = next(i for i, u, x in data if want[u[7:9]].split(".")[-1].rstrip("#") in (x or "") and i < 60)
    assert found[inside]


def test_columns_named_like_inner_ones(spark):
    data = spark.createDataFrame([("http://a.org/", "<p>hello</p>", 1, 2, 3, 4)], "url string, html string, host_ int, HTML_ int, path_ int, `a.b` int")
    out = extract(data)
    assert out.columns == [*data.columns, "text", "n_chars"] and tuple(out.first()) == ("http://a.org/", "<p>hello</p>", 1, 2, 3, 4, "hello", 5)


@given(st.text(alphabet="<>/ab p='\"!-&;", max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_is_read(html):
    assert isinstance(Page(html).text("/div"), str)


def test_hosts_agree_on_paths(spark):
    def page(body):
        return f"<body><div class='teaser t1'><p>{'teaser ' * 9}</p></div><div class='post p7'><p>{body}</p></div>"

    data = [(i, f"http://Host.example.org/{i}", page("long enough body text " * 9)) for i in range(9)] + [(20, "http://u@host.example.org:80/x", page("short"))]
    data += [(30, "http://host.example.org/odd", "<section>no such container</section>"), (31, None, None), (32, None, "<p>own</p>")]
    rng = random.Random(1)
    rng.shuffle(data)
    frame = pages(spark, data)
    wins = {r["host"]: r["path"] for r in host_paths(frame).collect()}
    assert wins["host.example.org"].endswith("/div.post.p#") or wins["host.example.org"].endswith("/div.p#.post")
    found = {r["page_id"]: r for r in extract(frame).collect()}
    assert found[20]["text"] == "short" and found[30]["text"] == "no such container" and found[31]["text"] == "" and found[32]["text"] == "own"
    assert all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert extract(frame).columns == ["page_id", "url", "html", "host", "id", "text", "n_chars"]
    assert extract(pages(spark, [])).count() == 0
    hosts = frame.select(host(F.col("url")).alias("h")).distinct().collect()
    assert {r["h"] for r in hosts} == {"host.example.org", ""}
