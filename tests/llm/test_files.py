"""WARC archives, audio features, page text."""

import base64
import hashlib
import html
import random
import time
import zlib

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from apexframe.llm import audio, html_text, queries, warc
from apexframe.llm.common import shared_dir


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash")).withColumn("n", F.lit(0))


def test_round_trip_by_any_ranges(spark, docs):
    docs([])
    big = "".join(f"{i * 7919 % 104729} " for i in range(60_000))
    rows = [(i, f"http://h/{i}\r\n%0A", f"<p>{i % 3}é</p>" * (i % 4)) for i in range(40)] + [(100, None, None), (None, "u", "only null"), (101, "u", big), (102, "u", big), (5, "again", "<p>2é</p>")]
    manifest = warc.write_archives(pages_of(spark, rows), shared_dir(spark, "test"))
    want = {}
    for page_id, _, t in rows:
        p = (t or "").encode()
        if page_id is not None:
            want.setdefault(p, page_id)
            want[p] = min(want[p], page_id)
    for size in (1000, 77_777, 1 << 23):
        got = warc.read_archives(manifest, size).collect()
        assert len(got) == len(rows)
        for r in got:
            p = next((t or "").encode() for i, _, t in rows if i == r["page_id"] and base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode() == r["payload_digest"])
            first = want.get(p, r["page_id"])
            assert r["payload_bytes"] == len(p) and r["record_type"] == ("response" if r["page_id"] == first else "revisit")
            assert r["refers_to"] == (None if r["page_id"] == first else first) and r["payload"] == (p if r["record_type"] == "response" else None)
    assert {r["url"] for r in got} >= {"http://h/7\r\n%0A", None}
    none = warc.write_archives(pages_of(spark, []), shared_dir(spark, "test"))
    assert warc.read_archives(none).count() == 0


def test_magic_inside_a_payload_is_no_record():
    inner = warc.encode_record(9, "u", b"inner", base64.b32encode(hashlib.sha1(b"inner").digest()).decode(), None, False)
    noise = bytes(range(256)) + b"\x1f\x8b\x08\x00junk" + zlib.compress(b"x")
    stream = noise + inner + b"\x1f\x8b\x08" + inner + inner[:-9]

    class File:
        def seek(self, p):
            self.p = p

        def read(self, n):
            return stream[self.p : self.p + n]

    for cut in range(0, len(stream), 13):
        found = [r for a, b in ((0, cut), (cut, len(stream))) for r in warc.records_in(warc._Bytes(File(), len(stream)), a, b)]
        assert [r[0] for r in found] == [9, 9]


def test_large_records_may_be_left_as_responses(spark, docs):
    docs([])
    m = warc.write_archives(pages_of(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]), shared_dir(spark, "test"), min_bytes=3)
    assert {r["page_id"]: r["record_type"] for r in warc.read_archives(m).collect()} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_payloads_survive_the_clip(spark, docs):
    texts = [None, "", "a", "é" * 32, "x" * 64, "x" * 65, "nul\0", "long " * 30_000]
    df = docs([(i, t) for i, t in enumerate(texts)])
    clips = df.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), audio.wav_of(audio.payload_of(F.col("text"))).alias("media"))
    for r in audio.audio_features(clips).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["media"][44:] == padded and r["n_bytes"] == len(raw) and r["media"][:4] == b"RIFF" and int.from_bytes(r["media"][40:44], "little") == len(padded)
        table = audio.read_tensors(r["tensors"])
        cube = table.column("log_mel").combine_chunks().to_numpy_ndarray()
        assert cube.shape[1:] == (audio.TENSOR_FRAMES, audio.MELS) and cube.shape[0] == -(-r["frames"] // audio.TENSOR_FRAMES)
        assert table.column("start_s").to_pylist() == sorted(table.column("start_s").to_pylist())
    assert audio.audio_features(clips.limit(0)).count() == 0


def test_resampling_is_the_plain_convolution():
    x = np.random.default_rng(0).standard_normal(333).astype(np.float32)
    h = audio._H[:, ::-1].T.ravel()  # phase-major back to the prototype filter
    up = np.zeros((len(x) + 2 * audio.TAPS) * audio.UP)
    up[audio.TAPS // 2 * audio.UP :: audio.UP][: len(x)] = x
    want = []
    for j in range(-(-len(x) * audio.UP // audio.DOWN)):
        phase, at = (j * audio.DOWN) % audio.UP, j * audio.DOWN // audio.UP
        taps = h[phase :: audio.UP]
        want.append(sum(taps[k] * up[(at + audio.TAPS - 1 - k) * audio.UP] for k in range(audio.TAPS)))
    assert np.allclose(audio.resample(x), want, atol=1e-4)


def test_a_tone_shows_in_its_band():
    t = np.arange(16_000) / audio.RATE
    wav = bytes(44) + (128 + 100 * np.sin(2 * np.pi * 1000 * t)).astype(np.uint8).tobytes()
    cube = audio.read_tensors(audio.features(wav)[0]).column("log_mel").combine_chunks().to_numpy_ndarray().reshape(-1, audio.MELS)
    band = cube[5:20].mean(axis=0).argmax()
    assert abs(band - audio._BANK[int(1000 / 5000 * 128)].argmax()) <= 1


def test_hysteresis_by_state_machine():
    e = np.random.default_rng(1).standard_normal(500)
    want, on, begin = [], False, 0
    for i, v in enumerate(e):
        if not on and v >= 0.8:
            on, begin = True, i
        elif on and v < -0.5:
            on = False
            want.append((begin, i))
    if on:
        want.append((begin, len(e)))
    assert audio.hysteresis(e, -0.5, 0.8) == want


def test_equal_texts_equal_features(spark, docs):
    docs([])
    out = queries.queries()["op4_audio_features"](spark, SF).toPandas()
    assert out.groupby("payload_sha256").feature.nunique().max() == 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad top">buy <div>now</div></div>
<div id="cookie-notice">We use cookies</div><form>name <input> <button>go</button></form>
<article><header><h1>A &amp; B</h1></header><p><b>One  two\n three&#8217;s<br><p>Four &lt;five&gt; &copy 6</p>
<aside>aside</aside><div class="share-bar">share</div><div class="body">seven<!-- no --> eight</div><table><tr><td>nine<td>ten</table>
<div class="ad">unclosed</article><section class="comments"><p>me too</p></section><footer>end &copy;</footer></body></html>"""


def test_main_text_of_a_page():
    main = [t for p, t in html_text.blocks_of(PAGE) if p == html_text.MAIN]
    assert main == ["A & B", "One two three’s", "Four <five> © 6", "seven eight", "nine", "ten"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("plain <b>text") == [(html_text.OPEN, "plain text")]
    assert html_text.blocks_of("<article>a<script>never closed") == [(html_text.MAIN, "a")]


def test_boilerplate_by_repeated_runs(spark, docs):
    docs([])
    top = "welcome to the site where all the news of the day are told"
    rows = [(i, f"http://h.org/{i}", f"<div>{top}</div><div>page {i} has words {i} of its own {html.escape('<ü>')} here number {i}</div><p>{top}</p>") for i in range(5)]
    rows += [(10, "http://other.org/1", f"<div>{top}</div>"), (11, None, None), (12, "http://h.org/12", ""), (13, "http://h.org/13", f"<article>{top}</article>"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit("clash")).withColumn("host", F.lit(1))
    got = html_text.main_text(df).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "page 3 has words 3 of its own <ü> here number 3" and text[10] == top and text[13] == top and text[11] == text[12] == ""
    assert html_text.main_text(df.limit(0)).count() == 0


def test_copies_and_quotations_are_no_boilerplate(spark, docs):
    docs([])
    rng = random.Random(15)
    words = lambda n: " ".join(f"k{rng.randrange(99_999)}" for _ in range(n))
    copy, quote, top = words(60), words(20), words(12)
    bodies = [copy, copy.upper().replace(" ", "  ").lower(), f"{words(30)} {quote} {words(30)}", f"{words(30)} {quote} {words(30)}", *(words(50) for _ in range(60))]
    rows = [(i, f"http://c.org/{i}", f"<div>{top}</div><p>{top} {b}</p>") for i, b in enumerate(bodies)]
    # a host of two copies and a quoting page
    rows += [(100 + i, f"http://d.org/{i}", f"<p>{b}</p>") for i, b in enumerate([copy, copy, f"{words(20)} {quote} {words(20)}"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert all(text[i] == " ".join(b.split()) for i, b in enumerate(bodies))
    assert text[100] == text[101] == copy and quote in text[102]


def test_chrome_by_whole_names_and_to_its_own_end():
    main = lambda x: [t for p, t in html_text.blocks_of(f"<body><article>{x}<p>end</p></article>tail</body>") if p == html_text.MAIN]
    for kept in ('<div style="overflow:hidden">a</div>', '<a title="The hidden valley">a</a><br>', '<div data-id="menu">a</div>', '<h2 id="comments-on-the-law">a</h2>',
                 '<section id="notice-period">a</section>', '<td class="share-prices">a</td><br>', '<div data-role="navigation">a</div>'):
        assert main(kept) == ["a", "end"], kept
    for gone in ("<div hidden>a</div>", '<div class="x share-bar">a</div>', "<div id=cookie-notice>a</div>", '<p class="ad">a', '<ul><li class="menu-item">a<li class="menu-item">a</ul>',
                 '<div role="navigation">a</div>', '<table><tr><td class="ad">a</table>', '<section class="comments"><div>a<article>a</article></div></section>'):
        assert main(gone) == ["end"], gone
    assert main('<ul><li class="menu-item">Home<li>kept</ul>') == ["kept", "end"]
    assert html_text.blocks_of('<div class="ad">buy<main>text</div> more</main>') == [(html_text.CHROME, "buy"), (html_text.MAIN, "text"), (html_text.MAIN, "more")]
    assert html_text.blocks_of("<div><nav>menu</div><p>open") == [(html_text.CHROME, "menu"), (html_text.OPEN, "open")]


def test_suffix_array_and_repeats_by_brute_force():
    rng = np.random.default_rng(3)
    for alphabet, n in ((2, 200), (5, 400), (400, 300), (1, 60)):
        tokens = rng.integers(0, alphabet, n)
        page = np.sort(rng.integers(0, 7, n))
        ends = np.append(np.flatnonzero(np.diff(page)), n - 1)
        tokens[ends] = 1000 + np.arange(len(ends))
        order, common = html_text.suffix_array(tokens.astype(np.uint64))
        t = tokens.tolist()
        assert order.tolist() == sorted(range(n), key=lambda i: t[i:])
        for a, b, c in zip(order[:-1].tolist(), order[1:].tolist(), common.tolist(), strict=True):
            assert t[a : a + c] == t[b : b + c] and (max(a, b) + c == n or t[a + c] != t[b + c])
        for run in (1, 3, 8):
            want = [len({int(page[k]) for k in range(n) if t[k : k + run] == t[i : i + run]}) for i in range(n - run + 1)]
            assert html_text.repeated_on(tokens.astype(np.uint64), page, run)[: n - run + 1].tolist() == want
    assert html_text.repeated_on(np.zeros(0, np.uint64), np.zeros(0, np.int64), 8).tolist() == []


def test_repeated_lines_go_and_shared_text_stays_in_main(spark, docs):
    """Inside article: a line on every page goes, near copies of an article on most pages of a host stay whole."""
    docs([])
    rng = random.Random(16)
    words = lambda n: " ".join(f"k{rng.randrange(99_999)}" for _ in range(n))
    line = words(10)
    bodies = [(words(40), words(40)) for _ in range(12)]
    rows = [(i, f"http://a.org/{i}", f"<article><p>{a}</p><p>{line}</p><p>{b}</p></article>") for i, (a, b) in enumerate(bodies)]
    shared = [words(30) for _ in range(4)]
    near = [[*shared[:2], words(25), *shared[2:], words(1)] for _ in range(9)]
    rows += [(100 + i, f"http://b.org/{i}", f"<article>{''.join(f'<p>{p}</p>' for p in one)}</article>") for i, one in enumerate(near)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert all(text[i] == f"{a}\n{b}" for i, (a, b) in enumerate(bodies))
    assert all(text[100 + i] == "\n".join(one) for i, one in enumerate(near))


def test_a_large_host_is_parted_and_keeps_its_rule(spark, docs):
    docs([])
    rng = random.Random(17)
    words = lambda n: " ".join(f"k{rng.randrange(99_999)}" for _ in range(n))
    top, bodies = words(12), [words(20) for _ in range(html_text.PART_PAGES * 2 + 30)]
    rows = [(i, f"http://a.org/{i}", f"<div>{top}</div><p>{b}</p>") for i, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    assert {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()} == dict(enumerate(bodies))


@pytest.mark.parametrize("size", [9, 40])
def test_a_host_counts_as_a_whole_in_parts_of_any_size(spark, docs, monkeypatch, size):
    """Lines on few, one in twenty and half of the pages, in and outside article, with copies that differ in case and blocks."""
    docs([])
    rng = random.Random(18)
    words = lambda n: " ".join(f"k{rng.randrange(99_999)}" for _ in range(n))
    lines = [(words(10), step) for step in (2, 3, 16, 19, 20, 21, 30, 120)]
    rows = []
    for i in range(320):
        own = [x for x, step in lines if i % step == 0]
        body = [words(12), *own, words(12)] if i % 5 else [*own, words(20), *own]
        tag = "article" if i % 3 == 0 else "div"
        rows.append((i, f"http://a.org/{i}", f"<{tag}>{''.join(f'<p>{x}</p>' for x in body)}</{tag}>"))
        if i % 8 == 0:
            rows += [(1000 + i, f"http://A.org/{i}", rows[-1][2].replace("k", "K")), (2000 + i, None, rows[-1][2]), (3000 + i, f"http://a.org/{i}", f"<div>{' '.join(body)}</div>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    whole = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    monkeypatch.setattr(html_text, "PART_PAGES", size)
    parted = [(r["page_id"], r["text"]) for r in html_text.main_text(df).collect()]
    assert len(parted) == len(rows) and dict(parted) == whole
    assert lines[2][0] not in "".join(x for i, x in parted if i < 1000 and i % 3) and lines[6][0] in "".join(x for _, x in parted)


def test_broken_pages_take_linear_time():
    for page in ('<a t="x' * 130_000, '<a t="x' * 130_000 + ">", "<p title='" * 90_000 + ">", "<!-- " * 200_000, "<script " * 120_000, "</script" * 120_000 + "<b", "<" * 1_000_000, "<!x" * 300_000, "&#" * 400_000):
        start = time.process_time()
        html_text.blocks_of(page)
        assert time.process_time() - start < 3
    assert [t for _, t in html_text.blocks_of('<article><p title="a>hello</p><p>more</p></article>')] == ["hello", "more"]
