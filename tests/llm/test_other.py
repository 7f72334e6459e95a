"""URL filter, fingerprints, WARC, quality, token counts and HTML against plain versions and odd rows."""

import gzip
import html
import itertools
import json
import math
import random
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from citeloom.llm import fingerprint, html_extract, quality, token_count, url_filter, warc
from citeloom.llm.queries import tokenizer_path

# -- quality


def brute_quality(text):
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text or "") if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\f\r"):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(again)


def test_quality_counts_equal_brute_force(spark):
    draw = random.Random(6)
    texts = [None, "", " \n ", "a", "a b c d e", "a b c d e a b c d e", "x\n x\nx\n\n\n", "é ü é ü é ü é ü é", "#*$%&|<> #", "a\x0bb\x0cc\rd\x85e"]
    texts += [draw.choice(["", " ", "\n"]) + "".join(draw.choice(["a", "b", "cé", "d#"]) + draw.choice([" ", "\n", "  ", "\t"]) for _ in range(draw.randint(1, 60))) for _ in range(150)]
    rows = [(i, t, "c", 5) for i, t in enumerate(texts)] + [(None, "a b", "c", 5), (3, "a", "c", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, llr int")
    labels = spark.createDataFrame([(5, 1, 0), (9, 0, 0), (None, 1, 0), (4, 1, None), (7, 1, 1)], "doc_id long, quality int, toxic int")
    out = quality.judge(docs, labels, buckets=1 << 10).collect()
    assert len(out) == len(rows)
    for r in out:
        want = brute_quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)
    assert all(r.llr == 0 for r in quality.judge(docs, labels.limit(0), buckets=64).collect())
    assert quality.judge(docs.limit(0), labels, buckets=64).count() == 0


def test_quality_runs_without_python(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = quality.judge(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int"), buckets=64)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Subquery" in plan and "__ratio#" not in plan


def test_quality_tells_junk_apart(spark):
    draw = random.Random(8)
    word = lambda: draw.choice("the and of with time people year way day thing man world life hand part child eye woman place work week case point".split())
    rows = [(i, " ".join(word() for _ in range(60))) for i in range(200)] + [(1000 + i, " ".join(word() + "***" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    assert kept == set(range(200))


# -- URL filter


def brute_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    path = re.split("[?#]", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    rules = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]
    fits = [(len(r), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return max(fits)[1:] if fits else (None, None)


def test_urls_equal_plain_rules(spark):
    urls = [None, "", "x", "http://", "HTTP://Example.COM/en/7?a", "https://a.b.example.com/en/6", "http://example.com/en", "http://xcom/en/", "http://com/en/", "http://com?q/en/", "ftp://É.net/de/8#x", "a://b.example.net/de/8", "http://b.example.net/de/9", "://org/es/", "x://y://z/w", "http://casino.example.net/x", "http://h.org/ES/"]
    df = spark.createDataFrame([(i, u, "v") for i, u in enumerate(urls)] + [(None, urls[4], "v")] * 2, "page_id long, url string, verdict string")
    model = url_filter.train([f"good{i % 7}.example.org/en/{i}" for i in range(60)], [f"casino{i % 5}.example.org/en/{i}" for i in range(60)])
    for m in (None, model):
        for r in url_filter.judge(df, model=m).collect():
            host, path = brute_parts(r.url)
            rule, verdict = brute_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule), r.url
            assert r.verdict == (verdict or ("block" if m and (host or path) and r.score < m.level else "allow")), r.url
    assert {r.verdict for r in url_filter.judge(df, model=model).where("url like '%casino%'").collect()} == {"block"}
    assert url_filter.judge(df.limit(0), model=model).count() == 0


def test_url_scores_take_in_every_url(spark):
    hosts = [f"{w}{i}.{'casino' if i % 3 else 'news'}.example.org" for i, w in enumerate("".join(x) for x in itertools.product("abcdefg", repeat=2))]
    urls = [f"http://{h}/en/{i}" for h in hosts for i in (1, 20)] + ["http://", None, "x", "HTTP://B.example.com/EN/é"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    texts = sorted({url_filter.shape(*brute_parts(u)) for u in urls if u and "://" in u})
    whole = url_filter.Ratio(*[url_filter.Markov().learn([t for t in texts if ("casino" in t) == bad]) for bad in (False, True)])
    scored = url_filter.scores(df, sample=5)  # the sample is for the level alone
    got = {r.s: r.score for r in scored[0].collect()}
    assert set(got) == set(texts) and all(abs(got[t] - whole.score(t)) < 1e-9 for t in texts)
    rows = {r.url: r for r in url_filter.judge(df, scored=scored).collect()}
    assert len(rows) == len(set(urls)) and rows[None].score == 0 == rows["x"].score and rows["http://"].verdict == "allow"
    assert all(abs(r.score - got[url_filter.shape(r.host, r.path)]) < 1e-12 for r in rows.values() if r.host)
    assert url_filter.scores(df.limit(0)) is None and url_filter.scores(df.where("url like '%casino%'")) is None


def test_errors_on_hosts_that_no_model_saw(spark):
    draw = random.Random(4)
    hosts = [f"{draw.choice(['www', 'm'])}.{a}{b}.example.org" for a in ("th", "wh", "on") for b in ("er", "in", "ed", "es")] + [f"{a}-casino.example.org" for a in ("win", "big", "lux", "pro", "vip", "top")]
    df = spark.createDataFrame([(i, f"http://{h}/{p}") for i, (h, p) in enumerate(itertools.product(hosts, ("en/a", "de/b", "c")))] + [(None, None), (1, "x"), (1, "http://")], "page_id long, url string")
    level, want = 0.0, {}
    fold = {r.h: r.f for r in spark.createDataFrame([(h,) for h in [*hosts, ""]], "h string").selectExpr("h", "pmod(xxhash64(h), 5) as f").collect()}
    texts = [(h, f"{h}/{p}") for h in hosts for p in ("en/a", "de/b", "c")] + [("", "")]
    for h, t in texts:
        a, r = (url_filter.Markov().learn([x for g, x in texts if fold[g] != fold[h] and ("casino" in g) == bad]) for bad in (False, True))
        bad, n, wrong = "casino" in h, *want.get(h, (0, 0, 0))[1:]
        want[h] = (bad, n + 1, wrong + ((url_filter.Ratio(a, r).score(t) < level) != bad))
    got = {r.host: (r.bad, r.n, r.wrong) for r in url_filter.unseen_hosts(df, level).collect()}
    assert got == want and sum(w for _, _, w in want.values()) < len(texts) / 4
    assert url_filter.unseen_hosts(df.limit(0), level).count() == 0


def test_url_model_on_held_out_words():
    draw = random.Random(9)
    good = [f"{draw.choice(['www', 'blog', 'm'])}.th{draw.choice(['an', 'er', 'in'])}{draw.choice(['ed', 'es', 'on'])}.example.net/en/{draw.randint(0, 999)}" for _ in range(400)]
    bad = [f"{draw.choice(['www', 'blog', 'm'])}.{draw.choice(['casino', 'casinos', 'bets', 'betting', 'poker'])}-{draw.choice(['win', 'club', 'vip'])}.example.net/en/{draw.randint(0, 999)}" for _ in range(400)]
    model = url_filter.train(sorted(set(good[:300])), sorted(set(bad[:300])))
    unseen = ["www.casino-royal.example.net/en/5", "m.free-betting.example.net/en/9", "blog.pokers-win.example.net/en/1"]
    assert all(model.score(u) < model.level for u in unseen + bad[300:]) and all(model.score(u) >= model.level for u in good[300:])
    total = sum(math.exp(model.accepted.log_likelihood(c)) > 0 for c in "ab")
    assert total == 2 and url_filter.train([], ["x"]) is None and url_filter.calibrate([], [1.0]) == 0.0


# -- fingerprints


def test_likeness_estimates_jaccard():
    draw = random.Random(3)
    for j in (0.0, 0.3, 0.6, 0.9):
        found = []
        for _ in range(40):
            n = 500
            k = int(2 * n * j / (1 + j))
            same = [str(draw.random()) for _ in range(k)]
            a, b = (" ".join(same + [str(draw.random()) for _ in range(n - k)]) for _ in range(2))
            found.append(fingerprint.likeness(fingerprint.fingerprint(a), fingerprint.fingerprint(b)))
        assert abs(np.mean(found) - j) < 0.04, j
    assert fingerprint.fingerprint(None) == "" == fingerprint.fingerprint(" ") and fingerprint.likeness("", "") == 1.0 and fingerprint.likeness("", "ab") == 0.0
    one = fingerprint.fingerprint("just one")
    assert len(one) == fingerprint.BINS * fingerprint.BIN_BITS // 4 and len(set(one)) == 1


def test_fingerprints_see_the_next_document(spark):
    import hashlib

    draw = random.Random(11)
    rows = [(i * 3, " ".join(draw.choice(["ab", "é", "zz", "q"]) for _ in range(draw.randint(0, 30))), "x") for i in range(120)] + [(7, None, "x"), (8, "", "x"), (9, "same", "x"), (9, "same", "x"), (None, "no id", "x")]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, h string").repartition(5)
    out = fingerprint.compare(docs).collect()
    assert len(out) == len(rows)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    order = sorted(((i if i is not None else -1, signed(t or ""), t or "") for i, t, _ in rows), reverse=True)
    want = {}
    for n, (i, _, t) in enumerate(order):
        other = order[(n + 1) % len(order)][2]
        new = t[: len(t) - len(t) // 3] + other[: len(t) // 3]
        a, b, c = (fingerprint.fingerprint(x) for x in (t, new, other))
        want.setdefault(i, []).append((len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    for r in out:
        assert tuple(r)[1:] in want[r.doc_id if r.doc_id is not None else -1]
    single = fingerprint.compare(spark.createDataFrame([(1, "abcdef", "")], "doc_id long, text string, h string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert fingerprint.compare(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", ["1", "2000"])
def test_ranges_are_even_whatever_the_ids(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(None if i % 3 == 0 else "hot" if i % 3 == 1 else f"id{i}", f"some words of {i % 2}") for i in range(600)] + [("long", "w " * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        held = [r[0] for r in fingerprint._in_ranges(docs, "doc_id", "text").groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
        assert len(held) == 12 and max(held) < 2 * np.median(held)  # a third of the rows has one id, a third none
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        out = fingerprint.compare(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(out) == len(rows) and {r.doc_id for r in out} == {r[0] for r in rows}
    hot = [r for r in out if r.doc_id == "hot"]
    assert sum(r.near_next == 1.0 for r in hot) >= len(hot) - 2  # equal texts follow one another


def plain_densification(text, bins=256, bits=4):
    """Least hash by bin, empty bins filled from the first filled one of their own order, low bits of each."""
    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    least = {}
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 7)
        least[h >> 56] = min(h, least.get(h >> 56, h))
    if not least:
        return ""
    orders = fingerprint._orders(bins)
    values = [least[b] if b in least else least[min(least, key=lambda f: orders[b][f])] for b in range(bins)]
    return "".join(f"{v % 16:x}" for v in values)


def test_fingerprint_equals_a_plain_densification():
    draw = random.Random(12)
    for n in (0, 1, 3, 5, 6, 20, 200, 3000):
        text = " ".join(draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(n))
        assert fingerprint.fingerprint(text) == plain_densification(text), n


# -- token counts


def test_counts_equal_the_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = token_count.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    least = min(s for _, s in vocabulary)
    other = [(f"<0x{b:02X}>", least) for b in range(256)]  # the tokenizer has bytes as pieces
    plain = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", least), *vocabulary, *other], 0, True))
    plain.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    draw = random.Random(5)
    texts = ["", " ", "Hello world", "a  b\n\nc\td", "日本語 тест 😀", "▁x▁ ▁", "the " * 300, "x" * 400]
    texts += ["".join(draw.choice("abcdeÉß ▁\n日.,1") for _ in range(draw.randint(1, 80))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, None, 1), (None, None, 1)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in token_count.count_tokens(docs, tokenizer_path("piece_bpe_32k.model")).collect()}
    for i, t in enumerate(texts):
        assert got[i].n_tokens == len(plain.encode(t, add_special_tokens=False).ids) and got[i].n_chars == len(t), t
    assert got[None].n_tokens == 0
    assert token_count.count_tokens(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).count() == 0
    ties = token_count.Counter([("<unk>", -100.0), ("a", -1.0), ("aa", -2.0), ("aaa", -3.0), ("b", -5.0)])
    assert [ties.best("a" * n)[0] for n in range(1, 8)] == [1, 1, 1, 2, 2, 2, 3]  # of equal scores the longest last piece stays


def test_control_and_byte_pieces_never_match_text():
    path = tokenizer_path("piece_bpe_32k.model")
    count = token_count.counter(path).count
    assert not {"<s>", "</s>", "<unk>", "<0x41>"} & {p for p, _ in token_count.vocabulary(path)}
    assert count("a<s>b") == 5 and count("x <0x41> y") > 5


@pytest.mark.parametrize("crossing", [False, True])
def test_fractional_scores_equal_the_tokenizer(crossing):
    tokenizers = pytest.importorskip("tokenizers")
    draw = random.Random(8)
    pieces = {"▁": -3.3, "\n": -4.0} | {"".join(draw.choice("abc▁" if crossing else "abc") for _ in range(draw.randint(1, 4))): -draw.random() * 9 for _ in range(60)}
    pieces |= {"▁" + p: -draw.random() * 9 for p in list(pieces)[2:20]} | {"ab": -2.5, "a": -1.25, "b": -1.25}  # with ties
    plain = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", min(pieces.values())), *pieces.items()], 0, False))
    plain.normalizer = tokenizers.normalizers.Sequence([tokenizers.normalizers.Prepend("▁"), tokenizers.normalizers.Replace(" ", "▁")])
    count = token_count.Counter(list(pieces.items()), fallback=False).count
    for text in ["", *["".join(draw.choice("aaabbbcc  dé\n▁") for _ in range(draw.randint(1, 200))) for _ in range(300)]]:
        assert count(text) == len(plain.encode(text, add_special_tokens=False).ids), text


def test_long_words_are_not_remembered():
    counter = token_count.Counter([("<unk>", -100.0), ("a", -1.0)])
    assert counter.count("a" * 5000 + " b") == 3 + 5000 + 3 + 1 and max(map(len, counter.known)) <= token_count.LONGEST


# -- HTML

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">A<li><a href="/b">B</ul></nav><div class="cookie-notice">We use cookies on this site to serve you</div>
<article><h1>Head &lt;one&gt;</h1><p>First <b>bold</b>   text&nbsp;here.<p>Second &eacute; line</p><div class="ad">Buy now this very fine thing today</div><form><input>Sign up here for news</form><!-- <p>hidden</p> -->
<p>Last one.</p><section id="comments"><p>Nice post, thanks for it</p></section></article><aside>More to read on other pages</aside><footer>&copy; me</footer></body></html>"""


def test_main_text_and_odd_pages(spark):
    weight = html_extract.weights({("word", True): 500, ("word", False): 80, ("p", True): 40, ("nav", False): 10, ("div", False): 10, ("footer", False): 10})
    assert html_extract.extract(PAGE, weight) == "Head <one>\nFirst bold text here.\nSecond é line\nLast one."
    bare = "<div><a>x</a></div><div>one two three four five six</div><p>seven eight nine</p><div><div><div>z</div></div></div>"
    assert "one two three four five six\nseven eight nine" in html_extract.extract(bare, weight)
    for odd in (None, "", "<", "<<<", "<p", "<!--", "<script>", "&#0;&bogus;", "<a href='", "</p></p>", "<nav>never closed text"):
        html_extract.extract(odd, weight)
    pages = spark.createDataFrame([(1, "u", PAGE, 3), (2, None, None, 3), (2, None, "", 3), (2, None, "", 3), (None, "v", "plain words only", 3)], "page_id long, url string, html string, n_chars int")
    got = html_extract.main_text(pages).collect()
    assert len(got) == 5 and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert {(r.page_id, r.text) for r in got} == {(1, "Head <one>\nFirst bold text here.\nSecond é line\nLast one."), (2, ""), (None, "plain words only")}
    assert all(r.n_chars == len(r.text) for r in got) and html_extract.main_text(pages.limit(0)).count() == 0


def test_main_text_on_the_test_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in html_extract.main_text(rows.withColumn("copy", rows.html)).collect():
        article = re.search("<article>(.*)</article>", r.copy, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)[^>]*>", article))
        assert r.text == "\n".join(b for b in blocks if b)


# -- WARC


def test_warc_derivatives(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", PAGE, "r"), (2, None, None, "r"), (3, "http://é/", "", "r")], "page_id long, url string, html string, record_id string")
    responses = warc.responses(pages)
    (tmp_path / "x.warc.gz").write_bytes(b"".join(warc.to_bytes(r.asDict(recursive=True)) for r in responses.collect()))
    (tmp_path / "y.warc").write_bytes(b"".join(warc.to_bytes(r.asDict(recursive=True), compress=False) for r in responses.collect()))
    back = warc.read(spark, f"file://{tmp_path}").collect()
    key = lambda r: (r.record_id, r.target_uri or "", bytes(r.block), r.block_digest, r.payload_digest, r.date, r.content_type)
    assert sorted(map(key, back)) == sorted(map(key, responses.collect() * 2))
    source = {r.record_id: r for r in responses.collect()}
    derived = warc.derive(responses).collect()
    assert len(derived) == 6 == len({r.record_id for r in derived})
    for r in derived:
        of = source[r.refers_to]
        assert r.block_digest == warc.digest(bytes(r.block)) and (r.target_uri, r.date) == (of.target_uri, of.date)
        assert {"name": "WARC-Refers-To", "value": r.refers_to} in [h.asDict() for h in r.headers]
        if r.warc_type == "metadata":
            e = json.loads(bytes(r.block))["Envelope"]
            assert e["WARC-Payload-Digest"] == of.payload_digest and e["WARC-Header-Metadata"] == [[h.name, h.value] for h in of.headers]
            assert e["Payload-Metadata"]["HTTP-Response-Metadata"]["Headers"][0][0] == "Content-Type"
    text = next(bytes(r.block).decode() for r in derived if r.warc_type == "conversion" and r.target_uri == "http://a/")
    assert text.splitlines()[0] == "T & t" and "Home" in text and "First bold text here." in text and "var a" not in text
    assert warc.derive(responses.withColumn("warc_type", responses.content_type)).count() == 0
    assert warc.derive(responses.limit(0)).count() == 0 and warc.http_parts(b"junk") == ("", [], b"junk")


def test_archives_with_bad_records(spark, tmp_path):
    between = warc.BETWEEN.encode()
    block = b"body" + between + b"0\r\nno record" + between + b"x"
    of = lambda length, block: b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: " + length + b"\r\n\r\n" + block + b"\r\n\r\n"
    files = {"whole": of(str(len(block)).encode(), block) + of(b"3", b"abc") + of(b"0", b""), "bad": of(b"many", b"abc") + of(b"-1", b"d") + of(b"2", b"ef"), "short": of(b"2", b"gh") + of(b"900", b"cut"), "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    got = sorted(bytes(r.block) for r in warc.read(spark, f"file://{tmp_path}").collect())
    assert got == sorted([block, b"abc", b"", b"abc", b"d", b"ef", b"gh", b"cut\r\n\r\n"])
    assert warc.parse_one(b"") == (None, 0) == warc.parse_one(b"0\r\n\r\n")


def plain_records(data):
    """Blocks of an archive read from its start: each as long as its header says, the next record at the first beginning behind it."""
    out, at = [], data.find(b"WARC/1.")
    while at >= 0:
        head = data.find(b"\r\n\r\n", at)
        length = int(re.search(rb"Content-Length: (\d+)", data[at:head])[1])
        out.append(data[head + 4 : head + 4 + length])
        at = data.find(b"\r\n\r\nWARC/1.", head + length)
        at = at + 4 if at >= 0 else at
    return out


@pytest.mark.parametrize("size", ["50", "400", "100000"])
def test_records_do_not_depend_on_splits(spark, tmp_path, size):
    draw, wanted = random.Random(int(size)), []
    inner = b"\r\n\r\nWARC/1.0\r\nWARC-Type: false\r\nContent-Length: %d\r\n\r\nin"
    for name in ("a.warc", "b.warc", "c.warc.gz", "z"):
        data = b""
        for i in range(25):
            block = draw.choice([b"%d:" % i, b"WARC/1."]) + b"x" * draw.choice([0, 3, 90]) + b"".join(draw.choice([inner % draw.choice([0, 5, 900]), b"\r\n\r\n", b"y" * 60, b"WARC/1.", b"\xff"]) for _ in range(draw.choice([0, 0, 0, 4])))
            data += b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
        blocks = plain_records(data)
        assert len(blocks) == 25
        wanted += blocks
        (tmp_path / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = warc.read(spark, f"file://{tmp_path}").collect()
        assert sorted(bytes(r.block) for r in got) == sorted(wanted) and {r.warc_type for r in got} == {"resource"}
        none = tmp_path / "none"
        none.mkdir()
        (none / "x.warc.gz").write_bytes(gzip.compress(b""))
        assert warc.read(spark, f"file://{none}").count() == 0
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_a_length_over_the_end_of_a_record_by_its_line_ends():
    first, second = b"0\r\nWARC-Type: a\r\nContent-Length: %d\r\n\r\nabc", b"0\r\nWARC-Type: b\r\nContent-Length: 1\r\n\r\nd"
    blocks = lambda n: [r["block"] for r in warc.records([(1, first % n), (1, second)])]
    assert blocks(3) == [b"abc", b"d"] and blocks(5) == [b"abc\r\n", b"d"] and blocks(7) == [b"abc\r\n\r\n", b"d"]
    assert len(blocks(8)) == 1 and blocks(8)[0][:8] == b"abc\r\n\r\nW"
    assert [r["block"] for r in warc.records([(1, first % 900), (2, second)])] == [b"abc", b"d"]


def test_registered_records_equal_a_plain_build(spark):
    import hashlib

    from citeloom.llm import queries

    folder = "/root/testdata/sf0.001"
    pages = {r.url: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.op6_warc(spark, folder).collect()
    assert len(got) == 2 * len(pages)
    for r in got:
        page = pages[r.target_uri]
        source = warc.response(str(page.page_id), page.url, page.html)
        assert r.refers_to == source["record_id"] and r.date == source["date"]
        if r.warc_type == "conversion":
            block = warc.read_page(page.html)[0].encode()
            assert r.content_length == len(block) and r.block_digest == "sha1:" + __import__("base64").b32encode(hashlib.sha1(block).digest()).decode()
            want = html.unescape(re.sub(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ", page.html))
            assert re.sub(r"\s+", "", block.decode()) == re.sub(r"\s+", "", want)
        else:
            assert r.warc_type == "metadata" and r.content_length > 0


WRAPPERS = ['class="site has-sidebar"', 'class="layout right-sidebar"', 'class="social-science"', 'class="article search-result"', 'id="related-work"', 'id="hidden-gems"', 'class="post-comments-open"', 'class="sidebar"', 'class=widget']


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("region", ["article", "div"])
def test_wrappers_never_take_the_article_with_them(wrapper, region):
    weight = html_extract.weights({("word", True): 500, ("word", False): 80, ("p", True): 40, ("div", False): 10})
    words = " ".join(f"word{i} is here." for i in range(40))
    page = f"<body><nav>a b</nav><div {wrapper}><{region}><p>{words}</p><div class='comments'>a reader says hi</div></{region}></div><div class='sidebar'>c d</div></body>"
    assert html_extract.extract(page, weight) == words


def test_long_comments_go_where_the_region_is_marked():
    weight = html_extract.weights({})
    page = f"<body><article><p>{'text ' * 30}</p></article><div id='comments'><p>{'reader ' * 90}</p></div></body>"
    assert html_extract.extract(page, weight) == ("text " * 30).strip()


ROWS = "".join(f"<tr><td>row</td><td>{i}</td></tr>" for i in range(200))
KEPT = [
    (f"<article><p>one two</p><table>{ROWS}</table><p>last words</p></article>", "one two\n" + "\n".join(f"row\n{i}" for i in range(200)) + "\nlast words"),
    ("<article><p>one two</p><div><div><div><img src=x><img src=y></div></div></div><div><figure><img><figcaption>cap</figcaption></figure></div><p>closing words</p></article>", "one two\ncap\nclosing words"),
    ("<article><h1>Short</h1><pre>a  b\nc</pre><ul><li>x<li>y</ul><ol><li>z</ol></article>", "Short\na b c\nx\ny\nz"),
    ("<div class=links>" + "word " * 200 + "</div><article>nine words are all that this small article has</article>", "nine words are all that this small article has"),
    ("<article>" + "text " * 60 + "<section id=comments>" + "reader " * 200 + "</section></article>", ("text " * 60).strip()),
    ("<main><h1>T</h1><p>a b c</p><div class='related-posts'><article>teaser</article></div></main>", "T\na b c"),
    ("<article><p>own text</p></article><section class='comments'><article class='comment'>nice</article><article class='comment depth-2'>yes</article></section>", "own text"),
    ("<article><p>own text</p></article><article class='comment'>nice</article>", "own text"),
    ("<article><header><h1>Head</h1></header><p>x y</p><footer>tags</footer></article>", "Head\nx y"),
    ("<article>first part</article><div>between</div><article>second part</article>", "first part\nsecond part"),
    *[(f"<article><p>a b c d</p><div class='{name}'>no content at all here</div><p>e f</p></article>", "a b c d\ne f") for name in ("post-comments", "comments-area", "cookie-bar", "sidebar-right", "ad-slot", "x widget_text", "top-banner")],
    *[(f"<article><p>a b</p><div class='{name}'>stays here</div></article>", "a b\nstays here") for name in ("adhesive", "shadow", "headed", "commentary", "has-sidebar", "comments-open", "address")],
    ("<div class='comments'><p>only readers speak here</p></div>", ""),
]


@pytest.mark.parametrize(("body", "want"), KEPT)
def test_marked_regions_are_kept_whole(body, want):
    weight = html_extract.weights({("word", True): 500, ("word", False): 80, ("p", True): 40, ("p", False): 1, ("div", False): 60, ("td", False): 5})
    for w in (weight, html_extract.weights({})):
        assert html_extract.extract(f"<html><body><nav>a b</nav>{body}<footer>f</footer></body></html>", w) == want


def test_hard_pages_take_linear_time():
    weight = html_extract.weights({})
    for page in ("<a " * 350_000 + '"', "<a x=\"" * 150_000, "<" * 1_000_000, "<!--" * 250_000, "<title>" * 150_000, "<div>" * 100_000 + "</x>" * 100_000, "<a href='" * 110_000, "x" * 1_000_000, "<div class=widget>" * 60_000 + "a"):
        began = time.time()
        html_extract.extract(page, weight)
        warc.read_page(page)
        assert time.time() - began < 5, page[:10]  # well under a second each, on an idle machine
