"""Each operator against brute force over a small table, and its defined results for odd rows."""

import base64
import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyspark.sql.functions as F
import pytest
import xxhash

from siftpool.llm import bpe, cotrain, decontam, exact, htmlcut, langid, neardup, queries, secrets, sharding, spans

from .conftest import SMALL

SQL_TABLES = "/root/testdata/sf0.01"


def texts_of(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}


# Sharding


def test_sharding_balance_and_slots(spark, documents):
    rows = queries.op1_sharding(spark, SMALL).collect()
    source = texts_of(documents)
    assert len(rows) == len(source)
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) <= set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))
    for r in rows:
        raw = (source[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def test_sharding_matches_a_sequential_walk(spark):
    """Counts of every (arc, shard) equal those of a walk that settles nearer shards first."""
    points, owners = sharding.ring(4, 8)
    orders = sharding.preferences(owners)
    counts = [(i * 7) % 13 for i in range(len(points) + 1)]
    caps = sharding.capacities(sum(counts), 4, 1.0)
    runs = sharding.allot(counts, orders, caps)
    room, expected = list(caps), [Counter() for _ in counts]
    left = list(counts)
    for step in range(4):
        for arc, order in enumerate(orders):
            while left[arc] and room[order[step]]:
                room[order[step]] -= 1
                left[arc] -= 1
                expected[arc][order[step]] += 1
    assert [Counter(dict(r)) for r in runs] == expected


def test_sharding_growth_moves_little(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    a = {r["k"]: r["shard"] for r in sharding.assign_shards(df, "k", 8).collect()}
    b = {r["k"]: r["shard"] for r in sharding.assign_shards(df, "k", 9).collect()}
    assert max(Counter(a.values()).values()) <= 4000 * 1.25 / 8 + 1
    assert sum(a[k] != b[k] for k in a) < 4000 * 0.4


def test_sharding_against_a_walk_of_the_ring(spark):
    """Every row's shard, by walking the ring row by row: nearer shards take rows before farther ones."""
    import bisect

    df = spark.range(1500).select((F.col("id") % 700).alias("k"), F.col("id").alias("d"))
    points, owners = sharding.ring(5, 16)
    spot = F.shiftrightunsigned(F.xxhash64("k"), 12).cast("double") / float(2**52)
    rows = df.select("k", "d", spot.alias("s"), F.pmod(F.xxhash64(F.lit(1), F.col("k")), F.lit(sharding.LANES)).alias("l")).collect()
    orders, room = sharding.preferences(owners), sharding.capacities(1500, 5, 1.0)
    arcs = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["l"], r["s"], r["k"], r["d"])):
        arcs[bisect.bisect_right(points, r["s"])].append(r["d"])
    expected = {}
    for step in range(5):
        for arc in sorted(arcs):
            shard = orders[arc][step]
            while arcs[arc] and room[shard]:
                expected[arcs[arc].pop(0)] = shard
                room[shard] -= 1
    got = {r["d"]: r["shard"] for r in sharding.assign_shards(df, "k", 5, vnodes=16, load=1.0, digest="d").collect()}
    assert got == expected
    apart = defaultdict(set)
    for d, shard in got.items():
        apart[d % 700].add(shard)
    assert sum(len(v) > 1 for v in apart.values()) < 16


def test_sharding_does_not_depend_on_partitions(spark):
    """A third of the rows alike in all, a third of one key, the others of their own."""
    i = F.col("id")
    df = spark.range(6000).select(F.when(i % 3 == 0, None).when(i % 3 == 1, 7).otherwise(i).alias("k"), F.when(i % 3 > 0, i).alias("d"))
    got = [Counter(tuple(r) for r in sharding.assign_shards(df.repartition(n, "d"), "k", 8, load=1.0, digest="d").collect()) for n in (2, 5)]
    assert got[0] == got[1]


def test_sharding_odd_rows(spark, odd):
    got = sharding.assign_shards(odd.withColumn("slot", F.lit("old")), "doc_id", 3, load=1.0, digest="text")
    assert got.count() == odd.count() and dict(got.dtypes)["slot"] == "bigint"
    assert sharding.assign_shards(odd.limit(0), "doc_id", 3).count() == 0
    same = spark.range(3000).select(F.lit(1).alias("k"))
    sizes = [r["n"] for r in sharding.assign_shards(same, "k", 4, load=1.0).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("d")).filter("n = d").collect()]
    assert sorted(sizes) == [750] * 4


# Substring dedup


def brute_spans(texts, null_last=True):
    """Cut texts by a plain dictionary of runs, documents in order of id."""
    seen, out = {}, {}
    for doc in sorted(texts):
        found = spans.units(texts[doc] or "")
        at = [i for i, u in enumerate(found) if u[2]]
        words = [" ".join((texts[doc] or "")[found[i][0] : found[i][1]].split()) for i in at]
        own = set()
        for i in range(len(at)):
            for j in range(i + 3, len(at) + 1):
                if sum(len(w.split()) for w in words[i:j]) >= 12:
                    own.add((i, j))
                    break
        for j in range(3, len(at) + 1):
            for i in range(j - 3, -1, -1):
                if sum(len(w.split()) for w in words[i:j]) >= 12:
                    own.add((i, j))
                    break
        gone, new = set(), {}
        for i, j in sorted(own):
            key = tuple(words[i:j])
            if key in seen or key in new:
                gone.update(range(at[i], at[j - 1] + 1))
            new.setdefault(key, doc)
        seen.update(new)
        out[doc] = "".join((texts[doc] or "")[u[0] : u[1]] for k, u in enumerate(found) if k not in gone)
    return out


def test_spans_against_brute_force(spark, documents):
    source = texts_of(documents)
    got = {r["doc_id"]: r["text"] for r in queries.op2_substring_dedup(spark, SMALL).collect()}
    assert got == brute_spans(source)


def test_spans_odd_rows(spark, odd):
    rows = spans.dedup_spans(odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows if r["doc_id"] in (2, 5, 6)}
    assert by[2]["text"] is None and by[5]["n_removed"] == 0 and by[6]["text"] == "" and by[6]["first_ids"] == [5]
    assert spans.dedup_spans(odd.limit(0)).count() == 0


def test_spans_of_rows_without_ids(spark):
    """Rows of null id count as the last ones; each loses only what its own text has from others."""
    one, two = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")
    df = spark.createDataFrame([(1, one), *[(None, f"x{i} {one}") for i in range(3)], *[(None, f"y{i} {two}") for i in range(3)], (None, None)], "doc_id long, text string")
    rows = spans.dedup_spans(df).collect()
    assert len(rows) == 8 and sum(r["n_removed"] > 0 for r in rows) == 3
    assert all((r["n_removed"] > 0) == (r["text"] or "").startswith("x") and (r["n_removed"] == 0 or r["first_ids"] == [1]) for r in rows)


def test_spans_find_a_passage_without_sentences_at_any_word():
    passage = " ".join(f"p{i * 7919 % 1000}" for i in range(60))
    for k in range(12):
        one, two = (" ".join(f"{c}{i * 31 % 97}" for i in range(k)) for c in "ab")
        known = spans.runs(spans.units(f"{one} {passage} tail of one."))[2]
        text, n, removed = spans.cut(f"{two} {passage} end", known)
        assert removed >= 3 and len(text.split()) < 30 + k and text.startswith(two.split(" ")[0])


def plain_units(text, size):
    """Units by definition: the word that each window of `size` words chooses ends one, unless it closes a sentence, which does so anyway."""
    words = [(m.start(), m[0]) for m in re.finditer(r"\S+", text)]
    stops = [m.end() for m in spans._SENTENCE.finditer(text) if m[0]]
    counts = [sum(at < stop for at, _ in words) for stop in stops]
    closing = {n - 1 for n, before in zip(counts, [0, *counts], strict=False) if n > before}
    for low in range(len(words) - size + 1):
        window = range(low, low + size)
        if closing.isdisjoint(window):
            chosen = min(window, key=lambda k: (xxhash.xxh3_64_intdigest(words[k][1]) >> 32, -k))
            stops.append(words[chosen + 1][0])
    stops = sorted(set(stops))
    held = [[w for at, w in words if begin <= at < stop] for begin, stop in zip([0, *stops], stops, strict=False)]
    return [(begin, stop, len(own), xxhash.xxh3_64_intdigest(" ".join(own))) for begin, stop, own in zip([0, *stops], stops, held, strict=False)]


def test_span_units_against_plain_windows():
    draw = random.Random(7)
    for _ in range(400):
        text = "".join(draw.choice("aab  .!?\n\t\u3000\x85\u00a0\x1cé\U0001f600") for _ in range(draw.randrange(160)))
        for size in (2, 3, 12):
            assert spans.units(text, size) == plain_units(text, size)
    assert spans.units("") == []


def test_spans_find_a_passage_of_51_words_at_every_offset():
    def text(name, words, length, lead):
        return [f"{name}{i * 7919 % 10007}" + "." * ((i + lead) % length == length - 1) for i in range(words)]

    for length in (5, 8, 12, 13, 15, 16, 20, 40):
        source = text("s", 130, length, 0)
        known = spans.runs(spans.units(" ".join(source)))[2]
        for k in range(len(source) - 50):
            for place in (0, 7, 33):
                copy = text("c", 60, length, k)
                copy[place:place] = source[k : k + 51]
                out, _, removed = spans.cut(" ".join(copy), known)
                assert removed >= 3 and len(out.split()) <= 60 + 24, (length, k, place)


def test_units_cover_the_text():
    for text in ("", "A. B!  C\n\nD e f", "x" * 50 + " y.z w", "no end " * 40, "…\n.?! a"):
        found = spans.units(text)
        assert "".join(text[a:b] for a, b, _, _ in found) == text


# Secrets


def test_secret_base_spans_against_plain_patterns(spark, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    source = texts_of(documents)
    for r in queries.op3_secrets(spark, SMALL).collect():
        text = source[r["doc_id"]] or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        told = ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(found))
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == k for f in found) for k in range(3)]


def der(tag, *parts):
    body = b"".join(parts)
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82]) + len(body).to_bytes(2, "big")
    return bytes([tag]) + size + body


def test_secret_structures():
    number = der(2, b"\x01" * 40)
    rsa = der(0x30, der(2, b"\0"), *[number] * 8)
    coded = base64.b64encode(rsa).decode()
    assert any(secrets.KINDS[k] == "der" for _, k, _ in secrets.scan(f"x {coded} y"))
    assert not any(secrets.KINDS[k] == "der" for _, k, _ in secrets.scan(f"x {coded[:-8]} y"))
    assert any(secrets.KINDS[k] == "derhex" for _, k, _ in secrets.scan(rsa.hex().upper()))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{coded[:64]}\n{coded[64:]}\n-----END RSA PRIVATE KEY-----"
    assert any(secrets.KINDS[k] == "pem" for _, k, _ in secrets.scan(pem))
    assert any(secrets.KINDS[k] == "pem" and e - s == len(json.dumps(pem)) - 2 for s, k, e in secrets.scan(f"key: {json.dumps(pem)},"))
    b64 = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{b64({'alg': 'HS256'})}.{b64({'sub': 1})}.abc"
    assert [(secrets.KINDS[k], s) for s, k, _ in secrets.scan(f"t {token}")] == [("jwt", 2)]
    assert not secrets.scan(f"t {b64({'a': 1})}.{b64({'sub': 1})}.abc")
    ssh = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"".join(len(x).to_bytes(4, "big") + x for x in (b"pub" * 9, b"key" * 9))
    assert any(secrets.KINDS[k] == "ssh" for _, k, _ in secrets.scan(base64.b64encode(ssh).decode()))


def test_secret_structures_without_a_frame():
    kinds = lambda text: {secrets.KINDS[k]: (s, e) for s, k, e in secrets.scan(text) if k > 2}
    number = der(2, b"\x01" * 40)
    coded = base64.b64encode(der(0x30, der(2, b"\0"), *[number] * 8)).decode()
    lines = [coded[i : i + 64] for i in range(0, len(coded), 64)]
    for end in ("\n", "\r\n", "\n    ", "\\n"):
        text = "key " + end.join(lines) + end + "Next line of words"
        assert kinds(text) == {"der": (4, 4 + len(end.join(lines)))}, end
    assert not kinds(end.join(lines[:-1]) + " Next")
    pem = f"-----BEGIN PRIVATE KEY-----\n{coded}\n-----END PRIVATE KEY-----\n"
    twice = base64.b64encode(pem.encode()).decode()
    assert "pembase64" in kinds(f"data: {twice}") and kinds(f"data: {twice}")["pembase64"] == (6, 6 + len(twice))
    code = lambda x: base64.urlsafe_b64encode(x).decode().rstrip("=")
    for head in (b'{ "alg": "RS256" }', b'{\n "typ":"JWT", "alg":"ES256"}', b' {"alg":"EdDSA"}'):
        for payload in ("", code(b"\x78\x9c\x01plain"), code(b'{"a":1}')):
            token = f"{code(head)}.{payload}.c2ln"
            assert kinds(f"www.example.com {token}") == {"jwt": (16, 16 + len(token))}
            assert kinds(f"e0123456789012.{token}") == {"jwt": (15, 15 + len(token))}
    assert not kinds("e0123456789abcdef.x.y www.example.com.org")
    field = lambda x: len(x).to_bytes(4, "big") + x
    many = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (20).to_bytes(4, "big") + field(b"pub" * 9) * 20 + field(b"key" * 9)
    assert "ssh" in kinds(base64.b64encode(many).decode())
    assert not kinds(base64.b64encode(many[:-30]).decode())


def test_secret_letters_are_ascii_and_places_code_points():
    assert secrets.scan("ſecret=abcdef toKen=abcdef") == []
    assert secrets.scan("🤗 PassWord = 'abc.def'") == [(2, 0, 21)]


def test_secrets_odd_rows(spark, odd):
    assert secrets.find_secrets(odd).count() == odd.count()
    assert secrets.find_secrets(odd.limit(0)).count() == 0


# HTML


def test_html_articles(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in queries.op4_html_text(spark, SMALL).collect():
        inner = pages[r["page_id"]].split("<article>")[1].split("</article>")[0]
        inner = re.sub(r"</?b>", "", inner)
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", inner)).split())
        assert r["n_chars"] == len(r["text"])


def test_html_boilerplate_without_semantic_tags():
    page = """<body class="has-sidebar"><div id="cookie-notice">We use cookies.</div><div class="menu"><a href=/>Home</a></div>
    <div class="content"><h1>Title</h1><p>A first paragraph &eacute; of the <b>main</b> text, long enough.</p><p>Short.</p>
    <div class="ad-box">Buy now!</div><p>Second.<br>line</p></div><div class="sidebar"><p>Related stories here.</p></div>
    <form><p>Subscribe</p></form><section id="comments"><p>A comment that is rather long, thanks for writing it.</p></section></body>"""
    assert htmlcut.main_text(page) == "Title A first paragraph é of the main text, long enough. Short. Second. line"


_PROSE = "Running prose that goes on for a while, with commas, and ends with a full stop. " * 6
_REMARK = "UNWANTED remark that is quite long, has commas, and sounds like an article. " * 20


@pytest.mark.parametrize(
    "page",
    [
        f"<main><article class=post><h1>Wanted</h1><p>{_PROSE}</p><p>Wanted.</p><div id=comments><ol class=comment-list><li class=comment><div class=comment-body><p>{_REMARK}</p></div></ol></div></article></main>",
        f"<article><p>Wanted {_PROSE}</p><ul class=commentlist><li><p class='text body'>{_REMARK}</ul><p>Wanted</p></article>",
        f"<article><p>{_PROSE}</p><div class=ad-slot><p>{_REMARK}</p></div><p>Wanted Wanted</p></article>",
        f"<article class='social-issues tags-politics' id=privacy-notice><h1>Wanted</h1><p>Wanted {_PROSE}</p></article>",
        f"<main><article><p>Wanted {_PROSE}</p><p>Wanted</p></article><section><article class=comment><div class=content><p>{_REMARK}</p></div></article></section></main>",
        f"<body><div><a href=/>UNWANTED</a> <a href=/x>UNWANTED</a></div><div><h1>Wanted</h1><div>Wanted {_PROSE}</div></div><div>UNWANTED © 2020 All rights reserved.</div></body>",
        f"<div class='content has-sidebar'><p>Wanted {_PROSE}</p><p>Wanted</p></div><div class=newsletter><p>{_REMARK}</p></div>",
    ],
)
def test_html_remarks_and_adverts_in_articles(page):
    text = htmlcut.main_text(page)
    assert "UNWANTED" not in text and text.count("Wanted") == 2 and _PROSE.strip() in text


def test_html_cut_beats_the_threshold_on_layouts_it_was_not_fitted_on():
    from siftpool.llm import htmltrain

    weights, scale = htmltrain.fitted()
    made = htmltrain.pages(htmltrain.HELD_OUT, 150, 7)
    cut, total = htmltrain.accuracy(made, weights, scale)
    alone, _ = htmltrain.accuracy(made, weights, 0.0)
    assert scale > 0 and cut >= 0.96 * total and cut - alone >= 0.01 * total
    assert all(found and any(truth) for found, _, truth in made)


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='layout sidebar-right'><nav><a href=/>UNWANTED</a></nav><div><h1>Wanted</h1><p>Wanted {_PROSE}</p></div></div>",
        f"<div class='page-wrapper has-menu header-fixed'><div class='elementor-widget-text-editor'><h1>Wanted</h1><p>{_PROSE}</p><p>Wanted, then.</p></div><div class=footer>UNWANTED</div></div>",
        f"<article><h1>Wanted</h1><p>Wanted <math><mi>x</mi><mo>=</mo><mn>2</mn></math> {_PROSE}</p></article><footer>UNWANTED</footer>",
        f"<article><h1>Wanted</h1><p>Wanted {_PROSE}</p><p>All rights reserved is what the old notice said; {_PROSE}</p></article>",
    ],
)
def test_html_wrappers_and_formulae(page):
    text = htmlcut.main_text(page)
    assert "UNWANTED" not in text and text.count("Wanted") == 2 and _PROSE.strip() in text and ("<math>" not in page or "x=2" in text)


def test_html_time_is_linear_in_nested_and_open_elements():
    import time

    weights = [1.0] * (len(htmlcut.FEATURES) + 1)
    for make in (lambda n: "<div>x" * n, lambda n: "<b>" * n + "<div>x</div></i>" * n, lambda n: "<p>x" * n + "</q>" * n):
        times = []
        for n in (4000, 32_000):
            began = time.process_time()
            assert len(htmlcut.main_text(make(n), weights, 1.0)) == 2 * n - 1
            times.append(time.process_time() - began)
        assert times[1] < 25 * times[0] + 1


@pytest.mark.parametrize("page", ["", "<", "<p", "<!--", "<script>x", "</p></p>", "<a href='", "<p>" * 500, "&#x110000; &bogus; &amp"])
def test_html_broken_pages(page):
    htmlcut.main_text(page)


def test_max_flow_is_a_minimum_cut():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(2, 6)
        edges = [(a, b, rng.randint(0, 9), rng.randint(0, 9)) for a in range(n + 2) for b in range(a + 1, n + 2) if rng.random() < 0.6]
        net = htmlcut.Network(n + 2)
        for e in edges:
            net.join(*e)
        cost = lambda s: sum((f if s[a] and not s[b] else 0) + (g if s[b] and not s[a] else 0) for a, b, f, g in edges)
        side = net.side(n, n + 1)
        best = min(cost([*c, True, False]) for c in itertools.product([False, True], repeat=n))
        assert side[n] and not side[n + 1] and cost(side) == best


def test_html_odd_rows(spark, odd):
    pages = odd.withColumnRenamed("text", "html").withColumn("text", F.lit(3))
    assert htmlcut.extract(pages).count() == odd.count()
    assert htmlcut.extract(pages.limit(0)).count() == 0


# Exact dedup


def test_exact_against_brute_force(spark, documents):
    groups = defaultdict(list)
    for d, t in texts_of(documents).items():
        groups[t or ""].append(d)
    expected = {d: (max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    rows = queries.op5_exact_dedup(spark, SMALL).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows} == expected
    assert len(rows) == len(expected)


def test_exact_fingerprints_compose():
    import random

    rng = random.Random(2)
    data = rng.randbytes(30_000)
    whole = exact.chunk_hash(data)
    plain = [sum(b * pow(r, i, p) for i, b in enumerate(data)) % p for r, p in zip(exact.ROOTS, exact.PRIMES, strict=True)]
    assert list(whole[1:]) == plain
    parts = [exact.chunk_hash(data[a:b]) for a, b in ((0, 1), (1, 5000), (5000, 5000), (5000, 30_000))]
    joined = parts[0]
    for p in parts[1:]:
        joined = exact.combine(joined, p)
    assert joined == whole


def test_exact_fingerprints_of_chunk_rows(spark):
    data = bytes(range(256)) * 60
    rows = [(1, i, bytearray(data[i * 1000 : i * 1000 + 1000])) for i in range(16)] + [(2, 0, None)]
    got = {r["d"]: (r["size"], r["fp_a"], r["fp_b"]) for r in exact.fingerprint_chunks(spark.createDataFrame(rows, "d long, n int, b binary"), "d", "n", "b").collect()}
    assert got == {1: exact.chunk_hash(data), 2: (0, 0, 0)}


def test_exact_separates_equal_fingerprints(spark, monkeypatch):
    """With fingerprints made equal, the comparison alone must find the groups."""
    def same(batches):
        import pyarrow as pa

        for b in exact_summaries(batches):
            yield pa.RecordBatch.from_arrays([b[0], pa.array([8] * len(b)), pa.array([7] * len(b)), b[3]], b.schema.names)

    exact_summaries = exact._summaries
    monkeypatch.setattr(exact, "_summaries", same)
    df = spark.createDataFrame([(i, "abcdefg" + "xyz"[i % 3]) for i in range(9)], "doc_id long, text string")
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact.duplicate_groups(df).collect()}
    assert got == {i: (6 + i % 3, 3, i >= 6) for i in range(9)}


def test_exact_odd_rows(spark, odd):
    rows = exact.duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    assert sum(r["kept"] for r in rows) == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    kept = exact.dedup_exact(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert exact.dedup_exact(odd.limit(0)).count() == 0


def test_exact_texts_above_the_limit_are_hashed_in_chunks(spark, documents):
    """With a limit of 300 bytes most texts take the path of huge ones; nulls and repeated rows too."""
    repeated = documents.unionByName(documents.filter("doc_id % 5 = 0")).withColumn("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id")))
    key = lambda r: (r["id"] is None, r["id"] or 0, bytes(r["sha"]), r["keep_id"] or 0, r["group_size"], r["kept"])
    assert sorted(map(key, exact.duplicate_groups(repeated, huge=300).collect())) == sorted(map(key, exact.duplicate_groups(repeated).collect()))


def test_exact_of_one_text_of_many_megabytes(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["0123456789abcdef" * (1 << 20) + str(i % 2) for i in range(3)]
    pq.write_table(pa.table({"doc_id": [0, 1, 2], "text": texts}), tmp_path / "t.parquet")
    got = exact.duplicate_groups(spark.read.parquet(str(tmp_path / "t.parquet")))
    assert {r["id"]: (r["keep_id"], r["group_size"]) for r in got.collect()} == {0: (2, 2), 1: (1, 1), 2: (2, 2)}


def test_exact_rows_alike_in_all(spark):
    """Two thirds of the rows are one null id with one text, in more copies than one block has."""
    n = 2 * exact.COPIES + 5
    df = spark.range(n + 1000).select(F.when(F.col("id") >= n, F.col("id")).alias("doc_id"), F.when(F.col("id") >= n, F.col("id").cast("string")).alias("text"))
    got = exact.duplicate_groups(df).groupBy("group_size").agg(F.count("*").alias("rows"), F.sum(F.col("kept").cast("int")).alias("kept"))
    assert {tuple(r) for r in got.collect()} == {(n, n, 1), (1, 1000, 1000)}
    assert exact.dedup_exact(df).count() == 1001


def test_one_key_with_a_third_of_the_rows_goes_to_many_tasks(spark):
    from siftpool.llm._skew import probable, spread_join

    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("64", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
        met = spread_join(left, left.select("k").distinct(), ["k"], F.col("row"))
        sizes = [r["n"] for r in met.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 0.04 * 30_000
        wanted = left.filter("k % 1000 = 1").select(F.xxhash64("k"))
        marked = probable(left, F.xxhash64("k"), wanted)
        assert marked.filter("k % 1000 = 1 AND NOT _maybe").count() == 0 and marked.filter("_maybe").count() < 60
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


# Decontamination


def shingles(text, pattern):
    words = re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_decontamination_against_brute_force(spark, documents):
    items = {r["item_id"]: shingles(r["text"], r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    expected = set()
    for d, t in texts_of(documents).items():
        own = shingles(t, r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
        expected |= {(d, i, len(s & own), len(s)) for i, s in items.items() if s and len(s & own) >= 0.8 * len(s)}
    got = {(r["doc_id"], r["item_id"], r["n_found"], r["n_shingles"]) for r in queries.op6_decontamination(spark, SMALL).collect()}
    assert expected and got == expected
    parts = decontam.find_contained(documents, spark.read.parquet(f"{SMALL}/benchmark.parquet"), part_bytes=2000)
    assert {(r["doc_id"], r["item_id"], r["n_found"], r["n_shingles"]) for r in parts.collect()} == expected


def test_decontamination_finds_items_at_any_place(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 17, 40, 130])))) for i in range(60)]
    docs = [(i, " ".join([*(word() for _ in range(rng.randint(0, 900))), t, *(word() for _ in range(rng.randint(0, 900)))])) for i, t in items]
    got = decontam.find_contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(i, i) for i, _ in items}


def test_decontamination_in_parts_of_few_items(spark, documents):
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    doubled = items.unionByName(items.limit(3))
    whole = decontam.find_contained(documents, doubled)
    parts = decontam.find_contained(documents, doubled, part_items=15)
    assert Counter(tuple(r) for r in parts.collect()) == Counter(tuple(r) for r in whole.collect())
    hit = {r["doc_id"] for r in whole.collect()}
    left = {r["doc_id"] for r in decontam.decontaminate(documents, doubled, part_items=15).collect()}
    assert hit and left == {r["doc_id"] for r in documents.collect()} - hit


def test_decontamination_odd_rows(spark, odd):
    items = spark.createDataFrame([(1, None), (None, "alpha beta gamma delta epsilon"), (2, "one two"), (2, "one two"), (3, "")], "item_id long, text string")
    got = decontam.find_contained(odd, items).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter({(3, None): 3, (None, None): 1, (7, 2): 2, (8, 2): 2})
    assert decontam.decontaminate(odd, items).count() == odd.count() - 5
    assert decontam.find_contained(odd, items.limit(0)).count() == 0
    assert decontam.find_contained(odd.limit(0), items).count() == 0


# SentencePiece


def test_tokens_equal_the_library(spark, documents):
    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    texts = texts_of(documents)
    for r in queries.op7_sentencepiece(spark, SMALL).collect():
        ids = source.encode(texts[r["doc_id"]] or "", add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(source.decode(ids).encode()).hexdigest()


def test_tokens_of_odd_texts():
    import random

    import sentencepiece

    source = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    own = bpe.Encoder(queries.model_path())
    rng = random.Random(4)
    texts = ["", " ", "  a  b ", "a\nb\tc\r\n", "ﬁ Å", "　x", "a▁b", "▁", "x\x00y", "​", "<s>hi</s><0x41>", "日本語🤗", "a" * 999, "=-" * 400, " " * 77, "\U0010ffff", "mississippi" * 60]
    texts += ["".join(rng.choices("abcdeth nio\n▁éß日 01", k=rng.randint(1, 200))) for _ in range(150)]
    for text in texts:
        ids = source.encode(text, add_eos=True)
        assert own.ids(text) == ids
        assert bpe.decode(own.model, ids) == source.decode(ids)
    for _ in range(100):
        ids = [rng.randrange(32_000) for _ in range(12)]
        assert bpe.decode(own.model, ids) == source.decode(ids)


def test_tokens_refuse_other_models():
    def field(number, value):
        size = len(value)
        return bytes([number << 3 | 2, *([size & 127 | 128, size >> 7] if size > 127 else [size])]) + value

    kind, bytes_ = lambda n: bytes([3 << 3, n]), bytes([0x98, 0x02, 1])
    plain = bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1])
    good = field(2, kind(2) + bytes_) + field(3, plain)
    bpe.check(good)
    for bad in (field(2, kind(1) + bytes_) + field(3, plain), field(2, kind(2)) + field(3, plain), good + field(3, plain + field(2, b"table")), good + field(3, bytes([4 << 3, 1])), good + field(1, kind(4))):
        with pytest.raises(ValueError):
            bpe.check(bad)


def test_tokens_keep_common_words(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 30)
    monkeypatch.setattr(bpe, "TOGETHER", 60)
    texts = [" ".join(["common", "words", *(f"w{i}x{j}" for j in range(8))]) for i in range(40)]
    own, fresh = bpe.Encoder(queries.model_path()), bpe.Encoder(queries.model_path())
    got = list(own.digests(texts))
    assert len(own.numbers) < 60 and [g[0] for g in got] == [len(fresh.ids(t)) for t in texts]
    assert [g[2] for g in got] == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_tokens_odd_rows(spark, odd):
    rows = bpe.token_digests(odd, queries.model_path()).collect()
    assert len(rows) == odd.count() and {r["n_tokens"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    ids = bpe.encode(odd.withColumn("ids", F.lit(1)), queries.model_path())
    assert dict(ids.dtypes)["ids"] == "array<int>" and ids.filter("doc_id = 2").first()["ids"] == [2]
    assert bpe.token_digests(odd.limit(0), queries.model_path()).count() == 0


# Language


def test_language_held_out_accuracy(spark, documents):
    lang = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = queries.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_language_pieces_count_every_gram_once():
    import numpy as np

    text = "Añb c" * (langid.AT_ONCE // 3)
    total = sum(n for _, n in langid.bucket_counts([text]))
    low = text.lower()
    assert total.sum() == 3 * len(low) - 3
    assert (total == np.bincount(langid._buckets(np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64), len(low)), minlength=langid.BUCKETS)).all()


def test_language_all_are_learned(spark, monkeypatch):
    """300 languages in blocks of 64, one of them in three of 3300 rows; letters decide about texts."""
    monkeypatch.setattr(langid, "BLOCK", 64)
    word = lambda i: "".join(chr(0x4E00 + (i * 31 + k * 7) % 20000) for k in range(4))
    rows = [(i * 100 + j, f"{word(i)} {word(i)}", f"l{i:03d}") for i in range(300) for j in range(3 if i == 7 else 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = langid.train(docs, F.lit(True), max_rows=1500)
    assert len(models) == 5 and sum(len(m.languages) for m in models) == 300
    got = langid.predict(docs, models).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.995 * len(got) and all(0 < r["score"] <= 1 for r in got)
    signs = spark.createDataFrame([("½ ² ① ৴ 12",), ("३",), ("é",)], "text string")
    assert [r["lang_pred"] != "und" for r in langid.predict(signs, models).collect()] == [False, False, True]
    assert langid.level([5, 100, 1], 20) == 14 and langid.level([3, 3], 100) == 3 and langid.level([9, 9], 1) == 1


def test_language_against_brute_force(spark, documents):
    """Counts, posteriors and scores by plain dictionaries, in one block and in two."""
    import math

    def grams(text):
        low = text.lower()
        codes = [ord(c) for c in low]
        out = Counter()
        for k in range(langid.ORDER):
            for i in range(len(codes) - k):
                value = 0
                for c in codes[i : i + k + 1]:
                    value = (value * 0x100000001B3 + c + 1) % 2**64
                value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                value = (value ^ value >> 27) * 0x94D049BB133111EB % 2**64
                out[(value ^ value >> 31) % langid.BUCKETS] += 1
        return out

    docs = documents.withColumn("text", F.substring("text", 1, 400)).filter("doc_id < 80")
    rows = docs.collect()
    known = [r for r in rows if r["lang"] and r["text"] is not None and r["doc_id"] % 2]
    counts, number = defaultdict(Counter), Counter()
    for r in known:
        counts[r["lang"]] += grams(r["text"])
        number[r["lang"]] += 1
    expected = {}
    for r in rows:
        if not any(map(str.isalpha, r["text"] or "")):
            expected[r["doc_id"]] = ("und", 0.0)
            continue
        own, logs = grams(r["text"]), {}
        for lang, c in sorted(counts.items()):
            total = sum(c.values()) + 0.5 * langid.BUCKETS
            logs[lang] = math.log(number[lang] / len(known)) + sum(n * math.log((c[g] + 0.5) / total) for g, n in own.items())
        best = max(logs, key=logs.get)
        expected[r["doc_id"]] = (best, 1 / sum(math.exp((x - logs[best]) / math.sqrt(sum(own.values()))) for x in logs.values()))
    old = langid.BLOCK
    try:
        for langid.BLOCK in (256, 2):
            models = langid.train(docs, F.col("doc_id") % 2 == 1)
            for r in langid.predict(docs, models).collect():
                lang, score = expected[r["doc_id"]]
                assert r["lang_pred"] == lang and math.isclose(r["score"], score, rel_tol=1e-3, abs_tol=1e-6)
    finally:
        langid.BLOCK = old


def test_language_odd_rows(spark, odd):
    model = langid.train(odd.withColumn("lang", F.col("lang")), F.lit(True))
    got = langid.predict(odd, model)
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[2]["lang_pred"] == "und" and rows[4]["lang_pred"] == "und" and rows[1]["score"] == 0 and got.count() == odd.count()
    none = langid.train(odd, F.lit(False))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.predict(odd.limit(0), model).count() == 0


# Quality


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    odd_ids = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 1
    model = cotrain.fit(docs, labels.filter(odd_ids))
    rows = cotrain.score(docs, model).join(labels.filter(~odd_ids), "doc_id").collect()
    good = [r["quality_score"] for r in rows if r["quality"] == 1]
    bad = [r["quality_score"] for r in rows if r["quality"] == 0]
    assert sum(s >= 0.5 for s in good) >= 0.98 * len(good)
    assert sum(s < 0.5 for s in bad) >= 0.6 * len(bad)
    assert sum(a > b for a in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_quality_views_teach_each_other():
    import numpy as np

    rng = np.random.default_rng(0)
    n = 1200
    truth = rng.integers(0, 2, n)
    text = rng.normal(size=(n, 4)) + 3 * truth[:, None]
    meta = rng.normal(size=(n, 3)) + 1.5 * truth[:, None]
    y = np.where(np.arange(n) < 60, truth, -1)
    held = np.arange(n) % 4 == 0
    alone = cotrain.co_train(text, meta, y, held, rounds=0)
    taught = cotrain.co_train(text, meta, y, held)
    right = lambda m: ((m.score(text, meta) >= 0.5) == truth)[60:].mean()
    view = lambda m: ((m.views[1].log_odds(meta) >= 0) == truth)[60:].mean()
    assert right(taught) >= 0.97 and view(taught) >= view(alone) - 0.01


def test_quality_against_plain_co_training(spark, documents):
    """Where no bound binds, the result is that of co-training on all rows at once, in memory."""
    import numpy as np

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    rows = documents.collect()
    half = lambda x: np.array(x).astype(np.float16).astype(np.float32)
    text = half([cotrain.text_features(r["text"] or "") for r in rows])
    meta = half([cotrain.meta_features((r["source"], r["lang"], r["n_chars"])) for r in rows])
    y = np.array([known.get(r["doc_id"], -1) for r in rows])
    import xxhash

    held = np.array([xxhash.xxh3_64_intdigest(str(r["doc_id"])) % 4 == 0 for r in rows])
    plain = cotrain.co_train(text, meta, y, held)
    expected = dict(zip((r["doc_id"] for r in rows), plain.score(text, meta), strict=True))
    model = cotrain.fit(documents, labels)
    for r in cotrain.score(documents, model).collect():
        assert abs(r["quality_score"] - expected[r["doc_id"]]) < 0.02


def test_quality_rare_kinds_are_heard(spark):
    """Of 3000 rows one source has 12; with 100 pseudo-labels for each view, it teaches nearly as much as the others."""
    rows = [(i, ("good words " if i % 2 else "BAD 123 ") * (3 + i % 5), "rare" if i % 250 == 1 or i % 250 == 2 else f"s{i % 2}", None, i % 7) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    seen, plain = [], cotrain.co_train
    try:
        cotrain.co_train = lambda *a, pool: plain(*a, pool=lambda v: seen.append(pool(v)) or seen[-1])
        cotrain.fit(docs, labels, max_pool=100)
    finally:
        cotrain.co_train = plain
    assert len(seen) == 3 and all(60 <= len(y) <= 140 for got in seen for _, y in got)


def test_quality_odd_rows(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text"))
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 0), (None, 1), (5, None), (7, 1)], "doc_id long, quality int")
    model = cotrain.fit(docs, labels)
    got = cotrain.score(docs.withColumn("quality_score", F.lit("old")), model)
    assert got.count() == odd.count() and got.filter("quality_score between 0 and 1").count() == odd.count()
    empty = cotrain.fit(docs.limit(0), labels)
    assert cotrain.score(docs, empty).count() == odd.count()
    assert cotrain.score(docs.limit(0), model).count() == 0


# Near-dedup


def brute_near(texts, percent):
    sets = {d: shingles(t, r"[^\x20\x09-\x0D]+") for d, t in texts.items()}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    pairs = {(a, b) for h in holders.values() for a in h for b in h if a < b}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("percent", [85, 60])
def test_near_groups_against_brute_force(spark, documents, percent):
    expected = brute_near(texts_of(documents), percent)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(documents, percent=percent).collect()}
    assert {d: v[0] for d, v in got.items()} == {d: v[0] for d, v in expected.items()}
    if percent == 85:
        assert got == expected


def test_near_groups_of_a_large_family(spark):
    """Mutated copies of one text, many of which link only with each other."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = {}
    for i in range(400):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = f"m{rng.randrange(40)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(df, percent=85).collect()}
    assert got == brute_near(texts, 85)


def test_near_groups_of_a_bucket_of_pairs_below_the_limit(spark):
    """Copies with so many words changed that most pairs share bands but few link, of three sizes; blocks of 32."""
    import random

    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts = {}
    for i in range(240):
        words = base[: 400 if i % 2 else 360] if i % 10 else base[:300]
        words = list(words)
        for _ in range(rng.choice([2, 4, 5, 5, 6])):
            words[rng.randrange(len(words))] = f"m{rng.randrange(10_000)}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    old = neardup.BLOCK
    neardup.BLOCK = 32
    try:
        got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_groups(df, percent=93).collect()}
    finally:
        neardup.BLOCK = old
    assert got == brute_near(texts, 93)


def test_common_sizes_and_agreement():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 6000, n).astype(np.uint64)) for n in (1, 30, 4000, 500, 4500)]
    assert (neardup._common(rows[:2], rows[2:]) == [[len(np.intersect1d(a, b)) for b in rows[2:]] for a in rows[:2]]).all()
    assert neardup.agreeing(100) == neardup.BANDS * neardup.ROWS and 125 < neardup.agreeing(85) < 140


def test_star_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["id"]: r["root"] for r in neardup.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 103: 100}


def test_near_odd_rows(spark, odd):
    rows = neardup.near_groups(odd, percent=85).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r["id"]].add((r["component_id"], r["kept"]))
    assert by[6] == {(5, False)} and by[8] == {(7, False)} and by[1] == {(1, True)} and (3, False) in by[None]
    kept = neardup.near_dedup(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7]
    assert neardup.near_dedup(odd.limit(0)).count() == 0


def test_near_rows_of_null_and_shared_ids(spark):
    def text(name, n=40):
        return " ".join(f"{name}{i}" for i in range(n))

    rows = [
        (5, text("a")), (None, text("a") + " more"), (7, text("b")), (None, text("b") + " more"),  # two pairs, by null ids
        *((None, text(f"alone{i}")) for i in range(6)), (None, text("x")), (None, text("x")), (None, text("x") + " more"), (None, None), (None, ""),
        (1, text("p")), (9, text("p") + " more"), (9, text("q")), (8, text("q") + " more"),  # 9 is near 1 and near 8, with two texts
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter(tuple(r) for r in neardup.near_groups(docs, percent=85).collect())
    assert sum(got.values()) == len(rows)
    of = {(i, c): k for i, _, c, k in got}
    assert of[5, 5] and of[7, 7] and of[1, 1] and of[8, 8] and not of[9, 1] and not of[9, 8] and not of[None, 5] and not of[None, 7]
    assert sum(n for (i, _, c, k), n in got.items() if i is None and c is None and k) == 9
    kept = Counter((r["doc_id"], r["text"]) for r in neardup.near_dedup(docs).collect())
    least = Counter([(5, text("a")), (7, text("b")), (None, None), (None, ""), (1, text("p")), (8, text("q") + " more"), (None, text("x"))])
    assert kept == least + Counter((None, text(f"alone{i}")) for i in range(6))


# Pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    tables = [docs]
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, tables[-1], SMALL)
        assert out.dtypes == docs.dtypes
        tables.append(spark.createDataFrame(out.collect(), docs.schema))
    ids = [{r["doc_id"] for r in t.collect()} for t in tables]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").filter("quality = 1").collect()} & ids[0]
    assert len(good & ids[1]) >= 0.97 * len(good)
    texts = texts_of(docs)
    last = {}
    for d in sorted(ids[1]):
        last[texts[d]] = d
    assert ids[2] == set(last.values())
    near = brute_near({d: texts[d] for d in ids[2]}, 80)
    assert ids[3] == {d for d, (_, root) in near.items() if d == root}
    hit = {r["doc_id"] for r in decontam.find_contained(tables[3], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert ids[4] == ids[3] - hit
    final = {r["doc_id"]: r["n_tokens"] for r in cp.run(spark, SMALL).collect()}
    assert set(final) == ids[4]


def test_pipeline_stages_odd_rows(spark, odd):
    import corpus_pipeline as cp

    clash = ("quality_score", "kept", "keep_id", "group_size", "component_id", "n_shingles", "n_tokens", "_row", "_h", "_id")
    docs = odd.withColumn("n_chars", F.length("text")).select("*", *[F.lit(c).alias(c) for c in clash])
    for name, stage in cp.STAGES:
        out = stage(spark, docs, SMALL)
        rows = out.collect()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        if name != "tokens":
            assert out.dtypes == docs.dtypes
            assert not Counter(map(repr, rows)) - Counter(map(repr, docs.collect()))
        else:
            assert len(rows) == docs.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SQL_TABLES}/{table}.parquet'")
    df = queries.queries()[name](spark, SQL_TABLES)
    expected = duck.sql(queries.oracle_sql()[name])
    assert sorted(expected.columns) == sorted(df.columns)
    wanted = Counter(expected.select(*(duckdb.ColumnExpression(c) for c in df.columns)).fetchall())
    assert wanted and Counter(tuple(r) for r in df.collect()) == wanted
