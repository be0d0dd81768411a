from __future__ import annotations

import hashlib
import io
import json
import re
import wave
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, html_text, language, licenses, media, mixing, packing, simhash, suffixes, warc
from tessera.llm.catalog import ORACLE_SQL, QUERIES
from tests.compare import normal_rows
from tests.llm.conftest import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert normal_rows(got.columns, map(tuple, got.collect())) == normal_rows(names, want.fetchall())


@pytest.mark.parametrize(
    "run",
    [
        lambda d: media.wav_features(media.store_wav(d)),
        lambda d: language.identify(d, language.fit(d)),
        licenses.scan,
        suffixes.remove_repeats,
        packing.pack,
        simhash.near_duplicates,
        simhash.deduplicate,
        mixing.mix,
        mixing.repeat_documents,
        exact_dedup.duplicate_report,
        exact_dedup.deduplicate,
    ],
)
def test_empty_table(no_docs, run):
    assert run(no_docs).collect() == []


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1 media


def features_by_hand(text: str | None) -> tuple:
    """Payload, clip and fingerprints with plain loops."""
    raw = (text or "").encode()
    payload = raw + b"\0" * (-(-max(len(raw), 1) // 64) * 64 - len(raw))
    x = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    frames = [x[k : k + media.FRAME] for k in range(0, len(x) - media.FRAME + 1, media.HOP)]
    size = np.abs(np.fft.rfft(np.array(frames) * media.WINDOW, axis=1))[:, 1:]
    found = []
    for t in range(len(size)):
        for f in range(size.shape[1]):
            near = size[max(0, t - media.NEAR_T) : t + media.NEAR_T + 1, max(0, f - media.NEAR_F) : f + media.NEAR_F + 1]
            if size[t, f] == near.max() and size[t, f] > media.OVER_MEAN * size[t].mean() and size[t, f] > 1e-3:
                found.append((t, f + 1))
    pairs = []
    for i, (t, f) in enumerate(found):
        for t2, f2 in [x for x in found[i + 1 :] if x[0] > t][: media.FAN]:  # of later frames
            if t2 - t <= media.REACH:
                pairs.append((t << 24) | (f << 16) | (f2 << 8) | (t2 - t))
    return payload, sorted(pairs)


def test_media_round_trip_and_features(odd_docs):
    stored = by_id(media.store_wav(odd_docs))
    got = by_id(media.wav_features(media.store_wav(odd_docs)))
    assert len(got) == 11
    for doc_id, text in [(r["doc_id"], r["text"]) for r in odd_docs.collect()]:
        if text and len(text) > 10_000:
            continue
        payload, pairs = features_by_hand(text)
        row, clip = got[doc_id], bytes(stored[doc_id]["media"])
        with wave.open(io.BytesIO(clip)) as w:
            assert (w.getsampwidth(), w.getnchannels(), w.readframes(w.getnframes())) == (1, 1, payload)
        assert row["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert row["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (row["n_bytes"], row["payload_bytes"]) == (len((text or "").encode()), len(payload))
        assert row["media_sha256"] == hashlib.sha256(clip).hexdigest()
        assert row["fingerprints"] == pairs
    assert got[1]["fingerprints"] == got[2]["fingerprints"]


def test_media_blocks_join(monkeypatch):
    samples = np.random.default_rng(3).integers(0, 255, 64 * 200).astype(np.uint8)
    whole = media.peaks(samples)
    monkeypatch.setattr(media, "BLOCK", 7)
    parts = media.peaks(samples)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


# 2 HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "<p>no</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><div id="cookie-notice">We use cookies.</div>
<div class="ad banner">Buy now, this is a long and tempting advert text.</div>
<article><h1>Caf&eacute; &amp; more</h1><p><b>First   block,
with<br>a break<p>Second &lt;block&gt; with <a href=/c>a link</a> in it.</p><ul><li>item one<li>item two</ul></article>
<aside>Other stories</aside><section class="comments"><p>I like this article a lot, well done to you all.</p></section>
<form><p>Subscribe to us</p></form><footer>&copy; us</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_text.main_text(PAGE) == "Café & more\n\nFirst block, with a break\n\nSecond <block> with a link in it.\n\nitem one\n\nitem two"


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<script>x</script>", ""), ("<div>" * 5000 + "deep", "deep"), ("<p>cut &am", "cut &am")])
def test_main_text_odd(html, text):
    assert html_text.main_text(html) == text


def test_main_text_of_all_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()
    assert len(rows) == pages.count()
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", source[r["page_id"]], re.S)[1]
        import html as h

        blocks = (" ".join(h.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article.replace("<br>", "\n")))
        assert r["text"] == "\n\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


WRAPS = ['<div class="content no-sidebar">', '<div class="has-cookie-notice">', '<div class="page with-sidebar">', '<div class="post share">', '<div class="entry-content related-enabled">', '<div class="layout no-sidebar"><article>', "<form>"]


@pytest.mark.parametrize("wrap", WRAPS)
def test_a_wrapper_never_cuts_the_article(wrap):
    html = f"<body><nav><a href=/>Home</a></nav>{wrap}<p>First paragraph of the article, with some words.</p><p>Second one, with a few more of them.</p></body>"
    assert html_text.main_text(html) == "First paragraph of the article, with some words.\n\nSecond one, with a few more of them."


LINKS = "<div>" + "".join(f"<div><a href=/{k}>Other story {k}</a></div>" for k in range(12)) + "</div>"
BARE = "<body>" + LINKS + "<div>" + "".join(f"<p>Paragraph {k} of a text that goes on for a while, as articles do, and has no links at all in it.</p>" for k in range(6)) + "</div>" + LINKS + "</body>"


def test_density_alone_finds_the_article(monkeypatch):
    """No tag, role or name tells the parts of this page apart."""
    want = "\n\n".join(f"Paragraph {k} of a text that goes on for a while, as articles do, and has no links at all in it." for k in range(6))
    assert html_text.main_text(BARE) == want
    monkeypatch.setattr(html_text, "content", lambda nodes: [nodes[0]])
    assert html_text.main_text(BARE) != want


def test_main_text_without_names_and_article_tags():
    import duckdb

    same = total = 0
    for (html,) in duckdb.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        bare = re.sub(r"<(/?)(article|main)\b", r"<\1div", re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", html))
        total, same = total + 1, same + (html_text.main_text(bare) == html_text.main_text(html))
    assert same >= 0.95 * total


@pytest.mark.parametrize("html", ["<div>" * 50_000 + "deep", "<p><button>" + "<div>" * 50_000 + "deep", "<b>" + "<span>" * 50_000 + "deep</b>", "<span><div>" * 25_000 + "deep"])
def test_deep_pages_take_linear_time(html):
    import time

    began = time.perf_counter()
    assert html_text.main_text(html) in ("deep", "")
    assert time.perf_counter() - began < 5


def test_pages_odd(spark):
    schema = "page_id long, url string, html string"
    rows = [(None, "u", "<p>a</p>"), (1, None, None), (2, "v", ""), (2, "v", "")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted([(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got], key=repr) == sorted([(None, "u", "a", 1), (1, None, "", 0), (2, "v", "", 0), (2, "v", "", 0)], key=repr)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []


# 3 language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", language.held_out())
    rows = found.filter("held").collect()
    assert len(rows) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd(odd_docs):
    rows = language.identify(odd_docs, language.fit(odd_docs)).collect()
    assert len(rows) == 12
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {3, 4, 5, 6} <= und
    kept = language.keep_identified(odd_docs, language.fit(odd_docs))
    assert kept.columns == odd_docs.columns and kept.count() == 12 - 4


def test_ngram_counts_of_parts():
    text = "abc déf  GHI " * 50 + "   7 7   xyz!!"
    on, counts = language.ngram_counts(text)
    assert counts.sum() and language.ngram_counts("12 !")[0].size == 0
    for part in (1, 2, 3, 4, 5, 7, 64, 1000):
        got = language.ngram_counts(text, part)
        assert (got[0].tolist(), got[1].tolist()) == (on.tolist(), counts.tolist())
    assert [x.tolist() for x in language.ngram_counts(text.upper())] == [on.tolist(), counts.tolist()]


def buckets_by_hand(text: str) -> dict:
    letters = re.sub(r" +", " ", " " + "".join(c.lower() if c.isalpha() else " " for c in text))
    found, m = {}, 1 << 32
    x = [ord(c) for c in letters]
    two = [(p * 0x9E3779B1 + q) % m for p, q in zip(x, x[1:])]
    hashes = [h * 0x27D4EB2F % m for h in two] + [((h * 0x85EBCA6B) ^ (c * 0xC2B2AE35)) % m * 0x165667B1 % m for h, c in zip(two, x[2:])]
    for h in hashes:
        k = (h ^ (h >> 15)) >> 17
        found[k] = found.get(k, 0) + 1
    return found


def test_language_equals_plain_loops():
    """N-grams, TF-IDF, FTRL and predictions with dicts and loops."""
    rng = np.random.default_rng(1)
    texts = [(" ".join("".join(rng.choice(list(letters), 4)) for _ in range(6)), k) for _ in range(12) for k, letters in enumerate(("abcd", "cdef", "eföx"))]
    counted = [buckets_by_hand(t) for t, _ in texts]
    for (t, _), want in zip(texts, counted):
        assert dict(zip(*(x.tolist() for x in language.ngram_counts(t)))) == want
    df = {}
    for c in counted:
        for k in c:
            df[k] = df.get(k, 0) + 1
    idf = np.zeros(language.BUCKETS)
    for k, n in df.items():
        idf[k] = np.log((1 + len(texts)) / (1 + n)) + 1

    def weighed(c: dict) -> dict:
        x = {k: np.log(1 + n) * idf[k] for k, n in c.items()}
        length = sum(v * v for v in x.values()) ** 0.5
        return {k: v / length for k, v in x.items()}

    l1, l2, alpha, beta, classes = 0.05, 0.05, 1.0, 1.0, 3
    z, n = {}, {}

    def weight(k, j):
        zi, ni = z.get((k, j), 0.0), n.get((k, j), 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - np.sign(zi) * l1) / ((beta + ni**0.5) / alpha + l2)

    def chances(x, scale=1.0):
        s = [sum(v * weight(k, j) for k, v in x.items()) / scale for j in range(classes)]
        e = [np.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    order = np.random.default_rng(7)
    for _ in range(2):
        for i in order.permutation(len(texts)):
            x = weighed(counted[i])
            p = chances(x)
            w = {(k, j): weight(k, j) for k in x for j in range(classes)}
            for (k, j), old in w.items():
                g = x[k] * (p[j] - (j == texts[i][1]))
                before = n.get((k, j), 0.0)
                z[k, j] = z.get((k, j), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / alpha * old
                n[k, j] = before + g * g
    rows = []
    for t, _ in texts:
        on, counts = language.ngram_counts(t)
        rows.append((on, language.tfidf(on, counts, idf)))
    got = language.follow_the_regularised_leader(rows, np.array([k for _, k in texts]), classes, l1, l2, alpha, beta, 2, 7)
    assert all(abs(got[k, j] - weight(k, j)) < 1e-9 for k in df for j in range(classes))
    assert (got == 0).mean() > 0.9
    model = language.LanguageModel(["a", "b", "c"], idf, got, 0.7)
    for (t, _), c in zip(texts, counted):
        p = chances(weighed(c), 0.7)
        assert model.predict(t)[0] == "abc"[int(np.argmax(p))] and abs(model.predict(t)[1] - max(p)) < 1e-9


def test_every_language_is_learned_from_few_rows_each(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list(chr(0x4E00 + 9 * k + j) for j in range(9)), 3)) for _ in range(8)), f"l{k}") for i, k in enumerate(rng.integers(0, 300, 6000).tolist())]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=10)
    assert len(model.labels) == 300
    hits = [model.predict(t)[0] == lang for _, t, lang in rows[:500]]
    assert np.mean(hits) > 0.9


def test_temperature_finds_the_scale():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(1, keepdims=True)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert 2.5 < language.temperature(logits * 3, labels) < 3.6


# 4 licences


def test_licenses_odd(odd_docs, spark):
    assert [(r["doc_id"], r["license_id"], r["containment"]) for r in licenses.scan(odd_docs).collect()] == [(7, "mit", 1.0)]
    filler = " ".join(f"word{i}" for i in range(500))
    grant = licenses.TEMPLATES["mit-grant"]
    rows = [(k, f"{' '.join(filler.split()[:k])} {grant.upper()} {filler}") for k in range(0, 200, 7)] + [(999, " ".join(grant.split()[:12]))]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got} == {k for k in range(0, 200, 7)}
    with pytest.raises(ValueError):
        licenses.template_shingles({"x": "too short"})


def test_no_template_is_missed_more_often_than_stated():
    sizes = [len(x) for _, _, x in licenses.template_shingles(licenses.TEMPLATES)]
    assert min(sizes) == 1
    n = licenses.bands_for(sizes)
    for m in sizes:
        shared = -(-4 * m // 5)
        s = shared / (licenses.WINDOW - licenses.SHINGLE + 1 + m - shared)
        assert (1 - s) ** n <= 0.001


def test_templates_of_several_parts(spark):
    """A template of 100 words is found where enough of its parts are, at any place, also among all others."""
    rng = np.random.default_rng(3)
    body = [f"clause{k}" for k in range(100)]
    templates = {**licenses.TEMPLATES, "long": " ".join(body)}
    parts = [set(x) for name, _, x in licenses.template_shingles(templates) if name == "long"]
    assert len(parts) > 3 and set.union(*parts) == {" ".join(body[k : k + 5]) for k in range(96)}
    noise = " . ".join(licenses.TEMPLATES.values())
    rows, want = [], set()
    for k in range(40):
        kept = [w if rng.random() > (k % 4) * 0.004 else "changed" for w in body[: 100 - (k % 5) * 3]]
        rows.append((k, " ".join([f"w{j}" for j in range(k)] + kept + noise.split())))
        windows = [set(" ".join(w[a + j : a + j + 5]) for j in range(60)) for w in [re.findall(r"[^\W_]+", rows[-1][1].lower())] for a in range(0, len(w), 32)]
        found = [p for p in parts if any(len(p & w) >= 0.8 * len(p) for w in windows)]
        if len(found) >= 0.8 * len(parts):
            want.add(k)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {r["doc_id"] for r in got if r["license_id"] == "long"} == want and 5 < len(want) < 40
    assert {r["license_id"] for r in got} == templates.keys()


# 5 suffixes


def test_anchors_do_not_depend_on_parts(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 99, 100, 1000, 9000)]
    whole = suffixes.text_anchors(texts)
    monkeypatch.setattr(suffixes, "CHUNK", 1024)
    parts = suffixes.text_anchors(texts)
    assert sorted(map(tuple, whole[:, [0, 3, 4, 5, 6]])) == sorted(map(tuple, parts[:, [0, 3, 4, 5, 6]]))
    starts = [set() for _ in texts]
    for row in whole:
        starts[row[3]] |= set(range(row[5], row[6] + 1))
    assert [len(s) for s in starts] == [0, 0, 1, 901, 8901]


def test_suffix_order_and_repeats_with_broken_hashes(monkeypatch):
    rng = np.random.default_rng(6)
    stem = [bytes(rng.integers(97, 99, 100, dtype=np.uint8)) for _ in range(4)]
    right = [stem[rng.integers(4)][: rng.integers(40, 101)] + bytes(rng.integers(97, 99, 60, dtype=np.uint8)) for _ in range(80)]
    right = [r[:100] for r in right]
    left = [bytes(rng.integers(97, 99, 68, dtype=np.uint8))[: rng.integers(0, 69)] for _ in range(80)]
    group = np.sort(rng.integers(0, 5, 80))
    size = np.array([len(r) for r in right])
    raw = suffixes.padded(right, 100)
    order = suffixes.merge_sort(suffixes.row_prefixes(raw, 0), size, raw, group)
    assert [(group[i], right[i]) for i in order] == sorted(zip(group.tolist(), right))
    least, most = np.zeros(80, np.int64), np.array([min(68, len(x)) for x in left])
    rank = rng.permutation(80)
    good = suffixes.repeats(group, right, left, least, most, rank)
    for i in range(80):
        for o in range(69):
            valid = lambda k: least[k] <= o <= most[k]  # noqa: B023, E731
            want = valid(i) and any(valid(j) and group[j] == group[i] and rank[j] < rank[i] and len(right[j]) >= 100 - o and right[j][: 100 - o] == right[i][: 100 - o] and left[j][:o] == left[i][:o] for j in range(80)) and len(right[i]) >= 100 - o
            if len(right[i]) >= 100 - o:
                assert good[i, o] == want
    monkeypatch.setattr(suffixes, "_BYTES", np.ones((2, 257), np.uint64))  # every byte hashes alike
    assert (suffixes.repeats(group, right, left, least, most, rank)[size == 100] == good[size == 100]).all()


def test_remove_repeats_odd(odd_docs):
    rows = odd_docs.collect()
    got = suffixes.remove_repeats(odd_docs).collect()
    assert len(got) == len(rows)
    one = {r["doc_id"]: r for r in got}
    assert one[1]["n_removed"] == 0 and one[3]["n_bytes"] == 0 and one[None]["n_removed"] == 0
    assert bytes(one[6]["kept"]) == b"1234 !!"


def test_remove_repeats_twice_the_same_id(spark):
    a, b = "x1 " * 60, "y2 " * 60
    rows = [(1, a + "left"), (1, b + "right"), (1, a + "left"), (2, a + b)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 4 and {r["n_removed"] for r in got if r["doc_id"] == 2} == {360}


# 6 packing


def check_packing(rows, capacity=1024):
    used = {}
    for r in rows:
        assert 0 < r["length"] <= capacity
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(used)


def test_pack_is_valid_and_dense(spark, documents):
    rows = packing.pack(documents).collect()
    n = check_packing(rows)
    total = sum(r["length"] for r in rows)
    assert n <= 1.02 * -(-total // 1024) + 1
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    for doc_id, pieces in docs.items():
        ids = [*tok.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        start = 0
        for k, p in enumerate(sorted(pieces, key=lambda p: p["piece"])):
            assert (p["piece"], p["start"]) == (k, start)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[start : start + p["length"]], "<u4").tobytes())
            assert p["length"] == 1024 or k == 0
            start += p["length"]
        assert start == len(ids)
    assert docs.keys() == texts.keys()


def test_pack_odd(odd_docs):
    rows = packing.pack(odd_docs).collect()
    check_packing(rows)
    assert sum(r["piece"] == 0 for r in rows) == 12
    assert [r["length"] for r in rows if r["doc_id"] == 3] == [1]


def test_encoder_equals_tokenizers():
    encode = packing.Encoder(packing.vocabulary_path())
    for text in ["", " ", "a  b\n\n c ", "<|endoftext|>x", "it's we'll DON'T", "  \n", "é  x", "½ ١٢ x", "a" * 5000, "\U0001f600 ok", "x y z", " 　 "]:
        assert encode(text).tolist() == encode.slow(text), text


def test_sum_of_squares_rule():
    """Placement equals a plain loop that tries every gap and sums the squares of all counts."""
    rng = np.random.default_rng(12)
    for capacity, n in ((10, 60), (64, 300), (1024, 400)):
        lengths = rng.integers(1, capacity + 1, n)
        where, offset, made = packing.sum_of_squares(lengths, capacity)
        gaps, got = {}, {}  # sequence -> gap by hand
        for i in np.argsort(-lengths, kind="stable").tolist():
            s = int(lengths[i])
            counts = np.bincount([g for g in gaps.values() if g < capacity], minlength=capacity + 1)
            counts[0] = 0
            best = None
            for gap in sorted({g for g in gaps.values() if g >= s}):
                after = counts.copy()
                after[gap] -= 1
                if gap > s:
                    after[gap - s] += 1
                cost = int((after.astype(np.int64) ** 2).sum())
                if best is None or cost < best[0]:
                    best = (cost, gap)
            gap = best[1] if best else capacity
            assert int(offset[i]) == capacity - gap
            assert best is None or gaps[int(where[i])] == gap
            assert best is not None or int(where[i]) not in gaps
            gaps[int(where[i])] = gap - s
            got[int(where[i])] = got.get(int(where[i]), 0) + s
        assert made == len(gaps) and max(got.values()) <= capacity


# 7 WARC


def record(i, url, s, kind="revisit", etag=None, modified=None, **headers):
    return (i, url, s, kind, etag, modified, {k.replace("_", "-"): v for k, v in headers.items()}, f"sha{i}" if kind == "response" else None, i if kind == "response" else None)


def test_revisits(spark):
    rows = [
        record(1, "http://A.com/x/", 10, "response", '"e1"', content_type="text/html", date="10"),
        record(2, "https://www.a.com/x#f", 20, "response", '"e2"', "m2", content_type="text/html", vary="old"),
        record(3, "http://a.com:80/x", 20, etag='"e1"'),  # the response of the same time is not earlier
        record(4, "a.com/x?utm_source=z", 21, etag='W/"e2"', date="21", vary="new", content_type="nope"),
        record(5, "http://a.com/x", 30, etag='"zz"', modified="m2"),
        record(6, "http://a.com/x", 31, modified="m2"),
        record(7, "http://a.com/x", 32),
        record(8, "http://b.com/", 33, etag='"e"'),
        record(9, None, 34, etag='"e"'),
        record(10, "http://a.com/x", None, etag='"e1"'),
        record(4, "a.com/x?utm_source=z", 21, etag='W/"e2"', date="21", vary="new", content_type="nope"),
    ]
    schema = "record_id long, url string, s long, kind string, etag string, last_modified string, headers map<string,string>, payload_sha256 string, payload_bytes long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s")).withColumn("slice", F.lit("clash"))
    got = [(r["record_id"], r["status"], r["via"], r["response_id"], r["headers"]) for r in warc.resolve_revisits(df, slices=4).orderBy("record_id").collect()]
    assert [g[:4] for g in got] == [
        (3, "resolved", "etag", 1), (4, "resolved", "etag", 2), (4, "resolved", "etag", 2), (5, "mismatch", "etag", None), (6, "resolved", "last-modified", 2),
        (7, "unverified", None, None), (8, "orphan", None, None), (9, "orphan", None, None), (10, "orphan", None, None),
    ]
    assert got[1][4] == {"content-type": "text/html", "vary": "new", "date": "21"}


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://x.com/AT&T", "x.com/AT&T"), ("http://x.com/AT?T", "x.com/AT?T"), ("x.com/a&ref=1", "x.com/a&ref=1"), ("HTTPS://WWW.X.com:443/a/?utm_source=z#f", "x.com/a"),
        ("x.com/?utm_a=1&b=2&gclid=3", "x.com/?b=2"), ("x.com/?b=2&ref=q&c=&d", "x.com/?b=2&c=&d"), ("x.com", "x.com"), ("x.com/a?b=/", "x.com/a?b=/"), ("x.com/a?", "x.com/a"), ("x.com?q", "x.com?q"), (None, None),
    ],
)
def test_canonical_url(spark, url, want):
    assert spark.createDataFrame([(url,)], "url string").select(warc.canonical_url(F.col("url"))).first()[0] == want


def test_revisits_at_equal_times_split(spark):
    """One URL, all captures at two times: slices cut through both."""
    rows = [record(k, "a.com", 10, "response", f'"{k}"') for k in range(40)] + [record(100 + k, "a.com", 10 + k % 2, etag='"39"') for k in range(60)]
    schema = "record_id long, url string, s long, kind string, etag string, last_modified string, headers map<string,string>, payload_sha256 string, payload_bytes long"
    df = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("s"))
    for slices in (1, 7, 30):
        got = {(r["record_id"], r["status"], r["response_id"]) for r in warc.resolve_revisits(df, slices=slices).collect()}
        assert got == {(100 + k, "resolved", 39) if k % 2 else (100 + k, "orphan", None) for k in range(60)}


def test_revisits_of_nothing(spark):
    assert warc.op7_warc_revisits.__name__ and warc.resolve_revisits(warc.capture_log(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


# 8 SimHash


def fingerprint_by_hand(text: str | None) -> int:
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(fps: dict) -> dict:
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(1000)
    rows = docs.collect()
    fps = {r["doc_id"]: fingerprint_by_hand(r["text"]) for r in rows[:1000] if len(r["text"]) < 3000}
    small = docs.filter(F.length("text") < 3000)
    got = by_id(simhash.near_duplicates(small))
    assert {i: int(r["fingerprint"], 16) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == components_by_hand(fps)


def test_simhash_odd(odd_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: r for r in rows}
    assert got[3]["fingerprint"] == "0" * 16 and {got[k]["component_id"] for k in (3, 4, 5)} == {3}
    assert {got[k]["component_id"] for k in (1, 2, 10)} == {1}
    kept = simhash.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns and {2, 4, 5, 10}.isdisjoint(r["doc_id"] for r in kept.collect())


def planted(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = []
    for _ in range(n):
        x = rng.integers(0, 1 << 63, dtype=np.uint64)
        for _ in range(rng.integers(1, 9)):
            found.append(x)
            x = x ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64)))
    return np.unique(np.array(found, np.uint64))


def test_shards_lose_no_link():
    fps = planted(900, 8)
    nodes = simhash.shard_tree(fps, 16)
    row, shard = simhash.route(fps, nodes, 1)
    assert len(set(shard.tolist())) > 8
    meet = {}
    for r, s in zip(row.tolist(), shard.tolist()):
        meet.setdefault(r, set()).add(s)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    for i, j in zip(*np.nonzero(near)):
        assert meet[i] & meet[j]
    by_block = simhash.shard_links(fps, 2)
    parent = np.arange(len(fps))
    for i, j in zip(*np.nonzero(near)):
        a, b = simhash._find(parent, i), simhash._find(parent, j)
        parent[max(a, b)] = min(a, b)
    assert by_block.tolist() == [simhash._find(parent, i) for i in range(len(fps))]


def test_links_over_many_shards(spark):
    fps = planted(3000, 9)
    classes = spark.createDataFrame([(int(np.int64(f)), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes)).collect()}
    whole = simhash.shard_links(fps, 2)
    assert [roots.get(i, i) for i in range(len(fps))] == whole.tolist()


def test_large_shards_are_split_on(spark):
    fps = planted(2000, 11)
    classes = spark.createDataFrame([(int(np.int64(f)), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    whole = simhash.shard_links(fps, 2)
    for settings in ({"tree": 2, "most_rows": 700}, {"tree": 1, "most_rows": 1500}):
        roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, **settings)).collect()}
        assert [roots.get(i, i) for i in range(len(fps))] == whole.tolist()


def test_shards_that_do_not_split_are_dealt_in_chunks(spark):
    fps = np.array([0, *(1 << np.arange(64, dtype=np.uint64)), *(np.uint64(7) << np.arange(8, 58, dtype=np.uint64))], np.uint64)
    classes = spark.createDataFrame([(int(np.int64(f)), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(classes, most_rows=10)).collect()}
    assert [roots.get(i, i) for i in range(len(fps))] == simhash.shard_links(fps, 2).tolist()


def test_fingerprints_of_parts(monkeypatch):
    texts = [" ".join(f"w{k * 7 % 91}" for k in range(n)) for n in (0, 1, 2, 3, 9, 10, 11, 100, 1000)] + ["A b", ""]
    whole = simhash.fingerprints(texts).tolist()
    assert whole == [fingerprint_by_hand(t) for t in texts]
    monkeypatch.setattr(simhash, "CHUNK", 64)  # parts of eight words
    assert simhash.fingerprints(texts).tolist() == whole


def test_long_chain_of_links(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 499)], "node long, root long")
    roots = {r["node"]: r["root"] for r in simhash.components(chain).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 500: 499}


# 9 mixing


def test_targets_water_fill(spark):
    sizes = {"a": 10.0, "b": 1000.0, "c": 1000.0, "d": 5.0, None: 100.0}
    df = spark.createDataFrame([(k, int(v)) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weight = dict(zip(["a", "b", "c", "d", None], [5, 2, 1, 5, 2]))
    target, capped, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in capped]
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            capped.add(s)
            target[s] = 3 * sizes[s]
            left -= target[s]
    assert got == pytest.approx(target)


def test_mix_comes_near_targets(documents):
    rows = mixing.mix(documents).collect()
    taken, target, largest = {}, {}, {}
    for r in rows:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
        largest[r["source"]] = max(largest.get(r["source"], 0), r["size"])
        assert r["taken"] <= 3 * r["size"] and r["size"] in (0, *[r["taken"] // k for k in (1, 2, 3)]) or r["taken"] == 0
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in taken)


def test_mix_odd(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == 12 and {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    out = mixing.repeat_documents(odd_docs)
    assert out.columns == odd_docs.columns
    taken = sum(r["taken"] for r in rows)
    assert out.select(F.sum(F.regexp_count("text", F.lit(mixing.WORD)))).first()[0] == taken


def test_mix_is_the_same_where_the_plan_is_not_sent(documents, odd_docs, monkeypatch):
    for docs in (documents, odd_docs):
        columns = ("doc_id", "source", "size", "target", "reps", "taken")
        sent = sorted(map(repr, mixing.mix(docs).select(*columns).collect()))
        repeated = sorted(map(repr, mixing.repeat_documents(docs).collect()))
        with monkeypatch.context() as m:
            m.setattr(mixing, "MOST_SENT", 0)
            assert sorted(map(repr, mixing.mix(docs).select(*columns).collect())) == sent
            assert sorted(map(repr, mixing.repeat_documents(docs).collect())) == repeated


def test_targets_of_many_sources(spark):
    sizes = {f"s{k:05}": 1 + (k * 7919) % 1000 for k in range(3000)}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    low, high = 0.0, 1e7
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * sizes[s], level * weight[s]) for s in sizes) < sum(sizes.values()) else (low, level)
    assert got == pytest.approx({s: min(3 * sizes[s], low * weight[s]) for s in sizes})


# 10 exact dedup


def test_exact_odd_and_colliding_digests(odd_docs):
    def want(rows):
        texts = {}
        for r in rows:
            texts.setdefault(r["text"] or "", []).append(r["doc_id"])
        best = {t: max((i for i in ids if i is not None), default=None) for t, ids in texts.items()}
        return sorted([(r["doc_id"], best[r["text"] or ""], len(texts[r["text"] or ""]), r["doc_id"] == best[r["text"] or ""]) for r in rows], key=repr)

    rows = odd_docs.collect()
    for digest in (exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0), lambda c: F.length(c).cast("string").cast("binary")):
        got = exact_dedup.duplicate_report(odd_docs, digest=digest).collect()
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got], key=repr) == want(rows)
        assert all(r["text_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r in got for t in [next(x["text"] for x in rows if x["doc_id"] == r["doc_id"])])
    kept = exact_dedup.deduplicate(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == sorted([None, 4, 5, 6, 7, 8, 9, 10], key=repr)


def test_copies_without_id_all_stay(spark):
    rows = [(None, "x", 1), (None, "x", 2), (None, "y", 3), (5, "y", 4), (5, "y", 5), (6, None, 6), (None, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, salt int")
    report = exact_dedup.duplicate_report(df).collect()
    kept = exact_dedup.deduplicate(df).collect()
    assert sorted((r["doc_id"] is None, r["text"] or "") for r in kept) == [(False, ""), (False, "y"), (True, "x"), (True, "x")]
    assert sum(r["kept"] for r in report) == 5 and {r["group_size"] for r in report} == {2, 3}
    assert sorted(r["salt"] for r in kept if r["doc_id"] is None) == [1, 2]
