"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pulseframe.llm import bpe, exact, media, mixing, quality, repeats, secrets, simhash, tokens, urls
from pulseframe.llm.common import scratch

CLASHES = """spans media ids key size digest row print word mask id doc score features label positive target bucket last least whole extra
    _id _digest _row _doc _key _copies _copy _features _score _source _size _bucket _at _of _word _bit _text _url _hits _verdict _read _scan""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def docs(spark, rows):
    """Documents with further columns that clash with names used inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(CLASHES)) for i, t, s in rows], SCHEMA)


def random_rows(seed, n=60, words=40):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abé ,.\n") for _ in range(rng.randint(1, 7))) for _ in range(30)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, words))) for _ in range(n)]
    for k in range(0, n, 4):  # near copies
        texts[k] = texts[k - 1][:rng.randint(0, 80)] + texts[k]
    rows = [(i, t, rng.choice(["s1", "s2", "s3", None])) for i, t in enumerate(texts)]
    rows += [(n, None, "s1"), (n + 1, "", "s1"), (n + 2, texts[1], "s2"), (n + 2, texts[1], "s2"), (None, texts[1], None), (None, texts[2], "s1"), (3, texts[5], "s1")]
    return rows + [(n + 3, "word " * 3000 + "\U0001f600 end", "s1"), (n + 4, "x" * 20000, "s2"), (n + 5, "x" * 20000, "s3")]


@pytest.fixture(scope="module", params=[1, 2])
def table(spark, request):
    rows = random_rows(request.param)
    return rows, docs(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).cache()


def by_row(rows):
    return sorted(map(repr, rows))


# 1


def test_entropy_is_that_of_each_window():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdef0123") for _ in range(200)) + "d" * 60
    for bits in (2.0, 2.8, 3.1):
        inside = set()
        for a in range(len(text) - 19):
            w = text[a:a + 20]
            h = -sum(w.count(c) / 20 * math.log2(w.count(c) / 20) for c in set(w))
            if h >= bits - 1e-9:
                inside |= set(range(a, a + 20))
        found = {i for s in secrets.suspect_windows(text, 20, bits) for i in range(s, s + 20)}
        assert found == inside


def spans_of(inside):
    """Maximal runs of the positions in the set."""
    return [(a, next(b for b in range(a, max(inside) + 2) if b not in inside)) for a in sorted(inside) if a - 1 not in inside]


def plain_entropy(text):
    """Characters in suspect windows that touch no term of the allow-list, and in those that do."""
    clear, harmless = set(), set()
    low = text.lower()
    allowed = [(k, k + len(a)) for a in secrets.ALLOW for k in range(len(low)) if low.startswith(a, k)]
    for _, chars, w, bits in secrets.CLASSES:
        for a in range(len(text) - w + 1):
            window = text[a:a + w]
            if set(window) <= set(chars) and -sum(window.count(c) / w * math.log2(window.count(c) / w) for c in set(window)) >= bits - 1e-9:
                touched = any(b < a + w and e > a for b, e in allowed)
                (harmless if touched else clear).update(range(a, a + w))
    return clear, harmless


def test_secrets(spark, none):
    key = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"
    rows = [
        (1, f'é ToKeN = "{key}" é', "a"),
        (2, "AKIA" + "A1" * 7 + " AKIA123", "a"),
        (3, "password: short", "a"),
        (4, None, "a"),
        (5, "the value Zq8Lr2Xw9Tn4Vb7Mk3Hs6Yd1Pc5 stands", "a"),
        (6, "the value ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 is listed", "a"),
        (7, "toſen=abcdefabcdef123 tokeN=" + "k" * 5, "a"),
        (8, "secret=token=abcdefghijkl", "a"),
        (9, "see docs.example, not code: Zq8Lr2Xw9Tn4Vb7Mk3Hs6Yd1Pc5QzWxEcRvT", "a"),
        (10, "key docs/example/fghjZq8Lr2Xw9Tn4Vb7Mk3Hs6Yd1P", "a"),
    ]
    scanned = secrets.secret_spans(docs(spark, rows)).collect()
    assert {r._found for r in secrets.secret_spans(docs(spark, rows).withColumn("_found", F.lit("x"))).collect()} == {"x"}
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.secret_spans] for r in scanned}
    held = {r.doc_id: [(s.start, s.end) for s in r.suppressed_spans] for r in scanned}
    assert found[1] == [("assign", 2, 11 + 40), ("hex", 11, 51), ("entropy", 11, 51)] and held[6] == [(10, 46)]
    assert not any(held[i] for i in (1, 2, 3, 4, 5, 7, 8, 9))
    assert found[9] == [("entropy", 28, 64)] and [k for k, *_ in found[10]] == ["entropy"] and held[10]
    for i, t, _ in rows:
        clear, harmless = plain_entropy(t or "")
        assert spans_of(clear) == [(s, e) for k, s, e in found[i] if k == "entropy"] and spans_of(harmless) == held[i]
    assert found[2] == [("access", 0, 18)]
    assert found[3] == found[4] == found[6] == found[7] == []
    assert [k for k, *_ in found[5]] == ["entropy"]
    assert found[8] == [("assign", 0, 25)]
    assert secrets.secret_spans(none).count() == 0


# 2


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(table, none, library):
    rows, df = table
    coded = bpe.bpe_decode(bpe.bpe_encode(df)).select("text", "ids", "decoded").collect()
    for r in coded:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.bpe_decode(bpe.bpe_encode(none)).count() == 0
    again = bpe.bpe_round_trip(df.withColumn("IDS", F.lit(1))).select("text", "ids", "decoded").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, coded))
    assert bpe.bpe_round_trip(none).count() == 0


def test_slices_hold_every_text():
    texts = ["", "ab", "c" * 50, "é" * 20, "", "x", "y" * 9]
    for array in (pa.array(["skipped", *texts], pa.string())[1:], pa.array(texts, pa.large_string())):
        for most in (1, 10, 45, 1000):
            parts = list(bpe.slices(array, most))
            assert sum(parts, []) == texts
            assert all(len(p) == 1 or sum(len(t.encode()) for t in p) <= most for p in parts)
    assert list(bpe.slices(pa.array([], pa.string()))) == []


def test_bpe_on_odd_texts(library):
    own = bpe.load(bpe.VOCABULARY)
    rng = random.Random(5)
    alphabet = "ab  \n\t\x1c\xa0 é1٣'s!﻿՘ ünß中​"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "x <|endoftext|><|endoftext|>  y", "a" * 5000, "\n\n a\n b\n", "don't  stop"]
    other = list(tokens.LibraryEncoder(bpe.VOCABULARY, kept=50).packed_all(texts))
    for t, packed in zip(texts, other, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encoder.packed(t), np.uint32).tolist() == ids, t
        assert np.frombuffer(packed, np.uint32).tolist() == ids, t


def test_merges_leftmost_lowest_first():
    rng = random.Random(7)
    for _ in range(300):
        pairs = [(a, b) for a in range(6) for b in range(6)]
        rng.shuffle(pairs)
        ranks = {p: (k, 6 + k) for k, p in enumerate(pairs[:12])} | {(6 + k, rng.randint(0, 5)): (12 + k, 20 + k) for k in range(5)}
        symbols = [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]
        plain = list(symbols)
        while pairs_now := [(ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            _, i = min(pairs_now)
            plain[i:i + 2] = [ranks[plain[i], plain[i + 1]][1]]
        assert bpe.merge_all(symbols, ranks) == plain


# 3


@pytest.mark.parametrize("n", [0, 1, 155, 156, 168, 169, 170, 352, 353, 575, 576, 577, 36863, 36864, 36865, 200_000])
def test_transport_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    stream = media.mux(data)
    back = media.demux(stream)
    assert back.payload == data and len(stream) % 188 == 0 and back.continuity_errors == 0
    assert len(back.pts) == len(back.random_access) == -(-n // (576 * 64))
    assert back.pts == [k * 64 * media.TICKS for k in range(len(back.pts))]


def test_lost_packets_are_noticed():
    stream = media.mux(bytes(5000))
    damaged = stream[: 188 * 6] + stream[188 * 8:]
    with pytest.raises(ValueError):
        media.demux(damaged)
    extra = stream[: 188 * 4] + stream[188 * 3: 188 * 4] + stream[188 * 4:]
    assert media.demux(extra).continuity_errors > 0
    with pytest.raises(ValueError):
        media.demux(stream[:5] + b"\x77" + stream[6:])


def test_media_columns(table, none):
    rows, df = table
    for r in media.read_media(media.store_media(df)).select("text", "read").collect():
        raw = (r.text or "").encode()
        assert bytes(r.read.payload) == raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
    assert media.read_media(media.store_media(none)).count() == 0


def test_damaged_streams_say_so(spark):
    good = media.mux(media.padded(b"abc" * 5000))
    flipped = bytearray(good)
    flipped[20] ^= 1  # in the first table
    streams = {
        "good": good, "null": None, "empty": b"", "short": good[:-1], "no tables": good[376:], "one table": good[:188] + good[376:], "crc": bytes(flipped), "sync": b"x" + good[1:],
        "cut": good[:188 * 4], "tables only": good[:376], "noise": bytes(random.Random(1).randrange(256) if k % 188 else 0x47 for k in range(188 * 40)),
    }
    df = spark.createDataFrame(list(streams.items()), "name string, media binary")
    got = {r.name: r.read for r in media.read_media(df).collect()}
    for name in ("null", "empty", "tables only"):
        assert (got[name].payload, got[name].error) == (b"", None)
    assert bytes(got["good"].payload).startswith(b"abc" * 5000) and got["good"].error is None
    for name in ("short", "no tables", "one table", "crc", "sync", "cut", "noise"):
        assert got[name].payload is None and got[name].error and got[name].pts == []


# 4


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(table, none, keep, weak):
    rows, df = table
    digest = (lambda c: F.pmod(F.length(c), F.lit(3)).cast("string")) if weak else exact.sha256
    got = exact.duplicate_groups(df, keep=keep, digest=digest, bits=8 if weak else None).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    want = []
    for ids in groups.values():
        best = (max if keep == "largest" else min)((i for i in ids if i is not None), default=None)
        kept = False
        for i in ids:
            want.append((i, best, len(ids), i == best and not kept))
            kept |= i == best
    assert by_row((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == by_row(want)
    assert exact.duplicate_groups(none).count() == 0


def test_keep_distinct(table, none):
    rows, df = table
    kept = exact.keep_distinct(df)
    assert kept.columns == df.columns
    got = [r.text or "" for r in kept.collect()]
    assert sorted(got) == sorted({t or "" for _, t, _ in rows})
    assert set(kept.select("_digest", "word").distinct().collect()) == {("x", "x")}
    assert exact.keep_distinct(none).count() == 0


def test_one_null_or_empty_text_of_an_id_stays(spark):
    df = docs(spark, [(1, None, "s"), (1, "", "s"), (0, "", "s"), (2, "a", "s"), (2, "a", "t"), (None, "a", "s")])
    got = exact.keep_distinct(df).collect()
    assert by_row((r.doc_id, r.text or "") for r in got) == by_row([(1, ""), (2, "a")])


@pytest.mark.parametrize("n", [0, 3, 500])
def test_rows_without_keys(spark, n, monkeypatch):
    df = docs(spark, [(i if i % 50 else None, f"t{i % 7}" if i % 11 else None, "s") for i in range(2000)])
    gone = spark.createDataFrame([(i if i % 50 else None, f"t{i % 7}" if i % 11 else None) for i in range(0, 2 * n, 2)], "a long, b string")
    want = {(i if i % 50 else None, f"t{i % 7}" if i % 11 else None) for i in range(2000)} - {tuple(r) for r in gone.collect()}
    for most in (26, 4):  # with a filter, and where no filter is large enough
        monkeypatch.setattr(exact, "MOST_BITS", most)
        got = exact.without(df, {"a": df.doc_id, "b": df.text}, gone)
        assert {(r.doc_id, r.text) for r in got.collect()} == want and got.columns == df.columns


# 5


def plain_url(u):
    host, path = "", ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(c.lower() if c.isascii() else c for c in host)
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
    low = "".join(c.lower() if c.isascii() else c for c in u or "")

    def stands(term):
        at = low.find(term)
        while at >= 0:
            if not (at and low[at - 1].isalnum()) and not (at + len(term) < len(low) and low[at + len(term)].isalnum()):
                return True
            at = low.find(term, at + 1)
        return False

    strict = sum(map(stands, urls.STRICT))
    soft = [t for t in urls.SOFT if stands(t)]
    reject = strict > 0 or len(soft) >= 2 and sum(urls.SOFT[t] for t in soft) >= urls.REJECT_AT
    return host, path, rule, verdict or ("block" if reject else "allow"), strict, len(soft)


def test_urls(spark):
    rng = random.Random(2)
    odd = [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://xexample.org/en/12", "http://com/fr/", "http://a.com?/de/", "http://a.com/de/#/x",
           "http://x.net/CASINO-x", "http://x.net/casinos", "http://x.net/free/bets", "http://x.net/poker", "http://x.net/poker-sale", "http://x.net/free-free", "http://É.net/win\n/?a=cheap", "a://b://c.org/", "http://x.net/éfree/bet"]
    parts = ["http://", "www.", "example", ".org", ".com", ".net", "/", "en", "es", "de", "fr", "1", "?", "#", "free", "bets", "-", "casino", "Win", ":80"]
    given = odd + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 10))) for _ in range(500)]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(given)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r.strict_hits, r.soft_hits) for r in urls.filter_urls(df).collect()}
    assert got == {i: plain_url(u) for i, u in enumerate(given)}
    assert urls.filter_urls(df.limit(0)).count() == 0


# 6


def test_wavelet_matrix():
    rng = np.random.default_rng(4)
    for n, bits in ((0, 3), (1, 1), (1000, 5), (5000, 16)):
        values = rng.integers(0, min(1 << bits, 300), n)
        m = tokens.WaveletMatrix.from_bytes(tokens.WaveletMatrix.build(values, bits).to_bytes())
        assert m.values().tolist() == values.tolist()
        for i in range(0, n, 97):
            assert m.access(i) == values[i]
        for v in range(0, min(1 << bits, 300), 41):
            at = np.flatnonzero(values == v).tolist()
            assert m.count(v) == len(at) and m.occurrences(v)[:5] == at[:5] and m.count(v, n // 2) == sum(a < n // 2 for a in at)


@pytest.mark.parametrize("block_ids", [500, 1 << 20])
def test_token_files(spark, table, none, library, block_ids):
    rows, df = table
    at = scratch(spark, "tokens")
    tokens.write_tokens(df, at, block_ids=block_ids)
    got = tokens.read_tokens(spark, at).join(tokens.block_starts(spark, at), ["shard", "block"]).collect()
    got = sorted((r.first + r.ahead, r.doc_id, r.n_tokens, bytes(r.ids)) for r in got)
    start = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (i, t, _), g in zip(ordered, got, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert g == (start, i, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = scratch(spark, "tokens")
    tokens.write_tokens(none, empty)
    assert tokens.read_tokens(spark, empty).count() == tokens.block_starts(spark, empty).count() == 0


# 7


def test_mixing(table, none):
    rows, df = table
    got = mixing.mix(df, bucket_docs=8).collect()
    assert by_row(got) == by_row(mixing.mix(df, bucket_docs=8).collect())
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # clamp and share again until none is above its cap
        left = sum(sizes.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not above:
            target |= share
            break
        target |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    taken = dict.fromkeys(order, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.whole * r.size + r.extra
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 12
    assert mixing.mix(none).count() == 0


def test_repeat_rows(table, none):
    rows, df = table
    for bucket_docs in (8, 4096):
        mixed = mixing.repeat_rows(df, bucket_docs=bucket_docs)
        assert mixed.columns == df.columns and set(mixed.select("_copies", "_of", "size").distinct().collect()) == {("x", "x", "x")}
        want = []
        twice = {}  # rows with the same id, source and size are taken alike
        for r in mixing.mix(df, bucket_docs=bucket_docs).collect():
            twice[r.doc_id, r.source, r.size] = max(twice.get((r.doc_id, r.source, r.size), 0), r.whole + (r.size > 0 and 2 * r.extra >= r.size))
        for i, t, s in rows:
            n = len((t or "").split())
            want += [(i, t, s)] * (twice[i, s, n] if n else 0)
        assert by_row((r.doc_id, r.text, r.source) for r in mixed.collect()) == by_row(want)
    assert mixing.repeat_rows(none).count() == 0


# 8


def test_repeats_equal_brute_force(table, none):
    rows, df = table
    got = repeats.remove_repeats(df).collect()
    want = [(i, *x) for (i, *_), x in zip(rows, brute.repeats([(i, t) for i, t, _ in rows]))]
    have = [(r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert by_row(have) == by_row(want)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_of_a_very_common_line(spark, monkeypatch):
    rng = random.Random(9)
    line = "the same line of a licence stands in each of these documents, word for word"
    rows = [(i, "".join(rng.choice("abcd") for _ in range(60)) + line + "".join(rng.choice("abcd") for _ in range(60)), "s") for i in range(200)]
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans)) for r in repeats.remove_repeats(docs(spark, rows)).collect()}
    assert got == {i: x[:3] for (i, *_), x in zip(rows, brute.repeats([r[:2] for r in rows]))}


def test_repeats_inside_documents(spark):
    """Periods, few letters and repeated lines within documents, shared with others at some places only."""
    rng = random.Random(10)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice((20, 55, 70)))) + "\n" for _ in range(12)]
    texts = ["0" * 3000, "ab" * 700 + "0" * 100, "=" * 400 + lines[0] * 9, "0" * 60 + "=" * 90, "abc" * 500, "cab" * 40]
    texts += ["".join(rng.choice(lines) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts += ["".join(rng.choice("ab") for _ in range(900)) for _ in range(4)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k], "s") for i, k in enumerate(order)]
    want = {i: x for (i, *_), x in zip(rows, brute.repeats([r[:2] for r in rows]))}
    for parts in (1, 7):
        found = repeats.remove_repeats(docs(spark, rows).repartition(parts)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in found} == want


@pytest.mark.parametrize("text", ["0" * 200000, "abcdefg" * 30000, "".join(random.Random(11).choice(["line of a table that comes again and again\n", "=" * 70 + "\n", "zz"]) for _ in range(4000))])
def test_repeats_of_one_document_send_few_rows_a_key(text):
    rows = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([0]), pa.array([text])], ["doc", "row", "text"])
    for sent in repeats.rank_anchors([rows]):
        _, sizes = np.unique(sent.column(0).to_numpy(), return_counts=True)
        assert sent.num_rows > 1000 and sizes.max() <= repeats.MANY_RUNS + 1
    locs = pa.array([[repeats.location(p, 0, 1) for p in range(len(text) - repeats.SPAN)]], pa.list_(pa.int64()))
    for sent in repeats.rank_windows([pa.RecordBatch.from_arrays([*rows.columns, locs], ["doc", "row", "text", "locs"])]):
        _, sizes = np.unique(sent.column(0).to_numpy(), return_counts=True)
        assert sizes.max() <= 2


# 9


def plain_fingerprint(t):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(table, none):
    rows, df = table
    got = simhash.near_duplicates(df).collect()
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    component = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    component[a] = component[b] = min(component[a], component[b])
    least = {c: min((i for (i, *_), x in zip(rows, component) if x == c and i is not None), default=None) for c in set(component)}
    want = [(i, f"{p:016x}", least[c]) for (i, *_), p, c in zip(rows, prints, component)]
    have = [(r.doc_id, f"{r.fingerprint & (1 << 64) - 1:016x}", r.component_id) for r in got]
    assert by_row(have) == by_row(want)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("blocks, hot", [(5, 512), (6, 512), (5, 3), (6, 2)])
def test_links_and_long_chains(spark, blocks, hot):
    rng = random.Random(blocks)
    prints = {rng.getrandbits(64) for _ in range(50)}
    for p in list(prints):
        for _ in range(rng.randint(0, 12)):
            for _ in range(rng.randint(1, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    signed = sorted(map(simhash.signed, prints))
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    got = [tuple(r) for r in simhash.links(df, blocks=blocks, hot=hot).collect()]
    assert len(got) == len(set(got))
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert set(got) == {(a, b) for k, b in enumerate(signed) for a in signed[:k] if apart(a, b) <= 3}
    # What meets and isn't discarded is the pivots' work: nearly all pairs that verification gets are links. Two references aren't enough.
    met, few = simhash.candidates(df, blocks=blocks, hot=hot).collect(), simhash.candidates(df, blocks=blocks, hot=hot, refs=simhash.references(2)).count()
    assert len(met) < 3 * len(got) and few > len(met)


def test_no_coordinate_of_two_tables_differs_by_more_than_the_prints(spark):
    rng = random.Random(4)
    a = [rng.getrandbits(64) for _ in range(400)]
    b = list(a)
    for k in range(400):
        for _ in range(k % 10):
            b[k] ^= 1 << rng.randrange(64)
    refs, mask = simhash.references(7), (1 << 40) - (1 << 20)
    x, y = (simhash.distances(np.array(p, np.uint64), mask, refs) for p in (a, b))
    assert x.tolist() == [[((p ^ q) & mask).bit_count() for q in refs] for p in a]
    df = spark.createDataFrame([(int(p), int(q)) for p, q in zip(simhash.packed(x), simhash.packed(y))], "a long, b long")
    near = [r.near for r in df.select(simhash.within(F.col("a"), F.col("b"), 3).alias("near")).collect()]
    assert near == [max(abs(p - q) for p, q in zip(*rows)) <= 3 for rows in zip(x.tolist(), y.tolist())]
    assert all(n for n, p, q in zip(near, a, b) if (p ^ q).bit_count() <= 3) and not all(near)


def test_components_of_chains(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {tuple(r) for r in simhash.components(chain).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_one_of_each_component_stays(table):
    rows, df = table
    distinct = exact.keep_distinct(df)
    kept = simhash.keep_one_of_each(distinct)
    assert kept.columns == df.columns
    groups = simhash.near_duplicates(distinct).select("component_id").distinct().count()
    assert kept.count() >= groups


# 10


def test_quality_is_learned(spark):
    path = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    got = quality.classify(documents, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    for kind in (0, 1):
        assert np.mean([r.predicted == kind for r in held if r.quality == kind]) > 0.9


def test_quality_edges(spark, table, none):
    rows, df = table
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, None), (None, 1), (3, 1), (3, 1)], "doc_id long, quality int")
    assert quality.classify(df, labels).count() == len(rows)
    assert quality.classify(df, labels.limit(0)).select("score").distinct().collect()[0].score == 0.5
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.classify(none, labels).count() == 0


def test_risk_is_not_negative():
    rng = np.random.default_rng(1)
    n = len(quality.FEATURES)
    good, bad = rng.normal(0, 1, (6000, n)), rng.normal(0, 1, (1200, n)) + np.eye(n)[0] * 5
    model = quality.fit_nnpu(good[:3000], np.concatenate([good[3000:], bad]), 3000 / 4200)
    margin = lambda x: quality._design(x, model.mean, model.scale) @ model.weight + model.bias
    assert (margin(good) > 0).mean() > 0.9 and (margin(bad) < 0).mean() > 0.85
