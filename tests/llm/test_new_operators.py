"""Repeated phrases, conversation prefixes and lexical search against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pulseframe.llm import lexical, phrases, prefixes

DOCS = "doc_id long, text string, id string, tie string, n_words int, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", -1, "z") for i, t in rows], DOCS)


# Repeated phrases


def plain_phrases(rows, span=20):
    """(doc_id, text) -> sorted (doc_id, n_words, n_removed, kept); ids differ."""
    words = {i: (t or "").encode().split() for i, t in rows}
    order = sorted(words, key=lambda i: (i is None, i or 0))
    first = {}
    for i in order:
        for s in range(len(words[i]) - span + 1):
            first.setdefault(tuple(words[i][s : s + span]), (i, s))
    out = []
    for i in order:
        gone = [False] * len(words[i])
        for s in range(len(words[i]) - span + 1):
            if first[tuple(words[i][s : s + span])] != (i, s):
                gone[s : s + span] = [True] * span
        out.append((i, len(words[i]), sum(gone), b" ".join(w for w, g in zip(words[i], gone) if not g).decode()))
    return out


def swept(df, **more):
    rows = phrases.remove_repeated_phrases(df, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def phrase_rows(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ç", "the", "of", "Wort", "x" * 9]) if rng.random() < 0.3 else f"w{rng.randrange(400)}"
    shared = [[word() for _ in range(rng.randrange(10, 90))] for _ in range(8)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rng.randrange(1, 5)):
            s = rng.choice(shared)
            at = rng.randrange(len(s))
            text += s[at : at + rng.randrange(5, 70)] if rng.random() < 0.6 else [word() for _ in range(rng.randrange(40))]
        rows.append((i * 7 % n, rng.choice([" ", "\n", "\t ", "\x0b"]).join(text)))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_phrases_against_plain(spark, seed):
    rows = phrase_rows(seed)
    assert swept(docs(spark, rows), shards=1 + 2 * seed) == plain_phrases(rows)


def test_phrases_cut_at_slices_give_the_same(monkeypatch, spark):
    rows = phrase_rows(9, 30)
    text = " ".join(t for _, t in rows)
    monkeypatch.setattr(phrases, "STEP", 64)
    monkeypatch.setattr(phrases, "PIECE", 200)
    found = lambda: [(int(d), int(b.place[p][s]), b.h1[p][s : s + 20].tobytes()) for _, b in phrases.blocks(__import__("pyarrow").array([text])) for p in b.slices(19) for a, e, _ in [phrases.passages(b, p)] for x, y in zip(a, e) for s in range(x, y - 19) for d in [b.doc[p][s]]]
    small = found()
    monkeypatch.setattr(phrases, "STEP", 1 << 17)
    monkeypatch.setattr(phrases, "PIECE", 1 << 20)
    assert sorted(small) == sorted(found())
    assert len(small) == len(text.split()) - 19


def test_phrases_edges(spark):
    passage = " ".join(f"p{k}" for k in range(25))
    rows = [(3, None), (4, ""), (5, " \n"), (6, "one"), (None, passage), (7, passage), (8, passage), (9, "same " * 60), (10, "x " + passage + " y")]
    out = {r[0]: r for r in swept(docs(spark, rows))}
    assert sorted(out.values(), key=str) == sorted(plain_phrases(rows), key=str)
    assert out[None][2] == 25 and out[7][2] == 0 and out[9][2:] == (59, "same") and out[10][3] == "x y"
    twice = swept(docs(spark, [(1, passage), (1, passage), (2, passage)]))
    assert [r[2] for r in twice] == [0, 0, 25]  # rows with one id and text are one document
    assert swept(docs(spark, [])) == []


def test_a_phrase_earlier_inside_a_longer_one_stays(spark):
    run = [f"r{k}" for k in range(60)]
    rows = [(0, " ".join(run)), (1, " ".join(run[10:45])), (2, " ".join(run[10:45])), (3, "z " + " ".join(run[5:50]) + " q")]
    assert swept(docs(spark, rows)) == plain_phrases(rows)


def test_phrases_with_text_ids(spark):
    passage = " ".join(f"p{k}" for k in range(30))
    df = spark.createDataFrame([("b", passage), ("a", passage)], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in phrases.remove_repeated_phrases(df).collect()} == {"a": 0, "b": 30}


# Conversation prefixes


def plain_trie(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(not any(len(q2) == len(q) + 1 and q2[: len(q)] == q for q2 in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in cs if len(whole[c]) == len(p))
        out.append((cs[0], len(p), members[p[:-1]][0] if p else None, len(cs), kids, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int, node int")
    turns = prefixes.ordered_turns(df)
    return sorted((tuple(r) for r in prefixes.prefix_trie(prefixes.rebuilt(turns), turns).collect()), key=str)


def conversation_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 60), 40):
        for t in range(rng.randrange(1, 12)):
            rows.append((c, rng.choice([None, t, t, t, t]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é", "", None, "long text"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_trie_against_plain(spark, seed):
    rows = conversation_rows(seed)
    assert trie(spark, rows) == plain_trie(rows)


def test_trie_of_long_equal_and_bare_conversations(spark, monkeypatch):
    monkeypatch.setattr(prefixes, "PIECE", 3)
    rows = [(c, t, "u", f"t{t}") for c in (5, 10, 15, 20, 25, 30, 35) for t in range(3 if c > 20 else 40)]
    rows += [(6, 0, "u", "x"), (7, 0, "u", "y"), (None, 0, "u", "no conversation"), (6, 0, "u", "x")]
    got = trie(spark, rows)
    assert got == plain_trie(rows)
    assert trie(spark, []) == []


# Lexical search


def plain_terms(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            out, word = out + [word] * bool(word), ""
        else:
            word += c
    return out + [word] * bool(word)


def plain_search(rows, items, k=10):
    found = [(i, Counter(plain_terms(t))) for i, t in rows]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(plain_terms(t))
    out = []
    for item, terms in wanted.items():
        scores = []
        for i, c in found:
            m = 10 + 90 * c.total() * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


ITEMS = "item_id string, text string, term string, score long"


def searched(spark, rows, items, **more):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, term string, id string, n long")
    out = lexical.search(df, spark.createDataFrame([(*i, "x", 0) for i in items], ITEMS), **more)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_search_against_plain(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "éa", "Ab", "aB", "9", "x-y", "ß"]
    rows = [(k % 50, " ".join(rng.choices(vocabulary, k=rng.randrange(40)))) for k in range(80)] + [(None, "w1 w2 ab"), (90, None), (91, ""), (92, "- !")]
    items = [(f"i{k}", ", ".join(rng.choices(vocabulary + ["unseen"], k=rng.randrange(1, 8)))) for k in range(12)] + [("i1", "w3"), ("none", None), (None, "w4 w5"), ("empty", " ")]
    assert searched(spark, rows, items) == plain_search(rows, items)
    assert searched(spark, rows, items, k=2) == plain_search(rows, items, 2)


def test_search_of_nothing(spark):
    assert searched(spark, [], [("i", "a")]) == []
    assert searched(spark, [(1, "a")], []) == []
    assert searched(spark, [(1, "a"), (1, "a"), (0, "a")], [("i", "A a")]) == plain_search([(1, "a"), (1, "a"), (0, "a")], [("i", "A a")])


def test_long_texts_are_counted_piece_by_piece(monkeypatch):
    text = "Ab, cd-éf " * 200
    want = Counter(t.encode() for t in plain_terms(text))
    monkeypatch.setattr(lexical, "PIECE", 7)
    assert lexical.term_counts(text) == want


def test_matches_are_summed_without_another_exchange(spark):
    """Postings move by document once; the sums by document and item need no exchange of the matches."""
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    out = lexical.search(df, spark.createDataFrame([("i", "a b")], "item_id string, text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" in plan.replace("row#", "row") and "hashpartitioning(item" in plan
    assert out.filter(F.col("rank") == 1).first().doc_id == 1


# Weights of url terms, and questions to shards of token files


def test_light_terms_reject_only_together():
    from pulseframe.llm import urls

    judge = lambda *terms: (lambda s, w: bool(s) or len(w) >= urls.LEAST_SOFT and sum(w.values()) >= urls.REJECT_AT)(*urls.hits("http://x.net/" + "-".join(terms), urls.STRICT, tuple(urls.SOFT.items())))
    assert not judge("cheap", "deal") and not judge("cheap", "deal", "sale") and judge("cheap", "deal", "sale", "free")
    assert judge("poker", "free") and judge("bets", "ads") and not judge("poker") and not judge("poker", "poker") and judge("casino")
    assert set(urls.SOFT.values()) == {1, 2, 3}


@pytest.fixture(scope="module")
def token_files(spark):
    import numpy as np

    from pulseframe.llm import tokens
    from pulseframe.llm.common import scratch

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "of", "ça", "zebra", "12", "\n", "a"]) for _ in range(rng.randrange(60)))) for i in range(90)] + [(None, "the a"), (400, None)]
    at = scratch(spark, "tokens")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tokens.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), at, block_ids=300)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = defaultdict(list)  # shard -> (doc, place, token)
    for r in sorted(tokens.read_tokens(spark, at).collect(), key=lambda r: (r.shard, r.block, r.ahead)):
        plain[r.shard] += [(r.doc_id, k, int(t)) for k, t in enumerate(np.frombuffer(bytes(r.ids), "<u4"))]
    return at, plain


def test_shards_count_and_find_tokens(spark, token_files):
    from pulseframe.llm import tokens

    at, plain = token_files
    assert len(plain) > 1 and max(map(len, plain.values())) > 300  # several shards, and several blocks in one
    wanted = sorted({t for rows in plain.values() for *_, t in rows})[::3] + [2, 49_999, 1 << 20, 2]
    counts = {(r.shard, r.token): r.n for r in tokens.count_tokens(spark, at, wanted).collect()}
    assert counts == {(s, t): sum(t == x for *_, x in rows) for s, rows in plain.items() for t in set(wanted)}
    found = sorted((r.shard, r.token, r.position, r.doc_id, r.place) for r in tokens.find_tokens(spark, at, wanted).collect())
    assert found == sorted((s, t, p, d, k) for s, rows in plain.items() for p, (d, k, t) in enumerate(rows) if t in wanted)
    one = next(iter(plain))
    assert {r.shard for r in tokens.count_tokens(spark, at, [2], shard=one).collect()} == {one}
    assert tokens.count_tokens(spark, at, []).count() == tokens.find_tokens(spark, at, []).count() == 0


def test_shards_give_the_token_at_a_position(spark, token_files):
    from pulseframe.llm import tokens

    at, plain = token_files
    asked = [(s, p) for s, rows in plain.items() for p in (*range(0, len(rows), 41), len(rows) - 1, len(rows), -1, 0, 0)] + [(next(iter(plain)), None), (77_777, 3)]
    got = sorted(((r.shard, r.position, r.token) for r in tokens.access_tokens(spark, at, spark.createDataFrame(asked, "shard long, position long")).collect()), key=str)
    want = [(s, p, plain[s][p][2] if p is not None and 0 <= p < len(plain.get(s, ())) else None) for s, p in asked]
    assert got == sorted(want, key=str)


def test_only_digests_of_several_runs_are_merged(spark):
    """Filters of runs are asked first: rows that their own run alone can have pass by the merge."""
    from pulseframe.llm import exact

    rows = spark.range(3000).select(F.sha2(F.when(F.col("id") % 100 == 0, F.lit("x")).otherwise(F.col("id").cast("string")).cast("binary"), 256).alias("digest"), "id")
    index = exact.DigestIndex(spark, memtable_rows=500, memtables=1)
    index.flush(rows.filter("id < 2000"))
    index.flush(rows.filter("id >= 2000"))
    assert len(index.runs) == 6  # four memtables of the first flush, two of the second
    apart, together = index.split()
    assert apart.count() + together.count() == sum(spark.read.parquet(p).count() for p, _ in index.runs)
    assert together.filter(F.col("digest") == hashlib.sha256(b"x").hexdigest()).count() == 6 and together.count() < 0.3 * 3000
    assert apart.filter(F.col("n") > 1).count() == 0 and apart.groupBy("digest").count().filter("count > 1").count() == 0
    whole = index.compact()
    assert whole.count() == 2971 and whole.filter("n > 1").collect()[0][1:] == (0, 2900, 30)
    assert len(index.runs) == 1
    index.flush(rows.filter("id < 7").select("digest", (F.col("id") + 5000).alias("id")))
    again = {r.digest: (r.least_id, r.largest_id, r.n) for r in index.compact().filter("n > 1").collect()}
    assert again[hashlib.sha256(b"x").hexdigest()] == (0, 5000, 31) and again[hashlib.sha256(b"3").hexdigest()] == (3, 5003, 2) and len(again) == 7


def test_shards_of_nothing(spark):
    from pulseframe.llm import tokens
    from pulseframe.llm.common import scratch

    at = scratch(spark, "tokens")
    tokens.write_tokens(spark.createDataFrame([], "doc_id long, text string"), at)
    assert tokens.count_tokens(spark, at, [1]).count() == tokens.find_tokens(spark, at, [1]).count() == 0
    assert [r.token for r in tokens.access_tokens(spark, at, spark.createDataFrame([(0, 0)], "shard long, position long")).collect()] == [None]


def test_planes_of_a_matrix_are_those_of_its_definition():
    import numpy as np
    from pulseframe.llm.tokens import WaveletMatrix

    rng = np.random.default_rng(3)
    for bits, n in ((1, 9), (16, 0), (16, 1), (16, 5000), (17, 5000)):
        values = rng.integers(0, 1 << bits, n)
        matrix, now = WaveletMatrix.build(values, bits), values.tolist()
        for k in range(bits):
            on = [v >> bits - 1 - k & 1 for v in now]
            assert np.unpackbits(matrix.planes[k], count=n, bitorder="little").tolist() == on and matrix.zeros[k] == on.count(0)
            now = [v for v, o in zip(now, on) if not o] + [v for v, o in zip(now, on) if o]
        assert WaveletMatrix.from_bytes(matrix.to_bytes()).values().tolist() == values.tolist()


def test_rows_of_equal_ranks_alone_are_sorted_by_all_keys():
    import numpy as np
    from pulseframe.llm.repeats import order_by

    rng = np.random.default_rng(4)
    for n, values in ((0, 3), (1, 3), (2, 1), (4000, 3), (4000, 1500), (4000, 1 << 60)):
        first, *more = (rng.integers(0, v, n).astype(np.uint64) for v in (values, 3, 4, 2))
        assert order_by(first, *more).tolist() == np.lexsort((*reversed(more), first)).tolist()


def test_a_word_is_kept_once_whatever_ends_it():
    """And ids are the library's, for parts that are words, ends of line, not separate, or of other letters."""
    import numpy as np
    from tokenizers import Tokenizer

    from pulseframe.llm import bpe, tokens

    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefgh\u00e9") for _ in range(6)) + str(k).translate(str.maketrans("0123456789", "klmnopqrst")) for k in range(40)]
    texts = [" ".join(w + end for w in words) for end in ("", ".", ",", "!?", "...", ")")]
    encoder = tokens.LibraryEncoder(bpe.VOCABULARY)
    list(encoder.packed_all(texts))
    assert len(encoder.now) <= len(words)
    texts += ["", " ", "  ", "a", " a", "a ", "a  b c", "a\n b", "a b\n", "don't (it) x1 \u0416\u0437, \u00fc! <|endoftext|> y", ". . !", "x " * 50]
    library = Tokenizer.from_file(bpe.VOCABULARY)
    for t, packed in zip(texts, encoder.packed_all(texts), strict=True):
        assert np.frombuffer(packed, np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids, t
