"""Near-duplicates, repeated passages, packing and BPE against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from plinth.llm.components import components
from plinth.llm.minhash import band_count, near_duplicates, parity, superminhash
from plinth.llm.substring import anchors, cut_repeats, remove_repeats
from plinth.llm.textops import HashCache, shingle_set, window_hashes, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bands string, rep int, key string"


def docs(spark, texts, ids=None):
    """Rows with columns whose names the operators use inside, too."""
    rows = [(i, t, None, "s", None, "x", 3, None) for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    out = [None, "", "  \n\t ", "one", "One", "one two three", "a b c d e", "A B C D E"]
    base = prose(rng, 300)
    out += [base] * 3 + [edited(rng, base, k) for k in (1, 2, 3, 4, 6, 8, 12, 20) for _ in range(4)]
    passage = prose(rng, 60)
    out += [f"{prose(rng, 40)}\n{passage} {prose(rng, 30)}" for _ in range(12)]
    out += [f"{passage[:150]}", " ".join(["x"] * 80), prose(rng, 34), prose(rng, 35), "z" * 5000, prose(rng, 20000)]
    out += [prose(rng, rng.randrange(1, 200)) for _ in range(40)]
    return out


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(texts, percent):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates_equal_brute_force(spark, corpus, percent):
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, corpus), percent).collect()}
    sizes, want = brute_components(corpus, percent)
    assert [got[i]["n_shingles"] for i in range(len(corpus))] == sizes
    assert [got[i]["component_id"] for i in range(len(corpus))] == want
    assert all(r["kept"] == (r["component_id"] == r["doc_id"]) for r in got.values())


def test_near_duplicates_null_ids_and_empty_table(spark):
    rows = near_duplicates(docs(spark, ["a b c d e f"] * 3 + [None], [None, 4, 4, None])).collect()
    assert len(rows) == 4 and all(r["kept"] and r["component_id"] == r["doc_id"] for r in rows)
    empty = near_duplicates(docs(spark, []))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """Documents that share half of their words, so that buckets are torn, and near copies among them."""
    monkeypatch.setattr("plinth.llm.minhash.BLOCK_WORK", 100)
    monkeypatch.setattr("plinth.llm.minhash.BLOCK_MEMBERS", 3)
    rng = random.Random(12)
    shared = prose(rng, 120)
    texts = [f"{shared} {prose(rng, 70)}" for _ in range(60)]
    texts += [edited(rng, t, k % 3) for k, t in enumerate(texts[:40])]
    got = {r["doc_id"]: r for r in near_duplicates(docs(spark, texts), 85).collect()}
    sizes, want = brute_components(texts, 85)
    assert [got[i]["component_id"] for i in range(len(texts))] == want and len(set(want)) > 30


def test_bands_follow_the_threshold():
    for percent in (70, 80, 85, 95):
        assert 1e-7 < (1 - (percent / 100) ** 4) ** band_count(percent) <= 1e-6
    assert band_count(100) == 1


def slow_superminhash(elements, size):
    """One element after the other, with the whole permutation."""
    from plinth.llm.textops import mix

    out = [float("inf")] * size
    for e in elements:
        perm = list(range(size))
        for j in range(size):
            bits = int(mix(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
            k = j + ((bits & 0xFFFFFFFF) * (size - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            out[perm[j]] = min(out[perm[j]], j + (bits >> 40) / (1 << 24))
    return out


def test_superminhash_stops_early_without_changing_a_slot():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n).astype(np.uint64) for n in (1, 3, 40, 200)]
    assert np.allclose(superminhash(sets, 16), [slow_superminhash(s, 16) for s in sets])


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 300).astype(np.uint64)
        b = np.concatenate([a[:270], rng.integers(0, 2**63, 30).astype(np.uint64)])
        one, two = superminhash([a, b], 64)
        errors.append((one == two).mean() - 270 / 330)
    assert abs(np.mean(errors)) < 0.02 and np.var(errors) < (270 / 330) * (60 / 330) / 64 * 1.3


def test_parity_never_overstates_the_difference():
    rng = np.random.default_rng(5)
    for n, k in ((50, 0), (200, 10), (3000, 40)):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[k:], rng.integers(0, 2**63, k).astype(np.uint64)])
        assert sum(int(x).bit_count() for x in (parity(a) ^ parity(b)).view(np.uint64)) <= 2 * k


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(200, 200), (None, 3), (300, 299), (300, 299)]
    rng.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {299: 299, 300: 299}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_repeats(texts, size):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for w in words:
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if seen[tuple(w[k : k + size])] > 1:
                keep[k : k + size] = [False] * size
        kept = [x for x, y in zip(w, keep) if y]
        out.append((len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


@pytest.mark.parametrize("windows,buckets", [(40_000, 400_000), (100, 50), (7, 400_000)])
def test_remove_repeats_equals_brute_force(spark, corpus, windows, buckets, monkeypatch):
    monkeypatch.setattr("plinth.llm.substring.SHARD_WINDOWS", windows)
    monkeypatch.setattr("plinth.llm.substring.BUCKET_WINDOWS", buckets)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(docs(spark, corpus)).collect()}
    assert [got[i] for i in range(len(corpus))] == brute_repeats(corpus, 35)


def test_remove_repeats_null_ids_repeated_rows_and_empty_table(spark):
    text = prose(random.Random(8), 50)
    rows = remove_repeats(docs(spark, [text, text, text + " x", None], [None, None, 7, 7])).collect()
    assert sorted((r["n_words"], r["n_removed"]) for r in rows) == [(0, 0), (50, 50), (50, 50), (51, 50)]
    assert remove_repeats(docs(spark, [])).count() == 0


def test_cut_repeats_keeps_columns_and_white_space(spark):
    rng = random.Random(9)
    passage, a, b = prose(rng, 40), "Alpha\n beta", "gamma  delta"
    got = {r["doc_id"]: r for r in cut_repeats(docs(spark, [f"{a} {passage}\n{b}", f"{passage}", " as it\twas ", None])).collect()}
    assert [got[i]["text"] for i in range(4)] == [f"{a} {b}", "", " as it\twas ", None]
    assert got[0]["n_chars"] == len(f"{a} {b}") and got[3]["n_chars"] is None and got[0]["rep"] == 3


def test_cut_repeats_with_columns_of_any_name(spark):
    passage = prose(random.Random(3), 40)
    table = spark.createDataFrame([(1, f"a {passage}", "k", "r", 5), (2, f"b {passage}", None, None, 6)], "doc_id long, text string, key string, Ranges string, _key int")
    got = {r["doc_id"]: r for r in cut_repeats(table).collect()}
    assert [tuple(got[i]) for i in (1, 2)] == [(1, "a", "k", "r", 5), (2, "b", None, None, 6)]


def test_each_window_has_one_anchor_and_equal_windows_equal_ones():
    rng = random.Random(6)
    cache = HashCache()
    passage = prose(rng, 35, 20).encode().split()
    found = set()
    for _ in range(20):
        before = prose(rng, rng.randrange(0, 60), 20).encode().split()
        hashes = word_hashes(before + passage + prose(rng, 30, 20).encode().split(), cache)
        grams, _, first, count = anchors(hashes, 35)
        assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == len(hashes) - 34
        found.add(int(grams[np.searchsorted(first, len(before), side="right") - 1]))
    assert len(found) == 1


def test_window_hashes_equal_for_equal_words_only():
    cache = HashCache()
    h = word_hashes(b"a b c a b c d".split(), cache)
    w = window_hashes(h, 3)
    assert len(w) == 5 and w[0] == w[3] and len(set(w.tolist())) == 4
    assert len(window_hashes(h, 8)) == 0
    assert len(shingle_set("a b", 5, cache)) == 1 and shingle_set("a b", 5, cache)[0] != shingle_set("b a", 5, cache)[0]


tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
ODD = [
    None, "", " ", "a", "it's we'LL 'S don't", "héllo wörld 漢字テスト 😀😀 ‍", "  two   three\n\n x \t\n y  ", "a" * 3000, "<|endoftext|>x <|endoftext|>\n\n<|endoftext|>", "foo \n <|endoftext|>", "a \n b", "x\n\ny", "1234567890" * 40,
    "  thin ", "end\n", "\nstart", " lead", "stop.\nNext, one; two: three! four?", "\x01odd", "\x01", "\x02 \x02", "x\u00a0 y", "x \u2028y", "a\x1c\x1cb", "a\x85\x85b", "µm ªº Ⅷ ²³ ǅ", "!!!???...", "é́́",
]


def reference():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


def fuzz(seed=1, n=150):
    rng = random.Random(seed)
    pool = [*"abctheinreon ABÉ漢'\n\t0129#!😀.,", " ", " ", "ing", "tion", "<|endoftext|>"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 120))) for _ in range(n)]


def test_automaton_equals_the_library():
    from plinth.llm.bpe import coder

    code, library = coder(public.path("byte_bpe_50k.json"), public.PATTERN), reference()
    for text in [t or "" for t in ODD] + fuzz():
        want = library.encode(text, add_special_tokens=False).ids
        assert code.encode(text) == want, repr(text)
        assert code.decode(want) == library.decode(want, skip_special_tokens=False)
        assert code.decode(want[1:]) == library.decode(want[1:], skip_special_tokens=False)


def test_small_automaton_accepts_only_what_bpe_produces():
    from itertools import product

    from plinth.llm.bpe import MergeAutomaton

    vocab = {b"a": 0, b"b": 1, b"aa": 2, b"ab": 3, b"aab": 4, b"ba": 5}
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5)]

    def merge(word):
        parts = [vocab[bytes([c])] for c in word]
        for u, v, w in merges:
            k = 0
            while k < len(parts) - 1:
                if parts[k : k + 2] == [u, v]:
                    parts[k : k + 2] = [w]
                k += 1
        return parts

    machine = MergeAutomaton(vocab, merges)
    for n in range(1, 9):
        for word in product(b"ab", repeat=n):
            assert machine.encode(bytes(word)) == merge(bytes(word))


def test_round_trip_query(spark):
    from plinth.llm.bpe import encode_documents, round_trip_digests

    args, library = (public.path("byte_bpe_50k.json"), public.PATTERN), reference()
    got = {r["doc_id"]: r for r in round_trip_digests(docs(spark, ODD), *args).collect()}
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert round_trip_digests(docs(spark, []), *args).count() == 0
    assert encode_documents(docs(spark, ["a b"]), *args).first()["ids"] == library.encode("a b", add_special_tokens=False).ids


def test_word_wise_ids_equal_the_library():
    from plinth.llm.packing import TextIds

    ids, library = TextIds(public.path("byte_bpe_50k.json")), reference()
    texts = [t or "" for t in ODD] + fuzz(2, 400)
    for _ in range(2):  # the second time from what is kept
        flat, bounds = ids(pa.array([None, *texts]).slice(1))
        for text, a, b in zip(texts, bounds, bounds[1:]):
            assert flat[a:b].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0], repr(text)
    assert [len(x) for x in ids(pa.array([], pa.string()))] == [0, 1]


def test_packing(spark, corpus):
    from plinth.llm.packing import pack

    texts, library = corpus + ODD, reference()
    rows = pack(docs(spark, texts), public.path("byte_bpe_50k.json")).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for part in sequences.values():
        at = 0
        for r in sorted(part, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and len(part) <= 64
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding == 0
    assert pack(docs(spark, []), public.path("byte_bpe_50k.json")).count() == 0


def test_packing_of_instructions_holds_the_limit_on_loss(spark):
    from plinth.llm.packing import pack

    rng, library = random.Random(4), reference()
    rows = [(i, prose(rng, rng.randrange(0, 400)) or None, prose(rng, rng.randrange(0, 300)) or None) for i in range(60)] + [(60, "p", prose(rng, 3000))]
    loose = pack(spark.createDataFrame(rows, "doc_id long, ask string, text string"), public.path("byte_bpe_50k.json"), prompt="ask")
    tight = pack(spark.createDataFrame(rows, "doc_id long, ask string, text string").coalesce(1), public.path("byte_bpe_50k.json"), loss_limit=300, prompt="ask").collect()
    load, most = Counter(), Counter()
    for r in tight:
        load[r["sequence_id"]] += r["loss_tokens"]
    for r in loose.collect():
        most[r["sequence_id"]] += r["loss_tokens"]
    assert max(load.values()) == 300 < max(most.values())  # without the limit, it would be passed
    for i, ask, text in rows:
        asked, told = (library.encode(t or "", add_special_tokens=False).ids for t in (ask, text))
        ids, at = [*asked, *told, 0], 0
        mine = sorted((r for r in tight if r["doc_id"] == i), key=lambda r: r["start"])
        for r in mine:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            assert r["loss_tokens"] == sum(at <= k < at + r["length"] for k in range(len(asked), len(ids)))
            at += r["length"]
        assert at == len(ids)


@pytest.mark.parametrize("share,limit", [(1.0, 1024), (0.5, 300), (0.9, 512), (0.0, 100)])
def test_fill_holds_all_limits(share, limit):
    from plinth.llm.packing import fill

    rng = np.random.default_rng(1)
    tokens = rng.integers(1, 3000, 300)
    loss = (tokens * share).astype(int)
    got = {}
    for part in fill(tokens, loss, 1024, 8, limit):
        assert sum(n for _, _, n in part) <= 1024 and len(part) <= 8
        assert sum(max(0, at + n - max(at, tokens[i] - loss[i])) for i, at, n in part) <= limit
        for i, start, n in part:
            got.setdefault(i, []).append((start, n))
    for i, total in enumerate(tokens):
        at = 0
        for start, n in sorted(got[i]):
            assert start == at
            at += n
        assert at == total
