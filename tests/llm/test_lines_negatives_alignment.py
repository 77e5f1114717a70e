"""Line dedup, hard negatives and cross-tokenizer alignment."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plinth.llm import alignment as A
from plinth.llm import negatives as N
from plinth.llm.bpe import byte_letters
from plinth.llm.line_dedup import dedup_digests, dedup_lines

# Line dedup


def brute_lines(rows, documents, least=1):
    cut = [(i, t, (t or "").split("\n")) for i, t in rows]
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def key(line):
        return line.strip(" \t\n\v\f\r").translate(upper)

    count = Counter(k for _, _, lines in {(i, t, tuple(x)) for i, t, x in cut} for k in {key(line) for line in lines})
    gone = {k for k, n in count.items() if n >= documents and len(k) >= least}
    return sorted((repr(i), len(x), sum(key(line) in gone for line in x), "\n".join(line for line in x if key(line) not in gone)) for i, _, x in cut)


def test_lines_against_brute_force(spark):
    rng = random.Random(3)
    pool = ["Menu", "menu ", "\tMENU\r", "ÄRGER", "ärger", "", "  ", "a\x0bb", "\xa0menu", "x" * 500, "日本", "İ", "i̇", "Σ", "ς", "end\x1c"]
    rows = [(n, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {n} {k}" for k in range(rng.randrange(1, 12)))) for n in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "\n\n\n"), (None, "menu"), (None, "menu\nrest"), (7, "menu\nseven again"), (104, "menu\n" * 5000 + "tail")]
    rows += [(200, "twice\nmenu")] * 3
    for documents, least in ((10, 1), (3, 1), (2, 0), (5, 3)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = dedup_lines(docs, documents, least).collect()
        assert sorted((repr(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got) == brute_lines(rows, documents, least)


def test_equal_rows_are_one_document(spark):
    docs = spark.createDataFrame([(1, "same\nrest")] * 12 + [(2, "same")], "doc_id long, text string")
    assert {r.n_dropped for r in dedup_digests(docs, documents=3).collect()} == {0}
    assert {r.n_dropped for r in dedup_digests(docs, documents=2).collect()} == {1}


def test_lines_with_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", 4, 5), (2, "a", None, 6, 7)], "doc_id long, text string, n_lines string, _r1 int, _lines int")
    out = dedup_lines(docs, documents=2)
    assert out.columns == ["doc_id", "text", "n_lines", "_r1", "_lines", "n_lines_", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "b", "x", 4, 5, 2, 1), (2, "", None, 6, 7, 1, 1)]
    none = dedup_digests(docs.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


def test_lines_run_no_python(spark):
    docs = spark.createDataFrame([(n, "menu\nrest") for n in range(20)], "doc_id long, text string")
    plan = dedup_digests(docs)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# Hard negatives


def brute_negatives(rows, positives=5, negatives=10):
    by_id = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        z = [int(np.floor(256 * x)) for x in v]
        by_id.setdefault(i, []).append((label, z))
    width = max((len(z) for x in by_id.values() for _, z in x), default=0)
    one = {i: min(x) for i, x in by_id.items()}
    table = {i: (label, np.array(z + [0] * (width - len(z)), object)) for i, (label, z) in one.items()}
    out = []
    for a, (label, z) in table.items():
        if a % 100:
            continue
        scored = sorted((-int(z @ y), i, other) for i, (other, y) in table.items() if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [(s, j) for s, j, other in scored if other != label and 30 * -p <= 100 * -s <= 90 * -p][:negatives]
            out += [(a, i, rank, j, -p, -s) for rank, (s, j) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, rank string, z int")
    return sorted(tuple(r) for r in N.hard_negatives(df, **options).collect())


@pytest.mark.parametrize("leaf_rows", [16, 100000])
def test_negatives_against_brute_force(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(N, "LEAF_ROWS", leaf_rows)
    monkeypatch.setattr(N, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = []
    for i in range(900):
        v = centres[i % 6] + rng.normal(size=8) * 0.3
        rows.append((i, int(rng.integers(0, 4)), (np.round(v, 1) if i % 2 else v).tolist()))
    rows += [(1000 + i, i % 2, centres[0].tolist()) for i in range(200)]
    rows += [(2000, None, [1.0] * 8), (2100, 1, None), (2200, 1, [1.0, None] * 4), (2300, 1, [float("nan")] * 8), (2400, 2, [float("inf")] + [0.0] * 7)]
    rows += [(None, 1, [1.0] * 8), (2500, 1, [0.0] * 8), (2600, 2, [5.0, 4.0]), (2700, 3, []), (2800, 0, [-9.5] * 8), (300, 3, [0.25] * 8), (2900, 9, [1.0] * 8)]
    rows += [rows[200], rows[200]]
    got = mined(spark, [(*r, "x", 1) for r in rows])
    assert got == brute_negatives(rows) and len(got) > 300


def test_windows_spare_leaves_of_clustered_rows(spark, monkeypatch):
    monkeypatch.setattr(N, "LEAF_ROWS", 32)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 6)) * 4
    rows = [(i, i % 3, (centres[i % 40] + rng.normal(size=6) * 0.05).tolist()) for i in range(2000)]
    visits = []
    whole = N._Index._leaves

    def counted(self, queries, most):
        out = whole(self, queries, most)
        visits.append((out.select(F.sum(F.size("leaves"))).first()[0], len(self.bounds.value.rows), out.count()))
        return out

    monkeypatch.setattr(N._Index, "_leaves", counted)
    assert mined(spark, [(*r, "x", 1) for r in rows]) == brute_negatives(rows)
    assert sum(v for v, _, _ in visits) < 0.6 * sum(leaves * asked for _, leaves, asked in visits[::2])


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, (rng.normal(size=4) * 150000).tolist()) for i in range(0, 300)]
    assert mined(spark, [(*r, "x", 1) for r in rows]) == brute_negatives(rows)


def test_negatives_of_nothing(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(100, 1, [1.0], "x", 1)]) == []
    assert mined(spark, [(1, 1, [1.0], "x", 1), (2, 2, [1.0], "x", 1)]) == []
    assert mined(spark, [(100, 1, [1.0], "x", 1), (200, 1, [1.0], "x", 1)]) == []


def test_tree_bounds_hold(spark):
    rng = np.random.default_rng(4)
    points = np.round(rng.normal(size=(500, 5)) * 50)
    longest = float((points**2).sum(axis=1).max())
    lifted = N._lifted(points, longest)
    tree = N.VantageTree(lifted[::3], 16)
    leaf, away = tree.place(lifted)
    entries = [(l, level, d) for l, path in zip(leaf, away) for level, d in enumerate(path)]
    spans = {}
    for l, level, d in entries:
        lo, hi = spans.get((l, level), (np.inf, -np.inf))
        spans[l, level] = min(lo, d), max(hi, d)
    keys = np.array(list(spans))
    values = np.array(list(spans.values()))
    bounds = N.LeafBounds(tree, keys[:, 0], keys[:, 1], values[:, 0], values[:, 1], np.bincount(leaf, minlength=len(tree.leaves)))
    queries = np.hstack([points[:20], np.zeros((20, 1))])
    low, high = bounds.reach(queries)
    true = np.sqrt(((queries[:, None, :] - lifted[None, :, :]) ** 2).sum(axis=2))
    assert (true >= low[:, leaf] - 1e-6).all() and (true <= high[:, leaf] + 1e-6).all()
    assert len(tree.leaves) > 8 and (np.bincount(leaf) > 0).sum() > 8


# Alignment


def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    one, two = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    letters = byte_letters()
    docs, links = [], Counter()
    for text in texts:
        docs.append(None)
        if not text:
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        spelled = [bytes(letters[c] for c in one.id_to_token(i)) for i in a], [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(x) != (" " + text).encode() for x in spelled):
            continue
        ends = [np.cumsum([len(t) for t in x]) for x in spelled]
        begins = [e - [len(t) for t in x] for e, x in zip(ends, spelled)]
        own = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if begins[0][i] < ends[1][j] and begins[1][j] < ends[0][i]] if len(a) < 200 else None
        if own is None:
            at = [np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in spelled]
            own = [(a[i], b[j]) for i, j in sorted(set(zip(at[0].tolist(), at[1].tolist())))]
        cuts = sorted(set(ends[0].tolist()) & set(ends[1].tolist()))
        groups = [([a[i] for i in range(len(a)) if lo < ends[0][i] <= hi], [b[j] for j in range(len(b)) if lo < ends[1][j] <= hi]) for lo, hi in zip([0, *cuts], cuts)] if len(a) < 2000 else None
        docs[-1] = (len(a), len(b), len(cuts), own, groups)
        links.update(own)
    most = {}
    for (_, b), n in links.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc in docs:
        if doc is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, cuts, own, groups = doc
        sha = None if groups is None else hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest()
        out.append((n_a, n_b, cuts, len(own), sum(links[p] == most[p[1]] for p in own), sum(links[p] for p in own), sha))
    return out


ODD = [
    None, "", " ", "  ", "x", " x", "x ", "  two  blanks ", "a\n b\t\tc\r\n\r\n d", "<|endoftext|>", "say <|endoftext|> and <s> </s> <unk>", "▁a", "a▁ b", "<0x41>",
    "naïve café ÀÉ", "日本語のテキスト", "Ελληνικά ςΣ", "emoji 👩‍👩‍👧 🇩🇪", "\x00\x01\x02", "é́ﬁ Ａ　b\xa0c", "​﻿", "１２３ 42", "don't can't I'LL", "x" * 3000, "word " * 800, "a\x01b", "\n\n\n", "…—“”",
]


@pytest.mark.parametrize("kept", [1 << 19, 50, 0])
def test_alignment_against_brute_force(spark, monkeypatch, kept):
    monkeypatch.setattr(A, "KEPT_PAIRS", kept)
    rng = random.Random(1)
    letters = "ab eé\n .日,<>▁' \t1" if kept else "abc "
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + ["same text again"] * 5
    rows = [(n if n % 9 else None, t, n, "y") for n, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = A.align(df, *paths()).collect()
    want = brute_alignment(texts)
    assert sorted((repr(n if n % 9 else None), *w) for n, w in enumerate(want) if w[-1]is not None) == sorted((repr(r.doc_id), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got)


def test_encoders_equal_the_libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    worker = A.Aligner(a_path, b_path)
    one, two = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    one.encode_special_tokens = True
    rng = random.Random(7)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("aA é\n  .日<>|_\t1'") for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    arr = pa.array(texts)
    ids, bounds = worker.b(arr)
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == (two.encode(t) if t else [two.piece_to_id("▁")])
    ids, bounds = worker._a(pa.array([" " + t for t in texts]))
    for k, t in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == one.encode(" " + t, add_special_tokens=False).ids


def test_owners_give_links_and_cuts():
    at_a, at_b, group_a, group_b = A.aligned(np.array([1, 2, 3]), np.array([1, 1, 1, 3]))
    assert list(zip(at_a.tolist(), at_b.tolist())) == [(0, 0), (1, 1), (1, 2), (2, 3)]
    assert group_a.tolist() == [0, 1, 2] and group_b.tolist() == [0, 1, 1, 2]


def test_alignment_of_an_empty_table(spark):
    assert A.align(spark.createDataFrame([], "doc_id long, text string"), *paths()).count() == 0


# Earlier operators, mended this round


def test_addresses_and_numbers_keep_apart():
    """A walk within its own set is one to one: every value of a small space, issued or not, has a surrogate of its own kind."""
    from plinth.llm.pii import Surrogates, _is_public, _may_be_issued

    make = Surrogates(b"key").makers
    rng = random.Random(4)
    addresses = sorted({".".join(map(str, (rng.choice([0, 10, 127, 224, 255, rng.randrange(256)]), *(rng.randrange(256) for _ in range(3))))) for _ in range(4000)} | {"139.134.86.73", "254.179.211.223"})
    number = lambda text: int.from_bytes(bytes(map(int, text.split("."))), "big")
    got = [make["ip"](a, 0) for a in addresses]
    assert len(set(got)) == len(addresses) and all(_is_public(number(a)) == _is_public(number(b)) for a, b in zip(addresses, got))
    numbers = sorted({f"{rng.choice(['000', '666', '002', '113', f'{rng.randrange(1000):03d}'])}-{rng.choice(['00', '56', f'{rng.randrange(100):02d}'])}-{rng.choice(['0000', f'{rng.randrange(10000):04d}'])}" for _ in range(4000)} | {"002-56-0228", "113-00-6654"})
    got = [make["ssn"](n, 0) for n in numbers]
    bare = lambda text: text.replace("-", "")
    assert len(set(got)) == len(numbers) and all(_may_be_issued(bare(a)) == _may_be_issued(bare(b)) for a, b in zip(numbers, got))


@pytest.mark.parametrize("name", ["Łukasz Nowak", "Šimon Dvořák", "Çelik Yılmaz", "Đorđe Petrović", "Ірина Шевченко", "Žofie Čapková"])
def test_names_of_more_letters_are_found(spark, name):
    from plinth.llm.pii import surrogate_documents

    docs = spark.createDataFrame([(1, f"We met Mr {name} there.")], "doc_id long, text string")
    out = surrogate_documents(docs).first()["text"]
    assert not any(part in out for part in name.split()) and out.startswith("We met Mr ") and out.endswith(" there.")


def test_vectors_without_an_id_stand_alone(spark):
    from plinth.llm.multi_index import near_vectors

    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None), (3, [1.0, 0.0]), (4, [1.0, 0.001])]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in got) == [(-1, 0, -1, True)] * 3 + [(3, 1, 3, True), (4, 1, 3, False)]


def test_sketches_of_long_texts_are_made_in_parts():
    from plinth.llm import minhash as M

    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n if n else None for n in (0, 5, 3, 3_000_000, 1, 1, 0)])], ["text"])
    assert [p.num_rows for p in M._parts(batch)] == [3, 1, 3]
    assert [p.num_rows for p in M._parts(pa.RecordBatch.from_arrays([pa.array(["a"] * 1000)], ["text"]))] == [400, 400, 200]


@pytest.mark.parametrize("page", [
    "<body><article class='legal'><p>{0}</p></article></body>",
    "<body><article><h1>Title</h1><section id='search'><p>{0}</p></section></article></body>",
    "<body><main class='search'><div class='legal'><p>{0}</p></div></main></body>",
    "<body><article><p class='byline'>By A. Writer, who reports from the coast for this paper</p><p>{0}</p></article></body>",
])
def test_articles_that_bear_a_doubtful_name_stay(page):
    from plinth.llm.html_text import main_text

    words = " ".join(f"word{i}" for i in range(80))
    text = main_text(page.format(words))
    assert words in text and ("byline" not in page or "By A. Writer" in text)


def test_feedback_of_readers_goes():
    from plinth.llm.html_text import main_text

    words, said = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "said"))
    assert main_text(f"<body><article><p>{words}</p><div class='reader-feedback'><p>{said}</p></div></article></body>") == words
