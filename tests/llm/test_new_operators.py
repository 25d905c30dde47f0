"""Byte-level BPE, vector codes and the Merkle manifest against plain versions of themselves."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from inkspan.llm import byte_bpe, exact_dedup, merkle, pii, vector_codes
from inkspan.llm.words import tokenizer_path

RANKS = tokenizer_path("byte_bpe_50k.tiktoken")
ODD = [
    None, "", " ", "  ", "\n", " \n", "a", " a", "  a", "\n a", "a \n\n b", "it's 'sun' 'really x'll x''s 's's's !'s \n's 't9 '", "don't we've I'm he'd they'll you're", "'r", "'v", "'re", "'l", "'ll'", "'S 'RE",
    "x1y2 12 ½ٓ٣ ²³", "日本語のテキスト 。、！", "emoji 👩‍👩‍👧 🇺🇦 é é", " a 　b  c \u0085d", "﻿a​b", "a" * 5000, "ab" * 3000 + "!" * 3000, " " * 4000 + "x", "\x1c\x1d\x00 z\x7f",
]


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def random_texts(n, seed=5):
    rng = random.Random(seed)
    signs = "''''stmdrevl aLЖ日é1½٣!?.\n\t  　🇺" + "   "
    return ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_ids_are_the_librarys(library):
    texts = ODD + random_texts(3000)
    ids, ends = byte_bpe.encode_batch(pa.array(texts, pa.string()), RANKS)
    for t, i, e in zip(texts, ids, ends):
        assert i.tolist() == library.encode_ordinary(t or ""), t
        assert (e[-1] if len(e) else 0) == len((t or "").encode())
    # in pieces, some of which end within a text
    small, _ = byte_bpe.encode_batch(pa.array(texts, pa.string()), RANKS, most=40)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(ids, small))


def test_every_character_is_in_the_librarys_class(library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["x ".join(every[k : k + 512]) for k in range(0, len(every), 512)]
    ids, _ = byte_bpe.encode_batch(pa.array(texts, pa.string()), RANKS)
    assert all(a.tolist() == b for a, b in zip(ids, library.encode_ordinary_batch(texts)))


def test_functions_compose_in_any_grouping():
    rng = np.random.default_rng(1)
    syms = rng.integers(0, 10, 1000).astype(np.uint8)
    step, begins = byte_bpe.automaton()
    state, expected = byte_bpe.FRESH, []
    for s in syms:
        expected.append(begins[s, state])
        state = step[s, state]
    assert byte_bpe.boundaries(syms).tolist() == expected


def test_long_slices_are_merged_alike():
    m = byte_bpe.merger(RANKS)
    rng = random.Random(3)
    for _ in range(200):
        word = bytes(rng.choice(b"aeinorst'") for _ in range(rng.randrange(2, 90)))
        assert m._plain(word) == m._heap(word)


def test_bpe_round_trip(spark, library):
    rows = [(k, t, "x") for k, t in enumerate(ODD)] + [(3, "twice", "y"), (3, "twice", "y"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = byte_bpe.bpe_round_trip(docs, RANKS).collect()
    texts = [t or "" for _, t, _ in rows]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((len(i), sha(" ".join(map(str, i))), sha(t)) for t in texts for i in [library.encode_ordinary(t)])
    assert byte_bpe.bpe_round_trip(docs.limit(0), RANKS).count() == 0
    named = docs.withColumnRenamed("doc_id", "a.b").withColumnRenamed("text", "c.d")
    assert byte_bpe.bpe_round_trip(named, RANKS, "a.b", "c.d").count() == len(rows)
    kept = byte_bpe.decode(byte_bpe.encode(docs, RANKS).withColumnRenamed("ends", "decoded"), RANKS)
    assert kept.columns == ["doc_id", "ids", "decoded", "decoded_"]


def made_words(n, seed=9):
    """Distinct slices that no rank has whole, none of them long."""
    rng = random.Random(seed)
    ends = ["en", "tion", "é", "ß", "ñ", "er", "日", "x", "sch", "qu", "ing", "'", "0"]
    return sorted({" " + "".join(rng.choice(ends) for _ in range(rng.randrange(5, 12))).replace("'", "") for _ in range(n)})


def test_new_slices_are_merged_together(library, monkeypatch):
    """They were merged one by one, which took most of the time on texts of many different words."""
    words = [w for w in made_words(4000) if len(w.encode()) < byte_bpe.HEAP_FROM]
    texts = ["".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    alone = []
    plain = byte_bpe.Merger._plain
    monkeypatch.setattr(byte_bpe.Merger, "_plain", lambda self, word: alone.append(word) or plain(self, word))
    byte_bpe.merger.cache_clear()
    ids, _ = byte_bpe.encode_batch(pa.array(texts, pa.string()), RANKS)
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in texts]
    assert len(alone) < byte_bpe.FEW


def test_slices_of_every_length_are_learnt_alike(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "TOGETHER", 100)
    rng = random.Random(4)
    slices = list({bytes(rng.choice(b"aeinorst'\x00\xff\xc3") for _ in range(rng.randrange(1, 120))) for _ in range(800)})
    for some in (slices, slices[:5], []):
        m = byte_bpe.Merger(RANKS)
        for _ in range(2):  # new, and kept but for the long ones
            flat, lengths = m.ids(some)
            got = [x.tolist() for x in np.split(flat, np.cumsum(lengths)[:-1])] if some else []
            assert got == [[m.ranks[w]] if w in m.ranks else m._heap(w) for w in some]
        assert all(len(w) <= byte_bpe.LONGEST for w in m.kept.at)


def test_a_full_cache_is_emptied(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MOST", 50)
    byte_bpe.merger.cache_clear()
    texts = random_texts(300, seed=8) + ["one " * 30, None, "日本 語 " * 20]
    ids, _ = byte_bpe.encode_batch(pa.array(texts, pa.string()), RANKS, most=400)
    assert 0 < len(byte_bpe.merger(RANKS).kept.at) <= 50
    assert all(i.tolist() == library.encode_ordinary(t or "") for t, i in zip(texts, ids))
    byte_bpe.merger.cache_clear()


def test_decoded_lists_may_be_null_or_cut(library):
    texts = ["a few words", None, "", "日本 é", "the end"]
    ids = [None if t is None else library.encode_ordinary(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])
    for a, n in ((0, 5), (1, 3), (1, 2), (4, 1), (2, 0)):
        (got,) = byte_bpe._decode(iter([batch.slice(a, n)]), RANKS, 1)
        assert got.column(2).to_pylist() == [(t or "").encode() for t in texts[a : a + n]]


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract, pair by pair."""
    kept = [(i, [int(np.floor(256 * np.float64(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(kept[0][1]) // parts
    kept = [k for k in kept if len(k[1]) == size * parts]
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    near = lambda v, p: min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        own = {}
        for _, v, _ in kept:
            for p in range(parts):
                own.setdefault((p, near(v, p)[1]), []).append(cut(v, p))
        for (p, k), vs in own.items():
            books[p][k] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, "".join(f"{near(v, p)[1]:02x}" for p in range(parts)), sum(near(v, p)[0] for p in range(parts)), lab) for i, v, lab in kept]
    by = {}
    for *_, e, lab in out:
        by[lab] = by.get(lab, 0) + e
    digest = sha(",".join(str(x) for b in books for e in b for x in e))
    return [(i, c, e, by[lab], digest) for i, c, e, lab in out]


SCHEMA = "vec_id long, embedding array<float>, label int, code string, v string"


def test_vector_codes_against_all_distances(spark):
    rng = np.random.default_rng(2)
    ok = [(int(k), rng.normal(size=32).astype(np.float32).tolist(), None if k % 5 == 0 else int(k % 3), "c", "v") for k in rng.permutation(400)]
    odd = [(1000, None, 1, "", ""), (1001, [], 1, "", ""), (1002, [None] * 32, 1, "", ""), (1003, [float("nan")] * 32, 1, "", ""), (1004, [float("inf")] + [0.0] * 31, 1, "", ""), (1005, [1.0] * 16, 1, "", ""), (None, [0.5] * 32, None, "", ""), (-5, [1e30] + [0.0] * 31, 7, "", "")]
    rows = ok + ok[:40] + odd
    got = vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect()
    held = [(i, v if v is None else [min(x, 2.0**18) if x is not None and np.isfinite(x) else x for x in v], lab) for i, v, lab, *_ in rows]
    expected = plain_codes(held)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, got)) == sorted(map(key, expected))


def test_few_and_no_vectors(spark):
    few = [(k, [float(k)] * 16, 1, "", "") for k in (3, 1, 1)]
    got = vector_codes.vector_codes(spark.createDataFrame(few, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_codes([r[:3] for r in few])))
    for rows in ([], [(1, [1.0] * 15, 1, "", "")]):
        assert vector_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_va_file_bounds_hold_and_select():
    rng = np.random.default_rng(4)
    e, q = rng.integers(-300, 300, (64, 4)), rng.integers(-400, 400, (500, 4))
    d = ((q[:, None, :] - e[None]) ** 2).sum(axis=2)
    f = vector_codes.VAFile(e)
    lower, upper = f.bounds(q)
    assert (lower <= d).all() and (d <= upper).all()
    assert (lower <= upper.min(axis=1)[:, None]).mean() < 0.25  # few entries are left to refine
    ties = vector_codes.VAFile(np.repeat(e[:8], 2, axis=0)).nearest(q)
    assert (ties[0] % 2 == 0).all() and (ties[1] == d[:, :8].min(axis=1)).all()
    assert (f.nearest(q)[0] == d.argmin(axis=1)).all()


def plain_proofs(rows, fanout=3):
    h = lambda *x: sha("".join(x))
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: h(*map(field, r[:5]))

    def tree(nodes):
        """(root, per node the list of (left, right))"""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, a in enumerate(at):
                run = nodes[a // fanout * fanout : a // fanout * fanout + fanout]
                paths[k].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
            nodes, at = [h(*nodes[a : a + fanout]) for a in range(0, len(nodes), fanout)], [a // fanout for a in at]
        return nodes[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        low[g] = tree([leaf(r) for r in groups[g]])
    root, high = tree([low[g][0] for g in order])
    out = []
    for g, top in zip(order, high):
        for r, path in zip(groups[g], low[g][1]):
            full = path + top
            text = r[4]
            if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            f = leaf((*r[:4], text))
            for a, b in full:
                f = h(a, f, b)
            out.append((r[0], leaf(r), low[g][0], root, h(*[a + b for a, b in full]), f, f == root))
    return out


DOCS = "doc_id long, source string, lang string, n_chars int, text string, leaf string, n string"


def test_merkle_against_a_plain_tree(spark):
    rng = random.Random(9)
    sources = [None, "", "a", "é", "z", "hot"]
    rows = [(k, "hot" if k % 3 == 0 else rng.choice(sources), rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "line\nline", "é\n", "plain"]), "x", "y") for k in range(120)]
    rows += rows[:7] + [(5, "hot", None, 1, "other", "", ""), (None, "hot", "en", 1, "no\nid", "", ""), (500, "alone", "en", 1, "one\n" * 9000, "", "")]
    got = merkle.proofs(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_proofs(rows)))
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4])
def test_small_trees(spark, n):
    rows = [(k, "s", "en", 1, "a\nb", "", "") for k in range(n)]
    got = merkle.proofs(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain_proofs(rows) if rows else []))


def test_which_of_equal_rows_stays(spark):
    rows = [(1, "Same" if k % 2 else "same", k, {"a": k}) for k in (5, 3, 9, 4)] + [(1, "same", None, None), (0, "same", 0, None), (2, "other", 2, {}), (None, "other", 1, {})]
    docs = spark.createDataFrame(rows, "doc_id int, text string, src int, m map<string,int>").repartition(7)
    kept = sorted((r.doc_id, r.text, r.src) for r in exact_dedup.drop_copies(docs).collect())
    assert kept == [(1, "Same", 3), (2, "other", 2)]
    counts = exact_dedup.exact_dedup(docs, salts=2).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size) for r in counts if r.doc_id != 1) == [(False, 0, 1, 6), (False, 2, 2, 2), (True, None, 2, 2)]
    assert [(r.doc_id, r.keep_id, r.group_size) for r in counts if r.doc_id == 1] == [(1, 1, 6)] * 5 and sum(r.kept for r in counts) == 2


def test_masked_addresses_of_any_length():
    import time

    name, host = "long.name-" * 13 + "x", "sub-domain" * 9
    text = f"please contact {name} [at] {host} (dot) example (dot) a (dot) b (dot) c.org. Or not"
    assert [text[a:b] for kind, a, b in pii.candidates(text) if kind == "email_masked"] == [text[15 : -len(". Or not")]]
    began = time.time()
    assert not [c for c in pii.candidates("a." * 200_000 + " (at) " + "b-" * 200_000) if c[0] == "email_masked"] and time.time() - began < 20
