"""Collocations and hard negatives against their DuckDB SQL and plain versions, piece encoding against the library."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import sentencepiece

from marlstone.llm import collocations as co
from marlstone.llm import hard_negatives as hn
from marlstone.llm import pieces as pc
from marlstone.llm import queries

from ..oracle import duck, rows

SF = "/root/testdata/sf0.001"
IDS = [2**53 + 1, 2**63 - 1, None, -7, 0]


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_hard_negatives"])
def test_matches_duckdb(spark, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck(queries.ORACLES[name], SF)
    assert len(want) and rows(got) == rows(want)


def plain_phrases(docs, minimum, top):
    """Phrases by counting all of them."""
    import re

    f, n, found = Counter(), Counter(), {}
    for text, lang in docs:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= minimum}
    for p, a in candidates.items():
        inside = any(q[0] == p[0] and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p) - 1] == p[1:] for i in range(1, len(q) - len(p) + 2)) for q, b in candidates.items())
        if not inside:
            cuts = [(2_000_000 * a // (f[p[: 1 + c]] + f[(p[0], *p[1 + c :])]), c) for c in range(1, len(p) - 1)]
            score, c = min(cuts)
            found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), f[p[: 1 + c]], f[(p[0], *p[1 + c :])]))
    return sorted((lang, i, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, every in found.items() for i, x in enumerate(sorted(every)[:top], 1))


@pytest.mark.parametrize("chunk", [7, 50, 2_000_000])
def test_collocations_against_counting(spark, chunk):
    r = random.Random(3)
    texts = [("".join(r.choice(["a", "B", "c é", " ", " ", "\t", ".", "\n", "ab ab ab", "x\x0by", "\x00", "\xa0"]) for _ in range(r.randint(0, 120))), r.choice(["en", None, "und", "fr"])) for _ in range(60)]
    texts += [(None, "en"), ("", None), (" . \n", "fr"), ("a b " * 200, "en"), ("a b " * 200, "en")]
    docs = spark.createDataFrame([(i, t, x, 1) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string, rank int")
    got = co.collocations(docs, minimum=4, top=12, chunk=chunk).collect()
    assert sorted(map(tuple, got)) == plain_phrases(texts, 4, 12)
    assert co.collocations(docs.limit(0), minimum=1).count() == 0


def test_rounds_leave_no_tables_and_lists_follow_from_names(spark):
    from marlstone.session import shared_dir

    left = lambda: {n for n in os.listdir(shared_dir(spark)) if n.split("-")[0] in ("words", "pairs", "phrases")}
    before = left()
    assert co.collocations(spark.createDataFrame([("a b c d " * 40, "en")], "text string, lang string"), minimum=4).count() > 0
    assert left() == before
    seq = np.random.default_rng(2).integers(-1, 9, 400)
    for high in (1, 2**40):  # names of any size
        both, own, left_name, right, bucket = co._listed(np.where(seq < 0, -1, seq * high), 5)
        assert (np.diff(bucket) >= 0).all() and len(set(zip(left_name, right))) == len(left_name)
        assert (left_name[own] == seq[:-1][both] * high).all() and (right[own] == seq[1:][both] * high).all()
    assert not co._listed(seq[:0], 5)[0].any() and not co._listed(seq[:1], 5)[0].any()


def plain_negatives(data):
    vs = []
    for key, (i, v, label) in enumerate(data):
        if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vs.append((key, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [int(np.floor(256 * float(x))) for x in v]))
    vs = [x for x in vs if sum(q * q for q in x[3]) < 2**62]
    out = []
    for a in vs:
        if a[1] is None or a[1] % 100:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(a[3], b[3], strict=True)), b[1] is None, b[1] or 0, b[2]) for b in vs if b[0] != a[0] and len(b[3]) == len(a[3])))
        for p, null, pid, label in [x for x in ranked if x[3] == a[2]][:5]:
            fits = [x for x in ranked if x[3] != a[2] and 30 * -p <= 100 * -x[0] <= 90 * -p]
            out += [(a[1], None if null else pid, i, None if x[1] else x[2], -p, -x[0]) for i, x in enumerate(fits[:10], 1)]
    return sorted(out, key=repr)


def test_hard_negatives_against_plain_search(spark, monkeypatch):
    r = random.Random(4)
    data = []
    for i in range(400):
        scale = r.choice([0.5, 1.0, 3.0, 1e6])
        v = [float(np.float32(r.gauss(0.3, 1) * scale)) for _ in range(r.choice([4, 4, 4, 3]))]
        data.append((r.choice([i, i, i, 100 * (i % 5), None]), v, r.choice([0, 0, 0, 1, 9])))
    data += [(500, None, 1), (600, [1.0, None, 1.0, 1.0], 1), (700, [1.0, float("nan"), 1.0, 1.0], 1), (800, [1.0, float("inf"), 0.0, 0.0], 1), (900, [1.0] * 4, None), (1000, [], 1), (1100, [1e30] * 4, 1)]
    data += [(2**53 + 1, [1.0] * 4, 1), (1200, [1.0] * 4, 1), (1200, [1.0] * 4, 1), (1300, [0.0] * 4, 0)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").coalesce(1)
    for size in (16, 2048):
        monkeypatch.setattr(hn, "BUCKET", size)
        got = sorted(map(tuple, hn.hard_negatives(table).collect()), key=repr)
        assert got == plain_negatives(data)
    assert hn.hard_negatives(table.limit(0)).count() == 0


def test_buckets_are_pruned():
    one = hn._Seekers([(1, 0, [1.0, 0.0], 1.0, [(1, 5, 100)])], same=False, k=1)
    ids, labels = np.array([7]), np.array([1])
    assert one.meet(100.0, ids, ids, labels, np.array([[10.0, 0.0]])) and one.worst[0] == 10
    assert not one.meet(64.0, ids, ids, labels, np.array([[8.0, 0.0]]))  # below the running best
    assert not hn._Seekers([(1, 0, [1.0, 0.0], 1.0, [(1, 5, 100)])], same=False, k=1).meet(9.0, ids, ids, labels, np.array([[3.0, 0.0]]))  # below the window


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pc.default_model())


def test_pieces_equal_the_library(library):
    model, r = pc.PieceModel(pc.default_model()), random.Random(5)
    kinds = ["abcdefghijklmnopqrstuvwxyz", " a", "  \n\t", "éàüñç", "한국어", "日本語の", "▁x", "0123456789", "<s></s><0x41>", "\x00�🙂é̈", "eorst"]
    words = [library.id_to_piece(i).replace(pc.SPACE, " ") for i in range(300, 32000)]
    for _ in range(6000):
        some = kinds[: r.randint(1, len(kinds))]
        for text in ("".join(r.choice(r.choice(some)) for _ in range(r.randint(0, 40))), "".join(r.choice(words) for _ in range(r.randint(1, 6)))):
            assert model.encode(text).tolist() == library.encode(text), text


def test_pieces_of_long_texts_and_forgotten_words(library, monkeypatch):
    monkeypatch.setattr(pc, "WINDOW", 50)
    monkeypatch.setattr(pc, "REMEMBERED", 5)
    model, r = pc.PieceModel(pc.default_model()), random.Random(6)
    for text in ("a" * 20_000, " " * 5000, "\n" * 300, " ".join("".join(r.choice("ab\nc  ") for _ in range(r.randint(0, 30))) for _ in range(2000))):
        assert model.encode(text).tolist() == library.encode(text)


def test_piece_digests(spark, library, monkeypatch):
    monkeypatch.setattr(pc, "OUT", 10)
    texts = ["one two", None, "", "ein  Zwei\n\x00 ▁drei 🙂", " x"]
    docs = spark.createDataFrame([(i, t, "z", 3) for i, t in zip(IDS, texts, strict=True)], "doc_id long, text string, ids string, n_tokens int")
    want = []
    for i, text in zip(IDS, texts, strict=True):
        ids = library.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, pc.piece_digests(docs).collect()), key=repr) == sorted(want, key=repr)
    assert pc.piece_digests(docs.limit(0)).count() == 0
    decoded = pc.decode_pieces(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"))
    assert [tuple(x) for x in decoded.orderBy("doc_id").collect()] == [(1, ""), (2, "")]


def test_whole_table_equals_the_library(spark, library):
    got = queries.op13_sentencepiece(spark, SF).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").sort_index()
    ids = [library.encode(t or "") for t in docs["text"]]
    want = pd.DataFrame({"n_tokens": [len(x) for x in ids], "ids_sha256": [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids]}, index=docs.index)
    pd.testing.assert_frame_equal(got[["n_tokens", "ids_sha256"]], want)
