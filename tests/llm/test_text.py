"""Words, shingles and the operators on texts, against plain Python."""

import hashlib
import os
import random
import re
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import jaccard_join as J
from tidewater.llm import license_rules as L
from tidewater.llm import media_columns as M
from tidewater.llm import suffix_pieces as P
from tidewater.llm import textcore as tc

ALPHABET = st.text(alphabet=st.sampled_from(list("ab AB1.\n\té日▁!")), max_size=60)
UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


@given(st.lists(ALPHABET, min_size=1, max_size=8))
@settings(max_examples=60, deadline=None)
def test_words(texts):
    data, offs = tc.string_buffer(pa.array(texts))
    for kept, pattern in ((tc.SPACED, rb"[^\x20\x09-\x0D]+"), (tc.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = tc.words(data, offs, kept)
        for i, text in enumerate(texts):
            raw = text.encode().translate(UPPER)
            want = [(m.start() + offs[i], len(m[0]), tc.word_hash(m[0].decode("utf-8", "surrogateescape")) if m[0].isascii() else None) for m in re.finditer(pattern, raw)]
            s = slice(w.first[i], w.first[i + 1])
            assert [(a, b) for a, b, _ in want] == list(zip(w.start[s].tolist(), w.length[s].tolist(), strict=True))
            assert all(h is None or h == x for (_, _, h), x in zip(want, w.hash[s].tolist(), strict=True))


def test_windows(monkeypatch):
    text = ["ab " * 50 + "c" * 100, "", "d" * 30 + " e", None]
    whole = tc.words(*tc.string_buffer(pa.array(text)), tc.SPACED)
    monkeypatch.setattr(tc, "WINDOW", 16)
    small = tc.words(*tc.string_buffer(pa.array(text)), tc.SPACED)
    assert (whole.hash == small.hash).all() and (whole.start == small.start).all() and (whole.first == small.first).all()


def shingle_set(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(UPPER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(texts):
    """Brute force over all pairs."""
    sets = {i: shingle_set(t) for i, t in texts}
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sets, label


def mutated(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"w{rng.randrange(500)}"
    return out


@pytest.mark.parametrize("seen", [2, 32])
def test_near_duplicates(spark, monkeypatch, seen):
    """Families of copies with more and more changes, shared passages, short texts and ties."""
    monkeypatch.setattr(J, "SEEN", seen)
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(60)]
    texts, k = [], 0
    for family in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 9, 30, 120, 400]))]
        for copy in range(12):
            own = mutated(rng, base, rng.choice([0, 0, 1, 1, 2, 3, 5])) + (passage if rng.random() < 0.3 else [])
            texts.append((k, " ".join(own)))
            k += 1
    texts += [(k, "a b c d"), (k + 1, "A b C d"), (k + 2, "a b c d e"), (k + 3, ""), (k + 4, ""), (k + 5, None), (k + 6, "solo")]
    monkeypatch.setattr(J, "BLOCK", 16)
    monkeypatch.setattr(J, "STAR", 4)
    sets, label = components(texts)
    rows = J.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.component_id for r in rows} == label
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(s) for i, s in sets.items()}
    assert len(set(label.values())) < len(label) - 30


def test_frequent_elements_come_last():
    """Linked sets share one of their first elements, whichever elements are the frequent ones."""
    rng = np.random.default_rng(12)
    for n in (3, 9, 20, 60, 200, 900):
        s = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        for _ in range(8):
            out, new = rng.random(n) < 0.05, rng.integers(0, 1 << 64, n // 20, dtype=np.uint64)
            t = np.unique(np.concatenate([s[~out], new]))
            if not len(t) or not J.linked(J.overlap(s, t), len(s), len(t)):
                continue
            every = np.unique(np.concatenate([e for x in (s, t) for e, _ in J.all_elements(x)]))
            for share in (0, 0.3, 0.9, 1):
                common = np.sort(every[rng.random(len(every)) < share])
                a, b = J.elements(s, common), J.elements(t, common)
                assert np.isin(a, b).any() and len(a) == len(J.elements(s, common[:0]))
    passage = np.sort(rng.integers(0, 1 << 64, 300, dtype=np.uint64))
    own = [np.unique(np.concatenate([passage, rng.integers(0, 1 << 64, 300, dtype=np.uint64)])) for _ in range(50)]
    kinds, count = np.unique(np.concatenate([e for x in own for e, _ in J.all_elements(x)]), return_counts=True)
    assert not any(np.isin(J.elements(x, kinds[count > 10]), kinds[count > 10]).any() for x in own)
    assert sum(np.isin(J.elements(x, kinds[:0]), kinds[count > 10]).any() for x in own) > 25


def test_stars_equal_union_find(spark, monkeypatch):
    from tidewater.llm import components as C

    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(220)], "a long, b long")
    one = {tuple(r) for r in C.connected(edges).collect()}
    monkeypatch.setattr(C, "ONE_TASK_EDGES", 0)
    many = {tuple(r) for r in C.connected(edges).collect()}
    alone = {(n, label) for n, label in one if n == label} - many
    assert many <= one and all(label == n for n, label in alone)


def test_tree_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(1 << 30, n, replace=False).astype(np.uint64)) for n in rng.integers(1, 300, 80)]
    sets += [np.sort(np.concatenate([s[: max(1, int(len(s) * 0.95))], rng.choice(1 << 30, 2).astype(np.uint64)])) for s in sets]
    points = np.stack([J.folded(J.point(s), J.DIMS) for s in sets])
    tree = J.CountRTree(points)
    for i, s in enumerate(sets):
        found = set(tree.search(points[i]).tolist())
        assert {j for j, t in enumerate(sets) if J.linked(J.overlap(s, t), len(s), len(t))} <= found
        assert all(J.may_be_linked(J.point(s), J.point(sets[j])) for j in range(len(sets)) if J.linked(J.overlap(s, sets[j]), len(s), len(sets[j])))


needs_model = pytest.mark.skipif(not os.path.exists(P.MODEL), reason="no model file")


@needs_model
@given(st.lists(st.text(alphabet=st.sampled_from(list("abcdethingo   ABC.,!\n\t1é日本\U0001f600 ")), max_size=80), min_size=1, max_size=5))
@settings(max_examples=80, deadline=None)
def test_pieces_equal_the_library(texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    own = P.encoder(Path(P.MODEL).read_bytes())
    for a, b, ids, first, _, _ in own.encode(pa.array(texts)):
        for i in range(a, b):
            mine = ids[first[i - a] : first[i - a + 1]]
            assert mine.tolist() == library.encode(texts[i])
            assert own.decode(mine).tobytes().decode()[1:] == texts[i]


@needs_model
def test_long_stretches_equal_the_library():
    """Prose without spaces goes through the array, and what is longer through the merges."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(4)
    texts = ["".join(rng.choice("日本語の文章はthe国人大和") for _ in range(n)) for n in (10, 100, 400, 900)] + ["x" * 3000 + "theend", "ab" * 700]
    for a, b, ids, first, _, _ in P.encoder(Path(P.MODEL).read_bytes()).encode(pa.array(texts)):
        for i in range(a, b):
            assert ids[first[i - a] : first[i - a + 1]].tolist() == library.encode(texts[i])


@needs_model
def test_encode_and_decode(spark, odd):
    encoded = P.encode(odd.where("doc_id not in (2, 10)"))
    back = {r.doc_id: r.text for r in P.decode(encoded).collect()}
    assert back == {r.doc_id: r.text or "" for r in odd.where("doc_id not in (2, 10)").collect()}
    with_ids = P.encoded_digests(odd, with_ids=True)
    assert with_ids.columns[-1] == "ids" and all(len(r.ids) == r.n_pieces for r in with_ids.collect())
    flags = {r.doc_id: r.round_trip for r in P.encoded_digests(odd).collect()}
    assert flags.pop(10) is False and all(flags.values())


@given(st.lists(st.sampled_from(["under", "the", "MIT", "license", "Apache", "version", "2", "cc", "by", "nc", "x", "-", "é"]), max_size=40))
@settings(max_examples=60, deadline=None)
def test_base_places(parts):
    text = " ".join(parts)
    ws = [w.decode() for w in L._WORDS.findall(text.encode().translate(UPPER))]
    want = sorted((i, label) for phrase, label in L.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())
    row = next(L._scan(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]))).to_pylist()[0]
    assert (row["n_words"], row["n_base"], row["base_labels"]) == (len(ws), len(want), ",".join(sorted({x for _, x in want})))
    assert (row["first_word"], row["last_word"]) == ((want[0][0], want[-1][0]) if want else (None, None))
    assert {x for _, x in want} <= set(row["labels"].split(",")) | {""} and 0 <= row["score"] <= 1


def labels_of(text):
    return {r.label for _, _, r in L.matches(text.lower().encode())}


def test_license_rules():
    assert len(L.RULES) > 400 and len(L.SIGNATURES) > 120
    assert labels_of("SPDX-License-Identifier: GPL-3.0") == {"gpl-3"}
    assert labels_of("SPDX-License-Identifier: MIT OR Apache-2.0") == {"mit", "apache-2"}
    assert labels_of("Licensed under the Apache License, Version 2.0") == {"apache-2"}
    assert labels_of("Licensed under MIT-0.") == {"mit-0"} and labels_of("released under MPL 2.0") == {"mpl-2"}
    assert labels_of("cc by-nc-sa 4.0") == {"cc-by-nc-sa"}
    assert labels_of("Redistribution and use in source and binary forms, with or without modification, are permitted") == {"bsd-2"}
    assert labels_of("he sat mit freunden by the sea") == set()
    for rule_text in ("agpl v3", "licensed under the unlicense", "public domain dedication", "all rights reserved", "open rail m", "cc0 1.0", "copyright 2020", "released under ISC"):
        assert gated(rule_text) and labels_of(rule_text)


def gated(text):
    w = tc.words(*tc.string_buffer(pa.array([text])), tc.ALNUM)
    return L._gated(w.hash, np.zeros(len(w.hash), np.int64)) == {0}


@pytest.mark.parametrize(("label", "spdx"), [(k, v.split("|")[0]) for k, v in L.IDS.items()])
def test_spdx_lines(label, spdx):
    spdx = re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"\(\?:(\w+).*", r"\1", spdx)).replace("?", "").replace("20[0-9]{2}", "2016")
    assert label in labels_of(f"SPDX-License-Identifier: {spdx.replace(' ', '-')}") and label in labels_of(f"It is licensed under {spdx}, so")


def test_signatures_hold_their_keyword_and_gate():
    """Every signature's own words, with its options left out, match it behind the prefilter and the gate."""
    for label, _, pattern, _ in L.SIGNATURES:
        text = re.sub(r"\(\?:([^|()]*)(?:\|[^()]*)?\)(?!\?|\*)", r"\1", re.sub(r"\(\?:[^()]*\)[?*]", "", re.sub(r"\(\?:[^()]*\)[?*]", "", pattern)))
        text = re.sub(r"\.\{0,\d+\}\?", "xx ", text).replace("licen[cs]e", "license").replace("[0-9]{2}", "20").replace("[sz]", "s")
        text = re.sub(r"\[(.)[^]]*\]", r"\1", text).replace("e?", "e").replace(" ?", " ")
        assert label in labels_of(text), (label, text)
        assert gated(text), text


@given(st.lists(st.sampled_from("spdx license identifier mit mit 0 or apache 2 0 licensed under the gnu general public license version 2 lgpl cc by nc sa 4 0 all rights reserved public domain x".split()), max_size=40))
@settings(max_examples=80, deadline=None)
def test_labels_equal_brute_force(words):
    """All rules without prefilter or gate, and suppression by comparing all intervals."""
    joined = f" {' '.join(words)} ".encode()
    found = [(*m.span(r.group), r) for r in L.RULES for m in r.pattern.finditer(joined)]
    standing = []
    for a, b, r in sorted(found, key=lambda x: (x[2].priority, x[0] - x[1], x[0])):
        if not any(x <= a and b <= y for x, y, _ in standing):
            standing.append((a, b, r))
    want = [(joined.count(b" ", 0, a) - 1, joined.count(b" ", 0, b), r.label) for a, b, r in standing]
    assert [(a, b, r.label) for a, b, r in L.matches(" ".join(words).encode())] == want


def test_many_matches_are_linear():
    import time

    began = time.perf_counter()
    assert len(L.matches(b"licensed under the apache license version 2 0 and cc by nc " * 20_000)) == 40_000
    assert time.perf_counter() - began < 20


def test_images():
    rng = np.random.default_rng(0)
    grey, colour = rng.integers(0, 256, (37, 24), dtype=np.uint8), rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    for x in (grey, colour):
        assert (M.decode(M.encode_bmp(x)) == x).all() and (M.decode(M.encode_netpbm(x)) == x).all()
    assert M.decode(b"P2 # note\n2 2\n15\n0 15 5 10").tolist() == [[0, 255], [85, 170]]
    assert M.decode(b"P1\n3 1\n101").tolist() == [[0, 255, 0]] and M.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    big = np.kron(grey.astype(float), np.ones((8, 9))).reshape(8, 37, 9, 24).mean((1, 3))
    assert np.abs(M.area_resize(grey, 8, 9) - big).max() < 1e-9
    for bad in (b"", b"P5\n2 2\n255\nabc", b"BM" + bytes(60), b"P9"):
        with pytest.raises((ValueError, IndexError)):
            M.decode(bad)
    tile = np.load(__import__("io").BytesIO(M.npy_tile(grey)))
    assert tile.shape == (8, 8) and tile.dtype == np.uint8


def test_strips(monkeypatch):
    image = np.random.default_rng(1).integers(0, 256, (100, 24), dtype=np.uint8)
    whole = M.area_resize(image, 8, 9)
    monkeypatch.setattr(M, "STRIP", 7)
    assert np.abs(M.area_resize(image, 8, 9) - whole).max() < 1e-9


def exact_cells(image, rows, columns):
    """Area means by exact fractions of pixels."""
    high, wide = len(image), len(image[0])

    def shares(cells, size):
        out = []
        for k in range(cells):
            low, top = Fraction(k * size, cells), Fraction((k + 1) * size, cells)
            out.append([(i, min(top, i + 1) - max(low, i)) for i in range(int(low), min(size, int(top) + 1)) if min(top, i + 1) > max(low, i)])
        return out

    area = Fraction(high, rows) * Fraction(wide, columns)
    return [[sum(p * q * int(image[i][j]) for i, p in ys for j, q in xs) / area for xs in shares(columns, wide)] for ys in shares(rows, high)]


def test_reductions_equal_fractions():
    rng = np.random.default_rng(2)
    for shape in ((24, 24), (7, 24), (50, 13)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        cells = exact_cells(image.tolist(), 8, 9)
        assert np.abs(M.area_resize(image, 8, 9) - np.array(cells, float)).max() < 1e-9
        small = [[int(x * 256 + Fraction(1, 2)) for x in row] for row in cells]
        bits = "".join("1" if a > b else "0" for row in small for a, b in zip(row, row[1:]))
        assert M.difference_hash(image) == int(bits, 2)
    colour = rng.integers(0, 256, (19, 11, 3), dtype=np.uint8)
    tile = np.load(__import__("io").BytesIO(M.npy_tile(colour)))
    assert tile.shape == (8, 8, 3) and all((np.abs(tile[..., c] - np.array(exact_cells(colour[..., c].tolist(), 8, 8), float)) <= 0.5 + 1e-9).all() for c in range(3))
    assert M.difference_hash(np.repeat(image[..., None], 3, 2)) == M.difference_hash(image)


@pytest.mark.parametrize("form", ["pgm", "bmp", "auto"])
def test_text_images(odd, form):
    texts = {r.doc_id: r.text for r in odd.collect()}
    kinds = set()
    for r in M.text_images(odd, form).collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        rows = np.frombuffer(payload, np.uint8).reshape(-1, 24)
        pgm = b"P5\n24 %d\n255\n" % len(rows) + payload
        kinds.add(r.media_sha256 == hashlib.sha256(pgm).hexdigest())
        assert r.media_bytes == len(pgm) if kinds == {True} and form == "pgm" else r.media_bytes >= len(payload)
        assert np.load(__import__("io").BytesIO(r.tile)).shape == (8, 8)
        if len(rows) < 500:
            cells = exact_cells(rows.tolist(), 8, 9)
            small = [[int(x * 256 + Fraction(1, 2)) for x in row] for row in cells]
            assert r.feature == f"{int(''.join('1' if a > b else '0' for row in small for a, b in zip(row, row[1:])), 2):016x}"
    assert kinds == {"pgm": {True}, "bmp": {False}, "auto": {True, False}}[form]
