"""Packing: ids against the tokenizer, pieces against their definition, the curve against its neighbours."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reliefgrid.llm import packing
from reliefgrid.llm.queries import QUERIES
from reliefgrid.runtime import local_table

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, n long, row string"
ODD = [
    "a\x0bb c\x0cd\x1c e f ́g", "<|endoftext|> x<|startoftext|>y < |endoftext|>", "<|STARTOFTEXT|> A", "I'll don't 's a' s", "é́ é ́", "x" * 200 + " " + "y" * 100 + " z",
    "", " ", "\n\n a", "ΑΣ ΣΑΣ σς", "​ a﻿ b", "ﬁ İ ß", "A. b, C.. d., .e e. \n", "É. İ Ǩ", "1. 22, 333; a1. Z9!", "他们在河边走。 x", "ab.", "ab. ", ". , ; a.b c.",
]


def check_pieces(rows, docs, tokenizer, capacity):
    """Every id of every document in one piece, sequences without holes, little padding."""
    want = defaultdict(list)
    for i, t in docs:
        want[i].append(tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END])
    ids = lambda r: np.frombuffer(bytes(r.ids), "<u2" if len(r.ids) == 2 * r.length else "<u4").tolist()
    per = defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids(r), "<u4").tobytes()) and 0 < r.length <= capacity
        per[r.doc_id].append(r)
    for i, whole in want.items():
        pieces = defaultdict(list)
        for r in per[i]:
            pieces[r.start].append(r)
        got, bag = [], sorted(per[i], key=lambda r: r.start)
        for first in [r for r in bag if r.start == 0]:
            doc, have = [first], first.length
            while have < first.doc_tokens:
                nxt = next(r for r in pieces[have] if r.doc_tokens == first.doc_tokens and r.sequence_id == doc[-1].sequence_id + 1)
                doc.append(nxt)
                have += nxt.length
            got.append([x for r in doc for x in ids(r)])
        assert sorted(got) == sorted(whole)
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for k, v in seqs.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == capacity or at & (at - 1) == 0


def test_word_ids_are_the_tokenizers():
    rnd = random.Random(3)
    words, t = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    texts = ODD + ["".join(rnd.choices("abcAB .,;'!\n\té1 ß-", k=rnd.randint(0, 80))) for _ in range(400)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [a.tolist() for a in words.ids(texts)] == want
    assert [words.ids([x])[0].tolist() for x in texts[:60]] == want[:60] and words.ids([]) == []


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    rnd = random.Random(4)
    words, t = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choices("abcde", k=5)) for _ in range(30)) for _ in range(2)]
        assert [a.tolist() for a in words.ids(texts)] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert len(words.known) <= 60


@pytest.mark.parametrize("capacity", [64, 4096])
def test_pieces(spark, capacity):
    rnd = random.Random(5)
    docs = [(k, " ".join("".join(rnd.choices("abcdefg", k=rnd.randint(1, 9))) for _ in range(rnd.choice([0, 1, 5, 60, 400])))) for k in range(80)]
    docs += [(200 + k, t) for k, t in enumerate(ODD)] + [(None, None), (None, "no id"), (300, "copy of " * 30), (300, "copy of " * 30), (301, "copy of " * 30)]
    frame = local_table(spark, [(i, t, 5, "x") for i, t in docs], SCHEMA).repartition(5)
    check_pieces(packing.packed(frame, PATH, capacity).collect(), docs, Tokenizer.from_file(PATH), capacity)
    assert packing.packed(frame.limit(0), PATH, capacity).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_curve_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    t = Tokenizer.from_file(PATH)
    total = sum(len(t.encode(d.text or "", add_special_tokens=False).ids) + 1 for d in docs)
    assert sum(r.length for r in rows) == total and {r.doc_id for r in rows} == {d.doc_id for d in docs}
    assert max(r.sequence_id for r in rows) + 1 == total // 4096 + bin(total % 4096).count("1")


@pytest.mark.parametrize("dims,bits", [(2, 5), (3, 3), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    grid = np.stack([x.ravel() for x in np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")], 1)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys) == list(range(1 << bits * dims))
    assert (np.abs(np.diff(grid[keys.argsort()], axis=0)).sum(1) == 1).all()


def test_neighbours_are_alike(spark):
    """Documents of two vocabularies: along the curve they stand with their own kind."""
    rnd = random.Random(7)
    words = [["".join(rnd.choices(letters, k=6)) for _ in range(30)] for letters in ("abcdef", "uvwxyz")]
    docs = [(k, " ".join(rnd.choices(words[k % 2], k=120))) for k in range(200)]
    ids = packing.encoded(local_table(spark, [(i, t, 0, "") for i, t in docs], SCHEMA).repartition(3), PATH)
    order = [r.doc_id % 2 for r in ids.orderBy("key").collect()]
    assert sum(a != b for a, b in zip(order, order[1:])) < 40  # by chance 100
