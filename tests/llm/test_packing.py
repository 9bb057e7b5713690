import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, nothing
from pyspark.sql import functions as F

from wanderlake.llm import packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["ΟΔΟΣ ΣΑΣ x", "Don't STOP'S it's", "x\x1cy\x85z q", "<|endoftext|> a<|endoftext|>b", "ͅ ̀ e ́", "12 3４", "İI ß", "🙂👍🏽 ok", "Ünder, straße. naïve,. a.b", "end., x.. 'll", "J̌ǰ"]


def whole(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(VOCABULARY).encode(text or "", add_special_tokens=False).ids, 0]


def test_pieces_equal_the_tokenizer_on_whole_texts(spark):
    docs = documents(spark, [*TEXTS, None, "", "the cat, sat. " * 3000, "y" * 9000])
    got = {}
    for r in packing.token_pieces(docs, VOCABULARY, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append(r)
    for r in docs.dropDuplicates(["doc_id"]).collect():
        want = np.array(whole(r.text), "<u4")
        pieces = sorted(got[r.doc_id], key=lambda p: p.piece)[:: 3 if r.doc_id == len(TEXTS) + 3 else 1]
        assert b"".join(bytes(p.ids) for p in pieces) == want.tobytes()
        assert [p.start for p in pieces] == list(range(0, len(want), 2048)) and all(p.length == 2048 for p in pieces[:-1])
        assert all(p.ids_crc32 == zlib.crc32(bytes(p.ids)) for p in pieces)


def check(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("parts,task", [(1, 10**6), (16, 10**6), (16, 50)])
def test_packing_is_tight(spark, parts, task):
    items = spark.range(3000, numPartitions=parts).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).alias("length"), F.lit(9).alias("offset"))
    rows = packing.pack(items, capacity=1024, task_items=task, fan_in=4).collect()
    assert sorted(r.id for r in rows) == list(range(3000))
    at_once = max(packing.best_fit(sorted((r.length for r in rows), reverse=True), 1024)[0]) + 1
    assert check(rows, 1024) <= (1.01 if task > 3000 else 1.03) * at_once


def test_items_that_never_fit_together(spark):
    items = spark.range(500, numPartitions=5).selectExpr("id", "600 as length")
    rows = packing.pack(items, capacity=1000, task_items=40).collect()
    assert check(rows, 1000) == 500 and len(rows) == 500


def test_best_fit():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8])
    assert packing.best_fit([], 10) == ([], [])


def test_empty(spark):
    assert packing.pack(packing.token_pieces(nothing(spark), VOCABULARY)).count() == 0


def test_a_worker_reads_its_vocabulary_once():
    """Later tasks of a worker have the same table of words; its ids are the tokenizer's own, of texts as bytes."""
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    first = packing.WordIds.of(vocabulary)
    texts = ["Plain words, Again.", "déjà vu ÉTÉ", "", "tabs\tand\u00a0more 12%"]
    own = [np.asarray([*Tokenizer.from_file(vocabulary).encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts]
    assert first.encode([t.encode() for t in texts], b"\0\0\0\0") == own
    assert packing.WordIds.of(vocabulary) is first and b"again." in first
