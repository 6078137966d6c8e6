import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from archgraph.llm import token_files
from archgraph.llm.token_files import decode_numbers, encode_numbers, read_token_files, write_token_files
from archgraph.session import new_folder

NUMBER = st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1), st.sampled_from([255, 256, 65535, 65536, 2**24 - 1, 2**24]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(NUMBER, max_size=11), max_size=6))
def test_numbers_come_back(rows):
    values = np.array([x for row in rows for x in row], dtype=np.uint32)
    counts = np.array([len(row) for row in rows], dtype=np.int64)
    control, data, controls, widths = encode_numbers(values, counts)
    assert len(control) == controls.sum() == sum(-(-n // 4) for n in counts)
    assert len(data) == widths.sum() == sum(max(1, (int(x).bit_length() + 7) // 8) for x in values)
    assert decode_numbers(control, data, counts).tolist() == values.tolist()


@pytest.mark.parametrize("frame_ids", [1 << 18, 16])
def test_files_hold_all_texts_in_order(spark, odd, monkeypatch, frame_ids):
    monkeypatch.setattr(token_files, "FRAME_IDS", frame_ids)
    folder = new_folder(spark, "token-files")
    write_token_files(odd, folder, path("word_bpe_49k.json"))
    rows = read_token_files(spark, folder).orderBy("start").collect()
    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    keys = [r.key for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at, got = 0, Counter()
    for r in rows:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
        got[r.key, zlib.crc32(bytes(r.ids))] += 1
    encode = lambda text: np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
    assert got == Counter((r.doc_id, zlib.crc32(encode(r.text))) for r in odd.collect())


def test_common_ids_take_one_byte(spark, make):
    folder = new_folder(spark, "token-files")
    write_token_files(make([(i, "the the the of and", "a") for i in range(50)]), folder, path("word_bpe_49k.json"))
    ranks = [r.n for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()]
    assert ranks == sorted(ranks, reverse=True) and ranks[0] == 150
    sizes = spark.read.parquet(f"{folder}/frames").agg(F.sum("ids_total"), F.sum(F.length("data"))).first()
    assert sizes[0] == sizes[1] == 300


def test_empty_table(spark, nothing):
    folder = new_folder(spark, "token-files")
    write_token_files(nothing, folder, path("word_bpe_49k.json"))
    assert read_token_files(spark, folder).collect() == []
