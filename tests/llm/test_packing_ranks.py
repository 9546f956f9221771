"""Both ways to number the rests of a length, and the ids of the faster library against those of the tokenizer file's own."""

import numpy as np
from test_operators import check_packing

from pagedelta.llm import packing
from pagedelta.llm.common import table


def test_both_ways_of_ranking_place_every_id(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition(5)
    encode = packing.encoder(packing.default_tokenizer())
    want = {r.doc_id: np.append(encode(r.text or ""), 0).astype("<u4") for r in docs.collect()}
    for parts in (packing.TABLE_PARTS, 0):
        monkeypatch.setattr(packing, "TABLE_PARTS", parts)
        check_packing(packing.pack(docs, packing.default_tokenizer()).collect(), want, packing.WINDOW)


def test_ids_are_those_of_the_tokenizer_file(spark):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    for text, ids in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.array_equal(encode(text), np.array(ids.ids, np.uint32))
