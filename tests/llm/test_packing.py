import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from halyard.llm import packing
from halyard.llm.bpe import Encoder
from halyard.llm.queries import packed

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True
OWN = Encoder(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text("ab '’strevmldZé\n\t \r½².!<|>\x00🙂漢", max_size=40)), max_size=5))
def test_ids_are_the_tokenizers(texts):
    ids, counts = OWN.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == [plain_ids(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 3, 1023, 1024, 1025, 5000])
def test_cuts(n):
    found = packing.cuts(n)
    assert sum(found) == n and all(x & (x - 1) == 0 and x <= 1024 for x in found)
    assert len([x for x in found if x < 1024]) == len({x for x in found if x < 1024})


def test_only_powers_of_two(odd):
    with pytest.raises(ValueError):
        packing.pack(odd, PATH, max_tokens=1000)


def check(docs):
    pieces = packing.pack(docs, PATH).collect()
    rows = docs.collect()
    assert len({p["sequence_id"] for p in pieces}) == len(pieces)
    assert all(p["offset"] == 0 and p["bucket"] == p["length"] and len(p["ids"]) == 4 * p["length"] for p in pieces)
    by_doc, at = [], 0
    for p in sorted(pieces, key=lambda p: p["sequence_id"]):
        if p["start"] == 0:
            by_doc.append([p["doc_id"], b"", p["doc_tokens"]])
        assert 4 * p["start"] == len(by_doc[-1][1])
        by_doc[-1][1] += bytes(p["ids"])
    assert sorted(map(str, ((d, np.frombuffer(x, "<u4").tolist(), n) for d, x, n in by_doc))) == sorted(map(str, ((r["doc_id"], ids := plain_ids(r["text"]), len(ids)) for r in rows)))


def test_every_id_once(odd):
    check(odd)


def test_whole_table(small_docs):
    check(small_docs)


def test_digest_columns(small_docs):
    pieces = {(p["doc_id"], p["start"]): p for p in packing.pack(small_docs, PATH).collect()}
    for r in packed(small_docs).collect():
        assert r["ids_crc32"] == zlib.crc32(bytes(pieces[r["doc_id"], r["start"]]["ids"]))


def test_empty_table_and_clashing_names(odd, empty):
    assert packing.pack(empty, PATH).count() == 0
    clash = odd.withColumnRenamed("source", "ids").withColumnRenamed("n_chars", "sequence_id")
    assert packing.pack(clash, PATH).count() == packing.pack(odd, PATH).count()


def test_added_tokens_have_the_ids_of_the_tokenizer_as_loaded():
    loaded = Tokenizer.from_file(PATH)
    added = [t.content for t in loaded.get_added_tokens_decoder().values()]
    assert added
    texts = ["plain", *(f"a {x} b{x}{x}" for x in added), "", added[0], "last one's"]
    ids, counts = OWN.encode(texts)
    ends = np.cumsum(counts)
    expected = [loaded.encode(x, add_special_tokens=False).ids + [0] for x in texts]
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts)] == expected
    assert expected[1] != plain_ids(texts[1])
