import os
import struct

import pytest
import sentencepiece

from curatrix.llm import sentencepiece_codec as C
from curatrix.llm.queries import SENTENCEPIECE_MODEL

needs_model = pytest.mark.skipif(not os.path.exists(SENTENCEPIECE_MODEL), reason="the public model file is not here")
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b   ", "\n", "\t x", "▁", "a▁b", "▁▁", "é😀\x00b", "<s> </s>", "<unk>", "<0x41>", "l'été\n\nà", "x" * 5000, "漢字 " * 300]


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def unigram_model(byte_fallback=True, squeeze=0):
    """A hand-written unigram model, scored by hand; nothing is trained."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    if byte_fallback:
        pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)]
    text = ["▁", "▁the", "▁th", "the", "e", "t", "h", "he", "▁a", "a", "b", "ab", "▁ab", "c", "abc", "n", "an", "▁an", "é", "▁▁"]
    pieces += [(p, -1.0 - 0.37 * i, 1) for i, p in enumerate(text)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    trainer = field(3, 1) + field(35, int(byte_fallback)) + field(40, 0) + field(41, 1) + field(42, 2)
    normal = field(1, b"identity") + field(3, 1) + field(4, squeeze) + field(5, 1)
    return data + field(2, trainer) + field(3, normal)


@needs_model
def test_parity_and_round_trip():
    codec = C.codec(SENTENCEPIECE_MODEL)
    ids, parity = codec.encode(ODD)
    assert all(parity)
    assert [x.tolist() for x in ids] == codec.peer.encode(ODD)
    assert [codec.decode(x.tolist()) for x in ids] == [t.replace("▁", " ") for t in ODD]
    whole = [e.ids for e in codec.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    assert whole == [x.tolist() for x in ids]
    assert codec.tokenizer.decode_batch(whole, skip_special_tokens=False)[-2] == "x" * 5000


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model(tmp_path, squeeze):
    path = tmp_path / "hand.model"
    path.write_bytes(unigram_model(squeeze=squeeze))
    codec = C.Codec(str(path))
    assert codec.model.kind == C.UNIGRAM and codec.model.byte_fallback
    texts = ["the abc the", "thean", "ab  ab", "é ü the", "", "the"]
    peer = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ids, parity = codec.encode(texts)
    assert [x.tolist() for x in ids] == peer.encode(texts) and all(parity)


def test_other_model_kinds_are_refused():
    with pytest.raises(ValueError, match="neither"):
        C.build_tokenizer(C.parse_model(field(1, field(1, b"<unk>") + field(3, 2)) + field(2, field(3, 3))))


@needs_model
def test_rows(spark):
    rows = [(i, t, "kept", 7) for i, t in enumerate([*ODD, None, "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string, n_tokens int")
    made = C.encode_texts(docs, "text", SENTENCEPIECE_MODEL, threads=2)
    assert made.columns == ["doc_id", "text", "extra", *C.NEW]
    found = {r["doc_id"]: r for r in made.collect()}
    for i, t, _, _ in rows:
        assert found[i]["lossless"] == ("▁" not in (t or "")) and found[i]["parity"] and found[i]["extra"] == "kept"
        assert found[i]["n_tokens"] == len(found[i]["token_ids"])
    back = C.decode_ids(made.select("doc_id", "token_ids"), "token_ids", SENTENCEPIECE_MODEL).collect()
    assert {r["doc_id"]: r["decoded"] for r in back} == {i: (t or "").replace("▁", " ") for i, t, _, _ in rows}
    assert C.encode_texts(docs.limit(0), "text", SENTENCEPIECE_MODEL).count() == 0


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_decoding_by_parts_equals_decoding_whole_texts(tmp_path, byte_fallback):
    path = tmp_path / "hand.model"
    path.write_bytes(unigram_model(byte_fallback))
    codec = C.Codec(str(path))
    texts = [*ODD, "the abc the", "the é ü", "the abc the"]
    for _ in range(2):
        ids, _, whole = codec.encode_beside(texts)
        assert codec.decode_beside(ids, texts, whole) == codec.decode_beside(ids, texts)
        assert all(w <= same for w, (_, same) in zip(whole, codec.decode_beside(ids, texts), strict=True))
        assert whole[-3] and whole[-1] and not whole[ODD.index("a▁b")] and whole[ODD.index("漢字 " * 300)] == byte_fallback
    # A part with wrong ids is told where it is learnt.
    codec._made, codec._before = {}, {}
    learn = codec._encode_all
    codec._encode_all = lambda some: [[4] for _ in some] if len(some) == 1 else learn(some)
    codec._learn(["xyz"])
    assert "xyz" in codec._lossy and codec.encode_beside(["the abc the"])[2] == [True]


def test_a_part_is_looked_up_once_for_many_texts(tmp_path):
    path = tmp_path / "hand.model"
    path.write_bytes(unigram_model())
    codec = C.Codec(str(path))
    texts = [*ODD, "the abc the", "ab  ab", "the an"] * 50
    looked = []

    class Counted(dict):
        def __getitem__(self, part):
            looked.append(part)
            return dict.__getitem__(self, part)

    codec._made = Counted()
    ids, _, whole = codec.encode_beside(texts)
    assert [x.tolist() for x in ids] == [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert whole == [same and C.MARK not in t for t, (_, same) in zip(texts, codec.decode_beside(ids, texts), strict=True)]
    # Once where it is decoded, once for all texts that hold it.
    assert len(looked) == 2 * len(set(looked)) == 2 * len(codec._made)


def test_a_worker_that_encodes_parts_holds_one_tokenizer(tmp_path):
    path = tmp_path / "hand.model"
    path.write_bytes(unigram_model())
    codec = C.Codec(str(path))
    ids, _ = codec.encode(["the abc the"])
    assert codec.by_parts and "tokenizer" not in vars(codec)
    assert codec.tokenizer.encode("the abc the", add_special_tokens=False).ids == ids[0].tolist()
